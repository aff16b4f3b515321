"""Readers, writers and derived customer tables."""
