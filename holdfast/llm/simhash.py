"""SimHash near-duplicates: fingerprints, an inverted index on positional bytes, exact components.

Two fingerprints that differ in at most ``MAX_BITS`` = 4 bits differ in at most 4 of their 8 bytes, so they
share at least 4 positional bytes. Pairs are counted where they can reach that minimum: any 4 of 8
positions contain at least one of the 20 position triples of ``TRIPLES``, so fingerprints are posted under
(triple, its three bytes) and meet in at least one posting. Within a posting shared positional bytes are
tallied, pairs with fewer than 4 are dropped and the rest are verified by their differing bits.

Exact copies are one fingerprint from the start. A posting gives a spanning forest of its links instead of
all pairs, and postings longer than ``BLOCK`` are dealt to tasks as pairs of blocks. Components are found by
alternating star contraction on the links, each round a written table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import map_texts
from holdfast.session import durable

SHINGLE = 4
MAX_BITS = 4
BLOCK = 2048
_GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))


def position_triples() -> list[tuple[int, int, int]]:
    """Triples of positions such that any four of the eight contain one: three in a group of positions,
    or two in a group and one in the next."""
    group = {p: g for g, members in enumerate(_GROUPS) for p in members}

    def chosen(triple: tuple[int, int, int]) -> bool:
        of = sorted(group[p] for p in triple)
        if of[0] == of[2]:
            return True
        twice, once = (of[0], of[2]) if of[0] == of[1] else (of[2], of[0])
        return len(set(of)) == 2 and (twice + 1) % len(_GROUPS) == once

    return [t for t in combinations(range(8), 3) if chosen(t)]


TRIPLES = position_triples()


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text's word shingles; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist()
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(view[a:b], 42) for a, b in zip(starts, ends[size - 1:].tolist())], np.uint64, len(starts))
    set_bits = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 14):
        part = hashes[a:a + (1 << 14)]
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * set_bits > len(hashes)).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``fp`` (the 64 bits as a long) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        def work(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
            fp = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([part.column("k0"), pa.array(fp)], ["doc_id", "fp"])

        return work

    return map_texts(docs, [id_col], text_col, f"doc_id {kind}, fp long", make)


def _byte(position: int) -> Column:
    return F.shiftrightunsigned("fp", 8 * position).bitwiseAND(F.lit(255))


def postings(distinct: DataFrame) -> DataFrame:
    """(``key``, ``fp``): every fingerprint under each position triple and its three bytes."""
    keys = [F.lit(i << 24).cast("long") + _byte(a) * 65536 + _byte(b) * 256 + _byte(c)
            for i, (a, b, c) in enumerate(TRIPLES)]
    return distinct.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _forest(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of distinct fingerprints.

    The search goes outward from one fingerprint at a time; it tallies the positional bytes shared with
    every fingerprint not reached yet, keeps those at the minimum and verifies their bits.
    """
    left = np.sort(fps.view(np.uint64))
    octets = left.view(np.uint8).reshape(-1, 8)
    least = 8 - max_bits
    out: list[tuple[np.ndarray, np.uint64]] = []
    frontier: list[np.uint64] = []
    while len(left):
        if not frontier:
            frontier.append(left[0])
            left, octets = left[1:], octets[1:]
        p = frontier.pop()
        shared = (octets == np.array([p]).view(np.uint8)).sum(axis=1)
        near = np.flatnonzero(shared >= least)
        near = near[np.bitwise_count(left[near] ^ p) <= max_bits]
        if len(near):
            out.append((left[near], p))
            frontier.extend(left[near])
            stay = np.ones(len(left), bool)
            stay[near] = False
            left, octets = left[stay], octets[stay]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return (np.concatenate([a for a, _ in out]).view(np.int64),
            np.concatenate([np.full(len(a), p) for a, p in out]).view(np.int64))


def links(distinct: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Verified links (``a``, ``b``) between fingerprints: enough of them to connect every component.

    ``max_bits`` may be at most 4, which is what the positional index guarantees to find.
    """
    if not 0 <= max_bits <= 4:
        raise ValueError("the positional index finds differences of at most 4 bits")
    posted = postings(distinct)
    sizes = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    dealt = posted.join(sizes, "key").select(
        "key", "fp", F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("own"), F.sequence(F.lit(0), blocks - 1).alias("others"))
    # Blocks i and j of a posting meet in the unit (i, j); a posting of one block is the unit (0, 0).
    units = dealt.select("key", "fp", "own", F.explode("others").alias("other")).groupBy(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    ).agg(F.collect_list("fp").alias("fps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("fps")
            flat, at = column.flatten().to_numpy(), (column.offsets.to_numpy() - column.offsets[0].as_py())
            found = []
            pair = np.diff(at) == 2
            first = at[:-1][pair]
            a, b = flat[first], flat[first + 1]
            close = np.bitwise_count((a ^ b).view(np.uint64)) <= max_bits
            found.append((a[close], b[close]))
            for s, e in zip(at[:-1][~pair].tolist(), at[1:][~pair].tolist()):
                found.append(_forest(flat[s:e], max_bits))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1)], ["a", "b"])

    found = units.select("fps").mapInArrow(run, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``root``) for every node of ``edges`` (``a``, ``b``): the smallest node of its component.

    Alternating large-star and small-star contraction; every round is written to the shared folder, and
    rounds end when the set of links no longer changes. A star's links are grouped by their node with
    only its smallest neighbour carried, so a node with very many links is summed before it is moved.
    """
    edges = durable(edges.select("a", "b"))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: every larger neighbour is linked to the smallest one.
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = durable(large.where("a <> b"))
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")
        ).select("e.*").where("a <> b").distinct()
        edges = durable(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        before = now


def _hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` and
    ``component`` (a fingerprint that names the component).

    ``component_id`` is the smallest id reachable over links of at most ``max_bits`` differing bits, the
    row's own included. NULL and empty texts and texts without words have fingerprint zero and are linked
    like any other. NULL ids are not candidates for ``component_id``; a component of NULL ids only has
    NULL. Rows with equal ids keep a row each. An empty table gives no rows; other columns are not read.
    """
    marked = durable(fingerprints(docs, id_col, text_col, shingle))
    distinct = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    rooted = components(links(distinct, max_bits))
    # A fingerprint of one row without links is a component of its own and needs no look-up.
    grouped = distinct.join(rooted, distinct["fp"] == rooted["node"], "left").where("root is not null or n > 1").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = grouped.join(smallest, "root").select("fp", "component_id", "root")
    return marked.join(named, "fp", "left").select(
        "doc_id", _hex(F.col("fp")).alias("fingerprint"),
        F.coalesce("component_id", "doc_id").alias("component_id"), _hex(F.coalesce("root", "fp")).alias("component"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
             max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each near-duplicate component, with the columns of ``docs``.

    The row whose id is ``component_id`` stays. Where several rows carry that id, and in a component whose
    ids are all NULL, the row that is smallest by its text and then by its other columns stays.
    """
    found = durable(near_duplicates(docs, id_col, text_col, shingle, max_bits))
    named = durable(found.where("component_id is not null").select(F.col("component_id").alias("_keep")).distinct())
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), F.col(f"`{id_col}`").alias("_id"))
    # Ids of several rows, normally none: only such rows are compared by their contents.
    again = durable(found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
                    .where("n > 1").select(F.col("doc_id").alias("_again")))
    # The kept ids grow with the rows: always a sorted join, so that small tables run the plan of large ones.
    named = named.hint("merge")
    chosen = F.col("_id") == F.col("_keep")
    once = rows.join(again, F.col("_id") == F.col("_again"), "left_anti").join(named, chosen, "left_semi")
    least = F.min_by("row", F.struct(F.col(f"row.`{text_col}`"), F.to_json("row"))).alias("row")
    several = rows.join(again, F.col("_id") == F.col("_again"), "left_semi").join(named, chosen, "left_semi")
    first = several.groupBy("_id").agg(least)

    def make():
        def work(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
            fp = [f"{fingerprint(t, shingle):016x}" for t in texts]
            return pa.RecordBatch.from_arrays([part.column("k0"), pa.array(fp, pa.string())], ["row", "print"])

        return work

    unnamed = map_texts(docs.where(F.col(f"`{id_col}`").isNull()), [row], text_col,
                        f"row {docs.schema.simpleString()}, print string", make)
    alone = found.where("component_id is null").select("fingerprint", "component").distinct()
    lone = unnamed.join(alone, unnamed["print"] == alone["fingerprint"]).groupBy("component").agg(least)
    return once.select("row.*").unionByName(first.select("row.*")).unionByName(lone.select("row.*"))
