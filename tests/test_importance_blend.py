"""The members' importances read one written table of their inputs, not the source tables again."""

from holdfast.operators import blend, scorecard
from holdfast.plans import queries


def test_members_share_a_written_table(spark, folder, monkeypatch):
    read, importance = [], scorecard.scorecard_importance
    monkeypatch.setattr(scorecard, "scorecard_importance", lambda df, terms: read.append(df) or importance(df, terms))
    rows = queries.importance_blend(spark, folder).collect()
    inputs = {t.feature for m in blend.TREE_ONLY_ENSEMBLE for t in scorecard.SCORECARDS[m]}
    assert {r.feature for r in rows} == {f"numeric__{f}" for f in inputs}
    assert len(read) == 3 and all(set(df.columns) == inputs for df in read)
    assert not any(f.endswith("lineitem.parquet") for df in read for f in df.inputFiles())
