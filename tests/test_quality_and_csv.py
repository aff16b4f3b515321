import pytest
from pyspark.sql import functions as F

from holdfast.operators import quality
from holdfast.schema import CATEGORICAL_PREDICTORS, DERIVED_FEATURES, ID, NUMERIC_PREDICTORS
from holdfast.sources import csv, results


def report(client, record):
    return {(r.table_name, r.rule): r.violations for r in quality.dq_report(client, record).collect()}


def test_duplicate_null_and_one_sided_keys(spark):
    client = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0), (None, 4.0), (7, 5.0)], f"{ID} long, x double")
    record = spark.createDataFrame([(1, 0), (2, None), (3, 2)], f"{ID} long, churn int")
    got = report(client, record)
    assert got[("client", "id_unique")] == 2 and got[("record", "id_unique")] == 0
    assert got[("client", "id_not_null")] == 1
    assert got[("joined", "same_ids")] == 3  # 7 on the left, 2 and 3 on the right
    assert got[("joined", "target_not_null")] == 1 and got[("joined", "target_is_0_or_1")] == 1
    with pytest.raises(ValueError, match="client.id_unique: 2"):
        quality.validate(client, record)
    sides = {r.side: r.ids for r in quality.key_coverage(client, record).collect()}
    assert sides == {"left_only": 1, "right_only": 2, "both": 1}
    assert [(r.key, r.copies) for r in quality.duplicate_keys(client, ID, "c").collect()] == [(1, 3)]


def test_missing_columns_are_reported(spark):
    client = spark.createDataFrame([(1, 1.0)], "other long, x double")
    record = spark.createDataFrame([(1, 1.0)], f"{ID} long, y double")
    got = report(client, record)
    assert got[("client", "id_present")] == 1 and got[("joined", "target_present")] == 1


def test_csv_markers_types_and_validation(spark, tmp_path):
    (tmp_path / "Client.csv").write_text(f"area,{ID},mystery,hnd_price\nNORTH,1,5,10\nNA,2,n/a,\n#N/A,3,7.5,nan\n")
    (tmp_path / "Record.csv").write_text(f"{ID},churn,mou_Mean\n1,1,2.5\n2,0,NULL\n3,1.0,inf\n")
    df = csv.load_customers(spark, str(tmp_path)).orderBy(ID)
    rows = df.collect()
    assert [r.area for r in rows] == ["NORTH", None, None]
    assert [r.mystery for r in rows] == [5.0, None, 7.5]
    assert [r.hnd_price for r in rows] == [10.0, None, None]
    assert [r.churn for r in rows] == [1, 0, 1]
    assert [r.mou_Mean for r in rows] == [2.5, None, None]  # infinity is no value
    (tmp_path / "Record.csv").write_text(f"{ID},churn\n1,1\n2,5\n")
    with pytest.raises(ValueError, match="same_ids: 1.*target_is_0_or_1: 1"):
        csv.load_customers(spark, str(tmp_path))


def test_results_round_trip(spark, tmp_path):
    metrics = spark.createDataFrame([("a", 0.7, 0.6, 0.5, 0.4, 0.3, 0.2)], results.METRICS_SCHEMA)
    results.write_result(metrics, str(tmp_path / "m"), "csv")
    assert results.read_result_csv(spark, str(tmp_path / "m"), results.METRICS_SCHEMA).collect() == metrics.collect()
    document = spark.range(1).select(F.struct(F.lit(6).alias("train")).alias("split_rows"), F.lit("x").alias("model"))
    results.write_document(document, str(tmp_path / "d"))
    assert results.read_document(spark, str(tmp_path / "d")).first().split_rows.train == 6


def test_column_dictionary():
    assert len(NUMERIC_PREDICTORS) == 77 and len(CATEGORICAL_PREDICTORS) == 21
    assert len(set(NUMERIC_PREDICTORS) | set(CATEGORICAL_PREDICTORS)) == 98
    assert len(DERIVED_FEATURES) == 34 and sum(f.kind == "difference" for f in DERIVED_FEATURES) == 4
    known = {*NUMERIC_PREDICTORS, *(f.name for f in DERIVED_FEATURES)}
    assert all({f.left, f.right} <= known for f in DERIVED_FEATURES)
    assert len(NUMERIC_PREDICTORS) + len(CATEGORICAL_PREDICTORS) + len(DERIVED_FEATURES) == 132
