"""Cut points, bucketed tables, distributed CSV records, published results, monitoring state and profiles."""

import math
import os
import random
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.operators import campaign, cuts, monitoring, profile, targeting
from holdfast.plans import queries
from holdfast.schema import ID, TARGET
from holdfast.session import durable, new_scratch_path
from holdfast.sources import csv, results, store


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def doubles(rng, kind, n):
    if kind == "ties":
        return [rng.choice([0.25, 0.5, 0.75]) for _ in range(n)]
    if kind == "near":  # neighbouring doubles
        first = struct.unpack("<q", struct.pack("<d", 0.3))[0]
        return [struct.unpack("<d", struct.pack("<q", first + rng.randrange(5)))[0] for _ in range(n)]
    if kind == "tiny":
        return [rng.choice([0.0, 5e-324, 1e-300, 1e-9, 1.0]) for _ in range(n)]
    return [rng.random() for _ in range(n)]


@pytest.mark.parametrize("kind", ["ties", "near", "tiny", "even"])
@pytest.mark.parametrize("key", ["long", "string"])
def test_cut_points_are_the_sorted_rows(spark, kind, key):
    rng = random.Random(kind)
    n = 400
    ids = list({rng.randrange(-(2**62), 2**62) for _ in range(n)}) if key == "long" else [f"{rng.choice('aé中')}{'x' * (i % 3)}{i}" for i in range(n)]
    rows = list(zip(ids, doubles(rng, kind, n)))
    df = durable(spark.createDataFrame(rows, f"k {key}, p double").repartition(3))
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    places = [0, 1, 2, 37, 200, 399, 400, 401]
    got = cuts.cut_points(df, places, "p", "k")
    assert set(got) == {p for p in places if 0 < p <= n}
    for place in places:
        inside = {r.k for r in df.where(cuts.is_inside(got.get(place), "p", "k")).collect()} if place <= n else set(ids)
        assert inside == {k for k, _ in order[:place]}, place


def test_shares_are_found_without_sorting(spark):
    df = durable(spark.range(500).select(F.col("id").alias(ID), (F.col("id") % 2).cast("int").alias(TARGET),
                                         (F.col("id") * 37 % 101 / 101).alias("p"), F.col("id").cast("double").alias("rev_Mean")))
    for result in (targeting.capture_lift_curve(df, 500), targeting.top_summary(df, 500), targeting.top_share(df, 500)):
        assert "rangepartitioning" not in plan(result)
    assert targeting.top_share(df, 500).count() == 100


def test_values_at_reads_counts_only(spark):
    df = spark.createDataFrame([(x,) for x in (5, 1, None, 3, 3, 9)], "x long")
    assert cuts.values_at(df, "x", [0, 1, 2, 3, 5, 6]) == {1: (1, 0), 2: (3, 1), 3: (3, 1), 5: (9, 4)}
    assert cuts.values_at(df.where("x > 9"), "x", [1]) == {}


def test_bucketed_tables_join_without_moving_rows(spark):
    left = spark.range(1000).select(F.col("id").alias(ID), F.rand(1).alias("a"))
    right = spark.range(500, 1500).select(F.col("id").alias(ID), F.rand(2).alias("odd name"))
    folder = new_scratch_path(spark)
    one, two = store.save_bucketed(left, f"{folder}/one", buckets=4), store.save_bucketed(right, f"{folder}/two", buckets=4)
    joined = store.join_stores(one, two)
    assert "Exchange" not in plan(joined) and joined.count() == 500
    spark.sql(f"DROP TABLE {store._name(folder + '/two')}")  # as in a later session
    again = store.join_stores(one, store.open_bucketed(spark, f"{folder}/two"))
    assert "Exchange" not in plan(again)
    assert sorted(again.collect()) == sorted(left.join(right, ID).collect())
    assert store.save_bucketed(left.limit(3), f"{folder}/one", buckets=4).count() == 3


FIELDS = ["plain", "", "two words", 'a "quoted" word', "line\nbreak", "a,b", "\n\n", '"', "x\n\"y\"\n,z", "é中", " pad "]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [400, 8192])
def test_records_with_line_breaks_are_read_by_many_tasks(spark, tmp_path, end, size):
    rng = random.Random(size)
    want = []
    (tmp_path / "t").mkdir()
    for part in range(2):
        rows = [(str(part * 1000 + i), rng.choice(FIELDS), rng.choice(FIELDS)) for i in range(80)]
        want += rows
        lines = [",".join('"' + f.replace('"', '""') + '"' if re.search(r'[",\n]', f) else f for f in r) for r in rows]
        text = end.join(["id,first col,b", *lines, ""])
        (tmp_path / "t" / f"{part}.csv").write_bytes(text.encode())
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        tasks = spark.read.option("lineSep", "\n").text(str(tmp_path / "t")).rdd.getNumPartitions()
        got = csv.read_raw(spark, str(tmp_path / "t"))
        found = sorted((tuple(r) for r in got.collect()), key=lambda r: int(r[0]))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got.columns == ["id", "first col", "b"] and (tasks > 2 or size == 8192)
    plain = spark.read.options(header=True, escape='"', multiLine=True).csv(str(tmp_path / "t")).collect()
    assert found == sorted((tuple(r) for r in plain), key=lambda r: int(r[0]))
    assert [(r[0], r[1] or "", r[2] or "") for r in found] == sorted(want, key=lambda r: int(r[0]))


def test_files_with_other_headers_fail(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x\n1,2\n")
    (tmp_path / "b.csv").write_text("id,y\n1,2\n")
    with pytest.raises(Exception, match="Another header"):
        csv.read_raw(spark, str(tmp_path)).collect()


def test_a_failed_run_leaves_the_results_before_it(spark, tmp_path):
    root = f"file://{tmp_path}/runs"
    with pytest.raises(FileNotFoundError):
        results.current(spark, root)
    for value in (1, 2):
        with results.publishing(spark, root) as folder:
            results.write_result(spark.range(value), f"{folder}/rows")
            results.write_result(spark.range(value + 5), f"{folder}/more")
        assert spark.read.parquet(f"{results.current(spark, root)}/rows").count() == value
    with pytest.raises(RuntimeError, match="killed"):
        with results.publishing(spark, root) as folder:
            results.write_result(spark.range(9), f"{folder}/rows")
            raise RuntimeError("killed")
    assert spark.read.parquet(f"{results.current(spark, root)}/rows").count() == 2
    assert spark.read.parquet(f"{results.current(spark, root)}/more").count() == 7
    assert results.discard_others(spark, root) == 2 and len(os.listdir(tmp_path / "runs" / "sets")) == 1


def test_state_gives_the_direct_results(spark):
    rng = random.Random(3)
    rows = [(i, rng.gauss(0, 1), rng.choice([None, 1.0, 2.0, 3.0]), rng.random(), rng.randrange(2)) for i in range(900)]
    df = durable(spark.createDataFrame(rows, f"{ID} long, a double, b double, p double, {TARGET} int"))
    old, new = durable(df.where(f"{ID} < 400")), durable(df.where(f"{ID} >= 400").withColumn("a", F.col("a") + 0.5))
    frozen = monitoring.freeze_bins(old, ["a", "b"])
    path = new_scratch_path(spark)
    monitoring.save_state(path, frozen=frozen, reference=monitoring.count_bins(old, frozen))
    frozen, reference = monitoring.load_state(spark, path, "frozen", "reference")
    weeks = [monitoring.count_bins(new.where(f"{ID} % 3 = {i}"), frozen) for i in range(3)]
    got = {r.feature: r.psi for r in monitoring.drift(reference, monitoring.add_counts(*weeks)).collect()}
    assert got == pytest.approx({r.feature: r.psi for r in campaign.feature_drift(old, new, ["a", "b"]).collect()})
    assert got["a"] > 0.1
    counts = monitoring.add_counts(*[monitoring.count_scores(df.where(f"{ID} % 2 = {i}")) for i in range(2)])
    table = {r.bin: (r.customers, pytest.approx(r.mean_p), pytest.approx(r.observed_rate)) for r in monitoring.calibration(counts).collect()}
    assert table == {r.bin: (r.customers, r.mean_p, r.observed_rate) for r in campaign.calibration_table(df).collect()}
    one, two = monitoring.calibration_error(counts).first(), campaign.calibration_summary(df).first()
    assert tuple(one) == pytest.approx(tuple(two))


def test_drift_reads_a_week_once(spark):
    week = spark.range(50).select(F.col("id").cast("double").alias("a"))
    frozen = monitoring.freeze_bins(durable(week), ["a"])
    assert plan(monitoring.count_bins(week, frozen)).count("Range (") == 1


def test_binned_density_is_close_to_the_exact_sum(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=300), rng.exponential(size=200) * 3])
    rows = [(i % 2, float(v)) for i, v in enumerate(values)] + [(0, None), (None, 1.0)]
    df = durable(spark.createDataFrame(rows, f"{TARGET} int, x double"))
    got = {(r[TARGET], r.point): (r.x, r.density) for r in profile.binned_density(df, ["x"], bins=256).collect()}
    for label in (0, 1):
        own = values[label::2]
        bw = own.std(ddof=1) * len(own) ** -0.2
        step = (own.max() - own.min() + 6 * bw) / 255
        bound = (step / bw) ** 2 / 8 * len(own) / (bw * math.sqrt(2 * math.pi) * len(values))
        for point in range(200):
            x, density = got[label, point]
            exact = np.exp(-0.5 * ((x - own) / bw) ** 2).sum() / (bw * math.sqrt(2 * math.pi) * len(values))
            assert abs(density - exact) <= bound + 1e-12


def test_correlated_pairs_over_rows_that_have_both(spark):
    rng = np.random.default_rng(7)
    a = rng.normal(size=500)
    columns = {"a": a * 1e6 + 1e9, "b": a + 0.1 * rng.normal(size=500), "c": rng.normal(size=500), "d": -a, "e": np.full(500, 3.0)}
    rows = [tuple(None if rng.random() < 0.2 else float(columns[c][i]) for c in columns) for i in range(500)]
    df = durable(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)))
    got = {(r.feature_a, r.feature_b): (r.customers, r.correlation) for r in profile.correlated_pairs(df, list(columns), 0.9).collect()}
    table = np.array([[math.nan if v is None else v for v in r] for r in rows])
    want = {}
    for i, x in enumerate("abcd"):
        for j, y in enumerate("abcd"):
            both = ~np.isnan(table[:, i]) & ~np.isnan(table[:, j])
            r = np.corrcoef(table[both, i], table[both, j])[0, 1]
            if i < j and abs(r) >= 0.9:
                want[x, y] = (both.sum(), pytest.approx(r))
    assert got == want and set(got) == {("a", "b"), ("a", "d"), ("b", "d")}
    assert profile.correlated_pairs(df, ["e"], 0.9).count() == 0


def test_cube_has_all_subtotals(spark):
    df = spark.createDataFrame([("x", "p", 1), ("x", "q", 0), (None, "p", 1), ("y", "p", None)], f"s string, part string, {TARGET} int")
    got = {(r.s, r.part, r.s_total, r.part_total): (r.customers, r.churners) for r in profile.segment_cube(df, "s", "part").collect()}
    assert got[None, None, 1, 1] == (3, 2) and got["x", None, 0, 1] == (2, 1) and got[None, "p", 1, 0] == (2, 2)
    assert got[None, "p", 0, 0] == (1, 1) and got[None, None, 0, 1] == (1, 1) and len(got) == 8


def test_weekly_store_query_has_no_exchange(spark, folder):
    text = plan(queries.store_join(spark, folder))
    assert "SortMergeJoin" in text and "Exchange" not in text
