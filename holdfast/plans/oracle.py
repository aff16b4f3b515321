"""Equivalent SQL for the registered queries, for a second engine to check them against.

Every statement is self-contained: it starts from the source tables and repeats the derivation as
common table expressions, independently of the DataFrame code.
"""

from __future__ import annotations

from holdfast.operators.importance import FRIENDLY, THEMES
from holdfast.operators.scorecard import ENGINEERED, HIST, INTERCEPT, SCORECARDS
from holdfast.schema import DERIVED_FEATURES, ID, TARGET

CATEGORIES = ("crclscod", "area", "prizm_social_one", "asl_flag")
COUNTS = {
    "attempt": "TRUE", "complete": "l_linestatus = 'F'", "drop_blk": "l_returnflag = 'R'",
    "plcd_vce": "p_size <= 25", "plcd_dat": "p_size > 25",
    "drop_vce": "p_size <= 25 AND l_returnflag = 'R'", "blck_vce": "p_size <= 25 AND l_returnflag = 'A'",
    "unan_vce": "p_size <= 25 AND l_returnflag = 'N'", "drop_dat": "p_size > 25 AND l_returnflag = 'R'",
    "blck_dat": "p_size > 25 AND l_returnflag = 'A'", "unan_dat": "p_size > 25 AND l_returnflag = 'N'",
    "recv_vce": "p_size <= 25 AND l_linestatus = 'O'",
    "peak_vce": "p_size <= 25 AND date_diff('day', DATE '1995-01-02', CAST(l_shipdate AS DATE)) % 7 < 5",
    "opk_vce": "p_size <= 25 AND NOT date_diff('day', DATE '1995-01-02', CAST(l_shipdate AS DATE)) % 7 < 5",
}
WINDOWS = (
    ("rev_Mean", 180, 6, "revenue"), ("avg3rev", 360, 12, "revenue"), ("avg6rev", 720, 24, "revenue"),
    ("mou_Mean", 180, 6, "usage_q"), ("avg3mou", 360, 12, "usage_q"), ("avg6mou", 720, 24, "usage_q"),
    ("totmrc_Mean", 180, 6, "charge"), ("ovrrev_Mean", 180, 6, "surcharge"), ("ovrmou_Mean", 180, 6, "overuse"),
)
NUMERIC = (
    *[w[0] for w in WINDOWS], *[f"{c}_Mean" for c in COUNTS], "change_mou", "avgrev", "avgmou", "totrev",
    "totmou", "totcalls", "custcare_Mean", "cc_mou_Mean", "uniqsubs", "actvsubs", "phones", "models",
    "hnd_price", "months", "eqpdays",
)


def subscriber(observed: str = "2000-01-01", suffix: str = "") -> str:
    """CTEs ending in ``subscriber<suffix>``."""
    x = suffix
    counts = ", ".join(f"SUM(CASE WHEN {cond} THEN 1 ELSE 0 END) AS n_{c}" for c, cond in COUNTS.items())
    sums = ", ".join(
        f"SUM(CASE WHEN age <= {d} THEN {m} ELSE 0 END) AS w_{n}" for n, d, _, m in WINDOWS)
    means = ", ".join(f"COALESCE(w_{n}, 0) / 10000.0::DOUBLE / {s}.0::DOUBLE AS {n}" for n, _, s, _ in WINDOWS)
    rates = ", ".join(f"COALESCE(n_{c}, 0)::DOUBLE / months AS {c}_Mean" for c in COUNTS)
    return f"""
past{x} AS (
  SELECT *, date_diff('day', CAST(o_orderdate AS DATE), DATE '{observed}') AS age FROM orders
  WHERE o_orderdate < DATE '{observed}' + INTERVAL 181 DAY),
usual{x} AS (
  SELECT o_custkey, o_orderpriority AS asl_flag FROM (
    SELECT o_custkey, o_orderpriority,
           ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY COUNT(*) DESC, o_orderpriority) AS rn
    FROM past{x} WHERE age >= 0 GROUP BY o_custkey, o_orderpriority) WHERE rn = 1),
tenure{x} AS (
  SELECT o_custkey,
         GREATEST(1.0::DOUBLE, FLOOR(MAX(CASE WHEN age >= 0 THEN age END) / 30.0::DOUBLE)) AS months,
         MIN(CASE WHEN age >= 0 THEN age END)::DOUBLE AS eqpdays,
         (1 - MAX(CASE WHEN age < 0 THEN 1 ELSE 0 END))::INTEGER AS churn
  FROM past{x} GROUP BY o_custkey HAVING MAX(age) >= 0),
lines{x} AS (
  SELECT o_custkey, age, l_suppkey, l_partkey, l_returnflag, l_linestatus, l_shipdate, p_size, p_brand, p_retailprice,
         CAST(FLOOR(l_extendedprice * (1.0::DOUBLE - l_discount) * 10000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS revenue,
         CAST(FLOOR(l_quantity * 10000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS usage_q,
         CAST(FLOOR(l_extendedprice * 10000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS charge,
         CAST(FLOOR(l_extendedprice * (1.0::DOUBLE - l_discount) * l_tax * 10000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS surcharge,
         CAST(FLOOR(GREATEST(l_quantity - 40.0::DOUBLE, 0.0::DOUBLE) * 10000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS overuse
  FROM lineitem JOIN past{x} ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE age >= 0),
facts{x} AS (
  SELECT o_custkey, {counts}, {sums}, SUM(revenue) AS totrev, SUM(usage_q) AS totmou,
         COUNT(DISTINCT l_suppkey) AS uniqsubs,
         COUNT(DISTINCT CASE WHEN age <= 720 THEN l_suppkey END) AS actvsubs,
         COUNT(DISTINCT l_partkey) AS phones, COUNT(DISTINCT p_brand) AS models, MAX(p_retailprice) AS hnd_price
  FROM lines{x} GROUP BY o_custkey),
care{x} AS (
  SELECT user_id, COUNT(*) AS care_calls,
         SUM(CAST(FLOOR(value * 10000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)) AS care_value
  FROM events WHERE event_type = 'error' GROUP BY user_id),
record0{x} AS (
  SELECT t.o_custkey AS {ID}, {means}, {rates},
         COALESCE(totrev, 0) / 10000.0::DOUBLE / months AS avgrev, COALESCE(totmou, 0) / 10000.0::DOUBLE / months AS avgmou,
         COALESCE(totrev, 0) / 10000.0::DOUBLE AS totrev, COALESCE(totmou, 0) / 10000.0::DOUBLE AS totmou,
         COALESCE(n_attempt, 0)::DOUBLE AS totcalls,
         care_calls::DOUBLE / months AS custcare_Mean, care_value / 10000.0::DOUBLE / months AS cc_mou_Mean,
         COALESCE(uniqsubs, 0)::DOUBLE AS uniqsubs, COALESCE(actvsubs, 0)::DOUBLE AS actvsubs,
         COALESCE(phones, 0)::DOUBLE AS phones, COALESCE(models, 0)::DOUBLE AS models,
         hnd_price::DOUBLE AS hnd_price, months, eqpdays, asl_flag, churn
  FROM tenure{x} t JOIN usual{x} u ON t.o_custkey = u.o_custkey
  LEFT JOIN facts{x} f ON t.o_custkey = f.o_custkey LEFT JOIN care{x} c ON t.o_custkey = c.user_id),
record{x} AS (
  SELECT *, (mou_Mean - avg3mou) / NULLIF(avg3mou, 0) * 100.0::DOUBLE AS change_mou FROM record0{x}),
client{x} AS (
  SELECT c_custkey AS {ID}, NULLIF(c_mktsegment, 'HOUSEHOLD') AS crclscod, n_name AS area, r_name AS prizm_social_one
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey),
subscriber{x} AS (
  SELECT r.*, crclscod, area, prizm_social_one FROM record{x} r JOIN client{x} c ON r.{ID} = c.{ID})"""


def engineered(source: str = "subscriber", name: str = "engineered") -> str:
    cells = []
    for f in DERIVED_FEATURES:
        if f.kind == "difference":
            cells.append(f"{f.left} - {f.right} AS {f.name}")
            continue
        times = f" * {f.times}::DOUBLE" if f.times != 1.0 else ""
        over = f" / {f.over}::DOUBLE" if f.over != 1.0 else ""
        cells.append(f"{f.left} / NULLIF({f.right}, 0){times}{over} AS {f.name}")
    return f"{name} AS (SELECT *, {', '.join(cells)} FROM {source})"


def parts(source: str, name: str = "parts", cuts: tuple[tuple[str, int], ...] = (("train", 60), ("validation", 80)),
          last: str = "test") -> str:
    whens = " ".join(f"WHEN pos <= FLOOR(cls * {c} / 100) THEN '{p}'" for p, c in cuts)
    return f"""{name} AS (
  SELECT * EXCLUDE (pos, cls), CASE {whens} ELSE '{last}' END AS part FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY {TARGET} ORDER BY md5(concat(CAST({ID} AS VARCHAR), '|42')), {ID}) AS pos,
           COUNT(*) OVER (PARTITION BY {TARGET}) AS cls FROM {source}))"""


def term_sql(t) -> str:
    return f"(COALESCE({t.feature}, {t.center}::DOUBLE) - ({t.center}::DOUBLE)) / {t.scale}::DOUBLE * ({t.weight}::DOUBLE)"


def logistic_sql(terms) -> str:
    z = f"({INTERCEPT}::DOUBLE)"
    for t in terms:
        z = f"({z} + {term_sql(t)})"
    return f"ROUND(1.0::DOUBLE / (1.0::DOUBLE + EXP(-({z}))), 9)"


def scored(source: str = "engineered", name: str = "scored") -> str:
    members = ", ".join(f"{logistic_sql(terms)} AS p_{m}" for m, terms in SCORECARDS.items())
    return f"""{name}0 AS (SELECT *, {members} FROM {source}),
{name}1 AS (SELECT *, ROUND(0.3::DOUBLE * p_hist + 0.1::DOUBLE * p_cat_d6 + 0.2::DOUBLE * p_cat_d7 + 0.4::DOUBLE * p_cat_d8, 9) AS p_ensemble FROM {name}0),
{name} AS (SELECT *, ROUND(0.65::DOUBLE * p_engineered + 0.35::DOUBLE * p_ensemble, 9) AS p FROM {name}1)"""


def long_models(source: str, name: str = "long_scores", members=("hist", "cat_d6", "cat_d7", "cat_d8", "engineered"),
                keep: str = f"{ID}, {TARGET}") -> str:
    rows = " UNION ALL ".join(f"SELECT {keep}, '{m}' AS model, p_{m} AS p FROM {source}" for m in members)
    return f"{name} AS ({rows})"


def one_model(source: str = "scored", name: str = "long_scores", where: str = "TRUE") -> str:
    return f"{name} AS (SELECT {ID}, {TARGET}, 'final' AS model, p FROM {source} WHERE {where})"


def ranking(source: str = "long_scores", name: str = "ranking") -> str:
    return f"""{name}_g AS (
  SELECT model, p, SUM(churn) AS tp, SUM(1 - churn) AS fp FROM {source} GROUP BY model, p),
{name}_c AS (
  SELECT *, SUM(tp) OVER w AS ctp, SUM(fp) OVER w AS cfp,
         SUM(tp) OVER (PARTITION BY model) AS pos, SUM(fp) OVER (PARTITION BY model) AS neg
  FROM {name}_g WINDOW w AS (PARTITION BY model ORDER BY p DESC)),
{name} AS (
  SELECT model, MAX(pos) AS positives, MAX(neg) AS negatives,
         SUM(fp * (ctp - tp * 0.5::DOUBLE)) / (MAX(pos)::DOUBLE * MAX(neg)) AS roc_auc,
         SUM((fp::DOUBLE / neg) * ((ctp * 2 - tp)::DOUBLE / pos) * 0.5::DOUBLE) AS curve_area,
         SUM(tp * (ctp::DOUBLE / (ctp + cfp))) / MAX(pos) AS average_precision
  FROM {name}_c GROUP BY model)"""


def at_thresholds(values: str, source: str = "long_scores", name: str = "at_t") -> str:
    """``values`` is a relation with columns (model, threshold)."""
    return f"""{name}_n AS (
  SELECT s.model, t.threshold,
         SUM(CASE WHEN churn = 1 AND p >= t.threshold THEN 1 ELSE 0 END)::DOUBLE AS tp,
         SUM(CASE WHEN churn = 0 AND p >= t.threshold THEN 1 ELSE 0 END)::DOUBLE AS fp,
         SUM(CASE WHEN churn = 1 AND p < t.threshold THEN 1 ELSE 0 END)::DOUBLE AS fn,
         SUM(CASE WHEN churn = 0 AND p < t.threshold THEN 1 ELSE 0 END)::DOUBLE AS tn
  FROM {source} s JOIN {values} t ON s.model = t.model GROUP BY s.model, t.threshold),
{name} AS (
  SELECT model, threshold, tp, fp, fn, tn,
         (tp + tn) / (tp + fp + fn + tn) AS accuracy,
         COALESCE(tp / NULLIF(tp + fp, 0), 0) AS "precision",
         COALESCE(tp / NULLIF(tp + fn, 0), 0) AS recall,
         COALESCE(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0) AS f1 FROM {name}_n)"""


GRID = "grid AS (SELECT i, CASE WHEN i = 180 THEN 0.95::DOUBLE ELSE i * ((0.95::DOUBLE - 0.05::DOUBLE) / 180) + 0.05::DOUBLE END AS threshold FROM (SELECT UNNEST(range(0, 181)) AS i))"


def sweep(source: str = "long_scores") -> str:
    models = f"grid_models AS (SELECT m.model, g.i, g.threshold FROM (SELECT DISTINCT model FROM {source}) m, grid g)"
    return f"{GRID}, {models}, {at_thresholds('grid_models', source, 'sweep')}"


def ranked(source: str = "scored", name: str = "ranked") -> str:
    return f"""{name} AS (SELECT *, ROW_NUMBER() OVER (ORDER BY p DESC, {ID}) AS risk_rank, COUNT(*) OVER () AS n_all,
  SUM(churn) OVER () AS n_churn FROM {source})"""


TOP20 = """top20 AS (
  SELECT 20 AS share_pct, COUNT(*) FILTER (risk_rank <= n_all * 20 // 100) AS targeted,
         SUM(churn) FILTER (risk_rank <= n_all * 20 // 100) AS reached, SUM(churn) AS churners,
         AVG(churn) AS overall_rate, AVG(rev_Mean) FILTER (risk_rank <= n_all * 20 // 100) AS mean_revenue
  FROM ranked),
summary AS (
  SELECT share_pct, targeted, reached, reached::DOUBLE / churners AS churn_capture,
         reached::DOUBLE / targeted AS target_churn_rate, overall_rate,
         reached::DOUBLE / targeted / overall_rate AS lift, mean_revenue FROM top20)"""


def r6(expr: str, name: str | None = None) -> str:
    return f"ROUND({expr}, 6) + 0.0::DOUBLE AS {name or expr}"


def r6s(names) -> str:
    return ", ".join(r6(n) for n in names)


SUB = subscriber()
ENG = f"{SUB}, {engineered()}"
SCORED = f"{ENG}, {scored()}"
FINAL = f"{SCORED}, {one_model()}"
SPLIT = f"{SUB}, {parts('subscriber')}"
SCORED_SPLIT = f"{SCORED}, {parts('scored')}"
MEMBERS = "('hist'), ('cat_d6'), ('cat_d7'), ('cat_d8'), ('engineered')"
METRIC_COLUMNS = ("roc_auc", "pr_auc", "accuracy", '"precision"', "recall", "f1")
IMPORTANCE = f"""{ENG}, gains AS ({' UNION ALL '.join(
    f"SELECT 'numeric__{t.feature}' AS feature, AVG(ABS({term_sql(t)})) AS gain FROM engineered" for t in ENGINEERED)})"""


def unpivoted(source: str, columns, keep: str, cast: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT {keep}, '{c}' AS feature, {c}{cast} AS value FROM {source}" for c in columns)


def oracle_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    every = (*NUMERIC, *CATEGORIES, ID, TARGET)
    wide = f"{ID}, {TARGET}, {r6s(NUMERIC)}, {', '.join(CATEGORIES)}"

    # sources and quality
    q["csv_scan_nulls"] = f"WITH {SUB} SELECT {ID}, crclscod, area, prizm_social_one FROM client"
    q["join_one_to_one"] = f"WITH {SUB} SELECT {wide} FROM subscriber"
    q["csv_two_files"] = q["store_join"] = q["join_one_to_one"]
    q["dq_report"] = f"""WITH {SUB},
      cl AS (SELECT {ID} AS k, COUNT(*) AS n FROM client GROUP BY 1),
      re AS (SELECT {ID} AS k, COUNT(*) AS n FROM record GROUP BY 1)
      SELECT 'client' AS table_name, 'id_present' AS rule, 0::BIGINT AS violations
      UNION ALL SELECT 'record', 'id_present', 0 UNION ALL SELECT 'joined', 'target_present', 0
      UNION ALL SELECT 'client', 'id_not_null', COALESCE(SUM(n) FILTER (k IS NULL), 0)::BIGINT FROM cl
      UNION ALL SELECT 'record', 'id_not_null', COALESCE(SUM(n) FILTER (k IS NULL), 0)::BIGINT FROM re
      UNION ALL SELECT 'client', 'id_unique', COALESCE(SUM(n - 1) FILTER (k IS NOT NULL), 0)::BIGINT FROM cl
      UNION ALL SELECT 'record', 'id_unique', COALESCE(SUM(n - 1) FILTER (k IS NOT NULL), 0)::BIGINT FROM re
      UNION ALL SELECT 'joined', 'same_ids', (SELECT COUNT(*) FROM cl FULL JOIN re ON cl.k = re.k
                                              WHERE cl.k IS NULL OR re.k IS NULL)::BIGINT
      UNION ALL SELECT 'joined', 'target_not_null', COUNT(*) FILTER (churn IS NULL) FROM record
      UNION ALL SELECT 'joined', 'target_is_0_or_1', COUNT(*) FILTER (churn NOT IN (0, 1)) FROM record"""
    q["duplicate_keys"] = """SELECT * FROM (
      SELECT 'orders' AS table_name, o_custkey AS key, COUNT(*) AS copies FROM orders GROUP BY 2 HAVING COUNT(*) > 1
      UNION ALL SELECT 'customer', c_custkey, COUNT(*) FROM customer GROUP BY 2 HAVING COUNT(*) > 1)"""
    q["key_coverage"] = f"""WITH {SUB}, both_sides AS (
        SELECT c.{ID} AS a, r.{ID} AS b FROM client c FULL JOIN record r ON c.{ID} = r.{ID})
      SELECT 'left_only' AS side, COUNT(*) FILTER (b IS NULL) AS ids FROM both_sides
      UNION ALL SELECT 'right_only', COUNT(*) FILTER (a IS NULL) FROM both_sides
      UNION ALL SELECT 'both', COUNT(*) FILTER (a IS NOT NULL AND b IS NOT NULL) FROM both_sides"""
    q["key_coverage_offenders"] = f"""WITH {SUB}
      SELECT {ID}, 'right' AS missing_from FROM client WHERE {ID} NOT IN (SELECT {ID} FROM record)
      UNION ALL SELECT {ID}, 'left' FROM record WHERE {ID} NOT IN (SELECT {ID} FROM client)"""

    # profile
    q["table_profile"] = f"""WITH {SUB} SELECT COUNT(*) AS n_rows, {len(every)} AS n_columns,
      {len(NUMERIC) + 2} AS n_numeric, {len(CATEGORIES)} AS n_text FROM subscriber"""
    nulls = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, COUNT(*) FILTER ({c} IS NULL) AS missing, "
        f"ROUND(COUNT(*) FILTER ({c} IS NULL) * 100.0::DOUBLE / COUNT(*), 6) AS missing_pct FROM subscriber" for c in every)
    q["missing_counts"] = f"WITH {SUB} SELECT column_name, missing FROM ({nulls}) ORDER BY missing DESC, column_name LIMIT 20"
    q["missing_pct"] = f"WITH {SUB} SELECT column_name, missing_pct FROM ({nulls}) ORDER BY missing DESC, column_name LIMIT 12"
    q["target_balance"] = f"""WITH {SUB} SELECT churn, COUNT(*) AS customers,
      ROUND(COUNT(*)::DOUBLE / (SELECT COUNT(*) FROM subscriber), 6) AS proportion,
      ROUND((SELECT AVG(churn) FROM subscriber), 6) AS overall_rate FROM subscriber GROUP BY churn"""
    compared = ("eqpdays", "months", "rev_Mean", "mou_Mean", "change_mou", "totmrc_Mean")
    q["class_mean_compare"] = f"""WITH {SUB} SELECT churn,
      {', '.join(r6(f'AVG({c})', f'mean_{c}') for c in compared)} FROM subscriber GROUP BY churn"""
    cuts = ", ".join(f"quantile_cont({c}, {p}) AS {c}_{i}" for c in ("eqpdays", "change_mou", "mou_Mean")
                     for i, p in ((1, 0.25), (2, 0.5), (3, 0.75)))
    bins = " UNION ALL ".join(
        f"SELECT churn, '{c}' AS feature, CASE WHEN {c} <= {c}_1 THEN 'Q1' WHEN {c} <= {c}_2 THEN 'Q2' "
        f"WHEN {c} <= {c}_3 THEN 'Q3' ELSE 'Q4' END AS quartile FROM subscriber, cuts WHERE {c} IS NOT NULL"
        for c in ("eqpdays", "change_mou", "mou_Mean"))
    q["qcut_churn_rate"] = f"""WITH {SUB}, cuts AS (SELECT {cuts} FROM subscriber)
      SELECT feature, quartile, COUNT(*) AS customers, ROUND(AVG(churn) * 100.0::DOUBLE, 6) AS churn_rate_pct
      FROM ({bins}) GROUP BY feature, quartile"""
    q["class_histogram"] = f"""WITH {SUB},
      spans AS (SELECT churn, MIN(eqpdays) AS lo, MAX(eqpdays) AS hi FROM subscriber GROUP BY churn),
      slots AS (SELECT s.churn, LEAST(FLOOR((eqpdays - lo) / (hi - lo) * 30.0::DOUBLE) + 1, 30)::INTEGER AS bin
                FROM subscriber s JOIN spans USING (churn)),
      grid AS (SELECT churn, lo, hi, UNNEST(range(1, 31))::INTEGER AS bin FROM spans)
      SELECT g.churn, g.bin, {r6('g.lo + (g.bin - 1) * ((g.hi - g.lo) / 30.0::DOUBLE)', 'lower')},
             {r6('g.lo + g.bin * ((g.hi - g.lo) / 30.0::DOUBLE)', 'upper')}, COUNT(s.bin) AS customers
      FROM grid g LEFT JOIN slots s ON g.churn = s.churn AND g.bin = s.bin GROUP BY g.churn, g.bin, g.lo, g.hi"""
    sample = f"""pair_sample AS (
      SELECT {ID}, months, LN(1.0::DOUBLE + rev_Mean) AS log_rev_Mean, LN(1.0::DOUBLE + mou_Mean) AS log_mou_Mean,
             LN(1.0::DOUBLE + totmrc_Mean) AS log_totmrc_Mean, LN(1.0::DOUBLE + eqpdays) AS log_eqpdays,
             CASE churn WHEN 0 THEN 'stayed' WHEN 1 THEN 'churned' END AS churn_label
      FROM subscriber WHERE months IS NOT NULL AND rev_Mean IS NOT NULL AND mou_Mean IS NOT NULL
        AND totmrc_Mean IS NOT NULL AND eqpdays IS NOT NULL AND churn IS NOT NULL
      ORDER BY md5(concat(CAST({ID} AS VARCHAR), '|42')), {ID} LIMIT 5000)"""
    pair_columns = ("months", "log_rev_Mean", "log_mou_Mean", "log_totmrc_Mean", "log_eqpdays")
    q["pair_sample"] = f"WITH {SUB}, {sample} SELECT {ID}, {r6s(pair_columns)}, churn_label FROM pair_sample"
    q["class_density"] = f"""WITH {SUB}, {sample},
      cells AS ({unpivoted('pair_sample', pair_columns, 'churn_label')}),
      stats AS (SELECT churn_label, feature, COUNT(*) AS n, MIN(value) AS lo, MAX(value) AS hi,
                STDDEV_SAMP(value) * POW(COUNT(*)::DOUBLE, -0.2::DOUBLE) AS bw FROM cells GROUP BY 1, 2),
      grid AS (SELECT *, UNNEST(range(0, 200))::INTEGER AS point, (SELECT COUNT(*) FROM pair_sample) AS total FROM stats),
      spots AS (SELECT *, (lo - bw * 3) + ((hi + bw * 3) - (lo - bw * 3)) * point / 199.0::DOUBLE AS x FROM grid)
      SELECT s.feature, s.churn_label, s.point, {r6('ANY_VALUE(s.x)', 'x')},
             {r6('SUM(EXP(POW((s.x - c.value) / s.bw, 2) * -0.5::DOUBLE)) / (ANY_VALUE(s.bw) * 2.5066282746310002::DOUBLE * ANY_VALUE(s.total))', 'density')}
      FROM spots s JOIN cells c ON s.feature = c.feature AND s.churn_label = c.churn_label
      GROUP BY s.feature, s.churn_label, s.point"""
    dense = ("eqpdays", "months", "rev_Mean", "mou_Mean")
    q["binned_density"] = f"""WITH {SUB},
      cells AS MATERIALIZED (SELECT * FROM ({unpivoted('subscriber', dense, 'churn', '::DOUBLE')}) WHERE value IS NOT NULL AND churn IS NOT NULL),
      stats AS (SELECT churn, feature, COUNT(*) AS n, MIN(value) AS lo, MAX(value) AS hi,
                STDDEV_SAMP(value) * POW(COUNT(*)::DOUBLE, -0.2::DOUBLE) AS bw FROM cells GROUP BY 1, 2),
      shape AS MATERIALIZED (SELECT churn, feature, bw, lo - bw * 3 AS start, hi + bw * 3 AS stop, SUM(n) OVER (PARTITION BY feature) AS total FROM stats),
      placed AS (SELECT c.churn, c.feature, (value - start) / ((stop - start) / 1023.0::DOUBLE) AS place
                 FROM cells c JOIN shape s ON c.churn = s.churn AND c.feature = s.feature),
      nodes AS (SELECT churn, feature, node, SUM(w) AS w FROM (
          SELECT churn, feature, FLOOR(place) AS node, 1 - (place - FLOOR(place)) AS w FROM placed
          UNION ALL SELECT churn, feature, FLOOR(place) + 1, place - FLOOR(place) FROM placed) GROUP BY 1, 2, 3),
      spots AS (SELECT churn, feature, bw, start, stop, total, point, start + (stop - start) * point / 199.0::DOUBLE AS x
                FROM (SELECT *, UNNEST(range(0, 200))::INTEGER AS point FROM shape))
      SELECT s.feature, s.churn, s.point, {r6('ANY_VALUE(s.x)', 'x')},
             {r6('SUM(n.w * EXP(POW((s.x - (s.start + n.node * ((s.stop - s.start) / 1023.0::DOUBLE))) / s.bw, 2) * -0.5::DOUBLE)) / (ANY_VALUE(s.bw) * 2.5066282746310002::DOUBLE * ANY_VALUE(s.total))', 'density')}
      FROM spots s JOIN nodes n ON s.feature = n.feature AND s.churn = n.churn GROUP BY s.feature, s.churn, s.point"""
    places = ", ".join(f"('{c}', {i})" for i, c in enumerate(NUMERIC))
    q["correlated_pairs"] = f"""WITH {SUB},
      cells AS MATERIALIZED (SELECT {ID}, feature, value, i FROM ({unpivoted('subscriber', NUMERIC, ID, '::DOUBLE')})
                             JOIN (VALUES {places}) AS o(name, i) ON feature = name WHERE value IS NOT NULL),
      pairs AS (SELECT least(a.feature, b.feature) AS u, greatest(a.feature, b.feature) AS v, COUNT(*) AS customers, CORR(a.value, b.value) AS c
                FROM cells a JOIN cells b ON a.{ID} = b.{ID} AND a.i < b.i GROUP BY 1, 2)
      SELECT u AS feature_a, v AS feature_b, customers, {r6('c', 'correlation')} FROM pairs WHERE NOT isnan(c) AND ABS(c) >= 0.95::DOUBLE"""
    q["segment_cube"] = f"""WITH {SPLIT} SELECT prizm_social_one, part, GROUPING(prizm_social_one)::INTEGER AS prizm_social_one_total,
      GROUPING(part)::INTEGER AS part_total, COUNT(*) AS customers, SUM(churn)::BIGINT AS churners, ROUND(AVG(churn), 6) AS churn_rate
      FROM parts GROUP BY CUBE (prizm_social_one, part)"""
    q["split_summary"] = f"""WITH {SPLIT} SELECT part, COUNT(*) AS customers, ROUND(AVG(churn), 6) AS churn_rate
      FROM parts GROUP BY part"""
    related = ("rev_Mean", "totmrc_Mean", "avgrev", "totrev", "mou_Mean", "avgmou", "totmou", "eqpdays")
    q["feature_correlation"] = f"WITH {SUB} " + " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, ROUND(CORR({a}, {b}), 6) AS correlation FROM subscriber"
        for i, a in enumerate(related) for b in related[i + 1:])
    q["segment_churn_rate"] = f"""WITH {SUB} SELECT feature AS segment, value AS level, COUNT(*) AS customers,
      SUM(churn)::BIGINT AS churners, ROUND(AVG(churn), 6) AS churn_rate
      FROM ({unpivoted('subscriber', CATEGORIES, 'churn')}) GROUP BY 1, 2"""
    fenced = ("rev_Mean", "mou_Mean", "eqpdays", "months", "hnd_price", "change_mou", "totrev")
    q["outlier_counts"] = f"WITH {SUB}, " + ", ".join(
        f"f_{c} AS (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM subscriber)" for c in fenced
    ) + " " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, ROUND(a - 1.5::DOUBLE * (b - a), 2) AS low_fence, "
        f"ROUND(b + 1.5::DOUBLE * (b - a), 2) AS high_fence, "
        f"(SELECT COUNT(*) FROM subscriber WHERE {c} < a - 1.5::DOUBLE * (b - a)) AS below, "
        f"(SELECT COUNT(*) FROM subscriber WHERE {c} > b + 1.5::DOUBLE * (b - a)) AS above FROM f_{c}" for c in fenced)

    # splitting
    q["stratified_split"] = f"WITH {SPLIT} SELECT {ID}, churn, part FROM parts"
    q["stratified_split_7030"] = f"""WITH {SUB}, {parts('subscriber', cuts=(('train', 70),))}
      SELECT {ID}, churn, part FROM parts"""
    q["hash_split"] = f"""WITH {SUB}, h AS (SELECT {ID}, churn,
        CAST(concat('0x', substr(md5(concat(CAST({ID} AS VARCHAR), '|42')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
        FROM subscriber)
      SELECT {ID}, churn, CASE WHEN u < 0.6::DOUBLE THEN 'train' WHEN u < 0.8::DOUBLE THEN 'validation' ELSE 'test' END AS part
      FROM h"""

    # features
    derived = [f.name for f in DERIVED_FEATURES]
    q["engineered_features"] = f"WITH {ENG} SELECT {ID}, {r6s(derived)} FROM engineered"
    q["feature_ratio_stats"] = f"WITH {ENG} " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, COUNT({c}) AS known, COUNT(*) - COUNT({c}) AS missing, {r6(f'AVG({c})', 'mean')} "
        "FROM engineered" for c in derived)

    # preparation
    filled = ("change_mou", "custcare_Mean", "cc_mou_Mean", "hnd_price", "rev_Mean", "mou_Mean")
    medians = "med AS (SELECT " + ", ".join(
        f"quantile_cont({c}, 0.5) AS {c}_m" for c in filled) + " FROM parts WHERE part = 'train')"
    q["median_impute"] = f"""WITH {SPLIT}, {medians} SELECT {ID}, part,
      {', '.join(r6(f'COALESCE({c}, {c}_m)', c) for c in filled)} FROM parts, med"""
    groups = [(c, "numeric") for c in NUMERIC] + [(c, "categorical") for c in CATEGORIES]
    q["missing_indicators"] = f"WITH {SPLIT}, " + "cells AS (" + " UNION ALL ".join(
        f"SELECT part, '{g}__missingindicator_{c}' AS indicator, ({c} IS NULL)::INTEGER AS flag FROM parts"
        for c, g in groups) + """)
      SELECT part, indicator, COUNT(*) AS customers, SUM(flag)::BIGINT AS flagged FROM cells WHERE indicator IN (
        SELECT indicator FROM cells WHERE part = 'train' GROUP BY indicator HAVING SUM(flag) > 0)
      GROUP BY part, indicator"""
    cat_cells = f"cells AS ({unpivoted('parts', CATEGORIES, f'{ID}, part')})"
    modes = """modes AS (SELECT feature, value AS mode_value FROM (
      SELECT feature, value, ROW_NUMBER() OVER (PARTITION BY feature ORDER BY COUNT(*) DESC, value) AS rn
      FROM cells WHERE part = 'train' AND value IS NOT NULL GROUP BY feature, value) WHERE rn = 1)"""
    q["mode_impute"] = f"""WITH {SPLIT}, {cat_cells}, {modes} SELECT {ID}, part, """ + ", ".join(
        f"COALESCE({c}, (SELECT mode_value FROM modes WHERE feature = '{c}')) AS {c}" for c in CATEGORIES) + " FROM parts"
    q["categorical_fill"] = f"WITH {SUB} SELECT {ID}, " + ", ".join(
        f"COALESCE({c}, '__MISSING__') AS {c}" for c in CATEGORIES) + " FROM subscriber"
    codes = ", ".join(
        f"code_{c} AS (SELECT v, (ROW_NUMBER() OVER (ORDER BY v) - 1)::INTEGER AS code FROM "
        f"(SELECT DISTINCT COALESCE({c}, '__MISSING__') AS v FROM parts WHERE part = 'train'))" for c in CATEGORIES)
    joins = " ".join(f"LEFT JOIN code_{c} ON code_{c}.v = COALESCE(parts.{c}, '__MISSING__')" for c in CATEGORIES)
    q["ordinal_encode"] = f"WITH {SPLIT}, {codes} SELECT {ID}, part, " + ", ".join(
        f"COALESCE(code_{c}.code, -1)::INTEGER AS {c}_code" for c in CATEGORIES) + f" FROM parts {joins}"
    labels = ", ".join(
        f"code_{c} AS (SELECT v, (ROW_NUMBER() OVER (ORDER BY v) - 1)::INTEGER AS code FROM "
        f"(SELECT DISTINCT COALESCE({c}, 'nan') AS v FROM subscriber))" for c in CATEGORIES)
    label_joins = " ".join(f"JOIN code_{c} ON code_{c}.v = COALESCE(s.{c}, 'nan')" for c in CATEGORIES)
    q["label_encode"] = f"WITH {SUB}, {labels} SELECT {ID}, " + ", ".join(
        f"code_{c}.code AS {c}_code" for c in CATEGORIES) + f" FROM subscriber s {label_joins}"
    q["onehot_counts"] = f"""WITH {SPLIT}, {cat_cells}, {modes},
      full_cells AS (SELECT part, c.feature, COALESCE(value, mode_value) AS value FROM cells c JOIN modes m ON c.feature = m.feature),
      slots AS (SELECT feature, value, CASE WHEN COUNT(*) < 10 THEN '__INFREQUENT__' ELSE value END AS slot
                FROM full_cells WHERE part = 'train' GROUP BY feature, value)
      SELECT part, f.feature, slot, COUNT(*) AS customers
      FROM full_cells f JOIN slots s ON f.feature = s.feature AND f.value = s.value GROUP BY 1, 2, 3"""
    q["standardize"] = f"""WITH {SPLIT}, {medians},
      whole AS (SELECT {ID}, part, {', '.join(f'COALESCE({c}, {c}_m) AS {c}' for c in filled)} FROM parts, med),
      fit AS (SELECT {', '.join(f'AVG({c}) AS {c}_a, STDDEV_POP({c}) AS {c}_s' for c in filled)} FROM whole WHERE part = 'train')
      SELECT {ID}, part, {', '.join(r6(f'({c} - {c}_a) / {c}_s', c) for c in filled)} FROM whole, fit"""
    q["ordered_target_encode"] = f"""WITH {SPLIT},
      prior AS (SELECT AVG(churn) AS r FROM parts WHERE part = 'train'),
      cells AS ({' UNION ALL '.join(f"SELECT {ID}, part, churn, '{c}' AS feature, COALESCE({c}, '__MISSING__') AS value FROM parts" for c in CATEGORIES)}),
      own AS (SELECT {ID}, part, feature, value, SUM(churn) OVER w AS s, COUNT(*) OVER w AS n FROM cells WHERE part = 'train'
              WINDOW w AS (PARTITION BY feature, value ORDER BY md5(concat(CAST({ID} AS VARCHAR), '|ordered')), {ID}
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      total AS (SELECT feature, value, SUM(churn) AS s, COUNT(*) AS n FROM cells WHERE part = 'train' GROUP BY 1, 2),
      other AS (SELECT {ID}, part, c.feature, c.value, s, n FROM cells c LEFT JOIN total t
                ON c.feature = t.feature AND c.value = t.value WHERE part <> 'train')
      SELECT {ID}, part, feature, value, {r6('(COALESCE(s, 0) + r) / (COALESCE(n, 0) + 1.0::DOUBLE)', 'encoded')}
      FROM (SELECT * FROM own UNION ALL SELECT * FROM other), prior"""

    # scores and blends
    q["blend_probabilities"] = f"""WITH {SCORED} SELECT {ID}, ROUND(p_ensemble, 6) AS p_ensemble,
      ROUND(ROUND(0.1::DOUBLE / total * p_cat_d6 + 0.2::DOUBLE / total * p_cat_d7 + 0.4::DOUBLE / total * p_cat_d8, 9), 6)
      AS p_trees FROM scored, (SELECT 0.1::DOUBLE + 0.2::DOUBLE + 0.4::DOUBLE AS total)"""
    q["blend_nested"] = f"WITH {SCORED} SELECT {ID}, ROUND(p, 6) AS p_final, ROUND(1.0::DOUBLE - p, 6) AS p_stay FROM scored"
    q["predict_at_threshold"] = f"""WITH {SCORED} SELECT {ID}, churn, (p >= 0.5::DOUBLE)::INTEGER AS at_050,
      (p >= 0.36::DOUBLE)::INTEGER AS at_036 FROM scored"""

    # metrics
    q["roc_auc"] = f"""WITH {SCORED}, {long_models('scored')}, {ranking()} SELECT model, positives::BIGINT AS positives,
      negatives::BIGINT AS negatives, ROUND(roc_auc, 6) AS roc_auc, ROUND(curve_area, 6) AS curve_area FROM ranking"""
    q["average_precision"] = f"""WITH {SCORED}, {long_models('scored')}, {ranking()}
      SELECT model, ROUND(average_precision, 6) AS average_precision FROM ranking"""
    half = f"half AS (SELECT DISTINCT model, 0.5::DOUBLE AS threshold FROM long_scores), {at_thresholds('half')}"
    six = "SELECT t.model, t.threshold, roc_auc, average_precision AS pr_auc, accuracy, \"precision\", recall, f1 FROM at_t t JOIN ranking r ON t.model = r.model"
    q["classification_metrics"] = f"""WITH {FINAL}, {ranking()}, {half}, six AS ({six})
      SELECT model, threshold, {r6s(METRIC_COLUMNS)} FROM six"""
    q["confusion_matrix"] = f"""WITH {FINAL}, {half}
      SELECT model, 0 AS actual, 0 AS predicted, tn::BIGINT AS customers FROM at_t
      UNION ALL SELECT model, 0, 1, fp::BIGINT FROM at_t UNION ALL SELECT model, 1, 0, fn::BIGINT FROM at_t
      UNION ALL SELECT model, 1, 1, tp::BIGINT FROM at_t"""
    q["roc_curve"] = f"""WITH {FINAL}, {ranking()}
      SELECT model, p AS threshold, ROUND(cfp::DOUBLE / neg, 6) AS fpr, ROUND(ctp::DOUBLE / pos, 6) AS tpr FROM ranking_c
      UNION ALL SELECT 'final', NULL, 0.0, 0.0"""
    best = "ROW_NUMBER() OVER (PARTITION BY model ORDER BY {} , threshold)"
    q["f1_threshold"] = f"""WITH {SCORED}, {long_models('scored')}, {sweep()},
      best AS (SELECT *, {best.format('f1 DESC')} AS rn FROM sweep)
      SELECT model, ROUND(threshold, 6) AS threshold, ROUND(f1, 6) AS f1, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn
      FROM best WHERE rn = 1"""
    q["f1_sweep"] = f"""WITH {FINAL}, {sweep()} SELECT model, ROUND(threshold, 6) AS threshold, tp::BIGINT AS tp,
      fp::BIGINT AS fp, fn::BIGINT AS fn, ROUND(f1, 6) AS f1 FROM sweep"""
    q["cost_threshold"] = f"""WITH {SCORED}, {long_models('scored')}, {sweep()},
      costs AS (SELECT *, fp * 15.0::DOUBLE + fn * 60.0::DOUBLE AS cost FROM sweep),
      best AS (SELECT *, {best.format('cost')} AS rn FROM costs)
      SELECT model, ROUND(threshold, 6) AS threshold, cost, fp::BIGINT AS fp, fn::BIGINT AS fn FROM best WHERE rn = 1"""
    valid = one_model("parts", "valid_scores", "part = 'validation'")
    test = one_model("parts", "long_scores", "part = 'test'")
    chosen = f"chosen AS (SELECT model, threshold FROM (SELECT *, {best.format('f1 DESC')} AS rn FROM sweep) WHERE rn = 1)"
    two = f"""{valid}, {test}, {sweep('valid_scores')}, {chosen},
      points AS (SELECT 'final' AS model, 0.5::DOUBLE AS threshold UNION ALL SELECT * FROM chosen), {at_thresholds('points')}, {ranking()}"""
    q["metrics_two_thresholds"] = f"""WITH {SCORED_SPLIT}, {two}, six AS ({six})
      SELECT model, ROUND(threshold, 6) AS threshold, {r6s(METRIC_COLUMNS)} FROM six"""
    valid_long = long_models("valid_rows", members=("hist", "cat_d6", "cat_d7", "cat_d8", "engineered", "ensemble", "final"))
    compare = f"valid_rows AS (SELECT *, p AS p_final FROM parts WHERE part = 'validation'), {valid_long}, {ranking()}, {half}, six AS ({six})"
    q["model_comparison"] = f"""WITH {SCORED_SPLIT}, {compare}
      SELECT model, {r6s(METRIC_COLUMNS)}, (ROW_NUMBER() OVER (ORDER BY roc_auc DESC, model))::INTEGER AS place FROM six"""
    q["run_metadata"] = f"""WITH {SCORED_SPLIT}, {two}, six AS ({six}),
      sel AS (SELECT * FROM six WHERE threshold <> 0.5::DOUBLE), def AS (SELECT * FROM six WHERE threshold = 0.5::DOUBLE)
      SELECT 'churn' AS target, 'final' AS selected_model, 'validation ROC-AUC' AS selection_metric,
        (SELECT ROUND(threshold, 6) FROM chosen) AS decision_threshold,
        (SELECT COUNT(*) FROM parts WHERE part = 'train') AS rows_train,
        (SELECT COUNT(*) FROM parts WHERE part = 'validation') AS rows_validation,
        (SELECT COUNT(*) FROM parts WHERE part = 'test') AS rows_test,
        {len(NUMERIC) + len(CATEGORIES)}::BIGINT AS feature_count, {len(NUMERIC)}::BIGINT AS numeric_feature_count,
        {len(CATEGORIES)}::BIGINT AS categorical_feature_count,
        (SELECT ROUND(AVG(churn), 6) FROM parts) AS target_rate,
        (SELECT ROUND(roc_auc, 6) FROM def) AS default_roc_auc, (SELECT ROUND(f1, 6) FROM def) AS default_f1,
        (SELECT ROUND(recall, 6) FROM sel) AS selected_recall, (SELECT ROUND(f1, 6) FROM sel) AS selected_f1"""

    # importance
    friendly = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FRIENDLY.items())
    plain = {"call_completion_rate": "Call Completion Rate", "change_mou": "Change Mou",
             "customer_care_calls_per_100_calls": "Customer Care Calls Per 100 Calls"}
    others = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in plain.items())
    facts = """COUNT(*) AS customers, COUNT(DISTINCT {id}) AS scored_once, SUM(churn)::BIGINT AS churners,
      COUNT(*) AS in_range, COUNT(*) AS reload_equal, true AS tells_apart, true AS learned, true AS inputs_named""".format(id=ID)
    for key, name in (("model_logistic", "logistic_regression"), ("model_forest", "random_forest"), ("model_balanced_forest", "balanced_forest"),
                      ("model_gbt_base", "gradient_boosting"), ("model_cat_d6", "cat_d6"), ("model_cat_d7", "cat_d7"),
                      ("model_cat_d8", "cat_d8"), ("model_gbt_engineered", "gbt_engineered")):
        q[key] = f"WITH {SPLIT} SELECT part, {facts}, '{name}' AS model FROM parts WHERE part <> 'train' GROUP BY part"
    q["model_tutorial"] = f"""WITH {SUB}, {parts('subscriber', cuts=(('train', 70),))}
      SELECT part, {facts}, 'tutorial' AS model FROM parts WHERE part <> 'train' GROUP BY part"""
    q["ensemble_scored_customers"] = f"""WITH {SPLIT} SELECT {ID}, churn, true AS in_range, true AS blend_equal,
      true AS classes_sum, true AS predicts_at_threshold FROM parts WHERE part = 'test'"""
    q["importance_top"] = f"WITH {IMPORTANCE} SELECT feature, ROUND(gain, 6) AS gain FROM gains ORDER BY gain DESC, feature LIMIT 15"
    q["importance_share"] = f"""WITH {IMPORTANCE}, t AS (SELECT * FROM gains ORDER BY gain DESC, feature LIMIT 12)
      SELECT feature, ROUND(gain, 6) AS gain, ROUND(gain / SUM(gain) OVER () * 100.0::DOUBLE, 6) AS share_pct FROM t"""
    q["importance_labels"] = f"""WITH {IMPORTANCE} SELECT feature, ROUND(gain, 6) AS gain,
      CASE substr(feature, 10) {friendly} {others} END AS label FROM gains"""
    themes = " ".join(f"WHEN substr(feature, 10) IN ({', '.join(repr(f) for f in fs)}) THEN '{t}'" for t, fs in THEMES.items())
    q["importance_by_theme"] = f"""WITH {IMPORTANCE} SELECT CASE {themes} ELSE 'Other' END AS theme,
      COUNT(*) AS features, ROUND(SUM(gain), 6) AS gain FROM gains GROUP BY 1"""
    blend_parts = " UNION ALL ".join(
        f"SELECT 'numeric__{t.feature}' AS feature, AVG(ABS({term_sql(t)})) * ({w}::DOUBLE / 0.7::DOUBLE) AS gain FROM engineered"
        for m, w in (("cat_d6", 0.1), ("cat_d7", 0.2), ("cat_d8", 0.4)) for t in SCORECARDS[m])
    q["importance_blend"] = f"""WITH {ENG} SELECT feature, ROUND(SUM(gain), 6) AS gain FROM ({blend_parts}) GROUP BY feature"""
    features = [t.feature for t in HIST]
    hist_mix = logistic_sql([t._replace(feature=f"(CASE WHEN f.feature = '{t.feature}' THEN d.{t.feature} ELSE s.{t.feature} END)") for t in HIST])
    hist_own = logistic_sql(HIST)
    names = ", ".join(f"('{f}')" for f in features)
    q["permutation_importance"] = f"""WITH {SPLIT},
      smp AS (SELECT *, ROW_NUMBER() OVER (ORDER BY md5(concat(CAST({ID} AS VARCHAR), '|42')), {ID}) AS place FROM (
        SELECT * FROM parts WHERE part = 'validation' ORDER BY md5(concat(CAST({ID} AS VARCHAR), '|42')), {ID} LIMIT 5000)),
      donors AS (SELECT r.r, smp.* EXCLUDE (place), ROW_NUMBER() OVER (PARTITION BY r.r
          ORDER BY md5(concat(CAST({ID} AS VARCHAR), '|42|', CAST(r.r AS VARCHAR))), {ID}) AS place
        FROM smp, (VALUES (1), (2)) r(r)),
      runs AS (SELECT concat(f.feature, '|', CAST(d.r AS VARCHAR)) AS model, s.churn, {hist_mix} AS p
        FROM smp s JOIN donors d ON s.place = d.place, (VALUES {names}) f(feature)),
      long_scores AS (SELECT * FROM runs UNION ALL SELECT '' AS model, churn, {hist_own} AS p FROM smp), {ranking()},
      drops AS (SELECT split_part(model, '|', 1) AS feature, (SELECT roc_auc FROM ranking WHERE model = '') - roc_auc AS d
        FROM ranking WHERE model <> '')
      SELECT feature, {r6('AVG(d)', 'importance_mean')}, {r6('STDDEV_POP(d)', 'importance_std')} FROM drops GROUP BY feature"""

    # targeting
    q["scored_customers"] = f"WITH {SCORED}, {ranked()} SELECT {ID}, churn, ROUND(p, 6) AS p, risk_rank FROM ranked"
    q["top_share"] = f"WITH {SCORED}, {ranked()} SELECT {ID}, risk_rank FROM ranked WHERE risk_rank <= n_all * 20 // 100"
    q["capture_lift_curve"] = f"""WITH {SCORED}, {ranked()}, steps AS (SELECT UNNEST(range(1, 21)) AS i)
      SELECT (i * 5)::INTEGER AS share_pct, COUNT(*) AS targeted, SUM(churn)::BIGINT AS reached,
             ROUND(SUM(churn)::DOUBLE / MAX(n_churn), 6) AS churn_capture, ROUND(AVG(churn), 6) AS target_churn_rate,
             ROUND(AVG(churn) / (MAX(n_churn)::DOUBLE / MAX(n_all)), 6) AS lift
      FROM ranked JOIN steps ON risk_rank <= n_all * i // 20 GROUP BY i"""
    q["top20_summary"] = f"""WITH {SCORED}, {ranked()}, {TOP20} SELECT share_pct, targeted, reached::BIGINT AS reached,
      {r6s(('churn_capture', 'target_churn_rate', 'overall_rate', 'lift', 'mean_revenue'))} FROM summary"""
    q["impact_scenarios"] = f"""WITH {SCORED}, {ranked()}, {TOP20},
      sc(pct, scenario) AS (VALUES (10, '10% save rate'), (20, '20% save rate'), (30, '30% save rate')),
      v AS (SELECT scenario, 100000.0::DOUBLE * overall_rate * churn_capture AS reached_churners, 300000.0::DOUBLE AS campaign_cost,
        100000.0::DOUBLE * overall_rate * churn_capture * (pct / 100.0::DOUBLE) * mean_revenue * 12.0::DOUBLE AS gross_value FROM summary, sc)
      SELECT scenario, ROUND(reached_churners, 3) AS reached_churners, ROUND(gross_value, 3) AS gross_value, campaign_cost,
        ROUND(gross_value - campaign_cost, 3) AS net_value, ROUND((gross_value - campaign_cost) / campaign_cost, 6) AS roi FROM v"""

    # campaign operation
    q["weekly_scores"] = f"""WITH {SCORED} SELECT '2000-01-01' AS snapshot_date, {ID}, ROUND(p, 6) AS p FROM scored
      WHERE months >= 3 AND totcalls > 0"""
    signals = (("handset_upgrade", "eqpdays", 1), ("plan_fit_review", "current_to_3m_usage", -1),
               ("service_recovery", "call_failure_rate", 1), ("priority_outreach", "rev_Mean", 1))
    stats = ", ".join(f"AVG({s}) AS m{i}, STDDEV_POP({s}) AS d{i}" for i, (_, s, _) in enumerate(signals))
    zs = ", ".join(f"COALESCE(ROUND(({s} - m{i}) / d{i} * {g}.0::DOUBLE, 6), 0) AS z{i}" for i, (_, s, g) in enumerate(signals))
    pick = " ".join(f"WHEN z{i} = GREATEST(z0, z1, z2, z3) THEN '{a}'" for i, (a, _, _) in enumerate(signals))
    actions = f"""st AS (SELECT {stats} FROM scored), zz AS (SELECT scored.*, {zs} FROM scored, st),
      actions AS (SELECT *, CASE WHEN p >= 0.6::DOUBLE THEN 'high' WHEN p >= 0.4::DOUBLE THEN 'medium' ELSE 'low' END AS risk_band,
        CASE {pick} END AS action, GREATEST(z0, z1, z2, z3) AS signal_strength FROM zz)"""
    q["retention_actions"] = f"""WITH {SCORED}, {actions} SELECT {ID}, risk_band, action,
      {r6('signal_strength')} FROM actions"""
    arms = f"""arms AS (SELECT *, CASE WHEN ROW_NUMBER() OVER (PARTITION BY segment ORDER BY
        md5(concat(CAST({ID} AS VARCHAR), '|holdout')), {ID}) <= CEIL(COUNT(*) OVER (PARTITION BY segment) * 10 / 100)
        THEN 'control' ELSE 'treatment' END AS arm FROM (SELECT *, concat(risk_band, '/', action) AS segment FROM actions))"""
    q["holdout_assignment"] = f"WITH {SCORED}, {actions}, {arms} SELECT {ID}, segment, arm FROM arms"
    q["uplift_measurement"] = f"""WITH {SCORED}, {actions}, {arms}, sums AS (SELECT segment,
        COUNT(*) FILTER (arm = 'treatment') AS treated, COUNT(*) FILTER (arm = 'control') AS control,
        AVG(1 - churn) FILTER (arm = 'treatment') AS rt, AVG(1 - churn) FILTER (arm = 'control') AS rc,
        AVG(rev_Mean) FILTER (arm = 'treatment') AS revenue FROM arms GROUP BY segment)
      SELECT segment, treated, control, ROUND(rt, 6) AS treated_retention, ROUND(rc, 6) AS control_retention,
        {r6('rt - rc', 'incremental_retention')},
        ROUND(SQRT(rt * (1 - rt) / NULLIF(treated, 0) + rc * (1 - rc) / NULLIF(control, 0)), 6) AS standard_error,
        ROUND((rt - rc) * NULLIF(treated, 0) * revenue * 12.0::DOUBLE - NULLIF(treated, 0) * 15.0::DOUBLE, 3) AS net_value FROM sums"""
    slot = "LEAST(FLOOR(p * 10) + 1, 10)::INTEGER"
    q["calibration_table"] = f"""WITH {SCORED} SELECT {slot} AS bin, COUNT(*) AS customers, ROUND(AVG(p), 6) AS mean_p,
      ROUND(AVG(churn), 6) AS observed_rate FROM scored GROUP BY 1"""
    q["calibration_from_state"] = q["calibration_table"]
    q["calibration_summary"] = f"""WITH {SCORED}, b AS (SELECT {slot} AS bin, COUNT(*) AS n, AVG(p) AS mp, AVG(churn) AS r,
        SUM(POW(p - churn, 2)) AS sq FROM scored GROUP BY 1)
      SELECT SUM(n)::BIGINT AS customers, ROUND(SUM(sq) / SUM(n), 6) AS brier,
        ROUND(SUM(n * ABS(mp - r)) / SUM(n), 6) AS calibration_error FROM b"""
    q["recalibrated_scores"] = f"""WITH {SCORED}, o AS (SELECT {ID}, p, p / (1 - p) * (0.2::DOUBLE / (1 - 0.2::DOUBLE) *
        (1 - 0.5::DOUBLE) / 0.5::DOUBLE) AS odds FROM scored)
      SELECT {ID}, ROUND(p, 6) AS p, ROUND(odds / (1 + odds), 6) AS p_shifted FROM o"""
    drifting = ("eqpdays", "months", "rev_Mean", "mou_Mean", "change_mou", "hnd_price")
    edges = ", ".join(f"quantile_cont({c}, {i / 10}) AS {c}_{i}" for c in drifting for i in range(1, 10))

    def share(source: str, name: str) -> str:
        cells = " UNION ALL ".join(
            f"SELECT '{c}' AS feature, CASE WHEN {c} IS NULL THEN -1 ELSE " + " + ".join(
                f"CASE WHEN {c} > {c}_{i} THEN 1 ELSE 0 END" for i in range(1, 10)) + f" END AS bin FROM {source}, edges"
            for c in drifting)
        return (f"{name} AS (SELECT feature, bin, COUNT(*)::DOUBLE / (SELECT COUNT(*) FROM {source}) AS s "
                f"FROM ({cells}) GROUP BY 1, 2)")

    q["feature_drift_psi"] = f"""WITH {SUB}, {subscriber('1999-07-01', '_old').strip()},
      edges AS (SELECT {edges} FROM subscriber_old), {share('subscriber_old', 'e')}, {share('subscriber', 'a')},
      m AS (SELECT COALESCE(e.feature, a.feature) AS feature, GREATEST(COALESCE(e.s, 0), 0.000001::DOUBLE) AS es,
            GREATEST(COALESCE(a.s, 0), 0.000001::DOUBLE) AS actual FROM e FULL JOIN a ON e.feature = a.feature AND e.bin = a.bin)
      SELECT feature, {r6('SUM((actual - es) * LN(actual / es))', 'psi')} FROM m GROUP BY feature"""
    q["drift_from_state"] = q["feature_drift_psi"]
    seg = " UNION ALL ".join(f"SELECT churn, p, '{c}' AS segment, {c} AS level FROM scored WHERE {c} IS NOT NULL"
                             for c in ("prizm_social_one", "crclscod", "area"))
    q["segment_fairness"] = f"""WITH {SCORED}, seg AS ({seg}),
      k AS (SELECT segment, level, COUNT(*) AS customers, COUNT(*) FILTER (p >= 0.5::DOUBLE) AS flagged,
            COUNT(*) FILTER (churn = 1) AS churners, COUNT(*) FILTER (p >= 0.5::DOUBLE AND churn = 1) AS hits FROM seg GROUP BY 1, 2),
      r AS (SELECT segment, level, customers, flagged::DOUBLE / customers AS selection_rate,
            COALESCE(hits::DOUBLE / NULLIF(churners, 0), 0) AS recall, COALESCE(hits::DOUBLE / NULLIF(flagged, 0), 0) AS "precision" FROM k)
      SELECT segment, level, customers, {r6s(('selection_rate', 'recall', '"precision"'))},
        {r6('MAX(selection_rate) OVER (PARTITION BY segment) - selection_rate', 'selection_gap')},
        {r6('MAX(recall) OVER (PARTITION BY segment) - recall', 'recall_gap')} FROM r"""
    return q
