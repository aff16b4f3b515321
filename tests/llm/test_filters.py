"""URL filters and licence scans."""

import datetime as dt
import math
import re
import struct

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from holdfast.llm import licences, queries, url_filter


def at(day, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=hour)


def test_url_filter_same_as_sql(spark, folder):
    got = queries.op7_url_filter(spark, folder).toPandas().sort_values(["id", "url"], ignore_index=True)
    con = duckdb.connect()
    for name in ("pages", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    want = con.execute(url_filter.FILTER_SQL).df().sort_values(["id", "url"], ignore_index=True)[got.columns]
    assert got.equals(want.astype(got.dtypes)) and 0 < got.blocked.sum() < len(got)


def test_keys(spark):
    urls = ["https://u:p@A.b.Example.com.:80/x/y?z#w", "http://example.com", "ftp://h/p", "/relative", "", None, "http:///x"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", url_filter.keys(F.col("url")).alias("k")).collect()
    assert {r.url: r.k for r in rows} == {
        urls[0]: ["a.b.example.com", "b.example.com", "example.com", "a.b.example.com/x"], urls[1]: ["example.com"],
        urls[2]: ["h", "h/p"], urls[3]: [], "": [], None: [], urls[6]: []}


def test_validity_in_time(spark):
    changes = [("block", "x.com", "add", at(0)), ("block", "x.com", "remove", at(40)), ("block", "x.com", "add", at(41)),
               ("allow", "a.x.com", "add", at(100)), ("block", "y.com", "add", at(5)), ("block", "y.com", "remove", at(5)),
               (None, "z.com", "add", at(0)), ("block", None, "add", at(0)), ("block", "z.com", "add", None)]
    captures = [(1, "http://x.com/", at(-1)), (2, "http://x.com/", at(0)), (3, "http://b.x.com/", at(39)), (4, "http://x.com", at(40)),
                (5, "http://x.com", at(400)), (6, "http://a.x.com/p", at(99)), (7, "http://a.x.com/p", at(101)), (8, "http://y.com", at(6)),
                (9, "http://z.com", at(6)), (10, None, at(6)), (11, "http://x.com", None), (2, "http://x.com/", at(0)), (None, "http://x.com/", at(1))]
    log = spark.createDataFrame(changes, "list string, entry string, action string, at timestamp")
    seen = spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp").withColumn("entry", F.lit("own"))
    rows = url_filter.filter_captures(seen, log).collect()
    assert len(rows) == 12 and {r.id for r in rows if r.blocked} == {None, 2, 3, 5, 6}
    assert url_filter.filter_captures(seen.where("false"), log).count() == 0
    assert url_filter.filter_captures(seen, log.where("false")).where("blocked").count() == 0


def test_intervals_only_where_captures_ask(spark):
    """An entry that stays on a list has as many intervals as hours are asked for, however late they are."""
    log = spark.createDataFrame([("block", f"h{i}.com", "add", at(i)) for i in range(50)], "list string, entry string, action string, at timestamp")
    late = dt.datetime(9998, 5, 1, 12)
    captures = [(i, f"http://h{i}.com/", late) for i in range(50)] + [(50, "http://h1.com/", at(1)), (51, "http://h1.com/", at(0, 23)), (52, "http://no.com", late)]
    seen = spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp")
    asked = seen.select(F.explode(url_filter.keys(F.col("url"))).alias("entry"), url_filter._cell(F.col("fetched_at")).alias("cell")).distinct()
    rows = url_filter.intervals(log, asked).collect()
    assert len(rows) == 51 and sum(r.valid_from is None for r in rows) == 50
    got = {r.id for r in url_filter.filter_captures(seen, log).where("blocked").collect()}
    assert got == set(range(51))


def test_many_changes_in_an_hour_and_zones(spark):
    """Against a plain walk through the log, across a change of clocks, at times of changes and between them."""
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        begin = dt.datetime(2024, 11, 3, 3, 0)
        times = [begin + dt.timedelta(minutes=7 * i) for i in range(60)]
        log = [("block", "x.com", "add" if i % 3 else "remove", t) for i, t in enumerate(times)]
        seen = [(i, "http://x.com/", begin + dt.timedelta(minutes=5 * i - 20)) for i in range(100)]
        changes = spark.createDataFrame(log, "list string, entry string, action string, at timestamp")
        rows = url_filter.filter_captures(spark.createDataFrame(seen, "page_id long, url string, fetched_at timestamp"), changes).collect()
        want = {i for i, _, t in seen if (past := [a for _, _, a, x in log if x <= t]) and past[-1] == "add"}
        assert len(rows) == 100 and {r.id for r in rows if r.blocked} == want and 0 < len(want) < 100
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.fixture(scope="module")
def model(documents):
    return licences.train(documents)


def test_licence_lines_are_found(documents, model):
    notice = re.compile("licensed under|released under the", re.I)
    want = {(r.doc_id, i) for r in documents.collect() for i, x in enumerate((r.text or "").split("\n")) if notice.search(x)}
    got = {(r.doc_id, r.paragraph) for r in licences.scan(documents, model).where("confirmed").collect()}
    assert want and got == want
    whole = {f: "intro words here\n" + "\n".join(s) for f, s in licences.TEMPLATES.items()}
    frame = documents.sparkSession.createDataFrame([(f, t) for f, t in whole.items()], "doc_id string, text string")
    rows = licences.scan(frame, model).where("confirmed").collect()
    assert all(r.doc_id == r.family for r in rows) and len(rows) >= 0.9 * sum(map(len, licences.TEMPLATES.values()))


def test_licence_notice_inside_a_long_line(documents, model):
    """A notice amid 5,000 words of one line is found wherever it stands; without one the line is not."""
    words = " ".join(r.text for r in documents.where("text is not null").orderBy("doc_id").collect())
    words = re.sub("licen[sc]e\\w*|released", "", words, flags=re.I).split()[:5000]
    notices = {f: s[1] for f, s in licences.TEMPLATES.items()}
    rows = [(f"{f} {at}", " ".join([*words[:at], s, *words[at:]])) for f, s in notices.items() for at in (0, 2477, 5000)]
    frame = documents.sparkSession.createDataFrame([*rows, ("none", " ".join(words))], "doc_id string, text string")
    got = {(r.doc_id, r.family) for r in licences.scan(frame, model).where("confirmed").collect()}
    assert len(words) == 5000 and got == {(i, i.split(" ")[0]) for i, _ in rows}


def _plain_best(text, model):
    """The best family of a paragraph by plain Python: hashed words and pairs, logits, softmax, windows."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    step = lambda h, seed: xxhash.xxh64_intdigest(struct.pack("<q", signed(h)), seed)
    hashes = [xxhash.xxh64_intdigest(w, 42) for w in re.sub("[^a-z0-9]+", " ", text.lower()).split()]
    best = (0.0, 0)
    for at in range(0, max(len(hashes) - licences.WINDOW, 0) + licences.STEP, licences.STEP):
        part = hashes[at:at + licences.WINDOW]
        terms = part + [step(b, step(a, 42)) for a, b in zip(part, part[1:])]
        buckets = {t % licences.BUCKETS for t in terms}
        z = [c + sum(x for x, b in zip(w, model.buckets) if b in buckets) for w, c in zip(model.weights, model.intercepts)]
        e = [math.exp(x - max(z)) for x in z]
        family = max(range(1, len(e)), key=lambda i: (e[i], -i))
        best = max(best, (e[family] / sum(e), family), key=lambda x: x[0])
    return best


def test_licence_probabilities_same_as_plain(spark, documents, model):
    """Also shows that no window which the bound leaves out could have had a family."""
    lines = {x for r in documents.where("text is not null").limit(300).collect() for x in r.text.split("\n") if x.isascii()}
    lines |= {x for listed in licences.TEMPLATES.values() for x in listed} | {x.replace("License", "Licence text") for x in sorted(lines)[:20]}
    lines |= {" ".join(sorted(lines)[:40]), "", "MIT", "the GNU General Public License"}
    frame = spark.createDataFrame([(x,) for x in sorted(lines)], "line string").repartition(8)
    got = {r.line: r.v for r in frame.select("line", licences._best(F.col("line"), model).alias("v")).collect()}
    likely = 0
    for line, v in got.items():
        probability, family = _plain_best(line, model)
        if probability >= licences.LEAST_PROBABILITY:
            likely += 1
            assert v.probability == pytest.approx(probability, abs=1e-9) and v.best == family
        else:
            assert v.probability < licences.LEAST_PROBABILITY
    assert likely >= sum(map(len, licences.TEMPLATES.values()))


CONFIRMED = {
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0", "Licensed under CC BY 4.0.": "CC-BY-4.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "CC-BY-4.0",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
    "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "This work is licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0",
    "This work is licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Licensed under the Apache License, Version 1.1.": "Apache-1.1",
    "Licensed under the Mozilla Public License, version 2.0.": "MPL-2.0", "SPDX-License-Identifier: MIT": "MIT", "// SPDX-License-Identifier: MIT": "MIT",
    "The MIT License (MIT)": "MIT", "Released under the MIT License.": "MIT", "Licensed under CC0 1.0 Universal.": "CC0-1.0",
    "SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0", "# SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
}
DENIED = (
    "Not licensed under the Apache License, Version 2.0.", "This work is not licensed under the GNU General Public License, version 3.",
    "This is not released under the MIT License.", "Licensed under the Apache License, Version 9.0.", "Licensed under CC BY-NC 2.0.",
    "This work is licensed under the GNU General Public License, version 1.", "SPDX-License-Identifier: WTFPL",
    "Licensed under the BSD 4-Clause License.", "The driver must hold a licence of version 3.", "released under the moon",
)


def test_versions_variants_and_denials(spark, model):
    rows = [(x, x) for x in [*CONFIRMED, *DENIED]]
    got = {r.doc_id: r.family for r in licences.scan(spark.createDataFrame(rows, "doc_id string, text string"), model).where("confirmed").collect()}
    assert got == CONFIRMED


def test_licence_scan_of_awkward_rows(awkward, empty):
    model = licences.train(awkward)
    assert licences.scan(awkward, model).count() == 0
    assert licences.scan(empty, model).count() == 0
    assert licences.train(empty).families == [licences.UNKNOWN, *licences.TEMPLATES]
