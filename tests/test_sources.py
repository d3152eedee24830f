"""Payload scan, normalisation rules, sinks, order statistics."""

import datetime as dt
import json
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.operators import incremental, normalize, ranking
from tidemark.sources import facts, sinks
from tidemark.streaming.rules_stream import refresh_table


def entry(**kw):
    return {"start": "2024-01-01", "end": "2024-03-31", "val": 1, "accn": "a1", "fy": 2024, "fp": "Q1",
            "form": "10-Q", "filed": "2024-05-01"} | kw


def test_payload_to_facts(spark):
    gaap = {
        "Revenues": {"label": "r", "units": {"USD": [entry(val=10), entry(accn="a2", filed=None)]}},
        "SalesRevenueNet": {"label": "r", "units": {"USD": [entry(val=99), entry(accn="a3", val=7)]}},
        "NetIncomeLoss": {"label": "n", "units": {"USD": [entry(end="2024-04-30"), entry(start=None)]}},
        "Assets": {"label": "a", "units": {"USD": [entry(start=None, val=5)]}},
        "Unknown": {"label": "u", "units": {"USD": [entry()]}},
    }
    folder = tempfile.mkdtemp(prefix="facts-")
    with open(f"{folder}/one.json", "w") as f:
        json.dump({"cik": 1, "entityName": "One", "facts": {"us-gaap": gaap}}, f, indent=1)
    payload = facts.read_company_facts(spark, folder).withColumn("ticker", F.lit("ONE"))
    flat = facts.flatten_facts(payload.drop("cik"))
    assert flat.count() == 8
    tags = registry.concept_tags(spark)
    got = sorted((r.concept, r.accession, r.duration_days, r.value)
                 for r in normalize.normalize(flat, tags).collect())
    # The lower priority number wins a key; a stub of 120 days and missing fields drop out.
    assert got == [("revenue", "a1", 90, 10.0), ("revenue", "a3", 90, 7.0), ("total_assets", "a1", 0, 5.0)]
    reasons = {r.tag: r.reason for r in normalize.quarantine(flat, tags).where("tag <> 'NetIncomeLoss'").collect()}
    assert reasons == {"Revenues": "missing filed", "Unknown": "unknown tag"}
    rows = normalize.normalize(flat, tags)
    assert {r.concept for r in normalize.concept_missing(rows).collect()} >= {"net_income", "operating_income"}


def test_registry_and_predecessors(spark):
    doc = json.dumps({"0": {"cik_str": 5, "ticker": "xom", "title": "X"}, "1": {"cik_str": 6, "ticker": "a", "title": "A"}})
    reg = facts.parse_registry(spark.createDataFrame([(doc,)], "body string"))
    over = spark.createDataFrame([("XOM", [9, 5])], "ticker string, ciks array<bigint>")
    got = sorted((r.ticker, r.cik_order, r.cik) for r in facts.resolve_ciks(reg, over).collect())
    assert got == [("A", 0, 6), ("XOM", 0, 9), ("XOM", 1, 5)]


def rows(spark, data):
    return spark.createDataFrame(data, "ticker string, date date, close double")


def stored(spark, path):
    return sorted((r.ticker, r.date.day, r.close) for r in sinks.read_table(spark, path).collect())


def test_bucketed_sinks(spark):
    root = tempfile.mkdtemp(prefix="sink-")
    path, day = f"{root}/t", lambda d: dt.date(2024, 1, d)
    first = rows(spark, [(t, day(d), float(d)) for t in ("A", "B", "C") for d in (1, 2)])
    sinks.replace_by_key(first, path, f"{root}/s1", buckets=2)
    sinks.replace_by_key(rows(spark, [("A", day(9), 9.0)]), path, f"{root}/s2", buckets=2)
    rest = [(t, d, float(d)) for t in ("B", "C") for d in (1, 2)]
    assert stored(spark, path) == [("A", 9, 9.0), *rest]
    sinks.upsert_by_key(rows(spark, [("B", day(1), 7.0), ("D", day(4), 4.0)]), path, f"{root}/s3",
                        ["ticker", "date"], buckets=2)
    assert stored(spark, path) == [("A", 9, 9.0), ("B", 1, 7.0), ("B", 2, 2.0), *rest[2:], ("D", 4, 4.0)]


def test_replacing_by_nothing_and_fixed_layout(spark):
    root = tempfile.mkdtemp(prefix="sink-")
    path, day = f"{root}/t", dt.date(2024, 1, 1)
    first = rows(spark, [(t, day, 1.0) for t in "ABCDEFGH"])
    sinks.replace_by_key(first, path, f"{root}/s1", buckets=4)
    gone = spark.createDataFrame([("A",), ("C",)], "ticker string")
    sinks.replace_by_key(first.limit(0), path, f"{root}/s2", keys=gone)
    assert [t for t, _, _ in stored(spark, path)] == list("BDEFGH")
    sinks.replace_by_key(first.limit(0), path, f"{root}/s3", keys=first)  # every bucket is left without a row
    assert stored(spark, path) == []
    with pytest.raises(ValueError):
        sinks.upsert_by_key(first, path, f"{root}/s4", ["ticker", "date"], buckets=8)


def test_only_touched_buckets_are_read(spark):
    path = tempfile.mkdtemp(prefix="sink-") + "/t"
    sinks.replace_by_key(rows(spark, [(f"T{i}", dt.date(2024, 1, 1), 1.0) for i in range(60)]), path, path + "-s", buckets=16)
    scan = sinks.read_buckets(spark, path, [3, 5])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in scan and "IN (3,5)" in scan


def test_last_incoming_row_wins(spark):
    day = dt.date(2024, 1, 1)
    old = rows(spark, [("A", day, 1.0), ("B", day, 1.0)])
    new = rows(spark, [("A", day, 5.0), ("A", day, 7.0), ("A", day, 6.0), ("C", day, 2.0)])
    assert sorted((r.ticker, r.close) for r in sinks.upsert(old, new, ["ticker", "date"], ["close"]).collect()) == [
        ("A", 7.0), ("B", 1.0), ("C", 2.0)]


def test_long_keys_stay_apart(spark):
    from tidemark.sources.bridge import ticker_of

    got = [r[0] for r in spark.range(1).select(F.explode(F.array(F.lit(7), F.lit(12345678901), F.lit(12345678902)).cast(
        "array<bigint>")).alias("k")).select(ticker_of("k")).collect()]
    assert got == ["S0000000007", "S12345678901", "S12345678902"]


def test_bad_input_is_reported_and_stops_nothing(spark):
    good = {"Revenues": {"label": "r", "units": {"USD": [entry(), entry(accn="b", end="2024-02-31"), entry(accn="c", filed="soon"),
                                                         entry(accn="d", start="2024-13-01")]}}}
    text = json.dumps({"cik": 1, "entityName": "x", "facts": {"us-gaap": good}})
    docs = spark.createDataFrame([("A", text), ("B", text[:-40]), ("C", None), ("D", "[]")], "ticker string, body string")
    payloads = facts.parse_company_facts(docs)
    flat, tags = facts.flatten_facts(payloads), registry.concept_tags(spark)
    assert [r.accession for r in normalize.normalize(flat, tags).where("ticker = 'A'").collect()] == ["a1"]
    assert sorted((r.accn, r.reason) for r in normalize.quarantine(flat.where("ticker = 'A'"), tags).collect()) == [
        ("b", "bad end date"), ("c", "bad filed date"), ("d", "bad start date")]
    assert {"B", "C"} <= {r.ticker for r in normalize.quarantine_payloads(payloads).collect()} <= {"B", "C", "D"}
    folder = tempfile.mkdtemp(prefix="facts-")
    for name, body in (("a", text), ("b", text[:-40])):
        with open(f"{folder}/{name}.json", "w") as f:
            f.write(body)
    assert sorted(r.bad_payload for r in facts.read_company_facts(spark, folder).collect()) == [False, True]


def test_filing_index_is_merged_over_keys_and_shards(spark):
    def lists(*filings):
        return {k: [f[i] for f in filings] for i, k in enumerate(("form", "accessionNumber", "filingDate", "reportDate"))}

    main = {"cik": "1", "filings": {"recent": lists(("10-K", "1-24", "2024-02-01", "2023-12-31"), ("8-K", "x", "2024-01-01", "")),
                                    "files": [{"name": "shard"}]}}
    shard, other = lists(("10-K", "1-19", "2019-02-01", "2018-12-31")), lists(("10-K", "2-22", "2022-02-01", "2021-12-31"))
    docs = spark.createDataFrame([("A", 1, json.dumps(main)), ("A", 1, json.dumps(shard)), ("A", 2, json.dumps(other)),
                                  ("A", 2, "no json")], "ticker string, cik bigint, body string")
    got = facts.annual_filings(facts.read_filing_index(docs), F.lit(dt.date(2025, 1, 1)), years=10, newest=2)
    assert sorted((r.cik, r.accession, r.filed.year) for r in got.collect()) == [(1, "124", 2024), (2, "222", 2022)]


@pytest.mark.parametrize("table, periods, rows", [
    # a footnote cell has no period
    ("<tr><th>T</th><th>Mar. 31, 2020</th><th>Mar. 31, 2019</th></tr><tr><td>a</td><td>1</td><td>2</td><td>[1]</td></tr>",
     [2020, 2019, None], [("a", ["1", "2", "[1]"])]),
    # a nested table belongs to nobody
    ("<tr><th>T</th><th>Mar. 31, 2020</th></tr><tr><td>a<table><tr><td>x</td></tr></table></td><td>1</td></tr><tr><td>b</td><td>2</td></tr>",
     [2020], [("a", ["1"]), ("b", ["2"])]),
    # odd spans count as one; row spans push the cells below to the right
    ("<tr><th colspan='100%'>T</th><th>Mar. 31, 2020</th></tr><tr><td rowspan=2>a</td><td colspan=x>1</td></tr><tr><td>2</td></tr>",
     [2020], [("a", ["1"]), ("a", ["2"])]),
    ("<tr><th rowspan=2>T</th><th colspan=2>years</th></tr><tr><th>Mar. 31, 2020</th><th>Mar. 31, 2019</th></tr><tr><td>a</td><td>1</td></tr>",
     [2020], [("a", ["1"])]),
])
def test_irregular_tables(table, periods, rows):
    from tidemark.sources.html_reports import parse_table

    if "100%" in table:
        table = table.replace("100%", "%")
    got = parse_table(f"<table>{table}</table>")
    assert ([d and d.year for d in got[0]], got[1], got[2]) == (periods, rows, None)


def test_documents_without_rows_say_why(spark):
    from tidemark.sources.html_reports import report_rows

    docs = spark.createDataFrame([("a", None), ("b", "<p>x"), ("c", "<table></table>"), ("d", "<table><tr><td>x<td>1")],
                                 "report_id string, html string")
    assert sorted((r.report_id, r.label, r.reason) for r in report_rows(docs).collect()) == [
        ("a", None, "no document"), ("b", None, "no table"), ("c", None, "no rows"), ("d", "x", None)]


def test_refresh_stream_upserts(spark):
    root = tempfile.mkdtemp(prefix="refresh-")
    for day, close in ((1, 1.0), (2, 2.0), (1, 5.0)):
        rows(spark, [("A", dt.date(2024, 1, day), close)]).write.mode("append").parquet(f"{root}/in")
        feed = spark.readStream.schema("ticker string, date date, close double").parquet(f"{root}/in")
        refresh_table(feed, f"{root}/t", f"{root}/stage", f"{root}/cp", ["ticker", "date"], ["close"]).awaitTermination(60)
    assert stored(spark, f"{root}/t") == [("A", 1, 5.0), ("A", 2, 2.0)]


def test_removal_and_cascade(spark):
    t = spark.createDataFrame([("A",), ("B",)], "ticker string")
    gone = t.where("ticker = 'A'")
    tables = {"watchlist": t, "stock_groups": t, "prices": t}
    count = lambda out: {n: d.count() for n, d in out.items()}
    assert count(sinks.remove_tickers(tables, gone)) == {"watchlist": 1, "stock_groups": 1, "prices": 2}
    assert count(sinks.remove_tickers(tables, gone, purge=True)) == {"watchlist": 1, "stock_groups": 1, "prices": 1}
    r = spark.createDataFrame([(1,), (2,)], "rule_id int")
    assert count(sinks.delete_rules({"rules": r, "events": r}, r.where("rule_id = 1"))) == {"rules": 1, "events": 1}


def test_unchanged_run_is_skipped(spark):
    marks = spark.createDataFrame([("A", dt.date(2024, 1, 1), 3, dt.date(2024, 1, 1))],
                                  "ticker string, session date, n_prices bigint, filed_at date")
    changes = incremental.change_detect(marks, marks)
    audit = incremental.run_audit(changes, marks.limit(0), F.lit(dt.date(2024, 1, 2))).first()
    assert (audit.status, audit.tickers, audit.new_price_rows) == ("skipped", 1, 0)
    assert incremental.changed_only(marks, changes).count() == 0


def test_group_median_and_ranks_with_a_hot_group(spark):
    rng = random.Random(3)
    data = [("hot", float(rng.randint(0, 4000)), i) for i in range(20_000)]
    data += [("ties", float(rng.randint(0, 2)), i) for i in range(3000)]
    data += [("one", 5.0, 0), ("even", 1.0, 0), ("even", 2.0, 1), ("none", None, 0)]
    df = spark.createDataFrame(data, "g string, v double, i int").repartition(16)
    got = {r.g: r.m for r in ranking.group_upper_median(df, ["g"], "v", "m").collect()}
    groups = {}
    for g, v, _ in data:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert got == {g: sorted(v)[len(v) // 2] for g, v in groups.items()}

    ranked = ranking.rank_within(df, "g", [F.col("v").desc_nulls_last(), F.col("i")], "rk")
    have = {(r.g, r.i): r.rk for r in ranked.collect()}
    for g in groups:
        own = sorted((r for r in data if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [have[(g, r[2])] for r in own] == list(range(1, len(own) + 1))
    spark.catalog.clearCache()
