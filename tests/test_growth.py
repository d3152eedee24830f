"""Plans and results of steps that have to grow with their input: tests of the findings on time, memory and shuffle."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import Row, functions as F

from tidemark.operators import distribution, incremental, refresh, rules, state
from tidemark.plans import queries
from tidemark import session
from tidemark.sources import html_reports, sinks
from tidemark.streaming import rules_stream


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def wide(spark):
    rows = [(t, date(2000, 1, 1) + timedelta(days=400 * i), None if i == 3 else float((i * 7 + k) % 5), 2.0 if t == "A" else None)
            for k, t in enumerate(("A", "B", None)) for i in range(12)]
    return spark.createDataFrame(rows, "ticker string, date date, pe_ttm double, pb double")


def test_concept_values_sort_no_fact_per_filing_date(spark):
    facts = spark.createDataFrame(
        [("A", "revenue", date(2000, 1 + 3 * q, 1), date(2000, 3 + 3 * q, 28), 88, date(2001, 1 + q, 1), acc, v)
         for q in range(4) for acc, v in (("b", 5.0), ("a", float(q)))],
        "ticker string, concept string, period_start date, period_end date, duration_days int, filed_at date, accession string, value double")
    values = state.concept_values(facts)
    assert plan_of(values).count("Window [") <= 1  # one for the ticker's dates; none orders expanded facts
    got = {r.as_of: r.value for r in values.collect()}
    assert got == {date(2001, 1, 1): None, date(2001, 2, 1): None, date(2001, 3, 1): None, date(2001, 4, 1): 6.0}


@pytest.mark.parametrize("stat", [distribution.metric_stats, distribution.upper_median, distribution.latest_value])
def test_statistics_keep_rows_wide_until_one_per_ticker(spark, stat):
    lines = [x.strip(" :+-") for x in plan_of(stat(wide(spark), ["pe_ttm", "pb"])).splitlines()]
    generate = max(i for i, x in enumerate(lines) if x.startswith("Generate"))
    assert generate < next(i for i, x in enumerate(lines) if x.startswith("Aggregate"))
    assert not any(x.startswith("Window") for x in lines)


def test_statistics_by_hand(spark):
    rows = wide(spark).collect()
    for t in ("A", "B", None):
        for m in ("pe_ttm", "pb"):
            known = sorted((r.date, r[m]) for r in rows if r.ticker == t and r[m] is not None)
            found = [r for r in distribution.metric_stats(wide(spark), ["pe_ttm", "pb"]).collect()
                     if r.ticker == t and r.metric_key == m]
            assert len(found) == bool(known)
            if known:
                inside = sorted(v for d, v in known if d >= known[-1][0].replace(year=known[-1][0].year - 10))
                r = found[0]
                assert (r.date, r.value, r.n, r.median) == (*known[-1], len(inside), inside[len(inside) // 2])
                assert r.percentile == sum(v <= known[-1][1] for v in inside) / len(inside) * 100
    medians = {(r.ticker, r.metric_key): r["median"] for r in distribution.upper_median(wide(spark), ["pe_ttm", "pb"]).collect()}
    assert medians == {
        (t, m): sorted(v)[len(v) // 2] for t in ("A", "B") for m in ("pe_ttm", "pb")
        if (v := [r[m] for r in rows if r.ticker == t and r[m] is not None])}


def test_trailing_percentile_ranks_all_metrics_of_a_ticker_at_once(spark):
    rows = [("A", m, None if i == 19 else date(2000, 1, 1) + timedelta(days=3 * i), float((i * 5 + k) % 7))
            for k, m in enumerate(("x", "y", None)) for i in range(20)]
    long = spark.createDataFrame(rows, "ticker string, metric_key string, date date, value double")
    ranked = rules.trailing_percentile(long, 15)
    assert "FlatMapGroupsInArrow [ticker" in plan_of(ranked)
    for r in ranked.collect():
        own = [(d, v) for _, m, d, v in rows if m == r.metric_key]
        dated = [d for d, _ in own if d]
        day = r.date or max(dated)
        inside = [v for d, v in own if (d or max(dated)) >= day - timedelta(days=15) and (d or max(dated)) <= day
                  and (r.date is None or d is not None)]
        assert (r.n, r.pct) == (len(inside), sum(v <= r.value for v in inside) / len(inside) * 100)


def test_refresh_derives_its_input_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(value):
        seen.add(1)
        return value

    prices = spark.createDataFrame(
        [("A", date(2002, 1, d), float(d), d) for d in range(1, 11)], "ticker string, date date, close double, volume long")
    facts = spark.createDataFrame(
        [("A", "revenue", date(2000, 1, 1), date(2000, 12, 31), 365, date(2001, 2, 1), "a", "10-K", "USD", 5.0)],
        "ticker string, concept string, period_start date, period_end date, duration_days int, filed_at date, "
        "accession string, form string, unit string, value double")
    splits = spark.createDataFrame([], "ticker string, date date, ratio double")
    given = prices.withColumn("close", counted.asNondeterministic()("close"))
    incremental.refresh_ratios(f"file://{tmp_path}/store", given, facts, splits, buckets=2)
    assert seen.value == 10


def test_segment_refresh_reads_its_index_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(ticker):
        seen.add(1)
        return ticker

    index = spark.createDataFrame([("A", 1, ["10-K"], ["f"], [date(2021, 2, 1)], [date(2020, 12, 31)])], (
        "ticker string, cik long, form array<string>, accessionNumber array<string>, filingDate array<date>, reportDate array<date>"))
    listing = spark.createDataFrame([("f", i, f"Segment Information {i} (Details)", f"R{i}.htm") for i in (1, 2, 3)],
                                    "filing_id string, position int, short_name string, file string")
    documents = spark.createDataFrame([("f", f"R{i}.htm", "<table><tr><th>x</th></tr></table>") for i in (1, 2, 3)],
                                      "filing_id string, file string, html string")
    revenue = spark.createDataFrame([], "ticker string, concept string, period_end date, duration_days int, filed_at date, "
                                        "accession string, value double")
    given = index.withColumn("ticker", counted.asNondeterministic()("ticker"))
    assert refresh.segment_refresh(given, listing, documents, revenue, F.lit(date(2021, 6, 1)), 5, 5).count() == 0
    assert seen.value == 1


def test_index_texts_are_made_of_filings(spark, sf_dir, monkeypatch):
    """No filter on what the texts say can reach the line items."""
    given, real = [], queries.facts.read_filing_index
    monkeypatch.setattr(queries.facts, "read_filing_index", lambda documents: (given.append(documents.inputFiles()), real(documents))[1])
    queries.segment_refresh(spark, sf_dir)
    assert given and given[0] and not [f for f in given[0] if "lineitem" in f]


def test_repeated_headers_keep_their_dates(spark):
    reports = spark.createDataFrame([(f"r{i}", f"<table><tr><th>t</th><th>{day}</th></tr><tr><td>a</td><td>{i}</td></tr></table>")
                                     for i, day in enumerate(["Dec. 31, 2020", "Dec. 31, 2020", "none", "Dec. 31, 2021"])],
                                    "report_id string, html string")
    got = {r.report_id: (r.row_idx, r.label, r.cells, r.periods, r.reason) for r in html_reports.report_rows(reports).collect()}
    assert got == {f"r{i}": (0, "a", [str(i)], [day], None) for i, day in enumerate(
        [date(2020, 12, 31), date(2020, 12, 31), None, date(2021, 12, 31)])}
    assert html_reports.report_rows(reports.limit(0)).collect() == []


def odd_sessions(spark):
    """Tickers of many and few sessions, null ones, days that repeat or are unknown, values null and no number."""
    rows = []
    for k, t in enumerate(("A", "B", "C", None)):
        for i in range(60 if t == "B" else 9):
            day = None if i == 7 else date(2000, 1, 1) + timedelta(days=2 * (i - (i == 4)))
            rows.append((t, day, None if (i + k) % 4 == 0 else float((i * 5 + k) % 7), float("nan") if i == 3 else float(i % 3), None))
    rows.append(("D", None, 1.0, None, None))
    return spark.createDataFrame(rows, "ticker string, date date, pe_ttm double, pb double, roe double")


@pytest.mark.parametrize("held", [5, 8192])
def test_metrics_of_a_session_are_ranked_together(spark, monkeypatch, held):
    monkeypatch.setattr(rules, "RANKED_ROWS", held)
    names = ["pe_ttm", "pb", "roe"]
    wide_rows = odd_sessions(spark).dropDuplicates(["ticker", "date"])
    ranked = rules.trailing_percentile(wide_rows, 15, metrics=names)
    plan = plan_of(ranked)
    assert plan.index("Generate") < plan.index("MapInArrow")  # long rows come after the ranks
    assert "Generate" not in plan[plan.index("MapInArrow"):]
    entries = [F.struct(F.lit(m).alias("metric_key"), F.col(m).alias("value")) for m in names]
    one_by_one = rules.trailing_percentile(wide_rows.select("ticker", "date", F.inline(F.array(*entries))), 15)
    show = lambda df: sorted(map(str, df.select("ticker", "date", "metric_key", "value", "pct", "n").collect()))
    assert show(ranked) == show(one_by_one) and show(ranked)


def test_sessions_stay_wide_until_they_meet_their_rules(spark):
    rows = odd_sessions(spark).withColumn("fundamentals_filed_at", F.col("date"))
    pairs = spark.createDataFrame(
        [(1, "A", "percentile_below", 50.0, "pe_ttm"), (1, "A", "percentile_below", 50.0, "pe_ttm"), (2, "A", "value_above", 2.0, "pe_ttm"),
         (3, "B", "new_filing", None, None), (4, "B", "value_above", 1.0, "ev_fcf"), (5, "B", "percentile_above", 10.0, "pb"),
         (6, "Z", "value_above", 1.0, "pb"), (7, None, "value_above", 1.0, "pb")],
        "rule_id int, ticker string, condition string, threshold double, metric_key string")
    sessions = rules.rule_sessions(rows, pairs)
    assert plan_of(sessions).count("MapInArrow") == 1 and "Union" not in plan_of(sessions)
    got = sessions.groupBy("rule_id", "ticker").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("values"),
                                                    F.count("percentile").alias("ranked"), F.count_if("holds").alias("holds")).collect()
    assert sorted(map(tuple, got)) == [(1, "A", 18, 12, 12, 0), (2, "A", 9, 6, 0, 3), (3, "B", 60, 0, 0, 0), (5, "B", 60, 60, 60, 0)]


def test_a_feed_is_written_once(spark, sf_dir, monkeypatch):
    seen = []

    def run(feed, root):
        files = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/feed").inputFiles()
        assert not seen or set(seen[-1]) < set(files)  # parts arrive one by one and stay
        seen.append(files)
        return len(files)

    sessions = queries._sessions(spark, sf_dir)
    monkeypatch.setattr(queries, "_sessions", lambda spark, d: sessions)
    monkeypatch.setattr(queries, "FEED_CUTS", ["1998-01-01", "2090-01-01"])  # the last part is empty
    last, root = queries._fed(spark, sf_dir, run)
    assert len(seen) == 3 and last == len(seen[-1])
    feed = spark.read.schema(sessions.schema).option("recursiveFileLookup", "true").parquet(f"{root}/feed")
    assert feed.exceptAll(sessions).isEmpty() and sessions.exceptAll(feed).isEmpty()
    assert not queries.sinks.table_exists(spark, f"{root}/landed/part=0")


def test_a_stream_keeps_one_state_per_ticker(spark, tmp_path):
    day = lambda n: date(2000, 1, 1) + timedelta(days=n)
    sessions = spark.createDataFrame(
        [(rule, t, day(i), "value_above", 1.0, "roe", float(i % 3), None, None, i % 3 > 1) for rule in (1, 2, 3) for t in "AB"
         for i in range(rule * 3)], "rule_id int, ticker string, session date, condition string, threshold double, "
        "metric_key string, value double, percentile double, marker date, holds boolean")
    sessions.write.parquet(f"{tmp_path}/feed")
    rules_stream.run_events(spark.readStream.schema(sessions.schema).parquet(f"{tmp_path}/feed"), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert spark.read.format("statestore").option("stateVarName", "last").load(f"{tmp_path}/cp").count() == 2
    assert sorted(map(tuple, rules_stream.stream_state(spark, f"{tmp_path}/cp").collect())) == [
        (rule, t, day(rule * 3 - 1), True, None) for rule in (1, 2, 3) for t in "AB"]


def test_a_pair_expires_with_its_own_last_session():
    class Value:
        held = None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    class Clock:
        now = 0

        def getCurrentProcessingTimeInMs(self):
            return self.now

    state, clock = rules_stream.TickerState(ttl_days=1), Clock()
    state._last = Value()
    row = lambda rule, n: Row(rule_id=rule, ticker="A", condition="value_above", threshold=1.0, metric_key="roe", sessions=np.array(
        [(n, rules_stream.UNKNOWN, True, 2.0, np.nan)], rules_stream.SESSION).tobytes())
    put = lambda now, *rows: (setattr(clock, "now", now), [e["rule_id"] for e in state.handleInputRows(("A",), iter(rows), clock)])[1]
    assert put(0, row(1, 1), row(2, 1)) == [1, 2]
    assert put(86_300_000, row(1, 2)) == []  # still held; the state is younger than a day
    assert put(86_500_000, row(1, 3), row(2, 3)) == [2]  # rule 2 had no session for a day and starts anew


def test_a_refresh_leaves_only_its_store_and_its_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda spark: f"file://{tmp_path}/shared")
    prices = spark.createDataFrame(
        [(t, date(2002, 1, d), float(d), d) for t in "AB" for d in range(1, 11)], "ticker string, date date, close double, volume long")
    facts = spark.createDataFrame(
        [(t, "revenue", date(2000, 1, 1), date(2000, 12, 31), 365, date(2001, 2, 1), "a", "10-K", "USD", 5.0) for t in "AB"],
        "ticker string, concept string, period_start date, period_end date, duration_days int, filed_at date, "
        "accession string, form string, unit string, value double")
    splits = spark.createDataFrame([], "ticker string, date date, ratio double")
    before = spark.conf.get(session.SHUFFLE_CLEANUP)
    for n, given in enumerate((prices.where("ticker = 'A'"), prices), 1):
        changes = incremental.refresh_ratios(f"file://{tmp_path}/store", given, facts, splits, buckets=2)
        assert len(list((tmp_path / "shared").iterdir())) == n  # the changes that are returned, and nothing else
        assert changes.where("derive").count() > 0
    assert sinks.read_table(spark, f"file://{tmp_path}/store/prices").count() == 20
    assert spark.conf.get(session.SHUFFLE_CLEANUP) == before
