"""Landed files, joins, screens, sinks, ranks and streams."""

import datetime as dt
import math
import tempfile

import pytest
from pyspark.sql import functions as F

from barloom.operators import features, joins, screen, sectors
from barloom.session import fresh_dir
from barloom.sources import feeds, sinks
from barloom.streaming import quotes as st


def folder():
    return tempfile.mkdtemp(prefix="barloom-test-")


def test_board_meeting_file(spark):
    """Other header spellings, spaces, a nameless last column; the first of two rows for one meeting stands."""
    path = folder() + "/meetings.csv"
    with open(path, "w") as f:
        f.write("Scrip Code ,Company, Purpose,Board Meeting Date,\n 512001 ,Tern Mills,Audited results,2024-03-05,x\n512777,Wren Foods,Dividend,7-4-2024,\n"
                "512001,Tern Mills Ltd,Another text,5 Mar 2024,\n,No Code Ltd,Audited results,5 Mar 2024,\n512900,No Date Ltd,Audited results,soon,\n")
    raw = feeds.read_csv_text(spark, path)
    rows = {(r["bse_code"], str(r["result_date"])): (r["company"], r["purpose"]) for r in feeds.parse_board_meetings(raw).collect()}
    assert rows == {(512001, "2024-03-05"): ("Tern Mills", "Audited results"), (512777, "2024-04-07"): ("Wren Foods", "Dividend")}
    assert tuple(feeds.board_meeting_counts(raw).first()) == (5, 2, 1)
    with pytest.raises(ValueError):
        feeds.meeting_columns(["Company", "Industry"])


def test_first_feed_row_stands_and_old_results_drop(spark):
    rows = [("TRN", "Financial Results", "x", "05-Mar-2024", "I9", "Later copy", "Steel", 8), ("TRN", "Board Meeting", "quarterly results", "05-Mar-2024", "I9", "First copy", "-", 3),
            ("TRN", "Financial Results", "x", "01-Feb-2020", "I9", "Old", "-", 4), ("TRN", "Dividend", "x", "06-Mar-2024", "I9", "None", "-", 5)]
    raw = spark.createDataFrame(rows, "bm_symbol string, bm_purpose string, bm_desc string, bm_date string, sm_isin string, sm_name string, sm_indusrty string, row_no long")
    got = {str(r["result_date"]): (r["company"], r["industry"]) for r in feeds.upcoming_results(raw).collect()}
    assert got == {"2024-03-05": ("First copy", None), "2020-02-01": ("Old", None)}
    assert [str(r["date"]) for r in feeds.past_result_dates(raw, "2024-06-01").collect()] == ["2024-03-05"]


def test_rss_file(spark):
    path = folder() + "/feed.xml"
    with open(path, "w") as f:
        f.write("<rss><channel><item><title> First </title><link>http://a</link><pubDate>Tue, 13 Oct 2026 10:00:00 GMT</pubDate></item>"
                "<item><title></title></item><item><title>Third</title><source>Desk</source><pubDate>never</pubDate></item></channel></rss>")
    got = feeds.rss_headlines(feeds.read_rss(spark, path), F.lit("Feed"), F.lit("2026-10-13 12:00:00").cast("timestamp"), limit=15).orderBy("item_no").collect()
    assert [(r["title"], r["source"], r["hours_ago"], r["time_known"]) for r in got] == [("First", "Feed", 2.0, True), ("Third", "Desk", 24.0, False)]


def test_sector_benchmarks(spark):
    cases = [("  CAPITAL   goods", None, "Nifty Infra"), ("Unknown trade", "Realty", "Nifty Realty"), ("Drug makers", "Media Entertainment & Publication", "Nifty Media"),
             (None, "Tyre cord", "Nifty Auto"), ("Jute", "Coir", None), (None, None, None)]
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, a string, b string").orderBy("i")
    assert [r[0] for r in df.select(joins.sector_index_for(F.col("a"), F.col("b"))).collect()] == [c[2] for c in cases]


def test_calendar_merge_fills_blanks(spark):
    d = dt.date
    e = spark.createDataFrame([
        ("I1", "upload", 0, d(2026, 10, 20), "", "Some Ltd-$", 500001, ""), ("I1", "nse", 1, d(2026, 10, 18), "SOME", "Other name", None, "Steel"),
        ("I2", "nse", 1, d(2026, 9, 1), "OLD", "Old", None, None), (None, "nse", 1, d(2026, 10, 18), "N", "N", None, None)],
        "isin string, source string, priority int, result_date date, symbol string, company string, bse_code long, industry string")
    r = joins.merge_calendars(e, "2026-10-01", 30).collect()
    assert len(r) == 1
    assert r[0].asDict() == {"isin": "I1", "result_date": d(2026, 10, 18), "symbol": "SOME", "company": "Some Ltd", "bse_code": 500001,
                             "industry": "Steel", "calendar_sources": ["upload", "nse"]}


def test_rule_screen_edges(spark):
    df = spark.createDataFrame([("A", 60.0, "BUY", 10.0, 5.0), ("B", None, "SELL", 1.0, None), ("C", 40.0, "STRONG BUY", 2.0, 3.0)],
                               "symbol string, rsi double, signal string, ltp double, sma200 double")
    run = lambda *c: sorted(r["symbol"] for r in screen.rule_screen(df, [dict(zip(("logic", "field", "op", "value"), x)) for x in c]).collect())
    assert run(("AND", "RSI", "!=", "60")) == ["C"]                                    # a null field fails even for !=
    assert run(("AND", "price", ">", "sma200")) == ["A", "B"]                          # a null column on the right is 0
    assert run(("AND", "signal", "=", "'buy'")) == ["A"]
    assert run(("AND", "rsi", ">", "50"), ("OR", "signal", "=", "Sell"), ("AND", "price", ">", "5")) == ["A"]   # folded left to right
    assert run(("AND", "nothing", ">", "1")) == [] and run() == ["A", "B", "C"]


def test_bounds_need_values(spark):
    df = spark.createDataFrame([(1, 30.0, None), (2, 30.0, 20.0), (3, 10.0, 20.0)], "k int, a double, b double")
    assert [r["k"] for r in df.filter(screen.within_bounds({"a": (25, None), "b": (None, None)})).collect()] == [1, 2]
    assert [r["k"] for r in df.filter(screen.within_bounds({"a": (25, None), "b": (15, 25)})).collect()] == [2]


def test_global_rank_with_one_hot_score(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 3 != 0, F.lit(5.0)).when(F.col("id") % 2 == 0, F.col("id").cast("double")).alias("score"))
    got = screen.global_rank(df, "score", "id").collect()
    ranked = sorted((r for r in got if r["score"] is not None), key=lambda r: (-r["score"], r["id"]))
    assert [r["rank"] for r in ranked] == list(range(1, len(ranked) + 1)) and all(r["rank"] is None for r in got if r["score"] is None)


def test_top_per_group_is_exact(spark):
    df = spark.range(400).select("id", F.when(F.col("id") < 300, 0).otherwise(1).alias("g"), (F.col("id") * 7919 % 401).alias("v"))
    got = sorted(r["id"] for r in screen.top_per_group(df, ["g"], [F.desc("v"), F.asc("id")], 5, salt_on="id").collect())
    rows = [(r["g"], -r["v"], r["id"]) for r in df.collect()]
    want = sorted(x[2] for g in (0, 1) for x in sorted(r for r in rows if r[0] == g)[:5])
    assert got == want


def test_strict_clean_and_runs(spark):
    df = spark.createDataFrame([(-math.inf, [math.nan, 0.123456], {"k": 7.0, "m": math.nan})], "x double, y array<double>, z map<string,double>")
    r = sinks.strict_clean(df).first()
    assert (r["x"], r["y"], r["z"]) == (None, [None, 0.1235], {"k": 7.0, "m": None})
    root = fresh_dir(spark, "runs")
    assert sinks.read_run(spark, root) is None and sinks.list_runs(spark, root).count() == 0
    for day in range(1, 5):
        sinks.save_run(df, root, f"2026010{day}_000000", f"2026-01-0{day}")
    assert sinks.read_run(spark, root).select("generated_at").first()[0] == "2026-01-04"
    assert sinks.read_run(spark, root, "20260102_000000", "csv").select("generated_at").first()[0] == "2026-01-02"
    assert sinks.read_run(spark, root, "20990101_000000") is None
    assert [r["run_id"] for r in sinks.list_runs(spark, root, 2).collect()] == ["20260104_000000", "20260103_000000"]
    assert sinks.drop_old_runs(spark, root, keep=3) == ["20260101_000000"]
    assert sinks.list_runs(spark, root).count() == 3 and sinks.read_run(spark, root, "20260101_000000") is None


def test_unfinished_saves_are_never_seen(spark):
    root = fresh_dir(spark, "runs")
    one = spark.createDataFrame([("a", 1.0)], "s string, x double")
    sinks.save_run(one, root, "r1", "first")
    bad = one.select("s", F.raise_error(F.lit("lost")).cast("double").alias("x"))
    with pytest.raises(Exception, match="lost"):
        sinks.save_run(bad, root, "r1", "second")
    one.withColumn("generated_at", F.lit("third")).write.json(f"{root}/data/run_id=r2/save=torn/json")       # files without a manifest row
    assert [(r["run_id"], r["generated_at"]) for r in sinks.list_runs(spark, root).collect()] == [("r1", "first")]
    assert sinks.read_run(spark, root).select("generated_at").first()[0] == "first"
    sinks.save_run(one.union(one), root, "r1", "fourth")
    assert [tuple(r) for r in sinks.list_runs(spark, root).collect()] == [("r1", "fourth", 2)]
    assert sinks.read_run(spark, root, "r1").count() == 2
    sinks.drop_old_runs(spark, root)
    assert sinks.read_run(spark, root, "r1").count() == 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.json(f"{root}/data/run_id=r2/save=torn/json")


def test_bars_by_month(spark):
    """An upsert rewrites the months it touches and no other; a date range reads its months only."""
    rows = [("A", dt.date(2024, m, d), float(m), 1) for m in range(1, 7) for d in (1, 15)]
    bars = spark.createDataFrame(rows, "symbol string, date date, c double, load_ts int").withColumns({f: F.col("c") for f in "ohlv"})
    path = fresh_dir(spark, "bars")
    sinks.write_bars(bars, path)
    files = lambda: {f.rsplit("/", 2)[1]: f for f in sinks.read_bars(spark, path).inputFiles()}
    before = files()
    new = bars.filter("date in ('2024-05-15', '2024-06-15')").withColumns({"c": F.lit(9.0), "load_ts": F.lit(2)})
    later = new.limit(1).withColumn("date", F.lit("2024-07-01").cast("date"))
    assert sinks.upsert_stored(new.unionByName(later), path) == ["2024-05", "2024-06", "2024-07"]
    after = files()
    assert {m for m in after if after[m] != before.get(m)} == {"month=2024-05", "month=2024-06", "month=2024-07"}
    stored = {(r["date"], r["c"], r["load_ts"]) for r in sinks.read_bars(spark, path).collect()}
    assert len(stored) == 13 and (dt.date(2024, 6, 15), 9.0, 2) in stored and (dt.date(2024, 6, 1), 6.0, 1) in stored
    part = sinks.between(sinks.read_bars(spark, path), F.lit("2024-02-10").cast("date"), F.lit("2024-03-20").cast("date"))
    assert sorted(r["date"].month for r in part.collect()) == [2, 3, 3]
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "2024-02" in plan and "2024-03" in plan
    newest = features.recent_stored_sessions(sinks.read_bars(spark, path), 4)
    assert sorted(r["date"] for r in newest.collect()) == [dt.date(2024, 5, 15), dt.date(2024, 6, 1), dt.date(2024, 6, 15), dt.date(2024, 7, 1)]
    assert "month" in newest._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1][:20]
    assert features.recent_stored_sessions(sinks.read_bars(spark, path), 25).count() == 13


def test_fundamentals_upsert(spark):
    old = spark.createDataFrame([("I1", 1.0, 1), ("I2", 2.0, 2)], "`ISIN Code` string, OPM double, row_no long")
    new = spark.createDataFrame([("I2", 5.0, 1), ("I2", 6.0, 2), ("I3", 7.0, 3), (None, 8.0, 4)], "`ISIN Code` string, OPM double, row_no long")
    assert {(r[0], r[1]) for r in feeds.upsert_fundamentals(old, new).select("ISIN Code", "OPM").collect()} == {("I1", 1.0), ("I2", 6.0), ("I3", 7.0)}


def test_small_universe_is_refused(spark):
    rows = spark.createDataFrame([("A", "A Ltd", "", "I1")], "Symbol string, `Company Name` string, Industry string, `ISIN Code` string")
    assert feeds.size_buckets([("Large", rows)], rows, at_least=1).first()["sector"] == "Other"
    with pytest.raises(Exception, match="only 1 stocks"):
        feeds.size_buckets([("Large", rows)], rows).collect()


def test_sector_order_puts_small_groups_last(spark):
    df = spark.createDataFrame([("a", 2, 2, 9.0), ("b", 5, 1, 1.0), ("c", 4, 4, None)], "sector string, n int, adv int, today double")
    assert [r[0] for r in df.orderBy(*sectors.sector_order("today")).collect()] == ["b", "c", "a"]
    assert [r[0] for r in df.orderBy(*sectors.sector_order("breadth")).collect()] == ["c", "b", "a"]


def test_alert_rules(spark):
    q = spark.createDataFrame([("X", None, 71.2, "STRONG BUY")], "symbol string, ltp double, rsi double, signal string")
    cases = [("price", "below", "100", False), ("rsi", "above", "71.2", True), ("rsi", "above", "72", False), ("signal", "above", "BUY", True),
             ("signal", "above", "SELL", False), ("price", "above", "abc", False)]
    a = spark.createDataFrame([("X", i, *c[:3]) for i, c in enumerate(cases)], "symbol string, i int, metric string, condition string, value string")
    got = [r[0] for r in q.join(a, "symbol").orderBy("i").select(st.alert_fires()).collect()]
    assert got == [c[3] for c in cases]


def test_alert_fires_once_over_batches(spark):
    alerts = spark.createDataFrame([("a1", "X", "price", "above", "10")], "alert_id string, symbol string, metric string, condition string, value string")
    out = fresh_dir(spark, "alerts")
    step = st.alert_latch(alerts, out)
    batch = lambda *p: spark.createDataFrame([("X", dt.datetime(2026, 1, 1, 0, i), i, float(x), None, None) for i, x in enumerate(p)],
                                             "symbol string, ts timestamp, tick_id int, ltp double, rsi double, signal string")
    for i, prices in enumerate([(5, 6), (9, 12, 15), (20,)]):
        step(batch(*prices), i)
        step(batch(*prices), i)                      # a batch that runs again
    rows = spark.read.parquet(out).collect()
    assert [(r["alert_id"], r["ltp"], r["batch_id"]) for r in rows] == [("a1", 12.0, 1)]


def test_late_ticks_and_quote_merge(spark):
    t = lambda m, s=0: dt.datetime(2026, 1, 5, 4, m, s)
    ticks = spark.createDataFrame([("X", t(0), 10.0, 1.0, 2), ("X", t(0), 11.0, 1.0, 1), ("X", t(4, 59), 9.0, 2.0, 3), ("X", t(5), 8.0, 1.0, 4)],
                                  "symbol string, ts timestamp, price double, qty double, tick_id int")
    b = st.five_minute_bars(ticks, watermark=None).orderBy("bar_start").collect()
    assert [(r["o"], r["h"], r["l"], r["c"], r["v"]) for r in b] == [(11.0, 11.0, 9.0, 9.0, 4.0), (8.0, 8.0, 8.0, 8.0, 1.0)]
    q = spark.createDataFrame([("X", t(1), 1.0, "BUY"), ("X", t(2), 2.0, None)], "symbol string, ts timestamp, ltp double, signal string")
    r = st.latest_quotes(q, ["ltp"], ["signal"], F.col("ts")).first()
    assert (r["ltp"], r["signal"]) == (2.0, "BUY")


def test_readers_of_landed_files(spark, tmp_path):
    (tmp_path / "bars.json").write_text('{"symbol": "A", "t": "2024-01-02T00:00:00+05:30", "o": "1", "h": "2", "l": "0.5", "c": "x", "v": "7", "arrival": 1}\n')
    from barloom.sources import bars as bar_source

    bar = bar_source.parse_bars(feeds.read_bars_json(spark, str(tmp_path / "bars.json"))).first()
    assert (bar["symbol"], bar["date"], bar["h"], bar["c"], bar["v"]) == ("A", dt.date(2024, 1, 2), 2.0, None, 7.0)
    (tmp_path / "instruments.json").write_text('[{"segment": "NSE_EQ", "instrument_type": "EQ", "exchange_token": "1", "isin": "I1", "trading_symbol": "AA", "name": "Alpha"},\n {"isin": "I2"}]')
    assert [(r["isin"], r["name"]) for r in feeds.read_instruments(spark, str(tmp_path / "instruments.json")).orderBy("isin").collect()] == [("I1", "Alpha"), ("I2", None)]
    names = [f.name for f in feeds.FUNDAMENTALS_SCHEMA]
    row = {"Name": "Alpha Ltd", "ISIN Code": "I1", "OPM": "12.5"}
    (tmp_path / "master.csv").write_text(",".join(names) + "\n" + ",".join(row.get(n, "") for n in names) + "\n" + ",".join(["Beta"] + [""] * (len(names) - 1)) + "\n")
    got = feeds.read_fundamentals(spark, str(tmp_path / "master.csv")).collect()
    assert [(r["Name"], r["ISIN Code"], r["OPM"]) for r in got][0] == ("Alpha Ltd", "I1", 12.5) and len({r["row_no"] for r in got}) == len(got)
