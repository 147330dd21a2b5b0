"""How the supplied tables stand in for market data.

No market data is supplied, so bars, ticks, filings, calendars and fundamentals are
derived from the sales, event and text tables. The operators do not know about this.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.session import fresh_dir, stage
from barloom.sources.bars import order_key, roll_up_ticks
from barloom.sources.sinks import write_bars

TODAY = "2001-06-30"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One priced trade per order line: symbol = brand, price = extended price per unit."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_shipdate", "l_returnflag", "l_linestatus", "l_discount",
    )
    brands = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    return lines.join(brands, F.col("l_partkey") == F.col("p_partkey")).select(
        "symbol",
        F.to_date("l_shipdate").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("qty"),
        order_key((F.col("l_orderkey"), 13), (F.col("l_linenumber"), 2), (F.col("l_partkey"), 12), (F.col("l_suppkey"), 10)).alias("seq"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("line"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_discount").alias("discount"),
    )


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roll_up_ticks(trade_ticks(spark, sf_dir), ["symbol", "date"])


def stored_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily bars written down once, for jobs that read them several times (as a bars table would be)."""
    return stage(bars_daily(spark, sf_dir))


def monthly_bars(spark: SparkSession, sf_dir: str) -> str:
    """The daily bars stored by month (``sinks.write_bars``); returns their path."""
    path = fresh_dir(spark, "bars")
    write_bars(bars_daily(spark, sf_dir), path)
    return path


def brand_number(symbol: Column) -> Column:
    return F.substring_index(symbol, "#", -1).cast("int")


def universe(bars: DataFrame) -> DataFrame:
    """One row per symbol with sector, size bucket, flag and identifiers."""
    n = brand_number(F.col("symbol"))
    sectors = ["Financial Services", "Information Technology", "Healthcare", "Realty", "Unlisted Trades"]
    return bars.select("symbol").distinct().select(
        "symbol",
        F.concat(F.lit("Company "), n).alias("name"),
        F.element_at(F.array(*[F.lit(s) for s in sectors]), F.floor((n - 1) / 5).cast("int") % 5 + 1).alias("sector"),
        F.element_at(F.array(*[F.lit(s) for s in ("Large", "Mid", "Small", "Micro")]), n % 4 + 1).alias("cap"),
        (n % 3 == 0).alias("flagship"),
        F.format_string("INE%07d", n).alias("isin"),
        (F.lit(500000) + n).cast("long").alias("bse_code"),
    )


def market_index(bars: DataFrame) -> DataFrame:
    """Equal-weight mean close per date: one row per session, so its size is bounded by the calendar."""
    return bars.groupBy("date").agg(F.avg("c").alias("c"))


def sector_index(bars: DataFrame, members: DataFrame) -> DataFrame:
    return (
        bars.join(members.select("symbol", "sector"), "symbol")
        .groupBy("sector", "date").agg(F.avg("c").alias("c"))
    )


INDEXES = ["Nifty Pharma", "Nifty IT", "Nifty Metal", "Nifty Realty", "Nifty Auto"]


def index_bars(bars: DataFrame) -> DataFrame:
    """Named indexes: the mean close of the brands with one remainder by five. Other indexes have no bars."""
    names = F.array(*[F.lit(x) for x in INDEXES])
    return bars.withColumn("index_name", F.element_at(names, brand_number(F.col("symbol")) % 5 + 1)).groupBy(
        "index_name", "date").agg(F.avg("c").alias("c"))


def fundamentals(ticks: DataFrame, key: str) -> DataFrame:
    """Fundamentals per company from its trades of the last year and the year before (see README for the rules)."""
    cur = F.col("date").between("2000-07-01", "2001-06-30")
    prev = F.col("date").between("1999-07-01", "2000-06-30")
    amount = F.col("price") * F.col("qty")
    margin = amount * (F.lit(0.06) - F.col("discount"))
    in_cur = lambda c: F.when(cur, c)
    in_prev = lambda c: F.when(prev, c)
    a = ticks.groupBy(key).agg(
        F.sum(in_cur(amount)).alias("s1"), F.sum(in_prev(amount)).alias("s0"),
        F.sum(in_cur(margin)).alias("p1"), F.sum(in_prev(margin)).alias("p0"),
        F.avg(in_cur(F.col("qty"))).alias("q1"), F.avg(in_cur(F.col("discount"))).alias("d1"),
        F.avg(in_prev(F.col("discount"))).alias("d0"),
        F.avg(F.when(F.col("flag") == "A", F.col("discount"))).alias("da"),
        F.min(in_cur(F.col("price"))).alias("low"), F.sum(amount).alias("all"),
        F.max_by("price", F.struct("date", "seq")).alias("last_price"))
    nz = lambda c: F.when(c != 0, c)
    pg = 100 * (F.col("p1") - F.col("p0")) / nz(F.abs("p0"))
    pe = F.col("low") / 100 - 5
    return a.select(
        key,
        F.col("last_price").alias("Current Price"), pe.alias("Price to Earning"),
        (F.col("all") / 1000).alias("Market Capitalization"),
        (F.col("p1") / 1000).alias("Net Profit latest quarter"), pg.alias("YOY Quarterly profit growth"),
        (F.col("s1") / 1000).alias("Sales latest quarter"),
        (100 * (F.col("s1") / F.col("s0") - 1)).alias("YOY Quarterly sales growth"),
        F.col("q1").alias("Return on capital employed"), (pe / nz(pg)).alias("PEG Ratio"),
        (F.col("da") * 12).alias("CFO by PAT"), (F.col("d1") * 20).alias("Debt to equity"),
        (100 * F.col("p1") / F.col("s1") + 15).alias("OPM"),
        (100 * (F.col("d1") - F.col("d0"))).alias("Change in FII holding"),
    )


def brand_master(ticks: DataFrame) -> DataFrame:
    """The fundamentals master by brand: every seventh brand is missing, every fifth has no ISIN."""
    n = brand_number(F.col("symbol"))
    industries = ["Pharmaceuticals", "Software Products", "Steel", "Cement", "Retailing"]
    return fundamentals(ticks, "symbol").filter(n % 7 != 0).select(
        F.concat(F.lit("Company "), n).alias("Name"), (F.lit(500000) + n).cast("long").alias("BSE Code"),
        F.col("symbol").alias("NSE Code"), F.when(n % 5 != 0, F.format_string("INE%07d", n)).alias("ISIN Code"),
        F.lit(None).cast("string").alias("Industry Group"),
        F.element_at(F.array(*[F.lit(x) for x in industries]), n % 5 + 1).alias("Industry"),
        *[f"`{c}`" for c in fundamentals(ticks, "symbol").columns if c != "symbol"],
        n.cast("long").alias("row_no"))


def part_master(ticks: DataFrame) -> DataFrame:
    """Fundamentals by part: one company per part, so the table grows with the data."""
    return fundamentals(ticks, "part_id").withColumns({
        "ISIN Code": F.format_string("PRT%08d", "part_id"), "BSE Code": F.col("part_id"),
        "NSE Code": F.concat(F.lit("P"), "part_id"), "row_no": F.col("part_id")})


def listings(members: DataFrame) -> DataFrame:
    """One listing per brand; every fourth is not on the symbol exchange, every ninth has no ISIN there."""
    n = brand_number(F.col("symbol"))
    return members.select(
        "bse_code", F.when(n % 9 != 0, F.col("isin")).alias("isin"), F.concat(F.lit("B"), n).alias("bse_symbol"),
        F.when(n % 4 != 0, F.col("symbol")).alias("nse_symbol"),
        F.when(n % 3 == 0, F.upper("name")).otherwise(F.concat("name", F.lit("."))).alias("name"))


def meeting_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw board-meeting export: one row per order, dates in six spellings, some unreadable; copies differ in purpose."""
    o = table(spark, sf_dir, "orders")
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 8
    spelled = (
        F.when(k == 0, F.date_format(d, "dd MMM yyyy")).when(k == 1, F.date_format(d, "dd-MMM-yyyy"))
        .when(k == 2, F.date_format(d, "dd/MM/yyyy")).when(k == 3, F.date_format(d, "dd-MM-yyyy"))
        .when(k == 4, F.date_format(d, "yyyy-MM-dd")).when(k == 5, F.date_format(d, "dd MMMM yyyy"))
        .when(k == 6, F.lit("to be announced")).otherwise(F.date_format(d, " dd MMM yyyy ")))
    return o.select(
        F.when(F.col("o_orderkey") % 50 == 0, "n/a").otherwise((500001 + F.col("o_custkey") % 25).cast("string"))
        .alias(" Security Code"),
        F.concat(F.lit(" Company "), 1 + F.col("o_custkey") % 25, F.lit(" Ltd-$ ")).alias("Company name"),
        F.lit("Steel").alias("Industry"),
        F.when(F.col("o_orderkey") % 3 == 0, "Results and dividend").otherwise("Quarterly Results").alias("Purpose"),
        spelled.alias("Meeting Date "), F.lit(None).cast("string").alias("_c5"), F.col("o_orderkey").alias("row_no"))


def result_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw board-meeting feed: one row per order; two of three are about results."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("Brand#"), 1 + F.col("o_custkey") % 25).alias("bm_symbol"),
        F.when(k % 3 == 0, "Dividend").when(k % 3 == 1, "Financial Results").otherwise("Board Meeting").alias("bm_purpose"),
        F.when(k % 3 == 2, "to consider quarterly RESULTS").otherwise("to consider").alias("bm_desc"),
        F.when(k % 11 == 0, "soon").otherwise(F.date_format("o_orderdate", "dd-MMM-yyyy")).alias("bm_date"),
        F.format_string("INE%07d", 1 + F.col("o_custkey") % 25).alias("sm_isin"),
        F.concat(F.lit("Company "), 1 + F.col("o_custkey") % 25).alias("sm_name"),
        F.when(k % 2 == 0, "-").when(k % 5 == 0, "Realty").otherwise("Healthcare").alias("sm_indusrty"), k.alias("row_no"))


HOLIDAYS = ["1999-01-26", "1999-08-15", "2000-01-26", "2000-10-02", "2001-01-26", "2001-07-04", "2001-07-10", "2001-07-14"]


def quotes(bars: DataFrame) -> DataFrame:
    """The newest bar of each symbol as a live quote; a third gives the percent, a third only the net change."""
    from barloom.functions import bar_windows as b

    n = brand_number(F.col("symbol"))
    rows = bars.select("*", F.lag("c").over(b.series()).alias("prev_close"), b.is_last_bar().alias("is_last"))
    return rows.filter("is_last").select(
        "symbol", F.col("c").alias("ltp"), F.col("o").alias("open"), F.col("h").alias("high"), F.col("l").alias("low"),
        F.col("v").alias("volume"), F.when(n % 6 != 5, F.col("prev_close")).alias("prev_close"),
        F.when(n % 3 == 0, F.lit(1.5) - n % 4).alias("given_pct"),
        F.when(n % 3 != 2, F.col("c") - F.col("prev_close")).alias("net_change"))


# ---- filings and headlines derived from orders ----------------------------------------------------

HEADLINES = [
    "{co} secures order of Rs {amt} crore from {client}, to be executed over {n} months",
    "{co} bags ${n} million contract, total orders this year Rs {amt} crore",
    "Termination of contract worth Rs {amt} crore by {client}",
    "{co} raises revenue guidance for the year",
    "{co} quarterly net profit rises {n}% on strong demand",
    "{co} quarterly profit falls {n}% as margins stay weak",
    "{co} receives show-cause notice with tax demand of Rs {n} lakh",
    "Regulator sends warning letter to {co}",
    "{co} in talks over acquisition valued at Rs {amt} crore",
    "{co} to raise Rs {amt} crore through QIP",
    "CFO of {co} resigns citing personal reasons",
    "Auditor of {co} to resign after the audit",
    "Closure of trading window for {co}",
    "{co} opens new plant with capacity of {n} million tonnes",
    "Creation of pledge on shares of {co}",
    "Release of pledge on {n} lakh shares of {co}",
    "Promoters of {co} bought shares worth Rs {amt} crore",
    "Promoter of {co} sells stake through block deal",
    "{co} announces buyback of Rs {amt} crore",
    "Agency reaffirms credit rating of {co}",
    "{co} declares final dividend",
    "{co} shares rise {n}% in early trade",
    "Brokerage upgrades {co} after results",
    "{co} signs MoU with {client}",
    "Update on the operations of {co}",
    "Exchange sought clarification on price movement in {co}",
    "{co} gets approval from the health ministry",
    "{co} receives purchase order of Rs {amt} crore from {client} to be supplied by FY{yy}",
]
OUTLETS = ["NSE filing", "Reuters", "Mint", "PR Newswire", "Trade Blog", "Economic Times", "Brand#7 Newsroom", "Moneycontrol"]


def _headline_parts() -> dict[str, Column]:
    return {
        "co": F.concat(F.lit("Brand#"), 1 + F.col("o_custkey") % 25),
        "amt": F.format_number(F.floor("o_totalprice"), 0),
        "client": F.element_at(F.array(*[F.lit(x) for x in ("NHAI", "Ministry of Power", "Delta Rail")]),
                               (F.col("o_orderkey") % 3 + 1).cast("int")),
        "n": (6 + F.col("o_orderkey") % 40).cast("string"),
        "yy": F.lpad(((F.year("o_orderdate") + 2) % 100).cast("string"), 2, "0"),
    }


def _headline_sql_parts() -> dict[str, str]:
    return {
        "co": "'Brand#' || (1 + o_custkey % 25)",
        "amt": "format('{:,}', CAST(floor(o_totalprice) AS BIGINT))",
        "client": "['NHAI', 'Ministry of Power', 'Delta Rail'][o_orderkey % 3 + 1]",
        "n": "CAST(6 + o_orderkey % 40 AS VARCHAR)",
        "yy": "lpad(CAST((year(o_orderdate) + 2) % 100 AS VARCHAR), 2, '0')",
    }


def _pieces(template: str) -> list[str]:
    import re

    return [p for p in re.split(r"(\{\w+\})", template) if p]


def headline_column() -> Column:
    parts = _headline_parts()
    kind, chain = F.col("o_orderkey") % len(HEADLINES), F
    for i, template in enumerate(HEADLINES):
        chain = chain.when(kind == i, F.concat(*[parts[p[1:-1]] if p[0] == "{" else F.lit(p) for p in _pieces(template)]))
    return chain.otherwise(F.lit(""))


def headline_sql() -> str:
    parts = _headline_sql_parts()
    whens = " ".join(
        f"WHEN {i} THEN " + " || ".join(parts[p[1:-1]] if p[0] == "{" else "'" + p + "'" for p in _pieces(t))
        for i, t in enumerate(HEADLINES))
    return f"CASE o_orderkey % {len(HEADLINES)} {whens} ELSE '' END"


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One filing or headline per order: the text depends on the order, the company on its customer."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_custkey")
    source = F.element_at(F.array(*[F.lit(x) for x in OUTLETS]), (k % 8 + 1).cast("int"))
    exchange = k % 8 == 0
    head = headline_column()
    return o.select(
        F.col("o_orderkey").alias("item_id"), F.concat(F.lit("Brand#"), 1 + k % 25).alias("company_id"),
        F.timestamp_seconds(F.unix_timestamp("o_orderdate") + (F.col("o_orderkey") % 1440) * 60).alias("ts"),
        F.when(~exchange & (k % 3 == 0), F.concat(head, F.lit(" - "), source)).otherwise(head).alias("title"),
        F.when(exchange, F.concat(F.lit("Reference "), "o_orderpriority")).otherwise("").alias("text"),
        F.when(F.col("o_orderkey") % 5 == 0, "Press Release").otherwise("General").alias("category"),
        source.alias("source"), F.when(exchange, "exchange").otherwise("media").alias("source_type"),
        F.concat(F.lit("Brand#"), 1 + k % 25).alias("company"),
        F.when(k % 25 % 4 != 0, (20000.0 + 1000 * (k % 25)).cast("double")).alias("annual_revenue_cr"),
        F.when(k % 25 % 3 != 0, (500000.0 + 10000 * (k % 25)).cast("double")).alias("market_cap_cr"))


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as news items: title = first sentence, an item every ten minutes, 25 companies."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("item_id"), F.concat(F.lit("Brand#"), 1 + F.col("doc_id") % 25).alias("company_id"),
        F.timestamp_seconds(F.lit(978307200) + F.col("doc_id") * 600).alias("ts"),
        F.regexp_extract("text", r"^[^.\n]*", 0).alias("title"), "text", F.lit("General").alias("category"), "source",
        F.lit("media").alias("source_type"))
