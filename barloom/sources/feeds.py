"""Landed files and feeds: listings, delivery, calendars, filings, headlines, fundamentals.

Each parser takes rows as the source wrote them (text columns) and gives typed rows. The readers
at the end scan the landed files; parsing is the same for a file, a table or a stream.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from barloom.functions import fixed_values as fv
from barloom.functions.scalars import blank_to_null, number


def trim_headers(df: DataFrame) -> DataFrame:
    """Trimmed headers and text; columns without a name (a trailing comma in the file) are dropped."""
    kept = [c for c in df.columns if c.strip() and not c.startswith(("_c", "Unnamed"))]
    return df.select(*[F.trim(F.col(f"`{c}`")).alias(c.strip()) for c in kept])


# ---- listings and universe ---------------------------------------------------------------------

def listed_equities(raw: DataFrame) -> DataFrame:
    """Main-board listings from the equity list: two series only."""
    rows = trim_headers(raw).filter(F.col("SERIES").isin(fv.LISTED_SERIES))
    listed = F.col("DATE OF LISTING") if "DATE OF LISTING" in rows.columns else F.lit("")
    return rows.select(
        F.col("SYMBOL").alias("symbol"), F.col("NAME OF COMPANY").alias("name"), F.col("ISIN NUMBER").alias("isin"),
        F.col("SERIES").alias("series"), F.coalesce(listed, F.lit("")).alias("listed"))


def size_buckets(lists: Sequence[tuple[str, DataFrame]], flagship: DataFrame, at_least: int = 700) -> DataFrame:
    """Universe from ordered constituent lists: the first list with a symbol sets its size bucket.

    Fails when fewer than ``at_least`` symbols come out; the check is one count, not a collect.
    """
    ranked = None
    for priority, (bucket, rows) in enumerate(lists):
        part = rows.select(
            F.trim("Symbol").alias("symbol"), F.trim("`Company Name`").alias("name"),
            F.coalesce(F.nullif(F.trim("Industry"), F.lit("")), F.lit("Other")).alias("sector"),
            F.trim("`ISIN Code`").alias("isin"), F.lit(bucket).alias("cap"), F.lit(priority).alias("priority"))
        ranked = part if ranked is None else ranked.unionByName(part)
    facts = F.struct("name", "sector", "cap", "isin")
    chosen = ranked.groupBy("symbol").agg(F.min_by(facts, F.struct("priority", "isin")).alias("f")).select("symbol", "f.*")
    flags = flagship.select(F.trim("Symbol").alias("symbol"), F.lit(True).alias("flagship")).distinct()
    out = chosen.join(flags, "symbol", "left").select(
        "symbol", "name", "sector", "cap", "isin", F.coalesce("flagship", F.lit(False)).alias("flagship"),
        F.concat(F.lit("NSE_EQ|"), "isin").alias("key"))
    n = chosen.agg(F.count("*")).scalar()
    return out.filter(F.when(n >= at_least, F.lit(True)).otherwise(
        F.raise_error(F.format_string("only %d stocks found", n)).cast("boolean")))


def instrument_maps(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(code listings, symbol listings) from the instrument master: cash shares of the two segments."""
    codes = raw.filter((F.col("segment") == "BSE_EQ") & ~F.col("instrument_type").eqNullSafe("F")).select(
        F.col("exchange_token").cast("string").alias("bse_code"), "isin",
        F.col("trading_symbol").alias("bse_symbol"), "name")
    symbols = raw.filter((F.col("segment") == "NSE_EQ") & (F.col("instrument_type") == "EQ")).select(
        "isin", F.col("trading_symbol").alias("nse_symbol"))
    return codes, symbols


def listing_table(raw: DataFrame) -> DataFrame:
    """One listing row per exchange code, with the other exchange's symbol joined by ISIN."""
    codes, symbols = instrument_maps(raw)
    return codes.join(symbols, "isin", "left").select("bse_code", "isin", "bse_symbol", "nse_symbol", "name")


# ---- delivery ---------------------------------------------------------------------------------------

def delivery_day(raw: DataFrame) -> DataFrame:
    """Delivery figures: five series; blank or '-' is null; a row whose other text is no number is dropped."""
    rows = trim_headers(raw).filter(F.col("SERIES").isin(fv.DELIVERY_SERIES))
    value = lambda c: blank_to_null(F.col(c), "-")
    ok = lambda c: value(c).isNull() | value(c).try_cast("double").isNotNull()
    return rows.filter(
        ok("DELIV_QTY") & ok("DELIV_PER") & F.col("TTL_TRD_QNTY").try_cast("double").isNotNull()
    ).select(
        F.col("DATE1").alias("date"), F.col("SYMBOL").alias("symbol"),
        value("DELIV_QTY").try_cast("double").alias("deliv_qty"),
        F.col("TTL_TRD_QNTY").try_cast("double").alias("traded_qty"),
        value("DELIV_PER").try_cast("double").alias("deliv_pct"))


# ---- calendars ---------------------------------------------------------------------------------------

def shape_of(form: str) -> str:
    """A pattern that every text of a date format of numbers and month names fits; a parse that fails costs much more than this look."""
    tokens = (m.group(0) for m in re.finditer(r"'[^']*'|([yMdHms])\1*|.", form))
    return "^" + "".join(r"[^0-9]+" if t.startswith("MMM") else r"[+-]?[0-9]+" if t[0] in "yMdHms" else re.escape(t.strip("'")) for t in tokens) + "$"


def at_format(text: Column, form: str) -> Column:
    """The timestamp of a text in the format, null when it is none; only texts of its shape are parsed."""
    return F.when(text.rlike(shape_of(form)), F.try_to_timestamp(text, F.lit(form)))


def any_date(text: Column, formats: Sequence[str] = fv.MEETING_DATE_FORMATS) -> Column:
    """The first format that fits."""
    return F.coalesce(*[F.to_date(at_format(F.trim(text), f)) for f in formats])


def meeting_columns(columns: Sequence[str], aliases: Mapping[str, Sequence[str]] = fv.MEETING_COLUMNS) -> dict[str, str]:
    """Which column holds what, by case-insensitive aliases in order. Code and date are required."""
    low = {c.strip().lower(): c for c in columns}
    found = {k: next((low[n] for n in names if n in low), None) for k, names in aliases.items()}
    if not found["code"] or not found["date"]:
        raise ValueError(f"a security code and a meeting date column are needed, found {list(columns)}")
    return {k: v for k, v in found.items() if v}


def in_order(raw: DataFrame) -> DataFrame:
    """Rows with their position ``row_no``: the caller's own, else the order of reading (for a landed file, its lines)."""
    return raw if "row_no" in raw.columns else raw.withColumn("row_no", F.monotonically_increasing_id())


def typed_meetings(raw: DataFrame) -> DataFrame:
    rows = in_order(trim_headers(raw))
    at = meeting_columns(rows.columns)
    text = lambda k: F.trim(F.col(f"`{at[k]}`")) if k in at else F.lit("")
    return rows.select(
        number(F.col(f"`{at['code']}`")).cast("long").alias("bse_code"), text("company").alias("company"),
        text("industry").alias("bm_industry"), text("purpose").alias("purpose"),
        any_date(F.col(f"`{at['date']}`")).alias("result_date"), F.col("row_no").cast("long").alias("row_no"))


def parse_board_meetings(raw: DataFrame) -> DataFrame:
    """Meetings with a code and a readable date; of several rows for one (code, date) the first stands."""
    good = typed_meetings(raw).dropna(subset=["bse_code", "result_date"])
    rest = F.struct("company", "bm_industry", "purpose")
    return good.groupBy("bse_code", "result_date").agg(F.min_by(rest, "row_no").alias("r")).select("bse_code", "result_date", "r.*")


def board_meeting_counts(raw: DataFrame) -> DataFrame:
    """One row: rows read, rows without code or date, duplicates."""
    good = F.col("bse_code").isNotNull() & F.col("result_date").isNotNull()
    per_key = typed_meetings(raw).groupBy(
        F.when(good, F.col("bse_code")).alias("k1"), F.when(good, F.col("result_date")).alias("k2")
    ).agg(F.count(F.lit(1)).alias("n"))
    bad = F.col("k1").isNull()
    return per_key.agg(
        F.sum("n").alias("rows_read"),
        F.coalesce(F.sum(F.when(bad, F.col("n"))), F.lit(0)).alias("rows_unparseable"),
        F.coalesce(F.sum(F.when(~bad, F.col("n") - 1)), F.lit(0)).alias("duplicates_removed"))


def is_result_meeting() -> Column:
    return F.lower(F.concat_ws(" ", "bm_purpose", "bm_desc")).contains("result")


def upcoming_results(raw: DataFrame) -> DataFrame:
    """Result meetings of the exchange's feed with a readable date, the first one per (symbol, date)."""
    d = F.to_date(at_format(F.col("bm_date"), "d-MMM-yyyy"))
    rows = in_order(raw).filter(is_result_meeting()).withColumn("result_date", d).filter("result_date is not null")
    facts = F.struct("sm_isin", "sm_name", "sm_indusrty")
    one = rows.groupBy("bm_symbol", "result_date").agg(F.min_by(facts, "row_no").alias("f"))
    return one.select(
        F.col("bm_symbol").alias("symbol"), F.col("f.sm_isin").alias("isin"), F.col("f.sm_name").alias("company"),
        "result_date", F.nullif(F.col("f.sm_indusrty"), F.lit("-")).alias("industry"))


def past_result_dates(raw: DataFrame, today: str, days_back: int = 3 * 365) -> DataFrame:
    """Distinct result dates per symbol, strictly before today and at most ``days_back`` days old."""
    d = F.to_date(at_format(F.col("bm_date"), "d-MMM-yyyy"))
    now = F.to_date(F.lit(today))
    return raw.filter(is_result_meeting()).select(F.col("bm_symbol").alias("symbol"), d.alias("date")).filter(
        (F.col("date") < now) & (F.col("date") >= F.date_sub(now, days_back))).distinct()


# ---- filings and headlines ---------------------------------------------------------------------------

def exchange_instant(local: Column) -> Column:
    """The UTC instant of an exchange-local wall time."""
    return F.to_utc_timestamp(local, "Asia/Kolkata")


def filings_from_symbol_feed(raw: DataFrame) -> DataFrame:
    ts = at_format(F.col("an_dt"), "d-MMM-yyyy HH:mm:ss")
    title = F.coalesce(F.nullif("desc", F.lit("")), F.lit("Announcement"))
    return raw.withColumn("local", ts).filter("local is not null").select(
        "company_id", exchange_instant(F.col("local")).alias("ts"), title.alias("title"),
        F.trim(F.coalesce("attchmntText", F.lit(""))).alias("text"), F.coalesce("desc", F.lit("")).alias("category"),
        F.coalesce("attchmntFile", F.lit("")).alias("url"), F.lit("NSE filing").alias("source"),
        F.lit("exchange").alias("source_type"))


def filings_from_code_feed(raw: DataFrame, attachment_base: str = "") -> DataFrame:
    stamp = F.substring(F.coalesce(F.nullif("NEWS_DT", F.lit("")), "DT_TM"), 1, 19)
    ts = F.coalesce(at_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"), at_format(stamp, "yyyy-MM-dd HH:mm:ss"))
    filled = lambda c: F.nullif(c, F.lit(""))
    return raw.withColumn("local", ts).filter("local is not null").select(
        "company_id", exchange_instant(F.col("local")).alias("ts"),
        F.coalesce(filled("NEWSSUB"), F.lit("Announcement")).alias("title"),
        F.trim(F.coalesce(filled("MORE"), "HEADLINE", F.lit(""))).alias("text"),
        F.coalesce("CATEGORYNAME", F.lit("")).alias("category"),
        F.when(filled("ATTACHMENTNAME").isNotNull(), F.concat(F.lit(attachment_base), "ATTACHMENTNAME"))
        .otherwise("").alias("url"),
        F.lit("BSE filing").alias("source"), F.lit("exchange").alias("source_type"))


def rfc822(text: Column) -> Column:
    """Mail-style dates; the weekday is removed first because the parser refuses weekday text."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    offset = F.regexp_replace(bare, r"\s(GMT|UTC|Z)$", " +0000")
    return F.coalesce(F.try_to_timestamp(offset, F.lit("d MMM yyyy HH:mm:ss Z")),
                      F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss")))


def hours_between(ts: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(ts)) / F.lit(3.6e9)


def rss_headlines(items: DataFrame, default_source: Column, now: Column, limit: int | None = None) -> DataFrame:
    """Headlines from feed items; no readable date means 24 hours ago and ``time_known`` false.

    ``limit`` keeps the first items of each feed in file order (``feed``, ``item_no``), which numbers them from 1.
    """
    rows = items.filter(F.col("item_no") <= limit) if limit else items
    titled = rows.filter(F.trim(F.coalesce("title", F.lit(""))) != "")
    h = hours_between(rfc822(F.col("pubDate")), now)
    return titled.select(
        *[c for c in ("feed", "item_no") if c in items.columns],
        F.trim("title").alias("title"), F.trim(F.coalesce("link", F.lit(""))).alias("link"),
        F.coalesce(F.nullif(F.trim("source"), F.lit("")), default_source).alias("source"),
        F.coalesce(h, F.lit(24.0)).alias("hours_ago"), h.isNotNull().alias("time_known"))


PROVIDER_NEWS = T.StructType([
    T.StructField(n, t) for n, t in (
        ("title", T.StringType()), ("link", T.StringType()), ("publisher", T.StringType()),
        ("providerPublishTime", T.DoubleType()), ("pubDate", T.StringType()),
        ("canonicalUrl", T.StructType([T.StructField("url", T.StringType())])),
        ("clickThroughUrl", T.StructType([T.StructField("url", T.StringType())])),
        ("provider", T.StructType([T.StructField("displayName", T.StringType())])))])
PROVIDER_ENVELOPE = T.StructType([*PROVIDER_NEWS.fields, T.StructField("content", PROVIDER_NEWS)])


def provider_headlines(raw: DataFrame, now: Column, default_source: str = "Yahoo Finance") -> DataFrame:
    """Headlines from a provider's JSON, nested under ``content`` or flat; time is epoch, ISO or mail-style."""
    n = raw.select("item_no", F.from_json("body", PROVIDER_ENVELOPE).alias("n"))
    inner = F.col("n.content")
    nested = inner.isNotNull()
    get = lambda f: F.when(nested, inner[f]).otherwise(F.col(f"n.{f}"))
    filled = lambda c: F.nullif(c, F.lit(""))
    title = F.coalesce(filled(get("title")), filled(F.col("n.title")))
    link = F.coalesce(filled(get("canonicalUrl")["url"]), filled(get("clickThroughUrl")["url"]), filled(get("link")),
                      filled(F.col("n.link")), F.lit(""))
    source = F.coalesce(filled(get("provider")["displayName"]), filled(F.col("n.publisher")), F.lit(default_source))
    text_time = filled(get("pubDate"))
    iso = F.coalesce(
        F.try_to_timestamp(text_time, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")),
        F.try_to_timestamp(text_time, F.lit("yyyy-MM-dd'T'HH:mm:ss")),
        rfc822(text_time))
    epoch = F.when(text_time.isNull() & (F.col("n.providerPublishTime") > 0),
                   F.timestamp_seconds("n.providerPublishTime"))
    h = hours_between(F.coalesce(iso, epoch), now)
    return n.select("item_no", title.alias("title"), link.alias("link"), source.alias("source"),
                    F.coalesce(h, F.lit(24.0)).alias("hours_ago"), h.isNotNull().alias("time_known")) \
        .filter(F.coalesce("title", F.lit("")) != "")


# ---- fundamentals ---------------------------------------------------------------------------------------

FUNDAMENTALS_SCHEMA = T.StructType(
    [T.StructField("Name", T.StringType()), T.StructField("BSE Code", T.StringType()),
     T.StructField("NSE Code", T.StringType()), T.StructField("ISIN Code", T.StringType())]
    + [T.StructField(c, T.StringType() if c.startswith("Industry") else T.DoubleType()) for c in fv.FUNDAMENTAL_COLUMNS])


def typed_master(raw: DataFrame) -> DataFrame:
    """The fundamentals table with a numeric exchange code where the text is one."""
    return raw.withColumn("BSE Code", number(F.col("BSE Code")).cast("long"))


def upsert_fundamentals(master: DataFrame, upload: DataFrame) -> DataFrame:
    """Uploaded rows replace those with their ISIN; the last copy inside the upload wins; no ISIN, no row."""
    new = upload.select(*[c for c in upload.columns if not c.startswith(("Unnamed", "_c"))])
    if "ISIN Code" not in new.columns:
        raise ValueError("an 'ISIN Code' column is needed")
    keyed = new.filter("`ISIN Code` is not null")
    payload = F.struct(*[f"`{c}`" for c in keyed.columns])
    last = keyed.groupBy("ISIN Code").agg(F.max_by(payload, "row_no").alias("p")).select("p.*")
    kept = master.join(last.select("ISIN Code"), "ISIN Code", "left_anti")
    return kept.unionByName(last, allowMissingColumns=True)


def provider_fundamentals(raw: DataFrame) -> DataFrame:
    """Provider quotes in the master's units; of an instrument's two listings the first with a price counts."""
    price = F.coalesce(F.nullif("currentPrice", F.lit(0.0)), F.col("regularMarketPrice"))
    has_price = F.col("currentPrice").isNotNull() | F.col("regularMarketPrice").isNotNull()
    fields = F.struct(
        price.alias("Current Price"), F.col("trailingPE").alias("Price to Earning"),
        F.when(F.col("marketCap") != 0, F.col("marketCap") / 1e7).alias("Market Capitalization"),
        (F.col("debtToEquity") * 0.01).alias("Debt to equity"), (F.col("operatingMargins") * 100).alias("OPM"),
        (F.col("earningsQuarterlyGrowth") * 100).alias("YOY Quarterly profit growth"),
        (F.col("revenueGrowth") * 100).alias("YOY Quarterly sales growth"), F.col("industry").alias("Industry"))
    return raw.filter(has_price).groupBy("symbol").agg(F.min_by(fields, "suffix_no").alias("f")).select("symbol", "f.*")


def fill_from_provider(rows: DataFrame, provider: DataFrame) -> DataFrame:
    """Fundamentals for rows that have none; other rows keep theirs."""
    fields = [c for c in provider.columns if c != "symbol"]
    p = provider.select(F.col("symbol").alias("nse_symbol"), F.struct(*[f"`{c}`" for c in fields]).alias("p"))
    joined = rows.join(p, "nse_symbol", "left")
    use = (F.col("fundamentals_source") == "none") & F.col("p").isNotNull()
    out = []
    for c in rows.columns:
        if c in fields:
            out.append(F.when(use, F.col(f"p.`{c}`")).otherwise(F.col(f"`{c}`")).alias(c))
        elif c == "fundamentals_source":
            out.append(F.when(use, F.lit("provider")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return joined.select(*out)


# ---- readers ------------------------------------------------------------------------------------------------

def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """A landed CSV as text columns; rows may have more or fewer fields than the header."""
    return spark.read.option("header", True).option("mode", "PERMISSIVE").option("inferSchema", False).csv(path)


def read_fundamentals(spark: SparkSession, path: str) -> DataFrame:
    """Fundamentals CSV with its row number inside the file (files are small company tables)."""
    raw = spark.read.option("header", True).schema(FUNDAMENTALS_SCHEMA).csv(path)
    return typed_master(raw).withColumn("row_no", F.monotonically_increasing_id())


def read_instruments(spark: SparkSession, path: str) -> DataFrame:
    schema = "segment string, instrument_type string, exchange_token string, isin string, trading_symbol string, name string"
    return spark.read.schema(schema).option("multiLine", True).json(path)


RSS_ITEM = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "link", "source", "pubDate")])


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """Saved feed files: one row per item, numbered in file order within its feed file."""
    from pyspark.sql import Window

    items = spark.read.format("xml").option("rowTag", "item").schema(RSS_ITEM).load(path).select(
        "*", F.input_file_name().alias("feed"), F.monotonically_increasing_id().alias("_at"))
    return items.select("*", F.row_number().over(Window.partitionBy("feed").orderBy("_at")).alias("item_no")).drop("_at")


def read_bars_json(spark: SparkSession, path: str) -> DataFrame:
    schema = "symbol string, t string, o string, h string, l string, c string, v string, oi string, arrival long"
    return spark.read.schema(schema).json(path)
