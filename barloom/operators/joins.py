"""Identity resolution, calendar merge and enrichment joins.

No side is broadcast by hint: company tables are small today, and Spark checks their size itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barloom.functions import fixed_values as fv
from barloom.functions.scalars import number


def strip_marks(company: Column) -> Column:
    """Names without the trailing '-$' mark of one exchange."""
    return F.trim(F.regexp_replace(company, r"[\s-]*\$+\s*$", ""))


def display_name(name: Column) -> Column:
    """All-capitals names in title case; a final dot is dropped."""
    n = F.rtrim(F.trim(name), F.lit("."))
    return F.when((n == F.upper(n)) & (n != F.lower(n)), F.initcap(F.lower(n))).otherwise(n)


def normal_label(label: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), r"\s+", " "))


def sector_index_for(*labels: Column) -> Column:
    """Benchmark index for the first label that is a known macro sector, else by ordered keywords, else null."""
    exact = F.create_map(*[F.lit(x) for pair in fv.SECTOR_INDEX.items() for x in pair])
    direct = [F.try_element_at(exact, normal_label(label)) for label in labels]
    by_word = []
    for label in labels:
        text = F.lower(F.coalesce(label, F.lit("")))
        chain = F
        for index, words in fv.SECTOR_KEYWORDS:
            chain = chain.when(text.rlike("|".join(words)), F.lit(index))
        by_word.append(chain)
    return F.coalesce(*direct, *by_word)


def resolve_meetings(meetings: DataFrame, listings: DataFrame, master: DataFrame) -> DataFrame:
    """Board meetings with ISIN, symbol and fundamentals: by the listing's ISIN, else by exchange code.

    ``listings`` is (bse_code, isin, bse_symbol, nse_symbol); ``master`` has the fundamentals columns.
    A repeated key in ``master`` counts once, the last row (``row_no``) wins.
    """
    fields = [c for c in master.columns if c in fv.FUNDAMENTAL_COLUMNS]
    payload = F.struct("NSE Code", "ISIN Code", *[f"`{c}`" for c in fields])
    by_isin = master.filter(F.col("ISIN Code").isNotNull()).groupBy(F.col("ISIN Code").alias("isin")).agg(
        F.max_by(payload, "row_no").alias("f1"))
    by_code = master.filter(F.col("BSE Code").isNotNull()).groupBy(F.col("BSE Code").alias("bse_code")).agg(
        F.max_by(payload, "row_no").alias("f2"))
    found = (
        meetings.join(listings, "bse_code", "left").join(by_isin, "isin", "left").join(by_code, "bse_code", "left")
        .withColumn("f", F.coalesce("f1", "f2")))
    return found.select(
        *[c for c in meetings.columns],
        F.coalesce("nse_symbol", "f.NSE Code").alias("nse_symbol"),
        "bse_symbol",
        F.coalesce("isin", "f.ISIN Code").alias("isin"),
        F.when(F.col("f").isNull(), "none").otherwise("master").alias("fundamentals_source"),
        *[F.col(f"f.`{c}`").alias(c) for c in fields],
    )


def company_profiles(asked: DataFrame, listings: DataFrame, master: DataFrame) -> DataFrame:
    """Profiles for companies asked by symbol, ISIN or code.

    ISIN comes from the symbol's listing, else from the code's; fundamentals by ISIN, else by symbol; the last
    matching row wins; the exchange's own name is preferred.
    """
    one = lambda key: listings.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"_{key}")).agg(
        F.min_by(F.struct(*listings.columns), "bse_code").alias("l"))
    q = asked.withColumn("symbol", F.upper("symbol"))
    s = one("nse_symbol").select("_nse_symbol", F.col("l.isin").alias("isin_s"))
    c = one("bse_code").select("_bse_code", F.col("l.isin").alias("isin_c"))
    q = q.join(s, q.symbol == s._nse_symbol, "left").join(c, q.bse_code == c._bse_code, "left")
    q = q.withColumn("isin", F.coalesce("isin", "isin_s", "isin_c")).drop("isin_s", "isin_c", "_nse_symbol", "_bse_code")
    li = one("isin").select("_isin", F.col("l.nse_symbol").alias("sym_i"), F.col("l.name").alias("name_i"),
                            F.col("l.bse_code").alias("code_i"))
    q = q.join(li, q.isin == li._isin, "left").withColumn("symbol", F.coalesce("symbol", "sym_i"))
    facts = F.struct("Name", "BSE Code", "Sales latest quarter", "Market Capitalization")
    mi = master.filter("`ISIN Code` is not null").groupBy(F.col("ISIN Code").alias("mi")).agg(
        F.max_by(facts, "row_no").alias("f1"))
    ms = master.filter("`NSE Code` is not null").groupBy(F.upper("NSE Code").alias("ms")).agg(
        F.max_by(facts, "row_no").alias("f2"))
    q = q.join(mi, q.isin == mi.mi, "left").join(ms, q.symbol == ms.ms, "left").withColumn("f", F.coalesce("f1", "f2"))
    sales = number(F.col("f.Sales latest quarter"))
    return q.select(
        "ask_id", "symbol", "isin",
        F.coalesce(display_name(F.col("name_i")), F.col("f.Name")).alias("name"),
        F.when(F.col("name_i").isNotNull(), F.col("f.Name")).alias("short_name"),
        F.coalesce(F.col("bse_code"), F.col("f.BSE Code"), F.col("code_i")).alias("bse_code"),
        F.when(sales != 0, sales * 4).alias("annual_revenue_cr"),
        number(F.col("f.Market Capitalization")).alias("market_cap_cr"),
    )


CALENDAR_FIELDS = ["symbol", "company", "bse_code", "industry"]


def merge_calendars(entries: DataFrame, today: str, days_ahead: int = 30) -> DataFrame:
    """Upcoming results, one row per ISIN: earliest date, blanks filled from the other source, sources listed.

    ``entries`` has isin, source, priority (lower first), result_date and the calendar fields.
    """
    start = F.to_date(F.lit(today))
    open_ = entries.filter(F.col("isin").isNotNull() & F.col("result_date").between(start, F.date_add(start, days_ahead)))
    cleaned = open_.withColumn("company", strip_marks(F.col("company")))

    def first_filled(name: str) -> Column:
        filled = F.col(name).isNotNull() & (F.col(name).cast("string") != "")
        return F.min_by(F.when(filled, F.col(name)), F.when(filled, F.struct("priority", "result_date"))).alias(name)

    return cleaned.groupBy("isin").agg(
        F.min("result_date").alias("result_date"),
        *[first_filled(n) for n in CALENDAR_FIELDS],
        F.transform(F.array_sort(F.collect_set(F.struct("priority", "source"))), lambda s: s["source"]).alias(
            "calendar_sources"),
    )


def with_fundamentals(rows: DataFrame, master: DataFrame) -> DataFrame:
    """Fundamentals by ISIN, the run-rate revenue (4 x the quarter) and where they came from."""
    fields = [c for c in master.columns if c in fv.FUNDAMENTAL_COLUMNS]
    facts = F.struct(*[F.col(f"`{c}`") for c in fields])
    one = master.filter("`ISIN Code` is not null").groupBy(F.col("ISIN Code").alias("isin")).agg(
        F.max_by(facts, "row_no").alias("f"))
    joined = rows.join(one, "isin", "left")
    sales = number(F.col("f.Sales latest quarter"))
    return joined.select(
        *rows.columns,
        *[F.col(f"f.`{c}`").alias(c) for c in fields],
        F.when(F.col("f").isNull(), "none").otherwise("master").alias("fund_source"),
        F.when(sales != 0, sales * 4).alias("annual_revenue_cr"),
        number(F.col("f.Market Capitalization")).alias("market_cap_cr"),
    )


def first_source_wins(primary: DataFrame, secondary: DataFrame, key: str) -> DataFrame:
    """All primary rows, and the secondary ones whose key the primary does not have."""
    return primary.unionByName(secondary.join(primary, key, "left_anti"), allowMissingColumns=True)


def quotes_with_universe(quotes: DataFrame, universe: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """Quotes of known tickers with their listing facts, and the fundamental score where there is one."""
    return quotes.join(universe, "symbol").join(fundamentals, "symbol", "left")

