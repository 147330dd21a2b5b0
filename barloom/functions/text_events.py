"""Column expressions that read a filing or headline: type, tone, amounts, order facts, reliability."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, functions as F

from barloom.functions import event_rules as er
from barloom.functions import fixed_values as fv
from barloom.functions.literals import folded, may_match

ANY_CASE = "(?iU)"


def search(text: Column, pattern: str) -> Column:
    return text.rlike(ANY_CASE + pattern)


def found(text: Column, pattern: str, group: int = 0, any_case: bool = True) -> Column:
    """The first hit (or one of its groups), null when there is none."""
    return F.nullif(F.regexp_extract(text, (ANY_CASE if any_case else "(?U)") + pattern, group), F.lit(""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it stands in there (a branch of ``when`` shares nothing by itself)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def rule_number(text: Column, fold: Column | None = None, rules: Sequence = er.RULES) -> Column:
    """Index of the first rule with a matching pattern, -1 when none matches; ``fold`` is ``folded(text)`` if it is there already.

    Rules are tried in order and the rest is not evaluated once one matches. A pattern is tried only on texts that hold a word it needs.
    """
    chain, fold = F, folded(text) if fold is None else fold
    for i, rule in enumerate(rules):
        hit = F.lit(False)
        for pattern in rule[4]:
            hit = hit | (may_match(fold, pattern) & search(text, pattern))
        chain = chain.when(hit, F.lit(i))
    return chain.otherwise(F.lit(-1))


def of_rule(number: Column, position: int, rules: Sequence = er.RULES) -> Column:
    values = F.array(*[F.lit(r[position]) for r in rules], F.lit(er.OTHER[position]))
    return F.element_at(values, F.when(number < 0, F.lit(len(rules) + 1)).otherwise(number + 1))


def matched_text(text: Column, fold: Column, number: Column, rules: Sequence = er.RULES) -> Column:
    """What the deciding pattern hit: the first pattern of the rule, in order, that matches."""
    chain = F
    for i, rule in enumerate(rules):
        chain = chain.when(number == i, F.coalesce(*[F.when(may_match(fold, p), found(text, p)) for p in rule[4]], F.lit("")))
    return chain.otherwise(F.lit(""))


def tone(text: Column) -> Column:
    """+1, 0 or -1 by counting rising against falling whole words."""
    up = F.regexp_count(text, F.lit(ANY_CASE + er.POSITIVE))
    down = F.regexp_count(text, F.lit(ANY_CASE + er.NEGATIVE))
    return F.signum((up - down).cast("double")).cast("int")


def strip_publisher(title: Column, source: Column) -> Column:
    """Title without ' - source' at its end, else without a short trailing segment."""
    t, s = F.coalesce(title, F.lit("")), F.trim(F.coalesce(source, F.lit("")))
    suffix = F.concat(F.lit(" - "), s)
    return F.when((s != "") & F.endswith(t, suffix), F.left(t, F.length(t) - F.length(suffix))).otherwise(
        F.regexp_replace(t, r"\s+[-|–—]\s+[^-|–—]{2,40}$", ""))


def headline_title(title: Column, source: Column) -> Column:
    """Title for de-duplication: entities decoded, publisher or any last segment removed."""
    t = F.coalesce(title, F.lit(""))
    for entity, char in (("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    suffix = F.concat(F.lit(" - "), source)
    exact = (F.coalesce(source, F.lit("")) != "") & F.endswith(t, suffix)
    return F.trim(F.when(exact, F.left(t, F.length(t) - F.length(suffix))).otherwise(
        F.regexp_replace(t, r"\s*[-|–—]\s*[^-|–—]+$", "")))


# ---- amounts ---------------------------------------------------------------------------------------

#: Marks around a hit and between its fields; the same control characters inside a text are read as another one, which is no word either.
HIT, FIELD, OTHER_CONTROL = "\x01", "\x02", "\x03"
#: A hit begins with a currency, a space or a digit; other places are passed over by one look.
AMOUNT_START = r"(?=[₹$€riue\s\d])"


def amount_pieces(text: Column) -> Column:
    """The text cut at its amounts, by one pass of the pattern: what is between them, and at odd places their currency, number, unit and whole."""
    plain = F.translate(text, HIT + FIELD, OTHER_CONTROL * 2)
    marked = F.regexp_replace(plain, ANY_CASE + AMOUNT_START + er.AMOUNT, f"{HIT}$1{FIELD}$2{FIELD}$3{FIELD}$0{HIT}")
    return F.split(marked, HIT, -1)


def hits_of(pieces: Column) -> Column:
    fields = lambda f: F.struct(*[F.get(f, F.lit(i)).alias(n) for i, n in enumerate(("cur", "num", "unit", "whole"))])
    return F.transform(F.filter(pieces, lambda p, i: i % 2 == 1), lambda p: let(F.split(p, FIELD, -1), fields))


def amount_hits(text: Column) -> Column:
    """array of struct(cur, num, unit, whole) for every number in the text that is no count of goods or people."""
    return hits_of(amount_pieces(text))


def in_crore(hit: Column, allow_bare: Column | None = None) -> Column:
    """The amount in crore; null for a plain number. A bare number needs a currency and at least 1000."""
    facts = F.struct(F.lower(hit["cur"]).alias("cur"), F.lower(hit["unit"]).alias("unit"), F.replace(hit["num"], F.lit(","), F.lit("")).cast("double").alias("v"))
    return let(facts, lambda f: _in_crore(f["cur"], f["unit"], f["v"], allow_bare))


def _in_crore(cur: Column, unit: Column, v: Column, allow_bare: Column | None) -> Column:
    rate = F.when(cur.isin("usd", "us$", "$"), F.lit(fv.USD_RATE)).when(cur.isin("eur", "€"), F.lit(fv.EUR_RATE)).otherwise(F.lit(1.0))
    scale = (
        F.when(unit.isin("lakh crore", "lakh cr"), 1e5).when(unit == "thousand crore", 1e3)
        .when(unit.startswith("cr"), 1.0).when(unit.startswith("lakh") | unit.startswith("lac"), 0.01)
        .when(unit.isin("billion", "bn"), 100.0).when(unit.isin("million", "mn", "mln"), 0.1))
    sized = F.round(v * scale * rate, 2)
    if allow_bare is None:
        return F.when(unit != "", sized)
    bare = F.when((cur != "") & (v >= 1000) & allow_bare, F.round(v / 1e7 * rate, 6))
    return F.when(unit != "", sized).otherwise(bare)


def amounts_in_crore(text: Column, allow_bare: Column | None = None) -> Column:
    return F.filter(F.transform(amount_hits(text), lambda h: in_crore(h, allow_bare)), lambda v: v.isNotNull())


def order_value(text: Column) -> Column:
    """The order's own value: the first amount not led in by a running-total phrase, else the first amount.

    One fold over the hits carries the last 45 characters before each of them.
    """
    start = F.struct(F.lit("").alias("tail"), F.lit(None).cast("double").alias("own"), F.lit(None).cast("double").alias("any"))

    def take(s: Column, before: Column, value: Column, w: Column) -> Column:
        return F.struct(
            F.right(F.concat(before, w), F.lit(45)).alias("tail"),
            F.coalesce(s["own"], F.when(~search(before, er.RUNNING_TOTAL), value)).alias("own"),
            F.coalesce(s["any"], value).alias("any"))

    def step(s: Column, x: Column) -> Column:
        now = F.struct(F.right(F.concat(s["tail"], x["g"]), F.lit(45)).alias("before"), in_crore(x["h"]).alias("value"))
        return let(now, lambda n: take(s, n["before"], n["value"], x["h"]["whole"]))

    def fold(pieces: Column) -> Column:
        hits, gaps = hits_of(pieces), F.filter(pieces, lambda p, i: i % 2 == 0)
        steps = F.arrays_zip(hits.alias("h"), F.slice(gaps, F.lit(1), F.size(gaps) - 1).alias("g"))
        return F.aggregate(steps, start, step, lambda s: F.coalesce(s["own"], s["any"]))

    return let(amount_pieces(text), fold)


def execution_months(text: Column, ref_local: Column) -> Column:
    """Months to carry out an order: a stated period of half a month to 15 years, else a stated fiscal year."""
    part = lambda pattern, group: F.regexp_extract(text, ANY_CASE + pattern, group)

    def stated(p: Column) -> Column:
        n, u = p["n"], p["u"]
        months = F.when(u.startswith("y"), n * 12).when(u.startswith("d"), n / 30).when(u.startswith("w"), n / 4.3).otherwise(n)
        return let(months, lambda m: F.when((m >= 0.5) & (m <= 180), F.round(m, 1)))

    def until(y: Column) -> Column:
        year = y.try_cast("int") + F.when(F.length(y) == 2, 2000).otherwise(0)
        return let((year - F.year(ref_local)) * 12 + (3 - F.month(ref_local)), lambda m: F.when(m.between(1, 180), m.cast("double")))

    period = F.struct(part(er.PERIOD, 1).try_cast("double").alias("n"), F.lower(part(er.PERIOD, 2)).alias("u"))
    return F.coalesce(let(period, stated), let(F.concat(part(er.BY_YEAR, 1), part(er.BY_YEAR, 2)), until))


def client_name(text: Column) -> Column:
    """The first capitalised run after from/by/with that is a name."""
    strip = lambda c: F.btrim(c, F.lit(" .,-"))
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: ~w.isin(*er.CLIENT_CONNECTORS) & (w != ""))
    runs = F.transform(F.regexp_extract_all(text, F.lit("(?U)" + er.CLIENT_CASE_SENSITIVE), F.lit(1)), strip)
    named = lambda w: (F.size(w) > 0) & ~F.get(w, F.lit(0)).isin(*er.CLIENT_STOP)
    names = F.filter(runs, lambda c: (F.length(c) >= 3) & let(words(c), named))
    return F.regexp_replace(F.get(names, F.lit(0)), r"(\s+(of|and|for))+$", "")


# ---- reliability and tokens -------------------------------------------------------------------------

def reliability(source_type: Column, source: Column, title: Column, company: Column) -> tuple[Column, Column]:
    """(score 0..1, label): exchange filings are certain, rumour wording caps everything else."""
    src = F.trim(F.lower(F.coalesce(source, F.lit(""))))
    name = F.get(F.split(F.trim(F.lower(F.coalesce(company, F.lit("")))), r"\s+"), F.lit(0))
    own = (F.length(name) > 3) & src.contains(name)
    head = F.coalesce(title, F.lit(""))
    stated = src.isin(*er.WIRES) | own | F.lower(head).contains("press release")
    exchange = F.coalesce(source_type == "exchange", F.lit(False))
    rumour = search(head, er.RUMOUR)
    base = F.when(stated, 0.85).when(src.isin(*er.TIER_ONE), 0.70).otherwise(0.50)
    label = F.when(stated, "Company statement").when(src.isin(*er.TIER_ONE), "Reputable media").otherwise("Media")
    return (F.when(exchange, F.lit(1.0)).when(rumour, F.least(base, F.lit(0.30))).otherwise(base),
            F.when(exchange, "Exchange filing").when(rumour, "Unverified report").otherwise(label))


def token_set(text: Column, stop: Sequence[str]) -> Column:
    """Distinct lower-case runs of letters and digits, without stop words."""
    tokens = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+")
    return F.array_except(tokens, F.array(*[F.lit(s) for s in ("", *stop)]))


def long_text_words(text: Column, stop: Sequence[str]) -> Column:
    """``token_set`` for whole documents, in any order: bytes that are no letter or digit become blanks, and the rest is split there."""
    kept = b"abcdefghijklmnopqrstuvwxyz0123456789"
    plain = bytes(b if b in kept else 32 for b in range(256))
    without = set(stop)

    @F.pandas_udf("string")
    def words(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: " ".join({*t.lower().encode().translate(plain).decode("ascii").split()} - without))

    joined = words(F.coalesce(text, F.lit("")))
    return F.filter(F.split(joined, " "), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def numbers_in(text: Column) -> Column:
    raw = F.regexp_extract_all(text, F.lit(r"\d[\d,]*\.?\d*"), F.lit(0))
    return F.filter(F.transform(raw, lambda x: F.regexp_replace(x, ",", "").try_cast("double")), lambda v: v.isNotNull())


def share_number(a: Column, b: Column, tolerance: float = er.NUMBER_TOLERANCE) -> Column:
    """True when a figure of one is within 3 % of a figure of the other, or when either has none."""
    near = lambda x, y: F.abs(x - y) <= tolerance * F.greatest(F.abs(x), F.abs(y), F.lit(1.0))
    return (F.size(a) == 0) | (F.size(b) == 0) | F.exists(a, lambda x: F.exists(b, lambda y: near(x, y)))


def direction_flags(title: Column) -> tuple[Column, Column]:
    words = F.regexp_extract_all(F.lower(title), F.lit("[a-z]+"), F.lit(0))
    has = lambda lst: F.arrays_overlap(words, F.array(*[F.lit(w) for w in lst]))
    return has(er.UP_WORDS), has(er.DOWN_WORDS)


def source_tier(source: Column) -> Column:
    tiers = F.create_map(*[F.lit(x) for pair in er.SOURCE_TIERS.items() for x in pair])
    known = F.coalesce(F.try_element_at(tiers, F.trim(F.lower(source))), F.lit(1))
    return F.when(F.coalesce(source, F.lit("")) == "", 0).otherwise(known)
