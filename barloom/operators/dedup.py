"""Near-duplicate headlines: one story per cluster, the best source in front."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions import event_rules as er
from barloom.functions import text_events as te
from barloom.operators.linking import close_vectors, connected_components, token_set_pairs, unit, with_frequency
from barloom.session import parted, spread, stage

DAY_H = 24.0


# ---- runs: exact copies first -----------------------------------------------------------------------

def title_hours(articles: DataFrame, window_h: float = DAY_H) -> DataFrame:
    """Copies of one title, chained while at most ``window_h`` hours lie between neighbours, as one node: a row per title and hour with copies.

    ``articles``: item_id, key (clean title), hours_ago. All copies of a title tell the same story, so a chain is
    connected, and another title is within the window of some copy exactly if it is within the window of
    the chain's ends or inside it. Hours are grouped before the window, so a title with a third of all rows
    has one row per hour there. Result: key, hour, first, last, n and the chain's node.
    """
    per_hour = articles.groupBy("key", F.floor("hours_ago").alias("hour")).agg(
        F.min("hours_ago").alias("first"), F.max("hours_ago").alias("last"), F.count(F.lit(1)).alias("n"),
        F.min("item_id").alias("least"))
    w = Window.partitionBy("key").orderBy("hour")
    new = F.coalesce(F.col("first") - F.lag("last").over(w) > window_h, F.lit(True))
    numbered = per_hour.select("*", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    return numbered.withColumn("node", F.min("least").over(Window.partitionBy("key", "run"))).drop("least")


def title_runs(hours: DataFrame) -> DataFrame:
    """(key, run, node, start, end, n): the chains of ``title_hours``."""
    return hours.groupBy("key", "run").agg(
        F.min("node").alias("node"), F.min("first").alias("start"), F.max("last").alias("end"), F.sum("n").alias("n"))


def run_of(articles: DataFrame, hours: DataFrame) -> DataFrame:
    """(item_id, node): the chain each article belongs to, found by title and hour."""
    return articles.select("item_id", "key", F.floor("hours_ago").alias("hour")).join(
        hours.select("key", "hour", "node").hint("merge"), ["key", "hour"]).select("item_id", "node")


# ---- title vectors --------------------------------------------------------------------------------------

def title_terms(title: Column, stop: Sequence[str]) -> Column:
    """Words of two letters or more without stop words, and pairs of neighbours among them."""
    words = F.filter(F.regexp_extract_all(F.lower(title), F.lit(r"(?U)\b\w\w+\b"), F.lit(0)), lambda w: ~w.isin(list(stop)))
    pairs = lambda ws: F.transform(F.sequence(F.lit(2), F.size(ws)), lambda i: F.concat_ws(" ", F.get(ws, i - 2), F.get(ws, i - 1)))
    return te.let(words, lambda ws: F.when(F.size(ws) >= 2, F.concat(ws, pairs(ws))).otherwise(ws))


def english_stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def counted(terms: Column) -> Column:
    """array of struct(term, tf): each different term of one title with how often it stands there."""
    times = lambda ts, t: F.struct(t.alias("term"), F.size(F.filter(ts, lambda x: x == t)).cast("long").alias("tf"))
    return te.let(terms, lambda ts: F.transform(F.array_distinct(ts), lambda t: times(ts, t)))


class Corpus(NamedTuple):
    """How often terms stand in the titles that weights are measured on: df is (term, df)."""

    df: DataFrame
    titles: int


def corpus_of(titles: DataFrame, stop: Sequence[str] | None = None) -> Corpus:
    """Term frequencies of (key, n) titles; n copies count as n documents. Stored, to be used for later titles too."""
    terms = titles.select("n", F.explode(F.array_distinct(title_terms(F.col("key"), stop or english_stop_words()))).alias("term"))
    return Corpus(stage(terms.groupBy("term").agg(F.sum("n").alias("df")), "corpus"), titles.agg(F.sum("n")).first()[0] or 0)


def tfidf(titles: DataFrame, stop: Sequence[str] | None = None, corpus: Corpus | None = None, by: str = "key") -> DataFrame:
    """(key, term, df, titles, places, weight): length-one TF-IDF vectors of distinct titles, smooth idf ln((1+n)/(1+df)) + 1.

    ``titles`` is (key, n): n copies count as n documents. With ``corpus`` the weights are those of another set of titles,
    so that they stay as they are while titles come in; a term that is new to it has df 0. ``titles`` and ``places`` of a term are the
    titles it stands in and the sum of their column ``places`` (1 each without that column). A title is named by its column ``by``.
    """
    held = titles.withColumns({"terms": title_terms(F.col("key"), stop or english_stop_words()),
                               "places": F.col("places") if "places" in titles.columns else F.lit(1)})
    tf = stage(held.select(by, "n", "places", F.explode(counted(F.col("terms"))).alias("t")).select(by, "n", "places", "t.*"))
    counts = [F.sum("n").alias("df"), F.count(F.lit(1)).alias("titles"), F.sum("places").alias("places")]
    own = tf.groupBy("term").agg(*counts)
    if corpus is None:
        total = titles.agg(F.sum("n")).scalar()
    else:
        own, total = own.drop("df").join(corpus.df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0))), corpus.titles
    weighed = with_frequency(tf.select(by, "term", "tf"), stage(own, "frequencies"), "term", "df").select(
        by, "term", "df", "titles", "places", (F.col("tf") * (F.ln((1 + total) / (1 + F.col("df"))) + 1)).alias("w"))
    raw = parted(weighed, tf, by)
    # the terms of one title, in the order that later steps need
    of_title = Window.partitionBy(by).orderBy(F.desc("df"), F.desc("term")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return raw.select(by, "term", "df", "titles", "places", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(of_title))).alias("weight"))


NONE = "-"                                                   # in place of an entity: none at all
#: Places of one term that lie in one stretch of time, as far as stretches of a window's length allow.
STRETCH = 64
#: Hours by which a stretch is asked beyond the window, for rounding.
SLACK = 1e-6


def title_cards(vectors: DataFrame, facts: DataFrame, titles: DataFrame, threshold: float) -> DataFrame:
    """One row per title with terms: id, vector (term, weight), lead, runs and the columns of ``title_facts``; stored.

    Terms are taken rare first. If two titles share no term before the point where the rest of one of them is
    shorter than the threshold, their cosine is below it; so only those leading terms can bring titles together. ``tail`` is the length
    from a term on. A term of a single title brings none together.
    """
    rest = Window.partitionBy("id").orderBy(F.desc("df"), F.desc("term")).rowsBetween(Window.unboundedPreceding, 0)
    tails = vectors.withColumn("tail", F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(rest)))
    leads = (F.col("tail") >= threshold - 1e-9) & (F.col("titles") > 1)
    packed = tails.groupBy("id").agg(
        F.collect_list(F.struct("term", "weight")).alias("vector"),
        F.collect_list(F.when(leads, F.struct("term", "tail", "places"))).alias("lead"))
    named = facts.hint("merge").join(titles.select("id", "key", "runs"), "key").drop("key")
    return stage(packed.hint("merge").join(named, "id"), "cards")


def meeting_runs(cards: DataFrame, first: float, last: float, window_h: float, threshold: float) -> DataFrame:
    """(p, c, a, b): different titles p, c that can be similar and runs a, b of theirs within the window; stored.

    Titles meet at a leading term in a stretch of time, one with an entity at each of its entities and, as p, where titles without any are.
    At the rarest term of two titles their cosine is at most the product of the tails there; titles of opposite direction, runs out of the
    window and lower bounds go while rows meet. All of it is lossless. Time is cut where a term has more than ``STRETCH`` runs, into
    stretches of a window at least; a long run lies in many of them, and two runs meet in the first that they share. ``first`` and
    ``last`` hour span all runs. Keys are hashes: equal ones of different terms only add a pair, which is compared like any other.
    """
    has = F.size("entities") > 0
    none = F.array(F.lit(NONE))
    tone = F.when(F.col("up") & ~F.col("down"), 1).when(F.col("down") & ~F.col("up"), -1).otherwise(0).cast("byte")
    wide = F.greatest(F.lit(float(window_h)), (last - first + 1) / F.ceil((F.col("l.places") + 1) / STRETCH))
    cell = lambda at: F.floor((at - first) / F.col("wide"))

    def side(entities: Column, slack: float) -> DataFrame:
        rows = cards.select("id", has.alias("has"), tone.alias("tone"), "runs", entities.alias("entities"), F.explode("lead").alias("l")).select(
            "id", "has", "tone", "runs", F.explode("entities").alias("entity"), "l.term", "l.tail", wide.alias("wide"))
        at = rows.select("id", "has", "tone", F.xxhash64("term", "entity").alias("met"), "tail", "wide", F.explode("runs").alias("r")).select(
            "id", "has", "tone", "met", "tail", "r.node", "r.start", "r.end",
            cell(F.col("r.start") - slack).alias("from"), cell(F.col("r.end") + slack).alias("upto"))
        return at.withColumn("cell", F.explode(F.sequence("from", "upto"))).drop("upto")

    p = side(F.when(has, F.concat("entities", none)).otherwise(none), 0.0).alias("p")
    c = side(F.when(has, F.col("entities")).otherwise(none), window_h + SLACK).alias("c")
    x = lambda name: F.col(f"p.{name}")
    y = lambda name: F.col(f"c.{name}")
    fits = (((x("has") & ~y("has")) | (x("id") < y("id"))) & (x("tone") * y("tone") >= 0) & (x("tail") * y("tail") >= threshold - 1e-9)
            & (y("start") - x("end") <= window_h) & (x("start") - y("end") <= window_h) & (x("cell") == F.greatest(x("from"), y("from"))))
    met = p.hint("merge").join(c.hint("merge"), (x("met") == y("met")) & (x("cell") == y("cell")) & fits)
    return stage(met.select(x("id").alias("p"), y("id").alias("c"), x("node").alias("a"), y("node").alias("b")).distinct(), "met")


def similar_runs(cards: DataFrame, met: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the runs of those met titles whose cosine is at least the threshold and that tell the same story."""
    facts = F.struct("up", "down", "numbers", "words", "entities")
    known = lambda name: cards.select(F.col("id").alias(name), F.map_from_entries("vector").alias(f"{name}_vector"), facts.alias(f"{name}_facts")).hint("merge")
    both = met.select("p", "c").distinct().join(known("p"), "p").join(known("c"), "c")
    dot = F.aggregate(F.map_entries("p_vector"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(
        F.try_element_at(F.col("c_vector"), e["key"]), F.lit(0.0)))
    sims = both.select("p", "c", dot.alias("sim"), "p_facts", "c_facts").filter(F.col("sim") >= threshold)
    judged = sims.filter(same_story(F.col("sim"), "p_facts", "c_facts")).select("p", "c")
    return met.join(judged.hint("merge"), ["p", "c"]).select("a", "b")


# ---- entities and the same-story test ----------------------------------------------------------------------

FEW_ALIASES = 50_000


def entities(titles: DataFrame, aliases: DataFrame) -> DataFrame:
    """(key, entities): symbols whose alias stands in the title as whole words.

    ``aliases`` is (alias, symbol). Runs of title words, up to the length of the longest alias, are joined with the
    aliases' words, then the exact spelling is tested on those few hits. Up to ``FEW_ALIASES`` aliases go to every task; more of them
    are joined by shuffle. The runs are never broadcast: there are many times more of them than the planner expects of the titles.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    known = stage(aliases.select(F.lower("alias").alias("alias"), "symbol", F.concat_ws(" ", words(F.col("alias"))).alias("gram")), "aliases")
    n, longest = known.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(F.split("gram", " "))), F.lit(1))).first()
    w = F.col("w")

    def runs_of(k: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (k - 1))
        joined = F.transform(starts, lambda i: F.concat_ws(" ", F.slice(w, i, k)))
        return F.when(F.size(w) >= k, joined).otherwise(F.array().cast("array<string>"))

    runs = [w] + [runs_of(k) for k in range(2, longest + 1)]
    split = titles.select("key", words(F.col("key")).alias("w"))
    grams = split.select("key", F.explode(F.array_distinct(F.concat(*runs))).alias("gram"))
    hits = grams.join(F.broadcast(known), "gram") if n <= FEW_ALIASES else grams.hint("merge").join(known, "gram")
    quoted = F.concat(F.lit(r"\b\Q"), F.col("alias"), F.lit(r"\E\b"))
    return hits.filter(F.regexp_like(F.lower("key"), quoted)).groupBy("key").agg(F.collect_set("symbol").alias("entities"))


def title_facts(titles: DataFrame, aliases: DataFrame) -> DataFrame:
    """What the same-story test needs of each distinct title."""
    up, down = te.direction_flags(F.col("key"))
    found = entities(titles.select("key"), aliases)
    return titles.select(
        "key", up.alias("up"), down.alias("down"), te.numbers_in(F.col("key")).alias("numbers"),
        te.token_set(F.col("key"), er.TITLE_STOP).alias("words")).join(found, "key", "left").withColumn(
        "entities", F.coalesce("entities", F.array().cast("array<string>")))


def same_story(sim: Column, a: str = "a", b: str = "b") -> Column:
    """Entity veto, direction veto, then similarity alone, with a shared figure, or with shared words and figure.

    ``a`` and ``b`` are struct columns from ``title_facts``.
    """
    x, y = F.col(a), F.col(b)
    other_entity = (F.size(x["entities"]) > 0) & (F.size(y["entities"]) > 0) & ~F.arrays_overlap(x["entities"], y["entities"])
    only_up = lambda s: s["up"] & ~s["down"]
    only_down = lambda s: s["down"] & ~s["up"]
    opposite = (only_up(x) & only_down(y)) | (only_down(x) & only_up(y))
    number = te.share_number(x["numbers"], y["numbers"])
    words = te.jaccard(x["words"], y["words"]) >= er.SAME_STORY_JACCARD
    return ~other_entity & ~opposite & (
        (sim >= er.SAME_STORY_SIM) | ((sim >= er.SAME_STORY_SIM_WITH_NUMBER) & number)
        | ((sim >= er.SAME_STORY_SIM_WITH_WORDS) & words & number))


def _within(a: str, b: str, window_h: float) -> Column:
    return (F.col(f"{b}.start") - F.col(f"{a}.end") <= window_h) & (F.col(f"{a}.start") - F.col(f"{b}.end") <= window_h)


# ---- clusters -------------------------------------------------------------------------------------------------

def story_links(articles: DataFrame, aliases: DataFrame, window_h: float = DAY_H, stop: Sequence[str] | None = None,
                vectors: DataFrame | None = None, corpus: Corpus | None = None) -> DataFrame:
    """(item_id, story): articles of one story share the smallest node id.

    ``articles``: item_id, title, source, hours_ago. With ``vectors`` (item_id, vec) the similarity is theirs,
    otherwise it is TF-IDF over the titles (or weighted by ``corpus``). With vectors, equal titles count as equal vectors.
    """
    keyed = stage(articles.select("item_id", "hours_ago", te.headline_title(F.col("title"), F.col("source")).alias("key")))
    hours = stage(title_hours(keyed, window_h), "hours")
    runs = stage(title_runs(hours))
    placed = F.filter(F.collect_list(F.struct("node", "start", "end")), lambda r: r["start"].isNotNull())
    grouped = runs.groupBy("key").agg(F.sum("n").alias("n"), placed.alias("runs"))
    titles = spread(stage(grouped.select(F.monotonically_increasing_id().alias("id"), "key", "n", F.size("runs").alias("places"), "runs"), "titles"))
    facts = stage(title_facts(titles, aliases))

    if vectors is None:
        threshold = er.SAME_STORY_SIM_WITH_WORDS
        first, last = runs.agg(F.coalesce(F.min("start"), F.lit(0.0)), F.coalesce(F.max("end"), F.lit(0.0))).first()
        cards = title_cards(tfidf(titles, stop, corpus, "id"), facts, titles, threshold)
        edges = similar_runs(cards, meeting_runs(cards, first, last, window_h, threshold), threshold)
    else:
        one = keyed.join(vectors, "item_id").groupBy("key").agg(F.min_by("vec", "item_id").alias("vec"))
        pairs = vector_pairs(runs, one, facts, window_h)
        node = F.struct("node", "start", "end")
        at = lambda name: runs.select(F.col("key").alias(name), node.alias(f"{name}_run"))
        known = lambda name: facts.select(F.col("key").alias(name), F.struct(*[c for c in facts.columns if c != "key"]).alias(f"{name}_facts"))
        judged = pairs.join(known("p").hint("merge"), "p").join(known("c").hint("merge"), "c").filter(same_story(F.col("sim"), "p_facts", "c_facts")).select("p", "c")
        edges = judged.join(at("p").hint("merge"), "p").join(at("c").hint("merge"), "c").filter(_within("p_run", "c_run", window_h)).select(
            F.col("p_run.node").alias("a"), F.col("c_run.node").alias("b"))
    stories = connected_components(runs.select("node"), edges)
    return run_of(keyed, hours).join(stories, "node").select("item_id", F.col("label").alias("story"))


def vector_pairs(runs: DataFrame, vectors: DataFrame, facts: DataFrame, window_h: float = DAY_H) -> DataFrame:
    """(p, c, sim) of titles that can pass the same-story test on vectors.

    A similarity of 0.74 or more comes from matrix blocks; below that the test also needs 40 % common words, so
    those pairs come from the word sets.
    """
    units = vectors.select("key", unit(F.col("vec")).alias("vec"))
    placed = runs.select("key", "node", F.explode(F.sequence(F.floor("start"), F.floor("end"))).alias("hour")).join(units, "key")
    named = runs.select("node", "key").distinct()
    close = close_vectors(placed.select("node", F.col("hour").cast("double").alias("hours"), "vec"),
                          er.SAME_STORY_SIM_WITH_NUMBER, window_h + 1)
    near = close.select("a", "b").distinct().join(named.select(F.col("node").alias("a"), F.col("key").alias("k1")), "a").join(
        named.select(F.col("node").alias("b"), F.col("key").alias("k2")), "b").select(
        F.least("k1", "k2").alias("p"), F.greatest("k1", "k2").alias("c"))
    sets = facts.filter(F.size("words") > 0).select(F.concat_ws(" ", F.array_sort("words")).alias("sig"), "key", "words")
    distinct_sets = sets.groupBy("sig").agg(F.first("words").alias("tokens"))
    days = lambda lo, hi: F.explode(F.sequence(F.floor(lo / window_h), F.floor(hi / window_h)))
    where = lambda lo, hi, role: runs.select("key", days(lo, hi).alias("day")).join(sets, "key").select(
        "day", "sig", F.lit(role).alias("role")).distinct()
    start, end = F.col("start"), F.col("end")
    worded = token_set_pairs(where(start, end, "p").unionByName(where(start - window_h, end + window_h, "c")), distinct_sets,
                             ["day"], er.SAME_STORY_JACCARD).select("p_sig", "c_sig").distinct()
    s = sets.select("sig", "key")
    by_words = worded.join(s.select(F.col("sig").alias("p_sig"), F.col("key").alias("k1")), "p_sig").join(
        s.select(F.col("sig").alias("c_sig"), F.col("key").alias("k2")), "c_sig").select(
        F.least("k1", "k2").alias("p"), F.greatest("k1", "k2").alias("c"))
    equal = s.select("sig", F.col("key").alias("p")).join(s.select("sig", F.col("key").alias("c")), "sig").filter("p < c").select("p", "c")
    pairs = near.unionByName(by_words).unionByName(equal).filter("p < c").distinct()
    dot = F.aggregate(F.zip_with("v1", "v2", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return pairs.join(units.select(F.col("key").alias("p"), F.col("vec").alias("v1")), "p").join(
        units.select(F.col("key").alias("c"), F.col("vec").alias("v2")), "c").select("p", "c", dot.alias("sim"))


def representatives(articles: DataFrame, links: DataFrame) -> DataFrame:
    """One article per story: best source tier, then newest; the other sources are listed, sorted."""
    rank = F.struct(-te.source_tier(F.col("source")), F.col("hours_ago"), F.col("item_id"))
    row = F.struct(*articles.columns)
    named = F.when(F.coalesce("source", F.lit("")) != "", F.col("source"))
    grouped = articles.join(links, "item_id").groupBy("story").agg(
        F.min_by(row, rank).alias("r"), F.collect_set(named).alias("sources"), F.count(F.lit(1)).alias("copies"))
    return grouped.select(
        "story", "r.*", "copies",
        F.array_sort(F.array_except("sources", F.array(F.col("r.source")))).alias("related_sources"))


def dedupe_articles(articles: DataFrame, aliases: DataFrame, window_h: float = DAY_H, stop: Sequence[str] | None = None,
                    vectors: DataFrame | None = None) -> DataFrame:
    return representatives(articles, story_links(articles, aliases, window_h, stop, vectors))
