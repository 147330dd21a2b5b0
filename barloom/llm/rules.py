"""Quality rules as a short-circuit cascade, in DataFrame operations only.

Each rule is a condition under which a document is rejected, over the measures that it needs. On a bounded raw sample the cascade
measures what share of the documents a rule rejects and what it costs, its measures included, and puts the rules with the most
rejections per second first. One CASE expression then tests them in that order: where a rule rejects, neither the later rules nor
their measures are computed. The order changes the work, never the verdict.

``without_rejected`` needs the verdict only and computes no measure that the cascade does not reach; ``quality`` reports five measures
of every document, so these are there already and the cascade saves the others.

Defined cases: null or empty text has no words and fails the base rules; repeated rows get the same verdict each; very long texts are
measured whole; extra columns are kept and cannot clash; an empty table gives no rows and leaves the rules in their order.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from barloom.llm.common import bind, indices, packed, words_of
from barloom.session import stage, unstage

SYMBOLS = r"[#*$%&|<>]"
#: About so many documents are timed to order the rules; only their order depends on it.
SAMPLE_ROWS = 2000


@dataclass(frozen=True)
class Rule:
    """``rejects`` makes the condition from a document's measures, by name (``measures``); it takes what it needs."""

    name: str
    rejects: Callable[[dict[str, Column]], Column]


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that are found twice or more.

    Windows are sorted by (words, place), so equal ones are neighbours; the places of those are sorted again, and each adds the
    words that the place before it has not covered. No window is compared with all others.
    """
    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, i: F.when(i + 1 < F.size(places), F.least(F.lit(3), F.get(places, i + 1) - p)).otherwise(3))
        return F.aggregate(gaps, F.lit(0), lambda total, g: total + g)

    def places(windows: Column) -> Column:
        found = F.transform(windows, lambda x, i: F.when(
            ((i > 0) & (F.get(windows, i - 1)["gram"] == x["gram"])) | (F.get(windows, i + 1)["gram"] == x["gram"]), x["at"]))
        return F.sort_array(F.filter(found, lambda p: p.isNotNull()))

    grams = F.transform(indices(F.size(words) - 2), lambda i: F.concat_ws(
        " ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return bind(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(
        bind(bind(F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("gram"), i.alias("at")))), places), covered)))


REPORTED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measures(text: Column, words: Column) -> dict[str, Column]:
    """The counts of a text (not null) with the given words, as expressions that cost nothing until they are used."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = {
        "n_words": F.size(words),
        "word_chars": F.char_length(F.array_join(words, "")),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)),
        "n_dup_lines": bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": repeated_words(words),
        "n_lines": F.size(F.split(text, "\n")),
        "shouts": F.regexp_count(text, F.lit(r"!!")),
        "capitals": F.regexp_count(text, F.lit(r"[A-Z]")),
    }
    return {k: v.cast("long") for k, v in counts.items()}


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def standard_rules() -> list[Rule]:
    """The base rules, and conditions that ordinary prose does not meet."""
    return [
        Rule("short", lambda m: m["n_words"] < 50),
        Rule("repeats", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
        Rule("symbols", lambda m: 100 * m["n_symbols"] > 30 * m["n_words"]),
        Rule("duplicate lines", lambda m: (m["n_dup_lines"] >= 4) & (100 * m["n_dup_lines"] > 40 * m["n_lines"])),
        Rule("word length", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"])),
        Rule("shouting", lambda m: 100 * m["shouts"] > 30 * m["n_words"]),
        Rule("capitals", lambda m: 2 * m["capitals"] > m["word_chars"]),
    ]


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def cascade(rules: list[Rule], m: dict[str, Column]) -> Column:
    """Whether a document is kept: true where no rule rejects it."""
    verdict = F.when(F.lit(False), False)
    for rule in rules:
        verdict = verdict.when(rule.rejects(m), False)
    return verdict.otherwise(True)


def ordered(sample: DataFrame, rules: list[Rule], repeats: int = 2) -> list[Rule]:
    """The rules by falling rejections per second on ``sample`` (a stored frame with ``text``); ties keep their order.

    A rule is timed alone, with the measures it needs; the time of a job that only reads the texts is taken off.
    """
    rows = sample.count()
    if not rows:
        return rules

    def timed(condition: Column) -> tuple[float, int]:
        best, n = float("inf"), 0
        for _ in range(repeats):
            start = time.perf_counter()
            n = sample.filter(condition).count()
            best = min(best, time.perf_counter() - start)
        return best, n

    reading, _ = timed(F.length(_text()) < 0)
    worth = []
    for rule in rules:
        seconds, rejected = timed(bind(words_of(_text()), lambda w: rule.rejects(measures(_text(), w))))
        worth.append(rejected / rows / max(seconds - reading, reading / 50))
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: (-worth[i], i))]


def ordered_for(docs: DataFrame, rules: list[Rule] | None, sample_rows: int) -> list[Rule]:
    """The rules (or the standard ones) in the order that a sample of about ``sample_rows`` documents gives."""
    share = min(1.0, sample_rows / max(1, docs.count()))
    some = docs.select("text").sample(share, seed=7) if share < 1 else docs.select("text")
    sample = stage(some.repartition(docs.sparkSession.sparkContext.defaultParallelism), "sample")
    out = ordered(sample, standard_rules() if rules is None else rules)
    unstage(sample)
    return out


def quality(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    order = ordered_for(docs, rules, sample_rows)
    reported = bind(words_of(_text()), lambda w: F.struct(*[measures(_text(), w)[c].alias(c) for c in REPORTED]))
    rows = docs.select("doc_id", "text", reported.alias("m")).select("doc_id", "text", "m.*")
    known = {**measures(_text(), words_of(_text())), **{c: F.col(c) for c in REPORTED}}
    return rows.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words"))).select(
        "doc_id", *REPORTED, "base_failed", (~F.col("base_failed") & cascade(order, known)).alias("kept"))


def without_rejected(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that no rule rejects, with all their columns."""
    order = ordered_for(docs, rules, sample_rows)
    row = docs.select(packed(docs).alias("row"), "text")
    return row.filter(bind(words_of(_text()), lambda w: cascade(order, measures(_text(), w)))).select("row.*")
