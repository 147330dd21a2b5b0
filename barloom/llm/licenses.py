"""License scans with a positional index of rare words, in DataFrame operations only.

A template is a sequence of words with mandatory key phrases. One pass counts in how many documents each licence word stands; the
two key words of a template with the highest inverse document frequency become its postings (word, template, place). A file looks
up the words it holds that are in this index. A posting fixes where the template would have to start; the start stays if the
template's second rare word stands at the same relative place, and the template is found there if all of its key phrases do. As
every found template holds both words, the look-up misses none; frequent licence words are never looked up.

The score of a place is the share of the template's words that stand there; a file has the best of its places.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from barloom.llm.common import bind, lower_ascii, words_of

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """``keys`` are phrases of ``text`` that must all stand at their places; ``base`` templates are counted and located."""

    label: str
    text: str
    keys: tuple[str, ...]
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_places(self) -> list[int]:
        words, places = self.words, set()
        for phrase in self.keys:
            k = phrase.split()
            at = next(i for i in range(len(words)) if words[i:i + len(k)] == k)
            places.update(range(at, at + len(k)))
        return sorted(places)


TEMPLATES = (
    Template("cc-by", "cc by", ("cc by",), base=True),
    Template("gpl", "general public license", ("general public license",), base=True),
    Template("reserved", "all rights reserved", ("all rights reserved",), base=True),
    Template("agpl", "gnu affero general public license", ("affero general public license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             ("redistribution and use in source and binary forms", "without modification")),
    Template("cc-by-nc", "cc by nc", ("cc by nc",)),
    Template("cc-by-nc-nd", "cc by nc nd", ("cc by nc nd",)),
    Template("cc-by-nc-sa", "cc by nc sa", ("cc by nc sa",)),
    Template("cc-by-nd", "cc by nd", ("cc by nd",)),
    Template("cc-by-sa", "cc by sa", ("cc by sa",)),
    Template("gpl-2.0", "gnu general public license version 2", ("general public license version 2",)),
    Template("gpl-3.0", "gnu general public license version 3", ("general public license version 3",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose",
             ("permission to use copy modify", "distribute this software")),
    Template("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software",
             ("permission is hereby granted free of charge", "obtaining a copy")),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             ("unencumbered software", "public domain")),
)


def words_in(text: Column) -> Column:
    return words_of(lower_ascii(text), SEPARATORS)


def idf(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, float]:
    """Inverse document frequency of every licence word over all documents; as many entries as the templates have words."""
    vocabulary = sorted({w for t in templates for w in t.words})
    held = F.array_intersect(words_in(F.col("text")), F.array(*[F.lit(w) for w in vocabulary]))
    counted = docs.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("word")).groupBy("word").count()
    n = {r["word"]: r["count"] for r in counted.collect()}                 # one row per licence word
    return {w: math.log((1 + n.get("", 0)) / (1 + n.get(w, 0))) for w in vocabulary}


@dataclass(frozen=True)
class Posting:
    template: Template
    place: int              # of the rarest key word
    second: int             # of the second rarest, the same for one-word keys


def postings(weights: dict[str, float], templates: tuple[Template, ...] = TEMPLATES) -> list[Posting]:
    out = []
    for t in templates:
        rare = sorted(t.key_places, key=lambda p: (-weights[t.words[p]], p))
        out.append(Posting(t, rare[0], rare[1] if len(rare) > 1 else rare[0]))
    return out


def _starts(words: Column, looked_up: Column, p: Posting) -> Column:
    """Where the template starts, given the places of indexed words.

    Only key words must stand in the text: optional leading words may lie before it, so a start can be negative (``F.get`` is
    null there, which lowers the score only).
    """
    text = p.template.words
    stands = lambda start, j: F.get(words, start + j) == text[j]
    order = [p.place, p.second, *[j for j in p.template.key_places if j not in (p.place, p.second)]]
    found = F.filter(looked_up, lambda at: reduce(lambda a, b: a & b, [stands(at - p.place, j) for j in dict.fromkeys(order)]))
    return F.transform(found, lambda at: at - p.place)


def _score(words: Column, starts: Column, t: Template) -> Column:
    share = lambda s: sum((F.when(F.get(words, s + j) == w, 1).otherwise(0) for j, w in enumerate(t.words)), F.lit(0))
    return F.coalesce(F.array_max(F.transform(starts, share)) / len(t.words), F.lit(0.0))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null text has no words, no labels and score 0; so has every text of an empty table. Very long texts are read whole, repeated rows
    are scanned each, and of equally good places the score takes any. Nothing is shuffled but the counts of licence words.
    """
    index = postings(idf(docs, templates), templates)
    rare = sorted({p.template.words[p.place] for p in index})
    base = [p.template for p in index if p.template.base]
    key = lambda t: t.label.replace("-", "_").replace(".", "_")

    def found(words: Column) -> Column:
        places = F.filter(F.transform(words, lambda w, i: F.when(w.isin(rare), i)), lambda i: i.isNotNull())
        starts = bind(places, lambda at: F.struct(*[_starts(words, at, p).alias(key(p.template)) for p in index]))
        return bind(starts, lambda s: F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.concat(*[s[key(t)] for t in base]).alias("base"),
            *[(F.size(s[key(t)]) > 0).alias(key(t)) for t in templates],
            F.greatest(*[_score(words, s[key(t)], t) for t in templates]).alias("score")))

    named = lambda some: F.array_join(F.array(*[F.when(F.col("f")[key(t)], t.label) for t in sorted(some, key=lambda t: t.label)]), ",")
    return docs.select("doc_id", bind(words_in(F.col("text")), found).alias("f")).select(
        "doc_id", "f.n_words", F.size("f.base").cast("long").alias("n_base"),
        F.array_min("f.base").cast("long").alias("first_word"), F.array_max("f.base").cast("long").alias("last_word"),
        named(base).alias("base_labels"), named(templates).alias("labels"), "f.score")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def scan_sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """The same result for DuckDB: each template's first key word gives its starts, all its words are then compared."""
    rows = ", ".join(f"({_quoted(t.label)}, {str(t.base).lower()}, {j}, {_quoted(w)}, {str(j in t.key_places).lower()})"
                     for t in templates for j, w in enumerate(t.words))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH template(label, base, j, word, is_key) AS (VALUES {rows}),
need AS (SELECT label, count(*) AS n_words, count(*) FILTER (WHERE is_key) AS n_keys, min(j) FILTER (WHERE is_key) AS j0 FROM template GROUP BY label),
head AS (SELECT t.label, t.j, t.word FROM template t JOIN need n ON t.label = n.label AND t.j = n.j0),
text AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM text),
place AS (SELECT w.doc_id, h.label, w.i - h.j AS start FROM words w JOIN head h ON w.word = h.word),
found AS (SELECT p.doc_id, p.label, p.start, any_value(t.base) AS base, count(*) FILTER (WHERE t.is_key) AS keys, count(*) AS n
  FROM place p JOIN template t ON t.label = p.label JOIN words w ON w.doc_id = p.doc_id AND w.i = p.start + t.j AND w.word = t.word
  GROUP BY p.doc_id, p.label, p.start),
hit AS (SELECT f.*, f.n / n.n_words AS share FROM found f JOIN need n ON n.label = f.label AND n.n_keys = f.keys),
total AS (SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word,
    max(start) FILTER (WHERE base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM hit GROUP BY doc_id)
SELECT t.doc_id, len(t.w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM text t LEFT JOIN total USING (doc_id)"""
