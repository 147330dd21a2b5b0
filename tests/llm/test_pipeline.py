"""The pipeline against a plain Python version of its stages, and the registered queries against their SQL."""

import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from barloom.llm import registry, rules
from tests.llm.test_operators import WS, brute_components
from tests.llm.test_similar import linked, shingle_set

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    after = {}
    for name, function in corpus_pipeline.STAGES:
        docs = function(spark, docs, FOLDER).cache()
        after[name] = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {r.doc_id for r in rules.quality(spark.read.parquet(f"{FOLDER}/documents.parquet")).filter("kept").collect()}
    assert Counter(r.doc_id for r in after["quality_rules"]) == Counter(kept)
    first = {}
    for i in sorted(kept):
        first.setdefault(re.sub(WS, " ", rows[i].text), i)
    assert sorted(r.doc_id for r in after["exact_dedup"]) == sorted(first.values())
    sets = {i: shingle_set(rows[i].text) for i in first.values()}
    roots = set(brute_components(sorted(sets), lambda a, b: linked(sets[a], sets[b])).values())
    assert {r.doc_id for r in after["near_dedup"]} == roots
    copies = Counter(r.doc_id for r in after["source_mixing"])
    assert set(copies) <= roots and max(copies.values()) <= 2
    words = lambda i: len([w for w in re.split(WS, rows[i].text) if w])
    assert sum(n * words(i) for i, n in copies.items()) == pytest.approx(1.5 * sum(map(words, roots)), rel=0.02)
    packed = after["best_fit_packing"]
    assert Counter(r.doc_id for r in packed if r.piece == 0) == copies
    full = Counter()
    for r in packed:
        full[r.sequence_id] += r.length
    assert max(full.values()) <= 1024
    assert corpus_pipeline.run(spark, FOLDER).count() == len(packed)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = registry.QUERIES[name](spark, FOLDER)
    cur = con.execute(registry.SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(cur.fetchall())


def test_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for name, function in corpus_pipeline.STAGES:
        docs = function(spark, docs, FOLDER)
    assert docs.count() == 0
