"""The pipeline's near-dedup stage against brute force over five-word shingles."""

import random
import re

import corpus_pipeline
from pyspark.sql import functions as F

from barloom.llm import similar
from tests.llm.test_operators import WS, brute_components

SCHEMA = "doc_id long, text string, source string"


def shingle_set(text):
    words = [w for w in re.split(WS, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    return {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def linked(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9


def edited(r, words, edits):
    out = list(words)
    for _ in range(edits):
        out[r.randrange(len(out))] = f"new{r.randrange(10 ** 6)}"
    return " ".join(out)


def test_near_dedup_stage_links_by_jaccard(spark):
    """Copies around the bound, on both sides of it, and one dense group; 2 to 4 edits of 150 words change 10 to 20 of 146 shingles."""
    r = random.Random(11)
    rows = [None, "", " \n", "one two", "One  Two", "one two three"]
    for _ in range(25):
        words = [f"w{r.randrange(5000)}" for _ in range(150)]
        rows += [" ".join(words), edited(r, words, r.randint(1, 5)), edited(r, words, r.randint(2, 4))]
    words = [f"w{r.randrange(5000)}" for _ in range(150)]
    rows += [edited(r, words, r.randint(0, 3)) for _ in range(90)]
    r.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(rows)] + [(3, rows[3], "s")], SCHEMA).repartition(3)
    sets = {i: shingle_set(t) for i, t in enumerate(rows)}
    root = brute_components(sorted(sets), lambda a, b: linked(sets[a], sets[b]))
    stay = corpus_pipeline.near_dedup(spark, docs, "")
    assert stay.columns == docs.columns
    assert sorted(x.doc_id for x in stay.collect()) == sorted(set(root.values()))
    got = {x.doc_id: x.component_id for x in similar.similar_copies(docs).collect()}
    assert got == root
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_unlike_members_of_common_passages(spark):
    """Texts that share a passage but not enough of it meet in no pair; pairs of 0.8 among them are found, with and without centres."""
    r = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join(passage + [f"w{r.randrange(10 ** 6)}" for _ in range(r.randint(20, 40))]) for _ in range(120)]
    texts += [edited(r, t.split(), r.randint(0, 2)) for t in texts[:60]]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    sets = {i: shingle_set(t) for i, t in enumerate(texts)}
    same = similar.shingle_sets(docs)
    nodes = {x.node: set(x.shingles) for x in same.collect()}
    left = same.select("node", F.size("shingles").cast("long").alias("size"), F.col("node").alias("root"))
    pivots = [x.node for x in same.orderBy("node").limit(5).collect()]
    found = {(x.a, x.b) for x in similar.across(left, same, pivots).collect()}
    want = {(a, b) for a in nodes for b in nodes if a < b and 5 * len(nodes[a] & nodes[b]) >= 4 * len(nodes[a] | nodes[b])}
    assert want <= found and len(found) < 2 * len(want) + 20 and len(want) > 20
    root = brute_components(sorted(sets), lambda a, b: linked(sets[a], sets[b]))
    assert {x.doc_id: x.component_id for x in similar.similar_copies(docs).collect()} == root


def test_pairs_pass_pivot_tables_of_fingerprints(spark):
    """Pairs at 0.8 are within the radius of their wide SimHash; unlike pairs are discarded before the exact comparison; tiny sets never are."""
    r = random.Random(19)
    texts = []
    for _ in range(60):
        words = [f"w{r.randrange(10 ** 6)}" for _ in range(r.randint(60, 200))]
        texts += [" ".join(words), edited(r, words, r.randint(1, 3))]
    texts += ["one two three four five six", "one two three four five six seven"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], SCHEMA)
    rows = {x.doc_id: x for x in similar.sketches(docs).collect()}
    sets = {i: shingle_set(t) for i, t in enumerate(texts)}
    nodes = spark.createDataFrame([(x.node, x.size, x.fp) for x in rows.values()], "node long, size long, fp array<long>")
    table = similar.pivot_table(nodes, [rows[0].node, rows[5].node])
    pairs = {tuple(sorted((rows[i].node, rows[j].node))): (i, j) for i in rows for j in rows if i < j}
    kept = {pairs[x.a, x.b] for x in similar.not_discarded(spark.createDataFrame(list(pairs), "a long, b long"), table).collect()}
    want = {p for p in pairs.values() if linked(sets[p[0]], sets[p[1]])}
    assert want <= kept and len(want) > 30
    assert all(min(len(sets[i]), len(sets[j])) < similar.TINY for i, j in kept if not sets[i] & sets[j])


def test_outer_members_meet_the_middle_of_a_dense_group(spark, monkeypatch):
    """Members at the edge of a dense group are joined by single comparisons; the search that follows does not pair them with the whole group."""
    r = random.Random(23)
    words = [f"w{r.randrange(10 ** 6)}" for _ in range(150)]
    texts = [edited(r, words, r.randint(0, 3)) for _ in range(300)] + [edited(r, words, r.randint(4, 7)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    met = []
    across = similar.across

    def counted(*args):
        out = across(*args)
        met.append(out.count())
        return out

    monkeypatch.setattr(similar, "across", counted)
    sets = {i: shingle_set(t) for i, t in enumerate(texts)}
    root = brute_components(sorted(sets), lambda a, b: linked(sets[a], sets[b]))
    assert {x.doc_id: x.component_id for x in similar.similar_copies(docs).collect()} == root
    assert met[0] < 2 * len(texts), met


def test_pairs_without_a_common_key_are_found(spark, monkeypatch):
    """The search covers all documents: with keys that never meet and fingerprints that discard everything no link is lost."""
    r = random.Random(31)
    texts = []
    for _ in range(40):
        words = [f"w{r.randrange(10 ** 6)}" for _ in range(r.choice([4, 9, 30, 150]))]
        texts += [" ".join(words), edited(r, words, r.randint(1, 3)), " ".join(words + ["more"])]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    sets = {i: shingle_set(t) for i, t in enumerate(texts)}
    root = brute_components(sorted(sets), lambda a, b: linked(sets[a], sets[b]))
    assert len(set(root.values())) < len(texts) - 20
    monkeypatch.setattr(similar, "not_discarded", lambda pairs, table: pairs.limit(0))
    assert {x.doc_id: x.component_id for x in similar.similar_copies(docs).collect()} == root
    keys = similar.band_keys
    monkeypatch.setattr(similar, "band_keys", lambda hashes: [k ^ hash(hashes.tobytes()) for k in keys(hashes)])
    assert {x.doc_id: x.component_id for x in similar.similar_copies(docs).collect()} == root
