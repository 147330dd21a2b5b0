"""Findings of round 4: titles meet without a row per day, and components end in few rounds; results as before."""

import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import dedup, linking
from barloom.functions import text_events as te


def union_find(ids, pairs):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        if a in up and b in up:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("last", [0, 200_000])
def test_components_of_long_paths_take_few_rounds(spark, monkeypatch, last):
    """A path in random order, one in rising order, a star, loops, ends that are no nodes and a node that comes twice."""
    r = random.Random(4)
    ids = r.sample(range(10 ** 6), 900)
    edges = list(zip(ids[:300], ids[1:301])) + [(ids[400], i) for i in ids[401:500]] + [(i, i + 1) for i in range(2 * 10 ** 6, 2 * 10 ** 6 + 200)]
    edges += [(ids[600], ids[600]), (ids[601], -5), (-5, ids[602])] + [(r.choice(ids[700:]), r.choice(ids[700:])) for _ in range(120)]
    every = ids + list(range(2 * 10 ** 6, 2 * 10 ** 6 + 201))
    staged, stage = [], linking.stage
    monkeypatch.setattr(linking, "LAST_EDGES", last, raising=False)
    monkeypatch.setattr(linking, "stage", lambda df, label="stage": staged.append(label) or stage(df, label))
    nodes = spark.createDataFrame([(i,) for i in every + ids[:2]], "node long")
    rows = linking.connected_components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(rows) == len(every) and {x.node: x.label for x in rows} == union_find(every, edges)
    assert len(staged) <= (3 if last else 40), staged


@pytest.mark.parametrize("stretch", [1, 3, 64])
def test_runs_meet_once_and_lose_nothing(spark, monkeypatch, stretch):
    """Long runs beside short ones, several runs a title, titles with and without entities; met pairs hold all that are similar, each once."""
    r = random.Random(8)
    vocab = ["acme", "beta", "profit", "rises", "falls", "order", "plant", "port", "deal", "rail", "steel", "5"]
    titles = [r.sample(vocab, r.randrange(5, 9)) for _ in range(14)]
    titles = [" ".join(t) for t in titles + [t[:-1] for t in titles] + [t[1:] for t in titles]]
    rows = [(t, float(h)) for t in titles[:6] for h in range(0, 400, 20)] + [(t, r.uniform(0, 400)) for t in titles[6:] for _ in range(r.randrange(1, 5))]
    rows += [(titles[0], None), ("only without a time", None)]
    df = spark.createDataFrame([(i, t, "Mint", h) for i, (t, h) in enumerate(rows)], "item_id long, title string, source string, hours_ago double")
    aliases = spark.createDataFrame([("acme", "A"), ("beta", "B")], "alias string, symbol string")
    monkeypatch.setattr(dedup, "STRETCH", stretch)
    seen, meeting = [], dedup.meeting_runs

    def kept(cards, *args):
        seen.extend([cards, meeting(cards, *args)])
        return seen[-1]

    monkeypatch.setattr(dedup, "meeting_runs", kept)
    links = {x.item_id: x.story for x in dedup.story_links(df, aliases, stop=["the"]).collect()}
    cards, met = seen[0].collect(), [(x.p, x.c, x.a, x.b) for x in seen[1].collect()]
    assert len(met) == len(set(met)) and set(links) == {i for i, (_, h) in enumerate(rows) if h is not None}
    facts = {c.id: c for c in cards}
    vector = {c.id: {v.term: v.weight for v in c.vector} for c in cards}
    near = lambda x, y, w=24.0: y.start - x.end <= w and x.start - y.end <= w
    tone = lambda c: (c.up and not c.down) - (c.down and not c.up)
    want = set()
    for p in cards:
        for c in cards:
            veto = p.entities and c.entities and not set(p.entities) & set(c.entities)
            cosine = sum(w * vector[c.id].get(t, 0.0) for t, w in vector[p.id].items())
            if p.id < c.id and not veto and tone(p) * tone(c) >= 0 and cosine >= 0.55:
                want |= {frozenset((x.node, y.node)) for x in p.runs for y in c.runs if near(x, y)}
    found = {frozenset((a, b)) for _, _, a, b in met}
    assert want <= found and len(want) > 30
    assert all(near(x, y) for p, c, a, b in met for x in facts[p].runs for y in facts[c].runs if (x.node, y.node) == (a, b))
    edges = [(x.a, x.b) for x in dedup.similar_runs(seen[0], seen[1], 0.55).collect()]
    node = {x.item_id: x.node for x in dedup.run_of(*_hours(df)).collect()}
    roots = union_find(sorted(set(node.values())), edges)
    assert links == {i: roots[n] for i, n in node.items()}


def _hours(df):
    keyed = df.select("item_id", "hours_ago", te.headline_title(F.col("title"), F.col("source")).alias("key"))
    return keyed, dedup.title_hours(keyed)
