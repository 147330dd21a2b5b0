"""Small tests for the faults found in round 3."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barloom.functions import event_rules as er
from barloom.functions import text_events as te
from barloom.operators import dedup, events, linking


@pytest.mark.parametrize("few", [0, 1000])
def test_title_runs_are_never_broadcast(spark, tmp_path, monkeypatch, few):
    """The planner takes a local list of aliases for endless and the titles for small; it must not send all their runs to the driver."""
    monkeypatch.setattr(dedup, "FEW_ALIASES", few, raising=False)
    rng = random.Random(3)
    keys = [f"{rng.choice(['Acme', 'Big Mill', 'Other'])} of {rng.choice(['north', 'big', 'mill', 'big mill'])} item {i}" for i in range(200)]
    spark.createDataFrame([(k,) for k in keys], "key string").write.parquet(str(tmp_path / "t"))
    aliases = spark.createDataFrame([("acme", "A"), ("Big Mill", "B"), ("big", "C")], "alias string, symbol string")
    found = dedup.entities(spark.read.parquet(str(tmp_path / "t")), aliases)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and ("BuildRight" in plan) == (few > 0)
    want = {k: {s for a, s in (("acme", "A"), ("big mill", "B"), ("big", "C")) if f" {a} " in f" {k.lower()} "} for k in keys}
    assert {r["key"]: set(r["entities"]) for r in found.collect()} == {k: v for k, v in want.items() if v}


def repeat_rows(seed: int, n: int = 400):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(14)]
    return [(i, "HOT" if rnd.random() < 0.6 else "C", rnd.choice(["earnings", "order_win", "other", "routine"]),
             dt.datetime.fromtimestamp(1_700_000_000 + rnd.choice([rnd.randrange(40 * 86400), 86400 * rnd.randrange(40)]), dt.timezone.utc),
             rnd.choice([None, None, 0.0, 100.0, 102.0, 105.5, 97.1, 300.0, 301.0]), rnd.sample(words, rnd.randrange(0, 6))) for i in range(n)]


REPEAT_ITEM = "item_id long, company_id string, event_type string, ts timestamp, amount double, tokens array<string>"


@pytest.mark.parametrize("block, look", [(100_000, 256), (60, 256), (60, 3), (100_000, 1)])
def test_repeats_by_scan_and_by_index(spark, monkeypatch, block, look):
    """Whole windows, windows over many blocks, and items that the scan leaves to the index."""
    monkeypatch.setattr(events, "BLOCK_WORDS", block)
    monkeypatch.setattr(events, "LOOK", look)
    rows = repeat_rows(11)
    parent = {}
    for a in rows:
        ok = []
        for b in rows:
            if a[1:3] != b[1:3] or a[2] == "routine" or not (b[3], b[0]) < (a[3], a[0]) or a[3] - b[3] > dt.timedelta(days=10):
                continue
            va, vb, ta, tb = a[4] or None, b[4] or None, set(a[5]), set(b[5])
            same = va and vb and abs(va - vb) <= 0.03 * vb
            soon = a[2] != "other" and not (va and vb) and a[3] - b[3] <= dt.timedelta(days=3 if a[2] == "earnings" else 2)
            if same or soon or (ta and tb and len(ta & tb) / len(ta | tb) >= 0.45):
                ok.append((b[3], b[0]))
        if ok:
            parent[a[0]] = min(ok)[1]
    root = lambda i: root(parent[i]) if i in parent else i
    got = {r["item_id"]: r["root"]["id"] for r in events.novelty_links(spark.createDataFrame(rows, REPEAT_ITEM)).collect()}
    assert got == {i: root(i) for i in parent}


def test_words_of_whole_documents(spark):
    """The words of long texts are those of ``token_set``, whatever the characters around them."""
    rng = random.Random(21)
    bits = ["The", "share", "ROUND", "x1", "é", "İ", "\u212a", "ß", "\n", " ", " ", "-", "\t", "\x00", "中", "😀", "12,5"]
    texts = [None, "", " ", "the", *["".join(rng.choice(bits) for _ in range(30)) for _ in range(200)]]
    texts += ["".join(f"a{chr(c)}b " for c in range(at, at + 64) if not 0xD800 <= c < 0xE000) for at in range(0, 0x11000, 64)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(*[
        F.array_sort(f(F.col("t"), er.NOVELTY_STOP)).alias(n) for f, n in ((te.token_set, "a"), (te.long_text_words, "b"))])
    assert [r["a"] for r in df.collect()] == [r["b"] for r in df.collect()]


def test_words_are_compared_as_bits(monkeypatch):
    """Shared words are counted on bit sets of a block, none of them built where no words are compared; the results are those of sets."""
    import numpy as np
    import pandas as pd

    rng = random.Random(22)
    sets = [rng.sample(range(40), rng.randrange(0, 30)) for _ in range(50)] + [[1000 + i] for i in range(5)]
    for room in (sets, sets[-5:], [[]]):
        bits = events.shared_words(np.array([w for s in room for w in s], np.int64), np.array([len(s) for s in room]))
        assert [[(a & b).bit_count() for b in bits[:i]] for i, a in enumerate(bits)] == [[len({*a} & {*b}) for b in room[:i]] for i, a in enumerate(room)]
    built = []
    shared_words = events.shared_words
    monkeypatch.setattr(events, "shared_words", lambda *a: built.append(1) or shared_words(*a))
    rows = pd.DataFrame({"company_id": "A", "event_type": ["other"] * 3 + ["earnings"] * 2, "era": 0, "part": 0, "t": [0, 1, 2, 0, 1], "item_id": [1, 2, 3, 4, 5],
                         "amount": None, "words": ["a b c", "", "a b c d", "a", "b"], "asks": True, "answers": True})
    got = events.first_repeats(rows, 10 * events.DAY)
    assert got.query("id == id")[["item_id", "id"]].values.tolist() == [[5, 4], [3, 1]] and len(built) == 1


def test_dense_repeats_write_no_pairs(spark, monkeypatch):
    """Items that all resemble each other, in one window: the work must not grow with their square."""
    compared = []
    monkeypatch.setattr(events, "token_set_pairs", lambda *a, **k: compared.append(1) or linking.token_set_pairs(*a, **k))
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(i, "HOT", "other", start + dt.timedelta(minutes=i), None, ["a", "b", "c", f"n{i}"]) for i in range(3000)]
    got = events.novelty_links(spark.createDataFrame(rows, REPEAT_ITEM)).collect()
    assert len(got) == 2999 and {r["root"]["id"] for r in got} == {0} and not compared


def test_alert_groups_do_not_grow_with_symbols(spark):
    """Ordinary symbols share state groups and get their ticks once; only a named symbol's ticks go to several shares."""
    import inspect

    from barloom.streaming import alerts as al

    assert "shares" in inspect.signature(al.level_alerts).parameters
    ticks = spark.readStream.format("rate").load().selectExpr(
        "cast(value as string) symbol", "timestamp ts", "value tick_id", "double(value) ltp", "double(value) rsi", "string(null) signal")
    alerts = spark.readStream.format("rate").load().selectExpr(
        "string(value) alert_id", "string(value) symbol", "'price' metric", "'above' condition", "'3' value")
    shares = spark.createDataFrame([("7", 3)], "symbol string, shares int")
    plan = al.level_alerts(ticks, alerts, shares=shares)._jdf.queryExecution().analyzed().toString()
    grouping = next(line for line in plan.splitlines() if "PandasWithState" in line).split("], [")[0]
    assert "[slot#" in grouping or "'slot" in grouping, grouping


def test_first_hits_over_several_symbols():
    import pandas as pd

    from barloom.streaming.alerts import first_hits

    ticks = pd.DataFrame({"symbol": list("AABB"), "ltp": [1.0, 5.0, 7.0, 2.0], "rsi": [None, 40.0, 60.0, 30.0], "signal": [None, "STRONG BUY", "SELL", None]})
    armed = pd.DataFrame([("B", "price", "above", "5"), ("A", "price", "above", "5"), ("A", "price", "above", "6"), ("B", "rsi", "below", "35"),
                          ("A", "signal", "above", "BUY"), ("B", "signal", "above", "BUY"), ("C", "price", "above", "0")], columns=["symbol", "metric", "condition", "value"])
    assert first_hits(armed, ticks).tolist() == [2, 1, -1, 3, 1, -1, -1]


def test_vectors_are_sent_to_few_chunks(spark):
    """Twice the vectors of a day must not be sent to twice the chunks; the pairs are those of brute force."""
    import numpy as np

    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, 8))
    v /= np.linalg.norm(v, axis=1)[:, None]
    hours = [float(i % 60) for i in range(400)]
    df = spark.createDataFrame([(i, hours[i], v[i].tolist()) for i in range(400)], "node long, hours double, vec array<double>")
    close = linking.close_vectors(df, 0.8, 24.0, block_rows=2)
    want = {(a, b) for a in range(400) for b in range(a + 1, 400) if abs(hours[a] - hours[b]) <= 24 and v[a] @ v[b] >= 0.8}
    assert {(r["a"], r["b"]) for r in close.collect()} == want
    plan = close._jdf.queryExecution()
    sent = next(m for m in [plan.optimizedPlan()]).children().head()
    rows = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, sent).count()
    assert rows <= 400 * (3 * linking.CHUNKS + 1)


def test_frequent_words_survive_a_full_cache(monkeypatch):
    """A word that keeps coming is encoded once, however many other words pass through the cache; ids stay those of the whole text."""
    import numpy as np
    public_tokenizers = pytest.importorskip("public_tokenizers")

    from barloom.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_WORDS", 100)
    known = tokens.PieceTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    learnt, learn = [], known._learn
    monkeypatch.setattr(known, "_learn", lambda words: learnt.extend(words) or learn(words))
    texts = [f"start common word {' '.join(f'w{i}x{k}' for k in range(60))} common end\n\n twice  blank" for i in range(20)]
    for text in texts:
        assert np.frombuffer(known.encode([text])[0], "<u4").tolist() == known.library.encode(text, add_special_tokens=False).ids
    assert learnt.count("common") == 1 and len(known.known) + len(known.older) < 400


def test_words_at_line_ends_are_learnt_apart():
    """The last word of a line and the first of the next are two cached words, not one new word per pair; ids stay those of the whole text."""
    import numpy as np
    public_tokenizers = pytest.importorskip("public_tokenizers")

    from barloom.llm import tokens

    known = tokens.PieceTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    ends, starts = [f"{c}nd." for c in "aeéiouü"], [f"{c}tart" for c in "AEIOUÑ"]
    texts = [f"first {a}\n{b} last" for a in ends for b in starts]
    texts += ["", "\n", "a\n", "a \nb c", "a\n b", "a\n\nb c\nd", "a \nb\n\nc", "a\n\n\nb c", "\na b", "a b\r\nc", "a \n\tb 1\n2 don't\n's"]
    for text, ids in zip(texts, known.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == known.library.encode(text, add_special_tokens=False).ids
    assert len(known.known) < len(ends) * len(starts)


def test_amount_pattern_is_applied_once(spark):
    """Order value and amounts read a text's amounts in one pass, with the hits that the pattern itself gives."""
    rng = random.Random(24)
    bits = ["Rs ", "₹", "$", "USD", "rs.", " ", "12", "1,20,000", "3.5", " crore", "cr", " lakh crore", " mn", "million", " shares", "100 tonnes", " order book of ",
            "x", "ytd ", "\x01", "\x02", "é", ". ", "İ", "K"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(600)] + ["", "\x01Rs 5 crore\x02"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    plain = F.translate("t", "\x01\x02", "\x03\x03")
    want = [F.regexp_extract_all(plain, F.lit("(?iU)" + er.AMOUNT), F.lit(i)) for i in (1, 2, 3, 0)]
    hits = te.amount_hits(F.col("t"))
    rows = df.select(F.array(*want).alias("want"), F.array(*[hits[n] for n in ("cur", "num", "unit", "whole")]).alias("got")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows] and sum(len(r["want"][0] or []) for r in rows) > 500
    for column in (te.order_value(F.col("t")), te.amounts_in_crore(F.col("t"))):
        assert df.select(column.alias("x"))._jdf.queryExecution().optimizedPlan().toString().count("subscribers?") == 1


def test_only_texts_of_a_date_formats_shape_are_parsed(spark):
    """The look before the parse loses no date."""
    from barloom.functions import fixed_values as fv
    from barloom.sources import feeds

    rng = random.Random(23)
    bits = ["1", "07", "31", "2001", "01", "Jan", "jan", "July", "May", "Sept", "-", "/", " ", "T", "09:30:00", "9:3:0", "+", "soon", ":", "."]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 8))) for _ in range(3000)]
    texts += ["1 Jan 2001", "07-May-2001", "31/07/2001", "7-1-2001", "2001-1-7", "1 July 2001", "1-Jan-2001 09:30:00", "2001-01-31T09:30:00", "2001-01-31 09:30:00", "+2001-01-07", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    forms = [*fv.MEETING_DATE_FORMATS, "d-MMM-yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss"]
    both = df.select("t", F.array(*[feeds.at_format(F.col("t"), f) for f in forms]).alias("got"), F.array(*[F.try_to_timestamp("t", F.lit(f)) for f in forms]).alias("want"))
    rows = both.collect()
    assert all(r["got"] == r["want"] for r in rows)
    assert not [f for i, f in enumerate(forms) if not any(r["want"][i] is not None for r in rows)]


def test_parts_follow_the_input(spark, tmp_path, monkeypatch):
    """A stored input of many parts is dealt into as many; a title's terms are counted without a table over all titles."""
    from barloom import session

    spark.range(20000).selectExpr("id", "uuid() as u").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    assert session.parted(t, t, "id").rdd.getNumPartitions() == t.rdd.getNumPartitions()
    monkeypatch.setattr(session, "PART_BYTES", 50_000)
    assert session.parted(t, t, "id").rdd.getNumPartitions() > 10
    titles = spark.createDataFrame([("big mill big mill big", 2), ("mill", 1), ("", 1)], "key string, n long")
    rows = titles.select("key", F.explode(dedup.counted(dedup.title_terms(F.col("key"), ["of"])))).select("key", "col.*").collect()
    assert {(r["key"][:3], r["term"]): r["tf"] for r in rows} == {("big", "big"): 3, ("big", "mill"): 2, ("big", "big mill"): 2, ("big", "mill big"): 2, ("mil", "mill"): 1}
