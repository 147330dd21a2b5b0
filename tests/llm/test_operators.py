"""Each operator against a plain Python version, over texts with every awkward case at once."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barloom.llm import chat, classifier, components, exact, licenses, mixing, packing, rules, sharding, simhash, suffixes
from barloom.llm.registry import tokenizer_path
from barloom.session import fresh_dir

WS = r"[\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, id string, value string, `names` int, bucket long"


def awkward_texts():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7)))
    prose = [" ".join(word() for _ in range(r.randint(60, 260))) for _ in range(24)]
    passage = " ".join(word() for _ in range(120))
    long = " ".join(word() for _ in range(9000))
    return [
        None, "", "   \n\t ", "one", "Two words", *prose, prose[0], prose[0].replace(" ", " \t ", 3), prose[1] + "!", prose[2] + " more",
        *[p + " " + passage + " " + p[::-1] for p in prose[3:8]], long, long, "a" * 3000, "xy " * 900, "same line\n" * 40 + prose[5],
        " ".join(w + "%%%" for w in prose[6].split()), prose[7].upper(), "CC  BY all rights reserved, cc-by-sa", "GNU General Public License version 3",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "İK cc by \x0b naïve <|endoftext|> &lt; end",
        prose[9] + "\nAll rights reserved.", "license " * 30, "tab\tand\x0cfeed " + prose[10],
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, None if i % 7 == 0 else f"s{i % 4 if i % 2 else 0}", None if t is None else len(t), "r", "x", "v", i, 1)
            for i, t in enumerate(awkward_texts())]
    rows += [rows[6], rows[6], (None, "no id at all " * 30, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def same_rows(got, want):
    assert sorted(got, key=repr) == sorted(want, key=repr)


# ---- exact dedup ------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("block,bits", [(4096, 64), (16, 3)])
def test_exact_copies(docs, block, bits):
    """Few bucket bits make different contents share buckets at every level; the result is the same."""
    norm = {i: re.sub(WS, " ", t) for i, t in plain(docs)}
    groups = {}
    for i, t in plain(docs):
        groups.setdefault(re.sub(WS, " ", t), []).append(i)
    smallest = {t: min(ids, key=lambda i: (i is None, i)) for t, ids in groups.items()}
    got = exact.copies(docs, block, bits).collect()
    same_rows([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got],
              [(i, smallest[norm[i]], len(groups[norm[i]]), hashlib.sha256(norm[i].encode()).hexdigest()) for i, _ in plain(docs)])
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_rows_keep_their_columns(docs, empty):
    stay = exact.without_copies(docs)
    assert stay.columns == docs.columns
    assert stay.count() == len({re.sub(WS, " ", t) for _, t in plain(docs)})
    assert exact.copies(empty).count() == 0 and exact.without_copies(empty).count() == 0


# ---- near dedup -------------------------------------------------------------------------------------------------

def brute_fingerprint(text):
    words = [w for w in re.split(WS, "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if root[b] < root[a] and linked(a, b):
                    root[a], changed = root[b], True
    return root


def test_near_copies(docs, empty):
    known = docs.filter("doc_id is not null")
    fps = {i: brute_fingerprint(t) for i, t in plain(known)}
    root = brute_components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    got = simhash.near_copies(known).collect()
    same_rows([(r.doc_id, r.fingerprint, r.component_id) for r in got], [(i, f"{fps[i]:016x}", root[i]) for i, _ in plain(known)])
    assert simhash.without_near_copies(docs).columns == docs.columns
    assert {r.doc_id for r in simhash.without_near_copies(known).collect()} == set(root.values())
    assert simhash.near_copies(empty).count() == 0


@pytest.mark.parametrize("meeting,hot", [(64, simhash.HOT), (0.001, simhash.HOT), (64, 5), (0.001, 2)])
def test_links_connect_dense_groups(spark, meeting, hot):
    """Fingerprints around a few centres, under few and many parts, with crowded keys refined; no link between different ones is lost."""
    r = random.Random(5)
    fps = set()
    for _ in range(4):
        c = r.getrandbits(64)
        for _ in range(60):
            x = c
            for _ in range(r.randint(0, 5)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    got = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3), meeting=meeting, hot=hot).collect()
    assert all((a ^ b).bit_count() <= 4 for a, b in ((x.a % (1 << 64), x.b % (1 << 64)) for x in got))
    pairs = {(x.a, x.b) for x in got}
    label = {r.node: r.root for r in components.components(spark.createDataFrame(sorted(pairs), "a long, b long")).collect()}
    root = brute_components(signed, lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4)
    assert {x: label.get(x, x) for x in signed} == root


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(200, 200), (300, 301), (301, 300)], "a long, b long")
    assert {(r.node, r.root) for r in components.components(chain).collect()} == {(i, 0) for i in range(71)} | {(300, 300), (301, 300)}
    assert components.components(chain.limit(0)).count() == 0


# ---- quality rules ----------------------------------------------------------------------------------------------

def test_rules(docs, empty):
    def facts(text):
        w = [x for x in re.split(WS, text) if x]
        grams = Counter(zip(w, w[1:], w[2:]))
        covered = {j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
                len(w) < 50 or 100 * len(covered) > 50 * len(w))
    got = rules.quality(docs).collect()
    same_rows([tuple(r)[:7] for r in got], [(i, *facts(t)) for i, t in plain(docs)])
    assert not any(r.kept for r in got if r.base_failed)
    by_id = {r.doc_id: r.kept for r in got}
    assert all(by_id[i] for i in range(5, 29)) and rules.without_rejected(docs).columns == docs.columns
    assert rules.without_rejected(docs).count() == sum(r.kept for r in got) and rules.quality(empty).count() == 0


def test_rule_order_follows_rejections_per_cost(spark):
    rows = spark.range(3000).select(F.concat_ws(" ", F.array_repeat(F.concat(F.lit("w"), F.col("id") % 7), (F.col("id") % 400).cast("int"))).alias("text"))
    none, half = rules.Rule("none", lambda m: m["n_words"] < 0), rules.Rule("half", lambda m: m["n_words"] < 200)
    dear = rules.Rule("dear", lambda m: (m["n_repeat_words"] >= 0) & (m["n_words"] < 200))
    assert [r.name for r in rules.ordered(rows, [none, half])] == ["half", "none"]
    assert [r.name for r in rules.ordered(rows.cache(), [none, dear, half])] == ["half", "dear", "none"]
    assert rules.ordered(rows.limit(0), [none, half]) == [none, half]


def test_cascade_computes_no_measure_behind_a_rejection(spark):
    """A measure that fails the job is not reached for documents that an earlier rule rejects, and is for others."""
    rows = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    dear = rules.Rule("dear", lambda m: F.raise_error(F.concat(F.lit("reached "), m["n_words"])).cast("boolean"))
    cheap = rules.Rule("cheap", lambda m: m["n_words"] < 50)
    kept = lambda order: rows.filter(rules.bind(rules.words_of(F.col("text")), lambda w: rules.cascade(order, rules.measures(rules._text(), w))))
    assert kept([cheap, dear]).count() == 0
    with pytest.raises(Exception, match="reached"):
        kept([dear, cheap]).count()


# ---- suffixes ---------------------------------------------------------------------------------------------------

def test_suffix_array_is_sorted():
    r = random.Random(1)
    for _ in range(150):
        data = bytes(r.choice(b"aab\xffc"[:r.randint(1, 5)]) for _ in range(r.randint(1, 70)))
        got = suffixes.suffix_array(np.frombuffer(data, np.uint8), 400).tolist()
        assert got == sorted(range(len(data)), key=lambda i: data[i:])


@pytest.mark.parametrize("hot", [suffixes.HOT_BYTES, 1])
def test_repeated_bytes(docs, empty, hot):
    """With hot = 1 byte every value with several regions is counted by windows instead of sorted."""
    texts = [(i, t.encode()) for i, t in plain(docs)]
    seen = Counter(t[k:k + 400] for _, t in texts for k in range(len(t) - 399))
    want = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - 399):
            if seen[t[k:k + 400]] > 1:
                gone[k:k + 400] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int)))) == 1)
        want.append((i, len(t), int(gone.sum()), len(edges), hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    got = suffixes.removed(docs, hot_bytes=hot, batch_bytes=5000)
    same_rows([tuple(r)[:5] for r in got.collect()], want)
    assert suffixes.removed(empty).count() == 0


# ---- packing ----------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("group", [16, packing.GROUP_PIECES])
def test_packing(docs, empty, group):
    """Groups of 16 pieces exchange documents; one group is as good as plain best-fit decreasing over all pieces."""
    library = Tokenizer.from_file(tokenizer_path())
    ids = [(i, np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")) for i, t in plain(docs)]
    got = packing.pack(docs, tokenizer_path(), group_pieces=group).collect()
    want = [(i, k, s, n, zlib.crc32(x[s:s + n].tobytes())) for i, x in ids for k, (s, n) in enumerate(packing.cut(len(x), 1024))]
    same_rows([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], want)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    lengths = np.array(sorted((r.length for r in got), reverse=True))
    alone = packing.best_fit_decreasing(lengths, 1024)[2]
    assert packing.lower_bound(lengths, 1024) <= len(by_sequence)
    assert len(by_sequence) == alone if group > len(lengths) else len(by_sequence) < 1.05 * alone
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_bounds_never_exceed_what_fits():
    r = random.Random(2)
    for _ in range(200):
        lengths = np.array(sorted((r.randint(1, 20) for _ in range(r.randint(1, 30))), reverse=True))
        bins, offsets, n = packing.best_fit_decreasing(lengths, 20)
        assert np.bincount(bins, weights=lengths).max() <= 20 and len(set(bins.tolist())) == n
        assert packing.lower_bound(lengths, 20) <= n
    assert packing.lower_bound(np.array([11, 11, 11]), 20) == 3 and packing.lower_bound(np.array([7] * 4), 20) == 2


# ---- mixing -----------------------------------------------------------------------------------------------------

def test_mixing(docs, empty):
    got = mixing.taken(docs).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    size = {i: len([w for w in re.split(WS, t) if w]) for i, t in plain(docs)}
    same_rows([(r.doc_id, r["size"]) for r in got], [(i, size[i]) for i, _ in plain(docs)])
    sums = Counter()
    for i, _ in plain(docs):
        sums[source[i]] += size[i]
    order = sorted(sums, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sums.values())
    while True:
        over = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * sums[s]]
        if not over:
            break
        for s in over:
            target[s] = 2 * sums[s]
            open_.remove(s)
            left -= 2 * sums[s]
    total = sum(weight[x] for x in open_)
    target |= {s: left * weight[s] / total for s in open_}
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sums[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
        taken[s] += r.taken
    longest = {s: max(size[i] for i in size if source[i] == s) for s in order}
    assert all(abs(taken[s] - target[s]) <= longest[s] / 2 for s in order)               # whole copies cannot come nearer than that
    assert sorted(map(tuple, mixing.taken(docs).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns and mix.count() == sum(r.copies for r in got)
    assert mixing.taken(empty).count() == 0 and mixing.mixed(empty).count() == 0


# ---- sharding ---------------------------------------------------------------------------------------------------

def test_sharding(docs, empty):
    got = sharding.shard(docs, shards=5, slots=64).collect()
    same_rows([(r.doc_id, r["size"], r.text_crc32) for r in got], [(i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in plain(docs)])
    for s in range(5):
        mine = sorted(r.slot for r in got if r.shard == s)
        assert mine == list(range(len(mine)))
    assert {r.law for r in got} == {"bytes"} and sharding.shard(empty).count() == 0


def test_stored_map_is_read_back_and_edited(spark):
    """A grown table moves few slots of the newest version; old versions stay readable; another number of slots is an error."""
    path = fresh_dir(spark, "map")
    r = random.Random(12)
    rows = [(i, "x" * r.randint(50, 900)) for i in range(3000)]
    table = lambda n: spark.createDataFrame(rows[:n], "doc_id long, text string")
    run = lambda n: sharding.shard(table(n), shards=4, slots=256, map_path=path).select("map_version", "virtual_slot", "shard", "size").collect()
    first, again, grown = run(2800), run(2800), run(3000)
    assert {x.map_version for x in first} == {1} == {x.map_version for x in again} and {x.map_version for x in grown} == {2}
    one, two = sharding.read_map(spark, path, 1)[1], sharding.read_map(spark, path, 2)[1]
    assert sharding.read_map(spark, path)[0] == 2 and sharding.read_map(spark, path, 0) == (0, sharding.first_map(256, 4))
    assert 0 < sum(a != b for a, b in zip(one, two)) < 40
    for found, current in ((first, one), (grown, two)):
        assert all(current[x.virtual_slot] == x.shard for x in found)
        load = Counter()
        for x in found:
            load[x.shard] += x["size"]
        assert max(load.values()) <= 1.01 * min(load.values())
    assert sharding.read_map(spark, path, 9) is None
    with pytest.raises(ValueError, match="slots"):
        sharding.shard(table(10), shards=4, slots=128, map_path=path)


def test_rebalancing_moves_slots_towards_the_mean():
    r = random.Random(4)
    load = {s: r.randint(1, 1000) for s in range(300)}
    first = sharding.first_map(300, 7)
    final = sharding.rebalanced(first, load, 7)
    sums = [sum(load[s] for s in range(300) if final[s] == k) for k in range(7)]
    assert len(final) == 300 and max(sums) - min(sums) <= 20
    assert sharding.rebalanced(final, load, 7) == sharding.rebalanced(final, load, 7)
    again = sharding.rebalanced(final, load, 7)
    assert sum(a != b for a, b in zip(final, again)) < sum(a != b for a, b in zip(first, final)) / 2
    assert sharding.rebalanced(first, {}, 7) == first


# ---- licences ---------------------------------------------------------------------------------------------------

def test_licences(docs, empty):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    got = {(r.doc_id, r.n_words): r for r in licenses.scan(docs).collect()}
    for i, t in plain(docs):
        w = words(t)
        r = got[i, len(w)]
        starts, labels, best = [], set(), 0.0
        for template in licenses.TEMPLATES:
            x = template.words
            for s in range(len(w)):
                if all(s + j < len(w) and w[s + j] == x[j] for j in template.key_places):
                    labels.add(template.label)
                    best = max(best, sum(s + j < len(w) and w[s + j] == x[j] for j in range(len(x))) / len(x))
                    if template.base:
                        starts.append(s)
        assert (r.n_base, r.first_word, r.last_word) == (len(starts), min(starts, default=None), max(starts, default=None))
        assert r.labels == ",".join(sorted(labels)) and r.score == pytest.approx(best)
        assert r.base_labels == ",".join(sorted(labels & {"cc-by", "gpl", "reserved"}))
    assert licenses.scan(empty).count() == 0


# ---- chats ------------------------------------------------------------------------------------------------------

def test_chats(spark):
    rows = [(1, 0, "system", "be &amp; <|turn|> brief"), (1, 1, "user", "</s>[INST] see ![image](a.png) and ![audio](b.wav)"), (1, 2, "assistant", "![document](c.pdf)<|end|>&lt;"),
            (2, 1, "assistant", "second"), (2, 0, "assistant", None), (2, None, None, "no turn"), (3, 0, "assistant<|says|>\n", "odd é role ![image]( x)"),
            (4, 0, "user", "same"), (4, 0, "user", "same"), (None, 0, "user", "z" * 20000)]
    said = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = chat.format_chat(chat.with_own_parts(said)).cache()
    got = {r.conv_id: r for r in chat.digest(chats).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == conv))
        loss = "".join(text for _, role, text in turns if role == "assistant")
        r = got[conv]
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    one = {r.conv_id: r for r in chats.collect()}[1]
    assert "<|image|> and <|audio|>" in one.formatted and one.formatted.count("<|turn|>") == 3 and one.expanded_tokens == 256 + 128 + 512
    assert [[a.ref for a in t] for t in one.attachments] == [[], ["a.png", "b.wav"], ["c.pdf"]]
    assert chat.digest(chat.format_chat(chat.with_own_parts(said.limit(0)))).count() == 0


def test_typed_parts_given_by_the_caller(spark):
    message = spark.createDataFrame([(1, 0, "user", [("text", "a<b"), ("video", "v"), ("image", None), ("text", None)])],
                                    "conv_id long, turn long, role string, parts array<struct<type string, value string>>")
    row = chat.format_chat(message).collect()[0]
    assert row.formatted == "<|turn|>user<|says|>a&lt;b<|image|><|end|>" and row.attachments[0][0].ref == "" and row.loss_mask == []


# ---- classifier -------------------------------------------------------------------------------------------------

def test_classifier_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    kept_apart = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    scored = classifier.classified(docs, labels.filter(~kept_apart), labelled=1500, handed=100)
    got = labels.filter(kept_apart).join(scored, "doc_id").select("quality", "kept").collect()
    assert sum(r.quality == r.kept for r in got) >= 0.97 * len(got)
    assert scored.count() == docs.count()


def test_co_training_rounds_by_brute_force(spark):
    """The rounds over all unlabelled documents in plain Python: the same pseudo-labels in the same order, the same scores."""
    folder = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    docs = docs.unionByName(docs.filter("doc_id < 5")).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    few = labels.filter("doc_id % 2 = 0")
    model = classifier.train(docs, few, handed=7, rounds=3, sure=0.6)
    rows = {r.doc_id: r for r in docs.collect() if r.doc_id is not None}
    text = {i: classifier.text_features(r.text) for i, r in rows.items()}
    meta = {i: classifier.meta_features(r.source, r.lang, r.n_chars) for i, r in rows.items()}
    good = {r.doc_id: float(r.quality >= 0.5) for r in few.collect() if r.doc_id in rows and r.quality is not None}
    ids = sorted(good)
    held = [i for i in ids if xxhash.xxh32_intdigest(str(i)) % 5 == 0]
    rest, free = [i for i in ids if i not in held], sorted(set(rows) - set(good))
    given = [[], []]

    def learn(k):
        x = (text, meta)[k]
        mine = rest + [i for i, _ in given[k]]
        y = [good[i] for i in rest] + [label for _, label in given[k]]
        return classifier.trained(np.array([x[i] for i in mine]), np.array(y), np.array([x[i] for i in held]), np.array([good[i] for i in held]))

    now = [learn(0), learn(1)]
    for _ in range(3):
        p = [dict(zip(free, now[k].score(np.array([(text, meta)[k][i] for i in free], np.float32)))) for k in (0, 1)]
        new = [[], []]
        for k in (0, 1):
            taken = {i for i, _ in given[1 - k]}
            for label, sure, against in ((1.0, lambda v: v, lambda v: v <= 0.4), (0.0, lambda v: 1 - v, lambda v: v >= 0.6)):
                open_ = [i for i in free if i not in taken and sure(p[k][i]) >= 0.6 and not against(p[1 - k][i])]
                new[1 - k] += [(i, label) for i in sorted(open_, key=lambda i: (-sure(p[k][i]), i))[:7]]
        given = [given[k] + new[k] for k in (0, 1)]
        now = [learn(0), learn(1)]
    assert model.pseudo_labels == len(given[0]) + len(given[1]) > 20
    for k, view in enumerate((model.text, model.meta)):
        assert np.allclose(view.weights, now[k].weights, atol=1e-4) and abs(view.slope - now[k].slope) < 1e-4


def test_classifier_without_anything_to_learn(docs, empty):
    none = docs.select("doc_id", F.lit(1).alias("quality"))
    for labels in (none, none.limit(0), none.withColumn("quality", F.lit(None).cast("int"))):
        got = classifier.classified(docs, labels).collect()
        assert len(got) == docs.count() and all(r.kept and r.score is None for r in got)
    mixed = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    got = classifier.classified(docs, mixed).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert classifier.classified(empty, mixed).count() == 0
