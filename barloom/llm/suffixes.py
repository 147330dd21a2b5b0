"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that starts in two places are found and removed.

A suffix array of all texts is no unit of distributed work, so the texts are cut into regions first, without losing a match. The
smallest hash of the 32-byte grams inside a window of ``length`` bytes is the window's value; neighbouring windows with one value
form a region. Equal windows have equal values, so all that can be equal lies in regions of one value. Regions whose value stands
alone are done. Of equal regions every byte is repeated, wherever they stand. Of the different regions of one value only those can have
a string in common that have the same 184 bytes on the left or on the right of the value's gram, since a window reaches that far on
one side of it; the others are done too (values whose gram stands twice in a region are left as they are). What is left goes
through suffix arrays: two-stage sorting (suffixes smaller than their successors are sorted directly, all others induced by bucket
scans) and the common prefixes of neighbours. A value with very many bytes in different regions - a passage that a third of all
documents quotes, each in its own surroundings - is not brought to one task: its windows are counted by two 64-bit hashes, in two steps.

Null text is empty; empty and short texts have no regions. Very long texts are read whole, in tasks of few texts. Repeated rows are
copies of each other. Ties do not arise. An empty table gives no rows; extra columns are not read, so none can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from barloom.session import stage, unstage

LENGTH = 400
GRAM = 32
#: Windows in one region; longer runs of one value (periodic texts) are cut.
REGION = 4096
#: Bytes of regions in one suffix array.
BATCH_BYTES = 2 << 20
#: Bytes in the different regions of one value beyond which they are counted by windows.
HOT_BYTES = 8 << 20
#: Bytes that are compared at a time in a suffix array; strings are at least as long.
BLOCK = 64
#: Windows that share the first of the two counting steps.
STEP = 32

_P = [pow(0x9E3779B97F4A7C15, 1 << i, 1 << 64) for i in range(6)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each 32-byte gram, by doubling."""
    h = data.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        for i in range(5):
            s = 1 << i
            h = h[:-s] * np.uint64(_P[i]) + h[s:]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    m, w = h, 1
    while 2 * w <= width:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    return np.minimum(m[:len(m) - (width - w)], m[width - w:]) if width > w else m


def regions(data: bytes, length: int = LENGTH) -> list[tuple[int, int, int, int, int, bool]]:
    """(value, hash high, hash low, start, bytes, whether the value stands there twice) of each region of a text."""
    if len(data) < length:
        return []
    h = gram_hashes(np.frombuffer(data, np.uint8))
    width = length - GRAM + 1
    m = window_minima(h, width)
    starts = np.concatenate(([0], np.flatnonzero(m[1:] != m[:-1]) + 1))
    ends = np.append(starts[1:], len(m))
    out, digest = [], xxhash.xxh3_128_intdigest
    for s, e, v in zip(starts.tolist(), ends.tolist(), m[starts].tolist()):
        twice = e - s > 1 and np.count_nonzero(h[s:e - 1 + width] == np.uint64(v)) > 1
        for at in range(s, e, REGION):
            size = min(at + REGION, e) - at + length - 1
            d = digest(data[at:at + size])
            out.append((v, d >> 64, d & 0xFFFFFFFFFFFFFFFF, at, size, twice))
    return out


def sides(content: bytes, value: int, length: int) -> tuple[int | None, int | None]:
    """Hashes of the bytes on the left and on the right of the value's first gram, as many as a window reaches on one side at least.

    Null where the region has not so many there.
    """
    h = gram_hashes(np.frombuffer(content, np.uint8))
    gram = int((h == np.uint64(value % (1 << 64))).argmax())
    reach = -(-(length - GRAM) // 2)
    short = xxhash.xxh3_64_intdigest
    return (short(content[gram - reach:gram]) if gram >= reach else None,
            short(content[gram + GRAM:gram + GRAM + reach], 1) if gram + GRAM + reach <= len(content) else None)


def _signed(values: list[int | None]) -> pa.Array:
    known = pa.array([v is None for v in values], pa.bool_()).to_numpy(zero_copy_only=False)
    return pa.array(np.array([v or 0 for v in values], np.uint64).astype(np.int64), mask=known)


def _utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


REGIONS = "doc_id long, text_key long, value long, high long, low long, start long, size long, twice boolean"


def all_regions(texts: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 256):
                batch = big.slice(at, 256)
                rows, docs, keys = [], [], []
                for doc, key, text in zip(*[batch[c].to_pylist() for c in ("doc_id", "text_key", "text")]):
                    found = regions(_utf8(text), length)
                    rows += found
                    docs += [doc] * len(found)
                    keys += [key] * len(found)
                v, hi, lo, start, size, twice = zip(*rows) if rows else ([],) * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(keys, pa.int64()), _signed(v), _signed(hi), _signed(lo), pa.array(start, pa.int64()),
                     pa.array(size, pa.int64()), pa.array(twice, pa.bool_())],
                    ["doc_id", "text_key", "value", "high", "low", "start", "size", "twice"])

    return texts.select("doc_id", "text_key", "text").mapInArrow(run, REGIONS)


# ---- suffix arrays ----------------------------------------------------------------------------------------------

def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number, zero beyond the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    n = len(data)
    k = np.zeros(n + 1, np.uint64)
    for i in range(8):
        k[:n] |= padded[i:i + n] << np.uint64(56 - 8 * i)
    return k


def smaller_than_next(data: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it; the last one is not."""
    n = len(data)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(np.diff(data.astype(np.int16)))
    step[-1] = -1
    at = np.where(step != 0, np.arange(n), n - 1)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks 1, 2, ... of the keys; equal keys have equal ranks."""
    order = np.argsort(keys)
    new = np.append(1, keys[order[1:]] != keys[order[:-1]])
    ranks = np.empty(len(keys), np.int64)
    ranks[order] = np.cumsum(new)
    return ranks


def block_ranks(data: np.ndarray) -> np.ndarray:
    """The rank of the BLOCK bytes from each position on among all of them, 0 beyond the end; built by doubling from eight bytes."""
    n = len(data)
    ranks = np.append(_dense(_words(data)[:n]), 0)
    width = 8
    while width < BLOCK:
        ranks = np.append(_dense(ranks[:n] * (n + 2) + ranks[np.minimum(np.arange(width, n + width), n)]), 0)
        width *= 2
    return ranks


def _offsets(depth: int) -> list[int]:
    """Where blocks start that together cover ``depth`` bytes; the last one may overlap the one before it."""
    return [*range(0, depth - BLOCK, BLOCK), max(0, depth - BLOCK)]


def sorted_directly(ranks: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions in order of their suffixes, compared up to ``depth`` bytes (one block at least), a block at a time, ties only."""
    n = len(ranks) - 1
    key = ranks[at]
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    head = np.concatenate(([True], key[1:] != key[:-1]))
    for d in _offsets(depth)[1:]:
        tied = np.flatnonzero(~(head & np.append(head[1:], True)))
        if not len(tied):
            break
        group = np.cumsum(head)[tied]
        key = group * (n + 2) + ranks[np.minimum(at[tied] + d, n)]
        order = np.argsort(key, kind="stable")
        at[tied] = at[tied][order]
        key = key[order]
        head[tied[1:]] |= key[1:] != key[:-1]
    return at


def suffix_array(data: np.ndarray, depth: int, ranks: np.ndarray | None = None) -> np.ndarray:
    """All suffixes in order (up to ``depth`` bytes) by two-stage sorting.

    A bucket holds the suffixes with one first byte: first the larger-than-next ones, then the smaller-than-next ones. Buckets are
    scanned in order; whatever stands before a scanned suffix and is larger than it goes to the next free place of its bucket.
    """
    n = len(data)
    small = smaller_than_next(data)
    direct = sorted_directly(block_ranks(data) if ranks is None else ranks, np.flatnonzero(small), depth)
    starts = np.searchsorted(data[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[data[-1]].append(np.array([n - 1]))                    # the last suffix is larger than the empty one
    out = []

    def hand_on(found: np.ndarray, own: int) -> np.ndarray:
        """Puts the larger predecessors into their buckets; returns those of the bucket being scanned."""
        before = found[found > 0] - 1
        before = before[~small[before]]
        chars = data[before]
        order = np.argsort(chars, kind="stable")
        before, chars = before[order], chars[order]
        cuts = np.flatnonzero(np.diff(chars)) + 1
        mine = np.empty(0, np.int64)
        for part in np.split(before, cuts) if len(before) else []:
            if data[part[0]] == own:
                mine = part
            else:
                induced[data[part[0]]].append(part)
        return mine

    for c in range(256):
        queue = induced[c]
        done = 0
        while done < len(queue):                                   # runs of one byte feed their own bucket
            part = np.concatenate(queue[done:])
            queue[done:] = [part]
            done += 1
            if len(mine := hand_on(part, c)):
                queue.append(mine)
        sorted_part = direct[starts[c]:starts[c + 1]]
        hand_on(sorted_part, c)
        out += [*queue, sorted_part]
    return np.concatenate(out)


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text the starts of strings of ``length`` bytes that start twice or more in the texts (each place once)."""
    data = np.frombuffer(b"".join(t + b"\xff" for t in texts), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    ranks = block_ranks(data)
    sa = suffix_array(data, length, ranks)
    sa = sa[ends[owner[sa]] - 1 - sa >= length]
    same = np.arange(len(sa) - 1)
    for d in _offsets(length):                                      # common prefixes of neighbours, survivors only
        same = same[ranks[sa[same] + d] == ranks[sa[same + 1] + d]]
    hit = np.unique(np.concatenate((sa[same], sa[same + 1])))
    cuts = np.searchsorted(hit, ends[:-1])
    begins = np.concatenate(([0], ends[:-1]))
    return [part - begin for part, begin in zip(np.split(hit, cuts), begins)]


def spans_of(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal (start, end) covered by windows from sorted starts."""
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > length) + 1
    return [(int(s[0]), int(s[-1]) + length) for s in np.split(starts, cuts)]


# ---- distributed ----------------------------------------------------------------------------------------------

SPANS = "value long, high long, low long, start long, end long"


def _solved(contents: DataFrame, length: int, batch_bytes: int) -> DataFrame:
    """Covered spans of each region, relative to it; regions of one value meet in one suffix array."""
    def solve(rows: list[tuple]) -> list[tuple]:
        starts = repeated_starts([r[3] for r in rows], length)
        return [(v, hi, lo, s, e) for (v, hi, lo, _), at in zip(rows, starts) for s, e in spans_of(at, length)]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = zip(*rows) if rows else ([],) * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["value", "high", "low", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*[batch[c].to_pylist() for c in ("value", "high", "low", "content")]):
                if last is not None and row[:3] == last[:3]:         # a repeated row of the table brings its region again
                    continue
                if size >= batch_bytes and row[0] != last[0]:
                    yield batch_of(solve(rows))
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3])
                last = row
        if rows:
            yield batch_of(solve(rows))

    return contents.repartition("value").sortWithinPartitions("value", "high", "low").mapInArrow(run, SPANS)


def _steps(content: bytes, value: int, length: int, windows: bool) -> list[tuple[int, int, int]]:
    """(hash, start, windows) of a region's groups of at most STEP windows, or of its windows.

    Groups follow the window's distance to the value's gram, so equal windows fall into equal groups; the hash covers the bytes
    that all windows of a group have.
    """
    h = gram_hashes(np.frombuffer(content, np.uint8))
    places = np.flatnonzero(h == np.uint64(value % (1 << 64)))
    s = np.arange(len(content) - length + 1)
    p = places[np.searchsorted(places, s)]
    digest = xxhash.xxh3_64_intdigest
    group = (p - s) // STEP
    cuts = np.flatnonzero((np.diff(group) != 0) | (np.diff(p) != 0)) + 1
    out = []
    for run in np.split(s, cuts):
        a = int(p[run[0]] - group[run[0]] * STEP)
        if windows:
            core = digest(content[a:a + length - STEP + 1], int(group[run[0]]))
            out += [(core, digest(content[i:i + length], 1), i) for i in run.tolist()]
        else:
            out.append((digest(content[a:a + length - STEP + 1], int(group[run[0]])), 0, int(run[0])))
    return out


def _counted(contents: DataFrame, length: int) -> DataFrame:
    """As ``_solved`` for values with very many regions: windows are counted by hashes, first in groups, then one by one."""
    def hashes(windows: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for big in batches:
                for at in range(0, big.num_rows, 128):
                    batch = big.slice(at, 128)
                    out = [(v, hi, lo, core, w, i) for v, hi, lo, c in zip(*[batch[x].to_pylist() for x in ("value", "high", "low", "content")])
                           for core, w, i in _steps(c, v, length, windows)]
                    v, hi, lo, core, w, i = zip(*out) if out else ([],) * 6
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), _signed(core),
                                                      _signed(w), pa.array(i, pa.int64())], ["value", "high", "low", "core", "window", "start"])
        return run

    form = "value long, high long, low long, core long, window long, start long"
    contents = contents.dropDuplicates(["value", "high", "low"])
    cores = stage(contents.mapInArrow(hashes(False), form).groupBy("value", "core").count().filter("count > 1").select("value", "core"), "cores")
    each = contents.mapInArrow(hashes(True), form).join(cores, ["value", "core"])
    each = stage(each, "windows")
    many = stage(each.groupBy("value", "core", "window").count().filter("count > 1").drop("count"), "repeated")
    return each.join(many, ["value", "core", "window"]).select("value", "high", "low", "start", (F.col("start") + length).alias("end"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def repeated_spans(docs: DataFrame, length: int = LENGTH, batch_bytes: int = BATCH_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(doc_id, text, spans) per document: spans (start, end) in UTF-8 bytes, unmerged and unordered, null where nothing repeats.

    Null text is empty. Repeated rows are copies of each other. A document is known by doc_id and a hash of its text.
    """
    texts = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    found = stage(all_regions(texts, length), "regions")
    whole, key = ["value", "high", "low"], ["doc_id", "text_key"]
    values = found.groupBy("value").agg(
        F.count("*").alias("n"), F.max("twice").alias("twice"),
        ((F.min("high") != F.max("high")) | (F.min("low") != F.max("low"))).alias("several"))
    values = stage(values.filter("n > 1 or twice").select(
        "value", (F.col("several") | F.col("twice")).alias("several"), F.col("twice").alias("any_twice")), "values")
    met = stage(found.join(values, "value"), "met")
    unstage(found)
    unstage(values)
    plain = met.filter("not several").select(*key, "start", (F.col("start") + F.col("size")).alias("end"))
    differ = met.filter("several")
    distinct = stage(differ.groupBy(*whole).agg(F.count("*").alias("n"), *[
        F.first(c).alias(c) for c in (*key, "start", "size", "any_twice")]), "distinct")
    many = distinct.filter("n > 1").select(*whole)
    copied = differ.join(many, whole).select(*key, "start", (F.col("start") + F.col("size")).alias("end"))

    wanted = distinct.groupBy(*key).agg(F.collect_list(F.struct(*whole, "start", "size", "any_twice")).alias("wanted")).withColumnsRenamed(
        {"doc_id": "w_doc", "text_key": "w_key"})
    held = texts.join(wanted, _same(F.col("doc_id"), F.col("w_doc")) & (F.col("text_key") == F.col("w_key"))).select("text", "wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 128):
                batch = big.slice(at, 128)
                rows = []
                for text, some in zip(batch["text"].to_pylist(), batch["wanted"].to_pylist()):
                    data = _utf8(text)
                    for x in some:
                        content = data[x["start"]:x["start"] + x["size"]]
                        beside = (None, None) if x["any_twice"] else sides(content, x["value"], length)
                        rows.append((x["value"], x["high"], x["low"], content, x["any_twice"], *beside))
                v, hi, lo, c, twice, left, right = zip(*rows) if rows else ([],) * 7
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(c, pa.binary()),
                     pa.array(twice, pa.bool_()), _signed(left), _signed(right)], ["value", "high", "low", "content", "any_twice", "left", "right"])

    contents = stage(held.mapInArrow(
        cut, "value long, high long, low long, content binary, any_twice boolean, left long, right long"), "contents")
    beside = contents.select(*whole, F.col("any_twice"), F.posexplode(F.array("left", "right")).alias("side", "beside"))
    alike = beside.filter("beside is not null").groupBy("value", "side", "beside").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    may = stage(beside.filter("not any_twice").join(alike, ["value", "side", "beside"], "left_semi").select(*whole).unionByName(
        contents.filter("any_twice").select(*whole)).distinct(), "alike")
    open_ = contents.join(may, whole, "left_semi").select(*whole, "content")
    size = contents.select(*whole, F.octet_length("content").alias("size")).join(may, whole, "left_semi")
    hot = stage(size.groupBy("value").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > hot_bytes).select("value"), "hot")
    if hot.isEmpty():
        spans = _solved(open_, length, batch_bytes)
    else:
        spans = _solved(open_.join(hot, "value", "left_anti"), length, batch_bytes).unionByName(
            _counted(open_.join(hot, "value"), length))
    spans = stage(spans, "spans")
    unstage(contents)
    alone = spans.withColumnsRenamed({"start": "from", "end": "to"}).join(distinct.filter("n = 1"), whole).select(
        *key, (F.col("start") + F.col("from")).alias("start"), (F.col("start") + F.col("to")).alias("end"))
    covered = plain.unionByName(copied).unionByName(alone).groupBy(*key).agg(
        F.collect_list(F.struct("start", "end")).alias("spans")).withColumnsRenamed({"doc_id": "c_doc", "text_key": "c_key"})
    return texts.join(covered, _same(F.col("doc_id"), F.col("c_doc")) & (F.col("text_key") == F.col("c_key")), "left").select(
        "doc_id", "text", "spans")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def removed(docs: DataFrame, length: int = LENGTH, batch_bytes: int = BATCH_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, spans (start, end)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 256):
                batch = big.slice(at, 256)
                rows = []
                for doc, text, spans in zip(*[batch[c].to_pylist() for c in ("doc_id", "text", "spans")]):
                    data = _utf8(text)
                    gone = merged([(x["start"], x["end"]) for x in spans or []])
                    kept, at_byte = hashlib.sha256(), 0
                    for s, e in [*gone, (len(data), len(data))]:
                        kept.update(data[at_byte:s])
                        at_byte = e
                    rows.append((doc, len(data), sum(e - s for s, e in gone), len(gone), kept.hexdigest(), [{"start": s, "end": e} for s, e in gone]))
                cols = list(zip(*rows)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(
                        pa.struct([("start", pa.int64()), ("end", pa.int64())]))))],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return repeated_spans(docs, length, batch_bytes, hot_bytes).mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")
