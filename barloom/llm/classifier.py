"""Quality classifier by co-training of two views.

One classifier reads the text (hashed byte trigrams), the other the page's metadata (source, language, length). Both learn from a
bounded sample of labelled documents. In each round both score every unlabelled document of the table, and each hands the ones it is
surest of, a fixed number per class, with its label to the other's training set. Views are calibrated on labelled documents kept apart
from training, and the calibrated log-odds are combined by weights learned there. Every document is then scored over its whole text.

A round is a scoring job that writes ids and probabilities only; labelled documents and those handed on before are taken out by id, the
surest are found by a distributed top-k, and only their features come to the driver.

Null text, source, language and length have values of their own; very long texts are read whole. Repeated rows are scored alike; as a
pseudo-label one row stands for an id, rows without an id give none. Equal probabilities go by id. If the labels show one class only, or
there are none, nothing can be learned: scores are null and all documents are kept. An empty table gives no rows; extra columns are
not read, so none can clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from barloom.session import stage, unstage

TRIGRAMS, SHAPES = 1024, 24
TEXT_SIZE, SOURCES, LANGS, LENGTHS = TRIGRAMS + SHAPES, 64, 16, 24
META_SIZE = SOURCES + LANGS + LENGTHS
#: Labelled documents that training sees, about; chosen by a hash of doc_id.
LABELLED = 6000
#: Pseudo-labels a round, view and class, of all unlabelled documents the surest, and the calibrated probability they need.
HANDED, SURE = 300, 0.95
ROUNDS = 4
KEEP = 0.5
DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def text_features(text: str | None) -> np.ndarray:
    """Square roots of hashed trigram shares, then what the text as a whole looks like: its number of words (by powers of two), how
    many words and lines are different, and how far it can be compressed. Empty text has zeros and the bin of no words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    x = np.zeros(TEXT_SIZE, np.float32)
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(b) >= 3:
        hashed = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(22)
        counts = np.bincount(hashed, minlength=TRIGRAMS)
        x[:TRIGRAMS] = np.sqrt(counts / counts.sum())
    words, lines = data.split(), data.splitlines()
    x[TRIGRAMS + min(len(words).bit_length(), SHAPES - 4)] = 1
    if words:
        x[-3:] = len(set(words)) / len(words), len(set(lines)) / len(lines), min(1.0, 3 * len(zlib.compress(data, 1)) / len(data))
    return x


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    x = np.zeros(META_SIZE, np.float32)
    x[xxhash.xxh32_intdigest(source or "") % SOURCES] = 1
    x[SOURCES + xxhash.xxh32_intdigest(lang or "") % LANGS] = 1
    x[SOURCES + LANGS + min(max(int(n_chars or 0), 0).bit_length(), LENGTHS - 1)] = 1
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 200, rate: float = 0.3) -> np.ndarray:
    """Logistic regression (weights, then the constant) by Adam over all rows; the same rows give the same weights."""
    x, y = x.astype(np.float32), y.astype(np.float32)
    w, m, v = np.zeros(x.shape[1] + 1, np.float32), np.float32(0), np.float32(0)
    for t in range(1, steps + 1):
        error = _sigmoid(x @ w[:-1] + w[-1]) - y
        g = np.append(error @ x / np.float32(len(y)) + np.float32(penalty) * w[:-1], error.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= np.float32(rate) * (m / np.float32(1 - 0.9 ** t)) / (np.sqrt(v / np.float32(1 - 0.999 ** t)) + np.float32(1e-8))
    return w.astype(float)


@dataclass(frozen=True)
class View:
    weights: np.ndarray
    slope: float
    shift: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability of good quality."""
        return _sigmoid(self.slope * (x @ self.weights[:-1] + self.weights[-1]) + self.shift)


def trained(x: np.ndarray, y: np.ndarray, held_x: np.ndarray, held_y: np.ndarray) -> View:
    w = fit(x, y)
    z = held_x @ w[:-1] + w[-1]
    slope, shift = fit(z[:, None] / 10, held_y, penalty=1e-3, rate=0.1)
    return View(w, max(slope / 10, 0.0), shift)


@dataclass(frozen=True)
class Model:
    text: View
    meta: View
    weights: tuple[float, float, float]
    pseudo_labels: int

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.score(text), self.meta.score(meta)
        return a, b, _sigmoid(self.weights[0] * _logit(a) + self.weights[1] * _logit(b) + self.weights[2])


def matrices(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The features of a batch of documents in both views."""
    text = np.array([text_features(t.as_py()) for t in batch["text"]], np.float32).reshape(-1, TEXT_SIZE)
    meta = np.array([meta_features(*x) for x in zip(*[batch[c].to_pylist() for c in ("source", "lang", "n_chars")])], np.float32)
    return text, meta.reshape(-1, META_SIZE)


def handed_on(mine: np.ndarray, other: np.ndarray, sure: float = SURE) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(label, rows, their probabilities) that a view is sure of, without those of which the other view is as sure of the opposite."""
    out = []
    for label, p, against in ((1.0, mine, other <= 1 - sure), (0.0, 1 - mine, other >= sure)):
        rows = np.flatnonzero((p >= sure) & ~against)
        out.append((label, rows, p[rows]))
    return out


def candidates(docs: DataFrame, views: list[View], sure: float = SURE) -> DataFrame:
    """(doc_id, view, label, p): what each view is sure of among all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 512):
                batch = big.slice(at, 512)
                scores = [view.score(x) for view, x in zip(views, matrices(batch))]
                ids = batch["doc_id"].to_numpy(zero_copy_only=False)
                for k in (0, 1):
                    for label, rows, p in handed_on(scores[k], scores[1 - k], sure):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[rows].astype(np.int64)), pa.array(np.full(len(rows), k), pa.int32()), pa.array(np.full(len(rows), label)), pa.array(p)],
                            ["doc_id", "view", "label", "p"])

    return docs.filter("doc_id is not null").select(*DOCUMENT).mapInArrow(run, "doc_id long, view int, label double, p double")


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, text_x, meta_x): one row per id, of its rows the one with the smallest hash of its text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, meta = matrices(batch)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([x.tobytes() for x in text], pa.binary()),
                                              pa.array([x.tobytes() for x in meta], pa.binary())], ["doc_id", "text_x", "meta_x"])

    one = docs.groupBy("doc_id").agg(F.min_by(F.struct(*DOCUMENT[1:]), F.xxhash64("text")).alias("d")).select("doc_id", "d.*")
    return one.mapInArrow(run, "doc_id long, text_x binary, meta_x binary")


def quality_marks(labels: DataFrame) -> DataFrame:
    """(marked, good): labels of one document averaged, from one half on it is good; null ones are left out."""
    return labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("marked")).agg(
        (F.avg("quality") >= 0.5).cast("int").alias("good"))


def sample(docs: DataFrame, marks: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """(doc_id, good, text_x, meta_x) of the bounded sample of labelled documents."""
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
    share = min(1.0, labelled / max(1, marks.count()))
    near = marks.filter(F.pmod(F.xxhash64(F.col("marked"), F.lit("sample")), F.lit(1 << 20)) / float(1 << 20) < share)
    chosen = docs.filter(place < share).select(*DOCUMENT).join(near.select("marked"), F.col("doc_id") == F.col("marked"), "left_semi")
    return features(chosen).join(near, F.col("doc_id") == F.col("marked")).select("doc_id", "good", "text_x", "meta_x")


def _matrix(rows: list, name: str, size: int) -> np.ndarray:
    return np.array([np.frombuffer(r[name], np.float32) for r in rows], np.float32).reshape(-1, size)


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, handed: int = HANDED, rounds: int = ROUNDS, sure: float = SURE) -> Model | None:
    """Co-trained model; every fifth labelled document (by hash) is held out for calibration and combination.

    None where the training or the held-out rows show one class only.
    """
    spark = docs.sparkSession
    marks = stage(quality_marks(labels), "marks")
    known = sorted(sample(docs, marks, labelled).collect(), key=lambda r: r["doc_id"])                 # bounded by ``labelled``
    held = np.array([xxhash.xxh32_intdigest(str(r["doc_id"])) % 5 == 0 for r in known], bool)
    y = np.array([r["good"] for r in known], float)
    if len(set(y[~held].tolist())) < 2 or len(set(y[held].tolist())) < 2:
        return None
    x = [_matrix(known, "text_x", TEXT_SIZE), _matrix(known, "meta_x", META_SIZE)]
    more = [x[0][:0], x[1][:0]]                                            # features each view has been handed
    given: list[list[tuple[int, float]]] = [[], []]                                                   # ids and labels each view has been handed

    def learn(k: int) -> View:
        return trained(np.concatenate((x[k][~held], more[k])), np.concatenate((y[~held], [label for _, label in given[k]])), x[k][held], y[held])

    now = [learn(0), learn(1)]
    for _ in range(rounds):
        found = candidates(docs, now, sure).groupBy("doc_id", "view", "label").agg(F.max("p").alias("p"))
        found = stage(found.join(marks, F.col("doc_id") == F.col("marked"), "left_anti"), "sure")
        new: list[list[tuple[int, float]]] = [[], []]
        for k in (0, 1):
            taken = spark.createDataFrame([(i,) for i, _ in given[1 - k]], "taken long")
            open_ = found.filter(F.col("view") == k).join(F.broadcast(taken), F.col("doc_id") == F.col("taken"), "left_anti")
            for label in (1.0, 0.0):
                best = open_.filter(F.col("label") == label).orderBy(F.desc("p"), "doc_id").limit(handed).collect()    # at most ``handed``
                new[1 - k] += [(r["doc_id"], label) for r in best]
        unstage(found)
        if not any(new):
            break
        ids = spark.createDataFrame([(i,) for i in sorted({i for some in new for i, _ in some})], "wanted long")
        rows = features(docs.join(F.broadcast(ids), F.col("doc_id") == F.col("wanted"), "left_semi")).collect()        # four times ``handed``
        by_id = {r["doc_id"]: r for r in rows}
        for k, (name, size) in enumerate((("text_x", TEXT_SIZE), ("meta_x", META_SIZE))):
            more[k] = np.concatenate((more[k], _matrix([by_id[i] for i, _ in new[k]], name, size)))
            given[k] += new[k]
        now = [learn(0), learn(1)]
    unstage(marks)
    stacked = np.column_stack([_logit(now[k].score(x[k][held])) for k in (0, 1)])
    w = fit(stacked / 10, y[held], penalty=1e-3, rate=0.1)
    return Model(now[0], now[1], (max(w[0] / 10, 0.0), max(w[1] / 10, 0.0), w[2]), len(given[0]) + len(given[1]))


def classified(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, handed: int = HANDED, keep: float = KEEP) -> DataFrame:
    """Per document: doc_id, text_score, meta_score, score (all 0 to 1), kept (score of at least ``keep``)."""
    model = train(docs, labels, labelled, handed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 512):
                batch = big.slice(at, 512)
                scores = model.score(*matrices(batch))
                yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(s, pa.float64()) for s in scores], pa.array(scores[2] >= keep)],
                                                 ["doc_id", "text_score", "meta_score", "score", "kept"])

    if model is None:
        none = F.lit(None).cast("double")
        return docs.select("doc_id", none.alias("text_score"), none.alias("meta_score"), none.alias("score"), F.lit(True).alias("kept"))
    return docs.select(*DOCUMENT).mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, kept boolean")
