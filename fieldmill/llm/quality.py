"""Quality rules: counted base rules, then a calibrated n-gram classifier.

The classifier is a logistic regression on hashed word 1- and 2-grams and
character 4-grams, each family as shares of the document's n-grams.  It is
trained on a bounded sample of labelled documents (``SAMPLE`` rows; whole
texts), and its scores are mapped to probabilities on the sample's held-out
quarter (a two-parameter logistic fit).  All documents are then scored in
Arrow batches against a fixed threshold: one gather per n-gram, no dense
vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import Words, mix, ragged, slices, windows
from .shared import ship, table

BITS = 16  # features of each family
FAMILIES = 3
SAMPLE = 2000
THRESHOLD = 0.5
ROUNDS, RATE, DECAY = 80, 0.5, 1e-7
MIN_WORDS, MAX_REPEAT = 50, 50

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = 1


def _per_doc(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive cuts."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[cuts[1:]] - total[cuts[:-1]]


def _windows_of(cuts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First item of every ``n``-item window inside one document, and the
    window cuts of the documents."""
    count = np.maximum(np.diff(cuts) - n + 1, 0)
    return np.repeat(cuts[:-1], count) + ragged(count), np.concatenate([[0], np.cumsum(count)])


def base_counts(words: Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words per document."""
    data, n_docs = words.data, len(words.bounds) - 1
    starts_char = (data & 0xC0) != 0x80
    solid = np.zeros(len(data) + 1, np.int8)
    np.add.at(solid, words.start, 1)
    np.add.at(solid, words.end, -1)
    in_word = np.cumsum(solid[:-1]) > 0
    h, (first, cuts) = words.hashes(), _windows_of(words.doc, 3)
    which = np.repeat(np.arange(n_docs), np.diff(cuts))
    key = mix(windows(h, 3)[first] ^ mix(which.astype(np.uint64)))
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    at = first[count[inverse] > 1]
    over = np.zeros(len(h) + 1, np.int64)
    np.add.at(over, at, 1)
    np.add.at(over, at + 3, -1)
    raw = data.tobytes()
    dup = []
    for a, b in zip(words.bounds[:-1], words.bounds[1:]):
        lines = [line for line in raw[a:b].split(b"\n") if line.strip()]
        dup.append(len(lines) - len(set(lines)))
    return {"n_words": np.diff(words.doc), "word_chars": _per_doc(in_word & starts_char, words.bounds),
            "n_symbols": _per_doc(_SYMBOL[data], words.bounds), "n_dup_lines": np.array(dup, np.int64),
            "n_repeat_words": _per_doc(np.cumsum(over)[:-1] > 0, words.doc)}


def features(words: Words):
    """(feature ids, document cuts) of each family."""
    shift = np.uint64(64 - BITS)
    h = words.hashes()
    yield h >> shift, words.doc
    first, cuts = _windows_of(words.doc, 2)
    yield windows(h, 2)[first] >> shift, cuts
    chars = np.frombuffer(words.data.tobytes().decode().encode("utf-32-le"), "<u4")
    upto = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
    first, cuts = _windows_of(upto[words.bounds], 4)
    yield windows(mix(chars.astype(np.uint64)), 4)[first] >> shift, cuts


class Model:
    """Weights per family, bias, calibration; scores whole documents."""

    def __init__(self, weights: np.ndarray, bias: float, scale: float = 1.0, shift: float = 0.0):
        self.weights, self.bias, self.scale, self.shift = weights.astype(np.float32), bias, scale, shift

    def probability(self, words: Words) -> np.ndarray:
        z = np.full(len(words.bounds) - 1, self.bias)
        for w, (ids, cuts) in zip(self.weights, features(words)):
            z += _per_doc(w[ids].astype(np.float64), cuts) / np.maximum(np.diff(cuts), 1)
        return _logistic(self.scale * z + self.shift)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sparse(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per document: (feature ids over all families, their shares)."""
    out = []
    for i, j, words in slices(column):
        rows = [([], []) for _ in range(j - i)]
        for f, (ids, cuts) in enumerate(features(words)):
            for d in range(j - i):
                u, n = np.unique(ids[cuts[d]:cuts[d + 1]], return_counts=True)
                rows[d][0].append(u.astype(np.int32) + (f << BITS))
                rows[d][1].append((n / max(1, n.sum())).astype(np.float32))
        out += [(np.concatenate(a), np.concatenate(b)) for a, b in rows]
    return out


def fit(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray) -> Model | None:
    """Train on three quarters, calibrate on the rest; classes weigh the same.
    None if a class is missing (nothing can be learnt, nothing is rejected)."""
    if not len(label) or label.min() == label.max():
        return None
    held = np.arange(len(label)) % 4 == 3
    if label[~held].min() == label[~held].max():
        held[:] = False
    ids = [r[0] for r, out in zip(rows, held) if not out]
    row = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    idx, val = np.concatenate(ids), np.concatenate([r[1] for r, out in zip(rows, held) if not out])
    y = label[~held].astype(float)
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, bias = np.zeros(FAMILIES << BITS), 0.0
    past, past_b = np.full_like(w, 1e-12), 1e-12
    for _ in range(ROUNDS):  # full-batch gradient with per-feature step sizes: rare n-grams learn as fast
        z = np.bincount(row, val * w[idx], len(ids)) + bias
        g = weight * (_logistic(z) - y)
        grad = np.bincount(idx, val * g[row], len(w)) + DECAY * w
        past += grad * grad
        past_b += g.sum() ** 2
        w, bias = w - RATE * grad / np.sqrt(past), bias - RATE * g.sum() / np.sqrt(past_b)
    w = w.reshape(FAMILIES, -1)
    scores = np.array([bias + (w.ravel()[i] * v).sum() for i, v in rows])
    scale, shift = _calibrate(scores[held], label[held])
    return Model(w, bias, scale, shift)


def _calibrate(z: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Logistic fit of held-out labels on scores, with smoothed targets."""
    n1, n0 = (label > 0).sum(), (label <= 0).sum()
    if not n1 or not n0:
        return 1.0, 0.0
    y = np.where(label > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps
        p = _logistic(a * z + b)
        v = p * (1 - p) + 1e-9
        g = np.array([((p - y) * z).sum() + 1e-3 * (a - 1), (p - y).sum()])
        hess = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(hess, g)
        step = np.clip(step, -1, 1)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return (a, b) if a > 0 and np.isfinite(a + b) else (1.0, 0.0)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", sample: int = SAMPLE) -> Model | None:
    """Model of at most ``sample`` labelled documents: those with the smallest
    id hashes.  Rows without id or label are left out; of several labels or
    texts under one id the smallest label and the text of the smallest hash
    count."""
    ship(docs.sparkSession)
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()) \
        .select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label")) \
        .groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    labelled = texts.join(F.broadcast(chosen), "id").groupBy("id", "label") \
        .agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))  # at most ``sample`` rows

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                rows = _sparse(part.column(2))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([a.tobytes() for a, _ in rows], pa.binary()),
                     pa.array([b.tobytes() for _, b in rows], pa.binary())], names=["id", "label", "ids", "shares"])

    got = labelled.mapInArrow(run, "id long, label long, ids binary, shares binary").collect()
    got.sort(key=lambda r: (r.id, r.label, bytes(r.ids)))
    order = np.random.Generator(np.random.PCG64(7)).permutation(len(got))
    rows = [(np.frombuffer(bytes(got[i].ids), np.int32), np.frombuffer(bytes(got[i].shares), np.float32)) for i in order]
    return fit(rows, np.array([got[i].label for i in order]))


def score_documents(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, quality (probability, null without a model)
    and kept.

    base_failed: fewer than 50 words, or over half of them in 3-word windows
    that occur twice.  kept: not base_failed and quality >= ``threshold``.
    Null and empty texts have no words and fail; repeated rows and null ids
    are judged like any other; an empty table gives no rows; other columns are
    not read.
    """
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for i, j, words in slices(batch.column(1)):
                c = base_counts(words)
                failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT * c["n_words"])
                p = model.probability(words) if model else np.ones(j - i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), *(pa.array(v, pa.int64()) for v in c.values()),
                     pa.array(failed), pa.array(p if model else [None] * (j - i), pa.float64()),
                     pa.array(~failed & (p >= threshold))],
                    names=["id", *c, "base_failed", "quality", "kept"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
             "base_failed boolean, quality double, kept boolean").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: Model | None, text_col: str = "text",
              threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``score_documents`` keeps."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            keep = [np.zeros(0, bool)]
            for _, _, words in slices(batch.column(at)):
                c = base_counts(words)
                good = (c["n_words"] >= MIN_WORDS) & (100 * c["n_repeat_words"] <= MAX_REPEAT * c["n_words"])
                keep.append(good & (model.probability(words) >= threshold) if model else good)
            yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: all documents, trained on the labels of the same folder."""
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels"))).drop("quality")
