"""Quality classifier: support vectors over naive-Bayes features.

A text's features are the distinct n-grams (one and two tokens) of its words and the
shapes of its words, hashed into ``BUCKETS``. Class log-count ratios scale the
indicators; a linear hinge-loss model over them is fitted by dual coordinate descent,
and a logistic curve through the margins makes scores.

The model is fitted on at most ``MAX_ROWS`` labelled rows, those with the smallest hash
of their id, each with all its features, and on fewer where these rows have more than
``MAX_FEATURES`` features together (an id whose rows have over a quarter of that is left out). Their ids and labels, so bounded, are broadcast to the scan of the documents:
no text is shuffled, and only the features of these rows reach the driver. The model is
one vector of BUCKETS numbers, broadcast to the workers, which score whole texts row by
row.

Defined results: a null text is an empty one, whose score is the curve at the bias;
training rows with a null label or id are left out; equal rows count as often as they
occur; with a single class, or none, every score is that class's share (0.5 for none);
an empty table gives an empty table; columns of the given names are replaced and others
kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ByteMemo, materialise, on_workers, table

BUCKETS = 1 << 18
MAX_ROWS = 6000
#: Features of all training rows together.
MAX_FEATURES = 12_000_000
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 30
SEED = 7
#: Bytes of hashes that a worker remembers.
WORD_CACHE = 32 << 20
U64 = np.uint64
UPPER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def shape_of(word: str) -> str:
    """Case and character classes of a word, runs shortened: ``Abc,`` is ``Xx,`` and ``ABC!!`` is ``X!!``."""
    made: list[str] = []
    for c in word:
        k = "x" if c.islower() else "X" if c.isupper() else "9" if c.isdigit() else c
        if not made or made[-1] != k or k not in "xX9":
            made.append(k)
    return "".join(made[:8])


def _hashes_of(word: str) -> bytes:
    digest = lambda x: hashlib.blake2b(x.encode(), digest_size=8).digest()
    return digest(word.lower()) + digest("\0" + shape_of(word))


class WordHashes(ByteMemo):
    """For each word, 16 bytes: the hash of its lower-case form and of its shape."""

    def __init__(self) -> None:
        super().__init__(_hashes_of, WORD_CACHE)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(31))) * U64(0x7FB5D329728EA185)
    x = (x ^ (x >> U64(27))) * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def features(text: str | None, memo: WordHashes) -> np.ndarray:
    """The sorted distinct buckets of a whole text; a repeated word pair has a bucket of its own."""
    words = text.split() if text else []
    if not words:
        return np.empty(0, dtype=np.int64)
    pairs = np.frombuffer(b"".join([memo[w] for w in words]), dtype=U64).reshape(-1, 2)
    plain, shape = pairs[:, 0], pairs[:, 1]
    echo = (plain[1:] == plain[:-1]).any()
    grams = [plain, shape, _mix(plain[:-1] * U64(3) + plain[1:]), _mix(shape[:-1] * U64(5) + shape[1:])]
    found = _mix(np.concatenate(grams)) % U64(BUCKETS - 1)
    return np.unique(np.append(found, U64(BUCKETS - 1)) if echo else found).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, found: np.ndarray) -> float:
        """Mean weight of the features, so that long texts compare with short ones, on the logistic curve."""
        margin = self.weights[found].sum() / np.sqrt(max(len(found), 1)) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))))


def descend(rows: list[np.ndarray], targets: np.ndarray, scale: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Dual coordinate descent for the hinge loss with one more constant feature; returns weights and bias."""
    w = np.zeros(len(scale) + 1)
    values = [np.append(scale[r], 1.0) for r in rows]
    places = [np.append(r, len(scale)) for r in rows]
    values = [v / np.append(np.full(len(v) - 1, np.sqrt(max(len(v) - 1, 1))), 1.0) for v in values]
    norms = np.array([v @ v for v in values])
    alpha, rng = np.zeros(len(rows)), np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            p, v, y = places[i], values[i], targets[i]
            new = min(max(alpha[i] + (1 - y * (w[p] @ v)) / norms[i], 0.0), cost[i])
            if (step := new - alpha[i]) != 0:
                w[p] += step * y * v
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


def _curve(margins: np.ndarray, targets: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through the margins, by Newton steps with a weak prior."""
    a, b, y = 1.0, 0.0, (targets > 0).astype(float)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([(margins * (p - y)).sum() + 1e-2 * (a - 1), (p - y).sum() + 1e-2 * b])
        r = p * (1 - p)
        h = np.array([[(r * margins**2).sum() + 1e-2, (r * margins).sum()], [(r * margins).sum(), r.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", training: Column | None = None, max_rows: int = MAX_ROWS) -> Model:
    """The model for the rows of ``labels`` (doc_id and a label of 0 or 1) where ``training`` (over ``_id``) holds."""
    on_workers(docs.sparkSession)
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).where("_id IS NOT NULL AND _y IN (0, 1)")
    chosen = known.where(F.lit(True) if training is None else training).orderBy(F.xxhash64("_id"), "_id", "_y").limit(max_rows)
    rows = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text")).join(F.broadcast(chosen), "_id").select(F.xxhash64("_id").alias("_h"), "_y", "_text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            found = [features(x.as_py(), memo).astype(np.int32) for x in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([batch.column("_h"), batch.column("_y").cast(pa.int64()), pa.array(found, pa.list_(pa.int32()))], names=["h", "y", "f"])

    drawn = materialise(rows.mapInArrow(hashed, "h long, y long, f array<int>"), "sample")
    sizes = drawn.groupBy("h").agg(F.sum(F.size("f") + 1).alias("n")).toArrow().sort_by("h")
    each = sizes.column("n").to_numpy()
    alone = each <= MAX_FEATURES // 4
    fits = alone & (np.cumsum(np.where(alone, each, 0)) <= MAX_FEATURES)
    if not fits.all():
        # whole rows, in the order of their hashes
        drawn = drawn.where(F.col("h").isin(sizes.column("h").to_numpy()[fits].tolist()))
    sample = drawn.toArrow().sort_by([("h", "ascending"), ("y", "ascending")])
    labelled = sample.column("y").to_numpy()
    size = np.bincount(labelled, minlength=2)
    if not size.all():
        share = size[1] / size.sum() if size.sum() else 0.5
        return Model(np.zeros(BUCKETS), 0.0, 1.0, float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    found = [np.asarray(x.values, dtype=np.int64) for x in sample.column("f")]
    sums = np.stack([np.bincount(np.concatenate([r for r, y in zip(found, labelled, strict=True) if y == k]), minlength=BUCKETS) for k in (0, 1)])
    rate = (sums + SMOOTHING) / (size[:, None] + 2 * SMOOTHING)
    scale = np.log(rate[1] / rate[0])
    targets = np.where(labelled == 1, 1.0, -1.0)
    # the rarer class weighs as much as the other
    weight = {s: COST * len(targets) / (2 * max((targets == s).sum(), 1)) for s in (-1.0, 1.0)}
    w = descend(found, targets, scale, np.array([weight[s] for s in targets]))
    model = Model(w[:-1] * scale, float(w[-1]), 1.0, 0.0)
    margins = np.array([model.weights[r].sum() / np.sqrt(max(len(r), 1)) + model.bias for r in found])
    model.slope, model.offset = _curve(margins, targets)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text, from 0 to 1."""
    on_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        if "memo" not in cache:
            cache["memo"] = WordHashes()
        return pa.array([shared.value.score(features(x.as_py(), cache["memo"])) for x in texts], type=pa.float64())

    cache: dict[str, WordHashes] = {}
    return docs.withColumn(into, run(F.col(f"`{text}`")))


def is_held_out(doc_id: str) -> Column:
    """Whether a row is held out; a null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; held-out rows are not learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), training=~is_held_out("_id"))
    return score(docs, model).select("doc_id", is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
