"""Quality classifier by compression: two zstandard dictionaries, one trained on good and one on bad labelled text.

A text is cut into blocks of ``BLOCK`` bytes, all of which are compressed with either dictionary. The sum of the sizes
under the bad one less that under the good one, over the sum of both, is the normalised size difference. A logistic
curve fitted on labelled texts that the dictionaries haven't seen turns it, together with the compressed share of the
bytes (which shows repetition), into a calibrated probability of label 1.

Bounds of what is fitted on, all documented parameters: at most ``rows`` labelled rows a class (those with the smallest
hash of their id), of which texts over ``max_bytes`` are left out (they are scored whole all the same); every second one
goes to the dictionaries, the others to the curve. There, a row weighs as many as its class has labels for each of its
rows, so the probability follows the labels' shares, whatever the bounds leave of a class.

Defined cases: a null text scores as an empty one, whose features are 0; texts are scored whole, however long; repeated
rows score alike; an id with both labels counts as 0; without labels of both classes every score is the share of label 1
(0.5 without any label); an empty table gives no rows. Only the text enters a score, and a score is a column under a name
of the caller's, so no name can clash.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import utf8

BLOCK = 2048
LEVEL = 3
DICTIONARY_BYTES = 64 << 10
ROWS = 2000
MAX_BYTES = 32_768
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    level: int
    block: int
    #: Means, scales and weights of the features; the last weight is the intercept.
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    prior: float


@lru_cache(maxsize=4)
def _compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    kept = zstandard.ZstdCompressionDict(dictionary)
    kept.precompute_compress(level=level)
    return zstandard.ZstdCompressor(
        dict_data=kept, compression_params=None, level=level, write_checksum=False, write_content_size=False, write_dict_id=False
    )


def features(raw: bytes | None, good: bytes, bad: bytes, level: int = LEVEL, block: int = BLOCK) -> tuple[float, float, float]:
    """(normalised size difference, compressed share, their product) of one whole text."""
    if not raw:
        return 0.0, 0.0, 0.0
    by_good, by_bad = _compressor(good, level), _compressor(bad, level)
    g = b = 0
    for i in range(0, len(raw), block):
        part = raw[i : i + block]
        g += len(by_good.compress(part))
        b += len(by_bad.compress(part))
    difference, share = (b - g) / (b + g), min(g, b) / len(raw)
    return difference, share, difference * share


def _dictionary(samples: list[bytes], block: int, size: int) -> bytes:
    parts = [s[i : i + block] for s in samples for i in range(0, len(s), block)]
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:
        # Too little text to train on: the text itself is the dictionary.
        joined = b"".join(parts)[-size:]
        return joined if len(joined) >= 8 else joined.ljust(8)


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted logistic regression by Newton's method with a small ridge."""
    mean, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    # The intercept isn't drawn to 0, so that the mean probability is the weighted share of label 1.
    ridge = np.diag([1.0] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (weight * p * (1 - p))[:, None]) + ridge, z.T @ (weight * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return mean, scale, w


def fit(
    documents: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    rows: int = ROWS,
    max_bytes: int = MAX_BYTES,
    level: int = LEVEL,
    block: int = BLOCK,
    dictionary_bytes: int = DICTIONARY_BYTES,
) -> Model:
    """Fits on labels as given; leave held-out rows out of `labels` before. `rows` and `max_bytes` bound the sample."""
    ids = (
        labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"))
        .filter("i is not null and y in (0, 1)")
        .groupBy("i")
        .agg(F.min("y").alias("y"))
        .withColumn("h", F.xxhash64("i"))
    )
    # At most 2 * rows ids: a bounded side.
    chosen = [ids.filter(f"y = {y}").orderBy("h", "i").limit(rows) for y in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])
    texts = documents.select(F.col(id_col).alias("i"), utf8(F.col(text_col)).alias("t"))
    sample = (
        texts.filter(F.length("t").between(1, max_bytes))
        .join(F.broadcast(chosen), "i")
        .orderBy("h", "i", "t")
        .limit(2 * rows)
        .collect()
    )
    kept = {y: [bytes(r.t) for r in sample if r.y == y] for y in (0, 1)}
    # Two rows: how many labels either class has.
    labelled = {0: 0, 1: 0} | {r.y: r.n for r in ids.groupBy("y").agg(F.count("*").alias("n")).collect()}
    prior = (labelled[1] + 1) / (labelled[0] + labelled[1] + 2)
    if min(len(kept[0]), len(kept[1])) < 2:
        return Model(b"", b"", level, block, (), (), (), prior)
    bad, good = (_dictionary(kept[y][::2], block, dictionary_bytes) for y in (0, 1))
    held = [(t, y) for y in (0, 1) for t in kept[y][1::2]]
    x, y = np.array([features(t, good, bad, level, block) for t, _ in held]), np.array([float(y) for _, y in held])
    weight = np.where(y == 1, labelled[1] / max(1, y.sum()), labelled[0] / max(1, (1 - y).sum()))
    mean, scale, w = _curve(x, y, weight * len(y) / weight.sum())
    return Model(good, bad, level, block, tuple(mean), tuple(scale), tuple(w), prior)


def score_text(model: Model, raw: bytes | None) -> float:
    if not model.weights:
        return model.prior
    x = features(raw, model.good, model.bad, model.level, model.block)
    z = sum(w * (v - m) / s for w, v, m, s in zip(model.weights, x, model.mean, model.scale, strict=False))
    return float(1 / (1 + np.exp(-np.clip(z + model.weights[-1], -30, 30))))


def score(model: Model, text: Column) -> Column:
    """Probability of label 1 of each whole text."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array([score_text(model, raw) for raw in texts.to_pylist()], pa.float64())

    return scored(utf8(text))


def held_out(doc_id: Column) -> Column:
    """Every fifth id by its CRC-32; a null id isn't held out and never learnt from."""
    return F.coalesce(F.crc32(utf8(doc_id)) % 5 == 0, F.lit(False))


def fit_on_train(documents: DataFrame, labels: DataFrame, **options) -> Model:
    return fit(documents, labels.filter(~held_out(F.col("doc_id"))), **options)
