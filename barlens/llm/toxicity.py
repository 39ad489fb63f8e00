"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Every coordinate has its own learning rate, and the L1 term keeps most weights at exactly 0, so that the model
sent to the executors is a short list of (feature, weight).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlens.llm.util import keep, mix, owners, slices, word_hashes

#: Bits of a feature's number: 4 million coordinates, 16 MB of weights while training.
BITS = 22
#: Bounds of the training sample: texts of each class, and bytes of text in all.
SAMPLE, SAMPLE_BYTES = 4000, 32 << 20
ALPHA, BETA, L2, EPOCHS = 1.0, 1.0, 0.05, 8
#: The L1 term: one for so many texts of the rarer class, within these bounds.
L1_TEXTS, L1_RANGE = 200, (1.0, 8.0)

# Distances of the words that a feature joins: single words, pairs, triples, and pairs with a gap.
_KINDS = ((), (1,), (1, 2), (2,), (3,))


@dataclass(frozen=True)
class Model:
    """Features with a weight other than 0, sorted, their weights and the intercept."""

    features: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    intercept: float = -2.0


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts, and the text that each is from; repeated ones are still there."""
    h, stops = word_hashes(texts)
    owner = owners(stops)
    out, of = [], []
    for k, gaps in enumerate(_KINDS):
        n = len(h) - max(gaps, default=0)
        if n <= 0:
            continue
        v = h[:n] * np.uint64(2 * k + 3)
        for j, g in enumerate(gaps):
            v = v + mix(h[g : g + n] + np.uint64(j + 1))
        within = owner[:n] == owner[len(h) - n :] if gaps else np.ones(n, bool)
        out.append((mix(v[within]) >> np.uint64(64 - BITS)).astype(np.int64))
        of.append(owner[:n][within])
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(of)


def train(texts: list[str], labels: list[int], prior: float) -> Model:
    """Fit on texts in the order given; `prior` is the share of label 1 among all labelled rows."""
    if not 0 < sum(labels) < len(labels):
        return Model(intercept=30.0 if labels and sum(labels) else -30.0) if labels else Model()
    own = []
    for lo in range(0, len(texts), 64):
        f, of = features(texts[lo : lo + 64])
        pair = np.unique((of << BITS) | f)
        cut = np.searchsorted(pair >> BITS, np.arange(1, len(texts[lo : lo + 64])))
        own += [(x & ((1 << BITS) - 1)).astype(np.int32) for x in np.split(pair, cut)]
    l1 = float(np.clip(min(sum(labels), len(labels) - sum(labels)) / L1_TEXTS, *L1_RANGE))
    z, n = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32)
    zb = nb = 0.0
    for _ in range(EPOCHS):
        for f, y in zip(own, labels, strict=True):
            zf, nf = z[f], n[f]
            w = np.where(np.abs(zf) <= l1, 0, -(zf - np.sign(zf) * l1) / ((BETA + np.sqrt(nf)) / ALPHA + L2))
            wb = -zb / ((BETA + nb**0.5) / ALPHA + L2)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + wb, -35, 35)))
            g = p - y
            z[f] = zf + g - (np.sqrt(nf + g * g) - np.sqrt(nf)) / ALPHA * w
            n[f] = nf + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / ALPHA * wb
            nb += g * g
    at = np.flatnonzero(np.abs(z) > l1)
    w = -(z[at] - np.sign(z[at]) * l1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
    model = Model(at, w.astype(np.float64), float(-zb / ((BETA + nb**0.5) / ALPHA + L2)))
    return calibrate(model, np.concatenate([logits(model, texts[lo : lo + 64]) for lo in range(0, len(texts), 64)]), np.array(labels), prior)


def calibrate(model: Model, s: np.ndarray, y: np.ndarray, prior: float) -> Model:
    """Scale and shift the scores to fit the labels, each class weighted as often as it is among all rows."""
    share = y.mean()
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    x, v = np.stack([s, np.ones_like(s)], axis=1), np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -35, 35)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        v = v - np.linalg.solve(h, x.T @ (weight * (p - y)) + 0.1 * (v - [1.0, 0.0]))
    if not (np.isfinite(v).all() and v[0] > 0):
        return model
    return Model(model.features, model.weights * v[0], model.intercept * float(v[0]) + float(v[1]))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on the rows of `labels` that have a text in `df`.

    Null ids, texts and labels are left out; of an id that occurs more than once one text and the higher label
    count. Training takes the ids of lowest hash, at most SAMPLE of each class and SAMPLE_BYTES of text in all.
    """
    marked = labels.select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("y")).dropna().groupBy("id").agg(F.max("y").alias("y"))
    marked = marked.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / F.lit(float(1 << 40)))
    counts = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    if not counts:
        return Model()
    limit = F.lit(0.0)
    for y, c in counts.items():
        limit = F.when(F.col("y") == y, F.lit(SAMPLE / c)).otherwise(limit)
    chosen = marked.where(F.col("h") < limit)
    # Hinted, here and below: about SAMPLE ids of each class.
    rows = keep(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).dropna().join(F.broadcast(chosen), "id").groupBy("id", "y", "h").agg(F.min("text").alias("text")), "sample")
    # Texts of over a 32nd of the bytes come last: one very long text leaves room for the others. Only lengths meet in one task.
    own = F.col("bytes") > SAMPLE_BYTES // 32
    size = F.sum("bytes").over(Window.orderBy(own, "h", "id").rowsBetween(Window.unboundedPreceding, 0))
    fitting = rows.select("id", "h", F.octet_length("text").cast("bigint").alias("bytes")).withColumn("size", size).where(F.col("size") <= SAMPLE_BYTES).select("id")
    found = rows.join(F.broadcast(fitting), "id").select("h", "id", "text", "y").collect()
    found.sort(key=lambda r: (r["h"], r["id"]))
    return train([r["text"] for r in found], [r["y"] for r in found], counts.get(1, 0) / sum(counts.values()))


def logits(model: Model, texts: list[str | None]) -> np.ndarray:
    """The sum of weights for each text; a text without words gets the intercept."""
    out = np.full(len(texts), model.intercept)
    f, of = features(texts)
    if len(f) and len(model.features):
        at = np.minimum(np.searchsorted(model.features, f), len(model.features) - 1)
        hit = model.features[at] == f
        pair = np.unique((of[hit] << BITS) | f[hit])
        np.add.at(out, pair >> BITS, model.weights[np.searchsorted(model.features, pair & ((1 << BITS) - 1))])
    return out


def scores(model: Model, texts: list[str | None]) -> np.ndarray:
    """The probability of label 1 for each text."""
    return 1 / (1 + np.exp(-np.clip(logits(model, texts), -35, 35)))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every text: (id, score, predicted), one row per row of `df`.

    Null and empty texts get the intercept's score; repeated rows and null ids give rows of their own; other
    columns are not read.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                p = scores(sent.value, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(p), pa.array((p >= 0.5).astype("int32"))], ["doc_id", "score", "predicted"])

    kind = dict(df.dtypes)[id_col]
    return df.selectExpr(f"`{id_col}` AS id", f"CAST(`{text_col}` AS string) AS text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def keep_clean(df: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of `df` whose text scores under the limit, all columns as they were."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxic(texts):
        import pandas as pd

        many = texts.tolist()
        return pd.Series(np.concatenate([scores(sent.value, many[lo : lo + 64]) for lo in range(0, len(many), 64)] or [np.zeros(0)]))

    return df.where(toxic(F.col(text_col).cast("string")) < limit)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of its id modulo 5 is 0. False for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
