"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams.

The features of a text are its distinct words, word pairs and pairs that skip a
word, each hashed to one of SIZE places.  FTRL-proximal keeps a learning rate for
each coordinate, and its L1 term leaves most weights at zero, so the weights that are
broadcast are a few hundred numbers.  Toxic texts are rare, so their gradients count
as often as there are other texts for each of them, at most MOST_BALANCE times.

The fit runs over a bounded sample of the labelled training rows (MOST_ROWS, and
MOST_PLACES features, by the order of a hash) in one task, which reads them one after
the other; scoring covers every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import answers, documents, fold, labels
from .textbatch import joined, mix, prefix_hash, range_hash, slices

BITS = 20
SIZE = 1 << BITS
#: Bounds of the training sample: rows, and features of all its rows together.
MOST_ROWS, MOST_PLACES = 16_000, 50_000_000
#: Chosen by cross-validation among the labels of the training folds.
EPOCHS, ALPHA, BETA, L1, L2 = 5, 2.0, 1.0, 20.0, 0.1
MOST_BALANCE = 10.0
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Place and row of every word, pair and skip pair; repeats included."""
    data, offsets = joined([t.lower() for t in texts])
    edge = np.flatnonzero(np.diff(np.concatenate([[False], _WORD[data], [False]]).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    row = np.searchsorted(offsets, start, "right") - 1
    h = range_hash(prefix_hash(data), start, end)
    out, of = [h], [row]
    for gap, salt in ((1, 0x2545F491), (2, 0x5851F42D)):
        same = row[gap:] == row[:-gap] if len(row) > gap else np.zeros(0, bool)
        pair = mix(h[:-gap] * np.uint64(5) + mix(h[gap:] + np.uint64(salt))) if len(row) > gap else np.zeros(0, np.uint64)
        out.append(pair[same])
        of.append(row[:-gap][same] if len(row) > gap else np.zeros(0, np.int64))
    return (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(of)


def balance(y: np.ndarray) -> float:
    """How often a row of label 1 counts: rows of label 0 for each of label 1, from 1 to MOST_BALANCE."""
    return float(np.clip((y == 0).sum() / max(1, (y == 1).sum()), 1.0, MOST_BALANCE))


def ftrl(rows: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, positive: float = 1.0) -> np.ndarray:
    """Weights after passes over rows of distinct places, in the given order; gradients of label 1 count `positive` times."""
    z, n = np.zeros(SIZE), np.zeros(SIZE)

    def weight(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    bias = np.array([SIZE - 1])
    for _ in range(epochs):
        for i, label in zip(rows, y, strict=True):
            i = np.union1d(i, bias)
            w = weight(i)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = (p - label) * (positive if label == 1 else 1.0)
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    return weight(np.arange(SIZE))


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = pdf["text"].fillna("").tolist()
        for a, b in slices([len(t) for t in texts]):
            place, row = features(texts[a:b])
            key = np.unique(row * SIZE + place)
            parts = np.split((key % SIZE).astype(np.int32), np.searchsorted(key, np.arange(1, b - a) * SIZE))
            own = pdf.iloc[a:b]
            yield pd.DataFrame({"id": own["id"].to_numpy(), "ord": own["ord"].to_numpy(), "label": own["label"].to_numpy(), "places": [p.tobytes() for p in parts]})


def _fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows, y, held = [], [], 0
    for pdf in batches:
        for label, places in zip(pdf["label"], pdf["places"], strict=True):
            held += len(places) // 4
            if held <= MOST_PLACES:
                rows.append(np.frombuffer(places, np.int32).astype(np.int64))
                y.append(label)
    labels = np.array(y, float)
    w = ftrl(rows, labels, positive=balance(labels))
    at = np.flatnonzero(w)
    yield pd.DataFrame({"place": at, "weight": w[at]})


def learn(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> np.ndarray:
    """Dense weights; with no labelled row all are zero, and every score is one half.

    Rows with a null id or label are passed over.  Of an id with several labels the
    greatest counts, and of several rows of docs with that id the one of the least hash.
    """
    known = labelled.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(label_col).cast("double")).alias("label"))
    sample = known.orderBy(F.xxhash64(id_col), id_col).limit(MOST_ROWS).select(F.col(id_col).alias("_id"), "label")
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = slim.join(F.broadcast(sample), F.col("id") == F.col("_id")).select("id", "text", "label", F.xxhash64(F.lit(7), "id").alias("ord"))
    kind = dict(slim.dtypes)["id"]
    hashed = rows.mapInPandas(_hashed, f"id {kind}, ord long, label double, places binary")
    one = hashed.groupBy("id", "ord").agg(F.min_by(F.struct("label", "places"), F.xxhash64("places")).alias("r")).select("id", "ord", "r.*")
    fitted = one.repartition(1).sortWithinPartitions("ord", "id").select("label", "places").mapInPandas(_fitted, "place long, weight double").toPandas()  # sparse, at most SIZE rows
    w = np.zeros(SIZE, np.float32)
    w[fitted["place"].to_numpy(np.int64)] = fitted["weight"].to_numpy()
    return w


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of each row; null counts as the empty text, scored by the constant alone.

    Each row is scored on its own text, so equal texts score the same and repeated ids
    play no part.  Other columns are ignored; an empty table gives no row.
    """
    at = np.flatnonzero(weights)
    shared = docs.sparkSession.sparkContext.broadcast((at, weights[at]))
    dense: list[np.ndarray] = []

    def scored(texts: list[str]) -> list:
        if not dense:
            dense.append(np.zeros(SIZE, np.float32))
            dense[0][shared.value[0]] = shared.value[1]
        w = dense[0]
        place, row = features(texts)
        hit = (w[place] != 0) & (place != SIZE - 1)
        key = np.unique(row[hit] * SIZE + place[hit])
        total = np.bincount(key // SIZE, weights=w[key % SIZE], minlength=len(texts)) + w[SIZE - 1]
        return [1 / (1 + np.exp(-np.clip(total, -35, 35)))]

    return answers(docs, id_col, text_col, {"score": "double"}, lambda: scored)


def op6_toxicity_ftrl(spark, sf_dir):
    docs = documents(spark, sf_dir)
    weights = learn(docs, labels(spark, sf_dir).where(fold("doc_id", 3) != 1))
    out = score(docs, weights)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
