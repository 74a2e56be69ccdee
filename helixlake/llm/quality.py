"""Quality scores by positive-unlabelled learning with a non-negative unbiased risk.

The scorer g is linear in features of a text's form: rates of pairs of character
classes, repetition of words and lines, word lengths, and rates of words by hash.
With the squared loss every term of the risk

    prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1))

is a quadratic form in the second moments of the features over the positives and
over the unlabelled texts.  One distributed pass sums these moments (a table of fixed
size); the risk is then minimised exactly on the driver.  (g + 1) / 2 estimates the
probability of label 1.

Positives are labelled rows of the training folds, at most MOST_POSITIVES of them,
by the order of a hash; every document counts as unlabelled text.  Labels of 0 are
not used.  The class prior is estimated from the same moments: it is the share of the
positives' density in the density of all texts that leaves the least Pearson divergence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import answers, documents, fold, labels, single_threaded
from .textbatch import joined, mix, prefix_hash, range_hash, slices, words

MOST_POSITIVES = 20_000
RIDGE = 1e-4
#: Classes of bytes: kinds of ASCII, then UTF-8 continuations and lead bytes by the length and range that they begin.
ASCII = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",;:", "!?", "|", "#", "$%", "&", "*", "\"'()[]{}<>/\\", "-_=+~^@`"]
LEADS = [0x80, 0xC0, 0xD0, 0xE0, 0xF0]
CLASSES = len(ASCII) + len(LEADS)
_CLASS = np.zeros(256, np.uint8)
for _k, _of in enumerate(ASCII):
    _CLASS[[ord(c) for c in _of]] = _k
for _k, _from in enumerate(LEADS):
    _CLASS[_from:] = len(ASCII) + _k
PAIRS, WORD_BITS, EXTRA = CLASSES * CLASSES, 6, 12
SIZE = PAIRS + (1 << WORD_BITS) + EXTRA


def features(texts: list[str]) -> np.ndarray:
    """A row of SIZE numbers, mostly between 0 and 1, for each text; a text without words has the constant alone."""
    n = len(texts)
    data, offsets = joined(texts)
    length = np.maximum(1, np.diff(offsets) - 1).astype(float)
    row = np.repeat(np.arange(n), np.diff(offsets))
    kind = _CLASS[data].astype(np.int64)
    pair = row[:-1] * PAIRS + kind[:-1] * CLASSES + kind[1:]
    pairs = np.bincount(pair[row[1:] == row[:-1]], minlength=n * PAIRS).reshape(n, PAIRS)
    out = np.zeros((n, SIZE))
    out[:, :PAIRS] = np.sqrt(pairs / length[:, None])
    start, end, of = words(data, offsets)
    prefix = prefix_hash(data)
    h = range_hash(prefix, start, end)
    count = np.bincount(of, minlength=n).astype(float)
    total = np.maximum(1, count)
    size = (end - start).astype(float)
    mean = lambda x: np.bincount(of, weights=x, minlength=n) / total

    def distinct(h: np.ndarray, of: np.ndarray) -> np.ndarray:
        order = np.lexsort((h, of))
        new = np.ones(len(order), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
        return np.bincount(of[order][new], minlength=n).astype(float)

    by_word = of * (1 << WORD_BITS) + (h >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    out[:, PAIRS : PAIRS + (1 << WORD_BITS)] = np.sqrt(np.bincount(by_word, minlength=n << WORD_BITS).reshape(n, -1) / total[:, None])
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    alone = mean((size == 1).astype(float))
    two = mix(h[:-1] * np.uint64(3) + mix(h[1:]))[of[1:] == of[:-1]]
    two_of = of[:-1][of[1:] == of[:-1]]
    breaks = np.flatnonzero(data == 10)
    line_start = np.concatenate([[0], breaks[:-1] + 1])
    line_of = np.searchsorted(offsets, breaks, "right") - 1
    lines = np.maximum(1, np.bincount(line_of, minlength=n)).astype(float)
    long = np.log1p(size)
    extra = [
        mean(again), np.sqrt(mean(again)), distinct(h, of) / total, distinct(two, two_of) / np.maximum(1, np.bincount(two_of, minlength=n)),
        alone, np.sqrt(alone), mean(long) / 3, np.sqrt(np.maximum(0, mean(long * long) - mean(long) ** 2)), np.log1p(count) / 10,
        distinct(range_hash(prefix, line_start, breaks), line_of) / lines, np.minimum(1, count / lines / 100), np.ones(n),
    ]
    for k, x in enumerate(extra):
        out[:, SIZE - EXTRA + k] = x
    out[count == 0, : SIZE - 1] = 0
    return out


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros((2, SIZE, SIZE))
    for pdf in batches:
        texts, positive = pdf["text"].fillna("").tolist(), pdf["positive"].to_numpy(bool)
        for a, b in slices([len(t) for t in texts]):
            x = features(texts[a:b])
            total[0] += x.T @ x
            total[1] += (xp := x[positive[a:b]]).T @ xp
    yield pd.DataFrame({"part": [TaskContext.get().partitionId() % 16], "sums": [total.tobytes()]})


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, float) for x in pdf["sums"])
    return pd.DataFrame({"part": pdf["part"].iloc[:1], "sums": [total.tobytes()]})


def moments(docs: DataFrame, positives: DataFrame, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Sums of x x' over all documents and over the positives.  The constant feature makes them hold counts and sums too."""
    single_threaded(docs.sparkSession)
    flag = positives.select(F.col(id_col).alias("_id")).distinct().withColumn("positive", F.lit(True))
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = slim.join(F.broadcast(flag), F.col("id") == F.col("_id"), "left").select("text", F.coalesce("positive", F.lit(False)).alias("positive"))
    kind = "part int, sums binary"
    parts = rows.mapInPandas(_moments, kind).groupBy("part").applyInPandas(_added, kind).collect()  # at most 16 rows of a fixed size
    both = sum((np.frombuffer(r["sums"], float) for r in parts), np.zeros(2 * SIZE * SIZE)).reshape(2, SIZE, SIZE)
    return both[0], both[1]


def inverse(a: np.ndarray) -> np.ndarray:
    """The inverse of a symmetric positive definite matrix of a few hundred rows, by elimination in one thread."""
    out = a.copy()
    for i in range(len(out)):
        row = out[i] / out[i, i]
        row[i] = 1 / out[i, i]
        column = out[:, i].copy()
        column[i] = 0
        out -= column[:, None] * row
        out[:, i] = -column * row[i]
        out[i] = row
    return out


def minimise(unlabelled: np.ndarray, positive: np.ndarray, prior: float, rounds: int = 200) -> np.ndarray:
    """Weights of least non-negative risk.  Each round takes a Newton step of the whole
    risk, or, while the part that must not be negative is, a step back up along it."""
    nu, np_ = unlabelled[-1, -1], positive[-1, -1]
    if not nu or not np_:
        w = np.zeros(len(unlabelled))
        w[-1] = 2 * prior - 1
        return w
    gu, gp = unlabelled / nu, positive / np_
    mu, mp = gu[-1], gp[-1]
    solve = inverse(gu / 2 + np.eye(len(gu)) * RIDGE)
    times = lambda a, v: (a * v).sum(-1)  # noqa: E731  (products this small are not worth threads)
    w = np.zeros(len(gu))
    for _ in range(rounds):
        u, p = times(gu, w), times(gp, w)
        negative = (times(u, w) + 2 * times(w, mu) + 1) / 4 - prior * (times(p, w) + 2 * times(w, mp) + 1) / 4
        slope_n = (u + mu) / 2 - prior * (p + mp) / 2
        if negative >= 0:
            step = -times(solve, slope_n + prior * (p - mp) / 2 + RIDGE * w)
        else:
            step = 0.5 * times(solve, slope_n)
        w = w + 0.5 * step
        if np.abs(step).max() < 1e-9:
            break
    return w


def estimated_prior(unlabelled: np.ndarray, positive: np.ndarray) -> float:
    """The share of the class in the unlabelled texts, from second moments (the constant last).

    Of shares t, the Pearson divergence from t times the positives' density to that of all
    texts is least at 1 / h' H^-1 h, with H the second moments of all and h the means of
    the positives.  One half where there is nothing to tell from.
    """
    nu, np_ = unlabelled[-1, -1], positive[-1, -1]
    if not nu or not np_:
        return 0.5
    h = positive[-1] / np_
    whole = inverse(unlabelled / nu + np.eye(len(h)) * RIDGE)
    return float(np.clip(1 / (h * (whole * h).sum(-1)).sum(), 1e-3, 1 - 1e-3))


def learn(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """Weights from the documents and the rows labelled 1; other rows and null ids are passed over.

    Labelled rows that repeat an id count once, and every row of docs with a positive's id
    is a positive.  Null texts are empty.  Without documents or positives all texts score
    the same.
    """
    positives = labelled.where((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(MOST_POSITIVES)
    both = moments(docs, positives, id_col, text_col)
    return minimise(*both, estimated_prior(*both))


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of each row; null counts as the empty text, which has a score too.

    Each row is scored on its own text, so equal texts score the same and repeated ids
    play no part.  Other columns are ignored; an empty table gives no row.
    """
    single_threaded(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def scored(texts: list[str]) -> list:
        return [np.clip((features(texts) @ shared.value + 1) / 2, 0, 1)]

    return answers(docs, id_col, text_col, {"score": "double"}, lambda: scored)


def op3_quality_pu(spark, sf_dir):
    docs = documents(spark, sf_dir)
    weights = learn(docs, labels(spark, sf_dir).where(fold("doc_id", 5) != 0))
    out = score(docs, weights)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
