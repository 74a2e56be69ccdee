"""Language identification with bit-sliced Bloom filters over character n-grams.

Learning counts every n-gram of every labelled training text, by language, in Spark.
An n-gram enters a language's filter if it makes up at least MIN_RATE of the
language's n-grams and SHARE of its rate in the language that uses it most; by the
first bound a language has at most 1 / MIN_RATE n-grams, so a model of BLOCK_LANGUAGES
languages has a fixed size and may be broadcast.

The filters are bit-sliced: slot s of the table holds one bit for each language, and
the AND of an n-gram's slots is the mask of all languages that contain it.  A text's
set bits are counted by language, corrected for the rate at which a filter answers
yes by chance, and the largest count decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import answers, discard, documents, every, fold, quoted, unused, written
from .textbatch import mix, slices

N = 4
MIN_RATE, SHARE = 5e-5, 0.2
SLOTS, PROBES = 1 << 17, 2
#: Languages of one model, 16 kB each; more make further models, which texts are held against one after the other.
BLOCK_LANGUAGES = 512
UNDETERMINED = "und"
_ALPHA: list[np.ndarray] = []


def _alpha() -> np.ndarray:
    if not _ALPHA:
        _ALPHA.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _ALPHA[0]


def grams(texts: list[str], n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and row of each n-gram, and whether each row has a letter.

    Case is folded and every character that is not a letter counts as a space; of
    n-grams with two spaces in a row none is taken.
    """
    pad = " " * (n - 1)
    low = [t.lower() for t in texts]
    code = np.frombuffer((pad + pad.join(low) + pad).encode("utf-32-le", "surrogatepass"), np.uint32)
    start = np.cumsum([n - 1] + [len(t) + n - 1 for t in low])
    letter = _alpha()[code]
    code = np.where(letter, code, np.uint32(32))
    count = np.concatenate([[0], np.cumsum(letter)])
    lettered = np.array([count[b + len(t)] > count[b] for b, t in zip(start, low, strict=False)], bool)
    wide = sliding(code, n)
    space = code == 32
    bad = np.zeros(len(code), bool)
    bad[:-1] = space[:-1] & space[1:]
    run = np.concatenate([[0], np.cumsum(bad)])
    ok = run[n - 1 : n - 1 + len(wide)] == run[: len(wide)]
    at = np.flatnonzero(ok)
    return wide[at], np.searchsorted(start, at + 1, "right") - 1, lettered


def sliding(code: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(max(0, len(code) - n + 1), np.uint64)
    for i in range(n):
        h = (h + code[i : i + len(h)].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return mix(h)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # SLOTS x words of 64 languages
    by_chance: np.ndarray
    #: Models of the languages beyond the first BLOCK_LANGUAGES, by name.
    more: list[Model] = field(default_factory=list)

    def masks(self, h: np.ndarray) -> np.ndarray:
        out = None
        for p in range(PROBES):
            got = self.table[(mix(h + np.uint64(p * 0x51ED27)) >> np.uint64(40)).astype(np.int64) % SLOTS]
            out = got if out is None else out & got
        return out

    def tally(self, texts: list[str]) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        """The language of this model with most of a text's n-grams, their number, and the sum over languages; None for a text without a letter."""
        h, row, lettered = grams(texts)
        rows, total = np.clip(row, 0, len(texts) - 1), np.zeros(len(texts))
        if not self.languages:
            return [None] * len(texts), total, total
        total = np.bincount(rows, minlength=len(texts)).astype(float)
        masks, hits = self.masks(h), np.zeros((len(texts), len(self.languages)))
        for j in range(len(self.languages)):
            on = (masks[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1)
            hits[:, j] = np.bincount(rows, weights=on, minlength=len(texts))
        chance = self.by_chance
        real = np.clip((hits - total[:, None] * chance) / np.maximum(1e-9, 1 - chance), 0, None)
        names = [self.languages[b] if ok else None for b, ok in zip(real.argmax(1), lettered, strict=True)]
        return names, np.where(lettered, real.max(1), 0.0), np.where(lettered, real.sum(1), 0.0)

    def decide(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        names, top, total = self.tally(texts)
        return [n or UNDETERMINED for n in names], top / np.maximum(1e-12, total)


def build(found: pa.Table) -> Model:
    """The model of (lang, gram) rows."""
    named = found["lang"].combine_chunks().dictionary_encode()
    listed = named.dictionary.to_pylist()
    languages = sorted(listed)
    table = np.zeros((SLOTS, max(1, -(-len(languages) // 64))), np.uint64)
    place = {lang: i for i, lang in enumerate(languages)}
    own = np.array([place[lang] for lang in listed], np.int64)[named.indices.to_numpy()] if listed else np.zeros(0, np.int64)
    h = found["gram"].to_numpy().view(np.uint64)
    bit = np.uint64(1) << (own % 64).astype(np.uint64)
    for p in range(PROBES):
        at = (mix(h + np.uint64(p * 0x51ED27)) >> np.uint64(40)).astype(np.int64) % SLOTS
        np.bitwise_or.at(table, (at, own // 64), bit)
    fill = [((table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))]
    return Model(languages, table, np.array(fill) ** PROBES)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of (language, n-gram) in a task; passed on before they grow large."""
    held: dict[str, list] = {}

    def out():
        for lang, parts in held.items():
            h, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([p[1] for p in parts]))
            yield pd.DataFrame({"lang": lang, "gram": h.view(np.int64), "n": n.astype(np.int64)})
        held.clear()

    size = 0
    for pdf in batches:
        for lang, part in pdf.groupby("lang", sort=False):
            texts = part["text"].tolist()
            for a, b in slices([len(t) for t in texts]):
                h, n = np.unique(grams(texts[a:b])[0], return_counts=True)
                held.setdefault(lang, []).append((h, n))
                size += len(h)
                if size > 3_000_000:
                    yield from out()
                    size = 0
    yield from out()


def learn(rows: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """The model of rows with a language and a text; other rows are passed over, and every row counts as often as it occurs.

    All languages are learned: those beyond BLOCK_LANGUAGES are in the models `more`.
    """
    known = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = written(known.select("lang", F.length("text").alias("n")).groupBy("lang").agg(F.sum("n").alias("size")))
    counts = known.mapInPandas(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rate = F.col("n") * (F.lit(1.0) / F.greatest("size", F.lit(1)))
    rates = counts.join(sizes, "lang").select("gram", F.struct("lang", rate.alias("rate")).alias("b")).groupBy("gram").agg(F.collect_list("b").alias("by"))  # at most one entry for each language
    most = F.array_max(F.transform("by", lambda b: b["rate"]))
    good = F.filter("by", lambda b: (b["rate"] >= MIN_RATE) & (b["rate"] >= SHARE * most))
    chosen = written(rates.select("gram", F.explode(good).alias("b")).select("b.lang", "gram"))
    languages = sorted(r["lang"] for r in sizes.select("lang").collect())  # a name for each language
    models = []
    for at in range(0, max(1, len(languages)), BLOCK_LANGUAGES):
        block = languages[at : at + BLOCK_LANGUAGES]
        own = chosen.where(F.col("lang").between(block[0], block[-1])) if block else chosen
        models.append(build(own.toArrow()))  # at most 1 / MIN_RATE rows for each language
    discard(sizes, chosen)
    models[0].more = models[1:]
    return models[0]


def _tallied(shared: Broadcast):
    """tally() of a broadcast model, as a function of columns."""

    @F.pandas_udf("lang string, top double, total double")
    def tallied(texts: pd.Series) -> pd.DataFrame:
        whole, parts = texts.fillna("").tolist(), [pd.DataFrame({"lang": pd.Series([], dtype=str), "top": pd.Series([], dtype=float), "total": pd.Series([], dtype=float)})]
        for a, b in slices([len(t) for t in whole]):
            parts.append(pd.DataFrame(dict(zip(("lang", "top", "total"), shared.value.tally(whole[a:b]), strict=True))))
        return pd.concat(parts[1:] or parts, ignore_index=True)

    return tallied


def _against_all(docs: DataFrame, model: Model, text_col: str, out: str) -> DataFrame:
    """docs, all columns, with a struct (lang_pred, score) in `out`, by all models one after the other.

    The first language by name wins a tie.  Between models the rows are written, so a task
    never holds more than one of them.
    """
    text = quoted(text_col).cast("string")
    held = docs
    models = [model, *model.more]
    for i, one in enumerate(models):
        shared = docs.sparkSession.sparkContext.broadcast(Model(one.languages, one.table, one.by_chance))

        now = _tallied(shared)(text)
        if i:
            before, (new,) = quoted(out), unused(held, "tally")
            held = held.select(*every(held), now.alias(new))
            better = before["lang"].isNull() | (quoted(new)["top"] > before["top"])
            both = F.struct(F.when(better, quoted(new)["lang"]).otherwise(before["lang"]).alias("lang"), F.greatest(quoted(new)["top"], before["top"]).alias("top"), (quoted(new)["total"] + before["total"]).alias("total"))
            held = held.select(*every(docs), both.alias(out))
        else:
            held = held.select(*every(docs), now.alias(out))
        if i + 1 < len(models):
            held = written(held)
    told = quoted(out)
    score = told["top"] / F.greatest(told["total"], F.lit(1e-12))
    return held.select(*every(docs), F.struct(F.coalesce(told["lang"], F.lit(UNDETERMINED)).alias("lang_pred"), score.alias("score")).alias(out))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score of each row of docs.

    Null texts and texts without a letter are `und` with score 0.  Equal texts get
    equal answers, whatever their ids; the first language by name wins a tie.  Other
    columns are ignored, and an empty table gives no row.
    """
    if model.more:
        told = _against_all(docs.select(F.col(id_col), F.col(text_col)), model, text_col, "_told")
        return told.select(id_col, "_told.lang_pred", "_told.score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return answers(docs, id_col, text_col, {"lang_pred": "string", "score": "double"}, lambda: shared.value.decide)


def identify_rows(docs: DataFrame, model: Model, text_col: str = "text", out: str = "__told") -> DataFrame:
    """docs, all columns, with a struct (lang_pred, score) in `out`, by the same rule as identify().

    `out` has to be a name that docs does not have.
    """
    return _against_all(docs, model, text_col, out)


def trained(docs: DataFrame) -> Model:
    return learn(docs.where(fold("doc_id", 4) != 2))


def op1_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    out = identify(docs, trained(docs))
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
