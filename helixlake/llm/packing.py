"""Sequence packing as vector bin packing with the dot-product heuristic.

An example has a vector: its tokens, its segments (one) and its loss-bearing tokens, each
as a share of what a sequence may hold.  A sequence is filled with the example, of
those that fit, whose vector has the largest dot product with what is left of the
sequence.  When none fits and cutting is allowed, the example with the largest dot
product is cut to fill the sequence to the last token.

Each task packs its own rows in blocks of BLOCK documents, so that memory is bounded
by the block, nothing is shuffled and no group can grow hot.  Sequence ids hold the
number of the partition, so a task that runs again gives the same rows again.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN, Encoder, byte_letters, read_spec, tokenizer_file
from .shared import documents

TOKENS, SEGMENTS, BLOCK = 1024, 512, 4096
#: Characters of one kind in a row that the fast encoder is given.
RUN = 2000
_BLANK, _BLANKS = re.compile(r"[ \t\r\n]"), re.compile(rf"\s{{{RUN}}}")
#: Sequences that one partition may number.
PER_PARTITION = 1 << 40


def pack(sizes: np.ndarray, loss: list[np.ndarray] | None = None, tokens: int = TOKENS, segments: int = SEGMENTS, loss_tokens: int = TOKENS, cut: bool = True) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, start, length) for items of the given sizes.

    loss[i] counts the loss-bearing tokens of item i before each of its places, its end
    included; without it all tokens bear loss.  With `cut` an item may be divided
    anywhere; without, items larger than a sequence are an error.  Equal vectors are
    taken in order.
    """
    if min(tokens, segments, loss_tokens) < 1:
        raise ValueError("a sequence must hold at least one token, one segment and one loss-bearing token")
    start = np.zeros(len(sizes), np.int64)
    left = sizes.astype(np.int64).copy()
    lossy = left.copy() if loss is None else np.array([c[-1] for c in loss], np.int64)
    if not cut and len(sizes) and (left.max() > tokens or lossy.max() > loss_tokens):
        raise ValueError("an item exceeds the limits of a sequence and cutting is off")
    alive = np.flatnonzero(left > 0)
    out: list[list[tuple[int, int, int]]] = []
    share = np.array([1 / tokens, 1 / segments, 1 / loss_tokens])

    def within(item: int, room: np.ndarray) -> int:
        """How many of the item's next tokens the sequence has room for."""
        most = int(min(room[0], left[item]))
        if loss is None:
            return int(min(most, room[2]))
        c, at = loss[item], int(start[item])
        return min(most, int(np.searchsorted(c, c[at] + room[2], "right")) - 1 - at)

    while len(alive):
        room, held = np.array([tokens, segments, loss_tokens]), []
        n, m = left[alive], lossy[alive]
        gone = np.zeros(len(alive), bool)
        while room[0] >= 1 and room[1] >= 1 and not gone.all():
            w = room * share * share
            dot = n * w[0] + w[1] + m * w[2]
            fits = (n <= room[0]) & (m <= room[2]) & ~gone
            if fits.any():
                i = int(np.where(fits, dot, -1).argmax())
                take = int(n[i])
            elif cut:
                i = int(np.where(gone, -1, dot).argmax())
                take = within(int(alive[i]), room)
                if take < 1:
                    break
            else:
                break
            item, at = int(alive[i]), int(start[alive[i]])
            part = take if loss is None else int(loss[item][at + take] - loss[item][at])
            held.append((item, at, take))
            start[item] += take
            left[item] -= take
            lossy[item] -= part
            n[i], m[i] = left[item], lossy[item]
            gone[i] = left[item] == 0
            room -= (take, 1, part)
        out.append(held)
        alive = alive[~gone]
    return out


def powers_of_two(held: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A sequence cut into sequences whose totals are powers of two, the largest first."""
    out, rest = [], list(held)
    total = sum(n for *_, n in held)
    while total:
        want = 1 << (total.bit_length() - 1)
        total -= want
        part = []
        while want:
            item, start, n = rest.pop(0)
            take = min(n, want)
            part.append((item, start, take))
            if take < n:
                rest.insert(0, (item, start + take, n - take))
            want -= take
        out.append(part)
    return out


class Tokens:
    """The ids of texts, and the bytes that each id stands for.

    A fast encoder with the same merges and special tokens takes all texts but those with
    a run of more than RUN characters of one kind, for which its pattern backtracks too
    deep; those are encoded by dynamic programming, which gives the same ids.
    """

    def __init__(self, spec: bytes):
        import tiktoken

        data = json.loads(spec)
        special = {t["content"]: t["id"] for t in data.get("added_tokens") or ()}
        byte = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(byte[c] for c in word): t for word, t in data["model"]["vocab"].items() if word not in special}
        self.spec, self.exact = spec, None
        self.fast = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.width = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        for word, t in [*ranks.items(), *((w.encode(), t) for w, t in special.items())]:
            self.width[t] = len(word)

    def encode(self, text: str) -> np.ndarray:
        if len(text) > RUN and (max(map(len, _BLANK.split(text))) > RUN or _BLANKS.search(text)):
            self.exact = self.exact or Encoder(self.spec)
            return np.frombuffer(self.exact.encode(text), "<u4")
        return self.fast.encode_to_numpy(text, allowed_special="all")

    def bearing(self, text: str, ids: np.ndarray, spans: list[dict]) -> np.ndarray:
        """Whether each id starts in one of the spans (start, end) of the text, in characters."""
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        before = np.concatenate([[0], np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))])
        change = np.zeros(before[-1] + 1, np.int64)
        for s in spans:
            a, b = (before[min(max(int(s[x]), 0), len(code))] for x in ("start", "end"))
            if a < b:
                change[a] += 1
                change[b] -= 1
        inside = np.cumsum(change) > 0
        width = self.width[ids]
        return inside[np.minimum(np.cumsum(width) - width, before[-1])]


_KNOWN: dict[str, Tokens] = {}


def pack_documents(
    docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", loss_col: str | None = None,
    tokens: int = TOKENS, segments: int = SEGMENTS, loss_tokens: int | None = None, block: int = BLOCK, end_id: int = 0,
) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and end_id; null and empty texts are end_id alone.  A sequence
    holds at most `tokens` ids, `segments` pieces and `loss_tokens` loss-bearing ids
    (as many as ids, unless given).  `loss_col` has spans, array<struct<start, end>> in
    characters: the ids that start in one bear loss, end_id does if the one before it
    does; null spans are none.  Without that column all ids bear loss.  A row of
    pieces has loss_tokens as its last column where the column is given.

    Whole sequences are cut from a document first, where only the number of ids limits
    them, and what remains is packed by vector.  The last sequence of a block is cut into
    powers of two, which need no padding.  Each row of docs is packed, so a repeated row
    gives pieces of its own; texts may be of any length, other columns are ignored and an
    empty table gives no piece.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_spec(path or tokenizer_file()))
    columns = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["loss_tokens"] if loss_col else [])]
    most_loss = tokens if loss_tokens is None else loss_tokens
    limits = (tokens, segments, most_loss)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, spec = shared.value
        if key not in _KNOWN:
            _KNOWN[key] = Tokens(spec)
        known = _KNOWN[key]
        context = TaskContext.get()
        number, waiting = (context.partitionId() if context else 0) * PER_PARTITION, 0
        rest: list[tuple] = []  # id, tokens of the document, where the rest starts, its ids, its loss-bearing ids before each place
        rows: list[tuple] = []

        def piece(doc, total: int, base: int, ids: np.ndarray, loss: np.ndarray | None, start: int, n: int, at: int) -> None:
            crc = zlib.crc32(ids[start : start + n].tobytes())
            rows.append((doc, base + start, n, crc, total, number, at, *(() if loss is None else (int(loss[start + n] - loss[start]),))))

        def close() -> None:
            nonlocal number, waiting
            found = pack(np.array([len(x[3]) for x in rest], np.int64), [x[4] for x in rest] if loss_col else None, *limits)
            if found and sum(n for *_, n in found[-1]) < tokens:
                found[-1:] = powers_of_two(found[-1])
            for held in found:
                at = 0
                for item, start, n in held:
                    piece(*rest[item], start, n, at)
                    at += n
                number += 1
            rest.clear()
            waiting = 0

        def given() -> pa.RecordBatch:
            doc, *rest_of = zip(*rows, strict=True)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(doc, id_type), *(pa.array(x, pa.int64()) for x in rest_of)], names=[id_col, *columns])

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            spans = batch.column(2).to_pylist() if loss_col else [None] * batch.num_rows
            for doc, text, bears in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), spans, strict=True):
                ids, loss = np.append(known.encode(text or ""), end_id).astype("<u4"), None
                if loss_col:
                    on = known.bearing(text or "", ids[:-1], bears or [])
                    loss = np.concatenate([[0], np.cumsum(np.append(on, on[-1:] if len(on) else False))])
                whole = len(ids) // tokens * tokens if most_loss >= tokens else 0
                for start in range(0, whole, tokens):
                    piece(doc, len(ids), 0, ids, loss, start, tokens, 0)
                    number += 1
                if whole < len(ids):
                    rest.append((doc, len(ids), whole, ids[whole:].copy(), None if loss is None else loss[whole:]))
                    waiting += len(ids) - whole
                if len(rest) >= block or waiting >= block * tokens:
                    close()
                if len(rows) >= 50_000:
                    yield given()
        close()
        if rows:
            yield given()

    kind = dict(docs.dtypes)[id_col]
    schema = ", ".join([f"`{id_col}` {kind}", *(f"{c} long" for c in columns)])
    given = [F.col(id_col), F.col(text_col).cast("string").alias("text"), *([F.col(loss_col).alias("loss")] if loss_col else [])]
    return docs.select(*given).mapInArrow(packed, schema)


def op4_vector_packing(spark, sf_dir):
    return pack_documents(documents(spark, sf_dir))
