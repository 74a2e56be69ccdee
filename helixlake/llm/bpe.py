"""Byte-pair encoding by per-prefix dynamic programming, and decoding.

For a pre-token, let last[i] be the last token of the encoding of its first i bytes.
It is unique: among the vocabulary's tokens that end at i (an automaton over the
vocabulary reports them all while it reads the pre-token once) it is the one whose
left neighbour, last[i - length], is compatible with it.  Two tokens are compatible
if merging their joined bytes leaves exactly the two.  Following last[] back from the
end gives the exact ids in time linear in the pre-token, however long it is.

Pre-tokens repeat, so each worker keeps a bounded table of those it has encoded.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import regex
from pyspark.sql import DataFrame

from .shared import answers, documents

#: Fixed pattern of byte-level pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens that a worker remembers, and characters of the longest that it does.
REMEMBERED, LONGEST = 300_000, 64
NEVER = 1 << 60


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable
    Latin-1 stands for itself, the others for the code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = [""] * 256, 256
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b], more = chr(more), more + 1
    return out


class Encoder:
    """Encodes and decodes texts with the vocabulary and merges of a tokenizer file."""

    def __init__(self, spec: str | bytes):
        import ahocorasick

        data = json.loads(spec)
        vocab: dict[str, int] = data["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
        self.letters = byte_letters()
        self.to_letters = {i: c for i, c in enumerate(self.letters)}
        self.pattern = regex.compile(PATTERN)
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens") or ()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        n = max([*vocab.values(), *self.special.values()]) + 1
        self.rank, self.left, self.right = [-1] * n, list(range(n)), list(range(n))
        self.merged: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(merges):
            t = vocab[a + b]
            self.rank[t], self.left[t], self.right[t] = r, vocab[a], vocab[b]
            self.merged[vocab[a], vocab[b]] = r
        byte = {c: b for b, c in enumerate(self.letters)}
        self.bytes = [b""] * n
        self.automaton = ahocorasick.Automaton()
        for word, t in vocab.items():
            if word in self.special:
                continue
            self.bytes[t] = bytes(byte[c] for c in word)
            if self.rank[t] >= 0 or len(word) == 1:
                self.automaton.add_word(word, (t, len(word)))
        self.automaton.make_automaton()
        for word, t in self.special.items():
            self.bytes[t] = word.encode()
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b gives a, b.

        Undoes the merges inside a and b, latest first.  At each time the boundary has
        one symbol on either side; if those merge with each other earlier than with
        their own neighbours, the boundary does not last.
        """
        known = self.fits.get((a, b))
        if known is not None:
            return known
        x, y, until_x, until_y, fits = a, b, NEVER, NEVER, True
        while True:
            m = self.merged.get((x, y), NEVER)
            if m < until_x and m <= until_y and m != NEVER:
                fits = False
                break
            if self.rank[x] < 0 and self.rank[y] < 0:
                break
            if self.rank[x] > self.rank[y]:
                until_x, x = self.rank[x], self.right[x]
            else:
                until_y, y = self.rank[y], self.left[y]
        if len(self.fits) > 4 * REMEMBERED:
            self.fits.clear()
        self.fits[a, b] = fits
        return fits

    def encode_piece(self, piece: str) -> bytes:
        """Ids of one pre-token as little-endian unsigned 32-bit integers."""
        word = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.to_letters)
        last, size = [-1] * (len(word) + 1), [0] * (len(word) + 1)
        for end, (t, n) in self.automaton.iter(word):
            end += 1
            if last[end] >= 0:
                continue
            at = end - n
            if at == 0 or (last[at] >= 0 and self.compatible(last[at], t)):
                last[end], size[end] = t, n
        out, at = [], len(word)
        while at > 0:
            out.append(last[at])
            at -= size[at]
        return np.array(out[::-1], "<u4").tobytes()

    def _plain(self, text: str) -> Iterator[bytes]:
        known, encode = self.known, self.encode_piece
        found = iter(self.pattern.findall(text)) if len(text) < 1 << 20 else (m.group() for m in self.pattern.finditer(text))
        while part := list(islice(found, 100_000)):
            for piece in set(part).difference(known):
                if len(piece) <= LONGEST:
                    known[piece] = encode(piece)
            yield b"".join([known[p] if p in known else encode(p) for p in part])
            if len(known) > REMEMBERED:
                known.clear()

    def encode(self, text: str) -> bytes:
        if self.split is None:
            return b"".join(self._plain(text))
        out = []
        for part in self.split.split(text):
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            elif part:
                out += self._plain(part)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def encoder(key: str, spec: bytes) -> Encoder:
    """The worker's encoder of a tokenizer file; made once for each worker."""
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(spec)
    return _ENCODERS[key]


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_spec(path: str) -> tuple[str, bytes]:
    """A key and the content of a tokenizer file; read on the driver, of a fixed size."""
    with open(path, "rb") as f:
        spec = f.read()
    return hashlib.sha256(spec).hexdigest(), spec


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of each row; with `texts`, also ids and decoded.

    Null counts as the empty text, which has no ids.  Special tokens in a text are
    encoded as such, and decoded again.  Equal texts have equal ids.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_spec(path or tokenizer_file()))

    def make():
        enc = encoder(*shared.value)

        def encoded(batch: list[str]) -> list:
            ids = [enc.encode(t) for t in batch]
            decoded = [enc.decode(x) for x in ids]
            out = [[len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(t.encode()).hexdigest() for t in decoded]]
            return [*out, ids, decoded] if texts else out

        return encoded

    columns = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | ({"ids": "binary", "decoded": "string"} if texts else {})
    return answers(docs, id_col, text_col, columns, make)


def op9_bpe_prefix_dp(spark, sf_dir):
    return encode_documents(documents(spark, sf_dir))
