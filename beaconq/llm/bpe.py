"""Byte-pair encoding and decoding, exact and in linear time.

Method: dynamic programming over prefixes. The encoding of a prefix ends in one
certain token. A suffix-link automaton of the vocabulary gives the tokens that end
at a position; the one that is compatible with the last token of the prefix before
it is stored, and the back-pointers then give the ids. Two tokens are compatible if
no merge crosses their border, which the split trees along the border decide; the
answers are kept.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, table
from .words import LETTERS, NUMBERS, ODD, Memo, byte_signs

ID_BITS = 20
PIECES_KEPT = 600_000
PAIRS_KEPT = 1_000_000
ENCODED = "doc_id long, n_tokens long, ids binary, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: The tokenizer's pre-tokens, over plain characters.
PIECE = re.compile(
    rf" ?[{LETTERS}]+| ?[{NUMBERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+"
)


class PairMemo(Memo):
    """A memo whose keys are numbers."""

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


class PrefixEncoder:
    """A byte-level vocabulary with its merges, as an exact encoder and decoder."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        byte_of = {s: b for b, s in enumerate(byte_signs())}
        self.token_bytes = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()}
        self.rank: dict[int, int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(model["merges"]):
            left, right = m.split(" ") if isinstance(m, str) else m
            a, b, ab = vocab[left], vocab[right], vocab[left + right]
            self.rank[a << ID_BITS | b] = r
            self.made.setdefault(ab, (a, b, r))
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.token_bytes |= {i: s.encode() for s, i in self.special.items()}
        self.borders = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.automaton = ahocorasick.Automaton()
        whole: dict[int, bool] = {}
        for i in sorted(vocab.values(), key=lambda i: len(self.token_bytes[i])):
            if i not in self.made:
                whole[i] = len(self.token_bytes[i]) == 1
            else:
                a, b, r = self.made[i]
                whole[i] = whole[a] and whole[b] and self._apart(a, b, r)
            if whole[i]:
                raw = self.token_bytes[i]
                self.automaton.add_word(raw.decode("latin-1"), (i, len(raw)))
        self.automaton.make_automaton()
        self.pairs = PairMemo(lambda k: self._apart(k >> ID_BITS, k & (1 << ID_BITS) - 1), PAIRS_KEPT)
        self.known = Memo(self._encode_piece, PIECES_KEPT)

    def _apart(self, a: int, b: int, before: float = float("inf")) -> bool:
        """Whether no merge of a rank under ``before`` joins the end of a to the start of b."""
        rank, made = self.rank, self.made
        x, x_until = a, before
        while True:
            y, y_until = b, before
            while True:
                r = rank.get(x << ID_BITS | y)
                if r is not None and r < before and r < x_until and r <= y_until:
                    return False
                if y not in made:
                    break
                y, _, y_until = made[y]
            if x not in made:
                return True
            _, x, x_until = made[x]

    def _encode_piece(self, piece: str) -> bytes:
        raw = piece.encode()
        last, pairs = [-1] * (len(raw) + 1), self.pairs
        sizes = [0] * (len(raw) + 1)
        for end, (token, size) in self.automaton.iter(raw.decode("latin-1")):
            end += 1
            if last[end] < 0 and (size == end or last[end - size] >= 0 and pairs[last[end - size] << ID_BITS | token]):
                last[end], sizes[end] = token, size
        ids, at = [], len(raw)
        while at:
            if last[at] < 0:
                raise ValueError(f"the vocabulary cannot spell {piece!r}")
            ids.append(last[at])
            at -= sizes[at]
        ids.reverse()
        return struct.pack(f"<{len(ids)}I", *ids)

    def _encode_plain(self, text: str) -> bytes:
        if ODD.search(text):
            pieces = [text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]
        else:
            pieces = PIECE.findall(text)
        return b"".join(map(self.known.__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        """The ids, each as four bytes, little-endian."""
        if self.borders is None or not any(s in text for s in self.special):
            return self._encode_plain(text)
        return b"".join(
            struct.pack("<I", self.special[part]) if part in self.special else self._encode_plain(part)
            for part in self.borders.split(text)
        )

    def decode(self, ids: bytes) -> str:
        found = np.frombuffer(ids, "<u4").tolist()
        return b"".join(map(self.token_bytes.__getitem__, found)).decode("utf-8", "replace")


_encoders: dict[str, PrefixEncoder] = {}


def encoder(path: str) -> PrefixEncoder:
    if path not in _encoders:
        _encoders[path] = PrefixEncoder(path)
    return _encoders[path]


def _by_text(docs: DataFrame, tokenizer: str, digests: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        enc = encoder(tokenizer)
        for batch in batches:
            ids = [enc.encode(t or "") for t in batch["text"].to_pylist()]
            out = {"doc_id": batch["doc_id"], "n_tokens": [len(b) // 4 for b in ids]}
            if digests:
                out["ids_sha256"] = [hashlib.sha256(b).hexdigest() for b in ids]
                out["decoded_sha256"] = [hashlib.sha256(enc.decode(b).encode()).hexdigest() for b in ids]
            else:
                out |= {"ids": ids, "decoded": [enc.decode(b) for b in ids]}
            yield out

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(rows, run, DIGESTS if digests else ENCODED)


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Ids (little-endian 32-bit) and the text decoded from them, for each document.

    A null text is encoded as the empty text, which has no ids. Null and repeated
    ``doc_id`` stay as they are, one row each. An empty table gives no rows; other
    columns are not read. Every row depends on itself alone, without a shuffle.
    """
    return _by_text(docs, tokenizer, digests=False)


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    """The digests are taken where the ids are made, so that ids and texts need not leave the worker."""
    import public_tokenizers

    return _by_text(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), digests=True)
