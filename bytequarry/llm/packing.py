"""Packing tokenised documents into fixed windows by best-fit decreasing.

A document is its token ids and an end id. Documents longer than a window are first cut
into full windows; what remains of each is placed, longest first, into the open window
with the least room that still suffices. A segment tree over remaining capacities finds
that window in log2(capacity) steps.

Every input partition packs its own documents, block after block with the open windows
kept, so there is no shuffle and memory holds one block of token ids. Sequence ids are
the partition's number times 2**32 plus a counter: unique, and equal again when a lost
task is repeated.

Defined cases: a null text counts as empty, and an empty document is its end id alone;
repeated rows are packed each; an empty table gives no pieces; texts of any length are
encoded whole, also a single word or gap of millions of code points; other columns are not
read, so they may have any names.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Token ids gathered before a block is packed.
BLOCK_TOKENS = 4_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_encoders: dict = {}


class Encoder:
    """Ids of a byte-level BPE vocabulary, given as a rank file and as the JSON file that defines it.

    The rank form is several times faster and gives the same ids. Its pattern search has a
    stack of limited depth, which a single word or gap of a few hundred thousand code points
    overruns; such a text is encoded by the JSON form, whole. Special strings inside a text
    become their ids, as the JSON file lists them.
    """

    def __init__(self, ranks_path: str, pattern: str, vocabulary_path: str):
        import tiktoken

        with open(vocabulary_path, encoding="utf-8") as f:
            special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.vocabulary_path, self._exact = vocabulary_path, None
        self._ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def exact(self, text: str) -> np.ndarray:
        """Ids by the JSON form."""
        if self._exact is None:
            from tokenizers import Tokenizer

            self._exact = Tokenizer.from_file(self.vocabulary_path)
        return np.asarray(self._exact.encode(text, add_special_tokens=False).ids, np.uint32)

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        try:
            return self._ranks.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # the pattern search ran out of its stack
            return self.exact(text)


def encoder(ranks_path: str, pattern: str, vocabulary_path: str) -> Encoder:
    """Kept per worker process."""
    key = (ranks_path, pattern, vocabulary_path)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


class BestFit:
    """Open windows by remaining capacity, with a segment tree of how many there are of each."""

    def __init__(self, capacity: int):
        self.capacity, self.width = capacity, 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.width)
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.windows = 0

    def _add(self, room: int, by: int) -> None:
        i = room + self.width
        while i:
            self.tree[i] += by
            i >>= 1

    def _tightest(self, size: int) -> int:
        """The least room of ``size`` or more among open windows, or -1."""
        tree, i = self.tree, size + self.width
        if tree[i]:
            return size
        while i > 1:
            if not i & 1 and tree[i + 1]:
                i += 1
                while i < self.width:
                    i = 2 * i if tree[2 * i] else 2 * i + 1
                return i - self.width
            i >>= 1
        return -1

    def place(self, size: int) -> tuple[int, int]:
        """Window and offset for a piece; opens a window where none has room."""
        room = self._tightest(size) if size < self.capacity else -1
        if room < 0:
            window, used = self.windows, 0
            self.windows += 1
        else:
            window, used = self.open[room].pop()
            self._add(room, -1)
        left = self.capacity - used - size
        if left:
            self.open[left].append((window, used + size))
            self._add(left, 1)
        return window, used


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """Pieces (start, length) of a document of ``n`` ids: full windows, then the rest."""
    return [(i, min(capacity, n - i)) for i in range(0, n, capacity)]


def pack(df: DataFrame, ranks_path: str, pattern: str, vocabulary_path: str, end_id: int = 0, capacity: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents with their places; see the module's text. Both files have these paths on every executor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(ranks_path, pattern, vocabulary_path)
        fit, base = BestFit(capacity), TaskContext.get().partitionId() << 32
        block: list[tuple] = []
        held = 0

        def flush() -> pd.DataFrame:
            block.sort(key=lambda p: -p[2])
            rows = [(*p, *fit.place(p[2])) for p in block]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            out["sequence_id"] += base
            block.clear()
            return out

        for pdf in batches:
            for doc, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = np.append(enc(t), end_id).astype("<u4")
                n = len(ids)
                block.extend((None if pd.isna(doc) else int(doc), s, k, zlib.crc32(ids[s : s + k].tobytes()), n) for s, k in cuts(n, capacity))
                held += n
                if held >= BLOCK_TOKENS:
                    yield flush()
                    held = 0
        if block:
            yield flush()

    return df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInPandas(run, SCHEMA)


def default_vocabulary() -> dict:
    """Files and split pattern of the installed public byte-level vocabulary."""
    import public_tokenizers

    place = lambda name: os.path.realpath(public_tokenizers.path(name))
    return {"ranks_path": place("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN, "vocabulary_path": place("byte_bpe_50k.json")}
