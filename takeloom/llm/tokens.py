"""Byte-level BPE over whole corpora by batched numpy merge rounds.

The distinct words of a batch lie side by side in one flat array of symbols. Each round looks all neighbouring pairs up in a sorted array of
pair keys, and merges in every word its pair of lowest rank, wherever that word holds it; words without a mergeable pair drop out. Words already
encoded are remembered by the worker, up to a bound.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The split before the merges, as published with the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Folder of the vocabulary files; a parameter of every operator here.
FOLDER = os.environ.get("TAKELOOM_TOKENIZERS", "/opt/tokenizers")
NONE = np.iinfo(np.int64).max


class ByteBPE:
    """Ids of one rank file (lines of base64 bytes and rank)."""

    def __init__(self, path: str, remember: int = 500_000):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.base = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.size = max(ranks.values()) + 1
        # a token of several bytes is the merge of just two tokens: those left when all lower ranks have been merged within its bytes
        left, right, made = [], [], []
        for token, rank in ranks.items():
            if len(token) > 1:
                parts = self._parts(token, rank, ranks)
                left.append(parts[0]), right.append(parts[1]), made.append(rank)
        keys = np.array(left, dtype=np.int64) * self.size + np.array(right, dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.made = keys[order], np.array(made, dtype=np.int64)[order]
        self.words: dict[str, np.ndarray] = {}
        self.remember = remember
        self.split = regex.compile(PATTERN)

    @staticmethod
    def _parts(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[int, int]:
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], NONE))
            assert ranks.get(parts[best] + parts[best + 1], NONE) < rank
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return ranks[parts[0]], ranks[parts[1]]

    def merge(self, symbols: np.ndarray, word: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and their words (ascending) after all merges."""
        done_s, done_w = [], []
        while len(symbols):
            pair = symbols[:-1] * self.size + symbols[1:]
            at = np.searchsorted(self.keys, pair)
            at[at == len(self.keys)] = 0
            rank = np.where((self.keys[at] == pair) & (word[:-1] == word[1:]), self.made[at], NONE)
            lowest = np.full(n_words, NONE)
            np.minimum.at(lowest, word[:-1], rank)
            open_ = lowest[word] != NONE
            done_s.append(symbols[~open_]), done_w.append(word[~open_])
            hit = (rank == lowest[word[:-1]]) & (rank != NONE)
            # of overlapping hits (a run of equal symbols) every second one counts, from the left
            where = np.flatnonzero(hit)
            if len(where):
                run = np.flatnonzero(np.diff(where, prepend=where[0] - 2) != 1)
                offset = np.arange(len(where)) - np.repeat(run, np.diff(np.append(run, len(where))))
                where = where[offset % 2 == 0]
            symbols = symbols.copy()
            symbols[where] = rank[where]
            keep = open_
            keep[where + 1] = False
            symbols, word = symbols[keep], word[keep]
        s, w = np.concatenate(done_s or [symbols]), np.concatenate(done_w or [word])
        order = np.argsort(w, kind="stable")
        return s[order], w[order]

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        raw = [w.encode("utf-8") for w in words]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        symbols = self.base[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        s, w = self.merge(symbols, np.repeat(np.arange(len(raw)), sizes), len(raw))
        return np.split(s.astype(np.int32), np.searchsorted(w, np.arange(1, len(raw))))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the offsets of each text in it; NULL and empty texts have no ids."""
        pieces = [self.split.findall(t) if t else [] for t in texts]
        if len(self.words) > self.remember:
            self.words.clear()
        new = list({w for p in pieces for w in p} - self.words.keys())
        if new:
            self.words.update(zip(new, self.encode_words(new), strict=True))
        known = self.words
        parts = [known[w] for p in pieces for w in p]
        ids = np.concatenate(parts) if parts else np.empty(0, dtype=np.int32)
        upto = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)))])
        offsets = upto[np.concatenate([[0], np.cumsum([len(p) for p in pieces], dtype=np.int64)])]
        return ids, offsets


@lru_cache(maxsize=4)
def _bpe(path: str) -> ByteBPE:
    return ByteBPE(path)


def token_ids(df: DataFrame, id_col: str, text_col: str = "text", *, vocabulary: str = "byte_bpe_50k", folder: str = FOLDER, batch_chars: int = 4_000_000) -> DataFrame:
    """Rows (id_col, ids ARRAY<INT>): the ids of each whole text, without special tokens (their strings are ordinary text).

    A NULL and an empty text give an empty list, a NULL id keeps its row, repeated rows are each encoded, an empty table gives no rows; other
    columns are ignored. A text of any length is encoded whole; texts are taken in batches of at most batch_chars characters, or one text.
    """
    path = f"{folder}/{vocabulary}.tiktoken"
    kind = df.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            start = size = 0
            for i in range(len(texts) + 1):
                if i == len(texts) or size + len(texts[i] or "") > batch_chars and i > start:
                    if i > start:
                        ids, offsets = bpe.encode(texts[start:i])
                        out = pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(ids, type=pa.int32()))
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, i - start), out], names=[id_col, "ids"])
                    start, size = i, 0
                if i < len(texts):
                    size += len(texts[i] or "")

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(encode, f"`{id_col}` {kind}, ids array<int>")
