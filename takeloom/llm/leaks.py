"""Evaluation passages inside training texts, found by an FM-index over each shard of the texts.

An item is cut into parts of at most six words, more parts than the changes allowed, so a document that holds twelve words of it in a row,
or all of it but for those changes, holds some part unchanged. The parts are searched backward in the index of each shard of documents;
where one occurs, the words around it are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takeloom.llm.fm_index import FMIndex
from takeloom.llm.words import words

OTHER = 1  # every word that no item has; 0 is the end mark of the index


def nearest_end(pattern: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int]:
    """(end, distance) of the stretch of text nearest to pattern in words changed, dropped or inserted; (-1, most + 1) if none is within most.

    The columns of the edit matrix are kept as bit vectors of vertical differences, one machine-independent integer each.
    """
    m = len(pattern)
    mask: dict[int, int] = {}
    for i, c in enumerate(pattern.tolist()):
        mask[c] = mask.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = (-1, most + 1)
    for j, c in enumerate(text.tolist()):
        eq = mask.get(c, 0)
        x = eq | minus
        d = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(d | plus) & full, plus & d
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~(x | up) & full, up & x
        if score < best[1]:
            best = (j + 1, score)
    return best


class Items:
    """The items' words as numbers, and the parts to search for. number: the words of all items, which those of this block are added to."""

    def __init__(self, items: list[tuple[int, str | None]], run: int, one_in: int, number: dict[str, int] | None = None):
        self.run = run
        number = {} if number is None else number
        self.ids: list[int] = []
        self.words: list[np.ndarray] = []
        self.most: list[int] = []
        parts: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        longest = (run + 1) // 2  # a run of so many words holds one whole part
        for eval_id, text in items:
            w = np.array([number.setdefault(x, len(number) + OTHER + 1) for x in words(text)], dtype=np.int64)
            if not len(w):
                continue
            most = len(w) // one_in
            at = len(self.ids)
            self.ids.append(eval_id), self.words.append(w), self.most.append(most)
            n = max(most + 1, -(-len(w) // longest))
            cuts = [len(w) * i // n for i in range(n + 1)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                parts.setdefault(tuple(w[a:b].tolist()), []).append((at, a))
        self.parts = [np.array(p, dtype=np.int64) for p in parts]
        self.uses = list(parts.values())

    def spans(self, item: int, doc: np.ndarray, diagonal: int) -> list[tuple[int, int]]:
        """Stretches [first, last] of the document's words that leak the item, around the placement of its first word at `diagonal`."""
        w, most, out = self.words[item], self.most[item], []
        a, b = max(0, -diagonal), min(len(w), len(doc) - diagonal)
        same = np.concatenate([[False], w[a:b] == doc[a + diagonal : b + diagonal], [False]])
        edges = np.flatnonzero(np.diff(same))
        for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if y - x >= self.run:
                out.append((a + diagonal + x, a + diagonal + y - 1))
        start = max(0, diagonal - most)
        window = doc[start : diagonal + len(w) + most]
        end, distance = nearest_end(w, window, most)
        if distance <= most:
            size, _ = nearest_end(w[::-1], window[:end][::-1], most)
            out.append((start + end - size, start + end - 1))
        return out


class Shard:
    """The documents of one shard with their index, which any number of items can be searched in."""

    def __init__(self, docs: list[np.ndarray]):
        self.docs = docs
        at, symbols, origin = [], [], []
        for k, d in enumerate(docs):
            d = np.append(d, OTHER)  # documents stay apart
            keep = np.ones(len(d), dtype=bool)
            keep[1:] = (d[1:] != OTHER) | (d[:-1] != OTHER)  # of other words in a row one is enough
            symbols.append(d[keep]), origin.append(np.flatnonzero(keep)), at.append(np.full(keep.sum(), k, dtype=np.int64))
        self.place, self.doc = np.concatenate(origin), np.concatenate(at)
        self.index = FMIndex(np.concatenate(symbols))

    def leaks(self, items: Items) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, first word, last word)."""
        if not items.parts:
            return
        which, position = self.index.occurrences(items.parts)
        seen = set()
        for part, k, p in zip(which.tolist(), self.doc[position].tolist(), self.place[position].tolist(), strict=True):
            for item, offset in items.uses[part]:
                if (k, item, p - offset) not in seen:
                    seen.add((k, item, p - offset))
                    for first, last in items.spans(item, self.docs[k], p - offset):
                        yield k, item, first, last


def leaks(docs: DataFrame, evals: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", eval_id: str = "eval_id", run: int = 12, one_in: int = 10, shard_words: int = 1_000_000, block: int = 20_000) -> DataFrame:
    """Rows (id_col, eval_id, first_word, last_word): the stretches of each document's words that leak an item, both ends included.

    A document leaks an item if it holds at least `run` of its words in a row, or the whole item with at most one word in `one_in` changed, dropped
    or inserted; words as in words(). An item or document without words leaks nothing, a NULL id keeps its rows, an item of fewer than `one_in`
    words must stand unchanged; empty tables give no rows. A repeated document row is reported once per row, a repeated item once per id.

    The items are the query set: they are read in blocks of `block` rows. Documents are indexed shard by shard within their tasks, whole and in any number, and each shard's
    index, made once, is searched for one block after another, so the documents are read once however many items there are; a worker holds one block at a time and the
    words of all items. Nothing is shuffled but the hits.
    """
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for df, c in ((docs, id_col), (evals, eval_id))]
    schema = f"{kinds[0]}, {kinds[1]}, first_word long, last_word long"
    rows = evals.select(eval_id, text_col)
    total = rows.count()
    blocks = [rows] if total <= block else [rows.where(F.pmod(F.xxhash64(eval_id), F.lit(-(-total // block))) == i) for i in range(-(-total // block))]
    numbers: dict[str, int] = {}
    sent = [docs.sparkSession.sparkContext.broadcast(Items([tuple(r) for r in part.collect()], run, one_in, numbers)) for part in blocks]  # the query set, a block at a time
    known = docs.sparkSession.sparkContext.broadcast(numbers)

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, shard, size = [], [], 0
        number = known.value

        def done() -> Iterator[pd.DataFrame]:
            index = Shard(shard)
            for block in sent:
                items = block.value
                hits = list(index.leaks(items))
                yield pd.DataFrame({id_col: pd.Series([ids[h[0]] for h in hits], dtype=object), eval_id: pd.Series([items.ids[h[1]] for h in hits], dtype=object), "first_word": [h[2] for h in hits], "last_word": [h[3] for h in hits]})
                if len(sent) > 1:
                    block.__dict__.pop("_value", None)  # read again for the next shard, so only one block is held

        for pdf in frames:
            for i, text in zip(pdf[id_col], pdf[text_col], strict=True):
                w = words(text)
                if w:
                    ids.append(None if pd.isna(i) else i)
                    shard.append(np.fromiter((number.get(x, OTHER) for x in w), dtype=np.int64, count=len(w)))
                    size += len(w)
                if size >= shard_words:
                    yield from done()
                    ids, shard, size = [], [], 0
        if shard:
            yield from done()

    return docs.select(id_col, text_col).mapInPandas(search, schema)


def removal_spans(found: DataFrame, *, id_col: str = "doc_id", eval_id: str = "eval_id") -> DataFrame:
    """Leaking stretches of each document, overlapping and touching ones merged: (id_col, first_word, last_word, eval_ids)."""
    spans = F.aggregate(
        F.array_sort(F.collect_list(F.struct("first_word", "last_word", eval_id))),
        F.expr(f"cast(array() as array<struct<first_word: bigint, last_word: bigint, eval_ids: array<{found.schema[eval_id].dataType.simpleString()}>>>)"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["last_word"] + 1 >= x["first_word"]),
                              F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["first_word"].alias("first_word"), F.greatest(F.try_element_at(acc, F.lit(-1))["last_word"], x["last_word"]).alias("last_word"), F.array_union(F.try_element_at(acc, F.lit(-1))["eval_ids"], F.array(x[eval_id])).alias("eval_ids")))))
        .otherwise(F.concat(acc, F.array(F.struct(x["first_word"].alias("first_word"), x["last_word"].alias("last_word"), F.array(x[eval_id]).alias("eval_ids"))))))
    return found.groupBy(id_col).agg(spans.alias("s")).select(id_col, F.inline("s"))
