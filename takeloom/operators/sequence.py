"""Alignment of what was expected with what was heard, by longest matching blocks."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takeloom.operators.validate import gate

FLAGS = "item_id string, n_expected int, n_matched int, match_ratio double, start_sec double, end_sec double, flag string"


def flag(matched: int, expected: int, threshold: float) -> str:
    return "unmatched" if matched == 0 else "low_confidence" if matched / expected < threshold else "ok"


def without_tokens(expected: DataFrame, take: str) -> DataFrame:
    """Items of expected (take, item_id, position, tokens) that have no token to be found by."""
    return expected.where(F.coalesce(F.size("tokens"), F.lit(0)) <= 0).select(take, "item_id", "position")


def expected_stream(expected: DataFrame, take: str) -> DataFrame:
    """(take, item_id, position, place, token): the tokens of each take's items in reading order, place from 1 within the item. An item without tokens raises."""
    gate(without_tokens(expected, take), "items without a token")
    return expected.select(take, "item_id", "position", F.posexplode("tokens").alias("place", "token")).withColumn("place", F.col("place") + 1)


def insertions(expected: DataFrame, heard: DataFrame, take: str) -> DataFrame:
    """(take, start_sec, end_sec, text): stretches of heard tokens between two expected ones that stand for none of them; what replaces an expected token is no insertion.

    expected and heard as in aligned_items(); both lists of a take are aligned as wholes.
    """
    kind = expected.schema[take].dataType.simpleString()

    def run(e: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
        e, h = e.sort_values(["position", "item_id"]), h.sort_values(["start", "end", "token"])
        tokens = [t for row in e["tokens"] if row is not None for t in row]
        said, starts, ends = h["token"].tolist(), h["start"].tolist(), h["end"].tolist()
        at = (e if len(e) else h)[take].iloc[0]
        steps = SequenceMatcher(None, tokens, said, autojunk=False).get_opcodes()
        out = [(at, starts[a], ends[b - 1], " ".join(said[a:b])) for step, _, _, a, b in steps if step == "insert"]
        return pd.DataFrame(out, columns=[take, "start_sec", "end_sec", "text"])

    return expected.groupBy(take).cogroup(heard.groupBy(take)).applyInPandas(run, f"`{take}` {kind}, start_sec double, end_sec double, text string")


def aligned_items(expected: DataFrame, heard: DataFrame, take: str, threshold: float = 0.8) -> DataFrame:
    """Per take and item its matched tokens, ratio, flag, and the time from the first matched token's start to the last one's end.

    expected: take, item_id, position, tokens; heard: take, start, end, token. Both lists of a take are aligned as wholes, so a take is one task;
    it holds as many tokens as were read in it. Times are NULL where nothing matched; a take on one side only has no matches.
    """
    kind = expected.schema[take].dataType.simpleString()

    def run(e: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
        e, h = e.sort_values(["position", "item_id"]), h.sort_values(["start", "end", "token"])
        tokens, owner = [], []
        for i, t in enumerate(e["tokens"]):
            t = [] if t is None else list(t)
            tokens += t
            owner += [i] * len(t)
        starts, ends = h["start"].tolist(), h["end"].tolist()
        matched: list[list[int]] = [[] for _ in range(len(e))]
        for block in SequenceMatcher(None, tokens, h["token"].tolist(), autojunk=False).get_matching_blocks():
            for k in range(block.size):
                matched[owner[block.a + k]].append(block.b + k)
        out = []
        for (item, t), m in zip(e[["item_id", "tokens"]].itertuples(index=False), matched, strict=True):
            n = 0 if t is None else len(t)
            out.append((e[take].iloc[0], item, n, len(m), round(len(m) / n, 4) if n else 0.0, min((starts[i] for i in m), default=None), max((ends[i] for i in m), default=None), flag(len(m), n, threshold)))
        return pd.DataFrame(out, columns=[take, "item_id", "n_expected", "n_matched", "match_ratio", "start_sec", "end_sec", "flag"])

    return expected.groupBy(take).cogroup(heard.groupBy(take)).applyInPandas(run, f"`{take}` {kind}, {FLAGS}")
