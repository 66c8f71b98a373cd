"""Token edit distance with counts of substitutions, deletions and insertions, and alignments."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

COUNTS = "struct<c:int,s:int,d:int,i:int>"


def edit_counts(ref: str, hyp: str) -> Column:
    """struct<c, s, d, i> of the cheapest edit of ref into hyp (token arrays), for utterances; unit costs.

    Of equally cheap edits the diagonal is preferred, then a deletion, then an insertion, at each cell seen from the end. Each cell carries the counts of its
    preferred predecessor, so no way back is needed. NULL arrays give NULL. Long texts are better served by align().
    """
    r, h = F.col(ref), F.col(hyp)

    def cell(c: Column, s: Column, d: Column, i: Column) -> Column:
        return F.struct(c.cast("int").alias("c"), s.cast("int").alias("s"), d.cast("int").alias("d"), i.cast("int").alias("i"))

    zero = F.lit(0)
    first = F.transform(F.sequence(F.lit(0), F.size(h)), lambda j: cell(j, zero, zero, j))

    def row(before: Column, word: Column) -> Column:
        left = F.array(cell(before[0]["c"] + 1, before[0]["s"], before[0]["d"] + 1, before[0]["i"]))

        def column(cells: Column, j: Column) -> Column:
            diagonal, up, back = F.element_at(before, j), F.element_at(before, j + 1), F.element_at(cells, F.lit(-1))
            miss = F.when(F.element_at(h, j) == word, 0).otherwise(1)
            best = (F.when(diagonal["c"] + miss <= F.least(up["c"], back["c"]) + 1, cell(diagonal["c"] + miss, diagonal["s"] + miss, diagonal["d"], diagonal["i"]))
                    .when(up["c"] <= back["c"], cell(up["c"] + 1, up["s"], up["d"] + 1, up["i"])).otherwise(cell(back["c"] + 1, back["s"], back["d"], back["i"] + 1)))
            return F.concat(cells, F.array(best))

        steps = F.when(F.size(h) > 0, F.sequence(F.lit(1), F.size(h))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, left, column)

    return F.when(r.isNotNull() & h.isNotNull(), F.element_at(F.aggregate(r, first, row), F.lit(-1)))


def align_tokens(ref: list[str], hyp: list[str]) -> tuple[int, int, int, str]:
    """(substitutions, deletions, insertions, alignment): w, [-w], [+w], [a->b]; same preferences as edit_counts."""
    # each cell is (cost, substitutions, deletions, insertions, how it was reached): the rule of edit_counts, with the edits carried along as a chain
    line: list[tuple] = [(0, 0, 0, 0, None)]
    for word in hyp:
        c, s, d, i, chain = line[-1]
        line.append((c + 1, s, d, i + 1, (chain, f"[+{word}]")))
    for said in ref:
        c, s, d, i, chain = line[0]
        fresh = [(c + 1, s, d + 1, i, (chain, f"[-{said}]"))]
        for diagonal, up, word in zip(line, line[1:], hyp, strict=False):
            back, miss = fresh[-1], int(word != said)
            if diagonal[0] + miss <= min(up[0], back[0]) + 1:
                c, s, d, i, chain = diagonal
                fresh.append((c + miss, s + miss, d, i, (chain, f"[{said}->{word}]" if miss else said)))
            elif up[0] <= back[0]:
                c, s, d, i, chain = up
                fresh.append((c + 1, s, d + 1, i, (chain, f"[-{said}]")))
            else:
                c, s, d, i, chain = back
                fresh.append((c + 1, s, d, i + 1, (chain, f"[+{word}]")))
        line = fresh
    _, s, d, i, chain = line[-1]
    edits = []
    while chain is not None:
        chain, edit = chain
        edits.append(edit)
    return s, d, i, " ".join(reversed(edits))


@F.pandas_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in ("s", "d", "i")] + [T.StructField("alignment", T.StringType())]))
def align(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    """struct<s, d, i, alignment>; a NULL side counts as one without tokens."""
    rows = [align_tokens([] if r is None else list(r), [] if h is None else list(h)) for r, h in zip(ref, hyp, strict=True)]
    return pd.DataFrame(rows, columns=["s", "d", "i", "alignment"])


def wer(errors: Column, reference_length: Column) -> Column:
    """Errors per reference token; with an empty reference 0 without errors and infinity with any."""
    return F.when(reference_length > 0, errors / reference_length).when(errors == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))


def counts_sql(ref: str, hyp: str, alignment: bool = False) -> str:
    """DuckDB SQL of edit_counts() over two columns; with alignment, each cell carries its edits too, in `a`."""
    names = {"c": "bigint", "s": "bigint", "d": "bigint", "i": "bigint", **({"a": "varchar"} if alignment else {})}

    def cell(edit: str, **values: str) -> str:
        values = {**values, "a": f"{values.pop('a')} || {edit}"} if alignment else {k: v for k, v in values.items() if k != "a"}
        return "{" + ", ".join(f"'{n}': {v}" for n, v in values.items()) + "}"

    heard = f"list_reduce(list_prepend('', {hyp}[1:j]), lambda p, q: p || ' [+' || q || ']')"
    first = f"list_transform(range(0, len({hyp}) + 1), lambda j: " + "{" + ", ".join(f"'{n}': {v}" for n, v in {"c": "cast(j as bigint)", "s": "cast(0 as bigint)", "d": "cast(0 as bigint)", "i": "cast(j as bigint)", **({"a": heard} if alignment else {})}.items()) + "})"
    empty = f"cast([] as struct({', '.join(f'{n} {t}' for n, t in names.items())})[])"
    w, h = f"{ref}[x.k]", f"{hyp}[y.j]"
    left = cell(f"' [-' || {w} || ']'", c="p.prev[1].c + 1", s="p.prev[1].s", d="p.prev[1].d + 1", i="p.prev[1].i", a="p.prev[1].a")
    miss = f"(case when {h} = {w} then 0 else 1 end)"
    dia, up, back = "p.prev[y.j]", "p.prev[y.j + 1]", "b.cells[y.j]"
    changed = f"(case when {h} = {w} then ' ' || {w} else ' [' || {w} || '->' || {h} || ']' end)"
    best = (f"case when {dia}.c + {miss} <= least({up}.c, {back}.c) + 1 then " + cell(changed, c=f"{dia}.c + {miss}", s=f"{dia}.s + {miss}", d=f"{dia}.d", i=f"{dia}.i", a=f"{dia}.a")
            + f" when {up}.c <= {back}.c then " + cell(f"' [-' || {w} || ']'", c=f"{up}.c + 1", s=f"{up}.s", d=f"{up}.d + 1", i=f"{up}.i", a=f"{up}.a") + " else " + cell(f"' [+' || {h} || ']'", c=f"{back}.c + 1", s=f"{back}.s", d=f"{back}.d", i=f"{back}.i + 1", a=f"{back}.a") + " end")
    inner = f"list_reduce(list_prepend({{'j': cast(0 as bigint), 'cells': [{left}]}}, list_transform(range(1, len({hyp}) + 1), lambda j: {{'j': cast(j as bigint), 'cells': {empty}}})), lambda b, y: {{'j': y.j, 'cells': list_concat(b.cells, [{best}])}}).cells"
    return f"list_reduce(list_prepend({{'k': cast(0 as bigint), 'prev': {first}}}, list_transform(range(1, len({ref}) + 1), lambda k: {{'k': cast(k as bigint), 'prev': {empty}}})), lambda p, x: {{'k': x.k, 'prev': {inner}}}).prev[-1]"
