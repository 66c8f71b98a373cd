"""Linear mixed models with two crossed random intercepts, from sufficient statistics gathered in Spark.

y = X b + u[a] + w[c] + e. The block of the factor with more levels is diagonal: it is eliminated by sums in Spark over its levels of equal row
count, which hold for every variance ratio, so none of its levels is collected. Of the other factor the sums per level and the level pairs that share
a level of the first come to the driver, as a sparse matrix: levels with few partners are eliminated one by one, and only the core that is left,
which must be within max_levels, is solved densely. Rows are never collected. A level of the larger factor with k partners makes k * k pairs.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takeloom.operators.stats import clean
from takeloom.operators.validate import ProblemsFound
from takeloom.session import stage

#: FIXED VALUE: levels with more partners than this are left to the dense core.
PARTNERS = 16


class Elimination:
    """The order in which levels are eliminated from a symmetric sparse matrix: rounds of levels without a common entry, then a dense core."""

    def __init__(self, n: int, pairs: np.ndarray, max_core: int):
        near: list[set[int]] = [set() for _ in range(n)]
        for i, j in pairs.tolist():
            near[i].add(j)
            near[j].add(i)
        self.at: dict[tuple[int, int], int] = {}
        for i, j in pairs.tolist():
            self.at[min(i, j), max(i, j)] = n + len(self.at)
        place = lambda i, j: i if i == j else self.at.setdefault((min(i, j), max(i, j)), n + len(self.at))
        self.rounds: list[tuple[np.ndarray, ...]] = []
        left = set(range(n))
        while left and (least := min(len(near[k]) for k in left)) <= PARTNERS:
            most, blocked, pivots = min(PARTNERS, 2 * least), set(), []
            for k in sorted((k for k in left if len(near[k]) <= most), key=lambda k: (len(near[k]), k)):
                if k not in blocked:
                    pivots.append(k)
                    blocked |= near[k]
            edges = [(k, i, place(k, i)) for k in pivots for i in sorted(near[k])]
            fills = [(place(i, j), place(k, i), place(k, j), k) for k in pivots for i in near[k] for j in near[k] if i <= j]
            self.rounds.append((np.array(pivots), np.array(edges, dtype=int).reshape(-1, 3), np.array(fills, dtype=int).reshape(-1, 4)))
            for k in pivots:
                for i in near[k]:
                    near[i] = (near[i] | near[k]) - {i, k}
                left.discard(k)
        self.core = np.array(sorted(left), dtype=int)
        if len(self.core) > max_core:
            raise ProblemsFound(f"more than {max_core} levels of a factor")
        rank = {k: r for r, k in enumerate(self.core.tolist())}
        inside = [(rank[i], rank[j], at) for (i, j), at in self.at.items() if i in rank and j in rank]
        self.inside = np.array(inside, dtype=int).reshape(-1, 3)
        self.size = n + len(self.at)

    def solve(self, values: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, float]:
        """right' M^-1 right and log |M| of the matrix whose diagonal and pairs are values."""
        v, r = values.copy(), right.copy()
        total, logdet = np.zeros((r.shape[1], r.shape[1])), 0.0
        for pivots, edges, fills in self.rounds:
            d, own = v[pivots], r[pivots]
            logdet += np.log(d).sum()
            total += own.T @ (own / d[:, None])
            if len(edges):
                np.subtract.at(r, edges[:, 1], (v[edges[:, 2]] / v[edges[:, 0]])[:, None] * r[edges[:, 0]])
                np.subtract.at(v, fills[:, 0], v[fills[:, 1]] * v[fills[:, 2]] / v[fills[:, 3]])
        if len(self.core):
            m = np.diag(v[self.core])
            m[self.inside[:, 0], self.inside[:, 1]] = m[self.inside[:, 1], self.inside[:, 0]] = v[self.inside[:, 2]]
            chol = np.linalg.cholesky(m)
            half = np.linalg.solve(chol, r[self.core])
            total += half.T @ half
            logdet += 2 * np.log(np.diag(chol)).sum()
        return total, logdet


def sufficient(df: DataFrame, y: str, x: list[str], factors: tuple[str, str], max_levels: int) -> dict:
    a, c = factors
    cols = [F.lit(1.0).alias("one"), *[clean(n).alias(n) for n in x]]
    rows = stage(df.select(F.col(a).alias("_a"), F.col(c).alias("_c"), *cols, clean(y).alias("_y")).dropna(), "model")
    names = ["one", *x, "_y"]
    upper = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    full = lambda r, name: np.array([[r[f"{name}{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(names))] for i in range(len(names))])
    one = rows.agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"x{i}_{j}") for i, j in upper], F.countDistinct("_a").alias("na"), F.countDistinct("_c").alias("nc")).first()
    swapped = one["na"] > one["nc"]
    small, large = ("_c", "_a") if swapped else ("_a", "_c")
    sums = [F.sum(n).alias(f"s{i}") for i, n in enumerate(names)]
    each = rows.groupBy(large).agg(F.count("*").alias("n"), *sums)
    by_n = each.groupBy("n").agg(F.count("*").alias("levels"), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"q{i}_{j}") for i, j in upper]).collect()
    index_n = {r["n"]: k for k, r in enumerate(by_n)}
    levels = rows.groupBy(small).agg(F.count("*").alias("n"), *sums).toPandas().sort_values(small, key=lambda s: s.astype(str))
    index = {v: k for k, v in enumerate(levels[small])}
    met = rows.groupBy(small, large).agg(F.count("*").alias("m")).join(each, large)
    crossed = met.groupBy(small, "n").agg(F.sum(F.col("m") * F.col("m")).alias("mm"), *[F.sum(F.col("m") * F.col(f"s{i}")).alias(f"b{i}") for i in range(len(names))]).toPandas()
    two = met.select(large, "n", F.col(small).alias("_i"), F.col("m").alias("_m")).join(met.select(large, F.col(small).alias("_j"), F.col("m").alias("_k")), large).where("_i < _j")
    pairs = two.groupBy("_i", "_j", "n").agg(F.sum(F.col("_m") * F.col("_k")).alias("mm")).toPandas()
    at = np.column_stack([pairs["_i"].map(index), pairs["_j"].map(index)]).astype(int).reshape(-1, 2)
    order = Elimination(len(index), np.unique(np.sort(at, axis=1), axis=0), max_levels)
    place = np.array([order.at[min(i, j), max(i, j)] for i, j in at.tolist()], dtype=int)
    where = crossed[small].map(index).to_numpy(dtype=int)
    return {
        "xx": full(one, "x"), "n": one["x0_0"] or 0.0, "swapped": swapped, "order": order, "sizes": np.array([r["n"] for r in by_n], dtype=float), "levels": np.array([r["levels"] for r in by_n], dtype=float),
        "q": np.array([full(r, "q") for r in by_n]).reshape(-1, len(names), len(names)), "own": levels["n"].to_numpy(dtype=float), "zx": levels[[f"s{i}" for i in range(len(names))]].to_numpy(dtype=float), "where": where, "class": crossed["n"].map(index_n).to_numpy(dtype=int),
        "mm": crossed["mm"].to_numpy(dtype=float), "b": crossed[[f"b{i}" for i in range(len(names))]].to_numpy(dtype=float), "place": place, "pair_class": pairs["n"].map(index_n).to_numpy(dtype=int), "pair_mm": pairs["mm"].to_numpy(dtype=float),
    }


def _reml(s: dict, log_ratio: np.ndarray) -> tuple[float, dict]:
    """Restricted log-likelihood profiled over b and the residual variance, at log variance ratios of the two factors (-inf: none)."""
    ratio = np.exp(log_ratio)
    own, other = ratio[::-1] if s["swapped"] else ratio
    w = other / (1 + other * s["sizes"])
    xx = s["xx"] - np.tensordot(w, s["q"], 1)
    z = s["zx"].copy()
    np.subtract.at(z, s["where"], w[s["class"], None] * s["b"])
    values = np.zeros(s["order"].size)
    values[: len(s["own"])] = s["own"]
    np.subtract.at(values, s["where"], w[s["class"]] * s["mm"])
    np.subtract.at(values, s["place"], w[s["pair_class"]] * s["pair_mm"])
    values *= own
    values[: len(s["own"])] += 1
    less, logdet = s["order"].solve(values, math.sqrt(own) * z)
    v = xx - less
    p = len(v) - 1
    xvx, xvy, yvy = v[:p, :p], v[:p, p], v[p, p]
    b = np.linalg.solve(xvx, xvy)
    rss = yvy - xvy @ b
    dof = s["n"] - p
    sigma2 = rss / dof
    value = -0.5 * (dof * (math.log(2 * math.pi * sigma2) + 1) + logdet + (s["levels"] * np.log1p(other * s["sizes"])).sum() + np.linalg.slogdet(xvx)[1])
    return value, {"b": b, "cov": np.linalg.inv(xvx) * sigma2, "sigma2": sigma2, "ratio": ratio}


def fit(df: DataFrame, y: str, x: list[str], factors: tuple[str, str], max_levels: int = 2_000) -> DataFrame:
    """(term, coef, se, z, p, low, high): fixed effects with normal 95% intervals, then the variances of both factors and of the residual.

    REML by a shrinking grid over both variance ratios; a ratio at the lower end of the search is a variance of 0 (boundary).
    """
    s = sufficient(df, y, x, factors, max_levels)
    centre, width = np.array([-2.0, -2.0]), 10.0
    best = _reml(s, centre)
    while width > 1e-4:
        grid = [centre + np.array([i, j]) * width for i in (-1, -0.5, 0, 0.5, 1) for j in (-1, -0.5, 0, 0.5, 1)]
        value, at = max(((_reml(s, np.clip(g, -16, 16))[0], k) for k, g in enumerate(grid)), key=lambda v: v[0])
        if value > best[0] + 1e-12:
            centre, best = np.clip(grid[at], -16, 16), _reml(s, np.clip(grid[at], -16, 16))
        else:
            width /= 2
    f = best[1]
    rows = []
    for name, b, v in zip(["intercept", *x], f["b"], np.diag(f["cov"]), strict=True):
        se = math.sqrt(max(v, 0.0))
        z = float(b / se) if se else None
        rows.append((name, float(b), se, z, math.erfc(abs(z) / math.sqrt(2)) if z is not None else None, float(b - 1.959964 * se), float(b + 1.959964 * se)))
    for name, r in zip(factors, f["ratio"], strict=True):
        rows.append((f"var({name})", 0.0 if r <= math.exp(-15.9) else float(r * f["sigma2"]), None, None, None, None, None))
    rows.append(("var(residual)", float(f["sigma2"]), None, None, None, None, None))
    return df.sparkSession.createDataFrame(rows, "term string, coef double, se double, z double, p double, low double, high double")
