from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np

from takeloom.llm import quota_sample
from takeloom.llm.flow import Network

POP = "g int, p string, t string, id string, quota int, available int"
TARGETS = "g int, p string, t string, target_permille int, min_rows int, sample_size int, available int"


def frames(spark, rows, targets):
    return spark.createDataFrame([(*r, f"i{n}", 7, 7) for n, r in enumerate(rows)], POP), spark.createDataFrame([(*t, 7) for t in targets], TARGETS)


def solved(spark, rows, targets, seed=1):
    pop, goal = frames(spark, rows, targets)
    return pop, quota_sample.quotas(pop, goal, "g", "p", "t", seed=seed)


def test_flow_against_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        supply, demand = [rng.randint(0, 3) for _ in range(2)], [rng.randint(0, 3) for _ in range(3)]
        cost = [[rng.randint(0, 9) for _ in range(3)] for _ in range(2)]
        net, arcs = Network(), {}
        for i in range(2):
            net.arc("s", ("a", i), supply[i], 0)
            for j in range(3):
                arcs[i, j] = net.arc(("a", i), ("b", j), 2, cost[i][j])
        for j in range(3):
            net.arc(("b", j), "t", demand[j], 0)
        sent = net.send("s", "t", 99)
        best: dict[int, int] = {}
        for x in itertools.product(range(3), repeat=6):
            f = [x[:3], x[3:]]
            if all(sum(f[i]) <= supply[i] for i in range(2)) and all(f[0][j] + f[1][j] <= demand[j] for j in range(3)):
                c = sum(f[i][j] * cost[i][j] for i in range(2) for j in range(3))
                best[sum(x)] = min(c, best.get(sum(x), c))
        assert sent == max(best) and sum(net.flow(a) * cost[i][j] for (i, j), a in arcs.items()) == best[sent]
    net = Network()
    net.arc("s", "t", 5, 2)
    assert net.send("s", "t", 9) == 5 and net.send("s", "t", 1) == 0


def test_shortfalls_and_floors(spark):
    rows = [(1, "a", "x")] * 50 + [(1, "a", "y")] * 2 + [(1, "b", "x")] * 50 + [(1, "b", "y")] * 30
    targets = [(1, "a", "x", 250, 0, 40), (1, "a", "y", 250, 0, 40), (1, "b", "x", 490, 1, 40), (1, "b", "y", 10, 6, 40), (1, "c", "x", 0, 0, 40), (1, "c", "y", 0, 3, 40)]
    pop, q = solved(spark, rows, targets)
    got = {(r.p, r.t): r for r in q.collect()}
    assert {k: (r.wanted, r.shortfall) for k, r in got.items()} == {("a", "x"): (10, 0), ("a", "y"): (10, 8), ("b", "x"): (20, 0), ("b", "y"): (6, 0), ("c", "x"): (0, 0), ("c", "y"): (3, 3)}
    assert all(r.quota <= r.available for r in got.values()) and got["b", "y"].quota >= 6 and got["a", "y"].quota == 2
    # what a/y lacks is taken from its own row or column
    assert got["a", "x"].quota + got["b", "y"].quota + got["b", "x"].quota >= 40 - 2
    drawn = Counter((r.p, r.t) for r in quota_sample.draw(pop, q, "g", "p", "t", "id", seed=5).collect())
    assert drawn == Counter({k: r.quota for k, r in got.items() if r.quota})


def test_random_rounding_keeps_the_size():
    cells = [("a", str(i), 333 if i < 2 else 334, 0, 0, 99) for i in range(3)]
    seen = Counter()
    for seed in range(60):
        n = [c["quota"] for c in quota_sample.cell_quotas(cells, 10, seed)]
        assert sum(n) == 10 and all(3 <= x <= 4 for x in n)
        seen[tuple(n)] += 1
    assert len(seen) == 3


def test_hidden_cases(spark):
    assert solved(spark, [], [(1, "a", "x", 1000, 0, 3)])[1].collect()[0].shortfall == 3
    assert solved(spark, [(1, "a", "x")], [])[1].collect() == []
    assert solved(spark, [(None, "a", "x"), (1, None, "x")], [(1, None, "x", 500, 0, 3), (1, "a", "x", 500, None, 3)])[1].collect()[0].available == 0
    two = solved(spark, [(1, "a", "x")] * 3, [(1, "a", "x", 500, 0, 4), (1, "a", "x", 500, 0, 4)])[1].collect()
    assert sorted(r.shortfall for r in two) == [0, 1]


def test_latest_eligible(spark):
    df = spark.createDataFrame([(1, "u", "a", "x", 0.5, None, 1, 1), (1, "u", "b", "x", 0.7, None, 2, 2), (1, "v", "a", "x", 0.5, None, 1, 3), (1, "v", "a", "x", 0.5, 9, 2, 4), (1, "w", "a", "x", float("nan"), None, 1, 5), (1, "w", "a", "x", 0.1, None, 1, 6)],
                               "g int, id string, p string, t string, rate double, deleted_at int, loaded_at int, row_id int")
    from pyspark.sql import functions as F

    got = quota_sample.eligible(df, "g", "id", "p", "t", lambda r: r.isNotNull() & ~F.isnan(r))
    assert sorted((r.id, r.p) for r in got.collect()) == [("u", "b"), ("w", "a")]


def quotas_of(cells, size, seed=0):
    return [c["quota"] for c in quota_sample.cell_quotas(cells, size, seed)]


def test_margins_are_met_where_they_can_be():
    cells = [("a", "x", 250, 0, 25, 0), ("a", "y", 250, 0, 25, 900), ("b", "x", 250, 0, 25, 900), ("b", "y", 250, 0, 25, 900)]
    assert quotas_of(cells, 100) == [0, 50, 50, 0]


def test_size_is_kept_and_conflicts_told():
    """Floors within the size are kept and taken back elsewhere; floors beyond it are told as unmet."""
    cells = [("a", "x", 900, 0, 90, 500), ("a", "y", 50, 20, 20, 500), ("b", "x", 25, 20, 20, 500), ("b", "y", 25, 20, 20, 500)]
    got = quotas_of(cells, 100)
    assert sum(got) == 100 and all(q >= c[3] for q, c in zip(got, cells, strict=True))
    tight = [(r, c, p, 40, max(40, w), a) for r, c, p, _, w, a in cells]
    out = quota_sample.cell_quotas(tight, 100, 0)
    assert sum(o["quota"] for o in out) == 100 and sum(o["unmet_floor"] for o in out) == 60


def test_quotas_against_brute_force():
    """No whole table within bounds misses the margins by less (beyond rounding), and size, floors and availability hold."""
    rng = random.Random(11)
    for trial in range(40):
        size = rng.randint(3, 8)
        parts = [rng.randint(0, 5) for _ in range(4)]
        permille = [1000 * x // max(1, sum(parts)) for x in parts]
        permille[0] += 1000 - sum(permille)
        cells = []
        for (r, c), p in zip(itertools.product("ab", "xy"), permille, strict=True):
            floor = rng.choice((0, 0, 1))
            cells.append((r, c, p, floor, max(floor, -(-size * p // 1000)), rng.choice((0, 2, 5, 9))))
        total, got = min(size, sum(c[5] for c in cells)), quotas_of(cells, size, trial)
        least = [min(c[3], c[5]) for c in cells]
        assert sum(got) == total and all(f <= q <= c[5] for f, q, c in zip(least, got, cells, strict=True))

        def missed(q):
            off = 0.0
            for k in (0, 1):
                for name in {c[k] for c in cells}:
                    off += abs(sum(x for x, c in zip(q, cells, strict=True) if c[k] == name) - size * sum(c[2] for c in cells if c[k] == name) / 1000)
            return off

        best = min(missed(q) for q in itertools.product(*[range(f, c[5] + 1) for f, c in zip(least, cells, strict=True)]) if sum(q) == total)
        assert missed(got) < best + 4  # rounding moves each of four margins by less than one


def test_rounding_keeps_means_and_margins():
    table = {("a", "x"): 1333, ("a", "y"): 667, ("b", "x"): 250, ("b", "y"): 750, ("c", "x"): 500, ("c", "y"): 2500}
    rng, sums = np.random.default_rng(4), Counter()
    for _ in range(3000):
        whole = quota_sample.rounded(table, rng)
        assert sum(whole.values()) == 6 and all(v // 1000 <= whole[k] <= -(-v // 1000) for k, v in table.items())
        assert whole["a", "x"] + whole["a", "y"] == 2 and whole["b", "x"] + whole["b", "y"] == 1 and whole["c", "x"] + whole["c", "y"] == 3
        sums.update(whole)
    assert all(abs(sums[k] / 3000 - v / 1000) < 0.05 for k, v in table.items())


def test_draw_hot_cell_and_ties(spark):
    pop = spark.range(20_000).selectExpr("1 as g", "'a' as p", "'x' as t", "cast(id div 2 as string) as id")  # each id twice
    q = spark.createDataFrame([(1, "a", "x", 501), (1, "b", "x", 3)], "g int, p string, t string, quota long")
    first = sorted(r.id for r in quota_sample.draw(pop, q, "g", "p", "t", "id", seed=1).collect())
    assert len(first) == 501 and first == sorted(r.id for r in quota_sample.draw(pop.repartition(3), q, "g", "p", "t", "id", seed=1).collect())
    assert quota_sample.draw(pop.limit(0), q, "g", "p", "t", "id").collect() == []
    assert quota_sample.draw(pop.limit(30), q, "g", "p", "t", "id").count() == 30


def test_margin_report(spark):
    q = spark.createDataFrame([(1, "a", "x", 500, 9, 9), (1, "a", "y", 500, 9, 0)], "g int, p string, t string, permille long, size long, quota long")
    got = {(r.margin, r.category): (r.target, r.drawn, r.missed) for r in quota_sample.margins(q, "g", "p", "t").collect()}
    assert got == {("p", "a"): (9.0, 9, 0), ("t", "x"): (4.5, 9, 4), ("t", "y"): (4.5, 0, 4)}
