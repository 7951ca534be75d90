"""Ranks of tuples over several graphs against a sort in plain Python."""

import math
import random

import pytest

from kinmap.operators import ranking


def expected(tuples, members, tests):
    out = []
    for g in range(3):
        for test, want in tests:
            for cluster in {c for c, k, n in members if k == g and n == want[g]}:
                inside = any((cluster, k, want[k]) in members for k in range(3) if k != g)
                met = [t for t in tuples if inside and t[0] == cluster and t[1][g] == want[g]]
                # Not a number is the greatest, nulls come last.
                met.sort(key=lambda t: ((2, 0) if t[2] is None else (0, 0) if math.isnan(t[2]) else (1, -t[2]), t[1]))
                first = lambda agree: next((r for r, t in enumerate(met, 1) if agree(t[1][k] == want[k] for k in range(3) if k != g)), None)
                out.append((g, test, inside, first(all), first(any)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_ranks_are_those_of_a_sort(spark, seed):
    pick = random.Random(seed)
    members = {(c, g, n) for c in range(3) for g in range(3) for n in range(12) if pick.random() < 0.7}
    each = lambda c, g: [n for k, h, n in members if (k, h) == (c, g)]
    scores = [0.5, 0.25, 0.75, None, float("nan"), 0.0, -1.0]
    tuples = [(c, [x, y, z], pick.choice(scores)) for c in range(3) for x in each(c, 0) for y in each(c, 1) for z in each(c, 2)]
    tests = [(t, [t, 99, 99] if t < 3 else [t, pick.randrange(12), pick.randrange(12)]) for t in range(12)]
    tables = [spark.createDataFrame(*x) for x in ((tuples, "cluster int, nodes array<long>, score double"), (list(members), "cluster int, gid int, node long"), (tests, "test long, nodes array<long>"))]
    want = expected(tuples, members, tests)
    assert any(r[3] for r in want) and any(not r[2] for r in want)
    for agreeing in (None, tables[0].unionByName(tables[0])):
        got = ranking.multiway_ranks(*tables, 3, agreeing)
        assert "Window" not in got._jdf.queryExecution().toString()  # tuples are counted, not sorted
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
