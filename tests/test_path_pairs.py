"""Pairs by common neighbours against loops, and that nothing is shuffled by pair."""

import functools
import random
import re
from collections import Counter

import pytest

from kinmap.operators import mapped, ranking


@pytest.fixture(scope="module")
def sides(spark):
    pick = random.Random(5)
    ends = lambda: [(pick.randrange(-9, 40), pick.randrange(30), pick.choice([-1.0, 1.0, 2.0])) for _ in range(300)]
    one, two = ends(), [(m, v, w) for v, m, w in ends()] + [(3, v, 1.0) for v in range(60)]
    want = Counter()
    for u, m, w in one:
        for k, v, x in two:
            if k == m:
                want[u, v] += w * x
    return spark.createDataFrame(one, "u long, mid long, w double"), spark.createDataFrame(two, "mid long, v long, w double"), want


def physical(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_sums_are_those_of_loops(spark, sides, monkeypatch):
    one, two, want = sides
    of = mapped.Mapped.of
    for part_rows in (1 << 22, 70):
        monkeypatch.setattr(mapped.Mapped, "of", functools.partial(of, part_rows=part_rows))
        for by in ("u", "v"):
            rows = mapped.path_sums(one, two, by).collect()
            assert len(rows) == len(want) and {(r.u, r.v): r.score for r in rows} == dict(want)
    monkeypatch.setattr(mapped, "mounted", lambda df: None)  # a folder that can't be mapped
    assert {(r.u, r.v): r.score for r in mapped.path_sums(one, two).collect()} == dict(want)
    with pytest.raises(ValueError, match="unknown end"):
        mapped.path_sums(one, two, "mid")


def test_pairs_dealt_by_v_rank_the_same(sides):
    one, two, want = sides
    pairs, turned = mapped.path_sums(one, two), mapped.path_sums(one, two, "v")
    tests = pairs.where("(u + v) % 7 = 0").select("u", "v")
    found = lambda df: sorted(map(tuple, df.collect()))
    assert found(ranking.both_ranks(pairs, tests, 60, 60, turned)) == found(ranking.both_ranks(pairs, tests, 60, 60))
    assert found(ranking.mutual_best(pairs, turned)) == found(ranking.mutual_best(pairs))


def test_queries_shuffle_nothing_by_pair(spark):
    from kinmap.plans import registry

    for name in ("e12_best_per_target", "e13_mutual_best", "e16_predicted_groups"):
        plan = physical(registry.QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert "MapInArrow" in plan
        # Groups and best pairs are found where the pairs are; only what is found of them is shuffled.
        assert not re.search(r"hashpartitioning\((u#\d+L, v#|mid#)", plan.split("MapInArrow")[0]) or name == "e13_mutual_best"
