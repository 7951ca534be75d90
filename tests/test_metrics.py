"""Group metrics and ranks on cases worked out by hand."""

import pytest

from kinmap.operators import groups, ranking

TRUTH = [("e0", "src", 0), ("e0", "tgt", 1), ("e0", "tgt", 2), ("e1", "src", 1), ("e1", "tgt", 0)]
ENTITIES = "eid string, side string, node long"


@pytest.fixture(scope="module")
def truth(spark):
    return spark.createDataFrame(TRUTH, ENTITIES), spark.createDataFrame([("e0",), ("e1",)], "eid string")


def values(df):
    return {r.name: r.value for r in df.collect()}


def test_perfect_prediction_scores_one(truth):
    names = (*groups.DEFAULTS, "M2M-SGS-weighted", "M2M-EGS-weighted")
    assert all(v == pytest.approx(1.0) for v in values(groups.scores(*truth, *truth, names)).values())


def test_missing_prediction(spark, truth):
    pred = spark.createDataFrame([("e0", "src", 0), ("e0", "tgt", 1)], ENTITIES)
    ids = spark.createDataFrame([("e0",)], "eid string")
    found = values(groups.scores(*truth, pred, ids))
    assert found == pytest.approx({"ACS": 2 / 7, "MSF1": 1 / 3, "MicroF1": 0.5, "M2M-SGS": 1 / 12, "M2M-EGS": 1.0})


def test_empty_prediction_and_predicted_only_entity(spark, truth):
    pred = spark.createDataFrame([("other", "tgt", 1)], ENTITIES)
    ids = spark.createDataFrame([("e0",), ("e1",), ("other",)], "eid string")
    found = values(groups.scores(*truth, pred, ids))
    assert found["ACS"] == found["MSF1"] == found["MicroF1"] == 0


def test_repeated_ids_count_once(spark, truth):
    pred = truth[0].union(truth[0])
    assert all(v == pytest.approx(1.0) for v in values(groups.scores(*truth, pred, truth[1])).values())


def test_unknown_names_are_errors(spark, truth):
    with pytest.raises(ValueError):
        groups.scores(*truth, *truth, ("nothing",))
    with pytest.raises(ValueError):
        ranking.combine("median", None, None)


def test_predicted_groups_pick_the_best_targets(spark, truth):
    rows = [(0, 0, 0.1), (0, 1, 0.9), (0, 2, 0.8), (1, 0, 0.7), (1, 1, 0.2), (1, 2, 0.1)]
    pairs = spark.createDataFrame(rows, "u long, v long, score double")
    got = {(r.eid, r.side, r.node) for r in ranking.predicted_groups(pairs, *truth, 2, 3).collect()}
    assert got == set(TRUTH)


def test_top_k_beyond_the_nodes_and_zero(spark, truth):
    pairs = spark.createDataFrame([(0, 1, 0.5)], "u long, v long, score double")
    every = ranking.predicted_groups(pairs, *truth, 2, 3, top_k=10).where("side = 'tgt' AND eid = 'e0'")
    assert sorted(r.node for r in every.collect()) == [0, 1, 2]
    assert ranking.predicted_groups(pairs, *truth, 2, 3, top_k=0).where("side = 'tgt'").isEmpty()


def brute_rank(scores, u, v, size):
    row = [scores.get((u, k), 0.0) for k in range(size)]
    return sorted(range(size), key=lambda k: (-row[k], k)).index(v) + 1


def test_ranks_with_ties_absent_and_negative_pairs(spark):
    scores = {(0, 1): 0.5, (0, 3): 0.5, (0, 4): -1.0, (1, 2): 0.0, (2, 0): -0.5}
    pairs = spark.createDataFrame([(u, v, s) for (u, v), s in scores.items()], "u long, v long, score double")
    tests = [(u, v) for u in range(3) for v in range(6)]
    got = ranking.ranks(pairs, ranking.scored_tests(pairs, spark.createDataFrame(tests, "u long, v long")), 6).collect()
    assert {(r.u, r.v): r.rank for r in got} == {(u, v): brute_rank(scores, u, v, 6) for u, v in tests}


def test_degree_anchors_match_the_full_table(spark):
    one, two = [(k, k % 4) for k in range(9)], [(k, (k * 2) % 5) for k in range(7)]
    a, b = (spark.createDataFrame(x, "node long, degree long") for x in (one, two))
    full = sorted((abs(d - e), u, v) for u, d in one for v, e in two)
    for k in (1, 5, 17, 63):
        got = {(r.u, r.v) for r in ranking.degree_anchors(a, b, k).collect()}
        assert got == {(u, v) for _, u, v in full[:k]}


def test_ranks_by_blocks(spark):
    """The same ranks as from all pairs, with ties and blocks on both sides."""
    import numpy as np

    from kinmap.operators import ranking, similarity

    rng = np.random.default_rng(2)
    sides = [spark.createDataFrame([(k, [float(x) for x in rng.integers(0, 3, 4)]) for k in range(n)], "node long, vec array<double>") for n in (25, 19)]
    tests = spark.createDataFrame([(int(u), int(v)) for u, v in zip(rng.permutation(25)[:12], rng.permutation(19)[:12])], "u long, v long")
    got = {tuple(r) for r in similarity.block_ranks(*sides, tests, similarity.inner, rows=8).select("u", "v", "direction", "rank").collect()}
    pairs = similarity.pairwise(*sides, similarity.inner, rows=8)
    want = {tuple(r) for r in ranking.both_ranks(pairs, tests, 25, 19).select("u", "v", "direction", "rank").collect()}
    assert got == want and len(got) == 24
