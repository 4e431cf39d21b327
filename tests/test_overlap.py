"""Pairs by lists of equal titles are those of all matters."""

import random

import pytest

from moothall.plans.joins import word_overlap


@pytest.mark.parametrize("most", [1, 3, 500])
def test_word_overlap_by_all_pairs(spark, most):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices("ab", k=rng.randint(1, 3))), rng.choice("xy")) for i in range(60)]
    got = sorted(tuple(r) for r in word_overlap(spark.createDataFrame(rows, "id long, title string, file string"), most).collect())
    sets = {i: set(t.split()) for i, t, _ in rows}
    want = sorted((i, j, len(sets[i] & sets[j]) / min(len(sets[i]), len(sets[j]))) for i, _, f in rows for j, _, g in rows if f == g and i < j)
    assert got == want
