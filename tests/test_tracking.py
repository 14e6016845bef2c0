"""Assignment against all permutations, and scores with a switch."""

import itertools

import numpy as np
import pytest

from spanloom.operators import tracking


@pytest.mark.parametrize("shape", [(1, 1), (3, 3), (2, 5), (5, 2), (4, 6)])
def test_assignment_is_optimal(shape):
    rng = np.random.default_rng(sum(shape))
    for _ in range(20):
        cost = rng.random(shape)
        small, large = min(shape), max(shape)
        c = cost if shape[0] <= shape[1] else cost.T
        best = min(sum(c[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
        pairs = tracking.assign(cost)
        assert len(pairs) == small and sum(cost[i, j] for i, j in pairs) == pytest.approx(best)


def test_scores_count_switches(spark):
    rows = [(1, f, "gt", 7, 0.0, 0.0, 10.0, 10.0) for f in range(3)]
    rows += [(1, 0, "pred", 1, 0.0, 0.0, 10.0, 10.0), (1, 1, "pred", 2, 0.0, 0.0, 10.0, 10.0), (1, 2, "pred", 2, 50.0, 50.0, 60.0, 60.0)]
    got = tracking.scores(spark.createDataFrame(rows, "sequence long, frame long, side string, id long, x1 double, y1 double, x2 double, y2 double")).first()
    assert (got.n_true, got.misses, got.extra, got.switches) == (3, 1, 1, 1) and got.mota == 0 and got.motp == 1.0
