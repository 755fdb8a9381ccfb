"""Two cover trees whose bounds leave nothing out still meet in few steps, and exactly."""

from __future__ import annotations

import numpy as np
import pytest

from airspark.llm.topk import Search, cover_tree


@pytest.mark.parametrize("large", [1, 1 << 26])
def test_few_leaves_meet_and_ties_go_to_the_smaller_id(large):
    rng = np.random.default_rng(3)
    rows = rng.integers(-2, 3, (800, 16)) * large
    ids = rng.permutation(2000)[:800]
    at = np.arange(0, 800, 2)
    queries = rows[at]
    products = queries.astype(object) @ rows.T.astype(object)
    # A first bound that is reached exactly must not lose the rows that reach it.
    floor = np.array([float(sorted(p)[-8]) for p in products])
    search = Search(queries.astype(float), ids[at], rows.astype(float), ids, 5, floor)
    met, leaf = [], search.leaf
    search.leaf = lambda q, c: (met.append(len(q.rows) * len(c.rows)), leaf(q, c))
    search.run(cover_tree(queries.astype(float), np.arange(len(at))), cover_tree(rows.astype(float), np.argsort(ids)))
    for i, p in enumerate(products):
        want = sorted((-s, d) for s, d in zip(p, ids.tolist()) if d != ids[at[i]])[:5]
        assert list(zip((-search.scores[i]).tolist(), search.found[i].tolist())) == want
    assert len(met) <= 400 and sum(met) <= 400 * 800
