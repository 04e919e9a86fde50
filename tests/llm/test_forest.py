"""Recall of leaves of the production forest, by depth."""

import pytest


@pytest.mark.parametrize("depth", [2, 5, 8])
def test_forest_recall(depth):
    """Planted pairs of cosine 0.95 to 0.97 share a leaf of the production forest, and random pairs seldom do in a deep one."""
    import numpy as np

    from veilmark.llm.embedding_dedup import Forest

    r = np.random.default_rng(depth)
    norm = lambda y: y / np.linalg.norm(y, axis=1, keepdims=True)
    x = norm(r.standard_normal((8000, 64)))
    a, c = x[:1000], r.uniform(0.95, 0.97, (1000, 1))
    away = r.standard_normal(a.shape)
    b = c * a + np.sqrt(1 - c * c) * norm(away - (away * a).sum(1, keepdims=True) * a)
    forest = Forest(x, depth)
    places = lambda y: set(zip(*(v.tolist() for v in forest.leaves(y))))
    share = lambda y: len({k[0] for k in places(a) & places(y)}) / len(a)
    print(depth, share(b), share(x[4000:5000]))
    assert share(b) >= 0.9 and (depth < 8 or share(x[4000:5000]) < 0.5)
