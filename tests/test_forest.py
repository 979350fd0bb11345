"""A forest scores by numbered cuts what its trees score one by one."""

import numpy as np

from seqloom.operators import outliers


def test_forest_by_numbers():
    r = np.random.default_rng(3)
    x = np.stack([r.integers(0, 9, 3000).astype(float), r.normal(0, 5, 3000), r.integers(0, 3, 3000) / 7], axis=1)
    x[:4] = [[np.nan] * 3, [np.inf] * 3, [-np.inf] * 3, [0, np.nan, 9]]
    for n in (1, 2, 3, 40, 256):
        trees = [outliers.grown(x[10 + t * 5 :][:n], 42, t) for t in range(25)]
        want = np.mean([outliers.path_length(t, x) for t in trees], axis=0)
        forest = outliers.Forest(trees, 3)
        assert (forest.mean_path(x) == want).all() and (forest.mean_path(x, 700) == want).all()
