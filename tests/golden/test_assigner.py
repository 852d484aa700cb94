"""The nearest known faces of a new one are found without sorting all."""

import numpy as np

from shoebox.operators import clustering


def test_nearest_rows_are_those_of_a_whole_sort():
    rng = np.random.default_rng(5)
    for n in (1, 3, 64, 65, 500):
        d = rng.integers(0, 20, n) / 10  # many ties
        assert clustering.nearest_rows(d, 64).tolist() == np.lexsort((np.arange(n), d))[:64].tolist()
