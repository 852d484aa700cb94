import numpy as np
import pyarrow as pa

from shoebox.llm import classifier


def test_packed_grams_come_back_as_shares():
    texts = [b"a b a b", b"", b"x " * 700 + b"rare words here", b"plain words of a plain text"]
    cells = classifier.grams(texts)
    rows = [classifier.packed(c) for c in cells]
    got, values, ends = classifier.unpacked([pa.chunked_array([pa.array([r[i] for r in rows], pa.binary())]) for i in range(4)])
    for i, c in enumerate(cells):
        want, shares = classifier.shares(c)
        assert got[ends[i] : ends[i + 1]].tolist() == want.tolist()
        assert np.allclose(values[ends[i] : ends[i + 1]], shares)


def test_gram_scores_do_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    ends = np.r_[0, np.cumsum([4, 0, 7, 1, 0, 12])]
    cells, values, w = rng.integers(0, 2 * classifier.CELLS, ends[-1]), rng.random(ends[-1]), rng.normal(size=2 * classifier.CELLS)
    whole = classifier.gram_scores(w, cells, values, ends)
    assert np.allclose(whole, [(values[a:b] * w[cells[a:b]]).sum() for a, b in zip(ends, ends[1:])])
    monkeypatch.setattr(classifier, "BLOCK", 5)
    assert np.allclose(classifier.gram_scores(w, cells, values, ends), whole)
    assert classifier.gram_scores(w, cells[:0], values[:0], np.zeros(1, int)).tolist() == []
