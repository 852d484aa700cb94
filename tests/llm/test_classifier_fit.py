import random

import numpy as np

from shoebox.llm import classifier


def _table(spark, n, seed):
    rng = random.Random(seed)
    word = lambda good: rng.choice(["cat", "mat", "sat", "hat", "rat"] if rng.random() < (0.7 if good else 0.4) else ["BUY", "w!", "#x", "now"]) + str(rng.randrange(50))
    rows = [(i, " ".join(word(i % 4 > 0) for _ in range(rng.randrange(3, 12))), int(i % 4 > 0)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    return rows, df.select("doc_id", "text"), df.select("doc_id", "quality")


def test_every_labelled_row_counts(spark, monkeypatch):
    """As many learning rows score below one half as are labelled bad: of all of them, also where there are more than 5,000."""
    monkeypatch.setattr(classifier, "STEPS", 4)
    rows, docs, labels = _table(spark, 9_000, 1)
    got = {r.doc_id: r.score for r in classifier.classify(docs, labels).where("not held_out").collect()}
    assert len(got) > 5_500
    assert sum(s < 0.5 for s in got.values()) == sum(not q for i, _, q in rows if i in got)


def test_the_spread_fit_is_the_fit_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(classifier, "ENOUGH", 1e-5)
    rows, docs, labels = _table(spark, 90, 2)
    model = classifier.learn(docs, labels)
    known = [r for r in rows if r[0] in {x.doc_id for x in docs.where(~classifier.held_out(docs["doc_id"])).collect()}]
    texts, y = [t.encode() for _, t, _ in known], np.array([q for *_, q in known])
    x = classifier.matrix(texts)
    assert np.allclose(model["mean"], x.mean(0)) and np.allclose(model["scale"], x.std(0) + 1e-9)
    cells, values = (np.concatenate(z) for z in zip(*map(classifier.shares, classifier.grams(texts)), strict=True))
    ends = np.r_[0, np.cumsum([len(classifier.shares(c)[0]) for c in classifier.grams(texts)])]
    better, worse = (z.ravel() for z in np.meshgrid(np.flatnonzero(y == 1), np.flatnonzero(y == 0)))
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-9), -8, 8)
    w = classifier.fit_weights(z, cells, values, ends, better, worse)
    assert np.allclose(np.r_[model["weights"], model["grams"]], w, atol=5e-3)
    scores = np.sort(z @ w[: z.shape[1]] + classifier.gram_scores(w[z.shape[1] :], cells, values, ends))
    k = int((y == 0).sum())
    assert abs(model["threshold"] - (scores[k - 1] + scores[k]) / 2) < 2e-2


def test_a_quantile_of_many_equal_scores(spark):
    values = [1.5] * 40 + [-3.0, 2.0, 1.5 + 1e-12, -1e300, 1e300]
    df = spark.createDataFrame([(v,) for v in values], "score double")
    for n in (0, 1, 2, 20, 41, 42, 43, 44):
        assert classifier.nth_score(df, n) == sorted(values)[n]
