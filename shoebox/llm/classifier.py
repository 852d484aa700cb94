"""A quality classifier learned from preference pairs (Bradley-Terry).

Of two labelled texts the better is preferred; the chance of that is the logistic function
of the difference of their scores, and a score is a weighted sum of features of the text:
a few counts, and the shares of its hashed word and character n-grams. Fitting the weights
is logistic regression on feature differences: one problem over counts and n-grams together,
with a penalty for each of the two, solved by limited-memory quasi-Newton steps. The pairs are
all pairs of a good and a bad text. Their loss depends on the two distributions of scores alone:
for each step tasks add up how many texts of each label score what, the driver works out what a
score of either label costs, and tasks add up the gradient of their rows. The threshold is the
quantile of the labelled texts' scores that leaves as many below it as were labelled bad.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm import textstats as ts
from shoebox.llm.common import byte_texts, cut, digests, forget, in_small_batches, slices, spaced_words

#: Pairs per row of the rarer label, where rows in memory are fitted by drawn pairs.
PAIRS = 40
#: The gradient at which a fit over a written table ends; each step reads the table twice.
ENOUGH = 1e-3
#: Scores are told apart by nodes of this distance, up to this size; ranges that a quantile's range is parted into.
NODE, FARTHEST, RANGES = 1 / 32, 64.0, 1024
NODES = int(2 * FARTHEST / NODE) + 3
#: Strength of the penalty of counts, and of n-grams; steps of a fit at most, steps remembered, and the gradient it ends at.
PENALTY, GRAM_PENALTY, STEPS, HISTORY, CLOSE = 1e-2, 1e-3, 60, 8, 1e-5
#: Hash cells of word n-grams (one and two words) and as many of character n-grams (CHARS bytes); what a text's shares add up to.
#: A labelled text sends 2 * CELLS cells at most, of 3 bytes (6 where a cell is there 256 times), however long it is.
CELL_BITS, CHARS, SHARE = 14, 4, 20.0
CELLS = 1 << CELL_BITS
#: Bytes of text that are looked at together, and n-gram cells of a fit.
TOGETHER, BLOCK = 1 << 20, 1 << 19
#: Columns of ``packed`` n-grams.
PACKS = ("words", "word_counts", "chars", "char_counts")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
FEATURES = (
    "log_words", "log_word_length", "symbols", "punctuation", "upper", "digits", "distinct", "most_common", "same_as_before", "repeated",
    "dup_lines", "line_words", "non_ascii", "short_text", "one_letter", "upper_words",
)
_UPPER, _DIGITS, _HIGH = bytes(range(65, 91)), b"0123456789", bytes(range(128, 256))


Parted = tuple[list[bytes], np.ndarray, np.ndarray]


def matrix(texts: list[bytes], parted: Parted | None = None) -> np.ndarray:
    """FEATURES of each text. What depends on a word alone is worked out once for the texts together; ``parted`` is their ``spaced_words``."""
    words, codes, offsets = parted or spaced_words(texts)
    count = np.diff(offsets)
    row = np.repeat(np.arange(len(texts)), count)
    of_rows = lambda marks: np.bincount(row, marks, minlength=len(texts))
    sizes, raw = np.fromiter(map(len, words), np.int64, len(words)), np.frombuffer(b"".join(words), np.uint8)
    upper, lower = (_row_sums(((raw >= a) & (raw < a + 26)).astype(np.int64), sizes) > 0 for a in b"Aa")
    one_letter, upper_words = of_rows((sizes == 1)[codes]), of_rows((upper & ~lower)[codes])
    same = of_rows(np.r_[False, (codes[1:] == codes[:-1]) & (row[1:] == row[:-1])][: len(codes)])
    each = np.sort(row * max(1, len(words)) + codes)
    new = np.flatnonzero(np.r_[True, each[1:] != each[:-1]][: len(each)])
    distinct, most = np.bincount(row[new], minlength=len(texts)), np.zeros(len(texts), np.int64)
    np.maximum.at(most, row[new], np.diff(np.r_[new, len(each)]))
    found = []
    for i, text in enumerate(texts):
        n, size = max(1, int(count[i])), max(1, len(text))
        chars = ts.code_points(text) - ts.count_of(text, ts.WHITE)
        lines = [x for x in text.split(b"\n") if x.strip(ts.WHITE)]
        repeated = ts.repeated_numbers(codes[offsets[i] : offsets[i + 1]], int(distinct[i]), 8)
        found.append([
            np.log1p(count[i]), np.log1p(chars / n), min(2.0, ts.count_of(text, ts.SYMBOLS) / n), min(3.0, ts.count_of(text, b".,;:!?") / n),
            ts.count_of(text, _UPPER) / size, ts.count_of(text, _DIGITS) / size, distinct[i] / n, most[i] / n, same[i] / n,
            repeated / n, 1 - len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))),
            ts.count_of(text, _HIGH) / size, float(count[i] < 20), one_letter[i] / n, upper_words[i] / n,
        ])
    return np.array(found, np.float64).reshape(-1, len(FEATURES))


def grams(texts: list[bytes], parted: Parted | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the cells of its word n-grams, and of its character n-grams, one for each occurrence."""
    words, codes, offsets = parted or spaced_words(texts)
    h, top = digests(words)[:, 0][codes], np.uint64(64 - CELL_BITS)
    two = (h[:-1] * _MIX[0] + h[1:] * _MIX[1]) >> top if len(h) else h
    found = []
    for t, a, b in zip(texts, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        raw = np.frombuffer(t, np.uint8)
        n = max(0, len(raw) - CHARS + 1)
        code = np.zeros(n, np.uint64)
        for i in range(min(CHARS, n)):  # CHARS bytes are one little-endian number
            code[i::CHARS] = raw[i : i + (len(raw) - i) // CHARS * CHARS].view("<u4")
        found.append((np.r_[h[a:b] >> top, two[a : max(a, b - 1)]].astype(np.int32), ((code * _MIX[0]) >> top).astype(np.int32) + CELLS))
    return found


def shares(cells: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(cells, values) of a text's n-grams, a cell once: SHARE times its share among n-grams of its kind."""
    parts = [np.unique(c, return_counts=True) for c in cells]
    return np.concatenate([c for c, _ in parts]), np.concatenate([n * SHARE / max(1, n.sum()) for _, n in parts]).astype(np.float32)


def packed(cells: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
    """A text's n-grams as they travel: for each kind the cells as 16-bit numbers and how often each is there, in one byte where all fit."""
    out = []
    for base, c in zip((0, CELLS), cells, strict=True):
        at, n = np.unique(c, return_counts=True)
        out += [(at - base).astype(np.uint16).tobytes(), n.astype(np.uint8 if n.max(initial=0) < 256 else np.uint32).tobytes()]
    return out


Counted = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def counted(columns: list[pa.ChunkedArray]) -> list[Counted]:
    """For words and for characters, of many texts from ``packed`` columns: (cells, counts, cells of each row, what makes a row's counts its values)."""
    held = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    found = []
    for k, base in enumerate((0, CELLS)):
        at, raw = held[2 * k], held[2 * k + 1]
        size, bytes_ = (np.asarray(pc.binary_length(c), np.int64) for c in (at, raw))
        size = size // 2
        if (bytes_ == size).all():
            n = _flat(raw).astype(np.float64)
        else:
            n = np.concatenate([np.frombuffer(x, np.uint8 if len(x) == own else np.uint32) for x, own in zip(raw.to_pylist(), size.tolist(), strict=True)]).astype(np.float64)
        found.append((_flat(at).view("<u2").astype(np.intp) + base, n, size, SHARE / np.maximum(1, _row_sums(n, size))))
    return found


def _row_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sums of consecutive runs of so many values."""
    found, some = np.zeros(len(sizes)), sizes > 0
    if some.any():
        found[some] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[some])
    return found


def counted_scores(w: np.ndarray, kinds: list[Counted]) -> np.ndarray:
    """What each row's n-grams weigh, as ``gram_scores`` has it."""
    return sum(factor * _row_sums(n * w[cells], size) for cells, n, size, factor in kinds)


def counted_sums(push: np.ndarray, kinds: list[Counted]) -> np.ndarray:
    """The sums of the rows' n-gram values, each row ``push`` times."""
    return sum(np.bincount(cells, n * np.repeat(push * factor, size), minlength=2 * CELLS) for cells, n, size, factor in kinds)


def unpacked(columns: list[pa.ChunkedArray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, values, ends) of many texts from ``packed`` columns, as ``shares`` gives them."""
    kinds = counted(columns)
    ends = np.r_[0, np.cumsum(kinds[0][2] + kinds[1][2])].astype(np.int64)
    cells, values = np.zeros(ends[-1], np.int32), np.zeros(ends[-1], np.float32)
    for (own, n, size, factor), starts in zip(kinds, (ends[:-1], ends[:-1] + kinds[0][2]), strict=True):
        to = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(len(own))
        cells[to], values[to] = own, n * np.repeat(factor, size)
    return cells, values, ends


def _flat(column: pa.BinaryArray) -> np.ndarray:
    """The bytes of a binary column's values without nulls, one after another."""
    _, ends, raw = column.buffers()
    if raw is None or not len(column):
        return np.zeros(0, np.uint8)
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]]


def held_out(doc_id: F.Column) -> F.Column:
    """Whether a row is kept from learning: crc32 of its doc_id as text is 1 modulo 3. A null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def pairs_of(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(better, worse): rows of preference pairs, PAIRS for each row of the rarer label."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rng = np.random.default_rng(7)
    rare, other = (bad, good) if len(bad) <= len(good) else (good, bad)
    mine, theirs = np.repeat(rare, PAIRS), rng.choice(other, len(rare) * PAIRS)
    return (theirs, mine) if rare is bad else (mine, theirs)


def _blocks(ends: np.ndarray):
    """(rows, entries): slices of consecutive rows of about BLOCK entries together."""
    edges = [0]
    while edges[-1] < len(ends) - 1:
        edges.append(max(edges[-1] + 1, int(np.searchsorted(ends, ends[edges[-1]] + BLOCK, "right")) - 1))
    return [(slice(a, b), slice(int(ends[a]), int(ends[b]))) for a, b in zip(edges, edges[1:], strict=False)]


def gram_scores(w: np.ndarray, cells: np.ndarray, values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """What each row's n-grams weigh: row i has ``values`` at ``cells``, from ends[i] to ends[i + 1]."""
    found = np.zeros(len(ends) - 1)
    for rows, own in _blocks(ends):
        row = np.repeat(np.arange(rows.stop - rows.start), np.diff(ends[rows.start : rows.stop + 1]))
        found[rows] = np.bincount(row, values[own] * w[cells[own]], minlength=rows.stop - rows.start)
    return found


def loss_of(w: np.ndarray, z: np.ndarray, cells: np.ndarray, values: np.ndarray, ends: np.ndarray, better: np.ndarray, worse: np.ndarray) -> tuple[float, np.ndarray]:
    """(loss, gradient): the mean logistic loss of score differences, and the penalties; w holds the weights of counts, then of n-grams."""
    k = z.shape[1]
    score = z @ w[:k] + gram_scores(w[k:], cells, values, ends)
    margin = score[better] - score[worse]
    p = 1 / (1 + np.exp(np.clip(margin, -40, 40)))
    push = (np.bincount(better, p, minlength=len(z)) - np.bincount(worse, p, minlength=len(z))) / len(better)
    penalty = np.r_[np.full(k, PENALTY), np.full(len(w) - k, GRAM_PENALTY)]
    gradient = penalty * w
    gradient[:k] -= z.T @ push
    for rows, own in _blocks(ends):
        gradient[k:] -= np.bincount(cells[own], values[own] * np.repeat(push[rows], np.diff(ends[rows.start : rows.stop + 1])), minlength=len(w) - k)
    return float(np.logaddexp(0, -margin).mean() + (penalty * w * w).sum() / 2), gradient


def minimized(loss_at: Callable[[np.ndarray], tuple[float, np.ndarray]], size: int, close: float) -> np.ndarray:
    """The weights at which the gradient of ``loss_at``, which gives a loss and its gradient, is below ``close``: quasi-Newton steps from the last HISTORY changes of the gradient."""
    w = np.zeros(size)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    loss, gradient = loss_at(w)
    for _ in range(STEPS):
        if np.abs(gradient).max() < close:
            break
        way, parts = -gradient, []
        for moved, turned in reversed(held):
            parts.append(moved @ way / (moved @ turned))
            way = way - parts[-1] * turned
        if held:
            moved, turned = held[-1]
            way *= moved @ turned / (turned @ turned)
        for (moved, turned), part in zip(held, reversed(parts), strict=True):
            way += moved * (part - turned @ way / (moved @ turned))
        size, slope = (1.0 if held else 1 / np.abs(gradient).sum()), gradient @ way
        for _ in range(30):
            after = loss_at(w + size * way)
            if after[0] <= loss + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break  # no step lessens the loss any more
        moved, turned = size * way, after[1] - gradient
        w, loss, gradient = w + moved, *after
        if moved @ turned > 0:
            held = [*held, (moved, turned)][-HISTORY:]
    return w


def fit_weights(z: np.ndarray, cells: np.ndarray, values: np.ndarray, ends: np.ndarray, better: np.ndarray, worse: np.ndarray) -> np.ndarray:
    """The weights of counts and n-grams that make ``loss_of`` least, for rows in memory.

    Row i has ``values`` at ``cells``, from ends[i] to ends[i + 1]. A step costs two passes over them, block by block.
    """
    return minimized(lambda w: loss_of(w, z, cells, values, ends, better, worse), z.shape[1] + 2 * CELLS, CLOSE)


def spread(score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first node, weights, slopes) of scores: each is dealt to three nodes by a quadratic spline, so what nodes add up to is smooth in it."""
    inside = np.abs(score) < FARTHEST
    at = (np.clip(score, -FARTHEST, FARTHEST) + FARTHEST) / NODE
    node = np.rint(at).astype(np.int64)
    u = at - node
    weights = np.stack([(0.5 - u) ** 2 / 2, 0.75 - u * u, (0.5 + u) ** 2 / 2])
    return node, weights, np.stack([u - 0.5, -2 * u, u + 0.5]) / NODE * inside


def pair_costs(good: np.ndarray, bad: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(loss, costs of good, costs of bad): the mean logistic loss of all pairs of texts at nodes, and what one text at each node adds to it."""
    apart = np.arange(1 - NODES, NODES) * NODE
    each = np.logaddexp(0, -apart)  # of a good text so far above a bad one
    n, m = good.sum(), bad.sum()
    of_good = np.convolve(each, bad / (n * m), "valid")
    return float(good @ of_good), of_good, np.convolve(each[::-1], good / (n * m), "valid")


class Labelled:
    """The learning rows as a written table of features, which tasks go through for each step; no row leaves them."""

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        # a task reads its rows batch by batch, so their number is the cluster's and sums sent to the driver don't grow with the rows
        self.rows = rows.coalesce(4 * spark.sparkContext.defaultParallelism)
        self.k = len(FEATURES)
        sums = self._summed(lambda x, y, _: np.r_[len(y), y.sum(), x.sum(0)])
        self.n, self.good = (int(sums[0]), int(sums[1])) if len(sums) else (0, 0)
        self.mean, self.scale = np.zeros(self.k), np.ones(self.k)
        if self.n:
            mean = self.mean = sums[2:] / self.n
            self.scale = np.sqrt(self._summed(lambda x, y, _: ((x - mean) ** 2).sum(0)) / self.n) + 1e-9

    def _each(self, of, schema: str, names: list[str]) -> DataFrame:
        def run(batches):
            yield from of(
                (np.array(b.column("x").flatten(), np.float64).reshape(-1, len(FEATURES)), np.asarray(b.column("quality")), lambda b=b: counted([b.column(c) for c in PACKS]))
                for b in batches
                if b.num_rows
            )

        return self.rows.select(*names).mapInArrow(run, schema)

    def _summed(self, of, names: tuple[str, ...] = ()) -> np.ndarray:
        """The sum over batches of what ``of`` makes of their counts, labels and, where asked for, n-grams; empty without rows."""

        def run(batches):
            total = 0
            for x, y, grams_ in batches:
                total = total + of(x, y, grams_)
            if not np.isscalar(total):
                yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float64).tobytes()], pa.binary())], ["sums"])

        found = self._each(run, "sums binary", ["quality", "x", *names]).toArrow().column("sums").to_pylist()
        return np.sum([np.frombuffer(x) for x in found], 0) if found else np.zeros(0)

    def _score(self, w: np.ndarray):
        mean, scale, k = self.mean, self.scale, self.k

        def score(x, grams_):
            z = np.clip((x - mean) / scale, -8, 8)
            return z, z @ w[:k] + counted_scores(w[k:], grams_)

        return score

    def loss_at(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        """(loss, gradient): as ``loss_of`` has them, over all pairs of a good and a bad row."""
        score, k, size = self._score(w), self.k, len(w)

        def scored(x, y, grams_):
            node, weights, _ = spread(score(x, grams_())[1])
            return np.concatenate([sum(np.bincount(node[y == v] + i, weights[i][y == v], minlength=NODES) for i in range(3)) for v in (1, 0)])

        loss, *costs = pair_costs(*np.split(self._summed(scored, PACKS), 2))
        costs = np.stack(costs[::-1])

        def pushed(x, y, grams_):
            kinds = grams_()
            z, own = score(x, kinds)
            node, _, slopes = spread(own)
            push = sum(slopes[i] * costs[y, node + i] for i in range(3))
            return np.r_[z.T @ push, counted_sums(push, kinds)]

        penalty = np.r_[np.full(k, PENALTY), np.full(size - k, GRAM_PENALTY)]
        return loss + float((penalty * w * w).sum() / 2), self._summed(pushed, PACKS) + penalty * w

    def scores(self, w: np.ndarray) -> DataFrame:
        score = self._score(w)

        def run(batches):
            for x, _, grams_ in batches:
                yield pa.RecordBatch.from_arrays([pa.array(score(x, grams_())[1])], ["score"])

        return self._each(run, "score double", ["quality", "x", *PACKS])


def nth_score(scores: DataFrame, n: int) -> float:
    """The score that n others stand below: ranges of scores are counted, and that which holds it is parted anew until its scores are all the same."""
    low, high = scores.agg(F.min("score"), F.max("score")).first()
    while low < high:
        width = (high - low) / RANGES or high - low
        place = F.least(F.floor((F.col("score") - low) / width), F.lit(RANGES - 1))
        found = scores.where(F.col("score").between(low, high)).groupBy(place.alias("place")).agg(F.count("*").alias("n"), F.min("score"), F.max("score")).orderBy("place").collect()
        for _, count, low, high in found:
            if n < count:
                break
            n -= count
    return low


def fit(rows: DataFrame) -> dict:
    """Weights, scaling and threshold from all rows of features, n-grams and labels of 0 and 1; without both labels every text scores one half."""
    held = Labelled(rows)
    model = {"mean": held.mean, "scale": held.scale, "weights": np.zeros(held.k), "grams": np.zeros(2 * CELLS), "threshold": 0.0}
    if not 0 < held.good < held.n:
        return model
    w = minimized(held.loss_at, held.k + 2 * CELLS, ENOUGH)
    model["weights"], model["grams"] = np.split(w, [held.k])
    told = cut(held.scores(w), "scores")
    k = held.n - held.good  # the quantile: as many below as are labelled bad
    model["threshold"] = (nth_score(told, k - 1) + nth_score(told, k)) / 2
    forget(told)
    return model


def score_of(model: dict, texts: list[bytes]) -> np.ndarray:
    parted = spaced_words(texts)
    said = [sum(SHARE * float(model["grams"][c].mean()) for c in cells if len(c)) for cells in grams(texts, parted)]
    raw = np.clip((matrix(texts, parted) - model["mean"]) / model["scale"], -8, 8) @ model["weights"] + np.array(said) - model["threshold"]
    return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


def learn(docs: DataFrame, labels: DataFrame) -> dict:
    """The model from all labelled rows outside the held-out third.

    Labels other than 0 and 1, and rows without a doc_id, teach nothing; of several labels
    of one doc_id the least counts, and of its texts the least. Features stand in the shared
    folder while they are learned from; the driver gets sums of them alone.
    """
    named = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    named = named.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))

    def run(batches):
        for b in batches:
            for s in slices(b.column("text"), TOGETHER):
                part = b.slice(s.start, s.stop - s.start)
                texts = byte_texts(part)
                parted = spaced_words(texts)
                kept = [packed(c) for c in grams(texts, parted)]
                columns = [pa.array(matrix(texts, parted).tolist(), pa.list_(pa.float64())), *(pa.array([k[i] for k in kept], pa.binary()) for i in range(4))]
                yield pa.RecordBatch.from_arrays([part.column("quality"), *columns], ["quality", "x", *PACKS])

    texts = in_small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(named, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("quality", "text")
    rows = cut(texts.mapInArrow(run, "quality int, x array<double>, " + ", ".join(f"{c} binary" for c in PACKS)), "features")
    model = fit(rows)
    forget(rows)
    return model


def scores(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and score of every row; null and blank texts are scored as texts without words."""

    def run(batches):
        for b in batches:
            for s in slices(b.column("text"), TOGETHER):
                part = b.slice(s.start, s.stop - s.start)
                yield pa.RecordBatch.from_arrays([*(part.column(f"_{c}") for c in keep), pa.array(score_of(model, byte_texts(part)))], [*keep, "score"])

    rows = in_small_batches(docs).select(F.col("text").cast("string").alias("text"), *((F.col(c).cast("bigint") if c == "doc_id" else F.col(c)).alias(f"_{c}") for c in keep))
    return rows.mapInArrow(run, ", ".join(f"`{c}` {rows.schema[f'_{c}'].dataType.simpleString()}" for c in keep) + ", score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Texts of equal words in equal places score alike; repeated rows stay; null and empty
    texts score as texts without words; very long texts are read whole; other columns are
    ignored; an empty table gives an empty result, and labels of one kind or none give every
    text one half.
    """
    model = learn(docs, labels)
    return scores(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
