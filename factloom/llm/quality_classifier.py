"""A quality classifier of naive Bayes support vectors.

A text is the set of its n-grams: words and pairs of words in lower case, and runs of one to three word shapes (how a word is written:
capitals, letters, digits, and its other signs as they are), the text's ends included. An n-gram's name is a place in a table of fixed
size (feature hashing), so the model is of one size however large the corpus and none is left out.

Each indicator is scaled by the log ratio of its shares in the two classes, and each text's vector to length one. On these vectors a
linear model with hinge loss is fitted by dual coordinate descent: one dual value for each text, moved at a time to its best place between
0 and its bound. The margin becomes a probability by a logistic curve fitted to the labels.

The fit uses at most about `sample_docs` labelled documents, half of each class and chosen by a hash, which bounds its work on the driver;
each weighs as much as it stands for. Every document is scored, over its whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrow import coded, hashed, mixed, pieces, row_of, split_words

#: How a word is written: what is replaced by one sign, in this order.
SHAPES = [(r"\p{N}+", "0"), (r"\p{Lu}{2,}", "\x01"), (r"\p{Lu}[\p{Ll}\p{M}]*", "\x02"), (r"[\p{L}\p{M}]+", "\x03")]
WORD_RUNS, SHAPE_RUNS = (1, 2), (1, 2, 3)


def shapes(words: pa.Array) -> pa.Array:
    for pattern, sign in SHAPES:
        words = pc.replace_substring_regex(words, pattern, sign)
    return words


def runs(names: np.ndarray, at: np.ndarray, n: int, kind: int, bits: int) -> np.ndarray:
    """Places of all runs of n names within a row, as `row << bits | place`."""
    count = np.maximum(np.diff(at) - n + 1, 0)
    first = np.concatenate([[0], np.cumsum(count)])
    start = np.repeat(at[:-1] - first[:-1], count) + np.arange(first[-1])
    name = np.full(len(start), 1000 * kind + n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            name = mixed(name * np.uint64(0x9E3779B97F4A7C15) + names[start + k])
    return row_of(first) << bits | (name >> np.uint64(64 - bits)).astype(np.int64)


def indicators(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, place) pairs of some texts, in ascending order. A null text is an empty one, which has the shape of its ends."""
    flat, at = split_words(texts)
    code, words = coded(flat)
    kinds, forms = coded(shapes(words))
    written = hashed(forms)[kinds][code] if len(words) else np.zeros(0, np.uint64)
    low = hashed(pc.utf8_lower(words))[code] if len(words) else written
    # The ends of a text stand before its first and after its last shape.
    ends = at + 2 * np.arange(len(at))
    shaped = np.zeros(ends[-1], np.uint64)
    shaped[np.arange(len(flat)) + 2 * row_of(at) + 1] = written
    shaped[ends[:-1]], shaped[ends[1:] - 1] = 1, 2
    pairs = [runs(low, at, n, 1, bits) for n in WORD_RUNS] + [runs(shaped, ends, n, 2, bits) for n in SHAPE_RUNS]
    pairs = np.unique(np.concatenate(pairs))
    return pairs >> bits, pairs & ((1 << bits) - 1)


def log_ratios(index: np.ndarray, rows: np.ndarray, y: np.ndarray, weight: np.ndarray, size: int, smoothing: float) -> np.ndarray:
    """For each place the log of its share among the indicators of class 1, less that of class 0."""
    share = []
    for k in (1, 0):
        total = np.bincount(index, weights=(weight * (y == k))[rows], minlength=size) + smoothing
        share.append(np.log(total / total.sum()))
    return share[0] - share[1]


def dual_descent(
    indptr: np.ndarray, index: np.ndarray, ratio: np.ndarray, y: np.ndarray, bound: np.ndarray, epochs: int, tolerance: float
) -> tuple[np.ndarray, float]:
    """Weights and bias of the least 1/2 |w|^2 + 1/2 b^2 + sum of bound * hinge, the dual values taken in a new fixed order each epoch.

    It ends when no dual value can move by a slope over `tolerance`, or after `epochs`."""
    sign = np.where(y == 1, 1.0, -1.0)
    w, b, dual = np.zeros(len(ratio)), 0.0, np.zeros(len(y))
    order = np.random.default_rng(12)
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(len(y)):
            at = index[indptr[i] : indptr[i + 1]]
            x = unit(ratio[at])
            slope = sign[i] * (w[at] @ x + b) - 1
            open_ = min(slope, 0.0) if dual[i] <= 0 else max(slope, 0.0) if dual[i] >= bound[i] else slope
            worst = max(worst, abs(open_))
            if open_:
                moved = min(max(dual[i] - slope / (x @ x + 1), 0.0), bound[i])
                step = (moved - dual[i]) * sign[i]
                w[at] += step * x
                b, dual[i] = b + step, moved
        if worst < tolerance:
            break
    return w, b


def unit(x: np.ndarray) -> np.ndarray:
    length = np.sqrt(x @ x)
    return x / length if length else x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def logistic_curve(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and offset of the probability of label 1 by margin (Newton's method; labels drawn in by one part in the class's size plus 2)."""
    n1, n0 = (weight * (y == 1)).sum(), (weight * (y == 0)).sum()
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, c = 1.0, float(np.log((n1 + 1) / (n0 + 1)))
    x = np.stack([margin, np.ones(len(margin))])

    def loss(a, c):
        z = a * margin + c
        return (weight * (np.logaddexp(0, z) - goal * z)).sum()

    for _ in range(steps):
        p = sigmoid(a * margin + c)
        slope = x @ (weight * (p - goal))
        curve = (x * (weight * p * (1 - p))) @ x.T + 1e-9 * np.eye(2) * max(1.0, weight.sum())
        da, dc = np.linalg.solve(curve, slope)
        size = 1.0
        while loss(a - size * da, c - size * dc) > loss(a, c) and size > 1e-6:
            size /= 2
        a, c = a - size * da, c - size * dc
        if abs(da) + abs(dc) < 1e-10:
            break
    return a, c


@dataclass
class QualityModel:
    """Tables over all places: the log ratio, and its product with the weight; and the logistic curve."""

    bits: int
    ratio: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margins(self, texts: pa.Array) -> np.ndarray:
        row, place = indicators(texts, self.bits)
        length = np.sqrt(np.bincount(row, weights=self.ratio[place] ** 2, minlength=len(texts)))
        total = np.bincount(row, weights=self.weights[place], minlength=len(texts))
        return total / np.where(length > 0, length, 1) + self.bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        return sigmoid(self.slope * self.margins(texts) + self.offset)


def fit(
    labelled: DataFrame, sample_docs: int = 12_000, bits: int = 20, smoothing: float = 1.0, cost: float = 1.0, epochs: int = 30, tolerance: float = 0.01
) -> QualityModel:
    """Learn from `labelled` (text, quality 0/1, and how many rows a row stands for in `weight` if there is one).

    Rows without text or label teach nothing. A text with two labels counts for both. Without rows, or with one class alone, the log
    ratios are 0 and the score is the share of label 1 (0.5 without rows)."""
    weight = F.col("weight") if "weight" in labelled.columns else F.lit(1.0)
    rows = labelled.where("text is not null and quality is not null")
    rows = rows.select("text", F.col("quality").cast("int").alias("quality"), weight.cast("double").alias("weight"))
    sizes = {r["quality"]: r["n"] for r in rows.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    share = F.lit(1.0)
    for k, n in sizes.items():
        share = F.when(F.col("quality") == k, min(1.0, sample_docs / 2 / n)).otherwise(share)
    chosen = rows.withColumn("hash", F.xxhash64("text")).where(F.pmod("hash", F.lit(1 << 30)) < share * (1 << 30)).withColumn("weight", F.col("weight") / share)

    def gather(batches):
        for batch in pieces(batches, "text"):
            row, place = indicators(batch.column("text"), bits)
            offsets = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(place.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("quality", "weight", "hash")), lists], ["quality", "weight", "hash", "places"])

    # The bounded sample, as places in the table. In the order of their texts' hashes, so that the fit is the same each time.
    got = chosen.mapInArrow(gather, "quality int, weight double, hash long, places array<int>").toArrow()
    got = got.sort_by([("hash", "ascending"), ("quality", "ascending")]).combine_chunks()
    lists = got["places"].combine_chunks()
    index, indptr = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int64)
    return fit_places(indptr, index, got["quality"].to_numpy(), got["weight"].to_numpy(), bits, smoothing, cost, epochs, tolerance)


def fit_places(
    indptr: np.ndarray, index: np.ndarray, y: np.ndarray, weight: np.ndarray, bits: int, smoothing: float = 1.0, cost: float = 1.0, epochs: int = 30, tolerance: float = 0.01
) -> QualityModel:
    """The model of texts given as places: log ratios, dual coordinate descent, logistic curve."""
    n1, n0 = (weight * (y == 1)).sum(), (weight * (y == 0)).sum()
    if not n1 or not n0:
        nothing = np.zeros(1 << bits, np.float32)
        return QualityModel(bits, nothing, nothing, 0.0, 0.0, float(np.log((n1 + 1) / (n0 + 1))))
    rows = np.repeat(np.arange(len(y)), np.diff(indptr))
    ratio = log_ratios(index, rows, y, weight, 1 << bits, smoothing)
    # Both classes count alike in the hinge loss.
    bound = cost * weight * np.where(y == 1, 0.5 / n1, 0.5 / n0) * len(y)
    w, bias = dual_descent(indptr, index, ratio, y, bound, epochs, tolerance)
    scaled = ratio * w
    length = np.sqrt(np.bincount(rows, weights=ratio[index] ** 2, minlength=len(y)))
    margin = np.bincount(rows, weights=scaled[index], minlength=len(y)) / np.where(length > 0, length, 1) + bias
    slope, offset = logistic_curve(margin, y, weight)
    return QualityModel(bits, ratio.astype(np.float32), scaled.astype(np.float32), bias, slope, offset)


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: `doc_id, score`, the probability of label 1.

    A null text scores as an empty one does, by the shape of its ends. A text of any length is one row of a batch and is read whole;
    repeated rows and ids are scored each by itself, an empty table gives no row, and other columns are ignored whatever their names.
    Equal texts have equal scores.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in pieces(batches, "text"):
            scores = sent.value.scores(pc.fill_null(batch.column("text"), ""))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(score, "doc_id long, score double")
