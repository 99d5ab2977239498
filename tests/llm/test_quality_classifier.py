"""The quality classifier's parts against plain Python, and its accuracy on held-out documents."""

import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.llm import quality_classifier as qc
from factloom.llm import queries as q

TEXTS = ["The the CAT, runs 12 times!", "", None, "  \n ", "one", "Über ÜBER über", "a b a b a b", "$$$ ### x1y", "The the CAT, runs 12 times!"]


def shape(word):
    """One sign for digits, capitals in a row, a capitalised word and other letters."""
    kind = lambda c: "N" if unicodedata.category(c)[0] == "N" else "U" if unicodedata.category(c) == "Lu" else "l" if unicodedata.category(c)[0] in "LM" else c
    kinds = "".join(map(kind, word))
    out = re.sub(r"N+", "0", kinds)
    out = re.sub(r"U{2,}", "\x01", out)
    return re.sub(r"l+", "\x03", re.sub(r"Ul*", "\x02", out))


def sets_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    low, forms = [w.lower() for w in words], ["^", *map(shape, words), "$"]
    runs = lambda x, n: [tuple(x[i : i + n]) for i in range(len(x) - n + 1)]
    return {("w", r) for n in (1, 2) for r in runs(low, n)} | {("s", r) for n in (1, 2, 3) for r in runs(forms, n)}


def test_indicators_are_the_sets_of_words_and_shapes():
    row, place = qc.indicators(pa.array(TEXTS), 40)
    assert np.all(np.diff(row * (1 << 40) + place) > 0)
    got = [set(place[row == k].tolist()) for k in range(len(TEXTS))]
    want = [sets_of(t) for t in TEXTS]
    assert list(map(len, got)) == list(map(len, want))  # no two of these meet in so large a table
    for i in range(len(TEXTS)):
        for j in range(len(TEXTS)):
            assert len(got[i] & got[j]) == len(want[i] & want[j])
    assert qc.indicators(pa.array([], pa.string()), 20)[0].size == 0


def some_rows(seed=3, n=60, size=40):
    rng = np.random.default_rng(seed)
    rows = [np.flatnonzero(rng.random(size) < 0.2) for _ in range(n)]
    rows[5] = np.zeros(0, np.int64)
    return np.concatenate([[0], np.cumsum([len(r) for r in rows])]), np.concatenate(rows), rows, rng.integers(0, 2, n), rng.uniform(0.5, 2, n)


def test_log_ratios_and_dual_descent_reach_the_optimum():
    indptr, index, rows, y, weight = some_rows()
    owner = np.repeat(np.arange(len(y)), np.diff(indptr))
    ratio = qc.log_ratios(index, owner, y, weight, 40, 1.0)
    share = {k: np.array([1.0 + sum(w for r, w, c in zip(rows, weight, y) if c == k and j in r) for j in range(40)]) for k in (0, 1)}
    assert np.allclose(ratio, np.log(share[1] / share[1].sum()) - np.log(share[0] / share[0].sum()))
    bound = weight * 0.7
    w, b = qc.dual_descent(indptr, index, ratio, y, bound, 3000, 1e-9)
    x = np.zeros((len(y), 41))
    for i, r in enumerate(rows):
        v = ratio[r]
        x[i, r], x[i, 40] = v / (np.sqrt(v @ v) or 1), 1.0
    sign = np.where(y == 1, 1.0, -1.0)
    primal = lambda v: 0.5 * v @ v + (bound * np.maximum(0, 1 - sign * (x @ v))).sum()
    at = np.append(w, b)
    # The dual value of the solution bounds every primal value from below; they meet at the optimum.
    rng = np.random.default_rng(0)
    assert all(primal(at) <= primal(at + 10.0 ** -rng.integers(1, 6) * rng.normal(size=41)) + 1e-7 for _ in range(300))


def test_logistic_curve_is_where_its_slope_is_nothing():
    rng = np.random.default_rng(6)
    margin, y, weight = rng.normal(size=200), rng.integers(0, 2, 200), rng.uniform(0.5, 3, 200)
    a, c = qc.logistic_curve(margin, y, weight)
    n1, n0 = (weight * (y == 1)).sum(), (weight * (y == 0)).sum()
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    off = weight * (1 / (1 + np.exp(-(a * margin + c))) - goal)
    assert abs(off.sum()) < 1e-6 and abs((off * margin).sum()) < 1e-6


def test_scores_equal_a_plain_sum(spark):
    rng = np.random.default_rng(2)
    bits = 12
    model = qc.QualityModel(bits, rng.normal(size=1 << bits).astype(np.float32), rng.normal(size=1 << bits).astype(np.float32), 0.2, 1.5, -0.3)
    texts = [*TEXTS, "long " * 60_000, " ".join(f"w{i}" for i in range(30_000))]
    df = spark.createDataFrame([(i, t, 1.0, "s") for i, t in enumerate(texts)] + [(0, texts[0], 1.0, "s")], "doc_id long, text string, score double, places string")
    got = qc.score_quality(df, model).collect()
    for r in got:
        _, place = qc.indicators(pa.array([texts[r.doc_id]], pa.string()), bits)
        x, w = model.ratio[place].astype(float), model.weights[place].astype(float)
        margin = w.sum() / np.sqrt((x**2).sum()) + 0.2
        assert abs(r.score - 1 / (1 + np.exp(-(1.5 * margin - 0.3)))) < 1e-9
    by = [r.score for r in sorted(got, key=lambda r: r.doc_id)]
    assert by[0] == by[1] == by[-3] and len(got) == len(texts) + 1  # repeated rows and equal texts
    assert qc.score_quality(df.limit(0), model).count() == 0


@pytest.mark.parametrize("rows,score", [([], 0.5), ([("a", 1), ("b", 1)], 0.75), ([("a", None), (None, 1)], 0.5)])
def test_without_two_classes_the_score_is_their_share(spark, rows, score):
    model = qc.fit(spark.createDataFrame(rows, "text string, quality int"))
    got = qc.score_quality(spark.createDataFrame([(1, "x"), (2, None)], "doc_id long, text string"), model).collect()
    assert {round(r.score, 9) for r in got} == {score}


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    found = q.op12_quality_classifier(spark, sf)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = found.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    low = [r for r in rows if r.quality == 0]
    assert np.mean([r.quality == r.predicted for r in rows]) > 0.97 and np.mean([r.predicted == 0 for r in low]) > 0.85
    assert found.count() == spark.read.parquet(f"{sf}/documents.parquet").count() and found.where((F.col("score") < 0) | (F.col("score") > 1)).count() == 0
