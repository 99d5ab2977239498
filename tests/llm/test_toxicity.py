"""The toxicity classifier's swaps, gradient and scores against plain Python, and its penalty on the given tables."""

import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.llm import queries as q
from factloom.llm import toxicity

GROUPS = [["women", "men"], ["young", "younger", "old"], ["tall", "talls"]]


def features(text):
    """Names of a text's features: words, and beginnings of 4 to 6 letters of longer words."""
    out = set()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        out |= {("w", w)} | {(n, w[:n]) for n in (4, 5, 6) if len(w) > n}
    return out


def named(words):
    """What the operator calls each feature."""
    out = {}
    for w, row in zip(words, toxicity.word_features(pa.array(words))):
        out["w", w] = row[0]
        out |= {(n, w[:n]): row[k + 1] for k, n in enumerate((4, 5, 6)) if len(w) > n}
    return out


def swapped(text, groups):
    """The text once for each sentence, term of a group in it and other term of the group."""
    out, at = [], 0
    for part in re.split(r"([.!?\n]+)", text):
        words = set(re.findall(r"[^\W\d_]+", part.lower()))
        for group in groups:
            for t in group:
                for o in group:
                    if t in words and o != t:
                        changed = re.sub(rf"(?<![^\W\d_]){t}(?![^\W\d_])", o, part, flags=re.I)
                        out.append(text[:at] + changed + text[at + len(part) :])
        at += len(part)
    return out


def test_swaps_change_what_real_swaps_change():
    rng = random.Random(2)
    pool = "women Men young younger old tall talls womens youngest elder river olden x".split()
    texts = ["".join(rng.choice(pool) + rng.choice([" ", " ", ". ", "\n", "! ", "-"]) for _ in range(rng.randint(0, 25))) for _ in range(120)]
    names = named(sorted({w.lower() for w in pool}))
    vocabulary = np.unique(np.array(list(names.values()), np.uint64))[::2]  # half of them are unknown
    place = {f: int(np.searchsorted(vocabulary, v)) for f, v in names.items() if v in vocabulary}
    for t in texts:
        want = Counter()
        for s in swapped(t, GROUPS):
            lost, gained = features(t) - features(s), features(s) - features(t)
            want[tuple(sorted(place[f] for f in lost if f in place)), tuple(sorted(place[f] for f in gained if f in place))] += 1
        assert toxicity.swap_changes(pa.array([t, None, "no term here"]), vocabulary, GROUPS) == want
    assert toxicity.swap_changes(pa.array([None, ""], pa.string()), vocabulary, GROUPS) == Counter()
    assert toxicity.swap_changes(pa.array(texts), vocabulary, []) == Counter()


def test_swaps_in_a_very_long_text_take_its_size():
    rng = random.Random(3)
    text = " ".join(rng.choice(["women", "men", "young", "old", "word", "more.", "river", "house"]) for _ in range(60_000))
    began = time.time()
    assert sum(toxicity.swap_changes(pa.array([text]), np.zeros(0, np.uint64), GROUPS).values()) > 10_000 and time.time() - began < 10


def test_descent_ends_at_the_plain_optimum():
    """Where the descent ends, the gradient of loss, ridge and swap penalty (by finite differences) is nothing."""
    rng = np.random.default_rng(8)
    rows = [np.flatnonzero(rng.random(12) < 0.3) for _ in range(80)]
    indptr, index = np.concatenate([[0], np.cumsum([len(r) for r in rows])]), np.concatenate(rows)
    y, weight = rng.integers(0, 2, 80).astype(float), rng.uniform(0.5, 2, 80)
    swaps = [(np.array([1, 2]), np.array([3]), 4), (np.array([0]), np.array([], np.int64), 1), (np.array([5]), np.array([6, 7]), 2)]

    def loss(x):
        w, b = x[:12], x[12]
        z = np.array([w[r].sum() + b for r in rows])
        held = (weight * (np.logaddexp(0, z) - y * z)).sum() / weight.sum() + 0.05 * (w @ w) / weight.sum()
        return held + sum(c / 7 * (w[come].sum() - w[gone].sum()) ** 2 for gone, come, c in swaps)

    w, b = toxicity.descend(indptr, index, y, weight, 12, swaps, penalty=1.0, l2=0.1, steps=6000)
    x = np.append(w, b)
    slope = [(loss(x + 1e-5 * e) - loss(x - 1e-5 * e)) / 2e-5 for e in np.eye(13)]
    assert np.abs(slope).max() < 1e-6


def test_scores_equal_a_plain_sum(spark):
    words = ["alpha", "betaxy", "gammas", "de"]
    names = named(words)
    order = sorted(names, key=lambda f: names[f])
    weights = np.random.default_rng(1).normal(size=len(order))
    model = toxicity.ToxicityModel(np.array([names[f] for f in order], np.uint64), weights, -0.3)
    texts = ["Alpha betaxy", "gammas, gammas", "betax", None, "", "unknown de", "de " * 50_000, "Alpha betaxy"]
    rows = spark.createDataFrame([(i, t, 1.0, "s") for i, t in enumerate(texts)], "doc_id long, text string, score double, row string")
    by = dict(zip(order, weights))
    for r in toxicity.score_toxicity(rows, model).collect():
        total = -0.3 + sum(by.get(f, 0.0) for f in features(texts[r.doc_id] or ""))
        assert abs(r.score - 1 / (1 + np.exp(-total))) < 1e-12
    assert {r.doc_id for r in toxicity.drop_toxic(rows, model, 0.5).collect()} == {r.doc_id for r in toxicity.score_toxicity(rows, model).collect() if r.score < 0.5}


def test_one_text_with_two_labels_has_the_larger(spark):
    rows = [("the same text", 0), ("the same text", 1), ("another", 0), (None, 1), ("unlabelled", None)]
    one = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"), min_docs=1, min_z=0.0)
    two = toxicity.fit(spark.createDataFrame([r for r in rows if r != rows[0]], "text string, toxic int"), min_docs=1, min_z=0.0)
    assert np.allclose(one.weights, two.weights) and abs(one.bias - two.bias) < 1e-9


@pytest.fixture(scope="module")
def labelled(spark):
    sf = "/root/testdata/sf0.01"
    docs = q.table(spark, sf, "documents")
    return toxicity.labelled_texts(docs, q.table(spark, sf, "labels").where(q.remainder(4) != 2)).cache()


def test_groups_of_the_given_texts_are_swapped_and_held_even(labelled):
    """On the given tables the penalty acts: words used alike are swapped in labelled sentences, and score changes shrink."""
    labelled = labelled.groupBy("text").agg(F.max("toxic").alias("toxic"))  # as the fit sees them
    texts = pa.array([r.text for r in labelled.collect()])
    sizes = labelled.agg(F.sum("toxic"), F.count("*")).first()
    groups = toxicity.like_terms(labelled, toxicity.IDENTITY_GROUPS, (sizes[0], sizes[1] - sizes[0]))
    assert groups and all(2 <= len(g) <= 6 for g in groups) and len({t for g in groups for t in g}) == sum(map(len, groups))
    change = []
    for penalty in (0.0, 1.0, 20.0):
        model = toxicity.fit(labelled, penalty=penalty)
        swaps = toxicity.swap_changes(texts, model.vocabulary, groups)
        assert model.swaps == sum(swaps.values()) > 100
        change.append(sum(n * (model.weights[list(x)].sum() - model.weights[list(g)].sum()) ** 2 for (g, x), n in swaps.items()) / sum(swaps.values()))
    assert change[0] > change[1] > change[2]
