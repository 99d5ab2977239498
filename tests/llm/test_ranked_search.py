"""Ranked search against plain whole-number scoring, on texts with nulls, copies, ties, missing ids and clashing columns."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from compare import same
from factloom.llm import queries as q
from factloom.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return TERM.findall((text or "").translate(LOW))


def ranked(docs, items, most=10):
    held = [(i, words(t)) for i, t in docs if words(t)]
    n_docs, n_terms = len(held), sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    out = []
    for item, text in items:
        found = []
        for i, w in held:
            tf, m = Counter(w), 10 + (90 * len(w) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in set(words(text)) if tf[t])
            if score > 0:
                found.append((-score, math.inf if i is None else i))
        out += [(item, k + 1, None if i == math.inf else i, -s) for k, (s, i) in enumerate(sorted(found)[:most])]
    return sorted(out, key=repr)


def tables(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, score int, terms string").repartition(3),
        spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, uid string"),
    )


def rows(found):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()), key=repr)


@pytest.mark.parametrize("seed,tree_terms", [(1, 1_000_000), (2, 400), (3, 60)])
def test_ranks_equal_plain_scoring(spark, seed, tree_terms):
    rng = random.Random(seed)
    known = ["The", "of", "a1", "Ünder", "K", "漢字", *[f"w{i}" for i in range(120)]]
    draw = lambda n: " ".join(known[min(int(rng.expovariate(0.06)), len(known) - 1)] + rng.choice(["", ",", "-", "."]) for _ in range(n))
    docs = [(i, draw(rng.randint(1, 80))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(130)] + [(2000 + i, "same same copy") for i in range(70)]  # groups of copies, over a leaf's size
    docs += [(3, "another of one id"), (None, docs[9][1]), (None, "w1"), (5000, None), (5001, ""), (5002, "?!"), (5003, "w3 " * 20000)]
    items = [(i, docs[i][1]) for i in (0, 7, 7, 50)] + [(90, "w1 W1 w2"), (91, None), (92, ""), (93, "unseen"), (None, "w5 copy"), (94, draw(200))]
    d, b = tables(spark, docs, items)
    want = ranked(docs, items)
    assert rows(ranked_search.top_documents(d, b, tree_terms=tree_terms)) == want
    assert rows(ranked_search.top_documents(d, b, tree_terms=tree_terms, block_bytes=300)) == want  # queries in several blocks
    assert rows(ranked_search.top_documents(d, b, most=1)) == ranked(docs, items, 1)


def test_empty_tables(spark):
    d, b = tables(spark, [(1, "a b")], [(1, "a")])
    none = [(1, None)]
    for docs, items in ((d.limit(0), b), (d, b.limit(0)), tables(spark, none, [(1, "a")]), tables(spark, [(1, "a")], none)):
        found = ranked_search.top_documents(docs, items)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0


def test_tree_bounds_hold_and_prune():
    """Every node's bound is at least the score of each document below; a search enters few leaves where one document stands out."""
    rng = np.random.default_rng(5)
    sets = [np.unique(np.minimum(rng.exponential(25, rng.integers(1, 60)).astype(np.int64), 199)) for _ in range(3000)]
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    vectors = ranked_search.Vectors(at, np.concatenate(sets), rng.integers(1, 5, at[-1]).astype(np.int64))
    tree = ranked_search.FPTree(np.arange(3000), rng.integers(10, 300, 3000), vectors, 10)
    weight = np.zeros(200, np.int64)
    weight[sets[17]] = rng.integers(1, 9000, len(sets[17]))
    n = len(tree.ids)
    score = tree.sums(tree.docs, 0, n, tree.m, weight)
    bound = tree.sums(tree.bounds, 0, len(tree.span), tree.least_m, weight)
    for (lo, hi), b, ids in zip(tree.span, bound, tree.least_id):
        assert b >= score[lo:hi].max() and ids == tree.ids[lo:hi].min()
    leaves = [s for s, (a, b) in zip(tree.span, tree.children) if a == b]
    assert sorted(x for lo, hi in leaves for x in range(lo, hi)) == list(range(n)) and max(hi - lo for lo, hi in leaves) <= 48
    best = tree.search(weight, [], 10)
    assert best == sorted(zip((-score).tolist(), tree.ids.tolist()))[:10]
    seen = []
    plain = tree.sums
    tree.sums = lambda vectors, lo, hi, m, w: (seen.append(hi - lo) if vectors is tree.docs else None, plain(vectors, lo, hi, m, w))[1]
    assert tree.search(weight, [], 1) == best[:1] and sum(seen) < n / 2


def test_query_agrees_with_sql(spark, sf):
    same(q.QUERIES["op13_ranked_search"](spark, sf), sf, q.ORACLES["op13_ranked_search"])
