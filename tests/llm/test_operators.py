"""The training-data operators against brute force, on fixtures with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.llm import decontamination, jaccard_join, language_id, license_scan, lm_scoring, mixing, quality_rules, token_counts, token_output, toxicity
from factloom.llm import queries as q
from factloom.llm.bpe import encoder as encoder_of

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORDS = "the of and in to that was near far red blue green stone river house tree hill road bridge lamp Über naïve don't 12 a1".split()


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    base = [rng.choice(WORDS) for _ in range(120)]
    for i in range(12):  # near copies
        near = list(base)
        near[i * 7] = "changed"
        texts.append(" ".join(near))
    texts += [" ".join(base)] * 3
    texts += ["", None, " ", "\n\n", "one", "  two  spaces \t tab\nline\x0b\x0cx ", "<|endoftext|> a", "word " * 3000, "x" * 5000, "é漢\U0001f600 mixed é"]
    out = [(i, t) for i, t in enumerate(texts)]
    return out + [(5, texts[5]), (7, "another text of the same id"), (None, "a row without id"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Columns of other names and of names that the operators use inside."""
    data = [(i, t, "en", f"s{(i or 0) % 3}", "x", 1, "y") for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, key string, score int, row string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_lm_scores_equal_a_plain_model(docs, rows, empty):
    train = lambda i: i is not None and i % 7 != 2
    tokens = [[*words_of((t or "").translate(LOW)), "\0end"] for _, t in rows]
    for order in (1, 2, 3):
        counts = [Counter() for _ in range(order)]
        for (i, _), w in zip(rows, tokens):
            if train(i):
                for k in range(order):
                    counts[k].update(tuple(w[j - k : j + 1]) for j in range(k, len(w)))
        n, v = sum(counts[0].values()), len(counts[0])
        once, twice = (sum(c == x for c in counts[0].values()) for x in (1, 2))
        d, mu = once / (once + 2 * max(twice, 1)) if once else 1 / (v + 1), 8.0

        def p(h, w):
            if not h:
                return (counts[0][(w,)] - d) / n if counts[0][(w,)] else d * v / n
            c = counts[len(h) - 1][h]
            return (counts[len(h)][(*h, w)] + mu * p(h[1:], w)) / (c + mu) if c else p(h[1:], w)

        assert abs(sum(p((), w) for (w,) in counts[0]) + d * v / n - 1) < 1e-9
        want = sorted((str(i), len(w), sum(counts[0][(x,)] > 0 for x in w), round(sum(math.log10((counts[0][(x,)] + 1) / (n + v + 1)) for x in w), 6), round(sum(math.log10(p(tuple(w[max(0, j - order + 1) : j]), w[j])) for j in range(len(w))), 6)) for (i, _), w in zip(rows, tokens))
        found = lm_scoring.lm_scores(docs.withColumn("train", F.col("doc_id") % 7 != 2), order=order, block_bytes=2000, slice_bytes=500).collect()
        assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in found) == want
        assert {r.train_tokens for r in found} == {n}
    assert lm_scoring.lm_scores(empty.withColumn("train", F.lit(True))).count() == 0
    assert {r.score for r in lm_scoring.lm_scores(docs.withColumn("train", F.lit(False))).collect()} == {0.0}


def test_license_scan_of_lines_files_and_ancestors(spark):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    data = [
        (1, "a/b/LICENSE", "x " * 40 + "\n" + gpl), (2, "a/b/c/d/x.py", "no words of that kind"), (3, "a/b/c/y.py", "Released under the MIT License.\n" + "word " * 30), (4, "a/z.py", "nothing"), (5, None, "Released under the MIT License."),
        (6, "a/b/c/d/e", None), (7, "q.txt", ""), (8, "a/bb/w", "licensed"), (9, "a/b/c/LICENSE", "All rights reserved."), (9, "a/b/c/LICENSE", "All rights reserved."), (10, "COPYING", "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0."),
    ]
    df = spark.createDataFrame(data, "doc_id long, path string, text string")
    got = {r.doc_id: (r.declared, r.inherited_from, r.license) for r in license_scan.license_scan(df).collect()}
    own = "LicenseRef-proprietary"
    assert got == {
        1: ("GPL-3.0", None, "GPL-3.0"), 2: (None, "a/b/c", own), 3: ("MIT", None, "MIT"), 4: (None, "", "Apache-2.0"), 5: ("MIT", None, "MIT"), 6: (None, "a/b/c", own), 7: (None, "", "Apache-2.0"), 8: (None, "", "Apache-2.0"),
        9: (own, None, own), 10: ("Apache-2.0", None, "Apache-2.0"),
    }
    assert license_scan.license_scan(df.limit(0)).count() == 0


def test_license_scan_agrees_with_sql(spark, sf):
    from compare import same

    same(q.op2_license_scan(spark, sf), sf, q.ORACLES["op2_license_scan"])


def test_language_id_on_held_out_documents(spark, sf, docs, empty):
    found = q.op3_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 20 and np.mean([r.lang == r.lang_pred for r in found]) > 0.97
    assert all(0 <= r.score <= 1 for r in found)
    model = language_id.fit(spark.createDataFrame([(1, "the red house", "en"), (2, "das rote Haus", "de"), (3, None, "fr"), (4, "x", None)], "doc_id long, text string, lang string"))
    got = [(r.doc_id, r.lang_pred) for r in language_id.identify(docs, model).collect()]
    assert len(got) == docs.count() and {p for i, p in got if i in (75, 76, 77, 78)} == {"und"}
    asked = spark.createDataFrame([(1, "the thex"), (2, "rotes Hausen"), (3, "12 34"), (4, None)], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language_id.identify(asked, model).collect()} == {1: "en", 2: "de", 3: "und", 4: "und"}
    assert {r.lang_pred for r in language_id.identify(asked, language_id.fit(empty)).collect()} == {"und"}
    assert language_id.identify(empty, model).count() == 0


def plain_backoff(texts, sample, max_n=4, smoothing=0.5):
    """Scores of texts by dicts of counts: a known word's log frequencies, else the mean over its places of the longest known n-gram's."""
    letters = lambda t: re.sub(r"[^\W\d_]+|.", lambda m: m[0] if m[0][0].isalpha() else " ", (t or "").lower(), flags=re.S).split()
    langs = sorted({lang for _, lang in sample})
    words, grams = Counter(), Counter()
    for t, lang in sample:
        for w in letters(t):
            words[w, lang] += 1
            for n in range(1, max_n + 1):
                for i in range(len(w) + 3 - n):
                    grams[f"^{w}$"[i : i + n], lang] += 1
    known, seen = {w for w, _ in words}, {g for g, _ in grams}

    def logs(counts, of, x):
        total = {k: sum(c for (y, lang), c in counts.items() if lang == k and of(y)) for k in langs}
        size = len({y for y, _ in counts if of(y)})
        return [math.log((counts[x, k] + smoothing) / (total[k] + smoothing * (size + 1))) for k in langs]

    memo, floor = {}, logs(grams, lambda y: True, None)

    def word(w):
        if w in memo:
            return memo[w]
        if w in known:
            memo[w] = logs(words, lambda y: True, w)
            return memo[w]
        m, rows = f"^{w}$", []
        for i in range(len(m) - 1):
            g = next((m[i : i + n] for n in range(min(max_n, len(m) - i), 0, -1) if m[i : i + n] in seen), None)
            if i == 0 and (g is None or len(g) == 1):
                continue  # the start mark counts only with what follows it
            rows.append(logs(grams, lambda y, n=len(g or ""): len(y) == n, g) if g else floor)
        memo[w] = [sum(x) / max(len(rows), 1) for x in zip(*rows)] if rows else [0.0] * len(langs)
        return memo[w]

    out = []
    for t in texts:
        total = [sum(x) for x in zip(*map(word, letters(t)))] or [0.0] * len(langs)
        best = max(range(len(langs)), key=lambda k: (total[k], -k))
        some = any(c.isalpha() for c in t or "")
        out.append((langs[best] if some else "und", 1 / sum(math.exp(x - total[best]) for x in total) if some else 0.0))
    return out


def test_language_scores_equal_plain_backoff(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").select("text", "lang").collect()
    sample = [(r.text, r.lang) for r in docs[:80] if r.text and r.lang and len(r.text) < 1500]
    asked = [(r.text or "")[:300] for r in docs[80:]] + ["", None, "12 ?", "Ünder straße", "x", "word " * 30_000]
    model = language_id.fit(spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(sample)], "doc_id long, text string, lang string"))
    got = language_id.identify(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    for r, (lang, score) in zip(got, plain_backoff(asked, sample)):
        assert abs(r.score - score) < 1e-4 and (r.lang_pred == lang or abs(score - 0.5) < 1e-3), (asked[r.doc_id], r, lang, score)
    # Equal counts in two languages are a tie, which the first in order wins.
    tie = language_id.fit(spark.createDataFrame([(1, "same words", "b"), (2, "same words", "a")], "doc_id long, text string, lang string"))
    row = language_id.identify(spark.createDataFrame([(1, "same unseen"), (1, "same unseen")], "doc_id long, text string"), tie).collect()
    assert [(r.lang_pred, r.score) for r in row] == [("a", 0.5)] * 2


def test_quality_counts_equal_brute_force(spark, rows, docs, empty):
    def base(t):
        t = t or ""
        w = words_of(t)
        seen, lines = set(), 0
        for line in t.split("\n"):
            if words_of(line):
                lines += line in seen
                seen.add(line)
        win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        count, hit = Counter(win), set()
        for i, x in enumerate(win):
            if count[x] > 1:
                hit.update(range(i, i + 5))
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), lines, len(hit)

    extra = [(900 + i, t) for i, t in enumerate(["a b\na b\n a b\n\n\n", "# * $ % & | < > #", "p q r s t p q r s t u", "p q r s t u p q r s t u v " * 9])]
    more = docs.select("doc_id", "text", "source").union(spark.createDataFrame(extra, "doc_id long, text string").withColumn("source", F.lit(None).cast("string")))
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.quality_rules(more).collect())
    want = sorted((str(i), *b, b[0] < 10 or 100 * b[4] > 20 * b[0]) for i, t in rows + extra for b in [base(t)])
    assert got == want
    assert quality_rules.quality_rules(empty).count() == 0


def test_lines_shared_in_a_host_are_removed_and_depleted_documents_go(spark):
    body = lambda i: " ".join("abcdefghijkl"[i % 12] + "xyzuvwopqrst"[j] for j in range(12))
    common = "this line stands in   every document of the HOST 7 and it is rather long indeed"
    data = [(i, "h", f"{body(i)}\n{common.replace('7', str(i % 10))}") for i in range(6)] + [(10, "h", f"tiny own line\n{common}"), (11, "other", common)]
    got = {r.doc_id: (r.removed_words, r.kept) for r in quality_rules.quality_rules(spark.createDataFrame(data, "doc_id long, source string, text string"), max_docs=5, min_left=0.4).collect()}
    n = len(common.split())
    assert got == {**{i: (n, True) for i in range(6)}, 10: (n, False), 11: (0, True)}


def test_mixing_rates_meet_targets_and_equal_a_dense_solution(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.4, 0.4, 0.4], 60)
    t = rng.integers(5, 400, 60)
    df = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(t, p)], "n_tokens long, p array<double>")
    for share in ([0.2, 0.3, 0.5], [0.02, 0.08, 0.9]):
        goal = [float(x * t.sum()) for x in share]
        steps = mixing.fit_rates(df, goal, most_rounds=200)
        r = np.array([x[0] for x in df.select(mixing.rate_of(F.col("p"), steps)).collect()])
        assert (r >= 0).all() and np.allclose((t * r) @ p, goal, atol=2e-3 * max(goal))
        x, off = np.ones(60), t @ p - goal
        for _ in steps:
            taken = x > 0
            m = (p * (t * taken)[:, None]).T @ p
            y = p @ np.linalg.solve(m + 1e-9 * np.trace(m) * np.eye(3), off)
            x = min((np.maximum(0, x - length * y) for length in (1.0, 0.5, 0.25, 0.1, 0.03, 0.01)), key=lambda z: float(np.sum(((t * z) @ p - goal) ** 2)))
            off = (t * x) @ p - goal
        assert np.allclose(x, r, atol=1e-6)


def test_mixing_thins_what_is_over_its_share_and_repeats_nothing(spark):
    sf, weights = "/root/testdata/sf0.01", {"clean": 0.96, "low": 0.03, "toxic": 0.01}
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), q.domain_labels(spark.read.parquet(f"{sf}/labels.parquet"))
    model = mixing.fit_domains(docs, labels, list(weights))
    text = F.col("text")
    rows = docs.select("doc_id", F.size(mixing.word_array(text)).alias("n"), model.posteriors(text, mixing.word_array(text)).alias("p"), (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)).alias("chance")).collect()
    n, p = np.array([r.n for r in rows]), np.array([r.p for r in rows])
    whole = p[:, 0] >= p.max(axis=1)
    have = n @ p
    over = [j for j in (1, 2) if have[j] > have[0] * weights[list(weights)[j]] / 0.96]
    assert 1 in over and not whole.all()  # else nothing is tried
    # Rates nearest to one without an excess, by many small dense steps.
    g = np.array([n * (p[:, j] - p[:, 0] * weights[list(weights)[j]] / 0.96) for j in over])
    b = np.linalg.inv((g[:, ~whole] / np.maximum(n[~whole], 1)) @ g[:, ~whole].T)
    r, v = np.ones(len(n)), np.zeros(len(over))
    for _ in range(4000):
        v = np.maximum(0, v + 0.5 * (b @ (g @ r)))
        r = np.where(whole, 1.0, np.clip(1 - (g / np.maximum(n, 1)).T @ v, 0, 1))
    assert (np.abs(g @ r) < 1e-3 * (n * r).sum()).all()  # the shares can be met
    got = Counter(x.doc_id for x in mixing.mixed_documents(docs, labels, weights, whole="clean").collect())
    assert max(got.values()) == 1 and all(got[x.doc_id] for x, w in zip(rows, whole) if w) and len(got) < len(rows)
    wrong = [x for x, rate in zip(rows, r) if (x.chance < rate) != (x.doc_id in got) and abs(x.chance - rate) > 0.02]
    assert not wrong


def test_mixing_without_labels_rows_or_words(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, domain string")
    rows = mixing.mixing_rates(docs, none, {"a": 0.5, "b": 0.5}, total=100.0).collect()
    assert len(rows) == docs.count() and all(abs(sum(r.p) - 1) < 1e-9 and r.rate >= 0 for r in rows)
    assert mixing.mixing_rates(empty, none, {"a": 1.0}).count() == 0
    assert mixing.mixed_documents(docs, none, {"a": 0.5, "b": 0.5}, whole="a").count() == docs.count()


def test_shards_round_trip(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    tok, path = Tokenizer.from_file(q.tokenizer_path()), q.tokenizer_path()
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    for most in (1 << 22, 50):
        got = token_output.token_output(docs, path, max_ids=most).collect()
        assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == want
    assert token_output.token_output(empty, path).count() == 0


def test_elias_fano_select_and_size():
    rng = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 0), (1, 10**12), (5000, 3), (5000, 10**9)):
        v = np.sort(rng.integers(0, top + 1, n))
        e = token_output.EliasFano.of(v)
        back, _ = token_output.EliasFano.read(e.to_bytes(), 0)
        assert (back.select(np.arange(n)) == v).all()
        if n > 1000:
            assert 8 * len(e.to_bytes()) <= n * (3 + max(0, math.log2(max(top / n, 1)))) + 1024


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def test_benchmark_hits_equal_brute_force(spark, docs, rows, empty):
    base = alnum(next(t for i, t in rows if i == 72))
    items = [(1, " ".join(base[3:17])), (2, "near far"), (3, "one"), (4, None), (5, " ,; "), (20, "word " * 12), (100, "not in any of the texts at all, by no means"), (2, "near far"), (None, "stone")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for item, t in items:
        w = alnum(t)
        if item is not None and w:
            for i in range(max(len(w) - 10, 0) + 1):
                windows[tuple(w[i : i + 10])].add(item)
    want = []
    for i, t in rows:
        w, hit, found = alnum(t), set(), set()
        for win, names in windows.items():
            for a in range(len(w) - len(win) + 1):
                if tuple(w[a : a + len(win)]) == win:
                    hit.update(range(a, a + len(win)))
                    found |= names
        want.append((str(i), len(w), len(hit), sorted(found)))
    for block, shard in ((4 << 20, 8 << 20), (30, 700)):
        got = decontamination.benchmark_hits(docs, bench, block_bytes=block, shard_bytes=shard).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"])) for r in got) == sorted(want)
        assert all(sum(s.end - s.first for s in r.spans) == r.n_hit for r in got)
        assert decontamination.drop_contaminated(docs, bench, block_bytes=block, shard_bytes=shard).count() == sum(not x[2] for x in want)
    assert decontamination.benchmark_hits(empty, bench).count() == 0
    assert all(r.n_hit == 0 for r in decontamination.benchmark_hits(docs, bench.limit(0)).collect())


def classes(rows, n=4, percent=85):
    sets, parent = [], {}
    for i, t in rows:
        w = words_of((t or "").translate(LOW))
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[root(a)] = min(least.get(root(a), i), i)
    return sorted((str(i), len(s), str(least.get(root(a)) if i is not None else None)) for a, ((i, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("options", [{}, {"most_sets": 4}, {"most_shingles": 300}])
def test_jaccard_classes_equal_brute_force(docs, rows, options):
    got = jaccard_join.jaccard_classes(docs, **options).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == classes(rows)


def test_one_document_of_each_class_stays(docs, rows, empty):
    kept = jaccard_join.keep_one(docs).collect()
    want = {c for i, _, c in classes(rows) if i != "None"}
    assert sorted(str(r.doc_id) for r in kept if r.doc_id is not None) == sorted(want) and sum(r.doc_id is None for r in kept) == 2
    assert jaccard_join.jaccard_classes(empty).count() == 0
    clashing = docs.withColumns({c: F.lit(1) for c in ("id", "nth", "_key", "label", "region", "n_shingles")})
    assert sorted(str(r.doc_id) for r in jaccard_join.keep_one(clashing).collect()) == sorted(str(r.doc_id) for r in kept)
    assert jaccard_join.keep_one(clashing).columns == clashing.columns


def test_linked_classes_of_random_sets_equal_all_pairs():
    rng = np.random.default_rng(4)
    for _ in range(30):
        base = rng.integers(0, 10**9, 40)
        sets = []
        for _ in range(25):
            s = base.copy()
            s[rng.integers(0, 40, rng.integers(0, 9))] = rng.integers(0, 10**9, 1)
            sets.append(np.unique(s))
        got = jaccard_join.linked_classes(sets, 85)
        parent = list(range(25))
        for _ in range(25):
            for a in range(25):
                for b in range(25):
                    i = len(np.intersect1d(sets[a], sets[b]))
                    if 100 * i >= 85 * (len(sets[a]) + len(sets[b]) - i):
                        parent[a] = parent[b] = min(parent[a], parent[b])
        assert len(set(zip(got.tolist(), parent))) == len(set(got.tolist())) == len(set(parent))


def test_links_between_members_of_different_balls_are_found():
    fresh = iter(range(10**6))
    own = lambda n: [next(fresh) for _ in range(n)]
    core, a, b = own(80), own(10), own(10)
    p1, p2 = core + a, core + b
    # Only x and y link the two clusters, and neither is a pivot: J(x, y) = 80/94, J(p1, y) = J(p2, x) = 80/97, J(p1, p2) = 80/100.
    sets = [p1, p2, core + a[:2] + own(5), core + b[:2] + own(5)] + [p1 + own(1) for _ in range(6)] + [p2 + own(1) for _ in range(6)]
    sets = [np.unique(s) for s in sets]
    assert len(set(jaccard_join.linked_classes(sets, 85).tolist())) == 1
    assert len(set(jaccard_join.linked_classes([s for i, s in enumerate(sets) if i != 3], 85).tolist())) == 2
    rng = np.random.default_rng(6)
    for _ in range(100):  # clusters whose middles lie apart by about the reach
        core, sets = own(60), []
        for _ in range(5):
            middle = core + own(int(rng.integers(3, 8)))
            sets += [np.unique([w for w in middle if rng.random() > 0.04] + own(int(rng.integers(0, 4)))) for _ in range(8)]
        got, want = jaccard_join.linked_classes(sets, 85), np.arange(len(sets))
        for a in range(len(sets)):
            for b in range(a):
                i = len(np.intersect1d(sets[a], sets[b]))
                if 100 * i >= 85 * (len(sets[a]) + len(sets[b]) - i):
                    want[want == want[a]] = want[b]
        assert len(set(zip(got.tolist(), want.tolist()))) == len(set(got.tolist())) == len(set(want.tolist()))


def copies(rng, base, n, edits):
    """Copies of some words, each with a number of words put in, taken out or changed."""
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(*edits)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], [w[k], f"in{rng.randrange(40)}"], [f"new{rng.randrange(40)}"], [f"own{rng.random()}"]])
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("most_sets", [8, 40])
def test_large_regions_equal_brute_force(spark, most_sets):
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    texts = [" ".join(base), *copies(rng, base, 70, (0, 7))]
    # Copies of a copy out of the base's reach, and two clusters that only copies of their own join.
    second = copies(rng, base, 1, (9, 9))[0].split()
    texts += [" ".join(second), *copies(rng, second, 25, (0, 4))]
    chain = [*base[:20], "a0", *base[21:40], "b0", *base[41:93]]
    for k, (a, b) in enumerate([("a0", "b0"), ("a1", "b0"), ("a1", "b1"), ("a2", "b1")]):
        w = [*chain[:20], a, *chain[21:40], b, *chain[41:]]
        texts.append(" ".join(w))
        if k in (0, 3):
            texts += [" ".join([*w[: 50 + 2 * j], f"x{k}{j}", *w[51 + 2 * j :]]) for j in range(10)]
    # Little but one passage: far from each other, with cells in common.
    texts += [" ".join([*base[:12], *(f"o{rng.random()}" for _ in range(rng.randint(1, 6)))]) for _ in range(30)]
    rows = list(enumerate(texts))
    want = classes(rows)
    assert 1 < len({c for *_, c in want}) < len(rows)
    got = jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), most_sets=most_sets).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want


def test_a_chain_of_balls_is_one_class(spark):
    base = [f"w{i}" for i in range(93)]
    texts = []
    for k, (a, b) in enumerate([("a0", "b0"), ("a1", "b0"), ("a1", "b1"), ("a2", "b1")]):
        texts.append([*base[:20], a, *base[21:40], b, *base[41:]])
    for k in (0, 3):
        texts += [[*texts[k][: 50 + 2 * j], f"x{k}{j}", *texts[k][51 + 2 * j :]] for j in range(10)]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    for most_sets in (4, 1024):
        got = jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), most_sets=most_sets).collect()
        assert {r.component_id for r in got} == {0} and classes(rows)[0][2] == "0"


def test_toxicity_on_held_out_documents(spark, docs, empty):
    sf = "/root/testdata/sf0.01"
    found = q.op9_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.toxic == r.predicted for r in found]) > 0.9
    model = toxicity.fit(empty.select("text", F.lit(1).alias("toxic")))
    scores = toxicity.score_toxicity(docs, model).collect()
    assert len(scores) == docs.count() and {r.score for r in scores} == {0.5}
    assert toxicity.score_toxicity(empty, model).count() == 0


def test_counterfactual_penalty_evens_out_identity_terms(spark):
    rng = random.Random(7)
    neutral = "river stone house tree hill road lamp bridge".split()
    data = []
    for i in range(240):
        w = [rng.choice(neutral) for _ in range(8)]
        bad = i % 3 == 0
        w += ["muslim"] if bad and rng.random() < 0.7 else ["christian"] if not bad and rng.random() < 0.7 else []
        w += ["vilelout"] if bad and rng.random() < 0.6 else []
        data.append((i, " ".join(w) + f" t{i}.", int(bad)))
    labelled = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    ask = pa.array(["a muslim by the river", "a christian by the river"])
    gap = [float(np.abs(np.diff(toxicity.fit(labelled, penalty=p).scores(ask)))[0]) for p in (0.0, 20.0)]
    assert gap[0] > 0.3 and gap[1] < 0.3 * gap[0]


def test_prefix_counts_answer_cuts_exactly(docs, rows, empty):
    from tokenizers import Tokenizer

    path = q.tokenizer_path()
    tok = Tokenizer.from_file(path)
    n_tokens = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    got = token_counts.prefix_token_counts(docs, path).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.prefix_tokens[-1]) for r in got) == sorted((str(i), len((t or "").encode()), n_tokens(t or "")) for i, t in rows)
    by = {(r.doc_id, r.n_bytes): r for r in got}
    for i, t in rows:
        if len(t or "") < 1000:
            assert by[i, len((t or "").encode())].prefix_tokens == [n_tokens((t or "")[:p]) for p in range(len(t or "") + 1)]
    assert token_counts.prefix_token_counts(empty, path).count() == 0


PARTS = [" ", "  ", "\n", "\t", "\xa0", "\x85", "\u3000", "\x1c", "a", "the", " hello", "world", "'ll", "'", "'s", "123", "4567", "!?", "é", "漢字", "\U0001f600", "<|endoftext|>", "<|endof", "|>", "x" * 30, "ab" * 25, "internationalization", "\r\n", " " * 30, "e\u0301", "\ufdd0"]


def test_prefix_counts_and_pieces_equal_the_library():
    from tokenizers import Tokenizer

    from factloom.llm.bpe import encoder

    tok, rng = Tokenizer.from_file(q.tokenizer_path()), random.Random(1)
    for _ in range(60):
        texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 9))) for _ in range(5)]
        want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
        ids, per, _, at = encoder(q.tokenizer_path())(pa.array(texts))
        ends = np.concatenate([[0], np.cumsum(per)])[at]
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == want
        counts, at = token_counts.counter(q.tokenizer_path())(pa.array(texts))
        for k, t in enumerate(texts):
            assert counts[at[k] : at[k + 1]].tolist() == [len(tok.encode(t[:p], add_special_tokens=False).ids) for p in range(1, len(t) + 1)]


def test_prefix_counts_where_texts_hold_every_mark():
    from tokenizers import Tokenizer

    tok, marks = Tokenizer.from_file(q.tokenizer_path()), token_counts.MARKS
    spread = [f"a {m} b{m}  c" for m in marks]
    for texts in (["".join(marks)], ["x y\u3000 z " + " ".join(marks) + "  end", "", "plain text"], spread, [*spread, " ".join(marks), "one"]):
        counts, at = token_counts.PrefixCounter(encoder_of(q.tokenizer_path()))(pa.array(texts))
        for k, t in enumerate(texts):
            assert counts[at[k] : at[k + 1]].tolist() == [len(tok.encode(t[:p], add_special_tokens=False).ids) for p in range(1, len(t) + 1)]


def test_remembered_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT_CHARS", 300)
    run = token_counts.PrefixCounter(encoder_of(q.tokenizer_path()))
    for k in range(12):
        counts, _ = run(pa.array([f"word{k} " + "ab" * 40]))
        assert len(run.pool) <= 300 and len(counts) == len(f"word{k} ") + 80


def test_cuts_and_budgets_follow_from_the_counts(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(q.tokenizer_path())
    # Touching white space, a special token, and pieces of over a budget's tokens; one long text has a double space.
    texts = ["a  b" * 40, "word " * 500 + " end", "<|endoftext|> x y", "qzxj" * 200, "", None, "短い" * 30, "one", "  "]
    df = token_counts.prefix_token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), q.tokenizer_path())
    for budget in (0, 1, 7, 300):
        got = df.select("doc_id", token_counts.chars_within(F.col("prefix_tokens"), budget).alias("n"), token_counts.tokens_of_prefix(F.col("prefix_tokens"), F.lit(9)).alias("t")).collect()
        for i, n, t in got:
            text = texts[i] or ""
            sizes = [len(tok.encode(text[:p], add_special_tokens=False).ids) for p in range(len(text) + 1)]
            assert n == max(p for p, c in enumerate(sizes) if c <= budget) and t == sizes[min(9, len(text))]


def test_pipeline_stages_each_do_their_work(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    kept = corpus_pipeline.jaccard_join(spark, docs, sf)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = {int(c) for _, _, c in _fast_classes(rows)}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == sets
    clean = corpus_pipeline.decontamination(spark, docs, sf)
    hits = {r.doc_id for r in q.op7_decontamination(spark, sf).where("contaminated").collect()}
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - hits
    calm = corpus_pipeline.toxicity(spark, docs, sf)
    toxic = {r.doc_id for r in q.op9_toxicity(spark, sf).where("predicted = 1").collect()}
    assert {r.doc_id for r in calm.collect()} == {i for i, _ in rows} - toxic
    assert names == ["toxicity", "jaccard_join", "decontamination", "mixing", "token_output"]
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def _fast_classes(rows, n=4, percent=85):
    post, sets, parent = defaultdict(list), {}, {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, t in rows:
        w = words_of((t or "").translate(LOW))
        sets[i] = {hashlib.md5("\0".join(w[k : k + n]).encode()).digest() for k in range(max(1, len(w) - n + 1))} if w else set()
        parent[i] = i
        shared = Counter(j for s in sets[i] for j in post[s])
        for j, c in shared.items():
            if 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            post[s].append(i)
    return [(i, len(sets[i]), root(i)) for i in sets]
