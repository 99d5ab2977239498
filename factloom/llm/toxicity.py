"""A toxicity classifier that does not lean on which group a text mentions.

Logistic regression on the presence of words and of their beginnings. Beside the loss on the labels it has a counterfactual penalty:
for every labelled sentence with an identity term, the squared change of the score when another term of the same group takes its
place. The penalty is on the weights of the features that the text gains and loses by it. Beside the stated groups, groups are found in the
labelled text itself: words that say nothing of the class and are used alike.

The fit uses at most about `sample_docs` labelled documents, half of each class and chosen by a hash, which bounds the model; rows weigh
as much as they stand for. Features are those that tell the classes apart beyond chance (`min_z`). Every document is scored, over its
whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language_id import letters_only
from .shared import stored
from .textarrow import coded, hashed, mixed, pieces, row_of, split_words

# Identity terms, by the groups within which they are swapped.
IDENTITY_GROUPS = [
    ["women", "men", "girls", "boys"],
    ["woman", "man", "girl", "boy"],
    ["female", "male", "transgender", "nonbinary"],
    ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist"],
    ["christians", "muslims", "jews", "hindus", "buddhists", "atheists"],
    ["gay", "lesbian", "bisexual", "straight", "queer", "heterosexual"],
    ["black", "white", "asian", "latino", "hispanic", "arab"],
    ["african", "european", "american", "mexican", "indian", "chinese"],
    ["immigrants", "refugees", "natives", "citizens"],
    ["young", "old", "elderly", "teenage"],
    ["disabled", "blind", "deaf", "paralyzed"],
]

STARTS = (4, 5, 6)
SWAPS = pa.list_(pa.struct([("gone", pa.list_(pa.int32())), ("come", pa.list_(pa.int32())), ("n", pa.int32())]))


def word_features(words: pa.Array) -> np.ndarray:
    """Feature names (64-bit) of each word, a column a kind: the word itself and its first 4, 5 and 6 characters; 0 where it is shorter."""
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    out = [mixed(hashed(words))]
    for n in STARTS:
        out.append(np.where(size > n, mixed(hashed(pc.utf8_slice_codeunits(words, 0, n)) + np.uint64(n)), np.uint64(0)))
    return np.stack(out, 1)


def present(texts: pa.Array, vocabulary: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs of some texts. With a sorted vocabulary, features are places in it and others are left out."""
    flat, at = split_words(letters_only(texts))
    code, words = coded(flat)
    names = word_features(words)
    if vocabulary is None:
        # A number for each distinct feature of the batch keeps the pairs in 64 bits.
        known, slot = np.unique(names, return_inverse=True)
        slot, found = slot.reshape(names.shape), names != 0
    else:
        slot = np.minimum(np.searchsorted(vocabulary, names), max(len(vocabulary) - 1, 0))
        found = (names != 0) & (vocabulary[slot] == names) if len(vocabulary) else np.zeros(names.shape, bool)
    rows = row_of(at)
    pairs = []
    for k in range(names.shape[1]):
        use = found[:, k][code]
        pairs.append(np.unique(rows[use] << 32 | slot[:, k][code[use]]))
    pairs = np.unique(np.concatenate(pairs))
    row, feature = pairs >> 32, pairs & 0xFFFFFFFF
    return row, (known[feature] if vocabulary is None else feature)


@dataclass
class ToxicityModel:
    """Weights of features, in ascending order of their names, and how many swaps in labelled sentences the fit has seen."""

    vocabulary: np.ndarray
    weights: np.ndarray
    bias: float
    swaps: int = 0

    def scores(self, texts: pa.Array) -> np.ndarray:
        row, feature = present(texts, self.vocabulary)
        total = np.bincount(row, weights=self.weights[feature], minlength=len(texts)) if len(row) else np.zeros(len(texts))
        return 1 / (1 + np.exp(-(total + self.bias)))


#: What ends a sentence.
SENTENCE_END = re.compile(r"[.!?\n]+")


def swap_changes(texts: pa.Array, vocabulary: np.ndarray, groups: list[list[str]]) -> Counter:
    """How often swaps in some texts change the same features: (lost, gained) places in the vocabulary, and the number of swaps.

    A swap puts another term of the group in a term's place all through one sentence. Which features a text has after it follows from how
    often it has them: one is lost if the sentence's uses were all of them, and gained if there was none. No text is copied."""
    out: Counter = Counter()
    others = {t: [o for o in group if o != t] for group in groups for t in group}
    terms = pa.array(sorted(others), pa.string())
    if not len(terms):
        return out
    of_term = word_features(terms)
    known = np.unique(of_term[of_term != 0])
    flat, at = split_words(letters_only(texts))
    code, words = coded(flat)
    some = pc.fill_null(pc.index_in(words, value_set=terms), -1).to_numpy() if len(words) else np.zeros(0, np.int64)
    row = row_of(at)
    rows = np.unique(row[some[code] >= 0])
    if not len(rows):
        return out
    # How often the texts that hold a term have each of the terms' features, by whichever word.
    names = word_features(words)
    slot = np.minimum(np.searchsorted(known, names), len(known) - 1)
    slot = np.where(known[slot] == names, slot, -1)
    held: dict[tuple[int, int], int] = {}
    for k in range(names.shape[1]):
        use = slot[:, k][code]
        pairs, n = np.unique(row[use >= 0] * len(known) + use[use >= 0], return_counts=True)
        for pair, c in zip(pairs.tolist(), n.tolist()):
            held[divmod(pair, len(known))] = held.get(divmod(pair, len(known)), 0) + c
    place = dict(zip(known.tolist(), _known_places(known, vocabulary).tolist()))
    slots = [{int(np.searchsorted(known, f)) for f in r[r != 0]} for r in of_term]
    index = {t: k for k, t in enumerate(terms.to_pylist())}
    name = terms.to_pylist()
    for r in rows.tolist():
        uses: Counter = Counter()
        parts = split_words(letters_only(pa.array(SENTENCE_END.split(texts[r].as_py()))))
        found = pc.fill_null(pc.index_in(parts[0], value_set=terms), -1).to_numpy().astype(np.int64)
        hit = found >= 0
        pairs, n = np.unique(row_of(parts[1])[hit] * len(name) + found[hit], return_counts=True)
        uses.update(zip((pairs % len(name)).tolist(), n.tolist()))
        for (t, c), times in uses.items():
            for other in others[name[t]]:
                o = index[other]
                gone = [place[int(known[f])] for f in slots[t] - slots[o] if held.get((r, f), 0) == c]
                come = [place[int(known[f])] for f in slots[o] - slots[t] if not held.get((r, f), 0)]
                out[tuple(sorted(x for x in gone if x >= 0)), tuple(sorted(x for x in come if x >= 0))] += times
    return out


def _known_places(names: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    if not len(vocabulary):
        return np.full(len(names), -1)
    at = np.minimum(np.searchsorted(vocabulary, names), len(vocabulary) - 1)
    return np.where(vocabulary[at] == names, at, -1)


def like_terms(
    chosen: DataFrame, given: list[list[str]], sizes: tuple[int, int], most: int = 400, least_docs: int = 20, group: int = 6, shortest: int = 3
) -> list[list[str]]:
    """Further groups of terms that texts use alike: of the `most` commonest words of the sample that do not tell the classes apart by
    themselves (within one standard error), those that mostly follow one word and precede one word go together, `group` at most."""

    def count(batches):
        for batch in pieces(batches, "text"):
            flat, at = split_words(letters_only(batch.column("text")))
            code, words = coded(flat)
            pairs = np.unique(row_of(at) * max(len(words), 1) + code)
            y = batch.column("toxic").to_numpy()[pairs // max(len(words), 1)]
            bad = np.bincount(pairs % max(len(words), 1), weights=y, minlength=len(words)).astype(np.int64)
            both = np.bincount(pairs % max(len(words), 1), minlength=len(words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([words, pa.array(bad), pa.array(both - bad)], ["word", "bad", "good"])

    bad_docs, good_docs = sizes
    words = chosen.select("text", "toxic").mapInArrow(count, "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    a, c = F.col("bad") + 0.5, F.col("good") + 0.5
    odds = F.log(a / (bad_docs + 1 - F.col("bad") + 0.5)) - F.log(c / (good_docs + 1 - F.col("good") + 0.5))
    calm = (F.col("bad") + F.col("good") >= least_docs) & (F.abs(odds / F.sqrt(1 / a + 1 / c)) <= 1) & (F.char_length("word") >= shortest)
    calm = calm & ~F.col("word").isin([t for g in given for t in g])
    rows = words.where(calm).orderBy(F.desc(F.col("bad") + F.col("good")), "word").limit(most).collect()
    terms = pa.array(sorted(r["word"] for r in rows), pa.string())
    if not len(terms):
        return []

    def beside(batches):
        for batch in pieces(batches, "text"):
            flat, at = split_words(letters_only(batch.column("text")))
            code, words = coded(flat)
            if not len(words):
                continue
            term = pc.fill_null(pc.index_in(words, value_set=terms), -1).to_numpy().astype(np.int64)[code]
            row, name = row_of(at), hashed(words).view(np.int64)[code]
            found = []
            for side in (-1, 1):
                here = np.flatnonzero(term >= 0)
                next_ = here + side
                here, next_ = here[(next_ >= 0) & (next_ < len(row))], next_[(next_ >= 0) & (next_ < len(row))]
                same = row[here] == row[next_]
                found.append((term[here[same]], np.full(same.sum(), side), name[next_[same]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["term", "side", "name"])

    near = chosen.select("text").mapInArrow(beside, "term long, side long, name long").groupBy("term", "side", "name").agg(F.count("*").alias("n"))
    near = near.groupBy("term", "side").agg(F.max(F.struct("n", "name"))["name"].alias("name")).collect()
    context: dict[int, dict[int, int]] = {}
    for r in near:
        context.setdefault(r["term"], {})[r["side"]] = r["name"]
    alike: dict[tuple, list[str]] = {}
    for t, sides in sorted(context.items()):
        alike.setdefault((sides.get(-1), sides.get(1)), []).append(terms[t].as_py())
    return [g[i : i + group] for _, g in sorted(alike.items(), key=lambda x: x[1]) for i in range(0, len(g), group) if len(g[i : i + group]) > 1]


def descend(
    indptr: np.ndarray, index: np.ndarray, y: np.ndarray, weight: np.ndarray, n_features: int, swaps: list[tuple[np.ndarray, np.ndarray, int]], penalty: float, l2: float, steps: int
) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient descent with momentum; the step of each weight follows a bound of its curvature (row sums)."""
    width = np.diff(indptr)
    rows = np.repeat(np.arange(len(y)), width)
    n = max(weight.sum(), 1e-9)
    w, b = np.zeros(n_features), float(np.log(((weight * y).sum() + 0.5) / ((weight * (1 - y)).sum() + 0.5)))
    bound = 0.25 * np.bincount(index, weights=(weight * (width + 1))[rows], minlength=n_features) / n + l2 / n
    bound_b = 0.25 * (weight * (width + 1)).sum() / n
    # Swaps as a sparse matrix: a row each, 1 where a feature comes and -1 where it goes.
    times = np.array([c for *_, c in swaps], float)
    share = 2 * penalty * times / max(1.0, times.sum())
    size = np.array([len(g) + len(x) for g, x, _ in swaps], np.int64)
    at = np.repeat(np.arange(len(swaps)), size)
    feature = np.concatenate([x for g, c, _ in swaps for x in (g, c)]).astype(np.int64) if len(swaps) else np.zeros(0, np.int64)
    sign = np.concatenate([x for g, c, _ in swaps for x in (-np.ones(len(g)), np.ones(len(c)))]) if len(swaps) else np.zeros(0)
    bound += np.bincount(feature, weights=(share * size)[at], minlength=n_features)
    speed, at_b = np.zeros(n_features), 0.0
    for _ in range(steps):
        ahead, ahead_b = w + 0.95 * speed, b + 0.95 * at_b
        z = np.bincount(rows, weights=ahead[index], minlength=len(y)) + ahead_b
        off = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        g = np.bincount(index, weights=off[rows], minlength=n_features) / n + l2 * ahead / n
        change = np.bincount(at, weights=sign * ahead[feature], minlength=len(swaps))
        g += np.bincount(feature, weights=sign * (share * change)[at], minlength=n_features)
        speed, at_b = 0.95 * speed - g / bound, 0.95 * at_b - off.sum() / n / bound_b
        w, b = w + speed, b + at_b
    return w, b


def fit(
    labelled: DataFrame, sample_docs: int = 20_000, min_z: float = 2.5, min_docs: int = 3, penalty: float = 1.0, l2: float = 0.1,
    steps: int = 600, groups: list[list[str]] = IDENTITY_GROUPS, like: int = 400,
) -> ToxicityModel:
    """Learn from `labelled` (text, toxic 0/1, and how many rows a row stands for in `weight` if there is one); rows without text or label
    teach nothing, and texts alike are one, with the larger of their labels. Without rows, every score is 0.5.

    Swapped are the terms of `groups` and, of the `like` commonest words without a class signal, those used alike (`like_terms`)."""
    weight = F.col("weight") if "weight" in labelled.columns else F.lit(1.0)
    rows = labelled.where("text is not null and toxic is not null").select("text", F.col("toxic").cast("int").alias("toxic"), weight.cast("double").alias("weight"))
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    keep = {k: min(1.0, sample_docs / 2 / n) for k, n in sizes.items()}
    share = F.element_at(F.create_map(*[F.lit(x) for k, v in keep.items() for x in (k, v)]), F.col("toxic"))
    chosen = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share * (1 << 30)).withColumn("weight", F.col("weight") / share)
    chosen = stored(chosen.groupBy("text").agg(F.max("toxic").alias("toxic"), F.max("weight").alias("weight")), "toxicity-sample")

    def count(batches):
        for batch in pieces(batches, "text"):
            y = batch.column("toxic").to_numpy()
            row, feature = present(batch.column("text"), None)
            names, inverse = np.unique(feature, return_inverse=True)
            bad = np.bincount(inverse, weights=y[row], minlength=len(names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(bad), pa.array(np.bincount(inverse, minlength=len(names)) - bad)], ["feature", "bad", "good"])

    per = chosen.select("text", "toxic").mapInArrow(count, "feature long, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    classes = chosen.agg(F.sum("toxic"), F.count("*")).first()
    bad_docs, good_docs = classes[0], classes[1] - classes[0]
    a, c = F.col("bad") + 0.5, F.col("good") + 0.5
    odds = F.log(a / (bad_docs + 1 - F.col("bad") + 0.5)) - F.log(c / (good_docs + 1 - F.col("good") + 0.5))
    telling = (F.col("bad") + F.col("good") >= min_docs) & (F.abs(odds / F.sqrt(1 / a + 1 / c)) > min_z)
    if like:
        groups = [*groups, *like_terms(chosen, groups, (bad_docs, good_docs), like)]
    terms = word_features(pa.array(sorted({t for group in groups for t in group}), pa.string()))
    names = per.where(telling).select("feature").toArrow()["feature"].to_numpy()
    vocabulary = np.unique(np.concatenate([names.view(np.uint64), terms[terms != 0]]))

    def gather(batches):
        for batch in pieces(batches, "text"):
            row, feature = present(batch.column("text"), vocabulary)
            offsets = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            changes = swap_changes(batch.column("text"), vocabulary, groups)
            # The batch's swaps go with its first row.
            held = [[{"gone": list(g), "come": list(x), "n": n} for (g, x), n in changes.items()]] + [None] * (batch.num_rows - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), batch.column("weight"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(feature.astype(np.int32))), pa.array(held, SWAPS)], ["toxic", "weight", "features", "swaps"]
            )

    # The bounded sample, as places in its vocabulary.
    got = chosen.mapInArrow(gather, "toxic int, weight double, features array<int>, swaps array<struct<gone:array<int>,come:array<int>,n:int>>").toArrow()
    lists = got["features"].combine_chunks()
    index = lists.flatten().to_numpy()
    indptr = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
    total: Counter = Counter()
    for part in got["swaps"].drop_null().to_pylist():
        for x in part:
            total[tuple(x["gone"]), tuple(x["come"])] += x["n"]
    swaps = [(np.array(g, np.int64), np.array(x, np.int64), n) for (g, x), n in sorted(total.items()) if g or x]
    w, b = descend(indptr, index, got["toxic"].to_numpy().astype(float), got["weight"].to_numpy(), len(vocabulary), swaps, penalty, l2, steps)
    return ToxicityModel(vocabulary, w, b, sum(total.values()))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: `doc_id, score`, the probability of label 1. A null text scores as an empty one does, the model's bias.

    A text of any length is one row of a batch and is read whole. Ids may repeat or be null, equal texts have equal scores, an empty table
    gives no row, and other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sent.value.scores(pc.fill_null(batch.column("text"), "")))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(score, "doc_id long, score double")


def labelled_texts(docs: DataFrame, labels: DataFrame, sample_docs: int = 20_000, label: str = "toxic") -> DataFrame:
    """`doc_id, text, toxic, weight` of labelled documents, at most about `sample_docs` of them and half of each class, chosen by a hash of
    their id; `weight` is how many labels a row stands for. Of several labels of one id the larger holds. `label` names the column."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias(label))
    sizes = {r[label]: r["n"] for r in one.groupBy(label).agg(F.count("*").alias("n")).collect()}
    share = F.lit(1.0)
    for k, n in sizes.items():
        share = F.when(F.col(label) == k, min(1.0, sample_docs / 2 / n)).otherwise(share)
    chosen = one.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)).withColumn("weight", 1 / share)
    # As many rows as the sample's bound says, however large the tables.
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that score under the threshold, all their columns as they are. A null text is judged as an empty one; rows
    alike share their fate, also where the score is the threshold itself (they go)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        for batch in pieces(batches, text_col):
            yield batch.filter(pa.array(sent.value.scores(pc.fill_null(batch.column(text_col), "")) < threshold))

    return docs.mapInArrow(keep, docs.schema)
