"""Mixing to target weights with soft domain membership.

A classifier learned from the labelled table gives each document posteriors over the domains. Rates, how many times a document is
taken, are then fitted so that the expected tokens of every domain (tokens x rate x posterior, over all documents) meet their targets:
least squares over nonnegative rates by projected gradient. With A the domains x documents matrix of tokens x posterior and W the
inverse token counts, a step is `r <- max(0, r - s W A' B (A r - T))` with `B = (A W A')^-1` over the documents whose rate is not zero:
in that metric a step of length `s = 1` meets the targets at once unless it takes rates to zero, so rounds are few. A document's step is
its posteriors times a vector of one number a domain. A round is one aggregation over the documents, and rates follow from the rounds'
vectors, so nothing but the domains' totals leaves the executors.

Where one domain is to stay whole, documents that are most likely of it keep rate 1 and all rates stay within [0, 1]: the others are
thinned until each domain over its share is at its share of what is taken. Domains short of their share stay short.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let, stored

#: Marks that words are parted by, beside white space.
MARKS = "\n\r\t\x0b\x0c.,;:!?\"()[]{}"


def word_array(text: Column) -> Column:
    """Lower-case words of a text; a null text has none."""
    return F.array_remove(F.split(F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKS, " " * len(MARKS)), " "), "")


def shape_words(text: Column, n_words: Column) -> Column:
    """Pseudo-words for the looks of a text: shares of marks and capitals and its length, in steps."""
    size = F.length(text) + 1
    steps = lambda share: F.floor(F.least(share, F.lit(0.99)) * 20).cast("string")
    marks = (F.length(text) - F.length(F.translate(text, "#*$%&|<>!{}[]=@", ""))) / size
    capitals = (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))) / size
    return F.array(F.concat(F.lit("\x00marks"), steps(marks)), F.concat(F.lit("\x00capitals"), steps(capitals)), F.concat(F.lit("\x00length"), F.floor(F.log2(n_words + 1)).cast("string")))


@dataclass
class DomainModel:
    """Bernoulli naive Bayes over a bounded vocabulary: each domain's start, and what the presence of a word adds."""

    domains: list[str]
    start: list[float]
    added: dict[str, list[float]] = field(default_factory=dict)

    def posteriors(self, text: Column, words: Column) -> Column:
        """Array of one probability a domain."""
        start = F.array(*[F.lit(float(x)) for x in self.start])

        def shares(logs: Column) -> Column:
            return let(F.transform(logs, lambda x: F.exp(x - F.array_max(logs))), lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(e, lambda x: x / total)))

        if not self.added:
            return shares(start)
        table = F.create_map(*[x for w, a in self.added.items() for x in (F.lit(w), F.array(*[F.lit(float(v)) for v in a]))])
        named = F.array(*[F.lit(w) for w in self.added])
        seen = F.array_intersect(F.concat(words, shape_words(F.coalesce(text, F.lit("")), F.size(words))), named)
        return let(F.aggregate(seen, start, lambda total, w: F.zip_with(total, F.element_at(table, w), lambda a, b: a + b)), shares)


def fit_domains(docs: DataFrame, labelled: DataFrame, domains: list[str], sample_docs: int = 8000, words_each: int = 100, min_docs: int = 5, min_lift: float = 5.0) -> DomainModel:
    """Learn from `labelled` (doc_id, domain): at most about `sample_docs` of its documents, and the `words_each` words that tell each
    domain best, each `min_lift` times as frequent there as elsewhere. Labels outside `domains`, or null, teach nothing; of several labels of one id the first in order holds. Without any, all
    posteriors are equal."""
    known = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    n = known.count()
    if not n:
        return DomainModel(domains, [0.0] * len(domains))
    keep = min(1.0, sample_docs / n)
    # The sample's size is bounded by its parameter, and so is what is broadcast.
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= int(keep * (1 << 30)))
    features = let(word_array(F.col("text")), lambda w: F.array_distinct(F.concat(w, shape_words(F.coalesce("text", F.lit("")), F.size(w)))))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("domain", features.alias("words"))
    rows = stored(rows, "mixing-sample")
    sizes = {r[0]: r[1] for r in rows.groupBy("domain").count().collect()}
    total = sum(sizes.values())
    counts = rows.select("domain", F.explode("words").alias("word")).groupBy("word").pivot("domain", domains).count().na.fill(0)
    counts = counts.withColumn("all", sum((F.col(f"`{d}`") for d in domains), F.lit(0))).where(F.col("all") >= min_docs)
    chosen = []
    for d in domains:
        n_own, own = sizes.get(d, 0), F.col(f"`{d}`")
        expected = F.col("all") * (n_own / max(total, 1))
        # Words that are several times as frequent in the domain as elsewhere, those furthest above expectation first.
        lift = ((own + 0.5) / (n_own + 1)) / ((F.col("all") - own + 0.5) / (total - n_own + 1))
        chosen.append(counts.where(lift >= min_lift).orderBy(F.desc((own - expected) / F.sqrt(expected + 0.5)), "word").limit(words_each))
    got = {}
    for part in chosen:
        for r in part.collect():
            got[r["word"]] = [r[d] for d in domains]
    model = DomainModel(domains, [], {})
    seen = [sizes.get(d, 0) for d in domains]
    start = [math.log((s + 1) / (total + len(domains))) for s in seen]
    for word, by in sorted(got.items()):
        p = [(c + 0.5) / (s + 1) for c, s in zip(by, seen)]
        start = [a + math.log(1 - x) for a, x in zip(start, p)]
        model.added[word] = [math.log(x) - math.log(1 - x) for x in p]
    model.start = start
    return model


def solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Solution of a small symmetric system by elimination; rows that vanish (an empty domain) give 0."""
    n = len(right)
    m = [[*row, b] for row, b in zip(matrix, right)]
    scale = max([abs(x) for row in matrix for x in row] + [1e-300])
    pivots = []
    for col in range(n):
        best = max((r for r in range(n) if r not in [p for p, _ in pivots]), key=lambda r: abs(m[r][col]), default=None)
        if best is None or abs(m[best][col]) <= 1e-12 * scale:
            continue
        pivots.append((best, col))
        for r in range(n):
            if r != best and m[r][col]:
                f = m[r][col] / m[best][col]
                m[r] = [a - f * b for a, b in zip(m[r], m[best])]
    out = [0.0] * n
    for row, col in pivots:
        out[col] = m[row][n] / m[row][col]
    return out


def held_whole(posteriors: Column, whole: int) -> Column:
    """Whether no domain is likelier than `whole`."""
    return posteriors[whole] >= F.array_max(posteriors)


def rate_of(posteriors: Column, steps: list[list[float]], whole: int | None = None) -> Column:
    """A document's rate after some rounds: from one copy, down each round's vector, never below zero; with a domain `whole` never above
    one, and one for its documents."""
    if not steps:
        return F.lit(1.0)
    rounds = F.array(*[F.array(*[F.lit(float(x)) for x in g]) for g in steps])
    down = lambda g: F.aggregate(F.zip_with(posteriors, g, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)
    if whole is None:
        return F.aggregate(rounds, F.lit(1.0), lambda r, g: F.greatest(F.lit(0.0), r - down(g)))
    thinned = F.aggregate(rounds, F.lit(1.0), lambda r, g: F.least(F.lit(1.0), F.greatest(F.lit(0.0), r - down(g))))
    return F.when(held_whole(posteriors, whole), 1.0).otherwise(thinned)


def fit_rates(measured: DataFrame, targets: list[float], most_rounds: int = 60, tolerance: float = 1e-6) -> list[list[float]]:
    """Rounds' vectors for `measured` (n_tokens, p): until every domain is within `tolerance` of the largest target.

    A round tries a few lengths of its step in one aggregation and takes the one that leaves the least squares. The rounds end early
    where none leaves less, as where no rates meet the targets; what is then off by over a thousandth is told in a warning, and
    `domain_totals` gives it.
    """
    k = len(targets)
    t, p = F.col("n_tokens").cast("double"), F.col("p")
    lengths = (1.0, 0.5, 0.25, 0.1, 0.03, 0.01)

    def at(points: list[list[list[float]]]) -> list[tuple[list[float], list[list[float]]]]:
        """Of each way to go on: what is off by domain, and the metric over the documents that are still taken."""
        rates = [F.lit(1.0)] if points == [[]] else [rate_of(p, x) for x in points]
        # The rates are computed once a row and summed up from an array.
        rows = measured.select(t.alias("t"), p.alias("p"), F.array(*rates).alias("r"))
        asked = []
        for i in range(len(points)):
            r = F.col("r")[i]
            asked += [F.sum(F.col("t") * r * F.col("p")[a]) for a in range(k)]
            asked += [F.sum(F.when(r > 0, F.col("t")).otherwise(0.0) * F.col("p")[a] * F.col("p")[b]) for a in range(k) for b in range(k)]
        got = [x or 0.0 for x in rows.agg(*asked).first()]
        parts = [got[i : i + k + k * k] for i in range(0, len(got), k + k * k)]
        return [([a - b for a, b in zip(x[:k], targets)], [x[k + i * k : k + i * k + k] for i in range(k)]) for x in parts]

    scale = max([*targets, 1e-300])
    steps: list[list[float]] = []
    off, metric = at([steps])[0]
    for _ in range(most_rounds):
        if max(map(abs, off), default=0.0) <= tolerance * scale:
            break
        ridge = 1e-9 * sum(metric[i][i] for i in range(k))
        full = solve([[x + ridge * (i == j) for j, x in enumerate(row)] for i, row in enumerate(metric)], off)
        points = [[*steps, [x * length for x in full]] for length in lengths]
        found = at(points)
        squares = [sum(x * x for x in o) for o, _ in found]
        best = squares.index(min(squares))
        if squares[best] >= sum(x * x for x in off) * (1 - 1e-6):
            break
        steps, (off, metric) = points[best], found[best]
    if max(map(abs, off), default=0.0) > 1e-3 * scale:
        warnings.warn(f"domains are off their targets {targets} by {off}", stacklevel=2)
    return steps


def domain_totals(measured: DataFrame, steps: list[list[float]], domains: list[str], targets: list[float], whole: int | None = None) -> DataFrame:
    """`domain, available, target, taken`: expected tokens of each domain before and after the rates."""
    t, r = F.col("n_tokens").cast("double"), rate_of(F.col("p"), steps, whole)
    each = measured.select(t.alias("t"), r.alias("r"), F.posexplode("p").alias("i", "q"))
    sums = each.groupBy("i").agg(F.sum(F.col("t") * F.col("q")).alias("available"), F.sum(F.col("t") * F.col("r") * F.col("q")).alias("taken"))
    names, goals = F.array(*[F.lit(d) for d in domains]), F.array(*[F.lit(float(x)) for x in targets])
    return sums.select(names[F.col("i")].alias("domain"), "available", goals[F.col("i")].alias("target"), "taken")


def fit_thinning(measured: DataFrame, share: list[float], whole: int, most_rounds: int = 40, tolerance: float = 1e-4) -> list[list[float]]:
    """One round's vector for `measured` (n_tokens, p) that thins the domains over their `share`, beside documents of `whole` at rate one.

    A domain's excess is its taken tokens less its share's ratio to those of `whole`, so the total falls with the mass of `whole` that
    thinned documents held. Of all rates without an excess, those nearest to one (squares weighed by tokens) are `1 - q v` cut to [0, 1],
    with q a document's part in the excesses and one v >= 0 a domain; v is found by Newton steps on the dual. Where documents of `whole`
    alone hold more of a domain than its share, its excess stays and the steps end when they change nothing.
    """
    others = [j for j in range(len(share)) if j != whole]
    ratio = {j: share[j] / share[whole] for j in others}
    m = len(others)
    t, p = F.col("n_tokens").cast("double"), F.col("p")
    q = [p[j] - ratio[j] * p[whole] for j in others]
    free = F.when(held_whole(p, whole), 0.0).otherwise(t)
    total = lambda x: F.coalesce(F.sum(x), F.lit(0.0))
    dot = lambda v: sum((x * F.lit(float(c)) for x, c in zip(q, v)), F.lit(0.0))
    cells = [(a, b) for a in range(m) for b in range(m)]

    def at(points: list[list[float]]) -> list[tuple[float, float, list[float], list[float]]]:
        """Of each v: the dual's value, tokens taken, excesses and curvature; all in one aggregation."""
        asked = []
        for v in points:
            s = dot(v)
            rate = F.when(held_whole(p, whole), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - s)))
            inner = F.when((1 - s > 0) & (1 - s <= 1), free).otherwise(0.0)
            asked += [total(-t * ((rate - 1) * (rate - 1) / 2 + s * rate)), total(t * rate), *[total(t * rate * x) for x in q], *[total(inner * q[a] * q[b]) for a, b in cells]]
        got = list(measured.agg(*asked).first())
        size = 2 + m + m * m
        parts = [got[i : i + size] for i in range(0, len(got), size)]
        return [(x[0], x[1], x[2 : 2 + m], x[2 + m :]) for x in parts]

    v = [0.0] * m
    here = at([v])[0]
    full = here[3]
    for _ in range(most_rounds):
        _, taken, excess, curve = here
        # A domain at v = 0 that is short has nothing to thin.
        moved = [a for a in range(m) if v[a] > 0 or excess[a] > 0]
        if all(abs(excess[a]) <= tolerance * taken for a in moved):
            break
        step = solve([[curve[a * m + b] + 1e-3 * full[a * m + b] for b in moved] for a in moved], [excess[a] for a in moved])
        points = [[max(0.0, v[a] + share_of * step[moved.index(a)]) if a in moved else v[a] for a in range(m)] for share_of in (1.0, 0.5, 0.2, 0.05, 0.01, 0.001)]
        found = at(points)
        best = min(range(len(points)), key=lambda i: found[i][0])
        if found[best][0] >= here[0] or max(abs(a - b) for a, b in zip(found[best][2], excess)) <= 1e-3 * tolerance * taken:
            break
        v, here = points[best], found[best]
    if not any(v):
        return []
    y = [0.0] * len(share)
    for j, x in zip(others, v):
        y[j] = x
        y[whole] -= ratio[j] * x
    return [y]


def with_domains(rows: DataFrame, model: DomainModel, text: Column) -> DataFrame:
    """`rows` and `n_tokens, p`: words and posteriors of a text."""
    both = let(word_array(text), lambda w: F.struct(F.size(w).cast("long").alias("n_tokens"), model.posteriors(text, w).alias("p")))
    return rows.select("*", both.alias("measured")).select(*rows.columns, "measured.n_tokens", "measured.p")


def targets_for(measured: DataFrame, weights: Mapping[str, float], domains: list[str], total: float | None) -> list[float]:
    """Token targets: shares of `total`, or of the most that can be had without taking more of a domain than there is."""
    have = measured.agg(*[F.coalesce(F.sum(F.col("n_tokens") * F.col("p")[i]), F.lit(0.0)) for i in range(len(domains))]).first()
    share = [weights.get(d, 0.0) / sum(weights.values()) for d in domains]
    if total is None:
        total = min([h / s for h, s in zip(have, share) if s > 0], default=0.0)
    return [s * total for s in share]


def mixing_rates(docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float], total: float | None = None, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of `docs`: `doc_id, n_tokens, p, rate`.

    `weights` names the domains and their target shares; `labelled` has `doc_id, domain`. `total` is the number of tokens to aim at. `p`
    holds the posteriors in the order of `weights`. A null or empty text has no tokens and never changes a total; its rate follows from
    its posteriors as any other's. Targets that no rates meet are met as nearly as least squares can. An empty table gives an empty one;
    ids may repeat or be null and other columns are ignored.
    """
    domains = list(weights)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = fit_domains(rows, labelled, domains, **options)
    measured = stored(with_domains(rows, model, F.col("text")).drop("text"), "mixing")
    steps = fit_rates(measured, targets_for(measured, weights, domains, total))
    return measured.withColumn("rate", rate_of(F.col("p"), steps))


def mixed_documents(docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float], total: float | None = None, whole: str | None = None, **options) -> DataFrame:
    """`docs` with each row taken as often as its rate says: the whole part, and once more if a hash of the row is under the rest.

    With a domain `whole`, its documents are all taken once, others once or not at all, and `total` plays no part. Columns stay as they
    are, whatever their names.
    """
    domains = list(weights)
    model = fit_domains(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labelled, domains, **options)
    # The rows are kept beside their posteriors, which are thus worked out once.
    measured = stored(with_domains(docs.select(F.struct("*").alias("row")), model, F.col("row.text")), "mixing")
    kept = None if whole is None else domains.index(whole)
    if kept is None:
        steps = fit_rates(measured, targets_for(measured, weights, domains, total))
    else:
        steps = fit_thinning(measured, [weights[d] / sum(weights.values()) for d in domains], kept)
    # A rate within the fit's tolerance of a whole number is that number.
    near = let(rate_of(F.col("p"), steps, kept), lambda r: F.when(F.abs(r - F.round(r)) < 1e-3, F.round(r)).otherwise(r))
    chance = F.pmod(F.xxhash64("row.doc_id", "row.text"), F.lit(1 << 30)) / float(1 << 30)
    copies = let(near, lambda r: (F.floor(r) + F.when(chance < r - F.floor(r), 1).otherwise(0)).cast("int"))
    # array_repeat gives no element for 0.
    return measured.select("row", F.explode(F.array_repeat(F.lit(1), copies)).alias("copy")).select("row.*")
