"""Ranked lexical search by a document FP-tree and branch and bound.

Documents are cut down to the terms that the queries ask for (the restricted term vector) and each vector is put in the order of falling
document frequency. In each task the vectors of a bounded number of documents share paths of a trie: a node is what documents with one
beginning have in common. Each node knows, for each term, the largest tf below it, the least m and the least id, and these bound the score
of every document below. For each query the trie is gone down depth first, the best child first, and what cannot enter the ten best any
more is not entered. The ten best of a task go on into its next trie as the bar to pass; the tasks' ten best meet at the end.

Scores are whole numbers, so bounds are exact: div is monotone in tf and in m.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored
from .textarrow import alnum_table, coded, pieces, remap, row_of, split_words

#: Id of a document without one, for ties: after all others.
NO_ID = np.iinfo(np.int64).max


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Terms of all texts, A-Z in lower case, and the rows' first places."""
    return split_words(remap(pc.fill_null(texts, ""), alnum_table()))


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """`uid, item_id, terms, bytes`: a query's distinct terms; rows of one id are queries of their own."""

    def split(batches):
        for batch in pieces(batches, "text"):
            flat, at = terms_of(batch.column("text"))
            code, words = coded(flat)
            rows = row_of(at)
            pairs = np.unique(rows << 32 | code)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs >> 32, np.arange(batch.num_rows + 1)).astype(np.int32)), words.take(pa.array(pairs & 0xFFFFFFFF)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("uid", "item_id")), lists, pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())], ["uid", "item_id", "terms", "bytes"])

    kind = items.schema[item_col].dataType.simpleString()
    rows = items.select(F.monotonically_increasing_id().alias("uid"), F.col(item_col).alias("item_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(split, f"uid long, item_id {kind}, terms array<string>, bytes long")


def in_blocks(items: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The queries in blocks of at most `block_bytes` of text each, or one query where it alone is longer."""
    total = items.agg(F.sum("bytes"), F.count("*")).first()
    if not total[1]:
        return []
    n = max(1, math.ceil(2 * (total[0] or 0) / block_bytes)) if (total[0] or 0) > block_bytes else 1
    while True:
        dealt = items.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(n)))
        sizes = dealt.groupBy("block").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
        if not sizes.where((F.col("bytes") > block_bytes) & (F.col("n") > 1)).take(1):
            return [dealt.where(F.col("block") == k).drop("block") for k in range(n)]
        n *= 2


def restricted(docs: DataFrame, vocabulary: pa.Array, id_col: str, text_col: str) -> DataFrame:
    """`doc_id, n, terms, tfs` of each document with a term: its terms with repeats counted in n, its vector's places in `vocabulary`."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        vocabulary = sent.value
        for batch in pieces(batches, "text"):
            flat, at = terms_of(batch.column("text"))
            code, words = coded(flat)
            place = pc.fill_null(pc.index_in(words, value_set=vocabulary), -1).to_numpy().astype(np.int64)[code] if len(words) else code
            use = place >= 0
            pairs, tf = np.unique(row_of(at)[use] << 32 | place[use], return_counts=True)
            lists = [pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs >> 32, np.arange(batch.num_rows + 1)).astype(np.int32)), pa.array(x.astype(np.int32))) for x in (pairs & 0xFFFFFFFF, tf)]
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), *lists], ["doc_id", "n", "terms", "tfs"])
            yield out.filter(pc.greater(out.column("n"), 0))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<int>")


def part(w, tf, m):
    """What a term adds to a score: whole numbers, rounded down."""
    return w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


@dataclass
class Vectors:
    """Vectors one after another: the terms of vector i are terms[at[i] : at[i + 1]]."""

    at: np.ndarray
    terms: np.ndarray
    tfs: np.ndarray

    def take(self, rows: np.ndarray) -> Vectors:
        size = np.diff(self.at)[rows]
        at = np.concatenate([[0], np.cumsum(size)])
        place = np.repeat(self.at[:-1][rows] - at[:-1], size) + np.arange(at[-1])
        return Vectors(at, self.terms[place], self.tfs[place])

    def largest(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct terms of all vectors, and the largest tf of each."""
        order = np.lexsort((self.tfs, self.terms))
        terms, tfs = self.terms[order], self.tfs[order]
        last = np.concatenate([terms[1:] != terms[:-1], [True]]) if len(terms) else np.zeros(0, bool)
        return terms[last], tfs[last]


class FPTree:
    """A trie over vectors whose terms are ascending places in the order of falling document frequency.

    Documents lie in the order of their vectors, so a node is a stretch of them that share a beginning. A stretch of at most `leaf`
    documents is not parted further; small neighbours with one parent are one stretch. `bounds` has a vector for each node: the largest
    tf of each term below it. The children of a node stand next to each other."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, vectors: Vectors, most: int, leaf: int = 48):
        names = [vectors.terms[a:b].astype(">i4").tobytes() for a, b in zip(vectors.at[:-1], vectors.at[1:])]
        tfs = [vectors.tfs[a:b].tobytes() for a, b in zip(vectors.at[:-1], vectors.at[1:])]
        order = sorted(range(len(names)), key=lambda i: (names[i], tfs[i], m[i], ids[i]))
        # Of documents alike in vector and m, which tie for every query, those of the `most` smallest ids can be among the best.
        kept, run = [], 0
        for k, i in enumerate(order):
            before = order[k - 1]
            run = run + 1 if k and names[i] == names[before] and tfs[i] == tfs[before] and m[i] == m[before] else 0
            if run < most:
                kept.append(i)
        rows = np.array(kept, np.int64)
        self.ids, self.m, self.docs, self.leaf = ids[rows], m[rows], vectors.take(rows), leaf
        self.span, self.children = [(0, len(rows))], [(0, 0)]
        waiting = [(0, 0)]
        while waiting:
            node, depth = waiting.pop()
            lo, hi = self.span[node]
            if hi - lo > leaf:
                parts, depth = self.parts(lo, hi, depth)
                self.children[node] = (len(self.span), len(self.span) + len(parts))
                for a, b, shared in parts:
                    if shared and b - a > leaf:
                        waiting.append((len(self.span), depth + 1))
                    self.span.append((a, b))
                    self.children.append((0, 0))
        self.bound()

    def parts(self, lo: int, hi: int, depth: int) -> tuple[list[tuple[int, int, bool]], int]:
        """A stretch of documents alike up to `depth` as smaller ones: (from, to, whether all go on with one term), and the depth where they part."""
        at, terms = self.docs.at, self.docs.terms
        first, last = terms[at[lo] : at[lo + 1]], terms[at[hi - 1] : at[hi]]
        short = min(len(first), len(last))
        differ = np.flatnonzero(first[:short] != last[:short])
        depth = int(differ[0]) if len(differ) else short
        size = np.diff(at[lo : hi + 1])
        if depth == len(last):  # all have the same terms
            return [(a, min(a + self.leaf, hi), False) for a in range(lo, hi, self.leaf)], depth
        next_ = np.where(size > depth, terms[np.minimum(at[lo:hi] + depth, len(terms) - 1)], -1)
        cuts = [lo, *(lo + 1 + np.flatnonzero(next_[1:] != next_[:-1])).tolist(), hi]
        out: list[tuple[int, int, bool]] = []
        for a, b in zip(cuts, cuts[1:]):
            if next_[a - lo] < 0 and b - a > self.leaf:  # ends here
                out += [(x, min(x + self.leaf, b), False) for x in range(a, b, self.leaf)]
            elif out and b - out[-1][0] <= self.leaf:
                out[-1] = (out[-1][0], b, False)
            else:
                out.append((a, b, True))
        return out, depth

    def bound(self) -> None:
        """The nodes' bounds from the leaves up; a node is made before its children, so going backwards meets these first."""
        terms, tfs = [None] * len(self.span), [None] * len(self.span)
        self.least_m, self.least_id = np.zeros(len(self.span), np.int64), np.zeros(len(self.span), np.int64)
        for node in range(len(self.span) - 1, -1, -1):
            (lo, hi), (a, b) = self.span[node], self.children[node]
            if b > a:
                below = Vectors(np.zeros(1, np.int64), np.concatenate(terms[a:b]), np.concatenate(tfs[a:b]))
            else:
                below = Vectors(np.zeros(1, np.int64), self.docs.terms[self.docs.at[lo] : self.docs.at[hi]], self.docs.tfs[self.docs.at[lo] : self.docs.at[hi]])
            terms[node], tfs[node] = below.largest()
            self.least_m[node], self.least_id[node] = self.m[lo:hi].min(initial=NO_ID), self.ids[lo:hi].min(initial=NO_ID)
        at = np.concatenate([[0], np.cumsum([len(t) for t in terms])])
        self.bounds = Vectors(at, np.concatenate(terms), np.concatenate(tfs))

    def search(self, weight: np.ndarray, best: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
        """The `most` best (-score, id), those of `best` among them; `weight` has the query's weight for each term, 0 for the others."""
        waiting = [(0, 0)] if len(self.ids) else []  # less its bound, and the node; the root has none
        least = np.iinfo(np.int64).min
        while waiting:
            held, node = waiting.pop()
            if len(best) == most and node and (held, self.least_id[node]) >= best[-1]:
                continue
            a, b = self.children[node]
            if b > a:
                score = self.sums(self.bounds, a, b, self.least_m[a:b], weight)
                bar = best[-1] if len(best) == most else (0, least)
                order = np.argsort(score, kind="stable")
                waiting += [(-int(score[k]), a + int(k)) for k in order if score[k] and (-score[k], self.least_id[a + k]) < bar]
            else:
                lo, hi = self.span[node]
                score = self.sums(self.docs, lo, hi, self.m[lo:hi], weight)
                some = np.flatnonzero(score >= max(1, -best[-1][0] if len(best) == most else 1))
                if len(some):
                    best = sorted([*best, *zip((-score[some]).tolist(), self.ids[lo:hi][some].tolist())])[:most]
        return best

    @staticmethod
    def sums(vectors: Vectors, lo: int, hi: int, m: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Scores of vectors lo to hi."""
        first = vectors.at[lo : hi + 1]
        w = weight[vectors.terms[first[0] : first[-1]]]
        use = np.flatnonzero(w)
        of = np.searchsorted(use, first - first[0])
        owner = np.repeat(np.arange(hi - lo), np.diff(of))
        added = part(w[use], vectors.tfs[first[0] + use].astype(np.int64), m[owner])
        total = np.concatenate([[0], np.cumsum(added)])
        return total[of[1:]] - total[of[:-1]]


def top_documents(
    docs: DataFrame, items: DataFrame, most: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    block_bytes: int = 8 << 20, tree_terms: int = 1_000_000,
) -> DataFrame:
    """The `most` best documents of each query: `item_id, rank, doc_id, score`, ranks from 1, equal scores by ascending doc_id.

    Null and empty texts have no term: such documents count for nothing and such queries find nothing. Documents of score 0 are not found.
    A text of any length is read whole. Repeated rows are documents, or queries, of their own; a document without an id ties after all
    others and is given back without one. An empty table of either kind gives no row, and other columns are ignored whatever their names.

    Queries go in blocks of at most `block_bytes` of text, which bounds what is broadcast; each block is one more pass over the documents.
    A tree holds documents of about `tree_terms` terms.
    """
    spark = docs.sparkSession
    kind = items.schema[item_col].dataType.simpleString()
    schema = f"uid long, item_id {kind}, doc_id long, score long"
    found = [search_block(docs, block, most, id_col, text_col, tree_terms, schema) for block in in_blocks(stored(item_terms(items, item_col, item_text_col), "search-items"), block_bytes)]
    found = [x for x in found if x is not None]
    if not found:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    rows = found[0]
    for x in found[1:]:
        rows = rows.unionByName(x)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # The tasks' best of a query meet in shares first, so that no task gets as many rows as there were tasks.
    rows = rows.withColumn("share", F.pmod(F.xxhash64("doc_id", "score"), F.lit(32)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("uid", "share").orderBy(*order))).where(F.col("rank") <= most)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("uid").orderBy(*order))).where(F.col("rank") <= most)
    return rows.select("item_id", "rank", "doc_id", "score")


def search_block(docs: DataFrame, block: DataFrame, most: int, id_col: str, text_col: str, tree_terms: int, schema: str) -> DataFrame | None:
    """The best documents of a block of queries in each task; None where there is nothing to find."""
    got = block.orderBy("uid").toArrow()  # a block of bounded size
    vocabulary = pc.unique(got["terms"].combine_chunks().flatten()) if got.num_rows else pa.array([], pa.string())
    if not len(vocabulary):
        return None
    vectors = stored(restricted(docs, vocabulary, id_col, text_col), "search-vectors")
    n_docs, n_terms = vectors.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    # As many rows as the vocabulary of a block has.
    df = np.zeros(len(vocabulary), np.int64)
    counted = vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toArrow()
    df[counted["t"].to_numpy()] = counted["df"].to_numpy()
    order = np.argsort(-df, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df[order].tolist()], np.int64)
    lists = got["terms"].combine_chunks()
    asked = place[pc.index_in(lists.flatten(), value_set=vocabulary).to_numpy()]
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
    names = pa.table([got["uid"], got["item_id"]], ["uid", "item_id"]).combine_chunks()
    sent = docs.sparkSession.sparkContext.broadcast((names, place, weight, asked, ends, n_docs, n_terms))

    def search(batches):
        names, place, weight, asked, ends, n_docs, n_terms = sent.value
        best: list[list[tuple[int, int]]] = [[] for _ in range(len(ends) - 1)]
        own = np.zeros(len(weight), np.int64)

        def grow(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            lists = table["terms"].combine_chunks()
            at = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int64)
            terms, tfs = place[lists.flatten().to_numpy()], table["tfs"].combine_chunks().flatten().to_numpy()
            order = np.lexsort((terms, np.repeat(np.arange(len(at) - 1), np.diff(at))))
            m = 10 + (90 * table["n"].to_numpy() * n_docs) // n_terms
            ids = pc.fill_null(table["doc_id"], NO_ID).to_numpy()
            tree = FPTree(ids, m, Vectors(at, terms[order], tfs[order]), most)
            for i in range(len(best)):
                mine = asked[ends[i] : ends[i + 1]]
                own[mine] = weight[mine]
                best[i] = tree.search(own, best[i], most)
                own[mine] = 0

        held, size = [], 0
        for batch in batches:
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column("terms")), 0))
            upto = np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy().astype(np.int64))
            at = 0
            while at < batch.num_rows:
                # The rows that still go into this tree: one at least.
                before = upto[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(upto, before + tree_terms - size, side="right")))
                held.append(batch.slice(at, to - at))
                size, at = size + int(upto[to - 1] - before), to
                if size >= tree_terms or at < batch.num_rows:
                    grow(held)
                    held, size = [], 0
        if held:
            grow(held)
        rows = [(i, ids, -score) for i, b in enumerate(best) for score, ids in b]
        if rows:
            item, ids, score = (np.array(x, np.int64) for x in zip(*rows))
            of = names.take(pa.array(item))
            yield pa.RecordBatch.from_arrays([of["uid"].combine_chunks(), of["item_id"].combine_chunks(), pa.array(ids, mask=ids == NO_ID), pa.array(score)], ["uid", "item_id", "doc_id", "score"])

    return vectors.mapInArrow(search, schema)


def duckdb_sql(most: int = 10) -> str:
    """The same ranking in SQL over tables `documents` and `benchmark`."""
    terms = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, {terms} AS words FROM documents WHERE text IS NOT NULL),
    held AS (SELECT row, doc_id, words, len(words) AS n FROM d WHERE len(words) > 0),
    size AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM held),
    q AS (SELECT row_number() OVER () AS item, item_id, list_distinct({terms}) AS words FROM benchmark WHERE text IS NOT NULL),
    asked AS (SELECT item, item_id, unnest(words) AS term FROM q),
    tf AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(words) AS term FROM held)
           WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
    w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w
          FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), size),
    scored AS (SELECT item, item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
               FROM tf JOIN w USING (term) JOIN asked USING (term), size GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {most}"""
