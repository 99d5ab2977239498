"""N-gram language model scores by a weighted backoff automaton.

Documents are taken in blocks. A block is coded once and stored. Its distinct n-grams go, in slices of the hash space, to the tasks
that add up their counts over all blocks; what comes back to a block are the totals of those n-grams that other blocks have too. From
n = 3 on a block sends only n-grams whose beginning and end other blocks have as well, as no other can be elsewhere. From the totals the
block builds the part of the automaton that its texts can visit, so no task ever holds the whole model, and no n-gram is pruned.

States are n-grams seen in training. An arc reads a word and carries its log-probability in the state; a state without an arc for a word
fails to the state of its longest proper suffix at a cost. With `c` the training counts:

*   root: `p(w) = (c(w) - D) / N`, and `p(unknown) = D * V / N`; `D = n1 / (n1 + 2 * max(n2, 1))` from the words seen once and twice,
    or `1 / (V + 1)` where none was seen once;
*   other states h, with suffix h': `p(w | h) = (c(hw) + mu * p(w | h')) / (c(h) + mu)`, so the failure arc costs `mu / (c(h) + mu)`.

Probabilities of the known words and the unknown one add up to one in every state.
"""

from __future__ import annotations

import struct
import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_dir, stored
from .textarrow import coded, hashed, lower_table, mixed, pieces, remap, split_words

END = np.uint64(0x9E3779B97F4A7C15)  # the name of the token that ends a text

BLOCKS = "block long, n_tokens long, doc_ids array<long>, train array<boolean>, at binary, names binary, codes binary"
SLICES = "size int, slice int, block long, keys binary, counts binary"
TOTALS = "block long, size int, slice int, places binary, totals binary, tokens long, words long, once long, twice long"
SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def pack(values: np.ndarray) -> bytes:
    """Integers as planes of bytes, lowest first, compressed: high planes are mostly zero."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()
    return struct.pack("<Q", len(planes)) + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(data: bytes, dtype) -> np.ndarray:
    size, (total,) = np.dtype(dtype).itemsize, struct.unpack_from("<Q", data)
    planes = pa.decompress(memoryview(data)[8:], decompressed_size=total, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def pack_ascending(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_ascending(data: bytes, dtype) -> np.ndarray:
    return np.cumsum(unpack(data, dtype), dtype=dtype)


def encode_block(batch: pa.RecordBatch, block: int) -> pa.RecordBatch:
    """A block's row: its texts as word codes, an end token after each. Codes are places in the ascending names of the block's words."""
    flat, at = split_words(remap(batch.column("text"), lower_table()))
    code, words = coded(flat)
    names, place = np.unique(mixed(np.concatenate([[END], hashed(words)])), return_inverse=True)
    codes = np.insert(place[1:][code], at[1:], place[0])
    at = at + np.arange(len(at))
    whole = np.array([0, batch.num_rows], np.int32)
    one = lambda x, t: pa.array([x], t)
    return pa.RecordBatch.from_arrays(
        [
            one(block, pa.int64()), one(len(codes), pa.int64()), pa.ListArray.from_arrays(whole, batch.column("doc_id")), pa.ListArray.from_arrays(whole, batch.column("train")),
            one(pack_ascending(at.astype(np.uint32)), pa.binary()), one(pack_ascending(names), pa.binary()), one(pack(codes.astype(np.uint32)), pa.binary()),
        ],
        ["block", "n_tokens", "doc_ids", "train", "at", "names", "codes"],
    )


@dataclass
class Grams:
    """Distinct n-grams of one length in a block."""

    keys: np.ndarray  # ascending names
    first: np.ndarray  # a place where each ends
    index: np.ndarray  # for each place its n-gram, -1 where the text is too short
    counts: np.ndarray  # training occurrences in the block


class Block:
    """A decoded block with its n-grams up to some length."""

    def __init__(self, row: dict, order: int):
        self.at, names, self.codes = unpack_ascending(row["at"], np.uint32).astype(np.int64), unpack_ascending(row["names"], np.uint64), unpack(row["codes"], np.uint32).astype(np.int64)
        size = np.diff(self.at)
        train = np.repeat(np.array(row["train"], bool), size)
        depth = np.arange(len(self.codes)) - np.repeat(self.at[:-1], size)
        self.n_words, self.grams = len(names), []
        key = name = names[self.codes]
        for k in range(1, order + 1):
            if k == 1:
                first = np.empty(len(names), np.int64)
                first[self.codes[::-1]] = np.arange(len(self.codes))[::-1]
                self.grams.append(Grams(names, first, self.codes, np.bincount(self.codes[train], minlength=len(names))))
                continue
            with np.errstate(over="ignore"):
                key = mixed(np.concatenate([[np.uint64(0)], key[:-1]]) * np.uint64(0xD1B54A32D192ED03) + name + np.uint64(k))
            place = np.flatnonzero(depth >= k - 1)
            keys, first, inverse = np.unique(key[place], return_index=True, return_inverse=True)
            index = np.full(len(key), -1)
            index[place] = inverse
            self.grams.append(Grams(keys, place[first] if len(place) else first, index, np.bincount(inverse[train[place]], minlength=len(keys))))

    def elsewhere(self, k: int, shared: np.ndarray) -> np.ndarray:
        """Which n-grams of length k other blocks may have, given which of length k - 1 they have."""
        below, end = self.grams[k - 2], self.grams[k - 1].first
        return shared[below.index[end - 1]] & shared[below.index[end]] if len(end) else np.zeros(0, bool)


def slice_bounds(keys: np.ndarray, slices: int) -> np.ndarray:
    """First places of equal slices of the hash space in ascending keys."""
    edges = [np.uint64((i << 64) // slices) for i in range(slices)]
    return np.append(np.searchsorted(keys, np.array(edges, np.uint64)), len(keys))


def sliced(block: int, k: int, keys: np.ndarray, counts: np.ndarray, slices: int) -> pa.RecordBatch:
    """A block's n-grams of one length, a row a slice."""
    ends = slice_bounds(keys, slices)
    out = [(k, j, block, pack_ascending(keys[a:b]), pack(counts[a:b].astype(np.uint32))) for j, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if b > a]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], ["size", "slice", "block", "keys", "counts"])


def add_up(table: pa.Table) -> pa.Table:
    """Totals of one slice. Back to each block go those of the n-grams that other blocks sent too; one row more tells how many words and
    tokens there are."""
    size, part = table.column("size")[0].as_py(), table.column("slice")[0].as_py()
    blocks = table.column("block").to_pylist()
    keys = [unpack_ascending(x.as_py(), np.uint64) for x in table.column("keys")]
    counts = np.concatenate([unpack(x.as_py(), np.uint32) for x in table.column("counts")])
    length = [len(x) for x in keys]
    every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    del keys
    total = np.bincount(inverse, weights=counts, minlength=len(every)).astype(np.int64)
    several = np.bincount(inverse, minlength=len(every)) > 1
    rows, start = [], 0
    for block, n in zip(blocks, length):
        mine = inverse[start : start + n]
        start += n
        place = np.flatnonzero(several[mine])
        if len(place):
            rows.append((block, size, part, pack_ascending(place.astype(np.uint32)), pack(total[mine[place]].astype(np.uint64)), None, None, None, None))
    if size == 1:
        rows.append((None, size, part, None, None, int(total.sum()), int((total > 0).sum()), int((total == 1).sum()), int((total == 2).sum())))
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 4]
    names = [x.split()[0] for x in TOTALS.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def returned(table: pa.Table, k: int, sent: np.ndarray, keys: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray]:
    """Places, among a block's n-grams of length k, of those that came back, and their totals; `sent` are the places of those sent."""
    ends = slice_bounds(keys[sent], slices)
    at, total = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size, part, places, totals in zip(*(table.column(c) for c in ("size", "slice", "places", "totals"))):
        if size.as_py() == k:
            at.append(sent[ends[part.as_py()] + unpack_ascending(places.as_py(), np.uint32).astype(np.int64)])
            total.append(unpack(totals.as_py(), np.uint64).astype(np.int64))
    return np.concatenate(at), np.concatenate(total)


def totals_of(block: Block, table: pa.Table, order: int, slices: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Totals of a block's n-grams of each length up to `order`, and which of the longest other blocks have."""
    out, shared = [], np.zeros(0, bool)
    for k in range(1, order + 1):
        g = block.grams[k - 1]
        sent = np.arange(len(g.keys)) if k < 3 else np.flatnonzero(block.elsewhere(k, shared))
        at, total = returned(table, k, sent, g.keys, slices)
        out.append(g.counts.copy())
        out[-1][at] = total
        shared = np.zeros(len(g.keys), bool)
        shared[at] = True
    return out, shared


class Automaton:
    """States, arcs and failure arcs that a block's texts can visit. State 0 is the root."""

    def __init__(self, block: Block, totals: list[np.ndarray], tokens: int, words: int, once: int, twice: int, mu: float):
        order, n_words = len(block.grams), block.n_words
        # Where no word was seen once, a little is kept for what was never seen.
        discount = once / (once + 2 * max(twice, 1)) if once else 1 / (words + 1)
        self.n_words, self.unknown = n_words, float(np.log10(discount * words / tokens)) if tokens else 0.0
        offset = np.cumsum([1] + [len(g.keys) for g in block.grams])
        self.fail, self.cost = np.zeros(offset[order - 1], np.int64), np.zeros(offset[order - 1])
        arcs, weights, after, lower = [], [], [], None
        for k, (g, total) in enumerate(zip(block.grams, totals), 1):
            seen = np.flatnonzero(total > 0)
            end, p = g.first[seen], np.zeros(len(g.keys))
            if k == 1:
                state, suffix = np.zeros(len(seen), np.int64), np.zeros(len(seen), np.int64)
                p[seen] = (total[seen] - discount) / tokens
            else:
                below = block.grams[k - 2]
                context, short = below.index[end - 1], below.index[end]
                state, suffix = offset[k - 2] + context, offset[k - 2] + short
                p[seen] = (total[seen] + mu * lower[short]) / (totals[k - 2][context] + mu)
            if k < order:
                self.fail[offset[k - 1] + seen] = suffix
                self.cost[offset[k - 1] + seen] = np.log10(mu / (total[seen] + mu))
            arcs.append(state * n_words + block.codes[end])
            weights.append(np.log10(p[seen]))
            after.append(offset[k - 1] + seen if k < order else suffix)
            lower = p
        arcs = np.concatenate(arcs)
        by = np.argsort(arcs)
        self.arcs, self.weights, self.after = np.append(arcs[by], np.iinfo(np.int64).max), np.append(np.concatenate(weights)[by], 0.0), np.append(np.concatenate(after)[by], 0)

    def step(self, state: np.ndarray, word: np.ndarray, total: np.ndarray) -> None:
        """Read a word in each of some states: adds to `total` and moves `state` in place, over failure arcs where it must."""
        left = np.arange(len(state))
        while len(left):
            key = state[left] * self.n_words + word[left]
            at = np.searchsorted(self.arcs, key)
            hit = self.arcs[at] == key
            done = left[hit]
            total[done] += self.weights[at[hit]]
            state[done] = self.after[at[hit]]
            left = left[~hit]
            lost = left[state[left] == 0]
            total[lost] += self.unknown
            left = left[state[left] != 0]
            total[left] += self.cost[state[left]]
            state[left] = self.fail[state[left]]

    def read(self, codes: np.ndarray, at: np.ndarray, order: int, stretch: int = 512) -> np.ndarray:
        """Log-probability of each text, left to right. All texts advance side by side; long ones are read in stretches, each begun in the
        state that the order - 1 words before it lead to."""
        size = np.diff(at)
        parts = -(-size // stretch)
        owner = np.repeat(np.arange(len(size)), parts)
        begin = at[owner] + (np.arange(len(owner)) - (np.cumsum(parts) - parts)[owner]) * stretch
        length = np.minimum(at[owner + 1] - begin, stretch)
        by = np.argsort(-length, kind="stable")
        owner, begin, length = owner[by], begin[by], length[by]
        state, total = np.zeros(len(owner), np.int64), np.zeros(len(owner))
        for back in range(order - 1, 0, -1):
            warm = np.flatnonzero(begin - back >= at[owner])
            s = state[warm]
            self.step(s, codes[begin[warm] - back], np.zeros(len(warm)))
            state[warm] = s
        for t in range(int(length.max(initial=0))):
            n = int(np.searchsorted(-length, -t))
            self.step(state[:n], codes[begin[:n] + t], total[:n])
        return np.bincount(owner, weights=total, minlength=len(size))


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """`df` as a table in the shared folder, dealt to buckets by `key`, so that a later grouping by it moves nothing."""
    spark, name = df.sparkSession, f"lm_blocks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def lm_scores(docs: DataFrame, order: int = 3, mu: float = 8.0, block_bytes: int = 4 << 20, slice_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text", train_col: str = "train") -> DataFrame:
    """One row per row of `docs`: `doc_id, n_tokens, n_known, train_tokens, base_score, score` (logarithms to base 10).

    The model learns from the rows whose `train_col` is true and scores all rows, whole texts. Tokens are words between ASCII white
    space, A-Z lower-cased, and one end. A null text is an empty one: its end is its only token. `n_known` tokens stand in the training
    rows. `base_score` is that of add-one smoothed words. Without training rows every word is the unknown one, with probability one.
    Ids may repeat or be null and other columns are ignored.
    """

    def encode(batches):
        part, seq = TaskContext.get().partitionId(), 0
        for batch in pieces(batches, "text", block_bytes):
            yield encode_block(batch, part << 32 | seq)
            seq += 1

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(train_col), F.lit(False)).alias("train"))
    blocks = bucketed(rows.mapInArrow(encode, BLOCKS), "block")
    tokens = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    slices = max(1, -(-tokens * 6 // slice_bytes))
    coded_only = blocks.select("block", "train", "at", "names", "codes")

    def cut(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # one block in memory at a time
                row = batch.slice(i, 1).to_pylist()[0]
                for k, g in enumerate(Block(row, min(order, 2)).grams, 1):
                    yield sliced(row["block"], k, g.keys, g.counts, slices)

    def added(parts: DataFrame) -> DataFrame:
        return stored(parts.groupBy("size", "slice").applyInArrow(add_up, TOTALS), "lm-totals")

    totals = added(coded_only.mapInArrow(cut, SLICES))
    known = totals.where("block is null").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "words", "once", "twice"))).first()
    tables = [totals.where("block is not null").select("block", "size", "slice", "places", "totals")]

    def longer(k: int):
        def cut_more(left: pa.Table, right: pa.Table) -> pa.Table:
            row = left.to_pylist()[0]
            block = Block(row, k)
            sent, g = block.elsewhere(k, totals_of(block, right, k - 1, slices)[1]), block.grams[k - 1]
            return pa.Table.from_batches([sliced(row["block"], k, g.keys[sent], g.counts[sent], slices)])

        return cut_more

    for k in range(3, order + 1):
        # What other blocks have of length k - 1 depends on the lengths before only where those were left out.
        so_far = reduce(DataFrame.union, tables).where("size >= 2")
        parts = coded_only.groupBy("block").cogroup(so_far.groupBy("block")).applyInArrow(longer(k), SLICES)
        tables.append(added(parts).select("block", "size", "slice", "places", "totals"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        block = Block(row, order)
        total = totals_of(block, right, order, slices)[0]
        n_tokens, n_words = known[0], known[1]
        automaton = Automaton(block, total, *known, mu)
        c = total[0][block.codes]
        base = np.add.reduceat(np.log10((c + 1) / (n_tokens + n_words + 1)), block.at[:-1])
        return pa.table({
            "doc_id": pa.array(row["doc_ids"], pa.int64()), "n_tokens": np.diff(block.at), "n_known": np.add.reduceat((c > 0).astype(np.int64), block.at[:-1]),
            "base_score": base, "score": automaton.read(block.codes, block.at, order),
        })

    found = blocks.groupBy("block").cogroup(reduce(DataFrame.union, tables).groupBy("block")).applyInArrow(score, SCORES)
    return found.select("doc_id", "n_tokens", "n_known", F.lit(known[0]).cast("long").alias("train_tokens"), "base_score", "score")
