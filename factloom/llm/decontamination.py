"""Benchmark passages in documents, found in an FM-index of each shard of documents.

A shard is a run of documents of one partition. Its words are indexed once: suffix array, Burrows-Wheeler transform in a wavelet matrix,
and every 8th suffix position. All test phrases of a block go through one backward search; the rows found are walked back to a sampled
position. Words that no phrase has can't be in an occurrence: a run of them is one break, so the index covers the phrases' vocabulary
only. Documents stay where they are; nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrow import alnum_table, pieces, remap, row_of, split_words

#: Codes below this are breaks between runs of known words. They differ, so that copies of a text part after a few words.
BREAKS = 1024


class WaveletMatrix:
    """Ranks and symbols of a sequence, a bit a level."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = max(1, int(n_symbols - 1).bit_length())
        self.words, self.ones, self.zeros = [], [], []
        left = symbols
        for level in range(self.levels):
            bit = (left >> (self.levels - 1 - level)) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            words = np.concatenate([packed, np.zeros(8 - len(packed) % 8, np.uint8)]).view(np.uint64)
            self.words.append(words)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]))
            self.zeros.append(int(len(left) - bit.sum()))
            left = np.concatenate([left[bit == 0], left[bit == 1]])
        self.first = self.rank(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def ranked(self, level: int, i: np.ndarray) -> np.ndarray:
        """Ones of a level before place i."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones[level][w] + np.bitwise_count(self.words[level][w] & mask)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where place i comes to on the way of `symbol`; less `first[symbol]` it is how often the symbol stands before i."""
        for level in range(self.levels):
            one = self.ranked(level, i)
            i = np.where((symbol >> (self.levels - 1 - level)) & 1, self.zeros[level] + one, i - one)
        return i

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at places i, and how often each stands before."""
        symbol = np.zeros(len(i), np.int64)
        for level in range(self.levels):
            one = self.ranked(level, i)
            bit = ((self.words[level][i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
            i = np.where(bit, self.zeros[level] + one, i - one)
            symbol = symbol << 1 | bit
        return symbol, i - self.first[symbol]


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by doubling the length that they are sorted by."""
    n, bits = len(symbols), max(1, int(symbols.max(initial=0)).bit_length())
    h = max(1, 62 // bits)
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(h, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(h):
        key = key << bits | padded[k : k + n]
    while True:
        order = np.argsort(key)
        fresh = np.concatenate([[0], (np.diff(key[order]) != 0).astype(np.int64)]) if n else key
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        if not n or rank[order[-1]] == n - 1:
            return order
        key = rank * (n + 1) + np.concatenate([rank[h:] + 1, np.zeros(min(h, n), np.int64)])
        h *= 2


class FMIndex:
    """Index of a sequence of symbols whose last one, 0, stands nowhere else."""

    def __init__(self, symbols: np.ndarray, n_symbols: int, sample: int = 8):
        order = suffix_array(symbols)
        self.n = len(symbols)
        self.wavelet = WaveletMatrix(symbols[order - 1], n_symbols)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=n_symbols))])
        self.sampled = order % sample == 0
        self.nth = np.cumsum(self.sampled) - 1
        self.places = order[self.sampled]

    def search(self, phrases: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [begin, end) of the suffixes that begin with each phrase; phrases stand at the right of their rows."""
        begin, end = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        alive = np.arange(len(phrases))
        for back in range(1, phrases.shape[1] + 1):
            alive = alive[(size[alive] >= back) & (begin[alive] < end[alive])]
            c = phrases[alive, -back]
            at = self.smaller[c] - self.wavelet.first[c]
            begin[alive] = at + self.wavelet.rank(c, begin[alive])
            end[alive] = at + self.wavelet.rank(c, end[alive])
        return begin, end

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of the suffixes at some rows: back, symbol by symbol, to a sampled one."""
        out, left = np.empty(len(rows), np.int64), np.arange(len(rows))
        rows, steps = rows.copy(), 0
        while len(left):
            done = self.sampled[rows]
            out[left[done]] = self.places[self.nth[rows[done]]] + steps
            left, rows = left[~done], rows[~done]
            symbol, before = self.wavelet.access(rows)
            rows, steps = self.smaller[symbol] + before, steps + 1
        return out


class Phrases:
    """Distinct word windows of some items, as codes from BREAKS on, and the items of each."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        flat, at = split_words(remap(pa.array([x[1] for x in items], pa.string()), alnum_table()))
        words = flat.dictionary_encode()
        self.vocabulary, codes = words.dictionary, words.indices.to_numpy().astype(np.int64) + BREAKS
        found: dict[tuple, set] = {}
        for (item, _), a, b in zip(items, at[:-1], at[1:]):
            for i in range(a, max(b - n, a) + 1 if b > a else a):
                found.setdefault(tuple(codes[i : min(i + n, b)].tolist()), set()).add(item)
        self.size = np.array([len(k) for k in found], np.int64)
        self.codes = np.zeros((len(found), n), np.int64)
        for i, k in enumerate(found):
            self.codes[i, n - len(k) :] = k
        self.items = pa.array([sorted(v) for v in found.values()], pa.list_(pa.int64()))

    def occurrences(self, flat: pa.Array, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, phrase) of all occurrences in the words of a shard."""
        code = pc.index_in(flat, value_set=self.vocabulary)
        place = np.flatnonzero(code.is_valid().to_numpy(zero_copy_only=False))
        if not len(place) or not len(self.size):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        row = row_of(at)[place]
        cut = np.flatnonzero((np.diff(place) != 1) | (np.diff(row) != 0)) + 1
        symbols = np.insert(code.take(pa.array(place)).to_numpy(zero_copy_only=False).astype(np.int64) + BREAKS, cut, place[cut] * 40503 % (BREAKS - 1) + 1)
        word = np.insert(place, cut, -1)
        index = FMIndex(np.append(symbols, 0), BREAKS + len(self.vocabulary))
        begin, end = index.search(self.codes, self.size)
        count = np.maximum(end - begin, 0)
        rows = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return word[index.locate(rows)], np.repeat(np.arange(len(count)), count)


def mark(batch: pa.RecordBatch, phrases: Phrases) -> pa.RecordBatch:
    """Add a block's hits to the spans and items of a batch (doc_id, text, spans, items)."""
    flat, at = split_words(remap(batch.column("text"), alnum_table()))
    first, phrase = phrases.occurrences(flat, at)
    depth = np.zeros(len(flat) + 1, np.int64)
    np.add.at(depth, first, 1)
    np.add.at(depth, first + phrases.size[phrase] if len(phrase) else first, -1)
    hit = np.cumsum(depth)[:-1] > 0
    rows, old = row_of(at), batch.column("spans")
    if len(old.flatten()):
        owner = np.repeat(np.arange(len(old)), pc.fill_null(pc.list_value_length(old), 0).to_numpy())
        for r, s in zip(owner.tolist(), old.flatten().to_pylist()):
            hit[at[r] + s["first"] : at[r] + s["end"]] = True
    before = np.concatenate([[False], hit[:-1] & (rows[1:] == rows[:-1])]) if len(hit) else hit
    after = np.concatenate([hit[1:] & (rows[1:] == rows[:-1]), [False]]) if len(hit) else hit
    begin, end = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after) + 1
    owner = rows[begin]
    spans = pa.StructArray.from_arrays([pa.array((begin - at[owner]).astype(np.int32)), pa.array((end - at[owner]).astype(np.int32))], ["first", "end"])
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(at))).astype(np.int32)), spans)
    named = pc.list_value_length(phrases.items).to_numpy(zero_copy_only=False).astype(np.int64)
    if len(phrase):
        pairs = np.unique(np.stack([rows[first], phrase], 1), axis=0)
        reps = named[pairs[:, 1]]
        doc = np.repeat(pairs[:, 0], reps)
        item = phrases.items.take(pa.array(pairs[:, 1])).flatten().to_numpy()
    else:
        doc, item = np.zeros(0, np.int64), np.zeros(0, np.int64)
    known = batch.column("items")
    doc = np.concatenate([doc, np.repeat(np.arange(len(known)), pc.fill_null(pc.list_value_length(known), 0).to_numpy())])
    item = np.concatenate([item, known.flatten().to_numpy()])
    pairs = np.unique(np.stack([doc, item], 1), axis=0)
    items = pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs[:, 0], np.arange(len(at))).astype(np.int32)), pa.array(pairs[:, 1]))
    n_words, n_hit = np.diff(at), np.concatenate([[0], np.cumsum(hit)])
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), batch.column("text"), pa.array(n_words), pa.array(n_hit[at[1:]] - n_hit[at[:-1]]), spans, items],
        ["doc_id", "text", "n_words", "n_hit", "spans", "items"],
    )


def phrase_blocks(benchmark: DataFrame, n: int, block_bytes: int, item_col: str = "item_id", item_text_col: str = "text") -> list[Broadcast]:
    """The items in broadcasts of about `block_bytes` of text each, dealt by hash; one empty block for an empty benchmark."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).where("item is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = []
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()
        out.append(benchmark.sparkSession.sparkContext.broadcast([(r["item"], r["text"]) for r in rows]))
    return out


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, n: int = 10, block_bytes: int = 4 << 20, shard_bytes: int = 8 << 20,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """One row per row of `docs`: `doc_id, n_words, n_hit, spans, items`.

    Words are runs of ASCII letters and digits and of all other non-ASCII characters, ASCII lower-cased. A window is n consecutive words
    of an item, or the whole of a shorter one. `spans` are the merged word ranges [first, end) inside any occurrence of a window, `items`
    the ids of the items found, ascending. Null texts have no words; an item with a null id or without words is none; repeated items
    count once; an empty benchmark hits nothing. Ids may repeat or be null and other columns are ignored.

    The phrases reach the tasks in blocks of about `block_bytes` of item text, as many as the benchmark needs: its size is summed first.
    Each block is one more pass over the shards.
    """
    sent = phrase_blocks(benchmark, n, block_bytes, item_col, item_text_col)
    empty = F.array().cast("array<struct<first:int,end:int>>").alias("spans"), F.array().cast("array<bigint>").alias("items")
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *empty)
    schema = "doc_id long, text string, n_words long, n_hit long, spans array<struct<first:int,end:int>>, items array<bigint>"
    for b, block in enumerate(sent):
        last = b == len(sent) - 1

        def search(batches, block=block, last=last):
            phrases = Phrases(block.value, n)
            for batch in pieces(batches, "text", shard_bytes):
                found = mark(batch, phrases)
                yield found.drop_columns(["text"]) if last else found

        out = out.select("doc_id", "text", "spans", "items").mapInArrow(search, schema.replace("text string, ", "") if last else schema)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_bytes: int = 4 << 20, shard_bytes: int = 8 << 20, text_col: str = "text") -> DataFrame:
    """The rows of `docs` in which no window of the benchmark occurs, all their columns as they are."""
    for block in phrase_blocks(benchmark, n, block_bytes):

        def keep(batches, block=block):
            phrases = Phrases(block.value, n)
            for batch in pieces(batches, text_col, shard_bytes):
                flat, at = split_words(remap(batch.column(text_col), alnum_table()))
                first, _ = phrases.occurrences(flat, at)
                clean = np.ones(batch.num_rows, bool)
                clean[row_of(at)[first]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
