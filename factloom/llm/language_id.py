"""Language identification, word first.

A known word scores by its log frequency in each language. An unseen word is read in character n-grams: at each place the longest known
one, from `max_n` characters down to one, gives its log frequencies. A text's score in a language is the sum over its words.

The model is fitted on at most about `sample_docs` labelled documents of each language, chosen by a hash of their id and text; this
parameter bounds its size. All words and n-grams of these documents are kept, by 64-bit names. Every document is scored, over its whole
text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrow import coded, hashed, mixed, pieces, row_of, split_words

UNKNOWN = "und"


def letters_only(texts: pa.Array) -> pa.Array:
    """Lower case; what is no letter or mark becomes a space."""
    return pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{M}]+", " ")


def marked(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Characters (code points) of words with their ends marked, one word after another, and the words' first places."""
    flat = np.frombuffer("".join(f"^{w}$" for w in words.to_pylist()).encode("utf-32-le"), np.uint32)
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    return flat, np.concatenate([[0], np.cumsum(size)])


def gram_names(chars: np.ndarray, at: np.ndarray, max_n: int) -> tuple[np.ndarray, np.ndarray]:
    """For n from 1 on, a row: the name of the n-gram that begins at each place, and whether it ends within the word."""
    left = np.repeat(at[1:], np.diff(at)) - np.arange(len(chars))
    padded = np.concatenate([chars.astype(np.uint64), np.zeros(max_n, np.uint64)])
    name, names = np.zeros(len(chars), np.uint64), []
    for n in range(max_n):
        with np.errstate(over="ignore"):
            name = mixed(name * np.uint64(0xD1B54A32D192ED03) + padded[n : n + len(chars)] + np.uint64(n + 1))
        names.append(name)
    return np.array(names).reshape(max_n, len(chars)), left[None, :] >= np.arange(1, max_n + 1)[:, None]


def _places(names: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where names stand in an ascending table, -1 where they don't."""
    if not len(table):
        return np.full(names.shape, -1)
    at = np.minimum(np.searchsorted(table, names), len(table) - 1)
    return np.where(table[at] == names, at, -1)


@dataclass
class LanguageModel:
    """Log frequencies of words and n-grams, by their ascending names, a column for each language in ascending order."""

    langs: list[str]
    words: np.ndarray
    word_scores: np.ndarray
    grams: np.ndarray
    gram_scores: np.ndarray
    floor: np.ndarray
    max_n: int

    def unseen(self, words: pa.Array) -> np.ndarray:
        """Scores of words that the model lacks: the mean over their places of the longest known n-gram's log frequencies. A word's places
        are its start mark and its characters; at the mark only n-grams that go on into the word count."""
        chars, at = marked(words)
        names, inside = gram_names(chars, at, self.max_n)
        found = np.full(len(chars), -1)
        for n in range(self.max_n - 1, -1, -1):
            open_ = np.flatnonzero((found < 0) & inside[n])
            found[open_] = _places(names[n][open_], self.grams)
        start, lone = at[:-1], _places(names[0][at[:-1]], self.grams)
        read = np.ones(len(chars), bool)
        read[at[1:] - 1] = False
        read[start[(found[start] < 0) | (found[start] == lone)]] = False
        owner = row_of(at)[read]
        out, places = np.empty((len(words), len(self.langs))), np.maximum(np.bincount(owner, minlength=len(words)), 1)
        for k in range(len(self.langs)):
            each = np.where(found >= 0, self.gram_scores[found, k] if len(self.grams) else 0.0, self.floor[k])
            out[:, k] = np.bincount(owner, weights=each[read], minlength=len(words)) / places
        return out

    def scores(self, words: pa.Array) -> np.ndarray:
        """A row for each (distinct) word, a column for each language."""
        at = _places(hashed(words), self.words)
        out = np.empty((len(words), len(self.langs)))
        out[at >= 0] = self.word_scores[at[at >= 0]]
        new = np.flatnonzero(at < 0)
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            out[part] = self.unseen(words.take(pa.array(part)))
        return out


def _log_frequencies(counts: np.ndarray, totals: np.ndarray, smoothing: float) -> np.ndarray:
    return np.log((counts + smoothing) / (totals + smoothing * (len(counts) + 1)))


def fit(labelled: DataFrame, sample_docs: int = 6_000, max_n: int = 4, smoothing: float = 0.5) -> LanguageModel | None:
    """Learn from `labelled` (doc_id, text, lang); rows without text or lang teach nothing. None where nothing is left."""
    rows = labelled.where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    # Ids and texts decide, so that copies of one text under many ids stand for as many rows as they are. A rare language keeps all.
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, int(min(1.0, sample_docs / sizes[k]) * (1 << 30)))])
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.element_at(share, F.col("lang")))

    def count(batches):
        for batch in pieces(batches, "text"):
            flat, at = split_words(letters_only(batch.column("text")))
            code, words = coded(flat)
            lang = pc.index_in(batch.column("lang"), value_set=pa.array(langs)).to_numpy().astype(np.int64)[row_of(at)]
            pair, n = np.unique(code * len(langs) + lang, return_counts=True)
            word, lang = pair // len(langs), pair % len(langs)
            chars, first = marked(words)
            names, inside = gram_names(chars, first, max_n)
            owner = row_of(first)
            # The distinct n-grams of each distinct word, then their counts by language.
            place = [np.flatnonzero(inside[k]) for k in range(max_n)]
            gram = np.concatenate([names[k][place[k]] for k in range(max_n)])
            kind = np.concatenate([np.full(len(place[k]), k + 1) for k in range(max_n)])
            of = np.concatenate([owner[p] for p in place])
            every, slot = np.unique(gram, return_inverse=True)
            kinds = np.zeros(len(every), np.int64)
            kinds[slot] = kind
            parts = [(np.zeros(len(word), np.int64), hashed(words)[word].view(np.int64), lang, n)]
            for k in range(len(langs)):
                mine = lang == k
                times = np.bincount(word[mine], weights=n[mine], minlength=len(words))
                total = np.bincount(slot, weights=times[of], minlength=len(every)).astype(np.int64)
                some = np.flatnonzero(total)
                parts.append((kinds[some], every[some].view(np.int64), np.full(len(some), k), total[some]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in parts]).astype(np.int64)) for i in range(4)], ["kind", "name", "lang", "n"])

    counts = chosen.select("text", "lang").mapInArrow(count, "kind long, name long, lang long, n long")
    by = [F.sum(F.when(F.col("lang") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(len(langs))]
    # As large as the bounded sample's vocabulary.
    table = counts.groupBy("kind", "name").agg(*by).toArrow()
    kind, name = table["kind"].to_numpy(), table["name"].to_numpy().view(np.uint64)
    each = np.stack([table[f"n{k}"].to_numpy().astype(float) for k in range(len(langs))], 1)

    def part(use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(name[use])
        m = each[use]
        return name[use][order], _log_frequencies(m, m.sum(0), smoothing)[order]

    words, word_scores = part(kind == 0)
    sized = [part(kind == k) for k in range(1, max_n + 1)]
    grams, gram_scores = np.concatenate([a for a, _ in sized]), np.concatenate([b for _, b in sized])
    order = np.argsort(grams)
    signs = each[kind > 0]
    floor = np.log(smoothing / (signs.sum(0) + smoothing * (len(signs) + 1)))
    return LanguageModel(langs, words, word_scores.astype(np.float32), grams[order], gram_scores[order].astype(np.float32), floor, max_n)


def identify(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: `doc_id, lang_pred, score`.

    `lang_pred` is the language of the largest score, the first in ascending order among equals; `und` where the text is null or has no
    letter, or where there is no model. `score` is the share of the best language among all (softmax of the sums), 0 for `und`.
    Ids may repeat or be null and other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        model = sent.value
        for batch in pieces(batches, "text"):
            flat, at = split_words(letters_only(batch.column("text")))
            some = pc.fill_null(pc.match_substring_regex(batch.column("text"), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            code, words = coded(flat)
            if model is None:
                best, share, names = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), [UNKNOWN]
            else:
                by_word, names = model.scores(words), model.langs
                total = np.empty((batch.num_rows, len(names)))
                owner = row_of(at)
                for k in range(len(names)):
                    total[:, k] = np.bincount(owner, weights=by_word[:, k][code], minlength=batch.num_rows)
                best = total.argmax(1)
                share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            pred = pa.array(np.array(names, object)[best], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.if_else(pa.array(some), pred, UNKNOWN), pa.array(np.where(some, share, 0.0))], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(score, "doc_id long, lang_pred string, score double")
