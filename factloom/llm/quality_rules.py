"""Quality rules: simple counts of each text, and lines that too many documents of one host share.

Lines are normalised (lower case, digits as 0, white space as one space) and hashed. A line that stands in more than `max_docs` documents
of a host is boilerplate there; all its occurrences go, and a document that loses too much is depleted and rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored
from .textarrow import coded, hashed, mixed, pieces, row_of, split_words, windows

SYMBOLS = "#*$%&|<>"

_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in SYMBOLS])
_INNER = (np.arange(256) & 0xC0) == 0x80  # second and later bytes of a code point

SCHEMA = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<hash:bigint,words:int>>"


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return run[offsets[1:]] - run[offsets[:-1]]


def word_counts(texts: pa.Array) -> np.ndarray:
    """Words of each text: places where a byte that is no space follows a space or the start."""
    texts = texts.take(pa.array(np.arange(len(texts))))
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[: len(texts) + 1]
    solid = ~_SPACE[np.frombuffer(data, np.uint8)[: offsets[-1]]] if data is not None else np.zeros(0, bool)
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    begins = offsets[:-1][np.diff(offsets) > 0]
    start[begins] = solid[begins]
    return _per_row(start, offsets)


def repeated_words(hashes: np.ndarray, at: np.ndarray, n: int = 5) -> np.ndarray:
    """Words of each row that stand in an n-word window found twice or more in that row."""
    full = np.diff(at) >= n
    win, first = windows(hashes, at, n)
    row = row_of(first)
    key = mixed(win ^ mixed(row.astype(np.uint64)))
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    again = (count[inverse] > 1) & full[row] if len(key) else np.zeros(0, bool)
    place = (at[:-1][row] + np.arange(len(row)) - first[:-1][row])[again]
    depth = np.zeros(len(hashes) + n + 1, np.int64)
    np.add.at(depth, place, 1)
    np.add.at(depth, place + n, -1)
    return _per_row(np.cumsum(depth)[: len(hashes)] > 0, at)


def normalised(lines: pa.Array) -> pa.Array:
    """Lines as they are compared."""
    spaced = pc.replace_substring_regex(pc.utf8_lower(lines), r"[\t-\r ]+", " ")
    return pc.utf8_trim(pc.replace_substring_regex(spaced, r"[0-9]", "0"), " ")


def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Counts and lines of each row of a batch (doc_id, host, text)."""
    texts = pc.fill_null(batch.column("text").cast(pa.string()), "").take(pa.array(np.arange(batch.num_rows)))
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[: len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[: offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    flat, at = split_words(texts)
    code, words = coded(flat)
    lists = pc.split_pattern(texts, "\n")
    rows, lines = row_of(lists.offsets.to_numpy()), lists.flatten()
    code_l, raw = coded(lines)
    n_words = word_counts(raw)
    solid = n_words[code_l] > 0
    rows, code_l = rows[solid], code_l[solid]
    distinct = np.bincount(np.unique(rows * (len(raw) + 1) + code_l) // (len(raw) + 1), minlength=len(texts))
    dup = np.bincount(rows, minlength=len(texts)) - distinct
    # Lines that are equal once normalised count together.
    code_n, norm = coded(normalised(raw))
    name = hashed(norm).astype(np.int64)
    key = rows * (len(norm) + 1) + code_n[code_l]
    pair, inverse = np.unique(key, return_inverse=True)
    total = np.bincount(inverse, weights=n_words[code_l], minlength=len(pair)).astype(np.int32)
    line = pa.StructArray.from_arrays([pa.array(name[pair % (len(norm) + 1)]), pa.array(total)], ["hash", "words"])
    ends = np.searchsorted(pair, np.arange(len(texts) + 1) * (len(norm) + 1)).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"), batch.column("host"), pa.array(np.diff(at)), pa.array(_per_row(~_SPACE[data] & ~_INNER[data], offsets)),
            pa.array(_per_row(_SYMBOL[data], offsets)), pa.array(dup.astype(np.int64)), pa.array(repeated_words(hashed(words)[code], at)),
            pa.ListArray.from_arrays(pa.array(ends), line),
        ],
        ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"],
    )


def quality_rules(
    docs: DataFrame, max_docs: int = 20, min_left: float = 0.5, min_words: int = 10, max_repeat_percent: int = 20,
    id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
) -> DataFrame:
    """One row per row of `docs`: `doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words, kept`.

    `base_failed`: under `min_words` words, or over `max_repeat_percent` percent of them in repeated 5-word windows. `removed_words`: words
    in lines that more than `max_docs` rows of the same host have (a row counts a line once; rows of a null host are one host). `kept`: not
    failed, and at least `min_words` words and the share `min_left` of all words left. Each row counts as a document, also where ids
    repeat or are null; a null text has no words; an empty table gives an empty one; other columns are ignored.
    """

    def counted(batches):
        for batch in pieces(batches, "text"):
            yield measure(batch)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"))
    rows = stored(rows.mapInArrow(counted, SCHEMA).withColumn("row", F.monotonically_increasing_id()), "quality-rows")
    lines = rows.select("row", F.coalesce("host", F.lit("\0")).alias("host"), F.inline("lines"))
    common = lines.groupBy("host", "hash").agg(F.count("*").alias("docs")).where(F.col("docs") > max_docs).select("host", "hash")
    lost = lines.join(common, ["host", "hash"], "left_semi").groupBy("row").agg(F.sum("words").alias("removed_words"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    return (
        rows.drop("lines", "host")
        .join(lost, "row", "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "removed_words",
            (~failed & (left >= min_words) & (left >= min_left * F.col("n_words"))).alias("kept"),
        )
    )
