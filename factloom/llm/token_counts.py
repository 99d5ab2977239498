"""Token counts at every prefix, so that truncation and budgets need no second encoding.

A text is cut in front of every run of white space, where the tokenizer's pattern always parts it whatever follows. So the count of the
prefix of p characters is the tokens of the pieces before, plus the tokens of the beginning of one piece, and each distinct piece of a
batch is worked out once, at all its characters, by a recurrence over the vocabulary: the encoding of a prefix is that of a shorter one
and one more token, `count[p] = count[p - len(t)] + 1`, where t is the token that ends at p and that the model keeps apart from the last
token of the shorter prefix; there is always one.
"""

from __future__ import annotations

import array
import itertools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import PLAIN, PieceEncoder, encoder
from .textarrow import pieces

#: What Unicode calls white space, as the tokenizer's pattern does.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
RUN = re.compile(f"[{WHITE}]+")
#: The end of what is surely no white space, before what surely is.
CUT = r"([^\s\p{Z}\x{85}\x{0b}\x{0c}\x{1c}-\x{1f}])([ \n\t\r])"
#: Noncharacters, one of which marks the cuts of a batch.
MARKS = [chr(0xFDD0 + i) for i in range(32)]
#: The same cut where a text itself holds all marks.
CUT_BETWEEN = re.compile(r"(?<=\S)(?=[ \n\t\r])")
#: Pieces, and characters of pieces, that a worker remembers from batch to batch; beyond, it forgets the rare ones.
KEPT, KEPT_CHARS = 700_000, 16_000_000


class PrefixCounter:
    """Token counts of all beginnings of pieces."""

    def __init__(self, encode: PieceEncoder):
        self.encode, self.pairs = encode, {}
        self.known, self.pool, self.chars, self.seen = {}, np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.vocabulary = set(encode.tok.get_vocab())
        self.longest = max(map(len, self.vocabulary))
        self.special = re.compile("|".join(map(re.escape, sorted(encode.special, key=len, reverse=True))) or r"(?!)")

    def apart(self, a: str, b: str) -> bool:
        """Whether two tokens in a row are what their text encodes to."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 200_000:
                self.pairs.clear()
            known = self.pairs[a, b] = [t.value for t in self.encode.tok.model.tokenize(a + b)] == [a, b]
        return known

    def table(self, letters: str) -> list[int]:
        """Tokens of the beginnings of 1, 2, … letters of one unit of the pattern, in the letters of its bytes.

        At most places the last token begins where one of the whole unit's does, so that is tried first; then all that end there are."""
        vocabulary, pairs, longest = self.vocabulary, self.pairs, self.longest
        rows, begin = [(0, "")], 0
        for whole in [t.value for t in self.encode.tok.model.tokenize(letters)]:
            done, last = rows[begin]
            for p in range(begin + 1, begin + len(whole)):
                token = letters[begin:p]
                if token in vocabulary and (not begin or pairs.get((last, token)) or self.apart(last, token)):
                    rows.append((done + 1, token))
                    continue
                for start in range(max(0, p - longest), p):
                    token = letters[start:p]
                    if token in vocabulary and (not start or self.apart(rows[start][1], token)):
                        rows.append((rows[start][0] + 1, token))
                        break
            rows.append((done + 1, whole))
            begin += len(whole)
        return [c for c, _ in rows[1:]]

    def spelled(self, text: str) -> str:
        return text.encode().decode("latin-1").translate(self.encode.letters)

    def unit(self, text: str) -> list[int]:
        """Tokens of the beginnings of 1, 2, … characters of one unit of the pattern."""
        if text[0] == "'" and len(text) <= 3:  # perhaps an ending like 'll, whose beginnings are units of their own
            return [len(self.encode.tok.encode(text[:p], add_special_tokens=False).ids) for p in range(1, len(text) + 1)]
        count = self.table(self.spelled(text))
        return count if len(count) == len(text) else [count[b - 1] for b in itertools.accumulate(len(c.encode()) for c in text)]

    def plain(self, text: str) -> list[int]:
        """Tokens of the beginnings of a text without special tokens."""
        out, base, at = [], 0, 0
        for letters, _ in self.encode.tok.pre_tokenizer.pre_tokenize_str(text):
            size, left = at, len(letters)
            while left:
                left -= len(text[size].encode())
                size += 1
            out += [base + c for c in self.unit(text[at:size])]
            base, at = out[-1], size
        # A beginning that ends in white space has all of it as one unit; what follows decides how much stays in it.
        for run in RUN.finditer(text):
            before = out[run.start() - 1] if run.start() else 0
            out[run.start() : run.end()] = [before + c for c in self.unit(run.group())]
        return out

    def piece(self, text: str) -> list[int]:
        """Tokens of the beginnings of any text. Up to its last character, a special token is ordinary text."""
        out, base, at = [], 0, 0
        for found in self.special.finditer(text):
            part = self.plain(text[at : found.end() - 1])
            out += [base + c for c in part]
            before = found.start() - at
            base += (part[before - 1] if before else 0) + 1
            out.append(base)
            at = found.end()
        return out + [base + c for c in self.plain(text[at:])]

    def counts(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Counts at all characters of some distinct pieces, one after another, and how many characters each has."""
        out = array.array("i")
        for x in names:
            if found := PLAIN.fullmatch(x):
                word, mark = found.groups()
                each = self.unit(word)
                out.extend(each)
                if mark:
                    out.append(each[-1] + 1)
            else:
                out.extend(self.piece(x))
        return np.frombuffer(out, np.int32) if out else np.zeros(0, np.int32), np.array([len(x) for x in names], np.int64)

    def places(self, names: list[str]) -> np.ndarray:
        """Numbers of some distinct pieces; what is new is worked out."""
        if len(self.known) + len(names) > KEPT or len(self.pool) + sum(map(len, names)) > KEPT_CHARS:
            self.forget()
        known = self.known
        fresh = [x for x in names if x not in known]
        pool, chars = self.counts(fresh)
        known.update(zip(fresh, range(len(known), len(known) + len(fresh))))
        self.pool, self.chars = np.concatenate([self.pool, pool]), np.concatenate([self.chars, chars])
        self.seen = np.concatenate([self.seen, np.zeros(len(fresh), np.int64)])
        places = np.array([known[x] for x in names], np.int64)
        self.seen[places] += 1
        return places

    def forget(self) -> None:
        """Drop the pieces that one batch alone has had since the last time; all of them where the rest is over half of what may stay."""
        keep = np.flatnonzero(self.seen > 1)
        if len(keep) > KEPT // 2 or self.chars[keep].sum() > KEPT_CHARS // 2:
            keep = keep[:0]
        names, size = list(self.known), self.chars[keep]
        begin = (np.cumsum(self.chars) - self.chars)[keep]
        self.pool = self.pool[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        self.known, self.chars, self.seen = {names[i]: k for k, i in enumerate(keep.tolist())}, size, np.zeros(len(keep), np.int64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Counts at all characters of all texts in order, and the texts' first places."""
        mark = next((m for m in MARKS if not pc.any(pc.match_substring(texts, m)).as_py()), None)
        if mark is None and len(texts) > 1:  # in halves, down to the texts that hold all marks by themselves
            (one, at), (other, more) = self(texts[: len(texts) // 2]), self(texts[len(texts) // 2 :])
            return np.concatenate([one, other]), np.concatenate([at[:-1], at[-1] + more])
        if mark is None:
            lists = pa.array([CUT_BETWEEN.split(texts[0].as_py())])
        else:
            lists = pc.split_pattern(pc.replace_substring_regex(texts, CUT, rf"\1{mark}\2"), mark)
        flat, at = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        at = at - at[0]
        d = flat.dictionary_encode()
        code = self.places(d.dictionary.to_pylist())[d.indices.to_numpy()]
        pool, chars = self.pool, self.chars
        begin, size = np.cumsum(chars) - chars, chars[code]
        # Tokens of a piece: its count at its last character, none for an empty text.
        whole = np.where(chars > 0, pool[np.maximum(begin + chars - 1, 0)] if len(pool) else 0, 0)[code] if len(code) else np.zeros(0, np.int64)
        done = np.cumsum(whole) - whole
        head = done[np.minimum(at[:-1], max(len(done) - 1, 0))] if len(done) else np.zeros(len(at) - 1, np.int64)
        base = done - np.repeat(head, np.diff(at))
        ends = np.cumsum(size)
        place = np.repeat(begin[code] - (ends - size), size)
        place += np.arange(len(place))
        return pool[place] + np.repeat(base.astype(np.int32), size), np.concatenate([[0], ends])[at]


_counters: dict[str, PrefixCounter] = {}


def counter(tokenizer: str) -> PrefixCounter:
    """One for each Python worker and tokenizer file."""
    if tokenizer not in _counters:
        _counters[tokenizer] = PrefixCounter(encoder(tokenizer))
    return _counters[tokenizer]


def prefix_token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: `doc_id, n_bytes, prefix_tokens`; ids may repeat or be null, other columns are ignored.

    `prefix_tokens[p]` (from 0) is the exact number of tokens of the text's first p characters, white space, special tokens and long words
    included. A null or empty text has no bytes and one prefix, the empty one of 0 tokens. The tokenizer is a byte-level BPE file of the `tokenizers` library.
    """

    def count(batches):
        run = counter(tokenizer)
        for batch in pieces(batches, "text", 2 << 20):
            counts, at = run(pc.fill_null(batch.column("text"), ""))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64()), prefixes(counts, at)],
                ["doc_id", "n_bytes", "prefix_tokens"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, "doc_id long, n_bytes long, prefix_tokens array<int>")


def prefixes(counts: np.ndarray, at: np.ndarray) -> pa.Array:
    """Lists of the counts of all prefixes, the empty one first."""
    return pa.ListArray.from_arrays(pa.array((at + np.arange(len(at))).astype(np.int32)), pa.array(np.insert(counts, at[:-1], 0).astype(np.int32)))


def total_tokens(prefix_tokens: Column) -> Column:
    """Tokens of the whole text: the count of its last prefix."""
    return F.element_at(prefix_tokens, -1).cast("long")


def chars_within(prefix_tokens: Column, budget: int) -> Column:
    """Characters of the longest prefix that has at most `budget` (0 or more) tokens."""
    # Counts may fall from one character to the next, as when a word's last letter makes it one token. The empty prefix always fits.
    back = F.array_position(F.transform(F.reverse(prefix_tokens), lambda c: c <= budget), True)
    return F.when(total_tokens(prefix_tokens) <= budget, F.size(prefix_tokens) - 1).otherwise(F.size(prefix_tokens) - back).cast("long")


def tokens_of_prefix(prefix_tokens: Column, chars: Column) -> Column:
    """Exact tokens of a text's first `chars` characters (of all where it has fewer)."""
    return F.element_at(prefix_tokens, (F.least(chars, F.size(prefix_tokens) - 1) + 1).cast("int")).cast("long")
