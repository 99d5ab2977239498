"""Byte-level BPE through the `tokenizers` library, each distinct piece of text encoded once per batch.

The pre-tokenizer's pattern never joins what stands before a single space with what stands after it, so a text may be cut in
front of every such space and the pieces encoded apart. Texts in which a space touches other white space, and texts that
hold a special token, are encoded whole.
"""

from __future__ import annotations

import array
import itertools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space beside other white space (as the tokenizer's pattern understands white space): such texts are not cut.
TOUCHING = r"[\s\p{Z}\x{85}\x{0b}\x{1c}-\x{1f}] | [\s\p{Z}\x{85}\x{0b}\x{1c}-\x{1f}]"

#: One word of Latin letters, perhaps with a space in front and one mark behind: the pre-tokenizer's pattern takes the word as one unit
#: and the mark as another, so the library's BPE model can be given the word at once.
PLAIN = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,]?)")

_loaded: dict[str, "PieceEncoder"] = {}


def byte_letters() -> dict[int, str]:
    """The letters that a byte-level vocabulary spells bytes with: printable Latin-1 bytes stand for themselves, others follow 255."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PieceEncoder:
    """Encodes Arrow text arrays; holds nothing but the tokenizer between calls."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.letters = byte_letters()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.mark = {x: self.tok.encode(x, add_special_tokens=False).ids for x in ".,"} | {"": []}

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some distinct pieces, one after another, and how many each has. Plain arrays, as lists of lists burden the collector."""
        model, letters, mark, plain = self.tok.model.tokenize, self.letters, self.mark, PLAIN.fullmatch
        ids, count, other = array.array("I"), array.array("I"), []
        for x in texts:
            if m := plain(x):
                word, tail = m.groups()
                if word.isascii():
                    word = letters[32] + word[1:] if word[0] == " " else word
                else:
                    word = word.encode().decode("latin-1").translate(letters)
                before = len(ids)
                ids.extend([t.id for t in model(word)])
                if tail:
                    ids.extend(mark[tail])
                count.append(len(ids) - before)
            else:
                other.append(len(count))
                count.append(0)
        ids, count = np.frombuffer(ids, np.uint32), np.frombuffer(count, np.uint32).astype(np.int64)
        if not other:
            return ids, count
        extra = [e.ids for i in range(0, len(other), 20_000) for e in self.tok.encode_batch_fast([texts[k] for k in other[i : i + 20_000]], add_special_tokens=False)]
        more = np.fromiter(map(len, extra), np.int64, len(extra))
        at = np.repeat((np.cumsum(count) - count)[other], more)
        count[other] = more
        return np.insert(ids, at, np.fromiter(itertools.chain.from_iterable(extra), np.uint32, int(more.sum()))), count

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All pieces of all texts in order. Returns (ids, tokens of each piece, bytes of each piece, first piece of each row)."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        whole = pc.match_substring_regex(texts, TOUCHING)
        for s in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, s))
        lists = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        flat, at = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        at = at - at[0]
        head = np.zeros(len(flat), bool)
        head[at[:-1]] = True
        size = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64) + ~head
        # A piece carries the space in front of it, except for the first of its row.
        flat = pc.if_else(pa.array(head), flat, pc.binary_join_element_wise("", flat, " "))
        code = flat.dictionary_encode()
        names, code = code.dictionary.to_pylist(), code.indices.to_numpy()
        lone = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        if len(lone):
            # The single piece of such a row is its whole text.
            kept = texts.take(pa.array(lone)).to_pylist()
            code = code.copy()
            code[at[lone]] = np.arange(len(names), len(names) + len(kept))
            size[at[lone]] = [len(x.encode()) for x in kept]
            names = names + kept
        parts = [self._encode(names[i : i + 50_000]) for i in range(0, len(names), 50_000)]
        pool, count = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        begin = np.cumsum(count) - count
        per = count[code]
        ends = np.cumsum(per)
        ids = pool[np.repeat(begin[code] - (ends - per), per) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, per, size, at


def encoder(path: str) -> PieceEncoder:
    """One encoder for each Python worker and tokenizer file."""
    if path not in _loaded:
        _loaded[path] = PieceEncoder(path)
    return _loaded[path]
