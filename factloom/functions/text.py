"""Text of the memory model: names, question terms, quotes, windows and segments."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.schemas import ANCHOR_WORDS, CITATION_BYTES, SEGMENT_BYTES


def normalised(name: Column) -> Column:
    """A name as it is compared: white space runs are one space, ends trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(name, r"(?U)\s+", " ")))


def question_terms(question: str, most: int = ANCHOR_WORDS) -> list[str]:
    """Names that a question may hold: every run of one to `most` words, with and without a possessive ending, in order of first sight."""
    text = "".join(c if c.isalnum() or c in "'-" or (not c.isspace() and not _punctuation(c)) else " " for c in question)
    words = [w.strip("'-").lower() for w in text.split()]
    found: dict[str, None] = {}
    for i in range(len(words)):
        for n in range(1, most + 1):
            if i + n <= len(words):
                term = " ".join(words[i : i + n])
                for t in (term, term.removesuffix("'s")):
                    if t:
                        found.setdefault(t)
    return list(found)


def _punctuation(c: str) -> bool:
    import unicodedata

    return unicodedata.category(c).startswith("P")


def term_windows(words: Column, most: int = ANCHOR_WORDS) -> Column:
    """All runs of one to `most` words of an array, for many questions at once."""
    starts = F.sequence(F.lit(1), F.size(words))
    runs = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size(words) - i + 1)), lambda n: F.array_join(F.slice(words, i, n), " "))))
    return F.when(F.size(words) > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def question_words(question: Column) -> Column:
    """Words of a question: between white space and punctuation other than `'` and `-`, which go from a word's ends only; lower case."""
    words = F.array_remove(F.split(question, r"(?U)[\s[\p{P}&&[^'\-]]]+"), "")
    return F.transform(words, lambda w: F.lower(F.regexp_replace(w, "^['-]+|['-]+$", "")))


def terms_of(question: Column, most: int = ANCHOR_WORDS) -> Column:
    """Names that a question may hold, in order of first sight: runs of one to `most` words, each also without a possessive ending."""
    forms = F.flatten(F.transform(term_windows(question_words(question), most), lambda t: F.array(t, F.regexp_replace(t, "'s$", ""))))
    return F.array_distinct(F.array_remove(forms, ""))


def exact_span(content: Column, quote: Column) -> Column:
    """Byte range of the first exact occurrence of a quote, null where there is none or the quote is blank."""
    at = F.instr(content, quote)
    start = F.octet_length(F.substring(content, F.lit(1), at - 1))
    return F.when((F.trim(quote) != "") & (at > 0), F.struct(start.alias("byte_start"), (start + F.octet_length(quote)).alias("byte_end")))


def locate(content: str, quote: str) -> tuple[int, int] | None:
    """Byte range of a quote: exact, or else with runs of white space matched to each other."""
    if not content or not quote or not quote.strip():
        return None
    at = content.find(quote)
    if at >= 0:
        start = len(content[:at].encode())
        return start, start + len(quote.encode())
    kept, places, spaced = [], [], False
    for i, c in enumerate(content):
        if c.isspace():
            spaced = bool(kept)
            continue
        if spaced:
            kept.append(" ")
            places.append(i)
            spaced = False
        kept.append(c)
        places.append(i)
    wanted = " ".join(quote.split())
    at = "".join(kept).find(wanted)
    if at < 0:
        return None
    return len(content[: places[at]].encode()), len(content[: places[at + len(wanted) - 1] + 1].encode())


def _located(content: pd.Series, quote: pd.Series) -> pd.DataFrame:
    found = [locate(c, q) for c, q in zip(content, quote)]
    return pd.DataFrame({"byte_start": pd.array([f and f[0] for f in found], "Int32"), "byte_end": pd.array([f and f[1] for f in found], "Int32")})


def with_spans(rows: DataFrame, content: str = "content", quote: str = "quote") -> DataFrame:
    """`byte_start, byte_end` of each row's quote. Exact matches stay in the JVM; only rows without one go through Python."""
    exact = exact_span(F.col(content), F.col(quote)).cast("struct<byte_start:int,byte_end:int>")
    search = F.pandas_udf(_located, "byte_start int, byte_end int")
    loose = F.when(F.trim(F.coalesce(quote, F.lit(""))) != "", search(F.col(content), F.col(quote)))
    found = rows.withColumn("_exact", exact)
    found = found.withColumn("_span", F.coalesce("_exact", F.when(F.col("_exact").isNull(), loose)))
    return found.select(*rows.columns, "_span.byte_start", "_span.byte_end")


def citation_window(content: Column, start: Column, end: Column, reach: int = CITATION_BYTES) -> Column:
    """Raw bytes around a span, and where they begin."""
    data = F.encode(content, "UTF-8")
    first = F.greatest(start - reach, F.lit(0))
    return F.struct(first.alias("first"), F.substring(data, first + 1, F.least(end + reach, F.octet_length(content)) - first).alias("bytes"))


def segments(text: str, ceiling: int = SEGMENT_BYTES) -> list[str]:
    """Cut a text into pieces of at most `ceiling` bytes that join to it again: after a paragraph, else a sentence, else a space, else a code point."""
    data, out = text.encode(), []
    while len(data) > ceiling:
        window = data[:ceiling]
        cut = window.rfind(b"\n\n") + 2
        if cut < 2:
            cut = max(window.rfind(m) + 2 if window.rfind(m) >= 0 else 0 for m in (b". ", b"! ", b"? ", b".\n", b"!\n", b"?\n"))
        if cut <= 0:
            cut = max(window.rfind(b" "), window.rfind(b"\n")) + 1
        if cut <= 0:
            cut = ceiling
            while cut > 1 and data[cut] & 0xC0 == 0x80:
                cut -= 1
        out.append(data[:cut].decode())
        data = data[cut:]
    return out + ([data.decode()] if data else [])


def segmented(docs: DataFrame, ceiling: int = SEGMENT_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id, ordinal, byte_start, byte_end, piece` of each document. Texts under the ceiling stay in the JVM."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: segments(t, ceiling))

    text = F.coalesce(F.col(text_col), F.lit(""))
    pieces = F.when(F.octet_length(text) <= ceiling, F.array(text)).otherwise(cut(text))
    rows = docs.select(F.col(id_col).alias("id"), pieces.alias("pieces"))
    ends = F.expr("transform(pieces, (p, i) -> struct(cast(i as int) as ordinal, aggregate(slice(pieces, 1, i), 0, (a, x) -> a + octet_length(x)) as byte_start, p as piece))")
    return rows.select("id", F.inline(ends)).select("id", "ordinal", "byte_start", (F.col("byte_start") + F.octet_length("piece")).alias("byte_end"), "piece")
