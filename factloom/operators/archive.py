"""Sealed ranges of the ledger as files: JSON lines that carry their seals, verified in parallel, and what stays when a range has left.

A file begins with a header, then has each of its seals followed by the entries' lines that it digested. Each file names the digest that it
follows, so files are verified each by itself, and the files among each other by one row a file."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators.ledger import _in_ranges

VERSION = 1
ZERO = "00" * 32


def lines(seals: DataFrame, entries: DataFrame, per_file: int) -> DataFrame:
    """`file, seal, entry_id, value`: the lines of files of `per_file` seals each; in the order of these columns, nulls first, they are the files.

    `seals` as `ledger.chain` gives them. The header (seal null) says what the file follows and where it ends."""
    rows = seals.withColumn("file", F.floor(F.col("seal") / per_file))
    head = rows.groupBy("file").agg(F.min(F.struct("seal", "previous")).alias("a"), F.max(F.struct("seal", "to_id")).alias("b"))
    header = F.struct(F.lit(VERSION).alias("version"), F.col("a.previous").alias("previous_digest"), F.col("b.seal").alias("through_seal"), F.col("b.to_id").alias("through_entry"))
    none = F.lit(None).cast("long")
    told = F.struct(
        F.col("seal"), F.col("from_id").alias("from_entry"), F.col("to_id").alias("to_entry"), F.col("entries").alias("entry_count"),
        F.col("digest").alias("entries_digest"), F.col("previous").alias("previous_digest"), F.col("sealed").alias("digest"),
    )
    out = head.select("file", none.alias("seal"), none.alias("entry_id"), F.to_json(header).alias("value"))
    out = out.unionByName(rows.select("file", "seal", none.alias("entry_id"), F.to_json(told).alias("value")))
    own = _in_ranges(entries, seals).select(F.floor(F.col("seal") / per_file).alias("file"), "seal", "entry_id", F.to_json(F.struct(F.col("line").alias("entry"))).alias("value"))
    return out.unionByName(own)


def write(rows: DataFrame, path: str) -> None:
    """Write the files below `path`, one a folder `file=N`. A file is one task's work, of at most its seals' entries."""
    order = [F.col("file"), F.asc_nulls_first("seal"), F.asc_nulls_first("entry_id")]
    rows.repartition("file").sortWithinPartitions(*order).select("file", "value").write.partitionBy("file").text(path)


def checked(data: bytes, head: str | None = None) -> dict:
    """What a file's contents say of it: the first seal that fails and why, and how far it holds. With `head`, it must end there.

    Faults: malformed, entries_missing, entries_changed, broken_link, wrong_digest, out_of_order, end_missing, other_head."""
    out = {"valid": False, "failed_seal": None, "failure": None, "seals": 0, "entries": 0, "first_entry": None, "last_entry": None, "previous": None, "head": None}

    def fail(why: str, seal: int | None) -> dict:
        return out | {"failure": why, "failed_seal": seal}

    try:
        rows = [json.loads(x) for x in data.decode().splitlines() if x]
    except ValueError:
        return fail("malformed", None)
    if not rows or not isinstance(rows[0], dict) or rows[0].get("version") != VERSION:
        return fail("malformed", None)
    header, seal, held = rows[0], None, []
    out["previous"] = out["head"] = header["previous_digest"]
    last = None

    def close() -> str | None:
        entries = hashlib.sha256("\n".join(held).encode()).hexdigest()
        if len(held) != seal["entry_count"]:
            return "entries_missing"
        if entries != seal["entries_digest"]:
            return "entries_changed"
        if seal["previous_digest"] != out["head"]:
            return "broken_link"
        if hashlib.sha256(bytes.fromhex(seal["previous_digest"] + seal["entries_digest"])).hexdigest() != seal["digest"]:
            return "wrong_digest"
        out.update(head=seal["digest"], seals=out["seals"] + 1, entries=out["entries"] + len(held))
        return None

    for row in rows[1:]:
        if "entry" in row:
            if seal is None:
                return fail("malformed", None)
            n = int(row["entry"].split("|", 1)[0])
            if not seal["from_entry"] <= n <= seal["to_entry"] or (out["last_entry"] is not None and n <= out["last_entry"]):
                return fail("out_of_order", seal["seal"])
            out["first_entry"] = n if out["first_entry"] is None else out["first_entry"]
            out["last_entry"] = n
            held.append(row["entry"])
            continue
        if seal is not None and (why := close()):
            return fail(why, seal["seal"])
        if last is not None and row["seal"] <= last:
            return fail("out_of_order", row["seal"])
        seal, held, last = row, [], row["seal"]
    if seal is None:
        return fail("end_missing", None)
    if why := close():
        return fail(why, seal["seal"])
    if (last, out["last_entry"]) != (header["through_seal"], header["through_entry"]):
        return fail("end_missing", last)
    if head is not None and head != out["head"]:
        return fail("other_head", last)
    return out | {"valid": True}


FOUND = "valid boolean, failed_seal long, failure string, seals long, entries long, first_entry long, last_entry long, previous string, head string"


def verify_files(spark: SparkSession, path: str) -> DataFrame:
    """`file` and what is said of each: verified by itself, then that it follows the file before it (`broken_link` at its first seal if not).

    A file is read whole by one task: it has the lines of its seals, whose number the writer chose."""

    def check(batches):
        for batch in batches:
            told = [checked(x) for x in batch.column("content").to_pylist()]
            columns = [pa.array([t[c.split()[0]] for t in told], {"boolean": pa.bool_(), "long": pa.int64(), "string": pa.string()}[c.split()[1]]) for c in FOUND.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("file").cast(pa.int64()), *columns], ["file", *[c.split()[0] for c in FOUND.split(", ")]])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    files = files.select(F.regexp_extract("path", r"/file=(\d+)/", 1).cast("long").alias("file"), "content")
    found = files.mapInArrow(check, f"file long, {FOUND}")
    # A row a file. A file that fails says nothing of its end, so the next one is held against nothing.
    order = Window.orderBy("file")
    before = F.lag(F.when(F.col("valid"), F.col("head"))).over(order)
    gap = F.col("valid") & before.isNotNull() & (before != F.col("previous"))
    rows = found.withColumn("_gap", gap)
    return rows.select("file", (F.col("valid") & ~F.col("_gap")).alias("valid"), "failed_seal", F.when(F.col("_gap"), "broken_link").otherwise(F.col("failure")).alias("failure"), "seals", "entries", "first_entry", "last_entry", "previous", "head")


def checkpoint(seals: DataFrame, through_seal: int) -> dict:
    """Where the chain stands after a seal that has been archived: `through_seal, through_entry, digest`."""
    row = seals.where(F.col("seal") == through_seal).select("to_id", "sealed").first()
    if row is None:
        raise ValueError(f"there is no seal {through_seal}")
    return {"through_seal": through_seal, "through_entry": row["to_id"], "digest": row["sealed"]}


def remaining(entries: DataFrame, mark: dict) -> DataFrame:
    """Entries that stay when what a checkpoint covers has left; nothing else may leave."""
    return entries.where(F.col("entry_id") > mark["through_entry"])
