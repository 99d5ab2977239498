"""Artifacts by compare-and-set: a log of puts and deletes folded into what became of each command and what is stored at the end.

An artifact's commands act on each other in order, so they are folded artifact by artifact, spread over all tasks. What a scope may hold
ties its artifacts together: only in a scope whose writes could reach its limits, counted as if nothing were ever deleted or made smaller,
are all commands folded as one sequence. That is one task's work, which holds the scope's live artifacts (the limit bounds them) and the
names of those that other commands name too. Contents don't reach the fold; a command is its sizes and its digest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.schemas import ARTIFACT_BYTES, ARTIFACT_KINDS, ARTIFACT_NAME_BYTES, ARTIFACT_SUBJECT_BYTES

COMMANDS = (
    "scope string, seq long, op string, artifact_id string, subject string, kind string, name string, bytes long, digest string, expected long, at timestamp"
)
OUT = "what string, scope string, seq long, artifact_id string, outcome string, version long, subject string, kind string, name string, bytes long, more long, objects long"
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def request_digest(subject: Column, kind: Column, name: Column, content: Column) -> Column:
    """SHA-256 over subject, kind, name and content, each behind its length as eight bytes."""
    part = lambda c: F.concat(F.unhex(F.lpad(F.hex(F.octet_length(c)), 16, "0")), c)
    return F.sha2(F.concat(*[part(F.encode(c, "UTF-8")) for c in (subject, kind, name)], part(content)), 256)


def invalid() -> Column:
    """Whether a command can't be tried: no name of an artifact, an unknown operation or kind, texts too long, no content or too much of it."""
    put = F.col("kind").isin(*ARTIFACT_KINDS) & F.octet_length("subject").between(1, ARTIFACT_SUBJECT_BYTES) & (F.octet_length("name") <= ARTIFACT_NAME_BYTES) & (F.col("bytes") <= ARTIFACT_BYTES) & F.col("digest").isNotNull()
    delete = F.col("expected").isNotNull() & (F.coalesce(F.octet_length("subject"), F.lit(1)) <= ARTIFACT_SUBJECT_BYTES)
    right = F.col("artifact_id").rlike(UUID) & F.when(F.col("op") == "put", put).when(F.col("op") == "delete", delete)
    return ~F.coalesce(right, F.lit(False))


def _apply(c: dict, held: dict, used: set, room: list | None) -> tuple[str, int, int]:
    """What becomes of one command, with how many bytes and objects more it makes. `held` and `used` change where it is accepted; `room` is
    what a scope holds and may hold, or None where it can't fill."""
    name = c["artifact_id"]
    a = held.get(name)
    if a and c["at"] >= a["until"]:
        a = None
    if c["op"] == "delete":
        if not a or c["subject"] not in (None, a["subject"]):
            return "not_found", 0, 0
        if a["version"] != c["expected"]:
            return "conflict", 0, 0
        del held[name]
        return "deleted", -a["bytes"], -1
    if not a:
        if c["expected"] is not None:
            return "not_found", 0, 0
        if name in used:
            return "conflict", 0, 0
        more, objects = c["bytes"], 1
    else:
        if (a["subject"], a["kind"]) != (c["subject"], c["kind"]):
            return "conflict", 0, 0
        if c["expected"] is None:
            return ("replayed" if a["first"] == c["digest"] else "conflict"), 0, 0
        if a["version"] != c["expected"]:
            again = a["previous"] == c["expected"] and a["digest"] == c["digest"]
            return ("replayed" if again else "conflict"), 0, 0
        more, objects = c["bytes"] - a["bytes"], 0
    if (more > 0 or objects) and c["bytes"] > c["max_object_bytes"]:
        return "capacity", 0, 0
    if room and ((more > 0 and room[0] + more > c["max_bytes"]) or (objects and room[1] + 1 > c["max_objects"])):
        return "capacity", 0, 0
    new = {"version": c["seq"], "previous": a and a["version"], "digest": c["digest"], "first": a["first"] if a else c["digest"], "until": a["until"] if a else c["until"]}
    held[name] = new | {k: c[k] for k in ("subject", "kind", "name", "bytes")}
    if c["again"]:
        used.add(name)
    return ("replaced" if a else "created"), more, objects


def _folding(key: list[str], limited: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A fold of sorted partitions, a key after the other."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split() for c in OUT.split(", ")]
        schema = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in names])
        blank, rows, now, held, used, room = dict.fromkeys(n for n, _ in names), [], None, {}, set(), None

        def stand() -> list[dict]:
            return [blank | {"what": "artifact", "scope": now[0], "artifact_id": i, "version": a["version"], **{k: a[k] for k in ("subject", "kind", "name", "bytes")}} for i, a in held.items()]

        for batch in batches:
            for c in batch.to_pylist():
                if now != tuple(c[k] for k in key):
                    if now:
                        rows += stand()
                    now, held, used, room = tuple(c[k] for k in key), {}, set(), [0, 0] if limited else None
                outcome, more, objects = _apply(c, held, used, room)
                if room:
                    room[0], room[1] = room[0] + more, room[1] + objects
                rows.append(blank | {"what": "said", "scope": c["scope"], "seq": c["seq"], "artifact_id": c["artifact_id"], "outcome": outcome, "more": more, "objects": objects})
                if len(rows) >= 10_000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
        if now:
            rows += stand()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return fold


def replay(commands: DataFrame, policies: DataFrame, write: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """What became of each command (`scope, seq, artifact_id, outcome`), and the artifacts that stand (`scope, artifact_id, version, subject,
    kind, name, bytes`).

    `commands` has the columns of `COMMANDS`; (scope, seq) orders them and is unique, and a version is the seq of the put that made it. A put
    without `expected` creates: repeated as it was it is `replayed`, and an id is never created twice, deleted or not. One with `expected`
    replaces that version; repeated it is `replayed` until the next. Others are `conflict`, or `not_found` where nothing stands. `policies` is
    `scope, max_object_bytes, max_bytes, max_objects, max_age_hours`; a write over them is `capacity`, one that makes an artifact no larger
    never is. An artifact ends `max_age_hours` after it was created and still takes its room, as nothing here sweeps it. A scope without a
    policy is `no_such_project`, a command that can't be tried is `invalid`, and neither changes anything. Null scopes have no policy."""
    told = commands.withColumns({"artifact_id": F.lower("artifact_id"), "_bad": invalid()}).join(policies, "scope", "left")
    wrong = F.when(F.col("_bad"), "invalid").when(F.col("max_bytes").isNull(), "no_such_project").when(F.col("at").isNull(), "invalid")
    rows = told.withColumn("wrong", wrong)
    refused = rows.where("wrong is not null").select("scope", "seq", "artifact_id", F.col("wrong").alias("outcome"))
    ready = rows.where("wrong is null").withColumn("until", F.expr("at + make_dt_interval(0, max_age_hours)"))
    many = ready.groupBy("scope", "artifact_id").agg((F.count("*") > 1).alias("again"))
    ready = write(ready.join(many, ["scope", "artifact_id"]).withColumns({c: F.unix_micros(c) for c in ("at", "until")}).drop("wrong", "_bad", "max_age_hours"))

    def folded(some: DataFrame, key: list[str], limited: bool) -> DataFrame:
        return some.repartition(*key).sortWithinPartitions(*key, "seq").mapInArrow(_folding(key, limited), OUT)

    each = write(folded(ready, ["scope", "artifact_id"], False))
    grown = each.where("what = 'said'").groupBy("scope").agg(F.sum(F.greatest("more", F.lit(0))).alias("_bytes"), F.sum(F.greatest("objects", F.lit(0))).alias("_objects"))
    full = write(grown.join(policies, "scope").where("_bytes > max_bytes or _objects > max_objects").select("scope"))
    whole = folded(ready.join(full, "scope", "left_semi"), ["scope"], True)
    done = write(each.join(full, "scope", "left_anti").unionByName(whole))
    said = done.where("what = 'said'").select("scope", "seq", "artifact_id", "outcome").unionByName(refused)
    return said, done.where("what = 'artifact'").select("scope", "artifact_id", "version", "subject", "kind", "name", "bytes")


def usage(artifacts: DataFrame, policies: DataFrame) -> DataFrame:
    """What each scope holds of what it may hold."""
    held = artifacts.groupBy("scope").agg(F.count("*").alias("objects"), F.sum("bytes").alias("used"))
    rows = policies.join(held, "scope", "left").fillna(0, ["objects", "used"])
    return rows.select("scope", "objects", "used", "max_bytes", "max_objects")


def page(artifacts: DataFrame, scope: str, kind: str, prefix: str, after: str, most: int) -> DataFrame:
    """A scope's artifacts of one kind whose names start with `prefix`, by id after a cursor; one row more than `most` says that there is a
    next page, and ends this one."""
    rows = artifacts.where((F.col("scope") == scope) & (F.col("kind") == kind) & F.startswith("name", F.lit(prefix)) & (F.col("artifact_id") > after))
    return rows.orderBy("artifact_id").limit(most + 1)
