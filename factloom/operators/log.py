"""The log of observations: appends, retries, validity, watermarks and the choice of work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.schemas import ROLES


def with_offsets(observations: DataFrame, order: list[str]) -> DataFrame:
    """Dense offsets from 0 within each scope, in arrival order."""
    return observations.withColumn("log_offset", F.row_number().over(Window.partitionBy("scope").orderBy(*order)) - 1)


def append_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Observations, messages and lineage rows of nested turns (`scope, source_id, data_subject_id, occurred_at, messages`)."""
    obs = with_offsets(turns.select("scope", "source_id", "data_subject_id", "occurred_at"), ["occurred_at", "source_id"])
    msgs = turns.select("scope", "source_id", "data_subject_id", F.inline("messages"))
    lineage = msgs.select("scope", F.lit("chunk").alias("projection_kind"), F.concat_ws(":", "source_id", F.col("ordinal").cast("string")).alias("projection_id"), "source_id", "data_subject_id")
    return obs, msgs, lineage


def turn_digest(*parts: Column) -> Column:
    """SHA-256 over parts framed by their byte lengths, so that no two lists of parts look alike."""
    framed = [F.concat(F.octet_length(p).cast("string"), F.lit(":"), p, F.lit(",")) for p in parts]
    return F.sha2(F.concat(*framed), 256)


def uuid_of(digest: Column, version: str = "5") -> Column:
    """The first 16 bytes of a hex digest as a UUID, with version and variant bits in place."""
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit(version), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def classify_retries(attempts: DataFrame, stored: DataFrame, erased: DataFrame) -> DataFrame:
    """Each attempt (`scope, key, digest`) as new, replay of a stored one, conflict with another payload, or erased."""
    known = stored.select("scope", "key", F.col("digest").alias("stored_digest"))
    gone = erased.select("scope", "key").distinct().withColumn("gone", F.lit(True))
    rows = attempts.join(known, ["scope", "key"], "left").join(gone, ["scope", "key"], "left")
    kind = F.when(F.col("gone"), "erased").when(F.col("stored_digest").isNull(), "new").when(F.col("stored_digest") == F.col("digest"), "replay").otherwise("conflict")
    return rows.select(*attempts.columns, kind.alias("outcome"))


def validate_turns(messages: DataFrame, most_messages: int = 64, message_bytes: int = 65_536, turn_bytes: int = 262_144) -> DataFrame:
    """The first rule that each source's messages break, null if none: count, role, blank, size, ordinals."""
    rows = messages.groupBy("scope", "source_id").agg(
        F.count("*").alias("n"), F.count_if(~F.col("role").isin(ROLES)).alias("bad_role"), F.count_if(F.trim("content") == "").alias("blank"),
        F.max(F.octet_length("content")).alias("longest"), F.sum(F.octet_length("content")).alias("bytes"), F.count_distinct("ordinal").alias("ordinals"),
    )
    reason = (
        F.when(F.col("n") > most_messages, "too_many_messages").when(F.col("bad_role") > 0, "unknown_role").when(F.col("blank") > 0, "blank_message")
        .when(F.col("longest") > message_bytes, "message_too_long").when(F.col("bytes") > turn_bytes, "turn_too_long").when(F.col("ordinals") < F.col("n"), "repeated_ordinal")
    )
    return rows.select("scope", "source_id", F.col("n").alias("messages"), "bytes", reason.alias("reason"))


def freshness(observations: DataFrame) -> DataFrame:
    """Highest stored offset, highest contiguously formed one, and parked turns, by scope (`formed`, `parked` flags)."""
    backlog = F.min(F.when(~F.col("formed") & ~F.col("parked"), F.col("log_offset")))
    stored = F.max("log_offset")
    formed = F.when(backlog.isNull(), stored).when(backlog > 0, backlog - 1)
    return observations.groupBy("scope").agg(stored.alias("stored"), formed.alias("formed"), F.count_if("parked").alias("parked"))


def due_work(observations: DataFrame, now: str, retry_seconds: int = 30, most_attempts: int = 6) -> DataFrame:
    """Unformed turns whose backoff is over, oldest first: `retry * 2 ** min(attempts - 1, 6)` seconds after the last attempt."""
    wait = F.lit(retry_seconds) * F.pow(F.lit(2), F.least(F.greatest(F.col("attempts") - 1, F.lit(0)), F.lit(6)))
    due = F.col("attempts").isin(0) | (F.unix_micros("last_attempt_at") + wait.cast("long") * 1_000_000 <= F.unix_micros(F.lit(now).cast("timestamp")))
    return observations.where(~F.col("formed") & ~F.col("parked") & (F.col("attempts") < most_attempts)).where(due)


def fair_pass(work: DataFrame, each: int = 8) -> DataFrame:
    """At most `each` turns of a scope in one pass, scopes with the oldest turn first."""
    own = Window.partitionBy("scope").orderBy("log_offset")
    return work.withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= each)


def backlog_by_age(observations: DataFrame) -> DataFrame:
    return observations.where("not formed and not parked").groupBy("scope").agg(F.min("occurred_at").alias("oldest"), F.count("*").alias("waiting")).orderBy("oldest", "scope")
