"""Stores beside the facts: subjects, feedback, vocabulary requests, backlog, controls, generations, and what they must keep to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.schemas import BACKLOG, BACKLOG_PER_PROJECT, PREDICATE_NAME, PROJECT_NAME, ROLES, SEGMENT_NAMESPACE, SURFACES


def segment_key(digest: Column, ordinal: Column, role: Column, subject: Column) -> Column:
    """A segment's own name: a version-5 UUID whose hash is SHA-256, of its document's digest, place, role and subject."""
    data = F.concat_ws("\n", digest, ordinal.cast("string"), role, F.coalesce(subject, F.lit("")))
    h = F.sha2(F.concat(F.unhex(F.lit(SEGMENT_NAMESPACE.replace("-", ""))), F.encode(data, "UTF-8")), 256)
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def live(subjects: DataFrame, sources: DataFrame) -> DataFrame:
    """Registered subjects that some source still names."""
    return subjects.join(sources.select("data_subject_id").where("data_subject_id is not null"), "data_subject_id", "left_semi")


def open_feedback(feedback: DataFrame, facts: DataFrame, promoted: DataFrame) -> DataFrame:
    """Feedback on facts that are still believed and that nobody has acted on yet."""
    standing = facts.where("known_to is null").select("fact_id")
    return feedback.join(standing, "fact_id", "left_semi").join(promoted.select("feedback_id"), "feedback_id", "left_anti")


def promote(feedback: DataFrame) -> DataFrame:
    """What feedback becomes: a correction where it proposes another object, else a retraction. Of one fact's the first holds."""
    first = F.min(F.struct("feedback_id", "proposed"))
    rows = feedback.groupBy("fact_id").agg(first.alias("x")).select("fact_id", "x.feedback_id", "x.proposed")
    return rows.withColumn("becomes", F.when(F.col("proposed").isNull(), "retraction").otherwise("correction"))


def vocabulary_requests(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Requests for predicates with why each is refused, null where it is taken: a bad name, a name in use, or asked for before."""
    known = vocabulary.select("predicate", F.lit(True).alias("known"))
    order = Window.partitionBy("predicate").orderBy("arrival")
    rows = asked.withColumn("nth", F.row_number().over(order)).join(F.broadcast(known), "predicate", "left")
    why = F.when(~F.col("predicate").rlike(PREDICATE_NAME), "invalid_name").when(F.col("known"), "exists").when(F.col("nth") > 1, "asked_before")
    return rows.select("predicate", "arrival", why.alias("refused"))


def project_names(names: DataFrame) -> DataFrame:
    """Whether each name can be a project's."""
    return names.withColumn("fits", F.col("name").rlike(PROJECT_NAME))


def only_grows(old: Column, new: Column) -> Column:
    """Whether a set of surfaces keeps all that it had."""
    return F.size(F.array_except(old, new)) == 0


def admit_to_backlog(waiting: DataFrame, most: int = BACKLOG, most_of_project: int = BACKLOG_PER_PROJECT) -> DataFrame:
    """Which turns the backlog has room for, first come first served; `waiting` is `scope, arrival`. A project holds `most_of_project` at most,
    and of what projects may hold the instance takes the first `most` to arrive, whichever project they are of."""
    order = Window.partitionBy("scope").orderBy("arrival")
    ranked = waiting.withColumn("nth", F.row_number().over(order))
    come = F.struct("arrival", "scope")
    # The last that still has room: `most` rows at most are ordered as a whole.
    last = ranked.where(F.col("nth") <= most_of_project).orderBy("arrival", "scope").limit(most).agg(F.max(come).alias("last"))
    rows = ranked.crossJoin(F.broadcast(last))  # one row
    return rows.select("scope", "arrival", F.coalesce((F.col("nth") <= most_of_project) & (come <= F.col("last")), F.lit(False)).alias("admitted"))


def effective_controls(asked: DataFrame, most_characters: int) -> DataFrame:
    """Recall controls as they take effect, or none where they are refused: a budget out of bounds, roles or surfaces empty, unknown or
    repeated. `asked` is `id, max_characters, roles, surfaces, hops`, null where a caller leaves one out."""
    roles, surfaces = F.coalesce("roles", F.array(F.lit("user"))), F.coalesce("surfaces", F.array(*map(F.lit, SURFACES)))
    one_of = lambda x, known, most: (F.size(x).between(1, most)) & (F.size(F.array_distinct(x)) == F.size(x)) & (F.size(F.array_except(x, F.array(*map(F.lit, known)))) == 0)
    budget = F.coalesce("max_characters", F.lit(most_characters))
    valid = budget.between(1, most_characters) & one_of(roles, ROLES, 4) & one_of(surfaces, SURFACES, len(SURFACES))
    hops = F.least(F.greatest(F.coalesce("hops", F.lit(1)), F.lit(1)), F.lit(2))
    return asked.select("id", valid.alias("valid"), F.when(valid, budget).alias("max_characters"), F.when(valid, F.array_join(roles, ",")).alias("roles"), F.when(valid, F.array_join(surfaces, ",")).alias("surfaces"), F.when(valid, hops).alias("hops"))


def owing_reports(communities: DataFrame, reports: DataFrame, writer: str, most: int) -> DataFrame:
    """The first scopes, in order, that have a community without a report by this writer."""
    by = reports.select("scope", "community_id", "written_by")
    rows = communities.join(by, ["scope", "community_id"], "left").where(F.col("written_by").isNull() | (F.col("written_by") != writer))
    return rows.select("scope").distinct().orderBy("scope").limit(most)


def rewritten(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of an append-only table that a later snapshot lacks or has with another content."""
    digest = lambda df: df.select(key, F.xxhash64(*columns).alias("h"))
    return digest(before).join(digest(after), [key, "h"], "left_anti").select(key)


def embedding_page(items: DataFrame, vectors: DataFrame, cursor: int, most: int) -> DataFrame:
    """The next items after a cursor whose text has no vector of its present digest."""
    current = vectors.select("item_id", "digest")
    return items.where(F.col("item_id") > cursor).join(current, ["item_id", "digest"], "left_anti").orderBy("item_id").limit(most)


def readiness(items: DataFrame, vectors: DataFrame) -> DataFrame:
    """For each generation how many items it has no current vector for; one without any can be made active."""
    generations = vectors.select("generation_id").distinct()
    have = vectors.select("generation_id", "item_id", "digest").join(items.select("item_id", "digest"), ["item_id", "digest"]).groupBy("generation_id").agg(F.count_distinct("item_id").alias("current"))
    total = items.agg(F.count("*").alias("items"))
    # The total is one row.
    rows = generations.join(have, "generation_id", "left").crossJoin(F.broadcast(total))
    lacking = F.col("items") - F.coalesce("current", F.lit(0))
    return rows.select("generation_id", "items", lacking.alias("lacking"), (lacking == 0).alias("ready"))
