"""From proposed claims to facts: admission, speakers, names, supersession, retraction, rebuilds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import normalised, with_spans
from factloom.schemas import ALIAS_CEILING, ENTITY_TYPES, SPEAKER_TERMS

CLAIM_KEY = ["scope", "account", "subject_id", "predicate"]


def known_kind(kind: Column, otherwise: Column) -> Column:
    return F.when(kind.isin(ENTITY_TYPES), kind).otherwise(otherwise)


def admit(proposals: DataFrame, vocabulary: DataFrame, unresolvable: list[str]) -> DataFrame:
    """Every proposal with the first gate that it fails as `reason`, null where it is admitted.

    Gates in order: relation, subject term, object term, blank ends, quote, polarity, tense, duplicate within the message. Duplicates count
    among rows that pass all other gates only; the first in `arrival` stays (where there is no such column, the first by quote).
    """
    first = ["arrival"] if "arrival" in proposals.columns else []
    rows = with_spans(proposals).join(F.broadcast(vocabulary.select("predicate", "semantic_type", "cardinality", "object_kind", "event")), "predicate", "left")
    subject, obj = normalised(F.col("subject")), normalised(F.col("object"))
    gate = (
        F.when(F.col("semantic_type").isNull(), "unmapped_relation")
        .when(subject.isin(unresolvable) | (subject == ""), "unresolvable_subject")
        .when(obj.isin(unresolvable) | (obj == ""), "unresolvable_object")
        .when(F.col("byte_start").isNull(), "unlocatable_quote")
        .when(F.col("polarity") != "asserted", "not_asserted")
        .when((F.col("tense") != "present") & ~((F.col("tense") == "past") & F.col("event")), "not_current")
    )
    rows = rows.select("*", subject.alias("subject_norm"), obj.alias("object_norm"), gate.alias("gate"))
    key = Window.partitionBy("scope", "source_id", "ordinal", "predicate", "subject_norm", "object_norm", F.col("gate").isNull()).orderBy(*first, "quote", "byte_start")
    twin = F.when(F.col("gate").isNull() & (F.row_number().over(key) > 1), "duplicate_claim")
    return rows.select("*", F.coalesce("gate", twin).alias("reason")).drop("gate").withColumns({"subject_type": known_kind(F.col("subject_type"), F.lit("")), "object_type": known_kind(F.col("object_type"), F.col("object_kind"))})


def bind_speakers(claims: DataFrame) -> DataFrame:
    """Claims about the speaker take the data subject as their end; others' words about themselves are refused."""
    says = F.col("subject_norm").isin(SPEAKER_TERMS)
    reason = F.when(says & (F.col("role") != "user"), "not_spoken_by_principal").when(says & F.col("data_subject_id").isNull(), "unresolvable_subject")
    return claims.select("*", F.when(says, F.col("data_subject_id")).alias("speaker_subject_id"), reason.alias("speaker_reason"))


def resolve_entities(names: DataFrame) -> DataFrame:
    """`scope, normalized_name, canonical_name, aliases` of names in arrival order: the first spelling is canonical, the others its aliases."""
    rows = names.select("scope", normalised(F.col("name")).alias("normalized_name"), "name", "arrival").where((F.octet_length("name") <= 4096) & (F.col("normalized_name") != ""))
    grouped = rows.groupBy("scope", "normalized_name").agg(F.min_by("name", "arrival").alias("canonical_name"), F.collect_set("name").alias("names"))
    return grouped.select("scope", "normalized_name", "canonical_name", F.slice(F.array_sort(F.array_except("names", F.array("canonical_name"))), 1, ALIAS_CEILING).alias("aliases"))


def supersede(claims: DataFrame) -> DataFrame:
    """Claims of one-valued keys in arrival order, with `accepted` and, for accepted ones, where the next accepted one begins.

    A claim is accepted if it begins after every earlier claim of its key. `known_at` is strictly later than the known_at of the claim
    before: in microseconds `n + max(learned - n)` over the claims so far.
    """
    order = Window.partitionBy(*CLAIM_KEY).orderBy("arrival", "claim_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = claims.withColumn("top", F.max("valid_from").over(before))
    rows = rows.withColumn("accepted", F.col("top").isNull() | (F.col("valid_from") > F.col("top"))).drop("top")
    among = Window.partitionBy(*CLAIM_KEY, "accepted").orderBy("arrival", "claim_id")
    n = F.row_number().over(among)
    clock = F.timestamp_micros(n + F.max(F.unix_micros("learned_at") - F.col("n")).over(among.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("n", n).withColumn("known_at", clock)
    return rows.withColumns({"next_valid": F.lead("valid_from").over(among), "next_known": F.lead("known_at").over(among)})


def fact_versions(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Current facts and history of accepted claims: a superseded fact ends where its successor begins, as known since then, and its
    earlier, endless version was known until then."""
    rows = supersede(claims).where("accepted")
    own = [*CLAIM_KEY, F.col("claim_id").alias("fact_id"), "object_value", "valid_from"]
    facts = rows.select(*own, F.col("next_valid").alias("valid_to"), F.coalesce("next_known", "known_at").alias("known_from"), F.lit(None).cast("timestamp").alias("known_to"))
    history = rows.where("next_valid is not null").select(*own, F.lit(None).cast("timestamp").alias("valid_to"), F.col("known_at").alias("known_from"), F.col("next_known").alias("known_to"))
    return facts, history


def refused_claims(claims: DataFrame) -> DataFrame:
    return supersede(claims).where("not accepted").select(*CLAIM_KEY, "claim_id", F.lit("conflicting_value").alias("reason"))


def claim_identity(*parts: str) -> Column:
    """Digest of a claim's defining parts, in the form of a UUID."""
    h = F.sha2(F.to_json(F.array(*[F.col(p).cast("string") for p in parts])), 256)
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))


def account_of(facts: DataFrame, projects: DataFrame) -> DataFrame:
    """Facts of a shared project belong to nobody's account; others, also of unknown projects, to their data subject's."""
    shared = F.coalesce(F.col("statements") == "shared", F.lit(False))
    return facts.join(projects.select("scope", "statements"), "scope", "left").withColumn("account", F.when(shared, "").otherwise(F.coalesce("data_subject_id", F.lit("")))).drop("statements")


def retract(facts: DataFrame, retractions: DataFrame, now: str) -> DataFrame:
    """Facts with the knowledge of retracted ones closed at `now`. A retraction of another version than the fact's changes nothing."""
    mark = retractions.select("fact_id", F.col("version").alias("_version"), F.lit(True).alias("_gone"))
    joined = facts.join(mark, "fact_id", "left")
    hit = F.col("_gone") & (F.col("_version") == F.col("version")) & F.col("known_to").isNull()
    return joined.withColumns({"known_to": F.when(hit, F.lit(now).cast("timestamp")).otherwise(F.col("known_to")), "version": F.when(hit, F.col("version") + 1).otherwise(F.col("version"))}).drop("_version", "_gone")


def correct(facts: DataFrame, corrections: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Corrections are retractions with a replacement: the closed facts, and the authored ones that stand in their place."""
    closed = retract(facts, corrections.select("fact_id", "version"), now)
    replaced = facts.join(corrections, ["fact_id", "version"]).where("known_to is null")
    return closed, replaced.select(F.concat("fact_id", F.lit(":corrected")).alias("fact_id"), "scope", "subject_id", "predicate", F.col("new_object_id").alias("object_id"), "valid_from", F.lit(now).cast("timestamp").alias("known_from"), F.lit("user").alias("source_role"))


def blocked(claims: DataFrame, retracted: DataFrame) -> DataFrame:
    """Claims that no retraction of the same source and signature holds back."""
    return claims.join(retracted.select("scope", "source_id", "signature"), ["scope", "source_id", "signature"], "left_anti")


def rebuild_generation(facts: DataFrame, admitted: DataFrame, sources: DataFrame, now: str) -> DataFrame:
    """A new generation of some sources' facts: open facts that are not curated close at `now`, the newly admitted ones open."""
    hit = facts.join(sources.select("source_id").distinct().withColumn("_hit", F.lit(True)), "source_id", "left")
    retired = hit.withColumn("known_to", F.when(F.col("_hit") & F.col("known_to").isNull() & (F.col("kind") != "curated"), F.lit(now).cast("timestamp")).otherwise(F.col("known_to"))).drop("_hit")
    fresh = admitted.join(sources.select("source_id").distinct(), "source_id", "left_semi")
    return retired.unionByName(fresh, allowMissingColumns=True)


def source_snapshot(messages: DataFrame) -> DataFrame:
    """Digest of each source's messages in order."""
    line = F.concat_ws("\x1f", F.col("ordinal").cast("string"), "role", F.sha2("content", 256))
    return messages.groupBy("scope", "source_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))).alias("x")).select("scope", "source_id", F.sha2(F.array_join(F.transform("x", lambda m: m["line"]), "\n"), 256).alias("digest"))


def pipeline_pins(formed: DataFrame) -> DataFrame:
    """The first pipeline version that formed each source."""
    return formed.groupBy("scope", "source_id").agg(F.min_by("version", "arrival").alias("version"))


def missing(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """What recovery has to restore."""
    return expected.join(present.select(*keys), keys, "left_anti")


def retention_of(support: DataFrame) -> DataFrame:
    """A fact's deadline: none if any support has none, else the latest."""
    never = F.bool_or(F.col("retention_until").isNull())
    return support.groupBy("fact_id").agg(F.when(never, None).otherwise(F.max("retention_until")).alias("retention_until"))
