"""A whole memory state over the driver's tables: every registered kind with lineage, and everything that belongs to sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.erasure import Kind, State
from factloom.schemas import PROJECTION_KINDS
from factloom.sources import adapters as a

SCOPE = "p0"
KINDS = {k: Kind("entity" if k == "entity" else k, "entity_id" if k == "entity" else "projection_id", survives) for k, survives in PROJECTION_KINDS.items()}


def small_hash(text: Column) -> Column:
    """0 to 65,535, the same in both engines."""
    return F.conv(F.substring(F.md5(text), 1, 4), 16, 10).cast("int")


def number() -> Column:
    return F.substring("source_id", 2, 20).cast("long")


def memory_state(spark, sf_dir, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> State:
    """The state of one project: sources of conversations and of facts, every 13th without a person. `keep` writes what most tables read."""
    log = a.messages(spark, sf_dir).select("source_id", "ordinal", "content", "conv_id", "data_subject_id")
    facts = a.lineage(spark, sf_dir).where("projection_kind = 'fact'").selectExpr("projection_id as fact_id", "source_id", "data_subject_id")
    facts = keep(facts, "state-facts")
    sources = log.select("source_id").unionByName(facts.select("source_id")).distinct()
    sources = keep(sources, "state-sources")
    observation = sources.select("source_id", F.when(number() % 13 != 0, F.concat(F.lit("u"), (number() % 11).cast("string"))).alias("data_subject_id"))
    said = log.select("ordinal", "content", "conv_id", "source_id").join(observation, "source_id")
    about = facts.withColumn("entity_id", F.concat_ws(":", F.split_part("fact_id", F.lit(":"), F.lit(2)), F.split_part("fact_id", F.lit(":"), F.lit(3))))
    # What several tables are made of is written once: an erasure reads each of them four times.
    about = keep(about.select("entity_id", "source_id", "data_subject_id").distinct(), "state-about")
    hashed = facts.withColumn("h", small_hash(F.col("fact_id")))
    reports = a.lineage(spark, sf_dir).where("projection_kind = 'community_report'").selectExpr("projection_id", "source_id", "data_subject_id")

    def named(rows: DataFrame, kind: str, name: str) -> DataFrame:
        return rows.select(F.lit(kind).alias("projection_kind"), F.expr(name).alias("projection_id"), "source_id", "data_subject_id")

    made = [
        named(said, "chunk", "'ch:' || source_id || ':' || ordinal"), named(said, "message_embedding", "'me:' || source_id || ':' || ordinal"),
        named(said.where(F.char_length("content") % 7 == 0), "rejected_claim", "'rj:' || source_id || ':' || ordinal"),
        named(said.where("conv_id % 4 = 0"), "agent_artifact", "'ar:' || source_id"), named(said, "segment", "'sg:' || (conv_id div 5)"),
        named(facts, "fact", "fact_id"), named(about, "entity", "entity_id"), named(about, "entity_embedding", "'ee:' || entity_id"),
        named(hashed.where("h % 7 = 0"), "fact_history", "'fh:' || fact_id"), named(hashed.where("h % 11 = 0"), "feedback", "'fb:' || fact_id"),
        named(reports, "community_report", "projection_id"), named(reports, "report_embedding", "'re:' || projection_id"),
    ]
    lineage = made[0]
    for part in made[1:]:
        lineage = lineage.unionByName(part)
    lineage = keep(lineage, "state-lineage")
    here = lambda rows: rows.select(F.lit(SCOPE).alias("scope"), "*")
    tables = {k: here(lineage.where(F.col("projection_kind") == k).select("projection_id").distinct()) for k in KINDS if k != "entity"}
    names = a.entities(spark, sf_dir).select("entity_id", "canonical_name")
    spelled = about.select("entity_id", "source_id").distinct().join(names, "entity_id").withColumn("h", small_hash(F.concat("entity_id", F.lit("/"), "source_id")) % 3)
    spelled = spelled.select("entity_id", "source_id", F.when(F.col("h") == 0, F.upper("canonical_name")).when(F.col("h") == 1, F.lower("canonical_name")).otherwise(F.col("canonical_name")).alias("name"))
    spelled = keep(spelled, "state-spelled")
    aliases = spelled.groupBy("entity_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    entity = about.select("entity_id").distinct().join(names, "entity_id", "left").join(aliases, "entity_id", "left")
    entity = entity.select("entity_id", "canonical_name", F.array_except(F.coalesce("names", F.array().cast("array<string>")), F.array("canonical_name")).alias("aliases"))
    receipt = hashed.groupBy("fact_id", "h").agg(F.min("source_id").alias("source_id"), F.max("source_id").alias("last"))
    receipt = keep(receipt, "state-receipt")
    tables |= {
        "entity": here(entity), "lineage": here(lineage), "observation": here(observation), "message": here(log.select("source_id", "ordinal")),
        "data_subject": here(observation.where("data_subject_id is not null").select("data_subject_id").distinct()),
        "fact_evidence": here(facts.select("fact_id", "source_id").distinct()), "entity_name_receipt": here(spelled),
        "record_retraction": here(receipt.where("h % 17 = 0").select("fact_id", "source_id")), "curated_claim": here(sources.where(number() % 9 == 0)),
        "fact_receipt": here(receipt.select("fact_id", "source_id", F.when(F.col("h") % 6 == 0, F.col("last")).alias("supersession_source"))),
        "fact_receipt_history": here(receipt.where("h % 6 = 0").select("fact_id", "source_id")), "source_extraction": here(sources),
        "fact_generation": here(sources.where(number() % 5 == 0)), "fact_generation_record": here(facts.where(number() % 5 == 0).select("fact_id", "source_id").distinct()),
        "erasure_request": spark.createDataFrame([], "request_id string, scope string, data_subject_id string, by_source boolean, reason string, completed_at timestamp, residual string"),
    }
    return State(tables, KINDS)


_HASH = "('0x' || substr(md5({}), 1, 4))::INT"
#: The same state for DuckDB: CTEs after the shapes `messages`, `lineage` and `entities`.
SQL = f"""fl AS (SELECT projection_id AS fact_id, source_id, data_subject_id, {_HASH.format("projection_id")} AS h FROM lineage WHERE projection_kind = 'fact'),
    src AS (SELECT DISTINCT source_id, substr(source_id, 2)::BIGINT AS k FROM (SELECT source_id FROM messages UNION ALL SELECT source_id FROM fl)),
    observation AS (SELECT source_id, k, CASE WHEN k % 13 <> 0 THEN 'u' || (k % 11) END AS data_subject_id FROM src),
    said AS (SELECT source_id, ordinal, content, conv_id, o.data_subject_id FROM messages JOIN observation o USING (source_id)),
    about AS (SELECT DISTINCT split_part(fact_id, ':', 2) || ':' || split_part(fact_id, ':', 3) AS entity_id, source_id, data_subject_id FROM fl),
    rep AS (SELECT projection_id, source_id, data_subject_id FROM lineage WHERE projection_kind = 'community_report'),
    lin AS (SELECT 'chunk' AS kind, 'ch:' || source_id || ':' || ordinal AS id, source_id, data_subject_id FROM said
        UNION ALL SELECT 'message_embedding', 'me:' || source_id || ':' || ordinal, source_id, data_subject_id FROM said
        UNION ALL SELECT 'rejected_claim', 'rj:' || source_id || ':' || ordinal, source_id, data_subject_id FROM said WHERE length(content) % 7 = 0
        UNION ALL SELECT 'agent_artifact', 'ar:' || source_id, source_id, data_subject_id FROM said WHERE conv_id % 4 = 0
        UNION ALL SELECT 'segment', 'sg:' || (conv_id // 5), source_id, data_subject_id FROM said
        UNION ALL SELECT 'fact', fact_id, source_id, data_subject_id FROM fl
        UNION ALL SELECT 'entity', entity_id, source_id, data_subject_id FROM about UNION ALL SELECT 'entity_embedding', 'ee:' || entity_id, source_id, data_subject_id FROM about
        UNION ALL SELECT 'fact_history', 'fh:' || fact_id, source_id, data_subject_id FROM fl WHERE h % 7 = 0 UNION ALL SELECT 'feedback', 'fb:' || fact_id, source_id, data_subject_id FROM fl WHERE h % 11 = 0
        UNION ALL SELECT 'community_report', projection_id, source_id, data_subject_id FROM rep UNION ALL SELECT 'report_embedding', 're:' || projection_id, source_id, data_subject_id FROM rep),
    kinds AS (SELECT DISTINCT kind, kind IN ('chunk', 'fact', 'entity', 'rejected_claim') AS survives FROM lin),
    spelled AS (SELECT entity_id, source_id, canonical_name, CASE {_HASH.format("entity_id || '/' || source_id")} % 3 WHEN 0 THEN upper(canonical_name) WHEN 1 THEN lower(canonical_name) ELSE canonical_name END AS name
        FROM (SELECT DISTINCT entity_id, source_id FROM about) JOIN entities USING (entity_id)),
    receipt AS (SELECT fact_id, h, min(source_id) AS source_id, CASE WHEN h % 6 = 0 THEN max(source_id) END AS later FROM fl GROUP BY 1, 2),
    owned_by AS (SELECT 'message' AS name, source_id || '/' || ordinal AS row, source_id AS owner FROM messages
        UNION ALL SELECT DISTINCT 'fact_evidence', fact_id || '/' || source_id, source_id FROM fl UNION ALL SELECT 'entity_name_receipt', entity_id || '/' || source_id, source_id FROM spelled
        UNION ALL SELECT 'record_retraction', fact_id, source_id FROM receipt WHERE h % 17 = 0 UNION ALL SELECT 'curated_claim', source_id, source_id FROM src WHERE k % 9 = 0
        UNION ALL SELECT 'fact_receipt', fact_id, source_id FROM receipt UNION ALL SELECT 'fact_receipt', fact_id, later FROM receipt
        UNION ALL SELECT 'fact_receipt_history', fact_id, source_id FROM receipt WHERE h % 6 = 0 UNION ALL SELECT 'fact_receipt_history', fact_id, later FROM receipt WHERE h % 6 = 0
        UNION ALL SELECT n, source_id, source_id FROM src, (SELECT unnest(['source_extraction', 'observation']) AS n) UNION ALL SELECT 'fact_generation', source_id, source_id FROM src WHERE k % 5 = 0
        UNION ALL SELECT DISTINCT 'fact_generation_record', fact_id || '/' || source_id, source_id FROM fl WHERE substr(source_id, 2)::BIGINT % 5 = 0)"""
