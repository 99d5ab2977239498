"""Erasure, retention, purge and export over lineage. Nothing is updated in place: a function takes a state and returns the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.schemas import PROJECTION_KINDS

ROW = ["scope", "projection_kind", "projection_id"]


def survives_sharing():
    return F.col("projection_kind").isin([k for k, v in PROJECTION_KINDS.items() if v])


def erase_subject(lineage: DataFrame, data_subject: str) -> DataFrame:
    """What an erasure of one subject does to each derived row it touches: `..., outcome` deleted or kept.

    A row of a kind that survives sharing is kept while a source of anybody else, or of nobody, supports it too.
    """
    own = F.col("data_subject_id").eqNullSafe(F.lit(data_subject))
    rows = lineage.groupBy(*ROW).agg(F.bool_or(own).alias("own"), F.bool_or(~own).alias("foreign")).where("own")
    return rows.select(*ROW, F.when(survives_sharing() & F.col("foreign"), "kept").otherwise("deleted").alias("outcome"))


def erase_sources(lineage: DataFrame, sources: DataFrame) -> DataFrame:
    """The same for a set of sources: rows that another source supports too are kept if their kind allows."""
    marked = lineage.join(sources.select("source_id").distinct().withColumn("_own", F.lit(True)), "source_id", "left")
    own = F.coalesce("_own", F.lit(False))
    rows = marked.groupBy(*ROW).agg(F.bool_or(own).alias("own"), F.bool_or(~own).alias("foreign")).where("own")
    return rows.select(*ROW, F.when(survives_sharing() & F.col("foreign"), "kept").otherwise("deleted").alias("outcome"))


def after_erasure(rows: DataFrame, outcome: DataFrame, kind: str, id_col: str) -> DataFrame:
    """A projection's rows without the deleted ones."""
    gone = outcome.where((F.col("projection_kind") == kind) & (F.col("outcome") == "deleted")).select(F.col("projection_id").alias(id_col))
    return rows.join(gone, id_col, "left_anti")


def receipt(outcome: DataFrame) -> DataFrame:
    """Deleted and residual rows by kind."""
    return outcome.groupBy("projection_kind").agg(F.count_if(F.col("outcome") == "deleted").alias("deleted"), F.count_if(F.col("outcome") == "kept").alias("residual"))


def receipt_map(outcome: DataFrame) -> DataFrame:
    """The receipt as two maps in one row."""
    pairs = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("projection_kind", c))))
    return receipt(outcome).agg(pairs("deleted").alias("deleted"), pairs("residual").alias("residual"))


def expired_sources(observations: DataFrame, now: str, most: int) -> DataFrame:
    """Sources past their retention, oldest first; a sweep takes at most `most`."""
    return observations.where(F.col("retention_until") <= F.lit(now).cast("timestamp")).orderBy("retention_until", "source_id").limit(most)


def entity_claimants(facts: DataFrame) -> DataFrame:
    """For each entity its facts and the data subjects who claim something of it: what a purge would remove."""
    ends = facts.selectExpr("fact_id", "data_subject_id", "explode(array_distinct(array(subject_id, object_id))) as entity_id").where("entity_id is not null")
    return ends.groupBy("entity_id").agg(F.count("*").alias("facts"), F.count_distinct("data_subject_id").alias("claimants"))


def purge_entity(facts: DataFrame, entity_id: str) -> DataFrame:
    return facts.where(~F.coalesce(F.col("subject_id") == entity_id, F.lit(False)) & ~F.coalesce(F.col("object_id") == entity_id, F.lit(False)))


def unreferenced(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """Entities at neither end of any fact."""
    used = facts.selectExpr("explode(array(subject_id, object_id)) as entity_id")
    return entities.join(used, "entity_id", "left_anti")


def export_sections(lineage: DataFrame, data_subject: str, sections: dict[str, tuple[DataFrame, str]], ceiling: int | None = 50_000) -> DataFrame:
    """`section, item_id, document` (JSON) of everything that a subject's sources support; sections over the ceiling raise, None has none."""
    own = lineage.where(F.col("data_subject_id") == data_subject)
    out = None
    for kind, (rows, id_col) in sections.items():
        ids = own.where(F.col("projection_kind") == kind).select(F.col("projection_id").alias(id_col)).distinct()
        part = rows.join(ids, id_col, "left_semi").select(F.lit(kind).alias("section"), F.col(id_col).alias("item_id"), F.to_json(F.struct(*sorted(rows.columns))).alias("document"))
        out = part if out is None else out.unionByName(part)
    if ceiling is not None and out.groupBy("section").count().where(F.col("count") > ceiling).take(1):
        raise ValueError(f"a section has more than {ceiling} rows")
    return out
