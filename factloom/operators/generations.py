"""Generations of vectors: each a model's vectors of a project's messages up to an offset, in a folder of its own. One is started, built from
what it lacks, checked against the texts as they are when it is written, made active when nothing is missing, and dropped as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators.vectors import embed
from factloom.schemas import RETAINED_GENERATIONS

MESSAGE = ["scope", "source_id", "ordinal"]
BUILDS = "scope string, generation_id string, operation_key string, model string, state string, through_offset long"


def start(builds: DataFrame, asked: DataFrame, messages: DataFrame, most: int = RETAINED_GENERATIONS) -> tuple[DataFrame, DataFrame]:
    """What became of each request (`scope, seq, operation_key, model`, in the order of `seq`), and the builds after them.

    A key asked for again is `replayed`, with another model `conflict`; a project keeps `most` generations that are not discarded, beyond
    which a request is `capacity`. A new one reaches to the last message's offset, -1 without any. A project's requests are few: they are
    ranked in one window a project."""
    known = builds.select("scope", "operation_key", F.col("model").alias("_model"))
    kept = builds.where("state <> 'discarded'").groupBy("scope").agg(F.count("*").alias("_kept"))
    first = Window.partitionBy("scope", "operation_key").orderBy("seq")
    rows = asked.join(known, ["scope", "operation_key"], "left").join(kept, "scope", "left").withColumn("_nth", F.row_number().over(first)).withColumn("_first", F.first("model").over(first))
    new = F.col("_model").isNull()
    rank = F.sum(F.when(new & (F.col("_nth") == 1), 1).otherwise(0)).over(Window.partitionBy("scope").orderBy("seq"))
    rows = rows.withColumn("_rank", F.when(new & (F.col("_nth") == 1), rank))
    rows = rows.withColumn("_place", F.first("_rank").over(first) + F.coalesce("_kept", F.lit(0)))
    full, other = new & (F.col("_place") > most), F.coalesce("_model", "_first") != F.col("model")
    rows = rows.withColumn("outcome", F.when(full, "capacity").when(other, "conflict").when(new & (F.col("_nth") == 1), "started").otherwise("replayed"))
    through = messages.groupBy("scope").agg(F.max("log_offset").alias("_through"))
    fresh = rows.where("outcome = 'started'").join(through, "scope", "left")
    name = F.concat_ws("-", "scope", "operation_key")
    made = fresh.select("scope", name.alias("generation_id"), "operation_key", "model", F.lit("building").alias("state"), F.coalesce("_through", F.lit(-1)).cast("long").alias("through_offset"))
    return rows.select("scope", "seq", "operation_key", "outcome"), builds.unionByName(made)


def _due(messages: DataFrame, builds: DataFrame) -> DataFrame:
    """Messages that each generation has to cover, with their digests. Builds are few a project."""
    reach = builds.select("scope", "generation_id", "through_offset")
    return messages.withColumn("digest", F.sha2("content", 256)).join(reach, "scope").where("log_offset <= through_offset").drop("through_offset")


def lacking(messages: DataFrame, vectors: DataFrame, builds: DataFrame) -> DataFrame:
    """Messages that a generation has no vector of their present text for."""
    key = ["generation_id", *MESSAGE, "digest"]
    return _due(messages, builds).join(vectors.select(*key), key, "left_anti")


def build(messages: DataFrame, vectors: DataFrame, builds: DataFrame, provider, size: int) -> DataFrame:
    """Vectors that generations being built lack, by their provider. A build that was lost begins where the stored vectors end. A text that
    several generations or messages share is embedded once."""
    due = lacking(messages, vectors, builds.where("state = 'building'"))
    # `embed` names a text by (source_id, ordinal): here by its digest.
    texts = due.groupBy(F.col("digest").alias("source_id")).agg(F.any_value("content").alias("content")).withColumn("ordinal", F.lit(0))
    made = embed(texts, provider, size).select("digest", "embedding")
    return due.select("generation_id", *MESSAGE, "digest").join(made, "digest")


def commit(vectors: DataFrame, messages: DataFrame) -> DataFrame:
    """Vectors whose message still has the text that they are of: others were edited or erased while the vectors were made."""
    now = messages.select(*MESSAGE, F.sha2("content", 256).alias("digest"))
    return vectors.join(now, [*MESSAGE, "digest"], "left_semi")


def activate(builds: DataFrame, active: DataFrame, asked: DataFrame, messages: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What became of each request to make a generation active (`scope, generation_id`, one a project), and the pointers `scope,
    generation_id` after them: `active` already, `not_found`, `incomplete` while it is not ready or lacks a vector, else `activated`."""
    gaps = lacking(messages, vectors, builds).groupBy("generation_id").agg(F.count("*").alias("_gaps"))
    now = active.select("scope", "generation_id", F.lit(True).alias("_active"))
    rows = asked.join(builds.select("scope", "generation_id", "state"), ["scope", "generation_id"], "left").join(now, ["scope", "generation_id"], "left").join(gaps, "generation_id", "left")
    why = F.when(F.col("state").isNull(), "not_found").when(F.col("_active"), "active").when((F.col("state") != "ready") | F.col("_gaps").isNotNull(), "incomplete").otherwise("activated")
    said = rows.select("scope", "generation_id", F.coalesce("_gaps", F.lit(0)).alias("lacking"), why.alias("outcome"))
    moved = said.where("outcome = 'activated'").select("scope", "generation_id")
    return said, active.join(moved.select("scope"), "scope", "left_anti").unionByName(moved)


def write(vectors: DataFrame, store: str) -> None:
    """Add vectors to the store, a folder a generation."""
    vectors.repartition("generation_id", F.pmod(F.xxhash64("digest"), F.lit(64))).write.mode("append").partitionBy("generation_id").parquet(store)


def drop(spark: SparkSession, store: str, builds: DataFrame, active: DataFrame, generation_id: str) -> DataFrame:
    """Delete a cancelled generation's folder; gives the builds with it discarded. One that is active or being built is refused."""
    row = builds.where(F.col("generation_id") == generation_id).first()
    if row is None or row["state"] == "building" or active.where(F.col("generation_id") == generation_id).take(1):
        raise ValueError(f"generation {generation_id} is absent, active or being built")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/generation_id={generation_id}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return builds.withColumn("state", F.when(F.col("generation_id") == generation_id, "discarded").otherwise(F.col("state")))
