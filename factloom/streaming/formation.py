"""The write path as a stream: observation files in, admitted claims and facts out, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.operators.formation import CLAIM_KEY, supersede


def form_claims(spark: SparkSession, source: str, schema: StructType, store: str, checkpoint: str) -> None:
    """Read claims that arrive as Parquet files and keep the store of accepted ones (`store`, Parquet) as a batch run would.

    Each batch's accepted claims are a part of the store, and what is needed of all before is one row a key, the latest beginning of its
    claims: that state is written with each batch under `store` + "-tops". A batch that is replayed after a failure writes the same parts
    again, so nothing is added twice. Claims that come late, and claims that came before, begin no later than their key's state and are
    not accepted.
    """
    tops = f"{store}-tops"

    def form(batch: DataFrame, epoch: int) -> None:
        fresh = batch.dropDuplicates(["claim_id"])
        old = spark.read.parquet(f"{tops}/{epoch - 1}") if epoch else None
        if old is not None:
            fresh = fresh.join(old, CLAIM_KEY, "left").where(F.col("top").isNull() | (F.col("valid_from") > F.col("top"))).drop("top")
        part = f"{store}/epoch={epoch}"
        supersede(fresh).where("accepted").select(*batch.columns).write.mode("overwrite").parquet(part)
        new = spark.read.schema(batch.schema).parquet(part).groupBy(*CLAIM_KEY).agg(F.max("valid_from").alias("top"))
        if old is not None:
            new = new.unionByName(old).groupBy(*CLAIM_KEY).agg(F.max("top").alias("top"))
        new.write.mode("overwrite").parquet(f"{tops}/{epoch}")

    stream = spark.readStream.schema(schema).parquet(source)
    run(stream, form, checkpoint)


def run(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Work off all that is there, then stop. A service would use a processing-time trigger of a few seconds instead."""
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_activity(events: DataFrame, minutes: int, late: str = "1 hour") -> DataFrame:
    """Calls and refusals in fixed windows of event time; entries later than `late` are left out."""
    window = F.window("occurred_at", f"{minutes} minutes")
    return events.withWatermark("occurred_at", late).groupBy(window, "operation").agg(F.count("*").alias("calls"), F.count_if(F.col("outcome") == "refused").alias("refused")).select(F.col("window.start").alias("start"), "operation", "calls", "refused")
