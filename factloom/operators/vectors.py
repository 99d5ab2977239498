"""Vectors: validity, cosine, exact top-k for many queries, candidates by hashing, surface texts, generations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.schemas import SURFACE_BYTES


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Similarity in double precision, within [-1, 1]."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))))


def validity(vectors: DataFrame, size: int, column: str = "embedding") -> DataFrame:
    """What is wrong with each vector: its size, a value that is not finite, or no length; null if nothing."""
    v = F.col(column)
    bad = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull())
    return vectors.select("*", F.when(F.size(v) != size, "size").when(bad, "not_finite").when(~F.exists(v, lambda x: x != 0), "zero").alias("fault"))


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int, block: int = 4096, asked: int = 512, most_queries: int = 100_000) -> DataFrame:
    """`query_id, item_id, similarity`: each query's k nearest items by cosine, ties by item id.

    Queries (`query_id, embedding`) are a stated set of at most `most_queries`, sent to the tasks; each task multiplies blocks of `block`
    items with blocks of `asked` queries and keeps k of each query, so what is shuffled is k rows a query and task.
    """
    rows = queries.select("query_id", "embedding").limit(most_queries + 1).collect()
    if len(rows) > most_queries:
        raise ValueError(f"more than {most_queries} queries")
    ids = np.array([r["query_id"] for r in rows], np.int64)
    unit = np.array([r["embedding"] for r in rows], np.float64)
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True) if len(rows) else unit
    sent = vectors.sparkSession.sparkContext.broadcast((ids, unit))

    def search(batches):
        ids, unit = sent.value
        best = [(np.zeros((len(x), 0)), np.zeros((len(x), 0), np.int64)) for x in (ids[q : q + asked] for q in range(0, len(ids), asked))]
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            item = batch.column("item_id").to_numpy()
            m = np.stack(batch.column("embedding").to_numpy(zero_copy_only=False)).astype(np.float64)
            m /= np.linalg.norm(m, axis=1, keepdims=True)
            for start in range(0, len(item), block):
                part = item[start : start + block]
                for i, (held, named) in enumerate(best):
                    sims = np.concatenate([held, np.clip(unit[i * asked : (i + 1) * asked] @ m[start : start + block].T, -1, 1)], axis=1)
                    names = np.concatenate([named, np.broadcast_to(part, (len(held), len(part)))], axis=1)
                    order = np.lexsort((names, -np.round(sims, 9)), axis=1)[:, :k]
                    best[i] = np.take_along_axis(sims, order, 1), np.take_along_axis(names, order, 1)
        for i, (held, named) in enumerate(best):
            if held.shape[1]:
                own = ids[i * asked : (i + 1) * asked]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, held.shape[1])), pa.array(named.ravel()), pa.array(held.ravel())], ["query_id", "item_id", "similarity"])

    near = vectors.select(F.col("item_id").cast("long").alias("item_id"), "embedding").mapInArrow(search, "query_id long, item_id long, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "item_id")
    return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def hash_codes(size: int, bits: int, tables: int, seed: int) -> np.ndarray:
    """Random hyperplanes: tables x bits x size."""
    return np.random.default_rng(seed).standard_normal((tables, bits, size))


def approximate_topk(vectors: DataFrame, queries: DataFrame, k: int, size: int, bits: int = 6, tables: int = 12, seed: int = 7, probes: int = 7) -> DataFrame:
    """Candidates in the `probes` hyperplane codes nearest to a query in some table, ranked by their exact cosine.

    The nearest codes are the query's own and then those that flip the planes it lies closest to. Each code's items meet its queries in
    one group, salted by item, of which k a query leave.
    """
    planes = hash_codes(size, bits, tables, seed)
    masks = np.arange(1 << bits)
    flipped = (masks[:, None] >> np.arange(bits) & 1).astype(np.float64)

    def code(most: int):
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    m = np.stack(batch.column("embedding").to_numpy(zero_copy_only=False)).astype(np.float64)
                    margins = np.einsum("tbs,ns->ntb", planes, m)
                    own = (margins > 0) @ (1 << np.arange(bits))
                    nearest = np.argsort((margins**2) @ flipped.T, axis=2, kind="stable")[:, :, :most] if most > 1 else np.zeros((*own.shape, 1), np.int64)
                    codes = (own[:, :, None] ^ nearest) + (np.arange(tables) * (1 << bits))[:, None]
                    yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("embedding"), pa.array(list(codes.reshape(len(m), -1).astype(np.int32)), pa.list_(pa.int32()))], ["id", "embedding", "codes"])

        return run

    def search(asked: pa.Table, items: pa.Table) -> pa.Table:
        unit = []
        for table in (asked, items) if asked.num_rows and items.num_rows else ():
            m = np.stack(table.column("embedding").to_numpy()).astype(np.float64)
            unit.append(m / np.linalg.norm(m, axis=1, keepdims=True))
        out = [[], [], []]
        if unit:
            query, item = asked.column("id").to_numpy(), items.column("id").to_numpy()
            for start in range(0, len(query), 1024):
                sims = np.clip(unit[0][start : start + 1024] @ unit[1].T, -1, 1)
                order = np.lexsort((np.broadcast_to(item, sims.shape), -np.round(sims, 9)), axis=1)[:, :k]
                for place, column in zip(out, (np.repeat(query[start : start + 1024], order.shape[1]), item[order].ravel(), np.take_along_axis(sims, order, 1).ravel())):
                    place.append(column)
        columns = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "item_id", "similarity"])

    schema = "id long, embedding array<float>, codes array<int>"
    salts = 4 + vectors.count() // (4096 << bits)
    left = queries.selectExpr("cast(query_id as long) as id", "embedding").mapInArrow(code(probes), schema).select("id", "embedding", F.explode("codes").alias("code"))
    left = left.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    right = vectors.selectExpr("cast(item_id as long) as id", "embedding").mapInArrow(code(1), schema).select("id", "embedding", F.explode("codes").alias("code"))
    right = right.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    near = left.groupBy("code", "salt").cogroup(right.groupBy("code", "salt")).applyInArrow(search, "query_id long, item_id long, similarity double")
    ranked = near.groupBy("query_id", "item_id").agg(F.max("similarity").alias("similarity"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "item_id")
    return ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def surface_texts(entities: DataFrame, quotes: DataFrame, budget: int = SURFACE_BYTES) -> DataFrame:
    """What an entity's vector is made of: its name, then aliases, then quotes, sorted and distinct; an item that would overflow is skipped."""
    q = quotes.groupBy("entity_id").agg(F.array_sort(F.collect_set("quote")).alias("quotes"))
    rows = entities.join(q, "entity_id", "left").select("entity_id", "canonical_name", F.array_sort("aliases").alias("aliases"), F.coalesce("quotes", F.array().cast("array<string>")).alias("quotes"))

    def fold(start: Column, items: Column, mark: str) -> Column:
        return F.aggregate(items, start, lambda t, x: F.when(F.octet_length(t) + F.octet_length(x) + len(mark) <= budget, F.concat(t, F.lit(mark), x)).otherwise(t))

    return rows.select("entity_id", fold(fold(F.col("canonical_name"), F.col("aliases"), " | "), F.col("quotes"), "\n").alias("surface"))


def missing_vectors(messages: DataFrame, vectors: DataFrame) -> DataFrame:
    """Messages without a vector of their current text."""
    digests = messages.withColumn("digest", F.sha2("content", 256))
    return digests.join(vectors.select("source_id", "ordinal", "digest"), ["source_id", "ordinal", "digest"], "left_anti")


def build_page(messages: DataFrame, after: tuple[int, int], items: int = 64, most_bytes: int = 1 << 20) -> DataFrame:
    """The next messages to embed after a cursor (offset, ordinal): a bounded number and size."""
    page = messages.where(F.struct(F.col("log_offset").cast("long"), F.col("ordinal").cast("int")) > F.struct(F.lit(after[0]).cast("long"), F.lit(after[1]).cast("int"))).orderBy("log_offset", "ordinal").limit(items)
    run = F.sum(F.octet_length("content")).over(Window.orderBy("log_offset", "ordinal").rowsBetween(Window.unboundedPreceding, 0))
    return page.withColumn("bytes", run).where(F.col("bytes") <= most_bytes)


def embed(messages: DataFrame, provider, size: int) -> DataFrame:
    """Vectors of messages by a provider (list of texts -> array of shape n x size), a batch at a time."""

    def run(batches):
        for batch in batches:
            v = np.asarray(provider(batch.column("content").to_pylist()), np.float32).reshape(-1, size)
            yield pa.RecordBatch.from_arrays([batch.column("source_id"), batch.column("ordinal"), batch.column("digest"), pa.array(list(v), pa.list_(pa.float32()))], ["source_id", "ordinal", "digest", "embedding"])

    rows = messages.select("source_id", F.col("ordinal").cast("int").alias("ordinal"), F.sha2("content", 256).alias("digest"), "content")
    return rows.mapInArrow(run, "source_id string, ordinal int, digest string, embedding array<float>")
