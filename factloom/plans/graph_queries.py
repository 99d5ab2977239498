"""Registered queries: vectors, communities, history roll-up, documents, streams."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.text import segmented
from factloom.operators import community, compaction, generations, vectors
from factloom.plans.recall_queries import VERSIONS_SQL
from factloom.plans.session import shared_dir, stored
from factloom.schemas import VERBATIM
from factloom.sources import adapters as a
from factloom.sources.adapters import with_shapes
from factloom.streaming import formation as streams
from factloom.streaming import reads

SIZE, K = 64, 10


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector asks for its neighbours among all."""
    return a.vectors(spark, sf_dir).where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "embedding")


def _size(spark: SparkSession, sf_dir: str) -> int:
    return a.vectors(spark, sf_dir).agg(F.max(F.size("embedding"))).first()[0] or 0


def vector_faults(spark, sf_dir):
    rows = vectors.validity(a.vectors(spark, sf_dir), _size(spark, sf_dir))
    return rows.groupBy("generation_id", F.coalesce("fault", F.lit("none")).alias("fault")).agg(F.count("*").alias("vectors"))


def vector_topk(spark, sf_dir):
    found = vectors.exact_topk(a.vectors(spark, sf_dir), _queries(spark, sf_dir), K)
    return found.select("query_id", "item_id", F.round("similarity", 6).alias("similarity"), "place")


def vector_topk_generation(spark, sf_dir):
    """The same within one generation: the filter is on the partition column."""
    found = vectors.exact_topk(a.vectors(spark, sf_dir).where("generation_id = 'g1'"), _queries(spark, sf_dir), 3)
    return found.select("query_id", "item_id", F.round("similarity", 6).alias("similarity"))


def vector_candidates(spark, sf_dir):
    """Approximate neighbours by hyperplane codes, ranked exactly, with the recall that they reach against the exact ones."""
    items, asked = a.vectors(spark, sf_dir), _queries(spark, sf_dir)
    near = vectors.approximate_topk(items, asked, K, _size(spark, sf_dir))
    exact = vectors.exact_topk(items, asked, K).select("query_id", "item_id", F.lit(1).alias("true"))
    return near.join(exact, ["query_id", "item_id"], "left").groupBy("query_id").agg(F.count("*").alias("found"), F.sum(F.coalesce("true", F.lit(0))).alias("true"))


def cosine_pairs(spark, sf_dir):
    """Each vector with the next one."""
    rows = a.vectors(spark, sf_dir).select("item_id", "embedding")
    following = rows.select((F.col("item_id") - 1).alias("item_id"), F.col("embedding").alias("next"))
    return rows.join(following, "item_id").select("item_id", F.round(vectors.cosine(F.col("embedding"), F.col("next")), 6).alias("similarity"))


def stale_vectors(spark, sf_dir):
    """Messages whose stored vector is of another text, or absent."""
    m = a.messages(spark, sf_dir)
    have = m.where("conv_id % 3 <> 0").select("source_id", "ordinal", F.sha2(F.when(F.col("conv_id") % 7 == 0, F.upper("content")).otherwise(F.col("content")), 256).alias("digest"))
    return vectors.missing_vectors(m, have).select("source_id", "ordinal", "digest")


def embedding_page(spark, sf_dir):
    rows = a.messages(spark, sf_dir).select(F.col("conv_id").alias("log_offset"), "ordinal", "source_id", "content")
    return vectors.build_page(rows, (3, 0), 64, 20_000).select("log_offset", "ordinal", "bytes")


def _stub(texts: list[str]) -> np.ndarray:
    """A provider for tests: counts of letters."""
    return np.array([[t.count(chr(97 + i)) for i in range(8)] for t in texts], np.float32)


def embedded_messages(spark, sf_dir):
    """Vectors of all messages by the stub provider."""
    rows = vectors.embed(a.messages(spark, sf_dir), _stub, 8)
    return rows.select("source_id", "ordinal", "digest", F.element_at("embedding", 1).cast("int").alias("a"), F.element_at("embedding", 5).cast("int").alias("e"))


def _logged(spark, sf_dir):
    return a.messages(spark, sf_dir).select("scope", "source_id", "ordinal", "content", F.col("conv_id").alias("log_offset"))


def _started(spark, sf_dir):
    """Each project asks for three generations, for the first again, and for the second again with another model."""
    m = _logged(spark, sf_dir)
    asked = m.select("scope").distinct().selectExpr("scope", "posexplode(split('a m1,b m2,c m1,a m1,b m3', ',')) as (place, ask)")
    asked = asked.selectExpr("scope", "place + 1L as seq", "split_part(ask, ' ', 1) as operation_key", "split_part(ask, ' ', 2) as model")
    return generations.start(spark.createDataFrame([], generations.BUILDS), asked, m)


def generation_starts(spark, sf_dir):
    return _started(spark, sf_dir)[0]


def generation_activation(spark, sf_dir):
    """Two generations of each project built while messages are edited and erased; the first is built again from what it lacks, and both are
    asked to be active."""
    base = f"{shared_dir(spark)}/generations-{uuid.uuid4().hex}"
    then, builds = _logged(spark, sf_dir), stored(_started(spark, sf_dir)[1], "builds")
    k = F.col("log_offset")
    now = then.where(k % 17 != 3).withColumn("content", F.when(k % 13 == 5, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    none = spark.createDataFrame([], "generation_id string, scope string, source_id string, ordinal int, digest string, embedding array<float>")
    generations.write(generations.commit(generations.build(then, none, builds, _stub, 8), now), base)
    first = builds.where("operation_key = 'a'")
    generations.write(generations.commit(generations.build(now, spark.read.parquet(base), first, _stub, 8), now), base)
    vectors, ready = spark.read.parquet(base), builds.withColumn("state", F.lit("ready"))
    said, _ = generations.activate(ready, spark.createDataFrame([], "scope string, generation_id string"), builds.select("scope", "generation_id"), now, vectors)
    return said.join(vectors.groupBy("generation_id").agg(F.count("*").alias("vectors")), "generation_id", "left")


def surface_texts(spark, sf_dir):
    """What the vectors of nations are made of: name, aliases, quotes, within 60 bytes."""
    entities = a.entities(spark, sf_dir).where("entity_type = 'place'").select("entity_id", "canonical_name", F.array(F.lower("canonical_name"), F.upper("canonical_name")).alias("aliases"))
    quotes = a.facts(spark, sf_dir).where("predicate = 'lives_in'").select(F.col("object_id").alias("entity_id"), F.col("statement").alias("quote"))
    return vectors.surface_texts(entities, quotes, 60)


def graph_edges(spark, sf_dir):
    return community.undirected(community.edge_weights(a.facts(spark, sf_dir)))


def _graph(spark, sf_dir):
    """The whole graph of current facts."""
    return community.undirected(community.edge_weights(a.facts(spark, sf_dir)))


def graph_components(spark, sf_dir):
    pairs = _graph(spark, sf_dir)
    return community.components(pairs, lambda d: stored(d, "components")).groupBy("component").agg(F.count("*").alias("nodes"))


def _members(spark, sf_dir):
    pairs = stored(_graph(spark, sf_dir), "pairs")
    labels = community.components(pairs, lambda d: stored(d, "components"))
    return pairs, stored(community.hierarchy(pairs, labels, lambda d: stored(d, "rounds")), "communities")


def community_hierarchy(spark, sf_dir):
    return _members(spark, sf_dir)[1]


def community_quality(spark, sf_dir):
    return community.quality(*_members(spark, sf_dir))


def report_material(spark, sf_dir):
    """Facts inside each nation's community, with their running size."""
    facts = a.facts(spark, sf_dir).where("predicate in ('lives_in', 'located_in')")
    members = facts.select(F.col("object_id").alias("community"), F.col("subject_id").alias("node")).unionByName(facts.select(F.col("object_id").alias("community"), F.col("object_id").alias("node")).distinct())
    return community.report_material(facts, members).select("community", "fact_id", "place", "bytes")


def stale_reports(spark, sf_dir):
    """Reports written at an earlier revision of a source."""
    rows = a.lineage(spark, sf_dir)
    now = community.revisions(rows.where("projection_kind = 'fact'"))
    reports = rows.where("projection_kind = 'community_report'").select(F.col("projection_id").alias("report_id"), "source_id", F.lit(5).cast("long").alias("revision"))
    return community.stale_reports(reports, now)


def _history(spark, sf_dir):
    """Turns of each project's subjects, in order, with a flag for the ones summarised already."""
    obs = a.observations(spark, sf_dir)
    order = Window.partitionBy("scope", "data_subject_id").orderBy("conv_id")
    return obs.withColumn("log_offset", (F.row_number().over(order) - 1).cast("long")).selectExpr("scope", "data_subject_id as subject", "source_id", "log_offset", "characters as size", "log_offset between 2 and 4 as summarised")


HISTORY_SQL = "hist AS (SELECT scope, data_subject_id AS subject, source_id, row_number() OVER (PARTITION BY scope, data_subject_id ORDER BY conv_id) - 1 AS log_offset, characters AS size, count(*) OVER (PARTITION BY scope, data_subject_id) AS n FROM observations), turns AS (SELECT *, log_offset BETWEEN 2 AND 4 AS summarised FROM hist)"


def _logs(spark, sf_dir):
    """Long histories: events as turns of five subjects."""
    return a.table(spark, sf_dir, "events").selectExpr("'p0' as scope", "'u' || (user_id % 5) as subject", "event_id as log_offset")


def _no_segments(spark):
    return spark.createDataFrame([], "scope string, subject string, level int, from_offset long, to_offset long, covered long")


def rollup_plan(spark, sf_dir):
    """First-level segments of every subject's history, beside the turns that are summarised already."""
    return compaction.plan_turns(_history(spark, sf_dir), branch=3, verbatim=2)


def rollup_first_level(spark, sf_dir):
    """First-level segments of long histories."""
    return compaction.roll_up_turns(compaction.compactable(_logs(spark, sf_dir)), _no_segments(spark))


def rollup_levels(spark, sf_dir):
    """Segments of long histories at every level."""
    return compaction.roll_up(_logs(spark, sf_dir), _no_segments(spark), lambda d: stored(d, "rollup"))


def rollup_after_erasure(spark, sf_dir):
    """Every 61st turn is erased with the segments over it; what is written again closes the gaps that this leaves."""
    write = lambda d: stored(d, "rollup")
    turns = _logs(spark, sf_dir)
    first = write(compaction.roll_up(turns, _no_segments(spark), write))
    gone = F.col("log_offset") % 61 == 7
    kept = compaction.after_loss(first, turns.where(gone))
    return compaction.roll_up(turns.where(~gone), kept, write)


def _segments(spark, sf_dir):
    return _history(spark, sf_dir).where("summarised").groupBy("scope", "subject").agg(F.min("log_offset").alias("from_offset"), F.max("log_offset").alias("to_offset"), F.count("*").alias("covered"), F.lit(40).cast("long").alias("size")).withColumn("level", F.lit(1))


def assembled_context(spark, sf_dir):
    return compaction.assemble(_history(spark, sf_dir), _segments(spark, sf_dir), 3000, verbatim=2).groupBy("scope", "subject", "kind").agg(F.count("*").alias("items"), F.sum("size").alias("size"), F.min("from_offset").alias("oldest"))


def segment_lineage(spark, sf_dir):
    rows = compaction.segment_lineage(_segments(spark, sf_dir).withColumn("segment_id", F.concat_ws(":", "scope", "subject")), _history(spark, sf_dir))
    return rows.select("segment_id", "covered", "linked", "complete")


def long_histories(spark, sf_dir):
    """Subjects of each scope whose observations are more than a context keeps as they were said."""
    return compaction.long_histories(a.observations(spark, sf_dir).withColumnRenamed("data_subject_id", "subject"))


def long_event_histories(spark, sf_dir):
    """Subjects whose turns are more than a context keeps as they were said."""
    return compaction.long_histories(_logs(spark, sf_dir))


def document_segments(spark, sf_dir):
    """All documents in pieces of at most 1 KiB; what they join to is compared with the text."""
    docs = a.table(spark, sf_dir, "documents")
    pieces = segmented(docs, 1024)
    joined = pieces.groupBy("id").agg(F.count("*").alias("pieces"), F.max(F.octet_length("piece")).alias("largest"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "piece"))), lambda x: x["piece"]), "").alias("whole"))
    return joined.join(docs.select(F.col("doc_id").alias("id"), "text"), "id").select("id", (F.col("whole") == F.col("text")).alias("lossless"), (F.col("largest") <= 1024).alias("bounded"), F.octet_length("text").alias("bytes"))


def documents_by_label(spark, sf_dir):
    docs, labels = a.table(spark, sf_dir, "documents"), a.table(spark, sf_dir, "labels")
    return docs.select("doc_id", "lang", "n_chars").join(labels, "doc_id", "left").groupBy("lang", "quality", "toxic").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("characters"))


def streamed_claims(spark, sf_dir):
    """Claims that arrive as files in three batches, and some of the first again with the last: what one batch run accepts."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    claims = a.status_claims(spark, sf_dir)
    line = F.col("arrival")["l_linenumber"]
    for came in (line <= 2, line.between(3, 4), (line >= 5) | (line == 1)):
        claims.where(came).write.mode("append").parquet(f"{base}/in")
        streams.form_claims(spark, f"{base}/in", claims.schema, f"{base}/store", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/store").groupBy("object_value").agg(F.count("*").alias("facts"), F.count_distinct("subject_id").alias("subjects"))


def _reads(spark, sf_dir):
    return a.audit(spark, sf_dir).select("entry_id", "principal", "project", "occurred_at")


def daily_reads(spark, sf_dir):
    """Entries of each caller in a project counted in days that begin with an entry."""
    return reads.counted(_reads(spark, sf_dir), 86_400)


def streamed_reads(spark, sf_dir):
    """The same from a stream that is stopped and started twice; a tenth of the entries come a day late. Windows that the last watermark, two
    days before the last entry, has passed."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = _reads(spark, sf_dir)
    came = F.col("occurred_at") + F.when(F.col("entry_id") % 10 == 0, F.expr("interval 1 day")).otherwise(F.expr("interval 0 day"))
    part = F.when(came < F.lit("2024-01-11").cast("timestamp"), 0).when(came < F.lit("2024-01-21").cast("timestamp"), 1).otherwise(2)
    for n in range(3):
        rows.where(part == n).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        out = reads.streamed(stream, 86_400, "2 days").writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
        out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(reads.COUNTED).parquet(f"{base}/out")


def event_windows(spark, sf_dir):
    """Fixed six-hour windows of the ledger."""
    return streams.windowed_activity(a.audit(spark, sf_dir), 360)


QUERIES = {f.__name__: f for f in (
    vector_faults, vector_topk, vector_topk_generation, vector_candidates, cosine_pairs, stale_vectors, embedding_page, embedded_messages, generation_starts, generation_activation, surface_texts, graph_edges, graph_components, community_hierarchy, community_quality,
    report_material, stale_reports, rollup_plan, rollup_first_level, rollup_levels, rollup_after_erasure, assembled_context, segment_lineage, long_histories, long_event_histories, document_segments, documents_by_label, streamed_claims, daily_reads, streamed_reads, event_windows,
)}

_COS = "list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"
_ROLLUP = f"""WITH t AS (SELECT 'u' || (user_id % 5) AS subject, event_id AS o FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY o) - 1 AS i, count(*) OVER (PARTITION BY subject) - {VERBATIM} AS old FROM t),
    g AS (SELECT subject, o, i, l AS level, (8 ** l)::BIGINT AS w FROM r, (SELECT unnest(range(1, {{top}})) AS l) WHERE i < old)
    SELECT 'p0' AS scope, subject, level::INT AS level, min(o) AS from_offset, max(o) AS to_offset, count(*) AS covered FROM g GROUP BY subject, level, w, i // w HAVING count(*) = w"""
#: The least label within so many steps: more than any two nodes of these graphs are apart.
_STEPS = 16
_LABELS = "e AS (SELECT DISTINCT subject_id AS x, object_id AS y FROM facts UNION SELECT object_id, subject_id FROM facts), l0 AS (SELECT x AS node, min(least(x, y)) AS c FROM e GROUP BY 1)" + "".join(
    f", l{i} AS (SELECT x AS node, min(least(n.c, o.c)) AS c FROM e JOIN l{i - 1} n ON n.node = y JOIN l{i - 1} o ON o.node = x GROUP BY 1)" for i in range(1, _STEPS + 1)
)
_READS = """WITH RECURSIVE t AS (SELECT 'u' || user_id AS principal, 'p' || (user_id % 4) AS project, epoch_us(ts) AS us FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
    w AS (SELECT principal, project, min(us) AS start FROM t GROUP BY 1, 2 UNION ALL SELECT w.principal, w.project, min(t.us) FROM w JOIN t ON t.principal = w.principal AND t.project = w.project AND t.us >= w.start + 86400000000 GROUP BY 1, 2),
    c AS (SELECT w.principal, w.project, w.start, count(*) - 1 AS further FROM w JOIN t ON t.principal = w.principal AND t.project = w.project AND t.us >= w.start AND t.us < w.start + 86400000000 GROUP BY 1, 2, 3 HAVING count(*) > 1)
    SELECT principal, project, start, further FROM c"""
ORACLES = {
    "generation_starts": "SELECT scope, seq::BIGINT AS seq, operation_key, outcome FROM (SELECT DISTINCT 'p' || (conv_id % 3) AS scope FROM conversations), (VALUES (1, 'a', 'started'), (2, 'b', 'started'), (3, 'c', 'capacity'), (4, 'a', 'replayed'), (5, 'b', 'conflict')) v(seq, operation_key, outcome)",
    "generation_activation": """WITH m AS (SELECT 'p' || (conv_id % 3) AS scope, conv_id % 13 = 5 AS edited FROM conversations WHERE conv_id % 17 <> 3), n AS (SELECT scope, count(*) AS n, count(*) FILTER (edited) AS edited FROM m GROUP BY 1)
        SELECT scope, scope || '-a' AS generation_id, 0::BIGINT AS lacking, 'activated' AS outcome, n AS vectors FROM n UNION ALL SELECT scope, scope || '-b', edited, CASE WHEN edited > 0 THEN 'incomplete' ELSE 'activated' END, n - edited FROM n""",
    "daily_reads": _READS,
    "streamed_reads": f"{_READS} WHERE ceil((start + 86400000000) / 1000) < (SELECT max(us) // 1000 - 2 * 86400000 FROM t)",
    "vector_faults": with_shapes("vectors", "SELECT generation_id, CASE WHEN len(embedding) <> (SELECT max(len(embedding)) FROM vectors) THEN 'size' ELSE 'none' END AS fault, count(*) AS vectors FROM vectors GROUP BY 1, 2"),
    "vector_topk": with_shapes("vectors", f"s AS (SELECT q.item_id AS query_id, v.item_id, {_COS} AS c FROM vectors q, vectors v WHERE q.item_id % 100 = 0) SELECT query_id, item_id, round(c, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, item_id)::INT AS place FROM s QUALIFY place <= {K}"),
    "vector_topk_generation": with_shapes("vectors", f"s AS (SELECT q.item_id AS query_id, v.item_id, {_COS} AS c FROM vectors q, vectors v WHERE q.item_id % 100 = 0 AND v.generation_id = 'g1') SELECT query_id, item_id, round(c, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, item_id) <= 3"),
    "cosine_pairs": with_shapes("vectors", f"SELECT q.item_id, round({_COS}, 6) AS similarity FROM vectors q JOIN vectors v ON v.item_id = q.item_id + 1"),
    "stale_vectors": with_shapes("messages", "SELECT source_id, ordinal, sha256(content) AS digest FROM messages WHERE conv_id % 3 = 0 OR (conv_id % 7 = 0 AND upper(content) <> content)"),
    "embedding_page": with_shapes("messages", "p AS (SELECT conv_id, ordinal, strlen(content) AS b FROM messages WHERE (conv_id, ordinal) > (3, 0) ORDER BY conv_id, ordinal LIMIT 64), r AS (SELECT *, sum(b) OVER (ORDER BY conv_id, ordinal ROWS UNBOUNDED PRECEDING)::BIGINT AS bytes FROM p) SELECT conv_id AS log_offset, ordinal, bytes FROM r WHERE bytes <= 20000"),
    "embedded_messages": with_shapes("messages", "SELECT source_id, ordinal, sha256(content) AS digest, (length(content) - length(replace(content, 'a', '')))::INT AS a, (length(content) - length(replace(content, 'e', '')))::INT AS e FROM messages"),
    "graph_edges": with_shapes("facts", "SELECT scope, least(subject_id, object_id) AS a, greatest(subject_id, object_id) AS b, count(*)::DOUBLE AS weight FROM facts WHERE subject_id <> object_id GROUP BY 1, 2, 3"),
    "graph_components": with_shapes("facts", f"{_LABELS} SELECT c AS component, count(*) AS nodes FROM l{_STEPS} GROUP BY 1"),
    "report_material": with_shapes("facts", "SELECT object_id AS community, fact_id, row_number() OVER w::INT AS place, sum(strlen(statement) + 1) OVER (w ROWS UNBOUNDED PRECEDING)::BIGINT AS bytes FROM facts WHERE predicate IN ('lives_in', 'located_in') WINDOW w AS (PARTITION BY object_id ORDER BY predicate, fact_id)").replace("row_number() OVER w::INT", "(row_number() OVER w)::INT"),
    "stale_reports": with_shapes("lineage", "n AS (SELECT source_id, count(*) AS now FROM lineage WHERE projection_kind = 'fact' GROUP BY 1) SELECT DISTINCT projection_id AS report_id FROM lineage LEFT JOIN n USING (source_id) WHERE projection_kind = 'community_report' AND coalesce(now, 0) <> 5"),
    "rollup_plan": with_shapes("observations", f"""{HISTORY_SQL}, old AS (SELECT *, CASE WHEN log_offset < 2 THEN 0 ELSE 1 END AS island, max(log_offset) OVER (PARTITION BY scope, subject) AS newest FROM turns WHERE log_offset < n - 2 AND NOT summarised),
        p AS (SELECT *, (row_number() OVER (PARTITION BY scope, subject, island ORDER BY log_offset) - 1) // 3 AS part FROM old), g AS (SELECT scope, subject, island, part, min(log_offset) AS from_offset, max(log_offset) AS to_offset, count(*) AS covered, any_value(n) AS n FROM p GROUP BY 1, 2, 3, 4)
        SELECT scope, subject, from_offset, to_offset, covered FROM g WHERE covered = 3 OR (island = 0 AND n - 2 > 2 AND covered >= 2)"""),
    "rollup_first_level": _ROLLUP.format(top=2),
    "rollup_levels": _ROLLUP.format(top=7),
    "assembled_context": with_shapes("observations", f"""{HISTORY_SQL}, seg AS (SELECT scope, subject, min(log_offset) AS a, max(log_offset) AS b FROM turns WHERE summarised GROUP BY 1, 2), cov AS (SELECT t.scope, t.subject, t.log_offset, a, b FROM turns t JOIN seg USING (scope, subject) WHERE t.summarised AND t.log_offset < t.n - 2),
        items AS (SELECT DISTINCT scope, subject, 'segment' AS kind, a AS from_offset, b AS to_offset, 40 AS size FROM cov UNION ALL SELECT scope, subject, 'turn', log_offset, log_offset, size FROM turns t WHERE NOT EXISTS (SELECT 1 FROM cov c WHERE c.scope = t.scope AND c.subject = t.subject AND c.log_offset = t.log_offset)),
        r AS (SELECT *, sum(size) OVER (PARTITION BY scope, subject ORDER BY to_offset DESC ROWS UNBOUNDED PRECEDING) AS total FROM items) SELECT scope, subject, kind, count(*) AS items, sum(size)::BIGINT AS size, min(from_offset) AS oldest FROM r WHERE total <= 3000 GROUP BY 1, 2, 3"""),
    "segment_lineage": with_shapes("observations", f"{HISTORY_SQL} SELECT scope || ':' || subject AS segment_id, count(*) AS covered, count(*) AS linked, true AS complete FROM turns WHERE summarised GROUP BY 1"),
    "long_histories": with_shapes("observations", "SELECT scope, data_subject_id AS subject, count(*) AS turns FROM observations GROUP BY 1, 2 HAVING count(*) > 8"),
    "long_event_histories": f"SELECT 'p0' AS scope, 'u' || (user_id % 5) AS subject, count(*) AS turns FROM events GROUP BY 2 HAVING count(*) > {VERBATIM}",
    "document_segments": "SELECT doc_id AS id, true AS lossless, true AS bounded, strlen(text)::INT AS bytes FROM documents",
    "documents_by_label": "SELECT lang, quality, toxic, count(*) AS documents, sum(n_chars)::BIGINT AS characters FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2, 3",
    "streamed_claims": with_shapes("claims", f"{VERSIONS_SQL} SELECT object_value, count(*) AS facts, count(DISTINCT subject_id) AS subjects FROM vf GROUP BY 1"),
    "event_windows": with_shapes("audit", "SELECT make_timestamp(epoch_us(occurred_at) // 21600000000 * 21600000000) AS start, operation, count(*) AS calls, count(*) FILTER (outcome = 'refused') AS refused FROM audit GROUP BY 1, 2"),
}
