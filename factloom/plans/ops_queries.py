"""Registered queries: the ledger, measurements, erasure, retention, purge and export."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators import archive, governance, ledger
from factloom.plans.session import shared_dir, stored
from factloom.sources import adapters as a
from factloom.sources.adapters import with_shapes

SUBJECT, BATCH = "u3", 1000


def _window(spark: SparkSession, sf_dir: str) -> tuple[str, str, str]:
    """The last two windows of ten days before the newest entry's next midnight."""
    top = a.audit(spark, sf_dir).agg(F.date_add(F.max("occurred_at"), 1).alias("d")).select(F.date_sub("d", 20).cast("string"), F.date_sub("d", 10).cast("string"), F.col("d").cast("string")).first()
    return tuple(f"{x} 00:00:00" for x in top)


WINDOW_SQL = "win AS (SELECT (max(occurred_at)::DATE + 1)::TIMESTAMP AS u, (max(occurred_at)::DATE - 9)::TIMESTAMP AS m, (max(occurred_at)::DATE - 19)::TIMESTAMP AS s FROM audit)"
WEIGHT_SQL = "CASE WHEN operation = 'freshness' THEN greatest(magnitude, 1) ELSE 1 END"


def ledger_activity(spark, sf_dir):
    return ledger.activity(a.audit(spark, sf_dir), *_window(spark, sf_dir)).withColumn("trend", ledger.trend(F.col("calls"), F.col("calls_before")))


def ledger_buckets(spark, sf_dir):
    since, _, until = _window(spark, sf_dir)
    return ledger.buckets(a.audit(spark, sf_dir), since, until, 7)


def busiest_projects(spark, sf_dir):
    return a.audit(spark, sf_dir).groupBy("project").agg(F.sum(ledger.weight()).alias("calls"), F.count_if(F.col("outcome") == "refused").alias("refused")).orderBy(F.desc("calls"), "project").limit(6)


def recent_entries(spark, sf_dir):
    return a.audit(spark, sf_dir).orderBy(F.desc("occurred_at"), F.desc("entry_id")).limit(50).select("entry_id", "operation", "principal", "outcome")


def last_acted(spark, sf_dir):
    return a.audit(spark, sf_dir).groupBy("principal").agg(F.max("occurred_at").alias("last_at"), F.max_by("operation", F.struct("occurred_at", "entry_id")).alias("last_operation"))


def outcome_mix(spark, sf_dir):
    rows = a.audit(spark, sf_dir)
    return rows.groupBy("operation").agg(F.count("*").alias("entries"), F.count_if(F.col("outcome") == "refused").alias("refused"), F.count_distinct(F.when(F.col("outcome") == "refused", F.col("principal"))).alias("refused_principals"))


def ledger_seals(spark, sf_dir):
    return ledger.seal_ranges(a.audit(spark, sf_dir), BATCH)


def seal_chain(spark, sf_dir):
    return ledger.chain(ledger.seal_ranges(a.audit(spark, sf_dir), BATCH)).select("seal", "digest", "previous", "sealed")


def _damaged(spark, sf_dir):
    """A ledger whose last seal is missing yet, and in which every 3001st magnitude was changed and every 4001st entry removed after sealing."""
    entries = a.audit(spark, sf_dir)
    ranges = ledger.seal_ranges(entries, BATCH)
    seals = stored(ledger.chain(ranges.where(F.col("seal") < ranges.agg(F.max("seal")).first()[0])), "seals")
    changed = entries.withColumn("magnitude", F.when(F.col("entry_id") % 3001 == 3000, F.col("magnitude") + 1).otherwise(F.col("magnitude")))
    return seals, changed.where(F.col("entry_id") % 4001 != 4000)


def chain_verification(spark, sf_dir):
    """The chain against a damaged ledger, seal by seal."""
    seals, entries = _damaged(spark, sf_dir)
    return ledger.verify(seals, entries).select("seal", "entries", F.coalesce("fault", F.lit("none")).alias("fault"))


def ledger_standing(spark, sf_dir):
    """The same in one row: the first failure, the head, and the entries not sealed yet."""
    seals, entries = _damaged(spark, sf_dir)
    return ledger.standing(seals, entries, ledger.verify(seals, entries))


def ledger_files(spark, sf_dir):
    """Archived seals as files of two, read back and verified; one file of three has an entry altered, removed, or moved to another seal."""
    entries = a.audit(spark, sf_dir)
    seals = stored(ledger.chain(ledger.seal_ranges(entries, BATCH)), "seals")
    lines = archive.lines(seals, entries, 2)
    hurt = F.col("file") % 3 == 1
    lines = lines.withColumn("value", F.when(hurt & F.col("entry_id").isNotNull() & (F.col("entry_id") % BATCH == 500), F.regexp_replace("value", "\\|p", "|q")).otherwise(F.col("value")))
    path = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    archive.write(lines, path)
    return archive.verify_files(spark, path).select("file", "valid", "failed_seal", "failure", "seals", "entries", "first_entry", "last_entry", "head")


def ledger_after_archive(spark, sf_dir):
    """What stays when sealed ranges have left: the rest of the entries, chained on from the checkpoint, gives the same seals."""
    entries = a.audit(spark, sf_dir)
    seals = stored(ledger.chain(ledger.seal_ranges(entries, BATCH)), "seals")
    mark = archive.checkpoint(seals, seals.agg(F.max("seal")).first()[0] // 2)
    rest = archive.remaining(entries, mark)
    again = ledger.chain(ledger.seal_ranges(rest, BATCH, mark["through_entry"], mark["through_seal"] + 1), mark["digest"])
    return again.select("seal", "from_id", "to_id", "entries", "previous", "sealed")


def archive_coverage(spark, sf_dir):
    """Seals older than ten days that an archive would take, and their entries."""
    _, middle, _ = _window(spark, sf_dir)
    rows = ledger.ranked(a.audit(spark, sf_dir), BATCH).groupBy(F.floor(F.col("rank") / BATCH).alias("seal")).agg(F.max("occurred_at").alias("newest"), F.count("*").alias("entries"))
    return rows.where(F.col("newest") < F.lit(middle).cast("timestamp")).select("seal", "entries")


def coalesced_reads(spark, sf_dir):
    """Reads in anchored windows of six hours."""
    return ledger.coalesce_reads(a.audit(spark, sf_dir).where("outcome = 'allowed'"), 21_600)


def duration_histograms(spark, sf_dir):
    return ledger.histogram(a.audit(spark, sf_dir), "operation", "magnitude")


def merged_histograms(spark, sf_dir):
    """Daily bucket arrays of each operation, merged."""
    rows = a.audit(spark, sf_dir).groupBy("operation", F.to_date("occurred_at").alias("day")).agg(*[F.count_if(F.col("magnitude") % 3 == i).alias(f"b{i}") for i in range(3)])
    return ledger.merge_histograms(rows.select(F.lit("op").alias("kind"), F.col("operation").alias("name"), F.array("b0", "b1", "b2").alias("buckets"))).select("name", F.array_join(F.transform("buckets", lambda x: x.cast("string")), ",").alias("buckets"))


def drain_rate(spark, sf_dir):
    """Seconds to the next free slot of each principal, from the time between its calls."""
    gap = F.unix_micros("occurred_at") - F.unix_micros(F.lag("occurred_at").over(Window.partitionBy("principal").orderBy("occurred_at", "entry_id")))
    rows = a.audit(spark, sf_dir).withColumn("gap", gap).groupBy("principal").agg(F.avg("gap").alias("mean"))
    return rows.where("mean is not null").select("principal", F.greatest(F.lit(1), F.least(F.lit(3600), F.ceil(F.col("mean") / 1_000_000))).cast("long").alias("retry_after"))


def metering(spark, sf_dir):
    """Calls, refusals and magnitudes by project and operation."""
    return a.audit(spark, sf_dir).groupBy("project", "operation", "outcome").agg(F.count("*").alias("calls"), F.sum("magnitude").alias("magnitude"))


def instance_health(spark, sf_dir):
    """One row about the whole instance."""
    e = a.audit(spark, sf_dir).agg(F.count("*").alias("entries"), F.max("occurred_at").alias("last_entry"), F.count_distinct("principal").alias("principals"))
    m = a.messages(spark, sf_dir).agg(F.count("*").alias("messages"), F.count_distinct("scope").alias("scopes"))
    return e.crossJoin(m)


def metrics_text(spark, sf_dir):
    """Counters as exposition lines."""
    rows = a.audit(spark, sf_dir).groupBy("operation", "outcome").agg(F.count("*").alias("n"))
    return rows.select(F.concat(F.lit('calls_total{operation="'), "operation", F.lit('",outcome="'), "outcome", F.lit('"} '), F.col("n").cast("string")).alias("line"))


def erasure_by_subject(spark, sf_dir):
    return governance.erase_subject(a.lineage(spark, sf_dir), SUBJECT)


def erasure_receipt(spark, sf_dir):
    return governance.receipt(governance.erase_subject(a.lineage(spark, sf_dir), SUBJECT))


def erasure_by_source(spark, sf_dir):
    rows = a.lineage(spark, sf_dir)
    sources = rows.where("source_id in ('o5', 'o105', 'o207')").select("source_id")
    return governance.erase_sources(rows, sources)


def state_after_erasure(spark, sf_dir):
    outcome = governance.erase_subject(a.lineage(spark, sf_dir), SUBJECT)
    return governance.after_erasure(a.facts(spark, sf_dir), outcome, "fact", "fact_id").groupBy("predicate").agg(F.count("*").alias("facts"))


def erasable_sources(spark, sf_dir):
    rows = a.lineage(spark, sf_dir).where(F.col("data_subject_id") == SUBJECT)
    return rows.select("source_id").distinct()


def retention_sweep(spark, sf_dir):
    """The first 40 sources past their retention, and what goes with them."""
    obs = a.lineage(spark, sf_dir).select("source_id").distinct().withColumn("retention_until", F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(cast(substring(source_id, 2) as int) % 200)"))
    expired = governance.expired_sources(obs, "2024-03-01 00:00:00", 40)
    return governance.receipt(governance.erase_sources(a.lineage(spark, sf_dir), expired))


def purge_preview(spark, sf_dir):
    return governance.entity_claimants(a.facts(spark, sf_dir))


def purged_facts(spark, sf_dir):
    return governance.purge_entity(a.facts(spark, sf_dir), "n:3").groupBy("predicate").agg(F.count("*").alias("facts"))


def unreferenced_entities(spark, sf_dir):
    """Entities that nothing refers to once one has been purged."""
    rest = governance.purge_entity(a.facts(spark, sf_dir), "n:3")
    return governance.unreferenced(a.entities(spark, sf_dir), rest).select("entity_id", "entity_type")


def subject_export(spark, sf_dir):
    """All that a person's sources support, however much it is: rows go on as a table."""
    facts = a.facts(spark, sf_dir).select("fact_id", "predicate", "statement", "source_role")
    return governance.export_sections(a.lineage(spark, sf_dir), SUBJECT, {"fact": (facts, "fact_id")}, None)


def dangling_lineage(spark, sf_dir):
    """Lineage rows of facts that a purge has removed."""
    rest = governance.purge_entity(a.facts(spark, sf_dir), "n:3").select(F.col("fact_id").alias("projection_id"))
    return a.lineage(spark, sf_dir).where("projection_kind = 'fact'").join(rest, "projection_id", "left_anti").select("projection_id", "source_id")


def quota_totals(spark, sf_dir):
    rows = a.messages(spark, sf_dir).groupBy("scope").agg(F.sum(F.octet_length("content")).alias("bytes"), F.count("*").alias("objects"))
    return rows.withColumn("over", F.col("bytes") > 20_000)


def vocabulary_coverage(spark, sf_dir):
    """Facts by predicate and role, and documents' facts at the median."""
    rows = a.facts(spark, sf_dir).groupBy("predicate", "source_role").agg(F.count("*").alias("facts"), F.count_distinct("subject_id").alias("subjects"))
    return rows


def facts_per_source(spark, sf_dir):
    per = a.lineage(spark, sf_dir).where("projection_kind = 'fact'").groupBy("source_id").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("sources"), F.expr("percentile_cont(0.5) within group (order by n)").alias("median"), F.max("n").alias("most"))


def degree_distribution(spark, sf_dir):
    ends = a.facts(spark, sf_dir).selectExpr("explode(array(subject_id, object_id)) as entity_id").groupBy("entity_id").agg(F.count("*").alias("n"))
    q = lambda p: F.expr(f"percentile_disc({p}) within group (order by n)")
    return ends.agg(F.count("*").alias("entities"), q(0.5).cast("long").alias("p50"), q(0.9).cast("long").alias("p90"), q(0.99).cast("long").alias("p99"), F.max("n").alias("most"))


def owed_notifications(spark, sf_dir):
    """Newest conversation of each project for two endpoints, once each."""
    top = a.observations(spark, sf_dir).groupBy("scope").agg(F.max("conv_id").alias("formed_through"))
    ends = spark.sql("SELECT * FROM VALUES ('e1'), ('e2'), ('e1') AS t(endpoint_id)")
    return top.join(F.broadcast(ends), F.lit(True)).dropDuplicates(["endpoint_id", "scope", "formed_through"]).select("endpoint_id", "scope", "formed_through")


QUERIES = {f.__name__: f for f in (
    ledger_activity, ledger_buckets, busiest_projects, recent_entries, last_acted, outcome_mix, ledger_seals, seal_chain, chain_verification, ledger_standing, ledger_files, ledger_after_archive, archive_coverage, coalesced_reads, duration_histograms, merged_histograms,
    drain_rate, metering, instance_health, metrics_text, erasure_by_subject, erasure_receipt, erasure_by_source, state_after_erasure, erasable_sources, retention_sweep, purge_preview, purged_facts, unreferenced_entities,
    subject_export, dangling_lineage, quota_totals, vocabulary_coverage, facts_per_source, degree_distribution, owed_notifications,
)}

_LINE = "entry_id || '|' || operation || '|' || principal || '|' || principal_kind || '|' || project || '|' || magnitude || '|' || outcome || '|' || (epoch_us(occurred_at) // 1000000) || '.' || lpad((epoch_us(occurred_at) % 1000000)::VARCHAR, 6, '0')"
SEALS_SQL = f"""ranked AS (SELECT *, (row_number() OVER (ORDER BY entry_id) - 1) // {BATCH} AS seal, {_LINE} AS line FROM audit),
    seals AS (SELECT seal, coalesce(lag(to_id) OVER (ORDER BY seal), -1) + 1 AS from_id, to_id, entries, digest FROM (SELECT seal, max(entry_id) AS to_id, count(*) AS entries, sha256(string_agg(line, chr(10) ORDER BY entry_id)) AS digest FROM ranked GROUP BY 1))"""
CHAIN_SQL = f"""{SEALS_SQL}, ord AS (SELECT *, row_number() OVER (ORDER BY seal) AS i FROM seals),
links AS (SELECT i, seal, digest, repeat('0', 64) AS previous, sha256(from_hex(repeat('0', 64) || digest)) AS sealed FROM ord WHERE i = 1 UNION ALL SELECT o.i, o.seal, o.digest, l.sealed, sha256(from_hex(l.sealed || o.digest)) FROM links l JOIN ord o ON o.i = l.i + 1)"""
_DAMAGE = f"""{SEALS_SQL}, after AS (SELECT seal, string_agg(CASE WHEN entry_id % 3001 = 3000 THEN replace(line, '|' || magnitude || '|' || outcome, '|' || (magnitude + 1) || '|' || outcome) ELSE line END, chr(10) ORDER BY entry_id) AS lines, count(*) AS held
    FROM ranked WHERE entry_id % 4001 <> 4000 GROUP BY 1),
    damage AS (SELECT s.*, CASE WHEN coalesce(held, 0) <> entries THEN 'entries_missing' WHEN sha256(lines) <> digest THEN 'entries_changed' END AS fault FROM seals s LEFT JOIN after USING (seal) WHERE seal < (SELECT max(seal) FROM seals))"""
OUTCOME_SQL = lambda own: f"SELECT scope, projection_kind, projection_id, CASE WHEN projection_kind IN ('chunk', 'fact', 'entity', 'rejected_claim') AND bool_or(NOT ({own})) THEN 'kept' ELSE 'deleted' END AS outcome FROM lineage GROUP BY 1, 2, 3 HAVING bool_or({own})"
_OWN = f"data_subject_id IS NOT DISTINCT FROM '{SUBJECT}'"
_RECEIPT = "SELECT projection_kind, count(*) FILTER (outcome = 'deleted') AS deleted, count(*) FILTER (outcome = 'kept') AS residual FROM o GROUP BY 1"
_ENDS = "ends AS (SELECT fact_id, data_subject_id, predicate, unnest(list_distinct([subject_id, object_id])) AS entity_id FROM facts)"
ORACLES = {
    "ledger_activity": with_shapes("audit", f"""{WINDOW_SQL}, c AS (SELECT operation, coalesce(sum({WEIGHT_SQL}) FILTER (occurred_at >= m), 0)::BIGINT AS calls, coalesce(sum({WEIGHT_SQL}) FILTER (occurred_at < m), 0)::BIGINT AS calls_before, count(*) FILTER (occurred_at >= m AND outcome = 'refused') AS refused, coalesce(sum(magnitude) FILTER (occurred_at >= m), 0)::BIGINT AS magnitude FROM audit, win WHERE occurred_at >= s AND occurred_at < u GROUP BY 1)
        SELECT *, CASE WHEN calls = calls_before THEN 'no change' WHEN calls_before = 0 THEN 'new' WHEN trunc((calls - calls_before) * 100.0 / calls_before) = 0 THEN 'under 1%' ELSE trunc((calls - calls_before) * 100.0 / calls_before)::BIGINT || '%' END AS trend FROM c"""),
    "ledger_buckets": with_shapes("audit", f"{WINDOW_SQL} SELECT least((epoch_us(occurred_at) - epoch_us(s)) // ((epoch_us(u) - epoch_us(s)) // 7), 6)::INT AS bucket, sum({WEIGHT_SQL})::BIGINT AS calls, count(*) FILTER (outcome = 'refused') AS refused FROM audit, win WHERE occurred_at >= s AND occurred_at < u GROUP BY 1"),
    "busiest_projects": with_shapes("audit", f"SELECT project, sum({WEIGHT_SQL})::BIGINT AS calls, count(*) FILTER (outcome = 'refused') AS refused FROM audit GROUP BY 1 ORDER BY calls DESC, project LIMIT 6"),
    "recent_entries": with_shapes("audit", "SELECT entry_id, operation, principal, outcome FROM audit ORDER BY occurred_at DESC, entry_id DESC LIMIT 50"),
    "last_acted": with_shapes("audit", "SELECT principal, max(occurred_at) AS last_at, arg_max(operation, (occurred_at, entry_id)) AS last_operation FROM audit GROUP BY 1"),
    "outcome_mix": with_shapes("audit", "SELECT operation, count(*) AS entries, count(*) FILTER (outcome = 'refused') AS refused, count(DISTINCT principal) FILTER (outcome = 'refused') AS refused_principals FROM audit GROUP BY 1"),
    "ledger_seals": with_shapes("audit", f"{SEALS_SQL} SELECT * FROM seals"),
    "seal_chain": with_shapes("audit", f"{CHAIN_SQL} SELECT seal, digest, previous, sealed FROM links").replace("WITH audit", "WITH RECURSIVE audit", 1),
    "chain_verification": with_shapes("audit", f"{_DAMAGE} SELECT seal, entries, coalesce(fault, 'none') AS fault FROM damage"),
    "ledger_standing": with_shapes("audit", f"""{_DAMAGE}, {CHAIN_SQL.split(", ord AS", 1)[1].join(["ord AS", ""])}
        SELECT NOT coalesce(bool_or(fault IS NOT NULL), false) AS valid, min(seal) FILTER (fault IS NOT NULL) AS first_failure, arg_min(fault, seal) FILTER (fault IS NOT NULL) AS fault, count(*) AS seals,
        (SELECT sealed FROM links WHERE seal = (SELECT max(seal) - 1 FROM seals)) AS head, (SELECT count(*) FROM audit WHERE entry_id % 4001 <> 4000 AND entry_id > (SELECT coalesce(max(to_id), -1) FROM damage)) AS unsealed FROM damage""").replace("WITH audit", "WITH RECURSIVE audit", 1),
    "ledger_files": with_shapes("audit", f"""{CHAIN_SQL}, f AS (SELECT seal // 2 AS file, min(seal) AS seal, max(i) AS i, count(*) AS n FROM links GROUP BY 1), e AS (SELECT seal // 2 AS file, count(*) AS entries, min(entry_id) AS first_entry, max(entry_id) AS last_entry FROM ranked GROUP BY 1),
        bad AS (SELECT seal // 2 AS file, min(seal) AS seal, min(from_id) AS from_id FROM seals WHERE (seal // 2) % 3 = 1 AND EXISTS (SELECT 1 FROM ranked r WHERE r.seal = seals.seal AND r.entry_id % {BATCH} = 500) GROUP BY 1)
        SELECT file, bad.seal IS NULL AS valid, bad.seal AS failed_seal, CASE WHEN bad.seal IS NOT NULL THEN 'entries_changed' END AS failure, CASE WHEN bad.seal IS NULL THEN n ELSE bad.seal - f.seal END AS seals,
        CASE WHEN bad.seal IS NULL THEN e.entries ELSE (SELECT count(*) FROM ranked r WHERE r.seal // 2 = f.file AND r.seal < bad.seal) END AS entries, first_entry,
        CASE WHEN bad.seal IS NULL THEN last_entry ELSE (SELECT max(entry_id) FROM ranked r WHERE r.seal = bad.seal) END AS last_entry,
        CASE WHEN bad.seal IS NULL THEN l.sealed ELSE b.previous END AS head
        FROM f JOIN e USING (file) LEFT JOIN bad USING (file) JOIN links l ON l.i = f.i LEFT JOIN links b ON b.seal = bad.seal""").replace("WITH audit", "WITH RECURSIVE audit", 1),
    "ledger_after_archive": with_shapes("audit", f"{CHAIN_SQL} SELECT l.seal, from_id, to_id, entries, previous, sealed FROM links l JOIN seals s ON s.seal = l.seal WHERE l.seal > (SELECT max(seal) // 2 FROM seals)").replace("WITH audit", "WITH RECURSIVE audit", 1),
    "archive_coverage": with_shapes("audit", f"{WINDOW_SQL}, {SEALS_SQL} SELECT seal, count(*) AS entries FROM ranked GROUP BY 1 HAVING max(occurred_at) < (SELECT m FROM win)"),
    "coalesced_reads": with_shapes("audit", """r AS (SELECT principal, project, occurred_at AS t, row_number() OVER (PARTITION BY principal, project ORDER BY occurred_at) AS i FROM audit WHERE outcome = 'allowed'),
        g AS (SELECT principal, project, t, i, t AS w FROM r WHERE i = 1 UNION ALL SELECT r.principal, r.project, r.t, r.i, CASE WHEN r.t >= g.w + INTERVAL 21600 SECONDS THEN r.t ELSE g.w END FROM g JOIN r ON r.principal = g.principal AND r.project = g.project AND r.i = g.i + 1)
        SELECT principal, project, w AS window_start, 'first' AS kind, 1::BIGINT AS magnitude FROM (SELECT principal, project, w, count(*) AS n FROM g GROUP BY 1, 2, 3) UNION ALL SELECT principal, project, w, 'further', n - 1 FROM (SELECT principal, project, w, count(*) AS n FROM g GROUP BY 1, 2, 3) WHERE n > 1""").replace("WITH audit", "WITH RECURSIVE audit", 1),
    "duration_histograms": with_shapes("audit", "b AS (SELECT operation AS name, len([x FOR x IN [5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000] IF x < magnitude]) AS bucket FROM audit), c AS (SELECT name, bucket, count(*) AS n FROM b GROUP BY 1, 2), g AS (SELECT DISTINCT name, k FROM b, (SELECT unnest(range(0, 12)) AS k)) SELECT g.name, g.k::INT AS bucket, sum(coalesce(n, 0)) OVER (PARTITION BY g.name ORDER BY g.k)::BIGINT AS cumulative FROM g LEFT JOIN c ON c.name = g.name AND c.bucket = g.k"),
    "merged_histograms": with_shapes("audit", "SELECT operation AS name, count(*) FILTER (magnitude % 3 = 0) || ',' || count(*) FILTER (magnitude % 3 = 1) || ',' || count(*) FILTER (magnitude % 3 = 2) AS buckets FROM audit GROUP BY 1"),
    "drain_rate": with_shapes("audit", "g AS (SELECT principal, epoch_us(occurred_at) - epoch_us(lag(occurred_at) OVER (PARTITION BY principal ORDER BY occurred_at, entry_id)) AS gap FROM audit) SELECT principal, greatest(1, least(3600, ceil(avg(gap) / 1000000)))::BIGINT AS retry_after FROM g GROUP BY 1 HAVING avg(gap) IS NOT NULL"),
    "metering": with_shapes("audit", "SELECT project, operation, outcome, count(*) AS calls, sum(magnitude)::BIGINT AS magnitude FROM audit GROUP BY 1, 2, 3"),
    "instance_health": with_shapes("audit messages", "SELECT * FROM (SELECT count(*) AS entries, max(occurred_at) AS last_entry, count(DISTINCT principal) AS principals FROM audit), (SELECT count(*) AS messages, count(DISTINCT scope) AS scopes FROM messages)"),
    "metrics_text": with_shapes("audit", """SELECT 'calls_total{operation="' || operation || '",outcome="' || outcome || '"} ' || count(*) AS line FROM audit GROUP BY operation, outcome"""),
    "erasure_by_subject": with_shapes("lineage", OUTCOME_SQL(_OWN)),
    "erasure_receipt": with_shapes("lineage", f"o AS ({OUTCOME_SQL(_OWN)}) {_RECEIPT}"),
    "erasure_by_source": with_shapes("lineage", OUTCOME_SQL("source_id IN ('o5', 'o105', 'o207')")),
    "state_after_erasure": with_shapes("lineage facts", f"o AS ({OUTCOME_SQL(_OWN)}) SELECT predicate, count(*) AS facts FROM facts WHERE fact_id NOT IN (SELECT projection_id FROM o WHERE projection_kind = 'fact' AND outcome = 'deleted') GROUP BY 1"),
    "erasable_sources": with_shapes("lineage", f"SELECT DISTINCT source_id FROM lineage WHERE data_subject_id = '{SUBJECT}'"),
    "retention_sweep": with_shapes("lineage", f"""ob AS (SELECT DISTINCT source_id, TIMESTAMP '2024-01-01 00:00:00' + to_days((substring(source_id, 2)::INT % 200)::INT) AS r FROM lineage), ex AS (SELECT source_id FROM ob WHERE r <= TIMESTAMP '2024-03-01 00:00:00' ORDER BY r, source_id LIMIT 40),
        mk AS (SELECT l.*, e.source_id IS NOT NULL AS own FROM lineage l LEFT JOIN ex e USING (source_id)), o AS ({OUTCOME_SQL("own").replace("FROM lineage", "FROM mk")}) {_RECEIPT}"""),
    "purge_preview": with_shapes("facts", f"{_ENDS} SELECT entity_id, count(*) AS facts, count(DISTINCT data_subject_id) AS claimants FROM ends GROUP BY 1"),
    "purged_facts": with_shapes("facts", "SELECT predicate, count(*) AS facts FROM facts WHERE subject_id <> 'n:3' AND object_id <> 'n:3' GROUP BY 1"),
    "unreferenced_entities": with_shapes("facts entities", f"{_ENDS.replace('FROM facts', 'FROM facts WHERE subject_id <> $n:3$ AND object_id <> $n:3$'.replace('$', chr(39)))} SELECT entity_id, entity_type FROM entities WHERE entity_id NOT IN (SELECT entity_id FROM ends)"),
    "subject_export": with_shapes("facts lineage", f"""SELECT 'fact' AS section, fact_id AS item_id, '{{"fact_id":"' || fact_id || '","predicate":"' || predicate || '","source_role":"' || source_role || '","statement":"' || statement || '"}}' AS document FROM facts WHERE fact_id IN (SELECT projection_id FROM lineage WHERE projection_kind = 'fact' AND data_subject_id = '{SUBJECT}')"""),
    "dangling_lineage": with_shapes("facts lineage", "SELECT projection_id, source_id FROM lineage WHERE projection_kind = 'fact' AND projection_id NOT IN (SELECT fact_id FROM facts WHERE subject_id <> 'n:3' AND object_id <> 'n:3')"),
    "quota_totals": with_shapes("messages", "SELECT scope, sum(strlen(content))::BIGINT AS bytes, count(*) AS objects, sum(strlen(content)) > 20000 AS over FROM messages GROUP BY 1"),
    "vocabulary_coverage": with_shapes("facts", "SELECT predicate, source_role, count(*) AS facts, count(DISTINCT subject_id) AS subjects FROM facts GROUP BY 1, 2"),
    "facts_per_source": with_shapes("lineage", "p AS (SELECT source_id, count(*) AS n FROM lineage WHERE projection_kind = 'fact' GROUP BY 1) SELECT count(*) AS sources, quantile_cont(n, 0.5)::DOUBLE AS median, max(n) AS most FROM p"),
    "degree_distribution": with_shapes("facts", "d AS (SELECT entity_id, count(*) AS n FROM (SELECT unnest([subject_id, object_id]) AS entity_id FROM facts) GROUP BY 1) SELECT count(*) AS entities, quantile_disc(n, 0.5)::BIGINT AS p50, quantile_disc(n, 0.9)::BIGINT AS p90, quantile_disc(n, 0.99)::BIGINT AS p99, max(n) AS most FROM d"),
    "owed_notifications": with_shapes("observations", "SELECT e AS endpoint_id, scope, max(conv_id) AS formed_through FROM observations, (SELECT unnest(['e1', 'e2']) AS e) GROUP BY 1, 2"),
}
