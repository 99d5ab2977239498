"""Registered queries: the log, admission, names, accounts, rebuilds and recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.text import citation_window, normalised
from factloom.operators import formation, log
from factloom.sources import adapters as a
from factloom.sources.adapters import with_shapes
from factloom.schemas import SPEAKER_TERMS

UNRESOLVABLE = ["it", "they", "this", "that", "he", "she"]
NOW = "2024-03-01 00:00:00"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = a.messages(spark, sf_dir)
    return m.groupBy("scope", "source_id", "data_subject_id", "occurred_at").agg(F.array_sort(F.collect_list(F.struct("ordinal", "role", "content"))).alias("messages"))


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with the state of their formation, by a fixed rule of their offset."""
    rows = log.with_offsets(a.observations(spark, sf_dir), ["occurred_at", "source_id"])
    return rows.selectExpr(
        "scope", "source_id", "data_subject_id", "occurred_at", "log_offset", "characters", "log_offset % 29 = 7 as parked", "log_offset < 20 or log_offset % 3 = 0 as formed", "cast(log_offset % 5 as int) as attempts",
        "occurred_at + make_dt_interval(30) as last_attempt_at", "case when log_offset % 4 = 0 then occurred_at + make_dt_interval(45) end as retention_until",
    )


STATES_SQL = """
off AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY occurred_at, source_id) - 1 AS log_offset FROM observations),
states AS (SELECT scope, source_id, data_subject_id, occurred_at, log_offset, characters, log_offset % 29 = 7 AS parked, log_offset < 20 OR log_offset % 3 = 0 AS formed, (log_offset % 5)::INT AS attempts,
 occurred_at + to_days(30) AS last_attempt_at, CASE WHEN log_offset % 4 = 0 THEN occurred_at + to_days(45) END AS retention_until FROM off)"""


def append_turns(spark, sf_dir):
    obs, msgs, lineage = log.append_turns(_turns(spark, sf_dir))
    n = msgs.groupBy("source_id").agg(F.count("*").alias("messages"))
    k = lineage.groupBy("source_id").agg(F.count("*").alias("lineage_rows"))
    return obs.join(n, "source_id").join(k, "source_id").select("scope", "source_id", "log_offset", "messages", "lineage_rows")


def turn_keys(spark, sf_dir):
    digest = log.turn_digest(F.col("source_id"), F.col("role"), F.col("content"))
    rows = a.messages(spark, sf_dir).where("ordinal = 0").withColumn("digest", digest)
    return rows.select("source_id", "digest", F.substring(log.uuid_of(F.col("digest")), 1, 14).alias("uuid_head"))


def retried_appends(spark, sf_dir):
    """First messages sent again: replays, and conflicts where the text was changed."""
    first = a.messages(spark, sf_dir).where("ordinal = 0").select("scope", F.col("source_id").alias("key"), "content", "conv_id")
    stored = first.where("conv_id % 2 = 0").select("scope", "key", F.sha2("content", 256).alias("digest"))
    erased = first.where("conv_id % 10 = 1").select("scope", "key")
    sent = first.select("scope", "key", F.sha2(F.when(F.col("conv_id") % 6 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")), 256).alias("digest"))
    return log.classify_retries(sent, stored, erased).groupBy("outcome").agg(F.count("*").alias("attempts"))


def turn_validity(spark, sf_dir):
    return log.validate_turns(a.messages(spark, sf_dir), most_messages=4, message_bytes=400, turn_bytes=1200)


def log_freshness(spark, sf_dir):
    return log.freshness(_states(spark, sf_dir))


def due_turns(spark, sf_dir):
    return log.fair_pass(log.due_work(_states(spark, sf_dir), NOW), 8).select("scope", "source_id", "log_offset", "nth")


def backlog_ages(spark, sf_dir):
    return log.backlog_by_age(_states(spark, sf_dir))


def turn_characters(spark, sf_dir):
    return a.observations(spark, sf_dir).select("source_id", "messages", "characters")


def parked_turns(spark, sf_dir):
    """A keyset page of parked turns."""
    return _states(spark, sf_dir).where("parked").where(F.struct("scope", "log_offset") > F.struct(F.lit("p0"), F.lit(40))).orderBy("scope", "log_offset").limit(50).select("scope", "log_offset", "source_id", "attempts")


def _admitted(spark, sf_dir):
    return formation.admit(a.proposals(spark, sf_dir), a.vocabulary(spark), UNRESOLVABLE)


def admission(spark, sf_dir):
    return _admitted(spark, sf_dir).select("source_id", "ordinal", "predicate", "subject_norm", "object_norm", "byte_start", "byte_end", "object_type", "reason")


def refusal_summary(spark, sf_dir):
    return _admitted(spark, sf_dir).where("reason is not null").groupBy("reason", "predicate").agg(F.count("*").alias("claims")).orderBy(F.desc("claims"), "reason", "predicate").limit(20)


def speaker_binding(spark, sf_dir):
    """Claims whose subject stands for the speaker, with every fifth word put as `I`."""
    rows = a.proposals(spark, sf_dir).withColumn("subject_norm", F.when(F.char_length("content") % 5 == 0, "i").otherwise(normalised(F.col("subject"))))
    bound = formation.bind_speakers(rows.withColumn("data_subject_id", F.when(F.col("ordinal") % 4 != 3, F.col("data_subject_id"))))
    return bound.groupBy("role", F.coalesce("speaker_reason", F.lit("none")).alias("reason"), F.col("speaker_subject_id").isNotNull().alias("bound")).agg(F.count("*").alias("claims"))


def entity_resolution(spark, sf_dir):
    """Subjects of proposals as entities; spellings that differ in case are aliases."""
    names = a.proposals(spark, sf_dir).select("scope", F.col("subject").alias("name"), F.struct(F.substring("source_id", 2, 20).cast("long").alias("o"), "ordinal").alias("arrival"))
    return formation.resolve_entities(names).select("scope", "normalized_name", "canonical_name", F.array_join("aliases", ",").alias("aliases"))


def claim_ids(spark, sf_dir):
    rows = _admitted(spark, sf_dir).where("reason is null")
    return rows.select("source_id", "ordinal", "predicate", formation.claim_identity("scope", "source_id", "ordinal", "predicate", "subject_norm", "object_norm").alias("claim_id"))


def accounts(spark, sf_dir):
    """Facts by account: nobody's in a shared project, else their data subject's."""
    projects = spark.sql("SELECT * FROM VALUES ('p0', 'separate'), ('p1', 'shared') AS t(scope, statements)")
    rows = a.messages(spark, sf_dir).select("scope", "data_subject_id", "source_id")
    return formation.account_of(rows, projects).groupBy("scope", "account").agg(F.count("*").alias("rows"))


def retention_deadlines(spark, sf_dir):
    """Deadline of each fact over its sources: none if one of them has none."""
    states = _states(spark, sf_dir).select("source_id", "retention_until")
    support = a.lineage(spark, sf_dir).where("projection_kind = 'fact'").join(states, "source_id").select(F.col("projection_id").alias("fact_id"), "retention_until")
    return formation.retention_of(support)


def _versioned(spark, sf_dir):
    return a.facts(spark, sf_dir).where("predicate = 'lives_in'").withColumn("version", F.lit(1)).withColumn("k", F.substring("subject_id", 3, 20).cast("long"))


def retractions(spark, sf_dir):
    facts = _versioned(spark, sf_dir)
    wanted = facts.where("k % 4 = 0").select("fact_id", F.when(F.col("k") % 8 == 0, 1).otherwise(7).alias("version"))
    return formation.retract(facts, wanted, NOW).groupBy("version", F.col("known_to").isNotNull().alias("closed")).agg(F.count("*").alias("facts"))


def corrections(spark, sf_dir):
    facts = _versioned(spark, sf_dir)
    wanted = facts.where("k % 6 = 0").select("fact_id", F.lit(1).alias("version"), F.lit("n:0").alias("new_object_id"))
    closed, authored = formation.correct(facts, wanted, NOW)
    return authored.select("fact_id", "object_id", "known_from").join(closed.select(F.concat("fact_id", F.lit(":corrected")).alias("fact_id"), "known_to"), "fact_id")


def blocked_claims(spark, sf_dir):
    """Admitted claims without those that a retraction holds back."""
    rows = _admitted(spark, sf_dir).where("reason is null").withColumn("signature", F.concat_ws("|", "predicate", "subject_norm", "object_norm"))
    held = rows.where(F.substring("source_id", 2, 20).cast("long") % 3 == 0).select("scope", "source_id", "signature")
    return formation.blocked(rows, held).groupBy("predicate").agg(F.count("*").alias("claims"))


def generation_rebuild(spark, sf_dir):
    """A second generation for a third of the sources: open facts retire, except curated ones."""
    base = a.lineage(spark, sf_dir).where("projection_kind = 'fact'").select(F.concat_ws("/", "projection_id", "source_id").alias("fact_id"), "source_id").withColumn("n", F.substring("source_id", 2, 20).cast("long"))
    facts = base.select("fact_id", "source_id", F.when(F.col("n") % 5 == 0, "curated").otherwise("extracted").alias("kind"), F.lit(None).cast("timestamp").alias("known_to"))
    sources = base.where("n % 3 = 0").select("source_id")
    fresh = base.select(F.concat("fact_id", F.lit("#2")).alias("fact_id"), "source_id", F.lit("extracted").alias("kind"))
    return formation.rebuild_generation(facts, fresh, sources, NOW).groupBy("kind", F.col("known_to").isNotNull().alias("retired")).agg(F.count("*").alias("facts"))


def source_snapshots(spark, sf_dir):
    return formation.source_snapshot(a.messages(spark, sf_dir))


def pipeline_pins(spark, sf_dir):
    rows = a.messages(spark, sf_dir).select("scope", "source_id", F.concat(F.lit("v"), F.col("ordinal").cast("string")).alias("version"), F.col("ordinal").alias("arrival"))
    return formation.pipeline_pins(rows)


def missing_rows(spark, sf_dir):
    """Facts of the lineage that a store of two thirds of them lacks."""
    expected = a.lineage(spark, sf_dir).where("projection_kind = 'fact'").select(F.col("projection_id").alias("fact_id")).distinct()
    present = a.facts(spark, sf_dir).where("hash(fact_id) is not null and source_role <> 'tool'").select("fact_id")
    return formation.missing(expected, present, ["fact_id"])


def citation_windows(spark, sf_dir):
    rows = _admitted(spark, sf_dir).where("reason is null").select("source_id", "ordinal", "predicate", citation_window(F.col("content"), F.col("byte_start"), F.col("byte_end"), 16).alias("w"))
    return rows.select("source_id", "ordinal", "predicate", F.col("w.first").alias("first"), F.octet_length("w.bytes").alias("bytes"), F.sha2("w.bytes", 256).alias("digest"))


def evidence_bytes(spark, sf_dir):
    """Evidence whose bytes are not its quote: none may be, but for quotes found with other white space."""
    rows = _admitted(spark, sf_dir).where("reason is null")
    own = F.substring(F.encode("content", "UTF-8"), F.col("byte_start") + 1, F.col("byte_end") - F.col("byte_start"))
    return rows.agg(F.count("*").alias("claims"), F.count_if(own == F.encode("quote", "UTF-8")).alias("exact"))


def unknown_predicates(spark, sf_dir):
    """Proposals whose predicate, or its cardinality, the vocabulary lacks."""
    return a.proposals(spark, sf_dir).join(F.broadcast(a.vocabulary(spark)), "predicate", "left_anti").groupBy("predicate").agg(F.count("*").alias("claims"), F.count_distinct("source_id").alias("sources"))


def speaker_turn_order(spark, sf_dir):
    """Messages that do not change the speaker, by lag over each source."""
    before = F.lag("role").over(Window.partitionBy("source_id").orderBy("ordinal"))
    return a.messages(spark, sf_dir).withColumn("same", F.coalesce(before == F.col("role"), F.lit(False))).groupBy("scope").agg(F.count("*").alias("messages"), F.count_if("same").alias("repeated"))


QUERIES = {f.__name__: f for f in (
    append_turns, turn_keys, retried_appends, turn_validity, log_freshness, due_turns, backlog_ages, turn_characters, parked_turns, admission, refusal_summary, speaker_binding, entity_resolution, claim_ids, accounts,
    retention_deadlines, retractions, corrections, blocked_claims, generation_rebuild, source_snapshots, pipeline_pins, missing_rows, citation_windows, evidence_bytes, unknown_predicates, speaker_turn_order,
)}

_QUOTED = ", ".join(f"'{w}'" for w in UNRESOLVABLE)
ADMIT_SQL = f"""
loc AS (SELECT p.*, v.semantic_type, v.object_kind, v.event, lower(trim(regexp_replace(subject, '\\s+', ' ', 'g'))) AS subject_norm, lower(trim(regexp_replace(object, '\\s+', ' ', 'g'))) AS object_norm,
 CASE WHEN trim(quote) <> '' AND instr(content, quote) > 0 THEN strlen(left(content, instr(content, quote) - 1)) END AS byte_start FROM proposals p LEFT JOIN vocabulary v USING (predicate)),
gated AS (SELECT *, byte_start + strlen(quote) AS byte_end, CASE WHEN semantic_type IS NULL THEN 'unmapped_relation' WHEN subject_norm IN ({_QUOTED}) OR subject_norm = '' THEN 'unresolvable_subject' WHEN object_norm IN ({_QUOTED}) OR object_norm = '' THEN 'unresolvable_object'
 WHEN byte_start IS NULL THEN 'unlocatable_quote' WHEN polarity <> 'asserted' THEN 'not_asserted' WHEN tense <> 'present' AND NOT (tense = 'past' AND event) THEN 'not_current' END AS gate FROM loc),
adm AS (SELECT * REPLACE (CASE WHEN object_type IN ('person', 'organisation', 'place', 'thing', 'event', 'concept') THEN object_type ELSE object_kind END AS object_type), coalesce(gate, CASE WHEN gate IS NULL AND
 row_number() OVER (PARTITION BY scope, source_id, ordinal, predicate, subject_norm, object_norm, gate IS NULL ORDER BY quote, byte_start) > 1 THEN 'duplicate_claim' END) AS reason FROM gated)"""
_A = "proposals vocabulary"
_SPEAKERS = ", ".join(f"'{w}'" for w in SPEAKER_TERMS)
ORACLES = {
    "append_turns": with_shapes("observations", "SELECT scope, source_id, (row_number() OVER (PARTITION BY scope ORDER BY occurred_at, source_id) - 1)::INT AS log_offset, messages, messages AS lineage_rows FROM observations"),
    "turn_keys": with_shapes("messages", "d AS (SELECT source_id, sha256(strlen(source_id) || ':' || source_id || ',' || strlen(role) || ':' || role || ',' || strlen(content) || ':' || content || ',') AS digest FROM messages WHERE ordinal = 0) SELECT source_id, digest, substring(digest, 1, 8) || '-' || substring(digest, 9, 4) || '-' || '5' AS uuid_head FROM d").replace("|| '-' || '5' AS uuid_head", "|| '-' AS uuid_head"),
    "retried_appends": with_shapes("messages", """f AS (SELECT *, CASE WHEN conv_id % 6 = 0 THEN content || '!' ELSE content END AS sent FROM messages WHERE ordinal = 0)
        SELECT CASE WHEN conv_id % 10 = 1 THEN 'erased' WHEN conv_id % 2 <> 0 THEN 'new' WHEN sent = content THEN 'replay' ELSE 'conflict' END AS outcome, count(*) AS attempts FROM f GROUP BY 1"""),
    "turn_validity": with_shapes("messages", """r AS (SELECT scope, source_id, count(*) AS n, count(*) FILTER (role NOT IN ('user', 'assistant', 'tool', 'system')) AS bad, count(*) FILTER (trim(content) = '') AS blank, max(strlen(content)) AS longest, sum(strlen(content)) AS b, count(DISTINCT ordinal) AS o FROM messages GROUP BY 1, 2)
        SELECT scope, source_id, n AS messages, b::BIGINT AS bytes, CASE WHEN n > 4 THEN 'too_many_messages' WHEN bad > 0 THEN 'unknown_role' WHEN blank > 0 THEN 'blank_message' WHEN longest > 400 THEN 'message_too_long' WHEN b > 1200 THEN 'turn_too_long' WHEN o < n THEN 'repeated_ordinal' END AS reason FROM r"""),
    "log_freshness": with_shapes("observations", f"{STATES_SQL} SELECT scope, max(log_offset)::INT AS stored, (CASE WHEN min(log_offset) FILTER (NOT formed AND NOT parked) IS NULL THEN max(log_offset) WHEN min(log_offset) FILTER (NOT formed AND NOT parked) > 0 THEN min(log_offset) FILTER (NOT formed AND NOT parked) - 1 END)::INT AS formed, count(*) FILTER (parked) AS parked FROM states GROUP BY 1"),
    "due_turns": with_shapes("observations", f"{STATES_SQL} SELECT scope, source_id, log_offset::INT AS log_offset, (row_number() OVER (PARTITION BY scope ORDER BY log_offset))::INT AS nth FROM states WHERE NOT formed AND NOT parked AND attempts < 6 AND (attempts = 0 OR last_attempt_at + to_seconds((30 * pow(2, least(greatest(attempts - 1, 0), 6)))::BIGINT) <= TIMESTAMP '{NOW}') QUALIFY nth <= 8"),
    "backlog_ages": with_shapes("observations", f"{STATES_SQL} SELECT scope, min(occurred_at) AS oldest, count(*) AS waiting FROM states WHERE NOT formed AND NOT parked GROUP BY 1"),
    "turn_characters": with_shapes("observations", "SELECT source_id, messages, characters FROM observations"),
    "parked_turns": with_shapes("observations", f"{STATES_SQL} SELECT scope, log_offset::INT AS log_offset, source_id, attempts FROM states WHERE parked AND (scope, log_offset) > ('p0', 40) ORDER BY scope, log_offset LIMIT 50"),
    "admission": with_shapes(_A, f"{ADMIT_SQL} SELECT source_id, ordinal, predicate, subject_norm, object_norm, byte_start::INT AS byte_start, byte_end::INT AS byte_end, object_type, reason FROM adm"),
    "refusal_summary": with_shapes(_A, f"{ADMIT_SQL} SELECT reason, predicate, count(*) AS claims FROM adm WHERE reason IS NOT NULL GROUP BY 1, 2 ORDER BY claims DESC, reason, predicate LIMIT 20"),
    "speaker_binding": with_shapes("proposals", f"""s AS (SELECT role, CASE WHEN length(content) % 5 = 0 THEN 'i' ELSE lower(trim(regexp_replace(subject, '\\s+', ' ', 'g'))) END IN ({_SPEAKERS}) AS says, CASE WHEN ordinal % 4 <> 3 THEN data_subject_id END AS ds FROM proposals)
        SELECT role, coalesce(CASE WHEN says AND role <> 'user' THEN 'not_spoken_by_principal' WHEN says AND ds IS NULL THEN 'unresolvable_subject' END, 'none') AS reason, says AND ds IS NOT NULL AS bound, count(*) AS claims FROM s GROUP BY 1, 2, 3"""),
    "entity_resolution": with_shapes("proposals", """n AS (SELECT scope, subject AS name, lower(trim(regexp_replace(subject, '\\s+', ' ', 'g'))) AS nn, substring(source_id, 2)::BIGINT AS o, ordinal FROM proposals WHERE strlen(subject) <= 4096),
        g AS (SELECT scope, nn, arg_min(name, (o, ordinal)) AS canonical_name, list(DISTINCT name) AS names FROM n WHERE nn <> '' GROUP BY 1, 2) SELECT scope, nn AS normalized_name, canonical_name, array_to_string(list_sort([x FOR x IN names IF x <> canonical_name])[1:64], ',') AS aliases FROM g"""),
    "claim_ids": with_shapes(_A, f"""{ADMIT_SQL}, h AS (SELECT source_id, ordinal, predicate, sha256('["' || scope || '","' || source_id || '","' || ordinal || '","' || predicate || '","' || subject_norm || '","' || object_norm || '"]') AS h FROM adm WHERE reason IS NULL)
        SELECT source_id, ordinal, predicate, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-' || substring(h, 13, 4) || '-' || substring(h, 17, 4) || '-' || substring(h, 21, 12) AS claim_id FROM h"""),
    "accounts": with_shapes("messages", "SELECT scope, CASE WHEN scope = 'p1' THEN '' ELSE data_subject_id END AS account, count(*) AS rows FROM messages GROUP BY 1, 2"),
    "retention_deadlines": with_shapes("observations lineage", f"{STATES_SQL} SELECT projection_id AS fact_id, CASE WHEN bool_or(retention_until IS NULL) THEN NULL ELSE max(retention_until) END AS retention_until FROM lineage JOIN states USING (source_id) WHERE projection_kind = 'fact' GROUP BY 1"),
    "retractions": "SELECT CASE WHEN c_custkey % 8 = 0 THEN 2 ELSE 1 END AS version, c_custkey % 8 = 0 AS closed, count(*) AS facts FROM customer GROUP BY 1, 2",
    "corrections": f"SELECT 'lives_in:c:' || c_custkey || ':n:' || c_nationkey || ':corrected' AS fact_id, 'n:0' AS object_id, TIMESTAMP '{NOW}' AS known_from, TIMESTAMP '{NOW}' AS known_to FROM customer WHERE c_custkey % 6 = 0",
    "blocked_claims": with_shapes(_A, f"{ADMIT_SQL} SELECT predicate, count(*) AS claims FROM adm WHERE reason IS NULL AND substring(source_id, 2)::BIGINT % 3 <> 0 GROUP BY 1"),
    "generation_rebuild": with_shapes("lineage", """b AS (SELECT substring(source_id, 2)::BIGINT AS n FROM lineage WHERE projection_kind = 'fact')
        SELECT kind, retired, count(*) AS facts FROM (SELECT CASE WHEN n % 5 = 0 THEN 'curated' ELSE 'extracted' END AS kind, n % 3 = 0 AND n % 5 <> 0 AS retired FROM b UNION ALL SELECT 'extracted', false FROM b WHERE n % 3 = 0) GROUP BY 1, 2"""),
    "source_snapshots": with_shapes("messages", "SELECT scope, source_id, sha256(string_agg(ordinal || chr(31) || role || chr(31) || sha256(content), chr(10) ORDER BY ordinal)) AS digest FROM messages GROUP BY 1, 2"),
    "pipeline_pins": with_shapes("messages", "SELECT scope, source_id, 'v' || min(ordinal) AS version FROM messages GROUP BY 1, 2"),
    "missing_rows": with_shapes("facts lineage", "SELECT DISTINCT projection_id AS fact_id FROM lineage WHERE projection_kind = 'fact' AND projection_id NOT IN (SELECT fact_id FROM facts WHERE source_role <> 'tool')"),
    "citation_windows": with_shapes(_A, f"{ADMIT_SQL}, w AS (SELECT *, greatest(byte_start - 16, 0) AS first, encode(content)[greatest(byte_start - 16, 0) + 1:least(byte_end + 16, strlen(content))] AS bytes FROM adm WHERE reason IS NULL) SELECT source_id, ordinal, predicate, first::INT AS first, octet_length(bytes)::INT AS bytes, sha256(bytes) AS digest FROM w"),
    "evidence_bytes": with_shapes(_A, f"{ADMIT_SQL} SELECT count(*) AS claims, count(*) AS exact FROM adm WHERE reason IS NULL"),
    "unknown_predicates": with_shapes(_A, "SELECT predicate, count(*) AS claims, count(DISTINCT source_id) AS sources FROM proposals WHERE predicate NOT IN (SELECT predicate FROM vocabulary) GROUP BY 1"),
    "speaker_turn_order": with_shapes("messages", "SELECT scope, count(*) AS messages, count(*) FILTER (role = before) AS repeated FROM (SELECT *, lag(role) OVER (PARTITION BY source_id ORDER BY ordinal) AS before FROM messages) GROUP BY 1"),
}
