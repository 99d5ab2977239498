"""Registered queries: artifacts, subjects, feedback, vocabulary requests, backlog, controls, generations, and constraints on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.text import segmented
from factloom.operators import artifacts, stores
from factloom.plans.session import stored
from factloom.schemas import ARTIFACT_BYTES, BACKLOG, BACKLOG_PER_PROJECT, ROLES, SEGMENT_BYTES, SEGMENT_NAMESPACE, SURFACES
from factloom.sources import adapters as a
from factloom.sources.adapters import with_shapes

BUDGET = 16_000


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")


def segment_keys(spark, sf_dir):
    """Documents of one segment by their keys; digest, place, role and subject make a key."""
    docs = _documents(spark, sf_dir).where(F.octet_length("text") <= SEGMENT_BYTES)
    key = stores.segment_key(F.sha2("text", 256), F.lit(0), F.lit("user"), F.concat(F.lit("u"), (F.col("doc_id") % 11).cast("string")))
    return docs.select("doc_id", key.alias("segment_key"))


def segment_key_clashes(spark, sf_dir):
    """Segments of all documents that would be taken for one another: the same words at the same place by the same subject."""
    docs = _documents(spark, sf_dir)
    pieces = segmented(docs).join(docs.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("digest")), "id")
    keyed = pieces.select(stores.segment_key(F.col("digest"), F.col("ordinal"), F.lit("user"), F.lit("u1")).alias("k"))
    return keyed.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("segments"))


def _artifact_log(spark, sf_dir):
    """Puts of documents: most expect the version before, some an earlier one, none or another's; some are sent twice, some artifacts deleted."""
    d, content, h = F.col("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.md5(F.concat_ws(":", "source", "name"))
    docs = a.table(spark, sf_dir, "documents").where("source is not null").withColumn("name", F.concat_ws("/", "lang", (d % 7).cast("string")))
    part = lambda i, n: F.substring(h, i, n)
    docs = docs.select(
        d.alias("d"), F.col("source").alias("scope"), (d * 10).alias("seq"), F.lit("put").alias("op"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)).alias("id"), F.when(d % 37 == 0, "other").otherwise(F.col("source")).alias("subject"),
        F.when(d % 31 == 0, "file").otherwise("state").alias("kind"), "name", content.alias("content"),
    )
    d, digest = F.col("d"), artifacts.request_digest(F.col("subject"), F.col("kind"), F.col("name"), F.col("content"))
    docs = docs.withColumns({"bytes": F.octet_length("content").cast("long"), "digest": digest}).drop("content")
    order = Window.partitionBy("scope", "name").orderBy("d")
    last = lambda n: F.lag("seq", n).over(order)
    puts = docs.withColumn("expected", F.when(d % 11 == 0, last(2)).when(d % 7 != 0, last(1))).withColumn("artifact_id", F.when(d % 41 != 0, F.col("id")).otherwise("none"))
    puts = puts.select("scope", "seq", "op", "artifact_id", "subject", "kind", "name", "bytes", "digest", "expected", "d")
    twice = puts.where("d % 13 = 0").withColumn("seq", F.col("seq") + 1)
    gone = puts.where("d % 29 = 0").withColumns({"op": F.lit("delete"), "expected": F.col("seq"), "seq": F.col("seq") + 2})
    return puts.unionByName(twice).unionByName(gone).drop("d").withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000)))


def _replayed_artifacts(spark, sf_dir, most_bytes=1 << 40, most_objects=100_000):
    log = _artifact_log(spark, sf_dir)
    policies = log.select("scope").distinct().where("scope <> 'src3'").select("scope", *[F.lit(v).cast("long").alias(c) for c, v in (("max_object_bytes", ARTIFACT_BYTES), ("max_bytes", most_bytes), ("max_objects", most_objects))], F.lit(720).alias("max_age_hours"))
    return *artifacts.replay(log, policies, lambda d: stored(d, "artifacts")), policies


def artifact_outcomes(spark, sf_dir):
    """What became of each put and delete."""
    return _replayed_artifacts(spark, sf_dir)[0]


def artifact_quota(spark, sf_dir):
    """What each project holds after the log."""
    _, standing, policies = _replayed_artifacts(spark, sf_dir)
    return artifacts.usage(standing, policies).select("scope", "objects", "used")


def artifact_capacity(spark, sf_dir):
    """The same log where a project holds 5 artifacts and 16 KB at most: how many commands each outcome had, and what is held."""
    said, standing, policies = _replayed_artifacts(spark, sf_dir, 16_384, 5)
    counts = said.groupBy("scope").pivot("outcome", ["created", "replaced", "deleted", "replayed", "conflict", "not_found", "capacity", "invalid", "no_such_project"]).count()
    return counts.join(artifacts.usage(standing, policies), "scope", "left")


def artifact_page(spark, sf_dir):
    """A page of one project's state under a prefix, after a cursor."""
    rows = artifacts.page(_replayed_artifacts(spark, sf_dir)[1], "src1", "state", "e", "20000000-0000-0000-0000-000000000000", 25)
    return rows.select("artifact_id", "name", "version", "bytes")


def live_subjects(spark, sf_dir):
    subjects = a.table(spark, sf_dir, "customer").selectExpr("'u' || (c_custkey % 23) as data_subject_id", "c_name as reference").groupBy("data_subject_id").agg(F.count("*").alias("references"), F.min("reference").alias("first"))
    return stores.live(subjects, a.lineage(spark, sf_dir))


def _feedback(spark, sf_dir):
    facts = a.facts(spark, sf_dir).where("predicate = 'lives_in'").select("fact_id", F.split_part("subject_id", F.lit(":"), F.lit(2)).cast("long").alias("k"), F.lit(None).cast("timestamp").alias("known_to"))
    events = a.table(spark, sf_dir, "events").where("event_type <> 'error'")
    rows = events.join(facts, F.col("user_id") == F.col("k"))
    return facts, rows.select(F.col("event_id").alias("feedback_id"), "fact_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("n:"), (F.col("event_id") % 25).cast("string"))).alias("proposed"))


def open_feedback(spark, sf_dir):
    facts, feedback = _feedback(spark, sf_dir)
    return stores.open_feedback(feedback, facts, feedback.where("feedback_id % 5 = 0")).groupBy("fact_id").agg(F.count("*").alias("open"), F.count("proposed").alias("proposals"))


def promoted_feedback(spark, sf_dir):
    return stores.promote(_feedback(spark, sf_dir)[1])


def vocabulary_requests(spark, sf_dir):
    """Words of part names asked for as predicates, in the order of their keys."""
    words = a.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("arrival"), F.concat(F.translate("p_name", " ", "_"), F.when(F.col("p_partkey") % 7 == 0, "_").otherwise("")).alias("predicate"))
    known = spark.range(1).select(F.explode(F.array(F.lit("lives_in"), F.lit("small_ring"))).alias("predicate"))
    return stores.vocabulary_requests(words, known).groupBy("refused").agg(F.count("*").alias("requests"), F.min("predicate").alias("first"))


def project_names(spark, sf_dir):
    names = a.table(spark, sf_dir, "nation").selectExpr("n_name as name").unionByName(a.table(spark, sf_dir, "nation").selectExpr("lower(n_name) as name")).unionByName(a.table(spark, sf_dir, "supplier").selectExpr("lower(s_name) as name"))
    return stores.project_names(names).groupBy("fits").agg(F.count("*").alias("names"), F.max("name").alias("last"))


def shrinking_projects(spark, sf_dir):
    """Projects whose surfaces of one day lack one that they had the day before."""
    days = a.table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("project"), F.to_date("ts").alias("day"), "event_type").groupBy("project", "day").agg(F.collect_set("event_type").alias("now"))
    old = days.select("project", F.date_add("day", 1).alias("day"), F.col("now").alias("before"))
    return days.join(old, ["project", "day"]).select("project", "day", stores.only_grows(F.col("before"), F.col("now")).alias("grows")).groupBy("grows").agg(F.count("*").alias("changes"))


def backlog_admission(spark, sf_dir):
    waiting = a.table(spark, sf_dir, "events").selectExpr("'p' || (user_id % 13) as scope", "event_id as arrival")
    return stores.admit_to_backlog(waiting).groupBy("scope", "admitted").agg(F.count("*").alias("turns"), F.max("arrival").alias("last"))


def recall_controls(spark, sf_dir):
    e = a.table(spark, sf_dir, "events")
    role = lambda k: F.element_at(F.array(*[F.lit(r) for r in [*ROLES, "owner"]]), (k % 5 + 1).cast("int"))
    surface = lambda k: F.element_at(F.array(*[F.lit(s) for s in SURFACES]), (k % 3 + 1).cast("int"))
    i = F.col("event_id")
    asked = e.select(
        i.alias("id"), F.when(i % 4 != 0, (i % 17 * 1000).cast("int")).alias("max_characters"), F.when(i % 3 != 0, F.array(role(i), role(i + 1 + i % 4))).alias("roles"), F.when(i % 5 != 0, F.array(surface(i), surface(i + i % 3))).alias("surfaces"), (i % 4).cast("int").alias("hops")
    )
    return stores.effective_controls(asked, BUDGET)


def scopes_owing_reports(spark, sf_dir):
    orders = a.table(spark, sf_dir, "orders")
    communities = orders.selectExpr("'p' || (o_custkey % 40) as scope", "o_orderkey as community_id")
    reports = orders.where("o_orderkey % 41 <> 3").selectExpr("'p' || (o_custkey % 40) as scope", "o_orderkey as community_id", "case when o_custkey % 40 < 20 then 'w2' else 'w1' end as written_by")
    return stores.owing_reports(communities, reports, "w2", 25)


def rewritten_ledger(spark, sf_dir):
    """Entries that a snapshot of the ledger with two kinds of damage no longer has as they were."""
    before = a.audit(spark, sf_dir).select("entry_id", "operation", "principal", "magnitude")
    after = before.where("entry_id % 101 <> 7").withColumn("magnitude", F.when(F.col("entry_id") % 89 == 5, F.col("magnitude") + 1).otherwise(F.col("magnitude")))
    return stores.rewritten(before, after, "entry_id", ["operation", "principal", "magnitude"])


def _items(spark, sf_dir):
    return _documents(spark, sf_dir).select(F.col("doc_id").alias("item_id"), F.sha2("text", 256).alias("digest"))


def _item_vectors(spark, sf_dir):
    """Vectors of documents by the embeddings' numbers; every 13th was made of another text."""
    made = a.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), (F.col("label") % 2).alias("generation_id"))
    rows = made.join(_items(spark, sf_dir), "item_id")
    return rows.select("item_id", F.concat(F.lit("g"), F.col("generation_id").cast("string")).alias("generation_id"), F.when(F.col("item_id") % 13 == 0, "stale").otherwise(F.col("digest")).alias("digest"))


def embedding_catch_up(spark, sf_dir):
    """The page of documents after a cursor that the active generation still has to embed."""
    return stores.embedding_page(_items(spark, sf_dir), _item_vectors(spark, sf_dir).where("generation_id = 'g1'"), 20, 100)


def generation_readiness(spark, sf_dir):
    return stores.readiness(_items(spark, sf_dir), _item_vectors(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    segment_keys, segment_key_clashes, artifact_outcomes, artifact_quota, artifact_capacity, artifact_page, live_subjects, open_feedback, promoted_feedback, vocabulary_requests, project_names, shrinking_projects, backlog_admission, recall_controls,
    scopes_owing_reports, rewritten_ledger, embedding_catch_up, generation_readiness,
)}

_ARTIFACTS = """RECURSIVE
named AS (SELECT *, lang || '/' || (doc_id % 7) AS name FROM documents WHERE source IS NOT NULL),
base AS (SELECT source AS scope, doc_id AS d, doc_id * 10 AS seq, name, 'put' AS op, coalesce(text, '') AS body, CASE WHEN doc_id % 31 = 0 THEN 'file' ELSE 'state' END AS kind, CASE WHEN doc_id % 37 = 0 THEN 'other' ELSE source END AS subject,
  CASE WHEN doc_id % 11 = 0 THEN lag(doc_id, 2) OVER w * 10 WHEN doc_id % 7 <> 0 THEN lag(doc_id) OVER w * 10 END AS expected, md5(source || ':' || name) AS h FROM named WINDOW w AS (PARTITION BY source, name ORDER BY doc_id)),
log AS (SELECT * FROM base UNION ALL SELECT * REPLACE (seq + 1 AS seq) FROM base WHERE d % 13 = 0 UNION ALL SELECT * REPLACE (seq + 2 AS seq, 'delete' AS op, seq AS expected) FROM base WHERE d % 29 = 0),
known AS (SELECT *, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS id, strlen(body) AS bytes FROM log),
tried AS (SELECT *, sha256(subject || '|' || kind || '|' || name || '|' || body) AS digest, row_number() OVER (PARTITION BY scope, id ORDER BY seq) AS nth FROM known WHERE scope <> 'src3' AND d % 41 <> 0 AND (bytes <= 524288 OR op = 'delete')),
step AS (SELECT scope, id, 0::BIGINT AS nth, (-1)::BIGINT AS seq, '' AS outcome, false AS used, NULL::BIGINT AS version, NULL::BIGINT AS previous, NULL::VARCHAR AS digest, NULL::VARCHAR AS first, NULL::VARCHAR AS subject, NULL::VARCHAR AS kind, NULL::VARCHAR AS name, NULL::BIGINT AS bytes FROM tried WHERE nth = 1
  UNION ALL SELECT scope, id, nth, seq, outcome, used OR outcome = 'created', CASE WHEN wrote THEN seq WHEN outcome <> 'deleted' THEN version END, CASE WHEN wrote THEN version ELSE previous END, CASE WHEN wrote THEN new.digest ELSE old_digest END,
    CASE WHEN outcome = 'created' THEN new.digest ELSE first END, CASE WHEN wrote THEN new.subject ELSE old_subject END, CASE WHEN wrote THEN new.kind ELSE old_kind END, CASE WHEN wrote THEN new.name ELSE old_name END, CASE WHEN wrote THEN new.bytes ELSE old_bytes END
  FROM (SELECT *, outcome IN ('created', 'replaced') AS wrote FROM (SELECT t.scope, t.id, t.nth, t.seq, t AS new, s.used, s.version, s.previous, s.first, s.digest AS old_digest, s.subject AS old_subject, s.kind AS old_kind, s.name AS old_name, s.bytes AS old_bytes,
    CASE WHEN t.op = 'delete' THEN CASE WHEN s.version IS NULL OR s.subject <> t.subject THEN 'not_found' WHEN s.version <> t.expected THEN 'conflict' ELSE 'deleted' END
    WHEN s.version IS NULL THEN CASE WHEN t.expected IS NOT NULL THEN 'not_found' WHEN s.used THEN 'conflict' ELSE 'created' END WHEN s.subject <> t.subject OR s.kind <> t.kind THEN 'conflict'
    WHEN t.expected IS NULL THEN CASE WHEN s.first = t.digest THEN 'replayed' ELSE 'conflict' END WHEN s.version = t.expected THEN 'replaced' WHEN s.previous = t.expected AND s.digest = t.digest THEN 'replayed' ELSE 'conflict' END AS outcome
    FROM step s JOIN tried t ON t.scope = s.scope AND t.id = s.id AND t.nth = s.nth + 1))),
arts AS (SELECT scope, id, arg_max(v, nth).version AS version, arg_max(v, nth).kind AS kind, arg_max(v, nth).name AS name, arg_max(v, nth).bytes AS bytes FROM (SELECT scope, id, nth, {'version': version, 'kind': kind, 'name': name, 'bytes': bytes} AS v FROM step) GROUP BY 1, 2 HAVING arg_max(v, nth).version IS NOT NULL)"""
_FEEDBACK = """
feedback AS (SELECT event_id AS feedback_id, 'lives_in:c:' || c_custkey || ':n:' || c_nationkey AS fact_id, CASE WHEN event_id % 3 = 0 THEN 'n:' || (event_id % 25) END AS proposed FROM events JOIN customer ON user_id = c_custkey WHERE event_type <> 'error')"""
_VECTORS = """
items AS (SELECT doc_id AS item_id, sha256(coalesce(text, '')) AS digest FROM documents),
vec AS (SELECT vec_id AS item_id, 'g' || (label % 2) AS generation_id, CASE WHEN vec_id % 13 = 0 THEN 'stale' ELSE digest END AS digest FROM embeddings JOIN items ON vec_id = item_id)"""
_ROLE = "(['" + "', '".join([*ROLES, "owner"]) + "'])[(({}) % 5)::INT + 1]"
_SURFACE = "(['" + "', '".join(SURFACES) + "'])[(({}) % 3)::INT + 1]"
_LIST = lambda x: "['" + "', '".join(x) + "']"
ORACLES = {
    "segment_keys": f"""WITH h AS (SELECT doc_id, sha256(unhex('{SEGMENT_NAMESPACE.replace("-", "")}') || encode(sha256(coalesce(text, '')) || chr(10) || '0' || chr(10) || 'user' || chr(10) || 'u' || (doc_id % 11))) AS h FROM documents WHERE strlen(coalesce(text, '')) <= {SEGMENT_BYTES})
        SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || translate(h[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-' || h[21:32] AS segment_key FROM h""",
    "artifact_outcomes": f"WITH {_ARTIFACTS} SELECT k.scope, k.seq, CASE WHEN d % 41 = 0 THEN 'none' ELSE k.id END AS artifact_id, CASE WHEN d % 41 = 0 OR (k.op = 'put' AND k.bytes > {ARTIFACT_BYTES}) THEN 'invalid' WHEN k.scope = 'src3' THEN 'no_such_project' ELSE outcome END AS outcome FROM known k LEFT JOIN step s ON s.scope = k.scope AND s.seq = k.seq",
    "artifact_quota": f"WITH {_ARTIFACTS}, p AS (SELECT DISTINCT source AS scope FROM named WHERE source <> 'src3') SELECT p.scope, count(id) AS objects, coalesce(sum(bytes), 0)::BIGINT AS used FROM p LEFT JOIN arts ON arts.scope = p.scope GROUP BY 1",
    "artifact_page": f"WITH {_ARTIFACTS} SELECT id AS artifact_id, name, version, bytes FROM arts WHERE scope = 'src1' AND kind = 'state' AND starts_with(name, 'e') AND id > '20000000-0000-0000-0000-000000000000' ORDER BY id LIMIT 26",
    "live_subjects": with_shapes("lineage", "s AS (SELECT 'u' || (c_custkey % 23) AS data_subject_id, count(*) AS \"references\", min(c_name) AS first FROM customer GROUP BY 1) SELECT * FROM s WHERE data_subject_id IN (SELECT data_subject_id FROM lineage WHERE data_subject_id IS NOT NULL)"),
    "open_feedback": f"WITH {_FEEDBACK} SELECT fact_id, count(*) AS open, count(proposed) AS proposals FROM feedback WHERE feedback_id % 5 <> 0 GROUP BY 1",
    "promoted_feedback": f"WITH {_FEEDBACK}, f AS (SELECT fact_id, min(feedback_id) AS feedback_id FROM feedback GROUP BY 1) SELECT fact_id, feedback_id, proposed, CASE WHEN proposed IS NULL THEN 'retraction' ELSE 'correction' END AS becomes FROM f JOIN feedback USING (fact_id, feedback_id)",
    "vocabulary_requests": """WITH w AS (SELECT p_partkey AS arrival, translate(p_name, ' ', '_') || CASE WHEN p_partkey % 7 = 0 THEN '_' ELSE '' END AS predicate FROM part),
        r AS (SELECT *, CASE WHEN NOT regexp_matches(predicate, '^[a-z][a-z_]*[a-z]$') THEN 'invalid_name' WHEN predicate IN ('lives_in', 'small_ring') THEN 'exists' WHEN row_number() OVER (PARTITION BY predicate ORDER BY arrival) > 1 THEN 'asked_before' END AS refused FROM w)
        SELECT refused, count(*) AS requests, min(predicate) AS first FROM r GROUP BY 1""",
    "project_names": "SELECT fits, count(*) AS names, max(name) AS last FROM (SELECT name, regexp_matches(name, '^[a-z][a-z0-9_]{0,62}$') AS fits FROM (SELECT n_name AS name FROM nation UNION ALL SELECT lower(n_name) FROM nation UNION ALL SELECT lower(s_name) FROM supplier)) GROUP BY 1",
    "shrinking_projects": """WITH d AS (SELECT DISTINCT user_id % 50 AS project, ts::DATE AS day, event_type FROM events), p AS (SELECT DISTINCT project, day FROM d),
        pairs AS (SELECT p.project, p.day FROM p JOIN p o ON o.project = p.project AND o.day + 1 = p.day),
        lost AS (SELECT DISTINCT q.project, q.day FROM pairs q JOIN d b ON b.project = q.project AND b.day + 1 = q.day WHERE NOT EXISTS (SELECT 1 FROM d n WHERE n.project = q.project AND n.day = q.day AND n.event_type = b.event_type))
        SELECT lost.day IS NULL AS grows, count(*) AS changes FROM pairs LEFT JOIN lost ON lost.project = pairs.project AND lost.day = pairs.day GROUP BY 1""",
    "backlog_admission": f"""WITH w AS (SELECT 'p' || (user_id % 13) AS scope, event_id AS arrival, row_number() OVER (PARTITION BY user_id % 13 ORDER BY event_id) AS nth FROM events),
        h AS (SELECT *, row_number() OVER (ORDER BY arrival) AS place FROM w WHERE nth <= {BACKLOG_PER_PROJECT})
        SELECT w.scope, coalesce(place <= {BACKLOG}, false) AS admitted, count(*) AS turns, max(w.arrival) AS last FROM w LEFT JOIN h USING (scope, arrival) GROUP BY 1, 2""",
    "recall_controls": f"""WITH q AS (SELECT event_id AS id, coalesce(CASE WHEN event_id % 4 <> 0 THEN event_id % 17 * 1000 END, {BUDGET})::INT AS m, CASE WHEN event_id % 3 <> 0 THEN [{_ROLE.format("event_id")}, {_ROLE.format("event_id + 1 + event_id % 4")}] ELSE ['user'] END AS r,
        CASE WHEN event_id % 5 <> 0 THEN [{_SURFACE.format("event_id")}, {_SURFACE.format("event_id + event_id % 3")}] ELSE {_LIST(SURFACES)} END AS s, least(greatest((event_id % 4)::INT, 1), 2) AS h FROM events),
        v AS (SELECT *, m BETWEEN 1 AND {BUDGET} AND len(list_distinct(r)) = len(r) AND NOT list_contains(r, 'owner') AND len(list_distinct(s)) = len(s) AS valid FROM q)
        SELECT id, valid, CASE WHEN valid THEN m END AS max_characters, CASE WHEN valid THEN array_to_string(r, ',') END AS roles, CASE WHEN valid THEN array_to_string(s, ',') END AS surfaces, CASE WHEN valid THEN h END AS hops FROM v""",
    "scopes_owing_reports": "SELECT DISTINCT 'p' || (o_custkey % 40) AS scope FROM orders WHERE o_orderkey % 41 = 3 OR o_custkey % 40 >= 20 ORDER BY scope LIMIT 25",
    "rewritten_ledger": with_shapes("audit", "SELECT entry_id FROM audit WHERE entry_id % 101 = 7 OR entry_id % 89 = 5"),
    "embedding_catch_up": f"WITH {_VECTORS} SELECT item_id, digest FROM items WHERE item_id > 20 AND NOT EXISTS (SELECT 1 FROM vec WHERE vec.item_id = items.item_id AND vec.digest = items.digest AND generation_id = 'g1') ORDER BY item_id LIMIT 100",
    "generation_readiness": f"WITH {_VECTORS} SELECT generation_id, (SELECT count(*) FROM items) AS items, (SELECT count(*) FROM items) - count(DISTINCT CASE WHEN digest <> 'stale' THEN item_id END) AS lacking, (SELECT count(*) FROM items) = count(DISTINCT CASE WHEN digest <> 'stale' THEN item_id END) AS ready FROM vec GROUP BY 1",
}
