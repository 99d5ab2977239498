"""Registered queries: temporal reads, supersession, anchors, walks, evidence, budget, inspection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import temporal
from factloom.functions.text import normalised, terms_of
from factloom.operators import formation, recall
from factloom.sources import adapters as a
from factloom.sources.adapters import with_shapes

NOW = "2024-06-01 00:00:00"
CAP = 16
VALID, KNOWN = "1995-06-15 00:00:00", "1996-01-01 00:00:00"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question a supplier and nation, read as terms: `question_id, term`."""
    s, n = a.table(spark, sf_dir, "supplier"), a.table(spark, sf_dir, "nation")
    # As people ask: with marks, and with a possessive.
    suppliers = s.selectExpr("'qs:' || s_suppkey as question_id", "'So: where is ' || translate(s_name, '#_', '  ') || '\\'s office?' as question")
    asked = suppliers.unionByName(n.selectExpr("'qn:' || n_nationkey as question_id", "'Who lives in \\'' || translate(n_name, '#_', '  ') || '\\', really?' as question"))
    return asked.select("question_id", F.explode(terms_of(F.col("question"))).alias("term"))


QUESTIONS_SQL = """
asked AS (SELECT 'qs:' || s_suppkey AS question_id, 'So: where is ' || translate(s_name, '#_', '  ') || '''s office?' AS q FROM supplier UNION ALL SELECT 'qn:' || n_nationkey, 'Who lives in ''' || translate(n_name, '#_', '  ') || ''', really?' FROM nation),
worded AS (SELECT question_id, [lower(trim(x, '''-')) FOR x IN string_split(translate(q, ':,?', '   '), ' ') IF x <> ''] AS w FROM asked),
runs AS (SELECT question_id, array_to_string(w[i:i + n - 1], ' ') AS term FROM (SELECT question_id, w, unnest(range(1, len(w) + 1)) AS i FROM worded), (SELECT unnest([1, 2, 3, 4]) AS n) WHERE i + n - 1 <= len(w)),
terms AS (SELECT DISTINCT question_id, term FROM (SELECT * FROM runs UNION ALL SELECT question_id, CASE WHEN term LIKE '%''s' THEN left(term, length(term) - 2) ELSE term END FROM runs) WHERE term <> '')"""

ANCHORS_SQL = "anchors AS (SELECT question_id, entity_id AS anchor_id, term, canonical_name FROM terms JOIN entities ON term = normalized_name)"

VISIBLE_SQL = f"visible AS (SELECT * FROM facts WHERE scope = 'p0' AND source_role IN ('user', 'assistant') AND (retention_until IS NULL OR retention_until > TIMESTAMP '{NOW}'))"
EDGES_SQL = f"""
arms AS (SELECT subject_id AS entity_id, 'out' AS direction, fact_id, predicate, object_id AS other_id FROM visible UNION ALL SELECT object_id, 'in', fact_id, predicate, subject_id FROM visible WHERE object_id IS NOT NULL),
edges AS (SELECT entity_id, direction, fact_id, predicate, other_id, n > {CAP} AS capped FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, direction ORDER BY fact_id) AS rn, count(*) OVER (PARTITION BY entity_id, direction) AS n FROM arms) WHERE rn <= {CAP} AND other_id IS NOT NULL)"""
WALK_SQL = """
h1 AS (SELECT question_id, anchor_id, other_id AS node, [anchor_id, other_id] AS path, [predicate] AS via, capped, fact_id, 1 AS hops FROM anchors JOIN edges ON anchor_id = entity_id WHERE other_id <> anchor_id),
h2 AS (SELECT question_id, anchor_id, other_id AS node, list_append(path, other_id) AS path, list_append(via, edges.predicate) AS via, h1.capped OR edges.capped AS capped, edges.fact_id, 2 AS hops FROM h1 JOIN edges ON node = entity_id WHERE NOT list_contains(path, other_id)),
walked AS (SELECT question_id, fact_id, hops, anchor_id, path, via, capped FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) QUALIFY row_number() OVER (PARTITION BY question_id, fact_id ORDER BY hops, anchor_id, path, via) = 1)"""
EVIDENCE_SQL = """
evidence AS (SELECT projection_id AS fact_id, source_id, min(try_cast(substring(source_id, 2) AS BIGINT)) OVER (PARTITION BY projection_id) AS first, try_cast(substring(source_id, 2) AS BIGINT) AS log_offset FROM lineage WHERE projection_kind = 'fact'),
cited AS (SELECT fact_id, source_id, log_offset FROM evidence QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY log_offset, source_id) = 1)"""
CUT_SQL = """
pathed AS (SELECT question_id, fact_id, sum(length(coalesce(canonical_name, ''))) AS path_size FROM (SELECT question_id, fact_id, unnest(path) AS e FROM walked) LEFT JOIN entities ON e = entity_id GROUP BY 1, 2),
offered AS (SELECT w.*, path_size + list_sum([length(x) FOR x IN via]) AS listed, v.predicate, v.statement, v.source_role, c.source_id, es.canonical_name AS subject_name, eo.canonical_name AS object_name FROM walked w JOIN pathed USING (question_id, fact_id) JOIN visible v USING (fact_id) JOIN cited c USING (fact_id) LEFT JOIN entities es ON es.entity_id = v.subject_id LEFT JOIN entities eo ON eo.entity_id = v.object_id),
sized AS (SELECT *, length(statement) + coalesce(length(subject_name), 0) + coalesce(length(object_name), 0) + length(predicate) + length(source_role) + listed AS size FROM offered),
run AS (SELECT *, row_number() OVER w AS place, sum(size) OVER (w ROWS UNBOUNDED PRECEDING) AS total FROM sized WINDOW w AS (PARTITION BY question_id ORDER BY hops, predicate, fact_id)),
cutted AS (SELECT *, CASE WHEN place > 20 THEN 'rows' WHEN total > 1800 THEN 'characters' END AS cut FROM run)"""


def _visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.visible(a.facts(spark, sf_dir), "p0", ["user", "assistant"], NOW)


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.anchors(questions(spark, sf_dir), a.entities(spark, sf_dir), ["p0"])


def _walk(spark: SparkSession, sf_dir: str, hops: int) -> DataFrame:
    return recall.walk(_anchors(spark, sf_dir), recall.directed_edges(_visible(spark, sf_dir), CAP), hops)


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.lineage(spark, sf_dir).where("projection_kind = 'fact'")
    return rows.select(F.col("projection_id").alias("fact_id"), "source_id", F.substring("source_id", 2, 20).cast("long").alias("log_offset"), F.lit(0).alias("source_ordinal"), F.lit(0).alias("byte_start"), F.lit("").alias("quote"))


def _cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = a.entities(spark, sf_dir).select("entity_id", "canonical_name")
    facts = _visible(spark, sf_dir).select("fact_id", "subject_id", "object_id", "predicate", "statement", "source_role")
    offered = recall.named_paths(recall.attach_evidence(_walk(spark, sf_dir, 2), facts, _evidence(spark, sf_dir), names), names)
    # Facts of these tables have no quoted text, so there is no context either.
    return recall.cut(offered, ["question_id"], ["hops", "predicate", "fact_id"], recall.fact_size(F.lit("")), budget=1800, most=20)


def question_terms(spark, sf_dir):
    return questions(spark, sf_dir).groupBy("question_id").agg(F.count("*").alias("n_terms"), F.max("term").alias("last_term"))


def recall_anchors(spark, sf_dir):
    return _anchors(spark, sf_dir).select("question_id", "anchor_id", "term", "canonical_name", "place")


def anchors_of_subject(spark, sf_dir):
    """Anchors that a data subject's sources support (the lineage names facts; their subjects are the entities)."""
    own = a.lineage(spark, sf_dir).where("projection_kind = 'fact'").selectExpr("'entity' as projection_kind", "split_part(projection_id, ':', 2) || ':' || split_part(projection_id, ':', 3) as projection_id", "data_subject_id")
    named = a.entities(spark, sf_dir).where("entity_type = 'person'").select(F.lit("all").alias("question_id"), F.col("entity_id").alias("anchor_id"), "canonical_name")
    return recall.of_subject(named, own, "u3").select("anchor_id", "canonical_name")


def fanout_edges(spark, sf_dir):
    return recall.directed_edges(_visible(spark, sf_dir), CAP).groupBy("entity_id", "direction").agg(F.count("*").alias("kept"), F.bool_or("capped").alias("capped"))


def walk_one_hop(spark, sf_dir):
    return _walk(spark, sf_dir, 1).select("question_id", "fact_id", "anchor_id", "hops", "capped")


def walk_two_hops(spark, sf_dir):
    return _walk(spark, sf_dir, 2).select("question_id", "fact_id", "anchor_id", "hops", F.array_join("path", ">").alias("path"), F.array_join("via", ">").alias("via"), "capped")


def recall_bundle(spark, sf_dir):
    kept = _cut(spark, sf_dir).where("cut is null")
    return kept.select("question_id", "place", "fact_id", "hops", "predicate", "subject_name", "object_name", "source_id", "size", "total")


def recall_explain(spark, sf_dir):
    return recall.explain(_cut(spark, sf_dir))


def recall_reach(spark, sf_dir):
    return recall.reach(questions(spark, sf_dir), _anchors(spark, sf_dir), _cut(spark, sf_dir).where("cut is null"))


def recall_co_derived(spark, sf_dir):
    """Of the facts kept for a question, those of one message about one subject name each other."""
    rows = _cut(spark, sf_dir).where("cut is null").withColumn("subject_norm", F.coalesce(normalised(F.col("subject_name")), F.lit("")))
    return recall.co_derived(rows).select("question_id", "fact_id", F.size("co_derived").cast("long").alias("n"), F.element_at("co_derived", 1).alias("first"))


def supersession(spark, sf_dir):
    rows = formation.supersede(a.status_claims(spark, sf_dir))
    return rows.select("claim_id", "accepted", F.when(F.col("accepted"), F.col("next_valid")).alias("valid_to"), F.when(F.col("accepted"), F.col("known_at")).alias("known_at"))


def refused_conflicts(spark, sf_dir):
    return formation.refused_claims(a.status_claims(spark, sf_dir)).groupBy("reason").agg(F.count("*").alias("claims"), F.count_distinct("subject_id").alias("subjects"))


def _versions(spark, sf_dir):
    return formation.fact_versions(a.status_claims(spark, sf_dir))


VERSIONS_SQL = """
m AS (SELECT *, max(valid_from) OVER (PARTITION BY subject_id ORDER BY a1, a2, valid_from, claim_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM claims),
acc AS (SELECT *, top IS NULL OR valid_from > top AS accepted FROM m),
num AS (SELECT *, row_number() OVER (PARTITION BY subject_id, accepted ORDER BY a1, a2, valid_from, claim_id) AS n FROM acc),
clk AS (SELECT *, make_timestamp(n + max(epoch_us(learned_at) - n) OVER (PARTITION BY subject_id, accepted ORDER BY a1, a2, valid_from, claim_id ROWS UNBOUNDED PRECEDING)) AS known_at FROM num),
sup AS (SELECT *, lead(valid_from) OVER w AS next_valid, lead(known_at) OVER w AS next_known FROM clk WINDOW w AS (PARTITION BY subject_id, accepted ORDER BY a1, a2, valid_from, claim_id)),
vf AS (SELECT claim_id AS fact_id, subject_id, object_value, valid_from, next_valid AS valid_to, coalesce(next_known, known_at) AS known_from, NULL::TIMESTAMP AS known_to FROM sup WHERE accepted),
vh AS (SELECT claim_id AS fact_id, subject_id, object_value, valid_from, NULL::TIMESTAMP AS valid_to, known_at AS known_from, next_known AS known_to FROM sup WHERE accepted AND next_valid IS NOT NULL),
va AS (SELECT * FROM vf UNION ALL SELECT * FROM vh)"""
_IN = lambda p, t: f"{p}_from <= TIMESTAMP '{t}' AND ({p}_to IS NULL OR {p}_to > TIMESTAMP '{t}')"


def _read(valid: str | None, known: str | None):
    def run(spark, sf_dir):
        facts, history = _versions(spark, sf_dir)
        return temporal.read(facts, history, valid, known).select("fact_id", "subject_id", "object_value", "valid_from", "valid_to", "known_from", "known_to")

    return run


def fact_history(spark, sf_dir):
    """Versions of each fact by when they were believed."""
    facts, history = _versions(spark, sf_dir)
    rows = facts.withColumn("status", F.when(F.col("valid_to").isNull(), "current").otherwise("validity_closed")).unionByName(history.withColumn("status", F.lit("knowledge_closed")))
    return rows.groupBy("status").agg(F.count("*").alias("versions"), F.count_distinct("subject_id").alias("subjects"), F.min("known_from").alias("first"), F.max("known_from").alias("last"))


def _misshapen(spark, sf_dir):
    """Versions as a faulty writer might leave them: every 40th order's superseded facts stay open, every 30th order's history ends late."""
    facts, history = _versions(spark, sf_dir)
    k = F.expr("cast(substring(subject_id, 3) as long)")
    facts = facts.withColumn("valid_to", F.when(k % 40 == 0, None).otherwise(F.col("valid_to")))
    late = F.expr("known_to + make_dt_interval(400)")
    return facts, history.withColumn("known_to", F.when(k % 30 == 0, late).otherwise(F.col("known_to")))


def overlapping_versions(spark, sf_dir):
    """Facts of a one-valued key that begin before an earlier one, believed at the same time, has ended."""
    facts, _ = _misshapen(spark, sf_dir)
    before = Window.partitionBy("scope", "account", "subject_id", "predicate").orderBy("valid_from", "fact_id").rowsBetween(Window.unboundedPreceding, -1)
    # The farthest end before each, in one pass over the key: no pairs are made.
    end = F.max(F.coalesce("valid_to", F.expr("timestamp'9999-01-01 00:00:00'"))).over(before)
    return facts.where("known_to is null").withColumn("_end", end).where(F.col("_end") > F.col("valid_from")).select("fact_id", "subject_id", "valid_from")


def ranges_and_gaps(spark, sf_dir):
    """Counts of versions whose ranges are empty, and whose beliefs go on into the fact's present one."""
    facts, history = _misshapen(spark, sf_dir)
    now = facts.select("fact_id", F.col("known_from").alias("_now"))
    rows = history.join(now, "fact_id", "left")
    return rows.agg(F.count("*").alias("versions"), F.count_if(F.col("known_to") <= F.col("known_from")).alias("empty"), F.count_if(F.col("known_to") > F.col("_now")).alias("overlapping"))


def records_page(spark, sf_dir):
    """A keyset page of facts: after a cursor, one more than the page to tell whether there is another."""
    rows = a.facts(spark, sf_dir).where(F.struct("predicate", "fact_id") > F.struct(F.lit("created"), F.lit("created:s:10")))
    return rows.orderBy("predicate", "fact_id").limit(101).select("predicate", "fact_id", F.expr("left(statement, 12)").alias("preview"), F.octet_length("statement").alias("bytes"), (F.char_length("statement") > 12).alias("truncated"))


def records_about(spark, sf_dir):
    """First 50 facts with an entity at either end: two bounded arms, then their union."""
    facts = a.facts(spark, sf_dir).select("fact_id", "subject_id", "object_id")
    arms = [facts.where(F.col(c) == "n:3").orderBy("fact_id").limit(50) for c in ("subject_id", "object_id")]
    return arms[0].unionByName(arms[1]).distinct().orderBy("fact_id").limit(50)


def newest_facts(spark, sf_dir):
    facts, _ = _versions(spark, sf_dir)
    return facts.orderBy(F.desc("valid_from"), F.desc("fact_id")).limit(25).select("fact_id", "valid_from", "object_value")


def entity_inspection(spark, sf_dir):
    """Entities with the facts at either end."""
    ends = a.facts(spark, sf_dir).selectExpr("predicate", "explode(array_distinct(array(subject_id, object_id))) as entity_id")
    return ends.groupBy("entity_id").agg(F.count("*").alias("facts"), F.array_join(F.array_sort(F.collect_set("predicate")), ",").alias("predicates")).join(a.entities(spark, sf_dir).select("entity_id", "canonical_name"), "entity_id", "left")


def visible_facts(spark, sf_dir):
    return _visible(spark, sf_dir).groupBy("predicate", "source_role").agg(F.count("*").alias("facts"), F.avg("confidence").alias("confidence"))


def no_scope_no_answer(spark, sf_dir):
    """An empty set of scopes, or of roles, gives nothing."""
    found = recall.anchors(questions(spark, sf_dir), a.entities(spark, sf_dir), [])
    return found.agg(F.count("*").alias("anchors"))


def citations(spark, sf_dir):
    """Each fact's sources in order, with how many stand behind it."""
    return _evidence(spark, sf_dir).groupBy("fact_id").agg(F.count("*").alias("spans"), F.min_by("source_id", F.struct("log_offset", "source_id")).alias("first_source"))


QUERIES = {f.__name__: f for f in (
    question_terms, recall_anchors, anchors_of_subject, fanout_edges, walk_one_hop, walk_two_hops, recall_bundle, recall_explain, recall_reach, recall_co_derived, supersession, refused_conflicts,
    fact_history, overlapping_versions, ranges_and_gaps, records_page, records_about, newest_facts, entity_inspection, visible_facts, no_scope_no_answer, citations,
)} | {"read_current": _read(None, None), "read_valid_at": _read(VALID, None), "read_known_at": _read(None, KNOWN), "read_bitemporal": _read(VALID, KNOWN)}

_VCOLS = "fact_id, subject_id, object_value, valid_from, valid_to, known_from, known_to"
_WALKED = ",".join([QUESTIONS_SQL, ANCHORS_SQL, VISIBLE_SQL, EDGES_SQL])
_CUT = ",".join([_WALKED, WALK_SQL, EVIDENCE_SQL, CUT_SQL])
ORACLES = {
    "question_terms": f"WITH {QUESTIONS_SQL} SELECT question_id, count(*) AS n_terms, max(term) AS last_term FROM terms GROUP BY 1",
    "recall_anchors": with_shapes("entities", f"{QUESTIONS_SQL}, {ANCHORS_SQL} SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY length(term) DESC, canonical_name, anchor_id)::INT AS place FROM anchors"),
    "anchors_of_subject": with_shapes("entities lineage", "SELECT entity_id AS anchor_id, canonical_name FROM entities WHERE entity_type = 'person' AND entity_id IN (SELECT split_part(projection_id, ':', 2) || ':' || split_part(projection_id, ':', 3) FROM lineage WHERE projection_kind = 'fact' AND data_subject_id = 'u3')"),
    "fanout_edges": with_shapes("facts", f"{VISIBLE_SQL}, {EDGES_SQL} SELECT entity_id, direction, count(*) AS kept, bool_or(capped) AS capped FROM edges GROUP BY 1, 2"),
    "walk_one_hop": with_shapes("entities facts", f"{_WALKED}, {WALK_SQL} SELECT question_id, fact_id, anchor_id, hops, capped FROM h1 QUALIFY row_number() OVER (PARTITION BY question_id, fact_id ORDER BY anchor_id, path) = 1"),
    "walk_two_hops": with_shapes("entities facts", f"{_WALKED}, {WALK_SQL} SELECT question_id, fact_id, anchor_id, hops, array_to_string(path, '>') AS path, array_to_string(via, '>') AS via, capped FROM walked"),
    "recall_bundle": with_shapes("entities facts lineage", f"{_CUT} SELECT question_id, place::INT AS place, fact_id, hops, predicate, subject_name, object_name, source_id, size, total::BIGINT AS total FROM cutted WHERE cut IS NULL"),
    "recall_explain": with_shapes("entities facts lineage", f"{_CUT} SELECT question_id, count(*) AS offered, count(*) FILTER (cut IS NULL) AS kept, count(*) FILTER (cut = 'rows') AS cut_rows, count(*) FILTER (cut = 'characters') AS cut_characters FROM cutted GROUP BY 1"),
    "recall_reach": with_shapes("entities facts lineage", f"""{_CUT}, per AS (SELECT question_id, anchor_id, count(*) AS n, bool_or(capped) AS capped FROM cutted WHERE cut IS NULL GROUP BY 1, 2),
        f AS (SELECT question_id, sum(n)::BIGINT AS facts, max(n) AS most, bool_or(capped) AS capped FROM per GROUP BY 1), t AS (SELECT question_id, count(*) AS terms FROM terms GROUP BY 1), an AS (SELECT question_id, count(DISTINCT anchor_id) AS anchors FROM anchors GROUP BY 1)
        SELECT question_id, terms, coalesce(anchors, 0) AS anchors, coalesce(facts, 0) AS facts, coalesce(most, 0) AS most_from_one, coalesce(capped, false) AS capped FROM t LEFT JOIN an USING (question_id) LEFT JOIN f USING (question_id)"""),
    "recall_co_derived": with_shapes("entities facts lineage", f"{_CUT}, e AS (SELECT question_id, fact_id, source_id, lower(subject_name) AS s FROM cutted WHERE cut IS NULL AND subject_name <> '') SELECT a.question_id, a.fact_id, count(DISTINCT b.fact_id) AS n, min(b.fact_id) AS first FROM e a JOIN e b ON a.question_id = b.question_id AND a.source_id = b.source_id AND a.s = b.s AND a.fact_id <> b.fact_id GROUP BY 1, 2"),
    "supersession": with_shapes("claims", f"{VERSIONS_SQL} SELECT claim_id, accepted, CASE WHEN accepted THEN next_valid END AS valid_to, CASE WHEN accepted THEN known_at END AS known_at FROM sup"),
    "refused_conflicts": with_shapes("claims", f"{VERSIONS_SQL} SELECT 'conflicting_value' AS reason, count(*) AS claims, count(DISTINCT subject_id) AS subjects FROM sup WHERE NOT accepted HAVING count(*) > 0"),
    "fact_history": with_shapes("claims", f"{VERSIONS_SQL} SELECT status, count(*) AS versions, count(DISTINCT subject_id) AS subjects, min(known_from) AS first, max(known_from) AS last FROM (SELECT *, CASE WHEN valid_to IS NULL THEN 'current' ELSE 'validity_closed' END AS status FROM vf UNION ALL SELECT *, 'knowledge_closed' FROM vh) GROUP BY 1"),
    "overlapping_versions": with_shapes("claims", f"{VERSIONS_SQL}, bad AS (SELECT fact_id, subject_id, valid_from, CASE WHEN substring(subject_id, 3)::BIGINT % 40 <> 0 THEN valid_to END AS t FROM vf) "
    "SELECT DISTINCT b.fact_id, b.subject_id, b.valid_from FROM bad a JOIN bad b ON a.subject_id = b.subject_id AND a.valid_from < b.valid_from AND (a.t IS NULL OR a.t > b.valid_from)"),
    "ranges_and_gaps": with_shapes("claims", f"{VERSIONS_SQL}, bad AS (SELECT fact_id, known_from, CASE WHEN substring(subject_id, 3)::BIGINT % 30 = 0 THEN known_to + INTERVAL 400 DAYS ELSE known_to END AS t FROM vh) "
    "SELECT count(*) AS versions, count(*) FILTER (t <= bad.known_from) AS empty, count(*) FILTER (t > vf.known_from) AS overlapping FROM bad LEFT JOIN vf USING (fact_id)"),
    "read_current": with_shapes("claims", f"{VERSIONS_SQL} SELECT {_VCOLS} FROM vf WHERE valid_to IS NULL AND known_to IS NULL"),
    "read_valid_at": with_shapes("claims", f"{VERSIONS_SQL} SELECT {_VCOLS} FROM vf WHERE {_IN('valid', VALID)} AND known_to IS NULL"),
    "read_known_at": with_shapes("claims", f"{VERSIONS_SQL} SELECT {_VCOLS} FROM va WHERE {_IN('known', KNOWN)} AND valid_to IS NULL"),
    "read_bitemporal": with_shapes("claims", f"{VERSIONS_SQL} SELECT {_VCOLS} FROM va WHERE {_IN('known', KNOWN)} AND {_IN('valid', VALID)}"),
    "records_page": with_shapes("facts", "SELECT predicate, fact_id, left(statement, 12) AS preview, strlen(statement)::INT AS bytes, length(statement) > 12 AS truncated FROM facts WHERE (predicate, fact_id) > ('created', 'created:s:10') ORDER BY predicate, fact_id LIMIT 101"),
    "records_about": with_shapes("facts", "SELECT DISTINCT fact_id, subject_id, object_id FROM facts WHERE subject_id = 'n:3' OR object_id = 'n:3' ORDER BY fact_id LIMIT 50"),
    "newest_facts": with_shapes("claims", f"{VERSIONS_SQL} SELECT fact_id, valid_from, object_value FROM vf ORDER BY valid_from DESC, fact_id DESC LIMIT 25"),
    "entity_inspection": with_shapes("facts entities", "e AS (SELECT predicate, unnest(list_distinct([subject_id, object_id])) AS entity_id FROM facts) SELECT entity_id, facts, predicates, canonical_name FROM (SELECT entity_id, count(*) AS facts, string_agg(DISTINCT predicate, ',' ORDER BY predicate) AS predicates FROM e GROUP BY 1) LEFT JOIN entities USING (entity_id)"),
    "visible_facts": with_shapes("facts", f"{VISIBLE_SQL} SELECT predicate, source_role, count(*) AS facts, avg(confidence) AS confidence FROM visible GROUP BY 1, 2"),
    "no_scope_no_answer": "SELECT 0::BIGINT AS anchors",
    "citations": with_shapes("lineage", f"{EVIDENCE_SQL} SELECT fact_id, count(*) AS spans, arg_min(source_id, (log_offset, source_id)) AS first_source FROM evidence GROUP BY 1"),
}
