"""The driver's tables in the shapes of the memory model, as DataFrames and, for the oracles, as DuckDB queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import normalised
from factloom.schemas import VOCABULARY

LEARNED = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def role_of(key: str) -> Column:
    return F.expr(f"element_at(array('user', 'assistant', 'tool', 'system'), cast({key} % 4 as int) + 1)")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`scope, entity_id, canonical_name, normalized_name, entity_type`; of equal normalised names the lowest id."""
    parts = [("customer", "c:", "c_custkey", "c_name", "person"), ("supplier", "s:", "s_suppkey", "s_name", "organisation"), ("nation", "n:", "n_nationkey", "n_name", "place"), ("region", "r:", "r_regionkey", "r_name", "place")]
    rows = [table(spark, sf_dir, t).selectExpr(f"'{p}' || {k} as entity_id", f"translate({n}, '#_', '  ') as canonical_name", f"'{e}' as entity_type") for t, p, k, n, e in parts]
    things = table(spark, sf_dir, "part").withColumn("normalized", normalised(F.col("p_name"))).groupBy("normalized").agg(F.min(F.struct("p_partkey", "p_name")).alias("x"))
    rows.append(things.selectExpr("'p:' || x.p_partkey as entity_id", "x.p_name as canonical_name", "'thing' as entity_type"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.select(F.lit("p0").alias("scope"), "entity_id", "canonical_name", normalised(F.col("canonical_name")).alias("normalized_name"), "entity_type")


def _facts(rows: DataFrame, predicate: str, subject: str, obj: str, key: str, cardinality: str) -> DataFrame:
    return rows.select(
        F.lit("p0").alias("scope"), F.expr(f"'{predicate}:' || {subject} || ':' || {obj}").alias("fact_id"), F.expr(subject).alias("subject_id"), F.lit(predicate).alias("predicate"),
        F.expr(obj).alias("object_id"), F.expr(f"{subject} || ' {predicate} ' || {obj}").alias("statement"), role_of(key).alias("source_role"), F.lit(cardinality).alias("cardinality"),
        F.expr(f"'u' || ({key} % 11)").alias("data_subject_id"), F.expr(f"cast(0.5 + ({key} % 50) / 100.0 as double)").alias("confidence"), F.expr(f"timestamp'{LEARNED}'").alias("valid_from"),
        F.expr("cast(null as timestamp)").alias("valid_to"), F.expr(f"timestamp'{LEARNED}'").alias("known_from"), F.expr("cast(null as timestamp)").alias("known_to"),
        F.expr(f"case when {key} % 13 = 0 then timestamp'2024-03-01 00:00:00' end").alias("retention_until"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static facts: where customers live, where suppliers are, what nations are part of, which parts suppliers made."""
    made = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return (
        _facts(table(spark, sf_dir, "customer"), "lives_in", "'c:' || c_custkey", "'n:' || c_nationkey", "c_custkey", "one")
        .unionByName(_facts(table(spark, sf_dir, "supplier"), "located_in", "'s:' || s_suppkey", "'n:' || s_nationkey", "s_suppkey", "one"))
        .unionByName(_facts(table(spark, sf_dir, "nation"), "part_of", "'n:' || n_nationkey", "'r:' || n_regionkey", "n_nationkey", "many"))
        .unionByName(_facts(made, "created", "'s:' || l_suppkey", "'p:' || l_partkey", "l_partkey", "many"))
    )


def status_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`has_status` claims of orders in arrival order: `scope, account, subject_id, predicate, claim_id, object_value, valid_from, learned_at, arrival`."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = items.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    return rows.selectExpr(
        "'p0' as scope", "'' as account", "'o:' || l_orderkey as subject_id", "'has_status' as predicate", "l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || cast(l_shipdate as date) as claim_id",
        "l_returnflag || l_linestatus as object_value", "cast(l_shipdate as timestamp) as valid_from", "cast(o_orderdate as timestamp) + make_dt_interval(l_linenumber) as learned_at", "struct(l_linenumber, l_partkey, l_shipdate) as arrival",
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`scope, source_id, data_subject_id, occurred_at, ordinal, role, content` of conversations."""
    return table(spark, sf_dir, "conversations").selectExpr(
        "'p' || (conv_id % 3) as scope", "'o' || conv_id as source_id", "'u' || (conv_id % 11) as data_subject_id", "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, conv_id) as occurred_at",
        "cast(turn as int) as ordinal", "role", "coalesce(text, '') as content", "conv_id",
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a conversation."""
    return messages(spark, sf_dir).groupBy("scope", "source_id", "data_subject_id", "occurred_at", "conv_id").agg(F.count("*").alias("messages"), F.sum(F.char_length("content") + F.char_length("role")).alias("characters"))


def vocabulary(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{p}', '{s}', '{c}', '{o}', {str(e).lower()})" for p, s, c, o, e in VOCABULARY)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS v(predicate, semantic_type, cardinality, object_kind, event)")


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims proposed from messages by a fixed rule: the first two words are subject and object, counts decide the rest."""
    n = "char_length(content)"
    return (
        messages(spark, sf_dir)
        .withColumn("words", F.expr("split(content, ' ')"))
        .selectExpr(
            "scope", "source_id", "data_subject_id", "ordinal", "role", "content", "words[0] as subject", "coalesce(get(words, 1), '') as object",
            f"element_at(array('likes', 'knows', 'created', 'located_in', 'unheard_of'), cast({n} % 5 as int) + 1) as predicate",
            f"case when {n} % 7 = 0 then 'nowhere ' || left(content, 5) else substring(content, 3, 12) end as quote",
            f"case when {n} % 11 = 0 then 'denied' else 'asserted' end as polarity", f"case when {n} % 3 = 0 then 'past' else 'present' end as tense", "'person' as subject_type", "case when ordinal % 2 = 0 then 'thing' else 'gadget' end as object_type",
        )
    )


def fact_ids(spark: SparkSession, sf_dir: str, in_task: int = 100_000) -> DataFrame:
    """`fact_id, k` of `facts`, with its key, all rows of one id in one task: what goes on by `fact_id` moves nothing again.

    An id says all of its fact, so it alone is moved, once. A task gets about `in_task` rows of the largest table."""
    made = table(spark, sf_dir, "lineitem")
    rows = made.selectExpr("'created:s:' || l_suppkey || ':p:' || l_partkey as fact_id")
    rows = rows.unionByName(table(spark, sf_dir, "customer").selectExpr("'lives_in:c:' || c_custkey || ':n:' || c_nationkey as fact_id"))
    rows = rows.unionByName(table(spark, sf_dir, "supplier").selectExpr("'located_in:s:' || s_suppkey || ':n:' || s_nationkey as fact_id"))
    rows = rows.unionByName(table(spark, sf_dir, "nation").selectExpr("'part_of:n:' || n_nationkey || ':r:' || n_regionkey as fact_id"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), made.count() // in_task + 1)
    rows = rows.repartition(tasks, "fact_id").groupBy("fact_id").agg(F.count("*").alias("n"))
    created = F.col("fact_id").startswith("created:")
    # Only what suppliers made is told once however often it was sold.
    rows = rows.select("fact_id", F.explode(F.array_repeat(F.lit(0), F.when(created, 1).otherwise(F.col("n").cast("int")))).alias("_"))
    return rows.select("fact_id", F.split_part("fact_id", F.lit(":"), F.when(created, 5).otherwise(3)).cast("long").alias("k"))


def sources_of(rows: DataFrame, *columns: str) -> DataFrame:
    """The named columns beside `source_id, data_subject_id`: one to three sources of each row by its `k`."""
    source = lambda o: f"struct('o' || ({o}) as source_id, case when k % 5 <> 0 then 'u' || (({o}) % 11) end as data_subject_id)"
    arms = f"filter(array({source('k % 97')}, if(k % 2 = 0, {source('k % 89 + 100')}, null), if(k % 3 = 0, {source('k % 83 + 200')}, null)), x -> x is not null)"
    return rows.selectExpr(*columns, f"inline({arms})")


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`scope, projection_kind, projection_id, source_id, data_subject_id`: each fact has one to three sources by its key, each report one or two."""
    made = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    base = table(spark, sf_dir, "customer").selectExpr("c_custkey as k", "'lives_in:c:' || c_custkey || ':n:' || c_nationkey as projection_id")
    base = base.unionByName(table(spark, sf_dir, "supplier").selectExpr("s_suppkey as k", "'located_in:s:' || s_suppkey || ':n:' || s_nationkey as projection_id"))
    base = base.unionByName(table(spark, sf_dir, "nation").selectExpr("n_nationkey as k", "'part_of:n:' || n_nationkey || ':r:' || n_regionkey as projection_id"))
    base = base.unionByName(made.selectExpr("l_partkey as k", "'created:s:' || l_suppkey || ':p:' || l_partkey as projection_id"))
    facts_of = sources_of(base, "'p0' as scope", "'fact' as projection_kind", "projection_id")
    reports = table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").selectExpr("c_custkey as k")
    both = "array(struct('o' || (k % 97) as source_id, 'u' || ((k % 97) % 11) as data_subject_id), struct('o' || (k % 89 + 100) as source_id, 'u' || ((k % 89 + 100) % 11) as data_subject_id))"
    return facts_of.unionByName(reports.selectExpr("'p0' as scope", "'community_report' as projection_kind", "'report:' || k as projection_id", f"inline({both})"))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger entries from events."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as entry_id", "event_type as operation", "'u' || user_id as principal", "if(user_id % 5 = 0, 'operator', 'credential') as principal_kind", "'p' || (user_id % 4) as project", "cast(greatest(floor(value), 0) as bigint) as magnitude",
        "case when event_type = 'error' or event_id % 17 = 0 then 'refused' else 'allowed' end as outcome", "cast(ts as timestamp) as occurred_at",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("'p0' as scope", "'g' || (label % 2) as generation_id", "vec_id as item_id", "embedding")


# The same shapes for DuckDB.
_NORM = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"


def _fact_sql(source: str, predicate: str, subject: str, obj: str, key: str, cardinality: str) -> str:
    return (
        f"SELECT 'p0' AS scope, '{predicate}:' || {subject} || ':' || {obj} AS fact_id, {subject} AS subject_id, '{predicate}' AS predicate, {obj} AS object_id, {subject} || ' {predicate} ' || {obj} AS statement, "
        f"(['user', 'assistant', 'tool', 'system'])[({key} % 4)::INT + 1] AS source_role, '{cardinality}' AS cardinality, 'u' || ({key} % 11) AS data_subject_id, (0.5 + ({key} % 50) / 100.0)::DOUBLE AS confidence, "
        f"TIMESTAMP '{LEARNED}' AS valid_from, NULL::TIMESTAMP AS valid_to, TIMESTAMP '{LEARNED}' AS known_from, NULL::TIMESTAMP AS known_to, CASE WHEN {key} % 13 = 0 THEN TIMESTAMP '2024-03-01 00:00:00' END AS retention_until FROM {source}"
    )


_KEYED = (
    "SELECT c_custkey AS k, 'lives_in:c:' || c_custkey || ':n:' || c_nationkey AS projection_id FROM customer UNION ALL SELECT s_suppkey, 'located_in:s:' || s_suppkey || ':n:' || s_nationkey FROM supplier "
    "UNION ALL SELECT n_nationkey, 'part_of:n:' || n_nationkey || ':r:' || n_regionkey FROM nation UNION ALL SELECT l_partkey, 'created:s:' || l_suppkey || ':p:' || l_partkey FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)"
)
_N = "length(content)"
SHAPES = {
    "entities": "SELECT 'p0' AS scope, entity_id, canonical_name, " + _NORM.format("canonical_name") + " AS normalized_name, entity_type FROM ("
    "SELECT 'c:' || c_custkey AS entity_id, translate(c_name, '#_', '  ') AS canonical_name, 'person' AS entity_type FROM customer UNION ALL SELECT 's:' || s_suppkey, translate(s_name, '#_', '  '), 'organisation' FROM supplier "
    "UNION ALL SELECT 'n:' || n_nationkey, translate(n_name, '#_', '  '), 'place' FROM nation UNION ALL SELECT 'r:' || r_regionkey, translate(r_name, '#_', '  '), 'place' FROM region "
    "UNION ALL SELECT 'p:' || min(p_partkey), arg_min(p_name, p_partkey), 'thing' FROM part GROUP BY " + _NORM.format("p_name") + ")",
    "facts": " UNION ALL ".join([
        _fact_sql("customer", "lives_in", "'c:' || c_custkey", "'n:' || c_nationkey", "c_custkey", "one"), _fact_sql("supplier", "located_in", "'s:' || s_suppkey", "'n:' || s_nationkey", "s_suppkey", "one"),
        _fact_sql("nation", "part_of", "'n:' || n_nationkey", "'r:' || n_regionkey", "n_nationkey", "many"), _fact_sql("(SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)", "created", "'s:' || l_suppkey", "'p:' || l_partkey", "l_partkey", "many"),
    ]),
    "claims": "SELECT 'p0' AS scope, '' AS account, 'o:' || l_orderkey AS subject_id, 'has_status' AS predicate, l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_shipdate::DATE AS claim_id, l_returnflag || l_linestatus AS object_value, "
    "l_shipdate::TIMESTAMP AS valid_from, o_orderdate::TIMESTAMP + to_days(l_linenumber) AS learned_at, l_linenumber AS a1, l_partkey AS a2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "messages": "SELECT 'p' || (conv_id % 3) AS scope, 'o' || conv_id AS source_id, 'u' || (conv_id % 11) AS data_subject_id, TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) AS occurred_at, turn::INT AS ordinal, role, coalesce(text, '') AS content, conv_id FROM conversations",
    "observations": "SELECT scope, source_id, data_subject_id, occurred_at, conv_id, count(*) AS messages, sum(length(content) + length(role))::BIGINT AS characters FROM messages GROUP BY ALL",
    "vocabulary": "SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{s}', '{c}', '{o}', {str(e).lower()})" for p, s, c, o, e in VOCABULARY) + ") AS v(predicate, semantic_type, cardinality, object_kind, event)",
    "proposals": "SELECT scope, source_id, data_subject_id, ordinal, role, content, string_split(content, ' ')[1] AS subject, coalesce(string_split(content, ' ')[2], '') AS object, "
    f"(['likes', 'knows', 'created', 'located_in', 'unheard_of'])[({_N} % 5)::INT + 1] AS predicate, CASE WHEN {_N} % 7 = 0 THEN 'nowhere ' || left(content, 5) ELSE substring(content, 3, 12) END AS quote, "
    f"CASE WHEN {_N} % 11 = 0 THEN 'denied' ELSE 'asserted' END AS polarity, CASE WHEN {_N} % 3 = 0 THEN 'past' ELSE 'present' END AS tense, 'person' AS subject_type, CASE WHEN ordinal % 2 = 0 THEN 'thing' ELSE 'gadget' END AS object_type FROM messages",
    "lineage": " UNION ALL ".join(
        [f"SELECT 'p0' AS scope, 'fact' AS projection_kind, projection_id, 'o' || ({o}) AS source_id, CASE WHEN k % 5 <> 0 THEN 'u' || (({o}) % 11) END AS data_subject_id FROM ({_KEYED}) WHERE {w}" for o, w in (("k % 97", "true"), ("k % 89 + 100", "k % 2 = 0"), ("k % 83 + 200", "k % 3 = 0"))]
        + [f"SELECT 'p0', 'community_report', 'report:' || c_custkey, 'o' || ({o}), 'u' || (({o}) % 11) FROM customer WHERE c_custkey % 10 = 0" for o in ("c_custkey % 97", "c_custkey % 89 + 100")]
    ),
    "audit": "SELECT event_id AS entry_id, event_type AS operation, 'u' || user_id AS principal, CASE WHEN user_id % 5 = 0 THEN 'operator' ELSE 'credential' END AS principal_kind, 'p' || (user_id % 4) AS project, greatest(floor(value), 0)::BIGINT AS magnitude, CASE WHEN event_type = 'error' OR event_id % 17 = 0 THEN 'refused' ELSE 'allowed' END AS outcome, ts AS occurred_at FROM events",
    "vectors": "SELECT 'p0' AS scope, 'g' || (label % 2) AS generation_id, vec_id AS item_id, embedding FROM embeddings",
}
_NEEDS = {"observations": ["messages"], "proposals": ["messages"]}


def with_shapes(names: str, sql: str) -> str:
    """DuckDB SQL over some of the shapes: `sql` is either a query or further CTEs and a query (`WITH` left out)."""
    order: list[str] = []
    for name in names.split():
        order += [x for x in [*_NEEDS.get(name, []), name] if x not in order]
    head = ", ".join(f"{n} AS ({SHAPES[n]})" for n in order)
    body = sql.strip()
    return f"WITH {head} {body}" if body[:6].upper() == "SELECT" else f"WITH {head}, {body}"
