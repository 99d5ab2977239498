"""Documents, model replies and erasure records as they come in from files."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 16 << 20
CLAIM_FIELDS = "array<struct<subject:string,predicate:string,object:string,statement:string,confidence:float,subject_type:string,object_type:string,quote:string,polarity:string,tense:string>>"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Text and Markdown files: `path, text, fault`. Texts lose white space at their end; null bytes, blanks and oversize are faults."""
    files = spark.read.format("binaryFile").load(path).select("path", "content", "length")
    text = F.expr("try_validate_utf8(cast(content as string))")
    rows = files.select("path", F.regexp_replace(text, r"(?U)\s+$", "").alias("text"), "length", text.isNull().alias("broken"))
    fault = F.when(F.col("length") > MOST_BYTES, "too_large").when(F.col("broken"), "not_utf8").when(F.contains("text", F.lit("\0")), "null_byte").when(F.trim("text") == "", "blank")
    return rows.select("path", "text", fault.alias("fault"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents `{title?, text, occurred_at?}`; a file with other fields, or none of text, is at fault."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    known = F.expr("map_keys(from_json(value, 'map<string,string>'))")
    parsed = F.from_json("value", "title string, text string, occurred_at timestamp")
    rows = files.select("path", parsed.alias("d"), F.size(F.array_except(known, F.array(F.lit("title"), F.lit("text"), F.lit("occurred_at")))).alias("extra"))
    fault = F.when(F.col("d").isNull(), "not_json").when(F.col("extra") > 0, "unknown_field").when(F.trim(F.coalesce("d.text", F.lit(""))) == "", "blank")
    return rows.select("path", "d.title", "d.text", "d.occurred_at", fault.alias("fault"))


def first_claims(reply: str) -> str | None:
    """The first JSON object with a list of claims in a model's reply, with or without a code fence around it; at most 32 places are tried."""
    decoder, at = json.JSONDecoder(), -1
    for _ in range(32):
        at = reply.find("{", at + 1)
        if at < 0:
            return None
        try:
            value, _ = decoder.raw_decode(reply, at)
        except ValueError:
            continue
        if isinstance(value, dict) and isinstance(value.get("claims"), list):
            return json.dumps(value["claims"])
    return None


def parse_replies(replies: DataFrame, column: str = "reply") -> DataFrame:
    """Replies with their `claims`, null where there are none to read. A reply that is such an object stays in the JVM."""
    find = F.pandas_udf(lambda s: s.map(lambda r: first_claims(r) if r else None), "string")
    plain = F.get_json_object(F.col(column), "$.claims")
    found = F.coalesce(F.when(F.startswith(F.col(column), F.lit("{")), plain), find(F.col(column)))
    return replies.withColumn("claims", F.from_json(found, CLAIM_FIELDS))


def erasure_records(lines: DataFrame, key: bytes) -> DataFrame:
    """`request_id, parts, authentic` from log lines that carry `erasure-record part=<base64 JSON> mac=<hex>`; parts are regrouped by request."""

    def sign(parts: pd.Series) -> pd.Series:
        return parts.map(lambda p: hmac.new(key, base64.b64decode(p), hashlib.sha256).hexdigest())

    found = lines.select(F.regexp_extract("value", r"erasure-record part=([A-Za-z0-9+/=]+) mac=([0-9a-f]{64})", 1).alias("part"), F.regexp_extract("value", r"mac=([0-9a-f]{64})", 1).alias("mac")).where("part <> ''")
    rows = found.withColumn("body", F.from_json(F.unbase64("part").cast("string"), "request string, n int, source string")).withColumn("good", F.pandas_udf(sign, "string")("part") == F.col("mac"))
    return rows.groupBy(F.col("body.request").alias("request_id")).agg(F.array_sort(F.collect_set("body.source")).alias("sources"), F.bool_and("good").alias("authentic"))


def destination_fault() -> Column:
    """Why a notification may not go to the address in column `url`: another scheme than https, or a private host. Null if it may."""
    host = F.expr("parse_url(url, 'HOST')")
    private = host.rlike(r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|\[)")
    return F.when(F.expr("parse_url(url, 'PROTOCOL')") != "https", "scheme").when(host.isNull(), "host").when(private, "private")
