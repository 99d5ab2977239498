"""Artifacts after random logs against one sequence of commands a scope."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from factloom.operators import artifacts as ar

ID = "00000000-0000-0000-0000-00000000000{}"
POLICY = "scope string, max_object_bytes long, max_bytes long, max_objects long, max_age_hours int"


def log(rng, scope, n):
    seen, rows = {}, []
    for i in range(n):
        name, now = ID.format(rng.randint(0, 5)), datetime(2024, 1, 1) + timedelta(hours=i)
        known = seen.get(name, [])
        expected = rng.choice([None, *known[-2:], *known[-1:] * 3, 999]) if known else rng.choice([None, None, None, 5])
        if rng.random() < 0.15 and known:
            rows.append((scope, i, "delete", name, rng.choice([None, "u", "v"]), None, None, None, None, known[-1], now))
        elif rng.random() < 0.15 and rows and rows[-1][2] == "put":
            rows.append((scope, i, *rows[-1][2:-1], now))
        else:
            size = rng.randint(0, 60)
            rows.append((scope, i, "put", name, rng.choice("uuuuv"), "state", f"n{i % 3}", size, f"d{size}", expected, now))
        seen.setdefault(name, []).append(i)
    return rows


def plain(rows, max_object, max_bytes, max_objects, hours):
    out, store, ever = {}, {}, set()
    for _, seq, op, name, subject, kind, title, size, digest, expected, at in rows:
        old = store.get(name)
        alive = old is not None and at < old["born"] + timedelta(hours=hours)
        if op == "delete":
            if not alive or (subject and subject != old["subject"]):
                out[seq] = "not_found"
            elif old["history"][-1] != expected:
                out[seq] = "conflict"
            else:
                out[seq] = "deleted"
                del store[name]
            continue
        if not alive and expected is not None:
            out[seq] = "not_found"
        elif not alive and name in ever:
            out[seq] = "conflict"
        elif alive and (old["subject"] != subject or old["kind"] != kind):
            out[seq] = "conflict"
        elif alive and expected is None:
            out[seq] = "replayed" if old["digests"][0] == digest else "conflict"
        elif alive and old["history"][-1] != expected:
            twice = len(old["history"]) > 1 and old["history"][-2] == expected and old["digests"][-1] == digest
            out[seq] = "replayed" if twice else "conflict"
        else:
            total = sum(x["size"] for k, x in store.items() if k != name) + size
            grows = not alive or size > old["size"]
            if grows and (size > max_object or total > max_bytes or (not alive and len(store) + 1 > max_objects)):
                out[seq] = "capacity"
                continue
            out[seq] = "replaced" if alive else "created"
            ever.add(name)
            x = old if alive else {"born": at, "history": [], "digests": []}
            store[name] = x | {"history": [*x["history"], seq], "digests": [*x["digests"], digest], "subject": subject, "kind": kind, "size": size, "title": title}
    return out, {k: (x["history"][-1], x["title"], x["size"]) for k, x in store.items()}


@pytest.mark.parametrize("limits", [(100, 10_000, 100, 5000), (55, 150, 100, 5000), (100, 10_000, 2, 5000), (50, 160, 3, 60)])
def test_replay_equals_one_sequence(spark, tmp_path, limits):
    rng, n = random.Random(sum(limits)), iter(range(100))

    def write(df):
        path = f"{tmp_path}/{next(n)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    logs = {f"s{i}": log(rng, f"s{i}", 150) for i in range(6)}
    rows = [r for x in logs.values() for r in x]
    rng.shuffle(rows)
    rows += [("s0", 1000, "put", "no uuid", "u", "state", "n", 1, "d", None, datetime(2024, 1, 1)), ("s0", 1001, "put", ID.format(1), "u", "odd", "n", 1, "d", None, datetime(2024, 1, 1))]
    rows += [("s0", 1002, "delete", ID.format(1), "u", None, None, None, None, None, datetime(2024, 1, 1)), (None, 1, "put", ID.format(1), "u", "state", "n", 1, "d", None, datetime(2024, 1, 1))]
    rows += [("s0", 1003, None, None, None, None, None, None, None, None, None), ("s0", 1004, "put", ID.format(1), "u", "file", "n" * 257, 1, "d", None, datetime(2024, 1, 1))]
    policies = spark.createDataFrame([(s, *limits) for s in logs], POLICY)
    said, stand = ar.replay(spark.createDataFrame(rows, ar.COMMANDS), policies, write)
    said, stand = said.collect(), stand.collect()
    kinds = set()
    for s, x in logs.items():
        want, left = plain(x, *limits)
        kinds |= set(want.values())
        assert {r.seq: r.outcome for r in said if r.scope == s and r.seq < 1000} == want
        assert {r.artifact_id: (r.version, r.name, r.bytes) for r in stand if r.scope == s} == left
    assert kinds >= {"created", "replaced", "conflict", "not_found", "deleted", "replayed"}
    assert {r.seq: r.outcome for r in said if r.scope == "s0" and r.seq >= 1000} == dict.fromkeys(range(1000, 1005), "invalid")
    assert [r.outcome for r in said if r.scope is None] == ["no_such_project"]


def test_empty_log_and_digest(spark, tmp_path):
    n = iter(range(100))

    def write(df):
        path = f"{tmp_path}/{next(n)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    said, stand = ar.replay(spark.createDataFrame([], ar.COMMANDS), spark.createDataFrame([], POLICY), write)
    assert said.count() == stand.count() == 0
    d = lambda *x: ar.request_digest(*map(F.lit, x))
    one, two, three = spark.range(1).select(d("a", "state", "bc", b""), d("a", "state", "b", b"c"), d("a", "state", "bc", b"")).first()
    assert one == three != two
