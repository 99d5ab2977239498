"""Sealed ranges by rank, and archive files whose damage is named by its first seal."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import archive, ledger
from factloom.plans.session import shared_dir, stored

BATCH = 10


@pytest.fixture(scope="module")
def entries(spark):
    """Ids with gaps: seals cover the next ten entries, not ten ids."""
    ids = sorted(random.Random(4).sample(range(3, 400), 47))
    rows = [(i, "observe", f"u{i % 5}", "credential" if i % 2 else "operator", "p", i % 7, "allowed", f"2024-01-01 00:00:{i % 60:02d}.{i:06d}") for i in ids]
    df = spark.createDataFrame(rows, "entry_id long, operation string, principal string, principal_kind string, project string, magnitude long, outcome string, t string")
    return df.withColumn("occurred_at", F.col("t").cast("timestamp")).drop("t")


@pytest.fixture(scope="module")
def seals(entries):
    return stored(ledger.chain(ledger.seal_ranges(entries, BATCH)), "seals")


def plain(entries):
    """Seals by a walk over the lines."""
    rows = sorted((r.entry_id, r.line) for r in entries.select("entry_id", ledger.entry_line().alias("line")).collect())
    out, previous, lo = [], bytes(32), 0
    for k in range(0, len(rows), BATCH):
        part = rows[k : k + BATCH]
        digest = hashlib.sha256("\n".join(line for _, line in part).encode())
        sealed = hashlib.sha256(previous + digest.digest())
        out.append((k // BATCH, lo, part[-1][0], len(part), digest.hexdigest(), previous.hex(), sealed.hexdigest()))
        previous, lo = sealed.digest(), part[-1][0] + 1
    return out


def test_seals_cover_the_next_entries_by_rank(entries, seals):
    assert [tuple(r) for r in seals.orderBy("seal").collect()] == plain(entries)
    line = entries.orderBy("entry_id").select(ledger.entry_line().alias("x")).first().x
    assert line.split("|")[3] in ("operator", "credential") and len(line.split("|")) == 8


def test_a_checkpoint_goes_on_with_the_same_chain(entries, seals):
    mark = archive.checkpoint(seals, 2)
    rest = archive.remaining(entries, mark)
    again = ledger.chain(ledger.seal_ranges(rest, BATCH, mark["through_entry"], 3), mark["digest"])
    assert [tuple(r) for r in again.orderBy("seal").collect()] == plain(entries)[3:]
    with pytest.raises(ValueError):
        archive.checkpoint(seals, 99)


def test_standing_names_the_first_failure(entries, seals):
    of = lambda e, s=seals: ledger.standing(s, e, ledger.verify(s, e)).first()
    some = plain(entries)
    good = of(entries)
    assert good.valid and good.unsealed == 0 and good.head == some[-1][6] and good.seals == 5
    part = seals.where("seal < 3")
    assert of(entries, part).valid and of(entries, part).unsealed == 17
    bad = of(entries.withColumn("outcome", F.when(F.col("entry_id") > some[2][1], "refused").otherwise(F.col("outcome"))))
    assert (bad.valid, bad.first_failure, bad.fault) == (False, 2, "entries_changed")
    gone = of(entries.where(F.col("entry_id") != some[1][2]))
    assert (gone.first_failure, gone.fault) == (1, "entries_missing")
    relinked = seals.withColumn("previous", F.when(F.col("seal") == 3, F.lit("11" * 32)).otherwise(F.col("previous")))
    assert (of(entries, relinked).first_failure, of(entries, relinked).fault) == (3, "broken_link")
    rewritten = seals.withColumn("sealed", F.when(F.col("seal") == 4, F.lit("22" * 32)).otherwise(F.col("sealed")))
    assert (of(entries, rewritten).first_failure, of(entries, rewritten).fault) == (4, "wrong_digest")


def test_files_hold_and_their_lines_are_those_that_were_sealed(spark, entries, seals):
    path = f"{shared_dir(spark)}/archive-whole"
    archive.write(archive.lines(seals, entries, 2), path)
    found = archive.verify_files(spark, path).orderBy("file").collect()
    assert [(r.file, r.valid, r.failure, r.seals) for r in found] == [(0, True, None, 2), (1, True, None, 2), (2, True, None, 1)]
    assert sum(r.entries for r in found) == 47 and found[-1].head == plain(entries)[-1][6] and found[0].previous == archive.ZERO
    assert [r.previous for r in found[1:]] == [r.head for r in found[:-1]]
    empty = f"{shared_dir(spark)}/archive-empty"
    archive.write(archive.lines(seals.limit(0), entries, 2), empty)


@pytest.mark.parametrize(
    "damage,seal,why",
    [
        (lambda v, e: v.replace("observe", "obscure") if e and e % 3 == 0 else v, None, "entries_changed"), (lambda v, e: None if e and e % 3 == 0 else v, None, "entries_missing"),
        (lambda v, e: v.replace('"entry_count":10', '"entry_count":11'), 2, "entries_missing"), (lambda v, e: v.replace('"version":1', '"version":2'), None, "malformed"),
        (lambda v, e: "{" if e else v, None, "malformed"), (lambda v, e: v.replace('"through_seal":3', '"through_seal":4'), 3, "end_missing"),
    ],
)
def test_damage_is_named_by_its_first_seal(spark, entries, seals, damage, seal, why, tmp_path):
    rows = archive.lines(seals, entries, 2).orderBy("file", F.asc_nulls_first("seal"), F.asc_nulls_first("entry_id")).collect()
    path, first = tmp_path, None
    for f in range(3):
        (path / f"file={f}").mkdir()
        kept = []
        for r in (r for r in rows if r.file == f):
            v = damage(r.value, r.entry_id) if f == 1 else r.value
            if f == 1 and v != r.value and r.entry_id and first is None:
                first = r.seal
            kept += [] if v is None else [v]
        (path / f"file={f}" / "part.txt").write_text("\n".join(kept) + "\n")
    found = {r.file: (r.valid, r.failed_seal, r.failure) for r in archive.verify_files(spark, f"file://{path}").collect()}
    assert found[0] == (True, None, None) and found[2][0] and found[1] == (False, None if why == "malformed" else first if seal is None else seal, why)


def test_a_file_that_follows_another_is_a_broken_link(spark, entries, seals):
    rows = archive.lines(seals, entries, 2)
    path = f"{shared_dir(spark)}/archive-gap"
    archive.write(rows.where("file <> 1"), path)
    assert [(r.file, r.valid, r.failure) for r in archive.verify_files(spark, path).orderBy("file").collect()] == [(0, True, None), (2, False, "broken_link")]
    one = "\n".join(r.value for r in rows.where("file = 0").orderBy(F.asc_nulls_first("seal"), F.asc_nulls_first("entry_id")).collect()).encode()
    assert archive.checked(one, plain(entries)[1][6])["valid"] and archive.checked(one, "33" * 32)["failure"] == "other_head"
    assert archive.checked(b"")["failure"] == "malformed" and archive.checked(json.dumps({"version": 1, "previous_digest": archive.ZERO, "through_seal": 0, "through_entry": 0}).encode())["failure"] == "end_missing"
