"""Anchored windows of reads: the batch against a loop, the stream against the batch, whatever order reads come in."""

import random
from datetime import datetime, timedelta

from factloom.streaming import reads

READS = "principal string, project string, occurred_at timestamp"


def made(rng, n):
    start = datetime(2024, 1, 1)
    return [(f"u{rng.choice([0, 0, 0, 1, 2])}", f"p{rng.randint(0, 1)}", start + timedelta(seconds=rng.randint(0, 1200))) for _ in range(n)]


def plain(rows, seconds):
    out = []
    for key in {r[:2] for r in rows}:
        times = sorted(r[2] for r in rows if r[:2] == key)
        while times:
            inside = [t for t in times if t < times[0] + timedelta(seconds=seconds)]
            if len(inside) > 1:
                out.append((*key, inside[0], len(inside) - 1))
            times = times[len(inside) :]
    return sorted(out)


def shown(df):
    return sorted((r.principal, r.project, datetime(1970, 1, 1) + timedelta(microseconds=r.start), r.further) for r in df.collect())


def test_batch_equals_a_loop(spark):
    rows = made(random.Random(1), 400)
    odd = [(None, "p", rows[0][2]), ("u", None, rows[0][2]), ("u0", "p0", None)]
    assert shown(reads.counted(spark.createDataFrame(rows + odd, READS), 60)) == plain(rows, 60)
    assert reads.counted(spark.createDataFrame([], READS), 60).count() == 0


def test_stream_equals_batch_after_restarts(spark, tmp_path):
    rng = random.Random(2)
    rows = sorted(made(rng, 300), key=lambda r: r[2] + timedelta(seconds=rng.randint(0, 100)))
    parts, end = [rows[:100], rows[100:200], rows[200:]], [("end", "p", rows[0][2] + timedelta(days=1))]
    for part in [*parts, end]:
        spark.createDataFrame(part, READS).write.mode("append").parquet(f"{tmp_path}/in")
        stream = reads.streamed(spark.readStream.schema(READS).parquet(f"{tmp_path}/in"), 60, "150 seconds")
        out = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at")
        out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert shown(spark.read.schema(reads.COUNTED).parquet(f"{tmp_path}/out")) == plain(rows, 60)
