"""Lifetimes by provider and upserted previews, on streams of several files."""

import datetime
import os
import random

from pyspark.sql import functions as F

from evidence_spark.streaming import jobs as ST

START = datetime.datetime(2026, 1, 1)


def write(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def test_four_lifetimes_in_one_stream(spark, tmp_path):
    rng = random.Random(4)
    lives, default = {"news": 600, "web": 1800, "encyclopedia": 21600}, 3600
    providers = [*lives, "page", None]
    moments = sorted(rng.randrange(0, 200_000) for _ in range(900))
    rows = [(i, START + datetime.timedelta(seconds=m // 60 * 60), rng.choice(providers), rng.randrange(3)) for i, m in enumerate(moments)]
    stored, want = {}, set()
    for i, at, provider, k in rows:
        if (provider, k) not in stored or (at - stored[provider, k]).total_seconds() > lives.get(provider, default):
            stored[provider, k] = at
            want.add(i)
    schema = "event_id long, ts timestamp, provider string, k int"
    for n in range(6):
        write(spark, rows[n * 150:(n + 1) * 150], schema, tmp_path / "in")
    table = spark.createDataFrame(rows + [(10_000, None, "news", 0)], schema)
    life = ST.lifetime("provider", lives, default)
    assert {r["event_id"] for r in ST.fresh_keys_batch(table, ["provider", "k"], "event_id", "ts", life).collect()} == want
    stream = ST.event_stream(spark, str(tmp_path / "in"), table.schema, glob="*.parquet")
    fresh = ST.fresh_keys(stream, ["provider", "k"], "event_id", "ts", life, 21600)
    got = ST.run_to_table(fresh, str(tmp_path / "out"), str(tmp_path / "state"), "append")
    assert {r["event_id"] for r in got.collect()} == want


def test_preview_by_upsert(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randrange(12) if rng.random() < 0.6 else 7, rng.random()) for _ in range(400)]
    schema = "k long, value double"
    source, state = tmp_path / "in", tmp_path / "state"

    def run(n_rows):
        """The preview after the files at hand; equal to the batch answer on their rows."""
        frame = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        got = ST.run_to_upserts(ST.preview_totals(frame, "k", "value"), ["k"], str(tmp_path / "out"), str(state))
        want = ST.preview_totals(spark.createDataFrame(rows[:n_rows], schema), "k", "value")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))

    source.mkdir()
    run(0)
    for n in range(3):
        write(spark, rows[n * 80:(n + 1) * 80], schema, source)
    run(240)
    triggers = {f for f in os.listdir(tmp_path / "out") if f.startswith("trigger=")}
    assert len(triggers) >= 4
    # The last trigger was written, but its commit was lost: it runs again and replaces its folder.
    last = max(int(f) for f in os.listdir(state / "commits") if f.isdigit())
    for name in (str(last), f".{last}.crc"):
        if (state / "commits" / name).exists():
            (state / "commits" / name).unlink()
    run(240)
    assert {f for f in os.listdir(tmp_path / "out") if f.startswith("trigger=")} == triggers
    for n in range(3, 5):
        write(spark, rows[n * 80:(n + 1) * 80], schema, source)
    run(400)
    untouched = spark.read.parquet(str(tmp_path / "out")).groupBy("trigger").agg(F.count("*").alias("n"))
    assert all(r["n"] <= 12 for r in untouched.collect())
