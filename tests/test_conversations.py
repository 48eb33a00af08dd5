"""Contexts kept by batches equal those made of the whole log, after restarts, repeats and late messages."""

import random

from pyspark.sql import functions as F

from tessella.operators import pack
from tessella.streaming import jobs

SCHEMA = "conv long, turn int, role string, text string, turns int"


def test_contexts_by_batch_equal_recomputed_ones(spark, tmp_path):
    r = random.Random(1)
    rows = [(c, i, r.choice(["user", "assistant", "system"]), r.choice(["é" * 30, "short", "", None]), 0) for c in range(7) for i in range(r.randint(0, 14))] + [(None, 1, "user", "x", 0), (3, None, "user", "x", 0)]
    r.shuffle(rows)
    seen = []
    for k in range(3):
        part = rows[k::3] + r.sample(seen, min(len(seen), 5))  # late ones and repeats
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.record_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema)
        jobs.refresh_contexts(stream, str(tmp_path / "out"), str(tmp_path / "state"), "conv", "turn", "role", "text", limit=4, longest=12, buckets=2).awaitTermination()
        seen += rows[k::3]
        log = spark.createDataFrame(sorted(set(seen), key=repr), SCHEMA).filter("conv IS NOT NULL AND turn IS NOT NULL")
        want = {x.conv: [tuple(t) for t in x.turns] for x in pack.last_turns(log, "conv", "turn", "role", "text", limit=4, longest=12).collect()}
        assert {x.conv: [tuple(t) for t in x.turns] for x in jobs.current(spark, str(tmp_path / "out")).collect()} == want
    assert jobs.current(spark, str(tmp_path / "out")).agg(F.max("version")).first()[0] > 1


def test_contexts_keep_whole_texts(spark, tmp_path):
    said = {1: "é" * 499 + "yz", 2: "word " * 3000 + "end", 3: "x" * 501, 4: None}
    for turns in ((1, 3), (2, 4)):
        spark.createDataFrame([(7, k, "user", said[k]) for k in turns], "conv long, turn int, role string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.record_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], "conv long, turn int, role string, text string").schema)
        jobs.refresh_contexts(stream, str(tmp_path / "out"), str(tmp_path / "state"), "conv", "turn", "role", "text", buckets=2).awaitTermination()
    assert {t.turn: t.text for t in jobs.current(spark, str(tmp_path / "out")).first().turns} == said


def test_a_batch_is_computed_once(spark, tmp_path):
    (tmp_path / "seen").mkdir()

    def noted(k):
        with open(tmp_path / "seen" / str(k), "a") as f:
            f.write("x")
        return k

    spark.range(20).select(F.col("id").alias("k"), (F.col("id") * 2).alias("at")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.record_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], "k long, at long").schema)
    note = F.udf(noted, "long").asNondeterministic()
    jobs.ingest(stream, str(tmp_path / "out"), str(tmp_path / "state"), ["k"], [F.desc("at")], lambda rows: rows.withColumn("k", note("k")), buckets=2).awaitTermination()
    assert sorted(x.k for x in jobs.current(spark, str(tmp_path / "out")).collect()) == list(range(20))
    assert {(tmp_path / "seen" / str(k)).read_text() for k in range(20)} == {"x"}
