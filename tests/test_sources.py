"""Readers of files as they come, and the table that a stream of records keeps."""

import json
import pathlib

from pyspark.sql import functions as F

from tessella.operators import audit
from tessella.sources import readers
from tessella.streaming import jobs


def test_one_minutes_file_for_each_document(spark, tmp_path):
    bodies = {
        "jeonnam/a.json": json.dumps({"DOCID": "1", "MINTS_HTML": "<p>text</p>"}, indent=2),
        "jeonnam/b.json": json.dumps({"DOCID": " ", "MINTS_HTML": "<p>text</p>"}),
        "gyeonggi/c.json": json.dumps({"DOCID": "3", "MINTS_HTML": ""}),
        "gyeonggi/d.json": "{broken",
    }
    for name, body in bodies.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(body, encoding="utf-8")
    rows = readers.read_minutes(spark, str(tmp_path)).select("path", "region_code", "DOCID", "reject_reason").collect()
    got = {pathlib.PurePath(r["path"]).name: (r["region_code"], r["reject_reason"]) for r in rows}
    assert got == {
        "a.json": ("jeonnam", None), "b.json": ("jeonnam", "missing_docid"), "c.json": ("gyeonggi", "missing_html"), "d.json": ("gyeonggi", "invalid_json"),
    }


def test_permit_csv_in_each_encoding(spark, tmp_path):
    header, line = ",".join(readers.PERMIT_COLUMNS), ",".join("영암군" for _ in readers.PERMIT_COLUMNS)
    keys = set()
    for encoding in ("utf-8", "utf-8-sig", "cp949"):
        path = tmp_path / encoding
        path.mkdir()
        (path / "permits.csv").write_bytes(f"{header}\n{line}\n".encode(encoding))
        row = readers.read_permit_csv(spark, str(path), "영암군").first()
        assert row["jibun_address"] == "영암군"
        keys.add(row["source_record_key"])
    assert len(keys) == 1


def _feed(spark, root, name, rows):
    spark.createDataFrame(rows, "k int, at int, v string").coalesce(1).write.parquet(f"{root}/in/{name}")
    stream = jobs.record_stream(spark, f"{root}/in/*", spark.read.parquet(f"{root}/in/{name}").schema)
    jobs.ingest(stream, f"{root}/table", f"{root}/state", ["k"], [F.desc("at")], buckets=8).awaitTermination()
    return {r["k"]: r["v"] for r in jobs.current(spark, f"{root}/table").collect()}


def test_ingest_rewrites_only_the_buckets_of_new_keys(spark, tmp_path):
    assert jobs.current(spark, f"{tmp_path}/table") is None
    want = {k: f"a{k}" for k in range(40)}
    assert _feed(spark, tmp_path, "one", [(k, 5, v) for k, v in want.items()]) == want
    before = {b: len(v) for b, v in jobs._buckets(spark, f"{tmp_path}/table").items()}
    assert len(before) > 4 and set(before.values()) == {1}

    assert _feed(spark, tmp_path, "two", [(3, 9, "newer"), (4, 1, "older, comes late")]) == want | {3: "newer"}
    after = {b: len(v) for b, v in jobs._buckets(spark, f"{tmp_path}/table").items()}
    assert 1 <= sum(after[b] > before[b] for b in before) <= 2

    for i in range(3):
        want |= {3: f"newest {i}"}
        assert _feed(spark, tmp_path, f"more{i}", [(3, 10 + i, f"newest {i}")]) == want
    assert max(len(v) for v in jobs._buckets(spark, f"{tmp_path}/table").values()) == 2


def test_candidate_export_keeps_order_and_drops_documents_without_episodes(spark):
    rows = spark.createDataFrame([("b", 1, 7, 0.2), ("a", 2, 8, 0.5), ("a", 3, 9, 0.9), ("a", 2, 9, 0.7), ("a", 4, None, 0.99)], "region string, doc int, episode int, c double")
    got = [tuple(r) for r in audit.candidate_export(rows, "region", "doc", "episode", "c").collect()]
    assert got == [("a", 3, 1, 0.9), ("a", 2, 2, 0.7), ("b", 1, 1, 0.2)]
