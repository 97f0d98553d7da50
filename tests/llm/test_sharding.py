"""Shards hold the whole records, in the order of their slots."""

import zlib
from pathlib import Path

import pyarrow.parquet as pq

import __spark_entry__ as entry
from quietwave.llm import sharding

SF_DIR = "/root/testdata/sf0.001"


def test_op6_digests_come_from_texts_in_shard_files(spark):
    got = entry.queries()["op6_external_shuffle_sharding"](spark, SF_DIR)
    files = got.inputFiles()
    assert files and all("/shard=" in f for f in files)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    wanted = {r["doc_id"]: (r["shard"], r["slot"], r["text_crc32"]) for r in got.collect()}
    seen = {}
    for f in files:
        shard = int(f.split("/shard=")[1].split("/")[0])
        rows = pq.ParquetFile(f.replace("file://", "")).read().to_pylist()
        assert [r["slot"] for r in rows] == sorted(r["slot"] for r in rows)
        for r in rows:
            assert r["text"] == docs[r["doc_id"]]
            seen[r["doc_id"]] = (shard, r["slot"], zlib.crc32((r["text"] or "").encode()))
    assert seen == wanted and set(seen) == set(docs)


def test_placed_rows_are_written_in_ranges_without_another_exchange(spark, tmp_path):
    df = spark.range(500).selectExpr("id AS doc_id", "repeat('x', CAST(id % 50 AS INT)) AS text").withColumn("size", sharding.record_size())
    placed = sharding.shuffle_into_shards(df, "doc_id", "size", 3, bucket_bytes=1000)
    path = str(tmp_path / "shards")
    sharding.write_shards(placed, path, placed=True)
    for folder in Path(path).glob("shard=*"):
        slots = [r["slot"] for f in sorted(folder.glob("*.parquet")) for r in pq.ParquetFile(f).read().to_pylist()]
        assert slots == list(range(len(slots)))
    back = sharding.read_shards(spark, path, placed.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, placed.collect()))
