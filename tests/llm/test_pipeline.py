"""The corpus pipeline, stage by stage, against brute force."""

import pyarrow as pa
import pytest

import corpus_pipeline
from quietwave.llm import decontam
from tests.llm.test_texts import jaccard_classes, repeats

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, columns = spark.read.parquet(f"{SF}/documents.parquet"), None
    functions = dict(corpus_pipeline.STAGES)
    assert list(functions) == ["language ID", "SimHash near-dedup", "suffix-array dedup", "benchmark decontamination", "best-fit packing"]
    columns = docs.columns
    known = functions["language ID"](spark, docs, SF)
    before = {r["doc_id"]: r["text"] for r in known.collect()}
    assert known.columns == columns and set(before) == {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"])}
    single = functions["SimHash near-dedup"](spark, known, SF)
    reach = jaccard_classes(before)
    after = {r["doc_id"]: r["text"] for r in single.collect()}
    assert single.columns == columns and after == {k: t for k, t in before.items() if reach[k] == k}
    cut = functions["suffix-array dedup"](spark, single, SF)
    left = {r["doc_id"]: r for r in cut.collect()}
    for (k, t), (_, removed, _, _) in zip(after.items(), repeats([t.encode() for t in after.values()], 200), strict=True):
        assert (k not in left) if removed == len(t.encode()) and removed else abs(len(left[k]["text"].encode()) + removed - len(t.encode())) < 4 * 50
    clean = functions["benchmark decontamination"](spark, cut, SF)
    items = [decontam.normal(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = set(left) - {r["doc_id"] for r in clean.collect()}
    assert clean.columns == columns and {k for k, r in left.items() if any(i in decontam.normal(r["text"]) for i in items)} <= gone
    packed = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(left) - gone


def test_odd_and_empty_input(spark, odd, empty):
    for table in (odd, empty):
        docs = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == table.columns, name
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()


def test_contaminated_rows_go_one_by_one(spark):
    item = "the committee found that seven of the nine samples had been stored at the wrong temperature"
    rows = [(None, f"before {item} after"), (None, "clean text without a key"), (5, f"x {item}"), (5, "clean text of a repeated id"), (6, "other"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, "an item that stands in no text of this table, as far as is known")], "item_id long, text string")
    want = sorted(((k, t) for k, t in rows if item not in (t or "")), key=str)
    for size in (8 << 20, 100):
        assert sorted(map(tuple, decontam.drop_contaminated(docs, items, slice_bytes=size).collect()), key=str) == want


def test_language_stage_without_labels(spark):
    rows = [(1, "some text", None), (2, "漢字", None), (3, "12 -- !!", None), (4, None, None), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    stage = dict(corpus_pipeline.STAGES)["language ID"]
    assert sorted(map(tuple, stage(spark, docs, SF).collect())) == rows[:2]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_texts_come_to_python_in_bounded_batches(spark, name, stage):
    """Whatever the stage runs in Python gets batches of bounded bytes; one split of texts is not one batch."""
    docs = spark.createDataFrame([(i, f"text number {i}", "en") for i in range(20)], "doc_id long, text string, lang string")
    long = spark.range(3000, numPartitions=1).selectExpr("id", "repeat('some words ', 800) text")
    nbytes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key)
    spark.conf.set(key, "64m")
    try:
        stage(spark, docs, SF)
        sizes = [r["n"] for r in long.mapInArrow(nbytes, "n long").collect()]
    finally:
        spark.conf.set(key, held)
    assert sum(sizes) > 25_000_000 and max(sizes) < 4.5 * (1 << 20), name
