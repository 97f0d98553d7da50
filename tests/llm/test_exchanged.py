"""Near-dedup exchanges hashes, not texts, also where Spark broadcasts nothing."""

import random

import numpy as np

from quietwave.llm import simhash


def shuffled(spark):
    """Bytes written to shuffles by all stages so far."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(
        spark._jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}


def test_near_dedup_does_not_exchange_texts(spark):
    rng, rows = random.Random(5), []
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=3000))
    for i in range(80):
        words = [word() for _ in range(50)]
        rows.append((2 * i, " ".join(words)))
        if i < 4:
            rows.append((2 * i + 1, " ".join([*words, "more"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = simhash.Work(spark, "texts").save(docs, "docs")
        before = shuffled(spark)
        kept = [r["doc_id"] for r in simhash.keep_first(docs).select("doc_id").collect()]
        moved = sum(b - before.get(k, 0) for k, b in shuffled(spark).items())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert sorted(kept) == [2 * i for i in range(80)]
    # the sample of about 4000 texts that tells common shingles is exchanged once; here it holds all
    assert moved < 1.25 * sum(len(t) for _, t in rows)


def test_bit_table_keeps_every_mark(spark):
    marks = [(1 << 63) - 1, -(1 << 63), -1, 0, 63, 64, *range(-5000, 5000, 7)]
    wanted = spark.createDataFrame([(m,) for m in marks], "mark long")
    for most in (1 << 26, 1024):
        assert simhash.marked_rows(simhash.mark_bits(wanted, most=most), np.array(marks, np.int64)).all()
    few = simhash.marked_rows(simhash.mark_bits(wanted.limit(3)), np.arange(100, 900, dtype=np.int64))
    assert few.sum() < 10 and not simhash.marked_rows(simhash.mark_bits(wanted.where("false")), np.array(marks, np.int64)).any()
