"""Inputs that once stopped an operator."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quietwave.llm import decontam, media, packing, simhash, suffix, toxicity
from quietwave.llm.queries import tokenizer_path

ITEM = "a question about the height of the tower in the old town square"


@pytest.mark.parametrize("kind", ["int", "long", "string", "date"])
def test_item_keys_of_any_type(spark, kind):
    items = spark.createDataFrame([("1", ITEM), (None, ITEM + " again")], "i string, text string").select(
        (F.col("i") if kind != "date" else F.when(F.col("i").isNotNull(), "2024-01-01")).cast(kind).alias("item_id"), "text")
    docs = spark.createDataFrame([(1, f"so {ITEM} again and more"), (2, "clean")], "doc_id int, text string")
    got = decontam.find_matches(docs, items).collect()
    assert sorted(str(r["item_id"]) for r in got) == sorted(["None", "2024-01-01" if kind == "date" else "1"])
    assert decontam.find_matches(docs.where("false"), items).collect() == []


@pytest.mark.parametrize("raw", [b"P5 99999999999999999999 1 255", b"P4 -3 4", b"P6 3 -1 255 abc", b"P5 2 2 0 abcd", b"P5 2 2 70000 abcdabcd", b"P2 1", b"P5", b"BM", b"BM" + b"\xff" * 60, b"", b"P6 100000 100000 255 x"])
def test_broken_headers_give_nulls(spark, raw):
    got = media.media_features(spark.createDataFrame([(1, bytearray(raw))], "doc_id long, media binary")).first()
    assert got["payload_bytes"] is None and got["media_bytes"] == len(raw)


def test_toxicity_passes_clashing_columns_through(spark):
    rows = [(i, "you awful rotten fool" if i % 2 else "a quiet walk by the sea", *["x"] * 10) for i in range(60)]
    names = ["_features", "_level", "_vector", "_raw", "_margin", "_class", "_probability", "row", "features", "a.b"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.fit(docs, labels, F.lit(True)))
    assert scored.columns == [*docs.columns, "score"] and scored.count() == 60
    means = dict(scored.groupBy(F.pmod("doc_id", F.lit(2))).agg(F.avg("score")).collect())
    assert means[1] > 0.8 > 0.2 > means[0] and scored.where("`a.b` = 'x' AND _level = 'x'").count() == 60


def test_tallies_drop_no_true_pair():
    rng = np.random.RandomState(5)
    draw = lambda n: rng.randint(-2**63, 2**63 - 1, n, dtype=np.int64)
    pairs = []
    for n in (0, 1, 3, 9, 40, 300, 2000):
        base = np.unique(draw(n))
        for cut in (0, n // 20, n // 9, n // 5, n // 2, n):
            pairs.append((base, np.unique(np.concatenate([base[cut:], draw(cut)]))))
    pairs.append((draw(100_000), draw(5)))  # no tally: more than 255 in a range
    assert simhash.shingle_tally(pairs[-1][0]) is None
    columns = [pa.array([simhash.shingle_tally(p[i]) for p in pairs], pa.binary()) for i in (0, 1)]
    numbers = pa.array(range(len(pairs)), pa.int64())
    batch = pa.RecordBatch.from_arrays([numbers, numbers, *columns], names=["a", "b", "x", "y"])
    kept = {v for out in simhash.may_reach(0.8)(iter([batch])) for v in out.column("a").to_pylist()}
    near = {i for i, (x, y) in enumerate(pairs) if len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y))}
    assert near <= kept and len(pairs) - 1 in kept
    far = {i for i, (x, y) in enumerate(pairs) if len(np.intersect1d(x, y)) == 0 and 0 < len(x) <= 300}
    assert far and not far & kept


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_packing_goes_by_the_rules_of_its_vocabulary(name):
    from tokenizers import Tokenizer

    own, texts = Tokenizer.from_file(tokenizer_path(name)), ["Hello it's  World 12 don't\n x", "", "\u00c9 \u00e0 la <|endoftext|> z", "\u4e2d\u6587 abc"]
    got = [np.frombuffer(raw, "<u4").tolist() for raw in packing.WordIds(tokenizer_path(name))(texts)]
    assert got == [own.encode(text, add_special_tokens=False).ids for text in texts]


def test_anchors_of_one_repeated_byte_in_bounded_memory():
    data = np.full(8 << 20, 32, np.uint8)
    tracemalloc.start()
    found = sum(len(part[0]) for part in suffix.anchors(data, np.array([0, len(data)])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == len(data) - 32 + 1 and peak < 500 << 20


def test_anchors_are_the_same_in_slices_of_any_size():
    rng = np.random.RandomState(3)
    parts = [rng.randint(97, 99 + 20 * (i % 2), 700 * i).astype(np.uint8) for i in range(8)] + [np.full(3000, 32, np.uint8)]
    data, offsets = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    whole, sliced = ([np.concatenate(c) for c in zip(*suffix.anchors(data, offsets, places=n), strict=True)] for n in (1 << 20, 97))
    assert all(np.array_equal(a, b) for a, b in zip(whole, sliced, strict=True))
