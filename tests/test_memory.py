"""Memory of one task in steps that multiply rows or keep tables."""

import numpy as np

from quietwave.llm import langid
from quietwave.operators import spectra as X


def test_spectra_are_made_in_slices(spark):
    seen = spark.sparkContext.accumulator(0)

    def transform(block):
        seen.add(1)
        return {"frame": np.ones((len(block), 2, 3), np.int64), "power": np.ones((len(block), 2, 3))}

    df = spark.range(1000).selectExpr("id", "array(1.0D, 2.0D) AS x").coalesce(1)
    assert X._map_traces(df, ["id"], "x", transform, "frame bigint, power double").count() == 6000
    assert seen.value >= 4


def test_table_of_language_grams_is_small():
    fold = langid.folded_bytes()
    codes = langid.gram_codes(np.frombuffer("Ab, ÿz".encode(), np.uint8), fold)
    assert len(np.unique(codes)) == len(codes) and (np.diff(codes.astype(int)) > 0).all()
    lookup = langid.Model(["a"], codes, np.zeros((len(codes), 0)), np.zeros((0, 0))).lookup()
    assert lookup.nbytes < 10_000_000 and lookup[codes].tolist() == list(range(len(codes)))
