"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text are rates: weighted lexicon hits (words and word beginnings), hits near a word
of the second person, hits that only appear once disguised signs are read as letters, capitals,
punctuation, digits, disguised words, length. The lexicon is learned too: log-odds of words between toxic
and clean training texts, with a prior, kept above a z-score.

Training takes at most `sample` labelled rows, lowest hashes of doc_id first; a third of them is held
back from lexicon and trees and calibrates the scores. The bound does not depend on the table; every
text is scored whole.

Defined results: null and empty texts have all rates zero and are scored like any other; a label table
with repeated ids counts an id as toxic if any of its rows does, null labels count as none; without
both classes the score is the rate of toxic labels (0 without labels); an empty table gives no rows;
other columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietwave.llm.common import Work

WORD = re.compile(r"[^\s.,;:?|()\"\[\]{}<>]+")
DISGUISE = str.maketrans("013457@$!+", "oleastasit")
HIDDEN = re.compile(r"[0134578@$!+*]")
# Words of the second person in the languages of the tables.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deiner deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
PREFIX, NEAR = 5, 4
NAMES = ("hits", "weight", "strongest", "heavy", "distinct", "prefix_hits", "prefix_weight", "near_second", "second", "hidden_hits",
         "disguised", "capitals", "shouted", "punctuation", "marks", "digits", "log_words", "hit_share_max", "any_hit", "any_prefix")


def plain(word: str) -> str:
    """Lower case, disguising signs read as letters, marks between letters dropped."""
    word = word.lower()
    if HIDDEN.search(word) or "-" in word or "_" in word or "'" in word:
        word = word.translate(DISGUISE).replace("*", "").replace("-", "").replace("_", "")
    return word.strip("'!-_")


def terms(text: str) -> set[str]:
    """Words (w:) and word beginnings (p:) of a text."""
    words = {plain(w) for w in set(WORD.findall(text))}
    return {f"w:{w}" for w in words if w} | {f"p:{w[:PREFIX]}" for w in words if len(w) > PREFIX}


def features(text: str, lexicon: dict[str, float], known: dict[str, tuple[float, float, bool]]) -> list[float]:
    """Rates of one text in the order of NAMES; `known` remembers looked-up words."""
    words = WORD.findall(text)
    n = max(1, len(words))
    hits, second, hidden, disguised, shouted = [], [], 0, 0, 0
    prefix_hits, prefix_weight, weight, strongest, heavy = 0, 0.0, 0.0, 0.0, 0
    distinct = set()
    for at, raw in enumerate(words):
        found = known.get(raw)
        if found is None:
            word = plain(raw)
            found = (lexicon.get(f"w:{word}", 0.0), lexicon.get(f"p:{word[:PREFIX]}", 0.0) if len(word) > PREFIX else 0.0,
                     word in SECOND, word != raw.lower() and any(c.isalpha() for c in raw) and bool(HIDDEN.search(raw)), len(raw) > 2 and raw.isupper(), word)
            if len(known) < 200_000:
                known[raw] = found
        w, p, is_second, is_hidden, is_shouted, word = found
        if w > 0:
            hits.append(at)
            distinct.add(word)
            weight += w
            strongest = max(strongest, w)
            heavy += w > 3
            hidden += is_hidden
        if p > 0:
            prefix_hits += 1
            prefix_weight += p
        if is_second:
            second.append(at)
        disguised += is_hidden
        shouted += is_shouted
    near = 0
    if hits and second:
        places = np.array(second)
        right = np.searchsorted(places, hits)
        gap = np.minimum(np.abs(places[np.minimum(right, len(places) - 1)] - hits), np.abs(places[np.maximum(right - 1, 0)] - hits))
        near = int((gap <= NEAR).sum())
    size = max(1, len(text))
    capitals = len(CAPITALS.findall(text)) if text.isascii() else sum(map(str.isupper, text))  # the same number, ASCII is faster so
    return [len(hits) / n, weight / n, strongest, heavy / n, float(len(distinct)), prefix_hits / n, prefix_weight / n, near / n, len(second) / n, hidden / n,
            disguised / n, capitals / size, shouted / n, len(PUNCTUATION.findall(text)) / size, len(MARKS.findall(text)) / n, len(DIGITS.findall(text)) / size,
            float(np.log1p(len(words))), len(hits) / max(1, len(distinct)), float(bool(hits)), float(prefix_hits > 0)]


CAPITALS, PUNCTUATION, MARKS, DIGITS = re.compile(r"[A-Z]"), re.compile(r"[^\w\s]"), re.compile(r"[!?]"), re.compile(r"\d")


def with_features(df: DataFrame, text: str, lexicon: dict[str, float], name: str = "_features") -> DataFrame:
    """Adds the array of features."""
    schema = T.StructType(df.schema.fields + [T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            rows = [features(x or "", lexicon, known) for x in batch.column(text).to_pylist()]
            flat = pa.array([v for row in rows for v in row], pa.float64())
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(NAMES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, flat)], names=schema.names)

    return df.mapInArrow(run, schema)


def learn_lexicon(train: DataFrame, z: float = 3.0, most: int = 2000) -> dict[str, float]:
    """Terms with log-odds of texts (toxic against clean, prior 0.5) at least `z` standard errors above 0; the `most` surest."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tallies = {0: Counter(), 1: Counter()}
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                tallies[toxic].update(terms(text or ""))
            found = sorted(tallies[0].keys() | tallies[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *(pa.array([tallies[k][t] for t in found], pa.int64()) for k in (1, 0))], names=["term", "toxic", "clean"])

    texts = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(a / (texts[1] - F.col("toxic") + 0.5)) - F.log(b / (texts[0] - F.col("clean") + 0.5))
    error = F.sqrt(1 / a + 1 / b)
    counts = train.select("text", "toxic").mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    best = counts.where(F.col("toxic") >= 2).select("term", odds.alias("odds"), (odds / error).alias("z")).where(F.col("z") >= z)
    return {r["term"]: float(r["odds"]) for r in best.orderBy(F.desc("z"), "term").limit(most).collect()}


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column, key: str, text: str, toxic: str, sample: int) -> DataFrame:
    """(id, toxic, text, part) of at most `sample` ids; part 2 of 0..2 calibrates."""
    known = labels.where(F.col(toxic).isNotNull() & F.col(key).isNotNull() & learn).groupBy(key).agg(F.max(F.col(toxic).cast("int")).alias("toxic"))
    drawn = known.orderBy(F.xxhash64(F.lit(3), key), key).limit(sample)
    # at most `sample` rows of two numbers: a proven bound for the broadcast
    joined = docs.select(key, text).join(F.broadcast(drawn), key)
    one = joined.groupBy(key).agg(F.max("toxic").alias("toxic"), F.min(text).alias("text"))
    return one.select(F.col(key).alias("id"), F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic"), "text", F.pmod(F.xxhash64(F.lit(5), key), F.lit(3)).cast("int").alias("part"))


class Model:
    """Lexicon, boosted trees and calibration; or a constant rate."""

    def __init__(self, rate: float, lexicon: dict[str, float] | None = None, trees=None, curve=None):
        self.rate, self.lexicon, self.trees, self.curve = rate, lexicon, trees, curve


def fit(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", toxic: str = "toxic",
        sample: int = 20_000, rounds: int = 20, depth: int = 3) -> Model:
    work = Work(docs.sparkSession, "toxicity")
    train = work.save(training_rows(docs, labels, learn, key, text, toxic, sample), "train")
    total = Counter()
    for r in train.groupBy("toxic", (F.col("part") == 2).alias("held")).agg(F.count("*").alias("n")).collect():
        total[r["toxic"], r["held"]] = r["n"]
    n = sum(total.values())
    rate = (total[1, False] + total[1, True]) / n if n else 0.0
    if not (total[0, False] and total[1, False]):
        work.drop("train")
        return Model(rate)
    lexicon = learn_lexicon(train.where("part < 2"))
    dense = work.save(with_features(train, "text", lexicon).select("id", "part", F.col("toxic").cast("double").alias("label"), "_features").coalesce(4), "dense")
    dense = dense.withColumn("vector", array_to_vector("_features"))
    trees = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=rounds, maxDepth=depth, maxBins=64, stepSize=0.3, minInstancesPerNode=5, seed=7,
                          cacheNodeIds=False).fit(dense.where("part < 2"))
    curve = None
    if total[0, True] and total[1, True]:
        held = trees.transform(dense.where("part = 2")).select("label", vector_to_array("probability")[1].alias("raw"))
        curve = IsotonicRegression(featuresCol="raw", labelCol="label").fit(held)
    work.drop("train", "dense")
    return Model(rate, lexicon, trees, curve)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """Adds the calibrated score. A hundredth of it is the trees' own share, which orders texts on a step of the calibration."""
    docs = docs.drop(name)
    if model.trees is None:
        return docs.withColumn(name, F.lit(float(model.rate)))
    # the row goes along as one column, so that no name of it meets a working column
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    dense = with_features(held, "text", model.lexicon).withColumn("_vector", array_to_vector("_features"))
    trees = model.trees.setFeaturesCol("_vector").setProbabilityCol("_probability").setRawPredictionCol("_margin").setPredictionCol("_class")
    raw = trees.transform(dense).select("row", vector_to_array("_probability")[1].alias("_raw"))
    if model.curve is None:
        return raw.select("row.*", F.col("_raw").alias(name))
    curve = model.curve.setFeaturesCol("_raw").setPredictionCol("_level")
    return curve.transform(raw).select("row.*", (0.99 * F.col("_level") + 0.01 * F.col("_raw")).alias(name))
