"""Language identification by string kernels.

The kernel of two texts is the share of byte n-grams (lengths 1 to 3 blended, presence only) that they
have in common: shared / sqrt(own x own). Its Nyström form over landmark texts carries one-versus-rest
kernel ridge regression; texts are scored in batches by two matrix products.

The classifier is fitted on a sample of at most `sample` labelled rows, rarer languages first, with the
first `landmarks` of them as landmarks and at most `vocabulary` of the landmarks' most common n-grams.
These bounds do not depend on the table; every text is scored whole.

Defined results: a null text, or one without a letter, is `und` with score 0; so is every text when no
label can be learned; equal texts get equal results; an empty table gives no rows; null labels are not
learned; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietwave.llm.common import text_bytes

UND = "und"
GRAMS = (1, 2, 3)
FEW_LABELS = 10_000


def folded_bytes() -> np.ndarray:
    """Byte to sign: 1 for a space, letters in lower case, bytes of longer signs as they are, all else a space; numbered without gaps."""
    table = np.full(256, 32, dtype=np.uint32)
    for code in range(256):
        if code >= 128 or chr(code).isalpha():
            table[code] = code if code >= 128 else ord(chr(code).lower())
    return (np.unique(table, return_inverse=True)[1] + 1).astype(np.uint32)


SIGNS = int(folded_bytes().max()) + 1


def gram_codes(raw: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Distinct n-grams of a text, each as a number that also tells its length, ascending."""
    signs = np.concatenate([[np.uint32(1)], fold[raw], [np.uint32(1)]]).astype(np.uint32)
    out, code = [], signs
    for n in GRAMS:
        if n > 1:
            code = code[:-1] * np.uint32(SIGNS) + signs[n - 1:]
        found = np.sort(code)
        out.append(found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found)
    return np.concatenate(out)  # signs are at least 1, so lengths do not collide


def has_letter(raw: np.ndarray, ascii_letters: np.ndarray) -> bool:
    return bool(ascii_letters[raw].any()) or (bool((raw >= 128).any()) and any(c.isalpha() for c in raw.tobytes().decode("utf-8", "ignore")))


def letters_table() -> np.ndarray:
    return np.array([chr(i).isalpha() and i < 128 for i in range(256)])


def with_letters(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text has a letter; needs no model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letters_table()
        for batch in batches:
            data, offsets = text_bytes(batch.column(text))
            held = [has_letter(data[a:b], letters) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield batch.filter(pa.array(held, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


class Model:
    """Landmark n-grams, kernel weights and labels; small, and built on the driver from the sample."""

    def __init__(self, labels: list[str], codes: np.ndarray, landmarks: np.ndarray, weights: np.ndarray):
        self.labels, self.codes, self.landmarks, self.weights = labels, codes, landmarks, weights

    def lookup(self) -> np.ndarray:
        kind = np.int16 if len(self.codes) < 1 << 15 else np.int32
        table = np.full(SIGNS ** max(GRAMS), -1, dtype=kind)  # some 8 MB in each task
        table[self.codes] = np.arange(len(self.codes), dtype=kind)
        return table

    def decide(self, present: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Decision values (rows x labels) from presence rows and counts of distinct n-grams."""
        kernel = (present @ self.landmarks) / np.sqrt(np.maximum(own, 1))[:, None]
        return kernel @ self.weights


def presence(codes: list[np.ndarray], lookup: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    rows = np.zeros((len(codes), width), dtype=np.float32)
    for row, own in enumerate(codes):
        at = lookup[own]
        rows[row, at[at >= 0]] = 1
    return rows, np.array([len(c) for c in codes], dtype=float)


def sample_rows(docs: DataFrame, text: str, label: str, learn: Column, sample: int) -> DataFrame:
    """At most `sample` labelled texts: smallest (hash as a share of 1) x (rows of its label).

    The expected number of texts below a threshold is known from the counts, so about twice the sample
    is left to be sorted, whatever the table's size; equal texts count once.
    """
    rows = docs.where(learn & F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).cast("string").alias("label"), F.col(text).alias("text"))
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"))
    total = sizes.agg(F.count("*").alias("labels")).first()["labels"]
    share = F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rank = F.col("share") * F.col("n")
    # one row for each label: its number is checked before it is broadcast
    sizes = F.broadcast(sizes) if total <= FEW_LABELS else sizes
    near = rows.select("label", share.alias("share"), "text").join(sizes, "label").where(rank <= 2.0 * sample / max(1, total))
    once = near.groupBy("label", "share").agg(F.min("n").alias("n"), F.min("text").alias("text"))
    return once.orderBy(rank, "label", "share").limit(sample).select("label", "text")


def fit(docs: DataFrame, learn: Column, text: str = "text", label: str = "lang", sample: int = 1200, landmarks: int = 160,
        vocabulary: int = 16_384, ridge: float = 1e-2) -> Model | None:
    """Kernel ridge regression from the rows where `learn` holds; None if there is no such row."""
    fold = folded_bytes()

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            found = [gram_codes(data[a:b], fold).tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["label", "codes"])

    rows = sample_rows(docs, text, label, learn, sample).mapInArrow(codes, "label string, codes binary").collect()
    if not rows:
        return None
    labels = sorted({r["label"] for r in rows})
    grams = [np.frombuffer(r["codes"], dtype=np.uint32) for r in rows]
    marks = grams[:landmarks]
    common, times = np.unique(np.concatenate(marks), return_counts=True)
    kept = np.sort(common[np.argsort(-times, kind="stable")[:vocabulary]])
    model = Model(labels, kept, np.zeros((len(kept), 0)), np.zeros((0, 0)))
    lookup = model.lookup()
    mark_rows, mark_own = presence(marks, lookup, len(kept))
    model.landmarks = (mark_rows / np.sqrt(np.maximum(mark_own, 1))[:, None]).T.astype(np.float32)
    every, own = presence(grams, lookup, len(kept))
    kernel = (every @ model.landmarks) / np.sqrt(np.maximum(own, 1))[:, None]
    values, vectors = np.linalg.eigh((kernel[:len(marks)] + kernel[:len(marks)].T) / 2)
    good = values > values.max() * 1e-6
    root = vectors[:, good] / np.sqrt(values[good])
    features = kernel @ root
    of = np.array([labels.index(r["label"]) for r in rows])
    target = np.where(of[:, None] == np.arange(len(labels)), 1.0, -1.0 / max(1, len(labels) - 1))
    weight = (len(rows) / (len(labels) * np.bincount(of, minlength=len(labels))))[of][:, None]
    solved = np.linalg.solve(features.T @ (features * weight) + ridge * np.eye(features.shape[1]), features.T @ (target * weight))
    model.weights = (root @ solved).astype(np.float32)
    return model


def predict(docs: DataFrame, model: Model | None, text: str = "text", label: str = "lang_pred", score: str = "score", sharpness: float = 4.0) -> DataFrame:
    """Adds the predicted label and its share (0 to 1) of the decision values by softmax."""
    docs = docs.drop(label, score)
    schema = T.StructType(docs.schema.fields + [T.StructField(label, T.StringType()), T.StructField(score, T.DoubleType())])
    if model is None:
        return docs.withColumns({label: F.lit(UND), score: F.lit(0.0)}).select(*schema.names)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by landmarks x vocabulary
    fold = folded_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_model = shared.value
        lookup, letters = own_model.lookup(), letters_table()
        for batch in batches:
            data, offsets = text_bytes(batch.column(text))
            names, scores = [UND] * batch.num_rows, np.zeros(batch.num_rows)
            spans = list(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
            rows = [i for i, (a, b) in enumerate(spans) if has_letter(data[a:b], letters)]
            for at in range(0, len(rows), 256):
                part = rows[at:at + 256]
                values = own_model.decide(*presence([gram_codes(data[spans[i][0]:spans[i][1]], fold) for i in part], lookup, len(own_model.codes)))
                shares = np.exp(sharpness * (values - values.max(axis=1, keepdims=True)))
                shares /= shares.sum(axis=1, keepdims=True)
                for i, best, share in zip(part, values.argmax(axis=1), shares, strict=True):
                    names[i], scores[i] = own_model.labels[best], float(share[best])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names), pa.array(scores)], names=schema.names)

    return docs.mapInArrow(run, schema)
