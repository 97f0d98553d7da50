"""Language-model scores by deleted interpolation of unigrams and bigrams.

The probability of a token is l(b) x c(v w) / c(v) + (1 - l(b)) x (c(w) + 0.5) / (N + 0.5 (V + 1)), where b is
the bucket of the context's frequency (powers of two) and the weights l are learned by
expectation-maximisation on held-out counts: a part of the training texts is kept out of the counts
that the weights are fitted with. The final counts are those of all training texts.

Texts are read in chunks of bounded size. A chunk asks for the counts of its distinct words and word
pairs; the requests, with the chunk's own counts, meet by hash range, where they are added up, and the
sums go back to the chunk. So nothing is shuffled per token, a frequent word costs one entry per chunk,
and no table of counts is held whole anywhere.

Words and pairs are known by 64-bit hashes, chunks by a hash of their tokens. The chunks are formed three
times from the same input, which must therefore give its rows in the same order each time, as files do;
an answer carries a checksum of its request, so a differing input is an error and never a wrong score.

Defined results: a null text is empty, and an empty text is the end token alone; repeated rows count
and are scored each; without training texts every count is zero; a null id is kept; an empty table
gives no rows; other columns are left out.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietwave.llm.common import Work, text_bytes

CHUNK, RANGE = 8 << 20, 16 << 20
BINS, ZERO = 16, -(1 << 20)
END, START = 0, 1
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class Ids(dict):
    """Numbers words in order of appearance, behind the end and start signs."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 2
        return number


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One 64-bit hash per pair of hashes."""
    mixed = left * ODD[0] + (right ^ (right >> np.uint64(31))) * ODD[1]
    mixed ^= mixed >> np.uint64(29)
    mixed *= ODD[1]
    return mixed ^ (mixed >> np.uint64(32))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and each key's place among them."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(keys) else np.empty(0, bool)
    place = np.empty(len(keys), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return ranked[new], place


class Chunk:
    """Tokens of some texts: a start sign, the words and an end sign for each, as numbers of distinct words."""

    def __init__(self, ids: np.ndarray, hashes: np.ndarray, lengths: np.ndarray, roles: np.ndarray):
        self.ids, self.hashes, self.lengths, self.roles = ids, hashes, lengths, roles
        self.words, place = distinct(hashes)
        self.at_word = place[ids]
        keys = hashes[ids]
        pairs = pair_keys(np.concatenate([keys[:1], keys[:-1]]), keys)
        pairs[ids == START] = hashes[START]  # no pair
        self.pairs, self.at_pair = distinct(pairs)
        self.role = np.repeat(roles, lengths)

    @staticmethod
    def read(texts: list[bytes], roles: list[int]) -> Chunk:
        index, parts, lengths = Ids(), [], []
        for raw in texts:
            own = raw.lower().split()
            parts.append(np.fromiter(map(index.__getitem__, own), dtype=np.int32, count=len(own)))
            lengths.append(len(own) + 2)
        ids = np.concatenate([x for own in parts for x in ((START,), own, (END,))]).astype(np.int32) if parts else np.empty(0, np.int32)
        # no word is empty or a space, so the signs have hashes of their own
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in (b"", b" ", *index)), dtype=np.uint64, count=len(index) + 2)
        return Chunk(ids, hashes, np.array(lengths, dtype=np.int64), np.array(roles, dtype=np.int8))

    def number(self) -> int:
        """A signed hash of the tokens and roles: the chunk's name, the same whenever it is formed again."""
        own = xxhash.xxh64(self.ids.tobytes(), seed=len(self.lengths))
        for part in (self.hashes, self.lengths, self.roles):
            own.update(part.tobytes())
        return own.intdigest() - (1 << 63)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        return self.words, self.pairs

    def counts(self, role: int) -> tuple[np.ndarray, np.ndarray]:
        own = self.role == role
        return np.bincount(self.at_word[own], minlength=len(self.words)), np.bincount(self.at_pair[own], minlength=len(self.pairs))


KEPT, HELD, SCORED = 0, 1, 2


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK) -> Iterator[tuple[int, pa.Array, Chunk]]:
    """(chunk number, ids, chunk) of columns (id, role, text)."""
    ids, roles, texts, held = [], [], [], 0

    def done() -> tuple[int, pa.Array, Chunk]:
        chunk = Chunk.read(texts, roles)
        return chunk.number(), pa.concat_arrays(ids), chunk

    for batch in batches:
        data, offsets = text_bytes(batch.column(2))
        role, start = batch.column(1).to_pylist(), 0
        for row in range(batch.num_rows):
            texts.append(data[offsets[row]:offsets[row + 1]].tobytes())
            roles.append(role[row])
            held += len(texts[-1])
            if held >= size:
                ids.append(batch.column(0).slice(start, row + 1 - start))
                yield done()
                start, held = row + 1, 0
                ids, roles, texts = [], [], []
        if start < batch.num_rows:
            ids.append(batch.column(0).slice(start))
    if texts:
        yield done()


def packed(values: np.ndarray) -> bytes:
    """Non-negative numbers in the fewest bytes that hold the largest, behind that size."""
    most = int(values.max()) if len(values) else 0
    size = next(s for s in (1, 2, 4, 8) if most < 1 << (8 * s) or s == 8)
    return bytes((size,)) + values.astype(f"<u{size}").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<u{raw[0]}", offset=1).astype(np.int64)


REQUEST = "kind int, range long, chunk long, keys binary, kept binary, held binary"
ANSWER = "kind int, range long, chunk long, size long, crc long, kept binary, held binary, distinct_kept long, distinct_all long, sum_kept long, sum_all long"


def requests(rows: DataFrame, ranges: int) -> DataFrame:
    """Distinct keys of each chunk with its training counts, cut by hash range."""
    cuts = np.array([(i << 64) // ranges for i in range(ranges)], dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, chunk in chunks(batches):
            for kind, (keys, kept, held) in enumerate(zip(chunk.keys(), chunk.counts(KEPT), chunk.counts(HELD), strict=True)):
                edges = np.append(np.searchsorted(keys, cuts), len(keys))
                out = [(kind, i, number, keys[a:b].tobytes(), packed(kept[a:b]), packed(held[a:b])) for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if b > a]
                types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types],
                                                 names=["kind", "range", "chunk", "keys", "kept", "held"])

    return rows.mapInArrow(run, REQUEST)


def runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Groups of consecutive rows with equal values in `columns`."""
    held, key = [], None
    for batch in batches:
        for row in range(batch.num_rows):
            now = tuple(batch.column(c)[row].as_py() for c in columns)
            if held and now != key:
                yield key, held
                held = []
            key = now
            held.append({c: batch.column(c)[row] for c in batch.schema.names})
    if held:
        yield key, held


def answers(asked: DataFrame, partitions: int) -> DataFrame:
    """Sums of the training counts for each request, and one row of totals per range (chunk null)."""
    dealt = asked.repartition(partitions, "kind", "range").sortWithinPartitions("kind", "range", "chunk")
    start = xxhash.xxh64_intdigest(b" ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 4]
        names = ["kind", "range", "chunk", "size", "crc", "kept", "held", "distinct_kept", "distinct_all", "sum_kept", "sum_all"]
        for (kind, span), rows in runs(batches, ["kind", "range"]):
            keys = [np.frombuffer(r["keys"].as_buffer(), dtype=np.uint64) for r in rows]
            found, place = distinct(np.concatenate(keys))
            sums = [np.bincount(place, np.concatenate([unpacked(r[c].as_py()) for r in rows]), len(found)).astype(np.int64) for c in ("kept", "held")]
            at, out = 0, []
            for row, own in zip(rows, keys, strict=True):
                here = place[at:at + len(own)]
                at += len(own)
                out.append((kind, span, row["chunk"].as_py(), len(own), zlib.crc32(own), packed(sums[0][here]), packed(sums[1][here]), None, None, None, None))
            token = found != np.uint64(start)  # the start sign is no token
            every = sums[0] + sums[1]
            out.append((kind, span, None, None, None, None, None, int((token & (sums[0] > 0)).sum()), int((token & (every > 0)).sum()), int(sums[0][token].sum()), int(every[token].sum())))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return dealt.mapInArrow(run, ANSWER)


def by_range(found: list[dict]) -> list[list[dict]]:
    """A chunk's answers of each kind in the order of its keys; chunks with equal tokens have equal answers."""
    return [[r for _, r in sorted({r["range"]: r for r in found if r["kind"] == kind}.items())] for kind in (0, 1)]


def checked(chunk: Chunk, found: list[dict]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(kept, held) counts of a chunk's words and of its pairs from its answers."""
    out = []
    for own, keys in zip(by_range(found), chunk.keys(), strict=True):
        at = 0
        for r in own:
            if zlib.crc32(keys[at:at + r["size"]]) != r["crc"]:
                raise ValueError("the input gave other rows than before; write it to a table first")
            at += r["size"]
        if at != len(keys):
            raise ValueError("the input gave other rows than before; write it to a table first")
        out.append(tuple(np.concatenate([unpacked(r[c]) for r in own]) if own else np.empty(0, np.int64) for c in ("kept", "held")))
    return out


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else 1 + the power of two below."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))).astype(np.int64) + 1, 0)


def estimates(word: np.ndarray, pair: np.ndarray, context: np.ndarray, tokens: int, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed unigram and plain bigram estimates."""
    return (word + 0.5) / (tokens + 0.5 * (vocabulary + 1)), np.where(context > 0, pair / np.maximum(context, 1), 0.0)


def learn_weights(table: list[tuple[int, int, int]], rounds: int = 60) -> np.ndarray:
    """EM for the bigram's weight in each bucket from (bucket, ratio bin, held-out count)."""
    weights = np.zeros(64)
    for own in {b for b, _, _ in table if b}:
        bins, n = np.array([(x, c) for b, x, c in table if b == own], dtype=float).T
        ratio = np.where(bins == ZERO, 0.0, np.exp2(bins / BINS))
        weight = 0.5
        for _ in range(rounds):
            share = weight * ratio
            weight = float((n * share / (share + 1 - weight)).sum() / n.sum())
            weight = min(max(weight, 1e-6), 1 - 1e-6)
        weights[own] = weight
    seen = np.flatnonzero(weights)
    for b in range(1, 64):
        # a bucket without held-out tokens takes the weight of the nearest one that has some
        if not weights[b] and len(seen):
            weights[b] = weights[seen[np.argmin(np.abs(seen - b))]]
    return weights


def score(docs: DataFrame, learn: Column, held: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every text, learning from rows where `learn` holds.

    `held` picks the training rows that are kept out while the weights are fitted.
    """
    work = Work(docs.sparkSession, "lm")
    id_type = docs.schema[key].dataType
    rows = docs.select(F.col(key).alias("doc_id"), F.when(~learn, SCORED).when(held, HELD).otherwise(KEPT).cast("int").alias("role"), F.col(text))
    size = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    ranges = max(4, -(-size // RANGE))
    partitions = max(4, 2 * ranges)
    found = work.save(answers(requests(rows, ranges), partitions), "answers")
    totals = found.where("chunk IS NULL AND kind = 0").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("distinct_kept", "distinct_all", "sum_kept", "sum_all")]).first()
    replies = found.where("chunk IS NOT NULL").select("kind", "range", "chunk", "size", "crc", "kept", "held")
    per_chunk = max(4, -(-size // CHUNK))

    # the weights: held-out tokens look up their own places among the answers
    def held_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, chunk in chunks(batches):
            at = np.flatnonzero((chunk.role == HELD) & (chunk.ids != START))
            if len(at):
                places = np.stack([chunk.at_word[at], chunk.at_pair[at], chunk.at_word[at - 1]]).astype("<u4")
                yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([number], pa.int64()), pa.array([places.tobytes()], pa.binary())], names=["kind", "chunk", "places"])

    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in runs(batches, ["chunk"]):
            # equal chunks of several partitions have one number; each of them counts
            places = Counter(r["places"].as_py() for r in group if r["kind"].as_py() == 2)
            if not places:
                continue
            replies = by_range([{c: r[c].as_py() for c in ("kind", "range", "kept")} for r in group if r["kind"].as_py() != 2])
            kept = [np.concatenate([unpacked(r["kept"]) for r in own]) for own in replies]
            for raw, copies in places.items():
                word, pair, context = np.frombuffer(raw, dtype="<u4").reshape(3, -1)
                low, high = estimates(kept[0][word], kept[1][pair], kept[0][context], totals["sum_kept"], totals["distinct_kept"])
                bins = np.where(high > 0, np.rint(BINS * np.log2(np.maximum(high, 1e-300) / low)), ZERO).astype(np.int64)
                both, times = np.unique(np.stack([bucket(kept[0][context]), bins]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.array(times * copies)], names=["bucket", "bin", "n"])

    places = rows.mapInArrow(held_places, "kind int, chunk long, places binary")
    asked = replies.select("kind", "range", "chunk", "kept", F.lit(None).cast("binary").alias("places")).unionByName(
        places.select("kind", F.lit(None).cast("long").alias("range"), "chunk", F.lit(None).cast("binary").alias("kept"), "places"))
    table = asked.repartition(per_chunk, "chunk").sortWithinPartitions("chunk").mapInArrow(ratios, "bucket long, bin long, n long")
    # at most 64 buckets x the bins of the range of a float: a bounded table
    weights = learn_weights([tuple(r) for r in table.groupBy("bucket", "bin").agg(F.sum("n").alias("n")).collect()])

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, own, chunk in chunks(batches):
            one = lambda raw: pa.array([raw.tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), one(chunk.ids), one(chunk.hashes), one(chunk.lengths), one(chunk.roles)],
                names=["chunk", "doc_ids", "ids", "hashes", "lengths", "roles"])

    kind = id_type.simpleString()
    carried = rows.mapInArrow(sequences, f"chunk long, doc_ids array<{kind}>, ids binary, hashes binary, lengths binary, roles binary")
    extra = ["doc_ids", "ids", "hashes", "lengths", "roles"]
    both = carried.select(F.lit(2).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in (("range", "long"), ("size", "long"), ("crc", "long"), ("kept", "binary"), ("held", "binary"))], "chunk", *extra).unionByName(
        replies.select("*", *[F.lit(None).cast(carried.schema[c].dataType).alias(c) for c in extra]))
    tokens, vocabulary = totals["sum_all"], totals["distinct_all"]

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in runs(batches, ["chunk"]):
            got = [{c: r[c].as_py() for c in ("kind", "range", "size", "crc", "kept", "held")} for r in group if r["kind"].as_py() != 2]
            counts = None
            for texts in (r for r in group if r["kind"].as_py() == 2):
                read = lambda c, t, row=texts: np.frombuffer(row[c].as_buffer(), dtype=t)
                chunk = Chunk(read("ids", np.int32), read("hashes", np.uint64), read("lengths", np.int64), read("roles", np.int8))
                counts = counts or [a + b for a, b in checked(chunk, got)]
                word, pair = counts
                at = np.flatnonzero(chunk.ids != START)
                own, context = word[chunk.at_word[at]], word[chunk.at_word[at - 1]]
                low, high = estimates(own, pair[chunk.at_pair[at]], context, tokens, vocabulary)
                share = weights[bucket(context)]
                starts = np.concatenate([[0], np.cumsum(chunk.lengths - 1)[:-1]])
                total = lambda x, starts=starts: np.add.reduceat(x, starts)
                yield pa.RecordBatch.from_arrays(
                    [texts["doc_ids"].values, pa.array(chunk.lengths - 1), pa.array(total((own > 0).astype(np.int64))), pa.array(np.full(len(starts), tokens, dtype=np.int64)),
                     pa.array(total(np.log10(low))), pa.array(total(np.log10(share * high + (1 - share) * low)))],
                    names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return both.repartition(per_chunk, "chunk").sortWithinPartitions("chunk").mapInArrow(
        scores, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
