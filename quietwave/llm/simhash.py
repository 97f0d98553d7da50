"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Each text gets a 64-bit fingerprint from its word shingles. Equal fingerprints form one class. Two
fingerprints within `distance` bits share at least 8 - distance of their 8 bytes, position by position. Their
postings are lists of fingerprints that agree in a set of positions, chosen so that any two with
that many shared bytes meet in a list. Inside a list the shared positional bytes of each pair are
tallied; pairs that reach the guaranteed minimum are kept and verified on all bits. Lists are worked
off in blocks of fixed size with a forest of links as output, so no task holds or emits all pairs of
a list; lists of any length are split into pairs of blocks.

`near_copies` finds every two texts of a shingle similarity of 0.8 or more. Such pairs differ in more bits
than bytes of 64 bits can guarantee to share, so a first pass posts byte sets of a wider fingerprint,
filters on 128 bits and verifies the links on the shingle sets themselves; a second pass finds the pairs
that are left without loss, by shared shingles (`prefix_pairs`). Candidates of both passes are first held
to a bound by tallies of their shingles' hash ranges (`may_reach`), so whole sets meet only where it may count. `keep_first` goes by it.

Defined results: null and empty texts have fingerprint zero and are linked like any other; repeated rows
are in one class; a null id stays in its class but names none (a component of null ids only is null);
an empty table gives no rows; other columns pass through `fingerprints`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietwave.llm.common import Work, components, each_text

SEED, BLOCK = 42, 4096
SETS = 20


def fingerprint(raw: bytes, size: int, seed: int = SEED) -> int:
    """SimHash over shingles of `size` words, as an unsigned number."""
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    last = max(0, len(words) - size)
    bounds = zip(starts[:last + 1].tolist(), ends[min(size, len(words)) - 1:].tolist(), strict=True)
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in bounds), dtype=np.uint64, count=last + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at:at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", size: int = 4, name: str = "fp") -> DataFrame:
    """Adds the fingerprint as a signed 64-bit column."""
    docs = docs.drop(name)
    schema = T.StructType(docs.schema.fields + [T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([fingerprint(raw, size) for raw in each_text(batch.column(text))], dtype=np.uint64)
            yield batch.append_column(name, pa.array(own.view(np.int64)))

    return docs.mapInArrow(run, schema)


def position_sets(shared: int, keyed: int = 3) -> list[tuple[int, ...]]:
    """Sets of `keyed` byte positions of which any `shared` positions contain one.

    For 3 of 4 (distance 4) the three-part cyclic design of Turán needs 20 sets instead of all 56.
    """
    keyed = min(keyed, shared)
    if (shared, keyed) != (4, 3):
        return list(combinations(range(8), keyed))
    part = (0, 0, 0, 1, 1, 1, 2, 2)
    sets = []
    for s in combinations(range(8), 3):
        held = sorted(part[i] for i in s)
        twice = {held[1]} if len(set(held)) == 2 else set()
        if len(set(held)) == 1 or any((held.count(t) == 2 and held.count((t + 1) % 3) == 1) for t in twice):
            sets.append(s)
    return sets


def postings(classes: DataFrame, sets: list[tuple[int, ...]], fp: str = "fp") -> DataFrame:
    """(list, fp): the bytes at each set of positions; the list's number holds the set and its bytes."""
    keys = []
    for number, positions in enumerate(sets):
        mask = sum(0xFF << (8 * p) for p in positions)
        mask -= (1 << 64) if mask >= 1 << 63 else 0
        keys.append(F.xxhash64(F.lit(number), F.col(fp).bitwiseAND(F.lit(mask).cast("long"))))
    return classes.select(F.explode(F.array(*keys)).alias("list"), F.col(fp).alias("fp"))


def tally(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Which pairs of two blocks (rows a x columns b) share 8 - distance bytes and differ in at most `distance` bits."""
    differ = a[:, None] ^ b[None, :]
    shared = (differ.view(np.uint8).reshape(len(a), len(b), 8) == 0).sum(axis=2)
    return (shared >= 8 - distance) & (np.bitwise_count(differ) <= distance)


def forest(values: np.ndarray, split: int, distance: int) -> list[tuple[int, int]]:
    """Links that join what the verified pairs of a list join; with a split, pairs across it only."""
    parent = np.arange(len(values))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    step = 512
    rows, columns = (range(0, len(values), step), lambda i: range(i, len(values), step)) if split < 0 else (range(0, split, step), lambda i: range(split, len(values), step))
    for i in rows:
        top = min(i + step, len(values) if split < 0 else split)
        for j in columns(i):
            found = tally(values[i:top], values[j:j + step], distance)
            for x, y in zip(*np.nonzero(found), strict=True):
                p, q = root(i + int(x)), root(j + int(y))
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    out.append((int(values[i + x]), int(values[j + y])))
    return out


def whole_runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], keyed: int = 3) -> Iterator[np.ndarray]:
    """Rows of sorted long columns in tables that never cut a run of equal values in the first `keyed` columns."""
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names], axis=1)
        last = np.flatnonzero(np.any(now[:, :keyed] != now[-1, :keyed], axis=1))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut or (held and np.any(held[-1][-1, :keyed] != now[0, :keyed])):
            yield np.concatenate([*held, now[:cut]])
            held = []
        held.append(now[cut:])
    if held:
        yield np.concatenate(held)


def near_links(classes: DataFrame, distance: int = 4, keyed: int = 3, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints whose components are those of all pairs within `distance` bits."""
    posted = postings(classes, position_sets(8 - distance, keyed))
    sizes = posted.groupBy("list").agg(F.count("*").alias("n")).where("n > 1")
    # a list of more than a block is worked off as all pairs of its blocks
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64(F.lit(9), "fp"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    parts = posted.join(sizes.select("list", blocks.alias("blocks")), "list").select("list", "fp", own.alias("own"), other.alias("other"))
    parts = parts.select("list", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp")
    dealt = parts.repartition("list", "i", "j").sortWithinPartitions("list", "i", "j", "own", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(table: np.ndarray) -> list[tuple[int, int]]:
            """Links of the runs of equal (list, i, j)."""
            edges = np.flatnonzero(np.any(table[1:, :3] != table[:-1, :3], axis=1)) + 1
            found = []
            for a, b in zip(np.concatenate([[0], edges]).tolist(), np.concatenate([edges, [len(table)]]).tolist(), strict=True):
                if b - a < 2:
                    continue
                i, j = table[a, 1:3]
                split = -1 if i == j else int((table[a:b, 3] == i).sum())
                values = table[a:b, 4].view(np.uint64) if table.flags.f_contiguous else np.ascontiguousarray(table[a:b, 4]).view(np.uint64)
                if b - a == 2 and split < 0:
                    if int(values[0] ^ values[1]).bit_count() <= distance:
                        found.append((int(values[0]), int(values[1])))
                else:
                    found += forest(values, split, distance)
            return found

        def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
            pairs = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], names=["a", "b"])

        for table in whole_runs(batches, ("list", "i", "j", "own", "fp")):
            yield batch_of(work(table))

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, distance: int = 4) -> DataFrame:
    """(key, fp, component_id): the class of every row, its smallest key.

    Fingerprints are written once. Classes of equal fingerprints are aggregated before anything is
    paired; the join back is by fingerprint, whose hot values Spark splits.
    """
    work = Work(docs.sparkSession, "simhash")
    marked = work.save(fingerprints(docs.select(key, text), text, size).select(key, "fp"), "marked")
    classes = work.save(marked.groupBy("fp").agg(F.min(key).alias("first")), "classes")
    links = work.save(near_links(classes, distance).distinct(), "links")
    joined = components(links, work)
    # each component takes the smallest id of its classes
    member = classes.join(joined, classes["fp"] == joined["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = member.groupBy("component").agg(F.min("first").alias("component_id"))
    named = work.save(member.join(least, "component").select("fp", "component_id"), "named")
    work.drop("classes", "links")
    return marked.join(named, "fp").select(key, "fp", "component_id")


def hex_digits(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def mixed(hashes: np.ndarray, words: int) -> np.ndarray:
    """`words` independent 64-bit numbers for each hash (the splitmix64 finaliser over a counter)."""
    x = hashes[:, None] + np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(raw: bytes, size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle in order; fewer words than `size` are one shingle, no words none."""
    words = raw.lower().split()
    count = max(1, len(words) - size + 1) if words else 0
    return np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i:i + size]), seed) for i in range(count)), dtype=np.uint64, count=count)


def wide_signature(hashes: np.ndarray, sets: int = SETS) -> tuple[np.ndarray, np.ndarray]:
    """(two words to compare, list numbers) of a SimHash of 128 + 24 x `sets` bits.

    A list is a set of three byte positions with its bytes. The two bits of a set whose sums are nearest to
    a tie turn first under an edit, so the text is posted under all four values of these two.
    """
    words = 2 + -(-sets * 24 // 64)
    ones = np.zeros(64 * words, dtype=np.int64)
    for at in range(0, len(hashes), 255):
        rows = mixed(hashes[at:at + 255], words)
        ones += np.unpackbits(rows.view(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    margin = 2 * ones - len(hashes)
    compared = np.packbits(margin[:128] > 0, bitorder="little").view(np.int64)
    margin = margin[128:128 + 24 * sets].reshape(sets, 24)
    value = (margin > 0) @ (np.int64(1) << np.arange(24, dtype=np.int64)) + (np.arange(sets, dtype=np.int64) << 24)
    weak = np.int64(1) << np.argsort(np.abs(margin), axis=1, kind="stable")[:, :2]
    lists = np.stack([value, value ^ weak[:, 0], value ^ weak[:, 1], value ^ weak[:, 0] ^ weak[:, 1]], axis=1)
    return compared, lists.ravel().astype(np.int32)


def nearest_tree(words: np.ndarray, split: int, limit: int) -> list[tuple[int, int]]:
    """Prim's least spanning forest over pairs within `limit` bits; with a split, over pairs across it.

    Whatever closer bound is put on the links later, what is connected under it stays connected in the forest.
    """
    side = np.arange(len(words)) < split
    best, origin, out = np.full(len(words), 999, dtype=np.int64), np.zeros(len(words), dtype=np.int64), []
    done, at = np.zeros(len(words), dtype=bool), 0
    for _ in range(len(words)):
        done[at] = True
        if best[at] <= limit:
            out.append((int(origin[at]), at))
        differ = np.bitwise_count(words ^ words[at]).sum(axis=1, dtype=np.int64)
        closer = (differ < best) & ~done
        if split >= 0:
            closer &= side != side[at]
        best[closer], origin[closer] = differ[closer], at
        at = int(np.argmin(np.where(done, 1000, best)))
    return out


def long_lists(posted: DataFrame, member: list[str], work: Work | None, name: str, block: int = BLOCK, share: int = 16) -> DataFrame:
    """(list, blocks) of lists that hold about more than `block` members, told from one in `share` members.

    This only decides into how many blocks a list is dealt; every list is compared in full whatever it says. So
    the lists themselves are exchanged once, not a second time to count them. The table is written, and
    Spark joins it by its known size.
    """
    some = posted.where(F.pmod(F.xxhash64(F.lit(13), *member), F.lit(share)) == 0)
    counted = some.groupBy("list").agg((F.count("*") * share).alias("n")).where(F.col("n") > block)
    work = work or Work(posted.sparkSession, "lists")
    return work.save(counted.select("list", F.ceil(F.col("n") / block).cast("int").alias("blocks")), name)


def similar_links(classes: DataFrame, limit: int, block: int = BLOCK, small: int = 8, work: Work | None = None) -> DataFrame:
    """(a0, a1, b0, b1): links between signatures (s0, s1) that meet in one of their `lists` and differ in at most `limit` bits.

    Lists of up to `small` signatures give all their pairs; longer ones the least spanning forest of each
    pair of blocks.
    """
    posted = classes.select(F.explode("lists").alias("list"), "s0", "s1")
    hot = long_lists(posted, ["s0", "s1"], work, "long", block)
    count = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64(F.lit(9), "s0", "s1"), count).cast("int")
    parts = posted.join(hot, "list", "left").select("list", "s0", "s1", own.alias("own"), F.explode(F.sequence(F.lit(0), count - 1)).alias("other"))
    parts = parts.select("list", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "s0", "s1")
    dealt = parts.repartition("list", "i", "j").sortWithinPartitions("list", "i", "j", "own", "s0", "s1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ("list", "i", "j", "own", "s0", "s1")):
            words = np.ascontiguousarray(table[:, 4:6]).view(np.uint64)
            starts = np.concatenate([[0], np.flatnonzero(np.any(table[1:, :3] != table[:-1, :3], axis=1)) + 1])
            lengths = np.diff(np.concatenate([starts, [len(table)]]))
            short = (lengths <= small) & (table[starts, 1] == table[starts, 2])
            number, fit = np.repeat(np.arange(len(starts)), lengths), np.repeat(short, lengths)
            left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for step in range(1, small):
                at = np.flatnonzero(fit[step:] & (number[step:] == number[:-step]))
                at = at[np.bitwise_count(words[at] ^ words[at + step]).sum(axis=1, dtype=np.int64) <= limit]
                left.append(at)
                right.append(at + step)
            for start, length in zip(starts[~short].tolist(), lengths[~short].tolist(), strict=True):
                i, j = table[start, 1:3]
                split = -1 if i == j else int((table[start:start + length, 3] == i).sum())
                found = np.array(nearest_tree(words[start:start + length], split, limit), dtype=np.int64).reshape(-1, 2) + start
                left.append(found[:, 0])
                right.append(found[:, 1])
            a, b = np.concatenate(left), np.concatenate(right)
            columns = [table[a, 4], table[a, 5], table[b, 4], table[b, 5]]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["a0", "a1", "b0", "b1"])

    return dealt.mapInArrow(run, "a0 long, a1 long, b0 long, b1 long")


def common_shingles(rows: DataFrame, size: int, sample: int = 4000, most: int = 200_000) -> np.ndarray:
    """(shingles, counts) of those that stand in two or more of about `sample` texts, the most common `most`, by shingle.

    They only order the shingles of a text; whatever they are, no pair is lost by it.
    """
    total = rows.count()
    some = rows.where(F.pmod(F.xxhash64(F.lit(11), "own"), F.lit(1 << 30)) <= (1 << 30) * min(1.0, sample / max(1, total)))

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in each_text(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(raw, size)).view(np.int64))], names=["gram"])

    grams = some.select("own", "text").dropDuplicates(["own"]).select("text").mapInArrow(shingles, "gram long")
    found = grams.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "gram").limit(most).collect()
    table = np.array([tuple(r) for r in found], dtype=np.int64).reshape(-1, 2)
    return table[np.argsort(table[:, 0])].T


def shingle_prefix(hashes: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a text's distinct ones, rarest first, so many that texts of the similarity share one of them.

    Such texts share at least ceil(similarity x n) of the n shingles of each, so the first shared one in any
    order that holds for all texts comes no later than at place n - ceil(similarity x n).
    """
    grams = hashes.view(np.int64)
    at = np.minimum(np.searchsorted(common[0], grams), max(0, common.shape[1] - 1))
    times = np.where(common[0][at] == grams, common[1][at], 0) if common.shape[1] else np.zeros(len(grams), np.int64)
    return grams[np.lexsort((grams, times))][:len(grams) - int(np.ceil(similarity * len(grams) - 1e-6)) + 1]


def prefix_pairs(classes: DataFrame, similarity: float, block: int = BLOCK, work: Work | None = None) -> DataFrame:
    """(a, b): every two nodes of different `part` that share a shingle of their prefixes and may reach the similarity.

    Takes (node, part, n, prefix). Beyond a pair's first shared shingle at places i and j there are at most
    min(n - i, m - j) shared ones, which with the sizes bounds the similarity; the bound drops no true pair.
    """
    posted = classes.select("node", "part", "n", F.posexplode("prefix").alias("at", "list"))
    hot = long_lists(posted, ["node"], work, "long-prefix", block)
    count = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64(F.lit(9), "node"), count).cast("int")
    parts = posted.join(hot, "list", "left").select("list", "node", "part", "n", "at", own.alias("own"), F.explode(F.sequence(F.lit(0), count - 1)).alias("other"))
    parts = parts.select("list", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "part", "n", "at")
    dealt = parts.repartition("list", "i", "j").sortWithinPartitions("list", "i", "j", "own", "node")
    share = similarity / (1 + similarity)

    def possible(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which of the pairs of rows (.., node, part, n, at) may reach the similarity."""
        rest = np.minimum(x[..., 6] - x[..., 7], y[..., 6] - y[..., 7])
        return (x[..., 5] != y[..., 5]) & (rest >= share * (x[..., 6] + y[..., 6]) - 1e-6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for table in whole_runs(batches, ("list", "i", "j", "own", "node", "part", "n", "at")):
            starts = np.concatenate([[0], np.flatnonzero(np.any(table[1:, :3] != table[:-1, :3], axis=1)) + 1])
            lengths = np.diff(np.concatenate([starts, [len(table)]]))
            for start, length in zip(starts[lengths > 1].tolist(), lengths[lengths > 1].tolist(), strict=True):
                held = table[start:start + length]
                i, j = held[0, 1:3]
                split = 0 if i == j else int((held[:, 3] == i).sum())
                step = max(1, (1 << 18) // length)
                for top in range(0, split or length, step):
                    x = held[top:min(top + step, split or length)]
                    good = possible(x[:, None], held[None, split:])
                    if not split:
                        good &= np.arange(len(held))[None] > np.arange(top, top + len(x))[:, None]
                    p, q = np.nonzero(good)
                    if len(p):
                        yield batch_of(x[p, 4], held[split + q, 4])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def shingle_tally(grams: np.ndarray, bins: int = 256) -> bytes | None:
    """Number of shingles in each of `bins` ranges of their hashes, a byte each; None if one does not fit."""
    counts = np.bincount((grams.view(np.uint64) >> np.uint64(65 - bins.bit_length())).astype(np.int64), minlength=bins) if len(grams) else np.zeros(bins, np.int64)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def may_reach(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keeps pairs (a, b, x, y) whose tallies x and y allow the similarity.

    Two texts share at most the sum of the lesser counts of each range, so the bound drops no true pair;
    a pair with a text without a tally is kept.
    """
    share = similarity / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            x, y = batch.column("x"), batch.column("y")
            both = np.flatnonzero(pc.and_(pc.is_valid(x), pc.is_valid(y)).to_numpy(zero_copy_only=False))
            if len(both):
                p, q = (np.stack([np.frombuffer(v, np.uint8) for v in c.take(pa.array(both)).to_pylist()]) for c in (x, y))
                shared = np.minimum(p, q).sum(axis=1, dtype=np.int64)
                keep[both] = shared >= share * (p.sum(axis=1, dtype=np.int64) + q.sum(axis=1, dtype=np.int64)) - 1e-6
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def mark_bits(wanted: DataFrame, each: int = 16, most: int = 1 << 26) -> np.ndarray:
    """A bit table of the hashes `mark`: `each` bits or more for one of them, `most` (8 MiB) in all.

    It rules rows out where they are read, so that a few wanted texts need no exchange of all. What it lets through
    is joined exactly; a full table lets more through and loses none.
    """
    bits = min(most, 1 << max(10, (each * wanted.count()).bit_length()))
    at = F.col("mark").bitwiseAND(F.lit(bits - 1).cast("long")).alias("at")
    words = wanted.select(at).groupBy(F.expr("cast(at div 64 as int)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("held")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("held").to_numpy().view(np.uint64)
    return out


def marked_rows(table: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Which of the hashes may be among those of a bit table."""
    at = marks.view(np.uint64) & np.uint64(64 * len(table) - 1)
    return (table[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def set_node(hashes: np.ndarray) -> int:
    """The number of a set of shingles, given in order."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).astype(np.int64))


def near_groups(docs: DataFrame, key: str, text: str, size: int, similarity: float, sets: int, work: Work) -> tuple[DataFrame, DataFrame]:
    """Rows (key, own, node), with `own` the hash of the text, and (node, chosen): the least (null, key, own) of each node's component.

    A row is known by its key and its text, nulls included. Texts of equal shingle sets are one node.
    """
    cosine = 2 * similarity / (1 + similarity)
    share = float(np.arccos(cosine) / np.pi)
    limit = int(128 * share + 2.5 * np.sqrt(128 * share * (1 - share)))  # 2.5 deviations beyond the expected bits
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("own"))
    kind = rows.schema["key"].dataType
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(rows, size))  # bounded by its `most`
    columns = {"node": pa.int64(), "s0": pa.int64(), "s1": pa.int64(), "n": pa.int64(), "lists": pa.list_(pa.int32()), "prefix": pa.list_(pa.int64())}

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in columns}
            for raw in each_text(batch.column("text")):
                h = np.unique(shingle_hashes(raw, size))
                (s0, s1), lists = wide_signature(h, sets) if len(h) else ((0, 0), [])
                for c, value in zip(columns, (set_node(h), int(s0), int(s1), len(h), lists, shingle_prefix(h, shared.value, similarity) if len(h) else []), strict=True):
                    out[c].append(value)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("own"), *(pa.array(out[c], t) for c, t in columns.items())], names=["key", "own", *columns])

    longs = [T.StructField(c, T.LongType()) for c in ("own", "node", "s0", "s1", "n")]
    schema = T.StructType([T.StructField("key", kind), *longs, T.StructField("lists", T.ArrayType(T.IntegerType())), T.StructField("prefix", T.ArrayType(T.LongType()))])
    posted = work.save(rows.select("key", "own", "text").mapInArrow(sign, schema), "posted")
    named_row = F.struct(F.col("key").isNull().alias("unnamed"), "key", "own")
    classes = work.save(posted.groupBy("node").agg(F.min(named_row).alias("first"), F.first(F.struct("s0", "s1", "n", "lists", "prefix")).alias("_"))
                        .select("node", "first", "_.*"), "classes")
    # the arrays are with the classes from here on
    marked = work.save(posted.select("key", "own", "node"), "marked")
    work.drop("posted")

    spark = docs.sparkSession

    def each_set(links: DataFrame, classes: DataFrame, form: Callable[[np.ndarray], object], kind: tuple[str, pa.DataType, str], name: str) -> DataFrame:
        """(node, form of its shingles) of the ends of links, and of a few other texts; made where the texts are read."""
        ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
        wanted = work.save(classes.join(ends, "node").select(F.xxhash64("first.key", "first.own").alias("mark")), name)
        table = spark.sparkContext.broadcast(mark_bits(wanted))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(pa.array(marked_rows(table.value, batch.column("mark").to_numpy())))
                for at in range(0, batch.num_rows, 200):
                    held = [np.unique(shingle_hashes(raw, size)) for raw in each_text(batch.column("text").slice(at, 200))]
                    yield pa.RecordBatch.from_arrays([pa.array([set_node(h) for h in held], pa.int64()), pa.array([form(h.view(np.int64)) for h in held], kind[1])], names=["node", kind[0]])

        # repeated rows of one key and text give a node several times
        return rows.select(F.xxhash64("key", "own").alias("mark"), "text").mapInArrow(run, f"node long, {kind[0]} {kind[2]}").dropDuplicates(["node"])

    def verified(links: DataFrame, classes: DataFrame, name: str) -> DataFrame:
        """The links whose ends reach the similarity on their shingle sets; their tallies come first."""
        tallies = work.save(each_set(links, classes, shingle_tally, ("tally", pa.binary(), "binary"), f"{name}-ends"), f"{name}-tallies")
        tally = lambda end, x: tallies.select(F.col("node").alias(end), F.col("tally").alias(x))
        likely = links.join(tally("a", "x"), "a").join(tally("b", "y"), "b").select("a", "b", "x", "y")
        likely = work.save(likely.mapInArrow(may_reach(similarity), "a long, b long"), f"{name}-likely")
        grams = work.save(each_set(likely, classes, lambda x: x, ("grams", pa.list_(pa.int64()), "array<long>"), f"{name}-likely-ends"), f"{name}-grams")
        pairs = likely.join(grams.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a").join(grams.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
        both = F.size(F.array_intersect("x", "y"))
        near = work.save(pairs.where(both >= F.lit(similarity) * (F.size("x") + F.size("y") - both)).select("a", "b"), name)
        work.drop(*(f"{name}-{part}" for part in ("ends", "tallies", "likely", "likely-ends", "grams")))
        work.release()
        return near

    # first pass: by signature, each one by its least node; nodes of one signature hang on to that
    signed = work.save(classes.where("n > 0").groupBy("s0", "s1").agg(F.min("node").alias("least"), F.first("lists").alias("lists")), "signed")
    met = similar_links(signed, limit, work=work)
    at = lambda end: signed.select(F.col("s0").alias(f"{end}0"), F.col("s1").alias(f"{end}1"), F.col("least").alias(end))
    met = met.distinct().join(at("a"), ["a0", "a1"]).join(at("b"), ["b0", "b1"]).select("a", "b")
    alike = classes.where("n > 0").select("node", "s0", "s1").join(signed.select("s0", "s1", "least"), ["s0", "s1"]).where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    both_ways = met.unionByName(alike).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    near = verified(work.save(both_ways, "candidates"), classes, "links")
    part = components(near, work)
    work.drop("signed", "candidates")
    # second pass: all pairs that are left between the groups so far
    placed = work.save(classes.where("n > 0").join(part, "node", "left").select("node", F.coalesce("component", "node").alias("part"), "n", "prefix"), "placed")
    firsts = work.save(classes.select("node", "first"), "firsts")
    work.drop("classes")
    work.release()
    rest = work.save(prefix_pairs(placed, similarity, work=work), "rest")
    work.drop("placed")
    work.release()
    rest = verified(rest, firsts, "more")
    joined = components(near.unionByName(rest), work.within("joined"))
    member = firsts.join(joined, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    named = member.select("node", "component").join(member.groupBy("component").agg(F.min("first").alias("chosen")), "component")
    named = work.save(named.select("node", "chosen"), "named")
    work.drop("firsts", "links", "rest", "more", "long", "long-prefix")
    return marked, named


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.8, sets: int = SETS) -> DataFrame:
    """(key, component_id) of every row with a key: texts linked at a Jaccard similarity of word shingles of `similarity` or more.

    First a wide SimHash finds most pairs: sets of three byte positions hold the lists, 128 bits are the
    filter, and each link is verified on the shingle sets of both texts. Long lists give a forest of
    candidates, which can fail where the pair that it stands for would not. So a second pass takes all
    pairs between the groups so far that share one of their rarest shingles (`prefix_pairs`), which any two
    texts of the similarity do, and verifies them. The groups are those of all pairs, whatever the length.
    Null and empty texts are one class, linked to no other. Rows without a key are grouped too, but name no
    group unless no row of it has a key.
    """
    marked, named = near_groups(docs, key, text, size, similarity, sets, Work(docs.sparkSession, "near-copies"))
    return marked.where(F.col("key").isNotNull()).join(named, "node").select(F.col("key").alias(key), F.col("chosen.key").alias("component_id"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.8, sets: int = SETS) -> DataFrame:
    """One row of each group of near-duplicates, the one with the smallest key and text hash, with all its columns.

    A row is known by key and text: rows of one key with different texts are different documents. Rows
    without a key come after all others and are grouped like them. Repeated rows of one key and text leave
    one row: those that occur twice are found on hashes alone, and only they are put through a distinct.
    """
    work = Work(docs.sparkSession, "near-copies")
    marked, named = near_groups(docs, key, text, size, similarity, sets, work)
    chosen = named.select(F.col("chosen.key").alias("k"), F.col("chosen.own").alias("o")).distinct()
    sizes = marked.groupBy("key", "own").agg(F.count("*").alias("n"))
    judged = sizes.join(chosen, chosen["k"].eqNullSafe(sizes["key"]) & (chosen["o"] == sizes["own"]), "left")
    judged = judged.select(F.col("key").alias("__k"), F.col("own").alias("__o"), F.col("o").isNull().alias("__gone"), "n")
    # only keys that go or repeat are written and joined; other rows stay where they are
    judged = work.save(judged.where("__gone or n > 1").drop("n"), "judged")
    work.drop("marked", "named")
    work.release()
    table = docs.sparkSession.sparkContext.broadcast(mark_bits(judged.select(F.col("__o").alias("mark"))))

    @F.arrow_udf("boolean")
    def judged_row(marks: pa.Array) -> pa.Array:
        return pa.array(marked_rows(table.value, marks.to_numpy()))

    rows = docs.withColumn("__own", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    rows = rows.withColumn("__judged", judged_row("__own"))
    other = rows.where("not __judged").select(*docs.columns)
    rows = rows.where("__judged")
    rows = rows.join(judged, rows[key].eqNullSafe(judged["__k"]) & (rows["__own"] == judged["__o"]), "left")
    single = rows.where("__gone is null").select(*docs.columns)
    first = rows.where("not __gone").select(*docs.columns, "__own").dropDuplicates([key, "__own"]).drop("__own")
    return other.unionByName(single).unionByName(first)
