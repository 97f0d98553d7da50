"""Document fingerprints of closed syncmers, in built-in functions only.

A k-mer of code points is an anchor if its least inner s-mer (by XXH64) stands at its first or last
place. That depends on the k-mer alone, so an edit changes only the anchors that overlap it, and two
texts with a common passage have the same anchors in it. A fingerprint keeps the `SIZE` anchors of
least hash, each with its first place in the text, packed into a long: 36 bits of hash, 27 of place
(places from 2^27 - 1 on count as that). Likeness estimates the share of common anchors from the least
hashes of both; a common anchor counts if it is displaced like the others, within an eighth of the
longer text of the median displacement.

Texts below `SHORT` code points take shorter k-mers; a text without an anchor is one anchor as a whole.
Texts are cut into overlapping slices, so the arrays of places stay small at any length.

The anchors of an edited text (own beginning, end of another) are those of the own beginning, which lie
before the cut and are known, and those of the new end, so a text is read once and a quarter.

`with_next` finds the following row by cuts of the order at sampled keys: one exchange of the texts, in
chunks of about 16 MB (at most 16 384 of them, which is 6 GB each at 100 TB), four to a task, and the first
row of a chunk sent to the one before as well.

Defined results: null texts are empty; an empty text has no anchor, likeness 1 to another empty text and
0 to any other. Rows follow each other by key, nulls first, then by hash of the text; equal rows in any
order, which changes no result. A single row follows itself. An empty table gives no rows. Other columns
are not looked at.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietwave.llm.common import Work

LONG_MERS, SHORT_MERS, SHORT = (12, 5), (5, 2), 48
SIZE, PLACE_BITS, HASH_BITS = 64, 27, 36
SLICE, BLOCK = 1 << 14, 1 << 20
CHUNK_BYTES, MOST_CHUNKS, EQUAL_ROWS = 16 << 20, 1 << 14, 100_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _hash(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, PLACE_BITS)


def _place(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << PLACE_BITS) - 1).cast("long"))


def _pack(value: Column, place: Column) -> Column:
    top = F.shiftleft(value.bitwiseAND(F.lit((1 << HASH_BITS) - 1).cast("long")), PLACE_BITS)
    return top.bitwiseOR(F.least(place.cast("long"), F.lit((1 << PLACE_BITS) - 1).cast("long")))


def _window_least(values: Column, width: int) -> Column:
    """Least of each `width` neighbours, by doubling; places behind the last full window hold less."""
    def joined(step: int) -> Callable[[Column], Column]:
        return lambda v: F.zip_with(v, F.slice(v, step + 1, F.size(v)), lambda a, b: F.least(a, b))

    have = 1
    while have < width:
        step = min(have, width - have)
        values, have = let(values, joined(step)), have + step
    return values


def anchors(text: Column, mers: tuple[int, int], start: Column | int = 0) -> Column:
    """Packed closed syncmers of a text, in order of place; `start` is the place of its first code point."""
    k, s = mers
    width, start = k - s + 1, F.lit(start) if isinstance(start, int) else start
    pieces = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{s}}}))."), F.lit(1))  # the last dot steps over both halves of a code point
    covering = [*range(0, k - s, s), k - s]  # inner places whose s-mers make up the k-mer

    def chosen(h: Column) -> Column:
        full = F.slice(_window_least(h, width), 1, F.greatest(F.size(h) - (width - 1), F.lit(0)))
        edges = F.transform(full, lambda m, i: F.when((F.get(h, i + (width - 1)) == m) | (F.get(h, i) == m), i))
        return F.transform(F.filter(edges, lambda i: i.isNotNull()), lambda i: _pack(F.xxhash64(*[F.get(h, i + c) for c in covering]), start + i))

    return let(F.transform(pieces, lambda p: F.xxhash64(p)), chosen)


def _sketch(ordered: Column, size: int) -> Column:
    """The first `size` of sorted anchors, of equal hashes the first place."""
    return let(ordered, lambda a: F.slice(F.filter(a, lambda x, i: (i == 0) | (_hash(x) != _hash(F.get(a, i - 1)))), 1, size))


def _slices(text: Column, n: Column, overlap: int) -> Column:
    """Slices of SLICE code points and an overlap, in order; in two levels, as a substring counts from the start."""
    def cut(t: Column, length: Column, step: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0)), F.lit(step))
        return F.transform(starts, lambda i: F.substring(t, i + 1, F.lit(step + overlap)))

    blocks = F.transform(cut(text, n, BLOCK), lambda b: cut(b, F.least(F.length(b), F.lit(BLOCK)), SLICE))
    return F.when(n <= SLICE, F.array(text)).when(n <= BLOCK, cut(text, n, SLICE)).otherwise(F.flatten(blocks))


def _long_sketches(text: Column, n: Column, size: int, start: Column | int = 0, kept: Column | None = None) -> Column:
    """Sketch of a text at the long scale (`a`) and of its anchors at places up to `kept` (`b`)."""
    start = F.lit(start) if isinstance(start, int) else start

    def of_slice(t: Column, i: Column) -> Column:
        return let(F.sort_array(anchors(t, LONG_MERS, start + i * SLICE)), lambda a: F.struct(
            _sketch(a, size).alias("a"), (F.array().cast("array<bigint>") if kept is None else _sketch(F.filter(a, lambda x: _place(x) <= kept), size)).alias("b")))

    def all_of(parts: Column) -> Column:
        return F.struct(_sketch(F.sort_array(F.flatten(parts["a"])), size).alias("a"), _sketch(F.sort_array(F.flatten(parts["b"])), size).alias("b"))

    return let(F.transform(_slices(text, n, LONG_MERS[0] - 1), of_slice), all_of)


def _short_sketch(text: Column, size: int) -> Column:
    whole = F.array(_pack(F.xxhash64(text), F.lit(0)))
    return let(_sketch(F.sort_array(anchors(text, SHORT_MERS)), size), lambda a: F.when(F.length(text) == 0, F.array().cast("array<bigint>")).when(F.size(a) == 0, whole).otherwise(a))


def sketch(text: Column, size: int = SIZE) -> Column:
    """Anchors of least hash of a text without nulls, as sorted packed longs."""
    n = F.length(text)
    return F.when(n < SHORT, _short_sketch(text, size)).otherwise(_long_sketches(text, n, size)["a"])


def likeness(a: Column, n_a: Column, b: Column, n_b: Column, size: int = SIZE) -> Column:
    """Estimated share of common anchors (0 to 1) of two sketches of texts of n_a and n_b code points."""
    def of_hashes(h: Column) -> Column:
        least = F.slice(F.sort_array(F.array_union(h["a"], h["b"])), 1, size)
        return let(F.struct(least.alias("least"), F.array_intersect(F.array_intersect(h["a"], h["b"]), least).alias("common")), of_common)

    def of_common(c: Column) -> Column:
        def places(x: Column) -> Column:
            return F.transform(F.filter(x, lambda v: F.array_contains(c["common"], _hash(v))), _place)

        # both in order of hash, so the places stand side by side
        moves = F.sort_array(F.zip_with(places(a), places(b), lambda p, q: q - p))
        return F.when(F.size(c["least"]) == 0, 1.0).otherwise(let(moves, alike) / F.size(c["least"]))

    def alike(moves: Column) -> Column:
        count = F.size(moves)
        middle = (F.get(moves, F.floor((count - 1) / 2).cast("int")) + F.get(moves, F.floor(count / 2).cast("int"))) / 2
        return let(middle, lambda m: F.size(F.filter(moves, lambda d: F.abs(d - m) * 8 <= F.greatest(n_a, n_b)))).cast("double")

    return let(F.struct(F.transform(a, _hash).alias("a"), F.transform(b, _hash).alias("b")), of_hashes)


def as_text(packed: Column, n: Column) -> Column:
    """A fingerprint as text: code points of the document in 8 hex digits, then 16 per anchor."""
    digits = F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0"))
    return F.lower(F.concat(F.lpad(F.hex(n.cast("long")), 8, "0"), F.array_join(digits, "")))


def from_text(fingerprint: Column) -> tuple[Column, Column]:
    """(anchors, code points) of a fingerprint made by `as_text`."""
    count = F.floor((F.length(fingerprint) - 8) / 16).cast("int")
    numbers = F.transform(F.sequence(F.lit(1), count), lambda i: F.conv(F.substring(fingerprint, i * 16 - 7, F.lit(16)), 16, 10).cast("long"))
    return F.when(count > 0, numbers).otherwise(F.array().cast("array<bigint>")), F.conv(F.substring(fingerprint, 1, 8), 16, 10).cast("long")


def fingerprint_likeness(a: Column, b: Column) -> Column:
    """Likeness of two stored fingerprints."""
    return likeness(*from_text(a), *from_text(b))


def with_next(df: DataFrame, key: str, text: str, carry: list[str], out: str = "_next", chunk_bytes: int = CHUNK_BYTES, equal_rows: int = EQUAL_ROWS) -> DataFrame:
    """Every row with a struct of the columns `carry` of the row that follows by key; the first follows the last."""
    work = Work(df.sparkSession, "next")
    order = ["_live", "_order", "_hash", "_row"]
    filler = F.lit(0).cast(df.schema[key].dataType)
    rows = df.withColumns({"_live": F.col(key).isNotNull(), "_order": F.coalesce(key, filler), "_hash": F.xxhash64(text), "_row": F.lit(0).cast("long")})
    most = rows.groupBy("_live", "_order", "_hash").agg(F.count("*").alias("n"), F.sum(F.octet_length(text)).alias("b")).agg(
        F.max("n").alias("most"), F.sum("n").alias("n"), F.sum("b").alias("b")).first()
    if not most["n"]:
        return rows.select(*df.columns, F.struct(*carry).alias(out))
    if most["most"] > equal_rows:
        # many equal rows: a row number, fixed by writing it, lets a cut fall between them
        rows = work.save(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    chunks = min(MOST_CHUNKS, -(-most["b"] // chunk_bytes))
    sample = rows.select(*order).sample(min(1.0, chunks * 16 / most["n"]), 17).collect() if chunks > 1 else []
    sample = sorted(tuple(r) for r in sample)
    cuts = sorted({sample[len(sample) * c // chunks] for c in range(1, chunks)}) if sample else []
    first = tuple(rows.agg(F.min(F.struct(*order)).alias("f")).first()["f"])
    shape = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in rows.select(*order).schema.fields)

    def constant(values: list[dict], kind: str) -> Column:
        """A table of the driver as a constant of the plan: Spark sees how small it is."""
        return F.from_json(F.lit(json.dumps(values, default=str)), f"array<{kind}>")

    def named(row: tuple) -> dict:
        return dict(zip(order, row, strict=True))

    listed, halves = constant([named(c) for c in cuts], f"struct<{shape}>"), [1 << b for b in reversed(range(len(cuts).bit_length()))]
    own = F.struct(*order)
    chunk = F.aggregate(F.array(*[F.lit(h) for h in halves]), F.lit(0), lambda at, half: at + F.when(F.get(listed, at + half - 1) <= own, half).otherwise(0)) if cuts else F.lit(0)
    # a cut is the key of a row that exists: the first row of its chunk, which the chunk before needs too
    heads: dict[tuple, list[int]] = {first: [len(cuts)]}
    for i, cut in enumerate(cuts):
        heads.setdefault(cut, []).append(i)
    to_rows = constant([{**named(head), "_to": to} for head, to in heads.items()], f"struct<{shape}, _to: array<int>>")
    placed = rows.withColumn("_chunk", chunk).join(df.sparkSession.range(1).select(F.inline(to_rows)), order, "left")
    every = F.concat(F.array(F.struct(F.col("_chunk"), F.lit(0).alias("_ahead"))), F.transform(F.coalesce("_to", F.array().cast("array<int>")), lambda c: F.struct(c.alias("_chunk"), F.lit(1).alias("_ahead"))))
    sent = placed.select(*df.columns, *order, F.inline(every)).repartition(max(1, chunks // 4), "_chunk")
    after = Window.partitionBy("_chunk").orderBy("_ahead", *order)
    return sent.withColumn(out, F.lead(F.struct(*carry)).over(after)).where("_ahead = 0").select(*df.columns, out)


def fingerprint_documents(df: DataFrame, key: str = "doc_id", text: str = "text", share: int = 4, size: int = SIZE, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Fingerprints of every text and of its edited text, and the likeness to the edited and to the next text.

    The edited text has its last floor(n / share) code points replaced by the first as many of the next text.
    """
    k = LONG_MERS[0]
    cut = F.col("_n") - F.floor(F.col("_n") / share).cast("int")
    texts = df.select(F.col(key), F.coalesce(text, F.lit("")).alias("_text")).withColumn("_n", F.length("_text"))
    # both scales of the edited text are the long one if even an empty next text leaves enough
    long_enough = cut >= SHORT
    signed = texts.withColumn("_both", F.when(F.col("_n") < SHORT, F.struct(_short_sketch(F.col("_text"), size).alias("a"), F.array().cast("array<bigint>").alias("b")))
                              .otherwise(_long_sketches(F.col("_text"), F.col("_n"), size, kept=cut - k)))
    # what both hold goes through the exchange once: both are the least of their union, the second up to the cut
    signed = signed.select(key, "_text", "_n", F.sort_array(F.array_union("_both.a", "_both.b")).alias("_anchors"))
    paired = with_next(signed, key, "_text", ["_text", "_n", "_anchors"], "_next", chunk_bytes).withColumns({
        "_sketch": F.slice("_anchors", 1, size), "_kept": F.slice(F.filter("_anchors", lambda x: _place(x) <= cut - k), 1, size), "_next_sketch": F.slice("_next._anchors", 1, size)})
    end = F.substring(F.col("_next._text"), F.lit(1), F.col("_n") - cut)
    edited = paired.withColumn("_edited", F.concat(F.substring("_text", F.lit(1), cut), end)).withColumn("_end", F.concat(F.substring("_text", cut - k + 2, F.lit(k - 1)), end))
    merged = _sketch(F.sort_array(F.concat("_kept", _long_sketches(F.col("_end"), F.length("_end"), size, cut - k + 1)["a"])), size)
    edited = edited.withColumn("_edited_sketch", F.when(long_enough, merged).otherwise(sketch(F.col("_edited"), size))).withColumn("_m", F.length("_edited"))
    return edited.select(
        key, F.col("_n").cast("long").alias("n_chars"), F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("_sketch"), F.col("_n")).alias("fingerprint"), as_text(F.col("_edited_sketch"), F.col("_m")).alias("edited_fingerprint"),
        likeness(F.col("_sketch"), F.col("_n"), F.col("_edited_sketch"), F.col("_m"), size).alias("near_edited"),
        likeness(F.col("_sketch"), F.col("_n"), F.col("_next_sketch"), F.col("_next._n"), size).alias("near_next"))
