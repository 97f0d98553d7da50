"""Long repeated strings by a run-length Burrows-Wheeler index of aligned contexts.

Every byte under a string of `length` bytes that also starts anywhere else is removed, with matches
inside one text and overlapping ones.

Where a long string can repeat is found first. Each window of `length` bytes picks its anchor, the
32-byte gram of least hash; equal windows pick equal anchors at equal places, so a repeated window shows
as a repeated anchor. An anchor's context is all that a window around it can reach. Anchors that occur
once end there; contexts that occur twice are repeated in full. Only the rest, the ends of repeats, are
indexed: contexts aligned at their anchors, in a Burrows-Wheeler transform by column. A pass over the
columns streams each context's matching statistic (the longest match that ends here, found beside it in
co-lexicographic order). A match ends where a run of equal bytes in the transform ends, so only run ends
are sampled; samples of `length` or more give the marks.

Texts are known by their MD5, positions are bytes. Groups are cut at `most` contexts: beyond that the
windows of a hot anchor are counted by hash in a plain distributed aggregate, to the same result. Equal
contexts and equal texts are aggregated before they meet.

Defined results: a null text is empty, and the text left of it is null; texts shorter than `length` lose nothing; equal texts of
`length` bytes or more lose everything, wherever they stand; null ids are kept; an empty table gives no
rows; other columns pass through `mark_texts`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietwave.llm.common import Work, text_bytes

LENGTH, GRAM = 200, 32
MOST = 50_000
BLOCK = 1 << 20
PLACES = 1 << 15
FACTORS = np.random.RandomState(7).randint(1, 2**62, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray, factor: np.uint64) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= factor
    return x ^ (x >> np.uint64(29))


def sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over each run of `width` values, by doubling."""
    step = 1
    while step * 2 <= width:
        x, step = pick(x[:-step], x[step:]), step * 2
    return pick(x[:len(x) - (width - step)], x[width - step:]) if step < width else x


def words_at(data: np.ndarray, count: int) -> np.ndarray:
    """The 8-byte words that start at each of the first `count` bytes."""
    return np.lib.stride_tricks.as_strided(data[:8].view("<u8"), shape=(count,), strides=(1,), writeable=False)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, places: int = PLACES) -> Iterator[tuple[np.ndarray, ...]]:
    """(place, text row, left, right, anchor hash, context hash) of all anchors of texts that lie end to end, `places` at a time.

    Where a text repeats one byte, every byte is an anchor; the slices hold its contexts to a bound.
    """
    n, grams = len(data), length - GRAM + 1
    left = grams - 1
    padded = np.concatenate([np.zeros(left, np.uint8), data, np.zeros(length + 8, np.uint8)])
    words = words_at(padded[left:], n + GRAM)
    hashes = words[:n] * FACTORS[0]
    for j in range(1, GRAM // 8):
        hashes += words[8 * j:8 * j + n] * FACTORS[j]
    hashes = mixed(hashes, FACTORS[255]) | np.uint64(1)
    # least hash of the window at each start; 0 where no window fits into its text
    least = sliding(np.concatenate([hashes, np.full(grams - 1, np.iinfo(np.uint64).max)]), grams, np.minimum)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        least[max(a, b - length + 1):b] = 0
    best = sliding(np.concatenate([np.zeros(grams - 1, np.uint64), least]), grams, np.maximum)
    every = np.flatnonzero(best == hashes)
    del least, best
    windows = np.lib.stride_tricks.sliding_window_view(padded[:n + left + length], left + length)
    column = np.arange(left + length + -(left + length) % 8)
    for start in range(0, len(every), places):
        place = every[start:start + places]
        row = np.searchsorted(offsets, place, side="right") - 1
        before, behind = np.minimum(left, place - offsets[row]), np.minimum(length, offsets[row + 1] - place)
        context = np.ascontiguousarray(np.pad(windows[place], ((0, 0), (0, -(left + length) % 8))))
        short = np.flatnonzero((before < left) | (behind < length))
        own = context[short]
        own[(column < left - before[short, None]) | (column >= left + behind[short, None])] = 0
        context[short] = own
        total = before.astype(np.uint64) * FACTORS[253] + behind.astype(np.uint64) * FACTORS[254]
        for j, word in enumerate(context.view("<u8").T):
            total += word * FACTORS[8 + j % 240] + (word >> np.uint64(32)) * FACTORS[9 + j % 240]
        yield place - offsets[row], row, before, behind, hashes[place].view(np.int64), mixed(total, FACTORS[252]).view(np.int64)


ANCHORS = "text_id binary, at int, before short, behind short, anchor long, context long"


def find_anchors(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """Anchors of a table (text_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            start = 0
            while start < batch.num_rows:
                # whole texts, about a block of bytes at a time
                stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + BLOCK, side="right")) - 1)
                stop = min(stop, batch.num_rows)
                part = data[offsets[start]:offsets[stop]]
                if len(part) >= length:
                    for at, row, before, behind, anchor, context in anchors(part, offsets[start:stop + 1] - offsets[start], length):
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array(start + row)), pa.array(at.astype(np.int32)), pa.array(before.astype(np.int16)), pa.array(behind.astype(np.int16)), pa.array(anchor), pa.array(context)],
                            names=["text_id", "at", "before", "behind", "anchor", "context"])
                start = stop

    return texts.select("text_id", "text").mapInArrow(run, ANCHORS)


def with_id(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn("text_id", F.unhex(F.md5(F.coalesce(text, F.lit("")))))


CONTEXTS = "anchor long, context long, before short, behind short, bytes binary"


def read_contexts(texts: DataFrame, wanted: DataFrame, length: int = LENGTH) -> DataFrame:
    """Bytes around wanted anchors (text_id, list of places) from the texts, each text once."""
    left = length - GRAM
    once = texts.groupBy("text_id").agg(F.any_value("text").alias("text"))
    joined = once.join(wanted, "text_id").select("text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            lists = batch.column(1)
            own, row = lists.flatten(), np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            at, before, behind = (own.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "before", "behind"))
            at = at + offsets[row]
            raw = data.tobytes()
            cut = [raw[a:b] for a, b in zip((at - before).tolist(), (at + behind).tolist(), strict=True)]
            for a in range(0, len(cut), 20_000):
                s = slice(a, a + 20_000)
                yield pa.RecordBatch.from_arrays([own.field("anchor")[s], own.field("context")[s], own.field("before")[s], own.field("behind")[s], pa.array(cut[s], pa.binary())],
                                                 names=["anchor", "context", "before", "behind", "bytes"])

    return joined.mapInArrow(run, CONTEXTS)


def aligned(raw: list[bytes], before: np.ndarray, behind: np.ndarray, left: int, width: int) -> np.ndarray:
    """Contexts as rows of symbols with the anchor at column `left`; 256 and 257 stand before and behind a text."""
    table = np.full((len(raw), width), 256, dtype=np.uint16)
    for row, own in enumerate(raw):
        start = left - before[row]
        table[row, start:start + len(own)] = np.frombuffer(own, np.uint8)
        table[row, start + len(own):] = 257
    return table


def long_matches(table: np.ndarray, before: np.ndarray, behind: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For each context the first and last column (exclusive) under matches of `length` with another one; (0, 0) for none.

    The order at a column is co-lexicographic in what lies before it; `start[i]` is where the match of
    the contexts i - 1 and i in that order begins. The transform of the column is its symbols in that
    order: where two neighbours differ a run ends, and with it their match.
    """
    left, width = length - GRAM, table.shape[1]
    n = len(table)
    low, high = np.full(n, width), np.zeros(n, dtype=np.int64)
    # the order at the end of the anchor by one sort; later columns refine it
    head = np.ascontiguousarray(table[:, :left + GRAM][:, ::-1]).astype(">u2")
    order = np.argsort(head.view(np.dtype((np.void, 2 * head.shape[1]))).ravel(), kind="stable")
    ranked = head[order]
    differ = ranked[1:] != ranked[:-1]
    same = np.where(differ.any(axis=1), differ.argmax(axis=1), head.shape[1])
    start = np.concatenate([[width], left + GRAM - same])
    first, last = left - before.astype(np.int64), left + behind.astype(np.int64)
    columns = np.ascontiguousarray(table.T)
    for j in range(left + GRAM, width + 1):
        # contexts whose longest match begins behind the anchor can never reach the length again
        following = np.append(start[1:], width)
        keep = np.minimum(start, following) <= left
        if not keep.all():
            places = np.flatnonzero(keep)
            if len(places) < 2:
                break
            # a match across dropped contexts begins where the latest of those between begins
            start = np.concatenate([[width], np.maximum.reduceat(np.append(start, 0), np.column_stack([places[:-1] + 1, places[1:] + 1]).ravel())[::2]])
            order = order[places]
        symbols = columns[j][order] if j < width else np.arange(len(order), dtype=np.int64)
        ends = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
        if j >= length and len(ends):
            x, y, begin = order[ends - 1], order[ends], start[ends]
            begin, end = np.maximum(begin, np.maximum(first[x], first[y])), np.minimum(j, np.minimum(last[x], last[y]))
            found = end - begin >= length
            for own in (x[found], y[found]):
                np.minimum.at(low, own, begin[found])
                np.maximum.at(high, own, end[found])
        if j == width:
            break
        step = np.argsort(symbols, kind="stable")
        moved = np.full(len(order), j + 1, dtype=np.int64)
        ranked = symbols[step]
        edges = np.append(np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])), len(ranked))
        shifted = np.append(start[1:], 0)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a == 1:
                continue
            places = step[a:b]
            if places[-1] - places[0] == b - a - 1:
                moved[a + 1:b] = start[places[1:]]
            else:
                moved[a + 1:b] = np.maximum.reduceat(shifted[:places[-1]], places[:-1])
        moved[0] = width
        order, start = order[step], moved
    return np.where(high > 0, low, 0), high


def index_contexts(contexts: DataFrame, length: int = LENGTH, batch_rows: int = 16_384) -> DataFrame:
    """(anchor, context, before, behind): how far around the anchor a context's repeats reach."""
    left = length - GRAM
    dealt = contexts.repartition(F.col("anchor")).sortWithinPartitions("anchor")
    names = ["anchor", "context", "before", "behind"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def work(table: pa.Table) -> pa.RecordBatch:
            before, behind = (table.column(c).to_numpy().astype(np.int64) for c in ("before", "behind"))
            rows = aligned([x.as_buffer() for x in table.column("bytes")], before, behind, left, left + length)
            low, high = long_matches(rows, before, behind, length)
            hit = np.flatnonzero(high)
            return pa.RecordBatch.from_arrays(
                [table.column("anchor").combine_chunks().take(pa.array(hit)), table.column("context").combine_chunks().take(pa.array(hit)),
                 pa.array((left - low[hit]).astype(np.int16)), pa.array((high[hit] - left).astype(np.int16))], names=names)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < batch_rows:
                continue
            table = pa.Table.from_batches(held)
            own = table.column("anchor").to_numpy()
            # the last group may go on in the next batch
            cut = int(np.searchsorted(own, own[-1]))
            if cut:
                # contexts of different anchors never match, so they can share an index
                yield work(table.slice(0, cut))
            held = table.slice(cut).to_batches()
        if held and sum(b.num_rows for b in held):
            yield work(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "anchor long, context long, before short, behind short")


def count_windows(contexts: DataFrame, length: int = LENGTH) -> DataFrame:
    """The result of `index_contexts` for hot anchors, by counting every window of every context by its MD5."""
    left = length - GRAM
    offsets = F.explode(F.sequence(F.lit(0), F.lit(left))).alias("a")
    rows = contexts.select("anchor", "context", "before", "behind", "bytes", offsets).where((F.col("a") <= F.col("before")) & (length - F.col("a") <= F.col("behind")))
    window = F.md5(F.expr(f"substring(bytes, before - a + 1, {length})"))
    keyed = rows.select("anchor", "context", "a", window.alias("w"))
    # equal windows of an anchor stand at equal offsets
    twice = keyed.groupBy("anchor", "a", "w").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "a", "w")
    found = keyed.join(twice, ["anchor", "a", "w"])
    return found.groupBy("anchor", "context").agg(F.max("a").cast("short").alias("before"), (length - F.min("a")).cast("short").alias("behind"))


def find_spans(docs: DataFrame, work: Work, text: str = "text", length: int = LENGTH, most: int = MOST) -> DataFrame:
    """(text_id, spans): for each text with repeats the byte spans under them, overlapping ones included."""
    texts = with_id(docs.select(F.col(text).alias("text")).where(F.octet_length("text") >= length), "text")
    every = work.save(find_anchors(texts, length), "anchors")
    repeated = every.groupBy("anchor").agg(F.count("*").alias("n"), F.min("context").alias("low"), F.max("context").alias("high")).where("n > 1")
    # written first, so that both sides of the join are plain exchanges and Spark can split a hot anchor
    repeated = work.save(repeated.select("anchor", (F.col("low") == F.col("high")).alias("single")), "hits")
    kept = work.save(every.join(repeated, "anchor"), "repeated")
    work.drop("anchors", "hits")
    open_ends = kept.where(~F.col("single"))
    groups = work.save(open_ends.groupBy("anchor", "context").agg(
        F.count("*").alias("n"), F.min(F.struct("text_id", "at", "before", "behind")).alias("one")), "groups")
    hot = groups.groupBy("anchor").agg(F.count("*").alias("contexts")).where(F.col("contexts") > most).select("anchor")
    place = F.struct(F.col("one.at").alias("at"), F.col("one.before").alias("before"), F.col("one.behind").alias("behind"), "anchor", "context")
    wanted = groups.groupBy(F.col("one.text_id").alias("text_id")).agg(F.collect_list(place).alias("places"))
    contexts = work.save(read_contexts(texts, wanted, length), "contexts")
    some_hot = hot.limit(1).count() > 0
    reach = index_contexts(contexts.join(hot, "anchor", "left_anti") if some_hot else contexts, length)
    if some_hot:
        reach = reach.unionByName(count_windows(contexts.join(hot, "anchor", "left_semi"), length))
    whole = groups.where("n > 1").select("anchor", "context", F.col("one.before").alias("before"), F.col("one.behind").alias("behind"))
    # a context that occurs twice is repeated in full, whatever the index says
    reach = work.save(reach.unionByName(whole).groupBy("anchor", "context").agg(F.max("before").alias("b"), F.max("behind").alias("e")), "reach")
    work.drop("contexts", "groups")
    span = lambda b, e: F.struct((F.col("at") - F.col(b)).cast("int").alias("s"), (F.col("at") + F.col(e)).cast("int").alias("e")).alias("span")
    ends = open_ends.join(reach, ["anchor", "context"]).select("text_id", span("b", "e"))
    spans = kept.where("single").select("text_id", span("before", "behind")).unionByName(ends).distinct()
    found = work.save(spans.groupBy("text_id").agg(F.sort_array(F.collect_list("span")).alias("spans")), "spans")
    work.drop("repeated", "reach")
    return found


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in spans:
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


MARKED = (("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType()), ("kept_text", T.StringType()))


def mark_texts(docs: DataFrame, text: str = "text", length: int = LENGTH, keep: list[str] | None = None, kept_text: bool = True, prefix: str = "") -> DataFrame:
    """The columns `keep` of every row with what was removed: bytes, maximal spans, digest and the text that is left.

    The text that is left drops the parts of signs that a cut leaves behind. The added columns take the
    place of kept ones of the same name.
    """
    work = Work(docs.sparkSession, "suffix")
    spans = find_spans(docs, work, text, length)
    added = [T.StructField(prefix + name, kind) for name, kind in MARKED][:5 if kept_text else 4]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in {f.name for f in added}]
    # the row travels as one column, so its names cannot meet those used here
    named = with_id(docs.select(F.struct(*keep).alias("row"), F.col(text).alias("text")), "text")
    joined = named.join(spans, "text_id", "left").select("row", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()][:len(added)]
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            present = batch.column("text").is_valid().to_pylist()
            lists = batch.column("spans")
            ends = lists.flatten()
            firsts, lasts = (ends.field(c).to_numpy(zero_copy_only=False).tolist() for c in ("s", "e"))
            bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).tolist()
            rows = []
            for i in range(batch.num_rows):
                raw = data[offsets[i]:offsets[i + 1]].tobytes()
                cuts = merged(list(zip(firsts[bounds[i]:bounds[i + 1]], lasts[bounds[i]:bounds[i + 1]], strict=True)))
                edges = [0, *(x for cut in cuts for x in cut), len(raw)]
                left = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if cuts else raw
                rows.append((len(raw), len(raw) - len(left), len(cuts), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if present[i] else None)[:len(added)])
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(added)
            yield pa.RecordBatch.from_arrays([*batch.column("row").flatten(), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], names=[*keep, *(f.name for f in added)])

    return joined.mapInArrow(run, T.StructType([docs.schema[c] for c in keep] + added))


def drop_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """Documents with the repeated bytes taken out of the text, n_chars adjusted; those with nothing left go."""
    marked = mark_texts(docs, text, length, keep=[c for c in docs.columns if c != text], prefix="__")
    out = marked.where((F.col("__n_removed") == 0) | (F.length("__kept_text") > 0))
    new = {text: F.col("__kept_text")}
    if "n_chars" in docs.columns and text != "n_chars":
        new["n_chars"] = F.when(F.col("__n_removed") > 0, F.length("__kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(new).select(*docs.columns)
