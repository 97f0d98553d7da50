"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur in a text with up to `rate` x its length edits. It is split into one piece more
than that budget, so every occurrence holds a piece unchanged. One automaton over all pieces finds the
exact hits in a scan of each text; the text around a hit is verified with Myers' bit-parallel edit
distance, the item's bits in one integer. Texts are not shuffled. Both sides are compared in lower case
with runs of white space as one space.

Items reach the tasks in slices of at most `slice_bytes`; more items than that take further scans, so
their number has no cap.

Defined results: null and empty texts match nothing; empty items match nothing; items below `shortest`
signs, where a budget would match by chance, match exactly; equal items are separate items; an item key may
be of any plain type, and null; repeated
documents are separate documents; an empty table on either side gives no matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quietwave.llm.common import Work

RATE, SHORTEST = 0.05, 40


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces of nearly equal length with their places."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def sign_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(masks: dict[str, int], length: int, window: str, budget: int) -> tuple[int, int] | None:
    """(least distance, end) of the item anywhere in the window, if within the budget; the first such end."""
    full, top = (1 << length) - 1, 1 << (length - 1)
    up, down, distance = full, 0, length
    best = None
    for end, c in enumerate(window, 1):
        equal = masks.get(c, 0)
        vertical = equal | down
        across = (((equal & up) + up) ^ up) | equal
        plus, minus = down | (full & ~(across | up)), up & across
        if plus & top:
            distance += 1
        elif minus & top:
            distance -= 1
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | (full & ~(vertical | plus)), plus & vertical
        if distance <= budget and (best is None or distance < best[0]):
            best = (distance, end)
    return best


class Matcher:
    """All items of a slice as one automaton."""

    def __init__(self, items: list[tuple[object, str]], rate: float, shortest: int):
        import ahocorasick

        self.items, by_piece = [], {}
        for key, text in items:
            item = normal(text or "")
            if item:
                budget = int(len(item) * rate) if len(item) >= shortest else 0
                for place, piece in pieces(item, budget):
                    by_piece.setdefault(piece, []).append((len(self.items), place))
                self.items.append((key, item, budget, None))
        self.automaton = ahocorasick.Automaton()
        for piece, places in by_piece.items():
            self.automaton.add_word(piece, (len(piece), places))
        if by_piece:
            self.automaton.make_automaton()
        self.masks: dict[int, dict[str, int]] = {}

    def matches(self, raw: str) -> list[tuple[object, int, int]]:
        """(item key, distance, end in the normal text) of the best match of each item found."""
        text = normal(raw)
        diagonals: dict[int, set[int]] = {}
        for end, (length, places) in self.automaton.iter(text):
            for number, place in places:
                diagonals.setdefault(number, set()).add(end + 1 - length - place)
        out = []
        for number, starts in diagonals.items():
            key, item, budget, _ = self.items[number]
            masks = self.masks.setdefault(number, sign_masks(item))
            best, low, high = None, None, None
            for start in [*sorted(starts), None]:
                # windows of hits that overlap are verified as one
                if high is not None and (start is None or start - budget > high):
                    window = text[low:high]
                    found = (0, window.find(item) + len(item)) if item in window else myers(masks, len(item), window, budget)
                    if found and (best is None or found[0] < best[0]):
                        best = (found[0], low + found[1])
                    low = high = None
                if start is not None:
                    low = max(0, start - budget) if low is None else low
                    high = max(high or 0, start + len(item) + budget)
            if best:
                out.append((key, *best))
        return sorted(out, key=lambda m: (m[1], m[2], str(m[0])))


def item_slices(items: DataFrame, key: str, text: str, slice_bytes: int) -> Iterator[list[tuple[object, str]]]:
    """The items in lists of at most `slice_bytes` of text (or one item), one at a time on the driver."""
    held, size = [], 0
    for row in items.select(key, text).where(F.col(text).isNotNull()).orderBy(key, text).toLocalIterator():
        if held and size + len(row[1]) > slice_bytes:
            yield held
            held, size = [], 0
        held.append((row[0], row[1]))
        size += len(row[1])
    if held:
        yield held


def find_matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
                 rate: float = RATE, shortest: int = SHORTEST, slice_bytes: int = 8 << 20) -> DataFrame:
    """(key, item key, distance, end): the best match of each item in each document that holds it."""
    out = None
    id_type, item_type = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema, named = f"doc_id {id_type}, item_id {item_type}, distance int, match_end long", to_arrow_type(items.schema[item_key].dataType)
    for held in item_slices(items, item_key, item_text, slice_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(held)  # at most slice_bytes

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate, shortest)
            for batch in batches:
                found = [(row, *m) for row, t in enumerate(batch.column(1).to_pylist()) if t and matcher.items for m in matcher.matches(t)]
                rows = pa.array([f[0] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), pa.array([f[1] for f in found], named), pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.int64())],
                    names=["doc_id", "item_id", "distance", "match_end"])

        part = docs.select(key, text).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
                      rate: float = RATE, shortest: int = SHORTEST, slice_bytes: int = 8 << 20) -> DataFrame:
    """The rows without a match. Each row goes by its own text alone, whatever its key: null and repeated keys take no other row along.

    Texts are not shuffled. With more than one slice of items the rows left are written between the scans.
    """
    work, schema, last = Work(docs.sparkSession, "decontam"), docs.schema, None
    for number, held in enumerate(item_slices(items, item_key, item_text, slice_bytes)):
        shared = docs.sparkSession.sparkContext.broadcast(held)  # at most slice_bytes

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate, shortest)
            for batch in batches:
                clean = [not (t and matcher.items and matcher.matches(t)) for t in batch.column(text).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        if number:
            docs = work.save(docs, f"left{number}")
            if last:
                work.drop(last)
            last = f"left{number}"
        docs = docs.mapInArrow(run, schema)
    return docs
