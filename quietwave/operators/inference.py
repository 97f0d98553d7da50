"""Posteriors over a table of prior draws: softmax weights and nearest statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietwave.operators.ordering import ROWS_PER_CHUNK, ranked, running
from quietwave.session import materialise

BLOCK_ROWS, BLOCKS, PIVOTS, PART_ROWS = 20_000, 1 << 16, 1024, 5_000
TASK_ROWS, LEAF_ROWS, CELL_SAMPLE, SAMPLE = 8192, 64, 32, 1 << 16


def posterior_weights(draws: DataFrame, event: list[str], logp: str = "logp") -> DataFrame:
    """weight = softmax of log-probability within an event; -inf gives 0, all -inf gives null."""
    top = draws.groupBy(*event).agg(F.max(logp).alias("_top"))
    lifted = draws.join(top, event).withColumn(
        "_e", F.when(F.col("_top") > float("-inf"), F.exp(F.col(logp) - F.col("_top"))))
    total = lifted.groupBy(*event).agg(F.sum("_e").alias("_sum"))
    return lifted.join(total, event).withColumn("weight", F.try_divide("_e", "_sum")).drop("_top", "_e", "_sum")


def weighted_quantiles(draws: DataFrame, groups: list[str], value: str, row_id: str, quantiles: tuple = (0.05, 0.5, 0.95),
                       weight: str = "weight", rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Smallest value whose running weight share reaches each quantile."""
    live = draws.where(F.col(weight) > 0)
    total = live.groupBy(*groups).agg(F.sum(weight).alias("_total"))
    swept = running(live.select(*groups, value, row_id, weight), [value, row_id], {"_mass": ("sum", weight)}, groups,
                    rows_per_chunk=rows_per_chunk).join(total, groups)
    share = F.col("_mass") / F.col("_total")
    return swept.groupBy(*groups).agg(F.max(value).alias("_top"), *[
        F.min(F.when(share >= q - 1e-12, F.col(value))).alias(f"_q{i}") for i, q in enumerate(quantiles)
    ]).select(*groups, F.explode(F.array(*[
        F.struct(F.lit(float(q)).alias("q"), F.coalesce(f"_q{i}", "_top").alias("value")) for i, q in enumerate(quantiles)
    ])).alias("_r")).select(*groups, "_r.*")


@dataclass
class BlockIndex:
    """Blocks of prior rows: number of rows and least and greatest value of every statistic."""

    count: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def bounds(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible distance of every point to the rows of every block, with room for rounding."""
        least, greatest = np.zeros((len(points), len(self.count))), np.zeros((len(points), len(self.count)))
        for a in range(points.shape[1]):
            under, over = self.low[:, a] - points[:, a, None], points[:, a, None] - self.high[:, a]
            least += np.maximum(0.0, np.maximum(under, over)) ** 2
            greatest += np.maximum(np.abs(under), np.abs(over)) ** 2
        return np.sqrt(least) * (1 - 1e-12), np.sqrt(greatest) * (1 + 1e-12)

    def first_visit(self, greatest: np.ndarray, k: int) -> np.ndarray:
        """Points x blocks: the blocks, by greatest distance, that hold k rows for sure."""
        order = np.argsort(greatest, axis=1, kind="stable")
        held = np.cumsum(self.count[order], axis=1)
        taken = held - self.count[order] < k
        out = np.zeros_like(taken)
        np.put_along_axis(out, order, taken, 1)
        return out


def _usable(stats: str) -> Column:
    return F.col(stats).isNotNull() & F.forall(stats, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def _cuts(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and value of the cuts of a balanced tree (2 k + 1 and 2 k + 2 lie below k), and the widest axis of its cells."""
    axis, at = np.zeros(2 ** (depth + 1) - 1, int), np.zeros(2 ** (depth + 1) - 1)
    parts = [sample]
    for level in range(depth + 1):
        below = []
        for k, rows in enumerate(parts, 2**level - 1):
            if len(rows):
                axis[k] = np.ptp(rows, axis=0).argmax()
                at[k] = np.median(rows[:, axis[k]])
            low = rows[:, axis[k]] <= at[k]
            below += [rows[low], rows[~low]]
        parts = below
    return axis, at


def _assigned(prior: DataFrame, row_id: str, stats: str, axis: np.ndarray, at: np.ndarray) -> DataFrame:
    """The cell of every row and its value along the widest axis of the cell."""
    inner = len(axis) // 2

    @F.pandas_udf("cell int, along double")
    def place(rows: pd.Series) -> pd.DataFrame:
        points = np.stack([np.asarray(v, float) for v in rows]) if len(rows) else np.zeros((0, 1))
        node, every = np.zeros(len(points), int), np.arange(len(points))
        while len(node) and node[0] < inner:
            node = 2 * node + 1 + (points[every, axis[node]] > at[node])
        return pd.DataFrame({"cell": (node - inner).astype(np.int32), "along": points[every, axis[node]]})

    return prior.withColumn("_n", place(stats)).select(F.col(row_id).alias("_id"), F.col(stats).cast("array<double>").alias("_s"), "_n.*")


def prior_index(prior: DataFrame, row_id: str, stats: str, block_rows: int = BLOCK_ROWS, pivots: int = PIVOTS) -> tuple[DataFrame, BlockIndex]:
    """Prior rows (_id, _s, block), written, and the bounds of their blocks.

    Space is halved at medians of a sample of at most SAMPLE rows (at least `pivots` if there are as many), along
    the widest axis each time; cells that still hold more than `block_rows` rows are cut further by rank, so equal
    rows too. The sample only sets where cuts lie. The driver gets the sample and a box per block, at most about
    2 BLOCKS of them: beyond that blocks grow.
    """
    usable = prior.where(_usable(stats))
    total = usable.count()
    if not total:
        none = usable.select(F.lit(0).alias("block"), F.col(row_id).alias("_id"), F.col(stats).cast("array<double>").alias("_s"))
        return none, BlockIndex(np.zeros(0, int), np.zeros((0, 1)), np.zeros((0, 1)))
    block_rows = max(block_rows, -(-total // BLOCKS))
    depth = int(np.ceil(np.log2(max(1.0, total / (0.7 * block_rows))))) if total > block_rows else 0
    wanted = min(SAMPLE, max(pivots, CELL_SAMPLE * 2**depth))
    sample = usable.select(stats).orderBy(F.xxhash64(row_id, stats)).limit(wanted).collect()
    points = np.array([r[0] for r in sample], float).reshape(len(sample), -1)
    placed = materialise(_assigned(usable, row_id, stats, *_cuts(points, depth)), "cells")
    largest = placed.groupBy("cell").count().agg(F.max("count")).first()[0]
    if largest > block_rows:
        placed = ranked(placed, ["along", "_id"], ["cell"], "_rank").withColumn("ring", F.floor((F.col("_rank") - 1) / block_rows).cast("int")).drop("_rank")
        placed = materialise(placed, "prior")
    else:
        placed = placed.withColumn("ring", F.lit(0))
    sides = [F.array(*[f(F.col("_s")[a]) for a in range(points.shape[1])]).alias(n) for f, n in ((F.min, "low"), (F.max, "high"))]
    rows = placed.groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("n"), *sides).orderBy("cell", "ring").collect()
    index = BlockIndex(np.array([r["n"] for r in rows], int), *(np.array([r[c] for r in rows], float).reshape(len(rows), -1) for c in ("low", "high")))
    numbers = prior.sparkSession.createDataFrame([(r["cell"], r["ring"], b) for b, r in enumerate(rows)], "cell int, ring int, block int")
    return placed.join(numbers, ["cell", "ring"]).select("block", "_id", "_s"), index


def _leaves(points: np.ndarray, leaf: int) -> tuple[np.ndarray, BlockIndex]:
    """An order of the rows in which leaves of at most `leaf` neighbours lie together, and their boxes."""
    done, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            done.append(rows)
            continue
        axis, half = np.ptp(points[rows], axis=0).argmax(), len(rows) // 2
        rows = rows[np.argpartition(points[rows, axis], half)]
        todo += [rows[:half], rows[half:]]
    return np.concatenate(done), BlockIndex(np.array([len(r) for r in done]), *(np.stack([f(points[r], axis=0) for r in done]) for f in (np.min, np.max)))


def _visit(blocks: DataFrame, sizes: DataFrame, requests: DataFrame, k: int, id_type: str, part_rows: int, leaf: int, slice_rows: int) -> DataFrame:
    """The k nearest rows of each requested block, none beyond _kth: (_row, _id, distance).

    A block with more requests than rows is split, so copies of blocks are never more rows than blocks and requests.
    """
    counts = requests.groupBy("block").agg(F.count(F.lit(1)).alias("_asked")).join(sizes, "block").select(
        "block", F.ceil(F.col("_asked") / F.greatest(F.lit(part_rows), "_rows")).cast("int").alias("_parts"))
    split = requests.join(counts, "block").withColumn("_part", F.pmod(F.xxhash64("_row"), F.col("_parts")).cast("int")).drop("_parts")
    copies = blocks.join(counts, "block").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")

    def best(rows: pa.Table, asked: pa.Table) -> pa.Table:
        who, what, far = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
        ids = rows.column("_id").combine_chunks()
        if len(ids) and asked.num_rows:
            points, own = (t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) for t, c in ((rows, "_s"), (asked, "_t")))
            limit = asked.column("_kth").to_numpy()
            place = np.empty(len(ids), int)
            place[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
            order, tree = _leaves(points, leaf)
            points, place = points[order], place[order]
            leaf_of = np.repeat(np.arange(len(tree.count)), tree.count)
            for at in range(0, len(own), slice_rows):
                least, _ = tree.bounds(own[at:at + slice_rows])
                for i, near in enumerate(least, at):
                    # the leaves nearest by their boxes hold k rows for sure; then all that the k-th distance leaves open
                    first = np.argsort(near, kind="stable")
                    seen = np.zeros(len(near), bool)
                    seen[first[:np.searchsorted(np.cumsum(tree.count[first]), min(k, len(points))) + 1]] = True
                    found = np.flatnonzero(seen[leaf_of])
                    away = np.sqrt(((points[found] - own[i]) ** 2).sum(axis=1))
                    bound = limit[i] if len(found) < k else min(limit[i], np.partition(away, k - 1)[k - 1])
                    more = np.flatnonzero((~seen & (near <= bound))[leaf_of])
                    if len(more):
                        found, away = np.concatenate([found, more]), np.concatenate([away, np.sqrt(((points[more] - own[i]) ** 2).sum(axis=1))])
                    open_ = np.flatnonzero(away <= bound)
                    kept = open_[np.lexsort((place[found[open_]], away[open_]))[:k]]
                    who.append(np.full(len(kept), i))
                    what.append(order[found[kept]])
                    far.append(away[kept])
        return pa.table([asked.column("_row").take(pa.array(np.concatenate(who))), ids.take(pa.array(np.concatenate(what))), pa.array(np.concatenate(far))], names=["_row", "_id", "distance"])

    return copies.groupBy("block", "_part").cogroup(split.groupBy("block", "_part")).applyInArrow(best, f"_row long, _id {id_type}, distance double")


def nearest_draws(prior: DataFrame, observed: DataFrame, row_id: str, event: str, stats: str, k: int,
                  block_rows: int = BLOCK_ROWS, pivots: int = PIVOTS, part_rows: int = PART_ROWS, task_rows: int = TASK_ROWS, block: int = 1024) -> DataFrame:
    """The k prior rows whose statistics lie nearest those of each observed row: (event, row_id, distance, rank).

    The index has two levels of boxes: blocks of `block_rows` prior rows, at least `task_rows`, which the driver
    knows, and leaves of at most LEAF_ROWS within a block, which its task makes. First each row visits the blocks
    that hold k rows for sure and lie nearest; the k-th distance found there then rules out all other blocks, and
    leaves in them, but those that may hold a nearer row, which are visited second. The result is exact, ties by
    row_id. Observed rows stay distributed and each is a row of its own, whatever its event; a block asked for by
    many of them, `part_rows` at least, is copied to several tasks, which take `block` of them at a time. Rows
    of the prior or observed rows that are null or hold a null or non-finite number take no part.
    """
    spark = prior.sparkSession
    id_type, event_type = (df.schema[c].dataType.simpleString() for df, c in ((prior, row_id), (observed, event)))
    blocks, index = prior_index(prior, row_id, stats, max(block_rows, task_rows), pivots)
    asked = observed.where(_usable(stats)).select(F.col(event).alias("event"), F.col(stats).cast("array<double>").alias("_t")).withColumn("_row", F.monotonically_increasing_id())
    if not len(index.count):
        return spark.createDataFrame([], f"event {event_type}, `{row_id}` {id_type}, distance double, rank int")
    asked = materialise(asked, "observed")
    # plain arrays: the class travels with the job, not with the broadcast
    shared = spark.sparkContext.broadcast((index.count, index.low, index.high))
    sizes = spark.createDataFrame([(b, int(n)) for b, n in enumerate(index.count)], "block int, _rows int")
    leaf = max(1, min(block_rows, LEAF_ROWS))

    def requests(limits: bool):
        def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = BlockIndex(*shared.value)
            step = max(1, 2_000_000 // len(tree.count))
            for batch in batches:
                points = np.array(batch.column("_t").to_pylist(), float).reshape(batch.num_rows, -1)
                for at in range(0, batch.num_rows, step):
                    least, greatest = tree.bounds(points[at:at + step])
                    chosen, kth = tree.first_visit(greatest, k), np.full(len(least), np.inf)
                    if limits:
                        kth = batch.column("_kth").to_numpy(zero_copy_only=False)[at:at + step]
                        chosen = ~chosen & (least <= kth[:, None])
                    row, block = np.nonzero(chosen)
                    part = batch.slice(at, step).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([part.column("_row"), part.column("_t"), pa.array(kth[row]), pa.array(block.astype(np.int32))], names=["_row", "_t", "_kth", "block"])
        return job

    schema = "_row long, _t array<double>, _kth double, block int"
    visit = (k, id_type, part_rows, leaf, block)
    first = materialise(_visit(blocks, sizes, asked.select("_row", "_t").mapInArrow(requests(False), schema), *visit), "nearest")
    found = first
    if len(index.count) > 1:
        order = Window.partitionBy("_row").orderBy("distance")
        kth = first.withColumn("_at", F.row_number().over(order)).where(F.col("_at") == k).select("_row", F.col("distance").alias("_kth"))
        # with fewer than k rows in all, the first visit went everywhere
        bounded = asked.join(kth, "_row").select("_row", "_t", "_kth")
        found = first.unionByName(_visit(blocks, sizes, bounded.mapInArrow(requests(True), schema), *visit))
    ranks = found.withColumn("rank", F.row_number().over(Window.partitionBy("_row").orderBy("distance", "_id"))).where(F.col("rank") <= k)
    return ranks.join(asked.select("_row", "event"), "_row").select("event", F.col("_id").alias(row_id), "distance", "rank")
