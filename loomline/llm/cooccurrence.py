"""Problem 7: which two items stand in the same baskets, how often, and how far above chance.

Items that can be in a result get dense numbers, so a pair packs into one 64-bit code. Each
task writes its codes as sorted runs with counts; Spark's external sorter spills and merges
the runs, and one pass over the sorted codes adds up equal neighbours. Counts then give the
lift and an odds ratio with continuity correction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from ..operators.references import might_contain
from ..sources.tables import cut_lineage

#: Codes that a task holds before it sorts them and writes a run (8 bytes each).
RUN_CODES = 2_000_000
#: Over how many keys the rows of one oversized basket are spread while it is taken out.
SALTS = 64


def bounded_baskets(rows: DataFrame, basket: str, item: str, min_size: int, max_size: int) -> DataFrame:
    """Distinct (basket, item) of the baskets with min_size to max_size different items.

    A basket beyond max_size, however large, is never gathered: it is recognised by its count,
    and only rows that a Bloom filter of such baskets lets through are joined, spread by a salt.
    """
    distinct = cut_lineage(
        rows.select(F.col(basket).cast("string").alias("basket"), F.col(item).cast("string").alias("item"))
        .filter((F.coalesce("basket", F.lit("")) != "") & (F.coalesce("item", F.lit("")) != ""))
        .distinct()
    )
    sizes = distinct.groupBy("basket").agg(F.count("*").alias("size"))
    out = cut_lineage(sizes.filter((F.col("size") < min_size) | (F.col("size") > max_size)).select("basket"))
    doubted = might_contain(out, "basket", F.col("basket"), out.count())
    # the filter already leaves next to nothing to check, so this join is cheap without a broadcast too
    salted = out.select("basket", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    checked = (
        distinct.filter(doubted)
        .withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS)).cast("int"))
        .join(salted.hint("merge"), ["basket", "salt"], "left_anti")
        .select("basket", "item")
    )
    return distinct.filter(~doubted).unionByName(checked)


def _run(codes: list[np.ndarray]) -> pa.RecordBatch:
    unique, n = np.unique(np.concatenate(codes), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(unique), pa.array(n.astype(np.int64))], names=["pair", "n"])


def _pair_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs (pair, n) of the packed pairs of all baskets, made for all baskets of one size at once."""
    held, count = [], 0
    for batch in batches:
        lists = batch.column("codes")
        items = np.asarray(lists.flatten(), np.int64)
        offsets = np.asarray(lists.offsets, np.int64)
        offsets = offsets - offsets[0]
        sizes = np.diff(offsets)
        for size in np.unique(sizes):
            first, second = np.triu_indices(size, 1)
            if not len(first):
                continue
            starts = offsets[:-1][sizes == size]
            step = max(1, RUN_CODES // len(first))
            for i in range(0, len(starts), step):
                block = np.sort(items[starts[i : i + step, None] + np.arange(size)], axis=1)
                codes = ((block[:, first] << 32) | block[:, second]).ravel()
                held.append(codes)
                count += len(codes)
                if count >= RUN_CODES:
                    yield _run(held)
                    held, count = [], 0
    if held:
        yield _run(held)


def _merged(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Run lengths of sorted (pair, n): equal pairs added up, also across batch borders."""
    last, total = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        pair, n = np.asarray(batch.column("pair")), np.asarray(batch.column("n"))
        heads = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        keys, sums = pair[heads], np.add.reduceat(n, heads)
        if last is not None and keys[0] == last:
            sums[0] += total
        elif last is not None:
            keys, sums = np.concatenate(([last], keys)), np.concatenate(([total], sums))
        last, total = int(keys[-1]), int(sums[-1])
        keys, sums = keys[:-1], sums[:-1]
        enough = sums >= least
        if enough.any():
            yield pa.RecordBatch.from_arrays([pa.array(keys[enough]), pa.array(sums[enough])], names=["pair", "n"])
    if last is not None and total >= least:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([total], pa.int64())], names=["pair", "n"])


def odds_ratio(both: Column, a: Column, b: Column, n: Column) -> Column:
    """Odds of b with a against b without a; 0.5 is added to each cell, so no cell is empty."""
    half = F.lit(0.5)
    return ((both + half) * (n - a - b + both + half)) / ((a - both + half) * (b - both + half))


def together(rows: DataFrame, basket: str, item: str, min_size: int = 2, max_size: int = 300, min_count: int = 5) -> DataFrame:
    """Pairs of items in at least ``min_count`` common baskets, with counts and how far above chance.

    Result: item_a, item_b (item_a < item_b), n_ab, n_a, n_b, n_baskets, lift, odds_ratio. A
    basket is the set of its distinct items; null and '' are no items and no baskets. Baskets
    with fewer than ``min_size`` or more than ``max_size`` items do not count at all, also not
    in n_a, n_b and n_baskets. An empty table gives an empty result.
    """
    inside = bounded_baskets(rows, basket, item, min_size, max_size)  # cheap to read again: distinct rows are written once
    # an item in fewer baskets than min_count is in no counted pair: leaving it out is exact
    frequent = numbered(inside.groupBy("item").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count), most=1 << 31)
    n_baskets = inside.agg(F.count_distinct("basket").alias("n_baskets"))
    baskets = (
        inside.join(frequent.select("item", "code"), "item").groupBy("basket").agg(F.collect_list("code").alias("codes")).filter(F.size("codes") > 1)
    )
    runs = baskets.select("codes").mapInArrow(_pair_runs, "pair long, n long")
    pairs = runs.repartition("pair").sortWithinPartitions("pair").mapInArrow(lambda b: _merged(b, min_count), "pair long, n long")
    a = frequent.select(F.col("code").alias("code_a"), F.col("item").alias("x"), F.col("n").alias("n_x"))
    b = frequent.select(F.col("code").alias("code_b"), F.col("item").alias("y"), F.col("n").alias("n_y"))
    found = (
        pairs.select(F.shiftright("pair", 32).alias("code_a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("code_b"), F.col("n").alias("n_ab"))
        .join(a.hint("merge"), "code_a")  # neither side has a size bound: no broadcast, also not at run time
        .join(b.hint("merge"), "code_b")
    )
    swap = F.col("x") > F.col("y")
    counted = found.select(
        F.least("x", "y").alias("item_a"),
        F.greatest("x", "y").alias("item_b"),
        "n_ab",
        F.when(swap, F.col("n_y")).otherwise(F.col("n_x")).alias("n_a"),
        F.when(swap, F.col("n_x")).otherwise(F.col("n_y")).alias("n_b"),
        n_baskets.scalar().alias("n_baskets"),
    )
    lift = F.col("n_ab") * F.col("n_baskets") / (F.col("n_a") * F.col("n_b"))
    return counted.withColumns({"lift": lift, "odds_ratio": odds_ratio(F.col("n_ab"), F.col("n_a"), F.col("n_b"), F.col("n_baskets"))})
