"""First-seen semantics, positions and numbering on tables with an explicit order column."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.tables import cut_lineage

#: Range of the order column that one task ranks; a larger group is ranked range by range.
RANGE = 1_000_000
_COUNTED = re.compile(r"(.*) \(([2-9]|[1-9]\d+)\)", re.DOTALL)


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join in which null keys are equal; the key columns are those of ``left``."""
    renamed = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = [left[k].eqNullSafe(renamed[f"_k{i}"]) for i, k in enumerate(keys)]
    joined = left.join(renamed, same, how)
    return joined.drop(*[f"_k{i}" for i in range(len(keys))])


def first_seen(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row per key: the one with the smallest ``seq``. Partial aggregates, no sort."""
    rest = F.struct(*[c for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(F.min_by(rest, seq).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def position_in_group(df: DataFrame, group: list[str], seq: str, name: str = "place", span: int = RANGE, differs: str | None = None) -> DataFrame:
    """``df`` with the 1-based place of every row in its group by ``seq`` (whole numbers, unique in the group). Null is a group too.

    Places within a range of ``seq`` come from one window, the counts of earlier ranges are
    added: no task sorts more of a group than ``span`` rows. With ``differs`` there is a column
    ``_mixed`` too: whether the group has different values of that column.
    """
    placed = df.withColumns({"_group": F.to_json(F.struct(*group)), "_range": F.floor(F.col(seq) / span)})
    ends = [F.min(differs).alias("_low"), F.max(differs).alias("_high")] if differs else []
    counts = placed.groupBy("_group", "_range").agg(F.count("*").alias("_n"), *ends)
    whole = W.partitionBy("_group")
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    mixed = [(F.min("_low").over(whole) != F.max("_high").over(whole)).alias("_mixed")] if differs else []
    counts = counts.select("_group", "_range", before.alias("_before"), *mixed)
    own = F.row_number().over(W.partitionBy("_group", "_range").orderBy(seq))
    ranked = placed.withColumn("_own", own).join(counts, ["_group", "_range"])
    return ranked.withColumn(name, F.col("_before") + F.col("_own")).drop("_group", "_range", "_own", "_before")


def numbered(df: DataFrame, order: list[Column] | None = None, most: int | None = None) -> DataFrame:
    """``df`` with ``code``: 0, 1, 2 ... without gaps, in ``order`` where it is given.

    Rows are written once, range-partitioned by ``order``, so numbers stay the same when a
    task runs again; the driver sees one count per partition. More than ``most`` rows are an error.
    """
    fixed = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df)
    at = F.monotonically_increasing_id()
    placed = fixed.withColumn("_part", F.shiftright(at, 33).cast("int")).withColumn("_place", at.bitwiseAND(F.lit((1 << 33) - 1)))
    counts = dict(placed.groupBy("_part").count().collect())
    starts, total = [], 0
    for p in range(max(counts, default=0) + 1):
        starts.append(total)
        total += counts.get(p, 0)
    if most is not None and total > most:
        raise ValueError(f"{total} rows cannot be numbered below {most}")
    offset = F.get(F.array(*[F.lit(s).cast("long") for s in starts]), F.col("_part"))
    return placed.withColumn("code", offset + F.col("_place")).drop("_part", "_place")


def batches(df: DataFrame, order: list[Column], size: int) -> DataFrame:
    """``df`` with ``batch``: 0 for the first ``size`` rows in ``order``, 1 for the next, and so on."""
    return numbered(df, order).withColumn("batch", F.floor(F.col("code") / size)).drop("code")


def upsert(old: DataFrame, new: DataFrame, key: str, seq: str) -> DataFrame:
    """Rows of ``old`` with those of ``new`` put in their places; unknown keys are appended.

    Keys are unique on each side. ``place`` orders the result: old rows keep their ``seq``,
    appended ones follow by their own.
    """
    columns = [c for c in old.columns if c not in (key, seq)]
    joined = old.select(key, F.struct(seq, *columns).alias("o")).join(new.select(key, F.struct(seq, *columns).alias("n")), key, "full")
    last = old.agg(F.coalesce(F.max(seq), F.lit(0)).alias("last")).scalar()
    place = F.coalesce(F.col(f"o.{seq}"), last + 1 + F.col(f"n.{seq}"))
    known = F.col("n").isNotNull()
    return joined.select(key, place.alias("place"), *[F.when(known, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns])


def _suffixed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Names of colliding families, which come one after another and in order: the first keeps
    its name, later ones count up. Of the current family only its different bases are held: a
    counted name is taken if its base has counted beyond it, any other if it was given as it is."""
    family, given, free = None, set(), {}

    def taken(name: str) -> bool:
        counted = _COUNTED.fullmatch(name)
        return name in given or (counted is not None and int(counted[2]) < free.get(counted[1], 2))

    for frame in frames:
        out = []
        for key, base, ext in zip(frame["_family"], frame["_base"], frame["_ext"], strict=True):
            if key != family:
                family, given, free = key, set(), {}
            low, n = base.lower(), 2
            if not taken(low):
                given.add(low)
                out.append(f"{base}{ext}")
                continue
            n = free.get(low, 2)  # all counters of a base below this one are taken, so it never falls
            while taken(f"{low} ({n})"):
                n += 1
            free[low] = n + 1
            out.append(f"{base} ({n}){ext}")
        yield pd.DataFrame({"_seq": frame["_seq"], "unique_name": out})


def unique_names(df: DataFrame, folder: list[str], base: Column, ext: Column, seq: str) -> DataFrame:
    """``df`` with ``unique_name``: base + ext, with `` (2)``, `` (3)`` where a folder has it already.

    Case does not count. Names can only collide within a family: same folder, same base
    without counters, same extension. Ranks and whether a family is of one name come from one
    pass; only a family that holds several bases (a name that already ends in a counter) is
    walked in order, as a stream that holds its different bases.
    """
    low = F.lower(base)
    rows = df.withColumns({"_base": base, "_ext": ext, "_seq": F.col(seq), "_root": F.regexp_replace(low, r"(?: \(\d+\))+$", ""), "_lowext": F.lower(ext), "_lowbase": low})
    family = [*folder, "_root", "_lowext"]
    ranked = cut_lineage(position_in_group(rows, family, "_seq", "_rank", differs="_lowbase"))
    name = F.when(F.col("_rank") == 1, F.concat("_base", "_ext")).otherwise(F.concat("_base", F.lit(" ("), F.col("_rank").cast("string"), F.lit(")"), "_ext"))
    out = ranked.filter(~F.col("_mixed")).withColumn("unique_name", name)
    held = ranked.filter("_mixed")
    if not held.isEmpty():
        one = held.select(F.to_json(F.struct(*family)).alias("_family"), "_seq", "_base", "_ext")
        walked = one.repartition("_family").sortWithinPartitions("_family", "_seq").mapInPandas(_suffixed, "_seq long, unique_name string")
        out = out.unionByName(held.join(walked, "_seq"))
    return out.drop("_base", "_ext", "_seq", "_root", "_lowbase", "_lowext", "_rank", "_mixed")
