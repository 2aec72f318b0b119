"""Problem 6: one surviving record per group of duplicates, field by field.

Rows are grouped by connected components over equal ids and equal (first act, title). Each
field then comes from the row that deserves most trust for it. Where that is the latest row,
rows without a timestamp are placed by currency reasoning: from groups with timestamps it is
learned which states of a value tend to come before which, directly or through other states; a
row without one stands after every dated row of its group whose state comes before its own,
rows without a time stand in topological order, and the latest row wins. A value that stands
in a dated row of the group too has that row's time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut_lineage
from .components import connected_components
from .names import acts
from .plain_text import plain_batch
from .titles import parse_title


def _named(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        titles = plain_batch(pa.array(f["title"].fillna(""), pa.string()))[0].to_pylist()
        credits = plain_batch(pa.array(f["act"].fillna(""), pa.string()))[0].to_pylist()
        keys = []
        for title, credit in zip(titles, credits, strict=True):
            words, version = parse_title(title)
            who = acts(credit)
            keys.append(f"n:{' '.join(who[0].casefold().split())}|{' '.join(words)}|{' '.join(version)}" if words and who else None)
        yield f[["title", "act"]].assign(key=keys)


def grouped(rows: DataFrame) -> DataFrame:
    """``rows`` (row, track, title, act, ...) with ``component``: equal for rows of one recording.

    Rows are linked by equal non-blank track, and by equal first act and title without case,
    character forms, editions and guests. A row with neither is alone.
    """
    names = rows.select("title", "act").distinct().repartition("title", "act").mapInPandas(_named, "title string, act string, key string")
    names = cut_lineage(names.filter(F.col("key").isNotNull()))
    keyed = rows.join(names, rows["title"].eqNullSafe(names["title"]) & rows["act"].eqNullSafe(names["act"]), "left").drop(names["title"]).drop(names["act"])
    track = F.when(F.trim("track") != "", F.concat(F.lit("t:"), F.trim("track")))
    keyed = keyed.withColumn("node", F.coalesce(track, "key", F.concat(F.lit("r:"), F.col("row").cast("string"))))
    edges = keyed.filter(F.col("node").startswith("t:") & F.col("key").isNotNull()).select("node", "key").distinct()
    found = connected_components(edges, "node", "key")
    return keyed.drop("key").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")).drop("node")


def precedence(rows: DataFrame) -> DataFrame:
    """(earlier, later, margin): states of which the first comes before the second in more groups than after.

    ``rows`` has component, state, at; states take few different values, times may be null.
    """
    seen = rows.filter(F.col("at").isNotNull() & F.col("state").isNotNull()).groupBy("component", "state").agg(F.min("at").alias("first"))
    other = seen.select("component", F.col("state").alias("later"), F.col("first").alias("second"))
    steps = seen.join(other, "component").filter(F.col("first") < F.col("second")).groupBy(F.col("state").alias("earlier"), "later").agg(F.count("*").alias("n"))
    back = steps.select(F.col("earlier").alias("later"), F.col("later").alias("earlier"), F.col("n").alias("m"))
    margin = (F.col("n") - F.coalesce("m", F.lit(0))).alias("margin")
    return steps.join(back, ["earlier", "later"], "left").select("earlier", "later", margin).filter("margin > 0")


def closed(learned: list[tuple[str, str, int]]) -> set[tuple[str, str]]:
    """The transitive closure of (earlier, later, margin), a partial order.

    Pairs count by falling margin; one that contradicts the order of those before it is left out.
    """
    order: set[tuple[str, str]] = set()
    for earlier, later, _ in sorted(learned, key=lambda x: (-x[2], x[0], x[1])):
        if (later, earlier) not in order:
            before = {earlier} | {a for a, b in order if b == earlier}
            after = {later} | {b for a, b in order if a == later}
            order |= {(a, b) for a in before for b in after}
    return order


def placed(rows: DataFrame, value: str | None = None) -> DataFrame:
    """``rows`` (component, state, at, ...) with ``currency``, by which later rows come last.

    A dated row has its time. A row without stands with the latest dated row of its group that
    has the same ``value``, where that column is named, or, if it is later, right behind the latest dated row whose
    state precedes its own; before all others if there is none. Of rows without a time at one
    place, those with more states before their own, among such rows of the group, come later:
    a topological order. States without a learned order stand alike.
    """
    if rows.filter(F.col("at").isNull()).isEmpty():  # every row has its place: there is nothing to learn
        return rows.withColumn("currency", F.struct("at", F.lit(0).alias("behind")))
    pairs = [tuple(r) for r in precedence(rows).collect()]  # states are few
    order = rows.sparkSession.createDataFrame(sorted(closed(pairs)), "earlier string, later string")
    last = rows.filter(F.col("at").isNotNull() & F.col("state").isNotNull()).groupBy("component", "state").agg(F.max("at").alias("last"))
    undated = rows.filter(F.col("at").isNull() & F.col("state").isNotNull()).select("component", "state").distinct()
    # per undated state of a group the states before it, with their last time if they have one there and whether a row without stands there
    here = last.withColumn("undated", F.lit(0)).unionByName(undated.withColumns({"last": F.lit(None).cast(last.schema["last"].dataType), "undated": F.lit(1)}))
    earlier = here.groupBy("component", F.col("state").alias("earlier")).agg(F.max("last").alias("last"), F.max("undated").alias("undated"))
    behind = undated.withColumnRenamed("state", "later").join(order, "later").join(earlier, ["component", "earlier"])
    behind = behind.groupBy("component", F.col("later").alias("state")).agg(F.max("last").alias("behind"), F.sum("undated").cast("int").alias("rank"))
    joined = rows.join(behind, ["component", "state"], "left").withColumn("same", F.lit(None).cast(rows.schema["at"].dataType))
    if value:
        same = rows.filter(F.col("at").isNotNull() & F.col(value).isNotNull()).groupBy("component", value).agg(F.max("at").alias("same"))
        joined = joined.drop("same").join(same, ["component", value], "left")
    undated_row = F.col("at").isNull()
    when = F.when(undated_row, F.greatest("behind", "same")).otherwise(F.col("at"))
    place = F.when(undated_row, F.coalesce("rank", F.lit(0)) + 1).otherwise(0)
    return joined.withColumn("currency", F.struct(when.alias("at"), place.alias("behind"))).drop("behind", "rank", "same")


def value_state(url: Column, track: Column, score: Column) -> Column:
    """What a row's link and score look like: the states whose order is learned."""
    link = (
        F.when(F.coalesce(F.trim(url), F.lit("")) == "", "no link")
        .when((F.coalesce(track, F.lit("")) != "") & url.contains(track), "whole link")
        .otherwise("broken link")
    )
    return F.concat_ws(", ", link, F.when(score.isNull(), "no score").when(score.between(0, 100), "score").otherwise("wrong score"))


def best_records(
    table: DataFrame, row_id: str, track_id: str, title: str, act: str, popularity: str, url: str, at: str, low: int = 0, high: int = 100
) -> DataFrame:
    """One row per group of rows of one recording, single rows included.

    Result: first_id, n_rows, keeper_id, url_id, and the built record track_id, title,
    act, popularity, spotify_url. The keeper, with the highest popularity from ``low`` to
    ``high``, gives popularity and track_id; ties and groups without such a popularity
    (then null) go to the smaller row_id. The link comes from the keeper if it holds the
    keeper's own whole track_id, else from the latest row whose link holds its own; without
    one url_id and link are null. Title and act come from the keeper, or, where it has
    none, from the smallest row that has one. Whole rows that repeat count once in n_rows.
    Row ids must be unique and whole numbers.
    """
    rows = table.select(
        F.col(row_id).cast("long").alias("row"), F.col(track_id).alias("track"), F.col(title).alias("title"), F.col(act).alias("act"),
        F.col(popularity).alias("score"), F.col(url).alias("url"), F.col(at).alias("at"),
    ).distinct()
    own = (F.coalesce(F.trim("track"), F.lit("")) != "") & F.coalesce(F.col("url").contains(F.trim("track")), F.lit(False))
    score = F.when(F.col("score").between(low, high), F.col("score").cast("long"))
    full = grouped(rows).withColumns({"own": own, "valid": score, "state": value_state(F.col("url"), F.trim("track"), F.col("score"))})
    dated = placed(cut_lineage(full), "url")
    record = F.struct("row", "track", "valid", "own", "url", F.nullif(F.trim("title"), F.lit("")).alias("title"), F.nullif(F.trim("act"), F.lit("")).alias("act"))
    first_of = lambda column: F.min_by(column, F.when(F.coalesce(F.trim(column), F.lit("")) != "", F.col("row")))
    picked = dated.groupBy("component").agg(
        F.min("row").alias("first_id"),
        F.count_distinct("row").alias("n_rows"),
        F.max_by(record, F.struct(F.coalesce("valid", F.lit(-1)), -F.col("row"))).alias("keeper"),
        F.max_by(F.when(F.col("own"), F.struct("row", "url")), F.when(F.col("own"), F.struct("currency", -F.col("row")))).alias("linked"),
        first_of("title").alias("any_title"),
        first_of("act").alias("any_act"),
    )
    from_keeper = F.col("keeper.own")
    return picked.select(
        "first_id", "n_rows", F.col("keeper.row").alias("keeper_id"),
        F.when(from_keeper, F.col("keeper.row")).otherwise(F.col("linked.row")).alias("url_id"),
        F.col("keeper.track").alias("track_id"), F.coalesce("keeper.title", "any_title").alias("title"), F.coalesce("keeper.act", "any_act").alias("act"),
        F.col("keeper.valid").alias("popularity"), F.when(from_keeper, F.col("keeper.url")).otherwise(F.col("linked.url")).alias("spotify_url"),
    )
