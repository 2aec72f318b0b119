"""Tiered linkage of track rows to a catalogue, nearest length first.

One equi-join on the title serves three tiers; the others join on other keys. The best
candidate of a row is a minimum over (tier, how well the length fits, catalogue order), so
no window or sort is needed and candidates are combined before they are shuffled.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import cut_lineage

# Tiers and the least likeness of the fuzzy tier.
TIERS = {1: "title+primary", 2: "title+artist", 3: "title+album", 4: "core-title", 5: "fuzzy", 6: "raw-title", 7: "album+track"}
LEAST_RATIO = 0.92
#: Letters of the runs by which like titles meet, and titles of one run that one task holds of a side.
GRAM, BLOCK = 3, 2000
QUERY = ["track_name", "artist_names", "album_name", "duration_ms", "track_number"]


def catalog(library: DataFrame) -> DataFrame:
    """The catalogue's match keys: one row per file, ``seq`` is its order."""
    names = F.array_distinct(F.transform(F.concat(T.split_artists(F.col("artist")), T.split_artists(F.col("albumartist"))), T.norm_key))
    artist = F.when(T.text(F.col("artist")) != "", F.col("artist")).otherwise(F.col("albumartist"))
    return library.select(
        F.col("file_id").alias("seq"), "path", T.norm_key(F.col("title")).alias("nt"), T.norm_key(T.core_title(F.col("title"))).alias("core"),
        T.raw_key(F.col("title")).alias("raw"), T.norm_key(F.col("album")).alias("c_album"), T.track_int(F.col("track")).alias("c_track"),
        F.filter(names, lambda x: x != "").alias("c_artists"), T.norm_key(T.primary_artist(artist)).alias("c_primary"),
        F.coalesce(F.col("length"), F.lit(0.0)).alias("length"),
    )


def queries(rows: DataFrame) -> DataFrame:
    """The match keys of distinct queries; ``query`` names each."""
    distinct = rows.select(F.to_json(F.struct(*QUERY)).alias("query"), *QUERY).distinct()
    nt = T.norm_key(F.col("track_name"))
    core = T.norm_key(T.core_title(F.col("track_name")))
    return distinct.select(
        "query", nt.alias("nt"), F.when(core != "", core).otherwise(nt).alias("core"), T.raw_key(F.col("track_name")).alias("raw"),
        F.array_distinct(F.transform(T.split_artists(F.col("artist_names")), T.norm_key)).alias("artists"), T.norm_key(T.primary_artist(F.col("artist_names"))).alias("primary"),
        T.norm_key(F.col("album_name")).alias("album"), T.track_int(F.col("track_number")).alias("track"), T.seconds_of_ms(F.col("duration_ms")).alias("want"),
        ((T.text(F.col("track_name")) == "") & (T.text(F.col("artist_names")) == "")).alias("empty"),
    )


def _best(found: DataFrame) -> DataFrame:
    """Per query its best candidate; ``fit`` orders the candidates of a tier."""
    return found.groupBy("query").agg(F.min(F.struct("tier", "fit", "seq", "path")).alias("best")).select("query", "best.tier", "best.seq", "best.path")


def _fit(tolerance: Column) -> Column:
    """Within the tolerance first, then the smaller gap; equal for all if the query has no length."""
    gap = F.abs(F.col("length") - F.col("want"))
    outside = ~((F.col("length") == 0) | (gap <= tolerance))
    none = F.struct(F.lit(0).alias("outside"), F.lit(0.0).alias("gap"))
    return F.when(F.col("want") == 0, none).otherwise(F.struct(outside.cast("int").alias("outside"), gap.alias("gap")))


def exact_matches(q: DataFrame, c: DataFrame) -> DataFrame:
    """(query, tier, seq, path) of the best candidate without the fuzzy tier."""
    shared = F.arrays_overlap("artists", "c_artists")
    with_title = q.filter("nt <> '' and not empty").join(c.filter("nt <> ''").drop("core", "raw"), "nt")
    first = (F.col("primary") != "") & (F.array_contains("c_artists", F.col("primary")) | (F.col("primary") == F.col("c_primary")) | F.array_contains("artists", F.col("c_primary")))
    tier = F.when(first, 1).when((F.size("artists") > 0) & shared, 2).when((F.col("album") != "") & (F.col("album") == F.col("c_album")), 3)
    by_title = with_title.withColumn("tier", tier).filter("tier is not null").select("query", "tier", _fit(F.when(F.col("tier") == 3, 3).otherwise(5)).alias("fit"), "seq", "path")
    cores = c.filter("core <> '' and core <> nt").drop("nt", "raw")
    by_core = q.filter("nt <> '' and not empty").join(cores, "core").filter((F.size("artists") > 0) & (shared | (F.col("primary") == F.col("c_primary"))))
    by_core = by_core.select("query", F.lit(4).alias("tier"), _fit(F.lit(5)).alias("fit"), "seq", "path")
    symbols = q.filter("nt = '' and not empty")
    gap = F.when(F.col("want") != 0, F.abs(F.col("length") - F.col("want"))).otherwise(F.lit(0.0))
    near = F.struct(F.lit(0).alias("outside"), gap.alias("gap"))
    anchored = ((F.size("artists") > 0) & (shared | (F.col("primary") == F.col("c_primary")))) | ((F.col("album") != "") & (F.col("c_album") == F.col("album")))
    by_raw = symbols.filter("raw <> ''").join(c.filter("raw <> ''").drop("nt", "core"), "raw").filter(anchored)
    by_raw = by_raw.select("query", F.lit(6).alias("tier"), near.alias("fit"), "seq", "path")
    placed = symbols.filter("album <> '' and track is not null").join(
        c.filter("c_album <> '' and c_track is not null"), (F.col("album") == F.col("c_album")) & (F.col("track") == F.col("c_track"))
    )
    by_place = placed.filter(T.duration_ok(F.col("want"), F.col("length"), 5)).select("query", F.lit(7).alias("tier"), near.alias("fit"), "seq", "path")
    return _best(by_title.unionByName(by_core).unionByName(by_raw).unionByName(by_place))


def letter_counts(words: pd.Series) -> np.ndarray:
    """How often each of the 36 letters and digits stands in each word."""
    out = np.zeros((len(words), 128), np.int32)
    joined = np.frombuffer("".join(words).encode("ascii"), np.uint8)
    np.add.at(out, (np.repeat(np.arange(len(words)), words.str.len()), joined), 1)
    return out


def _ratios(local: pd.Series, query: pd.Series) -> pd.Series:
    """The matching-blocks ratio; 0 where the letters alone show that it stays below LEAST_RATIO."""
    bound = 2 * np.minimum(letter_counts(local), letter_counts(query)).sum(axis=1) / np.maximum(local.str.len() + query.str.len(), 1)
    out = np.zeros(len(local))
    for i in np.flatnonzero(bound >= LEAST_RATIO):
        out[i] = SequenceMatcher(None, local.iat[i], query.iat[i]).ratio()
    return pd.Series(out)


def _grams(rest: Column) -> Column:
    """The runs of GRAM characters of ``rest`` with marked ends, in order; the n-th equal one is numbered n."""
    ends = "#" * (GRAM - 1)
    text = F.concat(F.lit(ends), rest, F.lit(ends))
    runs = F.array_sort(F.transform(F.sequence(F.lit(1), F.length(rest) + GRAM - 1), lambda i: F.substring(text, i, F.lit(GRAM))))
    return F.transform(runs, lambda g, i: F.concat(g, (i + 1 - F.array_position(runs, g)).cast("string")))


def like_titles(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """(q_nt, c_nt) of the distinct titles that can reach LEAST_RATIO; with equal first four letters.

    Titles of ratio r differ by at most (1 - r) of their joint length in insertions and
    deletions, which is D = 4/23 of one title's length for 0.92, and each of these touches GRAM
    runs of letters. So two such titles share one of their GRAM * D + 1 rarest runs, whatever
    the order, and are met there and nowhere else; a title too short for any difference is met
    as a whole. The first four letters, which all titles of a prefix have, are in no run. Runs
    that many titles have are grids of tasks.
    """
    titles = mine.select(F.lit(0).alias("side"), F.col("q_nt").alias("nt")).unionByName(theirs.select(F.lit(1).alias("side"), F.col("c_nt").alias("nt")))
    most = F.floor(F.length("nt") * 4 / 23)
    rest = F.expr("substring(nt, 5)")
    runs = F.when(most == 0, F.array(F.concat(F.lit("="), rest))).otherwise(_grams(rest))
    long = titles.select("side", "nt", T.prefix4(F.col("nt")).alias("prefix"), F.explode(runs).alias("run"))
    counts = long.groupBy("prefix", "run").agg(F.count_if(F.col("side") == 0).alias("n_left"), F.count_if(F.col("side") == 1).alias("n_right"))
    met = F.struct((F.col("n_left") * F.col("n_right")).alias("cost"), "run", "n_left", "n_right")
    per_title = long.join(counts, ["prefix", "run"]).groupBy("side", "nt", "prefix").agg(F.array_sort(F.collect_list(met)).alias("runs"))
    rarest = cut_lineage(per_title.select("side", "nt", "prefix", F.explode(F.slice("runs", F.lit(1), (GRAM * most + 1).cast("int"))).alias("r")).filter("r.cost > 0"))
    parts = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    placed = rarest.select("side", "nt", "prefix", "r.run", parts("r.n_left").alias("rows"), parts("r.n_right").alias("columns"))
    own = lambda n: F.pmod(F.xxhash64("nt"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.filter("side = 0").select("prefix", "run", F.col("nt").alias("q_nt"), own("rows").alias("row"), every("columns").alias("column"))
    right = placed.filter("side = 1").select("prefix", "run", F.col("nt").alias("c_nt"), own("columns").alias("column"), every("rows").alias("row"))
    a, b = F.length("q_nt"), F.length("c_nt")
    pairs = left.join(right, ["prefix", "run", "row", "column"]).filter(2 * F.least(a, b) >= LEAST_RATIO * (a + b))
    return pairs.select("q_nt", "c_nt").distinct()


def fuzzy_matches(q: DataFrame, c: DataFrame) -> DataFrame:
    """(query, tier, seq, path): titles with the same first four letters and a like spelling.

    Distinct titles are compared, not rows, and only those that share a rare run of letters.
    """
    ratio = F.pandas_udf(_ratios, "double")
    pairs = like_titles(q.filter("nt <> '' and not empty").select(F.col("nt").alias("q_nt")).distinct(), c.filter("nt <> ''").select(F.col("nt").alias("c_nt")).distinct())
    like = pairs.withColumn("ratio", ratio("c_nt", "q_nt")).filter(F.col("ratio") >= LEAST_RATIO).select("q_nt", "c_nt", "ratio")
    rows = q.filter("not empty").join(like, F.col("nt") == F.col("q_nt")).drop("nt", "core", "raw").join(c.drop("core", "raw"), F.col("c_nt") == c["nt"])
    near = rows.filter(T.duration_ok(F.col("want"), F.col("length"), 3))
    fit = F.struct(F.lit(0).alias("outside"), (-F.col("ratio")).alias("gap"))
    return _best(near.select("query", F.lit(5).alias("tier"), fit.alias("fit"), "seq", "path"))


def match_rows(tracks: DataFrame, library: DataFrame, fuzzy: bool = True) -> DataFrame:
    """(seq, playlist_id, track_id, tier, file_id, path) of every row.

    Within a playlist all rows of a track id get the match of its first row. Distinct
    queries are matched once and joined back.
    """
    rows = tracks.select("seq", T.text(F.col("playlist_id")).alias("playlist_id"), T.text(F.col("track_id")).alias("track_id"), F.to_json(F.struct(*QUERY)).alias("query"), *QUERY)
    first = rows.filter("track_id <> ''").groupBy("playlist_id", "track_id").agg(F.min_by("query", "seq").alias("first_query"))
    keyed = rows.select("seq", "playlist_id", "track_id", "query").join(first, ["playlist_id", "track_id"], "left").withColumn("query", F.coalesce("first_query", "query")).drop("first_query")
    q, c = cut_lineage(queries(rows)), cut_lineage(catalog(library))  # each is read by every tier
    found = cut_lineage(exact_matches(q, c))
    if fuzzy:
        found = found.unionByName(fuzzy_matches(cut_lineage(q.join(found, "query", "left_anti")), c))
    empty = q.filter("empty").select("query", F.lit(True).alias("empty"))
    out = keyed.join(found, "query", "left").join(empty, "query", "left")
    label = F.coalesce(*[F.when(F.col("tier") == k, v) for k, v in TIERS.items()], F.when(F.col("empty"), "local-no-meta"), F.lit("unmatched"))
    return out.select(keyed["seq"], "playlist_id", "track_id", label.alias("tier"), found["seq"].alias("file_id"), "path")


def match_summary(matches: DataFrame) -> DataFrame:
    """Rows and matched rows per playlist and, with a null playlist, in all."""
    return matches.rollup("playlist_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("file_id").isNotNull()).alias("n_matched"))
