"""Two-pass deduplication of tracks into a manifest, with the playlists of all copies kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

KEPT = ["track_name", "artist_names", "album_name", "duration_ms", "explicit", "popularity", "spotify_url"]


def id_dedup(tracks: DataFrame) -> DataFrame:
    """One row per non-blank track_id: the first row's values and its playlists in first-seen order.

    A playlist id counts only with a playlist name that is new to the track; the first row's
    id counts even without a name. Columns: track_id, the kept ones, playlist_names and
    playlist_ids joined by '; ', playlist_count, first_seq.
    """
    rows = tracks.filter(T.text(F.col("track_id")) != "")
    attributes = F.struct(*[F.col(c) for c in KEPT])
    by_name = rows.groupBy("track_id", T.text(F.col("playlist_name")).alias("name")).agg(
        F.min("seq").alias("seq"), F.min_by(T.text(F.col("playlist_id")), "seq").alias("id"), F.min_by(attributes, "seq").alias("row")
    )
    grouped = by_name.groupBy("track_id").agg(
        F.min("seq").alias("first_seq"), F.min_by("row", "seq").alias("row"), F.array_sort(F.collect_list(F.struct("seq", "name", "id"))).alias("seen")
    )
    kept = F.filter("seen", lambda s: (s["name"] != "") | (s["seq"] == F.col("first_seq")))
    names = F.filter(F.transform(kept, lambda s: s["name"]), lambda x: x != "")
    ids = F.filter(F.transform(kept, lambda s: s["id"]), lambda x: x != "")
    return grouped.select(
        "track_id", *[F.col(f"row.{c}").alias(c) for c in KEPT], F.array_join(names, "; ").alias("playlist_names"), F.array_join(ids, "; ").alias("playlist_ids"),
        F.size(names).alias("playlist_count"), "first_seq",
    )


def fuzzy_dedup(deduped: DataFrame) -> DataFrame:
    """One row per primary artist and title: the most popular, the earlier one of equals.

    Playlist names of collapsed rows are united and sorted; ids are the keeper's. ``slot``
    is the first place at which the group was seen.
    """
    keyed = deduped.withColumn("key", T.fuzzy_key(F.col("artist_names"), F.col("track_name")))
    row = F.struct("track_id", *KEPT, "playlist_names", "playlist_ids", "playlist_count", "first_seq")
    grouped = keyed.groupBy("key").agg(
        F.max_by(row, F.struct(F.coalesce("popularity", F.lit(0)), -F.col("first_seq"))).alias("row"),
        F.count("*").alias("n"), F.min("first_seq").alias("slot"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("playlist_names", "; "))))).alias("all_names"),
    )
    names = F.filter("all_names", lambda x: x != "")
    many = F.col("n") > 1
    return grouped.select(
        "row.track_id", *[F.col(f"row.{c}").alias(c) for c in KEPT], F.when(many, F.array_join(names, "; ")).otherwise(F.col("row.playlist_names")).alias("playlist_names"),
        "row.playlist_ids", F.when(many, F.size(names)).otherwise(F.col("row.playlist_count")).alias("playlist_count"), "slot",
    )


def manifest(tracks: DataFrame) -> DataFrame:
    """Both passes; sort by ``sort_title`` and ``slot`` for the manifest's order."""
    return fuzzy_dedup(id_dedup(tracks)).withColumn("sort_title", F.lower(T.text(F.col("track_name"))))
