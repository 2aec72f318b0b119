"""What is on disk already, what failed, and what to try again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .ordering import numbered


def library_stems(paths: DataFrame, path: str, root: str = "singles", recursive: bool = False) -> DataFrame:
    """(stem_key) of the audio files right under ``root``, or anywhere below it."""
    p = T.normal_path(F.col(path))
    inside = p.startswith(root + "/") if recursive else T.dirname(p) == root
    return paths.filter(inside & T.is_audio(p)).select(T.unicode_normalize(T.stem(p)).alias("stem_key")).distinct()


def predicted_stem(artists: str, title: str, extension: str = "mp3"):
    return T.unicode_normalize(T.stem(T.predicted_filename(F.col(artists), F.col(title), extension)))


def on_disk(tracks: DataFrame, stems: DataFrame, artists: str, title: str) -> DataFrame:
    """Tracks whose predicted file name is there; ``missing`` gives the others."""
    return tracks.withColumn("stem_key", predicted_stem(artists, title)).join(stems, "stem_key", "left_semi")


def missing(tracks: DataFrame, stems: DataFrame, artists: str, title: str) -> DataFrame:
    return tracks.withColumn("stem_key", predicted_stem(artists, title)).join(stems, "stem_key", "left_anti")


def failure_log(lines: DataFrame, line: str, seq: str) -> DataFrame:
    """(url, reason, seq) of the lines that are ``url`` or ``url  # reason``."""
    parsed = lines.select(T.log_url(F.col(line)).alias("url"), T.log_reason(F.col(line)).alias("reason"), F.col(seq).alias("seq"))
    return parsed.filter("url <> ''")


def reason_union(log: DataFrame) -> DataFrame:
    """(url, reasons, first_seq): the different reasons of every url in first-seen order."""
    by_reason = log.groupBy("url", "reason").agg(F.min("seq").alias("seq"))
    grouped = by_reason.groupBy("url").agg(F.min("seq").alias("first_seq"), F.array_sort(F.collect_list(F.struct("seq", "reason"))).alias("seen"))
    reasons = F.filter(F.transform("seen", lambda s: s["reason"]), lambda r: r != "")
    return grouped.select("url", reasons.alias("reasons"), "first_seq")


def metadata_of(tracks: DataFrame) -> DataFrame:
    """(url, artist, track, album): the first row of every non-blank url."""
    strip = lambda c: T.strip(T.text(F.col(c)))
    rows = tracks.select(strip("spotify_url").alias("url"), strip("artist_names").alias("artist"), strip("track_name").alias("track"), strip("album_name").alias("album"), "seq")
    row = F.min_by(F.struct("artist", "track", "album"), "seq").alias("row")
    return rows.filter("url <> ''").groupBy("url").agg(row).select("url", "row.*")


def retry_split(failures: DataFrame, metadata: DataFrame, stems: DataFrame, include_unavailable: bool = False) -> DataFrame:
    """(url, reasons, first_seq, artist, track, album, state) of every failed url.

    ``state`` is 'on_disk', 'retry' or 'no_metadata' (tried again as well); urls that are
    gone for good are left out unless asked for.
    """
    rows = failures if include_unavailable else failures.filter(~F.array_contains("reasons", "track_unavailable"))
    named = rows.join(metadata, "url", "left").fillna("", ["artist", "track", "album"])
    held = named.withColumn("stem_key", predicted_stem("artist", "track")).join(stems.withColumn("there", F.lit(True)), "stem_key", "left")
    state = F.when((F.col("artist") == "") | (F.col("track") == ""), "no_metadata").when(F.col("there"), "on_disk").otherwise("retry")
    return held.select("url", "reasons", "first_seq", "artist", "track", "album", state.alias("state"))


def retry_report(split: DataFrame) -> DataFrame:
    """The rows to try again, with a search link and their ``place``: rows with an artist first, then by artist, album and track without case."""
    rows = split.filter("state <> 'on_disk'").select(
        "artist", "track", "album", F.array_join("reasons", ", ").alias("reason"), F.col("url").alias("spotify_url"), T.search_url(F.col("artist"), F.col("track")).alias("search"),
        (F.col("artist") == "").alias("no_artist"), F.col("first_seq"),
    )
    order = [F.col("no_artist"), F.lower("artist"), F.lower("album"), F.lower("track"), F.col("first_seq")]
    return numbered(rows, order).withColumnRenamed("code", "place")
