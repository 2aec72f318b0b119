"""Writers of tables and playlist files. Every write goes through Spark's commit protocol.

A table is a folder of parts. Where an order is given the parts are ranges of it, in the order
of their names, so no task sorts or writes the whole; ``one_file`` is for small reports only.
"""

from __future__ import annotations

import warnings

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.ordering import first_seen
from . import schemas


def _in_parts(rows: DataFrame, order: list[str] | None, one_file: bool) -> DataFrame:
    """``rows``, whatever columns they keep, in ranges of ``order``."""
    if one_file:
        rows = rows.coalesce(1)
        return rows.sortWithinPartitions(*order) if order else rows
    return rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, keep_if_empty: bool = True, order: list[str] | None = None, one_file: bool = False, sep: str = ",") -> bool:
    """CSV with a header and only ``columns``. An empty table writes nothing unless told to; returns whether it wrote."""
    if keep_if_empty and df.isEmpty():
        return False
    rows = _in_parts(df, order, one_file)
    out = (rows.select(*columns) if columns else rows).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("sep", sep)
    out.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return True


def write_urls(df: DataFrame, path: str, url: str = "spotify_url", keep_blank: bool = False, order: str | None = None, one_file: bool = False) -> None:
    """One url per line, blank ones only if asked for, in ``order`` where it is given."""
    text = T.text(F.col(url))
    rows = df if keep_blank else df.filter(T.strip(text) != "")
    _in_parts(rows, [order] if order else None, one_file).select(text.alias("value")).write.mode("overwrite").text(path)


def write_export(rows: DataFrame, path: str, name: str, columns: list[str], order: str, distinct: bool = False, keep_blank: bool = False) -> None:
    """``<name>.csv`` with ``columns`` and ``<name>_urls.txt`` with the links, both in ``order``; ``distinct`` keeps the first of equal links."""
    write_csv(rows, f"{path}/{name}.csv", columns, keep_if_empty=False, order=[order])
    links = rows.select(T.strip(T.text(F.col("spotify_url"))).alias("spotify_url"), order) if distinct else rows
    write_urls(first_seen(links, ["spotify_url"], order) if distinct else links, f"{path}/{name}_urls.txt", keep_blank=keep_blank, order=order)


def write_playlist(tracks: DataFrame, path: str, name: str, order: str = "seq") -> None:
    """One playlist's rows and links; links that are blank stay."""
    write_export(tracks, path, name, schemas.names(schemas.TRACKS), order, keep_blank=True)


def write_manifest(rows: DataFrame, path: str, name: str, order: str) -> None:
    write_export(rows, path, name, schemas.names(schemas.MANIFEST), order)


def write_ranked(albums: DataFrame, path: str) -> DataFrame:
    """Ranked albums and their links; what comes back are the albums without a link, by rank."""
    write_export(albums, path, "albums", schemas.names(schemas.RANKED_ALBUMS), "rank")
    return albums.filter(T.text(F.col("spotify_url")) == "").select("rank", "artist", "title", "year").orderBy("rank")


def write_unmatched(rows: DataFrame, path: str, order: str = "seq") -> None:
    """Unmatched rows and their distinct links, for another try. A target that cannot be written only warns: it is a sidecar."""
    try:
        write_export(rows, path, "unmatched", schemas.UNMATCHED, order, distinct=True)
    except (OSError, PySparkException, Py4JJavaError) as e:
        warnings.warn(f"could not write {path}: {e}", stacklevel=2)


def write_retry(report: DataFrame, path: str, order: str = "place") -> Column:
    """The retry report and its links in report order; what comes back counts the rows with a name."""
    write_export(report, path, "retry", schemas.RETRY_REPORT, order)
    return F.count_if((T.text(F.col("artist")) != "") | (T.text(F.col("track")) != ""))


def append_log(df: DataFrame, path: str, url: str = "url", reason: str = "reason") -> None:
    """Lines ``url  # reason`` added to a failure log."""
    line = F.when(T.text(F.col(reason)) != "", F.concat(F.col(url), F.lit("  # "), F.col(reason))).otherwise(F.col(url))
    df.select(line.alias("value")).write.mode("append").text(path)


def write_catalog(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_playlists(lines: DataFrame, path: str, playlist: str, name: str) -> None:
    """One folder per playlist below ``path``, with its lines in order behind the header.

    ``lines`` has the columns ``playlist``, ``name``, seq, part and line. Of playlists with
    equal safe names the one that begins last counts. Playlists are written side by side; one
    playlist is one file.
    """
    stems = lines.select(T.safe_name(F.col(name)).alias("stem"), F.col(playlist).alias("_id"), "seq", "part", "line")
    begins = stems.groupBy("stem", "_id").agg(F.min("seq").alias("begin"))
    last = begins.groupBy("stem").agg(F.max_by("_id", F.struct("begin", "_id")).alias("_id"))
    head = last.select("stem", F.lit(-1).cast("long").alias("seq"), F.lit(0).alias("part"), F.lit("#EXTM3U").alias("line"))
    rows = stems.join(last, ["stem", "_id"], "left_semi").select("stem", "seq", "part", "line").unionByName(head)
    ordered = rows.repartition("stem").sortWithinPartitions("stem", "seq", "part")
    ordered.select("stem", F.col("line").alias("value")).write.mode("overwrite").partitionBy("stem").text(path)
