"""Readers of the files that a library is made of. A missing file is an empty table."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text as T
from ..operators.ordering import first_seen

#: Characters of the header from which the separator is guessed.
SNIFFED = 1024


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_csv(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",") -> DataFrame:
    """A CSV table with a header: quoted line breaks, doubled quotes and backslashes are text."""
    if not _there(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("sep", sep).csv(path)


def read_tsv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Tab-separated rows without a header, as the library tool lists them."""
    if not _there(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").csv(path)


def sniffed(spark: SparkSession, path: str) -> tuple[str, list[str]]:
    """The separator and the stripped header names of a CSV file, from its first line."""
    line = spark.read.text(path, wholetext=False).limit(1).collect()
    head = line[0][0] if line else ""
    try:
        sep = csv.Sniffer().sniff(head[:SNIFFED], delimiters=",;\t|").delimiter
    except csv.Error:
        sep = ","
    return sep, [name.strip().lstrip("﻿") for name in next(csv.reader([head], delimiter=sep), [])]


def file_order():
    """The place of a row over all files of a read: file name, block of the file, row of the block."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def _csv_columns(spark: SparkSession, path: str, wanted: list[str], needed: set[str]) -> DataFrame | None:
    """``wanted`` as stripped text ('' where the file lacks a column) and ``at``; None without the ``needed`` columns."""
    sep, names = sniffed(spark, path)
    if not needed <= set(names):
        return None
    schema = StructType([StructField(f"c{i}", StringType()) for i in range(len(names))])
    rows = read_csv(spark, path, schema, sep)
    cells = [(T.strip(T.text(F.col(f"c{names.index(c)}"))) if c in names else F.lit("")).alias(c) for c in wanted]
    return rows.select(*cells, file_order().alias("at"))


def read_metadata(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(url, artist, track, album) of CSV files of any separator, in order of their names; the first row of a url counts.

    A file without the columns track_name and artist_names counts as empty.
    """
    out = spark.createDataFrame([], "url string, artist string, track string, album string, seq struct<n:int,at:struct<file:string,block:bigint,row:bigint>>")
    for n, path in enumerate(sorted(p for p in paths if _there(spark, p))):
        rows = _csv_columns(spark, path, ["spotify_url", "artist_names", "track_name", "album_name"], {"track_name", "artist_names"})
        if rows is not None:
            rows = rows.withColumnsRenamed({"spotify_url": "url", "artist_names": "artist", "track_name": "track", "album_name": "album"})
            out = out.unionByName(rows.withColumn("seq", F.struct(F.lit(n).alias("n"), "at")).drop("at"))
    return first_seen(out.filter("url <> ''"), ["url"], "seq").select("url", "artist", "track", "album")


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """(url, seq): the lines of a text file, or the spotify_url column of a CSV file; blank ones dropped, the first of equal ones kept. ``seq`` orders them."""
    if not _there(spark, path):
        return spark.createDataFrame([], "url string, seq struct<file:string,block:bigint,row:bigint>")
    if path.lower().endswith(".csv"):
        rows = _csv_columns(spark, path, ["spotify_url"], {"spotify_url"})
        if rows is None:
            return spark.createDataFrame([], "url string, seq struct<file:string,block:bigint,row:bigint>")
        lines = rows.select(F.col("spotify_url").alias("url"), F.col("at").alias("seq"))
    else:
        lines = spark.read.text(path).select(T.strip(T.text(F.col("value"))).alias("url"), file_order().alias("seq"))
    return first_seen(lines.filter("url <> ''"), ["url"], "seq")


#: Fixed value: the file of a folder that is read instead of all its CSV files.
MANIFEST_FILE = "spotify_manifest.csv"


def read_source(spark: SparkSession, path: str) -> DataFrame:
    """(url, seq) of what a path names: of a folder its manifest, or else all its CSV files by name; of a file as ``read_urls``."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise FileNotFoundError(path)
    if path.lower().endswith(".csv") or not fs.getFileStatus(p).isDirectory():
        return read_urls(spark, path)
    entries = sorted(s.getPath().getName() for s in fs.listStatus(p))
    if MANIFEST_FILE in entries:
        return read_urls(spark, f"{path}/{MANIFEST_FILE}")
    tables = [e for e in entries if e.lower().endswith(".csv")]
    if not tables:  # a folder of text parts
        return read_urls(spark, path)
    parts = [read_urls(spark, f"{path}/{e}") for e in tables]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return first_seen(every, ["url"], "seq")


def read_failure_log(spark: SparkSession, soft: str, failed: str) -> DataFrame:
    """(url, reason, seq) of both logs, the soft one first."""
    from ..operators.existence import failure_log

    out = spark.createDataFrame([], "url string, reason string, seq struct<n:int,at:struct<file:string,block:bigint,row:bigint>>")
    for n, path in enumerate((soft, failed)):
        if _there(spark, path):
            lines = spark.read.text(path).select("value", F.struct(F.lit(n).alias("n"), file_order().alias("at")).alias("seq"))
            out = out.unionByName(failure_log(lines, "value", "seq"))
    return out


def read_catalog(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A catalogue of JSON lines; a line that does not parse fails the read, so the caller can rebuild it."""
    if not _there(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def list_files(spark: SparkSession, root: str, recursive: bool = True, glob: str = "*") -> DataFrame:
    """(path, size) of the files under ``root``, relative to it; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", glob).load(root)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    base = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri().getPath().rstrip("/") + "/"
    relative = F.substring(F.col("path"), F.position(F.lit(base), F.col("path")) + F.lit(len(base)), F.length("path"))
    return files.select(relative.alias("path"), F.col("length").alias("size"))


def _tags(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    try:
        from mediafile import MediaFile
    except ImportError as e:
        raise RuntimeError("reading tags of audio files needs the package mediafile; a table of tags can be read instead") from e
    for f in frames:
        out = []
        for path in f["path"]:
            try:
                m = MediaFile(path)
            except Exception:  # noqa: BLE001 - a file that cannot be read has no tags
                continue
            out.append((path, m.artist or "", m.albumartist or "", m.album or "", m.title or "", int(m.track or 0), float(m.length or 0.0)))
        yield pd.DataFrame(out, columns=["path", "artist", "albumartist", "album", "title", "track", "length"])


def read_tags(files: DataFrame, root: str) -> DataFrame:
    """The tags of the audio files (path) under ``root``, read on the executors."""
    audio = files.filter(T.is_audio(F.col("path"))).select(F.concat(F.lit(root.rstrip("/") + "/"), "path").alias("path"))
    return audio.mapInPandas(_tags, "path string, artist string, albumartist string, album string, title string, track int, length double")


def playlist_lines(spark: SparkSession, path: str) -> DataFrame:
    """(stem, seq, line) of the playlists below ``path``, as they are written; ``seq`` orders the lines of one."""
    lines = spark.read.schema("value string, stem string").text(path).select("stem", file_order().alias("seq"), T.strip(T.text(F.col("value"))).alias("line"))
    return lines.filter("line <> ''")


def playlist_ids(lines: DataFrame) -> DataFrame:
    """(stem, seq, track_id): the ids that playlist files carry, in order."""
    ids = lines.filter(F.col("line").startswith("#SPOTIFY:")).select("stem", "seq", T.strip(F.substring("line", len("#SPOTIFY:") + 1, 1 << 30)).alias("track_id"))
    return ids.filter("track_id <> ''")


def playlist_paths(lines: DataFrame, folder: str = "playlists") -> DataFrame:
    """(stem, seq, path): what playlist files list, relative to the library."""
    return lines.filter(~F.col("line").startswith("#")).select("stem", "seq", T.normal_path(F.concat(F.lit(folder + "/"), "line")).alias("path"))


def split_paths(paths: DataFrame, files: DataFrame) -> DataFrame:
    """``paths`` (path, ...) with ``exists``: whether the library has the file (path)."""
    there = files.select(T.normal_path(F.col("path")).alias("path")).distinct().withColumn("there", F.lit(True))
    return paths.join(there, "path", "left").withColumn("exists", F.coalesce("there", F.lit(False))).drop("there")
