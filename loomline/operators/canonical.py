"""Album groups, majority votes for their names, and ambiguous keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def scan(library: DataFrame) -> DataFrame:
    """Files with their tags stripped and defaults filled in: artist from albumartist, title from the file name. Files in pruned folders are left out."""
    library = library.filter(~T.in_pruned_folder(F.col("path")))
    strip = lambda c: T.strip(T.text(F.col(c)))
    artist = F.coalesce(F.nullif(strip("artist"), F.lit("")), F.nullif(strip("albumartist"), F.lit("")), F.lit("Unknown Artist"))
    return library.select(
        F.col("file_id").alias("seq"), T.text(F.col("path")).alias("path"), artist.alias("artist"), strip("albumartist").alias("albumartist"), strip("album").alias("album"),
        F.coalesce(F.nullif(strip("title"), F.lit("")), T.stem(F.col("path"))).alias("title"), F.coalesce(T.track_int(F.col("track")), F.lit(0)).alias("track"),
    )


def group_key(album: Column, seq: Column) -> Column:
    """Files of one album by its normalized name; a file without an album is a group of its own."""
    return F.when(album != "", F.concat(F.lit("a:"), T.norm_key(album))).otherwise(F.concat(F.lit("s:"), seq.cast("string")))


def grouped(files: DataFrame) -> DataFrame:
    return files.withColumn("group", group_key(F.col("album"), F.col("seq")))


def judged(files: DataFrame) -> DataFrame:
    """(group, kind, n, albumartist_vote, album_vote) of every group: its size and its majority votes.

    A vote goes to a normalized value; its winner is the most frequent one, of equals the one
    seen first, in its first-seen writing. ``albumartist_vote`` is the artist name with at
    least half of the votes, else the first collaborator with at least half, else Various
    Artists; blank names do not vote. ``album_vote`` is the album name, '' without any. All
    votes are counted in one pass, before anything of a group meets.
    """
    raw = F.nullif(F.when(F.col("albumartist") != "", F.col("albumartist")).otherwise(F.col("artist")), F.lit(""))
    values = {"whole": raw, "first": T.primary_token(raw), "album": F.nullif(F.col("album"), F.lit("")), "file": F.lit("")}
    votes = F.array(*[F.struct(F.lit(k).alias("vote"), v.alias("value")) for k, v in values.items()])
    long = files.select("group", "seq", F.explode(votes).alias("v")).select("group", "seq", "v.vote", "v.value")
    long = long.filter("value is not null").withColumn("key", T.norm_key(F.col("value")))
    counts = long.groupBy("group", "vote", "key").agg(F.count("*").alias("n"), F.min(F.struct("seq", "value")).alias("seen"))
    of = lambda vote, x: F.when(F.col("vote") == vote, x)
    best = lambda vote: F.max(of(vote, F.struct("n", (-F.col("seen.seq")).alias("early"), F.col("seen.value").alias("winner")))).alias(vote)
    won = counts.groupBy("group").agg(best("whole"), best("first"), best("album"), F.sum(of("whole", F.col("n"))).alias("total"), F.sum(of("file", F.col("n"))).alias("n"))
    half = lambda vote: 2 * F.col(f"{vote}.n") >= F.col("total")
    name = F.when(half("whole"), F.col("whole.winner")).when(half("first"), F.col("first.winner")).otherwise(T.VARIOUS_ARTISTS)
    return won.select("group", _kind().alias("kind"), "n", name.alias("albumartist_vote"), F.coalesce("album.winner", F.lit("")).alias("album_vote"))


def album_artists(files: DataFrame) -> DataFrame:
    """(group, albumartist_vote) of every group."""
    return judged(files).select("group", "albumartist_vote")


def dominant_albums(files: DataFrame) -> DataFrame:
    """(group, album_vote) of every group."""
    return judged(files).select("group", "album_vote")


def _kind() -> Column:
    return F.when(F.col("group").startswith("s:") | (F.col("n") == 1), "single").otherwise("album")


def group_sizes(files: DataFrame) -> DataFrame:
    """(group, kind, n, folders): size and source folders of every group."""
    folder = T.basename(T.dirname(F.col("path")))
    return files.groupBy("group").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(folder)).alias("folders")).withColumn("kind", _kind())


def album_folder(path: Column) -> Column:
    """The folder right below albums/ in which a file lies, at any depth; null elsewhere."""
    parts = F.split(T.text(path), "/")
    return F.when((F.get(parts, 0) == "albums") & (F.size(parts) > 2), F.concat_ws("/", F.get(parts, 0), F.get(parts, 1)))


def walk_order(path: Column) -> Column:
    """Files in the order of a walk: those of a folder by name, then its folders by name."""
    parts = F.split(T.text(path), "/")
    return F.transform(parts, lambda x, i: F.struct((i < F.size(parts) - 1).cast("int").alias("deeper"), x.alias("name")))


def existing_albums(library: DataFrame) -> DataFrame:
    """(aa_key, album_key, n_folders, folder, existing_aa) of the album folders on disk.

    An album folder is known by the tags of the first audio file in it, whatever folders lie
    in it; a key that several folders have is ambiguous: folder is null then.
    """
    files = library.filter(T.is_audio(F.col("path")) & ~T.in_pruned_folder(F.col("path"))).withColumn("folder", album_folder(F.col("path"))).filter("folder is not null")
    strip = lambda c: T.strip(T.text(F.col(c)))
    tags = F.struct(strip("albumartist").alias("aa"), strip("album").alias("al"))
    reps = files.groupBy("folder").agg(F.min_by(tags, F.struct(walk_order(F.col("path")), F.col("file_id"))).alias("r"))
    keyed = reps.filter(F.col("r.al") != "").select("folder", T.norm_key(F.col("r.aa")).alias("aa_key"), T.norm_key(F.col("r.al")).alias("album_key"), F.col("r.aa").alias("aa"))
    one = lambda c: F.when(F.col("n_folders") == 1, F.col(c))
    counted = keyed.groupBy("aa_key", "album_key").agg(F.count("*").alias("n_folders"), F.min("folder").alias("f"), F.min("aa").alias("a"))
    return counted.select("aa_key", "album_key", "n_folders", one("f").alias("folder"), one("a").alias("existing_aa"))
