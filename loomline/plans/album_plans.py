"""Where every file goes: the plan that tidies a library, and the one that stages new files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import canonical
from ..operators.ordering import position_in_group, unique_names
from ..sources.tables import cut_lineage


def _named(files: DataFrame, folder: list[str]) -> DataFrame:
    """Members of album groups with ``unique_name``: NN - Artist - Title.ext, unique in ``folder``."""
    placed = position_in_group(files, ["group"], "seq")
    base = F.concat(T.track_label(F.col("track"), F.col("place")), F.lit(" - "), T.sanitize(F.col("artist")), F.lit(" - "), T.sanitize(F.col("title")))
    return unique_names(placed, folder, base, T.extension(F.col("path")), "seq").drop("place")


def _judged(files: DataFrame) -> DataFrame:
    """Files with the size and the votes of their group, written once: plans read them several times."""
    return cut_lineage(files.join(canonical.judged(files), "group"))


def cleanup_plan(library: DataFrame) -> DataFrame:
    """(seq, path, kind, dst, move, albumartist, tag_write) of every file.

    Lone files go to singles/, groups to albums/<artist> - <album>/. ``move`` is false where
    the file is in place already; ``tag_write`` is true where the albumartist tag must change.
    """
    files = _judged(canonical.grouped(canonical.scan(library)))
    single = files.filter("kind = 'single'")
    dst = F.concat(F.lit("singles/"), T.sanitize(F.col("artist")), F.lit(" - "), T.sanitize(F.col("title")), T.extension(F.col("path")))
    lone = single.select("seq", "path", "kind", dst.alias("dst"), F.lit(None).cast("string").alias("albumartist_vote"), F.lit(False).alias("tag_write"))
    named = _named(files.filter("kind = 'album'"), ["group"])
    place = F.concat(F.lit("albums/"), T.folder_name(F.col("albumartist_vote"), F.col("album_vote")), F.lit("/"), F.col("unique_name"))
    fix = T.norm_key(F.col("albumartist")) != T.norm_key(F.col("albumartist_vote"))
    album = named.select("seq", "path", "kind", place.alias("dst"), "albumartist_vote", fix.alias("tag_write"))
    moved = T.normal_path(F.col("dst")) != T.normal_path(F.col("path"))
    return lone.unionByName(album).select("seq", "path", "kind", "dst", moved.alias("move"), F.col("albumartist_vote").alias("albumartist"), "tag_write")


def cleanup_counters(plan: DataFrame) -> DataFrame:
    return plan.agg(
        F.count_if((F.col("kind") == "album") & F.col("move")).alias("album_moves"), F.count_if((F.col("kind") == "single") & F.col("move")).alias("single_moves"),
        F.count_if(~F.col("move")).alias("in_place"), F.count_if("tag_write").alias("tag_writes"),
    )


def various_groups(library: DataFrame) -> DataFrame:
    """(album, n, folders) of the album groups without a common artist."""
    files = canonical.grouped(canonical.scan(library))
    sizes = canonical.group_sizes(files).filter("kind = 'album'")
    named = sizes.join(canonical.judged(files).drop("kind", "n"), "group")
    album = F.when(F.col("album_vote") != "", F.col("album_vote")).otherwise(T.folder_name(F.col("albumartist_vote"), F.col("album_vote")))
    return named.filter(F.col("albumartist_vote") == T.VARIOUS_ARTISTS).select("group", album.alias("album"), "n", "folders")


def stage_plan(incoming: DataFrame, library: DataFrame) -> DataFrame:
    """(seq, path, outcome, dst, move, albumartist, tag_write, ambiguous) of every incoming file.

    A group whose artist and album name exactly one album folder is merged into it, apart
    from titles that the folder has ('duplicate'); another group of two or more is staged in
    a new folder; lone files pass. Keys of several folders never merge and are 'ambiguous'.
    """
    files = _judged(canonical.grouped(canonical.scan(incoming)))
    index = canonical.existing_albums(library)
    keyed = files.withColumns({"aa_key": T.norm_key(F.col("albumartist_vote")), "album_key": T.norm_key(F.col("album_vote"))})
    looked = keyed.join(index, ["aa_key", "album_key"], "left").withColumn("with_album", F.col("group").startswith("a:"))
    merge = F.col("with_album") & F.col("folder").isNotNull()
    outcome = F.when(merge, "merge").when(F.col("with_album") & (F.col("n") >= 2), "stage").otherwise("pass")
    ambiguous = F.col("with_album") & (F.coalesce("n_folders", F.lit(0)) > 1)
    looked = looked.withColumns({"outcome": outcome, "ambiguous": ambiguous})
    have = library.filter(T.is_audio(F.col("path")) & (T.strip(T.text(F.col("title"))) != "") & ~T.in_pruned_folder(F.col("path"))).select(
        canonical.album_folder(F.col("path")).alias("folder"), T.norm_key(F.col("title")).alias("title_key"), F.lit(True).alias("owned")
    ).distinct()
    looked = looked.withColumn("title_key", T.norm_key(F.col("title"))).join(have, ["folder", "title_key"], "left")
    looked = looked.withColumn("outcome", F.when((F.col("outcome") == "merge") & F.col("owned"), "duplicate").otherwise(F.col("outcome")))
    target = F.when(F.col("outcome") == "merge", F.col("folder")).otherwise(F.concat(F.lit("incoming/albums/"), T.folder_name(F.col("albumartist_vote"), F.col("album_vote"))))
    tag = F.when(F.col("outcome") == "merge", F.coalesce(F.nullif("existing_aa", F.lit("")), F.col("albumartist_vote"))).otherwise(F.col("albumartist_vote"))
    looked = looked.withColumns({"target": target, "tag": tag})
    # places are counted over all members of a group, also those that stay behind
    placed = cut_lineage(position_in_group(looked, ["group"], "seq"))
    base = F.concat(T.track_label(F.col("track"), F.col("place")), F.lit(" - "), T.sanitize(F.col("artist")), F.lit(" - "), T.sanitize(F.col("title")))
    going = placed.filter("outcome in ('merge', 'stage')").withColumn("base", base).drop("place")
    going = unique_names(going, ["target"], F.col("base"), T.extension(F.col("path")), "seq")
    going = going.withColumn("dst", F.concat("target", F.lit("/"), "unique_name"))
    moved = T.normal_path(F.col("dst")) != T.normal_path(F.col("path"))
    fix = T.norm_key(F.col("albumartist")) != T.norm_key(F.col("tag"))
    go = going.select("seq", "path", "outcome", "dst", moved.alias("move"), F.col("tag").alias("albumartist"), fix.alias("tag_write"), "ambiguous")
    stay = placed.filter("outcome not in ('merge', 'stage')").select(
        "seq", "path", "outcome", F.lit(None).cast("string").alias("dst"), F.lit(False).alias("move"), F.lit(None).cast("string").alias("albumartist"), F.lit(False).alias("tag_write"), "ambiguous"
    )
    return go.unionByName(stay)


def stage_report(plan: DataFrame) -> DataFrame:
    out = lambda k: F.count_if(F.col("outcome") == k)
    return plan.agg(
        F.count("*").alias("scanned"), out("stage").alias("staged"), out("merge").alias("merged"), out("duplicate").alias("duplicates"), out("pass").alias("passed"),
        F.count_if("tag_write").alias("tag_writes"), F.count_if("ambiguous").alias("ambiguous"),
        F.count_distinct(F.when(F.col("outcome") == "stage", T.dirname(F.col("dst")))).alias("staged_folders"), F.count_distinct(F.when(F.col("outcome") == "merge", T.dirname(F.col("dst")))).alias("merged_folders"),
    )


def library_actions(plan: DataFrame) -> DataFrame:
    """(action, path, target) that carry a cleanup plan out: moves, then tags at the places moved to, then folders left empty.

    'move' leads from path to target; 'tag' writes the albumartist ``target`` into the file that
    stands at ``path`` by then; 'prune' removes a folder that held files before and holds none,
    nor a folder with any, after.
    """
    now = F.when(F.col("move"), F.col("dst")).otherwise(F.col("path"))
    moves = plan.filter("move").select(F.lit("move").alias("action"), "path", F.col("dst").alias("target"))
    tags = plan.filter("tag_write").select(F.lit("tag").alias("action"), now.alias("path"), F.col("albumartist").alias("target"))

    def folders(path: Column) -> DataFrame:
        parts = F.split(T.dirname(T.normal_path(path)), "/")
        deep = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
        return plan.select(F.explode(deep).alias("path")).filter("path <> ''").distinct()

    empty = folders(F.col("path")).join(folders(now), "path", "left_anti")
    return moves.unionByName(tags).unionByName(empty.select(F.lit("prune").alias("action"), "path", F.lit(None).cast("string").alias("target")))


def shown(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """What a report lists: the first ``most`` rows in ``order`` and, in ``n_more``, how many there are besides."""
    more = F.greatest(rows.agg(F.count("*").alias("n")).scalar() - most, F.lit(0))
    return rows.orderBy(*order).limit(most).withColumn("n_more", more)
