"""From what a user names to files, and from files to what is copied, kept and removed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import matching


def _folders(paths: DataFrame, path: str, root: str) -> DataFrame:
    """(folder, name_key) of every folder below ``root``, at any depth."""
    parts = F.split(T.dirname(T.normal_path(F.col(path))), "/")
    inside = paths.select(parts.alias("p")).filter(F.get("p", 0) == root)
    deep = inside.select(F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size("p"), F.lit(2))), lambda n: F.array_join(F.slice("p", 1, n), "/"))).alias("folder"))
    return deep.filter(F.contains("folder", F.lit("/"))).distinct().withColumn("name_key", T.norm_key(T.basename(F.col("folder"))))


def resolve_albums(specs: DataFrame, library: DataFrame) -> DataFrame:
    """(spec, via, target): a folder path, else the album folders of that name, else the folders of files with that album tag."""
    albums = _folders(library, "path", "albums").filter(F.size(F.split("folder", "/")) == 2)
    keyed = specs.select("spec").distinct().withColumn("key", T.norm_key(F.col("spec")))
    every = _folders(library, "path", "albums").select("folder")
    by_path = keyed.join(every, T.normal_path(F.col("spec")) == F.col("folder")).select("spec", F.lit("path").alias("via"), F.col("folder").alias("target"))
    rest = keyed.join(by_path.select("spec").distinct(), "spec", "left_anti")
    by_name = rest.join(albums, F.col("key") == F.col("name_key")).select("spec", F.lit("folder").alias("via"), F.col("folder").alias("target"))
    last = rest.join(by_name.select("spec").distinct(), "spec", "left_anti")
    tags = library.select(T.norm_key(F.col("album")).alias("key"), T.dirname(T.normal_path(F.col("path"))).alias("target")).filter("target <> ''").distinct()
    by_tag = last.join(tags, "key").select("spec", F.lit("tag").alias("via"), "target")
    return by_path.unionByName(by_name).unionByName(by_tag)


def resolve_songs(specs: DataFrame, library: DataFrame) -> DataFrame:
    """(spec, via, target): a file path, else files with that title and, for 'Artist - Title', a common artist."""
    catalog = matching.catalog(library).select("nt", "c_artists", "path")
    artist, title = T.spec_parts(F.col("spec"))
    keyed = specs.select("spec").distinct().select("spec", T.norm_key(title).alias("nt"), artist.alias("artist"), F.transform(T.split_artists(artist), T.norm_key).alias("wanted"))
    files = library.select(T.normal_path(F.col("path")).alias("target")).distinct()
    by_path = keyed.join(files, T.normal_path(F.col("spec")) == F.col("target")).select("spec", F.lit("path").alias("via"), "target")
    rest = keyed.join(by_path.select("spec").distinct(), "spec", "left_anti")
    found = rest.join(catalog.filter("nt <> ''"), "nt").filter((F.col("artist") == "") | F.arrays_overlap("wanted", "c_artists"))
    return by_path.unionByName(found.select("spec", F.lit("title").alias("via"), F.col("path").alias("target")).distinct())


def resolve_folders(specs: DataFrame, library: DataFrame, root: str) -> DataFrame:
    """(spec, via, target): folders of that name anywhere below ``root``, also right below it."""
    named = _folders(library, "path", root)
    keyed = specs.select("spec").distinct().withColumn("key", T.norm_key(F.col("spec")))
    return keyed.join(named, F.col("key") == F.col("name_key")).select("spec", F.lit("folder").alias("via"), F.col("folder").alias("target"))


def resolve_playlists(specs: DataFrame, entries: DataFrame, files: DataFrame) -> DataFrame:
    """(spec, playlist, path, exists): the files that the playlists of a name list, and whether they are there.

    ``entries`` is (playlist, name, path), ``files`` is (path).
    """
    keyed = specs.select("spec").distinct().withColumn("key", T.norm_key(F.col("spec")))
    there = files.select("path").distinct().withColumn("there", F.lit(True))
    hits = keyed.join(entries.withColumn("key", T.norm_key(F.col("name"))), "key").join(there, "path", "left")
    return hits.select("spec", "playlist", "path", F.coalesce("there", F.lit(False)).alias("exists"))


def resolution_warnings(specs: DataFrame, found: DataFrame) -> DataFrame:
    """(spec, n, warning): null for one target, else how many there are."""
    counts = found.groupBy("spec").agg(F.count_distinct("target").alias("n"))
    n = F.coalesce("n", F.lit(0))
    warning = F.when(n == 0, F.concat(F.lit("no match for "), "spec")).when(n > 1, F.concat("spec", F.lit(" matched "), n.cast("string"), F.lit(" targets")))
    return specs.select("spec").distinct().join(counts, "spec", "left").select("spec", n.alias("n"), warning.alias("warning"))


def resolve_targets(
    specs: DataFrame, library: DataFrame, entries: DataFrame, soundtracks: str = "soundtracks", paths: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """What specs (seq, kind, spec) name, in buckets, and what went wrong.

    Kinds are album, song, soundtrack and playlist; ``entries`` is (playlist, name, path) of
    the playlist files, ``library`` the files. With ``paths`` (item, path), entries are
    (playlist, name, item) instead: what is listed often and has many paths is then never
    multiplied out, a path's first spec comes from its item. First result: (bucket, target, seq)
    with the buckets folders, files and m3u8, each target once, at its first spec. Second: (kind,
    spec, warning) for specs without or with several targets, unknown kinds, and playlists that
    list files that are not there, which are left out.
    """
    of = lambda kind: specs.filter(F.col("kind") == kind).select("spec")
    if paths is None:
        entries, paths = entries.withColumnRenamed("path", "item"), entries.select(F.col("path").alias("item"), "path").distinct()
    there = library.select(T.normal_path(F.col("path")).alias("path")).distinct().withColumn("there", F.lit(True))
    paths = paths.join(there, "path", "left").select("item", "path", F.coalesce("there", F.lit(False)).alias("exists"))
    asked = specs.filter("kind = 'playlist' AND spec IS NOT NULL").select("spec", "seq", T.norm_key(F.col("spec")).alias("key"))
    listed = entries.withColumn("key", T.norm_key(F.col("name"))).join(asked.groupBy("key").agg(F.min("seq").alias("seq")), "key")
    named = asked.select("spec", "key").distinct()
    found = {
        "album": resolve_albums(of("album"), library).select("spec", "target"),
        "song": resolve_songs(of("song"), library).select("spec", "target"),
        "soundtrack": resolve_folders(of("soundtrack"), library, soundtracks).select("spec", "target"),
        "playlist": named.join(listed.select("key", F.col("playlist").alias("target")).distinct(), "key").select("spec", "target"),
    }
    bucket = {"album": "folders", "song": "files", "soundtrack": "folders", "playlist": "m3u8"}
    tagged = [df.select(F.lit(k).alias("kind"), "spec", F.lit(bucket[k]).alias("bucket"), "target") for k, df in found.items()]
    every = tagged[0]
    for part in tagged[1:]:
        every = every.unionByName(part)
    order = specs.groupBy("kind", "spec").agg(F.min("seq").alias("seq"))
    files = listed.groupBy("item").agg(F.min("seq").alias("seq")).join(paths.filter("exists"), "item").select(F.lit("files").alias("bucket"), F.col("path").alias("target"), "seq")
    targets = every.join(order, ["kind", "spec"]).select("bucket", "target", "seq").unionByName(files).groupBy("bucket", "target").agg(F.min("seq").alias("seq"))
    warned = [resolution_warnings(of(k), df).filter("warning is not null").select(F.lit(k).alias("kind"), "spec", "warning") for k, df in found.items()]
    gone = listed.join(paths.filter("not exists"), "item").groupBy("key", "playlist").agg(F.count_distinct("path").alias("n")).join(named, "key")
    warned.append(gone.select(F.lit("playlist").alias("kind"), "spec", F.concat("playlist", F.lit(": "), F.col("n").cast("string"), F.lit(" track(s) not there (skipped)")).alias("warning")))
    unknown = specs.filter(~F.col("kind").isin(*found)).select("kind", "spec", F.concat(F.lit("unknown kind "), "kind").alias("warning")).distinct()
    warned.append(unknown)
    warnings = warned[0]
    for part in warned[1:]:
        warnings = warnings.unionByName(part)
    return targets, warnings


def needs_catalog(kind: str, specs: DataFrame, library: DataFrame) -> bool:
    """Whether specs (spec) of a kind can only be resolved with the tags of the library: a name that is no path and no album folder."""
    if kind in ("soundtrack", "playlist"):
        return False
    keyed = specs.select("spec").distinct()
    if kind == "album":
        folders = _folders(library, "path", "albums")
        left = keyed.join(folders, T.normal_path(F.col("spec")) == F.col("folder"), "left_anti")
        tops = folders.filter(F.size(F.split("folder", "/")) == 2)
        return not left.join(tops, T.norm_key(F.col("spec")) == F.col("name_key"), "left_anti").isEmpty()
    files = library.select(T.normal_path(F.col("path")).alias("target"))
    return not keyed.join(files, T.normal_path(F.col("spec")) == F.col("target"), "left_anti").isEmpty()


def expanded(targets: DataFrame, files: DataFrame) -> DataFrame:
    """(path, bucket, seq): targets (bucket, target, seq) with folders replaced by all files (path) below them, at any depth.

    Buckets are numbered in the order in which they are staged: folders, files, m3u8. A file
    knows its folders, so this is an equi-join.
    """
    number = F.when(F.col("bucket") == "folders", 0).when(F.col("bucket") == "files", 1).otherwise(2)
    numbered = targets.select("target", number.alias("bucket"), "seq")
    paths = files.select(T.normal_path(F.col("path")).alias("path")).distinct()
    parts = F.split(T.dirname(F.col("path")), "/")
    above = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("target"))
    folders = numbered.filter("bucket = 0").withColumn("target", T.normal_path(F.col("target"))).join(above, "target").select("path", "bucket", "seq")
    return folders.unionByName(numbered.filter("bucket > 0").select(F.col("target").alias("path"), "bucket", "seq"))


def collect_plan(items: DataFrame, root: str) -> DataFrame:
    """(rel, bucket, seq) of items (bucket, path, seq) inside ``root``, the first of equal relative paths by bucket and seq."""
    inside = items.select(T.relative_inside(F.col("path"), F.lit(root)).alias("rel"), "bucket", "seq").filter("rel is not null")
    return inside.groupBy("rel").agg(F.min(F.struct("bucket", "seq")).alias("first")).select("rel", "first.bucket", "first.seq")


def stage_actions(plan: DataFrame, present: DataFrame, overwrite: bool = False, link: bool = False, source: DataFrame | None = None) -> DataFrame:
    """(rel, action): copy or link, or for what is there already skip or overwrite.

    With ``source`` (rel), what is to be written but not there to be read is an 'error'.
    """
    there = present.select("rel").distinct().withColumn("there", F.lit(True))
    action = F.when(F.col("there"), "overwrite" if overwrite else "skip").otherwise("link" if link else "copy")
    out = plan.join(there, "rel", "left").select("rel", action.alias("action"))
    if source is None:
        return out
    known = source.select("rel").distinct().withColumn("known", F.lit(True))
    return out.join(known, "rel", "left").select("rel", F.when((F.col("action") != "skip") & F.col("known").isNull(), "error").otherwise(F.col("action")).alias("action"))


def unstage_actions(plan: DataFrame, present: DataFrame, protected: DataFrame) -> DataFrame:
    """(rel, action) of the files (rel) of what is taken back.

    'protected': an audio file that a remaining playlist (protected.rel) refers to; else
    'missing' if it is not there, and 'm3u8_removed' for a playlist file or 'removed'.
    """
    flag = lambda df, name: df.select("rel").distinct().withColumn(name, F.lit(True))
    lists = F.lower(T.extension(F.col("rel"))).isin(*T.PLAYLIST_EXTENSIONS)
    action = F.when(F.col("kept") & ~lists, "protected").when(F.col("there").isNull(), "missing").when(lists, "m3u8_removed").otherwise("removed")
    return plan.select("rel").distinct().join(flag(protected, "kept"), "rel", "left").join(flag(present, "there"), "rel", "left").select("rel", action.alias("action"))


def action_counts(actions: DataFrame, names: list[str]) -> DataFrame:
    """One row with how often each of the named actions is planned."""
    return actions.agg(*[F.count_if(F.col("action") == n).alias(n) for n in names])


def removal(removed: DataFrame, remaining: DataFrame, present: DataFrame) -> DataFrame:
    """(path, action) of the files of removed playlists.

    'protected': a remaining playlist refers to the file; else 'remove' if it is there and 'missing' if not.
    """
    files = removed.select("path").distinct()
    kept = remaining.select("path").distinct().withColumn("kept", F.lit(True))
    there = present.select("path").distinct().withColumn("there", F.lit(True))
    action = F.when(F.col("kept"), "protected").when(F.col("there"), "remove").otherwise("missing")
    return files.join(kept, "path", "left").join(there, "path", "left").select("path", action.alias("action"))


#: The subtrees that an inventory counts.
SUBTREES = ("albums", "singles", "soundtracks", "playlists")


def inventory(files: DataFrame, subtrees: tuple[str, ...] | None = SUBTREES) -> DataFrame:
    """(sub, folder, n_files, n_folders, bytes) per folder, per subtree (folder null) and in all (both null).

    ``files`` is (path, size); only ``subtrees`` count, all of them if None; files right under a subtree have the folder ''.
    """
    p = T.normal_path(F.col("path"))
    sub = F.split_part(p, F.lit("/"), F.lit(1))
    folder = F.regexp_replace(T.dirname(p), r"^[^/]*/?", "")
    rows = files.select(sub.alias("sub"), folder.alias("folder"), F.concat_ws("/", sub, folder).alias("dir"), "size")
    rows = rows if subtrees is None else rows.filter(F.col("sub").isin(*subtrees))
    counted = rows.rollup("sub", "folder").agg(
        F.count("*").alias("n_files"), F.count_distinct(F.when(F.col("folder") != "", F.col("dir"))).alias("n_folders"), F.sum("size").alias("bytes")
    )
    return counted.withColumn("size", T.size_text(F.col("bytes")))


#: Fixed value: a token of at least so many characters is taken for an id.
ID_LENGTH = 16


def _tokens(tokens: DataFrame) -> DataFrame:
    """(token, as_id, is_id): the id in a token, and whether the token stands for it."""
    as_id = T.playlist_id_of(F.col("token"))
    return tokens.select("token").distinct().select("token", as_id.alias("as_id"), (F.length(as_id) >= ID_LENGTH).alias("is_id"))


def selected_playlists(playlists: DataFrame, tokens: DataFrame | None = None, every: bool = False, owner: str | None = None) -> DataFrame:
    """The playlists that are asked for: those whose name or id is a given token, else every one, else those of ``owner``.

    A token is a link, an id or a name; names count as they are written. Without tokens,
    ``every`` and ``owner`` all are taken. Repeated rows stay.
    """
    if tokens is not None:
        named = _tokens(tokens)
        ids = named.filter("is_id").select(F.col("as_id").alias("wanted_id"), F.lit(True).alias("by_id")).distinct()
        names = named.filter("not is_id").select(F.col("token").alias("wanted_name"), F.lit(True).alias("by_name")).distinct()
        hit = playlists.join(ids, F.col("id") == F.col("wanted_id"), "left").join(names, F.col("name") == F.col("wanted_name"), "left")
        return hit.filter("by_id or by_name").select(*playlists.columns)
    if every or owner is None:
        return playlists
    return playlists.filter(T.text(F.col("owner")) == owner)


def fetch_list(tokens: DataFrame, playlists: DataFrame) -> DataFrame:
    """(token, id): what to fetch for every token; id is null for a name that no playlist has. Of equal names the last by ``seq`` counts."""
    known = playlists.filter((T.text(F.col("name")) != "") & (T.text(F.col("id")) != "")).groupBy("name").agg(F.max_by("id", "seq").alias("known_id"))
    named = _tokens(tokens).join(known, (~F.col("is_id")) & (F.col("token") == F.col("name")), "left")
    return named.select("token", F.when(F.col("is_id"), F.col("as_id")).otherwise(F.col("known_id")).alias("id"))


def playlist_rows(playlists: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Every playlist with each of its rows, and once with null row columns if it has none."""
    return playlists.join(rows, key, "left")


def scoped_refresh(old: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """``old`` without the rows of the keys that were fetched again, and the fetched rows."""
    return old.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def pick_hit(hits: DataFrame) -> DataFrame:
    """Per query the hit to take: of the first search with any, the first with the wanted title, else the first.

    ``hits`` is (query, search, pos, title, wanted, id).
    """
    order = F.struct("search", (~(F.lower("title") == F.lower("wanted"))).cast("int").alias("other"), "pos", "id")
    return hits.groupBy("query").agg(F.min(order).alias("best"), F.min_by("title", order).alias("title")).select("query", F.col("best.id").alias("id"), "title")


def widest_image(images: DataFrame, key: str) -> DataFrame:
    """Per key the url of the widest image (key, url, width, pos), the first of equals."""
    return images.groupBy(key).agg(F.max_by("url", F.struct(F.coalesce("width", F.lit(0)), -F.col("pos"))).alias("url"))
