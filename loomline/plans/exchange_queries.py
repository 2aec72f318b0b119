"""Queries that go through pages and files: nested pages, tables, logs and playlists, written
and read again as a whole. Their SQL says what must come back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup, existence, matching, ordering, resolve
from ..sources import pages, readers, schemas, writers
from ..sources.tables import cut_lineage, scratch, table
from . import album_plans, album_queries, library_queries, track_queries
from . import function_queries as S

_FLAT = ["seq", "track_id", "track_name", "artist_names", "album_name", "duration_ms", "explicit", "popularity", "added_at", "added_by", "spotify_url"]


def q_json_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Nested pages, made from the rows of every playlist, back to flat rows; items without a track go."""
    return pages.flatten_tracks(pages.as_pages(table(spark, d, "playlist_tracks"))).select(*_FLAT)


def _playlist_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "playlists").withColumn("at", F.unix_seconds("exported_at"))
    return pages.playlists_as_pages(rows, "at")


def q_playlist_pages(spark: SparkSession, d: str) -> DataFrame:
    return pages.flatten_playlists(_playlist_pages(spark, d))


def q_owned_playlists(spark: SparkSession, d: str) -> DataFrame:
    """The playlists of the first owner, by the owner's id in the pages."""
    owner = table(spark, d, "playlists").agg(F.min("owner")).scalar()
    return pages.flatten_playlists(_playlist_pages(spark, d), owner=owner)


def _saved(spark: SparkSession, d: str) -> DataFrame:
    """The manifest's rows as pages of saved tracks, flattened."""
    blank = lambda c, kind: F.lit(None).cast(kind).alias(c)
    rows = table(spark, d, "spotify_manifest").select(
        F.col("row_id").alias("seq"), "track_id", "track_name", "artist_names", "album_name", "duration_ms", "explicit", "popularity", "spotify_url",
        F.date_format("exported_at", "yyyy-MM-dd").alias("added_at"), blank("added_by", "string"), blank("track_number", "int"), blank("disc_number", "int"), blank("is_local", "boolean"),
    )
    return pages.flatten_saved(pages.as_pages(rows, ()))


def q_saved_tracks(spark: SparkSession, d: str) -> DataFrame:
    return _saved(spark, d).select("playlist_id", "playlist_name", *_FLAT)


def _all_tracks(spark: SparkSession, d: str) -> DataFrame:
    tracks = table(spark, d, "playlist_tracks").drop("exported_at")
    return pages.with_saved(tracks, _saved(spark, d).select(*tracks.columns))


def q_all_tracks(spark: SparkSession, d: str) -> DataFrame:
    return _all_tracks(spark, d).select("seq", "playlist_id", "track_id", "track_name")


def q_manifest_all(spark: SparkSession, d: str) -> DataFrame:
    """The manifest of playlists and saved tracks, with each row's place in it."""
    rows = dedup.manifest(_all_tracks(spark, d))
    return ordering.numbered(rows, [F.col("sort_title"), F.col("slot")]).select("track_id", "playlist_names", "playlist_count", "explicit", "slot", F.col("code").alias("place"))


def _ranked(spark: SparkSession, d: str, path: str) -> DataFrame:
    """The manifest's rows, landed as album documents ranked by row."""
    m = table(spark, d, "spotify_manifest")
    documents = m.select(F.col("row_id").cast("int").alias("ranking"), F.col("album_name").alias("album"), F.col("artist_names").alias("artist"), F.year("exported_at").cast("string").alias("year"), F.concat(F.lit("al"), "row_id").alias("albumID"))
    writers.write_catalog(documents, path)
    return readers.read_catalog(spark, path, pages.RANKED)


def q_ranked_albums(spark: SparkSession, d: str) -> DataFrame:
    """The 200 best ranked album documents, read from where they landed."""
    return pages.top_ranked(_ranked(spark, d, scratch(spark, "ranked")), 200)


def _albums(spark: SparkSession, d: str) -> DataFrame:
    """Every album of the manifest, ranked by its first row; it was found, and has a link, if that row has one."""
    m = table(spark, d, "spotify_manifest").filter(T.text(F.col("album_name")) != "")
    first = m.groupBy("album_name").agg(F.min("row_id").cast("int").alias("rank"), F.min_by(F.struct("artist_names", "spotify_url"), "row_id").alias("r"))
    link = F.when(T.text(F.col("r.spotify_url")) != "", F.concat(F.lit("https://open.tapes.example/album/al"), F.col("rank").cast("string"), F.lit("?si=x"))).otherwise("")
    return first.select("rank", F.col("album_name").alias("title"), F.col("r.artist_names").alias("artist"), F.lit("").alias("year"), F.lit("").alias("album_id"), link.alias("spotify_url"))


def q_album_links(spark: SparkSession, d: str) -> DataFrame:
    return _albums(spark, d).select("rank", T.album_id_of(F.col("spotify_url")).alias("album_id"), T.album_id_of(F.concat(F.lit("tapes:album:"), F.md5("title"))).alias("uri_id"), T.is_playlist_link(F.replace("spotify_url", F.lit("/album/"), F.lit("/albums/"))).alias("listed"))


def q_album_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Ranked albums expanded to their tracks: nested pages of the albums, flattened, the first of equal links."""
    albums = _albums(spark, d)
    m = table(spark, d, "spotify_manifest").join(albums.select(F.col("title").alias("album_name"), F.concat(F.lit("al"), F.col("rank").cast("string")).alias("album")), "album_name")
    placed = ordering.position_in_group(m, ["album"], "row_id", "pos")
    found = pages.expand_albums(albums, pages.albums_as_pages(placed, "album", "album_name", "pos"))
    return found.select("track_id", "track_name", "artist_names", "album_name", "duration_ms", "explicit", "popularity", "playlist_count", "spotify_url")


def q_ranked_export(spark: SparkSession, d: str) -> DataFrame:
    """Ranked albums written as a table and a list of links, and read again: the albums with a link, and those without."""
    path = scratch(spark, "ranked")
    missing = writers.write_ranked(_albums(spark, d), path)
    links = readers.read_urls(spark, f"{path}/albums_urls.txt").select(F.lit("link").alias("what"), F.col("url").alias("value"))
    rows = readers.read_csv(spark, f"{path}/albums.csv", schemas.RANKED_ALBUMS).select(F.lit("album").alias("what"), F.concat_ws("|", "rank", "title", "artist").alias("value"))
    return links.unionByName(rows).unionByName(missing.select(F.lit("missing").alias("what"), F.col("rank").cast("string").alias("value")))


def q_playlists_csv(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "playlists.csv")
    writers.write_csv(table(spark, d, "playlists").withColumn("at", F.unix_micros("exported_at")), path, schemas.names(schemas.PLAYLISTS), order=["at"])
    nothing = readers.read_csv(spark, scratch(spark, "none.csv"), schemas.PLAYLISTS)
    return readers.read_csv(spark, path, schemas.PLAYLISTS).unionByName(nothing)


def q_single_playlist(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the first playlist id as a table and a list of links in which blank ones stay: how many of each came back."""
    tracks = table(spark, d, "playlist_tracks")
    one = tracks.filter(F.col("playlist_id") == tracks.agg(F.min("playlist_id")).scalar())
    path = scratch(spark, "single")
    writers.write_playlist(one, path, "tracks")
    rows = readers.read_csv(spark, f"{path}/tracks.csv", schemas.TRACKS)
    links = spark.read.text(f"{path}/tracks_urls.txt")
    return rows.agg(F.count("*").alias("n_rows"), F.sum("duration_ms").alias("ms"), F.count_if("explicit").alias("n_explicit")).withColumn("n_links", links.agg(F.count("*")).scalar())


def _ordered_manifest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "spotify_manifest").filter(T.text(F.col("track_name")) != "")


def q_manifest_export(spark: SparkSession, d: str) -> DataFrame:
    """The manifest as a table and its links, read again as sources: of a folder with a manifest, one without, a table and a text."""
    path = scratch(spark, "manifest")
    rows = _ordered_manifest(spark, d)
    writers.write_manifest(rows, f"{path}/with", "spotify_manifest", "row_id")
    writers.write_manifest(rows.filter("popularity is null"), f"{path}/with", "other", "row_id")
    writers.write_manifest(rows.filter("popularity < 50"), f"{path}/without", "a", "row_id")
    writers.write_manifest(rows.filter("popularity >= 50"), f"{path}/without", "b", "row_id")
    out = None
    for what, source in (("folder", f"{path}/with"), ("tables", f"{path}/without"), ("table", f"{path}/with/other.csv"), ("text", f"{path}/without/b_urls.txt")):
        urls = readers.read_source(spark, source).select(F.lit(what).alias("source"), "url")
        out = urls if out is None else out.unionByName(urls)
    return out


def q_url_order(spark: SparkSession, d: str) -> DataFrame:
    """Links written in the order of their rows and read again, with the place of each."""
    path = scratch(spark, "urls.txt")
    writers.write_urls(_ordered_manifest(spark, d), path, order="row_id")
    return ordering.numbered(readers.read_urls(spark, path), [F.col("seq")]).select("url", F.col("code").alias("place"))


def q_metadata_files(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of links from two tables with different separators; the first file that has a link counts."""
    path = scratch(spark, "metadata")
    writers.write_csv(_ordered_manifest(spark, d), f"{path}/a.csv", ["spotify_url", "artist_names", "track_name"], order=["row_id"], sep=";")
    tracks = table(spark, d, "playlist_tracks")
    writers.write_csv(tracks, f"{path}/b.csv", ["track_name", "album_name", "spotify_url", "artist_names"], order=["seq"])
    return readers.read_metadata(spark, [f"{path}/b.csv", f"{path}/a.csv", f"{path}/c.csv"])


def q_catalog_file(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "catalog")
    rows = table(spark, d, "library").select("path", "artist", "albumartist", "album", "title", F.coalesce(T.track_int(F.col("track")), F.lit(0)).alias("track"), "length")
    writers.write_catalog(rows, path)
    return readers.read_catalog(spark, path, schemas.CATALOG)


def q_listing_file(spark: SparkSession, d: str) -> DataFrame:
    """The library as a tab-separated listing without a header, read again: rows and albums per year."""
    path = scratch(spark, "listing.tsv")
    rows = table(spark, d, "library").select(F.concat_ws("\t", *[T.clean_text(F.col(c)) for c in schemas.names(schemas.LIBRARY)]).alias("value"))
    rows.write.text(path)
    return readers.read_tsv(spark, path, schemas.LIBRARY).groupBy(T.text(F.col("year")).alias("year")).agg(F.count("*").alias("n_rows"), F.count_distinct("album").alias("n_albums"))


def q_log_files(spark: SparkSession, d: str) -> DataFrame:
    """Failures appended to a soft log in two runs and to a failed log, read again: reasons in first-seen order."""
    log = cut_lineage(library_queries.q_log_parse(spark, d))
    path = scratch(spark, "logs")
    middle = log.agg(F.avg("seq")).scalar()
    for part in (log.filter(F.col("seq") < middle), log.filter(F.col("seq") >= middle)):
        writers.append_log(part.orderBy("seq"), f"{path}/soft")
    writers.append_log(log.filter(F.col("reason") == "track_unavailable"), f"{path}/failed")
    back = readers.read_failure_log(spark, f"{path}/soft", f"{path}/failed")
    return existence.reason_union(back).select("url", F.array_join(F.array_sort("reasons"), ", ").alias("reasons"))


def q_retry_export(spark: SparkSession, d: str) -> DataFrame:
    """The retry report written in its order and read again with places, and how many rows have a name."""
    path = scratch(spark, "retry")
    report = cut_lineage(library_queries.q_retry_report(spark, d))
    named = writers.write_retry(report, path)
    placed = readers.read_csv(spark, f"{path}/retry.csv", ", ".join(f"{c} string" for c in schemas.RETRY_REPORT)).withColumn("seq", readers.file_order())
    return ordering.numbered(placed, [F.col("seq")]).select("spotify_url", "reason", F.col("code").alias("place")).withColumn("n_named", report.agg(named).scalar())


def _unmatched(spark: SparkSession, d: str) -> DataFrame:
    tracks = table(spark, d, "playlist_tracks")
    rows = matching.match_rows(tracks, table(spark, d, "library")).filter("file_id is null").select("seq", F.col("tier").alias("tier_tried"))
    return rows.join(tracks.select("seq", "playlist_name", "track_id", "track_name", "artist_names", "album_name", "spotify_url"), "seq")


def q_unmatched_export(spark: SparkSession, d: str) -> DataFrame:
    """Unmatched rows and their distinct links as files, read again."""
    path = scratch(spark, "unmatched")
    writers.write_unmatched(cut_lineage(_unmatched(spark, d)), path)
    rows = readers.read_csv(spark, f"{path}/unmatched.csv", ", ".join(f"{c} string" for c in schemas.UNMATCHED))
    counts = rows.groupBy(F.col("tier_tried").alias("what")).agg(F.count("*").alias("n"))
    return counts.unionByName(readers.read_urls(spark, f"{path}/unmatched_urls.txt").agg(F.count("*").alias("n")).select(F.lit("links").alias("what"), "n"))


def _playlist_files(spark: SparkSession, d: str) -> DataFrame:
    """Every playlist's file, written and read again."""
    path = scratch(spark, "playlists")
    names = table(spark, d, "playlist_tracks").select("seq", F.coalesce("playlist_name", "playlist_id", F.lit("Unknown")).alias("name"))
    writers.write_playlists(track_queries.q_m3u_lines(spark, d).join(names, "seq"), path, "playlist_id", "name")
    return readers.playlist_lines(spark, path)


def q_playlist_files(spark: SparkSession, d: str) -> DataFrame:
    """The lines of all playlist files with their places; of playlists with one file name the later one stands."""
    lines = cut_lineage(_playlist_files(spark, d))
    placed = ordering.numbered(lines, [F.col("stem"), F.col("seq")])
    start = placed.groupBy("stem").agg(F.min("code").alias("start"))
    return placed.join(start, "stem").select("stem", (F.col("code") - F.col("start")).alias("place"), "line")


def q_playlist_file_refs(spark: SparkSession, d: str) -> DataFrame:
    """Per playlist file how many ids it carries, and how many files it lists that the library has or lacks (those of downloads count as lost)."""
    lines = cut_lineage(_playlist_files(spark, d))
    ids = readers.playlist_ids(lines).groupBy("stem").agg(F.count("*").alias("n_ids"))
    have = table(spark, d, "library").select("path").filter(~T.text(F.col("path")).startswith("downloads/"))
    paths = readers.split_paths(readers.playlist_paths(lines), have)
    return paths.groupBy("stem").agg(F.count_if("exists").alias("n_there"), F.count_if(~F.col("exists")).alias("n_lost")).join(ids, "stem", "left").withColumn("n_ids", F.coalesce("n_ids", F.lit(0)))


def q_file_listing(spark: SparkSession, d: str) -> DataFrame:
    """A tree of files with one folder per album folder's first letter, listed: files per folder."""
    path = scratch(spark, "tree")
    letters = table(spark, d, "library").select(F.concat(F.lit("l"), F.md5(F.substring(T.basename(F.col("path")), 1, 1))).alias("letter"), F.col("path").alias("value"))
    letters.repartition("letter").write.partitionBy("letter").text(path)
    listed = readers.list_files(spark, path, glob="*.txt")
    return listed.filter(T.dirname(F.col("path")) != "").select(T.dirname(F.col("path")).alias("folder"), (F.col("size") > 0).alias("filled")).distinct()


def q_playlist_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every playlist with its rows, and once without any."""
    lists = table(spark, d, "playlists").select(T.strip(F.col("id")).alias("id"), "owner").filter("id <> ''").distinct()
    rows = table(spark, d, "playlist_tracks").select(T.playlist_id_of(T.strip(F.col("playlist_id"))).alias("id"), "seq")
    return resolve.playlist_rows(lists, rows, "id")


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    """What a user may ask for: links, ids and names of playlist rows."""
    rows = table(spark, d, "playlist_tracks")
    return rows.select(F.col("playlist_name").alias("token")).unionByName(rows.select(F.col("playlist_id").alias("token"))).filter("trim(token) <> ''").distinct()


def q_playlist_select(spark: SparkSession, d: str) -> DataFrame:
    """Playlists by token, then all, then those of one owner."""
    lists = table(spark, d, "playlists").select("id", "name", "owner")
    owner = lists.agg(F.min("owner")).first()[0]
    modes = {"tokens": resolve.selected_playlists(lists, _tokens(spark, d)), "every": resolve.selected_playlists(lists, every=True), "mine": resolve.selected_playlists(lists, owner=owner)}
    tagged = [df.select(F.lit(mode).alias("mode"), "*") for mode, df in modes.items()]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


def q_fetch_list(spark: SparkSession, d: str) -> DataFrame:
    lists = table(spark, d, "playlists").select("id", "name", F.unix_micros("exported_at").alias("seq"))
    return resolve.fetch_list(_tokens(spark, d), lists)


_KINDS = ("album", "song", "soundtrack", "playlist", "opera")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """(seq, kind, spec): albums, songs, soundtracks and playlists that the tables name, and one kind that there is not."""
    m, tracks = table(spark, d, "spotify_manifest"), table(spark, d, "playlist_tracks")
    specs = {"album": (m, F.col("album_name"), "row_id"), "song": (m, F.col("track_name"), "row_id"), "soundtrack": (m, F.col("album_name"), "row_id"), "playlist": (tracks, F.col("playlist_name"), "seq")}
    out = None
    for k, (df, spec, seq) in specs.items():
        rows = df.select(F.lit(k).alias("kind"), spec.alias("spec"), F.col(seq).alias("seq")).filter(T.norm_key(F.col("spec")) != "").groupBy("kind", "spec").agg(F.min("seq").alias("seq"))
        out = rows if out is None else out.unionByName(rows)
    return out.unionByName(spark.createDataFrame([("opera", "x", 0)], "kind string, spec string, seq long"))


def _resolved(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    library = table(spark, d, "library")
    rows = table(spark, d, "playlist_tracks").select(T.playlist_id_of(T.strip(F.col("playlist_id"))).alias("playlist"), F.col("playlist_name").alias("name"), F.col("track_name").alias("item"))
    entries = cut_lineage(rows.filter("playlist <> '' AND item IS NOT NULL").distinct())
    # a title stands in many playlists and names many files: the two meet per title, not per row
    files = library.select(F.col("title").alias("item"), T.normal_path(F.col("path")).alias("path"))
    paths = entries.select("item").distinct().join(files, "item", "left").select("item", F.coalesce("path", F.concat(F.lit("lost/"), "item")).alias("path")).distinct()
    return resolve.resolve_targets(_asked(spark, d), library, entries, "downloads", paths)


def q_resolve_targets(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d)[0]


def q_resolve_problems(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d)[1]


def _collected(spark: SparkSession, d: str) -> DataFrame:
    """What the resolved targets come to below the library's root: folders expanded, then files, then playlists."""
    library = table(spark, d, "library")
    targets = cut_lineage(_resolved(spark, d)[0])
    lists = targets.withColumn("target", F.when(F.col("bucket") == "m3u8", F.concat(F.lit("playlists/"), "target", F.lit(".m3u8"))).otherwise(F.col("target")))
    items = resolve.expanded(lists, library)
    rooted = items.withColumn("path", F.concat(F.when(F.col("path").startswith("singles/"), F.lit("rootless/../")).otherwise("root/"), "path"))
    return resolve.collect_plan(rooted, "root")


def q_collect_plan(spark: SparkSession, d: str) -> DataFrame:
    """Singles lie outside the root here, so nothing of them is taken."""
    return _collected(spark, d)


def q_staged(spark: SparkSession, d: str) -> DataFrame:
    """What staging and taking back the collected files does, with those of compressed kinds there already and files of downloads gone."""
    plan = cut_lineage(_collected(spark, d))
    present = plan.filter(F.lower(T.extension(F.col("rel"))).isin(".mp3", ".m4a", ".m3u8")).select("rel")
    source = plan.filter(~F.col("rel").startswith("downloads/")).select("rel")
    protected = plan.filter("bucket = 1").select("rel")
    put = resolve.action_counts(resolve.stage_actions(plan, present, link=True, source=source), ["copy", "link", "skip", "overwrite", "error"])
    over = resolve.action_counts(resolve.stage_actions(plan, present, overwrite=True), ["copy", "link", "skip", "overwrite", "error"])
    back = resolve.action_counts(resolve.unstage_actions(plan, present, protected), ["removed", "protected", "missing", "m3u8_removed"])
    long = lambda df, step: df.select(F.lit(step).alias("step"), F.explode(F.array(*[F.struct(F.lit(c).alias("action"), F.col(c).alias("n")) for c in df.columns])).alias("x")).select("step", "x.*")
    return long(put, "stage").unionByName(long(over, "overwrite")).unionByName(long(back, "unstage"))


def q_needs_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Per kind whether what is asked for needs the tags; 'folders' asks for album folders by name only, 'paths' for files by path only."""
    library, asked = table(spark, d, "library"), cut_lineage(_asked(spark, d))
    rows = [(k, resolve.needs_catalog(k, asked.filter(F.col("kind") == k), library)) for k in _KINDS[:4]]
    folders = library.filter(F.col("path").startswith("albums/")).select(F.split_part("path", F.lit("/"), F.lit(2)).alias("spec"))
    rows += [("folders", resolve.needs_catalog("album", folders, library)), ("paths", resolve.needs_catalog("song", library.select(F.col("path").alias("spec")), library))]
    return spark.createDataFrame(rows, "kind string, needed boolean")


def q_library_actions(spark: SparkSession, d: str) -> DataFrame:
    return album_plans.library_actions(cut_lineage(album_plans.cleanup_plan(table(spark, d, "library"))))


def q_moves_shown(spark: SparkSession, d: str) -> DataFrame:
    """The moves that the report shows: the first 25 by place, and how many more there are."""
    moves = cut_lineage(album_plans.cleanup_plan(table(spark, d, "library"))).filter("move").select("seq", "path", "dst")
    return album_plans.shown(moves, [F.col("seq")], 25)


def q_folder_listing(spark: SparkSession, d: str) -> DataFrame:
    """All folders of the library in order of their names, with the place of each, and the label of the first file in each."""
    files = table(spark, d, "library").select(T.dirname(F.col("path")).alias("folder"), T.label_of_stem(F.col("path")).alias("label"))
    folders = files.groupBy("folder").agg(F.min("label").alias("label"))
    return ordering.numbered(folders, [F.col("folder")]).select("folder", "label", F.col("code").alias("place"))


def q_csv_field(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "playlist_tracks").select("seq", T.csv_field(F.col("track_name")).alias("title"), T.csv_field(F.col("artist_names")).alias("artists"))


QUERIES = {f.__name__: f for f in (
    q_json_flatten, q_playlist_pages, q_owned_playlists, q_saved_tracks, q_all_tracks, q_manifest_all, q_ranked_albums, q_album_links, q_album_tracks, q_ranked_export, q_playlists_csv, q_single_playlist,
    q_manifest_export, q_url_order, q_metadata_files, q_catalog_file, q_listing_file, q_log_files, q_retry_export, q_unmatched_export, q_playlist_files, q_playlist_file_refs, q_file_listing, q_playlist_rows,
    q_playlist_select, q_fetch_list, q_resolve_targets, q_resolve_problems, q_collect_plan, q_staged, q_needs_catalog, q_library_actions, q_moves_shown, q_folder_listing, q_csv_field,
)}

_p = lambda c: S.strip(S.t(c))
_SAVED = """saved AS (SELECT 'liked_songs' AS playlist_id, 'Liked Songs' AS playlist_name, row_id AS seq, coalesce(track_id, '') AS track_id, track_name, coalesce(artist_names, '') AS artist_names, coalesce(album_name, '') AS album_name,
  duration_ms, explicit, popularity, strftime(exported_at, '%Y-%m-%d') AS added_at, CAST(NULL AS VARCHAR) AS added_by, coalesce(spotify_url, '') AS spotify_url FROM spotify_manifest WHERE track_name IS NOT NULL)"""
_COLS = "seq, playlist_id, playlist_name, track_id, track_name, artist_names, album_name, duration_ms, explicit, popularity, spotify_url"
_ALL = f"""{_SAVED}, every AS (SELECT {_COLS} FROM playlist_tracks UNION ALL SELECT seq + 1 + (SELECT max(seq) FROM playlist_tracks), playlist_id, playlist_name, track_id, track_name, artist_names, album_name, duration_ms, explicit, popularity, spotify_url FROM saved)"""
_ALBUMS = """albums AS (SELECT CAST(row_id AS INTEGER) AS rank, album_name AS title, artist_names AS artist, CASE WHEN coalesce(spotify_url, '') <> '' THEN concat('https://open.tapes.example/album/al', row_id, '?si=x') ELSE '' END AS link
  FROM (SELECT *, row_number() OVER (PARTITION BY album_name ORDER BY row_id) AS n FROM spotify_manifest WHERE coalesce(album_name, '') <> '') WHERE n = 1)"""
_LOG = library_queries._LOG
_TOKENS = """tokens AS (SELECT token, CASE WHEN contains(token, '/playlist/') THEN split_part(split_part(token, '/playlist/', 2), '?', 1) WHEN contains(token, ':playlist:') THEN split_part(token, ':playlist:', 2) ELSE token END AS as_id
  FROM (SELECT playlist_name AS token FROM playlist_tracks UNION SELECT playlist_id FROM playlist_tracks) WHERE trim(token) <> '')"""
_np = library_queries._np
_ID = S.playlist_id(S.strip("playlist_id"))
_TARGETS = f"""{library_queries._PARTS},
asked AS (SELECT 'album' AS kind, album_name AS spec, min(row_id) AS seq FROM spotify_manifest GROUP BY 2 UNION ALL SELECT 'song', track_name, min(row_id) FROM spotify_manifest GROUP BY 2
  UNION ALL SELECT 'soundtrack', album_name, min(row_id) FROM spotify_manifest GROUP BY 2 UNION ALL SELECT 'playlist', playlist_name, min(seq) FROM playlist_tracks GROUP BY 2),
specs AS (SELECT * FROM asked WHERE {S.norm_key('spec')} <> ''),
a1 AS (SELECT spec, folder AS target FROM specs JOIN deep ON kind = 'album' AND folder = {S.normal_path('spec')} AND root = 'albums'),
a2 AS (SELECT spec, folder AS target FROM specs JOIN deep ON kind = 'album' AND {S.norm_key(S.basename('folder'))} = {S.norm_key('spec')} AND root = 'albums' AND i = 2 WHERE spec NOT IN (SELECT spec FROM a1)),
a3 AS (SELECT spec, target FROM specs JOIN (SELECT DISTINCT {S.norm_key('album')} AS key, {S.dirname(_np)} AS target FROM library WHERE {S.dirname(_np)} <> '') ON kind = 'album' AND key = {S.norm_key('spec')} WHERE spec NOT IN (SELECT spec FROM a1) AND spec NOT IN (SELECT spec FROM a2)),
k AS (SELECT spec, CASE WHEN contains(spec, ' - ') THEN split_part(spec, ' - ', 1) ELSE '' END AS artist, {S.norm_key("CASE WHEN contains(spec, ' - ') THEN regexp_replace(spec, '(?s)^.*? - ', '') ELSE spec END")} AS nt FROM specs WHERE kind = 'song'),
c AS (SELECT path, {S.norm_key('title')} AS nt, list_filter(list_transform(list_concat({S.split_artists('artist')}, {S.split_artists('albumartist')}), lambda a: {S.norm_key('a')}), lambda a: a <> '') AS names FROM library),
s1 AS (SELECT DISTINCT spec, {_np} AS target FROM specs JOIN library ON kind = 'song' AND {_np} = {S.normal_path('spec')}),
s2 AS (SELECT DISTINCT spec, path AS target FROM k JOIN c ON k.nt = c.nt WHERE k.nt <> '' AND (artist = '' OR list_has_any(list_transform({S.split_artists('artist')}, lambda a: {S.norm_key('a')}), names)) AND spec NOT IN (SELECT spec FROM s1)),
d1 AS (SELECT spec, folder AS target FROM specs JOIN deep ON kind = 'soundtrack' AND root = 'downloads' AND {S.norm_key(S.basename('folder'))} = {S.norm_key('spec')}),
entries AS (SELECT DISTINCT playlist, name, coalesce(path, concat('lost/', track_name)) AS path FROM (SELECT {_ID} AS playlist, playlist_name AS name, track_name FROM playlist_tracks) r LEFT JOIN (SELECT title, {_np} AS path FROM library) f ON r.track_name = f.title
  WHERE coalesce(playlist, '') <> '' AND coalesce(path, track_name) IS NOT NULL),
p1 AS (SELECT DISTINCT s.spec, e.playlist, e.path, e.path IN (SELECT {_np} FROM library) AS there FROM specs s JOIN entries e ON s.kind = 'playlist' AND {S.norm_key('s.spec')} = {S.norm_key('e.name')}),
hits AS (SELECT 'album' AS kind, 'folders' AS bucket, * FROM (SELECT * FROM a1 UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a3) UNION ALL SELECT 'song', 'files', * FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2)
  UNION ALL SELECT 'soundtrack', 'folders', * FROM d1 UNION ALL SELECT DISTINCT 'playlist', 'm3u8', spec, playlist FROM p1),
targets AS (SELECT bucket, target, min(seq) AS seq FROM (SELECT * FROM hits UNION ALL SELECT 'playlist', 'files', spec, path FROM p1 WHERE there) h JOIN specs s ON h.kind = s.kind AND h.spec = s.spec GROUP BY 1, 2)"""
_COLLECT = f"""files AS (SELECT DISTINCT {_np} AS path FROM library),
items AS (SELECT f.path, 0 AS bucket, t.seq FROM targets t JOIN files f ON t.bucket = 'folders' AND starts_with(f.path, concat(t.target, '/')) UNION ALL SELECT target, 1, seq FROM targets WHERE bucket = 'files' UNION ALL SELECT concat('playlists/', target, '.m3u8'), 2, seq FROM targets WHERE bucket = 'm3u8'),
plan AS (SELECT path AS rel, bucket, seq FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY bucket, seq) AS n FROM items WHERE NOT starts_with(path, 'singles/')) WHERE n = 1)"""
_lext = f"lower({S.extension('rel')})"
_count = lambda step, n: " UNION ALL ".join(f"SELECT '{step}' AS step, '{a}' AS action, (SELECT count(*) FROM plan WHERE {c}) AS n" for a, c in n.items())
_there, _gone, _list = f"{_lext} IN ('.mp3', '.m4a', '.m3u8')", "starts_with(rel, 'downloads/')", f"{_lext} = '.m3u8'"
_AND = " AND "
_M3U = track_queries.SQL["q_m3u_lines"]
_STEM = S.sanitize("coalesce(playlist_name, p.playlist_id, 'Unknown')", S._ILLEGAL_2)
_FILES = f"""{_M3U[:_M3U.index('SELECT playlist_id, seq, 0 AS part')].rstrip()}, lines AS ({_M3U[_M3U.index('SELECT playlist_id, seq, 0 AS part'):]}),
named AS (SELECT {_STEM} AS stem, x.* FROM lines x JOIN playlist_tracks p ON x.seq = p.seq),
begins AS (SELECT stem, playlist_id, min(seq) AS start FROM named GROUP BY 1, 2),
lasts AS (SELECT stem, playlist_id FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY start DESC, playlist_id DESC) AS n FROM begins) WHERE n = 1),
kept AS (SELECT n.stem, seq, part, line FROM named n JOIN lasts l ON n.stem = l.stem AND n.playlist_id = l.playlist_id),
whole AS (SELECT * FROM kept UNION ALL SELECT stem, -1, 0, '#EXTM3U' FROM lasts)"""
_PLAN = f"WITH {album_queries._LIB}, {album_queries._PLAN}"
_dirs = lambda path: f"SELECT DISTINCT array_to_string(p[1:i], '/') AS path FROM (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT string_split({S.dirname(S.normal_path(path))}, '/') AS p FROM plan WHERE {S.dirname(S.normal_path(path))} <> ''))"
_NOW = "CASE WHEN move THEN dst ELSE path END"

SQL = {
    "q_json_flatten": "SELECT seq, coalesce(track_id, '') AS track_id, track_name, coalesce(artist_names, '') AS artist_names, coalesce(album_name, '') AS album_name, duration_ms, explicit, popularity, coalesce(added_at, '') AS added_at, added_by, coalesce(spotify_url, '') AS spotify_url FROM playlist_tracks WHERE track_name IS NOT NULL",
    "q_playlist_pages": "SELECT coalesce(id, '') AS id, coalesce(name, '') AS name, coalesce(description, '') AS description, coalesce(owner, '') AS owner, public, track_count, coalesce(playlist_url, '') AS playlist_url FROM playlists",
    "q_saved_tracks": f"WITH {_SAVED} SELECT * FROM saved",
    "q_all_tracks": f"WITH {_ALL} SELECT seq, playlist_id, track_id, track_name FROM every",
    "q_manifest_all": f"WITH {_ALL}, " + track_queries._MANIFEST.replace("FROM playlist_tracks WHERE", "FROM every WHERE") + "SELECT track_id, playlist_names, playlist_count, explicit, slot, place FROM manifest",
    "q_ranked_albums": "SELECT CAST(row_id AS INTEGER) AS rank, coalesce(album_name, '') AS title, coalesce(artist_names, '') AS artist, CAST(year(exported_at) AS VARCHAR) AS year, concat('al', row_id) AS album_id, '' AS spotify_url FROM spotify_manifest ORDER BY row_id LIMIT 200",
    "q_album_links": f"WITH {_ALBUMS} SELECT rank, regexp_extract(link, '/album/([A-Za-z0-9]+)', 1) AS album_id, md5(title) AS uri_id, link <> '' AS listed FROM albums",
    "q_album_tracks": f"""WITH {_ALBUMS}, t AS (SELECT rank, m.* FROM albums JOIN spotify_manifest m ON m.album_name = title WHERE link <> '' AND coalesce(m.spotify_url, '') <> '')
SELECT coalesce(track_id, '') AS track_id, coalesce(track_name, '') AS track_name, coalesce(artist_names, '') AS artist_names, album_name, coalesce(duration_ms, 0) AS duration_ms, coalesce(explicit, false) AS explicit, 0 AS popularity, 0 AS playlist_count, spotify_url
FROM (SELECT *, row_number() OVER (PARTITION BY spotify_url ORDER BY rank, row_id) AS n FROM t) WHERE n = 1""",
    "q_ranked_export": f"""WITH {_ALBUMS} SELECT 'link' AS what, link AS value FROM albums WHERE link <> '' UNION ALL SELECT 'album', concat_ws('|', rank, title, nullif(artist, '')) FROM albums
UNION ALL SELECT 'missing', CAST(rank AS VARCHAR) FROM albums WHERE link = ''""",
    "q_playlists_csv": "SELECT nullif(id, '') AS id, nullif(name, '') AS name, nullif(description, '') AS description, nullif(owner, '') AS owner, public, track_count, nullif(playlist_url, '') AS playlist_url FROM playlists",
    "q_single_playlist": "SELECT count(*) AS n_rows, CAST(sum(duration_ms) AS BIGINT) AS ms, count(*) FILTER (WHERE explicit) AS n_explicit, count(*) AS n_links FROM playlist_tracks WHERE playlist_id = (SELECT min(playlist_id) FROM playlist_tracks)",
    "q_manifest_export": f"""WITH m AS (SELECT {_p('spotify_url')} AS url, popularity FROM spotify_manifest WHERE coalesce(track_name, '') <> '' AND {_p('spotify_url')} <> '')
SELECT DISTINCT 'folder' AS source, url FROM m UNION ALL SELECT DISTINCT 'tables', url FROM m WHERE popularity IS NOT NULL UNION ALL SELECT DISTINCT 'table', url FROM m WHERE popularity IS NULL UNION ALL SELECT DISTINCT 'text', url FROM m WHERE popularity >= 50""",
    "q_url_order": f"""WITH m AS (SELECT {_p('spotify_url')} AS url, min(row_id) AS first FROM spotify_manifest WHERE coalesce(track_name, '') <> '' GROUP BY 1) SELECT url, row_number() OVER (ORDER BY first) - 1 AS place FROM m WHERE url <> ''""",
    "q_metadata_files": f"""WITH r AS (SELECT 1 AS file, row_id AS pos, spotify_url, artist_names, track_name, '' AS album_name FROM spotify_manifest WHERE coalesce(track_name, '') <> '' UNION ALL SELECT 2, seq, spotify_url, artist_names, track_name, album_name FROM playlist_tracks)
SELECT url, artist, track, album FROM (SELECT {_p('spotify_url')} AS url, {_p('artist_names')} AS artist, {_p('track_name')} AS track, {_p('album_name')} AS album, row_number() OVER (PARTITION BY {_p('spotify_url')} ORDER BY file, pos) AS n FROM r) WHERE n = 1 AND url <> ''""",
    "q_catalog_file": f"SELECT path, artist, albumartist, album, title, coalesce({S.track_int('track')}, 0) AS track, length FROM library",
    "q_listing_file": f"SELECT {S.clean_text('year')} AS year, count(*) AS n_rows, count(DISTINCT nullif({S.clean_text('album')}, '')) AS n_albums FROM library GROUP BY 1",
    "q_log_files": f"WITH {_LOG} SELECT url, coalesce(string_agg(DISTINCT nullif(reason, ''), ', ' ORDER BY nullif(reason, '')), '') AS reasons FROM log GROUP BY url",
    "q_retry_export": library_queries.SQL["q_retry_report"].replace("SELECT artist, track, album, reasons AS reason", "SELECT reason, spotify_url, place, count(*) FILTER (WHERE artist <> '' OR track <> '') OVER () AS n_named FROM (SELECT artist, track, album, nullif(reasons, '') AS reason") + ")",
    "q_unmatched_export": f"""WITH {track_queries._CASCADE}, u AS (SELECT m.tier, {_p('p.spotify_url')} AS url FROM matches m JOIN playlist_tracks p ON m.seq = p.seq WHERE m.file_id IS NULL)
SELECT tier AS what, count(*) AS n FROM u GROUP BY 1 UNION ALL SELECT 'links', count(DISTINCT nullif(url, '')) FROM u""",
    "q_playlist_files": f"{_FILES} SELECT stem, row_number() OVER (PARTITION BY stem ORDER BY seq, part) - 1 AS place, {S.strip('line')} AS line FROM whole",
    "q_playlist_file_refs": f"""{_FILES}, have AS (SELECT {_np} AS path FROM library WHERE NOT starts_with(path, 'downloads/')), x AS (SELECT *, part = 2 AS listed, substring(line, 4) IN (SELECT path FROM have) AS there FROM kept)
SELECT stem, count(*) FILTER (WHERE listed AND there) AS n_there, count(*) FILTER (WHERE listed AND NOT there) AS n_lost, count(*) FILTER (WHERE part = 0) AS n_ids FROM x GROUP BY stem""",
    "q_file_listing": f"SELECT DISTINCT concat('letter=l', md5(substring({S.basename('path')}, 1, 1))) AS folder, true AS filled FROM library",
    "q_playlist_rows": f"WITH l AS (SELECT DISTINCT {S.strip('id')} AS id, owner FROM playlists WHERE {_p('id')} <> '') SELECT l.id, l.owner, r.seq FROM l LEFT JOIN (SELECT {_ID} AS id, seq FROM playlist_tracks) r ON l.id = r.id",
    "q_playlist_select": f"""WITH {_TOKENS} SELECT 'tokens' AS mode, id, name, owner FROM playlists WHERE id IN (SELECT as_id FROM tokens WHERE length(as_id) >= 16) OR name IN (SELECT token FROM tokens WHERE length(as_id) < 16)
UNION ALL SELECT 'every', id, name, owner FROM playlists UNION ALL SELECT 'mine', id, name, owner FROM playlists WHERE owner = (SELECT min(owner) FROM playlists)""",
    "q_fetch_list": f"""WITH {_TOKENS}, known AS (SELECT name, arg_max(id, epoch_us(exported_at)) AS id FROM playlists WHERE coalesce(name, '') <> '' AND coalesce(id, '') <> '' GROUP BY name)
SELECT token, CASE WHEN length(as_id) >= 16 THEN as_id ELSE k.id END AS id FROM tokens LEFT JOIN known k ON token = name""",
    "q_resolve_targets": f"WITH {_TARGETS} SELECT * FROM targets",
    "q_resolve_problems": f"""WITH {_TARGETS}, n AS (SELECT s.kind, s.spec, count(DISTINCT target) AS n FROM specs s LEFT JOIN hits h ON s.kind = h.kind AND s.spec = h.spec GROUP BY 1, 2)
SELECT kind, spec, CASE WHEN n = 0 THEN concat('no match for ', spec) ELSE concat(spec, ' matched ', n, ' targets') END AS warning FROM n WHERE n <> 1
UNION ALL SELECT 'playlist', spec, concat(playlist, ': ', count(DISTINCT path), ' track(s) not there (skipped)') FROM p1 WHERE NOT there GROUP BY spec, playlist UNION ALL SELECT 'opera', 'x', 'unknown kind opera'""",
    "q_collect_plan": f"WITH {_TARGETS}, {_COLLECT} SELECT rel, bucket, seq FROM plan",
    "q_staged": f"""WITH {_TARGETS}, {_COLLECT} {_count('stage', {'copy': 'false', 'link': f'NOT ({_there}) AND NOT {_gone}', 'skip': _there, 'overwrite': 'false', 'error': f'NOT ({_there}) AND {_gone}'})}
UNION ALL {_count('overwrite', {'copy': f'NOT ({_there})', 'link': 'false', 'skip': 'false', 'overwrite': _there, 'error': 'false'})}
UNION ALL {_count('unstage', {'removed': f'bucket <> 1 AND {_there} AND NOT {_list}', 'protected': f'bucket = 1 AND NOT {_list}', 'missing': f'NOT ({_there}) AND (bucket <> 1 OR {_list})', 'm3u8_removed': _list})}""",
    "q_needs_catalog": f"""WITH {_TARGETS} SELECT 'album' AS kind, EXISTS (SELECT 1 FROM specs WHERE kind = 'album' AND spec NOT IN (SELECT spec FROM a1) AND spec NOT IN (SELECT spec FROM a2)) AS needed
UNION ALL SELECT 'song', EXISTS (SELECT 1 FROM specs WHERE kind = 'song' AND spec NOT IN (SELECT spec FROM s1)) UNION ALL SELECT 'soundtrack', false UNION ALL SELECT 'playlist', false UNION ALL SELECT 'folders', false UNION ALL SELECT 'paths', false""",
    "q_library_actions": f"""{_PLAN} SELECT 'move' AS action, path, dst AS target FROM plan WHERE move UNION ALL SELECT 'tag', {_NOW}, albumartist FROM plan WHERE tag_write
UNION ALL SELECT 'prune', path, NULL FROM ({_dirs('path')}) WHERE path NOT IN ({_dirs(f'({_NOW})')})""",
    "q_moves_shown": f"{_PLAN} SELECT seq, path, dst, greatest((SELECT count(*) FROM plan WHERE move) - 25, 0) AS n_more FROM plan WHERE move ORDER BY seq LIMIT 25",
    "q_folder_listing": f"SELECT folder, label, row_number() OVER (ORDER BY folder) - 1 AS place FROM (SELECT {S.dirname('path')} AS folder, min({S.stem('path')}) AS label FROM library GROUP BY 1)",
    "q_csv_field": "SELECT seq, " + ", ".join(f"""CASE WHEN regexp_matches(coalesce({c}, ''), '[,"\\n]') THEN concat('"', replace({c}, '"', '""'), '"') ELSE coalesce({c}, '') END AS {a}""" for c, a in (("track_name", "title"), ("artist_names", "artists"))) + " FROM playlist_tracks",
}
SQL["q_owned_playlists"] = SQL["q_playlist_pages"] + " WHERE owner = (SELECT min(owner) FROM playlists)"
