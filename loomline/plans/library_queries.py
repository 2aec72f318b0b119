"""Queries of existence, failures, resolution, removal and inventory over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import existence, ordering, resolve
from ..operators.references import bare_id
from ..sources.tables import table
from . import function_queries as S


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "spotify_manifest").select("row_id", "artist_names", "track_name")


def _stems(spark: SparkSession, d: str) -> DataFrame:
    return existence.library_stems(table(spark, d, "library"), "path")


def q_on_disk(spark: SparkSession, d: str) -> DataFrame:
    return existence.on_disk(_manifest(spark, d), _stems(spark, d), "artist_names", "track_name").select("row_id", "stem_key")


def q_missing(spark: SparkSession, d: str) -> DataFrame:
    return existence.missing(_manifest(spark, d), _stems(spark, d), "artist_names", "track_name").select("row_id", "stem_key")


def q_existing_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = _manifest(spark, d).withColumn("stem_key", existence.predicted_stem("artist_names", "track_name")).join(_stems(spark, d).withColumn("there", F.lit(True)), "stem_key", "left")
    return rows.agg(F.count_if(F.col("there").isNotNull()).alias("existing"), F.count_if(F.col("there").isNull()).alias("new"), F.count_if(T.text(F.col("artist_names")) == "").alias("no_metadata"))


def _log_lines(spark: SparkSession, d: str) -> DataFrame:
    """The failure lines in the texts of the retry logs: what follows the level word."""
    docs = table(spark, d, "documents").filter("source = 'retry_log'")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    return lines.select(F.regexp_replace("raw", r"^\S+ (?:WARN|ERROR) ", "").alias("line"), (F.col("doc_id") * 1_000_000 + F.col("at")).alias("seq"))


def q_log_parse(spark: SparkSession, d: str) -> DataFrame:
    return existence.failure_log(_log_lines(spark, d), "line", "seq")


def q_reason_union(spark: SparkSession, d: str) -> DataFrame:
    return existence.reason_union(q_log_parse(spark, d)).select("url", F.array_join("reasons", ", ").alias("reasons"), "first_seq")


def _split(spark: SparkSession, d: str) -> DataFrame:
    metadata = existence.metadata_of(table(spark, d, "playlist_tracks"))
    return existence.retry_split(existence.reason_union(q_log_parse(spark, d)), metadata, _stems(spark, d))


def q_retry_list(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).select("url", "state", "artist", "track", "album")


def q_retry_report(spark: SparkSession, d: str) -> DataFrame:
    """The report with the place of every row in it."""
    return existence.retry_report(_split(spark, d))


def q_failure_class(spark: SparkSession, d: str) -> DataFrame:
    """What every log text means, as the output of a run; a text with an ERROR line counts as exit code 1."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", T.failure_class(F.col("text"), F.col("text").contains(" ERROR ").cast("int")).alias("class"))


def _specs(spark: SparkSession, d: str, column: str) -> DataFrame:
    """Every album or title that playlist rows name is asked for."""
    return table(spark, d, "playlist_tracks").select(F.col(column).alias("spec")).filter(T.text(F.col("spec")) != "").distinct()


def q_resolve_album(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolve_albums(_specs(spark, d, "album_name").filter(T.norm_key(F.col("spec")) != ""), table(spark, d, "library"))


def q_resolve_song(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "spotify_manifest").select(F.concat_ws(" - ", "artist_names", "track_name").alias("spec")).distinct()
    return resolve.resolve_songs(rows, table(spark, d, "library"))


def q_resolve_warnings(spark: SparkSession, d: str) -> DataFrame:
    specs = _specs(spark, d, "album_name").filter(T.norm_key(F.col("spec")) != "")
    return resolve.resolution_warnings(specs, resolve.resolve_albums(specs, table(spark, d, "library")))


def q_resolve_folder(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolve_folders(_specs(spark, d, "album_name"), table(spark, d, "library"), "downloads")


def _entries(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "playlist_tracks").filter("coalesce(track_id, '') <> ''")
    return rows.select(bare_id(F.col("playlist_id")).alias("playlist"), F.col("playlist_name").alias("name"), F.col("track_id").alias("path")).filter("playlist <> ''").distinct()


def q_resolve_playlist(spark: SparkSession, d: str) -> DataFrame:
    """Every playlist of the playlists table by name, with the tracks its rows list; tracks of the manifest are there."""
    specs = table(spark, d, "playlists").select(F.col("name").alias("spec")).filter(T.norm_key(F.col("spec")) != "")
    return resolve.resolve_playlists(specs, _entries(spark, d), table(spark, d, "spotify_manifest").select(F.col("track_id").alias("path")))


def q_removal(spark: SparkSession, d: str) -> DataFrame:
    """Deleted playlists are removed; tracks that other playlists have too stay."""
    gone = table(spark, d, "playlists").filter("deleted_at is not null").select(bare_id(F.col("id")).alias("playlist")).distinct()
    entries = _entries(spark, d).select("playlist", "path").distinct()
    removed, left = entries.join(gone, "playlist", "left_semi"), entries.join(gone, "playlist", "left_anti")
    return resolve.removal(removed, left, table(spark, d, "spotify_manifest").select(F.col("track_id").alias("path")))


def q_stage_actions(spark: SparkSession, d: str) -> DataFrame:
    """Album files and singles to a mirror in which those of compressed kinds are there already."""
    files = table(spark, d, "library").select(F.concat(F.lit("root/"), "path").alias("path"), F.col("file_id").alias("seq"), F.when(F.col("path").startswith("albums/"), 0).otherwise(1).alias("bucket"))
    plan = resolve.collect_plan(files, "root")
    present = plan.filter(F.lower(T.extension(F.col("rel"))).isin(".mp3", ".m4a", ".opus")).select("rel")
    return resolve.stage_actions(plan, present).join(plan, "rel").select("rel", "action", "bucket", "seq")


def q_stage_summary(spark: SparkSession, d: str) -> DataFrame:
    n = lambda a: F.count_if(F.col("action") == a)
    counts = q_stage_actions(spark, d).agg(n("copy").alias("copied"), n("skip").alias("skipped"), n("overwrite").alias("overwritten"))
    said = T.counted_summary([(F.col("copied"), "copied"), (F.col("overwritten"), "overwritten"), (F.col("skipped"), "already present (skipped)")])
    return counts.withColumn("said", said)


def q_inventory(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "library").select("path", F.bround(F.col("length") * 40000, 0).cast("long").alias("size"))
    return resolve.inventory(files)


def q_scoped_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Rows of playlists that were exported again after their first month are replaced by the rows of that later time."""
    rows = table(spark, d, "playlist_tracks").select("seq", bare_id(F.col("playlist_id")).alias("playlist"), F.unix_micros("exported_at").alias("at")).filter("playlist <> '' and at is not null")
    first = rows.groupBy("playlist").agg(F.min("at").alias("start"))
    aged = rows.join(first, "playlist").withColumn("late", F.col("at") - F.col("start") > 30 * 86_400_000_000).drop("at", "start")
    return resolve.scoped_refresh(aged.filter("not late").drop("late"), aged.filter("late").drop("late"), "playlist")


def q_search_pick(spark: SparkSession, d: str) -> DataFrame:
    """For every manifest row the library file to take, by three looser searches: album and artist, album alone, title alone."""
    key = lambda c: T.norm_key(F.col(c))
    m = table(spark, d, "spotify_manifest").select(F.col("row_id").alias("query"), F.col("track_name").alias("wanted"), key("album_name").alias("album_key"), T.norm_key(T.primary_artist(F.col("artist_names"))).alias("act_key"), key("track_name").alias("title_key"))
    lib = table(spark, d, "library").filter("title is not null").select(F.col("file_id").alias("id"), "title", key("album").alias("album_key"), T.norm_key(T.primary_artist(F.col("artist"))).alias("act_key"), key("title").alias("title_key"))
    hits = None
    for n, keys in enumerate((["album_key", "act_key"], ["album_key"], ["title_key"]), 1):
        named = [F.col(k) != "" for k in keys]
        asked = m.filter(named[0] & named[-1]).select("query", "wanted", *keys)
        found = asked.join(lib.select("id", "title", *keys), keys).select("query", F.lit(n).alias("search"), F.col("id").alias("pos"), "title", "wanted", "id")
        hits = found if hits is None else hits.unionByName(found)
    return resolve.pick_hit(hits)


def q_top_ranked(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "spotify_manifest").filter("popularity between 0 and 100")
    return rows.orderBy(F.desc("popularity"), "row_id").select("row_id", "popularity", "track_id").limit(200)


def q_library_totals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "library").agg(F.count("*").alias("n_rows"), F.count_distinct(T.norm_key(F.col("album"))).alias("n_albums"))


QUERIES = {f.__name__: f for f in (
    q_on_disk, q_missing, q_existing_counts, q_log_parse, q_reason_union, q_retry_list, q_retry_report, q_failure_class, q_resolve_album, q_resolve_song, q_resolve_warnings, q_resolve_folder,
    q_resolve_playlist, q_removal, q_stage_actions, q_stage_summary, q_inventory, q_scoped_refresh, q_search_pick, q_top_ranked, q_library_totals,
)}

_ext = f"lower({S.extension('path')})"
_AUDIO = "('.mp3', '.flac', '.m4a', '.opus', '.ogg', '.wav', '.aac')"
_STEM = S.unicode_normalize(S.stem(S.predicted("artist_names", "track_name")))
_STEMS = f"stems AS (SELECT DISTINCT {S.unicode_normalize(S.stem('path'))} AS stem_key FROM library WHERE {S.dirname(S.normal_path('path'))} = 'singles' AND {_ext} IN {_AUDIO})"
_LOG = rf"""lines AS (SELECT doc_id, raw, k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents WHERE source = 'retry_log')),
stripped AS (SELECT {S.strip(r"regexp_replace(raw, '^\S+ (?:WARN|ERROR) ', '')")} AS line, CAST(doc_id * 1000000 + k AS BIGINT) AS seq FROM lines),
log AS (SELECT regexp_extract(line, '^(\S+)(?:\s+#\s*(.*))?$', 1) AS url, {S.strip(r"regexp_extract(line, '^(\S+)(?:\s+#\s*(.*))?$', 2)")} AS reason, seq FROM stripped
  WHERE regexp_matches(line, '^(\S+)(?:\s+#\s*(.*))?$') AND NOT starts_with(line, '#'))"""
_REASONS = """firsts AS (SELECT url, reason, min(seq) AS seq FROM log GROUP BY 1, 2),
unions AS (SELECT url, coalesce(string_agg(nullif(reason, ''), ', ' ORDER BY seq), '') AS reasons, min(seq) AS first_seq, coalesce(bool_or(reason = 'track_unavailable'), false) AS hard FROM firsts GROUP BY url)"""
_p = lambda c: S.strip(S.t(c))
_RETRY = f"""meta AS (SELECT url, artist, track, album FROM (SELECT {_p('spotify_url')} AS url, {_p('artist_names')} AS artist, {_p('track_name')} AS track, {_p('album_name')} AS album,
  row_number() OVER (PARTITION BY {_p('spotify_url')} ORDER BY seq) AS n FROM playlist_tracks WHERE {_p('spotify_url')} <> '') WHERE n = 1),
named AS (SELECT u.url, reasons, first_seq, coalesce(artist, '') AS artist, coalesce(track, '') AS track, coalesce(album, '') AS album FROM unions u LEFT JOIN meta m ON u.url = m.url WHERE NOT hard),
split AS (SELECT n.*, CASE WHEN artist = '' OR track = '' THEN 'no_metadata' WHEN s.stem_key IS NOT NULL THEN 'on_disk' ELSE 'retry' END AS state FROM named n LEFT JOIN stems s ON s.stem_key = {S.unicode_normalize(S.stem(S.predicted('artist', 'track')))})"""
_np = S.normal_path("path")
_PARTS = f"dirs AS (SELECT DISTINCT string_split({S.dirname(_np)}, '/') AS p FROM library), deep AS (SELECT DISTINCT array_to_string(p[1:i], '/') AS folder, p[1] AS root, i FROM (SELECT p, unnest(range(2, len(p) + 1)) AS i FROM dirs WHERE len(p) > 1))"
_ALBUM = f"""{_PARTS}, specs AS (SELECT DISTINCT album_name AS spec FROM playlist_tracks WHERE {S.norm_key('album_name')} <> ''),
r1 AS (SELECT spec, 'path' AS via, folder AS target FROM specs JOIN deep ON folder = {S.normal_path('spec')} AND root = 'albums'),
r2 AS (SELECT spec, 'folder' AS via, folder AS target FROM specs JOIN deep ON {S.norm_key(S.basename('folder'))} = {S.norm_key('spec')} AND root = 'albums' AND i = 2 WHERE spec NOT IN (SELECT spec FROM r1)),
tags AS (SELECT DISTINCT {S.norm_key('album')} AS key, {S.dirname(_np)} AS target FROM library WHERE {S.dirname(_np)} <> ''),
r3 AS (SELECT spec, 'tag' AS via, target FROM specs JOIN tags ON key = {S.norm_key('spec')} WHERE spec NOT IN (SELECT spec FROM r1) AND spec NOT IN (SELECT spec FROM r2)),
found AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3)"""
_BARE = lambda c: rf"""CASE WHEN regexp_extract({_b(c)}, '^(?:.*[/:])?([^/:?#\s]+)/?(?:[?#].*)?$', 1) <> '' THEN regexp_extract({_b(c)}, '^(?:.*[/:])?([^/:?#\s]+)/?(?:[?#].*)?$', 1) ELSE {_b(c)} END"""
_b = lambda c: rf"regexp_replace(coalesce({c}, ''), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_ENTRIES = f"entries AS (SELECT DISTINCT * FROM (SELECT {_BARE('playlist_id')} AS playlist, playlist_name AS name, track_id AS path FROM playlist_tracks WHERE coalesce(track_id, '') <> '') WHERE playlist <> '')"
_ACTIONS = f"""plan AS (SELECT rel, bucket, seq FROM (SELECT *, row_number() OVER (PARTITION BY rel ORDER BY bucket, seq) AS n FROM (SELECT {_np} AS rel, file_id AS seq, CASE WHEN starts_with(path, 'albums/') THEN 0 ELSE 1 END AS bucket FROM library)) WHERE n = 1),
actions AS (SELECT rel, CASE WHEN lower({S.extension('rel')}) IN ('.mp3', '.m4a', '.opus') THEN 'skip' ELSE 'copy' END AS action, bucket, seq FROM plan)"""

SQL = {
    "q_on_disk": f"WITH {_STEMS} SELECT row_id, {_STEM} AS stem_key FROM spotify_manifest WHERE {_STEM} IN (SELECT stem_key FROM stems)",
    "q_missing": f"WITH {_STEMS} SELECT row_id, {_STEM} AS stem_key FROM spotify_manifest WHERE {_STEM} NOT IN (SELECT stem_key FROM stems)",
    "q_existing_counts": f"WITH {_STEMS} SELECT count(*) FILTER (WHERE {_STEM} IN (SELECT stem_key FROM stems)) AS existing, count(*) FILTER (WHERE {_STEM} NOT IN (SELECT stem_key FROM stems)) AS new, count(*) FILTER (WHERE coalesce(artist_names, '') = '') AS no_metadata FROM spotify_manifest",
    "q_log_parse": f"WITH {_LOG} SELECT url, reason, seq FROM log",
    "q_reason_union": f"WITH {_LOG}, {_REASONS} SELECT url, reasons, first_seq FROM unions",
    "q_retry_list": f"WITH {_STEMS}, {_LOG}, {_REASONS}, {_RETRY} SELECT url, state, artist, track, album FROM split",
    "q_retry_report": f"""WITH {_STEMS}, {_LOG}, {_REASONS}, {_RETRY} SELECT artist, track, album, reasons AS reason, url AS spotify_url, {S.search_url('artist', 'track')} AS search, artist = '' AS no_artist, first_seq,
  row_number() OVER (ORDER BY artist = '', lower(artist), lower(album), lower(track), first_seq) - 1 AS place FROM split WHERE state <> 'on_disk'""",
    "q_failure_class": """SELECT doc_id, CASE WHEN contains(text, 'Track no longer exists') OR contains(text, 'SongError') THEN 'track_unavailable' WHEN contains(text, ' ERROR ') THEN 'download_failed' WHEN contains(text, 'AudioProviderError') THEN 'AudioProviderError'
  WHEN contains(text, 'LookupError') THEN 'LookupError' WHEN contains(text, 'PermissionError') THEN 'PermissionError' WHEN contains(text, 'No results found') THEN 'No results found' WHEN contains(text, 'YT-DLP download error') THEN 'YT-DLP download error'
  WHEN contains(text, 'returned no usable results') THEN 'returned no usable results' ELSE 'ok' END AS class FROM documents""",
    "q_resolve_album": f"WITH {_ALBUM} SELECT * FROM found",
    "q_resolve_warnings": f"""WITH {_ALBUM}, k AS (SELECT s.spec, count(DISTINCT target) AS n FROM specs s LEFT JOIN found f ON s.spec = f.spec GROUP BY 1)
SELECT spec, n, CASE WHEN n = 0 THEN concat('no match for ', spec) WHEN n > 1 THEN concat(spec, ' matched ', n, ' targets') END AS warning FROM k""",
    "q_resolve_folder": f"WITH {_PARTS}, specs AS (SELECT DISTINCT album_name AS spec FROM playlist_tracks WHERE coalesce(album_name, '') <> '') SELECT spec, 'folder' AS via, folder AS target FROM specs JOIN deep ON root = 'downloads' AND {S.norm_key(S.basename('folder'))} = {S.norm_key('spec')}",
    "q_resolve_song": f"""WITH specs AS (SELECT spec, CASE WHEN contains(spec, ' - ') THEN split_part(spec, ' - ', 1) ELSE '' END AS artist, CASE WHEN contains(spec, ' - ') THEN regexp_replace(spec, '(?s)^.*? - ', '') ELSE spec END AS title FROM (SELECT DISTINCT concat_ws(' - ', artist_names, track_name) AS spec FROM spotify_manifest)),
k AS (SELECT spec, artist, {S.norm_key('title')} AS nt, list_transform({S.split_artists('artist')}, lambda a: {S.norm_key('a')}) AS wanted FROM specs),
c AS (SELECT path, {S.norm_key('title')} AS nt, list_filter(list_transform(list_concat({S.split_artists('artist')}, {S.split_artists('albumartist')}), lambda a: {S.norm_key('a')}), lambda a: a <> '') AS names FROM library),
r1 AS (SELECT DISTINCT spec, 'path' AS via, {_np} AS target FROM specs JOIN library ON {_np} = {S.normal_path('spec')})
SELECT * FROM r1 UNION ALL SELECT DISTINCT spec, 'title', path FROM k JOIN c ON k.nt = c.nt WHERE k.nt <> '' AND (artist = '' OR list_has_any(wanted, names)) AND spec NOT IN (SELECT spec FROM r1)""",
    "q_resolve_playlist": f"""WITH {_ENTRIES}, specs AS (SELECT DISTINCT name AS spec FROM playlists WHERE {S.norm_key('name')} <> '')
SELECT s.spec, e.playlist, e.path, e.path IN (SELECT track_id FROM spotify_manifest WHERE track_id IS NOT NULL) AS "exists" FROM specs s JOIN entries e ON {S.norm_key('s.spec')} = {S.norm_key('e.name')}""",
    "q_removal": f"""WITH {_ENTRIES}, gone AS (SELECT DISTINCT {_BARE('id')} AS playlist FROM playlists WHERE deleted_at IS NOT NULL),
removed AS (SELECT DISTINCT path FROM entries WHERE playlist IN (SELECT playlist FROM gone)), rest AS (SELECT DISTINCT path FROM entries WHERE playlist NOT IN (SELECT playlist FROM gone))
SELECT path, CASE WHEN path IN (SELECT path FROM rest) THEN 'protected' WHEN path IN (SELECT track_id FROM spotify_manifest WHERE track_id IS NOT NULL) THEN 'remove' ELSE 'missing' END AS action FROM removed""",
    "q_stage_actions": f"WITH {_ACTIONS} SELECT * FROM actions",
    "q_stage_summary": f"""WITH {_ACTIONS}, n AS (SELECT count(*) FILTER (WHERE action = 'copy') AS copied, count(*) FILTER (WHERE action = 'skip') AS skipped, count(*) FILTER (WHERE action = 'overwrite') AS overwritten FROM actions)
SELECT *, CASE WHEN copied + skipped + overwritten = 0 THEN 'nothing to do' ELSE concat_ws(', ', CASE WHEN copied > 0 THEN concat(copied, ' copied') END, CASE WHEN overwritten > 0 THEN concat(overwritten, ' overwritten') END, CASE WHEN skipped > 0 THEN concat(skipped, ' already present (skipped)') END) END AS said FROM n""",
    "q_inventory": f"""WITH r AS (SELECT split_part({_np}, '/', 1) AS sub, regexp_replace({S.dirname(_np)}, '^[^/]*/?', '') AS folder, CAST(round_even(length * 40000, 0) AS BIGINT) AS size FROM library WHERE split_part({_np}, '/', 1) IN ('albums', 'singles', 'soundtracks', 'playlists')),
g AS (SELECT sub, folder, count(*) AS n_files, count(DISTINCT CASE WHEN folder <> '' THEN concat(sub, '/', folder) END) AS n_folders, CAST(sum(size) AS BIGINT) AS bytes FROM r GROUP BY ROLLUP (sub, folder)) SELECT *, {S.size_text('CAST(bytes AS DOUBLE)')} AS size FROM g""",
    "q_scoped_refresh": f"""WITH r AS (SELECT seq, {_BARE('playlist_id')} AS playlist, epoch_us(exported_at) AS us FROM playlist_tracks WHERE exported_at IS NOT NULL), a AS (SELECT *, us - min(us) OVER (PARTITION BY playlist) > 2592000000000 AS late FROM r WHERE playlist <> '')
SELECT playlist, seq FROM a WHERE late OR playlist NOT IN (SELECT playlist FROM a WHERE late)""",
    "q_search_pick": f"""WITH m AS (SELECT row_id AS query, track_name AS wanted, {S.norm_key('album_name')} AS ak, {S.norm_key(f"coalesce(({S.split_artists('artist_names')})[1], '')")} AS pk, {S.norm_key('track_name')} AS tk FROM spotify_manifest),
l AS (SELECT file_id AS id, title, {S.norm_key('album')} AS ak, {S.norm_key(f"coalesce(({S.split_artists('artist')})[1], '')")} AS pk, {S.norm_key('title')} AS tk FROM library WHERE title IS NOT NULL),
h AS (SELECT query, 1 AS search, id, title, wanted FROM m JOIN l ON m.ak = l.ak AND m.pk = l.pk WHERE m.ak <> '' AND m.pk <> '' UNION ALL SELECT query, 2, id, title, wanted FROM m JOIN l ON m.ak = l.ak WHERE m.ak <> ''
  UNION ALL SELECT query, 3, id, title, wanted FROM m JOIN l ON m.tk = l.tk WHERE m.tk <> '')
SELECT query, id, title FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY search, CASE WHEN lower(title) = lower(wanted) THEN 0 ELSE 1 END, id) AS n FROM h) WHERE n = 1""",
    "q_top_ranked": "SELECT row_id, popularity, track_id FROM spotify_manifest WHERE popularity BETWEEN 0 AND 100 ORDER BY popularity DESC, row_id LIMIT 200",
    "q_library_totals": f"SELECT count(*) AS n_rows, count(DISTINCT {S.norm_key('album')}) AS n_albums FROM library",
}
