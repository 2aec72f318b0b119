"""Queries of deduplication and linkage over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup, matching, ordering
from ..sources.tables import table
from . import function_queries as S


def _tracks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "playlist_tracks")


def q_id_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.id_dedup(_tracks(spark, d))


def q_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The manifest with the place of every row in it."""
    return ordering.numbered(dedup.manifest(_tracks(spark, d)), [F.col("sort_title"), F.col("slot")]).withColumnRenamed("code", "place")


def q_match_exact(spark: SparkSession, d: str) -> DataFrame:
    return matching.match_rows(_tracks(spark, d), table(spark, d, "library"), fuzzy=False).select("seq", "tier", "file_id")


def q_match_cascade(spark: SparkSession, d: str) -> DataFrame:
    return matching.match_rows(_tracks(spark, d), table(spark, d, "library")).select("seq", "tier", "file_id")


def q_match_summary(spark: SparkSession, d: str) -> DataFrame:
    return matching.match_summary(matching.match_rows(_tracks(spark, d), table(spark, d, "library")))


def q_unmatched(spark: SparkSession, d: str) -> DataFrame:
    rows = matching.match_rows(_tracks(spark, d), table(spark, d, "library")).filter(F.col("file_id").isNull())
    return rows.select("seq", "tier").join(_tracks(spark, d).select("seq", "playlist_name", "track_name", "artist_names", "spotify_url"), "seq")


def q_first_seen_url(spark: SparkSession, d: str) -> DataFrame:
    rows = _tracks(spark, d).select(F.trim("spotify_url").alias("url"), "seq", "track_id").filter(F.col("url") != "")
    return ordering.first_seen(rows, ["url"], "seq")


def q_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "spotify_manifest").select("row_id", "spotify_url").filter(F.trim("spotify_url") != "")
    return ordering.batches(rows, [F.col("row_id")], 25)


def q_playlist_places(spark: SparkSession, d: str) -> DataFrame:
    rows = _tracks(spark, d).select("seq", T.playlist_id_of(F.trim("playlist_id")).alias("playlist"), T.track_int(F.col("track_number")).alias("track"))
    placed = ordering.position_in_group(rows.filter("playlist is not null"), ["playlist"], "seq")
    return placed.select("seq", "playlist", "place", T.track_label(F.col("track"), F.col("place")).alias("label"))


def q_playlist_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Playlists as first exported, with every later export put in its place."""
    rows = table(spark, d, "playlists").select(T.strip(F.col("id")).alias("id"), "name", "owner", "track_count", F.unix_micros("exported_at").alias("seq"))
    rows = rows.filter("id <> '' and seq is not null")
    ranked = rows.groupBy("id").agg(F.min(F.struct("seq", "name", "owner", "track_count")).alias("a"), F.max(F.struct("seq", "name", "owner", "track_count")).alias("b"))
    old = ranked.filter(F.col("a.seq") < 1_600_000_000_000_000).select("id", "a.*")
    return ordering.upsert(old, ranked.filter("a.seq < b.seq or a.seq >= 1600000000000000").select("id", "b.*"), "id", "seq")


def q_m3u_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of every playlist file, one row per line, in order of (seq, part): labels are the
    row's own, lengths and paths the file's."""
    files = table(spark, d, "library").select("file_id", "length", F.col("path").alias("file_path"))
    names = _tracks(spark, d).select("seq", "artist_names", "track_name")
    rows = matching.match_rows(_tracks(spark, d), table(spark, d, "library")).filter("file_id is not null").drop("path").join(files, "file_id").join(names, "seq")
    info = F.concat(F.lit("#EXTINF:"), T.ext_seconds(F.col("length")).cast("string"), F.lit(","), T.entry_label(F.col("artist_names"), F.col("track_name")))
    track = F.when(T.strip(F.col("track_id")) != "", F.concat(F.lit("#SPOTIFY:"), T.strip(F.col("track_id"))))
    path = T.relative_path(F.col("file_path"), F.lit("playlists"))
    lines = rows.select("playlist_id", "seq", F.posexplode(F.array(track, info, path)).alias("part", "line"))
    return lines.filter("line is not null").select("playlist_id", "seq", F.col("part").cast("int").alias("part"), "line")


QUERIES = {
    "q_id_dedup": q_id_dedup, "q_manifest": q_manifest, "q_match_exact": q_match_exact, "q_match_cascade": q_match_cascade, "q_match_summary": q_match_summary, "q_unmatched": q_unmatched,
    "q_first_seen_url": q_first_seen_url, "q_batches": q_batches, "q_playlist_places": q_playlist_places, "q_playlist_upsert": q_playlist_upsert, "q_m3u_lines": q_m3u_lines,
}

_KEPT = "track_name, artist_names, album_name, duration_ms, explicit, popularity, spotify_url"
_ID = f"""src AS (SELECT *, coalesce(playlist_name, '') AS pname, coalesce(playlist_id, '') AS pid FROM playlist_tracks WHERE coalesce(track_id, '') <> ''),
firsts AS (SELECT track_id, {_KEPT}, seq AS first_seq FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY seq) AS n FROM src) WHERE n = 1),
names AS (SELECT track_id, pname, seq, pid FROM (SELECT *, row_number() OVER (PARTITION BY track_id, pname ORDER BY seq) AS n FROM src) WHERE n = 1),
lists AS (SELECT f.track_id, coalesce(string_agg(nullif(pname, ''), '; ' ORDER BY seq), '') AS playlist_names, coalesce(string_agg(nullif(pid, ''), '; ' ORDER BY seq), '') AS playlist_ids,
  CAST(count(nullif(pname, '')) AS INTEGER) AS playlist_count FROM names n JOIN firsts f ON n.track_id = f.track_id WHERE pname <> '' OR seq = first_seq GROUP BY 1),
ids AS (SELECT f.track_id, {_KEPT}, playlist_names, playlist_ids, playlist_count, first_seq FROM firsts f JOIN lists l ON f.track_id = l.track_id)"""

_HEADS = f"""q AS (SELECT seq, coalesce(playlist_id, '') AS playlist_id, coalesce(track_id, '') AS track_id, {S.norm_key('track_name')} AS nt, {S.norm_key(S.core_title('track_name'))} AS core0, {S.raw_key('track_name')} AS raw,
  list_transform({S.split_artists('artist_names')}, lambda a: {S.norm_key('a')}) AS artists, {S.norm_key(f"coalesce(({S.split_artists('artist_names')})[1], '')")} AS prim,
  {S.norm_key('album_name')} AS album, track_number AS track, coalesce(CAST(duration_ms AS DOUBLE), 0) / 1000 AS want,
  (coalesce(track_name, '') = '' AND coalesce(artist_names, '') = '') AS no_names FROM playlist_tracks),
c AS (SELECT file_id, path, {S.norm_key('title')} AS nt, {S.norm_key(S.core_title('title'))} AS core, {S.raw_key('title')} AS raw, {S.norm_key('album')} AS c_album, {S.track_int('track')} AS c_track,
  list_filter(list_transform(list_concat({S.split_artists('artist')}, {S.split_artists('albumartist')}), lambda a: {S.norm_key('a')}), lambda a: a <> '') AS c_artists,
  {S.norm_key(f"coalesce(({S.split_artists("CASE WHEN coalesce(artist, '') <> '' THEN artist ELSE albumartist END")})[1], '')")} AS c_prim, coalesce(length, 0) AS length FROM library),
heads AS (SELECT q.*, CASE WHEN core0 <> '' THEN core0 ELSE nt END AS core FROM q WHERE NOT no_names),
"""
_EXACT = """
  SELECT seq, tier, file_id, CASE WHEN want = 0 OR length = 0 OR abs(length - want) <= (CASE tier WHEN 3 THEN 3 ELSE 5 END) THEN 0 ELSE 1 END AS outside, CASE WHEN want = 0 THEN 0 ELSE abs(length - want) END AS gap FROM (
    SELECT h.seq, h.want, c.length, c.file_id, CASE WHEN prim <> '' AND (list_contains(c_artists, prim) OR prim = c_prim OR list_contains(artists, c_prim)) THEN 1
      WHEN list_has_any(artists, c_artists) THEN 2 WHEN album <> '' AND album = c_album THEN 3 END AS tier
    FROM heads h JOIN c ON h.nt = c.nt WHERE h.nt <> '') WHERE tier IS NOT NULL
  UNION ALL SELECT h.seq, 4, c.file_id, CASE WHEN want = 0 OR length = 0 OR abs(length - want) <= 5 THEN 0 ELSE 1 END, CASE WHEN want = 0 THEN 0 ELSE abs(length - want) END
    FROM heads h JOIN c ON h.core = c.core WHERE h.nt <> '' AND c.core <> '' AND c.core <> c.nt AND len(artists) > 0 AND (list_has_any(artists, c_artists) OR prim = c_prim)
  UNION ALL SELECT h.seq, 6, c.file_id, 0, CASE WHEN want = 0 THEN 0 ELSE abs(length - want) END
    FROM heads h JOIN c ON h.raw = c.raw WHERE h.nt = '' AND h.raw <> '' AND ((len(artists) > 0 AND (list_has_any(artists, c_artists) OR prim = c_prim)) OR (album <> '' AND album = c_album))
  UNION ALL SELECT h.seq, 7, c.file_id, 0, CASE WHEN want = 0 THEN 0 ELSE abs(length - want) END
    FROM heads h JOIN c ON h.album = c.c_album AND h.track = c.c_track WHERE h.nt = '' AND album <> '' AND (want = 0 OR length = 0 OR abs(want - length) <= 5)
"""
# The matching-blocks ratio: the longest run that both titles have, the first in the catalogue's
# title and then in the other, is a block; what stands before and behind it is compared alike.
_LONGEST = """list_filter(flatten(list_transform(range(least(length(s), length(t)), 0, -1), lambda n: list_transform(range(1, length(s) - n + 2), lambda i: {'n': n, 'i': i}))),
  lambda x: contains(t, substring(s, x.i, x.n)))[1]"""
_FUZZY = f"""pairs AS (SELECT x.nt AS s, y.nt AS t FROM (SELECT DISTINCT nt FROM c WHERE nt <> '') x JOIN (SELECT DISTINCT nt FROM heads WHERE nt <> '') y ON left(x.nt, 4) = left(y.nt, 4)
  WHERE 2 * least(length(x.nt), length(y.nt)) >= 0.92 * (length(x.nt) + length(y.nt))),
blocks AS (SELECT s AS s0, t AS t0, s, t, CAST(0 AS BIGINT) AS m FROM pairs UNION ALL
  SELECT s0, t0, unnest([left(s, b.i - 1), substring(s, b.i + b.n)]), unnest([left(t, strpos(t, substring(s, b.i, b.n)) - 1), substring(t, strpos(t, substring(s, b.i, b.n)) + b.n)]), unnest([b.n, 0])
  FROM (SELECT s0, t0, s, t, {_LONGEST} AS b FROM blocks WHERE s <> '' AND t <> '') WHERE b IS NOT NULL),
ratios AS (SELECT s0, t0, 2.0::DOUBLE * sum(m) / (length(s0) + length(t0)) AS ratio FROM blocks GROUP BY s0, t0),
fuzzy AS (SELECT h.seq, 5 AS tier, c.file_id, 0 AS outside, -ratio AS gap FROM heads h JOIN ratios ON h.nt = t0 AND ratio >= 0.92 JOIN c ON c.nt = s0 WHERE want = 0 OR length = 0 OR abs(want - length) <= 3),
"""
_BEST = """best AS (SELECT seq, tier, file_id FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY tier, outside, gap, file_id) AS n FROM found) WHERE n = 1),
reps AS (SELECT seq, playlist_id, track_id, no_names, CASE WHEN track_id <> '' THEN min(seq) OVER (PARTITION BY playlist_id, track_id) ELSE seq END AS rep FROM q),
matches AS (SELECT r.seq, r.playlist_id, r.track_id, CASE b.tier WHEN 1 THEN 'title+primary' WHEN 2 THEN 'title+artist' WHEN 3 THEN 'title+album' WHEN 4 THEN 'core-title' WHEN 5 THEN 'fuzzy' WHEN 6 THEN 'raw-title' WHEN 7 THEN 'album+track'
  ELSE CASE WHEN h.no_names THEN 'local-no-meta' ELSE 'unmatched' END END AS tier, b.file_id FROM reps r JOIN q h ON r.rep = h.seq LEFT JOIN best b ON r.rep = b.seq)"""
_MATCH = f"{_HEADS}found AS ({_EXACT}), {_BEST}"
_CASCADE = f"RECURSIVE {_HEADS}{_FUZZY}found AS ({_EXACT} UNION ALL SELECT * FROM fuzzy), {_BEST}"

_MANIFEST = f"""{_ID}, keyed AS (SELECT *, {S.fuzzy_key('artist_names', 'track_name')} AS key FROM ids),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY coalesce(popularity, 0) DESC, first_seq) AS n, count(*) OVER (PARTITION BY key) AS m, min(first_seq) OVER (PARTITION BY key) AS slot FROM keyed),
united AS (SELECT key, array_to_string(list_sort(list_distinct(list_filter(flatten(list(string_split(playlist_names, '; '))), lambda x: x <> ''))), '; ') AS names,
  len(list_distinct(list_filter(flatten(list(string_split(playlist_names, '; '))), lambda x: x <> ''))) AS k FROM keyed GROUP BY key),
manifest AS (SELECT track_id, track_name, artist_names, album_name, duration_ms, explicit, popularity, spotify_url, CASE WHEN m > 1 THEN names ELSE playlist_names END AS playlist_names, playlist_ids,
  CAST(CASE WHEN m > 1 THEN k ELSE playlist_count END AS INTEGER) AS playlist_count, slot, lower(coalesce(track_name, '')) AS sort_title,
  row_number() OVER (ORDER BY lower(coalesce(track_name, '')), slot) - 1 AS place FROM ranked r JOIN united u ON r.key = u.key WHERE n = 1)
"""

SQL = {
    "q_id_dedup": f"WITH {_ID} SELECT * FROM ids",
    "q_manifest": f"WITH {_MANIFEST}SELECT * FROM manifest",
    "q_match_exact": f"WITH {_MATCH} SELECT seq, tier, file_id FROM matches",
    "q_match_cascade": f"WITH {_CASCADE} SELECT seq, tier, file_id FROM matches",
    "q_match_summary": f"""WITH {_CASCADE} SELECT playlist_id, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(file_id) AS BIGINT) AS n_matched FROM matches GROUP BY playlist_id
UNION ALL SELECT NULL, CAST(count(*) AS BIGINT), CAST(count(file_id) AS BIGINT) FROM matches""",
    "q_unmatched": f"WITH {_CASCADE} SELECT m.seq, m.tier, p.playlist_name, p.track_name, p.artist_names, p.spotify_url FROM matches m JOIN playlist_tracks p ON m.seq = p.seq WHERE m.file_id IS NULL",
    "q_first_seen_url": "SELECT url, seq, track_id FROM (SELECT trim(spotify_url) AS url, seq, track_id, row_number() OVER (PARTITION BY trim(spotify_url) ORDER BY seq) AS n FROM playlist_tracks WHERE trim(coalesce(spotify_url, '')) <> '') WHERE n = 1",
    "q_batches": "SELECT row_id, spotify_url, CAST(floor((row_number() OVER (ORDER BY row_id) - 1) / 25) AS BIGINT) AS batch FROM spotify_manifest WHERE trim(coalesce(spotify_url, '')) <> ''",
    "q_playlist_places": f"""SELECT seq, playlist, CAST(place AS BIGINT) AS place, printf('%02d', CAST(coalesce(nullif(track, 0), place) AS INTEGER)) AS label FROM (SELECT seq, {S.playlist_id('trim(playlist_id)')} AS playlist, track_number AS track,
  row_number() OVER (PARTITION BY {S.playlist_id('trim(playlist_id)')} ORDER BY seq) AS place FROM playlist_tracks)""",
    "q_playlist_upsert": f"""WITH p AS (SELECT {S.strip('id')} AS id, name, owner, track_count, epoch_us(exported_at) AS seq FROM playlists WHERE {S.strip(S.t('id'))} <> '' AND exported_at IS NOT NULL),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq, name NULLS FIRST, owner NULLS FIRST, track_count NULLS FIRST) AS n FROM p) WHERE n = 1),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC, name DESC NULLS LAST, owner DESC NULLS LAST, track_count DESC NULLS LAST) AS n FROM p) WHERE n = 1),
top AS (SELECT max(seq) AS last FROM a WHERE seq < 1600000000000000)
SELECT a.id, CASE WHEN a.seq < 1600000000000000 THEN a.seq ELSE last + 1 + b.seq END AS place, b.name, b.owner, b.track_count FROM a JOIN b ON a.id = b.id CROSS JOIN top WHERE a.seq < b.seq OR a.seq >= 1600000000000000
UNION ALL SELECT a.id, a.seq, a.name, a.owner, a.track_count FROM a JOIN b ON a.id = b.id WHERE a.seq = b.seq AND a.seq < 1600000000000000""",
    "q_m3u_lines": f"""WITH {_CASCADE} , m AS (SELECT x.playlist_id, x.seq, {S.strip('x.track_id')} AS track_id, p.artist_names, p.track_name, l.length, l.path FROM matches x JOIN library l ON x.file_id = l.file_id JOIN playlist_tracks p ON x.seq = p.seq)
SELECT playlist_id, seq, 0 AS part, concat('#SPOTIFY:', track_id) AS line FROM m WHERE track_id <> ''
UNION ALL SELECT playlist_id, seq, 1, concat('#EXTINF:', CAST({S.ext_seconds('length')} AS VARCHAR), ',', {S.entry_label('artist_names', 'track_name')}) FROM m
UNION ALL SELECT playlist_id, seq, 2, concat('../', {S.normal_path('path')}) FROM m""",
}
