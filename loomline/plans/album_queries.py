"""Queries of album groups, votes and plans over the whole library, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import canonical
from ..sources.tables import table
from . import album_plans
from . import function_queries as S


def _files(spark: SparkSession, d: str) -> DataFrame:
    return canonical.grouped(canonical.scan(table(spark, d, "library")))


def _incoming(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Files outside albums/ come in; the whole library is what they meet."""
    library = table(spark, d, "library")
    return library.filter(~T.text(F.col("path")).startswith("albums/")), library


def q_album_groups(spark: SparkSession, d: str) -> DataFrame:
    return canonical.group_sizes(_files(spark, d)).select("group", "kind", "n", F.array_join("folders", "|").alias("folders"))


def q_album_vote(spark: SparkSession, d: str) -> DataFrame:
    return canonical.album_artists(_files(spark, d))


def q_dominant_album(spark: SparkSession, d: str) -> DataFrame:
    return canonical.dominant_albums(_files(spark, d))


def q_cleanup_plan(spark: SparkSession, d: str) -> DataFrame:
    return album_plans.cleanup_plan(table(spark, d, "library"))


def q_cleanup_counters(spark: SparkSession, d: str) -> DataFrame:
    return album_plans.cleanup_counters(q_cleanup_plan(spark, d))


def q_various_top(spark: SparkSession, d: str) -> DataFrame:
    rows = album_plans.various_groups(table(spark, d, "library")).select("group", "album", "n", F.size("folders").alias("n_folders"))
    return rows.orderBy(F.desc("n"), "group").limit(25)


def q_large_groups(spark: SparkSession, d: str) -> DataFrame:
    return canonical.group_sizes(_files(spark, d)).select("group", "n").orderBy(F.desc("n"), "group").limit(15)


def q_existing_albums(spark: SparkSession, d: str) -> DataFrame:
    return canonical.existing_albums(table(spark, d, "library"))


def q_stage_plan(spark: SparkSession, d: str) -> DataFrame:
    return album_plans.stage_plan(*_incoming(spark, d))


def q_stage_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return q_stage_plan(spark, d).select("seq", "outcome", "albumartist", "tag_write", "ambiguous")


def q_stage_report(spark: SparkSession, d: str) -> DataFrame:
    return album_plans.stage_report(q_stage_plan(spark, d))


QUERIES = {
    "q_album_groups": q_album_groups, "q_album_vote": q_album_vote, "q_dominant_album": q_dominant_album, "q_cleanup_plan": q_cleanup_plan, "q_cleanup_counters": q_cleanup_counters,
    "q_various_top": q_various_top, "q_large_groups": q_large_groups, "q_existing_albums": q_existing_albums, "q_stage_plan": q_stage_plan, "q_stage_outcomes": q_stage_outcomes, "q_stage_report": q_stage_report,
}

_p = lambda c: S.strip(S.t(c))
_SCAN = f"""scan AS (SELECT file_id AS seq, coalesce(path, '') AS path, coalesce(nullif({_p('artist')}, ''), nullif({_p('albumartist')}, ''), 'Unknown Artist') AS artist, {_p('albumartist')} AS albumartist, {_p('album')} AS album,
  coalesce(nullif({_p('title')}, ''), {S.stem('path')}) AS title, coalesce({S.track_int('track')}, 0) AS track FROM {{src}}),
f AS (SELECT *, CASE WHEN album <> '' THEN concat('a:', {S.norm_key('album')}) ELSE concat('s:', seq) END AS grp, CASE WHEN albumartist <> '' THEN albumartist ELSE artist END AS raw FROM scan),
sizes AS (SELECT grp, count(*) AS n, CASE WHEN starts_with(grp, 's:') OR count(*) = 1 THEN 'single' ELSE 'album' END AS kind FROM f GROUP BY grp),
v AS (SELECT grp, seq, raw AS val, {S.norm_key('raw')} AS key FROM f WHERE raw <> ''),
v1 AS (SELECT grp, key, count(*) AS n, min(seq) AS s, arg_min(val, seq) AS val FROM v GROUP BY grp, key),
v2 AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, s) AS r, sum(n) OVER (PARTITION BY grp) AS total FROM v1),
t AS (SELECT grp, seq, {S.strip(r"(string_split_regex(raw, '[\s\p{Z}\x1c-\x1f]*(?:&|/)[\s\p{Z}\x1c-\x1f]*'))[1]")} AS val FROM f WHERE raw <> ''),
t1 AS (SELECT grp, {S.norm_key('val')} AS key, count(*) AS n, min(seq) AS s, arg_min(val, seq) AS val FROM t GROUP BY 1, 2),
t2 AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, s) AS r FROM t1),
aa AS (SELECT z.grp, CASE WHEN 2 * v2.n >= total THEN v2.val WHEN 2 * t2.n >= total THEN t2.val ELSE 'Various Artists' END AS aa FROM sizes z LEFT JOIN v2 ON z.grp = v2.grp AND v2.r = 1 LEFT JOIN t2 ON z.grp = t2.grp AND t2.r = 1),
al1 AS (SELECT grp, {S.norm_key('album')} AS key, count(*) AS n, min(seq) AS s, arg_min(album, seq) AS val FROM f WHERE album <> '' GROUP BY 1, 2),
al AS (SELECT z.grp, coalesce(x.val, '') AS al FROM sizes z LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, s) AS r FROM al1) x ON z.grp = x.grp AND x.r = 1)"""
_LIB = _SCAN.replace("{src}", "library")
_IN = _SCAN.replace("{src}", "(SELECT * FROM library WHERE NOT starts_with(coalesce(path, ''), 'albums/'))")
_audio = f"lower({S.extension('path')}) IN ('.mp3', '.flac', '.m4a', '.opus', '.ogg', '.wav', '.aac')"
_split = "string_split(coalesce(path, ''), '/')"
_FOLDER = f"CASE WHEN {_split}[1] = 'albums' AND len({_split}) > 2 THEN concat('albums/', {_split}[2]) END"
_INDEX = f"""walked AS (SELECT *, {_FOLDER} AS top, list_transform({_split}, lambda x, i: {{'deeper': i < len({_split}), 'name': x}}) AS walk FROM library WHERE {_audio}),
reps AS (SELECT top AS folder, {_p('albumartist')} AS aa, {_p('album')} AS al FROM (SELECT *, row_number() OVER (PARTITION BY top ORDER BY walk, file_id) AS n FROM walked WHERE top IS NOT NULL) WHERE n = 1),
idx AS (SELECT {S.norm_key('aa')} AS aa_key, {S.norm_key('al')} AS album_key, count(*) AS n_folders, CASE WHEN count(*) = 1 THEN min(folder) END AS folder, CASE WHEN count(*) = 1 THEN min(aa) END AS existing_aa
  FROM reps WHERE al <> '' GROUP BY 1, 2)"""
_OUTCOME = f"""have AS (SELECT DISTINCT {_FOLDER} AS folder, {S.norm_key('title')} AS title_key FROM library WHERE {_p('title')} <> '' AND {_audio}),
j AS (SELECT f.*, al.al, starts_with(f.grp, 'a:') AS wa, z.n, aa.aa, i.folder, i.existing_aa, coalesce(i.n_folders, 0) AS n_folders, h.folder IS NOT NULL AS owned
  FROM f JOIN sizes z ON f.grp = z.grp JOIN aa ON f.grp = aa.grp JOIN al ON f.grp = al.grp LEFT JOIN idx i ON i.aa_key = {S.norm_key('aa.aa')} AND i.album_key = {S.norm_key('al.al')}
  LEFT JOIN have h ON h.folder = i.folder AND h.title_key = {S.norm_key('f.title')}),
o AS (SELECT *, CASE WHEN wa AND folder IS NOT NULL THEN CASE WHEN owned THEN 'duplicate' ELSE 'merge' END WHEN wa AND n >= 2 THEN 'stage' ELSE 'pass' END AS outcome FROM j),
outcomes AS (SELECT seq, outcome, CASE outcome WHEN 'merge' THEN coalesce(nullif(existing_aa, ''), aa) WHEN 'stage' THEN aa END AS albumartist,
  coalesce(outcome IN ('merge', 'stage') AND {S.norm_key('albumartist')} <> {S.norm_key("CASE outcome WHEN 'merge' THEN coalesce(nullif(existing_aa, ''), aa) ELSE aa END")}, false) AS tag_write, wa AND n_folders > 1 AS ambiguous FROM o)"""

_PLAN = f"""placed AS (SELECT f.*, z.kind, aa.aa, al.al, row_number() OVER (PARTITION BY f.grp ORDER BY f.seq) AS place, {S.extension('f.path')} AS ext FROM f JOIN sizes z ON f.grp = z.grp JOIN aa ON f.grp = aa.grp JOIN al ON f.grp = al.grp),
based AS (SELECT *, concat(printf('%02d', CAST(coalesce(nullif(track, 0), place) AS INTEGER)), ' - ', {S.sanitize('artist')}, ' - ', {S.sanitize('title')}) AS base FROM placed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY grp, lower(base), lower(ext) ORDER BY seq) AS rank FROM based),
dsts AS (SELECT seq, path, kind, CASE kind WHEN 'single' THEN concat('singles/', {S.sanitize('artist')}, ' - ', {S.sanitize('title')}, ext)
  ELSE concat('albums/', {S.folder_name('aa', 'al')}, '/', base, CASE WHEN rank > 1 THEN concat(' (', rank, ')') ELSE '' END, ext) END AS dst, CASE kind WHEN 'album' THEN aa END AS albumartist,
  kind = 'album' AND {S.norm_key('albumartist')} <> {S.norm_key('aa')} AS tag_write FROM ranked),
plan AS (SELECT seq, path, kind, dst, {S.normal_path('dst')} <> {S.normal_path('path')} AS move, albumartist, tag_write FROM dsts)"""

_STAGED = f"""going AS (SELECT *, CASE outcome WHEN 'merge' THEN coalesce(nullif(existing_aa, ''), aa) ELSE aa END AS tag, {S.extension('path')} AS ext,
  CASE WHEN outcome = 'merge' THEN folder ELSE concat('incoming/albums/', {S.folder_name('aa', 'al')}) END AS target,
  concat(printf('%02d', CAST(coalesce(nullif(track, 0), place) AS INTEGER)), ' - ', {S.sanitize('artist')}, ' - ', {S.sanitize('title')}) AS base
  FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY seq) AS place FROM o) WHERE outcome IN ('merge', 'stage')),
named AS (SELECT *, row_number() OVER (PARTITION BY target, lower(base), lower(ext) ORDER BY seq) AS rank FROM going),
goal AS (SELECT *, concat(target, '/', base, CASE WHEN rank > 1 THEN concat(' (', rank, ')') ELSE '' END, ext) AS dst FROM named),
staging AS (SELECT seq, path, outcome, dst, {S.normal_path('dst')} <> {S.normal_path('path')} AS move, tag AS albumartist, {S.norm_key('albumartist')} <> {S.norm_key('tag')} AS tag_write, wa AND n_folders > 1 AS ambiguous FROM goal
  UNION ALL SELECT seq, path, outcome, NULL, false, NULL, false, wa AND n_folders > 1 FROM o WHERE outcome NOT IN ('merge', 'stage'))"""

SQL = {
    "q_stage_plan": f"WITH {_IN}, {_INDEX}, {_OUTCOME}, {_STAGED} SELECT * FROM staging",
    "q_stage_report": f"""WITH {_IN}, {_INDEX}, {_OUTCOME}, {_STAGED} SELECT count(*) AS scanned, count(*) FILTER (WHERE outcome = 'stage') AS staged, count(*) FILTER (WHERE outcome = 'merge') AS merged,
  count(*) FILTER (WHERE outcome = 'duplicate') AS duplicates, count(*) FILTER (WHERE outcome = 'pass') AS passed, count(*) FILTER (WHERE tag_write) AS tag_writes, count(*) FILTER (WHERE ambiguous) AS ambiguous,
  count(DISTINCT CASE WHEN outcome = 'stage' THEN {S.dirname('dst')} END) AS staged_folders, count(DISTINCT CASE WHEN outcome = 'merge' THEN {S.dirname('dst')} END) AS merged_folders FROM staging""",
    "q_cleanup_plan": f"WITH {_LIB}, {_PLAN} SELECT * FROM plan",
    "q_cleanup_counters": f"""WITH {_LIB}, {_PLAN} SELECT count(*) FILTER (WHERE kind = 'album' AND move) AS album_moves, count(*) FILTER (WHERE kind = 'single' AND move) AS single_moves,
  count(*) FILTER (WHERE NOT move) AS in_place, count(*) FILTER (WHERE tag_write) AS tag_writes FROM plan""",
    "q_album_groups": f"WITH {_LIB}, g AS (SELECT grp, string_agg(DISTINCT {S.basename(S.dirname('path'))}, '|' ORDER BY {S.basename(S.dirname('path'))}) AS folders FROM f GROUP BY grp) SELECT z.grp AS group, kind, n, folders FROM sizes z JOIN g ON z.grp = g.grp",
    "q_album_vote": f"WITH {_LIB} SELECT grp AS group, aa AS albumartist_vote FROM aa",
    "q_dominant_album": f"WITH {_LIB} SELECT grp AS group, al AS album_vote FROM al",
    "q_various_top": f"""WITH {_LIB} SELECT z.grp AS group, CASE WHEN al <> '' THEN al ELSE {S.folder_name('aa', 'al')} END AS album, z.n, CAST((SELECT count(DISTINCT {S.basename(S.dirname('path'))}) FROM f WHERE f.grp = z.grp) AS INTEGER) AS n_folders
FROM sizes z JOIN aa ON z.grp = aa.grp JOIN al ON z.grp = al.grp WHERE kind = 'album' AND aa = 'Various Artists' ORDER BY z.n DESC, z.grp LIMIT 25""",
    "q_large_groups": f"WITH {_LIB} SELECT grp AS group, n FROM sizes ORDER BY n DESC, grp LIMIT 15",
    "q_existing_albums": f"WITH {_INDEX} SELECT * FROM idx",
    "q_stage_outcomes": f"WITH {_IN}, {_INDEX}, {_OUTCOME} SELECT * FROM outcomes",
}
for _k in ("q_album_groups", "q_album_vote", "q_dominant_album", "q_various_top", "q_large_groups"):
    SQL[_k] = SQL[_k].replace("AS group", 'AS "group"')
