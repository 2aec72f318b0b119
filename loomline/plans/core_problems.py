"""The queries of problems 4 and 5 over the tables of one data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import multivalue, references
from ..sources.tables import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = multivalue.explode_values(table(spark, sf_dir, "playlist_tracks"), "playlist_tracks", "seq", "artist_names", multivalue.NAME_DELIMITERS)
    lists = multivalue.explode_values(table(spark, sf_dir, "spotify_manifest"), "spotify_manifest", "row_id", "playlist_names", multivalue.LIST_DELIMITERS)
    return names.unionByName(lists)


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks, playlists = table(spark, sf_dir, "playlist_tracks"), table(spark, sf_dir, "playlists")
    return references.orphans(tracks, "seq", "playlist_id", "exported_at", playlists, "id", "exported_at", "deleted_at")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select(F.col("child_id").alias("seq"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = table(spark, sf_dir, "playlist_tracks")
    return references.orphan_report("playlist_tracks", tracks, "playlist_id", "exported_at", _orphans(spark, sf_dir))


QUERIES = {"p4_found": p4_found, "p5_found": p5_found, "p5_report": p5_report}

_BARE = r"""CASE WHEN regexp_extract({t}, '^(?:.*[/:])?([^/:?#\s]+)/?(?:[?#].*)?$', 1) <> ''
  THEN regexp_extract({t}, '^(?:.*[/:])?([^/:?#\s]+)/?(?:[?#].*)?$', 1) ELSE {t} END"""
_TRIM = r"regexp_replace(coalesce({c}, ''), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_REFS = f"""
refs AS (SELECT seq, exported_at, {_BARE.format(t=_TRIM.format(c='playlist_id'))} AS key FROM playlist_tracks),
versions AS (SELECT {_BARE.format(t=_TRIM.format(c='id'))} AS key, exported_at, deleted_at,
  row_number() OVER (PARTITION BY {_BARE.format(t=_TRIM.format(c='id'))} ORDER BY exported_at DESC NULLS LAST, deleted_at DESC NULLS LAST) AS n FROM playlists),
latest AS (SELECT key, deleted_at FROM versions WHERE n = 1 AND key <> ''),
judged AS (SELECT r.seq, r.exported_at, CASE WHEN l.key IS NULL THEN 'missing' WHEN l.deleted_at <= r.exported_at THEN 'deleted' END AS why
  FROM refs r LEFT JOIN latest l ON r.key = l.key WHERE r.key <> '')
"""


def _packed(tab: str, rec_id: str, field: str, delimiters: str) -> str:
    """Problem 4 in SQL: a field as a run of values, each with the delimiter behind it."""
    text = f"coalesce({field}, '')"
    runs = rf"""regexp_extract_all({text}, '(?s)(?: *"(?:[^"]|"")*" *|.*?)(?:{delimiters}|$)')"""
    bare = f"regexp_replace(t, '(?:{delimiters})$', '')"
    quoted = rf"""regexp_matches({bare}, '(?s)^ *"(?:[^"]|"")*" *$')"""
    value = rf"""trim(CASE WHEN {quoted} THEN replace(regexp_extract({bare}, '(?s)^ *"(.*)" *$', 1), '""', '"') ELSE {bare} END, ' ')"""
    listed = f"CASE WHEN trim({text}, ' ') LIKE '[%]' AND json_valid({text}) THEN list_transform(json_extract_string({text}, '$[*]'), lambda t: trim(coalesce(t, ''), ' ')) END"
    values = f"list_filter(coalesce({listed}, list_transform({runs}, lambda t: {value})), lambda v: v <> '')"
    split = f"SELECT rec_id, vals, unnest(range(1, len(vals) + 1)) AS k FROM (SELECT {rec_id} AS rec_id, {values} AS vals FROM {tab}) WHERE len(vals) > 1"
    return f"SELECT '{tab}' AS tab, rec_id, CAST(k AS BIGINT) AS pos, vals[k] AS val FROM ({split})"


SQL = {
    "p4_found": _packed("playlist_tracks", "seq", "artist_names", "[,;|]| / ") + " UNION ALL " + _packed("spotify_manifest", "row_id", "playlist_names", "[;|]"),
    "p5_found": f"WITH {_REFS} SELECT seq FROM judged WHERE why IS NOT NULL",
    "p5_report": f"""WITH {_REFS} SELECT 'playlist_tracks' AS tab, strftime(exported_at, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS n_refs,
  CAST(count(*) FILTER (WHERE why = 'missing') AS BIGINT) AS n_missing, CAST(count(*) FILTER (WHERE why = 'deleted') AS BIGINT) AS n_deleted
FROM judged GROUP BY 2""",
}
