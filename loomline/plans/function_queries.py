"""Queries of the scalar functions over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import table


def _select(name: str, *columns):
    return lambda spark, d: table(spark, d, name).select(*(c() if callable(c) else c for c in columns))


def q_split_artists(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "library").select("file_id", F.posexplode(T.split_artists(F.col("artist"))).alias("pos", "name"))
    return rows.select("file_id", F.col("pos").cast("int").alias("pos"), "name")


c = F.col
QUERIES = {
    "q_norm_key": _select("library", "file_id", lambda: T.norm_key(c("title")).alias("title_key"), lambda: T.norm_key(c("artist")).alias("artist_key"), lambda: T.norm_key(c("album")).alias("album_key")),
    "q_unicode_normalize": _select("playlist_tracks", "seq", lambda: T.unicode_normalize(c("track_name")).alias("title"), lambda: T.unicode_normalize(c("artist_names")).alias("artists")),
    "q_title_normalize": _select("playlist_tracks", "seq", lambda: T.title_normalize(c("track_name")).alias("title"), lambda: T.fuzzy_key(c("artist_names"), c("track_name")).alias("fuzzy_key")),
    "q_raw_core": _select("library", "file_id", lambda: T.raw_key(c("title")).alias("raw"), lambda: T.core_title(c("title")).alias("core"), lambda: T.prefix4(T.norm_key(c("title"))).alias("prefix")),
    "q_sanitize": _select("library", "file_id", lambda: T.sanitize(c("title")).alias("part"), lambda: T.sanitize_filename(c("title")).alias("file_name"), lambda: T.safe_name(c("album")).alias("safe"), lambda: T.folder_name(c("albumartist"), c("album")).alias("folder")),
    "q_split_artists": q_split_artists,
    "q_primary_artist": _select("library", "file_id", lambda: T.primary_artist(c("artist")).alias("primary_artist"), lambda: T.primary_token(c("artist")).alias("primary_token")),
    "q_normalize_artist": _select("library", "file_id", lambda: T.normalize_artist(c("artist")).alias("artist"), lambda: T.normalize_artist(c("albumartist")).alias("albumartist")),
    "q_numbers": _select("library", "file_id", lambda: T.track_int(c("track")).alias("track"), lambda: T.ext_seconds(c("length")).alias("seconds"), lambda: T.duration_ok(F.lit(200.0), c("length"), 60).alias("near_200")),
    "q_clean_label": _select("library", "file_id", lambda: T.clean_text(c("title")).alias("title"), lambda: T.entry_label(c("artist"), c("title")).alias("label")),
    "q_filename_predict": _select("spotify_manifest", "row_id", lambda: T.predicted_filename(c("artist_names"), c("track_name"), "mp3").alias("file_name"), lambda: T.unicode_normalize(T.stem(T.predicted_filename(c("artist_names"), c("track_name"), "mp3"))).alias("stem_key")),
    "q_path_parts": _select("library", "file_id", lambda: T.basename(c("path")).alias("base"), lambda: T.dirname(c("path")).alias("folder"), lambda: T.stem(c("path")).alias("stem"), lambda: T.extension(c("path")).alias("ext"), lambda: T.is_audio(c("path")).alias("audio"), lambda: T.normal_path(c("path")).alias("normal")),
    "q_url_ids": _select("playlists", "owner", lambda: T.playlist_id_of(c("playlist_url")).alias("from_url"), lambda: T.playlist_id_of(c("id")).alias("from_id"), lambda: T.is_link(c("playlist_url")).alias("link"), lambda: T.export_name(c("name")).alias("export_name")),
    "q_track_url_ids": _select("spotify_manifest", "row_id", lambda: T.track_id_of(c("spotify_url")).alias("url_track"), lambda: T.album_id_of(c("spotify_url")).alias("url_album"), lambda: T.is_link(c("spotify_url")).alias("link")),
    "q_search_url": _select("library", "file_id", lambda: T.search_url(c("albumartist"), c("title")).alias("search")),
    "q_size_text": _select("documents", "doc_id", lambda: T.size_text(c("n_chars") * c("n_chars") * c("doc_id")).alias("size")),
}

# -- the same in SQL -------------------------------------------------------------------------

_W = r"\p{L}\p{N}_"
_S = r"[\s\p{Z}\x1c-\x1f]"


def t(x: str) -> str:
    return f"coalesce({x}, '')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"


def squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_S}+', ' ', 'g'))"


def norm_key(x: str) -> str:
    return f"regexp_replace(lower({t(x)}), '[^a-z0-9]', '', 'g')"


def unicode_normalize(x: str) -> str:
    return squeezed(rf"regexp_replace(lower({t(x)}), '[^{_W}\s\p{{Z}}]', '', 'g')")


def title_normalize(x: str) -> str:
    cut = rf"regexp_replace(lower({t(x)}), '{_S}*(feat\.?|ft\.?|featuring){_S}+[^\n]*', '', 'g')"
    return unicode_normalize(rf"regexp_replace({cut}, '{_S}*\([^\n]*?\)', '', 'g')")


def fuzzy_key(artists: str, title: str) -> str:
    head = f"trim(split_part({t(artists)}, ',', 1))"
    return f"concat({title_normalize(head)}, '|||', {title_normalize(title)})"


def raw_key(x: str) -> str:
    return squeezed(f"lower({t(x)})")


def core_title(x: str) -> str:
    return squeezed(rf"regexp_replace({t(x)}, '(?i){_S}*[\(\[]{_S}*(?:feat\.?|ft\.?|featuring|with|vs\.?)\b[^)\]]*[\)\]]{_S}*', ' ', 'g')")


def sanitize(x: str, illegal: str = r'[\\/:*?"<>|]') -> str:
    kept = rf"regexp_replace({strip(f"regexp_replace({t(x)}, '{illegal}', '', 'g')")}, '\.+$', '')"
    return f"CASE WHEN {kept} = '' THEN '_' ELSE {kept} END"


_ILLEGAL_2 = r'[<>:"/\\|?*\x00-\x1f]'


def sanitize_filename(x: str) -> str:
    return f"regexp_replace(regexp_replace({t(x)}, '{_ILLEGAL_2}', '', 'g'), '^[. ]+|[. ]+$', '', 'g')"


def split_artists(x: str) -> str:
    parts = rf"string_split_regex({t(x)}, '(?i){_S}*(?:,|&|/| x | vs | feat\.?|ft\.?|featuring){_S}*')"
    return f"list_filter(list_transform({parts}, lambda p: {strip('p')}), lambda p: p <> '')"


def track_int(x: str) -> str:
    return f"TRY_CAST(split_part({t(x)}, '/', 1) AS INTEGER)"


def ext_seconds(x: str) -> str:
    return f"CASE WHEN CAST(round_even(coalesce({x}, 0), 0) AS BIGINT) > 0 THEN CAST(round_even(coalesce({x}, 0), 0) AS BIGINT) ELSE -1 END"


def clean_text(x: str) -> str:
    return strip(rf"regexp_replace({t(x)}, '[\r\n\t]+', ' ', 'g')")


def entry_label(a: str, b: str) -> str:
    return f"concat_ws(' - ', nullif({clean_text(a)}, ''), nullif({clean_text(b)}, ''))"


def basename(x: str) -> str:
    return rf"regexp_extract({t(x)}, '([^/]*)$', 1)"


def dirname(x: str) -> str:
    return f"regexp_replace({t(x)}, '/?[^/]*$', '')"


def stem(x: str) -> str:
    return rf"regexp_replace({basename(x)}, '(?s)^(\.*[^.].*)\.[^.]*$', '\1')"


def extension(x: str) -> str:
    return rf"regexp_extract({basename(x)}, '(?s)^\.*[^.].*(\.[^.]*)$', 1)"


def predicted(a: str, b: str) -> str:
    return sanitize_filename(f"concat({t(a)}, ' - ', {t(b)}, '.mp3')")


def folder_name(a: str, b: str) -> str:
    return sanitize(f"concat({t(a)}, ' - ', {t(b)})")


def list_form(names: str) -> str:
    return f"""CASE len({names}) WHEN 0 THEN '' WHEN 1 THEN {names}[1] ELSE concat(array_to_string({names}[1:len({names})-1], ', '), ' & ', {names}[len({names})]) END"""


def _names(x: str) -> str:
    commas = rf"regexp_replace(regexp_replace({x}, '(^|[^{_W}\s\p{{Z}}]){_S}+[xX]{_S}+([^{_W}]|$)', '\1, \2', 'g'), '(?i){_S}+and{_S}+', ', ', 'g')"
    return f"list_filter(list_transform(string_split({commas}, ','), lambda p: {strip('p')}), lambda p: p <> '')"


def normalize_artist(x: str) -> str:
    clause = rf"(?i){_S}*[\(\[]?{_S}*(?:feat(?:uring)?\.?|ft\.?|f\.){_S}*"
    head = rf"regexp_extract({x}, '(?s)^(.*?)(?:{clause})(.*)$', 1)".replace("(?s)^(.*?)(?:(?i)", "(?is)^(.*?)(?:")
    tail = head[:-2] + "2)"
    has = f"regexp_matches({x}, '{clause}')"
    guests = rf"regexp_replace({strip(tail)}, '^[()]+|[()]+$', '', 'g')"
    whole = f"CASE WHEN {has} AND {guests} <> '' THEN concat({list_form(_names(strip(head)))}, ' feat. ', {list_form(_names(guests))}) WHEN {has} THEN {list_form(_names(strip(head)))} ELSE {list_form(_names(x))} END"
    return rf"CASE WHEN {strip(t(x))} = '' THEN {x} ELSE regexp_replace(regexp_replace({whole}, '  +', ' ', 'g'), '^[\s\p{{Z}},&]+|[\s\p{{Z}},&]+$', '', 'g') END"


def search_url(a: str, b: str) -> str:
    q = strip(f"concat({t(a)}, ' ', {t(b)})")
    return f"CASE WHEN {q} = '' THEN '' ELSE concat('https://www.youtube.com/results?search_query=', replace(url_encode({q}), '%2F', '/')) END"


def normal_path(x: str) -> str:
    return rf"regexp_replace(regexp_replace(replace({t(x)}, '\', '/'), '/+', '/', 'g'), '(.)/$', '\1')"


def playlist_id(x: str) -> str:
    return f"CASE WHEN contains({t(x)}, '/playlist/') THEN split_part(split_part({x}, '/playlist/', 2), '?', 1) WHEN contains({t(x)}, ':playlist:') THEN split_part({x}, ':playlist:', 2) ELSE {t(x)} END"


def export_name(x: str) -> str:
    return rf"replace(regexp_replace(regexp_replace({t(x)}, '[^{_W} -]', '', 'g'), '[\s\p{{Z}}]+$', ''), ' ', '_')"


def size_text(x: str) -> str:
    steps = "".join(f" WHEN {x} < pow(1024::DOUBLE, {p + 1}) THEN printf('%.1f {u}', {x} / pow(1024::DOUBLE, {p}))" for p, u in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")))
    return f"CASE WHEN {x} < 1024 THEN concat(CAST({x} AS BIGINT), ' B'){steps} ELSE printf('%.1f PB', {x} / pow(1024::DOUBLE, 5)) END"


SQL = {
    "q_norm_key": f"SELECT file_id, {norm_key('title')} AS title_key, {norm_key('artist')} AS artist_key, {norm_key('album')} AS album_key FROM library",
    "q_unicode_normalize": f"SELECT seq, {unicode_normalize('track_name')} AS title, {unicode_normalize('artist_names')} AS artists FROM playlist_tracks",
    "q_title_normalize": f"SELECT seq, {title_normalize('track_name')} AS title, {fuzzy_key('artist_names', 'track_name')} AS fuzzy_key FROM playlist_tracks",
    "q_raw_core": f"SELECT file_id, {raw_key('title')} AS raw, {core_title('title')} AS core, left({norm_key('title')}, 4) AS prefix FROM library",
    "q_sanitize": f"SELECT file_id, {sanitize('title')} AS part, {sanitize_filename('title')} AS file_name, {sanitize('album', _ILLEGAL_2)} AS safe, {folder_name('albumartist', 'album')} AS folder FROM library",
    "q_split_artists": f"SELECT file_id, CAST(i - 1 AS INTEGER) AS pos, names[i] AS name FROM (SELECT file_id, names, unnest(range(1, len(names) + 1)) AS i FROM (SELECT file_id, {split_artists('artist')} AS names FROM library))",
    "q_primary_artist": rf"SELECT file_id, coalesce(({split_artists('artist')})[1], '') AS primary_artist, {strip(rf"coalesce((string_split_regex({t('artist')}, '{_S}*(?:&|/){_S}*'))[1], '')")} AS primary_token FROM library",
    "q_normalize_artist": f"SELECT file_id, {normalize_artist('artist')} AS artist, {normalize_artist('albumartist')} AS albumartist FROM library",
    "q_numbers": f"SELECT file_id, {track_int('track')} AS track, {ext_seconds('length')} AS seconds, (coalesce(length, 0) = 0 OR abs(200 - length) <= 60) AS near_200 FROM library",
    "q_clean_label": f"SELECT file_id, {clean_text('title')} AS title, {entry_label('artist', 'title')} AS label FROM library",
    "q_filename_predict": f"SELECT row_id, {predicted('artist_names', 'track_name')} AS file_name, {unicode_normalize(stem(predicted('artist_names', 'track_name')))} AS stem_key FROM spotify_manifest",
    "q_path_parts": f"""SELECT file_id, {basename('path')} AS base, {dirname('path')} AS folder, {stem('path')} AS stem, {extension('path')} AS ext,
  lower({extension('path')}) IN ('.mp3', '.flac', '.m4a', '.opus', '.ogg', '.wav', '.aac') AS audio, {normal_path('path')} AS normal FROM library""",
    "q_url_ids": f"SELECT owner, {playlist_id('playlist_url')} AS from_url, {playlist_id('id')} AS from_id, regexp_matches({t('playlist_url')}, '^https?://') AS link, {export_name('name')} AS export_name FROM playlists",
    "q_track_url_ids": f"SELECT row_id, regexp_extract({t('spotify_url')}, '(?:/track/|:track:)([A-Za-z0-9]+)', 1) AS url_track, regexp_extract({t('spotify_url')}, '(?:/album/|:album:)([A-Za-z0-9]+)', 1) AS url_album, regexp_matches({t('spotify_url')}, '^https?://') AS link FROM spotify_manifest",
    "q_search_url": f"SELECT file_id, {search_url('albumartist', 'title')} AS search FROM library",
    "q_size_text": f"SELECT doc_id, {size_text('CAST(n_chars * n_chars * doc_id AS DOUBLE)')} AS size FROM documents",
}
