"""Scalar functions on names, titles, paths and links, as Column expressions.

All of them treat null as ''. Regular expressions are Java's; ``(?U)`` makes classes Unicode,
``(?d)`` lets only a line feed end a line.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and words that results must agree on.
ARTIST_SEPARATORS = r"(?iU)\s*(?:,|&|/| x | vs | feat\.?|ft\.?|featuring)\s*"
FEAT_PARENTHESES = r"(?iU)\s*[\(\[]\s*(?:feat\.?|ft\.?|featuring|with|vs\.?)\b[^)\]]*[\)\]]\s*"
FEAT_CLAUSE = r"(?iU)\s*[\(\[]?\s*(?:feat(?:uring)?\.?|ft\.?|f\.)\s*"
WORD = r"\p{L}\p{N}_"
ILLEGAL = r'[\\/:*?"<>|]'
ILLEGAL_AND_CONTROLS = r'[<>:"/\\|?*\x00-\x1f]'
AUDIO_EXTENSIONS = (".mp3", ".flac", ".m4a", ".opus", ".ogg", ".wav", ".aac")
PLAYLIST_EXTENSIONS = (".m3u8", ".m3u")
HARD_MARKERS = ("Track no longer exists", "SongError")
SOFT_MARKERS = ("AudioProviderError", "LookupError", "PermissionError", "No results found", "YT-DLP download error", "returned no usable results")
VARIOUS_ARTISTS = "Various Artists"
PRUNED_FOLDER = "__pycache__"
COLLABORATION_X = r"(?U)(?<!\w)\s+[xX]\s+(?!\w)"
COLLABORATION_AND = r"(?iU)\s+and\s+"
ALBUM_LINK = r"(?:/album/|:album:)([A-Za-z0-9]+)"
TRACK_LINK = r"(?:/track/|:track:)([A-Za-z0-9]+)"
PLAYLIST_LINK = r"(?i)/sets/|/albums/|/tracks/?$|/likes/?$|/reposts/?"
LOG_LINE = r"^(\S+)(?:\s+#\s*(.*))?$"


def text(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def squeezed(x: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)[\s\p{Z}\x1c-\x1f]+", " "))


def norm_key(x: Column) -> Column:
    """Lower case, ASCII letters and digits only."""
    return F.regexp_replace(F.lower(text(x)), "[^a-z0-9]", "")


def unicode_normalize(x: Column) -> Column:
    """Lower case; only letters, digits, underscores and single blanks."""
    return squeezed(F.regexp_replace(F.lower(text(x)), rf"(?U)[^{WORD}\s\p{{Z}}]", ""))


def title_normalize(x: Column) -> Column:
    """``unicode_normalize`` of what stands before a featuring word, without parentheses."""
    cut = F.regexp_replace(F.lower(text(x)), r"(?Ud)\s*(feat\.?|ft\.?|featuring)\s+.*", "")
    return unicode_normalize(F.regexp_replace(cut, r"(?Ud)\s*\(.*?\)", ""))


def fuzzy_key(artists: Column, title: Column) -> Column:
    return F.concat(title_normalize(F.trim(F.split_part(text(artists), F.lit(","), F.lit(1)))), F.lit("|||"), title_normalize(title))


def sanitize(x: Column) -> Column:
    """A file name part: no forbidden characters, no blanks at the ends, no dots at the end; '_' if nothing is left."""
    kept = F.regexp_replace(strip(F.regexp_replace(text(x), ILLEGAL, "")), r"\.+$", "")
    return F.when(kept == "", "_").otherwise(kept)


def sanitize_filename(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text(x), ILLEGAL_AND_CONTROLS, ""), r"^[. ]+|[. ]+$", "")


def safe_name(x: Column) -> Column:
    kept = F.regexp_replace(strip(F.regexp_replace(text(x), ILLEGAL_AND_CONTROLS, "")), r"\.+$", "")
    return F.when(kept == "", "_").otherwise(kept)


def strip(x: Column) -> Column:
    """No white space at the ends."""
    return F.regexp_replace(x, r"(?U)^[\s\p{Z}\x1c-\x1f]+|[\s\p{Z}\x1c-\x1f]+$", "")


def primary_token(x: Column) -> Column:
    return strip(F.get(F.split(text(x), r"(?U)\s*(?:&|/)\s*", 2), 0))


def split_artists(x: Column) -> Column:
    return F.filter(F.transform(F.split(text(x), ARTIST_SEPARATORS), strip), lambda a: a != "")


def primary_artist(x: Column) -> Column:
    return F.coalesce(F.get(split_artists(x), 0), F.lit(""))


def prefix4(x: Column) -> Column:
    return F.substring(x, 1, 4)


def raw_key(x: Column) -> Column:
    """Lower case and single blanks; symbols stay."""
    return squeezed(F.lower(text(x)))


def core_title(x: Column) -> Column:
    return squeezed(F.regexp_replace(text(x), FEAT_PARENTHESES, " "))


def track_int(x: Column) -> Column:
    return F.split_part(text(x), F.lit("/"), F.lit(1)).try_cast("int")


def seconds_of_ms(x: Column) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(0.0)) / 1000.0


def duration_ok(want: Column, have: Column, tolerance: float) -> Column:
    """A missing length never speaks against a match."""
    return (F.coalesce(want, F.lit(0.0)) == 0) | (F.coalesce(have, F.lit(0.0)) == 0) | (F.abs(want - have) <= tolerance)


def ext_seconds(x: Column) -> Column:
    s = F.bround(F.coalesce(x, F.lit(0.0)), 0).cast("long")
    return F.when(s > 0, s).otherwise(F.lit(-1).cast("long"))


def clean_text(x: Column) -> Column:
    return strip(F.regexp_replace(text(x), r"[\r\n\t]+", " "))


def entry_label(artist: Column, title: Column) -> Column:
    a, t = clean_text(artist), clean_text(title)
    return F.concat_ws(" - ", F.nullif(a, F.lit("")), F.nullif(t, F.lit("")))


def search_url(artist: Column, track: Column) -> Column:
    query = strip(F.concat(text(artist), F.lit(" "), text(track)))
    coded = F.url_encode(query)
    for found, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        coded = F.replace(coded, F.lit(found), F.lit(wanted))
    return F.when(query == "", "").otherwise(F.concat(F.lit("https://www.youtube.com/results?search_query="), coded))


def playlist_id_of(link: Column) -> Column:
    """The id in a playlist's link, its URI, or the text itself."""
    x = text(link)
    return (
        F.when(x.contains("/playlist/"), F.split_part(F.split_part(x, F.lit("/playlist/"), F.lit(2)), F.lit("?"), F.lit(1)))
        .when(x.contains(":playlist:"), F.split_part(x, F.lit(":playlist:"), F.lit(2)))
        .otherwise(x)
    )


def album_id_of(link: Column) -> Column:
    return F.regexp_extract(text(link), ALBUM_LINK, 1)


def track_id_of(link: Column) -> Column:
    return F.regexp_extract(text(link), TRACK_LINK, 1)


def is_link(x: Column) -> Column:
    return text(x).rlike(r"^https?://")


def list_form(names: Column) -> Column:
    """A; A & B; A, B & C."""
    n = F.size(names)
    return (
        F.when(n == 0, "").when(n == 1, F.get(names, 0)).otherwise(
            F.concat(F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" & "), F.get(names, n - 1))
        )
    )


def _names(x: Column) -> Column:
    commas = F.regexp_replace(F.regexp_replace(x, COLLABORATION_X, ", "), COLLABORATION_AND, ", ")
    return F.filter(F.transform(F.split(commas, ","), strip), lambda a: a != "")


def normalize_artist(x: Column) -> Column:
    """A credit in one form: main acts as a list, then ``feat.`` and the guests as a list."""
    parts = F.split(x, FEAT_CLAUSE, 2)
    guests = F.regexp_replace(strip(F.get(parts, 1)), r"^[()]+|[()]+$", "")
    main = list_form(_names(F.when(F.size(parts) > 1, strip(F.get(parts, 0))).otherwise(x)))
    whole = F.when((F.size(parts) > 1) & (guests != ""), F.concat(main, F.lit(" feat. "), list_form(_names(guests)))).otherwise(main)
    tidy = F.regexp_replace(F.regexp_replace(whole, "  +", " "), r"(?U)^[\s,&]+|[\s,&]+$", "")
    return F.when(strip(text(x)) == "", x).otherwise(tidy)


def track_label(track: Column, place: Column) -> Column:
    """Two digits at least: the tag's number, else the 1-based place."""
    return F.format_string("%02d", F.coalesce(F.nullif(track, F.lit(0)), place).cast("int"))


def predicted_filename(artists: Column, title: Column, extension: str) -> Column:
    return sanitize_filename(F.concat(text(artists), F.lit(" - "), text(title), F.lit(f".{extension}")))


def basename(path: Column) -> Column:
    return F.element_at(F.split(text(path), "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(text(path), r"/?[^/]*$", "")


def stem(name: Column) -> Column:
    """The last part of a path without its extension; leading dots are no extension."""
    return F.regexp_replace(basename(name), r"(?s)^(\.*[^.].*)\.[^.]*$", "$1")


def extension(name: Column) -> Column:
    """The extension with its dot, or ''."""
    return F.regexp_extract(basename(name), r"(?s)^\.*[^.].*(\.[^.]*)$", 1)


def is_audio(path: Column) -> Column:
    return F.lower(extension(path)).isin(*AUDIO_EXTENSIONS)


def folder_name(albumartist: Column, album: Column) -> Column:
    return sanitize(F.concat(text(albumartist), F.lit(" - "), text(album)))


def size_text(n: Column) -> Column:
    """Bytes in the largest unit below 1024, one decimal except for bytes."""
    x = n.cast("double")
    out = F.when(x < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B")))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        out = out.when(x / 1024.0**power < 1024, F.format_string(f"%.1f {unit}", x / 1024.0**power))
    return out.otherwise(F.format_string("%.1f PB", x / 1024.0**5))


def log_url(line: Column) -> Column:
    """The link of a failure log line; '' for comments and lines of another form."""
    found = F.regexp_extract(strip(text(line)), LOG_LINE, 1)
    return F.when(found.startswith("#"), "").otherwise(found)


def log_reason(line: Column) -> Column:
    return strip(F.regexp_extract(strip(text(line)), LOG_LINE, 2))


def failure_class(output: Column, exit_code: Column) -> Column:
    """What a run's output and exit code mean: a hard marker, then the exit code, then the first soft marker."""
    x = text(output)
    hard = x.contains(HARD_MARKERS[0])
    for m in HARD_MARKERS[1:]:
        hard = hard | x.contains(m)
    out = F.when(hard, "track_unavailable").when(exit_code != 0, "download_failed")
    for m in SOFT_MARKERS:
        out = out.when(x.contains(m), m)
    return out.otherwise("ok")


def export_name(x: Column) -> Column:
    """A file name for an export: letters, digits, blanks, - and _; blanks become _."""
    kept = F.regexp_replace(text(x), rf"(?U)[^{WORD} -]", "")
    return F.replace(F.regexp_replace(kept, r"(?U)\s+$", ""), F.lit(" "), F.lit("_"))


def spec_parts(spec: Column) -> tuple[Column, Column]:
    """Artist and title of ``Artist - Title``; no artist without the dash."""
    x = text(spec)
    dash = x.contains(" - ")
    artist = F.when(dash, F.split_part(x, F.lit(" - "), F.lit(1))).otherwise("")
    return artist, F.when(dash, F.regexp_replace(x, r"(?s)^.*? - ", "")).otherwise(x)


def normal_path(path: Column) -> Column:
    """Forward slashes, no doubled or trailing ones, no ``.`` parts, and no ``x/..``, however deep.

    One fold over the parts, which only paths with ``..`` need.
    """
    text_ = F.replace(text(path), F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(text_, "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")
    up = lambda kept: (F.size(kept) > 0) & (F.element_at(F.concat(kept, F.array(F.lit(".."))), F.greatest(F.size(kept), F.lit(1))) != "..")
    step = lambda kept, p: F.when((p == "..") & up(kept), F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(p)))
    folded = F.when(F.array_contains(parts, ".."), F.aggregate(parts, empty, step)).otherwise(parts)
    root = F.when(text_.startswith("/"), "/").otherwise("")
    return F.concat(root, F.array_join(folded, "/"))


def in_pruned_folder(path: Column) -> Column:
    """Whether a path runs through a folder that walks leave out."""
    return F.concat(F.lit("/"), dirname(path), F.lit("/")).contains(f"/{PRUNED_FOLDER}/")


def counted_summary(counts: list[tuple[Column, str]]) -> Column:
    """The counters that are not 0, as ``3 copied, 1 errors``; else ``nothing to do``."""
    shown = F.filter(F.array(*[F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {word}"))) for n, word in counts]), lambda x: x.isNotNull())
    return F.when(F.size(shown) == 0, "nothing to do").otherwise(F.array_join(shown, ", "))


def relative_path(path: Column, folder: Column) -> Column:
    """``path`` as seen from ``folder``; both normal and from one root."""
    a, b = F.split(normal_path(path), "/"), F.filter(F.split(normal_path(folder), "/"), lambda x: x != "")
    same = F.transform(F.sequence(F.lit(0), F.greatest(F.size(b) - 1, F.lit(0))), lambda i: F.slice(a, 1, i + 1) == F.slice(b, 1, i + 1))
    k = F.when(F.size(b) == 0, 0).otherwise(F.size(F.filter(same, lambda x: x)))
    up = F.repeat(F.lit("../"), F.size(b) - k)
    return F.concat(up, F.array_join(F.slice(a, k + 1, F.greatest(F.size(a) - k, F.lit(0))), "/"))


def is_playlist_link(x: Column) -> Column:
    """Whether a link of the audio site leads to a list of recordings."""
    return text(x).rlike(PLAYLIST_LINK)


def label_of_stem(name: Column) -> Column:
    """The name of a file shown as a label: its stem as it is."""
    return stem(name)


def csv_field(x: Column) -> Column:
    """A CSV field, quoted where it holds a comma, a quote or a line feed."""
    t = text(x)
    return F.when(t.rlike('[,"\\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def relative_inside(path: Column, root: Column) -> Column:
    """``path`` as seen from ``root``; null outside of it, '.' for the root itself."""
    p, r = normal_path(path), normal_path(root)
    return F.when(p == r, ".").when(p.startswith(F.concat(r, F.lit("/"))), F.substring(p, F.length(r) + 2, F.length(p)))
