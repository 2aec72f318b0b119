"""Scalar functions: truth tables."""

import pytest
from pyspark.sql import functions as F

from loomline.functions import text as T

PAIRS = [
    (T.norm_key, [("Déjà-Vu", "djvu"), ("宇多田", ""), ("$$$", ""), (None, ""), ("A-1 b", "a1b")]),
    (T.unicode_normalize, [("Déjà-Vu!", "déjàvu"), ("x² ½", "x² ½"), ("a‿b_c", "ab_c"), ("a  b", "a b"), (None, "")]),
    (T.title_normalize, [("Song (Remastered)", "song"), ("Song feat. X", "song"), ("Defeat It", "de"), ("A (x) B (y)", "a b"), ("", "")]),
    (T.core_title, [("U Know (feat. L) now", "U Know now"), ("X [ft. Y]", "X"), ("X (Remix)", "X (Remix)"), ("X (with Y)", "X"), (None, "")]),
    (T.raw_key, [(" $  $ ", "$ $"), (None, "")]),
    (T.sanitize, [('a/b:c*?"<>|', "abc"), (" a.. ", "a"), ("...", "_"), (None, "_")]),
    (T.sanitize_filename, [(". a\x01b .", "ab"), ("", "")]),
    (T.safe_name, [("a*b.", "ab"), ("?", "_")]),
    (T.primary_token, [("A & B & C", "A"), ("A/B", "A"), ("A", "A"), (None, "")]),
    (T.primary_artist, [("A x B feat. C/D", "A"), ("", ""), (" , B", "B")]),
    (T.clean_text, [("a\r\n\tb ", "a b"), (None, "")]),
    (T.stem, [("x/a..b", "a."), ("..a", "..a"), ("A.", "A"), ("a.mp3", "a"), ("a", "a"), (".hid", ".hid")]),
    (T.extension, [("x.y/a.mp3", ".mp3"), ("x.y/a", ""), (".hid", ""), ("a.", ".")]),
    (T.log_url, [("u  # r", "u"), ("u", "u"), ("# c", ""), ("u r", ""), ("", ""), ("#c", "")]),
    (T.log_reason, [("u  # r ", "r"), ("u", ""), ("u  #", "")]),
    (T.playlist_id_of, [("https://h/playlist/AB?si=1", "AB"), ("tapes:playlist:AB", "AB"), ("AB", "AB"), (None, "")]),
    (T.album_id_of, [("https://h/album/A1?x", "A1"), ("s:album:B2", "B2"), ("zzz", "")]),
    (T.export_name, [("My Mix! / 2 ", "My_Mix__2"), ("é_-", "é_-")]),
    (T.normal_path, [("a//b/./c/../d/", "a/b/d"), ("../a", "../a"), ("a\\b", "a/b"), ("./a", "a"), ("x/../../y", "../y"), ("playlists/../albums/a", "albums/a"), ("", ""), ("/a/../../b", "/../b"), ("/".join("abcdefghijkl") + "/.." * 12 + "/x", "x"), ("../../a/..", "../..")]),
    (
        T.normalize_artist,
        [("Mara Lind, Otto Vale", "Mara Lind & Otto Vale"), ("The Kites, Mara Lind, Otto Vale, Juno", "The Kites, Mara Lind, Otto Vale & Juno"), ("Mara Lind feat. Juno", "Mara Lind feat. Juno"),
         ("Mara Lind FT Juno and Otto Vale", "Mara Lind feat. Juno & Otto Vale"), ("Otto Vale (featuring Juno, The Kites)", "Otto Vale feat. Juno & The Kites"), ("Vale, the Elder", "Vale & the Elder"),
         ("Mara & Otto", "Mara & Otto"), ("Mara x Otto", "Mara x Otto"), ("Mara! x !Otto", "Mara! & !Otto"), ("tide and tide", "tide & tide"), (" , Mara,, Otto ,", "Mara & Otto"), ("Mara feat.", "Mara"),
         ("", ""), (None, None)],
    ),
]


@pytest.mark.parametrize(("function", "pairs"), PAIRS, ids=[f.__name__ for f, _ in PAIRS])
def test_text_functions(spark, function, pairs):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "i int, x string")
    got = [r.y for r in df.withColumn("y", function(F.col("x"))).orderBy("i").collect()]
    assert got == [b for _, b in pairs]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_other_functions(spark):
    lit = F.lit
    assert one(spark, T.split_artists(lit("A x B feat. C/D"))) == ["A", "B", "C", "D"] and one(spark, T.split_artists(lit("Daft Punk"))) == ["Da", "Punk"]
    assert [one(spark, T.track_int(lit(x))) for x in ("3/12", "", "x")] == [3, None, None]
    assert [one(spark, T.ext_seconds(lit(x))) for x in (2.5, 188.5, 0.0, 0.4)] == [2, 188, -1, -1]
    assert one(spark, T.search_url(lit("A/B ~*"), lit(""))).endswith("=A/B%20~%2A") and one(spark, T.search_url(lit(""), lit(None))) == ""
    assert [one(spark, T.size_text(lit(x))) for x in (0, 1023, 1024, 1536 * 1024, 1 << 50)] == ["0 B", "1023 B", "1.0 KB", "1.5 MB", "1.0 PB"]
    assert one(spark, T.entry_label(lit("a"), lit("b"))) == "a - b" and one(spark, T.entry_label(lit(""), lit("b"))) == "b" and one(spark, T.entry_label(lit(None), lit(None))) == ""
    assert one(spark, T.duration_ok(lit(0.0), lit(9.0), 1)) and one(spark, T.duration_ok(lit(3.0), lit(4.0), 1)) and not one(spark, T.duration_ok(lit(3.0), lit(5.0), 1))
    assert [one(spark, T.failure_class(lit(o), lit(c))) for o, c in (("SongError", 0), ("LookupError", 1), ("x LookupError", 0), ("fine", 0), (None, 0))] == [
        "track_unavailable", "download_failed", "LookupError", "ok", "ok",
    ]
    assert [one(spark, T.track_label(lit(t), lit(7))) for t in (3, 0, None, 123)] == ["03", "07", "07", "123"]
    assert [one(spark, c) for c in T.spec_parts(lit("A - B - C"))] == ["A", "B - C"] and [one(spark, c) for c in T.spec_parts(lit("B"))] == ["", "B"]
    assert one(spark, T.counted_summary([(lit(2), "copied"), (lit(0), "errors")])) == "2 copied" and one(spark, T.counted_summary([(lit(0), "x")])) == "nothing to do"
    assert one(spark, T.fuzzy_key(lit("A B, C"), lit("T (x)"))) == "a b|||t" and one(spark, T.is_link(lit("https://x"))) and not one(spark, T.is_link(lit(None)))


def test_relative_path(spark):
    pairs = [("albums/a.mp3", "playlists", "../albums/a.mp3"), ("playlists/x/a", "playlists", "x/a"), ("a", "", "a"), ("b/c/d", "b/e/f", "../../c/d"), ("b/c", "b", "c")]
    df = spark.createDataFrame(pairs, "p string, f string, want string").withColumn("got", T.relative_path(F.col("p"), F.col("f")))
    assert all(r.got == r.want for r in df.collect())


def test_links_fields_and_places(spark):
    lit = F.lit
    assert [one(spark, T.is_playlist_link(lit(x))) for x in ("https://h/u/sets/x", "https://h/u/Tracks/", "https://h/u/track", "https://h/likes", None)] == [True, True, False, True, False]
    assert [one(spark, T.csv_field(lit(x))) for x in ("a", "a,b", 'a"b', "a\nb", None)] == ["a", '"a,b"', '"a""b"', '"a\nb"', ""]
    assert [one(spark, T.relative_inside(lit(x), lit("r/s"))) for x in ("r/s/a", "r/s/../s/b/", "r/s", "r/sx/a", "r/s/../a")] == ["a", "b", ".", None, None]
    assert [one(spark, T.in_pruned_folder(lit(x))) for x in ("a/__pycache__/x.mp3", "__pycache__/x", "a/__pycache__", "a/b")] == [True, True, False, False]
    assert one(spark, T.label_of_stem(lit("a/b c.mp3"))) == "b c"
