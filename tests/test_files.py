"""Readers, writers and streams on files."""

import os

import pytest
from pyspark.sql import functions as F

from loomline.sources import readers, schemas, writers
from loomline.streaming import failures


def only_file(folder, suffix):
    return next(os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(suffix))


def test_csv_round_trip(spark, tmp_path):
    rows = [("p", 'a "quoted" name', "line\nbreak", "own\\er", True, 3, "u"), ("q", "", None, "x,y", False, None, None)]
    df = spark.createDataFrame(rows, schemas.PLAYLISTS)
    assert writers.write_csv(df, str(tmp_path / "c"))
    back = readers.read_csv(spark, str(tmp_path / "c"), schemas.PLAYLISTS).collect()
    assert [(r.id, r.name, r.description, r.owner, r.public, r.track_count) for r in back][0] == ("p", 'a "quoted" name', "line\nbreak", "own\\er", True, 3)
    assert not writers.write_csv(df.filter("1=0"), str(tmp_path / "c")) and readers.read_csv(spark, str(tmp_path / "none"), schemas.PLAYLISTS).count() == 0


def test_metadata_and_urls(spark, tmp_path):
    (tmp_path / "b.csv").write_text("track_name; artist_names;spotify_url\nTwo;B;u1\nThree;C;u2\n")
    (tmp_path / "a.csv").write_text("spotify_url,track_name,artist_names,album_name\nu1,One,A,Al\n,X,Y,Z\n")
    (tmp_path / "c.csv").write_text("name,spotify_url\nx,u9\n")
    paths = [str(tmp_path / f) for f in ("c.csv", "b.csv", "a.csv", "none.csv")]
    assert {tuple(r) for r in readers.read_metadata(spark, paths).collect()} == {("u1", "A", "One", "Al"), ("u2", "C", "Three", "")}
    (tmp_path / "u.txt").write_text("u1\n\n u2 \nu1\n")
    assert [r.url for r in readers.read_urls(spark, str(tmp_path / "u.txt")).orderBy("seq").collect()] == ["u1", "u2"]
    assert [r.url for r in readers.read_urls(spark, str(tmp_path / "c.csv")).collect()] == ["u9"]
    writers.write_urls(spark.createDataFrame([("u1",), ("",), (None,)], "spotify_url string"), str(tmp_path / "w"))
    assert open(only_file(tmp_path / "w", ".txt")).read() == "u1\n"



def test_a_long_header_keeps_its_last_columns(spark, tmp_path):
    extra = [f"a long column name {i}" for i in range(80)]
    path = str(tmp_path / "long.csv")
    with open(path, "w") as f:
        f.write(",".join([*extra, "track_name", "artist_names", "spotify_url"]) + "\n" + ",".join(["x"] * 80 + ["One", "A", "u1"]) + "\n")
    assert {tuple(r) for r in readers.read_metadata(spark, [path]).collect()} == {("u1", "A", "One", "")}
    assert [r.url for r in readers.read_urls(spark, path).collect()] == ["u1"]


def test_logs_and_catalog(spark, tmp_path):
    log = spark.createDataFrame([("u1", "LookupError"), ("u2", "")], "url string, reason string")
    writers.append_log(log, str(tmp_path / "soft"))
    writers.append_log(log.limit(1), str(tmp_path / "soft"))
    rows = readers.read_failure_log(spark, str(tmp_path / "soft"), str(tmp_path / "none")).collect()
    assert sorted((r.url, r.reason) for r in rows) == [("u1", "LookupError"), ("u1", "LookupError"), ("u2", "")]
    catalog = spark.createDataFrame([("p", "a", None, "al", "t", 1, 2.5)], schemas.CATALOG)
    writers.write_catalog(catalog, str(tmp_path / "j"))
    assert readers.read_catalog(spark, str(tmp_path / "j"), schemas.CATALOG).collect() == catalog.collect()
    (tmp_path / "t.tsv").write_text('A\tB\tC\t1\t"T\t2000\tp\n')
    assert readers.read_tsv(spark, str(tmp_path / "t.tsv"), schemas.LIBRARY).first().title == '"T'


def test_playlist_files(spark, tmp_path):
    rows = [("p1", "My/Mix", 1, 0, "#SPOTIFY:t1"), ("p1", "My/Mix", 1, 1, "#EXTINF:1,a"), ("p1", "My/Mix", 1, 2, "../albums/x.mp3"), ("p0", "MyMix", 0, 2, "../old.mp3"), ("p2", "007", 5, 2, "../lost.mp3")]
    lines = spark.createDataFrame(rows, "pid string, name string, seq long, part int, line string")
    writers.write_playlists(lines, str(tmp_path / "pl"), "pid", "name")
    text = open(only_file(tmp_path / "pl" / "stem=MyMix", ".txt")).read()
    assert text == "#EXTM3U\n#SPOTIFY:t1\n#EXTINF:1,a\n../albums/x.mp3\n"
    back = readers.playlist_lines(spark, str(tmp_path / "pl"))
    assert [(r.stem, r.track_id) for r in readers.playlist_ids(back).collect()] == [("MyMix", "t1")]
    files = spark.createDataFrame([("albums/./x.mp3",)], "path string")
    assert {(r.stem, r.path, r.exists) for r in readers.split_paths(readers.playlist_paths(back), files).collect()} == {("MyMix", "albums/x.mp3", True), ("007", "lost.mp3", False)}
    (tmp_path / "lib (1)" / "a").mkdir(parents=True)
    (tmp_path / "lib (1)" / "a" / "x.mp3").write_bytes(b"123")
    assert [(r.path, r["size"]) for r in readers.list_files(spark, str(tmp_path / "lib (1)")).collect()] == [("a/x.mp3", 3)]


def test_tags_come_from_the_tag_reader(spark, tmp_path):
    """The reader of audio tags is a package that need not be there: a stand-in shows what is made of its answers."""
    (tmp_path / "mediafile.py").write_text(
        "class MediaFile:\n    def __init__(self, path):\n        lines = open(path).read().split('|')\n        self.artist, self.title = lines[0], lines[1]\n        self.albumartist = self.album = self.track = None\n        self.length = 2.5\n"
    )
    spark.sparkContext.addPyFile(str(tmp_path / "mediafile.py"))
    (tmp_path / "root").mkdir()
    (tmp_path / "root" / "a.mp3").write_text("Ann|One")
    (tmp_path / "root" / "b.mp3").write_text("broken")
    (tmp_path / "root" / "c.txt").write_text("Ann|Two")
    rows = readers.read_tags(readers.list_files(spark, str(tmp_path / "root")), str(tmp_path / "root")).collect()
    assert [(os.path.basename(r.path), r.artist, r.albumartist, r.title, r.track, r.length) for r in rows] == [("a.mp3", "Ann", "", "One", 0, 2.5)]


def test_sources_and_exports(spark, tmp_path):
    rows = spark.createDataFrame([(3, "t3", "u3"), (1, "t1", "u1"), (2, "t2", ""), (4, "t1", "u1")], "seq long, track_id string, spotify_url string")
    writers.write_export(rows, str(tmp_path / "d"), "x", ["track_id", "spotify_url"], "seq", distinct=True)
    urls = readers.read_urls(spark, str(tmp_path / "d" / "x_urls.txt"))
    assert [r.url for r in urls.orderBy("seq").collect()] == ["u1", "u3"]
    assert {r.url for r in readers.read_source(spark, str(tmp_path / "d")).collect()} == {"u1", "u3"}
    writers.write_export(rows.filter("seq = 3"), str(tmp_path / "d"), "spotify_manifest", ["track_id", "spotify_url"], "seq")
    assert {r.url for r in readers.read_source(spark, str(tmp_path / "d")).collect()} == {"u3"}
    with pytest.raises(FileNotFoundError):
        readers.read_source(spark, str(tmp_path / "none"))
    blank = spark.createDataFrame([(" x ", "")], "a string, b string")
    writers.write_csv(blank, str(tmp_path / "b.csv"), one_file=True)
    assert open(only_file(tmp_path / "b.csv", ".csv")).read() == "a,b\n x ,\n"


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("u1  # a\nu2\nu1  # b\n# c\n")
    lines = spark.readStream.text(str(tmp_path / "in")).withColumn("at", F.current_timestamp())
    run = failures.reason_union_stream(lines, "value", "at").writeStream.outputMode("complete").format("memory").queryName("reasons").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert {(r.url, tuple(r.reasons), r.n) for r in spark.table("reasons").collect()} == {("u1", ("a", "b"), 2), ("u2", (), 1)}
