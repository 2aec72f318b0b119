"""Problems 2 and 6 on small tables with known answers."""

import random
from datetime import datetime

import pytest

from loomline.llm import linkage, survivors
from loomline.llm.linkage import path_readings
from loomline.llm.titles import parse_title, same_title


@pytest.mark.parametrize(
    ("title", "words", "version"),
    [
        ("Pale Owl", "pale owl", ""), ("Pale Owl - Remastered 2011", "pale owl", ""), ("Pale Owl [Remastered]", "pale owl", ""), ("Pale Owl (2010 Remaster)", "pale owl", ""),
        ("Pale Owl (UK Edition)", "pale owl", ""), ("Pale Owl (feat. Ann & Bob) [HQ]", "pale owl", ""), ("Pale Owl feat. Ann", "pale owl", ""), ("07 - Pale Owl (Lyrics)", "pale owl", ""),
        ("Pale Owl (Live at Rome) (Deluxe Edition)", "pale owl", "live rome"), ("Pale Owl - Iron Remix", "pale owl", "iron remix"), ("Pale Owl (Demo)", "pale owl", "demo"),
        ("Pale Owl (Acoustiic)", "pale owl", "acoustic"), ("Pale Owl (for Ann)", "pale owl for ann", ""), ("Café No. 7", "cafe no 7", ""), ("Don’t Go", "dont go", ""),
        ("(Live)", "live", ""), ("???", "???", ""), ("", "", ""), ("99", "99", ""), ("Ночь (Live)", "ночь", "live"),
    ],
)
def test_parse_title(title, words, version):
    assert (" ".join(parse_title(title)[0]), " ".join(parse_title(title)[1])) == (words, version)


def test_same_title():
    assert same_title(["a", "narow"], ["a", "narrow"], [9, 1], [9, 80]) > 0.9
    assert same_title(["ember"], ["amber"], [70], [80]) == 0 and same_title(["no", "13"], ["no", "18"], [9, 1], [9, 90]) == 0
    assert same_title(["a", "b"], ["ab"], [1, 1], [1]) > 0.9 and same_title(["a"], ["a", "b"], [1], [1, 1]) == 0


def test_path_readings():
    assert path_readings("albums/Ann Lee - Songs/07 - Ann Lee - Pale Owl.mp3") == (["Ann Lee", "Ann Lee"], ["Pale Owl", "Ann Lee - Pale Owl"])
    assert path_readings("incoming/Ann_Lee_-_Pale_Owl.mp3") == (["Ann Lee"], ["Pale Owl", "Ann Lee - Pale Owl"])
    assert path_readings("downloads/Ann Lee/Songs/7. Pale Owl.MP3") == (["Ann Lee"], ["Pale Owl"])
    assert path_readings("") == ([], [])


TRACKS = [
    ("t1", "Pale Owl", "Robert Vitizankova", 200_000), ("t1", "Pale　Owl", "Robert Vitizankova", 200_400), ("t2", "Pale Owl (UK Edition)", "Robert Vitizankova, Ann Lee", 0),
    ("t3", "Pale Owl (Live at Rome)", "Robert Vitizankova", 210_000), ("t4", "Pale Owl", "Lioba Vitizankova", 200_000), ("t5", "Iron River", "Robert Vitizankova", 100_000),
    ("t6", "Grey Harbour Song", "Robert Vitizankova", 120_000), ("", "Pale Owl", "Robert Vitizankova", 200_000), (None, "Pale Owl", "Robert Vitizankova", 1), ("t7", None, "Ann Lee", 5),
    ("t8", "Pale Owl", None, 5), ("t9", "!!!", "Ann Lee", 5), ("t10", "word " * 2000, "Ann Lee", 5),
]
FILES = [
    (1, "Bob Vitizankova", None, "Pale Owl [HQ]", "x/a.mp3", 201.0), (2, "", "", "", "singles/Vitizankova, Robert - Palee Owl.mp3", 0.0), (2, "", "", "", "singles/Vitizankova, Robert - Palee Owl.mp3", 0.0),
    (3, "Robert Vitizankova", "V.A.", "Robert Vitizankova - Pale Owl (Live at Rome)", "x.mp3", 209.0), (4, "Robert Vitizankova", None, "Iron River", "x.mp3", 180.0),
    (5, None, None, None, None, None), (6, "V.A.", None, "Iron River", "albums/V.A - Mix/03 - R. Vitizankova - Iron River.mp3", 100.0), (7, "Ann Lee", None, "!!!", "", 0.0), (8, "Ann Lee", "", "word " * 2000, "", 0.0),
]


def test_recordings(spark):
    tracks = spark.createDataFrame([(*t, "n", 1) for t in TRACKS], "track_id string, track_name string, act string, ms long, node string, length int")
    files = spark.createDataFrame([(*f, "n", 1) for f in FILES], "file_id long, artist string, albumartist string, title string, path string, length double, node string, words int")
    run = lambda t, f: linkage.recordings(t, "track_id", "track_name", "act", "ms", f, "file_id", "artist", "albumartist", "title", "path", "length")
    rows = run(tracks, files).collect()
    got = {(r.track_id, r.file_id) for r in rows}
    assert got == {("t1", 1), ("t1", 2), ("t2", 1), ("t2", 2), ("t3", 3), ("t5", 6), ("t9", 7), ("t10", 8)} and len(rows) == len(got)
    assert all(linkage.ACCEPT <= r.confidence <= 1 for r in rows)
    assert run(tracks.filter("1=0"), files).count() == 0 == run(tracks, files.filter("1=0")).count()


def test_confidence_spreads_from_other_titles(spark):
    edges = [(f"a|t{i}|", f"f{i}", "a", "b", 1.0, 0.95, f"t{i}") for i in range(4)] + [("a|x|", "fx", "a", "b", 0.94, 0.4, "x"), ("c|x|", "fx", "c", "b", 0.94, 0.4, "x")]
    df = spark.createDataFrame(edges, "track_node string, file_node string, t_name string, f_name string, title double, name double, t_title string")
    got = {r.track_node: r.confidence for r in linkage.spread(df).collect()}
    assert got["a|x|"] > linkage.ACCEPT > got["c|x|"] and got["a|t0|"] > 0.95



@pytest.mark.parametrize(("n", "title", "likely"), [(6, 1.0, True), (7, 0.92, True), (4, 1.0, False)])
def test_confidence_grows_until_stable(spark, n, title, likely):
    edges = [(f"a|t{i}|", f"f{i}", "a", "b", title, 0.0, f"t{i}") for i in range(n)] + [("c|x|", "fx", "c", "b", 0.9, 0.5, "x")]
    schema = "track_node string, file_node string, t_name string, f_name string, title double, name double, t_title string"
    want = 0.0
    for _ in range(500):
        s = (n - 1) * max(want, 0.4 * title)
        want = title * linkage.CONTEXT * s / (1 + s)
    assert (want >= linkage.ACCEPT) == likely
    apart = [("d|u|", "fu", "d", "e", 1.0, 1.0, "u"), ("d|v|", "fv", "d", "e", 0.7, 0.7, "v")]  # acts that have nothing to do with them
    for rows in (edges, edges + apart):
        got = {r.track_node: r.confidence for r in linkage.spread(spark.createDataFrame(rows, schema)).collect()}
        assert len(got) == len(rows) and got["c|x|"] == 0.45
        assert all(got[f"a|t{i}|"] == pytest.approx(want, abs=1e-5) for i in range(n))


def day(n):
    return datetime(2024, 1, n)


def test_best_records(spark):
    rows = [
        (1, "A", "Pale Owl", "Ann Lee", 50, "http://x/A", day(1)), (2, "B", "pale owl (UK Edition)", " ann lee ", 90, "n/a", day(2)), (3, "B", "?", None, 101, "x:B", day(3)),
        (4, "C", "Ｐａｌｅ Owl", "Ann Lee feat. Bob", 90, "x:C", day(4)), (5, "D", "Pale Owl (Demo)", "Ann Lee", None, "", day(1)), (6, "D", "Pale Owl (Demo)", "Ann Lee", -1, None, None),
        (7, "", "Sole", "Bob", 3, "x:", day(1)), (8, None, "SOLE", "Bob", 3, "x:", day(1)), (9, None, None, None, None, None, None), (10, "", "", "", None, "", None),
        (11, "E", "Late", "Cy", 1, "x:E", day(1)), (12, "F", "Late", "Cy", 5, "bad", day(2)), (12, "F", "Late", "Cy", 5, "bad", day(2)),
    ]
    df = spark.createDataFrame([(*r, "q", 1) for r in rows], "row_id long, track_id string, t string, a string, p int, u string, at timestamp, component string, first_id int")
    run = lambda d: survivors.best_records(d, "row_id", "track_id", "t", "a", "p", "u", "at")
    got = {r.first_id: r for r in run(df).collect()}
    assert {k: (r.n_rows, r.keeper_id, r.url_id) for k, r in got.items()} == {
        1: (4, 2, 4), 5: (2, 5, None), 7: (2, 7, None), 9: (1, 9, None), 10: (1, 10, None), 11: (2, 12, 11),
    }
    assert (got[1].track_id, got[1].popularity, got[1].spotify_url, got[1].title) == ("B", 90, "x:C", "pale owl (UK Edition)") and got[5].popularity is None
    assert run(df.filter("1=0")).count() == 0


def test_currency_places_rows_without_time(spark):
    rng = random.Random(1)
    rows = []
    for g in range(30):
        order = ["old", "mid", "new"] if g % 10 else ["new", "mid", "old"]
        start = rng.randint(1, 5)
        rows += [(f"g{g}", s, day(start + i), i) for i, s in enumerate(order)]
    rows += [("h", "old", day(3), 0), ("h", "new", None, 1), ("k", "new", day(3), 0), ("k", "old", None, 1), ("k", "never seen", None, 2), ("z", None, None, 0)]
    df = spark.createDataFrame(rows, "component string, state string, at timestamp, n int")
    assert {(r.earlier, r.later) for r in survivors.precedence(df).collect()} == {("old", "mid"), ("mid", "new"), ("old", "new")}
    got = {(r.component, r.state): tuple(r.currency) for r in survivors.placed(df).filter("component in ('h', 'k', 'z')").collect()}
    assert got[("h", "new")] == (day(3), 1) and got[("k", "old")] == (None, 1) and got[("k", "never seen")] == (None, 1) and got[("h", "old")] == (day(3), 0)
    assert survivors.placed(df).count() == len(rows)


def test_closed_order():
    assert survivors.closed([("a", "b", 3), ("b", "c", 2), ("c", "d", 1)]) == {("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("b", "d"), ("a", "d")}
    assert survivors.closed([("c", "a", 1), ("a", "b", 3), ("b", "c", 2)]) == {("a", "b"), ("b", "c"), ("a", "c")} and survivors.closed([]) == set()


def test_currency_orders_rows_without_time_among_themselves(spark):
    # learned: old before mid, mid before new; old and new never stand together
    rows = [(f"g{i}", s, day(k + 1)) for i in range(4) for k, s in enumerate([("old", "mid"), ("mid", "new")][i % 2])]
    rows += [("none", "new", None), ("none", "old", None), ("none", "mid", None), ("two", "old", day(9)), ("two", "new", None), ("two", "mid", None), ("far", "old", day(9)), ("far", "new", None)]
    df = spark.createDataFrame(rows, "component string, state string, at timestamp")
    got = {(r.component, r.state): r.currency for r in survivors.placed(df).collect() if r.component[0] != "g"}
    assert sorted(("old", "mid", "new"), key=lambda s: got["none", s].behind) == ["old", "mid", "new"] and len({got["none", s].behind for s in ("old", "mid", "new")}) == 3
    assert got["two", "new"].at == got["two", "mid"].at == day(9) and got["two", "new"].behind > got["two", "mid"].behind > got["two", "old"].behind
    assert got["far", "new"].at == day(9)


def test_best_record_of_a_group_without_time(spark):
    # in dated groups a link with a score comes before one without; the undated group's keeper has no link
    rows = [(i, f"d{i // 2}", "Pale Owl", f"Act{i // 2} Lee", 50 if i % 2 == 0 else None, f"x:d{i // 2}", day(1 + i % 2)) for i in range(4)]
    rows += [(10, "u", "Iron River", "Bob Ray", 5, "x:u", None), (11, "u", "Iron River", "Bob Ray", None, "y:u", None), (12, "w", "Iron River", "Bob Ray", 9, "n/a", None)]
    df = spark.createDataFrame(rows, "row_id long, track_id string, t string, a string, p int, u string, at timestamp")
    got = {r.first_id: r for r in survivors.best_records(df, "row_id", "track_id", "t", "a", "p", "u", "at").collect()}
    assert (got[10].keeper_id, got[10].url_id, got[10].spotify_url) == (12, 11, "y:u")


def test_a_row_without_time_stands_with_its_value(spark):
    rows = [("g", "s", day(2), "a"), ("g", "s", day(5), "b"), ("g", "s", None, "a"), ("g", "s", None, "new"), ("g", "s", None, None)]
    df = spark.createDataFrame(rows, "component string, state string, at timestamp, url string")
    got = {r.url: tuple(r.currency) for r in survivors.placed(df, "url").filter("at is null").collect()}
    assert got == {"a": (day(2), 1), "new": (None, 1), None: (None, 1)}
    dated = {r.url: tuple(r.currency) for r in survivors.placed(df.filter("at is not null"), "url").collect()}
    assert dated == {"a": (day(2), 0), "b": (day(5), 0)}


def test_lengths_decide_before_edges_are_made(spark):
    """Nodes that share an attribute make no edge if their known lengths differ; an unknown length meets all."""
    from loomline.llm import linkage

    of = lambda rows: spark.createDataFrame([(i, low, high, ["k"]) for i, low, high in rows], "node long, low double, high double, keys array<string>")
    tracks = [(i, 10.0 * i, 10.0 * i + 1) for i in range(1, 40)] + [(90, None, None)]
    files = [(i, 10.0 * i + 5, 10.0 * i + 5) for i in range(1, 40)] + [(91, None, None)]
    got = {(r.track_node, r.file_node) for r in linkage._candidates(of(tracks), of(files)).collect()}
    assert got == {(i, i) for i in range(1, 40)} | {(i, 91) for i in range(1, 40)} | {(90, i) for i in range(1, 40)} | {(90, 91)}
