"""Order-dependent operators, dedup, matching and plans against small models."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from loomline.operators import canonical, dedup, existence, matching, ordering, resolve
from loomline.plans import album_plans
from loomline.sources import pages

TRACK = "seq long, playlist_id string, playlist_name string, track_id string, track_name string, artist_names string, album_name string, duration_ms long, explicit boolean, popularity int, spotify_url string, track_number int"


def track(seq, pid, pname, tid, name, artists="A", pop=1, album="", ms=0, number=None):
    return (seq, pid, pname, tid, name, artists, album, ms, False, pop, f"u{tid}", number)


def test_first_seen_and_places(spark):
    rows = [(i, f"g{i % 3}", i * 10) for i in range(50)] + [(60, None, 5)]
    df = spark.createDataFrame(rows, "seq long, g string, v int")
    assert {(r.g, r.seq) for r in ordering.first_seen(df, ["g"], "seq").collect()} == {("g0", 0), ("g1", 1), ("g2", 2), (None, 60)}
    places = ordering.position_in_group(df.repartition(7), ["g"], "seq", span=8).collect()
    assert {(r.seq, r.place) for r in places} == {(i, i // 3 + 1) for i in range(50)} | {(60, 1)}
    cut = ordering.batches(df.repartition(5), [F.col("seq")], 20).collect()
    assert {(r.seq, r.batch) for r in cut} == {(i, i // 20) for i in range(50)} | {(60, 2)}
    assert ordering.batches(df.filter("1=0"), [F.col("seq")], 20).count() == 0


def test_upsert(spark):
    old = spark.createDataFrame([("a", 0, "x"), ("b", 1, "y")], "id string, seq long, v string")
    new = spark.createDataFrame([("b", 0, "z"), ("c", 1, "w")], "id string, seq long, v string")
    assert sorted((r.place, r.id, r.v) for r in ordering.upsert(old, new, "id", "seq").collect()) == [(0, "a", "x"), (1, "b", "z"), (3, "c", "w")]


def model_names(names):
    taken, out = set(), []
    for base, ext in names:
        name, n = base + ext, 2
        while name.lower() in taken:
            name, n = f"{base} ({n}){ext}", n + 1
        taken.add(name.lower())
        out.append(name)
    return out


def test_unique_names_like_a_loop(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["f0", "f1", "f2", None]), rng.choice(["x", "X", "x (2)", "y", "x (2) (2)", "z", "x (3)"]), rng.choice([".mp3", ".MP3", ".flac"])) for i in range(120)]
    df = spark.createDataFrame(rows, "seq long, folder string, b string, e string")
    got = {r.seq: r.unique_name for r in ordering.unique_names(df.repartition(6), ["folder"], F.col("b"), F.col("e"), "seq").collect()}
    for f in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == f]
        assert [got[r[0]] for r in mine] == model_names([(r[2], r[3]) for r in mine])


def model_manifest(rows, fuzzy):
    """The two passes as loops over rows in order."""
    ids = {}
    for _, pid, pname, tid, name, artists, *_rest, pop, _url, _n in rows:
        if not tid:
            continue
        if tid not in ids:
            ids[tid] = {"id": tid, "name": name, "artists": artists, "pop": pop, "names": [pname or ""], "ids": [pid or ""]}
        elif pname and pname not in ids[tid]["names"]:
            ids[tid]["names"].append(pname)
            if pid:
                ids[tid]["ids"].append(pid)
    groups = {}
    for t in ids.values():
        t = t | {"names": "; ".join(n for n in t["names"] if n), "ids": "; ".join(i for i in t["ids"] if i)}
        groups.setdefault(fuzzy(t["artists"], t["name"]), []).append(t)
    out = []
    for g in groups.values():
        keeper = max(g, key=lambda t: t["pop"])
        names = keeper["names"] if len(g) == 1 else "; ".join(sorted({n for t in g for n in t["names"].split("; ") if n}))
        out.append((keeper["id"], names, keeper["ids"], len([n for n in names.split("; ") if n]) if len(g) > 1 else len([n for n in keeper["names"].split("; ") if n])))
    return set(out)


def test_manifest_like_loops(spark):
    rng = random.Random(5)
    rows = [
        track(i, rng.choice(["p1", "p2", "", None]), rng.choice(["One", "Two", "Three", "", None]), rng.choice(["t1", "t2", "t3", "t4", "", None]), "", pop=0) for i in range(80)
    ]
    titles = {"t1": ("Song", 5), "t2": ("Song (Live)", 5), "t3": ("Other", 1), "t4": ("song feat. X", 9)}
    rows = [(*r[:4], titles.get(r[3], ("n", 0))[0], *r[5:9], titles.get(r[3], ("n", 0))[1], *r[10:]) for r in rows]
    got = {(r.track_id, r.playlist_names, r.playlist_ids, r.playlist_count) for r in dedup.manifest(spark.createDataFrame(rows, TRACK).repartition(5)).collect()}
    fuzzy = lambda a, t: (a.lower(), t.lower().split(" feat")[0].split(" (")[0])
    assert got == model_manifest(rows, fuzzy)
    assert dedup.manifest(spark.createDataFrame([], TRACK)).count() == 0


LIBRARY = "file_id long, artist string, albumartist string, album string, track string, title string, path string, length double"
FILES = [
    (1, "Ann", None, "Red", "1", "Night Drive", "albums/Ann - Red/01.mp3", 100.0), (2, "Ann", None, "Blue", "2/9", "Night Drive", "albums/Ann - Blue/02.mp3", 104.0),
    (3, "Bob", None, "Red", "3", "Sky (feat. Cy)", "singles/s.mp3", 50.0), (4, "Zed", None, "Gold", "4", "Night Drives", "x.mp3", 200.0), (5, "Ann", None, "Sym", "5", "$$$", "y.mp3", 60.0),
    (6, None, "Dan", "Pos", "6", "???", "z.mp3", 0.0), (7, "Eve", "Fay", "Red", "7", "Night Drive", "w.mp3", 101.0), (8, "Ann", None, "Red", "x", "Long", "v.mp3", 300.0),
]


def test_match_tiers(spark):
    rows = [
        track(1, "p", "P", "t1", "Night Drive", "Ann", ms=103_000), track(2, "p", "P", "t2", "Night Drive", "Nobody, Eve", ms=0), track(3, "p", "P", "t3", "Night Drive", "Nobody", album="Red", ms=0),
        track(4, "p", "P", "t4", "Sky", "Bob", ms=50_000), track(5, "p", "P", "t5", "Night Drivess", "Nobody", ms=200_000), track(6, "p", "P", "t6", "$$$", "Ann"), track(7, "p", "P", "t7", "!!", "Q", album="Pos", number=6),
        track(8, "p", "P", "", "", ""), track(9, "p", "P", "t9", "Unknown Thing", "Ann"), track(10, "p", "P", "t1", "Other", "Ann"), track(11, "q", "Q", "t1", "Other", "Ann"),
        track(12, "p", "P", "t12", "Long", "Ann", ms=400_000), track(13, "p", "P", "t13", "Night Drivess", "Nobody", ms=300_000), track(14, "p", "P", "t14", "Night Drive", "Nobody, Fay"),
    ]
    out = matching.match_rows(spark.createDataFrame(rows, TRACK), spark.createDataFrame(FILES, LIBRARY)).collect()
    got = {r.seq: (r.tier, r.file_id) for r in out}
    assert got == {
        1: ("title+primary", 2), 2: ("title+primary", 7), 3: ("title+album", 1), 4: ("core-title", 3), 5: ("fuzzy", 4), 6: ("raw-title", 5), 7: ("album+track", 6), 8: ("local-no-meta", None),
        9: ("unmatched", None), 10: ("title+primary", 2), 11: ("unmatched", None), 12: ("title+primary", 8), 14: ("title+artist", 7), 13: ("unmatched", None),
    }
    total = {r.playlist_id: (r.n_rows, r.n_matched) for r in matching.match_summary(matching.match_rows(spark.createDataFrame(rows, TRACK), spark.createDataFrame(FILES, LIBRARY))).collect()}
    assert total == {"p": (13, 10), "q": (1, 0), None: (14, 10)}
    assert matching.match_rows(spark.createDataFrame([], TRACK), spark.createDataFrame(FILES, LIBRARY)).count() == 0
    assert {r.tier for r in matching.match_rows(spark.createDataFrame(rows, TRACK), spark.createDataFrame([], LIBRARY)).collect()} == {"unmatched", "local-no-meta"}


def test_letter_bound_never_hides_a_ratio():
    rng = random.Random(1)
    import pandas as pd

    a = pd.Series(["".join(rng.choices("abc1", k=rng.randint(4, 14))) for _ in range(3000)])
    b = pd.Series([x if rng.random() < 0.3 else x[:-1] + rng.choice("abcz") for x in a])
    got = matching._ratios(a, b)
    want = [SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)]
    assert all(g == w if w >= matching.LEAST_RATIO else g in (0, w) for g, w in zip(got, want, strict=True))


def files(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "file_id long, path string, artist string, albumartist string, album string, title string, track string")


def test_votes(spark):
    rows = [(f"a{i}", a, None, "One", "t", "1") for i, a in enumerate(["A", "a!", "B", "C"])] + [(f"b{i}", a, None, "Two", "t", "1") for i, a in enumerate(["A & B", "A & C", "D"])]
    rows += [(f"c{i}", a, None, "Three", "t", "1") for i, a in enumerate(["A", "B", "C"])] + [(f"d{i}", a, None, "Four", "t", "1") for i, a in enumerate(["A", "B"])]
    rows += [("e0", "X", None, "", "t", "1"), ("e1", "X", None, None, "t", "1"), ("f0", "X", "", "宇多", "t", "1"), ("f1", "X", "Y", "田", "t", "1")]
    f = canonical.grouped(canonical.scan(files(spark, rows)))
    votes = {r.group: r.albumartist_vote for r in canonical.album_artists(f).collect()}
    assert [votes[g] for g in ("a:one", "a:two", "a:three", "a:four", "a:")] == ["A", "A", "Various Artists", "A", "X"]
    assert {r.group: r.n for r in canonical.group_sizes(f).collect()}["a:"] == 2 and sum(g.startswith("s:") for g in votes) == 2


def test_cleanup_plan_is_idempotent(spark):
    rng = random.Random(2)
    rows = [(f"in/{i}.mp3", rng.choice(["Ann", "Bob", "Ann & Cy"]), rng.choice(["", "Ann", None]), rng.choice(["Red", "red!", "Blue", "", None]), rng.choice(["One", "Two", "one", ""]), rng.choice(["1", "2", "", "x"])) for i in range(60)]
    plan = album_plans.cleanup_plan(files(spark, rows)).collect()
    assert len(plan) == 60 and len({r.dst.lower() for r in plan if r.kind == "album"}) == sum(r.kind == "album" for r in plan)
    done = {r.seq: r for r in plan}
    applied = [(done[i].dst, r[1], done[i].albumartist if done[i].tag_write else r[2], r[3], r[4] or f"{i}", r[5]) for i, r in enumerate(rows)]
    again = album_plans.cleanup_plan(files(spark, applied))
    assert not any(r.tag_write for r in again.collect())
    assert album_plans.cleanup_plan(files(spark, rows[:1]).filter("1=0")).count() == 0


def test_stage_plan(spark):
    library = files(spark, [("albums/Ann - Red/01 - Ann - One.mp3", "Ann", "Ann", "Red", "One", "1"), ("albums/Dup/1.mp3", "Bob", "Bob", "Twice", "One", "1"), ("albums/Dup2/1.mp3", "Bob", "Bob", "Twice!", "One", "1")])
    new = files(spark, [("in/a.mp3", "Ann", "", "red", "One", "1"), ("in/b.mp3", "Ann", "", "Red", "Two", "2"), ("in/c.mp3", "Bob", "", "Twice", "X", "1"), ("in/d.mp3", "Bob", "", "Twice", "Y", "2"),
                        ("in/e.mp3", "Cy", "", "New", "Z", "1"), ("in/f.mp3", "Cy", "", "", "Z", "1"), ("in/g.mp3", "Dan", "", "Pair", "Z", "1"), ("in/h.mp3", "Dan", "", "Pair", "Z", "1")])
    got = {r.path: (r.outcome, r.dst, r.ambiguous) for r in album_plans.stage_plan(new, library).collect()}
    assert got == {
        "in/a.mp3": ("duplicate", None, False), "in/b.mp3": ("merge", "albums/Ann - Red/02 - Ann - Two.mp3", False), "in/c.mp3": ("stage", "incoming/albums/Bob - Twice/01 - Bob - X.mp3", True),
        "in/d.mp3": ("stage", "incoming/albums/Bob - Twice/02 - Bob - Y.mp3", True), "in/e.mp3": ("pass", None, False), "in/f.mp3": ("pass", None, False),
        "in/g.mp3": ("stage", "incoming/albums/Dan - Pair/01 - Dan - Z.mp3", False), "in/h.mp3": ("stage", "incoming/albums/Dan - Pair/01 - Dan - Z (2).mp3", False),
    }
    report = album_plans.stage_report(album_plans.stage_plan(new, library)).first()
    assert (report.scanned, report.staged, report.merged, report.duplicates, report.passed, report.staged_folders) == (8, 4, 1, 1, 2, 2)


def test_retry(spark):
    lines = spark.createDataFrame([(0, "u1  # LookupError"), (1, "u2"), (2, "# note"), (3, "u1  # other"), (4, "u1  # LookupError"), (5, "u3  # track_unavailable"), (6, "u4")], "seq long, line string")
    union = existence.reason_union(existence.failure_log(lines, "line", "seq"))
    assert {(r.url, tuple(r.reasons), r.first_seq) for r in union.collect()} == {("u1", ("LookupError", "other"), 0), ("u2", (), 1), ("u3", ("track_unavailable",), 5), ("u4", (), 6)}
    meta = spark.createDataFrame([("u1", "Ann", "One", "Red"), ("u2", "Bob", "Two", "")], "url string, artist string, track string, album string")
    stems = spark.createDataFrame([("bob two",)], "stem_key string")
    split = existence.retry_split(union, meta, stems)
    assert {(r.url, r.state) for r in split.collect()} == {("u1", "retry"), ("u2", "on_disk"), ("u4", "no_metadata")}
    assert [r.spotify_url for r in existence.retry_report(split).collect()] == ["u1", "u4"]
    assert existence.retry_split(union, meta, stems, include_unavailable=True).count() == 4


def test_resolve_and_remove(spark):
    lib = spark.createDataFrame(FILES, LIBRARY)
    specs = spark.createDataFrame([("Ann - Red",), ("albums/Ann - Blue",), ("Gold",), ("nothing",), ("Red",)], "spec string")
    found = resolve.resolve_albums(specs, lib.filter("file_id <> 4").unionByName(lib.filter("file_id = 4").withColumn("path", F.lit("albums/odd/x.mp3"))))
    got = {(r.spec, r.via, r.target) for r in found.collect()}
    assert got == {("Ann - Red", "folder", "albums/Ann - Red"), ("albums/Ann - Blue", "path", "albums/Ann - Blue"), ("Gold", "tag", "albums/odd"), ("Red", "tag", "albums/Ann - Red"), ("Red", "tag", "singles")}
    warned = {r.spec: r.n for r in resolve.resolution_warnings(specs, found).filter("warning is not null").collect()}
    assert warned == {"nothing": 0, "Red": 2}
    songs = spark.createDataFrame([("Eve - Night Drive",), ("Night Drive",), ("x.mp3",)], "spec string")
    assert {(r.spec, r.target) for r in resolve.resolve_songs(songs, lib).collect()} == {("Eve - Night Drive", "w.mp3"), ("Night Drive", "w.mp3"), ("Night Drive", "albums/Ann - Red/01.mp3"), ("Night Drive", "albums/Ann - Blue/02.mp3"), ("x.mp3", "x.mp3")}
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    assert {(r.path, r.action) for r in resolve.removal(paths("a", "b", "c", "a"), paths("b"), paths("a", "b")).collect()} == {("a", "remove"), ("b", "protected"), ("c", "missing")}
    deep = spark.createDataFrame([("soundtracks/s/one/t.mp3",), ("soundtracks/one/u.mp3",), ("albums/one/v.mp3",)], "path string")
    assert {r.target for r in resolve.resolve_folders(spark.createDataFrame([("One",)], "spec string"), deep, "soundtracks").collect()} == {"soundtracks/s/one", "soundtracks/one"}
    sizes = spark.createDataFrame([("albums/a/1.mp3", 10), ("albums/a/2.mp3", 20), ("singles/3.mp3", 5)], "path string, size long")
    inv = {(r["sub"], r["folder"]): (r.n_files, r.n_folders, r.bytes, r["size"]) for r in resolve.inventory(sizes).collect()}
    assert inv == {("albums", "a"): (2, 1, 30, "30 B"), ("singles", ""): (1, 0, 5, "5 B"), ("albums", None): (2, 1, 30, "30 B"), ("singles", None): (1, 0, 5, "5 B"), (None, None): (3, 1, 35, "35 B")}
    plan = resolve.collect_plan(spark.createDataFrame([("r/a", 0, 1), ("r/./a", 1, 0), ("q/b", 0, 0)], "path string, bucket int, seq long"), "r")
    assert [(r.rel, r.bucket) for r in plan.collect()] == [("a", 0)]
    rels = lambda *p: spark.createDataFrame([(x,) for x in p], "rel string")
    staged = resolve.stage_actions(rels("a", "b", "c"), rels("a"), link=True, source=rels("a", "b"))
    assert {(r.rel, r.action) for r in staged.collect()} == {("a", "skip"), ("b", "link"), ("c", "error")}
    back = resolve.unstage_actions(rels("a.mp3", "b.mp3", "p.m3u8", "q.m3u", "a.mp3"), rels("a.mp3", "b.mp3", "p.m3u8"), rels("b.mp3", "p.m3u8"))
    assert {(r.rel, r.action) for r in back.collect()} == {("a.mp3", "removed"), ("b.mp3", "protected"), ("p.m3u8", "m3u8_removed"), ("q.m3u", "missing")}
    acts = resolve.stage_actions(plan, spark.createDataFrame([("a",)], "rel string"), overwrite=True)
    assert [(r.rel, r.action) for r in acts.collect()] == [("a", "overwrite")]


def test_pages(spark):
    text = '{"playlist_id":"p","items":[{"track":null},{"track":{"id":"t","name":"n","artists":[{"name":"A"},{"name":null}],"album":{"name":"al"}},"added_at":"x"}]}'
    rows = pages.flatten_tracks(spark.createDataFrame([(text,), ("no json",), (None,)], "json string")).collect()
    assert [(r.track_id, r.artist_names, r.album_name, r.added_by, r.spotify_url) for r in rows] == [("t", "A, ", "al", None, "")]
    lists = '{"items":[{"id":"1","owner":{"id":"me","display_name":"Me"},"tracks":{"total":3}},{"id":"2","owner":{"id":"x"}}]}'
    df = spark.createDataFrame([(lists,)], "json string")
    assert [(r.id, r.owner, r.track_count) for r in pages.flatten_playlists(df, owner="me").collect()] == [("1", "Me", 3)] and pages.flatten_playlists(df).count() == 2
    first = '{"name":"Long","tracks":{"items":[{"id":"a","name":"n","artists":[{"name":"Q"}],"duration_ms":5,"explicit":true,"external_urls":{"spotify":"ua"}},{"id":"c","name":"no link"}]}}'
    later = '{"items":[null,{"id":"b","name":"m","artists":[],"external_urls":{"spotify":"ub"}},{"id":"a2","name":"n","external_urls":{"spotify":"ua"}}]}'
    albums = spark.createDataFrame([("al9", 0, first), ("al9", 1, later), ("al8", 0, first), ("al7", 0, "no json")], "album string, page_no long, json string")
    rows = pages.flatten_album_tracks(albums.filter("album = 'al9'"), "json", "album", "page_no").orderBy("page_no", "pos").collect()
    assert [(r.track_id, r.artist_names, r.album_name, r.duration_ms, r.explicit, r.popularity, r.spotify_url) for r in rows] == [
        ("a", "Q", "Long", 5, True, 0, "ua"), ("b", "", "Long", 0, False, 0, "ub"), ("a2", "", "Long", 0, False, 0, "ua"),
    ]
    ranked = spark.createDataFrame([(2, "https://h/album/al8"), (1, "s:album:al9"), (3, "bad")], "rank int, spotify_url string")
    assert {(r.track_id, r.spotify_url) for r in pages.expand_albums(ranked, albums).collect()} == {("a", "ua"), ("b", "ub")}
    saved = pages.flatten_saved(spark.createDataFrame([('{"items":[{"track":{"id":"t"},"seq":1},{"track":null}]}',)], "json string"))
    assert [(r.playlist_id, r.playlist_name, r.track_id) for r in saved.collect()] == [("liked_songs", "Liked Songs", "t")]


def test_small_picks(spark):
    images = spark.createDataFrame([("p", "a", 10, 0), ("p", "b", 30, 1), ("p", "c", 30, 2), ("q", "d", None, 0)], "id string, url string, width int, pos int")
    assert {(r.id, r.url) for r in resolve.widest_image(images, "id").collect()} == {("p", "b"), ("q", "d")}
    hits = spark.createDataFrame([("x", 2, 0, "T", "t", 1), ("x", 1, 0, "other", "t", 2), ("x", 1, 1, "T", "t", 3), ("y", 3, 0, "z", "t", 4)], "query string, search int, pos int, title string, wanted string, id long")
    assert {(r.query, r.id) for r in resolve.pick_hit(hits).collect()} == {("x", 3), ("y", 4)}
    old, new = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int"), spark.createDataFrame([("b", 3)], "id string, v int")
    assert {tuple(r) for r in resolve.scoped_refresh(old, new, "id").collect()} == {("a", 1), ("b", 3)}
    ids = [f"{n}" * 22 for n in range(1, 5)]
    lists = spark.createDataFrame([(ids[0], "One", "me"), (ids[1], "Two", "x"), (ids[2], "one", "me"), (ids[3], "Two", None), (ids[3], "Two", None)], "id string, name string, owner string")
    tokens = spark.createDataFrame([("One",), (f"https://h/playlist/{ids[1]}?si=1",), (ids[3],), ("gone",), ("Two ",)], "token string")
    pick = lambda **how: sorted(r.id for r in resolve.selected_playlists(lists, **how).collect())
    assert pick(tokens=tokens) == [ids[0], ids[1], ids[3], ids[3]] and pick(every=True, owner="me") == sorted([*ids, ids[3]]) and pick(owner="me") == [ids[0], ids[2]] and len(pick()) == 5
    fetched = {(r.token, r.id) for r in resolve.fetch_list(tokens, lists.withColumn("seq", F.monotonically_increasing_id())).collect()}
    assert {("One", ids[0]), (ids[3], ids[3]), ("gone", None), ("Two ", None)} <= fetched
    entries = spark.createDataFrame([("p1", "Mix", "a"), ("p1", "Mix", "b"), ("p2", "mix!", "c")], "playlist string, name string, path string")
    found = resolve.resolve_playlists(spark.createDataFrame([("MIX",)], "spec string"), entries, spark.createDataFrame([("a",)], "path string"))
    assert {(r.playlist, r.path, r.exists) for r in found.collect()} == {("p1", "a", True), ("p1", "b", False), ("p2", "c", False)}


def model_match(row, library):
    """The file of one row by loops: equal title and act, else the likest title with the same four first letters."""
    key = lambda s: "".join(c for c in (s or "").lower() if c.isalnum())
    _, _, _, _, title, artist, _, ms, *_ = row
    nt, want = key(title), ms / 1000
    same = [f for f in library if key(f[5]) == nt and key(f[1]) == key(artist)]
    if same:
        return min(same, key=lambda f: (bool(want) and abs(f[7] - want) > 5, abs(f[7] - want) if want else 0, f[0]))[0]
    best, best_ratio = None, 0.0
    for f in library:
        if key(f[5])[:4] != nt[:4] or (want and f[7] and abs(f[7] - want) > 3):
            continue
        ratio = SequenceMatcher(None, key(f[5]), nt).ratio()
        if ratio > best_ratio:
            best, best_ratio = f[0], ratio
    return best if best_ratio >= 0.92 else None


def test_summary_unmatched_and_lines_know_the_fuzzy_tier(spark, tmp_path):
    from loomline.plans import track_queries

    library = [(i, a, None, "", "1", t, f"albums/{i}.mp3", n) for i, (a, t, n) in enumerate([("Ann", "Night Drive Home", 100.0), ("Bob", "Night Drive Homes", 102.0), ("Cy", "Silver Lantern", 0.0), ("Dan", "Grey", 60.0)])]
    titles = [("Night Drive Home", "Ann", 0), ("Night Drive Homme", "Zed", 101_000), ("Night Drive Homess", "Zed", 0), ("Silver Lanterns", "Zed", 9_000), ("Silver Lanterns", "Cy", 0), ("Night Drive Homme", "Zed", 200_000), ("Grex", "Dan", 0), ("Golden", "Dan", 0)]
    rows = [track(i, f"p{i % 2}", "P", f"t{i}", t, a, ms=n) for i, (t, a, n) in enumerate(titles)]
    spark.createDataFrame(rows, TRACK).write.parquet(str(tmp_path / "playlist_tracks.parquet"))
    spark.createDataFrame(library, LIBRARY).write.parquet(str(tmp_path / "library.parquet"))
    want = {r[0]: model_match(r, library) for r in rows}
    assert sum(f is not None for f in want.values()) == 5
    d = str(tmp_path)
    assert {r.seq for r in track_queries.q_unmatched(spark, d).collect()} == {s for s, f in want.items() if f is None}
    total = {r.playlist_id: (r.n_rows, r.n_matched) for r in track_queries.q_match_summary(spark, d).collect()}
    count = lambda p: (sum(p(s) for s in want), sum(f is not None for s, f in want.items() if p(s)))
    assert total == {"p0": count(lambda s: s % 2 == 0), "p1": count(lambda s: s % 2 == 1), None: count(lambda s: True)}
    paths = {r.seq: r.line for r in track_queries.q_m3u_lines(spark, d).filter("part = 2").collect()}
    assert paths == {s: f"../albums/{f}.mp3" for s, f in want.items() if f is not None}


def test_like_titles_meet_where_all_pairs_would(spark, monkeypatch):
    """Every pair that reaches the ratio is met, also in a prefix that all titles have and in grids of small blocks."""
    monkeypatch.setattr(matching, "BLOCK", 2)
    rng = random.Random(5)
    titles = ["love", "loves", "lovely", "loveisall", "a", "ab", "abc", "lov", "love" + "a" * 30, "love" + "a" * 27, "love" + "ab" * 40]
    for base in ["lovemeinthemorninglight", "lovesongforthelastdancer", "lovetrain", "loverofmine12", "love" + "xyz" * 20, "nightdrive"]:
        for _ in range(8):
            word = list(base)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(word))
                word[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "e", "7"])
            titles.append("".join(word))
    titles = sorted(set(titles))
    like = lambda a, b: a[:4] == b[:4] and SequenceMatcher(None, b, a).ratio() >= matching.LEAST_RATIO
    want = {(a, b) for a in titles for b in titles if like(a, b)}
    rows = spark.createDataFrame([(t,) for t in titles], "t string")
    met = {tuple(r) for r in matching.like_titles(rows.select(F.col("t").alias("q_nt")), rows.select(F.col("t").alias("c_nt"))).collect()}
    assert want <= met and len(want) > len(titles)
    assert all(a[:4] == b[:4] for a, b in met) and len(met) < len(titles) ** 2 / 3
    none = rows.filter("1 = 0")
    assert matching.like_titles(none.select(F.col("t").alias("q_nt")), rows.select(F.col("t").alias("c_nt"))).isEmpty()


def test_albums_with_inner_folders(spark):
    """An album of two discs is one album; its first file is one right in the folder; pruned folders are no files."""
    rows = [
        (1, "a", "Ann", "Red", "1", "One", "albums/X/CD1/1.mp3", 1.0), (2, "a", "Ann", "Red", "1", "Two", "albums/X/CD2/1.mp3", 1.0), (3, "a", "Bea", "Red", "1", "Zed", "albums/X/z.mp3", 1.0),
        (4, "a", "Eve", "Blue", "1", "P", "albums/Y/__pycache__/p.mp3", 1.0), (5, "a", "Eve", "Loose", "1", "Q", "albums/q.mp3", 1.0),
        (6, "Bea", "Bea", "Red", "1", "two", "incoming/t.mp3", 1.0), (7, "Bea", "Bea", "Red", "2", "New", "incoming/n.mp3", 1.0),
    ]
    library = spark.createDataFrame(rows, LIBRARY)
    found = canonical.existing_albums(library).collect()
    assert [(r.aa_key, r.album_key, r.n_folders, r.folder, r.existing_aa) for r in found] == [("bea", "red", 1, "albums/X", "Bea")]
    plan = album_plans.stage_plan(library.filter("path like 'incoming/%'"), library)
    assert {(r.seq, r.outcome, r.dst) for r in plan.collect()} == {(6, "duplicate", None), (7, "merge", "albums/X/02 - Bea - New.mp3")}


def test_library_actions(spark):
    plan = spark.createDataFrame(
        [("in/a/x.mp3", "albums/A/x.mp3", True, "Ann", True), ("in/b/y.mp3", "in/b/y.mp3", False, None, False), ("old/z.mp3", "albums/A/z.mp3", True, "Ann", False)],
        "path string, dst string, move boolean, albumartist string, tag_write boolean",
    )
    got = {tuple(r) for r in album_plans.library_actions(plan).collect()}
    assert got == {("move", "in/a/x.mp3", "albums/A/x.mp3"), ("move", "old/z.mp3", "albums/A/z.mp3"), ("tag", "albums/A/x.mp3", "Ann"), ("prune", "in/a", None), ("prune", "old", None)}
    few = album_plans.shown(plan.select("path"), [F.col("path")], 2).collect()
    assert [(r.path, r.n_more) for r in few] == [("in/a/x.mp3", 1), ("in/b/y.mp3", 1)]


def test_targets_are_resolved_and_expanded(spark):
    library = spark.createDataFrame(FILES, LIBRARY)
    specs = spark.createDataFrame([(3, "album", "Ann - Red"), (1, "album", "albums/Ann - Red"), (2, "song", "Night Drive"), (4, "playlist", "Mix"), (5, "opera", "x"), (6, "soundtrack", "nowhere")], "seq long, kind string, spec string")
    entries = spark.createDataFrame([("p1", "Mix", "albums/Ann - Red/01.mp3"), ("p1", "Mix", "gone.mp3")], "playlist string, name string, path string")
    targets, warned = resolve.resolve_targets(specs, library, entries)
    got = {(r.bucket, r.target, r.seq) for r in targets.collect()}
    assert ("folders", "albums/Ann - Red", 1) in got and ("m3u8", "p1", 4) in got and ("files", "albums/Ann - Red/01.mp3", 2) in got
    said = {(r.kind, r.warning) for r in warned.collect()}
    assert ("opera", "unknown kind opera") in said and ("playlist", "p1: 1 track(s) not there (skipped)") in said and ("soundtrack", "no match for nowhere") in said
    items = resolve.expanded(targets, library)
    first = {r.path: r.bucket for r in resolve.collect_plan(items.withColumn("path", F.concat(F.lit("r/"), "path")), "r").select(F.col("rel").alias("path"), "bucket").collect()}
    assert first["albums/Ann - Red/01.mp3"] == 0 and first["p1"] == 2
    spec = lambda *s: spark.createDataFrame([(x,) for x in s], "spec string")
    assert resolve.needs_catalog("album", spec("Gold"), library) and not resolve.needs_catalog("album", spec("Ann - Red", "albums/Ann - Red"), library)
    assert not resolve.needs_catalog("playlist", spec("x"), library) and resolve.needs_catalog("song", spec("x"), library) and not resolve.needs_catalog("song", spec("x.mp3"), library)


def test_a_title_of_many_playlists_and_files_is_not_multiplied_out(spark, tmp_path, monkeypatch):
    from loomline.plans import exchange_queries

    n = 120
    d = str(tmp_path)
    lists = [(i, f"list{i:020d}", "Mix" if i % 2 else "mix", "Song" if i else "Gone") for i in range(n)]
    spark.createDataFrame(lists, "seq long, playlist_id string, playlist_name string, track_name string").write.parquet(f"{d}/playlist_tracks.parquet")
    spark.createDataFrame([(i, "Ann", "Ann", "Red", "1", "Song", f"albums/Ann - Red/{i}.mp3", 1.0) for i in range(n)],
                          "file_id long, artist string, albumartist string, album string, track string, title string, path string, length double").write.parquet(f"{d}/library.parquet")
    spark.createDataFrame([(7, "Red", "Other")], "row_id long, album_name string, track_name string").write.parquet(f"{d}/spotify_manifest.parquet")
    kept = []
    cut = exchange_queries.cut_lineage
    monkeypatch.setattr(exchange_queries, "cut_lineage", lambda df: kept.append(cut(df)) or kept[-1])
    targets, problems = exchange_queries.q_resolve_targets(spark, d).collect(), exchange_queries.q_resolve_problems(spark, d).collect()
    assert max(df.count() for df in kept) <= n  # not the n * n of the files of each list
    by = {b: {(r.target, r.seq) for r in targets if r.bucket == b} for b in ("files", "m3u8", "folders")}
    assert by["files"] == {(f"albums/Ann - Red/{i}.mp3", 0) for i in range(n)} and by["m3u8"] == {(x[1], 0) for x in lists} and by["folders"] == {("albums/Ann - Red", 7)}
    said = {(r.kind, r.spec, r.warning) for r in problems}
    assert {("playlist", s, f"{lists[0][1]}: 1 track(s) not there (skipped)") for s in ("Mix", "mix")} <= said and ("playlist", "mix", f"mix matched {n} targets") in said
    assert len(problems) == 2 + 2 + 3  # also a song and a soundtrack that are not there, and a kind that there is not
