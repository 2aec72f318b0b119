"""Problem 2: tracks and files of one recording, without a common key.

1. Tracks with equal first act, title words and version are one node. A file has several
   readings of its act and title, from its tags and its path; files with equal readings and
   length are one node.
2. Nodes are joined by rare shared attributes: the phonetic code of a word of the act beside
   those of two words of the title. An edge weighs as much as its attributes are rare.
3. Meta-blocking drops edges that are weak against the best edges of both their nodes.
4. Edges are compared: title words, version, names of acts, length. Then confidence spreads:
   an edge gains where other titles of the same two acts match too, until no confidence grows.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from ..sources.tables import cut_lineage
from .names import COMMON_WORDS, COMPILATION, acts, full_forms, phonetic, same_act, shortened, tokens
from .name_variants import common_words
from .plain_text import plain_batch
from .titles import parse_title, same_title

#: Share of a node's best edge weight below which an edge is dropped, if it is so at both ends.
KEEP = 0.05
#: Confidence from which two records are one recording.
ACCEPT = 0.55
#: Seconds by which lengths of one recording may differ.
SECONDS = 4.0
#: What a pair of acts can gain from other matched titles.
CONTEXT = 0.8
#: Gain of two acts in a round, over all their titles, below which their confidences are stable.
STABLE = 1e-6
#: Words of a title up to which each two are an attribute. Of more words neighbours in a ring are:
#: two slips, and titles with more are not taken for one, touch four of these pairs at most.
EACH_TWO = 4
#: Rows of one side of an attribute that meet the other side in one task.
BLOCK = 2000

READINGS = "acts array<array<string>>, titles array<struct<words:array<string>,version:array<string>>>"


def _plain(values: pd.Series) -> list[str]:
    return plain_batch(pa.array(values.fillna(""), pa.string()))[0].to_pylist()


def _first_act(credit: str) -> tuple[str, ...]:
    named = acts(credit)
    return tokens(named[0]) if named else ()


def _tracks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(track_id, act, words, version, low, high) of rows with an act and a title."""
    for f in frames:
        out = []
        for track, title, act, low, high in zip(f["track_id"], _plain(f["title"]), _plain(f["act"]), f["low"], f["high"], strict=True):
            words, version = parse_title(title)
            who = _first_act(act)
            if words and who:
                out.append((track, list(who), list(words), list(version), low, high))
        yield pd.DataFrame(out, columns=["track_id", "act", "words", "version", "low", "high"])


def path_readings(path: str) -> tuple[list[str], list[str]]:
    """Acts and titles that a path in plain form may name, best first."""
    folders = path.replace("\\", "/").split("/")
    stem = re.sub(r"\.[A-Za-z0-9]{2,5}$", "", folders[-1])
    if "_-_" in stem or " " not in stem:
        stem = stem.replace("_", " ")
    stem = re.sub(r"^\s*\d{1,3}\s*(?:[-.]\s+|\s(?=\S))", "", stem).strip()
    parts = re.split(r"\s+[-–—]\s+", stem)
    who, titles = [], [stem]
    if len(parts) > 1:
        who.append(parts[0])
        titles.insert(0, " - ".join(parts[1:]))
        if len(parts) > 2:  # an act with a dash in its name
            who.append(" - ".join(parts[:2]))
            titles.append(" - ".join(parts[2:]))
    if len(folders) > 2:
        folder = folders[1] if len(folders) > 3 else re.split(r"\s+[-–—]\s+", folders[-2])[0]
        who.append(folder.replace("_", " "))
    return [w for w in who if w.strip()], [t for t in titles if t.strip()]


def _files(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(file_id, length, acts, titles) with every reading of tags and path."""
    for f in frames:
        out = []
        rows = zip(f["file_id"], f["length"], _plain(f["artist"]), _plain(f["albumartist"]), _plain(f["title"]), _plain(f["path"]), strict=True)
        for file, length, artist, albumartist, title, path in rows:
            path_acts, path_titles = path_readings(path)
            who = [_first_act(a) for a in (artist, albumartist, *path_acts)]
            who = list(dict.fromkeys(w for w in who if w and w != (COMPILATION,)))
            named = [title] if title.strip() else []
            if named and len(pieces := re.split(r"\s+[-–—]\s+", title)) > 1:
                named.append(" - ".join(pieces[1:]))
            titles = list(dict.fromkeys(t for t in map(parse_title, [*named, *path_titles]) if t[0]))
            if who and titles:
                out.append((file, length, [list(w) for w in who], [{"words": list(w), "version": list(v)} for w, v in titles]))
        yield pd.DataFrame(out, columns=["file_id", "length", "acts", "titles"])


def attribute_keys(act: list[str], title: list[str], common: frozenset[str] = COMMON_WORDS) -> set[str]:
    """The attributes of one act and one title.

    An attribute is the sound of a word of the act beside the sounds of two title words. Of
    three or four title words each two are an attribute, of more each and the next; of one or two also every sound
    that lacks a character: a title with one word mistyped still shares an attribute with the
    right one. If only one word of an act is not a ``common`` one, that word may hold a slip.
    """
    main = [w for w in act if w not in COMMON_WORDS and len(w) > 1] or list(act)
    sounds = {w: {phonetic(f) for f in full_forms(w)} for w in main}
    telling = [w for w in main if w not in common] or main
    if len(telling) == 1:
        sounds[telling[0]] |= shortened(phonetic(telling[0]))
    code = [phonetic(w) for w in title]
    pair = lambda a, b: "&".join(sorted((a, b)))
    lacking = lambda c: shortened(c) | ({*c, ""} if len(c) < 3 else set())  # noqa: E731 - also of a short sound
    if len(code) == 1:
        whole, near = {code[0]}, shortened(code[0])
    elif len(code) == 2:
        whole, near = {pair(*code)}, {pair(v, code[1]) for v in lacking(code[0])} | {pair(code[0], v) for v in lacking(code[1])}
    else:
        each = ((x, y) for i, x in enumerate(code) for y in code[i + 1 :]) if len(code) <= EACH_TWO else zip(code, [*code[1:], code[0]], strict=True)
        whole = near = {pair(x, y) for x, y in each}
    return {f"{s}|{c}" for w in main for s in sounds[w] for c in whole} | {f"{phonetic(w)}|{c}" for w in main for c in near}


def _keyed(frames: Iterator[pd.DataFrame], common: frozenset[str]) -> Iterator[pd.DataFrame]:
    for f in frames:
        keys = []
        for who, readings in zip(f["acts"], f["titles"], strict=True):
            found: set[str] = set()
            for title in readings:
                for act in who:
                    found |= attribute_keys(list(act), list(title["words"]), common)
            keys.append(sorted(found))
        yield f[["node", "low", "high"]].assign(keys=keys)


def _score(frames: Iterator[pd.DataFrame], common: frozenset[str]) -> Iterator[pd.DataFrame]:
    """Per edge the likeness of titles (with versions, and whether both lengths are known) and of names."""
    for f in frames:
        title, name, who = np.zeros(len(f)), np.zeros(len(f)), [""] * len(f)
        columns = (f[c] for c in ("t_act", "t_titles", "f_acts", "f_titles", "timed"))
        for i, (t_act, t_titles, f_acts, f_titles, timed) in enumerate(zip(*columns, strict=True)):
            mine = t_titles[0]
            best = 0.0
            for other in f_titles:
                if list(mine["version"]) == list(other["version"]):
                    best = max(best, same_title(list(mine["words"]), list(other["words"]), list(mine["df"]), list(other["df"])))
            if not best:
                continue
            title[i] = best * (1.0 if timed else 0.92)
            own = tuple(t_act[0])
            scores = [(same_act(own, tuple(a), common=common), -k) for k, a in enumerate(f_acts)]
            name[i] = max(scores)[0]
            who[i] = " ".join(f_acts[0])
        words = [" ".join(t[0]["words"]) for t in f["t_titles"]]
        out = f[["track_node", "file_node", "t_name"]].assign(f_name=who, t_title=words, title=title, name=name)
        yield out[out["title"] > 0]


def _with_frequencies(nodes: DataFrame) -> DataFrame:
    """``nodes`` (side, node, acts, titles, low, high) with, beside the words of each title, in how many titles each stands."""
    words = nodes.select("side", "node", F.posexplode("titles").alias("reading", "t")).select("side", "node", "reading", F.posexplode("t.words").alias("at", "word"))
    df = words.groupBy("word").agg(F.count("*").cast("int").alias("df"))
    back = words.join(df, "word").groupBy("side", "node").agg(F.array_sort(F.collect_list(F.struct("reading", "at", "df"))).alias("all"))
    own = lambda i: F.transform(F.filter("all", lambda x: x["reading"] == i), lambda x: x["df"])
    titles = F.transform("titles", lambda t, i: F.struct(t["words"].alias("words"), t["version"].alias("version"), own(i).alias("df")))
    return nodes.join(back, ["side", "node"]).select("side", "node", "acts", titles.alias("titles"), "low", "high")


def _candidates(tracks: DataFrame, files: DataFrame) -> DataFrame:
    """(track_node, file_node) of the edges that meta-blocking leaves.

    Nodes whose known lengths differ too much are no recording, whatever their names: they make no
    edge, so edges do not grow with all that share a word. A large attribute is a grid of tasks,
    so none holds all of it.
    """
    # an attribute travels as a hash: two that share one by chance are one more candidate, which is compared as any other
    keyed = lambda df: df.select("node", "low", "high", F.explode("keys").alias("k")).select("node", "low", "high", F.xxhash64("k").alias("key"))
    left, right = keyed(tracks), keyed(files)
    total = F.lit(1.0) + tracks.agg(F.count("*").alias("n")).scalar() + files.agg(F.count("*").alias("n")).scalar()
    sizes = left.groupBy("key").agg(F.count("*").alias("n_left")).join(right.groupBy("key").agg(F.count("*").alias("n_right")), "key")
    weight = F.log2(total / (F.col("n_left") + F.col("n_right")) + 1)
    parts = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    sizes = sizes.select("key", parts("n_left").alias("rows"), parts("n_right").alias("columns"), weight.alias("weight"))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = left.join(sizes, "key").select("key", F.col("node").alias("track_node"), "low", "high", "weight", own("rows").alias("row"), every("columns").alias("column"))
    b = right.join(sizes, "key").select("key", F.col("node").alias("file_node"), F.col("low").alias("length"), own("columns").alias("column"), every("rows").alias("row"))
    fits = F.col("length").isNull() | F.col("high").isNull() | F.col("length").between(F.col("low") - SECONDS, F.col("high") + SECONDS)
    edges = cut_lineage(a.join(b, ["key", "row", "column"]).filter(fits).groupBy("track_node", "file_node").agg(F.sum("weight").alias("weight")))
    best_t = edges.groupBy("track_node").agg((F.max("weight") * KEEP).alias("floor_t"))
    best_f = edges.groupBy("file_node").agg((F.max("weight") * KEEP).alias("floor_f"))
    kept = edges.join(best_t, "track_node").join(best_f, "file_node").filter((F.col("weight") >= F.col("floor_t")) | (F.col("weight") >= F.col("floor_f")))
    return kept.select("track_node", "file_node")


def spread(edges: DataFrame) -> DataFrame:
    """``edges`` (track_node, file_node, t_name, f_name, title, name) with their ``confidence``.

    confidence = title * (name + (1 - name) * CONTEXT * s / (1 + s)), where s sums the best
    confidences of the other titles that the two acts share. Each round uses the last one's.
    Values only grow and are bounded. Two acts are done when the sum over their titles, and so
    every confidence, gains less than STABLE; they depend on no other acts, and rounds go on
    with the rest.
    """
    acts_key = ["t_name", "f_name"]
    now = cut_lineage(edges.withColumns({"confidence": F.col("title") * F.col("name"), "before": F.lit(0.0)}))
    # without a second title of the two acts nothing can grow
    wide = now.groupBy(*acts_key).agg(F.count_distinct("t_title").alias("n")).filter("n > 1").select(*acts_key)
    done = [now.join(wide, acts_key, "left_anti").select(*edges.columns, "confidence")]
    now = cut_lineage(now.join(wide, acts_key, "left_semi"))
    while not now.isEmpty():
        # titles that match without any likeness of the names count a little: they are what names alone cannot show
        per_title = now.groupBy(*acts_key, "t_title").agg(F.greatest(F.max("confidence"), F.max("title") * 0.4).alias("own"))
        sums = per_title.groupBy(*acts_key).agg(F.sum("own").alias("all"))
        context = per_title.join(sums, acts_key).select(*acts_key, "t_title", "all", F.greatest(F.col("all") - F.col("own"), F.lit(0.0)).alias("s"))
        nxt = now.drop("confidence").join(context, [*acts_key, "t_title"])
        gained = F.col("name") + (1 - F.col("name")) * CONTEXT * F.col("s") / (1 + F.col("s"))
        moving = F.col("all") - F.col("before") >= STABLE
        nxt = cut_lineage(nxt.select(*edges.columns, (F.col("title") * gained).alias("confidence"), F.col("all").alias("before"), moving.alias("moving")))
        done.append(nxt.filter(~F.col("moving")).select(*edges.columns, "confidence"))
        now = nxt.filter("moving").drop("moving")
    return functools.reduce(DataFrame.unionByName, done)


def recordings(
    tracks: DataFrame, track_id: str, track_title: str, track_act: str, track_ms: str,
    files: DataFrame, file_id: str, artist: str, albumartist: str, title: str, path: str, length: str,
) -> DataFrame:
    """(track_id, file_id, confidence) of every track and file of one recording.

    Null and blank ids of tracks, and records without any act or title, match nothing.
    Repeated rows are one. Lengths of 0 or null are unknown. Editions, guests, cases, accents
    and character forms do not tell recordings apart; versions do. Only the columns named are read.
    """
    ms = F.when(F.col(track_ms) > 0, F.col(track_ms) / 1000.0)
    rows = tracks.select(F.trim(track_id).alias("track_id"), F.col(track_title).alias("title"), F.col(track_act).alias("act"), ms.alias("s")).filter(F.col("track_id") != "")
    rows = rows.groupBy("track_id", "title", "act").agg(F.min("s").alias("low"), F.max("s").alias("high"))
    parsed = rows.mapInPandas(_tracks, "track_id string, act array<string>, words array<string>, version array<string>, low double, high double")
    node = F.concat_ws("|", F.array_join("act", " "), F.array_join("words", " "), F.array_join("version", " "))
    parsed = cut_lineage(parsed.withColumn("node", node))
    t_nodes = parsed.groupBy("node").agg(F.first("act").alias("act"), F.first("words").alias("words"), F.first("version").alias("version"), F.min("low").alias("low"), F.max("high").alias("high"))
    t_nodes = numbered(t_nodes)  # nodes travel as numbers
    f_rows = files.select(
        F.col(file_id).cast("long").alias("file_id"), F.col(artist).alias("artist"), F.col(albumartist).alias("albumartist"), F.col(title).alias("title"), F.col(path).alias("path"), F.col(length).cast("double").alias("length")
    ).distinct()
    signature = F.md5(F.to_json(F.struct("acts", "titles", "length")))
    f_parsed = cut_lineage(f_rows.repartition("file_id").mapInPandas(_files, f"file_id long, length double, {READINGS}").withColumn("node", signature))
    # files with equal readings and lengths, however many, are one node
    f_nodes = numbered(f_parsed.groupBy("node").agg(F.first("acts").alias("acts"), F.first("titles").alias("titles"), F.first("length").alias("length")))
    known = lambda c: F.when((F.col(c) > 0) & ~F.isnan(c), F.col(c))
    both = t_nodes.select(
        F.lit("t").alias("side"), F.col("code").alias("node"), F.array("act").alias("acts"), F.array(F.struct("words", "version")).alias("titles"), known("low").alias("low"), known("high").alias("high")
    ).unionByName(f_nodes.select(F.lit("f").alias("side"), F.col("code").alias("node"), "acts", "titles", known("length").alias("low"), known("length").alias("high")))
    full = cut_lineage(_with_frequencies(both))
    common = common_words(t_nodes.select(F.col("act").alias("words")).distinct())
    tagged = lambda side: full.filter(F.col("side") == side).select("node", "acts", "titles", "low", "high").repartition("node").mapInPandas(lambda f: _keyed(f, common), "node long, low double, high double, keys array<string>")
    edges = _candidates(cut_lineage(tagged("t")), cut_lineage(tagged("f")))
    first = F.array_join(F.col("acts")[0], " ")
    left = full.filter("side = 't'").select(F.col("node").alias("track_node"), F.col("acts").alias("t_act"), F.col("titles").alias("t_titles"), first.alias("t_name"), F.col("high").alias("t_high"))
    right = full.filter("side = 'f'").select(F.col("node").alias("file_node"), F.col("acts").alias("f_acts"), F.col("titles").alias("f_titles"), F.col("high").alias("f_high"))
    timed = (F.col("t_high").isNotNull() & F.col("f_high").isNotNull()).alias("timed")
    scored = edges.join(left, "track_node").join(right, "file_node").select("track_node", "file_node", "t_name", "t_act", "t_titles", "f_acts", "f_titles", timed).mapInPandas(
        lambda f: _score(f, common), "track_node long, file_node long, t_name string, f_name string, t_title string, title double, name double"
    )
    found = spread(scored).filter(F.col("confidence") >= ACCEPT).select("track_node", "file_node", "confidence")
    named = lambda rows, id_, nodes, end: rows.select(id_, "node").distinct().join(nodes.select("node", F.col("code").alias(end)), "node").drop("node")
    out = found.join(named(parsed, "track_id", t_nodes, "track_node"), "track_node").join(named(f_parsed, "file_id", f_nodes, "file_node"), "file_node")
    return out.groupBy("track_id", "file_id").agg(F.max("confidence").alias("confidence"))
