"""Problem 3: the spellings of names that mean one act.

Distinct names are blocked by phonetic codes of their sorted tokens, where common words meet
beside near words only, compared by Jaro-Winkler with edit bounds and a table of nicknames, and accepted pairs are clustered by
connected components. A name with bare initials joins a cluster only if it fits no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut_lineage
from .components import connected_components
from .names import COMMON_WORDS, acts, block_keys, companions, has_initial, same_act, shared_keys, sounds_of, tokens
from .plain_text import plain_batch

#: Names of a block that one task compares with each other; larger blocks are cut into a grid.
BLOCK = 400
#: The same for names that meet at a common word, of which most pairs are dropped by an expression.
SHARED_BLOCK = 4000
#: A word is common if it stands beside different other words in this share of the names, and
#: beside at least so many. There can be no more than words of a name / COMMON_SHARE of them.
COMMON_SHARE, COMMON_LEAST = 1 / 400, 8


def _parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        plain = plain_batch(pa.array(frame["name"], pa.string()))[0].to_pylist()
        named = [acts(p) for p in plain]
        words = [tokens(a[0]) if len(a) == 1 else () for a in named]
        rows = [(n, list(w), has_initial(w)) for n, w in zip(frame["name"], words, strict=True) if any(w)]
        yield pd.DataFrame(rows, columns=["name", "words", "initial"])


def _companions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame([pair for w in frame["words"] for pair in companions(tuple(w))], columns=["word", "other"])


def _keyed(frames: Iterator[pd.DataFrame], common: frozenset[str]) -> Iterator[pd.DataFrame]:
    sounds = sounds_of(common)
    for frame in frames:
        words = [tuple(w) for w in frame["words"]]
        shared = [[{"key": k, "other": o} for k, o in sorted(shared_keys(w, common, sounds))] for w in words]
        yield frame.assign(keys=[sorted(block_keys(w, common)) for w in words], shared=shared)


def _compared(frames: Iterator[pd.DataFrame], common: frozenset[str]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        score = [same_act(tuple(a), tuple(b), common=common) for a, b in zip(frame["words_a"], frame["words_b"], strict=True)]
        out = frame[["a", "b"]].assign(score=score)
        yield out[out["score"] > 0]


def single_acts(names: DataFrame, name: str) -> DataFrame:
    """(name, words, initial) of the distinct names that name one act."""
    distinct = names.select(F.col(name).alias("name")).filter(F.trim("name") != "").distinct()
    spread = distinct.repartition("name")  # names cost Python time: spread them, few files or not
    return spread.mapInPandas(_parsed, "name string, words array<string>, initial boolean")


def common_words(nodes: DataFrame) -> frozenset[str]:
    """The words of ``nodes`` (words), distinct names, that do not tell acts apart: the known ones and those beside many others."""
    pairs = nodes.select("words").mapInPandas(_companions, "word string, other string").distinct()
    beside = pairs.groupBy("word").agg(F.count("*").alias("n"))
    least = F.greatest(F.lit(COMMON_LEAST), nodes.agg(F.count("*") * COMMON_SHARE).scalar())
    return COMMON_WORDS | {r.word for r in beside.filter(F.col("n") >= least).select("word").collect()}


def blocked_pairs(left: DataFrame, right: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Distinct pairs (a, b) of (node, keys) rows that share a key, ordered a < b within one table.

    Large blocks are cut into parts and every two parts meet in a task of their own.
    """
    plain = lambda df: df.select("node", F.transform("keys", lambda k: F.struct(k.alias("key"), F.lit("").alias("other"))).alias("keys"))
    return _met(plain(left), right if right is None else plain(right), block)


def shared_pairs(left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """Distinct pairs (a, b) of (node, shared) rows that meet at a common word beside words that can match.

    Whatever ``word_match`` takes for one word is near: an initial, a short form (all full forms
    are keys), and up to two edits, each of which may be a swap, one in words of less than eight letters.
    """
    of = lambda df: df.select("node", F.col("shared").alias("keys"))
    return _met(of(left), right if right is None else of(right), SHARED_BLOCK)


def _met(left: DataFrame, right: DataFrame | None, block: int) -> DataFrame:
    rows = lambda df, name: df.select(F.col("node").alias(name), F.explode("keys").alias("k")).select(name, "k.key", "k.other")
    own = rows(left, "a")
    sizes = own.groupBy("key").agg(F.count("*").alias("n"))
    if right is None:
        sizes = sizes.filter(F.col("n") > 1)
    parts = F.ceil(F.col("n") / block).cast("int")
    placed = own.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("a"), parts).cast("int"))
    theirs = placed.drop("part").withColumnRenamed("a", "b") if right is None else rows(right, "b").join(sizes, "key")
    spread = theirs.select("key", "b", F.col("other").alias("other_b"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    pairs = placed.select("key", "part", "a", "other").join(spread, ["key", "part"])
    short = F.least(F.length("other"), F.length("other_b")) < 2  # no word to check, or an initial
    size = F.greatest(F.length("other"), F.length("other_b"))
    near = short | F.when(size < 8, F.levenshtein("other", "other_b", 2) >= 0).otherwise(F.levenshtein("other", "other_b", 4) >= 0)
    return (pairs.filter(F.col("a") < F.col("b")) if right is None else pairs).filter(near).select("a", "b").distinct()


def spellings(names: DataFrame, name: str) -> DataFrame:
    """(words, cluster): each distinct spelling, folded to its words, with its act's cluster.

    ``names`` are the rows of ``single_acts``; spellings of equal words are one node from the start.
    """
    node = F.array_join("words", " ").alias("node")
    distinct = cut_lineage(names.groupBy(node).agg(F.first("words").alias("words"), F.first("initial").alias("initial")))
    common = common_words(distinct)
    nodes = cut_lineage(distinct.mapInPandas(lambda f: _keyed(f, common), "node string, words array<string>, initial boolean, keys array<string>, shared array<struct<key:string,other:string>>"))
    full, initials = nodes.filter(~F.col("initial")), nodes.filter(F.col("initial"))
    text = lambda side: nodes.select(F.col("node").alias(side), F.col("words").alias(f"words_{side}"))
    score = lambda pairs: pairs.join(text("a"), "a").join(text("b"), "b").mapInPandas(lambda f: _compared(f, common), "a string, b string, score double")
    candidates = lambda *sides: blocked_pairs(*sides).unionByName(shared_pairs(*sides)).distinct()
    links = cut_lineage(score(candidates(full)))
    clusters = full.select("node").join(connected_components(links, "a", "b"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    clusters = cut_lineage(clusters)
    fits = score(candidates(initials, full)).join(clusters.withColumnRenamed("node", "b"), "b")
    best = fits.groupBy("a", "component").agg(F.max("score").alias("score")).groupBy("a").agg(
        F.count("*").alias("n"), F.max(F.struct("score", "component")).alias("best")
    )
    known = cut_lineage(best.select(F.col("a").alias("node"), F.when(F.col("n") == 1, F.col("best.component")).alias("component")))
    free = initials.join(known, "node", "left_anti")
    alone = cut_lineage(score(candidates(free)))
    loose = free.select("node").join(connected_components(alone, "a", "b"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    unsure = known.filter(F.col("component").isNull()).select("node", F.col("node").alias("component"))
    return clusters.unionByName(known.filter(F.col("component").isNotNull())).unionByName(loose).unionByName(unsure)


def act_clusters(names: DataFrame, name: str) -> DataFrame:
    """(name, cluster) of every distinct non-blank name that names a single act.

    Null and blank names and names of several acts have no row; ``cluster`` is the smallest
    folded spelling of the act. Repeated names are one.
    """
    parsed = cut_lineage(single_acts(names, name).select("name", "words", "initial"))
    clusters = spellings(parsed, "name")
    return parsed.select("name", F.array_join("words", " ").alias("node")).join(clusters, "node").select("name", F.col("component").alias("cluster"))


def variant_pairs(names: DataFrame, name: str) -> DataFrame:
    """(name_a, name_b), name_a < name_b: two different spellings of one act, blocks never in one task."""
    rows = act_clusters(names, name).select(F.col("name").alias("node"), F.array("cluster").alias("keys"))
    return blocked_pairs(cut_lineage(rows)).select(F.col("a").alias("name_a"), F.col("b").alias("name_b"))
