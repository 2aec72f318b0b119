"""Problem 9: a mix of sources in which each has its target share of all tokens.

Texts become tokens of a public tokenizer, and each source's tokens are packed into blocks of
fixed length. The mix is a row of slots, cut into output shards. How many slots of a shard
each source gets is a multinomial draw under the condition that the totals over all shards
are the targets: the draw goes down a binary tree over the shards, so every shard finds its
own counts, and where each source's slots begin, from the seed alone, without any table of
shards. The j-th slot of a source is round j // n through its n blocks, each round in another
pseudorandom permutation of the block numbers. Slots and blocks are joined by block number.
"""

from __future__ import annotations

import functools
import math
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.tables import cut_lineage
from .hashing import mixed, passes

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed values of the default vocabulary: its pattern of pre-tokens and its end-of-text token.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_OF_TEXT = 50256
#: Documents of a source that are put in order by one task when block borders are found.
BUCKET_DOCS = 20_000
#: Sources whose targets and token counts the driver holds.
MOST_SOURCES = 10_000
#: Slots of one draw from which numpy's exact hypergeometric draw is replaced by its limits (numpy's bound).
MOST_DRAWN = 10**9
#: Slots of one source up to which such a draw is binomial; beyond, it is normal.
FEW_DRAWN = 10**6


def shipped(spark: SparkSession, path: str) -> str:
    """The name under which executors find the vocabulary file of the driver; it is sent to each of them once."""
    sent = spark.sparkContext.__dict__.setdefault("_loomline_files", set())
    if path not in sent:
        spark.sparkContext.addFile(path)
        sent.add(path)
    return os.path.basename(path)


@functools.cache
def _encoder(name: str, pattern: str):
    import base64

    import tiktoken
    from pyspark import SparkFiles

    with open(SparkFiles.get(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("mixing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _encoded(batches: Iterator[pa.RecordBatch], name: str, pattern: str, end: int | None) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(name, pattern)
    tail = [] if end is None else [end]
    for batch in batches:
        for part in passes(batch, "text"):
            tokens = [encoder.encode_ordinary(t) + tail for t in part.column("text").to_pylist()]
            sizes = pa.array([len(t) for t in tokens], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("source"), part.column("doc"), sizes, pa.array(tokens, pa.list_(pa.int32()))], names=["source", "doc", "n", "tokens"])


def tokenized(docs: DataFrame, doc_id: str, source: str, text: str, path: str = VOCABULARY, pattern: str = PATTERN, end: int | None = END_OF_TEXT) -> DataFrame:
    """(source, doc, n, tokens) of every document with text and a source; ``end`` closes each document."""
    rows = docs.select(F.col(source).alias("source"), F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    rows = rows.filter((F.col("text") != "") & F.col("source").isNotNull())
    name = shipped(docs.sparkSession, path)
    return rows.mapInArrow(lambda b: _encoded(b, name, pattern, end), "source string, doc long, n long, tokens array<int>")


def packed(tokens: DataFrame, block: int, n_docs: int) -> DataFrame:
    """(source, block, size, tokens): each source's tokens in blocks; the last may be short.

    The place of a document is a sum over buckets of documents plus one within its bucket, so
    no task sees a whole source.
    """
    buckets = max(1, math.ceil(n_docs / BUCKET_DOCS))
    placed = tokens.withColumn("bucket", F.pmod(F.xxhash64("doc"), F.lit(buckets)).cast("int"))
    sums = placed.groupBy("source", "bucket").agg(F.sum("n").alias("total"))
    earlier = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select("source", "bucket", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    inside = W.partitionBy("source", "bucket").orderBy("doc", "n", F.xxhash64("tokens")).rowsBetween(W.unboundedPreceding, -1)
    at = placed.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(bases, ["source", "bucket"])
    at = at.select("source", "tokens", "n", (F.col("base") + F.col("before")).alias("start"))
    low = F.floor(F.col("start") / block)
    spread = at.withColumn("block", F.explode(F.sequence(low, F.floor((F.col("start") + F.col("n") - 1) / block))))
    first = F.greatest(F.col("block") * block - F.col("start"), F.lit(0))
    last = F.least((F.col("block") + 1) * block - F.col("start"), F.col("n"))
    piece = F.struct((F.col("start") + first).alias("at"), F.slice("tokens", (first + 1).cast("int"), (last - first).cast("int")).alias("part"))
    joined = spread.select("source", "block", piece.alias("piece")).groupBy("source", "block").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    whole = joined.select("source", "block", F.flatten("pieces.part").alias("tokens"))
    return whole.select("source", "block", F.size("tokens").cast("long").alias("size"), "tokens")


@dataclass(frozen=True)
class Plan:
    """How many slots and blocks each source has; everything else follows from the seed."""

    sources: tuple[str, ...]
    slots: tuple[int, ...]
    blocks: tuple[int, ...]
    shard_slots: int
    seed: int

    @property
    def shards(self) -> int:
        return math.ceil(sum(self.slots) / self.shard_slots)


def plan(sources: list[str], shares: list[float], repeats: list[int], tokens: list[int], block: int, shard_slots: int, seed: int, total: int | None = None) -> Plan:
    """Slots per source: its share of ``total`` tokens, at most ``repeats`` rounds through its blocks.

    Without ``total`` the mix is the largest in which no source is short of its share. A
    source without tokens, share or repeats has no slots and does not limit the others.
    """
    blocks = [math.ceil(t / block) for t in tokens]
    limits = [b * max(r, 0) for b, r in zip(blocks, repeats, strict=True)]
    live = [i for i, (s, n) in enumerate(zip(shares, limits, strict=True)) if s > 0 and n > 0]
    if not live:
        return Plan(tuple(sources), (0,) * len(sources), tuple(blocks), shard_slots, seed)
    wanted = min(limits[i] / shares[i] for i in live) if total is None else total / block
    exact = {i: shares[i] * wanted for i in live}
    slots = {i: math.floor(x + 1e-9) for i, x in exact.items()}
    short = round(sum(exact.values())) - sum(slots.values())
    for i in sorted(live, key=lambda i: (slots[i] - exact[i], i))[: max(0, short)]:
        slots[i] += 1
    return Plan(tuple(sources), tuple(min(slots.get(i, 0), limits[i]) for i in range(len(sources))), tuple(blocks), shard_slots, seed)


@functools.lru_cache(maxsize=4096)
def _node(p: Plan, low: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, starts) per source of the shards low..low+size-1, a node of the binary tree."""
    if size >= p.shards:
        return np.array(p.slots, np.int64), np.zeros(len(p.slots), np.int64)
    parent = low - low % (2 * size)
    counts, starts = _node(p, parent, 2 * size)
    left = _left(p, parent, size)
    return (left, starts) if low == parent else (counts - left, starts + left)


def drawn(rng: np.random.Generator, counts: np.ndarray, take: int) -> np.ndarray:
    """How many of ``take`` slots, drawn without replacement from ``counts`` slots of each source, each source gets.

    A chain of hypergeometric draws. Of MOST_DRAWN slots and more a link of the chain is drawn
    from the limit of that distribution, with its mean and its variance: binomial for a small
    source, whose slots hardly compete, else normal, rounded and kept within what is possible.
    """
    out = np.zeros(len(counts), np.int64)
    total, left = int(counts.sum()), int(take)
    for i, own in enumerate(counts.tolist()):
        rest = total - own
        if total < MOST_DRAWN:
            x = int(rng.hypergeometric(own, rest, left)) if own and left else 0
        else:
            few, part = min(own, rest), left / total
            if few <= FEW_DRAWN:
                x = int(rng.binomial(few, part))
            else:
                x = round(few * part + rng.standard_normal() * math.sqrt(few * part * (1 - part) * (1 - few / total) * total / (total - 1)))
            x = x if own == few else left - x
            x = min(max(x, left - rest, 0), own, left)
        out[i] = x
        total, left = rest, left - x
    return out


@functools.lru_cache(maxsize=4096)
def _left(p: Plan, low: int, size: int) -> np.ndarray:
    """How many slots of each source fall into the left half, of ``size`` shards, of a node: one seeded draw."""
    counts, _ = _node(p, low, 2 * size)
    take = min(size * p.shard_slots, int(counts.sum()))
    return drawn(np.random.default_rng([p.seed, low, size]), counts, take)


def permuted(index: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at ``index``; one permutation for each key.

    A Feistel network over the next power of four; values beyond n go through it again.
    """
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    left = np.ones(len(out), bool)
    while left.any():
        x, k = out[left], keys[left]
        a, b = x >> np.uint64(half), x & mask
        for turn in range(4):
            a, b = b, a ^ (mixed(b ^ mixed(k + np.uint64(turn + 1))) & mask)
        out[left] = (a << np.uint64(half)) | b
        left[left] = out[left] >= n
    return out.astype(np.int64)


def _slots(batches: Iterator[pa.RecordBatch], p: Plan) -> Iterator[pa.RecordBatch]:
    """Every slot of the given shards: which block of which source stands in it, in which round."""
    for batch in batches:
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        for shard in batch.column("id").to_pylist():
            counts, starts = _node(p, shard, 1)
            source = np.repeat(np.arange(len(counts)), counts)
            j = np.arange(len(source)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
            n = np.array(p.blocks, np.int64)[source]
            turn = j // np.maximum(n, 1)
            block = np.zeros(len(j), np.int64)
            for s in np.flatnonzero(counts):
                own = source == s
                keys = mixed(np.uint64(p.seed) + mixed(np.uint64(s + 1) + (turn[own].astype(np.uint64) << np.uint64(20))))
                block[own] = permuted(j[own] % n[own], int(p.blocks[s]), keys)
            order = np.random.default_rng([p.seed, shard]).permutation(len(j))
            for column, values in zip(out, (np.full(len(j), shard), np.arange(len(j)), source[order], turn[order], block[order]), strict=True):
                column.append(values)
        s, slot, source, turn, block = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)
        names = pa.array(np.array(p.sources, object)[source].tolist() if len(source) else [], pa.string())
        columns = [pa.array(s, pa.int64()), pa.array(slot, pa.int64()), names, pa.array(turn, pa.int64()), pa.array(block, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["shard", "slot", "source", "turn", "block"])


class Mix:
    """A mix of ``docs`` by ``targets`` (source, target_share, max_repeat).

    Sources without a target are not used. Null or empty texts and null sources hold no
    tokens. Rows that repeat an id are documents of their own. Shares are scaled to a sum of
    1; of several targets for one source the first by share and repeats counts; null shares
    and repeats are 0. No block, so no token of a document, is used more than max_repeat times.
    """

    def __init__(
        self, docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", block: int = 256,
        shard_slots: int = 64, seed: int = 7, total: int | None = None, vocabulary: str = VOCABULARY, pattern: str = PATTERN, end: int | None = END_OF_TEXT, counts_only: bool = False,
    ) -> None:
        """``counts_only``: tokens are counted and not kept, for ``shares`` and ``slots``."""
        goals = targets.filter(F.col("source").isNotNull()).groupBy("source").agg(
            F.max(F.struct(F.coalesce("target_share", F.lit(0.0)).cast("double").alias("share"), F.coalesce("max_repeat", F.lit(0)).cast("long").alias("repeat"))).alias("g")
        )
        self.goals = sorted((r.source, r.share, r.repeat) for r in goals.select("source", "g.share", "g.repeat").limit(MOST_SOURCES + 1).collect())
        if len(self.goals) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources have targets")
        self.spark, self.block = docs.sparkSession, block
        names = [g[0] for g in self.goals]
        used = docs.filter(F.col(source).isin(names)) if names else docs.filter("1 = 0")
        tokens = tokenized(used, doc_id, source, text, vocabulary, pattern, end)
        self.tokens = tokens if counts_only else cut_lineage(tokens)
        self.stats = {r.source: (r.tokens, r.docs) for r in self.tokens.groupBy("source").agg(F.sum("n").alias("tokens"), F.count("*").alias("docs")).collect()}
        whole = sum(g[1] for g in self.goals) or 1.0
        available = [self.stats.get(n, (0, 0))[0] for n in names]
        self.plan = plan(names, [g[1] / whole for g in self.goals], [g[2] for g in self.goals], available, block, shard_slots, seed, total)

    def slots(self) -> DataFrame:
        p = self.plan
        shards = self.spark.range(p.shards)
        return shards.mapInArrow(lambda b: _slots(b, p), "shard long, slot long, source string, turn long, block long")

    def blocks(self) -> DataFrame:
        return packed(self.tokens, self.block, max((d for _, d in self.stats.values()), default=0))

    def mixed(self) -> DataFrame:
        """(shard, slot, source, turn, block, size, tokens): the mix, one row per slot."""
        return self.slots().join(self.blocks(), ["source", "block"]).select("shard", "slot", "source", "turn", "block", "size", "tokens")

    def shares(self) -> DataFrame:
        """Per target source: tokens there are and tokens used, target and real share, most uses of a block.

        Only the last block of a source is short, so sizes follow from the counts without reading a token.
        """
        used = self.slots().groupBy("source", "block").agg(F.count("*").alias("uses"))
        whole = sum(g[1] for g in self.goals) or 1.0
        rows = [(n, s / whole, int(r), int(self.stats.get(n, (0, 0))[0]), int(b)) for (n, s, r), b in zip(self.goals, self.plan.blocks, strict=True)]
        goals = self.spark.createDataFrame(rows, "source string, target_share double, max_repeat long, tokens_available long, n_blocks long")
        size = F.when(F.col("block") == F.col("n_blocks") - 1, F.col("tokens_available") - F.col("block") * self.block).otherwise(F.lit(self.block))
        summed = used.join(goals, "source").groupBy("source").agg(F.sum(F.col("uses") * size).alias("tokens_used"), F.max("uses").alias("most_uses"))
        out = goals.join(summed, "source", "left").withColumn("tokens_used", F.coalesce("tokens_used", F.lit(0)))
        total = out.agg(F.sum("tokens_used").alias("total")).scalar()
        return out.select(
            "source", "target_share", "max_repeat", "tokens_available", "tokens_used",
            F.when(total > 0, F.col("tokens_used") / total).otherwise(F.lit(0.0)).alias("actual_share"),
            F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
        )
