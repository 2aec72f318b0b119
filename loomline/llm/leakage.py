"""Problem 8: evaluation texts that stand, wholly or partly, in training documents.

A passage leaks if ``min_words`` consecutive words of an item stand in a document. Documents
are cut into windows of exactly the passage's size: within that size partition the shingle
sets of an item window and of a document window are equal in size, so full containment is
Jaccard 1 and one min-hash finds it surely. Neighbouring windows mostly share their min-hash,
so a document of n words keeps about 2n / (min_words - shingle + 2) of them. A Bloom filter
of the items' min-hashes (of bounded size) drops nearly all of these before any shuffle; the
rest are joined, and every candidate is verified by exact containment of word shingles; the
longest run that is reported is compared word by word.

Words are runs of letters and digits in lower case.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.references import might_contain
from ..sources.tables import cut_lineage
from .codepoints import row_of, to_code_points
from .hashing import BASE, TOP, gram_hashes, mixed, passes, powers, sliding_min

SHINGLE, MIN_WORDS = 5, 12
SIZE = 0x110000


@functools.cache
def _lower() -> np.ndarray:
    """For each code point its lower case if it is a letter or digit, else 0."""
    out = np.zeros(SIZE, np.uint32)
    for cp in (*range(0xD800), *range(0xE000, 0x32000)):
        c = chr(cp)
        if c.isalnum():
            low = c.lower()
            out[cp] = ord(low[0])
    return out


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of the batch, and for each the row it is in."""
    points, borders = to_code_points(texts)
    rows = row_of(borders)
    letters = _lower()[points]
    inside = letters > 0
    start = inside.copy()
    start[1:] &= ~inside[:-1] | (rows[1:] != rows[:-1])
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(inside)
    word = np.cumsum(start)[at] - 1
    place = at - starts[word]
    values = mixed(letters[at]) * powers(int(place.max()) + 1, BASE)[place]
    first = np.searchsorted(word, np.arange(len(starts)))
    return mixed(np.add.reduceat(values, first)), rows[starts]


def window_minima(texts: pa.Array, min_words: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, min-hash) of every window of ``min_words`` words; equal neighbours once."""
    hashes, rows = words(texts)
    shingles = gram_hashes(hashes, shingle)
    width = min_words - shingle + 1
    if len(shingles) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = sliding_min(shingles, width)
    row = rows[: len(low)]
    whole = rows[min_words - 1 :] == row
    low, row = low[whole], row[whole]
    fresh = np.ones(len(low), bool)
    fresh[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1])
    return row[fresh], low[fresh]


def _sketched(batches: Iterator[pa.RecordBatch], min_words: int, shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in passes(batch, "text"):
            row, low = window_minima(part.column("text"), min_words, shingle)
            offsets = np.searchsorted(row, np.arange(part.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(low.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("id"), lists], names=["id", "sketch"])


def sketches(df: DataFrame, key: str, text: str, min_words: int, shingle: int) -> DataFrame:
    """(id, low): the distinct window min-hashes of every text; texts of fewer words have none."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).filter(F.length("text") >= min_words)
    lists = rows.mapInArrow(lambda b: _sketched(b, min_words, shingle), "id long, sketch array<long>")
    return lists.select("id", F.explode("sketch").alias("low"))


def _runs(doc: pa.Array, item: pa.Array, min_words: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the longest run of item words in the document, and the share of item shingles in it.

    All rows at once: shingles and windows of both sides are tagged with their row and matched by sorting.
    """
    n = len(doc)
    longest, share = np.zeros(n, np.int64), np.zeros(n)
    (dh, dr), (ih, ir) = words(doc), words(item)

    def grams(h: np.ndarray, r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        g = gram_hashes(h, k)
        whole = r[k - 1 :] == r[: len(g)]
        return g[whole], r[: len(g)][whole]

    dg, dgr = grams(dh, dr, shingle)
    ig, igr = grams(ih, ir, shingle)
    tag = lambda g, r: mixed(g ^ mixed(r.astype(np.uint64) + np.uint64(1)))
    held = np.isin(tag(ig, igr), tag(dg, dgr))
    total = np.bincount(igr, minlength=n)
    share = np.bincount(igr[held], minlength=n) / np.maximum(total, 1)
    k, left = min_words, np.ones(n, bool)
    while left.any():  # a run of k words: one more round for each further word that some row still matches
        keep_d, keep_i = left[dr], left[ir]
        dh, dr, ih, ir = dh[keep_d], dr[keep_d], ih[keep_i], ir[keep_i]
        dg, dgr = grams(dh, dr, k)
        ig, igr = grams(ih, ir, k)
        hit = igr[np.isin(tag(ig, igr), tag(dg, dgr))]
        left = np.zeros(n, bool)
        left[hit] = True
        longest[left] = k
        k += 1
    return longest, share


def same_words(doc: str, item: str, run: int) -> bool:
    """Whether ``run`` consecutive words of the item stand in the document, word by word and not by hash."""
    doc_words, item_words = ("".join(c.lower()[0] if c.isalnum() else " " for c in t).split() for t in (doc, item))
    text = f" {' '.join(doc_words)} "
    return any(f" {' '.join(item_words[i : i + run])} " in text for i in range(len(item_words) - run + 1))


def _verified(batches: Iterator[pa.RecordBatch], min_words: int, shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in passes(batch, "text"):
            longest, share = _runs(part.column("text"), part.column("item_text"), min_words, shingle)
            for i in np.flatnonzero(longest >= min_words).tolist():  # few rows are left: the words themselves are compared once
                while longest[i] >= min_words and not same_words(part.column("text")[i].as_py(), part.column("item_text")[i].as_py(), int(longest[i])):
                    longest[i] -= 1
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("item_id"), pa.array(longest), pa.array(share)], names=["doc_id", "item_id", "longest_run", "containment"]
            ).filter(pa.array(longest >= min_words))


def leaks(docs: DataFrame, doc_id: str, items: DataFrame, item_id: str, text: str = "text", min_words: int = MIN_WORDS, shingle: int = SHINGLE) -> DataFrame:
    """Which documents hold ``min_words`` or more consecutive words of which items.

    Result: doc_id, item_id, longest_run (words) and containment (share of the item's
    shingles of ``shingle`` words that stand in the document). Null and short texts on either
    side give nothing; equal items and equal documents each give their own rows; rows that
    repeat an id are one. Ids are whole numbers. Only the columns named are read.
    """
    low_items = cut_lineage(sketches(items, item_id, text, min_words, shingle).select(F.col("id").alias("item_id"), "low").distinct())
    low_docs = sketches(docs, doc_id, text, min_words, shingle).select(F.col("id").alias("doc_id"), "low")
    near = low_docs.filter(might_contain(low_items, "low", F.col("low"), low_items.count()))
    candidates = cut_lineage(near.join(low_items, "low").select("doc_id", "item_id").distinct())
    doc_texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    doc_texts = doc_texts.filter(might_contain(candidates, "doc_id", F.col("doc_id"), candidates.count()))
    item_texts = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("item_text"))
    pairs = candidates.join(item_texts, "item_id").join(doc_texts, "doc_id").select("doc_id", "item_id", "text", "item_text")
    found = pairs.mapInArrow(lambda b: _verified(b, min_words, shingle), "doc_id long, item_id long, longest_run long, containment double")
    return found.groupBy("doc_id", "item_id").agg(F.max("longest_run").alias("longest_run"), F.max("containment").alias("containment"))
