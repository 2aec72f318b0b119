"""Problem 10: spans of at least a given length that stand verbatim in more than one text.

1. Texts are hashed; equal texts form a class and only one of them is looked at further.
2. Every window of ``min_chars`` characters holds an anchor: the smallest hash of its runs of
   ``min_chars // 2`` characters. Texts that share a span share an anchor. One count per
   anchor finds the few that stand in two different texts.
3. An anchor in few texts gives its pairs. An anchor in many (a common footer) is refined to
   the hashes of all windows around it, so only texts that share a whole window are paired;
   nothing is capped. Where no pairs are asked for, the counts of these windows tell what
   stands elsewhere, and a footer in n texts costs n, not n * n.
4. Pairs are grouped by reference text into shards. A shard builds a suffix automaton over
   the parts of the reference around its anchors and streams the partners through it for
   matching statistics; the maximal spans are the result. A long reference is cut into pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.ordering import position_in_group
from ..operators.references import might_contain
from ..sources.tables import cut_lineage
from .automaton import SuffixAutomaton
from .codepoints import row_of, to_code_points
from .hashing import gram_hashes, passes, sliding_max, sliding_min

MIN_CHARS = 240
#: Occurrences up to which an anchor's texts are paired directly; beyond, it is refined.
FEW = 48
#: Partners that one automaton serves before the shard is split.
SHARD = 64
#: Characters of a reference whose anchors one automaton holds (about 0.4 kB for each).
PIECE = 250_000
#: Copies of one text that one task links to the texts of others.
COPIES = 10_000


def _anchors_of(texts: pa.Array, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, hash) of the anchors: the runs that are smallest in some whole window."""
    k = min_chars // 2
    width = min_chars - k + 1
    points, borders = to_code_points(texts)
    rows = row_of(borders)
    if len(points) < min_chars:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = gram_hashes(points, k)
    low = sliding_min(hashes, width)
    low = np.where(rows[: len(low)] == rows[min_chars - 1 :], low, 0)
    high = sliding_max(np.concatenate((np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64))), width)
    at = np.flatnonzero((high[: len(hashes)] == hashes) & (hashes > 0))
    return rows[at], at - borders[rows[at]], hashes[at]


def _with_anchors(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in passes(batch, "text"):
            row, start, hashes = _anchors_of(part.column("text"), min_chars)
            offsets = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32())
            kind = pa.struct([("anchor", pa.int64()), ("start", pa.int32())])
            items = pa.StructArray.from_arrays([pa.array(hashes.view(np.int64)), pa.array(start.astype(np.int32))], fields=list(kind))
            yield pa.RecordBatch.from_arrays([part.column("cls"), pa.ListArray.from_arrays(offsets, items)], names=["cls", "found"])


def _windows(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    """All windows (hash, start) of ``min_chars`` characters that hold one of the given starts."""
    k = min_chars // 2
    kind = pa.struct([("gram", pa.int64()), ("at", pa.int32())])
    for batch in batches:
        for part in passes(batch, "text"):
            points, borders = to_code_points(part.column("text"))
            grams = gram_hashes(points, min_chars)
            lists = part.column("starts")
            starts = np.asarray(lists.flatten(), np.int64)
            row = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(lists.offsets)))
            first = np.maximum(starts - (min_chars - k), 0) + borders[row]
            last = np.minimum(starts + borders[row], borders[row + 1] - min_chars)
            count = np.maximum(last - first + 1, 0)
            at = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at, once = np.unique(at, return_index=True)
            row = np.repeat(row, count)[once]
            offsets = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32())
            items = pa.StructArray.from_arrays([pa.array(grams[at].view(np.int64)), pa.array((at - borders[row]).astype(np.int32))], fields=list(kind))
            yield pa.RecordBatch.from_arrays([part.column("cls"), part.column("first"), pa.ListArray.from_arrays(offsets, items)], names=["cls", "first", "windows"])


def _parts(starts: np.ndarray, size: int, min_chars: int) -> list[tuple[int, int]]:
    """The parts of a text of ``size`` characters in which a shared span can lie, merged.

    A span ends less than min_chars - k + 1 characters beyond its outermost anchors.
    """
    k = min_chars // 2
    reach = min_chars - k + 1
    out: list[tuple[int, int]] = []
    for s in np.sort(starts).tolist():
        low, high = max(0, s - reach), min(size, s + k + reach)
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _streamed(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    """Spans of partners in the reference that comes before them in the sorted shard."""
    automaton, parts, ref = None, [], None
    for batch in batches:
        out: dict[str, list] = {"ref": [], "doc": [], "start": [], "size": [], "ref_start": []}
        for row_ref, kind, doc, text, starts in zip(*(batch.column(c).to_pylist() for c in ("ref", "kind", "doc", "text", "starts")), strict=True):
            own = _parts(np.asarray(starts), len(text), min_chars)
            if kind == 0:
                ref, parts = row_ref, own
                automaton = SuffixAutomaton([text[a:b] for a, b in parts])
                continue
            assert row_ref == ref, "a partner came without its reference"
            for low, high in own:
                for start, size, end in automaton.maximal_spans(text[low:high], min_chars):
                    place = end - size
                    before = max(i for i, (first, _) in enumerate(automaton.place) if first <= place)
                    for name, value in (("ref", ref), ("doc", doc), ("start", low + start), ("size", size), ("ref_start", parts[before][0] + place - automaton.place[before][0])):
                        out[name].append(value)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(n, pa.int64()) for n in out]))


def _members_paired(groups: DataFrame, members: str) -> DataFrame:
    """Pairs (a, b), a < b, of the members of each group; groups are of bounded size."""
    listed = groups.select(F.array_sort(F.array_distinct(members)).alias("m"))
    pairs = F.flatten(
        F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.greatest(F.size("m") - i - 1, F.lit(0))), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    )
    return listed.select(F.explode(pairs).alias("p")).select("p.a", "p.b")


class SharedSpans:
    """The steps of one run over ``docs``; each table is made once.

    Null texts and texts under ``min_chars`` characters share nothing. Ids are whole numbers;
    rows with equal id count as copies of each other only if their texts are equal. Only the
    columns named are read.
    """

    def __init__(self, docs: DataFrame, doc_id: str, text: str = "text", min_chars: int = MIN_CHARS) -> None:
        self.min_chars = min_chars
        all_docs = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
        self.docs = all_docs.filter(F.length("text") >= min_chars).withColumn("cls", F.unhex(F.md5("text")))
        self.ids = all_docs.select("doc", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
        self._classes()
        self._candidates()

    def _within(self, df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
        """Rows of ``df`` whose ``key`` is in ``keys``; a Bloom filter keeps others out of the shuffle."""
        return df.filter(might_contain(keys, key, F.col(key), keys.count())).join(keys, key)

    def _classes(self) -> None:
        """copies: (cls, first, n_copies, doc) of every text that more than one id has."""
        sizes = self.docs.select("doc", "cls").distinct().groupBy("cls").agg(F.min("doc").alias("first"), F.count("*").alias("n_copies"))
        repeated = cut_lineage(sizes.filter(F.col("n_copies") > 1))
        self.copies = cut_lineage(self._within(self.docs.select("cls", "doc"), repeated, "cls").distinct())

    def _anchored(self) -> DataFrame:
        least = self.min_chars
        lists = self.docs.select("cls", "text").mapInArrow(
            lambda b: _with_anchors(b, least), "cls binary, found array<struct<anchor:long,start:int>>"
        )
        return lists.select("cls", F.explode("found").alias("f")).select("cls", "f.anchor", "f.start")

    def _candidates(self) -> None:
        """starts: (cls, starts) around which text is looked at; pairs: (a, b) of classes, a < b,
        with an anchor that few texts have; many: (cls, starts) of the other anchors."""
        text_of = F.xxhash64("cls")
        anchors = cut_lineage(self._anchored())  # about half a byte a character: less than hashing all texts again
        shared = cut_lineage(
            anchors.groupBy("anchor")
            .agg(F.min(text_of).alias("low"), F.max(text_of).alias("high"), F.count("*").alias("n"))
            .filter(F.col("low") != F.col("high"))
            .select("anchor", "n")
        )
        # copies of a text have equal rows here: they become one before the shuffle
        near = anchors.filter(might_contain(shared, "anchor", F.col("anchor"), shared.count())).distinct()
        places = cut_lineage(near.join(shared, "anchor"))
        self.starts = places.groupBy("cls").agg(F.collect_set("start").alias("starts"))
        few = places.filter(F.col("n") <= FEW).groupBy("anchor").agg(F.collect_set("cls").alias("m"))
        self.pairs = cut_lineage(_members_paired(few, "m").distinct())
        self.many = cut_lineage(places.filter(F.col("n") > FEW).groupBy("cls").agg(F.collect_set("start").alias("starts")))

    def _texts(self, classes: DataFrame) -> DataFrame:
        """(cls, first, text) with one text for each class."""
        first = cut_lineage(self._within(self.docs.select("cls", "doc"), classes.select("cls").distinct(), "cls").groupBy("cls").agg(F.min("doc").alias("first")))
        held = self.docs.select("cls", "doc", "text").filter(might_contain(first, "first", F.col("doc"), first.count()))
        joined = held.join(first.withColumnRenamed("first", "doc"), ["cls", "doc"])
        return joined.groupBy("cls", "doc").agg(F.min("text").alias("text")).withColumnRenamed("doc", "first")

    def _common_windows(self) -> DataFrame:
        """(cls, first, gram, at) of the windows around anchors that stand in many texts."""
        least = self.min_chars
        rows = self.many.join(self._texts(self.many).select("cls", "first", "text"), "cls")
        lists = rows.mapInArrow(lambda b: _windows(b, least), "cls binary, first long, windows array<struct<gram:long,at:int>>")
        return cut_lineage(lists.select("cls", "first", F.explode("windows").alias("w")).select("cls", "first", "w.gram", "w.at"))

    def _refined(self) -> DataFrame:
        """Pairs of classes that share a whole window around an anchor that stands in many texts.

        Groups of windows with the same texts are one group. A group's pairs are all results;
        they are made by joining blocks of members, never in one task.
        """
        places = self._common_windows().select("cls", "gram").distinct()
        mark = F.xxhash64("cls").cast("decimal(38,0)")
        mark2 = F.xxhash64("cls", F.lit(1)).cast("decimal(38,0)")
        groups = places.groupBy("gram").agg(F.count("*").alias("n"), F.sum(mark).alias("s1"), F.sum(mark2).alias("s2")).filter(F.col("n") > 1)
        kept = cut_lineage(groups.groupBy("n", "s1", "s2").agg(F.min("gram").alias("gram")).select("gram", "n"))
        members = self._within(places, kept, "gram")
        block = F.greatest(F.ceil(F.col("n") / SHARD), F.lit(1)).cast("int")
        left = members.withColumn("block", F.pmod(F.xxhash64("cls"), block).cast("int"))
        right = left.select("gram", F.col("cls").alias("other"), F.col("block").alias("other_block"), F.explode(F.sequence(F.lit(0), block - 1)).alias("block"))
        return left.select("gram", "block", "cls").join(right, ["gram", "block"]).filter(F.col("cls") < F.col("other")).select(
            F.col("cls").alias("a"), F.col("other").alias("b")
        )

    def _every_pair(self) -> DataFrame:
        return self.pairs if self.many.isEmpty() else cut_lineage(self.pairs.unionByName(self._refined()).distinct())

    def spans(self, candidates: DataFrame, both: bool = False) -> DataFrame:
        """(ref, doc, start, size, ref_start): maximal spans of ``doc`` that stand in ``ref``, of the ``candidates`` (a, b).

        ``ref`` and ``doc`` are the first ids of their classes, ref < doc; with ``both`` each
        pair comes in both directions. In a reference of more than PIECE characters a span is
        maximal within a piece: pieces overlap, so no window of a span is missed.
        """
        least = self.min_chars
        either = candidates.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        texts = cut_lineage(self._texts(either).join(self.starts, "cls"))
        name = texts.select("cls", "first")
        pairs = candidates.join(name.select(F.col("cls").alias("a"), F.col("first").alias("x")), "a").join(
            name.select(F.col("cls").alias("b"), F.col("first").alias("y")), "b"
        )
        if both:
            ends = pairs.select("x", "y").unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
            ends = ends.select(F.col("x").alias("ref"), F.col("y").alias("doc"))
        else:
            ends = pairs.select(F.least("x", "y").alias("ref"), F.greatest("x", "y").alias("doc"))
        shards = ends.groupBy("ref").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
        content = texts.select(F.col("first").alias("doc"), "text", "starts")
        piece_of = lambda x: F.floor(x / PIECE).cast("int")
        pieces = shards.join(texts.select(F.col("first").alias("ref"), F.array_distinct(F.transform("starts", piece_of)).alias("pieces")), "ref").select("ref", "shards", F.explode("pieces").alias("piece"))
        ends = ends.join(pieces, "ref").withColumn("shard", F.pmod(F.xxhash64("doc"), F.col("shards")).cast("int"))
        partners = ends.select("ref", "shard", "piece", F.lit(1).alias("kind"), "doc").join(content, "doc")
        heads = ends.select("ref", "shard", "piece").distinct().join(content.withColumnRenamed("doc", "ref"), "ref")
        heads = heads.withColumn("starts", F.filter("starts", lambda x: piece_of(x) == F.col("piece")))
        rows = partners.unionByName(heads.select("ref", "shard", "piece", F.lit(0).alias("kind"), F.col("ref").alias("doc"), "text", "starts"))
        sorted_rows = rows.repartition("ref", "shard", "piece").sortWithinPartitions("ref", "shard", "piece", "kind")
        return sorted_rows.mapInArrow(lambda b: _streamed(b, least), "ref long, doc long, start long, size long, ref_start long")

    def _links(self) -> DataFrame:
        """(ref, doc), ref < doc, of the first ids of two classes that share a span."""
        return self.spans(self._every_pair()).select("ref", "doc").distinct()

    def _with_copies(self, links: DataFrame, end: str, copies: DataFrame) -> DataFrame:
        """``links`` with each copy of the text at ``end`` in its place, and ``place``, which is 1 for the first; spread over parts of COPIES."""
        named = copies.select(F.col("first").alias(end), F.col("doc").alias("copy"), "place", F.floor((F.col("place") - 1) / COPIES).cast("int").alias("part"))
        parts = named.groupBy(end).agg((F.max("part") + 1).alias("parts"))
        spread = links.join(parts, end, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        joined = spread.join(named, [end, "part"], "left").drop("part", "parts")
        return joined.withColumns({end: F.coalesce("copy", end), "place": F.coalesce("place", F.lit(1))}).drop("copy")

    def found_pairs(self) -> DataFrame:
        """(doc_a, doc_b), doc_a < doc_b, of ids whose texts share a span.

        Copies are not expanded into all pairs, whatever their number: each is paired with
        its text's first copy and with the next one by id. With every other text that shares
        a span each copy is paired: with that text's first copy, and with its copy of the
        same place; so every copy keeps its link to every different text.
        """
        copies = cut_lineage(position_in_group(self.copies, ["cls"], "doc"))
        links = cut_lineage(self._links())
        pair = lambda a, b: (F.least(a, b).alias("doc_a"), F.greatest(a, b).alias("doc_b"))
        left, right = self._with_copies(links, "ref", copies), self._with_copies(links, "doc", copies)
        alike = self._with_copies(left.filter("place > 1").withColumnRenamed("place", "own"), "doc", copies).filter("place = own")
        across = [df.select(*pair("ref", "doc")) for df in (left, right, alike)]
        later = copies.filter("place > 1").select("cls", "doc", (F.col("place") - 1).alias("place"))
        neighbours = later.join(copies.select("cls", F.col("doc").alias("ahead"), "place"), ["cls", "place"]).select(*pair("ahead", "doc"))
        first = copies.filter("place > 1").select(*pair("first", "doc"))
        return across[0].unionByName(across[1]).unionByName(across[2]).unionByName(first).unionByName(neighbours).distinct()

    def _named(self) -> DataFrame:
        """(doc, n_chars, class_id, copied) of every id; ``class_id`` is the first id with the same text."""
        named = self.ids.distinct().join(self.copies.select("doc", "first"), "doc", "left")
        return named.select("doc", "n_chars", F.coalesce("first", "doc").alias("class_id"), F.col("first").isNotNull().alias("copied"))

    def linked(self) -> DataFrame:
        """One row per id: (doc_id, class_id, n_links), the number of other texts that share a span with its text."""
        links = self._links()
        ends = links.select(F.explode(F.array("ref", "doc")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
        return self._named().join(ends, "class_id", "left").select(F.col("doc").alias("doc_id"), "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))

    def elsewhere(self, earlier: bool = False) -> DataFrame:
        """(doc, start, stop): the parts of every class's text that lie in a span of another class's
        text, or with ``earlier`` of one with a smaller first id; parts do not touch.

        Spans around rare anchors come from the automata, those around common ones from the
        counts of their windows.
        """
        least = self.min_chars
        found = self.spans(self.pairs, both=not earlier).select("doc", "start", (F.col("start") + F.col("size")).alias("stop"))
        if not self.many.isEmpty():
            windows = self._common_windows()
            shared = cut_lineage(windows.groupBy("gram").agg(F.min("first").alias("low"), F.max("first").alias("high")).filter("low < high").select("gram", "low"))
            common = self._within(windows, shared, "gram").filter(F.col("first") > F.col("low") if earlier else F.lit(True))
            at = F.col("at").cast("long")
            found = found.unionByName(common.select(F.col("first").alias("doc"), at.alias("start"), (at + least).alias("stop")))
        ends = found.groupBy("doc", "start").agg(F.max("stop").alias("stop"))
        order = W.partitionBy("doc").orderBy("start")
        before = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
        fresh = ends.withColumn("fresh", (before.isNull() | (F.col("start") > before)).cast("int"))
        numbered = fresh.withColumn("part", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
        return numbered.groupBy("doc", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("part")

    def coverage(self) -> DataFrame:
        """One row per id: (doc_id, class_id, n_chars, shared_chars, share).

        ``shared_chars`` counts characters that lie in a span that stands in another id's
        text. A copied text is shared wholly.
        """
        covered = self.elsewhere().groupBy(F.col("doc").alias("class_id")).agg(F.sum(F.col("stop") - F.col("start")).alias("covered"))
        rows = self._named().join(covered, "class_id", "left")
        shared = F.when(F.col("copied"), F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0)))
        return rows.select(
            F.col("doc").alias("doc_id"), "class_id", "n_chars", shared.cast("long").alias("shared_chars"),
            F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(F.lit(0.0)).alias("share"),
        )

    def stripped(self) -> DataFrame:
        """(doc_id, kept): every text without the spans that an earlier id has too.

        A text that is a copy of an earlier id's text is left with ''; texts with nothing
        shared are not listed.
        """
        cuts = cut_lineage(self.elsewhere(earlier=True).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("cuts")))
        texts = self._within(self.docs.select("doc", "text"), cuts.select("doc"), "doc").join(cuts, "doc")
        start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("kept"))
        merged = F.aggregate(
            "cuts",
            start,
            lambda acc, c: F.struct(
                F.greatest(acc["at"], c["stop"]).alias("at"),
                F.concat(acc["kept"], F.substring("text", (acc["at"] + 1).cast("int"), F.greatest(c["start"] - acc["at"], F.lit(0)).cast("int"))).alias("kept"),
            ),
        )
        rest = texts.select("doc", "text", merged.alias("m")).select(F.col("doc").alias("doc_id"), F.concat("m.kept", F.expr("substring(text, cast(m.at + 1 as int))")).alias("kept"))
        copied = self.copies.filter(F.col("first") != F.col("doc")).select(F.col("doc").alias("doc_id"), F.lit("").alias("kept"))
        return rest.join(copied.select("doc_id"), "doc_id", "left_anti").unionByName(copied)
