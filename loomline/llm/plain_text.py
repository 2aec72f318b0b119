"""Problem 1: text that reads the same is brought to the same characters.

A batch of Arrow strings becomes one numpy array of code points. Every step below is a
gather in a table indexed by code point or arithmetic on positions; nothing runs per row.

1. blanks other than U+0020 become U+0020,
2. invisible characters go, apart from joiners and selectors that emoji, joining scripts
   and ideographs need,
3. wide, narrow, joined and font variants and composed letters are expanded,
4. marks are put in canonical order,
5. letters of another script within a word become the look-alike of the word's script,
6. letters and marks are composed again.

Nulls stay null, empty text stays empty. The result is in normalization form C.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codepoints import borders_of, from_code_points, row_of, to_code_points

SIZE = 0x110000
#: Scripts with look-alikes. Further scripts are numbered behind them in order of code points.
LATIN, CYRILLIC, GREEK, ARMENIAN, CHEROKEE, COPTIC, LISU = range(1, 8)
TABLED = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE", "COPTIC", "LISU")
#: First words of the names of letters that are of no script by themselves, or of scripts that are
#: written side by side within words (East Asian ones); and the least letters that make a script.
NO_SCRIPT = frozenset("CJK HIRAGANA KATAKANA KATAKANA-HIRAGANA HALFWIDTH FULLWIDTH HANGUL BOPOMOFO IDEOGRAPHIC MODIFIER MATHEMATICAL DOUBLE-STRUCK SCRIPT BLACK-LETTER CIRCLED SQUARED".split())
LEAST_LETTERS = 16
#: Letters beyond this code point have no look-alikes.
LOOKS = 0x10000

#: Letters of other scripts beside the Latin letters that look like them.
CYRILLIC_AS_LATIN = (
    "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ҮY ԚQ ԜW ӀI аa еe ѕs іi јj кk оo рp сc уy хx үy һh ԁd ԛq ԝw ӏl"
)
ARMENIAN_AS_LATIN = "ՏS ՍU ՕO ԼL օo սu ոn հh ցg զq աw յj"
CHEROKEE_AS_LATIN = "ᎠD ᎡR ᎢT Ꭵi ᎪA ᎫJ ᎬE ᎳW ᎷM ᎻH ᎽY ᏀG Ꮒh ᏃZ ᏌU Ꮟb ᏒR ᏔW ᏕS ᏙV ᏚS ᏞL ᏟC ᏢP ᏦK Ꮷd ᏳG ᏴB"
COPTIC_AS_LATIN = "ⲂB ⲎH ⲒI ⲔK ⲘM ⲚN ⲞO ⲢP ⲤC ⲦT ⲨY ⲬX ⲟo ⲣp ⲥc ⲓi"
LISU_AS_LATIN = "ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU"
GREEK_AS_LATIN = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ϳj αa γy ιi κk νv οo ρp υu χx ϲc"
#: Kinds of compatibility form that show the same letters.
SAME_LETTERS = {"<wide>", "<narrow>", "<font>", "<compat>", "<isolated>", "<initial>", "<medial>", "<final>", "<square>"}
#: Blocks whose letters need joiners, and the emoji blocks.
JOINING = ((0x0600, 0x0900), (0x0900, 0x0E00), (0x0F00, 0x1100), (0x1780, 0x1800), (0x1800, 0x18B0))
EMOJI = ((0x203C, 0x2050), (0x2122, 0x2123), (0x2139, 0x213A), (0x2190, 0x2200), (0x2300, 0x2400), (0x2460, 0x2500), (0x25A0, 0x2C00), (0x3030, 0x3031), (0x303D, 0x303E), (0x3297, 0x329A), (0x1F000, 0x1FB00))
#: Letters that are written so in their scripts, though they have a compatibility decomposition (Armenian, Thai, Lao).
KEPT_FORMS = "\u0587\u0e33\u0eb3\u0edc\u0edd"
ZWNJ, ZWJ, VS15, VS16, KEYCAP = 0x200C, 0x200D, 0xFE0E, 0xFE0F, 0x20E3


class Tables:
    """Arrays indexed by code point, made by rule from the Unicode database that Python holds.

    Letters listed as look-alikes (lunate sigma) are not expanded, so that the list can see them.
    """

    def __init__(self) -> None:
        self.single = np.arange(SIZE, dtype=np.uint32)
        self.invisible = np.zeros(SIZE, bool)
        self.order = np.zeros(SIZE, np.uint8)
        self.length = np.ones(SIZE, np.uint8)
        self.offset = np.zeros(SIZE, np.int32)
        self.script = np.zeros(SIZE, np.uint8)
        self.in_word = np.zeros(SIZE, bool)
        self.emoji = np.zeros(SIZE, bool)
        self.joining = np.zeros(SIZE, bool)
        self.ideograph = np.zeros(SIZE, bool)
        self.touch = np.zeros(SIZE, bool)
        named = {}
        pool: list[int] = []
        pairs: list[tuple[int, int]] = []
        for cp in (*range(0xD800), *range(0xE000, 0x32000), *range(0xE0000, 0xE0200)):
            c = chr(cp)
            kind = unicodedata.category(c)
            if kind in ("Cn", "Co"):
                continue
            self.order[cp] = unicodedata.combining(c)
            if kind[0] == "L":
                named.setdefault(unicodedata.name(c, "").partition(" ")[0], []).append(cp)
            self.in_word[cp] = kind[0] in "LM"
            if kind == "Zs" or cp in (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0x2028, 0x2029):
                self.single[cp] = 0x20
            elif kind in ("Cf", "Cc") or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or cp in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x2800, 0x3164, 0xFFA0):
                # Arabic number signs and Egyptian joiners are format characters that show
                self.invisible[cp] = not (0x0600 <= cp <= 0x0605 or cp in (0x06DD, 0x070F, 0x08E2) or 0x110BD <= cp <= 0x110CD or 0x13430 <= cp <= 0x1345F)
            shape = unicodedata.decomposition(c)
            if 0xAC00 <= cp < 0xD7A4 or (shape and not self.invisible[cp] and self.single[cp] == cp and c not in GREEK_AS_LATIN and c not in KEPT_FORMS):
                full = self._expanded(c, shape, kind)
                if full != c:
                    self.length[cp], self.offset[cp] = len(full), len(pool)
                    pool.extend(map(ord, full))
            composed = unicodedata.normalize("NFC", c) == c
            if composed and 0xAC00 <= cp < 0xD7A4:
                a, b = divmod(cp - 0xAC00, 28)
                first, second = (cp - b, 0x11A7 + b) if b else (0x1100 + a // 21, 0x1161 + a % 21)
                pairs.append(((first << 21) | second, cp))
            elif composed and shape and shape[0] != "<" and " " in shape:
                first, second = (int(x, 16) for x in shape.split())
                pairs.append(((first << 21) | second, cp))
        self._scripts(named)
        for low, high in EMOJI:
            self.emoji[low:high] = True
        for low, high in JOINING:
            self.joining[low:high] = True
        self.ideograph[0x2E80:0x3400] = self.ideograph[0x3400:0xA000] = self.ideograph[0xF900:0xFB00] = self.ideograph[0x20000:0x32000] = True
        self.pool = np.array(pool, np.uint32)
        pairs.sort()
        self.pair_keys = np.array([k for k, _ in pairs], np.int64)
        self.pair_values = np.array([v for _, v in pairs], np.uint32)
        self.second = np.zeros(SIZE, bool)
        self.second[self.pair_keys & 0x1FFFFF] = True
        self.second &= self.order == 0
        self.looks = self._look_alikes()
        # a row without any of these stays as it is; a mark, or a letter that joins the one before, may compose
        self.touch = self.invisible | (self.single != np.arange(SIZE)) | (self.order > 0) | self.second
        self.touch |= self.script > LATIN
        changes = np.flatnonzero(self.length > 1).tolist() + [c for c in np.flatnonzero(self.offset > 0) if self.length[c] == 1]
        for cp in changes:
            self.touch[cp] |= unicodedata.normalize("NFC", "".join(map(chr, self._spread(cp)))) != chr(cp)
        self.changed_single = np.zeros(SIZE, bool)
        self.changed_single[[c for c in changes if self.length[c] == 1]] = True

    def _spread(self, cp: int) -> np.ndarray:
        return self.pool[self.offset[cp] : self.offset[cp] + self.length[cp]]

    def _scripts(self, named: dict[str, list[int]]) -> None:
        """The script of every letter, by the first word of its name: the tabled ones, then any other."""
        others = [n for n, cps in named.items() if n and n not in TABLED and n not in NO_SCRIPT and len(cps) >= LEAST_LETTERS]
        for number, name in enumerate((*TABLED, *others), 1):
            self.script[named[name]] = number

    @staticmethod
    def _expanded(c: str, shape: str, kind: str) -> str:
        """The full canonical decomposition; also the compatibility one where it shows the same letters."""
        tag = shape.split()[0] if shape.startswith("<") else ""
        letters = kind[0] == "L" or kind == "Nl" or tag in ("<wide>", "<narrow>", "<square>", "<font>")
        return unicodedata.normalize("NFKD" if tag in SAME_LETTERS and letters else "NFD", c)

    @staticmethod
    def _look_alikes() -> np.ndarray:
        """looks[s][c]: the letter of tabled script s that looks like c, or 0. The first letter listed for a Latin one counts."""
        looks = np.zeros((len(TABLED) + 1, LOOKS), np.uint32)
        listed = {CYRILLIC: CYRILLIC_AS_LATIN, GREEK: GREEK_AS_LATIN, ARMENIAN: ARMENIAN_AS_LATIN, CHEROKEE: CHEROKEE_AS_LATIN, COPTIC: COPTIC_AS_LATIN, LISU: LISU_AS_LATIN}
        for script, pairs in listed.items():
            for foreign, latin in pairs.split():
                looks[LATIN][ord(foreign)] = ord(latin)
                if not looks[script][ord(latin)]:
                    looks[script][ord(latin)] = ord(foreign)
        for script in listed:
            for other, pairs in listed.items():
                if other != script:
                    for foreign, _ in pairs.split():
                        looks[script][ord(foreign)] = looks[script][looks[LATIN][ord(foreign)]]
        return looks


@functools.cache
def tables() -> Tables:
    return Tables()


def _neighbours(points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code point before and after each one in its row, 0 at the ends."""
    before, after = np.zeros_like(points), np.zeros_like(points)
    same = rows[1:] == rows[:-1]
    before[1:][same] = points[:-1][same]
    after[:-1][same] = points[1:][same]
    return before, after


def _shown(t: Tables, points: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which code points stay: the visible, and the invisible ones that emoji and some scripts need."""
    hidden = t.invisible[points]
    if not hidden.any():
        return ~hidden
    before, after = _neighbours(points, rows)
    emoji_before = t.emoji[before] | (before == VS16) | (before == ZWJ)
    keep = (points == ZWJ) & emoji_before & t.emoji[after]
    keep |= ((points == ZWJ) | (points == ZWNJ)) & t.joining[before]
    selector = (points == VS15) | (points == VS16)
    keep |= selector & (t.emoji[before] | (before == 0xA9) | (before == 0xAE) | (after == KEYCAP))
    keep |= (((points >= 0xFE00) & (points <= VS16)) | (points >= 0xE0100)) & t.ideograph[before]
    tag = (points >= 0xE0020) & (points <= 0xE007F)
    if tag.any():  # tags belong to the last character before them that is no tag
        last = np.maximum.accumulate(np.where(tag, -1, np.arange(len(points))))
        keep |= tag & (last >= 0) & (points[last] == 0x1F3F4) & (rows[last] == rows)
    return ~hidden | keep


def _spread_out(t: Tables, points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every code point replaced by its expansion: lengths and offsets come from the tables."""
    length = t.length[points].astype(np.int64)
    pooled = (length > 1) | t.changed_single[points]
    if not pooled.any():
        return points, rows
    ends = np.cumsum(length)
    within = np.arange(ends[-1]) - np.repeat(ends - length, length)
    out = np.repeat(points, length)
    from_pool = np.repeat(pooled, length)
    out[from_pool] = t.pool[(np.repeat(t.offset[points], length) + within)[from_pool]]
    return out, np.repeat(rows, length)


def _ordered(t: Tables, points: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Runs of marks in canonical order; a stable sort within each run, all runs at once."""
    order = t.order[points]
    if not ((order[1:] > 0) & (order[:-1] > order[1:]) & (rows[1:] == rows[:-1])).any():
        return points
    start = order == 0
    start[1:] |= rows[1:] != rows[:-1]
    return points[np.lexsort((order, np.cumsum(start)))]


def _one_script(t: Tables, points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Look-alikes of another script within a word replaced; and which code points lie in a word that mixes scripts.

    Any two scripts are a mixture; letters are replaced between scripts that have a table.
    """
    script = t.script[points]
    mixed_at = np.zeros(len(points), bool)
    if not (script > LATIN).any():
        return points, mixed_at
    inside = t.in_word[points]
    border = ~inside
    border[1:] |= (rows[1:] != rows[:-1]) | ~inside[:-1]
    border[:1] = True
    word = np.cumsum(border) - 1
    n = int(word[-1]) + 1
    letters = np.flatnonzero(script)
    first = np.flatnonzero(np.diff(word[letters], prepend=-1))
    low, high = np.minimum.reduceat(script[letters], first), np.maximum.reduceat(script[letters], first)
    mixed = np.zeros(n, bool)
    mixed[word[letters[first[low != high]]]] = True
    if not mixed.any():
        return points, mixed_at
    mixed_at = mixed[word] & inside
    at = np.flatnonzero(mixed_at & (script > 0) & (script <= len(TABLED)))
    w, own, place = word[at], script[at], np.minimum(points[at], LOOKS - 1)
    counts = np.stack([np.bincount(w[own == s], minlength=n) for s in range(1, len(TABLED) + 1)])
    left = np.stack([np.bincount(w[(own != s) & (t.looks[s][place] == 0)], minlength=n) for s in range(1, len(TABLED) + 1)])
    # a script into which every letter goes comes first, then the one with most letters, then Latin
    target = np.argmin(left * 1_000_000 - counts * 8 + np.arange(len(TABLED))[:, None], axis=0) + 1
    alike = t.looks[target[w], place]
    change = (own != target[w]) & (alike > 0)
    out = points.copy()
    out[at[change]] = alike[change]
    return out, mixed_at


def _composed(t: Tables, points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters joined with the marks behind them: round r looks at the r-th mark of every run at once."""
    order = t.order[points].astype(np.int16)
    starter = (order == 0) & ~t.second[points]
    starter[1:] |= rows[1:] != rows[:-1]
    starter[:1] = True
    starts = np.flatnonzero(starter)
    lengths = np.diff(np.append(starts, len(points)))
    alive = np.ones(len(points), bool)
    out = points.copy()
    runs = np.flatnonzero(lengths > 1)
    base = starts.copy()
    last = np.zeros(len(starts), np.int16)
    r = 1
    while len(runs):
        at = starts[runs] + r
        keys = (out[base[runs]].astype(np.int64) << 21) | out[at]
        place = np.minimum(np.searchsorted(t.pair_keys, keys), len(t.pair_keys) - 1)
        open_ = np.where(order[at] == 0, last[runs] == 0, last[runs] < order[at]) & (order[base[runs]] == 0)
        hit = (t.pair_keys[place] == keys) & open_
        out[base[runs[hit]]] = t.pair_values[place[hit]]
        alive[at[hit]] = False
        missed = runs[~hit]
        last[missed] = order[at[~hit]]
        fresh = ~hit & (order[at] == 0)
        base[runs[fresh]] = at[fresh]
        r += 1
        runs = runs[lengths[runs] > r]
    return out[alive], rows[alive]


def plain_batch(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The plain form of every string, and whether it mixed scripts within a word.

    Only rows with a code point that some table touches are worked on.
    """
    t = tables()
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    points, borders = to_code_points(values)
    n = len(borders) - 1
    mixed = np.zeros(n, bool)
    rows = row_of(borders)
    touched = np.zeros(n, bool)
    touched[rows[t.touch[points]]] = True
    if not touched.any():
        return values, mixed
    work = touched[rows]
    p, r = t.single[points[work]], rows[work]
    shown = _shown(t, p, r)
    p, r = p[shown], r[shown]
    p, r = _spread_out(t, p, r)
    p = _ordered(t, p, r)
    p, mixed_at = _one_script(t, p, r)
    mixed[r[mixed_at]] = True
    p, r = _composed(t, p, r)
    fresh = from_code_points(p, borders_of(r, n))
    plain = pc.if_else(pa.array(touched), fresh, values.cast(fresh.type))
    if values.null_count:
        plain = pc.if_else(values.is_valid(), plain, pa.scalar(None, plain.type))
    return plain.cast(pa.string()) if plain.nbytes < 2**31 else plain, mixed


@functools.cache
def _plain_udf():
    @F.arrow_udf("string")
    def plain(values: pa.Array) -> pa.Array:
        return plain_batch(values)[0]

    return plain


def plain(text: Column) -> Column:
    """The plain form of a text column. Printable ASCII never leaves the JVM's fast path.

    Null gives null, '' gives ''.
    """
    return F.when(text.rlike(r"[^\x20-\x7e]"), _plain_udf()(F.when(text.rlike(r"[^\x20-\x7e]"), text))).otherwise(text)


def _odd(values: pa.Array) -> pa.Array:
    form, mixed = plain_batch(values)
    same = pc.fill_null(pc.equal(form, values.cast(form.type)), True)
    return pc.or_(pc.invert(same), pa.array(mixed))


def _flag(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        odd = [_odd(batch.column(c)) for c in columns]
        yield pa.RecordBatch.from_arrays([batch.column(0), *odd], names=[batch.schema.names[0], *columns])


def not_plain(df: DataFrame, rec_id: str, *columns: str) -> DataFrame:
    """(rec_id, field) of every value of ``columns`` that is not in plain form, or mixes scripts within a word.

    One narrow pass over ``df`` for all columns, without a shuffle: the JVM drops printable
    ASCII, nulls and '' before Python sees a row. Only the columns named are read.
    """
    beyond = lambda c: F.col(c).rlike(r"[^\x20-\x7e]")
    text = [F.when(beyond(c), F.col(c)).alias(f"c{i}") for i, c in enumerate(columns)]
    rows = df.select(F.col(rec_id).alias("rec_id"), *text).filter(F.coalesce(*[f"c{i}" for i in range(len(columns))]).isNotNull())
    kind = rows.schema["rec_id"].dataType.simpleString()
    names = [f"c{i}" for i in range(len(columns))]
    judged = rows.mapInArrow(lambda batches: _flag(batches, names), f"rec_id {kind}, " + ", ".join(f"{n} boolean" for n in names))
    fields = F.filter(F.array(*[F.when(F.col(n), F.lit(c)) for n, c in zip(names, columns, strict=True)]), lambda x: x.isNotNull())
    return judged.select("rec_id", F.explode(fields).alias("field"))
