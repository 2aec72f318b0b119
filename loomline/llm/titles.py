"""Titles of recordings: their words without editions and guests, and which version they name."""

from __future__ import annotations

import re

from .names import edits, without_accents

#: Words that make another recording, words of mere editions, and words of uploads.
VERSIONS = frozenset("live remix acoustic instrumental demo cover karaoke unplugged mix edit dub rework reprise".split())
EDITIONS = frozenset("remaster remastered edition deluxe bonus version international anniversary reissue expanded mono stereo explicit album single digital original uk us eu track".split())
UPLOADS = frozenset("official audio video lyrics lyric music hq hd visualizer visualiser full 4k mv clip".split())
GUESTS = re.compile(r"(?:feat|ft|featuring|with)\b\.?\s", re.IGNORECASE)
_TAIL = re.compile(r"^(?P<head>.*\S)\s*(?:\((?P<a>[^()]*)\)|\[(?P<b>[^\[\]]*)\]|\s[-–—]\s+(?P<c>[^-–—]+?))$", re.DOTALL)
_OPEN_GUESTS = re.compile(r"^(?P<head>.*\S)\s+(?:feat|ft|featuring)\b\.?\s.*$", re.IGNORECASE | re.DOTALL)
_DOUBLED = re.compile(r"(.)\1+")
_NUMBER = re.compile(r"^\s*\d{1,3}\s*(?:[-.]\s+|-(?=\D))")


def words(text: str) -> list[str]:
    """Runs of letters and digits, without case, accents and apostrophes."""
    return re.findall(r"[^\W_]+", re.sub(r"['’`´]", "", without_accents(text).casefold()))


def _near(word: str, known: frozenset[str]) -> str:
    """``word``, or the known word that it is a slip of."""
    if word in known or len(word) < 4:
        return word
    return next((k for k in sorted(known) if len(k) > 3 and edits(word, k, 1) <= 1), word)


def parse_title(title: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(words, version) of a title in plain form.

    Trailing parts in brackets or behind a dash go if they name an edition, an upload or
    guests; if they name a version they become ``version``; any other part stays a part of
    the title, and what stands before it is not looked at. A leading track number goes. A
    title without letters and digits keeps its characters.
    """
    text = title.strip()
    version: list[str] = []
    while m := _TAIL.match(text):
        part = m["a"] if m["a"] is not None else m["b"] if m["b"] is not None else m["c"]
        if GUESTS.match(part.strip() + " "):
            text = m["head"]
            continue
        own = [_near(w, VERSIONS | EDITIONS | UPLOADS) for w in words(part)]
        if any(w in VERSIONS for w in own):
            version = own + version
        elif not own or not (all(w in EDITIONS or w in UPLOADS or w.isdigit() for w in own) or any(w in ("remaster", "remastered", "edition") for w in own)):
            break
        text = m["head"]
    if m := _OPEN_GUESTS.match(text):
        text = m["head"]
    bare = _NUMBER.sub("", text)
    found = words(bare if words(bare) else text)
    return tuple(found) or ((text.casefold(),) if text else ()), tuple(w for w in version if w not in ("version", "at"))


def same_title(a: list[str], b: list[str], df_a: list[int], df_b: list[int]) -> float:
    """The likeness of two titles' words, 0 if they are not taken for one title.

    A word may be a slip of the other side's word only if it is far rarer, or if the two
    differ by a doubled letter alone: two words that are both common are two words. Numbers
    must agree.
    """
    if a == b:
        return 1.0
    if "".join(a) == "".join(b):
        return 0.98
    if len(a) != len(b):
        return 0.0
    cost, score = 0, 1.0
    for x, y, n, m in zip(a, b, df_a, df_b, strict=True):
        if x == y:
            continue
        size = max(len(x), len(y))
        if size < 3 or any(c.isdigit() for c in x + y):
            return 0.0
        if min(n, m) > max(2, max(n, m) / 8) and _DOUBLED.sub(r"\1", x) != _DOUBLED.sub(r"\1", y):
            return 0.0
        d = edits(x, y, 2 if size > 6 else 1)
        cost += d
        if cost > 2 or d > (2 if size > 6 else 1):
            return 0.0
        score *= 1 - 0.06 * d
    return score
