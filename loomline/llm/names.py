"""Names typed by people: tokens, phonetic codes, and whether two names are one act."""

from __future__ import annotations

import functools
import re
import unicodedata

import regex

#: Short forms of given names, each beside the full form.
NICKNAMES = """
al:alexander alex:alexander alec:alexander sandy:alexander xander:alexander tony:anthony ant:anthony barb:barbara babs:barbara barbie:barbara
chas:charles chuck:charles charlie:charles charley:charles deb:deborah debbie:deborah debby:deborah ed:edward eddie:edward eddy:edward ned:edward ted:edward
liz:elizabeth lizzie:elizabeth beth:elizabeth betty:elizabeth betsy:elizabeth eliza:elizabeth libby:elizabeth bess:elizabeth lisa:elizabeth
fred:frederick fritz:frederick freddie:frederick freddy:frederick gerry:gerald jerry:gerald hal:harold harry:harold jim:james jimmy:james jimmie:james jamie:james
joe:joseph joey:joseph judy:judith judie:judith jude:judith kate:katherine kathy:katherine katie:katherine kat:katherine kitty:katherine kay:katherine kit:katherine
larry:lawrence lars:lawrence laurie:lawrence len:leonard lenny:leonard lennie:leonard leo:leonard maggie:margaret meg:margaret peggy:margaret peg:margaret margie:margaret marge:margaret madge:margaret
mike:michael mick:michael mickey:michael micky:michael mikey:michael nat:nathaniel nate:nathaniel nathan:nathaniel
pat:patricia patty:patricia patti:patricia trish:patricia tricia:patricia trisha:patricia dick:richard rick:richard ricky:richard rich:richard richie:richard
bob:robert bobby:robert rob:robert robbie:robert bert:robert sam:samuel sammy:samuel steve:stephen stevie:stephen steph:stephen steven:stephen
sue:susan susie:susan suzie:susan suzy:susan susanna:susan ted:theodore teddy:theodore theo:theodore tim:timothy timmy:timothy vicky:victoria vicki:victoria vic:victoria tori:victoria vickie:victoria
walt:walter wally:walter wal:walter bill:william billy:william will:william willy:william willie:william liam:william
dan:daniel danny:daniel dave:david tom:thomas tommy:thomas nick:nicholas chris:christopher matt:matthew andy:andrew ben:benjamin ron:ronald don:donald ken:kenneth
jenny:jennifer jen:jennifer becky:rebecca sally:sarah nancy:anne annie:anne cindy:cynthia sandra:alexandra jack:john johnny:john gene:eugene
"""
#: Short forms of what a band calls itself, and titles.
SHORT_WORDS = """
bros:brothers bro:brothers orch:orchestra ens:ensemble ensem:ensemble coll:collective collect:collective 4tet:quartet qt:quartet qrt:quartet qtet:quartet quart:quartet 5tet:quintet ss:sound+system
doctor:dr deejay:dj mister:mr missus:mrs saint:st sys:system snd:sound emcee:mc
"""
#: Words of any list of acts that do not tell acts apart by themselves. Words that
#: stand beside many others in the names at hand come to them, see ``companions``.
COMMON_WORDS = frozenset("brothers orchestra ensemble collective quartet quintet trio band sound system mc dj lady dr mr mrs st lord king queen son daughter of".split())
DROPPED = frozenset(("the", "and"))
#: How the credit for compilations is written, folded and without blanks.
COMPILATIONS = frozenset("va various variousartists variousartist variousperformers varios variosartistas diverse diverseinterpreten verschiedene verschiedeneinterpreten artistesdivers compilation compilations sampler vvaa aavv".split())
COMPILATION = "\0various"

_GUESTS = re.compile(r"\s*[\(\[]?\s*\b(?:feat|ft|featuring|with|vs)\b\.?\s+", re.IGNORECASE)
_CAMEL = regex.compile(r"(?<=\p{Ll}\p{M}*)(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})")
_EPITHET = re.compile(r"the|the \w+|son of \w+|daughter of \w+", re.IGNORECASE)
_QUOTED = re.compile(r'["“”„].+?["“”]')
_LIST = re.compile(r"\s*[;|]\s*")


@functools.cache
def nicknames() -> dict[str, frozenset[str]]:
    out: dict[str, set[str]] = {}
    for pair in NICKNAMES.split():
        short, full = pair.split(":")
        out.setdefault(short, {short}).add(full)
    return {k: frozenset(v) for k, v in out.items()}


@functools.cache
def short_words() -> dict[str, list[str]]:
    return {k: v.split("+") for k, _, v in (p.partition(":") for p in SHORT_WORDS.split())}


def without_accents(text: str) -> str:
    """Latin letters without their marks; other scripts keep theirs."""
    if text.isascii():
        return text
    out, latin = [], False
    for c in unicodedata.normalize("NFD", text):
        if unicodedata.combining(c):
            if latin:
                continue
        else:
            latin = c < "ɐ" or "Ḁ" <= c <= "ỿ"
        out.append(c)
    return unicodedata.normalize("NFC", "".join(out)).translate(_STROKES)


#: Latin letters that have no mark to drop.
_STROKES = str.maketrans({"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ß": "ss", "æ": "ae", "Æ": "Ae", "œ": "oe", "Œ": "Oe", "ı": "i"})


def acts(credit: str) -> list[str]:
    """The acts that a credit in plain form names, in order; guests come after the first acts.

    A comma that sets off an article, an epithet or a given name behind a single word is
    part of a name; ``&`` is, apart from lists of guests.
    """
    head, *guests = _GUESTS.split(credit.strip())
    out = []
    for n, part in enumerate([head, *guests]):
        pieces = [p.strip(" ()[]") if n else p.strip() for chunk in _LIST.split(part) for p in chunk.split(",")]
        pieces = [p for p in pieces if p]
        i = 0
        while i < len(pieces):
            piece = pieces[i]
            if i + 1 < len(pieces):
                follow = pieces[i + 1]
                single = len(piece.split()) == 1 and "-" not in piece and "_" not in piece
                if follow.lower() == "the" or (single and (len(follow.split()) == 1 or _EPITHET.fullmatch(follow))):
                    piece = f"{piece}, {follow}"
                    i += 1
            out.append(piece)
            i += 1
        if n:
            last = out.pop()
            out.extend(p.strip() for p in re.split(r"\s+&\s+(?!the\b)", last, flags=re.IGNORECASE) if p.strip())
    return out


def tokens(act: str) -> tuple[str, ...]:
    """The words of an act in plain form, as a sorted tuple: cases, accents, marks, order,
    articles, quoted bynames and short forms of common words do not count."""
    text = without_accents(_CAMEL.sub(" ", _QUOTED.sub(" ", act) if _QUOTED.sub("", act).strip() else act)).casefold()
    text = re.sub(r"['’`´]", "", text)
    words = re.findall(r"[^\W_]+", text)
    if "".join(words) in COMPILATIONS:
        return (COMPILATION,)
    out: list[str] = []
    letters = ""
    for w in [*words, ""]:
        if len(w) == 1 and w.isalpha():
            letters += w
            continue
        if letters:
            out.extend(short_words().get(letters, [letters]) if len(letters) > 1 else [letters])
            letters = ""
        if w:
            out.extend(short_words().get(w, [w]))
    kept = [w for w in out if w not in DROPPED]
    return tuple(sorted(kept or out))


_CODE = str.maketrans({"c": "k", "q": "k", "g": "k", "x": "k", "z": "s", "v": "f", "w": "f", "d": "t", "b": "p", "h": None, "y": None, "a": None, "e": None, "i": None, "o": None, "u": None, "j": "s"})


@functools.lru_cache(maxsize=100_000)
def phonetic(word: str) -> str:
    """The consonants of a Latin word by sound, equal neighbours once; other words as they are."""
    if not word.isascii():
        return word
    code = word.replace("ph", "f").translate(_CODE)
    return re.sub(r"(.)\1+", r"\1", code) or word[:1]


def shortened(code: str) -> set[str]:
    """The code and every form of it without one character: codes one edit apart share one."""
    return {code, *(re.sub(r"(.)\1+", r"\1", code[:i] + code[i + 1 :]) for i in range(len(code)) if len(code) > 2)}


def full_forms(word: str) -> frozenset[str]:
    return nicknames().get(word) or frozenset((word,))


def companions(words: tuple[str, ...]) -> list[tuple[str, str]]:
    """Each word of a name beside the sound of the longest other word: what tells how many names a word is part of."""
    by_size = sorted(range(len(words)), key=lambda i: (-len(words[i]), words[i]))
    return [(w, phonetic(words[by_size[1] if i == by_size[0] else by_size[0]])) for i, w in enumerate(words)] if len(words) > 1 else []


def block_keys(words: tuple[str, ...], common: frozenset[str] = COMMON_WORDS) -> set[str]:
    """Keys under which a name meets its variants: a main word by its phonetic code, also
    shortened by one character, beside the initial of another word; or the codes of both."""
    if words == (COMPILATION,):
        return {COMPILATION}
    keys = set()
    if len(words) == 1:
        return {f"{c}|" for c in shortened(phonetic(words[0]))}
    for i, main in enumerate(words):
        if len(main) < 3 or main in common:
            continue
        code = phonetic(main)
        forms = shortened(code)
        for j, other in enumerate(words):
            if i == j:
                continue
            for full in full_forms(other):
                keys.update(f"{c}|{full[0]}" for c in forms)
                if len(other) > 1:
                    keys.add("&".join(sorted((code, phonetic(full)))))
    return keys or {"".join(words)}


def sounds_of(common: frozenset[str]) -> frozenset[str]:
    """The sounds by which words meet that are ``common`` or one slip of sound from a common one."""
    return frozenset(c for w in common for c in shortened(phonetic(w)))


def shared_keys(words: tuple[str, ...], common: frozenset[str], sounds: frozenset[str]) -> set[tuple[str, str]]:
    """(key, other): the keys that ``block_keys`` leaves out, under which many names meet.

    ``other`` is the word beside the common one: only names whose other words are near can be one
    act. It is empty if the key holds the sounds of both words, so that few names have it.
    """
    keys = set()
    for i, main in enumerate(words if len(words) > 1 else ()):
        if len(main) < 3:
            continue
        met = shortened(phonetic(main)) & sounds
        for j, other in enumerate(words):
            if i == j:
                continue
            for full in full_forms(other):
                keys.update((f"{c}|{full[0]}", full) for c in met)
                if main in common and len(other) > 1:
                    keys.add(("&".join(sorted((phonetic(main), phonetic(full)))), ""))
    return keys


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    common = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                common.append(c)
                break
    m = len(common)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(common, (c for c, t in zip(b, taken, strict=True) if t), strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, changes and swaps of neighbours between the words, or most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, last, row = row, before, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, last[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
    return row[-1]


@functools.lru_cache(maxsize=200_000)
def word_match(a: str, b: str) -> tuple[float, int]:
    """How surely two words of names are one word (0: not), and how many edits that takes."""
    if a == b:
        return 1.0, 0
    if len(a) == 1 or len(b) == 1:
        initials = {f[0] for f in full_forms(a)} & {f[0] for f in full_forms(b)}
        return (0.9, 0) if initials and (len(a) == 1) != (len(b) == 1) else (0.0, 0)
    if full_forms(a) & full_forms(b):
        return 0.97, 0
    size = max(len(a), len(b))
    most = 1 if size < 8 else 2
    n = edits(a, b, most)
    similar = jaro_winkler(a, b)
    if n <= most and similar >= (0.88 if n > 1 else 0.8):
        return similar, n
    for x, y in ((a, b), (b, a)):  # a typing slip in a full name whose short form is meant, or the other way round
        if any(len(f) > 4 and edits(f, y, 1) <= 1 for f in full_forms(x) if f != x):
            return 0.9, 1
    return 0.0, 0


def same_act(a: tuple[str, ...], b: tuple[str, ...], most_edits: int = 3, common: frozenset[str] = COMMON_WORDS) -> float:
    """The likeness of two names, 0 if they are not taken for one act.

    Every word must find its partner; initials only count beside a word of four letters that is
    not one of the ``common`` ones.
    """
    if a == b:
        return 1.0
    if COMPILATION in (*a, *b):
        return 0.0
    if len(a) != len(b):
        return 0.99 if "".join(a) == "".join(b) else 0.0
    left, total, cost, long = list(b), 1.0, 0, False
    rest = []
    for word in a:
        if word in left:
            left.remove(word)
            long |= len(word) > 3 and word not in common
        else:
            rest.append(word)
    for word in sorted(rest, key=lambda w: (-len(w), w)):  # an initial takes what longer words leave
        best = max(((*word_match(word, other), other) for other in left), key=lambda m: (m[0], -m[1]), default=(0.0, 0, ""))
        if not best[0]:
            return 0.0
        left.remove(best[2])
        total *= best[0]
        cost += best[1]
        long |= min(len(word), len(best[2])) > 3
    return total if long and cost <= most_edits else 0.0


def has_initial(words: tuple[str, ...]) -> bool:
    return len(words) > 1 and any(len(w) == 1 for w in words)
