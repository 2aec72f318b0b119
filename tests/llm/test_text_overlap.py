"""Problems 7, 8 and 10 against brute force, and on edge cases."""

import random
import re
from collections import Counter
from itertools import combinations

import pytest

from loomline.llm import cooccurrence, leakage, shared_spans
from loomline.llm.automaton import SuffixAutomaton


def brute_pairs(rows, low, high, least):
    baskets = {}
    for b, i in rows:
        if b and i:
            baskets.setdefault(b, set()).add(i)
    kept = [s for s in baskets.values() if low <= len(s) <= high]
    n = Counter(i for s in kept for i in s)
    ab = Counter(p for s in kept for p in combinations(sorted(s), 2))
    return {(a, b, k, n[a], n[b], len(kept)) for (a, b), k in ab.items() if k >= least}


def test_together_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cooccurrence, "RUN_CODES", 50)
    rng = random.Random(1)
    rows = [(f"b{rng.randint(0, 60)}", f"i{int(rng.random() ** 3 * 40)}") for _ in range(900)]
    rows += [("huge", f"i{k}") for k in range(40)] + [(None, "i1"), ("b1", None), ("", "i1"), ("b2", ""), ("one", "i1")] + rows[:50]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "basket string, item string, n int, code int")
    got = cooccurrence.together(df, "basket", "item", 2, 20, 3).collect()
    want = brute_pairs(rows, 2, 20, 3)
    assert {(r.item_a, r.item_b, r.n_ab, r.n_a, r.n_b, r.n_baskets) for r in got} == want and len(got) == len(want) > 20
    r = got[0]
    assert r.lift == pytest.approx(r.n_ab * r.n_baskets / (r.n_a * r.n_b))
    odds = (r.n_ab + 0.5) * (r.n_baskets - r.n_a - r.n_b + r.n_ab + 0.5) / ((r.n_a - r.n_ab + 0.5) * (r.n_b - r.n_ab + 0.5))
    assert r.odds_ratio == pytest.approx(odds)
    assert cooccurrence.together(df.filter("1=0"), "basket", "item").count() == 0
    assert cooccurrence.together(df.filter("basket = 'one'"), "basket", "item").count() == 0


def brute_leaks(docs, items, least):
    words = lambda t: [w.lower() for w in re.findall(r"[^\W_]+", t or "")]
    out = set()
    for d, text in docs:
        have = words(text)
        grams = {tuple(have[i : i + least]) for i in range(len(have) - least + 1)}
        for k, item in items:
            w = words(item)
            if any(tuple(w[i : i + least]) in grams for i in range(len(w) - least + 1)):
                out.add((d, k))
    return out


def test_leaks_like_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [*"abcdefgh", "Ünder", "ночь", "x1"]
    line = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, line(rng.randint(0, 20))) for i in range(30)] + [(30, None), (31, ""), (32, "  !! "), (33, line(6)), (1, "a b c d e f g h")]
    docs = []
    for d in range(60):
        text = line(rng.randint(0, 60))
        w = (items[rng.randrange(30)][1] or "").split()
        if len(w) > 8 and d % 2:
            a = rng.randint(0, len(w) - 8)
            text += ", ... " + "—".join(w[a : a + rng.randint(5, 12)]).upper() + "\n" + line(5)
        docs.append((d, text))
    docs += [(100, None), (101, ""), (102, items[0][1]), (102, items[0][1]), (103, "zz " * 50000 + (items[3][1] or ""))]
    schema = "id long, text string, item_text string, low long, doc_id long"
    make = lambda rows: spark.createDataFrame([(i, t, "q", 0, 1) for i, t in rows], schema)
    got = leakage.leaks(make(docs), "id", make(items), "id", "text", 8, 5).collect()
    want = brute_leaks(docs, items, 8)
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) > 10
    assert all(r.longest_run >= 8 and 0 < r.containment <= 1 for r in got)
    assert leakage.leaks(make(docs), "id", make(items).filter("1=0"), "id").count() == 0
    assert leakage.leaks(make(docs).filter("1=0"), "id", make(items), "id").count() == 0


def brute_spans(docs, least):
    seen = {}
    for d, text in docs:
        for i in range(len(text or "") - least + 1):
            seen.setdefault(text[i : i + least], set()).add(d)
    return seen


def test_automaton_spans():
    rng = random.Random(3)
    for _ in range(200):
        pieces = ["".join(rng.choices("ab", k=rng.randint(0, 12))) for _ in range(rng.randint(1, 3))]
        text = "".join(rng.choices("abc", k=15))
        joined = "\0".join(pieces) + "\0"
        want = set()
        for end in range(1, len(text) + 1):
            size = max(k for k in range(end + 1) if any(text[end - k : end] in p for p in pieces))
            longer = end < len(text) and any(text[end - size : end + 1] in p for p in pieces)
            if size >= 3 and not longer:
                want.add((end - size, size))
        got = list(SuffixAutomaton(pieces).maximal_spans(text, 3))
        assert {(s, n) for s, n, _ in got} == want
        assert all(joined[e - n : e] == text[s : s + n] for s, n, e in got)


@pytest.mark.parametrize("few", [48, 2])
def test_shared_spans_like_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(shared_spans, "FEW", few)
    monkeypatch.setattr(shared_spans, "SHARD", 3)
    rng = random.Random(4)
    least = 24
    line = lambda n: "".join(rng.choices("abcdé🎵 ", k=n))
    passages, short = [line(rng.randint(24, 60)) for _ in range(6)], line(22)
    docs = []
    for d in range(40):
        text = line(rng.randint(0, 80))
        if d % 3 == 0:
            text += rng.choice(passages) + line(rng.randint(0, 30))
        if d % 2 == 0:
            text += short + line(3)
        if d % 7 == 0:
            text += passages[0] + line(2) + passages[0]
        docs.append((d, text))
    docs += [(50, docs[0][1]), (51, docs[0][1]), (52, line(40)), (60, None), (61, ""), (62, "x" * 500), (63, "x" * 30)]
    df = spark.createDataFrame([(d, t, b"0", 1) for d, t in docs], "id long, text string, cls binary, first int")
    run = shared_spans.SharedSpans(df, "id", "text", least)
    seen = brute_spans(docs, least)
    want = {p for g in seen.values() for p in combinations(sorted(g), 2)}
    got = run.found_pairs().collect()
    assert {(r.doc_a, r.doc_b) for r in got} == want and len(got) == len(want) > 10
    rows = {r.doc_id: r for r in run.coverage().collect()}
    assert len(rows) == len(docs)
    for d, text in docs:
        mask = set()
        for i in range(len(text or "") - least + 1):
            if len(seen[text[i : i + least]]) > 1:
                mask.update(range(i, i + least))
        assert rows[d].shared_chars == len(mask), d
    kept = {r.doc_id: r.kept for r in run.stripped().collect()}
    left = brute_spans([(d, kept.get(d, t)) for d, t in docs], least)
    assert not any(len(g) > 1 for g in left.values()) and kept[50] == kept[51] == "" and 0 not in kept


def test_copies_keep_their_links(spark, monkeypatch):
    """However many copies there are, each is paired with the first, the next, and with every different text."""
    monkeypatch.setattr(shared_spans, "COPIES", 2)
    text, other = "the same long text again and again " * 2, "another text that ends with: " + "the same long text again and again "
    df = spark.createDataFrame([(d, text) for d in range(6)] + [(d, other) for d in (20, 21, 22)] + [(9, "x" + text)], "id long, text string")
    run = shared_spans.SharedSpans(df, "id", "text", 24)
    rows = run.found_pairs().collect()
    got = {(r.doc_a, r.doc_b) for r in rows}
    within = {(0, d) for d in range(1, 6)} | {(d, d + 1) for d in range(5)} | {(20, 21), (20, 22), (21, 22)}
    single = {(d, 9) for d in range(6)} | {(9, d) for d in (20, 21, 22)}
    across = {(d, 20) for d in range(6)} | {(0, d) for d in (20, 21, 22)} | {(1, 21), (2, 22)}
    assert got == within | single | across and len(rows) == len(got)
    assert {(r.doc_id, r.class_id, r.n_links) for r in run.linked().collect()} == {(d, 0, 2) for d in range(6)} | {(d, 20, 2) for d in (20, 21, 22)} | {(9, 9, 2)}
    assert shared_spans.SharedSpans(df.filter("1=0"), "id").found_pairs().count() == 0


def test_a_common_footer_costs_its_texts_not_their_pairs(spark, monkeypatch):
    """Coverage and stripping of a footer in all texts come from window counts: no pair is made."""
    monkeypatch.setattr(shared_spans.SharedSpans, "_refined", None)
    rng = random.Random(8)
    footer = "".join(rng.choices("abcdefgh ", k=60))
    docs = [(d, "".join(rng.choices("ijklmnop ", k=30)) + footer) for d in range(120)]
    run = shared_spans.SharedSpans(spark.createDataFrame(docs, "id long, text string"), "id", "text", 24)
    assert run.pairs.count() < 1500  # of 7140: those with equal characters before the footer too
    seen = brute_spans(docs, 24)
    held = lambda t: len({i + k for i in range(len(t) - 23) if len(seen[t[i : i + 24]]) > 1 for k in range(24)})
    assert {r.doc_id: r.shared_chars for r in run.coverage().collect()} == {d: held(t) for d, t in docs}
    kept = {r.doc_id: r.kept for r in run.stripped().collect()}
    assert len(kept) == 119 and all(docs[d][1].startswith(k) and len(k) <= 30 for d, k in kept.items())


def test_a_long_reference_is_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(shared_spans, "PIECE", 40)
    rng = random.Random(9)
    long = "".join(rng.choices("abcdefgh ", k=400))
    docs = [(1, long), (2, "zz" + long[70:230] + "yy"), (3, long[380:] + "-" * 9 + long[:25])]
    run = shared_spans.SharedSpans(spark.createDataFrame(docs, "id long, text string"), "id", "text", 24)
    assert {(r.doc_a, r.doc_b) for r in run.found_pairs().collect()} == {(1, 2), (1, 3)}
    assert {r.doc_id: r.shared_chars for r in run.coverage().collect()} == {1: 160 + 25, 2: 160, 3: 25}
    assert {r.doc_id: r.kept for r in run.stripped().collect()} == {2: "zzyy", 3: long[380:] + "-" * 9}
