"""Problems 4 and 5 against brute force and on edge cases."""

import json
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.operators import multivalue, references


def brute_split(text, slash):
    """A reader that goes through the field character by character."""
    t = (text or "").strip(" ")
    if t.startswith("[") and t.endswith("]"):
        try:
            listed = json.loads(t)
        except ValueError:
            listed = None
        if isinstance(listed, list) and all(isinstance(v, str) for v in listed):
            return [v.strip(" ") for v in listed if v.strip(" ")]
    single = ",;|" if slash else ";|"

    def delimiter(i):
        if i >= len(text):
            return 0
        return 1 if text[i] in single else 3 if slash and text[i : i + 3] == " / " else 0

    out, i = [], 0
    while text and i <= len(text):
        j = i
        while j < len(text) and text[j] == " ":
            j += 1
        if j < len(text) and text[j] == '"':
            k, inner = j + 1, ""
            while k < len(text):
                if text[k] == '"' and text[k + 1 : k + 2] == '"':
                    inner += '"'
                    k += 2
                elif text[k] == '"':
                    break
                else:
                    inner += text[k]
                    k += 1
            end = k + 1
            while end < len(text) and text[end] == " " and not delimiter(end):
                end += 1
            if k < len(text) and (end == len(text) or delimiter(end)):
                out.append(inner)
                i = end + max(1, delimiter(end))
                if end == len(text):
                    break
                continue
        j = i
        while j < len(text) and not delimiter(j):
            j += 1
        out.append(text[i:j])
        if j >= len(text):
            break
        i = j + delimiter(j)
    return [v.strip(" ") for v in out if v.strip(" ")]


CASES = [
    None, "", " ", "A", "A, B", "A; B;", '"A, B"; C', '"A ""x"" B", C', "A / B/C / D", '["a", "b, c", ""]', "[a, b]", '"open, B', '"a"b, c',
    "  , A", "0, \"x, y\"", 'A "n" B, C', '""; A; B', "A | B ; C", " / A", "x, " * 3000,
]


@pytest.mark.parametrize("slash", [True, False])
def test_split_values_like_brute_force(spark, slash):
    rows = spark.createDataFrame(list(enumerate(CASES)), "rec_id long, f string")
    delimiters = multivalue.NAME_DELIMITERS if slash else multivalue.LIST_DELIMITERS
    found = {}
    for r in multivalue.explode_values(rows, "t", "rec_id", "f", delimiters).collect():
        found.setdefault(r.rec_id, []).append((r.pos, r.val))
    for i, text in enumerate(CASES):
        want = brute_split(text, slash)
        got = [v for _, v in sorted(found.get(i, []))]
        assert got == (want if len(want) > 1 else []), text
        assert [p for p, _ in sorted(found.get(i, []))] == list(range(1, len(got) + 1))



def test_explode_values_of_other_delimiters(spark):
    rows = spark.createDataFrame([(1, "a\tb"), (2, "a+b"), (3, "a\nb"), (4, '["a", "b"]'), (5, "a, b"), (6, '"a+b"')], "rec_id long, f string")
    got = {(r.rec_id, r.pos, r.val) for r in multivalue.explode_values(rows, "t", "rec_id", "f", "[\t+\n]").collect()}
    assert got == {(i, p, v) for i in (1, 2, 3, 4) for p, v in ((1, "a"), (2, "b"))}


def test_split_values_of_random_fields(spark):
    seen = []

    @settings(max_examples=400, deadline=None)
    @given(st.text(alphabet='ab ,;|/"', max_size=14))
    def gather(text):
        seen.append(text)

    gather()
    rows = spark.createDataFrame(list(enumerate(seen)), "rec_id long, f string")
    got = {}
    for r in multivalue.explode_values(rows, "t", "rec_id", "f", multivalue.NAME_DELIMITERS).collect():
        got.setdefault(r.rec_id, []).append((r.pos, r.val))
    for i, text in enumerate(seen):
        want = brute_split(text, True)
        assert [v for _, v in sorted(got.get(i, []))] == (want if len(want) > 1 else []), text


def at(day):
    return datetime(2024, 1, day)


def test_orphans(spark):
    child = spark.createDataFrame(
        [(1, "a", at(1)), (2, " k:playlist:b ", at(5)), (3, "https://x.y/p/c?si=1", at(5)), (4, "", at(1)), (5, None, at(1)), (6, "A", at(1)),
         (7, "b", at(2)), (8, "b", None), (9, "d", at(1)), (9, "zz", at(1)), (9, "zz", at(1)), (10, "e", at(9)), (11, "f", at(9))],
        "seq long, ref string, at timestamp",
    ).selectExpr("*", "'x' AS key", "1 AS gone")  # clashing names
    parent = spark.createDataFrame(
        [("a\t", at(1), None), ("b", at(1), None), ("b", at(3), at(4)), ("d", at(20), None), (None, at(1), None), ("e", at(2), at(3)), ("e", at(4), None),
         ("f", at(2), None), ("f", at(2), at(2)), ("", at(1), None)],
        "id string, at timestamp, deleted timestamp",
    )
    got = sorted((r.child_id, r.why) for r in references.orphans(child, "seq", "ref", "at", parent, "id", "at", "deleted").collect())
    assert got == [(2, "deleted"), (3, "missing"), (6, "missing"), (9, "missing"), (9, "missing"), (11, "deleted")]
    none = references.orphans(child, "seq", "ref", "at", parent.filter("1=0"), "id", "at", "deleted")
    assert {r.why for r in none.collect()} == {"missing"} and none.count() == 11
    assert references.orphans(child.filter("1=0"), "seq", "ref", "at", parent, "id", "at", "deleted").count() == 0
    report = references.orphan_report("t", child, "ref", "at", references.orphans(child, "seq", "ref", "at", parent, "id", "at", "deleted"))
    assert {(r.month, r.n_refs, r.n_missing, r.n_deleted) for r in report.collect()} == {("2024-01", 10, 4, 2), (None, 1, 0, 0)}
