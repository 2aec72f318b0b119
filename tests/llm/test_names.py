"""Problem 3: names, components and the spellings of one act."""

import random

import pytest

from loomline.llm.components import connected_components
from loomline.llm.name_variants import act_clusters, variant_pairs
from loomline.llm.names import COMMON_WORDS, acts, edits, jaro_winkler, same_act, tokens


@pytest.mark.parametrize(
    ("credit", "named"),
    [
        ("Ann Lee", ["Ann Lee"]), ("Lee, Ann", ["Lee, Ann"]), ("Pale Owls, The", ["Pale Owls, The"]), ("Bobo, the Third", ["Bobo, the Third"]),
        ("Zed, Son of Nobody", ["Zed, Son of Nobody"]), ("Ann Lee, Bob Ray", ["Ann Lee", "Bob Ray"]), ("Ann Lee feat. Bob Ray & Cy Doe", ["Ann Lee", "Bob Ray", "Cy Doe"]),
        ("Ann & the Owls", ["Ann & the Owls"]), ("Ann Lee ft. Zed, Son of Nobody, Bob Ray", ["Ann Lee", "Zed, Son of Nobody", "Bob Ray"]), ("A/B", ["A/B"]), ("", []),
    ],
)
def test_acts(credit, named):
    assert acts(credit) == named


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Robert Vitizankova", "VITIZANKOVA, Bob", True), ("R. Vitizankova", "Robert Vitizankovа", True), ("The Pale Owlbears", "Pale Owlbears (The)", True),
        ("Rolo Bros.", "Rolo Brothers", True), ("M.C. Kopetub", "MC Kopetub", True), ("Vita S. S.", "Vita Sound System", True), ("ZoraLebolaffel", "Zora Lebolaffel", True),
        ("Victoria Kirodevsky", "Lioba Kirodevsky", False), ("Hedda Kirodevsky", "Hedda Malasorrado", False), ("V.A.", "Various Artists", True), ("VA", "Vera Alba", False),
        ("Odo & the Grey Owls", "Odo and Grey Owls", True), ("Márta Rolo", "Marta Rolo", True), ("Jorun \"Harbor\" Nabat", "Nabat, Jorun", True),
    ],
)
def test_same_act(a, b, same):
    from loomline.llm.plain_text import plain_batch
    import pyarrow as pa

    a, b = plain_batch(pa.array([a, b]))[0].to_pylist()
    assert bool(same_act(tokens(a), tokens(b))) == same == bool(same_act(tokens(b), tokens(a)))


def test_distances():
    assert jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4) and jaro_winkler("", "a") == 0
    assert edits("ab", "ba", 2) == 1 and edits("abc", "abc", 1) == 0 and edits("kitten", "sitting", 3) == 3 and edits("a", "abcd", 2) == 3


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(300, 300), (0, 301)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*links, (None, 3)], "a long, b long"), "a", "b").collect()}
    root = {n: n for p in links for n in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {n: find(n) for n in root}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_variant_pairs(spark):
    names = ["Robert Vitizankova", "Vitizankova, Bob", "Robrt Vitizankova", "R. Vitizankova", "Victoria Kirodevsky", "Vesna Kirodevsky", "V. Kirodevsky",
             "Victoria Kirodevski", "Ann Lee, Bob Ray", "Ann Lee", None, "", "  ", "Ann Lee", "!!", "V.A.", "Various", "x" * 5000]
    df = spark.createDataFrame([(n, "k", ["w"]) for n in names], "name string, key string, words array<string>")
    got = {(r.name_a, r.name_b) for r in variant_pairs(df, "name").collect()}
    bob = sorted(names[:4])
    want = {(a, b) for i, a in enumerate(bob) for b in bob[i + 1 :]}
    assert got == want | {("Victoria Kirodevski", "Victoria Kirodevsky"), ("V.A.", "Various")}
    assert {r.name for r in act_clusters(df, "name").collect()} == set(names) - {"Ann Lee, Bob Ray", None, "", "  ", "!!"}
    assert variant_pairs(df.filter("1=0"), "name").count() == 0


def test_words_beside_many_others_are_common(spark):
    """A word of many names tells none of them apart; a name's own word stays telling, however many slips it has."""
    from loomline.llm import name_variants

    firsts = "ann bea cid dot eve fay gus hal ida jon kit lou".split()
    names = [("Wanderer", f) for f in firsts] + [("Zolotar", f) for f in ("Mia", "Mai", "Mja", "M")] + [(f"Quill{n}rab", "Solo") for n in ("ba", "to")]
    rows = spark.createDataFrame([(sorted(w.lower() for w in n),) for n in names], "words array<string>")
    common = name_variants.common_words(rows)
    assert "wanderer" in common and "zolotar" not in common and "solo" not in common and COMMON_WORDS <= common
    assert name_variants.common_words(rows.filter("1=0")) == COMMON_WORDS
    assert not same_act(("a", "wanderer"), ("ann", "wanderer"), common=common) and same_act(("m", "zolotar"), ("mia", "zolotar"), common=common)


def test_attributes_of_long_titles_survive_two_slips():
    from loomline.llm.linkage import attribute_keys

    title = [f"word{chr(97 + i)}{chr(98 + i)}x" for i in range(18)]
    slips = [*title[:4], "wxxxxx", *title[5:11], "wyyyyy", *title[12:]]
    assert attribute_keys(["someone"], title) & attribute_keys(["someone"], slips) and len(attribute_keys(["someone"], title * 500)) < 200
    assert attribute_keys(["ann", "quill"], ["amber", "ember"]) & attribute_keys(["ann", "quill"], ["amer", "ember"])


def test_names_with_common_words_meet_beside_near_words(spark):
    """A word of many names makes no large block, but no partner is lost: two slips in the other word, or all words common."""
    firsts = "ann bea cid dot eve fay gus hal ida jon kit lou".split()
    names = [f"{w} {f}" for w in ("Wanderer", "Karadon") for f in firsts] + ["Wanderer Sefeduthore", "Wanderer Sefedzthorm", "Karadon Livokegnel", "Karadon Livokengrl", "DJ Wanderer", "DJ Wandera"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {(r.name_a, r.name_b) for r in variant_pairs(df, "name").collect()}
    assert got == {("Wanderer Sefeduthore", "Wanderer Sefedzthorm"), ("Karadon Livokegnel", "Karadon Livokengrl"), ("DJ Wandera", "DJ Wanderer")}
