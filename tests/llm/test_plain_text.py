"""Problem 1 against unicodedata and on cases written out."""

import random
import unicodedata

import pyarrow as pa
import pytest

from loomline.llm.plain_text import not_plain, plain, plain_batch

CASES = [
    (None, None), ("", ""), ("plain", "plain"), ("Ｗｉｄｅ", "Wide"), ("Café", "Café"), ("a b　c\td", "a b c d"),
    ("no​thing﻿", "nothing"), ("Rооf", "Roof"), ("Οrϲhard", "Orchard"), ("ﬁne oﬃce", "fine office"), ("ｶﾞｷﾞ", "ガギ"),
    ("Зoя", "Зоя"), ("СОН", "СОН"), ("Ночной город", "Ночной город"), ("Παλιό ψωμί", "Παλιό ψωμί"), ("👩‍🎤 ❤️", "👩‍🎤 ❤️"),
    ("a‍🎤", "a🎤"), ("Don’t … ™", "Don’t … ™"), ("ヨルノミナト", "ヨルノミナト"), ("می‌خواهم", "می‌خواهم"), ("x️", "x"), ("1️⃣", "1️⃣"),
    ("ệ", "ệ"), ("ệ", "ệ"), ("한", "한"), ("́x", "́x"), ("a" + "́" * 500, "á" + "́" * 499),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_cases(text, want):
    assert plain_batch(pa.array([text], pa.string()))[0].to_pylist() == [want]


def test_all_cases_in_one_batch_and_sliced():
    texts, wanted = zip(*CASES, strict=True)
    assert plain_batch(pa.array(texts, pa.string()))[0].to_pylist() == list(wanted)
    assert plain_batch(pa.array(texts, pa.string()).slice(3, 20))[0].to_pylist() == list(wanted[3:23])
    assert plain_batch(pa.array([], pa.string()))[0].to_pylist() == []


def test_composes_like_unicodedata():
    rng = random.Random(5)
    ranges = [(0x41, 0x250), (0x300, 0x345), (0xAC00, 0xAC60), (0x1100, 0x1113), (0x1161, 0x1176), (0x11A8, 0x11C3), (0x900, 0x980), (0x1E00, 0x1EFF)]
    pool = [chr(c) for a, b in ranges for c in range(a, b) if unicodedata.category(chr(c)) not in ("Cf", "Cc", "Zs", "Cn")]
    pool = [c for c in pool if not unicodedata.decomposition(c).startswith("<")]
    texts = ["".join(rng.choices(pool, k=rng.randint(1, 14))) for _ in range(5000)]
    assert plain_batch(pa.array(texts))[0].to_pylist() == [unicodedata.normalize("NFC", x) for x in texts]


def test_is_idempotent_on_any_text():
    rng = random.Random(6)
    texts = ["".join(chr(rng.choice([*range(0x20, 0x3000), *range(0xFB00, 0xFFF0), *range(0x1F300, 0x1F600)])) for _ in range(rng.randint(0, 9))) for _ in range(4000)]
    once = plain_batch(pa.array(texts))[0]
    assert plain_batch(once)[0].to_pylist() == once.to_pylist()


def test_on_dataframes(spark):
    rows = spark.createDataFrame([(i, t, "ｘ") for i, (t, _) in enumerate(CASES)], "rec_id long, value string, mixed string")
    got = {(r.rec_id, r.field) for r in not_plain(rows, "rec_id", "value", "mixed").collect()}
    assert got == {(i, "value") for i, (t, want) in enumerate(CASES) if t != want} | {(i, "mixed") for i in range(len(CASES))}
    from pyspark.sql import functions as F

    assert [r.p for r in rows.orderBy("rec_id").select(plain(F.col("value")).alias("p")).collect()] == [w for _, w in CASES]
    assert not_plain(rows.filter("1=0"), "rec_id", "value").count() == 0


def test_any_two_scripts_in_a_word_are_a_mixture():
    mixed = ["שלוםa", "Aλpha", "ξerox", "ընդx", "Bօb", "გoა"]
    whole = ["Москва", "Ελλάδα", "Հայաստան", "ᏣᎳᎩ", "שלום", "საქართველო", "宇多田ヒカル", "Tシャツ", "Jポップ", "한국어B", "µs", "ªº", "Ångström", "Привет Bob"]
    assert plain_batch(pa.array(mixed))[1].all() and not plain_batch(pa.array(whole))[1].any()
    assert plain_batch(pa.array(whole))[0].to_pylist() == whole
