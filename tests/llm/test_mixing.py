"""Problem 9: packing, draws and shares."""

from collections import Counter

import numpy as np
import pytest

from loomline.llm import mixing
from loomline.llm.mixing import Mix, Plan, _node, permuted, plan

if not __import__("os").path.exists(mixing.VOCABULARY):
    pytest.skip("the tokenizer's file is not here", allow_module_level=True)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permuted(n):
    a = permuted(np.arange(n), n, np.full(n, 5, np.uint64))
    b = permuted(np.arange(n), n, np.full(n, 6, np.uint64))
    assert sorted(a) == sorted(b) == list(range(n)) and (n < 10 or list(a) != list(b))


def test_draws_add_up_and_vary():
    p = Plan(("a", "b", "c"), (500, 301, 76), (100, 400, 50), 10, 3)
    counts, starts = zip(*(_node(p, i, 1) for i in range(p.shards)), strict=True)
    assert p.shards == 88 and (np.sum(counts, axis=0) == p.slots).all() and all(c.sum() == 10 for c in counts[:-1]) and counts[-1].sum() == 7
    assert (np.cumsum(counts, axis=0)[:-1] == np.array(starts[1:])).all() and len({tuple(c) for c in counts}) > 5
    large = Plan(("a", "b"), (3 * 10**9, 10**9), (10**10, 10**10), 1000, 3)
    assert (_node(large, 0, 1)[0].sum(), _node(large, large.shards - 1, 1)[0].sum()) == (1000, 1000)


@pytest.mark.parametrize("total", [10**8, 10**11])
def test_draws_are_alike_at_every_size(total):
    """Means, spreads and correlations of the drawn counts are the hypergeometric ones, below numpy's bound and beyond; a rare source too."""
    counts = np.array([total * 6 // 10, 40, total * 4 // 10 - 40 - 5000, 5000], np.int64)
    take = int(counts.sum()) // 2
    got = np.array([mixing.drawn(np.random.default_rng([s, 1]), counts, take) for s in range(3000)])
    assert (got.sum(axis=1) == take).all() and (got >= 0).all() and (got <= counts).all()
    whole = counts.sum()
    mean = counts / whole * take
    spread = np.sqrt(counts * 1.0 * (whole - counts) / whole / whole * take / (whole - 1.0) * (whole - take))
    z = (got - mean) / spread
    assert (abs(z.mean(axis=0)) < 0.08).all() and (abs(z.std(axis=0) - 1) < 0.06).all()
    assert np.corrcoef(got[:, 0], got[:, 2])[0, 1] < -0.99 and abs(np.corrcoef(got[:, 1], got[:, 3])[0, 1]) < 0.08
    assert len({tuple(g) for g in got.tolist()}) > 2990
    assert (mixing.drawn(np.random.default_rng(1), counts, int(whole)) == counts).all() and mixing.drawn(np.random.default_rng(1), counts, 0).sum() == 0


def test_large_mixes_differ_by_seed():
    a, b = (Plan(("a", "b"), (3 * 10**9, 10**9), (10**10, 10**10), 1000, seed) for seed in (3, 4))
    assert tuple(_node(a, 0, 2**21)[0]) != tuple(_node(b, 0, 2**21)[0])


def test_plan_limits():
    assert plan(["a", "b"], [0.5, 0.5], [1, 3], [1000, 200], 10, 8, 1).slots == (60, 60)
    assert plan(["a", "b", "z"], [0.5, 0.3, 0.2], [1, 3, 1], [1000, 200, 0], 10, 8, 1).slots == (100, 60, 0)
    assert plan(["a"], [1.0], [2], [95], 10, 8, 1, total=50).slots == (5,)
    assert plan([], [], [], [], 10, 8, 1).shards == 0


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 7)
    docs = [(i, f"text {i} " + "word " * (i % 40), "abc"[i % 3], "x", 1) for i in range(120)]
    docs += [(500, None, "a", "x", 1), (501, "", "b", "x", 1), (502, "no source", None, "x", 1), (503, "unwanted", "q", "x", 1), (1, "again", "b", "x", 1), (1, "again", "b", "x", 1)]
    df = spark.createDataFrame(docs, "id long, text string, source string, tokens string, n int")
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.25, 1), ("c", 0.25, 2), ("none", 0.0, 2), (None, 0.1, 1)], "source string, target_share double, max_repeat int")
    m = Mix(df, targets, "id", block=16, shard_slots=8, seed=11)
    blocks = m.blocks().collect()
    encoder = mixing._encoder(mixing.VOCABULARY, mixing.PATTERN)
    want = Counter()
    for _, t, s, *_ in docs:
        if t and s in ("a", "b", "c"):
            want.update((s, x) for x in [*encoder.encode_ordinary(t), mixing.END_OF_TEXT])
    assert Counter((b.source, t) for b in blocks for t in b.tokens) == want
    assert all(b.size == len(b.tokens) and (b.size == 16 or b.block == m.plan.blocks[m.plan.sources.index(b.source)] - 1) for b in blocks)
    mixed = m.mixed().collect()
    assert len(mixed) == sum(m.plan.slots) == len({(r.shard, r.slot) for r in mixed})
    uses = Counter((r.source, r.block) for r in mixed)
    assert all(n <= {"a": 3, "b": 1, "c": 2}[s] for (s, _), n in uses.items())
    shares = {r.source: r for r in m.shares().collect()}
    total = sum(r.size for r in mixed)
    for s, goal in (("a", 0.5), ("b", 0.25), ("c", 0.25)):
        used = sum(r.size for r in mixed if r.source == s)
        assert shares[s].tokens_used == used and shares[s].actual_share == pytest.approx(used / total) and abs(used / total - goal) < 0.01
        assert shares[s].most_uses == max(n for (x, _), n in uses.items() if x == s)
    assert shares["none"].tokens_used == 0
    counted = Mix(df, targets, "id", block=16, shard_slots=8, seed=11, counts_only=True)
    assert sorted(counted.shares().collect()) == sorted(shares.values())
    assert sorted((r.shard, r.slot, r.source, r.block) for r in Mix(df.repartition(5), targets, "id", block=16, shard_slots=8, seed=11).mixed().collect()) == sorted(
        (r.shard, r.slot, r.source, r.block) for r in mixed
    )
    assert Mix(df.filter("1=0"), targets, "id").mixed().count() == 0
    assert Mix(df, targets.filter("1=0"), "id").mixed().count() == 0
