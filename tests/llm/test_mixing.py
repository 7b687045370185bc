import os

import pytest

from caskwise.llm import mixing as M


def test_plan_keeps_caps_and_shares():
    got = M.plan({"a": 1000, "b": 100, "c": 50}, {"a": (0.5, 1), "b": (0.3, 4), "c": (0.1, 9), "none": (0.1, 2)})
    tokens = {s: n * t + rest for (s, (n, rest)), t in zip(got.items(), (1000, 100, 50), strict=True)}
    size = sum(tokens.values())
    assert tokens["b"] == 400
    assert tokens["a"] / size == pytest.approx(0.5 / 0.9, abs=0.01)
    assert M.plan({}, {"a": (1.0, 1)}) == {}
    assert M.plan({"a": 10}, {"a": (0.0, 1)}) == {}


def test_splitting_tree_is_exact_and_even():
    import numpy as np

    counts = M.split_tree([1000, 37, 0, 5], 13, 3)
    assert counts.sum(axis=0).tolist() == [1000, 37, 0, 5]
    assert counts.min() >= 0
    assert np.ptp(counts.sum(axis=1)) <= 4
    assert (counts == M.split_tree([1000, 37, 0, 5], 13, 3)).all()
    assert M.split_tree([3], 0, 1).shape == (0, 1)


def test_splitting_tree_beyond_exact_draws():
    blocks = [2_000_000_000, 300_000_000, 7, 0]
    counts = M.split_tree(blocks, 8, 3)
    assert counts.sum(axis=0).tolist() == blocks
    assert counts.min() >= 0
    assert abs(counts.sum(axis=1) - sum(blocks) / 8).max() <= 3
    assert abs(counts[:, 0] / 2e9 - 1 / 8).max() < 1e-3


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(k, "word " * (k % 7 + 1), "abc"[k % 10 // 5 + (k % 10 > 8)]) for k in range(3000)]
    return spark.createDataFrame([*rows, (5000, None, "a"), (5001, "", "a"), (5002, "x y", None), (5003, "x y", "unlisted"), (None, "x", "a")], "doc_id bigint, text string, source string")


WEIGHTS = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.15, 3), ("gone", 0.05, 4)]


@pytest.mark.skipif(not os.path.exists(M.TOKENIZER), reason="no tokenizer")
def test_mix(spark, corpus):
    w = spark.createDataFrame(WEIGHTS, "source string, target_share double, max_repeats bigint")
    mix = M.mixed(spark, corpus, w)
    got = mix.collect()
    caps = {s: c for s, _, c in WEIGHTS}
    assert all(1 <= r["repeats"] <= caps[r["source"]] for r in got)
    assert len({r["doc_id"] for r in got}) == len(got)
    assert not {r["doc_id"] for r in got} & {5000, 5001, 5002, 5003, None}
    tokens: dict[str, int] = {}
    for r in got:
        tokens[r["source"]] = tokens.get(r["source"], 0) + r["repeats"] * r["n_tokens"]
    size = sum(tokens.values())
    for s, share, _ in WEIGHTS[:3]:
        assert tokens[s] / size == pytest.approx(share / 0.95, abs=8 / size)
    report = {r["source"]: r for r in M.shares(spark, mix, w).collect()}
    assert report["gone"]["tokens"] == 0
    assert report["a"]["tokens"] == tokens["a"]
    assert report["a"]["reached_share"] == pytest.approx(tokens["a"] / size)
    placed = M.sharded(spark, mix, shards=5).collect()
    assert len(placed) == sum(r["repeats"] for r in got)
    assert len({(r["doc_id"], r["copy"]) for r in placed}) == len(placed)
    assert {r["shard"] for r in placed} == set(range(5))
    # every shard holds the blocks of each source that the tree gives it; only a source's last block may be short
    copies = {s: sum(r["repeats"] for r in got if r["source"] == s) for s in caps}
    quotas = M.split_tree([-(-copies[s] // M.BLOCK) for s in "abc"], 5, 7)
    for k, s in enumerate("abc"):
        held = [sum(r["shard"] == i and r["source"] == s for r in placed) for i in range(5)]
        assert sum(q * M.BLOCK - h for q, h in zip(quotas[:, k], held, strict=True)) == -copies[s] % M.BLOCK
        assert all(0 <= q * M.BLOCK - h < M.BLOCK for q, h in zip(quotas[:, k], held, strict=True))
    drawn = M.drawn(spark, mix, shards=5).collect()
    assert all(len(r["shards"]) == r["repeats"] for r in drawn)
    assert sorted(map(tuple, M.mixed(spark, corpus.repartition(7), w).collect())) == sorted(map(tuple, got))


def test_running_sums_over_buckets(spark):
    docs = [(k, "ab"[k % 3 == 0], k % 5 + 1, (k * 7919 % 1000 - 500) << 54) for k in range(200)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint, h bigint")
    for bucket in (1000, 10):
        got = {r["doc_id"]: (r["rank"], r["before"]) for r in M.running(df, 140, bucket).collect()}
        for d, s, _, h in docs:
            earlier = [n for e, t, n, g in docs if t == s and (g, e) < (h, d)]
            assert got[d] == (len(earlier), sum(earlier))


@pytest.mark.skipif(not os.path.exists(M.TOKENIZER), reason="no tokenizer")
def test_empty(spark, corpus):
    w = spark.createDataFrame(WEIGHTS, "source string, target_share double, max_repeats bigint")
    assert M.mixed(spark, corpus.limit(0), w).count() == 0
    assert M.mixed(spark, corpus, w.limit(0)).count() == 0
