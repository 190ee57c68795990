import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm.mixing import EXACT_BUDGET, Mix, exact_fit, fit_source, source_key
from quern.llm.packing import best_fit, document_places, pack


def _check(places, items, capacity):
    bins, given = defaultdict(list), defaultdict(list)
    for r in places:
        bins[r.bin].append((r.offset, r.size))
        given[r.id].append((r.part, r.start, r.size))
        assert r.fill <= capacity
    for held in bins.values():
        end = 0
        for offset, size in sorted(held):  # places follow each other without a gap or an overlap
            assert offset == end
            end += size
    assert all(sum(s for _, s in bins[r.bin]) == r.fill for r in places)
    wanted = defaultdict(list)
    for i, size in items:
        size = size or 0
        wanted[i] += [(p, p * capacity, min(capacity, size - p * capacity)) for p in range(max(-(-size // capacity), 1))]
    assert {i: sorted(p) for i, p in given.items()} == {i: sorted(p) for i, p in wanted.items()}
    return len(bins)


@pytest.mark.parametrize("block, partitions", [(1 << 16, 1), (50, 7), (7, 12), (1, 3)])
def test_every_piece_has_one_place(spark, block, partitions):
    rng = random.Random(block)
    items = [(i, rng.choice([0, 1, 5, 60, 99, 100, 101, 350, None, rng.randint(1, 120)])) for i in range(700)] + [(3, 40), (3, 40), (None, 10)]
    df = spark.createDataFrame(items, "id long, size long").withColumn("bin", F.lit(1)).repartition(partitions)
    n = _check(pack(df, 100, block, 3).collect(), items, 100)
    if block >= 50:  # hardly more than one best fit over all pieces would take
        cut = [min(100, s - at) for _, s in items for at in range(0, max(s or 0, 1), 100) if s]
        assert n <= len(best_fit(np.array(cut), 100)[2]) * 1.02 + 2


def test_big_halves_cannot_be_merged(spark):
    items = [(i, 60) for i in range(300)]
    assert _check(pack(spark.createDataFrame(items, "id long, size long").repartition(9), 100, 20, 2).collect(), items, 100) == 300
    assert pack(spark.createDataFrame([], "id long, size long"), 100).count() == 0
    assert _check(pack(spark.createDataFrame([(1, 0), (2, 0)], "id long, size long"), 100).collect(), [(1, 0), (2, 0)], 100) == 1


def test_best_fit_prefers_the_tightest_bin():
    bin_of, offset, fill = best_fit(np.array([60, 50, 40, 45, 5]), 100)
    assert fill.tolist() == [100, 100] and bin_of.tolist() == [0, 1, 0, 1, 1] and offset.tolist() == [0, 0, 60, 50, 95]


def test_documents(spark):
    df = spark.createDataFrame([(1, "a b, c!"), (2, None), (3, ""), (4, "x " * 2500)], "doc_id long, text string")
    got = sorted((r.doc_id, r.part, r.size) for r in document_places(df).collect())
    assert got == [(1, 0, 5), (2, 0, 0), (3, 0, 0), (4, 0, 1024), (4, 1, 1024), (4, 2, 452)]


def test_exact_fit_against_all_choices():
    rng = random.Random(1)
    for _ in range(200):
        lengths = [rng.randint(0, 12) for _ in range(rng.randint(0, 5))]
        counts, budget = [rng.randint(0, 4) for _ in lengths], rng.randint(0, 60)
        sums = {0}
        for length, n in zip(lengths, counts):
            sums = {s + k * length for s in sums for k in range(n + 1)}
        take, total = exact_fit(lengths, counts, budget)
        assert total == max(s for s in sums if s <= budget) == sum(t * x for t, x in zip(take, lengths))
        assert all(0 <= t <= n for t, n in zip(take, counts))


def _sums(lengths, counts, most=1):
    sums = {0}
    for length, n in zip(lengths, counts):
        sums = {s + k * length for s in sums for k in range(n * most + 1)}
    return sums


def _total(lengths, draws):
    return sum(a * b for a, b in zip(lengths, draws))


def test_fit_source():
    assert fit_source([10, 20], [3, 1], 50, 2, 0) == [3, 1]
    assert fit_source([10, 20], [3, 1], 10**9, 2, 0) == [6, 2]
    assert fit_source([], [], 10, 3, 0) == [] and fit_source([0], [5], 10, 3, 0) == [0]
    assert _total([7, 11, 13], fit_source([7, 11, 13], [10**6, 10**6, 10**6], 20_000_003, 5, 1)) == 20_000_003
    lengths, counts = list(range(1, 3000)), [1] * 2999
    assert _total(lengths, fit_source(lengths, counts, 4_000_001, 1, 2)) == 4_000_001 > EXACT_BUDGET


def test_few_documents_with_repeats_against_all_choices():
    rng = random.Random(8)
    for seed in range(300):
        lengths = sorted(rng.sample(range(2, 90), rng.randint(1, 5)))
        counts, most = [rng.randint(0, 3) for _ in lengths], rng.randint(0, 5)
        budget = rng.randint(0, _total(lengths, counts) * (most + 1) + 5)
        draws = fit_source(lengths, counts, budget, most, seed)
        assert all(0 <= d <= n * most for d, n in zip(draws, counts))
        assert _total(lengths, draws) == max(s for s in _sums(lengths, counts, most) if s <= budget)
    # Neither two passes nor three meet it; a document drawn four times and one not at all do.
    assert _total([100, 31], fit_source([100, 31], [1, 1], 400, 4, 0)) == 400


def test_fit_source_with_long_documents():
    assert fit_source([120_000, 10], [3, 2000], 270_000, 1, 0) == [2, 2000]
    rng = random.Random(3)
    for seed in range(120):  # few long documents: against all choices
        lengths = sorted(rng.sample(range(100_001, 400_000), rng.randint(1, 4))) + [rng.randint(1, 99), 7001]
        counts = [rng.randint(1, 3) for _ in lengths[:-2]] + [rng.randint(0, 300), rng.randint(0, 3)]
        budget = rng.randint(1, _total(lengths, counts) - 1)
        take = fit_source(lengths, counts, budget, 1, seed)
        assert all(0 <= t <= n for t, n in zip(take, counts))
        assert _total(lengths, take) == max(s for s in _sums(lengths, counts) if s <= budget)


def test_fit_source_beyond_the_wide_budget():
    for lengths, counts in (([120_011, 150_001, 10], [300, 200, 2000]), ([6_000_000, 9_000_001], [3, 2])):
        budget = _total(lengths, counts) * 2 // 3
        take = fit_source(lengths, counts, budget, 1, 0)
        assert all(0 <= t <= n for t, n in zip(take, counts)) and 0 <= budget - _total(lengths, take) < max(lengths)


def test_a_hot_length_is_dealt_exactly(spark):
    df = spark.range(4000).select("id", F.lit("a").alias("source"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 7).cast("bigint").alias("size"))
    targets = spark.createDataFrame([("a", 0.61803, 3)], "source string, weight double, max_repeats int")
    mix = Mix(df.repartition(6), targets)
    draws = mix.draws().collect()
    by = defaultdict(int)
    for r in draws:
        by[r["size"]] += r.draws
    assert {r["size"]: r.draws for r in mix.fitted.collect() if r.draws} == dict(by) and len({r.id for r in draws}) == len(draws)
    assert sum(k * n for k, n in by.items()) == mix.targets[0][4] and max(r.draws for r in draws) == 1


def test_mix_meets_its_budgets(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice("aaaab"), rng.randint(0, 40)) for i in range(3000)] + [(5000, "c", 7), (5001, None, 9), (5002, "zz", 9), (None, "a", 3), (7, "a", None), (7, "a", 7)]
    df = spark.createDataFrame(docs, "id long, source string, size long").withColumn("draws", F.lit(1)).repartition(5)
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.4, 3), ("c", 0.1, 2), ("d", 0.2, 5), (None, 1.0, 1)], "source string, weight double, max_repeats int")
    mix = Mix(df, targets)
    shares = {r.source: r for r in mix.shares().collect()}
    total = sum(s or 0 for _, k, s in docs if k in ("a", "b", "c"))
    assert {k for k, r in shares.items() if r.short} == {"c", "d"} and shares["c"].drawn == 14 and shares["d"].drawn == 0
    for k in "ab":
        assert shares[k].drawn == shares[k].budget == round(shares[k].weight * total)
    assert abs(sum(r.mix_share for r in shares.values()) - 1) < 1e-9
    draws = mix.draws().collect()
    assert all(1 <= r.draws <= {"a": 1, "b": 3, "c": 2}[r.source] for r in draws)
    assert sorted(map(tuple, draws), key=str) == sorted(map(tuple, Mix(df, targets).draws().collect()), key=str)
    assert sorted(map(tuple, draws), key=str) != sorted(map(tuple, Mix(df, targets, seed=1).draws().collect()), key=str)
    nothing = Mix(df.limit(0), targets)
    assert nothing.draws().count() == 0 and not any(r.short for r in nothing.shares().collect())


def test_source_key(spark):
    df = spark.createDataFrame([(" Readme\t",), (None,)], "s string")
    assert [r[0] for r in df.select(source_key(F.col("s"))).collect()] == ["readme", None]
