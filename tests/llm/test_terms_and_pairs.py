import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.llm import repo_names
from quern.llm.cooccurrence import at_least, cooccurring
from quern.llm.set_join import expand, expand_between, links, links_between, similar_sets
from quern.llm.term_frequency import heavy_terms, mark_terms, repo_terms, term_counts


@pytest.mark.parametrize("share", [2, 512])
def test_counts_against_plain_ones(spark, share):
    rng = random.Random(share)
    words = ["hot", "warm", "", "a:b", "é", "x" * 1000] + [f"w{i}" for i in range(200)]
    rows = [(rng.choices(words, [60, 20, 2, 2, 2, 30] + [1] * 200, k=rng.randint(0, 8)) + [None] * (rng.random() < 0.2), rng.choice(words + [None])) for _ in range(500)]
    rows += [(None, None), (["hot"] * 5000, "hot")]
    df = spark.createDataFrame(rows, "a array<string>, b string").withColumn("term", F.lit(1)).repartition(3)
    got = {tuple(r) for r in term_counts(df, {"f": F.col("a"), "g": F.array("b")}, share=share).collect()}
    occurrences, records = Counter(), Counter()
    for a, b in rows:
        held = [("f", x) for x in a or [] if x is not None] + ([("g", b)] if b is not None else [])
        occurrences.update(held)
        records.update(set(held))
    assert got == {(*t, n, records[t]) for t, n in occurrences.items()}
    assert set(heavy_terms(df, {"f": F.col("a")}, 2)) == {"0:hot"}
    assert term_counts(df.limit(0), {"f": F.col("a")}).count() == 0


def test_marks(spark):
    counts = spark.createDataFrame([("f", "a", 9, 2), ("f", "b", 9, 3), ("f", "c", 9, 10), ("f", "d", 9, 11)], "field string, term string, occurrences long, records long")
    assert [r.mark for r in mark_terms(counts, 100).orderBy("term").collect()] == ["too_rare", None, None, "too_common"]


REPO = "id long, seq long, synced_at timestamp, topics array<string>, tags array<struct<name:string,source:string,confidence:float>>, groups array<string>, primary_language string"


def test_only_the_current_row_counts(spark):
    t = [("Old Name", "ai", 1.0)]
    rows = [(1, 1, None, None, t, None, "A"), (1, 2, None, ["x"], [(" new  Name ", "ai", 1.0), None, (None, "ai", 0.5), ("  ", "ai", 0.5)], [None], "Éa"), (1, 2, None, ["x"], [(" new  Name ", "ai", 1.0), None, (None, "ai", 0.5), ("  ", "ai", 0.5)], [None], "Éa"), (None, 3, None, ["y"], t, None, "B"), (2, 4, None, None, None, None, None)]
    df = spark.createDataFrame(rows, REPO)
    got = {(r.field, r.term, r.occurrences, r.repos) for r in repo_terms(df).collect()}
    assert got == {("tag", "new-name", 1, 1), ("language", "éa", 1, 1)}
    assert repo_names.count_current(df) == 2 and repo_terms(df.limit(0)).count() == 0


@pytest.mark.parametrize("block, most_bytes, min_item", [(128, 1 << 20, 1), (3, 1 << 20, 1), (3, 1 << 20, 4), (128, 20, 4), (3, 20, 4), (3, 20, 1)])
def test_pairs_against_plain_ones(spark, block, most_bytes, min_item):
    rng = random.Random(block)
    baskets = [sorted(rng.sample([f"i{k}" for k in range(40)] + ["é", "z z"], rng.randint(0, 14))) for _ in range(120)] + [[], None]
    baskets += baskets[:9]  # equal baskets
    df = spark.createDataFrame([(b, 1) for b in baskets], "items array<string>, a int").repartition(3)
    single, joint = Counter(), Counter()
    for b in baskets:
        single.update(b or [])
        joint.update(itertools.combinations(b or [], 2))
    got = {(r.item_a, r.item_b): (r.n_a, r.n_b, r.n_ab, round(r.lift, 9)) for r in cooccurring(df, len(baskets), min_item, 1, block, most_bytes).collect()}
    assert got == {p: (single[p[0]], single[p[1]], n, round(n * len(baskets) / (single[p[0]] * single[p[1]]), 9)) for p, n in joint.items() if min(single[p[0]], single[p[1]]) >= min_item}
    assert cooccurring(df.limit(0), 0).count() == 0 and at_least(5, 1000, 1001) == 6


@pytest.mark.parametrize("most_bytes", [1 << 20, 20])
def test_rare_items_leave_before_pairs_are_made(spark, most_bytes, monkeypatch):
    from quern.llm import cooccurrence

    made = []
    real = cooccurrence._pairs
    monkeypatch.setattr(cooccurrence, "_pairs", lambda baskets, block: made.append(real(baskets, block).count()) or real(baskets, block))
    df = spark.createDataFrame([(["a", "b", *sorted(f"r{i}-{k}" for k in range(9))],) for i in range(20)], "items array<string>")
    (pair,) = cooccurring(df, 20, 5, 1, broadcast_bytes=most_bytes).collect()
    assert (pair.item_a, pair.item_b, pair.n_ab) == ("a", "b", 20) and made[0] <= 20


def _jaccard_at_least(x, y, num=8, den=10):
    return len(x & y) * den >= len(x | y) * num


@pytest.mark.parametrize("hot_least, block_rows", [(1, 3), (4096, 4096)])
def test_similar_sets_against_all_pairs(spark, hot_least, block_rows, monkeypatch):
    for name, before in (("classes_of", ()), ("similar_classes", (False,)), ("expand", ()), ("links", ())):
        monkeypatch.setattr(f"quern.llm.set_join.{name}.__defaults__", (*before, hot_least, block_rows))
    rng = random.Random(hot_least)
    base = [rng.sample([f"t{i}" for i in range(60)], rng.randint(3, 14)) for _ in range(60)]
    sets = {}
    for i in range(300):
        s = set(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            s ^= {rng.choice(["t1", "t2", "t3", "n" + str(i)])}
        sets[i] = s
    rows = [(i, list(s) + list(s)[:1] + [None], "x") for i, s in sets.items()] + [(1000, None, "x"), (1001, [], "x"), (None, list(sets[0]), "x")]
    df = spark.createDataFrame(rows, "id long, tokens array<string>, side string")
    members, pairs = similar_sets(df, "0.8", 4)
    expected = {(a, b) for a, b in itertools.combinations(sets, 2) if min(len(sets[a]), len(sets[b])) >= 4 and _jaccard_at_least(sets[a], sets[b])}
    found = [tuple(r) for r in expand(members, pairs).collect()]
    assert len(found) == len(set(found)) and set(found) == expected
    degree = Counter(x for p in expected for x in p)
    told = {r.id: (r.class_id, r.copies, r.links) for r in links(members, pairs).collect()}
    assert {i: degree[i] for i in told} == {i: t[2] for i, t in told.items()} and set(told) == {i for i, s in sets.items() if len(s) >= 4}
    assert all(told[i][0] == min(j for j in told if sets[j] == sets[i]) for i in told)


def test_between_two_tables(spark):
    left = spark.createDataFrame([(1, list("abcde")), (2, list("vwxyz"))], "id long, tokens array<string>")
    right = spark.createDataFrame([(1, list("abcde")), (5, list("abcdf")), (6, list("vwxy")), (7, list("vwxyz!"))], "id long, tokens array<string>")
    members, pairs = similar_sets(left, "0.8", 1, right)
    side = {(r.side, r.id): tuple(r["class"]) for r in members.collect()}
    assert {(tuple(r.class_a), tuple(r.class_b)) for r in pairs.collect()} == {((0, 2), (1, 6)), ((0, 2), (1, 7))}
    assert side[0, 1] == side[1, 1] == (0, 1)
    empty = similar_sets(left.limit(0), "0.8", 1)
    assert empty[0].count() == 0 and empty[1].count() == 0


def test_records_between_two_tables(spark):
    rng = random.Random(5)
    base = [rng.sample([f"t{i}" for i in range(40)], rng.randint(5, 12)) for _ in range(12)]
    tables = [{i: set(rng.choice(base)) ^ set(rng.sample(["t1", "t2"], rng.randint(0, 1))) for i in range(60)} for _ in range(2)]
    left, right = (spark.createDataFrame([(i, list(s)) for i, s in t.items()], "id long, tokens array<string>") for t in tables)
    members, pairs = similar_sets(left, "0.8", 1, right)
    expected = {(a, b) for a, x in tables[0].items() for b, y in tables[1].items() if _jaccard_at_least(x, y)}
    found = [tuple(r) for r in expand_between(members, pairs).collect()]
    assert len(found) == len(set(found)) and set(found) == expected and any(a == b for a, b in expected)
    degree = Counter((side, p[side]) for p in expected for side in (0, 1))
    told = {(r.side, r.id): (r.copies, r.links) for r in links_between(members, pairs).collect()}
    assert told == {(side, i): (sum(s == o for o in tables[side].values()), degree[side, i]) for side in (0, 1) for i, s in tables[side].items()}
    none = similar_sets(left.limit(0), "0.8", 1, right)
    assert expand_between(*none).count() == 0 and {r.links for r in links_between(*none).collect()} == {0}
