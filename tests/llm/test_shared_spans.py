import random

import pytest
from pyspark.sql import functions as F

from quern.llm import shared_spans as S


def brute(docs, length):
    holders, covered = {}, {}
    docs = [(d, t) for d, t in docs if d is not None and t is not None]
    for d, t in docs:
        for i in range(len(t) - length + 1):
            holders.setdefault(t[i : i + length], set()).add(d)
    for d, t in docs:
        for i in range(len(t) - length + 1):
            if len(holders[t[i : i + length]]) > 1:
                covered.setdefault(d, set()).add(i)
    out = set()
    for d, starts in covered.items():
        first = last = None
        for i in sorted(starts):
            if first is not None and i > last:
                out.add((d, first, last))
                first = None
            first = i if first is None else first
            last = i + length
        out.add((d, first, last))
    return out


def _docs(length, seed):
    rng, alphabet = random.Random(seed), "abé漢😀 "
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    parts = [text(rng.randint(1, 3 * length)) for _ in range(30)]
    docs = [(d, "".join(rng.choice(parts) if rng.random() < 0.6 else text(rng.randint(0, length)) for _ in range(rng.randint(0, 6)))) for d in range(120)]
    return docs + [(200, "a" * 500), (201, "a" * 300), (202, "b" * 100), (203, None), (None, "a" * 400), (204, ""), (205, docs[3][1]), (3, docs[5][1]), (206, "ab" * 300)]


@pytest.mark.parametrize("length, gram, most, bits, hot, wide", [(20, 8, 8192, None, 10_000, 28), (20, 8, 2, None, 1, 28), (12, 12, 1, 16, 10_000, 28), (5, 9, 8192, None, 1, 28), (20, 8, 8192, 34, 1, 28), (5, 9, 2, 18, 10_000, 0)])
def test_against_all_windows(spark, length, gram, most, bits, hot, wide):
    docs = _docs(length, most) + [(1000 + i, "hot " * length) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("anchor", F.lit(1)).repartition(5)
    assert {tuple(r) for r in S.shared_spans(df, length, gram, bits, most, hot, wide).collect()} == brute(docs, length)


def test_texts_longer_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 300)
    docs = [(d, t) for d, t in _docs(20, 9) if d is not None and t is not None]
    chunked = list(S._chunks(iter([__import__("pyarrow").record_batch({"d": [d for d, _ in docs], "t": [t for _, t in docs]})]), 20))
    windows = {(d, o + i) for texts, ids, offsets in chunked for t, d, o in zip(texts, ids, offsets) for i in range(len(t) - 19)}
    assert windows == {(d, i) for d, t in docs for i in range(len(t) - 19)}


def test_a_full_sketch_loses_nothing():
    import numpy as np

    full = np.full((2 << 16) // 8, 255, np.uint8)
    assert len(S._estimated(np.arange(1000), full, 16)) == 1000


@pytest.mark.parametrize("bits", [16, 20, 40])
def test_both_ways_estimate_the_same_anchors(spark, bits):
    df = spark.createDataFrame([(d, t) for d, t in _docs(20, 7) if d is not None and t is not None and len(t) >= 20], "doc_id long, text string").repartition(3)
    found = S.sketch(df, 20, 8, bits)
    marked = S._marked(df, found, 20, 8)
    by_table = {(r.doc_id, a) for r in marked.collect() for a in r.anchors}
    held = {}
    for r in found.blocks.collect():
        held[r.block] = r.twice
    def told(anchor):
        import numpy as np
        slots = S._slots(np.array([anchor], np.int64), bits)[:, 0].tolist()
        return all(s >> S.BLOCK_BITS in held and held[s >> S.BLOCK_BITS][(s & 65535) >> 3] >> (s & 7) & 1 for s in slots)
    every = {(d, int(a)) for d, t in [tuple(r) for r in df.collect()] for a in S._runs([t], [d], [0], 20, 8).anchor}
    assert by_table == {(d, a) for d, a in every if told(a)} and len(by_table) < len(every)


def test_a_frequent_anchor_is_found_and_dealt_out(spark):
    docs = [(i, "x" * 300 + str(i) * 3) for i in range(200)] + [(i, "".join(chr(97 + (i * 7 + k * k) % 26) for k in range(250))) for i in range(1000, 1010)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert S.sketch(df, 200, 64).hot
    assert {tuple(r) for r in S.shared_spans(df).collect()} == brute(docs, 200)


def test_the_width_follows_the_files(spark, tmp_path):
    spark.range(50).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).write.parquet(str(tmp_path / "t"))
    assert S._width(spark.read.parquet(str(tmp_path / "t")), 200, 64) == S.LEAST_BITS
    big = spark.createDataFrame([(1, "y" * 3_000_000)], "doc_id long, text string")
    assert S._width(big, 200, 64) == ((3_000_000 * 2 // 138 + 1) * 4).bit_length() > S.LEAST_BITS


def test_amounts_and_empty_tables(spark):
    t = "x" * 50 + "y" * 250
    df = spark.createDataFrame([(1, t), (2, t[20:] + "zz"), (3, "short"), (4, None)], "doc_id long, text string")
    assert {tuple(r) for r in S.shared_amounts(df).collect()} == {(1, 300, 1, 280), (2, 282, 1, 280), (3, 5, 0, 0), (4, 0, 0, 0)}
    assert S.shared_spans(df.limit(0)).count() == 0
