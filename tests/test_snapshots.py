import random

import pytest
from pyspark.sql import functions as F

from quern.operators.snapshot_diff import diff_snapshots
from quern.plans import catalog_snapshots as S


def _diff(spark, rows, versions, **how):
    df = spark.createDataFrame(rows, "v int, k long, c string, s int").withColumn("key", F.lit("clash")).withColumn("version", F.lit(0))
    return {tuple(r) for r in diff_snapshots(df, "v", "k", F.col("c"), "s", versions, **how).collect()}


@pytest.mark.parametrize("chunk_rows, limit", [(4, 1 << 20), (1, 8), (1000, 8), (1000, 1 << 20)])
def test_against_plain_sets(spark, chunk_rows, limit):
    rng, state, rows, expected = random.Random(chunk_rows), {}, [], set()
    for version in (1, 2, 4, 5):
        before = dict(state)
        if version > 1:
            for k in rng.sample(sorted(state), 20):
                del state[k]
        for k in rng.sample(range(-500, 500), 60):
            state[k] = rng.choice(["x", "y", None])
        rows += [(version, k, c, version * 10) for k, c in state.items()]
        if version > 1:
            old = {2: 1, 4: 2, 5: 4}[version]
            expected |= {(version, k, "added", version * 10) for k in state.keys() - before.keys()}
            expected |= {(version, k, "removed", old * 10) for k in before.keys() - state.keys()}
            expected |= {(version, k, "changed", version * 10) for k in state.keys() & before.keys() if state[k] != before[k]}
    assert _diff(spark, rows, [1, 2, 4, 5], chunk_rows=chunk_rows, limit=limit) == expected


def test_edges(spark):
    assert _diff(spark, [], [1, 2]) == set() and _diff(spark, [(1, 1, "a", 0)], [1]) == set()
    assert _diff(spark, [(1, 1, "a", 0), (None, 2, "a", 0), (1, None, "a", 0)], [1, 2]) == {(2, 1, "removed", 0)}
    same = [(v, k, "a", 0) for v in (1, 2) for k in range(50)]
    assert _diff(spark, same, [1, 2]) == set()
    assert _diff(spark, [(1, 1, None, 0), (2, 1, "", 0)], [1, 2]) == {(2, 1, "changed", 0)}


def test_payloads(spark):
    def item(text, snapshot=1, page=1, pos=1):
        return (snapshot, 0, page, pos, None, text)

    rows = [
        item('{"starred_at":"2024-01-01T00:00:00.9Z","repo":{"id":1,"full_name":"a/b","topics":["x","y","x"]}}'),
        item('{"repo":{"topics":["y","x"],"full_name":"a/b","id":1,"fork":false,"archived":null},"starred_at":"2024-01-01T01:00:00+01:00"}', 2),
        item('{"repo":{"id":2}}'), item('{"repo":{"id":2,"full_name":"late"}}', page=2), item('{"repo":{"id":2,"full_name":"late"}}', 2),
        item('{"repo":{"id":3}}'), item('{"repo":{"id":3}} trailing', 2), item('{"repo":{"id":4}}'), item('{"repo":{"id":4', 2),
        item('{"repo":{"id":5},"starred_at":"yesterday"}'), item('{"repo":{"id":5}}', 2), item(None), item("", 2), item('{"repo":null}', 2), item("{'repo':{'id':6}}"), item('{"repo":{"id":7,"x":NaN}}'), item('{"repo":{"id":"x"}}', 2),
    ]
    df = spark.createDataFrame(rows, "snapshot_no int, slice_no int, page int, pos int, received_at timestamp, payload string")
    assert {tuple(r)[:3] for r in S.changes(df).collect()} == {(2, 3, "removed"), (2, 4, "removed")}
    runs = spark.createDataFrame([(1, 0, None), (2, 0, 2), (2, 1, 5)], "snapshot_no int, slice_no int, removed long")
    assert {tuple(r) for r in S.removed_counts(df, runs).collect()} == {(2, 0, 2, 2, True), (2, 1, 0, 5, False)}
    assert S.changes(df.limit(0)).count() == 0
