import json
import random

import numpy as np
import pyarrow as pa

from quern.operators import json_index as J
from quern.operators.nested import Rule, flatten_json, parse
from quern.plans import catalog_json as C

GOOD = ['{"a":[1,2,{"b":"c\\"d\\\\"}],"é":"ü\\u00e9"}', "[]", "{}", '"x"', "1", "-0.5e+3", "null", " true ", "[[[]],{}]", '{"a":{"b":{"c":[null,false]}}}', '"\\ud83d\\ude00"', "[1]\n"]
BAD = ["", " ", "[1,]", '{"a"}', '{"a":1,}', "01", "1.", "nul", '{"a":1}}', "[}", '"\\x"', '"\\u12g4"', '"a\tb"', '{"a" "b"}', "[1 2]", "{1:2}", '"abc', '\\"', '"a"b', "NaN", "{,}", "[,1]", ":", ",", '{"a"::1}', '{"a":1 "b":2}', '["a":1]', '"\\', "1 2", '"" ""', "-", "+1", ".5", "﻿{}", "tru e", '{"a":1]']


def _index(texts):
    return J.build(*J.text_buffers(pa.array(texts, pa.string())))


def _values(ix):
    told = J.strings(ix, ix.start, ix.end, ix.kind == J.STR).to_pylist()
    keys = J.strings(ix, ix.key_start, ix.key_end).to_pylist()
    made, roots = [], {}
    for i in range(len(ix.row)):
        kind, up = ix.kind[i], ix.parent[i]
        made.append({} if kind == J.OBJ else [] if kind == J.ARR else told[i] if kind == J.STR else json.loads(told[i]))
        if up < 0:
            roots[int(ix.row[i])] = made[i]
        elif ix.kind[up] == J.OBJ:
            made[up][keys[i]] = made[i]
        else:
            made[up].append(made[i])
    return roots


def test_validity_and_values():
    ix = _index(GOOD + BAD)
    assert ix.valid.tolist() == [True] * len(GOOD) + [False] * len(BAD)
    assert _values(ix) == {i: json.loads(t) for i, t in enumerate(GOOD)}
    for text in GOOD + BAD:  # alone, no other text can help or harm
        assert _index([text]).valid.tolist() == [text in GOOD]
    assert len(_index([]).valid) == 0 and not _index(["", None]).valid.any()


def test_random_texts_against_the_decoder():
    rng = random.Random(3)
    alphabet = list('{}[]:,"\\ ') + ["1", "0", "-", ".", "e", "true", "null", '"a"', '"b"', '\\"', "\\u0041", "\n", "é"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 10))) for _ in range(30_000)]
    for text in GOOD:
        for _ in range(200):
            i = rng.randrange(len(text) + 1)
            texts.append(text[:i] + rng.choice(alphabet) + text[i + rng.randint(0, 2) :])

    def valid(text):
        try:
            json.loads(text, parse_constant=lambda _: (_ for _ in ()).throw(ValueError()))
            return True
        except ValueError:
            return False

    ix = _index(texts)
    expected = np.array([valid(t) for t in texts])
    assert (ix.valid == expected).all()
    roots = _values(ix)
    whole = [i for i in np.flatnonzero(expected) if not any("\ud800" <= c <= "\udfff" for c in str(json.loads(texts[i])))]
    assert all(roots[i] == json.loads(texts[i]) for i in whole)


def test_half_a_surrogate_pair_is_no_character():
    assert _values(_index(['"a\\ud83d b"'])) == {0: "a\ufffd b"}


def test_deep_and_long():
    deep, long = "[" * 3000 + "]" * 3000, json.dumps({"x": "y" * 5_000_000, "z": [1, 2]})
    ix = _index([deep, long, "[" * 3000])
    assert ix.valid.tolist() == [True, True, False] and ix.level.max() == 2999


def test_rows_link_to_their_parents(spark):
    text = json.dumps({"items": [{"login": "a", "weeks": [{"w": "1", "c": 2}, {"w": "2"}]}, {"login": "b"}]})
    df = spark.createDataFrame([(7, text), (8, json.dumps(text)), (9, None), (10, "{"), (None, text), (11, '{"items":[{"login":"x","login":"y"}]}')], "seq long, contributors_json string")
    rows = flatten_json(df.selectExpr("*", "1 AS node", "2 AS child"), "seq", "contributors_json", C.CONTRIBUTORS).collect()
    people = {(r.record_id, r.node): r.login for r in rows if r.child == "contributor"}
    weeks = [r for r in rows if r.child == "week"]
    assert sorted((r[0] or 0) for r in people) == [0, 0, 7, 7, 8, 8, 11]
    assert {v for k, v in people.items() if k[0] == 11} == {"y"}
    assert all(people[r.record_id, r.parent_node] == r.login for r in weeks) and len(weeks) == 6
    assert [(r.login, r.w, r.c) for r in weeks if r.record_id == 7] == [("a", "1", "2"), ("a", "2", None)]


def test_every_shape_of_languages(spark):
    shapes = {
        1: '{"A": 1, "B": null}', 2: '[{"name":"A","bytes":1},{"name":"B"},{"bytes":2},null]', 3: '{"edges":[{"size":1,"node":{"name":"A"}},{"node":{"name":"B"}},{"size":3,"node":null},null]}',
        4: '{"data":{"r0":{"languages":{"edges":[{"node":{"name":"A"}},{"node":{"name":"B","color":"#1"}}]}},"r1":null}}', 5: json.dumps('{"A":1,"B":2}'), 6: "null", 7: "[]", 8: '{"": 1, " ": 2}', 9: '{"A":', 10: json.dumps("not json"),
    }
    df = spark.createDataFrame(list(shapes.items()), "seq long, languages_json string")
    got = {}
    for r in C.languages(df).collect():
        got.setdefault(r.seq, set()).add(r.language)
    assert got == {i: {"A", "B"} for i in range(1, 6)}


def test_found_against_plain_parsing(spark):
    base = "/root/testdata/sf0.001"
    repos, items = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("repos", "star_items"))
    got = {tuple(r) for r in C.found(repos, items).collect()}
    owners = set()
    for r in items.select("payload").collect():
        ok, v = parse(r.payload)
        repo = v.get("repo") if ok and isinstance(v, dict) else None
        login = (repo.get("owner") or {}).get("login") if isinstance(repo, dict) else None
        if login and login.strip():
            owners.add(("owner", repo["id"], login))
    assert {g for g in got if g[0] == "owner"} == owners
    assert C.found(repos.limit(0), items.limit(0)).count() == 0


def test_rules_without_fields_in_common(spark):
    rules = [Rule("a", ("x",), {"p": ("@value",)}), Rule("b", ("y", "[*]"), {"q": ("@value",)})]
    df = spark.createDataFrame([(1, '{"x": true, "y": [1.5, {"k": 2}, null]}')], "id long, t string")
    got = sorted((r.child, r.p, r.q) for r in flatten_json(df, "id", "t", rules).collect())
    assert got == [("a", "true", None), ("b", None, "1.5"), ("b", None, '{"k": 2}')]


def test_the_key_of_the_record_comes_along(spark):
    import datetime as dt

    from quern.plans import catalog_json

    at = dt.datetime(2026, 1, 1)
    text = '{"repo":{"id":5,"owner":{"login":"x","id":1}}}'
    rows = [(1, 0, 1, 1, at, text, "clash"), (1, 0, 1, 1, None, text, "clash"), (1, 0, 1, 2, at, '{"repo":{"owner":{"login":" "}}}', None), (1, 0, 1, 3, at, "{", None), (1, 0, 1, 4, at, None, None)]
    df = spark.createDataFrame(rows, "snapshot_no int, slice_no int, page int, pos int, received_at timestamp, payload string, node string")
    got = [tuple(r) for r in catalog_json.owners(df.repartition(2)).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, 1, 1, at, 1, 5, "x", 1, None), (1, 0, 1, 1, None, 1, 5, "x", 1, None)], key=str)
    assert catalog_json.owners(df.limit(0)).count() == 0
