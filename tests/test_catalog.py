import datetime as dt
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from quern.functions import display, fuzzy
from quern.functions.fulltext import bm25, index_texts, lengths, phrases, postings, postings_bm25, token_list
from quern.operators import catalog as model
from quern.operators import facets, ordering, predicates, search
from quern.plans.query import SortKey, parse

UTC = dt.timezone.utc
TAGS = "array<struct<name:string,source:string,confidence:float>>"
SCHEMA = f"id long, full_name string, owner string, description string, stargazers long, primary_language string, languages map<string,long>, archived boolean, fork boolean, topics array<string>, tags {TAGS}, groups array<string>, last_commit_at timestamp, starred_at timestamp, synced_at timestamp"


def row(id, full_name, description=None, stars=0, language=None, languages=None, archived=False, fork=False, topics=(), tags=(), groups=(), starred=None, commit=None, synced=None):
    return (id, full_name, full_name.split("/")[0], description, stars, language, languages or {}, archived, fork, list(topics), [(*t, 1.0) for t in tags], list(groups), commit, starred, synced)


@pytest.fixture(scope="module")
def small(spark):
    day = lambda n: dt.datetime(2026, 2, n, tzinfo=UTC)
    return spark.createDataFrame(
        [
            row(1, "helix-editor/helix", "A post-modern modal text editor", 39_000, "Rust", {"Rust": 1000}, topics=["editor", "rust"], starred=day(4)),
            row(2, "sharkdp/bat", "A cat clone with wings", 48_000, "Rust", {"Rust": 1000}, topics=["cli", "rust"], tags=[("CLI", "user")], groups=["Shell"], starred=day(3), commit=day(1)),
            row(3, "BurntSushi/ripgrep", "Recursively search directories", 47_000, "Rust", {"Rust": 900, "Shell": 5}, fork=True, topics=["cli", "search"], starred=day(2)),
            row(4, "zed-industries/zed", "A high-performance code editor", 50_000, None, archived=True, starred=None, commit=day(2)),
        ],
        SCHEMA,
    ).cache()


def ids(df):
    return [r.id for r in df.collect()]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("lang:RUST", {1, 2, 3}), ("lang:shell", {3}), ("-lang:rust", {4}), ("tag:cli", {2, 3}), ("-tag:cli", {1, 4}), ("group:shell", {2}), ("owner:SHARKDP", {2}),
        ("stars:>47500", {2, 4}), ("stars:..47k", {1, 3}), ("is:archived", {4}), ("-is:archived", {1, 2, 3}), ("is:active", {1, 2, 3}), ("-is:active", {1, 2, 3}), ("is:fork lang:rust", {3}), ('lang:""', set()), ("", {1, 2, 3, 4}),
    ],
)
def test_clauses(small, text, expected):
    assert set(ids(small.where(predicates.query_predicate(parse(text))))) == expected


def test_clauses_on_nulls(spark):
    df = spark.createDataFrame([(1, None, None, None, None, None, None, None, None, None, None, None, None, None, None)], SCHEMA)
    for text in ("lang:x", "tag:x", "group:x", "owner:x", "stars:1", "is:archived", "is:fork"):
        clause = parse(text).clauses[0]
        assert ids(df.where(predicates.clause_predicate(clause))) == [] and ids(df.where(~predicates.clause_predicate(clause))) == [1]
    assert ids(df.where(predicates.facet_predicate({"x"}, set()))) == []


def test_ascii_case_only(spark):
    df = spark.createDataFrame([("CAFÉ",), ("café",)], "s string")
    assert [r[0] for r in df.select(predicates.fold(F.col("s"))).collect()] == ["cafÉ", "café"]


def test_facets_pick_tags_not_topics(small):
    assert ids(small.where(predicates.facet_predicate({"cli"}, set()))) == [2]
    assert ids(small.where(predicates.facet_predicate({"cli", "x"}, {"Other"}))) == []
    assert predicates.known_selection({"a", "B"}, small.sparkSession.createDataFrame([("a",), ("b",)], "name string")) == {"a"}


def test_orders_and_ranks(small):
    assert ids(search.search(small, "")) == [1, 2, 3, 4]
    assert ids(search.search(small, "sort:stars")) == [4, 2, 3, 1] and ids(search.search(small, "sort:name")) == [3, 1, 2, 4]
    assert ids(search.search(small, "sort:recent")) == [4, 2, 3, 1] and ids(search.search(small, "", header=SortKey.STARS)) == [4, 2, 3, 1]
    ranked = ordering.with_rank(small.select("id", "full_name", "stargazers").repartition(3), ordering.tie_break())
    assert {r.id: r["rank"] for r in ranked.collect()} == {4: 1, 2: 2, 3: 3, 1: 4}
    assert ordering.with_rank(small.limit(0), ordering.tie_break()).count() == 0
    many = small.sparkSession.range(103).select("id", F.lit("x").alias("full_name"), F.lit(1).alias("stargazers"))
    sizes = [r["count"] for r in ordering.chunked(many, ordering.tie_break()).groupBy("batch").count().orderBy("batch").collect()]
    assert sizes == [25, 25, 25, 25, 3]


def test_ranking_signals(small):
    name_only = search.search(small, "hlxed").collect()
    assert [r.id for r in name_only] == [1] and name_only[0].score == pytest.approx(0.7)
    text_only = search.search(small, "wings").collect()
    assert [r.id for r in text_only] == [2] and text_only[0].score == pytest.approx(0.3)
    assert ids(search.search(small, "btsushi/rg")) == [3] and ids(search.search(small, "zed")) == [4]
    assert ids(search.search(small, "wings", fts=False)) == [] and ids(search.search(small, "editor -is:archived")) == [1]
    assert ids(search.retained(search.search(small, ""), 3)) == [3] and ids(search.retained(search.search(small, ""), 9)) == [1]


def test_exact_name_comes_first(spark):
    names = [("helix-editor/helix", 30_000), ("neovim/neovim", 80_000), ("zed-industries/zed", 50_000), ("microsoft/vscode", 160_000), ("helix-toolkit/helix-toolkit", 4_000)]
    df = spark.createDataFrame([row(i, n, stars=s) for i, (n, s) in enumerate(names)], SCHEMA)
    assert ids(search.search(df, "helix")) == [0, 4]


def test_fuzzy_words(spark):
    df = spark.createDataFrame([("Foo/Bar",), ("foo/café",), ("x",), ("",), (None,)], "n string")

    def hit(pattern):
        told = df.select("n", fuzzy.matches(F.col("n"), pattern).alias("m"), fuzzy.fuzzy_score(F.col("n"), pattern).alias("s")).collect()
        assert all((r.s is not None) == r.m for r in told if r.n)
        return {r.n for r in told if r.m and r.n}

    assert hit("fb") == {"Foo/Bar"} and hit("FB") == {"Foo/Bar"} and hit("Fb") == set() and hit("cafe") == {"foo/café"} and hit("é") == {"foo/café"}
    assert hit("^foo") == {"Foo/Bar", "foo/café"} and hit("bar$") == {"Foo/Bar"} and hit("'o/b") == {"Foo/Bar"} and hit("!foo") == {"x"} and hit("^x$") == {"x"} and hit("foo bar") == {"Foo/Bar"}


def test_far_letters_still_match(spark):
    long = "x" + "m" * 20 + "a" + "m" * 80 + "b" + "m" * 20
    df = spark.createDataFrame([row(1, long), row(2, "ab/c"), row(3, "ba/c")], SCHEMA)
    told = {r.id: (r.m, r.s) for r in df.select("id", fuzzy.matches(F.col("full_name"), "ab").alias("m"), fuzzy.fuzzy_score(F.col("full_name"), "ab").alias("s")).collect()}
    assert told[1] == (True, 0.0) and told[2][1] > 0 and told[3] == (False, None)
    assert set(ids(search.search(df, "ab", fts=False))) == {1, 2} and set(ids(search.search(df, "ab"))) == {1, 2}


def test_bm25_against_sqlite(spark):
    rng = random.Random(2)
    words = ["modal", "editor", "Café", "daily-driver", "c++", "snake_case", "漢字", "search", "searching", "x2", "the"]
    text = lambda n: " ".join(rng.choices(words, k=rng.randint(0, n)))
    rows = [row(i, f"o{i % 5}/{rng.choice(words)}-{i}", text(12) if i % 9 else None, topics=[rng.choice(words) for _ in range(i % 3)], tags=[(rng.choice(words), "ai")] * (i % 2)) for i in range(200)]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(full_name, description, topics, tags, tokenize='unicode61 remove_diacritics 2')")
    for r in rows:
        db.execute("insert into f(rowid, full_name, description, topics, tags) values (?,?,?,?,?)", (r[0], r[1], r[3] or "", " ".join(r[9]), " ".join(t[0] for t in r[10])))
    index = index_texts(spark.createDataFrame(rows, SCHEMA)).cache()
    for terms in (["sear"], ["modal", "edit"], ["daily-driver"], ["cafe"], ["CAFÉ"], ["snake_case"], ["漢"], ["the"], ["o1/modal"], ["nothing"], ["!!"], ["machine learning"]):
        wanted = phrases(terms)
        expected = {}
        if wanted:
            match = " AND ".join('"' + " ".join(p) + '"*' for p in wanted)
            expected = dict(db.execute("select rowid, -bm25(f, 1.0, 5.0, 3.0, 4.0) from f where f match ?", (match,)).fetchall())
        got = {r.id: r.rel for r in bm25(index, terms).collect()}
        assert got.keys() == expected.keys() and all(got[i] == pytest.approx(expected[i], rel=1e-9) for i in got), terms
        if terms in (["sear"], ["daily-driver"], ["modal", "edit"]):
            written = {r.id: r.rel for r in postings_bm25(postings(index), lengths(index), terms).collect()}
            assert written.keys() == got.keys() and all(written[i] == pytest.approx(got[i], rel=1e-9) for i in got), terms
    assert bm25(index.limit(0), ["a"]).count() == 0 and postings_bm25(postings(index.limit(0)), lengths(index.limit(0)), ["a"]).count() == 0


def test_tokens_fold(spark):
    df = spark.createDataFrame([("Ünï-CODE 漢字 x²",), (None,)], "s string")
    assert [r[0] for r in df.select(token_list(F.col("s"))).collect()] == [["uni", "code", "漢字", "x²"], []]
    assert phrases(['"a b"', "-x-", "…", "a/b.c"]) == [["ab"], ["x"], ["a", "b", "c"]]


def test_facet_counts(spark):
    links = spark.createDataFrame([(i, "cli", "github") for i in range(588)] + [(i, "CLI", "ai") for i in range(114)] + [(i, "wasm", "ai") for i in range(110)] + [(1, "once", "github")], "repo_id long, name string, source string")
    counted = facets.tag_facets(links)
    assert [tuple(r) for r in counted.collect()][:2] == [("cli", "github", 588), ("CLI", "ai", 114)]
    merged = facets.merged_facets(counted)
    assert [tuple(r) for r in merged.collect()] == [("cli", "ai", 702), ("wasm", "ai", 110)] and facets.facet_head(merged, 1).count() == 1
    groups = spark.createDataFrame([("A", ""), ("B", "s")], "name string, summary string")
    members = spark.createDataFrame([(1, "B"), (2, "B")], "repo_id long, group_name string")
    assert [tuple(r) for r in facets.group_facets(groups, members).collect()] == [("B", "s", 2), ("A", "", 0)]


def test_view_orders_its_lists(spark):
    df = spark.createDataFrame([([("b", "ai", 0.5), None, ("a", "ai", 0.5), ("c", "user", 0.1), ("d", "github", 1.0), (None, "ai", 1.0), ("e", "ai", None)],), (None,)], f"tags {TAGS}")
    assert [[t.name for t in r[0]] for r in df.select(model.ordered_tags(F.col("tags"))).collect()] == [["c", "d", "a", "b", "e"], []]
    texts = spark.createDataFrame([('{"A":1}',), ('{"A":null}',), ("[]",), ('{"A":',), (None,), ('{"edges":[]}',)], "l string")
    assert [r[0] for r in texts.select(model.stored_languages(F.col("l"))).collect()] == [{"A": 1}, {}, {}, {}, {}, {}]


def test_display_values(spark):
    one = spark.range(1)
    show = lambda c: one.select(c).first()[0]
    counts = {0: "0", 999: "999", 1000: "1k", 1049: "1.0k".replace(".0", ""), 1050: "1.1k", 1150: "1.1k", 1250: "1.2k", 9950: "9.9k", 9999: "10k", 39472: "39k", 999_999: "999k", 1_000_000: "1M", 1_550_000: "1.6M", 12_000_000: "12M", -1500: "-1.5k"}
    for n, text in counts.items():
        if 1000 <= abs(n) < 10_000:
            text = f"{n / 1000:.1f}k".replace(".0k", "k")
        assert show(display.compact_count(F.lit(n).cast("bigint"))) == text, n
    now = F.lit("2026-03-01 00:00:00").cast("timestamp")
    for then, text in (("2026-03-01 00:00:01", "now"), ("2026-02-28 23:59:30", "now"), ("2026-02-28 23:00:00", "1h"), ("2026-02-18 00:00:00", "11d"), ("2026-01-01 00:00:00", "1mo"), ("2020-01-01 00:00:00", "6y"), (None, "—")):
        assert show(display.relative_time(F.lit(then).cast("timestamp"), now)) == text
    assert show(display.absolute_date(F.lit("2026-02-08 10:00:00").cast("timestamp"))) == "8 Feb 2026"
    hue = 2_166_136_261
    for b in "Éclat".encode():
        hue = ((hue ^ b) * 16_777_619) % 2**32
    assert show(display.stable_hue(F.lit("Éclat"))) == hue % 360 and show(display.stable_hue(F.lit(""))) == 2_166_136_261 % 360
    assert show(display.language_color(F.lit("Rust"))).hue == 17 and show(display.language_color(F.lit("Éclat"))).hue == hue % 360
    shares = display.language_shares(F.create_map(F.lit("b"), F.lit(500), F.lit("a"), F.lit(500), F.lit("c"), F.lit(4)))
    assert [(s.name, round(s.share, 3)) for s in show(shares)] == [("a", 0.498), ("b", 0.498)]
    assert show(display.language_shares(F.create_map(F.lit("a"), F.lit(0)))) == []
    assert show(display.preview(F.lit("a\n <!-- x\nb  \n\n"), 2)) == "a\nb" and show(display.redact(F.lit("key=abc" + "x" * 300), "abc", 10)) == "key=[redac…"
    assert [show(F.unix_micros(display.parse_time(F.lit(t)))) for t in ("1970-01-01T00:00:01.5Z", "1970-01-01t01:00:00+01:00", "1970-13-01T00:00:00Z", "junk")] == [1_500_000, 0, None, None]
    assert show(display.format_time(F.lit("2026-02-18 01:02:03.9").cast("timestamp"))) == "2026-02-18T01:02:03Z"


def test_the_view_takes_each_column_of_the_current_row(spark, tmp_path):
    from quern.operators.current import current_columns

    rows = [(1, 1, None, "old", None), (1, 2, None, "new", None), (1, 2, None, "new", None), (2, 1, 5, "late", "x"), (2, 9, 4, "early", "y"), (None, 1, 1, "none", "z")]
    df = spark.createDataFrame(rows, "id long, seq long, synced_at long, a string, b string")
    view = current_columns(df.repartition(3), "id", ["synced_at", "seq"], ["a", "b"])
    assert {tuple(r) for r in view.collect()} == {(1, "new", None), (2, "late", "x")} and current_columns(df.limit(0), "id", ["seq"], ["a"]).count() == 0
    df.write.parquet(str(tmp_path / "t"))
    stored = current_columns(spark.read.parquet(str(tmp_path / "t")), "id", ["synced_at", "seq"], ["a", "b"])
    assert "ReadSchema: struct<id:bigint,seq:bigint,synced_at:bigint,a:string>" in stored.select("id", "a")._jdf.queryExecution().executedPlan().toString()


def test_tag_cells(small):
    shown = small.select("id", display.tag_cells(F.col("tags"), 1).alias("c")).where("id = 2").first().c
    assert [(t.name, t.muted) for t in shown] == [("CLI", False)]
