from hypothesis import given, settings
from hypothesis import strategies as st

from quern.plans.query import FIELDS, Clause, SortKey, StarRange, commands, count, parse, star_range, tokens, with_filter, with_sort

SAFE = st.from_regex(r"[a-zA-Z0-9_.][a-zA-Z0-9_.-]{0,20}", fullmatch=True)


def test_clauses_text_and_sort():
    q = parse('lang:rust -tag:cli "hello world" stars:>1k sort:stars sort:name')
    assert q.clauses == [Clause("language", "rust"), Clause("tag", "cli", True), Clause("stars", StarRange(1001, None))]
    assert q.terms == ["hello world"] and q.text == "hello world" and q.sort is SortKey.NAME


def test_edges():
    assert parse("lang:").is_empty
    assert parse('lang:""').clauses == [Clause("language", "")]
    assert parse("foo:bar http://x").terms == ["foo:bar", "http://x"]
    assert parse('"lang:rust"').terms == ["lang:rust"]
    assert parse("-word -").terms == ["-word", "-"]
    assert parse("owner:a:b").clauses == [Clause("owner", "a:b")]
    assert parse("-stars:banana").terms == ["-stars:banana"]
    assert parse('tag:"a \\"b\\" c"').clauses == [Clause("tag", 'a "b" c')]
    assert parse('"open to the end').terms == ["open to the end"]
    assert parse('"" "').is_empty


def test_active_and_source_hold_with_and_without_a_dash():
    for word, field in (("active", "archived"), ("source", "fork")):
        (plain,), (dashed,) = parse(f"is:{word}").clauses, parse(f"-is:{word}").clauses
        assert plain == Clause(field, False, False) and dashed == Clause(field, True, True)


def test_star_ranges():
    assert star_range("10..20") == StarRange(10, 20) and star_range("..20") == StarRange(None, 20)
    assert star_range("..") is None and star_range(">1..5") is None and star_range("1.5") is None
    assert star_range("<5") == StarRange(None, 4) and star_range("-0") == StarRange(0, 0)
    assert count("1.5k") == 1500 and count("2M") == 2_000_000 and count("k") is None
    assert count("1_000") is None and count("٣") is None and count("infk") is None and count(".5k") == 500
    assert count(str(2**63)) is None and star_range(f">{2**63 - 1}").low == 2**63 - 1


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text_parses(text):
    q = parse(text)
    assert "" not in q.terms or '""' in text or '"' in text
    assert q.text == " ".join(q.terms)


@settings(max_examples=200, deadline=None)
@given(st.lists(SAFE, max_size=6))
def test_free_text_parses_to_itself(words):
    q = parse(" ".join(words))
    assert parse(q.text).terms == q.terms


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(sorted(set(FIELDS) - {"sort", "is", "stars"})), SAFE)
def test_known_fields_never_leak_into_text(name, value):
    assert parse(f"{name}:{value}").terms == []
    (plain,), (dashed,) = parse(f"{name}:{value}").clauses, parse(f"-{name}:{value}").clauses
    assert dashed == Clause(plain.field, plain.value, True)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**9))
def test_greater_than_is_at_least_one_more(n):
    assert star_range(f">{n}") == star_range(f">={n + 1}")


def test_rewriting():
    assert with_sort("a sort:name  b SORT:stars", SortKey.STARS) == "a b sort:stars"
    assert with_filter("  a ", "-is:fork") == "a -is:fork" and with_filter(" ", "x") == "x"
    assert ("filter", "Hide forks") in commands("FORK") and len(commands("sort")) == 5
    assert tokens("a　b") == ["a", "b"]
