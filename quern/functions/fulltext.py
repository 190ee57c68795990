"""Full-text search: folded tokens, prefix phrases, column-weighted BM25."""

from __future__ import annotations

import math
import unicodedata
from functools import reduce

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as a word character, the weights and the constants of BM25.
TOKEN = "[\\p{L}\\p{N}\\p{Co}]+"
WEIGHTS = {"full_name": 1.0, "description": 5.0, "topics": 3.0, "tags": 4.0}
K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
KEPT_MARKS = "_-./\""
LIMIT = 2000


def folded(text: Column) -> Column:
    """Lower case without diacritics; ICU decomposes what isn't ASCII, inside the JVM."""
    apart = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), F.coalesce(text, F.lit("")), F.lit(False))
    plain = F.when(F.octet_length(text) == F.char_length(text), text).otherwise(F.regexp_replace(apart, "\\p{Mn}+", ""))
    return F.lower(plain)


def fold_text(text: str) -> str:
    """The same folding for the few words of a query."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").lower()


def token_list(text: Column) -> Column:
    """The folded tokens of a text; none for null."""
    return F.regexp_extract_all(folded(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), 1)


def phrases(terms: list[str]) -> list[list[str]]:
    """The phrase each term asks for: adjacent tokens, the last one a prefix.

    Characters that are neither letters, digits nor one of KEPT_MARKS are deleted from
    a term (white space too), marks at its ends as well; what is left splits into
    tokens at the marks. Terms with nothing left ask nothing.
    """
    out = []
    for term in terms:
        kept = "".join(c for c in term if c.isalnum() or c in KEPT_MARKS)
        kept = regex.sub(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "", kept)
        words = regex.findall(TOKEN, fold_text(kept))
        if words:
            out.append(words)
    return out


def index_texts(view: DataFrame) -> DataFrame:
    """id and the token lists of the four searched columns: a view of the current rows,
    to be derived anew or written as a table where many queries follow."""
    return view.select(
        "id", token_list(F.col("full_name")).alias("full_name"), token_list(F.col("description")).alias("description"),
        token_list(F.array_join("topics", " ")).alias("topics"), token_list(F.array_join("tags.name", " ")).alias("tags"),
    )


def hits(tokens: Column, phrase: list[str]) -> Column:
    """How often the phrase stands in the tokens."""
    if len(phrase) == 1:
        return F.size(F.filter(tokens, lambda t: t.startswith(phrase[0])))
    places = F.sequence(F.lit(1), F.size(tokens) - (len(phrase) - 1))

    def at(i: Column) -> Column:
        words = [F.try_element_at(tokens, i + k) for k in range(len(phrase))]
        tests = [w == p for w, p in zip(words[:-1], phrase)] + [words[-1].startswith(phrase[-1])]
        return reduce(lambda a, b: a & b, tests)

    return F.when(F.size(tokens) < len(phrase), 0).otherwise(F.size(F.filter(places, at)))


def bm25(index: DataFrame, terms: list[str]) -> DataFrame:
    """id, rel: the rows that hold every phrase, in whatever columns, and how well.

    Statistics are over the whole index and come to the driver as one row; the second
    pass over the index scores. No postings are exploded and nothing is shuffled. A
    query with no phrase finds nothing.
    """
    wanted = phrases(terms)
    if not wanted:
        return index.select("id", F.lit(0.0).alias("rel")).limit(0)
    columns = list(WEIGHTS)
    counted = index.select("id", sum((F.size(c) for c in columns), F.lit(0)).alias("length"), *[F.array(*[hits(F.col(c), p) for c in columns]).alias(f"h{i}") for i, p in enumerate(wanted)])
    any_hit = [F.exists(f"h{i}", lambda h: h > 0) for i in range(len(wanted))]
    stats = counted.agg(F.count("*").alias("n"), F.sum("length").alias("total"), *[F.count_if(a).alias(f"n{i}") for i, a in enumerate(any_hit)]).first()
    if not stats.n or not stats.total:
        return index.select("id", F.lit(0.0).alias("rel")).limit(0)
    mean, rel = stats.total / stats.n, F.lit(0.0)
    for i in range(len(wanted)):
        f = sum((F.col(f"h{i}")[k] * w for k, w in enumerate(WEIGHTS.values())), F.lit(0.0))
        rel = rel + F.lit(_idf(stats.n, stats[f"n{i}"])) * _saturated(f, F.col("length"), mean)
    return counted.where(reduce(lambda a, b: a & b, any_hit)).select("id", rel.alias("rel"))


def postings(index: DataFrame) -> DataFrame:
    """token, id, column, places: where each token stands, for many queries over one index.

    Written sorted by token (TableStore.write(..., sort_by=["token"])), a query reads only
    the row groups that can hold its words.
    """
    lists = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("tokens")) for c in WEIGHTS])
    each = index.select("id", F.explode(lists).alias("l")).select("id", "l.column", F.posexplode("l.tokens").alias("place", "token"))
    return each.groupBy("token", "id", "column").agg(F.sort_array(F.collect_list("place")).alias("places"))


def lengths(index: DataFrame) -> DataFrame:
    """id and the number of tokens of each row, the other half of a written index."""
    return index.select("id", sum((F.size(c) for c in WEIGHTS), F.lit(0)).alias("length"))


def _weight() -> Column:
    return F.coalesce(*[F.when(F.col("column") == c, w) for c, w in WEIGHTS.items()])


def _phrase_hits(entries: DataFrame, phrase: list[str]) -> DataFrame:
    """id, f: the weighted hits of a phrase, from postings."""
    *exact, prefix = phrase
    last = entries.where(F.col("token").startswith(prefix))
    if not exact:
        return last.groupBy("id").agg(F.sum(_weight() * F.size("places")).alias("f"))
    at = lambda df, k: df.select("id", "column", F.explode("places").alias("p")).select("id", "column", (F.col("p") - k).alias("p"))
    found = at(last, len(exact))
    for k, word in enumerate(exact):
        found = found.join(at(entries.where(F.col("token") == word), k), ["id", "column", "p"])
    return found.groupBy("id").agg(F.sum(_weight()).alias("f"))


def postings_bm25(entries: DataFrame, sizes: DataFrame, terms: list[str]) -> DataFrame:
    """id, rel: the same as bm25, from written postings and lengths: only the postings of
    the query's words are read and shuffled. One row of statistics and one count per
    phrase come to the driver."""
    wanted = phrases(terms)
    stats = sizes.agg(F.count("*").alias("n"), F.sum("length").alias("total")).first()
    if not wanted or not stats.n or not stats.total:
        return sizes.select("id", F.lit(0.0).alias("rel")).limit(0)
    out, rel = sizes, F.lit(0.0)
    for i, phrase in enumerate(wanted):
        hit = _phrase_hits(entries, phrase)
        rel = rel + F.lit(_idf(stats.n, hit.count())) * _saturated(F.col(f"f{i}"), F.col("length"), stats.total / stats.n)
        out = out.join(hit.withColumnRenamed("f", f"f{i}"), "id")
    return out.select("id", rel.alias("rel"))


def _idf(n: int, holding: int) -> float:
    idf = math.log((n - holding + 0.5) / (holding + 0.5))
    return idf if idf > 0 else LEAST_IDF


def _saturated(f: Column, length: Column, mean: float) -> Column:
    return f * (K1 + 1) / (f + K1 * (1 - B + B * length / F.lit(mean)))


def top(scores: DataFrame, n: int = LIMIT) -> DataFrame:
    """The n best hits."""
    return scores.orderBy(F.desc("rel"), "id").limit(n)


def bm25_sql(source: str, terms: list[str]) -> str:
    """CTEs ending in hits(id, rel): the same in DuckDB SQL over a table with the view's columns."""
    wanted, columns = phrases(terms), list(WEIGHTS)
    texts = {"full_name": "full_name", "description": "description", "topics": "array_to_string(topics, ' ')", "tags": "array_to_string(list_transform(tags, lambda t: t.name), ' ')"}
    split = ", ".join(f"regexp_extract_all(strip_accents(lower(coalesce({t}, ''))), '{TOKEN}') AS {c}" for c, t in texts.items())

    def sql_hits(c: str, p: list[str]) -> str:
        if len(p) == 1:
            return f"len(list_filter({c}, lambda t: starts_with(t, '{p[0]}')))"
        tests = [f"{c}[i + {k + 1}] = '{w}'" for k, w in enumerate(p[:-1])] + [f"starts_with({c}[i + {len(p)}], '{p[-1]}')"]
        return f"len(list_filter(range(greatest(len({c}) - {len(p) - 1}, 0)), lambda i: {' AND '.join(tests)}))"

    f = [" + ".join(f"{w} * {sql_hits(c, p)}" for c, w in WEIGHTS.items()) for p in wanted]
    fs = ", ".join(f"({x})::DOUBLE AS f{i}" for i, x in enumerate(f))
    idf = lambda i: f"(SELECT CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) ELSE {LEAST_IDF} END FROM stats)"
    rel = " + ".join(f"{idf(i)} * f{i} * {K1 + 1} / (f{i} + {K1} * ({1 - B} + {B} * length / (SELECT total / n FROM stats)))" for i in range(len(wanted)))
    return f"""split AS (SELECT id, {split} FROM {source}),
counted AS (SELECT id, ({' + '.join(f'len({c})' for c in columns)})::DOUBLE AS length, {fs} FROM split),
stats AS (SELECT count(*)::DOUBLE AS n, sum(length) AS total, {', '.join(f'count(*) FILTER (f{i} > 0) AS n{i}' for i in range(len(wanted)))} FROM counted),
hits AS (SELECT id, {rel} AS rel FROM counted WHERE {' AND '.join(f'f{i} > 0' for i in range(len(wanted)))})"""
