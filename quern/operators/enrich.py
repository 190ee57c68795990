"""Enrichment in batches: replies of a model to tags and groups."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.names import WHITE_SPACE, trimmed
from quern.operators.ordering import chunked
from quern.operators.predicates import summaries
from quern.session import cut_lineage

BATCH = 25
MOST_TAGS = 6
ASSUMED_CONFIDENCE = 0.5
#: Characters that one grouping request may hold.
GROUP_PROMPT = 1 << 22


class Cancelled(RuntimeError):
    """A run that was asked to stop and did, between two passes."""


class Malformed(ValueError):
    """A reply whose structure can't be used."""


def normalise_tag(name: Column) -> Column:
    """Trimmed, lower case, inner white space as one `-`."""
    return F.regexp_replace(F.lower(trimmed(name)), f"{WHITE_SPACE}+", "-")


def _strict(text: str):
    def refuse(word: str):
        raise ValueError(word)

    return json.loads(text, parse_constant=refuse)


def extract_json(raw: str):
    """The first complete JSON object or list in a reply, whatever stands around it.

    Candidates begin at each bracket and end where brackets balance outside strings; the
    kinds of brackets are left to the decoder. Raises Malformed if none decodes.
    """
    marks = [i for i, c in enumerate(raw) if c in '{}[]"\\']
    opened = False
    for k, start in enumerate(marks):
        if raw[start] not in "{[":
            continue
        opened = True
        depth, quoted, skip = 0, False, -1
        for i in marks[k:]:
            c = raw[i]
            if i == skip:
                continue
            if quoted:
                if c == "\\":
                    skip = i + 1
                quoted = c != '"'
            elif c == '"':
                quoted = True
            elif c in "{[":
                depth += 1
            elif c in "}]":
                depth -= 1
                if not depth:
                    try:
                        return _strict(raw[start : i + 1])
                    except ValueError:
                        break
    raise Malformed("no complete JSON value (truncated?)" if opened else "no JSON value")


def _entries(raw: str, name: str) -> list:
    value = extract_json(raw)
    if not isinstance(value, dict) or not isinstance(value.get(name), list):
        raise Malformed(f"an object with a list `{name}` was expected")
    return value[name]


def _name(entry, key: str) -> str:
    text = entry.get(key) if isinstance(entry, dict) else None
    if not isinstance(text, str) or not text.strip():
        raise Malformed(f"an entry lacks `{key}`")
    return text.strip()


def clean_tags(tags) -> list[tuple[str, float]]:
    """(name, confidence) of a list of names or {name, confidence}: names normalised, the
    first of equal ones kept, junk skipped, confidence within 0 and 1, at most MOST_TAGS."""
    out: dict[str, float] = {}
    for tag in tags if isinstance(tags, list) else []:
        name = tag if isinstance(tag, str) else tag.get("name") if isinstance(tag, dict) else None
        told = tag.get("confidence") if isinstance(tag, dict) else None
        if not isinstance(name, str) or not name.strip():
            continue
        sure = float(told) if isinstance(told, (int, float)) and not isinstance(told, bool) else ASSUMED_CONFIDENCE
        sure = ASSUMED_CONFIDENCE if math.isnan(sure) else min(max(sure, 0.0), 1.0)
        out.setdefault("-".join(name.lower().split()), sure)
        if len(out) == MOST_TAGS:
            break
    return list(out.items())


def parse_tags(raw: str) -> list[tuple[str, list[tuple[str, float]]]]:
    """(full_name, tags) of a reply; entries left without tags are dropped. A reply whose
    structure is wrong anywhere is Malformed as a whole; wrong values are mended."""
    told = [(_name(e, "full_name"), clean_tags(e.get("tags"))) for e in _entries(raw, "repos")]
    return [(name, tags) for name, tags in told if tags]


def parse_groups(raw: str) -> list[tuple[str, str, list[str]]]:
    """(name, summary, members) of a reply; groups left without members are dropped."""
    out = []
    for entry in _entries(raw, "groups"):
        name, summary, members = _name(entry, "name"), entry.get("summary"), entry.get("members")
        names = [m.strip() for m in members if isinstance(m, str) and m.strip()] if isinstance(members, list) else []
        if names:
            out.append((name, summary.strip() if isinstance(summary, str) else "", list(dict.fromkeys(names))))
    return out


def with_one_retry(ask: Callable[[str], str], prompt: str, parse: Callable[[str], list], again: str):
    """Asks once more, with `again` appended, if the reply can't be used; other errors pass."""
    try:
        return parse(ask(prompt))
    except Malformed:
        return parse(ask(prompt + again))


def batches(view: DataFrame, order: list[Column], size: int = BATCH) -> DataFrame:
    """batch, repos, prompt: the summaries of `size` repositories at a time, as JSON."""
    numbered = chunked(summaries(view).join(view.select("id", "stargazers"), "id"), order, size)
    row = F.struct("full_name", "description", "topics", "language")
    listed = numbered.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("full_name", row.alias("r")))).alias("l"))
    return listed.select("batch", F.size("l").alias("repos"), F.to_json(F.col("l.r"), {"ignoreNullFields": "true"}).alias("prompt"))


def tag_batches(prompts: DataFrame, ask: Callable[[str], str], again: str = "\nReply with JSON only.") -> DataFrame:
    """batch, ok, error, entry, full_name, place, name, confidence: tags of every batch, in
    the order of the reply (entry, place), or its error.

    `ask` runs in the executors, once per batch, once more for a malformed reply. A
    failed batch is one row with ok false and doesn't stop the others; a reply without
    any tag is one row with ok true and nulls.
    """
    columns = ["batch", "ok", "error", "entry", "full_name", "place", "name", "confidence"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for batch, prompt in zip(frame["batch"], frame["prompt"]):
                try:
                    told = with_one_retry(ask, prompt, parse_tags, again)
                    rows += [(batch, True, None, i, repo, k, *tag) for i, (repo, tags) in enumerate(told) for k, tag in enumerate(tags)] or [(batch, True, *[None] * 6)]
                except Exception as e:  # a batch may fail in any way
                    rows.append((batch, False, str(e)[:200], *[None] * 5))
            out = pd.DataFrame(rows, columns=columns)
            yield out.astype({"entry": "Int64", "place": "Int64"})

    return prompts.select("batch", "prompt").mapInPandas(run, "batch bigint, ok boolean, error string, entry int, full_name string, place int, name string, confidence double")


def resolved(told: DataFrame, repos: DataFrame) -> DataFrame:
    """repo_id, name, confidence, ordinal: the tags told for full names that are in the
    catalog (of several repositories of one name the least id); unknown names are skipped.
    Of a repository told more than once the last entry counts, as a whole."""
    ids = repos.where(F.col("full_name").isNotNull()).groupBy("full_name").agg(F.min("id").alias("repo_id"))
    entry = F.struct("batch", "entry")
    named = told.where("ok AND name IS NOT NULL").groupBy("full_name").agg(F.max(entry).alias("e"), F.collect_list(F.struct(entry.alias("e"), "place", "name", "confidence")).alias("all"))
    last = named.select("full_name", F.explode(F.filter("all", lambda t: t["e"] == F.col("e"))).alias("t"))
    return last.join(ids, "full_name").select("repo_id", F.col("t.name").alias("name"), F.col("t.confidence").alias("confidence"), F.col("t.place").alias("ordinal"))


def union_tags(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """full_name, tags: existing tags first, then fresh ones, trimmed, blank and repeated
    ones (in the same case) left out, in order. Both: full_name, tags ARRAY<STRING>."""
    none = F.array().cast("array<string>")
    joined = existing.select("full_name", F.col("tags").alias("_old")).join(fresh.select("full_name", F.col("tags").alias("_new")), "full_name", "full")
    both = F.concat(F.coalesce("_old", none), F.coalesce("_new", none))
    tags = F.array_distinct(F.filter(F.transform(both, trimmed), lambda t: t != ""))
    return joined.select("full_name", tags.alias("tags"))


def run_tags(prompts: DataFrame, ask: Callable[[str], str]) -> DataFrame:
    """tag_batches, failing only if every batch failed."""
    told = cut_lineage(tag_batches(prompts, ask))
    counts = told.groupBy("ok").agg(F.count_distinct("batch").alias("n")).collect()
    by = {r.ok: r.n for r in counts}
    if by.get(False) and not by.get(True):
        raise Malformed("every batch failed: " + told.where(~F.col("ok")).select("error").first()[0])
    return told


def group_prompt(view: DataFrame, tags: DataFrame, most: int = GROUP_PROMPT) -> DataFrame:
    """prompt: one row, the JSON list of full_name, description and tags of all
    repositories, in the order of their names. tags: full_name, tags ARRAY<STRING>.

    One request holds the whole library, so it is bounded by what a request may hold:
    more than `most` characters are refused before anything is gathered.
    """
    rows = view.select("full_name", "description").join(tags, "full_name", "left")
    line = F.to_json(F.struct("full_name", "description", F.coalesce("tags", F.array().cast("array<string>")).alias("tags")))
    lines = cut_lineage(rows.select("full_name", line.alias("line")))
    size = lines.agg(F.sum(F.length("line") + 1)).first()[0] or 0
    if size > most:
        raise Malformed(f"the grouping request would have {size} characters, more than {most}")
    listed = F.array_sort(F.collect_list(F.struct("full_name", "line")))
    return lines.agg(F.concat(F.lit("["), F.array_join(listed["line"], ","), F.lit("]")).alias("prompt"))


def ask_groups(prompt: DataFrame, ask: Callable[[str], str], again: str = "\nReply with JSON only.") -> DataFrame:
    """ok, error, ordinal, name, summary, member: one row per member of each group of the
    reply, or one row with the error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for prompt in frame["prompt"]:
                try:
                    told = with_one_retry(ask, prompt, parse_groups, again)
                    rows += [(True, None, i, name, summary, m) for i, (name, summary, members) in enumerate(told) for m in members]
                except Exception as e:  # the pass may fail in any way
                    rows.append((False, str(e)[:200], None, None, None, None))
            yield pd.DataFrame(rows, columns=["ok", "error", "ordinal", "name", "summary", "member"]).astype({"ordinal": "Int64"})

    return prompt.select("prompt").mapInPandas(run, "ok boolean, error string, ordinal int, name string, summary string, member string")


@dataclass
class Outcome:
    """What an enrichment run gave. tags as of tag_batches, groups as of ask_groups; repos
    is the number of repositories tagged. The tags stand whatever became of the groups,
    whose failure is told in group_error."""

    batches: int
    failed: int
    repos: int
    tags: DataFrame
    groups: DataFrame
    group_error: str | None


def analyse(view: DataFrame, tag: Callable[[str], str], group: Callable[[str], str], known: DataFrame, order: list[Column], most: int = GROUP_PROMPT, cancelled: Callable[[], bool] | None = None) -> Outcome:
    """Tags the repositories in batches, then groups all of them in one request.

    known: full_name, tags ARRAY<STRING>, what is known of each; the grouping sees these
    first and the new tags after them. Fails only if every batch did. cancelled is asked
    before the tags and before the groups. Without repositories nothing is asked.
    """
    def go_on() -> None:
        if cancelled is not None and cancelled():
            raise Cancelled("stopped between two passes")

    go_on()
    prompts = cut_lineage(batches(view, order))
    n = prompts.count()
    told = run_tags(prompts, tag)
    failed = told.where(~F.col("ok")).count()
    tagged = told.where("ok AND name IS NOT NULL")
    repos = tagged.select("batch", "entry").distinct().count()
    nothing = view.sparkSession.createDataFrame([], "ordinal int, name string, summary string, member string")
    go_on()
    if not n:
        return Outcome(0, 0, 0, told, nothing, None)
    fresh = tagged.groupBy("full_name").agg(F.array_sort(F.collect_list(F.struct("batch", "entry", "place", "name"))).alias("l")).select("full_name", F.col("l.name").alias("tags"))
    try:
        groups = cut_lineage(ask_groups(group_prompt(view, union_tags(known, fresh), most), group))
        error = groups.where(~F.col("ok")).select("error").first()
        error = error[0] if error else None
    except Malformed as e:
        groups, error = None, str(e)
    groups = nothing if error is not None or groups is None else groups.select("ordinal", "name", "summary", "member")
    return Outcome(n, failed, repos, told, groups, error)


def pointer(body: Column, path: str) -> Column:
    """The value at a JSON pointer (/choices/0/message) in a JSON text, as text."""
    steps = [s.replace("~1", "/").replace("~0", "~") for s in path.split("/")[1:]]
    return F.get_json_object(body, "$" + "".join(f"[{s}]" if s.isdigit() else f"['{s}']" for s in steps))
