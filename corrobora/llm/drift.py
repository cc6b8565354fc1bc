"""Problem 7: files whose fields change from one to the next: the changes, and one consistent table."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corrobora.llm.groups import star_components
from corrobora.operators.layout import spread
from corrobora.operators.packed import learn_lattice, unpack
from corrobora.operators.skew import lookup
from corrobora.session import cut

#: The key that names the candidate of a line, by which lines of two files are compared.
ENTITY = "candidateRef"
#: A rename needs this share of the settled similarity of a key that keeps its name and content.
ACCEPT = 0.5
#: Parts of names and of contents in what a pair starts from, and how much of its neighbours' similarity flows into a pair.
NAMES, CONTENTS, FLOW = 0.25, 0.75, 0.8
#: Pairs of keys of one step among which none may agree by mere chance.
COMPARED = 32
#: Rounds after which flooding must have settled to within SETTLED.
ROUNDS, SETTLED = 500, 1e-6
#: Renamed keys that the consistent table may know; the mapping of that many goes to the executors.
MOST_KEYS = 10_000


def _no_constant(_: str) -> None:
    raise ValueError("not JSON")


def read_object(raw: str | None) -> dict | None:
    """A top-level JSON object, or None: broken lines, other values, NaN and Infinity aren't readable."""
    try:
        x = json.loads(raw, parse_constant=_no_constant) if raw else None
    except (ValueError, RecursionError):
        return None
    return x if isinstance(x, dict) else None


def json_type(v: object) -> str | None:
    if v is None:
        return None
    if isinstance(v, bool):
        return "boolean"
    return "number" if isinstance(v, int | float) else {str: "string", list: "array", dict: "object"}[type(v)]


def leaves(v: object) -> list[str]:
    out, stack = [], [v]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            stack.extend(reversed(list(x.values())))
        elif isinstance(x, list):
            stack.extend(reversed(x))
        elif x is not None:
            out.append(json.dumps(x) if isinstance(x, bool | int | float) else x)
    return out


def content(v: object) -> str | None:
    """What a value says whatever its type: wrappers, lists against packed texts, case, marks and units aside."""
    words = [w for x in leaves(v) for w in re.findall(r"[^\W_]+(?:\.\d+)?", x.lower())]
    if not words:
        return None
    if re.fullmatch(r"\d+(?:\.\d+)?", words[0]) and len(words) <= 2:
        return f"{float(words[0]):g}"
    return " ".join(sorted(words))


def nesting(v: object, depth: int = 3) -> list[str]:
    """Paths of the named fields inside a value, lists aside, down to a depth."""
    out, stack = set(), [(v, "", depth)]
    while stack:
        x, path, left = stack.pop()
        if isinstance(x, list):
            stack.extend((y, path, left) for y in x if isinstance(y, dict | list))
        elif isinstance(x, dict) and left:
            for k, y in x.items():
                out.add(f"{path}{k}")
                stack.append((y, f"{path}{k}.", left - 1))
    return sorted(out)


def entries(drops: DataFrame) -> DataFrame:
    """(feed, file_seq, file_name, line_no, entity, key, type, inner, said): each top-level key of each readable line."""

    @F.pandas_udf("array<struct<entity:string,key:string,type:string,inner:array<string>,said:bigint>>")
    def fields(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from hashlib import blake2b

        for s in batches:
            rows = []
            for raw in s:
                x = read_object(raw) or {}
                who = x.get(ENTITY)
                who = None if who is None else str(who)
                row = []
                for k, v in x.items():
                    c = content(v)
                    said = None if c is None else int.from_bytes(blake2b(c.encode(errors="surrogatepass"), digest_size=8).digest(), "big", signed=True)
                    row.append({"entity": who, "key": k, "type": json_type(v), "inner": nesting(v) or None, "said": said})
                rows.append(row)
            yield pd.Series(rows)

    cols = ["feed", "file_seq", "file_name", "line_no"]
    return spread(drops.select(*cols, "raw_json")).select(*cols, F.explode(fields("raw_json")).alias("x")).select(*cols, "x.*")


def trigrams(name: str) -> set[str]:
    s = "  " + re.sub(r"[\W_]+", " ", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name)).lower() + " "
    return {s[i : i + 3] for i in range(len(s) - 2)}


def words(name: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name)).lower().split()


def dice(a: set[str], b: set[str]) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


def alike(x: str, y: str) -> float:
    return 1.0 if x == y else dice(trigrams(x), trigrams(y))


def _partners(xs: list[str], ys: list[str]) -> list[tuple[str, str]]:
    """Each x with the y most like it, and each y with such an x."""
    if not xs or not ys:
        return []
    to = {(x, max(sorted(ys), key=lambda y: alike(x, y))) for x in xs} | {(max(sorted(xs), key=lambda x: alike(x, y)), y) for y in ys}
    return sorted(to)


def _evidence(a: str, b: str, agree: tuple[int, int, int], inner_a: set[str], inner_b: set[str]) -> float:
    """What a pair of keys starts from: its names, and how far beyond chance its contents agree.

    Where no candidate has both, names count alone, or the fields nested in both values if there are two in common at least.
    """
    shared, same, kinds = agree
    names = dice(trigrams(a), trigrams(b))
    if shared:
        # Contents that don't repeat come from many more than were seen.
        chance = 1 / max(kinds, 2) if kinds < shared else min(0.5, 2 / kinds**2)
        lift = max(0.0, (same / shared - chance) / (1 - chance))
        return NAMES * names + CONTENTS * lift**2 * (1 - chance**same) ** COMPARED
    both = inner_a & inner_b
    return CONTENTS * max(names, len(both) / len(inner_a | inner_b) if len(both) >= 2 else 0.0)


#: Stands for a key that keeps its name and content: what all pairs are measured by.
KEPT = ("key", "=", "=")


def flood(gone: dict[str, set[str]], new: dict[str, set[str]], said: dict[tuple[str, str], tuple[int, int, int]], inner: dict[str, set[str]] | None = None) -> dict[tuple[str, str], float]:
    """The settled similarity of every pair of a key that went and one that came, by similarity flooding; KEPT has 1.

    gone, new: key to JSON types. said: (old, new) to (candidates with both values, of these with the same content, distinct
    contents). inner: key to paths of nested fields. The graph joins pairs of keys with the pairs of their types, of the words
    of their names and of their nested fields. Each round a pair gets what it starts from and FLOW of the mean of its neighbours
    by relation, and all are scaled to the largest. Raises if that doesn't settle.
    """
    inner = inner or {}
    start: dict[tuple, float] = {KEPT: 1.0}
    near: dict[tuple, dict[str, list[tuple]]] = {}

    def join(pair: tuple, other: tuple, value: float) -> None:
        start.setdefault(other, value)
        near.setdefault(pair, {}).setdefault(other[0], []).append(other)
        near.setdefault(other, {}).setdefault("key", []).append(pair)

    for a, b in product(sorted(gone), sorted(new)):
        pair = ("key", a, b)
        ia, ib = inner.get(a, set()), inner.get(b, set())
        start[pair] = _evidence(a, b, said.get((a, b), (0, 0, 0)), ia, ib)
        for x, y in product(sorted(gone[a]), sorted(new[b])):
            join(pair, ("type", x, y), 1.0 if x == y else 0.3)
        for relation, xs, ys in (("word", words(a), words(b)), ("inner", sorted(ia), sorted(ib))):
            for x, y in _partners(xs, ys):
                join(pair, (relation, x, y), alike(x, y))
    for n in list(start):
        if n[0] != "key" and n[1] == n[2]:
            join(KEPT, n, 1.0)
    if KEPT not in near:
        join(KEPT, ("type", "=", "="), 1.0)
    now = dict(start)
    for _ in range(ROUNDS):
        flow = {n: [sum(now[m] for m in ms) / len(ms) for ms in near.get(n, {}).values()] for n in now}
        raw = {n: start[n] + (FLOW * sum(parts) / len(parts) if parts else 0.0) for n, parts in flow.items()}
        top = max(raw.values())
        moved = max(abs(v / top - now[n]) for n, v in raw.items())
        now = {n: v / top for n, v in raw.items()}
        if moved < SETTLED:
            return {(k[1], k[2]): v / now[KEPT] for k, v in now.items() if k[0] == "key" and k != KEPT}
    raise RuntimeError(f"similarities of {sorted(gone)} and {sorted(new)} not settled after {ROUNDS} rounds")


def correspondences(similarity: dict[tuple[str, str], float]) -> list[tuple[str, str]]:
    """The pairs with ACCEPT or more that are consistent: each key once, the most similar first, then in order of names."""
    out: list[tuple[str, str]] = []
    for (a, b), v in sorted(similarity.items(), key=lambda x: (-round(x[1], 9), x[0])):
        if v >= ACCEPT and all(a != x and b != y for x, y in out):
            out.append((a, b))
    return out


def schema_changes(drops: DataFrame) -> DataFrame:
    """(feed, file_name, change_kind, field_name, new_name): what changes from a feed's file to the next by file_seq.

    added, removed, renamed (new_name is the new key, else empty) and type_changed (both sets of types, nulls aside, are
    not empty and differ). Only top-level keys of readable objects count; a key with only nulls is present; a feed's first
    file changes nothing; repeated lines change nothing. Files are folded to their keys by partial aggregates, and
    contents meet by candidate, so neither a feed nor a file with a large share of the lines is gathered; only the keys
    of one file that went or came are.
    """
    facts = cut(entries(drops))
    by = W.partitionBy("feed").orderBy("file_seq", "file_name")
    named = drops.where(F.col("feed").isNotNull() & F.col("file_name").isNotNull())
    files = named.groupBy("feed", "file_name").agg(F.min("file_seq").alias("file_seq"))
    files = files.select("feed", "file_name", F.lag("file_name").over(by).alias("before"), F.lead("file_name").over(by).alias("after"))
    types = facts.groupBy("feed", "file_name", "key").agg(F.array_sort(F.collect_set("type")).alias("types"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("inner")))).alias("inner"))
    at = types.join(files, ["feed", "file_name"])
    cur = at.where(F.col("before").isNotNull()).select("feed", F.col("file_name").alias("step"), "key", F.lit(None).cast("array<string>").alias("old"), F.col("types").alias("new"), "inner")
    old = at.where(F.col("after").isNotNull()).select("feed", F.col("after").alias("step"), "key", F.col("types").alias("old"), F.lit(None).cast("array<string>").alias("new"), "inner")
    keys = cut(cur.unionByName(old).groupBy("feed", "step", "key").agg(F.first("old", ignorenulls=True).alias("old"), F.first("new", ignorenulls=True).alias("new"), F.max("inner").alias("inner")))
    went = keys.where(F.col("new").isNull()).select("feed", "step", "key")
    came = keys.where(F.col("old").isNull()).select("feed", "step", "key")
    changed = keys.where((F.size("old") > 0) & (F.size("new") > 0) & (F.col("old") != F.col("new")))

    both = went.select("feed", "step").distinct().join(came.select("feed", "step").distinct(), ["feed", "step"])
    values = facts.where(F.col("said").isNotNull() & F.col("entity").isNotNull())

    def told(side: DataFrame, link: str, key: str, value: str) -> DataFrame:
        """The last content of each candidate under the keys of one side of the steps that lost and gained keys."""
        at = files.where(F.col(link).isNotNull()).select("feed", "file_name", (F.col("after") if link == "after" else F.col("file_name")).alias("step"))
        wanted = side.join(both, ["feed", "step"], "left_semi").join(at, ["feed", "step"])
        rows = values.join(wanted, ["feed", "file_name", "key"])
        last = rows.groupBy("feed", "step", "entity", "key").agg(F.max_by("said", F.struct("line_no", "said")).alias(value))
        return last.withColumnRenamed("key", key)

    met = told(went, "after", "a", "x").join(told(came, "before", "b", "y"), ["feed", "step", "entity"])
    said = met.groupBy("feed", "step", "a", "b").agg(
        F.count(F.lit(1)).alias("shared"), F.sum((F.col("x") == F.col("y")).cast("int")).alias("same"), F.count_distinct("y").alias("kinds")
    )
    none = lambda *names: [F.lit(None).cast(t).alias(n) for n, t in names]
    bag = (
        keys.join(both, ["feed", "step"], "left_semi").where(F.col("old").isNull() | F.col("new").isNull())
        .select("feed", "step", "key", "old", "new", "inner", *none(("a", "string"), ("b", "string"), ("shared", "bigint"), ("same", "bigint"), ("kinds", "bigint")))
        .unionByName(said.select("feed", "step", *none(("key", "string"), ("old", "array<string>"), ("new", "array<string>"), ("inner", "array<string>")), "a", "b", "shared", "same", "kinds"))
    )

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf.key.notna()]
        gone = {r.key: set(r.old) for r in own.itertuples() if r.new is None}
        new = {r.key: set(r.new) for r in own.itertuples() if r.old is None}
        agree = {(r.a, r.b): (int(r.shared), int(r.same), int(r.kinds)) for r in pdf[pdf.a.notna()].itertuples()}
        inner = {r.key: set(r.inner) for r in own.itertuples() if r.inner is not None}
        pairs = correspondences(flood(gone, new, agree, inner))
        return pd.DataFrame({"feed": pdf.feed.iloc[0], "step": pdf.step.iloc[0], "a": [a for a, _ in pairs], "b": [b for _, b in pairs]}, columns=["feed", "step", "a", "b"], dtype=object)

    # A number of partitions asked for is kept, while small ones would be run in one task.
    steps = bag.repartition(int(drops.sparkSession.conf.get("spark.sql.shuffle.partitions")), "feed", "step")
    renamed = cut(steps.groupBy("feed", "step").applyInPandas(match, "feed string, step string, a string, b string"))
    lost = went.join(renamed.select("feed", "step", F.col("a").alias("key")), ["feed", "step", "key"], "left_anti")
    found = came.join(renamed.select("feed", "step", F.col("b").alias("key")), ["feed", "step", "key"], "left_anti")

    def rows(df: DataFrame, kind: str, key: str = "key", to: Column | None = None) -> DataFrame:
        return df.select("feed", F.col("step").alias("file_name"), F.lit(kind).alias("change_kind"), F.col(key).alias("field_name"), (F.lit("") if to is None else to).alias("new_name"))

    return rows(found, "added").unionByName(rows(lost, "removed")).unionByName(rows(renamed, "renamed", "a", F.col("b"))).unionByName(rows(changed, "type_changed"))


def canonical_keys(drops: DataFrame, changes: DataFrame, prefer: tuple[str, ...] = ()) -> dict[str, str]:
    """Key to one key among those that renames tie together, a preferred one first, then the most used; for keys with a rename, at most MOST_KEYS."""
    links = changes.where(F.col("change_kind") == "renamed").select("field_name", "new_name").distinct()
    tied = star_components(links, "field_name", "new_name")
    used = entries(drops).groupBy("key").count()
    rows = tied.join(used, tied["id"] == used["key"], "left").select("id", "group_id", F.coalesce("count", F.lit(0)).alias("n")).limit(MOST_KEYS + 1).collect()
    if len(rows) > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} renamed keys")
    best: dict[str, tuple[bool, int, str]] = {}
    for r in rows:
        best[r.group_id] = min(best.get(r.group_id, (True, 1, "")), (r.id not in prefer, -r.n, r.id))
    return {r.id: best[r.group_id][2] for r in rows}


#: Fields of the consistent table and their types.
TARGET = {
    "candidateRef": "string", "candidateName": "string", "emailAddress": "string", "phoneNumber": "string", "currentEmployer": "string", "designation": "string",
    "skills": "array<string>", "totalYearsExperience": "double", "city": "string", "region": "string", "country": "string", "lastUpdated": "string",
}


_NUMBER = re.compile(r"\s*([+-]?\d+(?:\.\d+)?)\s*(?:[^\W\d_]+\.?\s*)?")


def number_of(v: object) -> float | None:
    """A number, or a text that is one number with at most a unit behind it; None for anything else, such as a range."""
    texts = leaves(v)
    m = _NUMBER.fullmatch(texts[0]) if len(texts) == 1 and not isinstance(v, bool) else None
    return float(m[1]) if m else None


def aligned(raw: str | None, names: dict[str, str], target: dict[str, str]) -> tuple[bool, dict[str, str], dict[str, list[str]], str | None]:
    """(readable, single values, lists, rest as JSON) of a line under the target fields.

    Nothing is lost: a field that has a value already, under another of its names, and a value that its type can't hold stay in
    rest under the key and in the form of the line. A text where a list is due stays one text, under a list of its own.
    """
    x = read_object(raw)
    single: dict[str, str] = {}
    lists: dict[str, list[str]] = {}
    rest = {}
    for k, v in (x or {}).items():
        field = names.get(k, k)
        kind, found = target.get(field), leaves(v)
        if kind is None or not found and v is not None and v != []:
            rest[k] = v
        elif not found:
            continue
        elif field in single or field in lists:
            rest[k] = v
        elif kind == "array<string>":
            if isinstance(v, str):
                single[field] = v
            else:
                lists[field] = found
        elif kind == "double":
            n = number_of(v)
            if n is None:
                rest[k] = v
            else:
                single[field] = repr(n)
        elif len(found) == 1:
            single[field] = found[0]
        else:
            rest[k] = v
    return x is not None, single, lists, json.dumps(rest, sort_keys=True, ensure_ascii=False) if rest else None


def consistent_table(drops: DataFrame, changes: DataFrame, target: dict[str, str] | None = None) -> DataFrame:
    """Every readable line once, in one schema: feed, file_name, line_no, the target fields, and all else as JSON in rest.

    Renamed keys are read under their canonical key; wrapped values are unwrapped; "23 years" becomes a number, "5-7 years" doesn't;
    packed texts become lists by the packed-field operator, whose model is learned from the whole column. Unreadable lines give
    no row. A second value of a field and a value that can't be cast are kept in rest, see aligned().
    """
    target = target or TARGET
    names = canonical_keys(drops, changes, tuple(target))

    @F.pandas_udf("struct<ok:boolean,single:map<string,string>,lists:map<string,array<string>>,rest:string>")
    def read_all(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([aligned(raw, names, target) for raw in s], columns=["ok", "single", "lists", "rest"])

    cols = ["feed", "file_name", "line_no"]
    lines = cut(spread(drops.select(*cols, "raw_json").distinct(), shuffled=True).select(*cols, read_all("raw_json").alias("x")).where("x.ok").select(*cols, "x.*"))
    for name in (n for n, kind in target.items() if kind == "array<string>"):
        lines = _unpacked(lines, name)

    def typed(name: str, kind: str) -> Column:
        if kind == "array<string>":
            return F.col("lists")[name].alias(name.lower())
        return F.col("single")[name].cast(kind).alias(name.lower())

    return lines.select(*cols, *[typed(n, k) for n, k in target.items()], "rest").distinct()


def _unpacked(lines: DataFrame, name: str) -> DataFrame:
    """lines with the packed texts of a field as lists; each distinct text is split once."""
    rows = lines.withColumn("__text", F.col("single")[name])
    texts = cut(rows.where(F.col("__text").isNotNull()).groupBy("__text").agg(F.count(F.lit(1)).alias("n")))
    split = unpack(texts.withColumn("__packed", F.col("__text")), "__packed", ["__text"], "v", learn_lattice(texts, "__text"))
    found = texts.join(split.groupBy("__text").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("a")), "__text")
    met = lookup(rows, found.select("__text", "n", F.transform("a", lambda x: x["v"]).alias("__list")), ["__text"], "n")
    more = F.when(F.col("__list").isNotNull(), F.map_concat("lists", F.create_map(F.lit(name), F.col("__list")))).otherwise(F.col("lists"))
    return met.withColumn("lists", more).drop("__text", "__list")
