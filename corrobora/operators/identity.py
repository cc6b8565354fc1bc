"""Identity: keys of records, guarded union of records that share them, clusters, refusals and flags."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.functions import contacts
from corrobora.functions.dictionaries import UNSTRUCTURED
from corrobora.functions.text import unaccent, unaccent_col
from corrobora.operators.components import min_label_components
from corrobora.session import cut

#: Kinds of keys from the strongest.
STRENGTH = {"email": 0, "phone": 1, "link": 2, "soft": 3}


def name_tokens(name: str) -> list[str]:
    return [t for t in re.split(r"[^\w]+", unaccent(name)) if t]


def names_compatible(a: list[str], b: list[str]) -> bool:
    """Two token lists agree in a token or an initial; an empty one contradicts nothing."""
    return not a or not b or any(x == y or (len(x) == 1 and y.startswith(x)) or (len(y) == 1 and x.startswith(y)) for x in a for y in b)


def names_compatible_col(a: Column, b: Column) -> Column:
    """names_compatible over two columns of token arrays, by nested higher-order functions."""
    one = lambda x, y: (x == y) | ((F.length(x) == 1) & y.startswith(x)) | ((F.length(y) == 1) & x.startswith(y))
    return (F.size(a) <= 0) | (F.size(b) <= 0) | F.exists(a, lambda x: F.exists(b, lambda y: one(x, y)))


def record_keys(atoms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(record_id, kind, key) and (record_id, flag).

    Strong keys are e-mail, phone and profile-link keys; a record without any may use its first name with its first current
    company. A free-text source with two keys of a kind speaks of several people: it is flagged and has no key at all.
    """
    value = F.col("value")
    of = lambda field: F.col("field_path") == field
    kind = F.when(of("emails"), "email").when(of("phones"), "phone").when(F.col("field_path").isin("links.linkedin", "links.github"), "link")
    key = F.when(of("emails"), contacts.email_match_key(value)).when(of("phones"), value).otherwise(contacts.url_match_key(value))
    strong = atoms.where(kind.isNotNull()).select("record_id", "source_type", "field_path", kind.alias("kind"), key.alias("key")).distinct()
    many = strong.where(F.col("source_type").isin(*UNSTRUCTURED)).groupBy("record_id", "field_path").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("record_id").distinct()
    job = F.from_json("value", "company string, is_current boolean")
    first = F.struct("order_index", "value", "method")
    names = atoms.where(of("full_name")).groupBy("record_id").agg(F.min_by("value", first).alias("name"))
    jobs = atoms.where(of("experience")).withColumn("j", job).where(F.col("j.is_current") & (F.length("j.company") > 0)).groupBy("record_id").agg(F.min_by("j.company", first).alias("company"))
    soft = names.join(jobs, "record_id").join(strong.select("record_id").distinct(), "record_id", "left_anti")
    soft = soft.select("record_id", F.lit("soft").alias("kind"), F.concat(unaccent_col(F.col("name")), F.lit("|"), unaccent_col(F.col("company"))).alias("key"))
    keys = strong.select("record_id", "kind", "key").distinct().join(many, "record_id", "left_anti").unionByName(soft)
    return keys, many.select("record_id", F.lit("multi_identity_source").alias("flag"))


@dataclass
class Identity:
    """members: record_id, cluster_id. clusters: cluster_id, record_ids, match_keys_used, flags. refusals: records, key, reason."""

    members: DataFrame
    clusters: DataFrame
    refusals: DataFrame
    record_flags: DataFrame


def refused_neighbours(who: Identity) -> DataFrame:
    """(cluster_id, other_id, key): clusters that a refused union would have tied, from either side."""
    home = who.members
    pairs = who.refusals.select("key", F.explode(F.array(F.struct(F.get("records", F.lit(0)).alias("a"), F.get("records", F.lit(1)).alias("b")), F.struct(F.get("records", F.lit(1)).alias("a"), F.get("records", F.lit(0)).alias("b")))).alias("p"))
    a = pairs.select("key", "p.*").join(home.select(F.col("record_id").alias("a"), "cluster_id"), "a")
    return a.join(home.select(F.col("record_id").alias("b"), F.col("cluster_id").alias("other_id")), "b").select("cluster_id", "other_id", "key").distinct()


_RESULT = "array<struct<what:string,id:string,cluster:string,keys:array<string>,records:array<string>,key:string,rank:int,other:string,reason:string>>"


def _guarded(rows: list[dict]) -> list[dict]:
    """Unions within one component: keys by strength and value; of a key the smallest record is compared with each other one."""
    names = {r["record_id"]: [name_tokens(n) for n in r["names"]] for r in rows}
    home = {r: r for r in names}
    members: dict[str, list[str]] = {r: [r] for r in names}
    used: dict[str, set[str]] = {r: set() for r in names}
    groups: dict[tuple[int, str, str], set[str]] = {}
    for r in rows:
        groups.setdefault((STRENGTH[r["kind"]], r["key"], r["kind"]), set()).add(r["record_id"])
    out = []
    for (rank, key, kind), group in sorted(groups.items()):
        base, *others = sorted(group)
        for other in others:
            a, b = home[base], home[other]
            if a == b:
                continue
            label = f"{kind}:{key}"
            if all(names_compatible(x, y) for i in members[a] for j in members[b] for x in names[i] for y in names[j]):
                keep, gone = min(a, b), max(a, b)
                for r in members[gone]:
                    home[r] = keep
                members[keep] += members.pop(gone)
                used[keep] |= used.pop(gone) | {label}
            else:
                out.append({"what": "refusal", "records": sorted((a, b)), "key": label, "rank": rank, "other": other, "reason": "suspect_shared_identifier"})
    for root, ids in members.items():
        out += [{"what": "member", "id": r, "cluster": root, "keys": sorted(used[root])} for r in ids]
    empty = dict.fromkeys(("what", "id", "cluster", "keys", "records", "key", "rank", "other", "reason"))
    return [empty | r for r in out]


def _guarded_all(rows: str) -> Column:
    @F.pandas_udf(_RESULT)
    def udf(components: pd.Series) -> pd.Series:
        return pd.Series([_guarded(list(c)) for c in components], dtype=object)

    return udf(rows)


def resolve(atoms: DataFrame) -> Identity:
    """Clusters of records. Every record with an atom is in one; the smallest record id names it.

    Unions never leave a component of the record-key graph, so components are found distributed and each is resolved in one
    task in the exact order of key strength, key and record; a chain of shared keys bounds that task.
    """
    keys, flags = record_keys(atoms)
    keys = cut(keys)
    records = atoms.select("record_id").distinct()
    linked = keys.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = keys.join(linked.drop("n"), ["kind", "key"])
    comp = min_label_components(shared.select("record_id", F.concat_ws(":", "kind", "key").alias("hub")), "record_id", "hub")
    names = atoms.where(F.col("field_path") == "full_name").groupBy("record_id").agg(F.array_sort(F.collect_set("value")).alias("names"))
    rows = shared.join(comp, "record_id").join(names, "record_id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    each = rows.groupBy("component").agg(F.collect_list(F.struct("record_id", "kind", "key", "names")).alias("rows"))
    done = cut(each.select(F.explode(_guarded_all("rows")).alias("x")).select("x.*"))
    grouped = done.where("what = 'member'").select(F.col("id").alias("record_id"), F.col("cluster").alias("cluster_id"), F.col("keys").alias("match_keys_used"))
    all_ = records.join(grouped, "record_id", "left").select("record_id", F.coalesce("cluster_id", "record_id").alias("cluster_id"), F.coalesce("match_keys_used", F.array().cast("array<string>")).alias("match_keys_used"))
    members = cut(all_)
    flagged = members.join(flags, "record_id", "left")
    clusters = flagged.groupBy("cluster_id").agg(F.array_sort(F.collect_set("record_id")).alias("record_ids"), F.max("match_keys_used").alias("match_keys_used"), F.collect_set("flag").alias("f"))
    soft = (F.size("record_ids") > 1) & F.exists("match_keys_used", lambda k: k.startswith("soft:"))
    clusters = clusters.select("cluster_id", "record_ids", "match_keys_used", F.array_sort(F.when(soft, F.array_append("f", "soft_key_merge")).otherwise(F.col("f"))).alias("flags"))
    refusals = done.where("what = 'refusal'").select("records", "key", "reason", "rank", "other")
    return Identity(members.select("record_id", "cluster_id"), clusters, refusals, flags)
