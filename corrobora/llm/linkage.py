"""Problem 1: records of two tables that describe the same person, without a common key."""

from __future__ import annotations

import html

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.functions.values import NULL_MARKS
from corrobora.llm.groups import star_edges
from corrobora.operators.layout import spread
from corrobora.operators.packed import edits
from corrobora.operators.skew import lookup
from corrobora.session import cut

#: An address or number that more different family names than this share is context, like an employer: it only counts together with names.
CONTEXT = 12
#: Larger blocks are compared in tiles of two slices of about this many people, so all pairs meet and no task holds a block.
SLICE = 200
#: A pair is kept if its weight is at least this share of the heaviest pair of either of its records.
KEEP = 0.25
#: Log odds from which a pair is a match, and to which names contradict each other.
MATCH, CONTRARY = 3.5, -5.0
#: How much of its neighbours' log odds flows into a pair each round, and the change below which it has settled.
FLOW, SETTLED = 0.3, 0.01
#: Titles, degrees and legal forms that are no part of a name.
TITLES = frozenset("dr mr mrs ms mx miss prof sir dame herr frau mme m".split())
DEGREES = frozenset("pmp mba phd cpa md msc bsc ma ba jr sr ii iii cfa esq dds rn pe".split())
LEGAL = re.compile(r"(?:[\s,]+(?:ltd|limited|inc|incorporated|llc|gmbh|plc|co|corp|corporation|company|group|holding|holdings|ag|sa|sas|bv|kg|pty)\.?)+$")
_ADDRESS = re.compile(r"([a-z0-9._%+\-]+)@([a-z0-9.\-]+)")


def plain(text: str) -> str:
    """Compatibility characters, case and accents aside."""
    return "".join(c for c in unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", html.unescape(text)).casefold()) if not unicodedata.combining(c))


def value(text: str | None) -> str | None:
    s = text.strip() if text else ""
    return None if s.lower() in NULL_MARKS else s


def name_tokens(raw: str | None) -> list[str]:
    """Words of a name, given name first: remarks, titles and degrees aside, "Last, First" turned round."""
    s = value(raw)
    if s is None:
        return []
    s = re.sub(r"\([^()]*\)|\[[^\[\]]*\]", " ", plain(s))
    parts = [re.findall(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*", p) for p in s.split(",")]
    parts = [_untitled(p) for i, p in enumerate(parts) if p and (not i or any(w not in DEGREES for w in p))]
    if len(parts) == 2:
        parts.reverse()
    words = [w for p in parts for w in p]
    while len(words) > 2 and words[-1] in DEGREES:
        words = words[:-1]
    return words


def _untitled(words: list[str]) -> list[str]:
    while len(words) > 1 and words[0] in TITLES:
        words = words[1:]
    return words


def mailboxes(*raw: str | None) -> list[str]:
    """All addresses as name@domain, without +tags, however the address is wrapped."""
    out: list[str] = []
    for r in raw:
        if (s := value(r)) is not None:
            s = re.sub(r"\s*[\[({]\s*at\s*[\])}]\s*|\s+at\s+", "@", re.sub(r"\s*[\[({]\s*dot\s*[\])}]\s*", ".", plain(s)))
            out += [f"{m.group(1).split('+')[0].strip('.-_')}@{m.group(2).strip('.-')}" for m in _ADDRESS.finditer(s.replace("mailto:", " "))]
    return sorted({x for x in out if not x.startswith("@")})


def phone_digits(raw: str | None) -> list[str]:
    """The last ten digits of each number, without extension; shorter numbers as they are, from seven digits."""
    s = value(raw)
    out = []
    for part in re.split(r"[;,|]|\s/\s|\bor\b", s.lower()) if s else []:
        d = re.sub(r"\D", "", re.sub(r"(?:ext\.?|extension|x|#)\s*\d+.*$", "", part))
        if len(d) >= 7:
            out.append(d[-10:])
    return sorted(set(out))


def employer(raw: str | None) -> str:
    s = value(raw)
    return LEGAL.sub("", " ".join(plain(s).split()).strip(" .,")).strip(" .,") if s else ""


def normalised(names: pd.Series, mails: list[pd.Series], phones: pd.Series, employers: pd.Series) -> pd.DataFrame:
    rows = [
        {"name": name_tokens(n), "mail": mailboxes(*m), "phone": phone_digits(p), "employer": employer(e)}
        for n, m, p, e in zip(names, zip(*mails, strict=True), phones, employers, strict=True)
    ]
    return pd.DataFrame(rows, columns=["name", "mail", "phone", "employer"])


_FIELDS = "struct<name:array<string>,mail:array<string>,phone:array<string>,employer:string>"


def people(table: DataFrame, key: str, name: str, mails: list[str], phone: str, company: str) -> DataFrame:
    """(record_id, name, mail, phone, employer) in one form. Missing columns of any row give empty values; keyless rows are left out."""

    @F.pandas_udf(_FIELDS)
    def norm(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for n, p, e, *m in batches:
            yield normalised(n, m, p, e)

    t = table.where(F.col(key).isNotNull()).select(F.col(key).alias("record_id"), *[F.col(c).alias(f"c{i}") for i, c in enumerate([name, phone, company, *mails])])
    return spread(t).select("record_id", norm(*[F.col(f"c{i}") for i in range(3 + len(mails))]).alias("x")).select("record_id", "x.*")


def identifiers(c: str = "") -> list[Column]:
    """Attributes that alone may lead to a person: mailbox, end of the mailbox with a name, phone."""
    name, mail, phone = F.col(f"{c}name"), F.col(f"{c}mail"), F.col(f"{c}phone")
    last = F.substring(F.coalesce(F.get(name, F.size(name) - 1), F.lit("")), 1, 2)
    mail = F.array_distinct(F.transform(mail, lambda m: F.substring_index(m, "@", 1)))
    return [
        F.transform(mail, lambda m: F.concat(F.lit("e:"), m)),
        F.transform(F.filter(mail, lambda m: F.length(m) >= 6), lambda m: F.concat(F.lit("t:"), F.substring(m, -3, 3), F.lit("|"), last)),
        F.transform(phone, lambda p: F.concat(F.lit("p:"), p)),
    ]


def signatures(context: Column) -> Column:
    """A context together with what two spellings of one name have in common: one name whole, an end of the other."""
    name = F.col("name")
    a, b = F.get(name, F.lit(0)), F.get(name, F.size(name) - 1)

    def two(tag: str, whole: Column, end: Column) -> Column:
        return F.concat(F.lit(f"{tag}:"), context, F.lit("|"), whole, F.lit("|"), end)

    keys = F.array(
        two("f1", a, F.substring(b, 1, 3)), two("f2", a, F.substring(b, -3, 3)), two("l1", b, F.substring(a, 1, 1)), two("l2", b, F.substring(a, -2, 2)),
        two("f1", b, F.substring(a, 1, 3)),
    )
    return F.when((F.size(name) >= 2) & (context != ""), keys).otherwise(F.array().cast("array<string>"))


def tiled(blocks: DataFrame) -> DataFrame:
    """(x, y, w): every pair of nodes of a block once, x < y. blocks: k, node, size, w.

    A block falls into slices of about SLICE nodes by hash; each two slices, and each slice with itself, are a tile.
    """
    slices = F.ceil(F.col("size") / SLICE).cast("int")
    own = blocks.select("k", "node", "w", slices.alias("n")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    at = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = at.select("k", "w", "node", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    a, b = at.withColumnsRenamed({"node": "x", "own": "ox"}), at.drop("w").withColumnsRenamed({"node": "y", "own": "oy"})
    met = a.join(b, ["k", "i", "j"]).where((F.col("x") < F.col("y")) & ((F.col("i") == F.col("j")) | (F.col("ox") != F.col("oy"))))
    return met.select("x", "y", "w")


def short_met(blocks: DataFrame) -> DataFrame:
    """(x, y, w): every pair of nodes of a block of which at least one is short, once, x < y. blocks: k, node, short, size, w.

    Short nodes go to each slice of the block; the others stay in theirs.
    """
    slices = F.ceil(F.col("size") / SLICE).cast("int")
    own = blocks.select("k", "node", "short", "w", slices.alias("n"))
    a = own.where("short").select("k", F.col("node").alias("a"), "w", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    b = own.select("k", F.col("node").alias("b"), "short", F.pmod(F.xxhash64("node"), F.col("n")).cast("int").alias("i"))
    met = a.join(b, ["k", "i"]).where((F.col("a") < F.col("b")) | ((F.col("a") > F.col("b")) & ~F.col("short")))
    return met.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "w")


def candidate_pairs(nodes: DataFrame, own: DataFrame) -> DataFrame:
    """(x, y, weight): pairs of nodes that share an attribute, x < y, heavier the rarer what they share, pruned by meta-blocking.

    nodes: node, name, mail, phone, employer, one per distinct person description; own: the same with own_identifiers only.
    Identifiers that more than CONTEXT family names share, and employers, are no blocks by themselves: nobody is the same
    person by an employer or a shared mailbox alone, so they are joined with both names first. Who has fewer than two names
    meets everybody with the shared identifier, and ends of own mailboxes are blocks whoever else has them. All pairs of a
    block meet, however large it is.
    """
    last = F.coalesce(F.get("name", F.size("name") - 1), F.lit(""))
    had = nodes.select("node", "name", last.alias("last"), F.explode(F.array_distinct(F.concat(*identifiers()))).alias("k"))
    counts = had.groupBy("k", "last").agg(F.count(F.lit(1)).alias("n")).groupBy("k").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("names"))
    counted = cut(lookup(had, counts, ["k"], "n"))
    strong = counted.where(F.col("names") <= CONTEXT).select("node", "k")
    context = counted.where(F.col("names") > CONTEXT)
    ends = own.select("node", F.explode(identifiers()[1]).alias("k")).join(context.select("node", "k"), ["node", "k"], "left_semi").select("node", F.concat(F.lit("o"), "k").alias("k"))
    shared = context.select("node", F.explode(signatures(F.col("k"))).alias("k"))
    work = nodes.select("node", F.explode(signatures(F.concat(F.lit("c:"), F.col("employer")))).alias("k")).where(~F.col("k").contains(":c:|"))
    keys = cut(strong.unionByName(ends).unionByName(shared).unionByName(work).distinct())
    total = nodes.count()
    weight = F.log(F.lit(float(max(total, 2))) / F.col("size")) + 0.1
    sizes = keys.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    at = lookup(keys, sizes.withColumn("size", F.col("n")), ["k"], "n", keys.count(), "inner").where(F.col("size").isNotNull())
    short = context.groupBy("k").agg(F.count(F.lit(1)).alias("size"), F.count_if(F.size("name") < 2).alias("n_short")).where("n_short > 0")
    around = lookup(context.select("node", "k", (F.size("name") < 2).alias("short")), short.select("k", "size", F.col("size").alias("n")), ["k"], "n").where(F.col("size").isNotNull())
    blocks = at.withColumn("w", weight)
    pairs = tiled(blocks).unionByName(short_met(around.withColumn("w", weight))).groupBy("x", "y").agg(F.sum("w").alias("weight"))
    pairs = cut(pairs)
    top = pairs.select("x", "weight").unionByName(pairs.select(F.col("y").alias("x"), "weight")).groupBy("x").agg(F.max("weight").alias("top"))
    at = pairs.join(top.withColumnRenamed("top", "tx"), "x").join(top.select(F.col("x").alias("y"), F.col("top").alias("ty")), "y")
    return at.where((F.col("weight") >= KEEP * F.col("tx")) | (F.col("weight") >= KEEP * F.col("ty"))).select("x", "y", "weight")


def _token(a: str, b: str) -> float:
    """Agreement of two name words: 2 same, 1.2 a typo apart, 0.8 an initial, -8 different."""
    if a == b:
        return 2.0 if len(a) > 1 else 0.8
    if min(len(a), len(b)) == 1:
        return 0.8 if a[0] == b[0] else -8.0
    most = 1 if min(len(a), len(b)) < 5 else 2
    return 1.2 if edits(a, b, most) <= most else -8.0


def name_score(a: list[str], b: list[str]) -> float:
    """Log odds of two names: given and family name agree in either order; an absent name says nothing."""
    if not a or not b:
        return 0.0
    if len(a) == 1 or len(b) == 1:
        return max(_token(x, y) for x in a for y in b) / 2
    straight = (_token(a[0], b[0]), _token(a[-1], b[-1]))
    turned = (_token(a[0], b[-1]), _token(a[-1], b[0]))
    return max(sum(p) if min(p) > 0 else min(p) for p in (straight, turned)) * (0.625 if max(sum(straight), sum(turned)) > 0 else 1)


def mail_tails(box: str, names: list[str]) -> set[str]:
    """What is left of a mailbox without the names, and without an initial before it: often a number of its owner."""
    t = re.sub(r"[._\-]", "", box)
    for w in sorted({x for x in names if len(x) > 1}, key=lambda x: (-len(x), x)):
        t = t.replace(w, "", 1)
    out = {t}
    if len(t) > 1 and t[0] in {x[0] for x in names}:
        out.add(t[1:])
    return out - {""}


def mail_score(a: list[str], b: list[str], names: list[str]) -> float:
    """Log odds of two sets of own addresses: one in common, one with the same name before the @ or the same end of it besides
    the names of both records, a typo apart, or different ones.

    At another domain the same name before the @ says as much as the address only if more is in it than the names: of people
    of one name many call themselves by it. A typo in the end itself says nothing either way, as neighbours in a numbering
    differ so too.
    """
    if not a or not b:
        return 0.0
    if set(a) & set(b):
        return 7.0
    a, b = [x.partition("@")[0] for x in a], [y.partition("@")[0] for y in b]
    if same := set(a) & set(b):
        return 7.0 if any(len(e) > 1 for x in same for e in mail_tails(x, names)) else 0.5
    ends = {e for x in a for e in mail_tails(x, names)} & {e for y in b for e in mail_tails(y, names)}
    if any(len(e) > 1 for e in ends) or any(len(x) >= 6 and len(y) >= 6 and x[-3:] == y[-3:] for x in a for y in b):
        return 5.0
    if ends:
        return 2.0
    near = any(min(len(x), len(y)) >= 8 and edits(x, y, 2) <= 2 for x in a for y in b)
    return 0.0 if near else -4.0


def phone_score(a: list[str], b: list[str]) -> float:
    if not a or not b:
        return 0.0
    if set(a) & set(b):
        return 4.0
    return 2.0 if any(edits(x, y, 1) <= 1 for x in a for y in b) else -3.0


def employer_score(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    return 2.0 if a == b or edits(a, b, 2) <= 2 else -0.7


def scored(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs with the log odds of each, from names, own mailboxes and phones, and employers."""

    @F.pandas_udf("double")
    def odds(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in batches:
            out = []
            for n1, m1, p1, e1, n2, m2, p2, e2 in zip(*cols, strict=True):
                n = name_score(list(n1), list(n2))
                m = mail_score(list(m1), list(m2), [*n1, *n2])
                p = phone_score(list(p1), list(p2))
                e = employer_score(e1, e2)
                if m == -4.0 and p == 4.0 and e > 0 and n > 0:
                    m = -2.0
                out.append(n + m + p + e)
            yield pd.Series(out)

    a = nodes.select(F.col("node").alias("x"), *[F.col(c).alias(f"x_{c}") for c in ("name", "mail", "phone", "employer")])
    b = nodes.select(F.col("node").alias("y"), *[F.col(c).alias(f"y_{c}") for c in ("name", "mail", "phone", "employer")])
    cols = [f"{s}_{c}" for s in "xy" for c in ("name", "mail", "phone", "employer")]
    return pairs.join(a, "x").join(b, "y").select("x", "y", "weight", odds(*cols).alias("s"))


def own_identifiers(nodes: DataFrame) -> DataFrame:
    """nodes without the mailboxes and phones that more than CONTEXT different family names share: these are nobody's own."""
    last = F.coalesce(F.get("name", F.size("name") - 1), F.lit(""))
    long = nodes.select("node", last.alias("last"), F.explode(F.concat(F.transform("mail", lambda m: F.concat(F.lit("e:"), m)), F.transform("phone", lambda p: F.concat(F.lit("p:"), p)))).alias("k"))
    counts = long.groupBy("k", "last").agg(F.count(F.lit(1)).alias("n")).groupBy("k").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("names"))
    kept = lookup(long, counts, ["k"], "n").where(F.col("names") <= CONTEXT)
    sets = kept.groupBy("node").agg(
        F.array_sort(F.collect_set(F.when(F.col("k").startswith("e:"), F.substring("k", 3, 1000)))).alias("mail"),
        F.array_sort(F.collect_set(F.when(F.col("k").startswith("p:"), F.substring("k", 3, 1000)))).alias("phone"),
    )
    none = F.array().cast("array<string>")
    return nodes.drop("mail", "phone").join(sets, "node", "left").withColumns({"mail": F.coalesce("mail", none), "phone": F.coalesce("phone", none)})


def labelled(edges: DataFrame) -> DataFrame:
    """edges with the groups gx, gy that matches tie their ends to; an end without a match is its own group."""
    ties = star_edges(edges.where(F.col("s") >= MATCH).select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")))
    at = edges.drop("gx", "gy")
    for end in ("x", "y"):
        at = at.join(ties.select(F.col("u").alias(end), F.col("v").alias(f"g{end}")), end, "left").withColumn(f"g{end}", F.coalesce(f"g{end}", end))
    return at


def refined(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """edges (x, y, weight, s) with their groups gx, gy and s after the neighbours have spoken, once that is stable.

    Pairs between the same two groups are neighbours: those that speak for a link (log odds above 0) but not enough each gain
    FLOW of the mean of the others, round by round, so several half-sure pairs sustain each other. Pairs within a group are
    neighbours where they share a record: a tie loses FLOW of what a contradiction (CONTRARY or less) at either end says
    against the group, so a chain breaks at its weakest tie. Pairs only rise or only fall; whenever some become or cease to be
    matches, groups are made anew.
    """
    now = cut(labelled(edges.withColumns({"s0": F.col("s"), "fell": F.lit(False)})))
    for _ in range(max_rounds):
        low, high = F.least("gx", "gy").alias("a"), F.greatest("gx", "gy").alias("b")
        open_ = now.where((F.col("gx") != F.col("gy")) & (F.col("s0") > 0) & ~F.col("fell"))
        between = open_.groupBy(low, high).agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("sum")).where("n > 1")
        against = now.where((F.col("gx") == F.col("gy")) & (F.col("s0") <= CONTRARY))
        said = against.select(F.explode(F.array("x", "y")).alias("end"), F.col("gx").alias("g"), "s0").groupBy("g", "end").agg(F.min("s0").alias("no"))
        up = open_.select("x", "y", "s", "s0", low, high).join(between, ["a", "b"]).select("x", "y", (F.col("s0") + FLOW * (F.col("sum") - F.col("s")) / (F.col("n") - 1)).alias("to"), F.lit(False).alias("down"))
        ties = now.where((F.col("gx") == F.col("gy")) & (F.col("s") >= MATCH)).select("x", "y", "s0", F.col("gx").alias("g"), F.explode(F.array("x", "y")).alias("end"))
        down = ties.join(said, ["g", "end"]).groupBy("x", "y").agg(F.min(F.col("s0") + FLOW * F.col("no")).alias("to")).withColumn("down", F.lit(True))
        moves = cut(up.unionByName(down).join(now.select("x", "y", "s"), ["x", "y"]).where(F.abs(F.col("to") - F.col("s")) > SETTLED).where((F.col("to") > F.col("s")) | F.col("down")))
        crossing = moves.agg(F.count(F.lit(1)), F.count_if((F.col("to") >= MATCH) != (F.col("s") >= MATCH))).first()
        if not crossing[0]:
            return now
        moved = now.join(moves.select("x", "y", "to", "down"), ["x", "y"], "left")
        moved = moved.withColumns({"s": F.coalesce("to", "s"), "fell": F.col("fell") | F.coalesce("down", F.lit(False))}).drop("to", "down")
        now = cut(labelled(cut(moved)) if crossing[1] else moved, instead_of=now)
    raise RuntimeError(f"neighbour similarities not settled after {max_rounds} rounds")


def linked_people(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id, confidence): every pair of a left and a right record that describe the same person.

    left, right: record_id, name, mail, phone, employer as from people(). Records that say exactly the same form one node, so
    copies are compared once and come back at the end. All pairs across a group come out, with the confidence of their own
    edge or, if they are tied through others only, of the weakest tie of their group. Empty tables give no rows;
    records without any value match nothing; repeated record ids are one.
    """
    cols = ("name", "mail", "phone", "employer")
    all_ = left.select("record_id", *cols, F.lit(0).alias("side")).unionByName(right.select("record_id", *cols, F.lit(1).alias("side")))
    all_ = all_.where((F.size("name") > 0) | (F.size("mail") > 0) | (F.size("phone") > 0))
    all_ = cut(all_.withColumn("said", F.substring(F.sha2(F.to_json(F.struct(*cols)), 256), 1, 32)))
    nodes = cut(all_.groupBy("said").agg(*[F.first(c).alias(c) for c in cols]).withColumn("node", F.monotonically_increasing_id()))
    copies = all_.groupBy("said").agg(F.count(F.lit(1)).alias("n")).join(nodes.select("said", "node"), "said")
    records = lookup(all_.select("record_id", "said", "side"), copies, ["said"], "n").select("record_id", "node", "side").distinct()
    nodes = nodes.drop("said")
    own = cut(own_identifiers(nodes))
    final = refined(cut(scored(candidate_pairs(nodes, own), own)))
    sure = cut(final.where(F.col("s") >= MATCH).select("x", "y", "s", F.col("gx").alias("g")))
    home = sure.select(F.explode(F.array("x", "y")).alias("node"), "g").distinct()
    weakest = sure.groupBy("g").agg(F.min("s").alias("weakest"))
    member = cut(records.join(home, "node", "left").withColumn("g", F.coalesce("g", "node")))
    met = across(member.where("side = 0").drop("side"), member.where("side = 1").drop("side"))
    met = met.withColumns({"x": F.least("na", "nb"), "y": F.greatest("na", "nb")})
    tied = met.join(sure.select("x", "y", "s"), ["x", "y"], "left").join(weakest, "g", "left")
    odds = F.when(F.col("x") == F.col("y"), F.lit(9.0)).otherwise(F.coalesce("s", "weakest"))
    return tied.select("left_id", "right_id", F.round(1 / (1 + F.exp(-odds)), 4).alias("confidence"))


def across(left: DataFrame, right: DataFrame) -> DataFrame:
    """(g, left_id, na, right_id, nb): all pairs of a left and a right member of each group, large groups in slices of the left side."""
    slices = left.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / (10 * SLICE)).cast("int").alias("n"))
    own = F.pmod(F.xxhash64("record_id"), F.coalesce("n", F.lit(1))).cast("int")
    big = slices.where("n > 1")
    a = left.join(big, "g", "left").select("g", own.alias("i"), F.col("record_id").alias("left_id"), F.col("node").alias("na"))
    b = right.join(big, "g", "left").select("g", F.explode(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1)).alias("i"), F.col("record_id").alias("right_id"), F.col("node").alias("nb"))
    return a.join(b, ["g", "i"]).drop("i")


def ats_people(ats: DataFrame) -> DataFrame:
    return people(ats, "record_id", "candidatename", ["emailaddress", "email_id"], "phonenumber", "currentemployer")


def roster_people(roster: DataFrame) -> DataFrame:
    return people(roster, "record_id", "name", ["email"], "phone", "current_company")
