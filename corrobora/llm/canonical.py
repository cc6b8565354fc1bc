"""Problem 4: freely typed values mapped to the entries of a reference list."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.functions.values import value_or_null
from corrobora.operators.layout import spread
from corrobora.operators.packed import unpack
from corrobora.operators.skew import lookup
from corrobora.session import cut

UNMATCHED = "unmatched"
#: Words of degree that may stand before or after an entry without being part of it.
DEGREES = ("advanced", "basic", "strong", "some", "good", "solid", "expert", "senior", "junior", "intermediate", "working", "beginner", "fluent", "experienced", "the")
#: Entries of a reference list that are sent to every executor; longer lists are met by a shuffle.
MOST_ENTRIES = 200_000
_VERSION = re.compile(r"\s+v?\d+(?:\.(?:\d+|x))*$")
_PARTS = re.compile(r"\s*[,;|]\s*|\s+[-–—/]\s+")
_REMARK = re.compile(r"\s*[(\[（]([^()\[\]（）]*)[)\]）]\s*")


def folded(text: str) -> str:
    """Compatibility characters, case and runs of blanks aside."""
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


def bare(text: str) -> str:
    """Letters, digits and signs that tell entries apart, accents, blanks and joining marks aside."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return re.sub(r"[\s_\-.,/'’]+", "", plain)


def bound(length: int) -> int:
    """Edits allowed for an entry of this many characters."""
    return 0 if length < 4 else 1 if length < 7 else 2


def deletions(word: str, most: int) -> set[str]:
    """word and all texts made by deleting up to most of its characters."""
    out = {word}
    for n in range(1, min(most, len(word)) + 1):
        out.update("".join(c for i, c in enumerate(word) if i not in gone) for gone in map(set, combinations(range(len(word)), n)))
    return out


#: Keys that lie side by side on a keyboard, row by row.
_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
_NEAR = {frozenset(r[i : i + 2]) for r in _ROWS for i in range(len(r) - 1)}


def weighted_distance(a: str, b: str) -> tuple[int, float]:
    """Damerau-Levenshtein distance with unrestricted counts of edits, and its weight.

    A swap, a doubled letter or a neighbouring key weighs less than another edit; a changed first letter weighs more.
    """
    rows: list[list[tuple[int, float]]] = [[(j, float(j)) for j in range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row = [(i, float(i))]
        for j, y in enumerate(b, 1):
            first = 0.3 if i == 1 or j == 1 else 0.0
            up, left, across = rows[i - 1][j], row[j - 1], rows[i - 1][j - 1]
            drop = 0.7 if i > 1 and x == a[i - 2] else 1.0 + first
            add = 0.7 if j > 1 and y == b[j - 2] else 1.0 + first
            swap = 0 if x == y else (0.9 if frozenset((x, y)) in _NEAR else 1.0) + first
            options = [(up[0] + 1, up[1] + drop), (left[0] + 1, left[1] + add), (across[0] + (x != y), across[1] + swap)]
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                turned = rows[i - 2][j - 2]
                options.append((turned[0] + 1, turned[1] + 0.8))
            row.append(min(options))
        rows.append(row)
    return rows[-1][-1]


class Dictionary:
    """Symmetric-delete index of a reference list: alias to entry.

    Every alias is filed under all texts made by deleting up to bound(length) of its characters; a query looks up its own
    deletions, so all aliases within the bound are met without comparing with the list. They are ranked by weighted
    distance, then by how often the entry occurs in the data, then by the entry itself.
    """

    def __init__(self, aliases: dict[str, str], frequency: dict[str, int] | None = None):
        self.frequency = frequency or {}
        self.exact = {folded(a): c for a, c in sorted(aliases.items())}
        self.plain: dict[str, set[str]] = {}
        for a, c in self.exact.items():
            self.plain.setdefault(bare(a), set()).add(c)
        self.index: dict[str, set[str]] = {}
        for a in self.plain:
            for d in deletions(a, bound(len(a))):
                self.index.setdefault(d, set()).add(a)
        self.longest = max(map(len, self.plain), default=0)
        self.memo: dict[str, str] = {}

    def _best(self, entries: set[str]) -> str:
        return min(entries, key=lambda c: (-self.frequency.get(c, 0), c))

    def known(self, text: str) -> str | None:
        """The entry that the text is, spelling marks aside."""
        if text in self.exact:
            return self.exact[text]
        b = bare(text)
        return self._best(self.plain[b]) if len(b) > 1 and b in self.plain else None

    def near(self, text: str) -> str | None:
        """The entry that the text is but for a few edits."""
        b = bare(text)
        if len(b) > self.longest + 2:
            return None
        met = {a for d in deletions(b, min(2, bound(len(b) + 1))) for a in self.index.get(d, ())}
        found = []
        for a in met:
            n, w = weighted_distance(b, a)
            if n <= bound(min(len(a), len(b) + 1)):
                c = self._best(self.plain[a])
                found.append((w, -self.frequency.get(c, 0), c))
        return min(found)[2] if found else None

    def forms(self, text: str) -> list[str]:
        """The text and what is left of it without remark, version, end marks and words of degree, then its remarks."""
        out = [text]
        core = _REMARK.sub(" ", text).strip()
        for t in (text, core):
            t = t.strip().rstrip("!?…;:,* ").rstrip(".").strip()
            out += [t, _VERSION.sub("", t).strip()]
        s = out[-1]
        for w in DEGREES:
            if s.startswith(w + " "):
                out.append(_VERSION.sub("", s[len(w) + 1 :]).strip())
            if s.endswith(" " + w):
                out.append(s[: -len(w) - 1].strip())
        return list(dict.fromkeys(x for x in out if x))

    def match(self, raw: str | None) -> str:
        """The entry meant by a text, or UNMATCHED."""
        if raw is None:
            return UNMATCHED
        if raw in self.memo:
            return self.memo[raw]
        text = folded(raw)
        forms = self.forms(text)
        remarks = [r.strip() for r in _REMARK.findall(text)]
        outside = _REMARK.sub(" ", text).strip()
        found = next((c for f in forms if (c := self.known(f))), None) or next((c for f in forms if (c := self.near(f))), None)
        if not found and (not outside or not outside.isascii()):
            found = next((c for r in remarks if (c := self.known(r))), None)
        if not found and len(parts := [p for p in _PARTS.split(outside) if p]) > 1:
            parts.reverse()
            found = next((c for p in parts if (c := self.known(p))), None) or next((c for p in parts if (c := self.near(p))), None)
        if len(self.memo) > 500_000:
            self.memo.clear()
        self.memo[raw] = found or UNMATCHED
        return self.memo[raw]


    def asked(self, raw: str, longest: int) -> set[str]:
        """Everything under which match(raw) may look up an alias of a list of such a longest one: the bare forms of a text and
        of its parts, and their deletions."""
        text = folded(raw)
        outside = _REMARK.sub(" ", text).strip()
        texts = {*self.forms(text), *(r.strip() for r in _REMARK.findall(text)), *(p for p in _PARTS.split(outside) if p)}
        return {d for b in map(bare, texts) if len(b) <= longest + 2 for d in deletions(b, min(2, bound(len(b) + 1)))}


def reference(entries: DataFrame, alias: str, entry: str) -> DataFrame:
    """(alias, entry) of a reference list: rows with both, the smallest entry of a repeated alias."""
    e = entries.where(F.col(alias).isNotNull() & F.col(entry).isNotNull())
    return e.groupBy(F.col(alias).alias("alias")).agg(F.min(entry).alias("entry"))


def canonicalise(values: DataFrame, column: str, entries: DataFrame, out: str = "canonical") -> DataFrame:
    """values with one more column: the entry meant by column, or unmatched. Null means unmatched. entries: as from reference().

    A list of at most MOST_ENTRIES is sent to the executors, and two narrow passes do the rest: the first counts, for each
    entry, the values that are one of its aliases; the second ranks near entries by distance and these counts. values should
    be cheap to read twice. A longer list is met by a shuffle, with the same result.
    """
    rows = entries.limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        return canonicalise_by_join(values, column, entries, out)
    aliases = {r.alias: r.entry for r in rows}
    plain = Dictionary(aliases)

    @F.pandas_udf("string")
    def exactly(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else plain.known(folded(v)))

    counted = values.select(exactly(column).alias("c")).where(F.col("c").isNotNull()).groupBy("c").count()
    full = Dictionary(aliases, {r[0]: r[1] for r in counted.collect()})

    @F.pandas_udf("string")
    def matched(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(full.match)

    return values.withColumn(out, matched(column))


def canonicalise_by_join(values: DataFrame, column: str, entries: DataFrame, out: str = "canonical") -> DataFrame:
    """canonicalise() for reference lists of any length.

    Each distinct value meets, by a shuffle on deletions, the aliases that it may mean, and is matched by a dictionary of
    these alone, which decides as the whole one would.
    """

    @F.pandas_udf("array<string>")
    def filed(s: pd.Series) -> pd.Series:
        return pd.Series([sorted(deletions(b := bare(folded(a)), bound(len(b)))) for a in s], dtype=object)

    @F.pandas_udf("array<string>")
    def asked(s: pd.Series) -> pd.Series:
        d = Dictionary({})
        return pd.Series([sorted(d.asked(v, longest)) for v in s], dtype=object)

    @F.pandas_udf("string")
    def known(raw: pd.Series, near: pd.Series) -> pd.Series:
        return pd.Series([Dictionary({x["alias"]: x["entry"] for x in n}).known(folded(v)) for v, n in zip(raw, near, strict=True)], dtype=object)

    @F.pandas_udf("string")
    def matched(raw: pd.Series, near: pd.Series) -> pd.Series:
        return pd.Series(
            [Dictionary({x["alias"]: x["entry"] for x in n}, {x["entry"]: x["n"] for x in n}).match(v) for v, n in zip(raw, near, strict=True)], dtype=object
        )

    longest = entries.agg(F.max(F.length("alias"))).first()[0] or 0
    distinct = cut(values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("raw")).agg(F.count(F.lit(1)).alias("times")))
    index = entries.select("alias", "entry", F.explode(filed("alias")).alias("k"))
    met = cut(distinct.select("raw", F.explode(asked("raw")).alias("k")).join(index, "k").select("raw", "alias", "entry").distinct())
    own = met.groupBy("raw").agg(F.collect_list(F.struct("alias", "entry")).alias("near"))
    sizes = own.join(distinct, "raw").select(known("raw", "near").alias("entry"), "times").where(F.col("entry").isNotNull()).groupBy("entry").agg(F.sum("times").alias("n"))
    ranked = met.join(sizes, "entry", "left").groupBy("raw").agg(F.collect_list(F.struct("alias", "entry", F.coalesce("n", F.lit(0)).alias("n"))).alias("near"))
    meant = cut(ranked.join(distinct, "raw").select(F.col("raw").alias(column), "times", matched("raw", "near").alias("__meant")))
    return lookup(values, meant, [column], "times").select(*values.columns, F.coalesce("__meant", F.lit(UNMATCHED)).alias(out))


def candidate_terms(ats: DataFrame, skills: DataFrame, countries: DataFrame, also_learn_from: DataFrame | None = None) -> DataFrame:
    """(record_id, field_name, pos, canonical): the skills of t1_ats, one row per skill, and its country.

    Skills are split by the packed-field operator, whose model is learned from t1_ats and also_learn_from; a country has
    a row if it has a value. Rows without record_id are kept with a null one; an empty reference list leaves all unmatched.
    """
    from corrobora.operators.packed import learn_lattice

    texts = ats.select("skills") if also_learn_from is None else ats.select("skills").unionByName(also_learn_from.select("skills"))
    items = cut(unpack(ats, "skills", ["record_id"], "raw", learn_lattice(texts, "skills")))
    s = canonicalise(items, "raw", reference(skills, "alias", "canonical")).select("record_id", F.lit("skills").alias("field_name"), "pos", "canonical")
    c = spread(ats.select("record_id", value_or_null(F.col("country")).alias("raw")).where(F.col("raw").isNotNull()))
    c = canonicalise(c, "raw", reference(countries, "alias", "country_code")).select("record_id", F.lit("country").alias("field_name"), F.lit(0).alias("pos"), "canonical")
    return s.unionByName(c)
