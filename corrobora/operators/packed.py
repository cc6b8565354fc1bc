"""Fields that hold several values in one text: one value per row, with its position."""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.functions.values import NULL_MARKS
from corrobora.operators.layout import spread
from corrobora.operators.skew import lookup
from corrobora.session import cut

#: Delimiters that hardly ever stand inside a value: a text falls apart at them before its lattice is laid out, except within
#: values that occur somewhere in quotes, as a JSON element or alone.
STRONG = set(";；|,，、\n\r\t•▪●◦‣·")
#: Every delimiter at which a lattice may split.
DELIMITER = re.compile(r"\s+(?:and|AND|And|&)\s+|(?<=\S)/(?=\S)|\s+/\s+|\s*[;；|,，、\n\r\t•▪●◦‣·]\s*")
_QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“"}
_OPEN, _CLOSE = "(（[", ")）]"
_BULLET = re.compile(r"^(?:[-*–]\s+|\(?\d{1,3}[.)]\s+)+")
_VERSION = re.compile(r"\s+v?\d+(?:\.(?:\d+|x))*$")
#: A value is in the dictionary if it is at least this share of all values: so the dictionary has at most 1 / share entries. Rarer ones stay in a table.
MIN_SHARE = 1e-4
#: Log probabilities of a value outside the dictionary: to be one at all, of each of its characters, and of each edit that leads from it to an entry.
UNSEEN, PER_CHAR, PER_EDIT = math.log(0.2), math.log(1 / 20), math.log(1e-3)
#: How often a delimiter separates before anything is learned, and the range in which that is learned: below it, delimiters
#: between two values nobody has seen would join them.
EVEN, LEAST_SPLIT, MOST_SPLIT = 0.5, 0.25, 1 - 1e-6
#: Rounds after which learning must have settled: the likelihood of the column changes by less than this share.
ROUNDS, SETTLED = 50, 1e-5
#: Marks that tell counts of delimiters (separating, inside a value) and the likelihood from counts of values.
_MARK = "\x00"
_SPLIT, _INSIDE, _LIKELY, _ALL = f"{_MARK}s", f"{_MARK}i", f"{_MARK}l", f"{_MARK}a"


def _closing(s: str, i: int) -> int:
    """Index of the quote that closes the one at i: doubled and escaped quotes don't, nor one inside a value. -1 if none."""
    end, j = _QUOTES[s[i]], i + 1
    while j < len(s):
        if s[j] == "\\":
            j += 2
            continue
        if s[j] == end:
            if j + 1 < len(s) and s[j + 1] == end:
                j += 2
                continue
            rest = s[j + 1 :].lstrip(" ")
            if not rest or rest[0] in STRONG or rest[0] in "/(" or re.match(r"and\b|&", rest):
                return j
        j += 1
    return -1


def chunks(text: str, joined: frozenset[str] = frozenset()) -> list[tuple[str, bool]]:
    """The parts of a packed text between strong delimiters, in order, each with whether it is atomic.

    JSON elements and quoted spans are atomic; delimiters in parentheses belong to their value. Parts that together are one
    of the joined values stay together, for the lattice to decide.
    """
    parts = _chunks(text)
    if not joined or len(parts) < 2:
        return [(c, atomic) for c, atomic, *_ in parts]
    out, i, most = [], 0, max(len(DELIMITER.findall(j)) for j in joined) + 1
    s = text.strip()
    while i < len(parts):
        for k in range(min(len(parts), i + most), i + 1, -1):
            run = parts[i:k]
            if not any(p[1] for p in run) and run[0][2] >= 0 and value_key(whole := s[run[0][2] : run[-1][3]]) in joined:
                out.append((whole, False))
                i = k
                break
        else:
            out.append(parts[i][:2])
            i += 1
    return out


def _chunks(text: str) -> list[tuple[str, bool, int, int]]:
    """The parts between all strong delimiters: text, whether atomic, and where they stand (-1 in JSON)."""
    s = text.strip()
    if s.startswith("["):
        try:
            flat: list[tuple[str, bool, int, int]] = []
            stack = [json.loads(s)]
            while stack:
                x = stack.pop()
                if isinstance(x, list):
                    stack.extend(reversed(x))
                elif x is not None:
                    flat.append((x if isinstance(x, str) else json.dumps(x, ensure_ascii=False), True, -1, -1))
            return flat
        except ValueError:
            s = s.lstrip("[").rstrip("]")
    marks = _numbering(s)
    cut_off = len(text.strip()) != len(s)
    out, start, i, atomic, parts = [], 0, 0, False, []

    def flush(to: int) -> None:
        nonlocal atomic, parts
        out.append(("".join(parts) + s[start:to], atomic, -1 if cut_off else start, to))
        atomic, parts = False, []

    while i < len(s):
        c = s[i]
        if i in marks:
            flush(i)
            i = start = marks[i]
        elif c in _QUOTES and not s[start:i].strip() and not parts and (j := _closing(s, i)) > 0:
            parts, atomic = [re.sub(r'\\(.)', r"\1", s[i + 1 : j]).replace(c * 2, c)], True
            i = start = j + 1
        elif c in _OPEN and (j := _matching(s, i)) > 0:
            i = j + 1
        elif c in STRONG:
            flush(i)
            i = start = i + 1
        elif c == "/" and i and s[i - 1].isspace() and i + 1 < len(s) and s[i + 1].isspace():
            flush(i)
            i = start = i + 1
        elif atomic and (m := re.match(r"\s+(?:and|&)\s+", s[i:])):
            flush(i)
            i = start = i + m.end()
        else:
            i += 1
    flush(len(s))
    return out


def _matching(s: str, i: int) -> int:
    depth = 0
    for j in range(i, len(s)):
        if s[j] in _OPEN:
            depth += 1
        elif s[j] in _CLOSE:
            depth -= 1
            if not depth:
                return j
        elif s[j] in "\n\t|":
            return -1
    return -1


def _numbering(s: str) -> dict[int, int]:
    """Start and end of the marks 1) 2) 3) ... (or 1. 2. 3.) of a text that begins with the first of them."""
    if not re.match(r"\(?1[.)]\s", s):
        return {}
    marks, at, n = {}, 0, 1
    while m := re.compile(rf"(?:^|(?<=\s))\(?{n}[.)]\s+").search(s, at):
        marks[m.start()], at, n = m.end(), m.end(), n + 1
    return marks


def cleaned(value: str) -> str | None:
    """A value without blanks, bullets, numbering and stray quotes around it; None for a null mark."""
    v = _BULLET.sub("", value.strip()).strip()
    v = re.sub(r"^(?:and|&)\s+", "", v)
    if v[:1] in _QUOTES and v[-1:] == _QUOTES.get(v[:1]):
        v = v[1:-1].strip()
    elif v.count('"') == 1:
        v = v.strip('"').strip()
    return None if v.lower() in NULL_MARKS else v


def value_key(value: str) -> str:
    """Form under which values are counted: compatibility characters, case, blanks, remark, version and end marks aside."""
    v = " ".join(unicodedata.normalize("NFKC", value).casefold().split())
    v = re.sub(r"\s*\([^()]*\)$", "", v).rstrip(".!… ")
    return _VERSION.sub("", v)


def edits(a: str, b: str, most: int) -> int:
    """Damerau-Levenshtein distance (adjacent swaps), or most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before2, before = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before2[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before2, before = before, row
    return min(before[-1], most + 1)


@lru_cache(maxsize=200_000)
def near_values(text: str, values: tuple[str, ...]) -> tuple[tuple[str, int], ...]:
    """The values that a text may be a typing of, with the edits between: more for longer values. Kept for the rounds of learning."""
    out = []
    letters = Counter(text)
    for v in values if text else ():
        most = 1 if len(v) < 9 else 2 if len(v) < 18 else 3
        # Each edit changes at most two counts of letters, so most pairs need no look at their order.
        if abs(len(v) - len(text)) <= most and sum(abs(n) for n in (letters - Counter(v)).values()) <= most and (d := edits(text, v, most)) <= most:
            out.append((v, d))
    return tuple(out)


def _kind(delimiter: str) -> str:
    """Delimiters that are learned together: blanks around and case aside, but a slash between blanks is another than one without."""
    d = delimiter.strip().lower()
    return " / " if d == "/" and delimiter != "/" else d or "\n"


class Lattice:
    """The ways to split a chunk at its delimiters, under learned frequencies of values and of delimiters that separate."""

    def __init__(self, counts: dict[str, float], splits: dict[str, float] | None = None):
        self.total = getattr(counts, "total", 0.0) or sum(counts.values()) or 1.0
        self.p = {k: math.log(n / self.total) for k, n in counts.items()}
        self.splits = dict(splits if splits is not None else getattr(counts, "splits", {}))
        self.joined = sorted(k for k in self.p if DELIMITER.search(k))
        self.whole = tuple(self.joined)
        #: Pieces of the longest value with delimiters; joining more than one beyond it is never likelier than splitting.
        self.reach = max((len(DELIMITER.findall(k)) for k in self.joined), default=0) + 2
        #: Values with a strong delimiter inside.
        self.kept = frozenset(k for k in self.joined if any(c in STRONG for c in k))
        self.memo: dict[str, float] = {}

    def score(self, value: str, rare: dict[str, float] | None = None) -> float:
        k = value_key(value)
        if k in self.p:
            return self.p[k]
        n = rare.get(k) if rare else None
        return max(self.outside(k), math.log(n / self.total)) if n else self.outside(k)

    def outside(self, k: str) -> float:
        if k in self.memo:
            return self.memo[k]
        best = UNSEEN + PER_CHAR * len(k)
        if DELIMITER.search(k):
            first, _, rest = k.partition(" ")
            for text, extra in ((k, 0.0), (rest, UNSEEN + PER_CHAR * len(first) / 2)):
                for j, d in near_values(text, self.whole):
                    best = max(best, self.p[j] + PER_EDIT * d + extra)
        if len(self.memo) > 200_000:
            self.memo.clear()
        self.memo[k] = best
        return best

    def arcs(self, pieces: list[str], rare: dict[str, float] | None) -> list[tuple[int, int, str, float]]:
        """(from, to, value, log probability) of every value that some pieces make, the delimiter before it and those inside included."""
        n = len(pieces) // 2 + 1
        at = [self.splits.get(_kind(d), EVEN) for d in pieces[1::2]]
        out = []
        for a in range(n):
            w = math.log(at[a - 1]) if a else 0.0
            for b in range(a + 1, min(n, a + self.reach) + 1):
                if b > a + 1:
                    w += math.log1p(-at[b - 2])
                value = "".join(pieces[2 * a : 2 * b - 1])
                out.append((a, b, value, w + self.score(value, rare)))
        return out

    def split(self, chunk: str, rare: dict[str, float] | None = None) -> list[str]:
        """The most likely values, by Viterbi; of equally likely ones the shorter. rare: counts of pieces too rare for the dictionary."""
        pieces = _pieces(chunk)
        n = len(pieces) // 2 + 1
        if n == 1 or chunk.strip().lower() in NULL_MARKS:
            return [chunk]
        best: list[tuple[float, int, str]] = [(0.0, 0, "")] + [(-math.inf, 0, "")] * n
        for a, b, value, w in self.arcs(pieces, rare):
            if (best[a][0] + w, a) > best[b][:2]:
                best[b] = (best[a][0] + w, a, value)
        out, end = [], n
        while end:
            out.append(best[end][2])
            end = best[end][1]
        return out[::-1]

    def expected(self, chunk: str, rare: dict[str, float] | None = None) -> dict[str, float]:
        """Expected counts of the values of a chunk over all its splits, and of its delimiters, by forward and backward sums."""
        pieces = _pieces(chunk)
        n = len(pieces) // 2 + 1
        arcs = self.arcs(pieces, rare)
        ahead, behind = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
        for a, b, _, w in arcs:
            ahead[b] = _plus(ahead[b], ahead[a] + w)
        for a, b, _, w in sorted(arcs, key=lambda x: -x[0]):
            behind[a] = _plus(behind[a], behind[b] + w)
        out: dict[str, float] = {_LIKELY: ahead[n], _ALL: 0.0}
        for a, b, value, w in arcs:
            share = math.exp(ahead[a] + w + behind[b] - ahead[n])
            v = cleaned(value)
            if share > 1e-4 and v is not None:
                out[value_key(v)] = out.get(value_key(v), 0.0) + share
                out[_ALL] += share
        for i, d in enumerate(pieces[1::2], 1):
            apart = math.exp(ahead[i] + behind[i] - ahead[n])
            out[_SPLIT + _kind(d)] = out.get(_SPLIT + _kind(d), 0.0) + apart
            out[_INSIDE + _kind(d)] = out.get(_INSIDE + _kind(d), 0.0) + 1 - apart
        return out


def _plus(x: float, y: float) -> float:
    """log(exp(x) + exp(y))."""
    hi, lo = max(x, y), min(x, y)
    return hi if lo == -math.inf else hi + math.log1p(math.exp(lo - hi))


def _pieces(chunk: str) -> list[str]:
    """chunk split at its delimiters outside parentheses: text, delimiter, text, ..."""
    out, at = [], 0
    for m in DELIMITER.finditer(chunk):
        if m.start() < at or not chunk[at : m.start()].strip() or not chunk[m.end() :].strip():
            continue
        head = chunk[: m.start()]
        if sum(head.count(c) for c in _OPEN) > sum(head.count(c) for c in _CLOSE):
            continue
        out += [chunk[at : m.start()], m.group()]
        at = m.end()
    return [*out, chunk[at:]]


def candidate_keys(chunk: str) -> set[str]:
    """The keys of everything that a split of the chunk can make a value; none if it has no delimiter."""
    pieces = _pieces(chunk)
    n = len(pieces) // 2 + 1
    return {value_key("".join(pieces[2 * a : 2 * end - 1])) for end in range(1, n + 1) for a in range(end)} if n > 1 else set()


def split_values(text: str | None, lattice: Lattice, rare: dict[str, float] | None = None) -> list[str]:
    if not text:
        return []
    parts = (p for c, atomic in chunks(text, lattice.kept) for p in ([c] if atomic else lattice.split(c, rare)))
    return [v for v in map(cleaned, parts) if v is not None]


class Model(dict):
    """Counts of the frequent values; total counts all values, splits has how often each delimiter separates, and rare (k, n)
    holds the values below MIN_SHARE, or is None if there are none."""

    total: float = 0.0
    rare: DataFrame | None = None

    def __init__(self, *args: object, **kw: float):
        super().__init__(*args, **kw)
        self.splits: dict[str, float] = {}


def _rare(ks: list[str] | None, ns: list[float] | None) -> dict[str, float] | None:
    return None if ks is None else dict(zip(ks, ns, strict=True))


def _expectations(lattice: Lattice):  # noqa: ANN202
    @F.pandas_udf("array<struct<k:string,n:double>>")
    def expectations(s: pd.Series, times: pd.Series, ks: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([[{"k": key, "n": v * t} for key, v in lattice.expected(c, _rare(k, n)).items()] for c, t, k, n in zip(s, times, ks, ns, strict=True)], dtype=object)

    return expectations


def _candidates(whole: bool, kept: frozenset[str] = frozenset()):  # noqa: ANN202
    """The candidate keys of a chunk, or of all chunks of a whole text."""

    @F.pandas_udf("array<string>")
    def candidates(s: pd.Series) -> pd.Series:
        return pd.Series([sorted({k for c, atomic in (chunks(t, kept) if whole else [(t, False)]) if not atomic for k in candidate_keys(c)}) for t in s], dtype=object)

    return candidates


def _rare_pieces(pieces: DataFrame, by: str, rare: DataFrame) -> DataFrame:
    """(by, ks, ns): the rare ones among the pieces (by, k), and their counts."""
    found = pieces.join(rare.select("k", F.col("n").cast("double").alias("rare_n")), "k").groupBy(by).agg(F.collect_list(F.struct("k", "rare_n")).alias("x"))
    return found.select(by, F.col("x.k").alias("ks"), F.col("x.rare_n").alias("ns"))


def learn_lattice(texts: DataFrame, column: str) -> Model:
    """Frequencies of the values of a whole column, and of delimiters that separate, by expectation maximisation.

    Values without delimiters, JSON elements and quoted spans are counted once and for all. Each round, chunks with delimiters
    give every value that some split makes the share of that split in all their splits under the current frequencies (each
    text counted as often as it occurs), until the likelihood settles; if it doesn't, an error is raised. Only values with
    MIN_SHARE of all values leave the executors, at most 1 / MIN_SHARE of them; the rarer ones stay in a table, in which the
    candidate pieces of each chunk are looked up.
    """

    def parts_of(kept: frozenset[str]) -> DataFrame:
        @F.pandas_udf("array<struct<k:string,open:boolean>>")
        def lexed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                rows = []
                for t in s:
                    row = []
                    for c, atomic in chunks(t, kept) if t else []:
                        v = cleaned(c)
                        if v is not None:
                            row.append({"k": c, "open": True} if not atomic and len(_pieces(c)) > 1 else {"k": value_key(v), "open": False})
                    rows.append(row)
                yield pd.Series(rows, dtype=object)

        return cut(distinct.select("n", F.explode(lexed(column)).alias("x")).groupBy("x.k", "x.open").agg(F.sum("n").alias("n")))

    def model(counts: DataFrame, total: float, splits: dict[str, float]) -> tuple[Model, dict[str, float]]:
        """The model of counts (k, n), and the marks among them, by one collection of bounded size."""
        least = max(total * MIN_SHARE, 0.5)
        rows = {r.k: r.n for r in counts.where((F.col("n") >= least) | F.col("k").startswith(_MARK)).collect()}
        marks = {k: n for k, n in rows.items() if k.startswith(_MARK)}
        out = Model({k: n for k, n in rows.items() if k not in marks})
        out.total, out.splits = total, splits
        out.rare = counts.where((F.col("n") < least) & (F.col("n") >= 0.5) & ~F.col("k").startswith(_MARK)) if least > 0.5 else None
        return out, marks

    def counted(parts: DataFrame) -> tuple[DataFrame, float]:
        fixed = parts.where(~F.col("open")).select("k", F.col("n").cast("double").alias("n"))
        return fixed, float(fixed.agg(F.sum("n")).first()[0] or 0)

    distinct = texts.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    parts = parts_of(frozenset())
    fixed, certain = counted(parts)
    found, _ = model(fixed, certain, {})
    if kept := Lattice(found).kept:
        parts = parts_of(kept)
        fixed, certain = counted(parts)
        found, _ = model(fixed, certain, {})
    ambiguous = parts.where("open").select("k", "n")
    pieces = None
    nothing = F.lit(None).cast("array<string>").alias("ks"), F.lit(None).cast("array<double>").alias("ns")
    before = total = last = None
    for _ in range(ROUNDS):
        if found.rare is None:
            asked = ambiguous.select("*", *nothing)
        else:
            pieces = cut(ambiguous.select(F.col("k").alias("chunk"), F.explode(_candidates(False)("k")).alias("k"))) if pieces is None else pieces
            asked = ambiguous.join(_rare_pieces(pieces, "chunk", found.rare).withColumnRenamed("chunk", "k"), "k", "left")
        shares = asked.select(F.explode(_expectations(Lattice(found))("k", "n", "ks", "ns")).alias("x"))
        again = cut(shares.groupBy("x.k").agg(F.sum("x.n").alias("n")))
        both = fixed.unionByName(again).groupBy("k").agg(F.sum("n").alias("n"))
        found, marks = model(both, certain if total is None else total, {})
        if not marks or before is not None and abs(marks[_LIKELY] - before) <= SETTLED * max(abs(before), 1.0):
            return found if last is None else last
        before, total = marks[_LIKELY], certain + marks[_ALL]
        found.total = total
        for k, n in marks.items():
            if k.startswith(_SPLIT):
                d = k[len(_SPLIT) :]
                found.splits[d] = min(max((n + EVEN) / (n + marks.get(_INSIDE + d, 0.0) + 1), LEAST_SPLIT), MOST_SPLIT)
        last = found
    raise RuntimeError(f"value frequencies not settled after {ROUNDS} rounds")


def unpack(rows: DataFrame, column: str, keys: list[str], value: str = "value", model: dict[str, float] | None = None) -> DataFrame:
    """(keys, pos int, value): each value of a packed text as written, positions from 0.

    Null marks take no position; null and empty texts give no row; texts are read whole; repeated rows stay repeated.
    Texts with weak delimiters get the counts of their rare pieces, if the model has rare values, by a lookup in which
    frequent texts don't gather; the others are split where they are.
    """
    model = learn_lattice(rows, column) if model is None else model
    lattice = Lattice(model)

    @F.pandas_udf("array<string>")
    def split(s: pd.Series) -> pd.Series:
        return pd.Series([split_values(t, lattice) for t in s], dtype=object)

    @F.pandas_udf("array<string>")
    def split_rare(s: pd.Series, ks: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([split_values(t, lattice, _rare(k, n)) for t, k, n in zip(s, ks, ns, strict=True)], dtype=object)

    at = spread(rows.select(*keys, column))
    if (rare := getattr(model, "rare", None)) is None:
        return at.select(*keys, F.posexplode(split(column)).alias("pos", value))
    weak = F.coalesce(F.col(column).rlike(r"(?U)\s(?:and|AND|And|&)\s|/"), F.lit(False))
    texts = cut(at.where(weak).groupBy(F.col(column).alias("__text")).agg(F.count(F.lit(1)).alias("n")))
    found = _rare_pieces(texts.select("__text", F.explode(_candidates(True, lattice.kept)("__text")).alias("k")), "__text", rare)
    known = cut(texts.join(found, "__text", "left"))
    asked = lookup(at.where(weak).withColumn("__text", F.col(column)), known, ["__text"], "n")
    plain = at.where(~weak).select(*keys, F.posexplode(split(column)).alias("pos", value))
    return plain.unionByName(asked.select(*keys, F.posexplode(split_rare(column, "ks", "ns")).alias("pos", value)))
