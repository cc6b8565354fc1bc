"""Skill names and countries by dictionary."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corrobora.functions import dictionaries as D
from corrobora.functions.text import _over, fold


def fold_skill(raw: object) -> str:
    """Folded name: letters, digits and + # . kept, a version at the end dropped."""
    s = re.sub(r"[^a-z0-9+#.\s]", " ", fold(raw))
    s = re.sub(r"\s+v?\d+(\.\d+)*$", "", s)
    return re.sub(r"\s+", " ", s).strip(" .")


def canonical_skill(raw: object, aliases: dict[str, str] | None = None) -> tuple[str, bool]:
    f = fold_skill(raw)
    hit = (D.SKILL_ALIASES if aliases is None else aliases).get(f)
    return (hit, True) if hit else (f, False)


def fold_skill_col(c: Column) -> Column:
    return _over(fold_skill)(c)


class SkillScanner:
    """Finds dictionary skills in prose: all aliases in one pattern set, by word borders that respect + and #."""

    def __init__(self, aliases: dict[str, str] | None = None, excluded: tuple[str, ...] = D.SCAN_EXCLUDED):
        self.aliases = {a: n for a, n in (D.SKILL_ALIASES if aliases is None else aliases).items() if a not in excluded}
        self.first = {a: re.compile(rf"(?<![a-z0-9+#]){re.escape(a)}(?![a-z0-9+#])") for a in self.aliases}

    def find(self, body: str) -> dict[str, tuple[int, int] | None]:
        """Name to the span of its first mention (None if folding moved it), for names in order."""
        folded, low = fold(body), body.lower()
        out: dict[str, tuple[int, int] | None] = {}
        for alias, pattern in self.first.items():
            if alias in folded and pattern.search(folded):
                name, m = self.aliases[alias], pattern.search(low)
                old = out.get(name)
                out[name] = m.span() if m and (old is None or m.start() < old[0]) else old
        return dict(sorted(out.items()))


def country_code(raw: object, codes: bool = True, aliases: dict[str, str] | None = None) -> str | None:
    """ISO 3166 code; with codes=False ambiguous two-letter texts have none."""
    key = fold(raw).strip(" .")
    if not codes and len(key) <= 2 and key not in D.SAFE_SHORT:
        return None
    return (D.COUNTRY_ALIASES if aliases is None else aliases).get(key)


def country_code_col(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """country_code by a literal map, for texts whose lower and folded forms agree."""
    table = D.COUNTRY_ALIASES if aliases is None else aliases
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.try_element_at(m, F.btrim(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), F.lit(" .")))
