"""What free text says: spotters that look at the whole text, and a small grammar over its lines.

Spotters come in a fixed order, each a pattern with a reader of its matches. Lines are marked once with what stands in them; then
productions are tried at each line, and the first that fits says how many lines it takes and what evidence they give.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from typing import NamedTuple

from corrobora.functions import partial_dates as dates
from corrobora.functions.contacts import EMAIL, PHONE, URL, to_e164
from corrobora.functions.skills import country_code
from corrobora.functions.text import nfc


class Finding(NamedTuple):
    """One piece of evidence and the characters that say it; no span where folding moved it."""

    path: str
    value: object
    raw: str
    method: str
    span: tuple[int, int] | None
    normalized: bool = True


def email_of(raw: object) -> str | None:
    s = nfc(raw).strip(" .,;<>()[]\"'")
    return s.lower() if re.fullmatch(EMAIL, s) else None


def link_of(url: str) -> tuple[str, str]:
    """(bucket, link) of a link in any writing."""
    u = url.strip().rstrip(".,;:")
    u = u if u.lower().startswith("http") else f"https://{u}"
    host = re.sub(r"^www\.", "", re.match(r"[a-zA-Z][a-zA-Z0-9+.\-]*:/*([^/?#]*)", u)[1].lower())
    return next((b for b in ("linkedin", "github") if host.endswith(f"{b}.com")), "other"), u


def place_of(text: str, countries: dict[str, str] | None) -> dict:
    first, *rest = [p.strip() for p in text.split(",")]
    return {"city": nfc(first), "region": None, "country": country_code(rest[-1], False, countries) if rest else None}


def post(company: str | None, title: str | None, start: object = None, end: object = None, current: bool = True, summary: str | None = None) -> dict:
    return {"company": company, "title": title, "start": start, "end": end, "is_current": current, "summary": summary}


# ---- spotters -------------------------------------------------------------------------------------------------------

#: Words that label a line, by what they label.
LABELS = {"full_name": ("name", "candidate"), "headline": ("role", "title"), "location": ("location", "based in")}
_METHODS = {"full_name": "regex:labeled_name_v1", "headline": "regex:labeled_title_v1", "location": "regex:labeled_location_v1"}
_LABELLED = {path: re.compile(rf"^(?:{'|'.join(names)})\s*[:\-]\s*(.+)$", re.I | re.M) for path, names in LABELS.items()}
#: Digits from which a number that is none in any plan is reported; shorter ones are years and the like.
REPORTED = 9


def labelled_lines(body: str, tools: object) -> Iterator[Finding]:
    for path, pattern in _LABELLED.items():
        for m in pattern.finditer(body):
            yield Finding(path, place_of(m[1], tools.countries) if path == "location" else nfc(m[1]), m[1], _METHODS[path], m.span(1))
            break


def addresses(body: str, tools: object) -> Iterator[Finding]:
    yield from (Finding("emails", e, m[0], "regex:email_v1", m.span()) for m in re.finditer(EMAIL, body) if (e := email_of(m[0])))


def numbers(body: str, tools: object) -> Iterator[Finding]:
    """Each number once; what isn't one is kept as it is written."""
    known: set[str] = set()
    for m in re.finditer(PHONE, body):
        raw = m[0].strip()
        number = to_e164(raw, tools.region)
        if number is None and len(re.sub(r"\D", "", raw)) >= REPORTED:
            yield Finding("phones_raw", raw, raw, "regex:phone_v1", m.span(), False)
        elif number is not None and number not in known:
            yield Finding("phones", number, raw, "regex:phone_v1", m.span())
            known.add(number)


def links(body: str, tools: object) -> Iterator[Finding]:
    for m in re.finditer(URL, body):
        bucket, url = link_of(m[0])
        yield Finding(f"links.{bucket}", url, m[0], "regex:url_v1", m.span())


def skills(body: str, tools: object) -> Iterator[Finding]:
    yield from (Finding("skills", {"name": n, "canonical": True}, n, "dict:skill_scan_v1", span) for n, span in tools.scanner.find(body).items())


SPOTTERS: tuple[Callable[[str, object], Iterator[Finding]], ...] = (labelled_lines, addresses, numbers, links, skills)


# ---- lines ----------------------------------------------------------------------------------------------------------

#: Fixed patterns: what a line is marked with.
DEGREE = re.compile(r"\b(ph\.?d|m\.?tech|b\.?tech|m\.?eng|b\.?eng|mba|m\.?sc|b\.?sc|m\.s|b\.s|ms|bs|m\.a|b\.a|b\.e|bachelor(?:'?s)?|master(?:'?s)?)\b", re.I)
SCHOOL = re.compile(r"((?:[A-Z][\w.&']*\s+)*(?:University|Institute|College|School|Academy|Polytechnic)(?:\s+of\s+[A-Z][\w']*(?:\s+[A-Z][\w']*)*)?|(?:IIT|IIM|NIT|BITS)\s+[A-Z][\w']*)")
SUBJECT = re.compile(r"\bin\s+([A-Z][A-Za-z &]{2,40}?)(?=\s*(?:,|—|–|\(|\||$))")
YEAR = re.compile(r"\b(?:19|20)\d{2}\b")
EMPLOYER = re.compile(r"\bat\s+([A-Z][\w&.']*(?:\s+(?:(?!(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\b)[A-Z][\w&.']*|of|the))*)")
COMPANY = re.compile(r"\b(Inc|LLC|Ltd|Labs|Systems|Technologies|Analytics|Studio|Group|Cloud|Software|Media|Bank|Retail|Press|Partners|Consulting)\b")
#: Beside dates, a line that is a date range has only these, and at most SPARE characters more.
_AROUND = re.compile(rf"{dates.TOKEN.pattern}|\b(?:to|until|through|since|present|current|now)\b|[\s\-–—·|,()./]+", re.I)
_TWO_PARTS = re.compile(r"(.+?)(?:\s+(?:—|–|\||--)\s+|,\s+)(.+)", re.S)
SPARE, LONG_LINE, LONG_PART = 3, 120, 60


@dataclass(frozen=True)
class Line:
    """A line, where it stands, and what stands in it."""

    text: str
    start: int
    end: int

    @cached_property
    def bare(self) -> str:
        return self.text.strip()

    @cached_property
    def span_of_time(self) -> tuple | None:
        return dates.parse_range(self.text)

    @cached_property
    def only_time(self) -> bool:
        """Whether the line is a date range and next to nothing else."""
        return dates.parse_range(self.bare) is not None and len(_AROUND.sub("", self.bare)) <= SPARE

    @cached_property
    def school(self) -> dict | None:
        """A degree at an institution, in a line that isn't long."""
        degree, school = (DEGREE.search(self.bare), SCHOOL.search(self.bare)) if len(self.bare) <= LONG_LINE else (None, None)
        if degree is None or school is None:
            return None
        subject, years = SUBJECT.search(self.bare), YEAR.findall(self.bare)
        return {"institution": nfc(school[1]), "degree": nfc(degree[1]), "field": nfc(subject[1]) if subject else None, "end_year": int(years[-1]) if years else None}

    @cached_property
    def heading(self) -> tuple[str, str] | None:
        """(company, title) of two capitalised parts without a date; the part that sounds like a company is one, else the first."""
        m = _TWO_PARTS.fullmatch(self.bare)
        if m is None or len(self.bare) > LONG_LINE or dates.parse(self.bare):
            return None
        parts = [m[1].strip(), m[2].strip()]
        if any(not p or not p[0].isupper() or len(p) > LONG_PART for p in parts):
            return None
        parts.sort(key=lambda p: COMPANY.search(p) is None)
        return parts[0], parts[1]

    @cached_property
    def employment(self) -> tuple[str, str | None] | None:
        """(company, title) of "title at company"; a long or labelled beginning is no title."""
        m = EMPLOYER.search(self.text)
        if m is None:
            return None
        before = self.text[: m.start()].strip(" .;,-")
        return nfc(m[1]), nfc(before) if 0 < len(before) <= LONG_PART and ":" not in before else None


#: Lines taken, and what they say; None if the production doesn't fit.
Reading = tuple[int, list[Finding]] | None


def _education(here: Line, below: Line | None) -> Reading:
    return (1, [Finding("education", here.school, here.bare, "regex:education_line_v1", (here.start, here.end))]) if here.school else None


def _employment(here: Line, below: Line | None) -> Reading:
    if not here.span_of_time:
        return None
    said = here.employment
    return 1, [] if said is None else [Finding("experience", post(*said, *here.span_of_time), here.bare, "regex:experience_line_v1", (here.start, here.end))]


def _block(here: Line, below: Line | None) -> Reading:
    if below is None or not below.only_time or not here.heading:
        return None
    company, title = here.heading
    what = post(nfc(company), nfc(title), *below.span_of_time)
    return 2, [Finding("experience", what, f"{here.bare} / {below.bare}", "regex:experience_block_v1", (here.start, below.end))]


PRODUCTIONS: tuple[Callable[[Line, Line | None], Reading], ...] = (_education, _employment, _block)


def lines_of(body: str) -> list[Line]:
    out, at = [], 0
    for whole in body.splitlines(keepends=True):
        text = whole.rstrip("\r\n")
        out.append(Line(text, at, at + len(text)))
        at += len(whole)
    return out


def read_lines(body: str) -> Iterator[Finding]:
    lines = [*lines_of(body), None]
    at = 0
    while (here := lines[at]) is not None:
        taken, found = next((r for p in PRODUCTIONS if (r := p(here, lines[at + 1]))), (1, []))
        yield from found
        at += taken


def read_text(body: str, tools: object) -> Iterator[Finding]:
    """All findings of a text. tools: region, countries and scanner."""
    for spot in SPOTTERS:
        yield from spot(body, tools)
    yield from read_lines(body)
