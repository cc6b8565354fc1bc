"""Statistics of many texts at once: every character of a batch is classified by table, and counts are added up by token, line and text."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np

LETTER, NUMBER, BLANK, BREAK, VOWEL, WIDE, END, JOINT = (1 << k for k in range(8))
#: Base letters that are vowels, sentence ends, marks that may stand in or around a word, and the blanks.
VOWELS, ENDS = frozenset("aeiouy"), frozenset(".!?…。！？")
JOINTS = frozenset(".,;:!?…。！？、・'\"’‘“”«»„()[]{}（）「」-–—/&@+#%*•·ー")
BLANKS = frozenset("\t\n\x0b\x0c\r \x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B))))
_CLOSERS = np.array([ord(c) for c in "\"'”»)）"], dtype=np.uint32)
#: A line that begins with the mark of an item.
_ITEM = re.compile(r"^[ \t]*(?:\d{1,3}[ ][-–—]|[-–—*•·◦‣▪●○□☐✓→>+]|o(?=[ ])|\(?\d{1,3}[.):]|\(?[a-zA-Z][.)]|\(?[ivxIVX]{1,5}[.)]|\[[ xX]?\])[ \t]+(?=\S)", re.M)
_ROW_TAG = re.compile(r"</?(?:table|thead|tbody|tr|td|th)\b[^<>\n]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][a-zA-Z0-9]*(?:\s[^<>\n]{0,200})?/?>|&#?[a-zA-Z0-9]{1,8};")
_RULE = re.compile(r"^[ \t|+:=_.\-–—]*[-=_–—]{3,}[ \t|+:=_.\-–—]*$", re.M)
#: Separators of columns, and how many of them a row has at least.
COLUMNS = (("\t", 1), ("|", 1), (";", 2), (",", 2), ("  ", 1))
#: Separators of items in one line, of which it has at least INLINE.
ITEMS, INLINE = ";·•|/,、・\t", 4
#: A row belongs to at least so many in a row with equally many columns; unmarked items to a run of at least so many short lines.
ROWS, RUN, SHORT_WORDS, SHORT_CHARS, CELL = 3, 4, 9, 90, 25
#: A token of a text of at least REPEATS tokens counts for no more than this share of them: nothing is said by saying it over and over.
REPEATS, SAID = 12, 0.1
#: Letters of a word that may be common; shorter ones are as often bits of something else.
WORD = 3
STATISTICS = (
    "n_chars", "n_words", "mean_word_length", "symbol_ratio", "line_end_ratio", "common_ratio", "sentence_ratio", "item_share", "column_share", "unreadable_share", "plain_ratio",
)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Flags and lower-case form of every code point."""
    flags, lower = np.zeros(sys.maxunicode + 1, dtype=np.uint8), np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for i in range(0x20000):
        c = chr(i)
        kind = unicodedata.category(c)
        f = (LETTER if kind[0] == "L" else 0) | (NUMBER if kind[0] == "N" else 0)
        if f & LETTER:
            base = unicodedata.normalize("NFKD", c)[0].lower()
            f |= VOWEL if base in VOWELS or c in "œæøŒÆØ" else 0
            low = c.lower()
            lower[i] = ord(low) if len(low) == 1 else i
        if 0x2E80 <= i <= 0x9FFF and f & LETTER or 0xF900 <= i <= 0xFAFF or 0xFF66 <= i <= 0xFF9F:
            f |= WIDE
        f |= (BLANK if c in BLANKS else 0) | (BREAK if c in "\r\n" else 0) | (END if c in ENDS else 0) | (JOINT if c in JOINTS else 0)
        flags[i] = f
    flags[0x20000:0x32000] = LETTER | WIDE
    return flags, lower


@cache
def _weights() -> np.ndarray:
    return np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of x from each start to the next; the last to the end."""
    return np.add.reduceat(x, starts) if len(starts) else np.zeros(0, dtype=x.dtype)


def _runs(on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches where on holds."""
    edge = np.flatnonzero(np.diff(on.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[0::2], edge[1::2]


class Batch:
    """Texts laid out one after the other, each closed by a line break. Null texts are empty."""

    def __init__(self, texts: list[str | None]):
        self.text = "".join([(t or "") + "\n" for t in texts])
        self.code = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        flags, lower = _tables()
        self.flag = flags[self.code]
        self.lower = lower[self.code]
        self.n = len(texts)
        sizes = np.fromiter((len(t or "") + 1 for t in texts), dtype=np.int64, count=self.n)
        self.start = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if self.n else np.zeros(0, dtype=np.int64)

    def hide(self, pattern: re.Pattern) -> None:
        """Make what matches blank, but for line breaks; the text keeps it."""
        if "<" in self.text or "&" in self.text:
            self.flag, self.code = self.flag.copy(), self.code.copy()
            for m in pattern.finditer(self.text):
                at = slice(m.start(), m.end())
                self.flag[at] = (self.flag[at] & BREAK) | BLANK
                self.code[at] = 32

    def has(self, bits: int) -> np.ndarray:
        return (self.flag & bits) != 0

    def owner(self, at: np.ndarray) -> np.ndarray:
        """The text that holds each position."""
        return np.searchsorted(self.start, at, side="right") - 1

    def by_text(self, at: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.owner(at), weights=weight, minlength=self.n)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A number for each stretch of characters, case aside."""
        inside = np.zeros(len(self.code) + 1, dtype=np.int64)
        np.add.at(inside, starts, 1)
        np.add.at(inside, ends, -1)
        on = np.cumsum(inside[:-1]) > 0
        at = np.flatnonzero(on)
        length = ends - starts
        first = np.concatenate([[0], np.cumsum(length)[:-1]]) if len(length) else np.zeros(0, dtype=np.int64)
        place = np.arange(len(at)) - np.repeat(first, length)
        mixed = (self.lower[at].astype(np.uint64) + np.uint64(7)) * _weights()[place & 255] * (np.uint64(2) * place.astype(np.uint64) + np.uint64(1))
        h = _sums(mixed, first)
        return (h ^ (h >> np.uint64(29))).view(np.int64)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, number) of every run of WORD letters or more."""
        a, b = _runs(self.has(LETTER))
        long = b - a >= WORD
        a, b = a[long], b[long]
        return self.owner(a), self.hashes(a, b)

    def said(self, owner: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Whether the text has said the same before as often as it counts."""
        key = number ^ (owner * np.int64(0x5851F42D4C957F2D))
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if len(key) else np.zeros(0, dtype=bool)
        times = np.zeros(len(key), dtype=np.int64)
        times[order] = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(key) else times
        total = np.bincount(owner, minlength=self.n)
        most = np.where(total < REPEATS, np.inf, np.maximum(3, SAID * total))
        return times >= most[owner]


def portions(texts: list[str | None], chars: int = 500_000) -> Iterator[list[str | None]]:
    """The texts in portions of about so many characters, which bound the memory of a batch; a longer text is one by itself."""
    part: list[str | None] = []
    size = 0
    for t in texts:
        n = len(t) if t else 0
        if part and size + n > chars:
            yield part
            part, size = [], 0
        part.append(t)
        size += n
    if part:
        yield part


def document_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the distinct words of the texts, and in how many texts each is."""
    who, word = Batch(texts).words()
    if not len(word):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    order = np.lexsort((who, word))
    w, t = word[order], who[order]
    first = np.concatenate([[True], (w[1:] != w[:-1]) | (t[1:] != t[:-1])])
    return np.unique(w[first], return_counts=True)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.round(np.divide(a, b, out=np.zeros(len(a)), where=b > 0), 6)


def _good_tokens(x: Batch, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each token from a to b reads as a word."""
    letter, number, joint = x.has(LETTER), x.has(NUMBER), x.has(JOINT)
    n = lambda on: _sums(on.astype(np.int32), a)
    before, after = np.concatenate([[False], letter[:-1]]), np.concatenate([letter[1:] | number[1:], [False]])
    code = x.lower
    inner = np.isin(code, np.array([ord(c) for c in ";,!?:*"], dtype=np.uint32)) & before & after & ~x.has(WIDE)
    thrice = np.zeros(len(code), dtype=bool)
    thrice[2:] = letter[2:] & (code[2:] == code[1:-1]) & (code[1:-1] == code[:-2]) & ~x.has(WIDE)[2:]
    at_sign = n((code == ord("@")) & before & after)
    link = n((code == ord("/")) & np.concatenate([[False], code[:-1] == ord("/")])) > 0
    letters, numbers, wide, vowels = n(letter), n(number), n(x.has(WIDE)), n(x.has(VOWEL))
    other = (b - a) - letters - numbers - n(joint)
    short = letters <= 3
    plain = (letters > 0) & (numbers == 0) & (other == 0) & (n(inner) == 0) & (n(thrice) == 0) & (letters <= 40) & (5 * letters >= 2 * (b - a))
    latin = plain & (short | ((vowels > 0) & (letters <= 6 * vowels + 3)))
    return latin | ((wide > 0) & (letters + numbers + n(joint) >= 0.85 * (b - a))) | ((at_sign == 1) & (other <= 1)) | (link & (2 * letters >= b - a))


def measure(texts: list[str | None], common: np.ndarray) -> dict[str, np.ndarray]:
    """STATISTICS of each text; null, empty and blank texts have zeros. common: sorted numbers of the common words.

    n_words counts what blanks separate; symbol_ratio the share of characters but letters, numbers and blanks;
    line_end_ratio the lines that end a sentence; common_ratio the words that are common, said over and over only a few times; sentence_ratio sentence ends by
    words; item_share, column_share and unreadable_share the shares of characters in list items, in rows with columns, and
    outside rows in what doesn't read as words; plain_ratio the tokens of WORD characters or more that read as words.
    """
    x = Batch(texts)
    solid = ~x.has(BLANK)
    a, b = _runs(solid)
    n_words, n_solid = x.by_text(a), x.by_text(a, (b - a).astype(float))
    symbol = solid & ~x.has(LETTER | NUMBER)
    n_symbols = np.add.reduceat(symbol.astype(np.int64), x.start) if x.n else np.zeros(0)
    who, word = x.words()
    known = common[np.minimum(np.searchsorted(common, word), len(common) - 1)] == word if len(common) else np.zeros(len(word), dtype=bool)
    n_long, n_known = np.bincount(who, minlength=x.n), np.bincount(who, weights=known & ~x.said(who, word), minlength=x.n)

    # From here on markup is blank and the marks of items end no sentence.
    x.hide(_TAG)
    marks = np.zeros(len(x.code), dtype=bool)
    marked_at = [m.span() for m in _ITEM.finditer(x.text)]
    for i, j in marked_at:
        marks[i:j] = True
    solid = ~x.has(BLANK)
    a, b = _runs(solid)

    # Lines that aren't blank: where they begin, how much they hold and whether they end a sentence.
    brk = np.flatnonzero(x.has(BREAK))
    first = np.concatenate([[0], brk[:-1] + 1]) if len(brk) else np.zeros(0, dtype=np.int64)
    chars = np.diff(np.concatenate([[0], np.cumsum(solid)])[np.concatenate([first, [len(x.code)]])]) if len(first) else np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(chars)
    first, chars = first[at], chars[at]
    stop = brk[at]
    text = x.owner(first)
    count = np.concatenate([[0], np.cumsum(solid & np.concatenate([[True], ~solid[:-1]]))])
    words = count[stop] - count[first]
    tail = np.isin(x.code, _CLOSERS)
    meant = np.flatnonzero(solid & ~tail)
    last = meant[np.maximum(np.searchsorted(meant, stop) - 1, 0)] if len(meant) else np.zeros(len(stop), dtype=np.int64)
    ended = x.has(END)[last] & (last >= first) if len(meant) else np.zeros(len(stop), dtype=bool)
    gap_next = np.concatenate([~solid[1:] | tail[1:], [True]])
    prior = np.concatenate([[False], x.has(LETTER)[:-1] | x.has(NUMBER)[:-1] | tail[:-1]])
    sentence = x.has(END) & ~marks & prior & (gap_next | x.has(WIDE) | (x.code == ord("。")))
    ends_before = np.concatenate([[0], np.cumsum(sentence)])
    sentences = ends_before[stop] - ends_before[first]

    def lines_at(found: list[int]) -> np.ndarray:
        on = np.zeros(len(first), dtype=bool)
        k = np.searchsorted(first, found, side="right") - 1
        on[k[(k >= 0) & (np.array(found) <= stop[k])]] = True
        return on

    def lines_with(pattern: re.Pattern) -> np.ndarray:
        return lines_at([m.end() - 1 for m in pattern.finditer(x.text)]) if len(first) else np.zeros(0, dtype=bool)

    rule = lines_with(_RULE)
    rule &= np.concatenate([[False], ~rule[:-1] & (text[1:] == text[:-1])]) | np.concatenate([~rule[1:] & (text[1:] == text[:-1]), [False]]) if len(rule) else rule
    table = _row_lines(x, first, stop, text, chars, sentences, rule) | (lines_with(_ROW_TAG) if "<" in x.text else False)
    marked = (lines_at([j - 1 for _, j in marked_at]) if len(first) else rule) & ~table & ~rule
    line_of = np.maximum(np.searchsorted(first, a, side="right") - 1, 0)
    in_row = (table | rule)[line_of] if len(first) else np.zeros(len(a), dtype=bool)
    reads, size = _good_tokens(x, a, b), b - a
    legible = 2 * np.bincount(line_of, weights=size * ~reads, minlength=len(first)) <= chars
    items = _item_lines(x, first, stop, text, chars, words, sentences, ended, marked, table | rule) & legible
    good = reads | in_row
    owner = x.owner(a)
    fresh = good & (in_row | ~x.said(owner, x.hashes(a, b)))
    n_all = np.bincount(owner, weights=size, minlength=x.n)
    unread = np.bincount(owner, weights=size * ~fresh, minlength=x.n)
    shown = np.bincount(text, weights=chars * (~rule), minlength=x.n)
    share = lambda on: _ratio(np.bincount(text, weights=chars * on, minlength=x.n), shown)
    n_chars = np.diff(np.concatenate([x.start, [len(x.code)]])) - 1 if x.n else np.zeros(0, dtype=np.int64)
    return {
        "n_chars": n_chars.astype(np.int32), "n_words": n_words.astype(np.int32), "mean_word_length": _ratio(n_solid, n_words), "symbol_ratio": _ratio(n_symbols, n_solid),
        "line_end_ratio": _ratio(np.bincount(text, weights=ended, minlength=x.n), np.bincount(text, minlength=x.n)), "common_ratio": _ratio(n_known, n_long),
        "sentence_ratio": _ratio(np.bincount(text, weights=sentences, minlength=x.n), n_words), "item_share": share(items), "column_share": share(table & ~rule),
        "unreadable_share": _ratio(unread, n_all), "plain_ratio": _ratio(np.bincount(owner, weights=fresh & (size >= WORD), minlength=x.n), np.bincount(owner, minlength=x.n)),
    }


def _stretches(same: np.ndarray) -> np.ndarray:
    """How many lines each stretch of lines has; same: whether a line goes on with the stretch of the line before."""
    group = np.cumsum(~same) - 1
    return np.bincount(group)[group] if len(group) else group


def _row_lines(x: Batch, first: np.ndarray, stop: np.ndarray, text: np.ndarray, chars: np.ndarray, sentences: np.ndarray, rule: np.ndarray) -> np.ndarray:
    """Lines that are rows: ROWS or more in a row with equally many columns, short cells and next to no sentences."""
    out = np.zeros(len(first), dtype=bool)
    body = np.flatnonzero(~rule)
    if not len(body):
        return out
    ruled = np.zeros(len(first) + 1, dtype=bool)
    ruled[:-1] = rule
    near = ruled[np.maximum(body - 1, 0)] | ruled[body + 1]
    for sep, least in COLUMNS:
        if sep == "  ":
            blank = x.has(BLANK) & ~x.has(BREAK)
            wide = blank & np.concatenate([blank[1:], [False]]) & ~np.concatenate([[True], x.has(BLANK)[:-1]])
            after = np.flatnonzero(~x.has(BLANK))
            nxt = np.searchsorted(after, np.flatnonzero(wide))
            at = np.flatnonzero(wide)
            inside = np.zeros(len(x.code), dtype=bool)
            ok = nxt < len(after)
            line_end = stop[np.maximum(np.searchsorted(first, at, side="right") - 1, 0)]
            inside[at[ok & (after[np.minimum(nxt, len(after) - 1)] < line_end)]] = True
        else:
            inside = x.code == ord(sep)
        total = np.concatenate([[0], np.cumsum(inside)])
        n = (total[stop] - total[first])[body]
        here = text[body]
        joined = np.concatenate([[False], (n[1:] == n[:-1]) & (here[1:] == here[:-1]) & (n[1:] >= least)])
        size = _stretches(joined)
        group = np.cumsum(~joined) - 1
        add = lambda w: np.bincount(group, weights=w)[group]
        cells = add(n + 1)
        calm = add(sentences[body].astype(float)) <= 0.34 * size if sep != "|" else add((sentences[body] > 0).astype(float)) <= 0.6 * size
        small = add(chars[body].astype(float)) <= CELL * cells
        ruled_group = add(near.astype(float)) > 0
        out[body[(n >= least) & ((size >= ROWS) | ((size == 2) & ruled_group)) & calm & small]] = True
    return out


def _item_lines(
    x: Batch, first: np.ndarray, stop: np.ndarray, text: np.ndarray, chars: np.ndarray, words: np.ndarray, sentences: np.ndarray, ended: np.ndarray, marked: np.ndarray, skip: np.ndarray
) -> np.ndarray:
    """Lines that are list items: marked lines, runs of short lines without sentences, and lines that hold several items."""
    n = len(first)
    if not n:
        return np.zeros(0, dtype=bool)
    letters = np.concatenate([[0], np.cumsum(x.has(LETTER))])
    spelt = 2 * (letters[stop] - letters[first]) >= chars
    # Marked lines of a text are items unless sentences end in many of them: then they are paragraphs with marks.
    n_marked = np.bincount(text, weights=marked, minlength=x.n)
    n_said = np.bincount(text, weights=marked & (sentences > 0), minlength=x.n)
    items = marked & (n_said <= 0.4 * np.maximum(n_marked, 1))[text]
    colon = x.code[np.maximum(stop - 1, 0)] == ord(":")
    wide = np.concatenate([[0], np.cumsum(x.has(WIDE))])
    short = (words <= SHORT_WORDS) & (stop - first <= SHORT_CHARS) & (sentences == 0) & ~ended & ~colon & ~skip & ~marked & spelt & ~(((wide[stop] - wide[first]) > 0) & (chars > 30))
    joined = np.concatenate([[False], short[1:] & short[:-1] & (text[1:] == text[:-1])])
    items |= short & (_stretches(joined) >= RUN)
    for sep in ITEMS:
        total = np.concatenate([[0], np.cumsum(x.code == ord(sep))])
        k = total[stop] - total[first]
        most = 5 if sep in ",、" else 8
        items |= (k >= INLINE) & (words <= most * (k + 1)) & (chars <= 45 * (k + 1)) & (sentences == 0) & ~ended & ~skip & spelt
    return items
