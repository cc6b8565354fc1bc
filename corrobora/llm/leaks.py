"""Problem 9: corpus documents that contain passages of evaluation items."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.llm.measures import portions
from corrobora.operators.layout import spread
from corrobora.session import cut

#: Consecutive words of an item that make a verbatim leak.
RUN = 10
#: Words of a block. Documents are cut into blocks one after the other, items into all blocks, so every RUN words of an item
#: that a document repeats cover one of the document's blocks: RUN must be 2 * BLOCK at least.
BLOCK = 5
#: Dimensions of the latent space, random directions beyond them, and power iterations.
RANK, OVERSAMPLE, POWER = 64, 16, 2
#: Documents whose blocks the space is fitted on besides all blocks of the items: the sample's bound.
FIT_DOCUMENTS = 1_000
#: Similarity from which a document's block and an item's are candidates. Blocks of the same words have 1 in any linear space.
COSINE = 0.75
#: Words of a block that a candidate has in common with the item's in the same order.
IN_ORDER = 4
#: A paraphrase: of the PASSAGE item words around a candidate the document has, near it, this share in the same order, and this
#: share of the words that only this item has (its answers: names, numbers).
PASSAGE, SAME_ORDER, ANSWERS, SLACK = 20, 0.6, 0.5, 5
#: Blocks of items that are sent to every executor at once; more items are searched in parts of so many, one pass each.
MOST_BLOCKS = 500_000
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,300}>|<!--.*?-->", re.S)
_SOFT = re.compile("[­​-‏⁠﻿]")
_PAGE = re.compile(r"\[\s*(?:page|p\.|seite|página)\s*\d+\s*\]|(?m:^\s*(?:-\s*\d+\s*-|page\s+\d+(?:\s+of\s+\d+)?)\s*$)", re.I)
_HYPHEN = re.compile(r"(?<=\w)[-‐‑¬]\s*\r?\n[ \t>|#*]*(?=\w)")
_LEAD = re.compile(r"(?m)^[ \t]*(?:\(?\d{1,3}[.):]|\d{1,4}(?=[ \t]{2,}|\t|\s*\|))[ \t]+")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Words of a text whatever its case, punctuation, markup, line breaks and hyphenation."""
    s = _SOFT.sub("", html.unescape(text)) if "&" in text or not text.isascii() else text
    if "<" in s:
        s = _TAG.sub(" ", s)
    s = _HYPHEN.sub("", _PAGE.sub(" ", s))
    return _WORD.findall(unicodedata.normalize("NFKC", s).casefold())


def readings(text: str) -> list[list[str]]:
    """The word sequences a text may stand for: as it is, without marks and numbers that lead its lines, and with tags that cut words taken out."""
    out = [words_of(text)]
    if _LEAD.search(text):
        out.append(words_of(_LEAD.sub(" ", text)))
    if "<" in text and re.search(r"\w</?[a-zA-Z][^<>]{0,300}>\w", text):
        out.append(words_of(re.sub(r"(?<=\w)</?[a-zA-Z][^<>]{0,300}>(?=\w)", "", text)))
    return out


class Items:
    """Words of the items as numbers, one item after the other with PASSAGE blanks (-2) between, and where their blocks begin."""

    def __init__(self, rows: list[tuple[int, str]]):
        words = {i: words_of(t) for i, t in rows}
        self.known = {w: n for n, w in enumerate(sorted({w for ws in words.values() for w in ws}))}
        line, item, begin = [np.full(PASSAGE, -2, dtype=np.int32)], [np.full(PASSAGE, -1, dtype=np.int64)], []
        held: dict[int, set[int]] = {}
        at = PASSAGE
        for i, ws in sorted(words.items()):
            ids = np.fromiter((self.known[w] for w in ws), dtype=np.int32, count=len(ws))
            for n in set(ids.tolist()):
                held.setdefault(n, set()).add(i)
            begin.append(np.arange(at, at + max(len(ws) - BLOCK + 1, 0)))
            line += [ids, np.full(PASSAGE, -2, dtype=np.int32)]
            item += [np.full(len(ws), i, dtype=np.int64), np.full(PASSAGE, -1, dtype=np.int64)]
            at += len(ws) + PASSAGE
        self.line, self.item = np.concatenate(line), np.concatenate(item)
        self.begin = np.concatenate(begin) if begin and sum(map(len, words.values())) >= RUN else np.zeros(0, dtype=np.int64)
        self.sizes = {i: len(ws) for i, ws in words.items()}
        #: Whether each word is in one item only.
        self.own = np.array([len(held[n]) == 1 for n in range(len(self.known))], dtype=bool)
        self.blocks = np.sort(self.line[self.begin[:, None] + np.arange(BLOCK)], axis=1) if len(self.begin) else np.zeros((0, BLOCK), dtype=np.int32)


def numbered(texts: list[str | None], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(words, text): the words of all readings of the texts as numbers, -1 for words of no item and between readings, and whose they are.

    A reading begins at a whole block and is followed by more than PASSAGE blanks, so nothing runs from one text into the next.
    """
    lines, owner, get, blank = [], [], known.get, repeat(-1)
    for i, t in enumerate(texts):
        for ws in readings(t) if t else ():
            size = (len(ws) + PASSAGE + 2 * SLACK) // BLOCK * BLOCK + BLOCK
            row = np.full(size, -1, dtype=np.int32)
            row[: len(ws)] = np.fromiter(map(get, ws, blank), dtype=np.int32, count=len(ws))
            lines.append(row)
            owner.append((i, size))
    if not lines:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
    return np.concatenate(lines), np.repeat([i for i, _ in owner], [n for _, n in owner])


class Space:
    """A latent space of item words, with the blocks of the items in it."""

    def __init__(self, items: Items, idf: np.ndarray, basis: np.ndarray):
        self.items, self.idf = items, idf.astype(np.float32)
        self.vectors = np.vstack([self.idf[:, None] * basis.astype(np.float32), np.zeros((1, basis.shape[1]), dtype=np.float32)])
        #: Squared weights; a word of no item weighs as an item word does on average.
        self.mass = np.append(self.idf**2, np.float32(np.mean(self.idf)) ** 2 if len(self.idf) else np.float32(1))
        self.rows = self.project(items.blocks)

    def project(self, blocks: np.ndarray) -> np.ndarray:
        """Latent directions of blocks of word numbers, in the order of the numbers so that equal blocks are equal."""
        z = self.vectors[blocks].sum(axis=1)
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def near(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(block, item block, similarity) of all pairs with COSINE or more: the cosine times the share of the block's mass in item words.

        The share alone bounds the similarity, so most blocks of a document are never multiplied.
        """
        known = blocks >= 0
        mass = self.mass[blocks]
        covered = np.sqrt((mass * known).sum(axis=1) / mass.sum(axis=1))
        at = np.flatnonzero(covered >= COSINE)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k in range(0, len(at), 1024):
            part = at[k : k + 1024]
            c = (self.project(blocks[part]) @ self.rows.T) * covered[part, None]
            i, j = np.nonzero(c >= COSINE)
            out.append((part[i], j, c[i, j]))
        if not out:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def common_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of the rows of a and b, row by row for all pairs of rows at once."""
    row = np.zeros((len(a), b.shape[1] + 1), dtype=np.int16)
    for i in range(a.shape[1]):
        same = (b == a[:, i, None]) & (a[:, i, None] >= 0)
        row[:, 1:] = np.maximum.accumulate(np.maximum(row[:, 1:], np.where(same, row[:, :-1] + 1, 0)), axis=1)
    return row[:, -1]


def document_frequencies(documents: DataFrame, text: str, known: dict[str, int]) -> tuple[np.ndarray, int]:
    """In how many documents each item word occurs, counted over all of them, and how many there are."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(len(known), dtype=np.int64), 0
        for pdf in batches:
            n += len(pdf)
            for part in portions(list(pdf[text])):
                ids, owner = numbered(part, known)
                held = ids >= 0
                pairs = np.unique(owner[held] * len(known) + ids[held])
                total += np.bincount(pairs % len(known), minlength=len(known)) if len(pairs) else 0
        at = np.nonzero(total)[0]
        yield pd.DataFrame({"w": np.append(at, -1).astype("int32"), "n": np.append(total[at], n)})

    df, n = np.zeros(len(known)), 0
    for r in documents.select(text).mapInPandas(count, "w int, n bigint").groupBy("w").agg(F.sum("n").alias("n")).collect():
        if r.w < 0:
            n = r.n
        else:
            df[r.w] = r.n
    return df, n


def fit_basis(documents: DataFrame, text: str, items: Items, idf: np.ndarray, seed: int = 7) -> np.ndarray:
    """Right singular vectors (words x RANK) of the TF-IDF matrix of all item blocks and the blocks of FIT_DOCUMENTS documents.

    Randomised SVD: the rows stay in their partitions; each power step multiplies a narrow matrix of the driver with every
    partition's rows and back, and only partial products (words x narrow) are added up. The sample has the documents with
    the smallest hashes of their texts; it only shapes the space, all documents are searched.
    """
    known = items.known
    width = min(RANK + OVERSAMPLE, len(known))

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = np.sort(numbered(list(pdf[text]), known)[0].reshape(-1, BLOCK), axis=1)
            yield pd.DataFrame({"block": list(ids[(ids >= 0).sum(axis=1) >= 2])})

    texts = documents.where(F.length(text) > 0).select(text)
    taken = texts.orderBy(F.xxhash64(text), text).limit(FIT_DOCUMENTS).mapInPandas(blocks, "block array<int>")
    own = documents.sparkSession.createDataFrame(pa.table({"block": pa.array(list(items.blocks), pa.list_(pa.int32()))}))
    fit = cut(taken.unionByName(own).repartition(8, "block"))
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(known), width)))[0].astype(np.float32)
    for _ in range(POWER + 1):

        def multiply(batches: Iterator[pd.DataFrame], q: np.ndarray = q) -> Iterator[pd.DataFrame]:
            total = np.zeros_like(q)
            for pdf in batches:
                if not len(pdf):
                    continue
                ids = np.vstack(pdf["block"].to_numpy())
                weight = np.where(ids >= 0, idf[ids], 0).astype(np.float32)
                weight /= np.maximum(np.linalg.norm(weight, axis=1, keepdims=True), 1e-9)
                y = (weight[:, :, None] * q[ids]).sum(axis=1)
                for k in range(BLOCK):
                    np.add.at(total, ids[:, k], weight[:, k, None] * y)
            at = np.nonzero(np.abs(total).sum(axis=1))[0]
            yield pd.DataFrame({"w": at.astype("int32"), "v": [v.tobytes() for v in total[at]]})

        z = np.zeros_like(q)
        for r in fit.mapInPandas(multiply, "w int, v binary").toLocalIterator():
            z[r.w] += np.frombuffer(bytes(r.v), dtype=np.float32)
        q = np.linalg.qr(z)[0].astype(np.float32)
    return q[:, : min(RANK, width)]


def latent_space(documents: DataFrame, rows: list[tuple[int, str]], text: str = "text") -> Space | None:
    """The items in a latent space fitted for this corpus; None if no item has RUN words."""
    items = Items(rows)
    if not len(items.begin):
        return None
    df, n = document_frequencies(documents, text, items.known)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    return Space(items, idf, fit_basis(documents, text, items, idf))


def _run_lengths(line: np.ndarray, at: np.ndarray, other: np.ndarray, to: np.ndarray) -> np.ndarray:
    """How many consecutive words from at in line and from to in other, and before them, are the same."""
    out = np.zeros(len(at), dtype=np.int64)
    for step, shift in ((1, 0), (-1, -1)):
        on, k = np.arange(len(at)), shift
        while len(on):
            i, j = at[on] + k, to[on] + k
            inside = (i >= 0) & (i < len(line)) & (j >= 0) & (j < len(other))
            same = inside.copy()
            same[inside] = (line[i[inside]] == other[j[inside]]) & (line[i[inside]] >= 0)
            on = on[same]
            out[on] += 1
            k += step
    return out


def search(texts: list[str | None], space: Space) -> list[tuple[int, int, str, int, float, float, float]]:
    """(text, item, kind, run, order, answers, cosine) of the items that leak into each text, by number of the text."""
    items = space.items
    line, owner = numbered(texts, items.known)
    if not len(line):
        return []
    blocks = line.reshape(-1, BLOCK)
    some = np.flatnonzero((blocks >= 0).sum(axis=1) >= 2)
    distinct, back = np.unique(np.sort(blocks[some], axis=1), axis=0, return_inverse=True)
    where = np.argsort(back, kind="stable")
    count = np.bincount(back, minlength=len(distinct))
    first = np.cumsum(count) - count
    i, j, cosine = space.near(distinct)
    # Each pair of blocks stands for all places of the document's block.
    each = count[i]
    place = some[where[np.repeat(first[i], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)]] * BLOCK if len(i) else np.zeros(0, dtype=np.int64)
    target, cosine = items.begin[np.repeat(j, each)], np.repeat(cosine, each)
    found: dict[tuple[int, int], tuple[int, int, str, int, float, float, float]] = {}
    wide = np.concatenate([np.full(PASSAGE, -1, dtype=np.int32), line, np.full(PASSAGE + SLACK, -1, dtype=np.int32)])
    for k in range(0, len(place), 100_000):
        p, q, c = place[k : k + 100_000], target[k : k + 100_000], cosine[k : k + 100_000]
        keep = common_order(line[p[:, None] + np.arange(BLOCK)], items.line[q[:, None] + np.arange(BLOCK)]) >= IN_ORDER
        p, q, c = p[keep], q[keep], c[keep]
        run = _run_lengths(line, p, items.line, q)
        before = (PASSAGE - BLOCK) // 2
        passage = items.line[np.clip(q[:, None] - before + np.arange(PASSAGE), 0, len(items.line) - 1)]
        passage = np.where(items.item[np.clip(q[:, None] - before + np.arange(PASSAGE), 0, len(items.line) - 1)] == items.item[q, None], passage, -2)
        near = wide[p[:, None] + PASSAGE - before - SLACK + np.arange(PASSAGE + 2 * SLACK)]
        size = (passage >= 0).sum(axis=1)
        order = common_order(passage, near) / np.maximum(size, 1)
        own = (passage >= 0) & items.own[np.maximum(passage, 0)]
        told = own & (passage[:, :, None] == near[:, None, :]).any(axis=2)
        answers = told.sum(axis=1) / np.maximum(own.sum(axis=1), 1)
        verbatim = run >= RUN
        paraphrase = ~verbatim & (size >= RUN) & (order >= SAME_ORDER) & (answers >= ANSWERS)
        for n in np.flatnonzero(verbatim | paraphrase):
            key = (int(owner[p[n]]), int(items.item[q[n]]))
            row = (*key, "verbatim" if verbatim[n] else "paraphrase", int(run[n]), round(float(order[n]), 4), round(float(answers[n]), 4), round(float(c[n]), 4))
            old = found.get(key)
            if old is None or (row[3], row[4:]) > (old[3], old[4:]):
                found[key] = row
    return sorted(found.values())


def leaked_items(documents: DataFrame, eval_items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, item_id, kind, run_words, order_share, answer_share, cosine): each document with the items it leaks.

    kind verbatim: the document holds RUN or more consecutive words of the item. kind paraphrase: not so, but near a candidate
    it has most words of an item's passage in their order, and its answers. Candidates are blocks of words that lie near each
    other in the latent space; what they are is then checked on the words around them. Each pass over the documents is
    narrow: items travel to the documents, no documents meet. Null and empty texts leak nothing; repeated documents and items
    are each reported; a null key is kept.
    """
    schema = f"{documents.select(key).schema[0].simpleString().replace(':', ' ', 1)}, item_id bigint, kind string, run_words int, order_share double, answer_share double, cosine double"
    names = [key, "item_id", "kind", "run_words", "order_share", "answer_share", "cosine"]
    docs = spread(documents.select(key, text))
    spark = documents.sparkSession
    out = spark.createDataFrame([], schema)
    for rows in _parts(eval_items):
        space = latent_space(docs, rows, text)
        if space is None:
            continue
        shared = spark.sparkContext.broadcast(space)

        def find(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            for pdf in batches:
                keys, at, rows = pdf[key].to_numpy(dtype=object), 0, []
                for part in portions(list(pdf[text])):
                    rows += [(keys[at + h[0]], *h[1:]) for h in search(part, shared.value)]
                    at += len(part)
                yield pd.DataFrame(rows, columns=names)

        out = out.unionByName(docs.mapInPandas(find, schema))
    return out


def _parts(eval_items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in parts of about MOST_BLOCKS words, which are all that the driver holds at once."""
    part, size = [], 0
    known = eval_items.where(F.col("item_id").isNotNull() & (F.length("text") > 0)).select("item_id", "text").distinct()
    for r in known.orderBy("item_id", "text").toLocalIterator():
        n = r.text.count(" ") + 1
        if part and size + n > MOST_BLOCKS:
            yield part
            part, size = [], 0
        part.append((r.item_id, r.text))
        size += n
    if part:
        yield part


def item_report(leaks: DataFrame, eval_items: DataFrame) -> DataFrame:
    """(item_id, task, split_name, n_documents, n_paraphrases, longest_run): every item, with in how many documents it leaked."""
    verbatim = F.col("kind") == "verbatim"
    n = leaks.groupBy("item_id").agg(
        F.count_distinct(F.when(verbatim, F.col("doc_id"))).alias("n_documents"), F.count_distinct(F.when(~verbatim, F.col("doc_id"))).alias("n_paraphrases"), F.max("run_words").alias("longest_run"),
    )
    return eval_items.select("item_id", "task", "split_name").distinct().join(n, "item_id", "left").fillna(0, ["n_documents", "n_paraphrases", "longest_run"])
