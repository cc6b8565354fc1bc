"""Problem 8: token ids of every text by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from os.path import commonprefix

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.operators.layout import spread

#: Where the vocabulary lies by default; a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the word pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries that a worker's caches hold before they start afresh.
CACHE = 1 << 19


class TrieEncoder:
    """Encodes sets of distinct words at once, each shared prefix a single time.

    The state of a prefix is the last token of its encoding. It is the one vocabulary entry that ends the prefix and may
    follow the state of what is left before it: two tokens may follow each other if merging their joined bytes gives
    just these two. Going through the words in byte order visits their trie depth first, with the states from the root
    to the current node on a stack; a word's ids are read back from its last state.
    """

    def __init__(self, lines: bytes):
        self.rank = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x.strip())}
        self.token = {i: t for t, i in self.rank.items()}
        self.tails = {t[k:] for t in self.rank for k in range(len(t))}
        self.follows: dict[tuple[int, int], bool] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Plain merging, lowest rank first; used for the short pieces of two tokens."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def may_follow(self, a: int, b: int) -> bool:
        ok = self.follows.get((a, b))
        if ok is None:
            if len(self.follows) > CACHE:
                self.follows.clear()
            ok = self.follows[a, b] = self.merged(self.token[a] + self.token[b]) == [a, b]
        return ok

    def state(self, word: bytes, d: int, states: list[int]) -> int:
        """The last token of word[:d], given the states of all shorter prefixes."""
        ends, k = [], 1
        while k <= d and word[d - k : d] in self.tails:
            t = self.rank.get(word[d - k : d])
            if t is not None:
                ends.append(t)
            k += 1
        for t in reversed(ends):
            left = d - len(self.token[t])
            if not left or self.may_follow(states[left], t):
                return t
        raise ValueError("the vocabulary lacks a byte")

    def encode(self, words: list[bytes]) -> dict[bytes, list[int]]:
        out: dict[bytes, list[int]] = {}
        states, before = [-1], b""
        for word in sorted(set(words)):
            shared = len(commonprefix((before, word)))
            del states[shared + 1 :]
            for d in range(shared + 1, len(word) + 1):
                states.append(self.state(word, d, states))
            ids, d = [], len(word)
            while d:
                ids.append(states[d])
                d -= len(self.token[states[d]])
            out[word], before = ids[::-1], word
        return out


_encoders: dict[int, tuple[TrieEncoder, dict[str, list[int]]]] = {}


def _encode_batches(lines: bytes, batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import regex

    key = hash(lines)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = TrieEncoder(lines), {}
    encoder, known = _encoders[key]
    words = regex.compile(PATTERN).findall
    for texts in batches:
        split = [words(t) if t else [] for t in texts]
        fresh = {w for s in split for w in s} - known.keys()
        if len(known) + len(fresh) > CACHE:
            known.clear()
            fresh = {w for s in split for w in s}
        raw = {w: w.encode("utf-8", "surrogatepass") for w in fresh}
        ids = encoder.encode(list(raw.values()))
        known.update((w, ids[b]) for w, b in raw.items())
        yield pd.Series([[i for w in s for i in known[w]] for s in split], dtype=object)


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids): the ids of every text, without special tokens, one row per row of documents.

    Null and empty texts give an empty list; strings of special tokens are ordinary text; texts are read whole. The
    vocabulary, of a fixed size, is read on the driver and sent to the executors once. Words don't leave their task: each
    Arrow batch builds the trie of the words it has not seen, so there is no shuffle and nothing grows with the corpus.
    """
    spark = documents.sparkSession
    with open(vocabulary, "rb") as f:
        lines = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from _encode_batches(lines.value, batches)

    return spread(documents.select(key, text)).select(key, encode(F.col(text)).alias("ids"))
