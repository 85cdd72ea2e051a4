"""Encoding of a whole corpus by a public byte-level BPE vocabulary (problem 7).

Method: batched numpy merge rounds. The words of a slice are found with the vocabulary's split rule as
array operations, each distinct word is encoded once, and all words that are still unknown go through the
merge rounds together: their symbols lie in one flat array, the rank of every adjacent pair comes from a
binary search over the sorted pair keys, and each round merges the lowest-ranked pair of every word.

Defined cases: a null and an empty text give the empty list; text that looks like a special token is
ordinary text; a text of any length is encoded whole; rows with equal ids are each encoded.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K

TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
CACHED_WORDS = 400_000
_NONE = np.int32(2**31 - 1)


class Encoder:
    """Byte-level BPE by merge rounds; keeps the ids of words it has met, up to CACHED_WORDS words."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        keys, ids = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append((left << 32) | right)
                    ids.append(rank)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.pair_keys = np.array(keys, np.int64)[order]
        self.pair_ids = np.array(ids, np.int32)[order]
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.starts = np.empty(1024, np.int64)
        self.counts = np.empty(1024, np.int64)
        self.flat = np.empty(1 << 14, np.int32)
        self.used = 0

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one flat array, and how many each word has."""
        sizes = np.array([len(w) for w in words], np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words), dtype=np.int64), sizes)
        counts = sizes.copy()
        live = np.arange(len(symbols))
        done_symbols, done_owner = [], []
        while len(symbols) > 1:
            keys = (symbols[:-1].astype(np.int64) << 32) | symbols[1:]
            at = np.searchsorted(self.pair_keys, keys)
            at[at == len(self.pair_keys)] = 0
            rank = np.where((self.pair_keys[at] == keys) & (owner[:-1] == owner[1:]), self.pair_ids[at], _NONE)
            rank = np.append(rank, _NONE)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            span = np.diff(np.append(first, len(symbols)))
            best = np.minimum.reduceat(rank, first)
            open_ = best != _NONE
            if not open_.any():
                break
            hit = (rank == np.repeat(best, span)) & (rank != _NONE)
            where = np.flatnonzero(hit)
            # overlapping hits (a pair of equal symbols) merge from the left: every second of a chain stays
            chain = np.flatnonzero(np.append(True, np.diff(where) != 1))
            offset = np.arange(len(where)) - np.repeat(chain, np.diff(np.append(chain, len(where))))
            where = where[offset % 2 == 0]
            symbols[where] = rank[where]
            keep = np.ones(len(symbols), bool)
            keep[where + 1] = False
            # words that are finished leave the flat array
            finished = np.repeat(~open_, span)
            if finished.any():
                done_symbols.append(symbols[finished])
                done_owner.append(owner[finished])
                keep &= ~finished
            symbols, owner = symbols[keep], owner[keep]
        done_symbols.append(symbols)
        done_owner.append(owner)
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        del live
        counts = np.bincount(owner, minlength=len(words)).astype(np.int64)
        return symbols[order], counts

    def rows(self, words: list[bytes]) -> np.ndarray:
        """Row numbers of words in the table of known words; unknown ones are encoded first."""
        if len(self.known) > CACHED_WORDS:
            self.forget()
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            ids, counts = self.merge(new)
            base = len(self.known)
            while base + len(new) > len(self.starts):
                self.starts, self.counts = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.counts, 2 * len(self.counts))
            while self.used + len(ids) > len(self.flat):
                self.flat = np.resize(self.flat, 2 * len(self.flat))
            self.flat[self.used : self.used + len(ids)] = ids
            self.counts[base : base + len(new)] = counts
            self.starts[base : base + len(new)] = self.used + np.cumsum(counts) - counts
            self.used += len(ids)
            self.known.update(zip(new, range(base, base + len(new))))
        return np.fromiter((self.known[w] for w in words), np.int64, len(words))

    def split(self, cps: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of the vocabulary's words: contractions, and runs of letters, numbers, others and white space."""
        kinds = K.classes()[cps]
        starts = K.runs(kinds, offsets)
        if len(starts) == 0:
            return starts
        ends = np.append(starts[1:], len(cps))
        kind = kinds[starts]
        last_of_text = np.isin(ends, offsets)
        cut = (kind == K.SPACE) & ~last_of_text
        blank = cps[ends - 1] == 32
        # a run of white space before other text gives its last character away: to the next word if it is a blank
        split_at = ends[cut & (ends - starts > 1)] - 1
        joins = np.zeros(len(starts), bool)
        joins[1:] = (cut & blank)[:-1]
        own = starts[~joins | (kind == K.SPACE)]
        lonely = cut & blank & (ends - starts == 1)  # the blank itself starts the next word
        bounds = [own, split_at, starts[lonely]]
        # contractions: an apostrophe alone in its run, not after a blank, then the given letters
        quote = np.flatnonzero((ends - starts == 1) & (cps[starts] == 39) & ~joins & ~last_of_text)
        drop = np.empty(0, np.int64)
        if len(quote):
            quote = quote[quote + 1 < len(starts)]
            quote = quote[kind[quote + 1] == K.LETTER]
            a = cps[starts[quote + 1]]
            long = ends[quote + 1] - starts[quote + 1] > 1
            b = np.where(long, cps[np.minimum(starts[quote + 1] + 1, len(cps) - 1)], 0)
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
            found = one | two
            letters = starts[quote + 1][found]
            stop = letters + np.where(one[found], 1, 2)
            drop = letters
            bounds.append(stop[stop < ends[quote + 1][found]])
        every = np.zeros(len(cps), bool)
        for b in bounds[:3]:
            every[b] = True
        every[drop] = False
        for b in bounds[3:]:
            every[b] = True
        return np.flatnonzero(every)

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For every word of the texts its row in the table, and for every text the number of its words."""
        cps, offsets = K.code_points(texts)
        starts = self.split(cps, offsets)
        lengths = np.diff(np.append(starts, len(cps)))
        codes, uniques = pd.factorize(K.hashes(cps, starts, lengths))
        first = np.empty(len(uniques), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        as_bytes = [cps[s : s + n].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass") for s, n in zip(starts[first], lengths[first])]
        long = np.flatnonzero(lengths > K.LONG_WORD)  # these are told apart by all their characters
        if len(long):
            as_bytes += [cps[s : s + n].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass") for s, n in zip(starts[long], lengths[long])]
            codes = codes.copy()
            codes[long] = len(uniques) + np.arange(len(long))
        rows = self.rows(as_bytes)
        per_text = np.diff(np.searchsorted(starts, offsets))
        return rows[codes], per_text

    def encode(self, texts: pa.Array) -> pa.Array:
        rows, per_text = self.words(texts)
        counts = self.counts[rows]
        flat = K.gather(self.flat, self.starts[rows], counts)
        ends = np.append(0, np.cumsum(counts))[np.append(0, np.cumsum(per_text))]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32, copy=False)))

    def count(self, texts: pa.Array) -> np.ndarray:
        rows, per_text = self.words(texts)
        sums = np.append(0, np.cumsum(self.counts[rows]))[np.append(0, np.cumsum(per_text))]
        return np.diff(sums)


@lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def vocabulary_path(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> str:
    return f"{folder}/{vocabulary}.tiktoken"


def encode(df: DataFrame, key: str, text: str, out: str = "ids", path: str | None = None) -> DataFrame:
    """``key`` and the token ids of ``text`` for every row; no shuffle, only these two columns are read."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in batches:
            for a, b in K.slices(batch.column(1)):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), tool.encode(part.column(1))], [key, out])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, `{out}` array<int>")


def count(df: DataFrame, key: str, text: str, out: str = "n_tokens", path: str | None = None) -> DataFrame:
    """``key`` and the number of tokens of ``text`` for every row (0 for a null or empty text)."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in batches:
            for a, b in K.slices(batch.column(1)):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tool.count(part.column(1)), pa.int64())], [key, out])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, `{out}` bigint")
