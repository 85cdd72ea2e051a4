"""Reading level of documents (problem 9).

Method: every sentence of a document's own paragraphs is classified by a regularised model of words and of
the characters inside words; the sentence-level distributions are averaged, and a calibration fitted on
documents that the sentence model has not seen turns them into the difficulty of the document.

The model is fitted on at most ``SAMPLE`` labelled documents (those of the smallest hashed ids); every document
is scored by the whole text of its own paragraphs. A label is the distribution of its raters' votes; a rater's
re-delivered label counts once and a null level not at all.

Defined cases: a null, empty or blank text has a null level; a text without any own paragraph is judged by all
its lines; one without a word has a null level.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K

SAMPLE = 900
LEVELS = 5
WORD_SLOTS, GRAM_SLOTS = 1 << 14, 1 << 13

_MARK = re.compile(r"\s*(?:\[\s?\d{1,4}\s?\]|\d{1,4}[.)]|§+\s?\d{1,4}|\(\d{1,4}\))\s+(?=\S)")
# The formulas that open an order, and the words that open a headnote.
_ORDER = re.compile(r"\s*(?:for these reasons|par ces motifs|aus diesen gründen|por estos motivos)", re.I)
_HEADNOTE = re.compile(r"\s*(?:headnote|leitsatz|leitsätze|sommaire|sumario|resumen|chapeau)\b\s*:?", re.I)
_PAGE = re.compile(r"\s*(?:[-–—] ?\d+ ?[-–—]|.{0,80}\b(?:page|seite|página|pág\.?)\s+\d+.{0,20}|\d+ ?/ ?\d+)\s*$", re.I)
_ASIDE = re.compile(r"\(\s*(?:cf|vgl|see|compare|siehe|voir|véase|comp)\b[^()]*\)", re.I)
_END = re.compile(r"(?<=[.!?])\s+")
_TAG = re.compile(r"<[^<>]{1,80}>|&[a-z]{2,8};")
# Words that introduce a citation; a sentence with one of them and a digit is not judged.
CITING = ("see", "compare", "cf", "vgl", "siehe", "vergleiche", "voir", "comparer", "véase", "compárese")


def paragraphs(text: str | None) -> list[str]:
    """The numbered paragraphs, without headnotes, headers, page lines, orders, bracketed citations and sentences quoted from the headnote."""
    if text is None or not text.strip():
        return []
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    lines = text.split("\n")
    own: list[list[str]] = []
    inside, noting, note = False, False, []
    for line in lines:
        if noting and not line.strip():
            noting = False
        if not line or line.isspace() or (len(line) < 130 and any(map(str.isdigit, line[-22:])) and _PAGE.match(line)):
            continue
        if mark := _MARK.match(line):
            inside, noting = True, False
            own.append([line[mark.end() :]])
        elif _ORDER.match(line):
            inside = noting = False
        elif head := _HEADNOTE.match(line):
            inside, noting = False, True
            note.append(line[head.end() :])
        elif noting:
            note.append(line)
        elif inside:
            own[-1].append(line)
    if not own:
        own = [lines]
    quoted = [q for q in _END.split(" ".join(" ".join(note).split())) if len(q) > 40]
    out: list[str] = []
    for parts in own:
        body = " ".join(parts) if len(parts) > 1 else parts[0]
        if "<" in body or "&" in body:
            body = _TAG.sub(" ", body)
        if quoted:
            flat = " ".join(body.split())
            for q in quoted:
                flat = flat.replace(q, " ")
            body = flat
        out.append(_ASIDE.sub(" ", body) if "(" in body else body)
    return out


class Bags:
    """The sentences of a batch as bags of distinct words; sentences end at ``.``, ``!`` or ``?`` before white space."""

    def __init__(self, texts: list[str | None]) -> None:
        found = [paragraphs(t) for t in texts]
        flat = [p for f in found for p in f]
        cps, offsets = K.code_points(pa.array(flat, pa.large_string()))
        cps = K.lower_table()[cps]
        kinds = K.classes()[cps]
        ends = np.flatnonzero(((cps[:-1] == 46) | (cps[:-1] == 33) | (cps[:-1] == 63)) & (kinds[1:] == K.SPACE)) + 1 if len(cps) else np.empty(0, np.int64)
        bounds = np.union1d(ends, offsets)
        self.per_text = np.diff(np.append(0, np.searchsorted(bounds[1:], offsets[np.cumsum([len(f) for f in found])], side="right"))) if len(found) else np.empty(0, np.int64)
        starts = K.runs((kinds == K.LETTER).astype(np.uint8), offsets)
        lengths = np.diff(np.append(starts, len(cps)))
        letter = kinds[starts] == K.LETTER if len(starts) else np.empty(0, bool)
        starts, lengths = starts[letter], lengths[letter]
        self.words, self.distinct = pd.factorize(K.hashes(cps, starts, lengths))
        self.first = np.empty(len(self.distinct), np.int64)
        self.first[self.words[::-1]] = np.arange(len(self.words))[::-1]
        self._at = (cps, starts, lengths)
        at = np.searchsorted(starts, bounds)
        self.counts = np.diff(at)
        digits = np.diff(np.searchsorted(np.flatnonzero(kinds == K.NUMBER), bounds)) > 0
        citing = np.isin(self.distinct, _citing())[self.words] if len(self.words) else np.empty(0, bool)
        cites = np.diff(np.append(0, np.cumsum(citing))[at]) > 0
        self.judged = (self.counts > 0) & ~(digits & cites)

    def spelling(self, k: int) -> str:
        cps, starts, lengths = self._at
        s = starts[self.first[k]]
        return cps[s : s + lengths[self.first[k]]].tobytes().decode("utf-32-le", "replace")

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sums of rows of values over the words of each sentence."""
        total = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0)])
        ends = np.append(0, np.cumsum(self.counts))
        return total[ends[1:]] - total[ends[:-1]]

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the character trigrams of each distinct word, flat, and the number of them per word."""
        each = [grams(self.spelling(k)) for k in range(len(self.distinct))]
        return np.array([g for e in each for g in e], np.int64), np.array([len(e) for e in each], np.int64)


@lru_cache(1)
def _citing() -> np.ndarray:
    cps, offsets = K.code_points(pa.array(CITING))
    return K.hashes(cps, offsets[:-1], np.diff(offsets))


def grams(word: str) -> list[int]:
    padded = f"<{word}>"
    return [hash_text(padded[i : i + 3]) % GRAM_SLOTS for i in range(len(padded) - 2)]


@lru_cache(1 << 16)
def hash_text(s: str) -> int:
    h = 2166136261
    for b in s.encode("utf-8", "replace"):
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return h


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Model:
    word: np.ndarray
    gram: np.ndarray
    bias: np.ndarray
    length: np.ndarray
    calibration: np.ndarray

    known: dict[int, np.ndarray] = field(default_factory=dict)

    def of_words(self, bags: Bags) -> np.ndarray:
        """The weights of each distinct word: its own and the mean of its trigrams' (kept for words met before)."""
        if len(self.known) > 200_000:
            self.known.clear()
        for k, h in enumerate(bags.distinct.tolist()):
            if h not in self.known:
                self.known[h] = self.word[h % WORD_SLOTS] + self.gram[grams(bags.spelling(k))].mean(axis=0)
        return np.array([self.known[h] for h in bags.distinct.tolist()]).reshape(len(bags.distinct), LEVELS)

    def of_sentences(self, bags: Bags) -> tuple[np.ndarray, np.ndarray]:
        """The distribution over levels of each sentence, and its weight (its number of words, 0 for none)."""
        return self.score(bags, self.of_words(bags))

    def score(self, bags: Bags, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.maximum(bags.counts, 1)[:, None]
        z = bags.sums(weights[bags.words]) / np.sqrt(n) + np.log(n) * self.length + self.bias
        return softmax(z), np.where(bags.judged, bags.counts, 0).astype(float)

    def features(self, bags: Bags) -> np.ndarray:
        """For each document the mean sentence distribution, weighted by words; NaN where there is no word."""
        p, weight = self.of_sentences(bags)
        ends = np.append(0, np.cumsum(bags.per_text))
        total = np.concatenate([np.zeros((1, LEVELS + 1)), np.cumsum(np.column_stack([p * weight[:, None], weight]), axis=0)])
        sums = total[ends[1:]] - total[ends[:-1]]
        with np.errstate(invalid="ignore", divide="ignore"):
            return sums[:, :LEVELS] / sums[:, LEVELS:]

    def documents(self, bags: Bags) -> np.ndarray:
        """The calibrated distribution over levels of each document."""
        return softmax(expand(self.features(bags)) @ self.calibration)


def expand(mean: np.ndarray) -> np.ndarray:
    level = mean @ np.arange(1, LEVELS + 1)
    return np.column_stack([mean, level, level**2, np.ones(len(mean))])


def _adam(params: list[np.ndarray], gradient, rounds: int, rate: float) -> None:
    m = [np.zeros_like(p) for p in params]
    v = [np.zeros_like(p) for p in params]
    for t in range(1, rounds + 1):
        for p, g, a, b in zip(params, gradient(*params), m, v):
            a *= 0.9
            a += 0.1 * g
            b *= 0.999
            b += 0.001 * g * g
            p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)


def fit(texts: list[str], votes: np.ndarray, rounds: int = 80) -> Model:
    """Fit the sentence model on two thirds of the documents and the calibration on the others."""
    held = np.arange(len(texts)) % 3 == 2
    bags = Bags([t for t, h in zip(texts, held) if not h])
    target = np.repeat(votes[~held], bags.per_text, axis=0)
    used = bags.judged
    slots = (bags.distinct % np.uint64(WORD_SLOTS)).astype(np.int64)
    flat, counts = bags.grams()
    owner = np.repeat(np.arange(len(counts)), counts)
    n = np.maximum(bags.counts, 1)[:, None]
    sentence_of = np.repeat(np.arange(len(bags.counts)), bags.counts)
    model = Model(np.zeros((WORD_SLOTS, LEVELS)), np.zeros((GRAM_SLOTS, LEVELS)), np.zeros(LEVELS), np.zeros(LEVELS), np.zeros((LEVELS + 3, LEVELS)))
    penalty, total = 1e-5, max(1, int(used.sum()))

    def gradient(word, gram, bias, length):
        weights = word[slots] + np.add.reduceat(gram[flat], np.cumsum(counts) - counts, axis=0) / counts[:, None]
        p, _ = model.score(bags, weights)
        d = np.where(used[:, None], p - target, 0) / total
        per_token = (d / np.sqrt(n))[sentence_of]
        per_word = np.column_stack([np.bincount(bags.words, per_token[:, k], len(counts)) for k in range(LEVELS)])
        g_word, g_gram = np.zeros_like(word), np.zeros_like(gram)
        np.add.at(g_word, slots, per_word)
        np.add.at(g_gram, flat, (per_word / counts[:, None])[owner])
        return g_word + penalty * word, g_gram + penalty * gram, d.sum(axis=0), (d * np.log(n)).sum(axis=0)

    _adam([model.word, model.gram, model.bias, model.length], gradient, rounds, 0.05)
    seen = model.features(Bags([t for t, h in zip(texts, held) if h]))
    ok = np.isfinite(seen).all(axis=1)
    x, y = expand(seen[ok]), votes[held][ok]
    _adam([model.calibration], lambda c: [x.T @ (softmax(x @ c) - y) / max(1, len(x)) + 1e-4 * c], 1500, 0.03)
    return model


def labelled(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """At most ``sample`` labelled documents with text, and the distribution of their raters' votes."""
    once = labels.filter("doc_id is not null and level between 1 and 5").groupBy("doc_id", "rater").agg(F.min("level").alias("level"))
    votes = once.groupBy("doc_id").agg(*[F.sum((F.col("level") == k).cast("int")).alias(f"v{k}") for k in range(1, LEVELS + 1)])
    chosen = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    got = documents.filter(F.length(F.trim("text")) > 0).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy("doc_id").collect()
    v = np.array([[r[f"v{k}"] for k in range(1, LEVELS + 1)] for r in got], float).reshape(len(got), LEVELS)
    return [r["text"] for r in got], v / np.maximum(v.sum(axis=1, keepdims=True), 1)


def levels(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, level, difficulty, p_demanding`` of every document; nulls where there is nothing to judge."""
    send = documents.sparkSession.sparkContext.broadcast(model)  # a fixed number of slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = send.value
        for batch in batches:
            for a, b in K.slices(batch.column(1), 3_000_000):
                part = batch.slice(a, b - a)
                p = model.documents(Bags(part.column(1).to_pylist()))
                none = ~np.isfinite(p).all(axis=1)
                level = np.where(none, 0, np.nan_to_num(p).argmax(axis=1) + 1)
                mean = p @ np.arange(1, LEVELS + 1)
                high = p[:, 3:].sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(level.astype(np.int32), mask=none), pa.array(mean, mask=none), pa.array(high, mask=none)],
                    ["doc_id", "level", "difficulty", "p_demanding"],
                )

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, level int, difficulty double, p_demanding double")
