"""Ranking and answer metrics, and the statistics that go with them."""

from __future__ import annotations

import re
import string
from collections import Counter
from fractions import Fraction
from math import ceil
from statistics import fmean, stdev

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .keyspace import splitmix64


def ranking_metrics(rankings: DataFrame, judgements: DataFrame, k: int = 10) -> DataFrame:
    """``query, ndcg, recall, mrr`` at k of ``query, doc, rank`` (from 1) and ``query, doc, grade``; linear gain.

    Queries without a positive judgement score 0.
    """
    discount = F.log2(F.col("rank") + 1)
    hits = rankings.filter(F.col("rank") <= k).join(judgements.filter("grade > 0"), ["query", "doc"])
    got = hits.groupBy("query").agg(F.sum(F.col("grade") / discount).alias("dcg"), F.count("*").alias("hit"), F.min("rank").alias("first"))
    w = Window.partitionBy("query").orderBy(F.desc("grade"), "doc")
    positive = judgements.filter("grade > 0")
    ideal = positive.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).groupBy("query").agg(F.sum(F.col("grade") / discount).alias("best"))
    total = positive.groupBy("query").agg(F.count("*").alias("positives"))
    queries = rankings.select("query").distinct()
    rows = queries.join(got, "query", "left").join(ideal, "query", "left").join(total, "query", "left")
    return rows.select("query", F.coalesce(F.col("dcg") / F.col("best"), F.lit(0.0)).alias("ndcg"), F.coalesce(F.col("hit") / F.col("positives"), F.lit(0.0)).alias("recall"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"))


def macro_micro(df: DataFrame, cluster: str, value: str) -> DataFrame:
    """Mean of the clusters' means, and mean of all values."""
    each = df.groupBy(cluster).agg(F.avg(value).alias("m"), F.sum(value).alias("s"), F.count(value).alias("n"))
    return each.agg(F.avg("m").alias("macro"), (F.sum("s") / F.sum("n")).alias("micro"))


# Words that do not count.
ARTICLES = ("a", "an", "the")
_PUNCTUATION = str.maketrans("", "", string.punctuation.replace("'", "")) | {ord("'"): " "}


def words(text: str) -> list[str]:
    """Lower-cased words without punctuation and articles; an apostrophe divides."""
    return [w for w in text.lower().translate(_PUNCTUATION).split() if w not in ARTICLES]


def token_f1(answer: str, truth: str) -> float:
    """1 where both are empty, 0 where one is."""
    a, b = Counter(words(answer)), Counter(words(truth))
    if not a or not b:
        return float(not a and not b)
    return 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values()))


def bleu1(answer: str, truth: str) -> float:
    """The clipped share of the answer's words that the truth has; no penalty for a short answer."""
    a, b = Counter(words(answer)), Counter(words(truth))
    return sum((a & b).values()) / sum(a.values()) if a and b else 0.0


# Units behind a number.
UNITS = "%|percent|am|pm|years?|months?|weeks?|days?|hours?|minutes?|miles?|km|dollars?|bucks"
_ENTITY = re.compile(rf"[A-Z][a-zA-Z]*(?:\s+[A-Z][a-zA-Z]*)*|\b\d+(?:\.\d+)?\s*(?:{UNITS})?")


def entities(text: str, limit: int = 8) -> list[str]:
    """The first runs of capitalised words and numbers with a unit, each once whatever its case, of at least two characters."""
    found = (m.group().strip(" .,;:") for m in _ENTITY.finditer(text))
    first: dict[str, str] = {}
    for e in found:
        if len(e) > 1:
            first.setdefault(e.lower(), e)
    return list(first.values())[:limit]


def sign_flip(differences: list[float | str | Fraction]) -> Fraction:
    """The exact two-sided p of the mean under all 2**n sign changes (n up to 20); differences count as the decimals they are written as."""
    exact = [d if isinstance(d, Fraction) else Fraction(str(d)) for d in differences]
    if not 0 < len(exact) <= 20:
        raise ValueError("1 to 20 differences")
    sums = [Fraction(0)]
    for d in exact:
        sums = [s + x for s in sums for x in (d, -d)]
    return Fraction(sum(abs(s) >= abs(sums[0]) for s in sums), len(sums))


def holm(ps: dict[str, float]) -> dict[str, float]:
    """Step-down adjusted p values; equal ones are taken in order of name."""
    out, top = {}, 0.0
    for i, (p, name) in enumerate(sorted((p, name) for name, p in ps.items())):
        top = max(top, min(1.0, (len(ps) - i) * p))
        out[name] = round(top, 12)
    return dict(sorted(out.items()))


def one_standard_error(scores: dict[str, list[float]], ranks: dict[str, int]) -> str:
    """The simplest choice (least rank, then name) whose mean is within one standard error of the best mean's."""
    means = {name: fmean(v) for name, v in scores.items()}
    best = min(scores, key=lambda name: (-means[name], ranks[name], name))
    least = means[best] - stdev(scores[best]) / len(scores[best]) ** 0.5
    return min((name for name, m in means.items() if m >= least), key=lambda name: (ranks[name], name))


GOLDEN = 0x9E3779B97F4A7C15


def draws(seed: int, bound: int):
    """An endless stream of unbiased draws below the bound: the outputs of SplitMix64, those above the last whole multiple refused."""
    state, limit = seed % 2**64, 2**64 - 2**64 % bound
    while True:
        draw = splitmix64(state)
        state = (state + GOLDEN) % 2**64
        if draw < limit:
            yield draw % bound


def cluster_bootstrap(candidate: dict[str, list[float]], baseline: dict[str, list[float]], replicates: int, seed: int, level: float = 0.95) -> dict[str, tuple[float, float, float]]:
    """``macro`` and ``micro``: estimate, lower and upper nearest-rank bound of the paired difference, clusters drawn with replacement."""
    names = sorted(candidate)
    if names != sorted(baseline) or any(len(candidate[n]) != len(baseline[n]) or not candidate[n] for n in names):
        raise ValueError("clusters do not pair")
    gaps = {n: [x - y for x, y in zip(candidate[n], baseline[n])] for n in names}
    source = draws(seed, len(names))
    picks = [[names[next(source)] for _ in names] for _ in range(replicates)]
    kinds = {"macro": lambda chosen: fmean(fmean(gaps[n]) for n in chosen), "micro": lambda chosen: fmean(x for n in chosen for x in gaps[n])}

    def interval(of) -> tuple[float, float, float]:
        ordered = sorted(map(of, picks))
        rank = lambda q: ordered[max(1, ceil(q * replicates)) - 1]
        return tuple(round(x, 12) for x in (of(names), rank((1 - level) / 2), rank(1 - (1 - level) / 2)))

    return {kind: interval(of) for kind, of in kinds.items()}
