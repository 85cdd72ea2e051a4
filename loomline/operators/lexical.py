"""Full-text search: stored postings, BM25 and BM25F, expansion, phrases and compound queries.

An index is written once: blocks of postings (field, term, and the documents, frequencies, lengths and positions of as many texts as were
analysed together), in files sorted by term, so that a query's filter on terms reads only the row groups that hold them, and
``terms`` (term, df). Each text is analysed once, for the index; queries never see it again. Blocks of the empty term hold every
document and field, and its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernel as K
from ..functions import text as X
from ..sources.tables import folder

EXPANDED = 64


def blocks(docs: DataFrame, key: str, fields: list[str], **filters: bool) -> DataFrame:
    """``field, term, docs, tfs, lens, positions``: the documents of a term, as many as stand in one slice of the texts. No shuffle.

    A block of the empty term holds every document of the slice.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in range(len(fields)):
                for a, b in K.slices(batch.column(1 + number)):
                    keys, texts = batch.column(0).slice(a, b - a), batch.column(1 + number).slice(a, b - a)
                    row, sizes, words, lists = X.postings_of(texts, **filters)
                    coded = words.dictionary_encode()
                    code = coded.indices.to_numpy(zero_copy_only=False)
                    order = np.argsort(code, kind="stable")
                    # the empty term first, with all documents
                    owner = np.concatenate([np.arange(len(texts)), row[order]])
                    starts = np.append(0, len(texts) + np.flatnonzero(np.append(True, code[order][1:] != code[order][:-1]))) if len(code) else np.zeros(1, np.int64)
                    cuts = pa.array(np.append(starts, len(owner)).astype(np.int32))
                    held = lists.take(pa.array(order))
                    at = np.append(np.zeros(len(texts), np.int32), held.offsets.to_numpy() - held.offsets[0].as_py())
                    positions = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), held.flatten())
                    columns = [keys.take(pa.array(owner)), pa.array(np.diff(at).astype(np.int32)), pa.array(sizes[owner].astype(np.int32)), positions]
                    term = pa.concat_arrays([pa.array([""], pa.string()), coded.dictionary.take(pa.array(code[order][starts[1:] - len(texts)]))])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(term), number, np.int32)), term, *[pa.ListArray.from_arrays(cuts, c) for c in columns]], ["field", "term", "docs", "tfs", "lens", "positions"])

    return docs.select(key, *fields).mapInArrow(run, f"field int, term string, docs array<{kind}>, tfs array<int>, lens array<int>, positions array<array<int>>")


@dataclass
class Index:
    """A stored index, and what its queries need to know of it."""

    spark: SparkSession
    path: str
    fields: list[str]
    filters: dict[str, bool]
    known: dict = field(default_factory=dict)

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def rows(self, wanted: Column, positions: bool = False) -> DataFrame:
        """``doc, field, term, tf, len`` (and ``positions``) of the blocks whose field or term is wanted; positions are read only if asked for."""
        names = {"docs": "doc", "tfs": "tf", "lens": "len"} | ({"positions": "positions"} if positions else {})
        each = self.blocks.filter(wanted).select("field", "term", F.explode(F.arrays_zip(*names)).alias("p"))
        return each.select("field", "term", *[F.col(f"p.{c}").alias(n) for c, n in names.items()])

    @property
    def postings(self) -> DataFrame:
        return self.rows(F.lit(True), positions=True)

    @property
    def terms(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/terms")

    @property
    def documents(self) -> DataFrame:
        """``doc, field, len`` of every document."""
        return self.rows(F.col("term") == "").select("doc", "field", "len")

    def counts(self) -> tuple[int, list[float]]:
        """The number of documents, and the mean length of every field: one row per field reaches the driver."""
        if "counts" not in self.known:
            rows = {r["field"]: (r["n"], r["avg"]) for r in self.documents.groupBy("field").agg(F.count("*").alias("n"), F.avg("len").alias("avg")).collect()}
            self.known["counts"] = (rows.get(0, (0, 0))[0], [rows.get(f, (0, 1.0))[1] or 1.0 for f in range(len(self.fields))])
        return self.known["counts"]

    def df(self, terms: list[str]) -> dict[str, int]:
        """In how many documents each of the terms stands."""
        return {t: 0 for t in terms} | {r["term"]: r["df"] for r in self.terms.filter(F.col("term").isin(terms)).collect()}

    def of(self, terms: list[str], positions: bool = False) -> DataFrame:
        return self.rows(F.col("term").isin(terms), positions)

    def analyze(self, query: str) -> list[str]:
        return [t for t, _ in X.analyze(query, **self.filters)]


def index(docs: DataFrame, key: str, text: str | list[str], path: str | None = None, **filters: bool) -> Index:
    """Analyse the documents once and store the index at ``path`` (a new folder beside the intermediate tables unless given).

    Rows are spread by term, and a term that is too frequent for one task by rebalancing; files are sorted by term. A document
    given twice is counted twice; null and empty texts are documents without terms.
    """
    fields = [text] if isinstance(text, str) else list(text)
    spark, path = docs.sparkSession, path or folder(docs.sparkSession)
    tasks = spark.sparkContext.defaultParallelism
    if len(docs.inputFiles()) < tasks:
        # few files have few row groups, and the texts of one are analysed in one task
        docs = docs.select(key, *fields).repartition(tasks)
    rows = blocks(docs, key, fields, **filters).hint("rebalance", "term").sortWithinPartitions("term", "field")
    rows.write.mode("overwrite").option("parquet.block.size", 16 << 20).parquet(f"{path}/postings")
    made = Index(spark, path, fields, filters)
    if len(fields) == 1:
        counted = made.blocks.filter("term <> ''").groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    else:
        counted = made.rows(F.col("term") != "").groupBy("term").agg(F.count_distinct("doc").alias("df"))
    counted.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    return made


def idf(n: int, df: int) -> float:
    return log(1.0 + (n - df + 0.5) / (df + 0.5))


def bm25(ix: Index, query: str, k1: float = 1.2, b: float = 0.75, minimum: int = 1, distinct: bool = True) -> DataFrame:
    """``doc, score, matched`` of documents with at least ``minimum`` of the query's terms (all of them: AND).

    Terms are added in their order, so that the sum does not depend on the partitioning.
    """
    terms = ix.analyze(query)
    return score_terms(ix, {t: (1 if distinct else terms.count(t)) for t in sorted(set(terms))}, k1, b, minimum)


def _wide(ix: Index, terms: list[str], more: list[Column], field: int = 0) -> DataFrame:
    """One row per document that has any of the terms, with ``tf0, tf1, ...``."""
    each = [F.max(F.when(F.col("term") == t, F.col("tf"))).alias(f"tf{i}") for i, t in enumerate(terms)]
    return ix.rows(F.col("term").isin(terms) & (F.col("field") == field), bool(more)).groupBy("doc").agg(F.max("len").alias("len"), *each, *more)


def score_terms(ix: Index, weights: dict[str, int], k1: float = 1.2, b: float = 0.75, minimum: int = 1) -> DataFrame:
    terms = sorted(weights)
    if not terms:
        return ix.documents.select("doc", F.lit(0.0).alias("score"), F.lit(0).alias("matched")).limit(0)
    (n, mean), df = ix.counts(), ix.df(terms)
    score, matched = F.lit(0.0), F.lit(0)
    for i, t in enumerate(terms):
        f = F.col(f"tf{i}").cast("double")
        part = F.lit(idf(n, df[t])) * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("len") / F.lit(mean[0])))
        score = score + F.when(f > 0, part * weights[t]).otherwise(0.0)
        matched = matched + F.when(f > 0, 1).otherwise(0)
    return _wide(ix, terms, []).select("doc", score.alias("score"), matched.alias("matched")).filter(F.col("matched") >= minimum)


def bm25f(ix: Index, weights: dict[str, int], query: str, k1: float = 1.2, b: float = 0.75, explain: bool = False) -> DataFrame:
    """``doc, score_nanos``: per-field weights in millionths, normalised frequencies summed, each term rounded to billionths.

    ``explain`` adds ``terms``, an array of ``term, df, score_nanos`` of the terms a document has.
    """
    terms = sorted(set(ix.analyze(query)))
    if not terms:
        return ix.documents.select("doc", F.lit(0).cast("bigint").alias("score_nanos")).limit(0)
    (n, mean), df = ix.counts(), ix.df(terms)
    number = {f: i for i, f in enumerate(ix.fields)}
    named = {(f, i): F.when((F.col("field") == number[f]) & (F.col("term") == t), F.struct("tf", "len")) for f in weights for i, t in enumerate(terms)}
    wide = ix.of(terms).groupBy("doc").agg(*[F.max(c).alias(f"x_{number[f]}_{i}") for (f, i), c in named.items()])
    total, parts = F.lit(0).cast("bigint"), []
    for i, t in enumerate(terms):
        tf = F.lit(0.0)
        for f, w in weights.items():
            x = F.col(f"x_{number[f]}_{i}")
            tf = tf + F.when(x.isNotNull(), w / 1e6 * x["tf"] / (1 - b + b * x["len"] / F.lit(mean[number[f]]))).otherwise(0.0)
        nanos = F.round(F.lit(idf(n, df[t])) * tf * (k1 + 1) / (tf + k1) * 1e9).cast("bigint")
        total = total + nanos
        parts.append(F.when(tf > 0, F.struct(F.lit(t).alias("term"), F.lit(df[t]).alias("df"), nanos.alias("score_nanos"))))
    scored = wide.select("doc", total.alias("score_nanos"), *([F.array_compact(F.array(*parts)).alias("terms")] if explain else []))
    return scored.filter("score_nanos > 0")


def bm25f_retrieve(ix: Index, weights: dict[str, int], query: str, limit: int) -> DataFrame:
    """``outcome, doc, score_nanos, terms``: the best documents with explanations, or one row ``no_candidates``."""
    top = bm25f(ix, weights, query, explain=True).orderBy(F.desc("score_nanos"), "doc").limit(limit)
    found = top.select(F.lit("match").alias("outcome"), *top.columns)
    return found if found.limit(1).count() else ix.spark.createDataFrame([("no_candidates",)], "outcome string").join(found.drop("outcome"), F.lit(True), "left")


def expand(found: DataFrame) -> list[str]:
    """At most 64 terms reach the driver; more is an error, not a cut."""
    terms = [r["term"] for r in found.select("term").orderBy("term").limit(EXPANDED + 1).collect()]
    if len(terms) > EXPANDED:
        raise ValueError(f"more than {EXPANDED} terms")
    return terms


def prefix_terms(ix: Index, query: str) -> list[str]:
    """The query's terms, the last one as every indexed term that starts with it."""
    terms = ix.analyze(query)
    return sorted({*terms[:-1], *expand(ix.terms.filter(F.col("term").startswith(terms[-1])))}) if terms else []


def _near(term: str, distance: int) -> Column:
    if distance not in (1, 2):
        raise ValueError("a distance of 1 or 2")
    # a term of a length that differs by more is no match, and its distance need not be computed
    return F.length("term").between(len(term) - distance, len(term) + distance) & (F.levenshtein(F.col("term"), F.lit(term), distance) >= 0)


def fuzzy_terms(ix: Index, query: str, distance: int) -> list[str]:
    """Indexed terms within the edit distance (1 or 2) of any term of the query."""
    terms = ix.analyze(query)
    return expand(ix.terms.filter(reduce(lambda a, b: a | b, [_near(t, distance) for t in terms]))) if terms else []


def _less(i: int):
    return lambda x: x - i


def _in_order(places: list[Column]) -> Column:
    """Whether the positions of the terms follow each other."""
    shifted = [F.transform(p, _less(i)) for i, p in enumerate(places)]
    return F.coalesce(F.size(reduce(F.array_intersect, shifted)) > 0, F.lit(False))


def phrase(ix: Index, query: str) -> DataFrame:
    """``doc``: documents with the query's terms at consecutive positions."""
    terms = ix.analyze(query)
    if not terms:
        return ix.documents.select("doc").limit(0)
    every = sorted(set(terms))
    wide = _wide(ix, every, [F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"p{i}") for i, t in enumerate(every)])
    return wide.filter(_in_order([F.col(f"p{every.index(t)}") for t in terms])).select("doc")


def best_chunk(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """``parent, score`` of ``doc, score`` and ``doc, parent``: a parent ranks by its best chunk."""
    return hits.join(parents, "doc").groupBy("parent").agg(F.max("score").alias("score"))


def compound(ix: Index, query: dict) -> DataFrame:
    """``doc, score``: a tree of term, phrase, prefix, fuzzy and boolean (must, should, must_not) clauses.

    Each matched leaf scores 1 however often it occurs; ``should`` is required only where there is no ``must``. Depth of at most 8, 64 clauses.
    """
    leaves: list[tuple[str, list[str] | str, int]] = []

    def build(node: dict, depth: int) -> tuple:
        (kind, v), = node.items()
        if depth > 8 or len(leaves) > 64:
            raise ValueError("a depth of at most 8, and 64 clauses")
        if kind == "boolean":
            return kind, *[[build(n, depth + 1) for n in v.get(part, [])] for part in ("must", "should", "must_not")]
        terms = ix.analyze(v["term"] if kind == "fuzzy" else v)
        if not terms:
            raise ValueError("a clause without a term")
        leaves.append((kind, terms if kind == "phrase" else terms[0], v.get("distance", 1) if kind == "fuzzy" else 0))
        return "leaf", len(leaves) - 1

    tree = build(query, 1)

    def value(node: tuple, leaf, true, both, either, no):
        """Whether a node matches, over columns or over plain values."""
        if node[0] == "leaf":
            return leaf(node[1])
        must, should, bad = ([value(n, leaf, true, both, either, no) for n in part] for part in node[1:])
        out = reduce(both, must, true)
        if not must and should:
            out = reduce(either, should)
        return reduce(both, [no(b) for b in bad], out)

    flag = lambda i: F.coalesce(F.col(f"m{i}"), F.lit(False))
    columns = (flag, F.lit(True), lambda a, b: a & b, lambda a, b: a | b, lambda a: ~a)

    def score(node: tuple) -> Column:
        if node[0] == "leaf":
            return flag(node[1]).cast("int")
        parts = reduce(lambda a, b: a + b, [score(n) for n in node[1] + node[2]], F.lit(0))
        return F.when(value(node, *columns), parts).otherwise(F.lit(0))

    wanted, tests = F.lit(False), []
    for kind, v, distance in leaves:
        if kind == "phrase":
            test = None
            wanted = wanted | F.col("term").isin(sorted(set(v)))
        else:
            test = F.col("term") == v if kind == "term" else F.col("term").startswith(v) if kind == "prefix" else _near(v, distance)
            test = test & (F.col("term") != "")
            wanted = wanted | test
        tests.append(test)
    if value(tree, lambda i: False, True, lambda a, b: a and b, lambda a, b: a or b, lambda a: not a):
        wanted = wanted | (F.col("term") == "")  # documents without any of the leaves match too
    parts = sorted({t for kind, v, _ in leaves if kind == "phrase" for t in v})
    aggregates = [F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"p{i}") for i, t in enumerate(parts)]
    aggregates += [F.max(test).alias(f"m{i}") for i, test in enumerate(tests) if test is not None]
    wide = ix.rows(wanted & (F.col("field") == 0), bool(parts)).groupBy("doc").agg(F.count("*").alias("_rows"), *aggregates)
    for i, (kind, v, _) in enumerate(leaves):
        if kind == "phrase":
            wide = wide.withColumn(f"m{i}", _in_order([F.col(f"p{parts.index(t)}") for t in v]))
    return wide.filter(value(tree, *columns)).select("doc", score(tree).cast("double").alias("score"))
