"""Splitting oversized texts at natural boundaries (problem 3).

Method: structure-tree packing. A text is parsed into a tree (sections by headings; fenced blocks, tables, list
items with their nested items and paragraphs inside; lines; sentences; clauses; words). Sibling subtrees are
merged bottom-up while they stay under the limit, and only a subtree that is too large by itself, beside the overlap, is
descended into. Between two siblings the cut is preferred whose size comes nearest to a multiple of the checkpoint.

A token is a longest run of characters other than blank, tab, CR and LF. A piece has the last ``overlap`` tokens
of the piece before it in front (fewer if that piece has fewer), and with them never more than the limit.

Defined cases: null, empty and blank texts, and texts within the limit, give one piece, the text itself (null
stays null, with 0 tokens); a limit that is null or below 1 leaves the text whole; an overlap of the limit or
more counts as the limit less one; a token is never cut, however long it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[^ \t\r\n]+")
_HEADING = re.compile(r" {0,3}(#{1,6})\s+\S|.{1,80}\n(=+|-{3,})\s*$")
_ITEM = re.compile(r"(\s*)(?:[-*+•]|\d{1,4}[.)])\s+\S")
_FENCE = re.compile(r"\s*(```|~~~)")
_LOG = re.compile(r"\s*(?:\d{1,2}:\d{2}|\d{4}-\d{2}-\d{2}|\[)")
SECTION, BLOCK, LINE, SENTENCE, CLAUSE, WORD = range(6)


class Node:
    """A span of tokens, and how weak the boundary in front of it is (SECTION strongest, WORD weakest)."""

    __slots__ = ("start", "stop", "kind", "children")

    def __init__(self, start: int, stop: int, kind: int, children: list[Node] | None = None) -> None:
        self.start, self.stop, self.kind, self.children = start, stop, kind, children or []


def boundaries(text: str) -> tuple[list[tuple[int, int]], list[int]]:
    """Token spans, and for each token the kind of the boundary in front of it."""
    spans = [m.span() for m in _TOKEN.finditer(text)]
    kinds = [WORD] * len(spans)
    line_start, fence, blank, previous = {}, False, True, ""
    at = 0
    for line in text.splitlines(keepends=True):
        bare = line.strip(" \t\r\n")
        if not bare:
            blank = True
        else:
            if _FENCE.match(line):
                kind = LINE if fence else BLOCK
                fence = not fence
            elif fence:
                kind = LINE
            elif _HEADING.match(line):
                kind = SECTION
            elif blank or (_ITEM.match(line) and not line[0].isspace()) or _LOG.match(line):
                kind = BLOCK
            else:
                kind = LINE
            line_start[at + len(line) - len(line.lstrip(" \t\r\n"))] = kind
            blank, previous = False, bare
        at += len(line)
    for i, (a, b) in enumerate(spans):
        if a in line_start:
            kinds[i] = line_start[a]
        elif i:
            last = text[spans[i - 1][1] - 1]
            if last in ")]\"'”»" and spans[i - 1][1] - spans[i - 1][0] > 1:
                last = text[spans[i - 1][1] - 2] if text[spans[i - 1][1] - 2] in ".!?" else last
            if last in ".!?。！？…":
                kinds[i] = SENTENCE
            elif last in ";:,":
                kinds[i] = CLAUSE
    return spans, kinds


def tree(kinds: list[int], start: int, stop: int, kind: int = SECTION) -> Node:
    """The tree over tokens start..stop: each level splits at the boundaries of its kind."""
    node = Node(start, stop, kinds[start] if start < stop else WORD)
    while kind < WORD:
        cuts = [i for i in range(start + 1, stop) if kinds[i] <= kind]
        if cuts:
            edges = [start, *cuts, stop]
            node.children = [tree(kinds, a, b, kind + 1) for a, b in zip(edges, edges[1:])]
            break
        kind += 1
    return node


def pack(node: Node, limit: int, overlap: int, target: int) -> list[tuple[int, int]]:
    """Token ranges of the pieces (without overlap), each at most ``limit`` with the overlap in front of it."""
    return merged(units(node, limit - overlap, target), limit, limit - overlap, target)


def units(node: Node, room: int, target: int) -> list[tuple[int, int]]:
    """A node that fits as one range; the ranges of a larger one's children, merged; of words, cuts at multiples of the checkpoint."""
    if node.stop - node.start <= room:
        return [(node.start, node.stop)]
    if node.children:
        return merged([u for child in node.children for u in units(child, room, target)], room, room, target)
    size = room if target <= 0 or room < target else room // target * target
    return [(a, min(a + size, node.stop)) for a in range(node.start, node.stop, size)]


def merged(ranges: list[tuple[int, int]], first_room: int, room: int, target: int) -> list[tuple[int, int]]:
    """Neighbouring ranges put together while they fit; a range is never cut."""
    out: list[tuple[int, int]] = []
    i = 0
    while i < len(ranges):
        start, space = ranges[i][0], room if out else first_room
        ends = [ranges[i][1]]
        for _, stop in ranges[i + 1 :]:
            if stop - start > space:
                break
            ends.append(stop)
        if ends[-1] < ranges[-1][1]:
            ends = ends[: ends.index(best(ends, start, space, target)) + 1]
        out.append((start, ends[-1]))
        i += len(ends)
    return out


def best(cuts: list[int], first: int, room: int, target: int) -> int:
    """The cut nearest to a multiple of the checkpoint among those that leave the piece at least half full."""
    full = [c for c in cuts if (c - first) * 2 >= min(room, cuts[-1] - first)]
    if target <= 0:
        return full[-1]
    return min(full, key=lambda c: (min((c - first) % target, -(c - first) % target), -c))


def split(text: str | None, limit: int | None, target: int | None, overlap: int | None) -> list[tuple[int, str | None, int, int]]:
    """``(piece, text, tokens, overlapping tokens)`` of every piece of the text."""
    if text is None:
        return [(0, None, 0, 0)]
    spans, kinds = boundaries(text)
    if not limit or limit < 1 or len(spans) <= limit:
        return [(0, text, len(spans), 0)]
    overlap = max(0, min(overlap or 0, limit - 1))
    out = []
    before = 0
    for n, (a, b) in enumerate(pack(tree(kinds, 0, len(spans)), limit, overlap, target or 0)):
        lead = min(overlap, a - before) if n else 0
        before = a - lead
        out.append((n, text[spans[a - lead][0] : spans[b - 1][1]], b - a + lead, lead))
    return out


def oversized(documents: DataFrame, profiles: DataFrame) -> DataFrame:
    """Current documents, as ``object_id, text`` and the limits of their profile, that exceed the limit.

    The tokens are counted by the JVM at the scan, and only oversized texts are shuffled.
    """
    limits = profiles.filter("profile_id is not null").groupBy("profile_id").agg(*[F.max(c).alias(c) for c in ("max_input_tokens_per_input", "checkpoint_chunk_tokens", "overlap_tokens")])
    stripped = F.translate("text", "\t\r\n", "   ")
    big = documents.filter("object_id is not null and text is not null").join(F.broadcast(limits), "profile_id")
    big = big.filter(F.length("text") >= F.col("max_input_tokens_per_input")).withColumn("_n", F.size(F.filter(F.split(stripped, " "), lambda x: x != "")))
    big = big.filter(F.col("_n") > F.col("max_input_tokens_per_input"))
    newest = documents.filter("object_id is not null").groupBy("object_id").agg(F.max(F.coalesce("version", F.lit(-1))).alias("_newest"))
    once = big.select("object_id", F.coalesce("version", F.lit(-1)).alias("_v"), "text", "max_input_tokens_per_input", "checkpoint_chunk_tokens", "overlap_tokens")
    return once.dropDuplicates(["object_id", "_v"]).join(newest, "object_id").filter("_v = _newest").drop("_v", "_newest")


def pieces(documents: DataFrame, profiles: DataFrame) -> DataFrame:
    """``object_id, piece, text, n_tokens, n_overlap`` of every current document that exceeds its limit."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, text, limit, target, overlap in frame.itertuples(index=False):
                out += [(key, *p) for p in split(text, limit, target, overlap)]
            yield pd.DataFrame(out, columns=["object_id", "piece", "text", "n_tokens", "n_overlap"])

    return oversized(documents, profiles).mapInPandas(run, "object_id bigint, piece int, text string, n_tokens int, n_overlap int")
