"""Queries without SQL, over all rows of the smallest tables, against plain Python."""

import hashlib
import ipaddress
import re
import unicodedata
from collections import Counter, defaultdict
from math import log

import pytest

from loomline.functions import text as X
from loomline.plans import queries as Q


@pytest.fixture(scope="module")
def documents(spark, data):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def memories(spark, data):
    return [(r["memory_id"], r["text"]) for r in spark.read.parquet(f"{data}/memory_store.parquet").select("memory_id", "text").collect()]


def chunks(df, key="doc_id"):
    out = defaultdict(list)
    for r in df.collect():
        out[r[key]].append((r["ordinal"], r["start"], r["stop"]))
    return {k: [c[1:] for c in sorted(v)] for k, v in out.items()}


def test_fixed_chunks(spark, data, documents):
    got = chunks(Q.chunk_fixed(spark, data))
    assert set(got) == {k for k, t in documents.items() if t}
    for k, ranges in got.items():
        raw = documents[k].encode()
        assert ranges[0][0] == 0 and ranges[-1][1] == len(raw)
        for a, b in ranges:
            raw[a:b].decode()
            assert b - a <= 2048
        for (_, end), (start, stop) in zip(ranges, ranges[1:]):
            assert 128 <= end - start <= 131 and stop > end


def test_sentence_chunks(spark, data, documents):
    got = chunks(Q.chunk_sentence(spark, data))
    for k, t in documents.items():
        want, held, at = [], b"", 0
        for sentence in re.findall(r".*?[.!?。！？]\s+|.+\Z", t or "", re.S):
            held += sentence.encode()
            while len(held) > 2048:
                cut = 2048
                while held[cut] & 0xC0 == 0x80:
                    cut -= 1
                want.append((at, at + cut))
                at, held = at + cut, held[cut:]
            if len(held) >= 1024:
                want.append((at, at + len(held)))
                at, held = at + len(held), b""
        assert got.get(k, []) == want + [(at, at + len(held))] * bool(held)
    for r in Q.chunk_documents(spark, data).collect():
        assert documents[r["parent"]].encode()[r["start"] : r["stop"]].decode() == r["text"]
        assert r["chunk_id"] == hashlib.sha256("\0".join(str(r[c]) for c in ("parent", "start", "stop", "text")).encode()).hexdigest()


def test_highlights_of_all_documents(spark, data, documents):
    for r in Q.highlight(spark, data).collect():
        normal = unicodedata.normalize("NFKC", documents[r["doc_id"]]).casefold()
        at = 0
        for f in r["fragments"]:
            assert len(f.encode()) <= 160 and re.search(r"\b(?:tribunal|judge)", f)
            at = normal.index(f, at) + len(f)
        assert len(r["fragments"]) <= 4 and bool(r["fragments"]) == bool(re.search(r"\b(?:tribunal|judge)\b", normal))


def test_flags_of_all_memories(spark, data, memories):
    got = Counter((r["memory_id"], tuple(r["kinds"])) for r in Q.pii_flags(spark, data).collect())
    assert Counter(k for k, _ in got.elements()) == Counter(k for k, _ in memories)
    texts = dict(memories)
    for key, kinds in got:
        t = texts[key] or ""

        def valid(part):
            try:
                return bool(ipaddress.IPv4Address(part))
            except ValueError:
                return False

        assert ("ipv4" in kinds) == any(valid(p.strip(".")) for p in re.split(r"[^0-9.]+", t))
        assert ("email" in kinds) == bool(re.search(r"[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]@[A-Za-z0-9.-]+\.[A-Za-z0-9-]{2,}(?![A-Za-z0-9.-])", t))
        assert ("ssn" in kinds) == any(re.fullmatch(r"[^A-Za-z0-9-]*[0-9]{3}-[0-9]{2}-[0-9]{4}[^A-Za-z0-9-]*", w) for w in t.split())


def test_captures_of_all_memories(spark, data, memories):
    got = Counter((r["memory_id"], r["kind"], r["line"]) for r in Q.capture_extract(spark, data).collect())
    want = Counter()
    for key, t in memories:
        fence = False
        for line in (t or "").split("\n"):
            line = line.rstrip("\r")
            if re.match(r"\s*(```|~~~)", line):
                fence = not fence
            elif not fence and not re.match(r"    |\t|\s*>", line):
                bare = re.sub(r"^[-* ]+", "", line.strip()).strip()
                m = re.match(r"(?i)(decision|decisión|constraint|restricción|fact|hecho|journal|diario):(.*)", bare)
                head = {"d": ("decision", "Decision"), "c": ("constraint", "Constraint"), "r": ("constraint", "Constraint"), "f": ("fact", "Fact"), "h": ("fact", "Fact"), "j": ("note", "Journal")}
                if m:
                    kind, name = ("note", "Journal") if m[1].lower() == "diario" else head[m[1][0].lower()]
                    content = m[2].strip()
                    if kind == "note" and not re.match(r"I(?:'m|'ve|’m)? |Yo |Estoy |Pienso |Creo ", content):
                        continue
                elif bare.lower().startswith("decidimos "):
                    kind, name, content = "decision", "Decision", bare
                elif re.search(r" (?:must|never|siempre|nunca) ", bare.lower()):
                    kind, name, content = "constraint", "Constraint", bare
                else:
                    continue
                if len(content.encode()) >= 8 and len(f"{name}: {content}".encode()) <= 512 and not X.has_secret(content) and not X.pii_kinds(content):
                    want[key, kind, f"{name}: {content}"] += 1
    assert got == want


def test_stemmed_search_of_all_documents(spark, data, documents):
    docs = {k: [t for t, _ in X.analyze(t, fold=True, stop=True, stemmed=True)] for k, t in documents.items() if t is not None}
    terms, mean, scores = sorted({t for t, _ in X.analyze("the farmers selling boxes", fold=True, stop=True, stemmed=True)}), sum(map(len, docs.values())) / len(docs), {}
    df = {t: sum(t in d for d in docs.values()) for t in terms}
    for k, d in docs.items():
        f = {t: d.count(t) for t in terms}
        if any(f.values()):
            scores[k] = sum(log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * f[t] * 2.2 / (f[t] + 1.2 * (0.4 + 0.6 * len(d) / mean)) for t in terms if f[t])
    want = sorted(((round(s, 9), k) for k, s in scores.items()), key=lambda x: (-x[0], x[1]))[:10]
    assert [(r["score"], r["doc"]) for r in Q.lex_stop_stem(spark, data).collect()] == [(pytest.approx(s), k) for s, k in want]
