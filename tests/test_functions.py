from fractions import Fraction

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.functions import text as X
from loomline.operators import evaluation as E
from loomline.operators import keyspace as K


def test_tokens():
    assert [t for t, _ in X.tokens("Großmaß ＡＢＣ naïve ②½")] == ["grossmass", "abc", "naïve", "21", "2"]
    assert [t for t, _ in X.tokens("नमस्ते")] == ["नमस", "ते"]  # a virama is not alphabetic, a vowel sign is
    assert X.tokens(None) == X.tokens("") == X.tokens(" .,") == []
    assert X.tokens("a " + "b" * 257 + " c") == [("a", 0), ("c", 2)]


def test_filters():
    assert X.fold_ascii("crème") == "creme" and X.fold_ascii("œuvre") == "oeuvre"
    assert X.fold_ascii("ħŧŋйſ") == "htŋйſ" and X.fold_ascii("ﬁ") == "ﬁ"  # only the letters of the table
    assert X.pipeline(["lowercase", "fold", "stem"]) == {"fold": True, "stop": False, "stemmed": True}
    for bad in ([], ["fold"], ["lowercase", "stop", "fold"], ["lowercase", "lowercase"], ["lowercase", "none"]):
        with pytest.raises(ValueError):
            X.pipeline(bad)
    assert len(X.STOP_WORDS) == 33
    assert [t for t, _ in X.analyze("The Hopping cats", stop=True, stemmed=True)] == ["hop", "cat"]


@pytest.mark.parametrize("word,root", [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("conflated", "conflat"), ("relational", "relat"), ("triplicate", "triplic"), ("adoption", "adopt"), ("controll", "control"), ("sky", "sky"), ("at", "at")])
def test_stem(word, root):
    assert X.stem(word) == root


def test_glob():
    assert X.glob_regex(b"h?l*[a-c][^z]\\*").match(b"hello-by*")
    assert not X.glob_regex(b"a*").match(b"ba")
    with pytest.raises(ValueError):
        X.glob_regex(b"x" * 1025)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=300), st.integers(4, 40), st.integers(0, 3))
def test_chunk_fixed_covers(text, size, overlap):
    data, at = text.encode(), 0
    for a, b in X.chunk_fixed(text, size, overlap):
        assert a <= at < b and b - a <= size
        data[a:b].decode()
        at = b
    assert at == len(data)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. !?é\n", max_size=200), st.integers(8, 30))
def test_chunk_sentences_cover(text, maximum):
    at = 0
    for a, b in X.chunk_sentences(text, maximum // 2, maximum):
        assert a == at and a < b <= a + maximum
        at = b
    assert at == len(text.encode())


def test_sentences():
    assert X.chunk_sentences("Hi. " + "x" * 40 + ".", 10, 20)[0] == (0, 20)
    assert X.chunk_sentences("aaaa. bbbb. cccc. dddd. ", 8, 64) == [(0, 12), (12, 24)]  # closed by the sentence that reaches the target
    assert X.chunk_sentences("一。二。三。", 3, 64) == [(0, 18)] and X.chunk_sentences("一。 二。 三", 3, 64) == [(0, 7), (7, 14), (14, 17)]
    assert X.chunk_sentences("", 3, 9) == []


def test_postings_are_those_of_the_analyzer():
    texts = ["Two boxes, two", "", None, "a " + "b" * 257 + " c", "Straße ½ ÉTÉ", "the the hopping"]
    for filters in ({}, {"fold": True, "stop": True, "stemmed": True}):
        row, sizes, words, lists = X.postings_of(pa.array(texts), **filters)
        for i, t in enumerate(texts):
            want = {}
            for term, at in X.analyze(t, **filters):
                want.setdefault(term, []).append(at)
            assert {words[j].as_py(): lists[j].as_py() for j in range(len(row)) if row[j] == i} == want and sizes[i] == sum(map(len, want.values()))


@pytest.mark.parametrize("text,kinds", [
    ("mail a@b.io, 4111 1111 1111 1111", ["card", "email"]), ("4111 1111 1111 1112", []), ("DNI: 1", ["label"]), ("born, date of birth unknown", ["label"]), ("see /home/ann", ["home"]), ("a@b.c", []), ("123-45-6789.", ["ssn"]),
    ("ip 10.0.0.255 here", ["ipv4"]), ("10.0.0.256", []), ("10.01.0.2", []), ("(aa:bb:cc:dd:ee:0f)", ["mac"]), ("123e4567-e89b-12d3-a456-426614174000", ["phone", "uuid"]), ("+493012345", []), ("+493012345678", ["phone"]), ("0000 0000 0000 0000", []), (None, []), ("", []),
])
def test_pii(text, kinds):
    assert X.pii_kinds(text) == kinds


def test_detectors():
    for secret in ("ghp_x", "use sk-1", "TOKEN=1", "in .env", "Authorization: x", "api_key=1", "aB3" * 12, "(" + "aB-" * 12 + ")"):
        assert X.has_secret(secret)
    for plain in ("password policy", "a credential", "plain words", "ab" * 20, "aB3." * 3, None):
        assert not X.has_secret(plain)
    lines = "- Decision: keep one writer\n```\nfact: not this one\n~~~\n```\n> Fact: quoted line\nthe cache must be warm\njournal: I wrote the parser\nJournal: today we ate\n    fact: indented here\nFact: short\nHecho: el disco es lento\nfact: mail a@b.io for it\ntoday we ate"
    assert X.captures(lines) == [("decision", "Decision: keep one writer"), ("constraint", "Constraint: the cache must be warm"), ("note", "Journal: I wrote the parser"), ("fact", "Fact: el disco es lento")]
    assert X.captures("fact: " + "x" * 600) == [] and X.captures("y" * 70_000) == []
    assert X.truncate_utf8("aé", 2) == "a"


def test_highlights():
    found = X.highlights("one two three " * 40, ["two"], 32, 4)
    assert len(found) == 4 and all("two" in f and len(f.encode()) <= 32 for f in found)


def test_splitmix64():
    assert K.splitmix64(0) == 0xE220A8397B1DCDAF


def test_statistics():
    assert E.holm({"a": 0.01, "b": 0.04, "c": 0.03}) == {"a": 0.03, "b": 0.06, "c": 0.06}
    assert E.sign_flip([1.0, 1.0, 1.0]) == Fraction(1, 4) and E.sign_flip([0.1, 0.2, -0.3]) == 1
    assert E.token_f1("a b", "b") == 1 and E.token_f1("x b", "b c") == 0.5 and E.token_f1("", "the") == 1.0 and E.token_f1("x", "") == 0.0
    assert E.bleu1("cat", "the cat sat down") == 1.0 and E.bleu1("cat cat", "The cat's hat.") == 0.5 and E.bleu1("", "x") == 0.0
    assert E.entities("Ann Lee met ann lee in Rome for 3 days, then 20% more. A") == ["Ann Lee", "Rome", "3 days", "20%"]
    assert E.one_standard_error({"x": [0.9, 0.8], "y": [0.84, 0.82], "z": [0.1, 0.2]}, {"x": 2, "y": 1, "z": 0}) == "y"


def test_bootstrap():
    assert [d for _, d in zip(range(3), E.draws(0, 2**64))] == [0xE220A8397B1DCDAF, 0x6E789E6AA1B965F4, 0x06C45D188009454F]  # published values of the generator
    candidate, baseline = {"a": [1.0, 0.0], "b": [1.0], "c": [0.5, 0.5, 0.5]}, {"a": [0.0, 0.0], "b": [0.5], "c": [0.5, 0.0, 0.0]}
    got = E.cluster_bootstrap(candidate, baseline, 300, 7)
    assert got["macro"][0] == pytest.approx((0.5 + 0.5 + 1 / 3) / 3) and got["micro"][0] == pytest.approx(2.5 / 6)
    for estimate, low, high in got.values():
        assert low <= estimate <= high
    assert got == E.cluster_bootstrap(candidate, baseline, 300, 7) != E.cluster_bootstrap(candidate, baseline, 300, 8)
    with pytest.raises(ValueError):
        E.cluster_bootstrap(candidate, {"a": [1.0]}, 10, 1)
