"""Text functions: analyzer, stemmer, glob, chunkers and detectors. Plain Python, wrapped as Arrow UDFs at the end."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K

MAX_TOKEN_BYTES = 256
_ASCII_WORD = re.compile(r"[a-z0-9]+")
_WORD = regex.compile(r"[\p{Alphabetic}\p{N}]+")
# English stop words, version 1.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()


def _words(text: str | None) -> list[str]:
    normal = unicodedata.normalize("NFKC", text).casefold() if text else ""
    return (_ASCII_WORD if normal.isascii() else _WORD).findall(normal)


def tokens(text: str | None) -> list[tuple[str, int]]:
    """``(term, position)``: NFKC, full case folding, runs of alphanumerics.

    A term of more than 256 bytes is left out and its position stays empty. Null and empty texts have no token.
    """
    return [(w, i) for i, w in enumerate(_words(text)) if len(w) <= MAX_TOKEN_BYTES // 4 or len(w.encode()) <= MAX_TOKEN_BYTES]


# The frozen folding table, version 1: what each letter becomes, and the letters. Other characters stay.
FOLDED = {
    "a": "àáâãäåāăą", "c": "çćĉċč", "d": "ďđð", "e": "èéêëēĕėęě", "g": "ĝğġģ", "h": "ĥħ", "i": "ìíîïĩīĭįı", "j": "ĵ", "k": "ķ", "l": "ĺļľŀł", "n": "ñńņňŉ",
    "o": "òóôõöøōŏő", "r": "ŕŗř", "s": "śŝşš", "t": "ţťŧ", "u": "ùúûüũūŭůűų", "w": "ŵ", "y": "ýÿŷ", "z": "źżž", "ae": "æ", "oe": "œ", "th": "þ",
}
_FOLD = str.maketrans({letter: plain for plain, letters in FOLDED.items() for letter in letters})


def fold_ascii(term: str) -> str:
    """Latin letters of the table without their marks."""
    return term.translate(_FOLD)


def _consonant(w: str, i: int) -> bool:
    if w[i] in "aeiou":
        return False
    return not (w[i] == "y" and i > 0 and _consonant(w, i - 1))


def _measure(w: str) -> int:
    kinds = "".join("c" if _consonant(w, i) else "v" for i in range(len(w)))
    return len(re.findall("v+c+", kinds))


def _vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    return len(w) > 2 and _consonant(w, len(w) - 1) and not _consonant(w, len(w) - 2) and _consonant(w, len(w) - 3) and w[-1] not in "wxy"


# Suffixes of the published algorithm (Porter, 1980), steps 2 to 4.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


@lru_cache(1 << 16)
def stem(w: str) -> str:
    """The stem of a word of ASCII lower-case letters with more than two of them; others stay."""
    if len(w) <= 2 or not (w.isascii() and w.isalpha() and w.islower()):
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = 2 if w.endswith("ed") else 3 if w.endswith("ing") else 0
        if cut and _vowel(w[:-cut]):
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        found = max((s for s in table if w.endswith(s)), key=len, default="")
        if found and _measure(w[: -len(found)]) > 0:
            w = w[: -len(found)] + table[found]
    found = max((s for s in _STEP4 if w.endswith(s)), key=len, default="")
    if found and _measure(w[: -len(found)]) > 1 and (found != "ion" or w[: -len(found)].endswith(("s", "t"))):
        w = w[: -len(found)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


FILTERS = ("lowercase", "fold", "stop", "stem")


def pipeline(names: list[str]) -> dict[str, bool]:
    """The filters of a named pipeline: ``lowercase`` first, then any of fold, stop and stem in this order, each once; others are refused."""
    places = [FILTERS.index(n) if n in FILTERS else -1 for n in names]
    if not names or places[0] != 0 or -1 in places or any(a >= b for a, b in zip(places, places[1:])):
        raise ValueError("a pipeline is lowercase, then fold, stop and stem in this order")
    return {"fold": "fold" in names, "stop": "stop" in names, "stemmed": "stem" in names}


_FLAT_WORD = re.compile(r"[a-z0-9']+")


def analyze(text: str | None, fold: bool = False, stop: bool = False, stemmed: bool = False, flat: bool = False) -> list[tuple[str, int]]:
    """Tokens through the optional filters, in the order fold, stop, stem; positions stay those of the text.

    ``flat`` has another rule for tokens: runs of ASCII letters, digits and apostrophes of the lower-cased text.
    """
    out = [(w, i) for i, w in enumerate(_FLAT_WORD.findall((text or "").lower()))] if flat else tokens(text)
    if fold:
        out = [(fold_ascii(t), p) for t, p in out]
    if stop:
        out = [(t, p) for t, p in out if t not in STOP_WORDS]
    if stemmed:
        out = [(stem(t), p) for t, p in out]
    return out


def glob_regex(pattern: bytes) -> re.Pattern[bytes]:
    """A byte glob (``* ? [a-z] [^a] \\x``) as an anchored pattern; at most 1,024 bytes."""
    if len(pattern) > 1024:
        raise ValueError("a glob has at most 1024 bytes")
    out, i = b"", 0
    while i < len(pattern):
        c = pattern[i : i + 1]
        i += 1
        if c == b"*":
            out += b".*"
        elif c == b"?":
            out += b"."
        elif c == b"\\" and i < len(pattern):
            out += re.escape(pattern[i : i + 1])
            i += 1
        elif c == b"[":
            end = pattern.find(b"]", i + 1)
            if end < 0:
                raise ValueError("unclosed class in a glob")
            inner = pattern[i:end]
            negated = inner[:1] == b"^"
            body = inner[negated:].replace(b"\\", b"\\\\").replace(b"[", b"\\[")
            out += b"[" + (b"^" if negated else b"") + body + b"]"
            i = end + 1
        else:
            out += re.escape(c)
    return re.compile(out + rb"\Z", re.S)


def like_escape(pattern: str) -> str:
    """A character that is not in the LIKE pattern, so that nothing in it is escaped."""
    return next(c for c in "|~^!\x01\x02\x03" if c not in pattern)


def truncate_utf8(text: str, most: int) -> str:
    """The longest prefix of at most ``most`` bytes that cuts no character."""
    return text.encode()[: max(0, most)].decode("utf-8", "ignore")


def chunk_fixed(text: str, size: int, overlap: int = 0) -> list[tuple[int, int]]:
    """Byte ranges of at most ``size`` bytes, each starting ``overlap`` before the last one's end, on character bounds."""
    if size < 4 or not 0 <= overlap < size:
        raise ValueError("a size of 4 or more, and an overlap below it")
    data, out, start = text.encode(), [], 0
    bound = lambda i: i >= len(data) or (data[i] & 0xC0) != 0x80
    while start < len(data):
        stop = min(len(data), start + size)
        while not bound(stop):
            stop -= 1
        if out and stop <= out[-1][1]:
            start = out[-1][1]  # the next character does not fit behind the overlap
            continue
        out.append((start, stop))
        if stop == len(data):
            break
        following = stop - overlap
        while not bound(following):
            following -= 1
        start = following if following > start else stop
    return out


_SENTENCE_END = regex.compile(r"[.!?。！？]\p{White_Space}+")


def chunk_sentences(text: str, target: int, maximum: int) -> list[tuple[int, int]]:
    """Byte ranges of whole sentences: a chunk is closed by the sentence that reaches ``target`` bytes; what would pass ``maximum`` is cut hard there.

    A sentence ends behind the white space after a terminator. The hard cut also falls inside a sentence that follows a
    short one, whenever both together pass the maximum.
    """
    if not 0 < target <= maximum:
        raise ValueError("0 < target <= maximum")
    data, ends, chars, size = text.encode(), [], 0, 0
    for m in _SENTENCE_END.finditer(text):
        size += len(text[chars : m.end()].encode())
        chars = m.end()
        ends.append(size)
    if data and (not ends or ends[-1] < len(data)):
        ends.append(len(data))
    out, start = [], 0
    for end in ends:
        while end - start > maximum:
            cut = start + maximum
            while (data[cut] & 0xC0) == 0x80:
                cut -= 1
            out.append((start, cut))
            start = cut
        if end - start >= target:
            out.append((start, end))
            start = end
    return out + [(start, len(data))] * (start < len(data))


def highlights(text: str, terms: list[str], size: int = 160, most: int = 4) -> list[str]:
    """Up to ``most`` fragments of at most ``size`` bytes of the normalised text, from a quarter of it before the match on, not overlapping."""
    normal = unicodedata.normalize("NFKC", text or "").casefold()
    data, wanted = normal.encode(), set(terms)
    out, last, chars, at = [], 0, 0, 0
    for m in _WORD.finditer(normal):
        if len(out) == most:
            break
        if m.group() not in wanted:
            continue
        at += len(normal[chars : m.start()].encode())
        chars = m.start()
        if at < last:
            continue
        start = max(last, at - size // 4)
        while start > 0 and (data[start] & 0xC0) == 0x80:
            start -= 1
        fragment = data[start : start + size].decode("utf-8", "ignore")
        if fragment:
            out.append(fragment)
            last = start + len(fragment.encode())
    return out


# Spellings that mark a secret.
SECRET_MARKS = ("authorization:", "bearer ", "private key", "password=", "secret=", "token=", "api_key=", "api-key=", "hyp1_", "github_pat_", "ghp_", "xoxb-", "sk-", ".env")
_EDGES = re.compile(r"^[^A-Za-z0-9_\-]+|[^A-Za-z0-9_\-]+$")
_CLASSES = [re.compile(c) for c in ("[a-z]", "[A-Z]", "[0-9]", "[_-]")]


def has_secret(text: str | None) -> bool:
    """A secret's mark, or a word of 32 to 512 bytes with at least three of lower case, upper case, digits and ``_ -``."""
    if not text:
        return False
    low = text.lower()
    if any(m in low for m in SECRET_MARKS):
        return True
    for word in re.split(r"[\s\"']", text):
        if len(word) >= 32:
            bare = _EDGES.sub("", word)
            if 32 <= len(bare.encode()) <= 512 and sum(c.search(bare) is not None for c in _CLASSES) >= 3:
                return True
    return False


def luhn(digits: str) -> bool:
    """A valid check digit; all zeros are none."""
    d = [int(c) for c in reversed(digits)]
    total = sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])
    return total > 0 and total % 10 == 0


# Labels of personal data, and folders that name a person.
PII_LABELS = (
    "email:", "e-mail:", "correo:", "phone:", "telephone:", "teléfono:", "telefono:", "mobile:", "address:", "dirección:", "direccion:", "date of birth", "birth date",
    "fecha de nacimiento", "social security", "ssn:", "dni:", "passport:", "pasaporte:", "credit card", "tarjeta de crédito", "tarjeta de credito", "bank account",
    "cuenta bancaria", "latitude:", "longitude:", "latitud:", "longitud:",
)
HOMES = ("/home/", "c:\\users\\")
_EMAIL_SHAPE = re.compile(r"[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]@(?=([A-Za-z0-9.-]+))")
_PHONE_RUN, _CARD_RUN, _IP_RUN = re.compile(r"[0-9+()\-. ]+"), re.compile(r"[0-9 -]+"), re.compile(r"[0-9.]+")
_SSN_SHAPE = re.compile(r"\d{3}-\d{2}-\d{4}", re.A)
_MAC_SHAPE = re.compile(r"[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}|[0-9A-Fa-f]{2}(?:-[0-9A-Fa-f]{2}){5}")
_UUID_SHAPE = re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}")


def _email(text: str) -> bool:
    parts = [m.group(1).rpartition(".") for m in _EMAIL_SHAPE.finditer(text)]
    return any(host and len(suffix) >= 2 for host, _, suffix in parts)


def _phone(text: str) -> bool:
    return any(10 <= sum(map(str.isdigit, run)) <= 15 and re.search(r"[+( -]", run) for run in _PHONE_RUN.findall(text))


def _card(text: str) -> bool:
    runs = (re.sub(r"\D", "", run) for run in _CARD_RUN.findall(text))
    return any(13 <= len(run) <= 19 and luhn(run) for run in runs)


def _ip(text: str) -> bool:
    for run in _IP_RUN.findall(text):
        parts = run.strip(".").split(".")
        if len(parts) == 4 and all(0 < len(p) <= 3 and int(p) <= 255 and (len(p) == 1 or p[0] != "0") for p in parts):
            return True
    return False


def _bare(words: list[str], kept: str) -> list[str]:
    edges = re.compile(rf"^[^{kept}]+|[^{kept}]+$")
    return [edges.sub("", w) for w in words]


def pii_kinds(text: str | None) -> list[str]:
    """The kinds of personal data that a label or the shape of the text shows, in alphabetical order."""
    if not text:
        return []
    low, words = text.lower(), text.split()
    found = {
        "label": any(label in low for label in PII_LABELS), "home": any(h in low for h in HOMES), "email": _email(text), "phone": _phone(text), "card": _card(text), "ipv4": _ip(text),
        "ssn": any(_SSN_SHAPE.fullmatch(w) for w in _bare(words, "A-Za-z0-9-")), "mac": any(_MAC_SHAPE.fullmatch(w) for w in _bare(words, "0-9A-Fa-f:-")),
        "uuid": any(_UUID_SHAPE.fullmatch(w) for w in _bare(words, "0-9A-Fa-f-")),
    }
    return sorted(k for k, there in found.items() if there)


CAPTURE_BYTES = (8, 512)
# How a line worth keeping begins or what it holds, in English and Spanish: marks, kind, name, and whether the mark is cut off.
CAPTURE_HEADS = (
    (("decision:", "decisión:"), "decision", "Decision", True), (("decidimos ",), "decision", "Decision", False), (("constraint:", "restricción:"), "constraint", "Constraint", True),
    (("fact:", "hecho:"), "fact", "Fact", True), (("journal:", "diario:"), "note", "Journal", True),
)
CAPTURE_INSIDE = (" must ", " never ", " siempre ", " nunca ")
FIRST_PERSON = ("I ", "I'm ", "I've ", "I’m ", "Yo ", "Estoy ", "Pienso ", "Creo ")


def captures(text: str | None) -> list[tuple[str, str]]:
    """``(kind, text)`` of the lines worth keeping of a text of at most 64 KiB.

    Fences, quotes and indented code are passed over, and so are lines of fewer than 8 or more than 512 bytes, lines with
    secrets or personal data, and journal lines that no one says of themselves.
    """
    if not text or len(text.encode()) > 65_536:
        return []
    out, fence = [], None
    for raw in text.split("\n"):
        raw = raw.removesuffix("\r")
        bare = raw.lstrip()
        mark = re.match(r"`+|~+", bare)
        if fence:
            if mark and mark.group()[0] == fence[0] and len(mark.group()) >= len(fence) and not bare[mark.end() :].strip():
                fence = None
            continue
        if raw.startswith(("    ", "\t")) or bare.startswith(">"):
            continue
        if mark and len(mark.group()) >= 3:
            fence = mark.group()
            continue
        line = raw.strip().lstrip("-* ").strip()
        low = line.lower()
        head = next((h for h in CAPTURE_HEADS if low.startswith(h[0])), None)
        if head:
            _, kind, name, cut = head
            content = line.partition(":")[2].strip() if cut else line
            if kind == "note" and not content.startswith(FIRST_PERSON):
                continue
        elif any(m in low for m in CAPTURE_INSIDE):
            kind, name, content = "constraint", "Constraint", line
        else:
            continue
        least, most = CAPTURE_BYTES
        whole = f"{name}: {content}"
        if least <= len(content.encode()) and len(whole.encode()) <= most and not has_secret(content) and not pii_kinds(content):
            out.append((kind, whole))
    return out


TOKEN_LIST = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("pos", T.IntegerType())]))


def analyzer(fold: bool = False, stop: bool = False, stemmed: bool = False):
    """An Arrow UDF: text -> array<struct<term, pos>>."""

    @F.pandas_udf(TOKEN_LIST)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"term": a, "pos": p} for a, p in analyze(t, fold, stop, stemmed)])

    return run


def postings_of(texts: pa.Array, fold: bool = False, stop: bool = False, stemmed: bool = False, flat: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Postings of an array of texts: row of each, the number of tokens of every text, and term and positions of each posting.

    The texts are looked at as one array of code points; only distinct words become strings.
    """
    raw = texts.fill_null("").to_pylist()
    normal = [t.lower() for t in raw] if flat else [unicodedata.normalize("NFKC", t).casefold() if not t.isascii() else t.casefold() for t in raw]
    whole = "".join(normal)
    cps = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.append(0, np.cumsum([len(t) for t in normal])).astype(np.int64)
    kinds = K.word_table()[0][cps] if not flat else (((cps >= 97) & (cps <= 122)) | ((cps >= 48) & (cps <= 57)) | (cps == 39)).astype(np.uint8)
    starts = K.runs(kinds, offsets)
    lengths = np.diff(np.append(starts, len(cps)))
    word = kinds[starts] == 1 if len(starts) else np.empty(0, bool)
    starts, lengths = starts[word], lengths[word]
    owner = np.searchsorted(offsets, starts, side="right") - 1
    first = np.searchsorted(owner, np.arange(len(normal)))
    position = np.arange(len(owner)) - first[owner] if len(owner) else owner
    ids, at, inverse = np.unique(K.hashes(cps, starts, lengths), return_index=True, return_inverse=True)
    names: dict[str, int] = {}
    number = np.empty(len(ids), np.int64)
    for i, (a, n) in enumerate(zip(starts[at].tolist(), lengths[at].tolist())):
        term = whole[a : a + n]
        if not flat and n > MAX_TOKEN_BYTES // 4 and len(term.encode()) > MAX_TOKEN_BYTES:
            number[i] = -1  # left out, its position stays empty
            continue
        if fold:
            term = fold_ascii(term)
        if stop and term in STOP_WORDS:
            number[i] = -1
            continue
        number[i] = names.setdefault(stem(term) if stemmed else term, len(names))
    term = number[inverse] if len(inverse) else inverse.astype(np.int64)
    kept = term >= 0
    owner, term, position = owner[kept], term[kept], position[kept]
    order = np.argsort((owner << 32) | term, kind="stable")
    owner, term, position = owner[order], term[order], position[order]
    new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (term[1:] != term[:-1]))) if len(owner) else np.empty(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(owner)).astype(np.int32)), pa.array(position.astype(np.int32)))
    words = pa.array(list(names), pa.string()).take(pa.array(term[new]))
    return owner[new], np.bincount(owner, minlength=len(normal)), words, lists


def spread(function, schema: T.DataType):
    """An Arrow UDF of a function of one text."""

    @F.pandas_udf(schema)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(function)

    return run
