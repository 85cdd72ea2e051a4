"""Personal information inside free text (problem 6).

Method: a skip-chain conditional random field over all tokens of a text (an address or a number in any spelling is one token);
all occurrences of a capitalised token in a document are joined by skip edges. A token that can only be nothing parts the chain without
loss, so the field works on the runs of the other tokens (see ``windows``). Potentials come from hashed features of the token, its
neighbours and its form; the labels of all windows of a document are found by loopy message passing: forward-backward over the chains,
with messages across the skip edges between rounds.

No labelled rows exist, so the field is fitted here by distant supervision on the windows of at most ``SAMPLE`` texts (those of the
smallest hashes; see ``Supervision``): what general knowledge of forms, titles and given names settles is labelled, what it leaves
open stays open, and the field maximises the likelihood of the label sets. Every text is searched whole.

Defined cases: null, empty and blank texts have nothing to find and come out unchanged; overlapping candidates are
settled in favour of the one that starts first, then the longer; equal finds in one text give one row; a single word is a name only
behind a title or where it is part of a longer name in the same text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, SLOTS, BESIDE, ROUNDS = 3_000, 1 << 16, 2, 2
LABELS = ("O", "email", "phone", "identity_number", "street_address", "person_name", "person_name+")
O, EMAIL, PHONE, IDENTITY, ADDRESS, NAME, NAME_ON = range(7)
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "identity_number": "[ID]", "street_address": "[ADDRESS]", "person_name": "[NAME]"}

_UP, _LOW = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
# Words that end a street's name, open one, or are joined to it.
_ENDING = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Close|Way|Row|Gardens|Terrace|Place|Pl|Square|Sq|Crescent|Grove|Hill|Mews|Park|Walk|Parkway|Highway"
_OPENING = "rue|avenue|boulevard|place|chemin|allée|impasse|quai|route|calle|avenida|paseo|plaza|via"
_JOINED = "straße|strasse|weg|platz|allee|gasse|ring|damm|ufer|steig|pfad"
_UNIT = "Flat|Apartment|Apt|Unit|Suite|Ste"
_STREETWORD = rf"(?-i:[{_UP}])[{_UP}{_LOW}'’\-]{{0,30}}+"
_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]{0,80}+(?<=[A-Za-z0-9])(?:\s?@\s?|\s?[\[({<]\s?at\s?[\])}>]\s?|\s+at\s+(?=[A-Za-z0-9\-]+(?:\s+dot\s+|\s?[\[({<]\s?dot)))[A-Za-z0-9\-]+(?:(?:\.|\s?[\[({<]\s?dot\s?[\])}>]\s?|\s+dot\s+)[A-Za-z0-9\-]+)+", re.I)
_DIGITS = re.compile(r"(?<![\w@.#/\-])(?:(?!(?:ID|NO|NR|IS|AT|BY|TO|OF|IN|ON|OR|AS)\b)[A-Z]{1,2}[ \-]?(?=\d)[\d \-]*\d(?: ?[A-Z])?|[a-z]{1,2}\d{5,}[a-z]?|(?:\+|\()?\d[\d()./ \-]*\d)(?![\w@])")
_ADDRESS = re.compile(
    rf"(?:\b(?:{_UNIT})\.? \w{{1,5}},? )?(?<![\w.\-])\d{{1,5}}[A-Za-z]?,? (?:[NSEW]\.? )?(?:{_STREETWORD} ){{1,4}}?(?:{_ENDING})\b(?:\.(?=[\s,;)]|$))?(?:,? (?:{_UNIT}|#)\.? ?\w{{1,5}}\b)?"
    rf"|(?<![\w.\-])\d{{1,5}}(?: ?(?:bis|ter|quater))?,? (?:{_OPENING}) (?:(?:des|du|de la|de|del|de los|la|le|d['’]) ?)?{_STREETWORD}(?:[ \-]{_STREETWORD})?"
    rf"|(?<![\w\-])(?-i:[{_UP}])[{_UP}{_LOW}\-]{{0,40}}(?:{_JOINED})\.? \d{{1,4}} ?[a-z]?\b",
    re.I,
)
_TOKEN = re.compile(rf"[{_UP}]\.(?=[ \-])|[^\W_][\w’'\-]*|[^\w\s]")
# what every address or number holds; each begins with a digit, which the search skips to
_HOUSE = re.compile(rf"\d(?:[A-Za-z]?,? (?:[NSEWnsew]\.? )?[{_UP}]|(?i:(?: ?(?:bis|ter|quater))?,? (?:{_OPENING}) ))")
_LONG = re.compile(r"\d[\d()./ \-]{4,}\d")
_NUMBERED = re.compile(r"\d(?<=[\w.] \d)")
_AT, _AT_WORD, _DOT_WORD = re.compile(r"@|[\[({<]\s?at\s?[\])}>]", re.I), re.compile(r"\sat\s", re.I), re.compile(r"dot", re.I)
_JOINTS = tuple(j.casefold() for j in _JOINED.split("|"))
# an address begins at most so far before the last digit of its house number, a number so far before its first
_BEFORE_HOUSE, _BEFORE_NUMBER = 24, 3
# Titles, and words that announce an identity number.
_TITLE = ("dr", "ms", "mr", "mrs", "miss", "prof", "professor", "sir", "dame", "herr", "frau", "mme", "sr", "sra")
_IDENTITY_WORDS = "identity number|identity card|national id|national identity|national insurance|passport|social security|tax number|tax id|id number|id card|driving licence"
_SEVERAL = re.compile(r"[\s,]")
_TITLED = re.compile(rf"\b(?:{'|'.join(_TITLE)})\.?$", re.I)
_ANNOUNCED = re.compile(rf"(?:{_IDENTITY_WORDS})\W+(?:\w+\W+){{0,2}}$")


@dataclass
class Window:
    """A chain of tokens: spans in the text, and a preset kind for those that are candidates as a whole."""

    text: str
    spans: list[tuple[int, int]]
    kinds: list[int]


def _matches(pattern: re.Pattern, text: str, hints: re.Pattern, before: int) -> list[tuple[int, int]]:
    """The matches of a pattern in the whole text; each begins inside a hint or at most ``before`` characters ahead of it."""
    out, at = [], 0
    for hint in hints.finditer(text):
        at = max(at, hint.start() - before)
        while at < hint.end():
            m = pattern.match(text, at)
            if m:
                out.append(m.span())
            at = m.end() if m else at + 1
    return out


def _wholes(text: str) -> list[tuple[int, int, int]]:
    """E-mail addresses, street addresses and numbers of a text, with their kinds."""
    out = []
    if _AT.search(text) or (_DOT_WORD.search(text) and _AT_WORD.search(text)):
        out += [(*m.span(), EMAIL) for m in _EMAIL.finditer(text)]
    if any(text[max(0, m.start() - 10) : m.start() - 1].removesuffix(".").casefold().endswith(_JOINTS) for m in _NUMBERED.finditer(text)):
        out += [(*m.span(), ADDRESS) for m in _ADDRESS.finditer(text)]
    else:
        out += [(a, b, ADDRESS) for a, b in _matches(_ADDRESS, text, _HOUSE, _BEFORE_HOUSE)]
    return out + [(a, b, PHONE) for a, b in _matches(_DIGITS, text, _LONG, _BEFORE_NUMBER) if sum(map(str.isdigit, text[a:b])) >= 6]


def tokens_of(text: str) -> tuple[list[tuple[int, int]], list[int]]:
    """All tokens of a text, and their preset kinds."""
    spans, kinds, at = [], [], 0
    for s, e, kind in [*sorted(_wholes(text), key=lambda f: (f[0], -f[1])), (len(text), len(text), O)]:
        if s < at:
            continue
        spans += [m.span() for m in _TOKEN.finditer(text, at, s)]
        kinds += [O] * (len(spans) - len(kinds))
        if e > s:
            spans.append((s, e))
            kinds.append(kind)
        at = e
    return spans, kinds


def windows(text: str) -> list[Window]:
    """The windows of a text, in order and without overlap.

    Every token is looked at. A run of tokens that may be something stands between tokens that can only be nothing, and these part
    the chain: with the tokens beside it, which its features read, a run has the same labels as in the chain over the whole text.
    A run whose only capitalised word has no title before it and stands in no other run but such is left out: that word is no name
    by definition, and its skip edges lead nowhere else.
    """
    spans, kinds = tokens_of(text)
    large = [i for i, (a, b) in enumerate(spans) if kinds[i] or (text[a].isupper() and named(text[a:b]))]
    runs: list[tuple[int, int, bool]] = []  # first large token, last one, and whether it is kept
    for i in large:
        if runs and all(text[a:b] == "," for a, b in spans[runs[-1][1] + 1 : i]):
            runs[-1] = (runs[-1][0], i, True)
        else:
            runs.append((i, i, bool(kinds[i]) or titled(text, spans[i][0])))
    words = {text[a:b].lower() for first, last, kept in runs if kept for (a, b), k in zip(spans[first : last + 1], kinds[first : last + 1]) if k == O}
    areas: list[list[int]] = []
    for first, last, kept in runs:
        if not kept and text[slice(*spans[first])].lower() not in words:
            continue
        while first and text[slice(*spans[first - 1])] == ",":
            first -= 1
        while last + 1 < len(spans) and text[slice(*spans[last + 1])] == ",":
            last += 1
        a, b = max(0, first - BESIDE), min(len(spans), last + 1 + BESIDE)
        if areas and a <= areas[-1][1]:
            areas[-1][1] = b
        else:
            areas.append([a, b])
    return [Window(text, spans[a:b], kinds[a:b]) for a, b in areas]


def named(token: str) -> bool:
    """Whether a token may be part of a name: a capitalised word, an initial, or a comma."""
    return token == "," or (token[0].isupper() and not any(map(str.isdigit, token)))


def titled(text: str, at: int) -> bool:
    """Whether a title stands before a place of a text."""
    end = at
    while end and text[end - 1].isspace():
        end -= 1
    return end < at and bool(_TITLED.search(text, max(0, end - 12), end))


_ALLOWED = np.zeros((len(LABELS), len(LABELS)), bool)
_ALLOWED[:, O] = True
for _kind in (EMAIL, ADDRESS, NAME):
    _ALLOWED[_kind, _kind] = True
_ALLOWED[PHONE, [PHONE, IDENTITY]] = True
_ALLOWED[NAME, NAME_ON] = True
NEVER = -1e4
_CONTEXT = 7


def _number(s: str) -> int:
    h = 2166136261
    for b in s.encode("utf-8", "replace"):
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return h


def _slot(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) & np.uint64(SLOTS - 1)).astype(np.int64)


@dataclass
class Tokens:
    """All tokens of some windows in one array: place in the forms met, slots of the context, labels a token may have, window of each, starts."""

    form: np.ndarray
    context: np.ndarray
    allowed: np.ndarray
    window: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray


class Features:
    """Features of tokens as slots: those of the form once per distinct token, those of the context by arithmetic on arrays."""

    def __init__(self, given: frozenset[str]) -> None:
        self.given = given
        self.clear()

    def clear(self) -> None:
        self.place: dict[tuple[str, int], int] = {}
        self.slots: list[list[int]] = []
        self.heads: list[int] = []
        self.shapes: list[int] = []
        self.kinds: list[int] = []
        self.summed: tuple[int, np.ndarray] | None = None

    def form(self, token: str, kind: int) -> list[str]:
        if kind == EMAIL:
            last = re.split(r"\W+|\bdot\b", token)[-1]
            return ["k:email", "tld:" + ("alpha" if last.isalpha() else "digit"), "path:" + str("/" in token)]
        if kind == ADDRESS:
            return ["k:address", "num:" + str(token[0].isdigit())]
        if kind == PHONE:
            pattern = pattern_of(token)
            digits = re.sub(r"\D", "", token)
            return ["k:number", "p:" + pattern, "lead:" + pattern[0] + digits[:1], "p:" + pattern + digits[:1], f"n:{len(digits)}", "sep:" + "".join(sorted(set(re.sub(r"\w", "", token))))]
        low = token.lower()
        if not token[0].isalpha():
            return ["w:" + (low if not low[0].isdigit() else "0")]
        shape = "A." if token[-1] == "." else "AA" if token.isupper() and len(token) > 1 else "Aa" if token[0].isupper() else "a"
        out = ["w:" + low, "s:" + shape]
        if shape[0] == "A":
            out += ["s3:" + low[-3:], "s4:" + low[-4:], "p4:" + low[:4], "given:" + str(low in self.given)]
        return out

    def met(self, token: str, kind: int) -> int:
        got = self.place.get((token, kind))
        if got is None:
            forms = self.form(token, kind)
            got = self.place[token, kind] = len(self.slots)
            self.slots.append(_slot(np.array([_number(f) for f in forms], np.uint64)).tolist())
            self.heads.append(_number(forms[0]))
            self.shapes.append(_number(forms[1]) if len(forms) > 1 else 1)
            self.kinds.append(NAME if kind == O and named(token) else kind)
        return got

    def of(self, ws: list[Window]) -> Tokens:
        if len(self.slots) > 300_000:
            self.clear()
        form = np.array([self.met(w.text[a:b], k) for w in ws for (a, b), k in zip(w.spans, w.kinds)], np.int64)
        lengths = np.array([len(w.spans) for w in ws], np.int64)
        starts = np.cumsum(lengths) - lengths
        window = np.repeat(np.arange(len(ws)), lengths)
        # two places before and behind every window stand for its ends
        at = np.arange(len(form)) + 4 * window + 2
        head, shape = np.full(len(form) + 4 * len(ws), 7, np.uint64), np.full(len(form) + 4 * len(ws), 3, np.uint64)
        head[at], shape[at] = np.array(self.heads, np.uint64)[form], np.array(self.shapes, np.uint64)[form]

        def join(salt: int, *parts: np.ndarray) -> np.ndarray:
            h = np.full(len(at), salt, np.uint64)
            for p in parts:
                h = (h * np.uint64(0x100000001B3)) ^ p
            return _slot(h)

        context = np.stack(
            [
                join(11, head[at - 1]), join(12, head[at + 1]), join(13, head[at - 2], head[at - 1]), join(14, head[at + 1], head[at + 2]),
                join(15, shape[at - 1], shape[at], shape[at + 1]), join(16, head[at - 1], shape[at]), join(17, head[at + 1], shape[at]),
            ],
            1,
        )
        return Tokens(form, context, _ALLOWED[np.array(self.kinds, np.int64)[form]], window, starts, lengths)

    def potentials(self, weights: np.ndarray, t: Tokens) -> np.ndarray:
        """(tokens, labels); the sums over a form's own slots are kept for as long as the weights stay the same."""
        if self.summed is None or self.summed[0] != id(weights):
            self.summed = (id(weights), np.empty((0, weights.shape[1])))
        new = self.slots[len(self.summed[1]) :]
        if new:
            sizes = np.array([len(s) for s in new])
            sums = np.add.reduceat(weights[np.fromiter((x for s in new for x in s), np.int64, int(sizes.sum()))], np.cumsum(sizes) - sizes, axis=0)
            self.summed = (id(weights), np.concatenate([self.summed[1], sums]))
        return self.summed[1][t.form] + weights[t.context].sum(1)

    def flat(self, t: Tokens, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All slots of some tokens, and which of ``rows`` each belongs to."""
        own = [self.slots[f] for f in t.form[rows].tolist()]
        sizes = np.array([len(o) for o in own])
        ids = np.concatenate([np.fromiter((x for o in own for x in o), np.int64, int(sizes.sum())), t.context[rows].ravel()])
        return ids, np.concatenate([np.repeat(np.arange(len(rows)), sizes), np.repeat(np.arange(len(rows)), _CONTEXT)])


def pattern_of(token: str) -> str:
    return re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", re.sub(r"\d", "0", token)))


@dataclass
class Field:
    unary: np.ndarray
    pair: np.ndarray
    skip: np.ndarray
    given: frozenset[str]


def _chains(node: np.ndarray, lengths: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label distributions of padded chains; the forward messages, and what follows each place as it is seen from the place before.

    Messages are products scaled to a sum of 1 at each place. The share of a label pair at places i and i + 1 is
    ``forward[i] * exp(pair) * behind[i + 1]``.
    """
    n, t, k = node.shape
    factor, across = np.exp(node - node.max(2, keepdims=True)), np.exp(pair)
    forward, behind, scale = np.empty_like(node), np.empty_like(node), np.empty((n, t))
    message = np.ones((n, k))
    for i in range(t):
        message = (message if i == 0 else message @ across) * factor[:, i]
        scale[:, i] = message.sum(1) + 1e-300
        message = message / scale[:, i, None]
        forward[:, i] = message
    backward = np.ones((n, k))
    belief = np.empty_like(node)
    for i in range(t - 1, -1, -1):
        live = (i + 1 < lengths)[:, None]
        if i + 1 < t:
            backward = np.where(live, behind[:, i + 1] @ across.T, 1.0)
        belief[:, i] = forward[:, i] * backward
        behind[:, i] = factor[:, i] * backward / scale[:, i, None]
    return belief, forward, behind


def _padded(t: Tokens, part: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``flat`` (per token) of some windows, padded with 0; their token numbers; and where they are live."""
    live = np.arange(int(t.lengths[part].max()))[None, :] < t.lengths[part][:, None]
    rows = (t.starts[part][:, None] + np.arange(live.shape[1]))[live]
    out = np.zeros((*live.shape, flat.shape[1]))
    out[live] = flat[rows]
    return out, rows, live


def _skips(docs: list[int], ws: list[Window]) -> tuple[np.ndarray, np.ndarray]:
    """Skip edges between token numbers: each occurrence of a capitalised word of a document with the first one and the one before."""
    at: dict[tuple[int, str], list[int]] = {}
    left, right, number = [], [], 0
    for doc, w in zip(docs, ws):
        text = w.text
        for (a, b), k in zip(w.spans, w.kinds):
            if k == O and b - a > 2 and text[a].isupper():
                seen = at.setdefault((doc, text[a:b].lower()), [])
                for other in seen:
                    left.append(other)
                    right.append(number)
                seen[:] = [seen[0], number] if seen else [number]
            number += 1
    return np.array(left, np.int64), np.array(right, np.int64)


def marginals(field: Field, t: Tokens, node: np.ndarray, left: np.ndarray, right: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Label distributions of all tokens after message passing over chains and skip edges, and the last messages to the right and left ends."""
    k = node.shape[1]
    node = np.where(t.allowed, node, NEVER)
    out, sent = np.empty_like(node), np.zeros((2, len(left), k))
    todo = np.argsort(t.lengths, kind="stable")
    for turn in range(rounds + 1):
        for c in range(0, len(todo), 256):
            part = todo[c : c + 256]
            padded, rows, live = _padded(t, part, node)
            out[rows] = _chains(padded, t.lengths[part], field.pair)[0][live]
        if turn == rounds or not len(left):
            break
        # a message is what its sender believes without what it was told along the same edge
        fresh = [_message(out[a], sent[1 - side], field.skip) for side, a in enumerate((left, right))]
        for side, b in enumerate((right, left)):
            np.add.at(node, b, fresh[side] - sent[side])
            sent[side] = fresh[side]
        touched = np.unique(t.window[np.concatenate([left, right])])
        todo = touched[np.argsort(t.lengths[touched], kind="stable")]
    return out, sent


def _message(belief: np.ndarray, told: np.ndarray, skip: np.ndarray) -> np.ndarray:
    own = belief * np.exp(-told)
    message = np.log((own / np.maximum(own.sum(1, keepdims=True), 1e-300)) @ np.exp(skip) + 1e-9)
    return message - message.mean(1, keepdims=True)


class Supervision:
    """What general knowledge says of the labels of a sample's windows: for each token the set of labels it may have.

    E-mail addresses and street addresses are labelled by their form, and so are phone numbers (international and trunk
    prefixes, three groups). Numbers announced as identity numbers are labelled, and so are others of a form (pattern, and the first digit where there are only digits)
    that is announced now and then, but for those beside a word that mostly stands beside forms never announced, which stay open; the rest is nothing.
    Names: from the list of given names, and from titles, the surnames beside them are learnt, and from those further given
    names; words that also stand in lower case in the sample are no names. Spans of the form 'I. Surname', and of the forms
    'Given I. Surname' and 'Surname, Given' with a known part, are labelled; known words standing alone stay open; all other words are nothing.
    """

    def __init__(self, texts: list[str], ws: list[Window], given: frozenset[str]) -> None:
        lower = Counter(word for t in texts for word in set(re.findall(rf"(?<!\S)[{_LOW}]{{2,}}(?=[\s,;:!?)]|\.\s|\.?$)", t)))
        self.common = {word for word, n in lower.items() if n > 1} | set(_TITLE)
        self.given, self.surnames = set(given), set()
        self.numbers: dict[tuple[str, str], list[int]] = {}
        words = [self.words(w) for w in ws]
        for _ in range(2):
            for tokens in words:
                for first, rest, titled in self.candidates(tokens):
                    names = [tokens[i][0] for i in (first, *rest) if len(tokens[i][0]) > 2]
                    if len(names) < 2:
                        continue
                    a, b = (names[1], names[0]) if tokens[first + 1][0] == "," else (names[0], names[-1])
                    if a in self.given or titled:
                        self.surnames.update(b.split("-"))
                    if titled or any(p in self.surnames for p in b.split("-")):
                        self.given.update([a])
        for w in ws:
            for (a, b), k in zip(w.spans, w.kinds):
                if k == PHONE:
                    seen = self.numbers.setdefault(self.shape(w.text[a:b]), [0, 0])
                    seen[0] += 1
                    seen[1] += self.announced(w, a)
        # words that mostly stand beside forms that are never announced
        beside: dict[tuple[str, str], list[int]] = {}
        for w in ws:
            for (a, b), k in zip(w.spans, w.kinds):
                if k == PHONE:
                    for x in self.around(w, a, b):
                        beside.setdefault(x, [0, 0])[self.numbers[self.shape(w.text[a:b])][1] > 0] += 1
        self.beside = {x for x, (never, ever) in beside.items() if never > ever}

    @staticmethod
    def around(w: Window, a: int, b: int) -> list[tuple[str, str]]:
        before, behind = re.findall(r"\w+", w.text[max(0, a - 24) : a].lower()), re.findall(r"\w+", w.text[b : b + 24].lower())
        return [("before", before[-1] if before else ""), ("behind", behind[0] if behind else "")]

    @staticmethod
    def shape(token: str) -> tuple[str, str]:
        pattern = pattern_of(token.upper())
        return pattern, "" if "A" in pattern else re.sub(r"\D", "", token)[:1]

    @staticmethod
    def announced(w: Window, a: int) -> bool:
        return bool(_ANNOUNCED.search(w.text[max(0, a - 48) : a].lower()))

    def words(self, w: Window) -> list[tuple[str, bool]]:
        """Lower-cased tokens, and whether each may be a name or an initial."""
        out = []
        for (a, b), k in zip(w.spans, w.kinds):
            word = w.text[a:b]
            low = word.lower()
            out.append((low, k == O and word[0].isupper() and not any(map(str.isdigit, word)) and low not in self.common))
        return out

    def candidates(self, tokens: list[tuple[str, bool]]) -> list[tuple[int, list[int], bool]]:
        """Spans of the form of a name: first token, the others, and whether a title stands before."""
        out, i, n = [], 0, len(tokens)
        while i < n:
            if not tokens[i][1]:
                i += 1
                continue
            titled = i > 0 and tokens[i - 1][0].rstrip(".") in _TITLE or i > 1 and tokens[i - 1][0] == "." and tokens[i - 2][0] in _TITLE
            j, rest, full = i + 1, [], len(tokens[i][0]) > 2
            if full and j + 1 < n and tokens[j][0] == "," and tokens[j + 1][1] and len(tokens[j + 1][0]) > 2:
                rest, j = [j, j + 1], j + 2
                while j < n and tokens[j][1] and tokens[j][0].endswith("."):
                    rest.append(j)
                    j += 1
                out.append((i, rest, titled))
                # the second word may as well open a name of its own
                i = i + 1 if not self.known(tokens, i, rest) else j
                continue
            while j < n and tokens[j][1] and tokens[j][0].endswith("."):
                rest.append(j)
                j += 1
            if j < n and tokens[j][1] and len(tokens[j][0]) > 2:
                out.append((i, [*rest, j], titled))
                i = j + 1 if self.known(tokens, i, [*rest, j]) else i + 1
            else:
                i += 1
        return out

    def known(self, tokens: list[tuple[str, bool]], first: int, rest: list[int]) -> bool:
        names = [tokens[i][0] for i in (first, *rest) if len(tokens[i][0]) > 2]
        if rest and tokens[rest[0]][0] == ",":
            return names[-1] in self.given and (any(p in self.surnames for p in names[0].split("-")) or names[0] not in self.given)
        if len(names) == 1:
            return True  # behind an initial
        return names[0] in self.given or any(p in self.surnames for p in names[-1].split("-"))

    def masks(self, w: Window) -> np.ndarray:
        """(tokens, labels): the labels each token may have."""
        out = np.zeros((len(w.spans), len(LABELS)), bool)
        out[:, O] = True
        tokens = self.words(w)
        for i, ((a, b), k) in enumerate(zip(w.spans, w.kinds)):
            token, wanted = w.text[a:b], None
            if k == EMAIL and not re.search(r"\d$", token) and "/" not in w.text[max(0, a - 1) : b]:
                wanted = EMAIL
            elif k == ADDRESS:
                wanted = ADDRESS
            elif k == PHONE:
                n, announced = self.numbers.get(self.shape(token), (1, 0))
                if self.announced(w, a):
                    wanted = IDENTITY
                elif announced >= 2 and announced > 0.2 * n:
                    wanted = IDENTITY if self.beside.isdisjoint(self.around(w, a, b)) else None
                    out[i, IDENTITY] = True
                elif 9 <= sum(map(str.isdigit, token)) <= 15 and (token[0] in "+(0" or re.fullmatch(r"\d{3}[-.]\d{3}[-.]\d{4}", token)) and not re.fullmatch(r"0+", token):
                    wanted = PHONE
            elif tokens[i][1] and (tokens[i][0] in self.given or tokens[i][0] in self.surnames):
                out[i, [NAME, NAME_ON]] = True
            if wanted:
                out[i] = np.arange(len(LABELS)) == wanted
        for first, rest, titled in self.candidates(tokens):
            if titled or self.known(tokens, first, rest):
                out[[first, *rest]] = False
                out[first, NAME] = True
                out[rest, NAME_ON] = True
        return out


def fit(texts: list[str], given: frozenset[str], steps: int = 180, seed: int = 5) -> Field:
    """Fit the potentials by the likelihood of the label sets (Adam, L2), then the skip potentials by message passing."""
    docs, ws = [], []
    for d, text in enumerate(texts):
        found = windows(text)
        ws += found
        docs += [d] * len(found)
    k = len(LABELS)
    field = Field(np.zeros((SLOTS, k)), np.zeros((k, k)), np.zeros((k, k)), given)
    if not ws:
        return field
    known = Supervision(texts, ws, given)
    field.given = frozenset(known.given)
    tool = Features(field.given)
    t = tool.of(ws)
    gold = np.concatenate([known.masks(w) for w in ws]) & t.allowed
    gold[~gold.any(1), O] = True
    order = np.argsort(t.lengths, kind="stable")
    batches = [order[c : c + 192] for c in range(0, len(order), 192)]
    rng = np.random.default_rng(seed)
    m, v = [np.zeros_like(field.unary), np.zeros_like(field.pair)], [np.zeros_like(field.unary), np.zeros_like(field.pair)]

    def expected(padded: np.ndarray, lengths: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label distributions of the live tokens, and expected numbers of label pairs."""
        belief, forward, behind = _chains(padded, lengths, field.pair)
        shared = np.where(live[:, 1:, None], behind[:, 1:], 0)
        return belief[live], np.einsum("nta,ntb->ab", forward[:, :-1], shared, optimize=True) * np.exp(field.pair)

    for step in range(1, steps + 1):
        part = batches[rng.integers(len(batches))]
        _, rows, _ = _padded(t, part, gold)
        ids, owner = tool.flat(t, rows)
        node = np.zeros((len(t.form), k))
        for c in range(k):
            node[rows, c] = np.bincount(owner, field.unary[ids, c], len(rows))
        free, _, live = _padded(t, part, np.where(t.allowed, node, NEVER))
        bound, _, _ = _padded(t, part, np.where(gold, node, NEVER))
        belief, joint = expected(free, t.lengths[part], live)
        target, wanted = expected(bound, t.lengths[part], live)
        d = (belief - target) / len(rows)
        g = np.stack([np.bincount(ids, d[owner, c], SLOTS) for c in range(k)], 1) + 1e-5 * field.unary
        gp = (joint - wanted) / len(rows) + 1e-5 * field.pair
        for p, grad, a, b in zip((field.unary, field.pair), (g, gp), m, v):
            a *= 0.9
            a += 0.1 * grad
            b *= 0.99
            b += 0.01 * grad * grad
            p -= 0.15 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    left, right = _skips(docs, ws)
    if not len(left):
        return field
    # the skip potentials follow the difference of what the label sets and the field, by its messages, say of both ends of an edge
    some = np.unique(t.window[np.concatenate([left, right])])
    ws, docs = [ws[w] for w in some], [docs[w] for w in some]
    keep = np.isin(t.window, some)
    t, gold = tool.of(ws), gold[keep]
    left, right = _skips(docs, ws)
    # they start as the association of the labels at both ends
    share = gold / gold.sum(1, keepdims=True)
    seen = share[left].T @ share[right] + 0.5
    seen = (seen + seen.T) / (seen + seen.T).sum()
    field.skip = np.clip(np.log(seen / np.outer(seen.sum(1), seen.sum(0))), -2, 2)
    node = tool.potentials(field.unary, t)
    bound = Tokens(t.form, t.context, gold, t.window, t.starts, t.lengths)
    for _ in range(12):
        both = []
        for tokens in (t, bound):
            belief, sent = marginals(field, tokens, node.copy(), left, right, 1)
            a, b = belief[left] * np.exp(-sent[1]), belief[right] * np.exp(-sent[0])
            pair = a[:, :, None] * np.exp(field.skip) * b[:, None, :]
            both.append((pair / np.maximum(pair.sum((1, 2), keepdims=True), 1e-300)).sum(0))
        change = (both[1] - both[0]) / len(left)
        field.skip = np.clip(field.skip + 8.0 * (change + change.T), -3, 3)
    return field


def spans(w: Window, belief: np.ndarray) -> list[tuple[int, int, str]]:
    """The spans of a window by the most probable label of each token."""
    best = belief.argmax(1).tolist()
    out: list[list] = []
    for i, ((a, b), label) in enumerate(zip(w.spans, best)):
        if label == O:
            continue
        if label == NAME_ON and out and out[-1][3] == i - 1 and out[-1][2] == "person_name":
            out[-1][1], out[-1][3] = b, i
        elif label in (NAME, NAME_ON):
            out.append([a, b, "person_name", i])
        else:
            out.append([a, b, LABELS[label], i])
    kept = []
    for a, b, kind, _ in out:
        # a name neither begins nor ends with a comma
        while kind == "person_name" and b > a and (w.text[b - 1] == "," or w.text[b - 1].isspace()):
            b -= 1
        while kind == "person_name" and b > a and (w.text[a] == "," or w.text[a].isspace()):
            a += 1
        if b > a and not (kind == "person_name" and b - a < 3):
            kept.append((a, b, kind))
    return kept


def find(field: Field, tool: Features, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
    """The spans of personal information in each text, in order."""
    docs, ws = [], []
    for d, t in enumerate(texts):
        if t:
            found = windows(t)
            ws += found
            docs += [d] * len(found)
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    if ws:
        t = tool.of(ws)
        belief, _ = marginals(field, t, tool.potentials(field.unary, t), *_skips(docs, ws))
        for d, w, a, n in zip(docs, ws, t.starts.tolist(), t.lengths.tolist()):
            out[d] += spans(w, belief[a : a + n])
    return [_supported(text, found) for text, found in zip(texts, out)]


def _supported(text: str | None, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Without single words as names, but behind a title or where a longer name of the text has them."""
    single = [f for f in found if f[2] == "person_name" and not _SEVERAL.search(text[f[0] : f[1]])]
    if not single:
        return found
    parts = {p for a, b, kind in found if kind == "person_name" and _SEVERAL.search(text[a:b]) for p in re.split(r"[\s,.]+", text[a:b].lower())}
    drop = {f for f in single if text[f[0] : f[1]].lower() not in parts and not titled(text, f[0])}
    return [f for f in found if f not in drop]


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by its placeholder."""
    out, at = [], 0
    for a, b, kind in sorted(found):
        if a >= at:
            out += [text[at:a], PLACEHOLDER[kind]]
            at = b
    return "".join([*out, text[at:]])


def model(texts: DataFrame, given: DataFrame) -> Field:
    """The field, fitted on at most SAMPLE of ``key, text`` and the list of given names (a fixed table)."""
    names = frozenset(r["given_name"].lower() for r in given.filter("given_name is not null").collect())
    share = 1 << 20
    total = texts.count()
    wanted = min(share, -(-(2 * SAMPLE) * share // max(1, total)))
    rows = texts.filter(F.length("text") > 0).filter(F.pmod(F.xxhash64("key"), F.lit(share)) < wanted).orderBy(F.xxhash64("key"), "key").limit(SAMPLE).collect()
    return fit([r["text"] for r in rows], names)


def entities(texts: DataFrame, field: Field) -> DataFrame:
    """``key, pii_type, pii_text`` of every distinct find in ``key, text``."""
    send = texts.sparkSession.sparkContext.broadcast(field)  # a fixed number of slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Features(send.value.given)
        for batch in batches:
            for c in range(0, batch.num_rows, 500):
                part = batch.slice(c, 500)
                rows = part.column(1).to_pylist()
                found = find(send.value, tool, rows)
                keys = part.column(0).to_pylist()
                every = list(dict.fromkeys((k, kind, t[a:b]) for k, t, f in zip(keys, rows, found) for a, b, kind in f))
                yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in every], pa.string()) for i in range(3)], ["key", "pii_type", "pii_text"])

    return texts.select("key", "text").mapInArrow(run, "key string, pii_type string, pii_text string").distinct()


def redacted(texts: DataFrame, field: Field) -> DataFrame:
    """``key, text``: every text with placeholders."""
    send = texts.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Features(send.value.given)
        for batch in batches:
            for c in range(0, batch.num_rows, 500):
                part = batch.slice(c, 500)
                rows = part.column(1).to_pylist()
                out = [t if not f else redact(t, f) for t, f in zip(rows, find(send.value, tool, rows))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], ["key", "text"])

    return texts.select("key", "text").mapInArrow(run, "key string, text string")
