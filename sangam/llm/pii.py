"""Personal information in free text: high-recall candidates, boosted trees, calibrated thresholds.

Generators propose overlapping spans for e-mail addresses, phone numbers, identity
numbers, street addresses and names.  A forest per type scores each span by its format
and context.  The forests, the vocabulary and the character model of names are fitted on
all texts: spans whose context names them (a label such as "passport" or "tracking
number", a title, a signature) serve as labelled examples, each also with its context
hidden, so format alone decides where no label stands beside a span.  Words and examples
are counted where the texts lie; spans are made once, written, and read again for the
examples and for the answers.
"""

from __future__ import annotations

import bisect
import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sangam.llm.boosting import Boosted
from sangam.session import drop, materialise

TYPES = ["email", "phone", "id_number", "address", "name"]

# Words of addresses.
_DESIG = r"(?:flat|house|plot|shop|apartment|apt|door|makaan|ghar|unit|villa|quarter|bungalow|h\. ?no|hno|building)"
_ROAD = r"(?:cross road|main road|road|rd|marg|lane|street|path|gali|avenue|chowk)"
_PLACE = r"(?:nagar|colony|layout|extension|sector|vihar|bazaar|market|chowk|pur|gali|road|marg|lane|street|path|enclave|park)"
PLACE_WORDS = frozenset(f"cross main rd avenue floor block stage pin {_PLACE[3:-1].replace('|', ' ')} {_ROAD[3:-1].replace('|', ' ')}".split())
_SEP = r"(?:\s?,\s?|[ \n])"
_PART = rf"(?:ground floor|(?:\d+(?:st|nd|rd|th)|first|second|third|top) floor|block [a-z0-9]\b|stage [ivx0-9]+\b|phase [ivx0-9]+\b|wing [a-z]\b|lane \d+|\d+(?:st|nd|rd|th) (?:cross|main)|near [^\W\d_]+ [^\W\d_]+|{_DESIG}\.? \d+)"
_W = r"[^\W\d_]{2,}"
ADDRESS = re.compile(
    rf"(?:(?<![\w/])(?P<desig>{_DESIG}\.?(?: ?(?:no|number|num)\b\.?)? ?[#:-]? ?)|(?P<hash>#) ?|(?<![\w/.,:-]))(?P<num>\d{{1,4}}(?:[ /-]?[a-z])?)\b(?P<parts>(?:{_SEP}+{_PART})*)"
    rf"{_SEP}+(?P<road>{_W} {_ROAD})\b(?P<local>(?:{_SEP}+{_W} {_PLACE}\b)?)(?P<city>(?:{_SEP}+{_W})?)(?P<pin>(?:[ ,\n-]+(?:pin(?:code)?[ :-]*)?\d{{6}}\b)?)",
    re.I,
)
_DIGIT_WORD = "(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|double|triple)"
PHONE = re.compile(
    rf"(?<![\w/.+-])(?:\+ ?)?\(?\d(?:[ ().–-]{{0,2}}\d){{6,14}}(?: ?(?:ext|x)\.? ?\d{{1,5}})?(?![\w/]|[-–.]\d)|\b{_DIGIT_WORD}(?:[ -]{_DIGIT_WORD}){{6,14}}\b", re.I
)
ID = re.compile(
    r"(?<![\w/-])(?:[a-z]{5} ?-?\d{4} ?-?[a-z]|[a-z][ -]?\d{7}|[a-z]{3}[ /-]?\d{7}|[a-z]{2}[ -]?\d{2}[ -]?\d{4}[ -]?\d{7}|\d{4}([ -]?)\d{4}\1\d{4}|\d{3}([ -]?)\d{2}\2\d{4})(?![\w/]|-\w)", re.I
)
EMAIL = re.compile(r"(?<![\w.+-])[a-z0-9][\w.+-]*(?: ?@ ?| ?[\[({]at[\])}] ?| at )[a-z0-9-]+(?:(?: ?\. ?(?=[a-z])| ?[\[({]dot[\])}] ?| dot )[a-z0-9-]+)+", re.I)
_TIGHT = re.compile(r"(?<![\w.+-])[a-z0-9][\w.+-]*(?: ?@ ?| ?[\[({]at[\])}] ?| at )[a-z0-9-]+(?:(?:\.| ?[\[({]dot[\])}] ?| dot )[a-z0-9-]+)+", re.I)
# What the patterns above can't do without, looked for first.
_AT = re.compile(r" at [a-z0-9-]+(?:\.| ?[\[({]dot[\])}] ?| dot )[a-z0-9-]")
_BRACED = ("@", "(at", "[at", "{at")
_DIGITS = re.compile(r"\d(?:\D{0,6}\d){3,}")
_NUMBER = re.compile(r"\d{4}|(?:\d\D*){7}")
_BEFORE, _AFTER = 12, 16  # how far a number may begin and end beyond its digits
_HOUSE = re.compile(r"\d{1,4}(?:[ /-]?[a-z])?(?=[\s,]+[^\W_])", re.I)
_BEFORE_HOUSE = re.compile(rf"(?:(?<![\w/]){_DESIG}\.?(?: ?(?:no|number|num)\b\.?)? ?[#:-]? ?|# ?)$", re.I)
_SPOKEN = _DIGIT_WORD[3:-1].split("|")
_ROADS = ("road", "rd", "marg", "lane", "street", "path", "gali", "avenue", "chowk")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")

# What labels a number beside it, for and against.
_LABELS = {
    "phone": r"ph|phone|tel|telephone|mobile|mob|call|sms|whatsapp|contact|fax|cell|ring|dial|number hai|mera number|ka number|missed call|emergency|helpline|driver ka mobile",
    "id_number": r"passport|pan|aadhaa?r|ssn|voter|epic|licen[cs]e|uid|social security|id (?:no|number|card)",
}
_AGAINST = r"tracking|barcode|isbn|invoice|batch|order|awb|sku|serial|build|commit|version|ticket|total|rs|code|row|line|record|score|lot|ref|reference|transaction|txn|parcel|shipment|file|counter|model"
_BESIDE = {k: re.compile(rf"\b(?:{v})\b[^\n\d]{{0,28}}$", re.I) for k, v in {**_LABELS, "against": _AGAINST}.items()}
_NAME_LEFT = re.compile(
    r"(?:\b(?:mr|mrs|ms|dr|shri|smt|sri|prof|kumari|miss)\.? |\b(?:mera naam|my name is|naam|name|i am|main|signed|regards|thanks|dear|reviewed by|translator|translated by|annotator|checked by|owner|ask for|meet|speaker|cc|to|from|attn|contact)\b[ :,\"(⏎\n-]{1,5})$", re.I
)
_NAME_RIGHT = re.compile(
    r"^(?:,? (?:ji|ne|ko|ka|ki|ke|se|par|bhi|is|was|has|will|said|says|wrote|called|approved|joined|signed)\b|,? (?:our|the|your|my) (?:new|old)\b|\)? ?:| ?<|, ?(?:flat|house|plot|shop|apt|door|makaan|#)|;|\" ?,| \| )", re.I
)


def _at(text: str, low: str) -> Iterator[re.Match]:
    if any(w in low for w in _BRACED) or (" at " in low and _AT.search(low)):
        yield from _TIGHT.finditer(text)


def _windows(text: str, low: str) -> list[tuple[int, int]]:
    """The stretches of a text that phone and identity numbers can lie in, in order, none overlapping."""
    if sum(map(low.count, _SPOKEN)) >= 7:
        return [(0, len(text))]
    out: list[tuple[int, int]] = []
    for m in _DIGITS.finditer(text):
        if _NUMBER.search(m.group()):
            s, e = max(0, m.start() - _BEFORE), m.end() + _AFTER
            if out and s <= out[-1][1]:
                out[-1] = (out[-1][0], e)
            else:
                out.append((s, e))
    return out


def _addresses(text: str, low: str) -> Iterator[re.Match]:
    """Matches of ADDRESS, tried only where a house number stands."""
    if not any(w in low for w in _ROADS):
        return
    done = 0
    for h in _HOUSE.finditer(text):
        s = h.start()
        if s < done or text[s - 1 : s].isdigit():
            continue
        left = _BEFORE_HOUSE.search(text, max(done, s - 28), s)
        m = (ADDRESS.match(text, left.start()) if left else None) or ADDRESS.match(text, s)
        if m:
            done = m.end()
            yield m


class Span:
    __slots__ = ("kind", "start", "end", "x", "label", "score", "first")

    def __init__(self, kind, start, end, x, label=None):
        self.kind, self.start, self.end, self.x, self.label, self.score = kind, start, end, x, label, 0.0


class _Good(dict):
    """Whether a word may be part of a name, kept per word; emptied when it holds very many."""

    def __init__(self, df: dict[str, float]):
        super().__init__()
        self.df = df

    def __missing__(self, w: str) -> bool:
        if len(self) > 500_000:
            self.clear()
        v = self[w] = len(w) > 2 and w.isascii() and self.df.get(w.lower(), 0.0) <= 0.006
        return v


class Model:
    """Vocabulary, character model and forests; they grow with the vocabulary, not with the rows."""

    def __init__(self) -> None:
        self.df: dict[str, float] = {}  # share of all texts a word stands in, where at least a few
        self.chars: dict[str, float] = {}  # log odds of a word's letter triples being a name's
        self.cities: set[str] = set()
        self.places: set[str] = set()
        self.forests: dict[str, Boosted] = {}
        self.good: _Good | None = None

    def common(self, w: str) -> bool:
        return self.df.get(w.lower(), 0.0) > 0.006

    def name_score(self, w: str) -> float:
        w = f"^^{w.lower()}$$"
        s = [self.chars.get(w[i : i + 3], -0.3) for i in range(len(w) - 2)]
        return sum(s) / len(s)

    # -- candidates
    def spans(self, text: str) -> list[Span]:
        out: list[Span] = []
        mono = float((text.islower() or text.isupper()) and all(c.islower() or c.isupper() for c in text if c.isalpha()))
        low = text.lower()
        for m in _at(text, low):
            s = m.group()
            tld = re.split(r"\.|dot", s.lower())[-1].strip(" ])}")
            left = text[max(0, m.start() - 24) : m.start()].lower()
            x = [float("@" in s), float(" " in s), len(tld), s.count(".") + s.lower().count("dot"), len(s), float(bool(re.search(r"mail|write|contact|cc|reply|from|share|karo|<|forward", left))), float(bool(re.search(r"[\[({]at", s, re.I))), float(" at " in s), float(" dot " in s.lower())]
            sure = "@" in s or re.search(r"[\[({](?:at|dot)[\])}]| at \S+ dot ", s, re.I)
            out.append(Span("email", m.start(), m.end(), x, 1 if sure else 0))
        places = _windows(text, low)
        for kind, pattern in (("phone", PHONE), ("id_number", ID)):
            for s, e in places:
                for m in pattern.finditer(text, s, e):
                    out.append(self._number(kind, text, m.start(), m.end()))
        for m in _addresses(text, low):
            end = m.end()
            city = m.group("city").strip(" ,\n").lower()
            if city and not m.group("pin") and city not in self.cities:
                end = m.start("city")
            start = m.start("desig") if m.group("desig") else m.start("num")
            left = text[max(0, m.start() - 20) : m.start()].lower()
            x = [float(bool(m.group("desig"))), float(bool(m.group("hash"))), float(bool(m.group("parts"))), float(bool(m.group("local"))), float(bool(m.group("pin"))), float(city in self.cities), len(m.group("num")), float("," in m.group()), float(bool(re.search(r"around|near|meet|version|gate|row|code|room|\d[ /.-]*$", left)))]
            sure = 1 if (m.group("desig") or m.group("hash")) and not x[8] else (0 if x[8] and not m.group("pin") else (1 if m.group("pin") or city in self.cities else None))
            out.append(Span("address", start, end, x, sure))
        out += self._names(text, mono)
        return out

    def _number(self, kind: str, text: str, start: int, end: int) -> Span:
        s = text[start:end]
        left, right = text[max(0, start - 40) : start], text[end : end + 24].lower()
        digits = sum(c.isdigit() for c in s)
        alpha = sum(c.isalpha() for c in s)
        groups = [len(g) for g in re.findall(r"\d+", s)] or [0]
        own, other = _LABELS[kind], "id_number" if kind == "phone" else "phone"
        near = _BESIDE[kind].search(left)
        against = _BESIDE["against"].search(left)
        x = [
            digits, alpha, len(groups), groups[0], groups[-1], max(groups),
            float(s.lstrip()[:1] == "+" or s.startswith("00")), float("(" in s), float("-" in s), float(" " in s), float("." in s), float("/" in s),
            float(bool(near)), float(bool(_BESIDE[other].search(left))), float(bool(against)),
            float(left.rstrip(" ")[-1:] in (";", "|", ",")), float(s[:1].isalpha()), float(s[-1:].isalpha()), float(bool(re.match(r"\s*(?:hai|pe|se|note|par|,? ?mail|\(office)", right))),
            float(bool(re.fullmatch(r"(?:19|20)\d\d[-./ ]\d\d?[-./ ]\d\d?|\d\d?[-./]\d\d?[-./](?:19|20)\d\d", s))),
        ]
        label = 0 if (against and not near) or x[19] else (1 if near else (0 if x[13] else None))
        if kind == "phone" and label is None and x[6]:
            label = 1
        return Span(kind, start, end, x, label)

    def _names(self, text: str, mono: float) -> Iterator[Span]:
        words = _TOKEN.findall(text)
        if self.good is None or self.good.df is not self.df:
            self.good = _Good(self.df)
        good = list(map(self.good.__getitem__, words))
        may = [g or len(w) == 1 for g, w in zip(good, words)]
        if not any(x and y for x, y in zip(may, may[1:])):
            return
        toks = list(_TOKEN.finditer(text))
        for i in range(len(toks)):
            if not (may[i] and may[i + 1 : i + 2] == [True]):
                continue
            j, parts = i, [i]
            while len(parts) < 4 and j + 1 < len(toks):
                gap = text[toks[j].end() : toks[j + 1].start()]
                initial = len(toks[j].group()) == 1
                if not (gap == " " or (initial and gap in (". ", ".")) or (gap == "  ")) or not may[j + 1]:
                    break
                j += 1
                parts.append(j)
                if good[j]:
                    yield self._name(text, toks, good, parts, mono)

    def _name(self, text, toks, good, parts, mono) -> Span:
        first, last = toks[parts[0]], toks[parts[-1]]
        w = [toks[p].group() for p in parts if len(toks[p].group()) > 1]
        left, right = text[max(0, first.start() - 24) : first.start()], text[last.end() : last.end() + 16]
        before = toks[parts[0] - 1].group() if parts[0] else ""
        after = toks[parts[-1] + 1].group() if parts[-1] + 1 < len(toks) else ""
        near_l = bool(before) and first.start() - toks[parts[0] - 1].end() <= 1
        near_r = bool(after) and toks[parts[-1] + 1].start() - last.end() <= 1
        scores = [self.name_score(x) for x in w]
        place = near_r and after.lower() in PLACE_WORDS
        l_anchor, r_anchor = bool(_NAME_LEFT.search(left)), bool(_NAME_RIGHT.match(right))
        title = sum(x[:1].isupper() and x[1:].islower() for x in w) / len(w)
        x = [
            min(scores), scores[0], scores[-1], len(w), len(parts) - len(w), title, mono, float(place), float(l_anchor), float(r_anchor),
            math.log10(self.df.get(w[0].lower(), 0.0) + 1e-4), math.log10(self.df.get(w[-1].lower(), 0.0) + 1e-4),
            float(near_l and parts[0] > 0 and good[parts[0] - 1]), self.name_score(before) if near_l and len(before) > 2 else -1.0,
            float(near_r and good[parts[-1] + 1] if after else 0), self.name_score(after) if near_r and len(after) > 2 else -1.0,
            float(any(v.lower() in self.places for v in w)), float(any(v.lower() in self.cities for v in w)),
            min(len(v) for v in w), float(left[-1:] in "@./_-+" if left else 0), float(right[:1] in "@_+-" or right[:2].strip(".") != right[:2] and right[1:2].isalpha() if right else 0),
        ]
        single = [p for p in parts if len(toks[p].group()) == 1]
        dotted = all(text[toks[p].end() : toks[p].end() + 1] == "." for p in single)
        x.append(float(bool(single) and not dotted))
        whole = len(w) == 2 or (len(w) == 1 and parts[0] == single[0])
        label = None
        if place or x[19] or (single and not dotted and not mono and toks[single[0]].group().islower()):
            label = 0
        elif l_anchor and (r_anchor or not (near_r and x[14])) and whole and dotted and title == 1 and not mono:
            label = 1
        return Span("name", first.start(), last.end(), x, label)

    # -- selection
    def mentions(self, texts: list[str | None]) -> list[list[Span]]:
        """Accepted spans of each text, in order, none overlapping."""
        return self.selected([self.spans(t) if t and t.strip() else [] for t in texts])

    def selected(self, found: list[list[Span]]) -> list[list[Span]]:
        """The same of the spans of each text."""
        for kind, forest in self.forests.items():
            group = [s for one in found for s in one if s.kind == kind]
            if group:
                p = forest.predict(np.array([s.x for s in group], np.float64))
                for s, v in zip(group, p):  # odds over those at the threshold, so that types with other thresholds compare
                    s.score = v / max(1 - v, 1e-12) * (1 - forest.threshold) / forest.threshold if v >= forest.threshold else 0.0
        out = []
        for one in found:
            kept: list[Span] = []  # in order, none overlapping
            starts: list[int] = []
            rank = {"email": 3, "address": 2, "id_number": 1, "phone": 1, "name": 0}
            for s in sorted((s for s in one if s.score > 0), key=lambda s: (-rank[s.kind], -s.score, s.start - s.end, s.start)):
                at = bisect.bisect_left(starts, s.start)
                if (at == len(kept) or s.end <= kept[at].start) and (at == 0 or kept[at - 1].end <= s.start):
                    starts.insert(at, s.start)
                    kept.insert(at, s)
            out.append(kept)
        return out


#: Features that tell of context, per type; examples are repeated with these hidden.
_CONTEXT = {"phone": (12, 18), "id_number": (12, 18), "name": (8, 9), "email": (5,), "address": ()}


_WIDTH = {"email": 9, "phone": 20, "id_number": 20, "address": 9, "name": 22}
_ANCHORED = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Shri|naam|signed,|regards -|speaker \(|Dear|by|meet|for|am) ?((?:[A-Z][a-z]+ )(?:[A-Z]\.? )?[A-Z][a-z]+)\b")
_PLACED = re.compile(rf"\b([^\W\d_]{{4,}}) {_PLACE}\b")
_COUNTS = ("texts", "word", "city", "place", "anchored")
FLUSH = 400_000  # words counted before the counts are handed on


def _count(t: str, into: Counter) -> None:
    """Counts one text's words, cities, places and words of anchored names, as (what, word)."""
    low = t.lower()
    into["texts", ""] += 1
    into.update(("word", w) for w in set(_TOKEN.findall(low)))
    for x in _addresses(low, low):
        if x.group("pin") and x.group("city").strip(" ,\n"):
            into["city", x.group("city").strip(" ,\n")] += 1
    into.update(("place", w) for w in _PLACED.findall(low))
    for x in _ANCHORED.findall(t):
        into.update(("anchored", w.lower()) for w in x.split() if len(w) > 3)


def _vocabulary(counts: Iterator[tuple[str, str, int]]) -> Model:
    """The model without its forests, of the counts of all texts; words of fewer than 3 texts may be left out if they are under a hundredth."""
    got: dict[str, dict[str, int]] = {k: {} for k in _COUNTS}
    for what, w, k in counts:
        got[what][w] = k
    m = Model()
    df, n = got["word"], max(got["texts"].get("", 0), 1)
    m.df = {w: c / n for w, c in df.items() if c >= 3}
    m.cities = {c for c, k in got["city"].items() if k >= 2 and c not in PLACE_WORDS}
    anchored = {w for w in got["anchored"] if not m.common(w)}
    m.places = {w for w in got["place"] if w not in anchored}
    yes, no = Counter(), Counter()
    for w in anchored:
        yes.update(f"^^{w}$$"[i : i + 3] for i in range(len(w) + 2))
    for w in m.places | {w for w, c in df.items() if c > 0.01 * n}:
        if w not in anchored and w.isascii() and len(w) > 2:
            no.update(f"^^{w}$$"[i : i + 3] for i in range(len(w) + 2))
    ty, tn = sum(yes.values()) + 1.0, sum(no.values()) + 1.0
    for g in yes.keys() | no.keys():
        m.chars[g] = max(-3.0, min(3.0, math.log((yes[g] + 0.3) / ty * tn / (no[g] + 0.3))))
    return m


def _examples(sure: list[Span]) -> Iterator[tuple[str, int, tuple[float, ...]]]:
    """(kind, label, features) of the spans of one text whose context tells what they are."""
    names = [s for s in sure if s.kind == "name" and s.label == 1]
    for s in sure:
        label = s.label
        if s.kind == "name" and label is None and any(s.start < k.end and s.end > k.start for k in names):
            label = 0  # another cut of a span known to be a name
        if label is None:
            continue
        yield s.kind, label, tuple(map(float, s.x))
        if label == 1 and _CONTEXT[s.kind]:
            yield s.kind, 1, tuple(0.0 if k in _CONTEXT[s.kind] else float(v) for k, v in enumerate(s.x))


def _forests(m: Model, examples: Iterator[tuple[str, int, tuple[float, ...], int]]) -> None:
    """Fits the forests on distinct examples (kind, label, features, times met), in whatever order."""
    of: dict[str, list] = {k: [] for k in TYPES}
    for kind, y, x, n in examples:
        of[kind].append((tuple(x), y, n))
    for k, rows in of.items():
        rows.sort()
        X, y, n = zip(*rows) if rows else ((), (), ())
        m.forests[k] = Boosted().fit(np.array(X, np.float64).reshape(-1, _WIDTH[k]), np.array(y, np.float64), times=np.array(n, np.int64))


def fit(texts: list[str | None]) -> Model:
    """Fit on texts in memory; :func:`fitted` does the same on a table."""
    texts = [t for t in texts if t and t.strip()]
    counts: Counter = Counter()
    for t in texts:
        _count(t, counts)
    m = _vocabulary((*k, n) for k, n in counts.items())
    _forests(m, ((*k, n) for k, n in Counter(x for t in texts for x in _examples(m.spans(t))).items()))
    return m


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    into: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in into], pa.string()), pa.array([k[1] for k in into], pa.string()), pa.array(into.values(), pa.int64())], names=["what", "w", "n"])

    for b in batches:
        for t in b.column(0).to_pylist():
            if t and t.strip():
                _count(t, into)
                if len(into) > FLUSH:
                    yield out()
                    into.clear()
    if into:
        yield out()


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    into: Counter = Counter()

    def out() -> pa.RecordBatch:
        kind, y, x = zip(*into)
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(y, pa.int32()), pa.array(x, pa.list_(pa.float64())), pa.array(into.values(), pa.int64())], names=["kind", "y", "x", "n"])

    for b in batches:
        for s in b.column(0).to_pylist():
            into.update(_examples(_read(s)))
            if len(into) > FLUSH // 10:
                yield out()
                into.clear()
    if into:
        yield out()


def _read(spans: str) -> list[Span]:
    """Spans of one text as :func:`fitted` writes them, with the place of their first letter or digit."""
    out = []
    for kind, start, end, label, x, first in json.loads(spans):
        s = Span(kind, start, end, x, label)
        s.first = first
        out.append(s)
    return out


def fitted(df: DataFrame, id_col: str, text: str, keep_text: bool = False) -> tuple[Model, DataFrame]:
    """(model fitted on all texts, written table (id, text, spans) of their spans as JSON).

    Without ``keep_text`` the text is left out, and so are texts without spans.
    """
    words = df.select(text).mapInArrow(_counted, "what string, w string, n long").groupBy("what", "w").agg(F.sum("n").alias("n"))
    words = materialise(words, "words")
    n = words.where("what = 'texts'").agg(F.sum("n")).first()[0] or 0
    # a row per word of the vocabulary, without those that count for nothing
    some = words.where((F.col("what") != "word") | (F.col("n") >= 3) | (F.col("n") > 0.01 * n)).toArrow()
    model = _vocabulary(zip(*(c.to_pylist() for c in some.columns)))
    drop(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, spans = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = model.spans(t) if t and t.strip() else []
                if found or keep_text:
                    ids.append(i)
                    texts.append(t if keep_text else None)
                    spans.append(json.dumps([(s.kind, s.start, s.end, s.label, s.x, _first(t, s)) for s in found], separators=(",", ":")))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(spans, pa.string())], names=["id", "text", "spans"])

    found = materialise(df.select(F.col(id_col).cast("long"), text).mapInArrow(run, "id long, text string, spans string"), "spans")
    told = found.select("spans").mapInArrow(_told, "kind string, y int, x array<double>, n long").groupBy("kind", "y", "x").agg(F.sum("n").alias("n")).toArrow()
    _forests(model, zip(*(c.to_pylist() for c in told.select(["kind", "y", "x", "n"]).columns)))
    return model, found


def _first(text: str, s: Span) -> int:
    """Position of a mention's first letter or digit."""
    return next((i for i in range(s.start, s.end) if text[i].isalnum()), s.start)


def find_mentions(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, pii_type, start_char, end_char), one row per mention, positions from 0 in characters.

    Null and blank texts have none.  Texts are scanned whole, whatever their length; only
    counts of words and of examples are shuffled.  Extra columns are not read.
    """
    model, spans = fitted(df, id_col, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                chosen = model.selected([_read(s) for s in part.column(1).to_pylist()])
                rows = [(i, s.kind, s.first, s.end) for i, found in zip(part.column(0).to_pylist(), chosen) for s in found]
                c = list(zip(*rows)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.string()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64())], names=["id", "pii_type", "start_char", "end_char"])

    return spans.select("id", "spans").mapInArrow(run, "id long, pii_type string, start_char long, end_char long")


def redact(df: DataFrame, id_col: str, text: str, placeholders: DataFrame) -> DataFrame:
    """(id, text, mentions): the text with each mention replaced by its type's placeholder.

    ``placeholders``: (pii_type, placeholder), a row per type.  Types without one stay as
    they are; null texts stay null; everything else in a text is unchanged.
    """
    model, spans = fitted(df, id_col, text, True)
    mark = {r.pii_type: r.placeholder for r in placeholders.where(F.col("pii_type").isin(TYPES)).groupBy("pii_type").agg(F.min("placeholder").alias("placeholder")).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                out, count = [], []
                for t, found in zip(part.column(1).to_pylist(), model.selected([_read(s) for s in part.column(2).to_pylist()])):
                    found = [s for s in found if mark.get(s.kind)]
                    for s in reversed(found):
                        t = t[: s.first] + mark[s.kind] + t[s.end :]
                    out.append(t)
                    count.append(len(found))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string()), pa.array(count, pa.int32())], names=["id", "text", "mentions"])

    return spans.mapInArrow(run, "id long, text string, mentions int")
