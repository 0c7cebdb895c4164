"""Broken prompt and response pairs: empty, refusal, copy, other language, truncated.

Copies are found by compressing the response with its prompt as a zstandard dictionary;
refusals and languages by dictionaries, the latter widened by word statistics; truncation
by a terminal-context model.  Both statistical parts are fitted on all pairs themselves:
words and contexts are counted where the pairs lie, and the features of every pair are
written once, read for each step of the fit, and read again for the labels.  Texts are cut
into words many at a time, by their bytes, and Python meets each distinct word of them once.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sangam.operators.shingles import mix64
from sangam.session import drop, materialise

CUT = 0.8  # probability from which an answer counts as truncated
COPY_COST = 0.30  # of the bytes a response takes alone, what it may take beside its prompt and still be a copy

# Stand-ins for no value, reduced to letters and digits.
NO_VALUE = frozenset(
    "na nan nil none null todo tbd blank empty void missing unknown undefined unavailable notavailable notapplicable "
    "notranslation translationmissing untranslated notext novalue nothing noanswer noresponse nooutput pending "
    "tobedone tobetranslated tba nodata xxx xx khali".split()
)
# What a refusal says of itself, of the task, and of the thing to be worked on.
_CANNOT = re.compile(
    r"\b(?:i (?:can ?not|can ?t|am (?:not able|unable)|won ?t|will not|could not|must (?:decline|refuse)|have to (?:decline|refuse)|decline|refuse|do ?n ?t feel comfortable|do not feel comfortable|m (?:unable|not able))"
    r"|not possible for me|not able to|unable to|must decline|no \w+ing can be (?:offered|provided)|can ?not be (?:offered|provided|processed|translated)"
    r"|mere liye (?:possible|sambhav|mumkin) na\w+|mujhse (?:\w+ ){0,4}na\w+ ho\w*|ma?in? \w+(?: \w+){0,6} na\w+ (?:kar|de|bana|likh) (?:sakt\w+|skt\w+|paung\w+|paaung\w+|payeg\w*)|hum \w+(?: \w+){0,6} na\w+ kar sakte|allowed na\w+|anumati na\w+|na\w+ kar (?:sakta|sakti|paunga|paungi))\b"
)
_TASK = re.compile(
    r"\b(?:translat\w*|render\w*|rewrit\w*|rephras\w*|process\w*|convert\w*|transcrib\w*|paraphras\w*|answer\w*|respond\w*|respons\w*|anuvaa?d\w*|tarjuma\w*|rupantar\w*|badal\w*|madad|help\w*|assist\w*|comply|fulfil\w*|generat\w*)\b"
)
_SELF = re.compile(r"\bas an? (?:\w+ )?(?:ai|assistant|language model|chatbot|bot)\b|\bi(?: a)?m (?:just )?an? (?:\w+ )?(?:ai|assistant|language model|chatbot|bot)\b|\b(?:main|mai|mein) (?:to )?ek (?:\w+ )?(?:ai|assistant|language model|chatbot|bot)\b")
_RATHER = re.compile(r"\bi (?:d|would) (?:rather|prefer) not\b|\bi (?:d|would) prefer to not\b")
_AGAINST = re.compile(r"\b(?:against|violates?|breach(?:es)?|outside|beyond) (?:my|our|the content|content|the safety|safety) (?:\w+ )?(?:guidelines?|polic\w+|rules?|instructions|programming|abilities|capabilities)\b|\bmer[ei] (?:\w+ )?(?:guidelines?|polic\w+|niyam\w*) ke (?:khila\w+|viru\w+)\b")
_THING = re.compile(
    r"\b(?:sentences?|texts?|messages?|requests?|prompts?|contents?|inputs?|lines?|vaa?kyas?|passages?|phrases?|statements?|question|task|instruction|policy|guidelines?|this|that|yeh|iss?)\b"
)
# Frequent function words, no words of any subject.
HINGLISH = frozenset(
    "ka ki ke kay kee k hai hy he h hae hain hein se sey mein me mai main mn ko ne nay aur aor or par pe lekin magar isliye phir woh wo jo joh bhi bi "
    "kya kia kyun kyunki tha thi the nahi nahin nai nahee nhi raha rahi rhe rahe rha gaya gayi gaye gayaa ho hoo hua hui hue hi kar kr karke karne karna karta karti wala waala wali vala vali wale liye lie liyee "
    "ek mera mra meri hamara humara hamari mere hamare humne maine uska uski uske iska iski iske unka inka use apna apni apne baad bad pehle paas pas sab yeh ye is us in un jab tab jahan wahan jaise waise aise "
    "toh to tho koi koyi kisi kissi kuch agar tak bahut bohot saath sath andar ander upar uper baare yahan idhar udhar sirf bas abhi abi kabhi kal aaj "
    "tumne tum tumhara aap aapka hum unhone usne kaun kahan kab kaise kitna chahiye chahie jata jaata jaati jate leke diya dia liya lia kiya dena lena hona sakta sakti sakte wajah".split()
)
ENGLISH = frozenset(
    "the of is a an in on to at for and by with from has was were that this our my it not be been will are have had i you but so then how could would should which "
    "when where there their they we he she his her as about into over your who what if than these those its do does did can".split()
)
_FUNCTION = HINGLISH | ENGLISH
FOREIGN = frozenset(
    # Spanish, Portuguese, Italian
    "el la los las una del que por para con sin pero muy está como más su al lo um uma não com mas muito os dos il gli della che per ma molto sono nella di è "
    # French, German, Dutch
    "le les des du est une pour dans avec pas mais elle nous vous ne au aux qui der die das und ist nicht mit auf dem den ein eine von zu im für het een niet van maar naar voor dat zijn "
    # Swahili, Indonesian, Turkish, Tagalog, Vietnamese, Polish
    "kwa na ya wa ni cha za katika lakini yang dan dengan untuk tidak dari pada ini itu kami dia akan ve için ile bu değil ama bir da ang mga sa ng ay hindi của và là không một các w nie jest się na że ale".split()
) - HINGLISH - ENGLISH

_MAYBE = re.compile(_TASK.pattern + r"|\b(?:ai|assistant|language model|bot|chatbot|against|violates?|breach|breaches|outside|beyond|mer[ei])\b")
# One word of each of these; a text with no such word is no refusal.
_MAYBE_WORD = re.compile(_TASK.pattern + r"|\b(?:ai|assistant|language|bot|chatbot|against|violates?|breach|breaches|outside|beyond|mer[ei])\b")
_NOT_BARE = re.compile(r"[\W_]+")
_NOT_LETTER = re.compile(r"[\W\d_]+")
_LATIN = re.compile(r"[a-zA-Z\u00aa-\u024f\u1e00-\u1eff]")
_WORDS = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
# The same for lower-case ASCII texts, several times as fast.
_ASCII_WORDS = re.compile(r"[a-z0-9]+(?:['-][a-z0-9]+)*")
_ASCII_NOT_BARE = {i: None for i in range(128) if not chr(i).isalnum()}
# Bytes of prepared texts: 1 within words, 2 what may join two of them, 3 what closes a clause, 0 others.
_KINDS = bytes(1 if x > 127 or chr(x).isalnum() else 2 if x in b"'-" else 3 if x in b".!?;" else 0 for x in range(256))
_APART = bytes(x for x in range(256) if _KINDS[x] != 1)
_LONGEST = max(map(len, NO_VALUE))
_ENDS = frozenset(".!?।;:|,)")
_CLOSE = frozenset(".!?।;")
DEFECTS = ["empty", "refusal", "copy", "other_language", "truncated"]


def bare(text: str) -> str:
    """Letters and digits in lower case."""
    if text.isascii():
        return text.lower().translate(_ASCII_NOT_BARE)
    return _NOT_BARE.sub("", text.lower())


def words(text: str) -> list[str]:
    text = text.lower()
    return (_ASCII_WORDS if text.isascii() else _WORDS).findall(text)


def is_empty(answer: str | None) -> bool:
    b = bare(answer or "")
    return not b or b in NO_VALUE


def is_refusal(answer: str) -> bool:
    """Declines the task: cannot, of a task and a thing; cannot, as an assistant; would rather not; against its rules."""
    t = answer.lower()
    if not _MAYBE.search(t):
        return False
    t = " ".join(re.findall(r"[^\W_]+", t))
    cannot = _CANNOT.search(t)
    if cannot and (_SELF.search(t) or (_TASK.search(t) and _THING.search(t))):
        return True
    return bool(_AGAINST.search(t) or (_RATHER.search(t) and _TASK.search(t)))


def copy_cost(prompt: bytes, answer: bytes) -> float:
    """Bytes the answer takes with the prompt as dictionary, over the bytes it takes alone.

    Each match takes a few bytes however long it is, so so many are let off a short answer.
    """
    d = zstandard.ZstdCompressionDict(prompt, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    with_it = len(zstandard.ZstdCompressor(level=1, dict_data=d, **_PLAIN).compress(answer))
    return (with_it - 6 - 4) / max(len(_ALONE.compress(answer)) - 6, 1)


def is_copy(p: str, a: str) -> bool:
    """Whether bare answer ``a`` is bare prompt ``p`` again: equal, repeated, in a few wrapping words, or nearly.

    A prompt of under 8 letters must be the whole answer, perhaps repeated; under 24 its
    edited copies are looked for by the cost of compression like all others.
    """
    if not p or len(a) < 0.75 * len(p):
        return False
    if p == a or not a.replace(p, ""):
        return True
    if len(p) < 8:
        return False
    if p in a and len(a.replace(p, "")) <= max(20, len(p) // 2):
        return True
    return copy_cost(p.encode(), a.encode()) < COPY_COST


_PLAIN = dict(write_content_size=False, write_checksum=False, write_dict_id=False)
_ALONE = zstandard.ZstdCompressor(level=1, write_content_size=False, write_checksum=False)


def latin_share(answer: str) -> float:
    if answer.isascii():
        return 1.0
    letters = _NOT_LETTER.sub("", answer)
    return len(_LATIN.findall(letters)) / len(letters) if letters else 1.0


class _Scores(dict):
    """What a word says for Hinglish and for English, kept per word; emptied when it holds very many."""

    def __init__(self, lang: dict[str, tuple[float, float]]):
        super().__init__()
        self.lang = lang

    def __missing__(self, x: str) -> tuple[float, float]:
        if len(self) > 500_000:
            self.clear()
        h, e = self.lang.get(x, (0.0, 0.0))
        if x in HINGLISH:
            h += 1.5
        if x in ENGLISH:
            e += 1.5
        if x in FOREIGN:
            h, e = h - 1.0, e - 1.0
        self[x] = h, e
        return h, e

    def __reduce__(self):
        return _Scores, (self.lang,)


class Model:
    """Parameters fitted on (prompt, answer) pairs; they grow with the vocabulary and the contexts met often."""

    def __init__(self) -> None:
        self.lang: dict[str, tuple[float, float]] = {}  # word: log odds of Hinglish, of English, against another language
        self.scores = _Scores(self.lang)
        self.copied: dict[str, float] = {}  # prompt word: how often it recurs in the answer
        self.copied_rare = 0.9
        self.ends = np.zeros(0, np.uint64), np.zeros(0, np.float32)  # contexts, in order, and their log odds of closing a clause
        self.base = -2.0  # the same of all places
        self.seen: frozenset[str] = frozenset()  # words met often
        # by language of the answer: weights (the first the intercept), means, scales
        self.logit = {way: (np.concatenate(([-9.0], np.zeros(11))), np.zeros(11), np.ones(11)) for way in ("hinglish", "english")}

    # -- language
    def languages(self, t: "_Texts", answers: np.ndarray, prompts: np.ndarray) -> np.ndarray:
        """'hinglish', 'english', 'other' or '' where too little can be told, of texts by their places, each by the words its prompt has not."""
        n = len(answers)
        (code, row), (asked, of) = t.words(answers), t.words(prompts)
        size = len(t.own) + 1
        on = t.known("alpha", str.isalpha, bool)[code] & ~_among(row * size + code, np.sort(of * size + asked))
        code, row = code[on], row[on]
        count = np.bincount(row, minlength=n)
        scores = t.known("scores", self.scores.__getitem__, np.dtype((float, 2)))
        hi, en = (np.bincount(row, scores[code, k], n) for k in (0, 1))
        known = np.bincount(row, t.known("function", _FUNCTION.__contains__, bool)[code], n)
        most = np.maximum(hi, en)
        foreign = (most < 0) | ((known == 0) & (most < 0.3 * count))
        other = np.array([latin_share(t.texts[i]) < 0.5 for i in answers.tolist()], bool)
        return np.where(other, "other", np.where(count < 3, "", np.where(foreign, "other", np.where(hi >= en, "hinglish", "english"))))

    # -- truncation
    def masked(self, w: str) -> int:
        """Mark of a word, one for all rare words and one for all rare ones with a digit."""
        return _mark(w if w in self.seen else "#" if w.isalpha() or not any(map(str.isdigit, w)) else "0")

    def contexts(self, t: "_Texts", code: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """At each word of some texts, given by their words and lengths: its place, and 55-bit marks of the word, of the last two, and of the last four with rare ones masked."""
        at = np.arange(len(code)) - np.repeat(np.cumsum(lens) - lens, lens)
        word, mask = t.known("mark", _mark, np.uint64)[code], t.known("mask", self.masked, np.uint64)[code]
        two = mix64(word + np.uint64(3) * np.roll(word, 1) + np.uint64(2))
        four = np.full(len(at), 4, np.uint64)
        for k in (3, 2, 1, 0):
            four = np.where(at >= k, mix64(four * np.uint64(5) + np.roll(mask, k)), four)
        return at, *(x >> np.uint64(9) for x in (mix64(word + np.uint64(1)), two, four))

    def closing(self, marks: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Log odds of contexts, ``other`` for those not met often."""
        keys, odds = self.ends
        if not len(keys):
            return other
        i = np.minimum(np.searchsorted(keys, marks), len(keys) - 1)
        return np.where(keys[i] == marks, odds[i], other)

    def features(self, t: "_Texts", prompts: np.ndarray, answers: np.ndarray) -> np.ndarray:
        """A row per pair, of prompts and answers by their places."""
        n = len(prompts)
        lens_p, lens_a = t.lens[prompts], t.lens[answers]
        (code_p, row_p), (code_a, row_a) = t.words(prompts), t.words(answers)
        size = len(t.own) + 1
        have = np.sort(row_a * size + code_a)
        some = t.known("copied", lambda w: self.copied.get(w, self.copied_rare) >= 0.8, bool)[code_p]
        row, hit = row_p[some], _among(row_p[some] * size + code_p[some], have)
        hits, right = np.bincount(row, minlength=n), np.bincount(row, hit, n)
        at = np.arange(len(row)) - (np.cumsum(hits) - hits)[row]
        third = np.maximum(hits * 2 // 3, hits - 6)
        late = np.bincount(row, hit & (at >= third[row]), n)
        last = np.full(n, -1)
        last[row[hit]] = at[hit]  # the last of each row stays
        ends = np.cumsum(lens_a)
        final = np.where(lens_a > 0, code_a[ends - 1] if len(code_a) else -1, -1)
        in_prompt = np.bincount(row_p, code_p == final[row_p], n) > 0
        x = np.zeros((n, 11))
        with np.errstate(invalid="ignore", divide="ignore"):
            x[:, 0] = np.where(hits > third, 1 - late / (hits - third), 0.1)
            x[:, 1] = np.where(third > 0, 1 - (right - late) / third, 0.1)
        x[:, 2] = np.minimum(hits - 1 - last, 6)
        x[:, 3] = np.minimum(lens_a / np.maximum(lens_p, 1), 2.0)
        tails = np.minimum(lens_a, 4)
        places, *marks = self.contexts(t, code_a[np.repeat(ends, lens_a) - np.arange(len(code_a)) <= 4], tails)
        x[:, 4:7] = self.base
        ends = np.cumsum(tails)
        some = np.flatnonzero(lens_a)
        if len(some):
            z = ends[some] - 1
            e1 = self.closing(marks[0][z], np.full(len(z), np.nan))
            x[some, 8] = np.isnan(e1) & ~in_prompt[some]
            x[some, 4] = e1 = np.where(np.isnan(e1), self.base - 1.5, e1)
            x[some, 5] = e2 = np.where(places[z] > 0, self.closing(marks[1][z], e1), e1)
            x[some, 6] = self.closing(marks[2][z], e2)
        x[:, 9] = right == hits
        for i, k in enumerate(answers.tolist()):
            end = t.texts[k].rstrip(" \t\r\n\"'”’»)*_~`]}:☺")
            if end:
                x[i, 7] = end[-1] in ".!?।" and not end.endswith(("..", "…"))
                x[i, 10] = end[-1] in "-–—(,/\"“‘«[{<" or end.endswith(("…", " .."))
        return x

    def truncation(self, x: np.ndarray, way: str) -> np.ndarray:
        """Probabilities of rows of features."""
        w, mean, scale = self.logit[way]
        return 1 / (1 + np.exp(-np.clip((x - mean) / scale @ w[1:] + w[0], -30.0, 30.0)))

    def label(self, prompt: str | None, answer: str | None) -> str | None:
        """The first defect that applies, or None."""
        t, at = _Texts([prompt or "", answer or ""]), np.arange(1)
        [first], [way] = self.before(t, at, at + 1, [_early(answer)])
        if first or not way:
            return first
        return "truncated" if self.truncation(self.features(t, at, at + 1), way)[0] >= CUT else None

    def before(self, t: "_Texts", prompts: np.ndarray, answers: np.ndarray, early: list[str | None]) -> tuple[list[str | None], list[str]]:
        """(the first defects but truncation, else the answers' languages) of prompts and answers by their places."""
        first = list(early)
        for i, (p, a) in enumerate(zip(prompts.tolist(), answers.tolist())):
            if not first[i] and is_copy(t.bare(p), t.bare(a)):
                first[i] = "copy"
        lang = self.languages(t, answers, prompts)
        asked = np.flatnonzero(lang == "english")
        lang[asked[self.languages(t, prompts[asked], answers[asked]) == "english"]] = "other"
        way = ["" if f else v or "hinglish" for f, v in zip(first, lang.tolist())]
        return ["other_language" if v == "other" else f for f, v in zip(first, way)], ["" if v == "other" else v for v in way]


def _early(answer: str | None) -> str | None:
    """The defects that ask for no prompt."""
    if is_empty(answer):
        return "empty"
    return "refusal" if is_refusal(answer) else None


_JOIN = frozenset("lekin isliye phir aur aor or but so then and".split())


_GROUPS = ("hi", "en", "other", "n_in", "n_out")  # answers by language, prompts in English; words of sound pairs, and those on both sides
FLUSH = 400_000  # words counted before the counts are handed on
CHUNK = 8_000  # pairs cut into words together, at most
BYTES = 16_000_000  # and the bytes of their texts, unless one pair alone has more
KEYS = 4_000_000  # contexts counted before the counts are handed on
SLICE = 2_000  # pairs whose features are made together
WAYS = ("hinglish", "english")


class _Marks(dict):
    """64-bit marks of words, emptied when it holds very many."""

    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        v = self[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return v


_mark = _Marks().__getitem__


class _Maybes(dict):
    """Whether a word may stand in a refusal, emptied when it holds very many."""

    def __missing__(self, w: str) -> bool:
        if len(self) > 500_000:
            self.clear()
        v = self[w] = bool(_MAYBE_WORD.search(w))
        return v


_maybe = _Maybes().__getitem__


def _prepared(text: str) -> str:
    """The text in lower case; of one that is not ASCII its words, apart by a blank or, where a clause closes, a full stop."""
    text = text.lower()
    if text.isascii():
        return text
    return "".join(w + (". " if _closes(gap) else " ") for w, gap in zip(_WORDS.findall(text), _WORDS.split(text)[1:]))


class _Texts:
    """Texts cut into words as :func:`words` does, all at once: places of their words in the list of distinct ones."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        ready = [_prepared(x) for x in texts]
        self.ascii = [x.isascii() for x in ready]
        sizes = np.array([len(x) if plain else len(x.encode("utf-8", "surrogatepass")) for x, plain in zip(ready, self.ascii)], np.int64)
        raw = ("\n".join(ready) + "\n").encode("utf-8", "surrogatepass")
        kinds = np.frombuffer(raw.translate(_KINDS), np.uint8)
        part = kinds == 1
        binds = np.flatnonzero(kinds == 2)
        binds = binds[part[binds - 1] & part[binds + 1]]
        part[binds] = True
        edges = np.flatnonzero(np.diff(part, prepend=False))
        starts, ends = edges[::2], edges[1::2]
        after = np.cumsum(sizes + 1)
        self.last = np.searchsorted(starts, after)  # where each text's words end
        self.lens = np.diff(self.last, prepend=0)
        offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(ends - starts)))
        self.letters = raw.translate(None, _APART).decode("latin-1")
        self.bare_to = offsets[self.last] - np.searchsorted(binds, after)  # where each text's letters and digits end
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.frombuffer(raw, np.uint8)[part])]).dictionary_encode()
        self.code = coded.indices.to_numpy().astype(np.int64)
        self.own = [w.decode("utf-8", "surrogatepass") for w in coded.dictionary.to_pylist()]
        self.closes = np.zeros(len(starts) + 1, bool)  # whether what stands after a word closes a clause; the last is no word's
        self.closes[np.searchsorted(starts, np.flatnonzero(kinds == 3)) - 1] = True
        self.closes[self.last[self.lens > 0] - 1] = True
        self._known: dict[str, np.ndarray] = {}

    def words(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, for each the index in ``some``) of some texts by their places."""
        lens = self.lens[some]
        row = np.repeat(np.arange(len(some)), lens)
        return self.code[np.arange(len(row)) + (self.last[some] - np.cumsum(lens))[row]], row

    def known(self, name: str, of: Callable, kind: np.dtype | type) -> np.ndarray:
        """What ``of`` says of each distinct word, asked once under a name."""
        if name not in self._known:
            self._known[name] = np.fromiter(map(of, self.own), kind, len(self.own))
        return self._known[name]

    def bare_size(self, i: int) -> int:
        return int(self.bare_to[i] - (self.bare_to[i - 1] if i else 0))

    def bare(self, i: int) -> str:
        if not self.ascii[i]:
            return bare(self.texts[i])
        return self.letters[self.bare_to[i] - self.bare_size(i) : self.bare_to[i]]


def _among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def _distinct(x: np.ndarray) -> np.ndarray:
    """The distinct numbers in order."""
    x = np.sort(x)
    return x[np.diff(x, prepend=~x[:1]) != 0]


def _squeezed(*arrays: np.ndarray) -> bytes:
    """Flat arrays in one compressed string, by their bytes' place."""
    head = json.dumps([(a.dtype.str, a.size) for a in arrays]).encode()
    body = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + b"\n" + body)


def _loosened(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    at = raw.index(b"\n")
    out, head, at = [], json.loads(raw[:at]), at + 1
    for kind, n in head:
        d = np.dtype(kind)
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * d.itemsize, at).reshape(d.itemsize, -1).T).view(d).ravel())
        at += n * d.itemsize
    return out


def _earlies(t: _Texts, answers: np.ndarray) -> list[str | None]:
    """The defects of :func:`_early` of texts by their places."""
    code, row = t.words(answers)
    maybe = np.bincount(row, t.known("maybe", _maybe, bool)[code], len(answers)) > 0

    def one(i: int, maybe: bool) -> str | None:
        if t.ascii[i]:
            b = t.bare(i) if t.bare_size(i) <= _LONGEST else None
            empty = b == "" or b in NO_VALUE
        else:
            empty = is_empty(t.texts[i])
        return "empty" if empty else "refusal" if maybe and is_refusal(t.texts[i]) else None

    return [one(i, x) for i, x in zip(answers.tolist(), maybe.tolist())]


def _tallies(t: _Texts, prompts: np.ndarray, answers: np.ndarray, early: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(whether each pair is sound, counts of the distinct words, a row for each of _GROUPS)."""
    n, size = len(prompts), len(t.own) + 1
    pairs = list(zip(prompts.tolist(), answers.tolist()))
    on = np.array([bool(not e and t.texts[p] and latin_share(t.texts[a]) >= 0.5) for e, (p, a) in zip(early, pairs)], bool) & (t.lens[answers] > 0)
    (pw, row_p), (w, row_a) = t.words(prompts), t.words(answers)
    is_hi, is_en = t.known("hinglish", HINGLISH.__contains__, bool), t.known("english", ENGLISH.__contains__, bool)
    long = np.maximum(t.lens[answers], 1)
    hi, en = (np.bincount(row_a, d[w], n) / long for d in (is_hi, is_en))
    hinglish = on & (hi >= 0.15) & (hi > en)
    other = on & ~hinglish & (en < 0.15) & (hi < 0.1) & (long >= 6)
    english = on & (np.bincount(row_p, is_en[pw], n) > 0.15 * t.lens[prompts])
    sound = hinglish.copy()
    for i in np.flatnonzero(hinglish).tolist():
        p, a = pairs[i]
        sound[i] = (t.ascii[p] and t.ascii[a] and t.bare_size(p) != t.bare_size(a)) or t.bare(p) != t.bare(a)
    asked, have = (_distinct((row * size + code)[on[row]]) for row, code in ((row_p, pw), (row_a, w)))
    both = _among(have, asked), _among(asked, have)
    (of_a, a), (of_p, p) = np.divmod(have, size), np.divmod(asked, size)
    count = lambda x: np.bincount(x, minlength=size - 1)
    told = count(a[sound[of_a]]) + count(p[sound[of_p]])
    return sound, np.array([count(a[hinglish[of_a] & ~both[0]]), count(p[english[of_p] & ~both[1]]), count(a[other[of_a] & ~both[0]]), told, 2 * count(a[sound[of_a] & both[0]])])


def _tally(p: str | None, a: str | None, early: str | None, into: dict[str, Counter]) -> bool:
    """Counts the words of one pair and tells whether it is sound."""
    t, at = _Texts([p or "", a or ""]), np.arange(1)
    sound, counts = _tallies(t, at, at + 1, [early])
    for g, c in zip(_GROUPS, counts.tolist()):
        into[g].update({w: k for w, k in zip(t.own, c) if k})
    return bool(sound[0])


def _lexicon(rows: Iterable[tuple], totals: tuple[float, ...]) -> Model:
    """The model's words, of (word, counts by _GROUPS) and the sums of hi, en, other and, of words met up to 4 times in sound pairs, n_in, n_out.

    Words with less than 3 in the first three and less than 5 in the fourth may be left out.
    """
    m = Model()
    th, te, to = (t + 1000.0 for t in totals[:3])
    m.copied_rare = totals[4] / max(totals[3], 1)
    seen = []
    for x, hi, en, other, n_in, n_out in rows:
        if hi + en + other >= 3:
            o = math.log((other + 0.5) / to)
            h, e = math.log((hi + 0.5) / th) - o, math.log((en + 0.5) / te) - o
            m.lang[x] = (max(-3.0, min(3.0, h)), max(-3.0, min(3.0, e)))
        if n_in > 4:
            m.copied[x] = (n_out + m.copied_rare) / (n_in + 1)
        if n_in >= 20:
            seen.append(x)
    m.seen = frozenset(seen)
    return m


class _Closes(dict):
    """Whether what stands between two words closes a clause."""

    def __missing__(self, gap: str) -> bool:
        if len(self) > 100_000:
            self.clear()
        v = self[gap] = any(c in _CLOSE for c in gap)
        return v


_closes = _Closes().__getitem__


def _context_keys(m: Model, texts: list[str]) -> np.ndarray:
    """Marks of the contexts at all words of the texts, each with a last bit: whether a clause closes there."""
    t = _Texts(texts)
    at, one, two, four = m.contexts(t, t.code, t.lens)
    joins = t.known("joins", _JOIN.__contains__, bool)[t.code]
    c = t.closes[:-1]
    c[:-1] |= joins[1:] & (at[1:] > 0)
    keys = [one, two[at > 0], four]
    return np.concatenate([k << np.uint64(1) | b.astype(np.uint64) for k, b in zip(keys, (c, c[at > 0], c))])


def _merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order with their counts added."""
    k, n = (np.concatenate(x) for x in zip(*runs))
    order = np.argsort(k)
    k, n = k[order], n[order]
    first = np.flatnonzero(np.diff(k, prepend=~k[:1]))
    return k[first], np.add.reduceat(n, first) if len(first) else n


def _often(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """(contexts met 5 times or more, times, times a clause closes there; both of all contexts)."""
    closes = n * (keys & np.uint64(1)).astype(np.int64)
    k = keys >> np.uint64(1)
    first = np.flatnonzero(np.diff(k, prepend=~k[:1]))
    alls, ends = (np.add.reduceat(x, first) if len(first) else x for x in (n, closes))
    on = alls >= 5
    return k[first][on], alls[on], ends[on], int(n.sum()), int(closes.sum())


def _close(m: Model, parts: list[tuple]) -> None:
    """Sets the contexts of the model, of parts by ranges of marks in order."""
    every, closing = sum(p[3] for p in parts), sum(p[4] for p in parts)
    base = (closing + 1) / (every + 10)
    m.base = math.log(base / (1 - base))
    if parts:
        k, alls, ends = (np.concatenate([p[i] for p in parts]) for i in range(3))
        m.ends = k, np.log((ends + 4 * base) / (alls - ends + 4 * (1 - base))).astype(np.float32)


def _cut(p: str, a: str, seed: int = 5) -> str:
    """An answer broken off, at a place told by a hash of the pair; empty if it would not look so."""
    h = hashlib.blake2b(f"{seed} {p}\n{a}".encode("utf-8", "surrogatepass"), digest_size=8).digest()
    r = int.from_bytes(h, "little")
    cut = a[: int(len(a) * (0.15 + 0.77 * ((r & 0xFFFFF) / 2**20)))].rstrip()
    if len(cut) <= 5 or cut[-1] in _ENDS:
        return ""
    if (r >> 20 & 0xFFFFF) / 2**20 < 0.3:
        cut += ("…", "...", " -", " (", ' "', ",")[(r >> 40) % 6]
    return cut


def _taught(pairs: list[tuple[str, str]], sound: Iterable[bool]) -> _Texts:
    """Prompts, answers, cuts of the answers and of the prompts, in this order; cuts of sound pairs only."""
    ps, as_ = ([r[k] for r in pairs] for k in (0, 1))
    return _Texts([*ps, *as_, *(_cut(p, a) if s else "" for p, a, s in zip(ps, as_, sound)), *(_cut(a, p) if s else "" for p, a, s in zip(ps, as_, sound))])


def _lessons(m: Model, t: _Texts, sound: np.ndarray, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, 1 for made cuts) by way, of sound pairs by their places, with their features, and their texts by :func:`_taught`."""
    n, out = len(t.texts) // 4, []
    for p, a, cut in ((sound, sound + n, sound + 2 * n), (sound + n, sound, sound + 3 * n)):
        rows = x if p is sound else m.features(t, p, a)
        made = np.array([bool(t.texts[i]) for i in cut.tolist()], bool)
        y = np.zeros(len(sound) + int(made.sum()))
        y[len(sound) :] = 1.0
        out.append((np.concatenate((rows, m.features(t, p[made], cut[made]))), y))
    return out


def _fit_logits(m: Model, over: Callable[[Callable], list]) -> None:
    """Ridge logistic regressions by Newton steps; ``over`` gives the results of a function of (features, labels) by way for all parts."""
    got = over(lambda ways: [np.array([len(y), y.sum(), *x.sum(0), *(x * x).sum(0)]) for x, y in ways])
    for v, way in enumerate(WAYS):
        t = np.sum([g[v] for g in got], axis=0) if got else np.zeros(24)
        if t[0] < 20 or t[1] in (0, t[0]):
            continue  # too few pairs to tell: nothing counts as truncated
        mean = t[2:13] / t[0]
        m.logit[way] = np.zeros(12), mean, np.sqrt(np.maximum(t[13:] / t[0] - mean**2, 0)) + 1e-6
    first: dict[str, np.ndarray] = {}
    live = [way for way in WAYS if not m.logit[way][0].any()]
    for again in (False, True):  # the second fit leaves out sound rows that look cut: they are
        now = {way: m.logit[way] for way in live}
        going = set(live)
        for _ in range(30):
            if not going:
                break
            got = over(lambda ways: [_step(x, y, now[way], first.get(way)) if way in going else None for way, (x, y) in zip(WAYS, ways)])
            for v, way in enumerate(WAYS):
                if way in going:
                    g, H = (sum(r[v][i] for r in got) for i in range(2))
                    w, mean, scale = now[way]
                    step = np.linalg.solve(H + 0.1 * np.eye(len(w)), g + 0.1 * w)
                    now[way] = w - step, mean, scale
                    if np.abs(step).max() < 1e-9:
                        going.discard(way)
        m.logit.update(now)
        first = {way: now[way][0] for way in live}


def _step(x: np.ndarray, y: np.ndarray, now: tuple, first: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of one part."""
    w, mean, scale = now
    Z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    if first is not None:
        keep = ~((y == 0) & (1 / (1 + np.exp(-np.clip(Z @ first, -30, 30))) > 0.8))
        Z, y = Z[keep], y[keep]
    q = 1 / (1 + np.exp(-np.clip(Z @ w, -30, 30)))
    return Z.T @ (q - y), (Z * (q * (1 - q))[:, None]).T @ Z


def fit(pairs: list[tuple[str | None, str | None]]) -> Model:
    """Fit on pairs in memory; :func:`defects` does the same on a table.  Truncated examples are made by cutting sound answers."""
    pairs = [(p or "", a or "") for p, a in pairs]
    t, at = _Texts([x for r in pairs for x in r]), np.arange(len(pairs)) * 2
    on, counts = _tallies(t, at, at + 1, _earlies(t, at + 1))
    sound = [r for r, s in zip(pairs, on) if s]
    rows = [(w, *c) for w, c in zip(t.own, counts.T.tolist()) if any(c)]
    m = _lexicon(rows, [*counts[:3].sum(1).tolist(), *(sum(r[i] for r in rows if r[4] <= 4) for i in (4, 5))])
    keys = _context_keys(m, [x for pair in sound for x in pair])
    _close(m, [_often(*np.unique(keys, return_counts=True))])
    t, at = _taught(sound, [True] * len(sound)), np.arange(len(sound))
    parts = [_lessons(m, t, at, m.features(t, at, at + len(sound)))]
    _fit_logits(m, lambda f: [f(part) for part in parts])
    return m


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in pieces of up to CHUNK rows and BYTES bytes of strings, or of one row."""
    for b in batches:
        sizes = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type))
        to, lo = np.cumsum(sizes), 0
        while lo < b.num_rows:
            hi = int(np.searchsorted(to, (to[lo - 1] if lo else 0) + BYTES, "right"))
            hi = min(max(hi, lo + 1), lo + CHUNK, b.num_rows)
            yield b.slice(lo, hi - lo)
            lo = hi


_PAIR = "id long, p string, a string, early string, sound boolean"
_WORD = "w string, " + ", ".join(f"{g} long" for g in _GROUPS)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (id, prompt, answer) with the defects that ask for no prompt, and, as rows of their own, counts of words."""
    names = ["id", "p", "a", "early", "sound", "w", *_GROUPS]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), *[pa.int64()] * 5]
    met: list[pa.Table] = []

    def out(n: int, **columns: list | pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, types)], names=names)

    def merged() -> pa.Table:
        t = pa.concat_tables(met).group_by("w").aggregate([(g, "sum") for g in _GROUPS])
        met.clear()
        return t.select(["w", *(f"{g}_sum" for g in _GROUPS)]).rename_columns(["w", *_GROUPS]).combine_chunks()

    def counts(t: pa.Table) -> Iterator[pa.RecordBatch]:
        for b in t.to_batches():
            yield out(b.num_rows, **dict(zip(t.column_names, b.columns)))

    for b in _chunks(batches):
        i, p, a = (c.to_pylist() for c in b.columns)
        t, at = _Texts([x or "" for x in (*p, *a)]), np.arange(len(i))
        early = _earlies(t, at + len(i))
        sound, n = _tallies(t, at, at + len(i), early)
        yield out(len(i), id=i, p=p, a=a, early=early, sound=sound.tolist())
        some = n.any(0)
        met.append(pa.table([pa.array([w for w, k in zip(t.own, some.tolist()) if k], pa.string()), *n[:, some]], names=["w", *_GROUPS]))
        if sum(map(len, met)) > FLUSH:
            met.append(merged())
            if len(met[0]) > FLUSH // 2:
                yield from counts(merged())
    if met:
        yield from counts(merged())


def defects(df: DataFrame, prompt: str, answer: str, id_col: str) -> DataFrame:
    """(id, defect) for every broken pair, null prompt counting as empty.

    A null answer is 'empty'.  Pairs are labelled one by one, so repeats all appear; only
    counts of words and contexts are shuffled.  Sound pairs with their columns exchanged are
    no case: an English answer is broken only under an English prompt.  Extra columns are not read.
    """
    spark = df.sparkSession
    read = materialise(df.select(F.col(id_col).cast("long"), prompt, answer).mapInArrow(_read, f"{_PAIR}, {_WORD}"), "pairs")
    pairs = read.where("w is null").select("id", "p", "a", "early", "sound")
    lexicon = materialise(read.where("w is not null").groupBy("w").agg(*(F.sum(g).alias(g) for g in _GROUPS)), "words")
    totals = lexicon.agg(*(F.sum(g) for g in _GROUPS[:3]), *(F.sum(F.when(F.col("n_in") <= 4, F.col(g))) for g in _GROUPS[3:])).first()
    known = lexicon.where("hi + en + other >= 3 or n_in > 4").toArrow()  # rows of a vocabulary
    model = _lexicon(zip(*(c.to_pylist() for c in known.columns)), [t or 0 for t in totals])
    drop(lexicon)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), pairs.count() // 20_000)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list = []

        def out() -> pa.RecordBatch:
            k, n = _merged(runs)
            of = ((k >> np.uint64(24)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            cut = np.searchsorted(of, np.arange(ranges + 1))
            own = [r for r in range(ranges) if cut[r] < cut[r + 1]]
            parts = [_squeezed(np.diff(k[cut[r] : cut[r + 1]], prepend=np.uint64(0)), n[cut[r] : cut[r + 1]].astype(np.int32)) for r in own]
            runs.clear()
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(parts, pa.binary())], names=["part", "keys"])

        for b in _chunks(batches):
            p, a = (c.to_pylist() for c in b.columns)
            runs.append(np.unique(_context_keys(model, [*p, *a]), return_counts=True))
            if sum(len(k) for k, _ in runs) > KEYS:
                runs[:] = [_merged(runs)]
                if len(runs[0][0]) > KEYS // 2:
                    yield out()
        if runs:
            yield out()

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[int, list] = {}
        for b in batches:
            for r, keys in zip(*(c.to_pylist() for c in b.columns)):
                k, n = _loosened(keys)
                of.setdefault(r, []).append((np.cumsum(k, dtype=np.uint64), n.astype(np.int64)))
        for r in sorted(of):
            *arrays, every, closing = _often(*_merged(of.pop(r)))
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([_squeezed(*arrays)], pa.binary()), pa.array([every], pa.int64()), pa.array([closing], pa.int64())], names=["part", "keys", "every", "closing"])

    contexts = pairs.where("sound").select("p", "a").mapInArrow(met, "part int, keys binary").repartitionById(ranges, F.col("part")).mapInArrow(often, "part int, keys binary, every long, closing long").collect()
    _close(model, [(*_loosened(r.keys), r.every, r.closing) for r in sorted(contexts)])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs by slices: ids and labels but truncation, features of the unlabelled, lessons of the sound."""
        for b in _chunks(batches):
            i, p, a, early, sound = (c.to_pylist() for c in b.columns)
            t, n = _taught([(x or "", y or "") for x, y in zip(p, a)], sound), len(i)
            label, way = model.before(t, np.arange(n), np.arange(n) + n, early)
            left, taught = np.array(way, object) != "", np.array(sound, bool)
            for at in range(0, n, SLICE):
                own = slice(at, at + SLICE)
                some = at + np.flatnonzero(left[own] | taught[own])
                x = model.features(t, some, some + n)
                lessons = [v for of in _lessons(model, t, some[taught[some]], x[taught[some]]) for v in (of[0].ravel(), of[1])]
                labels = zstandard.ZstdCompressor(level=1).compress(json.dumps([i[own], label[own], way[own]]).encode())
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (labels, _squeezed(x[left[some]].ravel()), _squeezed(*lessons))], names=["labels", "x", "lessons"])

    slices = materialise(pairs.mapInArrow(made, "labels binary, x binary, lessons binary"), "features")
    drop(read)

    def over(f: Callable) -> list:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                for body in b.column(0).to_pylist():
                    v = _loosened(body)
                    got = f([(v[0].reshape(-1, 11), v[1]), (v[2].reshape(-1, 11), v[3])])
                    total = got if total is None else [_added(s, g) for s, g in zip(total, got)]
            if total is not None:
                flat = [np.concatenate([np.ravel(a) for a in t]) if isinstance(t, tuple) else t for t in total]
                yield pa.RecordBatch.from_arrays([pa.array([None if t is None else t.tolist()], pa.list_(pa.float64())) for t in flat], names=list(WAYS))

        rows = slices.select("lessons").mapInArrow(run, ", ".join(f"{way} array<double>" for way in WAYS)).collect()
        back = lambda t: None if t is None else np.array(t) if len(t) == 24 else (np.array(t[:12]), np.array(t[12:]).reshape(12, 12))
        return [[back(t) for t in r] for r in sorted(rows, key=str)]  # in one order, or the last digits of the sums would change

    _fit_logits(model, over)
    logit = Model()
    logit.logit = model.logit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for labels, body in zip(*(c.to_pylist() for c in b.columns)):
                ids, label, way = json.loads(zstandard.ZstdDecompressor().decompress(labels))
                x = _loosened(body)[0].reshape(-1, 11)
                left = [k for k, v in enumerate(way) if v]
                cut = {v: logit.truncation(x, v) for v in WAYS}
                for n, k in enumerate(left):
                    if cut[way[k]][n] >= CUT:
                        label[k] = "truncated"
                at = [k for k, v in enumerate(label) if v]
                yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in at], pa.int64()), pa.array([label[k] for k in at], pa.string())], names=["id", "defect"])

    return slices.select("labels", "x").mapInArrow(run, "id long, defect string")


def _added(a, b):
    if a is None:
        return None
    return tuple(x + y for x, y in zip(a, b)) if isinstance(a, tuple) else a + b
