"""Secret scans (operator 1): patterned secrets, and credential values that are costly to guess.

Values that follow a credential word, those in base spans included, are segmented by dynamic
programming into words, dates, repeats, keyboard walks and brute-force spans so that the
product of the segments' guesses is smallest.  The programme goes over whole values, whatever
their length; segments are bounded by their kind (see ``GuessCost``).

A value is a secret if it, or a piece of it between signs, costs ``min_log10`` decimal digits of
guesses, ``min_brute`` of them by brute force, and ``min_share`` of what brute force alone
would take for its characters.  The share is what tells random values from prose of any
length: of paths and URLs only pieces count, as their signs part names.

Words are ranked: a short list of common passwords, then the whole words of a public
tokenizer's vocabulary in the order of their merges, which is about that of their frequency.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillmark.llm.common import in_parts, keyed_text, table

#: The base patterns, fixed values of the query's contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
#: Of these a match of the greedy base pattern is kept exactly if it is this long.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "guess")

#: Words that make what follows a credential, beyond those of the base pattern; the name that holds one may begin with anything.
#: For texts whose A-Z are lower-cased.
CONTEXT = re.compile(
    r"""(?:passphrase|password|passwd|passcode|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|authorization|bearer|pin)["']?(?:\x20*(?::=|=>|[:=])\x20*|\x20+is\x20+)["'`]?(?:bearer\x20+|basic\x20+)?([^\s"'`<>,;]+)""",
    re.ASCII,
)
_CONTEXT_HINT = re.compile(r"[:=]|\x20is\x20", re.IGNORECASE | re.ASCII)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Common password words, most common first; the words of a vocabulary come after them.
WORDS = tuple(
    "password admin welcome login dragon master monkey letmein secret sunshine princess football shadow baseball "
    "superman trustno hello freedom whatever ninja mustang access flower passw0rd batman starwars computer "
    "summer winter spring autumn monday friday january december love money test user root guest default changeme "
    "temp demo sample example service server system oracle mysql postgres public private key token api pass word "
    "blue green red black white orange purple silver gold tiger lion eagle wolf horse cookie coffee pepper ginger "
    "london paris berlin madrid america michael jordan thomas robert daniel jessica ashley george charlie andrew "
    "hunter killer soccer hockey ranger jackson matthew joshua amanda nicole maggie buster harley cheese internet "
    "the and you that was for are with his they this have from one had not but what all were when your can said".split()
)
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "789456123", "147258369")
_SWAPS = str.maketrans("@4301!$57+", "aaeoiisstt")


@lru_cache(maxsize=4)
def ranked_words(vocabulary: str | None) -> tuple[str, ...]:
    """``WORDS``, then the whole words of three letters or more that merges of a vocabulary file end in, in their order."""
    if vocabulary is None:
        return WORDS
    model = json.loads(open(vocabulary, encoding="utf-8").read())["model"]
    end = model.get("end_of_word_suffix") or ""
    found = dict.fromkeys(WORDS)
    for pair in model["merges"]:
        whole = pair.replace(" ", "") if isinstance(pair, str) else "".join(pair)
        if end and whole.endswith(end):
            whole = whole[: -len(end)]
        elif end or not whole.startswith("\u0120"):
            continue
        else:
            whole = whole[1:]
        if len(whole) >= 3 and whole.isascii() and whole.isalpha():
            found.setdefault(whole.lower())
    return tuple(found)


@lru_cache(maxsize=4)
def guess_cost(vocabulary: str | None) -> GuessCost:
    """One per Python worker."""
    return GuessCost(ranked_words(vocabulary))


def _neighbours() -> frozenset[str]:
    """Pairs of keys that lie side by side in a row, or above one another in two of the first four."""
    pairs = {a + b for row in ROWS for a, b in zip(row, row[1:])}
    pairs |= {row[k] + below[j] for row, below in zip(ROWS[:4], ROWS[1:4]) for k in range(len(row)) for j in (k, k - 1) if 0 <= j < len(below)}
    return frozenset(pairs | {p[::-1] for p in pairs})


_LOG = [0.0, *map(math.log10, range(1, 64))]
_BESIDE = _neighbours()
_FORWARD = frozenset(a + b for row in ROWS for a, b in zip(row, row[1:]))


def _beside(a: str, b: str) -> bool:
    """Keys that a walk may go between: neighbours, or characters that follow one another."""
    return a + b in _BESIDE or ord(b) - ord(a) in (1, -1)


@dataclass(frozen=True)
class Segment:
    start: int
    end: int
    kind: str
    log10: float


_DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)?\d\d|(?:19|20)\d\d", re.ASCII)


class GuessCost:
    """Minimum-cost segmentation of a value, in time that grows with its length.

    Words, plain, with signs for letters or reversed, stand anywhere; dates are years or whole
    dates; a walk has 3 to ``WALK`` keys; a repeat has a unit of at most ``UNIT`` characters, two
    to four times or as often as it goes on.  All of these may begin anywhere, so a value's cost is the least over all
    ways to part it into them and single characters.
    """

    #: Between words, one of about ten signs is tried.
    SIGNS = "-_./:"
    WALK, UNIT, TIMES = 48, 16, (2, 3, 4)

    def __init__(self, words: tuple[str, ...] = WORDS):
        self.rank = {w: k + 1 for k, w in reversed(list(enumerate(words)))}
        self.forward, self.backward = ahocorasick.Automaton(), ahocorasick.Automaton()
        for w in self.rank:
            self.forward.add_word(w, w)
            self.backward.add_word(w[::-1], w)
        for a in (self.forward, self.backward):
            if self.rank:
                a.make_automaton()

    def _alphabet(self, value: str) -> int:
        """How many characters brute force tries for each; signs between words are not among them."""
        s = re.sub("[-_./:]", "", value) or value
        if re.search("[0-9]", s) and re.fullmatch("[0-9]*[a-f][0-9a-f]*|[0-9]*[A-F][0-9A-F]*", s):
            return 16
        n = 26 * bool(re.search("[a-z]", s)) + 26 * bool(re.search("[A-Z]", s)) + 10 * bool(re.search("[0-9]", s)) + 33 * bool(re.search(r"[!-/:-@\[-`{-~ ]", s))
        return max(10, n + 100 * (not s.isascii()))

    def _unit(self, unit: str, low: str) -> float | None:
        """log10 of the guesses of a repeat's unit; none for one that is a repeat itself and no word."""
        rank = self.rank.get(low)
        if rank is None and (low + low).find(low, 1) < len(low):
            return None
        return min(len(unit) * math.log10(self._alphabet(unit)), math.inf if rank is None else math.log10(rank) + 0.3)

    def _words(self, s: str, low: str) -> Iterator[Segment]:
        """Words by their ends."""
        plain = low.translate(_SWAPS) if s.isascii() else low
        ways = [(self.forward, low, 0.0), (self.backward, low, 0.3)] + [(self.forward, plain, 0.5)] * (plain != low)
        found = [zip(a.iter(text), itertools.repeat(twist)) for a, text, twist in ways if self.rank]
        for (end, word), twist in heapq.merge(*found, key=lambda x: x[0][0]):
            j, i = end + 1, end + 1 - len(word)
            own = s[i:j]
            case = 0.0 if own.islower() or not own.isalpha() else 0.3 if own.istitle() or own.isupper() else 0.3 * (j - i) / 2
            yield Segment(i, j, "word", math.log10(self.rank[word]) + twist + case)

    def _repeats(self, low: str) -> list[np.ndarray]:
        """For each length of a unit: from each place, how many characters in a row equal those a unit later."""
        codes = np.frombuffer(low.encode("utf-32-le"), np.uint32)
        out = []
        for p in range(1, min(self.UNIT, len(low) // 2) + 1):
            differs = np.append(np.flatnonzero(codes[:-p] != codes[p:]), len(low) - p)
            out.append(differs[np.searchsorted(differs, np.arange(len(low) - p))] - np.arange(len(low) - p))
        return out

    def _from(self, s: str, low: str, runs: list[np.ndarray], units: dict[str, float | None], i: int) -> Iterator[tuple[int, str, float]]:
        """(end, kind, log10) of dates, repeats and walks that begin at a place."""
        n = len(s)
        if s[i] in "0123456789":
            for j in range(i + 4, min(n, i + 10) + 1):
                if _DATE.fullmatch(s, i, j):
                    yield j, "date", 2.0 if j - i == 4 else math.log10(365 * 120) + 0.6 * (not s[i:j].isdigit())
        for p, run in enumerate(runs, 1):
            if i < len(run) and run[i] >= p:
                unit = s[i : i + p]
                if unit not in units:
                    units[unit] = self._unit(unit, low[i : i + p])
                if (base := units[unit]) is not None:
                    most = int(run[i]) // p + 1
                    for times in {*self.TIMES, most}:
                        if times <= most and times * p > 2:
                            yield i + times * p, "repeat", base + math.log10(times)
        j, turns, way = i + 1, 0, None
        while j < min(n, i + self.WALK) and _beside(low[j - 1], low[j]):
            forward = low[j - 1] + low[j] in _FORWARD
            turns += forward != way
            way = forward
            j += 1
            if j - i > 2:
                yield j, "walk", _LOG[47] + _LOG[j - i] + turns * _LOG[4]

    def _segments(self, s: str) -> list[Segment]:
        """All segments of a value but single characters."""
        low = s.lower() if len(s.lower()) == len(s) else s
        runs, units = self._repeats(low), {}
        return [*self._words(s, low), *(Segment(i, *x) for i in range(len(s)) for x in self._from(s, low, runs, units, i))]

    def segment(self, value: str) -> tuple[float, list[Segment]]:
        """(log10 of the guesses, the cheapest segmentation)."""
        n = len(value)
        low = value.lower() if len(value.lower()) == n else value
        each = math.log10(self._alphabet(value))
        words, runs, units = self._words(value, low), self._repeats(low), {}
        word = next(words, None)
        cost, back = [0.0] + [math.inf] * n, [None] * (n + 1)
        for i in range(n):
            here = cost[i]
            # a segment's kind and place are guessed too
            for end, kind, log10 in self._from(value, low, runs, units, i):
                if here + log10 + 0.3 < cost[end]:
                    cost[end], back[end] = here + log10 + 0.3, (i, end, kind, log10)
            # brute force goes on by a character: spans of any length, at no charge per span
            one = 1.0 if value[i] in self.SIGNS else each
            if here + one <= cost[i + 1]:
                cost[i + 1], back[i + 1] = here + one, None
            while word is not None and word.end == i + 1:
                if cost[word.start] + word.log10 + 0.3 < cost[i + 1]:
                    cost[i + 1], back[i + 1] = cost[word.start] + word.log10 + 0.3, (word.start, word.end, word.kind, word.log10)
                word = next(words, None)
        found: list[Segment] = []
        j = n
        while j:
            if back[j] is not None:
                x = Segment(*back[j])
            else:
                e, kind = j, "sign" if value[j - 1] in self.SIGNS else "brute"
                while j and back[j] is None and (value[j - 1] in self.SIGNS) == (kind == "sign"):
                    j -= 1
                x = Segment(j, e, kind, (e - j) * (1.0 if kind == "sign" else each))
            found.append(x)
            j = x.start
        return cost[n], found[::-1]


@dataclass(frozen=True)
class Rule:
    """From which guess cost on a credential value is a secret; see the head of this module."""

    min_log10: float = 9.0
    min_brute: float = 5.0
    min_share: float = 0.7

    def _costly(self, segments: list[Segment], each: float) -> bool:
        own = [x for x in segments if x.kind != "sign"]
        brute = sum(x.log10 for x in own if x.kind == "brute")
        digits = brute + sum(x.log10 + 0.3 for x in own if x.kind != "brute")
        return digits >= self.min_log10 and brute >= self.min_brute and digits >= self.min_share * each * sum(x.end - x.start for x in own)

    def secret(self, value: str, segments: list[Segment], model: GuessCost) -> bool:
        """Whether a value, or a piece between signs, is costly; of a path or an address, whether a value between its slashes is."""
        if value.count("/") + value.count("\\") > 1:
            return any(self.secret(x, model.segment(x)[1], model) for x in re.split(r"[/\\?&=]", value) if x)
        each = math.log10(model._alphabet(value))
        if self._costly(segments, each):
            return True
        piece: list[Segment] = []
        for x in segments:
            if x.kind != "sign":
                piece.append(x)
            elif self._costly(piece, each):
                return True
            else:
                piece = []
        return self._costly(piece, each)


@dataclass(frozen=True)
class Value:
    """A credential value, the log10 of the guesses that it costs, and the segmentation that is cheapest."""

    start: int
    end: int
    log10: float
    segments: tuple[Segment, ...]
    secret: bool

    def __str__(self) -> str:
        return f"{self.start}:{self.end}:{self.log10:.2f}:{'+'.join(f'{x.kind}{x.end - x.start}' for x in self.segments)}"


def _order(span: tuple[int, int, str]) -> tuple:
    return span[0], KINDS.index(span[2]), span[1]


def base_finds(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int]]]:
    """(spans of the base patterns by start and then kind, places of the assignments' values)."""
    base: list[tuple[int, int, str]] = []
    places: list[tuple[int, int]] = []
    if ":" in text or "=" in text:
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= ASSIGN_LEAST:
                base.append((*m.span(), "assign"))
                places.append(m.span(2))
    if "AKIA" in text:
        base += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    base += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(base, key=_order), places


def credential_values(text: str, places: list[tuple[int, int]], model: GuessCost, rule: Rule) -> list[Value]:
    """Guess cost of every credential value of six characters or more, by start.

    These are the values at ``places`` and those behind other credential contexts that overlap
    none of them.
    """
    found = list(places)
    if _CONTEXT_HINT.search(text):
        ends = [b for _, b in places]
        for m in _contexts(text):
            a, b = m.start(1), m.start(1) + len(m[1].rstrip(".)]}!?"))
            k = bisect_right(ends, a)
            if b - a >= ASSIGN_LEAST and (k == len(places) or places[k][0] >= b):
                found.append((a, b))
    out = []
    for a, b in sorted(found):
        value = text[a:b]
        log10, segments = model.segment(value)
        out.append(Value(a, b, log10, tuple(segments), rule.secret(value, segments, model)))
    return out


def guess_spans(base: list[tuple[int, int, str]], values: list[Value]) -> list[tuple[int, int, str]]:
    """Spans of the values that are secrets and that no base span covers."""
    return [(v.start, v.end, "guess") for v in values if v.secret and not any(s <= v.start and v.end <= e for s, e, _ in base)]


def find_secrets(text: str, model: GuessCost, min_log10: float) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, guess spans) of one text."""
    base, places = base_finds(text)
    return base, guess_spans(base, credential_values(text, places, model, Rule(min_log10)))


def _contexts(text: str) -> Iterator[re.Match]:
    """Matches of CONTEXT in order, at the places that they have in the text itself."""
    return CONTEXT.finditer(text.encode().translate(_LOWER).decode())


def _joined(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", min_log10: float = 9.0, min_brute: float = 5.0, min_share: float = 0.7, vocabulary: str | None = None) -> DataFrame:
    """Per row: n_assign, n_access, n_hex, base_sha256, spans, n_guess, n_costly and guess_costs.

    ``spans`` lists kind:start:end (code points, end exclusive) of all finds, comma-joined,
    by start and then kind; ``base_sha256`` is the SHA-256 of the list of the first three
    kinds alone.  ``guess_costs`` lists every credential value, in a base span or not, secret or
    not, as start:end:log10 of its guesses:segmentation, such as word5+brute8; ``n_costly`` of
    them are secrets by the three thresholds (see ``Rule``), and those in no base span are
    the ``guess`` spans.  ``vocabulary`` is a tokenizer file whose words the guesser knows;
    without one it knows ``WORDS``.  Null and empty texts have no spans; null keys and
    repeated rows stay; other columns are not read; no rows give no rows.  Keys must be whole
    numbers.
    """
    rule = Rule(min_log10, min_brute, min_share)

    def run(batches):
        model = guess_cost(vocabulary)
        for part, texts in in_parts(batches):
            rows = []
            for t in texts:
                base, places = base_finds(t)
                values = credential_values(t, places, model, rule)
                more = guess_spans(base, values)
                kinds = [k for _, _, k in base]
                rows.append(
                    (*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted(base + more, key=_order)), len(more), sum(v.secret for v in values), ",".join(map(str, values)))
                )
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(),) * 3 + (pa.string(),) * 2 + (pa.int64(),) * 2 + (pa.string(),)))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "n_costly", "guess_costs"],
            )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, n_costly long, guess_costs string"
    return keyed_text(docs, key, text).mapInArrow(run, schema)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return scan_secrets(table(spark, sf_dir, "documents"), vocabulary=public_tokenizers.path("word_bpe_49k.json"))
