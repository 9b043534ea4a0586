"""Byte-pair vocabularies compiled, lazily, into deterministic transducers.

A prefix of a pre-token has exactly one byte-pair segmentation, and its last token depends
only on a bounded left context: the vocabulary paths that are still open and, for each of
them, the token that ends where the path starts.  That context is the transducer's state.
A transition advances every open path by one symbol, picks the one token that ends there
and whose pair with its predecessor is stable under the merge rules, and emits the change
in the number of tokens.  States and transitions are made when the text first needs them.

Texts are run in lockstep: a batch is cut into equally long chunks.  From its first
pre-token start on, a chunk's state map is constant, so a chunk is (lead, constant map);
the prefix scan composes these maps: each lead is run from the exit state before it, and
chunks without any start hand the composition on to the next round.

Long texts are cut between two words, where both patterns part pre-tokens whatever stands
around, so memory is bounded by a batch and not by a text.  Pieces with characters outside
``_SAFE`` or with special strings go to the tokenizers library itself, so the ids and
counts are the library's for every text.

Memory: a state is one ``bytes`` object, the table of transitions is reserved once for
``max_states`` rows and touched as states are made, and the library is loaded only when a
piece needs it.  A batch that would pass ``max_states`` starts the table anew and is run in
halves.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import cached_property, lru_cache

import numpy as np

SEP, SPACE, LETTER, NUMBER, OTHER, UNSAFE = range(6)
_TABLE = 0xD7A4
#: Blocks whose classes have long been settled: Latin, Greek, Cyrillic, Hebrew and Arabic letters, punctuation, kana, Han, Hangul.
_BLOCKS = ((1, 0x250), (0x370, 0x530), (0x5D0, 0x5EB), (0x620, 0x64B), (0x660, 0x66A), (0x2010, 0x2028), (0x20AC, 0x20AD), (0x3041, 0x3097), (0x30A1, 0x30FB), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4))


def _classes() -> np.ndarray:
    out = np.full(_TABLE, UNSAFE, np.uint8)
    for c in (c for low, high in _BLOCKS for c in range(low, high)):
        low = chr(c).lower()
        if unicodedata.normalize("NFC", chr(c)) != chr(c) or len(low) != 1 or unicodedata.normalize("NFC", low) != low:
            continue
        if not any(a <= ord(low) < b for a, b in _BLOCKS):
            continue
        kind = unicodedata.category(chr(c))
        if c in (9, 10, 11, 12, 13, 32):
            out[c] = SPACE
        elif kind[0] == "L":
            out[c] = LETTER
        elif kind[0] == "N":
            out[c] = NUMBER
        elif kind[0] in "PS":
            out[c] = OTHER
    out[0] = SEP
    out[0x3A3] = UNSAFE  # its lower case depends on what stands around it
    return out


_SAFE = _classes()
#: Contractions that both vocabularies' published patterns split off (fixed values).
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def _byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


#: Children of the nodes of a vocabulary's trie that have none; never written to.
_LEAF: dict[int, int] = {}
#: Between two words: what stands before and after never shares a pre-token.
_BETWEEN = re.compile(r"(?<=[a-z])(?= [a-z])")


def cut_text(text: str, most: int) -> list[str]:
    """Pieces of about ``most`` characters, cut between words; a stretch without such a place stays whole."""
    if len(text) <= most:
        return [text]
    out, low = [], 0
    while len(text) - low > most and (m := _BETWEEN.search(text, low + most)):
        out.append(text[low : m.start()])
        low = m.start()
    return [*out, text[low:]]


class _Full(Exception):
    """There is no room for another state."""


def _coded(paths: list[tuple[int, int, int]]) -> bytes:
    """A state, (node, token before, offset) of each open path, as bytes."""
    return array("q", [(before + 1) << 40 | node << 16 | offset + 32768 for node, before, offset in paths]).tobytes()


def _decoded(state: bytes) -> list[tuple[int, int, int]]:
    return [(x >> 16 & 0xFFFFFF, (x >> 40) - 1, (x & 0xFFFF) - 32768) for x in array("q", state)]


class BpeAutomaton:
    """One vocabulary's transducer; grows as texts are run, and starts anew beyond ``max_states``."""

    #: Step entries hold the next state and, in five bits, the emission plus this; 0: not made yet.
    _NONE = 16
    #: Vocabulary paths with so few tokens below tell predecessors apart by what they allow.
    FEW = 12
    MEMO = 60_000
    #: Places for transitions, 4 bytes each; corpora of many scripts have more columns and so fewer states.
    CELLS = 15_400_000

    def __init__(self, path: str, counting: bool = True, max_states: int = 120_000, columns: int = 128):
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        self.path, self.counting, self.max_states, self.columns = path, counting, max_states, columns
        self.suffix = model.get("end_of_word_suffix") or ""
        self.lower = bool(self.suffix)
        self.special = tuple(t["content"] for t in spec["added_tokens"])
        letters = _byte_letters()
        vocab = model["vocab"]
        size = max(vocab.values()) + 1
        self.length = np.zeros(size + 1, np.int32)
        self.token_at: list[int] = [-1]
        self.children: list[dict[int, int]] = [_LEAF]
        for text, token in vocab.items():
            ends = bool(self.suffix) and text.endswith(self.suffix)
            symbols = [letters[c] for c in (text[: -len(self.suffix)] if ends else text)]
            if ends:
                symbols[-1] += 256
            self.length[token] = len(symbols)
            node = 0
            for s in symbols:
                nxt = self.children[node].get(s)
                if nxt is None:
                    nxt = len(self.children)
                    if not self.children[node]:
                        self.children[node] = {}
                    self.children[node][s] = nxt
                    self.children.append(_LEAF)
                    self.token_at.append(-1)
                node = nxt
            self.token_at[node] = token
        self.rank = [-1] * size
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.merged: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            self.merged[a, b] = rank
            if self.parts[whole] is None:
                self.parts[whole], self.rank[whole] = (a, b), rank
        self.pairs: dict[int, bool] = {}
        self.views: dict[int, int | None] = {}
        self.alike: dict[tuple, int] = {}
        self.below: dict[int, list[int] | None] = {}
        self._restart()

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.no_truncation()
        out.no_padding()
        return out

    def __reduce__(self):
        return automaton, (self.path, self.counting)

    def _restart(self, room: int | None = None) -> None:
        """Forgets all states; the columns stay.  There is room for ``max_states`` and CELLS transitions, or for ``room`` states."""
        if not hasattr(self, "symbol_of"):
            self.column = np.zeros(512, np.int32)
            self.symbol_of = [-1]
        first = _coded([(0, -1, 0)])
        self.states: list[bytes] = [first]
        self.index: dict[bytes, int] = {first: 0}
        # zeros are reserved, and become memory when they are written to
        room = room or max(2, min(self.max_states, self.CELLS // self.columns))
        self.step = np.zeros((room, self.columns), np.int32)
        self.last = np.full(room, -1, np.int32)
        self.step[0, 0] = self._NONE

    def _stable(self, left: int, right: int) -> bool:
        """Whether the merge rules leave ``left`` and ``right`` side by side as they are.

        Both tokens are taken apart at the edge where they meet, the later merge first.  A
        rule for the two edge pieces that comes before the merge that consumed one of them
        would have joined them instead; on a tie the pair further left goes first.
        """
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is not None:
            return known
        good = self.pairs[key] = self._check(left, right)
        return good

    def _check(self, left: int, right: int) -> bool:
        rank, parts, merged = self.rank, self.parts, self.merged
        bound = 1 << 60
        while True:
            rule = merged.get((left, right))
            if rule is not None and 2 * rule < bound:
                return False
            a, b = rank[left], rank[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                bound, left = 2 * a, parts[left][1]
            else:
                bound, right = 2 * b + 1, parts[right][0]

    def _view(self, node: int, before: int) -> int | None:
        """One stand-in for all predecessors that allow the same tokens below ``node``; None if none."""
        if before < 0:
            return before
        key = node << 20 | before
        if (known := self.views.get(key, -2)) != -2:
            return known
        below = self.below.get(node, 0)
        if below == 0:
            below, todo = [], [*self.children[node].values()]
            while todo and len(below) <= self.FEW:
                n = todo.pop()
                if self.token_at[n] >= 0:
                    below.append(self.token_at[n])
                todo += self.children[n].values()
            if len(below) > self.FEW:
                below = None
            self.below[node] = below
        if below is None:
            out = before
        else:
            allowed = tuple(t for t in below if self._check(before, t))
            out = self.alike.setdefault((node, allowed), before) if allowed else None
        self.views[key] = out
        return out

    def _make(self, state: int, column: int) -> None:
        symbol, children, token_at = self.symbol_of[column], self.children, self.token_at
        token, gain, open_paths = -1, 0, []
        for node, before, offset in _decoded(self.states[state]):
            node = children[node].get(symbol)
            if node is None:
                continue
            t = token_at[node]
            if t >= 0 and token < 0 and (before < 0 or self._stable(before, t)):
                token, gain = t, offset + 1
            if children[node] and (view := self._view(node, before)) is not None:
                open_paths.append((node, view, offset))
        if symbol >= 256:
            open_paths = []
        new = _coded([*((n, b, (o - gain) * self.counting) for n, b, o in open_paths), (0, token, 0)])
        k = self.index.get(new)
        if k is None:
            k = len(self.states)
            if k >= len(self.step):
                raise _Full
            self.index[new] = k
            self.states.append(new)
            self.last[k] = token
            self.step[k, 0] = self._NONE
        self.step[state, column] = k << 5 | gain + self._NONE
        if len(self.pairs) > self.MEMO:
            self.pairs.clear()
        if len(self.views) > self.MEMO:
            self.views.clear()

    def _advance(self, state: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = state * self.columns + column
        nxt = self.step.reshape(-1).take(at)
        if len(nxt) and not nxt.all():
            for key in np.unique(at[nxt == 0]).tolist():
                self._make(*divmod(key, self.columns))
            nxt = self.step.reshape(-1).take(at)
        return nxt >> 5, nxt

    # -- pre-tokens ---------------------------------------------------------------

    def _starts(self, code: np.ndarray, kind: np.ndarray) -> np.ndarray:
        before = np.concatenate([[SEP], kind[:-1]]).astype(np.uint8)
        after = np.concatenate([kind[1:], [SEP]]).astype(np.uint8)
        start = kind != before
        tick = np.flatnonzero((code == 39) & (before != OTHER) & (after == LETTER))
        if self.lower:
            start |= kind == NUMBER
        else:
            ends = (kind == SPACE) & (after != SPACE) & (after != SEP)
            start |= ends
            joins = np.flatnonzero(ends & (code == 32)) + 1
            start[joins] = False
            tick = tick[(tick == 0) | (code[tick - 1] != 32)]
        if len(tick):
            c = np.concatenate([code, [0, 0, 0]])
            for tail in CONTRACTIONS:
                hit = np.ones(len(tick), bool)
                for k, ch in enumerate(tail):
                    hit &= c[tick + 1 + k] == ord(ch)
                for i in tick[hit].tolist():
                    n = i + 1 + len(tail)
                    start[i + 1] = False
                    if n < len(start) and kind[n] == LETTER:
                        start[n] = True
        return start

    def _symbols(self, joined: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per byte: column, whether a pre-token starts, whether one ends."""
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = _SAFE[code]
        start = self._starts(code, kind)
        real = kind != SEP
        if self.lower:
            real &= kind != SPACE
        end = real & np.concatenate([start[1:] | ~real[1:], [True]])
        start &= real
        raw = np.frombuffer(joined.encode("utf-8"), np.uint8)
        if len(raw) != len(code):
            head = (raw & 0xC0) != 0x80
            char = np.cumsum(head) - 1
            tail = np.concatenate([head[1:], [True]])
            start, end, real = start[char] & head, end[char] & tail, real[char]
        symbol = raw.astype(np.int32)
        if self.suffix:
            symbol = symbol + 256 * end
        symbol = np.where(real, symbol, 511)
        column = self.column[symbol]
        missing = (column == 0) & real
        if missing.any():
            new = np.unique(symbol[missing]).tolist()
            if len(self.symbol_of) + len(new) > self.columns:
                self.columns = len(self.symbol_of) + len(new) + 64
                self._restart()
            for s in new:
                self.column[s] = len(self.symbol_of)
                self.symbol_of.append(s)
            column = self.column[symbol]
        return np.where(real, column, 0).astype(np.int32), start, end

    # -- running ------------------------------------------------------------------

    def _run(self, column: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
        """Per byte: the tokens that its transition emits; without counting, the token that ends there."""
        try:
            return self._lanes(column, start, width)
        except _Full:
            self._restart()
        # from a pre-token's start on nothing depends on what stands before it
        inner = np.flatnonzero(start[1:]) + 1
        if len(column) <= width or not len(inner):
            return self._alone(column, start, width)
        cut = int(inner[np.argmin(np.abs(inner - len(column) // 2))])
        return np.concatenate([self._run(column[:cut], start[:cut], width), self._run(column[cut:], start[cut:], width)])

    def _alone(self, column: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
        """As ``_run``, with as many states as it takes: a pre-token can't be halved."""
        self._restart(max(self.max_states, len(column) + 2))
        try:
            return self._lanes(column, start, width)
        finally:
            self._restart()

    def _lanes(self, column: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
        n = len(column)
        chunks = -(-n // width)
        pad = chunks * width - n
        col = np.concatenate([column, np.zeros(pad, np.int32)]).reshape(chunks, width)
        begin = np.concatenate([start, np.zeros(pad, bool)]).reshape(chunks, width)
        states = np.empty((1 if self.counting else width, chunks), np.int32)
        emitted = np.empty((width if self.counting else 1, chunks), np.int8)
        turned, fresh = np.ascontiguousarray(col.T), np.ascontiguousarray(~begin.T)
        seen = np.zeros(chunks, bool)
        state = final = np.zeros(chunks, np.int32)
        for j in range(width):
            seen |= ~fresh[j]
            state = state * fresh[j]
            state, packed = self._advance(state, turned[j] * seen)
            if self.counting:
                emitted[j] = (packed & 31) - self._NONE
            else:
                states[j] = state
            final = state
        # lead: what stands before a chunk's first start; its entry state is the exit before it
        first = np.where(begin.any(axis=1), begin.argmax(axis=1), width)
        todo = np.flatnonzero((first > 0) & (np.arange(chunks) > 0))
        ready = first < width
        ready[0] = True
        while len(todo):
            now = todo[ready[todo - 1]]
            state = final[now - 1]
            steps, lane = first[now], now
            for j in range(int(steps.max(initial=0))):
                alive = steps > j
                if not alive.all():
                    state, lane, steps = state[alive], lane[alive], steps[alive]
                state, packed = self._advance(state, turned[j, lane])
                if self.counting:
                    emitted[j, lane] = (packed & 31) - self._NONE
                else:
                    states[j, lane] = state
            through = steps == width
            final[lane[through]] = state[through]
            ready[now] = True
            todo = np.setdiff1d(todo, now, assume_unique=True)
        out = (emitted if self.counting else states).T.reshape(-1)[:n]
        return out if self.counting else self.last.take(out)

    def _fits(self, text: str) -> bool:
        if any(s in text for s in self.special):
            return False
        if text.isascii() and text.isprintable():
            return True
        try:
            code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        except UnicodeEncodeError:
            return False
        return bool(len(code) == 0 or (code.max() < _TABLE and code.min() > 0 and _SAFE[code].max() < UNSAFE))

    def _batches(self, texts: list[str], chars: int):
        """About ``chars`` characters at a time: (pieces, number of the text of each, whether it goes to the library), and whether the last text ends there."""
        own: list[tuple[str, int, bool]] = []
        held = 0
        for k, t in enumerate(texts):
            pieces = cut_text(t, chars)
            for j, piece in enumerate(pieces):
                own.append((piece, k, not self._fits(piece)))
                held += len(piece) + 1
                if held >= chars:
                    yield own, j + 1 == len(pieces)
                    own, held = [], 0
        if own:
            yield own, True

    def _bytes_of(self, texts: list[str]) -> tuple[str, np.ndarray]:
        texts = [t.lower() for t in texts] if self.lower else texts
        joined = "\0".join(texts) + "\0"
        sizes = [len(t) if t.isascii() else len(t.encode()) for t in texts]
        return joined, np.cumsum(np.asarray(sizes, np.int64) + 1)

    def counts(self, texts: list[str], width: int = 64, chars: int = 400_000) -> np.ndarray:
        """Number of tokens of each text: the sum of what its transitions emit."""
        out = np.zeros(len(texts), np.int64)
        for own, _ in self._batches(texts, chars):
            good = [k for k, (_, _, odd) in enumerate(own) if not odd]
            if good:
                joined, ends = self._bytes_of([own[k][0] for k in good])
                column, start, _ = self._symbols(joined)
                total = np.concatenate([[0], np.cumsum(self._run(column, start, width), dtype=np.int64)])
                np.add.at(out, [own[k][1] for k in good], np.diff(total[np.concatenate([[0], ends])]))
            for piece, k, odd in own:
                if odd:
                    out[k] += len(self.library.encode(piece, add_special_tokens=False).ids)
        return out

    def _ids(self, own: list[tuple[str, int, bool]], width: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, number of ids of each)."""
        good = [k for k, (_, _, odd) in enumerate(own) if not odd]
        ids, sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)
        if good:
            joined, ends = self._bytes_of([own[k][0] for k in good])
            column, start, end = self._symbols(joined)
            token_of = self._run(column, start, width)
            mark = np.full(len(column), -1, np.int32)
            at, low = np.flatnonzero(end), np.flatnonzero(start)
            while len(at):
                token = token_of.take(at)
                mark[at] = token
                at = at - self.length.take(token)
                more = at >= low
                at, low = at[more], low[more]
            held = mark >= 0
            total = np.concatenate([[0], np.cumsum(held)])
            sizes = np.diff(total[np.concatenate([[0], ends])])
            ids = mark[held]
        if len(good) < len(own):
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            parts = {k: ids[bounds[j] : bounds[j + 1]] for j, k in enumerate(good)}
            for k, (piece, _, odd) in enumerate(own):
                if odd:
                    parts[k] = np.asarray(self.library.encode(piece, add_special_tokens=False).ids, np.int32)
            ids = np.concatenate([parts[k] for k in range(len(own))])
            sizes = np.asarray([len(parts[k]) for k in range(len(own))], np.int64)
        return ids, sizes

    def encode(self, texts: list[str], width: int = 64, chars: int = 400_000):
        """Yields, batch by batch in order, (ids of all its texts, number of ids of each)."""
        waiting: list[np.ndarray] = []  # ids of a text whose other pieces are still to come
        done = 0
        for own, complete in self._batches(texts, chars):
            ids, sizes = self._ids(own, width)
            owner = np.array([k for _, k, _ in own]) - done
            per = np.bincount(owner, weights=sizes).astype(np.int64)
            per[0] += sum(map(len, waiting))
            waiting.append(ids)
            done = own[-1][1] + 1
            if not complete:
                # all but the last text
                done -= 1
                ids, tail = np.concatenate(waiting), int(per[-1])
                waiting, per = [ids[len(ids) - tail :]], per[:-1]
                ids = ids[: len(ids) - tail]
            else:
                ids, waiting = np.concatenate(waiting), []
            if len(per):
                yield ids, per


@lru_cache(maxsize=2)
def automaton(path: str, counting: bool = True) -> BpeAutomaton:
    """One per Python worker, so what one task compiled serves the next."""
    return BpeAutomaton(path, counting)
