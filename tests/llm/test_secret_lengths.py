"""Guess costs of values of any length, against segments listed by hand and by rates per kind and length."""

from __future__ import annotations

import math
import random
import re

import public_tokenizers
import pytest

from quillmark.llm.secret_scan import GuessCost, find_secrets, guess_cost, ranked_words

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SWAPS = dict(zip("@4301!$57+", "aaeoiisstt"))
KEYS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "789456123", "147258369")


def beside(a: str, b: str) -> bool:
    if ord(a) - ord(b) in (1, -1):
        return True
    for row in KEYS:
        if a in row and b in row and abs(row.index(a) - row.index(b)) == 1:
            return True
    for up, down in zip(KEYS[:3], KEYS[1:4]):
        for x, y in ((a, b), (b, a)):
            if x in up and y in down and up.index(x) - down.index(y) in (0, 1):
                return True
    return False


def is_date(s: str) -> bool:
    day, month, year = r"(0?[1-9]|[12]\d|3[01])", r"(0?[1-9]|1[0-2])", r"(19|20)\d\d"
    return any(re.fullmatch(f"{year}{g}{month}{g}{day}|{day}{g}{month}{g}((19|20)?\\d\\d)", s) for g in ("", "-", r"\.", "_", "/")) or bool(re.fullmatch(year, s))


def segment_cost(model: GuessCost, s: str, i: int, j: int) -> float:
    """The least cost of one segment from i to j of any kind but brute force, by the definitions alone."""
    x, low, out = s[i:j], s[i:j].lower(), [math.inf]
    case = 0.0 if x.islower() or not x.isalpha() else 0.3 if x.istitle() or x.isupper() else 0.15 * len(x)
    for form, twist in ((low, 0.0), ("".join(SWAPS.get(c, c) for c in low), 0.5), (low[::-1], 0.3)):
        if form in model.rank:
            out.append(math.log10(model.rank[form]) + twist + case)
    if is_date(x):
        out.append(2.0 if len(x) == 4 else math.log10(365 * 120) + 0.6 * (not x.isdigit()))
    for p in range(1, min(16, len(x) // 2) + 1):
        times, unit = len(x) // p, low[:p]
        whole = len(x) == p * times and low == unit * times and len(x) > 2
        goes_on = s.lower()[j : j + p] == unit
        itself = any(unit == unit[:q] * (p // q) for q in range(1, p) if p % q == 0) and unit not in model.rank
        if whole and (times <= 4 or not goes_on) and not itself:
            base = p * math.log10(model._alphabet(x[:p]))
            out.append(min(base, math.log10(model.rank[unit]) + 0.3 if unit in model.rank else math.inf) + math.log10(times))
    if 3 <= len(x) <= 48 and all(beside(a, b) for a, b in zip(low, low[1:])):
        ways = [any(a + b in row for row in KEYS) for a, b in zip(low, low[1:])]
        turns = 1 + sum(a != b for a, b in zip(ways, ways[1:]))
        out.append(math.log10(47) + math.log10(len(x)) + turns * math.log10(4))
    return min(out)


def least_cost(model: GuessCost, s: str) -> float:
    each, best = math.log10(model._alphabet(s)), [0.0]
    for j in range(1, len(s) + 1):
        one = 1.0 if s[j - 1] in "-_./:" else each
        best.append(min([best[-1] + one] + [best[i] + segment_cost(model, s, i, j) + 0.3 for i in range(max(0, j - 400), j - 1)]))
    return best[-1]


VALUES = [
    "password1", "qwerty2020", "abcabcabc", "Zx9$k", "dragon1987!", "aaaa", "aaaaaaaaa", "p@ssw0rd", "drowssap-nogard", "1987-04-12_monkey", "12.4.1987", "asdfghjkl;'zxc", "xqwsxcd", "hahahahaha", "ab" * 20 + "!x",
    "monkeymonkeymonkey", "MonKEYmonkey77", "/etc/passw0rd/2020", "qazwsxedc", "321cba", "zk19870412", "é" * 5 + "abc", "0.0.0.0:80", "...---...", "a-b-a-b-a-b", "deadbeef01", "19871987",
]


@pytest.mark.parametrize("value", VALUES)
def test_cost_is_the_least_over_segments_listed_by_hand(value):
    model = GuessCost()
    cost, parts = model.segment(value)
    assert "".join(value[p.start : p.end] for p in parts) == value
    assert cost == pytest.approx(least_cost(model, value))


def test_cost_of_random_values_is_the_least():
    model, rng = GuessCost(), random.Random(4)
    bits = ["pass", "love", "12", "1234", "qwe", "asd", "aa", "ab", "-", ".", "2020", "X", "9", "!", "evol", "l0ve", "the"]
    for _ in range(60):
        value = "".join(rng.choice(bits) for _ in range(rng.randint(2, 9)))
        assert model.segment(value)[0] == pytest.approx(least_cost(model, value)), value


@pytest.mark.parametrize("value, secret", [("q9Zx!7Lm#2vTr8", True), ("ab" * 60, False), ("ab" * 500, False), ("a" * 1600, False), ("https://example.com/path/to/some/document/index.html", False), ("/var/lib/postgresql/data/pg_hba.conf", False)])
@pytest.mark.parametrize("before", [0, 39, 41, 60, 5000])
def test_no_prefix_and_no_length_changes_a_finding(value, secret, before):
    model = guess_cost(VOCABULARY)
    text = f"{'X' * before}_pwd: {value} x"
    a = text.index(value)
    assert find_secrets(text, model, 9.0)[1] == ([(a, a + len(value), "guess")] if secret else [])


def test_cost_grows_smoothly_with_a_repeat():
    model = GuessCost()
    costs = [model.segment("ab" * n)[0] for n in (10, 30, 63, 64, 65, 200, 500, 5000)]
    assert all(a <= b <= a + 1.1 for a, b in zip(costs, costs[1:])) and costs[-1] < 9


LENGTHS = [(12, 24), (25, 60), (61, 120), (121, 200), (201, 600)]


@pytest.mark.parametrize("low, high", LENGTHS)
def test_random_values_of_any_length_are_found(low, high):
    model, rng = guess_cost(VOCABULARY), random.Random(low)
    marks = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!#%+_"
    values = ["".join(rng.choice(marks[: rng.choice([26, 62, 67])]) for _ in range(rng.randint(low, high))) for _ in range(150)]
    assert sum(bool(find_secrets(f"pwd: {v} x", model, 9.0)[1]) for v in values) >= 0.97 * len(values)


@pytest.mark.parametrize("words", [3, 6, 12, 30, 60])
def test_paths_addresses_phrases_and_sentences_of_any_length_are_not(words):
    model, rng = guess_cost(VOCABULARY), random.Random(words)
    known = [w for w in ranked_words(VOCABULARY) if len(w) > 2][:20_000]
    some = lambda n=words: rng.sample(known, n)
    kinds = {
        "path": lambda: "/" + "/".join(some()) + rng.choice([".html", ".conf", ".py", ""]),
        "address": lambda: f"https://{rng.choice(known)}.com/{'/'.join(some())}?id={rng.randint(1, 99999)}",
        "phrase": lambda: "-".join(some()),
        "snake": lambda: "_".join(some()),
        "camel": lambda: "".join(w.title() for w in some()),
        "sentence": lambda: "".join(some()),
    }
    for kind, make in kinds.items():
        values = [make() for _ in range(100)]
        hits = sum(bool(find_secrets(f"credentials: {v} x", model, 9.0)[1]) for v in values)
        assert hits <= 0.05 * len(values), (kind, hits)
