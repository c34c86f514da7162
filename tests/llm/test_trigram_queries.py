import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidewell.llm import secrets
from tidewell.llm.common import flat


def words(query):
    return {frozenset("".join(chr(t >> k & 255) for k in (16, 8, 0)) for t in alternative) for alternative in query}


def by_hand(*alternatives):
    return {frozenset(s[i : i + 3] for s in strings for i in range(len(s) - 2)) for strings in alternatives}


@pytest.mark.parametrize(
    ("kind", "alternatives"),
    [
        ("assign", [["password"], ["passwd"], ["secret"], ["token"], ["apikey"], ["api_key"]]),
        ("access", [["akia"]]),
        ("pem", [["-----begin ", "private key-----"]]),
        ("github", [["ghp_"], ["gho_"], ["ghu_"], ["ghs_"], ["ghr_"]]),
        ("slack", [["xoxa-"], ["xoxb-"], ["xoxp-"], ["xoxr-"], ["xoxs-"]]),
        ("jwt", [["eyj", ".eyj"]]),
        ("google", [["aiza"]]),
    ],
)
def test_queries_of_the_rules(kind, alternatives):
    rule = next(r for r in secrets.BASE + secrets.ADDED if r.kind == kind)
    assert words(secrets.query_of(rule.pattern)) == by_hand(*alternatives)


@pytest.mark.parametrize("pattern", ["[0-9a-f]+", "ab", "a.b.c", "(abc)?", "abc|x", "(?:abc)*", "(?i)kis", "[^a]bc", r"\d\d\d"])
def test_rules_without_a_mandatory_trigram_scan_everything(pattern):
    assert secrets.queries((secrets.Rule("x", re.compile(pattern)),)) == [None]


@pytest.mark.parametrize(
    ("pattern", "alternatives"),
    [
        ("(?:ab|cd)ef", [["abef"], ["cdef"]]),
        ("abc+d", [["abc"]]),
        ("(abc){2}", [["abcabc"]]),
        (r"abc\d+xyz", [["abc", "xyz"]]),
        (r"^abc(?=d)\b", [["abc"]]),
        ("(?i:ABD)e", [["abde"]]),
        ("a[bc]d|abd", [["abd"], ["acd"]]),
    ],
)
def test_queries_of_other_patterns(pattern, alternatives):
    assert words(secrets.query_of(re.compile(pattern))) == by_hand(*alternatives)


def some_pattern(rnd, depth=0):
    kind = rnd.random()
    if depth > 2 or kind < 0.5:
        return "".join(rnd.choice("abcXk_é") for _ in range(rnd.randint(1, 4)))
    inner = some_pattern(rnd, depth + 1)
    if kind < 0.6:
        return f"(?:{inner}|{some_pattern(rnd, depth + 1)})"
    if kind < 0.7:
        return f"(?:{inner}){rnd.choice(['?', '*', '+', '{2}', '{1,3}', '+?', '{2,}'])}"
    if kind < 0.8:
        return f"[{rnd.choice(['ab', 'a-c', '^a', 'Xk'])}]{inner}"
    return inner + rnd.choice([".", r"\b", r"\w*", ""]) + some_pattern(rnd, depth + 1)


@pytest.mark.parametrize("flags", [0, re.IGNORECASE, re.IGNORECASE | re.ASCII])
def test_random_patterns_lose_no_match(flags):
    rnd, hits = random.Random(flags), 0
    for _ in range(300):
        rule = secrets.Rule("x", re.compile(some_pattern(rnd), flags))
        texts = ["".join(rnd.choice("abcABCxXkK_éK ") for _ in range(rnd.randint(0, 40))) for _ in range(60)]
        (query,) = secrets.queries((rule,))
        matching = {i for i, t in enumerate(texts) if rule.pattern.search(t)}
        hits += len(matching)
        if query is not None:
            data, offsets = flat(pa.array(texts))
            index = secrets.postings(data, offsets, np.array(sorted(frozenset().union(*query)), np.int32))
            assert matching <= set(secrets.candidates(index, query, len(texts)).tolist()), rule.pattern.pattern
    assert hits > 1000


def test_rules_are_scanned_in_full_without_a_parser(monkeypatch):
    monkeypatch.setattr(secrets, "_PARSER", None)
    assert secrets.queries(secrets.BASE + secrets.ADDED) == [None] * len(secrets.BASE + secrets.ADDED)
