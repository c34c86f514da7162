"""Secret scans: a trigram index says which texts a rule can match; only those are verified with its regex.

A Boolean trigram query (an OR of ANDs) is derived from the parse of each rule's regex: strings that a part of it can match
exactly are joined along sequences and multiplied over alternatives, short repeats and small classes; where a part is open,
the trigrams of what stands before it are mandatory. For each block of texts an inverted index is built in numpy: the texts' trigrams (ASCII letters folded) are looked up
among those that any query names, giving a posting list of texts for each; a rule's candidates are the union of the
intersections. A rule without a mandatory trigram scans every text.

Defined results: a null or empty text has no spans; its digest is that of the empty string. Matches are leftmost and do
not overlap within a kind; those that fail the kind's check are dropped after matching. Offsets are code points, end
exclusive. Repeated rows are scanned alike. Columns beside id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewell.llm.common import flat, groups, table

#: Python's own parser of regexes, which has no public name; without it every rule is sought in all of every text.
_PARSER = getattr(re, "_parser", None)
#: Texts are indexed in blocks of about this many bytes, one text at least.
BLOCK = 1 << 20
PIECE = 1 << 20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of the pattern that pass the check."""

    kind: str
    pattern: re.Pattern
    check: Callable[[re.Match], bool] = field(default=lambda m: True)


#: The base rules, in the order in which ties are listed.
BASE = (
    Rule(
        "assign",
        re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII),
        lambda m: len(m[2]) >= 8,
    ),
    Rule("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    Rule("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
)
#: Kinds that the method adds to the base ones.
ADDED = (
    Rule("pem", re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")),
    Rule("github", re.compile(r"gh[pousr]_[A-Za-z0-9]{36}")),
    Rule("slack", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}")),
    Rule("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    Rule("google", re.compile(r"AIza[A-Za-z0-9_-]{35}")),
)
#: Most strings, and most alternatives of a query, that are kept for a part of a regex; a query of more is weakened.
MOST_STRINGS, MOST_ALTERNATIVES = 64, 64
#: Letters that match others than their own two cases where case is ignored beyond ASCII.
_ODD_CASES = frozenset("iksIKS")

Query = frozenset[frozenset[int]]
#: The query that every text fits: one alternative without a trigram.
ANY: Query = frozenset([frozenset()])


def trigrams(literal: str) -> frozenset[int]:
    raw = "".join(c.lower() if c.isascii() else c for c in literal).encode()
    return frozenset(raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2] for i in range(len(raw) - 2))


def least(query: Query) -> Query:
    """Without the alternatives that ask for more than another; any text if too many are left."""
    kept = frozenset(a for a in query if not any(b < a for b in query))
    return kept if len(kept) <= MOST_ALTERNATIVES else ANY


def both(a: Query, b: Query) -> Query:
    """What must fit both; if that has too many alternatives, the one that has fewer."""
    if len(a) * len(b) > MOST_ALTERNATIVES:
        return min(a, b, key=lambda q: (q == ANY, len(q)))
    return least(frozenset(x | y for x in a for y in b))


@dataclass(frozen=True)
class Part:
    """What is known of a part of a regex: all strings that it matches, or None, and a query that its matches fit."""

    strings: frozenset[str] | None
    query: Query

    def open(self) -> Part:
        """The part as one whose strings are not known."""
        return self if self.strings is None else Part(None, least(frozenset(map(trigrams, self.strings))))


NOTHING, UNKNOWN = Part(frozenset([""]), ANY), Part(None, ANY)


def one_of(strings: frozenset[str] | set[str]) -> Part:
    return Part(frozenset(strings), ANY) if 0 < len(strings) <= MOST_STRINGS else UNKNOWN


def sequence(parts: list[Part]) -> Part:
    """Parts one after the other. Strings run on over neighbours until one of them is open."""
    run, query, closed = frozenset([""]), ANY, True
    for part in parts:
        if part.strings is not None and len(run) * len(part.strings) <= MOST_STRINGS:
            run = frozenset(a + b for a in run for b in part.strings)
            continue
        query, closed = both(query, Part(run, ANY).open().query), False
        run = part.strings if part.strings is not None else frozenset([""])
        query = both(query, part.query)
    return Part(run, query) if closed else Part(None, both(query, Part(run, ANY).open().query))


def either(parts: list[Part]) -> Part:
    """Alternatives."""
    if all(p.strings is not None for p in parts):
        strings = frozenset().union(*(p.strings for p in parts))
        if len(strings) <= MOST_STRINGS:
            return Part(strings, ANY)
    return Part(None, least(frozenset().union(*(p.open().query for p in parts))))


def repeated(part: Part, low: int, high: int) -> list[Part]:
    """Parts for a repeat; beyond the copies that it has at least it is open."""
    if part.strings is not None and high <= 4 and len(part.strings) ** high <= MOST_STRINGS:
        return [either([sequence([part] * n) for n in range(low, high + 1)])]
    if part.strings is not None and len(part.strings) == 1:
        return [part] * min(low, 8) + [UNKNOWN]
    return [part.open() if low else UNKNOWN]


def literal(code: int, flags: int) -> Part:
    c = chr(code)
    if flags & re.IGNORECASE and not (c.isascii() and (flags & re.ASCII or c not in _ODD_CASES)) or 0xD800 <= code < 0xE000:
        return UNKNOWN
    return one_of({c.lower() if c.isascii() else c})


def parsed(items, flags: int) -> Part:
    """What is known of a sequence of the regex's parse; kinds of items that aren't listed here are open."""
    parts = []
    for op, value in items:
        kind = str(op)
        if kind == "LITERAL":
            parts.append(literal(value, flags))
        elif kind == "IN" and all(str(k) in ("LITERAL", "RANGE") for k, _ in value):
            codes = {c for k, v in value for c in (range(v[0], min(v[1], v[0] + 256) + 1) if str(k) == "RANGE" else [v])}
            parts.append(either([literal(c, flags) for c in codes]) if len(codes) <= MOST_STRINGS else UNKNOWN)
        elif kind == "BRANCH":
            parts.append(either([parsed(x, flags) for x in value[1]]))
        elif kind == "SUBPATTERN":
            parts.append(parsed(value[3], (flags | value[1]) & ~value[2]))
        elif kind == "ATOMIC_GROUP":
            parts.append(parsed(value, flags))
        elif kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            parts += repeated(parsed(value[2], flags), value[0], value[1])
        elif kind in ("AT", "ASSERT", "ASSERT_NOT"):  # they take no characters
            parts.append(NOTHING)
        else:
            parts.append(UNKNOWN)
    return sequence(parts)


def query_of(pattern: re.Pattern) -> Query:
    """A query that each text with a match of the pattern fits."""
    if _PARSER is None:
        return ANY
    return parsed(_PARSER.parse(pattern.pattern, pattern.flags), pattern.flags).open().query


def queries(rules: tuple[Rule, ...]) -> list[list[frozenset[int]] | None]:
    """For each rule its alternatives as sets of trigrams; None if one of them has no trigram."""
    derived = [sorted(query_of(rule.pattern), key=sorted) for rule in rules]
    return [sets if all(sets) else None for sets in derived]


def postings(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> dict[int, np.ndarray]:
    """Texts that hold each wanted trigram, ascending. ``wanted`` is sorted."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    heads = np.zeros(256, bool)
    heads[wanted >> 16] = True
    for begin in range(0, max(0, len(data) - 2), PIECE):
        part = _FOLD[data[begin : begin + PIECE + 2]]
        at = np.flatnonzero(heads[part[:-2]])
        codes = part[at].astype(np.int32) << 16 | part[at + 1].astype(np.int32) << 8 | part[at + 2]
        k = np.minimum(np.searchsorted(wanted, codes), len(wanted) - 1)
        hit = wanted[k] == codes
        at = at[hit] + begin
        text = np.searchsorted(offsets, at, side="right") - 1
        inside = at + 3 <= offsets[text + 1]
        found.append(np.unique(np.stack([k[hit][inside], text[inside]]), axis=1))
    if not found:
        return {}
    pairs = np.unique(np.concatenate(found, axis=1), axis=1)
    cuts = np.flatnonzero(np.diff(pairs[0])) + 1
    return {int(wanted[x[0][0]]): x[1] for x in np.split(pairs, cuts, axis=1) if x.shape[1]}


def candidates(index: dict[int, np.ndarray], query: list[frozenset[int]], n: int) -> np.ndarray:
    """Texts that fit a Boolean query: the union of its alternatives, each the intersection of posting lists."""
    marks = np.zeros(n, bool)
    for alternative in query:
        lists = [index.get(t) for t in alternative]
        if any(x is None for x in lists):
            continue
        lists.sort(key=len)
        left = lists[0]
        for x in lists[1:]:
            left = left[np.isin(left, x, assume_unique=True)]
        marks[left] = True
    return np.flatnonzero(marks)


def spans_of(text: str, rule: Rule) -> list[tuple[int, int]]:
    return [m.span() for m in rule.pattern.finditer(text) if rule.check(m)]


def joined(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in sorted(spans))


def scanner(base: tuple[Rule, ...], added: tuple[Rule, ...], block: int = BLOCK) -> Callable:
    rules = base + added

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans = queries(rules)
        wanted = np.array(sorted(frozenset().union(*(t for q in plans if q for t in q))), np.int32)
        names = ["doc_id", *(f"n_{r.kind}" for r in base), "base_sha256", "spans"]
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for first, last in groups(offsets, block):
                begin, n = offsets[first], last - first
                part, own = data[begin : offsets[last]], offsets[first : last + 1] - begin
                index = postings(part, own, wanted) if len(wanted) else {}
                raw, texts = part.tobytes(), {}
                spans: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
                for k, (rule, query) in enumerate(zip(rules, plans, strict=True)):
                    for i in range(n) if query is None else candidates(index, query, n).tolist():
                        if i not in texts:
                            texts[i] = raw[own[i] : own[i + 1]].decode("utf-8", "replace")
                        spans[i] += [(a, k, b) for a, b in spans_of(texts[i], rule)]
                firsts = [[x for x in s if x[1] < len(base)] for s in spans]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n),
                        *(pa.array([sum(x[1] == k for x in s) for s in firsts], pa.int64()) for k in range(len(base))),
                        pa.array([hashlib.sha256(joined(s, rules).encode()).hexdigest() for s in firsts]),
                        pa.array([joined(s, rules) for s in spans]),
                    ],
                    names,
                )

    return scan


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", base: tuple[Rule, ...] = BASE, added: tuple[Rule, ...] = ADDED) -> DataFrame:
    """For each row the matches of each base kind, a digest of them, and all spans."""
    counts = "".join(f"n_{r.kind} long, " for r in base)
    rows = docs.selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"`{text}` as text")
    return rows.mapInArrow(scanner(base, added), f"doc_id long, {counts}base_sha256 string, spans string")


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
