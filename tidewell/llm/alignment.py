"""Alignment of two tokenizers' tokens of one text, with corpus-wide counts of the tokens that end together.

Both token streams spell the same bytes. A transducer reads them as in deciding whether a code has two readings: its state is
which stream leads and the bytes by which it leads (the dangling suffix). The next token always comes from the stream behind;
it eats from the residual, or the lead changes. An empty residual closes a group. Transitions depend on the residual and
the token alone, so they are memoised and reused for the whole corpus.

Where both tokenizers cut a text (before a space or a line feed that follows something else than white space) both streams have
spelled the same bytes, so the transducer is back at its start: a run over the stretch between two such places is one more
transition, from start to start, which yields its groups and depends on the stretch alone. It is memoised too, with what its
groups are written as and their links, so frequent stretches are encoded and aligned once. Texts with a stretch that a side
can't spell, and those of vocabularies that can't be cut, are read as a whole.

Where a group closes, its last tokens on both sides end together and are a link. Links are counted over the corpus; of two
tokens that end together one is a suffix of the other, so there are at most as many pairs as the entries of both vocabularies
have suffixes (some 500,000), and the table of counts is small whatever the corpus: that bound is checked when it is built.
A document's links wait as (pair, times) in a written table, and are looked up in the counts once these are known.

Defined results: a text that is null, empty or that a side can't spell again byte by byte has no tokens: zeros and an empty
``groups_sha256``. Special tokens' strings are plain text. Rows of equal id are rows of their own; an empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator, Sequence
from contextlib import suppress
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import groups, materialise, table
from tidewell.llm.tokens import _SPACED, _WHITE, _Cache, byte_letters, encoder

#: Memoised transitions, dropped when there are so many.
TRANSITIONS = 2_000_000
#: Memoised stretches, dropped when there are so many (but for those of one document), and how long one may be to be kept.
STRETCHES, LONGEST = 500_000, 64
#: Pairs of documents that are held at a time, but for those of one document.
HELD = 1 << 18
#: What stands for a space in pieces.
MARK = "▁"
_CHUNKS = re.compile(r" +[^ \n]*|\n[^ \n]*|[^ \n]+")
_STRETCHES = re.compile(rf"[{_WHITE}]+[^{_WHITE}]*(?:(?![ \n])[{_WHITE}]+[^{_WHITE}]*)*")
#: What a run of the transducer yields: its groups as written, its links as 64-bit integers, how many ids of A << 31 | of B.
Run = tuple[str, bytes, int]
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>"
COUNTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class State(dict):
    """A residual and the stream that leads by it; maps the next token of the stream behind to the state it leads to."""

    __slots__ = ("a_leads", "machine", "residual")

    def __init__(self, machine: Transducer, a_leads: bool, residual: bytes):
        super().__init__()
        self.machine, self.a_leads, self.residual = machine, a_leads, residual

    def __missing__(self, token: int) -> State:
        return self.machine.follow(self, token)


class Transducer:
    """Aligns tokens of two vocabularies, each given as the bytes of its tokens."""

    def __init__(self, a_bytes: Sequence[bytes], b_bytes: Sequence[bytes]):
        self.a_bytes, self.b_bytes = a_bytes, b_bytes
        self.clear()

    def clear(self) -> None:
        self.states: dict[tuple[bool, bytes], State] = {}
        self.size = 0
        self.start = self.states[False, b""] = State(self, False, b"")

    def state(self, a_leads: bool, residual: bytes) -> State:
        key = (a_leads, residual) if residual else (False, b"")
        if key not in self.states:
            self.states[key] = State(self, *key)
        return self.states[key]

    def follow(self, state: State, token: int) -> State:
        """The state after a token of the stream behind; of A where nothing dangles."""
        new = (self.b_bytes if state.a_leads else self.a_bytes)[token]
        old = state.residual
        if old.startswith(new):
            after = self.state(state.a_leads, old[len(new) :])
        elif new.startswith(old):
            after = self.state(not state.a_leads, new[len(old) :])
        else:
            raise ValueError("the streams spell different bytes")
        state[token] = after
        self.size += 1
        return after

    def groups(self, a: Sequence[int], b: Sequence[int]) -> tuple[list[int], list[int]]:
        """How many tokens of A and of B have been read at the end of each group; ValueError if they spell different bytes."""
        if self.size > TRANSITIONS:
            self.clear()
        start = self.start
        i = j = 0
        a_ends, b_ends = [], []
        n = len(a)
        try:
            while i < n:
                state = start[a[i]][b[j]]
                i += 1
                j += 1
                while state is not start:
                    if state.a_leads:
                        state = state[b[j]]
                        j += 1
                    else:
                        state = state[a[i]]
                        i += 1
                a_ends.append(i)
                b_ends.append(j)
        except IndexError:
            raise ValueError("one stream ends before the other") from None
        if j < len(b):
            raise ValueError("one stream ends before the other")
        return a_ends, b_ends


class Pieces:
    """Ids of a sentencepiece model, with a bounded cache by chunk.

    Where no piece has a space after another letter, nor a line feed, tokens can't cross into a run of spaces or over a line
    feed, so a chunk has the same ids alone and in its text. Models of other make are given whole texts.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.space = [self.model.piece_to_id(MARK)]
        plain = [p for i, p in enumerate(pieces) if not self.model.is_byte(i)]
        feed = self._ids("\n")
        self.cut = not any("\n" in p or MARK in p.lstrip(MARK) for p in plain) and feed[:1] == self.space and len(feed) == 2 and self._ids("a")[:1] != self.space
        self.cache = _Cache(self._chunk)

    def _ids(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)

    def _chunk(self, chunk: str) -> bytes:
        """The model adds a space: it stands for the chunk's first space, or goes again before a line feed."""
        own = self.space if chunk == " " else self._ids(chunk[1:]) if chunk[0] == " " else self._ids(chunk)[1:]
        return array("I", own).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a space and the text, little-endian unsigned 32-bit."""
        if not self.cut or MARK in text:
            return np.array(self._ids(text), "<u4").tobytes()
        return b"".join(map(self.cache.__getitem__, _CHUNKS.findall(" " + text)))


def byte_level_tokens(path: str) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    back = {c: b for b, c in byte_letters().items()}
    vocabulary = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    out = [b""] * (max(vocabulary.values()) + 1)
    for word, i in vocabulary.items():
        out[i] = bytes(back[c] for c in word) if all(c in back for c in word) else word.encode()
    return out


class Aligner:
    """Both encoders and their transducer; one for each Python worker."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        self.a, self.b = encoder(a_path), Pieces(b_path)
        self.a_bytes, self.b_bytes = byte_level_tokens(a_path), self.b.bytes
        self.a_sizes = np.array([len(x) for x in self.a_bytes], np.int64)
        self.transducer = Transducer(self.a_bytes, self.b_bytes)
        self.cut = self.a.pattern is _SPACED and self.b.cut
        self.known: dict[str, Run] = {}

    def _runs(self, stretches: list[str], a: bytes, b: bytes) -> list[Run]:
        """The transducer's runs over stretches that follow each other; ValueError if a side spells other bytes.

        B is held against the text, and A against B by the transducer.
        """
        a, b = (np.frombuffer(x, "<u4") for x in (a, b))
        b_list = b.tolist()
        if b"".join(map(self.b_bytes.__getitem__, b_list)) != "".join(stretches).encode():
            raise ValueError("B spells other bytes than the text")
        a_ends, b_ends = (np.array(x, np.int64) for x in self.transducer.groups(a.tolist(), b_list))
        links = (a[a_ends - 1].astype(np.int64) << 32 | b[b_ends - 1].astype(np.int64)).tobytes()
        written = groups_written(a, b, a_ends, b_ends)
        closed, ends = np.cumsum(self.a_sizes[a])[a_ends - 1], np.cumsum([len(x.encode()) for x in stretches])
        last = np.searchsorted(closed, ends)
        if (closed[last] != ends).any():
            raise ValueError("a group crosses the end of a stretch")
        out, i, j, k = [], 0, 0, 0
        for p, q, n in zip(a_ends[last].tolist(), b_ends[last].tolist(), (last + 1).tolist(), strict=True):
            out.append(("".join(written[i + j : p + q]), links[8 * k : 8 * n], p - i << 31 | q - j))
            i, j, k = p, q, n
        return out

    def _stretches(self, text: str) -> list[Run]:
        """Runs over a text's stretches; those that are not known are encoded and run over together, as no token joins them."""
        stretches = _STRETCHES.findall(text)
        runs = [*map(self.known.get, stretches)]
        new = [*dict.fromkeys([x for x, run in zip(stretches, runs, strict=True) if run is None])]
        if new:
            joined = "".join(new)
            made = dict(zip(new, self._runs(new, self.a._plain(joined), self.b._chunk(joined)), strict=True))
            runs = [made[x] if run is None else run for x, run in zip(stretches, runs, strict=True)]
            if len(self.known) + len(made) > STRETCHES:
                self.known.clear()
            self.known.update(made if len(max(new, key=len)) <= LONGEST else {x: run for x, run in made.items() if len(x) <= LONGEST})
        return runs

    def align(self, text: str | None) -> tuple[int, int, str, np.ndarray]:
        """How many ids A and B have, what the groups are written as, and their links (A's id << 32 | B's); none where a side
        doesn't spell the space and the text."""
        none = 0, 0, "", np.zeros(0, np.int64)
        if not text:
            return none
        runs = []
        if self.cut and MARK not in text:
            with suppress(ValueError):  # the text is read as a whole, which settles it
                runs = self._stretches(" " + text)
        try:
            runs = runs or self._runs([" " + text], self.a.encode(" " + text), self.b.encode(text))
        except ValueError:
            return none
        written, links, sizes = zip(*runs, strict=True)
        size = sum(sizes)
        return size >> 31, size & (1 << 31) - 1, "".join(written)[:-1], np.frombuffer(b"".join(links), np.int64)


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


@lru_cache(maxsize=4)
def _written(size: int, separator: str) -> np.ndarray:
    return np.array([f"{i}{separator}" for i in range(size)], object)


def groups_written(a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> list[str]:
    """``a1,a2|b1;a3|b2,b3;`` by its ids: each with what follows it, put in the place that it has in the text."""
    out = np.empty(len(a) + len(b), object)
    for ids, ends, before, last in ((a, a_ends, np.r_[0, b_ends[:-1]], "|"), (b, b_ends, a_ends, ";")):
        size = 1 << 16 if ids.max() < 1 << 16 else int(ids.max()) + 1
        place = np.arange(len(ids)) + np.repeat(before, np.diff(np.r_[0, ends]))
        out[place] = _written(size, ",")[ids]
        out[place[ends - 1]] = _written(size, last)[ids[ends - 1]]
    return out.tolist()


def _align(a_path: str, b_path: str) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(a_path, b_path).align
        names, types = zip(*[(c.split()[0], t) for c, t in zip(ALIGNED.split(", "), [*[pa.int64()] * 4, pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())], strict=True)], strict=True)
        for batch in batches:
            out, size = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if size >= HELD:
                    yield _record(out, names, types)
                    out, size = [], 0
                n_a, n_b, written, found = align(text.as_py())
                digest = hashlib.sha256(written.encode()).hexdigest() if n_a else ""
                links = np.sort(found)
                new = np.flatnonzero(np.r_[True, links[1:] != links[:-1]]) if len(links) else links
                times = np.diff(np.r_[new, len(links)]).astype(np.int32)
                out.append((doc_id, n_a, n_b, len(links), digest, links[new], times))
                size += len(new)
            yield _record(out, names, types)

    return rows


def _record(rows: list[tuple], names: Sequence[str], types: Sequence[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], list(names))


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, cut so that the lists of ``column`` have about HELD entries together, one row at least."""
    for batch in batches:
        offsets = batch.column(column).offsets.to_numpy().astype(np.int64)
        for first, last in groups(offsets, HELD):
            yield batch.slice(first, last - first)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the pairs of a task; a few hundred thousand at most, see ``pair_bound``."""
    held, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in _slices(batches, "pairs"):
        pairs, times = (batch.column(k).flatten().to_numpy().astype(np.int64) for k in (0, 1))
        held, at = np.unique(np.concatenate([held, pairs]), return_inverse=True)
        sums = np.bincount(at, np.concatenate([sums, times]), len(held)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums)], ["pair", "n"])


def pair_bound(a_bytes: Sequence[bytes], b_bytes: Sequence[bytes]) -> int:
    """How many pairs of tokens there are of which one is a suffix of the other."""
    total = 0
    for own, other in ((a_bytes, b_bytes), (b_bytes, a_bytes)):
        ids: dict[bytes, int] = {}
        for x in other:
            ids[x] = ids.get(x, 0) + 1
        total += sum(ids.get(x[k:], 0) for x in own for k in range(len(x)))
    return total


def _scored(known: object) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = known.value
        for batch in _slices(batches, "pairs"):
            pairs, times = batch.column("pairs"), batch.column("times")
            sizes = np.diff(pairs.offsets.to_numpy())
            at = np.searchsorted(pair, pairs.flatten().to_numpy())
            times = times.flatten().to_numpy().astype(np.int64)
            ends = np.cumsum(sizes)
            sums = [np.diff(np.r_[0, np.r_[0, np.cumsum(x)][ends]]) for x in (times, times * best[at], times * n[at])]
            kept = {c: batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")}
            kept |= {c: pa.array(x.astype(np.int64)) for c, x in zip(("n_links", "n_best", "count_sum"), sums, strict=True)}
            names = [c.split()[0] for c in COUNTS.split(", ")]
            yield pa.RecordBatch.from_arrays([kept[c] for c in names], names)

    return rows


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n, best) of each pair of ids that end together anywhere: how often, and whether no A id does so more often with b."""
    counts = aligned.select("pairs", "times").mapInArrow(_summed, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = counts.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"), "n")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: tokens, groups, links, and what the corpus-wide counts say of its links."""
    spark = docs.sparkSession
    source = docs.selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"`{text}` as text")
    aligned = materialise(source.mapInArrow(_align(a_path, b_path), ALIGNED), "aligned")
    bound = pair_bound(byte_level_tokens(a_path), Pieces(b_path).bytes)
    found = pair_counts(aligned).select((F.shiftleft("a", 32).bitwiseOR(F.col("b"))).alias("pair"), "n", F.col("best").cast("long").alias("best")).toArrow()
    if found.num_rows > bound:
        raise RuntimeError(f"more than {bound} pairs of tokens end together")
    pair, n, best = (found.column(c).to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pair)
    known = spark.sparkContext.broadcast((pair[order], n[order], best[order]))
    return aligned.mapInArrow(_scored(known), COUNTS)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
