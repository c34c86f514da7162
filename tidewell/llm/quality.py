"""Quality rules: repetition coverage by rolling hashes of several n-gram lengths, measured in numpy.

For each n of ``COVERAGE`` the characters of words inside n-word windows found twice or more in the text are measured
(first occurrences included), and those of lines that repeat an earlier line. A text with too high a share is not kept.
A duplicated window of n + 1 words holds duplicated windows of n words, so longer lengths are hashed only where the
shorter one has found a repeat.

Defined results: a null or empty text has no words, so all counts are 0 and it fails the base rules. Repeated rows are
judged alike. Columns beside id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewell.llm.common import WORD_SPACE, flat, groups, ngram_hashes, table, word_table

BASE_WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
#: Highest share, in percent, of a text's word characters inside duplicated windows of n words.
COVERAGE = {5: 20, 6: 18, 7: 16, 8: 14, 9: 12, 10: 10}
#: Highest share, in percent, of word characters in lines that repeat an earlier line.
DUP_LINE_CHARS = 20
_SYMBOLS = b"#*$%&|<>"
_NOT_WORD_CHARS = WORD_SPACE + bytes(range(0x80, 0xC0))
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, kept boolean, dup_line_chars long, max_ngram_percent double"
)


def covered(hashes: np.ndarray, n: int, n_words: int) -> np.ndarray | None:
    """Which words lie in a window whose hash is found twice or more; None if no window is."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return None
    twice = np.zeros(len(hashes), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n_words + 1, np.int32)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def line_repeats(raw: bytes) -> tuple[int, int]:
    """(lines with a word that are equal to an earlier line, their word characters)."""
    lines = [x for x in raw.split(b"\n") if x.strip(WORD_SPACE)]
    if len(set(lines)) == len(lines):
        return 0, 0
    seen, again, chars = set(), 0, 0
    for x in lines:
        if x in seen:
            again += 1
            chars += len(x.translate(None, _NOT_WORD_CHARS))
        seen.add(x)
    return again, chars


def measure(raw: bytes, words: np.ndarray, sizes: np.ndarray) -> tuple:
    """The figures of one text; ``words`` and ``sizes`` are its word hashes and their code points."""
    n_words, word_chars = len(words), len(raw.translate(None, _NOT_WORD_CHARS))
    n_symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    dup_lines, dup_chars = line_repeats(raw)
    repeat_words, most, good = 0, 0.0, True
    for n, percent in COVERAGE.items():
        if n_words <= n or (mark := covered(ngram_hashes(words, n), n, n_words)) is None:
            break
        if n == BASE_WINDOW:
            repeat_words = int(mark.sum())
        inside = int(sizes[mark].sum())
        most = max(most, 100 * inside / word_chars)
        good &= 100 * inside <= percent * word_chars
    good &= 100 * dup_chars <= DUP_LINE_CHARS * word_chars
    failed = n_words < MIN_WORDS or 100 * repeat_words > MAX_REPEATED_PERCENT * n_words
    return n_words, word_chars, n_symbols, dup_lines, repeat_words, failed, good and not failed, dup_chars, most


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(",")]
    for batch in batches:
        data, offsets = flat(batch.column(1))
        for first, last in groups(offsets):
            begin = offsets[first]
            part, own = data[begin : offsets[last]], offsets[first : last + 1] - begin
            words, sizes, index = word_table(part, own, lower=False)
            raw = part.tobytes()
            rows = [
                measure(raw[own[i] : own[i + 1]], words[index[i] : index[i + 1]], sizes[index[i] : index[i + 1]])
                for i in range(last - first)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *map(pa.array, zip(*rows, strict=True))], names)


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row of figures and the verdict for each row of ``docs``."""
    return docs.selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"`{text}` as text").mapInArrow(_measure, SCHEMA)


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


def _coverage_sql() -> str:
    return ", ".join(f"({n}, {percent})" for n, percent in COVERAGE.items())


OP2_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
w AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
limits(n, percent) AS (VALUES {_coverage_sql()}),
g AS (SELECT doc_id, n, percent, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram FROM (SELECT doc_id, w, n, percent, unnest(range(1, len(w) - n + 2)) AS i FROM d, limits WHERE len(w) >= n)),
r AS (SELECT doc_id, n, percent, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, n, gram) > 1),
c AS (SELECT DISTINCT doc_id, n, percent, unnest(range(i, i + n)) AS i FROM r),
s AS (SELECT c.doc_id, n, percent, count(*) AS words, sum(length(word)) AS inside FROM c JOIN w ON c.doc_id = w.doc_id AND c.i = w.i GROUP BY ALL),
l AS (SELECT doc_id, line, count(*) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
x AS (SELECT doc_id, sum(k - 1) AS n_dup_lines, sum((k - 1) * length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS dup_line_chars FROM l GROUP BY doc_id),
b AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
a AS (SELECT b.*, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(dup_line_chars, 0) AS dup_line_chars, coalesce(max(s.words) FILTER (WHERE n = {BASE_WINDOW}), 0) AS n_repeat_words, coalesce(max(100 * inside / word_chars), 0) AS max_ngram_percent, coalesce(bool_or(100 * inside > percent * word_chars), false) AS much
      FROM b LEFT JOIN x USING (doc_id) LEFT JOIN s USING (doc_id) GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words) AND NOT much AND 100 * dup_line_chars <= {DUP_LINE_CHARS} * word_chars AS kept, dup_line_chars::BIGINT AS dup_line_chars, max_ngram_percent FROM a
"""
