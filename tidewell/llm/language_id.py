"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams by language in one aggregation, over a sample of labelled rows whose bound is a
parameter. The log-probability matrix is broadcast, in blocks of languages; a batch of texts is one sparse matrix (row,
bucket, count), and its product with a block's log-probabilities scores all of them at once in numpy. A text's best language
and the sum of its probabilities go from block to block, so that the number of blocks changes nothing. The matrix grows with
the languages that are learned, 128 KiB each, and never with the rows.

Defined results: a null text, or one without a letter, is ``und`` with score 0. A null ``lang`` is never learned
from. Without any training row every text is ``und``. Repeated rows are judged alike; ties go to the language that
sorts first. Columns beside id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import materialise, table

BITS = 15
ORDERS = (1, 2, 3)
#: Rows learned from are sampled by a hash of all their columns once there are more than this many labelled rows.
TRAIN_ROWS = 20_000
#: Languages of a block of the matrix: 64 MiB of log-probabilities.
LANGUAGES = 512
#: Characters of texts that are counted at a time, and entries of the product that are held at a time.
BLOCK, ENTRIES = 1 << 17, 1 << 20
#: Texts whose scores are held at a time.
TEXTS = 1024
UNDETERMINED = "und"
#: Languages of a block, their log-probabilities by bucket and language, their log prior.
Part = tuple[list[str], np.ndarray, np.ndarray]
_LETTER = regex.compile(r"\p{L}")
_FACTORS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))


def pieces(texts: list[str]) -> Iterator[tuple[list[int], list[str], list[int]]]:
    """(texts' numbers, strings, own lengths), about BLOCK characters at a time.

    A long text comes in several strings; each goes on for the n-grams that begin within its own length.
    """
    number, strings, own, size = [], [], [], 0
    for k, text in enumerate(texts):
        text = text.lower()
        for begin in range(0, len(text), BLOCK):
            number.append(k)
            strings.append(text[begin : begin + BLOCK + max(ORDERS) - 1])
            own.append(min(BLOCK, len(text) - begin))
            size += own[-1]
            if size >= BLOCK:
                yield number, strings, own
                number, strings, own, size = [], [], [], 0
    if strings:
        yield number, strings, own


def bucket_matrix(texts: list[str], bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, bucket, count) of the lower-cased texts' n-grams by hash bucket, in order of row and bucket.

    Entries of a long text may come in several parts.
    """
    for number, strings, own in pieces(texts):
        points = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(x) for x in strings])
        piece = np.repeat(np.arange(len(strings)), lengths)
        ends, place = np.cumsum(lengths), np.arange(len(points))
        begins = place < (ends - lengths + np.array(own))[piece]
        keys = []
        for n in ORDERS:
            m = max(0, len(points) - n + 1)
            h = points[:m] * _FACTORS[0] + np.uint32(n * 0x27D4EB2F & 0xFFFFFFFF)
            for j in range(1, n):
                h = (h ^ (h >> np.uint32(15))) * _FACTORS[1] + points[j : j + m] * _FACTORS[2]
            h ^= h >> np.uint32(13)
            h *= _FACTORS[0]
            inside = begins[:m] & (place[:m] + n <= ends[piece[:m]])
            keys.append(piece[:m][inside] << bits | (h[inside] >> np.uint32(32 - bits)).astype(np.int64))
        keys = np.sort(np.concatenate(keys))
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        yield np.array(number)[keys[first] >> bits], keys[first] & ((1 << bits) - 1), np.diff(np.append(first, len(keys)))


def has_letter(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    for batch in batches:
        own = [(t, x) for t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if has_letter(t)]
        for lang in {x for _, x in own}:
            texts = [t for t, x in own if x == lang]
            rows[lang] = rows.get(lang, 0) + len(texts)
            for _, bucket, n in bucket_matrix(texts):
                sums[lang] = sums.get(lang, 0) + np.bincount(bucket, n, 1 << BITS).astype(np.int64)
    for lang, counts in sums.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(counts[at], rows[lang]))],
            ["lang", "bucket", "n"],
        )


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", train_rows: int = TRAIN_ROWS) -> list[Part]:
    """Blocks of languages, in order, learned from all given rows; none without any.

    Beyond ``train_rows`` rows, those whose hash falls under the fraction that leaves about as many are taken.
    """
    rows = rows.filter(F.col(lang).isNotNull())
    total = rows.count()
    if total > train_rows:
        share = int(train_rows / total * (1 << 31))
        rows = rows.filter(F.pmod(F.xxhash64(*[F.col(c) for c, t in rows.dtypes if "map<" not in t]), F.lit(1 << 31)) < share)
    counted = rows.select(F.col(text), F.col(lang)).mapInArrow(_count, "lang string, bucket int, n long")
    counted = materialise(counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "counts")
    seen = {r["lang"]: r["n"] for r in counted.filter("bucket < 0").collect()}
    every, learned = sorted(seen), max(sum(seen.values()), 1)
    return [_part(counted, every[k : k + LANGUAGES], seen, learned) for k in range(0, len(every), LANGUAGES)]


def _part(counted: DataFrame, langs: list[str], seen: dict[str, int], learned: int) -> Part:
    counts = counted.filter((F.col("bucket") >= 0) & F.col("lang").isin(langs)).toPandas()
    matrix = np.full((1 << BITS, len(langs)), 0.5)
    number = counts["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)
    np.add.at(matrix, (counts["bucket"].to_numpy(np.int64), number), counts["n"].to_numpy(np.int64))
    logs = np.log(matrix) - np.log(matrix.sum(axis=0, keepdims=True))
    return langs, logs.astype(np.float32), np.log(np.array([max(seen[x], 1) for x in langs], np.float64) / learned)


def judge(texts: list[str | None], parts: list[Part]) -> tuple[list[str], np.ndarray]:
    """The most probable language of each text and its posterior probability."""
    said, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    known = [k for k, t in enumerate(texts) if parts and has_letter(t)]
    for first in range(0, len(known), TEXTS):
        own = known[first : first + TEXTS]
        score[own], names = _judged([texts[k] for k in own], parts)
        for k, name in zip(own, names, strict=True):
            said[k] = name
    return said, score


def _judged(texts: list[str], parts: list[Part]) -> tuple[np.ndarray, np.ndarray]:
    """(posterior probability, language) of texts with a letter; entries of the sparse matrix are dropped as they are used."""
    points = [np.tile(prior, (len(texts), 1)) for _, _, prior in parts]
    for row, bucket, n in bucket_matrix(texts):
        for (langs, logs, _), own_points in zip(parts, points, strict=True):
            step = max(1, ENTRIES // len(langs))
            for k in range(0, len(row), step):
                own = slice(k, k + step)
                first = np.flatnonzero(np.append(True, row[own][1:] != row[own][:-1]))
                own_points[row[own][first]] += np.add.reduceat(n[own, None] * logs[bucket[own]].astype(np.float64), first)
    best, total, names = np.full(len(texts), -np.inf), np.full(len(texts), -np.inf), np.full(len(texts), UNDETERMINED, object)
    for (langs, _, _), own_points in zip(parts, points, strict=True):
        top = own_points.argmax(axis=1)
        most = own_points[np.arange(len(texts)), top]
        total = np.logaddexp(total, most + np.log(np.exp(own_points - most[:, None]).sum(axis=1)))
        better = most > best
        best, names = np.where(better, most, best), np.where(better, np.array(langs, object)[top], names)
    return np.minimum(np.exp(best - total), 1), names


def scorer(shared: list) -> Callable[[Iterator[pd.Series]], Iterator[pd.DataFrame]]:
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        parts = [x.value for x in shared]
        for texts in batches:
            said, points = judge(texts.tolist(), parts)
            yield pd.DataFrame({"lang_pred": said, "score": points})

    return score


def judgement(spark, model: list[Part], text: str = "text") -> F.Column:
    """A struct of the predicted language and its score."""
    shared = [spark.sparkContext.broadcast(part) for part in model]
    return F.pandas_udf(_typed(scorer(shared)), "lang_pred string, score double")(F.col(text))


def predict(rows: DataFrame, model: list[Part], text: str = "text") -> DataFrame:
    """``rows`` with columns ``lang_pred`` and ``score``, which replace any of these names."""
    others = [c for c in rows.columns if c not in ("lang_pred", "score", "__said")]
    made = rows.select(*others, judgement(rows.sparkSession, model, text).alias("__said"))
    return made.select(*others, F.col("__said.lang_pred").alias("lang_pred"), F.col("__said.score").alias("score"))


def _typed(f: Callable) -> Callable:
    f.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return f


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows of the fold that nothing is learned from: crc32 of the id as text, modulo 5, is 0. A null id is in no fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows whose language is determined, with their columns as they were."""
    model = fit(docs.filter(~held_out(doc_id)), text, lang)
    return docs.filter(judgement(docs.sparkSession, model, text).getField("lang_pred") != UNDETERMINED)
