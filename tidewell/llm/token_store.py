"""Token-ID files: each document's ids compressed alone with a shared zstandard dictionary.

The dictionary is trained on a bounded sample of serialized id arrays. Documents are range-partitioned by id, encoded
in order, and written as Parquet rows of joined frames ("chunks"), each with its documents' ids, frame offsets and
lengths and the dictionary's hash; the dictionary is a table beside them. One document is read by its chunk's id range,
its offset and one small decompression.

Defined results: a null or empty text is the end id alone. Rows of equal id keep one place each, ordered by length and
checksum. Null ids come first. An empty table gives empty files. Columns beside id and text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import new_path, table
from tidewell.llm.tokens import encoder

END_ID = 1
#: At most this many documents, and this many bytes of each, are learned from.
SAMPLE_ROWS, SAMPLE_BYTES = 1_000, 8 << 10
DICTIONARY_BYTES = 64 << 10
#: A chunk is closed once its frames hold this many bytes.
CHUNK_BYTES = 1 << 20
LEVEL = 3
CHUNKS = (
    "part int, chunk int, first_id long, last_id long, before long, n_tokens long, width int, dictionary string,"
    " doc_ids array<long>, offsets array<long>, lengths array<long>, frames binary"
)


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; where there is too little to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def load(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def id_width(vocabulary: str) -> int:
    """Bytes of a serialized id."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(vocabulary).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def serializer(vocabulary: str, end_id: int, width: int) -> Callable[[str | None], bytes]:
    encode, end, kind = encoder(vocabulary).encode, np.array([end_id], "<u4").tobytes(), f"<u{width}"
    return lambda text: np.frombuffer(encode(text) + end, "<u4").astype(kind).tobytes()


def _sampler(vocabulary: str, end_id: int, width: int) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serialize = serializer(vocabulary, end_id, width)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([serialize(t)[:SAMPLE_BYTES] for t in batch.column(0).to_pylist()], pa.binary())], ["ids"])

    return rows


def _writer(vocabulary: str, end_id: int, width: int, raw: bytes, digest: str) -> Callable:
    names = [x.split()[0] for x in CHUNKS.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, serialize = TaskContext.get().partitionId(), serializer(vocabulary, end_id, width)
        known = load(raw)
        compress = (zstandard.ZstdCompressor(level=LEVEL, dict_data=known) if known else zstandard.ZstdCompressor(level=LEVEL)).compress
        before = number = 0
        ids, offsets, lengths, frames, size = [], [], [], [], 0

        def closed() -> pa.RecordBatch:
            known_ids = [x for x in ids if x is not None]
            row = (part, number, min(known_ids, default=None), max(known_ids, default=None), before, sum(lengths), width, digest, ids, offsets, lengths, b"".join(frames))
            types = [pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.int32(), pa.string(), *[pa.list_(pa.int64())] * 3, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = serialize(text.as_py())
                frame = compress(data)
                ids.append(doc_id)
                offsets.append(size)
                lengths.append(len(data) // width)
                frames.append(frame)
                size += len(frame)
                if size >= CHUNK_BYTES:
                    yield closed()
                    before, number = before + sum(lengths), number + 1
                    ids, offsets, lengths, frames, size = [], [], [], [], 0
        if ids:
            yield closed()

    return rows


def _reader(raw: bytes, digest: str) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.to_pylist():
                out, start = [], chunk["before"]
                for doc_id, data in zip(chunk["doc_ids"], documents(chunk, raw, digest), strict=True):
                    out.append((doc_id, chunk["part"], start, len(data), zlib.crc32(data.astype("<u4").tobytes())))
                    start += len(data)
                columns = zip(*out, strict=True) if out else [[]] * 5
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "part", "inner", "n_tokens", "ids_crc32"])

    return rows


def documents(chunk: dict, raw: bytes, digest: str, wanted: int | None = None) -> Iterator[np.ndarray]:
    """Ids of each document of a chunk, or of those with the id ``wanted``, each decompressed alone."""
    if chunk["dictionary"] != digest:
        raise ValueError(f"the chunk needs dictionary {chunk['dictionary']}, not {digest}")
    known = load(raw)
    reader = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    ends = [*chunk["offsets"][1:], len(chunk["frames"])]
    for doc_id, begin, end in zip(chunk["doc_ids"], chunk["offsets"], ends, strict=True):
        if wanted is None or doc_id == wanted:
            yield np.frombuffer(reader.decompress(chunk["frames"][begin:end]), f"<u{chunk['width']}")


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes ``path``/chunks and ``path``/dictionary."""
    spark = docs.sparkSession
    source = docs.selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"`{text}` as text")
    width, total = id_width(vocabulary), source.count()
    share = int(min(1.0, SAMPLE_ROWS / max(total, 1)) * (1 << 31))
    sample = source.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) <= share).select("text")
    samples = sample.mapInArrow(_sampler(vocabulary, end_id, width), "ids binary").limit(2 * SAMPLE_ROWS).collect()
    raw = train([bytes(r["ids"]) for r in samples])
    digest = hashlib.sha256(raw).hexdigest()
    spark.createDataFrame([(digest, raw)], "dictionary string, raw binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/dictionary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.length("text"), F.crc32(F.col("text").cast("binary"))]
    ranged = source.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(*order)
    ranged.mapInArrow(_writer(vocabulary, end_id, width, raw, digest), CHUNKS).write.mode("overwrite").parquet(f"{path}/chunks")


def dictionary(spark: SparkSession, path: str) -> tuple[bytes, str]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    return bytes(row["raw"]), row["dictionary"]


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read back from the files."""
    raw, digest = dictionary(spark, path)
    chunks = spark.read.parquet(f"{path}/chunks")
    totals = {r["part"]: r["n"] for r in chunks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    bases, before = [], 0
    for part in sorted(totals):
        bases.append((part, before))
        before += totals[part]
    rows = chunks.mapInArrow(_reader(raw, digest), "doc_id long, part int, inner long, n_tokens long, ids_crc32 long")
    known = spark.createDataFrame(bases, "part int, base long")
    return rows.join(F.broadcast(known), "part").select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """Ids of the documents with this id: one chunk or so is read, and one frame each decompressed."""
    raw, digest = dictionary(spark, path)
    near = spark.read.parquet(f"{path}/chunks").filter((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    return [ids.tolist() for row in near.toLocalIterator() for ids in documents(row.asDict(), raw, digest, doc_id)]


def op7_token_store(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read(spark, path)
