"""Words across segments of long texts, and the pipeline on a table without rows."""

import random
import re

import numpy as np
import pyarrow as pa

import corpus_pipeline
from tidewell.llm import common, decontaminate

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_words_run_on_over_segments(monkeypatch):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(["ab", "é", "Word", "x" * 90, " ", "\n", "\t "]) for _ in range(rnd.randint(0, 120))) for _ in range(40)] + ["", "  ", "one"]
    data, offsets = common.flat(pa.array(texts))
    whole = common.word_table(data, offsets, lower=True)
    assert np.diff(whole[2]).tolist() == [len(WORD.findall(t)) for t in texts]
    assert whole[1].tolist() == [len(w) for t in texts for w in WORD.findall(t)]
    monkeypatch.setattr(common, "SEGMENT", 64)
    parts = common.word_table(data, offsets, lower=True)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    words = [w.lower() for t in texts for w in WORD.findall(t)]
    assert len(set(whole[0].tolist())) == len(set(words))


def test_items_are_found_across_segments_and_texts():
    filler = " ".join(f"w{i}" for i in range(200_000))  # over a segment
    item = "some words of a test item that is long enough to count"
    items = decontaminate.Items([1, 2, 3], [item, "two words", "w199999"])
    texts = [f"{filler} {item} {filler}", f"{filler} two", "words two words", "w199999 other", f"two\n{filler}"]
    data, offsets = common.flat(pa.array(texts))
    found = set()
    for first, last in common.groups(offsets):
        words, _, index = common.word_table(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], lower=True)
        found |= {(first + m[0], m[1]) for m in items.matches(words, index)}
    assert found == {(0, 1), (0, 3), (1, 3), (2, 2), (3, 3), (4, 3)}


def test_pipeline_of_an_empty_table(spark, empty, tmp_path):
    benchmark = spark.createDataFrame([(1, "a test item of more than five words")], "item_id long, text string")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0, name
        docs = out if name != "packing" else docs
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_says_which_odd_rows_stay(spark, docs, tmp_path):
    say = lambda k: " ".join(f"{k}w{i}" for i in range(60))
    test_item = "this is the passage of a test that nobody may learn from"
    texts = [None, "", " \n ", "12345 678", say("a"), say("a"), say("b"), f"{say('c')} {test_item}", "one two", say("a") + " more"]
    df = docs(texts, ids=[1, 2, 3, 4, 5, 6, 7, 8, 9, 10])
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, test_item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r["doc_id"] for r in rows}) == [5, 7, 9]
