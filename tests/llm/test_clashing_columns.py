"""Columns of the caller come through as they were, whatever their names."""

import pytest
from pyspark.sql import functions as F

from tidewell.llm import decontaminate, jaccard_join, language_id, line_dedup

NAMES = ["_key", "_gone", "gone", "doc_key", "row", "row_key", "_row_key", "line", "s", "d", "n", "lead", "root", "point", "block", "item_id", "lang_pred", "score", "bucket", "rank", "head", "component_id"]


@pytest.fixture
def clashing(docs):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = docs([passage, f"own words\n{passage}", None, "", "some other words of a text that nobody copied"])
    return rows.withColumns({c: F.concat(F.lit(f"{c} "), F.col("doc_id")) for c in NAMES})


def same(out):
    rows = out.collect()
    assert rows and all(r[c] == f"{c} {r['doc_id']}" for r in rows for c in NAMES)
    return {r["doc_id"]: r["text"] for r in rows}


def test_line_dedup(clashing):
    assert same(line_dedup.dedup(clashing))[1] == "own words"
    assert line_dedup.dedup(clashing).columns == [*clashing.columns, "removed_lines"]
    kept = line_dedup.keep_new_lines(clashing)
    assert same(kept)[1] == "own words" and kept.columns == clashing.columns


def test_other_stages(clashing, spark):
    bench = spark.createDataFrame([(1, "own words w0 w1 w2 w3 w4")], "item_id long, text string")
    assert sorted(same(decontaminate.keep_clean(clashing, bench))) == [0, 2, 3, 4]
    assert sorted(same(jaccard_join.keep_one(clashing))) == [0, 2, 3, 4]
    assert sorted(same(language_id.keep_identified(clashing))) == [0, 1, 4]
    for out in (decontaminate.keep_clean(clashing, bench), jaccard_join.keep_one(clashing), language_id.keep_identified(clashing)):
        assert out.columns == clashing.columns


def test_a_text_of_several_segments(docs, monkeypatch):
    """Words across the cuts of work arrays: texts of 3 MB give the same sets as the same words in one piece."""
    from tidewell.llm import common

    long = " ".join(f"word{i % 5000}x{i}" for i in range(220_000))
    copy = long.replace("word7x7 ", "other ")
    assert len(long) > 3 * common.SEGMENT // 1
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(docs([long, copy, long + " end", "x"])).collect()}
    assert got == {0: (219_996, 0), 1: (219_996, 0), 2: (219_997, 0), 3: (1, 3)}
