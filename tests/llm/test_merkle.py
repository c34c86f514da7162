"""The Merkle manifest against a plain construction of its trees."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from tidewell.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(leaves):
    """Root, and the siblings of each leaf from below."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    steps = []
    for i in range(len(leaves)):
        own = []
        for level in levels[:-1]:
            first = i - i % 3
            own.append(("".join(level[first:i]), "".join(level[i + 1 : first + 3])))
            i //= 3
        steps.append(own)
    return levels[-1][0], steps


def plain(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append((leaf_of(r, r["text"]), r))
    names = sorted(by, key=lambda s: b"" if s is None else b"=" + s.encode())
    for s in names:
        by[s].sort(key=lambda x: (x[1]["doc_id"] is not None, x[1]["doc_id"] or 0, x[0]))
    trees = {s: tree([leaf for leaf, _ in by[s]]) for s in names}
    root, tops = tree([trees[s][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for (leaf, r), steps in zip(by[s], trees[s][1], strict=True):
            steps = steps + tops[k]
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None
            node = leaf_of(r, r["text"].replace("\n", "") if tampered else r["text"])
            for left, right in steps:
                node = h(left, node, right)
            out.append((r["doc_id"], leaf, trees[s][0], root, h(*[x for step in steps for x in step]), node, node == root))
    return out


def found(spark, df, tmp_path):
    df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    out = merkle.op12_merkle_manifest(spark, str(tmp_path))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return [tuple(r) for r in out.collect()]


def same(got, wanted):
    assert sorted(got, key=str) == sorted(wanted, key=str)


@pytest.fixture
def mixed(spark):
    sources = [None, "", "a", "ab", "é", "zz", "hot", "hot", "hot"]
    rows = [(i if i % 17 else i // 2, f"text {i}\nof line" if i % 3 else None, "en" if i % 5 else None, sources[i % 9], i if i % 7 else None) for i in range(1, 331)]
    rows += [(None, "no id\n", None, "hot", 1), (None, "no id\n", None, "hot", 1), (5, "é\n" * 5000, "fr", "alone", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("levels", [2, 7])
def test_manifest_is_the_plain_tree(spark, mixed, tmp_path, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "PAGE", 3**levels)
    same(found(spark, mixed, tmp_path), plain([r.asDict() for r in mixed.collect()]))


def test_small_tables(spark, docs, tmp_path):
    for n in (1, 3, 10):
        df = docs([f"t{i}\nx" for i in range(n)])
        same(found(spark, df, tmp_path), plain([r.asDict() for r in df.collect()]))


def test_odd_rows(spark, odd, tmp_path):
    got = found(spark, odd, tmp_path)
    same(got, plain([r.asDict() for r in odd.collect()]))
    assert len({r[4] for r in got}) == 8  # equal rows are leaves of their own


def test_empty_table(spark, empty, tmp_path):
    assert found(spark, empty, tmp_path) == []
    merkle.write(empty, f"{tmp_path}/manifest")
    assert merkle.root(spark, f"{tmp_path}/manifest") is None


def test_tampering_shows(spark, mixed, tmp_path):
    rows = found(spark, mixed, tmp_path)
    assert {r[6] for r in rows} == {True, False} and len({r[3] for r in rows}) == 1
