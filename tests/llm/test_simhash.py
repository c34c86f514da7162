"""SimHash fingerprints, bit-sliced comparison and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from tidewell.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """{key: least key reached}, of {key: fingerprint}."""
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def balls(rnd, centres, size, flips):
    out = []
    for _ in range(centres):
        centre = rnd.getrandbits(64)
        for _ in range(size):
            fp = centre
            for _ in range(rnd.randint(0, flips)):
                fp ^= 1 << rnd.randrange(64)
            out.append(fp)
    return list(dict.fromkeys(out))


def signed(fp):
    return fp - (1 << 64) if fp >> 63 else fp


def linked(spark, fps):
    nodes = spark.createDataFrame([(signed(f), 1) for f in fps], "fp long, weight long")
    groups = {}
    for r in simhash.linked(nodes).collect():
        groups.setdefault(r["root"], set()).update((r["node"], r["root"]))
    return {frozenset(g) for g in groups.values()}


def plain_groups(fps):
    found = {}
    for i, r in plain_components({signed(f): f for f in fps}).items():
        found.setdefault(r, set()).add(i)
    return {frozenset(g) for g in found.values() if len(g) > 1}


def test_fingerprints(spark, docs):
    rnd = random.Random(5)
    texts = [None, "", " \n\t", "One", "one two", "One Two three", "a b c d", "é\x85x y z w", "a\x0bb\x0cc\rd"]
    texts += [" ".join(rnd.choice(["Alpha", "beta", "Γamma", "d" * 50]) for _ in range(n)) for n in (3, 10, 500)]
    got = {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in simhash.fingerprints(docs(texts)).collect()}
    assert got == {i: plain_fingerprint(t) for i, t in enumerate(texts)}


def test_long_texts_are_taken_in_stretches(monkeypatch):
    rnd = random.Random(6)
    text = "".join(rnd.choice(["abc", "x", "  ", " ", "\n", "long" * 30]) for _ in range(3000))
    whole = simhash.fingerprint(text.encode())
    assert whole == plain_fingerprint(text)
    for size in (1, 2, 7, 64, 1000):
        monkeypatch.setattr(simhash, "SEGMENT", size)
        assert simhash.fingerprint(text.encode()) == whole
        assert simhash.fingerprint(b"a b") == plain_fingerprint("a b")
        assert simhash.fingerprint(b"  a  ") == plain_fingerprint("a")


def test_keys_hold_every_close_pair(spark):
    rnd = random.Random(7)
    for _ in range(300):
        a, flips = rnd.getrandbits(64), rnd.sample(range(64), 3)
        shared = [n for n in range(16) if not set(flips) - set(simhash.free_bits(n))]
        assert shared, (a, flips)
    fps = [rnd.getrandbits(64) for _ in range(50)]
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    for r in df.select("fp", *[k.alias(f"k{n}") for n, k in enumerate(simhash.keys(df["fp"]))]).collect():
        fp = r["fp"] & (1 << 64) - 1
        for n in range(16):
            held = [b for b in range(64) if b not in simhash.free_bits(n)]
            assert r[f"k{n}"] >> 28 == n
            assert sorted(fp >> b & 1 for b in held) == sorted(r[f"k{n}"] >> k & 1 for k in range(28))


def test_bit_sliced_distances():
    rnd = random.Random(8)
    fps = np.array((balls(rnd, 3, 100, 6) + [rnd.getrandbits(64) for _ in range(128)])[:320], np.uint64)
    sliced, valid = simhash.planes(fps), np.full(5, simhash._ALL)
    row, block = (x.ravel() for x in np.meshgrid(np.arange(320), np.arange(5), indexing="ij"))
    pair, words = simhash.close(fps[row], block, sliced, valid, list(range(64)))
    got = {(int(row[p]), int(block[p]) * 64 + k) for p, w in zip(pair, words, strict=True) for k in range(64) if int(w) >> k & 1}
    assert got == {(i, j) for i in range(320) for j in range(320) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 3}


@pytest.mark.parametrize("tile", [4096, 16])
def test_components(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "QUERIES", 3 * tile)
    monkeypatch.setattr(simhash, "PIVOTS", 2)
    rnd = random.Random(9)
    fps = balls(rnd, 4, 150, 9) + balls(rnd, 60, 3, 5) + [rnd.getrandbits(16) for _ in range(150)] + [0]
    fps = list(dict.fromkeys(fps))
    assert linked(spark, fps) == plain_groups(fps)


def test_rows(spark, docs, odd):
    rnd = random.Random(10)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(40):
        own = list(base)
        own[rnd.randrange(300)] = "other"
        texts.append(" ".join(own))
    texts += texts[:5] + [None, "", "one", "one two three four five six", " ".join(base).upper()]
    ids = [100 - i for i in range(len(texts))]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.join(docs(texts, ids=ids)).collect()}
    fps = {i: plain_fingerprint(t) for i, t in zip(ids, texts, strict=True)}
    roots = plain_components(fps)
    assert got == {i: (f"{fps[i]:016x}", roots[i]) for i in ids}
    rows = simhash.join(odd).collect()
    assert len(rows) == odd.count() and simhash.join(odd).columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(r["component_id"] for r in rows if r["doc_id"] in (1, 2, 3)) == [1, 1, 1]


def test_empty(spark, empty):
    assert simhash.join(empty).collect() == []
