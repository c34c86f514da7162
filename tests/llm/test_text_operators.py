"""Quality, language ID, secrets, URLs, licences: brute force and odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewell.llm import language_id, license_scan, quality, secrets, url_filter

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_quality_against_brute_force(docs):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(["a ", "b ", "é#", "c\n", "d\t", "a b c d e f ", "\n", "|$ "]) for _ in range(rnd.randint(0, 60))) for _ in range(80)]
    got = {r["doc_id"]: r for r in quality.score(docs(texts)).collect()}
    for i, t in enumerate(texts):
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        kept = not r["base_failed"]
        for n, percent in quality.COVERAGE.items():
            g = Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
            inside = {k + j for k in range(len(w) - n + 1) if g[tuple(w[k : k + n])] > 1 for j in range(n)}
            kept &= 100 * sum(len(w[k]) for k in inside) <= percent * sum(map(len, w))
        again = [x for k, x in enumerate(lines) if x in lines[:k]]
        kept &= 100 * sum(len(x) for y in again for x in WORD.findall(y)) <= quality.DUP_LINE_CHARS * sum(map(len, w))
        assert r["kept"] == kept


def test_language_by_fold(spark):
    from tidewell.llm.common import table

    got = language_id.op8_language_id(spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got["doc_id"], got["held_out"], strict=True))
    own = got[got["held_out"]]
    assert (own["lang"] == own["lang_pred"]).mean() > 0.95 and got["score"].between(0, 1).all()


def test_language_without_letters_or_training(docs, odd, empty):
    model = language_id.fit(docs(["hello there friend", "bonjour les amis"] * 5, ["en", "fr"] * 5))
    out = language_id.predict(docs([None, "", "123 !?", "bonjour amis", "hello there"]), model).collect()
    assert [r["lang_pred"] for r in out] == ["und", "und", "und", "fr", "en"] and out[0]["score"] == 0
    none = language_id.fit(docs(["x"], [None]))
    assert language_id.predict(docs(["hello"]), none).first()["lang_pred"] == "und"
    assert language_id.keep_identified(odd).columns == odd.columns and language_id.keep_identified(empty).count() == 0


def brute_secrets(text):
    spans = []
    for k, rule in enumerate(secrets.BASE + secrets.ADDED):
        spans += [(m.start(), k, m.end()) for m in rule.pattern.finditer(text or "") if rule.check(m)]
    return spans


def test_secrets_against_scanning_everything(docs):
    rnd = random.Random(2)
    parts = ["password=", "Token : ", "API_KEY='", "apikey=", "abcdefgh12", "AKIA", "ABCDEFGHIJKL0123", "deadbeef" * 4, "0123abcd", " ", "\n", "é", "ſecret=abcdefgh", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "xoxb-1234567890ab", "secret", "="]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(300)] + [None, ""]
    rules = secrets.BASE + secrets.ADDED
    for r in secrets.scan(docs(texts)).collect():
        spans = brute_secrets(texts[r["doc_id"]])
        base = [s for s in spans if s[1] < 3]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[1] == k for s in base) for k in range(3))
        assert r["base_sha256"] == hashlib.sha256(secrets.joined(base, rules).encode()).hexdigest() and r["spans"] == secrets.joined(spans, rules)


def test_trigram_index_is_cut_in_pieces(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from tidewell.llm.common import flat

    monkeypatch.setattr(secrets, "PIECE", 5)
    data, offsets = flat(pa.array(["xxtok", "en", "token", "", "TOKENtoken"]))
    wanted = np.array(sorted(secrets.trigrams("token")), np.int32)
    index = secrets.postings(data, offsets, wanted)
    assert secrets.candidates(index, [secrets.trigrams("token")], 5).tolist() == [2, 4]


def test_urls(spark):
    urls = [None, "nothing", "http://WWW.Example.com/en/x?q#f", "https://a.example.com/en/", "http://example.com/EN/", "http://x.net/fr/1", "http://net/es/", "ftp://notcom/", "http://a.com", "http://a.com/", "x://example.comx/en/", "http://u@h.com:80/a://b", "http://é.com/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls * 2)], "page_id long, url string, rule string")
    got = url_filter.judge(pages, url_filter.rule_table(spark, url_filter.RULES)).collect()
    assert len(got) == 2 * len(urls)
    for r in got:
        u = urls[r["page_id"] % len(urls)] or ""
        after = u.split("://", 1)[1] if "://" in u else ""
        host = re.match(r"[^/?#]*", after)[0]
        path = re.match(r"[^?#]*", after[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h + p), a, h + p) for h, p, a in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits) if fits else (0, "allow", None)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, want[2], want[1])


def test_a_short_prefix_alone_is_no_match(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "PREFIX_HEX", 1)
    pages = spark.createDataFrame([(i, f"http://h{i}.com/en/") for i in range(200)], "page_id long, url string")
    out = url_filter.judge(pages, url_filter.rule_table(spark, [("h7.com", "/en/", "block"), ("other.org", "/", "block")]))
    assert [r["page_id"] for r in out.filter("verdict = 'block'").collect()] == [7]
    assert url_filter.judge(pages.limit(0), url_filter.rule_table(spark, url_filter.RULES)).count() == 0


def test_licences_and_directories(spark):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    data = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.txt", "some words\nmore words"), (3, "a/b/c/y.txt", None),
        (4, "a/b/notice.txt", " ".join(f"word{i}" for i in range(60)) + "\n" + gpl + "\nand then more"), (5, "z/x.txt", ""), (6, None, "x"), (7, "top.txt", "y"), (7, "top.txt", "y"),
        (8, "q/COPYING", gpl), (9, "q/r/s.txt", "words about a license and the public that are not one"),
    ]
    df = spark.createDataFrame(data, "doc_id long, path string, text string").withColumn("unit", F.lit(1))
    got = sorted(tuple(r) for r in license_scan.scan(df).select("doc_id", "licence", "origin", "directory").collect())
    assert got == [
        (1, "MIT", "file", "a"), (2, "MIT", "inherited", "a"), (3, "MIT", "inherited", "a"), (4, "GPL-3.0", "header", "a/b"), (5, None, "none", None),
        (6, None, "none", None), (7, None, "none", None), (7, None, "none", None), (8, "GPL-3.0", "file", "q"), (9, "GPL-3.0", "inherited", "q"),
    ]
    assert license_scan.scan(df.limit(0)).count() == 0


def test_licence_cosines_against_brute_force(spark):
    import math

    from tidewell.llm.common import table

    got = {r["doc_id"]: (r["licence"], r["score"]) for r in license_scan.op5_license_scan(spark, SF).filter("origin in ('header', 'file')").collect()}
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    split = lambda t: re.findall(license_scan._TERM, t.lower())
    known = {w for _, t in license_scan.TEMPLATES for w in split(t)}
    df = Counter(w for t in texts.values() for w in set(split(t)) & known)
    idf = {w: math.log((len(texts) + 1) / (df[w] + 1)) + 1 for w in known}
    weight = lambda c: {w: n * idf.get(w, math.log(len(texts) + 1) + 1) for w, n in c.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    templates = [(n, weight(Counter(split(t)))) for n, t in license_scan.TEMPLATES]
    want = {}
    for i, t in texts.items():
        hits = []
        blocks = re.split(license_scan._BETWEEN, t)
        for unit, own in enumerate([t, *t.split("\n"), *(b for b in blocks if "\n" in b and len(blocks) > 1)]):
            v = weight(Counter(split(own)))
            for name, u in templates:
                score = round(sum(x * u.get(w, 0) for w, x in v.items()) / (norm(v) * norm(u)), 6) if v else 0
                if score >= (license_scan.LINE_COSINE if unit else license_scan.FILE_COSINE):
                    hits.append((-score, name))
        if hits:
            want[i] = (min(hits)[1], -min(hits)[0])
    assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in want.items()}
    assert all(got[i][1] == pytest.approx(want[i][1], abs=2e-6) for i in want)


@pytest.mark.parametrize("scan", [quality.score, secrets.scan, lambda d: license_scan.scan(d, path="source")])
def test_odd_rows(odd, empty, scan):
    assert scan(odd).count() == odd.count() and scan(empty).count() == 0
