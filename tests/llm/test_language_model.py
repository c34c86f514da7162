import math
import random
from collections import Counter

import numpy as np
import pytest

from tidewell.llm import language_id


def bucket(gram):
    """The hash of an n-gram, one operation at a time."""
    a, b, c = (int(x) for x in language_id._FACTORS)
    h = (ord(gram[0]) * a + (len(gram) * 0x27D4EB2F & 0xFFFFFFFF)) & 0xFFFFFFFF
    for ch in gram[1:]:
        h = ((h ^ h >> 15) * b + ord(ch) * c) & 0xFFFFFFFF
    return ((h ^ h >> 13) * a & 0xFFFFFFFF) >> 32 - language_id.BITS


def grams(text):
    text = text.lower()
    return Counter(bucket(text[i : i + n]) for n in language_id.ORDERS for i in range(len(text) - n + 1))


@pytest.mark.parametrize("block", [7, 64, 1 << 17])
def test_bucket_matrix_against_single_texts(monkeypatch, block):
    monkeypatch.setattr(language_id, "BLOCK", block)
    texts = ["", "a", "Straße ÉTÉ", "x" * 100, "the word \U0001f600 and more words of it", "ab"]
    got = [Counter() for _ in texts]
    for rows, buckets, n in language_id.bucket_matrix(texts):
        for i, b, k in zip(rows.tolist(), buckets.tolist(), n.tolist(), strict=True):
            got[i][b] += k
    assert got == [grams(t) for t in texts]


@pytest.mark.parametrize("languages", [1, 2, 512])
def test_naive_bayes_against_brute_force(docs, monkeypatch, languages):
    monkeypatch.setattr(language_id, "LANGUAGES", languages)
    rnd = random.Random(4)
    words = {"en": ["the", "house", "of", "water"], "fr": ["le", "maison", "d'eau", "été"], "de": ["das", "Haus", "Wasser", "für"]}
    say = lambda lang, n: " ".join(rnd.choice(words[lang]) for _ in range(n))
    langs = [rnd.choice(list(words)) for _ in range(40)]
    texts = [say(x, rnd.randint(1, 12)) for x in langs]
    model = language_id.fit(docs(texts, langs))
    counts = {x: sum((grams(t) for t, y in zip(texts, langs, strict=True) if y == x), Counter()) for x in words}
    size = 1 << language_id.BITS
    judged = [say(rnd.choice(list(words)), rnd.randint(1, 9)) for _ in range(30)] + ["the été Haus", "zzz"]
    monkeypatch.setattr(language_id, "ENTRIES", 30)
    said, score = language_id.judge(judged, model)
    for text, lang, p in zip(judged, said, score, strict=True):
        points = {x: math.log(langs.count(x) / len(langs)) + sum(n * math.log((counts[x][g] + 0.5) / (sum(counts[x].values()) + 0.5 * size)) for g, n in grams(text).items()) for x in words}
        best = max(sorted(points), key=points.get)
        assert lang == best and p == pytest.approx(1 / sum(math.exp(v - points[best]) for v in points.values()), abs=1e-4)


def test_names_of_columns_are_parameters(docs, spark):
    rows = docs(["hello there friend", "bonjour les amis"] * 5, ["en", "fr"] * 5).withColumnsRenamed({"doc_id": "k", "text": "t", "lang": "l"})
    assert language_id.keep_identified(rows, "k", "t", "l").count() == 10
    assert len(language_id.fit(rows, "t", "l", train_rows=5)[0][0]) <= 2


def test_texts_over_a_block(docs):
    model = language_id.fit(docs(["hello there friend", "bonjour les amis"] * 5, ["en", "fr"] * 5))
    said, score = language_id.judge(["bonjour amis " * 250_000, None, "7"], model)
    assert said == ["fr", "und", "und"] and np.allclose(score, [1, 0, 0])
