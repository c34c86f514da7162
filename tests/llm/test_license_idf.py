"""Licence scans weigh every term by its own frequency in the corpus."""

import math
import re
from collections import Counter

import pytest

from tidewell.llm import license_scan


@pytest.mark.parametrize("common", [50_000, 3])
def test_common_extra_words_cost_little(spark, monkeypatch, common):
    monkeypatch.setattr(license_scan, "COMMON", common, raising=False)
    texts = [f"as under the license was released to w{i}" for i in range(400)] + ["Released as under the MIT License.", None, ""]
    df = spark.createDataFrame([(i, f"d{i}/x.txt", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    got = {r["doc_id"]: (r["licence"], r["score"]) for r in license_scan.scan(df).filter("origin in ('header', 'file')").collect()}

    split = lambda t: re.findall(license_scan._TERM, (t or "").lower())
    count = Counter(w for t in texts for w in set(split(t)))
    weigh = lambda t: {w: n * (math.log((len(texts) + 1) / (count[w] + 1)) + 1) for w, n in Counter(split(t)).items()}
    u, v = weigh("Released under the MIT License."), weigh(texts[400])
    norm = lambda x: math.sqrt(sum(w * w for w in x.values()))
    score = sum(w * u.get(k, 0) for k, w in v.items()) / (norm(u) * norm(v))
    assert score > 0.95 and got == {400: ("MIT", pytest.approx(score, abs=2e-6))}
