"""Test items of a few shingles are found wherever they stand."""

import random

from tidewell.llm import decontaminate


def test_items_of_few_shingles_are_never_missed(docs, spark):
    rnd = random.Random(9)
    sizes = [5] * 40 + [6] * 10 + list(range(7, 14))
    items = [" ".join(f"i{j}x{k}" for k in range(n)) for j, n in enumerate(sizes)]
    texts, want = [], []
    for i in range(4000):
        j = i % len(items)
        before = [f"u{rnd.random()}" for _ in range(rnd.choice([0, 0, 1, rnd.randint(0, 40)]))]
        texts.append(" ".join([*before, items[j], *(f"u{rnd.random()}" for _ in range(rnd.randint(20, 60)))]))
        want.append((i, j, sizes[j] - 4, sizes[j] - 4))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert sorted(tuple(r)[:4] for r in decontaminate.contaminated(docs(texts), bench).collect()) == want


def test_parts_of_short_items_far_apart_are_found(docs, spark):
    words = [f"w{k}" for k in range(12)]
    far = " ".join(f"u{k}" for k in range(500))
    text = f"{' '.join(words[:7])} {far} {' '.join(words[5:])}"
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert [tuple(r)[:4] for r in decontaminate.contaminated(docs([text, far]), bench).collect()] == [(0, 1, 6, 8)]
