"""The pipeline's stages keep and drop rows, not ids."""

from tidewell.llm import decontaminate, jaccard_join


def test_rows_of_one_id_are_judged_by_their_texts(docs):
    say = lambda k: " ".join(f"{k}w{i}" for i in range(30))
    rows = [(1, "a"), (2, "a"), (2, "b"), (2, "c"), (2, "c"), (3, "b"), (None, "a"), (None, "d"), (None, "d"), (None, "e")]
    kept = jaccard_join.keep_one(docs([say(k) for _, k in rows], ids=[i for i, _ in rows]))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, say("a")), (2, say("b")), (2, say("c")), (None, say("d")), (None, say("e"))], key=str)


def test_rows_without_words_stay_once_by_id_and_text(docs):
    kept = jaccard_join.keep_one(docs([None, "", "", " ", "", ""], ids=[1, 1, 2, 2, None, None]))
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect()) == [("1", ""), ("1", "None"), ("2", ""), ("2", " "), ("None", "")]


def test_only_the_rows_that_hold_an_item_are_dropped(docs, spark):
    item = "one two three four five six seven"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, f"x {item} y"), (1, "clean text"), (None, f"{item} z"), (None, "clean too"), (None, None)]
    kept = decontaminate.keep_clean(docs([t for _, t in rows], ids=[i for i, _ in rows]), bench)
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect()) == [("1", "clean text"), ("None", "None"), ("None", "clean too")]
