"""Groups of exact copies through the pipeline's line and near-duplicate stages."""

import random

import corpus_pipeline as C

rnd = random.Random(11)


def prose(n):
    return " ".join(f"w{rnd.randrange(3000)}" for _ in range(n))


def test_a_copy_group_keeps_one(spark):
    copied = "\n".join(prose(20) for _ in range(3))
    footer = "read more on our page"
    rows = [(100 + i, copied) for i in range(15)] + [(200 + i, f"{prose(30)}\n{footer}") for i in range(12)]
    docs = spark.createDataFrame([(i, t, "en", f"src{i % 5}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    staged = C.lines(spark, docs, "").cache()
    text = {r["doc_id"]: r["text"] for r in staged.collect()}
    assert {text[100 + i] for i in range(15)} == {copied}
    assert all(text[200 + i] == dict(rows)[200 + i].split("\n")[0] for i in range(12))
    assert all(r["n_chars"] == len(r["text"]) for r in staged.collect())
    kept = sorted(r["doc_id"] for r in C.near(spark, staged, "").collect())
    assert kept == [100, *range(200, 212)]
