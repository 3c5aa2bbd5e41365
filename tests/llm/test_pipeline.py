"""The pipeline's stages one after the other, over a small table with planted cases."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abdeiorstn") for _ in range(rng.randint(2, 7))) for _ in range(2000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    item = prose(40)
    clean = [prose(200) for _ in range(20)]
    base = prose(150)
    near = [" ".join([*base.split()[:k], "zz", *base.split()[k + 1 :]]) for k in (30, 80)]
    leak = prose(80) + " " + item[5:160] + " " + prose(80)
    texts = [*clean, *near, leak, None, "12 34", prose(90) + "\n" + clean[0]]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {}
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        left[name] = {r["doc_id"]: r.asDict() for r in docs.collect()}
    everything = set(range(26))
    assert set(left["language"]) == everything - {23, 24}
    assert set(left["lines"]) == everything - {23, 24}
    assert clean[0] not in left["lines"][25]["text"] and left["lines"][0]["text"] == clean[0]
    assert left["lines"][25]["n_chars"] == len(left["lines"][25]["text"])
    assert set(left["near_copies"]) == everything - {21, 23, 24}
    assert set(left["benchmark"]) == everything - {21, 22, 23, 24}
    assert set(left["mix"]) == set(left["benchmark"]) and set(range(20)) <= set(left["mix"])
    got = {r["doc_id"]: r["taken"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i: r["taken"] for i, r in left["mix"].items()}


def test_lines_keeps_short_lines_of_its_own(spark, tmp_path):
    """A document of short lines that shares a long footer loses the footer alone; a copy without a word left goes."""
    footer = "Printed with the kind permission of all the heirs"
    poem = "\n".join(f"The {w} is near" for w in ("sea", "hill", "mill", "wood"))
    texts = [f"Something else that is long enough to count here\n{footer}", f"{poem}\n{footer}", f"{poem}\n \n{footer}", "没有人\n知道\n" + footer, None, " \n "]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.lines(spark, docs, str(tmp_path)).collect()}
    assert got == {0: (texts[0], len(texts[0])), 1: (poem, len(poem)), 3: ("没有人\n知道", 6), 4: (None, 0), 5: (" \n ", 3)}
