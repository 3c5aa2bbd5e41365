"""The pipeline's stages on odd tables: empty ones, nulls, repeated rows and ids, long texts, clashing columns."""

import random
from collections import Counter

import corpus_pipeline
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string, key string, row string, _id string, size int"


def prose(rng, n):
    return " ".join("".join(rng.choice("abdeiorstn") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = random.Random(4)
    at = tmp_path_factory.mktemp("cases")
    a, b, c, long = prose(rng, 40), prose(rng, 50), prose(rng, 60), prose(rng, 30_000)
    near = c + " more"
    item = prose(rng, 12)
    texts = [
        (1, a, "s"), (5, a, "s"), (5, b, "s"), (6, c, "a"), (6, c, "b"), (6, c, "b"), (None, near, "a"), (None, prose(rng, 30), "a"), (None, prose(rng, 30), None),
        (7, None, "s"), (8, "", "s"), (8, "", "s"), (9, "12 34", None), (10, long, "s"), (11, "x " + item + " y", "s"), (12, "short item here", "s"), (13, prose(rng, 20), "s"),
    ]
    rows = [(i, t, "en", s, len(t or ""), "n", "k", "r", "i", 3) for i, t, s in texts]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([("1", item), (None, "Short, item!"), ("2", None)], "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), spark.read.parquet(f"{at}/documents.parquet"), rows


def of(df, schema):
    assert df.columns == schema.columns
    return Counter(map(tuple, df.collect()))


def test_language(spark, table):
    at, docs, rows = table
    assert of(corpus_pipeline.language(spark, docs, at), docs) == Counter(r for r in rows if r[1] and any(x.isalpha() for x in r[1]))
    unlabelled = docs.withColumn("lang", docs.lang.substr(100, 1)).replace("", None, subset=["lang"])
    assert corpus_pipeline.language(spark, unlabelled, at).count() == sum(bool(r[1]) and any(x.isalpha() for x in r[1]) for r in rows)


def test_near_copies_go_by_row(spark, table):
    at, docs, rows = table
    got = of(corpus_pipeline.near_copies(spark, docs, at), docs)
    kept = Counter((r[0], r[1]) for r in got.elements())
    want = Counter((r[0], r[1]) for r in rows)
    want[5, rows[1][1]] -= 1  # a copy of document 1
    want[6, rows[3][1]] -= 2  # three rows of one text: one stays
    want[None, rows[6][1]] -= 1  # near copy of document 6
    assert kept == +want and set(got) <= set(rows)


def test_benchmark_counts_short_items(spark, table):
    at, docs, rows = table
    assert of(corpus_pipeline.benchmark(spark, docs, at), docs) == Counter(r for r in rows if r[0] not in (11, 12))


def test_lines_and_mix(spark, table):
    at, docs, rows = table
    got = of(corpus_pipeline.lines(spark, docs, at), docs)
    # Documents of one line: copies lose it and go; so do near copies within two edits, and equal rows fare alike.
    assert Counter(r[0] for r in got.elements())[5] == 1 and {r[1] for r in got} >= {rows[2][1], rows[13][1], None, ""}
    out = corpus_pipeline.mix(spark, docs, at).collect()
    assert Counter((r["doc_id"], r["text"], r["name"], r["row"], r["_id"], r["key"]) for r in out) == Counter((r[0], r[1], "n", "r", "i", "k") for r in rows)
    assert all(r["taken"] <= 2 * r["size"] for r in out)


def test_empty(spark, table):
    at, docs, _ = table
    none = docs.where("doc_id < -1")
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, none, at)
        assert out.count() == 0 and (name == "mix" or out.columns == docs.columns)


def test_run(spark, table):
    at, _, rows = table
    out = corpus_pipeline.run(spark, at).collect()
    ids = Counter(r["doc_id"] for r in out)
    assert ids[1] == ids[6] == ids[10] == ids[13] == 1 and ids[5] == 1 and not any(ids[i] for i in (7, 8, 9, 11, 12)) and ids[None] == 2
    assert all(r["text"] for r in out)
