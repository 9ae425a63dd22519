import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import queries


def make(spark, folder):
    rng = random.Random(21)
    words = ["".join(rng.choices(["an", "the", "ti", "on", "er", "ing", "re"], k=rng.randint(2, 4))) for _ in range(600)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    rows = [(i, text(rng.randint(20, 120))) for i in range(400)]
    toxic = [i for i in range(0, 400, 8)]
    for i in toxic:
        rows[i] = (i, rows[i][1] + " you moron idiot scumbag " + text(3))
    bench = [(i, text(25)) for i in range(3)]
    copies = [(1000 + i, rows[i][1].replace(" ", "  ")) for i in range(1, 400, 40)]
    near = [(2000 + i, rows[i][1] + " extra") for i in range(3, 400, 40) if len(rows[i][1].split()) > 40]
    leaked = [(3000 + i, f"{text(30)} {b} {text(30)}") for i, b in bench]
    odd = [(4000, None), (4001, ""), (4002, "one")]
    docs = rows + copies + near + leaked + odd
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return dict(docs), set(toxic), [i for i, _ in copies], [i for i, _ in near], [i for i, _ in leaked]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    f = str(tmp_path_factory.mktemp("sf") / "sf")
    return f, make(spark, f)


def test_pipeline_against_brute_force(spark, folder):
    """The toxic texts, then all but the longest of equal texts, then all but the smallest id of near copies, then leaks go; the rest is encoded."""
    f, (docs, toxic, copies, near, leaked) = folder
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, f).collect()}
    want = set(docs) - toxic - {i - 1000 for i in copies if i - 1000 not in toxic} - set(leaked)
    want -= {i for i in copies if i - 1000 in toxic}
    want -= {i for i in near}
    want -= {4001}  # equal to the null text, which has the smaller id
    assert set(got) == want
    assert all(r.round_trip for r in got.values())


def test_stages_keep_the_columns_and_take_extra_ones(spark, folder):
    f, _ = folder
    docs = spark.read.parquet(f"{f}/documents.parquet").withColumn("score", F.lit(1)).withColumn("_drop", F.lit("x")).withColumn("component_id", F.lit(2))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, f).columns == docs.columns, name


def test_stages_take_an_empty_table(spark, folder):
    f, _ = folder
    docs = spark.read.parquet(f"{f}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, f).collect() == []


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
