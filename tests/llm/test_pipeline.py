"""The pipeline on a small corpus with planted cases."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import SCHEMA, VOCABULARY, sentence


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(3)
    at = tmp_path_factory.mktemp("sf")
    names = VOCABULARY + [f"n{i}" for i in range(300)]
    say = lambda n: " ".join(rng.choice(names) for _ in range(n))
    item = say(30)
    rows = [(i, say(60), "en", f"s{i % 3}", 0) for i in range(400)]
    rows += [(1000 + i, say(30) + " vexgrol snarkum " + say(30), "en", "s0", 0) for i in range(80)]
    rows += [(2000 + i, rows[i][1], "en", "s1", 0) for i in range(10)]
    rows += [(3000 + i, say(20) + " " + item + " " + say(20), "en", "s2", 0) for i in range(5)]
    rows += [(4000, None, None, None, None), (4001, "", "en", "s1", 0), (None, sentence(rng, 9), "en", "s1", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 1000)) for i in [*range(0, 400, 2), *range(1000, 1080)]], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages_one_by_one(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near-duplicates", "benchmark-leaks", "mixing", "sharding"]
    clean = stages["toxicity"](spark, docs, planted)
    assert clean.columns == docs.columns and ids(docs) - ids(clean) == set(range(1000, 1080))
    single = stages["near-duplicates"](spark, docs, planted)
    assert single.columns == docs.columns and set(range(2000, 2010)) <= ids(docs) - ids(single) <= {*range(2000, 2010), 4001}
    apart = stages["benchmark-leaks"](spark, docs, planted)
    assert apart.columns == docs.columns and ids(docs) - ids(apart) == set(range(3000, 3005))
    assert stages["mixing"](spark, docs, planted).columns == docs.columns
    assert stages["sharding"](spark, docs, planted).count() == docs.count()


def test_run(spark, planted):
    rows = corpus_pipeline.run(spark, planted).collect()
    ids = {r.doc_id for r in rows}
    assert not ids & {*range(1000, 1080), *range(2000, 2010), *range(3000, 3005)}
    assert len(ids & set(range(400))) > 300 and {r.shard for r in rows} == set(range(24))


def test_empty_tables(spark, planted, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{planted}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "text", "shard", "slot"} <= set(out.columns)
    # Documents alone, without labels and a benchmark: nothing is toxic or leaked.
    docs = spark.read.parquet(f"{planted}/documents.parquet").where("doc_id < 20").withColumn("doc_id", F.col("doc_id"))
    docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= set(range(20))


def test_columns_with_the_names_of_ours(spark, planted, tmp_path):
    odd = ["size", "score", "predicted", "target", "taken", "node", "class", "band", "times", "mark", "bucket", "order", "n", "component", "slot", "first", "toxic", "cell"]
    docs = spark.read.parquet(f"{planted}/documents.parquet").withColumns({c: F.lit(i) for i, c in enumerate(odd)})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{planted}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    wanted = sorted((r.doc_id, r.text, r.shard, r.slot) for r in corpus_pipeline.run(spark, planted).collect() if r.doc_id is not None)
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = out.collect()
    assert sorted((r.doc_id, r.text, r.shard, r.slot) for r in got if r.doc_id is not None) == wanted
    assert all(r["size"] == 0 and r.cell == len(odd) - 1 and r["class"] == odd.index("class") for r in got)
    assert set(out.columns) == {*docs.columns, "shard"}
