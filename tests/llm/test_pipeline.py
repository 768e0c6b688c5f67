"""The whole pipeline on a small corpus with planted cases, and the registered queries with SQL."""

import random

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rnd = random.Random(8)
    text = lambda n: " ".join("".join(rnd.choice("aeinorst") for _ in range(rnd.randint(2, 8))) + ("." if k % 9 == 8 else "") for k in range(n))
    passage = text(120)
    planted = {
        900_001: text(300), 900_002: text(200) + " " + passage + " " + text(150), 900_003: text(180) + " " + passage + " " + text(90),
        900_004: text(150) + " token = aB3dE5fG7hI9jK1lM3nO5 " + text(100), 900_005: text(250),
        # Symbols behind every word, as the labelled poor documents have them.
        900_006: " ".join(w + rnd.choice(["%%%", "###", "$$$", "&&&"]) for w in text(300).split()),
    }
    planted[900_007] = planted[900_001]
    planted[900_008] = planted[900_005].replace(" ", "  ", 3).replace(planted[900_005].split()[60], "changed", 1)
    rows = [(i, t, "en", f"own{i}", len(t)) for i, t in planted.items()]
    docs.unionByName(spark.createDataFrame(rows, docs.schema)).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.01/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return str(folder), planted, passage


def test_stages_in_order(spark, corpus, tmp_path):
    sf_dir, planted, passage = corpus
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "simhash near-dedup", "suffix-array dedup", "secret scans", "packing"]
    after = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after.append(docs)
    texts = [{r.doc_id: r.text for r in d.select("doc_id", "text").collect()} for d in after[:4]]
    assert set(planted) - set(texts[0]) == {900_006}
    assert set(planted) & set(texts[1]) == {900_001, 900_002, 900_003, 900_004, 900_005}
    assert set(texts[2]) == set(texts[3]) == set(texts[1])
    assert passage not in texts[2][900_002] and passage not in texts[2][900_003]
    assert texts[2][900_001] == planted[900_001]
    assert "aB3dE5fG7hI9jK1lM3nO5" not in texts[3][900_004] and "[SECRET]" in texts[3][900_004]
    assert {r.doc_id for r in after[4].select("doc_id").distinct().collect()} == set(texts[3])
    run = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(map(str, run)) == sorted(map(str, after[4].collect()))


@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.oracle_sql() if n.startswith("op")))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "labels", "benchmark"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got = __spark_entry__.queries()[name](spark, SF).toPandas()
    want = con.execute(__spark_entry__.oracle_sql()[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)
    # Integers with nulls come as doubles from one side.
    ordered = lambda df: df[columns].convert_dtypes().sort_values(columns).reset_index(drop=True).astype(str)
    assert ordered(got).equals(ordered(want))


def test_every_operator_has_its_query():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
