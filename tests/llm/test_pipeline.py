"""The queries against SQL, and the pipeline on planted documents."""

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenshelf.llm import mixing, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.select(*cols).collect()), key=repr) == sorted(want, key=repr)


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    rows = docs.collect()
    plain = rows[1].text
    extra = [(10_000, "123 ... !!!", "en", "s", 11), (10_001, None, None, None, None), (10_002, plain, None, "s", len(plain)), (10_003, "", "en", "s", 0)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "substring_dedup", "mix_sources", "tokenize"]
    ids = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert ids[0] == {r.doc_id for r in rows if r.text.strip()} | {10_002}
    assert 10_002 not in ids[1]
    assert ids[2] == ids[3] == ids[4]
    assert docs.where(F.col("n_tokens") == 0).count() == 0


def test_position_is_the_order_of_the_mixture(spark, tmp_path):
    rows = [(i, f"text {i} " + "word " * (400 if i % 5 == 0 else 1), "en", f"s{min(i % 7, 2)}", 1) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    hashes = {r.doc_id: r.u for r in docs.select("doc_id", F.shiftrightunsigned(F.xxhash64(F.lit(17), "doc_id"), 1).alias("u")).collect()}
    sources: dict = {}
    for i, _, _, source, _ in sorted(rows, key=lambda r: (hashes[r[0]], r[0])):
        sources.setdefault(source, []).append(i)
    weight = {f"s{k}": len(x) ** 0.7 for k, x in sources.items()}
    total = sum(weight.values())
    blocks = [(math.floor(j * total / w), math.ceil((j + 1) * total / w), k, j) for k, w in weight.items() for j in range(-(-len(sources[k[1:]]) // mixing.BLOCK))]
    want = []
    for _, (_, _, source, block) in sorted(zip(mixing.earliest_first(blocks, 0), blocks, strict=True)):
        want += sources[source[1:]][block * mixing.BLOCK : (block + 1) * mixing.BLOCK]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        corpus_pipeline.mix_sources(spark, docs, SF).write.parquet(str(tmp_path / "mixed"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(list((tmp_path / "mixed").glob("*.parquet"))) > 2
    out = corpus_pipeline.tokenize(spark, spark.read.parquet(str(tmp_path / "mixed")), SF)
    got = out.select("doc_id", "position").collect()
    assert len({r.position for r in got}) == 600
    assert [r.doc_id for r in sorted(got, key=lambda r: r.position)] == want


def test_pipeline_on_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
