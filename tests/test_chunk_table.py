import random

import pytest

from docloom.operators import chunk_table, chunking

SCHEMA = "doc_id long, element_index int, element_type string, page_number int, text string, content string"


def elements(spark, docs):
    return spark.createDataFrame([(d, i, k, i // 3, t, "x") for d, es in docs.items() for i, (k, t) in enumerate(es)], SCHEMA)


def test_chunks_are_the_folds(spark):
    r = random.Random(2)
    bits = ["One sentence.", "Another one! ", "", "  ", None, "no end", "A. B? C!", "x" * 70 + ". Y.", "Title words"]
    docs = {d: [(r.choice(["Title", "NarrativeText", "ListItem", None]), r.choice(bits)) for _ in range(r.randint(0, 25))] for d in range(40)}
    df = elements(spark, docs).repartition(5)
    for most, overlap in [(60, 2), (1, 0)]:
        got = {}
        for x in chunk_table.chunked(df, most=most, overlap=overlap).collect():
            got.setdefault(x.doc_id, []).append((x.chunk_index, x.content))
        for d, es in docs.items():
            assert [c for _, c in sorted(got.get(d, []))] == chunking.accumulate(es, most, overlap)


def test_sql_and_metadata(spark):
    df = elements(spark, {7: [("Title", "Head"), ("NarrativeText", "One. Two."), (None, "Three."), ("ListItem", "Four.")]})
    df.createOrReplaceTempView("chunk_elements")
    chunk_table.register(spark)
    rows = spark.sql("SELECT * FROM chunks(TABLE(chunk_elements) PARTITION BY (doc_id) ORDER BY (element_index), 'doc_id', 1000, 2) ORDER BY chunk_index").collect()
    assert [tuple(r) for r in rows] == [(7, 0, "Head", ["Title"], [0]), (7, 1, "One. Two. Three. Four.", ["NarrativeText", "ListItem"], [0, 1])]
    with pytest.raises(Exception, match="has no"):
        spark.sql("SELECT * FROM chunks(TABLE(chunk_elements) PARTITION BY (doc_id) ORDER BY (element_index), 'nothing', 1000, 2)").collect()


def test_a_long_document_streams(spark):
    from pyspark.sql import functions as F

    lines = spark.range(60_000).select(F.lit(1).alias("doc_id"), F.col("id").alias("element_index"), F.lit("NarrativeText").alias("element_type"), (F.col("id") / 20).cast("int").alias("page_number"), F.concat(F.lit("Line "), F.col("id").cast("string"), F.lit(".")).alias("text"))
    out = chunk_table.chunked(lines, most=100, overlap=0).selectExpr("count(*) AS n", "max(chunk_index) AS last", "sum(length(content)) AS chars").first()
    assert out.n == out.last + 1 and out.n > 5000 and out.chars > 60_000 * 9
