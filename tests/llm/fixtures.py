"""Edge rows that every operator must take: nulls, empty and very long texts, repeated rows, ties, clashing extra columns."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("size", T.StringType()),  # names that operators use themselves
        T.StructField("score", T.StringType()),
        T.StructField("fp", T.StringType()),
        T.StructField("range", T.StringType()),
    ]
)
LONG = "\n".join(f"The {i} line of a long text that goes on and on, word {i * 7} after word." for i in range(3000))
TEXTS = [
    (1, "The cat sat on the mat and looked at the moon for a while.", "en", "a"),
    (2, "Der Hund und die Katze von der Straße mit einem Ball.", "de", "b"),
    (3, None, "en", "a"),
    (4, "", None, None),
    (5, " \t\n ", "fr", "c"),
    (6, LONG, "en", "a"),
    (7, "The cat sat on the mat and looked at the moon for a while.", "en", "d"),
    (7, "The cat sat on the mat and looked at the moon for a while.", "en", "d"),
    (8, "1234 5678 !!!", "es", "b"),
    (9, LONG + "\nAnd an end.", "en", "a"),
    (None, "Les chats et les chiens du village sont dans une maison.", "fr", None),
    (10, "é́ 漢字 😀 \x00\x1c ﬁ İ Σ ​ <|endoftext|> ▁ <s>", "en", "a"),
    (11, "x", "en", "a"),
]


def documents(spark, rows=None):
    rows = TEXTS if rows is None else rows
    return spark.createDataFrame([(*r, len(r[1] or ""), "s", "t", "f", "r") for r in rows], SCHEMA)


def saved(spark, folder, rows=None, **tables):
    """A folder of tables, as queries read it."""
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
