"""Sources. Everything is a lazy scan whose filters and columns reach the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df's rows, dealt by key over four tasks a core: a file of one row group is otherwise the work of one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def missing(df: DataFrame, *columns: str) -> DataFrame:
    """Rows where any of the columns is null."""
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.col(c).isNull()
    return df.where(cond)


def non_blank(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull() & (F.trim(column) != ""))


def json_documents(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Multi-line JSON files; a file that holds null gives no rows. file: the path it came from."""
    reader = spark.read.option("multiLine", True).option("mode", "PERMISSIVE")
    df = (reader.schema(schema) if schema else reader).json(path)
    return df.withColumn("file", F.col("_metadata.file_path"))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """file, text: one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """file, modified, length, content, is_pdf (by the first bytes)."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return df.select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"), "length", "content", (F.substring("content", 1, 4) == F.lit(b"%PDF")).alias("is_pdf"))


def elements(files: DataFrame, parse, schema: str = "file string, element_index int, element_type string, page_number int, text string") -> DataFrame:
    """parse(bytes) -> [(type, page, text)]: any parser, run in batches of files."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(f, i, k, p, t) for f, c in zip(pdf["file"], pdf["content"], strict=True) for i, (k, p, t) in enumerate(parse(bytes(c)))], columns=["file", "element_index", "element_type", "page_number", "text"])

    return files.select("file", "content").mapInPandas(run, schema)


def latest(files: DataFrame) -> DataFrame:
    return files.orderBy(F.desc("modified"), "file").limit(1)


def flattened(df: DataFrame, separator: str = ".") -> DataFrame:
    """Struct columns become columns named outer.inner."""
    out = []

    def add(kind, path):
        for f in kind.fields:
            at = [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                add(f.dataType, at)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in at)).alias(separator.join(at)))

    add(df.schema, [])
    return df.select(*out)


def found(df: DataFrame) -> DataFrame:
    """One row: whether there is any."""
    return df.limit(1).agg((F.count("*") > 0).alias("found"))


def counted(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n of each table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def stems(files: DataFrame, file: str) -> DataFrame:
    """The distinct names of files, without folder and extension."""
    return files.select(F.regexp_replace(F.substring_index(file, "/", -1), r"\.[^.]*$", "").alias("stem")).distinct()
