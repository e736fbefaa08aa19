"""Result documents as rows: contexts, JSON, Markdown, answer boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.folders import written


def context(df: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """group, context: 'CHUNK i: text' in order, blank lines between."""
    g = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("x")))).alias("r"))
    lines = F.transform("r", lambda x, i: F.concat(F.lit("CHUNK "), (i + 1).cast("string"), F.lit(": "), x["x"]))
    return g.select(group, F.array_join(lines, "\n\n").alias("context"))


def sections(df: DataFrame, group: str, order: str, title: str, text: str) -> DataFrame:
    g = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(title).alias("t"), F.col(text).alias("x")))).alias("r"))
    return g.select(group, F.array_join(F.transform("r", lambda x: F.concat(F.lit("\n## "), x["t"], F.lit("\n"), x["x"], F.lit("\n"))), "").alias("content"))


def nth_within(df: DataFrame, group: list[str], into: str, *order: Column | str) -> DataFrame:
    """df with `into`: each row's place in its group, from 0. Groups are cut into ranges of rows, so that a hot one is many tasks' work; a range's
    rows are counted, and what stands before it in the group is added."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(n, *group, *order).withColumn("_part", F.spark_partition_id()))
    before = dealt.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    before = before.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_part").alias("_of"), (F.sum("_n").over(Window.partitionBy(*group).orderBy("_part")) - F.col("_n")).alias("_before"))
    placed = dealt.withColumn("_nth", F.row_number().over(Window.partitionBy("_part", *group).orderBy(*order)) - 1)
    same = F.col("_part") == F.col("_of")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return placed.join(before, same).withColumn(into, F.col("_before") + F.col("_nth")).select(*df.columns, into)


def nested_json(df: DataFrame, outer: str, inner: str, order: str, fields: list[str], page: int = 1000) -> DataFrame:
    """outer, inner, page, json: {inner, chunk_count, chunks: [...]} with chunks in order, `page` of them at most in one row."""
    rows = nth_within(df.select(outer, inner, order, *fields), [outer, inner], "page", order, *fields).withColumn("page", F.floor(F.col("page") / page).cast("int"))
    g = rows.groupBy(outer, inner, "page").agg(F.array_sort(F.collect_list(F.struct(F.col(order), *[F.col(f) for f in fields]))).alias("chunks"))
    return g.select(outer, inner, "page", F.to_json(F.struct(F.col(inner), F.size("chunks").alias("chunk_count"), F.col("chunks"))).alias("json"))


def answer_box(label: Column, answer: Column, quote: Column, confidence: Column) -> Column:
    shown = F.when(answer == "yes", "Yes").otherwise("No")
    return F.concat(F.lit("### "), label, F.lit("\nAnswer: "), shown, F.lit("\nQuote: "), F.trim(F.regexp_replace(quote, r"\s+", " ")), F.lit("\nConfidence: "), F.round(confidence * 100, 1).cast("string"), F.lit("%"))


def fill(template: str, **columns: Column) -> Column:
    """The template with {name} replaced by columns."""
    parts, rest = [], template
    while rest:
        before, found, after = rest.partition("{")
        parts.append(F.lit(before))
        if not found:
            break
        name, _, rest = after.partition("}")
        parts.append(F.coalesce(columns[name].cast("string"), F.lit("")))
    return F.concat(*parts)


def answer_with_citations(citations: DataFrame, chunks: DataFrame, cited: str, chunk: str, carried: list[str]) -> DataFrame:
    """Citations with the columns of the chunk they cite; those without a chunk stay, unverified."""
    c = chunks.select(F.col(chunk).alias(cited), *carried, F.lit(True).alias("_v"))
    return citations.join(c, cited, "left").withColumn("verified", F.coalesce("_v", F.lit(False))).drop("_v")


def cited_contents(citations: DataFrame, group: str, text: str, order: list[str]) -> DataFrame:
    """group, nth, text: each content once, in the order in which it is first cited. Copies are summed before any order is made."""
    first = citations.groupBy(group, text).agg(F.min(F.struct(*order)).alias("_o"))
    return nth_within(first, [group], "nth", "_o", text).select(group, (F.col("nth") + 1).cast("int").alias("nth"), text)


def upload_summary(rows: DataFrame, ok: Column, amount: str) -> DataFrame:
    """One row: total, uploaded, failed, and the sum of an amount."""
    good = F.coalesce(ok, F.lit(False)).cast("long")
    return rows.agg(F.count("*").alias("total"), F.sum(good).alias("uploaded"), F.sum(1 - good).alias("failed"), F.sum(amount).alias("chars"))


def with_header(groups: DataFrame, key: str, chunks: str) -> DataFrame:
    """key, json: {"metadata": {key, chunks}, "chunks": [...]}."""
    return groups.select(key, F.to_json(F.struct(F.struct(F.col(key), F.size(chunks).alias("chunks")).alias("metadata"), F.col(chunks).alias("chunks"))).alias("json"))


def markdown(rows: DataFrame, group: str, item: str, value: str) -> DataFrame:
    """group, markdown: a heading and a line for each item, in order."""
    g = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(item, value))).alias("r"))
    lines = F.transform("r", lambda x: F.concat(F.lit("- "), x[item], F.lit(": "), x[value].cast("string")))
    return g.select(group, F.concat(F.lit("# "), F.col(group), F.lit("\n"), F.array_join(lines, "\n")).alias("markdown"))


def html(title: Column, body: Column) -> Column:
    safe = lambda x: F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.concat(F.lit("<h1>"), safe(title), F.lit("</h1><p>"), safe(body), F.lit("</p>"))


def answer_or_error(answer: Column, message: str = "No answer could be given.") -> Column:
    """struct(status, answer): the shape that every question gets, answered or not."""
    return F.struct(F.when(answer.isNull(), "error").otherwise("ok").alias("status"), F.coalesce(answer, F.lit(message)).alias("answer"))


def chain(language: Column, chains: dict[str, str], default: str) -> Column:
    """The name of the chain that takes a language."""
    out = F.lit(default)
    for code, name in chains.items():
        out = F.when(language == code, name).otherwise(out)
    return out


def by_period(rows: DataFrame, group: str, period: str, periods: list[str], item: str, page: int = 1000) -> DataFrame:
    """group, page and a column for each period: its items in order, `page` of them at most in one row."""
    placed = nth_within(rows.where(F.col(period).isin(*periods)).select(group, period, item), [group, period], "page", item).withColumn("page", F.floor(F.col("page") / page).cast("int"))
    own = [F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(period) == p, F.col(item)))), lambda x: x.cast("string")), ", ").alias(p) for p in periods]
    return placed.groupBy(group, "page").agg(*own)
