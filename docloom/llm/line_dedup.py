"""Line dedup by winnowing over line hashes. DataFrame functions only.

Lines with words are hashed. A window is a shortest run of lines that reaches `least` words: one begins at every line, and one ends at every
line. Of each window the smallest line hash (the last of equals) is selected, and recorded only where the selection changes from one window
to the next. Whatever repeats over `least` words or more holds a whole window, and both places select the same line of it: that is the
guarantee, so only selected positions are joined, by their hash, and only hashes selected at two places or more go on.

A joined position is extended both ways, line by line over the hashes, to every shortest run of `least` words around it that selects it: those
that begin at each line before it and those that end at each line behind it. Two places have a run in common exactly if the hashes of all its
lines agree; a run that stands in a document with a smaller doc_id, or earlier in its own, is a later repeat. Overlapping and adjoining later
runs grow together to the maximal one, whose lines are deleted. (A repeat's last lines lie in runs that end there and begin inside it, as its
first lines do the other way round, so each line of a repeat is in some run.)

A hash that a third of all documents share is a long run of rows on one side of a sort-merge join whose other side has one row for it, which
adaptive execution splits; nothing is paired within a group.

Defined cases: null text stays null; lines without words have no part in windows and go only if they lie inside a deleted run; texts of fewer
words than `least` stay; a very long text is sorted by line within its own rows; a text whose lines all go becomes empty; rows with one doc_id
aren't held against each other, and rows that repeat a doc_id and text are treated alike; of equal places the first stays; a null doc_id comes
before all others; an empty table gives an empty result; extra columns are kept, but for one named as the result's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import LEAST_LONG, WORD, fresh, parts, table, written

LEAST = 50


def _doc():
    return Window.partitionBy("d", "t")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _reach(least: int) -> tuple:
    """Windows over a document's lines: the shortest run of `least` words from a line on, and up to a line."""
    return _doc().orderBy("start").rangeBetween(0, least - 1), _doc().orderBy("end").rangeBetween(-(least - 1), 0)


def selections(docs: DataFrame, least: int = LEAST, text: str = "text") -> DataFrame:
    """A row for each line with words: d (doc_id, null as the least long), t (hash of the text), p (line number), h (hash), start and end (words
    before it, and up to its end); ahead, behind: struct(h, np: the line number negated) of the line that the window from here on, and the one
    up to here, selects, where that isn't the one selected before."""
    own = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_LONG)).alias("d"), F.xxhash64(text).alias("t"), F.posexplode(_lines(F.col(text))).alias("p", "line"))
    hashed = own.select("d", "t", "p", F.xxhash64("line").alias("h"), F.regexp_count("line", F.lit(WORD)).alias("w")).where("w > 0")
    # repeated rows fall together here; everything up to the result stays in this partitioning
    hashed = hashed.repartition(parts(docs.sparkSession), "d", "t").groupBy("d", "t", "p").agg(F.min("h").alias("h"), F.min("w").alias("w"))
    ended = hashed.withColumn("end", F.sum("w").over(_doc().orderBy("p").rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("end") - F.col("w")).drop("w")
    ahead, behind = _reach(least)
    least_of = F.min(F.struct("h", (-F.col("p")).alias("np")))
    both = ended.withColumns({"a": least_of.over(ahead), "ae": F.max("end").over(ahead), "b": least_of.over(behind), "bs": F.min("start").over(behind)})
    both = both.withColumns({"a": F.when(F.col("ae") - F.col("start") >= least, F.col("a")), "b": F.when(F.col("end") - F.col("bs") >= least, F.col("b"))}).drop("ae", "bs")
    new = lambda c, order: F.when(~F.col(c).eqNullSafe(F.lag(c).over(_doc().orderBy(order))), F.col(c))
    return both.select("d", "t", "p", "h", "start", "end", new("a", "start").alias("ahead"), new("b", "end").alias("behind"))


def joined_positions(lines: DataFrame) -> DataFrame:
    """d, t, p of the selected positions whose hash is selected elsewhere too."""
    found = lines.select("d", "t", F.inline(F.filter(F.array("ahead", "behind"), lambda x: x.isNotNull()))).withColumn("p", -F.col("np")).drop("np")
    place = F.struct("d", "t", "p")
    often = found.groupBy("h").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low <> high").select("h")
    return found.join(often, "h", "left_semi").select("d", "t", "p")


def extended(lines: DataFrame, positions: DataFrame, least: int = LEAST) -> DataFrame:
    """The runs around joined positions: d, t, fingerprint, lines (hash of the run's lines), first, last (line numbers), and again: the run has
    stood earlier in the document. Documents without a joined position aren't looked at again."""
    none = F.lit(None).cast("long")
    marked = positions.select("d", "t", "p", none.alias("h"), none.alias("start"), none.alias("end"), F.lit(1).alias("joined"))
    rows = lines.select("d", "t", "p", "h", "start", "end", F.lit(0).alias("joined")).unionByName(marked).repartition(parts(lines.sparkSession), "d", "t")
    rows = rows.groupBy("d", "t", "p").agg(*[F.max(c).alias(c) for c in ("h", "start", "end", "joined")])
    rows = rows.withColumn("any", F.max("joined").over(_doc())).where("any = 1").drop("any")
    ahead, behind = _reach(least)
    selected = F.min(F.struct("h", (-F.col("p")).alias("np"), "joined"))
    both = rows.select(
        "d", "t", "p", "start", "end",
        selected.over(ahead).alias("a"), F.collect_list("h").over(ahead).alias("al"), F.max("p").over(ahead).alias("ap"), F.max("end").over(ahead).alias("ae"),
        selected.over(behind).alias("b"), F.collect_list("h").over(behind).alias("bl"), F.min("p").over(behind).alias("bp"), F.min("start").over(behind).alias("bs"),
    )
    run = lambda s, hashes, first, last: F.struct(F.col(f"{s}.h").alias("fingerprint"), F.xxhash64(hashes).alias("lines"), F.col(first).alias("first"), F.col(last).alias("last"))
    forward = F.when((F.col("a.joined") == 1) & (F.col("ae") - F.col("start") >= least), run("a", "al", "p", "ap"))
    backward = F.when((F.col("b.joined") == 1) & (F.col("end") - F.col("bs") >= least), run("b", "bl", "bp", "p"))
    out = both.select("d", "t", F.inline(F.array_distinct(F.filter(F.array(forward, backward), lambda x: x.isNotNull()))))
    return out.withColumn("again", F.col("first") > F.min("first").over(Window.partitionBy("d", "t", "fingerprint", "lines")))


def repeated_runs(docs: DataFrame, least: int = LEAST, text: str = "text") -> DataFrame:
    """d, t, runs: array of (first, last) line numbers to delete, disjoint and in order."""
    lines = written(selections(docs, least, text), "lines")
    found = written(extended(lines, joined_positions(lines), least), "runs")
    firsts = found.where("not again").groupBy("fingerprint", "lines").agg(F.min("d").alias("first_d"), F.max("d").alias("last_d")).where("first_d < last_d").select("fingerprint", "lines", "first_d")
    firsts = written(firsts, "firsts")
    later = found.where("not again").join(firsts, ["fingerprint", "lines"]).where("d > first_d").select("d", "t", "first", "last")
    marked = later.unionByName(found.where("again").select("d", "t", "first", "last"))
    # overlapping and adjoining windows grow together
    doc = Window.partitionBy("d", "t").orderBy("first", "last")
    apart = F.col("first") > F.coalesce(F.max("last").over(doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-2)) + 1
    runs = marked.withColumn("apart", apart.cast("int")).withColumn("run", F.sum("apart").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("d", "t", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return runs.groupBy("d", "t").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))


def without_runs(text: Column, runs: Column) -> Column:
    """text without the lines of runs. The text is split once: the lines are the lambda's variable."""

    def kept(lines):
        bound = F.concat(F.transform(runs, lambda r: r["first"]), F.array(F.size(lines)))

        def between(first, i):
            after = F.when(i == 0, F.lit(0)).otherwise(F.get(runs, i - 1)["last"] + 1)
            return F.slice(lines, after + 1, first - after)

        return F.array_join(F.flatten(F.transform(bound, between)), "\n")

    return F.get(F.transform(F.array(_lines(text)), kept), F.lit(0))


def deduplicated(docs: DataFrame, least: int = LEAST, text: str = "text", runs: str = "runs") -> DataFrame:
    """docs' columns, text without later repeated runs, and runs (null if nothing was deleted) in place of a column of that name."""
    docs = docs.drop(runs)
    k, d, t, r = fresh(docs, "_k", "_d", "_t", "_runs")
    gone = repeated_runs(docs, least, text).select(F.col("d").alias(d), F.col("t").alias(t), F.col("runs").alias(r))
    joined = docs.withColumn(k, F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_LONG))).join(gone, (F.col(k) == F.col(d)) & (F.xxhash64(text) == F.col(t)), "left")
    return joined.withColumn(text, F.when(F.col(r).isNotNull(), without_runs(F.col(text), F.col(r))).otherwise(F.col(text))).drop(k, d, t).withColumnRenamed(r, runs)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines (of the document), n_deleted, and the SHA-256 of what stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.size(_lines(F.col("text"))).cast("long").alias("n_lines"))
    out = deduplicated(docs)
    gone = F.aggregate(F.coalesce("runs", F.array().cast("array<struct<first:int,last:int>>")), F.lit(0).cast("long"), lambda n, r: n + (r["last"] - r["first"] + 1))
    return out.select("doc_id", "n_lines", gone.alias("n_deleted"), F.sha2("text", 256).alias("kept_sha256"))
