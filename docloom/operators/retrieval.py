"""Ranking of chunks: vectors, keywords, BM25, fused scores, quotas. Frames are lazy; ties go to the smaller key."""

from __future__ import annotations

import difflib
import functools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.functions.vector import cosine, literal, rounded


def top(df: DataFrame, score: str, key: str, k: int | None) -> DataFrame:
    out = df.orderBy(F.coalesce(F.col(score), F.lit(0.0)).desc(), F.col(key))
    return out if k is None else out.limit(k)


def top_per_group(df: DataFrame, group: list[str], score: str, key: str, n: int) -> DataFrame:
    """The n best of each group; Spark filters before the shuffle (WindowGroupLimit)."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(score), F.col(key)))).where(F.col("rn") <= n)


def similar(df: DataFrame, query: list[float], vector: str = "embedding", into: str = "score") -> DataFrame:
    return df.withColumn(into, rounded(cosine(F.col(vector), literal(query))))


def vector_topk(df: DataFrame, query: list[float], k: int = 10, least: float = 0.1, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    return top(similar(df, query, vector).where(F.col("score") >= least), "score", key, k)


def min_max(df: DataFrame, score: str, into: str | None = None) -> DataFrame:
    """Scaled to 0..1 over the whole frame; 0 where all are equal. One aggregate row is joined back."""
    ends = df.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    return df.join(F.broadcast(ends)).withColumn(into or score, F.when(width == 0, 0.0).otherwise((F.col(score) - F.col("_lo")) / width)).drop("_lo", "_hi")


def over_max(df: DataFrame, score: str) -> DataFrame:
    ends = df.agg(F.max(score).alias("_hi"))
    return df.join(F.broadcast(ends)).withColumn(score, F.when(F.col("_hi") == 0, 0.0).otherwise(F.col(score) / F.col("_hi"))).drop("_hi")


def first_of(df: DataFrame, same: list[str], *order: Column) -> DataFrame:
    """One row for each value of `same`: the first in order. Text is compared by a 256-bit hash, which is what the shuffle sorts by."""
    keys = [F.sha2(F.col(c).cast("binary"), 256) if df.schema[c].dataType.simpleString() == "string" else F.col(c) for c in same]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def keyword_share(text: Column, words: list[str]) -> Column:
    """Share of keywords that stand in the lower-cased text."""
    if not words:
        return F.lit(0.0)
    t = F.lower(text)
    return sum((F.contains(t, F.lit(w.lower())).cast("int") for w in words), F.lit(0)) / F.lit(float(len(words)))


def presence(text: Column, words: list[str]) -> Column:
    t = F.lower(text)
    return sum((F.contains(t, F.lit(w)).cast("int") for w in words), F.lit(0))


def regex_score(text: Column, query: str, lexicon: dict[str, list[str]], numbers: dict[str, str], whole_word: bool = False) -> Column:
    """0.7 * min(matches / 10, 1) + 0.3 * share of query words (over two characters) in the text."""
    keywords = [w for ws in lexicon.values() for w in ws]
    hits = sum((text.rlike(rf"(?i)\b\Q{w}\E\b").cast("int") for w in keywords), F.lit(0)) if whole_word else presence(text, keywords)
    hits = hits + sum((F.regexp_count(text, F.lit(f"(?i){p}")) for p in numbers.values()), F.lit(0))
    words = query.lower().split()
    share = presence(text, [w for w in words if len(w) > 2]) / float(max(len(words), 1))
    return F.lit(0.7) * F.least(hits / 10.0, F.lit(1.0)) + F.lit(0.3) * F.least(share, F.lit(1.0))


def fuzzy_score(text: Column, query: str, boosts: dict[str, tuple[float, list[str]]], count_patterns: bool = False) -> Column:
    """0.4 * coverage (+ 0.6 * share of five pattern hits, if counted), times the boost of every category that matches, at most 1."""
    words = [w for w in query.lower().split() if len(w) > 2]
    t = F.lower(text)
    base = F.lit(0.4) * (presence(text, words) / float(len(words)) if words else F.lit(0.0))
    hits = {c: sum((t.rlike(p).cast("int") for p in ps), F.lit(0)) for c, (_, ps) in boosts.items()}
    if count_patterns:
        base = base + F.lit(0.6) * F.least(sum(hits.values(), F.lit(0)) / 5.0, F.lit(1.0))
    for c, (boost, _) in boosts.items():
        base = base * F.when(hits[c] > 0, boost).otherwise(1.0)
    return F.least(base, F.lit(1.0))


def contextual_score(text: Column, query: str, boosts: dict[str, tuple[float, list[str]]], abbreviations=()) -> Column:
    """0.4 * share of query words that stand as whole words + min(pattern hits / 10, 0.6)."""
    t = X.preprocessed(text, abbreviations)
    words = [w for w in query.lower().split() if len(w) > 2]
    tokens = X.words(t)
    share = sum((F.array_contains(tokens, w).cast("int") for w in words), F.lit(0)) / float(max(len(words), 1))
    hits = sum((F.regexp_count(t, F.lit(p)) for _, ps in boosts.values() for p in ps), F.lit(0))
    return F.lit(0.4) * share + F.least(hits / 10.0, F.lit(0.6))


def highlights(text: Column, query: str, lexicon: dict[str, list[str]], most: int = 10) -> Column:
    """The query words, then `keyword (category)`, that stand in the text."""
    t = F.lower(text)
    pairs = [(w, w) for w in query.lower().split() if len(w) > 2] + [(w, f"{w} ({c})") for c, ws in lexicon.items() for w in ws]
    return F.slice(F.array_compact(F.array(*[F.when(F.contains(t, F.lit(w)), F.lit(shown)) for w, shown in pairs])), 1, most)


def query_types(query: Column, indicators: dict[str, list[str]], most: int = 3, fallback=(("ndc_targets", 1.0), ("emissions_reduction", 0.8))) -> Column:
    """The types of the indicators that stand in the query, two points each: array of (type, score), best first, then as first named."""
    t = F.lower(query)
    order = list(dict.fromkeys(x for ts in indicators.values() for x in ts))
    points = {x: sum((F.contains(t, F.lit(i)).cast("int") for i, ts in indicators.items() if x in ts), F.lit(0)) * 2.0 for x in order}
    rows = F.array(*[F.struct((-p).alias("minus"), F.lit(n).alias("place"), F.lit(x).alias("type")) for n, (x, p) in enumerate(points.items())])
    found = F.transform(F.slice(F.array_sort(F.filter(rows, lambda r: r["minus"] < 0)), 1, most), lambda r: F.struct(r["type"].alias("type"), (-r["minus"]).alias("score")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(*[F.struct(F.lit(a).alias("type"), F.lit(b).alias("score")) for a, b in fallback]))


def weighted_keywords(text: Column, groups: list[tuple[float, list[str]]], confidence: float = 1.0) -> Column:
    """Whole-word counts times the weight of their group, times the type's confidence."""
    total, tokens = F.lit(0.0), X.words(F.lower(text))
    for weight, words in groups:
        single = [w for w in words if " " not in w]
        total = total + F.lit(weight) * F.size(F.filter(tokens, lambda t: t.isin(single)))  # noqa: B023
        for phrase in (w for w in words if " " in w):
            total = total + F.lit(weight) * F.regexp_count(F.lower(text), F.lit(rf"\b\Q{phrase}\E\b"))
    return total * confidence


def bm25(df: DataFrame, query: list[str], key: str, text: str, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """key, score for the documents that hold a query word. White-space tokens of the lower-cased text; negative idfs become epsilon times the
    mean idf of the vocabulary. Document counts and lengths come from one pass over the tokens, summed before their shuffle (the null word stands
    for every document); only a row of statistics and the query's idfs are broadcast."""
    docs = df.select(key, X.whitespace_tokens(F.lower(F.coalesce(F.col(text), F.lit("")))).alias("t"))
    wanted = sorted(set(query))
    length = F.when(F.col("w").isNull(), F.col("dl"))
    seen = docs.select(F.size("t").alias("dl"), F.explode(F.array_append(F.array_distinct("t"), F.lit(None))).alias("w")).groupBy("w").agg(F.count("*").alias("df"), F.sum(length).alias("dl"))
    # words of one df share their idf: a row for each df
    own = [F.max(F.when(F.col("w") == w, F.col("df"))).alias(f"d{i}") for i, w in enumerate(wanted)]
    alike = seen.groupBy("df", F.col("w").isNull().alias("all")).agg(F.count("*").alias("words"), F.max("dl").alias("dl"), *own)
    total = Window.partitionBy()  # as many rows as there are distinct dfs
    n = F.max(F.when(F.col("all"), F.col("df"))).over(total)
    idf = alike.withColumn("n", n).withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    single = F.when(~F.col("all"), F.col("idf"))
    stats = [(F.sum(single * F.col("words")) / F.sum(F.when(~F.col("all"), F.col("words")))).alias("mean"), (F.max(F.when(F.col("all"), F.col("dl"))) / F.max("n")).alias("avgdl")]
    one = F.broadcast(idf.agg(*stats, *[F.max(F.when(F.col(f"d{i}").isNotNull(), F.col("idf"))).alias(f"i{i}") for i in range(len(wanted))]))  # one row
    counts = [F.size(F.filter("t", _is(w))).alias(f"f{i}") for i, w in enumerate(wanted)]
    hits = docs.select(key, F.size("t").alias("dl"), *counts).where(sum((F.col(f"f{i}") for i in range(len(wanted))), F.lit(0)) > 0).join(one)
    score = F.lit(0.0)
    for i in range(len(wanted)):
        tf, weight = F.col(f"f{i}"), F.when(F.col(f"i{i}") < 0, F.lit(epsilon) * F.col("mean")).otherwise(F.col(f"i{i}"))
        score = score + F.when(tf > 0, weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))).otherwise(0.0)
    return hits.groupBy(key).agg(F.round(F.sum(score), 6).alias("score"))


def _is(word: str):
    return lambda t: t == word


def keywords_of_types(types: DataFrame, key: str, keywords: dict[str, list[str]], most: int = 2) -> DataFrame:
    """types: key, type, score. key, keyword for the best `most` types of each key, in the lexicon's order."""
    best = top_per_group(types, [key], "score", "type", most)
    rows = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(i).alias("place"), F.lit(w).alias("keyword")) for t, ws in keywords.items() for i, w in enumerate(ws)])
    return best.select(key, "type").select(key, F.col("type").alias("_of"), F.inline(rows)).where("_of = type").select(key, "type", "place", "keyword")


def expanded(prompt: Column, country: Column, kind: Column, keywords: dict[str, list[str]], general: list[str], most: int = 8, of_general: int = 5) -> Column:
    """The query that is searched for: country, the first keywords of the question's kind (else of the general ones), prompt."""
    named = F.create_map(*[c for k, ws in keywords.items() for c in (F.lit(k), F.lit(" ".join(ws[:most])))])
    return F.concat_ws(" ", country, F.coalesce(F.element_at(named, kind), F.lit(" ".join(general[:of_general]))), prompt)


def most_similar(vocabulary: DataFrame, asked: list[str], k: int = 5, word: str = "word", vector: str = "vector") -> DataFrame:
    """word, near, score, rank: of each asked word the k nearest others. The asked words, a list of the caller's, are broadcast."""
    own = vocabulary.where(F.col(word).isin(asked)).select(F.col(word).alias("_word"), F.col(vector).alias("_vector"))
    rows = vocabulary.join(F.broadcast(own), F.col(word) != F.col("_word")).select(F.col("_word").alias("word"), F.col(word).alias("near"), rounded(cosine(F.col("_vector"), F.col(vector))).alias("score"))
    return top_per_group(rows, ["word"], "score", "near", k).withColumnRenamed("rn", "rank")


def similarity_of_content(asked: DataFrame, chunks: DataFrame, text: str, score: str, key: str) -> DataFrame:
    """asked's rows with the score of the first chunk (by key) whose content is the same, 0 where there is none."""
    first = chunks.groupBy(text).agg(F.min(F.struct(key, score))[score].alias("_s"))
    return asked.join(first, text, "left").withColumn(score, F.coalesce("_s", F.lit(0.0))).drop("_s")


def fused(transformer: Column, word2vec: Column, regex: Column, fuzzy: Column, weights=(0.25, 0.20, 0.30, 0.25)) -> Column:
    return sum((w * c for w, c in zip(weights, (transformer, word2vec, regex, fuzzy), strict=True)), F.lit(0.0))


def hybrid(lexical: Column, vector: Column, alpha: float = 0.5) -> Column:
    return alpha * lexical + (1 - alpha) * vector


def confidence_band(df: DataFrame, group: str, key: str, combined: str, similarity: str, regex: str, fuzzy: str) -> DataFrame:
    """High, Average or Low from the means of each group's five best."""
    five = top_per_group(df, [group], combined, key, 5).groupBy(group).agg(*[F.avg(c).alias(c) for c in (combined, similarity, regex, fuzzy)])

    def over(c, s, r, f):
        return (F.round(F.col(combined), 6) >= c) & ((F.round(F.col(similarity), 6) >= s) | (F.round(F.col(regex), 6) >= r) | (F.round(F.col(fuzzy), 6) >= f))

    return five.withColumn("band", F.when(over(0.75, 0.8, 0.7, 0.7), "High").when(over(0.5, 0.6, 0.4, 0.4), "Average").otherwise("Low"))


def full_text(text: Column, terms: list[str], match: str = "all") -> tuple[Column, Column]:
    """(matches, rank): all or any terms among the words; rank is their share of the text's words."""
    t = X.words(F.lower(text))
    want = F.array(*[F.lit(x.lower()) for x in dict.fromkeys(terms)])
    held = F.size(F.array_intersect(want, t))
    rank = F.size(F.filter(t, lambda w: F.array_contains(want, w))) / F.greatest(F.size(t), F.lit(1))
    return (held == F.size(want)) if match == "all" else (held > 0), rank


def ratio_of(x: str, y: str, least: float) -> float:
    size = len(x) + len(y)
    if size and (2.0 * min(len(x), len(y)) / size < least or 2.0 * sum(min(x.count(c), y.count(c)) for c in set(x)) / size < least):
        return 0.0
    r = difflib.SequenceMatcher(None, x, y).ratio()
    return r if r >= least else 0.0


def ratio_udf(least: float = 0.0):
    """Similarity of two texts as difflib's ratio, in Arrow batches; 0 if it is below `least`, which lengths and counts of
    characters (difflib's upper bounds) mostly tell. Pairs that come again are looked up."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        one = functools.lru_cache(65_536)(lambda x, y: ratio_of(x, y, least))
        return pd.Series([one(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=float)

    return ratio


def token_set_ratio(a: str | None, b: str | None) -> float:
    x, y = (set(re.sub(r"\W", " ", z or "").lower().split()) for z in (a, b))
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = (" ".join(filter(None, (both, " ".join(sorted(z))))) for z in (x - y, y - x))
    if both and (x <= y or y <= x):
        return 1.0
    best = 0.0
    # the most promising by their lengths first; a ratio is at most twice the shorter length over both
    for most, p, q in sorted(((2.0 * min(len(p), len(q)) / (len(p) + len(q)), p, q) for p, q in ((both, left), (both, right), (left, right))), key=lambda o: -o[0]):
        if most > best:
            best = max(best, difflib.SequenceMatcher(None, p, q).ratio())
    return best


def token_set_ratio_udf():
    """0..1: the best ratio among the shared words and each side's words, sorted. Words are lower-cased runs of letters, digits and underscores."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([token_set_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype=float)

    return ratio


def fuzzy_pattern_score(df: DataFrame, text: str, pattern: str, words: list[str], key: str, least: float = 0.6) -> DataFrame:
    """key, score: regex hits, else the best ratio of the words to a word trigram if it reaches `least`, else 0. Only texts without a hit give
    trigrams, each text its distinct ones, and only those whose length lets the ratio reach `least`; rows of one key count as one text's."""
    asked = " ".join(words)
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    rows = df.select(key, F.regexp_count(lower, F.lit(pattern)).cast("double").alias("hits"), lower.alias("_x"))
    able = lambda g: 2 * F.least(F.length(g), F.lit(len(asked))) >= F.lit(least) * (F.length(g) + len(asked))
    grams = rows.where("hits = 0").select(key, F.explode(F.filter(F.array_distinct(X.ngrams(F.col("_x"), 3)), able)).alias("gram"))
    near = grams.select(key, ratio_udf(least)(F.lit(asked), "gram").alias("r")).where("r > 0").groupBy(key).agg(F.max("r").alias("r"))
    best = rows.groupBy(key).agg(F.max("hits").alias("hits")).join(near, key, "left")
    return best.select(key, F.when(F.col("hits") > 0, F.col("hits")).otherwise(F.coalesce("r", F.lit(0.0))).alias("score"))
