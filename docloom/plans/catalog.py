"""The registered queries over the driver's tables, with the SQL that checks them. Lexicons here are words that the tables hold."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.functions import vector as V
from docloom.operators import changes, chunk_table, chunking, embedding, evaluation, extract, fulltext, graph, knn, report, retrieval, rounds, vector_index
from docloom.operators.folders import shared, written
from docloom.sources import readers
from docloom.sources.readers import table
from docloom.streaming import feeds, rescrape

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

QUERY = "the and from with ouen this"
WORDS = ["the", "and", "with", "ouen", "que"]
LEXICON = {"short": ["the", "and", "of"], "long": ["with", "from", "tion"], "other": ["der", "que", "les"]}
NUMBERS = {"year": r"20[0-9]{2}", "number": r"[0-9]+"}
BOOSTS = {"plain": (1.0, [r"(?:the|and)\s+of"]), "strong": (1.2, [r"with\s+the"]), "other": (1.1, [r" que ", r" der "])}
RELATIONS = {"SUPPORTS": [(r"with [a-z]+ing", r"the|and", 0.8), (r"from", r"this", 0.6)], "EXPLAINS": [(r"that is", r"which", 0.6), (r"of the", r"for the", 0.6)], "FOLLOWS": [(r"die", r"der", 0.6), (r"les", r"des", 0.8)]}
INDICATORS = {"the": ["articles"], "and": ["joins", "articles"], "with": ["ties"], "que": ["romance"], "der": ["german"]}
NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
MIN_EDGE, NEIGHBOURS = 0.55, 30


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from docloom.plans import records  # noqa: F401  registers its queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def _vector(spark, d, vec_id: int) -> list[float]:
    """The vector of a row; without that row one of no length, which is like nothing."""
    row = table(spark, d, "embeddings").where((F.col("vec_id") == vec_id) & F.col("embedding").isNotNull()).select("embedding").first()
    return list(row[0]) if row else []


def _docs(spark, d):
    return table(spark, d, "documents")


_COS = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"
_Q0 = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
_TOKENS = r"list_filter(string_split_regex(trim(lower(text)), '\s+'), lambda w: w <> '')"
_HAS = " + ".join(f"contains(lower(text), '{w}')::INT" for w in WORDS)

# -- scans, projections, filters


@query("SELECT doc_id, lang, text FROM documents WHERE lang = 'en'")
def scan_filtered(spark, d):
    return _docs(spark, d).where(F.col("lang") == "en").select("doc_id", "lang", "text")


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND trim(text) <> ''")
def scan_non_blank(spark, d):
    return readers.non_blank(_docs(spark, d), "text").select("doc_id", "text")


@query("SELECT d.doc_id FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id WHERE e.embedding IS NULL")
def scan_missing_embedding(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return readers.missing(_docs(spark, d).select("doc_id").join(e, "doc_id", "left"), "embedding").select("doc_id")


@query("SELECT doc_id, source FROM documents WHERE regexp_matches(source, 'src1[0-9]')")
def scan_regex(spark, d):
    return _docs(spark, d).where(F.col("source").rlike("src1[0-9]")).select("doc_id", "source")


@query("SELECT doc_id, lang FROM documents WHERE lower(lang) = lower('EN') AND source IN ('src1', 'src2', 'src3')")
def predicates(spark, d):
    return _docs(spark, d).where((F.lower("lang") == F.lower(F.lit("EN"))) & F.col("source").isin("src1", "src2", "src3")).select("doc_id", "lang")


@query(r"""SELECT doc_id, (text IS NOT NULL AND length(trim(text)) > 10 AND NOT regexp_matches(trim(text), '^[0-9]+(\.[0-9]+)?$') AND NOT starts_with(trim(text), '[')) AS usable FROM documents""")
def text_validity(spark, d):
    return _docs(spark, d).select("doc_id", F.coalesce(X.usable(F.col("text")), F.lit(False)).alias("usable"))


@query(r"""SELECT doc_id, line_no, trim(line) AS part FROM (SELECT doc_id, unnest(range(0, len(ls)))::INT AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE NOT (length(trim(line)) < 10 OR regexp_matches(trim(line), '^([0-9]+|[ivxlcdmIVXLCDM]+|[^\p{L}\p{N}]+|(?i:page)\s+[0-9]+.*)$'))""")
def element_filter(spark, d):
    lines = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.where(~X.skipped_element(F.col("line"))).select("doc_id", "line_no", F.trim("line").alias("part"))


@query("SELECT doc_id, concat_ws('_', source, coalesce(lang, 'en'), coalesce(strftime(DATE '2024-01-01' + (doc_id % 365)::INT, '%Y%m%d'), 'unknown_date')) AS file_id FROM documents")
def composed_ids(spark, d):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int"))
    return _docs(spark, d).select("doc_id", F.concat_ws("_", "source", F.coalesce("lang", F.lit("en")), F.coalesce(F.date_format(day, "yyyyMMdd"), F.lit("unknown_date"))).alias("file_id"))


@query("SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9_-]', '_', 'g') AS tag, length(html) AS n FROM pages")
def sanitised_tags(spark, d):
    return table(spark, d, "pages").select("page_id", X.tag(F.col("url")).alias("tag"), F.length("html").cast("long").alias("n"))


# -- text functions


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+'))::BIGINT AS n_words, len(" + _TOKENS + ")::BIGINT AS n_tokens FROM documents")
def token_counts(spark, d):
    t = F.col("text")
    return _docs(spark, d).select("doc_id", F.size(X.words(t)).cast("long").alias("n_words"), F.size(X.whitespace_tokens(F.lower(t))).cast("long").alias("n_tokens"))


@query(r"""SELECT doc_id, count(*)::BIGINT AS n_grams, min(g) AS first_gram FROM (SELECT doc_id, unnest(CASE WHEN len(t) < 3 THEN [array_to_string(t, ' ')] ELSE list_transform(range(0, len(t) - 2), lambda i: array_to_string(list_slice(t, i + 1, i + 3), ' ')) END) AS g FROM (SELECT doc_id, """ + _TOKENS + """ AS t FROM documents)) GROUP BY doc_id""")
def ngrams(spark, d):
    # counted where they are read: no gram is shuffled
    rows = _docs(spark, d).select("doc_id", F.inline(F.transform(F.array(X.ngrams(F.lower("text"), 3)), lambda g: F.struct(F.size(g).cast("long").alias("n"), F.array_min(g).alias("g")))))
    return rows.where("n > 0").groupBy("doc_id").agg(F.sum("n").alias("n_grams"), F.min("g").alias("first_gram"))


@query(r"""SELECT doc_id, chunk_index, content FROM (SELECT doc_id, unnest(range(0, len(ss), 2)) AS i, ss FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM documents)), LATERAL (SELECT (i // 2)::INT AS chunk_index, array_to_string(list_slice(ss, i + 1, i + 3), ' ') AS content)""")
def sentence_windows(spark, d):
    return chunking.sentence_windows(_docs(spark, d))


@query(r"""WITH c AS (SELECT doc_id, text, len(regexp_extract_all(text, '\(cid:[0-9]+\)')) AS cids, len(""" + _TOKENS + r""") AS n FROM documents)
SELECT doc_id, (cids * 10 > n) AS mild, (length(text) < 10 OR (n > 0 AND cids / n > 0.3) OR (length(text) > 20 AND len(regexp_extract_all(text, '[a-zA-Z0-9àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞß\s.,;:!?()\-''"]')) / length(text) < 0.4) OR length(text) - length(replace(text, chr(65533), '')) >= 3) AS severe FROM c""")
def corruption_flags(spark, d):
    t = F.col("text")
    return _docs(spark, d).select("doc_id", X.mildly_corrupted(t).alias("mild"), X.severely_corrupted(t).alias("severe"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(replace(regexp_replace(text, '\(cid:[0-9]+\)', ' ', 'g'), chr(65533), ' '), '[\x00-\x08\x0E-\x1F\x7F]', ' ', 'g'), '\s+', ' ', 'g')) AS cleaned FROM documents""")
def clean_text(spark, d):
    return _docs(spark, d).select("doc_id", X.cleaned(F.col("text"), runs=False).alias("cleaned"))


@query()
def gibberish_removed(spark, d):
    return X.gibberish_dropped(readers.dealt(_docs(spark, d).select("doc_id", "text"), "doc_id"), "text", "content").select("doc_id", "content")


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(text)), '\s+', ' ', 'g'), '[^\p{L}\p{N}_\s\-.,:;()%$]', ' ', 'g'), '\bthe\b', 'article', 'g') AS prepared FROM documents""")
def preprocessed(spark, d):
    return _docs(spark, d).select("doc_id", X.preprocessed(F.col("text"), [("the", "article")]).alias("prepared"))


@query("""SELECT event_id, (props->>'k')::BIGINT AS k, event_type FROM events WHERE (props->>'k')::BIGINT IS NOT NULL""")
def json_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type").where("k is not null")


@query("""SELECT doc_id, CASE WHEN contains(upper(text), 'YES') AND NOT contains(upper(text), 'NO') THEN 'YES' WHEN contains(upper(text), 'NO') THEN 'NO' ELSE 'UNCLEAR' END AS verdict, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS shown FROM documents""")
def verdicts(spark, d):
    return _docs(spark, d).select("doc_id", X.verdict(F.col("text")).alias("verdict"), X.shortened(F.col("text")).alias("shown"))


_H = f"sha1(unhex('{NAMESPACE.replace('-', '')}') || encode(url))"


@query(f"""SELECT page_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM (SELECT page_id, {_H} AS h FROM pages)""")
def uuid5_ids(spark, d):
    return table(spark, d, "pages").select("page_id", changes.uuid5(NAMESPACE, F.col("url")).alias("id"))


@query("SELECT lang, count(*)::BIGINT AS n FROM (SELECT CASE WHEN b = 0 THEN 'en' WHEN en = b THEN 'en' WHEN de = b THEN 'de' WHEN fr = b THEN 'fr' ELSE 'es' END AS lang FROM (SELECT *, greatest(en, de, fr, es) AS b FROM (SELECT "
       + ", ".join(f"len(list_filter(t, lambda w: w IN ({', '.join(repr(x) for x in ws)}))) AS {n}" for n, ws in {"en": ["the", "and"], "de": ["der", "und"], "fr": ["les", "des"], "es": ["los", "las"]}.items())
       + r" FROM (SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM documents)))) GROUP BY 1")
def language_votes(spark, d):
    votes = {"en": ["the", "and"], "de": ["der", "und"], "fr": ["les", "des"], "es": ["los", "las"]}
    return _docs(spark, d).select(X.stop_word_language(F.col("text"), votes).alias("lang")).groupBy("lang").agg(F.count("*").alias("n"))


# -- vectors


@query(f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q0}::DOUBLE[]), 6) AS score FROM embeddings WHERE round(list_cosine_similarity(embedding::DOUBLE[], {_Q0}::DOUBLE[]), 6) >= 0.1 ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk(spark, d):
    return retrieval.vector_topk(table(spark, d, "embeddings"), _vector(spark, d, 0)).select("vec_id", "score")


@query(f"SELECT label, vec_id, score, rn FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id)::INT AS rn FROM (SELECT label, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q0}::DOUBLE[]), 6) AS score FROM embeddings)) WHERE rn <= 3")
def vector_topk_per_group(spark, d):
    rows = retrieval.similar(table(spark, d, "embeddings"), _vector(spark, d, 0))
    return retrieval.top_per_group(rows, ["label"], "score", "vec_id", 3).select("label", "vec_id", "score", "rn")


@query(f"SELECT e.vec_id, d.source, round(list_cosine_similarity(embedding::DOUBLE[], {_Q0}::DOUBLE[]), 6) AS score FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id WHERE d.lang = 'en' ORDER BY score DESC, e.vec_id LIMIT 10")
def vector_topk_filtered(spark, d):
    docs = _docs(spark, d).where("lang = 'en'").select(F.col("doc_id").alias("vec_id"), "source")
    return retrieval.top(retrieval.similar(table(spark, d, "embeddings").join(docs, "vec_id"), _vector(spark, d, 0)), "score", "vec_id", 10).select("vec_id", "source", "score")


@query(f"SELECT d.doc_id, coalesce(round(list_cosine_similarity(embedding::DOUBLE[], {_Q0}::DOUBLE[]), 6), 0.0) AS score FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def vector_batch_default(spark, d):
    scored = retrieval.similar(table(spark, d, "embeddings"), _vector(spark, d, 0)).select(F.col("vec_id").alias("doc_id"), "score")
    return _docs(spark, d).select("doc_id").join(scored, "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


_SCORED = f"SELECT d.doc_id, d.text, round(list_cosine_similarity(e.embedding::DOUBLE[], {_Q0}::DOUBLE[]), 6) AS s0, round(list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 1)::DOUBLE[]), 6) AS s1 FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id WHERE length(trim(d.text)) > 10"


@query(f"""WITH s AS ({_SCORED}), m AS (SELECT *, CASE WHEN max(s0) OVER () = min(s0) OVER () THEN 0.0 ELSE (s0 - min(s0) OVER ()) / (max(s0) OVER () - min(s0) OVER ()) END AS score FROM s)
SELECT doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY score DESC, doc_id) AS n FROM m) WHERE n = 1 ORDER BY score DESC, doc_id LIMIT 25""")
def vector_minmax_dedup(spark, d):
    rows = retrieval.min_max(_two_scores(spark, d), "s0", "score")
    best = retrieval.first_of(rows, ["text"], F.desc("score"), F.col("doc_id"))
    return retrieval.top(best.select("doc_id", F.round("score", 6).alias("score")), "score", "doc_id", 25)


def _two_scores(spark, d):
    docs = _docs(spark, d).where(F.length(F.trim("text")) > 10).select(F.col("doc_id"), "text")
    e = table(spark, d, "embeddings")
    e = retrieval.similar(retrieval.similar(e, _vector(spark, d, 0), into="s0"), _vector(spark, d, 1), into="s1").select(F.col("vec_id").alias("doc_id"), "s0", "s1")
    return docs.join(e, "doc_id")


@query(f"""WITH s AS ({_SCORED}), m AS (SELECT doc_id, text, (s0 - min(s0) OVER ()) / (max(s0) OVER () - min(s0) OVER ()) AS a, (s1 - min(s1) OVER ()) / (max(s1) OVER () - min(s1) OVER ()) AS b FROM s)
SELECT doc_id, round((a + b) / 2, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY (a + b) / 2 DESC, doc_id) AS n FROM m) WHERE n = 1 ORDER BY score DESC, doc_id LIMIT 20""")
def two_vector_average(spark, d):
    rows = retrieval.min_max(retrieval.min_max(_two_scores(spark, d), "s0", "a"), "s1", "b").withColumn("score", (F.col("a") + F.col("b")) / 2)
    best = retrieval.first_of(rows, ["text"], F.desc("score"), F.col("doc_id"))
    return retrieval.top(best.select("doc_id", F.round("score", 6).alias("score")), "score", "doc_id", 20)


_KNN = f"SELECT source, target, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, target)::INT AS rank FROM (SELECT a.vec_id AS source, b.vec_id AS target, {_COS} AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)) WHERE rank <= "


def _pairs(spark, d, k: int):
    e = table(spark, d, "embeddings")
    return knn.nearest(e, e, k, "vec_id", "embedding", least_dims=10)


@query(f"{_KNN}5")
def knn_self(spark, d):
    return _pairs(spark, d, 5)


@query("SELECT source, target, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score, target)::INT AS rank FROM (SELECT a.vec_id AS source, b.vec_id AS target, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)) WHERE rank <= 4")
def knn_euclidean(spark, d):
    e = table(spark, d, "embeddings")
    return knn.nearest(e, e, 4, "vec_id", "embedding", "euclidean", 10)


@query(f"SELECT source, target, score, rank FROM ({_KNN}5) WHERE source % 20 = 0")
def ivf_topk(spark, d):
    e = table(spark, d, "embeddings")
    return vector_index.search(vector_index.build(e, "vec_id", "embedding"), e.where("vec_id % 20 = 0"), "vec_id", "embedding", 5)


@query(f"{_KNN}3")
def ivf_graph(spark, d):
    e = table(spark, d, "embeddings")
    return vector_index.search(vector_index.build(e, "vec_id", "embedding"), e, "vec_id", "embedding", 3)


@query("SELECT count(*)::BIGINT AS n, sum((len(list_filter(embedding, lambda x: x <> 0)) = 0)::INT)::BIGINT AS n_zero, max(len(embedding))::INT AS dims FROM embeddings")
def zero_vectors(spark, d):
    return table(spark, d, "embeddings").agg(F.count("*").alias("n"), F.sum(V.is_zero(F.col("embedding")).cast("long")).alias("n_zero"), F.max(F.size("embedding")).alias("dims"))


@query("SELECT vec_id, list_transform(embedding, lambda x: trunc(x::DOUBLE * 10000)::BIGINT) AS q FROM embeddings")
def quantised_vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", V.quantised(F.col("embedding")).alias("q"))


@query("SELECT vec_id, list_transform(range(0, 4), lambda d: round(list_sum(list_transform(list_filter(range(0, 16), lambda i: i % 3 <> 0), lambda i: embedding[i * 4 + d + 1]::DOUBLE)) / 10, 6)) AS pooled FROM embeddings")
def pooled_vectors(spark, d):
    places = F.sequence(F.lit(0), F.lit(15))
    tokens, mask = F.transform(places, lambda i: F.slice("embedding", i * 4 + 1, 4)), F.transform(places, lambda i: (i % 3 != 0).cast("int"))
    return table(spark, d, "embeddings").select("vec_id", F.transform(V.pooled(tokens, mask), lambda x: V.rounded(x)).alias("pooled"))


@query("SELECT label, dim, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(0, len(embedding)))::INT AS dim FROM embeddings) GROUP BY label, dim")
def mean_vectors(spark, d):
    return table(spark, d, "embeddings").select("label", F.posexplode(V.doubles(F.col("embedding"))).alias("dim", "x")).groupBy("label", "dim").agg(V.rounded(F.avg("x")).alias("mean"))


# -- lexical and fused ranking


@query(f"SELECT doc_id, round(({_HAS}) / {float(len(WORDS))}, 6) AS score FROM documents ORDER BY score DESC, doc_id LIMIT 20")
def boolean_search(spark, d):
    return retrieval.top(_docs(spark, d).select("doc_id", F.round(retrieval.keyword_share(F.col("text"), WORDS), 6).alias("score")), "score", "doc_id", 20)


_BM25 = r"""tokens AS (SELECT doc_id, unnest(""" + _TOKENS + r""") AS w FROM documents), dl AS (SELECT doc_id, len(""" + _TOKENS + r""") AS dl FROM documents),
tf AS (SELECT doc_id, w, count(*) AS f FROM tokens GROUP BY 1, 2), stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
idf0 AS (SELECT w, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT w, count(*) AS df FROM tf GROUP BY 1), stats), mean AS (SELECT avg(idf) AS m FROM idf0),
bm AS (SELECT tf.doc_id, round(sum((CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN idf0 USING (w) JOIN dl ON dl.doc_id = tf.doc_id, stats, mean WHERE w IN ('the', 'and', 'with', 'ouen', 'que') GROUP BY 1)"""


def _bm25(spark, d):
    return retrieval.bm25(_docs(spark, d), WORDS, "doc_id", "text")


@query(f"WITH {_BM25} SELECT doc_id, CASE WHEN (SELECT max(score) FROM bm) = 0 THEN 0.0 ELSE round(score / (SELECT max(score) FROM bm), 6) END AS score FROM bm ORDER BY score DESC, doc_id LIMIT 25")
def bm25_topk(spark, d):
    s = retrieval.over_max(_bm25(spark, d), "score").select("doc_id", F.round("score", 6).alias("score"))
    return retrieval.top(s, "score", "doc_id", 25)


@query(f"WITH {_BM25}, v AS (SELECT vec_id AS doc_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q0}::DOUBLE[]), 6) AS s FROM embeddings) SELECT v.doc_id, round(0.5 * coalesce(score / (SELECT max(score) FROM bm), 0.0) + 0.5 * s, 6) AS score FROM v LEFT JOIN bm USING (doc_id) ORDER BY score DESC, doc_id LIMIT 25")
def hybrid_topk(spark, d):
    lexical = retrieval.over_max(_bm25(spark, d), "score").withColumnRenamed("score", "b")
    vectors = retrieval.similar(table(spark, d, "embeddings"), _vector(spark, d, 0), into="s").select(F.col("vec_id").alias("doc_id"), "s")
    both = vectors.join(lexical, "doc_id", "left").select("doc_id", F.round(retrieval.hybrid(F.coalesce("b", F.lit(0.0)), F.col("s")), 6).alias("score"))
    return retrieval.top(both, "score", "doc_id", 25)


def _sql_presence(words):
    return " + ".join(f"contains(lower(text), '{w}')::INT" for w in words)


_QW = [w for w in QUERY.split() if len(w) > 2]
_REGEX_SQL = f"0.7 * least((({_sql_presence([w for ws in LEXICON.values() for w in ws])}) + " + " + ".join(f"len(regexp_extract_all(text, '(?i){p}'))" for p in NUMBERS.values()) + f") / 10.0, 1.0) + 0.3 * least(({_sql_presence(_QW)}) / {float(len(QUERY.split()))}, 1.0)"


@query(f"SELECT doc_id, round({_REGEX_SQL}, 6) AS score FROM documents")
def regex_score(spark, d):
    return _docs(spark, d).select("doc_id", F.round(retrieval.regex_score(F.col("text"), QUERY, LEXICON, NUMBERS), 6).alias("score"))


_FUZZY_SQL = f"least(0.4 * (({_sql_presence(_QW)}) / {float(len(_QW))})" + "".join(" * (CASE WHEN " + " OR ".join(f"regexp_matches(lower(text), '{p}')" for p in ps) + f" THEN {b} ELSE 1.0 END)" for b, ps in BOOSTS.values()) + ", 1.0)"


@query(f"SELECT doc_id, round({_FUZZY_SQL}, 6) AS score FROM documents")
def fuzzy_coverage(spark, d):
    return _docs(spark, d).select("doc_id", F.round(retrieval.fuzzy_score(F.col("text"), QUERY, BOOSTS), 6).alias("score"))


_FUSED_SQL = f"SELECT d.doc_id, d.source, round(0.25 * s0 + 0.20 * s1 + 0.30 * ({_REGEX_SQL.replace('text', 'd.text')}) + 0.25 * ({_FUZZY_SQL.replace('text', 'd.text')}), 6) AS combined, s0 AS similarity, round({_REGEX_SQL.replace('text', 'd.text')}, 6) AS regex, round({_FUZZY_SQL.replace('text', 'd.text')}, 6) AS fuzzy FROM documents d JOIN (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q0}::DOUBLE[]), 6) AS s0, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 1)::DOUBLE[]), 6) AS s1 FROM embeddings) e ON e.vec_id = d.doc_id"


def _fused(spark, d):
    e = retrieval.similar(retrieval.similar(table(spark, d, "embeddings"), _vector(spark, d, 0), into="s0"), _vector(spark, d, 1), into="s1").select(F.col("vec_id").alias("doc_id"), "s0", "s1")
    docs = _docs(spark, d).select("doc_id", "source", retrieval.regex_score(F.col("text"), QUERY, LEXICON, NUMBERS).alias("r"), retrieval.fuzzy_score(F.col("text"), QUERY, BOOSTS).alias("f")).join(e, "doc_id")
    return docs.select("doc_id", "source", F.round(retrieval.fused(F.col("s0"), F.col("s1"), F.col("r"), F.col("f")), 6).alias("combined"), F.col("s0").alias("similarity"), F.round("r", 6).alias("regex"), F.round("f", 6).alias("fuzzy"))


@query(f"SELECT doc_id, source, combined FROM ({_FUSED_SQL}) WHERE combined >= 0.2 ORDER BY combined DESC, doc_id LIMIT 20")
def fused_topk(spark, d):
    return retrieval.top(_fused(spark, d).where("combined >= 0.2").select("doc_id", "source", "combined"), "combined", "doc_id", 20)


@query(f"SELECT doc_id, source, combined FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY combined DESC, doc_id) AS rn FROM ({_FUSED_SQL})) WHERE rn <= 2 ORDER BY combined DESC, doc_id LIMIT 20")
def quota_topk(spark, d):
    few = retrieval.top_per_group(_fused(spark, d), ["source"], "combined", "doc_id", 2)
    return retrieval.top(few.select("doc_id", "source", "combined"), "combined", "doc_id", 20)


@query(f"""SELECT source, CASE WHEN c >= 0.75 AND (s >= 0.8 OR r >= 0.7 OR f >= 0.7) THEN 'High' WHEN c >= 0.5 AND (s >= 0.6 OR r >= 0.4 OR f >= 0.4) THEN 'Average' ELSE 'Low' END AS band FROM (SELECT source, round(avg(combined), 6) AS c, round(avg(similarity), 6) AS s, round(avg(regex), 6) AS r, round(avg(fuzzy), 6) AS f FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY combined DESC, doc_id) AS rn FROM ({_FUSED_SQL})) WHERE rn <= 5 GROUP BY source)""")
def confidence_band(spark, d):
    return retrieval.confidence_band(_fused(spark, d), "source", "doc_id", "combined", "similarity", "regex", "fuzzy").select("source", "band")


@query("SELECT item_id, type, score FROM (SELECT item_id, type, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, place) AS rn FROM (SELECT item_id, v.place, v.type, 2.0::DOUBLE * sum(contains(lower(text), v.word)::INT) AS score FROM benchmark, (VALUES (0, 'articles', 'the'), (0, 'articles', 'and'), (1, 'joins', 'and'), (2, 'ties', 'with'), (3, 'romance', 'que'), (4, 'german', 'der')) AS v(place, type, word) GROUP BY 1, 2, 3) WHERE score > 0) WHERE rn <= 3")
def query_type(spark, d):
    types = retrieval.query_types(F.col("text"), INDICATORS, fallback=(("none", 0.0),))
    return table(spark, d, "benchmark").select("item_id", F.inline(F.filter(types, lambda x: x["score"] > 0)))


@query(r"SELECT doc_id, round((2.0 * len(list_filter(t, lambda w: w IN ('the', 'der'))) + 1.5 * len(list_filter(t, lambda w: w IN ('and', 'und'))) + 1.2 * len(list_filter(t, lambda w: w IN ('of', 'von')))) * 2.0, 6) AS score FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM documents)")
def weighted_keywords(spark, d):
    groups = [(2.0, ["the", "der"]), (1.5, ["and", "und"]), (1.2, ["of", "von"])]
    return _docs(spark, d).select("doc_id", F.round(retrieval.weighted_keywords(F.col("text"), groups, 2.0), 6).alias("score"))


@query("SELECT doc_id, list_slice(list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), '{w}') THEN '{s}' END" for w, s in [(w, w) for w in _QW] + [(w, f"{w} ({c})") for c, ws in LEXICON.items() for w in ws]) + "], lambda x: x IS NOT NULL), 1, 10) AS shown FROM documents")
def keyword_highlights(spark, d):
    return _docs(spark, d).select("doc_id", retrieval.highlights(F.col("text"), QUERY, LEXICON).alias("shown"))


@query(r"SELECT doc_id, round(0.4 * ((" + " + ".join(rf"list_contains(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+'), '{w}')::INT" for w in _QW) + f") / {float(len(_QW))}) + least((" + " + ".join(f"len(regexp_extract_all(t, '{p}'))" for _, ps in BOOSTS.values() for p in ps) + r") / 10.0, 0.6), 6) AS score FROM (SELECT doc_id, regexp_replace(regexp_replace(lower(trim(text)), '\s+', ' ', 'g'), '[^\p{L}\p{N}_\s\-.,:;()%$]', ' ', 'g') AS t FROM documents)")
def contextual_score(spark, d):
    return _docs(spark, d).select("doc_id", F.round(retrieval.contextual_score(F.col("text"), QUERY, BOOSTS), 6).alias("score"))


@query(r"SELECT doc_id FROM documents WHERE len(list_intersect(['the', 'from', 'with'], regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) = 3")
def full_text_match(spark, d):
    return _docs(spark, d).where(retrieval.full_text(F.col("text"), ["the", "from", "with"])[0]).select("doc_id")


@query(f"SELECT prompt, vec_id, score, rn FROM (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY score DESC, vec_id)::INT AS rn FROM (SELECT a.vec_id AS prompt, b.vec_id, {_COS} AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id < 4)) WHERE rn <= 20")
def prompt_table_topk(spark, d):
    e = table(spark, d, "embeddings")
    return knn.nearest(e, e.where("vec_id < 4"), 20, "vec_id", "embedding").select(F.col("source").alias("prompt"), F.col("target").alias("vec_id"), "score", F.col("rank").alias("rn"))


#: How many chunks each prompt of the criteria takes: three of 25, one of 10, three periods of 8, a subsection of 10.
PROMPTS = {0: 25, 1: 25, 2: 25, 3: 10, 4: 8, 5: 8, 6: 8, 7: 10}


@query(f"SELECT prompt, vec_id, score, rn FROM (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY score DESC, vec_id)::INT AS rn FROM (SELECT a.vec_id AS prompt, b.vec_id, {_COS} AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)) JOIN (VALUES {', '.join(map(str, PROMPTS.items()))}) AS p(prompt, k) USING (prompt) WHERE rn <= k")
def criterion_topk(spark, d):
    e = table(spark, d, "embeddings")
    wanted = spark.createDataFrame(list(PROMPTS.items()), "prompt long, k int")
    near = knn.nearest(e, e.where(F.col("vec_id").isin(*PROMPTS)), max(PROMPTS.values()), "vec_id", "embedding").withColumnRenamed("source", "prompt")
    return near.join(F.broadcast(wanted), "prompt").where("rank <= k").select("prompt", F.col("target").alias("vec_id"), "score", F.col("rank").alias("rn"))


@query()
def fuzzy_search(spark, d):
    # texts stand for themselves by their digests, so that no text is shuffled
    rows = _docs(spark, d).select("doc_id", F.sha2("text", 256).alias("text"), F.round(retrieval.token_set_ratio_udf()(F.col("text"), F.lit(QUERY)), 6).alias("score"))
    return retrieval.top(retrieval.first_of(rows, ["text"], F.desc("score"), F.col("doc_id")).select("doc_id", "score"), "score", "doc_id", 20)


@query()
def fuzzy_patterns(spark, d):
    return retrieval.fuzzy_pattern_score(_docs(spark, d), "text", r"\bwith\s+the\b", ["with", "the", "and"], "doc_id")


# -- chunks

#: A fold over a list in SQL: `out` holds what is done, `held` what is open.
_LINES = "string_split(coalesce(text, ''), chr(10))"
_STRIPPED = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_SENTENCES = r"list_filter(string_split(regexp_replace({0}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"


def _folded(items: str, start: str, opened: str, nxt: str, done: str, emit: str, kept: str, rest: str, last: str) -> str:
    """SQL of doc_id, chunk_index, content. `nxt` is what a.held and b.held give together; where `done`, `emit` goes out and `kept` stays open,
    else `rest` does; `last` says whether what is open at the end goes out, as `emit` of it. {h} stands for nxt."""
    one = f"{{'out': []::VARCHAR[], 'held': {opened}}}"
    first = f"{{'out': []::VARCHAR[], 'held': {start}}}"
    step = f"CASE WHEN {done.replace('{h}', nxt)} THEN {{'out': list_append(a.out, {emit.replace('{h}', nxt)}), 'held': {kept.replace('{h}', nxt)}}} ELSE {{'out': a.out, 'held': {rest.replace('{h}', nxt)}}} END"
    fold = f"list_reduce(list_prepend({first}, list_transform({items}, lambda x: {one})), lambda a, b: {step})"
    return f"SELECT doc_id, (generate_subscripts(parts, 1) - 1)::INT AS chunk_index, unnest(parts) AS content FROM (SELECT doc_id, {last} AS parts FROM (SELECT doc_id, text, {fold} AS r FROM documents))"


_ACCUMULATED = _folded(
    f"flatten(list_transform(list_filter({_LINES}, lambda l: {_STRIPPED.format('l')} <> ''), lambda l: {_SENTENCES.format(_STRIPPED.format('l'))}))",
    "[]::VARCHAR[]", "[x]", "list_concat(a.held, b.held)", "length(array_to_string({h}, ' ')) >= 512 AND len({h}) > 3", "array_to_string({h}, ' ')", "list_slice({h}, -2, -1)", "{h}",
    "CASE WHEN len(r.held) > 0 THEN list_append(r.out, array_to_string(r.held, ' ')) ELSE r.out END",
)
_MERGED = _folded(
    _LINES, "NULL::VARCHAR", "x", "coalesce(a.held || ' ' || b.held, b.held)", "length({h}) >= 20", "{h}", "NULL::VARCHAR", "{h}", "CASE WHEN r.held IS NULL THEN r.out ELSE list_append(r.out, r.held) END"
)
_SPLIT = _folded(
    _SENTENCES.format(_STRIPPED.format("coalesce(text, '')")), "''", "x", "b.held", "a.held <> '' AND length(a.held) + 1 + length({h}) > 1000", "a.held", "{h}",
    "CASE WHEN a.held <> '' THEN a.held || ' ' || {h} ELSE {h} END",
    "CASE WHEN length(coalesce(text, '')) <= 1000 THEN [coalesce(text, '')] WHEN r.held <> '' THEN list_append(r.out, r.held) ELSE r.out END",
)


@query(_ACCUMULATED)
def sentence_chunks(spark, d):
    return chunking.sentence_chunks(_docs(spark, d))


@query(_MERGED)
def merge_short(spark, d):
    return chunking.merged_short_lines(_docs(spark, d))


@query(_SPLIT)
def split_long(spark, d):
    return chunking.split_long_texts(_docs(spark, d))


@query()
def chunk_pipeline(spark, d):
    return chunking.cleaned_chunks(_docs(spark, d))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS content_hash FROM documents GROUP BY text")
def exact_dedup(spark, d):
    return chunking.exact_copies(_docs(spark, d), "doc_id", "text").select("doc_id", "content_hash")


_CH = "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, run ORDER BY turn)::INT AS paragraph FROM (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT conv_id, turn, role, (lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS DISTINCT FROM role OR lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL)::INT AS c FROM conversations))"


@query(_CH)
def paragraph_numbers(spark, d):
    return chunking.paragraph_numbers(table(spark, d, "conversations"), "conv_id", "turn", "role").select("conv_id", "turn", "role", "paragraph")


@query("SELECT conv_id, turn, ((rn - 1) // 3 + 1)::INT AS page, ((rn - 1) % 3 + 1)::INT AS paragraph FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)")
def simulated_pages(spark, d):
    return chunking.simulated_pages(table(spark, d, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn", "page", "paragraph")


@query("SELECT conv_id, roles, opening FROM (SELECT conv_id, list(role ORDER BY t, role) AS roles FROM (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY 1, 2) GROUP BY 1) JOIN (SELECT conv_id, first(text ORDER BY turn) FILTER (text <> '') AS opening FROM conversations GROUP BY 1) USING (conv_id)")
def merged_metadata(spark, d):
    m = chunking.merged_metadata(table(spark, d, "conversations"), "conv_id", "turn", ["role"], ["text"])
    return m.select("conv_id", F.col("role").alias("roles"), F.col("text").alias("opening"))


@query(_SQL["sentence_chunks"])
def chunk_table_function(spark, d):
    lines = _docs(spark, d).where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("element_index", "text"), F.lit("NarrativeText").alias("element_type"), F.lit(1).alias("page_number"))
    return chunk_table.chunked(lines).select("doc_id", "chunk_index", "content")


# -- changes


def _old_new(spark, d):
    docs = _docs(spark, d).select("doc_id", "lang", "source", F.md5("text").alias("hash"))
    new = docs.where("doc_id % 7 <> 0").withColumn("source", F.when(F.col("doc_id") % 5 == 0, F.concat("source", F.lit("x"))).otherwise(F.col("source")))
    return docs.where("doc_id % 11 <> 0"), new


_OLD = "(SELECT doc_id, lang, source, md5(text) AS hash FROM documents WHERE doc_id % 11 <> 0)"
_NEW = "(SELECT doc_id, lang, CASE WHEN doc_id % 5 = 0 THEN source || 'x' ELSE source END AS source, md5(text) AS hash FROM documents WHERE doc_id % 7 <> 0)"


@query(f"SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'removed' WHEN o.source IS DISTINCT FROM n.source OR o.lang IS DISTINCT FROM n.lang OR o.hash IS DISTINCT FROM n.hash THEN 'updated' ELSE 'unchanged' END AS change FROM {_OLD} o FULL JOIN {_NEW} n ON o.doc_id = n.doc_id")
def cdc_diff(spark, d):
    return changes.diff(*_old_new(spark, d), "doc_id", ["lang", "source", "hash"]).select("doc_id", "change")


@query(f"SELECT * FROM {_OLD} UNION ALL SELECT * FROM {_NEW} WHERE doc_id NOT IN (SELECT doc_id FROM {_OLD})")
def insert_if_absent(spark, d):
    return changes.insert_if_absent(*_old_new(spark, d), "doc_id", "hash")


@query(f"SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN n.doc_id IS NOT NULL THEN n.source ELSE o.source END AS source, CASE WHEN n.doc_id IS NULL OR (o.doc_id IS NOT NULL AND o.source IS NOT DISTINCT FROM n.source) THEN o.hash ELSE NULL END AS embedding FROM {_OLD} o FULL JOIN {_NEW} n ON o.doc_id = n.doc_id")
def upsert_changed(spark, d):
    old, new = _old_new(spark, d)
    old = old.select("doc_id", "source", F.col("hash").alias("embedding"))
    return changes.upsert(old, new.select("doc_id", "source"), "doc_id", "source", ["embedding"])


@query("SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F'")
def cascade_delete(spark, d):
    orders, items = table(spark, d, "orders"), table(spark, d, "lineitem")
    gone = orders.where("o_orderstatus = 'F'").select("o_orderkey")
    chunks = items.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("chunk_id"))
    edges = chunks.select(F.col("chunk_id").alias("source"), F.col("chunk_id").alias("target"))
    _, kept, _ = changes.cascade_delete(orders.select("o_orderkey"), chunks, edges, gone, "o_orderkey")
    return kept.join(orders.select("o_orderkey"), "o_orderkey").select("o_orderkey", "l_linenumber")


@query("SELECT status, count(*)::BIGINT AS n FROM (SELECT CASE WHEN conv_id % 9 = 0 THEN 'invalid' WHEN d.doc_id IS NULL THEN 'unknown' ELSE 'inserted' END AS status FROM conversations c LEFT JOIN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) d ON c.conv_id = d.doc_id) GROUP BY 1")
def citation_load(spark, d):
    as_id = lambda c: changes.uuid5(NAMESPACE, F.col(c).cast("string"))
    cites = table(spark, d, "conversations").select(F.when(F.col("conv_id") % 9 == 0, F.lit("no-id")).otherwise(as_id("conv_id")).alias("cited"))
    chunks = _docs(spark, d).where("doc_id % 2 = 0").select(as_id("doc_id").alias("id"))
    return changes.checked_citations(cites, chunks, "cited", "id").groupBy("status").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, source, r AS source_rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY r, hash) AS n FROM (SELECT *, 0 AS r FROM {_OLD} UNION ALL SELECT *, 1 AS r FROM {_NEW})) WHERE n = 1")
def ordered_union_dedup(spark, d):
    return changes.ordered_union(list(_old_new(spark, d)), "doc_id", "hash").select("doc_id", "source", "source_rank")


@query(f"SELECT 'gone' AS side, doc_id FROM (SELECT doc_id FROM {_OLD} EXCEPT SELECT doc_id FROM {_NEW}) UNION ALL SELECT 'came', doc_id FROM (SELECT doc_id FROM {_NEW} EXCEPT SELECT doc_id FROM {_OLD}) UNION ALL SELECT 'both', doc_id FROM (SELECT doc_id FROM {_NEW} INTERSECT SELECT doc_id FROM {_OLD})")
def set_diff(spark, d):
    o, n = (x.select("doc_id") for x in _old_new(spark, d))
    side = lambda df, name: df.select(F.lit(name).alias("side"), "doc_id")
    return side(o.subtract(n), "gone").unionAll(side(n.subtract(o), "came")).unionAll(side(n.intersect(o), "both"))


@query(f"SELECT o.doc_id, n.source FROM {_OLD} o JOIN {_NEW} n ON o.doc_id = n.doc_id WHERE o.source IS DISTINCT FROM n.source")
def changed_fields(spark, d):
    old, new = _old_new(spark, d)
    return changes.changed_only(old, new, "doc_id", ["lang", "source", "hash"]).where("change = 'updated' and array_contains(changed, 'source')").select("doc_id", "source")


# -- aggregates and metrics


@query("SELECT source, count(*)::BIGINT AS n, count(DISTINCT lang)::BIGINT AS n_langs, min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 6) AS mean FROM documents GROUP BY source")
def counts_per_group(spark, d):
    return _docs(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("lang").alias("n_langs"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.round(F.avg("n_chars"), 6).alias("mean"))


@query("SELECT source, coalesce(max(n_chars) FILTER (WHERE lang = 'en'), 0) AS en, coalesce(max(n_chars) FILTER (WHERE lang = 'de'), 0) AS de, coalesce(max(n_chars) FILTER (WHERE lang = 'fr'), 0) AS fr, coalesce(max(n_chars) FILTER (WHERE lang = 'es'), 0) AS es FROM documents GROUP BY source")
def pivot_scores(spark, d):
    return evaluation.score_pivot(_docs(spark, d), "source", "lang", ["en", "de", "fr", "es"], "n_chars")


@query(f"SELECT label, count(*)::BIGINT AS n_low FROM (SELECT label, round(list_cosine_similarity(embedding::DOUBLE[], {_Q0}::DOUBLE[]), 6) AS score FROM embeddings) WHERE score < 0.7 GROUP BY label ORDER BY n_low DESC, label")
def low_confidence_counts(spark, d):
    return evaluation.low_confidence(retrieval.similar(table(spark, d, "embeddings"), _vector(spark, d, 0)), "label", "score")


_JUDGED = "(SELECT l.quality AS truth, (d.n_chars > 1000)::INT AS predicted, d.lang, d.source FROM labels l JOIN documents d USING (doc_id))"


def _judged(spark, d):
    docs = _docs(spark, d).select("doc_id", (F.col("n_chars") > 1000).cast("int").alias("predicted"), "lang", "source")
    return table(spark, d, "labels").join(docs, "doc_id").select(F.col("quality").alias("truth"), "predicted", "lang", "source")


@query(f"""WITH g AS (SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'all' END AS level, coalesce(lang, source) AS value, sum((truth = 1 AND predicted = 1)::INT)::BIGINT AS tp, sum((truth = 0 AND predicted = 1)::INT)::BIGINT AS fp, sum((truth = 1 AND predicted = 0)::INT)::BIGINT AS fn FROM {_JUDGED} GROUP BY GROUPING SETS ((), (lang), (source))),
p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM g)
SELECT level, value, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM p""")
def prf_metrics(spark, d):
    return evaluation.precision_recall(_judged(spark, d), "truth", "predicted", ["lang", "source"])


@query(f"SELECT round(avg((truth IS NOT DISTINCT FROM predicted)::INT), 6) AS accuracy, count(*)::BIGINT AS n FROM {_JUDGED}")
def accuracy(spark, d):
    return evaluation.accuracy(_judged(spark, d), "truth", "predicted")


@query(r"SELECT w, count(*)::BIGINT AS n FROM (SELECT unnest(" + _TOKENS + r") AS w FROM documents) WHERE w NOT IN (SELECT unnest(" + _TOKENS + r") FROM benchmark) GROUP BY w ORDER BY n DESC, w LIMIT 50")
def oov_topk(spark, d):
    tokens = lambda n: table(spark, d, n).select(F.explode(X.whitespace_tokens(F.lower("text"))).alias("w"))
    return evaluation.unknown_tokens(tokens("documents"), tokens("benchmark").distinct(), "w")


@query("SELECT doc_id, 'truth' AS missing_in FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def truth_leftovers(spark, d):
    return evaluation.leftovers(table(spark, d, "labels"), _docs(spark, d), "doc_id")


@query("SELECT lang, label, 'no' AS answer FROM (SELECT DISTINCT lang FROM documents), (VALUES ('a'), ('b')) AS v(label)")
def truth_template(spark, d):
    return evaluation.truth_template(_docs(spark, d), "lang", ["a", "b"])


@query("SELECT c_mktsegment, n_name, count(*)::BIGINT AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = (SELECT min(r_name) FROM region) GROUP BY 1, 2")
def star_join(spark, d):
    t = lambda n: table(spark, d, n)
    first = t("region").agg(F.min("r_name").alias("r_name"))
    nations = t("nation").join(t("region").join(first, "r_name", "left_semi"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = t("orders").join(t("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("c_mktsegment", "n_name").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


# -- graph

_EDGE_CASE = "CASE " + " ".join(f"WHEN regexp_matches(lower(s.text), '{a}') AND regexp_matches(lower(t.text), '{b}') THEN '{k}|{w}'" for k, a, b, w in sorted(((k, a, b, w) for k, ps in RELATIONS.items() for a, b, w in ps), key=lambda r: -r[3])) + " END"
_EDGES = f"(SELECT source, target, split_part(kw, '|', 1) AS type, confidence FROM (SELECT source, target, kw, round(least(1.0::DOUBLE, 0.3::DOUBLE * score + 0.5::DOUBLE * split_part(kw, '|', 2)::DOUBLE + 0.2::DOUBLE * greatest(0.1::DOUBLE, 1 - 0.001::DOUBLE * abs(source - target))), 7) AS confidence FROM (SELECT k.source, k.target, k.score, {_EDGE_CASE} AS kw FROM ({_KNN}{NEIGHBOURS}) k JOIN documents s ON s.doc_id = k.source JOIN documents t ON t.doc_id = k.target) WHERE kw IS NOT NULL) WHERE confidence >= {MIN_EDGE})"


def _edges(spark, d):
    docs = _docs(spark, d)
    return graph.relationships(_pairs(spark, d, NEIGHBOURS).select("source", "target", "score"), docs, "doc_id", "text", "doc_id", RELATIONS, MIN_EDGE)


@query(f"SELECT source, target, type, confidence FROM {_EDGES}")
def relationship_edges(spark, d):
    return _edges(spark, d)


TERMS = ["the", "from", "with"]
_MATCH = r"(SELECT doc_id AS node, round(len(list_filter(t, lambda w: w IN ('the', 'from', 'with'))) / greatest(len(t), 1), 6) AS relevance FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM documents) WHERE len(list_intersect(['the', 'from', 'with'], t)) = 3)"


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT source, target, confidence FROM {_EDGES}), w AS (SELECT node, 0 AS hops, 1.0::DOUBLE AS confidence, relevance::DOUBLE AS relevance, [node] AS path FROM {_MATCH}
UNION ALL SELECT e.target, hops + 1, w.confidence * e.confidence * 0.9, relevance * 0.8, list_append(path, e.target) FROM w JOIN e ON e.source = w.node WHERE hops < 3 AND e.confidence > 0.6 AND w.confidence > 0.4 AND NOT list_contains(path, e.target))
SELECT DISTINCT node, hops, round(confidence, 6) AS confidence, round(relevance, 6) AS relevance FROM w WHERE confidence > 0.3 AND list_has_any(path, (SELECT list(node) FROM (SELECT node FROM {_MATCH} ORDER BY relevance DESC, node LIMIT 5)))""")
def multi_hop(spark, d):
    return _walk(spark, d, _edges(spark, d))


def _walk(spark, d, edges, k=None):
    match, rank = retrieval.full_text(F.col("text"), TERMS)
    matches = readers.dealt(_docs(spark, d).select("doc_id", "text"), "doc_id").where(match).select(F.col("doc_id").alias("id"), F.round(rank, 6).alias("relevance"))
    return graph.multi_hop(edges, matches, "id", "relevance", least_edge=0.6, k=k)


@query(f"{_SQL['multi_hop']} ORDER BY 3 DESC, 4 DESC, 2, 1 LIMIT 40")
def multi_hop_top(spark, d):
    return _walk(spark, d, _edges(spark, d), k=40)


@query(f"SELECT source, target, confidence FROM {_EDGES} WHERE confidence > 0.5 AND source % 2 = 0 AND target % 2 = 0")
def induced_subgraph(spark, d):
    nodes = _docs(spark, d).where("doc_id % 2 = 0").select("doc_id")
    return graph.induced(_edges(spark, d), nodes, "doc_id").select("source", "target", "confidence")


@query(f"WITH p AS (SELECT DISTINCT source, target FROM {_EDGES}), x AS (SELECT node, count(*) AS d FROM (SELECT source AS node FROM p UNION ALL SELECT target FROM p) GROUP BY 1) SELECT vec_id, round(coalesce(d, 0) / ((SELECT count(*) FROM embeddings) - 1), 6) AS degree FROM embeddings LEFT JOIN x ON x.node = vec_id")
def degree_centrality(spark, d):
    return graph.degree(_edges(spark, d), table(spark, d, "embeddings").select("vec_id"), "vec_id")


_RANKS = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT source, target, sum(confidence) AS c FROM {_EDGES} GROUP BY 1, 2), w AS MATERIALIZED (SELECT source, sum(c) AS w FROM e GROUP BY 1),
s AS MATERIALIZED (SELECT e.source, e.target, c / w AS share FROM e JOIN w USING (source)), n AS MATERIALIZED (SELECT count(*) AS n FROM embeddings),
r AS (SELECT 0 AS i, vec_id AS node, vec_id IN (SELECT source FROM w) AS leads, 1.0::DOUBLE / n AS rank, 1e9::DOUBLE AS moved FROM embeddings, n
UNION ALL SELECT i + 1, node, leads, new, sum(abs(new - rank)) OVER () FROM (SELECT i, r.node, leads, rank, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(got, 0.0) + lost / n) AS new
FROM r LEFT JOIN (SELECT s.target AS node, sum(rank * share) AS got FROM s JOIN r ON r.node = s.source GROUP BY 1) g ON g.node = r.node, (SELECT coalesce(sum(CASE WHEN NOT leads THEN rank END), 0.0) AS lost FROM r), n WHERE moved >= 1e-6 * n AND i < 100))
SELECT node AS vec_id, round(rank, 6) AS pagerank FROM r WHERE i = (SELECT max(i) FROM r)"""


@query(_RANKS)
def pagerank(spark, d):
    return graph.pagerank(_edges(spark, d), table(spark, d, "embeddings").select("vec_id"), "vec_id")


def _graph(spark, d):
    nodes = table(spark, d, "embeddings").select("vec_id")
    return graph.induced(_edges(spark, d), nodes, "vec_id"), nodes


@query()
def betweenness(spark, d):
    return graph.betweenness(*_graph(spark, d), "vec_id")


@query()
def communities(spark, d):
    return graph.communities(*_graph(spark, d), "vec_id")


@query()
def node_classes(spark, d):
    edges, nodes = _graph(spark, d)
    edges = written(edges)  # four steps read them
    c = graph.degree(edges, nodes, "vec_id").join(graph.pagerank(edges, nodes, "vec_id"), "vec_id").join(graph.betweenness(edges, nodes, "vec_id"), "vec_id")
    cols = [F.col("degree"), F.col("pagerank"), F.col("betweenness")]
    c = c.withColumn("final_score", graph.final_score(*cols)).withColumn("classification", graph.node_class(*cols)).withColumn("confidence_level", graph.level(*cols))
    ranked = graph.combined_score(_walk(spark, d, edges), c, "vec_id")
    return graph.ranked_in_class(ranked, "vec_id").select("vec_id", "classification", "confidence_level", "combined_score", "rank_within_class", "overall_rank")


# -- extraction and reports


class _SETS:
    SECTORS = "the|and|with"
    POLICY_TYPES = "from|this"
    NET_ZERO = "to the|of the"
    EFFICIENCY_WORDS = r"\b(that|was)\b"
    EFFICIENCY_TARGETS = r"\b(is|are)\b"
    POWER_WORDS = "der|die"
    CARBON_PRICING = "la (de|que)"
    LABELS = ("net_zero_target", "sector_targets", "efficiency_target", "electricity_net_zero", "carbon_pricing")


@query(r"""WITH t AS (SELECT doc_id, lower(text) AS t FROM documents) SELECT doc_id, label, answer FROM (
SELECT doc_id, 'net_zero_target' AS label, CASE WHEN regexp_matches(t, 'to the|of the') THEN 'yes' ELSE 'no' END AS answer FROM t
UNION ALL SELECT doc_id, 'sector_targets', CASE WHEN regexp_matches(t, '\b(the|and|with)\b') THEN 'yes' ELSE 'no' END FROM t
UNION ALL SELECT doc_id, 'efficiency_target', CASE WHEN regexp_matches(t, 'from|this') AND regexp_matches(t, '\b(that|was)\b') AND regexp_matches(t, '\b(is|are)\b') THEN 'yes' WHEN regexp_matches(t, '\b(that|was)\b') THEN 'soft_yes' ELSE 'no' END FROM t
UNION ALL SELECT doc_id, 'electricity_net_zero', CASE WHEN contains(t, 'net zero') AND regexp_matches(t, 'der|die') THEN CASE WHEN contains(t, 'scenario') THEN 'soft_yes' ELSE 'yes' END ELSE 'no' END FROM t
UNION ALL SELECT doc_id, 'carbon_pricing', CASE WHEN regexp_matches(t, 'la (de|que)') THEN 'yes' ELSE 'no' END FROM t)""")
def label_rules(spark, d):
    return extract.labels_of(_docs(spark, d), "doc_id", "text", sets=_SETS)


@query(r"""SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '\b(20[0-9]{2})\b', 1) || CASE WHEN regexp_matches(text, '(?i)\bmid[-\s]?century\b') THEN ['2050'] ELSE [] END)) AS years,
list_sort(list_distinct(list_transform(regexp_extract_all(lower(text), '\b(the|and|with)\b', 1), lambda w: upper(w[1]) || w[2:]))) AS sectors, regexp_matches(lower(text), 'to the|of the') AS has_target, regexp_matches(lower(text), 'from|this') AS has_policy FROM documents""")
def entity_years(spark, d):
    tags = extract.entity_tags(F.col("text"), _SETS.SECTORS, _SETS.POLICY_TYPES, _SETS.NET_ZERO)
    return _docs(spark, d).select("doc_id", tags.alias("t")).select("doc_id", "t.years", "t.sectors", "t.has_target", "t.has_policy")


LICENSED = ("license", "licensed", "licenses", "licensing")


@query(rf"""WITH w AS (SELECT doc_id, unnest(t) AS w, unnest(range(0, len(t))) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS t FROM documents)),
s AS (SELECT doc_id, pos, w IN {LICENSED} AS x FROM w WHERE w IN {LICENSED} OR w IN ('version', 'versions')),
c AS (SELECT *, lag(pos) OVER o AS before, lag(x) OVER o AS y FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, round(sum(1.0::DOUBLE / (pos - before)), 6) AS rank FROM c WHERE x <> y GROUP BY doc_id""")
def stemmed_search(spark, d):
    index = fulltext.stored(_docs(spark, d), "doc_id", "text", f"{shared(spark)}/postings-{uuid.uuid4().hex}")
    return fulltext.search(index, "the licensing of versions", "doc_id")


@query()
def page_markdown(spark, d):
    return extract.page_markdown(table(spark, d, "pages"))


@query("""SELECT DISTINCT page_id, link FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages)""")
def page_links(spark, d):
    return extract.page_links(table(spark, d, "pages"))


@query("SELECT conv_id, string_agg('CHUNK ' || i || ': ' || text, chr(10) || chr(10) ORDER BY i) AS context FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) GROUP BY conv_id")
def context_format(spark, d):
    return report.context(table(spark, d, "conversations"), "conv_id", "turn", "text")


@query("SELECT conv_id, string_agg(chr(10) || '## ' || role || chr(10) || text || chr(10), '' ORDER BY turn) AS content FROM conversations GROUP BY conv_id")
def section_text(spark, d):
    return report.sections(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")


@query("SELECT lang, source, page, to_json({'source': source, 'chunk_count': count(*)::INT, 'chunks': list({'doc_id': doc_id, 'n_chars': n_chars} ORDER BY doc_id)})::VARCHAR AS json FROM (SELECT *, ((row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) - 1) // 100)::INT AS page FROM documents) GROUP BY lang, source, page")
def country_json(spark, d):
    return report.nested_json(_docs(spark, d), "lang", "source", "doc_id", ["n_chars"], page=100)


@query("SELECT conv_id, turn, d.source, (d.doc_id IS NOT NULL) AS verified FROM conversations LEFT JOIN documents d ON conv_id = d.doc_id")
def citation_enrich(spark, d):
    c = report.answer_with_citations(table(spark, d, "conversations").select("conv_id", "turn"), _docs(spark, d), "conv_id", "doc_id", ["source"])
    return c.select("conv_id", "turn", "source", "verified")


@query("SELECT doc_id, '### ' || lang || chr(10) || 'Answer: ' || (CASE WHEN doc_id % 3 = 0 THEN 'Yes' ELSE 'No' END) || chr(10) || 'Quote: ' || trim(regexp_replace(text, '\\s+', ' ', 'g')) || chr(10) || 'Confidence: 50.0%' AS box FROM documents".replace("\\\\", "\\"))
def answer_boxes(spark, d):
    answer = F.when(F.col("doc_id") % 3 == 0, "yes").otherwise("soft_yes")
    return _docs(spark, d).select("doc_id", report.answer_box(F.col("lang"), answer, F.col("text"), F.lit(0.5)).alias("box"))


# -- streams


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    return feeds.event_windows(table(spark, d, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*)::BIGINT AS attempts FROM events GROUP BY user_id")
def first_last_seen(spark, d):
    return feeds.seen(table(spark, d, "events"), "user_id")


_VISITS = """WITH e AS (SELECT user_id::VARCHAR AS url, event_type AS content, epoch_us(ts) AS us FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
d AS (SELECT url, us, min(content) AS content FROM e GROUP BY url, us),
g AS (SELECT *, (lag(us) OVER w IS NULL OR us - lag(us) OVER w > 10800000000)::INT AS fresh, lag(content) OVER w AS before FROM d WINDOW w AS (PARTITION BY url ORDER BY us)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY url ORDER BY us) AS run FROM g),
v AS (SELECT *, row_number() OVER w AS attempts, min(us) OVER (PARTITION BY url, run) AS first, max(us) OVER (PARTITION BY url, run) AS final, max(run) OVER (PARTITION BY url) AS runs FROM r WINDOW w AS (PARTITION BY url, run ORDER BY us)),
c AS (SELECT url, CASE WHEN fresh = 1 THEN 'new' WHEN content = before THEN 'unchanged' ELSE 'updated' END AS change, content, attempts, first, us AS last FROM v
UNION ALL SELECT url, 'removed', content, attempts, first, us FROM v WHERE us = final AND (run < runs OR us + 10800000000 <= (SELECT max(us) FROM e) - 600000000))
SELECT url, change, content, attempts::BIGINT AS attempts, make_timestamp(first) AS first_seen, make_timestamp(last) AS last_seen FROM c"""


@query(_VISITS)
def rescrape_stream(spark, d):
    folder = f"{shared(spark)}/rescrape-{uuid.uuid4().hex}"
    stream = rescrape.visits(rescrape.replay(table(spark, d, "events"), "ts", f"{folder}/in"), "user_id", "event_type", "ts", timedelta(hours=3))
    rescrape.run(spark, stream, f"{folder}/out", f"{folder}/checkpoint")
    out = spark.read.schema(stream.schema).parquet(f"{folder}/out")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_seen", "last_seen")})


# -- embeddings, questions and verdicts

_VOCAB = r"SELECT DISTINCT w AS word, [length(w)::DOUBLE, ascii(w)::DOUBLE] AS vector FROM (SELECT unnest(" + _TOKENS + ") AS w FROM benchmark)"


@query(f"SELECT doc_id, dim, round(sum(v * n) / sum(n), 6) AS x FROM (SELECT doc_id, n, unnest(vector) AS v, unnest([0, 1])::INT AS dim FROM (SELECT doc_id, w AS word, count(*) AS n FROM (SELECT doc_id, unnest({_TOKENS}) AS w FROM documents) GROUP BY 1, 2) JOIN ({_VOCAB}) USING (word)) GROUP BY 1, 2")
def document_vectors(spark, d):
    words = table(spark, d, "benchmark").select(F.explode(X.whitespace_tokens(F.lower("text"))).alias("word")).distinct()
    vocabulary = words.select("word", F.array(F.length("word").cast("double"), F.ascii("word").cast("double")).alias("vector"))
    return embedding.document_vectors(_docs(spark, d), "doc_id", "text", vocabulary)


@query(r"SELECT doc_id, (('0x' || substr(md5(w), 1, 8))::BIGINT % 64)::INT AS dim, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM documents) GROUP BY 1, 2")
def hashed_terms(spark, d):
    return embedding.hashed_terms(_docs(spark, d), "doc_id", "text")


@query("SELECT doc_id, CASE WHEN length(trim(text)) >= 20 THEN left(trim(text), 30000) END AS part FROM documents")
def embeddable_texts(spark, d):
    return _docs(spark, d).select("doc_id", embedding.embeddable(F.col("text")).alias("part"))


@query()
def word_vectors(spark, d):
    return embedding.word_vectors(_docs(spark, d), "text")


@query(f"SELECT question, vec_id, score FROM (SELECT a.vec_id AS question, b.vec_id, {_COS} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rn FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) WHERE rn = 1")
def best_chunk_per_question(spark, d):
    e = table(spark, d, "embeddings")
    return knn.nearest(e, e.where("vec_id % 50 = 0"), 1, "vec_id", "embedding").select(F.col("source").alias("question"), F.col("target").alias("vec_id"), "score")


@query(f"""SELECT q.vec_id AS question, m.target::VARCHAR AS answer, m.r AS round, CASE WHEN m.r IS NULL THEN 'unresolved' ELSE 'answered' END AS status FROM embeddings q LEFT JOIN
(SELECT source, r, min(target::VARCHAR) AS target FROM (SELECT k.source, k.target, ((k.rank - 1) // 5 + 1)::INT AS r, min((k.rank - 1) // 5 + 1) OVER (PARTITION BY k.source) AS f FROM ({_KNN}15) k JOIN embeddings a ON a.vec_id = k.source JOIN embeddings b ON b.vec_id = k.target WHERE a.label = b.label) WHERE r = f GROUP BY 1, 2) m ON m.source = q.vec_id WHERE q.vec_id % 20 = 0""")
def answer_rounds(spark, d):
    """A question is answered by a neighbour of its own label: among five at first, then among ten, then fifteen."""
    e = table(spark, d, "embeddings")
    labels = e.select(F.col("vec_id").alias("target"), F.col("label").alias("found"))

    def answer(left, r):
        near = knn.nearest(e, left.join(e, F.col("question") == F.col("vec_id")).select("vec_id", "embedding"), 5 * r, "vec_id", "embedding", least_dims=10)
        checked = near.join(labels, "target").join(left, F.col("source") == F.col("question"))
        return checked.select("question", F.col("target").cast("string").alias("answer"), (F.col("label") == F.col("found")).alias("passed"))

    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("question"), "label")
    return rounds.in_rounds(asked, "question", answer).select("question", "answer", "round", "status")


@query("SELECT conv_id, CASE WHEN bool_or(contains(upper(text), 'NO')) THEN 'NO' WHEN bool_or(contains(upper(text), 'YES')) THEN 'YES' ELSE 'UNCLEAR' END AS verdict, count(*)::BIGINT AS n FROM conversations GROUP BY conv_id")
def criterion_verdicts(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", X.verdict(F.col("text")).alias("v"))
    g = rows.groupBy("conv_id").agg(F.max((F.col("v") == "NO").cast("int")).alias("no"), F.max((F.col("v") == "YES").cast("int")).alias("yes"), F.count("*").alias("n"))
    return g.select("conv_id", F.when(F.col("no") == 1, "NO").when(F.col("yes") == 1, "YES").otherwise("UNCLEAR").alias("verdict"), "n")


@query("SELECT doc_id, lang FROM documents ORDER BY CASE lang WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END, doc_id LIMIT 100")
def fixed_rank_order(spark, d):
    rank = F.coalesce(F.nullif(F.array_position(F.array(F.lit("fr"), F.lit("de")), F.col("lang")), F.lit(0)), F.lit(3))
    return _docs(spark, d).select("doc_id", "lang").orderBy(rank, "doc_id").limit(100)


@query("SELECT doc_id, make_date((2000 + doc_id % 30)::INT, (doc_id % 9 + 1)::INT, 1)::VARCHAR AS month FROM documents")
def month_of_url(spark, d):
    url = F.concat(F.lit("https://host/a/20"), F.lpad((F.col("doc_id") % 30).cast("string"), 2, "0"), F.lit("-0"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit("/x.pdf"))
    return _docs(spark, d).select("doc_id", extract.month_of_url(url).cast("string").alias("month"))


@query(r"SELECT doc_id, round(len(list_filter(t, lambda w: w IN ('the', 'from', 'with'))) / greatest(len(t), 1), 6) AS rank FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM documents) WHERE len(list_intersect(['the', 'from', 'with'], t)) > 0")
def full_text_rank(spark, d):
    match, rank = retrieval.full_text(F.col("text"), ["the", "from", "with"], "any")
    return _docs(spark, d).where(match).select("doc_id", F.round(rank, 6).alias("rank"))


@query("SELECT answer, count(n)::BIGINT AS n FROM (VALUES ('YES'), ('NO'), ('UNCLEAR'), ('ABSENT')) AS v(answer) LEFT JOIN (SELECT CASE WHEN contains(upper(text), 'NO') THEN 'NO' WHEN contains(upper(text), 'YES') THEN 'YES' ELSE 'UNCLEAR' END AS answer, 1 AS n FROM documents) USING (answer) GROUP BY 1")
def verdict_distribution(spark, d):
    rows = _docs(spark, d).select(X.verdict(F.col("text")).alias("answer"))
    return graph.distribution(rows, "answer", ("YES", "NO", "UNCLEAR", "ABSENT"))
