"""Registered queries over single records and small rules: file names, questions, reports, stored frames, keyword lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.functions import vector as V
from docloom.operators import changes, chunking, evaluation, extract, graph, report, retrieval
from docloom.plans import catalog
from docloom.plans.catalog import _NEW, _OLD, _Q0, _TOKENS, INDICATORS, _docs, _old_new, _vector, query
from docloom.sources import readers
from docloom.sources.readers import table

_INITCAP = "upper(left({0}, 1)) || lower(substr({0}, 2))"

# -- scans


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id = 3 ORDER BY turn")
def scan_of_document(spark, d):
    return table(spark, d, "conversations").where("conv_id = 3").select("conv_id", "turn", "role").orderBy("turn")


@query("SELECT vec_id, label FROM embeddings WHERE embedding IS NOT NULL ORDER BY vec_id LIMIT 10000")
def scan_sample(spark, d):
    return table(spark, d, "embeddings").where("embedding is not null").select("vec_id", "label").orderBy("vec_id").limit(10_000)


@query("SELECT count(*) > 0 AS found FROM (SELECT 1 FROM documents WHERE lang = 'fr' LIMIT 1)")
def exists_one(spark, d):
    return readers.found(_docs(spark, d).where("lang = 'fr'"))


@query("SELECT DISTINCT (props->>'k')::BIGINT AS k FROM events WHERE props->>'k' IS NOT NULL ORDER BY k")
def distinct_field(spark, d):
    k = F.get_json_object("props", "$.k").cast("long").alias("k")
    return table(spark, d, "events").select(k).where("k is not null").distinct().orderBy("k")


@query("SELECT event_id, event_type, value FROM events ORDER BY value DESC, event_type DESC, event_id LIMIT 40")
def three_key_order(spark, d):
    return table(spark, d, "events").select("event_id", "event_type", "value").orderBy(F.desc("value"), F.desc("event_type"), "event_id").limit(40)


@query("SELECT name, n FROM (SELECT 'documents' AS name, count(*)::BIGINT AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'labels', count(*) FROM labels)")
def row_counts(spark, d):
    return readers.counted({n: table(spark, d, n) for n in ("documents", "pages", "labels")})


@query("SELECT DISTINCT stem FROM (SELECT 'doc' || doc_id AS stem FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'doc' || doc_id FROM documents WHERE doc_id % 3 = 0)")
def files_by_stem(spark, d):
    docs = _docs(spark, d)
    one = docs.where("doc_id % 2 = 0").select(F.concat(F.lit("/a/doc"), "doc_id", F.lit(".json")).alias("file"))
    other = docs.where("doc_id % 3 = 0").select(F.concat(F.lit("/b/doc"), "doc_id", F.lit(".md")).alias("file"))
    return readers.stems(one.unionAll(other), "file")


@query(r"SELECT DISTINCT link FROM (SELECT unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages) WHERE contains(link, '/') AND length(link) - length(replace(link, '/', '')) = 1".replace('\\"', '"'))
def country_links(spark, d):
    return extract.country_links(extract.page_links(table(spark, d, "pages")), "link", "/", 1)


@query("SELECT page_id, url || '.pdf' AS link FROM pages WHERE page_id % 2 = 0")
def pdf_links(spark, d):
    links = table(spark, d, "pages").select("page_id", F.concat("url", F.when(F.col("page_id") % 2 == 0, ".pdf").otherwise(".html")).alias("link"))
    return extract.links_to(links, ".pdf")


# -- file names, countries, languages

_FILE = "source || '_' || lang || '_202401' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || '.pdf'"
BY_COUNTRY = {"src1": "fr", "src2": "de", "src3": "es"}
COUNTRIES = ["Src1", "Src 2", "Src3"]


def _files(spark, d):
    file = F.concat_ws("_", "source", "lang", F.concat(F.lit("202401"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit(".pdf")))
    return _docs(spark, d).select("doc_id", "source", "lang", file.alias("file"))


@query(f"SELECT doc_id, {_INITCAP.format('source')} AS country, lang AS language, ('2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0')) AS day FROM documents")
def file_parts(spark, d):
    p = extract.file_parts(F.col("file"))
    return _files(spark, d).select("doc_id", p["country"].alias("country"), p["language"].alias("language"), p["date"].cast("string").alias("day"))


@query(f"SELECT doc_id, CASE WHEN contains(lower({_FILE}), 'src1') THEN 'Src1' WHEN contains(lower({_FILE}), 'src_2') THEN 'Src 2' WHEN contains(lower({_FILE}), 'src3') THEN 'Src3' WHEN length(source) > 2 THEN {_INITCAP.format('source')} ELSE 'Unknown' END AS country FROM documents")
def file_countries(spark, d):
    return _files(spark, d).select("doc_id", extract.country_of_file(F.col("file"), COUNTRIES).alias("country"))


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN lang END, CASE WHEN doc_id % 3 = 1 AND lang IN ('en', 'de', 'fr', 'es') THEN lang END, CASE source WHEN 'src1' THEN 'fr' WHEN 'src2' THEN 'de' WHEN 'src3' THEN 'es' END, 'en') AS language FROM documents")
def resolved_languages(spark, d):
    third = F.col("doc_id") % 3
    file = F.when(third == 1, F.col("file")).otherwise(F.lit("plain.pdf"))
    return _files(spark, d).select("doc_id", X.resolved_language(F.when(third == 0, F.col("lang")), file, F.col("source"), BY_COUNTRY).alias("language"))


@query("SELECT doc_id, code FROM documents JOIN (VALUES ('en', 'GBR'), ('de', 'DEU'), ('fr', 'FRA')) AS v(lang, code) USING (lang)")
def country_codes(spark, d):
    return extract.coded(_docs(spark, d), "lang", {"en": "GBR", "de": "DEU", "fr": "FRA"}).select("doc_id", "code")


@query("SELECT doc_id, upper(source) AS code FROM documents WHERE doc_id % 2 = 0")
def braced_codes(spark, d):
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Policies of {"), F.upper("source"), F.lit("} in force"))).otherwise("no code")
    return _docs(spark, d).select("doc_id", extract.country_code(text).alias("code")).where("code is not null")


@query(f"SELECT doc_id, {_INITCAP.format('source')} || ' ' || {_INITCAP.format('lang')} AS name FROM documents")
def file_keys(spark, d):
    return _docs(spark, d).select("doc_id", X.file_key(F.concat_ws("_", "source", "lang")).alias("name"))


@query(r"SELECT page_id, replace(trim(regexp_replace(url, '[^\p{L}\p{N} _-]', '', 'g')), ' ', '_') AS name FROM pages")
def file_names(spark, d):
    return table(spark, d, "pages").select("page_id", X.file_name(F.col("url")).alias("name"))


@query(f"SELECT item_id, {_INITCAP.format('text')} AS shown FROM benchmark")
def capitalised(spark, d):
    return table(spark, d, "benchmark").select("item_id", X.capitalised(F.col("text")).alias("shown"))


@query("SELECT doc_id, NULL::VARCHAR AS country FROM documents")
def constant_column(spark, d):
    return _docs(spark, d).select("doc_id", F.lit(None).cast("string").alias("country"))


@query("SELECT doc_id, list_extract(['net zero', 'sector', 'efficiency'], (doc_id % 5)::INT + 1) AS label FROM documents")
def label_of_index(spark, d):
    return _docs(spark, d).select("doc_id", X.labelled(F.col("doc_id") % 5, ["net zero", "sector", "efficiency"]).alias("label"))


# -- questions, nested values


@query("SELECT item_id, rtrim(trim(split_part(split_part(split_part(split_part(text || '?? - why', chr(10), 1), ' - ', 1), '; ', 1), ': ', 1)), '?') || '?' AS question FROM benchmark")
def main_questions(spark, d):
    return table(spark, d, "benchmark").select("item_id", X.main_question(F.concat("text", F.lit("?? - why"))).alias("question"))


@query("SELECT conv_id, nth, ' ' || role || ' ' AS section FROM (SELECT conv_id, role, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS nth FROM conversations)")
def question_sections(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    text = F.array_join(F.transform("r", lambda x, i: F.concat(F.lit("Q"), (i + 1).cast("string"), F.lit(": "), x["role"], F.lit(" "))), "")
    return rows.select("conv_id", F.posexplode(X.sections(text)).alias("nth", "section"))


@query("SELECT event_id, CASE event_id % 3 WHEN 2 THEN 'plain words' ELSE props->>'k' END AS k FROM events")
def unwrapped_fields(spark, d):
    props = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit("}"))
    nested = F.to_json(F.struct(props.alias("k")))
    x = F.when(F.col("event_id") % 3 == 0, props).when(F.col("event_id") % 3 == 1, nested).otherwise('{ "plain  words" }')
    return table(spark, d, "events").select("event_id", X.unwrapped(x, "k").alias("k"))


@query(f"SELECT conv_id, list_sort(list_distinct(flatten(list({_TOKENS})))) AS keywords FROM conversations GROUP BY conv_id")
def keyword_union(spark, d):
    t = table(spark, d, "conversations").select("conv_id", F.explode(X.whitespace_tokens(F.lower("text"))).alias("w")).distinct()
    return t.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("keywords"))


# -- vectors


@query("SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: round(x / n, 6)) AS unit FROM (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)")
def unit_vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform(V.unit(F.col("embedding")), lambda x: V.rounded(x)).alias("unit"))


@query("SELECT vec_id, list_transform(embedding, lambda x: trunc(x::DOUBLE * 1000000)::BIGINT) AS vector FROM embeddings")
def parsed_vectors(spark, d):
    text = F.to_json(V.doubles(F.col("embedding")))
    return table(spark, d, "embeddings").select("vec_id", F.transform(V.parsed(text), lambda x: (x * 1_000_000).cast("bigint")).alias("vector"))


@query("SELECT vec_id, list_transform(embedding, lambda x: trunc(x::DOUBLE * 10000)::BIGINT / 10000.0::DOUBLE) AS vector FROM embeddings WHERE list_max(list_transform(embedding, lambda x: abs(trunc(x::DOUBLE * 10000)))) > 1000")
def dequantised_vectors(spark, d):
    q = table(spark, d, "embeddings").select("vec_id", V.quantised(F.col("embedding")).alias("q"))
    return q.where(F.array_max(F.transform("q", lambda x: F.abs(x))) > 1000).select("vec_id", V.dequantised(F.col("q")).alias("vector"))


@query(f"SELECT item_id, coalesce(s, 0.0) AS score FROM benchmark LEFT JOIN (SELECT text, arg_min(s, doc_id) AS s FROM (SELECT d.text, d.doc_id, round(list_cosine_similarity(e.embedding::DOUBLE[], {_Q0}::DOUBLE[]), 6) AS s FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id) GROUP BY text) c USING (text)")
def similarity_of_content(spark, d):
    e = retrieval.similar(table(spark, d, "embeddings"), _vector(spark, d, 0)).select(F.col("vec_id").alias("doc_id"), "score")
    chunks = _docs(spark, d).select("doc_id", "text").join(e, "doc_id")
    return retrieval.similarity_of_content(table(spark, d, "benchmark"), chunks, "text", "score", "doc_id").select("item_id", "score")


_WORDS2 = f"SELECT w AS word, [length(w)::DOUBLE, ascii(w)::DOUBLE] AS v FROM (SELECT DISTINCT unnest({_TOKENS}) AS w FROM benchmark)"


@query(f"SELECT word, near, score, rank FROM (SELECT a.word AS word, b.word AS near, round(list_cosine_similarity(a.v, b.v), 6) AS score, row_number() OVER (PARTITION BY a.word ORDER BY round(list_cosine_similarity(a.v, b.v), 6) DESC, b.word)::INT AS rank FROM ({_WORDS2}) a JOIN ({_WORDS2}) b ON a.word <> b.word WHERE a.word IN ('the', 'and', 'with')) WHERE rank <= 5")
def similar_words(spark, d):
    words = table(spark, d, "benchmark").select(F.explode(X.whitespace_tokens(F.lower("text"))).alias("word")).distinct()
    vocabulary = words.select("word", F.array(F.length("word").cast("double"), F.ascii("word").cast("double")).alias("vector"))
    return retrieval.most_similar(vocabulary, ["the", "and", "with"])


# -- keyword lookups and query expansion

KEYWORDS = {"articles": ["the", "a", "an"], "joins": ["and", "or"], "ties": ["with"], "romance": ["que"], "german": ["der", "die"]}
_KEYWORD_ROWS = ", ".join(f"('{t}', {i}, '{w}')" for t, ws in KEYWORDS.items() for i, w in enumerate(ws))
_TYPE_ROWS = ", ".join(f"({i}, '{t}', '{w}')" for i, (w, t) in enumerate((w, t) for w, ts in INDICATORS.items() for t in ts))


@query(f"SELECT item_id, type, v.place, v.keyword FROM (SELECT item_id, type, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, type) AS rn FROM (SELECT item_id, t.type, sum(contains(lower(text), t.word)::INT) AS score FROM benchmark, (VALUES {_TYPE_ROWS}) AS t(place, type, word) GROUP BY 1, 2) WHERE score > 0) JOIN (VALUES {_KEYWORD_ROWS}) AS v(type, place, keyword) USING (type) WHERE rn <= 2")
def keywords_of_types(spark, d):
    types = retrieval.query_types(F.col("text"), INDICATORS, most=9, fallback=(("none", 0.0),))
    rows = table(spark, d, "benchmark").select("item_id", F.inline(types)).where("score > 0")
    return retrieval.keywords_of_types(rows, "item_id", KEYWORDS)


@query("SELECT doc_id, source || ' ' || (CASE lang WHEN 'en' THEN 'the of and' WHEN 'de' THEN 'der die' ELSE 'a b c d e' END) || ' targets' AS query FROM documents")
def expanded_queries(spark, d):
    words = {"en": ["the", "of", "and"], "de": ["der", "die"]}
    return _docs(spark, d).select("doc_id", retrieval.expanded(F.lit("targets"), F.col("source"), F.col("lang"), words, ["a", "b", "c", "d", "e", "f"]).alias("query"))


@query(f"SELECT m.*, d.lang FROM ({catalog._SQL['multi_hop']}) m JOIN documents d ON d.doc_id = m.node WHERE d.lang = 'en'")
def hops_by_country(spark, d):
    hops = catalog._walk(spark, d, catalog._edges(spark, d))
    return graph.of_country(hops, _docs(spark, d), "node", "doc_id", "lang", "en").select("node", "hops", "confidence", "relevance", "lang")


# -- stored frames


@query(f"SELECT o.doc_id, o.lang, CASE WHEN n.doc_id IS NULL THEN o.source WHEN n.doc_id % 13 <> 0 THEN n.source END AS source, o.hash FROM {_OLD} o LEFT JOIN {_NEW} n USING (doc_id)")
def update_from(spark, d):
    old, new = _old_new(spark, d)
    cleared = new.withColumn("source", F.when(F.col("doc_id") % 13 != 0, F.col("source")))
    return changes.update_from(old, cleared, "doc_id", ["source"])


@query("SELECT source, target FROM (SELECT doc_id AS source, doc_id + 1 AS target FROM documents) WHERE source % 10 <> 0 AND target % 10 <> 0")
def cascade_edges(spark, d):
    docs = _docs(spark, d).select("doc_id")
    chunks = docs.select("doc_id", F.col("doc_id").alias("chunk_id"))
    more = chunks.unionAll(chunks.agg((F.max("doc_id") + 1).alias("doc_id"), (F.max("chunk_id") + 1).alias("chunk_id")))
    edges = docs.select(F.col("doc_id").alias("source"), (F.col("doc_id") + 1).alias("target"))
    return changes.cascade_delete(docs, more, edges, more.where("doc_id % 10 = 0").select("doc_id").distinct())[2]


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN TIMESTAMP '2024-05-01 00:00:00' END AS processed_at FROM documents")
def processed_marks(spark, d):
    docs = _docs(spark, d).select("doc_id", F.lit(None).cast("timestamp_ntz").alias("processed_at"))
    return changes.marked(docs, docs.where("doc_id % 4 = 0").select("doc_id"), "doc_id", "processed_at", F.lit("2024-05-01 00:00:00").cast("timestamp_ntz"))


@query("SELECT batch, count(*)::BIGINT AS n FROM (SELECT conv_id, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2)::INT AS batch FROM conversations) GROUP BY batch")
def upload_batches(spark, d):
    return changes.batched(table(spark, d, "conversations"), "conv_id", "turn", 2).groupBy("batch").agg(F.count("*").alias("n"))


@query("SELECT count(*)::BIGINT AS total, sum((doc_id % 5 > 0)::INT)::BIGINT AS uploaded, sum((doc_id % 5 = 0)::INT)::BIGINT AS failed, sum(n_chars)::BIGINT AS chars FROM documents")
def upload_summary(spark, d):
    return report.upload_summary(_docs(spark, d), F.col("doc_id") % 5 > 0, "n_chars")


# -- reports


@query("SELECT role, nth, text FROM (SELECT role, text, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn)::INT AS nth FROM (SELECT *, row_number() OVER (PARTITION BY role, text ORDER BY conv_id, turn) AS n FROM conversations) WHERE n = 1)")
def citations_by_country(spark, d):
    return report.cited_contents(table(spark, d, "conversations"), "role", "text", ["conv_id", "turn"])


@query("SELECT max(degree) AS max_centrality, count(DISTINCT community)::BIGINT AS communities_found FROM (SELECT round(vec_id / 7.0, 6)::DOUBLE AS degree, label AS community FROM embeddings)")
def graph_stats(spark, d):
    return graph.stats(table(spark, d, "embeddings").select(F.round(F.col("vec_id") / 7.0, 6).cast("double").alias("degree"), F.col("label").alias("community")), "degree", "community")


@query("""SELECT doc_id, '{"metadata":{"doc_id":' || doc_id || ',"chunks":1},"chunks":[{"n_chars":' || n_chars || '}]}' AS json FROM documents""")
def chunk_dump(spark, d):
    chunks = _docs(spark, d).groupBy("doc_id").agg(F.collect_list(F.struct("n_chars")).alias("chunks"))
    return report.with_header(chunks, "doc_id", "chunks")


@query("SELECT lang, '# ' || lang || chr(10) || string_agg('- ' || source || ': ' || n, chr(10) ORDER BY source) AS markdown FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY lang")
def markdown_reports(spark, d):
    return report.markdown(_docs(spark, d).groupBy("lang", "source").agg(F.count("*").alias("n")), "lang", "source", "n")


@query("SELECT '<h1>' || replace(replace(lang, '&', '&amp;'), '<', '&lt;') || '</h1><p>' || count(*) || '</p>' AS html, lang FROM documents GROUP BY lang")
def html_reports(spark, d):
    n = _docs(spark, d).groupBy("lang").agg(F.count("*").alias("n"))
    return n.select("lang", report.html(F.col("lang"), F.col("n").cast("string")).alias("html"))


@query("SELECT item_id, 'Question: ' || text || chr(10) || 'Item ' || item_id || '.' AS prompt FROM benchmark")
def filled_templates(spark, d):
    return table(spark, d, "benchmark").select("item_id", report.fill("Question: {q}\nItem {i}.", q=F.col("text"), i=F.col("item_id")).alias("prompt"))


@query("SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN doc_id % 6 = 0 THEN 'No answer could be given.' ELSE 'text of ' || doc_id END AS answer FROM documents")
def error_rows(spark, d):
    answer = F.when(F.col("doc_id") % 6 > 0, F.concat(F.lit("text of "), F.col("doc_id").cast("string")))
    shaped = report.answer_or_error(answer)
    return _docs(spark, d).select("doc_id", shaped["status"].alias("status"), shaped["answer"].alias("answer"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'english' ELSE 'multilingual' END AS chain FROM documents")
def chain_of_language(spark, d):
    return _docs(spark, d).select("doc_id", report.chain(F.col("lang"), {"en": "english"}, "multilingual").alias("chain"))


@query("SELECT lang, page, coalesce(string_agg(CASE WHEN p = 0 THEN doc_id::VARCHAR END, ', ' ORDER BY doc_id), '') AS near_term, coalesce(string_agg(CASE WHEN p = 1 THEN doc_id::VARCHAR END, ', ' ORDER BY doc_id), '') AS mid_term, coalesce(string_agg(CASE WHEN p = 2 THEN doc_id::VARCHAR END, ', ' ORDER BY doc_id), '') AS long_term FROM (SELECT lang, doc_id, doc_id % 3 AS p, ((row_number() OVER (PARTITION BY lang, doc_id % 3 ORDER BY doc_id) - 1) // 50)::INT AS page FROM documents) GROUP BY lang, page")
def sector_periods(spark, d):
    period = F.element_at(F.array(F.lit("near_term"), F.lit("mid_term"), F.lit("long_term")), (F.col("doc_id") % 3 + 1).cast("int"))
    return report.by_period(_docs(spark, d).select("lang", "doc_id", period.alias("period")), "lang", "period", ["near_term", "mid_term", "long_term"], "doc_id", page=50)


@query("SELECT lang, count(*)::BIGINT AS n, sum((l.toxic IS NULL)::INT)::BIGINT AS missing, sum((l.toxic = (d.doc_id % 2))::INT)::BIGINT AS agree FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id GROUP BY lang")
def assessment_comparison(spark, d):
    predicted = _docs(spark, d).select("doc_id", "lang", (F.col("doc_id") % 2).cast("int").alias("answer"))
    truth = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("truth"))
    return evaluation.comparison(predicted, truth, "doc_id", "lang", "answer", "truth")


@query("SELECT doc_id, (lower(lang) IN ('en', 'de'))::INT AS y FROM documents")
def binarised(spark, d):
    return _docs(spark, d).select("doc_id", evaluation.binary(F.col("lang"), ("en", "de")).alias("y"))


_MD = "'# T' || chr(10) || '### ' || role || chr(10) || 'Body' || chr(10) || 'Source URL: http://x/' || turn"


@query("SELECT conv_id, turn, role AS question, 'http://x/' || turn AS url FROM conversations")
def answer_blocks(spark, d):
    md = F.concat(F.lit("# T\n### "), "role", F.lit("\nBody\nSource URL: http://x/"), F.col("turn").cast("string"))
    return extract.answer_blocks(table(spark, d, "conversations").select("conv_id", "turn", md.alias("md")), "md").select("conv_id", "turn", "question", "url")


@query("SELECT doc_id, lang AS label, (doc_id % 90 + 10) / 100.0::DOUBLE AS confidence FROM documents")
def confidence_lines(spark, d):
    md = F.concat(F.lit("# R\n## "), "lang", F.lit("\nConfidence: 0."), (F.col("doc_id") % 90 + 10).cast("string"))
    return extract.confidences(_docs(spark, d).select("doc_id", md.alias("md")), "md").select("doc_id", "label", "confidence")


# -- extraction strategies


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'fast' WHEN 1 THEN 'auto' WHEN 2 THEN 'ocr' ELSE 'placeholder' END AS strategy, CASE WHEN doc_id % 4 = 3 THEN 'No text could be extracted.' ELSE source END AS content FROM documents")
def strategy_fallback(spark, d):
    k = F.col("doc_id") % 4
    got = chunking.first_strategy({"fast": F.when(k == 0, F.col("source")), "auto": F.when(k == 1, F.col("source")).otherwise(""), "ocr": F.when(k <= 2, F.col("source"))})
    return _docs(spark, d).select("doc_id", got["strategy"].alias("strategy"), got["content"].alias("content"))


@query(r"SELECT doc_id, (n = 0 OR (n < 5 AND bad > 0)) AS retry FROM (SELECT doc_id, sum((trim(line) <> '')::INT) AS n, sum(contains(line, 'the')::INT) AS bad FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id)")
def ocr_retry(spark, d):
    lines = _docs(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return chunking.needs_ocr(lines, "doc_id", "line", F.contains("line", F.lit("the")))
