"""Every query by name, with its SQL for DuckDB where SQL can express it.

The driver tables carry no crawl metadata, so statuses, sessions and delays are derived from their keys by the same
expression on both sides. Scores are rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as X
from ..functions.embed import HashingEmbedder, embed_column
from ..functions.partition import spread
from ..operators import answer as A
from ..operators import catalog as G
from ..operators import crawl as C
from ..operators import extract as E
from ..operators import index as I
from ..operators import keyword_index as K
from ..operators import latent as L
from ..operators import retrieve as R
from ..operators import vector_index as V
from ..operators.paging import PagedTable
from ..operators.substring_index import SubstringIndex, simple_upper
from ..sources.staging import kept, kept_folder, staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---------------------------------------------------------------- shared derivations

STATUS = "CASE page_id % 4 WHEN 0 THEN 'crawled' WHEN 1 THEN 'pending' WHEN 2 THEN 'failed' ELSE 'skipped' END"
HOST_SQL = r"regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"


def pages_of(spark, d):
    """pages with id, site (host), status and content hash."""
    p = table(spark, d, "pages")
    return p.select(F.col("page_id").alias("id"), X.host(F.col("url")).alias("site_id"), "url", F.expr(STATUS).alias("status"), "html")


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols or ("score",)})


TOKENS_SQL = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
VEC_SQL = "list_cosine_similarity(a.embedding::double[], b.embedding::double[])"
RANK_SQL = "0.1 / 1.64493406685 * list_sum(list_transform(range(1, least(tf, 255) + 1), lambda j: 1.0 / (j * j)))"


def keyword_sql(texts: str, queries: str) -> str:
    """CTEs ending in kw(query_id, chunk_id, score)."""
    return f"""
lx as (select query_id, unnest(list_distinct({TOKENS_SQL.format("q")})) as lexeme, len(list_distinct({TOKENS_SQL.format("q")})) as n from {queries}),
po as (select chunk_id, lexeme, count(*) as tf from (select chunk_id, unnest({TOKENS_SQL.format("text")}) as lexeme from {texts}) group by all),
kw as (select query_id, chunk_id, round(sum({RANK_SQL.replace("tf", "po.tf")} / n), 12) as score from po join lx using (lexeme) group by all)"""


#: Every row whose id is divisible by this is a query of the searches.
EVERY = 50
CHUNKS_SQL = "select doc_id as chunk_id, text, embedding from documents left join embeddings on doc_id = vec_id"


def all_chunks(spark, d):
    """All documents as chunks: chunk_id, text, embedding. Those without a vector are found by their words alone."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return docs.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id", "left")


def all_queries(spark, d):
    """query_id, q, vector: text and vector of every row that is a query."""
    return all_chunks(spark, d).where(F.col("chunk_id") % EVERY == 0).select(F.col("chunk_id").alias("query_id"), F.col("text").alias("q"), F.col("embedding").alias("vector"))


def keyword_index(spark, d, analyzer="simple"):
    """The keyword index of all documents for many queries at once, built once a session."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return kept(spark, f"keyword-{analyzer}", [f"{d}/documents.parquet"], lambda: K.build_whole(I.terms(texts, analyzer)))


def vectors_of(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def vector_queries(spark, d):
    """Vectors that are queries: query_id, vector."""
    return vectors_of(spark, d).where(F.col("chunk_id") % EVERY == 0).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))


# ---------------------------------------------------------------- retrieval


def topk_sql(k: int) -> str:
    return f"""select query_id, rank, chunk_id, score from (select b.vec_id as query_id, a.vec_id as chunk_id, round({VEC_SQL}, 6) as score,
row_number() over (partition by b.vec_id order by round({VEC_SQL}, 12) desc, a.vec_id) as rank from embeddings a, (select * from embeddings where vec_id % {EVERY} = 0) b) where rank <= {k}"""


def top_vectors(spark, d, k):
    return rounded(R.vector_search(vectors_of(spark, d), vector_queries(spark, d), k)).withColumn("rank", F.col("rank").cast("bigint"))


@query(topk_sql(10))
def vector_topk(spark, d):
    return top_vectors(spark, d, 10)


@query(topk_sql(5))
def vector_topk_batch(spark, d):
    return top_vectors(spark, d, 5)


def vector_index(spark, d):
    """The index of all vectors, built once a session."""
    path = kept_folder(spark, "vectors", [f"{d}/embeddings.parquet"], lambda at: V.Index.build(vectors_of(spark, d), at))
    return V.Index.open(spark, path)


@query()
def ann_topk(spark, d):
    """The approximate search of every 50th vector against all."""
    return rounded(vector_index(spark, d).search(vector_queries(spark, d), 10)).withColumn("rank", F.col("rank").cast("bigint"))


@query()
def ann_recall(spark, d):
    """The share of the exact search's rows that the approximate one finds, by query."""
    found = vector_index(spark, d).search(vector_queries(spark, d), 10)
    return V.recall(found, R.vector_search(vectors_of(spark, d), vector_queries(spark, d), 10))


@query(f"""with qs as (select doc_id as query_id, text as q from documents where doc_id % {EVERY} = 0), tx as (select doc_id as chunk_id, text from documents), {keyword_sql('tx', 'qs')}
select query_id, rank, chunk_id, round(score, 6) as score from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from kw) where rank <= 10""")
def keyword_or_rank(spark, d):
    return rounded(R.keyword_search(keyword_index(spark, d), all_queries(spark, d), 10)).withColumn("rank", F.col("rank").cast("bigint"))


@query()
def keyword_english(spark, d):
    english, queries = I.english(spark), all_queries(spark, d)
    lex = queries.withColumn("terms", F.array_distinct(english("q"))).select("query_id", F.col("terms").alias("own"), F.size("terms").alias("n"))
    return rounded(R.keyword_search(keyword_index(spark, d, "english"), queries, 10, lex))


def fused_sql(pool: int, queries: str) -> str:
    """queries(query_id, q, vec): both arms, fused into hy(query_id, chunk_id, score, rank)."""
    return f"""
ch as ({CHUNKS_SQL}),
qs as ({queries}), {keyword_sql('ch', 'qs')},
ve as (select query_id, a.chunk_id, round({VEC_SQL}, 12) as score from ch a, (select qs.query_id, embedding from qs join embeddings on vec = vec_id) b where a.embedding is not null),
li as (select query_id, 0 as list, chunk_id, row_number() over (partition by query_id order by score desc, chunk_id) as rank from ve union all
       select query_id, 1, chunk_id, row_number() over (partition by query_id order by score desc, chunk_id) from kw),
fu as (select query_id, chunk_id, list_sum(list(1.0::double / (60 + rank) order by list)) as score, min(list * 1000000 + rank) as first from li where rank <= {pool} group by all),
hy as (select query_id, chunk_id, score, row_number() over (partition by query_id order by round(score, 12) desc, first) as rank from fu)"""


QUERIES_SQL = f"select doc_id as query_id, text as q, doc_id as vec from documents where doc_id % {EVERY} = 0"


def found_by_all(spark, d, k=5):
    """query_id, rank, chunk_id, score: the hybrid search of all queries, done once for the queries that start from its hits."""
    make = lambda: R.hybrid_search(all_chunks(spark, d), keyword_index(spark, d), all_queries(spark, d), k)
    found = kept(spark, f"hits-{k}", [f"{d}/documents.parquet", f"{d}/embeddings.parquet"], make)
    return found.withColumn("rank", F.col("rank").cast("bigint"))


@query(f"""with {fused_sql(10, QUERIES_SQL)}
select query_id, rank, chunk_id, round(score, 6) as score from hy where rank <= 5""")
def hybrid_rrf(spark, d):
    return rounded(found_by_all(spark, d))


@query(f"""with {fused_sql(10, QUERIES_SQL)},
mu as (select query_id // {2 * EVERY} as query_id, chunk_id, list_sum(list(1.0::double / (60 + rank) order by query_id)) as score, min(query_id // {EVERY} % 2 * 1000000 + rank) as first from hy where rank <= 10 group by query_id // {2 * EVERY}, chunk_id),
ra as (select *, row_number() over (partition by query_id order by round(score, 12) desc, first) as rank from mu)
select query_id, rank, chunk_id, round(score, 6) as score from ra where rank <= 8""")
def multi_query_rrf(spark, d):
    """Every query is a sub-query; two that follow each other by id are one question."""
    subs = all_queries(spark, d).select(F.floor(F.col("query_id") / (2 * EVERY)).alias("group_id"), F.floor(F.col("query_id") / EVERY % 2).cast("int").alias("sub"), "q", "vector")
    return rounded(R.multi_search(all_chunks(spark, d), keyword_index(spark, d), subs, 8)).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"""with r as (select b.vec_id as query_id, b.label as want, a.label as got, row_number() over (partition by b.vec_id order by round({VEC_SQL}, 12) desc, a.vec_id) as rank
from embeddings a, (select * from embeddings where vec_id % {EVERY} = 0) b where a.vec_id <> b.vec_id),
f as (select query_id, min(case when want = got and rank <= 5 then rank end) as first from r group by all)
select round(avg((first is not null)::int), 6) as hit_rate, round(avg(coalesce(1.0 / first, 0)), 6) as mrr from f""")
def retrieval_eval(spark, d):
    return judged(table(spark, d, "embeddings"), f"vec_id % {EVERY} = 0")


def judged(e, asked):
    """hit_rate and mrr of the rows of e that are asked: whether a row with the same label is found."""
    queries = e.where(asked).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    hits = R.vector_search(e.select(F.col("vec_id").alias("chunk_id"), "embedding"), queries, 6).where("chunk_id <> query_id")
    w = Window.partitionBy("query_id").orderBy("rank")
    hits = hits.withColumn("rank", F.row_number().over(w)).join(e.select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("/"), F.col("label").cast("string"), F.lit("/")).alias("url")), "chunk_id")
    goldens = e.where(asked).select(F.col("vec_id").alias("query_id"), F.concat(F.lit("/"), F.col("label").cast("string"), F.lit("/")).alias("expect"))
    return rounded(R.evaluate(hits, goldens, 5), "hit_rate", "mrr")


@query()
def latent_eval(spark, d):
    """hit_rate and mrr by language of every 50th document: of latent vectors of the corpus, and of as long hash vectors."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "lang")
    out = None
    for name, embedder in (("latent", L.fit(docs)), ("hash", HashingEmbedder(L.DIMENSIONS))):
        vectors = embed_column(spread(docs), "text", embedder).select(F.col("chunk_id").alias("vec_id"), "embedding", F.col("lang").alias("label"))
        vectors = staged(vectors, "embedded")  # texts are embedded once, not for each block of queries
        found = judged(vectors, f"vec_id % {EVERY} = 0").withColumn("embedder", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out


def hits_of(spark, d):
    """The results of the hybrid search of all queries with url, title and the whole text."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("https://"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), "text")
    return docs.join(found_by_all(spark, d), "chunk_id")


HITS_SQL = f"""with {fused_sql(10, QUERIES_SQL)},
hits as (select query_id, rank, 'https://' || source || '/' || doc_id as url, 'Doc ' || doc_id as title, d.text from hy join documents d on doc_id = chunk_id where rank <= 5)"""


@query(f"{HITS_SQL} select query_id, string_agg('[' || rank || '] Source: ' || url || chr(10) || text, chr(10) || chr(10) order by rank) as context from hits group by 1")
def rag_context(spark, d):
    return A.context(hits_of(spark, d))


@query(f"{HITS_SQL} select query_id, rank as marker, url, title, case when length(text) > 160 then left(text, 160) || '…' else text end as snippet from hits")
def citations(spark, d):
    return A.citations(hits_of(spark, d))


@query(f"{HITS_SQL} select query_id, count(distinct url) as n_sources from hits group by 1")
def distinct_sources(spark, d):
    return hits_of(spark, d).groupBy("query_id").agg(F.countDistinct("url").alias("n_sources"))


@query(f"{HITS_SQL} select query_id, count(distinct {HOST_SQL}) as n_hosts, count(distinct {HOST_SQL}) >= 2 as multi_source from hits group by 1")
def multi_source_hosts(spark, d):
    hosts = hits_of(spark, d).groupBy("query_id").agg(F.countDistinct(X.host(F.col("url"))).alias("n_hosts"))
    return hosts.withColumn("multi_source", F.col("n_hosts") >= 2)


@query("""with a as (select doc_id, 'As ' || replace(replace(text, '[', ''), ']', '') || ' says [' || (doc_id % 7) || '], see [' || (doc_id % 3 + 1) || '].' as answer from documents),
m as (select doc_id, pos, list_extract(found, pos)::bigint as marker from (select doc_id, regexp_extract_all(answer, '\\[(\\d+)\\]', 1) as found, unnest(range(1, len(regexp_extract_all(answer, '\\[(\\d+)\\]', 1)) + 1)) as pos from a))
select doc_id, pos, marker, case when marker between 1 and 5 then 'https://source/' || marker end as url from m""".replace("\\\\", "\\"))
def inline_citations(spark, d):
    return cited_inline(spark, d, F.regexp_replace("text", r"[\[\]]", ""))


def cited_inline(spark, d, body):
    said = F.concat(F.lit("As "), body, F.lit(" says ["), (F.col("doc_id") % 7).cast("string"), F.lit("], see ["), (F.col("doc_id") % 3 + 1).cast("string"), F.lit("]."))
    m = table(spark, d, "documents").select("doc_id", F.posexplode(A.cited_markers(said)).alias("pos", "marker"))
    sources = spark.range(1, 6).select(F.col("id").alias("marker"), F.concat(F.lit("https://source/"), F.col("id").cast("string")).alias("url"))
    return m.withColumn("pos", F.col("pos").cast("bigint") + 1).join(F.broadcast(sources), "marker", "left")


# ---------------------------------------------------------------- listings and statistics


@query(f"select {HOST_SQL} as host, count(*) as n from pages group by 1")
def host_counts(spark, d):
    return table(spark, d, "pages").groupBy(X.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query(f"""with p as (select *, {HOST_SQL} as host, {STATUS} as status from pages), s as (select distinct host from p union select 'empty.example')
select s.host as id, count(p.page_id) as n_pages, count(*) filter (p.status = 'crawled') as n_crawled, (s.host like 'm.%') as robots_txt_cached from s left join p using (host) group by 1""")
def site_page_counts(spark, d):
    p = pages_of(spark, d).drop("html")
    sites = p.select(F.col("site_id").alias("id")).union(spark.createDataFrame([("empty.example",)], "id string")).distinct().withColumn("robots_txt", F.when(F.col("id").startswith("m."), "User-agent: *"))
    return G.site_page_counts(sites, p)


@query(f"""select count(distinct {HOST_SQL}) as sites, count(*) as pages, count(*) filter (page_id % 4 = 0) as pages_crawled, count(*) filter (page_id % 4 = 2) as pages_failed,
count(*) filter (page_id % 4 = 3) as pages_skipped, count(*) filter (page_id % 4 = 1) as pages_pending, count(*) as page_versions, (select count(*) from documents) as documents,
(select count(*) from embeddings) as chunks, (select count(*) from embeddings where label % 2 = 0) as chunks_embedded, (select count(*) from events where event_type = 'error') as dead_letter_jobs from pages""")
def pipeline_totals(spark, d):
    p = pages_of(spark, d).drop("html")
    chunks = table(spark, d, "embeddings").select(F.when(F.col("label") % 2 == 0, F.col("vec_id")).alias("embedding"))
    return G.totals(p.select("site_id").distinct(), p, p, table(spark, d, "documents"), chunks, table(spark, d, "events").where("event_type = 'error'"))


@query(f"""select page_id as id, {HOST_SQL} as site_id, url, {STATUS} as status, length(html) as raw_length, 'Site ' || {HOST_SQL} as site_name from pages
where page_id % 4 <> 1 and url ilike '%example_com%' order by page_id desc limit 20 offset 5""")
def list_pages(spark, d):
    p = pages_of(spark, d)
    sites = p.select(F.col("site_id").alias("id")).distinct().select("id", F.concat(F.lit("Site "), "id").alias("name"), F.col("id").alias("base_url"))
    rows = G.pages_where(p.where("status <> 'pending'"), q="example_com").withColumn("raw_length", F.length("html").cast("bigint")).drop("html")
    return G.with_site(G.paginated(rows, 20, 5), sites).select("id", "site_id", "url", "status", "raw_length", "site_name")


@query("select count(*) as total from pages where page_id % 4 = 0 and url ilike '%EXAMPLE.net%'")
def list_pages_total(spark, d):
    return G.pages_where(pages_of(spark, d).drop("html"), status="crawled", q="EXAMPLE.net").agg(F.count("*").alias("total"))


DOCS_SQL = f"""(select doc_id as id, page_id, {HOST_SQL.replace('url', 'p.url')} as site_id, p.url, 'Doc ' || doc_id as title, text as cleaned_text,
case when length(text) < 500 then 'listing' else 'article' end as content_type from documents join pages p on doc_id = page_id)"""


def documents_of(spark, d):
    """Documents with a page of the same id: (documents, versions, pages) in stage-table form."""
    docs = table(spark, d, "documents")
    text = F.col("text")
    docs = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("page_version_id"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), text.alias("cleaned_text"), X.content_type(text, F.lit(0), F.lit(False)).alias("content_type"))
    pages = pages_of(spark, d).drop("html")
    return docs, pages.select("id", F.col("id").alias("page_id"), F.lit(1).alias("version_no")), pages


@query(f"""select id, site_id, url, title, content_type, left(cleaned_text, 300) as excerpt, length(cleaned_text) as length from {DOCS_SQL}
where content_type = 'article' and (title ilike '%oc%' or cleaned_text ilike '%the%') order by id desc limit 20 offset 2""")
def list_documents(spark, d):
    rows = G.documents_where(*documents_of(spark, d), content_type="article", q="oc")
    return G.paginated(rows, 20, 2).select("id", "site_id", "url", "title", "content_type", "excerpt", F.col("length").cast("bigint").alias("length"))


SQL["list_documents"] = SQL["list_documents"].replace("cleaned_text ilike '%the%'", "cleaned_text ilike '%oc%'")


@query("""with n as (select count(*) as n from documents), d as (select doc_id, lang, length(text) as length, row_number() over (order by doc_id desc) - 1 as place from documents)
select doc_id, lang, length, place, n as total from d, n where place >= n * 3 // 4 and place < n * 3 // 4 + 100""")
def deep_page(spark, d):
    """A page of all documents, three quarters down the listing, with the total."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.length("text").cast("bigint").alias("length"))
    path = kept_folder(spark, "paged", [f"{d}/documents.parquet"], lambda at: PagedTable.build(docs, at, "doc_id"))
    pages = PagedTable(spark, path, "doc_id")
    total = pages.total()
    rows = pages.page(100, total * 3 // 4)
    place = F.row_number().over(Window.orderBy(F.desc("doc_id"))) - 1 + total * 3 // 4  # a hundred rows
    return rows.withColumns({"place": place.cast("bigint"), "total": F.lit(total).cast("bigint")})


@query(f"select count(distinct id) as total from {DOCS_SQL} where title ilike '%1%' or cleaned_text ilike '%1%'")
def list_documents_total(spark, d):
    return G.documents_where(*documents_of(spark, d), q="1").agg(F.countDistinct("id").alias("total"))


#: A pattern of every 50th text: eight of its characters with anything before, between and behind, or with one unknown character.
PATTERN = "case when doc_id % 100 = 0 then '%' || substr(text, 5, 4) || '%' || substr(text, 30, 4) || '%' else '%' || upper(substr(text, 8, 4)) || '_' || substr(text, 13, 4) || '%' end"


@query(f"""with p as (select doc_id as pattern_id, {PATTERN} as pattern from documents where doc_id % {EVERY} = 0)
select pattern_id, doc_id from documents join p on text ilike pattern""")
def substring_search(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    path = kept_folder(spark, "trigrams", [f"{d}/documents.parquet"], lambda at: SubstringIndex.build(docs, at))
    any_, cut = F.lit("%"), lambda at: F.substring("text", at, 4)
    loud = F.concat(any_, simple_upper(cut(8)), F.lit("_"), cut(13), any_)  # upper() makes two characters of some
    pattern = F.when(F.col("doc_id") % 100 == 0, F.concat(any_, cut(5), any_, cut(30), any_)).otherwise(loud)
    asked = table(spark, d, "documents").where(F.col("doc_id") % EVERY == 0).select(F.col("doc_id").alias("pattern_id"), pattern.alias("pattern"))
    return SubstringIndex(spark, path).search(asked).withColumnRenamed("id", "doc_id")


@query("""select d.doc_id as document_id, count(l.doc_id) as n_chunks, count(l.v) as n_embedded, case when count(l.doc_id) > 0 then round(count(l.v) / count(l.doc_id) * 100) else 0 end as percent
from documents d left join (select c.conv_id as doc_id, case when turn % 3 = 0 then 1 end as v from conversations c) l using (doc_id) group by 1""")
def chunk_progress(spark, d):
    chunks = table(spark, d, "conversations").select(F.col("conv_id").alias("document_id"), F.when(F.col("turn") % 3 == 0, 1).alias("embedding"))
    return G.chunk_progress(table(spark, d, "documents").select(F.col("doc_id").alias("id")), chunks)


@query("""select conv_id as document_id, list(turn order by turn) as chunk_order, count(*) as n_chunks from conversations group by 1""")
def document_chunks(spark, d):
    one = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("document_id"))
    return one.agg(F.array_sort(F.collect_list("turn")).alias("chunk_order"), F.count("*").alias("n_chunks"))  # chunks of one document


@query("""select user_id as page_id, version_no, event_type as content from (select *, row_number() over (partition by user_id order by version_no desc) as r from
(select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) as version_no from events)) where r = 1""")
def page_latest_version(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v = table(spark, d, "events").select(F.col("user_id").alias("page_id"), F.row_number().over(w).cast("bigint").alias("version_no"), F.col("event_type").alias("content"))
    return G.latest_versions(v, ["content"])


@query("""select page_id, coalesce(d.doc_id, -1) as document_id, coalesce(p.url, '') as url from pages p left join (select doc_id from labels) d on page_id = doc_id""")
def version_document(spark, d):
    labels = table(spark, d, "labels").select("doc_id")
    p = table(spark, d, "pages").select("page_id", "url")
    return p.join(labels, p.page_id == labels.doc_id, "left").select("page_id", F.coalesce("doc_id", F.lit(-1)).alias("document_id"), F.coalesce("url", F.lit("")).alias("url"))


@query("""with s as (select user_id as id, user_id % 7 as site_id, count(*) as n from events group by all)
select id, site_id, n, case when site_id < 5 then 'Site ' || site_id end as site_name from s order by id desc limit 5""")
def recent_sessions(spark, d):
    s = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n")).withColumn("site_id", F.col("id") % 7)
    sites = spark.range(5).select("id", F.concat(F.lit("Site "), F.col("id").cast("string")).alias("name"), F.lit("").alias("base_url"))
    return G.recent_sessions(s, sites).select("id", "site_id", "n", "site_name")


@query("""select event_type as queue, count(*) filter (event_id % 5 = 0) as waiting, count(*) filter (event_id % 5 = 1) as active, count(*) filter (event_id % 5 = 2) as completed,
count(*) filter (event_id % 5 = 3) as failed, count(*) filter (event_id % 5 = 4) as delayed from events group by 1""")
def queue_depth(spark, d):
    state = F.element_at(F.array(*map(F.lit, ("waiting", "active", "completed", "failed", "delayed"))), (F.col("event_id") % 5 + 1).cast("int"))
    return G.queue_depths(table(spark, d, "events").select(F.col("event_type").alias("queue"), state.alias("state")))


# ---------------------------------------------------------------- crawl state


@query("""select page, ts, event_id, sha256(event_type) as content_hash, sum(new) over (partition by page order by ts, event_id)::bigint as version_no from
(select user_id as page, ts, event_id, event_type, case when lag(event_type) over (partition by user_id order by ts, event_id) is distinct from event_type then 1 else 0 end as new from events) qualify new = 1""")
def version_history(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("page"), F.col("ts").alias("fetched_at"), F.col("event_id").alias("seq"), X.sha(F.col("event_type")).alias("content_hash"))
    return C.versions(e).withColumnsRenamed({"fetched_at": "ts", "seq": "event_id"})


@query("""with e as (select user_id, event_id, epoch_us(ts) as now_us, row_number() over (partition by user_id order by ts, event_id) - 1 as i from events)
select user_id as domain, event_id as seq, now_us, i * 21600000000 + max(now_us - i * 21600000000) over (partition by user_id order by i) as slot,
i * 21600000000 + max(now_us - i * 21600000000) over (partition by user_id order by i) - now_us as wait from e""")
def rate_slots(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("domain"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("now_us"), F.lit(21_600_000_000).alias("delay"))
    return C.rate_slots(e).drop("delay")


@query(f"""with l as (select {HOST_SQL} as session, page_id // 5 as parent, page_id as place, url from pages),
c as (select *, 1 + row_number() over (partition by session order by parent, place) > 6 as beyond from l),
o as (select *, coalesce(sum(beyond::int) over (partition by session, parent order by place rows between unbounded preceding and 1 preceding), 0) as earlier from c)
select session, parent, place, url, case when not beyond then 'enqueued' when earlier = 0 then 'skipped' else 'dropped' end as outcome from o""")
def page_budget(spark, d):
    links = table(spark, d, "pages").select(X.host(F.col("url")).alias("session"), F.floor(F.col("page_id") / 5).alias("parent"), F.col("page_id").alias("place"), "url")
    counted = links.select("session").distinct().withColumns({"prior": F.lit(1), "max_pages": F.lit(6)})
    return C.budget(links, counted)


@query("""with o as (select user_id as session, case when event_type = 'purchase' then 'failed' when event_id % 3 = 0 then 'unchanged' when event_id % 3 = 1 then 'crawled' else 'skipped' end as outcome from events)
select session, count(*) filter (outcome = 'crawled') as pages_crawled, count(*) filter (outcome in ('skipped', 'unchanged')) as pages_skipped, count(*) filter (outcome = 'failed') as pages_failed from o group by 1""")
def session_counters(spark, d):
    outcome = F.when(F.col("event_type") == "purchase", "failed").when(F.col("event_id") % 3 == 0, "unchanged").when(F.col("event_id") % 3 == 1, "crawled").otherwise("skipped")
    return C.session_counters(table(spark, d, "events").select(F.col("user_id").alias("session"), outcome.alias("outcome")))


@query("""select event_id, event_id % 6 + 1 as attempts_made, case when event_id % 6 + 1 < 4 then 'retry' else 'dead' end as fate,
case when event_id % 6 + 1 < 4 then least(1000 * pow(2, event_id % 6), 30000) / 2 end as least_wait, case when event_id % 6 + 1 < 4 then least(1000 * pow(2, event_id % 6), 30000) end as most_wait from events""")
def backoff_bounds(spark, d):
    return C.retry(table(spark, d, "events").select("event_id", (F.col("event_id") % 6 + 1).alias("attempts_made")))


@query("""select event_id, event_type as queue, event_id as job_id, event_id % 6 + 1 as attempts_made, 'dlq:' || event_type || ':' || event_id as dlq_id from events where event_id % 6 + 1 >= 4""")
def dead_letters(spark, d):
    jobs = table(spark, d, "events").select("event_id", F.col("event_type").alias("queue"), F.col("event_id").alias("job_id"), (F.col("event_id") % 6 + 1).alias("attempts_made"))
    return C.dead_letters(jobs)


@query("""with j as (select event_id, event_id % 5 as siteId, case when event_id % 7 = 0 then 'nowhere' else 'https://h/' || event_id end as url, event_id % 4 - 1 as depth from events)
select event_id, siteId <= 0 or url not like '%://%' or depth < 0 as invalid from j""")
def payload_validation(spark, d):
    jobs = table(spark, d, "events").select("event_id", (F.col("event_id") % 5).alias("siteId"), F.when(F.col("event_id") % 7 == 0, "nowhere").otherwise(F.concat(F.lit("https://h/"), F.col("event_id").cast("string"))).alias("url"), (F.col("event_id") % 4 - 1).alias("depth"), F.lit(None).cast("int").alias("sessionId"))
    return jobs.select("event_id", schemas.invalid_job("scrape").alias("invalid"))


@query("""with s as (select event_id, [200, 301, 403, 404, 429, 500, 503][1 + event_id % 7] as status, event_id % 11 <> 0 as allowed, event_id % 2 = 0 as changed from events)
select event_id, status, status = 429 or status >= 500 as transient, case when not allowed then 'skipped' when status = 429 or status >= 500 or status = 403 then 'retry' when status >= 400 then 'failed' when changed then 'crawled' else 'unchanged' end as outcome from s""")
def status_gate(spark, d):
    e = table(spark, d, "events").select("event_id", F.element_at(F.array(*map(F.lit, (200, 301, 403, 404, 429, 500, 503))), (F.col("event_id") % 7 + 1).cast("int")).alias("status"), (F.col("event_id") % 11 != 0).alias("allowed"), (F.col("event_id") % 2 == 0).alias("changed"))
    yes = F.lit(True)
    return e.select("event_id", "status", X.transient(F.col("status")).alias("transient"), C.outcome(yes, F.col("allowed"), yes, F.lit(False), F.col("status"), F.col("changed")).alias("outcome"))


@query(f"select page_id, case when {HOST_SQL} like 'm.%' then 'js' else 'static' end as fetcher, greatest(500.0, (page_id % 4) * 1000.0) as delay_ms from pages")
def fetcher_and_delay(spark, d):
    p = table(spark, d, "pages")
    mode = F.when(X.host(F.col("url")).startswith("m."), "js").otherwise("static")
    return p.select("page_id", mode.alias("fetcher"), X.effective_delay(F.lit(500), (F.col("page_id") % 4).cast("double")).alias("delay_ms"))


@query("""select event_id, coalesce(case when event_id % 3 = 0 then 4 end, 2) as max_depth, coalesce(case when event_id % 3 = 0 then 9 end, case when event_id % 2 = 1 then 50 else 30 end) as max_pages from events""")
def crawl_limits(spark, d):
    return limits_of(spark, table(spark, d, "events"))


def limits_of(spark, events):
    jobs = events.select("event_id", (F.col("event_id") % 3).alias("session_id"), (F.col("event_id") % 2).alias("site_id"))
    sessions = spark.createDataFrame([(0, 4, 9)], "id bigint, max_depth int, max_pages int")
    sites = spark.createDataFrame([(0, 2, 30), (1, 2, 50)], "id bigint, max_depth int, max_pages int")
    return C.limits(jobs, sessions, sites).select("event_id", "max_depth", "max_pages")


@query("""with recursive e as (select event_type as domain, epoch_us(ts) // 1000 as now_ms, event_id as seq, event_id % 3 <> 0 as blocked, row_number() over (partition by event_type order by epoch_us(ts) // 1000, event_id) as i from events),
f as (select distinct domain, 0::bigint as now_ms, 0::bigint as seq, false as blocked, 0::bigint as i, false as cold, 0::bigint as n, 0::bigint as win, 0::bigint as until from e union all
      select domain, now_ms, seq, blocked, i, cold, case when not counts then n when c >= 3 then 0 else c end, case when not counts then win when c >= 3 then 0 when c = 1 then now_ms + 60000 else win end, case when counts and c >= 3 then now_ms + 120000 else until end
      from (select e.*, e.now_ms < f.until as cold, f.n, f.win, f.until, e.blocked and e.now_ms >= f.until as counts, case when e.now_ms >= f.win then 1 else f.n + 1 end as c from f join e on e.domain = f.domain and e.i = f.i + 1))
select domain, now_ms, seq, blocked, cold as in_cooldown from f where i > 0""")
def cooldown(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("domain"), F.unix_millis(F.col("ts").cast("timestamp")).alias("now_ms"), F.col("event_id").alias("seq"), (F.col("event_id") % 3 != 0).alias("blocked"))
    return C.cooldown(e)


@query(f"""with known as (select url from pages where page_id % 3 = 0), l as (select url, page_id % 3 as depth from pages)
select url, min(depth) + 1 as depth from l where depth < 2 and url not in (select url from known) group by 1""")
def frontier_new_urls(spark, d):
    p = table(spark, d, "pages")
    return C.frontier(p.select("url", (F.col("page_id") % 3).alias("depth")), p.where("page_id % 3 = 0").select("url"), 2)


# ---------------------------------------------------------------- text and documents


@query("select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as clean, nullif(trim(regexp_replace(text, '[^A-Z]+', ' ', 'g')), '') as title from documents".replace("\\\\", "\\"))
def normalize_ws(spark, d):
    return table(spark, d, "documents").select("doc_id", X.normalize_whitespace(F.col("text")).alias("clean"), X.clean_title(F.regexp_replace("text", "[^A-Z]+", " ")).alias("title"))


@query("""with s as (select doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]+["'')\\]]*\\s*|[^.!?]+$'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') as found from documents)
select doc_id, len(found) as n, sha256(array_to_string(found, '|')) as digest from s""".replace("\\\\", "\\"))
def sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", X.sentences(F.col("text")).alias("found")).select("doc_id", F.size("found").cast("bigint").alias("n"), X.sha(F.array_join("found", "|")).alias("digest"))


@query("select sha256(text) as digest, count(*) as copies, min(doc_id) as doc_id from documents group by 1")
def exact_dedup(spark, d):
    return table(spark, d, "documents").groupBy(X.sha(F.col("text")).alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"))


#: The pages' own shape in SQL: the text of their one article, or of all between menu and foot.
PLAIN_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '<!--.*?-->', '', 'gs'), '<[^>]+>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))"""
EXTRACT_SQL = f"""(select *, case when used then article else body end as text from (select *, length(article) >= 200 as used from
(select page_id, {PLAIN_SQL.format("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")} as title, {PLAIN_SQL.format("regexp_extract(html, '<article>(.*)</article>', 1, 's')")} as article,
{PLAIN_SQL.format("regexp_extract(html, '</nav>(.*)<footer>', 1, 's')")} as body from pages)))"""


@query(f"select page_id, case when not used and length(text) < 500 then 'listing' else 'article' end as content_type from {EXTRACT_SQL}")
def classify_content(spark, d):
    """The content type of every page by its own text and tables."""
    return E.outcome(E.extract(versions_in(spark, d))).select(F.col("page_version_id").alias("page_id"), "content_type")


STRIP = r"<(script|style|noscript|template|svg|nav|header|footer|aside)[^>]*>.*?</(script|style|noscript|template|svg|nav|header|footer|aside)>"


@query(f"""select page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(html, '{STRIP}', '', 'gs'), '<[^>]+>', '', 'gs'), '\\s+', ' ', 'g'))) as digest from pages""".replace("\\\\", "\\"))
def clean_text_regex(spark, d):
    text = F.regexp_replace(F.regexp_replace("html", "(?s)" + STRIP, ""), "(?s)<[^>]+>", "")
    return table(spark, d, "pages").select("page_id", X.sha(F.trim(F.regexp_replace(text, r"\s+", " "))).alias("digest"))


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def backfill_missing(spark, d):
    return I.backfill(table(spark, d, "documents").select(F.col("doc_id").alias("id")), table(spark, d, "labels").select(F.col("doc_id").alias("document_id"))).select(F.col("id").alias("doc_id"))


@query("""select doc_id as id, case when doc_id % 3 = 0 then 'new' else lang end as lang from documents where doc_id % 3 <> 0 union all select doc_id, 'new' from documents where doc_id % 3 = 0 union all select doc_id + 1000000000, 'new' from documents where doc_id % 3 = 0""")
def upsert_documents(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    fresh = docs.where("id % 3 = 0").select("id", F.lit("new").alias("lang"))
    return I.upsert(docs, fresh.union(fresh.select((F.col("id") + 1_000_000_000).alias("id"), "lang")), "id")


@query("""select conv_id as document_id, turn as chunk_index, text from conversations where conv_id % 2 = 1 union all select conv_id, 0, 'again' from conversations where conv_id % 2 = 0 group by 1""")
def replace_chunks(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), "text")
    fresh = c.where("document_id % 2 = 0").select("document_id").distinct().select("document_id", F.lit(0).cast("bigint").alias("chunk_index"), F.lit("again").alias("text"))
    return I.replace_chunks(c, fresh)


@query("""select distinct url from pages where page_id % 2 = 1 and url not in (select url from pages where page_id % 2 = 0)""")
def find_or_create(spark, d):
    p = table(spark, d, "pages").select("page_id", "url")
    return I.find_or_create(p.where("page_id % 2 = 0").select("url"), p.where("page_id % 2 = 1").select("url"))


@query(r"""select page_id, nullif(lower(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '\.([^.]+)$', 1)), '') as ext,
coalesce(nullif(lower(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '\.([^.]+)$', 1)), '') in ({EXTENSIONS}), false) as is_document from pages""".replace("{EXTENSIONS}", ", ".join(f"'{x}'" for x in X.DOCUMENT_EXTENSIONS)))
def document_extension(spark, d):
    ext = X.extension(F.try_parse_url("url", F.lit("PATH")))
    return table(spark, d, "pages").select("page_id", ext.alias("ext")).withColumn("is_document", F.coalesce(F.col("ext").isin(*X.DOCUMENT_EXTENSIONS), F.lit(False)))


HREF = r"""<a\s[^>]*href="([^"#?]*)"""


@query(r"""with h as (select page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) as origin, unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"#?]*)', 1)) as href from pages)
select page_id, case when href like '/%' then origin || href else href end as url, count(*) as n from h where href like '/%' or href like origin || '/%' group by all""")
def same_host_links(spark, d):
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1).alias("origin"), F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("href"))
    own = p.where(F.col("href").startswith("/") | F.startswith("href", F.concat("origin", F.lit("/"))))
    return own.groupBy("page_id", F.when(F.col("href").startswith("/"), F.concat("origin", "href")).otherwise(F.col("href")).alias("url")).agg(F.count("*").alias("n"))


@query("""select doc_id, left(text, 260) as shown, left(sha256(text), 10) as hash10, left(sha256(text), 16) as hash16, len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')) as n_lines, round(strlen(text) / 1024.0, 1) as kb from documents""")
def ui_truncations(spark, d):
    lines = F.filter(F.transform(F.split("text", "\n"), F.trim), lambda x: x != "")
    h = X.sha(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.left("text", F.lit(260)).alias("shown"), F.left(h, F.lit(10)).alias("hash10"), F.left(h, F.lit(16)).alias("hash16"), F.size(lines).cast("bigint").alias("n_lines"), F.round(F.octet_length("text") / 1024.0, 1).alias("kb"))


def versions_in(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("page_version_id"), "url", F.col("html").alias("raw_html"))


@query(f"""select page_id as page_version_id, nullif(title, '') as title, text, used as used_readability, case when not used and length(text) < 500 then 'listing' else 'article' end as content_type,
case when text = '' then 'skipped' else 'processed' end as outcome from {EXTRACT_SQL}""")
def html_extract(spark, d):
    return E.outcome(E.extract(versions_in(spark, d))).select("page_version_id", "title", "text", "used_readability", "content_type", "outcome")


@query()
def html_tables(spark, d):
    return E.extract(versions_in(spark, d)).select("page_version_id", F.size("structured.tables").alias("n_tables"), F.size("structured.documentLinks").alias("n_links"))


@query(r"""with h as (select page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) as origin, regexp_extract_all(html, '<a\s[^>]*href="(/[^"#]*)', 1) as found from pages),
l as (select page_id, origin || replace(replace(replace(replace(replace(replace(replace(url_encode(href), '%2F', '/'), '%2C', ','), '%25', '%'), '%24', '$'), '%2A', '*'), '%26', '&'), '%21', '!') as url, pos from
(select page_id, origin, replace(unnest(found), '&amp;', '&') as href, unnest(range(len(found))) as pos from h)),
f as (select page_id, url, min(pos) as pos from l group by all)
select page_id, (row_number() over (partition by page_id order by pos) - 1)::int as place, url from f""")
def html_links(spark, d):
    return E.links(table(spark, d, "pages"))


@query()
def chunks(spark, d):
    docs, _ = E.documents(E.extract(versions_in(spark, d)))
    return I.chunk(docs.withColumnRenamed("page_version_id", "document_id"))


@query()
def indexed_pages(spark, d):
    """Pages to searchable chunks: extract, chunk, embed."""
    made = embed_column(chunks(spark, d), "text", HashingEmbedder(64))
    return made.select("document_id", "chunk_index", "token_count", F.size("embedding").alias("dimensions"))


@query(f"""with n as (select count(*) as n from pages)
select event_id as chunk_id, 'Doc ' || page_id as title, url from events, n join pages on page_id = event_id % n where event_id % {EVERY} = 0""")
def resolved_hits(spark, d):
    """Hits with the title of their document and the address of their page, by the joins of search results, over all pages."""
    n = F.lit(table(spark, d, "pages").count())
    chunks = table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % n).alias("document_id"), F.lit("").alias("heading_path"), F.col("event_type").alias("text"))
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), "url")
    documents = pages.select("id", F.col("id").alias("page_version_id"), F.concat(F.lit("Doc "), F.col("id").cast("string")).alias("title"))
    hits = chunks.where(F.col("id") % EVERY == 0).select(F.lit(0).cast("bigint").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("chunk_id"), F.lit(0.0).alias("score"))
    return R.resolve_hits(hits, chunks, documents, pages.select("id", F.col("id").alias("page_id")), pages).select("chunk_id", "title", "url")
