"""Queries on search over several collections and on a wiki that is made from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import records, retrieve, search, wiki
from ..operators.search_index import SearchIndex
from ..sources.scratch import scratch_path
from ..sources.store import Store
from .base import read
from .texts import bm25_sql, fold_sql, words_sql  # noqa: F401

c = F.col


# ---- search ----


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(c("item_id").alias("query_id"), c("text").alias("query"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents; only some have a summary with words of their text."""
    return read(spark, sf_dir, "documents").select("doc_id", F.when(c("doc_id") % 10 == 0, F.substring("text", 1, 400)).otherwise(F.lit("")).alias("summary"), "text", F.lit("beleg").alias("category"))


def _long_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(tx.casefold(text), F.lit(r"(?U)\w+"), F.lit(0)), lambda w: F.length(w) >= 3))


def _hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hub pages whose titles hold the words of some questions; those of other categories don't count."""
    b = read(spark, sf_dir, "benchmark")
    return b.select(F.concat(F.lit("hub_"), "item_id").alias("doc_id"), F.concat(F.array_join(_long_words(c("text")), " "), F.lit(" und Partner")).alias("title"), F.when(c("item_id") % 3 == 0, "produkt").otherwise("wiki_lieferant").alias("category"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longer words of each benchmark passage as a question."""
    return read(spark, sf_dir, "benchmark").select(c("item_id").alias("query_id"), F.array_join(_long_words(c("text")), " ").alias("query"))


def kept_index(spark: SparkSession, rows: DataFrame, doc_id: str, text: str, stale: Column) -> SearchIndex:
    """An index that first held only the beginnings of some texts and lacked others, then was refreshed with them."""
    index = SearchIndex(Store(spark, scratch_path(spark, "index")))
    rows = rows.select(c(doc_id).cast("long").alias("doc_id"), c(text).alias("text"))
    index.refresh(rows.where(c("doc_id") % 7 != 5).withColumn("text", F.when(stale, F.substring("text", 1, 40)).otherwise(c("text"))), "doc_id", "text")
    index.refresh(rows.where(stale | (c("doc_id") % 7 == 5)), "doc_id", "text")
    return index


def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole passages asked of a kept index of the documents, a third of which were put in anew."""
    asked = _queries(spark, sf_dir).select("query_id", tx.query_words(c("query"), None).alias("words"))
    found = kept_index(spark, read(spark, sf_dir, "documents"), "doc_id", "text", c("doc_id") % 3 == 1).search(asked, 5)
    return found.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def hub_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hub_hits(_asked(spark, sf_dir), _hubs(spark, sf_dir))


def fts_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full text by summaries, filled up from the whole texts, with the language of each document beside it."""
    found = search.text_hits(_queries(spark, sf_dir), _docs(spark, sf_dir), 5)
    return found.join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "left").select("query_id", "doc_id", "source", "rank", "lang")


def _collections(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    part, sup = read(spark, sf_dir, "part"), read(spark, sf_dir, "supplier")
    return {"articles": part.select(c("p_partkey").alias("doc_id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text")), "contacts": sup.select(c("s_suppkey").alias("doc_id"), F.concat_ws(" ", "s_name", F.concat(F.lit("nation"), "s_nationkey")).alias("text"))}


def master_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles and contacts for a part's name and a nation, with the master row's price or balance joined by its key."""
    q = read(spark, sf_dir, "part").where("p_partkey % 20 = 0").select(c("p_partkey").alias("query_id"), F.concat(c("p_name"), F.lit(" nation"), c("p_partkey") % 25, F.lit(" 2")).alias("query"))
    hits = search.master_hits(q, _collections(spark, sf_dir), 5)
    part, sup = read(spark, sf_dir, "part").select(c("p_partkey").alias("_p"), "p_retailprice"), read(spark, sf_dir, "supplier").select(c("s_suppkey").alias("_s"), "s_acctbal")
    j = hits.join(part, (c("source") == "articles") & (c("doc_id") == c("_p")), "left").join(sup, (c("source") == "contacts") & (c("doc_id") == c("_s")), "left")
    return j.select("query_id", "doc_id", "source", "rank", F.coalesce("p_retailprice", "s_acctbal").alias("value"))


def fts_prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes of one to four letters as questions over a kept index of part names that was refreshed once."""
    q = read(spark, sf_dir, "region").select(c("r_regionkey").cast("long").alias("query_id"), F.split(F.element_at(F.array(F.lit("r"), F.lit("sm wi"), F.lit("old bol"), F.lit("hot gear"), F.lit("zzz")), (c("r_regionkey") + 1).cast("int")), " ").alias("words"))
    return kept_index(spark, read(spark, sf_dir, "part"), "p_partkey", "p_name", c("doc_id") % 3 == 1).search(q, 20).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def hash_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents nearest to benchmark passages by hash embeddings, above the threshold."""
    return search.vector_hits(_queries(spark, sf_dir), _docs(spark, sf_dir), 5)


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order of trust over whole questions."""
    return search.hybrid(_asked(spark, sf_dir), _hubs(spark, sf_dir), _docs(spark, sf_dir), _collections(spark, sf_dir), 5).select("query_id", "doc_id", "source", "category", "stage", "rank")


def hybrid_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for one category: only hubs and vectors of it are asked."""
    return search.hybrid(_asked(spark, sf_dir), _hubs(spark, sf_dir), _docs(spark, sf_dir), _collections(spark, sf_dir), 5, "wiki_lieferant").select("query_id", "doc_id", "source", "category", "stage", "rank")


def indexed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in chunks with their ids, as an index holds them."""
    rows = records.chunk_rows(retrieve.chunks(read(spark, sf_dir, "benchmark"), "item_id", "text", 100, ". "))
    return rows.select("id", F.md5("chunk").alias("chunk_md5"))


_ASKED = r"SELECT item_id AS query_id, array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: list_position(l, l[i]) = i), lambda i: l[i]), ' ') AS query FROM (SELECT item_id, list_filter(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+'), lambda w: length(w) >= 3) AS l FROM benchmark)"
_HUB = rf"""
sq AS ({_ASKED}),
hb AS (SELECT 'hub_' || query_id AS doc_id, string_split(query || ' und Partner', ' ') AS w, CASE WHEN query_id % 3 = 0 THEN 'produkt' ELSE 'wiki_lieferant' END AS category FROM sq),
hh AS (SELECT query_id, doc_id, category FROM sq JOIN hb ON category LIKE 'wiki\_%' ESCAPE '\' AND len(list_filter(string_split(query, ' '), lambda x: NOT list_contains(w, x))) = 0 WHERE query <> '')"""


def _text_sql(p: str, query: str) -> str:
    return (
        bm25_sql(p + "s", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN substr(text, 1, 400) ELSE '' END AS body FROM documents", words_sql(query)) + "," + bm25_sql(p + "o", "SELECT doc_id, text AS body FROM documents", words_sql(query))
        + f""",
{p}u AS (SELECT query_id, doc_id, 'fts5' AS source, 0 AS s, rank FROM {p}sr WHERE rank <= 5 UNION ALL SELECT query_id, doc_id, 'ocr_fallback', 1, rank FROM {p}or o WHERE rank <= 10 AND NOT EXISTS (SELECT 1 FROM {p}sr x WHERE x.rank <= 5 AND x.query_id = o.query_id AND x.doc_id = o.doc_id)),
{p}k AS (SELECT query_id, doc_id, source, row_number() OVER (PARTITION BY query_id ORDER BY s, rank) AS rank FROM {p}u)"""
    )


def _master_sql(p: str, query: str) -> str:
    parts = {"a": ("articles", "SELECT p_partkey AS doc_id, p_name || ' ' || p_brand || ' ' || p_type AS body FROM part"), "c": ("contacts", "SELECT s_suppkey AS doc_id, s_name || ' nation' || s_nationkey AS body FROM supplier")}
    union = " UNION ALL ".join(f"SELECT query_id, doc_id, '{name}' AS source, score FROM {p}{k}r WHERE rank <= 5" for k, (name, _) in parts.items())
    return ",".join(bm25_sql(p + k, rows, words_sql(query, False)) for k, (_, rows) in parts.items()) + f",\n{p}k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, source, doc_id) AS rank FROM ({union}))"


def _vector_sql(p: str, query: str) -> str:
    words = r"list_filter(string_split_regex(lower({0}), '\s+'), lambda w: w <> '')"
    side = lambda n, rows, key, text: f"""
{p}{n}w AS (SELECT id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT {key} AS id, {words.format(text)} AS l FROM {rows})),
{p}{n}b AS (SELECT id, ('0x' || substr(sha256(w), 15, 2))::INTEGER % 128 AS b, sum(1.0::DOUBLE / i) AS v FROM {p}{n}w GROUP BY ALL),
{p}{n} AS (SELECT id, b, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS v FROM {p}{n}b)"""  # noqa: E731
    return side("q", f"({query})", "query_id", "query") + "," + side("d", "documents", "doc_id", "text") + f""",
{p}r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 12) DESC, doc_id) AS rank FROM (SELECT q.id AS query_id, d.id AS doc_id, sum(q.v * d.v) AS sim FROM {p}q q JOIN {p}d d USING (b) GROUP BY ALL) WHERE sim > 0.3)"""


# ---- wiki ----


def _wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of suppliers, nations, regions and article categories, with faults by key."""
    s = read(spark, sf_dir, "supplier")
    k = c("s_suppkey")
    k_ = k.cast("string")
    cat = F.concat(F.lit("kat-"), c("s_nationkey") % 7)
    front = F.concat(
        F.lit('---\nentity_id: "e'), (k - F.when(k % 25 == 24, 1).otherwise(0)).cast("string"), F.lit('"\nentity_type: supplier\ncanonical_name: "'), c("s_name"), F.lit('"\narticle_categories: ["'), cat, F.lit('"]\n'), F.when(k % 17 != 3, F.lit("skr03_accounts: []\n")).otherwise(""), F.lit("source_count: 1\n"), F.when(k % 15 != 1, F.lit('updated: "2024-01-01"\n')).otherwise(""), F.lit("---\n"),
    )
    body = F.concat(
        F.lit("\n# "), c("s_name"), F.lit("\n*Kategorie: lieferant* | x\n\nText\n- [["), F.lit("article_category_"), cat, F.lit("|"), cat, F.lit("]]\n[Land](../../nations/"), F.when(k % 13 == 0, "none-").otherwise("nation-"), c("s_nationkey"), F.lit(".md)\n[Verzeichnis](../../index.md)\n"), F.when(k % 11 == 0, F.lit("[[nirgends]]\n")).otherwise(""),
        F.when(k > 0, F.concat(F.lit("[[supplier-"), k - 1, F.lit("]]\n"))).otherwise(""), F.lit("- `"), F.when(k % 20 == 5, F.lit("DUBLITTE_MD5_NO_SAVE")).when(k % 20 == 6, F.concat(F.lit("weg-"), k_)).otherwise(k_), F.lit("` | 2024-01-01 | 1 EUR | Quelle\n"),
    )
    suppliers = s.select(F.concat(F.lit("entities/suppliers/supplier-"), k_, F.lit(".md")).alias("path"), F.concat(F.when(k % 10 != 0, front).otherwise(""), F.when(k % 20 == 10, F.lit("Kategorie: konzept\n")).otherwise(""), body).alias("text"))
    n = read(spark, sf_dir, "nation")
    plain = lambda kind, key, name, more: F.concat(F.lit('---\nentity_id: "'), F.lit(kind), key.cast("string"), F.lit(f'"\nentity_type: {kind}\ncanonical_name: "'), name, F.lit('"\nsource_count: 0\nupdated: "2024-01-01"\n---\n\n# '), name, F.lit("\n"), more)
    nations = n.select(F.concat(F.lit("nations/nation-"), "n_nationkey", F.lit(".md")).alias("path"), plain("nation", c("n_nationkey"), c("n_name"), F.concat(F.lit("[Region](./../regions/region-"), "n_regionkey", F.lit(".md#oben)\n"))).alias("text"))
    r = read(spark, sf_dir, "region")
    regions = r.select(F.concat(F.lit("regions/region-"), "r_regionkey", F.lit(".md")).alias("path"), plain("region", c("r_regionkey"), c("r_name"), F.lit("")).alias("text"))
    twins = r.where("r_regionkey < 2").select(F.concat(F.lit("old/region-"), "r_regionkey", F.lit(".md")).alias("path"), plain("alt", c("r_regionkey"), c("r_name"), F.lit("")).alias("text"))
    cats = spark.range(5).select(F.concat(F.lit("entities/categories/article_category_kat-"), "id", F.lit(".md")).alias("path"), plain("article_category", c("id"), F.concat(F.lit("kat-"), "id"), F.lit("")).alias("text"))
    out = spark.createDataFrame([("index.md", "x"), ("log.md", "x"), ("Archive/old.md", "[[weg]]")], "path string, text string")
    return suppliers.unionByName(nations).unionByName(regions).unionByName(twins).unionByName(cats).unionByName(out)


def wiki_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id")
    return wiki.lint(_wiki(spark, sf_dir), docs)


def wiki_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wiki.lint_report(wiki_findings(spark, sf_dir))


_CAT = "'kat-' || s_nationkey % 7"
_FIND = f"""
WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n, 'entities/suppliers/supplier-' || s_suppkey || '.md' AS path, {_CAT} AS cat, s_suppkey % 10 <> 0 AS front FROM supplier),
good AS (SELECT * FROM s WHERE front AND k % 15 <> 1),
ids AS (SELECT k - CASE WHEN k % 25 = 24 THEN 1 ELSE 0 END AS e, count(*) AS c, min(path) AS path FROM good GROUP BY 1 HAVING count(*) > 1),
src AS (SELECT path, CASE WHEN k % 20 = 5 THEN 'DUBLITTE_MD5_NO_SAVE' WHEN k % 20 = 6 THEN 'weg-' || k ELSE k::VARCHAR END AS id, k FROM s WHERE front),
fi AS (
SELECT 'orphan' AS "check", path, NULL AS detail FROM s WHERE k = (SELECT max(k) FROM s)
UNION ALL SELECT 'orphan', 'nations/nation-' || n_nationkey || '.md', NULL FROM nation WHERE n_nationkey NOT IN (SELECT n FROM s WHERE k % 13 <> 0)
UNION ALL SELECT 'orphan', 'regions/region-' || r_regionkey || '.md', NULL FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation)
UNION ALL SELECT 'orphan', 'old/region-' || x || '.md', NULL FROM (VALUES (0), (1)) t(x)
UNION ALL SELECT 'orphan', 'entities/categories/article_category_kat-' || x || '.md', NULL FROM range(0, 5) t(x) WHERE 'kat-' || x NOT IN (SELECT cat FROM s)
UNION ALL SELECT 'broken_markdown_link', path, '../../nations/none-' || n || '.md' FROM s WHERE k % 13 = 0
UNION ALL SELECT 'broken_wikilink', path, 'nirgends.md' FROM s WHERE k % 11 = 0
UNION ALL SELECT 'broken_wikilink', path, 'article_category_' || cat || '.md' FROM s WHERE n % 7 > 4
UNION ALL SELECT 'duplicate_slug', 'old/region-' || x || '.md', 'region-' || x FROM (VALUES (0), (1)) t(x)
UNION ALL SELECT 'duplicate_entity_id', path, 'e' || e FROM ids
UNION ALL SELECT 'invalid_front_matter', path, NULL FROM s WHERE (NOT front AND k % 20 <> 10) OR (front AND (k % 15 = 1 OR k % 17 = 3))
UNION ALL SELECT 'legacy', path, NULL FROM s WHERE NOT front AND k % 20 = 10
UNION ALL SELECT CASE WHEN k % 20 = 5 THEN 'non_file_source' ELSE 'missing_source' END, path, id FROM src WHERE k % 20 IN (5, 6) OR id NOT IN (SELECT doc_id::VARCHAR FROM documents)
UNION ALL SELECT DISTINCT 'missing_category', NULL, cat FROM s WHERE n % 7 > 4)
"""


def wiki_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wiki.links(wiki.parsed(_wiki(spark, sf_dir))).select("path", "kind", "target", "to_path")


def wiki_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wiki.graph(wiki.parsed(_wiki(spark, sf_dir)))[1]


def wiki_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wiki.graph(wiki.parsed(_wiki(spark, sf_dir)))[0]


def wiki_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by category with their title and first line."""
    return wiki.index_page(_wiki(spark, sf_dir)).groupBy("category").agg(F.count("*").alias("pages"), F.min("line").alias("first_line"), F.max("place").alias("last_place"))


def repaired_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wiki.repaired_categories(_wiki(spark, sf_dir), "2024-02-01").select("path", F.regexp_extract("text", r"source_count: (\d+)", 1).cast("long").alias("suppliers"), F.size(F.regexp_extract_all("text", F.lit(r"- \[\["), F.lit(0))).cast("long").alias("links"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents of suppliers; some suppliers are unknown, some documents are there twice."""
    k = c("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        F.when(k % 50 == 0, F.concat(F.lit("TEST-"), k)).otherwise(k.cast("string")).alias("doc_id"), F.when(c("o_custkey") % 9 == 0, "Unbekannt").when(c("o_custkey") % 9 == 1, "").otherwise(F.concat(F.lit("Firma "), c("o_custkey") % 40)).alias("supplier"), F.when(c("o_custkey") % 2 == 0, F.concat(F.lit("c"), c("o_custkey") % 40)).alias("entity_id"),
        F.concat(F.lit(" R"), c("o_custkey") % 20, F.lit(" ")).alias("number"), F.date_format(F.trunc(c("o_orderdate").cast("date"), "year"), "yyyy-MM-dd").alias("day"), (c("o_custkey") % 3).cast("double").alias("gross"), F.when(k % 2 == 0, "Fleisch").otherwise("Unbekannt").alias("goods"), F.when(k % 3 == 0, "3400").alias("skr03"), F.when(k % 4 == 0, F.concat(F.lit("f/"), k)).alias("link"),
    )


def wiki_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir)
    old = read(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.concat(F.lit("beleg_"), "o_orderkey", F.lit(".md")).alias("path"))
    return wiki.compaction(d, old)


def largest_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wiki.largest_groups(_documents(spark, sf_dir).where("doc_id not like 'TEST-%'"))


def entity_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hub pages of all suppliers and the page of what is unresolved, read back as the wiki's parser reads them."""
    p = wiki.parsed(wiki.entity_pages(_documents(spark, sf_dir), "2024-01-01"))
    return p.select("path", "title", "category", "entity_type", wiki.field(c("front"), "source_count").cast("long").alias("sources"), F.array_join("categories", ",").alias("goods"), F.array_join(wiki.list_field(c("front"), "skr03_accounts"), ",").alias("accounts"), F.size(F.regexp_extract_all("text", F.lit(r"(?m)^- `"), F.lit(0))).cast("long").alias("lines"))


def compacted_wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wiki after compaction: how many pages lie in each folder."""
    d = _documents(spark, sf_dir)
    pages = d.where("doc_id not like 'TEST-%'").select(F.concat(F.lit("beleg_"), "doc_id", F.lit(".md")).alias("path"), F.lit("alt").alias("text")).unionByName(spark.createDataFrame([("frei.md", "bleibt"), ("entities/suppliers/firma-2.md", "alt")], "path string, text string"))
    return wiki.compacted(pages, d, "2024-01-01").groupBy(F.regexp_replace("path", "[^/]*$", "").alias("folder")).agg(F.count("*").alias("pages"), F.count_if(c("text") == "alt").alias("old"))


def master_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of customers, segments and part types, and the links that lead to them."""
    cust, part = read(spark, sf_dir, "customer"), read(spark, sf_dir, "part")
    contacts = cust.select(c("c_custkey").alias("number"), c("c_name").alias("name"), c("c_mktsegment").alias("kind"), F.lit("Ort").alias("city"), F.lit("DE").alias("country"))
    articles = part.select(c("p_partkey").alias("number"), c("p_name").alias("name"), c("p_type").alias("category"), F.lit("Stk").alias("unit"), F.lit(19.0).alias("rate"), F.lit(1.0).alias("buy"), F.lit(2.0).alias("sell"))
    pages = wiki.master_pages(contacts, articles)
    return pages.select("path", F.size(F.regexp_extract_all("text", F.lit(r"\[\["), F.lit(0))).cast("long").alias("links"), F.size(F.regexp_extract_all("text", F.lit(r"(?m)^- \*\*\d+ – "), F.lit(0))).cast("long").alias("articles"))


def wiki_writing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as pages, raw texts as files, events as lines of the log, and a page of counts."""
    b = read(spark, sf_dir, "benchmark")
    answers = wiki.answer_page(b.select(c("text").alias("question"), F.concat(F.lit("Antwort "), "item_id").alias("answer")), "2024-01-01").select(F.lit("answer").alias("kind"), "path", F.md5("text").alias("text_md5"))
    raw = wiki.raw_source(b.select(F.concat(F.lit("a/"), "item_id").alias("doc_id"), F.when(c("item_id") % 2 == 0, c("text")).alias("text"), F.lit("M").alias("supplier"), F.lit(None).cast("string").alias("day"), c("item_id").alias("gross"))).select(F.lit("raw").alias("kind"), "path", F.md5("text").alias("text_md5"))
    log = wiki.log_lines(read(spark, sf_dir, "events").where("event_type = 'signup'").select(c("ts").alias("at"), F.lit("update_page").alias("action"), F.concat(F.lit("Seite "), "event_id").alias("summary"))).select(F.lit("log").alias("kind"), c("line").alias("path"), F.lit(None).cast("string").alias("text_md5"))
    counts = wiki.category_page(read(spark, sf_dir, "part"), "p_type", "Artikel").select(F.lit("counts").alias("kind"), F.lit("p_type").alias("path"), F.md5("text").alias("text_md5"))
    return answers.unionByName(raw).unionByName(log).unionByName(counts)


QUERIES = {f.__name__: f for f in (
    hub_search, fts_fallback, master_search, fts_prefix_search, index_search, hash_vectors, hybrid_search, hybrid_category, indexed_chunks, wiki_findings, wiki_lint, wiki_links, wiki_edges, wiki_nodes, wiki_index, repaired_categories, wiki_compaction, largest_groups, entity_pages, compacted_wiki, master_pages, wiki_writing,
)}

_ALL = "SELECT item_id AS query_id, text AS query FROM benchmark"
_MASTER_Q = "SELECT p_partkey AS query_id, p_name || ' nation' || p_partkey % 25 || ' 2' AS query FROM part WHERE p_partkey % 20 = 0"
_DOCS = """
WITH d AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN 'TEST-' || o_orderkey ELSE o_orderkey::VARCHAR END AS id, o_orderkey AS k, o_custkey % 9 < 2 AS open, o_custkey % 40 AS f, CASE WHEN o_custkey % 2 = 0 THEN 'c' || o_custkey % 40 END AS e, o_custkey % 20 AS r, year(o_orderdate) AS y, o_custkey % 3 AS g FROM orders),
x AS (SELECT *, coalesce(e, 'firma ' || f) AS key FROM d WHERE k % 50 <> 0)
"""
_STAGES = """,
u AS ({0}),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY stage, place) AS n FROM u),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY stage, place, doc_id) AS rank FROM o WHERE n = 1)
SELECT query_id, doc_id, source, category, stage::INTEGER AS stage, rank::INTEGER AS rank FROM z WHERE rank <= 5"""
_HUB_STAGE = "SELECT query_id, doc_id, 'wiki' AS source, category, 0 AS stage, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS place FROM hh"

SQL = {
    "hub_search": "WITH " + _HUB + " SELECT query_id, doc_id FROM hh",
    "fts_fallback": "WITH " + _text_sql("t", _ALL) + " SELECT query_id, doc_id, tk.source, rank::INTEGER AS rank, lang FROM tk JOIN documents USING (doc_id) WHERE rank <= 5",
    "master_search": "WITH " + _master_sql("m", _MASTER_Q) + " SELECT query_id, doc_id, source, rank::INTEGER AS rank, CASE source WHEN 'articles' THEN (SELECT p_retailprice FROM part WHERE p_partkey = doc_id) ELSE (SELECT s_acctbal FROM supplier WHERE s_suppkey = doc_id) END AS value FROM mk WHERE rank <= 5",
    "index_search": "WITH " + bm25_sql("", "SELECT doc_id, text AS body FROM documents", words_sql(_ALL, most=None)) + " SELECT query_id, doc_id, rank::INTEGER AS rank, round(score, 6) AS score FROM r WHERE rank <= 5",
    "fts_prefix_search": "WITH " + bm25_sql("", "SELECT p_partkey AS doc_id, p_name AS body FROM part", "SELECT r_regionkey::BIGINT AS query_id, unnest(string_split((['r', 'sm wi', 'old bol', 'hot gear', 'zzz'])[r_regionkey + 1], ' ')) AS raw FROM region") + " SELECT query_id, doc_id, rank::INTEGER AS rank, round(score, 6) AS score FROM r WHERE rank <= 20",
    "hash_vectors": "WITH " + _vector_sql("v", _ALL) + " SELECT query_id, doc_id, rank::INTEGER AS rank FROM vr WHERE rank <= 5",
    "hybrid_search": "WITH " + _HUB + "," + _text_sql("t", "SELECT * FROM sq") + "," + _master_sql("m", "SELECT * FROM sq") + "," + _vector_sql("v", "SELECT * FROM sq") + _STAGES.format(_HUB_STAGE + " UNION ALL SELECT query_id, doc_id::VARCHAR, source, 'beleg', 1, rank FROM tk WHERE rank <= 5 UNION ALL SELECT query_id, doc_id::VARCHAR, source, 'master', 2, rank FROM mk WHERE rank <= 5 UNION ALL SELECT query_id, doc_id::VARCHAR, 'vector', 'beleg', 3, rank FROM vr WHERE rank <= 5"),
    "hybrid_category": "WITH " + _HUB + _STAGES.format(_HUB_STAGE),
    "indexed_chunks": r"""
WITH RECURSIVE p AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY i) AS i, x FROM (SELECT item_id, unnest(string_split(text, '. ')) AS raw, generate_subscripts(string_split(text, '. '), 1) AS i, trim(raw, ' ') AS x FROM benchmark) WHERE x <> ''),
f(item_id, i, chunk, body) AS (SELECT item_id, i, 0, x FROM p WHERE i = 1 UNION ALL SELECT p.item_id, p.i, CASE WHEN length(f.body) + length(p.x) <= 100 THEN f.chunk ELSE f.chunk + 1 END, CASE WHEN length(f.body) + length(p.x) <= 100 THEN f.body || '. ' || p.x ELSE p.x END FROM f JOIN p ON p.item_id = f.item_id AND p.i = f.i + 1)
SELECT item_id || '_chunk_' || chunk AS id, md5(arg_max(body, i)) AS chunk_md5 FROM f GROUP BY item_id, chunk""",
    "wiki_findings": _FIND + "SELECT * FROM fi",
    "wiki_lint": _FIND + """SELECT "check", count(*) AS findings, "check" NOT IN ('legacy', 'non_file_source', 'missing_category') AS issue FROM fi GROUP BY 1""",
    "wiki_links": _FIND + """SELECT path, 'wiki' AS kind, 'article_category_' || cat AS target, CASE WHEN n % 7 < 5 THEN 'entities/categories/article_category_' || cat || '.md' END AS to_path FROM s
UNION ALL SELECT path, 'markdown', '../../nations/' || CASE WHEN k % 13 = 0 THEN 'none-' ELSE 'nation-' END || n || '.md', CASE WHEN k % 13 <> 0 THEN 'nations/nation-' || n || '.md' END FROM s UNION ALL SELECT path, 'wiki', 'nirgends', NULL FROM s WHERE k % 11 = 0
UNION ALL SELECT path, 'wiki', 'supplier-' || (k - 1), 'entities/suppliers/supplier-' || (k - 1) || '.md' FROM s WHERE k > 0 UNION ALL SELECT 'nations/nation-' || n_nationkey || '.md', 'markdown', './../regions/region-' || n_regionkey || '.md', 'regions/region-' || n_regionkey || '.md' FROM nation""",
    "wiki_edges": _FIND + "SELECT 'supplier-' || k AS source, 'article_category_' || cat AS target FROM s WHERE n % 7 < 5 UNION ALL SELECT 'supplier-' || k, 'supplier-' || (k - 1) FROM s WHERE k > 0",
    "wiki_nodes": _FIND + "SELECT 'supplier-' || k AS id, s_name AS label, CASE WHEN front OR k % 20 <> 10 THEN 'lieferant' ELSE 'lieferant' END AS \"group\" FROM s JOIN supplier ON s_suppkey = k UNION ALL SELECT 'nation-' || n_nationkey, n_name, 'allgemein' FROM nation UNION ALL SELECT 'region-' || r_regionkey, r_name, 'allgemein' FROM region UNION ALL SELECT 'region-' || r_regionkey, r_name, 'allgemein' FROM region WHERE r_regionkey < 2 UNION ALL SELECT 'article_category_kat-' || x, 'kat-' || x, 'artikelart' FROM range(0, 5) t(x)",
    "wiki_index": """SELECT 'lieferant' AS category, count(*) AS pages, min('- **[' || s_name || '](./entities/suppliers/supplier-' || s_suppkey || '.md)**: ' || CASE WHEN s_suppkey % 20 = 10 THEN 'Kategorie: konzept' ELSE 'Text' END || '...') AS first_line, (count(*) - 1)::INTEGER AS last_place FROM supplier
UNION ALL SELECT 'artikelart', 5, '- **[kat-0](./entities/categories/article_category_kat-0.md)**: Keine Zusammenfassung...', 4
UNION ALL SELECT 'Allgemein', count(*), min(l), (count(*) - 1)::INTEGER FROM (SELECT '- **[' || n_name || '](./nations/nation-' || n_nationkey || '.md)**: [Region](./../regions/region-' || n_regionkey || '.md#oben)...' AS l FROM nation UNION ALL SELECT '- **[' || r_name || '](./regions/region-' || r_regionkey || '.md)**: Keine Zusammenfassung...' FROM region UNION ALL SELECT '- **[' || r_name || '](./old/region-' || r_regionkey || '.md)**: Keine Zusammenfassung...' FROM region WHERE r_regionkey < 2)""",
    "repaired_categories": f"SELECT 'entities/categories/article_category_' || {_CAT} || '.md' AS path, count(*) FILTER (s_suppkey % 10 <> 0) AS suppliers, count(*) FILTER (s_suppkey % 10 <> 0) AS links FROM supplier WHERE s_nationkey % 7 > 4 GROUP BY 1",
    "wiki_compaction": _DOCS + """, c AS (SELECT count(*) AS belege, count(*) FILTER (open) AS unresolved_documents, count(DISTINCT key) FILTER (NOT open) AS canonical_supplier_pages FROM x), q AS (SELECT coalesce(sum(n - 1), 0)::BIGINT AS possible_business_duplicates FROM (SELECT count(*) AS n FROM x WHERE NOT open GROUP BY key, r, y, g)), p AS (SELECT count(*) AS old_beleg_pages FROM x WHERE k % 2 = 0)
SELECT *, CASE WHEN unresolved_documents > 0 THEN 1 ELSE 0 END AS review_pages, greatest(0, old_beleg_pages - canonical_supplier_pages - CASE WHEN unresolved_documents > 0 THEN 1 ELSE 0 END) AS pages_saved FROM c, q, p""",
    "largest_groups": _DOCS + "SELECT key AS entity, count(*) AS documents FROM x WHERE NOT open GROUP BY key ORDER BY documents DESC, entity LIMIT 20",
    "entity_pages": _DOCS + """SELECT CASE WHEN open THEN 'review/unresolved-documents.md' ELSE 'entities/suppliers/firma-' || f || '.md' END AS path, CASE WHEN open THEN 'Ungeklärte Belege' ELSE 'Firma ' || f END AS title, CASE WHEN open THEN 'prüfung' ELSE 'lieferant' END AS category, CASE WHEN open THEN 'review_queue' ELSE 'supplier' END AS entity_type, count(*) AS sources,
  CASE WHEN bool_or(k % 2 = 0) THEN 'Fleisch' ELSE '' END AS goods, CASE WHEN bool_or(k % 3 = 0) THEN '3400' ELSE '' END AS accounts, count(*) AS lines FROM d GROUP BY 1, 2, 3, 4""",
    "compacted_wiki": _DOCS + "SELECT 'archive/belege/' AS folder, count(*) AS pages, count(*) AS old FROM x UNION ALL SELECT '', 1, 0 UNION ALL SELECT 'review/', 1, 0 UNION ALL SELECT 'entities/suppliers/', count(DISTINCT f), 0 FROM d WHERE NOT open",
    "master_pages": """SELECT 'entities/contacts/contact_' || c_custkey || '.md' AS path, 1::BIGINT AS links, 0::BIGINT AS articles FROM customer UNION ALL SELECT 'entities/categories/contact_type_' || lower(c_mktsegment) || '.md', count(*), 0 FROM customer GROUP BY c_mktsegment UNION ALL SELECT 'entities/categories/article_category_' || lower(p_type) || '.md', 0, count(*) FROM part GROUP BY p_type
UNION ALL SELECT 'wissensgraph.md', (SELECT count(DISTINCT c_mktsegment) FROM customer) + (SELECT count(DISTINCT p_type) FROM part), 0""",
    "wiki_writing": r"""SELECT 'answer' AS kind, 'query_' || regexp_replace(substr(regexp_replace(lower(text), '[^\p{L}\p{N}]', '_', 'g'), 1, 40), '^_+|_+$', '', 'g') || '.md' AS path, md5('# Analyse: ' || substr(text, 1, 50) || chr(10) || '*Kategorie: erkenntnis* | *Zuletzt aktualisiert: 2024-01-01*' || chr(10) || chr(10) || '### Ursprüngliche Frage:' || chr(10) || '> ' || text || chr(10) || chr(10) || '### Generierte Erkenntnisse:' || chr(10) || 'Antwort ' || item_id || chr(10)) AS text_md5 FROM benchmark
UNION ALL SELECT 'raw', 'raw_sources/belege/beleg_a_' || item_id || '.txt', md5(CASE WHEN item_id % 2 = 0 THEN text ELSE 'Lieferant: M, Datum: , Betrag: ' || item_id || ' EUR, Beleg-ID: a/' || item_id END) FROM benchmark
UNION ALL SELECT 'log', '## [' || strftime(ts, '%Y-%m-%d %H:%M') || '] UPDATE_PAGE | Seite ' || event_id, NULL FROM events WHERE event_type = 'signup'
UNION ALL SELECT 'counts', 'p_type', md5('## Artikel' || chr(10) || chr(10) || sum(n) || ' Einträge' || chr(10) || chr(10) || string_agg('- ' || p_type || ': ' || n, chr(10) ORDER BY n DESC, p_type)) FROM (SELECT p_type, count(*) AS n FROM part GROUP BY 1)""",
}
