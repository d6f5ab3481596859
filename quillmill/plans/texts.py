"""Queries on documents, conversations, embeddings and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import classify, entities, graph, retrieve, segment
from ..operators.type_rules import MEDIUM, STRONG, WEAK
from .base import read


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.exact_duplicates(read(spark, sf_dir, "documents"), "doc_id", "text")


def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", F.md5("text").alias("md5"))
    return entities.keep_first(d, ["md5"], ["doc_id"])


def strong_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    mails = tx.strong_ids(F.col("text"))["emails"]
    d = read(spark, sf_dir, "documents").select("doc_id", mails.alias("m")).where(F.size("m") > 0)
    return d.select("doc_id", F.array_join("m", ",").alias("emails"), F.size("m").alias("n"))


def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(tx.redact(F.col("text"))).alias("redacted_md5"))


def mask_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", tx.mask(F.col("c_name")).alias("masked"), F.right(F.md5("c_name"), F.lit(8)).alias("suffix"))


#: Rules over the sample vocabulary; the German rules are held by literal cases.
SAMPLE_RULES = {"Insult": ({r"\bidiot\b": STRONG, r"\bclown\b": MEDIUM, r"\bmoron\b": MEDIUM}, {r"\blicense\b": WEAK}), "Notice": ({r"\blicense\b": STRONG, r"\breleased\b": WEAK}, {r"\bidiot\b": STRONG}), "Prose": ({r"\bthe\b": WEAK, r"\band\b": WEAK, r"\bwith\b": WEAK}, {})}


def classify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify.classify(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", SAMPLE_RULES)
    return out.select("doc_id", "document_type", F.round("confidence", 6).alias("confidence"), "status")


_CLASSIFY = r"""
WITH d AS (SELECT doc_id, text, ' ' || regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g') || ' ' AS t FROM documents),
s AS (SELECT doc_id, text, greatest(0::DOUBLE, least(1::DOUBLE, (0::DOUBLE + CASE WHEN contains(t, ' idiot ') THEN 0.8::DOUBLE ELSE 0 END + CASE WHEN contains(t, ' clown ') THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN contains(t, ' moron ') THEN 0.4::DOUBLE ELSE 0 END) - CASE WHEN contains(t, ' license ') THEN 0.2::DOUBLE ELSE 0 END)) AS a,
  greatest(0::DOUBLE, least(1::DOUBLE, (0::DOUBLE + CASE WHEN contains(t, ' license ') THEN 0.8::DOUBLE ELSE 0 END + CASE WHEN contains(t, ' released ') THEN 0.2::DOUBLE ELSE 0 END) - CASE WHEN contains(t, ' idiot ') THEN 0.8::DOUBLE ELSE 0 END)) AS b,
  greatest(0::DOUBLE, least(1::DOUBLE, 0::DOUBLE + CASE WHEN contains(t, ' the ') THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN contains(t, ' and ') THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN contains(t, ' with ') THEN 0.2::DOUBLE ELSE 0 END)) AS c FROM d),
r AS (SELECT doc_id, text, list_sort([{'n': -a, 'i': 0, 'k': 'Insult'}, {'n': -b, 'i': 1, 'k': 'Notice'}, {'n': -c, 'i': 2, 'k': 'Prose'}]) AS r FROM s),
x AS (SELECT doc_id, r[1] AS p, r[2] AS q, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) < 20 OR len(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[a-zA-ZäöüÄÖÜß]{3,}'))) < 3 AS thin FROM r)
SELECT doc_id, CASE WHEN thin THEN 'Unlesbar' WHEN p.n = 0 THEN 'Sonstiges' ELSE p.k END AS document_type, round(CASE WHEN thin THEN 0 WHEN p.n = 0 THEN 0.1::DOUBLE ELSE -p.n END, 6) AS confidence,
  CASE WHEN thin THEN 'INSUFFICIENT_TEXT' WHEN p.n <> 0 AND (-p.n) - (-q.n) < 0.15::DOUBLE AND q.n < 0 THEN 'AMBIGUOUS' ELSE 'CLASSIFIED' END AS status FROM x"""

SAMPLE_INTENTS = {"SPANISH": (" los ", " las "), "GERMAN": (" und ", " der "), "FRENCH": (" les ", " est "), "ENGLISH": (" the ", " and ")}


def email_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", classify.email_intent(F.col("role"), F.col("text"), SAMPLE_INTENTS).alias("intent"))


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = retrieve.chunks(read(spark, sf_dir, "documents"), "doc_id", "text", 400, "\n")
    return c.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max(F.length("chunk")).alias("longest"), F.sum(F.length("chunk")).alias("chars"))


_CHUNK = r"""
WITH RECURSIVE p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, length(x) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i, trim(raw, ' ') AS x FROM documents) WHERE x <> ''),
f(doc_id, i, chunk, size) AS (SELECT doc_id, i, 0, n FROM p WHERE i = 1 UNION ALL
  SELECT p.doc_id, p.i, CASE WHEN f.size + p.n <= 400 THEN f.chunk ELSE f.chunk + 1 END, CASE WHEN f.size + p.n <= 400 THEN f.size + 1 + p.n ELSE p.n END FROM f JOIN p ON p.doc_id = f.doc_id AND p.i = f.i + 1),
c AS (SELECT doc_id, chunk, max(size) AS n FROM f GROUP BY ALL)
SELECT doc_id, count(*) AS chunks, max(n)::INTEGER AS longest, sum(n)::BIGINT AS chars FROM c GROUP BY doc_id"""


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search queries: benchmark passages, with as many words as a search takes."""
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), tx.query_words(F.col("text")).alias("words"))
    return b.where(F.size("words") > 0)


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.bm25(read(spark, sf_dir, "documents"), "doc_id", "text", _queries(spark, sf_dir), 5)


def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def fold_sql(x: str) -> str:
    """strip_accents of the sample's letters in SQL."""
    return f"strip_accents(replace(replace(replace(lower({x}), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'))"


#: A question's words as a search takes them, and all of its words, in SQL.
_ONCE = "list_transform(list_filter(range(1, len(l) + 1), lambda i: list_position(l, l[i]) = i), lambda i: l[i])"
_CLEAN = r"string_split_regex(trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')), '\s+')"
_STOP = "w NOT IN (" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + ")"


def words_sql(rows: str, stop: bool = True, most: int | None = 20) -> str:
    """(query_id, raw) for rows (query_id, query); with a stop list the first ``most`` words, or all where that is None."""
    keep = f"length(w) >= 3 AND {_STOP}" if stop else "w <> ''"
    return f"SELECT query_id, unnest({_ONCE + (f'[1:{most}]' if stop and most else '')}) AS raw FROM (SELECT query_id, list_filter({_CLEAN.format('query')}, lambda w: {keep}) AS l FROM ({rows}))"


def bm25_sql(p: str, docs: str, words: str) -> str:
    """Common table expressions that end in {p}r (query_id, doc_id, score, rank), from docs (doc_id, body) and words (query_id, raw)."""
    return rf"""
{p}d AS (SELECT doc_id, list_filter(string_split_regex({fold_sql("body")}, '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS t FROM ({docs})),
{p}s AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS avg FROM {p}d),
{p}p AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM {p}d) GROUP BY ALL),
{p}a AS (SELECT query_id, {fold_sql("raw")} AS word FROM ({words})),
{p}w AS (SELECT DISTINCT word, length(word) AS n FROM {p}a WHERE word <> ''),
{p}t AS (SELECT word, term FROM (SELECT DISTINCT term FROM {p}p) x JOIN {p}w w ON left(x.term, least(w.n, 3)) = left(w.word, 3) AND starts_with(x.term, w.word)),
{p}h AS (SELECT word, doc_id, len, sum(tf) AS tf FROM {p}t JOIN {p}p USING (term) GROUP BY ALL),
{p}f AS (SELECT word, count(*) AS df FROM {p}h GROUP BY word),
{p}x AS (SELECT query_id, doc_id, sum(ln((s.n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / s.avg))) AS score FROM {p}a JOIN {p}h USING (word) JOIN {p}f USING (word), {p}s s GROUP BY ALL),
{p}r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {p}x)"""


_BM25 = "WITH " + bm25_sql("", "SELECT doc_id, text AS body FROM documents", words_sql("SELECT item_id AS query_id, text AS query FROM benchmark")) + "\n"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return retrieve.vector_search(v, q, 0.3, 5)


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("query_id", "vec_id", "rank", F.round("sim", 6).alias("sim"))


def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    return retrieve.hash_embedding(read(spark, sf_dir, "benchmark"), "item_id", words).select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


def supplier_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    return entities.contained_names(read(spark, sf_dir, "documents"), "doc_id", "text", b, "item_id", "passage").select("doc_id", "name_id")


def alias_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    return entities.best_names(entities.contained_names(read(spark, sf_dir, "documents"), "doc_id", "text", b, "item_id", "passage"))


_CONTAIN = r"""
WITH n AS (SELECT item_id AS name_id, ' ' || array_to_string(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+'), ' ') || ' ' AS norm FROM benchmark),
d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+'), ' ') || ' ' AS body FROM documents),
c AS (SELECT doc_id, name_id, norm FROM d JOIN n ON contains(body, norm) WHERE length(norm) >= 7)
"""


def contact_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that share a key (nation and segment and balance band, or a coarse name) are one entity."""
    c = read(spark, sf_dir, "customer")
    keys = {"band": F.concat_ws("|", "c_nationkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 500)), "pair": F.floor(F.col("c_custkey") / 2)}
    found = entities.resolve_entities(entities.identity_keys(c, "c_custkey", keys))
    return found.groupBy("entity").agg(F.count("*").alias("members"), F.max("row_id").alias("last_member"))


def reconcile_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, c = read(spark, sf_dir, "documents").select("doc_id"), F.col
    name = lambda m, k: F.when(c("doc_id") % m == 0, F.array(F.concat(F.lit(k), c("doc_id") % 5))).otherwise(F.array().cast("array<string>"))
    rows = d.select("doc_id", (c("doc_id") % 41 != 0).alias("readable"), F.concat(name(2, "E"), name(14, "F")).alias("strong"), F.concat(name(3, "E"), name(15, "G")).alias("weak"), F.when(c("doc_id") % 4 == 0, F.concat(F.lit("E"), c("doc_id") % 5)).alias("current"), (c("doc_id") % 22 != 0).alias("role_ok"))
    return entities.reconcile(rows).select("doc_id", "status", F.array_join("reasons", ",").alias("reasons"))


_RECONCILE = """
WITH d AS (SELECT doc_id, doc_id % 41 <> 0 AS readable, list_concat(CASE WHEN doc_id % 2 = 0 THEN ['E' || doc_id % 5] ELSE [] END, CASE WHEN doc_id % 14 = 0 THEN ['F' || doc_id % 5] ELSE [] END) AS s,
  list_concat(CASE WHEN doc_id % 3 = 0 THEN ['E' || doc_id % 5] ELSE [] END, CASE WHEN doc_id % 15 = 0 THEN ['G' || doc_id % 5] ELSE [] END) AS w, CASE WHEN doc_id % 4 = 0 THEN 'E' || doc_id % 5 END AS cur, doc_id % 22 <> 0 AS role_ok FROM documents),
r AS (SELECT *, list_filter([CASE WHEN NOT readable THEN 'source_unreadable' END, CASE WHEN len(s) > 1 THEN 'several_strong' END, CASE WHEN len(s) = 1 AND NOT role_ok THEN 'role_mismatch' END, CASE WHEN len(s) = 1 AND len(list_filter(w, lambda x: NOT list_contains(s, x))) > 0 THEN 'weak_disagrees' END,
  CASE WHEN cur IS NOT NULL AND len(s) > 0 AND NOT list_contains(s, cur) THEN 'current_disagrees' END, CASE WHEN len(s) = 0 AND len(w) > 1 THEN 'several_weak' END], lambda x: x IS NOT NULL) AS reasons FROM d)
SELECT doc_id, CASE WHEN NOT readable THEN 'SOURCE_UNREADABLE' WHEN len(reasons) > 0 THEN 'REVIEW_CONFLICT' WHEN len(s) = 1 AND coalesce(s[1] <> cur, true) THEN 'UPDATED' ELSE 'UNCHANGED' END AS status, array_to_string(reasons, ',') AS reasons FROM r"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.links(read(spark, sf_dir, "pages").select("page_id", "html"), "page_id", "html", graph.HREF)


def link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


def _slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hub slugs of the sample: targets with two sources or more."""
    return graph.hubs(_edges(spark, sf_dir)).where("source_count >= 2").select("target")


def hub_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.hubs(_edges(spark, sf_dir))


def broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.broken(_edges(spark, sf_dir), _slugs(spark, sf_dir)).select("page_id", "target")


def orphan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/"), F.element_at(F.split("url", "/"), -1)).alias("slug"))
    return graph.orphans(p, "slug", _edges(spark, sf_dir)).select("page_id", "slug")


def wiki_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/"), F.element_at(F.split("url", "/"), -1)).alias("slug"))
    return graph.lint(p, "slug", _edges(spark, sf_dir))


def dup_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.duplicate_slugs(read(spark, sf_dir, "part"), tx.slug(F.col("p_name")))


_EDGES = """WITH e AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="([^"#?]+)"', 1))) AS target FROM pages), h AS (SELECT target, count(DISTINCT page_id) AS source_count, min(page_id) AS first_source FROM e GROUP BY target)"""


def compaction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("source", "lang", F.md5("text").alias("m"))
    return graph.compaction(d, "source", ["m"])


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top_counts(read(spark, sf_dir, "part"), "p_type")


def import_dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").agg(F.count("*").alias("rows"), F.count_distinct("p_name").alias("keys"), (F.count("*") - F.count_distinct("p_name")).alias("duplicates"))


def persistence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id")
    for name, key, flag in (("labels", "doc_id", "has_label"), ("embeddings", "vec_id", "has_vector"), ("pages", "page_id", "has_page")):
        k = read(spark, sf_dir, name).select(F.col(key).alias("_k")).distinct().withColumn(flag, F.lit(True))
        d = d.join(k, F.col("doc_id") == F.col("_k"), "left").drop("_k").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return d.withColumn("persisted", F.expr("has_label and has_vector and has_page"))


def _word(pattern: str) -> str:
    """A pattern between word ends, in words that Java and RE2 read alike."""
    return rf"(?i)(?:^|[^\p{{L}}\p{{N}}_]){pattern}(?:[^\p{{L}}\p{{N}}_]|$)"


def _stack_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    """Conversations as page stacks: turns are pages, and some stacks skip a page number; and which pages have too little text."""
    skip = F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") >= 2), 1).otherwise(0)
    return read(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + skip).alias("turn"), "text"), F.length("text") < 60


def _stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    sig = segment.Signals(first_page=_word("on"), header=_word("the"), number=_word("(an[a-z]{2,6})"), customer=_word("(re[a-z]{2,6})"), date=_word("of"), total=_word("in"), later_page=_word("that"), continued=_word("it"), page_of=_word(r"(er)\s+(er)"))
    pages, low = _stack_pages(spark, sf_dir)
    return segment.transitions(pages, "conv_id", "turn", "text", sig, low)


def boundary_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stack(spark, sf_dir).select("conv_id", "turn", F.round("score", 6).alias("score"), "is_boundary", "doc_seq", "has_gap")


def boundary_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.documents(_stack(spark, sf_dir), "conv_id", "turn").select("conv_id", "doc_seq", "start_page", "end_page", "ambiguous")


_W = lambda p: f"regexp_matches(text, '{_word(p)}')"
_STACK = rf"""
WITH p0 AS (SELECT conv_id, turn, trim(text) AS text, length(text) < 60 AS blank, length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) AS alnum, lag(length(text) < 60) OVER w AS pb, turn - lag(turn) OVER w AS step FROM (SELECT conv_id, turn + CASE WHEN conv_id % 5 = 0 AND turn >= 2 THEN 1 ELSE 0 END AS turn, text FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p1 AS (SELECT *, CASE WHEN NOT blank THEN 'C' WHEN alnum = 0 THEN 'S' WHEN NOT coalesce(pb, true) THEN 'B' ELSE 'S' END AS k, coalesce(max(step) OVER (PARTITION BY conv_id) > 1, false) AS has_gap FROM p0),
p2 AS (SELECT *, sum(CASE WHEN k = 'S' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS seps FROM p1),
f AS (SELECT conv_id, turn, has_gap, seps, {_W('on')} AS f1, lower(regexp_extract(text, '{_word("(an[a-z]{2,6})")}', 1)) AS num, lower(regexp_extract(text, '{_word("(re[a-z]{2,6})")}', 1)) AS cust, {_W('the')} AS hd, {_W('of')} AS dt, {_W('in')} AS tot, {_W('that')} AS lat, {_W('it')} AS con, {_W("er[[:space:]]+er")} AS lst FROM p2 WHERE k = 'C'),
g AS (SELECT *, lag(turn) OVER w IS NOT NULL AS has, lag(num) OVER w AS pnum, lag(cust) OVER w AS pcust, lag(hd) OVER w AS phd, lag(dt) OVER w AS pdt, lag(tot) OVER w AS ptot, lag(lst) OVER w AS plst, lag(seps) OVER w AS pseps FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT *, CASE WHEN has THEN greatest(0::DOUBLE, least(1::DOUBLE, 0.2::DOUBLE + (0::DOUBLE + CASE WHEN f1 THEN 0.6::DOUBLE ELSE 0 END + CASE WHEN num <> '' AND pnum <> '' AND num <> pnum THEN 0.8::DOUBLE ELSE 0 END + CASE WHEN hd AND NOT phd THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN dt AND NOT pdt THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN plst THEN 0.7::DOUBLE ELSE 0 END + CASE WHEN ptot THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN seps > pseps THEN 0.5::DOUBLE ELSE 0 END)
   - (0::DOUBLE + CASE WHEN lat THEN 0.6::DOUBLE ELSE 0 END + CASE WHEN con THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN num <> '' AND num = pnum THEN 0.7::DOUBLE ELSE 0 END + CASE WHEN cust <> '' AND cust = pcust THEN 0.4::DOUBLE ELSE 0 END))) END AS score FROM g),
t AS (SELECT conv_id, turn, has_gap, score, coalesce(score > 0.6::DOUBLE, false) AS is_boundary, coalesce(score >= 0.4::DOUBLE AND score <= 0.6::DOUBLE, false) AS amb, (sum(CASE WHEN score > 0.6::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) + 1)::BIGINT AS doc_seq FROM s)
"""

QUERIES = {f.__name__: f for f in (
    exact_duplicates, keep_first, strong_ids, redact_text, mask_ids, classify_documents, email_intent, chunk_documents, bm25_search, vector_topk, hash_embedding, supplier_containment, alias_match, contact_entities, reconcile_status,
    link_edges, hub_rollup, broken_links, orphan_pages, wiki_lint, dup_slugs, compaction_report, category_counts, import_dedup_stats, persistence_check, boundary_transitions, boundary_documents,
)}

_VEC = """
v AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS sim FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM v WHERE sim > 0.3)"""

SQL = {
    "exact_duplicates": "SELECT md5(text) AS md5, count(*) AS copies, min(doc_id) AS keep_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "keep_first": "SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, md5(text) AS md5 FROM documents GROUP BY md5(text)",
    "strong_ids": r"SELECT doc_id, array_to_string(m, ',') AS emails, len(m)::INTEGER AS n FROM (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+'))) AS m FROM documents) WHERE len(m) > 0",
    "redact_text": r"SELECT doc_id, md5(substr(regexp_replace(regexp_replace(regexp_replace(text, '(?i)(authorization|token|password|secret)(\s*[:=]\s*)\S+', '\1\2[REDACTED]', 'g'), '\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b', '[IBAN-REDACTED]', 'g'), '[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}', '[EMAIL-REDACTED]', 'g'), 1, 4000)) AS redacted_md5 FROM documents",
    "mask_ids": "SELECT c_custkey, repeat('*', length(c_name) - 4) || right(c_name, 4) AS masked, right(md5(c_name), 8) AS suffix FROM customer",
    "classify_documents": _CLASSIFY,
    "email_intent": "SELECT conv_id, turn, CASE WHEN contains(t, ' los ') OR contains(t, ' las ') THEN 'SPANISH' WHEN contains(t, ' und ') OR contains(t, ' der ') THEN 'GERMAN' WHEN contains(t, ' les ') OR contains(t, ' est ') THEN 'FRENCH' WHEN contains(t, ' the ') OR contains(t, ' and ') THEN 'ENGLISH' ELSE 'ALLGEMEINE_ANFRAGE' END AS intent FROM (SELECT conv_id, turn, lower(role || chr(10) || text) AS t FROM conversations)",
    "chunk_documents": _CHUNK,
    "bm25_search": _BM25 + "SELECT query_id, doc_id, rank::INTEGER AS rank, round(score, 6) AS score FROM r WHERE rank <= 5",
    "vector_topk": "WITH" + _VEC + " SELECT query_id, vec_id, rank::INTEGER AS rank, round(sim, 6) AS sim FROM vr WHERE rank <= 5",
    "hash_embedding": r"""
WITH w AS (SELECT item_id AS doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT item_id, list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '') AS l FROM benchmark)),
b AS (SELECT doc_id, ('0x' || substr(sha256(w), 15, 2))::INTEGER % 128 AS bucket, sum(1.0::DOUBLE / i) AS v FROM w GROUP BY ALL)
SELECT doc_id, bucket, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS weight FROM b""",
    "supplier_containment": _CONTAIN + "SELECT doc_id, name_id FROM c",
    "alias_match": _CONTAIN + ", m AS (SELECT *, max(length(norm)) OVER (PARTITION BY doc_id) AS top FROM c) SELECT doc_id, count(DISTINCT name_id) AS candidates, CASE WHEN count(DISTINCT name_id) = 1 THEN min(name_id) END AS entity_id FROM m WHERE length(norm) = top GROUP BY doc_id",
    "contact_entities": """
WITH RECURSIVE keys AS (SELECT c_custkey AS id, 'b' || c_nationkey || '|' || c_mktsegment || '|' || floor(c_acctbal / 500)::BIGINT AS k FROM customer UNION ALL SELECT c_custkey, 'p' || c_custkey // 2 FROM customer),
adj AS (SELECT DISTINCT a.id AS a, b.id AS b FROM keys a JOIN keys b USING (k)),
r(id, e) AS (SELECT id, id FROM keys UNION SELECT adj.b, r.e FROM r JOIN adj ON adj.a = r.id),
m AS (SELECT id, min(e) AS entity FROM r GROUP BY id)
SELECT entity, count(*) AS members, max(id) AS last_member FROM m GROUP BY entity""",
    "reconcile_status": _RECONCILE,
    "link_edges": _EDGES + " SELECT page_id, target FROM e",
    "hub_rollup": _EDGES + " SELECT * FROM h",
    "broken_links": _EDGES + " SELECT page_id, target FROM e WHERE target NOT IN (SELECT target FROM h WHERE source_count >= 2)",
    "orphan_pages": _EDGES + ", p AS (SELECT page_id, '/' || list_last(string_split(url, '/')) AS slug FROM pages) SELECT page_id, slug FROM p WHERE slug NOT IN (SELECT target FROM e)",
    "wiki_lint": _EDGES + """, p AS (SELECT page_id, '/' || list_last(string_split(url, '/')) AS slug FROM pages)
SELECT 'pages' AS "check", count(*) AS n FROM p UNION ALL SELECT 'links', count(*) FROM e UNION ALL SELECT 'broken_links', count(*) FROM e WHERE target NOT IN (SELECT slug FROM p) UNION ALL SELECT 'orphans', count(*) FROM p WHERE slug NOT IN (SELECT target FROM e)
UNION ALL SELECT 'duplicate_slugs', count(*) FROM (SELECT slug FROM p GROUP BY slug HAVING count(*) > 1)""",
    "dup_slugs": "SELECT slug, count(*) AS n FROM (SELECT substr(regexp_replace(regexp_replace(replace(lower(p_name), 'ß', 'ss'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) AS slug FROM part) GROUP BY slug HAVING count(*) > 1",
    "compaction_report": "SELECT source, sum(c)::BIGINT AS documents, sum(c - 1)::BIGINT AS surplus FROM (SELECT source, md5(text) AS m, count(*) AS c FROM documents GROUP BY ALL) GROUP BY source",
    "category_counts": "SELECT p_type, count(*) AS n FROM part GROUP BY p_type",
    "import_dedup_stats": "SELECT count(*) AS rows, count(DISTINCT p_name) AS keys, count(*) - count(DISTINCT p_name) AS duplicates FROM part",
    "persistence_check": "SELECT *, has_label AND has_vector AND has_page AS persisted FROM (SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS has_label, doc_id IN (SELECT vec_id FROM embeddings) AS has_vector, doc_id IN (SELECT page_id FROM pages) AS has_page FROM documents)",
    "boundary_transitions": _STACK + "SELECT conv_id, turn, round(score, 6) AS score, is_boundary, doc_seq, has_gap FROM t",
    "boundary_documents": _STACK + "SELECT conv_id, doc_seq, min(turn) AS start_page, max(turn) AS end_page, count(*) FILTER (amb) AS ambiguous FROM t GROUP BY ALL",
}
