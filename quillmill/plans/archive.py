"""Queries on saving, ledgers, contacts, reconciliation, jobs and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import assign, contacts, containment, entities, ledger, prices, reconciliation, records, stack  # noqa: F401
from ..sources import config, sinks
from ..sources.page_cache import PageCache
from ..sources.scratch import materialize, scratch_path
from ..sources.store import Store, append_numbered
from ..streaming import jobs, leases
from ..streaming.intake import Intake
from .base import read

c = F.col


# ---- saving ----


def _saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents to be saved in order of their keys: hashes and data repeat by customer and month."""
    o = read(spark, sf_dir, "orders")
    docs = o.select(
        c("o_orderkey").alias("seq"), F.md5(F.concat_ws("|", "o_custkey", F.date_format("o_orderdate", "yyyy-MM"))).alias("md5"), F.concat(F.lit(" Customer "), c("o_custkey") % 100).alias("supplier"), (c("o_custkey") % 7 * 10.5).alias("gross"), F.trunc(c("o_orderdate").cast("date"), "month").alias("day"),
        F.when(c("o_orderkey") % 3 == 0, "PASSED").alias("validation_status"), (c("o_orderkey") % 3 == 0).alias("passed"), F.concat(F.lit("01_Eingangsarchiv/"), F.year("o_orderdate")).alias("folder"), F.when(c("o_orderkey") % 2 == 0, "Rechnung").alias("kind"),
        F.when(c("o_orderkey") % 5 == 0, "Fleisch, frisch").when(c("o_orderkey") % 5 == 1, "Unbekannt").alias("goods"), (c("o_custkey") % 7 * 9.0).alias("net"), (c("o_custkey") % 7 * 1.5).alias("tax"), F.lit(None).cast("double").alias("rate"), F.when(c("o_orderkey") % 4 == 0, "4900").alias("skr03"), F.concat(F.lit("f/"), c("o_orderkey")).alias("link"),
    )
    before = o.where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.min("o_orderdate").alias("d")).select(F.md5(F.concat_ws("|", "o_custkey", F.date_format("d", "yyyy-MM"))).alias("md5"), F.lit("nobody").alias("supplier"), F.lit(1.0).alias("gross"), F.lit(None).cast("date").alias("day"))
    return ledger.save_plan(docs, before)


def save_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _saved(spark, sf_dir).select("seq", "save_status", "destination")


_SAVED = """
WITH o AS (SELECT o_orderkey AS seq, md5(o_custkey || '|' || strftime(o_orderdate, '%Y-%m')) AS md5, o_custkey % 100 AS s, o_custkey % 7 AS g, date_trunc('month', o_orderdate)::DATE AS day, year(o_orderdate) AS y FROM orders),
old AS (SELECT md5(o_custkey || '|' || strftime(min(o_orderdate), '%Y-%m')) AS md5 FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey),
f AS (SELECT *, min(seq) OVER (PARTITION BY md5) AS fh, CASE WHEN g <> 0 THEN min(seq) OVER (PARTITION BY s, g, day) END AS fm FROM o),
p AS (SELECT *, CASE WHEN md5 IN (SELECT md5 FROM old) OR fh < seq THEN 'DUBLITTE_MD5' WHEN fm < seq THEN 'DUBLITTE_VERDACHT' WHEN seq % 3 = 0 THEN 'PASSED' ELSE 'MANUAL_REVIEW_NEEDED' END AS save_status FROM f)
"""


def ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.ledger_rows(_saved(spark, sf_dir), 41)


_LEDGER = _SAVED + """
SELECT printf('VG-%04d', row_number() OVER (ORDER BY seq) + 41) AS ledger_id, strftime(day, '%Y-%m-%d') AS day, ' Customer ' || s AS supplier, CASE WHEN seq % 2 = 0 THEN 'Rechnung' ELSE 'Sonstiges' END || CASE WHEN seq % 5 = 0 THEN ' (Fleisch; frisch)' ELSE '' END AS category, printf('%.2f', g * 10.5) AS gross, printf('%.2f', g * 9.0) AS net, CASE WHEN g > 0 THEN '7.0' ELSE '0.0' END AS rate,
  printf('%.2f', g * 1.5) AS tax, CASE WHEN seq % 4 = 0 THEN '4900' ELSE '3400' END AS skr03, CASE WHEN save_status LIKE 'DUB%' THEN save_status WHEN save_status = 'PASSED' THEN 'OFFEN' ELSE 'PRUEFUNG_ERFORDERLICH' END AS booking_status, 'f/' || seq AS link, md5 FROM p"""


def ledger_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends to a ledger file: the second goes on with the numbers of the first."""

    path = scratch_path(spark, "ledger")
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", tx.formula_guard(c("s_name")).alias("name"))
    sinks.append_ledger(spark, path, rows.where("s_suppkey < 50"), ["s_suppkey"])
    return sinks.append_ledger(spark, path, rows.where("s_suppkey >= 50"), ["s_suppkey"]).select("ledger_id", c("s_suppkey").cast("long").alias("s_suppkey"), "name")


def numbered_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends to a ledger in a store; each takes its numbers with its commit."""
    ledger_store = Store(spark, scratch_path(spark, "store"))
    rows = read(spark, sf_dir, "supplier").select(c("s_suppkey").cast("long").alias("s_suppkey"), c("s_name").alias("name"))
    append_numbered(ledger_store, "ledger", rows.where("s_suppkey < 50"), ["s_suppkey"])
    append_numbered(ledger_store, "ledger", rows.where("s_suppkey >= 50"), ["s_suppkey"])
    return ledger_store.read("ledger").drop("_commit")


def store_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers upserted in three commits, a wrong commit rolled back, and the folders made one."""
    store = Store(spark, scratch_path(spark, "store"))
    rows = read(spark, sf_dir, "customer").select(c("c_custkey").cast("long").alias("c_custkey"), c("c_name").alias("name"))
    store.append("customers", rows.withColumn("round", F.lit(0)))
    store.append("customers", rows.where("c_custkey % 2 = 0").withColumn("round", F.lit(2)))
    good = store.append("customers", rows.where("c_custkey % 3 = 0").withColumn("round", F.lit(3)))
    store.replace("customers", rows.where("c_custkey < 0").withColumn("round", F.lit(9)))
    store.rollback(good.version)
    store.compact("customers", ["c_custkey"])
    return store.latest("customers", ["c_custkey"])


def intake_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents taken in by a stream, again by a stream without its checkpoint (which changes nothing), and the rest by the first."""
    store, source = Store(spark, scratch_path(spark, "store")), scratch_path(spark, "arrived")
    docs = read(spark, sf_dir, "documents").select(c("doc_id").cast("long").alias("doc_id"), "text")
    stream = lambda: spark.readStream.schema(docs.schema).parquet(source)
    checkpoint = scratch_path(spark, "checkpoint")
    docs.where("doc_id % 4 <> 3").write.parquet(source)
    Intake(store).start(stream(), checkpoint).awaitTermination()
    Intake(store).start(stream(), scratch_path(spark, "checkpoint")).awaitTermination()
    docs.where("doc_id % 4 = 3").write.mode("append").parquet(source)
    Intake(store).start(stream(), checkpoint).awaitTermination()
    return store.read("ledger").drop("_commit")


def lease_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of customers on a stream, each with one lease: renewed, failed or left to run out; the last state of each."""
    k, at = c("c_custkey"), c("c_custkey") * 10.0 + 1
    of = lambda seq, kind, when, target=None: F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("kind"), when.alias("at"), F.lit("w").alias("worker"), F.lit(target).cast("string").alias("target"))
    second = F.when(k % 3 == 0, of(2, "complete", at + 10, "OCR_RUNNING")).when(k % 3 == 1, of(2, "renew", at + 500)).otherwise(of(2, "fail", at + 20))
    events = read(spark, sf_dir, "customer").select(k.cast("string").alias("job_id"), F.inline(F.array(of(1, "claim", at), second)))
    source, states = scratch_path(spark, "events"), scratch_path(spark, "states")
    events.write.parquet(source)
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        jobs = read(spark, sf_dir, "customer").count()
        stream = leases.stream_leases(spark.readStream.schema(events.schema).parquet(source), buckets=max(16, -(-jobs // leases.BUCKET_JOBS)))
        keep = lambda rows, batch: rows.withColumn("_batch", F.lit(batch)).write.mode("append").parquet(states)
        stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", scratch_path(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, was)
    values = ["status", "attempts", "owner", "lease", "retry_at", "stage", "rejected"]
    return spark.read.parquet(states).groupBy("job_id").agg(F.max_by(F.struct(*values), "_batch").alias("s")).select("job_id", "s.*")


def page_cache_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of suppliers, one for each nation, read in three runs: all anew, none, and those of one more folder with equal contents."""
    folder, cache = scratch_path(spark, "files"), PageCache(Store(spark, scratch_path(spark, "store")))
    rows = read(spark, sf_dir, "supplier").select("s_nationkey", c("s_name").alias("value")).coalesce(1)
    rows.write.partitionBy("s_nationkey").text(f"{folder}/one")
    cache.read(folder, glob="*.txt")
    cache.read(folder, glob="*.txt")
    rows.where("s_nationkey % 2 = 0").write.partitionBy("s_nationkey").text(f"{folder}/two")
    cache.read(folder, glob="*.txt")
    return cache.store.read("runs").select("run", "files", "hits", "misses")


def source_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source as files: whether all of a file's documents are verified, and its new name."""
    d = read(spark, sf_dir, "documents").select(F.concat(F.lit("in/"), "source", F.lit(".pdf")).alias("file"), (c("doc_id") % 37 != 5).alias("verified"), "doc_id")
    expected = d.groupBy("file").agg((F.count("*") + F.max(F.when(c("doc_id") == 3, 1).otherwise(0))).alias("documents"))
    return ledger.source_manifest(d, "file", expected)


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    name = F.concat(F.lit("f"), c("o_orderkey"), F.lit(".pdf"))
    rows = o.where("o_orderkey % 3 = 0").select(name.alias("source"), F.concat(F.lit("in/"), name).alias("path"), F.lit("FEHLER").alias("status"))
    new = o.where("o_orderkey % 4 = 0").select(name.alias("source"), F.concat(F.lit("in/Done_"), name).alias("path"), F.lit("DONE").alias("status"))
    done = o.where("o_orderkey % 2 = 0").select(F.concat(F.lit("in/Done_"), name).alias("path"))
    return ledger.inventory(rows, new, done)


# ---- contacts ----


def contact_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders teach contacts in order of their keys; some bring another mail address, which is a conflict."""
    o = read(spark, sf_dir, "orders")
    cust = c("o_custkey").cast("string")
    docs = o.select(
        c("o_orderkey").alias("seq"), c("o_orderkey").cast("string").alias("document_id"), F.when(c("o_orderkey") % 9 == 0, "MANUAL").otherwise("PASSED").alias("validation_status"), F.when(c("o_orderkey") % 10 == 0, 0.5).otherwise(0.95).alias("confidence"),
        F.concat(F.lit("Kontakt "), cust).alias("supplier"), F.concat(F.lit("DE "), cust).alias("supplier_tax_id"), F.concat(F.when(c("o_orderkey") % 11 == 0, "z").otherwise("a"), cust, F.lit("@x.de")).alias("supplier_email"),
    )
    return contacts.learn(contacts.from_documents(docs)).select((c("seq") / 2).cast("long").alias("o_orderkey"), "status")


_UPSERT = """
WITH s AS (SELECT o_orderkey, o_custkey, o_orderkey % 11 = 0 AS z FROM orders WHERE o_orderkey % 9 <> 0 AND o_orderkey % 10 <> 0),
f AS (SELECT *, first_value(z) OVER w AS z1, row_number() OVER w AS n FROM s WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_orderkey, CASE WHEN n = 1 THEN 'CREATED' WHEN z = z1 THEN 'MATCHED' ELSE 'REVIEW_CONFLICT' END AS status FROM f"""


def _entities(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cust = read(spark, sf_dir, "customer")
    ent = cust.select(c("c_custkey").alias("entity_id"), F.concat(F.lit("Name "), c("c_custkey") % 50).alias("canonical_name"), F.lit("supplier").alias("role"), F.concat(F.lit("DE"), c("c_custkey") + 100000000).alias("tax_id"), F.lit(None).cast("string").alias("iban"), F.concat("c_custkey", F.lit("@x.de")).alias("email"), F.lit(1).alias("evidence_count"))
    return ent, read(spark, sf_dir, "orders").select(c("o_custkey").alias("entity_id"), F.concat(F.lit("alias "), c("o_orderkey")).alias("alias"))


def contact_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All contacts with the number of their aliases, by name, as a viewer may see them."""
    return records.safe_contacts(records.entity_list(*_entities(spark, sf_dir)))


def known_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest alias in each document and whose it is; aliases are the first words of benchmark passages."""
    b = read(spark, sf_dir, "benchmark")
    words = F.split(tx.normalize_text(c("text")), " ")
    alias = lambda k: b.select((c("item_id") % 30).alias("entity_id"), F.array_join(F.slice(words, 1, k), " ").alias("alias"), F.when(c("item_id") % 7 == 6, "customer").otherwise("supplier").alias("role"))
    ent = b.select(c("item_id").alias("entity_id"), F.concat(F.lit("Kontakt "), c("item_id")).alias("canonical_name"))
    return contacts.known_names(read(spark, sf_dir, "documents"), "doc_id", "text", alias(2).unionByName(alias(3)), ent, "supplier")


_N = r"array_to_string(regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[\p{{L}}\p{{N}}_]+'), ' ')"
_KNOWN = rf"""
WITH w AS (SELECT item_id, string_split({_N.format('text')}, ' ') AS w FROM benchmark WHERE item_id % 7 <> 6),
n AS (SELECT item_id % 30 AS e, array_to_string(w[1:2], ' ') AS a FROM w UNION ALL SELECT item_id % 30, array_to_string(w[1:3], ' ') FROM w),
d AS (SELECT doc_id, ' ' || {_N.format('text')} || ' ' AS body FROM documents),
m AS (SELECT doc_id, e, length(a) AS l, max(length(a)) OVER (PARTITION BY doc_id) AS top FROM d JOIN n ON length(a) >= 5 AND contains(body, ' ' || a || ' ')),
b AS (SELECT doc_id, count(DISTINCT e) AS candidates, CASE WHEN count(DISTINCT e) = 1 THEN min(e) END AS entity_id FROM m WHERE l = top GROUP BY doc_id)
SELECT *, 'Kontakt ' || entity_id AS name FROM b"""


# ---- reconciliation ----


def _reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against contacts that have customer numbers, mail addresses found in the texts, and aliases from the benchmark."""
    d = read(spark, sf_dir, "documents")
    mail = lambda t: F.array_min(F.array_distinct(F.regexp_extract_all(t, F.lit(r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"), F.lit(0))))
    docs = d.select(
        "doc_id", F.when(c("doc_id") % 3 == 0, "Rechnung").when(c("doc_id") % 3 == 1, "Einnahme").alias("kind"), F.concat(F.lit("scan_"), "doc_id").alias("file_name"), F.when(c("doc_id") % 10 == 0, "Metro").alias("supplier"), "text", F.when(c("doc_id") % 4 == 0, F.concat(F.lit("K-"), c("doc_id") % 40)).alias("ext_id"),
        F.when(c("doc_id") % 8 == 0, F.concat(F.lit("e"), c("doc_id") % 40)).alias("current"), (c("doc_id") % 41 != 0).alias("readable"),
    )
    ids = spark.range(40).select(F.concat(F.lit("e"), "id").alias("entity_id"), F.when(c("id") % 5 == 0, "customer").otherwise("supplier").alias("role"), F.concat(F.lit("k "), "id").alias("ext_id"), F.lit(None).cast("string").alias("email"))
    mails = d.where(c("text").contains("@")).select(mail(c("text")).alias("email")).where("email is not null").groupBy("email").agg(F.lit(1).alias("n")).select(F.concat(F.lit("m_"), "email").alias("entity_id"), F.lit("both").alias("role"), F.lit(None).cast("string").alias("ext_id"), "email")
    none = {k: F.lit(None).cast("string") for k in ("iban", "tax_id")}
    b = read(spark, sf_dir, "benchmark")
    aliases = b.select(F.concat(F.lit("e"), "item_id").alias("entity_id"), F.array_join(F.slice(F.split(tx.normalize_text(c("text")), " "), 1, 3), " ").alias("alias")).unionByName(spark.createDataFrame([("e7", "Metro")], "entity_id string, alias string"))
    known = materialize(ids.unionByName(mails).withColumns(none), "known")  # mails are found in all texts
    return reconciliation.reconcile_documents(docs, known, aliases)


def reconciliation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reconciled(spark, sf_dir).select("doc_id", F.array_join("strong", ",").alias("strong"), F.array_join("weak", ",").alias("weak"), F.array_join("reasons", ",").alias("reasons"), "proposed", "status")


def weak_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reconciled(spark, sf_dir).select("doc_id", F.explode("weak").alias("entity_id"))


def reconciliation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconciliation.summary(_reconciled(spark, sf_dir))


def reconciliation_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' contacts after the updates, as version 1 of a table whose version 0 stays."""

    done = materialize(_reconciled(spark, sf_dir).select("doc_id", "current", "proposed", "status"), "reconciled")  # two versions are written from it
    base = scratch_path(spark, "contacts")
    sinks.upsert_version(spark, base, done.select("doc_id", "current"), ["doc_id"], 0)
    return sinks.upsert_version(spark, base, reconciliation.updates(done), ["doc_id"], 1)


def _key(x: str) -> str:
    """match_key of the sample's letters in SQL."""
    return rf"regexp_replace(strip_accents(replace(replace(replace(lower(coalesce({x}, '')), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe')), '[^\p{{L}}\p{{N}}]', '', 'g')"


_RECON = rf"""
WITH d AS (SELECT doc_id, text, {_key('text')} AS body, regexp_extract_all(text, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+') AS mails FROM documents),
me AS (SELECT DISTINCT list_min(list_distinct(mails)) AS email FROM d WHERE len(mails) > 0),
sh AS (SELECT doc_id, 'e' || doc_id % 40 AS e FROM d WHERE doc_id % 4 = 0 UNION SELECT doc_id, 'm_' || me.email FROM (SELECT doc_id, unnest(mails) AS m FROM d) x JOIN me ON {_key('x.m')} = {_key('me.email')}),
al AS (SELECT 'e' || item_id AS e, {_key("array_to_string((string_split(" + _N.format('text') + ", ' '))[1:3], ' ')")} AS k FROM benchmark UNION ALL SELECT 'e7', 'metro'),
wh AS (SELECT DISTINCT doc_id, e FROM d JOIN al ON length(k) > 3 AND (contains(body, k) OR (doc_id % 10 = 0 AND contains('metro', k)) OR contains('scan' || doc_id, k))),
s AS (SELECT doc_id, list_sort(list(DISTINCT e)) AS strong FROM sh GROUP BY doc_id), w AS (SELECT doc_id, list_sort(list(DISTINCT e)) AS weak FROM wh GROUP BY doc_id),
j AS (SELECT d.doc_id, coalesce(strong, []) AS strong, coalesce(weak, []) AS weak, d.doc_id % 41 <> 0 AS readable, CASE WHEN d.doc_id % 8 = 0 THEN 'e' || d.doc_id % 40 END AS cur FROM d LEFT JOIN s USING (doc_id) LEFT JOIN w USING (doc_id)),
r AS (SELECT *, list_filter([CASE WHEN NOT readable THEN 'source_unreadable' END, CASE WHEN len(strong) > 1 THEN 'several_strong' END,
  CASE WHEN len(strong) = 1 AND strong[1] NOT LIKE 'm\_%' ESCAPE '\' AND ((doc_id % 3 = 0 AND substr(strong[1], 2)::INT % 5 = 0) OR (doc_id % 3 = 1 AND substr(strong[1], 2)::INT % 5 <> 0)) THEN 'role_mismatch' END,
  CASE WHEN len(strong) = 1 AND len(list_filter(weak, lambda x: NOT list_contains(strong, x))) > 0 THEN 'weak_disagrees' END, CASE WHEN cur IS NOT NULL AND len(strong) > 0 AND NOT list_contains(strong, cur) THEN 'current_disagrees' END, CASE WHEN len(strong) = 0 AND len(weak) > 1 THEN 'several_weak' END], lambda x: x IS NOT NULL) AS reasons FROM j),
z AS (SELECT *, CASE WHEN len(strong) = 1 AND len(reasons) = 0 THEN strong[1] END AS proposed FROM r),
f AS (SELECT *, CASE WHEN NOT readable THEN 'SOURCE_UNREADABLE' WHEN len(reasons) > 0 THEN 'REVIEW_CONFLICT' WHEN proposed IS NOT NULL AND coalesce(proposed <> cur, true) THEN 'UPDATED' ELSE 'UNCHANGED' END AS status FROM z)
"""


# ---- assignment ----


def _assigned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers of two words and articles of one, taken from benchmark passages."""
    b, d = read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents")
    words = F.regexp_extract_all(c("text"), F.lit(r"(?U)\w{4,}"), F.lit(0))
    suppliers = b.select("item_id", F.concat(F.array_join(F.slice(words, 1, 2), "  "), F.lit(" GmbH")).alias("name"))
    articles = b.select("item_id", F.posexplode(F.slice(words, 3, 3)).alias("k", "name")).select((c("item_id") * 10 + c("k")).alias("article_id"), "name")
    s = assign.supplier_of(d, "doc_id", "text", suppliers, "item_id", "name")
    a = assign.articles_of(d, "doc_id", "text", articles, "article_id", "name").withColumn("rate", F.when(c("article_id") % 3 == 0, 7.0).when(c("article_id") % 3 == 1, 19.0))
    return s, a


def supplier_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir)[0].select("doc_id", "supplier_id")


def article_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir)[1].select("doc_id", "article_id", "place")


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign.enrich(config.real_documents(read(spark, sf_dir, "documents").select("doc_id")), "doc_id", *_assigned(spark, sf_dir))


def assignment_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enriched(spark, sf_dir).select("doc_id", "supplier_id", F.size("article_ids").alias("articles"), "article_rate", "goods", "skr03", "skr04")


def backfill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign.backfill_report(_enriched(spark, sf_dir))


_ASSIGN = r"""
WITH w AS (SELECT item_id, regexp_extract_all(text, '[\p{L}\p{N}_]{4,}') AS w FROM benchmark),
d AS (SELECT doc_id, regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g') AS t FROM documents),
s AS (SELECT item_id, regexp_replace(replace(lower(array_to_string(w[1:2], '  ') || ' GmbH'), 'ß', 'ss'), '\s+', ' ', 'g') AS n, list_transform(w[1:2], lambda x: replace(lower(x), 'ß', 'ss')) AS k FROM w),
sm AS (SELECT doc_id, item_id, n FROM d JOIN s ON contains(t, n) OR (len(list_filter(k, lambda x: contains(t, x))) >= least(2, len(k)) AND len(list_filter(k, lambda x: contains(t, x))) / len(k) >= 0.7)),
sup AS (SELECT doc_id, arg_min(item_id, (-length(n), item_id)) AS supplier_id FROM sm GROUP BY doc_id),
a AS (SELECT item_id * 10 + i AS article_id, replace(lower(x), 'ß', 'ss') AS n FROM (SELECT item_id, unnest(w[3:5]) AS x, generate_subscripts(w[3:5], 1) - 1 AS i FROM w) WHERE length(replace(lower(x), 'ß', 'ss')) >= 5),
am AS (SELECT doc_id, article_id, row_number() OVER (PARTITION BY doc_id ORDER BY article_id) AS place FROM d JOIN a ON contains(t, n)),
art AS (SELECT doc_id, article_id, place::INTEGER AS place, CASE article_id % 3 WHEN 0 THEN 7.0::DOUBLE WHEN 1 THEN 19.0::DOUBLE END AS rate FROM am WHERE place <= 12),
rt AS (SELECT doc_id, arg_max(rate, (n, -rate)) AS rate FROM (SELECT doc_id, rate, count(*) AS n FROM art WHERE rate IS NOT NULL GROUP BY ALL) GROUP BY doc_id),
en AS (SELECT d.doc_id, supplier_id, coalesce(ac.n, 0)::INTEGER AS articles, rt.rate AS article_rate FROM d LEFT JOIN sup USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM art GROUP BY 1) ac USING (doc_id) LEFT JOIN rt USING (doc_id))
"""


# ---- jobs ----


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stored jobs."""
    e = read(spark, sf_dir, "events")
    states = F.create_map(*[F.lit(x) for kv in {"signup": "DISCOVERED", "view": "OCR_RUNNING", "click": "RETRY_PENDING", "purchase": "COMMITTED", "error": "FAILED"}.items() for x in kv])
    return e.select(c("event_id").alias("job_id"), F.md5(F.concat_ws("|", "user_id", F.date_format("ts", "yyyy-MM-dd"))).alias("source_md5"), (c("user_id") % 5 + 1).alias("page_start"), (c("user_id") % 5 + 2).alias("page_end"), states[c("event_type")].alias("status"), F.get_json_object("props", "$.k").cast("int").alias("attempt_count"), F.when(c("event_id") % 3 == 0, "w1").alias("locked_by"), c("ts").alias("created_at"), c("ts").alias("updated_at"))


def latest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 newest jobs, as a viewer may see them."""
    return records.safe_jobs(records.latest(_states(spark, sf_dir), "created_at", "job_id", 100))


def unique_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job for each hash and page range: the first that was created."""
    return jobs.unique_jobs(_states(spark, sf_dir), ["source_md5", "page_start", "page_end"], ["created_at", "job_id"]).select("job_id", "source_md5")


def job_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by id: the ids asked for are those of orders; most have a job."""
    asked = read(spark, sf_dir, "orders").select((c("o_orderkey") * 7).alias("job_id"))
    return jobs.lookup(_states(spark, sf_dir), asked).select("job_id", "status")


def resume_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), (c("n_chars") + c("doc_id") % 3).alias("updated_at"))
    return jobs.first_by_hash(d, c("doc_id") % 4 != 0)


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last checkpoint of each user's job that its owner saved under its lease."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", F.unix_timestamp("ts").alias("at"), (c("event_id") % 3).cast("string").alias("worker"), "props")
    held = e.groupBy(c("user_id").alias("job_id")).agg((F.max("user_id") % 3).cast("string").alias("owner"), (F.floor((F.max("at") + F.min("at")) / 2)).alias("lease"))
    return jobs.checkpoints(held, e.select(c("user_id").alias("job_id"), "worker", "at", F.to_json(F.struct("event_id")).alias("data"))).select("job_id", "checkpoint")


def committed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot of the store: jobs in all and committed, documents, vectors, pages, contacts."""
    j = _states(spark, sf_dir)
    tables = {"jobs": j, "committed": j.where("status = 'COMMITTED'")} | {n: read(spark, sf_dir, n) for n in ("documents", "embeddings", "pages", "customer")}
    return records.stats(tables)


def job_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs that pass the pipeline's steps, some of which stop or fail on the way."""
    o = read(spark, sf_dir, "orders").select(c("o_orderkey").cast("string").alias("job_id"), (c("o_orderkey") % 9).alias("stop"))
    names = F.array(*[F.lit(n) for n in ("acquire", "ocr_start", "ocr_done", "analyse", "analysed", "persist", "commit")])
    steps = o.select("job_id", "stop", F.posexplode(names).alias("seq", "step")).where("seq <= stop")
    steps = steps.withColumn("step", F.when((c("seq") == 4) & (c("stop") == 4), "fail").otherwise(c("step")))
    return jobs.fold(jobs.stage_events(steps.select("job_id", c("seq").cast("long").alias("seq"), "step", c("seq").cast("double").alias("at"), F.lit("w").alias("worker")))).select("job_id", "status", "attempts", "rejected")


_JOBS = "WITH j AS (SELECT event_id AS job_id, md5(user_id || '|' || strftime(ts, '%Y-%m-%d')) AS source_md5, user_id % 5 + 1 AS page_start, user_id % 5 + 2 AS page_end, CASE event_type WHEN 'signup' THEN 'DISCOVERED' WHEN 'view' THEN 'OCR_RUNNING' WHEN 'click' THEN 'RETRY_PENDING' WHEN 'purchase' THEN 'COMMITTED' WHEN 'error' THEN 'FAILED' END AS status, (props->>'k')::INTEGER AS attempt_count, event_id % 3 = 0 AS leased, ts FROM events) "


# ---- prices, mails, records ----


def price_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of orders replace those of their documents; those without a document are added."""
    line = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_extendedprice").alias("price"))
    row = lambda k, p: line.select(F.when(c("l_orderkey") % 10 != 0, c("l_orderkey").cast("string")).alias("document_id"), c("l_partkey").alias("item"), F.lit("kg").alias("unit"), p.alias("price"), F.lit(k).alias("recorded_at"))
    old, new = row(1, c("price")), row(2, c("price") + 1).where("document_id is null or item % 2 = 0")
    return prices.upsert_prices(old, new, ["document_id", "item", "unit"])


def mail_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One draft for each subject, sender and intent: the last mail's."""
    o = read(spark, sf_dir, "orders")
    mails = o.select(F.concat(F.lit("Betreff "), "o_orderpriority").alias("subject"), F.concat(c("o_custkey") % 20, F.lit("@x.de")).alias("sender"), F.concat(F.lit("Firma "), c("o_custkey")).alias("supplier"), F.when(c("o_orderstatus") == "F", "RECHNUNG_INVOICE").alias("intent"), c("o_orderkey").alias("at"))
    return records.keep_last(records.mail_drafts(mails), ["draft_id"], ["at"]).select("draft_id", "subject", "sender", "supplier", "intent", "status", F.md5("draft").alias("draft_md5"))


def vouchers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(c("o_orderkey").alias("seq"), F.concat(F.lit("Kunde "), "o_custkey").alias("supplier"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), c("o_totalprice").alias("gross"), F.lit(0.0).alias("net"), F.lit(0.0).alias("tax"), F.lit("3400").alias("skr03"), (c("o_orderkey") % 2 == 0).alias("passed"), F.when(c("o_orderkey") % 3 == 0, "OPEN").otherwise("PASSED").alias("validation_status"), (c("o_orderkey") % 5 != 0).alias("persisted"))
    return records.vouchers(o, 7).select("id", "seq", "supplier", "day", "gross", "status")


def approval_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    parts = {"supplier": F.when(c("o_orderkey") % 5 != 0, F.concat(F.lit("Kunde "), "o_custkey")), "day": F.date_format("o_orderdate", "yyyy-MM-dd"), "gross": (c("o_orderkey") % 100).cast("double"), "net": F.lit(None).cast("double"), "tax": F.lit(0.5), "skr03": F.lit(None).cast("string"), "status": c("o_orderstatus"), "reason": F.lit(None).cast("string")}
    path = records.mock_path(parts["day"], parts["supplier"], parts["gross"], c("o_orderkey") % 2 == 0, F.lit("2026-01-01").cast("date"))
    return o.select("o_orderkey", F.md5(records.approval_message(parts)).alias("message_md5"), path.alias("path"))


def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with texts and summaries filled in, ids of files, page ids, and the bytes of a mock vector."""
    d = read(spark, sf_dir, "documents")
    rows = config.real_documents(d.select(F.when(c("doc_id") % 9 == 0, F.concat(F.lit("TEST-"), "doc_id")).otherwise(c("doc_id").cast("string")).alias("doc_id"), F.when(c("doc_id") % 4 != 0, c("text")).alias("text"), F.lit("Metro").alias("supplier"), F.when(c("doc_id") % 2 == 0, "2024-01-02").alias("day"), c("n_chars").alias("gross"), F.lit("R 1").alias("number"), F.lit(None).cast("string").alias("goods"), F.lit("PASSED").alias("status"), F.when(c("doc_id") % 3 == 0, "kurz").alias("summary")))
    out = records.synthesised(rows)
    m = F.md5("text")
    v = records.mock_embedding(c("doc_id"))
    return out.select("doc_id", m.alias("text_md5"), "summary", records.file_document_id(m, F.when(c("doc_id").endswith("1"), 3)).alias("file_id"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 6).alias("vector_sum"), F.size(v).alias("vector_dim"), tx.safe_id(F.concat(F.lit("/a b/"), "doc_id", F.lit("!"))).alias("safe"), tx.question_slug(F.substring("text", 1, 60)).alias("slug"))


def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector index after documents were indexed again: their old chunks are gone, those of other documents stay, and what was appended stays twice."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), (c("doc_id") % 3).cast("int"))).alias("chunk_no"), F.lit("alt").alias("chunk"))
    index = records.chunk_rows(d).withColumn("doc_id", c("doc_id").cast("string"))
    new = records.chunk_rows(read(spark, sf_dir, "documents").where("doc_id % 4 = 0").select("doc_id", F.lit(0).alias("chunk_no"), F.lit("neu").alias("chunk"))).withColumn("doc_id", c("doc_id").cast("string"))
    out = records.append_vectors(records.replace_vectors(index, new), new.where("doc_id like '%8'"))
    return records.without_prefix(out, "doc_id", "1", "10").select("id", "doc_id", "chunk")


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as they are logged, and the last 1000 lines of that log."""
    e = read(spark, sf_dir, "events")
    rows = records.audit_events(e.select(c("ts").alias("at"), F.concat("user_id", F.lit("@x.de")).alias("identity"), c("event_type").alias("action"), F.concat(F.lit("token="), "event_id").alias("target"), F.when(c("event_id") % 7 == 0, "denied").alias("outcome"), "event_id"))
    lines = e.select(c("event_id").alias("n"), F.concat(F.lit("secret: "), "event_id", F.lit("  ")).alias("line"))
    return rows.groupBy("action", "outcome").agg(F.count("*").alias("n"), F.min("identity").alias("identity"), F.max("target").alias("target")).unionByName(config.redacted_log(lines, 5000).agg(F.lit("log").alias("action"), F.min("line").alias("outcome"), F.count("*").alias("n"), F.max("line").alias("identity"), F.min("n").cast("string").alias("target")))


QUERIES = {f.__name__: f for f in (
    save_plan, ledger_rows, ledger_append, numbered_ledger, store_upserts, intake_ledger, lease_expiry, page_cache_runs, source_manifest, inventory, contact_upsert, contact_list, known_contacts, reconciliation_status, weak_evidence, reconciliation_summary, reconciliation_apply, supplier_assignment, article_matches, assignment_enrichment, backfill_report,
    latest_jobs, unique_jobs, job_lookup, resume_by_hash, checkpoints, committed_stats, job_stages, price_upsert, mail_drafts, vouchers, approval_messages, stored_documents, vector_upsert, audit_log,
)}

SQL = {
    "save_plan": _SAVED + "SELECT seq, save_status, CASE WHEN save_status = 'DUBLITTE_MD5' THEN 'DUBLITTE_MD5_NO_SAVE' WHEN save_status = 'DUBLITTE_VERDACHT' THEN '04_Pruefung_Erforderlich/DUBLITTEN' WHEN seq % 3 = 0 THEN '01_Eingangsarchiv/' || y ELSE '04_Pruefung_Erforderlich' END AS destination FROM p",
    "ledger_rows": _LEDGER,
    "numbered_ledger": "SELECT printf('VG-%04d', row_number() OVER (ORDER BY s_suppkey)) AS ledger_id, s_suppkey, s_name AS name FROM supplier",
    "store_upserts": "SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 3 WHEN c_custkey % 2 = 0 THEN 2 ELSE 0 END AS round FROM customer",
    "intake_ledger": "WITH d AS (SELECT doc_id, md5(coalesce(text, '')) AS md5, row_number() OVER (ORDER BY doc_id % 4 = 3, doc_id) AS n FROM documents) SELECT printf('VG-%04d', n) AS ledger_id, doc_id, md5, CASE WHEN row_number() OVER (PARTITION BY md5 ORDER BY n) = 1 THEN 'NEW' ELSE 'DUPLICATE' END AS status FROM d",
    "lease_expiry": "WITH e AS (SELECT c_custkey AS k, c_custkey * 10.0::DOUBLE + 1 AS t, c_custkey % 3 AS m FROM customer), x AS (SELECT *, CASE m WHEN 0 THEN t + 600 WHEN 1 THEN t + 1100 END AS l, (SELECT max(t + CASE m WHEN 0 THEN 10 WHEN 1 THEN 500 ELSE 20 END) FROM e) AS now FROM e), y AS (SELECT *, m = 2 OR l <= now AS back FROM x) SELECT k::VARCHAR AS job_id, CASE WHEN back THEN 'RETRY_PENDING' WHEN m = 0 THEN 'OCR_RUNNING' ELSE 'DISCOVERED' END AS status, back::INTEGER AS attempts, CASE WHEN NOT back THEN 'w' END AS owner, CASE WHEN NOT back THEN l END AS lease, CASE WHEN m = 2 THEN t + 50 WHEN back THEN l + 30 END AS retry_at, CASE WHEN back THEN CASE m WHEN 0 THEN 'OCR_RUNNING' ELSE 'DISCOVERED' END END AS stage, 0 AS rejected FROM y",
    "page_cache_runs": "WITH n AS (SELECT count(DISTINCT s_nationkey) AS n, count(DISTINCT s_nationkey) FILTER (s_nationkey % 2 = 0) AS e FROM supplier) SELECT 1 AS run, n AS files, 0::BIGINT AS hits, n AS misses FROM n UNION ALL SELECT 2, n, n, 0 FROM n UNION ALL SELECT 3, n + e, n + e, 0 FROM n",
    "ledger_append": "SELECT printf('VG-%04d', row_number() OVER (ORDER BY s_suppkey)) AS ledger_id, s_suppkey, s_name AS name FROM supplier",
    "source_manifest": "WITH d AS (SELECT 'in/' || source || '.pdf' AS file, count(*) AS saved, bool_and(doc_id % 37 <> 5) AS ok, max(CASE WHEN doc_id = 3 THEN 1 ELSE 0 END) AS more FROM documents GROUP BY 1) SELECT file, (saved + more)::BIGINT AS documents, saved, ok AND more = 0 AS complete, CASE WHEN ok AND more = 0 THEN 'Done_' ELSE '' END || substr(file, 4) AS target FROM d",
    "inventory": "SELECT 'f' || o_orderkey || '.pdf' AS source, 'in/' || CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0 THEN '' ELSE 'Done_' END || 'f' || o_orderkey || '.pdf' AS path, CASE WHEN o_orderkey % 4 = 0 THEN 'DONE' WHEN o_orderkey % 3 = 0 THEN 'FEHLER' ELSE 'BEREITS_DONE' END AS status FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0 UNION ALL SELECT 'f' || o_orderkey || '.pdf', 'in/Done_f' || o_orderkey || '.pdf', 'BEREITS_DONE' FROM orders WHERE o_orderkey % 6 = 0 AND o_orderkey % 4 <> 0",
    "contact_upsert": _UPSERT,
    "contact_list": "WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) SELECT c_custkey AS entity_id, 'Name ' || c_custkey % 50 AS canonical_name, 'supplier' AS role, coalesce(n, 0) AS alias_count, 1 AS evidence_count, '*******' || right('DE' || (c_custkey + 100000000), 4) AS tax_id, '' AS iban, repeat('*', length(c_custkey || '@x.de') - 4) || 'x.de' AS email FROM customer LEFT JOIN a ON k = c_custkey",
    "known_contacts": _KNOWN,
    "reconciliation_status": _RECON + "SELECT doc_id, array_to_string(strong, ',') AS strong, array_to_string(weak, ',') AS weak, array_to_string(reasons, ',') AS reasons, proposed, status FROM f",
    "weak_evidence": _RECON + "SELECT doc_id, e AS entity_id FROM wh",
    "reconciliation_summary": _RECON + "SELECT count(*) AS processed, count(*) FILTER (len(reasons) > 0) AS conflicts, count(*) FILTER (status = 'UPDATED') AS updated, count(*) FILTER (status = 'UNCHANGED') AS unchanged, 0::BIGINT AS no_candidate_entities FROM f",
    "reconciliation_apply": _RECON + "SELECT doc_id, CASE WHEN status = 'UPDATED' THEN proposed ELSE cur END AS current FROM f",
    "supplier_assignment": _ASSIGN + "SELECT * FROM sup",
    "article_matches": _ASSIGN + "SELECT doc_id, article_id, place FROM art",
    "assignment_enrichment": _ASSIGN + "SELECT doc_id, supplier_id, articles, article_rate, CASE article_rate WHEN 7 THEN 'Lebensmittel' WHEN 19 THEN 'Betriebsbedarf' END AS goods, CASE article_rate WHEN 7 THEN '3400' WHEN 19 THEN '4900' END AS skr03, CASE article_rate WHEN 7 THEN '5400' WHEN 19 THEN '6300' END AS skr04 FROM en",
    "backfill_report": _ASSIGN + "SELECT count(*) AS migrated, count(supplier_id) AS supplier_matches, sum(articles)::BIGINT AS article_matches FROM en",
    "latest_jobs": _JOBS + "SELECT job_id, status, page_start, page_end, attempt_count, ts AS updated_at, leased, repeat('*', 24) || right(source_md5, 8) AS source_hash FROM j ORDER BY ts DESC, job_id LIMIT 100",
    "unique_jobs": _JOBS + "SELECT arg_min(job_id, (ts, job_id)) AS job_id, source_md5 FROM j GROUP BY source_md5, page_start, page_end",
    "job_lookup": _JOBS + "SELECT job_id, status FROM j WHERE job_id IN (SELECT o_orderkey * 7 FROM orders)",
    "resume_by_hash": "SELECT md5, doc_id FROM (SELECT md5(text) AS md5, arg_min(doc_id, (n_chars + doc_id % 3, doc_id)) AS doc_id FROM documents GROUP BY 1) WHERE doc_id % 4 <> 0",
    "checkpoints": "WITH e AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS sec FROM events), h AS (SELECT user_id, (max(sec) + min(sec)) // 2 AS lease FROM e GROUP BY 1) SELECT user_id AS job_id, max('{\"event_id\":' || event_id || '}') FILTER (sec = m) AS checkpoint FROM (SELECT h.user_id, event_id, sec, max(sec) OVER (PARTITION BY h.user_id) AS m FROM h LEFT JOIN e ON e.user_id = h.user_id AND event_id % 3 = h.user_id % 3 AND sec <= lease) GROUP BY user_id",
    "committed_stats": "SELECT 'jobs' AS name, count(*) AS n FROM events UNION ALL SELECT 'committed', count(*) FROM events WHERE event_type = 'purchase' " + " ".join(f"UNION ALL SELECT '{t}', count(*) FROM {t}" for t in ("documents", "embeddings", "pages", "customer")),
    "job_stages": "SELECT o_orderkey::VARCHAR AS job_id, (['DISCOVERED', 'OCR_RUNNING', 'OCR_COMPLETE', 'ANALYSIS_RUNNING', 'RETRY_PENDING', 'RAG_RUNNING', 'COMMITTED'])[least(o_orderkey % 9, 6) + 1] AS status, (o_orderkey % 9 = 4)::INTEGER AS attempts, 0 AS rejected FROM orders",
    "price_upsert": "WITH l AS (SELECT l_orderkey, l_partkey AS item, min(l_extendedprice) AS p FROM lineitem GROUP BY ALL) SELECT l_orderkey::VARCHAR AS document_id, item, 'kg' AS unit, p + CASE WHEN item % 2 = 0 THEN 1 ELSE 0 END AS price, 1 AS recorded_at FROM l WHERE l_orderkey % 10 <> 0 UNION ALL SELECT NULL, item, 'kg', p, 1 FROM l WHERE l_orderkey % 10 = 0 UNION ALL SELECT NULL, item, 'kg', p + 1, 2 FROM l WHERE l_orderkey % 10 = 0",
    "mail_drafts": """WITH m AS (SELECT 'Betreff ' || o_orderpriority AS subject, o_custkey % 20 || '@x.de' AS sender, 'Firma ' || o_custkey AS supplier, CASE WHEN o_orderstatus = 'F' THEN 'RECHNUNG_INVOICE' ELSE 'ALLGEMEINE_ANFRAGE' END AS intent, o_orderkey AS k FROM orders),
k AS (SELECT subject, sender, intent, arg_max(supplier, k) AS supplier FROM m GROUP BY ALL)
SELECT 'draft_' || substr(sha256(subject || chr(31) || sender || chr(31) || intent), 1, 24) AS draft_id, subject, sender, supplier, intent, 'PENDING_APPROVAL' AS status, md5('Guten Tag ' || supplier || ',' || chr(10) || chr(10) || CASE intent WHEN 'RECHNUNG_INVOICE' THEN 'vielen Dank für Ihre Rechnung. Wir haben sie erhalten und prüfen sie.' ELSE 'vielen Dank für Ihre Nachricht. Wir melden uns in Kürze.' END || chr(10) || chr(10) || 'Mit freundlichen Grüßen') AS draft_md5 FROM k""",
    "vouchers": "SELECT printf('SEV-MOCK-%04d', row_number() OVER (ORDER BY o_orderkey) + 7) AS id, o_orderkey AS seq, 'Kunde ' || o_custkey AS supplier, strftime(o_orderdate, '%Y-%m-%d') AS day, o_totalprice AS gross, 'offen' AS status FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0",
    "approval_messages": """WITH m AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN 'Kunde ' || o_custkey ELSE 'Unbekannt' END AS s, strftime(o_orderdate, '%Y-%m-%d') AS d, printf('%.2f', (o_orderkey % 100)::DOUBLE) AS g, o_orderstatus AS st, chr(10) AS nl FROM orders)
SELECT o_orderkey, md5('Neuer Beleg erfasst:' || nl || '- Lieferant: ' || s || nl || '- Datum: ' || d || nl || '- Brutto: ' || g || ' EUR (Netto: 0.00 EUR, USt: 0.50 EUR)' || nl || '- Soll-Konto: 3400' || nl || '- Status: ' || st || ' ()' || nl || nl || '[ 1 ] Bestätigen und buchen' || nl || '[ 2 ] Zur manuellen Prüfung verschieben' || nl) AS message_md5,
  CASE WHEN o_orderkey % 2 = 0 THEN substr(d, 1, 4) || '/' || substr(d, 6, 2) || '/' ELSE '00_Manuelle_Prüfung_Nötig/' END || d || '_' || replace(s, ' ', '_') || '_' || g || 'EUR.pdf' AS path FROM m""",
    "stored_documents": r"""WITH d AS (SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 4 <> 0 AND trim(text) <> '' THEN text ELSE 'Lieferant: Metro, Datum: ' || CASE WHEN doc_id % 2 = 0 THEN '2024-01-02' ELSE '' END || ', Betrag: ' || n_chars || ' EUR, Beleg-ID: ' || doc_id END AS t, CASE WHEN doc_id % 3 = 0 THEN 'kurz' ELSE 'Beleg ' || doc_id || ' von Metro, Datum ' || CASE WHEN doc_id % 2 = 0 THEN '2024-01-02' ELSE '' END || ', Brutto ' || n_chars || ' EUR, Rechnungsnummer R 1, Warengruppe , Status PASSED.' END AS summary FROM documents WHERE doc_id % 9 <> 0)
SELECT doc_id, md5(t) AS text_md5, summary, 'MF-' || substr(md5(t), 1, 16) || '-' || CASE WHEN right(doc_id, 1) = '1' THEN 3 ELSE 1 END AS file_id, round(list_sum(list_transform(range(0, 16), lambda k: ('0x' || substr(md5(doc_id), 2 * k + 1, 2))::INTEGER / 255.0::DOUBLE)), 6) AS vector_sum, 384 AS vector_dim, 'a_b_' || doc_id AS safe,
  regexp_replace(substr(regexp_replace(lower(substr(t, 1, 60)), '[^\p{L}\p{N}]', '_', 'g'), 1, 40), '^_+|_+$', '', 'g') AS slug FROM d""",
    "vector_upsert": "WITH i AS (SELECT doc_id, unnest(range(0, doc_id % 3 + 1)) AS k FROM documents), r AS (SELECT doc_id || '_chunk_' || k AS id, doc_id::VARCHAR AS doc_id, 'alt' AS chunk FROM i WHERE doc_id % 4 <> 0 UNION ALL SELECT doc_id || '_chunk_0', doc_id::VARCHAR, 'neu' FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id || '_chunk_0', doc_id::VARCHAR, 'neu' FROM documents WHERE doc_id % 4 = 0 AND doc_id::VARCHAR LIKE '%8') SELECT * FROM r WHERE NOT (doc_id LIKE '1%' AND doc_id NOT LIKE '10%')",
    "audit_log": "SELECT event_type AS action, CASE WHEN event_id % 7 = 0 THEN 'denied' ELSE 'ok' END AS outcome, count(*) AS n, '[EMAIL-REDACTED]' AS identity, 'token=[REDACTED]' AS target FROM events GROUP BY ALL UNION ALL SELECT 'log', 'secret: [REDACTED]', count(*), 'secret: [REDACTED]', min(event_id)::VARCHAR FROM (SELECT event_id FROM events ORDER BY event_id DESC LIMIT 1000)",
}
