"""A wiki of Markdown pages as a table (path, text): parsing, links, checks, repairs, and the pages that are generated.

Paths are relative to the wiki, with ``/``.  A page's stem is its file name without ``.md``.  Links resolve by equality
joins on paths and stems.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.scratch import materialize

#: The fields of front matter, of a supplier's beside them, pages that are no knowledge, roles of entity types.
REQUIRED, SUPPLIER_FIELDS = ("entity_id", "entity_type", "canonical_name", "source_count", "updated"), ("article_categories", "skr03_accounts")
SYSTEM_PAGES = ("index.md", "log.md")
TYPE_CATEGORY = {"supplier": "lieferant", "customer": "kunde", "article_category": "artikelart", "review_queue": "prüfung"}
LEGACY_CATEGORIES = ("persona", "buchhaltung", "workflow", "konzept")
UNRESOLVED = ("", "unknown", "unbekannt", "unbekannterlieferant", "bank", "dublittemd5", "fehler")
NO_FILE = "DUBLITTE_MD5_NO_SAVE"
_FRONT = r"(?s)^---\n(.*?)\n---\n"
_MD_LINK = r"\[[^\]]*\]\(([^)<>]+\.md)(?:#[^)]*)?\)"
_WIKILINK = r"(?U)\[\[([\w\-]+)(?:\|.*?)?\]\]"
_SOURCE = r"(?m)^- `([^`]+)` \| .* \| .* \| .*"
CATEGORY = "article_category_"


def field(front: Column, name: str) -> Column:
    """A scalar of front matter without its quotes; null where the field is absent."""
    line = rf"(?m)^{name}:[ \t]*(.*?)[ \t]*$"
    return F.when(front.rlike(rf"(?m)^{name}:"), F.regexp_replace(F.regexp_extract(front, line, 1), "^\"|\"$|^'|'$", ""))


def list_field(front: Column, name: str) -> Column:
    """A list of front matter in brackets; empty where it is absent or no list."""
    return F.coalesce(F.from_json(F.regexp_extract(front, rf"(?m)^{name}:[ \t]*(\[.*\])[ \t]*$", 1), "array<string>"), F.array().cast("array<string>"))


def knowledge(pages: DataFrame) -> DataFrame:
    """Pages but for the index, the log and what is archived."""
    parts = F.split(F.lower("path"), "/")
    return pages.where(~F.element_at(parts, -1).isin(*SYSTEM_PAGES) & ~F.exists(parts, lambda x: x.contains("archive")))


def parsed(pages: DataFrame) -> DataFrame:
    """pages with stem, front (null without front matter), body, title, category, and the fields of the front matter."""
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    front = F.when(F.col("text").rlike(_FRONT), F.regexp_extract("text", _FRONT, 1))
    out = knowledge(pages).withColumns({"stem": name, "front": front, "body": F.regexp_replace("text", _FRONT, "")})
    lines = F.split("body", "\n")
    heads = F.filter(lines, lambda x: x.startswith("# "))
    said = F.try_element_at(F.filter(lines, lambda x: x.contains("*Kategorie:") & ~x.startswith("# ")), F.lit(1))
    category = F.trim(F.replace(F.replace(F.element_at(F.split(said, r"\|"), 1), F.lit("*Kategorie:"), F.lit("")), F.lit("*"), F.lit("")))
    kinds = F.create_map(*[F.lit(x) for kv in TYPE_CATEGORY.items() for x in kv])
    text = F.try_element_at(F.filter(lines, lambda x: (F.trim(x) != "") & ~x.startswith("#") & ~x.startswith("*")), F.lit(1))
    return out.withColumns({
        "title": F.coalesce(F.trim(F.replace(F.try_element_at(heads, F.size(heads)), F.lit("# "), F.lit(""))), F.initcap(F.replace("stem", F.lit("_"), F.lit(" ")))),
        "category": F.coalesce(field(F.col("front"), "category"), F.try_element_at(kinds, field(F.col("front"), "entity_type")), F.nullif(category, F.lit("")), F.lit("Allgemein")),
        "summary": F.coalesce(F.substring(F.trim(text), 1, 120), F.lit("Keine Zusammenfassung")), "entity_id": field(F.col("front"), "entity_id"), "entity_type": field(F.col("front"), "entity_type"), "categories": list_field(F.col("front"), "article_categories"),
    })


def joined_path(folder: Column, target: Column) -> Column:
    """A relative path from a folder without its . and .. parts; null where it leaves the wiki."""
    parts = F.filter(F.split(F.concat_ws("/", F.nullif(folder, F.lit("")), target), "/"), lambda x: ~x.isin("", "."))
    start = F.struct(F.array().cast("array<string>").alias("p"), F.lit(True).alias("ok"))

    def step(acc: Column, x: Column) -> Column:
        up = x == ".."
        return F.struct(F.when(up, F.slice(acc["p"], 1, F.greatest(F.size(acc["p"]) - 1, F.lit(0)))).otherwise(F.concat(acc["p"], F.array(x))).alias("p"), (acc["ok"] & ~(up & (F.size(acc["p"]) == 0))).alias("ok"))

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["ok"], F.array_join(acc["p"], "/")))


def links(pages: DataFrame) -> DataFrame:
    """(path, kind, target, to_path) of each link of parsed pages: kind markdown or wiki, to_path null where it is broken.

    A Markdown link is relative to its page's folder.  A wikilink names a stem that exactly one page has; a stem of
    several pages is neither resolved nor broken (kind ambiguous).  Links to the index and the log are left out.
    """
    folder = F.regexp_replace("path", "[^/]*$", "")
    md = pages.select("path", F.explode(F.regexp_extract_all("text", F.lit(_MD_LINK), F.lit(1))).alias("target"), folder.alias("_f"))
    md = md.withColumn("_to", F.coalesce(joined_path(F.col("_f"), F.col("target")), F.col("target"))).where(~F.col("_to").isin(*SYSTEM_PAGES))
    known = pages.select(F.col("path").alias("to_path"))
    md = md.join(known, F.col("_to") == F.col("to_path"), "left").select("path", F.lit("markdown").alias("kind"), "target", "to_path")
    wl = pages.select("path", F.explode(F.regexp_extract_all("text", F.lit(_WIKILINK), F.lit(1))).alias("target"))
    stems = pages.groupBy(F.col("stem").alias("_stem")).agg(F.count("*").alias("_n"), F.min("path").alias("_one"))
    wl = wl.join(stems, F.col("target") == F.col("_stem"), "left")
    wl = wl.select("path", F.when(F.col("_n") > 1, "ambiguous").otherwise("wiki").alias("kind"), "target", F.when(F.col("_n") == 1, F.col("_one")).alias("to_path"))
    return md.unionByName(wl)


def graph(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, label, group; edges: source, target) of parsed pages by stem, each edge once, to pages that exist."""
    nodes = pages.select(F.col("stem").alias("id"), F.col("title").alias("label"), F.lower("category").alias("group"))
    targets = F.array_distinct(F.concat(F.regexp_extract_all("text", F.lit(_WIKILINK), F.lit(1)), F.regexp_extract_all("text", F.lit(r"\[.*?\]\(\.\/([a-zA-Z0-9_\-]+)\.md\)"), F.lit(1))))
    edges = pages.select(F.col("stem").alias("source"), F.explode(targets).alias("target"))
    return nodes, edges.join(nodes.select(F.col("id").alias("target")).distinct(), "target", "left_semi").select("source", "target").distinct()


def missing_categories(pages: DataFrame) -> DataFrame:
    """(slug, label) of article categories that parsed pages name, in links or as a supplier's, and no page describes."""
    label = lambda c: F.struct(tx.slug(c).alias("slug"), c.alias("label"))
    complete = F.lit(True)
    for name in REQUIRED:
        complete = complete & field(F.col("front"), name).isNotNull()
    supplier = F.when(complete & (F.col("entity_type") == "supplier"), F.filter(F.transform("categories", lambda x: F.trim(x)), lambda x: x != "")).otherwise(F.array().cast("array<string>"))
    linked = F.transform(F.filter(F.regexp_extract_all("text", F.lit(_WIKILINK), F.lit(1)), lambda x: x.startswith(CATEGORY)), lambda x: F.regexp_replace(x, f"^{CATEGORY}", ""))
    named = pages.select(F.explode(F.concat(F.transform(supplier, label), F.transform(linked, label))).alias("_c")).select("_c.*")
    there = pages.where(F.col("stem").startswith(CATEGORY)).select(F.regexp_replace("stem", f"^{CATEGORY}", "").alias("slug"))
    return named.groupBy("slug").agg(F.min("label").alias("label")).join(there, "slug", "left_anti")


def source_faults(pages: DataFrame, documents: DataFrame | None) -> DataFrame:
    """(path, source_id, status) of sources of suppliers' and review pages that are no file, missing, or cannot be verified."""
    own = pages.where(F.col("entity_type").isin("supplier", "review_queue")).select("path", F.explode(F.regexp_extract_all("text", F.lit(_SOURCE), F.lit(1))).alias("source_id")).withColumn("source_id", F.trim("source_id"))
    no_file = F.col("source_id").contains(NO_FILE)
    if documents is None:
        return own.withColumn("status", F.when(no_file, "NON_FILE_SOURCE").otherwise("SOURCE_DATABASE_UNAVAILABLE (NOT_VERIFIABLE)"))
    there = documents.select(F.col("doc_id").cast("string").alias("source_id"), F.lit(True).alias("_there")).distinct()
    return own.join(there, "source_id", "left").where(no_file | F.col("_there").isNull()).select("path", "source_id", F.when(no_file, "NON_FILE_SOURCE").otherwise("MISSING_SOURCE").alias("status"))


def lint(pages: DataFrame, documents: DataFrame | None = None, exempt: tuple[str, ...] = ()) -> DataFrame:
    """(check, path, detail) of each finding over raw pages (path, text).

    Checks: orphan, broken_markdown_link, broken_wikilink, duplicate_slug, duplicate_entity_id, invalid_front_matter,
    legacy, missing_source, non_file_source, unverified_source, missing_category.  ``exempt`` stems are never orphans and, without front matter, legacy.
    """
    p = materialize(parsed(pages), "pages")  # read by every check, parsed once
    l = materialize(links(p), "links")  # noqa: E741
    none = F.lit(None).cast("string")
    find = lambda rows, check, path=F.col("path"), detail=none: rows.select(F.lit(check).alias("check"), path.alias("path"), detail.alias("detail"))
    reached = l.where("to_path is not null").select(F.col("to_path").alias("path")).distinct()
    legacy = F.col("stem").isin(*exempt) if exempt else F.lit(False)
    for name in LEGACY_CATEGORIES:
        legacy = legacy | F.col("text").contains(f"Kategorie: {name}")
    lacking = F.lit(False)
    for name in REQUIRED:
        lacking = lacking | field(F.col("front"), name).isNull()
    supplier_lacks = F.lit(False)
    for name in SUPPLIER_FIELDS:
        supplier_lacks = supplier_lacks | field(F.col("front"), name).isNull()
    invalid = F.when(F.col("front").isNull(), ~legacy).otherwise(lacking | ((F.col("entity_type") == "supplier") & supplier_lacks))
    whole = p.where(F.col("front").isNotNull() & ~lacking & (F.coalesce("entity_id", F.lit("")) != ""))
    twice = lambda rows, key: rows.groupBy(F.col(key).alias("detail")).agg(F.count("*").alias("_n"), F.min("path").alias("path")).where("_n > 1")
    sources = source_faults(p, documents)
    parts = [
        find(p.where(~F.col("stem").isin(*exempt) if exempt else F.lit(True)).join(reached, "path", "left_anti"), "orphan"),
        find(l.where("kind = 'markdown' and to_path is null"), "broken_markdown_link", detail=F.col("target")), find(l.where("kind = 'wiki' and to_path is null"), "broken_wikilink", detail=F.concat("target", F.lit(".md"))),
        find(twice(p, "stem"), "duplicate_slug", detail=F.col("detail")), find(twice(whole, "entity_id"), "duplicate_entity_id", detail=F.col("detail")),
        find(p.where(F.coalesce(invalid, F.lit(False))), "invalid_front_matter"), find(p.where(F.col("front").isNull() & legacy), "legacy"),
        sources.select(F.when(F.col("status") == "MISSING_SOURCE", "missing_source").when(F.col("status") == "NON_FILE_SOURCE", "non_file_source").otherwise("unverified_source").alias("check"), "path", F.col("source_id").alias("detail")),
        find(missing_categories(p), "missing_category", none, F.col("label")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: Findings that make a wiki unhealthy.
ISSUES = ("orphan", "broken_markdown_link", "broken_wikilink", "duplicate_slug", "duplicate_entity_id", "invalid_front_matter", "missing_source")


def lint_report(findings: DataFrame) -> DataFrame:
    """check, findings and whether they are issues: the summary that a report begins with."""
    return findings.groupBy("check").agg(F.count("*").alias("findings")).withColumn("issue", F.col("check").isin(*ISSUES))


def lint_status(findings: DataFrame) -> str:
    return "ISSUES_FOUND" if findings.where(F.col("check").isin(*ISSUES)).limit(1).count() else "HEALTHY"


def _page(path: Column, text: Column) -> list[Column]:
    return [path.alias("path"), text.alias("text")]


def repaired_categories(pages: DataFrame, updated: str) -> DataFrame:
    """The pages (path, text) of missing categories: what they are, and links to the suppliers that have them."""
    p = parsed(pages)
    gone = missing_categories(p)
    have = p.where(F.col("front").isNotNull()).select(F.explode("categories").alias("label"), F.col("stem").alias("_s")).groupBy("label").agg(F.array_sort(F.collect_set("_s")).alias("_who"))
    j = gone.join(have, "label", "left").withColumn("_who", F.coalesce("_who", F.array().cast("array<string>")))
    stem = F.concat(F.lit(CATEGORY), F.col("slug"))
    lines = F.array_join(F.transform("_who", lambda s: F.concat(F.lit("- [["), s, F.lit("]]"))), "\n")
    text = F.concat(
        F.lit('---\nentity_id: "'), stem, F.lit('"\nentity_type: article_category\ncanonical_name: "'), F.col("label"), F.lit('"\nsource_count: '), F.size("_who").cast("string"), F.lit(f'\ngenerated: true\nupdated: "{updated}"\n---\n\n# '), F.col("label"),
        F.lit("\n*Kategorie: artikelart*\n\nErzeugte Seite der Artikelart '"), F.col("label"), F.lit("'.\n\n## Verknüpfte Lieferanten/Kontakte\n"), lines, F.lit("\n"),
    )
    return j.select(*_page(F.concat(F.lit("entities/categories/"), stem, F.lit(".md")), text))


def index_page(pages: DataFrame) -> DataFrame:
    """The lines of the index: for each category its pages by path, with title and first line (category, place, line)."""
    p = parsed(pages)
    line = F.concat(F.lit("- **["), F.col("title"), F.lit("](./"), F.col("path"), F.lit(")**: "), F.col("summary"), F.lit("..."))
    listed = p.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("path", line.alias("line")))).alias("_l"))
    return listed.select("category", F.posexplode(F.transform("_l", lambda s: s["line"])).alias("place", "line"))


def plain_page(slug: Column, title: Column, content: Column, category: Column, updated: str, cross: Column | None = None) -> list[Column]:
    """path and text of a page that is written by hand or made from an answer."""
    related = F.lit("") if cross is None else F.when(F.size(cross) > 0, F.concat(F.lit("\n\n### Querverweise\n"), F.array_join(F.transform(cross, lambda x: F.concat(F.lit("- ["), x, F.lit("](./"), x, F.lit(".md)"))), "\n"))).otherwise("")
    return _page(F.concat(slug, F.lit(".md")), F.concat(F.lit("# "), title, F.lit("\n*Kategorie: "), category, F.lit(f"* | *Zuletzt aktualisiert: {updated}*\n\n"), F.trim(content), related, F.lit("\n")))


def answer_page(questions: DataFrame, updated: str) -> DataFrame:
    """A page (path, text) of each question and its answer."""
    content = F.concat(F.lit("### Ursprüngliche Frage:\n> "), F.col("question"), F.lit("\n\n### Generierte Erkenntnisse:\n"), F.col("answer"))
    return questions.select(*plain_page(F.concat(F.lit("query_"), tx.question_slug(F.col("question"))), F.concat(F.lit("Analyse: "), F.substring("question", 1, 50)), content, F.lit("erkenntnis"), updated))


def log_lines(events: DataFrame) -> DataFrame:
    """One line of the log for each event (at, action, summary), in order of time."""
    return events.select(F.concat(F.lit("## ["), F.date_format("at", "yyyy-MM-dd HH:mm"), F.lit("] "), F.upper("action"), F.lit(" | "), F.col("summary")).alias("line"), "at")


def raw_source(docs: DataFrame) -> DataFrame:
    """(path, text) of each document's raw text; one without a text says what is known of it."""
    said = F.concat(F.lit("Lieferant: "), F.coalesce("supplier", F.lit("")), F.lit(", Datum: "), F.coalesce(F.col("day").cast("string"), F.lit("")), F.lit(", Betrag: "), F.coalesce(F.col("gross").cast("string"), F.lit("")), F.lit(" EUR, Beleg-ID: "), F.col("doc_id").cast("string"))
    return docs.select(*_page(F.concat(F.lit("raw_sources/belege/beleg_"), tx.safe_id(F.col("doc_id").cast("string")), F.lit(".txt")), F.when(F.trim(F.coalesce("text", F.lit(""))) != "", F.col("text")).otherwise(said)))


def entity_pages(docs: DataFrame, updated: str) -> DataFrame:
    """The hub page (path, text) of each supplier, and one review page for documents whose supplier is unknown.

    docs: doc_id, supplier, entity_id, goods, skr03, day, gross, link.  Sources are sorted by id, sets by value, so the
    pages are the same for any order of the documents.
    """
    name = F.trim(F.coalesce(F.nullif("supplier", F.lit("")), F.lit("Unbekannter Lieferant")))
    open_ = F.regexp_replace(tx.casefold(name), "[^a-z0-9]+", "").isin(*UNRESOLVED)
    stem = F.when(open_, "unresolved-documents").otherwise(tx.slug(name, F.col("entity_id")))
    link = F.when(F.coalesce("link", F.lit("")) != "", F.concat(F.lit("[Quelle](<"), F.col("link"), F.lit(">)"))).otherwise("Quelle in der Datenbank")
    line = F.concat(F.lit("- `"), F.col("doc_id").cast("string"), F.lit("` | "), F.coalesce(F.col("day").cast("string"), F.lit("unbekannt")), F.lit(" | "), F.coalesce(F.format_string("%.2f", "gross"), F.lit("")), F.lit(" EUR | "), link)
    kept = lambda c: F.array_sort(F.collect_set(F.when(~F.trim(F.coalesce(c, F.lit(""))).isin("", "Unbekannt", "UNKNOWN"), F.trim(c))))
    hub = docs.withColumns({"_open": open_, "_stem": stem, "_name": F.when(open_, "Ungeklärte Belege").otherwise(name), "_line": line}).groupBy("_open", "_stem").agg(
        F.max_by("_name", F.struct(F.length("_name"), F.col("_name"))).alias("name"), F.min("entity_id").alias("id"), F.array_sort(F.collect_set("_name")).alias("aliases"), kept(F.col("goods")).alias("goods"), kept(F.col("skr03")).alias("accounts"), F.array_sort(F.collect_set(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("_line").alias("line")))).alias("sources"),
    )
    kind, category, folder = F.when(F.col("_open"), "review_queue").otherwise("supplier"), F.when(F.col("_open"), "prüfung").otherwise("lieferant"), F.when(F.col("_open"), "review/").otherwise("entities/suppliers/")
    shown = F.when(F.size("goods") > 0, F.array_join(F.transform("goods", lambda g: F.concat(F.lit(f"[[{CATEGORY}"), F.replace(tx.slug(g), F.lit("-"), F.lit("_")), F.lit("|"), g, F.lit("]]"))), " ")).otherwise("Noch nicht sicher bestimmt")
    front = F.concat_ws(
        "\n", F.lit("---"), F.concat(F.lit('entity_id: "'), F.when(F.col("_open"), "review_unresolved").otherwise(F.coalesce(F.nullif("id", F.lit("")), F.col("_stem"))), F.lit('"')), F.concat(F.lit("entity_type: "), kind), F.concat(F.lit('canonical_name: "'), F.replace("name", F.lit('"'), F.lit("'")), F.lit('"')),
        F.concat(F.lit("aliases: "), F.to_json("aliases")), F.concat(F.lit("article_categories: "), F.to_json("goods")), F.concat(F.lit("skr03_accounts: "), F.to_json("accounts")), F.concat(F.lit("source_count: "), F.size("sources").cast("string")), F.lit(f"updated: {updated}"), F.lit("---"),
    )
    text = F.concat(
        front, F.lit("\n\n# "), F.col("name"), F.lit("\n*Kategorie: "), category, F.lit("*\n\n## Verdichtetes Wissen\n\n- Belegquellen: "), F.size("sources").cast("string"), F.lit("\n- Artikelarten: "), shown, F.lit("\n- Konten: "), F.when(F.size("accounts") > 0, F.array_join("accounts", ", ")).otherwise("noch nicht sicher bestimmt"),
        F.lit("\n\n## Quellenbelege\n\n"), F.array_join(F.transform("sources", lambda s: s["line"]), "\n"), F.lit("\n"),
    )
    return hub.select(*_page(F.concat(folder, F.col("_stem"), F.lit(".md")), text))


def compaction(docs: DataFrame, old_pages: DataFrame) -> DataFrame:
    """One row: what a wiki of entities instead of documents would save.

    docs: doc_id, supplier, entity_id, number, day, gross; ids that begin with TEST- are left out.  Surplus documents are
    those beyond the first of equal entity, number, day and gross.  old_pages: path of the pages of single documents.
    """
    real = docs.where(~F.col("doc_id").cast("string").startswith("TEST-"))
    name = F.trim(F.coalesce(F.nullif("supplier", F.lit("")), F.lit("Unbekannter Lieferant")))
    keyed = real.withColumns({"_open": tx.normalize_compact(name).isin(*UNRESOLVED), "_key": F.coalesce(F.nullif("entity_id", F.lit("")), tx.casefold(name)), "_number": tx.casefold(F.trim(F.coalesce("number", F.lit(""))))})
    known = keyed.where("not _open")
    surplus = known.where("_number <> ''").groupBy("_key", "_number", "day", "gross").agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("possible_business_duplicates"))
    counts = keyed.agg(F.count("*").alias("belege"), F.count_if("_open").alias("unresolved_documents"))
    entities = known.select("_key").distinct().agg(F.count("*").alias("canonical_supplier_pages"))
    expected = real.select(F.concat(F.lit("beleg_"), tx.safe_id(F.col("doc_id").cast("string")), F.lit(".md")).alias("path")).distinct()
    pages = old_pages.select("path").distinct().join(expected, "path", "left_semi").agg(F.count("*").alias("old_beleg_pages"))
    one = counts.join(entities).join(surplus).join(pages)  # each side is one row
    review = F.when(F.col("unresolved_documents") > 0, 1).otherwise(0)
    return one.withColumns({"review_pages": review, "pages_saved": F.greatest(F.lit(0), F.col("old_beleg_pages") - F.col("canonical_supplier_pages") - review)})


def largest_groups(docs: DataFrame, top: int = 20) -> DataFrame:
    """The entities with the most documents; a report of so many rows."""
    name = F.trim(F.coalesce(F.nullif("supplier", F.lit("")), F.lit("Unbekannter Lieferant")))
    known = docs.where(~tx.normalize_compact(name).isin(*UNRESOLVED)).select(F.coalesce(F.nullif("entity_id", F.lit("")), tx.casefold(name)).alias("entity"))
    return known.groupBy("entity").agg(F.count("*").alias("documents")).orderBy(F.desc("documents"), "entity").limit(top)


def compacted(pages: DataFrame, docs: DataFrame, updated: str) -> DataFrame:
    """The wiki after compaction: pages of single documents under archive/, entity pages in place of their old versions, the rest as it was.

    The result is a new version of the wiki (see ``sinks.upsert_version``); the old one is the backup.
    """
    expected = docs.select(F.concat(F.lit("beleg_"), tx.safe_id(F.col("doc_id").cast("string")), F.lit(".md")).alias("path"), F.lit(True).alias("_old")).distinct()
    moved = pages.join(expected, "path", "left").select(F.when(F.col("_old"), F.concat(F.lit("archive/belege/"), F.col("path"))).otherwise(F.col("path")).alias("path"), "text")
    new = entity_pages(docs, updated)
    return moved.join(new.select("path"), "path", "left_anti").unionByName(new)


def master_pages(contacts: DataFrame, articles: DataFrame) -> DataFrame:
    """(path, text) of a page for each contact, each kind of contact, each article category, and one that leads to them.

    contacts: number, name, kind, city, country.  articles: number, name, category, unit, rate, buy, sell.
    """
    c = F.col
    node = F.concat(F.lit("contact_"), tx.safe_id(c("number").cast("string")))
    group = lambda k: F.concat(F.lit("contact_type_"), tx.safe_id(F.lower(k)))
    cat = lambda k: F.concat(F.lit(CATEGORY), tx.safe_id(F.lower(k)))
    one = contacts.select(*_page(F.concat(F.lit("entities/contacts/"), node, F.lit(".md")), F.concat(F.lit("# "), c("name"), F.lit("\n*Kategorie: kontakt_"), F.lower("kind"), F.lit("*\n\n- **Node-ID:** "), node, F.lit("\n- **Typ:** "), c("kind"), F.lit("\n- **Ort/Land:** "), F.coalesce("city", F.lit("")), F.lit(", "), F.coalesce("country", F.lit("")), F.lit("\n\n## Beziehungen\n\n- [["), group(c("kind")), F.lit("|"), c("kind"), F.lit("]]\n"))))
    of_kind = contacts.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct(node.alias("n"), c("name").alias("t")))).alias("_l"))
    kinds = of_kind.select(*_page(F.concat(F.lit("entities/categories/"), group(c("kind")), F.lit(".md")), F.concat(F.lit("# Kontakte "), c("kind"), F.lit("\n*Kategorie: kontaktart*\n\n## Kontakte\n\n"), F.array_join(F.transform("_l", lambda s: F.concat(F.lit("- [["), s["n"], F.lit("|"), s["t"], F.lit("]]"))), "\n"), F.lit("\n"))))
    row = F.concat(F.lit("- **"), c("number").cast("string"), F.lit(" – "), c("name"), F.lit("** | Einheit: "), F.coalesce("unit", F.lit("")), F.lit(" | USt: "), F.coalesce(c("rate").cast("string"), F.lit("")), F.lit(" % | EK: "), F.coalesce(c("buy").cast("string"), F.lit("")), F.lit(" EUR | VK: "), F.coalesce(c("sell").cast("string"), F.lit("")), F.lit(" EUR"))
    of_cat = articles.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("number", row.alias("t")))).alias("_l"))
    cats = of_cat.select(*_page(F.concat(F.lit("entities/categories/"), cat(c("category")), F.lit(".md")), F.concat(F.lit("# Artikelart "), c("category"), F.lit("\n*Kategorie: artikelart*\n\n- **Anzahl Artikel:** "), F.size("_l").cast("string"), F.lit("\n\n## Artikel\n\n"), F.array_join(F.transform("_l", lambda s: s["t"]), "\n"), F.lit("\n"))))
    entry = of_kind.select(F.concat(F.lit("- [["), group(c("kind")), F.lit("|Kontakte: "), c("kind"), F.lit("]]")).alias("l")).unionByName(of_cat.select(F.concat(F.lit("- [["), cat(c("category")), F.lit("|Artikelart: "), c("category"), F.lit("]]")).alias("l")))
    root = entry.agg(F.array_sort(F.collect_list("l")).alias("_l")).select(*_page(F.lit("wissensgraph.md"), F.concat(F.lit("# Wissensgraph\n*Kategorie: stammdaten*\n\n## Einstiegspunkte\n\n"), F.array_join("_l", "\n"), F.lit("\n"))))
    return one.unionByName(kinds).unionByName(cats).unionByName(root)


def category_page(rows: DataFrame, column: str, title: str) -> DataFrame:
    """The text of a page that counts rows by a column, the most frequent first."""
    n = rows.groupBy(F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit("Ohne Angabe")).alias("k")).agg(F.count("*").alias("n"))
    lines = n.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "k", "n"))).alias("_l"), F.sum("n").alias("all"))
    return lines.select(F.concat(F.lit(f"## {title}\n\n"), F.coalesce("all", F.lit(0)).cast("string"), F.lit(" Einträge\n\n"), F.array_join(F.transform("_l", lambda s: F.concat(F.lit("- "), s["k"], F.lit(": "), s["n"].cast("string"))), "\n")).alias("text"))
