"""Link graphs of pages: edges, broken links, orphans, hubs, duplicate slugs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def links(pages: DataFrame, page_id: str, body: str, pattern: str, group: int = 1) -> DataFrame:
    """Distinct (page_id, target) of the links in a body."""
    found = F.array_distinct(F.regexp_extract_all(F.col(body), F.lit(pattern), F.lit(group)))
    return pages.select(F.col(page_id).alias("page_id"), F.explode(found).alias("target"))


HREF, WIKILINK, MARKDOWN = r'href="([^"#?]+)"', r"\[\[([^\]|#]+)(?:[|#][^\]]*)?\]\]", r"\[[^\]]*\]\(([^)#\s]+)\)"


def broken(edges: DataFrame, slugs: DataFrame) -> DataFrame:
    """Edges to a target that no page has (slugs: target)."""
    return edges.join(slugs.select("target").distinct(), "target", "left_anti")


def orphans(pages: DataFrame, slug: str, edges: DataFrame) -> DataFrame:
    """Pages that no edge points to."""
    return pages.join(edges.select(F.col("target").alias(slug)).distinct(), slug, "left_anti")


def hubs(edges: DataFrame) -> DataFrame:
    """target, source_count, first_source: a hub's sources as a set, counted before the shuffle."""
    return edges.groupBy("target").agg(F.count_distinct("page_id").alias("source_count"), F.min("page_id").alias("first_source"))


def duplicate_slugs(pages: DataFrame, slug: Column) -> DataFrame:
    return pages.groupBy(slug.alias("slug")).agg(F.count("*").alias("n")).where("n > 1")


def lint(pages: DataFrame, slug: str, edges: DataFrame) -> DataFrame:
    """check, n: pages, links, broken links, orphans and repeated slugs of a page set, by key joins and counts alone."""
    slugs = pages.select(F.col(slug).alias("target"))
    parts = {"pages": pages, "links": edges, "broken_links": broken(edges, slugs), "orphans": orphans(pages, slug, edges), "duplicate_slugs": duplicate_slugs(pages, F.col(slug))}
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def top_counts(rows: DataFrame, key: str, top: int | None = None) -> DataFrame:
    """Counts by key, the most frequent first, ties by key."""
    out = rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key)
    return out.limit(top) if top else out


def compaction(docs: DataFrame, entity: str, keys: list[str]) -> DataFrame:
    """Documents and surplus copies (rows beyond the first of equal keys) of each entity."""
    groups = docs.groupBy(entity, *keys).agg(F.count("*").alias("c"))
    return groups.groupBy(entity).agg(F.sum("c").alias("documents"), F.sum(F.col("c") - 1).alias("surplus"))


def dominant(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key; ties to the smaller value."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.max_by(value, F.struct("n", -F.col(value))).alias("dominant"), F.max("n").alias("n"))
