"""How good retrieval and extraction are, against ground truth: one aggregation a query or document, then one over all.

Where nothing can be measured, a figure is null.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import materialize

#: Kinds of queries that a ground truth may name, and the bounds of a good retrieval.
QUERY_TYPES = ("entity", "invoice_number", "date_range", "article_category", "amount", "accounting")
AT_LEAST = {"hit_at_1": 0.80, "hit_at_3": 0.90, "hit_at_5": 0.95, "mrr": 0.85, "hub_first_rate": 1.0}
AT_MOST = {"duplicate_rate": 0.0, "false_entity_rate": 0.05}
REQUIRED = ("supplier", "kind", "net", "tax", "gross")
AMOUNT_TOLERANCE, SURE = 0.02, 0.8


def truth_errors(truth: DataFrame) -> DataFrame:
    """query_id and error of each fault in a ground truth (query_id, query, query_type)."""
    gone = (F.coalesce("query_id", F.lit("")) == "") | (F.coalesce("query", F.lit("")) == "")
    faults = F.array_compact(F.array(F.when(~F.coalesce(F.col("query_type").isin(*QUERY_TYPES), F.lit(False)), F.lit("query_type")), F.when(gone, F.lit("required"))))
    return truth.select("query_id", F.explode(faults).alias("error"))


def _judged(truth: DataFrame, hits: DataFrame, top: int) -> DataFrame:
    """truth and hits side by side, one row a hit, a query without hits once; flags of each hit."""
    j = truth.join(hits.where(F.col("rank") <= top), "query_id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    listed = lambda k, v: (F.size(k) == 0) | yes(F.array_contains(k, F.col(v)))
    return j.withColumns({"_good": yes(F.col("doc_id") == F.col("expected_entity")) | yes(F.array_contains("expected_docs", F.col("doc_id"))), "_cat": listed("allowed_categories", "category"), "_src": listed("expected_sources", "source")})


def retrieval_report(truth: DataFrame, hits: DataFrame, top: int = 5) -> DataFrame:
    """Measures overall (query_type null) and for each query type.

    truth: query_id, query_type, expected_entity, expected_docs, allowed_categories, expected_sources (arrays).  hits:
    query_id, rank, doc_id, source, category.  A hit counts where category and source are allowed; violations are
    shares of the hits that were expected; the entity rates are shares of the queries of type entity.
    """
    good, at = F.col("_good"), F.col("rank")
    wiki = F.col("expected_entity").isNotNull() & F.col("category").startswith("wiki_")
    per = _judged(truth, hits, top).groupBy("query_id", "query_type", "expected_entity").agg(
        F.min(F.when(good & F.col("_cat") & F.col("_src"), at)).alias("first"), F.count("doc_id").alias("n"), F.count_distinct("doc_id").alias("d"), F.count_if(good).alias("relevant"), F.count_if(good & ~F.col("_cat")).alias("bad_category"), F.count_if(good & ~F.col("_src")).alias("bad_source"),
        F.min_by(F.when(wiki, F.col("doc_id")), F.when(wiki, at)).alias("hub"), F.min_by("doc_id", "rank").alias("top"), F.count(F.when(at > 1, F.col("doc_id"))).alias("more"), F.count_distinct(F.when(at > 1, F.col("doc_id"))).alias("more_d"),
        F.coalesce(F.bool_or(good & (F.col("source") == "fts5")), F.lit(False)).alias("fts"), F.coalesce(F.bool_or(good & (F.col("source") == "ocr_fallback")), F.lit(False)).alias("ocr"), F.coalesce(F.bool_or(F.col("source") == "ocr_fallback"), F.lit(False)).alias("ocr_used"),
    )
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    hit = lambda k: share(F.coalesce(F.col("first") <= k, F.lit(False)))
    entity = F.col("query_type") == "entity"
    of_entities = lambda c: F.coalesce(F.avg(F.when(entity, F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0))), F.lit(0.0))
    violations = lambda c: F.sum(c) / F.greatest(F.sum("relevant"), F.lit(1))
    return per.rollup("query_type").agg(
        F.count("*").alias("queries"), hit(1).alias("hit_at_1"), hit(3).alias("hit_at_3"), hit(5).alias("hit_at_5"), F.avg(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))).alias("mrr"), share(F.col("n") > F.col("d")).alias("duplicate_rate"),
        of_entities(F.col("hub") != F.col("expected_entity")).alias("false_entity_rate"), of_entities(F.col("hub").isNull()).alias("entity_miss_rate"), of_entities((F.col("top") == F.col("expected_entity")) & (F.col("more") == F.col("more_d"))).alias("hub_first_rate"),
        violations("bad_category").alias("category_violation_rate"), violations("bad_source").alias("source_violation_rate"), share(F.col("fts")).alias("fts_hit_rate"), share(F.col("ocr")).alias("ocr_hit_rate"), share(F.col("ocr_used")).alias("ocr_usage_rate"), F.count_if(F.col("ocr") & ~F.col("fts")).alias("only_by_ocr"),
    )


def source_counts(hits: DataFrame, top: int = 5) -> DataFrame:
    return hits.where(F.col("rank") <= top).groupBy("source").agg(F.count("*").alias("hits"))


def gate(report: DataFrame) -> DataFrame:
    """measure, value, bound, passed of each bound on the overall row of a retrieval report."""
    names = [*AT_LEAST, *AT_MOST]
    bounds = F.create_map(*[F.lit(x) for kv in (AT_LEAST | AT_MOST).items() for x in kv])
    rows = report.where("query_type is null").select(*names).unpivot([], names, "measure", "value").withColumn("bound", bounds[F.col("measure")])
    return rows.withColumn("passed", F.when(F.col("measure").isin(*AT_LEAST), F.col("value") >= F.col("bound")).otherwise(F.col("value") <= F.col("bound")))


def incomplete(docs: DataFrame) -> DataFrame:
    """docs with error STRUCTURAL_INCOMPLETE where a required field is null, empty or UNKNOWN."""
    gone = F.lit(False)
    for name in REQUIRED:
        v = F.col(name).cast("string")
        gone = gone | v.isNull() | v.isin("", "UNKNOWN")
    return docs.withColumn("error", F.when(gone, "STRUCTURAL_INCOMPLETE"))


def cache_counts(pages: DataFrame, cached: DataFrame) -> DataFrame:
    """md5, pages, cache_hits and cache_misses of each document: cached pages by content hash, misses never below zero."""
    n = pages.groupBy("md5").agg(F.count("*").alias("pages"))
    hits = cached.groupBy("md5").agg(F.count("*").alias("cache_hits"))
    return n.join(hits, "md5", "left").withColumn("cache_hits", F.coalesce("cache_hits", F.lit(0))).withColumn("cache_misses", F.greatest(F.col("pages") - F.col("cache_hits"), F.lit(0)))


def _share(good: Column, total: Column) -> Column:
    return good / F.nullif(total, F.lit(0))


def compare_boundaries(expected: DataFrame, found: DataFrame, source: str) -> DataFrame:
    """For each source: precision and recall of exact (start_page, end_page) ranges, share of the starts and of the ends
    that were found, and of the pages that lie in equal ranges.  Ranges of a source do not overlap."""
    key = [source, "start_page", "end_page"]
    e, f = expected.select(*key).distinct(), found.select(*key).distinct()
    both = lambda on: e.select(*on).distinct().withColumn("_e", F.lit(1)).join(f.select(*on).distinct().withColumn("_f", F.lit(1)), on, "full")
    count = lambda rows, name: rows.groupBy(source).agg(F.count("_e").alias(f"_{name}_e"), F.count("_f").alias(f"_{name}_f"), F.count_if(F.col("_e").isNotNull() & F.col("_f").isNotNull()).alias(f"_{name}"))
    pages = both(key).where("_e is not null").groupBy(source).agg(F.sum(F.col("end_page") - F.col("start_page") + 1).alias("_pages"), F.coalesce(F.sum(F.when(F.col("_f").isNotNull(), F.col("end_page") - F.col("start_page") + 1)), F.lit(0)).alias("_right"))
    j = count(both(key), "x").join(count(both([source, "start_page"]), "s"), source).join(count(both([source, "end_page"]), "t"), source).join(pages, source, "left")
    zero = lambda a, b: F.coalesce(_share(F.col(a), F.col(b)), F.lit(0.0))
    return j.select(source, zero("_x", "_x_f").alias("exact_precision"), zero("_x", "_x_e").alias("exact_recall"), zero("_s", "_s_e").alias("start_page_accuracy"), zero("_t", "_t_e").alias("end_page_accuracy"), zero("_right", "_pages").alias("page_assignment_accuracy"))


def median(rows: DataFrame, value: str, name: str, times: str | None = None) -> DataFrame:
    """One row with the exact median of a column, null without values; ``times`` says how often a row's value counts.

    Equal values are counted, the counts dealt by ranges, and only the range that holds the middle is put in order, so
    no task holds all values.
    """
    c = F.col
    counted = rows.where(c(value).isNotNull()).groupBy(c(value).alias("_v")).agg((F.sum(times) if times else F.count("*")).alias("_n"))
    ranges = materialize(counted.repartitionByRange("_v").withColumn("_p", F.spark_partition_id()), "median")
    sums = ranges.groupBy("_p").agg(F.sum("_n").alias("_m"))  # a row for each range
    ends = sums.withColumns({"_to": F.sum("_m").over(Window.orderBy("_p")), "_all": F.sum("_m").over(Window.partitionBy(F.lit(0)))})
    low, high = F.floor((c("_all") - 1) / 2), F.floor(c("_all") / 2)
    middle = ends.where((c("_to") > low) & (c("_to") - c("_m") <= high)).withColumn("_before", c("_to") - c("_m")).drop("_m", "_to")
    place = c("_before") + F.sum("_n").over(Window.partitionBy("_p").orderBy("_v"))
    at = ranges.join(F.broadcast(middle), "_p").withColumn("_end", place)
    holds = lambda k: F.max(F.when((c("_end") > k) & (c("_end") - c("_n") <= k), c("_v")))
    two = at.agg(holds(low).alias("_a"), holds(high).alias("_b"))
    return two.select(F.when(c("_a") == c("_b"), c("_a")).otherwise(c("_a") * 0.5 + c("_b") * 0.5).alias(name))


#: What the files of a batch add to the report: ranges and pages, then documents, then fields.
_FIELDS = ("net", "tax", "gross", "supplier", "kind", "number")
_SUMS = ("exact", "same_start_page", "same_end_page", "pages", "right_pages", "wanted", "detected", "docs", "manual", "called", "compared", "whole", *[f"{k}_{f}" for f in _FIELDS for k in ("has", "ok")])


def _held_against(files: DataFrame) -> DataFrame:
    """_e, _n, _calls and _SUMS: sums over some files in a row without _e, and rows of how often (_n) an error _e occurs.

    files: _known (whether it has a file), _run (whether it was run) and the sorted lists _x (expected), _b (bounds), _d (docs).
    """

    def flat(column):
        """The rows of a batch's lists as columns, with the row of the batch that each is of."""
        import pyarrow.compute as pc

        size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        items = column.flatten()
        return np.repeat(np.arange(len(size)), size), {f.name: items.field(k) for k, f in enumerate(items.type)}

    def number(column):
        """Values, and which of them are there."""
        return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)

    def pages(r, a, z, place):
        """The first place (row of the batch, page) of the ranges a to z, which are in order."""
        import pandas as pd

        size = np.abs(z - a) + 1
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        rows = pd.DataFrame({"r": np.repeat(r, size), "p": np.repeat(a, size) + np.repeat(np.where(z < a, -1, 1), size) * step, "at": np.repeat(place, size)})
        return rows.drop_duplicates(["r", "p"])

    def places(r):
        """The place of each row among those of its file, which follow each other."""
        return np.arange(len(r)) - np.searchsorted(r, r)

    def measured(batch):
        import pandas as pd
        import pyarrow as pa
        import pyarrow.compute as pc

        known, run = (batch.column(k).to_numpy(zero_copy_only=False).astype(bool) for k in (0, 1))
        (xr, x), (br, b), (dr, d) = (flat(batch.column(k)) for k in (2, 3, 4))
        out = dict.fromkeys(_SUMS, 0) | {"wanted": len(xr), "detected": len(br), "docs": len(dr)}
        out["manual"], out["called"] = int(d["manual"].to_numpy(zero_copy_only=False).sum()), len(dr) - d["calls"].null_count
        (xs, xs_is), (xz, xz_is), (bs, bs_is), (bz, bz_is) = (number(y[k]) for y in (x, b) for k in ("start_page", "end_page"))
        whole = xs_is & xz_is & known[xr]
        frame = pd.DataFrame({"r": xr, "s": xs, "z": xz})
        found = pd.DataFrame({"r": br, "s": bs, "z": bz})
        both = lambda key, mask: frame[whole].groupby(["r", *key]).size().rename("n").reset_index().merge(found[mask].groupby(["r", *key]).size().rename("m").reset_index(), on=["r", *key])
        out["exact"] = int(both(["s", "z"], bs_is & bz_is)["m"].sum())
        for key, name, mask in (("s", "same_start_page", bs_is), ("z", "same_end_page", bz_is)):
            met = both([key], mask)
            out[name] = int((met["n"] * met["m"]).sum())
        held = whole & run[xr]
        last = np.maximum(xs, xz)[held]
        out["pages"] = int(pd.Series(last).groupby(xr[held]).max().sum())
        mine = bs_is & bz_is & known[br]
        met = pages(xr[held], xs[held], xz[held], places(xr[held])).merge(pages(br[mine], bs[mine], bz[mine], places(br)[mine]), on=["r", "p"])
        out["right_pages"] = int((met["at_x"] == met["at_y"]).sum())
        # the first expected row of a document's start page: those without a position have no values
        ranked = x["ranked"].to_numpy(zero_copy_only=False).astype(bool)
        first = frame[xs_is & known[xr]].assign(i=np.nonzero(xs_is & known[xr])[0])
        first = first.assign(none=~ranked[first["i"]]).sort_values("none", kind="stable").drop_duplicates(["r", "s"])[["r", "s", "i", "none"]]
        ds, ds_is = number(d["start_page"])
        j = pd.DataFrame({"r": dr, "s": ds, "k": np.arange(len(dr))})[ds_is & known[dr]].merge(first, on=["r", "s"])
        at, of = pa.array(j["k"].to_numpy(np.int64)), pa.array(j["i"].to_numpy(np.int64), mask=j["none"].to_numpy(bool))
        good, errors = np.ones(len(j), bool), []
        out["compared"] = len(j)
        for f in _FIELDS:
            want, got = x[f].take(of), d[f].take(at)
            has = want.is_valid().to_numpy(zero_copy_only=False)
            if pa.types.is_string(want.type):
                ok = pc.fill_null(pc.equal(want, got), False).to_numpy(zero_copy_only=False)
            else:
                (w, _), (g, g_is) = number(want), number(got)
                error = np.abs(g - w)
                errors.append(error[has & g_is])
                ok = has & g_is & (error <= AMOUNT_TOLERANCE)
                good &= ok | ~has
            out[f"has_{f}"], out[f"ok_{f}"] = int(has.sum()), int(ok.sum())
        out["whole"] = int(good.sum())
        value, times = np.unique(np.concatenate(errors), return_counts=True)
        calls = pc.sum(d["calls"]).as_py() or 0.0
        n = len(value)
        rows = {"_e": pa.array([None, *value], pa.float64()), "_n": pa.array([0, *times], pa.int64()), "_calls": pa.array([calls, *[0.0] * n], pa.float64())}
        return pa.RecordBatch.from_pydict(rows | {k: pa.array([v, *[0] * n], pa.int64()) for k, v in out.items()})

    return files.mapInArrow(lambda batches: (measured(x) for x in batches if x.num_rows), "_e double, _n long, _calls double, " + ", ".join(f"{k} long" for k in _SUMS))


def extraction_report(expected: DataFrame, bounds: DataFrame, docs: DataFrame, runs: DataFrame) -> DataFrame:
    """One row of measures of an extraction.

    expected: file, pos, start_page, end_page, net, tax, gross, supplier, kind, number.  bounds: file, pos, start_page,
    end_page as detected.  docs: file, start_page, error, confidence, llm_calls, and the fields of expected as extracted.
    runs: file, seconds, cache_hits, cache_misses.  A document is held against the first expected one of its file and
    start page; a page is right if the first range that holds it has the same place among its file's ranges on both sides.

    All rows of a file are brought together once (inputs that are dealt by file already are not dealt again) and everything
    is measured where they lie; an Arrow map does it for some files at a time, since a file's rows meet each other in
    six ways.  What is left are sums and counts of equal errors.
    """
    c = F.col
    low = lambda k: F.lower(F.nullif(c(k), F.lit("")))
    texts = ("supplier", "kind", "number")
    fields = lambda text: [text(k).alias(k) if k in texts else c(k).cast("double").alias(k) for k in _FIELDS]
    page = lambda k: c(k).cast("long").alias(k)
    manual = (F.coalesce("error", F.lit("")) != "") | (F.coalesce("confidence", F.lit(1.0)) < SURE)
    parts = {
        "_x": expected.select("file", F.struct("pos", page("start_page"), page("end_page"), c("pos").isNotNull().alias("ranked"), *fields(low)).alias("_x")),
        "_b": bounds.select("file", F.struct("pos", page("start_page"), page("end_page")).alias("_b")),
        "_d": docs.select("file", F.struct(page("start_page"), manual.alias("manual"), c("llm_calls").cast("double").alias("calls"), *fields(lambda k: F.lower(F.coalesce(c(k), F.lit(""))))).alias("_d")),
        "_r": runs.select("file").distinct().select("file", F.lit(True).alias("_r")),
    }
    kinds = {k: rows.schema[k].dataType for k, rows in parts.items()}
    every = reduce(DataFrame.unionByName, [rows.select("file", *[c(k) if k == name else F.lit(None).cast(t).alias(k) for k, t in kinds.items()]) for name, rows in parts.items()])
    files = every.groupBy("file").agg(F.max("_r").alias("_run"), *[F.sort_array(F.collect_list(k)).alias(k) for k in ("_x", "_b")], F.collect_list("_d").alias("_d"))
    bare = lambda k: F.transform(k, lambda s: s.dropFields("pos")).alias(k)
    sums = _held_against(files.select(c("file").isNotNull().alias("_known"), F.coalesce("_run", F.lit(False)).alias("_run"), bare("_x"), bare("_b"), "_d"))
    # a row for each error that occurs, and one without: they are read three times
    sums = materialize(sums.groupBy("_e").agg(*[F.sum(k).alias(k) for k in ("_n", "_calls", *_SUMS)]), "errors")
    one = sums.where("_e is null").agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("_calls", *_SUMS)])
    each = sums.where("_e is not null")
    errors = each.agg((F.sum(c("_e") * c("_n")) / F.sum("_n")).alias("mean_absolute_error")).join(median(each, "_e", "median_absolute_error", "_n"))
    n = runs.agg((F.sum("cache_hits") / F.nullif(F.sum("cache_hits") + F.sum("cache_misses"), F.lit(0))).alias("cache_hit_rate"), (F.sum("seconds") / F.nullif(F.sum("cache_hits") + F.sum("cache_misses"), F.lit(0))).alias("avg_seconds_per_page"))
    one = one.join(errors).join(n)  # each side is one row
    names = {"net": "net_amount_accuracy", "tax": "tax_amount_accuracy", "gross": "gross_amount_accuracy", "supplier": "supplier_hit_rate", "kind": "document_type_hit_rate", "number": "invoice_number_hit_rate"}
    share = lambda a, b, k: _share(c(a), c(b)).alias(k)
    done = {"exact_boundary_precision": ("exact", "detected"), "exact_boundary_recall": ("exact", "wanted"), "start_page_accuracy": ("same_start_page", "wanted"), "end_page_accuracy": ("same_end_page", "wanted"), "page_assignment_accuracy": ("right_pages", "pages")}
    field = {k: share(f"ok_{k}", f"has_{k}", n) for k, n in names.items()}
    return one.select(
        *[share(a, b, k) for k, (a, b) in done.items()], *[field[k] for k in ("net", "tax", "gross")], share("whole", "compared", "amount_all_correct_rate"), *[field[k] for k in texts], "mean_absolute_error", "median_absolute_error",
        share("manual", "docs", "manual_check_share"), F.when(c("called") == c("docs"), _share(c("_calls"), c("docs"))).alias("llm_calls_per_document"), "cache_hit_rate", "avg_seconds_per_page",
    )


def markdown(report: DataFrame, title: str) -> DataFrame:
    """The lines of a report's rows: a heading, then each measure, four places after the point; null is not_available."""
    value = lambda n, t: F.coalesce(F.format_string("%.4f", F.col(n)) if t == "double" else F.col(n).cast("string"), F.lit("not_available"))
    lines = [F.concat(F.lit(f"- **{n}**: "), value(n, t)) for n, t in report.dtypes]
    return report.select(F.concat(F.lit(f"# {title}\n\n"), F.concat_ws("\n", *lines)).alias("value"))
