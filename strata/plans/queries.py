"""Driver queries: every operator over the driver's tables, on the analogues that the README lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import text as T
from strata.operators import blocks, changes, coverage, families, findings, metrics, similarity
from strata.operators.meetings import meetings
from strata.policy import NearClone, Policy, Suppression
from strata.session import cut, dealt, only, table
from strata.sources.units import document_units, stored_units

LOOSE = NearClone(minimum_sloc=1, minimum_tokens=20, max_candidates=64)
#: Blocks of 24 words and more: documents are shorter than functions are long.
BLOCKS = NearClone(minimum_sloc=1, minimum_tokens=8, block_minimum_tokens=24)
EXCEPTIONS = (
    Suppression("function-mass", "src0", "reviewed", None),
    Suppression("near-clone", "src1", "reviewed", 1),
    Suppression("near-clone", "src2", "reviewed", 2),
)


def r6(c: Column) -> Column:
    return F.round(c, 6)


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return dealt(table(spark, sf, "documents"), "doc_id")


def units(spark: SparkSession, sf: str, *columns: str, roles: bool = False) -> DataFrame:
    return stored_units(docs(spark, sf), table(spark, sf, "labels") if roles else None, columns)


def tokens(df: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and ``t``, the words of each text."""
    return df.select(*keep, T.words(F.col("text")).alias("t"))


# --- tokens and shingles


def shingle_sets(spark: SparkSession, sf: str) -> DataFrame:
    d = tokens(docs(spark, sf), "doc_id").select("doc_id", F.size("t").alias("n_tokens"), T.windows(F.col("t")).alias("s"))
    return d.select("doc_id", "n_tokens", F.size("s").alias("n_shingles"), F.size(F.array_distinct("s")).alias("n_distinct"))


def shingle_postings(spark: SparkSession, sf: str) -> DataFrame:
    d = tokens(docs(spark, sf), "lang").select("lang", F.explode(F.array_distinct(T.windows(F.col("t")))).alias("shingle"))
    return d.groupBy("lang", "shingle").agg(F.count("*").alias("n_docs")).where("n_docs >= 3")


def shingle_overlap(spark: SparkSession, sf: str) -> DataFrame:
    found = meetings(document_units(docs(spark, sf)), asks=F.lit(5))
    return found.select(F.col("q").alias("doc_id"), F.col("c").alias("other_id"), "overlap")


def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).select("doc_id", "lang", F.sha2(F.array_join(T.words(F.col("text")), " "), 256).alias("h"))
    g = d.groupBy("lang", "h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_copies")).where("n_copies > 1")
    return g.select("lang", F.col("h").alias("digest"), "first_id", "n_copies")


def renamed_clone(spark: SparkSession, sf: str) -> DataFrame:
    leaf = lambda w: F.when(w.rlike("^[0-9\"'`]"), "LIT").when(w.rlike("[0-9]"), "ID").otherwise(w)
    d = docs(spark, sf).select("doc_id", "lang", F.sha2(F.array_join(F.transform(T.words(F.col("text")), leaf), " "), 256).alias("digest"))
    return d.groupBy("lang", "digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_docs")).where("n_docs > 1")


def stream_digests(spark: SparkSession, sf: str) -> DataFrame:
    words = T.words(F.col("text"))
    return docs(spark, sf).select("doc_id", F.sha2(F.array_join(words, " "), 256).alias("token_digest"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_digest"))


def line_runs(spark: SparkSession, sf: str) -> DataFrame:
    sizes = F.transform(T.words(F.col("text")), lambda w: F.least(F.length(w), F.lit(9)))
    d = docs(spark, sf).select("doc_id", sizes.alias("v")).withColumn("runs", T.run_lengths(F.col("v")))
    pairs = F.array_join(F.transform("runs", lambda r: F.concat_ws(":", r["n"].cast("string"), r["value"].cast("string"))), ",")
    same = T.from_run_lengths(F.col("runs")) == F.col("v")
    return d.select("doc_id", F.size("runs").alias("n_runs"), F.md5(pairs).alias("digest"), same.alias("decodes"))


def hex_codec(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    text = T.hex_sequence(F.col("keys"))
    o = o.withColumn("hex_text", text)
    return o.select("o_custkey", "hex_text", (T.from_hex_sequence(F.col("hex_text")) == F.col("keys")).alias("decodes"))


# --- near clones


def near_clone_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pairs = similarity.similar_pairs(similarity.rare_first(document_units(docs(spark, sf))), 0.85)
    return pairs.select(F.col("q").alias("doc_id"), F.col("c").alias("other_id"), "overlap", r6(F.col("jaccard")).alias("jaccard"))


def near_clone_topk(spark: SparkSession, sf: str) -> DataFrame:
    top = meetings(document_units(docs(spark, sf)), 64)
    return top.select(F.col("q").alias("doc_id"), F.col("c").alias("other_id"), "overlap", F.col("rn").alias("place"))


def _best(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.best_whole_matches(document_units(docs(spark, sf), table(spark, sf, "labels")), LOOSE)


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return cut(similarity.best_whole_matches(document_units(docs(spark, sf)), LOOSE).select("q", "c"))


def near_clone_best(spark: SparkSession, sf: str) -> DataFrame:
    return _best(spark, sf).select(
        F.col("q").alias("doc_id"),
        F.col("c").alias("other_id"),
        r6(F.col("token_similarity")).alias("token_similarity"),
        r6(F.col("ast_similarity")).alias("shape_similarity"),
        r6(F.col("similarity")).alias("similarity"),
        similarity.risk(F.col("q_role"), F.col("c_role")).alias("risk"),
        (F.col("q_path") == F.col("c_path")).alias("same_source"),
    )


def block_longest_run(spark: SparkSession, sf: str) -> DataFrame:
    sized = F.when(F.col("token_count") >= 2 * BLOCKS.block_tokens, 1)
    runs = meetings(document_units(docs(spark, sf)), BLOCKS.block_max_candidates, sized, sized, BLOCKS.block_run)
    return runs.select(F.col("q").alias("doc_id"), F.col("c").alias("other_id"), "start", "length")


def block_matches(spark: SparkSession, sf: str) -> DataFrame:
    found = blocks.block_matches(document_units(docs(spark, sf)), BLOCKS)
    return found.select(
        F.col("q").alias("doc_id"), F.col("c").alias("other_id"), "left_start", "left_length", "right_start", "right_length", "ast_length", "island"
    )


def clone_families(spark: SparkSession, sf: str) -> DataFrame:
    return families.clone_families(_edges(spark, sf), docs(spark, sf).select(F.col("doc_id").alias("pos"))).select(F.col("pos").alias("doc_id"), "family")


def family_summary(spark: SparkSession, sf: str) -> DataFrame:
    u = document_units(docs(spark, sf), table(spark, sf, "labels"), streams=False)
    s = families.family_summary(families.clone_families(_edges(spark, sf), u), u)
    return s.select(
        "family", "members", r6(F.col("family_mass")).alias("family_mass"), r6(F.col("largest_mass")).alias("largest_mass"),
        r6(F.col("recoverable_mass")).alias("recoverable_mass"), "roles", "risk", "path", "base_path",
    )


def contamination_containment(spark: SparkSession, sf: str) -> DataFrame:
    b = tokens(table(spark, sf, "benchmark"), "item_id").select("item_id", F.array_distinct(T.windows(F.col("t"))).alias("s"))
    left = b.select("item_id", F.size("s").alias("n"), F.explode("s").alias("shingle"))
    right = tokens(docs(spark, sf), "doc_id").select("doc_id", F.explode(F.array_distinct(T.windows(F.col("t")))).alias("shingle"))
    pairs = left.join(right, "shingle").groupBy("item_id", "doc_id").agg(F.count("*").alias("overlap"), F.max("n").alias("n"))
    return pairs.withColumn("containment", r6(F.col("overlap") / F.col("n"))).where("containment >= 0.5").select("item_id", "doc_id", "overlap", "containment")


def page_tag_stream(spark: SparkSession, sf: str) -> DataFrame:
    tags = F.regexp_extract_all(F.lower("html"), F.lit(r"<(/?[a-z][a-z0-9]*)"), F.lit(1))
    p = table(spark, sf, "pages").select("page_id", tags.alias("t"))
    opened = F.size(F.filter("t", lambda x: ~F.startswith(x, F.lit("/"))))
    return p.select("page_id", F.size("t").alias("n_tags"), opened.alias("n_nodes"), F.md5(F.array_join("t", " ")).alias("digest"))


def page_structure_clones(spark: SparkSession, sf: str) -> DataFrame:
    p = page_tag_stream(spark, sf)
    return p.groupBy("digest").agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"), F.max("n_nodes").alias("n_nodes")).where("n_pages > 1")


# --- mass, erosion, history


def unit_mass(spark: SparkSession, sf: str) -> DataFrame:
    u = document_units(docs(spark, sf), streams=False)
    return u.select(F.col("pos").alias("doc_id"), "sloc", "cc", r6(F.col("mass")).alias("mass"))


def mass_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = metrics.summaries(document_units(docs(spark, sf), streams=False), metrics.CUTOFFS, ["language"])
    return s.select(
        "language", "cutoff", r6(F.col("total_mass")).alias("total_mass"), r6(F.col("high_mass")).alias("high_mass"), "high_count", "max_cc",
        r6(F.col("max_mass")).alias("max_mass"), r6(F.col("erosion_ratio")).alias("erosion_ratio"),
    )


def top_contributors(spark: SparkSession, sf: str) -> DataFrame:
    t = metrics.top_contributors(document_units(docs(spark, sf), streams=False), 10, ["language"])
    return t.select("language", "rank", "path", F.col("qualified_name").alias("name"), "cc", r6(F.col("mass")).alias("mass"))


def _customer_months(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a history: revisions are months, units customers, cc their line items, sloc their orders."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    l = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("items"))  # noqa: E741
    g = o.join(l, "o_orderkey").groupBy("month", "o_custkey").agg(F.count("*").cast("int").alias("sloc"), F.sum("items").cast("int").alias("cc"))
    return g.withColumn("mass", T.mass(F.col("cc"), F.col("sloc")))


def _months(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.summaries(_customer_months(spark, sf), (3, 5, 8), ["month"])


def erosion_by_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    m = _months(spark, sf)
    return m.select("month", "cutoff", r6(F.col("total_mass")).alias("total_mass"), r6(F.col("high_mass")).alias("high_mass"), "high_count", r6(F.col("erosion_ratio")).alias("erosion_ratio"))


def erosion_history(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics.adjacent(_months(spark, sf), "month", ["cutoff"], "erosion_ratio", "delta")
    wide = m.groupBy("month").pivot("cutoff", [3, 5, 8]).agg(r6(F.max("erosion_ratio")).alias("ratio"), r6(F.max("delta")).alias("delta"))
    return wide


def delta_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics.adjacent(_months(spark, sf), "month", ["cutoff"], "erosion_ratio", "delta")
    q = metrics.floor_quantiles(m, "delta", {"p0": 0.0, "p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p100": 1.0}, ["cutoff"])
    return q.select("cutoff", "n", *[r6(F.col(c)).alias(c) for c in ("p0", "p50", "p90", "p95", "p99", "p100")])


def erosion_breaches(spark: SparkSession, sf: str) -> DataFrame:
    m = _months(spark, sf).withColumn("year", F.substring("month", 1, 4).cast("int")).withColumn("m", F.substring("month", 6, 2))
    head, base = m.withColumn("prior", F.col("year") - 1), m.withColumn("prior", F.col("year"))
    e = metrics.erosion_delta(base, head, ["prior", "m", "cutoff"])
    return e.select(F.col("prior").alias("base_year"), F.col("m").alias("month"), "cutoff", r6(F.col("delta")).alias("delta"), r6(F.col("growth")).alias("growth"), "breaches")


def history_rollup(spark: SparkSession, sf: str) -> DataFrame:
    u = _customer_months(spark, sf).withColumn("year", F.substring("month", 1, 4))
    r = u.rollup("year", "month").agg(F.sum("mass").alias("total_mass"), F.max("cc").alias("max_cc"), F.count("*").alias("n_units"))
    return r.select("year", "month", r6(F.col("total_mass")).alias("total_mass"), "max_cc", "n_units")


# --- revisions


def _customer_year(spark: SparkSession, sf: str, year: int) -> DataFrame:
    m = _customer_months(spark, sf).where(F.substring("month", 1, 4) == str(year))
    g = m.groupBy("o_custkey").agg(F.sum("sloc").cast("int").alias("sloc"), F.sum("cc").cast("int").alias("cc"))
    return g.withColumn("mass", T.mass(F.col("cc"), F.col("sloc")))


def mass_delta(spark: SparkSession, sf: str) -> DataFrame:
    head = _customer_year(spark, sf, 1997)
    base = _customer_year(spark, sf, 1996).select("o_custkey", F.col("mass").alias("base_mass"))
    rows = head.join(base, "o_custkey", "left").withColumn("delta", F.col("mass") - F.col("base_mass"))
    kind = F.when(F.col("base_mass").isNull() & (F.col("mass") > 10), "new").when(F.col("delta") > 5, "grown")
    return rows.withColumn("kind", kind).where("kind is not null").select(
        "o_custkey", "kind", r6(F.col("mass")).alias("head_mass"), r6(F.col("base_mass")).alias("base_mass"), r6(F.col("delta")).alias("delta")
    )


def entry_diff(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(
        F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("o_orderpriority")), ",")).alias("h")
    )
    return changes.entry_diff(o.where("y = 1996"), o.where("y = 1997"), "o_custkey", ["n", "h"])


def _features(spark: SparkSession, sf: str, year: int) -> DataFrame:
    l = table(spark, sf, "lineitem").where(F.year("l_shipdate") == year)  # noqa: E741
    return l.groupBy("l_suppkey").agg(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")))).alias("features"))


def feature_expansion(spark: SparkSession, sf: str) -> DataFrame:
    g = changes.feature_growth(_features(spark, sf, 1997), _features(spark, sf, 1996), ["l_suppkey"], "features")
    return g.select("l_suppkey", "change", F.array_join("added", ",").alias("added"))


def set_broadened(spark: SparkSession, sf: str) -> DataFrame:
    def priorities(year: int) -> DataFrame:
        o = table(spark, sf, "orders").where(F.year("o_orderdate") == year)
        return o.groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("items"))

    b = changes.broadened(priorities(1997), priorities(1996), ["o_custkey"], "items")
    return b.select("o_custkey", F.array_join("items", ",").alias("items"), "broadened")


def bag_difference(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_suppkey", F.year("l_shipdate").alias("y"))  # noqa: E741
    left = changes.bag_difference(
        l.where("y = 1997"), l.where("y = 1996"), ["l_returnflag", "l_linestatus", "l_quantity"], ["l_returnflag", "l_suppkey"], ["l_orderkey", "l_linenumber"]
    )
    return left.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_suppkey")


def interval_contains(spark: SparkSession, sf: str) -> DataFrame:
    ranges = table(spark, sf, "events").groupBy("user_id").agg(F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))
    ranges = ranges.withColumn("bucket", F.pmod("user_id", F.lit(7)))
    lines = table(spark, sf, "events").where("event_type = 'purchase' and value > 90").select(F.pmod("user_id", F.lit(7)).alias("bucket"), "event_id")
    return changes.touched(ranges, lines, "bucket", "first_id", "last_id", "event_id").select("user_id", "first_id", "last_id")


def lcs_added_lines(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _edges(spark, sf)
    lines = only(docs(spark, sf).select("doc_id", T.line_hashes(F.col("text")).alias("h")), pairs.select("q").unionAll(pairs.select("c")), "doc_id")
    both = pairs.join(lines.select(F.col("doc_id").alias("q"), F.col("h").alias("head")), "q")
    both = both.join(lines.select(F.col("doc_id").alias("c"), F.col("h").alias("base")), "c")
    return changes.added_lines(both, "q", "base", "head").select(F.col("q").alias("doc_id"), "line", "status")


# --- findings


def _emitted(spark: SparkSession, sf: str) -> DataFrame:
    u = document_units(docs(spark, sf), table(spark, sf, "labels"), streams=False)
    heavy = findings.shaped(
        u.where("mass > 80"),
        emit_seq=F.col("pos"),
        rule_id=F.lit("function-mass"),
        severity=F.lit("error"),
        message=F.format_string("new function mass %.2f exceeds limit %.2f", "mass", F.lit(80.0)),
        path=F.col("path"),
        line=F.col("start_line"),
        head_mass=F.col("mass"),
        threshold=F.lit(80.0),
        properties=findings.properties(qualified_name=F.col("qualified_name")),
    )
    lonely = findings.shaped(
        u.where("role <> 'general'"),
        emit_seq=F.col("pos") + 1_000_000_000,
        rule_id=F.lit("near-clone"),
        severity=F.lit("warning"),
        message=F.format_string("unit with role %s", "role"),
        path=F.col("path"),
        line=F.col("start_line"),
        base_path=F.when(F.col("sloc") > 3, F.col("language")),
        properties=findings.properties(qualified_name=F.col("qualified_name"), clone_scope=F.lit("block")),
    )
    return heavy.unionByName(lonely)


def severity_policy(spark: SparkSession, sf: str) -> DataFrame:
    kept = findings.apply_severity(_emitted(spark, sf), {"function-mass": "warn", "near-clone": "off"})
    return kept.select(F.col("emit_seq"), "rule_id", "severity", "message")


def suppressed_findings(spark: SparkSession, sf: str) -> DataFrame:
    kept = findings.unsuppressed(_emitted(spark, sf), findings.suppression_rows(spark, EXCEPTIONS))
    return kept.groupBy("rule_id", "path").agg(F.count("*").alias("n_findings"))


def findings_union_sorted(spark: SparkSession, sf: str) -> DataFrame:
    policy = Policy(suppressions=EXCEPTIONS)
    return findings.governed(_emitted(spark, sf), policy).select("path", "line", "rule_id", "base_path", "emit_seq", "severity", "message")


def finding_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return findings.with_fingerprint(_emitted(spark, sf)).select("emit_seq", "fingerprint")


def sarif_json(spark: SparkSession, sf: str) -> DataFrame:
    return findings.sarif_results(_emitted(spark, sf))


def rule_coverage_matrix(spark: SparkSession, sf: str) -> DataFrame:
    suffix = F.when(F.col("doc_id") % 4 == 0, ".rs").when(F.col("doc_id") % 4 == 1, ".py").when(F.col("doc_id") % 4 == 2, "/Cargo.toml").otherwise(".txt")
    files = docs(spark, sf).select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), suffix).alias("path"),
        F.when(F.col("n_chars") > 200, "analyzed").otherwise("failed").alias("status"),
        F.when(F.col("n_chars") > 200, "").otherwise("too short").alias("detail"),
    )
    return coverage.rule_coverage(files, {**Policy().severities(), "unsafe-surface-growth": "off"})


def budget_prefix(spark: SparkSession, sf: str) -> DataFrame:
    rows = docs(spark, sf).select("doc_id", "source", "n_chars")
    kept = coverage.within_budget(rows, "doc_id", F.col("n_chars"), 40_000, 30, ["source"])
    return kept.select("doc_id", "source", "running_bytes", "file_index", "status", "detail")


def risk_label(spark: SparkSession, sf: str) -> DataFrame:
    u = document_units(docs(spark, sf), table(spark, sf, "labels"), streams=False)
    pairs = _followed(u.select("language", "pos", "role")).where("other is not null")
    return pairs.groupBy("language", "role", "other", similarity.risk(F.col("role"), F.col("other")).alias("risk")).agg(F.count("*").alias("n_pairs"))


def _followed(units: DataFrame, rows: int = 65_536) -> DataFrame:
    """``units`` with ``other``, the role of the next one in its language.

    Stretches of positions are ordered on their own; only each one's first role,
    a row for many, is ordered over the whole language.
    """
    from pyspark.sql.window import Window

    parts = units.withColumn("part", F.floor(F.col("pos") / rows))
    inside = F.lead("role").over(Window.partitionBy("language", "part").orderBy("pos"))
    firsts = parts.groupBy("language", "part").agg(F.min_by("role", "pos").alias("first"))
    after = firsts.select("language", "part", F.lead("first").over(Window.partitionBy("language").orderBy("part")).alias("after"))
    return parts.withColumn("inside", inside).join(after, ["language", "part"]).withColumn("other", F.coalesce("inside", "after"))


def role_classify(spark: SparkSession, sf: str) -> DataFrame:
    u = document_units(docs(spark, sf), table(spark, sf, "labels"), streams=False)
    return u.select(F.col("pos").alias("doc_id"), "role", F.col("role").isin("test", "accessor").alias("is_low_risk"))


def path_checks(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", F.regexp_replace("url", r"^[a-z]+://", "").alias("path"))
    return p.select("page_id", T.relative_path(F.col("path")).alias("is_relative"), T.locator(F.col("path")).alias("locator"))


def snapshot_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    entry = F.concat_ws("\x1f", F.col("doc_id").cast("string"), "lang", F.sha2(F.coalesce("text", F.lit("")), 256))
    d = docs(spark, sf).select("source", F.sha2(entry, 256).alias("h"))
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\x1e"), 256)
    parts = d.groupBy("source", F.substring("h", 1, 3).alias("part")).agg(F.count("*").alias("n"), F.concat("part", joined("h")).alias("h"))
    return parts.groupBy("source").agg(F.sum("n").alias("n_entries"), joined("h").alias("fingerprint"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        shingle_sets, shingle_postings, shingle_overlap, exact_duplicates, renamed_clone, stream_digests, line_runs, hex_codec,
        near_clone_pairs, near_clone_topk, near_clone_best, block_longest_run, block_matches, clone_families, family_summary,
        contamination_containment, page_tag_stream, page_structure_clones, unit_mass, mass_summary, top_contributors,
        erosion_by_cutoff, erosion_history, delta_quantiles, erosion_breaches, history_rollup, mass_delta, entry_diff,
        feature_expansion, set_broadened, bag_difference, interval_contains, lcs_added_lines, severity_policy,
        suppressed_findings, findings_union_sorted, finding_fingerprint, sarif_json, rule_coverage_matrix, budget_prefix,
        risk_label, role_classify, path_checks, snapshot_fingerprint,
    )
}
