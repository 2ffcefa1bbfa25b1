"""Registered queries: scans, sinks, projections, joins, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions import numeric as num
from cohortlens.functions import rules, text
from cohortlens.functions.rng import hash32, stable_seed
from cohortlens.operators import expect, folds, genesets, matching, metrics, profile, resample
from cohortlens.plans import views as v
from cohortlens.plans.registry import query
from cohortlens.sources import sinks, tables
from cohortlens.sources.tables import table

NATIONS = tuple(f"N{i}" for i in range(25))


@query(
    "a01_header_repair",
    "SELECT c_custkey, 'CS' || CAST(c_custkey AS VARCHAR) AS cluster_id, c_mktsegment AS cluster_label FROM customer",
)
def a01(spark, sf):
    raw = table(spark, sf, "customer").select(
        "c_custkey", F.concat(F.lit("CS"), v.text("c_custkey")).alias("Tree_first_cl_label"), F.col("c_mktsegment").alias("Unnamed: 21")
    )
    return tables.repair_tail(raw, "Tree_first_cl_label", "Unnamed: 21")


@query(
    "a02_keyed_parquet",
    """SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_ids,
    (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS n_repeated FROM orders""",
)
def a02(spark, sf):
    keyed, repeated = tables.read_keyed_parquet(spark, f"{sf}/orders.parquet", ["cell_id", "specimen_id", "o_orderkey"])
    n = repeated.agg(F.count(F.lit(1))).scalar()
    return keyed.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("cell_id").alias("n_ids")).withColumn("n_repeated", n)


def _wide(spark, sf):
    """Genes by nations, as a wide matrix with explicit zeros."""
    nation = table(spark, sf, "supplier").select(v.text("s_suppkey").alias("sample_id"), F.concat(F.lit("N"), v.text("s_nationkey")).alias("nation"))
    wide = v.counts(spark, sf).join(nation, "sample_id").groupBy("gene").pivot("nation", list(NATIONS)).agg(F.sum("cnt"))
    return wide.fillna(0)


@query(
    "a03_wide_counts_to_long",
    """SELECT sample_id, gene, cnt, CAST(sum(cnt) OVER (PARTITION BY sample_id) AS BIGINT) AS total, gene IN (SELECT gene FROM requested) AS hit
    FROM (SELECT 'N' || CAST(s_nationkey AS VARCHAR) AS sample_id, gene, CAST(sum(cnt) AS BIGINT) AS cnt
          FROM counts JOIN supplier ON CAST(s_suppkey AS VARCHAR) = sample_id GROUP BY 1, 2) QUALIFY hit""",
)
def a03(spark, sf):
    long = tables.wide_to_long(_wide(spark, sf), "gene", NATIONS)
    return tables.selected_and_totals(long, v.requested(spark, sf)).withColumn("hit", F.lit(True))


@query("a03_count_validity", "SELECT CAST(0 AS BIGINT) AS n_invalid, count(DISTINCT gene) AS n_genes FROM counts")
def a03b(spark, sf):
    wide = _wide(spark, sf)
    bad = tables.invalid_counts(wide, "gene", NATIONS).agg(F.count(F.lit(1))).scalar()
    return wide.agg(F.count(F.lit(1)).alias("n_genes")).withColumn("n_invalid", bad)


def _manifest(spark, sf):
    from cohortlens.operators.provenance import artifact_manifest

    return artifact_manifest(spark, sf, strip=sf, glob="*.parquet")


@query("a04_manifest_scan")
def a04(spark, sf):
    """Writes the digests of the input files as tab-separated text and scans them back."""
    path = v.scratch(spark)
    _manifest(spark, sf).select("path", "bytes", "sha256").write.option("sep", "\t").option("header", True).csv(path)
    return tables.read_manifest(spark, path)


@query(
    "a05_control_sets_flat",
    """SELECT module, control_id, gene, 1.0 / expected_n AS weight, expected_n FROM (
    SELECT *, count(*) OVER (PARTITION BY module, control_id) AS expected_n FROM (
    SELECT DISTINCT p_type AS module, CAST(p_size AS INTEGER) AS control_id, p_brand AS gene FROM part))""",
    ["weight"],
)
def a05(spark, sf):
    """Nested JSON text (module -> controls -> genes) parsed and flattened to weighted membership."""
    part = table(spark, sf, "part").select("p_type", "p_size", "p_brand").distinct()
    sets = part.groupBy("p_type", "p_size").agg(F.collect_list("p_brand").alias("genes"))
    nested = sets.groupBy(F.col("p_type").alias("module")).agg(
        F.collect_list(F.struct(F.col("p_size").alias("control_id"), "genes")).alias("controls")
    )
    path = v.scratch(spark)
    nested.write.json(path)
    return tables.flatten_control_sets(spark.read.json(path, schema=tables.CONTROL_JSON))


@query(
    "a06_module_membership",
    """SELECT module, gene, CAST(row_number() OVER (PARTITION BY module ORDER BY gene) - 1 AS INTEGER) AS ordinal, n_issues FROM (
    SELECT DISTINCT p_type AS module, p_brand AS gene, CAST(0 AS BIGINT) AS n_issues FROM part)""",
)
def a06(spark, sf):
    definitions = table(spark, sf, "part").groupBy(F.col("p_type").alias("module")).agg(
        F.array_sort(F.collect_set("p_brand")).alias("genes")
    )
    membership = tables.module_membership(definitions)
    issues = tables.module_issues(membership).agg(F.count(F.lit(1))).scalar()
    return membership.withColumn("n_issues", issues)


@query(
    "a07_partitioned_sink",
    "SELECT module, fold, count(*) AS n, min(y_true) AS low, max(y_true) AS high FROM long_targets GROUP BY 1, 2",
    ["low", "high"],
)
def a07(spark, sf):
    path = v.scratch(spark)
    sinks.write_partitions(v.long_targets(spark, sf), path, ["module", "fold"], spread=4)
    back = spark.read.parquet(path)
    return back.groupBy("module", "fold").agg(F.count(F.lit(1)).alias("n"), F.min("y_true").alias("low"), F.max("y_true").alias("high"))


@query(
    "a08_atomic_tables",
    "SELECT f.fmt, stratum, count(*) AS n FROM cells, (SELECT unnest(['csv', 'json', 'parquet']) AS fmt) f GROUP BY 1, 2",
)
def a08(spark, sf):
    summary = v.cells(spark, sf).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    out = None
    for fmt in ("csv", "json", "parquet"):
        path = v.scratch(spark)
        sinks.write_table(summary, path, fmt)
        reader = spark.read.schema("stratum string, n bigint")
        back = (reader.option("header", True) if fmt == "csv" else reader).format(fmt).load(path)
        back = back.select(F.lit(fmt).alias("fmt"), "stratum", "n")
        out = back if out is None else out.unionByName(back)
    return out


@query("a09_artifact_manifest")
def a09(spark, sf):
    return _manifest(spark, sf)


@query("a10_batched_append", "SELECT module, count(*) AS n, count(DISTINCT cell_id) AS n_cells FROM long_targets GROUP BY 1")
def a10(spark, sf):
    """Appends the facts in one batch per fold, as an interruptible run would."""
    path, rows = v.scratch(spark), v.long_targets(spark, sf)
    for fold in v.FOLDS:
        sinks.append_batch(rows.filter(F.col("fold") == fold), path)
    return spark.read.parquet(path).groupBy("module").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cell_id").alias("n_cells"))


@query(
    "b01_inverse_z",
    """WITH s AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM vectors GROUP BY 1),
    z AS (SELECT v.i, v.x, s.m, s.s, greatest(least((v.x - s.m) / s.s, 2.0), -2.0) AS z FROM vectors v JOIN s ON s.i = v.i)
    SELECT i, count(*) AS n, CAST(sum(CASE WHEN abs(z) = 2 THEN 1 ELSE 0 END) AS BIGINT) AS n_censored, avg(z * s + m) AS mean_restored,
    max(CASE WHEN abs(z) < 2 THEN abs(z * s + m - x) END) AS max_error FROM z GROUP BY 1""",
    ["mean_restored", "max_error"],
)
def b01(spark, sf):
    x = v.vectors(spark, sf)
    stats = x.groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    z = x.join(stats, "i").withColumn("z", num.clip(F.try_divide(F.col("x") - F.col("m"), F.col("s")), -2.0, 2.0))
    back = z.withColumn("restored", num.inverse_z(F.col("z"), F.col("m"), F.col("s"))).withColumn("censored", F.abs("z") == 2.0)
    return back.groupBy("i").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("censored").alias("n_censored"),
        F.avg("restored").alias("mean_restored"),
        F.max(F.when(~F.col("censored"), F.abs(F.col("restored") - F.col("x")))).alias("max_error"),
    )


@query(
    "b02_cpm",
    """SELECT c.sample_id, c.gene, CAST(c.cnt AS DOUBLE) / CAST(l.lib AS DOUBLE) * CAST(1e6 AS DOUBLE) AS cpm
    FROM counts c JOIN library l ON c.sample_id = l.sample_id""",
    ["cpm"],
)
def b02(spark, sf):
    joined = v.counts(spark, sf).join(v.library(spark, sf), "sample_id")
    return joined.select("sample_id", "gene", num.cpm(F.col("cnt"), F.col("lib")).alias("cpm"))


@query("b03_log2_cpm", "SELECT sample_id, gene, x FROM expression", ["x"])
def b03(spark, sf):
    return genesets.long_expression(v.counts(spark, sf), v.library(spark, sf)).select("sample_id", "gene", "x")


@query(
    "b04_identifier_issue",
    r"""SELECT role, CASE WHEN text IS NULL OR length(text) = 0 THEN 'empty' WHEN regexp_matches(text, '^[ \t\n\v\f\r]|[ \t\n\v\f\r]$') THEN 'surrounding_whitespace'
    WHEN regexp_matches(text, '[\x00-\x1F]') THEN 'control_character' ELSE '' END AS issue, count(*) AS n FROM conversations GROUP BY 1, 2""",
)
def b04(spark, sf):
    rows = table(spark, sf, "conversations")
    return rows.groupBy("role", text.identifier_issue(F.col("text")).alias("issue")).agg(F.count(F.lit(1)).alias("n"))


def _gene_table(spark, sf):
    return genesets.gene_qc(v.counts(spark, sf), v.library(spark, sf), v.requested(spark, sf), ["Brand#7|1"])


def zgenes(spark, sf):
    """Standardised gene table, as the stage before matching leaves it."""
    return v.staged(spark, sf, "zgenes", lambda: matching.standardised_genes(_gene_table(spark, sf)))


@query("b05_candidate_eligibility", "SELECT gene, exclusion_reason = '' AS candidate_eligible, exclusion_reason FROM gene_table")
def b05(spark, sf):
    return _gene_table(spark, sf).select("gene", "candidate_eligible", "exclusion_reason")


@query("b06_first_token", "SELECT split_part(trim(p_name), ' ', 1) AS category, count(*) AS n FROM part GROUP BY 1")
def b06(spark, sf):
    return table(spark, sf, "part").groupBy(text.first_token(F.col("p_name")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


LABELLED = """SELECT d.doc_id, d.lang, d.source, d.n_chars, d.n_chars >= 500 AS guess, l.quality = 1 AS quality, l.toxic = 1 AS toxic, l.doc_id IS NOT NULL AS matched
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""


def _labelled(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", (F.col("n_chars") >= 500).alias("guess"))
    labels = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("quality"), (F.col("toxic") == 1).alias("toxic"))
    return expect.left_with_match(docs, labels, ["doc_id"])


@query("b07_three_valued_agreement", f"SELECT doc_id, CASE WHEN quality IS NOT NULL THEN guess = quality END AS agrees FROM ({LABELLED})")
def b07(spark, sf):
    return _labelled(spark, sf).select("doc_id", text.three_valued_equal(F.col("guess"), F.col("quality")).alias("agrees"))


@query(
    "b08_mismatch_reasons",
    f"""SELECT doc_id, concat_ws(';', CASE WHEN NOT matched THEN 'LABEL_MISSING' END, CASE WHEN quality IS NOT NULL AND guess <> quality THEN 'LABEL_DISAGREEMENT' END,
    CASE WHEN toxic THEN 'FLAGGED_TOXIC' END) AS reason FROM ({LABELLED}) WHERE NOT matched OR (quality IS NOT NULL AND guess <> quality) OR toxic""",
)
def b08(spark, sf):
    rows = _labelled(spark, sf)
    reason = text.reasons(
        (~F.col("matched"), "LABEL_MISSING"),
        (F.col("quality").isNotNull() & (F.col("guess") != F.col("quality")), "LABEL_DISAGREEMENT"),
        (F.coalesce("toxic", F.lit(False)), "FLAGGED_TOXIC"),
    )
    return rows.select("doc_id", reason.alias("reason")).filter(F.col("reason") != "")


@query(
    "b09_outer_views",
    """SELECT k AS outer_fold, fold = k AS is_test, count(*) AS n, count(DISTINCT group_id) AS n_groups FROM cells, folds3 GROUP BY 1, 2""",
)
def b09(spark, sf):
    return folds.outer_views(v.cells(spark, sf), v.FOLDS).groupBy("outer_fold", "is_test").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("group_id").alias("n_groups")
    )


@query(
    "b10_restricted_cohort",
    "SELECT stratum, status = 'F' AS included, count(*) AS n, count(DISTINCT group_id) AS n_groups FROM cells GROUP BY 1, 2",
)
def b10(spark, sf):
    rows = v.cells(spark, sf).withColumn("included", F.col("status") == "F")
    return rows.groupBy("stratum", "included").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("group_id").alias("n_groups"))


@query(
    "b11_alias_search",
    """SELECT p_name AS gene, p_name = 'red ring' AS is_exact, lower(trim(p_name)) = 'red ring' AS is_exact_folded, contains(lower(trim(p_name)), 'red ring') AS is_substring,
    p_name <> trim(p_name) AS is_whitespace_variant, coalesce(sum(c.n), 0)::BIGINT AS detected_n
    FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) c ON l_partkey = p_partkey
    WHERE contains(lower(trim(p_name)), 'red ring') GROUP BY 1""",
)
def b11(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("gene"))
    lines = table(spark, sf, "lineitem").select("l_partkey")
    detected = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("gene").agg(F.count(F.lit(1)).alias("detected_n"))
    return genesets.alias_matches(part.select("gene").distinct(), detected, "red ring")


@query(
    "b12_numeric_coercion",
    """SELECT field, count(*) AS n, count(*) - count(x) AS n_bad, sum(x) AS total FROM (
    SELECT 'props' AS field, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS x FROM events
    UNION ALL SELECT 'event_type', try_cast(event_type AS DOUBLE) FROM events) GROUP BY 1""",
    ["total"],
)
def b12(spark, sf):
    raw = table(spark, sf, "events").select(F.get_json_object("props", "$.k").alias("props"), "event_type")
    long = raw.unpivot([], ["props", "event_type"], "field", "text")
    return long.withColumn("x", num.to_number(F.col("text"))).groupBy("field").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("x").isNull()).alias("n_bad"), F.sum("x").alias("total")
    )


@query(
    "b13_infinite_to_missing",
    """SELECT event_type, count(*) AS n, count(*) - count(x) AS n_infinite, avg(x) AS mean FROM (
    SELECT event_type, CASE WHEN value > 0 THEN ln(value) END AS x FROM events) GROUP BY 1""",
    ["mean"],
)
def b13(spark, sf):
    """log of zero or less becomes minus infinity upstream; it is dropped before summarising."""
    raw = table(spark, sf, "events").select(
        "event_type", F.when(F.col("value") > 0, F.log("value")).otherwise(F.lit(float("-inf"))).alias("raw")
    )
    return raw.withColumn("x", num.finite(F.col("raw"))).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("x").isNull()).alias("n_infinite"), F.avg("x").alias("mean")
    )


@query(
    "b14_header_shape",
    r"""SELECT bool_and(regexp_full_match('CS' || CAST(c_custkey AS VARCHAR), 'CS[0-9]+')) AS accessions_ok,
    NOT bool_or(regexp_full_match(c_name, 'CS[0-9]+')) AS labels_ok FROM customer""",
)
def b14(spark, sf):
    raw = table(spark, sf, "customer").select(F.concat(F.lit("CS"), v.text("c_custkey")).alias("accession"), "c_name")
    return tables.tail_shape(raw, "accession", "c_name")


FOLD_METRICS_SQL = """SELECT module, model, fold, 1 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(*)) AS r2,
    corr(ry, rp) AS spearman FROM (SELECT *, rank() OVER (PARTITION BY module, model, fold ORDER BY y_true) + (count(*) OVER (PARTITION BY module, model, fold, y_true) - 1) / 2.0 AS ry,
    rank() OVER (PARTITION BY module, model, fold ORDER BY y_pred) + (count(*) OVER (PARTITION BY module, model, fold, y_pred) - 1) / 2.0 AS rp FROM oof WHERE model <> 'mean') GROUP BY 1, 2, 3"""


@query(
    "b15_classify_omission",
    f"""SELECT a.module, a.fold, CASE WHEN b.r2 <= 0 OR b.r2 - a.r2 <= -0.1 OR b.spearman - a.spearman <= -0.1 THEN 'weakened'
    WHEN b.r2 - a.r2 > 0.05 AND b.spearman - a.spearman >= -0.05 THEN 'stronger_after_omission'
    WHEN abs(b.r2 - a.r2) <= 0.05 AND abs(b.spearman - a.spearman) <= 0.05 THEN 'stable' ELSE 'mixed_or_partial' END AS label
    FROM ({FOLD_METRICS_SQL}) a JOIN ({FOLD_METRICS_SQL}) b ON a.module = b.module AND a.fold = b.fold AND a.model = 'stratum' AND b.model = 'ols'""",
)
def b15(spark, sf):
    m = metrics.regression_metrics(v.oof(spark, sf, ("ols", "stratum")), ["module", "model", "fold"])
    wide = m.groupBy("module", "fold").agg(
        *[F.max(F.when(F.col("model") == k, F.col(c))).alias(f"{c}_{k}") for k in ("ols", "stratum") for c in ("r2", "spearman")]
    )
    label = rules.classify_omission(
        F.col("r2_ols") - F.col("r2_stratum"), F.col("spearman_ols") - F.col("spearman_stratum"), F.col("r2_ols")
    )
    return wide.select("module", "fold", label.alias("label"))


@query(
    "b16_classify_definition",
    """SELECT module, CASE WHEN greatest(abs(o - m), abs(s - m)) <= 0.05 AND o > 0 AND s > 0 THEN 'robust'
    WHEN greatest(abs(o - m), abs(s - m)) <= 0.1 THEN 'moderately sensitive' ELSE 'composition-sensitive' END AS label FROM (
    SELECT module, max(CASE WHEN model = 'mean' THEN r2 END) AS m, max(CASE WHEN model = 'ols' THEN r2 END) AS o, max(CASE WHEN model = 'stratum' THEN r2 END) AS s FROM perf GROUP BY 1)""",
)
def b16(spark, sf):
    m = metrics.regression_metrics(v.oof(spark, sf), ["module", "model"], spearman=False)
    wide = m.groupBy("module").agg(*[F.max(F.when(F.col("model") == k, F.col("r2"))).alias(k) for k in v.MODELS])
    return wide.select("module", rules.classify_definition(F.col("mean"), F.col("ols"), F.col("stratum")).alias("label"))


@query(
    "b17_range_position",
    """SELECT s.s_suppkey, CASE WHEN s_acctbal < low THEN 'below' WHEN s_acctbal > high THEN 'above' ELSE 'within' END AS position
    FROM supplier s JOIN (SELECT c_nationkey, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer GROUP BY 1) r ON c_nationkey = s_nationkey""",
)
def b17(spark, sf):
    span = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"))
    suppliers = table(spark, sf, "supplier")
    joined = suppliers.join(span, suppliers.s_nationkey == span.c_nationkey)
    return joined.select("s_suppkey", rules.range_position(F.col("s_acctbal"), F.col("low"), F.col("high")).alias("position"))


@query(
    "c01_full_outer_source",
    """SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'right_only' WHEN b.k IS NULL THEN 'left_only' ELSE 'both' END AS source, n_orders, acctbal
    FROM (SELECT o_custkey AS k, count(*) AS n_orders FROM orders GROUP BY 1) a FULL OUTER JOIN (SELECT c_custkey AS k, c_acctbal AS acctbal FROM customer WHERE c_acctbal > 0) b ON a.k = b.k""",
    ["acctbal"],
)
def c01(spark, sf):
    a = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n_orders"))
    b = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("acctbal"))
    return expect.outer_with_source(a, b, ["k"])


@query("c02_left_match", f"SELECT lang, matched, count(*) AS n FROM ({LABELLED}) GROUP BY 1, 2")
def c02(spark, sf):
    return _labelled(spark, sf).groupBy("lang", "matched").agg(F.count(F.lit(1)).alias("n"))


@query(
    "c03_left_semi",
    "SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1",
)
def c03(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    kept = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query(
    "c04_rejected_rows",
    """SELECT CAST(doc_id AS VARCHAR) AS id, source, 'label_missing' AS reason FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), NULL, 'lines_missing' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
)
def c04(spark, sf):
    docs = expect.rejected_rows(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), ["doc_id"], "label_missing")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    bare = expect.rejected_rows(orders, table(spark, sf, "lineitem"), ["l_orderkey"], "lines_missing")
    return docs.select(v.text("doc_id").alias("id"), "source", "reason").unionByName(
        bare.select(v.text("l_orderkey").alias("id"), "reason"), allowMissingColumns=True
    )


@query(
    "c05_checked_join",
    """SELECT l_orderkey AS k, l_linenumber AS line, count(*) AS n, 'left' AS side FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1
    UNION ALL SELECT o_orderkey, 1, count(*), 'right' FROM orders GROUP BY 1 HAVING count(*) > 1""",
)
def c05(spark, sf):
    """A join declared one to one whose left side breaks the promise."""
    left = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), "l_quantity")
    right = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.lit(1).alias("line"), "o_totalprice")
    return expect.checked_join(left, right, ["k", "line"], "left", "one_to_one")[1]


@query(
    "c06_lookup_completeness",
    "SELECT count(*) AS n_rows, count(*) - count(quality) AS n_missing FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
)
def c06(spark, sf):
    return expect.with_lookup(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), ["doc_id"], "quality")[1]


@query(
    "c07_paired_models",
    "SELECT module, count(*) AS n, avg(y_pred_a - y_pred_b) AS mean_difference, CAST(0 AS BIGINT) AS n_violations FROM pairs GROUP BY 1",
    ["mean_difference"],
)
def c07(spark, sf):
    view, violations = resample.paired_view(v.oof(spark, sf, ("mean", "ols")), "ols", "mean")
    n = violations.agg(F.count(F.lit(1))).scalar()
    return view.groupBy("module").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("y_pred_a") - F.col("y_pred_b")).alias("mean_difference")
    ).withColumn("n_violations", n)


PAIRS_SQL = """SELECT p.module, p.gene AS target_gene, c.gene, sqrt((c.zx - t.zx) * (c.zx - t.zx) + (c.zd - t.zd) * (c.zd - t.zd)) AS distance
    FROM present p JOIN zgenes t ON t.gene = p.gene JOIN zgenes c ON c.candidate_eligible
    WHERE sqrt((c.zx - t.zx) * (c.zx - t.zx) + (c.zd - t.zd) * (c.zd - t.zd)) <= 0.5"""


@query("c08_radius_join", PAIRS_SQL, ["distance"])
def c08(spark, sf):
    z = zgenes(spark, sf)
    targets = v.requested(spark, sf).join(z, "gene").select("module", F.col("gene").alias("target_gene"), F.col("zx").alias("tx"), F.col("zd").alias("td"))
    pairs = matching.radius_pairs(targets, z.filter("candidate_eligible").select("gene", "zx", "zd"), 0.5)
    return pairs.select("module", "target_gene", "gene", "distance")


@query(
    "c10_expected_grid",
    """SELECT e.cell_id, e.model, 'missing' AS side FROM (SELECT cell_id, m.model FROM cells, (SELECT unnest(['mean', 'ols', 'boosted']) AS model) m) e
    WHERE e.model = 'boosted' UNION ALL SELECT cell_id, 'stratum', 'extra' FROM cells""",
)
def c10(spark, sf):
    """The predictions hold one model that was not asked for and lack one that was."""
    observed = v.oof(spark, sf).select("cell_id", "model")
    wanted = expect.expected_grid(v.cells(spark, sf), ["cell_id"], {"model": ["mean", "ols", "boosted"]})
    return expect.two_way_difference(wanted, observed, ["cell_id", "model"])


@query(
    "g01_union_aligned",
    """SELECT source, count(*) AS n, count(lang) AS n_lang, count(role) AS n_role FROM (
    SELECT 'documents' AS source, lang, NULL AS role FROM documents UNION ALL SELECT 'conversations', NULL, role FROM conversations UNION ALL SELECT 'benchmark', NULL, NULL FROM benchmark) GROUP BY 1""",
)
def g01(spark, sf):
    parts = [
        table(spark, sf, "documents").select(F.lit("documents").alias("source"), "lang"),
        table(spark, sf, "conversations").select(F.lit("conversations").alias("source"), "role"),
        table(spark, sf, "benchmark").select(F.lit("benchmark").alias("source")),
    ]
    rows = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("lang").alias("n_lang"), F.count("role").alias("n_role"))


@query("g02_distinct_keys", "SELECT DISTINCT module, model, analysis FROM oof")
def g02(spark, sf):
    return v.oof(spark, sf).select("module", "model", "analysis").distinct()


@query(
    "g03_two_way_except",
    """SELECT o_custkey AS k, 'extra' AS side FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
    UNION ALL SELECT c_custkey, 'missing' FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)""",
)
def g03(spark, sf):
    expected = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return expect.two_way_difference(expected, table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), ["k"])


@query(
    "g04_shared_groups",
    "SELECT o_custkey AS group_id, count(DISTINCT o_orderstatus) AS n_sides FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1",
)
def g04(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("group_id"), F.col("o_orderstatus").alias("side"))
    return expect.shared_groups(rows, "group_id", "side")


@query(
    "g05_partition_halves",
    """SELECT p_brand, len(list_intersect(a, b)) = 0 AS is_disjoint, len(list_distinct(list_concat(a, b))) = len(whole) AS is_complete FROM (
    SELECT p_brand, list(DISTINCT p_size) FILTER (p_size <= 25) AS a, list(DISTINCT p_size) FILTER (p_size >= 25) AS b, list(DISTINCT p_size) AS whole FROM part GROUP BY 1)""",
)
def g05(spark, sf):
    sides = table(spark, sf, "part").groupBy("p_brand").agg(
        F.collect_set(F.when(F.col("p_size") <= 25, F.col("p_size"))).alias("a"),
        F.collect_set(F.when(F.col("p_size") >= 25, F.col("p_size"))).alias("b"),
        F.collect_set("p_size").alias("whole"),
    )
    return expect.partition_check(sides, "a", "b", "whole").select("p_brand", "is_disjoint", "is_complete")


@query("g06_feature_policy", "SELECT cell_id, f1, f2, f3, f4, f5, f6 FROM cells", ["f1", "f2", "f3", "f4", "f5", "f6"])
def g06(spark, sf):
    kept, features = expect.drop_features(v.cells(spark, sf), [*v.FEATURES, "f7"], ["f7"])
    return kept.select("cell_id", *features)


@query(
    "h01_scalar_math",
    """SELECT event_id, log2(value + 1) AS l2, log10(value + 1) AS l10, sqrt(value) AS root, CAST(sign(value - 10) AS DOUBLE) AS side, ceil(CAST(0.1 AS DOUBLE) * value)::BIGINT AS top, greatest(least(value, 20.0), 5.0) AS clipped FROM events""",
    ["l2", "l10", "root", "side", "clipped"],
)
def h01(spark, sf):
    x = F.col("value")
    return table(spark, sf, "events").select(
        "event_id", F.log2(x + 1).alias("l2"), F.log10(x + 1).alias("l10"), F.sqrt(x).alias("root"), F.signum(x - 10).alias("side"),
        F.ceil(F.lit(0.1) * x).cast("bigint").alias("top"), num.clip(x, 5.0, 20.0).alias("clipped"),
    )


@query(
    "h02_tolerance_equality",
    """SELECT module, count(*) AS n, CAST(sum(CASE WHEN abs(y_pred - y_true) <= 0.01 + 0.05 * abs(y_true) THEN 1 ELSE 0 END) AS BIGINT) AS n_close FROM oof_ols GROUP BY 1""",
)
def h02(spark, sf):
    rows = v.oof(spark, sf, ("ols",))
    return rows.groupBy("module").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(num.is_close(F.col("y_pred"), F.col("y_true"), 0.05, 0.01)).alias("n_close")
    )


@query(
    "h03_text_functions",
    r"""SELECT p_partkey, lower(trim(p_name)) AS folded, contains(lower(p_name), 'ring') AS has_ring, regexp_full_match(p_brand, 'Brand#[0-9]+') AS brand_ok,
    regexp_replace(p_brand || ' ' || p_type, '[^A-Za-z0-9]+', '_', 'g') AS safe FROM part""",
)
def h03(spark, sf):
    name = F.col("p_name")
    return table(spark, sf, "part").select(
        "p_partkey", text.fold_case(name).alias("folded"), F.lower(name).contains("ring").alias("has_ring"),
        F.col("p_brand").rlike("^Brand#[0-9]+$").alias("brand_ok"), text.safe_name(F.concat_ws(" ", "p_brand", "p_type")).alias("safe"),
    )


@query(
    "h04_joined_ids",
    """SELECT p_brand, string_agg(DISTINCT p_type, ';' ORDER BY p_type) AS types, 'control_' || lpad(CAST(min(p_size) AS VARCHAR), CAST(greatest(4, length(CAST(min(p_size) AS VARCHAR))) AS INTEGER), '0') AS control FROM part GROUP BY 1""",
)
def h04(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(
        F.concat_ws(";", F.array_sort(F.collect_set("p_type"))).alias("types"), text.numbered("control_", F.min("p_size")).alias("control")
    )


@query(
    "h05_sorted_json",
    """SELECT p_partkey, '{"brand":"' || p_brand || '","size":' || CAST(p_size AS VARCHAR) || ',"type":"' || p_type || '"}' AS js FROM part""",
)
def h05(spark, sf):
    from cohortlens.operators.provenance import config_json

    named = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("type"), F.col("p_size").alias("size"), F.col("p_brand").alias("brand"))
    return named.select("p_partkey", config_json(["type", "size", "brand"]).alias("js"))


@query(
    "h06_set_signature",
    """SELECT p_brand, sha256(string_agg(g, chr(10) ORDER BY g)) AS signature FROM (SELECT DISTINCT p_brand, p_brand || '|' || CAST(p_size AS VARCHAR) AS g FROM part) GROUP BY 1""",
)
def h06(spark, sf):
    genes = F.collect_set(F.concat_ws("|", "p_brand", v.text("p_size")))
    return table(spark, sf, "part").groupBy("p_brand").agg(text.set_signature(genes).alias("signature"))


@query("h07_vector_digest")
def h07(spark, sf):
    from cohortlens.operators.provenance import vector_digest

    return vector_digest(v.long_targets(spark, sf), ["module"], "cell_id", "y_true")


@query(
    "h08_stable_seed",
    """SELECT o_orderkey, ('0x' || substr(sha256(concat_ws('|', 'v1', '42', 'fold', CAST(o_orderkey AS VARCHAR))), 1, 8))::BIGINT AS seed,
    ('0x' || substr(md5(concat_ws('|', '7', CAST(o_orderkey AS VARCHAR))), 1, 8))::BIGINT AS draw FROM orders""",
)
def h08(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", stable_seed("fold", F.col("o_orderkey")).alias("seed"), hash32(7, F.col("o_orderkey")).alias("draw")
    )


@query(
    "h09_choose",
    """SELECT p_brand, n, CAST(round(exp(lgamma(n + 1) - lgamma(n // 2 + 1) - lgamma(n - n // 2 + 1))) AS BIGINT) AS ways FROM (
    SELECT p_brand, count(DISTINCT p_type) + count(DISTINCT p_size % 10) AS n FROM part GROUP BY 1)""",
)
def h09(spark, sf):
    sizes = table(spark, sf, "part").groupBy("p_brand").agg(
        (F.count_distinct("p_type") + F.count_distinct(F.col("p_size") % 10)).alias("n")
    )
    return sizes.select("p_brand", "n", num.choose(F.col("n"), F.floor(F.col("n") / 2).cast("bigint")).alias("ways"))


@query(
    "h10_spearman_brown",
    "SELECT module, control_id, 2 * sqrt(r2) / (1 + sqrt(r2)) AS sb FROM control_perf",
    ["sb"],
)
def h10(spark, sf):
    return v.control_performance(spark, sf).select("module", "control_id", num.spearman_brown(F.sqrt("r2")).alias("sb"))


@query(
    "h11_reliability_ratio",
    "SELECT c.module, control_id, CASE WHEN observed > 0 THEN r2 / observed END AS ratio FROM control_perf c JOIN observed_perf o ON o.module = c.module",
    ["ratio"],
    digits=4,
)
def h11(spark, sf):
    joined = v.control_performance(spark, sf).join(v.observed_performance(spark, sf), "module")
    return joined.select("module", "control_id", num.reliability_ratio(F.col("r2"), F.col("observed")).alias("ratio"))


@query(
    "h12_monte_carlo_p",
    """SELECT user_id, (1.0 + above) / (n + 1) AS p_one_sided, least(1.0, 2 * least((1.0 + n - above) / (n + 1), (1.0 + n - below) / (n + 1))) AS p_sign FROM (
    SELECT user_id, count(*) AS n, sum(CASE WHEN value > 10 THEN 1 ELSE 0 END) AS above, sum(CASE WHEN value < 10 THEN 1 ELSE 0 END) AS below FROM events GROUP BY 1)""",
    ["p_one_sided", "p_sign"],
)
def h12(spark, sf):
    d = F.col("value") - 10
    tallied = table(spark, sf, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(d > 0).alias("above"), F.count_if(d < 0).alias("below")
    )
    return tallied.select(
        "user_id", num.plus_one_p(F.col("above"), F.col("n")).alias("p_one_sided"),
        num.sign_tail_p(F.col("above"), F.col("below"), F.col("n")).alias("p_sign"),
    )
