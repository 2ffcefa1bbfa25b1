"""Registered queries: resampling, folds, matched sets, correlation, components and reliability."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions.numeric import spearman_brown
from cohortlens.operators import corr, folds, genesets, matching, metrics, ranks, reliability, resample
from cohortlens.plans import views as v
from cohortlens.plans.q_metrics import DRAWS20, LOO_SQL, dense
from cohortlens.plans.q_tables import _gene_table, zgenes
from cohortlens.plans.registry import query
from cohortlens.sources.tables import table


def md5_int(*parts: str) -> str:
    return "('0x' || substr(md5(concat_ws('|', " + ", ".join(parts) + ")), 1, 8))::BIGINT"


WRANKS = """(SELECT w.replicate, o.module, w.w, y_true, y_pred,
    sum(w.w) OVER (PARTITION BY w.replicate, o.module ORDER BY y_true RANGE UNBOUNDED PRECEDING) - (sum(w.w) OVER (PARTITION BY w.replicate, o.module, y_true) - 1) / 2.0 AS ry,
    sum(w.w) OVER (PARTITION BY w.replicate, o.module ORDER BY y_pred RANGE UNBOUNDED PRECEDING) - (sum(w.w) OVER (PARTITION BY w.replicate, o.module, y_pred) - 1) / 2.0 AS rp
    FROM {rows} o JOIN weights20 w ON w.group_id = o.group_id)"""
RHO = """(sum(w * ry * rp) - sum(w * ry) * sum(w * rp) / sum(w)) / (sqrt(sum(w * ry * ry) - sum(w * ry) * sum(w * ry) / sum(w)) * sqrt(sum(w * rp * rp) - sum(w * rp) * sum(w * rp) / sum(w)))"""


@query(
    "i01_cluster_bootstrap",
    f"""SELECT d.replicate, d.module, d.n_sampled_rows, d.r2, d.mae, d.rmse, s.spearman FROM ({DRAWS20}) d JOIN (
    SELECT replicate, module, {RHO} AS spearman FROM {WRANKS.format(rows="oof_ols")} GROUP BY 1, 2) s ON s.replicate = d.replicate AND s.module = d.module""",
    ["r2", "mae", "rmse", "spearman"],
)
def i01(spark, sf):
    return resample.cluster_bootstrap(v.oof(spark, sf, ("ols",)), ["module"], n_resamples=20)


@query("i01_bootstrap_errors", f"SELECT * FROM ({DRAWS20})", ["r2", "mae", "rmse"])
def i01b(spark, sf):
    """R2, MAE and RMSE draws alone: group sums only, no row is repeated per replicate."""
    return resample.cluster_bootstrap(v.oof(spark, sf, ("ols",)), ["module"], n_resamples=20, spearman=False)


def _paired_sql(model: str, weights: str) -> str:
    return f"""SELECT w.replicate, o.module, 1 - sum(w.w * e * e) / (sum(w.w * y_true * y_true) - sum(w.w * y_true) * sum(w.w * y_true) / sum(w.w)) AS r2,
    sum(w.w * abs(e)) / sum(w.w) AS mae, sqrt(sum(w.w * e * e) / sum(w.w)) AS rmse FROM (SELECT *, y_true - y_pred AS e FROM oof_{model}) o JOIN {weights} w ON w.group_id = o.group_id GROUP BY 1, 2"""


def _deltas_sql(weights: str) -> str:
    return f"""SELECT a.module, a.replicate, m.metric, CASE m.metric WHEN 'r2' THEN a.r2 WHEN 'mae' THEN a.mae ELSE a.rmse END AS metric_a, CASE m.metric WHEN 'r2' THEN b.r2 WHEN 'mae' THEN b.mae ELSE b.rmse END AS metric_b,
    CASE m.metric WHEN 'r2' THEN a.r2 - b.r2 WHEN 'mae' THEN b.mae - a.mae ELSE b.rmse - a.rmse END AS delta
    FROM ({_paired_sql("ols", weights)}) a JOIN ({_paired_sql("mean", weights)}) b ON a.module = b.module AND a.replicate = b.replicate CROSS JOIN (SELECT unnest(['r2', 'mae', 'rmse']) AS metric) m"""


DELTAS = _deltas_sql("weights20")


def _summary_sql(weights: str) -> str:
    return f"""SELECT module, metric, count(*) AS n_bootstrap, CAST(sum(CASE WHEN delta > 0 THEN 1 ELSE 0 END) AS BIGINT) AS count_gt0, CAST(sum(CASE WHEN delta < 0 THEN 1 ELSE 0 END) AS BIGINT) AS count_lt0,
    CAST(sum(CASE WHEN delta = 0 THEN 1 ELSE 0 END) AS BIGINT) AS count_eq0, quantile_cont(delta, 0.025) AS ci_low, quantile_cont(delta, 0.975) AS ci_high,
    avg(CASE WHEN delta > 0 THEN 1.0 ELSE 0.0 END) AS prob_gt0, avg(CASE WHEN delta < 0 THEN 1.0 ELSE 0.0 END) AS prob_lt0,
    least(1.0, 2 * least((1.0 + sum(CASE WHEN delta <= 0 THEN 1 ELSE 0 END)) / (count(*) + 1), (1.0 + sum(CASE WHEN delta >= 0 THEN 1 ELSE 0 END)) / (count(*) + 1))) AS p_sign_tail FROM ({_deltas_sql(weights)}) GROUP BY 1, 2"""


#: Draws of the paired comparisons, as many as the analyses make.
PAIRED_DRAWS = 5000


@query("i02_paired_bootstrap", _summary_sql("weights20"), ["ci_low", "ci_high", "prob_gt0", "prob_lt0", "p_sign_tail"])
def i02(spark, sf):
    draws = resample.paired_bootstrap(v.pairs(spark, sf), ["module"], n_resamples=20, spearman=False)
    return resample.paired_summary(draws, ["module"])


@query("i02_paired_spearman")
def i02b(spark, sf):
    """All four metrics of two models under one plan; ranks are redone per replicate."""
    draws = resample.paired_bootstrap(v.pairs(spark, sf), ["module"], n_resamples=PAIRED_DRAWS)
    return resample.paired_summary(draws, ["module"])


@query(
    "i03_increment_over_baseline",
    f"""SELECT module, point_delta, ci_low, ci_high, p_sign_tail, least(1.0, min(family_n * p_sign_tail / bh_rank) OVER (ORDER BY bh_rank DESC ROWS UNBOUNDED PRECEDING)) AS bh_q FROM (
    SELECT s.module, a.r2 - b.r2 AS point_delta, ci_low, ci_high, p_sign_tail, row_number() OVER (ORDER BY p_sign_tail, s.module) AS bh_rank, count(*) OVER () AS family_n FROM ({_summary_sql("weights5000")}) s
    JOIN perf a ON a.module = s.module AND a.model = 'ols' JOIN perf b ON b.module = s.module AND b.model = 'mean' WHERE metric = 'r2')""",
    ["point_delta", "ci_low", "ci_high", "p_sign_tail", "bh_q"],
)
def i03(spark, sf):
    rows = v.pairs(spark, sf)
    summary = resample.paired_summary(resample.paired_bootstrap(rows, ["module"], n_resamples=PAIRED_DRAWS, spearman=False), ["module"])
    points = [metrics.error_metrics("y_true", p)["r2"].alias(k) for k, p in (("a", "y_pred_a"), ("b", "y_pred_b"))]
    point = rows.groupBy("module").agg(*points).select("module", (F.col("a") - F.col("b")).alias("point_delta"))
    joined = summary.filter("metric = 'r2'").join(point, "module")
    return ranks.bh_adjust(joined, [], "p_sign_tail", ["module"]).select(
        "module", "point_delta", "ci_low", "ci_high", "p_sign_tail", "bh_q"
    )


def _null_sql(rows: str, unit: str, stratum: str, n: int, seed: int) -> str:
    slot, draw = md5_int(f"'{seed}'", "'slot'", unit), md5_int(f"'{seed}'", "CAST(iteration AS VARCHAR)", unit)
    return f"""WITH r AS (SELECT *, rank() OVER (PARTITION BY module ORDER BY y_true) + (count(*) OVER (PARTITION BY module, y_true) - 1) / 2.0 - (count(*) OVER (PARTITION BY module) + 1) / 2.0 AS ry,
    rank() OVER (PARTITION BY module ORDER BY y_pred) + (count(*) OVER (PARTITION BY module, y_pred) - 1) / 2.0 - (count(*) OVER (PARTITION BY module) + 1) / 2.0 AS rp FROM ({rows})),
    s AS (SELECT module, {stratum} AS h, {unit} AS u, ry, rp, row_number() OVER (PARTITION BY module, {stratum} ORDER BY {slot}, {unit}) AS slot FROM r),
    p AS (SELECT module, {stratum} AS h, ry, iteration, row_number() OVER (PARTITION BY module, {stratum}, iteration ORDER BY {draw}, {unit}) AS slot FROM r, (SELECT CAST(unnest(range(0, {n})) AS INTEGER) AS iteration)),
    z AS (SELECT module, sqrt(sum(ry * ry) * sum(rp * rp)) AS norm, sum(ry * rp) / sqrt(sum(ry * ry) * sum(rp * rp)) AS observed FROM r GROUP BY 1)
    SELECT p.module, p.iteration, sum(p.ry * s.rp) / any_value(z.norm) AS rho, any_value(z.observed) AS observed FROM p JOIN s ON s.module = p.module AND s.h = p.h AND s.slot = p.slot JOIN z ON z.module = p.module GROUP BY 1, 2"""


def _null_summary(inner: str) -> str:
    return f"""SELECT module, max(observed) AS observed_spearman, count(*) AS n_permutations, CAST(sum(CASE WHEN abs(rho) >= abs(observed) THEN 1 ELSE 0 END) AS BIGINT) AS extreme_count,
    avg(rho) AS null_mean, stddev_samp(rho) AS null_sd, (1.0 + sum(CASE WHEN abs(rho) >= abs(observed) THEN 1 ELSE 0 END)) / (count(*) + 1) AS p_two_sided FROM ({inner}) GROUP BY 1"""


NULL_DOUBLES = ["observed_spearman", "null_mean", "null_sd", "p_two_sided"]


@query("i04_stratified_permutation", _null_summary(_null_sql("SELECT * FROM oof_ols", "cell_id", "stratum", 10, 7)), NULL_DOUBLES)
def i04(spark, sf):
    rows = v.oof(spark, sf, ("ols",))
    null = resample.stratified_permutation(rows, ["module"], "stratum", "cell_id", 10, 7)
    return resample.permutation_summary(null, resample.observed_spearman(rows, ["module"]), ["module"])


@query(
    "i04_permutation_moments",
    """WITH r AS (SELECT module, stratum, rank() OVER (PARTITION BY module ORDER BY y_true) + (count(*) OVER (PARTITION BY module, y_true) - 1) / 2.0 - (count(*) OVER (PARTITION BY module) + 1) / 2.0 AS ry,
    rank() OVER (PARTITION BY module ORDER BY y_pred) + (count(*) OVER (PARTITION BY module, y_pred) - 1) / 2.0 - (count(*) OVER (PARTITION BY module) + 1) / 2.0 AS rp FROM oof_ols),
    h AS (SELECT module, stratum, count(*) * avg(ry) * avg(rp) AS m, count(*) * var_pop(ry) * count(*) * var_pop(rp) / (count(*) - 1) AS s FROM r GROUP BY 1, 2)
    SELECT module, sum(m) / any_value(norm) AS null_mean, sqrt(sum(s)) / any_value(norm) AS null_sd FROM h JOIN (SELECT module AS m2, sqrt(sum(ry * ry) * sum(rp * rp)) AS norm FROM r GROUP BY 1) ON m2 = module GROUP BY 1""",
    ["null_mean", "null_sd"],
)
def i04b(spark, sf):
    return resample.permutation_moments(v.oof(spark, sf, ("ols",)), ["module"], "stratum")


GROUP_ROWS = """SELECT module, group_id, 'all' AS h0, CAST(sum(CAST(floor(ty * 1e9 + 0.5) AS BIGINT)) AS DOUBLE) / (count(ty) * 1e9) AS y_true, CAST(sum(CAST(floor(tp * 1e9 + 0.5) AS BIGINT)) AS DOUBLE) / (count(tp) * 1e9) AS y_pred FROM (
    SELECT module, group_id, y_true - avg(y_true) OVER (PARTITION BY module, stratum) AS ty, y_pred - avg(y_pred) OVER (PARTITION BY module, stratum) AS tp FROM oof_ols) GROUP BY 1, 2"""


@query("i05_group_permutation", _null_summary(_null_sql(GROUP_ROWS, "group_id", "h0", 20, 9)), NULL_DOUBLES)
def i05(spark, sf):
    rows = v.oof(spark, sf, ("ols",))
    null = resample.group_permutation(rows, ["module"], "group_id", "stratum", 20, 9)
    units = resample.group_level_means(rows, ["module"], "group_id", "stratum")
    return resample.permutation_summary(null, resample.observed_spearman(units, ["module"]), ["module"])


N_CONTROLS = 20

PROPOSALS_SQL = f"""WITH RECURSIVE near AS (SELECT p.module, p.gene AS target_gene, t.zx AS tx, t.zd AS td, c.gene, c.zx, c.zd, sqrt((c.zx - t.zx) * (c.zx - t.zx) + (c.zd - t.zd) * (c.zd - t.zd)) AS distance
    FROM present p JOIN zgenes t ON t.gene = p.gene JOIN zgenes c ON c.candidate_eligible),
    pool AS (SELECT module, target_gene, tx, td, count(*) AS size, list({{'g': gene, 'd': distance, 'x': zx, 'z': zd}} ORDER BY distance, gene) AS pool FROM (
    SELECT * FROM near WHERE distance <= 0.5 QUALIFY row_number() OVER (PARTITION BY module, target_gene ORDER BY distance, gene) <= 128) GROUP BY 1, 2, 3, 4),
    ok AS (SELECT m.module FROM (SELECT module, count(*) AS n FROM present GROUP BY 1) m JOIN (SELECT module, count(*) AS n, min(size) AS low FROM pool GROUP BY 1) q ON q.module = m.module WHERE q.n = m.n AND q.low >= m.n),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY size, target_gene) AS k, count(*) OVER (PARTITION BY module) AS n FROM pool WHERE module IN (SELECT module FROM ok)),
    walk AS (SELECT module, control_id, proposal, 0::BIGINT AS k, []::VARCHAR[] AS used, 0.0::DOUBLE AS sd, 0.0::DOUBLE AS md, 0.0::DOUBLE AS dx, 0.0::DOUBLE AS dz FROM (SELECT DISTINCT module FROM ordered),
    (SELECT CAST(unnest(range(0, {N_CONTROLS})) AS INTEGER) AS control_id), (SELECT CAST(unnest(range(0, 16)) AS INTEGER) AS proposal)
    UNION ALL SELECT module, control_id, proposal, k, list_append(used, c.g), sd + c.d, greatest(md, c.d), dx + c.x - tx, dz + c.z - td FROM (
    SELECT w.module, w.control_id, w.proposal, w.k + 1 AS k, w.used, w.sd, w.md, w.dx, w.dz, o.tx, o.td, free[1 + {md5_int("'42'", "w.module", "CAST(w.control_id AS VARCHAR)", "CAST(w.proposal AS VARCHAR)", "o.target_gene")} % len(free)] AS c
    FROM walk w JOIN ordered o ON o.module = w.module AND o.k = w.k + 1, LATERAL (SELECT list_filter(o.pool, lambda q: NOT list_contains(w.used, q.g)) AS free))),
    done AS (SELECT w.module, w.control_id, w.proposal, o.n AS n_genes, sd / o.n AS mean_distance, md AS max_distance, dx / o.n AS expression_difference, dz / o.n AS detection_difference,
    sha256(array_to_string(list_sort(used), chr(10))) AS set_signature FROM walk w JOIN (SELECT DISTINCT module, n FROM ordered) o ON o.module = w.module AND o.n = w.k)
    SELECT *, mean_distance <= 0.25 AND max_distance <= 0.5 AND abs(expression_difference) <= 0.1 AND abs(detection_difference) <= 0.1 AS matching_pass FROM done"""
QUALITY = ["mean_distance", "max_distance", "expression_difference", "detection_difference"]


@query("i06_proposals", f"SELECT * FROM ({PROPOSALS_SQL})", QUALITY)
def i06(spark, sf):
    """Sixteen proposals for each control with their quality and verdict."""
    z, wanted = zgenes(spark, sf), v.requested(spark, sf)
    packed = matching.packed_pools(z, wanted, matching.candidate_pools(z, wanted, 0.5))
    drawn = matching.propose(matching.proposal_jobs(packed, N_CONTROLS, 0, 15), 42)
    return matching.score_proposals(drawn).drop("picks")


def matched(spark, sf):
    return v.staged(spark, sf, "matched", lambda: matching.matched_sets(zgenes(spark, sf), v.requested(spark, sf), N_CONTROLS))


@query(
    "i06_matched_sets",
    f"""SELECT module, control_id, proposal, n_genes, mean_distance, max_distance, expression_difference, detection_difference, set_signature, matching_pass FROM ({PROPOSALS_SQL})
    WHERE matching_pass QUALIFY row_number() OVER (PARTITION BY module, control_id ORDER BY proposal) = 1""",
    QUALITY,
)
def i06b(spark, sf):
    return matched(spark, sf).drop("picks")


@query(
    "d18_matching_diagnostics",
    f"""SELECT module, count(*) AS n_controls, count(*) AS n_passed, avg(mean_distance) AS mean_distance, max(max_distance) AS max_distance, max(abs(expression_difference)) AS max_abs_expression_difference,
    max(abs(detection_difference)) AS max_abs_detection_difference, CAST(sum(proposal) AS BIGINT) AS rejected_proposals FROM (SELECT * FROM ({PROPOSALS_SQL})
    WHERE matching_pass QUALIFY row_number() OVER (PARTITION BY module, control_id ORDER BY proposal) = 1) GROUP BY 1""",
    ["mean_distance", "max_distance", "max_abs_expression_difference", "max_abs_detection_difference"],
)
def d18(spark, sf):
    return matching.matching_diagnostics(matched(spark, sf))


@query("i06_assignments")
def i06c(spark, sf):
    return matching.assignments(matched(spark, sf))


@query("x14_signature_gate")
def x14(spark, sf):
    return matching.duplicate_signatures(matched(spark, sf))


CONTROL_SETS = """SELECT p_brand AS module, i % 7 AS control_id, p_brand || '|' || CAST(i AS VARCHAR) AS gene FROM (SELECT DISTINCT p_brand FROM part), (SELECT unnest(range(1, 51)) AS i)"""


def _brand_sets(spark, sf):
    """Sets from the data itself: the sizes of a brand dealt into seven sets."""
    brands = table(spark, sf, "part").select(F.col("p_brand").alias("module")).distinct()
    sets = brands.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(50)))).select(
        "module", (F.col("i") % 7).alias("control_id"), F.concat_ws("|", "module", v.text("i")).alias("gene")
    )
    known = sets.join(v.counts(spark, sf).select("gene").distinct(), "gene", "left_semi")
    n = known.groupBy("module", "control_id").agg(F.count(F.lit(1)).alias("_n"))
    return known.join(n, ["module", "control_id"]).select("module", "control_id", "gene", (F.lit(1.0) / F.col("_n")).alias("weight"))


@query(
    "c09_control_targets",
    f"""WITH s AS (SELECT *, count(*) OVER (PARTITION BY module, control_id) AS n FROM ({CONTROL_SETS}) WHERE gene IN (SELECT gene FROM counts)),
    g AS (SELECT l.sample_id, s.module, s.control_id, s.n, s.gene FROM library l CROSS JOIN s)
    SELECT g.sample_id, g.module, CAST(g.control_id AS INTEGER) AS control_id, sum(coalesce(e.x, 0.0) / g.n) AS y FROM g LEFT JOIN expression e ON e.sample_id = g.sample_id AND e.gene = g.gene GROUP BY 1, 2, 3""",
    ["y"],
)
def c09(spark, sf):
    library = v.library(spark, sf)
    return genesets.control_targets(genesets.long_expression(v.counts(spark, sf), library), library, _brand_sets(spark, sf))


@query(
    "c09_incomplete_controls",
    f"""SELECT module, CAST(control_id AS INTEGER) AS control_id, count(*) AS expected, count(k.gene) AS seen FROM ({CONTROL_SETS}) s LEFT JOIN (SELECT DISTINCT gene FROM counts) k ON k.gene = s.gene GROUP BY 1, 2 HAVING count(*) <> count(k.gene)""",
)
def c09b(spark, sf):
    brands = table(spark, sf, "part").select(F.col("p_brand").alias("module")).distinct()
    sets = brands.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(50)))).select(
        "module", (F.col("i") % 7).alias("control_id"), F.concat_ws("|", "module", v.text("i")).alias("gene")
    )
    return genesets.incomplete_controls(sets, v.counts(spark, sf))


@query(
    "i07_balanced_partitions",
    """WITH s AS (SELECT module, count(*) AS gene_n FROM present GROUP BY 1)
    SELECT module, gene_n, CASE WHEN gene_n % 2 = 0 THEN w // 2 ELSE w END AS max_partitions, reverse(lpad(bin(mask), CAST(gene_n AS INTEGER), '0')) AS mask, CASE WHEN CASE WHEN gene_n % 2 = 0 THEN w // 2 ELSE w END <= 100 THEN 'exhaustive' ELSE 'deterministic_random_unique' END AS method FROM (
    SELECT module, gene_n, mask, CAST(round(exp(lgamma(gene_n + 1) - lgamma(gene_n // 2 + 1) - lgamma(gene_n - gene_n // 2 + 1))) AS BIGINT) AS w FROM s, (SELECT unnest(range(0, 256)) AS mask)
    WHERE mask < (1 << gene_n) AND bit_count(mask) = gene_n // 2 AND (gene_n % 2 = 1 OR mask % 2 = 1))""",
)
def i07(spark, sf):
    present = genesets.present_members(v.requested(spark, sf), v.counts(spark, sf))
    return reliability.balanced_partitions(reliability.set_sizes(present, ["module"]), ["module"], 100)


@query(
    "i08_inner_group_split",
    f"""SELECT k AS outer_fold, group_id, row_number() OVER (PARTITION BY k ORDER BY {md5_int("'42'", "CAST(k AS VARCHAR)", "group_id")}, group_id) <= ceil(CAST(0.2 AS DOUBLE) * count(*) OVER (PARTITION BY k)) AS is_validation
    FROM (SELECT DISTINCT k, group_id FROM cells, folds3 WHERE fold <> k)""",
)
def i08(spark, sf):
    return folds.inner_group_split(v.cells(spark, sf), "group_id", v.FOLDS)


PROFILE_SQL = """SELECT group_id, CAST(sum(n) AS BIGINT) AS n_cells, arg_min(stratum, (-n, stratum)) AS dominant FROM (SELECT group_id, stratum, count(*) AS n FROM cells GROUP BY 1, 2) GROUP BY 1"""


def _serpentine_sql(order: str, partition: str, rows: str, columns: str) -> str:
    return f"""SELECT {columns}, CAST(CASE WHEN (pos // 3) % 2 = 0 THEN pos % 3 ELSE 2 - pos % 3 END AS INTEGER) AS fold FROM (
    SELECT *, row_number() OVER (PARTITION BY {partition} ORDER BY {order}) - 1 AS pos FROM ({rows}))"""


def _stratified_sql(profile: str) -> str:
    return _serpentine_sql(f"n_cells DESC, {md5_int(chr(39) + '42' + chr(39), 'group_id')}, group_id", "dominant", profile, "group_id, n_cells, dominant")


FINISHED_FOLDS_SQL = _stratified_sql(PROFILE_SQL.replace("FROM cells", "FROM cells WHERE status = 'F'"))
REPEATED_FOLDS_SQL = _serpentine_sql(
    f"n_cells DESC, {md5_int('CAST(repeat_seed AS VARCHAR)', 'group_id')}, group_id", "repeat_seed, dominant",
    f"SELECT * FROM ({PROFILE_SQL}), (SELECT CAST(unnest([101, 202, 303, 404, 505]) AS INTEGER) AS repeat_seed)", "repeat_seed, group_id, n_cells, dominant",
)
STRATUM_FOLDS_SQL = _serpentine_sql(
    f"n_cells DESC, {md5_int(chr(39) + 'size' + chr(39), 'group_id')}, group_id", "stratum",
    "SELECT stratum, group_id, count(*) AS n_cells FROM cells GROUP BY 1, 2", "stratum, group_id, n_cells",
)


@query("i09_stratified_group_folds", _stratified_sql(PROFILE_SQL))
def i09(spark, sf):
    return folds.stratified_group_folds(v.cells(spark, sf), "group_id", "stratum", 3)


@query("i09_repeated_folds", REPEATED_FOLDS_SQL)
def i09b(spark, sf):
    return folds.repeated_group_folds(v.cells(spark, sf), "group_id", "stratum", 3, [101, 202, 303, 404, 505])


@query("i10_size_balanced_folds", STRATUM_FOLDS_SQL)
def i10(spark, sf):
    return folds.size_balanced_folds(v.cells(spark, sf), ["stratum"], "group_id", 3)


@query(
    "i11_fixed_subset",
    f"""SELECT module, control_id, CAST(rn AS INTEGER) AS subset_rank FROM (SELECT module, control_id, row_number() OVER (PARTITION BY module ORDER BY {md5_int("'42'", "module", "CAST(control_id AS VARCHAR)")}, control_id) AS rn
    FROM control_perf) WHERE rn <= 50""",
)
def i11(spark, sf):
    return folds.fixed_subset(v.control_performance(spark, sf).select("module", "control_id"), ["module"], "control_id", 50)


@query(
    "i12_sample_per_group",
    f"""SELECT lang, doc_id, CAST(rn AS INTEGER) AS subset_rank FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {md5_int("'42'", "lang", "CAST(doc_id AS VARCHAR)")}, doc_id) AS rn
    FROM documents) WHERE rn <= 100""",
)
def i12(spark, sf):
    return folds.fixed_subset(table(spark, sf, "documents").select("lang", "doc_id"), ["lang"], "doc_id", 100)


COLUMNS = ["f1", "f2", "f3", "f4", "f5", "f6", "f7"]
LIST = ", ".join(f"'{c}'" for c in COLUMNS)
PAIR_SQL = f"""WITH w AS (SELECT cell_id, feature, x FROM cells UNPIVOT (x FOR feature IN ({", ".join(COLUMNS)}))),
    p AS (SELECT a.feature AS feature_1, b.feature AS feature_2, a.x AS a, b.x AS b FROM w a JOIN w b ON a.cell_id = b.cell_id AND a.feature < b.feature),
    r AS (SELECT *, rank() OVER (PARTITION BY feature_1, feature_2 ORDER BY a) + (count(*) OVER (PARTITION BY feature_1, feature_2, a) - 1) / 2.0 AS ra,
    rank() OVER (PARTITION BY feature_1, feature_2 ORDER BY b) + (count(*) OVER (PARTITION BY feature_1, feature_2, b) - 1) / 2.0 AS rb FROM p)
    SELECT feature_1, feature_2, corr(ra, rb) AS spearman_rho, corr(a, b) AS pearson_r, count(*) AS n_complete, bool_and(a = b) AS is_exact_duplicate FROM r GROUP BY 1, 2"""


@query("k01_pairwise_correlations", f"SELECT * FROM ({PAIR_SQL})", ["spearman_rho", "pearson_r"])
def k01(spark, sf):
    return corr.pairwise_correlations(v.cells(spark, sf), COLUMNS)


@query("k01_high_pairs", f"SELECT *, abs(spearman_rho) AS abs_rho FROM ({PAIR_SQL}) WHERE abs(spearman_rho) > 0.8", ["spearman_rho", "pearson_r", "abs_rho"])
def k01b(spark, sf):
    return corr.high_pairs(corr.pairwise_correlations(v.cells(spark, sf), COLUMNS), 0.8)


@query(
    "c11_rank_once_pairs",
    """WITH r AS (SELECT cell_id, feature, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS r FROM cells UNPIVOT (x FOR feature IN (f1, f2, f3, f4, f5)))
    SELECT a.feature AS feature_1, b.feature AS feature_2, corr(a.r, b.r) AS spearman_rho FROM r a JOIN r b ON a.cell_id = b.cell_id AND a.feature < b.feature GROUP BY 1, 2""",
    ["spearman_rho"],
)
def c11(spark, sf):
    """The columns without missing values: each is ranked once for all its pairs."""
    return corr.rank_gram_correlations(v.cells(spark, sf), ["f1", "f2", "f3", "f4", "f5"], "cell_id")


@query(
    "k02_duplicate_columns",
    "SELECT 'f1' AS feature_1, 'f7' AS feature_2, count(*) AS n_complete, CAST(0 AS BIGINT) AS n_missing FROM cells WHERE f1 IS NOT NULL",
)
def k02(spark, sf):
    return corr.duplicate_columns(v.cells(spark, sf), COLUMNS)


@query(
    "k03_correlation_components",
    f"""WITH RECURSIVE e AS (SELECT feature_1 AS a, feature_2 AS b FROM ({PAIR_SQL}) WHERE abs(spearman_rho) > 0.8), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    walk AS (SELECT f AS node, f AS label FROM (SELECT unnest([{LIST}]) AS f) UNION SELECT u.b, w.label FROM walk w JOIN u ON u.a = w.node),
    l AS (SELECT node, min(label) AS label FROM walk GROUP BY 1)
    SELECT 'C' || lpad(CAST(d AS VARCHAR), CAST(greatest(2, length(CAST(d AS VARCHAR))) AS INTEGER), '0') AS component_id, node AS feature, count(*) OVER (PARTITION BY label) AS component_size,
    string_agg(node, '|') OVER (PARTITION BY label ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS members FROM (SELECT *, dense_rank() OVER (ORDER BY label) AS d FROM l)""",
)
def k03(spark, sf):
    return corr.feature_components(v.cells(spark, sf), COLUMNS, 0.8)


@query(
    "k03_group_components",
    """WITH RECURSIVE e AS (SELECT DISTINCT 'c' || CAST(c_nationkey AS VARCHAR) AS a, 's' || CAST(s_nationkey AS VARCHAR) AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
    JOIN supplier ON s_suppkey = l_suppkey), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    walk AS (SELECT a AS node, a AS label FROM u UNION SELECT u.b, w.label FROM walk w JOIN u ON u.a = w.node)
    SELECT node, min(label) AS label FROM walk GROUP BY 1""",
)
def k03b(spark, sf):
    """Components of the graph of customer and supplier nations joined by their lines."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    buyers = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.concat(F.lit("c"), v.text("c_nationkey")).alias("a")
    )
    sellers = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("s"), v.text("s_nationkey")).alias("b"))
    edges = lines.join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
    edges = edges.select("a", "b").distinct()
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    return corr.connected_components(nodes, edges)


VARIANT_SQL = """WITH z AS (SELECT module, fold, cell_id, stratum, y_true AS y, f1 AS a, f4 AS b FROM long_targets),
    c AS (SELECT k, module, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS bby FROM z, folds3 WHERE fold <> k GROUP BY 1, 2),
    q AS (SELECT *, (ay * bb - bby * ab) / (aa * bb - ab * ab) AS b1, (bby * aa - ay * ab) / (aa * bb - ab * ab) AS b2 FROM c),
    h AS (SELECT k, module, stratum, avg(y) AS m FROM z, folds3 WHERE fold <> k GROUP BY 1, 2, 3),
    v AS (SELECT cell_id, module AS target, 'raw' AS variant, y AS value FROM z
    UNION ALL SELECT cell_id, z.module, 'adjusted', y - (my - b1 * ma - b2 * mb) - b1 * a - b2 * b FROM z JOIN q ON q.k = z.fold AND q.module = z.module
    UNION ALL SELECT cell_id, z.module, 'stratum_centred', y - m FROM z JOIN h ON h.k = z.fold AND h.module = z.module AND h.stratum = z.stratum)"""
MATRIX_SQL = VARIANT_SQL + """, r AS (SELECT *, rank() OVER (PARTITION BY variant, target ORDER BY value) + (count(*) OVER (PARTITION BY variant, target, value) - 1) / 2.0 AS r FROM v)
    SELECT a.variant, a.target AS target_1, b.target AS target_2, corr(a.r, b.r) AS rho FROM r a JOIN r b ON a.variant = b.variant AND a.cell_id = b.cell_id GROUP BY 1, 2, 3"""


def target_matrix(spark, sf):
    rows = v.long_targets(spark, sf).select(
        "cell_id", "stratum", "fold", "f1", "f4", F.col("module").alias("target"), F.col("y_true").alias("y")
    )
    variants = corr.target_variants(rows, "stratum", ("f1", "f4"))
    return v.staged(spark, sf, "target_matrix", lambda: corr.target_correlations(variants, v.TARGETS))


@query("k04_target_correlations", f"SELECT * FROM ({MATRIX_SQL})", ["rho"])
def k04(spark, sf):
    return target_matrix(spark, sf)


@query(
    "k05_matrix_summary",
    f"""SELECT variant, count(DISTINCT target_1) AS size, 0.0 AS max_asymmetry, 0.0 AS max_diagonal_error,
    sum(CASE WHEN target_1 = target_2 THEN rho END) ** 2 / sum(rho * rho) AS participation_ratio FROM ({MATRIX_SQL}) GROUP BY 1""",
    ["max_asymmetry", "max_diagonal_error", "participation_ratio"],
)
def k05(spark, sf):
    return corr.matrix_summary(target_matrix(spark, sf), ["variant"], "target_1", "target_2", "rho")


@query("k05_eigenvalues")
def k05b(spark, sf):
    return corr.matrix_eigenvalues(target_matrix(spark, sf), "variant", "target_1", "target_2", "rho")


SPLIT_SQL = """WITH s AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY gene) - 1 AS i, count(*) OVER (PARTITION BY module) AS n FROM present),
    d AS (SELECT e.sample_id, s.module, s.i, s.n, CAST(CAST(e.x AS FLOAT) AS DOUBLE) AS x FROM dense e JOIN s ON s.module = e.module AND s.gene = e.gene),
    m AS (SELECT unnest(range(0, 256)) AS mask),
    h AS (SELECT module, mask, sample_id, sum(CASE WHEN (mask >> i) & 1 = 1 THEN x ELSE 0 END) / (n // 2) AS a, sum(CASE WHEN (mask >> i) & 1 = 0 THEN x ELSE 0 END) / (n - n // 2) AS b
    FROM d, m WHERE mask < (1 << n) AND bit_count(mask) = n // 2 AND (n % 2 = 1 OR mask % 2 = 1) GROUP BY module, mask, sample_id, n),
    r AS (SELECT *, rank() OVER (PARTITION BY module, mask ORDER BY a) + (count(*) OVER (PARTITION BY module, mask, a) - 1) / 2.0 AS ra,
    rank() OVER (PARTITION BY module, mask ORDER BY b) + (count(*) OVER (PARTITION BY module, mask, b) - 1) / 2.0 AS rb FROM h),
    t AS (SELECT module, mask, corr(ra, rb) AS rho, 2 * corr(ra, rb) / (1 + corr(ra, rb)) AS sb FROM r GROUP BY 1, 2)
    SELECT module, count(*) AS partition_n, quantile_cont(rho, 0.25) AS q1_rho, quantile_cont(rho, 0.5) AS median_rho, quantile_cont(rho, 0.75) AS q3_rho, quantile_cont(sb, 0.25) AS q1_sb, quantile_cont(sb, 0.5) AS median_sb,
    quantile_cont(sb, 0.75) AS q3_sb, min(rho) AS min_rho, max(rho) AS max_rho, min(sb) AS min_sb, max(sb) AS max_sb FROM t GROUP BY 1"""
SPLIT_DOUBLES = [f"{q}_{c}" for c in ("rho", "sb") for q in ("q1", "median", "q3", "min", "max")]


def observed_reliability(spark, sf):
    counts, library = v.counts(spark, sf), v.library(spark, sf)
    present = genesets.present_members(v.requested(spark, sf), counts).select("module", "gene")
    return reliability.reliability(genesets.long_expression(counts, library), present, library, ["module"], 100)


@query("k06_split_half", f"SELECT * FROM ({SPLIT_SQL})", SPLIT_DOUBLES)
def k06(spark, sf):
    return observed_reliability(spark, sf).select("module", "partition_n", *SPLIT_DOUBLES)


@query(
    "k06_score_variance",
    """SELECT module, genes, set_signature, var_pop(score) AS score_variance FROM (SELECT module, sample_id, sum(CAST(CAST(x AS FLOAT) AS DOUBLE)) / count(*) AS score FROM dense GROUP BY 1, 2)
    JOIN (SELECT module, string_agg(gene, '|' ORDER BY gene) AS genes, sha256(string_agg(gene, chr(10) ORDER BY gene)) AS set_signature FROM present GROUP BY 1) USING (module) GROUP BY 1, 2, 3""",
    ["score_variance"],
)
def k06b(spark, sf):
    counts, library = v.counts(spark, sf), v.library(spark, sf)
    present = genesets.present_members(v.requested(spark, sf), counts).select("module", "gene")
    return reliability.set_spread(genesets.long_expression(counts, library), present, library, ["module"])


def control_reliability(spark, sf):
    counts, library = v.counts(spark, sf), v.library(spark, sf)
    sets = matching.set_weights(matched(spark, sf)).select("module", "control_id", "gene")
    return v.staged(
        spark, sf, "control_reliability",
        lambda: reliability.reliability(genesets.long_expression(counts, library), sets, library, ["module", "control_id"], 20),
    )


@query("k07_control_reliability")
def k07(spark, sf):
    return reliability.reliability_percentile(control_reliability(spark, sf), observed_reliability(spark, sf))


@query(
    "k08_reliability_context",
    """WITH sb AS (SELECT l_returnflag AS module, l_suppkey AS control_id, CAST(count(DISTINCT l_partkey) AS DOUBLE) / count(*) AS median_sb FROM lineitem GROUP BY 1, 2),
    o AS (SELECT o.module, observed AS observed_r2, s AS observed_sb, observed / s AS observed_ratio FROM observed_perf o JOIN (SELECT module, avg(median_sb) AS s FROM sb GROUP BY 1) a ON a.module = o.module),
    r AS (SELECT c.module, r2 / median_sb AS ratio FROM control_perf c JOIN sb ON sb.module = c.module AND sb.control_id = c.control_id)
    SELECT o.*, count(ratio) AS control_valid_n, 100.0 * sum(CASE WHEN ratio <= observed_ratio THEN 1 ELSE 0 END) / count(ratio) AS percentile FROM o JOIN r ON r.module = o.module GROUP BY ALL""",
    ["observed_r2", "observed_sb", "observed_ratio", "percentile"],
)
def k08(spark, sf):
    """The share of distinct parts among a supplier's lines stands in for reliability."""
    sb = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("module"), F.col("l_suppkey").alias("control_id")).agg(
        (F.count_distinct("l_partkey").cast("double") / F.count(F.lit(1))).alias("median_sb")
    )
    seen = v.observed_performance(spark, sf).withColumnRenamed("observed", "observed_r2").join(
        sb.groupBy("module").agg(F.avg("median_sb").alias("observed_sb")), "module"
    )
    return reliability.reliability_context(v.control_performance(spark, sf), sb, seen)


@query(
    "c12_performance_with_reliability",
    """SELECT c.module, c.control_id, c.r2, 2 * sqrt(c.r2) / (1 + sqrt(c.r2)) AS sb, o.observed FROM control_perf c JOIN observed_perf o ON o.module = c.module""",
    ["r2", "sb", "observed"],
)
def c12(spark, sf):
    perf = v.control_performance(spark, sf)
    sb = perf.select("module", "control_id", spearman_brown(F.sqrt("r2")).alias("sb"))
    return perf.join(sb, ["module", "control_id"]).join(v.observed_performance(spark, sf), "module")
