"""The stand-in views once more as SQL text, written independently of the Spark code they check."""

from __future__ import annotations

import re

VIEWS = {
    "counts": """SELECT CAST(l_suppkey AS VARCHAR) AS sample_id, p_brand || '|' || CAST(p_size AS VARCHAR) AS gene,
        CAST(sum(l_quantity) AS BIGINT) AS cnt FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "library": "SELECT CAST(l_suppkey AS VARCHAR) AS sample_id, CAST(sum(l_quantity) AS BIGINT) AS lib FROM lineitem GROUP BY 1",
    "expression": """SELECT c.sample_id, c.gene, c.cnt, log2(CAST(c.cnt AS DOUBLE) / CAST(l.lib AS DOUBLE) * CAST(1e6 AS DOUBLE) + 1) AS x
        FROM counts c JOIN library l ON c.sample_id = l.sample_id""",
    "requested": """SELECT b.p_brand AS module, b.p_brand || '|' || CAST(s.i AS VARCHAR) AS gene, CAST(s.i AS INTEGER) AS ordinal
        FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand IN ('Brand#1','Brand#2','Brand#3','Brand#4','Brand#5','Brand#6')) b,
        (SELECT unnest(range(1, 9)) AS i) s""",
    "present": "SELECT * FROM requested WHERE gene IN (SELECT gene FROM counts)",
    "dense": """SELECT l.sample_id, p.module, p.gene, coalesce(c.cnt, 0) AS cnt, coalesce(c.x, 0.0) AS x
        FROM library l CROSS JOIN present p LEFT JOIN expression c ON c.sample_id = l.sample_id AND c.gene = p.gene""",
    "every_set": """SELECT b.p_brand AS module, b.p_brand || '|' || CAST(s.i AS VARCHAR) AS gene, CAST(s.i AS INTEGER) AS ordinal
        FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL) b, (SELECT unnest(range(1, CAST((SELECT max(p_size) FROM part) AS INTEGER) + 1)) AS i) s""",
    "every_present": "SELECT * FROM every_set WHERE gene IN (SELECT gene FROM counts)",
    "every_dense": """SELECT l.sample_id, p.module, p.gene, coalesce(c.cnt, 0) AS cnt, coalesce(c.x, 0.0) AS x
        FROM library l CROSS JOIN every_present p LEFT JOIN expression c ON c.sample_id = l.sample_id AND c.gene = p.gene""",
    "qc": """SELECT g.gene, CAST(sum(CASE WHEN cnt > 0 THEN 1 ELSE 0 END) AS BIGINT) AS detected_n, avg(x) AS mean_log2cpm,
        avg(CASE WHEN cnt > 0 THEN 1.0 ELSE 0.0 END) AS detection_rate, var_pop(x) AS variance_log2cpm
        FROM (SELECT l.sample_id, g.gene, coalesce(e.cnt, 0) AS cnt, coalesce(e.x, 0.0) AS x
              FROM library l CROSS JOIN (SELECT DISTINCT gene FROM counts) g
              LEFT JOIN expression e ON e.sample_id = l.sample_id AND e.gene = g.gene) g GROUP BY 1""",
    "gene_table": """SELECT q.*, q.gene IN (SELECT gene FROM requested) AS is_requested,
        coalesce((SELECT string_agg(DISTINCT r.module, ';' ORDER BY r.module) FROM requested r WHERE r.gene = q.gene), '') AS modules,
        CASE WHEN variance_log2cpm <= 1e-12 THEN 'zero_variance' WHEN detection_rate <= 0 THEN 'zero_detection'
             WHEN q.gene = 'Brand#7|1' THEN 'alias_audit_gene'
             WHEN q.gene IN (SELECT gene FROM requested) THEN 'primary_module_gene' ELSE '' END AS exclusion_reason FROM qc q""",
    "zgenes": """SELECT gene, exclusion_reason = '' AS candidate_eligible,
        (mean_log2cpm - (SELECT avg(mean_log2cpm) FROM gene_table WHERE exclusion_reason = '')) / (SELECT stddev_pop(mean_log2cpm) FROM gene_table WHERE exclusion_reason = '') AS zx,
        (detection_rate - (SELECT avg(detection_rate) FROM gene_table WHERE exclusion_reason = '')) / (SELECT stddev_pop(detection_rate) FROM gene_table WHERE exclusion_reason = '') AS zd
        FROM gene_table""",
    "order_lines": """SELECT l_orderkey, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS qty,
        CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents,
        CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS disc,
        CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS tax,
        CAST(sum(CAST(round(p_retailprice * 100) AS BIGINT)) AS BIGINT) AS list,
        max(l_quantity) AS maxq, min(l_quantity) AS minq FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""",
    "cells": """SELECT CAST(o_orderkey AS VARCHAR) AS cell_id, CAST(o_custkey AS VARCHAR) AS group_id, o_orderpriority AS stratum,
        o_orderstatus AS status, CAST(qty AS DOUBLE) AS f1, CAST(disc AS DOUBLE) / CAST(n AS DOUBLE) AS f2,
        CAST(tax AS DOUBLE) / CAST(n AS DOUBLE) AS f3, CAST(n AS DOUBLE) AS f4, maxq AS f5,
        CASE WHEN n > 1 THEN maxq - minq END AS f6, CAST(qty AS DOUBLE) AS f7,
        ln(CAST(cents AS DOUBLE) / CAST(100.0 AS DOUBLE)) AS line_value,
        CAST(list AS DOUBLE) / CAST(n AS DOUBLE) / CAST(100.0 AS DOUBLE) AS list_price, ln(o_totalprice) AS order_total,
        CAST(('0x' || substr(md5(concat_ws('|', '42', CAST(o_custkey AS VARCHAR))), 1, 8))::BIGINT % 3 AS INTEGER) AS fold
        FROM orders JOIN order_lines ON o_orderkey = l_orderkey""",
    "long_targets": """SELECT cell_id, group_id, stratum, status, fold, f1, f4, module, y_true FROM cells
        UNPIVOT (y_true FOR module IN (line_value, list_price, order_total))""",
    "folds3": "SELECT unnest(range(0, 3))::INTEGER AS k",
    "oof_mean": """SELECT t.*, m.y_pred FROM long_targets t JOIN (
        SELECT k, module, avg(y_true) AS y_pred FROM long_targets, folds3 WHERE fold <> k GROUP BY 1, 2) m
        ON m.k = t.fold AND m.module = t.module""",
    "ols_coef": """SELECT k, module, regr_slope(y_true, f1) AS slope, regr_intercept(y_true, f1) AS intercept
        FROM long_targets, folds3 WHERE fold <> k GROUP BY 1, 2""",
    "oof_ols": """SELECT t.*, m.intercept + m.slope * t.f1 AS y_pred FROM long_targets t JOIN ols_coef m
        ON m.k = t.fold AND m.module = t.module""",
    "ridge_sums": """SELECT k, module, stratum, sum(y_true) AS s, CAST(count(*) AS DOUBLE) AS n
        FROM long_targets, folds3 WHERE fold <> k GROUP BY 1, 2, 3""",
    "ridge_base": """SELECT k, module, (sum(s) - sum(s * n / (n + 1))) / (sum(n) - sum(n * n / (n + 1))) AS b FROM ridge_sums GROUP BY 1, 2""",
    "oof_stratum": """SELECT t.*, coalesce(b.b + (r.s - r.n * b.b) / (r.n + 1), b.b) AS y_pred FROM long_targets t
        JOIN ridge_base b ON b.k = t.fold AND b.module = t.module
        LEFT JOIN ridge_sums r ON r.k = t.fold AND r.module = t.module AND r.stratum = t.stratum""",
    "oof": """SELECT cell_id, group_id, stratum, status, fold, module, 'mean' AS model, 'dummy' AS analysis, y_true, y_pred FROM oof_mean
        UNION ALL SELECT cell_id, group_id, stratum, status, fold, module, 'ols', 'features_only', y_true, y_pred FROM oof_ols
        UNION ALL SELECT cell_id, group_id, stratum, status, fold, module, 'stratum', 'stratum_only', y_true, y_pred FROM oof_stratum""",
    "pairs": """SELECT a.module, a.cell_id, a.group_id, a.stratum, a.fold, a.y_true, a.y_pred AS y_pred_a, b.y_pred AS y_pred_b
        FROM oof_ols a JOIN oof_mean b ON a.cell_id = b.cell_id AND a.module = b.module""",
    "ranked_oof": """SELECT *, rank() OVER (PARTITION BY module, model ORDER BY y_true) + (count(*) OVER (PARTITION BY module, model, y_true) - 1) / 2.0 AS ry,
        rank() OVER (PARTITION BY module, model ORDER BY y_pred) + (count(*) OVER (PARTITION BY module, model, y_pred) - 1) / 2.0 AS rp FROM oof""",
    "perf": """SELECT module, model, analysis, count(*) AS n, 1 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(*)) AS r2,
        avg(abs(y_true - y_pred)) AS mae, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse, corr(ry, rp) AS spearman
        FROM ranked_oof GROUP BY 1, 2, 3""",
    "control_perf": """SELECT l_returnflag AS module, l_suppkey AS control_id, pow(covar_samp(l_quantity, l_extendedprice) / (stddev_samp(l_quantity) * stddev_samp(l_extendedprice)), 2) AS r2
        FROM lineitem GROUP BY 1, 2""",
    "observed_perf": """SELECT l_returnflag AS module, pow(corr(l_quantity, l_extendedprice), 2) AS observed
        FROM lineitem GROUP BY 1""",
    "specificity": """SELECT c.module, o.observed, count(*) AS control_n, CAST(sum(CASE WHEN r2 >= observed THEN 1 ELSE 0 END) AS BIGINT) AS extreme_count,
        100.0 * sum(CASE WHEN r2 <= observed THEN 1 ELSE 0 END) / count(*) AS observed_percentile,
        quantile_cont(r2, 0.5) AS control_median, quantile_cont(r2, 0.9) AS control_p90, quantile_cont(r2, 0.95) AS control_p95, quantile_cont(r2, 0.99) AS control_p99,
        (1.0 + sum(CASE WHEN r2 >= observed THEN 1 ELSE 0 END)) / (count(*) + 1) AS raw_p
        FROM control_perf c JOIN observed_perf o ON c.module = o.module GROUP BY 1, 2""",
    "vectors": """SELECT vec_id, label, CAST(i - 1 AS INTEGER) AS i, CAST(embedding[i] AS DOUBLE) AS x
        FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""",
    "curves": """SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step, value AS loss FROM events""",
    "group_slots": """SELECT group_id, row_number() OVER (ORDER BY ('0x' || substr(md5(concat_ws('|', '42', group_id)), 1, 8))::BIGINT, group_id) - 1 AS slot,
        count(*) OVER () AS n_groups FROM (SELECT DISTINCT group_id FROM cells)""",
    "plan20": """SELECT r AS replicate, ('0x' || substr(md5(concat_ws('|', '42', CAST(r AS VARCHAR), CAST(slot AS VARCHAR))), 1, 8))::BIGINT % n_groups AS slot
        FROM group_slots, (SELECT CAST(unnest(range(0, 20)) AS INTEGER) AS r)""",
    "weights20": """SELECT p.replicate, g.group_id, count(*) AS w FROM plan20 p JOIN group_slots g ON g.slot = p.slot GROUP BY 1, 2""",
    "plan5000": """SELECT r AS replicate, ('0x' || substr(md5(concat_ws('|', '42', CAST(r AS VARCHAR), CAST(slot AS VARCHAR))), 1, 8))::BIGINT % n_groups AS slot
        FROM group_slots, (SELECT CAST(unnest(range(0, 5000)) AS INTEGER) AS r)""",
    "weights5000": """SELECT p.replicate, g.group_id, count(*) AS w FROM plan5000 p JOIN group_slots g ON g.slot = p.slot GROUP BY 1, 2""",
}


def _used(text: str) -> list[str]:
    words = set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", text))
    return [v for v in VIEWS if v in words]


def with_views(body: str) -> str:
    """Puts the views a statement names, and those they name, in front of it."""
    needed: list[str] = []

    def add(name: str) -> None:
        if name in needed:
            return
        for other in _used(VIEWS[name]):
            if other != name:
                add(other)
        needed.append(name)

    for view in _used(body):
        add(view)
    if not needed:
        return body
    heads = ",\n".join(f"{v} AS MATERIALIZED ({VIEWS[v]})" for v in needed)
    if re.match(r"\s*WITH\s", body, re.I):
        body = f"SELECT * FROM ({body}) AS w"
    return f"WITH {heads}\n{body}"
