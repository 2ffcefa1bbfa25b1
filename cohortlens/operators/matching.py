"""Matched control sets: candidate pools, proposals, acceptance and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.functions.rng import pick
from cohortlens.functions.text import set_signature
from cohortlens.operators.ranks import top_k
from cohortlens.session import cut_lineage


def standardised_genes(qc: DataFrame) -> DataFrame:
    """(gene, candidate_eligible, zx, zd): mean and detection as z-scores of the eligible genes."""
    eligible = qc.filter("candidate_eligible")
    stats = eligible.agg(
        F.struct(
            F.avg("mean_log2cpm").alias("mx"),
            F.stddev_pop("mean_log2cpm").alias("sx"),
            F.avg("detection_rate").alias("md"),
            F.stddev_pop("detection_rate").alias("sd"),
        )
    ).scalar()
    s = F.col("_stats")
    return qc.withColumn("_stats", stats).select(
        "gene",
        "candidate_eligible",
        F.try_divide(F.col("mean_log2cpm") - s["mx"], s["sx"]).alias("zx"),
        F.try_divide(F.col("detection_rate") - s["md"], s["sd"]).alias("zd"),
    )


def radius_pairs(targets: DataFrame, candidates: DataFrame, radius: float) -> DataFrame:
    """Candidates within a Euclidean radius of each target, by an equi-join on grid cells.

    targets (module, target_gene, tx, td), candidates (gene, zx, zd). Cells are a touch wider than the
    radius, so every partner lies in one of the nine cells around the target.
    """
    width = radius * 1.0001
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])

    def cell(x: str) -> Column:
        return F.floor(F.col(x) / width)

    spread = targets.withColumn("_o", F.explode(around)).withColumns(
        {"_cx": cell("tx") + F.col("_o.i"), "_cd": cell("td") + F.col("_o.j")}
    ).drop("_o")
    gridded = candidates.withColumns({"_cx": cell("zx"), "_cd": cell("zd")})
    dx, dd = F.col("zx") - F.col("tx"), F.col("zd") - F.col("td")
    return (
        spread.join(gridded, ["_cx", "_cd"])
        .withColumn("distance", F.sqrt(dx * dx + dd * dd))
        .filter(F.col("distance") <= radius)
        .drop("_cx", "_cd")
    )


def candidate_pools(z: DataFrame, membership: DataFrame, radius: float, neighbours: int = 128) -> DataFrame:
    """(module, target_gene, tx, td, gene, zx, zd, distance, pool_rank): the nearest eligible candidates."""
    targets = membership.join(z, "gene").select(
        "module", F.col("gene").alias("target_gene"), F.col("zx").alias("tx"), F.col("zd").alias("td")
    )
    candidates = z.filter("candidate_eligible").select("gene", "zx", "zd")
    pairs = radius_pairs(targets, candidates, radius)
    return top_k(pairs, ["module", "target_gene"], [F.col("distance"), F.col("gene")], neighbours, "pool_rank")


def pool_shortfalls(z: DataFrame, membership: DataFrame, pools: DataFrame) -> DataFrame:
    """Targets whose pool is smaller than their module: no control set can be drawn for that module."""
    present = membership.join(z.select("gene"), "gene").select("module", F.col("gene").alias("target_gene"))
    sizes = present.groupBy("module").agg(F.count(F.lit(1)).alias("module_size"))
    pooled = pools.groupBy("module", "target_gene").agg(F.count(F.lit(1)).alias("pool_size"))
    return (
        present.join(sizes, "module")
        .join(pooled, ["module", "target_gene"], "left")
        .withColumn("pool_size", F.coalesce("pool_size", F.lit(0)))
        .filter(F.col("pool_size") < F.col("module_size"))
    )


def packed_pools(z: DataFrame, membership: DataFrame, pools: DataFrame) -> DataFrame:
    """One row per drawable module with its targets, smallest pool first; pools hold at most `neighbours`."""
    entry = F.struct("pool_rank", "gene", "distance", "zx", "zd")
    per_target = pools.groupBy("module", "target_gene", "tx", "td").agg(
        F.count(F.lit(1)).cast("int").alias("pool_size"), F.array_sort(F.collect_list(entry)).alias("pool")
    )
    blocked = pool_shortfalls(z, membership, pools).select("module").distinct()
    order = F.struct("pool_size", "target_gene", "tx", "td", "pool")
    return (
        per_target.join(blocked, "module", "left_anti")
        .groupBy("module")
        .agg(F.array_sort(F.collect_list(order)).alias("targets"))
    )


def propose(jobs: DataFrame, seed: int) -> DataFrame:
    """Draws one candidate per target without replacement for each (module, control_id, proposal) row.

    jobs also carries `targets` from packed_pools. The state of the fold is the short list of picks.
    """
    start = F.array().cast("array<struct<target_gene:string,gene:string,distance:double,tx:double,td:double,zx:double,zd:double,pool_size:int>>")

    def bind(value: Column, use) -> Column:
        """Evaluates value once and hands it to use."""
        return F.transform(F.array(value), use)[0]

    def draw(picked: Column, target: Column) -> Column:
        def choose_from(free: Column) -> Column:
            at = pick(
                F.greatest(F.size(free), F.lit(1)), seed, F.col("module"), F.col("control_id"), F.col("proposal"),
                target["target_gene"],
            )
            return F.get(free, at.cast("int"))

        def without(used: Column) -> Column:
            return bind(F.filter(target["pool"], lambda c: ~F.array_contains(used, c["gene"])), choose_from)

        chosen = bind(F.transform(picked, lambda q: q["gene"]), without)
        made = bind(
            chosen,
            lambda c: F.struct(
                target["target_gene"].alias("target_gene"),
                c["gene"].alias("gene"),
                c["distance"].alias("distance"),
                target["tx"].alias("tx"),
                target["td"].alias("td"),
                c["zx"].alias("zx"),
                c["zd"].alias("zd"),
                target["pool_size"].alias("pool_size"),
            ),
        )
        return F.concat(picked, F.array(made))

    return jobs.select("module", "control_id", "proposal", F.aggregate("targets", start, draw).alias("picks"))


def score_proposals(
    proposals: DataFrame,
    max_distance: float = 0.50,
    max_mean_distance: float = 0.25,
    max_expression: float = 0.10,
    max_detection: float = 0.10,
) -> DataFrame:
    """Adds the four quality metrics, the set signature and whether the proposal passes."""

    def total(field) -> Column:
        return F.aggregate("picks", F.lit(0.0), lambda a, q: a + field(q))

    n = F.size("picks")
    return (
        proposals.withColumns(
            {
                "n_genes": n.cast("bigint"),
                "mean_distance": total(lambda q: q["distance"]) / n,
                "max_distance": F.array_max(F.transform("picks", lambda q: q["distance"])),
                "expression_difference": total(lambda q: q["zx"]) / n - total(lambda q: q["tx"]) / n,
                "detection_difference": total(lambda q: q["zd"]) / n - total(lambda q: q["td"]) / n,
                "set_signature": set_signature(F.transform("picks", lambda q: q["gene"])),
            }
        )
        .withColumn(
            "matching_pass",
            F.coalesce(
                ~F.exists("picks", lambda q: q["gene"].isNull())
                & (F.col("mean_distance") <= max_mean_distance)
                & (F.col("max_distance") <= max_distance)
                & (F.abs("expression_difference") <= max_expression)
                & (F.abs("detection_difference") <= max_detection),
                F.lit(False),
            ),
        )
    )


def proposal_jobs(packed: DataFrame, n_controls: int, first: int, last: int) -> DataFrame:
    return packed.withColumn("control_id", F.explode(F.sequence(F.lit(0), F.lit(n_controls - 1)))).withColumn(
        "proposal", F.explode(F.sequence(F.lit(first), F.lit(last)))
    )


def _settle(passing: DataFrame) -> DataFrame:
    """First passing proposal per control; of two controls with one signature the later moves on."""
    open_rows = passing
    while True:
        firsts = top_k(open_rows, ["module", "control_id"], [F.col("proposal")], 1, "_rn").drop("_rn")
        owner = W.partitionBy("module", "set_signature").orderBy("control_id")
        marked = cut_lineage(firsts.withColumn("_place", F.row_number().over(owner)))
        losers = marked.filter(F.col("_place") > 1).select("module", "control_id", "proposal")
        if losers.isEmpty():
            return marked.drop("_place")
        open_rows = cut_lineage(open_rows.join(losers, ["module", "control_id", "proposal"], "left_anti"))


def matched_sets(
    z: DataFrame,
    membership: DataFrame,
    n_controls: int,
    radius: float = 0.50,
    neighbours: int = 128,
    max_attempts: int = 200,
    wave: int = 16,
    seed: int = 42,
    **limits: float,
) -> DataFrame:
    """Accepted control sets (module, control_id, proposal, picks, metrics, set_signature).

    Proposals are drawn in growing waves; only controls without a set go to the next one. Controls that fail
    all attempts are absent and show up in `failed_controls`.
    """
    packed = cut_lineage(packed_pools(z, membership, candidate_pools(z, membership, radius, neighbours)))
    jobs = packed.withColumn("control_id", F.explode(F.sequence(F.lit(0), F.lit(n_controls - 1))))
    passing, pending, first = None, jobs, 0
    while True:
        last = min(first + wave, max_attempts) - 1
        rows = pending.withColumn("proposal", F.explode(F.sequence(F.lit(first), F.lit(last))))
        rows = rows.repartition("module", "control_id")
        drawn = score_proposals(propose(rows, seed), max_distance=radius, **limits).filter("matching_pass")
        drawn = cut_lineage(drawn)
        passing = drawn if passing is None else passing.unionByName(drawn)
        settled = _settle(passing)
        pending = jobs.join(settled.select("module", "control_id"), ["module", "control_id"], "left_anti")
        first, wave = last + 1, wave * 4
        if first >= max_attempts or pending.isEmpty():
            return settled


def failed_controls(packed: DataFrame, settled: DataFrame, n_controls: int) -> DataFrame:
    every = packed.select("module").withColumn("control_id", F.explode(F.sequence(F.lit(0), F.lit(n_controls - 1))))
    return every.join(settled, ["module", "control_id"], "left_anti")


def assignments(settled: DataFrame) -> DataFrame:
    """One row per control and target with both z-coordinates, their differences and the distance."""
    return settled.select("module", "control_id", F.explode("picks").alias("q")).select(
        "module",
        "control_id",
        "q.target_gene",
        F.col("q.gene").alias("control_gene"),
        F.col("q.tx").alias("target_zx"),
        F.col("q.td").alias("target_zd"),
        F.col("q.zx").alias("control_zx"),
        F.col("q.zd").alias("control_zd"),
        (F.col("q.zx") - F.col("q.tx")).alias("delta_zx"),
        (F.col("q.zd") - F.col("q.td")).alias("delta_zd"),
        "q.distance",
        F.col("q.pool_size").cast("bigint").alias("pool_size"),
    )


def set_weights(settled: DataFrame) -> DataFrame:
    """(module, control_id, gene, weight) for control_targets."""
    return settled.select("module", "control_id", "n_genes", F.explode("picks").alias("q")).select(
        "module", "control_id", F.col("q.gene").alias("gene"), (F.lit(1.0) / F.col("n_genes")).alias("weight")
    )


def matching_diagnostics(settled: DataFrame) -> DataFrame:
    """Per module: sets, distances, largest differences and proposals rejected on the way."""
    return settled.groupBy("module").agg(
        F.count(F.lit(1)).alias("n_controls"),
        F.count_if("matching_pass").alias("n_passed"),
        F.avg("mean_distance").alias("mean_distance"),
        F.max("max_distance").alias("max_distance"),
        F.max(F.abs("expression_difference")).alias("max_abs_expression_difference"),
        F.max(F.abs("detection_difference")).alias("max_abs_detection_difference"),
        F.sum("proposal").alias("rejected_proposals"),
    )


def duplicate_signatures(settled: DataFrame, minimum_pass: float = 1.0) -> DataFrame:
    """Per module: repeated signatures and whether enough sets pass."""
    per = settled.groupBy("module", "set_signature").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("matching_pass").alias("_ok")
    )
    share = F.try_divide(F.sum("_ok").cast("double"), F.sum("_n"))
    return per.groupBy("module").agg(
        F.count_if(F.col("_n") > 1).alias("n_repeated_signatures"),
        share.alias("pass_fraction"),
        (share >= minimum_pass).alias("gate_ok"),
    )
