import hashlib
import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from cohortlens.functions import rng
from cohortlens.operators import permute, resample


def h32(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def test_hashes_of_arrays_equal_md5():
    texts = ["", "a", "é" * 5, None, "x" * 51, "x" * 52, "y" * 70, *[str(i * 7919) for i in range(300)]]
    want = [h32("7|3") if t is None else h32("7|3", t) for t in texts]
    assert rng.hash32_texts("7|3", pa.array(texts)).tolist() == want
    assert rng.hash32_texts("7|3", pa.array(texts)[3:9]).tolist() == want[3:9]
    assert rng.hash32_numbers("42|5", 7, 1203).tolist() == [h32(42, 5, i) for i in range(7, 1203)]
    assert rng.hash32_numbers("x" * 60, 98, 102).tolist() == [h32("x" * 60, i) for i in range(98, 102)]


def test_products_equal_sorting_by_hash_and_id(spark, monkeypatch):
    monkeypatch.setattr(permute, "RANGE_ROWS", 40)
    deal = random.Random(3)
    rows = [(m, "AB"[deal.randrange(2)], f"c{i}", deal.randrange(-9, 10), deal.randrange(-70000, 70000)) for m in ("m", "n") for i in range(330)]
    rows += [("m", None, "z", 1, 1), (None, "A", "z", 1, 1), ("m", "A", "null", None, 5)]
    df = spark.createDataFrame(rows, "m string, s string, c string, x long, z long").repartition(7)
    got = {(r["m"], r["iteration"]): r["dot"] for r in permute.permuted_products(df, ["m"], "s", "c", F.col("x"), F.col("z"), 4, 11).collect()}
    want = {}
    for m in ("m", "n"):
        for t in range(4):
            total = 0
            for s in "AB":
                own = [r for r in rows if r[:2] == (m, s)]
                moved = sorted(own, key=lambda r: (h32(11, t, r[2]), r[2]))
                slots = sorted(own, key=lambda r: (h32(11, "slot", r[2]), r[2]))
                total += sum((x[3] or 0) * z[4] for x, z in zip(moved, slots, strict=True))
            want[m, t] = total
    assert got == want


def test_rows_of_equal_hash_follow_in_the_order_of_their_ids(spark):
    df = spark.range(600).select(F.lit(1).cast("long").alias("_k"), F.lit(3).alias("_parts"), F.md5(F.col("id").cast("string")).alias("_cell"), F.col("id").alias("_a"), (-F.col("id")).alias("_b"))
    blocks = permute._blocks(df.repartition(9))
    held = [permute._Block(r.asDict()) for r in blocks.orderBy("_b").collect()]
    assert len({x.place for x in held}) == len(held)
    ids = [t for x in held for t in x.texts.to_pylist()]
    assert ids == sorted(ids) and len(ids) == 600 and all(ids[i] == hashlib.md5(str(a).encode()).hexdigest() for i, a in enumerate(np.concatenate([x.a for x in held])))
    same = np.zeros(2, np.uint32).tobytes()
    pieces = pd.DataFrame({"_first": [7, 3], "_n": [2, 2], "h": [same, same], "v": [np.int8([3, 4]).tobytes(), np.int8([1, 2]).tobytes()]})
    assert permute._in_order(pieces).tolist() == [1, 2, 3, 4]


def test_iterations_are_no_rows(spark):
    """Rows are not repeated per iteration: what moves is arrays of hashes and values."""
    rows = [("m", "AB"[i % 2], f"c{i}", float(i % 7), float(i % 5)) for i in range(90)]
    df = spark.createDataFrame(rows, "module string, stratum string, cell_id string, y_true double, y_pred double")
    null = resample.stratified_permutation(df, ["module"], "stratum", "cell_id", 6, 7)
    plan = null._jdf.queryExecution().toString()
    assert "explode" not in plan and "Window" not in plan
