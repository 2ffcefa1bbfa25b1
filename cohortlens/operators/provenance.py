"""Artifact manifests, receipts, configuration digests and incremental work lists."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.numeric import finite
from cohortlens.functions.rng import hash32


#: Files up to this size are hashed whole by one task; larger ones in blocks, by as many tasks as Spark splits them into.
WHOLE_BYTES = 64 << 20
BLOCK_BYTES = 4 << 20
#: Names that Spark's line reader would unpack: such files are hashed whole, whatever their size.
_PACKED = r"(?i)\.(gz|bz2|deflate|lz4|snappy|zst|zstd)$"


def _block_pieces(batches: Iterator[pa.RecordBatch], offsets: dict, lengths: dict, size: int) -> Iterator[pa.RecordBatch]:
    """Digests of the blocks that lie inside one split; of blocks on the edge of a split, its bytes."""

    def piece(file: int, at: int, held: bytes) -> pa.RecordBatch:
        whole = len(held) == size
        row = (file, at // size, at % size, len(held), hashlib.sha256(held).digest() if whole else None, None if whole else held)
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    kinds = [pa.int64()] * 4 + [pa.binary()] * 2
    schema = pa.schema(list(zip(["_file", "_block", "_at", "_bytes", "_digest", "_raw"], kinds, strict=True)))
    split, at, held = None, 0, bytearray()
    for batch in batches:
        files, starts, lines = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        turns = np.flatnonzero((np.diff(files) != 0) | (np.diff(starts) != 0)) + 1
        for low, high in zip([0, *turns], [*turns, len(files)], strict=True):
            if low == high:
                continue
            here = (int(files[low]), int(starts[low]))
            if here != split:
                if held:
                    yield piece(split[0], at, bytes(held))
                split, at, held = here, offsets[here], bytearray()
            held += b"\n".join(lines.slice(low, high - low).to_pylist()) + b"\n"
            del held[max(0, lengths[split[0]] - at) :]  # the last line of a file may have no end
            while at % size + len(held) >= size:
                cut = size - at % size
                yield piece(split[0], at, bytes(held[:cut]))
                at, held = at + cut, held[cut:]
    if held:
        yield piece(split[0], at, bytes(held))


def block_digests(lines: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """(_file, _read, sha256) from (_file, _size, _start, value): the digest of the digests of a file's blocks, in order.

    lines are a file's bytes cut at line ends, in order within each split. A first scan adds up the bytes of the splits,
    so that the second knows where in the file each begins; blocks do not depend on where Spark cuts.
    """
    sums = lines.groupBy("_file", "_start").agg(F.sum(F.octet_length("value") + 1).alias("n"), F.max("_size").alias("size"))
    offsets, lengths, ends = {}, {}, {}
    for r in sums.orderBy("_file", "_start").toLocalIterator():  # one row a split
        offsets[r["_file"], r["_start"]], lengths[r["_file"]] = ends.get(r["_file"], 0), r["size"]
        ends[r["_file"]] = ends.get(r["_file"], 0) + r["n"]
    pieces = lines.select("_file", "_start", "value").mapInArrow(
        lambda batches: _block_pieces(batches, offsets, lengths, size),
        "_file bigint, _block bigint, _at bigint, _bytes bigint, _digest binary, _raw binary",
    )
    edges = F.transform(F.sort_array(F.collect_list(F.when(F.col("_raw").isNotNull(), F.struct("_at", "_raw")))), lambda e: e["_raw"])
    joined = F.aggregate(edges, F.lit(b""), lambda a, e: F.concat(a, e))
    blocks = pieces.groupBy("_file", "_block").agg(
        F.sum("_bytes").alias("_bytes"), F.coalesce(F.max("_digest"), F.unhex(F.sha2(joined, 256))).alias("_digest")
    )
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("_block", "_digest"))), lambda e: F.hex(e["_digest"]))
    return blocks.groupBy("_file").agg(F.sum("_bytes").alias("_read"), F.sha2(F.unhex(F.concat_ws("", ordered)), 256).alias("sha256"))


def artifact_manifest(
    spark: SparkSession, root: str, strip: str = "", glob: str | None = None, whole: int = WHOLE_BYTES, block: int = BLOCK_BYTES
) -> DataFrame:
    """(path, bytes, sha256, suffix) of every finished file under root, hashed on the executors.

    sha256 is that of the content; of a file above `whole` bytes it is the SHA-256 of the SHA-256 digests (32 bytes each)
    of its blocks of `block` bytes, in order, so that no task reads more than a split of it.
    """

    def reader(fmt: str) -> DataFrameReader:
        made = spark.read.format(fmt).option("recursiveFileLookup", True)
        return made.option("pathGlobFilter", glob) if glob else made

    name = F.regexp_replace("path", r"^file:/+", "/")
    if strip:
        name = F.regexp_replace(name, "^" + strip.rstrip("/") + "/", "")
    uri, length = F.col("_metadata.file_path"), F.col("_metadata.file_size")
    all_files = reader("binaryFile").load(root)
    unfinished, packed = F.col("path").rlike(r"(\.tmp|\.partial|\.crc)$|/_temporary/"), F.col("path").rlike(_PACKED)
    named = [name.alias("path"), F.col("length").alias("bytes")]
    small = all_files.filter(length <= whole).select(*named, F.sha2("content", 256).alias("sha256"))
    # Named by _metadata, files are left out before they are opened; by path, only after their content was read.
    kept = all_files.filter((length > whole) & uri.rlike(_PACKED)).select(*named, F.sha2("content", 256).alias("sha256"))
    large = all_files.filter((F.col("length") > whole) & ~packed & ~unfinished).select(*named, F.xxhash64(uri).alias("_file"))
    lines = (
        reader("text").option("lineSep", "\n").load(root)
        .filter((length > whole) & ~uri.rlike(_PACKED) & ~uri.rlike(r"(\.tmp|\.partial|\.crc)$|/_temporary/"))
        .select(F.xxhash64(uri).alias("_file"), length.alias("_size"), F.col("_metadata.file_block_start").alias("_start"), F.col("value").cast("binary").alias("value"))
    )
    complete = F.when(F.col("_read") == F.col("bytes"), F.col("sha256")).otherwise(F.raise_error(F.concat(F.lit("not read in full: "), F.col("path"))))
    blocked = large.join(block_digests(lines, block), "_file", "left").select("path", "bytes", complete.alias("sha256"))
    files = small.unionByName(kept).filter(~unfinished).unionByName(blocked)
    return files.withColumn("suffix", F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))


def manifest_status(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, status) for every path of either side."""
    counts = recorded.groupBy("path").agg(
        F.count(F.lit(1)).alias("_n"), F.first("bytes").alias("bytes"), F.first("sha256").alias("sha256")
    )
    seen = actual.select("path", F.col("bytes").alias("actual_bytes"), F.col("sha256").alias("actual_sha256"))
    joined = counts.join(seen, "path", "full_outer")
    unsafe = F.col("path").startswith("/") | F.array_contains(F.split("path", "/"), "..")
    status = (
        F.when(unsafe, "unsafe_path")
        .when(F.col("_n") > 1, "duplicate_path")
        .when(F.col("actual_sha256").isNull(), "missing")
        .when(F.col("sha256").isNull(), "unrecorded")
        .when(F.col("bytes") != F.col("actual_bytes"), "size_mismatch")
        .when(F.col("sha256") != F.col("actual_sha256"), "digest_mismatch")
        .otherwise("ok")
    )
    return joined.select("path", status.alias("status"))


def stage_receipt(manifest: DataFrame, stage: str, prefix: str) -> DataFrame:
    """The digests a stage left behind, bound to its name."""
    return manifest.filter(F.col("path").startswith(prefix)).select(F.lit(stage).alias("stage"), "path", "bytes", "sha256")


def receipt_valid(receipt: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row per stage: files recorded, files that still match, and the verdict."""
    joined = receipt.join(manifest.select("path", F.col("sha256").alias("_now")), "path", "left")
    return (
        joined.groupBy("stage")
        .agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("sha256") == F.col("_now")).alias("n_matching"))
        .withColumn("valid", F.col("n_files") == F.col("n_matching"))
    )


def provenance_table(manifest: DataFrame, action: str) -> DataFrame:
    return manifest.select(F.col("path").alias("source"), "sha256", "bytes", F.lit(action).alias("action"))


def config_json(columns: Sequence[str]) -> Column:
    """JSON text with sorted keys."""
    return F.to_json(F.struct(*sorted(columns)))


def config_digest(columns: Sequence[str]) -> Column:
    """SHA-256 of 'name=value' lines in name order; a NULL value reads as 'null'."""
    lines = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in sorted(columns)]
    return F.sha2(F.concat_ws("\n", *lines), 256)


def vector_digest(df: DataFrame, by: Sequence[str], key: str, value: str) -> DataFrame:
    """Digest per key of an id-to-number mapping, independent of row order and free of any long list.

    Each (id, value) pair is hashed to two 32-bit words; their sums identify the vector.
    """
    text = F.concat_ws("|", F.col(key).cast("string"), F.coalesce(F.format_string("%.12e", F.col(value)), F.lit("null")))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(hash32("a", text)).alias("_a"), F.sum(hash32("b", text)).alias("_b")
    ).select(*by, "n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), F.col("_a").cast("string"), F.col("_b").cast("string")), 256).alias("digest"))


def id_digest(df: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """Order-free digest of a set of ids per key."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(hash32("a", F.col(key))).alias("digest_a"), F.sum(hash32("b", F.col(key))).alias("digest_b")
    )


def partition_validity(
    partitions: DataFrame, expected_cells: DataFrame, signature: DataFrame, by: Sequence[str] = ("module", "control_id")
) -> DataFrame:
    """Per stored partition whether it may be reused: complete, unique, finite, right truth and right configuration.

    partitions: by, cell_id, y_true, y_pred, run_signature. expected_cells: cell_id, y_true. signature: module, run_signature.
    """
    by = list(by)
    truth = expected_cells.select(*[c for c in by if c in expected_cells.columns], "cell_id", F.col("y_true").alias("_truth"))
    on = [c for c in by if c in expected_cells.columns] + ["cell_id"]
    wanted = signature.select(*[c for c in by if c in signature.columns], F.col("run_signature").alias("_wanted"))
    joined = partitions.join(truth, on, "left").join(wanted, [c for c in by if c in signature.columns], "left")
    per_cell = joined.groupBy(*by, "cell_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.bool_and(F.col("y_true").eqNullSafe(F.col("_truth"))).alias("_same"),
        F.bool_and(finite(F.col("y_pred")).isNotNull()).alias("_finite"),
        F.bool_and(F.col("run_signature").eqNullSafe(F.col("_wanted"))).alias("_signed"),
    )
    return per_cell.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.bool_and(F.col("_n") == 1).alias("unique_cells"),
        F.bool_and("_same").alias("truth_equal"),
        F.bool_and("_finite").alias("all_finite"),
        F.bool_and("_signed").alias("signature_equal"),
    )


def work_list(expected: DataFrame, validity: DataFrame, n_cells: int | Column, by: Sequence[str] = ("module", "control_id")) -> DataFrame:
    """Expected partitions that must be computed again."""
    complete = F.col("n_cells") == (n_cells if isinstance(n_cells, Column) else F.lit(n_cells))
    good = validity.filter(complete & F.col("unique_cells") & F.col("truth_equal") & F.col("all_finite") & F.col("signature_equal"))
    return expected.join(good.select(*by), list(by), "left_anti")


def gate(checks: Mapping[str, DataFrame]) -> DataFrame:
    """(check, n_violations, passed) from one-row or violation tables: each check passes when its table is empty."""
    out = None
    for name, table in checks.items():
        row = table.agg(F.count(F.lit(1)).alias("n_violations")).select(F.lit(name).alias("check"), "n_violations")
        out = row if out is None else out.unionByName(row)
    return out.withColumn("passed", F.col("n_violations") == 0)
