"""Legacy archive converter: ARC records of version 1 and 2 become WARC records, equal payloads are stored once."""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import shared_path

#: Fixed header lines of the two versions.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_RECORDS = 20_000
REVISIT_FROM = 1000


def arc_file(url: Column, date: Column, html: Column, version: Column) -> Column:
    """A legacy archive of one record, as binary: version block, header line of that version, HTTP answer."""
    body = F.concat(F.lit(HTTP_HEAD), F.coalesce(html, F.lit("")))
    clean = F.regexp_replace(F.coalesce(url, F.lit("-")), r"\s", "%20")
    clean = F.when(clean == "", F.lit("-")).otherwise(clean)

    def built(v: int) -> Column:
        extra = "" if v == 1 else "200 - - 0 legacy.arc "
        names = f"{v} 0 legacy\n{FIELDS[v]}\n"
        block = f"filedesc://legacy.arc 0.0.0.0 19960101000000 text/plain {extra}{len(names)}\n{names}\n"
        return F.concat(F.lit(block), clean, F.lit(" 0.0.0.0 "), date, F.lit(f" text/html {extra}"), F.octet_length(body).cast("string"), F.lit("\n"), body, F.lit("\n"))

    return F.when(version == 1, built(1)).otherwise(built(2)).cast("binary")


def arc_records(data: bytes) -> Iterator[dict]:
    """Records of an ARC file: header fields as the file's own version block names them, body by the declared length.

    A record cut short is marked as truncated; where a header line can't be read the rest of the file is left out.
    """
    names, at = None, 0
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            return
        parts = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        offset, at = at, end + 1
        if not parts[-1].isdigit() or len(parts) not in (5, 10) or names and len(parts) != len(names):
            return
        length = int(parts[-1])
        body = data[at : at + length]
        at += length
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if names is None:
            lines = body.decode("utf-8", "replace").splitlines()
            names = lines[1].split(" ") if len(lines) > 1 else FIELDS[1].split(" ")
            continue
        yield dict(zip(names, parts, strict=True)) | {"offset": offset, "body": body, "truncated": len(body) < length}


def warc_record(arc: dict, key: str, refers_to: str | None) -> bytes:
    """The WARC record (without the two line ends that close it) that stands for an ARC record.

    The id is a function of what the record holds, so a conversion that is run again gives the same records.
    """
    body = arc["body"]
    http = body.startswith(b"HTTP/")
    payload = body[body.find(b"\r\n\r\n") + 4 :] if http else body
    digest = hashlib.sha1(payload).hexdigest()
    stamp = (arc["Archive-date"] + "19960101000000"[len(arc["Archive-date"]) :])[:14]
    date = f"{stamp[:4]}-{stamp[4:6]}-{stamp[6:8]}T{stamp[8:10]}:{stamp[10:12]}:{stamp[12:14]}Z"
    name = uuid.UUID(bytes=hashlib.sha1(f"{key}|{arc['URL']}|{stamp}|{arc['offset']}|{digest}".encode()).digest()[:16], version=5)
    kind = "revisit" if refers_to is not None else "response" if http else "resource"
    block = body[: body.find(b"\r\n\r\n") + 4] if kind == "revisit" and http else b"" if kind == "revisit" else body
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}", f"WARC-Target-URI: {arc['URL']}",
        f"WARC-IP-Address: {arc['IP-address']}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
        f"Content-Type: {'application/http; msgtype=response' if http else arc['Content-type']}", f"Content-Length: {len(block)}",
        f"X-Archive-Key: {key}", f"X-Payload-Length: {len(payload)}",
    ]
    head += ["WARC-Truncated: length"] * arc["truncated"]
    head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Key: {refers_to}"] if kind == "revisit" else []
    return "\r\n".join(head).encode() + END.encode() + block


def write_warc(archives: DataFrame) -> str:
    """Writes WARC files from (key string, arc binary, refers_to string or null); returns the folder.

    A record is a row of a text file whose line end is the WARC record end, so any file system that Spark writes to will do.
    """
    path = shared_path(archives.sparkSession, "warc")

    def convert(batches):
        for batch in batches:
            out = []
            for key, arc, refers in zip(batch["key"], batch["arc"], batch["refers_to"], strict=True):
                refers = None if pd.isna(refers) else refers
                out += [warc_record(r, key, refers) for r in arc_records(arc)]
            yield pd.DataFrame({"value": out}, dtype=object)

    records = archives.select("key", "arc", "refers_to").mapInPandas(convert, "value binary")
    writer = records.select(F.col("value").cast("string").alias("value")).write
    writer.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)
    return path


def warc_records(stream) -> Iterator[tuple[dict, bytes]]:
    """Headers and block of each record of a WARC stream, by the declared lengths."""
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError("not a WARC record")
        head = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name] = value.strip()
        yield head, stream.read(int(head["Content-Length"]))
        stream.read(len(END))


def read_warc(spark, path: str) -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to) of each record; stored payloads are hashed anew."""

    def read(batches):
        for batch in batches:
            rows = []
            for content in batch["content"]:
                for head, block in warc_records(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)))):
                    size, digest = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].partition(":")[2]
                    if head["WARC-Type"] != "revisit":
                        http = block.startswith(b"HTTP/")
                        payload = block[block.find(b"\r\n\r\n") + 4 :] if http else block
                        if (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
                            raise ValueError(f"damaged record {head['WARC-Record-ID']}")
                    rows.append((head["X-Archive-Key"], size, digest, head["WARC-Type"], head.get("X-Refers-To-Key")))
            yield pd.DataFrame(rows, columns=["key", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInPandas(read, "key string, payload_bytes bigint, payload_digest string, record_type string, refers_to string")


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages to legacy archives to WARC files and back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Of pages with equal payloads of at least 1000 bytes the one with the largest id is stored, the others revisit it; an
    id that is given twice with the stored payload is stored twice. A null page is an empty payload, a null id never is
    the stored one unless all ids of its payload are null. An empty table gives an empty table; other columns are not read.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{url_col}`").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    largest = rows.filter(F.octet_length("html") >= REVISIT_FROM).groupBy("digest").agg(F.max("id").alias("stored"), F.count(F.lit(1)).alias("n"))
    largest = largest.filter((F.col("n") > 1) & F.col("stored").isNotNull()).select("digest", "stored")
    joined = rows.join(largest, "digest", "left")
    other = F.col("stored").isNotNull() & ~F.col("stored").eqNullSafe(F.col("id"))
    version = F.when(F.coalesce(F.col("id"), F.lit(0)) % 2 == 0, 1).otherwise(2)
    archives = joined.select(
        F.coalesce(F.col("id").cast("string"), F.lit("null")).alias("key"), arc_file(F.col("url"), F.lit("19990101000000"), F.col("html"), version).alias("arc"),
        F.when(other, F.col("stored").cast("string")).alias("refers_to"),
    )
    read = read_warc(spark, write_warc(archives))
    return read.select(
        F.col("key").try_cast("bigint").alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("bigint").alias("refers_to")
    )
