"""A content-addressed archive of WARC records.

Payload bytes are stored once each, under their SHA-256, in one table; the exact header bytes of every
record stand in another; records are put together again by a join. What is read back is checked: a payload
whose bytes do not give the digest it is filed under raises an error.

Of records with equal payloads, the one with the least page id (a null id is last; then the least url,
a null url first) is the ``response``, the others are ``revisit`` records that refer to it. Rows repeated
whole are several records; one of them is the response. A null payload is an empty one; a null url leaves
the target out of the header. Payloads shorter than ``least_bytes`` are not shared: all are responses. An
empty table gives an empty archive. Columns of the source that are not named are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nichelens.session import shared_folder

#: Copies of a payload row for a digest that many records share.
SALTS = 64
#: A digest is hot with this part of all records or more, so at most so many digests are.
HOT_SHARE = 1000
#: Fewer records than this are never hot.
HOT_LEAST = 1000
_PLAIN = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    """Where the two tables of an archive lie."""

    headers: str
    payloads: str


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 digest: 160 bits are 32 signs, taken 60 bits at a time."""
    digest = F.sha1(data)
    parts = [(1, 15, 12), (16, 15, 12), (31, 10, 8)]
    signs = [F.lpad(F.conv(F.substring(digest, at, n), 16, 32), width, "0") for at, n, width in parts]
    return F.translate(F.concat(*signs), _PLAIN, _BASE32)


def _uuid(*parts: Column) -> Column:
    """A name-based record id."""
    named = F.md5(F.concat_ws("\n", *[F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]))
    return F.concat(F.lit("urn:uuid:"), F.regexp_replace(named, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"))


def _line(name: str, value: Column) -> Column:
    """One header line; nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def _on_digest(records: DataFrame, stored: DataFrame, spread_by: Column) -> DataFrame:
    """``records`` with the columns of ``stored``, which has one row a digest.

    Digests with a thousandth of all records or more, a thousand at most, have their stored row copied
    ``SALTS`` times, and their records are dealt over the copies.
    """
    total = records.agg(F.count("*")).scalar()
    counts = records.groupBy("digest").agg(F.count("*").alias("n"))
    hot = counts.where((F.col("n") * HOT_SHARE >= total) & (F.col("n") >= HOT_LEAST))
    hot = F.broadcast(hot.select(F.col("digest").alias("hot_digest")))
    is_hot = F.col("hot_digest").isNotNull()
    left = records.join(hot, F.col("digest") == F.col("hot_digest"), "left")
    left = left.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64(spread_by), F.lit(SALTS).cast("long"))).otherwise(F.lit(0).cast("long"))).drop("hot_digest")
    right = stored.join(hot, F.col("digest") == F.col("hot_digest"), "left")
    copies = F.sequence(F.lit(0).cast("long"), F.when(is_hot, SALTS - 1).otherwise(0).cast("long"))
    right = right.withColumn("salt", F.explode(copies)).drop("hot_digest")
    return left.join(right, ["digest", "salt"]).drop("salt")


def records(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """(page_id, record_type, refers_to, digest, header, http_header): one record a row, without payload.

    Only digests travel: equal rows are counted before the shuffle and told apart by number afterwards.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    narrow = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    narrow = narrow.select(
        "page_id", "url", F.sha2("payload", 256).alias("digest"), base32_sha1(F.col("payload")).alias("sha1"),
        F.length("payload").cast("long").alias("bytes"),
    )
    cells = narrow.groupBy("page_id", "url", "digest", "sha1", "bytes").agg(F.count("*").alias("times"))
    order = F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", "url")
    firsts = cells.groupBy("digest").agg(F.min(order).alias("first"))
    known = _on_digest(cells, firsts, F.struct("page_id", "url"))
    each = known.withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    own = (
        F.col("page_id").eqNullSafe(F.col("first.page_id"))
        & F.col("url").eqNullSafe(F.col("first.url"))
        & (F.col("number") == 1)
    ) | (F.col("bytes") < least_bytes)
    each = each.withColumn("record_type", F.when(own, "response").otherwise("revisit"))
    again = F.col("record_type") == "revisit"
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), _line("Content-Length", F.col("bytes")), F.lit("\r\n")
    )
    first_id = _uuid(F.col("first.page_id"), F.col("first.url"), F.col("digest"), F.lit(1))
    target = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", F.concat(F.lit("<"), _uuid(F.col("page_id"), F.col("url"), F.col("digest"), F.col("number")), F.lit(">"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", target),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Profile", F.when(again, F.lit(_REVISIT))),
        _line("WARC-Refers-To", F.when(again, F.concat(F.lit("<"), first_id, F.lit(">")))),
        _line("Content-Type", F.lit("application/http;msgtype=response")),
        _line("Content-Length", F.length("http_header") + F.when(again, 0).otherwise(F.col("bytes"))),
        F.lit("\r\n"),
    )
    each = each.withColumn("http_header", http).withColumn("header", header)
    return each.select(
        "page_id", "record_type", F.when(again, F.col("first.page_id")).alias("refers_to"), "digest",
        F.col("header").cast("binary").alias("header"), F.col("http_header").cast("binary").alias("http_header"),
    )


def store(pages: DataFrame, folder: str, payload_col: str = "html", **how) -> Archive:
    """Write both tables of the archive under ``folder``.

    A payload is filed once: copies within a task are folded before the shuffle, the rest behind it.
    """
    archive = Archive(f"{folder}/headers", f"{folder}/payloads")
    records(pages, payload_col=payload_col, **how).write.parquet(archive.headers)
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload")
    filed = pages.select(payload).select(F.sha2("payload", 256).alias("digest"), "payload")
    filed.groupBy("digest").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(archive.payloads)
    return archive


def field(header: Column, name: str) -> Column:
    """Value of a header line, null where there is none."""
    found = F.regexp_extract(header.cast("string"), f"(?m)^{re.escape(name)}: ([^\\r\\n]*)", 1)
    return F.when(found != "", found)


def restore(spark: SparkSession, archive: Archive) -> DataFrame:
    """Every record with its payload: what ``records`` gives, and (payload, payload_bytes, payload_digest).

    Digests are taken anew from the stored bytes; bytes that do not fit their digest raise an error.
    """
    stored = spark.read.parquet(archive.payloads)
    wrong = F.raise_error(F.concat(F.lit("payload does not fit its digest "), F.col("digest")))
    checked = stored.select(
        F.when(F.sha2("payload", 256) == F.col("digest"), F.col("digest")).otherwise(wrong).alias("digest"),
        "payload", F.length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"),
    )
    return _on_digest(spark.read.parquet(archive.headers), checked, F.col("header"))


def whole(restored: DataFrame) -> DataFrame:
    """``restored`` with a column ``record``: the bytes of each record, a revisit without its payload."""
    body = F.when(field(F.col("header"), "WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return restored.withColumn("record", F.concat("header", "http_header", body, F.lit(b"\r\n\r\n")))


def write_files(restored: DataFrame, path: str) -> None:
    """WARC files, compressed: the records of :func:`restore`, one after another.

    Every record ends in the two line breaks that the text writer puts between its rows.
    """
    body = F.when(field(F.col("header"), "WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    record = F.concat("header", "http_header", body).cast("string")
    restored.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


_LENGTH = re.compile(rb"^content-length:[ \t]*(\d+)", re.I | re.M)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, header, http_header, payload) of the records in WARC files.

    Spark reads a compressed file as lines from its start; joined again they are the file's bytes, cut
    into records by their lengths. A task holds one record at a time. What is not a record raises an error.
    """

    def run(batches):
        at, held, number = None, bytearray(), 0

        def take(end: bool):
            """Whole records at the front of the bytes held."""
            nonlocal number
            while True:
                start = len(held) - len(held.lstrip(b"\r\n"))
                stop = held.find(b"\r\n\r\n", start)
                if start == len(held) or stop < 0:
                    if end and start < len(held):
                        raise ValueError(f"{at}: a record is cut off")
                    return
                header = bytes(held[start : stop + 4])
                length = _LENGTH.search(header)
                if not header.startswith(b"WARC/") or not length:
                    raise ValueError(f"{at}: record {number} has no header")
                last = stop + 4 + int(length[1])
                if len(held) < last:
                    if end:
                        raise ValueError(f"{at}: a record is cut off")
                    return
                block = bytes(held[stop + 4 : last])
                del held[:last]
                cut = block.find(b"\r\n\r\n") + 4 if b"application/http" in header else 0
                yield at, number, header, block[:cut], block[cut:]
                number += 1

        def rows():
            nonlocal at, number, held
            for batch in batches:
                for file, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if file != at:
                        yield from take(True)
                        at, held, number = file, bytearray(), 0
                    held += line
                    held += b"\n"
                    if len(line) < 2:  # a record ends in an empty line
                        yield from take(False)
            yield from take(True)

        names = ["file", "number", "header", "http_header", "payload"]
        kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        part, size = [], 0
        for row in rows():
            part.append(row)
            size += sum(map(len, row[2:]))
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names)
                part, size = [], 0
        if part:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names)

    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary"))
    return lines.mapInArrow(run, "file string, number long, header binary, http_header binary, payload binary")


def archive_pages(spark: SparkSession, pages: DataFrame, name: str) -> DataFrame:
    """Pages written to an archive in the shared folder and read back from there."""
    return restore(spark, store(pages, f"{shared_folder(spark)}/{name}"))
