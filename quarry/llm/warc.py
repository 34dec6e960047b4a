"""WARC: archives without repeated payloads.

Headers alone tell each record's part: the least row (by id, then url) of each digest is its original response
and the rest become revisit records that refer to it. Equal headers are counted before they are shuffled. Digests that
more than one in MOST_HOT of all records have, of which there are fewer than MOST_HOT, go to their records by broadcast;
the others' records meet them in a shuffle. Of payloads only one for each digest and task is shuffled, to its response;
revisits have none.

Archives are plain WARC/1.1 written by Spark's text sink, whose line separator is the record separator, so
any store that Spark writes to will do; each row of the sink is one archive of some ARCHIVE_BYTES of records.
Reading parses records by their Content-Length, checks each response's payload against its digest, and
gives the payload of a revisit by its headers.

Null payload counts as empty. Payloads shorter than ``least_bytes`` are always responses. Repeated ids: of
rows with the same id and payload one is the response and the rest revisit it. A null id is after all others and
a header that is left out; what revisits such a response refers to it by record id and digest. Extra columns
are ignored; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import shared_dir, stored

SEPARATOR = "\r\n\r\n"
ARCHIVE_BYTES = 8 << 20
MOST_HOT = 1000
#: Fixed value: the profile that marks a revisit by identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload_ok boolean"


def record_urn(page_id: int | None, sha1: str, kind: str = "response") -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{sha1}:{kind}')}"


def resolve_revisits(df: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, sha1, n, record_type, refers_to): each record's part in the archive; n is the
    payload's bytes, and html is null in revisits."""
    text = F.coalesce(F.col(payload_col), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), text.alias("html"), F.sha1(text.cast("binary")).alias("sha1"), F.octet_length(text).cast("long").alias("n"))
    own = rows.where(F.col("n") >= least_bytes)
    heads = stored(own.groupBy("sha1", "page_id", "url", "n").agg(F.count("*").alias("copies")))
    least = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", F.col("url").isNull().alias("no_url"), "url")).alias("least")
    originals = stored(heads.groupBy("sha1").agg(least, F.max("n").alias("n"), F.sum("copies").alias("records")))
    payloads = own.groupBy("sha1").agg(F.first("html").alias("html"))
    responses = originals.join(payloads.hint("merge"), "sha1").select("least.page_id", "least.url", "html", "sha1", "n", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    share = (originals.agg(F.sum("records")).first()[0] or 0) // MOST_HOT
    repeated = originals.where("records > 1").select("sha1", "least", (F.col("records") > share).alias("hot"))
    hot, others = F.broadcast(repeated.where("hot").drop("hot")), repeated.where("NOT hot").drop("hot")  # hot: fewer than MOST_HOT
    referred = heads.join(hot, "sha1").unionByName(heads.join(hot, "sha1", "left_anti").join(others.hint("merge"), "sha1"))
    is_least = F.col("page_id").eqNullSafe(F.col("least.page_id")) & F.col("url").eqNullSafe(F.col("least.url"))
    rest = referred.withColumn("times", F.col("copies") - is_least.cast("long")).where("times > 0")
    revisits = rest.select("page_id", "url", F.lit(None).cast("string").alias("html"), "sha1", "n", F.lit("revisit").alias("record_type"), F.col("least.page_id").alias("refers_to"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("col")
    out = responses.unionByName(revisits)
    if least_bytes > 0:
        out = out.unionByName(rows.where(F.col("n") < least_bytes).select("*", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")))
    return out


def write_archives(resolved: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write ``resolved`` as archives under ``path``, each record with fresh headers."""

    def record(page_id: int | None, url: str | None, html: str | None, sha1: str, size: int, kind: str, refers_to: int | None) -> str:
        body = html or ""
        digest = base64.b32encode(bytes.fromhex(sha1)).decode()
        head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_urn(page_id, sha1, kind)}>", f"WARC-Date: {date}", f"WARC-Target-URI: {(url or '').replace(chr(13), '').replace(chr(10), '')}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: text/html; charset=utf-8", f"X-Payload-Length: {size}"]
        if page_id is not None:
            head.append(f"X-Page-ID: {page_id}")
        if kind == "revisit":
            head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_urn(refers_to, sha1)}>"]
            if refers_to is not None:
                head.append(f"X-Refers-To-Page: {refers_to}")
            body, size = "", 0
        return "\r\n".join([*head, f"Content-Length: {size}"]) + SEPARATOR + body

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                held.append(record(*row))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([SEPARATOR.join(held)])], names=["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([SEPARATOR.join(held)])], names=["value"])

    archives = resolved.select("page_id", "url", "html", "sha1", "n", "record_type", "refers_to").mapInArrow(run, "value string")
    archives.write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row of HEADERS for each record; payload_ok: a response's payload has the size and digest it says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                raw = content.as_buffer()
                raw = memoryview(gzip.decompress(raw)) if name.endswith(".gz") else memoryview(raw)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parsed(raw)), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()))], names=[f.split()[0] for f in HEADERS.split(", ")]) if len(raw) else pa.RecordBatch.from_pylist([], pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_ok", pa.bool_())]))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, HEADERS)


def parsed(raw: memoryview) -> Iterator[tuple]:
    """Records of one archive, by their Content-Length."""
    at, whole = 0, bytes(raw)
    while at < len(whole):
        end = whole.index(b"\r\n\r\n", at)
        lines = whole[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        body = end + 4
        at = body + int(head["Content-Length"]) + 4
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        kind, size = head["WARC-Type"], int(head["X-Payload-Length"])
        ok = None
        if kind == "response":
            payload = whole[body : at - 4]
            ok = len(payload) == size and base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest
            if not ok:
                raise ValueError(f"record {head['WARC-Record-ID']}: the payload doesn't match its digest")
        page_id, refers = head.get("X-Page-ID"), head.get("X-Refers-To-Page")
        yield int(page_id) if page_id else None, size, digest, kind, int(refers) if refers else None, ok


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_archives(resolve_revisits(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    return read_archives(spark, path).drop("payload_ok")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
q AS (SELECT page_id, strlen(payload) AS n, list_transform(range(8), lambda g: ('0x' || substr(sha1(payload), g * 5 + 1, 5))::INTEGER) AS five,
             first_value(page_id) OVER (PARTITION BY payload ORDER BY page_id) AS least FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((five[i // 4 + 1] >> (15 - 5 * (i % 4)))::INTEGER & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to
FROM q
"""
