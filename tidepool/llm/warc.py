"""WARC archives with revisit records.

Pages become records whose payload is the page in UTF-8. Only headers (id, digest, length, URL) are shuffled, by payload digest and after
pre-aggregation, to find for each group of equal payloads the one that stays a response; the others become revisit records, made from
their headers alone, that refer to it. Bodies stay where they were read. Archives are written by Spark's own writer into a folder of
any store (one file of records per task and ``records_per_archive``, each file one gzip stream, committed as a whole, so a lost executor
leaves nothing half-written). They are read back as a stream of text between blank lines, from which records are put together by the
lengths in their headers: a task holds one record and one Arrow batch at a time, however large an archive is. Revisits are resolved
by joining them to their originals on the record id, which depends on page id and payload.

Defined cases: a null page is an empty payload, always a response; payloads under ``least_bytes`` are responses; page ids that tie for
the largest of a group are all responses; a page id with several payloads has a record for each; repeated rows stay repeated; a null id
never gets to be an original and stays a response; line breaks in URLs become blanks and a null URL an empty one; very long pages are
written whole; extra columns are ignored, whatever their names. No pages give one empty archive and an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidepool.llm.common import materialize, salted_join, shared_dir, without

GAP = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: Column, digest: Column) -> Column:
    """A urn:uuid that depends on the page's id and payload alone, so that a task that runs again writes the same record."""
    h = F.md5(F.concat_ws("/", F.coalesce(page_id.cast("string"), F.lit("")), digest))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))


def decide(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Records of ``pages`` (_id, _url, _body): _id, _url, payload_digest, payload_bytes, refers_to, refers_to_url (null: response), _body (revisits: empty)."""
    headed = pages.withColumns({"payload_digest": F.sha1("_body"), "payload_bytes": F.octet_length("_body").cast("long")})
    headers = materialize(headed.filter((F.col("payload_bytes") >= least_bytes) & F.col("_id").isNotNull()).select("_id", "_url", "payload_digest", "payload_bytes"), "headers")
    group = ["payload_digest", "payload_bytes"]
    originals = headers.groupBy(*group).agg(F.max("_id").alias("refers_to"), F.max_by("_url", "_id").alias("refers_to_url"), F.min("_id").alias("_least")).filter("_least < refers_to").drop("_least")
    revisits = materialize(salted_join(headers, originals, group, F.col("_id")).filter("_id < refers_to"), "revisits")
    columns = ["_id", "_url", "payload_digest", "payload_bytes", "refers_to", "refers_to_url", "_body"]
    responses = without(headed, revisits, ["_id", "payload_digest"]).withColumns({"refers_to": F.lit(None).cast("long"), "refers_to_url": F.lit(None).cast("string")})
    return responses.select(*columns).unionByName(revisits.withColumn("_body", F.lit("")).select(*columns))


def write_warc(records: DataFrame, path: str, date: str, records_per_archive: int = 20_000) -> None:
    """Write ``decide``'s rows as WARC/1.1 under ``path``. ``date``: when the records are written, as 2024-01-31T00:00:00Z."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    uri = lambda url: F.regexp_replace(F.coalesce(url, F.lit("")), "[\r\n]", " ")
    revisit = F.col("refers_to").isNotNull()
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.col("_id"), F.col("payload_digest"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri(F.col("_url"))),
        F.when(F.col("_id").isNotNull(), line("WARC-Page-ID", F.col("_id").cast("string"))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(
            revisit,
            F.concat(
                line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", record_id(F.col("refers_to"), F.col("payload_digest"))),
                line("WARC-Refers-To-Target-URI", uri(F.col("refers_to_url"))), line("WARC-Refers-To-Date", F.lit(date)),
            ),
        ).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string")), F.lit(GAP),
    )
    records.select(F.concat(head, "_body").alias("value")).write.option("lineSep", GAP).option("compression", "gzip").option("maxRecordsPerFile", records_per_archive).text(path)


def records_of(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of each record of a stream of bytes that was cut at blank lines."""
    held, headers, size = bytearray(), None, 0
    for piece in pieces:
        held += piece
        held += b"\r\n\r\n"
        while True:
            if headers is None:
                while held[:2] == b"\r\n":
                    del held[:2]
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                first, *lines = held[:end].decode("utf-8").split("\r\n")
                if not first.startswith("WARC/"):
                    raise ValueError(f"not a WARC record: {first[:80]!r}")
                headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
                size = int(headers["content-length"])
                del held[: end + 4]
            if len(held) < size + 4:
                break
            yield headers, bytes(held[:size])
            del held[: size + 4]
            headers = None
    if headers is not None:
        raise ValueError(f"cut off within {headers.get('warc-record-id')}")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_id, record_type, refers_to_record, payload_digest, payload_bytes, payload of every record; a response whose digest doesn't match its payload is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for h, payload in records_of(x.as_py() for batch in batches for x in batch.column(0)):
            digest = h["warc-payload-digest"].removeprefix("sha1:")
            if h["warc-type"] != "revisit" and hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError(f"damaged payload in {h['warc-record-id']}")
            page = h.get("warc-page-id")
            rows.append((int(page) if page else None, h["warc-target-uri"], h["warc-record-id"], h["warc-type"], h.get("warc-refers-to"), digest, len(payload), payload))
            size += len(payload)
            if size > 16 << 20 or len(rows) >= 10_000:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    kinds = "page_id bigint, url string, record_id string, record_type string, refers_to_record string, payload_digest string, payload_bytes bigint, payload binary"
    # A gzip file is never split, and lines keep their order within a file.
    return spark.read.option("lineSep", GAP).option("pathGlobFilter", "*.gz").text(path).select(F.col("value").cast("binary")).mapInArrow(run, kinds)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "url", "record_id", "record_type", "refers_to_record", "payload_digest", "payload_bytes", "payload"])


def resolve(records: DataFrame) -> DataFrame:
    """Records without payload: revisits get payload_bytes and refers_to (a page id) from the response they refer to."""
    heads = materialize(records.select("page_id", "url", "record_id", "record_type", "refers_to_record", "payload_digest", "payload_bytes"), "heads")
    asked = heads.filter("refers_to_record is not null")
    named = asked.select(F.col("refers_to_record").alias("record_id")).distinct()
    originals = heads.filter("record_type = 'response' and page_id is not null").join(named, "record_id", "left_semi")
    originals = originals.groupBy(F.col("record_id").alias("refers_to_record")).agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("full_bytes"))
    found = salted_join(asked, originals, ["refers_to_record"], F.col("page_id"), "left").select("page_id", "url", F.coalesce("full_bytes", "payload_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    rest = heads.filter("refers_to_record is null").select("page_id", "url", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return rest.unionByName(found)


def archive_pages(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 1000, records_per_archive: int = 20_000, date: str | None = None) -> DataFrame:
    """Write deduplicated archives of ``pages`` under ``path`` (by default a new shared folder), read them back and resolve the revisits.

    ``date``: the records' date, by default now.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/tidepool/warc-{uuid.uuid4().hex}"
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("_url"), F.coalesce(F.col(html_col), F.lit("")).alias("_body"))
    write_warc(decide(rows, least_bytes), path, date, records_per_archive)
    return resolve(read_warc(spark, path)).withColumnRenamed("page_id", id_col)
