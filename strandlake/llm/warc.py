"""A content-addressed WARC archive.

``payloads`` holds the bytes of every distinct payload once, under its SHA-256 and length;
``headers`` holds, for every record, its exact header block. Records are put together
again, byte for byte, by a join of the two. They are read as a WARC file is: the header block
up to its empty line, as many bytes of content as it states, the HTTP headers and the payload in
these; a revisit gets its payload's length and digest from the record it refers to. Stated digests are checked against the bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import checkpointed, shared_dir, spread_join, values

_SAFE = "".join(map(chr, range(33, 127)))
_FIELD = re.compile(rb"^([^:\r\n]+): ?([^\r\n]*)\r$", re.M)
_DIGESTS = "struct<address:binary,payload_digest:string,payload_bytes:bigint>"
_PARSED = pa.struct([("record_id", pa.string()), ("target_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("stated", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64())])
_PARSED_SQL = "struct<record_id:string,target_id:string,page_id:bigint,record_type:string,refers_to:bigint,stated:string,payload_digest:string,payload_bytes:bigint>"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _digests(payloads: pa.Array) -> pa.Array:
    rows = []
    for raw in values(payloads):
        raw = raw or b""
        rows.append({"address": hashlib.sha256(raw).digest(), "payload_digest": payload_digest(raw), "payload_bytes": len(raw)})
    return pa.array(rows, pa.struct([("address", pa.binary()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64())]))


def _record_id(record: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, record)}>"


def header_block(page_id: int | None, url: str | None, kind: str, refers_to: int | None, digest: str, size: int, record: str, target: str | None, date: str) -> bytes:
    """WARC and HTTP headers of a record, each with its empty line. Characters that a header cannot hold are percent-encoded."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(record)}", f"WARC-Date: {date}", f"WARC-Target-URI: {quote(url or '', safe=_SAFE)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"X-Page-ID: {'' if page_id is None else page_id}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(target)}", f"X-Refers-To-Page: {'' if refers_to is None else refers_to}"]
    lines.append(f"Content-Length: {len(http) + (size if kind == 'response' else 0)}")
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode("ascii")


def _headers(date: str):
    def build(page_id: pa.Array, url: pa.Array, kind: pa.Array, refers_to: pa.Array, digest: pa.Array, size: pa.Array, record: pa.Array, target: pa.Array) -> pa.Array:
        columns = [values(c) for c in (page_id, url, kind, refers_to, digest, size, record, target)]
        return pa.array([header_block(*row, date) for row in zip(*columns, strict=True)], pa.binary())

    return arrow_udf(build, "binary")


def write_archive(pages: DataFrame, place: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes ``pages(page_id, url, html)`` as ``place``/payloads and ``place``/headers.

    Null html is an empty payload, a null url an empty target. Of records with equal
    payloads (SHA-256, SHA-1 and length agree) of ``min_bytes`` or more, the one with the
    smallest page_id, null last, is a response and the others revisit it; of repeated
    page_ids one row. Shorter payloads make responses only. An empty table makes an empty
    archive; other columns are ignored.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")
    rows = pages.select(F.monotonically_increasing_id().alias("uid"), F.spark_partition_id().alias("part"), F.col("page_id").cast("long").alias("page_id"), "url", payload)
    slim = checkpointed(rows.select("uid", "part", "page_id", "url", arrow_udf(_digests, _DIGESTS)("payload").alias("d")).select("uid", "part", "page_id", "url", "d.*"))
    key = ["address", "payload_digest", "payload_bytes"]
    order = F.struct(F.col("page_id").isNull().alias("z"), F.col("page_id").alias("i"), F.col("uid").alias("u"))
    first = slim.groupBy(*key).agg(F.min(order).alias("first"))
    # by content and not by uid: a second scan may number its rows otherwise
    again = pages.select(payload).select("payload", F.unhex(F.sha2("payload", 256)).alias("address"), F.length("payload").cast("long").alias("payload_bytes"))
    again.groupBy("address", "payload_bytes").agg(F.first("payload").alias("payload")).write.parquet(f"{place}/payloads")
    own = (F.col("uid") == F.col("first.u")) | (F.col("payload_bytes") < min_bytes)
    # a payload may be that of a third of all pages
    records = spread_join(slim, first, key, "part").select("uid", "page_id", "url", F.when(own, "response").otherwise("revisit").alias("kind"), F.when(~own, F.col("first.i")).alias("refers_to"), F.when(~own, F.col("first")).alias("target"), *key)
    name = lambda i, u: F.concat_ws("/", i.cast("string"), u.cast("string"))
    target = F.when(F.col("kind") == "revisit", name(F.col("target.i"), F.col("target.u")))
    header = _headers(date)("page_id", "url", "kind", "refers_to", "payload_digest", "payload_bytes", name(F.col("page_id"), F.col("uid")), target)
    records.select("page_id", header.alias("header"), "kind", "address", "payload_bytes").write.parquet(f"{place}/headers")


def read_archive(spark: SparkSession, place: str) -> DataFrame:
    """Records of an archive: page_id, kind, header, and record, its bytes as a WARC file holds them.

    Only responses are joined with their payloads, so a payload is read once however many records revisit it.
    """
    headers, payloads, end = spark.read.parquet(f"{place}/headers"), spark.read.parquet(f"{place}/payloads"), F.lit(b"\r\n\r\n")
    whole = headers.where("kind = 'response'").join(payloads, ["address", "payload_bytes"]).select("page_id", "kind", "header", F.concat("header", "payload", end).alias("record"))
    return whole.unionByName(headers.where("kind <> 'response'").select("page_id", "kind", "header", F.concat("header", end).alias("record")))


def parse_record(record: bytes) -> dict:
    """Fields of a record's bytes; for a response also length and SHA-1 of the payload cut out of them."""
    head, _, rest = record.partition(b"\r\n\r\n")
    field = dict(_FIELD.findall(head + b"\r\n"))
    number = lambda name: int(field[name]) if field.get(name) else None
    size = int(field[b"Content-Length"])
    name, stated, kind = field[b"WARC-Record-ID"].decode(), field[b"WARC-Payload-Digest"].decode(), field[b"WARC-Type"].decode()
    if not record.startswith(b"WARC/1.1\r\n") or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record {name} is not framed by its Content-Length")
    out = {"record_id": name, "target_id": field.get(b"WARC-Refers-To", b"").decode() or None, "page_id": number(b"X-Page-ID"), "record_type": kind, "refers_to": number(b"X-Refers-To-Page"), "stated": stated}
    if kind == "response":
        payload = rest[:size].partition(b"\r\n\r\n")[2]
        out |= {"payload_digest": payload_digest(payload), "payload_bytes": len(payload)}
        if stated != f"sha1:{out['payload_digest']}":
            raise ValueError(f"payload of record {name} does not match its digest")
    return out


def parse_records(records: DataFrame) -> DataFrame:
    """page_id, record_type, refers_to, payload_digest and payload_bytes of each record, from its bytes alone.

    A revisit has the length and digest of the payload of the record it refers to. A record
    that is not framed by its Content-Length, or a payload unlike a digest that any of its
    records states, is an error.
    """
    parse = arrow_udf(lambda rows: pa.array([parse_record(r) for r in values(rows)], _PARSED), _PARSED_SQL)
    read = checkpointed(records.select(F.spark_partition_id().alias("part"), parse("record").alias("r")).select("part", "r.*"))
    found = read.where("record_type = 'response'").select(F.col("record_id").alias("target_id"), F.col("payload_digest").alias("digest"), F.col("payload_bytes").alias("size"))
    again = read.where("record_type <> 'response'")
    same = F.col("stated") == F.concat(F.lit("sha1:"), "digest")
    digest = F.when(same, F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("payload of record "), "record_id", F.lit(" does not match its digest"))))
    columns = ["page_id", "record_type", "refers_to", "payload_digest", "payload_bytes"]
    told = spread_join(again, found, ["target_id"], "part").select("page_id", "record_type", "refers_to", digest.alias("payload_digest"), F.col("size").alias("payload_bytes"))
    return read.where("record_type = 'response'").select(*columns).unionByName(told)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` to a new archive in the shared folder and reads its records back."""
    place = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archive(pages, place, min_bytes)
    return read_archive(pages.sparkSession, place)
