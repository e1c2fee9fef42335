"""WARC archives: writing captures, reading records, assembling transactions.

`write_archive` turns captures into request, response (or revisit) and metadata records; every record is one line of Spark's
text sink whose line separator is the end-of-record mark (two CRLF), so archives go to any file system that Spark writes to.
`read_records` follows Content-Length, not separators, through gzip members or plain files. `transactions` joins the records
of a capture through WARC-Concurrent-To and emits one nested row for each capture.

Duplicates: of captures with equal payloads (by SHA-256) the one with the largest id is stored, the others are revisit records
that refer to it. Only hashes are shuffled to find them, a hot one spread over several tasks; payloads are shuffled once, by
capture, and read back without a shuffle where a caller needs no more than their size and digest.

Null payloads are empty, null URLs ``about:blank``. Every row is a capture with records of its own: rows that share an id, or
have none, are told apart by their content, and equal ones are numbered. A null id is smaller than all others and reads back as
null. Other columns do not enter the archive. Files end at ``FILE_BYTES`` of records (or one capture) and are read by one task,
as a stream.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.llm.common import in_batches, looked_up, shared_dir, stored

#: Fixed parts of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NL = "\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Most bytes of payload in a file of several captures.
FILE_BYTES = 512 << 20


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: 160 bits are four groups of ten hex digits, each eight base-32 digits."""
    hexed = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(kind: str, key: Column) -> Column:
    h = F.md5(F.concat(F.lit(f"{kind}:"), key).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(">"))


def _record(kind: str, fields: list[tuple[str, Column]], block: Column, block_bytes: Column) -> Column:
    lines = [F.concat(F.lit(f"{name}: "), value.cast("string")) for name, value in [("WARC-Type", F.lit(kind)), *fields, ("Content-Length", block_bytes)]]
    return F.concat(F.concat_ws(NL, F.lit(VERSION), *lines), F.lit(NL + NL), block)


def _told_apart(captures: DataFrame, key: str) -> DataFrame:
    """``captures`` (``key``, url, payload) with ``name``, a text of its own for every row."""
    odd = captures.groupBy(key).agg(F.count("*").alias("m")).where(F.col(key).isNull() | (F.col("m") > 1))
    if odd.isEmpty():
        return captures.withColumn("name", F.col(key).cast("string"))
    each = captures.groupBy(key, "url", "payload").agg(F.count("*").alias("m")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    content = F.md5(F.to_json(F.struct("url", F.col("payload").cast("string").alias("payload"))).cast("binary"))
    name = F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("null")), content, F.col("copy").cast("string"))
    return stored(each.withColumn("name", name).drop("m", "copy"), "captures")


def revisits(captures: DataFrame, key: str, least_bytes: int = 0) -> DataFrame:
    """(name, to): the captures whose payload another one holds too, and the name of the one of them that is kept."""
    small = captures.where(F.octet_length("payload") >= least_bytes).select("name", F.col(key).alias("key"), F.unhex(F.sha2("payload", 256)).alias("strong"))
    small = stored(small, "payload-digests")
    last = small.groupBy("strong").agg(F.max(F.struct("key", "name")).alias("last"), F.count("*").alias("m")).where("m > 1").select("strong", F.col("last.name").alias("to"))
    return looked_up(small, "strong", "name", last).where(F.col("to") != F.col("name")).select("name", "to")


def write_archive(captures: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> None:
    """Three records for each capture; equal payloads of at least ``least_bytes`` are stored once.

    Captures are written by size, each class within 16 times the one before, so that records to a file bound its bytes.
    """
    data = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    target = F.coalesce(F.regexp_replace(F.col(url), r"[\r\n]+", " "), F.lit("about:blank"))
    c = _told_apart(captures.select(F.col(key), target.alias("url"), data.alias("payload")), key)
    to = stored(revisits(c, key, least_bytes), "revisits")
    size = F.octet_length("payload").cast("long")
    mean = max(1024.0, c.agg(F.avg(size)).first()[0] or 0.0)
    level = F.greatest(F.lit(0), F.ceil(F.log(F.greatest(size, F.lit(1)) / mean) / F.log(F.lit(16.0))) - 1).cast("int")
    levels = sorted(r[0] for r in c.select(level.alias("level")).distinct().collect())  # a handful of powers
    for k in levels or [0]:
        some = c.where(level == k) if len(levels) > 1 else c
        per_file = max(1, int(FILE_BYTES / (mean * 16 ** (k + 1))))
        lines = _records(some.join(to, "name", "left"), key)
        lines.write.option("lineSep", NL + NL).option("compression", "gzip").option("maxRecordsPerFile", 3 * per_file).text(f"{path}/level={k}")


def _records(c: DataFrame, key: str) -> DataFrame:
    """(value) of the records of captures (name, ``key``, url, payload, to)."""
    size = lambda x: F.octet_length(x)
    capture = _urn("capture", F.col("name"))
    common = [("WARC-Target-URI", F.col("url")), ("WARC-Date", F.lit(DATE))]
    c = c.withColumn("payload_bytes", size("payload").cast("long")).withColumn("digest", base32_sha1(F.col("payload")))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{NL}Content-Type: text/html; charset=UTF-8{NL}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(NL + NL))
    http = [("Content-Type", F.lit("application/http; msgtype=response")), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))]
    response = _record("response", [("WARC-Record-ID", capture), *common, *http], F.concat(head, F.col("payload").cast("string")), size(head) + F.col("payload_bytes"))
    revisit = _record("revisit", [("WARC-Record-ID", capture), *common, *http, ("WARC-Profile", F.lit(REVISIT_PROFILE)), ("WARC-Refers-To", _urn("capture", F.col("to")))], head, size(head))
    ask = F.concat(F.lit("GET "), F.col("url"), F.lit(f" HTTP/1.1{NL}{NL}"))
    request = _record("request", [("WARC-Record-ID", _urn("request", F.col("name"))), *common, ("Content-Type", F.lit("application/http; msgtype=request")), ("WARC-Concurrent-To", capture)], ask, size(ask))
    note = F.concat(F.lit("captureKey: "), F.coalesce(F.col(key).cast("string"), F.lit("none")), F.lit(NL))
    metadata = _record("metadata", [("WARC-Record-ID", _urn("metadata", F.col("name"))), *common, ("Content-Type", F.lit("application/warc-fields")), ("WARC-Concurrent-To", capture)], note, size(note))
    return c.select(F.explode(F.array(request, F.when(F.col("to").isNull(), response).otherwise(revisit), metadata)).alias("value"))


def _inflated(data: bytes, step: int = 64 << 10):
    """Plain bytes of a file of one or more gzip members, piece by piece; other files as they are."""
    at = 0
    while data[at : at + 2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        while not d.eof and at < len(data):
            piece = data[at : at + step]
            plain = d.decompress(piece)
            at += len(piece) - len(d.unused_data)
            if plain:
                yield plain
        if not d.eof:
            raise ValueError("a gzip member is cut short")
    while at < len(data):
        yield data[at : at + step]
        at += step


def parse(data):
    """(headers with lower-case names, block) of each record of bytes or pieces of them; an error where the format is broken."""
    held, source = bytearray(), iter([data] if isinstance(data, bytes) else data)

    def reach(n: int) -> bool:
        while len(held) < n and (more := next(source, None)) is not None:
            held.extend(more)
        return len(held) >= n

    while reach(1):
        if reach(2) and held[:2] == b"\r\n":
            del held[:2]
            continue
        while (end := held.find(b"\r\n\r\n")) < 0 and reach(len(held) + 1):
            pass
        first, *lines = bytes(held[: max(end, 0)]).split(b"\r\n")
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {bytes(held[:20])!r}")
        headers = {}
        for x in lines:
            name, _, value = x.partition(b":")
            headers[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        past = end + 4 + int(headers["content-length"])
        if not reach(past):
            raise ValueError("the last record is cut short")
        yield headers, bytes(held[end + 4 : past])
        del held[:past]


RECORD = "type string, id string, concurrent_to string, refers_to string, url string, date string, digest string, http_head string, http_length long, payload_bytes long, payload_digest string, payload binary"


def read_records(spark: SparkSession, path: str, responses: bool = True) -> DataFrame:
    """One row for each record; a block of HTTP is split into its head and the payload, of which size and digest are taken.

    Without ``responses`` the payloads of responses stay behind: their column is null.
    """

    def rows(batches):
        for pdf in batches:
            for content in pdf["content"]:
                out, size = [], 0
                for h, block in parse(_inflated(content)):
                    head, body, length = None, block, None
                    if h.get("content-type", "").startswith("application/http"):
                        top, _, body = block.partition(b"\r\n\r\n")
                        head = top.decode("utf-8", "replace")
                        for x in head.split(NL)[1:]:
                            if x.lower().startswith("content-length:"):
                                length = int(x[15:])
                    digest, kind = h.get("warc-payload-digest"), h["warc-type"]
                    kept = body if responses or kind != "response" else None
                    out.append((kind, h["warc-record-id"], h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), digest.removeprefix("sha1:") if digest else None, head, length, len(body), sha1_base32(body), kept))
                    size += 400 + len(kept or b"")
                    if size > 4 << 20:
                        yield _frame(out)
                        out, size = [], 0
                yield _frame(out)

    return in_batches(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content"), rows, RECORD)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in RECORD.split(", ")]).astype({"http_length": "Int64"})


def transactions(records: DataFrame) -> DataFrame:
    """(id, capture, request, metadata): one nested row for each response or revisit, with what is concurrent to it.

    Records meet their capture in one grouping by its id: that of a capture is its own, that of others the one they are
    concurrent to. Captures without a request or metadata keep null and an empty list; records that belong to no capture are
    left out. Of several captures with one id, or several requests to one, the smallest row is taken.
    """
    own = F.col("type").isin("response", "revisit")
    whole = F.struct("type", "id", "refers_to", "url", "date", "digest", "http_head", "http_length", "payload_bytes", "payload_digest", "payload")
    small = F.struct("id", "date", "http_head", "payload")
    of = F.when(own, F.col("id")).when(F.col("type").isin("request", "metadata"), F.col("concurrent_to"))
    t = records.withColumn("of", of).where("of is not null").groupBy("of").agg(
        F.min(F.when(own, whole)).alias("capture"), F.min(F.when(F.col("type") == "request", small)).alias("request"),
        F.sort_array(F.collect_list(F.when(F.col("type") == "metadata", small))).alias("metadata"),
    )
    return t.where("capture is not null").withColumnRenamed("of", "id")


def capture_report(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) to an archive, reads it back and returns one row for each capture.

    (page_id, payload_bytes, payload_digest, record_type, refers_to, url): all from the archive.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    write_archive(pages, path)
    t = transactions(read_records(spark, path, responses=False))
    key = F.regexp_extract(F.get("metadata", F.lit(0))["payload"].cast("string"), r"captureKey: (-?\d+)", 1)
    response = F.col("capture.type") == "response"
    t = t.select(
        F.when(key != "", key).cast("long").alias("page_id"), "id", F.col("capture.type").alias("record_type"), F.col("capture.refers_to").alias("to"), F.col("capture.url").alias("url"),
        F.when(response, F.col("capture.payload_bytes")).otherwise(F.col("capture.http_length")).alias("payload_bytes"),
        F.when(response, F.col("capture.payload_digest")).otherwise(F.col("capture.digest")).alias("payload_digest"),
    )
    t = stored(t, "transactions")
    keys = t.where("record_type = 'response'").select(F.col("id").alias("to"), F.col("page_id").alias("refers_to"))
    again = looked_up(t.where("record_type = 'revisit'"), "to", "id", keys)
    out = t.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).unionByName(again)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


ORACLE = """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, url, sha1(b) AS h, CAST(octet_length(b) AS BIGINT) AS n, max(page_id) OVER (PARTITION BY b) AS last FROM p)
SELECT page_id, n AS payload_bytes,
       translate(to_base(CAST('0x' || substr(h, 1, 10) AS BIGINT), 32, 8) || to_base(CAST('0x' || substr(h, 11, 10) AS BIGINT), 32, 8)
                 || to_base(CAST('0x' || substr(h, 21, 10) AS BIGINT), 32, 8) || to_base(CAST('0x' || substr(h, 31, 10) AS BIGINT), 32, 8),
                 '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to,
       coalesce(regexp_replace(url, '[\\r\\n]+', ' ', 'g'), 'about:blank') AS url
FROM d
"""
