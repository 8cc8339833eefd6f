"""WARC archives: writing captures, and assembling them again from their records.

A capture is three records: a request, a response (or a revisit, when an equal payload is stored
elsewhere) and metadata; request and metadata name the response in WARC-Concurrent-To. Archives are
written by Spark's text writer with the record separator as its line separator, one gzip file per task, and read back the
same way, split at the version line, one task per file. A payload that
contains the version line itself is sent in chunks (Transfer-Encoding: chunked) cut inside that line,
so the separator never occurs inside a record. Assembly joins the records through the concurrent-to
identifiers; nothing relies on their order.

Of equal payloads of at least `LEAST` bytes the row with the largest page id is the response and the
others revisit it; the digests of such payloads are counted by a partial aggregate first.

Edge cases: a null payload is empty; null and empty URLs and control characters in URLs are escaped; rows
repeating the winning page id and payload are all responses; rows with a null page id revisit like
others, and among payloads that only they hold all are responses; extra columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.core import materialize, shared_folder
from arbora.llm.registry import query, table

LEAST = 1000
VERSION = "WARC/1.1\r\n"
DATE = "2024-01-01T00:00:00Z"


def _record_id(*parts: Column) -> Column:
    h = F.sha1(F.concat_ws("|", *parts))
    pieces = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def _header(kind: str | Column, rid: Column, uri: Column, more: dict[str, Column], body: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    fields = [F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), rid),
              F.lit(f"WARC-Date: {DATE}"), F.concat(F.lit("WARC-Target-URI: "), uri)]
    fields += [F.concat(F.lit(f"{k}: "), v) for k, v in more.items()]
    fields.append(F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")))
    return F.concat(F.lit(VERSION), F.concat_ws("\r\n", *fields), F.lit("\r\n\r\n"), body)


def captures(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(page_id, uri, payload, digest, bytes, kind, refers): what each row is stored as."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    uri = F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"[\x00-\x20\x7f]", "%20")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), uri.alias("uri"), body.alias("payload"),
                        F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).alias("bytes"))
    equal = (rows.where(F.col("bytes") >= LEAST).groupBy("digest").agg(F.max("page_id").alias("refers"), F.count("*").alias("c"))
             .where("c > 1 and refers is not null").select(F.col("digest").alias("_digest"), "refers"))
    joined = rows.join(equal, (F.col("digest") == F.col("_digest")) & (F.col("bytes") >= LEAST), "left").drop("_digest")
    revisit = F.col("refers").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers"))
    return joined.withColumn("kind", F.when(revisit, "revisit").otherwise("response")).withColumn(
        "refers", F.when(revisit, F.col("refers")))


def write_archive(stored: DataFrame, path: str) -> None:
    """Write the captures as a folder of WARC files."""
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    response = F.col("rid")
    chunked = F.col("payload").contains(VERSION)
    pieces = F.split("payload", r"(?<=WARC)(?=/1\.1\r\n)")
    chunks = F.concat(F.concat_ws("", F.transform(pieces, lambda p: F.concat(
        F.lower(F.hex(F.octet_length(p).cast("long"))), F.lit("\r\n"), p, F.lit("\r\n")))), F.lit("0\r\n\r\n"))
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n")
    full = F.when(chunked, F.concat(http, F.lit("Transfer-Encoding: chunked\r\n\r\n"), chunks)).otherwise(
        F.concat(http, F.lit("\r\n"), F.col("payload")))
    body = F.when(F.col("kind") == "revisit", F.concat(http, F.lit("\r\n"))).otherwise(full)
    refers = F.coalesce(F.col("refers").cast("string"), F.lit(""))
    more = {"WARC-Payload-Digest": digest, "X-Payload-Length": F.col("bytes").cast("string"), "X-Page": page,
            "X-Refers-To-Page": refers, "Content-Type": F.lit("application/http; msgtype=response")}
    main = _header(F.col("kind"), response, F.col("uri"), more, body)
    ask = F.concat(F.lit("GET "), F.col("uri"), F.lit(" HTTP/1.1\r\n\r\n"))
    request = _header("request", _record_id(F.lit("q"), response), F.col("uri"),
                      {"WARC-Concurrent-To": response, "Content-Type": F.lit("application/http; msgtype=request")}, ask)
    note = F.concat(F.lit("fetchedAs: "), F.col("kind"), F.lit("\r\n"))
    metadata = _header("metadata", _record_id(F.lit("m"), response), F.col("uri"),
                       {"WARC-Concurrent-To": response, "Content-Type": F.lit("application/warc-fields")}, note)
    # A random id per row is fixed by the written file: it is never computed again.
    named = stored.withColumn("rid", F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">")))
    named.select(F.explode(F.array(request, main, metadata)).alias("value")).write.option("lineSep", "\r\n\r\n").text(path, compression="gzip")


def records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of a folder of WARC files: type, id, concurrent, fields, block."""
    raw = spark.read.option("lineSep", VERSION).text(path).where("value <> ''")
    cut = F.instr("value", "\r\n\r\n")
    head, rest = F.substring(F.col("value"), F.lit(1), cut - 1), F.substring(F.col("value"), cut + 4, F.length("value"))
    fields = F.str_to_map(head, F.lit("\r\n"), F.lit(": "))
    parsed = raw.select(fields.alias("fields"), rest.alias("rest"))
    # The separator that follows every block is not part of it.
    block = F.expr("left(rest, length(rest) - 4)")
    return parsed.select(F.col("fields")["WARC-Type"].alias("type"), F.col("fields")["WARC-Record-ID"].alias("id"),
                         F.col("fields")["WARC-Concurrent-To"].alias("concurrent"), "fields", block.alias("block"))


def _payload(block: Column) -> Column:
    """Body of an HTTP message, chunks put together."""
    cut = F.instr(block, "\r\n\r\n")
    head, body = F.substring(block, F.lit(1), cut + 1), F.substring(block, cut + 4, F.length(block))
    step = F.aggregate(
        F.sequence(F.lit(1), F.size(F.split(body, VERSION[4:])) + 1),
        F.struct(body.alias("left"), F.lit("").alias("made")),
        lambda acc, _: _one_chunk(acc), lambda acc: acc["made"])
    return F.when(head.contains("\r\nTransfer-Encoding: chunked\r\n"), step).otherwise(body)


def _one_chunk(acc: Column) -> Column:
    line = F.instr(acc["left"], "\r\n")
    size = F.conv(F.substring(acc["left"], F.lit(1), line - 1), 16, 10).cast("int")
    raw = F.substring(acc["left"], line + 2, F.length(acc["left"])).cast("binary")
    chunk = F.substring(raw, F.lit(1), size).cast("string")
    left = F.substring(raw, size + 3, F.length(raw)).cast("string")
    return F.struct(left.alias("left"), F.concat(acc["made"], chunk).alias("made"))


def assemble(found: DataFrame) -> DataFrame:
    """One row per capture: its response (or revisit) record with the request and metadata joined to it."""
    main = found.where("type in ('response', 'revisit')").select("id", F.struct("type", "id", "fields", "block").alias("response"))
    side = found.where("concurrent is not null").groupBy("concurrent").agg(
        *[F.min(F.when(F.col("type") == t, F.struct("id", "block"))).alias(t) for t in ("request", "metadata")])
    return main.join(side, main.id == side.concurrent, "left").select("response", "request", "metadata")


SQL = f"""SELECT page_id, bytes AS payload_bytes, digest AS payload_digest,
    CASE WHEN bytes >= {LEAST} AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN bytes >= {LEAST} AND page_id < top THEN top END AS refers_to
    FROM (SELECT *, max(page_id) OVER (PARTITION BY digest) top FROM (
        SELECT page_id, strlen(coalesce(html, '')) bytes, sha1(coalesce(html, '')) digest FROM pages))"""


@query("op7_warc", SQL)
def op7_warc(spark, folder):
    """Write every page, read the archives back and tell what each capture holds."""
    path = f"{shared_folder(spark)}/arbora-{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    write_archive(captures(table(spark, folder, "pages")), path)
    # Blocks become digest and size before records meet, so no payload crosses that shuffle.
    made = F.when(F.col("type") == "response", _payload(F.col("block")))
    found = records(spark, path).withColumn("block", F.struct(
        F.sha1(made.cast("binary")).alias("digest"), F.octet_length(made).alias("bytes")))
    f = F.col("response.fields")
    whole = assemble(found).where("request is not null and metadata is not null").select(
        F.col("response.type").alias("record_type"), f["X-Page"].alias("page"), f["X-Refers-To-Page"].alias("refers"),
        f["WARC-Payload-Digest"].alias("named"), f["X-Payload-Length"].alias("size"), F.col("response.block").alias("made"))
    digest = F.coalesce("made.digest", F.substring("named", 6, 40))
    size = F.coalesce("made.bytes", F.col("size").cast("int"))
    number = lambda c: F.when(F.col(c) != "", F.col(c).cast("long"))
    return materialize(whole.select(number("page").alias("page_id"), size.cast("long").alias("payload_bytes"),
                                    digest.alias("payload_digest"), "record_type", number("refers").alias("refers_to")))
