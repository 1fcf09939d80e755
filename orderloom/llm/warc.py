r"""A content-addressed WARC archive: payload bytes once, record headers apart, records rebuilt by joins.

write_archive() leaves two Parquet tables in the shared folder: `payloads` (digest, payload), one row for each distinct
payload that a response carries, and `records` (one row a record: its exact header bytes and the digest of what follows).
A payload's name is its SHA-256 with its SHA-1 and length beside it: two payloads are one only if all three agree.
read_archive() joins the two into the records' bytes, from which parse_records() reads everything anew and digests each
payload again. Everything is DataFrame operations; digests are found before anything is shuffled, and a payload that very
many pages share is stored and moved once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, table

END = "\r\n"
#: The digits of radix 32 and the alphabet of base32.
RADIX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(digest: Column) -> Column:
    """40 hex digits as 32 base32 digits: five of one are four of the other."""
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), RADIX32, BASE32)


def _header(name: str, value: Column) -> Column:
    """A header line; nothing for a null value. CR and LF are percent-encoded, as they would end the line."""
    safe = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(END)), F.lit(""))


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", min_bytes: int = 0,
                  date: str = "2024-01-01T00:00:00Z") -> tuple[DataFrame, DataFrame]:
    """records (uid, digest, record_type, header) and payloads (digest, payload), both written.

    Of records whose payloads are equal and have min_bytes or more, that with the smallest id is a response and the others
    revisit it; shorter ones are all responses. A null text is an empty payload; a null id comes after all others; rows
    that repeat an id are records each, of which one is the response. Other columns are not read; an empty table gives an empty archive.
    """
    payload = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    staged = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    staged = staged.withColumn("uid", F.monotonically_increasing_id())
    digest = F.concat_ws(":", F.sha2("payload", 256), F.sha1("payload"), F.octet_length("payload"))
    staged = materialize(staged.select("uid", "id", "url", digest.alias("digest"), F.octet_length("payload").cast("long").alias("n"), "payload"), "staged", compression="zstd")

    first = F.min(F.struct(F.isnull("id").alias("no_id"), "id", "uid"))
    firsts = staged.where(F.col("n") >= min_bytes).groupBy("digest").agg(first.alias("first")).select("digest", F.col("first.uid").alias("first_uid"), F.col("first.id").alias("first_id"))
    firsts = materialize(firsts, "first-records")

    heads = staged.select("uid", "id", "url", "digest", "n").join(firsts, "digest", "left")
    revisit = F.coalesce(F.col("first_uid") != F.col("uid"), F.lit(False))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("n"), F.lit(END + END))
    uri = lambda uid: F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(uid.cast("string")), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    header = F.concat(
        F.lit(f"WARC/1.1{END}"),
        _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _header("WARC-Record-ID", uri(F.col("uid"))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Page-ID", F.col("id")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.split_part("digest", F.lit(":"), F.lit(2))))),
        _header("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _header("WARC-Refers-To", F.when(revisit, uri(F.col("first_uid")))),
        _header("WARC-Refers-To-Page-ID", F.when(revisit, F.col("first_id"))),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))),
        F.lit(END),
        http,
    )
    records = heads.select("uid", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.encode(header, "UTF-8").alias("header"))
    records = materialize(records, "warc-records")

    stored = staged.where(F.col("n") >= min_bytes).join(firsts.select(F.col("first_uid").alias("uid")), "uid", "left_semi").select("digest", "payload")
    if min_bytes > 0:
        short = staged.where(F.col("n") < min_bytes).groupBy("digest").agg(F.first("payload").alias("payload"))
        stored = stored.unionByName(short)
    payloads = materialize(stored, "warc-payloads", compression="zstd")
    discard(staged, firsts)
    return records, payloads


def read_archive(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """uid and record: each record's bytes as a WARC file has them, the payload joined to those that carry one."""
    end = F.encode(F.lit(END + END), "UTF-8")
    carrying = records.where("record_type = 'response'").join(payloads, "digest").select("uid", F.concat("header", "payload", end).alias("record"))
    return carrying.unionByName(records.where("record_type <> 'response'").select("uid", F.concat("header", end).alias("record")))


def parse_records(archive: DataFrame, id_type: str = "bigint") -> DataFrame:
    """What each record's bytes say: uid, page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload, intact.

    Ids are read as id_type; an id that is none of that type is null.

    For a response, length and digest are those of the bytes themselves, and intact tells whether they agree with its
    headers; for a revisit they are those its headers give of the payload it refers to, and payload is null.
    """
    text = F.decode("record", "UTF-8")
    head = archive.withColumn("warc", F.split_part(text, F.lit(END + END), F.lit(1))).withColumn("http", F.split_part(text, F.lit(END + END), F.lit(2)))
    value = lambda part, name: F.nullif(F.regexp_extract(part, rf"(?m)^{name}: ([^\r\n]*)\r?$", 1), F.lit(""))
    offset = F.octet_length("warc") + F.octet_length("http") + 8
    size = value(F.col("warc"), "Content-Length").cast("long") - F.octet_length("http") - 4
    rows = head.select(
        "uid",
        value(F.col("warc"), "WARC-Page-ID").try_cast(id_type).alias("page_id"),
        value(F.col("warc"), "WARC-Target-URI").alias("url"),
        value(F.col("warc"), "WARC-Type").alias("record_type"),
        value(F.col("warc"), "WARC-Refers-To-Page-ID").try_cast(id_type).alias("refers_to"),
        F.regexp_replace(value(F.col("warc"), "WARC-Payload-Digest"), "^sha1:", "").alias("said_digest"),
        value(F.col("http"), "Content-Length").cast("long").alias("said_bytes"),
        F.substring(F.col("record"), offset + 1, size.cast("int")).alias("payload"),
    )
    carries = F.col("record_type") == "response"
    rows = rows.withColumn("payload", F.when(carries, F.col("payload"))).withColumn("own", F.when(carries, base32_of_hex(F.sha1("payload"))))
    intact = F.when(carries, (F.col("own") == F.col("said_digest")) & (F.octet_length("payload") == F.col("said_bytes")))
    return rows.select(
        "uid", "page_id", "url", "record_type",
        F.coalesce(F.octet_length("payload").cast("long"), "said_bytes").alias("payload_bytes"),
        F.coalesce("own", "said_digest").alias("payload_digest"), "refers_to", "payload", intact.alias("intact"),
    )


def op10_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    records, payloads = write_archive(pages)
    return parse_records(read_archive(records, payloads), dict(pages.dtypes)["page_id"]).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (
  SELECT page_id, octet_length(encode(t)) AS payload_bytes, sha1(t) AS hex, min(page_id) OVER (PARTITION BY t) AS first_id FROM p),
b AS (
  SELECT d.*, (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, 1 + 5 * CAST(i // 4 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT), 1), '' ORDER BY i)
               FROM range(32) r(i)) AS payload_digest
  FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to,
       CASE WHEN page_id = first_id THEN true END AS intact
FROM b
"""
