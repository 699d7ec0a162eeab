"""Content-addressed WARC archive.

``payloads`` holds each distinct payload once, under its SHA-256; ``records``
holds the exact header bytes of every record with the address of its payload.
Two payloads count as equal only when SHA-256, SHA-1 and length agree, so the
address is verified by a second digest when it is written; when it is read, the
address is computed again from the stored bytes and must match.  A record is
rebuilt as header, payload, and the closing line breaks.

All of it is DataFrame functions.  Payload bytes are shuffled once to be stored
(one row per distinct payload and map task at most) and once to be read; the
digests of a payload that a third of all pages share are narrow rows, and the
joins on them leave the splitting of hot addresses to adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from divspark.llm.common import Workspace, pick, read

DATE = "2024-01-01T00:00:00Z"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"


def base32_of_hex(digest: Column) -> Column:
    """Base32 (RFC 4648, no padding is due) of a 160-bit digest given in hex: every
    five hex digits are four letters."""
    letters = []
    for k in range(0, 40, 5):
        bits = F.conv(F.substring(digest, k + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substr(F.lit(ALPHABET), F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*letters)


def _record_id(page: Column, row: Column, url: Column) -> Column:
    h = F.md5(F.concat_ws("|", page.cast("string"), row.cast("string"), url).cast("binary"))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts]), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing when the value is null; line breaks cannot end it."""
    safe = F.regexp_replace(F.regexp_replace(value.cast("string"), "\r", "%0D"), "\n", "%0A")
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def write_archive(ws: Workspace, df: DataFrame, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html", *, min_bytes: int = 0, date: str = DATE) -> tuple[DataFrame, DataFrame]:
    """Store ``records (header, address)`` and ``payloads (address, payload)``.

    Of records with equal payloads of at least ``min_bytes`` bytes the one with the
    smallest id is the response (a null id last; of repeated rows one), the others
    revisit it.  A null page is an empty payload.
    """
    pages = pick(df, page_id=id_col, url=url_col, html=html_col).select(
        "page_id", F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    pages = pages.withColumns({"address": F.unhex(F.sha2("payload", 256)), "sha1": F.sha1("payload"),
                               "bytes": F.octet_length("payload").cast("long")})
    same = ["address", "sha1", "bytes"]
    digests = ws.store(pages.drop("payload").withColumn("row", F.monotonically_increasing_id()), "digests")
    first = ws.store(digests.groupBy(*same).agg(
        F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row", "url")).alias("first")), "first")

    rows = digests.join(first, same)
    revisit = (F.col("bytes") >= min_bytes) & (F.col("row") != F.col("first.row"))
    own = _record_id(F.col("page_id"), F.col("row"), F.col("url"))
    other = _record_id(F.col("first.page_id"), F.col("first.row"), F.col("first.url"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("bytes").cast("string"), F.lit(END))
    kept = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", own), _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Page-ID", F.col("page_id")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha1")))),
        _line("WARC-Refers-To", F.when(revisit, other)),
        _line("WARC-Refers-To-Page-ID", F.when(revisit, F.col("first.page_id"))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _line("Content-Length", kept), F.lit("\r\n"), http)
    records = ws.store(rows.select(F.encode(header, "utf-8").alias("header"), "address"), "records")

    # the payload of each address, from the page that is its response
    key = F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("key")
    chosen = first.select("address", F.col("first.page_id").alias("page_id")).select("address", key)
    payloads = ws.store(pages.select("address", key, "payload").join(chosen, ["address", "key"], "left_semi")
                        .dropDuplicates(["address", "key"]).select("address", "payload"), "payloads")
    ws.drop("digests", "first")
    return records, payloads


def read_records(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """Original records by joining headers to payloads: ``header, payload, record``.

    ``payload`` is the full payload, of a revisit too; ``record`` the bytes of the
    WARC record (a revisit's has no payload).  Fails on a payload whose bytes do
    not have the address they are stored under.
    """
    sound = F.when(F.unhex(F.sha2("payload", 256)) == F.col("address"), F.col("payload")).otherwise(
        F.raise_error(F.lit("archive: stored payload does not match its address")))
    whole = records.join(payloads.select("address", sound.alias("payload")), "address")
    is_revisit = F.contains(F.decode("header", "utf-8"), F.lit("\r\nWARC-Type: revisit\r\n")) | \
        F.startswith(F.decode("header", "utf-8"), F.lit("WARC/1.1\r\nWARC-Type: revisit\r\n"))
    body = F.when(is_revisit, F.lit(b"")).otherwise(F.col("payload"))
    return whole.select("header", "payload", F.concat("header", body, F.lit(END.encode())).alias("record"))


def field(text: Column, name: str) -> Column:
    """A header field of a record, null when it is absent."""
    value = F.regexp_extract(text, rf"(?s)\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(value != "", value)


def archive_index(records: DataFrame, payloads: DataFrame, id_type: str = "bigint") -> DataFrame:
    """What the archive says of each page, parsed out of the bytes of the rebuilt records.

    A response's payload is cut from its own record, after the HTTP header and as long as
    the record says; a revisit's is the one it refers to.  Fails on a record that is not as
    long as its header says, and on a payload that has not the digest in its header.
    """
    def sound(value: Column, holds: Column, message: str) -> Column:
        return F.when(holds, value).otherwise(F.raise_error(F.lit(f"archive: {message}")))
    whole = read_records(records, payloads).select(
        "record", "payload", F.substring_index(F.decode("record", "utf-8"), END, 1).alias("head"))
    head = F.concat(F.col("head"), F.lit("\r\n"))
    start, length = F.octet_length("head") + len(END), field(head, "Content-Length").cast("int")
    block = F.substring(F.col("record"), start + 1, length)
    whole = whole.select(
        "payload", head.alias("head"),
        sound(block, F.octet_length("record") == start + length + len(END), "record length does not match its header").alias("block"))
    body = F.substring(F.col("block"), F.octet_length(F.substring_index(F.decode("block", "utf-8"), END, 1)) + len(END) + 1,
                       F.octet_length("block"))
    kind, text = field(F.col("head"), "WARC-Type"), F.col("head")
    whole = whole.select("head", kind.alias("record_type"), F.when(kind == "revisit", F.col("payload")).otherwise(body).alias("payload"))
    digest = F.regexp_extract(field(text, "WARC-Payload-Digest"), "^sha1:(.*)$", 1)
    return whole.select(
        field(text, "WARC-Page-ID").cast(id_type).alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        sound(digest, digest == base32_of_hex(F.sha1("payload")), "payload does not match the digest in its header")
        .alias("payload_digest"), "record_type", field(text, "WARC-Refers-To-Page-ID").cast(id_type).alias("refers_to"))


def archive(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *,
            min_bytes: int = 0) -> DataFrame:
    """Write the archive of all rows and read it back: ``page_id, payload_bytes,
    payload_digest, record_type, refers_to``, one row per input row.

    A null url leaves its header out, a null id too (it reads back as null); an
    empty table gives an empty archive; extra columns are ignored.
    """
    ws = Workspace(df.sparkSession, "warc")
    records, payloads = write_archive(ws, df, id_col, url_col, html_col, min_bytes=min_bytes)
    return archive_index(records, payloads, df.schema[id_col].dataType.simpleString())


def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(read(spark, sf_dir, "pages"))


ORACLE_SQL = """
WITH d AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first_id FROM d),
letters AS (
  SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1), ''
           ORDER BY i) AS b32
  FROM d, range(32) t(i) GROUP BY page_id)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, b32 AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM r JOIN letters USING (page_id)
"""
