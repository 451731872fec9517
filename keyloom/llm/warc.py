"""WARC records kept in a content-addressed archive.

A payload is stored once, under its SHA-256; record headers are stored apart, byte for byte, with that digest; joins put
the records together again. Of records with equal payloads of at least ``revisit_from`` bytes the one with the largest
page id is the response and the others revisit it; every other record is a response with its own payload.

The stored payloads are checked on reading: a payload whose SHA-256 is not its key raises. Payload bytes are shuffled
once, after each task has dropped copies; the store is bucketed by digest, so reading records back does not shuffle them.

Edge cases: null html is an empty payload; null or repeated page ids are kept (among equal rows one is the response); null
ids sort before all others; control characters in a url are percent-encoded in its header; an empty table gives an empty archive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, bucketed, id_back, id_of, join_hot, let, materialize

#: The base32 alphabet of RFC 4648, and the dates of the records (the input has none).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2020-01-01T00:00:00Z"
CRLF = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 160 bits are 8 groups of 20 bits, each 4 letters."""
    def letters(x: Column) -> Column:
        group = lambda i: F.conv(F.substring(x, 5 * i + 1, 5), 16, 10).cast("int")
        one = lambda i, j: F.substring(F.lit(BASE32), F.shiftright(group(i), 15 - 5 * j).bitwiseAND(31) + 1, F.lit(1))
        return F.concat(*[one(i, j) for i in range(8) for j in range(4)])

    return let(F.sha1(payload), letters)


@dataclass(frozen=True)
class Archive:
    """The two tables: payloads (bucketed by digest) and headers; ``drop`` deletes the payloads."""

    payloads: DataFrame
    headers: DataFrame
    drop: Callable[[], None]

    def verified(self) -> DataFrame:
        """Payloads with ``n`` and ``sha1``; one that doesn't hash to its key raises."""
        bad = F.raise_error(F.concat(F.lit("payload does not match its digest: "), "digest"))
        ok = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(bad)
        return self.payloads.select("digest", ok.alias("payload")).withColumns({"n": F.octet_length("payload").cast("long"), "sha1": base32_sha1(F.col("payload"))})

    def records(self, only: str | None = None) -> DataFrame:
        """The records as they were given: header bytes, an empty line, payload (none for revisits), two line ends."""
        end, empty = F.encode(F.lit(CRLF * 2), "UTF-8"), F.encode(F.lit(""), "UTF-8")
        first = self.headers.where("kind = 'response'").join(self.verified(), "digest").select("uid", "kind", "digest", F.concat("header", "payload", end).alias("record"))
        again = self.headers.where("kind = 'revisit'").select("uid", "kind", "digest", F.concat("header", empty, end).alias("record"))
        return first if only == "response" else again if only == "revisit" else first.unionByName(again)

    def originals(self) -> DataFrame:
        """(uid, page_id, url, payload) of every page, revisits filled from the response's payload."""
        return self.headers.join(self.payloads, "digest").select("uid", "page_id", "url", "payload")


def write_archive(pages: DataFrame, revisit_from: int = 0) -> Archive:
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(id_of("page_id").alias("pid"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    keyed = rows.withColumn("digest", F.sha2("payload", 256))
    # A payload once by digest: copies go in each task, before the shuffle.
    payloads, drop = bucketed(keyed.groupBy("digest").agg(F.first("payload").alias("payload")), "warc_payloads", "digest")
    index = materialize(keyed.select(F.monotonically_increasing_id().alias("uid"), "pid", "url", "digest", F.octet_length("payload").cast("long").alias("n"), base32_sha1(F.col("payload")).alias("sha1")), "warc-index")
    winners = materialize(index.groupBy("digest").agg(F.max(F.struct("pid", "uid")).alias("w"), F.count(F.lit(1)).alias("times")), "warc-winners")
    whole = join_hot(index, winners, "digest", "times").withColumn("kind", F.when((F.col("n") < revisit_from) | (F.col("w.uid") == F.col("uid")), F.lit("response")).otherwise(F.lit("revisit")))
    # What could end a line, in any reader's eyes, is percent-encoded; other control characters go.
    safe = F.col("url")
    for mark in "\r\n\x0b\x0c\x85\u2028\u2029":
        safe = F.replace(safe, F.lit(mark), F.lit("".join(f"%{x:02X}" for x in mark.encode())))
    safe = F.regexp_replace(safe, "[\\x00-\\x1f\\x7f]", "")
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit(CRLF))
    given = lambda c, k: F.when(F.col(c) != NULL_ID, line(k, F.col(c).cast("string"))).otherwise(F.lit(""))
    revisit = F.col("kind") == "revisit"
    header = F.concat(
        F.lit("WARC/1.1" + CRLF), line("WARC-Type", F.col("kind")), line("WARC-Record-ID", F.concat(F.lit("<urn:keyloom:"), F.col("uid").cast("string"), F.lit(">"))), F.lit(f"WARC-Date: {DATE}{CRLF}"),
        line("WARC-Target-URI", safe), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))), given("pid", "WARC-Page-ID"),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", F.concat(F.lit("<urn:keyloom:"), F.col("w.uid").cast("string"), F.lit(">"))), F.when(F.col("w.pid") != NULL_ID, line("WARC-Refers-To-Page-ID", F.col("w.pid").cast("string"))).otherwise(F.lit("")))).otherwise(F.lit("")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n").cast("string"))), F.lit(CRLF),
    )
    headers = materialize(whole.select("uid", id_back("pid").alias("page_id"), "url", "digest", "kind", F.encode(header, "UTF-8").alias("header")), "warc-headers")
    return Archive(payloads, headers, drop)


def parse(records: DataFrame) -> DataFrame:
    """Fields of whole records: the header is what stands before the first empty line."""
    # Only the header is text. Its end is found in bytes (one character each in Latin-1), in the whole record where its first 64 KB have none.
    end = lambda b: F.instr(F.decode(b, "ISO-8859-1"), CRLF * 2)
    start = end(F.substring("record", 1, 65536))
    at = F.when(start > 0, start).otherwise(end(F.col("record")))
    head = F.decode(F.substring(F.col("record"), F.lit(1), F.col("__at")), "UTF-8")
    field = lambda k: F.regexp_extract("__head", rf"(?md)^{k}: ([^\r\n]*)\r?$", 1)
    number = lambda k: F.expr(f"try_cast(nullif(regexp_extract(__head, '(?md)^{k}: ([^\\\\r\\\\n]*)\\\\r?$', 1), '') as bigint)")
    rows = records.withColumn("__at", at + 3).withColumn("__head", head)
    body = F.substring(F.col("record"), F.col("__at") + 1, number("Content-Length").cast("int"))
    return rows.withColumn("__body", body).select(
        "digest", field("WARC-Type").alias("record_type"), number("WARC-Page-ID").alias("page_id"), number("WARC-Refers-To-Page-ID").alias("refers_to"), field("WARC-Target-URI").alias("url"), F.substring(field("WARC-Payload-Digest"), 6, 32).alias("header_digest"),
        F.octet_length("__body").cast("long").alias("body_bytes"), base32_sha1(F.col("__body")).alias("body_digest"), "record",
    )


def round_trip(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """Write the archive, put the records together again, parse them: one row per page, from what was read back."""
    archive = write_archive(pages, revisit_from)
    bad = F.raise_error(F.concat(F.lit("record does not match its digest: "), "digest"))
    first = materialize(parse(archive.records("response")).select("digest", "record_type", "page_id", "refers_to", F.col("body_bytes").alias("payload_bytes"), F.when(F.col("body_digest") == F.col("header_digest"), F.col("body_digest")).otherwise(bad).alias("payload_digest")), "warc-read")
    archive.drop()  # all payloads have been read back
    sizes = first.groupBy("digest").agg(F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest"))
    times = archive.headers.where("kind = 'revisit'").groupBy("digest").agg(F.count(F.lit(1)).alias("times"))
    again = parse(archive.records("revisit")).select("digest", "record_type", "page_id", "refers_to", "header_digest")
    again = join_hot(again, materialize(sizes.join(times, "digest"), "warc-sizes"), "digest", "times")
    again = again.withColumn("payload_digest", F.when(F.col("header_digest") == F.col("payload_digest"), F.col("payload_digest")).otherwise(bad))
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return first.select(*cols).unionByName(again.select(*cols))
