"""WARC archives: written by Spark's text writer, read back in splits and
verified by boundary chains.

Writing: one record per row.  Of rows with equal payloads of ``min_bytes`` or
more, the one with the smallest id is a ``response`` and the others are
``revisit`` records that name it; smaller payloads are always responses.  An
archive holds ``records_per_file`` records at most.

Reading: the files are split at the magic ``WARC/1.0\\r\\n``, which a payload
may hold as well.  The pieces between are written once, with the file, the split
and the number that they got in this one scan, and all later steps read that
table: how the files would be split by another scan, with more or fewer
executors alive, does not matter.  Tasks emit, for each candidate, its offset
in the file and the offset at which its successor must start (head,
Content-Length and the closing CRLF CRLF).  Per file, pointer jumping from offset 0 marks the
candidates that the chain reaches; only those are records, and a piece that
follows a false magic is joined back to the record that holds it.  Candidates
are three numbers each and files are bounded, so a file's chain is a small
group; payloads are not gathered by file.

Defined results: null payload is written as empty; null url is left out of the
head; line breaks of any kind and control characters in a url are
percent-escaped, and heads are read line by line at CR LF only; rows that repeat an id are
records of their own, and with equal payloads all rows of the smallest id are
responses; rows with a null id revisit a row with an id if there is one, else
are responses.  An empty table writes an archive without records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.regex import once
from ..session import scratch_dir
from .common import cut, short

MAGIC = "WARC/1.0\r\n"
MIN_BYTES = 0
RECORDS_PER_FILE = 20_000
URN = "urn:page:"
DATE = "2000-01-01T00:00:00Z"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CONTROLS = r"[\x00-\x1F\x7F-\x9F\x{2028}\x{2029}]"


def sha1_base32(payload: Column) -> Column:
    """SHA-1 of a binary column, upper-case base32: 20 bits (5 hex digits) make 4 letters.
    The digest is taken once a row, each group of digits converted once."""
    def letters(g: Column) -> Column:
        return F.concat(*[F.substring(F.lit(BASE32), F.shiftright(g, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)])

    def group(h: Column, k: int) -> Column:
        return once(F.conv(F.substring(h, 5 * k + 1, 5), 16, 10).cast("int"), letters)

    return once(F.sha1(payload), lambda h: F.concat(*[group(h, k) for k in range(8)]))


def with_records(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, refers_to)."""
    p = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("payload"))
    p = p.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"),
                 sha1_base32(F.col("payload").cast("binary")).alias("payload_digest"))
    shared = (p.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes")
              .agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
              .filter("_n > 1 and _first is not null").drop("_n"))
    shared = cut(shared)
    on = ["payload_digest", "payload_bytes"]
    return (p.join(short(shared), on, "left")
            .select("page_id", "url", "payload", *reversed(on),
                    F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("refers_to")))


def escaped(url: Column) -> Column:
    """``url`` with control characters and line separators percent-escaped as UTF-8 bytes."""
    def letter(c: Column) -> Column:
        return F.when(c.rlike(CONTROLS), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c)

    return F.when(url.rlike(CONTROLS), F.array_join(F.transform(F.split(url, ""), letter), "")).otherwise(url)


def record_text(r: DataFrame) -> Column:
    """A record up to the last byte but one: the writer's line end closes it."""
    nl = F.lit("\r\n")
    revisit = F.col("refers_to").isNotNull()
    url = escaped(F.col("url"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    body = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    pid = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    head = F.concat(
        F.lit(MAGIC), F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), nl,
        F.lit(f"WARC-Record-ID: <{URN}"), pid, F.lit(">"), nl,
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), url, nl), F.lit("")),
        F.lit(f"WARC-Date: {DATE}\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"), nl,
        F.when(revisit, F.concat(F.lit(f"WARC-Refers-To: <{URN}"), F.col("refers_to").cast("string"),
                                 F.lit(">\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/"
                                       "identical-payload-digest\r\n"))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r"))


def write_warc(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES,
               records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write ``pages`` (page_id, url, html) as archives under ``path``."""
    r = with_records(pages, min_bytes)
    (r.select(record_text(r).alias("value")).write.option("lineSep", "\n")
     .option("maxRecordsPerFile", records_per_file).text(path))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block, mid, n, own): what stands between magics, from one
    scan, as a written table.  ``mid`` grows along a split; n: its bytes; own:
    the bytes that a record with this head has."""
    p = (spark.read.option("lineSep", MAGIC).text(path)
         .select("value", F.col("_metadata.file_path").alias("file"),
                 F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("mid")))
    head = F.when(F.instr("value", "\r\n\r\n") > 0, F.substring_index("value", "\r\n\r\n", 1))
    length = F.regexp_extract(F.substring_index(head, "\nContent-Length: ", -1), r"^([0-9]{1,18})(?:\r\n|\z)", 1)
    p = p.select("*", F.octet_length("value").cast("long").alias("n"),
                 F.when(F.col("value").startswith("WARC-Type: ") & (length != ""),
                        F.octet_length(head) + 8 + length.cast("long")).alias("own"))
    store = scratch_dir(spark, "warc-pieces")
    p.write.option("compression", "zstd").parquet(store)
    return spark.read.parquet(store)


def _reached(key, pdf):
    """One file's candidates (off, succ, mid) -> each piece's record: pointer
    jumping from offset 0 over the index of each candidate's successor."""
    import numpy as np
    import pandas as pd
    start = pdf[pdf["off"] < 0][["file", "mid", "off"]]
    pdf = pdf[pdf["off"] >= 0].sort_values("off", kind="stable")
    off, succ = pdf["off"].to_numpy(), pdf["succ"].to_numpy()
    n = len(off)
    at = np.searchsorted(off, succ)
    ok = (succ >= 0) & (at < n)
    ok[ok] = off[at[ok]] == succ[ok]
    jump = np.append(np.where(ok, at, n), n)
    seen = np.zeros(n + 1, bool)
    seen[:1] = n > 0 and off[0] == 0
    while True:  # after k rounds, the first 2**k nodes of the chain are seen
        new = jump[np.flatnonzero(seen)]
        if seen[new].all():
            break
        seen[new] = True
        jump = jump[jump]
    head = np.maximum.accumulate(np.where(seen[:n], np.arange(n), 0))
    out = pdf[["file", "mid", "off"]].copy()
    out["rec"] = off[head] if n else off
    out["pieces"] = np.bincount(head, minlength=n)[head] if n else 0
    return pd.concat([out, start.assign(rec=-1, pieces=0)])


def chain_index(pieces: DataFrame) -> DataFrame:
    """(file, mid, off, rec, pieces): of each piece the offset of the record
    that holds it and how many pieces that record has (none: what stands
    before a file's first magic)."""
    p = pieces.select("file", "block", "mid", "n", "own")
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = (p.groupBy("file", "block").agg(F.sum(F.col("n") + len(MAGIC)).alias("_len"))
              .select("file", "block", F.coalesce(F.sum("_len").over(before), F.lit(0)).alias("_start")))
    upto = W.partitionBy("file", "block").orderBy("mid").rowsBetween(W.unboundedPreceding, -1)
    # The first piece of a file is what stands before its first magic: nothing.
    p = (p.withColumn("_in", F.coalesce(F.sum(F.col("n") + len(MAGIC)).over(upto), F.lit(0)))
         .join(blocks, ["file", "block"])
         .select("file", "mid", "n", (F.col("_start") + F.col("_in") - len(MAGIC)).alias("off"), "own"))
    p = p.select("file", "mid", "off", F.coalesce(F.col("off") + len(MAGIC) + F.col("own"), F.lit(-1)).alias("succ"))
    return p.groupBy("file").applyInPandas(_reached, "file string, mid long, off long, rec long, pieces long")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, payload_digest, refers_to, http_length, payload) of every record."""
    # Most pieces are whole records; the others are few and meet the pieces without moving them.
    pieces = _pieces(spark, path)
    odd = cut(chain_index(pieces).filter("pieces <> 1"))
    whole = pieces.select("file", "mid", "value").join(short(odd.select("file", "mid")), ["file", "mid"], "left_anti").select("value")
    parts = (pieces.select("file", "mid", "value").join(short(odd.filter("pieces > 1")), ["file", "mid"]).groupBy("file", "rec")
             .agg(F.array_sort(F.collect_list(F.struct("off", "value"))).alias("_l"))
             .select(F.array_join(F.col("_l.value"), MAGIC).alias("value")))
    r = whole.unionAll(parts)
    head = F.substring_index("value", "\r\n\r\n", 1)
    rest = F.expr("substring(value, length(substring_index(value, '\\r\\n\\r\\n', 1)) + 5)")
    r = r.select(head.alias("_h"), rest.alias("_b"))

    def field(name: str, col: str = "_h") -> Column:
        v = F.regexp_extract(col, rf"(?dm)^{name}: ([^\r\n]*)", 1)
        return F.when(v != "", v)

    def urn(name: str) -> Column:
        v = F.regexp_extract("_h", rf"(?dm)^{name}: <{URN}([^>\r\n]*)>", 1)
        return F.when(v != "", v).cast("long")

    body = F.expr("substring(_b, length(substring_index(_b, '\\r\\n\\r\\n', 1)) + 5)")
    payload = F.substring(body, F.lit(1), F.length(body) - 4)
    kind = field("WARC-Type")
    return r.select(
        urn("WARC-Record-ID").alias("page_id"), field("WARC-Target-URI").alias("url"), kind.alias("record_type"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
        urn("WARC-Refers-To").alias("refers_to"),
        F.regexp_extract(F.substring_index("_b", "\r\n\r\n", 1), r"(?dm)^Content-Length: ([0-9]+)", 1)
        .cast("long").alias("http_length"),
        F.when(kind == "response", payload).alias("payload"))


def round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = scratch_dir(spark, "warc")
    write_warc(pages, path, min_bytes)
    return read_warc(spark, path)
