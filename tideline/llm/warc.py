"""WARC archives with revisit records: write each repeated payload once, and read the archives back.

Headers (digest, length, id) are shuffled by payload digest and reduced to one original per
repeated payload; partial aggregation collapses a hot payload before that shuffle. The rows then
meet the short table of originals on the digest, a join whose hot partitions Spark can split. A
record whose payload was seen before becomes a revisit record with fresh headers and no payload.

Archives are text files of Spark's own writer, whose record separator is the CRLF CRLF that ends a
WARC record, compressed with gzip as a whole. They are read by streaming, never a file at a time.

Defined results: a null payload is empty; payloads shorter than ``least`` bytes are always
responses; the original is the smallest id, and rows that repeat its id and payload are responses
as well; rows with a null id are revisits if any row with an id has the payload, else responses. A
null URL leaves the header out; line breaks in a URL are escaped. An empty table gives no archive
records.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
END = CRLF + CRLF
READ = "page_id bigint, url string, record_type string, refers_to bigint, stated_digest string, payload string, payload_bytes bigint, payload_digest string"


def resolve_revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """(page_id, url, payload, digest, bytes, refers_to); refers_to is null for responses.

    ``pages`` needs page_id, url and html; other columns are ignored.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha2(F.col("payload").cast("binary"), 256), "bytes": F.octet_length("payload").cast("bigint")})
    headers = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    originals = headers.where("n > 1").select("digest", "first")
    return rows.join(originals, "digest", "left").select(
        "page_id", "url", "payload", "digest", "bytes",
        F.when(F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first"))), F.col("first")).alias("refers_to"),
    )


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def _fields(**named: Column) -> Column:
    """Header lines; a null value leaves its line out."""
    return F.concat(*[F.coalesce(F.concat(F.lit(k.replace("_", "-") + ": "), v, F.lit(CRLF)), F.lit("")) for k, v in named.items()])


def records(resolved: DataFrame, date: str) -> DataFrame:
    """One ``value`` per row: a whole WARC record but for the CRLF CRLF that ends it."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(END))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    profile = F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    kept = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    head = _fields(
        WARC_Type=F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        WARC_Record_ID=_urn(F.col("page_id")),
        WARC_Date=F.lit(date),
        WARC_Target_URI=url,
        WARC_Payload_Digest=F.concat(F.lit("sha256:"), F.col("digest")),
        WARC_Profile=F.when(revisit, profile),
        WARC_Refers_To=F.when(revisit, _urn(F.col("refers_to"))),
        Content_Type=F.lit("application/http; msgtype=response"),
        Content_Length=(F.octet_length(http) + F.octet_length(kept)).cast("string"),
    )
    return resolved.select(F.concat(F.lit(f"WARC/1.1{CRLF}"), head, F.lit(CRLF), http, kept).alias("value"))


def write_archives(pages: DataFrame, path: str, least: int = 100, date: str = "1970-01-01T00:00:00Z") -> str:
    """Write deduplicated archives into the new folder ``path``, which executors must share."""
    records(resolve_revisits(pages, least), date).write.option("lineSep", END).option("compression", "gzip").text(path)
    return path


def _id(urn: str | None) -> int | None:
    name = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(name) if name.lstrip("-").isdigit() else None


def _record(data: bytes) -> tuple[dict[str, str], bytes] | int:
    """(headers, block) of a whole record, or how many bytes a longer ``data`` needs at least."""
    cut = data.find(b"\r\n\r\n")
    if cut < 0:
        return len(data) + 1
    head = dict(x.split(": ", 1) for x in data[:cut].decode().split(CRLF)[1:])
    end = cut + 4 + int(head["Content-Length"])
    return (head, data[cut + 4 : end]) if end <= len(data) else end


def _rows(pieces: Iterator[bytes]) -> Iterator[tuple]:
    """Records from the pieces between CRLF CRLF; only the record at hand is held."""
    held: list[bytes] = []
    size, need = 0, 0
    for piece in pieces:
        if not held:
            piece = piece.lstrip(b"\r\n")
            if not piece:
                continue
        held += [piece, b"\r\n\r\n"]
        size += len(piece) + 4
        if size < need:
            continue
        got = _record(data := b"".join(held))
        if isinstance(got, int):
            held, need = [data], got
            continue
        head, block = got
        held, size, need = [], 0, 0
        payload = block.partition(b"\r\n\r\n")[2]
        revisit = head["WARC-Type"] == "revisit"
        own = (None, None, None) if revisit else (payload.decode(), len(payload), hashlib.sha256(payload).hexdigest())
        yield _id(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), head["WARC-Type"], _id(head.get("WARC-Refers-To")), head["WARC-Payload-Digest"].removeprefix("sha256:"), *own
    if b"".join(held).strip():
        raise ValueError("an archive ends inside a record")


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the archives in ``path``: page_id, url, record_type, refers_to, stated_digest, and for
    responses payload (null without ``payloads``), payload_bytes and payload_digest as found in the file."""
    names = [x.split()[0] for x in READ.split(", ")]

    def parse(batches):
        def flat():
            for b in batches:
                yield from (x.as_py().encode() for x in b.column(0))

        held, size = [], 0
        for row in _rows(flat()):
            size += (row[6] or 0) + 100
            held.append(row if payloads else (*row[:5], None, *row[6:]))
            if size > 4_000_000:
                yield as_batch(held)
                held, size = [], 0
        if held:
            yield as_batch(held)

    def as_batch(rows):
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names=names)

    return spark.read.option("lineSep", END).text(path).mapInArrow(parse, READ)


def follow_revisits(read: DataFrame) -> DataFrame:
    """Join revisit records to the responses they refer to: payload_bytes and payload_digest of every record.

    A response that repeats its page_id counts once.
    """
    heads = read.select("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest")
    found = read.where("record_type = 'response' AND page_id IS NOT NULL").groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("stated_digest")).agg(F.max("payload_bytes").alias("of_bytes"))
    revisits = read.where("record_type = 'revisit'").select("page_id", "url", "record_type", "refers_to", "stated_digest")
    joined = revisits.join(found, ["refers_to", "stated_digest"], "left").select("page_id", "url", "record_type", "refers_to", F.col("of_bytes").alias("payload_bytes"), F.when(F.col("of_bytes").isNotNull(), F.col("stated_digest")).alias("payload_digest"))
    return heads.where("record_type = 'response'").unionByName(joined)
