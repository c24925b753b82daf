"""WARC archives: writing with revisits and segments, reading back, reassembly, chunked decoding.

Writing: one response record per page with the payload in an HTTP block, chunked framing.
Of equal payloads of at least ``MIN_REVISIT`` bytes the page with the smallest id is written, the
others are revisits that refer to it. Blocks beyond ``SEGMENT_BYTES`` go on in continuation records.
Archives are written by Spark's text writer with the record separator, at most ``RECORDS`` records a
file, so a file has a bounded size.

Reading: archives are parsed by their content lengths. Continuation records are grouped by their origin's
id, put in order of segment number and verified against the total length; then the chunked
framing is decoded. Records that are not segmented pass without a shuffle.

Defined results: a null payload is empty; payloads under ``MIN_REVISIT`` bytes are all responses; rows equal in id and
payload share one record id: each comes back as a row, with the smallest id all as responses; a null
id is never the smallest while others are there; extra columns are not read. Where a segment is missing, the first one too,
the record comes back with a null payload and ``complete`` false (known by its origin's id, and by page and URL where a segment
names them). So does a record cut short. Bytes that are no record are one row of type ``unreadable`` for each
stretch of them; reading goes on at the next record.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from sensorlake.functions.shipping import by_value
from sensorlake.llm.bloom import cells_for, packed, probe, two_cells
from sensorlake.llm.common import apart, bound_batches, written
from sensorlake.session import ensure_checkpoint_dir

by_value(__name__)

MIN_REVISIT = 100
SEGMENT_BYTES = 64 << 10
CHUNK_BYTES = 8 << 10
RECORDS = 1024
#: Records carry one fixed date, so that a rewritten task writes the same bytes.
DATE = "2020-01-01T00:00:00Z"
END = "\r\n\r\n"


# --------------------------------------------------------------------------- writing
def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = []
    for a in range(0, len(payload), size):
        part = payload[a:a + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def _record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + END.encode() + block


def _escaped(text: str | None) -> str | None:
    """A header value stays on its line."""
    return None if text is None else text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unescaped(text: str | None) -> str | None:
    return None if text is None else text.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def _records(segment: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n")
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            own = f"<urn:uuid:{row['rid']}>"
            common = [("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", _escaped(row["url"])),
                      ("WARC-Payload-Digest", f"sha256:{row['digest']}"), ("X-Page-ID", _escaped(row["id"])),
                      ("Content-Type", "application/http;msgtype=response")]
            if row["first"] is not None:
                out.append(_record([("WARC-Type", "revisit"), *common, ("WARC-Refers-To", f"<urn:uuid:{row['first']}>"),
                                    ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")],
                                   b""))
                continue
            block = http + chunked(row["payload"])
            parts = [block[a:a + segment] for a in range(0, len(block), segment)]
            number = "1" if len(parts) > 1 else None
            out.append(_record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", number)], parts[0]))
            for k, part in enumerate(parts[1:], 2):
                total = str(len(block)) if k == len(parts) else None
                out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{row['rid']}#{k}>"),
                                    ("WARC-Date", DATE), ("WARC-Target-URI", _escaped(row["url"])), ("X-Page-ID", _escaped(row["id"])),
                                    ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(k)),
                                    ("WARC-Segment-Total-Length", total)], part))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])


def _record_id(page: Column, digest: Column) -> Column:
    h = F.sha2(F.concat_ws("|", F.coalesce(page, F.lit("null")), digest), 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   segment_bytes: int = SEGMENT_BYTES) -> None:
    """Archives of ``pages`` under ``path``."""
    bound_batches(pages.sparkSession)
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    own = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), payload.alias("payload")).select(
        "page", "url", "payload", F.sha2("payload", 256).alias("digest"))
    # payloads that may repeat, by a filter of bounded size; only those rows are shuffled
    large = F.octet_length("payload") >= MIN_REVISIT
    hashes = own.where(large).select(F.xxhash64("digest").alias("h"))
    cells = cells_for(pages.count())
    words = written(packed(hashes.select(F.explode(F.array(*two_cells("h", cells))).alias("cell"))
                           .groupBy("cell").count().where("count > 1")), "repeated-payloads")
    probed = probe(own.withColumn("h", F.xxhash64("digest")), "h", words, cells, "may")
    again = probed.where(F.col("may") & large)
    least = again.groupBy(F.col("digest").alias("of")).agg(F.min("page").alias("least"))
    joined = again.join(apart(least), F.col("digest") == F.col("of")).select("page", "url", "payload", "digest", "least")
    alone = probed.where(~(F.col("may") & large)).select(
        "page", "url", "payload", "digest", F.col("page").alias("least"))
    rows = joined.unionByName(alone)
    page, least_page = F.col("page").cast("string"), F.col("least").cast("string")
    revisit = F.col("least").isNotNull() & ~F.col("page").eqNullSafe(F.col("least"))
    rows = rows.select(page.alias("id"), "url", F.when(~revisit, F.col("payload")).alias("payload"), "digest",
                       _record_id(page, F.col("digest")).alias("rid"),
                       F.when(revisit, _record_id(least_page, F.col("digest"))).alias("first"))
    (rows.mapInArrow(partial(_records, segment_bytes), "record binary").select(F.col("record").cast("string"))
     .write.option("lineSep", END).option("maxRecordsPerFile", RECORDS).text(path))


# --------------------------------------------------------------------------- reading
_FIELDS = {"WARC-Type": "kind", "WARC-Record-ID": "rid", "X-Page-ID": "page", "WARC-Target-URI": "url",
           "WARC-Payload-Digest": "digest", "WARC-Refers-To": "refers", "WARC-Segment-Origin-ID": "origin",
           "WARC-Segment-Number": "number", "WARC-Segment-Total-Length": "total"}
_ROW = pa.schema([(x, pa.int64() if x in ("number", "total") else pa.string()) for x in _FIELDS.values()]
                 + [("block", pa.binary())])


def _header(head: bytes) -> dict | None:
    """Fields of a record's header by our names, and its ``size``; None if it can't be read."""
    try:
        fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
        row = {own: fields.get(name) for name, own in _FIELDS.items()}
        for x in ("number", "total"):
            row[x] = None if row[x] is None else int(row[x])
        return row | {"size": int(fields["Content-Length"]), "page": _unescaped(row["page"]), "url": _unescaped(row["url"])}
    except (ValueError, KeyError):
        return None


def records_of(content: bytes) -> Iterator[dict]:
    """Records of one archive, by their content lengths. A record cut short has no block; stretches
    that are no record are rows of kind ``unreadable``."""
    at, end = 0, END.encode()
    while at < len(content):
        stop = content.find(end, at)
        row = _header(content[at:stop]) if stop >= 0 and content[at:at + 5] == b"WARC/" else None
        if row is None or row["size"] < 0:
            yield {own: None for own in _FIELDS.values()} | {"kind": "unreadable", "block": None}
            following = content.find(end + b"WARC/", at)
            at = len(content) if following < 0 else following + 4
            continue
        size = row.pop("size")
        block = content[stop + 4:stop + 4 + size]
        whole = len(block) == size and content[stop + 4 + size:stop + 8 + size] in (end, b"")
        yield row | {"block": block if whole else None}
        following = content.find(end + b"WARC/", stop)
        at = stop + 8 + size if whole else len(content) if following < 0 else following + 4


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            rows, size = [], 0
            for row in records_of(content.as_py()):
                rows.append(row)
                size += len(row["block"] or b"")
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, _ROW)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, _ROW)


def unchunked(body: bytes) -> bytes | None:
    """The payload of chunked framing; null if the framing is broken."""
    parts, at = [], 0
    while True:
        stop = body.find(b"\r\n", at)
        if stop < 0:
            return None
        try:
            size = int(body[at:stop].split(b";")[0], 16)
        except ValueError:
            return None
        if size == 0:
            return b"".join(parts)
        at = stop + 2
        if body[at + size:at + size + 2] != b"\r\n":
            return None
        parts.append(body[at:at + size])
        at += size + 2


@F.arrow_udf(BinaryType())
def _payload(blocks: pa.Array) -> pa.Array:
    out = []
    for block in blocks:
        head, gap, body = (block.as_py() or b"").partition(b"\r\n\r\n")
        if not gap:
            out.append(None)
        else:
            out.append(unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body)
    return pa.array(out, pa.binary())


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per page record: page (text), url, record_type, payload (null for revisits), digest (as
    written), complete, rid and refers (record ids)."""
    bound_batches(spark)
    rows = (spark.read.format("binaryFile").load(path).select("content")
            .mapInArrow(_parsed, ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}"
                                           for f in _ROW if f.name != "block") + ", block binary"))
    cols = ["page", "url", "kind", "digest", "rid", "refers", "block"]
    whole = rows.where("kind <> 'continuation' AND number IS NULL").select(*cols, F.col("block").isNotNull().alias("complete"))

    text = F.col("block").cast("string")                     # the same bytes: strings can be joined in one step
    # a block that is null (cut short) leaves its place empty, so that the lengths don't agree
    parts = (rows.where("kind = 'continuation'").groupBy("origin", "number")
             .agg(F.first("block", ignorenulls=True).alias("block"), *[F.max(c).alias(c) for c in ("total", "page", "url")])
             .groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("number", text.alias("text")))).alias("parts"),
                                    F.max("total").alias("total"), F.max("page").alias("part_page"), F.max("url").alias("part_url")))
    first = rows.where("kind = 'response' AND number = 1")
    tail = F.array_join("parts.text", "")
    in_order = F.col("parts.number") == F.sequence(F.lit(2).cast("long"), F.size("parts").cast("long") + 1)
    # on both sides: first segments without the others, and continuations without their first one
    joined = first.select(cols).join(parts, F.col("rid") == F.col("origin"), "full").withColumn(
        "complete", F.coalesce(in_order & (F.octet_length("block") + F.octet_length(tail) == F.col("total")), F.lit(False)))
    again = joined.withColumn("block", F.when(F.col("complete"), F.concat(F.col("block"), tail.cast("binary"))))
    again = again.select(F.coalesce("page", "part_page").alias("page"), F.coalesce("url", "part_url").alias("url"),
                         F.coalesce("kind", F.lit("response")).alias("kind"), "digest", F.coalesce("rid", "origin").alias("rid"),
                         "refers", "block", "complete")
    found = whole.unionByName(again)
    return found.select("page", "url", F.col("kind").alias("record_type"),
                        F.when(F.col("kind") == "response", _payload("block")).alias("payload"),
                        F.regexp_replace("digest", "^sha256:", "").alias("digest"), "complete", "rid", "refers")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               path: str | None = None) -> DataFrame:
    """Writes archives of ``pages`` and reads them back: page_id, payload_bytes, payload_digest,
    record_type, refers_to and complete."""
    spark = pages.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/sensorlake/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, id_col, url_col, html_col)
    kind = pages.schema[id_col].dataType
    rows = written(read_archives(spark, path).select(
        F.col("page").cast(kind).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"), "record_type", "complete", "rid", "refers"), "records")
    responses = rows.where("record_type = 'response'")
    target = responses.select(F.col("rid").alias("target"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("b"),
                              F.col("payload_digest").alias("s")).dropDuplicates(["target"])
    revisits = (rows.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest")
                .join(apart(target), F.col("refers") == F.col("target"), "left")
                .withColumnsRenamed({"b": "payload_bytes", "s": "payload_digest"}))
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "complete"]
    return responses.withColumn("refers_to", F.lit(None).cast(kind)).select(cols).unionByName(revisits.select(cols))
