"""WARC archives of pages: writing with chunked transfer framing and segments, reading with reassembly.

Writing: every page is a record, named after its id and its row's place in the table. Of pages with equal payloads the one with the
largest id is a response, the others are revisits that refer to its record by name; pages without an equal are responses. Who
revisits whom is settled on digests and ids alone: the largest id of a digest is a sum combined before the shuffle, and a digest
that many pages share is joined to it from tables that Spark can split. Payloads travel once, by the rows' places, so a payload
that a third of all pages have weighs on no task; those of revisits stay behind, as their records do not hold them. A response's
HTTP message is framed in chunks; a message of more
than SEGMENT bytes is cut: a first response record with segment number 1, then continuation records that name the first one as
their origin, the last with the total length. Every record is a gzip member; an archive is a .warc.gz file of about ARCHIVE
bytes that starts with a warcinfo record. Archives are rows (name, content), written to the shared store by Spark, so no
executor's disk is needed; ``content`` is a valid file as it stands.

Reading: archives are taken apart record by record. Whole records are settled at once; segments travel by origin, are ordered by
number, checked for gaps and for the total length, then joined. Chunked framing is decoded, and the payload is held against
the record's digest; a broken record raises ValueError.

Null html is an empty payload, empty payloads are equal like any other. Repeated rows of the winning id are all responses, each under
a name of its own, and revisits refer to one of them; a null id is a page of its own kind and never wins over an id. Long payloads
are segments, put together one record at a time. Empty tables give empty results, extra columns are ignored.
"""

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared_store import written
from ..tables import table
from .arrowrows import bounded, kept
from .rowkeys import keyed

CHUNK, SEGMENT, ARCHIVE = 4096, 32 << 10, 4 << 20
_END = b"\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(payload[k : k + size]), payload[k : k + size]) for k in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        n = int(body[at:line].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        at = line + 2
        out.append(body[at : at + n])
        if len(out[-1]) != n or body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at += n + 2


def record(fields: dict[str, object], block: bytes) -> bytes:
    """One WARC record as a gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(1, wbits=31)
    return packer.compress(head.encode() + block + _END) + packer.flush()


def records(file: bytes):
    """(fields, block) of each record of a .warc.gz file."""
    at = 0
    while at < len(file):
        unpacker, out = zlib.decompressobj(wbits=31), []
        while not unpacker.eof:
            piece = file[at : at + (64 << 10)]
            if not piece:
                raise ValueError("an archive is cut short")
            out.append(unpacker.decompress(piece))
            at += len(piece) - len(unpacker.unused_data)
        raw = b"".join(out)
        head, _, rest = raw.partition(_END)
        lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        n = int(fields["Content-Length"])
        if not lines[0].startswith("WARC/") or rest[n:] != _END:
            raise ValueError("a record's length does not hold")
        yield fields, rest[:n]


def record_name(page_id, place: str) -> str:
    """The name of a page's record: its id and its row's place."""
    return f"<urn:page:{page_id}:{place}>"


def page_records(page_id, place: str, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: str | None = None):
    """The records of one page; a revisit of the record ``refers_to`` needs the payload's size and digest only."""
    # A line break in an address would end the field; it is written as a blank.
    target = " ".join((url or "about:blank").split()) or "about:blank"
    name = record_name(page_id, place)
    fields = {"WARC-Type": "response", "WARC-Record-ID": name, "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Target-URI": target, "WARC-Page-ID": page_id, "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http;msgtype=response"}
    if refers_to is not None:
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
        yield record(fields | {"WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": refers_to}, head.encode())
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= SEGMENT:
        yield record(fields, block)
        return
    yield record(fields | {"WARC-Segment-Number": 1}, block[:SEGMENT])
    for number, at in enumerate(range(SEGMENT, len(block), SEGMENT), 2):
        total = len(block) if at + SEGMENT >= len(block) else None
        yield record({"WARC-Type": "continuation", "WARC-Record-ID": f"{name[:-1]}:{number}>", "WARC-Date": fields["WARC-Date"], "WARC-Target-URI": target, "WARC-Segment-Origin-ID": name, "WARC-Segment-Number": number, "WARC-Segment-Total-Length": total}, block[at : at + SEGMENT])


def revisits(raw: DataFrame) -> DataFrame:
    """_file, _row of every row that revisits another, and the id and place of that one; from digests and ids alone."""
    marks = raw.select("_file", "_row", "id", F.sha1("payload").alias("digest"))
    marks = written(marks, "digests")
    winners = marks.groupBy("digest").agg(F.max(F.struct("id", "_file", "_row")).alias("w"), F.count(F.lit(1)).alias("n")).where("n > 1")
    winners = written(winners.select("digest", F.col("w.id").alias("to_id"), F.col("w._file").alias("to_file"), F.col("w._row").alias("to_row")), "winners")
    # A page with the winning id is a response too, and so are all of a payload that no page with an id has.
    return marks.join(winners, "digest").where("NOT id <=> to_id").drop("digest", "id")


def archives(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """name, content: .warc.gz files that hold every row of pages."""
    page = F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload")
    raw = keyed(pages.select(id_col, url_col, payload_col)).select(*page, "_file", "_row")
    later = revisits(raw)
    raw = raw.withColumn("size", F.octet_length("payload")).withColumn("digest", F.sha1("payload"))
    both = bounded(raw).join(later, ["_file", "_row"], "left")
    decided = both.select("id", "url", F.when(F.col("to_file").isNull(), F.col("payload")).alias("payload"), "size", "digest", "_file", "_row", "to_id", "to_file", "to_row")

    def write(batches):
        kept(None)
        part, files, held, size = TaskContext.get().partitionId(), 0, [], 0

        def file():
            info = record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:archive:{part}-{files}>", "WARC-Date": "1970-01-01T00:00:00Z", "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")
            return pa.RecordBatch.from_arrays([pa.array([f"pages-{part:06d}-{files:05d}.warc.gz"]), pa.array([info + b"".join(held)], pa.binary())], names=["name", "content"])

        place = lambda file, row: f"{file & (1 << 64) - 1:016x}.{row}"
        for b in batches:
            others = zip(*(b.column(k).to_pylist() for k in (0, 1, 3, 4, 5, 6, 7, 8, 9)))
            for payload, (page, url, n, digest, at_file, at_row, to_id, to_file, to_row) in zip(b.column(2), others):
                to = None if to_file is None else record_name(to_id, place(to_file, to_row))
                body = payload.as_buffer().to_pybytes() if payload.is_valid else None
                for r in page_records(page, place(at_file, at_row), url, body, n, base64.b32encode(bytes.fromhex(digest)).decode(), to):
                    held.append(r)
                    size += len(r)
                if size >= ARCHIVE:
                    yield file()
                    files, held, size = files + 1, [], 0
        if held:
            yield file()

    return decided.mapInArrow(write, "name string, content binary")


def _page(fields: dict[str, str], block: bytes) -> tuple:
    """page, payload_bytes, payload_digest, record_type, refers_to of a whole response or revisit."""
    head, _, body = block.partition(_END)
    http = dict(x.lower().split(": ", 1) for x in head.decode().split("\r\n")[1:])
    digest, page = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields.get("WARC-Page-ID")
    page = None if page is None else int(page)
    if fields["WARC-Type"] == "revisit":
        return page, int(http["content-length"]), digest, "revisit", int(fields["WARC-Refers-To"].removeprefix("<urn:page:").split(":")[0])
    payload = unchunked(body) if http.get("transfer-encoding") == "chunked" else body
    if payload_digest(payload) != digest:
        raise ValueError(f"the payload of page {page} does not have its digest")
    return page, len(payload), digest, "response", None


_PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_pages(files: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page in the archives."""

    def take_apart(batches):
        kept(None)
        for b in batches:
            for content in b.column(1):
                out = []
                for fields, block in records(content.as_buffer().to_pybytes()):
                    kind = fields["WARC-Type"]
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    origin = fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"])
                    if "WARC-Segment-Number" in fields:
                        total = fields.get("WARC-Segment-Total-Length")
                        about = None if kind == "continuation" else "\n".join(f"{k}: {v}" for k, v in fields.items())
                        out.append((origin, int(fields["WARC-Segment-Number"]), total and int(total), about, block, None, None, None, None, None))
                    else:
                        out.append((origin, 0, None, None, None, *_page(fields, block)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    names = ["origin", "number", "total", "about", "block", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    parts = bounded(files).select("name", "content").mapInArrow(take_apart, f"origin string, number long, total long, about string, block binary, {_PAGE}")
    ordered = parts.repartition("origin").sortWithinPartitions("origin", "number")

    def join(batches):
        now, about, blocks, total, out = None, None, [], None, []

        def settle():
            whole = b"".join(blocks)
            if about is None or total != len(whole):
                raise ValueError(f"segments of {now} are missing or do not have their total length")
            out.append(_page(dict(x.split(": ", 1) for x in about.split("\n")), whole))

        for b in batches:
            columns = [b.column(k).to_pylist() for k in range(len(names))]
            for origin, number, length, fields, block, *page in zip(*columns):
                if number == 0:
                    out.append(tuple(page))
                    continue
                if origin != now:
                    if now is not None:
                        settle()
                    now, about, blocks, total = origin, None, [], None
                if number != len(blocks) + 1:
                    raise ValueError(f"segment {len(blocks) + 1} of {origin} is missing")
                about, total = about or fields, length if length is not None else total
                blocks.append(block)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types[5:])], names=names[5:])
                out = []
        if now is not None:
            settle()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types[5:])], names=names[5:])

    return ordered.mapInArrow(join, _PAGE)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as the archives written of the pages table have it."""
    return read_pages(written(archives(table(spark, sf_dir, "pages"), "page_id", "url", "html"), "archives"))


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
 h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS x FROM p),
 w AS (SELECT x, max(page_id) AS winner FROM h GROUP BY x)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(generate_series(0, 31), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + CAST((CAST('0x' || substr(x, CAST(5 * (k // 4) + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = winner THEN NULL ELSE winner END AS refers_to
FROM h JOIN w USING (x)
"""
