"""WARC archives: one gzip stream per file, then one member per record.

Pages are first written as ordinary whole-file gzip streams, one file per
task.  The normaliser inflates each stream once, a block at a time, cuts it at
record bounds, rewrites every record as its own gzip member and puts an offset
index beside the file; any record can then be read by one seek.
"""

from __future__ import annotations

import hashlib
import json
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, open_input, put_file, table

BLOCK = 1 << 18
GZIP = 31  # zlib's window bits for a gzip member
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "urn:page:"


def _gzip(level: int):
    return zlib.compressobj(level, zlib.DEFLATED, GZIP)


def _header_text(value: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str,
                 refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit record (no body) where ``refers_to`` is set."""
    name = "" if page_id is None else page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    body = http.encode() + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: <{RECORD}{name}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_text(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{RECORD}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


def _headers(block: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in block.decode().split("\r\n")[1:] if ": " in line)


def inflate_records(stream):
    """Records of a gzip stream of any number of members, one at a time; only
    one record and one block are held."""
    inflate, have = zlib.decompressobj(GZIP), bytearray()
    at, need = 0, None
    while True:
        while True:  # records that are whole in ``have``
            if need is None and (end := have.find(b"\r\n\r\n", at)) >= 0:
                need = end + 4 + int(_headers(bytes(have[:end]))["Content-Length"]) + 4
            if need is None or len(have) < need:
                at = max(0, len(have) - 3) if need is None else at
                break
            yield bytes(have[:need])
            del have[:need]
            at, need = 0, None
        block = stream.read(BLOCK)
        if not block:
            if have or not inflate.eof:
                raise ValueError("the archive ends inside a record or a gzip member")
            return
        while block:
            if inflate.eof:
                inflate = zlib.decompressobj(GZIP)
            have += inflate.decompress(block)
            block = inflate.unused_data


def normalise(source: str, target: str, level: int = 6) -> int:
    """Rewrite one archive with a gzip member per record; the index
    (``target`` + ``.idx``: JSON lines of record id, offset, length) comes
    last.  Returns the number of records."""
    index, offset = [], 0

    def members():
        nonlocal offset
        with open_input(source) as f:
            for record in inflate_records(f):
                press = _gzip(level)
                member = press.compress(record) + press.flush()
                name = _headers(record[:record.index(b"\r\n\r\n")])["WARC-Record-ID"]
                index.append(json.dumps([name, offset, len(member)]))
                offset += len(member)
                yield member

    put_file(target, members())
    put_file(target + ".idx", ["\n".join(index).encode()])
    return len(index)


def read_member(file, offset: int, length: int) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of the record at ``offset``."""
    file.seek(offset)
    record = zlib.decompress(file.read(length), GZIP)
    head, rest = record.split(b"\r\n\r\n", 1)
    warc = _headers(head)
    http, payload = rest[:int(warc["Content-Length"])].split(b"\r\n\r\n", 1)
    return warc, _headers(http), payload


def _page(uri: str | None) -> int | None:
    name = (uri or "").strip("<>").removeprefix(RECORD)
    return int(name) if name else None


def with_revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """page_id, url, html, digest and refers_to: of equal payloads of at least
    ``least_bytes``, the largest page_id answers and the others refer to it.
    The winners are one row per repeated payload; pages meet them by digest,
    where a hot payload's partition may be split freely."""
    pages = pages.withColumn("html", F.coalesce("html", F.lit(""))) \
        .withColumn("digest", F.sha1(F.encode("html", "utf-8")))
    winner = pages.where(F.octet_length("html") >= least_bytes).groupBy("digest") \
        .agg(F.max("page_id").alias("winner"), F.count("*").alias("copies")) \
        .where("copies > 1").select(F.col("digest").alias("same"), "winner")
    return pages.join(winner, F.col("digest") == F.col("same"), "left") \
        .select("page_id", "url", "html", "digest",
                F.when(~F.col("page_id").eqNullSafe(F.col("winner")), F.col("winner")).alias("refers_to"))


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write every page as a WARC record (whole-stream gzip), normalise the
    archives, and return the manifest: uri and number of records.

    Null html is an empty payload, a null url leaves its header out, a null
    page id an empty record name; repeated ids are records of their own; an
    empty table gives no archives with records.  Other columns are not read.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    folder, whole = scratch.path("archives"), scratch.path("streams")
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                         F.col(html_col).alias("html"))

    def write(batches):
        count = 0

        def stream():
            nonlocal count
            press = _gzip(1)
            for batch in batches:
                for row in zip(*(batch.column(i) for i in range(5))):
                    page_id, url, html, digest, refers_to = (v.as_py() for v in row)
                    count += 1
                    yield press.compress(record_bytes(page_id, url, html.encode(), digest, refers_to, date))
            yield press.flush()

        uri = f"{whole}/{TaskContext.get().partitionId():07d}.warc.gz"
        put_file(uri, stream())
        yield pa.RecordBatch.from_pydict({"uri": [uri], "n": pa.array([count], pa.int64())})

    streams = scratch.write(with_revisits(pages).mapInArrow(write, "uri string, n long"), "streams-manifest")

    def rewrite(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                target = f"{folder}/{uri.rsplit('/', 1)[1]}"
                n = normalise(uri, target)
                yield pa.RecordBatch.from_pydict({"uri": [target], "n": pa.array([n], pa.int64())})

    streams = streams.where("n > 0").select("uri")
    return scratch.write(_one_each(streams).mapInArrow(rewrite, "uri string, n long"), "manifest")


def _one_each(files: DataFrame) -> DataFrame:
    return files.repartition(max(1, files.count()), "uri")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record, read through the offset index: page_id, payload_bytes,
    payload_digest, record_type, refers_to, url and payload (null for revisits).
    Digest and length of a response are taken from its payload."""
    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with open_input(uri + ".idx") as f:
                    index = [json.loads(line) for line in f.read().decode().split("\n")]
                with open_input(uri) as f:
                    for i in range(0, len(index), 100):
                        yield _rows([read_member(f, at, n) for _, at, n in index[i:i + 100]])

    return _one_each(manifest.select("uri")).mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
             "url string, payload binary")


def _rows(records) -> pa.RecordBatch:
    out = []
    for warc, http, payload in records:
        full = warc["WARC-Type"] == "response"
        out.append((_page(warc["WARC-Record-ID"]), len(payload) if full else int(http["Content-Length"]),
                    hashlib.sha1(payload).hexdigest() if full else warc["WARC-Payload-Digest"].removeprefix("sha1:"),
                    warc["WARC-Type"], _page(warc.get("WARC-Refers-To")), warc.get("WARC-Target-URI"),
                    payload if full else None))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def op3_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every row of pages, written, normalised and read back."""
    return read_archives(archive(table(spark, sf_dir, "pages"))) \
        .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS digest, strlen(coalesce(html, ''))::BIGINT AS bytes FROM pages
), w AS (
  SELECT digest, max(page_id) AS winner FROM p WHERE bytes >= 1000 GROUP BY digest HAVING count(*) > 1
)
SELECT p.page_id, p.bytes AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN w.winner IS NULL OR w.winner = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN w.winner <> p.page_id THEN w.winner END AS refers_to
FROM p LEFT JOIN w USING (digest)
"""
