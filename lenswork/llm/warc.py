"""WARC archives: writing, normalising monolithic gzip, reading by index.

Each task writes its pages as one archive of a single gzip stream. The normaliser inflates such a
file once, piece by piece, writes every record as a gzip member of its own and, beside it, an index
(an Arrow file: record id, type, offset and length of the member). Reading seeks by that index.
Spark's shuffles carry a page at most once; which page of equal payloads is the response is
decided on digests, with the maximum formed before the shuffle; only digests that come again are joined back,
and very common ones (an empty payload, say) are dealt over many tasks.

Rows: a null html is an empty payload; pages with equal ids and payloads are all responses (or all
revisits of the same page); a null page_id is smaller than any other; a null url is an empty target. An empty table
gives no archives and no rows. A payload of any length is one record. Only page_id, url and html are read; other
columns, whatever their names, don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, fresh_path, load, shuffle_partitions, stored

#: Payloads smaller than this are never revisits.
LEAST_BYTES, CHUNK, GZIP = 0, 1 << 18, 31
#: A digest is common if it has this share of all pages (so there are at most as many) and so many pages.
SHARE, COMMON, SALTS = 1000, 1000, 64
#: Fixed value: the profile of revisits by payload digest (WARC 1.1).
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # the table has no crawl time


def record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    target = "".join(c if c.isprintable() and c != " " else "".join(f"%{x:02X}" for x in c.encode("utf-8", "surrogatepass")) for c in url or "")
    headers = {"WARC-Record-ID": f"<urn:x-page:{page_id}>", "WARC-Date": DATE, "WARC-Target-URI": target, "WARC-Payload-Digest": f"sha1:{digest}", "X-Payload-Bytes": str(size), "Content-Type": "application/http;msgtype=response"}
    if revisit:
        headers |= {"WARC-Refers-To": f"<urn:x-page:{refers_to}>", "WARC-Profile": PROFILE}
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    return record("revisit" if revisit else "response", headers, http + (b"" if revisit else payload))


def roles(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Rows (page_id, digest, refers_to): refers_to is null for responses. Only ids and digests are shuffled."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    small = pages.select("page_id", F.unhex(F.sha1(payload)).alias("digest"), (F.octet_length(payload) >= least_bytes).alias("counts")).distinct()
    top = stored(small.filter("counts").groupBy("digest").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeated-payloads")
    most = max(COMMON, (top.agg(F.sum("n")).first()[0] or 0) // SHARE)
    common = F.broadcast(top.filter(F.col("n") >= most).select("digest", F.lit(True).alias("common")))
    salt = F.when(F.col("common"), F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.when(F.col("n") >= most, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    joined = small.join(common, "digest", "left").withColumn("salt", salt).join(top.select("digest", "top", F.explode(salts).alias("salt")), ["digest", "salt"], "left")
    return joined.select("page_id", "digest", F.when(F.col("counts") & (F.col("top") > F.col("page_id")), F.col("top")).when(F.col("counts") & F.col("page_id").isNull(), F.col("top")).alias("refers_to"))


def write_archives(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write pages (page_id, url, html); the manifest (path) of the monolithic archives, in the shared folder."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "archives")
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("html"), F.unhex(F.sha1(payload.cast("binary"))).alias("sha"))
    of = roles(pages, least_bytes).withColumnRenamed("page_id", "p")
    key = F.coalesce(rows.page_id, F.lit(-1)) == F.coalesce(of.p, F.lit(-1))
    rows = rows.join(of, key & rows.page_id.eqNullSafe(of.p) & (rows.sha == of.digest)).select("page_id", "url", "html", "refers_to")

    def write(batches):
        fs, root = filesystem(folder)
        out = squeeze = None
        name = f"pages-{uuid.uuid4().hex}.warc.gz"
        for b in batches:
            for page, url, html, refers in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out, squeeze = fs.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(6, zlib.DEFLATED, GZIP)
                    out.write(squeeze.compress(record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": DATE, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")))
                payload = html.encode()
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                out.write(squeeze.compress(page_record(page, url, payload, digest, len(payload), refers, refers is not None)))
        if out is not None:
            out.write(squeeze.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"path": pa.array([f"{folder}/{name}"])})

    return stored(rows.mapInArrow(write, "path string"), "archive-manifest")


def records_of(stream):
    """The records of an inflated WARC stream, given as pieces of bytes; holds one record at a time."""
    held = bytearray()
    for piece in stream:
        held += piece
        while (head := held.find(b"\r\n\r\n")) >= 0:
            length = next(int(line.split(b":", 1)[1]) for line in bytes(held[:head]).split(b"\r\n") if line.lower().startswith(b"content-length:"))
            end = head + 4 + length + 4
            if len(held) < end:
                break
            yield bytes(held[:end])
            del held[:end]
    if held.strip():
        raise ValueError("the archive ends within a record")


def inflated(stream):
    """Pieces of a gzip file of one or many members."""
    one = zlib.decompressobj(GZIP)
    while data := stream.read(CHUNK):
        while data:
            yield one.decompress(data)
            data = one.unused_data
            if one.eof:
                one = zlib.decompressobj(GZIP)
            elif not data:
                break


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = (line.split(":", 1) for line in head.decode().split("\r\n")[1:])
    headers = {k.lower(): v.strip() for k, v in fields}
    return headers, block[: int(headers["content-length"])]


def normalise(manifest: DataFrame) -> DataFrame:
    """Rewrite each archive (path) with a member for every record and its index; the manifest of the new ones."""
    spark = manifest.sparkSession
    folder = fresh_path(spark, "normalised")

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, source = filesystem(path)
                _, root = filesystem(folder)
                fs.create_dir(root, recursive=True)
                name = f"{source.rsplit('/', 1)[1].removesuffix('.warc.gz')}-{uuid.uuid4().hex}.warc.gz"
                ids, kinds, offsets, lengths, at = [], [], [], [], 0
                with fs.open_input_stream(source, compression=None) as stream, fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                    for raw in records_of(inflated(stream)):
                        headers = parse(raw)[0]
                        squeeze = zlib.compressobj(6, zlib.DEFLATED, GZIP)
                        member = squeeze.compress(raw) + squeeze.flush()
                        out.write(member)
                        ids.append(headers["warc-record-id"])
                        kinds.append(headers["warc-type"])
                        offsets.append(at)
                        lengths.append(len(member))
                        at += len(member)
                index = pa.table({"record_id": ids, "type": kinds, "offset": pa.array(offsets, pa.int64()), "length": pa.array(lengths, pa.int64())})
                with fs.open_output_stream(f"{root}/{name}.idx", compression=None) as out, pa.ipc.new_file(out, index.schema) as sink:
                    sink.write_table(index)
                yield pa.RecordBatch.from_pydict({"path": pa.array([f"{folder}/{name}"])})

    dealt = manifest.repartition(shuffle_partitions(spark))
    return stored(dealt.mapInArrow(run, "path string"), "normalised-manifest")


def _page(urn: str | None) -> int | None:
    value = urn.removeprefix("<urn:x-page:").removesuffix(">") if urn else "None"
    return None if value == "None" else int(value)


def read_archives(manifest: DataFrame) -> DataFrame:
    """Rows (page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of the page records, each found by the index."""

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, p = filesystem(path)
                with fs.open_input_file(p + ".idx") as f:
                    index = pa.ipc.open_file(f).read_all()
                rows: list[tuple] = []
                held = 0
                with fs.open_input_file(p) as f:
                    for kind, offset, length in zip(*(index.column(c).to_pylist() for c in ("type", "offset", "length"))):
                        if kind not in ("response", "revisit"):
                            continue
                        f.seek(offset)
                        headers, block = parse(zlib.decompress(f.read(length), GZIP))
                        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        digest = headers["warc-payload-digest"].removeprefix("sha1:")
                        if payload is not None and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"{path}: the payload at {offset} doesn't have its digest")
                        size = int(headers["x-payload-bytes"]) if payload is None else len(payload)
                        rows.append((_page(headers["warc-record-id"]), headers["warc-target-uri"], size, digest, kind, _page(headers.get("warc-refers-to")), payload))
                        held += len(payload or b"")
                        if held > 8_000_000:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return manifest.repartition(shuffle_partitions(manifest.sparkSession)).mapInArrow(run, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = normalise(write_archives(load(spark, sf_dir, "pages")))
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
