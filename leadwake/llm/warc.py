"""Operator 7: WARC archives compressed with Zstandard and a dictionary, one frame per record.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself plain or compressed; then
each record is a frame of its own.  The writer's tasks roll archives of bounded size into the shared folder; the reader
takes the dictionary from the first frame, finds every frame's end from its block headers, decodes one frame per record
and checks version, headers, lengths and digests.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from leadwake.llm.common import load, map_arrow
from leadwake.session import materialize, shared_folder

SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
#: Bytes of records per archive; a larger record has an archive of its own.
ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES, TRAINING_RECORDS, TRAINING_BYTES = 16 << 10, 128, 8 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: One date for all records, so that reruns write equal archives.
DATE = "2000-01-01T00:00:00Z"


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record; ``digest`` is the base32 SHA-1 of the payload, which a revisit names but doesn't carry."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {target}",
            f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).hexdigest())}"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """The bytes of an archive; without a dictionary where the records are too few to train one."""
    samples = [r[:TRAINING_BYTES] for r in records[:TRAINING_RECORDS]]
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples) if len(samples) >= 16 else None
    except zstandard.ZstdError:
        trained = None
    parts = []
    if trained is not None:
        kept = zstandard.ZstdCompressor(write_content_size=True).compress(trained.as_bytes())
        parts.append(struct.pack("<II", SKIPPABLE, len(kept)) + kept)
    pack = zstandard.ZstdCompressor(dict_data=trained, write_content_size=True, write_checksum=True)
    return b"".join([*parts, *map(pack.compress, records)])


def frame_end(data: bytes, start: int) -> int:
    """Where the frame that begins at ``start`` ends, from its header and block headers."""
    at = start + zstandard.frame_header_size(data[start:start + 18])
    checksum = zstandard.get_frame_parameters(data[start:start + 18]).has_checksum
    while True:
        if at + 3 > len(data):
            raise ValueError("frame is cut off")
        head = int.from_bytes(data[at:at + 3], "little")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            break
    at += 4 * checksum
    if at > len(data):
        raise ValueError("frame is cut off")
    return at


def frames(data: bytes):
    """The decoded frames of an archive, or an exception in place of one that can't be decoded; it ends where no frame begins."""
    at, dictionary = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        length = struct.unpack_from("<I", data, 4)[0]
        kept, at = data[8:8 + length], 8 + length
        if kept[:4] == struct.pack("<I", FRAME):
            kept = zstandard.ZstdDecompressor().decompress(kept)
        dictionary = zstandard.ZstdCompressionDict(kept)
    unpack = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        try:
            end = frame_end(data, at)
        except (ValueError, zstandard.ZstdError) as e:
            yield ValueError(f"no frame at byte {at}: {e}")
            return
        try:
            yield unpack.decompress(data[at:end])
        except zstandard.ZstdError as e:
            yield ValueError(f"frame at byte {at}: {e}")
        at = end


def _fields(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.decode("utf-8").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"bad header line {line[:60]!r}")
        out[name.lower()] = value.strip()
    return out


def _page(urn: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+|None)>", urn)
    if not m:
        raise ValueError(f"bad record id {urn[:60]!r}")
    return None if m[1] == "None" else int(m[1])


def parse(data: bytes) -> dict:
    """Check one record and take it apart; ValueError says what is wrong."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not gap or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no WARC version or no end of the header")
    fields = _fields(lines)
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - set(fields):
        raise ValueError(f"missing {sorted(missing)}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("Content-Length differs from the block")
    block, kind = rest[:-4], fields["warc-type"]
    if kind not in ("response", "revisit"):
        raise ValueError(f"unexpected type {kind[:20]!r}")
    if "warc-block-digest" in fields and fields["warc-block-digest"] != "sha1:" + base32(hashlib.sha1(block).hexdigest()):
        raise ValueError("block digest differs")
    http, gap, payload = block.partition(b"\r\n\r\n")
    length = _fields(http.partition(b"\r\n")[2]).get("content-length", "") if gap and http.startswith(b"HTTP/") else ""
    digest = fields.get("warc-payload-digest", "")
    if not length.isdigit() or not digest.startswith("sha1:"):
        raise ValueError("no payload length or digest")
    if kind == "response" and (len(payload) != int(length) or digest[5:] != base32(hashlib.sha1(payload).hexdigest())):
        raise ValueError("payload differs from its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise ValueError("revisit with a payload or without its response")
    return {"page_id": _page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": kind, "payload_bytes": int(length),
            "payload_digest": digest[5:], "refers_to": _page(fields["warc-refers-to"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None}


def with_roles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """page_id, url, payload, sha1, refers_to (null for a response).

    Pages of equal payload are found by digest with a map-side combined minimum; only digests that occur more than once
    come back to the pages.
    """
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                     F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("sha1", F.sha1("payload"))
    first = (p.filter(F.octet_length("payload") >= least).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
             .filter("n > 1").select("sha1", "first"))
    return p.join(first, "sha1", "left").withColumn("refers_to", F.when((F.col("page_id") != F.col("first")) | F.col("page_id").isNull(), F.col("first"))).drop("first")


def write(pages: DataFrame, folder: str, **columns) -> DataFrame:
    """Write one record per page into archives in ``folder``, a path that all executors share; returns (name, records, bytes).

    A null html is an empty payload, a null url a target made of the id.  Of repeated pages with one id each is written; a
    page with a null id refers to the smallest id of its payload, if there is one.  A task that runs again writes under new
    names, and only names in the returned list count.
    """

    def run(batches):
        from pyarrow import fs

        uri = folder if re.match(r"[a-z0-9]+://?", folder) else f"file://{folder}"
        store, root = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
        store.create_dir(root, recursive=True)

        def close(records):
            data, name = archive(records), f"{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(data)
            return pa.RecordBatch.from_pydict({"name": [name], "records": pa.array([len(records)], pa.int64()), "bytes": pa.array([len(data)], pa.int64())})

        held, size = [], 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                page_id, url, payload, sha1, refers_to = row
                held.append(record(page_id, url, payload, base32(sha1), refers_to))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield close(held)
                    held, size = [], 0
        if held:
            yield close(held)

    rows = with_roles(pages, **columns).select("page_id", "url", "payload", "sha1", "refers_to")
    return materialize(map_arrow(rows, run, "name string, records long, bytes long"))


SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, error string"


def read(spark: SparkSession, folder: str, names: DataFrame | None = None, payloads: bool = True) -> DataFrame:
    """Every record of the archives in ``folder`` (those in ``names``, if given); what is wrong with a bad one is in ``error``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    if names is not None:
        files = files.join(names.select("name"), "name", "left_semi")
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches):
        types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
        for b in batches:
            for data in b.column(0):
                rows = []
                for frame in frames(data.as_py()):
                    try:
                        rows.append(parse(frame) if isinstance(frame, bytes) else {"error": str(frame)})
                    except ValueError as e:
                        rows.append({"error": str(e)})
                    if not payloads:
                        rows[-1].pop("payload", None)
                yield pa.RecordBatch.from_pydict({c: pa.array([r.get(c) for r in rows], types.get(c, pa.string())) for c in columns})

    return map_arrow(files.select("content"), run, SCHEMA)


def op7(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    names = write(load(spark, sf_dir, "pages"), folder)
    if names.isEmpty():
        return spark.createDataFrame([], SCHEMA).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")
    return read(spark, folder, names, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first, sha1(html) || '00' AS h FROM p GROUP BY html)
SELECT page_id, strlen(p.html)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + (('0x' || substr(h, 1 + (5 * k) // 4, 3))::INT >> (7 - (5 * k) % 4)) % 32]), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, NULL::VARCHAR AS error
FROM p JOIN f ON p.html = f.html
"""
