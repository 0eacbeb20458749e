"""Legacy archive converter: ARC (versions 1 and 2) to WARC 1.0, with readers and writers for both.

An ARC file begins with a version block (`filedesc://`), whose version line says how the header
line of each record is laid out: five fields in version 1, ten in version 2. Each record is read by
its declared length, never by looking for the next header. For every record the converter
synthesises what WARC wants and ARC lacks: a record identifier (a name-based UUID of the file's name
below the converted folder, position and url), an ISO timestamp, a type, and block and payload digests. Of
records with equal payloads of `min_revisit` bytes or more, one stays a response and the others become
`revisit` records.

Files go through Spark's binary-file reader and text writer (record bytes as rows, the separator of
the format as line separator), so any store that Spark reaches will do. A file is one gzip stream, as
large as one input partition; it is read record by record, so memory is bounded by the largest
record and the compressed file. A first pass yields digests and no blocks; from them come, per file, the
positions of its revisits. A second pass meets that list (broadcast while its rows are at most
`max_broadcast`, else joined by file) and writes each file's records where they are read: blocks are
never shuffled. Hot digests are an aggregate with map-side combine, and their revisits a join that AQE splits.

Defined results: a null payload is an empty one; a null url becomes `urn:absent`; white space in
urls is percent-encoded; a null key is left out and read back as null; records that tie for the
largest key are all responses; repeated rows are a record each; payloads of any length are kept whole; broken
header lines are skipped up to the next one that parses; a truncated last record is kept as far as it
goes; an empty table gives files without records; columns other than key, url and payload have no
place in an archive and are not returned.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from grainmill.llm._common import delete_path, forget, fresh_path, map_arrow, written

#: Fixed values of the formats.
ARC_FIELDS = {
    1: ["url", "ip", "date", "content_type", "length"],
    2: ["url", "ip", "date", "content_type", "status", "checksum", "location", "offset", "filename", "length"],
}
ARC_TITLE = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
KEY_HEADER = "X-Record-Key"

RECORD_SCHEMA = "file string, position bigint, url string, date string, payload_bytes bigint, payload_sha1 string, key bigint"
WARC_SCHEMA = "record_id string, record_type string, url string, date string, refers_to string, payload_bytes bigint, payload_sha1 string, key bigint"
_BATCH = 8 << 20


def _clean_url(url: str | None) -> str:
    return re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) if url else "urn:absent"


def http_block(payload: bytes, key: int | None) -> bytes:
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (f"{KEY_HEADER}: {key}\r\n" if key is not None else "")
    return f"{head}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def arc_header(version: int, **values) -> bytes:
    return " ".join(str(values.get(f, "-")) for f in ARC_FIELDS[version]).encode() + b"\n"


def version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 grainmill\n{ARC_TITLE[version]}\n\n".encode()
    return arc_header(version, url=f"filedesc://{name}", ip="0.0.0.0", date=date, content_type="text/plain", status=200, length=len(body)) + body


def arc_record(version: int, url: str | None, payload: bytes, key: int | None, date: str) -> bytes:
    block = http_block(payload, key)
    return arc_header(version, url=_clean_url(url), ip="0.0.0.0", date=date, content_type="text/html", status=200, length=len(block)) + block


def _http_parts(block: bytes) -> tuple[dict[str, str], bytes]:
    """HTTP headers (lower-case names) and payload; a block without headers is all payload."""
    if not block.startswith(b"HTTP/"):
        return {}, block
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap:
        head, _, payload = block.partition(b"\n\n")
    lines = head.decode("latin-1").splitlines()[1:]
    return {a.strip().lower(): b.strip() for a, c, b in (x.partition(":") for x in lines) if c}, payload


def _key(headers: dict[str, str]) -> int | None:
    value = headers.get(KEY_HEADER.lower(), "")
    return int(value) if re.fullmatch(r"-?\d+", value) else None


def _opened(content: bytes) -> io.BufferedIOBase:
    return gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def read_arc(content: bytes) -> Iterator[dict]:
    """The records of an ARC file after its version block: the fields of their headers, and `block`."""
    f = _opened(content)
    version = 1
    while line := f.readline():
        line = line.rstrip(b"\r\n")
        if not line:
            continue
        names = ARC_FIELDS[version]
        if line.startswith(b"filedesc://"):
            fields = line.split(b" ")
            if not fields[-1].isdigit():
                continue
            body = f.read(int(fields[-1]))
            said = body.split(b" ", 1)[0]
            version = int(said) if said in (b"1", b"2") else (2 if len(fields) == 10 else 1)
            continue
        fields = line.decode("utf-8", "replace").rsplit(" ", len(names) - 1)
        if len(fields) != len(names) or not fields[-1].isdigit():
            continue
        yield dict(zip(names, fields, strict=True)) | {"block": f.read(int(fields[-1]))}


def warc_record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """Without the two line ends behind it, which the writer puts between records."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block


def iso_date(date: str) -> str:
    """An ISO timestamp from the 14 digits of an ARC date; missing digits take their least value."""
    d = re.sub(r"\D", "", date)[:14]
    d += "00000101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, parts)))}>"


def sha1_label(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def read_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record."""
    f = _opened(content)
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            continue
        headers = {}
        while (line := f.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, f.read(int(headers.get("content-length", 0)))


def _batched(rows: Iterator[tuple], schema: pa.Schema, weight=lambda r: 256) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def made():
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(schema.types)], schema=schema)

    for r in rows:
        held.append(r)
        size += weight(r)
        if size >= _BATCH:
            yield made()
            held, size = [], 0
    yield made()


_LINE = pa.schema([("value", pa.binary())])


def _save(records: DataFrame, path: str, separator: str) -> None:
    records.select(F.col("value").cast("string")).write.option("lineSep", separator).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def write_arc(pages: DataFrame, path: str, url: str = "url", payload: str = "html", key: str = "page_id", version: int = 1, date: str = "20240101000000") -> None:
    """One ARC file per partition of pages: a record per row."""

    def run(batches):
        def lines():
            yield (version_block(version, "pages.arc", date),)
            for b in batches:
                for u, p, k in zip(*(b.column(i) for i in range(3)), strict=True):
                    yield (arc_record(version, u.as_py(), (p.as_py() or "").encode("utf-8"), k.as_py(), date),)

        yield from _batched(lines(), _LINE, lambda r: len(r[0]))

    rows = pages.select(F.col(f"`{url}`").cast("string"), F.col(f"`{payload}`").cast("string"), F.col(f"`{key}`").cast("bigint"))
    _save(map_arrow(rows, run, "value binary"), path, "\n")


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, content) of the files below path; name is what follows it, or the last part of a single file's path."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    full = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.when(F.col("path").startswith(full), F.substring("path", len(full) + 1, 1 << 20)).otherwise(F.substring_index("path", "/", -1))
    return files.select("path", name.alias("name"), "content")


def arc_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all ARC files below path, with the size and SHA-1 of their payloads; `file` is the name below path."""
    schema = pa.schema([("file", pa.string()), ("position", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha1", pa.string()), ("key", pa.int64())])

    def run(batches):
        def rows():
            for b in batches:
                for name, content in zip(b.column(0), b.column(1), strict=True):
                    for n, r in enumerate(read_arc(content.as_py())):
                        headers, payload = _http_parts(r["block"])
                        yield name.as_py(), n, r["url"], r["date"], len(payload), hashlib.sha1(payload).hexdigest(), _key(headers)

        yield from _batched(rows(), schema)

    return map_arrow(_files(spark, path).select("name", "content"), run, RECORD_SCHEMA)


def revisits(records: DataFrame, min_revisit: int) -> DataFrame:
    """(file, position, kept): the records whose payload another one with a larger key has too, and that one (file, position, url, date)."""
    large = records.where(F.col("payload_bytes") >= min_revisit)
    best = F.max(F.struct("key", "file", "position", "url", "date")).alias("kept")
    kept = large.groupBy("payload_sha1", "payload_bytes").agg(F.count("*").alias("n"), best).where("n > 1").drop("n")
    same = large.select("payload_sha1", "payload_bytes", "file", "position", "key").join(kept, ["payload_sha1", "payload_bytes"])
    return same.where("not (key <=> kept.key)").select("file", "position", F.col("kept").dropFields("key").alias("kept"))


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_revisit: int = 1000, max_broadcast: int = 100_000) -> None:
    """Writes the records below arc_path as gzipped WARC files below warc_path, in the order of each file."""
    narrow = written(arc_records(spark, arc_path), "arc-records")
    again = written(revisits(narrow, min_revisit), "arc-revisits")
    few = again.count() <= max_broadcast
    lists = again.groupBy(F.col("file").alias("name")).agg(F.collect_list(F.struct("position", "kept")).alias("again"))
    met = _files(spark, arc_path).select("name", "content").join(F.broadcast(lists) if few else lists.hint("shuffle_hash"), "name", "left")

    def run(batches):
        def lines():
            info = b"software: grainmill\r\nformat: WARC File Format 1.0\r\n"
            head = [("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'grainmill')}>"), ("Content-Type", "application/warc-fields")]
            yield (warc_record("warcinfo", head, info),)
            for b in batches:
                for name, content, again in zip(*(b.column(i) for i in range(3)), strict=True):
                    kept = {x["position"]: x["kept"] for x in again.as_py() or ()}
                    for n, r in enumerate(read_arc(content.as_py())):
                        yield (_as_warc(r, name.as_py(), n, kept.get(n)),)

        yield from _batched(lines(), _LINE, lambda r: len(r[0]))

    _save(map_arrow(met.select("name", "content", "again"), run, "value binary"), warc_path, "\r\n\r\n")
    forget(narrow)
    forget(again)


def _as_warc(r: dict, file: str, position: int, kept: dict | None) -> bytes:
    """The record of an ARC file as a WARC record; a revisit of kept, if that is given."""
    block = r["block"]
    payload = _http_parts(block)[1]
    is_http = block.startswith(b"HTTP/")
    headers = [("WARC-Target-URI", r["url"]), ("WARC-Date", iso_date(r["date"])), ("WARC-Record-ID", record_id(file, position, r["url"])), ("WARC-IP-Address", r["ip"]), ("WARC-Payload-Digest", sha1_label(hashlib.sha1(payload).hexdigest()))]
    if kept:
        block = block[: len(block) - len(payload)]
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(kept["file"], kept["position"], kept["url"])), ("WARC-Refers-To-Target-URI", kept["url"]), ("WARC-Refers-To-Date", iso_date(kept["date"]))]
    headers += [("WARC-Block-Digest", sha1_label(hashlib.sha1(block).hexdigest())), ("Content-Type", "application/http; msgtype=response" if is_http else r["content_type"])]
    return warc_record("revisit" if kept else "response" if is_http else "resource", headers, block)


def warc_records(spark: SparkSession, path: str) -> DataFrame:
    """The response, resource and revisit records of all WARC files below path; of a payload that is present, size and SHA-1 are measured anew."""
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("date", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha1", pa.string()), ("key", pa.int64())])

    def run(batches):
        def rows():
            for b in batches:
                for content in b.column(0):
                    for h, block in read_warc(content.as_py()):
                        kind = h.get("warc-type")
                        if kind not in ("response", "resource", "revisit"):
                            continue
                        http, payload = _http_parts(block)
                        if kind == "revisit":
                            size = int(http.get("content-length", 0))
                            digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                        else:
                            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        yield h["warc-record-id"], kind, h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-refers-to"), size, digest, _key(http)

        yield from _batched(rows(), schema)

    return map_arrow(_files(spark, path).select("content"), run, WARC_SCHEMA)


def round_trip(pages: DataFrame, url: str = "url", payload: str = "html", key: str = "page_id", min_revisit: int = 1000) -> DataFrame:
    """pages as ARC files, converted to WARC and read back: the columns of `warc_records`, and `refers_to_key`."""
    spark = pages.sparkSession
    arc, warc = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    write_arc(pages, arc, url, payload, key)
    convert(spark, arc, warc, min_revisit)
    delete_path(spark, arc)
    back = written(warc_records(spark, warc), "warc-records")
    delete_path(spark, warc)
    target = back.where("record_type != 'revisit'").select(F.col("record_id").alias("target"), F.col("key").alias("refers_to_key"))
    target = target.join(back.where("record_type = 'revisit'").select(F.col("refers_to").alias("target")).distinct(), "target", "left_semi")
    return back.join(target, F.col("refers_to") == F.col("target"), "left").drop("target")
