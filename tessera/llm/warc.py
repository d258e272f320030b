"""WARC archives of individually compressed records with an embedded Zstandard dictionary.

Each archive starts with a skippable frame (magic 0x184D2A5D) that holds a dictionary built from records of
that very archive; each record is a frame of its own. Equal payloads are found by their digests alone, and pages are
dealt by page and not by payload, so a payload that very many pages have is no large group. Archives go to a
shared folder under names that hold the attempt, so no attempt touches another's file; a manifest beside them, written
as a table and so by finished attempts only, says which archives count and are read.

Defined cases: null html is an empty payload; rows with a null page_id are archived too (never referred to);
rows that repeat a page_id and its payload are each a response; a null url leaves the header out; an empty
table gives no archive and an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh_dir, materialize, table

MAGIC, DICT_MAGIC = 0x184D2A5D, 0xEC30A437
#: Bytes of records before an archive ends, of records that a dictionary is built from, and of the dictionary.
ARCHIVE_BYTES, TRAIN_BYTES, DICT_BYTES = 48 << 20, 1 << 20, 32 << 10
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, first) -> bytes:
    """One WARC/1.1 record: a response, or a revisit of page `first`."""
    revisit = first is not None and first != page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{first}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on whole records drawn over the archive by their hashes, TRAIN_BYTES of them; a record of more than a quarter
    of that lends its first quarter. Plain content where they are too few to train on."""
    samples, held = [], 0
    for r in sorted(records, key=xxhash.xxh3_64_intdigest):
        samples.append(r[: TRAIN_BYTES // 4])
        held += len(samples[-1])
        if held >= TRAIN_BYTES:
            break
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict((b"".join(samples)[-DICT_BYTES:] or b"\r\n" * 4).ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def pack(records: list[bytes], level: int = 3) -> bytes:
    d = build_dictionary(records)
    raw = d.as_bytes()
    c = zstandard.ZstdCompressor(level=level, dict_data=d)
    return b"".join([struct.pack("<II", MAGIC, len(raw)), raw, *map(c.compress, records)])


def unpack(archive: bytes):
    """Yields (headers, block) of each record."""
    magic, n = struct.unpack_from("<II", archive)
    if magic != MAGIC:
        raise ValueError("the archive does not start with a dictionary frame")
    raw = archive[8 : 8 + n]
    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == struct.pack("<I", DICT_MAGIC) else zstandard.DICT_TYPE_RAWCONTENT
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
    with d.stream_reader(memoryview(archive)[8 + n :], read_across_frames=True) as stream:
        held = b""
        while True:
            while (at := held.find(b"\r\n\r\n")) < 0:
                more = stream.read(1 << 16)
                if not more:
                    if held:
                        raise ValueError("the archive ends within a record")
                    return
                held += more
            head = dict(line.split(": ", 1) for line in held[:at].decode("utf-8", "surrogateescape").split("\r\n")[1:])
            size = int(head["Content-Length"])
            parts, have = [held[at + 4 :]], len(held) - at - 4
            while have < size + 4:
                more = stream.read(max(1 << 16, size + 4 - have))
                if not more:
                    raise ValueError("the archive ends within a record")
                parts.append(more)
                have += len(more)
            held = b"".join(parts)
            yield head, held[:size]
            held = held[size + 4 :]


def with_first(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, first: the smallest page_id with an equal payload where several have it."""
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.cast("binary").alias("payload"), F.sha1(html).alias("_key"))
    light = keyed.where(F.length("payload") >= min_bytes).select("page_id", "_key")
    shared = light.groupBy("_key").agg(F.min("page_id").alias("first"), F.count("*").alias("_n")).where("_n > 1").select("_key", "first")
    # Both are written first: joined right away, rows and aggregate would share one exchange, which Spark could not split
    # where one payload is very common. Payloads are then dealt by page, not by payload.
    refs = materialize(light.join(materialize(shared, "warc-shared"), "_key").distinct(), "warc-first").withColumnsRenamed({"page_id": "_page", "_key": "_same"})
    found = keyed.join(refs, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("_key") == F.col("_same")), "left")
    return found.select("page_id", "url", "payload", "first")


_MANIFEST = "name string, records long, bytes long"


def write_archives(records: DataFrame, path: str) -> DataFrame:
    """Writes archives of with_first()'s rows to the folder; the manifest, a row for each archive: name, records, bytes."""

    def write(batches):
        fs, at = pyarrow.fs.FileSystem.from_uri(path)
        task = TaskContext.get()
        held, size, k = [], 0, 0

        def close():
            # The attempt is in the name: nothing is replaced or deleted, and what a lost attempt left is in no manifest.
            name = f"part-{task.partitionId():06d}-{k:05d}-{task.taskAttemptId()}.warc.zst"
            data = pack(held)
            fs.create_dir(at, recursive=True)
            with fs.open_output_stream(f"{at}/{name}", compression=None) as f:
                f.write(data)
            return pa.RecordBatch.from_pydict({"name": [name], "records": [len(held)], "bytes": [len(data)]})

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "first")), strict=True):
                held.append(record(*row))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    held, size, k = [], 0, k + 1
        if held:
            yield close()

    return materialize(records.mapInArrow(write, _MANIFEST), "warc-manifest")


def read_archives(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """A row for each record of the archives that the manifest names; a response's payload is held against its digest."""
    fields = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"

    def page(urn):
        digits = urn.removeprefix("<urn:x-page:").removesuffix(">") if urn else ""
        return int(digits) if digits else None

    def read(batches):
        for b in batches:
            for content in b.column("content"):
                out, size = {k.split()[0]: [] for k in fields.split(", ")}, 0
                for head, block in unpack(content.as_py()):
                    http, payload = block.split(b"\r\n\r\n", 1)
                    whole = int(http.rsplit(b"Content-Length: ", 1)[1])
                    told, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                    if kind == "response" and (len(payload) != whole or digest(payload) != told):
                        raise ValueError(f"{head['WARC-Record-ID']}: the payload does not match its digest")
                    row = (page(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), whole, told, kind, page(head.get("WARC-Refers-To")), payload if kind == "response" else None)
                    for k, v in zip(out, row, strict=True):
                        out[k].append(v)
                    size += len(block)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pydict(out, schema)
                        out, size = {k: [] for k in out}, 0
                yield pa.RecordBatch.from_pydict(out, schema)

    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in fields.split(", ")])
    at = path if "://" in path else f"file://{path}"
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    if not jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm):
        return spark.createDataFrame([], fields)  # an empty manifest: no task made the folder
    # The folder is listed by Spark, and archives that no finished attempt named go before their contents are read.
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(at)
    named = files.withColumn("name", F.regexp_extract("path", "[^/]+$", 0)).join(manifest.select("name"), "name", "left_semi")
    return named.select("content").mapInArrow(read, fields)


def op6_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "warc")
    made = write_archives(with_first(table(spark, sf_dir, "pages")), path)
    back = read_archives(spark, path, made)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_B32 = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {a}, {n}))::BIGINT >> {s}) & 31)::INT, 1)"


def _base32(h: str) -> str:
    """SQL for 40 hex digits as base32: four groups of ten digits, each of eight letters."""
    letters = [_B32.format(a=1 + 10 * g, n=10, s=35 - 5 * k) for g in range(4) for k in range(8)]
    return " || ".join(letters).replace("(h,", f"({h},")


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, h, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {_base32('h')} AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM f
"""
