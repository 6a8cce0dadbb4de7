"""WARC archives written from and read back into a chunked record table.

A record is a run of rows with one record identifier and rising chunk numbers, so no task ever holds
an oversized payload in a Python object of its own: writers compress chunk by chunk and readers inflate chunk by chunk, both
carrying the SHA-1 and the length of what went before, and both comparing them with what the record states at its last chunk.

Archives are gzip files with a member for each record, in the shared folder. Each task attempt writes a file
of its own under a temporary name and renames it when it is whole; only files in the manifest count,
so lost and repeated attempts leave no trace in the results.

Defined results: a null html is an empty payload; a null url gives no target URI; of equal payloads of at
least min_bytes, all rows with the smallest page_id are responses (repeated rows share it) and the
others revisits; rows without a page_id never are that response if another has an id, and revisit it; repeated rows make a record
each, with the same record identifier; payloads of any length are taken whole; columns of the input other than page_id, url and html are
not read, whatever their names; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kinlink.llm.workdir import bound_batches, fresh_folder, materialize

CHUNK_BYTES = 256 << 10
CHUNKS = (
    "archive string, record long, chunk long, is_last boolean, record_type string, page_id long, target_uri string, "
    "refers_to long, data binary, bytes_so_far long, digest_so_far string, payload_bytes long, payload_digest string"
)


def base32_digest(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode("ascii")


def classify(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, n_bytes, sha1, refers_to (null for responses) of each row."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.encode(F.lit(""), "UTF-8")).alias("payload"),
    )
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("n_bytes"), F.sha1("payload").alias("sha1"))
    first = materialize(
        rows.where(F.col("n_bytes") >= min_bytes).groupBy("sha1", "n_bytes").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1"),
        "payloads",
    )
    joined = rows.join(first.drop("copies"), ["sha1", "n_bytes"], "left")
    other = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "payload", "n_bytes", "sha1", F.when(other, F.col("first_id")).alias("refers_to"))


def chunk_table(rows: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row for each chunk of each record, in order within a partition; revisits have one empty chunk."""
    body = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.encode(F.lit(""), "UTF-8"))
    rows = rows.withColumn("payload", body).withColumn("last", F.greatest(F.ceil(F.octet_length("payload") / chunk_bytes) - 1, F.lit(0)))
    rows = rows.select("*", F.monotonically_increasing_id().alias("record"), F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("chunk"))
    data = F.col("payload").substr((F.col("chunk") * chunk_bytes + 1).cast("int"), F.lit(chunk_bytes))
    return rows.select("record", "chunk", "last", "page_id", "url", "n_bytes", "sha1", "refers_to", data.alias("data"))


def _one_line(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8")) for c in value)


def record_head(page_id: int | None, url: str | None, n_bytes: int, sha1: str, refers_to: int | None, date: str = "") -> bytes:
    """The WARC header and the HTTP header that precede a payload. date: when the record is written; empty for now."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    revisit = refers_to is not None
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    lines += [f"WARC-Date: {date or datetime.now(UTC).strftime('%Y-%m-%dT%H:%M:%SZ')}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_one_line(url)}")
    if revisit:
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines.append(f"WARC-Payload-Digest: sha1:{base32_digest(sha1)}")
    lines.append(f"Content-Length: {len(http) + (0 if revisit else n_bytes)}")
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + http


def _writer(folder: str):
    def run(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        name = f"{base}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, packer, records = None, None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    out = where.open_output_stream(name + ".part", compression=None)
                if row["chunk"] == 0:
                    packer, digest, so_far = zlib.compressobj(3, zlib.DEFLATED, 31), hashlib.sha1(), 0
                    out.write(packer.compress(record_head(*(row[c] for c in ("page_id", "url", "n_bytes", "sha1", "refers_to")))))
                    records += 1
                out.write(packer.compress(row["data"]))
                digest.update(row["data"])
                so_far += len(row["data"])
                if row["chunk"] == row["last"]:
                    if row["refers_to"] is None and (so_far, digest.hexdigest()) != (row["n_bytes"], row["sha1"]):
                        raise ValueError(f"page {row['page_id']}: the chunks do not make the payload")
                    out.write(packer.compress(b"\r\n\r\n"))
                    out.write(packer.flush())
        if out is not None:
            out.close()
            where.move(name + ".part", name)
            yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name.rsplit('/', 1)[-1]}"], "records": [records]})

    return run


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write pages to a new folder; returns the manifest (archive, records)."""
    rows = chunk_table(classify(bound_batches(pages), min_bytes), chunk_bytes)
    return materialize(rows.mapInArrow(_writer(folder), "archive string, records long"), "manifest")


def read_records(stream, chunk_bytes: int = CHUNK_BYTES):
    """Chunks of the records in a readable stream of an inflated archive, as dicts."""
    record = 0
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not at the start of a record")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            key, _, value = line.decode("utf-8").partition(":")
            head[key.strip().lower()] = value.strip()
        left = int(head["content-length"])
        declared = None
        while left:  # the HTTP header
            line = stream.readline(left)
            left -= len(line)
            if line.lower().startswith(b"content-length:"):
                declared = int(line.split(b":")[1])
            if line in (b"\r\n", b"\n", b""):
                break
        kind = head["warc-type"]
        number = lambda key: int(x) if (x := head.get(key, "").removeprefix("<urn:page:").rstrip(">")) else None
        same = {"record": record, "record_type": kind, "page_id": number("warc-record-id"), "target_uri": head.get("warc-target-uri"), "refers_to": number("warc-refers-to")}
        digest, total, chunk = hashlib.sha1(), 0, 0
        while True:
            data = stream.read(min(left, chunk_bytes))
            if left and not data:
                raise ValueError("an archive ends within a record")
            left -= len(data)
            total += len(data)
            digest.update(data)
            so_far = base64.b32encode(digest.digest()).decode("ascii")
            row = same | {"chunk": chunk, "is_last": left == 0, "data": data, "bytes_so_far": total, "digest_so_far": so_far, "payload_bytes": None, "payload_digest": None}
            if left == 0:
                stated = head["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and stated != so_far:
                    raise ValueError(f"record {record}: the payload does not match its digest")
                row["payload_bytes"], row["payload_digest"] = (total, so_far) if kind == "response" else (declared, stated)
            yield row
            chunk += 1
            if left == 0:
                break
        record += 1


def _reader(chunk_bytes: int, with_data: bool):
    schema = to_arrow_schema(StructType.fromDDL(CHUNKS))

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                where, path = fs.FileSystem.from_uri(archive)
                with where.open_input_stream(path, compression=None) as raw:
                    stream, rows, size = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 16), [], 0
                    for row in read_records(stream, chunk_bytes):
                        size += len(row["data"])
                        rows.append(row | {"archive": archive} | ({} if with_data else {"data": None}))
                        if len(rows) >= 1000 or with_data and size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def read_archives(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunk table of the archives in a manifest.

    Every row carries the length and digest of its record up to and with it; a record's last row has those of the whole payload, checked
    against the header. A revisit has one empty chunk and the values its header states.
    """
    files = bound_batches(manifest).select("archive").repartition(max(1, manifest.count()))
    return files.mapInArrow(_reader(chunk_bytes, with_data), CHUNKS)


def _joiner(batches):
    """Whole texts of chunks that come in order, each put together once."""
    import pyarrow as pa

    now, parts = None, []
    names = ("archive", "record", "page_id")

    def done():
        columns = [pa.array([v], t) for v, t in zip(now, (pa.string(), pa.int64(), pa.int64()), strict=True)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([b"".join(parts).decode("utf-8")], pa.string())], names=[*names, "html"])

    for batch in batches:
        for *key, data in zip(*(batch.column(c).to_pylist() for c in (*names, "data")), strict=True):
            if key != now:
                if now is not None:
                    yield done()
                now, parts = key, []
            parts.append(data)
    if now is not None:
        yield done()


def payload_texts(chunks: DataFrame) -> DataFrame:
    """archive, record, page_id, html of response records, joined from their chunks: for texts that fit a row."""
    mine = chunks.where("record_type = 'response'").select("archive", "record", "page_id", "chunk", "data")
    parts = max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    ordered = bound_batches(mine).repartition(parts, "archive", "record").sortWithinPartitions("archive", "record", "chunk")
    return ordered.mapInArrow(_joiner, "archive string, record long, page_id long, html string")


def warc_digest(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page, as read back."""
    folder = fresh_folder(pages.sparkSession, "warc")
    chunks = read_archives(write_archives(pages, folder), with_data=False)
    return chunks.where("is_last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages
), d AS (
  SELECT *, list_transform(range(0, 8), lambda g: CAST('0x' || substr(sha1(h), g * 5 + 1, 5) AS BIGINT)) AS fives FROM p
)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(fives, lambda v: array_to_string(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> s) & 31 AS INTEGER) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM d
"""
