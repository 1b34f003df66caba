"""WARC archives: writing, gzip normalising with an index, reading back.

Archives are first written as one gzip stream each, as some crawlers leave them.
``normalise`` inflates such a stream once, in chunks, rewrites every record as a
gzip member of its own and notes member offsets in a sidecar index, so that later
reads can seek to single records. Of pages with equal payloads (told by length and
SHA-256) the one with the largest id is a response; the others are revisits that refer
to it and carry no payload, but its digest and length. Reading back, every revisit must
find its response.

Files lie in the shared folder, written under a task's own name and moved into
place, so that a task that runs again after a loss leaves the same file. Rows are
dealt to archives by a hash of their id and url, so copies spread over all of them; an
archive holds some ``ARCHIVE_BYTES`` of payload.

A null html is an empty payload, a null url an empty one; line ends, blanks and control
characters of a url are percent-encoded. Rows that repeat an id are records of their
own; a null id takes part, but wins against no id. Other columns are left out, and an
empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import cut, shared_dir

CHUNK = 1 << 20
ARCHIVE_BYTES = 16 << 20
LEVEL = 4
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def file_system(uri: str):
    """(pyarrow file system, path) of a folder in the shared store."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: str, url: str, payload: bytes, length: int, digest: str, refers: str | None) -> bytes:
    """One WARC/1.1 record."""
    url = re.sub("[\\x00-\\x20\\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    headers = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:weft:page:{page_id}>",
        f"WARC-Target-URI: {url}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {length}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(payload)}",
    ]
    if refers is not None:
        headers += [f"WARC-Refers-To: <urn:weft:page:{refers}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(headers).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Plain bytes of a gzip file of one or many members, chunk by chunk."""
    z, inside = zlib.decompressobj(31), False
    for chunk in chunks:
        while chunk:
            inside = True
            out = z.decompress(chunk, CHUNK)
            if out:
                yield out
            chunk = z.unconsumed_tail
            if z.eof:
                chunk = z.unused_data
                z, inside = zlib.decompressobj(31), False
    if inside:
        raise ValueError("the stream ends inside a gzip member")


def records(plain: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, payload, the whole record) of each record of a plain stream."""
    have = bytearray()
    for chunk in plain:
        have += chunk
        while (end := have.find(b"\r\n\r\n")) >= 0:
            headers = dict((line.split(":", 1)[0], line.split(":", 1)[1].strip()) for line in have[:end].decode().split("\r\n")[1:])
            size = int(headers["Content-Length"])
            whole = end + 4 + size + 4
            if len(have) < whole:
                break
            yield headers, bytes(have[end + 4 : end + 4 + size]), bytes(have[:whole])
            del have[:whole]
    if have:
        raise ValueError(f"{len(have)} bytes after the last whole record")


def member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _publish(fs, path: str, data: bytes | None = None, parts: Iterator[bytes] | None = None) -> None:
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temporary) as out:
        for part in parts if parts is not None else [data]:
            out.write(part)
    fs.move(temporary, path)


def _chunks(stream) -> Iterator[bytes]:
    while data := stream.read(CHUNK):
        yield data


def normalise_file(fs, source: str, target: str) -> int:
    """Rewrite one archive; returns its number of records.

    The source goes once its normalised form and then the index are in place. A
    task that runs again after that finds no source and counts the index.
    """
    from pyarrow.fs import FileType

    if fs.get_file_info(source).type == FileType.NotFound:
        with fs.open_input_stream(target + ".idx") as stream:
            return sum(chunk.count(b"\n") for chunk in _chunks(stream))
    index = io.StringIO()
    count = offset = 0

    def members() -> Iterator[bytes]:
        nonlocal count, offset
        with fs.open_input_stream(source, compression=None) as stream:
            for headers, _, whole in records(inflate(_chunks(stream))):
                data = member(whole)
                index.write(json.dumps({"id": headers["WARC-Record-ID"], "type": headers["WARC-Type"], "offset": offset, "length": len(data)}) + "\n")
                count, offset = count + 1, offset + len(data)
                yield data

    _publish(fs, target, parts=members())
    _publish(fs, target + ".idx", index.getvalue().encode())
    fs.delete_file(source)
    return count


def read_member(file, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record of an open archive by its index entry, without reading what is
    before it."""
    headers, payload, _ = next(records(inflate(iter([file.read_at(length, offset)]))))
    return headers, payload


def base32(hexadecimal: Column) -> Column:
    """40 hex digits as 32 letters: five digits are four letters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")

    def four(at: int) -> list[Column]:
        number = F.conv(F.substring(hexadecimal, at, 5), 16, 10).cast("int")
        return [F.substring(letters, F.shiftright(number, b).bitwiseAND(31) + 1, F.lit(1)) for b in (15, 10, 5, 0)]

    return F.concat(*[c for at in range(1, 41, 5) for c in four(at)])


def with_digests(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, and identity (SHA-256)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), base32(F.sha1(payload)).alias("payload_digest"), F.unhex(F.sha2(payload, 256)).alias("identity"))


def archives_of(pages: DataFrame) -> int:
    """How many archives the pages' payloads fill; some for each core at least."""
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    return max(2 * pages.sparkSession.sparkContext.defaultParallelism, -(-total // ARCHIVE_BYTES))


def dealt(pages: DataFrame, archives: int) -> DataFrame:
    """Adds the ``archive`` of each page, by a hash of its id and url."""
    return pages.withColumn("archive", F.pmod(F.xxhash64("page_id", "url"), F.lit(archives)))


def revisits_of(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(archive, page_id, identity, refers_to) of the pages whose payload a larger id
    holds as well.

    Counting combines before it shuffles, and no payload is moved. Of rows that
    repeat the winner's id and payload, all are responses.
    """
    narrow = cut(pages.select("archive", "page_id", "payload_bytes", "identity"))
    repeated = narrow.where(F.col("payload_bytes") >= least_bytes).groupBy(F.col("payload_bytes").alias("size"), F.col("identity").alias("is")).agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).where("n > 1 and winner is not null")
    found = narrow.join(repeated, (F.col("payload_bytes") == F.col("size")) & (F.col("identity") == F.col("is"))).where("page_id is null or page_id < winner")
    return found.select("archive", "page_id", "identity", F.col("winner").alias("refers_to")).distinct()


def write_archives(pages: DataFrame, revisits: DataFrame, folder: str) -> DataFrame:
    """One gzip stream of many records for each archive; (path, records).

    Pages meet their archive's revisits in the task that writes it, so payloads
    are shuffled once.
    """

    def write(key: tuple[pa.Scalar, ...], table: pa.Table, known: pa.Table) -> pa.Table:
        fs, root = file_system(folder)
        path, count = f"{root}/mono-{key[0].as_py():06d}.warc.gz", 0
        refers = {(i, x): to for i, x, to in zip(known["id"].to_pylist(), known["of"].to_pylist(), known["to"].to_pylist())}

        def stream() -> Iterator[bytes]:
            nonlocal count
            z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            for batch in table.to_batches(max_chunksize=64):
                for row in batch.to_pylist():
                    to = refers.get((row["id"], row["identity"]))
                    data = record("response" if to is None else "revisit", row["id"], row["url"] or "", row["payload"] if to is None else b"", row["payload_bytes"], row["payload_digest"], to)
                    count += 1
                    yield z.compress(data)
            yield z.flush()

        _publish(fs, path, parts=stream())
        return pa.table({"path": [path], "records": [count]})

    own = F.coalesce(F.col("page_id").cast("string"), F.lit("null")).alias("id")
    left = pages.select("archive", own, "url", "payload", "payload_bytes", "payload_digest", "identity")
    right = revisits.select(F.col("archive").alias("at"), own, F.col("identity").alias("of"), F.col("refers_to").cast("string").alias("to"))
    return left.groupBy("archive").cogroup(right.groupBy("at")).applyInArrow(write, "path string, records long")


def _spread(archives: DataFrame) -> DataFrame:
    """Paths dealt over the cores, a few to a task."""
    cores = archives.sparkSession.sparkContext.defaultParallelism
    count = archives.count()
    return archives.select("path").repartition(max(1, min(count, max(cores, count // 4))))


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Normalise every archive of (path); returns (path, records)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = file_system(folder)
        for frame in batches:
            targets = [f"{root}/{path.rsplit('/', 1)[-1].replace('mono-', 'part-')}" for path in frame["path"]]
            yield pd.DataFrame({"path": targets, "records": [normalise_file(fs, a, b) for a, b in zip(frame["path"], targets)]})

    return _spread(archives).mapInPandas(run, "path string, records long")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Every record's facts, read back through the archives' index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(path + ".idx") as stream:
                    entries = [json.loads(line) for line in stream.read().decode().splitlines()]
                file = fs.open_input_file(path)
                for entry in entries:
                    headers, payload = read_member(file, entry["offset"], entry["length"])
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    response = headers["WARC-Type"] == "response"
                    if response and (base32_sha1(payload) != digest or len(payload) != int(headers["X-Payload-Length"])):
                        raise ValueError(f"{path}: a payload does not match its digest at {entry['offset']}")
                    number = lambda name: None if (t := headers[name].rstrip(">").rsplit(":", 1)[-1]) == "null" else int(t)  # noqa: B023,E731
                    rows.append((number("WARC-Record-ID"), int(headers["X-Payload-Length"]), digest, headers["WARC-Type"], None if response else number("WARC-Refers-To")))
                file.close()
                # Arrow keeps ids whole: beside a null a column of numbers would turn into doubles
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return _spread(archives).mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def resolved(read: DataFrame) -> DataFrame:
    """``read`` as it is, if every revisit's response is there with the same digest;
    else an error."""
    there = read.where("record_type = 'response'").select(F.col("page_id").alias("__page"), F.col("payload_digest").alias("__digest"), F.lit(True).alias("__there")).distinct()
    both = read.join(there, (F.col("refers_to") == F.col("__page")) & (F.col("payload_digest") == F.col("__digest")), "left")
    lost = (F.col("record_type") == "revisit") & F.col("__there").isNull()
    kind = F.when(lost, F.raise_error(F.concat(F.lit("a revisit without its response: page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))).otherwise(F.col("record_type"))
    return both.select("page_id", "payload_bytes", "payload_digest", kind.alias("record_type"), "refers_to")


def op7_warc(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pages = dealt(with_digests(table), archives_of(table))
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    written = cut(write_archives(pages, revisits_of(pages), folder))
    return resolved(cut(read_archives(cut(normalise(written, folder)), folder)))


ORACLE = {
    "op7_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(encode(coalesce(html, ''))) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS winner FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 40, 5), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda b:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, i + 1, 5))::INT >> b) & 31) + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = winner THEN NULL ELSE winner END AS refers_to
FROM g
""",
}
