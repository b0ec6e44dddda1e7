"""WARC archives: written as one gzip stream a file, then normalised to one gzip member a record with an offset index.

Files are opened through pyarrow's file systems by URI, so the shared folder may be on any store that pyarrow reaches
from the executors. Each file is written under a name of its attempt and then renamed, so a repeated task is harmless.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import Workspace, new_path, read_table, with_group_totals

#: Payloads of at least so many bytes are deduplicated.
REVISIT_BYTES = 100
#: About so many payload bytes go to one archive.
ARCHIVE_BYTES = 16 << 20
#: Bytes inflated or read at a time.
CHUNK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _publish(uri: str, write) -> None:
    system, path = _fs(uri)
    own = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(own) as out:
        write(out)
    system.move(own, path)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record. The block of a revisit is empty; its headers keep length and digest of the payload."""
    block = b"" if revisit else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k: v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a plain stream: headers, and the whole record. Only one record is held at a time."""
    buffer = bytearray()
    chunks = iter(chunks)

    def need(n: int) -> bool:
        while len(buffer) < n:
            more = next(chunks, None)
            if more is None:
                return False
            buffer.extend(more)
        return True

    while True:
        at, seen = -1, 0
        while (at := buffer.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(buffer)
            if not need(seen + 1):
                if buffer.strip():
                    raise ValueError("a record is cut off")
                return
        head = parse_head(bytes(buffer[:at]))
        size = at + 4 + int(head["Content-Length"]) + 4
        if not need(size):
            raise ValueError("a record is cut off")
        yield head, bytes(buffer[:size])
        del buffer[:size]


def inflate(stream) -> Iterator[bytes]:
    """What a gzip file holds, piece by piece, be it one member or many."""
    inflater = zlib.decompressobj(31)
    fresh = True
    while data := stream.read(CHUNK):
        while data:
            if fresh:
                inflater, fresh = zlib.decompressobj(31), False
            if out := inflater.decompress(data, CHUNK):
                yield out
            data = inflater.unconsumed_tail
            if inflater.eof:
                data, fresh = inflater.unused_data, True
    if not fresh and not inflater.eof:
        raise ValueError("the gzip stream is cut off")


def normalise(source: str, target: str, level: int = 6) -> list[tuple[int, int, str, str]]:
    """Rewrite a monolithic archive with a gzip member per record. Writes the index beside it, a line of offset, length,
    record id and type for each record, and returns its rows."""
    rows: list[tuple[int, int, str, str]] = []

    def write(out) -> None:
        at = 0
        system, path = _fs(source)
        with system.open_input_stream(path, compression=None) as stream:
            for head, whole in records(inflate(stream)):
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(whole) + packer.flush()
                out.write(member)
                rows.append((at, len(member), head["WARC-Record-ID"], head["WARC-Type"]))
                at += len(member)

    _publish(target, write)
    _publish(f"{target}.idx", lambda out: out.write("".join(f"{a}\t{n}\t{i}\t{t}\n" for a, n, i, t in rows).encode()))
    return rows


def read_record(stream, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record, from its own member alone."""
    stream.seek(offset)
    whole = zlib.decompress(stream.read(length), 31)
    head, _, rest = whole.partition(b"\r\n\r\n")
    found = parse_head(head)
    return found, rest[: int(found["Content-Length"])]


def read_index(uri: str) -> list[tuple[int, int, str, str]]:
    system, path = _fs(uri)
    with system.open_input_stream(path, compression=None) as f:
        lines = f.read().decode().splitlines()
    return [(int(a), int(n), i, t) for a, n, i, t in (x.split("\t") for x in lines)]


def plan_records(pages: DataFrame, ws: Workspace, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, digest, refers_to) of revisits: of rows with equal payloads of at least 100 bytes the smallest id is the
    response, which refers_to names for the others. An id may have other payloads too, so the digest belongs to the key."""
    body = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = ws.keep(pages.select(F.col(id_col).alias("id"), F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("bytes")))
    large = with_group_totals(rows.filter(F.col("bytes") >= REVISIT_BYTES), ["digest"], "id", first=("min", "id"))
    small = rows.filter(F.col("bytes") < REVISIT_BYTES).withColumn("first", F.col("id"))
    return large.unionByName(small).filter("id <> first").select("id", "digest", F.col("first").alias("refers_to")).distinct()


def write_archives(pages: DataFrame, folder: str, ws: Workspace, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the pages as monolithic gzip archives into ``folder``, each task its own files of about ARCHIVE_BYTES of
    payload, and return (archive). Pages aren't shuffled unless the revisits are too many to be broadcast."""
    revisits = ws.keep(plan_records(pages, ws, id_col, html_col))
    revisits = F.broadcast(revisits) if revisits.count() <= 500_000 else revisits
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).join(revisits, ["id", "digest"], "left")
    # ids beside nulls: pandas would make them floats
    rows = rows.withColumns({"id": F.col("id").cast("string"), "refers_to": F.col("refers_to").cast("string"), "task": F.spark_partition_id()})

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, size, names = 0, 0, []
        packer, held, task = None, None, None

        def close() -> str:
            held.write(packer.flush())
            name = f"{folder}/mono-{task:06d}-{n:06d}.warc.gz"
            data = held.getvalue()
            _publish(name, lambda out: out.write(data))
            return name

        for batch in batches:
            for key, url, payload, digest, refers, task in zip(batch["id"], batch["url"], batch["payload"], batch["digest"], batch["refers_to"], batch["task"], strict=True):
                if packer is None:
                    packer, held, size = zlib.compressobj(1, zlib.DEFLATED, 31), io.BytesIO(), 0
                refers, key = None if pd.isna(refers) else int(refers), None if pd.isna(key) else int(key)
                held.write(packer.compress(record(key, url, payload, digest, refers, refers is not None)))
                size += len(payload)
                if size >= ARCHIVE_BYTES:
                    names.append(close())
                    packer, n = None, n + 1
        if packer is not None:
            names.append(close())
        yield pd.DataFrame({"archive": names}, dtype="object")

    return ws.keep(rows.mapInPandas(write, "archive string"))


def normalise_archives(archives: DataFrame, ws: Workspace) -> DataFrame:
    """Normalise each archive beside it, and delete the monolithic one; (archive, records). A task that runs again after
    it deleted its source finds the index, which is written last."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source in batch["archive"]:
                target = source.replace("/mono-", "/rec-")
                system, path = _fs(source)
                try:
                    rows = normalise(source, target)
                    system.delete_file(path)
                except FileNotFoundError:
                    rows = read_index(f"{target}.idx")
                yield pd.DataFrame({"archive": [target], "records": [len(rows)]})

    return ws.keep(spread(archives).mapInPandas(work, "archive string, records long"))


def spread(archives: DataFrame) -> DataFrame:
    """One archive name a partition, as far as there are enough tasks."""
    n = max(1, min(archives.count(), 10_000))
    return archives.repartition(n, "archive") if n > 1 else archives.coalesce(1)


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record, each read by its offset alone: page_id, url, record_type, payload_digest, payload_bytes,
    refers_to, payload (null for revisits)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
        of = lambda x: int(x[len("<urn:page:") : -1]) if x and len(x) > len("<urn:page:>") else None
        for batch in batches:
            for name in batch["archive"]:
                system, path = _fs(name)
                out, size = [], 0
                with system.open_input_file(path) as f:
                    for offset, length, _, _ in read_index(f"{name}.idx"):
                        head, block = read_record(f, offset, length)
                        revisit = head["WARC-Type"] == "revisit"
                        digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                        if not revisit and hashlib.sha256(block).hexdigest() != digest:
                            raise ValueError(f"{name}: the payload at {offset} doesn't have its digest")
                        out.append((of(head["WARC-Record-ID"]), head["WARC-Target-URI"], head["WARC-Type"], digest, int(head["X-Payload-Length"]), of(head.get("WARC-Refers-To")), None if revisit else block))
                        size += len(block)
                        if size > CHUNK * 4:
                            yield pd.DataFrame(out, columns=names, dtype="object").astype({"page_id": "Int64", "refers_to": "Int64"})
                            out, size = [], 0
                yield pd.DataFrame(out, columns=names, dtype="object").astype({"page_id": "Int64", "refers_to": "Int64"})

    return spread(archives).mapInPandas(work, "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary")


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a record per page to archives in ``folder`` (in the session's shared folder, if not given), normalise them,
    and return what is read back from them, as ``read_archives`` does.

    Null html is an empty payload; null or malformed urls are kept as an empty or the same target. Of pages with equal
    payloads of at least 100 bytes the smallest id is the response. Repeated rows with that id are responses each; a
    page without id is a response. Rows that share an id but not the payload are told apart by their digests. A page is held
    whole, in a worker in up to five copies (batch, payload, record, archive, member), so the largest page times five must
    fit a worker. An empty table writes no archive. Payloads are compared by SHA-256; only ids,
    digests and sizes are shuffled, and groups of copies are totalled in parts.
    """
    spark = pages.sparkSession
    ws = Workspace(spark, "warc")
    folder = folder or new_path(spark, "archives")
    made = write_archives(pages, folder_ready(spark, folder), ws)
    return read_archives(normalise_archives(made, ws))


def folder_ready(spark: SparkSession, folder: str) -> str:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(where)
    return str(system.makeQualified(where).toString()).replace("file:/", "file:///", 1) if str(system.getScheme()) == "file" and not folder.startswith("file:///") else folder


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(read_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH d AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
