"""WARC archives: one gzip member per record, written and read in Spark tasks.

Of records with equal payloads one is a ``response``, the others are ``revisit`` records that refer to it. The reader goes through an
archive once, member by member: zlib gives pieces of bounded size, the record's Content-Length frames its block, and block and
payload are hashed as they pass, so memory doesn't grow with a record or an archive. Archives lie in the shared folder; a task names
its files anew at every attempt and only the names in the committed table are read, so lost executors leave nothing half-written
in the result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from duelstats.session import cut, scratch_path

CHUNK = 1 << 16
ARCHIVE_BYTES = 1 << 28
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the name space of URLs
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value
DATE = "2000-01-01T00:00:00Z"
END = b"\r\n\r\n"


class ArchiveError(ValueError):
    """An archive that isn't framed as it should be or doesn't match its digests."""


def digest(sha: bytes) -> str:
    return base64.b32encode(sha).decode()


def record_id(page_id, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}/{payload_digest}')}>"


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One record with its HTTP block; a revisit leaves the payload out."""
    payload_digest = digest(hashlib.sha1(payload).digest())
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(payload)}".encode() + END
    if not revisit:
        block += payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(f"revisit {page_id}" if revisit else page_id, payload_digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", "".join(f"%{ord(c):02X}" if c < "!" else c for c in url or "")),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Block-Digest", "sha1:" + digest(hashlib.sha1(block).digest())),
        ("WARC-Payload-Digest", "sha1:" + payload_digest),
        ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        fields.append(("Page-Id", quote(str(page_id))))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, payload_digest)), ("Refers-To-Page-Id", quote(str(refers_to)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + END


def _filesystem(folder: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder)


def _writer(folder: str, archive_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = lambda: pa.RecordBatch.from_pydict({"archive": [name], "records": [count], "bytes": [size]})
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        out, name, size, count = None, "", 0, 0
        for batch in batches:
            for page_id, url, html, revisit, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                member = zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = record(page_id, url, (html or "").encode(), refers_to, revisit)
                packed = member.compress(raw) + member.flush()
                out.write(packed)
                size, count = size + len(packed), count + 1
                if size >= archive_bytes:
                    out.close()
                    out = None
                    yield told()
        if out is not None:
            out.close()
            yield told()

    return write


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per page below ``folder``; the table of archives (``archive``, ``records``, ``bytes``) is the manifest.

    Of pages with equal payloads of at least ``least`` bytes, that with the largest identifier is the response and the others revisit
    it; rows that share that identifier are responses too, and so are all of a group without identifiers. A null text is an
    empty payload, a null address an empty one. Identifiers of any type go into the records as text. An empty table writes nothing.
    """
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{url_col}`").alias("_url"), html.alias("_html"))
    # the archive's digest alone can be made to agree for different payloads
    same = ["_sha", "_other", "_n"]
    rows = rows.withColumns({"_sha": F.unhex(F.sha1(F.encode("_html", "UTF-8"))), "_other": F.xxhash64("_html"), "_n": F.octet_length("_html")})
    # pages alone with their payload need no partner: only groups of two and more are joined
    shared = rows.where(F.col("_n") >= least).groupBy(*same).agg(F.max("_id").alias("_best"), F.count(F.lit(1)).alias("_rows")).where("_rows > 1").drop("_rows")
    joined = rows.join(cut(shared), same, "left")
    revisit = F.col("_best").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_best"))
    dealt = joined.select(F.col("_id").cast("string"), "_url", "_html", revisit.alias("_revisit"), F.when(revisit, F.col("_best").cast("string")).alias("_refers"))
    return cut(dealt.mapInArrow(_writer(folder, archive_bytes), "archive string, records bigint, bytes bigint"))


def members(stream) -> Iterator[Iterator[bytes]]:
    """The gzip members of a stream, each as an iterator over its bytes in bounded pieces; each must be used up before the next."""
    raw = stream.read(CHUNK)
    while raw:
        unpack = zlib.decompressobj(31)

        def pieces(unpack=unpack):
            nonlocal raw
            data = raw
            while not unpack.eof:
                if not data:
                    data = stream.read(CHUNK)
                    if not data:
                        raise ArchiveError("an archive ends within a record")
                piece = unpack.decompress(data, CHUNK)
                data = unpack.unconsumed_tail
                if piece:
                    yield piece
            raw = unpack.unused_data or stream.read(CHUNK)

        yield pieces()


class _Bytes:
    """Reads lines and stretches from an iterator of pieces."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, b""

    def head(self, most: int = 1 << 20) -> bytes:
        """Up to and without the next empty line."""
        while (at := self.held.find(END)) < 0:
            if len(self.held) > most:
                raise ArchiveError("a header without an end")
            self._more()
        found, self.held = self.held[:at], self.held[at + len(END) :]
        return found

    def _more(self) -> None:
        piece = next(self.pieces, None)
        if piece is None:
            raise ArchiveError("a record ends early")
        self.held += piece

    def stretch(self, length: int) -> Iterator[bytes]:
        while length:
            if not self.held:
                self._more()
            part, self.held = self.held[:length], self.held[length:]
            length -= len(part)
            yield part

    def rest(self) -> bytes:
        return self.held + b"".join(self.pieces)


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}


def read_records(stream, with_payload: bool = False) -> Iterator[dict]:
    """The records of one archive in their order, checked against length and digests."""
    for member in members(stream):
        source = _Bytes(member)
        head = source.head()
        if not head.startswith(b"WARC/"):
            raise ArchiveError("a member doesn't start with a record")
        fields = _fields(head)
        block, payload, size, kept = hashlib.sha1(), hashlib.sha1(), 0, []
        left = int(fields["content-length"])
        body = _Bytes(source.stretch(left))
        http = body.head() + END
        block.update(http)
        for part in body.stretch(left - len(http)):
            block.update(part)
            payload.update(part)
            size += len(part)
            if with_payload:
                kept.append(part)
        if source.rest() != END:
            raise ArchiveError("a record doesn't end where its length says")
        revisit = fields["warc-type"] == "revisit"
        if fields["warc-block-digest"] != "sha1:" + digest(block.digest()):
            raise ArchiveError("a block doesn't match its digest")
        if not revisit and fields["warc-payload-digest"] != "sha1:" + digest(payload.digest()):
            raise ArchiveError("a payload doesn't match its digest")
        name = lambda k: unquote(fields[k]) if k in fields else None
        yield {
            "page_id": name("page-id"),
            "record_type": fields["warc-type"],
            "record_id": fields["warc-record-id"],
            "refers_to_record": fields.get("warc-refers-to"),
            "refers_to": name("refers-to-page-id"),
            "url": fields["warc-target-uri"],
            "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"),
            "stored_bytes": size,
        } | ({"payload": b"".join(kept)} if with_payload else {})


SCHEMA = "page_id string, record_type string, record_id string, refers_to_record string, refers_to string, url string, payload_digest string, stored_bytes bigint"


def _reader(folder: str, with_payload: bool):
    kinds = {"string": pa.string(), "bigint": pa.int64()}
    fields = [(n, kinds[k]) for n, k in (f.split() for f in SCHEMA.split(", "))] + ([("payload", pa.binary())] if with_payload else [])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    rows: list[dict] = []
                    held = 0
                    for found in read_records(stream, with_payload):
                        rows.append(found)
                        held += 200 + len(found.get("payload", b""))
                        if held > 1 << 22:
                            yield pa.RecordBatch.from_pylist(rows, pa.schema(fields))
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema(fields))

    return read


def read_archives(manifest: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Every record of the archives that the manifest names, one archive after another in each task; identifiers are texts."""
    files = manifest.select("archive").repartition(max(1, manifest.count()))
    return files.mapInArrow(_reader(folder, with_payload), SCHEMA + (", payload binary" if with_payload else ""))


def round_trip(pages: DataFrame, folder: str | None = None, **kw) -> DataFrame:
    """Write the pages' archives, read them back, and give every record the size of the payload it stands for."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    records = cut(read_archives(write_archives(pages, folder, **kw), folder))
    responses = records.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_record"), "payload_digest").agg(F.max("stored_bytes").alias("payload_bytes"))
    revisits = records.where("record_type = 'revisit'").join(responses, ["refers_to_record", "payload_digest"], "left")
    kind = pages.schema[kw.get("id_col", "page_id")].dataType
    out = [F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")]
    alone = records.where("record_type <> 'revisit'").withColumn("payload_bytes", F.col("stored_bytes"))
    return alone.select(*out).unionByName(revisits.select(*out))
