"""WARC archives in Zstandard frames.

An archive begins with a skippable frame that holds its dictionary; each record is a frame of its own,
so any record can be decoded alone. Archives are read through Spark's binary reader, on any file system it
knows; the dictionary is loaded from the leading frame and headers, lengths and digests are validated.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.session import ship

from .common import HOT_KEYS, LIGHT, col, shared_dir, written

#: Fixed values of the formats: the dictionary's skippable frame, a Zstandard frame, a dictionary.
DICTIONARY_FRAME, ZSTD_FRAME, ZSTD_DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: Bytes of an archive that are decoded at once.
STEP = 1 << 14
#: Digests that several pages share are broadcast up to so many; beyond, only the hot ones are.
BROADCAST_ROWS = 500_000
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


class WarcError(ValueError):
    """An archive or a record that is not as it says."""


def digest(payload: bytes) -> str:
    """The bare base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(record_id: str | None) -> int | None:
    if record_id is None or record_id == "<urn:page:none>":
        return None
    if not (record_id.startswith("<urn:page:") and record_id.endswith(">")):
        raise WarcError(f"record id {record_id!r}")
    return int(record_id[len("<urn:page:") : -1])


def _uri(url: str) -> str:
    """On one header line: blanks and line breaks, which no URI has, are percent-encoded and stay so."""
    return re.sub(r"\s", lambda m: quote(m[0]), url)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record: a response with its payload, or a revisit, whose HTTP headers tell the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    headers = [
        VERSION,
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        headers.append(f"WARC-Target-URI: {_uri(url)}")
    if revisit:
        headers += [f"WARC-Refers-To: {_id(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(headers).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    out = {}
    for line in lines:
        name, sep, value = line.partition(":")
        if not sep or not re.fullmatch(r"[!-9;-~]+", name):
            raise WarcError(f"header line {line[:80]!r}")
        out[name.lower()] = value.strip()
    return first, out


def _needed(headers: dict[str, str], name: str) -> str:
    if name not in headers:
        raise WarcError(f"no {name} header")
    return headers[name]


def _length(headers: dict[str, str]) -> int:
    said = _needed(headers, "content-length")
    if not (said.isascii() and said.isdigit()):
        raise WarcError(f"content length {said!r}")
    return int(said)


def parse_record(data: bytes) -> tuple:
    """The columns of RECORD; a revisit's payload is None. Raises WarcError if anything does not fit."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    first, headers = _headers(head)
    if not sep or first != VERSION:
        raise WarcError(f"not a {VERSION} record: {first[:80]!r}")
    length = _length(headers)
    block, after = rest[:length], rest[length:]
    if len(block) != length or after != b"\r\n\r\n":
        raise WarcError(f"record of {len(rest) - 4} bytes says {length}")
    kind = _needed(headers, "warc-type")
    if kind not in ("response", "revisit"):
        raise WarcError(f"record type {kind!r}")
    http, sep, payload = block.partition(b"\r\n\r\n")
    status, fields = _headers(http)
    size = _length(fields)
    if not sep or not status.startswith("HTTP/"):
        raise WarcError("no HTTP headers")
    if len(payload) != (size if kind == "response" else 0):
        raise WarcError(f"{kind} with a payload of {len(payload)} bytes says {size}")
    said = _needed(headers, "warc-payload-digest").removeprefix("sha1:")
    if kind == "response" and digest(payload) != said:
        raise WarcError("the payload has another digest")
    revisit = kind == "revisit"
    return _page(_needed(headers, "warc-record-id")), headers.get("warc-target-uri"), kind, _page(headers.get("warc-refers-to")) if revisit else None, said, size, None if revisit else payload


def train_dictionary(records: list[bytes], size: int = 16_384) -> bytes:
    """A Zstandard dictionary of some records; b"" if they are too few to learn from."""
    try:
        return zstandard.train_dictionary(size, records).as_bytes()
    except zstandard.ZstdError:
        return b""


def archive_bytes(records: list[bytes], dictionary: bytes, level: int = 3) -> bytes:
    """The dictionary in a skippable frame (none if empty), then a frame per record."""
    loaded = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    packer = zstandard.ZstdCompressor(level=level, dict_data=loaded, write_checksum=True, write_content_size=True)
    frames = [packer.compress(r) for r in records]
    if dictionary:
        packed = zstandard.ZstdCompressor(level=level).compress(dictionary)
        frames.insert(0, struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
    return b"".join(frames)


def read_archive(data: bytes) -> Iterator[tuple]:
    """The records of an archive, one frame at a time. The dictionary may be packed or plain."""
    at, loaded = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
        (size,) = struct.unpack_from("<I", data, 4)
        raw = data[8 : 8 + size]
        if len(raw) != size:
            raise WarcError("the dictionary's frame is cut off")
        if raw[:4] == struct.pack("<I", ZSTD_FRAME):
            raw = zstandard.ZstdDecompressor().decompress(raw)
        if raw[:4] != struct.pack("<I", ZSTD_DICTIONARY):
            raise WarcError("the leading frame holds no dictionary")
        loaded, at = zstandard.ZstdCompressionDict(raw), 8 + size
    view = memoryview(data)
    unpacker = zstandard.ZstdDecompressor(dict_data=loaded) if loaded else zstandard.ZstdDecompressor()
    while at < len(data):
        frame, begin, out = unpacker.decompressobj(), at, []
        try:
            while not frame.eof and at < len(data):  # in steps: what a step holds beyond the frame is copied
                out.append(frame.decompress(view[at : at + STEP]))
                at = min(at + STEP, len(data))
        except zstandard.ZstdError as e:
            raise WarcError(f"frame at byte {begin}: {e}") from e
        if not frame.eof:
            raise WarcError(f"the frame at byte {begin} is cut off")
        at -= len(frame.unused_data)
        yield parse_record(b"".join(out))


def with_revisits(pages: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``(page_id, url, payload, refers_to, revisit)`` of pages ``(page_id, url, payload)``.

    Of equal payloads (SHA-1 and length), the row with the largest page_id is the response and the others
    revisit it; a null page_id is smaller than all others. Rows that share this page_id are all responses.
    Only digests are grouped, and these in part before they are shuffled. Payloads stay where they are unless too
    many digests are shared to be broadcast; then the pages of a hot digest still do not meet in one task.
    """
    marked = pages.select("page_id", "url", "payload", F.sha1("payload").alias("sha"), F.octet_length("payload").alias("size"))
    first = written(marked.groupBy("sha", "size").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")), "digests")
    shared = first.where("n > 1").select("sha", "size", "refers_to", F.lit(True).alias("shared"), "n")
    by, (n_shared, n_rows) = ["sha", "size"], shared.agg(F.count(F.lit(1)), F.sum("n")).first()
    if n_shared <= broadcast_rows:
        joined = marked.join(F.broadcast(shared), by, "left")
    else:
        most = max(LIGHT, n_rows // HOT_KEYS)
        hot = F.broadcast(shared.where(F.col("n") > most))  # fewer than HOT_KEYS
        cold = marked.join(hot.select(*by), by, "left_anti").join(shared.where(F.col("n") <= most), by, "left")
        joined = marked.join(hot, by).unionByName(cold)
    revisit = F.coalesce("shared", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return joined.select(
        "page_id", "url", "payload", F.when(revisit, F.col("refers_to")).alias("refers_to"), revisit.alias("revisit")
    )


def write_archives(records: DataFrame, folder: str, archive_mb: float = 8, sample: int = 512) -> DataFrame:
    """Writes ``<part>-<number>.warc.zst`` files of rows ``(page_id, url, payload, refers_to, revisit)``.

    Returns ``(path, records)`` of each. A file ends once it holds ``archive_mb`` MB of records, and its
    dictionary is trained on its first ``sample`` records. A task that is repeated writes the same names
    anew, each by a rename, so a lost executor leaves no half of a file.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyspark import TaskContext

        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(place)
        store.create_dir(root, recursive=True)
        number, held, size = 0, [], 0

        def end() -> pd.DataFrame:
            name = f"{root}/{context.partitionId():06d}-{number:04d}.warc.zst"
            part = f"{root}/.{context.taskAttemptId()}-{number}.part"
            with store.open_output_stream(part) as out:
                out.write(archive_bytes(held, train_dictionary(held[:sample])))
            store.move(part, name)
            return pd.DataFrame({"path": [name.rsplit("/", 1)[1]], "records": [len(held)]})

        for batch in batches:
            for page_id, url, payload, refers_to, revisit in zip(*(batch[c].array for c in ("page_id", "url", "payload", "refers_to", "revisit")), strict=True):
                held.append(record_bytes(_whole(page_id), url if isinstance(url, str) else None, payload, _whole(refers_to), bool(revisit)))
                size += len(held[-1])
                if size >= archive_mb * 1e6:
                    yield end()
                    number, held, size = number + 1, [], 0
        if held:
            yield end()

    ship(records.sparkSession)
    place = _qualified(records.sparkSession, folder)
    typed = records.select(F.col("page_id").cast("string"), "url", "payload", F.col("refers_to").cast("string"), "revisit")
    return typed.mapInPandas(write, "path string, records long")


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme of the file system that Spark reads it from."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", whole)


def _whole(value) -> int | None:
    return int(value) if isinstance(value, str) else None


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all ``*.warc.zst`` files of a folder, with the columns of RECORD."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = _arrow_schema()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(zip(*rows, strict=True), schema.types, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], schema=schema)

        for batch in batches:
            for data in batch.column("content"):
                rows, size = [], 0
                for record in read_archive(data.as_py()):
                    rows.append(record)
                    size += record[5]
                    if size > 4e6:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select("content").mapInArrow(read, RECORD)


def _arrow_schema():
    import pyarrow as pa

    whole, text = pa.int64(), pa.string()
    return pa.schema([("page_id", whole), ("url", text), ("record_type", text), ("refers_to", whole), ("payload_digest", text), ("payload_bytes", whole), ("payload", pa.binary())])


def archive_pages(pages: DataFrame, folder: str | None = None, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """All pages written as archives (null html: an empty payload) and read back from them.

    Texts of any length are stored and read whole; repeated rows have a record each, of which those with the largest
    page_id are responses (ties: all of them). Null ids and addresses are kept as nulls. Only the three columns named are
    read, whatever the names of others. Raises WarcError if fewer or more records were written than there are pages.
    An empty table writes no archive and gives no rows.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/corpuscle/warc-{uuid.uuid4().hex}"
    payload = F.encode(F.coalesce(col(html), F.lit("")), "UTF-8")
    records = with_revisits(pages.select(col(page).alias("page_id"), col(url).alias("url"), payload.alias("payload")))
    made = write_archives(records, folder).agg(F.sum("records")).first()[0] or 0
    n = pages.count()
    if made != n:
        raise WarcError(f"{made} records of {n} pages")
    return read_archives(spark, folder) if made else spark.createDataFrame([], RECORD)


def warc_digest(pages: DataFrame) -> DataFrame:
    """Each page's record as read back: lengths, digest, type and what it refers to; cases as in ``archive_pages``.

    A null or empty html is an empty payload, which pages share like any other.
    """
    return archive_pages(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
