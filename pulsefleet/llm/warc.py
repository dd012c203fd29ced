"""WARC archives: writing, and a normaliser for archives that are one gzip stream.

An archive compressed as a whole can only be read from its start. The normaliser inflates the stream
once, piece by piece, writes every record as a gzip member of its own, and a sidecar index with one JSON
line per record (offset, length, type, record id, target, payload digest). From then on a task reads any
record by its place. A task holds one record at a time, whatever the archive's size.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsefleet.llm.common import files_folder, open_folder, publish, slices, stored

CHUNK = 1 << 20
LEVEL = 4
LEAST_REVISIT = 1000

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CRLF = b"\r\n"


# -- records -------------------------------------------------------------------------------------


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC/1.1 record."""
    head = "".join(f"{name}: {value}\r\n" for name, value in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + _CRLF + block + _CRLF + _CRLF


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields (names in lower case) and block of one record."""
    head, _, rest = data.partition(_CRLF + _CRLF)
    fields = _fields(head)
    return fields, rest[: int(fields["content-length"])]


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an uncompressed WARC stream, whole, one after the other."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        at = 0
        while True:
            head = held.find(_CRLF + _CRLF, at)
            if head < 0:
                break
            end = head + 4 + int(_fields(bytes(held[at:head]))["content-length"]) + 4
            if end > len(held):
                break
            yield bytes(held[at:end])
            at = end
        del held[:at]
    if held.strip():
        raise ValueError("the archive ends inside a record")


def inflate(source) -> Iterator[bytes]:
    """Inflate a gzip file piece by piece; members follow each other."""
    opened = zlib.decompressobj(31)
    while data := source.read(CHUNK):
        while data:
            yield opened.decompress(data, CHUNK)
            while opened.unconsumed_tail and not opened.eof:
                yield opened.decompress(opened.unconsumed_tail, CHUNK)
            data = opened.unused_data
            if opened.eof:
                opened = zlib.decompressobj(31)
            else:
                break


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def normalise(source, out) -> Iterator[dict]:
    """Rewrite the archive ``source`` to ``out`` record by record; the index entries."""
    at = 0
    for data in records(inflate(source)):
        packed = member(data)
        out.write(packed)
        fields = _fields(data[: data.find(_CRLF + _CRLF)])
        yield {
            "offset": at,
            "length": len(packed),
            "type": fields.get("warc-type", ""),
            "id": fields.get("warc-record-id", ""),
            "target": fields.get("warc-target-uri", ""),
            "digest": fields.get("warc-payload-digest", ""),
        }
        at += len(packed)


# -- Spark: write, normalise, read ------------------------------------------------------------------


def decided(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest (SHA-1), refers_to: null for responses.

    Of pages with equal payloads of at least 1000 bytes the largest page_id is the response. Only
    digests are grouped; payloads are joined to the few digests that repeat.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    long_ = F.length("payload") >= LEAST_REVISIT
    repeated = rows.where(long_).groupBy("digest").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n"))
    repeated = stored(repeated.where("n > 1").select("digest", "response"))
    joined = rows.join(repeated, "digest", "left")
    other = F.col("page_id").isNull() | (F.col("page_id") < F.col("response"))
    return joined.select("page_id", "url", "payload", "digest", F.when(other, F.col("response")).alias("refers_to"))


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}')}>"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A page as response, or as revisit of the page ``refers_to``: HTTP head without the payload.

    Line breaks in a url would end the field; they are left out of the target.
    """
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", "".join((url or "").splitlines())),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if page_id is not None:
        fields.append(("WARC-Page-ID", str(page_id)))
    if refers_to is not None:
        fields += [
            ("WARC-Profile", _PROFILE),
            ("WARC-Refers-To", _record_id(refers_to, digest)),
            ("WARC-Refers-To-Page-ID", str(refers_to)),
        ]
    return record(fields, http if refers_to is not None else http + payload)


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write one archive per task, each a single gzip stream, as crawlers do: file, n_records."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = open_folder(folder)
        name = f"{TaskContext.get().partitionId():06d}.warc.gz"
        count = 0

        def write(out) -> None:
            nonlocal count
            packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            info = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(None, name)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Filename", name)], b"")
            out.write(packer.compress(info))
            for batch in batches:
                for piece in slices(batch, "payload"):
                    for row in zip(*(piece.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                        out.write(packer.compress(page_record(*row)))
                        count += 1
            out.write(packer.flush())

        publish(fs, f"{base}/{name}", write)
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count])], names=["file", "n_records"])

    return stored(rows.mapInArrow(of, "file string, n_records long"))


def normalise_archives(files: DataFrame, source: str, target: str) -> DataFrame:
    """Normalise each archive ``file`` from folder to folder, with its sidecar; file, n_records."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from_fs, from_base = open_folder(source)
        fs, base = open_folder(target)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                lines = 0

                def write(out, name=name) -> None:
                    nonlocal lines

                    def index(side) -> None:
                        nonlocal lines
                        with from_fs.open_input_stream(f"{from_base}/{name}", compression=None) as archive:
                            for entry in normalise(archive, out):
                                side.write((json.dumps({"file": name, **entry}) + "\n").encode())
                                lines += 1

                    publish(fs, f"{base}/{name}.index", index)

                publish(fs, f"{base}/{name}", write)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([lines])], names=["file", "n_records"])

    return stored(files.select("file").repartition(max(1, files.count())).mapInArrow(of, "file string, n_records long"))


def read_index(spark, folder: str) -> DataFrame:
    """All sidecar entries: file, offset, length, type, id, target, digest."""
    schema = "file string, offset long, length long, type string, id string, target string, digest string"
    return spark.read.schema(schema).json(f"{folder}/*.index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records at the places of ``index``: fields (lower-case names) and block, each read by itself."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_folder(folder)
        name, opened = None, None
        for batch in batches:
            heads, blocks, filled = [], [], 0
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if file != name:
                    name, opened = file, fs.open_input_file(f"{base}/{file}")
                fields, block = parse(zlib.decompress(opened.read_at(length, offset), 31))
                heads.append(list(fields.items()))
                blocks.append(block)
                filled += len(block)
                if filled > CHUNK * 16:
                    yield _rows(heads, blocks)
                    heads, blocks, filled = [], [], 0
            yield _rows(heads, blocks)

    def _rows(heads, blocks) -> pa.RecordBatch:
        fields = pa.array(heads, pa.map_(pa.string(), pa.string()))
        return pa.RecordBatch.from_arrays([fields, pa.array(blocks, pa.binary())], names=["fields", "block"])

    return index.select("file", "offset", "length").mapInArrow(of, "fields map<string,string>, block binary")


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives, normalise them, and read them back by index.

    Per page: page_id, payload_bytes, payload_digest, record_type, refers_to. A response's length and
    digest are taken from its block, a revisit's from its HTTP head and digest field. A null html is an
    empty payload, a null url an empty target. Repeated rows of the largest page_id are responses each; a
    null page_id revisits any page with its payload that has an id. Other columns are not read.
    """
    spark = pages.sparkSession
    raw, folder = files_folder(spark), files_folder(spark)
    rows = decided(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"))
    archives = write_archives(rows, raw)
    if normalise_archives(archives, raw, folder).isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    read = read_records(read_index(spark, folder).where("type in ('response', 'revisit')"), folder)
    # The HTTP head ends at the first blank line.
    head_bytes = F.locate("\r\n\r\n", F.col("block").cast("string")) + 3
    payload = F.expr("substring(block, head_bytes + 1)")
    said = F.regexp_extract(F.expr("cast(substring(block, 1, head_bytes) as string)"), r"Content-Length: (\d+)", 1).cast("long")
    response = F.col("record_type") == "response"
    read = read.select(
        "block",
        F.col("fields")["warc-page-id"].cast("long").alias("page_id"),
        F.col("fields")["warc-type"].alias("record_type"),
        F.col("fields")["warc-refers-to-page-id"].cast("long").alias("refers_to"),
        F.col("fields")["warc-payload-digest"].alias("digest"),
        head_bytes.alias("head_bytes"),
    )
    return read.select(
        "page_id",
        F.when(response, F.length(payload)).otherwise(said).cast("long").alias("payload_bytes"),
        F.when(response, F.sha1(payload)).otherwise(F.substring_index("digest", ":", -1)).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
