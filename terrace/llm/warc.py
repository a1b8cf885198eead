"""WARC archives: a writer, a normaliser of monolithic gzip files with a sidecar offset index, and a reader.

* ``write_archives`` writes each partition as one .warc.gz that is a single gzip stream (the monolithic form).
  A record whose payload another one has already is a revisit without a body.
* ``normalise`` inflates each such file once, as a stream, rewrites every record as a gzip member of its own and
  writes ``<file>.idx`` with a line for each record: its id, the offset and the length of its member.
* ``read_archives`` reads records by the index, in blocks of members, so one large archive is read by many tasks.

Files go to a folder that all executors share. Each task writes under a name of its own attempt and renames at the
end, so a task that is run again replaces its file. Folders may be local (file:) or any store pyarrow knows.

Defined cases: null payload is empty; a null url is written as ``urn:none``; payloads under ``least`` bytes are
never revisits; repeated rows are
responses both, for neither has the smaller id; a null page_id with a repeated payload is a response; an empty table
writes no archive; a long payload is one record; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from io import BufferedReader
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, cut, shared_dir, utf8

_GZIP = 31  # zlib window bits for gzip members
_CHUNK = 1 << 20


def _store(uri: str):
    """(file system, path) of a URI."""
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(urlparse(uri).path)
    return fs.FileSystem.from_uri(uri)


# --- records -----------------------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; the payload's size and digest are stated also where a revisit leaves it out."""
    body = b"" if refers_to is not None else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {'urn:none' if url is None else url.encode('unicode_escape').decode()}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def inflate(file: BufferedReader) -> Iterator[bytes]:
    """The bytes of a gzip file of any number of members, a chunk at a time."""
    engine = zlib.decompressobj(_GZIP)
    while block := file.read(_CHUNK):
        while block:
            data = engine.decompress(block, 4 * _CHUNK)
            if data:
                yield data
            if engine.eof:
                block, engine = engine.unused_data, zlib.decompressobj(_GZIP)
            else:
                block = engine.unconsumed_tail


def split_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(head, whole record) of each record of an inflated stream; holds one record at a time."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        at = 0
        while (end := held.find(b"\r\n\r\n", at)) >= 0:
            head = parse_head(bytes(held[at:end]))
            stop = end + 8 + int(head["content-length"])
            if len(held) < stop:
                break
            yield head, bytes(held[at:stop])
            at = stop
        del held[:at]
    if held:
        raise ValueError("the archive ends inside a record")


# --- tasks -------------------------------------------------------------------------------------------


def _write(folder: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        name, engine, count = f"part-{TaskContext.get().partitionId():06d}.warc.gz", zlib.compressobj(level, zlib.DEFLATED, _GZIP), 0
        held = f"{root}/.{name}-{uuid.uuid4().hex}"
        with store.open_output_stream(held, compression=None) as out:
            for b in batches:
                rows = zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), utf8(b.column("payload")), b.column("digest").to_pylist(), b.column("refers_to").to_pylist(), strict=True)
                for row in rows:
                    out.write(engine.compress(record(*row)))
                    count += 1
            out.write(engine.flush())
        if count:
            store.move(held, f"{root}/{name}")
            yield batch({"file": ([name], pa.string()), "records": ([count], pa.int64())})
        else:
            store.delete_file(held)

    return run


def _normalise(source: str, target: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (store, root), (sink, out_root) = _store(source), _store(target)
        for b in batches:
            for name in b.column("file").to_pylist():
                tag, offset, ids, offsets, lengths = uuid.uuid4().hex, 0, [], [], []
                with store.open_input_stream(f"{root}/{name}", compression=None) as file, sink.open_output_stream(f"{out_root}/.{name}-{tag}", compression=None) as out:
                    for head, whole in split_records(inflate(file)):
                        engine = zlib.compressobj(level, zlib.DEFLATED, _GZIP)
                        member = engine.compress(whole) + engine.flush()
                        out.write(member)
                        ids.append(head["warc-record-id"])
                        offsets.append(offset)
                        lengths.append(len(member))
                        offset += len(member)
                with sink.open_output_stream(f"{out_root}/.{name}.idx-{tag}", compression=None) as out:
                    out.write("".join(f"{i}\t{o}\t{n}\n" for i, o, n in zip(ids, offsets, lengths, strict=True)).encode())
                sink.move(f"{out_root}/.{name}-{tag}", f"{out_root}/{name}")
                sink.move(f"{out_root}/.{name}.idx-{tag}", f"{out_root}/{name}.idx")
                yield batch({"file": ([name], pa.string()), "records": ([len(ids)], pa.int64())})

    return run


def _index(folder: str, block: int):
    """Blocks of neighbouring members of about ``block`` bytes: (file, offset, lengths of the members)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for b in batches:
            for name in b.column("file").to_pylist():
                starts, members = [], []
                with store.open_input_stream(f"{root}/{name}.idx", compression=None) as file:
                    for line in file.read().decode().splitlines():
                        _, offset, length = line.split("\t")
                        if not starts or int(offset) - starts[-1] >= block:
                            starts.append(int(offset))
                            members.append([])
                        members[-1].append(int(length))
                yield batch({"file": ([name] * len(starts), pa.string()), "offset": (starts, pa.int64()), "lengths": (members, pa.list_(pa.int64()))})

    return run


_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _id(value: str | None) -> int | None:
    digits = (value or "")[len("<urn:page:") : -1]
    return int(digits) if digits else None


def _read(folder: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for b in batches:
            for name, offset, lengths in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "lengths")), strict=True):
                out, payloads, at = [], [], 0
                with store.open_input_file(f"{root}/{name}") as file:
                    data = memoryview(file.read_at(sum(lengths), offset))
                for length in lengths:  # a member for each record
                    whole = zlib.decompress(data[at : at + length], _GZIP)
                    at += length
                    cut = whole.index(b"\r\n\r\n")
                    head = parse_head(whole[:cut])
                    payload = whole[cut + 4 : cut + 4 + int(head["content-length"])]
                    refers_to = _id(head.get("warc-refers-to"))
                    size, digest = int(head["x-payload-length"]), head["warc-payload-digest"].removeprefix("sha256:")
                    if head["warc-type"] == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
                        raise ValueError(f"{name}: the payload at {offset} is not what its head states")
                    out.append((_id(head["warc-record-id"]), size, digest, head["warc-type"], refers_to))
                    payloads.append(payload if refers_to is None else None)
                names, kinds = [x.split()[0] for x in _RECORD.split(", ")], (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                columns = {n: (list(v), t) for n, v, t in zip(names, zip(*out, strict=True), kinds, strict=True)}
                yield batch(columns | ({"payload": (payloads, pa.binary())} if with_payload else {}))

    return run


# --- operators ---------------------------------------------------------------------------------------


def with_revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is null for responses.

    The first of each payload is found on (digest, page_id) alone, pre-aggregated; payloads are shuffled once.
    """
    payload = F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    pages = pages.withColumn("digest", F.sha2("payload", 256))
    first = pages.where(F.length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("c")).where("c > 1")
    # short payloads meet no other, so they do not go to one place by their common digest
    key = F.when(F.length("payload") >= least, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    pages = pages.withColumn("key", key).join(first.select(F.col("digest").alias("key"), "first_id"), "key", "left")
    return pages.select("page_id", "url", "payload", "digest", F.when(F.col("page_id") > F.col("first_id"), F.col("first_id")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Write one monolithic .warc.gz per partition of ``with_revisits``; (file, records)."""
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    return pages.mapInArrow(_write(folder, level), "file string, records long")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a written table that stand for much work each, dealt evenly: one to a task, more from 10,000 rows on."""
    n = rows.count()
    return rows.repartition(max(1, -(-n // (1 + n // 10_000))))


def normalise(files: DataFrame, source: str, target: str, level: int = 6) -> DataFrame:
    """Rewrite the named archives of ``source`` as one member per record, each with a sidecar index."""
    store, root = _store(target)
    store.create_dir(root, recursive=True)
    return files.select("file").mapInArrow(_normalise(source, target, level), "file string, records long")


def read_archives(files: DataFrame, folder: str, with_payload: bool = False, block: int = 8 << 20) -> DataFrame:
    """The records of the named archives by their indexes."""
    blocks = cut(spread(files.select("file")).mapInArrow(_index(folder, block), "file string, offset long, lengths array<long>"))
    return spread(blocks).mapInArrow(_read(folder, with_payload), _RECORD + ", payload binary" * with_payload)


def round_trip(pages: DataFrame, least: int = 100) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as archives, normalise them and read them back."""
    spark = pages.sparkSession
    base = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    marked = with_revisits(pages, least)
    written = write_archives(marked, f"{base}/raw").select("file", "records")
    written = cut(written)
    done = cut(normalise(spread(written), f"{base}/raw", f"{base}/records"))
    return read_archives(done, f"{base}/records")
