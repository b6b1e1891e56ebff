"""WARC archives: writer, monolithic-gzip normaliser, offset index, reader.

A *monolithic* archive is one gzip stream over all its records, so no record can
be read without inflating everything before it.  ``normalise`` inflates such a
stream once, rewrites every record as a gzip member of its own and reports where
each member lies; the sidecar index then allows any record to be read alone.
Both directions stream: memory is bounded by the largest record.

Payloads that occur more than once (100 bytes or more) are stored once: the
record of the smallest page_id is the response, the others are revisits that
name it.  Revisits carry no payload but its length and digest, and the page whose
record they refer to; after reading, these are held against that record.

Record ids are URNs of the archive's name and the record's place in it, so repeated
page_ids have ids of their own; the page_id is a header of its own.

Skew: grouping shuffles digests and ids only, with partial minima.  Tables of shared
digests are broadcast when their measured size is within a bound, else joined by
shuffle, where adaptive execution splits a hot digest.

Lost executors: each attempt writes under a name of its own and only names that a
finished task returned are read, so a repeated task leaves unread files at most.

Defined cases: a null html is an empty payload; a null page_id is stored as
``null`` and never is a revisit's target unless no id exists; rows that repeat the
smallest page_id are all responses; payloads of exactly 100 bytes are shared; an empty
table writes no archive and gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.arrow_groups import lean
from lodestrata.llm.files import prepare, resolve, spread, unique
from lodestrata.storage import materialise, scratch_path, sized

SHARED_BYTES = 100
#: Date of the records unless the caller gives one (a repeated run writes equal bytes).
DATE = "2024-01-01T00:00:00Z"
READ = 1 << 20
_END = b"\r\n\r\n"


def record(kind: str, record_id: str, page_id, url, digest: str, length: int, refers_to, payload: bytes, date: str = DATE) -> bytes:
    """One WARC/1.1 record, headers and block."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), ' ').replace(chr(10), ' ')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-X-Payload-Length: {length}",
        f"WARC-X-Page-ID: {'null' if page_id is None else page_id}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(payload)}",
    ]
    if kind == "revisit":
        lines.append(f"WARC-X-Refers-To-Page: {refers_to}")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(lines).encode() + _END + payload + _END


def inflate(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """The bytes of a gzip stream of one or many members."""
    engine = zlib.decompressobj(31)
    while chunk := read(READ):
        while chunk:
            out = engine.decompress(chunk, READ)
            if out:
                yield out
            if engine.eof:
                chunk = engine.unused_data
                engine = zlib.decompressobj(31)
            else:
                chunk = engine.unconsumed_tail
    out = engine.flush()
    if out:
        yield out


def records(blocks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, payload, whole record) of each record in a stream of blocks."""
    held = bytearray()
    blocks = iter(blocks)

    def fill(size: int) -> bool:
        while len(held) < size:
            block = next(blocks, None)
            if block is None:
                return False
            held.extend(block)
        return True

    while True:
        searched = 0
        while (at := held.find(_END, searched)) < 0:
            searched = max(0, len(held) - 3)
            if not fill(len(held) + 1):
                if held.strip():
                    raise ValueError("archive ends inside a record head")
                return
        head = dict(line.split(": ", 1) for line in held[:at].decode().split("\r\n")[1:] if ": " in line)
        begin = at + len(_END)
        size = begin + int(head["Content-Length"])
        if not fill(size + len(_END)):
            raise ValueError("archive ends inside a record")
        payload, whole = bytes(held[begin:size]), bytes(held[: size + len(_END)])
        del held[: size + len(_END)]
        yield head, payload, whole


def normalise(read: Callable[[int], bytes], write: Callable[[bytes], object], level: int = 6) -> Iterator[tuple[str, str, int, int]]:
    """Rewrite a monolithic stream record by record; yields (record id, type, offset, length)."""
    offset = 0
    for head, _, whole in records(inflate(read)):
        engine = zlib.compressobj(level, zlib.DEFLATED, 31)
        member = engine.compress(whole) + engine.flush()
        write(member)
        yield head["WARC-Record-ID"], head["WARC-Type"], offset, len(member)
        offset += len(member)


def read_record(source, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record through its index entry, without the rest of the archive."""
    source.seek(offset)
    head, payload, _ = next(records(iter([zlib.decompress(source.read(length), 31)])))
    return head, payload


def with_decisions(pages: DataFrame) -> DataFrame:
    """Add payload digest, length, record_type and refers_to to page_id, url, html."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    base = pages.select("page_id", "url", "html", F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("payload_bytes"))
    shared = materialise(
        base.where(F.col("payload_bytes") >= SHARED_BYTES).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n"),
        "shared-digests",
    )
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return base.join(sized(shared), "digest", "left").select(
        "page_id", "url", "html", "digest", "payload_bytes",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"),
    )


def _monolithic_writer(folder: str, level: int, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, out, engine, count = "", None, None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    target = unique(folder, ".warc.gz")
                    system, path = resolve(target)
                    out, engine = system.open_output_stream(path, compression=None), zlib.compressobj(level, zlib.DEFLATED, 31)
                payload = b"" if row["record_type"] == "revisit" else (row["html"] or "").encode()
                name = f"urn:archive:{target.rsplit('/', 1)[-1].removesuffix('.warc.gz')}:{count}"
                out.write(engine.compress(record(row["record_type"], name, row["page_id"], row["url"], row["digest"], row["payload_bytes"], row["refers_to"], payload, date)))
                count += 1
        if out is not None:
            out.write(engine.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [target], "records": pa.array([count], pa.int64())})
    return write


def _normaliser(folder: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column("archive").to_pylist():
                target = unique(folder, ".warc.gz")
                system, path = resolve(source)
                out_system, out_path = resolve(target)
                index = target.removesuffix(".warc.gz") + ".idx"
                _, index_path = resolve(index)
                count = 0
                with system.open_input_stream(path, compression=None) as read, out_system.open_output_stream(out_path, compression=None) as out, out_system.open_output_stream(index_path, compression=None) as side:
                    for name, kind, offset, length in normalise(read.read, out.write, level):
                        side.write(f"{offset}\t{length}\t{kind}\t{name}\n".encode())
                        count += 1
                yield pa.RecordBatch.from_pydict({"source": [source], "archive": [target], "index": [index], "records": pa.array([count], pa.int64())})
    return run


def _page(name: str | None) -> int | None:
    return None if name in (None, "null") else int(name)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
    ])
    for batch in batches:
        for archive, index in zip(batch.column("archive").to_pylist(), batch.column("index").to_pylist()):
            system, path = resolve(archive)
            _, index_path = resolve(index)
            rows: list[tuple] = []
            with system.open_input_stream(index_path, compression=None) as side, system.open_input_file(path) as source:
                for line in _lines(side):
                    offset, length, _, _ = line.split("\t")
                    head, payload = read_record(source, int(offset), int(length))
                    kind = head["WARC-Type"]
                    digest, size = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["WARC-X-Payload-Length"])
                    if kind == "response":
                        digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
                    rows.append((_page(head["WARC-X-Page-ID"]), head["WARC-Target-URI"], size, digest, kind, _page(head.get("WARC-X-Refers-To-Page")), archive, int(offset), int(length)))
                    if len(rows) >= 5_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _lines(stream) -> Iterator[str]:
    rest = b""
    while chunk := stream.read(READ):
        *whole, rest = (rest + chunk).split(b"\n")
        yield from (x.decode() for x in whole)
    if rest:
        yield rest.decode()


def write_archives(pages: DataFrame, folder: str, level: int = 1, date: str = DATE) -> DataFrame:
    """One monolithic archive per task; the manifest (archive, records)."""
    prepare(folder)
    return materialise(with_decisions(pages).mapInArrow(lean(_monolithic_writer(folder, level, date)), "archive string, records bigint"), "archives")


def normalise_archives(manifest: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Each archive rewritten with one member per record and an index beside it."""
    prepare(folder)
    files = manifest.count()
    return materialise(
        spread(manifest.sparkSession, manifest, files).mapInArrow(lean(_normaliser(folder, level)), "source string, archive string, index string, records bigint"),
        "normalised",
    )


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of normalised archives, each read through its index entry."""
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, archive string, offset bigint, length bigint"
    return spread(manifest.sparkSession, manifest, manifest.count()).mapInArrow(lean(_reader), schema)


def checked(records: DataFrame) -> DataFrame:
    """``records`` (a materialised table), of which each revisit must have the digest and length of a response of the page it refers to."""
    keys = ["refers_to", "payload_digest", "payload_bytes"]
    stored = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes")
    named = records.where("record_type = 'revisit'").select(*keys).distinct()
    found = materialise(stored.distinct().join(named, keys, "left_semi").withColumn("stored", F.lit(True)), "referred-to")
    out = records.join(sized(found), keys, "left")
    wrong = (F.col("record_type") == "revisit") & F.col("stored").isNull()
    said = F.concat(F.lit("a revisit of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(" differs from the record it refers to"))
    return out.withColumn("payload_digest", F.when(wrong, F.raise_error(said)).otherwise(F.col("payload_digest"))).select(*records.columns)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write, normalise and read back all pages; the monolithic files go once rewritten."""
    from lodestrata.storage import delete_path

    spark = pages.sparkSession
    raw, final = scratch_path(spark, "warc-raw"), scratch_path(spark, "warc")
    written = write_archives(pages, raw)
    normal = normalise_archives(written, final)
    delete_path(spark, raw)
    return checked(materialise(read_archives(normal), "warc-records"))
