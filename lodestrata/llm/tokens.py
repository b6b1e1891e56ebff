"""Token ids in Parquet: encoder, file format, selective reads.

Encoding.  Texts are encoded in slices of SLICE_BYTES.  A tokenizer whose normaliser
and pre-tokenizer are exactly the known ones (``_BLANK_FREE``) drops white space and
treats the stretches between as independent, so a text's ids are the ids of its
blank-separated chunks in order: a slice is split and its chunks are made distinct by
Arrow, distinct chunks of ASCII and Latin-1 letters, digits and ASCII signs
are cut into pieces (letters, one digit, other signs) whose distinct ones go to the
tokenizer's model, all other chunks go through the whole tokenizer, and the ids are
gathered by numpy.  With any other tokenizer every whole text goes through
the library.

Format.  Files hold contiguous doc_id ranges in ascending order, rows sorted.
Columns: doc_id and n_tokens (delta encoding), start_in_file (delta), ids (list,
dictionary encoding).  Row groups close at ROW_GROUP_TOKENS tokens, pages at
PAGE_BYTES, and page indexes are written, so a reader can fetch the metadata
without ids, or the ids of a few documents without their neighbours.

Lost executors: each attempt writes a file under a name of its own, and only names
that a finished task returned are read.

Defined cases: a null or empty text is the end id alone; null ids sort first;
repeated ids are ordered by text hash; an empty table writes no file and gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.arrow_groups import lean, slices
from lodestrata.llm.files import prepare, resolve, unique
from lodestrata.storage import materialise, scratch_path

END_ID = 1
ROW_GROUP_TOKENS = 1_000_000
PAGE_BYTES = 64 * 1024
#: Bytes of text that are encoded at once (a longer text is a slice of its own).
SLICE_BYTES = 2 << 20
#: Distinct pieces and chunks whose ids a task remembers (and those of one slice besides).
REMEMBERED = 150_000
#: The normaliser and pre-tokenizer under which blank-separated chunks are independent.
_BLANK_FREE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}

#: Class of each byte for cutting pieces: 1 letter, 2 digit, 0 another sign, 9 none of these.
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = _CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
# Controls, the apostrophe of contractions, a sign of special tokens and bytes of other characters.
_CLASS[:0x20] = _CLASS[0x7F:] = _CLASS[ord("'")] = _CLASS[ord("|")] = 9
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of each byte of a UTF-8 string; Latin-1 letters count as letters."""
    kind, lower = _CLASS[data], _LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, np.int64)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # the signs of multiplication and division
    kind[lead] = kind[lead + 1] = 1
    capital = lead[data[lead + 1] <= 0x9E] + 1
    lower[capital] += 32
    return kind, lower


def _byte_letters() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, others follow from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def gather(flat: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs flat[first : first + count], one after the other."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(first - (ends - count), count) + np.arange(total)]


class Encoder:
    """Ids of whole texts by one tokenizer file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or not {"<", "|"} <= set(t["content"]) or re.search(r"\s", t["content"]) for t in rules["added_tokens"])
        self.by_chunk = plain and all(rules[k] == v for k, v in _BLANK_FREE.items())
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.known: dict[str, bytes] = {}

    def forget(self) -> None:
        """Drop the remembered ids; a worker outlives its task."""
        self.known = {}

    def ids(self, text: str) -> array:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> array:
        """Ids of a cut piece, which is in lower case and a stretch of the pre-tokenizer already."""
        spelled = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
        return array("I", [t.id for t in self.model.tokenize(spelled)])

    def _distinct(self, texts: list[str], encode: Callable[[str], array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct strings, one after the other, and first place and count of each."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        found = list(map(known.get, texts))
        for i, ids in enumerate(found):
            if ids is None:
                found[i] = known[texts[i]] = encode(texts[i]).tobytes()
        count = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return np.frombuffer(b"".join(found), np.uint32), np.cumsum(count) - count, count

    def _chunks(self, chunks: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct chunks without blanks, one after the other, and first place and count of each."""
        offsets = np.frombuffer(chunks.buffers()[1], np.int64)[chunks.offset : chunks.offset + len(chunks) + 1]
        data = np.frombuffer(chunks.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        kind, lower = _classes(data)
        strange = np.concatenate(([0], np.cumsum(kind == 9)))
        simple = strange[offsets[1:]] == strange[offsets[:-1]]
        # Pieces of the simple chunks: one begins with each chunk, each digit and each change of class.
        sizes = np.diff(offsets)
        kept = np.repeat(simple, sizes)
        kind, lower, sizes = kind[kept], lower[kept], sizes[simple]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        begins = np.ones(len(lower) + 1, bool)
        begins[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        begins[ends] = True
        edges = np.flatnonzero(begins)
        every = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(lower)).dictionary_encode()
        flat, first, count = self._distinct(every.dictionary.to_pylist(), self._piece)
        piece = every.indices.to_numpy()
        flat = gather(flat, first[piece], count[piece])
        at = np.concatenate(([0], np.cumsum(count[piece])))[np.searchsorted(edges, ends)]
        # All other chunks go through the tokenizer.
        other, other_first, other_count = self._distinct(chunks.filter(pa.array(~simple)).to_pylist(), self.ids)
        first, count = np.empty(len(chunks), np.int64), np.empty(len(chunks), np.int64)
        first[simple], count[simple] = at[:-1], np.diff(at)
        first[~simple], count[~simple] = len(flat) + other_first, other_count
        return np.concatenate([flat, other]), first, count

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a slice of texts, each with the end id, and the places where texts begin and end."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.by_chunk:
            flat, first, count = self._whole(texts)
            ends = np.cumsum(count + 1)
            out = np.full(int(ends[-1]) if len(ends) else 0, END_ID, "<u4")
            inside = np.ones(len(out), bool)
            inside[ends - 1] = False
            out[inside] = flat
            return out, np.concatenate(([0], ends))
        split = pc.ascii_split_whitespace(texts)
        bounds = split.offsets.to_numpy()
        every = split.flatten().dictionary_encode()
        flat, first, count = self._chunks(every.dictionary.cast(pa.large_string()))
        flat, first, count = np.append(flat, np.uint32(END_ID)), np.append(first, len(flat)), np.append(count, 1)
        places = np.insert(every.indices.to_numpy().astype(np.int64), bounds[1:] - bounds[0], len(first) - 1)
        counts = count[places]
        out = gather(flat, first[places], counts).astype("<u4", copy=False)
        ends = np.concatenate(([0], np.cumsum(counts)))[bounds - bounds[0] + np.arange(len(bounds))]
        return out, ends

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [self.ids(t.as_py()) for t in texts]
        count = np.fromiter(map(len, found), np.int64, len(found))
        return np.frombuffer(b"".join(found), np.uint32), np.cumsum(count) - count, count

    def column(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text with the end id, little-endian unsigned 32-bit."""
        for _, texts in slices(column, SLICE_BYTES):
            ids, bounds = self.encode(texts)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                yield ids[a:b]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file; it lives as long as the worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class TokenFile:
    """Writer of one token file."""

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("start_in_file", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def __init__(self, target: str) -> None:
        system, path = resolve(target)
        self.out = system.open_output_stream(path)
        self.writer = pq.ParquetWriter(
            self.out, self.schema, compression="zstd", use_dictionary=["ids.list.element"],
            column_encoding={"doc_id": "DELTA_BINARY_PACKED", "n_tokens": "DELTA_BINARY_PACKED", "start_in_file": "DELTA_BINARY_PACKED"},
            data_page_size=PAGE_BYTES, write_page_index=True, write_statistics=True,
        )
        self.rows: tuple[list, list, list] = ([], [], [])
        self.held = self.tokens = self.documents = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        for column, value in zip(self.rows, (doc_id, self.tokens, ids)):
            column.append(value)
        self.tokens += len(ids)
        self.held += len(ids)
        self.documents += 1
        if self.held >= ROW_GROUP_TOKENS:
            self.flush()

    def flush(self) -> None:
        ids_of, starts, ids = self.rows
        if not ids_of:
            return
        sizes = np.array([len(x) for x in ids], np.int64)
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
        flat = pa.array(np.concatenate(ids).view(np.int32), pa.int32())
        table = pa.table([pa.array(ids_of, pa.int64()), pa.array(sizes), pa.array(starts, pa.int64()), pa.ListArray.from_arrays(offsets, flat)], schema=self.schema)
        self.writer.write_table(table, row_group_size=len(ids_of))
        self.rows, self.held = ([], [], []), 0

    def close(self) -> None:
        self.flush()
        self.writer.close()
        self.out.close()


def _file_writer(folder: str, path: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, file, target, least = encoder(path), None, "", None
        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode.column(batch.column("text"))):
                if file is None:
                    target = unique(folder, ".parquet")
                    file = TokenFile(target)
                if least is None:
                    least = doc_id
                file.add(doc_id, ids)
        encode.forget()
        if file is not None:
            file.close()
            yield pa.RecordBatch.from_pydict({"file": [target], "least": pa.array([least], pa.int64()), "documents": pa.array([file.documents], pa.int64()), "tokens": pa.array([file.tokens], pa.int64())})
    return write


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Encode all documents; the manifest (file, least, documents, tokens, start), a row per file."""
    prepare(folder)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ranged = base.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    files = materialise(ranged.mapInArrow(lean(_file_writer(folder, tokenizer)), "file string, least bigint, documents bigint, tokens bigint"), "token-files")
    # A row per file: the only rows that one task sees together.
    before = Window.orderBy(F.col("least").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return materialise(files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))), "token-manifest")


def read_tokens(manifest: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows of the token files with ``start``, the ids of all documents before them.

    Spark prunes columns and skips row groups and pages by their statistics, so a
    filter on doc_id, or a read without ids, touches only what it needs.
    """
    spark = manifest.sparkSession
    names = [r[0] for r in manifest.select("file").collect()]  # a name per file
    schema = "doc_id bigint, n_tokens bigint, start_in_file bigint, ids array<int>"
    if not names:
        return spark.createDataFrame([], schema).withColumn("start", F.lit(0).cast("long"))
    rows = spark.read.schema(schema).parquet(*names)
    last = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    bases = manifest.select(F.element_at(F.split("file", "/"), -1).alias("__file"), F.col("start").alias("__base"))
    rows = rows.withColumn("__file", last).join(F.broadcast(bases), "__file")
    rows = rows.withColumn("start", F.col("__base") + F.col("start_in_file")).drop("__file", "__base")
    return rows.select(*columns) if columns else rows


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        flat = ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
        offsets = ids.offsets.to_numpy()
        sums = [zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write all documents in the token format, read them back and describe their ids."""
    folder = scratch_path(docs.sparkSession, "tokens")
    rows = read_tokens(write_tokens(docs, folder, tokenizer), ["doc_id", "start", "n_tokens", "ids"])
    return rows.mapInArrow(lean(_checksums), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
