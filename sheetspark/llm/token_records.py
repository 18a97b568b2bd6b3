"""Token ids in length-delimited binary records, with an offset index for shuffled reads.

A shard is two files. The record file holds one frame a document::

    uint64 length | uint32 masked crc of the length | payload | uint32 masked crc of the payload

with the payload ``int64 doc_id, uint8 flags, ids``. Ids take two bytes where the
vocabulary has at most 65,536 entries, otherwise four (flag 2); flag 1 marks a
null doc_id. Numbers are little-endian. A checksum is CRC-32 as zlib computes it,
rotated right by 15 bits and shifted by a constant, so that a checksum of data
that hold checksums is sound. The index file has ``int64 doc_id, uint64 offset,
uint64 tokens`` for each frame, so a reader can take records in any order with a
seek for each one.

Files carry the attempt in their names and count only when the manifest lists
them. The manifest is a Parquet table that Spark's committer publishes, so a lost
executor or a second attempt leaves stray files that nobody reads.

Results at the edges: a null or empty text is one end id; null doc_ids come
first; equal doc_ids are ordered by text; a very long text is one record; an empty
table gives an empty manifest and no records; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheetspark.llm.common import small_batches, texts_of

MASK_DELTA = 0xA282EAD8
HEAD = struct.Struct("<QI")
ROW = struct.Struct("<qB")
TAIL = struct.Struct("<I")
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("tokens", "<u8")])
NULL_ID, WIDE = 1, 2
FLUSH = 8 << 20

#: A word of letters below U+0250, none of which NFC changes, without the one letter whose lower case is two.
LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+").fullmatch

MANIFEST = "shard long, data string, index string, n_docs long, n_tokens long, n_bytes long, index_crc long"
RECORDS = "doc_id long, start long, n_tokens long, ids array<int>"


class CorruptRecord(ValueError):
    """A frame or an index whose lengths or checksums don't hold."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, TAIL.pack(masked(length)), payload, TAIL.pack(masked(payload))))


def unframe(data, at: int = 0) -> tuple[bytes, int]:
    """The payload of the frame at ``at`` and the place after it; raises where a checksum fails."""
    length, check = HEAD.unpack_from(data, at)
    if masked(bytes(data[at : at + 8])) != check:
        raise CorruptRecord("length")
    start = at + HEAD.size
    payload = bytes(data[start : start + length])
    if len(payload) != length or masked(payload) != TAIL.unpack_from(data, start + length)[0]:
        raise CorruptRecord("payload")
    return payload, start + length + TAIL.size


@cache
def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies.

    Printing characters of Latin-1 stand for themselves; the others, in order, for
    those from code point 256 on.
    """
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


#: The parts, as a file describes them, by which the ids of a text are those of its pieces.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PRETOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def can_be_cut(description: dict) -> bool:
    """Whether a tokenizer file has these parts, a plain BPE model, and no added token that blanks matter to."""
    normalizer, pre, model = (description.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
    if normalizer.get("normalizers") != NORMALIZERS or pre.get("pretokenizers") != PRETOKENIZERS:
        return False
    if model.get("type") != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("unk_token"):
        return False
    added = description.get("added_tokens") or []
    return not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(map(str.isspace, t["content"])) for t in added)


class ChunkEncoder(dict):
    """The ids, packed, of a piece of text between blanks, by the tokenizers library.

    Its pre-tokeniser drops white space and no token of it spans any, so a text's
    ids are those of its pieces in order. Pieces repeat, so most are looked up. Of
    the rest, words of Latin letters are normalised here (lower case is all that
    happens to them) and go to the library's model at once, one full stop or comma
    behind a word apart; whatever else there is goes through the whole library.
    All that holds for tokenizers of one make, so the file is read for it: of any
    other, each text goes to the library as it is (``whole``).
    The memory is emptied when it holds ``limit`` pieces, or 32 characters for each of as many.
    """

    def __init__(self, path: str, limit: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as file:
            self.whole = not can_be_cut(json.load(file))
        self.limit, self.held = limit, 0
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.code = "I" if self.wide else "H"

    def __missing__(self, piece: str) -> bytes:
        self.held += len(piece)
        if len(self) >= self.limit or self.held >= 32 * self.limit:
            self.clear()
            self.held = len(piece)
        word = piece[:-1] if piece[-1:] in (".", ",") else piece
        if not LATIN(word):
            packed = self.pack(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        elif word is not piece:
            packed = self[word] + self[piece[-1]]
        elif (lower := word.lower()) != word:
            packed = self[lower]
        else:
            if not word.isascii():
                word = "".join(map(byte_letters().__getitem__, word.encode()))
            packed = self.pack([t.id for t in self.model.tokenize(word)])
        self[piece] = packed
        return packed

    def pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def packed(self, text: str) -> bytes:
        if self.whole:
            return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        # str.split() would also cut at separators that the tokenizer may keep
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def write_records(docs: DataFrame, out: str, tokenizer: str, end_id: int, shards: int | None = None) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) and writes shards under ``out``; returns the manifest.

    Shard k holds the k-th range of doc_ids, each in ascending order, so the
    concatenation of the shards is in order. The text is shuffled once, to its range.
    """
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first())
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    data_dir = f"{out}/data"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        enc = encoder(tokenizer)
        end = enc.pack([end_id])
        width = len(end)
        filesystem, root = pafs.FileSystem.from_uri(data_dir)
        filesystem.create_dir(root, recursive=True)
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}"
        index, offset, waiting, size = [], 0, [], 0
        with filesystem.open_output_stream(f"{root}/{name}.rec") as sink:

            def flush() -> None:
                sink.write(b"".join(waiting))
                waiting.clear()

            def every() -> Iterator[pa.RecordBatch]:
                yield first
                yield from batches

            for batch in every():
                ids = batch.column(0).to_pylist()
                for doc_id, text in zip(ids, texts_of(batch.column(1)), strict=True):
                    packed = enc.packed(text) + end
                    record = frame(pack(doc_id, packed, enc.wide))
                    index.append((doc_id or 0, offset, len(packed) // width))
                    offset += len(record)
                    waiting.append(record)
                    size += len(record)
                    if size >= FLUSH:
                        flush()
                        size = 0
            flush()
        table = np.array(index, INDEX)
        raw = table.tobytes()
        with filesystem.open_output_stream(f"{root}/{name}.idx") as sink:
            sink.write(raw)
        row = [shard, f"{name}.rec", f"{name}.idx", len(index), int(table["tokens"].sum()), offset, masked(raw)]
        yield pa.RecordBatch.from_pydict({c.split()[0]: [v] for c, v in zip(MANIFEST.split(", "), row, strict=True)})

    small_batches(spark)
    rows.mapInArrow(write, MANIFEST).write.parquet(f"{out}/manifest")
    return spark.read.parquet(f"{out}/manifest")


def shard_list(spark: SparkSession, out: str) -> DataFrame:
    """The manifest with ``first``, the tokens of all shards before; one row a shard."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    listed = spark.read.parquet(f"{out}/manifest")
    return listed.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_index(filesystem, root: str, shard: dict) -> np.ndarray:
    with filesystem.open_input_file(f"{root}/{shard['index']}") as source:
        raw = source.read()
    if masked(raw) != shard["index_crc"] or len(raw) != shard["n_docs"] * INDEX.itemsize:
        raise CorruptRecord(f"index of shard {shard['shard']}")
    return np.frombuffer(raw, INDEX)


def pack(doc_id: int | None, packed: bytes, wide: bool) -> bytes:
    return ROW.pack(doc_id or 0, NULL_ID * (doc_id is None) + WIDE * wide) + packed


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, flags = ROW.unpack_from(payload)
    ids = np.frombuffer(payload, "<u4" if flags & WIDE else "<u2", offset=ROW.size)
    return (None if flags & NULL_ID else doc_id), ids


def read_records(spark: SparkSession, out: str, shuffle_seed: int | None = None) -> DataFrame:
    """Reads all records back: doc_id, start (tokens of all records before), n_tokens, ids.

    In stored order, frames stream from the record file and every checksum is
    verified. With ``shuffle_seed``, the records of a shard come in an order drawn
    from the seed, each one read by the index, and the shards are mixed as well.
    """
    shards = shard_list(spark, out)
    key = F.col("shard") if shuffle_seed is None else F.xxhash64(F.col("shard"), F.lit(shuffle_seed))
    spread = shards.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key)
    data_dir = f"{out}/data"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                yield from read_shard(data_dir, shard, shuffle_seed)

    return spread.mapInArrow(read, RECORDS)


def read_shard(data_dir: str, shard: dict, seed: int | None) -> Iterator[pa.RecordBatch]:
    filesystem, root = pafs.FileSystem.from_uri(data_dir)
    index = read_index(filesystem, root, shard)
    starts = shard["first"] + np.concatenate(([0], np.cumsum(index["tokens"].astype(np.int64))[:-1]))
    order = np.arange(len(index))
    if seed is not None:
        order = np.random.default_rng([seed, shard["shard"]]).permutation(len(index))
    ends = np.append(index["offset"][1:], np.uint64(shard["n_bytes"]))
    rows: list[tuple] = []
    held = 0
    with filesystem.open_input_file(f"{root}/{shard['data']}") as source:
        block, low, high = b"", 0, 0
        for k in order.tolist():
            a, b = int(index["offset"][k]), int(ends[k])
            if not low <= a <= b <= high:
                low, high = a, max(b, min(a + FLUSH, shard["n_bytes"])) if seed is None else b
                source.seek(low)
                block = source.read(high - low)
            payload, after = unframe(block, a - low)
            doc_id, ids = unpack(payload)
            if after != b - low or len(ids) != index["tokens"][k]:
                raise CorruptRecord(f"record {k} of shard {shard['shard']}")
            rows.append((doc_id, int(starts[k]), len(ids), ids.astype(np.int32)))
            held += len(ids)
            if held >= 2_000_000:
                yield as_batch(rows)
                rows, held = [], 0
    if rows:
        yield as_batch(rows)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    offsets = np.concatenate(([0], np.cumsum([r[2] for r in rows]))).astype(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([r[3] for r in rows])))
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), ids],
        names=["doc_id", "start", "n_tokens", "ids"],
    )
