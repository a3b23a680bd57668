"""Token ids in sorted-string-table shards.

A shard file holds the documents of one range of keys, sorted:

    block*      zstd-compressed; entries (shared prefix length, rest length, value length, rest of key, value)
    index       zstd-compressed; for each block its last key, offset and length
    bloom       bits of a Bloom filter over all keys
    footer      fixed size: offsets and lengths of index and bloom, entries, tokens, hash count, id width, magic

A key is a null marker, the order-preserving big-endian document id, and a counter for repeated ids. A value is
the number of ids before the document in its shard, and its ids as little-endian integers of two bytes, or four
where the vocabulary needs them. ``Shard.get`` asks the Bloom filter, finds the block by binary search in the
index and reads that block alone.

Files are written by tasks into the shared folder under a name of their own for each attempt; the manifest, itself
a stored table, names the files that count, so a task that runs again leaves no doubt.
"""

from __future__ import annotations

import bisect
import math
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAGIC = b"QFSST01\n"
FOOTER = struct.Struct("<QQQQQQII8s")
BLOCK_BYTES = 256 * 1024
BLOOM_BITS = 10
BLOOM_HASHES = 7
#: Bytes of text that one shard takes.
SHARD_BYTES = 64 << 20
#: Remembered pieces in one worker process; the table is emptied when it is full.
MEMORY = 600_000
#: New pieces that the library encodes in one text.
TOGETHER = 50
SLICE_CHARS = 1_000_000


def file_of(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if re.match(r"\w+:", path) else f"file://{path}")


# ---- format -------------------------------------------------------------------------------------------------------


def key_of(doc_id: int | None, again: int = 0) -> bytes:
    head = b"\0" + bytes(8) if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))
    return head + struct.pack(">Q", again)


def id_of(key: bytes) -> int | None:
    return None if key[:1] == b"\0" else struct.unpack(">Q", key[1:9])[0] - (1 << 63)


def _bloom_places(key: bytes, bits: int) -> list[int]:
    low, high = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(low + i * high) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Writes one shard; keys must come in ascending order."""

    def __init__(self, sink, width: int):
        self.sink, self.width = sink, width
        self.offset = self.entries = self.tokens = 0
        self.block, self.size, self.last = [], 0, b""
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.pack = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: bytes) -> None:
        if self.keys and key <= self.keys[-1]:
            raise ValueError("keys out of order")
        shared = 0
        if self.block:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        rest = key[shared:]
        self.block += [struct.pack("<BBIQ", shared, len(rest), len(ids), self.tokens), rest, ids]
        self.size += 14 + len(rest) + len(ids)
        self.last = key
        self.keys.append(key)
        self.entries += 1
        self.tokens += len(ids) // self.width
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            packed = self.pack.compress(b"".join(self.block))
            self.sink.write(packed)
            self.index.append((self.last, self.offset, len(packed)))
            self.offset += len(packed)
            self.block, self.size = [], 0

    def close(self) -> None:
        self._flush()
        index = self.pack.compress(b"".join(struct.pack("<BQI", len(k), o, n) + k for k, o, n in self.index))
        bits = max(8, BLOOM_BITS * len(self.keys))
        bloom = bytearray((bits + 7) // 8)
        for key in self.keys:
            for place in _bloom_places(key, bits):
                bloom[place >> 3] |= 1 << (place & 7)
        self.sink.write(index)
        self.sink.write(bytes(bloom))
        self.sink.write(FOOTER.pack(self.offset, len(index), self.offset + len(index), bits, self.entries, self.tokens, BLOOM_HASHES, self.width, MAGIC))


class Shard:
    """Reads one shard file by footer, index and block."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        end = source.tell()
        at, index_len, bloom_at, self.bits, self.entries, self.tokens, _, self.width, magic = FOOTER.unpack(self._read(end - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard file")
        self.unpack = zstandard.ZstdDecompressor()
        raw, self.index, p = self.unpack.decompress(self._read(at, index_len), max_output_size=1 << 31) if index_len else b"", [], 0
        while p < len(raw):
            n, offset, length = struct.unpack_from("<BQI", raw, p)
            self.index.append((raw[p + 13 : p + 13 + n], offset, length))
            p += 13 + n
        self.last_keys = [k for k, _, _ in self.index]
        self.bloom = self._read(bloom_at, (self.bits + 7) // 8)

    def _read(self, at: int, length: int) -> bytes:
        self.source.seek(at)
        return self.source.read(length)

    def _entries(self, block: int) -> Iterator[tuple[bytes, int, bytes]]:
        _, offset, length = self.index[block]
        raw = self.unpack.decompressobj().decompress(self._read(offset, length))
        p, key = 0, b""
        while p < len(raw):
            shared, rest, size, before = struct.unpack_from("<BBIQ", raw, p)
            p += 14
            key = key[:shared] + raw[p : p + rest]
            p += rest
            yield key, before, raw[p : p + size]
            p += size

    def __iter__(self) -> Iterator[tuple[bytes, int, bytes]]:
        for block in range(len(self.index)):
            yield from self._entries(block)

    def get(self, key: bytes) -> tuple[int, bytes] | None:
        """(ids before it in the shard, its ids) of one key, or None."""
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, self.bits)):
            return None
        block = bisect.bisect_left(self.last_keys, key)
        if block < len(self.index):
            for found, before, ids in self._entries(block):
                if found == key:
                    return before, ids
        return None


# ---- tokens -------------------------------------------------------------------------------------------------------


class WordEncoder:
    """Encodes texts with the tokenizers library, each distinct piece once.

    For this vocabulary the library turns white space into spaces, lower-cases, and cuts at every space and between
    letters, digits and signs before it merges, so ids of a text are the ids of its pieces in a row. Pieces are cut
    here only in printable ASCII and Latin-1 letters; a stretch with anything else goes to the library whole. New
    pieces go to the library many at a time, with spaces between them: the last id of each piece is a word end.
    Whether a vocabulary is of this kind is tested on PROBES when it is loaded; if not, all texts go to the library whole.
    """

    PROBES = ["Don't STOP, 12ab!? (x's) we'll  go\nà la Île; ß ÷ 3.14 <b> #1 o'er", "a" * 40, "x1y2 \n z", "It is a plain line of words."]

    PLAIN_TEXT = re.compile(r"[ \n!-~À-ÖØ-öø-ÿ]*\Z")
    PIECES = re.compile(r"[a-zß-öø-ÿ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")

    def __init__(self, tokenizer_file: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        size = max(self.tokenizer.get_vocab_size(), end_id + 1)
        self.width = 2 if size <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.end = np.array([end_id], self.kind).tobytes()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.word_end = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.word_end[i] = token.endswith("</w>")
        self.pieces: dict[str, bytes] = {}
        self.stretches: dict[str, bytes] = {}
        self.by_pieces = True
        self.by_pieces = self._fits()

    def _fits(self) -> bool:
        try:
            return self.encode(self.PROBES) == [ids + self.end for ids in self._whole(self.PROBES)]
        except ValueError:
            return False

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        for at in range(0, len(pieces), 1000 * TOGETHER):
            part = pieces[at : at + 1000 * TOGETHER]
            lines = [" ".join(part[i : i + TOGETHER]) for i in range(0, len(part), TOGETHER)]
            ids = np.array([i for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False) for i in e.ids], self.kind)
            ends = (np.flatnonzero(self.word_end[ids]) + 1) * self.width
            if len(ends) != len(part):
                raise ValueError("a piece is not one word of this vocabulary")
            raw = ids.tobytes()
            self.pieces.update(zip(part, [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]))

    def _cut(self, text: str) -> list[str] | None:
        """The pieces of a text of plain characters; None for any other."""
        if self.PLAIN_TEXT.match(text) and not any(s in text for s in self.specials):
            return self.PIECES.findall(text.lower())
        return None

    def _mixed(self, text: str) -> bytes:
        """A text with other characters, stretch by stretch."""
        words = text.replace("\n", " ").split(" ")
        self.stretches.update(zip(new := list({w for w in words if w not in self.stretches}), self._whole(new)))
        out = b"".join([self.stretches[w] for w in words])
        if len(self.stretches) > MEMORY // 4:
            self.stretches.clear()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text with the end id, as little-endian integers."""
        if not self.by_pieces:
            return [ids + self.end for ids in self._whole(texts)]
        if len(self.pieces) > MEMORY:
            self.pieces.clear()
        cut = [self._cut(t) for t in texts]
        pieces = self.pieces
        if new := set().union(*filter(None, cut)).difference(pieces):
            self._learn(list(new))
        return [(self._mixed(t) if ps is None else b"".join(map(pieces.__getitem__, ps))) + self.end for t, ps in zip(texts, cut)]


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def _encoder(tokenizer_file: str, end_id: int) -> WordEncoder:
    at = (tokenizer_file, end_id)
    if at not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        _ENCODERS[at] = WordEncoder(tokenizer_file, end_id)
    return _ENCODERS[at]


# ---- writing and reading back ---------------------------------------------------------------------------------------

MANIFEST = "path string, first_key binary, entries long, tokens long"


def _write_shard(folder: str, tokenizer_file: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, first = _encoder(tokenizer_file, end_id), None, b""
        name = f"{uuid.uuid4().hex}.sst"
        fs, base = file_of(folder)
        sink = None

        def put(keys: list[tuple[int | None, int]], texts: list[str]) -> None:
            nonlocal writer, sink, first
            for (doc_id, again), ids in zip(keys, encoder.encode(texts)):
                key = key_of(doc_id, again)
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    sink = fs.open_output_stream(f"{base}/{name}")
                    writer, first = Writer(sink, encoder.width), key
                writer.add(key, ids)

        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            texts = batch.column(2).to_pylist()
            held, start = 0, 0
            for i, t in enumerate(texts):
                texts[i] = t = t or ""
                held += len(t)
                if held >= SLICE_CHARS:
                    put(keys[start : i + 1], texts[start : i + 1])
                    start, held = i + 1, 0
            if start < len(texts):
                put(keys[start:], texts[start:])
        if writer:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pylist(
                [{"path": f"{folder}/{name}", "first_key": first, "entries": writer.entries, "tokens": writer.tokens}],
                pa.schema([("path", pa.string()), ("first_key", pa.binary()), ("entries", pa.int64()), ("tokens", pa.int64())]),
            )

    return run


def write_shards(docs: DataFrame, tokenizer_file: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all rows of ``docs`` and return the manifest: one row per shard file, in no order.

    Null keys come first, null texts hold the end id alone, a repeated key is an entry of its own for each row
    (in the order of the texts; equal texts in any order), and an empty table writes no file. Texts of any length are
    encoded whole; an entry longer than a block is a block of its own. All other columns of ``docs`` are left out,
    whatever their names. tokenizer_file must be readable on executors.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    folder = common.fresh_path(spark, "sst")
    narrow = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    size = narrow.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = max(1, math.ceil(size / SHARD_BYTES))
    # rows are bounded by key and number, so the rows of one key may fill several shards
    at = [F.col("key").asc_nulls_first(), F.col("again")]
    ordered = _counted(narrow).repartitionByRange(shards, *at).sortWithinPartitions(*at)
    return common.stored(ordered.mapInArrow(_write_shard(folder, tokenizer_file, end_id), MANIFEST), "sst-manifest")


def _counted(narrow: DataFrame) -> DataFrame:
    """(key, again, text): again numbers the rows of a key from 0, in the order of their texts. Only repeated keys are sorted for it."""
    counted = narrow.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("key").alias("_key"))
    repeated = common.stored(counted, "repeated-keys")
    n = repeated.count()
    if not n:
        return narrow.select("key", F.lit(0).cast("long").alias("again"), "text")
    same = F.col("key").eqNullSafe(F.col("_key"))
    small = common.maybe_broadcast(repeated, n, 1_000_000)
    rows = common.stored(narrow.join(small, same, "left_semi"), "repeated-rows")
    numbered, _ = common.numbered(rows, ["key", "text"], rows.count())
    numbered = common.stored(numbered, "repeated-numbered")
    firsts = common.stored(numbered.groupBy(F.col("key").alias("_key")).agg(F.min("row_no").alias("_first")), "repeated-first")
    again = numbered.join(common.maybe_broadcast(firsts, n), same).select("key", (F.col("row_no") - F.col("_first")).alias("again"), "text")
    return narrow.join(small, same, "left_anti").select("key", F.lit(0).cast("long").alias("again"), "text").unionByName(again)


def _read_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            fs, path = file_of(row["path"])
            with fs.open_input_file(path) as source:
                shard, rows = Shard(source), []
                for key, before, ids in shard:
                    wide = ids if shard.width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                    rows.append((id_of(key), row["before"] + before, len(ids) // shard.width, zlib.crc32(wide)))
                    if len(rows) >= 10_000:
                        yield _digests(rows)
                        rows = []
                if rows:
                    yield _digests(rows)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every entry, read from the shard files.

    The ids before a shard are sums over the manifest, which has one row for each shard.
    """
    before, rows = 0, []
    for r in sorted(manifest.collect(), key=lambda r: bytes(r["first_key"])):
        rows.append((r["path"], before))
        before += r["tokens"]
    if not rows:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.createDataFrame(rows, "path string, before long").repartition(len(rows))
    return files.mapInArrow(_read_shard, "doc_id long, start long, n_tokens long, ids_crc32 long")


def look_up(manifest: DataFrame, doc_id: int) -> list[int] | None:
    """The ids of one document by binary search: in the manifest for the shard, in its index for the block."""
    rows = sorted(manifest.collect(), key=lambda r: bytes(r["first_key"]))
    at = bisect.bisect_right([bytes(r["first_key"]) for r in rows], key_of(doc_id)) - 1
    if at < 0:
        return None
    fs, path = file_of(rows[at]["path"])
    with fs.open_input_file(path) as source:
        shard = Shard(source)
        found = shard.get(key_of(doc_id))
        return None if found is None else np.frombuffer(found[1], f"<u{shard.width}").tolist()
