"""Token-id files: fixed-size blocks of ids as bit or byte planes, each compressed by zstandard, with a chunk index.

A shard file, all numbers little-endian:

    MAGIC
    chunk 0, chunk 1, ...     each the compressed planes of BLOCK ids (the last chunk of a shard has what is left)
    document table            zstandard of int64 document ids, uint8 1 where an id is null, uint32 id counts
    chunk index               a row of uint64 per chunk: place in the file, ids, compressed bytes of each plane
    FOOTER                    places of table and index, documents, chunks, planes, ids in all; MAGIC

A byte plane holds byte p of every id of the block, a bit plane bit p packed eight to a byte. The manifest lists the
shards in document order with the number of ids before each.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"SLPLANE1"
BLOCK = 1 << 16
FOOTER = struct.Struct("<QQQQQQ8s")
LEVEL = 3
#: Encoded words are forgotten beyond this number, or this many bytes of text, which bounds a worker's memory.
MOST_WORDS, MOST_BYTES = 300_000, 16 << 20
#: Bytes of text that are split into words at once, and words that are joined to be encoded by one call.
TEXT_BYTES, CALL = 8 << 20, 64
#: What Arrow takes as white space and the tokenizer does not.
ODD_SPACE = "[\x1c-\x1f]"
#: Parts the new words of a call; white space around it keeps it a token by itself.
MARK = "\x01"
#: A single stop or comma at a word's end, after a Latin letter or a digit, is a token by itself (less the letter whose lower
#: case ends in an accent).
STOP = r"[0-9A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{2af}][.,]$"
#: Words of letters that stay letters when they are composed and lowered: the last of their tokens ends in END, no other.
PLAIN, END = r"^[A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}]+$", "</w>"
#: Bytes of input, as the plan estimates them, that go to a shard at most on average.
SHARD_BYTES = 256 << 20


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """4 byte planes or 32 bit planes of uint32 ids, lowest first."""
    flat = np.ascontiguousarray(ids.astype("<u4", copy=False)).view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(flat[:, p]).tobytes() for p in range(4)]
    spread = np.unpackbits(flat, axis=1, bitorder="little")
    return [np.packbits(spread[:, p], bitorder="little").tobytes() for p in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)).view("<u4").reshape(-1)
    spread = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(spread, axis=1, bitorder="little").reshape(-1, 4).copy().view("<u4").reshape(-1)


class ShardWriter:
    """Appends documents to one shard; holds one block of ids and the document table."""

    def __init__(self, out, bits: bool = False):
        self.out, self.bits, self.at = out, bits, 0
        self.pack = zstandard.ZstdCompressor(level=LEVEL)
        self.left, self.held = [], 0
        self.index: list[list[int]] = []
        self.ids, self.nulls, self.counts, self.total = [], [], [], 0
        self._put(MAGIC)

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian uint32."""
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.counts.append(len(ids) // 4)
        self.total += len(ids) // 4
        self.left.append(ids)
        self.held += len(ids)
        if self.held >= 4 * BLOCK:
            raw = b"".join(self.left)
            whole = len(raw) // (4 * BLOCK) * 4 * BLOCK
            for i in range(0, whole, 4 * BLOCK):
                self._chunk(raw[i : i + 4 * BLOCK])
            self.left, self.held = [raw[whole:]], len(raw) - whole

    def _chunk(self, raw: bytes) -> None:
        planes = [self.pack.compress(p) for p in to_planes(np.frombuffer(raw, "<u4"), self.bits)]
        self.index.append([self.at, len(raw) // 4, *map(len, planes)])
        self._put(b"".join(planes))

    def close(self) -> None:
        if self.held:
            self._chunk(b"".join(self.left))
        table = self.at
        self._put(self.pack.compress(np.array(self.ids, "<i8").tobytes() + np.array(self.nulls, "u1").tobytes() + np.array(self.counts, "<u4").tobytes()))
        index = self.at
        self._put(np.array(self.index, "<u8").tobytes())
        planes = 32 if self.bits else 4
        self._put(FOOTER.pack(table, index, len(self.ids), len(self.index), planes, self.total, MAGIC))


class ShardReader:
    """Reads a shard's tables, and any of its chunks by itself."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        self.table, index, self.n_docs, self.n_chunks, planes, self.total, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.index = np.frombuffer(self._read(index, self.n_chunks * (2 + planes) * 8), "<u8").reshape(-1, 2 + planes)
        raw = zstandard.ZstdDecompressor().decompress(self._read(self.table, index - self.table), max_output_size=13 * self.n_docs + 1)
        n = self.n_docs
        self.doc_ids = np.frombuffer(raw[: 8 * n], "<i8")
        self.nulls = np.frombuffer(raw[8 * n : 9 * n], "u1")
        self.counts = np.frombuffer(raw[9 * n :], "<u4")

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def chunk(self, k: int) -> np.ndarray:
        at, n, *sizes = (int(x) for x in self.index[k])
        raw, ends = self._read(at, sum(sizes)), np.cumsum([0, *sizes]).tolist()
        open_ = zstandard.ZstdDecompressor()
        return from_planes([open_.decompress(raw[a:b], max_output_size=n + 1) for a, b in zip(ends, ends[1:], strict=False)], n)

    def documents(self) -> Iterator[tuple[int | None, int, Iterator[bytes]]]:
        """doc_id, number of ids before it in the shard, its ids in pieces. Holds one chunk."""
        chunks = (self.chunk(k) for k in range(self.n_chunks))
        block, at = np.empty(0, "<u4"), 0

        def pieces(need: int) -> Iterator[bytes]:
            nonlocal block, at
            while need:
                if at == len(block):
                    block, at = next(chunks), 0
                take = min(need, len(block) - at)
                yield block[at : at + take].tobytes()
                at, need = at + take, need - take

        before = 0
        for i, null, n in zip(self.doc_ids.tolist(), self.nulls.tolist(), self.counts.tolist(), strict=True):
            yield None if null else i, before, pieces(n)
            before += n


def _gather(flat: np.ndarray, size: np.ndarray, which: np.ndarray, spare: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Of the runs that lie one after another in flat the runs `which`, each followed by `spare` free places, and where
    each ends."""
    n = size[which]
    first = (np.cumsum(size) - size)[which]
    whole = n + spare
    after = np.cumsum(whole)
    at = np.repeat(first - (after - whole), whole)
    at += np.arange(len(at))
    return flat[np.minimum(at, max(0, len(flat) - 1))] if len(flat) else np.zeros(len(at), flat.dtype), after


class WordEncoder:
    """Encodes text by a tokenizer of the tokenizers library that drops white space and lowers case: words without white
    space are encoded each by itself and each different one once, as the tokenizer joins nothing across white space.
    Texts that hold the string of a special token, or a character that Arrow takes for white space and the tokenizer
    doesn't, go to the library whole."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        (self.mark,) = self.model.encode(MARK, add_special_tokens=False).ids
        special = [re.escape(t.content) for t in self.model.get_added_tokens_decoder().values()]
        self.whole = "|".join([ODD_SPACE, *special])
        vocabulary = self.model.get_vocab()
        self.last, self.marks = np.zeros(max(vocabulary.values()) + 1, bool), np.zeros(max(vocabulary.values()) + 1, bool)
        ends = [i for t, i in vocabulary.items() if t.endswith(END)]
        self.last[ends], self.marks[self.mark] = True, True
        self.stops = [self.model.encode(x, add_special_tokens=False).ids[0] for x in (".", ",")]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def _library(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _called(self, new: list[str], part: str, closes: np.ndarray) -> list[bytes]:
        """Ids of words that are joined by `part` and end where an id closes."""
        calls, out = [part.join([*new[i : i + CALL], ""]) for i in range(0, len(new), CALL)], []
        for found in self.model.encode_batch_fast(calls, add_special_tokens=False):
            ids = np.array(found.ids, "<u4")
            cut = closes[ids]
            raw, ends = ids[ids != self.mark].tobytes(), (4 * np.cumsum(ids != self.mark)[cut]).tolist()
            out.extend([raw[a:b] for a, b in zip([0, *ends], ends, strict=False)])
        return out

    def _words(self, coded: pa.Array) -> list[bytes]:
        """Ids of words, each different."""
        words = coded.to_pylist()
        found = list(map(self.known.get, words))
        new = [i for i, b in enumerate(found) if b is None]
        if new:
            if len(self.known) > MOST_WORDS or self.held > MOST_BYTES:  # what is met again moves on, the rest is forgotten
                self.older, self.known, self.held = self.known, {}, 0
            older = self.older.get
            for i in new:
                found[i] = older(words[i])
            new = np.array([i for i in new if found[i] is None], np.int64)
            left = coded.take(pa.array(new))
            odd = pc.match_substring(left, MARK).to_numpy(zero_copy_only=False)
            for i in new[odd].tolist():
                found[i] = self._library(words[i])
            plain = pc.match_substring_regex(left, PLAIN).to_numpy(zero_copy_only=False)
            for which, part, closes in ((plain, " ", self.last), (~plain & ~odd, f" {MARK} ", self.marks)):
                which = new[which].tolist()
                for i, ids in zip(which, self._called([words[i] for i in which], part, closes), strict=True):
                    found[i] = ids
            self.known.update(zip(words, found, strict=True))
            self.held += pc.sum(pc.binary_length(left)).as_py() or 0
        return found

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin (with the end of the last)."""
        words = pc.utf8_split_whitespace(texts)
        ends = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        which, different = coded.indices.to_numpy(), coded.dictionary
        # A-Z is lowered here where no accent follows that would join its letter
        stop = pc.match_substring_regex(different, STOP)
        base = pc.if_else(stop, pc.utf8_slice_codeunits(different, 0, -1), different)
        coded = pc.if_else(pc.string_is_ascii(base), pc.ascii_lower(base), base).dictionary_encode()
        raw = self._words(coded.dictionary)
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        flat, _ = _gather(np.frombuffer(b"".join(raw), "<u4"), size, coded.indices.to_numpy(), stop.to_numpy(zero_copy_only=False))
        size = size[coded.indices.to_numpy()] + stop.to_numpy(zero_copy_only=False)
        dots = np.flatnonzero(stop.to_numpy(zero_copy_only=False))
        flat[np.cumsum(size)[dots] - 1] = np.where(pc.ends_with(different, ".").to_numpy(zero_copy_only=False)[dots], self.stops[0], self.stops[1])
        ids, after = _gather(flat, size, which)
        return ids, np.concatenate([[0], after])[ends - ends[0]]

    def encode_batch(self, texts: pa.Array) -> Iterator[bytes]:
        """Little-endian uint32 ids of each text, in order; null counts as empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        whole = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)
        size = pc.binary_length(texts).to_numpy()
        start = 0
        while start < len(texts):
            end = start + max(1, int(np.searchsorted(np.cumsum(size[start:]), TEXT_BYTES, side="right")))
            part = texts.slice(start, end - start)
            odd = whole[start:end]
            ids, cut = self._plain(pc.if_else(pa.array(odd), "", part) if odd.any() else part)
            raw, cut = ids.tobytes(), (4 * cut).tolist()
            for k in range(end - start):
                yield self._library(part[k].as_py()) if odd[k] else raw[cut[k] : cut[k + 1]]
            start = end


@lru_cache(maxsize=2)
def _words(path: str) -> WordEncoder:
    return WordEncoder(path)


def _shards(docs: DataFrame) -> int:
    """As many as docs has partitions, and no fewer than SHARD_BYTES ask for."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(1, docs.rdd.getNumPartitions())
    return max(parts, min(64 * parts, -(-size // SHARD_BYTES)))  # an estimate may be far too large


def write_token_files(
    docs: DataFrame, to: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", bits: bool = False, shards: int | None = None
) -> str:
    """Encodes every whole text, appends end_id, and writes the ids in ascending doc_id order as shards under the folder
    `to` (a URI that all executors see); returns the manifest's URI.

    A null doc_id comes first; rows that share a doc_id are ordered by a hash of their text, rows that are alike are
    interchangeable. Null and empty texts have end_id alone. Other columns are not read. Documents are range
    partitioned, so no task holds more than its range; a lost task writes its shard anew under another name and only
    shards of tasks that ended are listed. An empty table gives a manifest without shards.
    """
    n = shards or _shards(docs)
    order = ("__sl_id", "__sl_tie", "__sl_row")
    rows = docs.select(
        docs[doc_id].cast("bigint").alias("__sl_id"),
        F.xxhash64(docs[text]).alias("__sl_tie"),
        F.monotonically_increasing_id().alias("__sl_row"),
        docs[text].alias("__sl_text"),
    )
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("__sl_id", "__sl_text")
    end = struct.pack("<I", end_id)

    def shard(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = pa.fs.FileSystem.from_uri(to)
        system.create_dir(folder, recursive=True)
        name, code, out, first = f"shard-{uuid.uuid4().hex}", _words(tokenizer), None, None
        for batch in it:
            for key, ids in zip(batch.column(0).to_pylist(), code.encode_batch(batch.column(1)), strict=True):
                if out is None:
                    file = system.open_output_stream(f"{folder}/{name}.part")
                    out, first = ShardWriter(file, bits), key
                out.add(key, ids + end)
        if out is not None:
            out.close()
            file.close()
            system.move(f"{folder}/{name}.part", f"{folder}/{name}")
            made = {"name": [name], "first": pa.array([first], pa.int64()), "n_docs": [len(out.ids)], "n_ids": [out.total]}
            yield pa.RecordBatch.from_pydict(made)

    made = rows.mapInArrow(shard, "name string, first bigint, n_docs bigint, n_ids bigint")
    made = made.withColumn("part", F.spark_partition_id())  # ranges ascend with the partition
    listed, before = [], 0
    for r in sorted(made.collect(), key=lambda r: r.part):  # a row per shard
        listed.append({"name": r.name, "n_docs": r.n_docs, "n_ids": r.n_ids, "before": before})
        before += r.n_ids
    system, folder = pa.fs.FileSystem.from_uri(to)
    system.create_dir(folder, recursive=True)
    with system.open_output_stream(f"{folder}/manifest.json") as f:
        f.write(json.dumps({"block": BLOCK, "n_ids": before, "shards": listed}).encode())
    return f"{to}/manifest.json"


def read_token_files(spark: SparkSession, manifest: str, digest: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens, and ids
    (array<int>), or with digest their unsigned CRC-32 as ids_crc32. A task reads a shard, a chunk at a time. Documents of null text have their end id
    alone, null and repeated doc_ids are rows of their own; the files of an empty table give no rows."""
    system, inner = pa.fs.FileSystem.from_uri(manifest)
    with system.open_input_stream(inner) as f:
        listed = json.loads(f.read())["shards"]
    folder = manifest.rsplit("/", 1)[0]
    last, kind = ("ids_crc32", pa.int64()) if digest else ("ids", pa.list_(pa.int32()))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), (last, kind)])

    def documents(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = pa.fs.FileSystem.from_uri(folder)
        for batch in it:
            for name, before in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                with system.open_input_file(f"{inner}/{name}") as file:
                    rows, held = [], 0
                    for doc_id, at, pieces in ShardReader(file).documents():
                        n, crc, ids = 0, 0, []
                        for raw in pieces:
                            n += len(raw) // 4
                            if digest:
                                crc = zlib.crc32(raw, crc)
                            else:
                                ids.append(np.frombuffer(raw, "<i4"))
                        rows.append((doc_id, before + at, n, crc if digest else np.concatenate(ids)))
                        held += n
                        if len(rows) >= 4096 or held >= 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    files = spark.createDataFrame([(i, s["name"], s["before"]) for i, s in enumerate(listed)], "shard int, name string, before bigint")
    if listed:
        files = files.repartitionByRange(len(listed), "shard")
    return files.mapInArrow(documents, f"doc_id bigint, start bigint, n_tokens bigint, {last} {'bigint' if digest else 'array<int>'}")
