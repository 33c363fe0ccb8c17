"""Token-ID output: plane-shuffled id files with a chunk index, written and read back by Spark tasks.

A shard file holds the ids of a contiguous range of documents in ascending id order:

    magic, chunks..., index, index length (8 bytes), magic

A chunk holds CHUNK_IDS ids (the last one fewer).  Its ids, as little-endian unsigned 32-bit integers, are transposed
into 4 byte planes or 32 bit planes; each plane is compressed with zstandard on its own and an all-zero plane takes no
bytes.  The index is a zstandard frame of JSON: for each chunk its offset, its number of ids and its planes' lengths,
and for each document its id and length, so that a reader can fetch a span of ids with two ranged reads.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.tables import fresh_dir

MAGIC = b"PLNIDS01"
#: Ids in a chunk, ids above which a task goes on in the next file, and bytes of text encoded at once.
CHUNK_IDS, FILE_IDS, BATCH_BYTES = 1 << 16, 1 << 24, 4 << 20
#: Pieces that a worker's memo keeps, and the longest of them (characters).
MEMO_SIZE, MEMO_CHARS = 150_000, 48


# ---- the file format ----------------------------------------------------------------------------------------------


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """The byte or bit planes of unsigned 32-bit ids, least significant first."""
    octets = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [octets[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The ids that ``to_planes`` took apart; an empty plane stands for zeros."""
    if len(planes) == 4:
        octets = np.zeros((n, 4), dtype=np.uint8)
        for k, plane in enumerate(planes):
            if plane:
                octets[:, k] = np.frombuffer(plane, dtype=np.uint8)
    else:
        bits = np.zeros((n, 32), dtype=np.uint8)
        for k, plane in enumerate(planes):
            if plane:
                bits[:, k] = np.unpackbits(np.frombuffer(plane, dtype=np.uint8), count=n, bitorder="little")
        octets = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view("<u4").ravel()


class ShardWriter:
    """Takes the ids of a shard bit by bit; full chunks are compressed at once, so that few ids are held."""

    def __init__(self, kind: str = "byte"):
        self.kind, self.press = kind, zstandard.ZstdCompressor(level=3)
        self.parts, self.chunks, self.at = [MAGIC], [], len(MAGIC)
        self.rest = np.zeros(0, dtype="<u4")

    def _chunk(self, ids: np.ndarray) -> None:
        planes = [self.press.compress(p) if p.count(0) < len(p) else b"" for p in to_planes(ids, self.kind)]
        self.chunks.append([self.at, len(ids), [len(p) for p in planes]])
        self.parts += planes
        self.at += sum(map(len, planes))

    def add(self, ids: np.ndarray) -> None:
        ids = np.concatenate([self.rest, ids])
        full = len(ids) - len(ids) % CHUNK_IDS
        for begin in range(0, full, CHUNK_IDS):
            self._chunk(ids[begin : begin + CHUNK_IDS])
        self.rest = ids[full:].copy()

    def finish(self, doc_ids: list[int | None], lengths: list[int]) -> bytes:
        """The bytes of the shard file."""
        if len(self.rest):
            self._chunk(self.rest)
        index = self.press.compress(json.dumps({"chunks": self.chunks, "docs": doc_ids, "lengths": lengths}).encode())
        return b"".join([*self.parts, index, struct.pack("<Q", len(index)), MAGIC])


def encode_shard(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int], kind: str = "byte") -> bytes:
    """The bytes of one shard file."""
    writer = ShardWriter(kind)
    writer.add(ids)
    return writer.finish(doc_ids, lengths)


def decode_index(data: bytes) -> dict:
    """The chunk and document index of a shard file."""
    if data[: len(MAGIC)] != MAGIC or data[-len(MAGIC) :] != MAGIC:
        raise ValueError("not a complete id file")
    (size,) = struct.unpack("<Q", data[-len(MAGIC) - 8 : -len(MAGIC)])
    return json.loads(zstandard.ZstdDecompressor().decompress(data[-len(MAGIC) - 8 - size : -len(MAGIC) - 8]))


def decode_chunks(data: bytes, index: dict, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids [start, stop) of a shard file; only the chunks that hold them are read."""
    stop = sum(n for _, n, _ in index["chunks"]) if stop is None else stop
    open_up, out, base = zstandard.ZstdDecompressor(), [], 0
    for at, n, sizes in index["chunks"]:
        if base < stop and base + n > start:
            planes = []
            for size in sizes:
                planes.append(open_up.decompress(data[at : at + size]) if size else b"")
                at += size
            out.append(from_planes(planes, n)[max(0, start - base) : stop - base])
        base += n
    return np.concatenate(out) if out else np.zeros(0, dtype="<u4")


# ---- tokenising ---------------------------------------------------------------------------------------------------


# The pre-token pattern of the vocabulary whose runs can be told apart by columns, its letters that every
# library version has as such, and its ASCII marks; and the end of a word in its pieces.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTERS, MARKS, WORD_END = r"A-Za-zÀ-ÖØ-öø-ÿ", r"!-/:-@\[-`{-~", "</w>"


class TextEncoder:
    """Ids of whole texts by the tokenizers library; only the distinct pieces of a batch reach it.

    A batch is split and dictionary-encoded as columns, the ids of each distinct piece come from a memo or the library,
    and the batch's ids are gathered from them by NumPy, so that no Python code runs for each occurrence.

    Only for vocabularies whose pre-tokeniser drops white space: no token, added token or normaliser step then joins
    what blanks and line ends separate, so a text's ids are those of its pieces in order.  Others are encoded whole.
    With the pattern PRE_TOKENS a run of marks between a letter and a blank is a piece of its own, and pieces of only
    letters or only marks are one pre-token each: those go to the library as one text, whose ids part at word ends.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path) as f:
            parts = json.load(f)
        steps = (parts["pre_tokenizer"] or {}).get("pretokenizers", [])
        first = steps[0] if steps else {}
        norms = {n["type"] for n in (parts["normalizer"] or {}).get("normalizers", [])}
        self.added = [t["content"] for t in parts["added_tokens"]]
        self.by_piece = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and norms <= {"NFC", "Lowercase", "Replace"} and not any(" " in t or "\n" in t for t in self.added)
        self.by_run = self.by_piece and first.get("pattern") == {"Regex": PRE_TOKENS} and norms == {"NFC", "Lowercase", "Replace"} and parts["model"].get("end_of_word_suffix") == WORD_END
        if self.by_run:
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
            self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.ends_word[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        self.one_run = re.compile(f"[{LETTERS}]+|[{MARKS}]+").fullmatch
        self.memo: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_runs(self, runs: list[str]) -> list[bytes]:
        """The same for texts of one pre-token each."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(runs)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = (np.flatnonzero(self.ends_word[ids]) + 1) * 4
        if len(ends) != len(runs):
            return self._encode(runs)
        data, begin = ids.tobytes(), 0
        out = []
        for end in ends.tolist():
            out.append(data[begin:end])
            begin = end
        return out

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces; those of short ones are kept for later batches."""
        if len(self.memo) > MEMO_SIZE:
            self.memo = {}
        memo = self.memo
        found = list(map(memo.get, pieces))
        new = [w for w, ids in zip(pieces, found, strict=True) if ids is None]
        if not new:
            return found
        runs = list(filter(self.one_run, new)) if self.by_run else []
        known = set(runs)
        others = [w for w in new if w not in known]
        fresh = dict(zip(runs, self._encode_runs(runs), strict=True)) if runs else {}
        fresh.update(zip(others, self._encode(others), strict=True))
        memo.update(fresh if max(map(len, new)) <= MEMO_CHARS else {w: ids for w, ids in fresh.items() if len(w) <= MEMO_CHARS})
        return [fresh[w] if ids is None else ids for w, ids in zip(pieces, found, strict=True)]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids of the texts one after the other, number of ids of each text); null counts as empty."""
        if not self.by_piece:
            found = self._encode(["" if t is None else t for t in texts.to_pylist()])
            return np.frombuffer(b"".join(found), dtype="<u4"), np.array([len(x) // 4 for x in found], dtype=np.int64)
        spaced = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        if self.by_run and not any(pc.any(pc.match_substring(spaced, t[:2])).as_py() for t in self.added):
            spaced = pc.replace_substring_regex(pc.ascii_lower(spaced), f"([{LETTERS}])([{MARKS}]+) ", r"\1 \2 ")
        split = pc.split_pattern(spaced, " ")
        words = split.flatten().dictionary_encode()
        which = words.indices.to_numpy()
        found = self._pieces(words.dictionary.to_pylist())
        table = np.frombuffer(b"".join(found), dtype="<u4")
        size = np.fromiter(map(len, found), dtype=np.int32, count=len(found)) // 4
        begin = np.cumsum(size, dtype=np.int32) - size
        own = size[which]
        ends = np.zeros(len(own) + 1, dtype=np.int32)
        np.cumsum(own, out=ends[1:])
        at = np.repeat(begin[which] - ends[:-1], own)
        at += np.arange(len(at), dtype=np.int32)
        bounds = split.offsets.to_numpy()
        return table[at], np.diff(ends[bounds - bounds[0]]).astype(np.int64)


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """The encoder of a vocabulary file, made once for each Python worker."""
    if path not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def runs_of(texts: pa.Array, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [begin, end) of rows with at most ``limit`` bytes of text each, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin, before = 0, 0
    while begin < len(ends):
        end = max(int(np.searchsorted(ends, before + limit, side="right")), begin + 1)
        yield begin, end
        begin, before = end, int(ends[end - 1])


def pieces_of(text: str, limit: int = BATCH_BYTES) -> list[str]:
    """A long text cut at blanks into parts of about ``limit`` characters (a part without any blank stays whole)."""
    out, at = [], 0
    while len(text) - at > limit:
        cut = text.rfind(" ", at, at + limit)
        cut = cut if cut > at else text.find(" ", at + limit)
        if cut < 0:
            break
        out.append(text[at:cut])
        at = cut + 1
    return [*out, text[at:]]


# ---- writing and reading ------------------------------------------------------------------------------------------

SHARD = pa.schema([("task", pa.int32()), ("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])
SHARD_DDL = "task int, part int, file string, n_docs long, n_ids long, n_bytes long"


def write_ids(docs: DataFrame, tokenizer_path: str, out_dir: str | None = None, end_id: int = 2, planes: str = "byte", id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame]:
    """Write the ids of all texts in ascending id order; returns the folder and the table of its files.

    The texts are range-partitioned by id (one shuffle), sorted within the partitions, encoded and written by the
    tasks.  Each file gets its name by an atomic rename, and its bytes depend on its rows alone, so a task that runs
    again after a lost executor leaves the same file.  The table (task, part, file, n_docs, n_ids, n_bytes; the order is
    that of task and part) is written beside the files, and nothing goes to the driver.  Files go to ``out_dir``, by
    default a new folder under the shared folder; the caller removes it when it is done with the ids.

    Ids are whole numbers.  Null text counts as empty (the end id alone); a null id sorts first; rows with equal ids
    stay separate, ordered by their text; an empty table makes no file.  Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    out_dir = out_dir or fresh_dir(spark, "token-ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(out_dir)
        store.create_dir(folder, recursive=True)
        encode, task = encoder(tokenizer_path), TaskContext.get().partitionId()
        held = ShardWriter(planes)
        ids: list[pa.Array] = []
        sizes: list[np.ndarray] = []
        total, part = 0, 0

        def flush() -> pa.RecordBatch:
            name = f"shard-{task:06d}-{part:04d}.ids"
            lengths = np.concatenate(sizes).tolist()
            data = held.finish(pa.concat_arrays(ids).to_pylist(), lengths)
            own = f"{folder}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(own) as f:
                f.write(data)
            store.move(own, f"{folder}/{name}")
            return pa.RecordBatch.from_pylist([{"task": task, "part": part, "file": name, "n_docs": len(lengths), "n_ids": total, "n_bytes": len(data)}], schema=SHARD)

        for batch in batches:
            for begin, end in runs_of(batch.column(1)):
                texts = batch.column(1).slice(begin, end - begin)
                if end == begin + 1 and encode.by_piece and texts[0].is_valid:
                    found, counts = zip(*(encode(pa.array([t])) for t in pieces_of(texts[0].as_py())), strict=True)
                    found, counts = np.concatenate(found), np.array([sum(int(c[0]) for c in counts)])
                else:
                    found, counts = encode(texts)
                # an end id after each document
                lengths = counts + 1
                with_ends = np.empty(len(found) + len(counts), dtype="<u4")
                inside = np.ones(len(with_ends), dtype=bool)
                inside[np.cumsum(lengths) - 1] = False
                with_ends[inside] = found
                with_ends[~inside] = end_id
                held.add(with_ends)
                ids.append(pa.concat_arrays([batch.column(0).slice(begin, end - begin)]))
                sizes.append(lengths)
                total += len(with_ends)
                if total >= FILE_IDS:
                    yield flush()
                    held, ids, sizes, total, part = ShardWriter(planes), [], [], 0, part + 1
        if ids:
            yield flush()

    ordered = docs.select(id_col, text_col).repartitionByRange(F.col(id_col).asc_nulls_first()).sortWithinPartitions(F.col(id_col).asc_nulls_first(), text_col)
    ordered.mapInArrow(write, SHARD_DDL).write.parquet(f"{out_dir}/files")
    return out_dir, spark.read.schema(SHARD_DDL).parquet(f"{out_dir}/files")


#: Files up to which the table of their places is broadcast.
MOST_BROADCAST = 100_000


def read_ids(spark: SparkSession, folder: str, shards: DataFrame, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row for each document of the files: id, start (ids before it), n_tokens, ids_crc32 and, if asked for, ids.

    Spark reads the files; a task decodes one at a time, so memory is bounded by the format's ids in a file.
    ``shards`` is the table that ``write_ids`` gives; running sums over its tasks and each one's files give the starts.
    """
    per_task = shards.groupBy("task").agg(F.sum("n_ids").alias("n"))  # a row for each writing task
    before = per_task.select(F.col("task").alias("_task"), (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("_before"))
    inside = F.sum("n_ids").over(Window.partitionBy("task").orderBy("part")) - F.col("n_ids")
    bases = shards.withColumn("_inside", inside).join(F.broadcast(before), F.col("task") == F.col("_task")).select(F.col("file").alias("_name"), (F.col("_before") + F.col("_inside")).alias("_base"))
    more = ", ids array<long>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = data.as_buffer()
                index = decode_index(data)
                ids = decode_chunks(data, index)
                ends = np.cumsum(np.array(index["lengths"], dtype=np.int64))
                starts = ends - np.array(index["lengths"], dtype=np.int64)
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                name = pa.array([path.rsplit("/", 1)[-1]]).dictionary_encode().take(pa.array(np.zeros(len(crc), np.int32))).cast(pa.string())
                columns = [name, pa.array(index["docs"], pa.int64()), pa.array(starts), pa.array(index["lengths"], pa.int64()), pa.array(crc, pa.int64())]
                names = ["_file", "_id", "_at", "_n", "_crc"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(np.r_[0, ends].astype(np.int32), pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder).select("path", "content")
    rows = files.mapInArrow(read, f"_file string, _id long, _at long, _n long, _crc long{more}")
    bases = F.broadcast(bases) if shards.count() <= MOST_BROADCAST else bases
    out = rows.join(bases, F.col("_file") == F.col("_name"))
    return out.select(F.col("_id").alias(id_col), (F.col("_base") + F.col("_at")).alias("start"), F.col("_n").alias("n_tokens"), F.col("_crc").alias("ids_crc32"), *(["ids"] * with_ids))
