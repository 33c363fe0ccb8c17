"""Alignment of two tokenizers' ids over the same bytes, and corpus-wide counts of the id pairs that are linked.

Interval coalescing: the tokens of both sides are byte intervals; sorted by start, with the running maximum of their
ends, a group breaks where a start reaches that maximum, which is where tokens of both sides end.  Overlapping pairs are
expanded inside the groups, and the links are those of them that end together (or all of them).

Texts are cut first where both tokenizers cut: before a single blank between two characters that are no white space.
Such chunks repeat, so each distinct chunk of a batch is tokenised and aligned once, and a bounded memo keeps short ones.

Counting: links go out as blocks, each with the dictionary of its pairs, so that the shuffles carry a pair once a block
and not once a link; the counted pairs come back by block.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.sentence_pieces import PieceCodec, text_batches
from newsloom.tables import fresh_dir

#: Chunks in each of two generations of a worker's memo, the longest that is kept, characters of chunks that are aligned
#: at once, and characters of a block.
MEMO_SIZE, MEMO_CHARS, ALIGN_CHARS, BLOCK_CHARS = 150_000, 48, 1 << 18, 4 << 20


def coalesce(a_sizes: np.ndarray, b_sizes: np.ndarray, a_text: np.ndarray, b_text: np.ndarray, overlaps: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups and links of many texts at once.

    Takes the tokens' sizes in bytes and the number of the text that each belongs to (ascending); the two sides of a text
    cover the same bytes.  Gives the group of each A token and of each B token, and the links as places in A and in B,
    ordered by A and then B.  Sizes are at least 1.
    """
    a_end, b_end = np.cumsum(a_sizes), np.cumsum(b_sizes)
    a_start, b_start = a_end - a_sizes, b_end - b_sizes
    start, end = np.r_[a_start, b_start], np.r_[a_end, b_end]
    # a text ends for both sides at one byte, so no interval crosses into the next text
    order = np.lexsort((np.r_[a_text, b_text], start))
    running = np.maximum.accumulate(end[order])
    breaks = np.r_[True, start[order][1:] >= running[:-1]] if len(order) else np.zeros(0, dtype=bool)
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(breaks) - 1
    a_group, b_group = group[: len(a_sizes)], group[len(a_sizes) :]
    first, last = np.searchsorted(b_end, a_start, side="right"), np.searchsorted(b_start, a_end, side="left")
    many = last - first
    left = np.repeat(np.arange(len(a_sizes)), many)
    right = np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    if not overlaps:
        together = a_end[left] == b_end[right]
        left, right = left[together], right[together]
    return a_group, b_group, left, right


def chunks(text: str) -> list[str]:
    """The text cut before each single blank that stands between two characters that are no white space.

    Neither tokenizer joins what such a cut parts: the byte-level pattern begins a pre-token at that blank, and no piece
    has a word-start mark inside.
    """
    out: list[str] = []
    whole = True  # whether the last chunk may end here
    for part in text.split(" "):
        if whole and part and not part[0].isspace():
            out.append(part)
        elif out:
            out[-1] += " " + part
        else:
            out.append(part)
        whole = bool(part) and not part[-1].isspace()
    return out


class Aligner:
    """Aligns a byte-level tokenizer (A, a .json file) with a merge-type one with the mark before texts (B, .model)."""

    def __init__(self, byte_level: str, pieces: str, overlaps: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        with open(byte_level) as f:
            parts = json.load(f)
        if (parts["pre_tokenizer"] or {}).get("type") != "ByteLevel" or parts["normalizer"]:
            raise ValueError("A needs a byte-level vocabulary without a normaliser")
        self.b = PieceCodec(pieces)
        if not self.b.prefix or self.b.whole or not self.b.bytes:
            raise ValueError("B needs the mark before texts, no marks inside pieces, and byte pieces")
        byte_of = {c: b for b, c in enumerate(_byte_letters())}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab(with_added_tokens=False).items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token if c in byte_of)
        self.a_size = np.array(list(map(len, self.a_bytes)), dtype=np.int64)
        self.b_size = np.array(list(map(len, self.b.raw)), dtype=np.int64)
        self.a_name, self.b_name = np.array([str(i) for i in range(len(self.a_bytes))], dtype=object), np.array([str(i) for i in range(len(self.b.raw))], dtype=object)
        self.overlaps = overlaps
        self.memo: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}

    def aligned(self, words: list[str]) -> list[tuple | None]:
        """(tokens of A, tokens of B, groups, links as packed pairs, groups as text) of chunks, each taken with a blank
        before it; None where the bytes of a side are not the chunk's own."""
        a_ids = [e.ids for e in self.a.encode_batch_fast([" " + w for w in words], add_special_tokens=False)]
        b_ids = self.b.library.encode(words, num_threads=1)
        fit = []
        for w, a, b in zip(words, a_ids, b_ids, strict=True):
            data = (" " + w).encode()
            fit.append(b"".join(map(self.a_bytes.__getitem__, a)) == data == b"".join(map(self.b.raw.__getitem__, b)))
        good = [k for k, ok in enumerate(fit) if ok]
        out: list[tuple | None] = [None] * len(words)
        if not good:
            return out
        a_many, b_many = np.array([len(a_ids[k]) for k in good]), np.array([len(b_ids[k]) for k in good])
        a, b = (np.fromiter(chain.from_iterable(ids[k] for k in good), dtype=np.int64, count=int(n.sum())) for ids, n in ((a_ids, a_many), (b_ids, b_many)))
        a_text, b_text = np.repeat(np.arange(len(good)), a_many), np.repeat(np.arange(len(good)), b_many)
        a_group, b_group, left, right = coalesce(self.a_size[a], self.b_size[b], a_text, b_text, self.overlaps)
        pairs = (a[left].astype(np.uint64) << np.uint64(32)) | b[right].astype(np.uint64)
        # the groups' text: tokens by group, A before B, each with the mark that stands before it
        group, side = np.r_[a_group, b_group], np.r_[np.zeros(len(a), dtype=np.int8), np.ones(len(b), dtype=np.int8)]
        order = np.lexsort((np.arange(len(group)), side, group))
        group, side, text = group[order], side[order], np.r_[a_text, b_text][order]
        mark = np.full(len(order), ",", dtype=object)
        mark[1:][side[1:] > side[:-1]] = "|"
        new = np.r_[True, group[1:] != group[:-1]]
        mark[new] = ";"
        head = np.r_[True, text[1:] != text[:-1]]
        mark[head] = ""
        shown = (mark + np.r_[self.a_name[a], self.b_name[b]][order]).tolist()
        text_at = np.r_[np.flatnonzero(head), len(order)].tolist()
        groups = np.bincount(text[new], minlength=len(good)).tolist()
        link_at = np.searchsorted(a_text[left], np.arange(len(good) + 1)).tolist()
        for j, k in enumerate(good):
            out[k] = (int(a_many[j]), int(b_many[j]), groups[j], pairs[link_at[j] : link_at[j + 1]].tobytes(), "".join(shown[text_at[j] : text_at[j + 1]]))
        return out

    def texts(self, texts: list[str]) -> list[tuple[int, int, int, np.ndarray, str] | None]:
        """The same for whole texts; None where a text is empty or a side's bytes differ from blank + text."""
        if len(self.memo) > MEMO_SIZE:  # what is still in use moves to the new generation
            self.memo, self.older = {}, self.memo
        memo, older = self.memo, self.older
        split = [chunks(t) if t else [] for t in texts]
        fresh: dict[str, tuple | None] = {}
        listed = []
        for w in {w for words in split for w in words if w not in memo}:
            if w in older:
                memo[w] = older[w]
            else:
                listed.append(w)
        if listed:
            for part in _parts(listed):
                for w, found in zip(part, self.aligned(part), strict=True):
                    (memo if len(w) <= MEMO_CHARS else fresh)[w] = found
        out = []
        for words in split:
            parts = [memo[w] if w in memo else fresh[w] for w in words]
            if not parts or None in parts:
                out.append(None)
                continue
            n_a, n_b, n_groups, links, shown = zip(*parts, strict=True)
            out.append((sum(n_a), sum(n_b), sum(n_groups), np.frombuffer(b"".join(links), dtype=np.uint64), ";".join(shown)))
        return out


def _parts(words: list[str]) -> Iterator[list[str]]:
    """The chunks in lists of about ALIGN_CHARS characters."""
    part, size = [], 0
    for w in words:
        part.append(w)
        size += len(w) + 1
        if size >= ALIGN_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 as such, others from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


_aligners: dict[tuple, Aligner] = {}


def aligner(byte_level: str, pieces: str, overlaps: bool) -> Aligner:
    """The aligner of two vocabulary files, made once for each Python worker."""
    key = (byte_level, pieces, overlaps)
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


BLOCK = "block long, pair long, links long, doc {0}, n_a long, n_b long, n_groups long, groups_sha256 string, groups string, places binary"


def align_blocks(docs: DataFrame, byte_level: str, pieces: str, overlaps: bool = False, groups: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of aligned texts, as two kinds of rows.

    Rows with a pair (A id * 2^32 + B id) say how many links of the block hold it.  Rows with places are texts: id,
    counts, groups (digest, or the text itself too), and for each link the place of its pair among the block's pairs in
    ascending order (little-endian, 32 bits).  A block has about BLOCK_CHARS characters; a longer text is a block of its
    own.  Block numbers are unique in one run but not the same in another, so blocks are written before they are read.
    """
    fields = BLOCK.format(docs.schema[id_col].dataType.simpleString())
    doc_type = _arrow_type(docs, id_col)
    schema = pa.schema([("block", pa.int64()), ("pair", pa.int64()), ("links", pa.int64()), ("doc", doc_type), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("groups", pa.string()), ("places", pa.binary())])

    def rows(block: int, many: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block] * many, pa.int64()) if f.name == "block" else columns[f.name] if f.name in columns else pa.nulls(many, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, block = aligner(byte_level, pieces, overlaps), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part, texts in text_batches(batch, most=BLOCK_CHARS):
                found = own.texts(texts)
                links = [f[3] if f else np.zeros(0, dtype=np.uint64) for f in found]
                codes, place, counts = np.unique(np.concatenate(links), return_inverse=True, return_counts=True)
                yield rows(block, len(codes), pair=pa.array(codes.astype(np.int64)), links=pa.array(counts.astype(np.int64)))
                ends = np.cumsum([0, *map(len, links)]).tolist()
                place = place.astype("<u4")
                shown = [f[4] if f else "" for f in found]
                numbers = {n: pa.array([f[k] if f else 0 for f in found], pa.int64()) for k, n in enumerate(("n_a", "n_b", "n_groups"))}
                digests = pa.array([hashlib.sha256(t.encode()).hexdigest() if f else "" for f, t in zip(found, shown, strict=True)], pa.string())
                places = pa.array([place[a:z].tobytes() for a, z in zip(ends, ends[1:], strict=False)], pa.binary())
                yield rows(block, len(texts), doc=part.column(0), groups_sha256=digests, places=places, **numbers, **({"groups": pa.array(shown, pa.string())} if groups else {}))
                block += 1

    return docs.select(id_col, text_col).mapInArrow(run, fields)


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, a, b, links (in the whole corpus), best: whether no pair of the same B id has more links (ties are all best).

    Blocks are summed before they are shuffled; a B id has at most one pair for each A id.
    """
    each = blocks.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("links").alias("links"))
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    counted = each.select("pair", F.shiftright("pair", 32).cast("int").alias("a"), b.cast("int").alias("b"), "links")
    return counted.withColumn("best", F.col("links") == F.max("links").over(Window.partitionBy("b")))


def align(docs: DataFrame, byte_level: str, pieces: str, overlaps: bool = False, groups: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and groups).

    A encodes blank + text, B encodes text (and adds the blank); neither gives special tokens.  Byte offsets where tokens
    of both sides end cut them into groups.  Links are the A-B pairs whose byte ranges end together (``overlaps``: that
    share a byte).  A pair's count is the number of links in all of ``docs`` that hold it.  n_best counts the links whose
    pair has the highest count among the pairs of its B id, count_sum adds up the counts of all links.  groups lists the
    ids, `a1,a2|b1;a3|b2,b3`; groups_sha256 is its digest.

    A text that is null or empty, or for which the bytes of a side are not those of blank + text (it holds a word-start
    mark of its own, for example), has no tokens: zeros, an empty groups and '' for the digest.  Null and repeated ids
    stay, row for row; an empty table gives no rows.  Other columns are not read, so their names cannot clash.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    folder = fresh_dir(spark, "alignment")
    align_blocks(docs, byte_level, pieces, overlaps, groups, id_col, text_col).write.parquet(folder)
    blocks = spark.read.parquet(folder)
    counted = pair_counts(blocks).select("pair", "links", "best")
    back = blocks.where("pair IS NOT NULL").select(F.col("block").alias("of"), "pair").join(counted, "pair").select("of", "pair", "links", "best")
    texts = blocks.where("places IS NOT NULL").drop("pair", "links")
    schema = f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + ", groups string" * groups

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        pairs = right.column("pair").to_numpy()
        order = np.argsort(pairs)
        links, best = right.column("links").to_numpy()[order], right.column("best").to_numpy()[order].astype(np.int64)
        places = [np.frombuffer(x, dtype="<u4") for x in left.column("places").to_pylist()]
        out = {
            id_col: left.column("doc"), "n_a": left.column("n_a"), "n_b": left.column("n_b"), "n_groups": left.column("n_groups"), "n_links": pa.array([len(p) for p in places], pa.int64()),
            "n_best": pa.array([int(best[p].sum()) for p in places], pa.int64()), "count_sum": pa.array([int(links[p].sum()) for p in places], pa.int64()), "groups_sha256": left.column("groups_sha256"),
        }
        return pa.table(out | ({"groups": left.column("groups")} if groups else {}))

    return texts.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(run, schema)
