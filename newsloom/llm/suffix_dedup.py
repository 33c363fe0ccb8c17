"""Exact substring dedup: every byte covered by a string of MIN_BYTES that also starts earlier goes.

Three steps, all of them Spark stages.  Hashes only choose what is compared; every removal rests on equal bytes.

1. Anchors.  A window of MIN_BYTES bytes is filed under its least-hashed K-gram (its anchor).  Equal windows have equal
   anchors at equal offsets, so only windows whose anchor occurs twice can repeat.  Consecutive windows share an anchor;
   they travel as one entry.  Entries of one batch of the scan whose spanned bytes are equal collapse to the earliest
   one, so that a passage which very many documents hold reaches its bucket once for each batch.
2. Suffix sorting.  Spans of anchors that occur twice get their bytes by a join on the document and go to buckets by
   anchor: a bucket holds all suffixes that could be equal to one of its own.  The spans of an anchor with very many of
   them are dealt out by the bytes that their windows share around the anchor.  In a bucket equal spans collapse to the
   earliest one, and the suffixes of the others are sorted blockwise with a difference cover (Karkkainen, 2007): sample
   suffixes at the cover's residues are ranked by prefix doubling; then one block of suffixes after the other is sorted
   by its first PERIOD bytes, and ties, however long, are settled by the ranks of two sample suffixes at the same
   distance.  Neighbours with a common prefix of MIN_BYTES form a class; all its members but the earliest are repeats.
3. Removal.  The repeats' spans meet their documents by a join, and covered bytes are cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.tables import fresh_dir

MIN_BYTES, K = 100, 24
#: Text bytes hashed at once, text bytes for each bucket of the suffix sort, and suffixes sorted at once.
PART_BYTES, BUCKET_BYTES, BLOCK_SUFFIXES = 1 << 20, 4 << 20, 1 << 19
#: Buckets of a task, tasks of a stage at most, spans of an anchor above which they are dealt out, and windows of a part.
TASK_BUCKETS, MOST_TASKS, HOT, PART_WINDOWS = 4, 20_000, 512, 10
#: The period of the difference cover and its residues: every distance modulo PERIOD is one between two residues.
PERIOD, COVER = 32, (1, 2, 3, 4, 8, 12, 20)
NO_ID = -(1 << 63)

_U = np.uint64
_MASK_POS = _U((1 << 21) - 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15 | 1
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        a = np.full(n + 1, b, dtype=_U)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(29))) * _U(0xA0761D6478BD642F)
    return h ^ (h >> _U(32))


_BYTE = _mix(np.arange(1, 257, dtype=_U) * _U(0x2545F4914F6CDD1D)) | _U(1)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def find_anchors(data: bytes, starts: np.ndarray, ends: np.ndarray, span: int = MIN_BYTES, k: int = K) -> dict[str, np.ndarray]:
    """Anchor entries of the texts [starts, ends) of one buffer: text number, hash h, offset of the anchor in the span
    (off), windows minus one (n), first window's start in the text (lo), and the spanned bytes' fingerprint (ctx)."""
    size = len(data)
    width = span - k + 1
    if size not in _tables:
        _tables.clear()
        _tables[size if size > PART_BYTES + span else PART_BYTES + span] = _powers(max(size, PART_BYTES + span))
    up, down = next(iter(_tables.values()))
    total = np.zeros(size + 1, dtype=_U)
    np.cumsum(_BYTE[np.frombuffer(data, dtype=np.uint8)] * up[:size], out=total[1:])
    grams = size - k + 1
    h = _mix((total[k:] - total[:grams]) * down[:grams])
    least = (h & ~_MASK_POS) | np.arange(grams, dtype=_U)
    have = 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    at = (least & _MASK_POS).astype(np.int64)
    windows = np.maximum(ends - starts - span + 1, 0)
    if not windows.sum():
        return {}
    text = np.repeat(np.arange(len(starts)), windows)
    p = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(starts, windows)
    at = at[p]
    head = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (p[1:] != p[:-1] + 1)])
    lo, hi, at, text = p[head], p[np.r_[head[1:], len(p)] - 1], at[head], text[head]
    ctx = _mix((total[hi + span] - total[lo]) * down[lo])
    return {"text": text, "h": h[at], "off": (at - lo).astype(np.uint8), "n": (hi - lo).astype(np.uint8), "lo": lo - starts[text], "ctx": ctx}


def parts_of(texts: list[bytes], limit: int = PART_BYTES, span: int = MIN_BYTES) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(buffer, starts, ends, text numbers, offsets in the text) of parts of about ``limit`` bytes; a longer text is cut
    into overlapping pieces, so that each of its windows is in exactly one part."""
    held, starts, ends, numbers, bases, total = [], [], [], [], [], 0
    for number, data in enumerate(texts):
        for base in range(0, max(len(data) - span + 1, 0), limit):
            piece = data[base : base + limit + span - 1]
            if total and total + len(piece) > limit:
                yield b"".join(held), np.array(starts), np.array(ends), np.array(numbers), np.array(bases)
                held, starts, ends, numbers, bases, total = [], [], [], [], [], 0
            held.append(piece)
            starts.append(total)
            total += len(piece)
            ends.append(total)
            numbers.append(number)
            bases.append(base)
    if held:
        yield b"".join(held), np.array(starts), np.array(ends), np.array(numbers), np.array(bases)


# ---- packed columns that go through shuffles as one binary value --------------------------------------------------


def pack(*columns: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed; short and sorted numbers take few bytes."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(len(columns[0]).to_bytes(8, "little") + b"".join(planes))


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T.copy().view(kind).ravel())
        at += n * size
    return out


ENTRY = ("<u8", "<i8", "<u8", "<i8", "u1", "u1")  # h, oid, key, lo, off, n
_H, _CTX = _U((1 << 48) - 1), _U((1 << 56) - 1)


def collapse(texts: list[bytes], text, h, ctx, oid, key, lo, off, n, span: int = MIN_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, repeat): entries sorted by hash and span, then by document and place; which of the sorted ones
    come first of their span, and which have an earlier one.

    Spans with equal fingerprints are compared byte by byte with the first of them; one that differs counts as a first.
    """
    order = np.lexsort((lo, key, oid, n, off, ctx, h))
    cols = [c[order] for c in (h, ctx, off, n)]
    first = np.ones(len(order), dtype=bool)
    if len(order) > 1:
        first[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    lead = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    same = [(c[order] == c[order][lead]) for c in (oid, key, lo)]
    repeat = ~first & ~np.logical_and.reduce(same)
    own, at, size = text[order].tolist(), lo[order].tolist(), n[order].tolist()
    for k, j in zip(np.flatnonzero(repeat).tolist(), lead[repeat].tolist(), strict=True):
        length = size[k] + span
        if texts[own[k]][at[k] : at[k] + length] != texts[own[j]][at[j] : at[j] + length]:
            first[k], repeat[k] = True, False
    return order, first, repeat


MARK = pa.schema([("oid", pa.int64()), ("key", pa.int64()), ("lo", pa.int64()), ("n", pa.int32()), ("off", pa.int32()), ("h", pa.int64()), ("hot", pa.bool_())])
MARK_DDL = "oid long, key long, lo long, n int, off int, h long, hot boolean"


def _marks(oid, key, lo, n, off=None, h=None, hot=None) -> pa.RecordBatch:
    """Rows of spans: off is null for repeats that are already known, else the rows still have to be sorted."""
    none = pa.nulls(len(oid))
    more = [none.cast(t) for t in (pa.int32(), pa.int64(), pa.bool_())] if off is None else [pa.array(off.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(hot)]
    return pa.RecordBatch.from_arrays([pa.array(oid), pa.array(key.view(np.int64)), pa.array(lo), pa.array(n.astype(np.int32)), *more], schema=MARK)


def _runs(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, length) of runs of consecutive integers in a sorted array."""
    head = np.flatnonzero(np.r_[True, value[1:] != value[:-1] + 1])
    return value[head], np.diff(np.r_[head, len(value)])


# ---- blockwise suffix sorting with a difference cover -------------------------------------------------------------


def _cover_distance() -> np.ndarray:
    table = np.full((PERIOD, PERIOD), -1, dtype=np.int64)
    inside = np.isin(np.arange(2 * PERIOD) % PERIOD, COVER)
    for i in range(PERIOD):
        for j in range(PERIOD):
            table[i, j] = next(d for d in range(PERIOD) if inside[i + d] and inside[j + d])
    return table


DISTANCE = _cover_distance()


def _dense(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Dense ranks, equal for equal keys, from the order that sorts the keys."""
    new = np.zeros(len(order), dtype=np.int64)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.cumsum(new)
    return rank


class CoverSorter:
    """Sorts suffixes of one buffer, block by block, to a depth of at least 4 * PERIOD bytes."""

    def __init__(self, text: np.ndarray):
        self.text = np.r_[text, np.zeros(5 * PERIOD + 8, dtype=np.uint8)]
        self.n = len(text)
        # the 8 bytes from each place on, as one number that sorts like them
        places = len(self.text) - 7
        self.word = np.empty(places, dtype=_U)
        raw = self.text.tobytes()
        for s in range(8):
            count = (len(raw) - s) // 8
            part = np.frombuffer(raw, dtype=">u8", count=count, offset=s)
            self.word[s::8] = part[: len(self.word[s::8])]
        self._rank_samples()

    def _rank_samples(self) -> None:
        inside = np.isin(np.arange(self.n + PERIOD) % PERIOD, COVER)
        at = np.flatnonzero(inside)
        keys = [self.word[at + 8 * k] for k in range(PERIOD // 8)]
        rank = _dense(np.lexsort(keys[::-1]), *keys)
        self.rank = np.zeros(self.n + 5 * PERIOD, dtype=np.int64)
        for ahead in (PERIOD, 2 * PERIOD):  # depth PERIOD, then 2 * PERIOD, then 4 * PERIOD
            self.rank[at] = rank + 1
            pair = (rank + 1) * np.int64(len(at) + 2) + self.rank[at + ahead]
            rank = _dense(np.argsort(pair, kind="stable"), pair)
        self.rank[at] = rank + 1

    def blocks(self, suffixes: np.ndarray, size: int = BLOCK_SUFFIXES) -> Iterator[np.ndarray]:
        """The suffixes sorted, in blocks between splitters; equal first bytes are never parted."""
        if len(suffixes) <= size:
            yield self._sort(suffixes)
            return
        lead = self.word[suffixes]
        count = -(-len(suffixes) // size)
        cuts = np.unique(np.quantile(lead[:: max(1, len(lead) // 65536)].astype(np.float64), np.arange(1, count) / count).astype(_U))
        block = np.searchsorted(cuts, lead, side="right")
        for b in range(len(cuts) + 1):
            if len(own := suffixes[block == b]):
                yield self._sort(own)

    def _sort(self, s: np.ndarray) -> np.ndarray:
        keys = [self.word[s + 8 * k] for k in range(PERIOD // 8)]
        order = np.lexsort(keys[::-1])
        group = _dense(order, *keys)[order]
        s = s[order]
        size = np.bincount(group)
        active = np.flatnonzero(size[group] > 1)
        label = group[active]
        while len(active):
            # the middle one of each tied group is its pivot; the cover's ranks tell less, equal and greater
            head = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
            count = np.diff(np.r_[head, len(label)])
            pivot = np.repeat(s[active[head + count // 2]], count)
            own = s[active]
            ahead = DISTANCE[own % PERIOD, pivot % PERIOD]
            sign = np.sign(self.rank[own + ahead] - self.rank[pivot + ahead])
            label = np.repeat(np.arange(len(head)), count) * 3 + sign + 1
            move = np.argsort(label, kind="stable")
            s[active] = own[move]
            label, sign = label[move], sign[move]
            left = np.bincount(label, minlength=int(label[-1]) + 1)[label] > 1
            left &= sign != 0
            active, label = active[left], label[left]
        return s

    def same(self, a: np.ndarray, b: np.ndarray, length: int = MIN_BYTES) -> np.ndarray:
        """Whether the suffixes a[i] and b[i] share their first ``length`` bytes."""
        out = np.ones(len(a), dtype=bool)
        for k in [*range(0, length - 7, 8), length - 8]:
            out &= self.word[a + k] == self.word[b + k]
        return out


def repeats_in(contexts: list[bytes], oid: np.ndarray, key: np.ndarray, lo: np.ndarray, n: np.ndarray, span: int = MIN_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans (oid, key, lo, n) of windows that start earlier as well; context i holds the bytes of the n[i] + 1 windows
    that start at lo[i] and after it."""
    lengths = np.fromiter(map(len, contexts), dtype=np.int64, count=len(contexts))
    begin = np.cumsum(lengths) - lengths
    sorter = CoverSorter(np.frombuffer(b"".join(contexts), dtype=np.uint8))
    count = n.astype(np.int64) + 1
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    suffixes = np.repeat(begin, count) + inside
    by_doc = np.lexsort((key, oid))
    doc = _dense(by_doc, oid, key)
    place = np.zeros(len(sorter.text), dtype=np.int64)  # of each suffix: document rank and start, in one number
    place[suffixes] = (np.repeat(doc, count) << 36) + np.repeat(lo, count) + inside
    found = []
    for s in sorter.blocks(suffixes):
        new = np.r_[True, ~sorter.same(s[1:], s[:-1], span)]
        head = np.flatnonzero(new)
        own = place[s]
        least = np.repeat(np.minimum.reduceat(own, head), np.diff(np.r_[head, len(s)]))
        found.append(own[own > least])
    if not found or not (every := np.unique(np.concatenate(found))).size:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty.view(_U), empty, empty
    first, length = _runs(every)
    number = by_doc[np.searchsorted(doc[by_doc], first >> 36)]
    return oid[number], key[number], first & ((1 << 36) - 1), length - 1


# ---- the Spark stages ---------------------------------------------------------------------------------------------


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(oid, key, text, id): oid orders documents (null ids first); key tells rows of one id apart, and is 0 throughout
    if all ids are unique."""
    per_id = docs.groupBy(id_col).agg(F.count("*").alias("c"))
    unclear = not per_id.where((F.col("c") > 1) | F.col(id_col).isNull()).isEmpty()
    key = F.xxhash64(id_col, text_col) if unclear else F.lit(0).cast("long")
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("oid"), key.alias("key"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))


def _scan(rows: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            oid, key = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(_U)
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]
            found = []
            for data, starts, ends, numbers, bases in parts_of(texts):
                got = find_anchors(data, starts, ends)
                if got:
                    got["lo"] = got["lo"] + bases[got["text"]]
                    got["text"] = numbers[got["text"]]
                    found.append(got)
            if not found:
                continue
            e = {c: np.concatenate([f[c] for f in found]) for c in found[0]}
            cols = (e["h"] & _H, e["ctx"] & _CTX, oid[e["text"]], key[e["text"]], e["lo"], e["off"], e["n"])
            order, first, repeat = collapse(texts, e["text"], *cols)
            h, _, own, own_key, lo, off, n = (c[order] for c in cols)
            if repeat.any():
                yield _entries(np.full(1, int(own[0] % buckets)), [b""], [pack(own[repeat], own_key[repeat], lo[repeat], n[repeat])])
            keep = np.flatnonzero(first)
            which = (h[keep] % _U(buckets)).astype(np.int64)
            by = np.lexsort((lo[keep], own[keep], which))
            keep, which = keep[by], which[by]
            cut = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
            ends_at = np.r_[cut[1:], len(keep)]
            names, packed = which[cut], []
            for a, b in zip(cut, ends_at, strict=True):
                k = keep[a:b]
                packed.append(pack(h[k], np.diff(own[k], prepend=0), own_key[k], lo[k], off[k], n[k]))
            yield _entries(names, packed, [b""] * len(packed))

    return rows.select("oid", "key", "text").mapInArrow(run, "bucket long, entries binary, repeats binary")


def _entries(bucket, entries, repeats) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(entries, pa.binary()), pa.array(repeats, pa.binary())], names=["bucket", "entries", "repeats"])


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """The rows of each bucket, of batches that are sorted by bucket."""
    bucket, held = None, []
    for batch in batches:
        for own, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != bucket:
                if held:
                    yield bucket, held
                bucket, held = own, []
            held.append(row)
    if held:
        yield bucket, held


def _meet(hot: int):
    """Known repeats, and the entries of each bucket whose anchor has several; no bytes are here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(batches):
            parts = []
            for entries, repeats in rows:
                if repeats:
                    yield _marks(*unpack(repeats, "<i8", "<u8", "<i8", "u1"))
                if entries:
                    part = unpack(entries, *ENTRY)
                    part[1] = np.cumsum(part[1])
                    parts.append(part)
            if not parts:
                continue
            cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
            order = np.argsort(cols[0], kind="stable")
            h, oid, key, lo, off, n = (c[order] for c in cols)
            head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            size = np.diff(np.r_[head, len(h)])
            count = np.repeat(size, size)
            if (several := count > 1).any():
                yield _marks(oid[several], key[several], lo[several], n[several], off[several], h[several], count[several] > hot)

    return run


def parts_around(data: bytes, lo: int, n: int, off: int, span: int = MIN_BYTES, size: int = PART_WINDOWS) -> Iterator[tuple[int, int, int]]:
    """(hash, lo, n) of the parts of a span: windows whose anchors are at neighbouring offsets, under a hash of the
    bytes that all windows at these offsets hold.  Equal windows are in parts of equal hashes."""
    anchor = lo + off
    for g in range((off - n) // size, off // size + 1):
        high, low = min(off, size * g + size - 1), max(off - n, size * g)
        yield xxhash.xxh64_intdigest(data[anchor - size * g : anchor - size * g - size + 1 + span], g), anchor - high, high - low


def _cut(buckets: int, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[int, list] = {}
            for oid, key, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                for s in spans:
                    parts = parts_around(data, s["lo"], s["n"], s["off"], span) if s["hot"] else ((s["h"], s["lo"], s["n"]),)
                    for h, lo, n in parts:
                        out.setdefault(h % buckets, []).append((oid, key, lo, n, data[lo : lo + n + span]))
            packed = []
            for rows in out.values():
                oid, key, lo, n, data = zip(*rows, strict=True)
                packed.append((pack(np.array(oid, np.int64), np.array(key, np.int64), np.array(lo, np.int64), np.array(n, np.int64)), zstandard.ZstdCompressor(level=1).compress(b"".join(data))))
            if packed:
                yield _entries(list(out), [a for a, _ in packed], [b for _, b in packed])

    return run


def equal_spans(contexts: list[bytes], oid: np.ndarray, key: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of each group of equal contexts, others of a group that are repeats of its first)."""
    seen: dict[bytes, int] = {}
    lead = np.arange(len(contexts))
    for k in np.lexsort((lo, key, oid)).tolist():
        lead[k] = seen.setdefault(contexts[k], k)
    other = (oid != oid[lead]) | (key != key[lead]) | (lo != lo[lead])
    return np.sort(np.fromiter(seen.values(), np.int64, count=len(seen))), np.flatnonzero(other)


def _sort_buckets(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(batches):
            meta = [unpack(m, "<i8", "<i8", "<i8", "<i8") for m, _ in rows]
            oid, key, lo, n = (np.concatenate(c) for c in zip(*meta, strict=True))
            data = b"".join(zstandard.ZstdDecompressor().decompress(d) for _, d in rows)
            ends = np.cumsum(n + span)
            contexts = [data[a:b] for a, b in zip((ends - n - span).tolist(), ends.tolist(), strict=True)]
            first, repeat = equal_spans(contexts, oid, key, lo)
            if len(repeat):
                yield _marks(oid[repeat], key[repeat].view(_U), lo[repeat], n[repeat])
            oid, key, lo, n = repeats_in([contexts[k] for k in first.tolist()], oid[first], key[first].view(_U), lo[first], n[first], span)
            if len(oid):
                yield _marks(oid, key, lo, n)

    return run


def _remove(id_col: str, span: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, digests, kept_texts = [], [], [], [], []
            for text, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                kept, at, runs, gone = [], 0, 0, 0
                end = -1
                for lo, stop in sorted((m["lo"], m["lo"] + m["n"] + span) for m in marks or ()):
                    if lo > end:
                        kept.append(data[at:lo])
                        runs += 1
                        end = lo
                    if stop > end:
                        gone += stop - end
                        end = at = stop
                kept.append(data[at:])
                left = b"".join(kept)
                sizes.append(len(data))
                removed.append(gone)
                spans.append(runs)
                digests.append(hashlib.sha256(left).hexdigest())
                kept_texts.append(left.decode("utf-8", "replace"))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
            names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns.append(pa.array(kept_texts, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside drop their shuffle files when they end; the session's own choice is put back."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row for each row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept_text.

    A byte is removed if a string of MIN_BYTES bytes inside one text covers it that also starts earlier, in a document
    of a smaller id or earlier in the same one.  Buckets grow in number with the text, so what a task holds does not;
    of an anchor with more than HOT spans a task holds the spans' places, 34 bytes each, and their bytes in parts.

    Ids are whole numbers.  Null text is empty; a null id comes before all others; rows with the same id are documents
    of their own, in the order of a hash of id and text, and rows that are equal in both count as one document (all get
    its result); a span cut inside a character leaves a replacement mark in kept_text, never in the digest; an empty
    table gives no rows; other columns are not read.
    """
    span, spark = MIN_BYTES, docs.sparkSession
    rows = _keyed(docs, id_col, text_col)
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    buckets = max(16, -(-total // BUCKET_BYTES))
    tasks = min(-(-buckets // TASK_BUCKETS), MOST_TASKS)
    path, sorted_path = fresh_dir(spark, "suffix-marks"), fresh_dir(spark, "suffix-repeats")
    with short_shuffles(spark):
        _scan(rows, buckets).repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet(HOT), MARK_DDL).write.parquet(path)
        marks = spark.read.schema(MARK_DDL).parquet(path)
        open_spans = marks.where("off is not null").groupBy("oid", "key").agg(F.collect_list(F.struct("lo", "n", "off", "h", "hot")).alias("spans"))
        cut = rows.select("oid", "key", "text").join(open_spans, ["oid", "key"]).select("oid", "key", "text", "spans").mapInArrow(_cut(buckets, span), "bucket long, entries binary, repeats binary")
        cut.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_sort_buckets(span), MARK_DDL).write.parquet(sorted_path)
    known = marks.where("off is null").unionByName(spark.read.schema(MARK_DDL).parquet(sorted_path))
    spans = known.groupBy("oid", "key").agg(F.collect_list(F.struct("lo", "n")).alias("spans"))
    out = rows.join(spans, ["oid", "key"], "left").select("id", "text", "spans")
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    return out.mapInArrow(_remove(id_col, span, with_text), schema)
