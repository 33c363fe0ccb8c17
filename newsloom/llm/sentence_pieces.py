"""SentencePiece encoding and decoding of merge-type vocabularies by a score-ordered agenda.

A pre-token's symbols are its characters.  An agenda holds every pair of neighbours that is a piece, the best score first
and the leftmost among equals; taking a pair merges it and offers the two pairs that the new symbol makes.  What is left
are the pieces; characters that are none become byte pieces.  Decoding goes the other way.  Both are checked against the
sentencepiece library, batch by batch: the ids of each pre-token that a worker meets for the first time, and the text
that each row's ids decode to.

Pre-tokens are runs of word-start marks with what follows them.  Where some piece crosses such a border, or a line end,
the whole text is one sequence.  Pre-tokens repeat, so a bounded memo keeps the ids of short ones for the life of a
Python worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
#: Pre-tokens in each of two generations of a worker's memo, and the longest that is kept (characters).
MEMO_SIZE, MEMO_CHARS = 300_000, 48
#: Symbols up to which the agenda is a list (above, a heap), and the cost of a pair that is no piece.
SHORT, NO_PIECE = 40, float("inf")
#: Characters of text that a batch holds before it goes on (a longer text is a batch of its own).
BATCH_CHARS = 4 << 20

_RUNS = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")


class PieceCodec:
    """Ids of texts and texts of ids for one .model file.

    Takes merge-type models with identity normalisation that keep all white space (blanks become word-start marks), with
    or without byte fallback and the mark before the text; raises ValueError for others.  With ``check``, ``unlike``
    collects the pre-tokens for which the library gives other ids.
    """

    def __init__(self, model_path: str, check: bool = False):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as layout

        proto = layout.ModelProto()
        with open(model_path, "rb") as f:
            proto.ParseFromString(f.read())
        spec, kind = proto.normalizer_spec, layout.ModelProto.SentencePiece
        if proto.trainer_spec.model_type != layout.TrainerSpec.BPE or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("needs a merge-type vocabulary with identity normalisation that keeps white space")
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in proto.pieces):
            raise ValueError("vocabularies with user-defined or unused pieces are not covered")
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.prefix = spec.add_dummy_prefix
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kind.NORMAL}
        # the agenda takes the least first
        self.cost = {p.piece: -p.score for p in proto.pieces if p.type == kind.NORMAL}
        self.unknown = self.library.unk_id()
        byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kind.BYTE}
        self.bytes = [byte[b] for b in range(256)] if proto.trainer_spec.byte_fallback else None
        long = [p for p in self.ids if len(p) > 1]
        self.whole = any(SPACE in p.lstrip(SPACE) or "\n" in p for p in long)
        # decoding: what each id stands for, and which ids need care
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        self.raw = [self._octets(p, kind) for p in proto.pieces]
        self.is_byte = np.array([p.type == kind.BYTE for p in proto.pieces])
        self.is_control = np.array([p.type == kind.CONTROL for p in proto.pieces])
        self.marked = np.array([p.type == kind.NORMAL and p.piece.startswith(SPACE) for p in proto.pieces])
        self.check, self.unlike = check, set()
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _octets(self, piece, kind) -> bytes:
        if piece.type == kind.CONTROL:
            return b""
        if piece.type == kind.BYTE:
            return bytes([int(piece.piece[3:5], 16)])
        return self.library.decode([self.unknown]).encode() if piece.type == kind.UNKNOWN else piece.piece.replace(SPACE, " ").encode()

    def merged(self, word: str) -> list[str]:
        """The symbols that are left of a pre-token when no pair of neighbours is a piece."""
        if len(word) <= SHORT:
            return self._merged_short(word)
        cost, end = self.cost, len(word)
        sym: list[str | None] = list(word)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        # an entry names its pair by place and joined text; it is stale once either symbol has changed
        agenda = [(cost[p], k, p) for k, p in enumerate(map(str.__add__, sym, sym[1:])) if p in cost]
        heapify(agenda)
        while agenda:
            _, k, joined = heappop(agenda)
            left, r = sym[k], after[k]
            if left is None or r == end or len(left) + len(sym[r]) != len(joined):
                continue
            sym[k], sym[r] = joined, None
            after[k] = r = after[r]
            if r < end:
                before[r] = k
                if (p := joined + sym[r]) in cost:
                    heappush(agenda, (cost[p], k, p))
            b = before[k]
            if b >= 0 and (p := sym[b] + joined) in cost:
                heappush(agenda, (cost[p], b, p))
        return [s for s in sym if s is not None]

    def _merged_short(self, word: str) -> list[str]:
        """The same with the agenda kept as a plain list in the order of places, which short sequences search faster."""
        get, sym = self.cost.get, list(word)
        agenda = [get(p, NO_PIECE) for p in map(str.__add__, sym, sym[1:])]
        while agenda and (best := min(agenda)) != NO_PIECE:
            k = agenda.index(best)
            joined = sym[k] + sym[k + 1]
            sym[k : k + 2] = [joined]
            del agenda[k]
            if k:
                agenda[k - 1] = get(sym[k - 1] + joined, NO_PIECE)
            if k < len(agenda):
                agenda[k] = get(joined + sym[k + 1], NO_PIECE)
        return sym

    def word_ids(self, word: str) -> list[int]:
        """The ids of one pre-token, without begin and end."""
        out: list[int] = []
        for s in self.merged(word):
            i = self.ids.get(s)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in s.encode()]
            elif not out or out[-1] != self.unknown:  # neighbours without ids are one unknown
                out.append(self.unknown)
        return out

    def pre_tokens(self, text: str) -> list[str]:
        """The sequences that merges stay inside."""
        if not text:
            return []
        marked = (SPACE + text if self.prefix else text).replace(" ", SPACE)
        if self.whole or not (self.bytes or self.unknown < 0):  # unknowns join across sequences
            return [marked]
        if not self.prefix or "  " in text or text[0] == " " or SPACE in text:
            return _RUNS.findall(marked)
        return marked.replace("\n", "\0\n\0").replace(SPACE, f"\0{SPACE}")[1:].split("\0") if "\0" not in text else _RUNS.findall(marked)

    def encode(self, texts: list[str], ends: bool = True) -> list[np.ndarray]:
        """The ids of whole texts (unsigned, 32 bits), with begin and end ids if wanted."""
        if len(self.memo) > MEMO_SIZE:  # what is still in use moves to the new generation
            self.memo, self.older = {}, self.memo
        memo, older = self.memo, self.older
        fresh: dict[str, bytes] = {}
        head, tail = (np.array([i] * ends, dtype="<u4").tobytes() for i in (self.begin, self.end))
        out = []
        for text in texts:
            words = self.pre_tokens(text)
            parts = list(map(memo.get, words))
            if None in parts:
                for k, (w, p) in enumerate(zip(words, parts, strict=True)):
                    if p is None:
                        p = memo.get(w) or older.get(w) or fresh.get(w)
                        if p is None:
                            p = fresh[w] = np.array(self.word_ids(w), dtype="<u4").tobytes()
                        if len(w) <= MEMO_CHARS:
                            memo[w] = p
                        parts[k] = p
            out.append(np.frombuffer(b"".join([head, *parts, tail]), dtype="<u4"))
        if self.check and fresh:
            self.compare(fresh)
        return out

    def compare(self, words: dict[str, bytes]) -> None:
        """Holds the ids of pre-tokens against the library's, which gets each after a line end (no piece has one)."""
        lead = "" if self.whole else "\n"
        head = len(self.library.encode(lead))
        for w, found in zip(words, self.library.encode([lead + w.replace(SPACE, " ") if lead else w[int(self.prefix) :] for w in words], num_threads=1), strict=True):
            if np.array(found[head:], dtype="<u4").tobytes() != words[w]:
                self.unlike.add(w)

    def as_library(self, text: str) -> bool:
        """Whether the library has agreed on all of the text's pre-tokens."""
        return not self.unlike or self.unlike.isdisjoint(self.pre_tokens(text))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: marks become blanks, the one before the text goes, byte pieces make UTF-8 (U+FFFD for each
        byte that makes none), begin and end ids say nothing."""
        ids = np.asarray(ids, dtype=np.int64)
        said = np.flatnonzero(~self.is_control[ids])
        if not len(said):
            return ""
        ids = ids[said[0] : said[-1] + 1]
        lost = int(self.prefix and self.marked[ids[0]])
        if len(said) == len(ids):  # else a control id may part the bytes of a character
            try:
                return b"".join(map(self.raw.__getitem__, ids.tolist()))[lost:].decode()
            except UnicodeDecodeError:
                pass
        text, is_byte = [], self.is_byte[ids]
        cuts = np.flatnonzero(np.r_[True, is_byte[1:] != is_byte[:-1]])
        for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(ids)], strict=True):
            part = b"".join(map(self.raw.__getitem__, ids[a:z].tolist()))
            text.append(_mended(part) if is_byte[a] else part.decode())
        return "".join(text)[lost:]


def _mended(data: bytes) -> str:
    """The characters of bytes, U+FFFD for each byte that belongs to none."""
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(data[at : at + e.start].decode() + "�")
            at += e.start + 1
    return "".join(out)


_codecs: dict[tuple[str, bool], PieceCodec] = {}


def codec(model_path: str, check: bool = False) -> PieceCodec:
    """The codec of a vocabulary file, made once for each Python worker."""
    if (model_path, check) not in _codecs:
        _codecs[model_path, check] = PieceCodec(model_path, check)
    return _codecs[model_path, check]


def text_batches(batch: pa.RecordBatch, column: int = 1, most: int = BATCH_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch with their texts (null: empty), each of about ``most`` characters."""
    sizes = np.cumsum([len(t) for t in batch.column(column).fill_null("").to_pylist()])
    at = 0
    while at < batch.num_rows:
        below = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, below + most, side="right")))
        part = batch.slice(at, end - at)
        yield part, part.column(column).fill_null("").to_pylist()
        at = end


def encode_texts(docs: DataFrame, model_path: str, ends: bool = True, decoded: bool = False, packed: bool = False, check: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, ids (array of int; ``packed``: binary, little-endian unsigned 32-bit integers);
    ``decoded`` adds the text that the ids decode to.

    ``check`` adds as_library: whether the library gives the same ids for all pre-tokens of the text (each is compared
    when a worker first meets it) and decodes the ids to the same text.  The check reports, it replaces nothing.  A narrow stage: no shuffle, memory bounded by a batch of texts and the memo.

    Null text counts as empty (only begin and end ids, decoding to an empty text); null and repeated ids stay, row for
    row; an empty table gives no rows; texts of any length are encoded whole.  Other columns of ``docs`` are not read, so
    their names cannot clash.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    columns = [f"`{id_col}` {kind}", f"ids {'binary' if packed else 'array<int>'}", *["decoded string"] * decoded, *["as_library boolean"] * check]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path, check)
        for batch in batches:
            for part, texts in text_batches(batch):
                ids = own.encode(texts, ends)
                if packed:
                    out = {id_col: part.column(0), "ids": pa.array([i.tobytes() for i in ids], pa.binary())}
                else:
                    offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                    out = {id_col: part.column(0), "ids": pa.ListArray.from_arrays(offsets, np.concatenate(ids).astype(np.int32))}
                same = list(map(own.as_library, texts)) if check else []
                if decoded:
                    back = list(map(own.decode, ids))
                    out["decoded"] = pa.array(back, pa.string())
                    if check:
                        same = [s and a == b for s, a, b in zip(same, back, own.library.decode([i.tolist() for i in ids], num_threads=1), strict=True)]
                if check:
                    out["as_library"] = pa.array(same, pa.bool_())
                yield pa.RecordBatch.from_pydict(out)

    return docs.select(id_col, text_col).mapInArrow(run, ", ".join(columns))


def decode_ids(df: DataFrame, model_path: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """``df`` with one more column, the text of its ids.

    Null ids give a null text, no ids an empty one.  An id outside the vocabulary, or a null among the ids, raises an
    error.  ``into`` must be no column of ``df`` (ValueError), in any case of letters.
    """
    from pyspark.sql import functions as F

    if into.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"there is a column {into} already")

    @F.pandas_udf("string")
    def decoded(column):
        own = codec(model_path)
        return column.map(lambda ids: None if ids is None else own.decode(ids))

    return df.withColumn(into, decoded(F.col(f"`{ids_col}`")))
