"""Token counts by rank-synchronous array merging.

A batch of pre-tokens is one flat array of symbol ids plus the pre-token that each symbol belongs to.  In every round
each pre-token finds its pair of the best rank and merges all occurrences of that pair at once; rounds go on until no
pre-token has a pair left.  The count is the number of surviving symbols.  Pre-tokens repeat, so a bounded memo keeps
the counts of short ones for the life of a Python worker.

No merge joins two characters that stand next to each other in no piece, so sequences are cut there first.  A sequence
that is still long (text without blanks) would need as many rounds over all its symbols as it has different merges; it
takes its merges in the same order from a queue instead, where only the pairs next to a merge are looked at again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
#: Pre-tokens kept by each of two generations of a worker's memo, and the longest one that is kept (characters).
MEMO_SIZE, MEMO_CHARS = 500_000, 48
#: Symbols merged at once, symbols of a sequence from which on its pairs are queued, and distinct characters up to which
#: their neighbours are looked up in a square table.
BATCH_SYMBOLS, LONG_SEQUENCE, SQUARE = 2_000_000, 512, 1024


class ArrayMerger:
    """Counts for a piece vocabulary with byte fallback (a .model file of the sentencepiece library).

    Merge order is that of the library: the pair whose joined piece has the best score first, then the leftmost.
    All occurrences of a pair merge in one round, unless the joined piece shares its score with another or is part of a
    piece of a better or equal score; such pairs merge one at a time, the leftmost first, which keeps the order exact.
    """

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        piece = {model.id_to_piece(i): i for i in ids}
        scores = {i: model.get_score(i) for i in ids}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {i: order[s] for i, s in scores.items()}
        self.base = model.get_piece_size()
        self.char = {p: i for p, i in piece.items() if len(p) == 1}
        joined = [(piece[p[:k]], piece[p[k:]], i) for p, i in piece.items() for k in range(1, len(p)) if p[:k] in piece and p[k:] in piece]
        # characters of longer pieces that are no pieces themselves still take part as the ends of merges
        self.keys = np.array([a * self.base + b for a, b, _ in joined], dtype=np.int64)
        by_key = np.argsort(self.keys)
        self.keys = self.keys[by_key]
        self.merged = np.array([i for _, _, i in joined], dtype=np.int64)[by_key]
        self.ranks = np.array([self.rank[i] for _, _, i in joined], dtype=np.int64)[by_key]
        shared = {}
        for i in {i for _, _, i in joined}:
            shared[self.rank[i]] = shared.get(self.rank[i], 0) + 1
        single = {i for _, _, i in joined if shared[self.rank[i]] > 1}
        single |= {part for a, b, i in joined for part in (a, b) if len(model.id_to_piece(part)) > 1 and self.rank[i] <= self.rank[part]}
        self.one_by_one = np.isin(self.merged, np.fromiter(single, dtype=np.int64, count=len(single)))
        inside = {c for p in piece if len(p) > 1 for c in p}
        if "\n" in inside:
            raise ValueError("pieces of this vocabulary cross line ends")
        self.apart = {c: c not in inside for c in self.char}
        self.beside = np.unique(np.array([(ord(a) << 21) + ord(b) for p in piece if len(p) > 1 for a, b in zip(p, p[1:], strict=False)], dtype=np.int64))
        self.queued: dict[int, tuple[int, int]] = {}
        self.memo: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def counts(self, words: list[str]) -> np.ndarray:
        """The number of tokens of each pre-token."""
        out = np.zeros(len(words), dtype=np.int64)
        start = 0
        while start < len(words):
            end, total = start, 0
            while end < len(words) and (end == start or total + len(words[end]) <= BATCH_SYMBOLS):
                total += len(words[end])
                end += 1
            out[start:end] = self._merge(words[start:end])
            start = end
        return out

    def _merge(self, words: list[str]) -> np.ndarray:
        text = "".join(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        distinct, where = np.unique(codes, return_inverse=True)
        sym = np.empty(len(distinct), dtype=np.int64)
        weight = np.ones(len(distinct), dtype=np.int64)
        alone = np.zeros(len(distinct), dtype=bool)
        for k, code in enumerate(distinct):
            c = chr(code)
            sym[k] = self.char.get(c, -1)
            if sym[k] < 0:
                weight[k] = len(c.encode("utf-8", "surrogatepass"))
            alone[k] = self.apart.get(c, True)
        word = np.repeat(np.arange(len(words)), lengths)
        out = np.bincount(word, weights=weight[where], minlength=len(words)).astype(np.int64)
        # sequences end at words' ends, on both sides of characters that never merge, and between two that no piece joins
        cut = alone[where]
        new = np.ones(len(codes), dtype=bool)
        new[1:] = (word[1:] != word[:-1]) | cut[1:] | cut[:-1] | ~self._joined(distinct, where)
        seq, sym = np.cumsum(new) - 1, sym[where]
        live = ~cut
        seq, sym, word = seq[live], sym[live], word[live]
        size = np.bincount(seq)
        if len(size) and size.max() > LONG_SEQUENCE:
            long = size[seq] > LONG_SEQUENCE
            at = np.flatnonzero(long)
            first = np.flatnonzero(np.r_[True, seq[at][1:] != seq[at][:-1]])
            for a, b in zip(first, np.r_[first[1:], len(at)], strict=True):
                out[word[at[a]]] -= self._queued_merges(sym[at[a:b]].tolist())
            seq, sym, word = seq[~long], sym[~long], word[~long]
        while len(sym) > 1:
            pair = np.flatnonzero((seq[1:] == seq[:-1]) & (sym[1:] >= 0) & (sym[:-1] >= 0))
            key = sym[pair] * self.base + sym[pair + 1]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[at] == key
            pair, at = pair[known], at[known]
            if not len(pair):
                break
            rank, owner = self.ranks[at], seq[pair]
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            size = np.diff(np.r_[first, len(pair)])
            best = np.repeat(np.minimum.reduceat(rank, first), size)
            chosen = rank == best
            pair, at, owner = pair[chosen], at[chosen], owner[chosen]
            # leftmost only, where the order among equals matters; else every second of a run of overlapping pairs
            head = np.r_[True, owner[1:] != owner[:-1]]
            head_at = np.repeat(at[head], np.diff(np.r_[np.flatnonzero(head), len(pair)]))
            keep = (at == head_at) & (~self.one_by_one[head_at] | head)
            pair, at = pair[keep], at[keep]
            run = np.r_[True, pair[1:] != pair[:-1] + 1]
            begin = np.flatnonzero(run)
            offset = np.arange(len(pair)) - np.repeat(begin, np.diff(np.r_[begin, len(pair)]))
            keep = offset % 2 == 0
            pair, at = pair[keep], at[keep]
            sym = sym.copy()
            sym[pair] = self.merged[at]
            out -= np.bincount(word[pair], minlength=len(out))
            stays = np.ones(len(sym), dtype=bool)
            stays[pair + 1] = False
            # sequences without a pair in this round are finished
            active = np.zeros(int(seq[-1]) + 1, dtype=bool)
            active[owner] = True
            stays &= active[seq]
            sym, seq, word = sym[stays], seq[stays], word[stays]
        return out

    def _joined(self, distinct: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Whether each character and the next one stand next to each other in some piece."""
        codes = distinct.astype(np.int64)
        known = lambda key: self.beside[np.minimum(np.searchsorted(self.beside, key), len(self.beside) - 1)] == key
        if len(codes) <= SQUARE:
            return known((codes[:, None] << 21) + codes[None, :])[where[:-1], where[1:]]
        return known((codes[where[:-1]] << 21) + codes[where[1:]])

    def _queued_merges(self, sym: list[int]) -> int:
        """The number of merges of one sequence, best rank and then leftmost first."""
        if not self.queued:
            self.queued = {k: (r, m) for k, r, m in zip(self.keys.tolist(), self.ranks.tolist(), self.merged.tolist(), strict=True)}
        pairs, base = self.queued, self.base
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        end = len(sym)

        def offer(k: int) -> tuple | None:
            right = after[k]
            if right == end or sym[k] < 0 or sym[right] < 0:
                return None
            key = sym[k] * base + sym[right]
            found = pairs.get(key)
            return (found[0], k, key, found[1]) if found else None

        queue = [x for x in map(offer, range(len(sym))) if x]
        heapify(queue)
        merges = 0
        while queue:
            _, k, key, joined = heappop(queue)
            right = after[k]
            if sym[k] < 0 or right == end or sym[k] * base + sym[right] != key:
                continue  # one of the two has merged with another symbol since
            sym[k], sym[right] = joined, -1
            after[k] = after[right]
            if after[k] < end:
                before[after[k]] = k
            merges += 1
            for x in (offer(k), offer(before[k]) if before[k] >= 0 else None):
                if x:
                    heappush(queue, x)
        return merges

    def text_counts(self, texts: list[str]) -> list[int]:
        """The number of tokens of each whole text."""
        if len(self.memo) > MEMO_SIZE:  # what is still in use moves to the new generation
            self.memo, self.older = {}, self.memo
        memo, older = self.memo, self.older
        split = [pre_tokens(t) for t in texts]
        listed: list[str] = []
        for w in {w for words in split for w in words if w not in memo}:
            if w in older:
                memo[w] = older[w]
            else:
                listed.append(w)
        fresh: dict[str, int] = {}
        if listed:
            fresh = dict(zip(listed, self.counts(listed).tolist(), strict=True))
            memo.update({w: n for w, n in fresh.items() if len(w) <= MEMO_CHARS})
            fresh = {w: n for w, n in fresh.items() if len(w) > MEMO_CHARS}
        if fresh:
            return [sum(fresh[w] if w in fresh else memo[w] for w in words) for words in split]
        return [sum(map(memo.__getitem__, words)) for words in split]


_RUNS = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")


def pre_tokens(text: str) -> list[str]:
    """Runs of word-start marks with what follows them, and line ends; no merge crosses from one to the next."""
    if not text:
        return []
    marked = (SPACE + text).replace(" ", " " + SPACE)
    if "  " in text or text[0] == " " or SPACE in text:
        return _RUNS.findall(marked.replace(" ", ""))
    return marked.replace("\n", " \n ").split(" ")


_mergers: dict[str, ArrayMerger] = {}


def merger(model_path: str) -> ArrayMerger:
    """The merger of a vocabulary file, made once for each Python worker."""
    if model_path not in _mergers:
        _mergers[model_path] = ArrayMerger(model_path)
    return _mergers[model_path]


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", rows_at_once: int = 256) -> DataFrame:
    """One row for each row of ``docs``: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Counts are those of the vocabulary's own library over the whole text, without begin, end or added special tokens.
    A narrow stage: no shuffle, memory bounded by ``rows_at_once`` texts and the memo.

    Null text counts as empty (0 bytes, 0 tokens); null and repeated ids are kept as they are, row for row; an empty
    table gives no rows.  Other columns of ``docs`` are not read, so their names cannot clash.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merger(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(at, rows_at_once)
                texts = ["" if t is None else t for t in part.column(1).to_pylist()]
                n = own.text_counts(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())],
                    names=[id_col, "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.select(id_col, text_col).mapInArrow(count, f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")
