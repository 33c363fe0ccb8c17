"""Plain versions of the operators, for small inputs only."""

import collections
import hashlib
import re

import numpy as np
import xxhash

BLANK = r"[^\x20\x09-\x0D]+"


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def quality_counts(text):
    t = text or ""
    w = re.findall(BLANK, t)
    seen, dup, inside = set(), 0, set()
    for line in t.split("\n"):
        if re.search(BLANK, line):
            dup += line in seen
            seen.add(line)
    three = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    for i in range(len(w) - 2):
        if three[(w[i], w[i + 1], w[i + 2])] > 1:
            inside |= {i, i + 1, i + 2}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside)]


def fingerprint(text):
    w = re.findall(BLANK, lower(text))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, radius=3):
    """Least reachable id of each id, over all pairs."""
    ids = sorted(prints)
    v = np.array([prints[i] for i in ids], dtype=np.uint64)
    up = list(range(len(ids)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(v[i + 1 :] ^ v[i]) <= radius):
            a, b = top(i), top(i + 1 + int(j))
            up[max(a, b)] = min(a, b)
    return {d: ids[top(k)] for k, d in enumerate(ids)}


def contamination(text, items):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        k = min(13, len(b))
        windows = {tuple(b[p : p + k]) for p in range(len(b) - k + 1)} if k else set()
        for p in range(len(w) - k + 1 if k else 0):
            if tuple(w[p : p + k]) in windows:
                hit |= set(range(p, p + k))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


def remove_repeats(docs, size=100):
    """id -> (bytes, removed, spans, digest of what is left), documents in the order of their ids."""
    seen, out = set(), {}
    for d in sorted(docs):
        b = (docs[d] or "").encode()
        mark = bytearray(len(b))
        for p in range(len(b) - size + 1):
            s = b[p : p + size]
            if s in seen:
                mark[p : p + size] = b"\1" * size
            seen.add(s)
        left = bytes(c for c, m in zip(b, mark, strict=True) if not m)
        out[d] = (len(b), sum(mark), len([x for x in bytes(mark).split(b"\0") if x]), hashlib.sha256(left).hexdigest())
    return out


def targets(sizes):
    """The excess shared again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, done, rest = 1.5 * sum(sizes.values()), {}, set(names)
    while rest:
        level = (total - sum(done.values())) / sum(weight[s] for s in rest)
        over = [s for s in rest if level * weight[s] > 2 * sizes[s]]
        if not over:
            break
        done |= {s: 2.0 * sizes[s] for s in over}
        rest -= set(over)
    return done | {s: level * weight[s] for s in rest}
