"""Plain versions of the contracts, row by row."""

import hashlib
import re
import zlib
from collections import defaultdict

import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def contamination(docs, items, n=10):
    """{doc_id: (n_words, n_hit, n_items, sha, contaminated)}."""
    windows = defaultdict(set)
    for item_id, text in items:
        w = words(text)
        for k in range(max(1, len(w) - n + 1) if w and item_id is not None else 0):
            windows[tuple(w[k : k + n])].add(str(item_id))
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for k in range(len(w)):
            for size in range(1, n + 1):
                got = windows.get(tuple(w[k : k + size])) if k + size <= len(w) else None
                if got:
                    ids |= got
                    hit |= set(range(k, k + size))
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def alike(x, y, least=0.8):
    """Whether two sets of shingles have that Jaccard similarity; empty ones do."""
    return len(x & y) >= least * len(x | y) if x or y else True


def components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a + 1, n):
            if linked(a, b):
                root[find(b)] = find(a)
    return [find(x) for x in range(n)]


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        s += v - 9 if v > 9 else v
    return s % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
)


def pii(text):
    return [f"{kind}:{m.start()}:{m.end()}" for kind, p, ok in PII for m in re.finditer(p, text or "") if ok(m[0])]


def crc(x):
    return zlib.crc32(str(x).encode())


def targets(sizes):
    """{source: target} by resharing until none is above twice its source."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        got = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        above = [s for s in free if got[s] > 2 * sizes[s]]
        if not above:
            return fixed | got
        fixed |= {s: 2.0 * sizes[s] for s in above}


def passes(rows):
    """{(doc_id, text): times} of (doc_id, text, source) rows; full repeats are taken or left together."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, groups = defaultdict(int), defaultdict(lambda: defaultdict(list))
    for doc_id, text, source in rows:
        sizes[source] += size(text)
        md5 = hashlib.md5((text or "").encode()).hexdigest()
        groups[source][hashlib.md5(f"{'' if doc_id is None else doc_id}:{md5}".encode()).hexdigest()].append((doc_id, text))
    goal, out = targets(sizes), defaultdict(int)
    for source, of in groups.items():
        at = 0
        for key in sorted(of):
            for p in range(2):
                if at + p * sizes[source] < int(goal[source]):
                    for row in of[key]:
                        out[row] += bool(size(row[1]))
            at += sum(size(t) for _, t in of[key])
    return out
