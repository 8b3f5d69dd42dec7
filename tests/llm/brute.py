"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def rule_stats(text):
    text = text or ""
    w = words(text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if words(x)]
    stats = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
    return (*stats, len(w) < 50 or 100 * len(covered) > 50 * len(w))


def bad_hosts(rows, limit=0.5):
    """Hosts of (host, failed) rows whose shrunk failure rate is above the limit."""
    n, k = Counter(h for h, _ in rows), Counter(h for h, f in rows if f)
    total = sum(n.values())
    mean = sum(k.values()) / total
    spread = sum(n[h] * (k[h] / n[h] - mean) ** 2 for h in n) / total
    noise = mean * (1 - mean) * len(n) / total
    weight = min(max(mean * (1 - mean) / max(spread - noise, 1e-9) - 1, 1.0), 1e6)
    return {h for h in n if (k[h] + mean * weight) / (n[h] + weight) > limit}


def shingle_set(text, size):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}


def components(rows, percent, size):
    """doc_id -> smallest id reachable; rows of (doc_id, text) with distinct ids."""
    sets = {d: shingle_set(t, size) for d, t in rows}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    shared = Counter((a, b) for ids in holders.values() for i, a in enumerate(sorted(ids)) for b in sorted(ids)[i + 1 :])
    for (a, b), i in shared.items():
        if 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {d: find(d) for d in sets}, {d: len(s) for d, s in sets.items()}


def covered_bytes(rows, window=50):
    """(doc_id, bytes, cover flags) of (doc_id, text) rows: bytes of strings that start in a document with a smaller id."""
    key = lambda r: (r[0] is None, r[0] or 0)
    first = {}
    for doc_id, text in sorted(rows, key=key):
        data = (text or "").encode()
        for i in range(len(data) - window + 1):
            first.setdefault(data[i : i + window], key((doc_id,)))
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        cover = bytearray(len(data))
        for i in range(len(data) - window + 1):
            if first[data[i : i + window]] < key((doc_id,)):
                cover[i : i + window] = b"\1" * window
        out.append((doc_id, data, bytes(cover)))
    return out


def removal(rows):
    return [
        (d, len(data), sum(c), sum(1 for x in c.split(b"\0") if x), hashlib.sha256(bytes(x for x, f in zip(data, c, strict=True) if not f)).hexdigest())
        for d, data, c in covered_bytes(rows)
    ]


def text_without(data, cover):
    """Characters of which at least one byte is not covered."""
    out, at = [], 0
    for ch in data.decode():
        n = len(ch.encode())
        if not all(cover[at : at + n]):
            out.append(ch)
        at += n
    return "".join(out)
