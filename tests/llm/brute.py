"""The operators' results by plain Python over small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base_rules(text):
    w = words(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def kept_hosts(rows):
    """Whether each (host, text) is kept."""
    rules = [base_rules(t) for _, t in rows]
    fails, count = Counter(), Counter()
    for (h, _), r in zip(rows, rules, strict=True):
        if h is not None:
            count[h] += 1
            fails[h] += r[5] or 10 * r[2] > r[1]
    rates = [fails[h] / count[h] for h in count]
    m = sum(rates) / max(1, len(rates))
    v = sum((x - m) ** 2 for x in rates) / max(1, len(rates))
    k = max(1.0, m * (1 - m) / v - 1) if v > 0 else 1e12
    bad = {h for h in count if (fails[h] + m * k) / (count[h] + k) > 0.5}
    return [not r[5] and h not in bad for (h, _), r in zip(rows, rules, strict=True)]


def line_dedup(rows, min_docs=10):
    """(n_lines, n_dropped, kept text) of (doc_id, text) rows; equal rows are one document."""
    key = lambda x: x.strip(SPACE).translate(LOWER)
    seen = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            seen[key(line)].add((d, t or ""))
    out = []
    for _, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or len(seen[key(x)]) < min_docs]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def shingles(text, n):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near(rows, n, share):
    """{doc_id: (set size, component)} of (doc_id, text) rows with ids."""
    sets = {d: shingles(t, n) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b]:
                same = len(sets[a] & sets[b])
                if 100 * same >= share * (len(sets[a]) + len(sets[b]) - same):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def tokens(text):
    return re.split(r"[\W_]+", (text or "").lower())


def leaks(text, items, window=20):
    """Item ids that overlap at any alignment with a shared seed; short items at any place that holds four fifths of them."""
    masks, out, t = ("1110101", "1101011", "10110011"), set(), tokens(text)
    for k, item in items:
        w = [x for x in tokens(item) if x]
        if len(w) < 8:
            if w and any(10 * sum(x == y for x, y in zip(t[i : i + len(w)], w, strict=True)) >= 8 * len(w) for i in range(len(t) - len(w) + 1)):
                out.add(k)
            continue
        for at in range(-len(w) + 1, len(t)):
            eq = [0 <= at + i < len(t) and t[at + i] == x for i, x in enumerate(w)]
            seeded = any(all(eq[i + j] for j, c in enumerate(m) if c == "1") and 0 <= at + i and at + i + len(m) <= len(t) for m in masks for i in range(len(w) - len(m) + 1))
            n = min(len(w), window)
            if seeded and max(sum(eq[i : i + n]) for i in range(len(w) - n + 1)) * 10 >= 8 * n:
                out.add(k)
    return out


def repeats(texts, length=400):
    """(bytes, removed, spans, sha256) of each text."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


def crc(values):
    return zlib.crc32(b"".join(v.to_bytes(4, "little") for v in values))
