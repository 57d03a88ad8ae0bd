"""Plain, slow versions of the operators, written from their definitions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def covered(n, starts, width):
    gone = [False] * n
    for s in starts:
        for k in range(s, s + width):
            gone[k] = True
    return gone


def byte_dedup(docs, width=50):
    """{doc_id: (n_bytes, n_removed, n_spans, sha)} from (doc_id, text) with distinct ids."""
    first = {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        raw = (text or "").encode()
        for k in range(len(raw) - width + 1):
            first.setdefault(raw[k : k + width], i)
    out = {}
    for i, text in docs:
        raw = (text or "").encode()
        gone = covered(len(raw), [k for k in range(len(raw) - width + 1) if first[raw[k : k + width]] < i], width)
        left = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return out


def word_dedup(docs, width=20):
    first = {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        w = words(text)
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), (i, k))
    out = {}
    for i, text in docs:
        w = words(text)
        gone = covered(len(w), [k for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] != (i, k)], width)
        left = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(left)).hexdigest())
    return out


def shingles(text, width=5):
    w = [x.lower() for x in words(text)]
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def jaccard_components(docs, percent=80, width=5):
    """{doc_id: (n_shingles, component_id)}"""
    sets = {i: shingles(t, width) for i, t in docs}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    have = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            have[x].append(i)
    shared = Counter()
    for ids in have.values():
        ids = sorted(ids)
        for n, a in enumerate(ids):
            for b in ids[n + 1 :]:
                shared[a, b] += 1
    for (a, b), both in shared.items():
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def targets(sizes, weights=(5, 2, 1), boost=1.5, most=2.0):
    """{source: target} by giving out the total until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total = boost * sum(sizes.values())
    full = set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        shares = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if shares[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else shares[s] for s in order}
        full |= over


def rule_counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)"""
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    count = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    repeat = covered(len(w), [k for k in range(len(w) - 4) if count[tuple(w[k : k + 5])] > 1], 5)
    return len(w), len("".join(x.decode() for x in w)), sum(c in "#*$%&|<>" for c in text), dup, sum(repeat)


def fold(doc_id, of):
    return zlib.crc32(str(doc_id).encode()) % of
