"""Plain versions of the operators, one document after another."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections import defaultdict

import xxhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, schema=DOCS):
    """Rows of (doc_id, text, lang, source), or (doc_id, text)."""
    full = [(r + ("en", "a"))[:4] if len(r) == 2 else r for r in rows]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in full], schema)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fingerprint(text, n=4):
    w = words((text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fingerprints, radius=4):
    """Least key of each key's class, from {key: fingerprint}."""
    label = {k: k for k in fingerprints}
    keys = list(fingerprints)
    changed = True
    while changed:
        changed = False
        for a in keys:
            for b in keys:
                if label[b] < label[a] and (fingerprints[a] ^ fingerprints[b]).bit_count() <= radius:
                    label[a], changed = label[b], True
    return label


def line_key(line):
    return line.strip(" \t\n\x0b\f\r").translate({i: i + 32 for i in range(65, 91)})


def dedup(rows, least=10):
    """{doc_id: kept text} of rows (doc_id, text)."""
    first = {}
    for d, text in sorted(rows):
        for line in (text or "").split("\n"):
            if len(line_key(line)) >= least:
                first.setdefault(line_key(line), d)
    return {d: "\n".join(x for x in (text or "").split("\n") if first.get(line_key(x), d) == d) for d, text in rows}


def targets(sizes, weights=(1, 2, 3), limit=3):
    """{source: target} from {source: size}, the excess shared anew until no source is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    held = set()
    while True:
        rest = sum(sizes.values()) - limit * sum(sizes[s] for s in held)
        free = [s for s in order if s not in held]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > limit * sizes[s]}
        if not over:
            return {s: float(limit * sizes[s]) if s in held else share[s] for s in order}
        held |= over


def mix(rows, seed="mix"):
    """[(doc_id, source, size, target, copies)] of rows (doc_id, text, source)."""
    sizes, members = defaultdict(int), defaultdict(list)
    for d, text, source in rows:
        n = len(words(text))
        sizes[source] += n
        members[source].append((n, d))
    target = targets(sizes)
    out = []
    for source, own in members.items():
        rate = target[source] / sizes[source] if sizes[source] else 0.0
        shift = int(hashlib.md5(f"{seed}:{source or ''}".encode()).hexdigest()[:8], 16) / 2**32
        place = 0
        for (n, d), group in itertools.groupby(sorted(own, key=lambda x: (x[0], x[1] is None, x[1] or 0))):
            rows = len(list(group))
            total = math.floor((place + rows) * rate + shift) - math.floor(place * rate + shift)
            place += rows
            out += [(d, source, n, target[source], total // rows + (i < total % rows)) for i in range(rows)]
    return out


def similar_classes(texts, n=5):
    """Least key of each key's class, from {key: text}: links at a Jaccard similarity of 0.8 or more of the word shingles."""
    sets = {}
    for k, t in texts.items():
        w = words((t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets[k] = frozenset(" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()
    keys = sorted(sets)
    pairs = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    label = {k: k for k in keys}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label
