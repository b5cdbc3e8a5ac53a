"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import string

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def near_duplicates(rows, size=2, percent=80):
    """{doc_id: (n_shingles, component_id)} of rows (doc_id, text)."""
    sets = {}
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(LOWER)) if x]
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    ids = sorted(sets)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                n = len(a & b)
                if 100 * n >= percent * (len(a) + len(b) - n):
                    p, q = sorted((root(ids[x]), root(ids[y])))
                    up[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def repeated_bytes(rows, length=200):
    """{doc_id: (n_bytes, n_removed, n_spans, kept_sha256)} of rows (doc_id, text)."""
    raw = {i: (t or "").encode() for i, t in rows}
    seen: dict[bytes, int] = {}
    for b in raw.values():
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            seen[w] = seen.get(w, 0) + 1
    out = {}
    for i, b in raw.items():
        end, removed, spans, kept = 0, 0, 0, bytearray()
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                if p > end or (p == 0 and not spans):
                    kept += b[end:p]
                    spans += 1
                elif not spans:
                    spans += 1
                removed += p + length - max(end, p)
                end = p + length
        kept += b[end:]
        out[i] = (len(b), removed, spans, hashlib.sha256(kept).hexdigest())
    return out


def mix(rows, weights=(5, 2, 1), cap=3):
    """{source: target} of rows (source, size)."""
    total, sizes = 0, {}
    for s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
        total += n
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), float(total)
    while True:
        full = {s for s in open_ if left * w[s] / sum(w[x] for x in open_) > cap * sizes[s]}
        if not full:
            break
        for s in full:
            target[s] = float(cap * sizes[s])
            left -= target[s]
        open_ -= full
    for s in open_:
        target[s] = left * w[s] / sum(w[x] for x in open_)
    return target


def pareto(rows, weights=(5, 2, 1), cap=3):
    """Copies of rows (source, size, 64-bit number): whole copies, then a sequential draw in Pareto order, then the smallest that is left if it comes closer."""
    target, sizes = mix([r[:2] for r in rows], weights, cap), {}
    for s, n, _ in rows:
        sizes[s] = sizes.get(s, 0) + n
    copies = [0] * len(rows)
    for s, t in target.items():
        e = t / sizes[s] if sizes[s] else 0.0
        base = min(int(e), cap)
        p, gap, order = e - base, t - base * sizes[s], []
        for k, (source, n, h) in enumerate(rows):
            if source == s and n:
                copies[k] = base
                u = ((h % (1 << 64) >> 11) + 0.5) / (1 << 53)
                order.append((u * (1 - p) / (u * (1 - p) + (1 - u) * p) if p else 1.0, h, n, k))
        if base == cap:
            continue
        left = []
        for v, h, n, k in sorted(order):
            if n <= gap:
                copies[k] += 1
                gap -= n
            else:
                left.append((n, v, h, k))
        if left and min(left)[0] < 2 * gap:
            copies[min(left)[3]] += 1
    return copies
