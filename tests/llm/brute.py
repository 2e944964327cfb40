"""Plain Python versions of the operators, row by row, to hold results against."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from zlib import crc32

import xxhash


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def text_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t))


def alnum_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))


def remainder(i, n):
    return crc32(("" if i is None else str(i)).encode()) % n


def secrets(t, rules, window, kinds):
    t, out = t or "", []
    for m in re.finditer(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[1]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    base, extra = sorted(out), []
    for m in re.finditer(rf"[A-Za-z0-9+/_-]{{{window},}}", t):
        if any(re.search(p, m[0]) for p in rules.allow):
            continue
        is_hex, runs = bool(re.fullmatch("[0-9A-Fa-f]+", m[0])), []
        for i in range(len(m[0]) - window + 1):
            c = Counter(m[0][i : i + window])
            if math.log2(window) - sum(n * math.log2(n) for n in c.values()) / window >= (rules.hex_bits if is_hex else rules.base64_bits):
                at = m.start() + i
                if runs and at <= runs[-1][1]:
                    runs[-1][1] = at + window
                else:
                    runs.append([at, at + window])
        extra += [(a, 3 if is_hex else 4, b) for a, b in runs if not any(s <= a and e >= b for s, _, e in base)]
    listed = lambda spans: ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)
    count = Counter(k for _, k, _ in base)
    return count[0], count[1], count[2], hashlib.sha256(listed(base).encode()).hexdigest(), listed(sorted(base + extra))


def contamination(docs, items, size=10):
    windows = defaultdict(set)
    for item, t in items:
        w = alnum_words(t)
        k = min(size, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[i : i + k])].add(item)
    sizes, out = {len(w) for w in windows}, []
    for i, t in docs:
        w, hit, found = alnum_words(t), set(), set()
        for k in sizes:
            for s in range(len(w) - k + 1):
                if (key := tuple(w[s : s + k])) in windows:
                    hit |= set(range(s, s + k))
                    found |= windows[key]
        names = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


def simhash(t, k=3):
    w = text_words(t)
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_groups(docs, bits=3):
    fps = [simhash(t) for _, t in docs]
    up = list(range(len(docs)))

    def top(x):
        while up[x] != x:
            x = up[x] = up[up[x]]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                up[top(a)] = top(b)
    low: dict = {}
    for x, (i, _) in enumerate(docs):
        if i is not None:
            low[top(x)] = min(low.get(top(x), i), i)
    return [(i, f"{fps[x]:016x}", low.get(top(x))) for x, (i, _) in enumerate(docs)]


def shares(children, budget):
    """{name: (weight, capacity)} -> {name: share}, shortage by shortage."""
    got, open_, left = {}, {k: v for k, v in children.items() if v[0] > 0 and v[1] > 0}, budget
    while open_:
        total = sum(w for w, _ in open_.values())
        short = [k for k, (w, c) in open_.items() if c <= left * w / total + 1e-9]
        if not short:
            return got | {k: left * w / total for k, (w, _) in open_.items()}
        for k in short:
            got[k] = open_[k][1]
        left -= sum(open_.pop(k)[1] for k in short)
    return got


def mix_targets(leaves, mix):
    """{(domain, lang, source): tokens} -> {leaf: target}."""
    cap = {k: v * mix.epochs for k, v in leaves.items() if all(mix.weights.get(k[:d], 1.0) > 0 for d in (1, 2, 3))}
    at = {(): float(mix.budget if mix.budget is not None else math.floor(sum(leaves.values()) * mix.share))}
    for depth in range(3):
        below: dict = {}
        for node, budget in at.items():
            names = {k[: depth + 1] for k in cap if k[:depth] == node}
            below |= shares({n: (mix.weights.get(n, 1.0), sum(v for k, v in cap.items() if k[: depth + 1] == n)) for n in names}, budget)
        at = below
    return {k: math.floor(at.get(k, 0) + 1e-6) for k in leaves}


def mix_rows(rows, mix):
    """[(domain, lang, source, id, tokens)] -> [(.., epoch)]."""
    leaves: dict = defaultdict(int)
    for *leaf, _, n in rows:
        leaves[tuple(leaf)] += n
    out = []
    for leaf, target in mix_targets(leaves, mix).items():
        own = [r for r in rows if tuple(r[:3]) == leaf]
        full = target // leaves[leaf] if leaves[leaf] else 0
        out += [(*r, e) for r in own for e in range(full)]
        left = target - full * leaves[leaf]
        if left <= 0:
            continue
        h = lambda r: int(hashlib.md5(f"{mix.seed}:{full}:{'' if r[3] is None else r[3]}".encode()).hexdigest()[:15], 16)
        by: dict = defaultdict(list)
        for r in own:
            by[h(r)].append(r)
        used = 0
        for k in sorted(by):
            used += sum(r[4] for r in by[k])
            if used > left:
                break
            out += [(*r, full) for r in by[k]]
    return out
