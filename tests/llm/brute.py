"""Brute-force versions of the operators, for small fixtures."""

import math
from collections import Counter, defaultdict


def components(nodes, pairs):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in root}


def hamming_pairs(prints, most):
    """prints: (id, int of 256 bits)."""
    return {(min(a, b), max(a, b)) for i, (a, x) in enumerate(prints) for b, y in prints[i + 1 :] if a != b and (x ^ y).bit_count() <= most}


def line_dedup(docs, min_lines=2, min_words_one=50):
    """docs: (id, text), distinct ids; gives {id: (text, lines removed, lines)}."""
    seen, out = set(), {}
    for doc, text in sorted(docs):
        lines = text.split("\n")
        gone = set()
        for n in {1, min_lines}:
            for i in range(len(lines) - n + 1):
                run = tuple(lines[i : i + n])
                if n < min_lines and len(run[0].split()) < min_words_one:
                    continue
                if run in seen:
                    gone |= set(range(i, i + n))
                seen.add(run)
        out[doc] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone), len(lines))
    return out


def mix(rows, weights, share, key):
    """rows: (id, source, tokens); gives the ids in order of finish within the budget."""
    queues = defaultdict(list)
    for r in rows:
        queues[r[1]].append(r)
    timed = []
    for source, q in queues.items():
        run = 0
        for r in sorted(q, key=lambda r: (key(r[0]), r[0])):
            run += r[2]
            timed.append((run / weights.get(source, 1.0), source, key(r[0]), r[0], r[2]))
    budget, total, out = math.floor(share * sum(r[2] for r in rows)), 0, []
    for t in sorted(timed):
        total += t[4]
        if total > budget:
            break
        out.append(t[3])
    return out


def suffix_tree_bits(texts, depth, min_share, divergence, smooth):
    """log2 probability of each text under the tree of all."""
    pad = bytes(depth)
    n = defaultdict(Counter)
    for t in texts:
        s = pad + t
        for i in range(depth, len(s)):
            for k in range(depth + 1):
                n[s[i - k : i]][s[i]] += 1
    size = {c: sum(x.values()) for c, x in n.items()}
    least = max(1.0, min_share * size.get(b"", 0))
    kept = {b""}
    for c, x in n.items():
        if c and size[c] >= least:
            up = n[c[1:]]
            if sum(v * math.log((v / size[c]) / (up[b] / size[c[1:]])) for b, v in x.items()) >= divergence:
                kept |= {c[i:] for i in range(len(c) + 1)}

    def p(c, b):
        below = p(c[1:], b) if c else 1 / 256
        return (n[c][b] + smooth * below) / (size.get(c, 0) + smooth)

    out = []
    for t in texts:
        s, total = pad + t, 0.0
        for i in range(depth, len(s)):
            k = next(k for k in range(depth, -1, -1) if s[i - k : i] in kept)
            total += math.log2(p(s[i - k : i], s[i]))
        out.append(total)
    return out
