"""Plain versions of the corpus operators, for small inputs."""

import collections
import hashlib
import math
import re
import zlib

SPACE = r"[^\x20\x09-\x0D]+"
LOWER = {k: k + 32 for k in range(65, 91)}


def base_counts(text):
    text = text or ""
    words = re.findall(SPACE, text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(SPACE, line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def hits(docs, items):
    """{row: (n_words, n_hit, item ids)}"""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    wins = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        if w:
            for k in range(max(1, len(w) - 9)):
                wins[tuple(w[k : k + 10])].add(None if i is None else str(i))
    out = []
    for t in docs:
        w = words(t)
        hit, ids = set(), set()
        for size in {len(k) for k in wins}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in wins:
                    hit |= set(range(k, k + size))
                    ids |= wins[tuple(w[k : k + size])]
        out.append((len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids - {None})).encode()).hexdigest(), bool(hit)))
    return out


def shingles(text):
    w = re.findall(SPACE, (text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    """{doc_id: (n_shingles, component)} of (doc_id, text) with distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = collections.defaultdict(list)
    for i, s in sets.items():
        common = collections.Counter(j for g in s for j in where[g])
        for j, k in common.items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for g in s:
            where[g].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def base_scores(rows):
    tokens = {i: re.findall(SPACE, (t or "").translate(LOWER)) + ["\n"] for i, t in rows}
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i in tokens}
    counts = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {i: (held[i], len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens.items()}


def base_spans(text):
    text = text or ""
    assign = r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(assign, text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


def maximal(rows):
    """{conv_id: (n_turns, n_copies)} of (conv_id, turn, role, text)."""
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append((turn, role, text))
    lines = {c: tuple(x[1:] for x in sorted(v, key=lambda x: x[0])) for c, v in convs.items()}
    proper = {v[:k] for v in lines.values() for k in range(1, len(v))}
    out = {}
    for c in sorted(lines):
        if lines[c] not in proper:
            out.setdefault(lines[c], [c, 0])[1] += 1
    return {c: (len(v), n) for v, (c, n) in out.items()}
