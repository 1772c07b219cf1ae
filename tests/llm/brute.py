"""Plain versions of the operators, written apart from them, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text)


def base_scores(docs):
    """docs: (id, text). Rows of id, held out, tokens, known, training tokens, base score."""
    counts, rows = Counter(), []
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [*WORD.findall(lower(t or "")), None]
    for i, t in docs:
        if not out(i):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    for i, t in docs:
        x = tokens(t)
        rows.append((i, out(i), len(x), sum(counts[w] > 0 for w in x), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in x)))
    return rows


def repeats(docs, length):
    """Rows of id, bytes, removed bytes, runs, digest of the rest."""
    raws, seen = [(t or "").encode() for _, t in docs], Counter()
    for r in raws:
        seen.update(r[k : k + length] for k in range(len(r) - length + 1))
    rows = []
    for (i, _), r in zip(docs, raws, strict=True):
        gone = [False] * len(r)
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        rows.append((i, len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return rows


def later_and_near(docs, length, short):
    """Rows of id, runs of bytes whose string of ``length`` has an earlier start, bytes in strings of ``short`` that start
    elsewhere too, the longest run of these; ids must ascend."""
    raws = [(t or "").encode() for _, t in docs]
    seen, near = set(), Counter()
    for r in raws:
        near.update(r[k : k + short] for k in range(len(r) - short + 1))
    rows = []
    for (i, _), r in zip(docs, raws, strict=True):
        later, again = bytearray(len(r)), bytearray(len(r))
        for k in range(len(r) - length + 1):
            if r[k : k + length] in seen:
                later[k : k + length] = b"1" * length
            seen.add(r[k : k + length])
        for k in range(len(r) - short + 1):
            if near[r[k : k + short]] > 1:
                again[k : k + short] = b"1" * short
        rows.append((i, [m.span() for m in re.finditer(b"1+", later)], again.count(b"1"), max(map(len, re.findall(b"1+", again)), default=0)))
    return rows


def shingles(text, n=4):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def components(docs, percent=85):
    """Rows of id, set size, component; ids must differ."""
    sets, parent = {i: shingles(t) for i, t in docs}, {i: i for i, _ in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [(i, len(sets[i]), root(i)) for i in ids]


def strong_spans(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def quality(text):
    """words, word characters, symbols, duplicate lines, repeated words"""
    w = WORD.findall(text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + j for k in range(len(w) - 2) for j in range(3) if windows[tuple(w[k : k + 3])] > 1}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def revisits(rows):
    """rows: (id, payload bytes). id -> (bytes, digest, type, refers to)"""
    import base64

    groups = defaultdict(list)
    for i, p in rows:
        groups[p].append(i)
    return {
        i: (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), *(("response", None) if i == max(groups[p]) else ("revisit", max(groups[p]))))
        for i, p in rows
    }


def leaks(docs, items, coverage=0.5, width=8, literals=4, least=3):
    """Rows of id, item, windows, covered tokens, slots, whether re-parameterised; ids must differ."""
    from fabula.llm.decontaminate import _EDGES, UNITS

    def read(text):
        out = []
        for word in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
            t = word.strip(_EDGES)
            if t:
                digits = sum(c.isdigit() for c in t)
                kind = "number" if digits and 2 * digits >= len(t) else "name" if t[0].isupper() else "unit" if t.lower() in UNITS else ""
                out.append((t.lower(), "" if kind == "unit" and (not out or out[-1][1] != "number") else kind))
        return out

    def windows(tokens, n):
        found = []
        for k in range(len(tokens) - n + 1):
            part = tokens[k : k + n]
            found.append((k, ("plain", *(t for t, _ in part)), None))
            slots = [t if kind else None for t, kind in part]
            if any(slots) and sum(s is None for s in slots) >= min(literals, n):
                found.append((k, ("template", *(kind and "<" + kind + ">" or t for t, kind in part)), slots))
        return found

    rows = []
    texts = {i: read(t) for i, t in docs}
    for item, text in items:
        tokens = read(text)
        if len(tokens) < least:
            continue
        n = min(width, len(tokens))
        for i, own in texts.items():
            placed = defaultdict(list)
            for at, key, slots in windows(own, n):
                for pos, other, theirs in windows(tokens, n):
                    if key == other:
                        placed[at - pos].append((pos, tuple((a, b) for a, b in zip(theirs, slots, strict=True) if a is not None) if slots else ()))
            at, pairs = set(), set()
            for found in placed.values():
                met = {p for _, ps in found for p in ps}
                unclear = {a for a, _ in met if len({b for x, b in met if x == a}) > 1}
                kept = [(pos, ps) for pos, ps in found if not unclear & {a for a, _ in ps}]
                at |= {pos for pos, _ in kept}
                pairs |= {p for _, ps in kept for p in ps}
            covered = len({pos + j for pos in at for j in range(n)})
            if at and covered / len(tokens) >= coverage:
                rows.append((i, item, len(at), covered, len(pairs), any(a != b for a, b in pairs)))
    return sorted(rows)
