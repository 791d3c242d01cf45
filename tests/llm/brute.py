"""Plain Python versions of the operators, for small tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np

BLANKS = " \t\n\x0b\x0c\r"


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def shingles(text, n=5):
    w = words(text)
    n = min(n, len(w))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()


def similar(docs, bound=0.8):
    """(class, links) of each id; docs: distinct ids with texts."""
    sets = {d: shingles(t) for d, t in docs.items()}
    held = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            held[x].append(d)
    common = collections.Counter()
    for ids in held.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                common[a, b] += 1
    links = [(a, b) for (a, b), n in common.items() if n >= bound * (len(sets[a]) + len(sets[b]) - n) - 1e-9]
    parent = {d: d for d in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    count = collections.Counter()
    for a, b in links:
        count[a] += 1
        count[b] += 1
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    return {d: (root(d), count[d]) for d in docs}


def line_key(line):
    line = line.strip(BLANKS)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)


def dedup_lines(rows):
    """rows: (id, text); ids are not null. A sorted list of (id, lines, dropped, sha256)."""
    holders = collections.defaultdict(set)
    for d, text in rows:
        for line in (text or "").split("\n"):
            if len(line_key(line)) >= 10:
                holders[line_key(line)].add(d)
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(line_key(x), ())) > 1 and d > min(holders[line_key(x)]))]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def secrets(text):
    """(assign, access, hex, digest of the base spans), with the patterns as they are asked for."""
    text = text or ""
    found = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end(), "assign"))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            found.append((m.start(), 1, m.end(), "access"))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 24:
            found.append((m.start(), 2, m.end(), "hex"))
    n = collections.Counter(f[3] for f in found)
    joined = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))
    return n["assign"], n["access"], n["hex"], hashlib.sha256(joined.encode()).hexdigest()


def token_rows(rows, tokenizer, end=2):
    """rows: (id, text) in order. (id, start, tokens, crc32)."""
    out, at = [], 0
    for d, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def leaks(docs, items):
    """(document, item) pairs with the item's words in a row inside the document."""
    texts = {d: f" {' '.join(words(t))} " for d, t in docs.items()}
    return {(d, i) for i, item in items.items() if len(words(item)) >= 5 for d, t in texts.items() if f" {' '.join(words(item))} " in t}


def shared_runs(docs, n=50):
    """Documents with a run of n words that a smaller document has."""
    first, found = {}, set()
    for d in sorted(docs):
        w = words(docs[d])
        for k in range(len(w) - n + 1):
            if first.setdefault(tuple(w[k : k + n]), d) != d:
                found.add(d)
    return found


def best_vectors(rows, k=5, every=50):
    """rows: (id, vector). (query, rank, id, score)."""
    ok = {(i, tuple(int(np.floor(256 * float(x))) for x in v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q, a in ok:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ok if i != q and len(a) == len(b))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def hard_negatives(rows, every=100, k=5, low=80, high=100):
    """(anchor, positive, rank, negative, scores) of (id, label, integers) rows with distinct ids."""
    product = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    found = set()
    for anchor, label, vector in rows:
        if anchor % every:
            continue
        others = sorted((-product(vector, v), i, own) for i, own, v in rows if i != anchor and len(v) == len(vector))
        for minus, positive, _ in [x for x in others if x[2] == label][:k]:
            fit = [(-m, i) for m, i, own in others if own != label and low * -minus <= 100 * -m <= high * -minus]
            found |= {(anchor, positive, rank, negative, -minus, score) for rank, (score, negative) in enumerate(fit[:k], 1)}
    return found


def lexical_terms(text):
    small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", small)


def lexical_ranking(docs, items, k=10):
    """(item, rank, doc, score) of (id, text) rows."""
    counted = [(d, collections.Counter(lexical_terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(term for _, c in counted for term in c)
    wanted = collections.defaultdict(set)
    for item, text in items:
        wanted[item] |= set(lexical_terms(text))
    found = []
    for item, terms in wanted.items():
        scored = []
        for d, c in counted:
            m = 10 + 90 * sum(c.values()) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((-score, d is not None, d or 0))
        found += [(item, rank, d if given else None, -minus) for rank, (minus, given, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(found, key=repr)
