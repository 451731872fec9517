"""Plain versions of the operators, for small tables: (doc_id, text) lists in, rows out."""

import base64
import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if n[w] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 16]
    spans = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))
    return *(sum(x[1] == k for x in found) for k in range(3)), sha(spans), spans


def warc(pages, least=0):
    largest = {}
    for p, html in pages:
        largest[html] = max(largest.get(html, p), p)
    out = []
    for p, html in pages:
        b = (html or "").encode()
        again = len(b) >= least and largest[html] != p
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", largest[html] if again else None))
    return out


def repeats(docs, unit, window):
    """(doc_id, n, removed, spans, kept sha) of windows that also start earlier; docs in order of id."""
    seen, out = set(), {}
    for d, text in sorted(docs, key=lambda x: x[0]):
        units = list((text or "").encode()) if unit == "byte" else WORD.findall(text or "")
        gone = [False] * len(units)
        for i in range(len(units) - window + 1):
            w = bytes(units[i : i + window]) if unit == "byte" else tuple(units[i : i + window])
            if w in seen:
                gone[i : i + window] = [True] * window
            seen.add(w)
        kept = [u for u, g in zip(units, gone) if not g]
        spans = sum(g and not p for p, g in zip([False, *gone], gone))
        out[d] = (len(units), sum(gone), spans, sha(bytes(kept) if unit == "byte" else " ".join(kept)))
    return out


def shingles(text, k=5):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else Counter()


def classes(pairs, ids):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def near(docs, at_least=0.8):
    sets = {d: shingles(t) for d, t in docs}
    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    pairs = {(a, b) for v in by.values() for a in v for b in v if a < b}
    good = [(a, b) for a, b in pairs if sum((sets[a] & sets[b]).values()) >= at_least * sum((sets[a] | sets[b]).values())]
    return classes(good, sets)
