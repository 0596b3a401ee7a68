"""Plain versions of the operators, one text after the other."""

import hashlib
import re
from collections import defaultdict

LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ident(doc_id):
    return -(1 << 63) if doc_id is None else doc_id


def sha(data):
    return hashlib.sha256(data).hexdigest()


def documents(rows):
    """Texts by id; rows that repeat an id are one document."""
    return sorted({ident(i): (t or "") for i, t in rows}.items())


def repeated_bytes(rows, window):
    seen, out = set(), {}
    for doc, text in documents(rows):
        data = text.encode()
        gone = [False] * len(data)
        for p in range(len(data) - window + 1):
            part = data[p:p + window]
            if part in seen:
                gone[p:p + window] = [True] * window
            seen.add(part)
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out[doc] = (len(data), sum(gone), spans, sha(bytes(b for b, g in zip(data, gone) if not g)))
    return out


def repeated_words(rows, window):
    seen, out = set(), {}
    for doc, text in documents(rows):
        words = WORD.findall(text)
        gone = [False] * len(words)
        for p in range(len(words) - window + 1):
            part = tuple(words[p:p + window])
            if part in seen:
                gone[p:p + window] = [True] * window
            seen.add(part)
        kept = [w for w, g in zip(words, gone) if not g]
        out[doc] = (len(words), sum(gone), sha(" ".join(kept).encode()))
    return out


def shingles(text, size=5):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i:i + size]) for i in range(max(len(words) - size + 1, 1))} if words else set()


def groups(rows, percent=80):
    """Size of the set and lowest linked id of every row, by its place."""
    sets = [(ident(i), shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if both and 100 * both >= percent * len(sets[a][1] | sets[b][1]):
                parent[find(a)] = find(b)
    lowest = defaultdict(lambda: 1 << 63)
    for k, (doc, _) in enumerate(sets):
        lowest[find(k)] = min(lowest[find(k)], doc)
    return sorted((doc, len(s), lowest[find(k)]) for k, (doc, s) in enumerate(sets))


def contamination(rows, items, window=13):
    windows = defaultdict(set)
    for item, text in items:
        words = ALNUM.findall((text or "").translate(LOWER))
        for start in range(max(len(words) - window + 1, min(len(words), 1))):
            windows[tuple(words[start:start + window])].add("" if item is None else str(item))
    out = []
    for doc, text in rows:
        words = ALNUM.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for size in {len(w) for w in windows}:
            for start in range(len(words) - size + 1):
                owners = windows.get(tuple(words[start:start + size]))
                if owners:
                    hit |= set(range(start, start + size))
                    found |= owners
        out.append((doc, len(words), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(out, key=str)


def quality(text):
    """Words, their characters, symbols, repeated lines and repeated words."""
    text = text or ""
    words = WORD.findall(text)
    grams = defaultdict(list)
    for i in range(len(words) - 2):
        grams[tuple(words[i:i + 3])].append(i)
    covered = {i + j for places in grams.values() if len(places) > 1 for i in places for j in range(3)}
    lines, seen, repeated = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated, len(covered)
