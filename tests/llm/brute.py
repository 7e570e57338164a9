"""Plain restatements of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def components(docs):
    """doc_id -> (set size, smallest id reached), for docs = [(doc_id, text)]."""
    sets = {}
    for i, text in docs:
        w = words(lower(text))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])
    kinds = defaultdict(list)
    for i, s in sets.items():
        if s:
            kinds[s].append(i)
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    def join(a, b):
        a, b = sorted((root(a), root(b)))
        up[b] = a

    names = list(kinds)
    for k, a in enumerate(names):
        for i in kinds[a][1:]:
            join(kinds[a][0], i)
        for b in names[k + 1 :]:
            if 100 * len(a & b) >= 75 * len(a | b):
                join(kinds[a][0], kinds[b][0])
    return {i: (len(s), root(i)) for i, s in sets.items()}


def repeats_removed(texts, width=35):
    """(words, removed, kept text) of each text."""
    split = [words(t) for t in texts]
    seen = Counter(tuple(w[k : k + width]) for w in split for k in range(len(w) - width + 1))
    out = []
    for w in split:
        gone = {k + j for k in range(len(w) - width + 1) if seen[tuple(w[k : k + width])] > 1 for j in range(width)}
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def chunks(text):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    alike = [0 <= i and i + 1 < len(h) and h[i] == h[i + 1] for i in range(-1, len(h) + 1)]  # alike[i + 1]: lines i and i + 1
    ends, since = [], 0
    for i, x in enumerate(h):
        rolled = ((h[i - 2] if i > 1 else 0) * 31 + (h[i - 1] if i else 0)) * 31 + x
        end = rolled % 5 == 0 or alike[i] or alike[i + 1] or alike[i + 2]
        since = 0 if end else since + 1
        if since == 32:
            end, since = True, 0
        ends.append(end and i > 0)
    for i in range(1, len(ends)):
        ends[i] = ends[i] and not ends[i - 1]
    out, begin = [], 0
    for k in range(len(lines)):
        if ends[k] or k == len(lines) - 1:
            out.append(lines[begin : k + 1])
            begin = k + 1
    return out


def chunks_removed(docs):
    """doc_id -> (lines, lines removed, kept text)."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        if text is None:
            out[i] = (0, 0, None)
            continue
        kept, removed = [], 0
        for part in chunks(text):
            body = "\n".join(part)
            if sum(bool(words(x)) for x in part) >= 2 and body in seen:
                removed += len(part)
            else:
                seen.add(body)
                kept.append(body)
        out[i] = (len(text.split("\n")), removed, "\n".join(kept))
    return out


# the base patterns of secret scans on code points
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)
