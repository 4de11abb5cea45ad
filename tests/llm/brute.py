"""Plain versions of the operators, for small tables."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np

BLANK = r"[\x20\x09-\x0D]+"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w for w in re.split(BLANK, text or "") if w]


def shingles(text, lower=True):
    w = words((text or "").translate(LOW) if lower else text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(docs):
    """docs: (doc_id, text) -> {row: (size, least id)}."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        least[find(i)].append(d)
    return [(docs[i][0], len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None)) for i in range(len(docs))]


def dedup_lines(docs):
    strip = " \t\n\x0b\x0c\r"
    lines = {d: (t or "").split("\n") for d, t in docs}
    holders = defaultdict(set)
    for d, ls in lines.items():
        for x in ls:
            holders[x.strip(strip).translate(LOW)].add(d)
    gone = {k: max(v) for k, v in holders.items() if len(k) >= 20 and len(v) >= 3}
    out = {}
    for d, ls in lines.items():
        kept = [x for x in ls if gone.get(x.strip(strip).translate(LOW), d) == d]
        out[d] = (len(ls), len(ls) - len(kept), "\n".join(kept))
    return out


def quality(text):
    w, lines = words(text), (text or "").split("\n")
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] >= 2 for k in range(3)}
    full = [x for x in lines if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(full) - len(set(full)), len(rep)


def pieces(docs, encode):
    """{doc: ids with the end}."""
    return {d: np.array([*encode(t or ""), 0], dtype="<u4") for d, t in docs}


def crc(array):
    return zlib.crc32(array.tobytes())
