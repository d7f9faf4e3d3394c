"""Plain single-machine versions of the operators, for small fixtures."""

import zlib
from collections import Counter

import xxhash

BIT = [1 << b for b in range(64)]


def split_words(text):
    import re
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def simhash(text, width=3):
    ws = split_words(lower_ascii(text))
    if not ws:
        return 0
    sh = [" ".join(ws[i:i + width]) for i in range(len(ws) - width + 1)] or [" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(b for b in BIT if 2 * sum(1 for h in hs if h & b) > len(hs))


def reach(n, linked):
    """Component number of 0..n-1 under the relation ``linked(i, j)``."""
    comp = list(range(n))

    def root(a):
        while comp[a] != a:
            a = comp[a]
        return a

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = root(i), root(j)
                comp[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def sketch(text, k, width, hash_of):
    """The k least distinct shingle hashes, by the given hash of a list of words."""
    ws = split_words((text or "").lower())
    if not ws:
        return []
    sh = [ws[i:i + width] for i in range(len(ws) - width + 1)] or [ws]
    return sorted({hash_of(s) for s in sh})[:k]


def held_out(key, mod, rest):
    return zlib.crc32(("" if key is None else str(key)).encode()) % mod == rest


def base_scores(rows, mod=7, rest=2):
    import math
    toks = {k: [w.encode() for w in split_words(lower_ascii(t))] + [None] for k, t in rows}
    train = Counter()
    for k, ws in toks.items():
        if not held_out(k, mod, rest):
            train.update(ws)
    n, v = sum(train.values()), len(train)
    return n, {k: (len(ws), sum(w in train for w in ws), sum(math.log10((train[w] + 1) / (n + v + 1)) for w in ws))
               for k, ws in toks.items()}
