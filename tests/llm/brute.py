"""Plain versions of the training-data operators, for small tables."""

import numpy as np


def simhash(text, words=3):
    import re

    import xxhash

    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0d]+", lower)
    if not found:
        return 0
    parts = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    h = [xxhash.xxh64(p.encode(), 42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def jaccard(a, b, words=5):
    """Similarity of the sets of word shingles."""
    sets = []
    for t in (a, b):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


def classes(ids, linked):
    """Smallest id reachable, by plain search."""
    out = {}
    for start in sorted(ids):
        if start in out:
            continue
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = start
                todo += [y for y in ids if y not in out and linked(x, y)]
    return out


class Writer:
    """A second, bit-by-bit writer of lossless WebP with transforms, meta codes and near distances."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n)]

    def fixed(self, size):
        """Code lengths for 256 symbols of 8 bits and none for the rest, written with repeats of zero."""
        lengths = [8] * 256 + [0] * (size - 256) if size > 256 else [8] * 256
        self.put(0, 1)
        self.put(15, 4)  # 19 lengths of length codes: 8, 17, 18
        order = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
        own = {8: 1, 18: 2, 0: 2}
        for k in order:
            self.put(own.get(k, 0), 3)
        self.put(0, 1)
        code = {8: (0, 1), 0: (1, 2), 18: (3, 2)}  # canonical 0, 10, 11, reversed
        i = 0
        while i < size:
            if lengths[i]:
                self.put(*code[8])
                i += 1
            elif size - i >= 11:
                n = min(138, size - i)
                self.put(*code[18])
                self.put(n - 11, 7)
                i += n
            else:
                self.put(*code[0])
                i += 1

    def byte(self, v):
        self.bits += [v >> (7 - i) & 1 for i in range(8)]

    def image(self, pixels, main, cache_bits=0, head=()):
        """Literal pixels (ARGB) with 8-bit codes."""
        self.put(1 if cache_bits else 0, 1)
        if cache_bits:
            self.put(cache_bits, 4)
        if main:
            self.put(0, 1)
        self.fixed(280 + (1 << cache_bits if cache_bits else 0))
        for _ in range(3):
            self.fixed(256)
        self.put(1, 1)  # distance: a lone symbol
        self.put(0, 1)
        self.put(0, 1)
        self.put(0, 1)
        for p in np.asarray(pixels).ravel().tolist():
            for up in (8, 16, 0, 24):
                self.byte(p >> up & 255)

    def header(self, width, height):
        self.put(0x2F, 8)
        self.put(width - 1, 14)
        self.put(height - 1, 14)
        self.put(1, 1)
        self.put(0, 3)

    def data(self):
        b = self.bits + [0] * (-len(self.bits) % 8)
        return bytes(sum(b[i + k] << k for k in range(8)) for i in range(0, len(b), 8)) + b"\0" * 8


def predict(p, modes, k):
    """Residuals of ARGB rows by the format's fourteen predictors, pixel by pixel."""
    height, width = p.shape
    ch = lambda v: [int(v) >> s & 255 for s in (0, 8, 16, 24)]
    join = lambda c: sum((x & 255) << s for x, s in zip(c, (0, 8, 16, 24)))
    avg = lambda a, b: [(x + y) // 2 for x, y in zip(a, b)]
    clip = lambda x: max(0, min(255, x))
    out = np.zeros_like(p)
    flat = p.ravel()
    for y in range(height):
        for x in range(width):
            left = ch(p[y, x - 1]) if x else None
            t = ch(p[y - 1, x]) if y else None
            if not x and not y:
                g = [0, 0, 0, 255]
            elif not y:
                g = left
            elif not x:
                g = t
            else:
                tl, tr = ch(p[y - 1, x - 1]), ch(flat[(y - 1) * width + x + 1])
                m = int(modes[y >> k, x >> k])
                if m == 0:
                    g = [0, 0, 0, 255]
                elif m == 11:
                    pl = sum(abs(t[i] - tl[i]) for i in range(4))
                    pt = sum(abs(left[i] - tl[i]) for i in range(4))
                    g = left if pl < pt else t
                elif m == 12:
                    g = [clip(left[i] + t[i] - tl[i]) for i in range(4)]
                elif m == 13:
                    a = avg(left, t)
                    g = [clip(a[i] + int((a[i] - tl[i]) / 2)) for i in range(4)]
                else:
                    g = [None, left, t, tr, tl, avg(avg(left, tr), t), avg(left, tl), avg(left, t), avg(tl, t), avg(t, tr), avg(avg(left, tl), avg(t, tr))][m]
            out[y, x] = join([a - b for a, b in zip(ch(p[y, x]), g)])
    return out
