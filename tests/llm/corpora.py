"""Small corpora with odd rows, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

PII = [
    "mail ann.b@mail.example.com now", "call +1 (438) 555-7372 or +1 (826) 555-4081 190.137.223.7", "host 10.0.0.255 not 10.0.0.256",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "@@ a@b a@b.c %x@y.z.", "1.2.3.4.5.6.7.8", "é1@x.de 012.34.5.6",
]


def corpus(seed: int = 5, n: int = 90, odd: bool = True) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): copies, near copies, shared passages, odd texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(400)]

    def words(k):
        return [rng.choice(vocabulary) for _ in range(k)]

    passage, line = words(60), " ".join(words(7))
    texts = []
    for i in range(n):
        body = words(rng.randint(1, 160))
        kind = i % 9
        if kind == 1 and texts:
            body = rng.choice(texts).split(" ")
        elif kind == 2 and len(texts) > 3:
            body = texts[3].split(" ")
            for _ in range(rng.randint(0, 6)):
                body[rng.randrange(len(body))] = "changed"
        elif kind == 3:
            at = rng.randint(0, len(body))
            body[at:at] = passage[rng.randint(0, 20):]
        elif kind == 4:
            body = body[:20] + ["\n" + line + "\n"] + body[20:]
        elif kind == 5:
            body += [PII[i % len(PII)]]
        elif kind == 6:
            body = body[:15] * rng.randint(1, 4)
        texts.append(" ".join(body))
    if odd:
        texts += [None, "", " \t\n", "one", "a a a a a a a a a a a a a a a a a a", "x" * 700, "ab" * 300, "　é\n\n z  y",
                  "<|endoftext|> it's 12", " ".join(words(9000)), *PII]
    rows = [(i * 3 + 1, t, ("en", "de", None)[i % 3], ("s0", "s1", "s0", None)[i % 4], len(t) if t is not None else None)
            for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[4], rows[13]] if odd else rows


def words_of(text):
    return (text or "").encode().split()


def components(rows):
    sets = {}
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        k = min(5, len(w))
        sets[(r[0], r[1])] = frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1)) if k else frozenset()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets, key=lambda k: (k[0], k[1] or ""))
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)), key=keys.index)
                root[y] = x
    return {k: (len(sets[k]), find(k)[0]) for k in keys}


def byte_repeats(rows, length=100):
    seen, out = set(), {}
    for doc, text in sorted({(r[0], r[1] or "") for r in rows}):
        data = text.encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            part = data[s:s + length]
            if part in seen:
                gone[s:s + length] = b"\1" * length
            seen.add(part)
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[doc] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in doubled) % 10 == 0


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((m.start(), k, m.end(), kind))
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out)]


def held_out(doc):
    return zlib.crc32(str(doc).encode()) % 7 == 2


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def unigram(rows):
    train = Counter(t for r in rows if not held_out(r[0]) for t in tokens(r[1]))
    total, kinds = sum(train.values()), len(train)

    def score(text):
        own = tokens(text)
        return len(own), sum(train[t] > 0 for t in own), total, sum(math.log10((train[t] + 1) / (total + kinds + 1)) for t in own)

    return score


def context_tree(rows, depth):
    """Recursive context-tree weighting over dictionaries; scores a text."""
    counts = defaultdict(lambda: [0, 0])

    def bits(byte):
        return [((1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1) for k in range(8)]

    def places(text):
        data = b"\xff" * depth + (text or "").encode().lower() + b"\xff"
        return [(data[j - depth:j], data[j]) for j in range(depth, len(data))]

    for r in rows:
        if not held_out(r[0]):
            for context, byte in places(r[1]):
                for prefix, bit in bits(byte):
                    for d in range(depth + 1):
                        counts[(context[depth - d:], prefix)][bit] += 1
    children = defaultdict(list)
    for context, prefix in counts:
        if context:
            children[(context[1:], prefix)].append((context, prefix))
    weighted, weight = {}, {}
    for d in range(depth, -1, -1):
        for node in [n for n in counts if len(n[0]) == d]:
            a, b = counts[node]
            own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
            below = sum(weighted[c] for c in children[node])
            high = max(own, below)
            weighted[node] = own if d == depth else high + math.log(math.exp(own - high) + math.exp(below - high)) - math.log(2)
            weight[node] = 1 / (1 + math.exp(min(700, below - own)))

    def probability(context, prefix, bit, d=0):
        node = (context[depth - d:], prefix)
        pair = counts.get(node, [0, 0])
        own = (pair[bit] + 0.5) / (sum(pair) + 1)
        if d == depth:
            return own
        w = weight.get(node, 0.5)
        return w * own + (1 - w) * probability(context, prefix, bit, d + 1)

    return lambda text: sum(math.log10(probability(c, p, b)) for c, x in places(text) for p, b in bits(x))
