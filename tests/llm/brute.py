"""Plain Python versions of the operators' contracts."""

import hashlib
import math
import re
from collections import Counter

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def lower(text):
    return (text or "").translate(LOWER)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def near_duplicates(docs, percent=85):
    sets = []
    for _, text in docs:
        w = SPACE.findall(lower(text))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = {}
    for i, s in enumerate(sets):
        for x in s:
            held.setdefault(x, []).append(i)
    seen = set()
    for members in held.values():
        for a in members:
            for b in members:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * len(sets[a] | sets[b]):
                        root[find(b)] = find(a)
    least = {}
    for i, (doc, _) in enumerate(docs):
        r = find(i)
        least[r] = min(least.get(r, doc), doc)
    return [(doc, len(s), least[find(i)], doc == least[find(i)]) for i, ((doc, _), s) in enumerate(zip(docs, sets))]


def without_repeated_lines(docs):
    """doc_id -> (lines, kept lines)."""
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for doc, text in docs:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 20 and doc is not None:
                holders.setdefault(k, set()).add(doc)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        gone = lambda x: len(holders.get(key(x), ())) >= 3 and doc is not None and doc != max(holders[key(x)])
        out.append((doc, lines, [x for x in lines if not gone(x)]))
    return out


def contamination(docs, items, width=13):
    windows = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(x) for x in windows}
    out = []
    for doc, text in docs:
        w = WORD.findall(lower(text))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[x]
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def languages(learn, asked, codes, bits=16, smoothing=0.5, sharpness=6.0):
    """Language, score and lead over the second of each text in `asked`, by trigrams of bytes and the codewords' bits."""

    def grams(text):
        b = text.translate(LOWER).encode()
        return [(((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 0x9E3779B1) % 2**32) >> (32 - bits) for i in range(len(b) - 2)]

    langs = sorted({lang for _, lang in learn})
    counts = {lang: Counter(g for text, of in learn if of == lang for g in grams(text)) for lang in langs}
    total = {lang: sum(counts[lang].values()) + smoothing * 2**bits for lang in langs}
    share = {lang: [(counts[lang][g] + smoothing) / total[lang] for g in range(2**bits)] for lang in langs}
    odds, weights = [], []
    for bit in range(len(codes[0])):
        sides = [[share[lang] for lang, code in zip(langs, codes) if code[bit] == side] for side in (1, 0)]
        odds.append([math.log(sum(s[g] for s in sides[0]) / len(sides[0])) - math.log(sum(s[g] for s in sides[1]) / len(sides[1])) for g in range(2**bits)])
        apart = [sum(p * o for p, o in zip(share[lang], odds[bit])) * (1 if code[bit] else -1) for lang, code in zip(langs, codes)]
        weights.append(max(min(apart), 0) + 1e-3)
    out = {}
    for i, text in asked.items():
        if text is None or not any(c.isalpha() for c in text):
            out[i] = ("und", 0.0, 0.0)
            continue
        found = grams(text)
        margins = [sum(o[g] for g in found) / max(1, len(found)) for o in odds]
        loss = [sum(w * math.log1p(math.exp(-sharpness * m * (1 if b else -1))) for w, m, b in zip(weights, margins, code)) / sum(weights) for code in codes]
        like = [math.exp((min(loss) - x) * len(weights)) for x in loss]
        order = sorted(range(len(langs)), key=lambda k: (-like[k], langs[k]))
        out[i] = (langs[order[0]], like[order[0]] / sum(like), (like[order[0]] - like[order[1]]) / sum(like))
    return out
