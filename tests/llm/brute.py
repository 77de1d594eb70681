"""Plain versions of the operators' results, one text and one pair at a time."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SOLID = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def op1(pages):
    """pages: (page_id, html)"""
    body = {p: (h or "").encode() for p, h in pages}
    first = {}
    for p, b in sorted(body.items()):
        if len(b) >= 100:
            first.setdefault(b, p)
    return {(p, len(b), hashlib.sha256(b).hexdigest(), *(("revisit", first[b]) if first.get(b, p) != p else ("response", None))) for p, b in body.items()}


def op2(docs, bench, size=13, share=20):
    windows = defaultdict(set)
    for item, text in bench:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i : i + size])].add(item)
    lengths = {len(x) for x in windows}
    out = set()
    for doc, text in docs:
        w, hit, items = words(text), set(), set()
        for m in lengths:
            for i in range(len(w) - m + 1):
                if (own := windows.get(tuple(w[i : i + m]))) is not None:
                    hit |= set(range(i, i + m))
                    items |= own
        out.add((doc, len(w), len(hit), len(items), sha(",".join(sorted(map(str, items)))), bool(hit) and share * len(hit) >= len(w)))
    return out


def op3(turns):
    """turns: (conv_id, turn, role, text); everything but formatted_chars"""
    by = defaultdict(list)
    for conv, turn, role, text in turns:
        by[conv].append((turn, role or "", text or ""))
    out = set()
    for conv, rows in by.items():
        rows.sort()
        said = "".join(t for _, r, t in rows if r == "assistant")
        out.add((conv, len(rows), sha("".join(f"{r}\n{t}\n" for _, r, t in rows)), len(said), sha(said)))
    return out


def op4(docs, path):
    import struct

    from tokenizers import Tokenizer

    made, start, out = Tokenizer.from_file(path), 0, set()
    for doc, text in sorted(docs):
        ids = made.encode(text or "", add_special_tokens=False).ids + [0]
        out.add((doc, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def op5(docs, weights=(3, 1, 2), share=1.5, most=2):
    """docs: (doc_id, source, text) -> {doc_id: size}, {source: (size, target)}"""
    size = {d: len(SOLID.findall(t or "")) for d, _, t in docs}
    own = Counter()
    for d, s, _ in docs:
        own[s] += size[d]
    order = sorted(own, key=lambda s: (s is None, s or ""))
    weigh = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), share * sum(own.values())
    while open_:
        total = sum(weigh[s] for s in open_)
        over = {s for s in open_ if left * weigh[s] / total > most * own[s]}
        if not over:
            target |= {s: left * weigh[s] / total for s in open_}
            break
        for s in over:
            target[s] = float(most * own[s])
        left -= sum(target[s] for s in over)
        open_ -= over
    return size, {s: (own[s], target.get(s, 0.0)) for s in order}


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def op6(docs):
    """Everything but labels and score."""
    out = set()
    for doc, text in docs:
        w, places, labels = words(text), [], set()
        for phrase, label in PHRASES.items():
            p = phrase.split()
            own = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            places += own
            labels |= {label} if own else set()
        out.add((doc, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    return out


def op8(docs, least=20, min_docs=3):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                held[key(line)].add(doc)
    out = set()
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(own := held.get(key(x), ())) >= min_docs and max(own) != doc)]
        out.add((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def shingle_set(text, k=4):
    w = SOLID.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def op9(docs, k=4, num=85, den=100):
    sets = {d: shingle_set(t, k) for d, t in docs}
    held = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            held[x].append(d)
    common = Counter()
    for own in held.values():
        own = sorted(set(own))
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                common[a, b] += 1
    root = {d: d for d in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for (a, b), n in common.items():
        if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {(d, len(s), find(d)) for d, s in sets.items()}


def op10(vectors, every=20, k=20):
    import numpy as np

    ids = np.array([i for i, _ in vectors])
    v = np.array([x for _, x in vectors], np.float64)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score = (v * v[i]).sum(1)
        order = [j for j in np.lexsort((ids, -score)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in order]
    return out
