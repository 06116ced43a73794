"""Plain versions that several tests share."""

import hashlib
import re


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_components(rows, shingle=4, percent=85):
    """(doc_id, n_shingles, component) of each (doc_id, text)."""
    sets = []
    for _, t in rows:
        w = word_list(t)
        sets.append({tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    order = sorted(range(len(rows)), key=lambda i: len(sets[i]))
    for x, i in enumerate(order):
        for j in order[x + 1 :]:
            if len(sets[i]) * 100 < percent * len(sets[j]):
                break
            if sets[i]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def brute_taken(docs, block_words=2048):
    """Words taken of every doc_id, source by source, block by block and word by word."""
    size = {d: len((t or "").encode().split()) for d, t in zip(docs.doc_id, docs.text, strict=True)}
    by = {}
    for d, t, s in zip(docs.doc_id, docs.text, docs.source, strict=True):
        key = hashlib.md5(f"11|{'' if s is None else '=' + s}|{d}|{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()
        by.setdefault(s, []).append((key, d))
    names = sorted(by, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    cap = {s: 2 * sum(size[d] for _, d in by[s]) for s in names}
    left, open_, target = 0.75 * sum(cap.values()), set(names), {}
    while True:
        level = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if level[s] > cap[s]]
        if not over:
            break
        for s in over:
            target[s] = cap[s]
            left -= cap[s]
            open_.remove(s)
    target.update(level)
    taken = {}
    for number, s in enumerate(names, 1):
        blocks, start = {}, 0
        for _, d in sorted(by[s]):
            blocks.setdefault(start // block_words, []).append(d)
            start += size[d]
        quota = int(target[s] + 0.5)
        for e in (0, 1):
            left = min(quota, start) if e == 0 else max(0, quota - start)
            for _, b in sorted((hashlib.md5(f"11|{e}|{number}|{b}".encode()).hexdigest(), b) for b in blocks):
                for d in blocks[b]:
                    take = min(size[d], left)
                    taken[d] = taken.get(d, 0) + take
                    left -= take
    return taken
