"""Plain versions of operators that SQL cannot express, for small tables; rows are (doc_id, text, source) or dicts of texts by id."""

import hashlib
import re
from collections import defaultdict

import numpy as np


def components(rows, n, num, den):
    sets = {}
    for i, t, _ in rows:
        words = (t or "").encode().lower().split()
        sets[i] = {tuple(words[j : j + n]) for j in range(len(words) - n + 1)} or ({tuple(words)} if words else set())
    ids = sorted(i for i in sets if i is not None and sets[i])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                a_, b_ = find(a), find(b)
                root[max(a_, b_)] = min(a_, b_)
    return {i: (len(s), None if i is None else find(i)) for i, s in sets.items()}


def toxicity(texts, labels):
    """Scores by id, the kept terms and the neighbours' cosines by id; every labelled text is an example."""

    def counts(text):
        out = defaultdict(int)
        for w in re.findall(r"\w+", (text or "").lower()):
            for t in [w] + [w[:n] + "~" for n in (4, 5, 6, 7) if len(w) > n]:
                out[t] += 1
        return out

    order = sorted(labels, key=lambda i: (labels[i], i))
    bags = {i: counts(t) for i, t in texts.items()}
    df = defaultdict(lambda: [0, 0])
    for i in order:
        for t in bags[i]:
            df[t][labels[i]] += 1
    n = [sum(1 for i in order if labels[i] == y) for y in (0, 1)]
    ll = lambda k, m, p: (k * np.log(p) if k else 0) + ((m - k) * np.log(1 - p) if m > k else 0)
    kept = [t for t, (a, b) in df.items() if a + b >= 3 and 2 * (ll(a, n[0], a / n[0]) + ll(b, n[1], b / n[1]) - ll(a, n[0], (a + b) / sum(n)) - ll(b, n[1], (a + b) / sum(n))) > 10.83]

    def vector(bag):
        v = np.array([(1 + np.log(bag[t])) * (np.log((1 + sum(n)) / (1 + sum(df[t]))) + 1) if bag.get(t) else 0.0 for t in kept])
        return v / (np.linalg.norm(v) or 1)

    examples, y, base = np.array([vector(bags[i]) for i in order]), np.array([labels[i] for i in order]), n[1] / sum(n)

    def vote(v, without=None):
        c = np.round(examples @ v, 12)
        near = sorted((-c[j], j) for j in range(len(order)) if j != without and c[j] > 1e-12)[:16]
        w = np.array([c[j] ** 2 for _, j in near])
        return [(sum(w[k] for k, (_, j) in enumerate(near) if y[j]) + 0.02 * base) / (w.sum() + 0.02), np.tanh(w.sum())], [-c for c, _ in near]

    x = np.array([[1, *vote(examples[j], j)[0]] for j in range(len(order))])
    curve, ridge = np.zeros(3), np.array([1e-6, 1, 1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ curve))
        curve += np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(ridge), x.T @ (y - p) - ridge * curve)
    found = {i: vote(vector(bag)) for i, bag in bags.items()}
    return {i: 1 / (1 + np.exp(-curve @ [1, *v])) for i, (v, _) in found.items()}, kept, {i: near for i, (_, near) in found.items()}


def drop_shared_lines(rows):
    """Rows (doc_id, text, source) without the lines that five of them share, but for the largest id that holds one."""
    key = lambda line: line.strip(" \t\n\v\f\r").encode().lower()
    holders = defaultdict(set)
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            if len(line.strip(" \t\n\v\f\r")) >= 40:
                holders[key(line)].add(i)
    stays = lambda line, i: len(h := holders.get(key(line), ())) < 5 or i == max(h)
    return [(i, t if t is None else "\n".join(x for x in t.split("\n") if stays(x, i)), s) for i, t, s in rows]


def mix(rows, weights=(1, 2, 3), epochs=3):
    """Copies by id that weighted fair queueing takes of rows (doc_id, text, source) with distinct ids."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    key = {i: hashlib.md5(str(i).encode()).hexdigest() for i in size}
    by = defaultdict(list)
    for i, _, s in sorted(rows, key=lambda r: (key[r[0]], size[r[0]])):
        by[s].append(i)
    whole = {s: sum(size[i] for i in x) for s, x in by.items()}
    weight = {s: weights[n % len(weights)] for n, s in enumerate(sorted(by, key=lambda s: (s is None, s or "")))}
    total, capped = sum(size.values()), set()
    while True:
        left = total - sum(epochs * whole[s] for s in capped)
        level = left / (sum(w for s, w in weight.items() if s not in capped) or 1)
        more = {s for s, w in weight.items() if s not in capped and w * level > epochs * whole[s]}
        if not more:
            break
        capped |= more
    queue = []
    for s, x in by.items():
        target, before = epochs * whole[s] if s in capped else weight[s] * level, 0
        for i in x:
            for e in range(epochs):
                begin = e * whole[s] + before
                time = (begin + size[i]) / target if target else 0.0
                if time <= 1 or begin < target:
                    queue.append((time, key[i], e, i))
            before += size[i]
    copies, used = defaultdict(int), 0
    for _, _, _, i in sorted(queue):
        if (used := used + size[i]) > total:
            break
        copies[i] += 1
    return copies
