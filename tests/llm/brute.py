"""The operators' results by plain definitions."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def components(rows):
    """[(doc_id, text)] of unique ids to {doc_id: (n_shingles, component_id)}."""
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for j, n in collections.Counter(j for t in s for j in holders[t]).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
        for t in s:
            holders[t].append(i)
    low = collections.defaultdict(lambda: float("inf"))
    for i in sets:
        low[root(i)] = min(low[root(i)], i)
    return {i: (len(sets[i]), low[root(i)]) for i in sets}


def targets(sizes):
    """{source: size} to {source: target}: reshared until no target is above three times its size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: n % 3 + 1 for n, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}


def taken(rows):
    """[(doc_id, text, source)] to sorted [(doc_id, size, source_size, target, taken)]."""
    sized = [(i, len(WORD.findall(t or "")), s) for i, t, s in rows]
    sizes = collections.Counter()
    for _, n, s in sized:
        sizes[s] += n
    goal = targets(sizes)
    out = []
    for source in sizes:
        at = 0
        own = sorted((hashlib.md5(f"0:{i}".encode()).hexdigest(), i, n) for i, n, s in sized if s == source)
        for _, i, n in own:
            words = sum(max(0, min(n, round(goal[source]) - at - k * sizes[source])) for k in range(3))
            out.append((i, n, sizes[source], goal[source], words))
            at += n
    return sorted(out, key=str)


def removed_lines(rows):
    """[(doc_id, text)] to {(doc_id, line): removed}."""
    out, texts, sets = {}, set(), []
    holders = collections.defaultdict(list)
    for i, text in sorted(r for r in rows if r[1] is not None):
        for k, line in enumerate(text.split("\n")):
            s = frozenset(WORD.findall(line))
            if line in texts or not s:
                out[i, k] = line in texts
                continue
            texts.add(line)
            shared = collections.Counter(j for t in s for j in holders[t])
            out[i, k] = any(100 * n >= 80 * (len(s) + len(sets[j]) - n) for j, n in shared.items())
            for t in s:
                holders[t].append(len(sets))
            sets.append(s)
    return out
