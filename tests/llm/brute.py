"""Plain single-machine versions of the numbered operators, to compare with on small tables."""

import hashlib
import re
from collections import Counter, defaultdict

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def blank_words(text):
    return BLANK.findall(text or "")


def lower_az(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def decontaminate(docs, items, window=10):
    """docs, items: lists of (id, text) -> list of (id, n_words, n_hit, n_items, sha, contaminated)."""
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_az(t or ""))
    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        size = min(window, len(w))
        for s in range(len(w) - size + 1 if w else 0):
            wins[tuple(w[s:s + size])].add(i)
    sizes = {len(k) for k in wins}
    out = []
    for i, t in docs:
        w = words(t)
        hit, found = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                got = wins.get(tuple(w[s:s + n]))
                if got:
                    hit.update(range(s, s + n))
                    found |= got
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    return out


def near_dups(docs, k=2, percent=80):
    """(id, n_shingles, component, kept) with every pair that shares a shingle compared."""
    sets = []
    for i, t in docs:
        w = [lower_az(x) for x in blank_words(t)]
        sets.append((i, {tuple(w[s:s + k]) for s in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    classes = {}
    for i, s in sets:
        if s:
            classes.setdefault(frozenset(s), []).append(i)
    reps = list(classes)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    where = defaultdict(list)
    for n, s in enumerate(reps):
        ids = [i for i in classes[s] if i is not None]
        for i in ids:
            join(ids[0], i)
        for g in s:
            where[g].append(n)
    for n, s in enumerate(reps):
        common = Counter(m for g in s for m in where[g] if m < n)
        for m, c in common.items():
            if 100 * c >= percent * (len(s) + len(reps[m]) - c):
                a = [i for i in classes[s] if i is not None]
                b = [i for i in classes[reps[m]] if i is not None]
                if a and b:
                    join(a[0], b[0])
    out = []
    for i, s in sets:
        c = None if i is None else find(i) if s else i
        out.append((i, len(s), c, c is None or c == i))
    return out


def rules(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t = text or ""
    w = blank_words(t)
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        if blank_words(x):
            dup += x in seen
            seen.add(x)
    c = Counter(tuple(w[s:s + 3]) for s in range(len(w) - 2))
    hit = {p for s in range(len(w) - 2) if c[tuple(w[s:s + 3])] > 1 for p in (s, s + 1, s + 2)}
    return len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), dup, len(hit)


def substrings(docs, window=13):
    """(id, n_words, n_removed, sha) by a dictionary from every window to its smallest id."""
    first = {}

    def rank(i):
        return float("inf") if i is None else i
    for i, t in docs:
        w = blank_words(t)
        for s in range(len(w) - window + 1):
            k = tuple(w[s:s + window])
            first[k] = min(first.get(k, float("inf")), rank(i))
    out = []
    for i, t in docs:
        w = blank_words(t)
        gone = {p for s in range(len(w) - window + 1) if first[tuple(w[s:s + window])] < rank(i) for p in range(s, s + window)}
        out.append((i, len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone))))
    return out


def mix_targets(sizes, weights=(5, 2, 1), cap=3):
    """sizes: {source: words} -> {source: target}, by repeated resharing of the excess."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in over}


def judge_url(url, rules):
    """(host, path, rule, verdict) by trying every rule."""
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = lower_az(re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules
            if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"
