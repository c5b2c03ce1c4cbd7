"""Plain Python versions of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, width):
    w = blank_words(text)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def near_duplicates(rows, width, threshold=80):
    """{doc_id: (n_shingles, component_id)} from (doc_id, text), all pairs."""
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    of = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            of[x].add(i)
    for i, s in sets.items():
        for j in {j for x in s for j in of[x] if j < i}:
            n = len(s & sets[j])
            if 100 * n >= threshold * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(docs, items, width=13):
    """{doc_id: (n_words, n_hit, items, contaminated)}."""
    windows = defaultdict(set)
    for item, text in items:
        w = alnum_words(text)
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        w, hit, found = alnum_words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out[doc] = (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    return out


def mix(rows, seed=17):
    """[(doc_id, times taken)] from (doc_id, source, text): targets by repeated sharing out, then fair queueing."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, _, t in rows}
    of = defaultdict(int)
    for i, s, _ in rows:
        of[s] += size[i]
    names = sorted(of, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    budget, capped = 1.5 * sum(of.values()), set()
    while True:
        free = sum(weight[s] for s in names if s not in capped)
        left = budget - sum(2 * of[s] for s in capped)
        target = {s: 2.0 * of[s] if s in capped else left * weight[s] / free for s in names}
        over = {s for s in names if s not in capped and target[s] > 2 * of[s]}
        if not over:
            break
        capped |= over
    order = sorted(rows, key=lambda r: (hashlib.md5(f"{r[0]}:{seed}".encode()).hexdigest(), r[0], size[r[0]]))
    turns, sent = [], defaultdict(int)
    for i, s, _ in order:
        sent[s] += size[i]
        for p in (0, 1):
            if size[i]:
                turns.append(((p * of[s] + sent[s]) / target[s], names.index(s), p, i))
    taken, spent = defaultdict(int), 0
    for _, _, _, i in sorted(turns):
        spent += size[i]
        if spent > sum(of.values()) * 3 // 2:
            break
        taken[i] += 1
    return taken, target, of, size


def recurring(rows, min_docs=3, min_words=5, depth=3, constant=0.7, long_docs=None, long_words=50):
    """{(doc_id, line number)} of lines whose template recurs, from (doc_id, text): every level of constant words, long lines."""
    lines = []
    for doc, text in rows:
        for n, raw in enumerate([] if text is None else text.split("\n")):
            words = tuple("<*>" if re.search("[0-9]", w) and not w.startswith("<*>") else w for w in re.findall(r"[^\x20\x09-\x0D]+", raw))
            lines.append((doc, text, n, words))
    docs_of, texts_of, leaves = defaultdict(set), defaultdict(set), defaultdict(set)
    for doc, text, _, words in lines:
        if len(words) >= min_words:
            docs_of[words].add(doc)
            texts_of[words].add(text)
            leaves[(len(words), words[:depth])].add(words)
    bad = {w for w, d in docs_of.items() if len(d) >= min_docs}
    if long_docs is not None:
        bad |= {w for w, d in docs_of.items()
                if sum(x != "<*>" for x in w) >= long_words and min(len(d), len(texts_of[w])) >= long_docs}
    for kinds in leaves.values():
        if len(kinds) < 2 or sum(len(docs_of[w]) for w in kinds) < min_docs:
            continue
        at = Counter()
        for words in kinds:
            for k, w in enumerate(words):
                if w != "<*>":
                    at[k, w] += len(docs_of[words])
        general = defaultdict(set)
        for words in kinds:
            counts = [at[k, w] if at[k, w] >= min_docs else 0 for k, w in enumerate(words)]
            weakest = sorted(counts, reverse=True)[math.ceil(constant * len(words)) - 1]
            least = min_docs
            while least <= weakest:
                general[tuple(w if n >= least else "<*>" for w, n in zip(words, counts))].add(words)
                least *= 2
        for group in general.values():
            if len(group) > 1 and len(set().union(*(docs_of[w] for w in group))) >= min_docs:
                bad |= group
    return {(doc, n) for doc, _, n, words in lines if words in bad}


def resampled(docs, targets, percent=25, least=20, seed=7, buckets=10_000):
    """{doc_id: (n_features, weight, score, rank)} from (doc_id, text) and texts."""

    def hashed(text):
        w = alnum_words(text)
        return [zlib.crc32(x.encode()) % buckets for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    of = {i: hashed(t) for i, t in docs}
    source = Counter(b for i in of for b in of[i])
    target = Counter(b for t in targets for b in hashed(t))
    a, b = sum(source.values()) + buckets, sum(target.values()) + buckets
    gain = {x: math.floor(1000 * math.log((target[x] + 1) * a / ((source[x] + 1) * b))) for x in source}
    rows = {}
    for i, t in docs:
        weight = sum(gain[x] for x in of[i]) // len(of[i]) if of[i] else 0
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows[i] = [len(of[i]), weight, score, None]
    able = sorted((-rows[i][2], i) for i, t in docs if len(alnum_words(t)) >= least)
    for k, (_, i) in enumerate(able[: percent * len(able) // 100]):
        rows[i][3] = k + 1
    return {i: tuple(r) for i, r in rows.items()}


def ranked(docs, items, k=10):
    """{(item_id, rank): (doc_id, score)} from (doc_id, text) and (item_id, text), every document scored for every item."""
    terms = [(i, Counter(alnum_words(t))) for i, t in docs]
    n_docs = sum(1 for _, c in terms if c)
    total = sum(c.total() for _, c in terms)
    holders = Counter(x for _, c in terms for x in c)
    out = {}
    for item, text in items:
        asked, found = set(alnum_words(text)), []
        for i, c in terms:
            m = 10 + 90 * c.total() * n_docs // max(total, 1)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holders[x] + 1))) * (10**9 * c[x] // (1000 * c[x] + 8 * m))
                for x in asked & c.keys()
            )
            if score > 0:
                found.append((-score, i))
        for rank, (score, i) in enumerate(sorted(found)[:k], 1):
            out[item, rank] = (i, -score)
    return out
