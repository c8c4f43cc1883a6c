"""Plain restatements of what the corpus operators must return, text by text and pair by
pair, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NORMAL = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def lower_az(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def decontamination(docs, items, window=13):
    """{row: (n_words, n_hit, n_items, items_sha256, contaminated)}"""
    windows: dict[tuple, set] = {}
    for item_id, text in items:
        w = NORMAL.findall(lower_az(text or ""))
        if not w:
            continue
        size = min(window, len(w))
        for i in range(len(w) - size + 1):
            windows.setdefault(tuple(w[i:i + size]), set()).add(item_id)
    out = []
    for doc_id, text in docs:
        w = NORMAL.findall(lower_az(text or ""))
        hit, found = set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                ids = windows.get(tuple(w[i:i + size]))
                if ids is not None:
                    hit.update(range(i, i + size))
                    found |= ids
        names = sorted(str(x) for x in found if x is not None)
        out.append((doc_id, len(w), len(hit), len(names), sha(",".join(names)),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return out


def substring(docs, window=35):
    """[(doc_id, n_words, n_removed, kept_sha256)]"""
    lists = [words(t) for _, t in docs]
    count = Counter(tuple(w[i:i + window]) for w in lists for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(docs, lists):
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((doc_id, len(w), len(gone), sha(" ".join(kept))))
    return out


SECRETS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                          r"([A-Za-z0-9+/_.=-]+)", re.I | re.A), lambda m: len(m[2]) >= 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
)


def secrets(docs):
    out = []
    for doc_id, text in docs:
        spans = [(m.start(), k, kind, m.end()) for k, (kind, p, ok) in enumerate(SECRETS)
                 for m in p.finditer(text or "") if ok(m)]
        joined = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans))
        n = Counter(kind for _, _, kind, _ in spans)
        out.append((doc_id, n["assign"], n["access"], n["hex"], sha(joined), joined))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(m) -> str:
    return re.sub("[^0-9]", "", m[0])


PII = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
     lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"),
     lambda m: 16 <= len(_digits(m)) <= 19 and luhn(_digits(m))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 8 <= len(_digits(m)) <= 15),
)


def pii(docs):
    out = []
    for doc_id, text in docs:
        spans = [f"{kind}:{m.start()}:{m.end()}" for kind, p, ok in PII
                 for m in p.finditer(text or "") if ok(m)]
        n = Counter(s.split(":")[0] for s in spans)
        out.append((doc_id, *(n[k] for k, _, _ in PII), sha(",".join(spans)), spans))
    return out


def fingerprint(text):
    w = words(lower_az(text or ""))
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    return {n: root(n) for n in nodes}


def simhash(docs, bits=3):
    prints = [fingerprint(t) for _, t in docs]
    distinct = sorted(set(prints))
    edges = [(a, b) for i, a in enumerate(distinct) for b in distinct[:i]
             if (a ^ b).bit_count() <= bits]
    root = components(distinct, edges)
    least: dict = {}
    for (doc_id, _), fp in zip(docs, prints):
        if doc_id is not None:
            least[root[fp]] = min(doc_id, least.get(root[fp], doc_id))
    return [(doc_id, f"{fp:016x}", least.get(root[fp])) for (doc_id, _), fp in zip(docs, prints)]


def statistics(docs):
    """[(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)]"""
    out = []
    for doc_id, text in docs:
        text = text or ""
        w = words(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        five = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        count = Counter(five)
        covered = {j for i, g in enumerate(five) if count[g] > 1 for j in range(i, i + 5)}
        out.append((doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text),
                    len(lines) - len(set(lines)), len(covered),
                    len(w) < 10 or 100 * len(covered) > 20 * len(w)))
    return out


def quality_scores(docs, target, buckets, folds, smoothing, prior):
    """Score of each text of ``docs``; ``target`` is a list of texts. Each text is scored by
    counts that leave out all texts of its fold."""
    def signed(h):
        return h - (1 << 64) if h >> 63 else h

    def fold(text):
        return signed(xxhash.xxh64_intdigest((text or "").encode(), 42)) % folds

    def grams(text):
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words(text or "")]
        raw = [x.to_bytes(8, "little") for x in h]
        two = [xxhash.xxh64_intdigest(y, xxhash.xxh64_intdigest(x, 42))
               for x, y in zip(raw, raw[1:])]
        return [x % buckets for x in h + two]

    ratio = {}
    for f in range(folds):
        raw = Counter(g for _, t in docs if fold(t) != f for g in grams(t))
        good = Counter(g for t in target if fold(t) != f for g in grams(t))
        total, wanted = sum(raw.values()), sum(good.values())
        p = [(raw[b] + smoothing) / (total + smoothing * buckets) for b in range(buckets)]
        lift = [(good[b] + prior) / (wanted * p[b] + prior) for b in range(buckets)]
        norm = sum(x * y for x, y in zip(p, lift))
        ratio[f] = [math.log(x / norm) if wanted else 0.0 for x in lift]
    out = []
    for _, text in docs:
        some = grams(text)
        out.append(sum(ratio[fold(text)][g] for g in some) / len(some) if some else 0.0)
    return out


def crc(value) -> int:
    return zlib.crc32(str(value).encode())


def suffixes(docs, length=100):
    """[(doc_id, n_bytes, n_removed, n_spans, kept_sha256)] of ``docs`` in document order."""
    seen, out = set(), []
    for doc_id, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            piece = data[i:i + length]
            if piece in seen:
                gone[i:i + length] = b"\1" * length
            seen.add(piece)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((doc_id, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def spelling_words(docs):
    """{word: n} of words of 5 or more code points with 3 or more occurrences."""
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower_az(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] or a[i + 1:] == b[i:] or a[i:] == b[i + 1:]


def spelling(words):
    """[(word, form, root, n, n_near, form_n)], every pair compared."""
    near = {w: [o for o in words if one_edit(w, o)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        f = form[w]
        out.append((w, f, root, words[w], len(near[w]), None if f is None else words[f]))
    return out


def prefix_trie(rows):
    """[(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256)] of ``rows (conv_id, turn, role, text)`` without ties."""
    own: dict[int, list] = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        if c is not None:
            own.setdefault(c, []).append((role or "", text or ""))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members: dict[tuple, list] = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children: dict[tuple, int] = Counter(n[:-1] for n in members if n)
    leaves: dict[tuple, int] = Counter()
    saved: dict[tuple, int] = Counter()
    for node, inside in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(inside) - 1) * (len(node[-1][1]) if node else 0)
    return [(min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n],
             leaves[n], saved[n],
             sha(",".join(str(c) for c in sorted(m) if len(built[c]) == len(n))))
            for n, m in members.items()]
