"""Plain versions of the corpus operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

SPACES = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))


def exact(docs):
    """{doc_id: (keep_id, group_size)} of distinct ids."""
    groups = defaultdict(list)
    for name, text in docs:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(name)
    return {name: (min(g), len(g)) for g in groups.values() for name in g}


def lines(docs, min_chars, min_docs):
    """{doc_id: (text left, lines, dropped)}."""
    holders = defaultdict(set)
    for name, text in docs:
        for line in (text or "").split("\n"):
            holders[lower(line.strip(SPACES))].add(name)
    out = {}
    for name, text in docs:
        own = (text or "").split("\n")
        kept = [x for x in own if not (len(k := lower(x.strip(SPACES))) >= min_chars and len(holders[k]) >= min_docs and max(holders[k]) != name)]
        out[name] = "\n".join(kept), len(own), len(own) - len(kept)
    return out


def repeats(docs, size):
    """{doc_id: (bytes, removed, runs, sha256 of the rest)}."""
    first = {}
    for name, data in sorted(docs):
        for i in range(len(data) - size + 1):
            first.setdefault(data[i : i + size], name)
    out = {}
    for name, data in docs:
        gone = np.zeros(len(data), dtype=bool)
        for i in range(len(data) - size + 1):
            if first[data[i : i + size]] < name:
                gone[i : i + size] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        out[name] = len(data), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(data, np.uint8)[~gone])).hexdigest()
    return out


def shingles(text, width):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def similar(docs, width, per_cent):
    """{doc_id: (set size, component)}."""
    sets = {name: shingles(text, width) for name, text in docs}
    label = {name: name for name in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= per_cent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {name: (len(s), root(name)) for name, s in sets.items()}


def letters(text):
    return [lower(w) for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text or "")]


def leaks(docs, items, error_percent, min_words):
    """{(doc_id, item_id): word edits} by the full table of distances."""
    out = {}
    for item, text in items:
        p = letters(text)
        budget = len(p) * error_percent // 100
        if len(p) < min_words:
            continue
        for name, body in docs:
            w = letters(body)
            row = [0] * (len(w) + 1)
            for a in range(1, len(p) + 1):
                new = [a]
                for b in range(1, len(w) + 1):
                    new.append(min(row[b - 1] + (p[a - 1] != w[b - 1]), row[b] + 1, new[-1] + 1))
                row = new
            if min(row) <= budget:
                out[name, item] = min(row)
    return out


def katz(docs, order, discounts):
    """Rows (doc_id, held_out, tokens, known, training tokens, base score, score), and a check that contexts sum to one."""
    held = {name: zlib.crc32(str(name).encode()) % 7 == 2 for name, _ in docs}
    tokens = [[*words(text), "</s>"] for _, text in docs]
    counts = [Counter() for _ in range(order + 1)]

    def grams(seq, m):
        for i, w in enumerate(seq):
            yield tuple(seq[max(0, i - m + 1) : i]) if i >= m - 1 else ("<s>", *seq[:i]), w

    for (name, _), seq in zip(docs, tokens):
        if not held[name]:
            for m in range(1, order + 1):
                counts[m].update(grams(seq, m))
    kept = [None]
    for m in range(1, order + 1):
        n = Counter(counts[m].values())
        kept.append([*discounts(np.array([n[r] for r in range(1, 7)])), 1.0])
    follow = [defaultdict(dict) for _ in range(order + 1)]
    for m in range(1, order + 1):
        for (h, w), c in counts[m].items():
            follow[m][h][w] = c
    known = {}

    def shorter(m, h):
        real = [x for x in h if x != "<s>"]
        return tuple(real[len(real) - (m - 2) :]) if len(real) >= m - 2 else ("<s>", *real)

    def context(m, h):
        if (m, h) not in known:
            own = follow[m].get(h, {})
            total, left = sum(own.values()), sum(c * (1 - kept[m][min(c, 6) - 1]) for c in own.values())
            whole = max(total + (left <= 0), 1)
            rest = 1 - sum(p(m - 1, shorter(m, h), w) for w in own) if m > 1 else None
            known[m, h] = own, whole, (left if left > 0 else 1.0) / whole, rest
        return known[m, h]

    def p(m, h, w):
        own, whole, left, rest = context(m, h)
        if w in own:
            return kept[m][min(own[w], 6) - 1] * own[w] / whole
        if m == 1:
            return left
        return (left / rest if own else 1.0) * p(m - 1, shorter(m, h), w)

    total, types, out = sum(counts[1].values()), len(counts[1]), []
    for (name, _), seq in zip(docs, tokens):
        score = sum(math.log10(p(order, h, w)) for h, w in grams(seq, order))
        base = sum(math.log10((counts[1][(), w] + 1) / (total + types + 1)) for w in seq)
        out.append((name, held[name], len(seq), sum(counts[1][(), w] > 0 for w in seq), total, base, score))
    for m in range(1, order + 1):
        for h in list(follow[m])[:30]:
            assert abs(sum(p(m, h, w) for w in context(1, ())[0]) + p(m, h, "\0unknown") - 1) < 1e-9
    return out


def repeated_words(docs, size):
    """Sorted rows (doc_id, words, removed, sha256 of the rest, spans); rows with a null id stay whole and remove nothing."""
    split = [(name, re.findall(r"[^\x20\x09-\x0D]+", text or "")) for name, text in docs]
    first = {}
    for name, w in split:
        for i in range(len(w) - size + 1):
            if name is not None:
                k = tuple(w[i : i + size])
                first[k] = min(first.get(k, name), name)
    out = []
    for name, w in split:
        gone = np.zeros(len(w), dtype=bool)
        for i in range(len(w) - size + 1):
            if name is not None and first[tuple(w[i : i + size])] < name:
                gone[i : i + size] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((name, len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest(), kept, list(zip(edges[::2].tolist(), edges[1::2].tolist()))))
    return sorted(out, key=str)


def spellings(docs, least, min_count, ratio, every):
    """Sorted rows (word, form, root, n, n_near, form_n) by comparing all words with all words."""
    counts = Counter()
    for name, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= least
    counts = {w: n for w, n in counts.items() if n >= min_count}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= ratio * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return sorted(out, key=str)


def aligned(docs, encode_a, encode_b):
    """Sorted rows as the alignment returns them; encoders give (id, bytes) pairs of space + text."""
    links, rows = [], []
    for name, text in docs:
        whole = (" " + text).encode() if text else b""
        a, b = (encode(text) if text else [] for encode in (encode_a, encode_b))
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            a, b = [], []
        ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (a, b)]
        own = [(i, j) for i in range(len(a)) for j in range(len(b)) if ends[0][i] - len(a[i][1]) < ends[1][j] and ends[1][j] - len(b[j][1]) < ends[0][i]]
        groups, start = [], 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            groups.append("|".join(",".join(str(k) for (k, _), e in zip(side, e_side) if start < e <= cut) for side, e_side in zip((a, b), ends)))
            start = cut
        links.append([(a[i][0], b[j][0]) for i, j in own])
        rows.append((name, len(a), len(b), len(groups), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    counts = Counter(x for own in links for x in own)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return sorted(((*row[:5], sum(counts[x] == best[x[1]] for x in own), sum(counts[x] for x in own), row[5]) for row, own in zip(rows, links)), key=str)
