"""Plain Python versions of the document operators, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile("[^\x20\x09-\x0D]+")


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def fold(doc_id, modulus):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % modulus


def contaminated(docs, items, size=10):
    win = {}
    for item_id, text in items:
        if item_id is None:
            continue
        w = WORD.findall(lower(text))
        m = min(size, len(w))
        for i in range(len(w) - m + 1) if m else ():
            win.setdefault(tuple(w[i:i + m]), set()).add(str(item_id))
    out = []
    for doc_id, text in docs:
        w, hit, got = WORD.findall(lower(text)), set(), set()
        for m in {len(k) for k in win}:
            for i in range(len(w) - m + 1):
                k = win.get(tuple(w[i:i + m]))
                if k:
                    hit |= set(range(i, i + m))
                    got |= k
        out.append((doc_id, len(w), len(hit), len(got), sorted(got), bool(hit)))
    return out


def without_repeats(docs, length):
    count = Counter()
    raw = [(d, (t or "").encode()) for d, t in docs]
    for _, b in raw:
        count.update(b[i:i + length] for i in range(len(b) - length + 1))
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def nearest(rows, is_query, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, a in ok:
        if not is_query(q):
            continue
        s = [(-float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), i) for i, b in ok if i != q and len(b) == len(a)]
        out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(sorted((round(x, 12), i) for x, i in s)[:k])]
    return out


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def personal_data(text):
    """[(kind, start, end)] of the base kinds."""
    def luhn(d):
        t = 0
        for i, c in enumerate(reversed(d)):
            v = int(c) * (2 if i % 2 else 1)
            t += v - 9 if v > 9 else v
        return t % 10 == 0

    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), rank, kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


def jaccard_classes(docs, words=5, threshold=0.8):
    """{doc_id: (class, links)}"""
    sets = {}
    for d, text in docs:
        w = WORD.findall(lower(text))
        sets[d] = {tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    inv, links = defaultdict(list), {d: set() for d in sets}
    for d, s in sets.items():
        common = Counter(o for x in s for o in inv[x])
        for x in s:
            inv[x].append(d)
        for o, m in common.items():
            if m >= threshold * (len(s) + len(sets[o]) - m) - 1e-9:
                links[d].add(o)
                links[o].add(d)
    root, moved = {d: d for d in sets}, True
    while moved:
        moved = False
        for d in sets:
            m = min([root[d], *(root[o] for o in links[d])])
            if m < root[d]:
                root[d], moved = m, True
    return {d: (root[d], len(links[d])) for d in sets}


def base_scores(docs):
    """(train tokens, {doc_id: (tokens, known, base score)})"""
    count, own = Counter(), {}
    for d, text in docs:
        own[d] = [*TOKEN.findall(lower(text)), "\0end"]
        if d is not None and fold(d, 7) != 2:
            count.update(own[d])
    n, v = sum(count.values()), len(count)
    return n, {d: (len(t), sum(count[x] > 0 for x in t), sum(np.log10((count[x] + 1) / (n + v + 1)) for x in t)) for d, t in own.items()}


def levels(children, budget):
    """Water filling: [(weight, supply)] -> budgets."""
    out, open_ = [0.0] * len(children), [i for i, (w, _) in enumerate(children) if w > 0]
    while open_:
        total = sum(children[i][0] for i in open_)
        full = [i for i in open_ if children[i][1] <= budget * children[i][0] / total]
        if not full:
            for i in open_:
                out[i] = budget * children[i][0] / total
            break
        for i in full:
            out[i] = children[i][1]
        budget -= sum(children[i][1] for i in full)
        open_ = [i for i in open_ if i not in full]
    return out


def echoed(doc_id, text):
    """Words of a text, the tail made periodic for one id in ten."""
    w = TOKEN.findall(text or "")
    n, h = len(w), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def periodic_runs(w):
    """(start, period, length) of all runs, by trying each period."""
    n, out = len(w), []
    code = {x: i for i, x in enumerate(dict.fromkeys(w))}
    x = np.array([code[v] for v in w], int)
    for q in range(1, n // 4 + 1):
        same = np.concatenate([[False], x[:-q] == x[q:], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for a, b in edge.reshape(-1, 2).tolist():
            if b - a + q >= max(6, 4 * q) and not any((x[a:b + q - e] == x[a + e:b + q]).all() for e in range(1, q)):
                out.append((a, q, b - a + q))
    return sorted(out)


def collapsed(w, found):
    gone = set()
    for a, q, length in found:
        gone |= set(range(a + q, a + length))
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def simhash(text):
    import xxhash
    w = TOKEN.findall(lower(text))
    s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_components(docs):
    """[(doc_id, fingerprint, component)] by comparing all pairs."""
    fp = [simhash(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        k = find(i)
        least[k] = min((x for x in (least.get(k), d) if x is not None), default=None)
    return [(d, f"{fp[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(docs)]


def divergence(docs, least_docs=30, top=50):
    """docs: (text, lang, source); rows of the audit."""
    n, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        w = re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        groups[lang].add(source)
        n[lang, source].update(w)
        df[lang].update(set(w))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, c in df[lang].items() if c >= least_docs]

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q = shares(sum((n[lang, s] for s in sources), Counter()))
        p = {s: shares(n[lang, s]) for s in sources}
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -v, r + 1) for r, (v, _, item) in enumerate(found)]
    return out


def word_hash(word: bytes):
    """The fingerprint of a word, byte by byte with whole numbers."""
    from tapeflow.llm import common

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
        x = (x ^ x >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
        return x ^ x >> 31

    base, total = (common._BASE * 3 | 1) & (1 << 64) - 1, 0
    for i, b in enumerate(word):
        total += mixed((b + 1) * common._BASE_INV + 1 & (1 << 64) - 1) * pow(base, i, 1 << 64)
    return mixed(total + len(word) & (1 << 64) - 1)


def passage_features(text):
    """Feature lists of the passages of a text, by counting."""
    from tapeflow.llm import quality as Q
    raw = (text or "").encode()
    spans = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    words = [raw[a:b] for a, b in spans]
    low = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    kinds = [int(Q._CLASSES[c]) for c in raw]
    out = []
    for a in range(0, max(len(words), 1), Q.PASSAGE):
        b = min(a + Q.PASSAGE, len(words))
        if a == b:
            out.append([0.0] * Q.N_FEATURES)
            continue
        lo, hi, n = spans[a][0], spans[b - 1][1], b - a
        x = [kinds[lo:hi].count(k) / (hi - lo) for k in range(Q.N_CLASSES)]
        own = range(a, b)
        shouts = [2 * sum(65 <= c <= 90 for c in words[i]) > len(words[i]) > 2 for i in own]
        x += [sum(len(words[i]) / 16 for i in own) / n, sum(shouts) / n, sum(int(Q._CLASSES[words[i][-1]]) in (7, 8, 9) for i in own) / n]
        x += [sum(i >= d and low[i] == low[i - d] for i in own) / n for d in (1, 2, 3)]
        x += [sum(len(words[i]) == 1 for i in own) / n, min(n / Q.PASSAGE, 1)]
        h = [word_hash(low[i]) for i in own]
        x += [sum(v >> k & 1 for v in h) / n - 0.5 for k in range(Q.N_BITS)]
        out.append(x)
    return out


def quality_score(p, text):
    """Gated attention over the passages in plain loops."""
    p = {k: v.astype(float).tolist() for k, v in p.items()}
    hidden = range(len(p["c"]))
    z, s = [], []
    for x in passage_features(text):
        x = [(v - m) / d for v, m, d in zip(x, p["mean"], p["std"], strict=True)]
        e = [np.tanh(sum(x[i] * p["E"][i][j] for i in range(len(x))) + p["e"][j]) for j in hidden]
        gate = [np.tanh(sum(e[i] * p["V"][i][j] for i in hidden)) / (1 + np.exp(-sum(e[i] * p["U"][i][j] for i in hidden))) for j in hidden]
        z.append(e)
        s.append(sum(g * w for g, w in zip(gate, p["w"], strict=True)))
    top = [np.exp(v - max(s)) for v in s]
    bag = [sum(a * e[j] for a, e in zip(top, z, strict=True)) / sum(top) for j in hidden]
    return 1 / (1 + np.exp(-(sum(m * c for m, c in zip(bag, p["c"], strict=True)) + p["b"][0])))


def language_vector(text):
    """The unit vector of a text: letter vectors rotated, multiplied and added n-gram by n-gram; None without letters."""
    from tapeflow.llm import language as L
    letters = []
    for c in f" {text or ''} ".lower():
        if c.isalpha():
            letters.append(c)
        elif not letters or letters[-1] != " ":
            letters.append(" ")
    if not any(c != " " for c in letters):
        return None
    total = np.zeros(L.DIM)
    for i in range(len(letters) - L.NGRAM + 1):
        v = np.ones(L.DIM)
        for j in range(L.NGRAM):
            v *= np.roll(L.letter(ord(letters[i + j])).astype(float), j)
        total += v
    return total / max(np.linalg.norm(total), 1e-9)


def languages(docs):
    """[(doc_id, prediction, score)] of (doc_id, text, lang) rows."""
    from tapeflow.llm import language as L
    unit = [language_vector(t) for _, t, _ in docs]
    proto = {}
    for (d, t, lang), u in zip(docs, unit, strict=True):
        if lang is not None and t is not None and fold(d, L.FOLDS) not in (0, None) and u is not None:
            proto[lang] = proto.get(lang, 0) + np.rint(u * L.SCALE)
    names = sorted(proto)
    out = []
    for (d, _, _), u in zip(docs, unit, strict=True):
        cos = [float(u @ proto[n] / np.linalg.norm(proto[n])) for n in names] if u is not None else []
        out.append((d, names[int(np.argmax(cos))], (1 + max(cos)) / 2) if cos else (d, "und", 0.0))
    return out
