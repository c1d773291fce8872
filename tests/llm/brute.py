"""Plain versions of the operators over lists of rows."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

SPACED = r"[^\x20\x09-\x0D]+"


def lower(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")


def words(text):
    return re.findall(SPACED, text or "")


def warc(pages):
    digest = [base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() for _, _, h in pages]
    least = {}
    for (i, _, _), d in zip(pages, digest, strict=True):
        if i is not None:
            least[d] = min(i, least.get(d, i))
    out = []
    for (i, _, h), d in zip(pages, digest, strict=True):
        first = least.get(d)
        response = first is None or i == first
        out.append((i, len((h or "").encode()), d, "response" if response else "revisit", None if response else first))
    return out


def quality(docs):
    out = []
    for i, text in docs:
        text = text or ""
        w = words(text)
        lines = [x for x in text.split("\n") if words(x)]
        grams = Counter(zip(w, w[1:], w[2:]))
        hit = {k + j for k in range(len(w) - 2) for j in range(3) if grams[tuple(w[k : k + 3])] > 1}
        symbols = sum(c in "#*$%&|<>" for c in text)
        chars, dup = sum(map(len, w)), len(lines) - len(set(lines))
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        kept = not failed and not (10 * symbols > 3 * len(w) or 100 * dup > 40 * len(lines) or chars < 2 * len(w) or chars > 15 * len(w))
        listed, ended = sum(bool(re.match("[ \t]*[-*\u2022]", x)) for x in lines), sum(bool(re.search(r"(\.\.\.|\u2026)[ \t\r]*\Z", x)) for x in lines)
        plain = sum(bool(re.search("[A-Za-z\u0080-\U0010ffff]", x)) for x in w)
        kept = kept and not (10 * listed > 9 * len(lines) or 10 * ended > 3 * len(lines) or 10 * plain < 7 * len(w) or max(map(len, w)) > 1000)
        out.append((i, len(w), chars, symbols, dup, len(hit), failed, kept))
    return out


def simhash(text, shingle=3):
    w = words(lower(text))
    grams = [" ".join(w[k : k + shingle]) for k in range(len(w) - shingle + 1)] if len(w) >= shingle else [" ".join(w)] if w else []
    h = np.array([xxhash.xxh64_intdigest(g.encode(), 42) for g in grams], dtype=np.uint64)
    return sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))


def near_duplicates(docs):
    fps = [simhash(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, f"{fps[k]:016x}", least.get(find(k))) for k, (i, _) in enumerate(docs)]


def contamination(docs, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    known = {}
    for i, text in items:
        w = split(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            known.setdefault(tuple(w[k : k + n]), set()).add(i)
    sizes = {len(k) for k in known}
    out = []
    for i, text in docs:
        w = split(text)
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in known:
                    hit |= set(range(k, k + n))
                    found |= known[x]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def base_scores(docs):
    tokens = [[*words(lower(t)), None] for _, t in docs]
    held = [zlib.crc32(str("" if i is None else i).encode()) % 7 == 2 for i, _ in docs]
    c = Counter(w for x, h in zip(tokens, held, strict=True) if not h for w in x)
    n, v = sum(c.values()), len(c)
    return [(i, h, len(x), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x)) for (i, _), x, h in zip(docs, tokens, held, strict=True)]


def line_runs(docs, min_lines=2, min_words=20):
    """(id, text without later copies) of documents that differ in (id, text)."""
    order = lambda d: (d[0] is not None, d[0] or 0)
    known = sorted({d for d in docs if d[1] is not None}, key=lambda d: (order(d), xxhash.xxh64_intdigest(d[1].encode(), 42) - (1 << 63 << 1) * (xxhash.xxh64_intdigest(d[1].encode(), 42) >> 63)))
    seen, out = set(), {}
    for d in known:
        lines = d[1].split("\n")
        kept = [(n, " ".join(words(x))) for n, x in enumerate(lines) if words(x)]
        gone = set()
        for k in range(len(kept)):
            one, two = (kept[k][1],), tuple(x for _, x in kept[k : k + min_lines])
            if one in seen and len(one[0].split(" ")) >= min_words:
                gone.add(k)
            if len(two) == min_lines and two in seen:
                gone |= set(range(k, k + min_lines))
            seen.add(one)
            seen.add(two)
        dead = {kept[k][0] for k in gone}
        for k in gone:
            if k + 1 in gone:
                dead |= set(range(kept[k][0], kept[k + 1][0]))
        out[d] = "\n".join(x for n, x in enumerate(lines) if n not in dead)
    return [(d[0], out.get(d)) for d in docs]


def representatives(texts, similarity=80):
    """The numbers of the texts that are the first of their group; groups are what five-word Jaccard similarity connects."""
    split = [words(lower(t)) for t in texts]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {()} for w in split]
    group = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if group[a] != group[b] and 100 * len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    return sorted(set(group))


def unit_removals(docs, min_words=8, context=25):
    """(id, start, end, kept id) of the later copies of lines, and of sentences of lines that stay; rows in order."""
    found = []  # (digest words, (id is null, id, row, start, whole), end, line)
    for row, (i, text) in enumerate(docs):
        text, before = text or "", []
        for m in re.finditer(r"[^\n]+", text):
            pieces = [(a + m.start(), b + m.start()) for a, b in sentence_spans(m.group())]
            pieces = [(a, b, text[a:b].lower().split()) for a, b in pieces if text[a:b].split()]
            key = lambda start, whole: (i is None, i or 0, row, start, m.start(), whole)
            if pieces:
                found.append((tuple(w for p in pieces for w in p[2]), key(m.start(), True), m.end(), (row, m.start())))
            for a, b, own in pieces:
                seen, start = own, a
                if len(own) < min_words:
                    for s, w in reversed(before):
                        if len(seen) >= context:
                            break
                        if len(seen) + len(w) <= context:
                            start = s
                        seen = [*w, *seen]
                    seen = seen[-context:] if len(seen) >= context else []
                before.append((a, own))
                if seen and (len(pieces) > 1 or len(own) < min_words):
                    found.append((tuple(seen), key(start, False), b, (row, m.start())))
    first = {}
    for words_, key, _, _ in found:
        first[words_] = min(key, first.get(words_, key))
    later = [(w, k, e, line) for w, k, e, line in found if k > first[w] and (k[2], k[3]) != (first[w][2], first[w][3])]
    gone = {line for _, k, _, line in later if k[5]}
    return [(docs[k[2]][0], k[3], e, docs[first[w][2]][0]) for w, k, e, line in later if k[5] or line not in gone]


def sentence_spans(line):
    at = 0
    for m in re.finditer(r"(?<=[.!?])[^\S\n]+", line):
        if m.start() > at:
            yield at, m.start()
        at = m.end()
    if at < len(line):
        yield at, len(line)


WEIGHTS = {"domain": {"web": 5, "books": 3}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}}


def filled(budget, children):
    """Whole tokens of each (weight, capacity): the level at which all that aren't full get alike, rounded down."""
    budget = min(budget, sum(c for _, c in children.values()))
    best, rest = None, budget
    order = sorted(children, key=lambda k: (children[k][1] / children[k][0], k))
    weights = sum(w for w, _ in children.values())
    for k in order:
        w, c = children[k]
        best = max(best or (-1, 0, 1), (rest / weights, rest, weights))
        rest, weights = rest - c, weights - w
    return {k: min(c, best[1] * w // best[2]) for k, (w, c) in children.items()}


def mixed(docs, percent=60, epochs=4):
    """(row number, n_tokens, epoch, take_tokens) of rows (id, text, lang, source)."""
    leaves = {}
    for row, (i, text, lang, source) in enumerate(docs):
        n = len(words(text))
        if n:
            source = source or ""
            m = re.search("([0-9]{1,6})$", source)
            leaves.setdefault((["web", "books", "code", "news"][int(m.group(1)) % 4 if m else 0], lang or "", source), []).append((row, i, text or "", n))
    capacity = {k: epochs * sum(x[3] for x in v) for k, v in leaves.items()}
    budgets = {(): sum(capacity.values()) // epochs * percent // 100}
    for level in (1, 2, 3):
        parents, budgets = budgets, {}
        for p, b in parents.items():
            names = {k[:level] for k in leaves if k[: level - 1] == p}
            if names:
                weigh = lambda k: WEIGHTS.get(["domain", "lang", "source"][level - 1], {}).get(k[-1], 1)
                budgets |= filled(b, {k: (weigh(k), sum(c for x, c in capacity.items() if x[:level] == k)) for k in names})
    out = []
    for leaf, rows in leaves.items():
        tokens = sum(x[3] for x in rows)
        whole, part = divmod(budgets[leaf], tokens)
        out += [(row, n, e, n) for row, _, _, n in rows for e in range(whole)]
        digest = lambda x: hashlib.md5(x.encode()).hexdigest()
        for row, i, text, n in sorted(rows, key=lambda x: (digest(f"mix-1:{whole}:{'' if x[1] is None else x[1]}:{digest(x[2])}"), x[1] or 0)):
            if part > 0:
                out.append((row, n, whole, min(n, part)))
                part -= n
    return out


def pipeline(docs, items):
    """Rows (id, text, n_chars, n_tokens, epoch, take_tokens) of documents (id, text, lang, source, n_chars)."""
    docs = [d for d, q in zip(docs, quality([d[:2] for d in docs]), strict=True) if q[7]]
    cleaned = line_runs([d[:2] for d in docs])
    docs = [(d[0], t, d[2], d[3], d[4] if t == d[1] else len(t)) for d, (_, t) in zip(docs, cleaned, strict=True) if t == d[1] or words(t)]
    docs.sort(key=lambda d: (d[0] is None, d[0] or 0))
    docs = [docs[i] for i in representatives([d[1] for d in docs])]
    hit = {c[0] for c in contamination([d[:2] for d in docs], items) if c[5]}
    docs = [d for d in docs if d[0] is None or d[0] not in hit]
    return [(docs[row][0], docs[row][1], docs[row][4], n, epoch, take) for row, n, epoch, take in mixed([d[:4] for d in docs])]


def runs_of(x, min_length=12):
    """(start, length, period) of all periodic runs of a sequence, by start, then period."""
    found = {}
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((i, n, q) for (i, n), q in found.items()), key=lambda r: (r[0], r[2]))


def periodic(docs):
    out = []
    for i, text in docs:
        w = words(text)
        h = None if i is None else zlib.crc32(str(i).encode())
        if h is not None and h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        found = runs_of(w)
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        milli = 1000 * best[1] // best[2] if found else None
        out.append((i, len(found), *best, milli, digest("".join(f"{s},{n},{q}\n" for s, n, q in found)), digest(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def merkle(rows):
    """rows (doc_id, text, lang, source, n_chars)."""
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    framed = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def fold(level):
        """The root and, for each node, its steps: what is left and right of it."""
        steps, at, levels = [[] for _ in level], list(range(len(level))), list(level)
        while len(levels) > 1:
            for k, i in enumerate(at):
                run = i // 3 * 3
                steps[k].append(("".join(levels[run:i]), "".join(levels[i + 1 : run + 3])))
            levels = [sha("".join(levels[i : i + 3])) for i in range(0, len(levels), 3)]
            at = [i // 3 for i in at]
        return levels[0], steps

    trees = {}
    for i, text, lang, source, n in rows:
        leaf = lambda t: sha("".join(map(framed, (i, source, lang, n, t))))  # noqa: E731, B023
        other = leaf(text.replace("\n", "")) if i is not None and text is not None and zlib.crc32(str(i).encode()) % 2 == 0 else leaf(text)
        trees.setdefault(source, []).append((i is not None, i or 0, leaf(text), other, i))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for name in names:
        trees[name].sort(key=lambda r: r[:3])
    subroots = {name: fold([r[2] for r in trees[name]]) for name in names}
    root, top = fold([subroots[name][0] for name in names])
    out = []
    for k, name in enumerate(names):
        for (_, _, leaf, other, i), steps in zip(trees[name], subroots[name][1], strict=True):
            path, again = steps + top[k], other
            for left, right in path:
                again = sha(left + again + right)
            out.append((i, leaf, subroots[name][0], root, sha("".join(a + b for a, b in path)), again, again == root))
    return out


def similar(docs, percent=80):
    split = [words(lower(t)) for _, t in docs]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in split]
    group = list(range(len(docs)))
    for b in range(len(docs)):
        for a in range(b):
            if group[a] != group[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    least = {}
    for g, (i, _) in zip(group, docs, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return [(i, len(s), least.get(g)) for (i, _), s, g in zip(docs, sets, group, strict=True)]
