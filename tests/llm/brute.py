"""Plain definitions of what the text operators return, to hold the real ones against."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np

LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
WORD = re.compile("[^\x20\x09-\x0d]+")


def crc(ids) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def token_files(rows, path):
    from tokenizers import Tokenizer

    tok, start, out = Tokenizer.from_file(path), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def leaks(rows, items, n=13):
    windows = {}
    for item, text in items:
        w = ALNUM.findall((text or "").translate(LOWER))
        k = min(n, len(w))
        for i in range(len(w) - k + 1) if k else ():
            windows.setdefault(tuple(w[i : i + k]), set()).add(item)
    lengths, out = {len(k) for k in windows}, []
    for doc, text in rows:
        w = ALNUM.findall((text or "").translate(LOWER))
        hit, ids = set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                if found := windows.get(tuple(w[i : i + k])):
                    hit |= set(range(i, i + k))
                    ids |= {str(x) for x in found if x is not None}
        sha = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(ids), sha, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def near_duplicates(rows, k=3, percent=85):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j, inter in Counter(j for x in s for j in where[x] if j < i).items():
            if 100 * inter >= percent * (len(s) + len(sets[j]) - inter):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, doc), doc)
    return [(doc, len(sets[i]), least[find(i)], doc == least[find(i)]) for i, (doc, _) in enumerate(rows)]


def repeats(rows, n=35):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def base_rules(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def bad_line(line, phrases):
    words, low = len(re.split(r"[\x20\x09-\x0D]+", line.strip(" "))), line.lower()
    symbols = 12 * sum(c in "#*$%&|<>" for c in line) > len(line)
    navigation = sum(c in "|»•·›" for c in line) >= 2 or len(re.findall(r" [>/] ", line)) >= 2
    unended = words <= 3 and not re.search("[.!?…:;,。！？\"'”’»)\\]][\\x20\\x09-\\x0D]*$", line)
    shouts = len(re.findall("!!", line))
    capitals = words >= 5 and line.upper() == line and low != line
    return symbols or navigation or unended or (shouts >= 2 and 3 * shouts >= words) or capitals or (words <= 30 and any(p in low for p in phrases))


def cleaned(text, phrases):
    """The text's lines that stand, or None for a rejected document."""
    if base_rules(text)[5]:
        return None
    lines = list(dict.fromkeys(x for x in text.split("\n") if WORD.search(x)))
    fine = [x for x in lines if not bad_line(x, phrases)]
    chars = lambda s: len(re.sub(r"[\x20\x09-\x0D]", "", s))
    return "\n".join(fine) if chars(text) - sum(map(chars, fine)) <= 0.5 * chars(text) else None


def paragraphs(text, run=12):
    return {p.rstrip(" ") for p in re.findall(r"(?:[^\n ]+ *){1,%d}" % run, text)}


def fingerprints(rows):
    """doc_id, n_chars, edited_sha256, near_edited, near_next; rows: (doc_id, text, the hash that orders one doc_id's rows)."""
    docs = sorted(((d is None, -(d or 0), h, t or "", d) for d, t, h in rows), key=lambda r: r[:3])
    out = []
    for i, (_, _, _, text, doc) in enumerate(docs):
        after, n = docs[(i + 1) % len(docs)][3], len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        own = paragraphs(text)
        near = [1.0 if not own | x else len(own & x) / len(own | x) for x in (paragraphs(edited), paragraphs(after))]
        out.append((doc, n, hashlib.sha256(edited.encode()).hexdigest(), *near))
    return out


def prefix_trie(rows, block=5, most=9):
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            r, x = role or "", text or ""
            digest = hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).hexdigest()[:32]
            convs.setdefault(c, []).append(((t is not None, t or 0, digest), (r, x)))
    convs = {c: [y for _, y in sorted(v, key=lambda k: k[0])] for c, v in convs.items()}
    nodes, ends = {}, {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % most
        b = convs.get(c - (abs(c) % block) * (1 if c >= 0 else -1), [])[:h] + own[h:]
        for k in range(len(b) + 1):
            nodes.setdefault(tuple(b[:k]), []).append(c)
        ends.setdefault(tuple(b), []).append(c)
    kids, leaves, saved = Counter(p[:-1] for p in nodes if p), Counter(), Counter()
    for p, m in nodes.items():
        for k in range(len(p) + 1):
            saved[p[:k]] += (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
            leaves[p[:k]] += not kids[p]
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return [(min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha(p)) for p, m in nodes.items()]


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def spelling(rows, shortest=5, least=3):
    seen = Counter()
    for doc, text in rows:
        for w in re.findall("[a-zÀ-ÿ]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            seen[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    words = {w: n for w, n in seen.items() if len(w) >= shortest and n >= least}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {w: min(x, key=lambda y: (-words[y], y)) for w, x in near.items() if x}
    form = {w: f for w, f in form.items() if words[f] >= 2 * words[w]}
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return out
