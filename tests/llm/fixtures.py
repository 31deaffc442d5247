"""Small corpora with the awkward cases, and brute-force versions of the operators."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re

import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, key int, part string, rows int, text_key string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
BLANKS = " \t\n\x0b\f\r"


def corpus(n: int = 60, seed: int = 1) -> list[tuple]:
    """Documents with copies, near copies, shared passages and lines, odd blanks, nulls, one long text."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéüß") for _ in range(r.randint(1, 7))) for _ in range(400)]
    vocab += ["The", "OF", "And,", "x"]
    words = lambda k: [r.choice(vocab) for _ in range(k)]
    passage, line = " ".join(words(70)), "  A Line That Many documents Share, again \t"
    docs: list[str | None] = []
    for i in range(n):
        t = "\n".join(" ".join(words(r.randint(1, 40))) for _ in range(r.randint(1, 6)))
        if i % 5 == 1:
            t = t + "\n" + (line if i % 2 else line.upper()) + "\nend"
        if i % 7 == 2:
            t = " ".join(words(9)) + " " + passage + " " + " ".join(words(r.randint(0, 30)))
        if i % 9 == 3 and docs:
            t = docs[r.randrange(len(docs))] or ""
        if i % 11 == 4 and docs:
            w = (docs[-1] or "a b c d e f").split(" ")
            w[r.randrange(len(w))] = "changed"
            t = " ".join(w)
        docs.append(t)
    docs += [None, "", " \n\t ", "one", "two words", "\n", "a\x0bb\x0cc\rd", "ab " * 300, "é" * 150 + "é" * 150, " ".join(words(3000)), docs[0], docs[0]]
    return [(i, t, None if i % 13 == 0 else "en", None if i % 17 == 0 else f"s{i % 4}", len(t or ""), "s", 7, "p", 3, "k") for i, t in enumerate(docs)]


def frame(spark, rows, schema: str = SCHEMA):
    return spark.createDataFrame(rows, schema).repartition(3)


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return (text or "").translate(LOWER)


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def text_hash(b: bytes) -> int:
    """Spark's xxhash64 of a text."""
    return int.from_bytes(xxhash.xxh64(b, seed=42).digest(), "big", signed=True)


def shared_ids(rows: list[tuple]) -> list[tuple]:
    """More rows for a corpus: repeated ones, and other texts under doc_ids that have one."""
    r = random.Random(5)
    other = [" ".join("".join(r.choice("qwzx") for _ in range(5)) for _ in range(90)) for _ in range(3)]
    give = lambda i, t: (i, t, *rows[0][2:])
    long_ = rows[2][1] or ""
    return [*rows, rows[3], rows[3], give(2, other[0]), give(9, long_), give(9, other[1]), give(9, long_ + " " + other[2]), give(40, other[2]), give(40, long_)]


def line_dedup(rows, min_chars=20, min_docs=3):
    key = lambda x: lower(x.strip(BLANKS))
    held: dict = {}
    for d, t, *_ in rows:
        if d is not None:
            for x in set(map(key, (t or "").split("\n"))):
                if len(x) >= min_chars:
                    held.setdefault(x, set()).add(d)
    out = []
    for d, t, *_ in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if not (d is not None and len(held.get(key(x), ())) >= min_docs and d != max(held[key(x)]))]
        out.append((d, len(ls), len(ls) - len(kept), sha("\n".join(kept))))
    return out


def shingles(text, n):
    w = words(lower(text))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard_components(rows, n=3, percent=90):
    sets = [shingles(t, n) for _, t, *_ in rows]
    root: dict = {d: d for d, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i][0], rows[j][0]
            if a is None or b is None or not sets[i] or not sets[j]:
                continue
            inter = len(sets[i] & sets[j])
            if 100 * inter >= percent * (len(sets[i]) + len(sets[j]) - inter):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [(d, len(s), None if d is None else find(d)) for (d, *_), s in zip(rows, sets)]


def topk(rows, k=20):
    ok = []
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.append((i, [math.floor(64 * x) for x in v]))
    out = []
    asked = {q: min(v for i, v in ok if i == q) for q, _ in ok if q % 20 == 0}  # repeated rows are one query
    for q, v in asked.items():
        s = sorted((-sum(x * y for x, y in zip(v, u)), c) for c, u in ok if c != q)[:k]
        out += [(q, r + 1, c, -x) for r, (x, c) in enumerate(s)]
    return out


def word_substrings(rows, w=50):
    first: dict = {}
    ws = {id(r): words(r[1]) for r in rows}
    for r in rows:
        if r[0] is not None:
            x = ws[id(r)]
            for i in range(len(x) - w + 1):
                k = tuple(x[i : i + w])
                first[k] = min(first.get(k, r[0]), r[0])
    out = []
    for r in rows:
        x = ws[id(r)]
        gone = [False] * len(x)
        if r[0] is not None:
            for i in range(len(x) - w + 1):
                if first[tuple(x[i : i + w])] < r[0]:
                    gone[i : i + w] = [True] * w
        kept = [y for y, g in zip(x, gone) if not g]
        out.append((r[0], len(x), sum(gone), sha(" ".join(kept))))
    return out


def byte_substrings(rows, w=100):
    raw = [((d, (t or "").encode())) for d, t, *_ in rows]
    order = {b: text_hash(b) for _, b in raw}  # texts that share a doc_id follow each other by it
    first: dict = {}
    for d, b in raw:
        if d is not None:
            for i in range(len(b) - w + 1):
                k = b[i : i + w]
                if k not in first or (d, order[b], i) < first[k]:
                    first[k] = (d, order[b], i)
    out = []
    for d, b in raw:
        gone = [False] * len(b)
        if d is not None:
            for i in range(len(b) - w + 1):
                if first[b[i : i + w]] < (d, order[b], i):
                    gone[i : i + w] = [True] * w
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def warc(rows, least=0):
    pay = [(p, (h or "").encode()) for p, _, h, *_ in rows]
    first: dict = {}
    for p, b in pay:
        if p is not None:
            first[b] = min(first.get(b, p), p)
    out = []
    for p, b in pay:
        f = first.get(b)
        again = len(b) >= least and f is not None and p != f
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", f if again else None))
    return out


BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def decontaminate(rows, items, w=13):
    wins: dict = {}
    for i, t, *_ in items:
        x = BENCH_WORD.findall(lower(t))
        n = min(w, len(x))
        for s in range(len(x) - n + 1) if x else ():
            wins.setdefault(tuple(x[s : s + n]), set()).add(i)
    out = []
    for d, t, *_ in rows:
        x = BENCH_WORD.findall(lower(t))
        hit, found = set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(x) - n + 1):
                k = tuple(x[s : s + n])
                if k in wins:
                    hit.update(range(s, s + n))
                    found |= wins[k]
        names = sorted(str(i) for i in found if i is not None)
        out.append((d, len(x), len(hit), len(names), sha(",".join(names)), bool(hit) and 20 * len(hit) >= len(x)))
    return out
