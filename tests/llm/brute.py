"""Plain versions of the operators, and the documents that they are compared on."""

import hashlib
import random
import re
from collections import Counter, defaultdict

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, _keep string, _text int, id long, text2 string, "
          "n_words string, kept int, key string, _row int, score string, h1 int, token string, _id int")
BLANKS = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def texts():
    """Plain texts, copies, near copies, shared passages and lines, and odd ones."""
    rnd = random.Random(7)
    words = [a + b + c for a in "tshrn" for b in "aeiou" for c in ("n", "re", "st", "ng", "ä", "Ü")]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage, line, base = prose(90), "A line that many of these documents share, with blanks", prose(160)
    out = [None, "", " \t ", "\n\n", "one", "two words", "a b c", "aaaa " * 120, "x" * 900, "ab" * 300, "é" * 450, "日本語" * 120, "▁ ▁\x00"]
    out += [prose(40), base, base, base]
    for k in range(1, 9):
        near = base.split()
        for j in range(k):
            near[rnd.randrange(len(near))] = f"edit{k}{j}"
        out.append(" ".join(near))
    out += [prose(20) + "\n" + passage + "\n" + prose(15) for _ in range(6)]
    out += [prose(12) + f"\n  {line.upper() if k % 2 else line}\t\n" + prose(12) for k in range(7)]
    out += [prose(30) + " " + s for s in (
        "Released under the MIT License.", "Licensed under the Apache License, Version 2.0. Apache license", "GENERAL PUBLIC LICENSE",
        "Licensed under CC BY-NC 4.0", "permission is hereby granted free of charge to any person obtaining a copy of this software and documentation files")]
    out += ["### " * 30 + prose(20), prose(3000), (prose(9) + "\n") * 25, "A B C D E F G H " * 20]
    return out


def rows():
    """Rows with null ids and columns that clash with names inside the operators; the last repeats one as it is."""
    out = []
    for k, t in enumerate(texts()):
        out.append((k, t, None if k % 5 == 0 else "en" if k % 2 else "de", None if k % 7 == 0 else f"s{k % 3}", len(t or ""), "k", k, -k, "t", "w", 1, "y", 3, "s", 0, "q", 9))
    return out


def documents(spark, which=None):
    return spark.createDataFrame(rows() if which is None else which, SCHEMA).repartition(3)


def by_id(which=None):
    return {r[0]: r[1] or "" for r in (rows() if which is None else which)}


def license_places(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    at, labels = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i:i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return w, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def line_dedup(docs):
    where = defaultdict(set)
    for i, t in docs.items():
        for s in t.split("\n"):
            if len(k := lower(s.strip(BLANKS))) >= 40:
                where[k].add(i)
    out = {}
    for i, t in docs.items():
        kept = [s for s in t.split("\n") if not (len(k := lower(s.strip(BLANKS))) >= 40 and len(where[k]) >= 5 and max(where[k]) != i)]
        n = t.count("\n") + 1
        out[i] = (n, n - len(kept), "\n".join(kept))
    return out


def suffix_dedup(docs, length=200):
    """docs: list of (id, bytes), ids may repeat."""
    seen = Counter(b[i:i + length] for _, b in docs for i in range(len(b) - length + 1))
    out = []
    for d, b in docs:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def ngram_classes(docs, n=4, percent=85):
    sets = {}
    for i, t in docs.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", lower(t).encode())
        sets[i] = frozenset(tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def quality_signals(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for k in range(i, i + 8)}
    seen, dup = set(), 0
    for s in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", s):
            dup += s in seen
            seen.add(s)
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), failed
