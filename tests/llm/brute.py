"""Plain versions of the operators' definitions, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from itertools import combinations

import xxhash


def ascii_lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def secret_base(text: str) -> list[tuple[int, int, int]]:
    assign = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m.group(1)) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(found)


def simhash(text: str) -> int:
    words = re.findall("[^\x20\x09-\x0d]+", ascii_lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints: dict, radius: int = 2) -> dict:
    """id -> least id reachable."""
    parent = {i: i for i in prints}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= radius:
            p, q = sorted((top(a), top(b)))
            parent[q] = p
    return {i: top(i) for i in prints}


def bench_words(text: str | None) -> list[str]:
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", ascii_lower(text or ""))


def contamination(text: str | None, items: list[tuple[object, str | None]], span: int = 10) -> tuple[int, int, list]:
    words, hit, found = bench_words(text), set(), []
    for item, item_text in items:
        own = bench_words(item_text)
        size = min(span, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        at = [i for i in range(len(words) - size + 1) if tuple(words[i : i + size]) in windows] if windows else []
        for i in at:
            hit.update(range(i, i + size))
        if at:
            found.append(str(item))
    return len(words), len(hit), sorted(set(found))


def kept_bytes(texts: list[tuple[int, str | None]], size: int = 100) -> dict[int, tuple[int, int, int, str]]:
    """Of documents in the order of their ids: (bytes, removed, runs, digest of what stays)."""
    seen, out = set(), {}
    for i, text in texts:
        data = (text or "").encode()
        gone = [False] * len(data)
        for k in range(len(data) - size + 1):
            if data[k : k + size] in seen:
                gone[k : k + size] = [True] * size
            seen.add(data[k : k + size])
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = len(data), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(data, gone) if not g)).hexdigest()
    return out


def unigram_scores(texts: list[tuple[bool, str | None]]) -> tuple[int, list[tuple[int, int, float]]]:
    """(N, (tokens, known, base score) of each) of (held out, text)."""
    split = [[*re.findall("[^\x20\x09-\x0d]+", ascii_lower(t or "")), None] for _, t in texts]
    counts = Counter(w for (held, _), words in zip(texts, split) if not held for w in words)
    n, v = sum(counts.values()), len(counts)
    return n, [(len(words), sum(counts[w] > 0 for w in words), sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)) for words in split]


def near_groups(texts: dict) -> dict:
    """Least key of each text's group over Jaccard similarities of five-word shingles of 0.8 or more."""
    words = {k: ascii_lower(t or "").split() for k, t in texts.items()}
    own = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for k, w in words.items()}
    group = {k: k for k in texts}
    for i in texts:
        for j in texts:
            if i < j and group[i] != group[j] and (own[i] == own[j] or 5 * len(own[i] & own[j]) >= 4 * len(own[i] | own[j])):
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    return group
