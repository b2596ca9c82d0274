"""Plain versions of the operators, for small tables."""

import hashlib
import re
import zlib
from collections import Counter

import xxhash

from forecourt.llm.quality_rules import STOP_WORDS


def ascii_lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def simhash(text, shingle=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    if not words:
        return 0
    parts = [" ".join(words[i:i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows, radius=4):
    """Component id of each (key, fingerprint), by comparing all fingerprints."""
    prints = sorted({f for _, f in rows})
    parent = {f: f for f in prints}

    def top(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(prints):
        for b in prints[i + 1:]:
            if (a ^ b).bit_count() <= radius:
                parent[top(b)] = top(a)
    least = {}
    for key, f in rows:
        if key is not None:
            least[top(f)] = min(key, least.get(top(f), key))
    return [least.get(top(f)) for _, f in rows]


def benchmark_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))


def passages(text, items, width=10):
    """Words, hit words and names of items hit."""
    words, hit, names = benchmark_words(text), set(), set()
    for name, body in items:
        own = benchmark_words(body)
        n = min(width, len(own))
        for s in range(max(1, len(own) - width + 1) if own else 0):
            for p in range(len(words) - n + 1):
                if words[p:p + n] == own[s:s + n]:
                    hit |= set(range(p, p + n))
                    names.add(str(name))
    return len(words), len(hit), sorted(names)


def good(text):
    """The verdict of the quality rules."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    windows = [tuple(words[i:i + 5]) for i in range(n - 4)]
    times = Counter(windows)
    again = len({i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)})
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    if n < 10 or again > 0.2 * n or not 2.5 <= sum(map(len, words)) / n <= 12:
        return False
    stop = sum(w.lower().rstrip(".,;:") in STOP_WORDS for w in words)
    return (len(re.findall(r"[#*$%&|<>]", text)) <= 0.1 * n and (n < 20 or stop >= 0.05 * n) and len(lines) - len(set(lines)) <= 0.4 * len(lines))


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def runs(words, least=12):
    """Runs of a word list as (start, length, period), trying every period."""
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            size = i - start + q
            if size >= max(least, 2 * q) and all(any(words[k] != words[k + p] for k in range(start, start + size - p)) for p in range(1, q)):
                found.append((start, size, q))
    return sorted(found)


def with_periods(key, text):
    """The words of a document, a stretch of them repeated if its id says so."""
    words, h = split(text), zlib.crc32(str(key).encode())
    n, g = len(words), h // 10
    if key is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def rebuilt(rows):
    """Conversations {id: turns} of (id, turn, role, text), each begun with up to three turns of the one whose id divides by 20."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            turn = (turn is not None, turn or 0)
            own.setdefault(c, []).append((turn, sha(f"{len(role or '')}:{role or ''}{text or ''}")[:32], (role or "", text or "")))
    own = {c: [x[-1] for x in sorted(t)] for c, t in own.items()}
    return {c: own.get(c - c % 20, [])[:zlib.crc32(str(c).encode()) % 4] + t[zlib.crc32(str(c).encode()) % 4:] for c, t in own.items()}


def trie(said):
    """Rows of the prefix trie of {id: turns}."""
    members = {}
    for c, turns in said.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, convs in members.items():
        below = [x for x in members if x[:len(node)] == node]
        kids = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(y[:-1] == x for y in members if y)]
        saved = sum((len(members[x]) - 1) * len(split(x[-1][1])) for x in below if x)
        ends = ",".join(str(c) for c in sorted(convs) if len(said[c]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(kids), len(leaves), saved, sha(ends)))
    return out


def repeats(docs, width=100):
    """Marks of the bytes covered by a string of ``width`` bytes that also starts earlier; ``docs`` in order, as bytes."""
    seen, marks = set(), []
    for d in docs:
        mark = bytearray(len(d))
        for s in range(len(d) - width + 1):
            if d[s:s + width] in seen:
                mark[s:s + width] = b"\1" * width
            seen.add(d[s:s + width])
        marks.append(mark)
    return marks


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
