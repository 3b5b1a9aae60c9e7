"""Plain Python versions of the operators, from their contracts, for comparison."""

import hashlib
import math
import re

import numpy as np
import xxhash

PII = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text):
    found = []
    for k, (kind, pattern) in enumerate(PII.items()):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((m.start(), k, m.end()))
    return ",".join(f"{list(PII)[k]}:{a}:{b}" for a, k, b in sorted(found))


def simhash(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    """Smallest node reachable, by comparing all pairs."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    nodes = sorted(parent)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def vector_groups(rows, threshold):
    """vec_id to number of links and component, by comparing all pairs."""
    usable = {}
    for r in rows:
        v = r["embedding"]
        if r["label"] is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            usable[r["vec_id"]] = (r["label"], np.array(v, dtype=np.float64))

    def linked(a, b):
        if a not in usable or b not in usable or usable[a][0] != usable[b][0] or len(usable[a][1]) != len(usable[b][1]):
            return False
        x, y = usable[a][1], usable[b][1]
        return float(x @ y) / math.sqrt(float(x @ x) * float(y @ y)) >= threshold

    ids = [r["vec_id"] for r in rows]
    groups = components(ids, linked)
    return {i: (sum(linked(i, j) for j in ids if j != i), groups[i]) for i in ids}


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def words_of(text):
    """(word, start, stop, line) of each word, A-Z as a-z."""
    line, out = 0, []
    for m in re.finditer(r"[^\x20\x09-\x0D]+|\n", text or ""):
        if m[0] == "\n":
            line += 1
        else:
            out.append(("".join(c.lower() if "A" <= c <= "Z" else c for c in m[0]), m.start(), m.end(), line))
    return out


def paragraphs_of(text, least=24):
    """(shingles, start, stop) of each line of enough words, and of each run of shorter ones that has as many together.

    A run ends at a line of enough words, and at a blank line once it has enough.
    """
    lines, runs, before = {}, [[]], -1
    for w in words_of(text):
        lines.setdefault(w[3], []).append(w)
    for at, ws in lines.items():
        if len(ws) >= least:
            runs += [ws, []]
        else:
            if at > before + 1 and len(runs[-1]) >= least:
                runs.append([])
            runs[-1].extend(ws)
        before = at
    for ws in runs:
        if len(ws) >= least:
            yield frozenset(tuple(w[0] for w in ws[i : i + 5]) for i in range(len(ws) - 4)), ws[0][1], ws[-1][2]
