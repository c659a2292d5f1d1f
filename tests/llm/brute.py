"""Plain sequential versions of the corpus operators, for small fixtures."""

import re

import numpy as np
import xxhash


def roots(nodes, links):
    """The smallest node reachable from each node."""
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def secrets(text):
    out = []
    assign = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    out += [(m.start(), 0, m.end(), "assign") for m in re.finditer(assign, text, re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def personal(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in out)


def vector_links(vectors, limit=0.9):
    """Index pairs with a cosine of ``limit`` or more; unsound vectors link with nothing."""
    def sound(v):
        return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    out = []
    for i, a in enumerate(vectors):
        for j in range(i):
            b = vectors[j]
            if sound(a) and sound(b) and len(a) == len(b):
                x, y = np.array(a, float), np.array(b, float)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= limit:
                    out.append((i, j))
    return out


def passages(docs, least):
    """(doc_id, start, end): word stretches all of whose windows of ``least`` words occur in another document."""
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for d, t in docs}
    homes = {}
    for d, w in words.items():
        for i in range(len(w) - least + 1):
            homes.setdefault(tuple(w[i:i + least]), set()).add(d)
    out = set()
    for d, w in words.items():
        end = start = None
        for i in range(len(w) - least + 1):
            if len(homes[tuple(w[i:i + least])]) > 1:
                if end is None or i > end:
                    if end is not None:
                        out.add((d, start, end))
                    start = i
                end = i + least
        if end is not None:
            out.add((d, start, end))
    return out
