"""The contracts in plain Python, for comparison on small tables."""

import collections
import hashlib
import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def dedup(texts, width):
    """Per text: words, removed, digest of the rest."""
    words = [SPACED.findall(t or "") for t in texts]
    seen = collections.Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        out.append((len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone).encode())))
    return out


def contamination(texts, items, width=13):
    owners = collections.defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(lower(text))
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            owners[tuple(w[i : i + n])].add(str(item))
    out = []
    for text in texts:
        w, hit, found = ALNUM.findall(lower(text)), set(), set()
        for n in {len(x) for x in owners}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in owners:
                    hit.update(range(i, i + n))
                    found |= owners[tuple(w[i : i + n])]
        out.append((len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def written(spans):
    return ",".join(f"{kind}:{a}:{b}" for _, _, kind, a, b in sorted(spans))


def secrets(text):
    """Base spans."""
    text = text or ""
    found = [
        (m.start(), 0, "assign", m.start(), m.end())
        for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text)
        if len(m[2]) >= 8
    ]
    found += [(m.start(), 1, "access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return found


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def personal(text):
    """Base spans."""
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    ]
    return [(k, m.start(), kind, m.start(), m.end()) for k, (kind, p, fine) in enumerate(rules) for m in re.finditer(p, text) if fine(m[0])]


def shingle_sets(texts):
    out = []
    for text in texts:
        w = SPACED.findall(lower(text))
        out.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    return out


def similar_components(ids, texts):
    """Size of each set and the smallest id of its component."""
    sets, parent = shingle_sets(texts), {}
    order = sorted(range(len(ids)), key=lambda i: ids[i])

    def root(i):
        while parent.get(i, i) != i:
            i = parent[i]
        return i

    for x, i in enumerate(order):
        for j in order[:x]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)), key=lambda k: ids[k])
                parent[b] = a
    return [(len(s), ids[root(i)]) for i, s in enumerate(sets)]
