"""Brute-force versions of p1 and p5."""

from itertools import combinations


def runs(text):
    if text is None:
        return frozenset()
    t = "".join(c for c in text.lower() if c.isalnum())
    return frozenset(t[i : i + 5] for i in range(len(t) - 4))


def like(a, b):
    if not a or not b:
        return False
    both = len(a & b)
    return 5 * both >= 3 * (len(a) + len(b) - both)


def refused(lines):
    """lines: (batch, row, name, scope, text) -> refused rows."""
    names, by_scope, out = set(), {}, set()
    for _, row, name, scope, text in sorted(lines, key=lambda x: (-1 if x[0] is None else x[0], x[1])):
        r = runs(text)
        kept = by_scope.setdefault(scope, [])
        if (name is not None and name in names) or any(like(r, k) for k in kept):
            out.add(row)
        else:
            kept.append(r)
            names.add(name)
    return out


def like_pairs(rows):
    """rows: (id, text) -> pairs of ids with like texts."""
    texts = {}
    for i, t in rows:
        if i is not None:
            texts.setdefault(runs(t), set()).add(i)
    texts.pop(frozenset(), None)
    out = set()
    for ids in texts.values():
        out |= set(combinations(sorted(ids), 2))
    for a, b in combinations(texts, 2):
        if min(len(a), len(b)) * 5 >= 3 * max(len(a), len(b)) and like(a, b):
            out |= {(min(u, v), max(u, v)) for u in texts[a] for v in texts[b] if u != v}
    return out
