"""Plain twins of operators, for small tables."""

import re
from collections import defaultdict


def line_templates(rows, min_docs=3):
    """{row: {line: its templates}} of (id, text) rows by place, and {template: rows it is in}."""
    lines = {}  # (row, line) -> tokens as they are, and with numbers masked
    for r, (_, t) in enumerate(rows):
        for k, x in enumerate((t or "").split("\n")):
            if tokens := re.findall(r"[^\x20\x09-\x0d]+", x):
                lines[r, k] = tokens, tuple("<n>" if re.search("[0-9]", y) else y for y in tokens)
    at = defaultdict(set)
    keys = defaultdict(set)
    worded = {k: 2 * masked.count("<n>") <= len(masked) for k, (_, masked) in lines.items()}

    def met(place, key):
        keys[place].add(key)
        at[key].add(place[0])

    for place, (tokens, masked) in lines.items():
        if worded[place]:
            met(place, ("masked", masked))
        if len(tokens) >= 8:
            met(place, ("whole", tuple(tokens)))

    def recurs(key):
        return len(at[key]) >= (2 if key[0] == "whole" else min_docs)

    spare = lambda n: min(n // 5, 4)

    def leaves(masked):
        n, b = len(masked), spare(len(masked)) + 1
        cut = [2 + (n - 2) * k // b for k in range(b + 1)]
        return [(n, masked[:2], k, masked[cut[k] : cut[k + 1]]) for k in range(b)] if b > 1 else []

    plain = lambda masked: ("whole" if len(masked) >= 8 and "<n>" not in masked else "masked", masked)
    rare = {p: masked for p, (_, masked) in lines.items() if worded[p] and not recurs(plain(masked))}
    fields = defaultdict(set)
    for (r, _), masked in rare.items():
        for leaf in leaves(masked):
            for pos, tok in enumerate(masked):
                fields[leaf, pos, tok].add((r, masked))
    for place, masked in rare.items():
        for leaf in leaves(masked):
            shape = tuple(tok if len(fields[leaf, pos, tok]) >= min_docs else "*" for pos, tok in enumerate(masked))
            if sum(x == "*" for x in shape) <= spare(len(masked)):
                met(place, ("form", leaf, shape))
    return keys, at, recurs


def without_recurring_lines(rows, min_docs=3):
    """(lines dropped, text left) of every row; rows with smaller ids come first, null last."""
    keys, at, recurs = line_templates(rows, min_docs)
    order = lambda r: (rows[r][0] is None, rows[r][0] or 0, r)
    holder = {k: min(rs, key=order) for k, rs in at.items()}
    out = []
    for r, (_, t) in enumerate(rows):
        left = [x for k, x in enumerate((t or "").split("\n")) if not any(recurs(y) and holder[y] != r for y in keys[r, k])]
        out.append(((t or "").count("\n") + 1 - len(left), "\n".join(left)))
    return out
