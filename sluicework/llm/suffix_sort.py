"""Deep-shallow suffix sorting, and repeated windows read off two sorted orders.

``deep_shallow`` orders byte strings by multikey quicksort on eight-byte characters down to a shallow depth;
groups that still agree there share long prefixes and are ordered by a blind trie, which looks at branching
bytes only and compares one pair of strings per insertion.
"""

from __future__ import annotations

CHARACTER = 8
SHALLOW = 48


def lcp(a: bytes, b: bytes) -> int:
    m = min(len(a), len(b))
    a, b = a[:m], b[:m]
    if a == b:
        return m
    return (m * 8 - (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length()) // 8


def blind_trie(strings: list[bytes], group: list[int]) -> list[int]:
    """``group`` (indices of strings) in the strings' order."""
    # an inner node is [depth, {byte at depth: child}], a leaf a list of indices of equal strings; -1 ends a string
    at = lambda s, d: s[d] if d < len(s) else -1
    root: object = (group[0],)
    for i in group[1:]:
        s, node, path = strings[i], root, []
        while isinstance(node, list):  # descend blindly
            path.append(node)
            node = node[1].get(at(s, node[0])) or next(iter(node[1].values()))
        other = strings[node[0]]
        d = lcp(s, other)
        if d == len(s) == len(other):
            parent = next((p for p in reversed(path) if p[0] <= d), None)
            if parent is None:
                root = (*node, i)
            else:
                parent[1][at(s, parent[0])] = (*node, i)
            continue
        above, below = None, root
        while isinstance(below, list) and below[0] < d:
            above, below = below, below[1][at(s, below[0])]
        if isinstance(below, list) and below[0] == d:
            below[1][at(s, d)] = (i,)
            continue
        fresh = [d, {at(other, d): below, at(s, d): (i,)}]
        if above is None:
            root = fresh
        else:
            above[1][at(s, above[0])] = fresh
    out: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
        else:
            out.extend(node)
    return out


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Indices of ``strings`` in their order."""
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        group, d = stack.pop()
        if len(group) <= 1:
            out.extend(group)
        elif d >= shallow:
            out.extend(blind_trie(strings, group))
        else:
            pivot = strings[group[len(group) // 2]][d : d + CHARACTER]
            less, same, more = [], [], []
            for i in group:
                c = strings[i][d : d + CHARACTER]
                (same if c == pivot else less if c < pivot else more).append(i)
            if len(pivot) < CHARACTER:  # these strings end here and are equal
                stack.append((more, d))
                stack.extend(([i], d) for i in reversed(same))
            else:
                stack.append((more, d))
                stack.append((same, d + CHARACTER))
            stack.append((less, d))
    return out


def repeated_windows(texts: list[bytes], anchors: list[int], width: int) -> list[list[tuple[int, int]]]:
    """For each text the ranges (first, last) of starts of ``width``-byte windows that occur in another text
    at the same distance from the anchor.

    ``anchors[i]`` is a position in text i before or in each window.  Suffixes at the anchors and reversed
    prefixes before them are sorted.  In a run of suffixes that share R bytes, a text's longest common
    reversed prefix is one with a neighbour; L of those bytes make the windows that start width - R to L
    bytes before the anchor repeated.  Runs are the intervals of the suffixes' common-prefix array.
    """
    right = [t[a:] for t, a in zip(texts, anchors, strict=True)]
    left = [t[:a][::-1] for t, a in zip(texts, anchors, strict=True)]
    order = deep_shallow(right)
    rank = [0] * len(texts)
    for r, i in enumerate(deep_shallow(left)):
        rank[i] = r
    common = [lcp(right[i], right[j]) for i, j in zip(order, order[1:], strict=False)]
    found: list[list[tuple[int, int]]] = [[] for _ in texts]

    def run(lo: int, hi: int, shared: int) -> None:
        need = width - shared
        members = sorted(order[lo : hi + 1], key=rank.__getitem__)
        before = -1
        for x, i in enumerate(members):
            after = lcp(left[i], left[members[x + 1]]) if x + 1 < len(members) else -1
            best = max(before, after)
            if best >= max(need, 0):
                found[i].append((anchors[i] - best, anchors[i] - max(need, 0)))
            before = after

    stack: list[tuple[int, int]] = []  # (shared bytes, first position) of the open runs
    for x, c in enumerate([*common, -1]):
        first = x
        while stack and stack[-1][0] > c:
            shared, first = stack.pop()
            run(first, x, shared)
        if c >= 0 and (not stack or stack[-1][0] < c):
            stack.append((c, first))
    return [merge(f) for f in found]


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Inclusive ranges, joined where they meet."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            if z > out[-1][1]:
                out[-1] = (out[-1][0], z)
        else:
            out.append((a, z))
    return out
