"""Deep-shallow ordering of strings, with the longest two-sided matches of each one.

Multikey quicksort orders the strings by one character after another down to a shallow depth; groups that still agree
there go to a blind trie, which compares a new string with one leaf and only looks at branching characters on its way.
Both leave the same tree of common prefixes. Its nodes are merged from the leaves up, smaller side into larger; each
side is kept in the order of the strings' reversed left contexts, so that the neighbours of an inserted string share
the longest left context with it.
"""

from __future__ import annotations

from bisect import bisect_left


def common_prefix(a: bytes, b: bytes, most: int) -> int:
    n = min(len(a), len(b), most)
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class Matches:
    """For strings right[i] with reversed left contexts left[i]: ahead[i] and behind[i] are the bytes after and before the
    split that some other string shares with it, over the pairs that share `least` bytes in all."""

    def __init__(self, right: list[bytes], left: list[bytes], least: int, start: int = 0, shallow: int = 16):
        self.right, self.left, self.least = right, left, least
        self.ahead, self.behind = [0] * len(right), [0] * len(right)
        self.deep = start + shallow
        self._quick(list(range(len(right))), start)

    def _merge(self, a: list[tuple[bytes, int]], b: list[tuple[bytes, int]], depth: int) -> list[tuple[bytes, int]]:
        if len(a) < len(b):
            a, b = b, a
        for key, i in b:
            at = bisect_left(a, (key, i))
            for k in (at - 1, at):
                if 0 <= k < len(a):
                    other, j = a[k]
                    shared = common_prefix(key, other, len(key))
                    if shared + depth >= self.least:
                        for x in (i, j):
                            self.behind[x] = max(self.behind[x], shared)
                            self.ahead[x] = max(self.ahead[x], depth)
            a.insert(at, (key, i))
        return a

    def _quick(self, items: list[int], depth: int) -> list[tuple[bytes, int]]:
        """Multikey quicksort of strings that agree on `depth` characters."""
        done: list[tuple[bytes, int]] = []
        while items:
            if len(items) == 1:
                return self._merge(done, [(self.left[items[0]], items[0])], depth) if done else [(self.left[items[0]], items[0])]
            if depth >= self.deep:
                part = self._trie(items)
                return self._merge(done, part, depth) if done else part
            chars = [self.right[i][depth] if len(self.right[i]) > depth else -1 for i in items]
            pivot = sorted(chars)[len(chars) // 2]
            same = [i for i, c in zip(items, chars, strict=True) if c == pivot]
            if len(same) == len(items) and pivot >= 0:
                depth += 1
                continue
            if pivot < 0:
                part = self._equal(same, depth)
            else:
                part = self._quick(same, depth + 1)
            done = self._merge(done, part, depth) if done else part
            less = [i for i, c in zip(items, chars, strict=True) if c < pivot]
            if less:
                done = self._merge(done, self._quick(less, depth), depth)
            items = [i for i, c in zip(items, chars, strict=True) if c > pivot]
        return done

    def _equal(self, items: list[int], depth: int) -> list[tuple[bytes, int]]:
        out: list[tuple[bytes, int]] = []
        for i in items:
            out = self._merge(out, [(self.left[i], i)], depth)
        return out

    def _trie(self, items: list[int]) -> list[tuple[bytes, int]]:
        """Blind trie: a node is [depth, {character: child}], a leaf the list of the numbers of equal strings."""
        right = self.right
        root: list = [items[0]]
        for i in items[1:]:
            s = right[i]
            node = root
            while len(node) == 2 and isinstance(node[1], dict):
                d, below = node
                c = s[d] if len(s) > d else -1
                node = below.get(c) or next(iter(below.values()))
            t = right[node[0]]
            shared = common_prefix(s, t, len(s))
            if shared == len(s) == len(t):
                node.append(i)
                continue
            up, node = None, root
            while len(node) == 2 and isinstance(node[1], dict) and node[0] < shared:
                up = node
                node = node[1][s[node[0]]]
            c = s[shared] if len(s) > shared else -1
            if len(node) == 2 and isinstance(node[1], dict) and node[0] == shared:
                node[1][c] = [i]
                continue
            fork = [shared, {(t[shared] if len(t) > shared else -1): node, c: [i]}]
            if up is None:
                root = fork
            else:
                up[1][s[up[0]]] = fork
        return self._fold(root)

    def _fold(self, root: list) -> list[tuple[bytes, int]]:
        stack, done = [(root, False)], []
        while stack:
            node, ready = stack.pop()
            if not (len(node) == 2 and isinstance(node[1], dict)):
                done.append(self._equal(node, len(self.right[node[0]])))
            elif not ready:
                stack.append((node, True))
                stack += [(x, False) for x in node[1].values()]
            else:
                out = done.pop()
                for _ in range(len(node[1]) - 1):
                    out = self._merge(out, done.pop(), node[0])
                done.append(out)
        return done[0]
