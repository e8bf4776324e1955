"""Order strings that share long prefixes: multikey quicksort to a shallow depth, then blind tries."""

from __future__ import annotations

import numpy as np

WORD_BYTES = 8  # that multikey quicksort compares at once


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def shallow_groups(strings: list[bytes], depth_words: int) -> list[np.ndarray]:
    """Numbers of the strings in order of their first words, those that agree in all of them together."""
    width = depth_words * WORD_BYTES
    raw = b"".join([s[:width].ljust(width, b"\0") for s in strings])
    words = np.frombuffer(raw, ">u8").reshape(len(strings), depth_words).astype(np.uint64)
    out: list[np.ndarray] = []
    todo = [(np.arange(len(strings)), 0)]
    while todo:
        own, depth = todo.pop()
        if len(own) < 2 or depth == depth_words:
            if len(own):
                out.append(own)
            continue
        key = words[own, depth]
        pivot = np.partition(key, len(key) // 2)[len(key) // 2]
        # popped in ascending order: smaller, equal (one word deeper), larger
        todo += [(own[key > pivot], depth), (own[key == pivot], depth + 1), (own[key < pivot], depth)]
    return out


def blind_trie(strings: list[bytes], own: list[int]) -> tuple[list[int], list[int]]:
    """Order of the given strings, and for each the prefix it shares with the one before (0 for the first).

    A node is [depth, children by the byte at that depth (-1: the string ends)];
    a leaf is a list of equal strings' numbers. A string goes down without being
    compared, meets one string at a leaf, and is compared with that one alone.
    """
    root: list | None = None
    for number in own:
        s, leaf = strings[number], [number]
        if root is None:
            root = leaf
            continue
        node = root
        while isinstance(node[-1], dict):
            c = s[node[0]] if len(s) > node[0] else -1
            node = node[1].get(c) or next(iter(node[1].values()))
        other = strings[node[0]]
        if s == other:
            node.append(number)
            continue
        shared = common(s, other)
        above, node = None, root
        while isinstance(node[-1], dict) and node[0] < shared:
            above, step = node, s[node[0]]
            node = node[1][step]
        c = s[shared] if len(s) > shared else -1
        if isinstance(node[-1], dict) and node[0] == shared:
            node[1][c] = leaf
            continue
        old = other[shared] if len(other) > shared else -1
        branch = [shared, {old: node, c: leaf}]
        if above is None:
            root = branch
        else:
            above[1][step] = branch
    order: list[int] = []
    shared_with: list[int] = []
    todo: list[tuple[list, int]] = [(root, 0)] if root is not None else []
    while todo:
        node, before = todo.pop()
        if isinstance(node[-1], dict):
            children = sorted(node[1].items())
            for k in range(len(children) - 1, -1, -1):
                todo.append((children[k][1], before if k == 0 else node[0]))
        else:
            for k, number in enumerate(node):
                order.append(number)
                shared_with.append(before if k == 0 else len(strings[number]))
    return order, shared_with


def ordered(strings: list[bytes], shallow: int = 64) -> tuple[list[int], list[int]]:
    """Numbers of the strings in ascending order, and the prefix each shares with the one before.

    Prefixes shorter than the shallow depth may be given as 0: what is looked for is longer.
    """
    order: list[int] = []
    shared: list[int] = []
    for group in shallow_groups(strings, shallow // WORD_BYTES):
        if len(group) == 1:
            order.append(int(group[0]))
            shared.append(0)
        else:
            part, lengths = blind_trie(strings, group.tolist())
            order += part
            shared += lengths
    return order, shared
