"""Deep-shallow sorting of many byte strings, with the common prefixes of neighbours.

Shallow: multikey quicksort with eight bytes as one character, every group of
equal prefixes split at once, down to ``SHALLOW`` bytes. Deep: what is then still
equal is put in order by a blind trie for each group: a string walks down by the
branching bytes alone, is compared once with the leaf it reaches, and branches
off at the depth that this comparison shows.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 48


def _words(strings: list[bytes], width: int) -> np.ndarray:
    """Zero-padded strings as rows of big-endian 8-byte words."""
    return np.frombuffer(b"".join(s[:width].ljust(width, b"\0") for s in strings), dtype=">u8").reshape(len(strings), width // 8).astype(np.uint64)


def blind_trie(members: list[int], values: dict[int, int], width: int) -> tuple[list[int], list[int]]:
    """Members in the order of their values (big-endian integers of ``width`` bytes), and each one's common prefix with the one before."""
    # a node is (depth, {branching byte: child}); a leaf is a list of members with one value
    bits = 8 * width
    root: list = [members[0]]
    for member in members[1:]:
        value, node = values[member], root
        while type(node) is tuple:
            node = node[1].get(value >> (bits - 8 - 8 * node[0]) & 255) or next(iter(node[1].values()))
        differ = (value ^ values[node[0]]).bit_length()
        if not differ:
            node.append(member)
            continue
        depth = (bits - differ) // 8
        above, node = None, root
        while type(node) is tuple and node[0] < depth:
            above, node = node, node[1][value >> (bits - 8 - 8 * node[0]) & 255]
        byte = value >> (bits - 8 - 8 * depth) & 255
        if type(node) is tuple and node[0] == depth:
            node[1][byte] = [member]
            continue
        some = node
        while type(some) is tuple:
            some = next(iter(some[1].values()))
        branch = (depth, {values[some[0]] >> (bits - 8 - 8 * depth) & 255: node, byte: [member]})
        if above is None:
            root = branch
        else:
            above[1][value >> (bits - 8 - 8 * above[0]) & 255] = branch
    order, common, stack = [], [], [(root, 0)]
    while stack:
        node, shared = stack.pop()
        if type(node) is tuple:
            children = sorted(node[1].items(), reverse=True)
            stack += [(child, shared if at == len(children) - 1 else node[0]) for at, (_, child) in enumerate(children)]
        else:
            order += node
            common += [shared, *[width] * (len(node) - 1)]
    return order, common


def deep_shallow_sort(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): strings sorted by their first ``width`` bytes, zero-padded, and each one's common prefix with the one before it.

    ``width`` is a multiple of 8. The first entry of ``common`` is 0.
    """
    n = len(strings)
    order, common = np.arange(n), np.full(n, width)
    if not n:
        return order, common
    words = _words(strings, width)
    common[0] = 0
    head = np.zeros(n, dtype=bool)  # of a group of strings that are equal so far
    head[0] = True
    for column in range(min(SHALLOW, width) // 8):
        group = np.cumsum(head)
        size = np.bincount(group)[group]
        open_ = np.flatnonzero(size > 1)
        if not len(open_):
            break
        key = words[order[open_], column]
        by = np.lexsort((key, group[open_]))
        order[open_], key = order[open_][by], key[by]
        new = np.flatnonzero((key[1:] != key[:-1]) & ~head[open_[1:]]) + 1
        differ = key[new] ^ key[new - 1]
        high = np.zeros(len(new), dtype=np.int64)  # leading bytes in common
        for b in range(1, 8):
            high += differ < np.uint64(1) << np.uint64(8 * (8 - b))
        common[open_[new]] = 8 * column + high
        head[open_[new]] = True
    starts = np.flatnonzero(head)
    sizes = np.diff(np.append(starts, n))
    if width > SHALLOW:
        for at, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            members = order[at : at + size].tolist()
            values = {m: int.from_bytes(strings[m][:width].ljust(width, b"\0")) for m in members}
            got, shared = blind_trie(members, values, width)
            order[at : at + size] = got
            common[at + 1 : at + size] = shared[1:]
    return order, common
