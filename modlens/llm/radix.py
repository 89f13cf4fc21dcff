"""Adaptive radix trees over keys made of fixed-width big-endian numbers.

An inner node has the layout that its number of children needs: sorted bytes and children (up to 4, then up to 16), a
table of 256 slots into at most 48 children, or 256 children. It grows into the next layout when full. Bytes that
all keys below a node share stand in the node as its prefix (path compression), so a number of 16 bytes costs a
node only where keys differ. A key may end at any node, as one key may be the beginning of another.

Keys hold numbers of `width` bytes each, the whole of one after the other. Only depths that are a multiple of the width are
nodes of the caller's trie: `walk` names those, wherever in a compressed prefix they lie, and passes over all others.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator


class Few:
    """Up to `room` children: their bytes, sorted, and the children in the same order."""

    __slots__ = ("bytes", "children", "room")

    def __init__(self, room: int):
        self.room, self.bytes, self.children = room, bytearray(), []

    def get(self, byte: int):
        at = bisect_left(self.bytes, byte)
        return self.children[at] if at < len(self.bytes) and self.bytes[at] == byte else None

    def put(self, byte: int, child: Node) -> None:
        at = bisect_left(self.bytes, byte)
        if at < len(self.bytes) and self.bytes[at] == byte:
            self.children[at] = child
        else:
            self.bytes.insert(at, byte)
            self.children.insert(at, child)

    def full(self) -> bool:
        return len(self.children) == self.room

    def items(self) -> Iterator[tuple[int, Node]]:
        return zip(self.bytes, self.children, strict=True)

    def grown(self):
        out = Few(16) if self.room == 4 else Slots()
        for byte, child in self.items():
            out.put(byte, child)
        return out


class Slots:
    """Up to 48 children, found by a table of 256 places."""

    __slots__ = ("table", "children")
    room = 48

    def __init__(self):
        self.table, self.children = bytearray(256), []

    def get(self, byte: int):
        at = self.table[byte]
        return self.children[at - 1] if at else None

    def put(self, byte: int, child: Node) -> None:
        if at := self.table[byte]:
            self.children[at - 1] = child
        else:
            self.children.append(child)
            self.table[byte] = len(self.children)

    def full(self) -> bool:
        return len(self.children) == self.room

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((byte, self.children[at - 1]) for byte, at in enumerate(self.table) if at)

    def grown(self):
        out = All()
        for byte, child in self.items():
            out.put(byte, child)
        return out


class All:
    """A place for each of 256 children."""

    __slots__ = ("children",)
    room = 256

    def __init__(self):
        self.children: list[Node | None] = [None] * 256

    def get(self, byte: int):
        return self.children[byte]

    def put(self, byte: int, child: Node) -> None:
        self.children[byte] = child

    def full(self) -> bool:
        return False

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((byte, child) for byte, child in enumerate(self.children) if child is not None)


class Node:
    """prefix: bytes from the parent's byte on that all keys below share; value: that of the key that ends here."""

    __slots__ = ("prefix", "value", "layout")

    def __init__(self, prefix: bytes, value=None):
        self.prefix, self.value, self.layout = prefix, value, None

    def put(self, byte: int, child: Node) -> None:
        if self.layout is None:
            self.layout = Few(4)
        elif self.layout.full() and self.layout.get(byte) is None:
            self.layout = self.layout.grown()
        self.layout.put(byte, child)

    def items(self) -> Iterator[tuple[int, Node]]:
        return self.layout.items() if self.layout is not None else iter(())


def shared_length(a: bytes, b: bytes) -> int:
    """Bytes that two texts begin with in common."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    low, high = 0, most  # a[:low] is shared, a[:high] is not
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class Tree:
    def __init__(self, width: int):
        self.width, self.root = width, None

    def add(self, key: bytes, value, merge: Callable) -> None:
        """Puts a value at a key; merge(old, value) if one is there."""
        if len(key) % self.width:
            raise ValueError("keys are made of whole numbers")
        if self.root is None:
            self.root = Node(key, value)
            return
        parent, byte, node, at = None, 0, self.root, 0
        while True:
            rest = key[at:]
            n = shared_length(node.prefix, rest)
            if n < len(node.prefix):  # the key leaves the prefix: a node for what they share
                upper = Node(node.prefix[:n])
                upper.put(node.prefix[n], node)
                node.prefix = node.prefix[n + 1 :]
                if parent is None:
                    self.root = upper
                else:
                    parent.put(byte, upper)
                if n == len(rest):
                    upper.value = value
                else:
                    upper.put(rest[n], Node(rest[n + 1 :], value))
                return
            at += n
            if at == len(key):
                node.value = value if node.value is None else merge(node.value, value)
                return
            byte = key[at]
            child = node.layout.get(byte) if node.layout is not None else None
            if child is None:
                node.put(byte, Node(key[at + 1 :], value))
                return
            parent, node, at = node, child, at + 1

    def walk(self) -> Iterator[tuple[bytes, bool, object]]:
        """(key, entered, value) on the way into and out of each node whose depth is whole numbers, in order of the keys.

        The value is that of a key that ends there (on the way in), else None. No recursion, as keys may be long.
        """
        if self.root is None:
            return
        width = self.width
        yield b"", True, self.root.value if not self.root.prefix else None
        #: (node, key down to its end, depth down to which its parents' nodes were named, or None on the way out)
        stack: list[tuple[Node, bytes, int | None]] = [(self.root, self.root.prefix, 0)]
        while stack:
            node, key, named = stack.pop()
            if named is None:
                for depth in range(len(key) // width * width, node, -width):  # node: the depth to stop at
                    yield key[:depth], False, None
                continue
            for depth in range(named + width, len(key) + 1, width):
                yield key[:depth], True, node.value if depth == len(key) else None
            stack.append((named, key, None))
            below = len(key) // width * width
            for byte, child in reversed(list(node.items())):
                stack.append((child, key + bytes([byte]) + child.prefix, below))
        yield b"", False, None
