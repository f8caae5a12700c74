"""An adaptive radix tree over byte keys: layouts that grow with a node's children, and compressed paths."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

#: Children that the layouts hold: sorted bytes searched in turn, sorted bytes searched by halves, an index of all bytes, a slot for each byte.
FOUR, SIXTEEN, FORTY_EIGHT, ALL = 4, 16, 48, 256


class Node:
    """The bytes of its compressed path, the number stored for the key that ends here (-1: none), and its children.

    In the two sorted layouts `keys` has the children's bytes in order; in the indexed one it has, for each byte,
    the child's place plus one; in the largest one it is not needed.
    """

    __slots__ = ("path", "value", "layout", "keys", "children")

    def __init__(self, path: bytes, value: int = -1):
        self.path, self.value = path, value
        self.layout, self.keys, self.children = FOUR, bytearray(), []

    def child(self, byte: int) -> Node | None:
        if self.layout == FOUR:
            at = self.keys.find(byte)
            return self.children[at] if at >= 0 else None
        if self.layout == SIXTEEN:
            at = bisect_left(self.keys, byte)
            return self.children[at] if at < len(self.keys) and self.keys[at] == byte else None
        if self.layout == FORTY_EIGHT:
            at = self.keys[byte]
            return self.children[at - 1] if at else None
        return self.children[byte]

    def put(self, byte: int, node: Node) -> None:
        """Sets the child of a byte, in the next larger layout where this one is full."""
        if self.layout in (FOUR, SIXTEEN):
            at = bisect_left(self.keys, byte)
            if at < len(self.keys) and self.keys[at] == byte:
                self.children[at] = node
                return
            if len(self.keys) < self.layout:
                self.keys.insert(at, byte)
                self.children.insert(at, node)
                return
            self._grow()
            self.put(byte, node)
        elif self.layout == FORTY_EIGHT:
            at = self.keys[byte]
            if at:
                self.children[at - 1] = node
            elif len(self.children) < FORTY_EIGHT:
                self.children.append(node)
                self.keys[byte] = len(self.children)
            else:
                self._grow()
                self.children[byte] = node
        else:
            self.children[byte] = node

    def _grow(self) -> None:
        if self.layout == FOUR:
            self.layout = SIXTEEN
        elif self.layout == SIXTEEN:
            index = bytearray(ALL)
            for place, byte in enumerate(self.keys, 1):
                index[byte] = place
            self.layout, self.keys = FORTY_EIGHT, index
        else:
            slots: list[Node | None] = [None] * ALL
            for byte, place in enumerate(self.keys):
                if place:
                    slots[byte] = self.children[place - 1]
            self.layout, self.keys, self.children = ALL, bytearray(), slots

    def branches(self) -> Iterator[tuple[int, Node]]:
        """Children in the order of their bytes."""
        if self.layout in (FOUR, SIXTEEN):
            yield from zip(self.keys, self.children)
        elif self.layout == FORTY_EIGHT:
            yield from ((byte, self.children[place - 1]) for byte, place in enumerate(self.keys) if place)
        else:
            yield from ((byte, node) for byte, node in enumerate(self.children) if node is not None)


def agreed(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving the stretch that is still open."""
    least, most = 0, min(len(a), len(b))
    while least < most:
        middle = (least + most + 1) // 2
        if a[least:middle] == b[least:middle]:
            least = middle
        else:
            most = middle - 1
    return least


class Tree:
    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, value: int) -> None:
        """Stores a number of zero or more for a key; a key may begin another."""
        node, at = self.root, 0
        above: tuple[Node, int] | None = None
        while True:
            same = agreed(node.path, key[at : at + len(node.path)])
            if same < len(node.path):
                upper = Node(node.path[:same])
                upper.put(node.path[same], node)
                node.path = node.path[same + 1 :]
                if above:
                    above[0].put(above[1], upper)
                else:
                    self.root = upper
                node = upper
            at += same
            if at == len(key):
                node.value = value
                return
            below = node.child(key[at])
            if below is None:
                node.put(key[at], Node(key[at + 1 :], value))
                return
            above, node, at = (node, key[at]), below, at + 1
