"""A vocabulary trie and its intersection with a Levenshtein automaton over the confusions of character recognition."""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Sequence

# What a scan makes of characters; each text on the left may be read as any on the right.
CONFUSIONS = {
    "e": "c 6", "é": "6", "c": "( e", "o": "0", "i": "l 1", "l": "1 i", "a": "@", "t": "f", "f": "t", "s": "5", "g": "9", "b": "6 h", "z": "2", "q": "9",
    "h": "b", "n": "ri", "m": "rn nn", "u": "ii", "ü": "ii", "d": "cl", "w": "vv", "ri": "n", "rn": "m", "nn": "m", "li": "h", "cl": "d", "vv": "w", "ii": "u", "ni": "m",
    "0": "o", "1": "l i", "5": "s", "8": "b", "6": "b", "9": "g", "2": "z",
    "ت": "ث ن", "ث": "ت", "ب": "ت ن ي", "ي": "ب ت", "ن": "ب ت", "ق": "ف", "ف": "ق", "ج": "ح خ", "ح": "ج خ", "خ": "ح ج", "ش": "س", "س": "ش", "ز": "ر", "ر": "ز", "د": "ذ", "ذ": "د",
    "ص": "ض", "ض": "ص", "ط": "ظ", "ظ": "ط", "ع": "غ", "غ": "ع",
}
#: (true, read) pairs by the first true character.
_BY_TRUE: dict[str, list[tuple[str, str]]] = {}
for _true, _reads in CONFUSIONS.items():
    for _read in _reads.split():
        _BY_TRUE.setdefault(_true[0], []).append((_true, _read))


#: Behind every character.
LAST = "\U0010ffff"


class _Node:
    """The words first..last - 1, which agree in their first ``depth`` characters."""

    __slots__ = ("children", "depth", "first", "last")

    def __init__(self, first: int, last: int, depth: int) -> None:
        self.first, self.last, self.depth, self.children = first, last, depth, None


class Trie:
    """Words with counts; ``search`` gives every word that a string may be a misreading of.

    The words stand in one sorted list, and a node is a range of it: its children are found by bisection when a search first comes there, so that memory goes to what is asked for.
    """

    def __init__(self, words: Iterable[tuple[str, int]]) -> None:
        both = sorted(dict(words).items())
        self.words, self.counts = [w for w, _ in both], array("q", (n for _, n in both))
        self.root = _Node(0, len(self.words), 0)

    @classmethod
    def of(cls, words: Sequence[str], counts: Sequence[int]) -> Trie:
        """Of sorted words that stand elsewhere, with their counts."""
        out = cls(())
        out.words, out.counts, out.root = words, counts, _Node(0, len(words), 0)
        return out

    def kids(self, node: _Node) -> dict[str, _Node]:
        if node.children is None:
            node.children, words, d = {}, self.words, node.depth
            i = node.first + self.ends(node)
            while i < node.last:
                c = words[i][d]
                j = bisect_right(words, words[i][: d + 1] + LAST, i, node.last)
                node.children[c] = _Node(i, j, d + 1)
                i = j
        return node.children

    def ends(self, node: _Node) -> bool:
        """Whether a word ends at the node."""
        return node.first < node.last and len(self.words[node.first]) == node.depth

    def down(self, node: _Node | None, text: str) -> _Node | None:
        """The node that a text leads to."""
        for c in text:
            if node is None:
                return None
            node = self.kids(node).get(c)
        return node

    def starting(self, prefix: str) -> range:
        """Places in ``words`` of all words that start so."""
        i = bisect_left(self.words, prefix)
        return range(i, bisect_right(self.words, prefix + LAST, i))

    def near(self, read: str) -> list[tuple[str, int]]:
        """All (word, count) one plain edit away: a character put in, left out, replaced, or two neighbours swapped. The automaton of one edit: along the path of what was read
        so far every branch is tried once, and behind the edit only the rest itself leads on.
        """
        found: dict[str, int] = {}

        def end(node: _Node | None, text: str) -> None:
            node = self.down(node, text)
            if node is not None and self.ends(node):
                found[self.words[node.first]] = self.counts[node.first]

        node: _Node | None = self.root
        for i in range(len(read) + 1):
            if node is None:
                break
            rest = read[i + 1 :]
            if i < len(read):
                end(node, rest)  # a character too many
                if i + 1 < len(read):
                    end(node, read[i + 1] + read[i] + read[i + 2 :])
            for c, child in self.kids(node).items():
                end(child, read[i:])  # one is missing
                if i < len(read) and c != read[i]:
                    end(child, rest)
            node = self.kids(node).get(read[i]) if i < len(read) else None
        found.pop(read, None)
        return list(found.items())

    def search(self, read: str, errors: int, edits: int = 0) -> list[tuple[str, int, int, int]]:
        """All (word, count, errors used, plain edits used) that become ``read`` by at most ``errors`` confusions or, of these, at most ``edits`` plain
        insertions, deletions or substitutions: the automaton's states (place in ``read``, errors, edits, rest of a true digraph) run down the trie together.
        """
        n, found = len(read), {}
        stack: list[tuple[_Node, frozenset]] = [(self.root, self._close({(0, 0, 0, "")}, n, errors, edits))]
        while stack:
            node, states = stack.pop()
            if self.ends(node):
                ends = [(e, p) for i, e, p, rest in states if i == n and not rest]
                if ends:
                    found[self.words[node.first]] = (self.counts[node.first], *min(ends))
            for c, child in self.kids(node).items():
                after = set()
                for i, e, p, rest in states:
                    if rest:
                        if rest == c:
                            after.add((i, e, p, ""))
                        continue
                    if i < n and read[i] == c:
                        after.add((i + 1, e, p, ""))
                    if e < errors:
                        for true, seen in _BY_TRUE.get(c, ()):
                            if read.startswith(seen, i):
                                after.add((i + len(seen), e + 1, p, true[1:]))
                        if p < edits:
                            after.add((i, e + 1, p + 1, ""))
                            if i < n:
                                after.add((i + 1, e + 1, p + 1, ""))
                if after:
                    stack.append((child, self._close(after, n, errors, edits)))
        return [(w, *v) for w, v in found.items()]

    @staticmethod
    def _close(states: set, n: int, errors: int, edits: int) -> frozenset:
        """With the states reached by dropping characters of the string that no word has (plain edits only)."""
        if edits:
            grown = list(states)
            for i, e, p, rest in grown:
                if i < n and e < errors and p < edits and not rest and (s := (i + 1, e + 1, p + 1, "")) not in states:
                    states.add(s)
                    grown.append(s)
        return frozenset(states)
