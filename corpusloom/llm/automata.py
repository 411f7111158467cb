"""Rules compiled to one minimal deterministic automaton over bytes.

A small regular language (literals, classes, groups, alternation, ``? * + {m} {m,n}``) is parsed to
a nondeterministic automaton, made deterministic by subset construction, minimised by partition
refinement, and laid out as one flat transition array over byte classes."""

from __future__ import annotations

from dataclasses import dataclass, field

ALL = frozenset(range(256))


def _one(byte: int, fold: bool) -> frozenset[int]:
    c = chr(byte)
    return frozenset({byte, ord(c.swapcase())}) if fold and c.isascii() and c.isalpha() else frozenset({byte})


class _Parser:
    """Trees: ("set", bytes), ("cat", items), ("alt", items), ("rep", item, least, most or None)."""

    def __init__(self, pattern: str, fold: bool):
        self.s, self.i, self.fold = pattern, 0, fold

    def peek(self) -> str:
        return self.s[self.i : self.i + 1]

    def take(self) -> str:
        self.i += 1
        return self.s[self.i - 1]

    def escape(self) -> int:
        c = self.take()
        if c == "x":
            self.i += 2
            return int(self.s[self.i - 2 : self.i], 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def alternatives(self):
        items = [self.sequence()]
        while self.peek() == "|":
            self.take()
            items.append(self.sequence())
        return items[0] if len(items) == 1 else ("alt", items)

    def sequence(self):
        items = []
        while self.peek() and self.peek() not in "|)":
            items.append(self.repeated(self.atom()))
        return ("cat", items)

    def atom(self):
        c = self.take()
        if c == "(":
            if self.s.startswith("?:", self.i):
                self.i += 2
            inner = self.alternatives()
            if self.take() != ")":
                raise ValueError(f"unbalanced group in {self.s!r}")
            return inner
        if c == "[":
            return ("set", self.klass())
        return ("set", _one(self.escape() if c == "\\" else ord(c), self.fold))

    def klass(self) -> frozenset[int]:
        invert, out, first = self.peek() == "^", set(), True
        if invert:
            self.take()
        while first or self.peek() != "]":
            first = False
            c = self.take()
            low = self.escape() if c == "\\" else ord(c)
            high = low
            if self.peek() == "-" and self.s[self.i + 1] != "]":
                self.take()
                c = self.take()
                high = self.escape() if c == "\\" else ord(c)
            for b in range(low, high + 1):
                out |= _one(b, self.fold)
        self.take()
        return ALL - out if invert else frozenset(out)

    def repeated(self, item):
        while (c := self.peek()) and c in "?*+{":
            self.take()
            if c == "{":
                inside = self.s[self.i : self.s.index("}", self.i)]
                self.i += len(inside) + 1
                low, _, high = inside.partition(",")
                item = ("rep", item, int(low), int(high or low) if "," not in inside or high else None)
            else:
                item = ("rep", item, c == "+" and 1 or 0, 1 if c == "?" else None)
        return item


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.step: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.step.append(None)
        return len(self.step) - 1

    def build(self, tree, start: int) -> int:
        """Adds the tree from ``start`` on; the state where it ends."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            mid = self.state()
            self.empty[start].append(mid)
            self.step[mid] = (tree[1], end)
            return end
        if kind == "cat":
            for x in tree[1]:
                start = self.build(x, start)
            return start
        if kind == "alt":
            end = self.state()
            for x in tree[1]:
                self.empty[self.build(x, start_of := self.state())].append(end)
                self.empty[start].append(start_of)
            return end
        _, item, least, most = tree
        for _ in range(least):
            start = self.build(item, start)
        if most is None:
            hub = self.state()
            self.empty[start].append(hub)
            self.empty[self.build(item, hub)].append(hub)
            out = self.state()
            self.empty[hub].append(out)
            return out
        out = self.state()
        self.empty[start].append(out)
        for _ in range(most - least):
            start = self.build(item, start)
            self.empty[start].append(out)
        return out

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


def _reverse(tree):
    if tree[0] == "cat":
        return ("cat", [_reverse(x) for x in reversed(tree[1])])
    if tree[0] == "alt":
        return ("alt", [_reverse(x) for x in tree[1]])
    return ("rep", _reverse(tree[1]), *tree[2:]) if tree[0] == "rep" else tree


@dataclass
class Automaton:
    """``table[state + class]`` is the next state; states are multiples of ``width``. States from
    ``accepting`` on accept, and ``rules[state]`` says which rules; state ``dead`` leads nowhere."""

    classes: bytes
    width: int
    table: list[int]
    start: int
    accepting: int
    rules: dict[int, tuple[int, ...]] = field(default_factory=dict)
    dead: int = -1


def parse(pattern: str, fold: bool = False):
    p = _Parser(pattern, fold)
    tree = p.alternatives()
    if p.i != len(pattern):
        raise ValueError(f"unbalanced group in {pattern!r}")
    return tree


def compile_rules(trees: list, search: bool) -> Automaton:
    """One automaton for all the trees; with ``search`` a match may begin anywhere."""
    nfa = _Nfa()
    start, ends = nfa.state(), {}
    for i, tree in enumerate(trees):
        ends[nfa.build(tree, start)] = i
    sets = {s[0] for s in nfa.step if s}
    signature = {b: tuple(b in s for s in sets) for b in range(256)}
    names = {sig: k for k, sig in enumerate(dict.fromkeys(signature.values()))}
    classes = bytes(names[signature[b]] for b in range(256))
    sample = {k: next(b for b in range(256) if classes[b] == k) for k in range(len(names))}
    # subset construction
    first = nfa.closure([start])
    number, rows, accepts = {first: 0}, [], []
    queue = [first]
    for subset in queue:
        accepts.append(tuple(sorted(ends[x] for x in subset if x in ends)))
        moves = [(s[0], s[1]) for x in subset if (s := nfa.step[x])]
        row = []
        for k in range(len(names)):
            to = nfa.closure({end for allowed, end in moves if sample[k] in allowed} | ({start} if search else set()))
            if to not in number:
                number[to] = len(number)
                queue.append(to)
            row.append(number[to])
        rows.append(row)
    # minimisation: split blocks until all members of a block move alike
    block = [accepts.index(a) for a in accepts]
    while True:
        signs = [(block[i], *(block[j] for j in row)) for i, row in enumerate(rows)]
        index = {s: k for k, s in enumerate(dict.fromkeys(signs))}
        new = [index[s] for s in signs]
        if len(index) == len(set(block)):
            break
        block = new
    members = {b: i for i, b in reversed(list(enumerate(new)))}
    order = sorted(members, key=lambda b: bool(accepts[members[b]]))
    width, place = len(names), {b: k * len(names) for k, b in enumerate(order)}
    table = [place[new[j]] for b in order for j in rows[members[b]]]
    accepting = width * sum(not accepts[members[b]] for b in order)
    dead = next((place[b] for b in order if not accepts[members[b]] and all(new[j] == b for j in rows[members[b]])), -1)
    return Automaton(classes, width, table, place[new[0]], accepting, {place[b]: accepts[members[b]] for b in order if accepts[members[b]]}, dead)


def reversed_tree(tree):
    return _reverse(tree)


def longest(a: Automaton, data: bytes, at: int, stop: int, step: int = 1) -> int:
    """From ``at``, forward (``data`` from at on) or backward (bytes before at): the farthest place
    where the automaton accepts, or -1."""
    s, found, table, classes, accepting, dead = a.start, -1, a.table, a.classes, a.accepting, a.dead
    for i in range(at, stop) if step > 0 else range(at - 1, stop - 1, -1):
        s = table[s + classes[data[i]]]
        if s >= accepting:
            found = i + 1 if step > 0 else i
        elif s == dead:
            break
    return found
