"""Regexes over bytes, compiled by subset construction and minimised into transition arrays.

The patterns may hold literals, escapes (\\xNN, \\n, \\t, \\d, escaped signs), classes, groups, |, ?, *, + and {m}, {m,}, {m,n}; (?i:...)
makes the ASCII letters in it match in either case.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Nfa:
    """Edges by byte set, empty edges, and what each accepting state accepts."""

    edges: list[list[tuple[frozenset[int], int]]] = field(default_factory=list)
    empty: list[list[int]] = field(default_factory=list)
    accepts: dict[int, int] = field(default_factory=dict)

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1


#: Parsed patterns: ("set", bytes), ("cat", parts), ("alt", parts), ("rep", part, least, most or None)
Node = tuple


class _Parser:
    def __init__(self, pattern: str):
        self.p, self.i, self.fold = pattern, 0, False

    def peek(self) -> str:
        return self.p[self.i : self.i + 1]

    def take(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def alternation(self) -> Node:
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self) -> Node:
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated(self.atom()))
        return ("cat", parts)

    def repeated(self, node: Node) -> Node:
        while (c := self.peek()) and c in "?*+{":
            self.take()
            if c == "{":
                end = self.p.index("}", self.i)
                low, comma, high = self.p[self.i : end].partition(",")
                self.i = end + 1
                node = ("rep", node, int(low), int(high) if high else None if comma else int(low))
            else:
                node = ("rep", node, *{"?": (0, 1), "*": (0, None), "+": (1, None)}[c])
        return node

    def atom(self) -> Node:
        c = self.take()
        if c == "(":
            before = self.fold
            if self.p.startswith("?i:", self.i):
                self.i, self.fold = self.i + 3, True
            elif self.p.startswith("?:", self.i):
                self.i += 2
            node = self.alternation()
            if self.take() != ")":
                raise ValueError(f"unbalanced group in {self.p}")
            self.fold = before
            return node
        if c == "[":
            return ("set", self.folded(self.bracket()))
        return ("set", self.folded(self.escape() if c == "\\" else {ord(c)}))

    def escape(self) -> set[int]:
        c = self.take()
        if c == "x":
            self.i += 2
            return {int(self.p[self.i - 2 : self.i], 16)}
        return set(range(0x30, 0x3A)) if c == "d" else {ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))}

    def bracket(self) -> set[int]:
        out: set[int] = set()
        negated = self.peek() == "^" and bool(self.take())
        while (c := self.take()) != "]":
            first = self.escape() if c == "\\" else {ord(c)}
            if self.peek() == "-" and self.p[self.i + 1] != "]" and len(first) == 1:
                self.take()
                last = self.escape() if (d := self.take()) == "\\" else {ord(d)}
                first = set(range(min(first), max(last) + 1))
            out |= first
        return set(range(256)) - out if negated else out

    def folded(self, found: set[int]) -> frozenset[int]:
        if self.fold:
            found = found | {b ^ 0x20 for b in found if chr(b).isascii() and chr(b).isalpha()}
        return frozenset(found)


def parse(pattern: str) -> Node:
    parser = _Parser(pattern)
    node = parser.alternation()
    if parser.peek():
        raise ValueError(f"unbalanced group in {pattern}")
    return node


def backwards(node: Node) -> Node:
    """The pattern of the reversed strings."""
    kind = node[0]
    if kind == "set":
        return node
    if kind == "rep":
        return ("rep", backwards(node[1]), *node[2:])
    parts = [backwards(p) for p in node[1]]
    return (kind, parts[::-1] if kind == "cat" else parts)


def _build(nfa: Nfa, node: Node, start: int) -> int:
    """Add node behind start; its end state."""
    kind = node[0]
    if kind == "set":
        end = nfa.state()
        nfa.edges[start].append((node[1], end))
        return end
    if kind == "cat":
        for part in node[1]:
            start = _build(nfa, part, start)
        return start
    if kind == "alt":
        end = nfa.state()
        for part in node[1]:
            first = nfa.state()
            nfa.empty[start].append(first)
            nfa.empty[_build(nfa, part, first)].append(end)
        return end
    _, part, low, high = node
    for _ in range(low):
        start = _build(nfa, part, start)
    end = nfa.state()
    nfa.empty[start].append(end)
    if high is None:
        first = nfa.state()
        nfa.empty[start].append(first)
        last = _build(nfa, part, first)
        nfa.empty[last] += [first, end]
    else:
        for _ in range(high - low):
            start = _build(nfa, part, start)
            nfa.empty[start].append(end)
    return end


@dataclass(frozen=True)
class Dfa:
    """Flat transitions over classes of bytes: state s goes to table[s + class]; states are multiples of `width`, and those from
    `accepting` on accept masks[s // width]. State `dead` never accepts again."""

    classes: bytes
    width: int
    table: list[int]
    dead: int
    start: int
    accepting: int
    masks: list[int]


def compile_rules(nodes: list[Node], anchored: bool) -> Dfa:
    """One automaton for all patterns; unless anchored, a match may start at each byte. Rule i accepts as bit i."""
    nfa = Nfa()
    start = nfa.state()
    for rule, node in enumerate(nodes):
        first = nfa.state()
        nfa.empty[start].append(first)
        nfa.accepts[_build(nfa, node, first)] = 1 << rule

    def closure(states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    # Bytes that no edge tells apart are one class.
    sets = {s for edges in nfa.edges for s, _ in edges}
    groups: dict[tuple[bool, ...], int] = {}
    of_byte = [groups.setdefault(tuple(b in s for s in sets), len(groups)) for b in range(256)]
    member = {c: of_byte.index(c) for c in range(len(groups))}
    begin = closure({start})
    numbers: dict[frozenset[int], int] = {frozenset(): 0, begin: 1}
    todo, rows = [frozenset(), begin], []
    for states in todo:
        row = []
        for c in range(len(groups)):
            b = member[c]
            reached = {t for s in states for on, t in nfa.edges[s] if b in on} | (set() if anchored else {start})
            target = closure(reached)
            if target not in numbers:
                numbers[target] = len(numbers)
                todo.append(target)
            row.append(numbers[target])
        rows.append(row)
    masks = [0] * len(todo)
    for states, n in numbers.items():
        for s in states:
            masks[n] |= nfa.accepts.get(s, 0)

    # Minimise: split the classes by what they accept and where they go until nothing changes.
    block = list(masks)
    while True:
        ids: dict[tuple, int] = {}
        new = [ids.setdefault((block[s], *(block[t] for t in rows[s])), len(ids)) for s in range(len(rows))]
        if len(ids) == len(set(block)):
            break
        block = new
    order = sorted(set(block), key=lambda k: (masks[block.index(k)] != 0, block.index(k)))
    place = {k: i for i, k in enumerate(order)}
    width = len(groups)
    numbered = [i * width for i in range(len(order))]  # one object a state: the table stays in the processor's cache
    table: list[int] = []
    out_masks = []
    for k in order:
        row = rows[block.index(k)]
        table += [numbered[place[block[t]]] for t in row]
        out_masks.append(masks[block.index(k)])
    accepting = next((i for i, m in enumerate(out_masks) if m), len(out_masks))
    return Dfa(bytes(of_byte), width, table, place[block[0]] * width, place[block[1]] * width, accepting * width, out_masks)


class Scanner:
    """Leftmost-longest, non-overlapping matches of each rule in one pass over the bytes.

    The combined automaton tells where matches of which rules end. At the first end of a rule behind its last match, the rule's
    reversed automaton finds the leftmost start and its anchored one the longest end. This gives the leftmost match for rules of
    which no match can lie inside the unfinished part of another (a keyword with what follows, a run of one class)."""

    def __init__(self, patterns: list[str]):
        nodes = [parse(p) for p in patterns]
        self.all = compile_rules(nodes, anchored=False)
        self.ahead = [compile_rules([n], anchored=True) for n in nodes]
        self.back = [compile_rules([backwards(n)], anchored=True) for n in nodes]
        self.alone = [compile_rules([n], anchored=False) for n in nodes]

    @staticmethod
    def _longest(dfa: Dfa, data: bytes) -> tuple[int, bool]:
        """The length of the longest match from the start, -1 without one, and whether more data might give a longer one."""
        state, best, accepting, table, dead = dfa.start, -1, dfa.accepting, dfa.table, dfa.dead
        for n, b in enumerate(data.translate(dfa.classes), 1):
            state = table[state + b]
            if state >= accepting:
                best = n
            elif state == dead:
                return best, False
        return best, True

    def _back(self, rule: int, data: bytes, low: int, end: int) -> int:
        """How far the longest match that ends at end reaches back, not beyond low; the piece grows as long as the automaton is alive at its end."""
        size = 256
        while True:
            piece = data[max(low, end - size) : end]
            found, alive = self._longest(self.back[rule], piece[::-1])
            if not alive or len(piece) < size:
                return found
            size *= 4

    def _next(self, rule: int, data: bytes, low: int) -> int:
        """The last byte of the first match to end of those that start at low or behind; behind the data without one."""
        dfa = self.alone[rule]
        state, accepting, table = dfa.start, dfa.accepting, dfa.table
        for at, b in enumerate(data[low:].translate(dfa.classes), low):
            state = table[state + b]
            if state >= accepting:
                return at
        return len(data)

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(rule, start, end) in bytes, by end of the shortest match."""
        table, state, accepting, masks, width = self.all.table, self.all.start, self.all.accepting, self.all.masks, self.all.width
        resume, wait = [0] * len(self.ahead), [0] * len(self.ahead)
        out = []
        for at, b in enumerate(data.translate(self.all.classes)):
            state = table[state + b]
            if state >= accepting:
                mask = masks[state // width]
                while mask:
                    rule = (mask & -mask).bit_length() - 1
                    mask &= mask - 1
                    low = resume[rule]
                    if at < wait[rule]:
                        continue
                    if (length := self._back(rule, data, low, at + 1)) < 0:
                        wait[rule] = self._next(rule, data, low)  # what ends here starts before low: looked at once, not at each further byte
                        continue
                    start = at + 1 - length
                    end = start + self._ahead(rule, data, start)
                    resume[rule] = wait[rule] = end
                    out.append((rule, start, end))
        return out

    def _ahead(self, rule: int, data: bytes, start: int) -> int:
        """The length of the longest match from start; more is looked at as long as it may go on."""
        size = 256
        while True:
            piece = data[start : start + size]
            found, alive = self._longest(self.ahead[rule], piece)
            if not alive or len(piece) < size:
                return found
            size *= 4
