"""Secret scans with one combined deterministic automaton.

The regexes of all rules become one non-deterministic automaton read from right to left, which subset construction and
minimisation turn into transition arrays over byte classes.  One pass over a text's bytes, last byte first, then tells at
which positions a match of which rule starts.  From these starts, each rule's own small automaton finds the longest end;
matches of a kind are taken leftmost and without overlap, and those under the kind's least length are dropped.  A private key's span goes on to its END line, or over its lines if it has none.

Null and empty texts have no spans.  Spans count code points, end exclusive, ordered by start and then by kind as listed, also where
several start at one place.  Texts of any length are scanned whole, in memory of a few times their size also where every byte starts a
match; repeated rows give repeated results; an empty table gives no rows; other columns are ignored or kept, whatever their names.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, texts_of


class Rule(NamedTuple):
    """head + body is the regex; the match counts if the whole has ``least`` bytes and what follows the head ``least_body``.

    A match that counts runs on over ``tail``, a regular expression of the library (it may look ahead) that also matches nothing.
    """

    kind: str
    head: str
    body: str
    least: int = 1
    least_body: int = 1
    tail: str = ""


_LINE_END = r"(?:[ \t]*(?:\r?\n|\r|\\r\\n|\\n))++[ \t]*+"
_FIELD = r"[A-Za-z][A-Za-z0-9-]*+:[ \t][^\r\n\\]*+"
#: A key's body up to its END line; without one, its base64 lines and header fields.
_KEY = rf"(?:\s|\\[rn]|{_FIELD}|[A-Za-z0-9+/=]++)*+-----END [A-Z ]*PRIVATE KEY-----|(?:{_LINE_END}(?:{_FIELD}|[A-Za-z0-9+/=]++)(?=[ \t]*(?:[\r\n\"']|\\[rn]|\Z)))*+"

#: The rules.  Letters of a head in (?i:...) match in either case.
BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", least_body=6),
    Rule("access", r"AKIA", r"[A-Z0-9]{16,}", least=20),
    Rule("hex", r"", r"[0-9a-f]{24,}", least=24),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_", r"[A-Za-z0-9]+", least_body=36),
    Rule("slack", r"xox[abprs]-", r"[A-Za-z0-9-]+", least_body=10),
    Rule("google", r"AIza", r"[0-9A-Za-z_-]+", least_body=35),
    Rule("payment", r"[sr]k_live_", r"[0-9A-Za-z]+", least_body=16),
    Rule("jwt", r"eyJ", r"[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", least_body=20),
    Rule("pem", r"-----BEGIN\x20", r"[A-Z\x20]*PRIVATE\x20KEY-----", tail=_KEY),
)
RULES = BASE_RULES + MORE_RULES
BASE_KINDS = tuple(r.kind for r in BASE_RULES)

# --- Regexes: a node is ("set", bytes), ("cat", nodes), ("alt", nodes), ("rep", node, least, most or None).


class _Parser:
    def __init__(self, text: str):
        self.text, self.at, self.fold = text, 0, False

    def alternatives(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.at += 1
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            node = self.atom()
            while self.peek() in ("?", "*", "+", "{") and self.peek():
                c = self.peek()
                self.at += 1
                if c == "{":
                    body, self.at = self.text[self.at : self.text.index("}", self.at)], self.text.index("}", self.at) + 1
                    low, comma, high = body.partition(",")
                    node = ("rep", node, int(low), (int(high) if high else None) if comma else int(low))
                else:
                    node = ("rep", node, int(c == "+"), 1 if c == "?" else None)
            parts.append(node)
        return ("cat", parts)

    def byte(self) -> int:
        c = self.peek()
        self.at += 1
        if c != "\\":
            return ord(c)
        c = self.peek()
        self.at += 1
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return ord(c)

    def atom(self):
        if self.peek() == "(":
            fold = self.fold
            self.at += 1
            if self.peek(3) == "?i:":
                self.at, self.fold = self.at + 3, True
            node = self.alternatives()
            self.at, self.fold = self.at + 1, fold
            return node
        if self.peek() == "[":
            self.at += 1
            found = set()
            while self.peek() != "]":
                low = high = self.byte()
                if self.peek() == "-" and self.peek(2) != "-]":
                    self.at += 1
                    high = self.byte()
                found.update(range(low, high + 1))
            self.at += 1
        else:
            found = {self.byte()}
        if self.fold:
            found |= {ord(x) for b in found for x in (chr(b).lower(), chr(b).upper()) if b < 128}
        return ("set", frozenset(found))


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.steps: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.steps.append([])
        return len(self.empty) - 1

    def add(self, node, start: int, backwards: bool) -> int:
        """The state that start leads to through node."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.steps[start].append((node[1], end))
            return end
        if kind == "cat":
            for part in reversed(node[1]) if backwards else node[1]:
                start = self.add(part, start, backwards)
            return start
        if kind == "alt":
            end = self.state()
            for part in node[1]:
                inner = self.state()
                self.empty[start].append(inner)
                self.empty[self.add(part, inner, backwards)].append(end)
            return end
        _, part, least, most = node
        for _ in range(least):
            start = self.add(part, start, backwards)
        end = self.state()
        if most is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[loop].append(end)
            self.empty[self.add(part, loop, backwards)].append(loop)
        else:
            self.empty[start].append(end)
            for _ in range(most - least):
                start = self.add(part, start, backwards)
                self.empty[start].append(end)
        return end

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


class Dfa:
    """Minimal automaton: ``table[state * width + byte class]`` is the next state times width; states from ``accepting`` on have rule bits in ``mask``."""

    def __init__(self, nodes: list, backwards: bool, anywhere: bool):
        nfa = _Nfa()
        root = nfa.state()
        finals: dict[int, int] = {}
        for k, node in enumerate(nodes):
            first = nfa.state()
            nfa.empty[root].append(first)
            finals[nfa.add(node, first, backwards)] = 1 << k
        sets = {s for steps in nfa.steps for s, _ in steps}
        by_sets: dict[tuple, int] = {}
        self.classes = bytes(by_sets.setdefault(tuple(b in s for s in sets), len(by_sets)) for b in range(256))
        width = len(by_sets)
        example = [self.classes.index(c) for c in range(width)]
        begin = nfa.closure([root])
        number, rows, masks, todo = {begin: 0}, [], [], [begin]
        for states in todo:
            row = []
            for c in range(width):
                after = {t for q in states for s, t in nfa.steps[q] if example[c] in s}
                after = nfa.closure(after | ({root} if anywhere else set()))
                if after not in number:
                    number[after] = len(number)
                    todo.append(after)
                row.append(number[after])
            rows.append(row)
            masks.append(sum({finals[q] for q in states if q in finals}))
        # Minimisation: split blocks by mask, then by the blocks that they lead to, until nothing splits.
        blocks = masks
        count = 0
        while len(set(blocks)) != count:
            count = len(set(blocks))
            names: dict[tuple, int] = {}
            blocks = [names.setdefault((blocks[q], *(blocks[t] for t in rows[q])), len(names)) for q in range(len(rows))]
        one = {}
        for q, b in enumerate(blocks):
            one.setdefault(b, q)
        order = sorted(one, key=lambda b: (masks[one[b]] != 0, one[b]))
        place = {b: i for i, b in enumerate(order)}
        self.width, self.start = width, place[blocks[0]] * width
        self.table = [place[blocks[t]] * width for b in order for t in rows[one[b]]]
        self.mask = [masks[one[b]] for b in order]
        self.accepting = sum(m == 0 for m in self.mask) * width
        dead = [i for i, b in enumerate(order) if not masks[one[b]] and all(place[blocks[t]] == i for t in rows[one[b]])]
        self.dead = dead[0] * width if dead else -1

    def longest(self, text: bytes, at: int) -> int:
        """End of the longest match that starts at ``at``; -1 if there is none."""
        s, table, classes, first, dead = self.start, self.table, self.classes, self.accepting, self.dead
        end = at if s >= first else -1
        for i in range(at, len(text)):
            s = table[s + classes[text[i]]]
            if s == dead:
                break
            if s >= first:
                end = i + 1
        return end


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        whole = [_Parser(r.head + r.body).alternatives() for r in rules]
        self.starts = Dfa(whole, backwards=True, anywhere=True)
        self.match = [Dfa([node], backwards=False, anywhere=False) for node in whole]
        self.head = [Dfa([_Parser(r.head).alternatives()], backwards=False, anywhere=False) if r.head else None for r in rules]
        self.tail = [re.compile(r.tail.encode()) if r.tail else None for r in rules]

    def byte_spans(self, text: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, in order."""
        d = self.starts
        table, first, s = d.table, d.accepting, d.start
        starts = [m for m in d.mask for _ in range(d.width)]  # rule bits by state
        runs: list[list[int]] = []  # [first, last, rule bits] of neighbouring places where the same rules' matches start: a long run of digits is one
        held = 0
        for i, c in enumerate(text.translate(d.classes)[::-1], 1):
            s = table[s + c]
            if s >= first:
                if starts[s] == held:
                    runs[-1][1] = i
                else:
                    held = starts[s]
                    runs.append([i, i, held])
            elif held:
                held = 0
        n, out, busy = len(text), [], [0] * len(self.rules)
        for last, start, mask in reversed(runs):
            own = [k for k in range(len(self.rules)) if mask >> k & 1]
            at, stop = n - start, n - last
            while at <= stop:
                for k in own:
                    if at >= busy[k]:
                        end, rule = self.match[k].longest(text, at), self.rules[k]
                        body = self.head[k].longest(text, at) if self.head[k] else at
                        if end - at >= rule.least and end - body >= rule.least_body:
                            if self.tail[k]:
                                end = self.tail[k].match(text, end).end()
                            out.append((at, k, end))
                        busy[k] = end
                at = max(at + 1, min(busy[k] for k in own))  # up to there every rule is inside a match
        return out

    def spans(self, text: bytes) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, ordered by start, then kind as listed."""
        found = self.byte_spans(text)
        if found and not text.isascii():
            place, before, points = {}, 0, 0
            for p in sorted({p for a, _, b in found for p in (a, b)}):
                points += len(text[before:p].decode())
                place[p], before = points, p
            found = [(place[a], k, place[b]) for a, k, b in found]
        return [(self.rules[k].kind, a, b) for a, k, b in found]


@lru_cache(4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span replaced by [kind]; of spans that overlap, the first one names the whole."""
    out, at = [], 0
    merged: list[list] = []
    for kind, a, b in spans:
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join(out) + text[at:]


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def scan_secrets(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES, redacted: bool = False) -> DataFrame:
    """(*keep, spans[, text_col with the spans replaced; a null text stays null]) for each row of docs."""
    source = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    schema = source.drop("__text").schema.add("spans", T.DataType.fromDDL(SPANS))
    if redacted:
        schema = schema.add(text_col, "string")
    built = docs.sparkSession.sparkContext.broadcast(scanner(rules))  # the transition arrays: a fixed size for the rules
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        scan = built.value
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            texts = texts_of(column)
            spans = [scan.spans(t) for t in texts]
            made = [pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans], kind)]
            if redacted:
                valid = column.is_valid().to_pylist()
                made.append(pa.array([(redact(t.decode(), s) if s else t.decode()) if v else None for t, s, v in zip(texts, spans, valid, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=schema.names)

    return arrow_map(source, run, schema)
