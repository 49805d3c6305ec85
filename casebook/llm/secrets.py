"""Secret scan with one combined deterministic automaton.

The patterns of all rules are compiled together: a nondeterministic automaton
each, subset construction of their union (with the start always added, so a
match may begin anywhere), minimisation by refining classes of states, and
renumbering that puts accepting states last.  A text's bytes go through the
one transition array once; each accepting step names the rules that end there.

For an accepting step of a rule, the minimal automaton of its reversed pattern
is run backwards, no further than the end of the rule's match before, to the
leftmost start.  The pattern is then applied at that start for the match's end
and groups, and the rule's least length is checked; a match that fails it is
dropped but still takes its place, so matches of a rule never overlap.

Cases: a null or empty text has no spans; texts of any length are scanned
whole; a text is scanned apart from its neighbours; repeated rows each get
their row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import re._constants as C
import re._parser as parser
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TextBlock, map_text


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern over bytes, and the least number of
    characters that ``group`` of a match must have."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("url_login", r"://[A-Za-z0-9_.-]+:[A-Za-z0-9_.%-]+@"),
)
RULES = BASE_RULES + MORE_RULES


# ---------------------------------------------------------------------------
# From patterns to transition arrays
# ---------------------------------------------------------------------------
class _Nfa:
    """States with empty steps and steps on byte sets; fragments (in, out)."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.steps: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.steps.append(None)
        return len(self.empty) - 1

    def on(self, values: frozenset) -> tuple[int, int]:
        a, b = self.state(), self.state()
        self.steps[a] = (values, b)
        return a, b

    def chain(self, parts: list[tuple[int, int]]) -> tuple[int, int]:
        if not parts:
            a = self.state()
            return a, a
        for (_, out), (into, _) in zip(parts, parts[1:]):
            self.empty[out].append(into)
        return parts[0][0], parts[-1][1]

    def build(self, items, fold: bool, backwards: bool) -> tuple[int, int]:
        parts = [self.item(op, arg, fold, backwards) for op, arg in items]
        return self.chain(parts[::-1] if backwards else parts)

    def item(self, op, arg, fold: bool, backwards: bool) -> tuple[int, int]:
        if op in (C.LITERAL, C.NOT_LITERAL, C.IN, C.ANY):
            return self.on(_byte_set(op, arg, fold))
        if op is C.SUBPATTERN:
            return self.build(arg[3], fold or bool(arg[1] & re.I), backwards)
        if op is C.BRANCH:
            a, b = self.state(), self.state()
            for branch in arg[1]:
                into, out = self.build(branch, fold, backwards)
                self.empty[a].append(into)
                self.empty[out].append(b)
            return a, b
        if op is C.MAX_REPEAT:
            low, high, sub = arg
            parts = [self.build(sub, fold, backwards) for _ in range(low)]
            if high is C.MAXREPEAT:
                a, b = self.state(), self.state()
                into, out = self.build(sub, fold, backwards)
                self.empty[a] += [into, b]
                self.empty[out].append(a)
                parts.append((a, b))
            else:
                for _ in range(high - low):
                    a, b = self.state(), self.state()
                    into, out = self.build(sub, fold, backwards)
                    self.empty[a] += [into, b]
                    self.empty[out].append(b)
                    parts.append((a, b))
            return self.chain(parts)
        raise ValueError(f"a rule's pattern may not hold {op}")

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for nxt in self.empty[todo.pop()]:
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return frozenset(seen)


def _byte_set(op, arg, fold: bool) -> frozenset:
    if op is C.LITERAL:
        got = {arg}
    elif op is C.NOT_LITERAL:
        got = set(range(256)) - {arg}
    elif op is C.ANY:
        got = set(range(256)) - {10}
    else:
        got, negate = set(), False
        for kind, value in arg:
            if kind is C.NEGATE:
                negate = True
            elif kind is C.LITERAL:
                got.add(value)
            elif kind is C.RANGE:
                got.update(range(value[0], value[1] + 1))
            else:
                raise ValueError(f"a rule's set may not hold {kind}")
        got = set(range(256)) - got if negate else got
    if fold:
        got |= {b ^ 32 for b in got if 65 <= b <= 90 or 97 <= b <= 122}
    if max(got, default=0) > 255:
        raise ValueError("rules are patterns over bytes")
    return frozenset(got)


@dataclass
class Automaton:
    """``steps[state * width + classes[byte]]`` is the next state times width;
    states from ``accepting`` on (times width) accept; ``ends`` lists, for
    each of these, the numbers of the patterns.  State 0 is the start;
    ``dead`` (times width, or -1) is left by no byte."""

    classes: bytes
    width: int
    steps: list[int]
    start: int
    accepting: int
    ends: list[tuple[int, ...]]
    dead: int

    @property
    def n_states(self) -> int:
        return len(self.steps) // self.width


def _shortest(items) -> list:
    """The items without the open end of a repeat that ends them: whatever
    they match starts with a match of these."""
    items = list(items)
    if items and items[-1][0] is C.MAX_REPEAT and items[-1][1][1] is C.MAXREPEAT:
        low, _, sub = items[-1][1]
        items[-1] = (C.MAX_REPEAT, (low, low, sub))
    elif items and items[-1][0] is C.SUBPATTERN:
        *head, sub = items[-1][1]
        items[-1] = (C.SUBPATTERN, (*head, _shortest(sub)))
    return items


def compile_patterns(patterns: list[str], anywhere: bool, backwards: bool = False) -> Automaton:
    """The minimal deterministic automaton of the patterns' union; with
    ``anywhere`` a match may start at any byte, else only at the first.  An
    open repeat at a pattern's end is cut to its least length where matches
    may start anywhere: what lies behind a match's first end need not be
    carried in the states."""
    nfa, starts, outs = _Nfa(), [], {}
    for k, p in enumerate(patterns):
        items = parser.parse(p.encode("ascii"))
        into, out = nfa.build(_shortest(items) if anywhere else items, False, backwards)
        starts.append(into)
        outs[out] = k
    sets = {s[0] for s in nfa.steps if s}
    classes, groups = _byte_classes(sets)
    first = nfa.closure(starts)
    number, table, todo = {first: 0}, [], [first]
    while todo:
        here = todo.pop(0)
        row = []
        for byte in groups:
            to = {s[1] for q in here if (s := nfa.steps[q]) and byte in s[0]}
            there = nfa.closure(to) | first if anywhere else nfa.closure(to)
            if there not in number:
                number[there] = len(number)
                todo.append(there)
            row.append(number[there])
        table.append(row)
    labels = [tuple(sorted(outs[q] for q in state if q in outs)) for state in number]
    steps, part = _minimise(np.array(table, np.int64), labels)
    ends = [()] * len(steps)
    for old, new in enumerate(part):
        ends[new] = labels[old]
    order = sorted(range(len(steps)), key=lambda s: (bool(ends[s]), s != part[0], s))
    place = {s: k for k, s in enumerate(order)}
    width = len(groups)
    flat = [place[t] * width for s in order for t in steps[s].tolist()]
    plain = sum(not ends[s] for s in order)
    dead = next((k * width for k, s in enumerate(order[:plain]) if all(t == s for t in steps[s].tolist())), -1)
    return Automaton(classes, width, flat, place[part[0]] * width, plain * width, [ends[s] for s in order[plain:]], dead)


def _byte_classes(sets: set[frozenset]) -> tuple[bytes, list[int]]:
    """A class for each byte, and one byte of each class: bytes that lie in
    the same sets share a class."""
    ordered = sorted(sets, key=sorted)
    seen: dict[tuple, int] = {}
    classes, groups = [], []
    for byte in range(256):
        key = tuple(byte in s for s in ordered)
        if key not in seen:
            seen[key] = len(seen)
            groups.append(byte)
        classes.append(seen[key])
    return bytes(classes), groups


def _minimise(table: np.ndarray, labels: list[tuple]) -> tuple[np.ndarray, list[int]]:
    """Steps between classes of equal states, and each state's class: classes
    start from the labels and are split until equal classes step alike."""
    ids = {x: k for k, x in enumerate(dict.fromkeys(labels))}
    part = np.array([ids[x] for x in labels])
    while True:
        _, finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == part.max():
            break
        part = finer
    keep = np.array([np.flatnonzero(part == k)[0] for k in range(part.max() + 1)])
    return part[table[keep]], part.tolist()


# ---------------------------------------------------------------------------
# Scanning
# ---------------------------------------------------------------------------
class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.all = compile_patterns([r.pattern for r in rules], anywhere=True)
        self.back = [compile_patterns([r.pattern], anywhere=False, backwards=True) for r in rules]

    def prepare(self) -> None:
        """Once a task: makes the patterns (they aren't sent compiled) and lets
        equal steps share one number, which keeps the array in the cache."""
        one = {x: x for x in self.all.steps}
        self.all.steps = [one[x] for x in self.all.steps]
        self.compiled = [re.compile(r.pattern.encode()) for r in self.rules]

    def scan(self, raw: bytes) -> list[tuple[int, int, int]]:
        """(start, rule number, end) in bytes, by start, then rule."""
        steps, accepting, state = self.all.steps, self.all.accepting, self.all.start
        hits = []
        for at, c in enumerate(raw.translate(self.all.classes)):
            state = steps[state + c]
            if state >= accepting:
                hits.append((at, state))
        if not hits:
            return []
        width, ends = self.all.width, self.all.ends
        past, found = [0] * len(self.rules), []
        for at, state in hits:
            for k in ends[(state - accepting) // width]:
                if at >= past[k] and (start := self._start(raw, k, at, past[k])) is not None:
                    m = self.compiled[k].match(raw, start)
                    past[k] = m.end()
                    a, b = m.span(self.rules[k].group)
                    if b - a >= self.rules[k].least:
                        found.append((start, k, m.end()))
        return sorted(found)

    def _start(self, raw: bytes, k: int, at: int, stop: int) -> int | None:
        auto, found = self.back[k], None
        state = auto.start
        for i in range(at, stop - 1, -1):
            state = auto.steps[state + auto.classes[raw[i]]]
            if state >= auto.accepting:
                found = i
            elif state == auto.dead:
                break
        return found

    def spans(self, raw: bytes) -> list[tuple[str, int, int]]:
        """(kind, start, end) in characters."""
        found = self.scan(raw)
        if not found:
            return []
        if raw.isascii():
            place = lambda at: at
        else:
            leads = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
            place = lambda at: int(leads[at])
        return [(self.rules[k].kind, place(a), place(b)) for a, k, b in found]


def scan_secrets(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text",
                 keep: list[str] | None = None) -> DataFrame:
    """The kept columns (the id) and secrets: array<struct<kind, start, end>>,
    by start, then in the rules' order; characters, end exclusive."""
    scanner = Scanner(rules)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def make():
        scanner.prepare()

        def work(block: TextBlock) -> list[pa.Array]:
            return [pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in scanner.spans(raw)]
                              for raw in block.raw()], kind)]
        return work

    return map_text(df, text_col, keep or [id_col],
                    [("secrets", "array<struct<kind:string,start:bigint,end:bigint>>")], make)


def secret_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_assign, n_access, n_hex, base_sha256 and spans, from scan_secrets."""
    found = scan_secrets(df, RULES, id_col, text_col)
    base = [r.kind for r in BASE_RULES]
    said = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    joined = lambda a: F.concat_ws(",", F.transform(a, said))
    secrets, of = F.col("secrets"), lambda kinds: lambda x: x["kind"].isin(kinds)
    return found.select(
        F.col(f"`{id_col}`"),
        *[F.size(F.filter(secrets, of([k]))).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(joined(F.filter(secrets, of(base))), 256).alias("base_sha256"),
        joined(secrets).alias("spans"))


def redact_secrets(df: DataFrame, text_col: str = "text", length_col: str | None = None,
                   rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with every span (overlapping ones joined) replaced by ``[kind]``
    of its first rule; ``length_col`` is set to the new length.  Rows, order of
    columns and texts without secrets stay as they are."""
    scanner = Scanner(rules)

    def make():
        scanner.prepare()

        def work(block: TextBlock) -> list[pa.Array]:
            out = []
            for raw, null in zip(block.raw(), block.nulls.tolist()):
                parts, at = [], 0
                for start, k, end in scanner.scan(raw):
                    if start >= at:
                        parts += [raw[at:start], f"[{scanner.rules[k].kind}]".encode()]
                    at = max(at, end)
                out.append(None if null else (b"".join([*parts, raw[at:]]) if parts else raw).decode("utf-8", "replace"))
            return [pa.array(out, pa.string())]
        return work

    names = df.columns
    rest = [c for c in names if c != text_col]
    new = map_text(df, text_col, rest, [("_redacted", "string")], make)
    made = new.columns[-1]
    of = {text_col: F.col(f"`{made}`")}
    if length_col:
        of[length_col] = F.length(F.col(f"`{made}`")).cast("long")
    return new.select(*[of.get(c, F.col(f"`{c}`")).alias(c) for c in names])
