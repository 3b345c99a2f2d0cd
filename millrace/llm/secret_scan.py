"""Secret scan through a trigram inverted index.

From each rule's regex a Boolean trigram query is derived: what any match must contain. Every block of documents
gets an inverted index in one pass over its characters, a posting list of rows per trigram that some rule needs; a rule's
query intersects and unites posting lists, and only the rows that remain are searched with the regex. A rule without
mandatory trigrams searches every row. Blocks are built where the documents are: nothing is shuffled, and the index is as
large as its block.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: An index block ends after this many characters (a longer text is a block of its own).
BLOCK_CHARS = 1_000_000
#: Alternatives of a pattern part that are kept apart before they are folded into a query.
MOST_STRINGS = 24


@dataclass(frozen=True)
class Rule:
    """kind names the spans; group must have at least least characters. Matching is ASCII-only."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False

    @property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


# The three base rules, then those that the scan adds.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),
    # the whole key: header, key lines (or what stands for their ends inside a string), and the last line if it is there
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----(?:[\x09-\x0D\x20]+(?:Proc-Type|DEK-Info):[^\x0A\x0D]*)*[A-Za-z0-9+/=\x09-\x0D\x20\\]*(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----)?"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

# A query is None (any row), a trigram, or ("and" | "or", frozenset of queries).


def _both(a, b):
    if a is None or b is None:
        return b if a is None else a
    return a if a == b else ("and", frozenset((a, b)))


def _all_of(text: str):
    found = None
    for i in range(len(text) - 2):
        found = _both(found, text[i : i + 3])
    return found


def _any_of(strings: Iterable[str]):
    parts = {_all_of(s) for s in strings}
    return None if None in parts or not parts else parts.pop() if len(parts) == 1 else ("or", frozenset(parts))


@dataclass
class _State:
    """strings: every way to write the part just read (lower case); query: what was settled before it."""

    strings: set[str] = field(default_factory=lambda: {""})
    query: object = None

    def then(self, strings: set[str]) -> None:
        if len(self.strings) * len(strings) > MOST_STRINGS:
            self.settle()
        self.strings = {a + b for a in self.strings for b in strings} if len(strings) <= MOST_STRINGS else {""}

    def settle(self) -> None:
        self.query, self.strings = _both(self.query, _any_of(self.strings)), {""}


class _Parser:
    """Reads the part of the regex language that rules use; anything else is an error.

    Nodes: a character; a set of characters (None: too many to list); ("all", nodes); ("any", nodes);
    ("repeat", node, least, most)."""

    LISTED = 8  # characters of a set that are told apart

    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0
        self.tree = self.any()
        if self.at < len(pattern):
            raise ValueError(f"unexpected {pattern[self.at]!r} at {self.at} of {pattern!r}")

    def take(self, text: str) -> bool:
        found = self.text.startswith(text, self.at)
        self.at += len(text) * found
        return found

    def any(self) -> tuple:
        branches = [self.all()]
        while self.take("|"):
            branches.append(self.all())
        return branches[0] if len(branches) == 1 else ("any", branches)

    def all(self) -> tuple:
        nodes = []
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            node = self.one()
            counts = re.compile(r"([?*+])|\{(\d+)(,?)(\d*)\}").match(self.text, self.at)
            if counts:
                self.at = counts.end()
                sign, least, comma, most = counts.groups()
                bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[sign] if sign else (int(least), int(most) if most else None if comma else int(least))
                self.take("?")  # lazy: the same matches for a query
                node = ("repeat", node, *bounds)
            nodes.append(node)
        return ("all", nodes)

    def one(self) -> object:
        if self.take("("):
            if self.text.startswith("?", self.at) and not self.take("?:"):
                raise ValueError(f"unknown group at {self.at} of {self.text!r}")
            node = self.any()
            if not self.take(")"):
                raise ValueError(f"open group in {self.text!r}")
            return node
        if self.take("["):
            return self.set()
        if self.take("."):
            return (None,)
        char = self.char()
        return char if isinstance(char, str) else (None,)

    def char(self) -> str | None:
        """One literal character, None for an escape that means many."""
        char, self.at = self.text[self.at], self.at + 1
        if char in "^$":
            raise ValueError(f"unknown {char!r} in {self.text!r}")
        if char != "\\":
            return char
        char, self.at = self.text[self.at], self.at + 1
        if char == "x":
            self.at += 2
            return chr(int(self.text[self.at - 2 : self.at], 16))
        if char in "dDsSwW":
            return None
        if char.isalnum():
            raise ValueError(f"unknown \\{char} in {self.text!r}")
        return char

    def set(self) -> object:
        found, many = set(), self.take("^")
        while not self.take("]"):
            char = self.char()
            if char is not None and self.text.startswith("-", self.at) and not self.text.startswith("-]", self.at):
                self.at += 1
                last = self.char()
                found.update(map(chr, range(ord(char), ord(last) + 1)))
            elif char is None:
                many = True
            else:
                found.add(char)
        return (None,) if many or len({c.lower() for c in found}) > self.LISTED else frozenset(found)


def _read(node: object, state: _State) -> None:
    if isinstance(node, str):
        state.then({node.lower()})
    elif isinstance(node, frozenset):
        state.then({c.lower() for c in node})
    elif node[0] == "all":
        for part in node[1]:
            _read(part, state)
    elif node[0] == "any":
        exact, queries = set(), []
        for branch in node[1]:
            inner = _State()
            _read(branch, inner)
            exact = exact | inner.strings if exact is not None and inner.query is None else None
            queries.append(_both(inner.query, _any_of(inner.strings)))
        if exact is not None and len(exact) <= MOST_STRINGS and "" not in exact:
            state.then(exact)
        else:
            state.settle()
            if None not in queries:
                state.query = _both(state.query, ("or", frozenset(queries)) if len(set(queries)) > 1 else queries[0])
    elif node[0] == "repeat" and node[2:] == (0, 1) and isinstance(node[1], str):
        state.then({"", node[1].lower()})
    elif node[0] == "repeat" and node[2] >= 1:
        state.settle()
        inner = _State()
        _read(node[1], inner)
        state.query = _both(state.query, _both(inner.query, _any_of(inner.strings)))
    else:  # what is optional or matches too much ends the string
        state.settle()


def trigram_query(pattern: str):
    """The Boolean query that the lower-cased text of any match satisfies; None if there is none."""
    state = _State()
    _read(_Parser(pattern).tree, state)
    state.settle()
    return state.query


def trigrams_of(query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


#: ASCII characters by code, A-Z lower-cased; all others are one character, the last.
_CODES = np.array([ord(chr(c).lower()) for c in range(128)] + [0], np.uint8)


def _coded(text: str) -> list[int]:
    return [int(_CODES[min(ord(c), 128)]) for c in text]


class TrigramIndex:
    """Posting lists of one block for the trigrams asked for, from one pass over its characters.

    Characters beyond ASCII count as one: a posting list may hold rows without the trigram, and lacks none with it."""

    def __init__(self, texts: Sequence[str], trigrams: Iterable[str]):
        self.rows = len(texts)
        wanted = sorted(trigrams)
        numbers: dict[int, list[str]] = {}
        for g in wanted:
            a, b, c = _coded(g)
            numbers.setdefault((a * 128 + b) * 128 + c, []).append(g)
        slots = np.zeros(1 << 21, np.int32)
        slots[list(numbers)] = np.arange(1, len(numbers) + 1)
        lengths = np.fromiter((len(t) + 2 for t in texts), np.int64, self.rows)
        # two separators that no trigram has part the texts
        chars = np.frombuffer("".join(t + "\x01\x01" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = _CODES[np.minimum(chars, 128)]
        key = codes[:-2].astype(np.int32)
        for later in (codes[1:-1], codes[2:]):
            key *= 128
            key += later
        slot = slots[key]
        at = np.flatnonzero(slot)
        row = np.searchsorted(np.cumsum(lengths), at, side="right")
        pairs = np.unique(slot[at].astype(np.int64) * max(1, self.rows) + row)
        of, row = np.divmod(pairs, max(1, self.rows))
        cuts = np.searchsorted(of, np.arange(1, len(numbers) + 2))
        self.postings = {g: row[cuts[i] : cuts[i + 1]] for i, names in enumerate(numbers.values()) for g in names}

    def candidates(self, query) -> np.ndarray:
        if query is None:
            return np.arange(self.rows)
        if isinstance(query, str):
            return self.postings[query]
        lists = sorted((self.candidates(q) for q in query[1]), key=len)
        found = lists[0]
        for other in lists[1:]:
            found = np.intersect1d(found, other, assume_unique=True) if query[0] == "and" else np.union1d(found, other)
        return found


class Scanner:
    def __init__(self, rules: Sequence[Rule]):
        self.rules = [(i, r, r.regex, trigram_query(r.pattern)) for i, r in enumerate(rules)]
        self.trigrams = set().union(*(trigrams_of(q) for *_, q in self.rules))

    def scan(self, texts: Sequence[str]) -> list[list[tuple[int, int, int]]]:
        """(start, rule number, end) of every match, in order, for each text."""
        index = TrigramIndex(texts, self.trigrams)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for number, rule, regex, query in self.rules:
            for row in index.candidates(query):
                found[row] += [(m.start(), number, m.end()) for m in regex.finditer(texts[row]) if m.end(rule.group) - m.start(rule.group) >= rule.least]
        for spans in found:
            spans.sort()
        return found


def blocks(texts: Sequence[str]) -> Iterable[list[str]]:
    block, chars = [], 0
    for text in texts:
        block.append(text)
        chars += len(text)
        if chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


SPANS = "array<struct<kind:string,start:int,end:int>>"


def secrets(text: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The spans of every rule's matches in the whole text: kind, start, end (code points, end exclusive).

    Per rule leftmost and non-overlapping, those whose group is too short dropped; ordered by start, then by rule.
    Spans of different rules may overlap. Null and empty texts have an empty list. Equal texts give equal lists."""
    scanner = Scanner(rules)
    kinds = [r.kind for r in rules]

    @F.pandas_udf(SPANS)
    def spans(column: pd.Series) -> pd.Series:
        out: list[list[dict]] = []
        for block in blocks([t or "" for t in column]):
            out += [[{"kind": kinds[k], "start": s, "end": e} for s, k, e in row] for row in scanner.scan(block)]
        return pd.Series(out, index=column.index, dtype=object)

    return spans(text)


def redacted(text: Column, rules: Sequence[Rule] = RULES, mark: str = "[SECRET]") -> Column:
    """The text with every span (overlapping ones as one) replaced by mark; null stays null."""
    scanner = Scanner(rules)

    @F.pandas_udf("string")
    def masked(column: pd.Series) -> pd.Series:
        out: list[str | None] = []
        texts = list(column)
        rows = (row for block in blocks([t or "" for t in texts]) for row in scanner.scan(block))
        for text, row in zip(texts, rows, strict=True):
            if not row:
                out.append(text)
                continue
            parts, at = [], 0
            for start, _, end in row:
                if start >= at:
                    parts += [text[at:start], mark]
                at = max(at, end)
            out.append("".join([*parts, text[at:]]))
        return pd.Series(out, index=column.index, dtype=object)

    return masked(text)


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
