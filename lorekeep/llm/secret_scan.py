"""Operator 10: secret scans with inferred grammars.

Base rules find assignments, access keys and hex strings. The values that they label are dealt into
formats by kind, letters used and first letters in common; from each format one probabilistic
automaton is inferred: a prefix tree of the training values whose states are merged in red-blue
order wherever their outgoing shares are statistically compatible and both are seen often enough to
tell. Every other run of credential letters, from six letters on, is then scored by its likelihood
under those formats against a letter-pair model of the corpus, and is added as a span of kind
``format`` if no single letter pulls it below its format and the odds, over all of its letters, are
EVIDENCE bits and more. Runs that differ are scored together, letter by letter, in numpy.

Defined cases: a run of letters is one candidate, whatever its length; a null or empty text has no spans; a text of any length is scanned whole; without
any labelled value nothing is added; repeated rows get equal spans. Offsets count code points.
Other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "format")
_NAMES = ("password", "passwd", "secret", "token", "api_?key")
_ANYCASE = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in n) for n in _NAMES)
ASSIGN = re.compile(rf"({_ANYCASE})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A candidate of the automata: a run of credential letters of at least the length of the shortest base value.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
#: Training values: at most about so many a kind, those of the least hash, and only their first letters so far.
MAX_VALUES, MAX_LETTERS = 1500, 256
#: Confidence of the Hoeffding test for a state; passes through a state below which it is not told apart from its like.
ALPHA, LEAST_SEEN = 0.05, 20
#: Training values of a format at least; letters that two values of a format have in common at their start.
LEAST_VALUES, HEAD = 8, 3
#: Bits a letter, and in all, by which a format must beat the corpus' own letter pairs.
MARGIN_BITS, EVIDENCE = 0.75, 24.0
#: Share of a format's training values that may score below its floor.
FLOOR_SHARE = 0.01
#: Distinct candidates that a task remembers before it starts afresh.
MEMORY = 150_000


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) by the base rules, in order of start, then kind."""
    out = []
    low = text.lower()
    if any(n in low for n in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        out += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


class Automaton:
    """A probabilistic automaton: per state, counts of letters with their targets, and of ends."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.end: list[int] = [0]

    def insert(self, value: str, times: int = 1) -> None:
        state = 0
        for c in value:
            self.count[state][c] = self.count[state].get(c, 0) + times
            if c not in self.next[state]:
                self.next[state][c] = len(self.next)
                self.next.append({})
                self.count.append({})
                self.end.append(0)
            state = self.next[state][c]
        self.end[state] += times

    def total(self, state: int) -> int:
        return self.end[state] + sum(self.count[state].values())

    def compatible(self, a: int, b: int, alpha: float) -> bool:
        """Do the outgoing shares of both states, and of all below them, agree within the bound?"""
        pairs, width = [(a, b)], math.sqrt(0.5 * math.log(2 / alpha))
        while pairs:
            a, b = pairs.pop()
            n, m = self.total(a), self.total(b)
            if not n or not m:
                continue
            if min(n, m) < LEAST_SEEN:
                continue  # too rare to tell
            bound = width * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.end[a] / n - self.end[b] / m) > bound:
                return False
            for c in self.count[a].keys() | self.count[b].keys():
                if abs(self.count[a].get(c, 0) / n - self.count[b].get(c, 0) / m) > bound:
                    return False
                if c in self.next[a] and c in self.next[b]:
                    pairs.append((self.next[a][c], self.next[b][c]))
        return True

    def apart(self, a: int, b: int) -> float:
        """Half the sum of what the outgoing shares differ by."""
        n, m = max(1, self.total(a)), max(1, self.total(b))
        letters = self.count[a].keys() | self.count[b].keys()
        return (abs(self.end[a] / n - self.end[b] / m) + sum(abs(self.count[a].get(c, 0) / n - self.count[b].get(c, 0) / m) for c in letters)) / 2

    def fold(self, into: int, tree: int) -> None:
        """Add the counts of the tree below ``tree`` to the states that ``into`` leads to."""
        pairs = [(into, tree)]
        while pairs:
            a, b = pairs.pop()
            self.end[a] += self.end[b]
            for c, n in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + n
                if c in self.next[a]:
                    pairs.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]

    def merge(self, alpha: float = ALPHA) -> Automaton:
        """Merge compatible states, heaviest first: red states stay, blue ones are their children.

        Of the red states that a blue one is compatible with it joins the one whose letters are most like its own.
        """
        red = [0]
        while blue := sorted({(-self.total(t), s, c, t) for s in red for c, t in self.next[s].items() if t not in set(red)}):
            _, source, letter, state = blue[0]
            able = [r for r in red if self.compatible(r, state, alpha)]
            if able:
                r = min(able, key=lambda r: (self.apart(r, state), r))
                self.next[source][letter] = r
                self.fold(r, state)
            else:
                red.append(state)
        return self

    def table(self) -> dict[int, dict[str, tuple[int, float]]]:
        """Of the states that can be reached: letter to (target, bits); ends under the empty letter."""
        seen, todo = {}, [0]
        while todo:
            if (s := todo.pop()) in seen:
                continue
            n = self.total(s) + 1.0
            seen[s] = {c: (self.next[s][c], math.log2(k / n)) for c, k in self.count[s].items()} | {"": (s, math.log2((self.end[s] + 0.5) / n))}
            todo += self.next[s].values()
        return seen


#: Bits for a letter that a format or a pair of letters has never shown.
UNSEEN = -14.0


def bits(table: dict[int, dict[str, tuple[int, float]]], value: str) -> float:
    """log2 likelihood of ``value``; a letter that its state lacks costs UNSEEN and stays there."""
    state, total = 0, 0.0
    for c in value:
        state, b = table[state].get(c, (state, UNSEEN))
        total += b
    return total + table[state][""][1]


def letters_used(value: str) -> str:
    """The kinds of letters in a value; hex digits are a kind of their own."""
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", value):
        return "x" if value == value.lower() else "X"
    return "".join(k for k, p in (("a", "[a-z]"), ("A", "[A-Z]"), ("9", "[0-9]"), ("+", "[^A-Za-z0-9]")) if re.search(p, value))


def formats_of(values: Counter) -> dict[tuple[str, str], Counter]:
    """Values of one kind by format: the letters used, and the start that LEAST_VALUES of them and more have in common."""
    starts: Counter = Counter()
    for v in values:
        starts[letters_used(v), v[:HEAD]] += 1
    total, out = Counter(letters_used(v) for v in values), defaultdict(Counter)
    for v, n in values.items():
        used = letters_used(v)
        # a start is one of a format if it is far more frequent than letters by chance make it
        own = starts[used, v[:HEAD]] >= max(LEAST_VALUES, total[used] / 50)
        out[used, v[:HEAD] if own else ""][v] = n
    return out


class Scorer:
    """An automaton as arrays over states and ASCII letters, for many values at once."""

    def __init__(self, table: dict[int, dict[str, tuple[int, float]]]) -> None:
        names = {s: i for i, s in enumerate(sorted(table))}
        self.next = np.tile(np.arange(len(names), dtype=np.int32)[:, None], (1, 128))
        self.bits = np.full((len(names), 128), UNSEEN, np.float32)
        self.end = np.zeros(len(names), np.float32)
        for s, row in table.items():
            for c, (t, b) in row.items():
                if c:
                    self.next[names[s], ord(c)], self.bits[names[s], ord(c)] = names[t], b
                else:
                    self.end[names[s]] = b
        self.start = names[0]

    def score(self, columns: list[np.ndarray], lengths: np.ndarray) -> np.ndarray:
        """Bits of values given by place: ``columns[k]`` holds the letters at k of those, longest first, that reach it."""
        state, total = np.full(len(lengths), self.start, np.int32), np.zeros(len(lengths))
        for c in columns:
            n = len(c)
            total[:n] += self.bits[state[:n], c]
            state[:n] = self.next[state[:n], c]
        return total + self.end[state]


@dataclass(frozen=True)
class Formats:
    """The automata by format with their floors, and the letter-pair model of the corpus (bits by first and second letter)."""

    scorers: dict[str, Scorer]
    floors: dict[str, float]
    words: np.ndarray

    def likely(self, values: list[str]) -> list[bool]:
        """For each value: is some format's likelihood a letter above its floor, and far enough above the corpus' own?"""
        if not values or not self.scorers:
            return [False] * len(values)
        lengths = np.array([len(v) for v in values])
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        raw = np.frombuffer("".join(values[i] for i in order.tolist()).encode("ascii"), np.uint8)
        starts = np.cumsum(lengths) - lengths
        reach = np.searchsorted(-lengths, -np.arange(int(lengths[0])), "left")  # how many are longer than k
        columns = [raw[starts[:n] + k] for k, n in enumerate(reach.tolist())]
        plain, before = np.zeros(len(lengths)), np.full(len(lengths), 10, np.uint8)
        for c in columns:
            plain[: len(c)] += self.words[before[: len(c)], c]
            before[: len(c)] = c
        good = np.zeros(len(lengths), bool)
        for name, scorer in self.scorers.items():
            found = scorer.score(columns, lengths)
            odds = found - plain
            good |= (found / (lengths + 1) >= self.floors[name]) & (odds / (lengths + 1) >= MARGIN_BITS) & (odds >= EVIDENCE)
        out = np.zeros(len(lengths), bool)
        out[order] = good
        return out.tolist()


def infer(values: Iterable[tuple[str, str, int]], pairs: dict[str, int]) -> Formats:
    """Automata from (kind, value, times) and the corpus' letter pairs from their counts."""
    by: dict[str, Counter] = defaultdict(Counter)
    for kind, value, times in values:
        by[kind][value] += times
    scorers, floors = {}, {}
    for kind in sorted(by):
        for (used, head), own in sorted(formats_of(by[kind]).items()):
            if len(own) < LEAST_VALUES:
                continue  # too few to tell a format by
            tree = Automaton()
            for value in sorted(own):
                tree.insert(value)  # once, however often it stands: a copied text is not a format
            name = f"{kind}/{used}/{head}"
            table = tree.merge().table()
            scores = sorted(bits(table, v) / (len(v) + 1) for v in own)
            scorers[name], floors[name] = Scorer(table), scores[int(FLOOR_SHARE * len(scores))] - 0.25
    words, first = np.full((128, 128), UNSEEN, np.float32), Counter()
    for p, n in pairs.items():
        first[p[0]] += n
    for p, n in pairs.items():
        words[ord(p[0]), ord(p[1])] = math.log2(n / (first[p[0]] + 1))
    return Formats(scorers, floors, words)


class _Known(dict):
    """What is known of candidates: are they likely?"""

    def learn(self, texts: Iterable[str], formats: Formats) -> None:
        new = sorted({m for t in texts for m in CANDIDATE.findall(t)} - self.keys())
        if len(self) + len(new) > MEMORY:
            self.clear()
            new = sorted({m for t in texts for m in CANDIDATE.findall(t)})
        self.update(zip(new, formats.likely(new), strict=True))


def all_spans(text: str, formats: Formats | None, known: _Known | None = None) -> list[tuple[int, int, str]]:
    """Base spans and those that the formats add outside them."""
    base = [s[:3] for s in base_spans(text)]
    if formats is None or not formats.scorers:
        return base
    if known is None:
        known = _Known()
        known.learn([text], formats)
    if not any(map(known.__getitem__, CANDIDATE.findall(text))):
        return base
    out, starts, reach = list(base), [s for s, _, _ in base], [0]
    for _, e, _ in base:
        reach.append(max(reach[-1], e))
    for m in CANDIDATE.finditer(text):
        # of the base spans that start before its end, does one reach beyond its start?
        if known[m[0]] and reach[bisect_left(starts, m.end())] <= m.start():
            out.append((m.start(), m.end(), "format"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def learn(docs: DataFrame, max_values: int = MAX_VALUES) -> Formats:
    """Infer the formats from the values that the base rules label in all ``docs``.

    All texts are scanned and all their letter pairs counted; a kind's automaton sees at most about
    ``max_values`` distinct values, those of the least hash, up to their first MAX_LETTERS letters; at
    most a few thousand rows of so many letters and the counts of letter pairs of ASCII come to the driver.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        pairs = np.zeros(1 << 14, np.int64)
        for batch in batches:
            texts = [t for t in batch.column("text").to_pylist() if t]
            for t in texts:
                for _, _, kind, value in base_spans(t):
                    found[kind, value[:MAX_LETTERS]] += 1
            raw = np.frombuffer("\n".join(texts).encode("utf-8", "replace"), np.uint8)
            raw = np.where((raw >= 128) | (raw <= 32), 10, raw).astype(np.int64)
            if len(raw) > 1:
                pairs += np.bincount(raw[:-1] << 7 | raw[1:], minlength=1 << 14)
            if len(found) > 50_000:
                yield from rows(found, np.zeros(0, np.int64))
                found.clear()
        yield from rows(found, pairs)

    def rows(found: Counter, pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(pairs)
        kinds = [k for k, _ in found] + ["pair"] * len(at)
        values = [v for _, v in found] + [chr(i >> 7) + chr(i & 127) for i in at.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array([*found.values(), *pairs[at].tolist()], pa.int64())], ["kind", "value", "times"])

    counted = cut(docs.select("text").mapInArrow(run, "kind string, value string, times long").groupBy("kind", "value").agg(F.sum("times").alias("times")))
    sizes = {r.kind: r.n for r in counted.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for kind, n in sizes.items():
        share = F.when(F.col("kind") == kind, F.lit(1.0 if kind == "pair" else min(1.0, max_values / n))).otherwise(share)
    drawn = counted.where(F.pmod(F.xxhash64("value"), F.lit(1 << 30)) < share * F.lit(float(1 << 30)))
    got = [(r.kind, r.value, r.times) for r in drawn.collect()]
    return infer([r for r in got if r[0] != "pair"], {v: n for k, v, n in got if k == "pair"})


def scan(docs: DataFrame, formats: Formats | None, redact: bool = False) -> DataFrame:
    """``docs`` with ``spans`` (array of start, end, kind); with ``redact`` the text has [REDACTED] in their place."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(formats)
    docs = docs.drop("spans")
    names, kind = list(docs.columns), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def clean(text: str, spans: list[tuple[int, int, str]]) -> str:
        parts, at = [], 0
        for s, e, _ in spans:
            if s >= at:
                parts += [text[at:s], "[REDACTED]"]
            at = max(at, e)
        return "".join([*parts, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, told = _Known(), shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if told is not None and told.scorers:
                known.learn([t for t in texts if t], told)
            spans = [all_spans(t, told, known) if t else [] for t in texts]
            columns = dict(zip(names, batch.columns, strict=True))
            if redact:
                columns["text"] = pa.array([clean(t, s) if s else t for t, s in zip(texts, spans, strict=True)], pa.string())
            rows = [[{"start": s, "end": e, "kind": k} for s, e, k in x] for x in spans]
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(rows, kind)], [*names, "spans"])

    extra = _parse_datatype_string("spans array<struct<start:int,end:int,kind:string>>")
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *extra.fields]))
