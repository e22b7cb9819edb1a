"""Benchmark decontamination by pigeonhole edit matching.

Test items and texts are lower-cased and every run of anything but letters and digits becomes one space. An
item of m characters may be found with up to k = floor(rate * m) edits; it is cut into k + 1 pieces, of which
one must occur unchanged in any such match (pigeonhole). An automaton finds all pieces in one pass over a
text; around each hit Myers' bit-parallel algorithm searches the whole item within k edits. An item of fewer
than `short` characters is found unchanged and between word borders only (scripts without spaces between
words have a border at every character).

Items reach the executors in slices of at most `slice_chars` characters, one pass for each slice; a test set
of any size works, and what is broadcast stays bounded.

Cases: null and blank texts match nothing; null items and those without a letter or digit have nothing to be
found; items with a null id are searched like any other (item_id is then null); an id that repeats gives
rows for each of its rows; repeated items are found each under its id; no items or no rows give no rows;
extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import settle
from quern.ship import ship

GAP = re.compile(r"(?: *(?:[^\w ]|_)(?:\W|_)*| {2,})")


@dataclass(frozen=True)
class DecontamParams:
    rate: float = 0.07  # edits an item character
    short: int = 24  # items of fewer characters are matched exactly, as whole words
    slice_chars: int = 2_000_000


def normalise(text: str) -> str:
    return GAP.sub(" ", text.lower()).strip(" ")


def offsets(text: str) -> tuple[str, list[int]]:
    """normalise(text) and, for each of its characters, the place of its origin in text."""
    out, at = [], []
    gap = -1
    for i, c in enumerate(text):
        for x in c.lower():
            if x == "_" or not re.match(r"\w", x):
                gap = i if gap < 0 else gap
            else:
                if gap >= 0 and out:
                    out.append(" ")
                    at.append(gap)
                gap = -1
                out.append(x)
                at.append(i)
    return "".join(out), at


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 consecutive pieces that cover the item, as equal as can be: (offset, piece)."""
    n, m = k + 1, len(item)
    cuts = [m * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _spaceless(c: str) -> bool:
    """Of a script that sets no space between words: Thai to Khmer, kana, ideographs and beyond."""
    return "\u0e00" <= c <= "\u0eff" or "\u1000" <= c <= "\u109f" or "\u1780" <= c <= "\u17ff" or "\u2e80" <= c <= "\ua4cf" or "\uf900" <= c <= "\ufaff" or c >= "\U00020000"


def borders(text: str, start: int, end: int) -> bool:
    """text[start:end] begins and ends at word borders of a normalised text."""
    free = lambda i: not 0 < i < len(text) or " " in text[i - 1 : i + 1] or _spaceless(text[i - 1]) or _spaceless(text[i])
    return free(start) and free(end)


class Pattern:
    """Myers' algorithm with the pattern in one big integer."""

    def __init__(self, item: str, k: int):
        self.item, self.m, self.k = item, len(item), k
        self.full, self.last = (1 << len(item)) - 1, 1 << (len(item) - 1)
        self.masks = self._masks(item)
        self.back = None

    @staticmethod
    def _masks(item: str) -> dict[str, int]:
        masks: dict[str, int] = {}
        for i, c in enumerate(item):
            masks[c] = masks.get(c, 0) | (1 << i)
        return masks

    def _scan(self, masks: dict[str, int], text: str, anchored: bool) -> Iterator[int]:
        """Distance of the pattern to the best substring ending at each character (anchored: to the prefix)."""
        pv, mv, score, full, last = self.full, 0, self.m, self.full, self.last
        for c in text:
            eq = masks.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (~(xh | pv) & full)
            mh = pv & xh
            if ph & last:
                score += 1
            elif mh & last:
                score -= 1
            ph = ((ph << 1) | (1 if anchored else 0)) & full
            mh = (mh << 1) & full
            pv = mh | (~(xv | ph) & full)
            mv = ph & xv
            yield score

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, distance) of matches that don't overlap, each with the least distance around."""
        out: list[tuple[int, int, int]] = []
        best: tuple[int, int] | None = None
        for i, d in enumerate(self._scan(self.masks, text, False)):
            if best and i - best[1] >= self.m:
                out.append(self._whole(text, best))
                best = None
            if d <= self.k and (best is None or d < best[0]):
                best = d, i
        if best:
            out.append(self._whole(text, best))
        return out

    def _whole(self, text: str, best: tuple[int, int]) -> tuple[int, int, int]:
        d, last = best
        if self.back is None:
            self.back = self._masks(self.item[::-1])
        tail = text[max(0, last + 1 - self.m - self.k) : last + 1][::-1]
        for n, x in enumerate(self._scan(self.back, tail, True)):
            if x == d:
                return last - n, last + 1, d
        raise AssertionError("a match has a start")


class Matcher:
    def __init__(self, items: list[tuple[int | None, str]], p: DecontamParams):
        import ahocorasick

        self.short = p.short
        self.patterns: dict[str, tuple[Pattern, list[int | None]]] = {}
        for item_id, text in items:
            if item := normalise(text):
                edits = int(p.rate * len(item)) if len(item) >= p.short else 0
                self.patterns.setdefault(item, (Pattern(item, edits), []))[1].append(item_id)
        where: dict[str, list[tuple[str, int]]] = {}
        for item, (pattern, _) in self.patterns.items():
            for at, piece in pieces(item, pattern.k):
                where.setdefault(piece, []).append((item, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def find(self, raw: str) -> list[tuple[int | None, int, int, int]]:
        """(item id, start, end, distance) of matches in the raw text, by place, in code points."""
        if not self.patterns:
            return []
        text = normalise(raw)
        windows: dict[str, list[list[int]]] = {}
        whole_words: dict[str, list[int]] = {}
        for end, (n, places) in self.automaton.iter(text):
            for item, at in places:
                pattern = self.patterns[item][0]
                if pattern.m < self.short:  # its one piece is the item itself
                    mine = whole_words.setdefault(item, [])
                    if borders(text, end + 1 - n, end + 1) and (not mine or mine[-1] <= end + 1 - n):
                        mine.append(end + 1)
                    continue
                lo = max(0, end + 1 - n - at - pattern.k)
                hi = end + 1 - n - at + pattern.m + pattern.k
                mine = windows.setdefault(item, [])
                if mine and lo <= mine[-1][1]:
                    mine[-1][0], mine[-1][1] = min(lo, mine[-1][0]), max(hi, mine[-1][1])
                else:
                    mine.append([lo, hi])
        out = []
        origin = offsets(raw)[1] if any(whole_words.values()) else None
        for item, ends in whole_words.items():
            pattern, ids = self.patterns[item]
            out += [(i, origin[e - pattern.m], origin[e - 1] + 1, 0) for e in ends for i in ids]
        for item, spans in windows.items():
            pattern, ids = self.patterns[item]
            spans.sort()
            whole = [spans[0]]
            for lo, hi in spans[1:]:
                if lo <= whole[-1][1]:
                    whole[-1][1] = max(hi, whole[-1][1])
                else:
                    whole.append([lo, hi])
            for lo, hi in whole:
                for a, b, d in pattern.find(text[lo:hi]):
                    if origin is None:
                        origin = offsets(raw)[1]
                    out += [(i, origin[lo + a], origin[lo + b - 1] + 1, d) for i in ids]
        return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0, *x[1:]))


def _slices(items: DataFrame, p: DecontamParams, item_key: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The items, at most about slice_chars characters at a time."""
    known = items.select(F.col(item_key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("text is not null")
    total = known.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // p.slice_chars))
    for i in range(n):
        part = [(r["id"], r["text"]) for r in known.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i).collect()]
        yield sorted(part, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def find_leaks(docs: DataFrame, items: DataFrame, p: DecontamParams = DecontamParams(), key: str = "doc_id", text: str = "text", item_key: str = "item_id") -> DataFrame:
    """(key, item_id, start, end, distance) of every match, places in code points of the text."""
    ship(docs.sparkSession)
    schema = pa.schema([(key, pa.int64()), (item_key, pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("distance", pa.int32())])
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    found = None
    for part in _slices(items, p, item_key, "text"):
        shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, part))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared, p)
            for b in batches:
                out = [(i.as_py(), *hit) for i, t in zip(b["id"], b["text"], strict=True) if t.is_valid for hit in matcher.find(t.as_py())]
                if out:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        one = rows.mapInArrow(run, f"{key} long, {item_key} long, start long, end long, distance int")
        found = one if found is None else found.unionByName(one)
    return found


_matchers: dict[str, Matcher] = {}


def _matcher(shared, p: DecontamParams) -> Matcher:
    """The automaton of a slice, kept by a worker until the next slice comes."""
    name, part = shared.value
    if name not in _matchers:
        _matchers.clear()
        _matchers[name] = Matcher(part, p)
    return _matchers[name]


def drop_leaks(docs: DataFrame, items: DataFrame, p: DecontamParams = DecontamParams(), text: str = "text", item_key: str = "item_id") -> DataFrame:
    """docs without the rows in which an item is found, with docs' columns: no shuffle, a pass for each slice of items.

    Between passes what is left is written, so that a task never holds more than one slice's automaton."""
    ship(docs.sparkSession)
    at = docs.columns.index(text)
    kept = docs
    for i, part in enumerate(_slices(items, p, item_key, "text")):
        kept = settle(kept, "clean") if i else kept
        shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, part))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared, p)
            for b in batches:
                ok = [not (t.is_valid and matcher.find(t.as_py())) for t in b.column(at)]
                yield b.filter(pa.array(ok, pa.bool_()))

        kept = kept.mapInArrow(run, docs.schema)
    return kept
