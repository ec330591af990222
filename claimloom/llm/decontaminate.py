"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The automaton holds every run of words of every item. A document's words are streamed through it; after
each word the state and the length tell the longest run that ends here and lies in some item. Where that
length reaches the window, or the run ends with a whole item shorter than the window, those words are hit.

Words are runs of characters other than ASCII punctuation, spaces and controls, after lower-casing A-Z.
In UTF-8 every byte of a non-ASCII character is above 0x7F, so this is done on bytes by one translation
and one split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import beside, changed, free_name, with_id

WINDOW = 10
MAX_COVERAGE = 0.5
#: Words of test items in one automaton; a larger benchmark gets several, walked one after another.
BLOCK_WORDS = 500_000
SLICE = 512

_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Automaton:
    """Suffix automaton of several word sequences with the items of each window at its states."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        #: (length of the run, items) that end in a state; a state's runs share their ends.
        self.ends: list[list[tuple[int, list[int]]]] = [[] for _ in self.next]
        self.names = [name for name, words in items if words]
        at: dict[tuple[int, int], set[int]] = {}
        for n, words in enumerate(w for _, w in items if w):
            size = min(window, len(words))
            state, length = 0, 0
            for word in words:
                state, length = self.step(state, length, word)
                while self.length[self.link[state]] >= size:
                    state = self.link[state]
                length = min(length, self.length[state])
                if length >= size:
                    at.setdefault((state, size), set()).add(n)
        for (state, size), found in at.items():
            self.ends[state].append((size, sorted(found)))
        # What ends in a shorter run at the end of a state's runs ends in the state too.
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            above = self.link[state]
            if above > 0 and self.ends[above]:
                self.ends[state] = self.ends[state] + self.ends[above]

    def _extend(self, last: int, word: bytes) -> int:
        there = self.next[last].get(word)
        if there is not None:
            if self.length[there] == self.length[last] + 1:
                return there
            return self._clone(last, word, there)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, word, q)
        return new

    def _clone(self, p: int, word: bytes, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _state(self, length: int, following: dict[bytes, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def step(self, state: int, length: int, word: bytes) -> tuple[int, int]:
        """State and length of the longest run that ends with ``word``."""
        there = self.next[state].get(word)
        while there is None and state:
            state = self.link[state]
            length = self.length[state]
            there = self.next[state].get(word)
        return (0, 0) if there is None else (there, length + 1)

    def hits(self, words: list[bytes], spans: list[tuple[int, int]], found: set[int]) -> None:
        """Add the hit runs of ``words`` as [first, end) and the numbers of the items they come from."""
        following, ends = self.next, self.ends
        state = length = 0
        for i, word in enumerate(words):
            there = following[state].get(word)
            if there is None:
                if not state:
                    continue
                state, length = self.step(state, length, word)
                if not state:
                    continue
            else:
                state = there
                length += 1
            for size, numbers in ends[state]:
                if length >= size:
                    spans.append((i + 1 - size, i + 1))
                    found.update(numbers)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [(a, b) for a, b in out]


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the characters from the first to the last word of each span."""
    raw = text.encode("utf-8", "surrogatepass")
    folded = raw.translate(_FOLD)
    starts, stops, at = [], [], 0
    for word in folded.split():
        at = folded.index(word, at)
        starts.append(at)
        at += len(word)
        stops.append(at)
    kept, at = [], 0
    for first, end in spans:
        kept.append(raw[at : starts[first]])
        at = stops[end - 1]
    return b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")


def _blocks(items: DataFrame, id_col: str, text_col: str, window: int) -> list[Automaton]:
    """Automata over the items by id. Test items are a stated set; ids that repeat count as one item each."""
    blocks: list[list] = [[]]
    size = 0
    chosen = items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    for row in chosen.filter(F.col("t").isNotNull()).orderBy("i", "t").toLocalIterator():
        words = words_of(row["t"])
        if not words:
            continue
        if size and size + len(words) > BLOCK_WORDS:
            blocks.append([])
            size = 0
        blocks[-1].append((row["i"] or "", words))
        size += len(words)
    return [Automaton(b, window) for b in blocks if b]


_SCHEMA = "n_words long, n_hit long, hits array<struct<first:int,end:int>>, items array<string>"


def matches(texts: list, blocks: list[Automaton]) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
    """Number of words, hit word spans and ids of the items hit, of each text."""
    words = [words_of(t) for t in texts]
    spans: list[list] = [[] for _ in texts]
    names: list[set] = [set() for _ in texts]
    for automaton in blocks:
        for w, s, k in zip(words, spans, names):
            found: set[int] = set()
            automaton.hits(w, s, found)
            k.update(automaton.names[n] for n in found)
    return [len(w) for w in words], [merged(s) for s in spans], names


def scan(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Hit words of every row of ``docs``: row_id, n_words, n_hit, hits (word spans), items.

    ``items`` are distinct item ids as strings, sorted. Null and wordless texts have no words and no hits; an
    item with fewer words than the window must occur whole; null and wordless items never occur. Repeated rows
    come out each; an empty benchmark hits nothing. Only id and text are read, so other names cannot clash.
    """
    context = docs.sparkSession.sparkContext
    shared = [context.broadcast(a) for a in _blocks(items, item_id, item_text, window)]
    rows = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text"))
    hit = pa.struct([("first", pa.int32()), ("end", pa.int32())])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [block.value for block in shared]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                n_words, joined, names = matches(part.column("text").to_pylist(), blocks)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row_id"),
                        pa.array(n_words, pa.int64()),
                        pa.array([sum(b - a for a, b in s) for s in joined], pa.int64()),
                        pa.array([[{"first": a, "end": b} for a, b in s] for s in joined], pa.list_(hit)),
                        pa.array([sorted(k) for k in names], pa.list_(pa.string())),
                    ],
                    ["row_id", "n_words", "n_hit", "hits", "items"],
                )

    return rows.mapInArrow(match, with_id(docs, id_col, "row_id", _SCHEMA))


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``docs`` without benchmark spans, and without documents of which they cover over ``max_coverage``.

    The columns stay as they are; ``n_chars``, where there is one, follows a text that changes. Rows whose text
    is null, empty or without a hit stay as they are, repeated ones too; an empty table or benchmark changes
    nothing; texts of any length are read whole, and no name of a column can clash.
    """
    context = docs.sparkSession.sparkContext
    shared = [context.broadcast(a) for a in _blocks(items, item_id, item_text, window)]
    found = pa.struct([("kept", pa.bool_()), ("text", pa.string())])

    def work(texts: list, _: list) -> pa.Array:
        n_words, joined, _names = matches(texts, [block.value for block in shared])
        made = [
            {"kept": sum(b - a for a, b in s) <= n * max_coverage, "text": without(t, s) if s else None}
            for t, n, s in zip(texts, n_words, joined)
        ]
        return pa.array(made, found)

    name = free_name(docs, "found")
    done = beside(docs, work, "kept boolean, text string", [F.col(f"`{text_col}`")], name).filter(F.col(name)["kept"])
    return changed(done, F.col(name)["text"], docs, text_col)
