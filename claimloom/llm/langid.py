"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram's vector binds its letters by multiplication, each
letter's vector first rotated by its place. A text's vector bundles (adds) its n-grams, a language's
prototype adds the unit vectors of its documents, and a text gets the language of the greatest cosine.

Letters are folded to a small alphabet by one table lookup on code points; runs of other characters count
as one space. A batch of texts is bundled by one matrix product: counts of its distinct n-grams times their
vectors. Prototypes are sums, so training is one pass that sends a vector for each language and task.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import with_id

DIMENSIONS = 512
GRAM = 3
#: Symbols of the folded alphabet: 0 is the gap between words, the rest are letters.
SYMBOLS = 256
UNKNOWN = "und"
#: Texts are bundled in batches of at most so many rows and about so many characters.
ROWS, CHARACTERS = 128, 1 << 19


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """Symbol of each code point: 0 for what is not a letter, else one of 1 to SYMBOLS - 1.

    Basic Latin and Latin-1 letters get symbols of their own; further letters share the rest by hash.
    """
    table = np.zeros(0x110000, np.uint8)
    own: dict[str, int] = {}
    for code in range(0x250):
        letter = chr(code)
        low = letter.lower()
        if letter.isalpha() and len(low) == 1:
            if ord(low) < 0x100 and low not in own:
                own[low] = len(own) + 1
            table[code] = own.get(low, 0)
    free = SYMBOLS - 1 - len(own)
    for code in range(0x100, 0x110000):
        if table[code] == 0 and unicodedata.category(chr(code))[0] in "LM":
            low = chr(code).lower()[:1].encode("utf-8", "surrogatepass")
            table[code] = len(own) + 1 + zlib.crc32(low) % free
    return table


@lru_cache(maxsize=4)
def letter_vectors(dimensions: int = DIMENSIONS, seed: int = 7) -> np.ndarray:
    draw = np.random.default_rng(seed)
    return (draw.integers(0, 2, (SYMBOLS, dimensions), dtype=np.int8) * 2 - 1).astype(np.int8)


def gram_vectors(codes: np.ndarray, gram: int = GRAM, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Bound vectors of n-gram codes: letters rotated by their place and multiplied."""
    letters = letter_vectors(dimensions)
    out = np.ones((len(codes), dimensions), np.int8)
    for place in range(gram):
        symbol = (codes >> (8 * place)) & 0xFF
        out *= np.roll(letters, place, axis=1)[symbol]
    return out


def gram_codes(text: str, gram: int = GRAM) -> np.ndarray:
    """Codes of the letter n-grams; the text is padded with gaps so one letter has an n-gram too."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = _folding()[points]
    if not symbols.any():
        return np.zeros(0, np.int64)
    symbols = np.concatenate([[0], symbols, [0] * (gram - 1)]).astype(np.int64)
    symbols = symbols[np.concatenate([[True], (symbols[1:] != 0) | (symbols[:-1] != 0)])]
    symbols = np.concatenate([symbols, np.zeros(max(0, gram - len(symbols)), np.int64)])
    n = len(symbols) - gram + 1
    codes = np.zeros(n, np.int64)
    for place in range(gram):
        codes |= symbols[place : place + n] << (8 * (gram - 1 - place))
    return codes


class Bundler:
    """Bundles batches of texts; keeps the vectors of the n-grams met lately."""

    KEPT = 1 << 14

    def __init__(self, gram: int = GRAM, dimensions: int = DIMENSIONS):
        self.gram, self.dimensions = gram, dimensions
        self.row = np.full(1 << (8 * gram), -1, np.int32)
        self._clear()

    def _clear(self) -> None:
        self.row[:] = -1
        self.vectors = np.zeros((self.KEPT, self.dimensions), np.float32)
        self.n = 0

    def _learn(self, fresh: np.ndarray) -> None:
        self.vectors[self.n : self.n + len(fresh)] = gram_vectors(fresh, self.gram, self.dimensions)
        self.row[fresh] = np.arange(self.n, self.n + len(fresh))
        self.n += len(fresh)

    def bundle(self, texts: list[str]) -> np.ndarray:
        """One vector for each text; texts without letters get zeros."""
        out = np.zeros((len(texts), self.dimensions), np.float64)
        owners: list[np.ndarray] = []
        codes: list[np.ndarray] = []
        held = 0
        for n, text in enumerate(texts):
            found = gram_codes(text, self.gram)
            for at in range(0, len(found), CHARACTERS):
                piece = found[at : at + CHARACTERS]
                if held + len(piece) > CHARACTERS:
                    self._add(out, np.concatenate(owners), np.concatenate(codes))
                    owners, codes, held = [], [], 0
                owners.append(np.full(len(piece), n))
                codes.append(piece)
                held += len(piece)
        if held:
            self._add(out, np.concatenate(owners), np.concatenate(codes))
        return out

    def _add(self, out: np.ndarray, owners: np.ndarray, codes: np.ndarray) -> None:
        fresh = np.unique(codes[self.row[codes] < 0])
        if self.n + len(fresh) > self.KEPT:
            self._clear()
            fresh = np.unique(codes)
        if len(fresh) > self.KEPT:
            for at in range(0, len(fresh), self.KEPT):
                low, high = fresh[at], fresh[min(at + self.KEPT, len(fresh)) - 1]
                some = (codes >= low) & (codes <= high)
                self._add(out, owners[some], codes[some])
            return
        self._learn(fresh)
        first, last = owners[0], owners[-1] + 1
        cells = (owners - first) * self.n + self.row[codes]
        counts = np.bincount(cells, minlength=(last - first) * self.n).reshape(last - first, self.n)
        out[first:last] += counts.astype(np.float32) @ self.vectors[: self.n]


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Prototypes from every row with a language and a letter, sorted by language.

    What comes to the driver is one sum for each language and dimension.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler, totals = Bundler(), {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            texts = batch.column("text").to_pylist()
            for at in range(0, len(texts), ROWS):
                units = _unit(bundler.bundle(texts[at : at + ROWS]))
                for lang, unit in zip(langs[at : at + ROWS], units):
                    totals[lang] = totals.get(lang, 0) + unit
        for lang, total in totals.items():
            # Whole numbers add up alike in any order.
            whole = np.rint(total * (1 << 20)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(whole)), pa.array(np.arange(len(whole), dtype=np.int32)), pa.array(whole)],
                ["lang", "place", "value"],
            )

    labelled = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).dropna()
    summed = labelled.mapInArrow(sums, "lang string, place int, value long").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    found: dict[str, np.ndarray] = {}
    for row in summed.toLocalIterator():
        found.setdefault(row["lang"], np.zeros(DIMENSIONS))[row["place"]] = row["value"]
    langs = sorted(lang for lang, vector in found.items() if vector.any())
    return langs, _unit(np.array([found[lang] for lang in langs]).reshape(len(langs), DIMENSIONS))


def predict(
    docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, lang_pred, score (cosine, 0 to 1) for each row of ``docs``.

    Null, empty and letterless texts, and all texts where nothing was learned, get ``und`` and 0. Of equal
    cosines the first language by name wins. Whole texts are read; repeated rows come out each; columns
    other than id and text are not read.
    """
    langs, prototypes = model
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler = Bundler()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = part.column("text").to_pylist()
                units = _unit(bundler.bundle(texts))
                # Marks are symbols of n-grams too, but alone they are no letter.
                lettered = np.array([any(map(str.isalpha, t)) for t in texts], bool)
                known = units.any(axis=1) & lettered & bool(langs)
                cosines = units @ prototypes.T if langs else np.zeros((len(units), 1))
                best = cosines.argmax(axis=1)
                names = [langs[b] if k else UNKNOWN for b, k in zip(best, known)]
                scores = np.where(known, np.clip(cosines.max(axis=1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"]
                )

    return rows.mapInArrow(score, with_id(docs, id_col, "doc_id", "lang_pred string, score double"))
