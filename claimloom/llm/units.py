"""Texts cut into units that tokenizers encode independently, so that each distinct unit is encoded once a worker.

The byte-level pre-token pattern starts a new pre-token at every space before a sign that is not white
space, and no piece of a piece vocabulary holds its space mark behind another sign. So a text may be cut
before such a space if the sign in front of it is not a space either. What cannot be cut there stays glued.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Callable

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

#: Units a worker remembers in each of two generations, and the longest of them.
KEPT = 1 << 17
KEPT_LENGTH = 64
#: Units for the faster of two equal encoders: not too long, of scripts whose signs every table knows, without a space at the end.
FAST_LENGTH = 1 << 14
USUAL = re.compile(r"[!-~\u00a1-\u052f][\x00-\u052f]{0,%d}(?<! )" % FAST_LENGTH).fullmatch


def starts_unit(part: str) -> bool:
    """Whether a cut before a space and ``part`` is safe: it begins with a sign that no table counts as white space."""
    return part[:1].isalnum() or bool(part) and unicodedata.category(part[0])[0] in "LMNPS"


def glued(parts: list[str], starts_unit: Callable[[str], bool] = starts_unit) -> list[str]:
    """Units of a text split at every space: parts that cannot start a unit are put back behind the one before."""
    starts = [0, *(i for i in range(1, len(parts)) if parts[i - 1] and starts_unit(parts[i]))]
    return [" ".join(parts[a:b]) for a, b in zip(starts, [*starts[1:], len(parts)])]


class Memory:
    """Encoded units of texts: new ones are encoded together, and those met lately are remembered.

    ``encode`` takes units and gives their values, each for a space and the unit. Units are kept in two
    generations of about ``KEPT`` entries each.
    """

    def __init__(self, encode: Callable[[list[str]], list], starts_unit: Callable[[str], bool] = starts_unit):
        self.encode, self.starts_unit = encode, starts_unit
        self.new: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def _learn(self, wanted: set[str]) -> list[str]:
        """Make the values of all ``wanted`` units known; returns those that are too long to be kept."""
        if len(self.new) > KEPT:
            self.old, self.new = self.new, {}
        fresh = wanted.difference(self.new)
        again = fresh.intersection(self.old)
        self.new.update(zip(again, map(self.old.__getitem__, again)))
        fresh -= again
        units = [u for u in fresh if self.starts_unit(u)]
        self.new.update(zip(units, self.encode(units)))
        self.new.update(dict.fromkeys(fresh.difference(units)))
        return [u for u in fresh if len(u) > KEPT_LENGTH]

    def of(self, texts: list[list[str]]) -> list[list]:
        """The values of the units of each text, given as its parts between spaces; None for what starts no unit."""
        long = self._learn(set().union(*texts))
        found = [list(map(self.new.__getitem__, parts)) for parts in texts]
        for unit in long:
            del self.new[unit]
        return found


def split_at(ids: np.ndarray, lengths: np.ndarray, sizes: list[int]) -> list[bytes] | None:
    """``ids`` cut where the bytes of tokens reach the sums of ``sizes``; None if they do not."""
    ends, wanted = np.cumsum(lengths[ids]), np.cumsum(sizes)
    cuts = np.searchsorted(ends, wanted)
    if len(wanted) and (cuts[-1] != len(ends) - 1 or not np.array_equal(ends[cuts], wanted)):
        return None
    raw, width = ids.tobytes(), ids.itemsize
    stops = ((cuts + 1) * width).tolist()
    return [raw[a:b] for a, b in zip([0, *stops], stops)]


class ByteLevel:
    """Ids of a byte-level BPE vocabulary in the ``tokenizers`` format.

    Where its ids are the ranks of its merges, which is tested, usual units go through a faster encoder of the
    same merges; all others, and every vocabulary that is different, through ``tokenizers`` itself.
    """

    def __init__(self, vocabulary: str, plain_specials: bool):
        self.whole = Tokenizer.from_str(vocabulary)
        self.whole.encode_special_tokens = plain_specials
        described = json.loads(vocabulary)
        self.specials = [] if plain_specials else [t["content"] for t in described.get("added_tokens", [])]
        self.raw = entry_bytes(described["model"]["vocab"])
        self.lengths = np.zeros(self.whole.get_vocab_size(), np.int64)
        self.lengths[list(self.raw)] = [len(x) for x in self.raw.values()]
        self.fast = _same_merges(described["model"], self.raw)

    def usual(self, units: list[str]) -> list[str]:
        """Those of ``units`` that the faster encoder may encode, all together."""
        usual = [u for u in units if USUAL(u)] if self.fast else []
        text = " ".join(usual)
        return [u for u in usual if not any(s in u for s in self.specials)] if any(s in text for s in self.specials) else usual

    def encode(self, text: str) -> bytes:
        """Ids of one text, as 32-bit numbers."""
        return array("i", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def together(self, usual: list[str], sizes: list[int]) -> list[bytes]:
        """Ids of a space and each of units that :meth:`usual` let through; ``sizes`` are their bytes, space included."""
        ids = np.array(self.fast.encode_ordinary(f" {' '.join(usual)}") if usual else [], np.int32)
        return split_at(ids, self.lengths, sizes) or [self.encode(f" {u}") for u in usual]

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Ids of a space and each unit, as 32-bit numbers."""
        usual = self.usual(units)
        found = self.together(usual, [len(u.encode()) + 1 for u in usual])
        if len(usual) == len(units):
            return found
        done = dict(zip(usual, found))
        return [done[u] if u in done else self.encode(f" {u}") for u in units]

    def starts_unit(self, part: str) -> bool:
        """As the function of that name; a special token also ends what stands before it."""
        return starts_unit(part) and not any(part.startswith(s) for s in self.specials)


def entry_bytes(vocabulary: dict[str, int]) -> dict[int, bytes]:
    """The bytes of each entry: a sign of an entry stands for a byte, printable ones for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}
    return {i: bytes(byte[c] for c in entry) for entry, i in vocabulary.items() if all(c in byte for c in entry)}


def _same_merges(model: dict, raw: dict[int, bytes]) -> tiktoken.Encoding | None:
    """An encoder by ranks, if joining by least id is the same as joining in the order of the merges."""
    vocab = model["vocab"]
    made = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    in_order = None not in made and made == sorted(set(made)) and len(raw) == len(vocab) == len(made) + 256
    if not in_order:
        return None
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in raw.items()}, special_tokens={})
