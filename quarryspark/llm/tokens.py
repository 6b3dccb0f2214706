"""Encoding texts with a public tokenizer file, each distinct piece of text once per worker.

The library encodes a whole text by normalizing it, splitting it into pre-tokens and
merging inside each of those. No pre-token of the two kinds of tokenizer below reaches
across the start of a run of blanks, so a text can be cut there, every cut-out unit
encoded by the library on its own, and the ids put together again. Units repeat a lot, so
a worker keeps what it has encoded in dictionaries of bounded size.

``blanks="leading"``: byte-level kinds, where a blank belongs to what follows. A unit is one
space or newline and the run after it. Texts with longer runs of white space, with white
space at an end or with white space of other kinds are encoded whole.
``blanks="dropped"``: kinds that drop white space. A unit is a run without space and newline.
``blanks=None``: any other kind; texts are encoded whole.
In the first two kinds letters or digits and the punctuation after them are different
pre-tokens, so punctuation at a unit's end is encoded on its own.

Added tokens such as ``<|endoftext|>`` are one id wherever a text holds their content, as by
the library's defaults. They might reach over a cut, so texts that hold one are encoded whole.
"""

from __future__ import annotations

import functools
import itertools
import re

import numpy as np

#: units a worker knows at most, about 170 bytes each; when there are more, it keeps the first
#: third of those met, which are the frequent ones
KNOWN_UNITS = 1_000_000

#: no apostrophe: it may open a pre-token with the letters after it
_PUNCTUATION = '!"#$%&()*+,-./:;<=>?@[\\]^`{|}~'
#: white space other than space and newline
_OTHER_WHITE = re.compile("[\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]").search


def uneven(t: str) -> bool:
    """Whether a cut before each space and newline might fall inside a longer run of white space."""
    return "  " in t or " \n" in t or "\n\n" in t or t[:1] in (" ", "\n") or t[-1:] in (" ", "\n") or "\0" in t or _OTHER_WHITE(t) is not None


class _Numbers(dict):
    """Numbers units as they are met; ``fresh`` are those met since it was last emptied."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, unit: str) -> int:
        n = self[unit] = len(self)
        self.fresh.append(unit)
        return n


class _Ragged:
    """Arrays of ids by number, one after another in a growing buffer."""

    def __init__(self) -> None:
        self.ids, self.start, self.length = np.empty(1 << 16, "<u4"), np.zeros(1 << 12, "int64"), np.zeros(1 << 12, "int64")
        self.used = 0

    @staticmethod
    def _room(x: np.ndarray, n: int) -> np.ndarray:
        return x if n <= len(x) else np.concatenate([x, np.zeros(max(n - len(x), len(x)), x.dtype)])

    def put(self, numbers: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.ids = self._room(self.ids, self.used + len(ids))
        self.ids[self.used : self.used + len(ids)] = ids
        most = int(numbers.max(initial=-1)) + 1
        self.start, self.length = self._room(self.start, most), self._room(self.length, most)
        self.start[numbers] = self.used + np.cumsum(lengths) - lengths
        self.length[numbers] = lengths
        self.used += len(ids)

    def get(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all numbers in their order, length of each)."""
        n = self.length[numbers]
        at = np.cumsum(n)
        return self.ids[np.arange(at[-1] if len(at) else 0) + np.repeat(self.start[numbers] - at + n, n)], n


class UnitEncoder:
    """Encodes texts to uint32 arrays of ids, the same as the library does for whole texts.

    A unit is looked up under its text; in ``leading`` mode without its space, and with a
    zero character before it where it has none (the first of a text, punctuation cut off).
    """

    def __init__(self, path: str, blanks: str | None, known_units: int = KNOWN_UNITS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # by any case, as the normalizer may change it before added tokens are looked for
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)), re.I).search if added else lambda t: None
        self.blanks, self.known_units = blanks, known_units
        self.numbers, self.known = _Numbers(), _Ragged()

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_units(self, units: list[str], numbers: list[int]) -> None:
        """Have the library encode units, many in one call."""
        if self.blanks == "leading":
            units = [u if (c := u[:1]) == "\n" else u[1:] if c == "\0" else " " + u for u in units]
        for at in range(0, len(units), 20_000):
            part = units[at : at + 20_000]
            e = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            lengths = np.bincount(np.array(e.word_ids, dtype="int64"), minlength=len(part)) if e.ids else np.zeros(len(part), "int64")
            self.known.put(np.array(numbers[at : at + 20_000], "int64"), lengths, np.array(e.ids, dtype="<u4"))

    def _learn(self) -> None:
        """Encode what is fresh; units that end in punctuation are put together from two."""
        numbers, mark, ends = self.numbers, "\0" if self.blanks == "leading" else "", []
        while numbers.fresh:
            fresh, numbers.fresh, plain, which = numbers.fresh, [], [], []
            for n, u in enumerate(fresh, len(numbers) - len(fresh)):
                stem = u.rstrip(_PUNCTUATION)
                if len(stem) < len(u) and stem[-1:].isalnum():
                    ends += (n, numbers[stem], numbers[mark + u[len(stem) :]])
                else:
                    plain.append(u)
                    which.append(n)
            self._encode_units(plain, which)
        if ends:
            e = np.array(ends, "int64").reshape(-1, 3)
            ids, n = self.known.get(e[:, 1:].ravel())
            self.known.put(e[:, 0], n.reshape(-1, 2).sum(1), ids)

    def _forget(self) -> None:
        """Keep the first units, in the order of their numbers."""
        numbers, known = _Numbers(), _Ragged()
        numbers.update(itertools.islice(self.numbers.items(), self.known_units // 3))
        first = np.arange(len(numbers))
        ids, n = self.known.get(first)
        known.put(first, n, ids)
        self.numbers, self.known = numbers, known

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.blanks is None:
            return self.whole(texts)
        if len(self.numbers) > self.known_units:
            self._forget()
        leading = self.blanks == "leading"
        # a space is put before every newline, so that a split at spaces leaves newlines with what follows
        apart = [self.added(t) is not None for t in texts]
        split = [[] if a or uneven(t) else ("\0" + t).replace("\n", " \n").split(" ") for t, a in zip(texts, apart, strict=True)] if leading else [[] if a else t.replace("\n", " ").split(" ") for t, a in zip(texts, apart, strict=True)]
        counts = np.array([len(s) for s in split], "int64")
        numbers = np.fromiter(map(self.numbers.__getitem__, itertools.chain.from_iterable(split)), "int64", int(counts.sum()))
        self._learn()
        ids, n = self.known.get(numbers)
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(counts)]
        begin, out = 0, []
        for t, s, end in zip(texts, split, ends.tolist(), strict=True):
            out.append(ids[begin:end] if s else self.whole([t])[0])
            begin = end
        return out


@functools.lru_cache(maxsize=1)
def encoder(path: str, blanks: str | None, known_units: int = KNOWN_UNITS) -> UnitEncoder:
    """This worker's encoder of a tokenizer file; it keeps the last one only."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return UnitEncoder(path, blanks, known_units)


def text_groups(texts: list[str | None], most: int = 1_000_000):
    """Ranges of ``texts`` of about ``most`` characters, so that what is held at once is bounded."""
    begin = held = 0
    for k, t in enumerate(texts):
        held += len(t or "")
        if held >= most:
            yield begin, k + 1
            begin, held = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
