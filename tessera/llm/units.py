"""Text units that a BPE tokenizer encodes independently of their surroundings.

A unit starts at a single space that stands between two non-space characters (or at the start of the
text) and runs to the next such space. The pre-tokenizers of the supported kinds (byte-level BPE with a
leading space, word-end BPE that drops white space) always break there, their normalisers never look
across it, and no added token may hold white space (checked), so encoding unit by unit gives exactly
the ids of the whole text.
"""
from __future__ import annotations

import json
import os
import re

import numpy as np

# a break: one space, no white space on either side (U+180E counts as space for some regex engines)
_BREAK = re.compile(r"(?<=[^\s᠎]) (?=[^\s᠎])")
# a space that is not such a break
_ODD = re.compile(r"(?:\A|[\s᠎]) | (?:[\s᠎]|\Z)")


def first_break(text: str) -> int:
    found = _BREAK.search(text)
    return found.start() if found else -1


def last_break(text: str) -> int:
    at = text.rfind(" ")
    while at >= 0 and not _BREAK.match(text, at):
        at = text.rfind(" ", 0, at)
    return at


def split_units(text: str) -> list[str]:
    """The units of ``text``, the leading space of all but the first one taken off."""
    return _BREAK.split(text) if _ODD.search(text) else text.split(" ")


def check_tokenizer(blob: bytes) -> None:
    """Fail for a tokenizer whose added tokens could cross a unit's edge."""
    spec = json.loads(blob)
    for token in spec.get("added_tokens") or []:
        if token.get("lstrip") or token.get("rstrip") or re.search(r"\s", token["content"]):
            raise ValueError(f"added token {token['content']!r} may cross white space")
    if spec["model"]["type"] != "BPE" or spec["model"].get("dropout"):
        raise ValueError("a deterministic BPE model is needed")


def load_tokenizer(blob: bytes):
    """The tokenizer without truncation and padding, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_buffer(blob)
    tok.no_truncation()
    tok.no_padding()
    return tok


_MARK = " \x01"     # a unit of its own, put between units that are encoded together


# byte-level BPE writes bytes without a printable Latin-1 character as the characters from U+0100 on
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARS = dict(zip([b for b in range(256) if b not in set(_PRINTABLE)], range(0x100, 0x200)))


class UnitEncoder:
    """Ids of units; many units are encoded as one text, with a mark between them, and split at the marks."""

    def __init__(self, blob: bytes):
        self.tok = load_tokenizer(blob)
        self.mark = self.one(_MARK)
        # What the pre-tokenizer makes of a Latin word and of a mark after it, found by a probe; None: not one piece.
        self.lower = self._pieces("Q") == self._pieces("q")
        probe = "qjxzkwvq"
        split = self._pieces(" " + probe)
        plain = len(split) == 1 and split[0].endswith(probe) and self._pieces(" é") == [split[0][:-len(probe)] + "Ã©"]
        self.prefix = split[0][:-len(probe)] if plain else None
        self.after = {c: self.one(c) for c in ".,;:!?" if plain and self._pieces(f" {probe}{c}") == [*split, c]}

    def _pieces(self, text: str) -> list[str]:
        if self.tok.normalizer is not None:
            text = self.tok.normalizer.normalize_str(text)
        return [p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(text)]

    def one(self, unit: str) -> np.ndarray:
        return np.array(self.tok.encode(unit, add_special_tokens=False).ids, dtype="<u4")

    def word(self, piece: str) -> list[int] | None:
        """Ids of " " + a Latin word, maybe with a mark after it, straight from the BPE model; None for anything else."""
        body, end = (piece[:-1], self.after[piece[-1]]) if piece and piece[-1] in self.after else (piece, None)
        if self.prefix is None or not body.isalpha() or max(body) > "\xff":
            return None
        if self.lower:
            body = body.lower()
        if not body.isascii():
            body = body.encode().decode("latin-1").translate(_BYTE_CHARS)
        ids = [t.id for t in self.tok.model.tokenize(self.prefix + body)]
        return ids if end is None else ids + end.tolist()

    def many(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of " " + each piece."""
        out = [self.word(p) for p in pieces]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self._joined([" " + pieces[i] for i in rest])):
            out[i] = ids
        return [np.asarray(ids, dtype="<u4") for ids in out]

    def _joined(self, units: list[str]) -> list[np.ndarray]:
        if len(units) < 2 or not len(self.mark):
            return [self.one(u) for u in units]
        ids = self.one(_MARK.join(units))
        ends = np.flatnonzero(ids == self.mark[-1])
        if len(ends) != len(units) - 1:         # a unit holds the mark itself
            return [self.one(u) for u in units]
        starts, ends = [0, *(ends + 1).tolist()], [*(ends + 1 - len(self.mark)).tolist(), len(ids)]
        return [ids[i:j] for i, j in zip(starts, ends)]


class UnitCache:
    """piece (a unit without its space) -> what ``make`` turns its ids into; bounded, in two generations."""

    def __init__(self, units: UnitEncoder, make, most: int, longest: int = 200):
        self.units, self.make, self.most, self.longest = units, make, most, longest
        self.young: dict = {}
        self.old: dict = {}

    def lookup(self, pieces: list[str]):
        """Iterator of the values of ``pieces``."""
        if len(self.young) > self.most // 2:    # what is not met again in the next generation goes
            self.young, self.old = {}, self.young
        young, old, fresh = self.young, self.old, []
        for p in set(pieces).difference(young):
            if p in old:
                young[p] = old[p]
            else:
                fresh.append(p)
        if not fresh:
            return map(young.__getitem__, pieces)
        young.update(zip(fresh, map(self.make, self.units.many(fresh))))
        values = list(map(young.__getitem__, pieces))
        for p in fresh:
            if len(p) > self.longest:
                del young[p]
        return iter(values)


def tokenizer_blob(path: str, most_bytes: int = 64 << 20) -> bytes:
    """Vocabulary file for a broadcast, its size checked."""
    if os.path.getsize(path) > most_bytes:
        raise ValueError(f"{path} is larger than {most_bytes} bytes")
    with open(path, "rb") as f:
        blob = f.read()
    check_tokenizer(blob)
    return blob
