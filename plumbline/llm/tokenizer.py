"""Tokenizer access: texts are cut at spaces and line ends, and the ids of the pieces are kept in bounded worker caches.

The tokenizer lower-cases and composes within a piece, drops white space and never joins across it, so the ids of a text are
the ids of its pieces in order. Pieces are cut only at space, tab, carriage return and line feed; other white space stays
inside a piece and is left to the tokenizer.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

#: Entries of a worker's cache before it starts anew.
CACHE = 800_000
#: Longer pieces are encoded one by one, the others in runs of RUN with a rare control character between.
LONG, RUN, SEPARATOR = 80, 256, "\x01"
#: Stands for the end id behind a text; holds a space, so it is no piece.
END = " end"
#: A run of signs between a letter or digit and a space; one word of lower-case Latin-1 letters.
_SIGNS = re.compile(r"[!-/:-@\[-`{-~](?<=[a-z0-9ß-öø-ÿ].)[!-/:-@\[-`{-~]*(?= )")
_WORD = re.compile(r"[a-zß-öø-ÿ]+")
_CUTS = str.maketrans("\n\t\r", "   ")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _letters() -> dict[int, str]:
    """The letters of ``_WORD`` as byte-level vocabularies write them."""
    from tokenizers.pre_tokenizers import ByteLevel

    signs = ByteLevel(add_prefix_space=False, use_regex=False)
    return {c: signs.pre_tokenize_str(chr(c))[0][0] for c in range(0x61, 0x100) if _WORD.fullmatch(chr(c))}


def pieces(text: str) -> list[str]:
    """The pieces of a text, in order; pieces may be empty.

    Texts of Latin-1 characters hold no combining marks, so lower-casing them first is safe (but for special strings, which
    are matched as they stand), and so is parting the signs at the end of a piece from the letter before: fewer pieces differ.
    """
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
    if "<|" in text:
        return text.translate(_CUTS).split(" ")
    return _SIGNS.sub(r" \g<0>", text.lower().replace("\n", " ").replace("\t", " ").replace("\r", " ")).split(" ")


class Pieces(dict):
    """Numbers of pieces, their lengths in ids and, where ``keep``, the ids: a cache that starts anew beyond CACHE entries.

    Unknown pieces of a batch get numbers first and are encoded together afterwards, in runs with a separator between. A word
    of plain letters, which the tokenizer leaves whole, goes to its model at once.
    """

    def __init__(self, path: str, keep: bool, frequent: dict[str, int] | None = None):
        super().__init__()
        self.tokenizer, self.keep, self.frequent = load(path), keep, frequent or {}
        self.mark = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids
        self.model, self.letters = self.tokenizer.model, _letters()
        self.direct = self._takes_words()
        self.renew(0)

    def word(self, piece: str) -> list[int]:
        return [token.id for token in self.model.tokenize(piece if piece.isascii() else piece.translate(self.letters))]

    def _takes_words(self) -> bool:
        """Whether the model alone gives the tokenizer's ids for words of the letters that ``word`` is used for."""
        alphabet = "".join(map(chr, self.letters))
        probes = [*alphabet, *(a + b for a, b in zip(alphabet, alphabet[7:])), alphabet, alphabet[::-1]]
        return all(self.word(p) == self.tokenizer.encode(p, add_special_tokens=False).ids for p in probes)

    def renew(self, limit: int = CACHE) -> None:
        if len(self) > limit + len(self.frequent) or not limit:
            self.clear()
            self.update(zip(self.frequent, range(len(self.frequent))))
            self.sizes, self.pool, self.new = array("q", self.frequent.values()), array("I"), []
            self[""]
            self.settle()

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self.sizes) + len(self.new)
        self.new.append(piece)
        return number

    def add(self, ids) -> None:
        self.sizes.append(len(ids))
        if self.keep:
            self.pool.extend(ids)

    def settle(self) -> None:
        """Encodes the new pieces, in the order of their numbers."""
        found: list = [None] * len(self.new)
        others = []
        for i, p in enumerate(self.new):
            if self.direct and len(p) <= LONG and _WORD.fullmatch(p):
                found[i] = self.word(p)
            elif len(p) <= LONG and SEPARATOR not in p:
                others.append(i)
            else:
                found[i] = self.tokenizer.encode(p, add_special_tokens=False).ids
        for at in range(0, len(others), RUN):
            run = others[at:at + RUN]
            for i, ids in zip(run, self._run([self.new[i] for i in run])):
                found[i] = ids
        for ids in found:
            self.add(ids)
        self.new = []

    def _run(self, run: list[str]) -> list[list[int]]:
        """The ids of pieces without the separator, encoded as one text."""
        ids = self.tokenizer.encode(f" {SEPARATOR} ".join(run), add_special_tokens=False).ids
        if len(self.mark) == 1 and ids.count(self.mark[0]) == len(run) - 1:
            cuts = [-1, *(i for i, n in enumerate(ids) if n == self.mark[0]), len(ids)]
            return [ids[a + 1:b] for a, b in zip(cuts, cuts[1:])]
        return [self.tokenizer.encode(p, add_special_tokens=False).ids for p in run]

    def numbers(self, texts: list[str], *end: str) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all pieces of the texts, each text followed by ``end``, and the pieces per text."""
        parts, counts = [], np.empty(len(texts), np.int64)
        for i, text in enumerate(texts):
            found = pieces(text)
            found += end
            counts[i] = len(found)
            parts.append(np.fromiter(map(self.__getitem__, found), np.int32, len(found)))
        self.settle()
        return np.concatenate(parts) if parts else np.empty(0, np.int32), counts

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Ids per text."""
        self.renew()
        picked, counts = self.numbers(texts)
        return np.add.reduceat(np.array(self.sizes)[picked], np.cumsum(counts) - counts) if len(texts) else counts


class Ids(Pieces):
    """As Pieces, with the ids of whole texts."""

    def __init__(self, path: str):
        super().__init__(path, True)

    def rows(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, each text followed by ``end``, and the number of ids per text."""
        self.renew()
        if END not in self:
            self[END] = len(self.sizes)
            self.add([end])
        picked, counts = self.numbers(texts, END)
        if not len(picked):
            return np.empty(0, np.uint32), counts
        all_sizes, pool = np.array(self.sizes), np.array(self.pool, np.uint32)
        sizes = all_sizes[picked]
        starts = (np.cumsum(all_sizes) - all_sizes)[picked]
        ids = pool[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
        return ids, np.add.reduceat(sizes, np.cumsum(counts) - counts)
