"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

A row of tokens is the encoding of its text if and only if every two neighbours are compatible: no merge across their
boundary has its turn before the merges that made the two. So a word is encoded from left to right with the longest token that
starts at a place and goes with the token before it; where none goes, the last token is taken back for its next shorter one. A
place that failed once fails for good, as the tokens before a place are its prefix's only encoding, so each place is left at
most once and the work is linear in the word. All tokens that start anywhere in a word come from one pass of an Aho-Corasick
automaton over the reversed word.

A vocabulary is a ``tokenizers`` file whose words end in a suffix and which drops white space; the library normalizes and
parts the words, the merges are made here.
"""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Iterator
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import tokenizer
from plumbline.llm.common import map_arrow, text_columns, texts_of

#: A word's last symbol, which carries the suffix, as one character of the private use area.
LAST = 0xE000
#: Pieces that a task remembers, pairs of the compatibility table, and characters or ids handled at a time.
PIECES, PAIRS, CHUNK = 200_000, 1 << 19, 1 << 21


class Vocabulary:
    """Tokens, merges and the tables made of them: the automaton, the edges of each token and the compatible pairs."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        model = stated["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or not self.suffix:
            raise ValueError("the vocabulary must be a BPE model with a suffix at word ends")
        if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("the vocabulary uses a setting that is not supported")
        if stated.get("decoder"):
            raise ValueError("the vocabulary names a decoder; only joined tokens are supported")
        self.special = {t["content"]: t["id"] for t in stated["added_tokens"]}
        self.ids = {self.symbols(token): i for token, i in model["vocab"].items()}
        if any(s not in self.ids or self.ending(s) not in self.ids for s in ByteLevel.alphabet()):
            raise ValueError("the vocabulary lacks a byte")
        self.merges: dict[tuple[int, int], int] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair = (model["vocab"][left], model["vocab"][right])
            whole = model["vocab"][left + right]
            if whole in made or any(made[p][2] >= rank for p in pair if p in made):
                raise ValueError(f"merge {rank} makes a token twice or before its parts")
            made[whole], self.merges[pair] = (*pair, rank), rank
        self.right = {i: self._edge(i, made, 1) for i in self.ids.values()}
        self.left = {i: self._edge(i, made, 0) for i in self.ids.values()}
        self.pairs: dict[int, bool] = {}
        #: A token is made from its own text unless a merge across its last seam comes before its parts are made.
        self.whole = {s: i for s, i in self.ids.items() if i not in made or not self._crossed(*made[i][:2], made[i][2])}
        self.automaton = ahocorasick.Automaton()
        for symbols, i in self.whole.items():
            self.automaton.add_word(symbols[::-1], (len(symbols), i))
        self.automaton.make_automaton()

    def symbols(self, token: str) -> str:
        """A token as one character per symbol, the last marked if it ends a word."""
        if not token.endswith(self.suffix) or token == self.suffix:
            return token
        return self.ending(token[:-len(self.suffix)])

    def ending(self, word: str) -> str:
        return word[:-1] + chr(LAST + ord(word[-1]))

    @staticmethod
    def _edge(token: int, made: dict, side: int) -> list[tuple[int, float]]:
        """The tokens at one edge of a token while it is made, each with the rank of the merge that uses it up."""
        edge, until = [(token, inf)], token
        while until in made:
            part = made[until][side]
            edge.append((part, made[until][2]))
            until = part
        return edge

    def _crossed(self, first: int, second: int, before: float = inf) -> bool:
        """Whether a merge across the boundary of two tokens has its turn: where ranks are equal, the left place comes first."""
        rank_of = self.merges.get
        for a, used_a in self.right[first]:
            for b, used_b in self.left[second]:
                rank = rank_of((a, b))
                if rank is not None and rank < before and rank < used_a and rank <= used_b:
                    return True
        return False

    def compatible(self, first: int, second: int) -> bool:
        """The pair-compatibility table, filled as pairs are met and started anew beyond PAIRS."""
        key = first << 32 | second
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = not self._crossed(first, second)
        return known

    def word(self, symbols: str) -> list[int]:
        """The ids of one word, given as one character per symbol with the last one marked."""
        if symbols in self.whole:
            return [self.whole[symbols]]
        n = len(symbols)
        sizes, tokens, first = array("l"), array("l"), array("l", [0]) * (n + 1)
        place = n
        for end, (size, token) in self.automaton.iter(symbols[::-1]):  # longest first for each place, last place first
            if n - 1 - end != place:
                place = n - 1 - end
                first[place] = len(sizes)
            sizes.append(size)
            tokens.append(token)
        failed, found, tried = bytearray(n + 1), [], []
        at, option = 0, first[0]
        while at < n:
            last = first[at - 1] if at else len(sizes)  # matches are held by place, from the last place to the first
            while option < last:
                if not failed[at + sizes[option]] and (not found or self.compatible(found[-1], tokens[option])):
                    break
                option += 1
            if option < last:
                found.append(tokens[option])
                tried.append(option)
                at += sizes[option]
                option = first[at]
            else:
                failed[at] = 1
                found.pop()
                option = tried.pop()
                at -= sizes[option]
                option += 1
        return found


#: A worker keeps one vocabulary: its tables are of fixed size.
_vocabulary = functools.lru_cache(maxsize=1)(Vocabulary)


class Encoder(tokenizer.Pieces):
    """The cache of pieces, filled by the backtracking encoder."""

    def __init__(self, path: str):
        self.vocabulary = _vocabulary(path)
        self.special = re.compile("(" + "|".join(map(re.escape, self.vocabulary.special)) + ")") if self.vocabulary.special else None
        super().__init__(path, True)

    def renew(self, limit: int = PIECES) -> None:
        super().renew(limit)

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and the number of ids per text."""
        self.renew()
        picked, counts = self.numbers(texts)
        all_sizes, pool = np.array(self.sizes), np.array(self.pool, np.uint32)
        sizes = all_sizes[picked]
        starts = (np.cumsum(all_sizes) - all_sizes)[picked]
        ids = pool[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
        return ids, np.add.reduceat(sizes, np.cumsum(counts) - counts) if len(texts) else counts

    def settle(self) -> None:
        for piece in self.new:
            self.add(self.piece(piece))
        self.new = []

    def piece(self, piece: str) -> list[int]:
        """The ids of a piece of text; strings of special tokens are matched as they stand."""
        vocabulary = self.vocabulary
        if tokenizer._WORD.fullmatch(piece):  # plain letters stay as they are and make one word
            return vocabulary.word(vocabulary.ending(piece if piece.isascii() else piece.translate(self.letters)))
        found: list[int] = []
        for part in self.special.split(piece) if self.special else [piece]:
            if part in vocabulary.special:
                found.append(vocabulary.special[part])
            elif part:
                for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(part)):
                    found += vocabulary.word(vocabulary.ending(word))
        return found


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes add up to about CHUNK."""
    start = held = 0
    for i, size in enumerate(sizes):
        held += size + 1
        if held >= CHUNK or i == len(sizes) - 1:
            yield start, i + 1
            start, held = i + 1, 0


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(path)
    for batch in batches:
        texts = texts_of(batch)
        for lo, hi in _slices([len(t) for t in texts]):
            ids, counts = encoder.rows(texts[lo:hi])
            yield _binary(batch.column(0)[lo:hi], ids.astype("<u4").view(np.uint8), counts * 4, "ids", pa.binary())


def _binary(keys: pa.Array, data: np.ndarray, sizes: np.ndarray, name: str, kind: pa.DataType, *more: pa.Array) -> pa.RecordBatch:
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    values = pa.Array.from_buffers(kind, len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    return pa.RecordBatch.from_arrays([keys, *more, values], ["doc_id", *(["ids"] if more else []), name])


def bpe_encode(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids) per row: the ids of the whole text as little-endian unsigned 32-bit integers, in one binary value.

    No special tokens are added, nothing is cut or padded; strings of special tokens inside a text become their ids. Null and
    empty texts give an empty value; a null id stays null; repeated rows are encoded each; an empty table gives an empty table;
    other columns are left out, whatever their names. One text may be as long as a row can be. No row is shuffled.
    """
    rows = text_columns(docs, id_column, text_column)
    return map_arrow(rows, "doc_id long, ids binary", _encoded, path or tokenizer.vocabulary_path())


def offset_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all tokens one after the other, each with a space behind it, and where each id begins."""
    with open(path, encoding="utf-8") as file:
        stated = json.load(file)
    named = {**{i: t for t, i in stated["model"]["vocab"].items()}, **{t["id"]: t["content"] for t in stated["added_tokens"]}}
    values = [f"{named[i]} ".encode() if i in named else b"" for i in range(max(named) + 1)]
    return np.frombuffer(b"".join(values), np.uint8), np.concatenate(([0], np.cumsum([len(v) for v in values])))


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    table, offsets = offset_table(path)
    widths = np.diff(offsets)
    for batch in batches:
        raw = [b or b"" for b in batch.column(1).to_pylist()]
        for lo, hi in _slices([len(b) // 4 for b in raw]):
            ids = np.frombuffer(b"".join(raw[lo:hi]), "<u4").astype(np.int64)
            sizes = widths[ids]
            data = table[np.repeat(offsets[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
            ends = np.cumsum([len(b) // 4 for b in raw[lo:hi]])
            bytes_before = np.concatenate(([0], np.cumsum(sizes)))
            counts = np.diff(bytes_before[np.concatenate(([0], ends))])
            # the space behind a text's last token goes
            keep = np.ones(len(data), bool)
            keep[(np.cumsum(counts) - 1)[counts > 0]] = False
            yield _binary(batch.column(0)[lo:hi], data[keep], counts - (counts > 0), "text", pa.string(), batch.column(1)[lo:hi])


def bpe_decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, text) per row of (doc_id, ids): the tokens of the ids, special ones too, with a space between.

    Null and empty ids give an empty text; other columns are left out; an id that the vocabulary lacks fails.
    """
    rows = encoded.select("doc_id", "ids")
    return map_arrow(rows, "doc_id long, ids binary, text string", _decoded, path or tokenizer.vocabulary_path())
