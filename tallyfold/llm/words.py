"""Pre-tokens of many texts at once, and what is known of each distinct one.

The two public vocabularies split a text into pre-tokens and merge within each of
them, so what a pre-token encodes to does not depend on its surroundings. Splitting
and looking up are numpy operations on the code points of many texts; only pre-tokens
not seen before are handed to Python, as strings.

Texts that hold characters above U+024F, characters that change their number when
normalised, or strings of special tokens are split one by one, by the library's own normaliser
and pre-tokenizer; their pre-tokens are then encoded like all others.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import xxhash

from tallyfold.llm.common import sizes_within

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
RANGE = 0x250  # Latin; nothing below it composes
HASHED = 32  # characters of a pre-token that the table of random numbers covers
BATCH_CHARS = 1 << 21
CELL_BITS = 22  # of the table by which known pre-tokens are found
KNOWN = 1_500_000  # distinct pre-tokens remembered by a Python worker; more are encoded again


@lru_cache(maxsize=4)
def library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


_LETTERS = byte_letters()
_BYTE = {x: b for b, x in enumerate(_LETTERS)}
_LETTER_OF = {b: x for b, x in enumerate(_LETTERS)}


def as_letters(word: str) -> str:
    """A letter for each byte of a pre-token, as the vocabulary is written."""
    return word.encode().decode("latin-1").translate(_LETTER_OF)


def from_letters(letters: str) -> str:
    return bytes(_BYTE[x] for x in letters).decode()


class Splitter:
    """Splits texts as the tokenizer does; the character tables are asked of the library."""

    def __init__(self, path: str):
        self.tokenizer = library(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("special tokens that take in their surroundings are not known")
        self.specials = {t.content: i for i, t in added.items()}
        longest_first = sorted(self.specials, key=lambda s: (-len(s), s))
        self.special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")")
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str
        # Lower-case words without white space, or pieces that carry the blank before them.
        self.blanks = len(pieces("a b")) == 2 and pieces("a b")[1][0] != "b"
        if not self.blanks and pieces("a b")[1][0] != "b":
            raise ValueError("this pre-tokenizer is not known")
        normal = self.tokenizer.normalizer
        self.norm = np.arange(RANGE, dtype=np.uint32)
        self.odd = np.zeros(RANGE, bool)
        self.kind = np.full(RANGE, OTHER, np.uint8)
        for c in range(RANGE):
            s = chr(c)
            to = normal.normalize_str(s) if normal else s
            if len(to) != 1 or ord(to) >= RANGE:
                self.odd[c] = True
                continue
            self.norm[c] = ord(to)
            count = len(pieces(f"a{s}b"))
            if self.blanks:
                if count == 1:
                    self.kind[c] = LETTER
                elif s == " " or len(pieces(f"{s}{s}b")) == 3:
                    self.kind[c] = SPACE
                elif len(pieces(f"{s}1")) == 1:
                    self.kind[c] = NUMBER
            elif count == 1:
                self.kind[c] = LETTER
            elif count == 2:
                self.kind[c] = SPACE
            elif len(pieces(f"a{s}{s}b")) == 4:
                self.kind[c] = NUMBER
        self.table = np.random.default_rng(20240229).integers(
            0, 1 << 63, size=RANGE * HASHED, dtype=np.uint64
        ) * np.uint64(2) + np.uint64(1)

    def words(self, text: str) -> list[str | int]:
        """Pre-tokens of one text with any characters, and ids of special tokens, in order."""
        normal, pieces = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer.pre_tokenize_str
        out: list[str | int] = []
        for i, part in enumerate(self.special.split(text) if self.specials else [text]):
            if i % 2:
                out.append(self.specials[part])
            elif part:
                part = normal.normalize_str(part) if normal else part
                out += [from_letters(piece) for piece, _ in pieces(part)]
        return out

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points of all texts, where each ends, and which are to be split one by one."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        bad = codes >= RANGE
        bad |= self.odd[np.where(bad, 0, codes)]
        before = np.concatenate([[0], np.cumsum(bad)])
        hard = before[ends] > before[np.concatenate([[0], ends[:-1]])]
        hard |= np.fromiter((any(s in t for s in self.specials) for t in texts), bool, len(texts))
        return codes, ends, hard

    def split(self, codes: np.ndarray, ends: np.ndarray):
        """First and last (exclusive) place of each pre-token, its hash, and pre-tokens per text."""
        codes = self.norm[codes]
        n, kind = len(codes), self.kind[codes]
        begins = np.concatenate([[0], ends[:-1]])
        edge = np.zeros(n + 1, bool)
        edge[begins] = edge[n] = True
        new = edge[:n].copy()
        new[1:] |= kind[1:] != kind[:-1]
        if not self.blanks:
            new |= kind == NUMBER
        self._contractions(codes, kind, edge, new)
        if self.blanks:
            # White space before a word: its last character stands alone, or joins the word if blank.
            follows = np.flatnonzero(new[1:] & (kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~edge[1:n]) + 1
            new[follows - 1] = True
            new[follows] = codes[follows - 1] != 32
        starts = np.flatnonzero(new)
        stops = np.append(starts[1:], n)
        place = np.arange(n, dtype=np.int32) - np.repeat(starts, stops - starts).astype(np.int32)
        np.minimum(place, HASHED - 1, out=place)
        place += codes.astype(np.int32) * HASHED
        hashes = np.add.reduceat(self.table[place], starts) if n else np.empty(0, np.uint64)
        if not self.blanks:
            words = kind[starts] != SPACE
            starts, stops, hashes = starts[words], stops[words], hashes[words]
        for i in np.flatnonzero(stops - starts > HASHED):
            hashes[i] = xxhash.xxh64_intdigest(codes[starts[i] : stops[i]].tobytes())
        per_text = np.diff(np.searchsorted(starts, np.concatenate([[0], ends])))
        return codes, starts, stops, hashes, per_text

    def _contractions(self, codes, kind, edge, new) -> None:
        n = len(codes)
        at = np.flatnonzero((codes == 39) & new)
        at = at[at + 1 < n]
        at = at[new[at + 1] & ~edge[at + 1] & (kind[at + 1] == LETTER)]
        if self.blanks:
            at = at[edge[at] | (codes[at - 1] != 32)]
        if not len(at):
            return
        one = codes[at + 1]
        after = np.minimum(at + 2, n - 1)
        two = np.where((at + 2 < n) & ~new[after], codes[after], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))
        long |= (one == ord("l")) & (two == ord("l"))
        for which, size in ((short, 2), (long & ~short, 3)):
            new[at[which] + 1] = False
            stop = at[which] + size
            new[stop[stop < n]] = True


class Book:
    """What is known of each distinct pre-token: a run of numbers, made once by ``make``.

    Pre-tokens are known by 64-bit hashes of their characters alone, which are random sums, or XXH64
    where they are long: among the 1.5 million that one worker remembers, two have the same hash
    with a chance of 6e-8.
    """

    def __init__(self, make: Callable[[list[str]], list], known: int = KNOWN):
        self.make, self.known = make, known
        self._clear()

    def _clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.first = self.count = np.empty(0, np.int64)
        self.pool = np.empty(0, np.int32)
        self.table = np.full(1 << CELL_BITS, -1, np.int32)  # a key of each cell
        self.other: dict[int, int] = {}  # keys whose cell was taken

    def _add(self, keys: np.ndarray, made: list) -> None:
        count = np.fromiter(map(len, made), np.int64, len(made))
        first = len(self.pool) + np.cumsum(count) - count
        flat = np.fromiter((x for run in made for x in run), np.int32, int(count.sum()))
        number = len(self.keys) + np.arange(len(keys))
        self.pool = np.concatenate([self.pool, flat])
        self.keys = np.concatenate([self.keys, keys])
        self.first = np.concatenate([self.first, first])
        self.count = np.concatenate([self.count, count])
        cell = keys >> np.uint64(64 - CELL_BITS)
        free = np.flatnonzero(self.table[cell] < 0)
        self.table[cell[free]] = number[free]
        taken = self.table[cell] != number
        self.other.update(zip(keys[taken].tolist(), number[taken].tolist()))

    def look(self, hashes, codes, starts, stops):
        """``first`` and ``count`` into ``pool`` for every pre-token."""
        at = self.table[hashes >> np.uint64(64 - CELL_BITS)].astype(np.int64)
        if len(self.keys):
            at[self.keys[at] != hashes] = -1
        missing = np.flatnonzero(at < 0)
        if len(missing):
            unique, index, inverse = np.unique(hashes[missing], return_index=True, return_inverse=True)
            place = np.fromiter((self.other.get(h, -1) for h in unique.tolist()), np.int64, len(unique))
            new = np.flatnonzero(place < 0)
            if len(self.keys) and len(self.keys) + len(new) > self.known:
                self._clear()
                return self.look(hashes, codes, starts, stops)
            if len(new):
                text = codes.astype("<u4").tobytes().decode("utf-32-le")
                where = missing[index[new]]
                words = [text[a:b] for a, b in zip(starts[where].tolist(), stops[where].tolist())]
                place[new] = len(self.keys) + np.arange(len(new))
                self._add(unique[new], self.make(words))
            at[missing] = place[inverse]
        return self.first[at], self.count[at]


def ragged(pool: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``pool[first : first + count]`` of every row, one after the other."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(first - (ends - count), count) + np.arange(total)]


class Encoder:
    """Ids of texts, each distinct pre-token of which is encoded by ``make``."""

    def __init__(self, path: str, make: Callable[[list[str]], list] | None = None):
        self.splitter, self.model = Splitter(path), library(path).model
        self.make = make or self.merged
        self.book = Book(self.make)

    def merged(self, words: list[str]) -> list[list[int]]:
        """Ids of pre-tokens by the library's merges."""
        tokenize = self.model.tokenize
        return [[t.id for t in tokenize(as_letters(word))] for word in words]

    def whole(self, text: str) -> np.ndarray:
        """Ids of one text with any characters."""
        pieces = self.splitter.words(text)
        distinct = list(dict.fromkeys(p for p in pieces if isinstance(p, str)))
        runs = dict(zip(distinct, self.make(distinct)))
        ids = (x for p in pieces for x in (runs[p] if isinstance(p, str) else (p,)))
        return np.fromiter(ids, np.int32)

    def batches(self, texts: list[str], chars: int = BATCH_CHARS):
        """A slice of the texts, their ids one after the other, and how many each has."""
        for rows in sizes_within([len(t) for t in texts], chars):
            part = texts[rows]
            codes, ends, hard = self.splitter.codes(part)
            easy = part
            if hard.any():
                easy = ["" if h else t for t, h in zip(part, hard)]
                codes, ends, _ = self.splitter.codes(easy)
            codes, starts, stops, hashes, per_text = self.splitter.split(codes, ends)
            first, count = self.book.look(hashes, codes, starts, stops)
            ids = ragged(self.book.pool, first, count)
            token_ends = np.concatenate([[0], np.cumsum(count)])
            word_ends = np.concatenate([[0], np.cumsum(per_text)])
            lengths = np.diff(token_ends[word_ends])
            if hard.any():
                at = np.concatenate([[0], np.cumsum(lengths)])
                runs = [
                    self.whole(t) if h else ids[at[i] : at[i + 1]]
                    for i, (t, h) in enumerate(zip(part, hard))
                ]
                ids = np.concatenate(runs) if runs else ids
                lengths = np.fromiter(map(len, runs), np.int64, len(runs))
            yield rows, ids, lengths


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One for each Python worker, so that what it knows serves later tasks."""
    return Encoder(path)
