"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

Encoding takes the longest token at each place (Aho-Corasick finds all of them in one
pass) as long as it is compatible with the token before: two tokens are compatible if
merging their joined text leaves the border between them. A sequence of tokens is the
result of the merges exactly if each neighbouring pair is compatible, so the first such
sequence found is it. Where no token fits, the token before is shortened.

Contract: null texts count as empty; empty texts have no ids; repeated rows give repeated
rows; extra columns are ignored; strings of special tokens give their ids, as is the library's
default. Characters of any script are encoded in the same way; only the splitting of such texts
is the library's. A very long text is encoded whole, as one batch; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import arrow_map, whole_text
from tallyfold.llm.words import Encoder, as_letters, library, ragged

NEVER = 1 << 40
PAIRS = 1 << 20  # answers remembered by a Python worker; beyond it they are worked out again


class Backtracker:
    """Encodes single pre-tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {pair: i for i, pair in enumerate(merges)}
        # Each merge makes a string of its own; letters have no merge.
        self.made = {a + b: (i, a, b) for i, (a, b) in enumerate(merges)}
        self.compatible: dict[tuple[str, str], bool] = {}
        self.whole: set[str] = set()
        for token in sorted(self.ids, key=lambda t: self.made.get(t, (-1,))[0]):
            if token not in self.made:
                self.whole.add(token)
                continue
            _, a, b = self.made[token]
            if a in self.whole and b in self.whole and self._border_stays(a, b, inside=True):
                self.whole.add(token)
        self.matches = ahocorasick.Automaton()
        for token in self.whole:
            self.matches.add_word(self._marked(token), token)
        self.matches.make_automaton()
        self.shorter = {t: self._shorter(t) for t in self.whole}

    def _marked(self, token: str) -> str:
        return token[: -len(self.end)] + "\0" if self.end and token.endswith(self.end) else token

    def _shorter(self, token: str) -> str | None:
        marked = self._marked(token)
        return next((marked[:n] for n in range(len(marked) - 1, 0, -1) if marked[:n] in self.whole), None)

    def _border_stays(self, a: str, b: str, inside: bool = False) -> bool:
        """Whether no merge ever crosses the border of two tokens set side by side.

        Goes back in time: of the pieces at the border the one made last is taken apart.
        Two pieces merge if their rank comes before either is used up; of equal ranks the
        one further left comes first. ``inside`` leaves out the merge of the two themselves.
        """
        until_a = until_b = NEVER
        while True:
            rank = self.rank.get((a, b), NEVER)
            if not inside and rank < until_a and rank <= until_b and rank != NEVER:
                return False
            inside = False
            made_a, made_b = self.made.get(a, (-1, a, a)), self.made.get(b, (-1, b, b))
            if made_a[0] < 0 and made_b[0] < 0:
                return True
            if made_a[0] > made_b[0]:
                until_a, a = made_a[0], made_a[2]
            else:
                until_b, b = made_b[0], made_b[1]

    def fits(self, a: str, b: str) -> bool:
        pair = (a, b)
        known = self.compatible.get(pair)
        if known is None:
            if len(self.compatible) >= PAIRS:
                self.compatible.clear()
            known = self.compatible[pair] = self._border_stays(a, b)
        return known

    def word(self, word: str) -> list[int]:
        text = as_letters(word)
        if text + self.end in self.whole:
            return [self.ids[text + self.end]]
        if self.end:
            text += "\0"
        longest: list[str | None] = [None] * len(text)
        for last, token in self.matches.iter(text):
            first = last + 1 - len(self._marked(token))
            if longest[first] is None or len(token) > len(longest[first]):
                longest[first] = token
        tokens: list[str] = []
        dead = bytearray(len(text) + 1)
        at, token = 0, longest[0]
        while at < len(text):
            if token is None:
                dead[at] = 1
                token = tokens.pop()
                at -= len(self._marked(token))
                token = self.shorter[token]
                continue
            stop = at + len(self._marked(token))
            if not dead[stop] and (not tokens or self.fits(tokens[-1], token)):
                tokens.append(token)
                at, token = stop, longest[stop] if stop < len(text) else None
            else:
                token = self.shorter[token]
        return [self.ids[t] for t in tokens]

    def words(self, words: list[str]) -> list[list[int]]:
        return list(map(self.word, words))


class Offsets:
    """Strings by id, in one buffer; each is followed by a blank."""

    def __init__(self, strings: list[bytes]):
        joined = [s + b" " for s in strings]
        self.buffer = np.frombuffer(b"".join(joined), np.uint8)
        self.size = np.fromiter(map(len, joined), np.int64, len(joined))
        self.first = np.cumsum(self.size) - self.size

    def join(self, ids: np.ndarray) -> bytes:
        """The strings of the ids, joined by one blank."""
        return ragged(self.buffer, self.first[ids], self.size[ids])[:-1].tobytes()


class Codec:
    def __init__(self, path: str):
        tokenizer = library(path)
        if tokenizer.decoder is not None:
            raise ValueError("only vocabularies without a decoder are joined by blanks")
        self.encoder = Encoder(path, Backtracker(path).words)
        size = max(tokenizer.get_vocab().values()) + 1
        self.tokens = Offsets([(tokenizer.id_to_token(i) or "").encode() for i in range(size)])
        self.numbers = Offsets([str(i).encode() for i in range(size)])


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def round_trip(documents: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encoded, then decoded from the ids."""

    def run(batch):
        texts = batch.column("text").to_pylist()
        own = codec(path)
        n_tokens, ids_sha, text_sha = [], [], []
        for _, ids, lengths in own.encoder.batches(texts):
            for run_ids in np.split(ids, np.cumsum(lengths)[:-1]):
                n_tokens.append(len(run_ids))
                ids_sha.append(hashlib.sha256(own.numbers.join(run_ids)).hexdigest())
                text_sha.append(hashlib.sha256(own.tokens.join(run_ids)).hexdigest())
        return {
            "doc_id": batch.column("doc_id"),
            "n_tokens": n_tokens,
            "ids_sha256": ids_sha,
            "decoded_sha256": text_sha,
        }

    rows = documents.select(F.col("doc_id").cast("bigint"), whole_text().alias("text"))
    return arrow_map(
        rows, run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
