"""Token ids of whole texts by a public tokenizer, piece by piece.

The vocabulary's splitting pattern never crosses white space, and its normaliser works on single
characters, so the ids of a text are the ids of its blank-separated pieces in a row.
"""

from __future__ import annotations

import os
from itertools import compress, repeat

import numpy as np

from tableviews.llm.shared import PieceTable

VOCABULARY = "word_bpe_49k.json"

# Signs after a word that are looked up apart from it.
SIGNS = ".,!?;:$#*&%|"

# Words kept by a worker; the table is emptied beyond.
KNOWN_WORDS = 900_000

# Marks the piece of a word that ends it, a fixed value of the vocabulary.
WORD_END = "</w>"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    """Token ids as little-endian unsigned integers of `width` bytes.

    plain_specials: the strings of special tokens inside a text are ordinary text.
    """

    def __init__(self, path: str | None = None, plain_specials: bool = False, cached: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or vocabulary_path())
        self.tokenizer.encode_special_tokens = plain_specials
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.width = 2 if size <= 2**16 else 4
        self.dtype = f"<u{self.width}"
        self.ends = np.zeros(size, bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.ends[number] = token.endswith(WORD_END)
        # the model alone, where no other step changes or cuts small ASCII letters
        letters, rules = "abcdefghijklmnopqrstuvwxyz", self.tokenizer.pre_tokenizer
        cut = rules.pre_tokenize_str(letters) if rules else [(letters, None)]
        normal = self.tokenizer.normalizer.normalize_str(letters) if self.tokenizer.normalizer else letters
        added = any(token.content.isalpha() for token in self.tokenizer.get_added_tokens_decoder().values())
        plain = normal == letters and [piece for piece, _ in cut] == [letters] and not added
        self.model = self.tokenizer.model if plain else None
        self.table = PieceTable(self._fill, cached)
        self.words: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        # without places in the text, which cost a quarter of the work on new words
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)

    def _one_by_one(self, pieces: list[str]) -> list[bytes]:
        return [np.asarray(x.ids, dtype=self.dtype).tobytes() for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _split(self, ids: np.ndarray, stops: np.ndarray) -> list[bytes]:
        """The bytes of runs of ids that end at the stops."""
        raw, ends = ids.tobytes(), (stops * self.width).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def _together(self, words: list[str]) -> list[bytes]:
        """Words of letters only give one run of tokens each, whose last token ends a word."""
        ids = self._ids(" ".join(words))
        stops = np.flatnonzero(self.ends[ids]) + 1
        return self._split(ids, stops) if len(stops) == len(words) else self._one_by_one(words)

    def _by_model(self, words: list[str]) -> list[bytes]:
        """Words of small ASCII letters, which the steps before the model leave as they are."""
        found = list(map(self.model.tokenize, words))
        ids = np.array([token.id for tokens in found for token in tokens], self.dtype)
        return self._split(ids, np.cumsum(np.fromiter(map(len, found), np.int64, len(found))))

    def _learn(self, words: set[str]) -> None:
        """Keep the ids of new words."""
        small = [word for word in words if self.model and word.isascii()]
        others = [word for word in words if not (self.model and word.isascii())]
        for part, ids in ((small, self._by_model), (others, self._together)):
            if part:
                self.words.update(zip(part, ids(part), strict=True))

    def _fill(self, pieces: list[str]) -> list[bytes]:
        """Ids of new pieces; most are letters with signs after them, which are tokens of their own."""
        known, values = self.words, [b""] * len(pieces)
        bodies = list(map(str.rstrip, pieces, repeat(SIGNS)))
        letters = np.fromiter(map(str.isalpha, bodies), bool, len(pieces))
        # only ASCII letters are sure to be the same word in either case
        words = [body.lower() if body.isascii() else body for body in bodies]
        self._learn({word for word in compress(words, letters) if word not in known})
        signs = [piece[len(body) :] for piece, body in zip(pieces, bodies)]
        ends = {s: self._ids(s).tobytes() if s else b"" for s in set(compress(signs, letters))}
        odd = np.flatnonzero(~letters).tolist()
        for k in np.flatnonzero(letters).tolist():
            values[k] = known[words[k]] + ends[signs[k]]
        for k, value in zip(odd, self._one_by_one([pieces[k] for k in odd]), strict=True):
            values[k] = value
        if len(known) > KNOWN_WORDS:
            known.clear()
        return values

    def __call__(self, texts: list[str]) -> list[bytes]:
        return self.table.encode(texts)


_ENCODERS: dict[tuple, PieceEncoder] = {}


def encoder(path: str | None = None, plain_specials: bool = False) -> PieceEncoder:
    """The encoder of this worker process, kept from task to task."""
    key = (path, plain_specials)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(path, plain_specials)
    return _ENCODERS[key]
