"""Exact byte-level BPE encoding with the tokenizers library, of each distinct word once.

The tokenizer cuts a text into words before it merges bytes, and words do not act upon each other: the ids of a text
are those of its words, one after the other. So a text is cut here by the same pattern, and only words that this worker
has not met go through the library's model. Texts beyond Latin letters, with rare control characters, or with the
string of a token that was added to the vocabulary, such as an end of text, go through the library whole, as it is loaded.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache
from itertools import accumulate, islice

import numpy as np

#: The words of the byte-level tokenizer, its Unicode classes spelled out for characters up to U+024F (fixed values).
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBER = "0-9²³¹¼-¾"
SPACE = "\\t-\\r \\x85\\xa0"
WORD = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
PLAIN = re.compile("[\\x00-\\x1b\\x20-ɏ]*")
#: Words kept by a worker; beyond, the first half of them stays, which holds the frequent ones. Some 75 MB.
MOST_WORDS = 350_000


def _alphabet() -> dict[int, str]:
    """The sign that byte-level models write for each byte: itself where it is printable, else the next from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(others)}


class _Words(dict):
    """What a word is encoded to; found by ``encode`` when the word is met first."""

    def __init__(self, encode) -> None:
        self.encode = encode

    def __missing__(self, word: str):
        value = self[word] = self.encode(word)
        return value


class Encoder:
    """Encodes texts, with or without the characters where tokens begin. One for each Python worker: see encoder()."""

    def __init__(self, path: str, offsets: bool = False) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.signs = self.tokenizer.model, _alphabet()
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.code = np.dtype(self.dtype).char
        self.offsets = offsets
        self.words = _Words(self._spans_of if offsets else self._ids_of)

    def _tokens(self, word: str) -> list:
        return self.model.tokenize(word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.signs))

    def _ids_of(self, word: str) -> bytes:
        return array(self.code, [t.id for t in self._tokens(word)]).tobytes()

    def _spans_of(self, word: str) -> tuple[int, bytes, bytes]:
        """Number of tokens, their first characters and the ones after their last; a part of a character counts whole."""
        ends = list(accumulate(len(t.value) for t in self._tokens(word)))
        starts = [0, *ends[:-1]]
        if not word.isascii():
            char = [k for k, c in enumerate(word) for _ in c.encode("utf-8", "surrogatepass")]
            starts, ends = [char[b] for b in starts], [char[b - 1] + 1 for b in ends]
        return len(ends), array("i", starts).tobytes(), array("i", ends).tobytes()

    def _cut(self, text: str) -> list[str] | None:
        """The words of a text; None for a text to be encoded whole."""
        if len(self.words) > MOST_WORDS:
            first = dict(islice(self.words.items(), MOST_WORDS // 2))
            self.words.clear()
            self.words.update(first)
        return WORD.findall(text) if PLAIN.fullmatch(text) and not any(x in text for x in self.added) else None

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian integers of self.dtype."""
        out = []
        for text in texts:
            words = self._cut(text)
            if words is None:
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes())
            else:
                out.append(b"".join(map(self.words.__getitem__, words)))
        return out

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The first character of each token, and the one after its last."""
        words = self._cut(text)
        if words is None:
            pairs = np.array(self.tokenizer.encode(text, add_special_tokens=False).offsets, np.int32).reshape(-1, 2)
            return pairs[:, 0], pairs[:, 1]
        found = list(map(self.words.__getitem__, words))
        to = np.cumsum(np.fromiter(map(len, words), np.int32, len(words)), dtype=np.int32)
        base = np.repeat(np.concatenate([np.zeros(1, np.int32), to])[:-1], np.fromiter((x[0] for x in found), np.int32, len(found)))
        return tuple(base + np.frombuffer(b"".join([x[k] for x in found]), np.int32) for k in (1, 2))


@lru_cache(maxsize=2)
def encoder(path: str, offsets: bool = False) -> Encoder:
    """The worker's encoder, kept from task to task."""
    return Encoder(path, offsets)


def batches(texts, most_chars: int = 400_000):
    """Cuts an iterable of (key, text) into lists of bounded size, each of at least one text."""
    some, n = [], 0
    for key, text in texts:
        some.append((key, text))
        n += len(text)
        if n >= most_chars or len(some) >= 2000:
            yield some
            some, n = [], 0
    if some:
        yield some
