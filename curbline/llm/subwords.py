"""Public tokenizers over Arrow text columns, each distinct word encoded once per worker."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex

MAX_WORDS = 300_000  # words a worker remembers before it starts anew
LONG = 64  # longer words are not remembered
_IRREGULAR = regex.compile(r"\s\s|[^\S \n]|^\s|\s\Z")
_BEYOND_LATIN = regex.compile("[^\\x00-\u024f]")

# The split patterns of the two vocabularies, and the printable stand-ins of bytes that
# byte-level vocabularies use (bytes that print as themselves stay, the others follow from U+0100 on).
_SPLIT_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_SPLIT_BYTES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_STAND_IN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class _Words(dict):
    """Numbers unknown words in the order they come and remembers that they are new."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.count = 0

    def __missing__(self, word: str) -> int:
        self[word] = number = self.count
        self.count += 1
        self.new.append(word)
        return number


class Encoder:
    """Token ids of texts, equal to encoding each whole text with ``add_special_tokens=False``.

    Both kinds of vocabulary never join two words, so a text is cut at single blanks and every word is
    looked up; only a word that is new is encoded. ``blanks`` tells that a word's ids depend on the
    blank before it (byte-level vocabularies). There, a text with any other white space than single
    blanks and line ends between words is encoded as a whole. Of a new word in Latin letters the parts
    go to the tokenizer's model one by one and are remembered as well; the whole tokenizer encodes
    every other new word.
    """

    def __init__(self, path: str, blanks: bool):
        from tokenizers import Tokenizer

        self.tokenizer, self.blanks = Tokenizer.from_file(path), blanks
        self.model = self.tokenizer.model
        # a word that could be one of these whole strings must meet the tokenizer's own rules
        self.special = {t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()}
        self._forget()

    def _forget(self) -> None:
        self.words, self.parts = _Words(), {}
        self.ids = np.zeros(0, np.uint32)
        self.first = np.zeros(1, np.int64)

    def _parts(self, text: str) -> list[str]:
        """Words to look up. In byte-level texts a leading carriage return marks "no blank before"."""
        if not self.blanks:
            return text.replace("\n", " ").split(" ")
        if _IRREGULAR.search(text):
            return ["\r" + text]
        parts = text.replace("\n", " \n").split(" ")
        parts[0] = "\r" + parts[0]
        return parts

    def _encode_word(self, word: str) -> list[int]:
        if self.blanks:
            word = word[1:] if word[:1] == "\r" else word if word[:1] == "\n" else " " + word
        if _BEYOND_LATIN.search(word) or any(s in word for s in self.special):
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        found: list[int] = []
        for part in (_SPLIT_BYTES.findall(word) if self.blanks else _SPLIT_WORDS.findall(word.lower())):
            ids = self.parts.get(part)
            if ids is None:
                printed = part.encode().decode("latin-1").translate(_STAND_IN)
                ids = tuple([t.id for t in self.model.tokenize(printed)])
                if len(part) <= LONG:
                    self.parts[part] = ids
            found += ids
        return found

    def _learn(self) -> None:
        new = self.words.new
        if not new:
            return
        lists = [self._encode_word(w) for w in new]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((i for x in lists for i in x), np.uint32, int(sizes.sum()))
        self.ids = np.concatenate([self.ids, flat])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
        for w in new:
            if len(w) > LONG:
                del self.words[w]
        new.clear()

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of each text and then ``end_id``; NULL is an empty text."""
        if self.words.count > MAX_WORDS:
            self._forget()
        numbers, counts = [], np.zeros(len(column), np.int64)
        look = self.words.__getitem__
        for i, text in enumerate(column.to_pylist()):
            parts = self._parts(text) if text else []
            counts[i] = len(parts)
            numbers.append(np.fromiter(map(look, parts), np.int64, len(parts)))
        self._learn()
        word = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        size = np.diff(self.first)[word]
        ends = np.concatenate(([0], np.cumsum(size)))
        row_end = ends[np.cumsum(counts)] if len(column) else np.zeros(0, np.int64)
        offsets = np.concatenate(([0], row_end + np.arange(1, len(column) + 1)))
        out = np.empty(int(offsets[-1]), np.uint32)
        shift = np.repeat(np.arange(len(column)), np.diff(np.concatenate(([0], row_end))))
        source = np.repeat(self.first[word] - ends[:-1], size) + np.arange(int(ends[-1]))
        out[np.arange(len(source)) + shift] = self.ids[source]
        out[offsets[1:] - 1] = end_id
        return out, offsets


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, blanks: bool) -> Encoder:
    """One encoder per worker process and file, until :func:`forget`."""
    if (path, blanks) not in _encoders:
        _encoders[path, blanks] = Encoder(path, blanks)
    return _encoders[path, blanks]


def forget() -> None:
    """Free the words of all encoders; tasks of other operators call it, as they may run in the same process."""
    for known in _encoders.values():
        known._forget()


def slices(column: pa.Array, limit: int = 2 << 20):
    """Runs of rows of up to ``limit`` bytes of text (one row at least)."""
    sizes = np.cumsum(np.asarray(pa.compute.binary_length(column).fill_null(0))) if len(column) else []
    first = 0
    while first < len(column):
        before = sizes[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(sizes, before + limit, "right")))
        yield first, end
        first = end
