"""Token ids by the tokenizers library, with a memo of words in front of it."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

#: Words a worker remembers before it starts afresh: about 300 MB with their stems.
MEMO_WORDS = 1_000_000

#: Letters whose lower case is one letter of the same range, then marks that make one pre-token.
_PLAIN = re.compile(r"([a-z\u00df-\u00f6\u00f8-\u00ff]+)([!-&(-/:;=-@\[-`{-~]*)\Z")

_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Byte-level vocabularies write each byte as a printable character: itself, or the next one from 256 on.
_AS_CHARACTER = {b: b for b in _PRINTABLE} | {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in set(_PRINTABLE))}


class _Words(dict):
    """Word to its place in the lists of ids; a word not met before is encoded then."""

    def __init__(self, tokenizer, most: int):
        self.tokenizer, self.one, self.most = tokenizer, tokenizer.model.tokenize, most
        # bytes, not lists: the garbage collector would walk these again and again
        self.stems: dict[str, bytes] = {}
        self.ids, self.ends = bytearray(), array("q", [0])

    def __missing__(self, word: bytes) -> int:
        text = word.decode()
        if match := _PLAIN.match(text.lower()):
            stem, mark = match.groups()
            self.ids += self.stem(stem)
            if mark:
                self.ids += self.stem(mark)
        else:
            self.ids += array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        place = self[word] = len(self.ends) - 1
        self.ends.append(len(self.ids) >> 2)
        return place

    def stem(self, text: str) -> bytes:
        found = self.stems.get(text)
        if found is None:
            if len(self.stems) > self.most // 2:
                self.stems.clear()
            plain = text if text.isascii() else text.encode().decode("latin-1").translate(_AS_CHARACTER)
            found = self.stems[text] = array("I", [t.id for t in self.one(plain)]).tobytes()
        return found


class WordMemoEncoder:
    """Encodes texts word by word, each distinct word once.

    Valid for tokenizers that drop white space and whose pre-tokens never cross it: then the ids of a
    text are those of its words in turn.  ASCII white space cuts the words, anything else is left to the
    tokenizer, special tokens written in a text included.
    """

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.memo_words = memo_words
        self.words = _Words(self.tokenizer, memo_words)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """uint32 ids of each text."""
        if len(self.words) > self.memo_words:
            self.words = _Words(self.tokenizer, self.memo_words)
        place = self.words.__getitem__
        split = [t.split() for t in texts]
        at = [np.fromiter(map(place, words), np.int64, len(words)) for words in split]
        ids, ends = np.frombuffer(bytes(self.words.ids), np.uint32), np.array(self.words.ends, np.int64)
        flat = np.concatenate([np.zeros(0, np.int64), *at])
        first, size = ends[flat], ends[flat + 1] - ends[flat]
        stop = np.cumsum(size)
        whole = ids[np.arange(size.sum()) + np.repeat(first - (stop - size), size)]
        cuts = np.r_[0, stop][np.cumsum([len(words) for words in split])] if texts else []
        return np.split(whole, cuts[:-1]) if texts else []


_encoders: dict[tuple[str, int], WordMemoEncoder] = {}


def encoder(path: str, memo_words: int = MEMO_WORDS) -> WordMemoEncoder:
    """One per worker process, vocabulary file and size of memo."""
    if (path, memo_words) not in _encoders:
        _encoders[path, memo_words] = WordMemoEncoder(path, memo_words)
    return _encoders[path, memo_words]
