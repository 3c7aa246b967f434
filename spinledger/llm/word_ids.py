"""Token ids of whole texts from a tokenizers file whose pieces never cross white space.

A text's ids are the ids of its parts in order, cut where no piece can reach over. Parts
repeat, so each process keeps the ids of those it has seen and asks the tokenizers
library only for new ones.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from functools import lru_cache

#: Parts remembered by one process; beyond it the memory starts anew.
REMEMBERED = 400_000

_RUNS = re.compile(rb"[a-z\x80-\xff]+|[^a-z\x80-\xff\x09-\x0d\x20]+")
#: Outside ASCII, what is not one of the Latin letters up to U+024F; a dotted capital I lowers to a letter and a mark.
_NO_LETTER = re.compile("[^\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]")


class WordIds:
    """Encode texts as the library does with ``add_special_tokens=False``.

    Valid for a lower-casing vocabulary whose pre-tokenizer splits letters, digits
    and other signs and removes white space.
    """

    def __init__(self, path: str, end_id: int | None = None):
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are kept as little-endian 32-bit numbers")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        self._words: dict[bytes, bytes] = {}
        self._end = b"" if end_id is None else array("I", [end_id]).tobytes()

    @property
    def largest(self) -> int:
        """The largest id that a text can have."""
        own = max(self._library.get_vocab(with_added_tokens=True).values(), default=0)
        return max(own, int.from_bytes(self._end, "little"))

    def _parts(self, text: str) -> list[bytes]:
        """Cut a text where a piece certainly ends, into parts that come again often.

        White space ends a piece, and so does the border between a run of letters and
        a run of ASCII signs. Special tokens, contractions and other signs than letters
        outside ASCII may reach over such borders; these texts are cut at white space.
        """
        data = text.encode()
        if b"'" in data or b"<|" in data or not text.isascii() and _NO_LETTER.search(text):
            return data.split()
        return _RUNS.findall(data.lower())

    def _learn(self, parts: set[bytes]) -> None:
        words, pieces, other = self._words, self._library.model.tokenize, []
        for part in parts:
            if part.isalpha() and part.islower():  # ASCII letters: one pre-token that the normalizer leaves as it is
                words[part] = array("I", [piece.id for piece in pieces(part.decode())]).tobytes()
            else:
                other.append(part)
        found = self._library.encode_batch_fast([part.decode() for part in other], add_special_tokens=False)
        for part, encoding in zip(other, found, strict=True):
            words[part] = array("I", encoding.ids).tobytes()

    def encode_batch(self, texts: list[str | None], block: int = 500) -> list[bytes]:
        """Little-endian 32-bit ids of each text, the end id behind each."""
        out: list[bytes] = []
        for i in range(0, len(texts), block):
            rows = [self._parts(text) if text else [] for text in texts[i : i + block]]
            if len(self._words) > REMEMBERED:
                self._words = {}
            new: set[bytes] = set()
            for parts in rows:
                new.update(parts)
            self._learn(new.difference(self._words))
            get = self._words.__getitem__
            out += [b"".join(map(get, parts)) + self._end for parts in rows]
        return out


@lru_cache(maxsize=4)
def word_ids(path: str, end_id: int | None) -> WordIds:
    """One encoder for each process and file."""
    return WordIds(path, end_id)
