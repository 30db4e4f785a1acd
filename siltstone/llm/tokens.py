"""Token ids of whole texts, by a public tokenizer and a bounded cache of words.

The tokenizer drops white space and splits a text into runs of letters, single
digits and runs of other characters before it merges bytes, so the ids of a
text are those of its space-separated words, one after the other. Words repeat;
their ids are kept as bytes and a text is one join of them.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np

#: Id that ends a document.
END_ID = 1
WORD_CACHE = 400_000
UNIT_CACHE = 600_000
_TAIL = ".,!?;:#*$%&|<>"

#: The tokenizer's alphabet: bytes that print as one character in Latin-1 stand for themselves, the others for 256, 257 and so on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}

_loaded: dict[str, WordEncoder] = {}


class WordEncoder:
    """Texts (UTF-8 bytes) to ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.words: dict[bytes, bytes] = {}
        self.units: dict[str, bytes] = {}

    def _whole(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _unit(self, unit: str) -> bytes:
        """A run of lower-case letters or of other characters, which needs no more than merging."""
        run = unit if unit.isascii() else unit.encode().decode("latin-1").translate(_ALPHABET)
        ids = array("I", [t.id for t in self.merge(run)]).tobytes()
        self.units[unit] = ids
        return ids

    def _learn(self, word: bytes) -> bytes:
        s = word.decode("utf-8", "replace")
        head = s.rstrip(_TAIL)
        if head.isalpha() and (s.isascii() or max(s) < "\u0100"):
            unit = head.lower()
            ids = self.units.get(unit) or self._unit(unit)
            if len(head) < len(s):
                tail = s[len(head) :]
                ids += self.units.get(tail) or self._unit(tail)
        else:
            ids = self._whole(s)
        self.words[word] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        if text.isascii() and b"<|" not in text:
            text = text.lower()
        split = text.split()
        found = list(map(self.words.get, split))
        if None in found:
            if len(self.words) > WORD_CACHE:
                self.words.clear()
            if len(self.units) > UNIT_CACHE:
                self.units.clear()
            learn, get = self._learn, self.words.get
            found = [f if f is not None else get(w) or learn(w) for w, f in zip(split, found, strict=True)]
        return b"".join(found)


def encoder(path: str) -> WordEncoder:
    """One for each worker, which serves many tasks."""
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoded(batches: Iterator, path: str, step: int = 500) -> Iterator[tuple[object, bytes]]:
    """(doc_id, ids with the end id) of each row of record batches with columns doc_id and text."""
    end = np.array([END_ID], "<u4").tobytes()
    enc = encoder(path)
    for batch in batches:
        names = batch.schema.names
        ids, texts = batch.column(names.index("doc_id")), batch.column(names.index("text"))
        for at in range(0, batch.num_rows, step):
            some = [bytes(t) if t else b"" for t in texts.slice(at, step).cast("binary").to_pylist()]
            for doc_id, text in zip(ids.slice(at, step).to_pylist(), some, strict=True):
                yield doc_id, enc.encode(text) + end
