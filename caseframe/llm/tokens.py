"""Token ids of whole texts with the tokenizers library, one encoder for each Python worker."""

from __future__ import annotations

import os
import re
from array import array

#: Distinct chunks that a worker remembers in each of two generations; a new one begins when the first is full.
REMEMBERED = 400_000
#: Longer chunks are encoded each time.
LONGEST = 48
_MARKS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())
#: A letter of ASCII or Latin-1 at the end.
_LETTER_LAST = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])\Z")
#: Words that no normaliser changes and no pre-tokeniser splits: lower-case letters of ASCII and Latin-1.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: The byte-level alphabet: bytes that print stand for themselves, the others for the characters from 256 on.
_BYTES = {b: chr(256 + i) for i, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """encode(texts) gives the ids' bytes, little-endian unsigned 32-bit, as encode(text, add_special_tokens=False) would.

    With `by_chunk` a text is lower-cased (ASCII) and cut at blanks and line ends, and the ids of chunks met before are
    taken from memory; punctuation after a letter at a chunk's end is a chunk of its own. That is right for tokenizers
    that lower-case, drop white space and keep letters apart from punctuation, as the public word-level BPE file does;
    for others pass by_chunk=False, which encodes whole texts."""

    _made: dict[tuple[str, bool], Encoder] = {}

    def __init__(self, path: str, by_chunk: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.by_chunk = Tokenizer.from_file(path), by_chunk
        self.model, self.known = self.tokenizer.model, _Known(self, {})
        self.vocabulary = self.tokenizer.get_vocab_size()

    @classmethod
    def of(cls, path: str, by_chunk: bool = True) -> Encoder:
        if (path, by_chunk) not in cls._made:
            cls._made[path, by_chunk] = cls(path, by_chunk)
        return cls._made[path, by_chunk]

    def whole(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8") for t in texts], add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def chunk(self, c: bytes) -> bytes:
        """A plain word goes straight to the tokenizer's model, all else through the whole tokenizer."""
        word = c if c.isascii() else c.decode("utf-8").lower().encode("utf-8")
        if not _PLAIN.fullmatch(word):
            return self.whole([c])[0]
        plain = word.decode("latin-1")
        return self.word(plain if word.isascii() else plain.translate(_BYTES))

    def word(self, plain: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(plain)]).tobytes()

    def forget(self) -> None:
        """Frees the chunks remembered, where other stages need a worker's memory."""
        self.known = _Known(self, {})

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_chunk:
            return self.whole(texts)
        if len(self.known) > REMEMBERED:
            self.known = _Known(self, self.known)
        get = self.known.__getitem__
        # special tokens keep their case
        return [b"".join(map(get, [t] if b"<|" in t else t.lower().replace(b"\n", b" ").split(b" "))) for t in texts]


class _Known(dict):
    """Ids of chunks; those not met in this generation come from the one before or are made."""

    def __init__(self, encoder: Encoder, old: dict):
        super().__init__({b"": b""})
        self.encoder, self.old = encoder, old
        if isinstance(old, _Known):
            old.old = {}  # two generations at most

    def __missing__(self, c: bytes) -> bytes:
        ids = self.old.get(c)
        if ids is None and c.isalpha():
            ids = self.encoder.word(c.decode("ascii"))
        elif ids is None:
            head = c.rstrip(_MARKS)
            if head and len(head) < len(c) and b"<|" not in c and _LETTER_LAST.search(head):
                ids = self[head] + self[c[len(head) :]]
            else:
                ids = self.encoder.chunk(c)
        if len(c) <= LONGEST:
            self[c] = ids
        return ids
