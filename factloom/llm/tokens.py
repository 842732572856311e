"""Token ids of whole texts with a byte-level BPE vocabulary file of the ``tokenizers`` library."""

from __future__ import annotations

import re

import numpy as np

#: Longest chunk that is remembered, and chunks remembered by a worker before it forgets all (about 150 bytes each).
KEPT_LENGTH, KEPT_CHUNKS = 48, 200_000

_CLEAN_SPACE = re.compile(r"(?<=\S) (?=\S)")
_LOADED: dict[str, "ByteBpe"] = {}


class _Unclean(Exception):
    """A chunk that starts or ends with white space, or is empty: its neighbours matter."""


class _Chunks(dict):
    """Chunk to packed ids; ``lead`` is what stands before the chunk in the text."""

    def __init__(self, encode, lead: str):
        super().__init__()
        self.encode, self.lead = encode, lead

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Unclean
        got = np.array(self.encode(self.lead + chunk), "<u4").tobytes()
        if len(chunk) <= KEPT_LENGTH:
            if len(self) >= KEPT_CHUNKS:
                self.clear()
            self[chunk] = got
        return got


def _byte_of_symbol() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable ones for themselves, the rest from U+0100 on in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """Encodes with the ids of a ``tokenizers`` JSON file, as ``encode(text, add_special_tokens=False)`` does.

    The strings of its added tokens are those tokens wherever they stand, and part the
    text; what is between them is encoded by itself. The vocabulary is read with ``tokenizers``; the merges run in tiktoken's core, which
    takes the ids as ranks and is several times faster, and equality with ``tokenizers``
    is checked on loading. The split pattern never crosses a single space between two
    other characters (the space opens the next piece), so a text is the concatenation of
    its space-separated chunks, and a worker remembers the ids of short chunks.
    """

    #: Fixed: the split pattern of byte-level BPE files of this family.
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    PROBES = ("", "One two,  three\n\n four's\t5,000 ", " été 中文。 x́ \U0001f600!", "<|endoftext|> re've  ", " a  b\x1c c\x85d")

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        added = own.get_added_tokens_decoder()
        symbols, special = _byte_of_symbol(), {t.content: i for i, t in added.items()}
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError(f"{path} has added tokens that take in what stands around them")
        ranks = {bytes(symbols[c] for c in token): i for token, i in own.get_vocab(with_added_tokens=True).items() if token not in special}
        self.encode_plain = tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._first, self._later = _Chunks(self.encode_plain, ""), _Chunks(self.encode_plain, " ")
        self._added = {token: np.array([i], "<u4").tobytes() for token, i in special.items()}
        # The longest of those that start at a place wins.
        self._at_added = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        for text in (*self.PROBES, *(f" x {token}y" for token in special)):
            if self.packed(text) != np.array(own.encode(text, add_special_tokens=False).ids, "<u4").tobytes():
                raise ValueError(f"{path} is not a byte-level BPE of the expected form")

    def packed(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text; none for null or empty."""
        if not text:
            return b""
        if self._at_added is None or not self._at_added.search(text):
            return self._between(text)
        return b"".join(self._added[x] if k % 2 else self._between(x) for k, x in enumerate(self._at_added.split(text)))

    def _between(self, text: str) -> bytes:
        """The ids of a stretch without added tokens."""
        if not text:
            return b""
        try:
            return self._joined(text.split(" "))
        except _Unclean:
            pass
        try:
            return self._joined(_CLEAN_SPACE.split(text))
        except _Unclean:  # white space at an end of the text
            return np.array(self.encode_plain(text), "<u4").tobytes()

    def _joined(self, chunks: list[str]) -> bytes:
        return self._first[chunks[0]] + b"".join(map(self._later.__getitem__, chunks[1:]))


def load(path: str) -> ByteBpe:
    """The encoder of a file, once a worker process."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def default_path() -> str:
    """The installed 50k byte-level vocabulary; looked up where it is used, on the executors."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
