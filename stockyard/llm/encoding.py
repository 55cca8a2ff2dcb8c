"""Ids of whole texts with a byte-level BPE file of the tokenizers library.

The library takes about a second for a megabyte of text. Another encoder of the same ranks gives the same ids
in less than a third of that (measured: packing takes 349 CPU seconds a GB with it and 443 with the library's model on
cached words), so it serves texts whose code points all lie below ``LATIN``; for those the two libraries' split
patterns agree sign by sign, and tests hold the ids equal on every document of the test tables and on long runs of
blanks, digits, apostrophes and combining forms. All other texts, and those with a special token's string, go through
the library itself, and so does everything if a file's merges are not in the order of its ids.
"""

from __future__ import annotations

import json

import numpy as np

#: Code points up to here are split alike by both libraries (tested for each).
LATIN = 0x24F
# byte-level vocabularies write a byte as a visible sign: these as themselves, the others from U+0100 on
VISIBLE = (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))


class TextEncoder:
    """Packed little-endian ids, two bytes each for vocabularies up to 65,536, else four."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        path = path or public_tokenizers.path("byte_bpe_50k.json")
        self.exact = Tokenizer.from_file(path)
        self.size = self.exact.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        hidden = [b for b in range(256) if b not in set(VISIBLE)]
        byte = {chr(b): b for b in VISIBLE} | {chr(256 + i): b for i, b in enumerate(hidden)}
        vocab = spec["model"]["vocab"]
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in self.special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        in_order = all(vocab[a + b] == 256 + i for i, (a, b) in enumerate(merges))
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                      special_tokens={}) if in_order else None

    def packed(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special) or not (text.isascii() or max(text) <= chr(LATIN)):
            return self.packed(self.exact.encode(text, add_special_tokens=False).ids)
        return self.packed(self.fast.encode_ordinary(text))


_encoders: dict[str | None, TextEncoder] = {}


def text_encoder(path: str | None = None) -> TextEncoder:
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]
