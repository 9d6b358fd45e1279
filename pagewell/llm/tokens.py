"""Token ids of whole texts by a byte-level BPE vocabulary, given as a file of ranks."""

from __future__ import annotations

import base64

VOCABULARY = "byte_bpe_50k.tiktoken"  # the ranks of byte_bpe_50k.json
SPECIAL = {"<|endoftext|>": 50256}


class Encoder:
    """Text to little-endian 32-bit ids, as bytes.

    A text is encoded in one call. Remembered words do not pay: a call for each word that is not
    among them costs more than all others save, unless nearly every word of the corpus is.
    """

    def __init__(self, path: str | None = None, pattern: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path(VOCABULARY), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._encoding = tiktoken.Encoding(
            "given", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL
        )

    def encode(self, text: str) -> bytes:
        return self._encoding.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()


_encoders: dict[str | None, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """The worker's encoder for a vocabulary file, loaded once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
