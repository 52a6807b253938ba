"""Token ids of whole texts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64

import numpy as np
import public_tokenizers
import tiktoken

VOCABULARY = "byte_bpe_50k.tiktoken"
SPECIAL = {"<|endoftext|>": 50256}


class Encoder:
    """Ids of a text as an array of unsigned 32-bit integers.

    The ids are those of the `tokenizers` file byte_bpe_50k.json, which holds the same
    vocabulary, with add_special_tokens=False: no id is added, but the string of a special
    token in a text is that token. With special=False it is ordinary text, as with that
    library's encode_special_tokens. Null and empty texts have no ids.
    """

    def __init__(self, vocabulary: str = VOCABULARY, special: bool = True):
        with open(public_tokenizers.path(vocabulary), "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        known = SPECIAL if special else {}
        self.bpe = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=known)
        self.allowed = set(known)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        return self.bpe.encode_to_numpy(text, allowed_special=self.allowed, disallowed_special=())
