"""Token ids of whole texts, as 32-bit little-endian bytes.

The ids are those of the ``tokenizers`` library. Most texts are cut into pre-tokens here, and each distinct pre-token is encoded
once with the same vocabulary as ranks; texts with a character outside a plain set, or with the name of a special token, go
through ``tokenizers`` themselves. A test holds both ways together.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

VOCABULARY = "byte_bpe_50k"
# Fixed value: the vocabulary's pre-token pattern, for texts of plain characters.
PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Letters, digits and marks on which Python's classes and the vocabulary's agree.
UNUSUAL = re.compile("[^\t\n\x0b\x0c\r -~¡-±´-¸º»¿-ſ‐-‧€]")
MOST_WORDS = 400_000


class PreTokens(dict):
    """Ids by pre-token, filled as they are asked for; emptied when it holds ``MOST_WORDS``."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MOST_WORDS:
            self.clear()
        ids = np.asarray(self.encode(word), "<u4").tobytes()
        self[word] = ids
        return ids


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY, folder: str | None = None):
    """``text -> bytes of ids``; one per Python worker. ``folder``: where the vocabulary files are."""
    import tiktoken
    from tokenizers import Tokenizer

    if folder is None:
        import public_tokenizers

        place = public_tokenizers.path
    else:
        place = lambda name: f"{folder}/{name}"
    with open(place(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    plain = tiktoken.Encoding("plain", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    whole = Tokenizer.from_file(place(f"{vocabulary}.json"))
    special = sorted(token.content for token in whole.get_added_tokens_decoder().values())
    known = PreTokens(plain.encode_ordinary)

    def encode(text: str) -> bytes:
        if UNUSUAL.search(text) or any(name in text for name in special):
            return np.asarray(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(known.__getitem__, PRE_TOKEN.findall(text)))

    return encode
