"""Token ids and character spans of whole texts with a public byte-level vocabulary.

`byte_bpe_50k.json` and `byte_bpe_50k.tiktoken` hold one vocabulary; the second form is several times faster to apply
and gives the same ids. Texts that may name a special token go through `tokenizers`.
"""

from __future__ import annotations

import base64
import os

import numpy as np

_SPECIAL = "<|"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class TextEncoder:
    """Encodes texts; `name` is the vocabulary without its ending."""

    def __init__(self, name: str = "byte_bpe_50k"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken

        with open(vocabulary(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(
            name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        self.sizes[list(ranks.values())] = [len(token) for token in ranks]
        self.json = vocabulary(f"{name}.json")
        self.plain = None

    def tokenizer(self):
        if self.plain is None:
            from tokenizers import Tokenizer

            self.plain = Tokenizer.from_file(self.json)
        return self.plain

    def ids(self, text: str) -> np.ndarray:
        """Ids as little-endian unsigned 32-bit numbers."""
        if _SPECIAL in text:
            return np.array(self.tokenizer().encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), dtype="<u4")

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First character and end of every token, in code points; a token inside a character spans it."""
        if _SPECIAL in text:
            found = self.tokenizer().encode(text, add_special_tokens=False).offsets
            return tuple(np.array(found, dtype=np.int64).reshape(-1, 2).T)
        ends = np.cumsum(self.sizes[self.ids(text)])
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        if text.isascii():
            return starts, ends
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        place = np.cumsum((raw & 0xC0) != 0x80) - 1
        return place[starts], place[ends - 1] + 1
