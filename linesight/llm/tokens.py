"""Token ids of whole texts by a public tokenizer file."""

from __future__ import annotations

import base64
import os

import numpy as np


class Encoder:
    """``encode`` gives the ids that ``tokenizers`` gives for the JSON file.

    Where a rank file of the same vocabulary lies beside it (same name, ending
    ``.tiktoken``) and the split pattern is given, plain text goes through
    ``tiktoken``, which is several times faster on the same merges.  Texts that
    hold the string of an added token go through ``tokenizers`` itself."""

    def __init__(self, path: str, pattern: str | None = None):
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.exact = Tokenizer.from_file(path)
        self.added = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        ranks = path.removesuffix(".json") + ".tiktoken"
        self.fast = None
        if pattern and os.path.exists(ranks):
            import tiktoken
            with open(ranks, "rb") as f:
                pairs = dict(line.split() for line in f if line.strip())
            merges = {base64.b64decode(a): int(b) for a, b in pairs.items()}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or any(t in text for t in self.added):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, pattern: str | None = None) -> Encoder:
    """The worker's encoder for a file, loaded once per process."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def byte_bpe_50k() -> tuple[str, str]:
    """Path and split pattern of the 50k byte-level vocabulary."""
    import public_tokenizers as P
    return P.path("byte_bpe_50k.json"), P.PATTERN
