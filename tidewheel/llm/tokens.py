"""Token counts of whole texts under a public byte-level BPE vocabulary.

The vocabulary is read from ``path`` (a parameter; by default the file that the
installed ``public_tokenizers`` package names).  Texts are cut in front of line
feeds that follow a non-blank: the tokenizer's own pattern always cuts there, so
the counts of the pieces add up to the count of the text, exactly.  Counts of
pieces are remembered per Python worker (revisions of a page share most lines);
the memory is bounded by MEMO_CHARS and emptied when full.

Defined cases: a null text counts 0, as does an empty one.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MEMO_CHARS = 40_000_000
LONGEST_REMEMBERED = 2_000
_CUT = re.compile(r"(?<=\S)(?=\n)")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer of a rank file (a line per token: base64, rank)."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Counter:
    """Counts tokens of texts, remembering short pieces."""

    def __init__(self, path: str):
        self.encode = encoding(path).encode_ordinary
        self.memo: dict[str, int] = {}
        self.chars = 0

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        total = 0
        for piece in _CUT.split(text):
            n = self.memo.get(piece)
            if n is None:
                n = len(self.encode(piece))
                if len(piece) <= LONGEST_REMEMBERED:
                    self.chars += len(piece) + 80
                    if self.chars > MEMO_CHARS:
                        self.memo.clear()
                        self.chars = len(piece) + 80
                    self.memo[piece] = n
            total += n
        return total


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    """One per Python worker and vocabulary."""
    return Counter(path)


def token_count(text: Column, path: str | None = None) -> Column:
    """The number of tokens (int) of a string column."""
    vocabulary = path or default_vocabulary()

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        from tidewheel.llm.tokens import counter as shared

        c = shared(vocabulary)
        return pd.Series([c.count(t) for t in texts], dtype="int32")

    return count(text)
