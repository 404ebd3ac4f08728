"""Byte-level BPE of whole texts by tiktoken, over the ranks of a tokenizer file.

Used where ids are needed but how they are found isn't the operator's own work. Merges must be
ranked as their tokens' ids are (checked; else this library's encoder does all). Pieces of over
LONG characters, on which tiktoken takes more than linear time, go to this library's encoder.
"""

from __future__ import annotations

import json
import re

import numpy as np
import tiktoken

from usagelens.llm.bpe import PATTERN, Bpe, byte_of_char

LONG = 1000
BLANK = re.compile(r"\s{%d}" % LONG)


class Ranks:
    def __init__(self, content: str):
        self.bpe = Bpe(content)
        spec = json.loads(content)
        to_byte, vocab = byte_of_char(), spec["model"]["vocab"]
        added = {t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(to_byte[c] for c in t): i for t, i in vocab.items() if i not in added}
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        alike = made == sorted(set(made)) and len(made) + 256 == len(ranks)
        self.quick = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if alike else None

    def plain(self, text: str) -> np.ndarray:
        """Ids of a text in which special tokens are plain text."""
        if self.quick is None or len(text) > LONG and (BLANK.search(text) or max(map(len, text.split()), default=0) > LONG):
            get = self.bpe.known
            return np.frombuffer(b"".join([get(p) for p in self.bpe.cut.findall(text)]), dtype=np.int32)
        return np.array(self.quick.encode_ordinary(text), dtype=np.int32)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text in which special tokens are themselves."""
        if self.bpe.cut_added is not None and self.bpe.cut_added.search(text):
            return self.bpe.encode(text)
        return self.plain(text)


_LOADED: dict[int, Ranks] = {}


def loaded(content: str) -> Ranks:
    """The encoder of this content, made once in a Python worker."""
    if hash(content) not in _LOADED:
        _LOADED[hash(content)] = Ranks(content)
    return _LOADED[hash(content)]
