"""Token ids of whole texts by the ``tokenizers`` library, with a bounded memo of white-space chunks.

The vocabulary's pattern never spans white space, so a text's ids are those of its chunks, one after
the other. Chunks that a worker has met before cost one dictionary look-up; unseen ones go to the
library, many at a time.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable
from functools import lru_cache
from itertools import islice

import numpy as np

#: One run of Latin letters, then perhaps one mark: a pre-token of letters and one of the mark.
_LETTERS, _MARKS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß", ".,;:!?|"
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|]?)")


class ChunkEncoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit bytes.

    ``capacity`` bounds the memo's entries; beyond it the third that was learnt first stays, which holds the frequent
    words.
    """

    def __init__(self, path: str, capacity: int = 400_000, joined: int = 2000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        as_bytes = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.byte_level = {ord(c): as_bytes(c)[0][0] for c in _LETTERS}
        self.marks = {c: np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, "<u4").tobytes() for c in ("", *_MARKS)}
        self.capacity, self.joined = capacity, joined
        self.memo: dict[str, bytes] = {"": b""}

    @staticmethod
    def chunks(text: str) -> list[str]:
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def learn(self, missing: Iterable[str]) -> None:
        """Plain chunks go straight to the library's BPE model, as the text that its normalizer and
        pre-tokenizer make of them; all others through the whole of the library."""
        other, tokenize = [], self.tokenizer.model.tokenize
        for chunk in missing:
            plain = _PLAIN.fullmatch(chunk)
            if plain is None:
                other.append(chunk)
                continue
            word, mark = plain.groups()
            ids = array("I", [t.id for t in tokenize(word.lower().translate(self.byte_level))])
            self.memo[chunk] = ids.tobytes() + self.marks[mark]
        for i in range(0, len(other), self.joined):
            part = other[i : i + self.joined]
            for chunk, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.memo[chunk] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for text in texts:
            chunks = self.chunks(text or "")
            parts = list(map(self.memo.get, chunks))
            try:
                out.append(b"".join(parts))
            except TypeError:  # some aren't known yet
                unknown = [i for i, p in enumerate(parts) if p is None]
                missing = {chunks[i] for i in unknown}
                if len(self.memo) + len(missing) > self.capacity:
                    self.memo = dict(islice(self.memo.items(), self.capacity // 3))
                self.learn(missing)
                for i in unknown:
                    parts[i] = self.memo[chunks[i]]
                out.append(b"".join(parts))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """One encoder for each worker process and vocabulary."""
    return ChunkEncoder(path)
