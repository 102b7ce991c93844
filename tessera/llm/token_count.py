"""Token counts, with overlap resynchronisation for huge texts.

Texts up to ``chunk_chars`` characters are encoded at once.  A longer one is
encoded in chunks that overlap.  Each chunk's tokens have byte offsets, as the
vocabulary is byte-level: a token is as long as its bytes.  Two neighbouring
encodings are spliced at a token boundary which both have and which is proven
stable: non-space before it, white space at it.  There every scan of the
pre-tokeniser starts a new piece whatever came before, so the left chunk's
tokens up to it and the right chunk's tokens from it are those of the whole
text.  Where an overlap has no such place it is widened, twofold each time, up
to the whole chunk.

The engine is tiktoken on the ranks of the same vocabulary: it gives the ids of
the tokenizers library for this vocabulary (held together by the tests, over
all code points) at several times its speed.  Special tokens' strings are split
off first, as the library's default has it.  Where even a whole chunk has no stable place, the text up
to the next one goes to the tokenizers library itself.

Cases: null and empty texts have no bytes and no tokens.  Every input row gives
a row; repeated rows and null ids are kept.  Columns other than doc_id and text
are ignored.  No rows give no rows.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm._common import documents_only, slices

#: A stable place lies between its two characters.  Python's \\s has all that the pre-tokeniser's has.
_STABLE = re.compile(r"\S[ \t\n\r\x0b\x0c]")


class ResyncCounter:
    def __init__(self, ranks_path: str, json_path: str, pattern: str, chunk_chars: int = 16_384, overlap_chars: int = 512):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)
        with open(json_path, encoding="utf-8") as f:
            special = [x["content"] for x in json.load(f)["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.json_path, self.library = json_path, None
        self.chunk, self.overlap = chunk_chars, overlap_chars
        self.widened = 0

    def _library(self, text: str) -> int:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.json_path)
            self.library.no_truncation()
            self.library.no_padding()
            self.library.encode_special_tokens = True
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def _ends(self, text: str) -> np.ndarray:
        """The byte offset at which each token of ``text`` ends."""
        return np.cumsum(self.lengths[np.asarray(self.encoding.encode_ordinary(text), np.int64)])

    def _long(self, text: str) -> int:
        """Tokens of a text longer than a chunk: chunk, find the common boundary, splice."""
        total = base = 0  # tokens counted so far, and the character from which the rest is to be counted
        start, stop, skip = 0, self.chunk, 0  # the left chunk, and how many of its tokens lie before base
        left = self._ends(text[:stop])
        while stop < len(text):
            width = self.overlap
            while (found := self._splice(text, start, stop, width, base, left)) is None:
                if stop - width <= base:  # no stable place since base: up to the next one goes to the library
                    m = _STABLE.search(text, stop - 1)
                    place = m.start() + 1 if m else len(text)
                    total += self._library(text[base:place])
                    found = 0, -1, place, place, self._ends(text[place : place + self.chunk])
                    skip = 1
                    break
                width *= 2
                self.widened += 1
            i, j, begin, base, right = found
            total += i + 1 - skip
            start, stop, skip, left = begin, min(len(text), begin + self.chunk), j + 1, right
        return total + len(left) - skip

    def _splice(self, text: str, start: int, stop: int, width: int, base: int, left: np.ndarray):
        """Last token of the left and of the right chunk before a common stable boundary, the right chunk's start, the boundary, the right chunk's ends."""
        begin = stop - width
        if begin <= base or begin + self.chunk <= stop:
            return None
        right = None
        for m in _STABLE.finditer(text, begin, stop):
            place = m.start() + 1
            if right is None:
                right = self._ends(text[begin : begin + self.chunk])
            at_left, at_right = len(text[start:place].encode()), len(text[begin:place].encode())
            i, j = int(np.searchsorted(left, at_left)), int(np.searchsorted(right, at_right))
            if i < len(left) and left[i] == at_left and j < len(right) and right[j] == at_right:
                return i, j, begin, place, right
        return None

    def _ordinary(self, text: str) -> int:
        return self._long(text) if len(text) > self.chunk else len(self.encoding.encode_ordinary(text))

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self._ordinary(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self._ordinary(p) for p in parts if p)


SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def count_tokens(documents: DataFrame, ranks_path: str, json_path: str, pattern: str, limit: int = 512, chunk_chars: int = 16_384, overlap_chars: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = ResyncCounter(ranks_path, json_path, pattern, chunk_chars, overlap_chars)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in slices(texts):
                n_bytes = [len(t.encode()) if t else 0 for t in texts[i:j]]
                n = [counter.count(t) if t else 0 for t in texts[i:j]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n_bytes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return documents_only(documents).mapInArrow(run, SCHEMA)
