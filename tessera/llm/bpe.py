"""BPE encoding and decoding by forced-boundary splitting.

A merge can join two neighbouring symbols only if their concatenation is a
token, so a pair of bytes that occurs inside no token of the vocabulary is never
joined: between them the text can be cut and both sides encoded on their own.
Prose has such a pair at nearly every word end, so a text falls into fragments
of about any wished size, and even a run without white space is bounded.

A cut must also leave the pre-tokeniser's splitting as it was.  That splitter
scans from the left without look-behind; it looks ahead only past white space,
and it treats an apostrophe with the letters after it as one piece.  So no cut
is made after white space, before an apostrophe, or inside a character.

Cases: null and empty texts have no tokens and decode to the empty text.  A
special token's string inside a text becomes that token, as by the library's
default.  Every input row gives a row; repeated rows and null ids are kept.
Columns other than doc_id and text are ignored.  No rows give no rows.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm._common import documents_only, sha, slices, utf8

#: Last bytes of the UTF-8 forms of white space outside ASCII, and white space and separators in ASCII.
_SPACE_ENDS = {0x85, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF, *range(0x80, 0x8B), *range(0x00, 0x21), 0x7F}


def cut_table(tokens: list[bytes]) -> np.ndarray:
    """For each pair of bytes (first << 8 | second), whether it always marks a cut."""
    inside = np.zeros(1 << 16, bool)
    for t in tokens:
        if len(t) > 1:
            a = np.frombuffer(t, np.uint8).astype(np.int64)
            inside[a[:-1] << 8 | a[1:]] = True
    first, second = np.divmod(np.arange(1 << 16), 256)
    return ~inside & ((second & 0xC0) != 0x80) & (second != 0x27) & ~np.isin(first, list(_SPACE_ENDS))


class ForcedBoundaryCodec:
    """Encodes and decodes with a byte-level BPE file of the tokenizers library.

    ``ranks_path`` holds the same vocabulary for tiktoken, which encodes the
    fragments; one without any cut over ``long_bytes`` goes to the tokenizers library.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str, fragment_bytes: int = 2048, long_bytes: int = 20_000):
        import tiktoken

        self.json_path, self.library = json_path, None
        self.fragment_bytes, self.long_bytes = fragment_bytes, long_bytes
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        with open(json_path, encoding="utf-8") as f:
            self.special = {x["content"].encode(): x["id"] for x in json.load(f)["added_tokens"]}
        self.special_of = {i: s for s, i in self.special.items()}
        self.special_split = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")") if self.special else None
        self.cut_table = cut_table([*ranks, *self.special])
        self.decimal = [str(i) for i in range(max([*ranks.values(), *self.special.values()]) + 1)]

    def fragments(self, data: bytes) -> list[bytes]:
        """``data`` cut at the first certain cut after each ``fragment_bytes`` bytes."""
        if len(data) <= self.fragment_bytes:
            return [data]
        a = np.frombuffer(data, np.uint8)
        cuts = np.flatnonzero(self.cut_table[a[:-1].astype(np.uint16) << np.uint16(8) | a[1:]]) + 1
        at = np.searchsorted(cuts, np.arange(self.fragment_bytes, len(data), self.fragment_bytes))
        ends = [*np.unique(cuts[at[at < len(cuts)]]).tolist(), len(data)]
        return [data[i:j] for i, j in zip([0, *ends[:-1]], ends)]

    def _encode_long(self, text: str) -> list[int]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.json_path)
            self.library.no_truncation()
            self.library.no_padding()
            self.library.encode_special_tokens = True
        return self.library.encode(text, add_special_tokens=False).ids

    def _plain(self, data: bytes) -> list[int]:
        out: list[int] = []
        for piece in self.fragments(data):
            text = piece.decode("utf-8")
            out += self._encode_long(text) if len(piece) > self.long_bytes else self.encoding.encode_ordinary(text)
        return out

    def encode(self, data: bytes) -> list[int]:
        """The ids of a whole text in UTF-8."""
        if not data:
            return []
        if self.special_split is None or not self.special_split.search(data):
            return self._plain(data)
        out: list[int] = []
        for part in self.special_split.split(data):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self._plain(part)
        return out

    def joined(self, ids: list[int]) -> bytes:
        return ",".join(map(self.decimal.__getitem__, ids)).encode()

    def decode(self, ids: list[int]) -> bytes:
        """The text of ids; bytes that aren't UTF-8 become replacement characters."""
        if self.special_of.keys().isdisjoint(ids):
            data = self.encoding.decode_bytes(ids)
        else:
            data = b"".join(self.special_of[i] if i in self.special_of else self.encoding.decode_single_token_bytes(i) for i in ids)
        try:
            data.decode("utf-8")
        except UnicodeDecodeError:
            data = data.decode("utf-8", "replace").encode("utf-8")
        return data


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_decode(documents: DataFrame, json_path: str, ranks_path: str, pattern: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns doc_id, n_tokens, ids (array of int) and decoded text if named in
    ``keep``, and the digests of both.  One narrow pass, no shuffle.
    """
    more = {"ids": ("ids array<int>", pa.list_(pa.int32())), "decoded": ("decoded string", pa.string())}
    keep = tuple(k for k in more if k in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ForcedBoundaryCodec(json_path, ranks_path, pattern)
        for batch in batches:
            texts = utf8(batch.column(1))
            for i, j in slices(texts):
                rows: list[list] = [[] for _ in range(5)]
                for data in texts[i:j]:
                    ids = codec.encode(data or b"")
                    decoded = codec.decode(ids)
                    rows[0].append(len(ids))
                    rows[1].append(sha(codec.joined(ids)))
                    rows[2].append(sha(decoded))
                    if "ids" in keep:
                        rows[3].append(ids)
                    if "decoded" in keep:
                        rows[4].append(decoded.decode("utf-8"))
                columns = [batch.column(0).slice(i, j - i), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())]
                columns += [pa.array(rows[3 + (k == "decoded")], more[k][1]) for k in keep]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *keep])

    return documents_only(documents).mapInArrow(run, ", ".join([SCHEMA, *(more[k][0] for k in keep)]))
