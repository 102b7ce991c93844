"""Token counts and the codec against the tokenizers library."""

import random

import pytest

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from tessera.llm.bpe import ForcedBoundaryCodec, encode_decode  # noqa: E402
from tessera.llm.registry import tokenizer_files  # noqa: E402
from tessera.llm.token_count import ResyncCounter, count_tokens  # noqa: E402

FILES = tokenizer_files()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILES["json_path"])


def texts():
    r = random.Random(1)
    parts = ["'", "s", "t", "re", " ", "  ", "\n", "\t", "é", "日", "#", "1", "Ab", "q", "z", "　", "\xa0", "<|endoftext|>", "<|endof", "ll", "\x1c", "\x85", "🎉", "'ve", "--"]
    out = ["".join(r.choice(parts) for _ in range(r.randint(0, 300))) for _ in range(400)]
    out += ["".join(f"a{chr(c)}b {chr(c)} '{chr(c)}s\n" for c in range(start, start + 64)) for start in [*range(0, 0x3100, 64), 0xFE00, 0xFF00, 0x1F300]]
    return out + ["ab" * 9000 + " cd" * 9000 + "x" * 20000]


def test_codec(library):
    for size in (2, 2048):
        codec = ForcedBoundaryCodec(**FILES, fragment_bytes=size, long_bytes=5000)
        for t in texts():
            ids = library.encode(t, add_special_tokens=False).ids
            assert codec.encode(t.encode()) == ids
            assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False).encode()


def test_counts(library):
    counters = [ResyncCounter(FILES["ranks_path"], FILES["json_path"], FILES["pattern"], *sizes) for sizes in ((64, 8), (1000, 100), (16_384, 512))]
    for t in texts():
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert [c.count(t) for c in counters] == [n] * 3
    assert counters[0].widened


def test_frames(docs, rows, empty, library):
    want = sorted((i is not None, i or 0, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    got = count_tokens(docs, **FILES).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    got = encode_decode(docs, **FILES, keep=("ids", "decoded")).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, len(r.ids)) for r in got) == want
    texts_of = {i: t or "" for i, t in rows}
    assert all(r.decoded == texts_of[r.doc_id] for r in got)
    assert count_tokens(empty, **FILES).count() == 0 and encode_decode(empty, **FILES).count() == 0
