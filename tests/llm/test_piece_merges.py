import random

import pytest
import sentencepiece

from starlode.llm import pieces
from starlode.llm.merging import LONGEST
from starlode.llm.queries import tokenizer_file

PATH = tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def reference():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def ids(codec, texts):
    return [memoryview(d).cast("I").tolist() if d else [] for d in codec.encode(texts)]


def test_new_chunks_are_merged_without_the_library(reference, texts, monkeypatch):
    # Each new chunk was encoded by the library, a quarter of the query's time.
    codec, asked, rows = pieces.Codec(PATH), [], list(texts.values())
    whole = codec.by_library
    monkeypatch.setattr(codec, "by_library", lambda chunks: asked.extend(chunks) or whole(chunks))
    assert ids(codec, rows) == reference.encode(rows)
    assert len(asked) < 0.02 * len(codec.chunks)


def test_blocks_and_long_chunks(reference, monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK", 7)
    monkeypatch.setattr(pieces, "CACHE_CHUNKS", 60)
    codec, rng = pieces.Codec(PATH), random.Random(8)
    letters = "abeinst éß漢😀\n.1"
    rows = ["", "a" * (LONGEST - 1), "a" * LONGEST, "x" * 300 + " y"] + ["".join(rng.choice(letters) for _ in range(rng.randrange(25))) for _ in range(300)]
    for k in range(0, len(rows), 20):
        got = ids(codec, rows[k : k + 20])
        assert got == reference.encode(rows[k : k + 20])
        assert codec.decode(got) == rows[k : k + 20]
    assert codec.decode([]) == []
    broken = [[3 + 0xC3], got[-1], [3 + 0xE2, 3 + 0x96, 3 + 0x81, 3 + 0x41], []]
    assert codec.decode(broken) == codec.tokenizer.decode_batch(broken, skip_special_tokens=False)
