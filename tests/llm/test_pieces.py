import random
import struct

import pytest
import sentencepiece

from starlode.llm import pieces
from starlode.llm.queries import tokenizer_file

PATH = tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def codec():
    return pieces.codec(PATH)


@pytest.fixture(scope="module")
def reference():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def ids(codec, texts):
    return [memoryview(d).cast("I").tolist() if d else [] for d in codec.encode(texts)]


def test_parsed_model(codec, reference):
    assert len(codec.model.pieces) == reference.get_piece_size() and codec.model.kind == 2 and codec.model.byte_fallback
    for i in (0, 3, 300, 31999):
        assert codec.model.pieces[i][0] == reference.id_to_piece(i)
        assert codec.model.pieces[i][1] == pytest.approx(reference.get_score(i))


def test_parity_on_made_up_texts(codec, reference):
    rng = random.Random(5)
    letters = "abcT,.▁ \n\t!?é漢😀<>0x'\"-|"
    texts = ["", " ", "  a  b", "<s> </s> <0x41>", "a▁b", "x" * 5000] + ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)]
    assert ids(codec, texts) == reference.encode(texts)
    assert [e.ids for e in codec.tokenizer.encode_batch(texts, add_special_tokens=False)] == reference.encode(texts)


def test_parity_and_roundtrip_on_documents(codec, reference, texts):
    rows = list(texts.values())
    got = ids(codec, rows)
    assert got == reference.encode(rows)
    assert codec.decode(got) == rows


def test_decoding_bytes_that_are_no_text(codec):
    rng = random.Random(6)
    rows = [[rng.randrange(3, 32000) for _ in range(8)] for _ in range(500)] + [[3 + 0xC3], [3 + 0xC3, 3 + 0xA9], []]
    assert codec.decode(rows) == codec.tokenizer.decode_batch(rows, skip_special_tokens=False)
    with pytest.raises(ValueError, match="outside"):
        codec.decode([[32000]])


def test_columns(documents):
    docs = documents([(1, "Hello wörld"), (2, None), (3, ""), (1, "Hello wörld"), (None, "x")])
    encoded = pieces.encode(docs, PATH)
    assert [r["text"] for r in pieces.decode(encoded, PATH).where("doc_id = 1").collect()] == ["Hello wörld"] * 2
    got = pieces.verified(docs, PATH).collect()
    assert all(r["parity"] and r["roundtrip"] for r in got) and len(got) == 5
    assert pieces.verified(documents([]), PATH).count() == 0


def test_unigram_models(codec):
    model = pieces.Model([("<unk>", 0.0, pieces.UNKNOWN), ("▁", -3.0, 1), ("▁ab", -1.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -4.0, 1)], kind=1)
    tokenizer = pieces.rebuild(model)
    assert tokenizer.encode("ab  ab", add_special_tokens=False).tokens == ["▁ab", "▁ab"]
    assert tokenizer.decode(tokenizer.encode("ab a").ids) == "ab a"


def field(number, value):
    """A field of a protobuf message, for models made by hand."""

    def varint(n):
        return bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def made_model(kind, squeeze, user=()):
    rng = random.Random(11)
    entries = [("<unk>", 0.0, pieces.UNKNOWN), ("<s>", 0.0, pieces.CONTROL), ("</s>", 0.0, pieces.CONTROL)]
    entries += [(f"<0x{b:02X}>", 0.0, pieces.BYTE) for b in range(256)] + [(u, 0.0, pieces.USER) for u in user]
    words = ["▁the", "▁table", "▁tab", "▁stable", "able", "▁an", "ant", "▁é", "été"]
    parts = {w[i:j] for w in words for i in range(len(w)) for j in range(i + 1, len(w) + 1)} - set(user)
    if kind == 1:
        entries += [(p, -1.0 - 2 * len(p) * rng.random() - rng.random(), pieces.NORMAL) for p in sorted(parts)]
    else:
        entries += [(p, -float(i), pieces.NORMAL) for i, p in enumerate(sorted(parts, key=lambda p: (-len(p), p)))]
    data = b"".join(field(1, field(1, p) + field(2, s) + field(3, k)) for p, s, k in entries)
    return data + field(2, field(3, kind) + field(35, 1)) + field(3, field(1, "identity") + field(3, 1) + field(4, int(squeeze)) + field(5, 1))


@pytest.mark.parametrize("squeeze", [True, False])
@pytest.mark.parametrize("kind, user", [(1, ()), (1, ("<x>", "<xx>")), (2, ()), (2, ("<x>", "<xx>"))])
def test_parity_of_models_made_by_hand(tmp_path, kind, user, squeeze):
    path = tmp_path / "made.model"
    path.write_bytes(made_model(kind, squeeze, user))
    own, rng = pieces.Codec(str(path)), random.Random(12)
    bits = ["the", "table", "stable", "an", "ant", "été", "a", "b", "l", " ", " ", "  ", "漢", "😀", "z", "\n", *(["<x>", "<xx>", "<"] if user else [])]
    texts = ["", " ", "the table", "  the  an "] + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(1500)]
    reference = sentencepiece.SentencePieceProcessor(model_proto=path.read_bytes())
    assert own.model.kind == kind and own.model.squeeze == squeeze
    assert ids(own, texts) == reference.encode(texts)
