import random

import numpy as np
import pytest
from tokenizers import Tokenizer, models

from starlode.llm import packing
from starlode.llm.merging import LONGEST, Merges
from starlode.llm.queries import tokenizer_file

PATH = tokenizer_file("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def listed(data):
    return np.frombuffer(data, "<u4").tolist()


@pytest.mark.parametrize("seed", range(6))
def test_merges_are_those_of_the_library(seed):
    # Random merges, so that a merge may make pairs of a lower rank than its own, and many slots of the table collide.
    rng = random.Random(seed)
    vocab, found = {c: i for i, c in enumerate("abcd")}, []
    while len(found) < 300:
        a, b = (rng.choice([x for x in vocab if len(x) < 5]) for _ in range(2))
        if (a, b) not in found:
            found.append((a, b))
            vocab.setdefault(a + b, len(vocab))
    rng.shuffle(found)
    library = Tokenizer(models.BPE(vocab, found))
    words = ["".join(rng.choice("abcd") for _ in range(rng.choice([1, 2, 3, 5, 9, 17, LONGEST]))) for _ in range(2000)]
    symbols, lengths = np.array([vocab[c] for w in words for c in w], np.int32), np.array([len(w) for w in words])
    merges = Merges(((vocab[a], vocab[b], vocab[a + b]) for a, b in found), len(vocab))
    left, counts = merges.merged(symbols, np.cumsum(lengths) - lengths, lengths)
    ends = np.cumsum(counts)
    assert [left[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)] == [library.encode(w).ids for w in words]
    with pytest.raises(ValueError, match="more than"):
        merges.merged(np.zeros(LONGEST + 1, np.int32), np.array([0]), np.array([LONGEST + 1]))


def test_new_words_are_merged_without_the_library(tokenizer, texts, monkeypatch):
    # Each new word was a call of the library of its own: most of the query's time.
    ids, asked = packing.WordIds(PATH), []
    monkeypatch.setattr(ids, "by_library", lambda word: asked.append(word) or packing.WordIds.by_library(ids, word))
    rows = list(texts.values())
    assert [listed(d) for d in ids.of_all(rows)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in rows]
    assert len(asked) < 0.02 * len(ids.known)


ODD = ["ȺƁx", "x²¼9", "'s 'll don't", "a b\u0085c­", "Éé", "w" * (LONGEST + 1) + ".", "é" * 40 + " " + "1" * 90, "<a> a<|b", "..'..", "ªŉǅ", "a\x00b \x7f", ""]


def test_odd_words(tokenizer):
    for text in [*ODD, " ".join(ODD), *(f"ab{chr(c)}Cd {chr(c)}" for c in range(1, 0x300))]:
        assert listed(packing.WordIds(PATH).of(text) if text in ODD else packing.word_ids(PATH).of(text)) == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_words_are_forgotten_and_long_texts_cut(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    monkeypatch.setattr(packing, "BLOCK_WORDS", 30)
    ids, rng = packing.WordIds(PATH), random.Random(4)
    rows = [" ".join("".join(rng.choice("abcdé.") for _ in range(4)) for _ in range(n)) for n in (10, 0, 29, 31, 200)]
    assert [listed(d) for d in ids.of_all(rows)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in rows]
    assert len(ids.known) <= 50


def test_other_rules_are_left_to_the_library(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as f:
        rules = json.load(f)
    rules["pre_tokenizer"]["pretokenizers"][0]["pattern"] = {"Regex": "[\\p{L}]+|[\\p{N}]+|[^\\s\\p{L}\\p{N}]+"}
    (tmp_path / "other.json").write_text(json.dumps(rules))
    ids = packing.WordIds(str(tmp_path / "other.json"))
    assert ids.merges is None
    assert listed(ids.of("abc 1234 x.y")) == ids.tokenizer.encode("abc 1234 x.y", add_special_tokens=False).ids
