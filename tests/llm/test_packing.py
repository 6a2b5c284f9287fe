import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from starlode.llm import packing
from starlode.llm.queries import tokenizer_file

PATH = tokenizer_file("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_ids_of_words_are_the_ids_of_the_text(tokenizer, texts):
    rng = random.Random(3)
    letters = "abTé ß.,!?'s ll<|>1²İΣ漢\n\t́ "
    made = ["", "  ", "don't WE'RE x's", "a<|endoftext|>b <|STARTOFTEXT|>", "É é é", "end.) (x., \"q\""] + ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(4000)]
    ids = packing.word_ids(PATH)
    for text in made + list(texts.values())[:150]:
        assert np.frombuffer(ids.of(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_best_fit():
    rng = random.Random(1)
    for _ in range(50):
        lengths = [rng.randint(1, 100) for _ in range(rng.randint(0, 200))]
        bins, offsets, fill = packing.best_fit(lengths, 100)
        used = defaultdict(list)
        for b, o, n in zip(bins, offsets, lengths, strict=True):
            used[b].append((o, n))
        for b, parts in used.items():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at == fill[b] <= 100
        assert sum(2 * f <= 100 for f in fill) <= 1


def verify(rows, got, tokenizer, capacity=2048):
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        parts = sorted(by[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(-(-len(ids) // capacity)))
        for r in parts:
            cut = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == r["piece"] * capacity and r["length"] == min(capacity, len(ids) - r["start"])
            assert r["ids_crc32"] == zlib.crc32(np.array(cut, "<u4").tobytes())
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(sequences), sum(r["length"] for r in got)


@pytest.mark.parametrize("partitions, chunk", [(1, 65536), (9, 65536), (20, 3)])
def test_packing(documents, texts, tokenizer, partitions, chunk):
    rows = [*texts.items(), (1000, None), (1001, ""), (1002, "word " * 6000)]
    got = packing.pack(documents(rows).repartition(partitions), PATH, chunk=chunk).collect()
    bins, total = verify(rows, got, tokenizer)
    assert bins <= total / 2048 * 1.02 + 2 if chunk > 3 else bins <= total / 2048 * 1.15 + 2


def test_bin_numbers_never_meet():
    # Partition 262,144 at level 0 and node 0 at level 1 had the same numbers once.
    ranges = [(level, node, chunk) for level in (0, 1, 2) for node in (0, 1, 262_143, 262_144, (1 << 24) - 1) for chunk in (0, 1, (1 << 14) - 1)]
    firsts = sorted(packing.bin_base(*r, 1 << 20) for r in ranges)
    assert all(b - a >= 1 << 20 for a, b in zip(firsts, firsts[1:], strict=False)) and firsts[-1] + (1 << 20) < 1 << 63
    for bad in ((32, 0, 0, 1), (0, 1 << 24, 0, 1), (0, 0, 1 << 14, 1), (0, 0, 0, (1 << 20) + 1)):
        with pytest.raises(ValueError):
            packing.bin_base(*bad)


@pytest.mark.parametrize("node_items, most", [(32768, 5000), (500, 5150)])
def test_more_than_4096_underfull_bins_meet(spark, node_items, most):
    # Every document is a chunk and so a bin of its own; 5,000 of 1,300 tokens and as many of 700 make 5,000 sequences.
    rows = spark.range(10_000).selectExpr("id AS doc_id", "repeat('a ', CAST(if(id < 5000, 1299, 699) AS INT)) AS text")
    got = packing.pack(rows.repartitionByRange(8, "doc_id"), PATH, chunk=1, node_items=node_items).select("sequence_id", "length")
    sums = [r["n"] for r in got.groupBy("sequence_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()]
    assert max(sums) <= 2048 and sum(sums) == 10_000_000 and len(sums) <= most


def test_repeated_rows_rows_without_id_and_none(documents):
    got = packing.pack(documents([(1, "a b"), (1, "a b"), (None, "c")]), PATH).collect()
    assert len(got) == 3 and len({r["sequence_id"] for r in got}) == 1
    assert packing.pack(documents([]), PATH).count() == 0
