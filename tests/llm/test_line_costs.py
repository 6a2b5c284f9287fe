import random

import numpy as np
import pyarrow as pa
import pytest

from starlode.llm import hashing, linededup, links

LINES = ["", "a", "short", "eightly8", "nine char", "aaaaaaaaaaaaaaaa", "The quick brown fox jumps over the lazy dog", "ß" * 7, "日本語のテキストです。日本語"]


@pytest.mark.parametrize("kind", [np.uint32, np.uint64])
@pytest.mark.parametrize("k", [1, 3, 8])
def test_padded_shingles_are_the_same_sets(kind, k):
    codes, at = linededup.codes_of(LINES)
    plain = hashing.char_shingles(codes, at, k, kind)
    padded = hashing.char_shingles(codes, at, k, kind, padded=True)
    assert padded[1].tolist() == [len(line) for line in LINES]
    for a, b in zip(hashing.distinct(*plain), hashing.distinct(*padded), strict=True):
        assert a.tolist() == b.tolist()
    if kind is np.uint32:
        assert (hashing.minhash(*plain, 6, 1) == hashing.minhash(*padded, 6, 1)).all()


def test_only_items_that_meet_across_components_have_long_sketches(spark, documents, monkeypatch):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    # One bucket of pairs of like lines, unlike from pair to pair, and a second one of two like lines alone.
    lines = [line for base in (word(60) for _ in range(12)) for line in (base, base[:-1])]
    *many, e, f = lines
    names = {line: linededup.line_name(line)[0] for line in lines}
    rows = [(b, names[x], names[c0], names[c1]) for b, group, c0, c1 in ((1, many, many[0], many[2]), (2, [e, f], e, f)) for x in group]
    members = spark.createDataFrame(rows, "bucket long, item long, c0 long, c1 long")
    payload = linededup.line_texts(documents([(1, "\n".join(lines))]), members.select("item").distinct(), linededup.SHINGLE)
    assert len(links.sketch_columns(payload)) == linededup.SHORT // 64 < linededup.SKETCH // 64

    made, widened = [], links.widened

    def seen(rows, sets, size):
        made.append({r["item"] for r in rows.select("item").collect()})
        return widened(rows, sets, size)

    monkeypatch.setattr(links, "widened", seen)
    sets = lambda texts: linededup.line_sets(texts, linededup.SHINGLE)
    found = [{tuple(r) for r in links.linked(members, payload, sets, linededup.PERCENT, *size).collect()} for size in ((linededup.SKETCH,), ())]
    pairs = [(names[a], names[b]) for a, b in zip(lines[::2], lines[1::2], strict=True)]
    assert found[0] == found[1] == {(x, min(p)) for p in pairs for x in p}
    assert len(made) == 1 and made[0] == {names[x] for x in many} - {names[many[0]], names[many[2]]}


def test_long_sketches_are_the_parities_of_the_lines(spark, documents):
    line = "a line of words that is long enough to have several shingles"
    name = linededup.line_name(line)[0]
    payload = linededup.line_texts(documents([(1, line)]), spark.createDataFrame([(name,)], "item long"), linededup.SHINGLE)
    sets = lambda texts: linededup.line_sets(texts, linededup.SHINGLE)
    row = links.widened(payload, sets, linededup.SKETCH).collect()[0]
    assert list(row["wide"]) == links.parities(*sets(pa.array([line])), linededup.SKETCH)[0].tolist()
