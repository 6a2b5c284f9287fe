import hashlib

import numpy as np
import pyarrow as pa

from starlode.llm import fingerprints as P
from starlode.llm import hashing


def words_by_hand(text):
    return [w for w in text.lower().replace("\n", " ").split(" ") if w]


def jaccard(a, b, k=5):
    sets = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set() for w in (words_by_hand(a), words_by_hand(b))]
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))


def test_words_of_a_buffer_do_not_depend_on_their_place():
    texts = ["a b", "", "b  a\tc ", " x", "a", "lang " * 50]
    data = "".join(texts).encode()
    at = np.cumsum([0, *map(len, texts)])
    found, counts = hashing.words(np.frombuffer(data, np.uint8), at)
    assert counts.tolist() == [2, 0, 3, 1, 1, 50]
    assert found[0] == found[3] == found[6] and found[1] == found[2] and len({*found.tolist()}) == 5


def test_segments_of_very_long_texts(monkeypatch):
    text = ("word%d " * 1) % 1 + " ".join(f"w{i % 97}" for i in range(5000))
    whole = P.signature(pa.array([text]))
    monkeypatch.setattr(hashing, "SEGMENT", 64)
    assert (P.signature(pa.array([text])) == whole).all()


def test_estimates_are_near_the_likeness():
    base = [f"w{i}" for i in range(600)]
    for keep in (600, 480, 300):
        other = base[:keep] + [f"x{i}" for i in range(600 - keep)]
        a, b = " ".join(base), " ".join(other)
        s = P.signature(pa.array([a, b]), 512)
        assert abs((s[0] == s[1]).mean() - jaccard(a, b)) < 0.07


def test_against_edits(documents, texts):
    rows = [(i, t) for i, t in texts.items() if i < 60] + [(1000, None), (1001, ""), (1002, "two words"), (1003, texts[3]), (1004, "é" * 7)]
    got = {r["doc_id"]: r for r in P.against_edits(documents(rows).repartition(5)).collect()}
    order = sorted((i for i, _ in rows), reverse=True)
    text = {i: t or "" for i, t in rows}
    for i, j in zip(order, order[1:] + order[:1], strict=True):
        k = len(text[i]) // 3
        edited = text[i][: len(text[i]) - k] + text[j][:k]
        assert got[i]["n_chars"] == len(text[i])
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own, other = got[i]["fingerprint"], got[j]["fingerprint"]
        assert got[i]["near_next"] == sum(own[a : a + 4] == other[a : a + 4] for a in range(0, 256, 4)) / 64
        assert 0 <= got[i]["near_edited"] <= 1
    assert got[1003]["fingerprint"] == got[3]["fingerprint"]


def test_single_row_follows_itself_and_empty_table(documents):
    row = P.against_edits(documents([(5, "one two three")])).first()
    assert row["near_next"] == 1.0 and P.against_edits(documents([])).count() == 0


def test_rows_without_id_and_repeated_rows(documents):
    got = P.against_edits(documents([(1, "a b c"), (1, "a b c"), (None, "x y"), (None, "z"), (2, "q")])).collect()
    assert len(got) == 5


def test_near_classes(documents):
    base = " ".join(f"w{i}" for i in range(200))
    near = base.replace("w100 ", "y ")
    rows = [(5, base), (3, near), (9, "other " * 3), (7, base), (11, None), (12, "")]
    got = {r["doc_id"]: r["class_id"] for r in P.near_classes(documents(rows)).collect()}
    assert jaccard(base, near) >= 0.8
    assert got == {5: 3, 3: 3, 7: 3, 9: 9, 11: 11, 12: 12}
