import random
from collections import defaultdict

import pyarrow as pa
import pytest

from starlode.llm import components, linededup, links, neardup


class Forest:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def brute(sets, percent=80):
    """Smallest key reachable, by comparing all pairs of sets that are not empty."""
    forest, keys = Forest(), sorted(sets)
    for i, a in enumerate(keys):
        forest.find(a)
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= max(len(x), len(y)) * percent and len(x & y) * 100 >= len(x | y) * percent:
                forest.join(a, b)
    return {k: forest.find(k) for k in keys}


def word_set(text, k):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def variants(n, seed):
    """Texts in families of copies with a few words changed: many likenesses near 0.8."""
    rng, out = random.Random(seed), []
    while len(out) < n:
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 8, 30, 120]))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 15) + 1)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(1000)}"
            out.append(" ".join(copy))
    rng.shuffle(out)
    return out[:n]


@pytest.mark.parametrize("small", [0, 500_000])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(components, "SMALL", small)
    chain = [(i, i + 1) for i in range(60)] + [(100, 90), (90, 100), (7, 7), (200, 201), (None, 5)]
    got = {r["node"]: r["component"] for r in components.connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {90: 90, 100: 90, 200: 200, 201: 200}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("k, bands, rows", [(4, 30, 5), (5, 30, 5), (4, 60, 2)])
def test_near_duplicates_equal_brute_force(documents, k, bands, rows):
    made = variants(250, k + bands)
    table = [(3 * i + 1, t) for i, t in enumerate(made)] + [(2, None), (5, ""), (8, " \t"), (11, made[0]), (14, made[0])]
    want = brute({i: word_set(t, k) for i, t in table})
    got = neardup.near_duplicates(documents(table), shingle=k, bands=bands, rows=rows).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(got) == len(table)
    assert all(r["n_shingles"] == len(word_set(dict(table)[r["doc_id"]], k)) and r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("sketched", [True, False])
def test_mixed_buckets_lose_no_link(documents, monkeypatch, sketched):
    if not sketched:
        monkeypatch.setattr(links, "sketch_columns", lambda frame: [])
    made = variants(120, 77)
    got = neardup.near_duplicates(documents(list(enumerate(made))), shingle=4, bands=60, rows=1).collect()  # every bucket is mixed
    assert {r["doc_id"]: r["component_id"] for r in got} == brute({i: word_set(t, 4) for i, t in enumerate(made)})


def test_rows_without_id_repeated_rows_and_none(documents):
    got = neardup.near_duplicates(documents([(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (None, None)])).collect()
    assert len(got) == 4 and all(r["kept"] for r in got)
    assert neardup.near_duplicates(documents([])).count() == 0
    kept = neardup.deduplicated(documents([(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, "")]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]


def test_one_of_identical_rows_and_of_rows_without_id_stays(documents):
    same, odd = "a b c d e f", "u v w x y z"
    rows = [(7, same), (7, same), (7, same), (None, same), (None, odd), (None, odd), (9, odd), (9, "k l m n o p"), (None, None), (None, None)]
    kept = [(r["doc_id"], r["text"]) for r in neardup.deduplicated(documents(rows)).collect()]
    assert sorted(kept, key=repr) == sorted([(7, same), (9, odd), (9, "k l m n o p"), (None, None), (None, None)], key=repr)
    alone = neardup.deduplicated(documents([(None, odd)] * 5)).collect()
    assert [(r["doc_id"], r["text"]) for r in alone] == [(None, odd)]
    assert neardup.deduplicated(documents([])).count() == 0


def test_rows_that_share_an_id_are_judged_by_their_own_sets(documents):
    texts = ["a b c d e f g", "h i j k l m n"]
    got = neardup.near_duplicates(documents([(1, texts[0]), (1, texts[1]), (2, texts[0]), (3, texts[1]), (4, texts[1])])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 1)]
    got = neardup.near_duplicates(documents([(5, texts[0]), (5, texts[1]), (2, texts[0]), (3, texts[1])])).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [(2, 2, True), (3, 3, True), (5, 2, False), (5, 3, False)]


def test_densified_signatures_estimate_likeness():
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (300, 330, 6)]
    values, counts = neardup.shingle_sets(pa.array(texts), 4)
    s = neardup.one_permutation(values, counts, 512)
    assert abs((s[0] == s[1]).mean() - 297 / 327) < 0.06
    assert len(set(s[2].tolist())) <= 3  # three shingles


def line_set(line, k=linededup.SHINGLE):
    return frozenset(line[i : i + k] for i in range(max(1, len(line) - k + 1))) if line else frozenset()


def brute_lines(table):
    places = sorted((i, p, linededup.normal(line)) for i, t in table for p, line in enumerate((t or "").split("\n")) if line.strip())
    names = sorted({n for *_, n in places})
    part = brute({j: line_set(n) for j, n in enumerate(names)})
    code, first = {n: part[j] for j, n in enumerate(names)}, {}
    gone = defaultdict(set)
    for i, p, n in places:
        if first.setdefault(code[n], (i, p)) != (i, p):
            gone[i].add(p)
    return {i: t if t is None else "\n".join(line for p, line in enumerate(t.split("\n")) if p not in gone[i]) for i, t in table}


def test_line_dedup_equals_brute_force(documents):
    rng = random.Random(9)
    pool = variants(60, 5) + ["short", "Short ", "tiny", "", "  "]
    table = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 7)))) for i in range(40)] + [(50, None), (51, ""), (52, "\n\n")]
    got = {r["doc_id"]: r for r in linededup.deduplicated(documents(table)).collect()}
    want = brute_lines(table)
    assert {i: r["text"] for i, r in got.items()} == want
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got.values())
    assert all(r["n_kept"] == sum(bool(x.strip()) for x in (r["text"] or "").split("\n")) for r in got.values())


def test_line_dedup_on_odd_rows(documents):
    got = linededup.deduplicated(documents([(None, "one line of text here\none line of text here"), (1, "same"), (1, "same"), (2, "same")])).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == [(0, "one line of text here\none line of text here"), (1, "same"), (1, "same"), (2, "")]
    assert linededup.deduplicated(documents([])).count() == 0 and linededup.summary(documents([(1, None)])).first()["n_lines"] == 0
