import zlib
from collections import Counter, defaultdict

import pytest

from starlode.llm import sharding


def check(rows, got, shards=16):
    assert len(got) == len(rows)
    counts = Counter(r["shard"] for r in got)
    sizes = [counts.get(j, 0) for j in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert want == Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got)


def cut_links(rows, got):
    text = dict(rows)
    groups = defaultdict(Counter)
    for r in got:
        groups[text[r["doc_id"]]][r["shard"]] += 1
    return sum(sum(c.values()) - max(c.values()) for c in groups.values())


def test_documents(small, texts):
    got = sharding.assign(small).collect()
    check(list(texts.items()), got)
    assert cut_links(texts.items(), got) <= 2


def test_many_groups_meet(documents):
    rows = [(i, f"group {i % 200}" if i < 1000 else f"alone {i}") for i in range(2000)]
    got = sharding.assign(documents(rows)).collect()
    check(rows, got)
    assert cut_links(rows, got) <= 40  # 800 links; some groups may have to be cut where shares end


def test_a_group_of_a_third_is_split_evenly(documents):
    rows = [(i, "copy" if i % 3 == 0 else f"alone {i}") for i in range(3000)]
    check(rows, sharding.assign(documents(rows)).collect())


def test_all_equal_and_no_singles(documents):
    check([(i, "same") for i in range(100)], sharding.assign(documents([(i, "same") for i in range(100)])).collect())
    rows = [(i, f"pair {i // 2}") for i in range(160)]
    check(rows, sharding.assign(documents(rows)).collect())


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, None), (2, ""), (None, "x"), (None, None), (7, "é"), (7, "é")]])
def test_small_and_odd_tables(documents, rows):
    check(rows, sharding.assign(documents(rows)).collect())


def test_partitioning_does_not_matter(documents):
    rows = [(i, f"t{i % 37}") for i in range(400)]
    runs = [{(r["doc_id"], r["shard"], r["slot"]) for r in sharding.assign(documents(rows).repartition(n)).collect()} for n in (1, 7)]
    assert runs[0] == runs[1]


def test_no_python_on_the_way(documents):
    plan = sharding.assign(documents([(1, "a"), (2, "a")]))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
