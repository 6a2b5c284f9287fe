import numpy as np
from test_dedup import brute, brute_lines, word_set
from test_langid import direct

import corpus_pipeline as P
from starlode.llm import langid, linededup, secrets
from starlode.llm.common import DOCUMENT_COLUMNS, written


def test_stages_one_by_one(spark, small, sf, texts):
    docs, seen = small, []
    for name, stage in P.STAGES[:-1]:
        after = written(stage(spark, docs, sf), name)
        assert after.columns == list(DOCUMENT_COLUMNS)
        seen.append({r["doc_id"]: r["text"] for r in after.collect()})
        docs = after
    language, lines, near, masked = seen
    assert len(language) >= 0.99 * len(texts) and all(texts[i] == t for i, t in language.items())
    assert all(any(linededup.normal(x) for x in t.split("\n")) for t in lines.values())
    kept = [linededup.normal(x) for t in lines.values() for x in t.split("\n") if x.strip()]
    assert len(kept) == len(set(kept))
    assert set(near) <= set(lines) and all(near[i] == lines[i] for i in near)
    scanner = secrets.default_scanner()
    assert set(masked) == set(near) and not any(scanner.base(t) for t in masked.values())
    packed = P.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in packed} == set(masked)


def test_copies_and_letterless_documents_go(spark, documents, sf):
    long = " ".join(f"the word{i % 50} and of" for i in range(80))
    docs = documents([(1, long), (2, long), (3, None), (4, "123 456"), (5, "the and of the other one is here")])
    for name, stage in P.STAGES[:-1]:
        docs = written(stage(spark, docs, sf), name)
    assert sorted(r["doc_id"] for r in docs.collect()) == [1, 5]


def by_id(frame):
    return {r["doc_id"]: r["text"] for r in frame.collect()}


def test_every_stage_equals_brute_force(spark, small, sf):
    docs = written(small.where("doc_id < 60").unionByName(small.where("doc_id < 3")), "some")  # three rows come twice
    before = by_id(docs)
    net = langid.fit(docs)
    language = written(P.language_filter(spark, docs, sf), "language")
    want = {i for i, t in before.items() if t and langid.has_letter(t) and direct(net, t).max() >= P.LEAST_SCORE}
    assert set(by_id(language)) == want and language.count() == len(want) + len({0, 1, 2} & want)
    once = written(language.distinct(), "once")  # the brute force knows documents by their ids
    lines = written(P.line_dedup(spark, once, sf), "lines")
    left = brute_lines(sorted(by_id(once).items()))
    assert by_id(lines) == {i: t for i, t in left.items() if any(x.strip() for x in t.split("\n"))}
    near = written(P.near_dedup(spark, language, sf), "near")
    part = brute({i: word_set(t, 5) for i, t in by_id(language).items()})
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(i for i, p in part.items() if i == p)
    masked = by_id(P.secret_masking(spark, near, sf))
    scanner = secrets.default_scanner()
    for i, text in by_id(near).items():
        hidden = np.zeros(len(text), bool)
        for a, _, b in scanner.spans(text)[1]:
            hidden[a:b] = True
        plain = "".join("\0" if h else c for c, h in zip(text, hidden, strict=True))
        assert masked[i].replace("[secret]", "") == plain.replace("\0", "") and masked[i].count("[secret]") >= len(set(scanner.spans(text)[1])) > 0 or masked[i] == text


def test_odd_tables(spark, documents, sf):
    for rows in ([], [(None, None), (None, None)], [(None, "the and of one"), (1, "the and of one"), (1, "the and of one"), (2, "")]):
        docs = documents(rows)
        for name, stage in P.STAGES:
            docs = written(stage(spark, docs, sf), name)
        assert docs.count() <= 1


def test_a_very_long_text_passes_whole(spark, documents, sf):
    text = "\n".join(f"the line of the number {i} and the other {i * 7919}" for i in range(25_000))  # beyond a slice
    docs = documents([(1, text), (2, "the and of that one is here")])
    for name, stage in P.STAGES[:4]:
        docs = written(stage(spark, docs, sf), name)
    got = by_id(docs)
    assert len(got[1]) > 1 << 20 and set(got[1].split("\n")) <= set(text.split("\n"))
