import random

from starlode.llm import linededup, links


def test_no_pair_of_short_lines_at_the_threshold_is_turned_down(spark, documents):
    rng = random.Random(4)
    pairs = []
    for _ in range(4000):  # four of five shingles shared
        longer = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12))
        pairs.append((longer[:-1], longer))
    names = [linededup.line_name(line)[0] for pair in pairs for line in pair]
    docs = documents([(1, "\n".join(line for pair in pairs for line in pair))])
    payload = linededup.line_texts(docs, spark.createDataFrame([(i,) for i in names], "item long"), linededup.SHINGLE)
    marks = links.sketch_columns(payload)
    rows = {r["item"]: [r["n"], *[r[m] for m in marks]] for r in payload.collect()}
    both = [rows[a] + rows[b] for a, b in zip(names[::2], names[1::2], strict=True)]
    columns = ["n", *marks, "c_n", *[f"c_{m}" for m in marks]]
    frame = spark.createDataFrame(both, ", ".join(f"{c} long" for c in columns))
    assert {(r[0], r[len(marks) + 1]) for r in both} == {(4, 5)}
    assert frame.where(links.near_enough(marks, "c_", linededup.PERCENT)).count() == len(pairs)
