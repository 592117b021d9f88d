"""What line dedup and near duplicates store on their way."""

import random
from collections import Counter

import pytest

from plumbline.llm import common, lines, minhash


@pytest.fixture
def kept(monkeypatch):
    """(name, columns, rows) of the tables that an operator stores."""
    out = []

    def recording(module):
        store = module.stored

        def stored(df, name="t"):
            made = store(df, name)
            out.append((name, made.columns, made))
            return made

        monkeypatch.setattr(module, "stored", stored)

    recording(lines)
    recording(minhash)
    return out


def test_rounds_do_not_grow_with_the_longest_repeat(spark, kept):
    """A passage of 300 lines is found by common prefixes of at most as many lines as it takes to ``min_words`` words; its end has fewer words than that."""
    rnd = random.Random(4)
    passage = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice((1, 2, 9)))) for _ in range(300)] + ["end of it"]
    texts = [["a b"] + passage, ["c d"] + passage[40:] + ["e f"], passage[:120] + ["g h"] + passage[200:]]
    df = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(r["doc_id"], r["line_no"]) for r in lines.repeated_lines(df, 10).collect()}
    assert got == {(1, i) for i in range(1, 262)} | {(2, i) for i in [*range(120), *range(121, 222)]}
    assert Counter(n for n, _, _ in kept)["names"] == 4  # prefixes of 1, 2, 4 and 8 lines; ten before


def test_signatures_are_kept_only_of_classes_that_share_a_bucket(spark, kept):
    rnd = random.Random(5)
    texts = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(60)) for _ in range(200)]
    texts += [texts[7] + " more", texts[9]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()}
    assert out == {i: i for i in range(200)} | {200: 7, 201: 9}
    with_sig = {n: made.count() for n, columns, made in kept if "sig" in columns}
    assert set(with_sig) == {"sets"} and 2 <= with_sig["sets"] <= 20  # before, members and classes too


def test_join_counted_broadcasts_hot_keys_only_if_there_are_any(spark):
    rows = spark.createDataFrame([(k, i) for i in range(6) for k in "aab"] + [(None, 9)], "k string, i int")
    keyed = common.stored(spark.createDataFrame([("a", 1, 12), ("b", 2, 6)], "k string, v int, n long"))
    want = sorted([("a", i, 1) for i in range(6) for _ in "aa"] + [("b", i, 2) for i in range(6)] + [(None, 9, None)], key=str)
    for hot in (1, 8, 100):
        out = common.join_counted(rows, keyed, ["k"], hot, "left")
        assert sorted(map(tuple, out.collect()), key=str) == want
        assert ("Union" in common.join_counted(rows, keyed, ["k"], hot)._jdf.queryExecution().optimizedPlan().toString()) == (hot < 100)
