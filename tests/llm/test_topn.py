import random

from wayflow.llm import topn

SCHEMA = "hop int, seed int, total bigint, id bigint, note string, rank int"


def brute(rows, n, copies):
    groups = {}
    for hop, seed, total, i, note, rank in rows:
        if None not in (hop, seed, total, i):
            groups.setdefault((hop, seed), []).append((total, i, (note, rank)))
    out = set()
    for k, items in groups.items():
        seen, kept = set(), []
        for total, i, rest in sorted(items, key=lambda x: x[:2]):
            if copies and (total, rest) in seen:
                continue
            seen.add((total, rest))
            kept.append((*k, total, i))
        out |= {(*x, p + 1) for p, x in enumerate(kept[:n])}
    return out


def test_against_brute(spark, monkeypatch):
    monkeypatch.setattr(topn, "HELD", 40)
    r = random.Random(3)
    rows = []
    for i in range(4000):
        hop = r.choice([1, 1, 1, 1, 2, 3, None]) if r.random() < 0.9 else r.randint(4, 300)
        rows.append((hop, r.choice([0, 1, None]), r.choice([None, *range(30), 2**62]), i, r.choice(["a", "b", None]), r.choice([1, None])))
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    for copies in (None, ["hop", "seed", "total", "note", "rank"]):
        got = [tuple(x) for x in topn.top_n(df, ["hop", "seed"], "total", "id", 5, copies).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, 5, copies)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert topn.top_n(df, ["hop"], "total", "id", 5, ["note"]).count() == 0


def test_nulls_in_different_columns_are_no_copies(spark):
    df = spark.createDataFrame([(1, 7, 1, 5, None), (1, 7, 2, None, 5), (1, 7, 3, 5, None)], "k int, score int, id int, a int, b int")
    got = topn.top_n(df, ["k"], "score", "id", 5, ["k", "score", "a", "b"]).collect()
    assert [(r.id, r.rank) for r in sorted(got)] == [(1, 1), (2, 2)]
