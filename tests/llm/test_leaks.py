import random

from wayflow.llm import leaks

R = random.Random(5)
VOCAB = [f"{a}{b}" for a in ("mor", "zet", "quil", "ba", "fe", "trö") for b in ("ite", "ase", "on", "ex", "ium")]


def sentence(n):
    return [R.choice(VOCAB) for _ in range(n)]


def brute(item, text):
    """Whether a stretch of at least 15 words of the item with at most one edit in ten lies in the text, edges equal."""
    n, m = len(item), len(text)
    for i in range(n):
        for k in range(m):
            if item[i] != text[k]:
                continue
            row = {(0, 0): 0}
            best = {(i, k): 0}
            todo = [(i, k)]
            while todo:
                a, b = todo.pop()
                e = best[a, b]
                if a - i + 1 >= 15 and item[a] == text[b] and 10 * e <= a - i + 1:
                    return True
                for da, db in ((1, 1), (1, 0), (0, 1)):
                    x, y = a + da, b + db
                    if x < n and y < m:
                        cost = e + (0 if da and db and item[x] == text[y] else 1)
                        if cost <= 3 and cost < best.get((x, y), 9):
                            best[x, y] = cost
                            todo.append((x, y))
    return False


def damaged(words, edits):
    w = list(words)
    for _ in range(edits):
        k = R.randrange(1, len(w) - 1)
        how = R.random()
        if how < 0.4:
            w[k] = "otherword"
        elif how < 0.7:
            del w[k]
        else:
            w.insert(k, "extraword")
    return w


def test_against_brute():
    items = [(i, " ".join(sentence(R.choice([10, 16, 25, 33])))) for i in range(12)]
    auto = leaks.Automaton(items)
    hits = 0
    for _ in range(120):
        i, text = R.choice(items)
        w = text.split()
        a = R.randrange(0, max(1, len(w) - 14))
        part = damaged(w[a : a + R.randint(12, 30)], R.randint(0, 3)) if len(w) > 13 else w
        doc = " ".join(["fill"] * 5 + part + ["end"] * 5)
        got = {x[0] for x in auto.spans(doc)}
        want = brute(leaks.words(text), leaks.words(doc))
        assert (i in got) == want, (i, doc)
        hits += want
    assert hits > 20


def test_markup_and_offsets():
    words = "Nemeth-Ao keeps one kaxanite alloy for every fine crystal and hides the layered coating behind the efficient größe torus twice"
    auto = leaks.Automaton([(7, words)])
    text = "Intro.\n% Nemeth-Ao keeps \\emph{one} KAXANITE al-\n%   loy for~every \\textbf{fine} crys{t}al\r\nand hides the layered, coating -- behind the eﬃcient GRÖSSE torus twice. End"
    [(item, a, b)] = set(auto.spans(text))
    assert item == 7 and text[a:b].startswith("Nemeth") and text[a:b].endswith("twice")
    assert not list(auto.spans("keeps one kaxanite alloy for every fine crystal and hides the"))


def test_rows(spark, monkeypatch):
    a, b = " ".join(sentence(20)), " ".join(sentence(20))
    docs = spark.createDataFrame([(1, f"x {a} y {a}"), (2, None), (3, ""), (4, f"{b} {a}"), (4, f"{b} {a}")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, a), (2, b), (3, None), (4, "too short"), (5, a)], "item_id bigint, text string")
    want = {(1, 1), (1, 5), (4, 1), (4, 2), (4, 5)}
    assert {tuple(r) for r in leaks.found(docs, items).collect()} == want
    monkeypatch.setattr(leaks, "ITEM_CHARS", 10)
    assert {tuple(r) for r in leaks.found(docs, items).collect()} == want
    assert leaks.found(docs, items.limit(0)).count() == 0
    assert leaks.found(docs.limit(0), items).count() == 0


def test_a_million_letters_take_no_square():
    import time

    began = time.time()
    text = "a" * 1_000_000 + " torn-\nword " + "b" * 1_000_000 + "{}" * 100_000
    assert leaks.words(text)[1] == "tornword"
    assert time.time() - began < 2
