"""Leaked passages: the index against brute force, and planted passages."""

import random

import numpy as np

from hydroframe.llm import leaks

ITEMS = [(i, " ".join(f"w{i}x{k}" if k % 3 else f"common{k}" for k in range(40))) for i in range(1, 6)]


def test_index_against_brute_force():
    rng = np.random.default_rng(0)
    for n in (1, 2, 50, 700):
        s = rng.integers(2, 6, n)
        index = leaks.FMIndex(s, 6)
        phrases = np.array([[a, b, c] for a in range(2, 6) for b in range(2, 6) for c in range(2, 6)])
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high):
            want = [i for i in range(n - 2) if (s[i : i + 3] == p).all()]
            assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


def test_common_subsequence():
    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        masks = {}
        for i, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << i
        assert leaks.longest_common(masks, len(a), b) == slow(a, b)


def test_words():
    assert leaks.words("The \\emph{odd} sym-\n% metry of~the ﬁnal\\textbf{Table}.") == ["the", "odd", "symmetry", "of", "the", "final", "table"]
    assert leaks.words(None) == [] == leaks.words("")


def marked(words, rng):
    out = []
    for k, w in enumerate(words):
        w = f"\\emph{{{w}}}" if k % 5 == 0 else w.upper() if k % 7 == 0 else w
        out.append(w + ("\n% " if k % 9 == 8 else " "))
    return "".join(out)


def test_planted(spark):
    rng = random.Random(2)
    filler = lambda n: " ".join(f"filler{rng.randrange(300)}" for _ in range(n)) + " "
    item = lambda i: ITEMS[i - 1][1].split()
    whole = filler(30) + marked(item(1), rng) + filler(30)
    half = filler(300) + marked(item(2)[10:32], rng) + filler(10)
    replaced = filler(10) + marked([w if k % 8 else "indeed" for k, w in enumerate(item(3))], rng)
    dropped = marked([w for k, w in enumerate(item(4)) if k % 6], rng)
    quote = filler(50) + " ".join(item(5)[5:13]) + filler(50)
    both = whole + filler(100) + half
    docs = [(1, whole), (2, half), (3, replaced), (4, dropped), (5, quote), (6, both), (7, None), (8, ""), (9, filler(50_000) + whole), (10, whole), (11, filler(200)), (11, filler(5))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([*[(i, "s", t) for i, t in ITEMS], (77, "s", None), (78, "s", "two words"), (79, "s", "")], "item_id long, suite string, text string")
    got = {tuple(r) for r in leaks.leaks(df, b).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (4, 4), (6, 1), (6, 2), (9, 1), (10, 1)}
    spans = {(r.doc_id, r.item_id): (r.first_word, r.end_word, whole[r.first_char : r.end_char]) for r in leaks.leaked_spans(df, b).where("doc_id = 1").collect()}
    first, end, passage = spans[1, 1]
    assert (first, end) == (30, 70) and leaks.words(passage) == item(1)
    assert leaks.leaks(df.where("false"), b).collect() == [] == leaks.leaks(df, b.where("false")).collect()


def test_shards_don_t_matter(spark, monkeypatch):
    docs = [(k, f"pad{k} " * 20 + ITEMS[k % 5][1]) for k in range(40)]
    items = leaks.Items(ITEMS)
    one = sorted(leaks.search_shard(items, docs))
    many = sorted(x for d in docs for x in leaks.search_shard(items, [d]))
    assert one == many and len(one) == 40


def test_replaced_words_and_short_items(spark):
    """Every third word replaced, items of one to five words, and items that stand several times in one document."""
    rng = random.Random(7)
    filler = lambda n: " ".join(f"filler{rng.randrange(300)}" for _ in range(n)) + " "
    long = [f"w{k}" for k in range(40)]
    items = [(1, " ".join(long)), (2, "alpha beta gamma"), (3, "delta epsilon zeta eta theta"), (4, "iota"), (5, " ".join(f"v{k}" for k in range(7)))]
    docs = [
        (1, filler(9) + " ".join(w if k % 3 else "other" for k, w in enumerate(long)) + " " + filler(9)),
        (2, filler(9) + "Alpha \\emph{beta}\n% gamma " + filler(9) + "delta epsilon zeta eta theta " + filler(3) + "iota"),
        (3, filler(9) + "alpha gamma beta delta epsilon zeta theta " + filler(3)),
        (4, filler(5) + " ".join(long) + " " + filler(50) + " ".join(long[:25]) + " " + filler(5) + " ".join(f"v{k}" for k in range(4))),
        (5, " ".join(w if k % 3 else "other" for k, w in enumerate(long[:30]))),
        (6, " ".join(long[5:20])),
    ]
    df, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in leaks.leaked_spans(df, b).select("doc_id", "item_id", "n_words").collect())
    assert got == [(1, 1, 26), (2, 2, 3), (2, 3, 5), (2, 4, 1), (4, 1, 25), (4, 1, 40), (4, 5, 4), (5, 1, 20)]


def test_places_of_words():
    texts = ["The \\emph{odd} sym-\n% metry of~the ﬁnal\\textbf{Table} \u00adso\u200bft İx.", "a\r\nb %c", "Caf\u0065\u0301 \u1112\u1161\u11ab 2\u00bd"]
    for t in texts:
        places, found = leaks.word_places(t), leaks.words(t)
        assert len(places) == len(found)
    places = leaks.word_places(texts[0])
    assert [texts[0][a:b] for a, b in places[:2]] == ["The", "odd"] and texts[0][slice(*places[2])] == "sym-\n% metry"


def test_blocks_of_items_don_t_matter(monkeypatch):
    docs = [(k, f"pad{k} " * 20 + ITEMS[k % 5][1] + " common0 common3" * (k % 7)) for k in range(40)]
    items = leaks.Items(ITEMS)
    one = sorted(leaks.search_shard(items, docs))
    monkeypatch.setattr(leaks, "MAX_PAIRS", 50)
    assert sorted(leaks.search_shard(items, docs)) == one
