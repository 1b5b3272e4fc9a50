"""Scoring of abusive language: folding, the kernel, and accuracy on held-out documents."""

import random

import numpy as np
import pytest

from hydroframe.llm import abuse

NOUNS = ["idiot", "moron", "cretin", "imbecile", "halfwit"]
CLEAN = ["the sensor dampens the seasonal budget of the riffle", "we sampled the flux at sixty sites and compared it with the record", "this damned float jumps to the next page again", "the word idiot is studied as an object in section two", "dead larvae were counted and killed specimens were kept cold", "the argument is weak and the plot is wrong"]
BAD = ["you people are {a} {n}s and take your {n} of a supervisor with you", "only a {a} {n} like you could fail to read a simple plot", "shut your mouth you {a} {n} nobody asked what you think"]


def document(rng, bad):
    s = [rng.choice(CLEAN) for _ in range(rng.randrange(5, 12))]
    if bad:
        t = rng.choice(BAD).format(a=rng.choice(["stupid", "filthy", "spineless", "braindead"]), n=rng.choice(NOUNS))
        s.insert(rng.randrange(len(s)), rng.choice(["% {}", "\\footnote{{{}}}", "\\todo{{{}}}", "{}"]).format(t))
    return ".\n".join(s) + "."


def corpus(n, seed):
    rng = random.Random(seed)
    return [(document(rng, bad), int(bad)) for bad in (rng.random() < 0.3 for _ in range(n))]


@pytest.fixture(scope="module")
def machine():
    rng = random.Random(9)
    return abuse.fit([(t, y if rng.random() > 0.03 else 1 - y, 1) for t, y in corpus(250, 1)])


@pytest.mark.parametrize("text", ["you m1ser@ble 1d10t", "you miserable idddiot", "you miserable i d i o t", "you mis​erable idiot", "you miserable іdіоt", "you miserable ídiót"])
def test_folding(text):
    assert abuse.windows(text.lower()) == ["you miserable idiot"]


def test_kernel_tolerates_gaps():
    k = lambda a, b: float(abuse.kernel_features([a])[0] @ abuse.kernel_features([b])[0])
    assert k("worthless moron", "worthless moron") == pytest.approx(1, abs=1e-5)
    assert k("worthless moron", "worth*less mo*ron") > 0.6 > k("worthless moron", "seasonal budget")
    assert np.allclose(abuse.kernel_features([""]), abuse.kernel_features([""]))


def test_held_out(machine):
    right = 0
    held = corpus(200, 2)
    for text, y in held:
        found = [w for p in abuse.pieces(text) if abuse.unusual(machine.common, p) for w in abuse.windows(p)]
        score = max(machine.scores(found), default=machine.bias) if found else machine.bias
        right += int((score > 0) == bool(y))
    assert right / len(held) >= 0.97


def test_whole_query(spark):
    docs = [(i, "s" if i % 2 else None, t) for i, (t, _) in enumerate(corpus(200, 3))]
    truth = {i for i, (_, y) in enumerate(corpus(200, 3)) if y}
    long = "we sampled the flux at sixty sites. " * 5_000
    docs += [(1000, "s", None), (1001, "s", ""), (1002, "s", "  "), (1003, "s", long), (1004, "s", long + "shut your mouth you filthy moron nobody asked what you think.")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    votes = spark.createDataFrame([(i, "r", int(i in truth), None) for i in range(150)] + [(0, "q", 0, None), (5000, "r", 1, None), (None, None, None, None)], "doc_id long, reviewer string, abusive int, reviewed_at timestamp")
    s = {r.doc_id: r.score for r in abuse.scored(df, votes).collect()}
    found = {i for i, x in s.items() if x > 0}
    assert {r.doc_id for r in abuse.abusive(df, votes).collect()} == found
    assert len(s) == 205 and 1004 in found and not found & {1000, 1001, 1002, 1003}
    assert len((found & set(range(200))) ^ truth) <= 6
    rates = abuse.rates(df, votes).collect()
    assert sum(r.n_documents for r in rates) == 205
    assert abuse.scored(df, votes.where("false")).where("score > 0").collect() == [] == abuse.scored(df.where("false"), votes).collect()


def test_every_sentence_is_scored(spark, machine):
    """Abuse of common words reaches the machine, also where masked letters fall into common pieces."""
    texts = ["you miserable m0r0n", "shut your mouth you filthy moron"]
    df = spark.createDataFrame([(i, "s", t + ".") for i, t in enumerate(texts)], "doc_id long, source string, text string")
    machine.common |= {w for t in texts for w in abuse.quick_words(t)}
    got = {r.doc_id: (r.score, r.worst) for r in abuse.score_with(machine, df).collect()}
    for i, t in enumerate(texts):
        folded = abuse.windows(t)
        assert got[i] == (pytest.approx(float(machine.scores(folded)[0]), abs=1e-4), folded[0])


@pytest.mark.parametrize(
    ("text", "words"),
    [
        ("All is well.\n% morons!\nNext", "morons"),
        ("\\todo{Idiots.}", "idiots"),
        ("你是白痴。", "你 是 白 痴"),
        ("a cost of \\$5 you filthy moron and \\$6 more", "you filthy moron"),
        ("so $x = \\text{you filthy moron}$ holds", "you filthy moron"),
        ("\\def\\x{you filthy moron}", "you filthy moron"),
    ],
)
def test_short_and_hidden_pieces_are_kept(text, words):
    assert any(words in w for p in abuse.pieces(text) for w in abuse.windows(p))


def test_bounds_hold(machine):
    """The first eigenvectors bound the score, so no sentence that may be abusive, or the worst, is passed over."""
    rng = random.Random(5)
    texts = [w for t, _ in corpus(60, 6) for p in abuse.pieces(t) for w in abuse.windows(p)] + ["".join(rng.choice("abcdei st*") for _ in range(rng.randrange(1, 90))) for _ in range(300)] + ["", " "]
    f = machine.scores(texts)
    low, high = machine.bounds(texts)
    assert (low <= f).all() and (f <= high).all()
    owner = np.array([rng.randrange(40) for _ in texts])
    worst, count, first = machine.judge(texts, owner, 41)
    for k in range(40):
        mine = f[owner == k]
        assert worst[k] == pytest.approx(float(mine.max()), abs=1e-5) and count[k] == (mine > 0).sum() and owner[first[k]] == k
    assert worst[40] == pytest.approx(machine.bias) and first[40] == -1


def test_arguments_of_commands_are_read():
    """What isn't shown counts where it reads as words; keys don't."""
    got = [w for p in abuse.pieces("As in \\label{you-filthy-moron}\\cite{smith2020,jones} text \\begin{itemize}.") for w in abuse.windows(p)]
    assert "you filthy moron" in got and not any("smith" in w or "itemize" in w for w in got)


def test_quoted_words_stay_in_their_sentence():
    """One or two quoted words are read with what is said about them; a quoted sentence stands alone."""
    text = "Annotators marked the token ``imbecile'' as hostile. He wrote ``you filthy moron'' on it."
    got = [w for p in abuse.pieces(text) for w in abuse.windows(p)]
    assert got == ["annotators marked the token imbecile as hostile", "he wrote", "you filthy moron", "on it"]


def test_folding_keeps_known_words_within_bounds(monkeypatch):
    """Words once met are not looked into again; what is kept is bounded and changes no result."""
    monkeypatch.setattr(abuse, "_UNDRAWN", set())
    monkeypatch.setattr(abuse, "MAX_UNDRAWN", 3)
    cases = {"the flow is low": "the flow is low", "the flooow is low": "the flow is low", "a_b cd, is-low": "a b cd is low", "x y z of w": "xyz of w", "no 1999 m0r0n 12": "no moron", "flow is coool flow": "flow is col flow", "": ""}
    for _ in range(2):
        for piece, words in cases.items():
            assert " ".join(abuse._folded_words(piece)) == words
            assert len(abuse._UNDRAWN) <= 3
    assert abuse._UNDRAWN and all(w.isalpha() and len(w) > 1 and w not in ("flooow", "coool") for w in abuse._UNDRAWN)
