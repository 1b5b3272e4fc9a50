"""Scoring of documents for abusive, hateful or sexually explicit language (problem 10).

A text is cut into sentences, also inside comments and notes, and folded: compatibility forms, look-alike letters,
digits written for letters, invisible characters, drawn-out and spaced-out letters. Sentences are compared by the
gap-weighted subsequence kernel of three characters, so inserted, masked or missing characters cost little. A support
vector machine on Nyström features of that kernel (landmark sentences) scores each sentence; a document has the score
of its worst one.

Labels are votes on documents; the majority holds, ties are left out. Sentences of documents voted clean are clean;
those of documents voted abusive begin with the sentences whose words stand out, and labels and machine are refined
in turn (multiple-instance learning), which also drops wrong votes. The sample to fit on is bounded by MAX_FIT
documents of either class, taken by the hash of their id.

Every sentence is scored, distinct folded sentences once per batch; words that are common in clean documents (at
least COMMON of them hold each) only choose which sentences the machine is fitted on.

Defined cases: null, empty and blank texts score the machine's bias and are not abusive; without any labelled abusive
or any clean document, nothing is found; repeated rows count as rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroframe.plans.io import only

#: Documents of either class that the machine is fitted on, at most, and their characters.
MAX_FIT = 1500
MAX_FIT_CHARS = 100_000_000
#: Sentences of clean documents that the machine is fitted on, at most.
MAX_CLEAN_SENTENCES = 12_000
#: Of them, sentences of common words only, at most.
PLAIN = 4_000
#: Landmark sentences of the Nyström map, at most.
LANDMARKS = 300
#: Dimension of the hashed subsequences.
DIM = 4096
#: Weight of a subsequence per character that it spans, and the longest gap between its characters.
DECAY, GAP = 0.6, 3
#: Exponent of the normalised kernel: sharpens similarity to the nearest landmarks.
POWER = 2
#: Sentences of one matrix of features, and eigenvectors that score every sentence.
CHUNK, LEADING = 64, 48
#: Total weight of a class against the regulariser.
COST = 20_000.0
#: Rounds of refinement, folds of each, and the score from which a clean document's sentence counts as a wrong vote.
TURNS, FOLDS, WRONG = 3, 4, 0.5
#: How many times as frequent in abusive documents a common word may be.
ENRICHED = 4.0
#: ... where so many abusive documents or more have it.
ENRICHED_LEAST = 6
#: Votes from which an abusive document is sure to have an abusive sentence.
SURE_VOTES = 2
#: How far the words of such a sentence must stand out (mean log odds).
LONE = 1.0
#: Similarity (to the POWER) of sentences that are nearly one.
NEAR = 0.5
#: What stands in clean documents at more than this part of its rate in abusive ones is clean.
SHARED = 0.3
#: Share of the clean and of the abusive sentences' scores that the threshold lies between.
CLEAN_QUANTILE, WEAK_QUANTILE = 0.9995, 0.97
#: Share of the clean documents from which a word is common.
COMMON = 0.01
#: Words of a window; longer sentences are scored in overlapping windows.
WINDOW, STRIDE = 28, 18

# Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("авеёзіјкмнорстухѕԁԛԝгпαβεικνορτυχγη", "abeezijkmhopctyxsdqwrnabeiknoptuxyn")
# Digits and signs written for letters.
LEET = str.maketrans("0134578@$€!|", "oieastbaseil")

_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff\u202a-\u202e\u0300-\u036f]")
_DRAWN = re.compile(r"([^\W\d_])\1{2,}")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_][ .\-_*]){2,}[^\W_](?![^\W_])")
_FOREIGN = re.compile(r"[^\x00-\x7f]+")
_ACCENT = re.compile(r"\\[\"'`^~=.chuvkrbd](?:\{(\w)\}|(?<![chuvkrbd])(\w))|\\[,;! ]")
_NAMED = re.compile(r"\\(?:[a-z]*cite[a-z]*|(?:eq|page|auto)?ref|label|input|include[a-z]*|usepackage|document[a-z]+|bibliography[a-z]*|bibitem|begin|end|new[a-z]+)\*?(?:\[[^\]\n]*\])*(?:\{([^{}\n]*)\})?|\\def\\[a-z]+")
_KEY_WORD = re.compile(r"(?<![^\W_])[^\W\d_]{2,}(?![^\W_])")
_THREE_WORDS = re.compile(r"(?:[^\W\d_]{2,}[-_:.+/\s]+){2}[^\W\d_]{2,}")
_COMMAND = re.compile(r"\\[a-z@]+\*?")
_LINE = re.compile(r"\r?\n[ \t]*%*[ \t]*(?=\S)|[%{}]")
_CUT = re.compile(r"[.!?;:。！？]+(?=[\s}'\")\]])|\n[ \t\r%]*\n|\}[ \t\r]*\n|\x1f|\\(?:footnote|todo|item|section|caption|thanks|marginpar|title|author)\b|``|''")
#: One or two quoted words belong to the sentence about them; longer quotations stand alone.
_QUOTED = re.compile(r"``\s*([^\s`']+(?:\s+[^\s`']+)?)\s*''")
_REMARK = re.compile(r"((?<!\\)%[^\n]*)\n(?![ \t]*%)")
_QUICK = re.compile(r"[^\W\d_]+")
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff"
_WORD = re.compile(rf"[{_UNSPACED}]|(?![{_UNSPACED}])[^\W_](?:(?![{_UNSPACED}])[^\W_]|[*@$€!|'’](?=[\w*]))*|\*{{2,}}")
_BLANKED = "".join(ch if ch.isalnum() else " " for ch in map(chr, range(128)))
_MATH = re.compile(r"(?<!\\)\$[^$\n]{0,200}(?<!\\)\$")
_WORDS_IN_MATH = re.compile(r"(?<![\\A-Za-z])[^\W\d_](?:[^\W_]|[*@€!|'’])+")
_YEAR = re.compile(r"\d{3}")


def _letters(m: re.Match) -> str:
    t = m[0]
    if t[0] in "ÃÂâ":
        t = re.sub(r"[ÃÂâ][\x80-\xbf€-™]{1,2}", _repair, t)
    return _INVISIBLE.sub("", unicodedata.normalize("NFKD", t).lower().translate(LOOKALIKES))


def _repair(m: re.Match) -> str:
    try:
        return m[0].encode("cp1252").decode("utf-8")
    except UnicodeError:
        return m[0]


def _spoken(m: re.Match) -> str:
    """The words of a formula."""
    return f" {' '.join(_WORDS_IN_MATH.findall(m[0]))} "


def _argument(m: re.Match) -> str:
    """The argument of a command that isn't shown, as a piece of its own where a key of it reads as three words or more."""
    if not m[1] or _THREE_WORDS.search(m[1]) is None:
        return "\x1f"
    said = (re.sub(r"[-_:.+/\s]+", " ", key) for key in m[1].split(","))
    return "\x1f" + "\x1f".join(k for k in said if len(_KEY_WORD.findall(k)) >= 3) + "\x1f"


def pieces(text: str | None) -> list[str]:
    """A text in lower case, cut into sentences, whatever part of the source they stand in; markup is kept."""
    if not text:
        return []
    t = _MATH.sub(_spoken, text) if "$" in text else text
    t = t.lower()
    if "\\" in t:
        t = _NAMED.sub(_argument, t)
    if "``" in t:
        t = _QUOTED.sub(r" \1 ", t)
    if "%" in t:
        t = _REMARK.sub("\\1\x1f", t)
    return [p for p in _CUT.split(t) if p and not p.isspace()]


def quick_words(piece: str) -> list[str]:
    """Runs of letters of a piece, as they stand."""
    return _QUICK.findall(piece)


#: Words of two ASCII letters or more without drawn-out ones, as met so far; at most MAX_UNDRAWN of them are kept.
_UNDRAWN: set[str] = set()
MAX_UNDRAWN = 200_000


def _drawn(word: str) -> bool:
    """Whether an ASCII word has drawn-out letters."""
    if len(word) < 3 and not word.isalpha() or word in _UNDRAWN:
        return False
    if _DRAWN.search(word) is not None:
        return True
    if len(word) > 1 and word.isalpha():
        if len(_UNDRAWN) >= MAX_UNDRAWN:
            _UNDRAWN.clear()
        _UNDRAWN.add(word)
    return False


def _folded_words(piece: str) -> list[str]:
    """The words of a piece without compatibility forms, accents, look-alikes, invisible, drawn-out and spaced-out
    characters and digits for letters."""
    t = piece
    if t.isascii():
        if "\\" in t:
            t = _COMMAND.sub(" ", _ACCENT.sub(lambda m: m[1] or m[2] or " ", t))
        if not ("'" in t or "!" in t or "$" in t or "*" in t or "@" in t or "|" in t):
            # Nothing but letters, digits and plain signs: words are runs of them.
            words = t.translate(_BLANKED).split()
            if _UNDRAWN.issuperset(words):
                return words
            if [*map(len, words)].count(1) < 3 and not any(map(_drawn, words)):
                return words if "".join(words).isalpha() else [x for w in words if (x := w if w.isalpha() else _unleet(w))]
    else:
        t = _FOREIGN.sub(_letters, t)
        if "\\" in t:
            t = _COMMAND.sub(" ", _ACCENT.sub(lambda m: m[1] or m[2] or " ", t))
    t = _SPACED.sub(lambda m: re.sub(r"[ .\-_*]", "", m[0]), _DRAWN.sub(r"\1", _LINE.sub(" ", t)))
    return [w for w in map(_unleet, _WORD.findall(t)) if w]


def windows(piece: str) -> list[str]:
    """The folded words of a piece joined by blanks, in overlapping windows where there are many."""
    words = _folded_words(piece)
    if not (words and words[0].isalpha()) and not any(map(str.isalpha, "".join(words))) and "**" not in piece:
        return []
    if len(words) <= WINDOW:
        return [" ".join(words)]
    return [" ".join(words[k : k + WINDOW]) for k in range(0, len(words) - WINDOW + STRIDE, STRIDE)]


def unusual(common: frozenset, piece: str) -> bool:
    """Whether a piece has a word that clean documents don't commonly have, or masked or spaced-out letters."""
    words = _QUICK.findall(piece)
    return not common.issuperset(words) or "**" in piece or (sum(len(w) == 1 for w in words) > 3 and _SPACED.search(piece) is not None)


def _unleet(word: str) -> str:
    if word.isalpha():
        return word
    if word.isdigit() or _YEAR.search(word):
        return ""
    if any(ch.isalpha() for ch in word):
        return _DRAWN.sub(r"\1", word.translate(LEET))
    return word if "*" in word else ""


_CODES = np.full(0x110000, 0, np.uint8)
for _k, _ch in enumerate("abcdefghijklmnopqrstuvwxyz*ß' ", 1):
    _CODES[ord(_ch)] = _k
_CODES[0x3040:0xA000] = 29
#: The code between two texts, and the bucket of each three codes; those with a code between texts fall into the last.
_BETWEEN = 31
_CODES[0] = _BETWEEN
_BUCKET = (np.arange(32**3, dtype=np.int64) * 2654435761 >> 7) % DIM
_BUCKET[(np.arange(32**3)[:, None] // np.array([1, 32, 1024]) % 32 == _BETWEEN).any(1)] = DIM
_BUCKET = _BUCKET.astype(np.int32)


def _counts(texts: list[str]) -> np.ndarray:
    """Rows of the gap-weighted subsequence map of three characters, hashed to DIM, not normalised."""
    gap = "\0" * (2 * GAP)
    part = [f"  {t.replace(chr(0), ' ')}  {gap}" for t in texts]
    code = _CODES[np.frombuffer("".join(part).encode("utf-32-le", "replace"), np.uint32)].astype(np.int32)
    n = len(code) - 2 * GAP
    first = code[:n] << 10
    row = np.repeat(np.arange(len(part), dtype=np.int32) * (DIM + 1), [len(p) for p in part])[:n]
    keys = np.empty((GAP * GAP, n), np.int64)
    k = 0
    for a in range(1, GAP + 1):
        two = first + (code[a : n + a] << 5)
        for b in range(1, GAP + 1):
            np.add(_BUCKET[two + code[a + b : n + a + b]], row, out=keys[k])
            k += 1
    weights = np.repeat([DECAY ** (a + b) for a in range(1, GAP + 1) for b in range(1, GAP + 1)], n)
    return np.bincount(keys.ravel(), weights, minlength=len(part) * (DIM + 1)).reshape(len(part), DIM + 1)[:, :DIM].astype(np.float32)


def kernel_features(texts: list[str]) -> np.ndarray:
    """Rows of the gap-weighted subsequence map of three characters, hashed to DIM and normalised."""
    out = np.zeros((len(texts), DIM), np.float32)
    for at in range(0, len(texts), CHUNK):
        x = _counts(texts[at : at + CHUNK])
        out[at : at + CHUNK] = x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], 1e-9)
    return out


class Machine:
    """A fitted scorer; its size is bounded by LANDMARKS, DIM and MAX_FIT.

    The sum over the landmarks of beta * kernel**2 is a quadratic form, held by its eigenvectors. Its LEADING ones
    score every sentence; what the others can add is bounded by their greatest eigenvalue and the part of the sentence
    that they see. Sentences that may be abusive, or the worst of their document, are scored by all of them.
    """

    def __init__(self, landmarks: np.ndarray, beta: np.ndarray, bias: float, common: frozenset) -> None:
        if POWER != 2:
            raise ValueError("the machine is a quadratic form")
        self.bias, self.common = float(bias), common
        q, r = np.linalg.qr(landmarks.T.astype(np.float64))
        values, vectors = np.linalg.eigh((r * beta) @ r.T)
        order = np.argsort(-np.abs(values))
        self.values, self.vectors = values[order].astype(np.float32), (q @ vectors[:, order]).astype(np.float32)
        rest = self.values[LEADING:]
        self.most, self.least = float(rest.max(initial=0.0)), float(rest.min(initial=0.0))

    def bounds(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest decision value that each sentence can have."""
        low, high = np.empty(len(texts), np.float32), np.empty(len(texts), np.float32)
        lead, values = np.ascontiguousarray(self.vectors[:, :LEADING]), self.values[:LEADING]
        for at in range(0, len(texts), CHUNK):
            x = _counts(texts[at : at + CHUNK])
            size = np.maximum(np.einsum("ij,ij->i", x, x), 1e-9)
            seen = (x @ lead) ** 2
            f = seen @ values / size + self.bias
            unseen = np.maximum(1 - seen.sum(1) / size, 0) + 1e-5
            low[at : at + CHUNK], high[at : at + CHUNK] = f + self.least * unseen - 1e-5, f + self.most * unseen + 1e-5
        return low, high

    def scores(self, texts: list[str]) -> np.ndarray:
        """Decision values of sentences; abusive above 0."""
        out = np.empty(len(texts), np.float32)
        for at in range(0, len(texts), CHUNK):
            out[at : at + CHUNK] = (kernel_features(texts[at : at + CHUNK]) @ self.vectors) ** 2 @ self.values + self.bias
        return out

    def judge(self, texts: list[str], owner: np.ndarray, n: int, clean_too: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(worst score, number of abusive sentences, index of the worst or -1) of n documents, texts[i] being a
        sentence of owner[i]; without clean_too the score of a document without abusive sentences is the bias."""
        at = np.fromiter((seen.setdefault(t, len(seen)) for seen in [{}] for t in texts), np.int64, len(texts))
        unique = list(dict.fromkeys(texts))
        low, high = self.bounds(unique)
        floor = np.full(n, -np.inf)
        np.maximum.at(floor, owner, low[at])
        asked = (high[at] > 0) | (clean_too & (high[at] >= floor[owner]))
        exact = np.full(len(unique), -np.inf, np.float32)
        which = np.unique(at[asked])
        exact[which] = self.scores([unique[i] for i in which])
        f = np.where(asked, exact[at], -np.inf)
        worst, count = np.full(n, -np.inf), np.zeros(n, np.int64)
        np.maximum.at(worst, owner, f)
        np.add.at(count, owner, f > 0)
        first = np.full(n, -1, np.int64)
        hit = np.flatnonzero(asked & (f == worst[owner]))[::-1]
        first[owner[hit]] = hit
        return np.where(first < 0, self.bias, worst), count, first


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by Newton steps with halving."""
    x = np.hstack([z, np.ones((len(z), 1))])
    ridge = np.ones(x.shape[1])
    ridge[-1] = 1e-3
    w = np.zeros(x.shape[1])
    loss = lambda v: float(ridge @ v**2 + 2 * (weight @ np.maximum(1 - y * (x @ v), 0) ** 2))
    now = loss(w)
    for _ in range(rounds):
        active = y * (x @ w) < 1
        xa, wa = x[active], weight[active]
        step = np.linalg.solve(np.diag(ridge) + 2 * (xa.T * wa) @ xa, 2 * (xa.T * wa) @ y[active]) - w
        size = 1.0
        while (then := loss(w + size * step)) > now and size > 1e-3:
            size /= 2
        w, gain, now = w + size * step, now - then, then
        if gain < 1e-4 * now:
            break
    return w[:-1], float(w[-1])


def _sentences(piece: str) -> list[str]:
    """The windows that the machine is fitted on: with two words of three letters or unspaced characters, no lone letters of formulas."""
    return [w for w in windows(piece) if sum(len(x) > 2 or re.match(f"[{_UNSPACED}]", x) is not None for x in w.split()) >= 2]


def fit(documents: list[tuple[str | None, int, int]], seed: int = 7) -> Machine | None:
    """A machine from (text, 0 or 1, number of votes) of labelled documents; None where a class is absent."""
    cut = [(pieces(t), y, n) for t, y, n in documents]
    clean, bad = [p for p, y, _ in cut if not y], [(p, n) for p, y, n in cut if y]
    if not clean or not bad:
        return None
    df = Counter(w for ps in clean for w in {x for p in ps for x in _QUICK.findall(p)})
    quick = Counter(w for ps, _ in bad for w in {x for p in ps for x in _QUICK.findall(p)})
    # Wrong votes bring abusive words into clean documents, so a common word must not be frequent in abusive ones.
    common = frozenset(w for w, n in df.items() if n >= max(2, COMMON * len(clean)) and (quick[w] < ENRICHED_LEAST or quick[w] / len(bad) <= ENRICHED * n / len(clean)))
    folded = [[*dict.fromkeys(w for p in ps if unusual(common, p) for w in _sentences(p))] for ps, _ in bad]
    bad_df = Counter(w for ts in folded for w in {x for t in ts for x in t.split()})

    def stands_out(t: str) -> float:
        odds = sorted((np.log((bad_df[w] + 0.5) / (len(bad) + 1)) - np.log((df[w] + 0.5) / (len(clean) + 1)) for w in set(t.split())), reverse=True)[:4]
        return sum(odds) / 4 if len(odds) >= 2 else -9.0

    holders = Counter(w for ps in clean for w in {x for p in ps if unusual(common, p) for x in _sentences(p)})
    negative = [*holders]
    rng = np.random.default_rng(seed)
    plain = [*dict.fromkeys(p for ps in clean for p in ps if not unusual(common, p))]
    plain = [plain[i] for i in np.sort(rng.permutation(len(plain))[:PLAIN])]
    negative = [*dict.fromkeys(negative + [w for p in plain for w in _sentences(p)])]
    candidates = [(k, t, stands_out(t)) for k, ts in enumerate(folded) for t in ts]
    if not candidates:
        return None
    texts = [t for _, t, _ in candidates]
    bag = np.array([k for k, *_ in candidates])
    start = np.array([o for *_, o in candidates])
    best = np.full(len(bad), -np.inf)
    np.maximum.at(best, bag, start)
    positive = (start >= 0.6 * best[bag]) & (start > 0.3)
    if not positive.any():
        positive = start >= best[bag] - 1e-9
    sure = np.array([n >= SURE_VOTES for _, n in bad])
    if len(negative) > MAX_CLEAN_SENTENCES:
        negative = [negative[i] for i in np.sort(rng.choice(len(negative), MAX_CLEAN_SENTENCES, replace=False))]
    if not negative:
        negative = [""]
    xp, xn = kernel_features(texts), kernel_features(negative)
    side = rng.integers(0, FOLDS, len(negative))
    held = np.array([holders.get(t, 1) for t in negative], np.float64)
    wrong = np.zeros(len(negative), bool)
    # How many documents of either class hold nearly the same sentence.
    near = np.flatnonzero(start > 0.3)
    clean_near = np.concatenate([((xp[near[k : k + 256]] @ xn.T) ** POWER > NEAR) @ held for k in range(0, len(near), 256)]) if len(near) else np.zeros(0)
    bad_near = np.concatenate([((xp[near[k : k + 256]] @ xp[near].T) ** POWER > NEAR).sum(1) for k in range(0, len(near), 256)]) if len(near) else np.zeros(0)
    shared = np.zeros(len(texts), bool)
    shared[near] = clean_near / len(clean) > SHARED * bad_near / len(bad)
    for turn in range(TURNS + 1):
        p, n = np.flatnonzero(positive), np.flatnonzero(~wrong)
        marks = np.vstack([xp[rng.permutation(p)[: LANDMARKS // 2]], xn[rng.permutation(n)[: LANDMARKS // 2]]])
        values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64) ** POWER + 1e-6 * np.eye(len(marks)))
        root = vectors / np.sqrt(np.maximum(values, 1e-6))
        zp, zn = (xp @ marks.T) ** POWER @ root, (xn @ marks.T) ** POWER @ root
        if turn == TURNS:
            break
        # Judged by a machine that hasn't seen their document, lone sentences that merely stand out find no support.
        fp, fn = np.full(len(texts), -1.0), np.full(len(negative), -1.0)
        for fold_ in range(FOLDS):
            ps, ns = p[bag[p] % FOLDS != fold_], n[side[n] != fold_]
            if not len(ps) or not len(ns):
                continue
            w, bias = _balanced(zp[ps], zn[ns])
            fp[bag % FOLDS == fold_] = zp[bag % FOLDS == fold_] @ w + bias
            fn[side == fold_] = zn[side == fold_] @ w + bias
        wrong = fn > WRONG
        w_ = np.flatnonzero(wrong)
        wrong[w_] = ((xn[w_] @ xp[p].T) ** POWER > NEAR).sum(1) / len(bad) * SHARED >= ((xn[w_] @ xn.T) ** POWER > NEAR) @ held / len(clean)
        positive = (fp > 0) & ~shared
        # A document that several reviewers call abusive has a sentence that is: its most likely one.
        likely = fp + 0.2 * np.minimum(start, 5)
        top = np.full(len(bad), -np.inf)
        np.maximum.at(top, bag, likely)
        lone = sure & ~np.isin(np.arange(len(bad)), bag[positive])
        positive |= lone[bag] & (likely >= top[bag]) & (start > LONE) & ~shared
        if not positive.any():
            positive = start >= best[bag] - 1e-9
    w, bias = _balanced(zp[positive], zn[~wrong])
    # The threshold lies half way between the weakest abusive and the closest clean sentences, as judged without their fold.
    close = np.quantile(fn[~wrong], CLEAN_QUANTILE) if (~wrong).any() else 0.0
    weak = np.quantile(fp[positive], 1 - WEAK_QUANTILE)
    bias -= (max(weak, 0.0) + min(close, 0.0)) / 2
    return Machine(marks.astype(np.float32), (root @ w).astype(np.float32), bias, common)


def _balanced(good: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, float]:
    """A machine between positive and negative rows, either class with the same total weight."""
    y = np.concatenate([np.ones(len(good)), -np.ones(len(bad))])
    return _svm(np.vstack([good, bad]), y, np.where(y > 0, 1 / len(good), 1 / len(bad)) * COST)


def labelled(documents: DataFrame, labels: DataFrame) -> list[tuple[str | None, int, int]]:
    """(text, majority vote, votes) of at most MAX_FIT documents of either class, by the hash of their id, and of at
    most MAX_FIT_CHARS characters; of rows of one id the alphabetically first text counts. One read of the documents."""
    votes = only(labels, "doc_id", "abusive").where("abusive in (0, 1)").groupBy("doc_id").agg(F.avg("abusive").alias("mean"), F.count(F.lit(1)).alias("votes")).where("mean <> 0.5")
    by_hash = votes.select("doc_id", "votes", (F.col("mean") > 0.5).cast("int").alias("y"), F.xxhash64("doc_id").alias("h"))
    ids = reduce(DataFrame.unionByName, [by_hash.where(f"y = {y}").orderBy("h", "doc_id").limit(MAX_FIT) for y in (0, 1)])
    # At most 2 * MAX_FIT ids.
    rows = only(documents, "doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y", "votes", "h").agg(F.min("text").alias("text"))
    out, left = [], MAX_FIT_CHARS
    for r in rows.orderBy("h", "doc_id").toLocalIterator():
        left -= len(r["text"])
        if left < 0 and out:
            break
        out.append((r["doc_id"], r["text"], r["y"], r["votes"]))
    return [x[1:] for x in sorted(out, key=lambda x: (-x[2], x[0]))]


_ROW = "doc_id long, source string, score double, n_abusive long, worst string"


def score_with(machine: Machine | None, documents: DataFrame, clean_too: bool = True) -> DataFrame:
    """Score, number of abusive sentences and worst sentence of every document; no shuffle. Without clean_too, documents
    without abusive sentences get the bias as score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                owner, texts = [], []
                if machine is not None:
                    folded: dict[str, list[str]] = {}
                    for k, text in enumerate(batch.column(2)):
                        for p in pieces(text.as_py()):
                            if (found := folded.get(p)) is None:
                                found = folded[p] = windows(p)
                            owner += [k] * len(found)
                            texts += found
                score = np.full(batch.num_rows, machine.bias if machine else -1.0)
                count, worst = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
                if texts:
                    score, count, first = machine.judge(texts, np.array(owner), batch.num_rows, clean_too)
                    worst = [texts[i] if i >= 0 else None for i in first]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array(count), pa.array(worst, pa.string())], names=["doc_id", "source", "score", "n_abusive", "worst"])

    return only(documents, "doc_id", "source", "text").mapInArrow(run, _ROW)


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document with its score, by a machine fitted on the labels."""
    return score_with(fit(labelled(documents, labels)), documents)


def abusive(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id of every document with an abusive sentence."""
    return score_with(fit(labelled(documents, labels)), documents, clean_too=False).where("n_abusive > 0").select("doc_id")


def rates(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per source: documents, abusive documents and their share."""
    s = score_with(fit(labelled(documents, labels)), documents, clean_too=False)
    bad = F.col("n_abusive") > 0
    return s.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(bad).alias("n_abusive"), F.round(F.avg(bad.cast("double")), 6).alias("rate"))
