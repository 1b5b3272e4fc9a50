"""Linking of the labels under which monitoring points appear (problem 7).

A label is read into side, kind of structure and up to two names (village and water body, in any order); labels that
read alike are one representative. Suffix blocking finds the near names: distinct names are filed under their last END
letters, refined by bands of length that lose no pair, and under their beginnings with one letter left out, as ends may
be abbreviated. No suffix is discarded: common ones are compared in tiles, where letters in common bound the longest common
subsequence from above. Two representatives of the same structure and side then meet by equality with a near name of
the one of their names that reaches fewer representatives; a name that a third of all labels share is not expanded
where the other name is rarer. Pairs are verified by the ratio of the longest common subsequence of both names; links
are closed into points by alternating minimum propagation with checkpoints.

A label without structure meets all labels of its side that have its names, and joins their point when there is just
one.

Defined cases: labels without id are left out; null and blank labels, and labels without any name, belong to no point of others; missing coordinates
neither help nor harm; coordinates far apart need nearly equal names; repeated labels are linked to each other; two
spellings of a name that differ in their suffixes and by more than a letter in their beginnings are not compared.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from string import ascii_lowercase

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydroframe.plans.io import cut, only

#: Letters of the suffixes, and beginnings, that names are filed under.
END = 3
#: Names of a tile of comparisons, each way.
TILE = 1_000
#: Equal letters of a name that are counted one by one.
LEVELS = 3
#: Least ratio of the longest common subsequence to the longer name; where coordinates are far apart, and at all.
FAR_RATIO, RATIO = 0.9, 0.74
#: Degrees from which coordinates are far apart.
FAR = 0.02
#: Labels of a point from which its pairs are formed in several parts.
SPLIT = 1_000

# Kinds of structure, as typed.
STRUCTURES = {
    "stp": r"sewage treatment plant|sewage plant|s\.\s?t\.\s?p\.?|stp|treatment plant",
    "pump": r"pump(?:ing)? (?:station|stn\.?|house)|p\. (?:station|stn\.?)",
    "intake": r"intake (?:well|w\.?)|intake",
    "culvert": r"(?:road|rd\.?) culvert|culvert",
    "bridge": r"bridge|brdg\.?|br\.",
    "weir": r"weir|wier",
    "ghat": r"ghaat|ghat",
    "gauge": r"gauge",
}
# Sides of a structure, as typed.
SIDES = {"U": r"u/s|up ?str(?:ea)?m(?: side)?", "D": r"d/s|down ?str(?:ea)?m(?: side)?"}
# Words for kinds of water, as typed.
TYPES = r"river|rvr|riv|r|drain|drn|canal|cnl|khadd|khad|khud|nallah|nalla|nala|nullah|choe|choh|choa|cho|stream|strm|str"

_CODE = re.compile(r"^\s*[a-z]{1,3}\d{1,3}\s*[-:]\s*")
_EXTRA = re.compile(r"[,(]?\s*(?:ward\s*\d+|distt\.?\s*\w+|(?:lower|upper) reach|pin pending)\s*\)?")
_STRUCTURE = [(k, re.compile(rf"(?<![a-z])(?:{p})(?![a-z])")) for k, p in STRUCTURES.items()]
_SIDE = [(k, re.compile(rf"(?<![a-z])(?:{p})(?![a-z])")) for k, p in SIDES.items()]
_TYPE = re.compile(rf"(?<![a-z])(?:{TYPES})(?![a-z]|-[a-z])\.?")
_BREAK = re.compile(r"(?<![a-z])(?:vill(?:age)?\.?|at|on|near|of)(?![a-z])|[,()/:;|]|\s-\s|-(?=\s)|(?<=\s)-")


def read_label(text: str | None) -> tuple[str, str, str, str]:
    """(side, structure, water name, village name); names are joined letters, '' where absent.

    The water is the name beside a word for a kind of water; where no name has one, both are sorted.
    """
    if not text:
        return "", "", "", ""
    t = unicodedata.normalize("NFKD", text.lower())
    t = _EXTRA.sub(" ", _CODE.sub("", " ".join(t.split())))
    side = structure = ""
    for k, p in _SIDE:
        if p.search(t):
            side, t = k, p.sub(" | ", t)
            break
    for k, p in _STRUCTURE:
        if p.search(t):
            structure, t = k, p.sub(" | ", t)
            break
    t = _TYPE.sub("~", t)
    water, others = [], []
    for part in _BREAK.split(t):
        for k, piece in enumerate(pieces := re.split("(~)", part)):
            name = re.sub(r"[^a-z]", "", piece)
            if len(name) < 3:
                continue
            beside = "~" in pieces[max(k - 1, 0) : k] or "~" in pieces[k + 1 : k + 2]
            (water if beside else others).append(name)
    if not water and len(others) >= 2:
        a, b = sorted(others, key=len, reverse=True)[:2]
        return side, structure, min(a, b), max(a, b)
    first = water[0] if water else (others.pop(0) if others else "")
    rest = others or water[1:]
    return side, structure, first, max(rest, key=len) if rest else ""


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel columns."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        if m := masks.get(ch):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def alike(a: str, b: str) -> float:
    """Ratio of the longest common subsequence to the longer name; a beginning counts as its whole name."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    n, short, long = common_length(a, b), min(len(a), len(b)), max(len(a), len(b))
    ratio = n / long
    if short >= 5 and long - short >= 2 and common_length(min(a, b, key=len), max(a, b, key=len)[: short + 1]) >= short - 1:
        ratio = max(ratio, 0.95 * (short - (short - common_length(min(a, b, key=len), max(a, b, key=len)[: short + 1]))) / short)
    return ratio


def same_names(w1: str, v1: str, w2: str, v2: str) -> float:
    """The lesser ratio of the better pairing of both names."""
    return max(min(alike(w1, w2), alike(v1, v2)), min(alike(w1, v2), alike(v1, w2)))


_READ = "label_id long, side string, structure string, water string, village string, latitude double, longitude double"


def read_labels(labels: DataFrame) -> DataFrame:
    """Every label with what is read from it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            parts = pd.DataFrame([read_label(t) for t in f["location"]], columns=["side", "structure", "water", "village"], index=f.index)
            yield pd.concat([f[["label_id"]], parts, f[["latitude", "longitude"]]], axis=1)

    return only(labels, "label_id", "location", "latitude", "longitude").where("label_id is not null").mapInPandas(run, _READ)


@F.pandas_udf(T.BooleanType())
def _linked(w1: pd.Series, v1: pd.Series, a1: pd.Series, o1: pd.Series, w2: pd.Series, v2: pd.Series, a2: pd.Series, o2: pd.Series) -> pd.Series:
    out, seen = [], {}
    for p, q, a, b, r, s, c, d in zip(w1, v1, a1, o1, w2, v2, a2, o2):
        if (score := seen.get((p, q, r, s))) is None:
            score = seen[p, q, r, s] = same_names(p, q, r, s)
        away = max(abs(a - c), abs(b - d))
        out.append(score >= (FAR_RATIO if away > FAR else RATIO))
    return pd.Series(out)


def _counts(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How often a name has each letter: rows of steps up to LEVELS, and the number of letters beyond them."""
    count = np.array([[n.count(ch) for ch in ascii_lowercase] for n in names], np.int64).reshape(len(names), 26)
    steps = np.hstack([count >= k for k in range(1, LEVELS + 1)]).astype(np.float32)
    return steps, np.maximum(count - LEVELS, 0).sum(1).astype(np.float32)


def near_pairs(left: list[str], right: list[str]) -> list[tuple[str, str]]:
    """Every (name of left, name of right) with a ratio of at least RATIO; names are letters a to z."""
    if len(left) * len(right) <= 64:
        return [(a, b) for a in left for b in right if alike(a, b) >= RATIO]
    (sa, ra), (sb, rb) = _counts(left), _counts(right)
    la, lb = (np.array([len(n) for n in names], np.float32) for names in (left, right))
    least_a, least_b = (np.minimum(RATIO * n - 1e-3, n - 1) for n in (la, lb))
    out = []
    for at in range(0, len(left), 256):
        rows = slice(at, at + 256)
        # Letters in common, whatever their order: no common subsequence is longer.
        common = sa[rows] @ sb.T
        if ra.any() and rb.any():
            common += np.minimum(ra[rows, None], rb[None, :])
        i, j = np.nonzero(common >= np.minimum(least_a[rows, None], least_b[None, :]))
        common, short, long = common[i, j], np.minimum(la[at + i], lb[j]), np.maximum(la[at + i], lb[j])
        maybe = (common >= RATIO * long - 1e-3) | ((short >= 5) & (long - short >= 2) & (common >= short - 1))
        out += [(left[p], right[q]) for p, q in zip((at + i[maybe]).tolist(), j[maybe].tolist()) if alike(left[p], right[q]) >= RATIO]
    return out


def _keys(name: Column) -> Column:
    """What a name is filed under: its suffix of END letters, with length bands of which names whose lengths allow the
    ratio have one in common; and its first END + 1 letters less any one of them, so that a slip there, where the end is
    abbreviated, leaves a key in common."""
    band = F.floor(F.log(F.length(name).cast("double")) / -math.log(RATIO))
    end = F.concat(F.lit("-"), F.right(name, F.lit(END)))
    begun = [F.concat(F.substring(name, 1, k), F.substring(name, k + 2, END - k), F.lit("-")) for k in range(END + 1)]
    return F.array_distinct(F.array(*begun, F.concat(end, F.lit(":"), band.cast("string")), F.concat(end, F.lit(":"), (band + 1).cast("string"))))


def near_names(reps: DataFrame) -> DataFrame:
    """(name, near): pairs of names, also of a name with itself, with a ratio of at least RATIO that have a key in common.

    Suffixes are refined by length bands, and none is discarded: what a common one still holds is compared in tiles of
    TILE names each way, so no task holds a whole suffix.
    """
    names = cut(reps.select(F.explode(F.array("water", "village")).alias("name")).where("name <> ''").distinct())
    filed = names.select("name", F.explode(_keys(F.col("name"))).alias("key"))
    sizes = filed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / TILE).cast("int")
    chunk = filed.join(sizes, "key").select("key", "name", chunks.alias("chunks"), F.pmod(F.xxhash64("name"), chunks).cast("int").alias("chunk"))
    tiles = chunk.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("k")).select("key", "name", "chunk", F.least("chunk", "k").alias("i"), F.greatest("chunk", "k").alias("j"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tile, left, right = None, [], []

        def found() -> pd.DataFrame:
            if not left or not right:
                return pd.DataFrame({"name": [], "near": []}, dtype=object)
            pairs_ = near_pairs(left, right)
            return pd.DataFrame(pairs_ + [(b, a) for a, b in pairs_ if tile[1] != tile[2]], columns=["name", "near"])

        for f in frames:
            for key, name, c, i, j in zip(f["key"], f["name"], f["chunk"], f["i"], f["j"]):
                if (key, i, j) != tile:
                    if tile:
                        yield found()
                    tile, left, right = (key, i, j), [], []
                if c == i:
                    left.append(name)
                if c == j:
                    right.append(name)
        if tile:
            yield found()

    # By number, so that tiles are spread and small shuffles aren't merged into few tasks.
    parts = max(int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    near = tiles.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInPandas(run, "name string, near string")
    return cut(near.unionByName(names.select("name", F.col("name").alias("near"))).distinct())


def _either(reps: DataFrame, *fields: str) -> DataFrame:
    """(fields, own, other, of): one row per name of either kind; representatives of one name are alike to none."""
    name = F.inline(F.array(F.struct(F.col("water").alias("own"), F.col("village").alias("other")), F.struct(F.col("village").alias("own"), F.col("water").alias("other"))))
    return reps.where("water <> '' and village <> ''").select(*fields, F.struct("rep", "lat", "lon", "water", "village").alias("of"), name)


def _meeting(left: DataFrame, right: DataFrame, near: DataFrame, *fields: str) -> DataFrame:
    """(a, b): every representative of left with every one of right that has equal fields and two near names."""
    a, b = _either(left, *fields), _either(right, *fields)
    reach = b.groupBy(*fields, F.col("own").alias("near")).agg(F.count(F.lit(1)).alias("n")).join(near, "near").groupBy(*fields, F.col("name").alias("own")).agg(F.sum("n").alias("n"))
    # Pairs have two near names, so it suffices to expand the name that reaches fewer; a name that reaches none has no pair.
    lesser = a.join(reach, [*fields, "own"], "left").groupBy("of", *fields).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "own", "other")).alias("by"))
    begun = lesser.select(*fields, F.col("of").alias("a"), F.col("by.own").alias("name"), F.col("by.other").alias("other_a")).join(near, "name")
    met = begun.join(b.select(*fields, F.col("own").alias("near"), F.col("other").alias("other_b"), F.col("of").alias("b")), [*fields, "near"])
    return met.join(near.select(F.col("name").alias("other_a"), F.col("near").alias("other_b")), ["other_a", "other_b"]).select("a", "b")


def _neighbours(reps: DataFrame, near: DataFrame, *fields: str) -> DataFrame:
    """All pairs of representatives with equal fields and two near names."""
    pairs = _meeting(reps, reps, near, *fields).where("a.rep <> b.rep").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.select(*(F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("rep", "lat", "lon", "water", "village")))


def _verify(pairs: DataFrame) -> DataFrame:
    return pairs.where(_linked(*(F.col(f"{c}_{s}") for s in "ab" for c in ("water", "village", "lat", "lon")))).select("rep_a", "rep_b")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(rep, point): the least representative that each reaches; checkpointed every round, until nothing changes."""
    both = cut(links.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).union(links.select("rep_b", "rep_a")).distinct())
    state = cut(nodes.select("rep", F.col("rep").alias("point")))
    while True:
        offer = both.join(state, both["b"] == state["rep"]).groupBy("a").agg(F.min("point").alias("offered"))
        new = state.join(offer, state["rep"] == offer["a"], "left").select("rep", "point", F.least("point", F.coalesce("offered", "point")).alias("new"))
        hop = new.select(F.col("rep").alias("via"), F.col("new").alias("hopped"))
        new = new.join(hop, new["new"] == hop["via"], "left").select("rep", "point", F.least("new", "hopped").alias("new"))
        new = cut(new)
        if new.where("new <> point").isEmpty():
            return state
        state = new.select("rep", F.col("new").alias("point"))


def points(labels: DataFrame) -> DataFrame:
    """(label_id, point) of every label; a point is named by its least label_id."""
    read = cut(read_labels(labels))
    named = read.where("water <> ''")
    names = ["side", "structure", "water", "village"]
    reps = cut(named.groupBy(*names).agg(F.min("label_id").alias("rep"), F.percentile("latitude", F.lit(0.5)).alias("lat"), F.percentile("longitude", F.lit(0.5)).alias("lon")))
    built = reps.where("structure <> ''")
    bare = reps.where("structure = ''")
    near_to = near_names(reps)
    links = _verify(_neighbours(built, near_to, "structure", "side"))
    point = components(built, links)
    # Labels without structure: the point of their names, if there is only one among all that have them.
    loose = components(bare, _verify(_neighbours(bare, near_to, "side")))
    hosts = _meeting(bare, built, near_to, "side").select(*(F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("rep", "lat", "lon", "water", "village")))
    of_host = _verify(hosts).join(point.select(F.col("rep").alias("rep_b"), F.col("point").alias("host")), "rep_b")
    hosted = of_host.join(loose, of_host["rep_a"] == loose["rep"]).groupBy("point").agg(F.min("host").alias("host"), F.max("host").alias("last")).where("host = last")
    loose = loose.join(hosted.select("point", "host"), "point", "left").select("rep", F.coalesce("host", "point").alias("point"))
    of = read.join(reps.select("rep", *names), names, "left").join(point.unionByName(loose), "rep", "left")
    return of.select("label_id", F.coalesce("point", "label_id").alias("point"))


def points_with_links(labels: DataFrame) -> DataFrame:
    """(label_id, point, n_links): the point of every label, and how many other labels it has there. Grows in proportion
    to the labels, however many a point has."""
    p = cut(points(labels))
    sizes = p.groupBy("point").agg((F.count(F.lit(1)) - 1).alias("n_links"))
    return p.join(sizes, "point").select("label_id", "point", "n_links")


def pairs(labels: DataFrame) -> DataFrame:
    """(label_id_a, label_id_b) of every two labels of one point, the lesser first."""
    p = points(labels)
    parts = p.groupBy("point").agg(F.ceil(F.count(F.lit(1)) / SPLIT).cast("int").alias("parts"))
    p = cut(p.join(parts, "point"))
    a = p.select(F.col("label_id").alias("label_id_a"), "point", F.pmod(F.xxhash64("label_id"), "parts").cast("int").alias("part"))
    b = p.select(F.col("label_id").alias("label_id_b"), "point", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return a.join(b, ["point", "part"]).where("label_id_a < label_id_b").select("label_id_a", "label_id_b")
