"""Canonical names of typed places, and variant labels of points."""

import random

import pytest

from hydroframe.llm import canonical, variants

A = [("Shutura River", "Shutura River", None), ("Old Khad", "Shutura River", None), ("Pedaeth Drain", "Pedaeth Drain", "x"), ("PEDAETH", "Pedaeth Drain", None), ("Chogusasim Stream", "Chogusasim Stream", None), ("Jashotheak Nallah", "Chogusasim Stream", None), ("Jashotheak Nallah", "Chogusasim Stream", None), (None, None, None)]
E = {
    "Shutura-RIV. after meeting Pedaeth Drain": "Shutura River",
    "NX05 - shuturra river near bus stand": "Shutura River",
    "Thisisim River falling into Shutura River": "",
    "bus stand on Pedeath drn": "Pedaeth Drain",
    "Selupa: Cho-gusasim Str. / school bridge": "Chogusasim Stream",
    "STR. CHOGU SASIM (SCHOOL BRIDGE, SELUPA)": "Chogusasim Stream",
    "Jaashotheak nallah at sluice gate": "Chogusasim Stream",
    "near pump house (Selupa)": "",
    "same as last month": "",
    "": "",
    "  ": "",
    "?": "",
    "Chogusasim u/s Pedaeth Drain": "Chogusasim Stream",
    "x" * 30_000: "",
}


def test_map_names(spark):
    entries = [(i, t, None) for i, t in enumerate([*E, *E])] + [(999, None, None), (None, "Shutura", None)]
    df = spark.createDataFrame(entries, "entry_id long, location string, name string")
    got = {r.entry_id: r.name for r in canonical.map_names(df, spark.createDataFrame(A, "alias string, name string, note string")).collect()}
    want = {i: n for i, n in enumerate([*E.values(), *E.values()])} | {999: ""}
    assert got == want
    none = spark.createDataFrame([], "alias string, name string")
    assert {r.name for r in canonical.map_names(df, none).collect()} == {""}
    assert canonical.map_names(df.where("false"), none).collect() == []


@pytest.mark.parametrize(
    ("label", "want"),
    [
        ("KP49 - Rezojiq. bridge (Kaku thara choe, Up stream)", ("U", "bridge", "kakuthara", "rezojiq")),
        ("Bechebegol Choh - Nenidu Wick S.T.P.", ("", "stp", "bechebegol", "neniduwick")),
        ("P. STATION TENUCHILUND, DRAIN ZAKABOAK D/S", ("D", "pump", "zakaboak", "tenuchilund")),
        ("Kakuthara at Bridge vill. Rezojiquay Down stream, Ward 4", ("D", "bridge", "kakuthara", "rezojiquay")),
        ("Vill. Teguhacorft - Cho-jukuak ghat", ("", "ghat", "chojukuak", "teguhacorft")),
    ],
)
def test_read_label(label, want):
    got = variants.read_label(label)
    assert got[:2] == want[:2] and set(got[2:]) == set(want[2:])
    assert variants.read_label(None) == ("", "", "", "") == variants.read_label("")


L = "label_id long, location string, latitude double, longitude double, data_source string, first_seen timestamp"


def test_points(spark):
    groups = [
        ["Shutura River - Jehinewick STP downstream", "JEHINE WICK S.T.P. (SHUTURA RVR, D/S)", "Rvr Shuttura - Jehinewick Sewage Plant Down Stream", "MX11 - d/s jehineweick stp on shutura rvr"],
        ["Shutura River - Jehinewick STP upstream", "JEHINE STP (SHUTURA R., U/S)"],
        ["Shutura River - Jehinewick Bridge", "Brdg Jehinewick, Shutura"],
        ["Zakaboak Drain - Tenuchilund Weir", "Zakaboak Drain at vill. Tenuchilund", "wier tenuchilund, zakabaok drn"],
        ["Zakaboak Drain - Reropaburn Weir"],
    ]
    rows, want, i = [], set(), 0
    for g, labels in enumerate(groups):
        ids = []
        for k, t in enumerate(labels):
            i += 1
            ids.append(i)
            rows.append((i, t, None if k == 1 else 24.0 + g * 0.05, None if k == 1 else 61.0, None, None))
        want |= {(a, b) for a in ids for b in ids if a < b}
    rows += [(100, None, None, None, None, None), (101, "", None, None, None, None), (None, "Shutura", None, None, None, None)]
    df = spark.createDataFrame(rows, L)
    assert {tuple(r) for r in variants.pairs(df).collect()} == want
    assert variants.points(df).count() == i + 2 and variants.pairs(df.where("false")).collect() == []


def test_hot_point(spark):
    """A third of the labels name one point; comparisons stay linear and every link is found."""
    rng = random.Random(4)
    base = "shutura river - jehinewick stp downstream"
    rows = []
    for k in range(300):
        at = rng.randrange(8, 20)
        rows.append((k, base[:at] + rng.choice(["", base[at]]) + base[at + rng.choice([0, 1]) :] if k % 3 == 0 else f"Water{chr(97 + k % 26)}{chr(97 + k // 26)}moar Drain - Place{chr(97 + k % 26)}{chr(97 + k // 26)}ton Weir", 24.0, 61.0, None, None))
    p = {r.label_id: r.point for r in variants.points(spark.createDataFrame(rows, L)).collect()}
    assert len({p[k] for k in range(0, 300, 3)}) == 1


def test_common_length():
    assert variants.common_length("zakaboak", "zakabaok") == 7 and variants.alike("rezojiq", "rezojiquay") > 0.9 and variants.alike("", "x") == 0


def _between(rng, first, end):
    """A name of its own that begins with first and has a common end."""
    return first + "".join(rng.choice("bcdfgjkmpqvwxz") for _ in range(8)) + end


def test_no_pair_is_lost_under_common_ends(spark):
    """Two spellings that share only ends of names, which many labels in between have too."""
    rng = random.Random(11)
    texts = ["Shuturel River - Pirevonagar Weir", "Thudurel River - Zirexonagar Weir"]
    texts += [f"{_between(rng, 'S', 'urel')} River - {_between(rng, 'R', 'onagar')} Weir" for _ in range(40)]
    read = [variants.read_label(t)[2:] for t in texts]
    linked = {(i, j) for j in range(len(read)) for i in range(j) if variants.same_names(*read[i], *read[j]) >= variants.RATIO}
    assert linked == {(0, 1)}
    assert {tuple(r) for r in variants.pairs(spark.createDataFrame([(i, t, None, None, None, None) for i, t in enumerate(texts)], L)).collect()} == linked


def test_bare_label_meets_all_points(spark):
    """A label without structure finds its only point, and none where there are two, however many labels stand between."""
    rng = random.Random(13)
    texts = ["Shuturel River - Pirevonagar Weir", "Thudurel River - Zirexonagar", "Gomemoond Drain - Lelete Weir", "Gomemoond Drain - Lelete"]
    texts += [f"{_between(rng, 'S', 'urel')} River - {_between(rng, 'R', 'onagar')} Weir" for _ in range(40)]
    # Twenty spellings of one point, then the other point of the same names.
    texts += [f"Kakuthara Choe - Rezojiquay{a}{b} Bridge" for a in "bcdf" for b in "ghjkm"] + ["Kakuthara Choe - Rezojiquayzz Weir", "Kakuthara Choe - Rezojiquay"]
    got = {r.label_id: r.point for r in variants.points(spark.createDataFrame([(i, t, None, None, None, None) for i, t in enumerate(texts)], L)).collect()}
    assert got[1] == got[0] and got[3] == got[2]
    assert len({got[i] for i in range(44, 64)}) == 1 and len({got[44], got[64], got[65]}) == 3


def test_near_pairs_are_all_pairs(spark, monkeypatch):
    """In a tile all near pairs are found, and over all suffixes all that share an end, whatever the tiles."""
    rng = random.Random(12)
    names = sorted({"".join(rng.choice("abet") for _ in range(rng.randrange(3, 12))) for _ in range(150)} | {"a" * 40, "a" * 50, "ab" * 30, "abeta" + "b" * 30})
    want = {(a, b) for a in names for b in names if variants.alike(a, b) >= variants.RATIO}
    assert set(variants.near_pairs(names, names)) == want
    begun = lambda n: {n[:k] + n[k + 1 : 4] for k in range(4)}
    ends = {(a, b) for a, b in want if a == b or begun(a) & begun(b) or (a[-3:] == b[-3:] and min(len(a), len(b)) >= variants.RATIO * max(len(a), len(b)))}
    reps = spark.createDataFrame([(n, "") for n in names], "water string, village string")
    for tile in (1000, 7):
        monkeypatch.setattr(variants, "TILE", tile)
        assert ends <= {(r.name, r.near) for r in variants.near_names(reps).collect()} <= want


def test_long_chains_of_variants(spark):
    """Components are followed to their ends, whatever their length, and links are counted."""
    nodes = spark.createDataFrame([(i,) for i in range(200)], "rep long")
    links = spark.createDataFrame([(i, i + 1) for i in range(149)], "rep_a long, rep_b long")
    got = {r.rep: r.point for r in variants.components(nodes, links).collect()}
    assert {got[i] for i in range(150)} == {0} and got[199] == 199
    df = spark.createDataFrame([(1, "Shutura River - Jehinewick Bridge"), (2, "Brdg Jehinewick, Shutura"), (3, "Other River - Elsewick Weir")], "label_id long, location string").selectExpr("*", "24.0D AS latitude", "61.0D AS longitude")
    assert {r.label_id: (r.point, r.n_links) for r in variants.points_with_links(df).collect()} == {1: (1, 1), 2: (1, 1), 3: (3, 0)}
