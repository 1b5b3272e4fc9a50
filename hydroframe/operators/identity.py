"""Station labels that are variants of one another."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroframe.functions import text as X

# Extra words that make a label a different site.
SITE_WORDS = "U S D UPSTREAM DOWNSTREAM BEFORE AFTER CONFLUENCE CONF ABOVE BELOW INLET OUTLET INTAKE EXIT ENTRY ORIGIN NORTH SOUTH EAST WEST LEFT RIGHT OLD NEW".split()
# First words of labels that are fragments of longer ones.
FRAGMENT_START = "OF INTO AT ON FALLING TO AND WITH IN NEAR FROM".split()
#: Labels of one connected candidate group that are merged in order by one call.
MAX_GROUP = 20_000

_PASTED = r"(?<![A-Za-z0-9])\d{1,3}\.\d+(?![A-Za-z0-9])"


def labels(rows: DataFrame) -> DataFrame:
    """Labels with their words, median position, number of rows and first row; labels without position are left out."""
    ok = rows.where((F.trim("location") != "") & X.valid_position(F.col("latitude"), F.col("longitude")))
    g = ok.groupBy("location").agg(F.percentile("latitude", F.lit(0.5)).alias("lat"), F.percentile("longitude", F.lit(0.5)).alias("lon"), F.min("row_id").alias("first"))
    n = rows.groupBy("location").agg(F.count(F.lit(1)).alias("n_rows"))
    words = F.regexp_extract_all(F.upper("location"), F.lit("([A-Z0-9]+)"), F.lit(1))
    fragment = F.col("location").rlike(_PASTED) | F.coalesce(F.try_element_at(words, F.lit(1)).isin(FRAGMENT_START), F.lit(False))
    return g.join(n, "location").select("*", X.label_tokens(F.col("location")).alias("tokens"), X.flow_marker(F.col("location")).alias("marker"), fragment.alias("fragment"))


def comparable(a: str, b: str, extra: int = 3):
    """Whether the lesser of two token sets is a sub-label of the greater."""
    short = F.when(F.size(f"{a}.tokens") <= F.size(f"{b}.tokens"), F.col(f"{a}.tokens")).otherwise(F.col(f"{b}.tokens"))
    long = F.when(F.size(f"{a}.tokens") <= F.size(f"{b}.tokens"), F.col(f"{b}.tokens")).otherwise(F.col(f"{a}.tokens"))
    piece = F.when(F.size(f"{a}.tokens") <= F.size(f"{b}.tokens"), F.col(f"{a}.fragment")).otherwise(F.col(f"{b}.fragment"))
    more = F.array_except(long, short)
    return (F.size(short) >= 2) & (F.size(F.array_except(short, long)) == 0) & (F.size(more) <= extra) & ((F.size(F.array_intersect(more, F.array(*map(F.lit, SITE_WORDS)))) == 0) | piece)


def candidate_pairs(label: DataFrame, same_m: float = 150.0, near_m: float = 1000.0, extra: int = 3) -> DataFrame:
    """(location_a, location_b, metres): sub-labels at one point, or near by with three words or more.

    Labels meet in 3 x 3 grid cells of near_m; each label exists once, so a station with many rows is one row here.
    """
    step = near_m / X.DEGREE_M
    cell = label.withColumn("r", F.floor(F.col("lat") / step)).withColumn("c", F.floor(F.col("lon") / step))
    a = cell.withColumn("r", F.explode(F.array(F.col("r") - 1, F.col("r"), F.col("r") + 1))).withColumn("c", F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1))).alias("a")
    b = cell.alias("b")
    m = X.flat_m(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    words = F.least(F.size("a.tokens"), F.size("b.tokens"))
    met = a.join(b, (F.col("a.r") == F.col("b.r")) & (F.col("a.c") == F.col("b.c")) & (F.col("a.first") < F.col("b.first")))
    return met.where(comparable("a", "b", extra) & ((m <= same_m) | ((m <= near_m) & (words >= 3)))).select(F.col("a.location").alias("location_a"), F.col("b.location").alias("location_b"), F.round(m, 3).alias("metres"))


def _is_sub(a: frozenset, b: frozenset, fragment_a: bool, fragment_b: bool, extra: int) -> bool:
    (short, piece), (long, _) = sorted(((a, fragment_a), (b, fragment_b)), key=lambda x: len(x[0]))
    more = long - short
    return len(short) >= 2 and short <= long and len(more) <= extra and (piece or not more & set(SITE_WORDS))


def merge_groups(label: DataFrame, pairs: DataFrame, extra: int = 3) -> DataFrame:
    """(location, merged_into) by greedy union in first-seen order, within each connected group of candidates.

    A union needs every cross pair comparable and not both sides of a structure. The kept label starts and reads as a
    whole one, then has the most words, the most rows, and the first name; pasted numbers are cut off it.
    """
    from hydroframe.operators.graph import components

    ids = label.select(F.col("first").alias("node"), "location")
    edge = pairs.join(ids.withColumnsRenamed({"location": "location_a", "node": "a"}), "location_a").join(ids.withColumnsRenamed({"location": "location_b", "node": "b"}), "location_b").select("a", "b")
    group = components(ids.select("node"), edge)
    near = edge.join(group.withColumnRenamed("node", "a"), "a").groupBy("component").agg(F.collect_list(F.struct("a", "b")).alias("edges"))
    members = label.withColumnRenamed("first", "node").join(group, "node").join(near, "component")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        if len(f) > MAX_GROUP:
            raise ValueError(f"a group of variants has at most {MAX_GROUP} labels")
        f = f.sort_values("node").reset_index(drop=True)
        at = {n: i for i, n in enumerate(f["node"])}
        tokens = [frozenset(t) for t in f["tokens"]]
        root = list(range(len(f)))
        sets = {i: [i] for i in root}
        find = lambda i: i if root[i] == i else find(root[i])
        for e in sorted(((at[x["a"]], at[x["b"]]) for x in f["edges"].iloc[0])):
            x, y = find(e[0]), find(e[1])
            if x == y:
                continue
            both = sets[x] + sets[y]
            if len({f["marker"][i] for i in both} - {""}) > 1 or not all(_is_sub(tokens[i], tokens[j], f["fragment"][i], f["fragment"][j], extra) for i in sets[x] for j in sets[y]):
                continue
            root[y] = x
            sets[x] = both
            del sets[y]
        rows = []
        for ids_ in sets.values():
            first = lambda s: re.findall("[A-Z0-9]+", s.upper())[:1]
            kept = min(ids_, key=lambda i: (first(f["location"][i]) and first(f["location"][i])[0] in FRAGMENT_START, bool(re.search(_PASTED, f["location"][i])), -len(tokens[i]), -f["n_rows"][i], f["location"][i]))
            name = " ".join(re.sub(_PASTED, " ", f["location"][kept]).split()).strip(" ,")
            rows += [(f["location"][i], name) for i in ids_ if f["location"][i] != name]
        return pd.DataFrame(rows, columns=["location", "merged_into"])

    return members.groupBy("component").applyInPandas(run, "location string, merged_into string")


def merge_duplicates(rows: DataFrame, same_m: float = 150.0, near_m: float = 1000.0, extra: int = 3) -> DataFrame:
    """rows with merged labels replaced."""
    label = labels(rows)
    into = merge_groups(label, candidate_pairs(label, same_m, near_m, extra), extra)
    return rows.join(into, "location", "left").withColumn("location", F.coalesce("merged_into", "location")).drop("merged_into")
