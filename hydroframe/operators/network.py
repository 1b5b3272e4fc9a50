"""The channel network: stations placed on named channels, ordered towards each channel's outlet."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hydroframe.functions import text as X
from hydroframe.functions.names import canonical_names, name_base, name_similarity, near_bases, parse_water_body
from hydroframe.operators import channels, graph
from hydroframe.plans.io import cut

CONFLUENCE_M = 250.0
DEFER_KM, COMPANY_KM = 5.0, 10.0
LOW_SPREAD_M = 5.0
REFERENCE_LIKENESS = 0.85
GROUP_LIKENESS = 0.9
SAME_NAME = 0.8
SNAP_M = 15_000.0
SLACK_M = 3.0
ENDS = 6
# How labels say that they lie downstream of a water, or at its end.
DOWNSTREAM_OF = r"(?i)\b(?:D\s*/\s*S|DOWN\s*STREAM|DOWNSTREAM)\b\.?\s*(?:OF\s+)?(?:THE\s+)?(.+)$"
AT_CONFLUENCE = r"(?i)\b(?:BEFORE|AT|NEAR|U\s*/\s*S\s+OF)\s+(?:THE\s+)?(?:CONFLUENCE|CONF)\b"


def line_ends(lines: DataFrame) -> DataFrame:
    """(node, line_id, end, x, y, length): both ends of every line, ends that touch sharing a node."""
    length = channels.segments(lines).groupBy("line_id").agg(F.sum("length").alias("length"))
    ends = lines.select("line_id", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("pts")[0].alias("p")), F.struct(F.lit(1).alias("end"), F.element_at("pts", -1).alias("p")))).alias("e")).select("line_id", "e.end", F.col("e.p.x").alias("x"), F.col("e.p.y").alias("y"))
    nodes = channels.touching(lines).select("node", "line_id", "x", "y").dropDuplicates(["line_id", "x", "y"])
    return ends.join(nodes, ["line_id", "x", "y"]).join(length, "line_id")


def far_ends(ends: DataFrame, most: int = ENDS) -> DataFrame:
    """The (channel, node) ends farthest from the centre of their channel's ends, at most `most` each (a top-k report);
    source and mouth are among them.

    ends: channel, node, x, y, one row an end.
    """
    centre = ends.groupBy("channel").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    away = X.flat_m(F.col("y"), F.col("x"), F.col("cy"), F.col("cx"))
    w = W.partitionBy("channel").orderBy(F.col("away").desc(), "node")
    return ends.join(centre, "channel").withColumn("away", F.round(away, 3)).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).select("channel", "node")


def outlets(lines: DataFrame, channel: DataFrame, heights: DataFrame | None = None) -> DataFrame:
    """(channel, node, reason, joins): where each channel leaves.

    Where known heights of ends differ by five metres, the lowest end, or the nearest confluence up to three metres
    above it; else a drawn end within 250 m of a line of another name; else the only such end; else a drawn end; else
    the nearest such end; else the end of the longest line. joins is the line it meets. Heights count for the six
    ends farthest from the channel's centre.
    """
    ends = cut(line_ends(lines).join(channel, "line_id"))
    degree = ends.groupBy("channel", "node").agg(F.count(F.lit(1)).alias("degree"), F.min("end").alias("drawn"), F.first("x").alias("x"), F.first("y").alias("y"))
    loose = degree.where("degree = 1")
    at = loose.select(F.struct("channel", "node").alias("station"), F.col("y").alias("lat"), F.col("x").alias("lon"))
    named = lines.select("line_id", name_base("name").alias("base"))
    own = channel.join(named, "line_id").groupBy("channel").agg(F.min("base").alias("own"))
    met = channels.nearby_lines(at, channels.segments(lines), CONFLUENCE_M / 1000).select("station.channel", "station.node", "line_id", "metres")
    met = met.join(named, "line_id").join(own, "channel").where("base <> own AND base <> ''").groupBy("channel", "node").agg(F.min_by(F.struct("line_id", "metres"), F.struct("metres", "line_id")).alias("b")).select("channel", "node", F.col("b.line_id").alias("joins"), F.col("b.metres").alias("gap"))
    longest = ends.where("end = 1").groupBy("channel").agg(F.min_by("node", F.struct(-F.col("length"), "line_id")).alias("last_end"))
    c = degree.join(met, ["channel", "node"], "left").join(longest, "channel", "left")
    if heights is None:
        c = c.withColumn("height", F.lit(None).cast("double"))
    else:
        known = far_ends(loose).join(heights.select("node", F.col("m").alias("height")), "node").where("height is not null")
        c = c.join(known, ["channel", "node"], "left")
    per = W.partitionBy("channel")
    least = F.min("height").over(per)
    steep = F.max("height").over(per) - least >= LOW_SPREAD_M
    touch, drawn = F.col("joins").isNotNull(), (F.col("degree") == 1) & (F.col("drawn") == 1)
    touches = F.count_if(touch).over(per)
    low = F.when(touch & (F.col("height") <= least + SLACK_M), 0).when(F.col("height").isNotNull(), 1)
    rank = F.when(steep & low.isNotNull(), low).when(touch & drawn, 2).when(touch & (touches == 1), 3).when(drawn, 4).when(touch, 5).when(F.col("node") == F.col("last_end"), 6).otherwise(7)
    c = c.withColumn("rank", rank)
    by = F.when(F.col("rank").isin(0, 2, 5), F.col("gap")).when(F.col("rank") == 1, F.col("height"))
    best = c.withColumn("by", by).withColumn("n", F.row_number().over(per.orderBy("rank", "by", "node"))).where("n = 1")
    confluence = F.col("rank").isin(0, 2, 3, 5) | ((F.col("rank") == 1) & F.col("joins").isNotNull())
    reason = F.when(confluence, "confluence").when(F.col("rank") == 1, "lowest end").otherwise("drawn end")
    return best.select("channel", "node", reason.alias("reason"), F.when(confluence, F.col("joins")).alias("joins"))


def channel_network(stations: DataFrame, lines: DataFrame, limit_km: float = 2.0, heights: DataFrame | None = None) -> DataFrame:
    """(station, channel, line_id, position, to_outlet_m, method, reason, joins) of every station.

    stations: station, label, name ('' unknown), lat, lon. Named stations without a line go to the channel that most
    placed stations of their name are on; unnamed ones a little too far join a line within 5 km that has a placed
    station within 10 km; the rest has no channel.
    """
    channel = cut(channels.channels(lines))
    m = cut(channels.match_stations(stations, lines, limit_km))
    placed = m.where("line_id is not null").select("station", "line_id", "metres", "along", "method")
    rest = stations.join(placed, "station", "left_anti")
    base = stations.select("station", name_base("name").alias("base"))
    votes = placed.join(base, "station").where("base <> ''").join(channel, "line_id").groupBy("base", "channel").agg(F.count(F.lit(1)).alias("n"))
    most = votes.withColumn("r", F.row_number().over(W.partitionBy("base").orderBy(F.col("n").desc(), "channel"))).where("r = 1").select("base", "channel")
    voted = rest.join(base, "station").where("base <> ''").join(most, "base").select("station", "channel")
    unnamed = rest.where("trim(name) = ''").select("station", "lat", "lon")
    near = channels.nearby_lines(unnamed, channels.segments(lines), DEFER_KM).groupBy("station").agg(F.min_by(F.struct("line_id", "metres", "along"), F.struct("metres", "line_id")).alias("b")).select("station", "b.*")
    company = placed.join(channel, "line_id").join(stations.select("station", "lat", "lon"), "station").select(F.col("channel"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    step = COMPANY_KM * 1000 / X.DEGREE_M
    late = near.join(channel, "line_id").join(unnamed, "station").withColumn("r", F.explode(F.array(*(F.floor(F.col("lat") / step) + k for k in (-1, 0, 1)))))
    with_friend = late.join(company.withColumn("r", F.floor(F.col("lat2") / step)), ["channel", "r"]).where(X.haversine_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) <= COMPANY_KM * 1000).select("station").distinct()
    deferred = near.join(with_friend, "station", "left_semi").select("station", "line_id", "metres", "along", F.lit("near others").alias("method"))
    on_line = placed.unionByName(deferred).join(channel, "line_id")
    everyone = on_line.select("station", "channel", "line_id", "metres", "along", "method").unionByName(voted.select("station", "channel", F.lit(None).cast(dict(lines.dtypes)["line_id"]).alias("line_id"), F.lit(None).cast("double").alias("metres"), F.lit(None).cast("double").alias("along"), F.lit("name only").alias("method")))
    out = cut(outlets(lines, channel, heights))
    ends = cut(line_ends(lines).join(channel, "line_id"))
    way = ends.groupBy("channel", "line_id", "length").agg(F.min_by("node", "end").alias("a"), F.max_by("node", "end").alias("b"))
    code = lambda c: F.concat_ws(":", "channel", c)
    d = graph.outlet_distance(way.select(code("a").alias("up"), code("b").alias("down"), "length"), out.select(code("node").alias("node")))
    ranges = way.join(d.select(F.col("node").alias("_a"), F.col("distance").alias("da")), code("a") == F.col("_a"), "left").join(d.select(F.col("node").alias("_b"), F.col("distance").alias("db")), code("b") == F.col("_b"), "left")
    e = everyone.join(ranges.select("line_id", "length", "da", "db"), "line_id", "left")
    to = F.when(F.col("metres") <= SNAP_M, F.least(F.col("da") + F.col("along"), F.col("db") + F.col("length") - F.col("along")))
    e = e.withColumn("to_outlet_m", F.round(to, 1)).join(stations.select("station", "label"), "station")
    e = at_confluence(e.join(out.select("channel", "reason"), "channel", "left"))
    e = cut(e.select("station", "channel", "label", "line_id", "method", "to_outlet_m"))
    order = channels.order_stations(e.select("channel", "station", "label", "to_outlet_m"))
    full = e.drop("label").join(order.select("station", "position"), "station").join(out.select("channel", "reason", "joins"), "channel", "left")
    return stations.select("station").join(full, "station", "left").withColumn("method", F.coalesce("method", F.lit("unassigned")))


def downstream_references(stations: DataFrame, names: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(station, channel): every other channel that a station's label says it lies downstream of.

    stations: station, label, own_channel (null if none); names: channel, name, with a row for every name and alias;
    aliases as from sources.tables.alias_table. The distinct names said and known meet by near_bases().
    """
    said = F.regexp_extract("label", DOWNSTREAM_OF, 1)
    s = stations.select("station", "own_channel", F.trim(said).alias("said")).where("said <> ''")
    s = s.withColumn("said", F.coalesce(F.nullif(parse_water_body("said"), F.lit("")), F.col("said")))
    s = (s if aliases is None else canonical_names(s, "said", aliases)).withColumn("a", name_base("said"))
    n = names.withColumn("b", name_base("name")).where("b <> ''").select("channel", "b").distinct()
    met = near_bases(s.select(F.col("a").alias("base")), n.select(F.col("b").alias("base")), REFERENCE_LIKENESS)
    found = s.join(met, "a").join(n, "b").where(F.coalesce(F.col("own_channel") != F.col("channel"), F.lit(True)))
    return found.select("station", "channel").distinct()


def at_confluence(placed: DataFrame) -> DataFrame:
    """placed (label, reason, to_outlet_m, ...): a station of unknown distance whose label says that it lies at or before
    the confluence, on a channel that ends in one, lies at its end (0 m)."""
    there = F.col("to_outlet_m").isNull() & (F.col("reason") == "confluence") & F.col("label").rlike(AT_CONFLUENCE)
    return placed.withColumn("to_outlet_m", F.when(there, F.lit(0.0)).otherwise(F.col("to_outlet_m"))).withColumn("position_from", F.when(there, "station label (at the confluence)"))


def loose_names(stations: DataFrame) -> DataFrame:
    """(name, grouped_as): names off the network, each under the first seen that is at least 0.9 alike.

    The order matters, so names are worked through in that order, but only within groups connected by near_bases().
    """
    n = stations.where("trim(name) <> ''").groupBy("name").agg(F.min("row_id").alias("first")).withColumn("base", name_base("name"))
    heads = n.where("base <> ''").groupBy("base").agg(F.min("first").alias("node"))
    near = cut(near_bases(heads, heads, GROUP_LIKENESS).where("a <> b"))
    edges = near.join(heads.select(F.col("base").alias("a"), F.col("node").alias("n_a")), "a").join(heads.select(F.col("base").alias("b"), F.col("node").alias("n_b")), "b")
    group = graph.components(heads.select("node"), edges.select(F.col("n_a").alias("a"), F.col("n_b").alias("b")))
    members = heads.join(group, "node").join(edges.groupBy(F.col("n_a").alias("node")).agg(F.collect_list("n_b").alias("near")), "node", "left")

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("node")
        kept: list[int] = []
        out = []
        for base, node, near_ in zip(f["base"], f["node"], f["near"]):
            like = set(near_) if near_ is not None else set()
            head = next((k for k in kept if k in like), None)
            if head is None:
                kept.append(head := node)
            out.append((base, head))
        return pd.DataFrame(out, columns=["base", "head"])

    grouped = members.groupBy("component").applyInPandas(fold, "base string, head long")
    first = n.select(F.col("first").alias("head"), F.col("name").alias("grouped_as"))
    named = n.join(grouped, "base").join(first, "head").select("name", "grouped_as")
    # A name of kinds of water alone is like no other.
    return named.unionByName(n.where("base = ''").select("name", F.col("name").alias("grouped_as")))


def display_names(channel: DataFrame, stations: DataFrame, names: DataFrame) -> DataFrame:
    """(channel, name, network_name, aliases, slug): what a channel is called, most stations first.

    channel: station, channel; stations: station, water_body (of the file, '' unknown), parsed (from the label, ''
    unknown); names: channel, name (of its lines). The one name that the file's stations have; else, where the file
    has none, the label name that most stations have, if it is unlike the lines' name and either half of the stations
    have it or no label uses the lines' name; else the lines' name. Other label names are aliases.
    """
    s = channel.where("channel is not null").join(stations.select("station", F.trim("water_body").alias("body"), F.trim("parsed").alias("parsed")), "station")
    total = s.groupBy("channel").agg(F.count(F.lit(1)).alias("n_stations"), F.collect_set(F.nullif("body", F.lit(""))).alias("bodies"))
    labels = s.where("parsed <> ''").groupBy("channel", "parsed").agg(F.count(F.lit(1)).alias("n")).join(names.select("channel", F.col("name").alias("line_name")), "channel")
    labels = labels.withColumn("own", name_similarity("parsed", "line_name") >= SAME_NAME)
    top = labels.groupBy("channel").agg(F.min_by(F.struct("parsed", "n", "own"), F.struct(-F.col("n"), "parsed")).alias("top"), F.max("own").alias("own_used"))
    j = total.join(names.select("channel", F.col("name").alias("line_name")), "channel").join(top, "channel", "left")
    local = (F.size("bodies") == 0) & F.col("top").isNotNull() & ~F.col("top.own") & ((F.col("top.n") * 2 >= F.col("n_stations")) | ~F.col("own_used"))
    line = F.coalesce(F.nullif("line_name", F.lit("")), F.lit("Unnamed channel"))
    shown = j.select("channel", "n_stations", line.alias("network_name"), F.when(F.size("bodies") == 1, F.get("bodies", F.lit(0))).when(local, F.col("top.parsed")).otherwise(line).alias("name"))
    other = labels.where("not own").join(shown.select("channel", "name"), "channel").where(name_similarity("parsed", "name") < SAME_NAME)
    alias = other.groupBy("channel").agg(F.array_sort(F.collect_set("parsed")).alias("aliases"))
    out = shown.join(alias, "channel", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    slug = X.slug(F.col("name"), "channel")
    # Equal slugs are told apart by repeated suffixes, in the order of the channels.
    again = F.row_number().over(W.partitionBy(slug).orderBy("channel")) - 1
    return out.withColumn("slug", F.concat(slug, F.repeat(F.lit("-2"), again))).orderBy(F.col("n_stations").desc(), F.lower("name"), "channel")
