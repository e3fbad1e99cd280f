"""Map-feature operators: extract scan, classification, routing to lines and polygons, ring assembly.

Elements: type, id, tags MAP<STRING,STRING>, points ARRAY<STRUCT<x,y>> (lon, lat), members for
relations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tags as T
from .chains import ranked_chains
from .lineage import cut

CLOSED_DEG = 1e-9
RINGS = "array<array<struct<x: double, y: double>>>"


def clean_points(points: Column) -> Column:
    """Without vertices that are not finite."""
    good = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.filter(points, lambda p: good(p["x"]) & good(p["y"]))


def is_closed(points: Column) -> Column:
    a, b = F.get(points, F.lit(0)), F.try_element_at(points, F.lit(-1))
    return F.coalesce((F.size(points) >= 4) & (F.abs(a["x"] - b["x"]) < CLOSED_DEG) & (F.abs(a["y"] - b["y"]) < CLOSED_DEG), F.lit(False))


def open_ring(points: Column) -> Column:
    return F.when(is_closed(points), F.slice(points, 1, F.size(points) - 1)).otherwise(points)


def classified(elements: DataFrame) -> DataFrame:
    """elements with `kind` STRUCT<layer, subtype, bridge, width_m>, null where nothing is printed."""
    return elements.withColumn("kind", T.classify(F.col("tags")))


def routed(elements: DataFrame) -> DataFrame:
    """Elements with `route`: line, polygon, skipped, or ignored (no tags, or fewer than two points).

    One pass: each row is judged by itself. A class with a width is a line even where it is closed;
    one without is a polygon if closed and skipped if open. With a column `members`, relations become
    polygons: one row for each outer ring, numbered by `part`, with all inner rings in `inners`; without
    an outer ring they are ignored, as are nodes.
    """
    w = classified(elements.withColumn("points", clean_points(F.col("points"))))
    untagged = F.coalesce(F.size("tags"), F.lit(0)) <= 0
    whole = "members" in elements.columns
    relation = F.coalesce(F.col("type") == "relation", F.lit(False)) if whole else F.lit(False)
    other = F.coalesce(~F.col("type").isin("way", "relation"), F.lit(False)) if whole else F.lit(False)
    if whole:
        w = _with_rings(w, relation & ~untagged & F.col("kind").isNotNull())
        w = w.withColumn("points", F.when(relation, F.concat("outer", F.slice("outer", 1, 1))).otherwise(F.col("points"))).drop("outer")
    else:
        w = w.withColumns({"part": F.lit(0), "inners": F.lit(None).cast(RINGS)})
    w = w.withColumn("inners", F.coalesce("inners", F.array().cast(RINGS)))
    route = (
        F.when(untagged, "ignored").when(F.col("kind").isNull(), "skipped").when(other, "ignored").when(relation, F.when(F.col("points").isNull(), "ignored").otherwise("polygon")).when(F.size("points") < 2, "ignored")
        .when(F.col("kind.width_m").isNotNull(), "line").when(is_closed(F.col("points")), "polygon").otherwise("skipped")
    )
    return w.withColumn("route", route)


def _with_rings(elements: DataFrame, relation: Column) -> DataFrame:
    """elements, a relation once for each of its outer rings: `part`, `outer`, and `inners`, all of its inner rings."""
    some = F.coalesce(relation, F.lit(False))
    rels = cut(elements.filter(some).withColumn("_row", F.monotonically_increasing_id()))
    m = rels.select("_row", F.posexplode("members").alias("ord", "m")).filter("m.type = 'way'")
    v = m.select("_row", "ord", F.coalesce("m.role", F.lit("?")).alias("role"), F.posexplode("m.geometry").alias("seq", "g")).select(F.col("_row").alias("rel_id"), "ord", "role", "seq", F.col("g.lon").alias("x"), F.col("g.lat").alias("y"))
    ring = assembled_rings(v).groupBy("rel_id", "role", "ring").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))
    of = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("ring", "points")))), lambda r: r["points"])
    found = ring.groupBy("rel_id").agg(of("outer").alias("outers"), of("inner").alias("inners"))
    joined = rels.join(found, F.col("_row") == F.col("rel_id"), "left").drop("rel_id", "_row")
    each = joined.select("*", F.posexplode_outer("outers").alias("part", "outer")).withColumn("part", F.coalesce("part", F.lit(0))).drop("outers")
    none = {"part": F.lit(0), "outer": F.lit(None).cast(each.schema["outer"].dataType), "inners": F.lit(None).cast(each.schema["inners"].dataType)}
    return elements.filter(~some).withColumns(none).unionByName(each)


def assembled_rings(members: DataFrame) -> DataFrame:
    """rel_id, role, ring, seq, x, y: fragments of each relation joined into rings by their ends.

    Input: rel_id, ord, role, seq, x, y, one row for each vertex; roles are outer (also ''), and inner. Where fragments meet, their
    ends are paired in the order of the members. Walked from either side, fragments are links of a chain, which
    is ordered by pointer doubling: a ring may have any number of members. A ring begins with its first member, as that
    runs; rings are numbered in the order of these. A chain that does not close is a ring too, from end to end. Rings
    of fewer than three points go, and so do fragments of fewer than two.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    role = F.when(F.col("role").isin("outer", ""), "outer").when(F.col("role") == "inner", "inner")
    points = members.filter(finite("x") & finite("y")).withColumn("role", role).filter("role IS NOT NULL")
    model = [F.struct("rel_id", "role").alias("model_id")]
    f = points.groupBy(*model, F.col("ord").cast("long").alias("ord")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ps"))
    f = f.filter("size(ps) >= 2").withColumn("whole", is_closed(F.col("ps")))
    f = cut(f)
    key = lambda p: F.struct(F.floor(p["x"] / CLOSED_DEG + 0.5).alias("x"), F.floor(p["y"] / CLOSED_DEG + 0.5).alias("y"))
    ends = f.filter("NOT whole").select("model_id", "ord", F.posexplode(F.array(key(F.element_at("ps", 1)), key(F.element_at("ps", -1)))).alias("end", "at"))
    w = Window.partitionBy("model_id", "at").orderBy("ord", "end")
    odd = F.row_number().over(w) % 2 == 1
    other = lambda c: F.when(odd, F.lead(c).over(w)).otherwise(F.lag(c).over(w))
    met = ends.select("model_id", "ord", "end", other("ord").alias("to"), other("end").alias("by"))
    # a fragment walked forwards (ord * 2) leaves by its end 1, backwards (ord * 2 + 1) by its end 0; at a loose end the walk turns
    link = F.coalesce(F.col("to") * 2 + F.col("by"), F.col("ord") * 2 + F.col("end"))
    links = met.select("model_id", (F.col("ord") * 2 + 1 - F.col("end")).alias("id"), link.alias("next"), F.col("to").isNull().alias("loose"))
    links = cut(links)
    ranked = ranked_chains(links.select("model_id", "id", "next"), ["model_id"])
    sized = Window.partitionBy("model_id", "ring")
    turn = ranked.join(links.select("model_id", "id", "loose"), ["model_id", "id"]).withColumns({"last": F.min(F.when(F.col("loose"), F.col("seq"))).over(sized), "links": F.count("*").over(sized)})
    # a closed chain is there twice, once each way; one with loose ends is there once, and back again
    forward = F.when(F.col("last").isNull(), F.col("ring") % 2 == 0).otherwise((F.col("seq") <= F.col("last")) | (F.col("seq") > F.col("last") + F.col("links") / 2))
    order = F.when(F.col("last").isNull(), F.col("seq")).otherwise((F.col("seq") + F.col("links") / 2 - F.col("last") - 1) % F.col("links"))
    chains = turn.filter(forward).select("model_id", F.floor(F.col("ring") / 2).alias("first"), order.cast("long").alias("order"), F.floor(F.col("id") / 2).alias("ord"), (F.col("id") % 2 == 1).alias("back"))
    alone = f.filter("whole").select("model_id", F.col("ord").alias("first"), F.lit(0).cast("long").alias("order"), "ord", F.lit(False).alias("back"))
    each = chains.unionByName(alone).join(f.select("model_id", "ord", "ps"), ["model_id", "ord"])
    run = F.when(F.col("back"), F.reverse("ps")).otherwise(F.col("ps"))
    own = F.when(F.col("order") == 0, run).otherwise(F.slice(run, F.lit(2), F.size("ps") - 1))
    rings = each.select("model_id", "first", "order", own.alias("ps")).groupBy("model_id", "first").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("order", "ps"))), lambda x: x["ps"])).alias("ps"))
    rings = rings.select("model_id", "first", open_ring(F.col("ps")).alias("ps")).filter("size(ps) >= 3")
    rings = rings.withColumn("ring", (F.row_number().over(Window.partitionBy("model_id").orderBy("first")) - 1).cast("int"))
    return rings.select("model_id.rel_id", "model_id.role", "ring", F.posexplode("ps").alias("seq", "p")).select("rel_id", "role", "ring", "seq", "p.x", "p.y")


def enabled(features: DataFrame, settings: DataFrame) -> DataFrame:
    """features (layer, subtype) of enabled layers (layer, enabled, subtypes): an empty list of subtypes means all of them."""
    s = F.broadcast(settings.filter("enabled").select(F.col("layer").alias("_layer"), "subtypes"))  # one row a layer
    wanted = (F.size("subtypes") == 0) | F.array_contains("subtypes", F.col("subtype"))
    return features.join(s, (F.col("layer") == F.col("_layer")) & wanted, "left_semi")
