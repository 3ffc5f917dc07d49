"""Range, nearest and set joins."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from spanlight.operators.prefix import numbered, tiles
from spanlight.operators.windows import DAY, merge_intervals, points_inside
from spanlight.sources.io import stored


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int, place: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, with their place."""
    return rows.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(place) <= k)


def view_agreement(observations: DataFrame, sizes: Iterable[int]) -> DataFrame:
    """How far two views share windows, and tactics within shared windows, for several window sizes."""
    sized = observations.withColumn("size", F.explode(F.array(*map(F.lit, sizes))))
    sets = [F.collect_set(F.when(F.col("view") == v, F.col("tactic"))).alias(v) for v in ("network", "provenance")]
    w = sized.groupBy("size", F.floor(F.col("ts_s") / F.col("size")).alias("w")).agg(*sets)
    paired = (F.size("network") > 0) & (F.size("provenance") > 0)
    return w.groupBy("size").agg(
        F.count("*").alias("union_windows"), F.count_if(paired).alias("paired"), (F.count_if(paired) / F.count("*")).alias("jaccard"),
        F.count_if(paired & F.arrays_overlap("network", "provenance")).alias("agreeing"),
    )


def retention(flow: DataFrame, alerts: DataFrame, budgets: Iterable[float], radius: int) -> DataFrame:
    """Share of time, rows and bytes that stays if only the time around the best alerts is kept."""
    ranked = alerts.withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    w = Window.partitionBy("budget")
    place = F.row_number().over(w.orderBy(F.desc("score"), "h"))
    chosen = ranked.withColumns({"place": place, "total": F.count("*").over(w)}).where(F.col("place") <= F.ceil(F.col("budget") * F.col("total")))
    capture = F.broadcast(flow.agg(F.min("ts_s").alias("lo"), F.max("ts_s").alias("hi"), F.count("*").alias("rows_all"), F.sum("size").alias("bytes_all")))
    around = chosen.crossJoin(capture).select("budget", F.greatest(F.col("lo"), F.col("h") * 3600 - radius).alias("a"), F.least(F.col("hi"), F.col("h") * 3600 + radius).alias("b"))
    m = merge_intervals(around, ["budget"], "a", "b")
    time = m.groupBy("budget").agg(F.count("*").alias("intervals"), F.sum(F.col("b") - F.col("a")).alias("seconds"))
    points = flow.withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    kept = points_inside(points, m, ["budget"], "ts_s", "a", "b", 2 * radius).groupBy("budget").agg(F.count("*").alias("rows_n"), F.sum("size").alias("bytes"))
    return time.join(kept, "budget").crossJoin(capture).select(
        "budget", "intervals", F.round(F.col("seconds") / (F.col("hi") - F.col("lo")), 9).alias("time_share"), (F.col("rows_n") / F.col("rows_all")).alias("row_share"), F.round(F.col("bytes") / F.col("bytes_all"), 9).alias("byte_share")
    )


def within(left: DataFrame, right: DataFrame, centre: str, ts: str, radius: float, keys: list[str] = ()) -> DataFrame:
    """All pairs with ``abs(ts - centre) <= radius``, ends included, and equal ``keys``.

    Time is cut into buckets as wide as the radius. A centre goes to three of them, a row to one,
    and an equi-join on the bucket replaces the inequality; the exact condition is checked after.
    """
    b = F.floor(F.col(centre) / radius)
    l = left.withColumn("_b", F.explode(F.array(b - 1, b, b + 1)))
    r = right.withColumn("_b", F.floor(F.col(ts) / radius))
    return l.join(r, ["_b", *keys]).where(F.abs(F.col(ts) - F.col(centre)) <= radius).drop("_b")


def nearest_distance(rows: DataFrame, key: str, ts: str, side: str, a: str, b: str, block: float = DAY) -> DataFrame:
    """For each row of either side, the distance to the nearest row of the other side with the same key.

    Rows without a partner are left out. One ordered pass each way inside blocks of time; no pairs
    are formed. Of each block only its first and last time of either side are ordered over a whole
    key, so a key with very many rows spreads over as many tasks as it has blocks.
    """
    order = Window.partitionBy(key, "_block").orderBy(ts)
    over_key = Window.partitionBy(key).orderBy("_block")
    earlier, later = over_key.rowsBetween(Window.unboundedPreceding, -1), over_key.rowsBetween(1, Window.unboundedFollowing)
    other = F.when(F.col(side) == a, b).otherwise(a)
    rows = rows.withColumn("_block", F.floor(F.col(ts) / block))
    tops: dict[str, Column] = {}
    ends: list[Column] = []
    edges: list[Column] = []
    for s in (a, b):
        at = F.when(F.col(side) == s, F.col(ts))
        ends += [F.max(at).alias(f"_last_{s}"), F.min(at).alias(f"_first_{s}")]
        edges += [F.last(f"_last_{s}", ignorenulls=True).over(earlier).alias(f"_past_{s}"), F.first(f"_first_{s}", ignorenulls=True).over(later).alias(f"_next_{s}")]
        tops[f"before_{s}"] = F.coalesce(F.last(at, ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, 0)), f"_past_{s}")
        tops[f"after_{s}"] = F.coalesce(F.first(at, ignorenulls=True).over(order.rangeBetween(0, Window.unboundedFollowing)), f"_next_{s}")
    around = rows.groupBy(key, "_block").agg(*ends).select(key, "_block", *edges)
    wide = rows.join(around, [key, "_block"]).withColumns(tops).withColumn("_other", other)
    gaps = [F.when(F.col("_other") == s, F.abs(F.col(ts) - F.col(f"{w}_{s}"))) for s in (a, b) for w in ("before", "after")]
    return wide.withColumn("distance", F.least(*gaps)).where("distance is not null").select(*(c for c in rows.columns if c != "_block"), "distance")


def nearest_flow(sockets: DataFrame, flow: DataFrame, offsets: Iterable[float], tolerance: float) -> DataFrame:
    """The flow nearest in time to each socket, at each clock offset, with the socket's remote address and port at either end.

    Ties go to the earlier flow row and then to the source end. A flow counts once for each end.
    No pairs are formed: flow ends of one time are one row, and inside each address, port and time bucket a centre takes the last
    time up to it and the first from it on, from one ordered pass each way.
    """
    ends = flow.select(
        "row_id", F.col("ts_s").alias("at"),
        F.explode(F.array(*(F.struct(F.lit(n).alias("side"), F.col(i).alias("ip"), F.col(p).alias("port"), F.col(li).alias("local_ip")) for n, (i, p, li) in enumerate((("src_ip", "src_port", "dst_ip"), ("dst_ip", "dst_port", "src_ip")))))).alias("e"),
    ).select("row_id", "at", "e.*").where("ip is not null and port is not null")
    b = F.floor(F.col("at") / tolerance)
    ends = ends.groupBy("ip", "port", "at").agg(F.min(F.struct("row_id", "side", "local_ip")).alias("m"))
    ends = ends.select("ip", "port", "at", b.alias("_b"), F.struct(F.col("at").alias("flow_s"), "m.*").alias("end"))
    s = sockets.select("socket_id", F.col("remote_ip").alias("ip"), F.col("remote_port").alias("port"), "ts_s", F.explode(F.array(*map(F.lit, offsets))).alias("offset"))
    s = s.withColumn("at", F.col("ts_s") + F.col("offset")).drop("ts_s").withColumn("_b", F.explode(F.array(b - 1, b, b + 1)))
    both = s.unionByName(ends, allowMissingColumns=True)
    place = Window.partitionBy("_b", "ip", "port")
    upto = lambda o: F.last("end", ignorenulls=True).over(place.orderBy(o).rangeBetween(Window.unboundedPreceding, 0))
    near = both.withColumn("before", upto(F.asc("at"))).withColumn("after", upto(F.desc("at"))).where("offset is not null")
    near = near.select("socket_id", "offset", "at", F.explode(F.array("before", "after")).alias("e")).where("e is not null")
    delta = F.abs(F.col("e.flow_s") - F.col("at"))
    m = F.min(F.struct(delta.alias("delta"), "e.row_id", "e.side", "e.local_ip")).alias("m")
    return near.where(delta <= tolerance).groupBy("socket_id", "offset").agg(m).select("socket_id", "offset", "m.*")


def socket_observations(edges: DataFrame, nodes: DataFrame, usable: Column) -> DataFrame:
    """Connect edges with their socket and process; the first row of each (process, time, address, port) stays."""
    socket = nodes.where("subtype = 'network socket'").select(F.col("id").alias("src"), "remote_ip", "remote_port")
    process = nodes.where("type = 'Process'").select(F.col("id").alias("dst"), "pid", "exe")
    found = edges.where("operation = 'connect'").join(socket, "src").join(process, "dst")
    first = Window.partitionBy("dst", "ts_s", "remote_ip", "remote_port").orderBy("row_id")
    return found.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").where(usable).withColumnRenamed("row_id", "socket_id")


def seed_reach(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """``case_id, id, m0 .. m<hops>``: from which kinds of seeds each node is reached within so many undirected steps.

    ``edges`` is ``case_id, u, v``, ``seeds`` ``case_id, id, mask`` with a bit for each kind of seed. All kinds expand in one pass:
    a hop is one join, in which a node's neighbours' bits are merged by ``bit_or``, so hubs do not multiply paths.
    """
    both = stored(edges.select("case_id", "u", "v").union(edges.select("case_id", F.col("v"), F.col("u"))).distinct())
    state = stored(seeds.groupBy("case_id", "id").agg(F.bit_or("mask").alias("m0")))
    for hop in range(1, hops + 1):
        last = f"m{hop - 1}"
        step = state.where(F.col(last) != 0).select("case_id", F.col("id").alias("u"), last).join(both, ["case_id", "u"]).groupBy("case_id", F.col("v").alias("id")).agg(F.bit_or(last).alias("_new"))
        older = [F.coalesce(f"m{k}", F.lit(0)).alias(f"m{k}") for k in range(hop)]
        state = stored(state.join(step, ["case_id", "id"], "full").select("case_id", "id", *older, F.coalesce(last, F.lit(0)).bitwiseOR(F.coalesce("_new", F.lit(0))).alias(f"m{hop}")))
    return state


def two_hops(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """``case_id, id, hop`` of what lies at most ``hops`` undirected steps from a case's seeds; ``edges`` has ``case_id, u, v``."""
    reached = seed_reach(edges, seeds.select("case_id", "id").withColumn("mask", F.lit(1)), hops)
    return reached.select("case_id", "id", F.coalesce(*(F.when(F.col(f"m{h}") != 0, h) for h in range(hops + 1))).alias("hop"))


#: Which sockets a graph is kept around: those that match the alert in address and port, in address, in port, or in either.
SEED_RULES = {"joint": 1, "address": 2, "port": 4, "either": 8}


def seed_pruning(entities: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """For each case and rule its seeds, the nodes that stay within ``hops`` of them, and whether a true process stays.

    ``entities`` is ``case_id, id, kind, pid, label, address_match, port_match``. A case without a seed keeps all of its nodes.
    ``truth`` and ``kept`` are 1 or 0: the case has a labelled process, and a node with the pid of one stays.
    """
    a, p = F.col("address_match") == 1, F.col("port_match") == 1
    rule = {"joint": a & p, "address": a, "port": p, "either": a | p}
    bits = [F.when(rule[r], b).otherwise(0) for r, b in SEED_RULES.items()]
    seeds = entities.where("kind = 'socket'").select("case_id", "id", (bits[0] + bits[1] + bits[2] + bits[3]).alias("mask")).where("mask <> 0")
    named = entities.where("kind = 'process' and label = 1 and pid <> ''").select("case_id", "pid").distinct().withColumn("true_pid", F.lit(1))
    nodes = entities.join(named, ["case_id", "pid"], "left").join(seed_reach(edges, seeds, hops), ["case_id", "id"], "left").na.fill(0, ["true_pid", "m0", f"m{hops}"])
    long = nodes.withColumn("_r", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(b).alias("bit")) for r, b in SEED_RULES.items()))))
    on = lambda m: F.col(m).bitwiseAND(F.col("_r.bit")) != 0
    out = long.groupBy("case_id", F.col("_r.rule").alias("rule")).agg(F.count_if(on("m0")).alias("seeds"), F.count("*").alias("nodes"), F.count_if(on(f"m{hops}")).alias("near"), F.max("true_pid").alias("truth"), F.max(F.when(on(f"m{hops}"), F.col("true_pid")).otherwise(0)).alias("near_truth"))
    all_stay = F.col("seeds") == 0
    return out.select("case_id", "rule", "seeds", "nodes", F.when(all_stay, F.col("nodes")).otherwise(F.col("near")).alias("retained"), "truth", F.when(all_stay, F.col("truth")).otherwise(F.col("near_truth")).alias("kept"))


def overlap_pairs(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Jaccard of the members of all case pairs of a group that share some; ``members`` has group_id, case_id, id."""
    a = members.select("group_id", "id", F.col("case_id").alias("case_a"))
    b = members.select("group_id", "id", F.col("case_id").alias("case_b"))
    shared = a.join(b, ["group_id", "id"]).where("case_a < case_b").groupBy("group_id", "case_a", "case_b").agg(F.count("*").alias("shared"))
    sa, sb = (sizes.select(F.col("case_id").alias(f"case_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    return shared.join(sa, "case_a").join(sb, "case_b").withColumn("jaccard", F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared")))


def hashed_donor(cases: DataFrame, block: str, id: str, key: str, salt: str) -> DataFrame:
    """For each case one other case of its block and of another ``key``: the (hash mod n)-th by id.

    Donors are numbered within (block, key); the n-th case of another key is found from the counts
    of the keys, so no pairs are formed. Cases without such a donor keep a null.
    """
    inside = Window.partitionBy(block, key).orderBy(id)
    numbered = cases.select(block, id, key, (F.row_number().over(inside) - 1).alias("_i"))
    sizes = cases.groupBy(block, key).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(block).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy(block))})
    n = F.col("_all") - F.col("_n")
    wanted = numbered.join(sizes, [block, key]).where(n > 0)
    big = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(salt), F.col(id).cast("string")), 256), 1, 15), 16, 10).cast("bigint")
    place = F.pmod(big, n)
    wanted = wanted.withColumn("_place", F.when(place < F.col("_before"), place).otherwise(place + F.col("_n"))).select(block, F.col(id).alias("_for"), "_place")
    placed = numbered.join(sizes, [block, key]).select(block, F.col(id).alias("donor_id"), (F.col("_before") + F.col("_i")).alias("_place"))
    found = wanted.join(placed, [block, "_place"]).select(F.col("_for").alias(id), "donor_id")
    return cases.select(id).join(found, id, "left")


def banded_donors(cases: DataFrame, donors: DataFrame) -> DataFrame:
    """``case_id, band, donor_id``: for each case one donor of every band, the (hash of case and band mod n)-th by id; ``donors`` is ``donor_id, band``."""
    placed = stored(numbered(donors.select("donor_id", "band"), ["band"], [F.asc("donor_id")], "_place"))
    sizes = placed.groupBy("band").agg(F.count("*").alias("_n"))  # one row a band
    big = F.conv(F.substring(F.sha2(F.concat_ws("|", "case_id", "band"), 256), 1, 15), 16, 10).cast("bigint")
    wanted = cases.join(F.broadcast(sizes), F.lit(True)).withColumn("_place", F.pmod(big, F.col("_n")) + 1)
    return wanted.join(placed, ["band", "_place"]).select("case_id", "band", "donor_id")


#: Distinct vectors of a tile, and pivots at most; pivots (8 bytes a number) go to every task.
TILE, PIVOTS = 1024, 4096


def nearest_donors(rows: DataFrame, block: str, id: str, vector: str, label: str, tile: int = TILE) -> DataFrame:
    """For each case the closest other case of the same class and of another class, Euclidean, within its block; ties by id.

    Equal vectors of a class are one (they answer each other). Distinct ones are tiled by their nearest pivot. A first pass inside a vector's own
    tile gives it a radius for each class; by the triangle inequality another tile can hold something closer
    only if its pivot is nearer than that radius and the tile's own radius together, and only such pairs of a vector and a
    group of tiles are compared. Rows without a vector take no part. What cannot be ruled out is compared in full, so the result is exact on any data;
    how much is ruled out depends on how clustered the vectors are (``tile_share``).
    """
    rows, tiled, radius = _tiled(rows, block, id, vector, label, tile)
    near = _own_tile(tiled)
    grouped, wanted = _wanted_groups(tiled, near, radius, tile)
    return _nearest(rows, grouped, near, wanted, id)


def tile_share(rows: DataFrame, block: str, id: str, vector: str, label: str, tile: int = TILE) -> float:
    """The share of all (vector, tile) pairs of a block that can't be ruled out, own tiles included."""
    _, tiled, radius = _tiled(rows, block, id, vector, label, tile)
    tiles = tiled.groupBy("_block").agg(F.countDistinct("_t", "_c").alias("t"), F.count("*").alias("n")).agg(F.sum(F.col("t") * F.col("n"))).first()[0]
    return (_wanted_tiles(tiled, _own_tile(tiled), radius).count() + tiled.count()) / tiles if tiles else 0.0


def _bounds(vectors, at):
    """Bounds on the distances of vectors to pivots, lower and upper, for some vectors at a time."""
    import numpy as np

    for low in range(0, len(vectors), ROWS):
        x = np.stack(vectors[low : low + ROWS]).astype(float)
        both = (x * x).sum(1)[:, None] + (at * at).sum(1)
        d2, slack = both - 2 * (x @ at.T), 1e-12 * (1 + x.shape[1]) * both
        yield np.sqrt(np.maximum(d2 - slack, 0)), np.sqrt(np.maximum(d2, 0) + slack)


def _tiled(rows: DataFrame, block: str, id: str, vector: str, label: str, tile: int) -> tuple[DataFrame, DataFrame, tuple]:
    """Rows; distinct vectors of a block and class with their smallest id, their tile and its part; and all pivots with their tiles' radii."""
    import numpy as np

    rows = rows.where(F.col(vector).isNotNull()).select(F.col(block).alias("_block"), F.col(id).alias("_id"), F.transform(F.col(vector).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("_v"), F.col(label).cast("string").alias("l"))  # no -0.0, which would be another text
    rows = stored(rows.withColumn("_key", F.md5(F.to_json(F.struct("_block", "_v")))))
    distinct = stored(rows.groupBy("_block", "_key", "l").agg(F.min("_id").cast("bigint").alias("donor"), F.first("_v").alias("_v")))
    keys = distinct.select("_key").distinct().orderBy(F.xxhash64("_key"), "_key").limit(min(PIVOTS, -(-distinct.count() // tile)))
    at = np.array([v for _, v in sorted({r._key: r._v for r in distinct.select("_key", "_v").join(F.broadcast(keys), "_key").collect()}.items())], float)

    def assign(batches):
        for b in batches:
            if len(b):
                high = [h for _, h in _bounds(b["_v"].to_numpy(), at)]
                yield b.assign(_t=np.concatenate([h.argmin(1) for h in high]).astype("int32"), _d=np.concatenate([h.min(1) for h in high]))

    placed = stored(distinct.mapInPandas(assign, StructType([*distinct.schema, StructField("_t", IntegerType()), StructField("_d", DoubleType())])))
    sizes = placed.groupBy("_block", "_t").agg(F.ceil(F.count("*") / tile).alias("_k"))
    tiled = stored(placed.join(sizes, ["_block", "_t"]).withColumn("_c", F.pmod(F.xxhash64("_key", "l"), F.col("_k")).cast("int")))
    # One row a pivot: a tile's radius over all blocks.
    radius = {r["_t"]: r["r"] for r in placed.groupBy("_t").agg(F.max("_d").alias("r")).collect()}
    return rows, tiled, (at, np.array([radius.get(t, 0.0) for t in range(len(at))]))


_BEST = "_block {b}, _key string, l string, same boolean, distance double, donor bigint"


#: Vectors whose products are held at a time, of either side.
ROWS = 512
#: Tiles' worth of vectors in a group at least; a block has about so many groups until one holds so many numbers. A task holds two groups.
GROUP, GROUPS, NUMBERS = 16, 8, 1 << 22


def _compare(a, b):
    """For each vector and class of ``a`` the nearest vector of ``b`` that is not itself, of the same and of another class; only those within ``_u``, if ``a`` has that.

    Vectors are scaled into the unit ball and compared by matrix products of single precision, of which only the greatest of a row of a block
    is kept. Rows are worked out again in the blocks that may hold their best, by double precision where single leaves many open. The errors of products are
    below ``slack``, so what is within it of the best is worked out number by number; only these decide.
    Both sides are in the order of their classes, so nearly all blocks are of one kind.
    """
    import numpy as np
    import pandas as pd

    if not len(a) or not len(b):
        return pd.DataFrame(columns=["_block", "_key", "l", "same", "distance", "donor"])
    number: dict = {}
    codes = [np.array([number.setdefault(l, len(number)) for l in s["l"]]) for s in (a, b)]
    orders = [np.argsort(c, kind="stable") for c in codes]
    (a, b), (ca, cb) = (s.iloc[o] for s, o in zip((a, b), orders)), (c[o] for c, o in zip(codes, orders))
    x, y = (np.stack(s["_v"].to_numpy()).astype(float) for s in (a, b))
    ids, centre = b["donor"].to_numpy(), y.mean(0)
    u, w = x - centre, y - centre
    scale = np.sqrt(max((u * u).sum(1).max(), (w * w).sum(1).max())) or 1.0
    if not np.isfinite(scale):
        raise ValueError("a vector has a number that is not finite")
    u, w = u / scale, w / scale
    xx = (u * u).sum(1)
    # A product with half the other's square taken off: the greater, the nearer.
    u, w = np.column_stack([u, np.ones(len(u))]), np.column_stack([w, (w * w).sum(1) / -2])
    u32, w32 = u.astype(np.float32), w.astype(np.float32)
    slack = {np.dtype(t): 4 * (8 + x.shape[1]) * float(np.finfo(t).eps) for t in (np.float32, np.float64)}
    best, donor = np.full((2, len(x)), np.inf), np.full((2, len(x)), -1)
    # Distances are rounded to nine digits, so those within one unit of the ninth tie. No product is below -1.5.
    limit = lambda rows, d: np.maximum((xx[rows] - ((d + 2e-9) / scale) ** 2) / 2, -2)
    reach = lambda rows, most, e: limit(rows, scale * np.sqrt(np.maximum(xx[rows] - 2 * (most - e), 0)))
    least = np.repeat(limit(slice(None), a["_u"].to_numpy(float) if "_u" in a else np.full(len(x), np.inf))[None], 2, 0)
    place = {i: k for k, i in enumerate(ids)}
    itself = np.array([place.get(i, -1) for i in a["donor"]])
    blocks = [(z, min(z + ROWS, len(y))) for z in range(0, len(y), ROWS)]
    room, none = np.empty(ROWS * ROWS, np.float32), np.float32(-np.inf)

    def exactly(i, k):
        step = max(1, NUMBERS // y.shape[1])
        return np.concatenate([np.round(np.sqrt(((y[k[z : z + step]] - x[i[z : z + step]]) ** 2).sum(1)), 9) for z in range(0, len(i), step)])

    def look(rows, left, right, same):
        out = (ca[rows, None] == cb[left:right]) != bool(same)
        own = np.flatnonzero((itself[rows] >= left) & (itself[rows] < right))
        out[own, itself[rows[own]] - left] = True
        for u_, w_ in ((u32, w32), (u, w)):
            s = u_[rows] @ w_[left:right].T
            s[out] = -np.inf
            e = slack[s.dtype]
            at_least = np.maximum(least[same, rows], reach(rows, s.max(1).astype(float), e)) - e
            i, k = np.divmod(np.flatnonzero(s >= at_least.astype(s.dtype)[:, None]), right - left)
            if len(i) <= 16 * len(rows):
                break
        if not len(i):
            return
        d, named = exactly(rows[i], left + k), ids[left + k]
        order = np.lexsort((named, d, i))
        order = order[np.r_[True, np.diff(i[order]) > 0]]
        row, d, named = rows[i[order]], d[order], named[order]
        now = (d < best[same, row]) | ((d == best[same, row]) & (named < donor[same, row]))
        row, d = row[now], d[now]
        best[same, row], donor[same, row] = d, named[now]
        least[same, row] = np.maximum(least[same, row], limit(row, d))

    for top in range(0, len(x), 4 * ROWS):
        some = slice(top, min(top + 4 * ROWS, len(x)))
        most = np.full((2, some.stop - top, len(blocks)), none)
        for low in range(top, some.stop, ROWS):
            high = min(low + ROWS, some.stop)
            first, last = np.searchsorted(cb, ca[low]), np.searchsorted(cb, ca[high - 1], "right")  # what is outside is of another class than all rows
            for n, (left, right) in enumerate(blocks):
                s = np.matmul(u32[low:high], w32[left:right].T, out=room[: (high - low) * (right - left)].reshape(high - low, right - left))
                own = np.flatnonzero((itself[low:high] >= left) & (itself[low:high] < right))
                s[own, itself[low + own] - left] = none
                p, q = (min(max(z, left), right) - left for z in (first, last))
                other, alike = most[0, low - top : high - top, n], most[1, low - top : high - top, n]
                for part in (s[:, :p], s[:, q:]):
                    if part.shape[1]:
                        np.maximum(other, part.max(1), out=other)
                if p < q and ca[low] == ca[high - 1]:
                    alike[:] = s[:, p:q].max(1)
                elif p < q:
                    equal = ca[low:high, None] == cb[left + p : left + q]
                    alike[:] = np.where(equal, s[:, p:q], none).max(1)
                    np.maximum(other, np.where(equal, none, s[:, p:q]).max(1), out=other)
        for same in (0, 1):
            e = slack[most.dtype]
            least[same, some] = np.maximum(least[same, some], reach(some, most[same].max(1).astype(float), e))
            wanted = most[same] >= (least[same, some] - e).astype(np.float32)[:, None]
            for n in np.flatnonzero(wanted.any(0)):
                look(top + np.flatnonzero(wanted[:, n]), *blocks[n], same)
    out = []
    for same in (1, 0):
        found = np.flatnonzero(np.isfinite(best[same]))
        out.append(a[["_block", "_key", "l"]].iloc[found].assign(same=bool(same), distance=best[same, found], donor=donor[same, found]))
    return pd.concat(out)


def _own_tile(tiled: DataFrame) -> DataFrame:
    """The nearest that a vector's own part of its tile holds."""
    kind = _BEST.format(b=tiled.schema["_block"].dataType.simpleString())
    return stored(tiled.select("_block", "_key", "_v", "l", "donor", "_t", "_c").groupBy("_block", "_t", "_c").applyInPandas(lambda g: _compare(g, g), kind))


def _asked(tiled: DataFrame, near: DataFrame, radius: tuple) -> DataFrame:
    """Vectors with ``_u``, how far away something closer may still be, and ``_open``, a bit for each tile that may hold it (words of 32)."""
    import numpy as np

    # A class that the own tile lacks has no radius yet: all tiles are open.
    per = near.groupBy("_block", "_key", "l").agg(F.count("*").alias("n"), F.max("distance").alias("u"))
    reach = F.when(F.col("n") == 2, F.col("u") + 1e-8).otherwise(F.lit(float("inf")))
    asked = tiled.join(per, ["_block", "_key", "l"], "left").withColumn("_u", F.coalesce(reach, F.lit(float("inf")))).drop("n", "u")
    at, radii = radius

    def opened(batches):
        for b in batches:
            if len(b):
                u, words = b["_u"].to_numpy(), []
                for k, (low, _) in enumerate(_bounds(b["_v"].to_numpy(), at)):
                    bits = np.packbits(low - radii <= u[k * ROWS : (k + 1) * ROWS, None], axis=1, bitorder="little")
                    words += list(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 4))).view("<u4").astype("int64"))
                yield b.assign(_open=words)

    return stored(asked.mapInPandas(opened, StructType([*asked.schema, StructField("_open", ArrayType(LongType()))])))


def _is_open(tile: Column) -> Column:
    return F.getbit(F.element_at("_open", F.floor(tile / 32).cast("int") + 1), tile % 32) == 1


def _wanted_tiles(tiled: DataFrame, near: DataFrame, radius: tuple) -> DataFrame:
    """Vectors with each other tile part that may hold something as near as what they have."""
    open_ = F.filter(F.sequence(F.lit(0), F.lit(max(len(radius[1]) - 1, 0))), _is_open)
    long = _asked(tiled, near, radius).select("_block", "_key", F.col("_t").alias("t0"), F.col("_c").alias("c0"), F.explode(open_).alias("_t"))
    parts = tiled.select("_block", "_t", "_c").distinct()
    return long.join(parts, ["_block", "_t"]).where("_t <> t0 or _c <> c0")


def _wanted_groups(tiled: DataFrame, near: DataFrame, radius: tuple, tile: int) -> tuple[DataFrame, DataFrame]:
    """``tiled`` with ``_g``, the group of a tile part; and its vectors, of group ``g0``, with each group ``_g`` that may hold something as near as what they have."""
    upto = Window.partitionBy("_block").orderBy("_t", "_c").rowsBetween(Window.unboundedPreceding, 0)  # one row a tile part
    sizes = tiled.groupBy("_block", "_t", "_c").agg(F.count("*").alias("_n"))
    most = max(GROUP * tile, NUMBERS // max(radius[0].shape[-1], 1))
    each = F.least(F.lit(most), F.greatest(F.lit(GROUP * tile), F.ceil(F.sum("_n").over(Window.partitionBy("_block")) / GROUPS)))
    parts = stored(sizes.withColumn("_g", F.floor((F.sum("_n").over(upto) - F.col("_n")) / each).cast("int")).drop("_n"))
    # A group that is one part needs no second look by its own vectors.
    groups = parts.groupBy("_block", "_g").agg(F.collect_set("_t").alias("_tiles"), F.count("*").alias("_parts"))
    grouped = _asked(tiled, near, radius).join(F.broadcast(parts), ["_block", "_t", "_c"])
    wanted = grouped.withColumnRenamed("_g", "g0").join(F.broadcast(groups), "_block").where("_parts > 1 or _g <> g0").where(F.exists("_tiles", _is_open))
    return grouped, wanted.select("_block", "_key", "_v", "l", "donor", "_u", "g0", "_g")


def _nearest(rows: DataFrame, tiled: DataFrame, near: DataFrame, wanted: DataFrame, id: str) -> DataFrame:
    """Each row's nearest of both kinds, from its own tile, from the groups that were wanted and from rows with the same vector."""
    kind = _BEST.format(b=tiled.schema["_block"].dataType.simpleString())
    keys = ["_block", "g0", "_g"]
    # Both sides of a comparison are one group each, so no task holds more than two of them. Comparisons take long for their bytes, so they are dealt out by number.
    pairs = stored(wanted.select(keys).distinct())
    parts = min(4 * pairs.count(), 2000) or 1
    members = F.broadcast(pairs).join(tiled.select("_block", "_g", "_v", "l", "donor"), ["_block", "_g"])
    members = members.select(*(F.col(k).alias(f"m{k}") for k in keys), *(F.col(c).alias(c) for c in ("_v", "l", "donor"))).repartition(parts, *(f"m{k}" for k in keys))
    far = wanted.repartition(parts, *keys).groupBy(*keys).cogroup(members.groupBy(*(f"m{k}" for k in keys))).applyInPandas(lambda a, b: _compare(a, b), kind)
    found = near.unionByName(far).groupBy("_block", "_key", "l", "same").agg(F.min(F.struct("distance", "donor")).alias("m"))
    keyed = rows.select("_block", "_key", "l", "_id")
    others = keyed.join(found, ["_block", "_key", "l"]).select("_id", "same", "m.distance", "m.donor")
    # Rows with the same vector are at distance 0: of the same class the smallest other id, of others the smallest.
    # Two smallest ids of a class are enough for every row of it.
    smallest = keyed.groupBy("_block", "_key", "l").agg(F.min("_id").alias("i1"))
    second = keyed.join(smallest, ["_block", "_key", "l"]).where("_id <> i1").groupBy("_block", "_key", "l").agg(F.min("_id").alias("i2"))
    heads = smallest.join(second, ["_block", "_key", "l"], "left")
    own = keyed.join(heads, ["_block", "_key", "l"]).select("_id", F.lit(True).alias("same"), F.lit(0.0).alias("distance"), F.when(F.col("_id") == F.col("i1"), F.col("i2")).otherwise(F.col("i1")).alias("donor")).where("donor is not null")
    pair = smallest.groupBy("_block", "_key").agg(F.sort_array(F.collect_list(F.struct("i1", "l"))).alias("by_id")).where(F.size("by_id") > 1)
    cross = keyed.join(pair, ["_block", "_key"]).select("_id", F.lit(False).alias("same"), F.lit(0.0).alias("distance"), F.when(F.element_at("by_id", 1)["l"] == F.col("l"), F.element_at("by_id", 2)["i1"]).otherwise(F.element_at("by_id", 1)["i1"]).alias("donor"))
    best = others.unionByName(own).unionByName(cross).groupBy("_id", "same").agg(F.min(F.struct("distance", "donor")).alias("m"))
    return best.select(F.col("_id").alias(id), "same", F.col("m.donor").alias("donor_id"), "m.distance")


def key_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of either side that the other lacks, and keys that a side has more than once."""
    only = [x.join(y, key, "left_anti").select(F.lit(f"only_{n}").alias("problem"), F.col(key).alias("key")) for n, x, y in (("left", a, b), ("right", b, a))]
    twice = [x.groupBy(key).count().where("count > 1").select(F.lit(f"repeated_{n}").alias("problem"), F.col(key).alias("key")) for n, x in (("left", a), ("right", b))]
    return only[0].union(only[1]).union(twice[0]).union(twice[1])


def inject_graph(original: DataFrame, donor: DataFrame, prefix: str) -> DataFrame:
    """Edges of ``original`` and of ``donor``; the donor's ids get a prefix, so they cannot collide."""
    renamed = donor.withColumns({c: F.concat(F.lit(prefix), F.col(c)) for c in ("src", "dst")})
    return original.withColumn("part", F.lit("original")).unionByName(renamed.withColumn("part", F.lit("injected")))



def disjoint_centres(rows: DataFrame, key: str, ts: str, wanted: int, radius: float, least: int, most: int) -> DataFrame:
    """Quantile-spaced times whose windows of ``radius`` hold ``least`` to ``most`` rows and do not overlap.

    Picks are the first rows of ``4 * wanted`` equal parts of each key, found by ranges; their windows are counted
    by a range join, and the sequential choice runs on the few picks that are left.
    """
    import pandas as pd

    picks = tiles(rows.select(key, ts), [key], [F.asc(ts)], 4 * wanted, "_p").groupBy(key, "_p").agg(F.min(ts).alias("centre")).select(F.col(key).alias("_k"), "centre")
    sized = within(picks.withColumnRenamed("_k", key), rows.select(key, ts), "centre", ts, radius, [key]).groupBy(key, "centre").agg(F.count("*").alias("n")).where(F.col("n").between(least, most))

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        kept, last = [], None
        for r in group.sort_values("centre").itertuples():
            if len(kept) < wanted and (last is None or r.centre - last >= 2 * radius):
                kept.append(r.Index)
                last = r.centre
        return group.loc[kept]

    return sized.groupBy(key).applyInPandas(choose, sized.schema)
