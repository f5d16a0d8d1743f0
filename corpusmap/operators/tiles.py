"""Quadtree tiles with level of detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corpusmap.functions.ordering import candidate_share, hash_key, hash_unit
from corpusmap.sources.scratch import materialize, materialize_observed


def _cell(value: str, low: float, high: float, depth: int) -> Column:
    """Cell number along one axis; the upper edge belongs to the last cell."""
    cells = 1 << depth
    width = (high - low) or 1.0
    place = F.floor((F.col(value) - F.lit(low)) / F.lit(width) * F.lit(float(cells)))
    return F.least(place, F.lit(cells - 1)).cast("bigint")


def extent(points: DataFrame) -> tuple[float, float, float, float]:
    """Smallest and largest x and y."""
    row = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    return tuple(row) if row[0] is not None else (0.0, 0.0, 0.0, 0.0)


def quadtree_tiles(
    points: DataFrame, capacity: int = 65536, max_depth: int = 24, seed: int = 42
) -> DataFrame:
    """Tile of each point (id, x, y): id, x, y, z, tile_x, tile_y, priority.

    A tile keeps its ``capacity`` first points in seeded order, the rest descends one depth; at
    ``max_depth`` everything stays. Priorities are uniform, so the first points of a full tile
    lie below a known share: only those are ranked, and a tile that holds a third of all rows is
    never gathered.
    """
    x0, x1, y0, y1 = extent(points)
    rest = points.select("id", "x", "y", hash_key(F.col("id"), seed).alias("priority"))
    done: list[DataFrame] = []
    key = ["tile_x", "tile_y"]
    for depth in range(max_depth + 1):
        placed = rest.withColumns(
            {
                "z": F.lit(depth),
                "tile_x": _cell("x", x0, x1, depth),
                "tile_y": _cell("y", y0, y1, depth),
            }
        )
        if depth == max_depth:
            done.append(placed)
            break
        placed = materialize(placed, "tile-rows")
        sizes, seen = materialize_observed(
            placed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")),
            "tile-sizes",
            full=F.count_if(F.col("n") > capacity),
        )
        if not seen["full"]:
            done.append(placed)
            break
        sized = placed.join(sizes, key)
        over = F.col("n") > capacity
        window = W.partitionBy(*key).orderBy("priority", "id")

        # Should the share hold too few points of a tile, it doubles, for such tiles only.
        share = candidate_share(capacity, F.col("n"))
        place = hash_unit(F.col("priority"))
        grow = F.lit(1.0)
        while True:
            held, short = materialize_observed(
                sized.where(over)
                .groupBy(*key)
                .agg(F.max(grow).alias("grow"), F.count_if(place < share * grow).alias("held")),
                "tile-shares",
                short=F.count_if(F.col("held") < capacity),
            )
            sized = placed.join(sizes, key).join(
                held.select(*key, F.when(F.col("held") < capacity, F.col("grow") * 2).otherwise(F.col("grow")).alias("grow")),
                key,
                "left",
            )
            grow = F.col("grow")
            if not short["short"]:
                break
        candidate = place < share * grow
        ranked = materialize(
            sized.where(over & candidate)
            .withColumn("rank", F.row_number().over(window))
            .select(*placed.columns, "rank"),
            "tile-ranks",
        )
        columns = placed.columns
        done.append(sized.where(~over).select(*columns))
        done.append(ranked.where(F.col("rank") <= capacity).select(*columns))
        rest = (
            sized.where(over & ~candidate)
            .select(*columns)
            .unionByName(ranked.where(F.col("rank") > capacity).select(*columns))
            .select("id", "x", "y", "priority")
        )
    tiled = done[0]
    for part in done[1:]:
        tiled = tiled.unionByName(part)
    return tiled.select("id", "x", "y", "z", "tile_x", "tile_y", "priority")


def tile_key(z: str = "z", x: str = "tile_x", y: str = "tile_y") -> Column:
    """Key of a tile, ``z/x/y``."""
    return F.concat_ws("/", z, x, y)


def tile_manifest(tiles: DataFrame) -> DataFrame:
    """One row per tile: its key, number of points and extent of its points."""
    return tiles.groupBy("z", "tile_x", "tile_y").agg(
        F.count(F.lit(1)).alias("n_points"),
        F.struct(
            F.min("x").alias("x_min"),
            F.max("x").alias("x_max"),
            F.min("y").alias("y_min"),
            F.max("y").alias("y_max"),
        ).alias("extent"),
    ).withColumn("key", tile_key())


def tile_children(manifest: DataFrame) -> DataFrame:
    """Manifest with the keys of the up to four children of each tile, in quadrant order."""
    child = F.struct((F.col("tile_x") % 2 + 2 * (F.col("tile_y") % 2)).alias("quadrant"), "key")
    children = (
        manifest.where("z > 0")
        .groupBy(
            (F.col("z") - 1).alias("z"),
            F.expr("tile_x div 2").alias("tile_x"),
            F.expr("tile_y div 2").alias("tile_y"),
        )
        .agg(F.sort_array(F.collect_list(child)).alias("found"))
    )
    return manifest.join(children, ["z", "tile_x", "tile_y"], "left").select(
        *manifest.columns,
        F.coalesce(
            F.transform("found", lambda c: c["key"]), F.array().cast("array<string>")
        ).alias("children"),
    )


def tile_metadata(tiles: DataFrame, manifest: DataFrame) -> DataFrame:
    """Tile rows with the key, extent and children of their tile."""
    meta = manifest.select("z", "tile_x", "tile_y", "key", "extent", "children")
    return tiles.join(meta, ["z", "tile_x", "tile_y"], "left")


def points_in_view(
    tiles: DataFrame,
    bbox: tuple[float, float, float, float],
    zoom_level: int,
    max_points: int = 1_000_000,
) -> DataFrame:
    """Points of the tiles down to ``zoom_level`` inside (x_min, y_min, x_max, y_max), at most
    ``max_points``, coarse tiles first.

    Depths that fit are taken whole. Only the depth that overflows is cut by priority, and there
    an approximate quantile keeps all but the likely rows out of the sort; a count checks it.
    """
    x_min, y_min, x_max, y_max = bbox
    seen = tiles.where(
        (F.col("z") <= zoom_level)
        & F.col("x").between(x_min, x_max)
        & F.col("y").between(y_min, y_max)
    )
    room = max_points
    # One row per depth.
    for depth, n in sorted(map(tuple, seen.groupBy("z").count().collect())):
        if n > room:
            break
        room -= n
    else:
        return seen
    whole, level = seen.where(F.col("z") < depth), seen.where(F.col("z") == depth)
    place = hash_unit(F.col("priority"))
    share = min(1.0, 1.02 * room / n + 0.001)
    cut = level.agg(F.percentile_approx(place, share, 10_000)).first()[0]
    if level.where(place <= cut).limit(room).count() == room:
        level = level.where(place <= cut)
    return whole.unionByName(level.orderBy("priority", "id").limit(room))
