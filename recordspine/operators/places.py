"""Points in boundaries by a quadtree cover of each boundary.

A cell that more than a few edges touch is cut twice in each direction (two levels of a quadtree at once), so cells are small along the edges and large elsewhere. A cell that no
edge touches lies wholly inside (and needs no test) or wholly outside (and is dropped); all others carry only the edges
that touch them. Rows of the cover therefore grow with the edges, not with the area.

Whether a cell's lower right corner is inside is known, from the root (whose corner is outside of everything) down: going from
there to another place of the same cell, first along the right side, then level, each edge on the way turns inside to
outside. A cell's own edges are all that this can meet. The same walk answers for a point, which lies in one cell of a boundary at
most. Places on an edge or corner count as if moved right by a very little and up by far less, which is the half-open rule of
ray casting.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordspine.sources.tables import written

WAYS = 4  # parts of a cell's side
EDGES = 1 << 13  # edges that are cut at once, or one cell's
PLAIN = 4  # edges of a cell that go as plain columns


def _side(e, x, y):
    """Above 0: (x, y) lies left of the edge, which goes upwards."""
    return (e["x2"] - e["x1"]) * (y - e["y1"]) - (x - e["x1"]) * (e["y2"] - e["y1"])


def _turns(e, cx, cy, x, y):
    """An odd number of crossings with the edge on the way (cx, cy) to (cx, y) to (x, y); of columns and of NumPy arrays alike.

    Short, as Java compiles no method of over 8,000 bytes.
    """
    beside = _side(e, cx, y) > 0
    upright = ((e["x1"] > cx) != (e["x2"] > cx)) & ((_side(e, cx, cy) > 0) != beside)
    level = (e["y1"] <= y) & (y < e["y2"]) & ((_side(e, x, y) > 0) != beside)
    return upright != level


def _odd(edges: str, cx: Column, cy: Column, x: Column, y: Column) -> Column:
    return F.size(F.filter(edges, lambda e: _turns(e, cx, cy, x, y))) % 2 == 1


def _touches(e, x0, y0, x1, y1):
    """Arrays: the edge may touch the closed cell: the boxes meet and the corners are not all clearly on one side of its line."""
    boxes = (np.minimum(e["x1"], e["x2"]) <= x1) & (np.maximum(e["x1"], e["x2"]) >= x0) & (e["y1"] <= y1) & (e["y2"] >= y0)
    corners = [_side(e, x, y) for x in (x0, x1) for y in (y0, y1)]
    slack = (np.abs(e["x2"] - e["x1"]) + e["y2"] - e["y1"]) * reduce(np.maximum, map(np.abs, (x0, x1, y0, y1, *e.values()))) * 1e-12
    return boxes & (reduce(np.minimum, corners) <= slack) & (reduce(np.maximum, corners) >= -slack)


def _cut(level: int, box: tuple[float, float, float]):
    """A function of Arrow batches: cells of a level, each to its parts that edges touch or that lie inside."""
    (left, bottom, size), old, new = box, box[2] / WAYS**level, box[2] / WAYS ** (level + 1)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            sizes = np.cumsum(pc.list_value_length(batch["edges"]).to_numpy(zero_copy_only=False))
            while at < len(sizes):  # so many cells at once as have EDGES edges
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + EDGES, "right")))
                yield from some(batch.slice(at, end - at))
                at = end

    def some(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = pc.list_value_length(batch["edges"]).to_numpy(zero_copy_only=False)
        flat, owner = batch["edges"].flatten(), np.repeat(np.arange(len(n)), n)
        e = {c: flat.field(c).to_numpy() for c in ("x1", "y1", "x2", "y2")}
        cx, cy, inside = (batch[c].to_numpy(zero_copy_only=False) for c in ("cx", "cy", "inside"))
        count = lambda which: np.bincount(owner[which], minlength=len(n))
        x, y = (left + old + cx * old)[owner], (bottom + cy * old)[owner]
        for part in range(WAYS**2):
            px, py = cx * WAYS + part % WAYS, cy * WAYS + part // WAYS
            x0, y0, x1, y1 = ((o + c * new)[owner] for o, c in ((left, px), (bottom, py), (left + new, px), (bottom + new, py)))
            within, touching = inside ^ (count(_turns(e, x, y, x1, y0)) % 2 == 1), np.flatnonzero(_touches(e, x0, y0, x1, y1))
            left_over = count(touching)
            keep = np.flatnonzero(within | (left_over > 0))
            offsets = pa.array(np.concatenate([[0], np.cumsum(left_over[keep])]), pa.int32())
            columns = {"boundary_id": batch["boundary_id"].take(pa.array(keep)), "level": pa.array(np.full(len(keep), level + 1), pa.int32()), "cx": pa.array(px[keep]), "cy": pa.array(py[keep]), "inside": pa.array(within[keep])}
            yield pa.RecordBatch.from_pydict(columns | {"edges": pa.ListArray.from_arrays(offsets, flat.take(pa.array(touching)))})

    return parts


def edges_of(boundaries: DataFrame) -> DataFrame:
    """(boundary_id, edges): each ring's edges, directed upwards (level ones to the left), of boundaries with `rings` (array of rings) or one `ring`.

    Rings close themselves. Corners with a null, NaN or infinite number are left out; rings under three corners are empty.
    """
    rings = F.col("rings") if "rings" in boundaries.columns else F.array("ring")
    fine = lambda v: v.isNotNull() & (F.abs(v) < float("inf"))
    clean = F.transform(F.coalesce(rings, F.array()), lambda r: F.filter(F.coalesce(r, F.array()), lambda p: fine(p["x"]) & fine(p["y"])))
    edge = lambda a, b: F.struct(*(v.cast("double").alias(n) for v, n in ((a["x"], "x1"), (a["y"], "y1"), (b["x"], "x2"), (b["y"], "y2"))))
    around = lambda r: F.zip_with(r, F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1)), lambda a, b: F.when((a["y"] < b["y"]) | ((a["y"] == b["y"]) & (a["x"] >= b["x"])), edge(a, b)).otherwise(edge(b, a)))
    edges = F.flatten(F.transform(F.filter(clean, lambda r: F.size(r) > 2), around))
    return boundaries.select("boundary_id", edges.alias("edges")).where(F.size("edges") > 0)


def _box(edges: DataFrame) -> tuple[float, float, float] | None:
    """Left, bottom and size of a square around all edges whose sides are multiples of a power of two; None without edges.

    No edge reaches its right or upper side.
    """
    low = lambda c: F.min(F.array_min(F.transform("edges", lambda e: F.least(e[f"{c}1"], e[f"{c}2"]))))
    high = lambda c: F.max(F.array_max(F.transform("edges", lambda e: F.greatest(e[f"{c}1"], e[f"{c}2"]))))
    half = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1e-9)))))
    row = edges.agg(low("x").alias("x0"), low("y").alias("y0"), high("x").alias("x1"), high("y").alias("y1")).select((F.floor(F.col("x0") / half) * half).alias("x"), (F.floor(F.col("y0") / half) * half).alias("y"), (half * 2).alias("size")).first()
    return None if row["x"] is None else tuple(row)


def cover(boundaries: DataFrame, most: float = 16, depth: int = 12) -> tuple[DataFrame, tuple[float, float, float] | None]:
    """Cells (boundary_id, level, cx, cy, inside, edges) of boundaries, and the square that they divide.

    `inside` tells of a cell's lower right corner. A cell with at most `most` edges, or at `depth`, is not cut; there many
    edges may meet in one corner, and all of them stay in the cell. Each level is written out.
    """
    edges = written(edges_of(boundaries), "cover")
    box = _box(edges)
    whole = edges.select("boundary_id", F.lit(0).alias("level"), F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy"), F.lit(False).alias("inside"), "edges")
    if box is None:
        return whole, None
    done, open_ = whole.where(F.size("edges") <= most), whole.where(F.size("edges") > most)
    for level in range(depth):
        if open_.isEmpty():
            return done, box
        # A boundary's cells are dealt out anew, so that one of very many edges isn't one task's work.
        parts = written(open_.repartition("boundary_id", "cx", "cy").mapInArrow(_cut(level, box), whole.schema), "cover")
        done, open_ = done.unionByName(parts.where(F.size("edges") <= most)), parts.where(F.size("edges") > most)
    return done.unionByName(open_), box


def locate(points: DataFrame, boundaries: DataFrame, most: float = PLAIN) -> DataFrame:
    """(point_id, boundary_id): points (point_id, x, y) inside polygons (boundary_id, and `ring`: array of struct x, y, or `rings`:
    an array of rings, of which those inside others are holes or islands). `most`: edges of a cell that is not cut.

    Points without a finite x and y lie nowhere. A point meets its cell at each level that occurs, by an equi-join. Edges go into
    it as plain columns, since the test is then compiled; those of a cell that has more than PLAIN go as an array.
    """
    cells, box = cover(boundaries, most)
    if box is None:
        return points.crossJoin(cells.select("boundary_id").limit(0)).select("point_id", "boundary_id")
    left, bottom, size = box
    levels = sorted(r["level"] for r in cells.select("level").distinct().collect())
    p = points.where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))).select("point_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    p = p.where((F.col("x") >= left) & (F.col("x") < left + size) & (F.col("y") >= bottom) & (F.col("y") < bottom + size))
    p = p.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumn("_size", F.lit(size) / F.pow(F.lit(float(WAYS)), "level"))
    at = lambda v, o: F.floor((F.col(v) - o) / F.col("_size"))
    p = p.withColumns({"cx": at("x", left), "cy": at("y", bottom)}).withColumns({"_cx": F.lit(left) + (F.col("cx") + 1) * F.col("_size"), "_cy": F.lit(bottom) + F.col("cy") * F.col("_size")}).drop("_size")
    way = F.col("_cx"), F.col("_cy"), F.col("x"), F.col("y")
    meet = lambda c: p.join(c.hint("merge"), ["level", "cx", "cy"])
    plain = cells.where(F.size("edges") <= PLAIN)
    plain = plain.select(*cells.columns[:-1], *(F.coalesce(F.get("edges", F.lit(i))[c], F.lit(0.0)).alias(f"_{c}{i}") for i in range(PLAIN) for c in ("x1", "y1", "x2", "y2")))  # what is missing is a place, which turns nothing
    turned = [_turns({c: F.col(f"_{c}{i}") for c in ("x1", "y1", "x2", "y2")}, *way) for i in range(PLAIN)]
    out = meet(plain).where(reduce(lambda a, b: a != b, turned, F.col("inside"))).select("point_id", "boundary_id")
    many = cells.where(F.size("edges") > PLAIN)
    if not many.isEmpty():
        out = out.unionByName(meet(many).where(F.col("inside") != _odd("edges", *way)).select("point_id", "boundary_id"))
    return out


def boundary_at(boundaries: DataFrame, day) -> DataFrame:
    """The boundary versions in force on a day; null bounds are open, the end is exclusive."""
    return boundaries.where((F.col("effective_from").isNull() | (F.col("effective_from") <= day)) & (F.col("effective_to").isNull() | (F.col("effective_to") > day)))
