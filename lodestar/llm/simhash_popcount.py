"""Near-duplicates by SimHash, joined in the space of segment bit counts.

A fingerprint's 64 bits are cut into 32 segments of two; a segment's number of set bits is a coordinate. Changing one
bit changes one coordinate by one, so the Manhattan distance of two such points is a lower bound of the fingerprints'
Hamming distance. The join is a range join on a grid of unit cells over each half of the coordinates: of two points
within ``radius`` = 4, one half is within 2, and there some cell is within 1 of both. So each point is dealt, in each half,
to its own cell and to the neighbours one step away (50 cells on average, 66 at most), whatever the number of points;
the points that meet in a cell are held against the bound and then compared exactly.

A crowded cell is cut further along the other half. Two points within ``radius`` are within it there too, so one of that
half's two quarters has them within 2, and again some cell of that quarter is within 1 of both. Only inner cells that
are still crowded are dealt out as pairs of slices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import cut, drop_cut, each_part, map_rows, part_of, parts_seen
from lodestar.llm.components import Forest, components

RADIUS = 4
EVEN = 0x5555555555555555
#: Points of a cell that one task holds; larger cells are cut along the other half, then dealt out as pairs of slices.
CELL_LIMIT = 16_384
BLOCK = 1 << 16


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of the text's word shingles, repeats included; without words 0."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and exactly the six ASCII white-space characters
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > len(starts)).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` of each row, ``fp`` as a signed long."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            found = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], np.uint64)
            return {"doc_id": batch.column(0), "fp": pa.array(found.view(np.int64))}

        return step

    return map_rows(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), "doc_id long, fp long", make)


def _near(points: np.ndarray, others: np.ndarray, one: tuple[np.uint64, np.uint64], radius: int) -> np.ndarray:
    """Which of ``points`` (and their thermometer codes ``others``) link to ``one``: first the bound, then exactly."""
    within = np.flatnonzero(np.bitwise_count(others ^ one[1]) <= radius)
    return within[np.bitwise_count(points[within] ^ one[0]) <= radius]


def thermometer(points: np.ndarray) -> np.ndarray:
    """A code whose Hamming distance is the Manhattan distance of the segment bit counts (0, 1, 2 as 00, 01, 11)."""
    even = np.uint64(EVEN)
    high = points >> np.uint64(1)
    return ((points | high) & even) | ((points & high & even) << np.uint64(1))


def spanning_links(cells: np.ndarray, points: np.ndarray, radius: int = RADIUS, small: int = 32) -> list[tuple[int, int]]:
    """Links within each run of equal ``cells`` that connect what all its links connect: at most a tree for each run.

    Small runs are compared by offset, all runs at once. In larger ones a search from point to point compares only
    with points not yet reached, so a run full of copies costs about its length.
    """
    codes = thermometer(points)
    change = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1], True])
    sizes = np.diff(change)
    links: list[tuple[int, int]] = []
    run = np.repeat(np.arange(len(sizes)), sizes)
    forest = Forest()
    little = np.flatnonzero(sizes[run] <= small)
    if len(little):
        p, c, r = points[little], codes[little], run[little]
        for step in range(1, int(sizes[sizes <= small].max(initial=1))):
            same = np.flatnonzero(r[step:] == r[:-step])
            if not len(same):
                break
            same = same[np.bitwise_count(c[same] ^ c[same + step]) <= radius]
            same = same[np.bitwise_count(p[same] ^ p[same + step]) <= radius]
            for i in same.tolist():
                if forest.join(i, i + step):
                    links.append((int(p[i]), int(p[i + step])))
    for k in np.flatnonzero(sizes > small):
        part = np.unique(points[change[k] : change[k + 1]])
        other = thermometer(part)
        left = np.arange(len(part))
        while len(left):
            todo, left = [int(left[0])], left[1:]
            while todo and len(left):
                x = todo.pop()
                hit = _near(part[left], other[left], (part[x], other[x]), radius)
                if len(hit):
                    found = left[hit]
                    links += [(int(part[x]), int(y)) for y in part[found]]
                    todo += found.tolist()
                    left = np.delete(left, hit)
    return links


def _link_cells(batches):
    """Over a partition sorted by cell: the spanning links of each cell, holding one batch and one cell at a time."""
    rest_c, rest_p = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def emit(links):
        pairs = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    for batch in batches:
        cells = np.r_[rest_c, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)]
        points = np.r_[rest_p, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
        if not len(cells):
            continue
        cut_at = int(np.flatnonzero(cells == cells[-1])[0]) if cells[0] != cells[-1] else 0
        rest_c, rest_p = cells[cut_at:], points[cut_at:]
        if cut_at and (links := spanning_links(cells[:cut_at], points[:cut_at])):
            yield emit(links)
    if len(rest_c) and (links := spanning_links(rest_c, rest_p)):
        yield emit(links)


def _segment_counts(fp: Column) -> Column:
    """Every segment's number of set bits, 0 to 2, in the segment's own two bits."""
    even = F.lit(EVEN).cast("long")
    high = F.shiftrightunsigned(fp, 1)
    one, two = fp.bitwiseXOR(high).bitwiseAND(even), fp.bitwiseAND(high).bitwiseAND(even)
    return one.bitwiseOR(F.shiftleft(two, 1))


def _around(counts: Column, first: int, size: int, name: int) -> list[Column]:
    """The cells of ``size`` segments from ``first`` on: a point's own, and those one step from it along one segment."""
    own = F.shiftrightunsigned(counts, 2 * first).bitwiseAND(F.lit((1 << 2 * size) - 1)) + F.lit(name << 32)
    cells = [own]
    for j in range(size):
        count, step = F.shiftrightunsigned(counts, 2 * (first + j)).bitwiseAND(F.lit(3)), F.lit(1 << 2 * j).cast("long")
        cells += [F.when(count > 0, own - step), F.when(count < 2, own + step)]
    return cells


def grid_cells(fp: Column) -> Column:
    """The cells of both halves that a fingerprint is dealt to; bit 32 names the half."""
    counts = _segment_counts(fp)
    return F.array_compact(F.array(*_around(counts, 0, 16, 0), *_around(counts, 16, 16, 1)))


def inner_cells(fp: Column, cell: Column) -> Column:
    """The cells of both quarters of the half that ``cell`` does not lie in, each within ``cell``."""
    counts = _segment_counts(fp)
    halves = [F.array_compact(F.array(*_around(counts, at, 8, 2), *_around(counts, at + 8, 8, 3))) for at in (0, 16)]
    other = F.when(F.shiftrightunsigned(cell, 32) == 0, halves[1]).otherwise(halves[0])
    return F.transform(other, lambda inner: F.xxhash64(cell, inner))


def _crowded(dealt: DataFrame, count: int, cell_limit: int) -> DataFrame:
    """``(cell, n)`` of the cells with more than ``cell_limit`` points, none of others, as a written table.

    Cells are counted in buckets first, so that only those in crowded buckets are counted one by one. The crowded
    buckets are written before the second count is planned: where there are none, or few, no dealt row is shuffled for it.
    """
    bucket = F.pmod(F.xxhash64("cell"), F.lit(max(1 << 16, 64 * count // 1024)))
    crowded = cut(dealt.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("n")).where(F.col("n") > cell_limit).select("_bucket"), "crowded-buckets")
    if crowded.isEmpty():
        drop_cut(crowded)
        return dealt.sparkSession.range(0).select(F.col("id").alias("cell"), F.col("id").alias("n"))
    counted = dealt.withColumn("_bucket", bucket).join(crowded, "_bucket", "left_semi").groupBy("cell").agg(F.count("*").alias("n"))
    large = cut(counted.where(F.col("n") > cell_limit), "crowded-cells")
    drop_cut(crowded)
    return large


def links_of(points: DataFrame, count: int, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """``points(fp)`` without repeats → links ``(u, v)`` that connect all that lie within ``RADIUS``.

    Points of cells with more than ``cell_limit`` go to the cells' inner cells instead, and those of inner cells that
    have more than so many, too, to pairs of slices; nothing is left out. Two inner cells whose hashes are alike are
    one cell, which costs comparisons and no links.
    """
    dealt = points.select("fp", F.explode(grid_cells(F.col("fp"))).alias("cell"))
    large = _crowded(dealt, count, cell_limit)
    if large.isEmpty():
        parts = dealt
    else:
        marked = dealt.join(large, "cell", "left")
        inside = dealt.join(large.select("cell"), "cell", "left_semi").select("fp", F.explode(inner_cells(F.col("fp"), F.col("cell"))).alias("cell"))
        slices = F.ceil(F.col("n") / cell_limit).cast("int")
        mine = F.pmod(F.xxhash64("fp"), slices)
        # Slices of a crowded inner cell meet two by two, under the name of the pair.
        pairs = F.transform(F.sequence(F.lit(0), slices - 1), lambda j: F.xxhash64("cell", F.least(j, mine), F.greatest(j, mine)))
        inside = inside.join(_crowded(inside, count, cell_limit), "cell", "left")
        inside = inside.select("fp", F.explode(F.when(F.col("n").isNull(), F.array("cell")).otherwise(pairs)).alias("cell"))
        parts = marked.where("n IS NULL").select("fp", "cell").unionByName(inside)
    return parts.select("cell", "fp").repartition("cell").sortWithinPartitions("cell").mapInArrow(_link_cells, "u long, v long")


def near_duplicates(docs: DataFrame, cell_limit: int = CELL_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, fingerprint, component_id)`` of each row of ``docs``.

    Rows are linked when their fingerprints differ in at most ``RADIUS`` bits; ``component_id`` is the smallest id
    reachable over links. Equal fingerprints are one point, so copies cost nothing but their rows. Null and empty texts
    have the fingerprint zero and are linked like any other. Null ids never name a component that has another id;
    repeated rows keep their number; an empty table gives an empty result; other columns are not read.
    """
    marked = cut(fingerprints(docs, id_col, text_col), "fingerprints")
    # A point's rows, and a component's points, are joined part by part: one of them may hold a third of all.
    marked = marked.withColumn("_part", part_of("doc_id"))
    classes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), parts_seen("_part").alias("_parts")), "points")
    joined = components(links_of(classes.select("fp"), classes.count(), cell_limit))
    named = classes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")).withColumn("_part", part_of("fp"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"), parts_seen("_part").alias("_seen"))
    least = least.select("component", "component_id", each_part("_seen").alias("_part"))
    named = cut(named.join(least, ["component", "_part"]).select("fp", "component_id", "_parts"), "named-points")
    drop_cut(classes)
    named = named.select("fp", "component_id", each_part("_parts").alias("_part"))
    return marked.join(named, ["fp", "_part"]).select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that keep one document of each component: the one with the smallest id.

    Of repeated rows one stays. Rows without an id stay where no row of their component has one.
    """
    kept = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    kept = kept.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, docs[id_col].cast("long").eqNullSafe(kept["_kept_id"]), "left_semi").dropDuplicates([id_col, text_col])
