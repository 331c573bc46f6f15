"""From points to cells: encoding, gap-free segments, densification, grid statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom import config as C
from pathloom.functions import geo
from pathloom.functions import sequences as S


def encode(trips: DataFrame, edge_km: float = C.HEX_EDGE_KM, max_hop_km: float = C.MAX_HOP_KM, fill: bool = False) -> DataFrame:
    """Adds cells_raw, cells (consecutive repeats dropped), sizes, compression, path length and worst hop.

    fill puts points into steps longer than an eighth of a cell, up to max_hop_km, before the grid sees them; n_cells_filled is
    how many cells that adds.  A trip without points has null cells, sizes of 0, and no ratio, length or hop.
    """
    cell = lambda p: geo.hex_cell(p["lon"], p["lat"], edge_km)
    df = trips.withColumn("cells_raw", F.transform("points", cell))
    source = geo.densify(F.col("points"), geo.cell_step_km(edge_km) / 8, max_hop_km) if fill else F.col("points")
    df = df.withColumn("cells", S.compact(F.transform(source, cell) if fill else F.col("cells_raw")))
    df = df.withColumn("_hops", S.hops_km(F.col("cells"))).withColumn("_bare", F.size(S.compact(F.col("cells_raw"))))
    return df.select(
        *trips.columns, "cells_raw", "cells",
        F.coalesce(F.size("cells_raw"), F.lit(0)).alias("n_cells_raw"), F.coalesce(F.size("cells"), F.lit(0)).alias("n_cells"),
        F.coalesce(F.size("cells") - F.col("_bare"), F.lit(0)).alias("n_cells_filled"),
        F.when(F.size("cells") > 0, F.size("cells_raw") / F.size("cells")).alias("compression_ratio"),
        F.aggregate("_hops", F.lit(0.0), lambda s, d: s + d).alias("encoded_len_km"), F.coalesce(F.array_max("_hops"), F.lit(0.0)).alias("max_hop_km"),
    )


def segments(encoded: DataFrame, max_hop_km: float = C.MAX_HOP_KM) -> DataFrame:
    """(id, entity, seg, cells, cum): gap-free stretches of at least two cells with their prefix sums in km."""
    df = encoded.select("id", "entity", "cells", S.hops_km(F.col("cells")).alias("h"))
    df = df.select("id", "entity", F.posexplode(S.split_at_gaps(F.col("cells"), F.col("h"), max_hop_km)).alias("seg", "cells"))
    return df.withColumn("cum", S.prefix_sums(S.hops_km(F.col("cells"))))


def encoding_summary(encoded: DataFrame, max_hop_km: float = C.MAX_HOP_KM) -> DataFrame:
    return encoded.agg(
        F.count("*").alias("trips"), F.avg("n_cells_raw").alias("avg_raw"), F.avg("n_cells").alias("avg_cells"), F.avg("compression_ratio").alias("avg_ratio"),
        F.max("max_hop_km").alias("worst_hop_km"), F.count_if(F.col("max_hop_km") > max_hop_km).alias("over_bound"),
    )


def cell_entropy(encoded: DataFrame, sectors: int = 8) -> DataFrame:
    """(cell, n, entropy): Shannon entropy in bits of the direction in which trips leave a cell."""
    n = F.size("cells")
    steps = F.when(n < 2, F.array().cast("array<struct<f:string,t:string>>")).otherwise(
        F.zip_with(F.slice("cells", F.lit(1), n - 1), F.slice("cells", F.lit(2), n - 1), lambda a, b: F.struct(a.alias("f"), b.alias("t")))
    )
    s = encoded.select(F.explode(steps).alias("s")).select("s.f", "s.t").groupBy("f", "t").agg(F.count("*").alias("c"))
    a, b = geo.hex_centre(F.col("f")), geo.hex_centre(F.col("t"))
    sector = F.floor(geo.bearing_deg(a["lon"], a["lat"], b["lon"], b["lat"]) / (360.0 / sectors))
    by = s.groupBy(F.col("f").alias("cell"), sector.alias("sector")).agg(F.sum("c").alias("c"))
    total = by.groupBy("cell").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("e"))
    return total.select("cell", "n", (F.log2("n") - F.col("e") / F.col("n")).alias("entropy"))


def grid_comparison(trips: DataFrame, edges_km: tuple[float, ...] = (0.461, 0.174, 0.066), precisions: tuple[int, ...] = (6, 7)) -> DataFrame:
    """(grid, trips, avg_cells, avg_ratio, cells): hexagon edges and geohash precisions side by side, in one pass over the trips."""
    hexagon = lambda e: lambda p: geo.hex_cell(p["lon"], p["lat"], e)
    hashed = lambda k: lambda p: geo.geohash(p["lon"], p["lat"], k)
    kinds = [(f"hex_{e}", hexagon(e)) for e in edges_km] + [(f"geohash_{k}", hashed(k)) for k in precisions]
    each = F.array(*[F.struct(F.lit(name).alias("grid"), F.transform("points", f).alias("raw")) for name, f in kinds])
    df = trips.select(F.explode(each).alias("x")).select("x.grid", "x.raw", S.compact(F.col("x.raw")).alias("cells"))
    per = df.groupBy("grid").agg(F.count("*").alias("trips"), F.avg(F.size("cells")).alias("avg_cells"), F.avg(F.when(F.size("cells") > 0, F.size("raw") / F.size("cells"))).alias("avg_ratio"))
    distinct = df.select("grid", F.explode("cells").alias("c")).groupBy("grid").agg(F.countDistinct("c").alias("cells"))
    return per.join(distinct, "grid")


def grid_entropy(trips: DataFrame, edges_km: tuple[float, ...] = (0.461, 0.174, 0.066), precisions: tuple[int, ...] = (6, 7), sectors: int = 8) -> DataFrame:
    """(grid, cells, entropy): the mean over cells of the entropy of the directions in which trips leave them, for each grid."""
    hexagon = lambda e: lambda p: geo.hex_cell(p["lon"], p["lat"], e)
    middle = lambda e: lambda c: geo.hex_centre(c, e)
    hashed = lambda k: lambda p: geo.geohash(p["lon"], p["lat"], k)
    kinds = [(f"hex_{e}", hexagon(e), middle(e)) for e in edges_km] + [(f"geohash_{k}", hashed(k), geo.geohash_centre) for k in precisions]
    out = None
    for name, cell, centre in kinds:
        seq = trips.select(S.compact(F.transform("points", cell)).alias("s"))
        n = F.size("s")
        steps = F.when(n < 2, F.array().cast("array<struct<f:string,t:string>>")).otherwise(F.zip_with(F.slice("s", F.lit(1), n - 1), F.slice("s", F.lit(2), n - 1), lambda a, b: F.struct(a.alias("f"), b.alias("t"))))
        pair = seq.select(F.explode(steps).alias("x")).groupBy("x.f", "x.t").agg(F.count("*").alias("c"))
        a, b = centre(F.col("f")), centre(F.col("t"))
        sector = F.floor(geo.bearing_deg(a["lon"], a["lat"], b["lon"], b["lat"]) / (360.0 / sectors))
        by = pair.groupBy("f", sector.alias("sector")).agg(F.sum("c").alias("c")).groupBy("f").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("e"))
        row = by.agg(F.lit(name).alias("grid"), F.count("*").alias("cells"), F.avg(F.log2("n") - F.col("e") / F.col("n")).alias("entropy"))
        out = row if out is None else out.unionByName(row)
    return out


def drops(feats: DataFrame) -> DataFrame:
    """One row: trips, how many each anomaly flag would drop before encoding (one may have several), and how many go on to it."""
    names = ["is_teleport", "is_idle", "is_too_fast", "is_too_short", "is_offgrid"]
    good = ~F.coalesce(F.col("is_anomalous"), F.lit(False))
    return feats.agg(F.count("*").alias("trips"), *[F.count_if(c).alias(c) for c in names], F.count_if(good).alias("encoded"))


def leaked(encoded: DataFrame, feats: DataFrame, id_col: str = "id") -> DataFrame:
    """One row: encoded trips, and how many of them are flagged as anomalous, which should have been left out."""
    bad = encoded.join(feats.filter("is_anomalous").select(id_col), id_col, "left_semi").agg(F.count("*").alias("leaked"))
    return encoded.agg(F.count("*").alias("encoded")).crossJoin(bad)
