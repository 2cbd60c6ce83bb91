"""One-dimensional marginals: bandwidths, kernel density grids, monotone cubic interpolation and their tables."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.operators.ranks import finite, quantiles


#: Points of a grid that is sent to all tasks.
MOST_GRID = 100_000


def robust_bandwidth(df: DataFrame, columns: list[str], group: list[str] | None = None) -> DataFrame:
    """A row a column (and group): n, sd (n - 1), iqr and h = 0.9 min(sd, iqr / 1.34) n**-1/5 / sd.

    An iqr of 0 counts as sd; fewer than two values or sd 0 give 1.
    """
    group = group or []
    long = df.select(*group, F.explode(F.array(*(F.struct(F.lit(c).alias("coord"), F.col(c).cast("double").alias("x")) for c in columns))).alias("p")).select(*group, "p.*")
    keys = [*group, "coord"]
    stats = finite(long, "x").groupBy(*keys).agg(F.count("*").alias("n"), F.stddev_samp("x").alias("sd"))
    ends = quantiles(long, "x", {"lower_": 0.25, "upper_": 0.75}, keys).select(*keys, (F.col("upper_") - F.col("lower_")).alias("iqr"))
    stats = stats.join(ends, keys)
    scale = F.when(F.col("iqr") > 0, F.least("sd", F.col("iqr") / 1.34)).otherwise(F.col("sd"))
    h = F.when((F.col("n") < 2) | (F.coalesce("sd", F.lit(0.0)) <= 0), F.lit(1.0)).otherwise(0.9 * scale * F.pow("n", F.lit(-0.2)) / F.col("sd"))
    return stats.withColumn("h", h)


def kde_grid(df: DataFrame, column: str, grid: DataFrame, width: float) -> DataFrame:
    """g, density: the Gaussian kernel density at each grid point g, by counts of distinct values.

    grid: one column g, MOST_GRID rows at most (else ValueError). The join is by design all grid points against all distinct
    values; map-side partial sums leave one row a grid point and task. For columns with many distinct values fit_marginal
    works on bins.
    """
    if grid.limit(MOST_GRID + 1).count() > MOST_GRID:
        raise ValueError(f"a grid has {MOST_GRID} points at most")
    values = finite(df, column).groupBy(F.col(column).cast("double").alias("x")).agg(F.count("*").alias("c"))
    t = (F.col("g") - F.col("x")) / width
    sums = values.join(F.broadcast(grid)).groupBy("g").agg(F.sum(F.col("c") * F.exp(-0.5 * t * t)).alias("s"), F.sum("c").alias("n"))
    return sums.select("g", (F.col("s") / (F.col("n") * width * math.sqrt(2 * math.pi))).alias("density"))


@dataclass(frozen=True)
class Marginal:
    """A fitted marginal as tables: distribution function and log density on a grid, and the kernels' sum beyond it."""

    n: int
    width: float
    grid: np.ndarray
    density: np.ndarray
    cdf: np.ndarray
    mass: np.ndarray  # rows by grid point, shared between neighbours

    def pdf(self, x: np.ndarray) -> np.ndarray:
        return np.exp(self.log_pdf(x))

    def log_pdf(self, x: np.ndarray) -> np.ndarray:
        """Cubic interpolation of the log density on the grid; beyond it the kernels of all bins, never a floor."""
        x = np.asarray(x, float)
        out = pchip(self.grid, np.log(np.maximum(self.density, 1e-300)), np.clip(x, self.grid[0], self.grid[-1]))
        beyond = np.flatnonzero((x < self.grid[0]) | (x > self.grid[-1]))
        centre, weight = self.grid[self.mass > 0], np.log(self.mass[self.mass > 0])
        for at in np.array_split(beyond, max(1, -(-len(beyond) // 1000))):
            logs = weight - 0.5 * ((x[at, None] - centre) / self.width) ** 2
            top = logs.max(1, initial=-np.inf)
            out[at] = top + np.log(np.exp(logs - top[:, None]).sum(1)) - math.log(self.n * self.width * math.sqrt(2 * math.pi))
        return out

    def distribution(self, x: np.ndarray) -> np.ndarray:
        least = 0.5 / (self.n + 1)
        return np.clip(pchip(self.grid, self.cdf, np.clip(x, self.grid[0], self.grid[-1])), least, 1 - least)

    def quantile(self, p: np.ndarray) -> np.ndarray:
        keep = np.concatenate(([True], np.diff(self.cdf) > 0))
        return pchip(self.cdf[keep], self.grid[keep], np.clip(p, self.cdf[keep][0], self.cdf[keep][-1]))


def fit_marginal(df: DataFrame, column: str, points: int = 2000, pad: float = 4.0) -> Marginal:
    return fit_marginals(df, [column], points, pad)[column]


def fit_marginals(df: DataFrame, columns: list[str], points: int = 2000, pad: float = 4.0) -> dict[str, Marginal]:
    """Bins the columns on fine uniform grids (one aggregation for all, `points` rows a column at most) and convolves with the
    kernel. A column without finite values is an error."""
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in columns))
    stats = {r.coord: r for r in robust_bandwidth(rows, columns).collect()}  # a row a column
    if missing := set(columns) - stats.keys():
        raise ValueError(f"no finite values: {', '.join(sorted(missing))}")
    inside = {c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)) for c in columns}
    ends = rows.agg(*(f(inside[c]) for c in columns for f in (F.min, F.max))).first()
    grids, widths, shares = [], [], []
    for j, c in enumerate(columns):
        width = stats[c].h * (stats[c].sd if stats[c].sd and stats[c].sd > 0 else 1.0)
        grid = np.linspace(ends[2 * j] - pad * width, ends[2 * j + 1] + pad * width, points)
        place = (inside[c] - float(grid[0])) / float(grid[1] - grid[0])
        cell = F.floor(place)
        shares += [F.struct(F.lit(j).alias("j"), (cell + k).alias("k"), (1 - (place - cell) if k == 0 else place - cell).alias("w")) for k in (0, 1)]
        grids.append(grid)
        widths.append(width)
    masses = np.zeros((len(columns), points + 1))
    split = rows.select(F.explode(F.array(*shares)).alias("p")).where("p.w IS NOT NULL")
    for r in split.groupBy("p.j", "p.k").agg(F.sum("p.w").alias("w")).collect():  # a row a grid point at most
        masses[r.j, int(r.k)] += r.w
    return {c: _smoothed(stats[c].n, widths[j], grids[j], masses[j, :points]) for j, c in enumerate(columns)}


def _smoothed(n: int, width: float, grid: np.ndarray, mass: np.ndarray) -> Marginal:
    step = grid[1] - grid[0]
    offsets = np.arange(-int(8 * width / step) - 1, int(8 * width / step) + 2) * step
    kernel = np.exp(-0.5 * (offsets / width) ** 2) / (width * math.sqrt(2 * math.pi))
    density = np.convolve(mass, kernel, "full")[len(offsets) // 2 :][: len(grid)] / n
    area = np.concatenate(([0.0], np.cumsum((density[1:] + density[:-1]) / 2 * step)))
    return Marginal(n, width, grid, density, area / area[-1], mass)


def pchip_slopes_np(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes of the monotone cubic: weighted harmonic means inside, a limited three-point rule at the ends."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    if len(d) == 1:
        return np.array([d[0], d[0]])
    w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        inner = np.where(d[:-1] * d[1:] > 0, (w1 + w2) / (w1 / d[:-1] + w2 / d[1:]), 0.0)

    def end(h0, h1, d0, d1):
        m = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        if m * d0 <= 0:
            return 0.0
        return 3 * d0 if d0 * d1 <= 0 and abs(m) > 3 * abs(d0) else m

    return np.concatenate(([end(h[0], h[1], d[0], d[1])], inner, [end(h[-1], h[-2], d[-1], d[-2])]))


def pchip(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    m = pchip_slopes_np(x, y)
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)
    h = x[k + 1] - x[k]
    t = (at - x[k]) / h
    return y[k] * (1 + 2 * t) * (1 - t) ** 2 + h * m[k] * t * (1 - t) ** 2 + y[k + 1] * t * t * (3 - 2 * t) + h * m[k + 1] * t * t * (t - 1)


def pchip_slopes(grid: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Adds slope at each grid point of each group, as pchip_slopes_np. Grids are small; groups go apart."""
    order = Window.partitionBy(group).orderBy(x)
    at = lambda c, k: (F.lead(c, k) if k > 0 else F.lag(c, -k)).over(order)
    h0, h1 = F.col(x) - at(x, -1), at(x, 1) - F.col(x)
    d0, d1 = (F.col(y) - at(y, -1)) / h0, (at(y, 1) - F.col(y)) / h1
    w1, w2 = 2 * h1 + h0, h1 + 2 * h0
    inner = F.when(d0 * d1 > 0, (w1 + w2) / (w1 / d0 + w2 / d1)).otherwise(0.0)
    h2, hm = at(x, 2) - at(x, 1), at(x, -1) - at(x, -2)
    d2, dm = (at(y, 2) - at(y, 1)) / h2, (at(y, -1) - at(y, -2)) / hm

    def end(h: Column, k: Column, d: Column, e: Column) -> Column:
        m = ((2 * h + k) * d - h * e) / (h + k)
        return F.when(k.isNull(), d).when(m * d <= 0, 0.0).when((d * e <= 0) & (F.abs(m) > 3 * F.abs(d)), 3 * d).otherwise(m)

    return grid.withColumn("slope", F.when(d0.isNull(), end(h1, h2, d1, d2)).when(d1.isNull(), end(h0, hm, d0, dm)).otherwise(inner))


def interpolate_uniform(df: DataFrame, column: str, table: DataFrame, lo: float, step: float, points: int, name: str) -> DataFrame:
    """Adds linear interpolation into a table (k, y) over a uniform grid: an equality join on the cell's number."""
    place = F.greatest(F.lit(0.0), F.least(F.lit(float(points - 1)), (F.col(column) - lo) / step))
    cell = F.least(F.lit(points - 2), F.floor(place)).cast("int")
    pairs = table.select(F.col("k").alias("k_"), F.col("y").alias("y0_")).join(table.select((F.col("k") - 1).alias("k_"), F.col("y").alias("y1_")), "k_")
    joined = df.withColumn("p_", place).withColumn("k_", cell).join(pairs, "k_", "left")  # Spark sizes the table itself
    return joined.withColumn(name, F.col("y0_") + (F.col("p_") - F.col("k_")) * (F.col("y1_") - F.col("y0_"))).drop("p_", "k_", "y0_", "y1_")
