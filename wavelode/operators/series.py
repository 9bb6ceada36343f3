"""Time-series primitives over (subject, seq, t, p), as window and aggregate expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kernels import rolling_medians
from ..functions.lineage import cut

MAD_SCALE = 1.4826


def ordered():
    """A subject's samples in order."""
    return Window.partitionBy("subject").orderBy("seq")


def backwards():
    """From a sample on to the subject's last, by order reversed: Spark evaluates such a frame in one pass."""
    return Window.partitionBy("subject").orderBy(F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, 0)


def odd(n: int, least: int = 3) -> int:
    """The next odd count from ``n`` on, at least ``least``."""
    n = max(n, least)
    return n + 1 - n % 2


def samples(seconds: float | Column, dt: Column, least: int = 3, make_odd: bool = True) -> Column:
    """Samples in a span of time: rounded half to even, clamped, and made odd where asked."""
    seconds = seconds if isinstance(seconds, Column) else F.lit(float(seconds))
    n = F.greatest(F.bround(seconds / dt).cast("int"), F.lit(least))
    return n + F.when(n % 2 == 0, 1).otherwise(0) if make_odd else n


def sampling_interval(df: DataFrame) -> DataFrame:
    """(subject, dt): median of the positive time differences."""
    d = F.col("t") - F.lag("t").over(ordered())
    return df.withColumn("d", d).where("d > 0").groupBy("subject").agg(F.percentile("d", 0.5).alias("dt"))


def differences(df: DataFrame, column: str = "p") -> DataFrame:
    """Add dp and ddp, first and second backward differences; each begins with 0."""
    w = ordered()
    df = df.withColumn("dp", F.col(column) - F.lag(column).over(w)).withColumn("dp", F.coalesce("dp", F.col(column) - F.col(column)))
    return df.withColumn("ddp", F.col("dp") - F.coalesce(F.lag("dp").over(w), F.col("dp")))


def trapezoid_area(df: DataFrame, *by: str) -> DataFrame:
    """Area under p by t for each subject, or for each group of ``by``."""
    keys = by or ("subject",)
    w = Window.partitionBy(*keys).orderBy("seq")
    part = (F.col("p") + F.lag("p").over(w)) / 2 * (F.col("t") - F.lag("t").over(w))
    return df.withColumn("part", part).groupBy(*keys).agg(F.coalesce(F.sum("part"), F.lit(0.0)).alias("area"))


#: Samples of a block, in which the wide windows over a subject's samples are evaluated.
BLOCK = 1024


def in_blocks(df: DataFrame, reach: int | Column):
    """``df`` with _block, and the window over a block's samples in order.

    A sample is copied to every block that has samples within ``reach`` of it, so frames
    up to that reach are whole for a block's own samples (``own_block``). Blocks of a long
    series are evaluated side by side. Needs seq without gaps from 0.
    """
    first, last = F.greatest(F.floor((F.col("seq") - reach) / BLOCK), F.lit(0)), F.floor((F.col("seq") + reach) / BLOCK)
    # Dealt to all tasks: rows are small, but a row's window is much work.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.withColumn("_block", F.explode(F.sequence(first, last))).repartition(tasks, "subject", "_block"), Window.partitionBy("subject", "_block").orderBy("seq")


def own_block(df: DataFrame) -> DataFrame:
    """Each sample once, from the block that it belongs to."""
    return df.where(F.floor(F.col("seq") / BLOCK) == F.col("_block")).drop("_block")


def filled(df: DataFrame, column: str, out: str) -> DataFrame:
    """Nulls take the next value, and the last one where there is no next."""
    return filled_all(df, {column: out})


def filled_all(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``filled`` for several columns, given with the names of the results, in one pass.

    Blocks are filled side by side; what is beyond a block comes from a table of the first
    and last value of every block.
    """
    # Read twice, so what it took is not done twice.
    df = cut(df.withColumn("_block", F.floor(F.col("seq") / BLOCK)))
    held = {c: F.when(F.col(c).isNotNull(), F.struct("seq", F.col(c).alias("v"))) for c in columns}
    ends = df.groupBy("subject", "_block").agg(*[f(h).alias(f"{n}{c}") for c, h in held.items() for n, f in (("_a", F.min), ("_b", F.max))])
    later = Window.partitionBy("subject").orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("subject").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("subject", "_block", *[F.last(f"_a{c}", True).over(later)["v"].alias(f"_next{c}") for c in columns], *[F.last(f"_b{c}", True).over(earlier)["v"].alias(f"_before{c}") for c in columns])
    own = Window.partitionBy("subject", "_block")
    up, down = own.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0), own.orderBy(F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, 0)
    df = df.select("*", *[F.last(c, True).over(down).alias(f"_down{c}") for c in columns]).select("*", *[F.last(c, True).over(up).alias(f"_up{c}") for c in columns]).join(ends, ["subject", "_block"])
    sides = ("_down", "_next", "_up", "_before")
    return df.withColumns({out: F.coalesce(*[f"{side}{c}" for side in sides]) for c, out in columns.items()}).drop("_block", *[f"{side}{c}" for side in sides for c in columns])


def neighbourhoods(df: DataFrame, width: str, column: str, out: str = "_near", reach: int = 1) -> DataFrame:
    """Add the samples around each, structs of seq and v in order, as many as the subject's own ``width`` says.

    ``width`` is a column that is the same for a subject's samples, so frames of a window,
    which have one size, cannot express it: blocks of samples are gathered as arrays, from which
    every sample's part is cut, ``reach`` half widths to both sides.
    """
    h = F.floor(F.col(width) / 2)
    first, last = F.greatest(F.floor((F.col("seq") - reach * h) / BLOCK), F.lit(0)), F.floor((F.col("seq") + reach * h) / BLOCK)
    rows = df.select(F.explode(F.sequence(first, last)).alias("_block"), h.cast("int").alias("_h"), F.struct("seq", *[c for c in df.columns if c != "seq"]).alias("_row"))
    blocks = rows.groupBy(F.col("_row.subject").alias("_subject"), "_block").agg(F.first("_h").alias("_h"), F.sort_array(F.collect_list(F.struct(F.col("_row.seq").alias("seq"), F.col(f"_row.{column}").alias("v"))), True).alias("_a"), F.collect_list(F.when(F.floor(F.col("_row.seq") / BLOCK) == F.col("_block"), F.col("_row"))).alias("_own"))
    place = lambda x: (x["seq"] - F.col("_a")[0]["seq"]).cast("int")
    side = reach * F.col("_h")
    near = lambda x: F.slice("_a", F.greatest(place(x) - side, F.lit(0)) + 1, F.least(place(x), side) + side + 1)
    cut_out = blocks.select(F.explode(F.transform("_own", lambda x: F.struct(x.alias("row"), near(x).alias("near")))).alias("_x"))
    return cut_out.select("_x.row.*", F.col("_x.near").alias(out)).select(*df.columns, out)


def rolling_median(df: DataFrame, width: int | str, column: str = "p", out: str = "median") -> DataFrame:
    """Centred median over an odd number of samples, filled where too few are there.

    ``width`` is one number, or the name of a column with each subject's own.
    """
    return rolling(df, ("median", width, column, out))


def rolling(df: DataFrame, *wanted: tuple[str, int | str, str, str], eps: float = 1e-9) -> DataFrame:
    """Several rolling medians and MADs, each (median or mad, width, column, out), in one pass over blocks of samples."""
    wholes = None
    for what, _, column, out in wanted:
        if what == "mad":
            whole = robust_mad(df, column, 0.0).withColumnRenamed("mad", f"_whole{out}")
            wholes = whole if wholes is None else wholes.join(whole, "subject")
    halves = [F.floor(F.col(w) / 2) if isinstance(w, str) else F.lit(w // 2) for w in dict.fromkeys(w for _, w, _, _ in wanted)]
    raw = [f"_raw{out}" for *_, out in wanted]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema] + [T.StructField(c, T.DoubleType()) for c in raw])
    df = in_blocks(df, F.greatest(*halves) if len(halves) > 1 else halves[0])[0].groupBy("subject", "_block").applyInArrow(_rolled(wanted), schema)
    df = filled_all(df, {f"_raw{out}": out for *_, out in wanted}).drop(*raw)
    if wholes is None:
        return df
    mads = [out for what, *_, out in wanted if what == "mad"]
    return df.join(wholes, "subject").withColumns({out: F.greatest(out, F.lit(eps), 0.05 * F.col(f"_whole{out}")) for out in mads}).drop(*[f"_whole{out}" for out in mads])


def _rolled(wanted: tuple[tuple[str, int | str, str, str], ...]):
    """A block's own samples with their medians and MADs; null where too few values are around a sample."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("seq")
        own = np.flatnonzero(rows.column("seq").to_numpy() // BLOCK == rows.column("_block")[0].as_py())
        out = rows.drop_columns(["_block"]).take(own)
        for what, width, column, name in wanted:
            width = rows.column(width)[0].as_py() if isinstance(width, str) else width
            x, held = rows.column(column).cast(pa.float64()), rows.column(column).is_valid().to_numpy()
            value, n = rolling_medians(x.to_numpy(), held, int(width // 2), own, what == "mad")
            out = out.append_column(f"_raw{name}", pa.array(MAD_SCALE * value if what == "mad" else value, pa.float64(), mask=n < max(3, width // 3)))
        return out

    return run


def array_median(a: Column) -> Column:
    s = F.array_sort(a)
    n = F.size(a)
    return F.when(n > 0, (F.element_at(s, ((n + 1) / 2).cast("int")) + F.element_at(s, (n / 2).cast("int") + 1)) / 2)


def robust_mad(df: DataFrame, column: str = "p", eps: float = 1e-9, *by: str) -> DataFrame:
    """(subject, mad): scaled median absolute deviation, at least ``eps``."""
    keys = by or ("subject",)
    mid = df.groupBy(*keys).agg(F.percentile(column, 0.5).alias("m"))
    dev = df.join(mid, list(keys)).groupBy(*keys).agg(F.percentile(F.abs(F.col(column) - F.col("m")), 0.5).alias("d"))
    return dev.select(*keys, F.greatest(F.col("d") * MAD_SCALE, F.lit(eps)).alias("mad"))


def rolling_mad(df: DataFrame, width: int | str, column: str = "p", out: str = "mad", eps: float = 1e-9) -> DataFrame:
    """Centred scaled MAD, filled like the rolling median, at least 0.05 of the subject's own MAD; widths as there."""
    return rolling(df, ("mad", width, column, out), eps=eps)


def scaled(df: DataFrame, column: str = "p", eps: float = 1e-12, added: bool = False) -> DataFrame:
    """Add three scalings by subject: robust z, min-max, and min-max of values clipped to p5..p95.

    The deviation that z is divided by is ``eps`` at least, or has ``eps`` added to it.
    """
    mad = robust_mad(df, column, 0.0)
    q = df.groupBy("subject").agg(F.percentile(column, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("q"), F.min(column).alias("lo"), F.max(column).alias("hi"))
    df = df.join(q.join(mad, "subject"), "subject")
    x, low, high = F.col(column), F.col("q")[0], F.col("q")[2]
    clipped = (F.least(F.greatest(x, low), high) - low) / (high - low)
    return (
        df.withColumn("robust_z", (x - F.col("q")[1]) / (F.col("mad") + eps if added else F.greatest("mad", F.lit(eps))))
        .withColumn("minmax", (x - F.col("lo")) / (F.col("hi") - F.col("lo") + eps))
        .withColumn("minmax01", F.when(x.isNull(), 0.0).when(high - low <= eps, 0.5).otherwise(clipped))
        .drop("q", "lo", "hi", "mad")
    )


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over rows with both values: null below 3 of them or where one hardly varies."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    enough = (F.count(x) >= 3) & (F.stddev_pop(x) >= 1e-12) & (F.stddev_pop(y) >= 1e-12)
    return F.when(enough, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def runs(df: DataFrame, flag: str, *by: str) -> DataFrame:
    """Add run: a number that is the same for neighbouring rows with the same flag."""
    keys = by or ("subject",)
    all_rows, same = Window.partitionBy(*keys).orderBy("seq"), Window.partitionBy(*keys, flag).orderBy("seq")
    return df.withColumn("run", F.row_number().over(all_rows) - F.row_number().over(same))


def run_table(df: DataFrame, flag: str) -> DataFrame:
    """Maximal runs of true: subject, start and end (exclusive) of seq, times and length."""
    found = runs(df, flag).where(F.col(flag)).groupBy("subject", "run")
    return found.agg(F.min("seq").alias("start"), (F.max("seq") + 1).alias("end"), F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.count(F.lit(1)).alias("n")).drop("run")


def fill_short_gaps(df: DataFrame, flag: str, most: int, out: str = "filled") -> DataFrame:
    """Close false runs of up to ``most`` samples that have true samples on both sides."""
    df = runs(df, flag)
    run = Window.partitionBy("subject", flag, "run")
    ends = Window.partitionBy("subject")
    df = df.withColumn("_n", F.count(F.lit(1)).over(run)).withColumn("_a", F.min("seq").over(run)).withColumn("_b", F.max("seq").over(run))
    inside = (F.col("_a") > F.min("seq").over(ends)) & (F.col("_b") < F.max("seq").over(ends))
    return df.withColumn(out, F.col(flag) | (inside & (F.col("_n") <= most))).drop("run", "_n", "_a", "_b")


def expand_mask(df: DataFrame, flag: str, radius: int, out: str = "expanded") -> DataFrame:
    """True within ``radius`` samples of a true sample."""
    return df.withColumn(out, F.max(flag).over(ordered().rowsBetween(-radius, radius)))


def mask_iou(df: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """Overlap of two masks over their union, null where both are empty."""
    both, either = F.count_if(F.col(a) & F.col(b)), F.count_if(F.col(a) | F.col(b))
    return df.groupBy(*(by or ("subject",))).agg(F.try_divide(both.cast("double"), either.cast("double")).alias("iou"))


def interpolate(df: DataFrame, known: Column, x: str = "t", y: str = "p", out: str = "filled") -> DataFrame:
    """``y`` where ``known``, else linear in ``x`` between the known neighbours, and level beyond the ends."""
    w = ordered()
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), backwards()
    point = F.when(known, F.struct(F.col(x).alias("x"), F.col(y).alias("y")))
    df = df.withColumn("_l", F.last(point, ignorenulls=True).over(before)).withColumn("_r", F.last(point, ignorenulls=True).over(after))
    l, r = F.col("_l"), F.col("_r")
    share = F.coalesce(F.try_divide(F.col(x) - l["x"], r["x"] - l["x"]), F.lit(0.0))
    return df.withColumn(out, F.when(known, F.col(y)).otherwise(F.coalesce(l["y"] + share * (r["y"] - l["y"]), l["y"], r["y"]))).drop("_l", "_r")


def bfill_ffill(df: DataFrame, column: str, out: str = "filled") -> DataFrame:
    return filled(df, column, out)


def resample(df: DataFrame, dt: DataFrame | None = None) -> DataFrame:
    """Linear interpolation on a uniform grid: subject, k, t and p, from the first time to the last at most.

    The grid joins the rows as one ordered union, so every grid point finds its
    neighbours by a window and no range join is needed.
    """
    dt = dt if dt is not None else sampling_interval(df)
    span = df.groupBy("subject").agg(F.min("t").alias("t0"), F.max("t").alias("t1")).join(dt, "subject")
    k = F.explode(F.sequence(F.lit(0), F.floor((F.col("t1") - F.col("t0")) / F.col("dt") + 1e-9).cast("int")))
    grid = span.select("subject", "t0", "dt", k.alias("k")).select("subject", F.col("k").cast("long").alias("k"), (F.col("t0") + F.col("k") * F.col("dt")).alias("t"), F.lit(None).cast("double").alias("p"))
    both = df.where("p is not null").select("subject", F.lit(None).cast("long").alias("k"), "t", "p").unionByName(grid)
    order = Window.partitionBy("subject").orderBy("t", F.col("k").asc_nulls_first())
    both = both.withColumn("seq", F.row_number().over(order))
    return interpolate(both, F.col("p").isNotNull()).where("k is not null").select("subject", "k", "t", F.col("filled").alias("p"))


def uniform(df: DataFrame, values: tuple[str, ...], masks: tuple[str, ...] = (), dt: DataFrame | None = None) -> DataFrame:
    """Many columns on a uniform grid in one ordered pass: subject, k, t, ``values`` and ``masks``.

    Grid points lie every ``dt`` (subject, dt; the sampling interval by default) from the first
    time to the last at most. Values are linear between the known neighbours of their own
    column. A mask holds at a point between two neighbouring samples that have it, and within
    half an interval of a sample that has it.
    """
    dt = dt if dt is not None else sampling_interval(df)
    span = df.groupBy("subject").agg(F.min("t").alias("_t0"), F.max("t").alias("_t1")).join(dt.select("subject", F.col("dt").alias("_dt")), "subject")
    k = F.explode(F.sequence(F.lit(0), F.floor((F.col("_t1") - F.col("_t0")) / F.col("_dt") + 1e-9).cast("int")))
    grid = span.select("subject", "_t0", "_dt", k.alias("k")).select("subject", F.col("k").cast("long").alias("k"), (F.col("_t0") + F.col("k") * F.col("_dt")).alias("t"), "_dt")
    point = {c: F.when(F.col(c).isNotNull(), F.struct("t", F.col(c).cast("double").alias("v"))) for c in values}
    held = {c: F.when(F.col(c), F.col("t")) for c in masks}
    rows = df.select("subject", "t", *[e.alias(f"_{c}") for c, e in (point | held).items()], *[F.coalesce(F.col(c), F.lit(False)).alias(f"_in_{c}") for c in masks])
    both = rows.unionByName(grid, allowMissingColumns=True)
    # Samples come before a grid point at their time, from either side.
    order = [F.col("t"), F.col("k").asc_nulls_first()]
    before = Window.partitionBy("subject").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("subject").orderBy(F.col("t").desc(), F.col("k").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    sides = [*(f"_{c}" for c in values), *(f"_{c}" for c in masks), *(f"_in_{c}" for c in masks)]
    both = both.select("*", *[F.last(c, True).over(before).alias(f"l{c}") for c in sides])
    both = both.select("*", *[F.last(c, True).over(after).alias(f"r{c}") for c in sides]).where("k is not null")

    def linear(c: str) -> Column:
        l, r = F.col(f"l_{c}"), F.col(f"r_{c}")
        share = F.coalesce(F.try_divide(F.col("t") - l["t"], r["t"] - l["t"]), F.lit(0.0))
        return F.coalesce(l["v"] + share * (r["v"] - l["v"]), l["v"], r["v"]).alias(c)

    def covered(c: str) -> Column:
        half, no = F.col("_dt") / 2, F.lit(False)
        close = F.coalesce(F.col("t") - F.col(f"l_{c}") <= half, no) | F.coalesce(F.col(f"r_{c}") - F.col("t") <= half, no)
        return (close | F.coalesce(F.col(f"l_in_{c}") & F.col(f"r_in_{c}"), no)).alias(c)

    return both.select("subject", "k", "t", *map(linear, values), *map(covered, masks))


def project_mask(df: DataFrame, flag: str, grid: DataFrame, pad: float) -> DataFrame:
    """Grid points (subject, k, t) with whether they lie in a run of ``flag``, padded on both sides.

    Padded runs become steps up and down; a running sum over the ordered union of steps
    and grid points counts the runs that hold a point.
    """
    found = run_table(df, flag)
    up = found.select("subject", (F.col("t_start") - pad).alias("t"), F.lit(0).alias("kind"), F.lit(1).alias("step"), F.lit(None).cast("long").alias("k"))
    down = found.select("subject", (F.col("t_end") + pad).alias("t"), F.lit(2).alias("kind"), F.lit(-1).alias("step"), F.lit(None).cast("long").alias("k"))
    points = grid.select("subject", "t", F.lit(1).alias("kind"), F.lit(0).alias("step"), "k")
    w = Window.partitionBy("subject").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = up.union(down).union(points).withColumn("_in", F.sum("step").over(w))
    return both.where("kind = 1").select("subject", "k", "t", (F.col("_in") > 0).alias("inside"))


def savgol_by_width(df: DataFrame, width: str, column: str = "p", out: str = "smooth") -> DataFrame:
    """As ``savgol``, with each subject's own odd number of samples in the column ``width``; below 5 values stay."""
    n = df.groupBy("subject").agg(F.count(F.lit(1)).alias("_n"))
    df = neighbourhoods(df.join(n, "subject"), width, column, "_near", reach=2)
    wide = F.col(width).cast("int")
    h = F.floor(wide / 2).cast("int")
    size = wide.cast("double")
    s2 = h * (h + 1) * (2 * h + 1) / 3
    s4 = s2 * (3 * h * h + 3 * h - 1) / 5
    # Near an end the whole window nearest to it is fitted, and read at the sample's place in it.
    middle = F.least(F.greatest(F.col("seq"), h.cast("long")), F.col("_n") - 1 - h)
    x = (F.col("seq") - middle).cast("double")
    weight = lambda i: 1 / size + i * x / s2 + (i * i - s2 / size) * (x * x - s2 / size) / (s4 - s2 * s2 / size)
    inside = F.filter("_near", lambda y: F.abs(y["seq"] - middle) <= h)
    fitted = F.aggregate(inside, F.lit(0.0), lambda a, y: a + y["v"] * weight((y["seq"] - middle).cast("double")))
    value = F.when((wide < 5) | (F.col("_n") < wide), F.col(column)).otherwise(fitted)
    return df.withColumn(out, F.coalesce(value, F.col(column))).drop("_near", "_n")


def savgol(df: DataFrame, width: int, column: str = "p", out: str = "smooth") -> DataFrame:
    """Value of a least-squares parabola over the ``width`` samples around each.

    Samples nearer than half a window to an end take the value of the first or last whole
    window's parabola at their place. A subject with fewer than ``width`` samples keeps
    its values, and so does a sample whose window has a missing one.
    """
    h, w = width // 2, ordered()
    n, s2 = width, h * (h + 1) * (2 * h + 1) / 3
    s4 = s2 * (3 * h * h + 3 * h - 1) / 5
    # Orthogonal polynomials 1, i and i * i - s2 / n over the window's places.
    weight = lambda i, x: 1 / n + i * x / s2 + (i * i - s2 / n) * (x * x - s2 / n) / (s4 - s2 * s2 / n)
    total = None
    for i in range(-h, h + 1):
        term = ((F.lag(column, -i) if i < 0 else F.lead(column, i)).over(w) if i else F.col(column)) * weight(i, 0)
        total = term if total is None else total + term
    count = df.groupBy("subject").agg(F.count(F.lit(1)).alias("_n"))
    df = df.join(count, "subject")
    near = (F.col("seq") < width) | (F.col("seq") >= F.col("_n") - width)
    held = F.sort_array(F.collect_list(F.when(near, F.struct("seq", F.col(column).alias("v")))))
    ends = df.where(near).groupBy("subject").agg(held.alias("_e")).where(F.size("_e") >= width)
    df = df.withColumn("_mid", total).join(ends, "subject", "left")
    place = lambda first, x: sum((F.get("_e", first + i + h)["v"] * weight(i, x) for i in range(-h, h + 1)), F.lit(0.0))
    left, right = F.col("seq") < h, F.col("seq") >= F.col("_n") - h
    edge = F.when(left, place(F.lit(0), F.col("seq") - h)).when(right, place(F.size("_e") - width, F.col("seq") - (F.col("_n") - 1 - h)))
    value = F.when(F.col("_n") < width, F.col(column)).when(left | right, edge).otherwise(F.col("_mid"))
    return df.withColumn(out, F.coalesce(value, F.col(column))).drop("_mid", "_e", "_n")
