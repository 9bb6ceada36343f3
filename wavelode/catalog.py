"""Queries over the test tables, one for each operator, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import denoise, evaluate, features, ml, nonlinear, series, stats, vmd, windows
from .plans import reports
from .sources.series import event_series, finite, prepare, seconds, table, vector_series

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _r(*names: str, n: int = 6):
    """Columns rounded as the SQL rounds them."""
    return [F.round(F.col(c), n).alias(c) for c in names]


#: Parts of the SQL twins. Series by kind of event, and vectors as series.
EV = "s as (select event_type as subject, row_number() over (partition by event_type order by ts, event_id) - 1 as seq, epoch(ts) as t, value as p from events)"
US = "s as (select user_id as subject, row_number() over (partition by user_id order by ts, event_id) - 1 as seq, epoch(ts) as t, value as p from events)"
EM = "s as (select vec_id as subject, generate_subscripts(embedding, 1) - 1 as seq, unnest(embedding)::double as p from embeddings)"
W = "partition by subject order by seq"
DT = "dt as (select subject, quantile_cont(d, 0.5) as dt from (select subject, t - lag(t) over (partition by subject order by seq) as d from s) where d > 0 group by 1)"


def _fill(c: str) -> str:
    return f"coalesce(first_value({c} ignore nulls) over (partition by subject order by seq rows between current row and unbounded following), last_value({c} ignore nulls) over (partition by subject order by seq rows between unbounded preceding and current row))"


def _median(src: str, col: str, w: int, out: str, name: str, keep: str = "*") -> str:
    h = w // 2
    f = f"over (partition by subject order by seq rows between {h} preceding and {h} following)"
    return f"{name}0 as (select *, case when count({col}) {f} >= {max(3, w // 3)} then quantile_cont({col}, 0.5) {f} end as m_ from {src}), {name} as (select * exclude (m_), {_fill('m_')} as {out} from {name}0)"


def _mad(src: str, col: str, w: int, out: str, name: str) -> str:
    h = w // 2
    f = f"over (partition by subject order by seq rows between {h} preceding and {h} following)"
    return (
        f"{name}0 as (select *, case when count({col}) {f} >= {max(3, w // 3)} then 1.4826e0 * mad({col}) {f} end as m_ from {src}),"
        f"{name}g as (select subject, 1.4826e0 * mad({col}) as g_ from {src} group by 1),"
        f"{name} as (select a.* exclude (m_), greatest({_fill('m_').replace('subject order', 'a.subject order')}, 1e-9, 0.05e0 * g.g_) as {out} from {name}0 a join {name}g g on a.subject = g.subject)"
    )


DIFF = f"d0 as (select *, coalesce(p - lag(p) over ({W}), 0) as dp from s), d as (select *, dp - coalesce(lag(dp) over ({W}), dp) as ddp from d0)"


def _noise(src: str) -> str:
    """Differences and local noise of a table of series, as table noise."""
    return (
        f"n0 as (select *, coalesce(p - lag(p) over ({W}), 0) as dp from {src}), n1 as (select *, dp - coalesce(lag(dp) over ({W}), dp) as ddp from n0),"
        + _mad("n1", "dp", 17, "s_dp", "n2") + "," + _mad("n2", "ddp", 17, "s_ddp", "n3") + ", noise as (select *, s_dp / sqrt(2e0) as s_p from n3)"
    )


# ------------------------------------------------------------------ scans and series


@query("with s as (select event_type as subject, epoch(ts) as t, avg(value) as p from events where value is not null group by 1, 2) select subject, (row_number() over (partition by subject order by t) - 1)::bigint as seq, round(t, 6) as t, round(p, 6) as p from s qualify count(*) over (partition by subject) >= 7")
def prepare_signal(spark, sf):
    return prepare(table(spark, sf, "events"), "event_type", seconds("ts"), "value").select("subject", "seq", *_r("t", "p"))


@query(f"with {EV}, {DT} select subject, round(dt, 6) as dt from dt")
def sampling_interval(spark, sf):
    return series.sampling_interval(event_series(spark, sf)).select("subject", *_r("dt"))


@query(f"with {US}, {DIFF} select subject, seq::bigint as seq, round(dp, 6) as dp, round(ddp, 6) as ddp from d")
def first_second_diff(spark, sf):
    return series.differences(event_series(spark, sf, "user_id")).select("subject", "seq", *_r("dp", "ddp"))


@query(f"with {US} select subject, round(coalesce(sum(x), 0), 4) as area from (select subject, (p + lag(p) over ({W})) / 2 * (t - lag(t) over ({W})) as x from s) group by 1")
def trapezoid_area(spark, sf):
    return series.trapezoid_area(event_series(spark, sf, "user_id")).select("subject", *_r("area", n=4))


@query(f"with {EV}, {_median('s', 'p', 25, 'median', 'm')} select subject, seq::bigint as seq, round(median, 6) as median from m")
def rolling_median(spark, sf):
    return series.rolling_median(event_series(spark, sf), 25).select("subject", "seq", *_r("median"))


@query(f"with {EV}, {_mad('s', 'p', 25, 'mad', 'm')} select subject, seq::bigint as seq, round(mad, 6) as mad from m")
def rolling_mad(spark, sf):
    return series.rolling_mad(event_series(spark, sf), 25).select("subject", "seq", *_r("mad"))


@query(f"with {US} select subject, round(greatest(1.4826e0 * mad(p), 1e-9), 6) as mad from s group by 1")
def robust_mad(spark, sf):
    return series.robust_mad(event_series(spark, sf, "user_id")).select("subject", *_r("mad"))


_SCALED = f"""with {US}, q as (select subject, quantile_cont(p, 0.05) as lo5, quantile_cont(p, 0.5) as md, quantile_cont(p, 0.95) as hi5, min(p) as lo, max(p) as hi, 1.4826e0 * mad(p) as mad from s group by 1)
select s.subject, seq::bigint as seq, round((p - md) / greatest(mad, 1e-12), 6) as robust_z, round((p - lo) / (hi - lo + 1e-12), 6) as minmax,
round(case when hi5 - lo5 <= 1e-12 then 0.5e0 else (least(greatest(p, lo5), hi5) - lo5) / (hi5 - lo5) end, 6) as minmax01 from s join q on s.subject = q.subject"""


@query(_SCALED)
def robust_scalings(spark, sf):
    return series.scaled(event_series(spark, sf, "user_id")).select("subject", "seq", *_r("robust_z", "minmax", "minmax01"))


@query(f"with {US}, l as (select *, lag(p) over ({W}) as q from s) select subject, round(case when count(q) >= 3 and stddev_pop(p) filter (where q is not null) >= 1e-12 and stddev_pop(q) >= 1e-12 then corr(p, q) end, 6) as corr from l group by 1")
def safe_corr(spark, sf):
    df = event_series(spark, sf, "user_id").withColumn("q", F.lag("p").over(series.ordered()))
    return df.groupBy("subject").agg(series.safe_corr(F.col("p"), F.col("q")).alias("corr")).select("subject", *_r("corr"))


_FLAG = "f as (select *, p > 60 as flag from s)"
_RUNS = f"r as (select *, row_number() over ({W}) - row_number() over (partition by subject, flag order by seq) as run from f)"


def _flagged(spark, sf, subject="event_type"):
    return event_series(spark, sf, subject).withColumn("flag", F.col("p") > 60)


@query(f'with {EV}, {_FLAG}, {_RUNS} select subject, min(seq)::bigint as start, (max(seq) + 1)::bigint as "end", round(min(t), 6) as t_start, round(max(t), 6) as t_end, count(*) as n from r where flag group by subject, run')
def runs(spark, sf):
    return series.run_table(_flagged(spark, sf), "flag").select("subject", "start", "end", *_r("t_start", "t_end"), "n")


_FILLED = f"g as (select *, count(*) over (partition by subject, flag, run) as n_, min(seq) over (partition by subject, flag, run) as a_, max(seq) over (partition by subject, flag, run) as b_, min(seq) over (partition by subject) as lo_, max(seq) over (partition by subject) as hi_ from r), filled as (select subject, seq, t, p, flag, flag or (a_ > lo_ and b_ < hi_ and n_ <= 2) as filled from g)"


@query(f"with {EV}, {_FLAG}, {_RUNS}, {_FILLED} select subject, seq::bigint as seq, filled from filled")
def fill_short_gaps(spark, sf):
    return series.fill_short_gaps(_flagged(spark, sf), "flag", 2).select("subject", "seq", "filled")


@query(f"with {EV}, {_FLAG} select subject, seq::bigint as seq, bool_or(flag) over ({W} rows between 2 preceding and 2 following) as expanded from f")
def expand_mask(spark, sf):
    return series.expand_mask(_flagged(spark, sf), "flag", 2).select("subject", "seq", "expanded")


@query(f"with {US}, m as (select *, p > 60 as a, p > 100 or seq % 5 = 0 as b from s) select subject, round(sum((a and b)::int) / nullif(sum((a or b)::int), 0)::double, 6) as iou from m group by 1")
def mask_iou(spark, sf):
    df = event_series(spark, sf, "user_id").withColumn("a", F.col("p") > 60).withColumn("b", (F.col("p") > 100) | (F.col("seq") % 5 == 0))
    return series.mask_iou(df, "a", "b").select("subject", *_r("iou"))


def _interp(src: str, known: str, out: str, name: str, y: str = "p") -> str:
    l = f"over ({W} rows between unbounded preceding and current row)"
    r = f"over ({W} rows between current row and unbounded following)"
    k = lambda f, c, o: f"{f}(case when {known} then {c} end ignore nulls) {o}"
    return (
        f"{name}0 as (select *, {k('last_value', 't', l)} as lt, {k('last_value', y, l)} as ly, {k('first_value', 't', r)} as rt, {k('first_value', y, r)} as ry from {src}),"
        f"{name} as (select * exclude (lt, ly, rt, ry), case when {known} then {y} else coalesce(ly + coalesce((t - lt) / nullif(rt - lt, 0), 0) * (ry - ly), ly, ry) end as {out} from {name}0)"
    )


@query(f"with {US}, {_interp('s', 'seq % 7 <> 3 and p < 150', 'filled', 'i')} select subject, seq::bigint as seq, round(filled, 6) as filled from i")
def interp_gaps(spark, sf):
    return series.interpolate(event_series(spark, sf, "user_id"), (F.col("seq") % 7 != 3) & (F.col("p") < 150)).select("subject", "seq", *_r("filled"))


@query(f"with {US}, k as (select *, case when seq % 4 <> 1 then p end as x from s) select subject, seq::bigint as seq, round({_fill('x')}, 6) as filled from k")
def bfill_ffill(spark, sf):
    return series.bfill_ffill(event_series(spark, sf, "user_id").withColumn("x", F.when(F.col("seq") % 4 != 1, F.col("p"))), "x").select("subject", "seq", *_r("filled"))


_GRID = f"{DT}, sp as (select s.subject, min(t) as t0, max(t) as t1, any_value(dt) as dt from s join dt on s.subject = dt.subject group by 1), g as (select subject, k, t0 + k * dt as t from (select *, unnest(range(0, floor((t1 - t0) / dt + 1e-9)::bigint + 1)) as k from sp))"


@query(f"with {US}, {_GRID}, j as (select g.subject, g.k, g.t, a.t as lt, a.p as lp from g asof join s a on g.subject = a.subject and g.t >= a.t), j2 as (select j.*, b.t as rt, b.p as rp from j asof left join s b on j.subject = b.subject and j.t <= b.t) select subject, k::bigint as k, round(t, 3) as t, round(case when rt is null or rt = lt then lp else lp + (t - lt) / (rt - lt) * (rp - lp) end, 5) as p from j2")
def uniform_resample(spark, sf):
    return series.resample(event_series(spark, sf, "user_id")).select("subject", "k", *_r("t", n=3), *_r("p", n=5))


@query(f"with {US}, {_GRID}, {_FLAG}, {_RUNS}, rt as (select subject, min(t) - 1000 as a, max(t) + 1000 as b from r where flag group by subject, run) select g.subject, g.k::bigint as k, exists (select 1 from rt where rt.subject = g.subject and g.t between rt.a and rt.b) as inside from g")
def project_mask(spark, sf):
    df = _flagged(spark, sf, "user_id")
    return series.project_mask(df, "flag", series.resample(df), 1000.0).select("subject", "k", "inside")


def _parabola(first: str, weights: tuple[int, ...]) -> str:
    """Weighted sum of five samples in a row, of which ``first`` is the place of the first from the current one."""
    at = lambda k: f"lead(p, {k}) over ({W})" if k > 0 else f"lag(p, {-k}) over ({W})" if k < 0 else "p"
    return "(" + " + ".join(f"{w}e0 * {at(first + i)}" for i, w in enumerate(weights)) + ") / 35"


@query(f"""with {EV}, n as (select *, count(*) over (partition by subject) as n from s) select subject, seq::bigint as seq, round(case when n < 5 then p when seq = 0 then {_parabola(0, (31, 9, -3, -5, 3))} when seq = 1 then {_parabola(-1, (9, 13, 12, 6, -5))}
when seq = n - 1 then {_parabola(-4, (3, -5, -3, 9, 31))} when seq = n - 2 then {_parabola(-3, (-5, 6, 12, 13, 9))} else {_parabola(-2, (-3, 12, 17, 12, -3))} end, 6) as smooth from n""")
def savgol(spark, sf):
    return series.savgol(event_series(spark, sf), 5).select("subject", "seq", *_r("smooth"))


# ------------------------------------------------------------------ denoising

_GATE = f"o as (select *, p < 5 or p > 150 as flag from s), {_interp('o', 'not flag', 'gated', 'q')}, qr as (select q.*, row_number() over ({W}) - row_number() over (partition by subject, flag order by seq) as run from q), qs as (select qr.*, dt, min(t) over (partition by qr.subject, flag, run) as ta, max(t) over (partition by qr.subject, flag, run) as tb, min(seq) over (partition by qr.subject, flag, run) as sa, max(seq) over (partition by qr.subject, flag, run) as sb, max(seq) over (partition by qr.subject) as n from qr join dt on qr.subject = dt.subject)"


@query(f"with {US}, {DT}, {_GATE} select subject, seq::bigint as seq, flag as out_of_range, round(gated, 6) as gated, flag and (tb - ta + dt > 20000 or sa = 0 or sb = n) as low_confidence from qs")
def hard_range_gate(spark, sf):
    return denoise.range_gate(event_series(spark, sf, "user_id"), 5.0, 150.0, 20000.0).select("subject", "seq", "out_of_range", *_r("gated"), "low_confidence")


@query(f"with {EV}, {_noise('s')} select subject, seq::bigint as seq, round(s_dp, 6) as s_dp, round(s_ddp, 6) as s_ddp, round(s_p, 6) as s_p from noise")
def local_noise(spark, sf):
    return denoise.local_noise(event_series(spark, sf)).select("subject", "seq", *_r("s_dp", "s_ddp", "s_p"))


_BASE = f"{_median('s', 'p', 25, 'baseline', 'b')}, br as (select *, p - baseline as residual from b), {_noise('br')}"
_EVENTS = f"""hot as (select *, residual > 1 * s_p as flag from noise), hr as (select *, row_number() over ({W}) - row_number() over (partition by subject, flag order by seq) as run from hot),
hg as (select *, count(*) over (partition by subject, flag, run) as n_, min(seq) over (partition by subject, flag, run) as a_, max(seq) over (partition by subject, flag, run) as b_, max(seq) over (partition by subject) as hi_ from hr),
hf as (select * exclude (run), flag or (a_ > 0 and b_ < hi_ and n_ <= 1) as filled from hg),
hu as (select *, row_number() over ({W}) - row_number() over (partition by subject, filled order by seq) as run, greatest(residual, 0) as up from hf),
hp as (select *, (up + lag(up) over (partition by subject, run order by seq)) / 2 * (t - lag(t) over (partition by subject, run order by seq)) as part from hu where filled),
ev as (select subject, min(seq) as a, max(seq) + 1 as b, min(t) as ta, max(t) as tb, count(*) as n, max(residual) as peak, coalesce(sum(part), 0) as area, quantile_cont(s_p, 0.5) as noise from hp group by subject, run),
evs as (select * from ev where n >= 2 and peak > 1 * noise and area > 0.5e0 * noise * (tb - ta))"""


@query(f'with {EV}, {_BASE}, {_EVENTS} select subject, a::bigint as start, b::bigint as "end", round(ta, 6) as t_start, round(tb, 6) as t_end, n, round(peak, 6) as peak, round(area, 4) as area from evs')
def physio_events(spark, sf):
    return _events(spark, sf).select("subject", "start", "end", *_r("t_start", "t_end"), "n", *_r("peak"), *_r("area", n=4))


#: Limits for series whose noise is as large as their values.
_LOW = denoise.Limits(amp=1.0, slope=1.0, curve=1.0)


def _estimated(spark, sf):
    return denoise.baseline_and_noise(event_series(spark, sf), 25, 17)


def _events(spark, sf):
    return denoise.events(_estimated(spark, sf), 2, 1.0, 0.5, 1)


_BRIDGE = f"lag(p) over ({W}) + (lead(p) over ({W}) - lag(p) over ({W})) * (t - lag(t) over ({W})) / nullif(lead(t) over ({W}) - lag(t) over ({W}), 0)"


@query(f"""with {EV}, {_noise('s')}, x as (select *, p - lag(p) over ({W}) as l, lead(p) over ({W}) - p as r, abs(lag(p) over ({W}) - lead(p) over ({W})) as gap, {_BRIDGE} as br, quantile_cont(s_p, 0.5) over ({W} rows between 2 preceding and 2 following) as near from noise)
select subject, seq::bigint as seq from x where l * r < 0 and abs(p - br) > greatest(1 * s_p, 3) and abs(l) > greatest(1 * s_dp, 3) and abs(r) > greatest(1 * s_dp, 3) and gap <= 4 * near + 3""")
def isolated_spikes(spark, sf):
    return denoise.isolated_spikes(_estimated(spark, sf), k=_LOW).where("spike").select("subject", "seq")


@query(f"""with {EV}, {_noise('s')}, x as (select *, {_BRIDGE} as br from noise) select subject, seq::bigint as seq from x where abs(ddp) > greatest(1 * s_ddp, 3) and abs(p - br) > greatest(1 * s_p, 3)""")
def curvature_spikes(spark, sf):
    return denoise.curvature_spikes(_estimated(spark, sf), k=_LOW).where("curved").select("subject", "seq")


@query(f"""with {EV}, {DT}, {_BASE}, x as (select *, greatest(1 * s_p, 3) as amp, abs(residual) > greatest(1 * s_p, 3) as flag, lag(p) over ({W}) as l, lead(p) over ({W}) as r from noise),
y as (select *, row_number() over ({W}) - row_number() over (partition by subject, flag order by seq) as run from x),
z as (select subject, min(seq) as a, max(seq) + 1 as b, count(*) as n, arg_min_null(l, seq) as l, arg_max_null(r, seq) as r, max(abs(residual)) as peak, quantile_cont(s_p, 0.5) as noise, quantile_cont(amp, 0.5) as amp, max(t) - min(t) as span from y where flag group by subject, run)
select z.subject, a::bigint as start, b::bigint as "end", round(peak, 6) as peak from z join dt on z.subject = dt.subject where n <= 4 and span <= 2000 and abs(l - r) <= 4 * noise + 3 and peak > amp""")
def short_pulses(spark, sf):
    return denoise.short_pulses(_estimated(spark, sf), 4, 2000.0, k=_LOW).select("subject", "start", "end", *_r("peak"))


@query(f"""with {EV}, {_noise('s')}, x as (select *, lead(p) over ({W}) - p as d, lead(p) over ({W}) as p1, lead(t) over ({W}) as t1, greatest(1 * s_p, 3) as amp, greatest(greatest(1 * s_dp, 3), lead(greatest(1 * s_dp, 3)) over ({W})) as lim from noise),
e as (select * from x where abs(d) > lim), f as (select a.subject, a.seq as i, min(b.seq) as j from e a join e b on a.subject = b.subject and b.seq > a.seq and b.seq <= a.seq + 5 and a.d * b.d < 0 group by 1, 2),
g as (select f.subject, f.i, f.j, a.p as pa, a.t as ta, b.p1 as pb, b.t1 as tb from f join x a on f.subject = a.subject and f.i = a.seq join x b on f.subject = b.subject and f.j = b.seq),
h as (select g.subject, i, j, max(abs(x.p - (pa + (pb - pa) * (x.t - ta) / nullif(tb - ta, 0)))) as off, quantile_cont(x.amp, 0.5) as lim from g join x on x.subject = g.subject and x.seq > i and x.seq <= j group by 1, 2, 3)
select subject, (i + 1)::bigint as start, (j + 1)::bigint as "end" from h where off > lim""")
def reverse_edges(spark, sf):
    return denoise.reverse_edges(_estimated(spark, sf), k=_LOW).select("subject", "start", "end")


_STEPPED = "st as (select subject, seq, t, floor(p / 40) * 40 as p from s)"


@query(f"""with {EV}, {_STEPPED}, {_noise('st')}, x as (select *, coalesce(abs(p - lag(p) over ({W})) <= 1e-6, true) as flag, abs(p - lag(p) over ({W})) as l, abs(lead(p) over ({W}) - p) as r from noise),
y as (select *, row_number() over ({W}) - row_number() over (partition by subject, flag order by seq) as run, lag(l) over ({W}) as l0 from x),
z as (select subject, min(seq) as a, max(seq) + 1 as b, count(*) as n, arg_min_null(l0, seq) as l, arg_max_null(r, seq) as r, quantile_cont(s_p, 0.5) as noise from y where flag group by subject, run)
select subject, a::bigint as start, b::bigint as "end" from z where n >= 4 and (coalesce(l, 0) > noise or coalesce(r, 0) > noise)""")
def flatlines(spark, sf):
    df = event_series(spark, sf).withColumn("p", F.floor(F.col("p") / 40).cast("double") * 40)
    return denoise.flatlines(denoise.local_noise(df), 4, k=_LOW).select("subject", "start", "end")


@query(f"""with {US}, {DT}, {DIFF}, m as (select subject, 1.4826e0 * mad(dp) as a, 1.4826e0 * mad(p) as b, avg((p < 5 or p > 150)::int) as o from d group by 1),
k as (select m.subject, least(greatest(0.65e0 * a / (b + 1e-9) + 3 * o, 0), 1) as badness, dt from m join dt on m.subject = dt.subject)
select subject, round(badness, 6) as badness, round(6.5e0 - badness, 6) as amp_k, round(3 + 0.8e0 * badness, 6) as event_amp_k, round(1.5e0 + 0.5e0 * badness, 6) as event_area_k, round(greatest(3 * dt, 4.8e0 + 3 * badness), 6) as smooth_s, round(greatest(10 * dt, 20 + 10 * badness), 6) as noise_s from k""")
def adaptive_params(spark, sf):
    out = denoise.adaptive_parameters(event_series(spark, sf, "user_id"), 5.0, 150.0)
    return out.select("subject", *_r("badness", "amp_k", "event_amp_k", "event_area_k", "smooth_s", "noise_s"))


@query()
def denoise_full(spark, sf):
    return denoise.denoise(event_series(spark, sf), 5.0, 300.0).select("subject", "seq", *_r("clean", "preclean", "baseline", "residual", "noise"), "out_of_range", "artifact", "event", "quality_flag")


_WIDE = f"{DT}, bw as (select s.*, dt, greatest(round_even(40000e0 / dt, 0)::int, 9) as n0 from s join dt on dt.subject = s.subject), sw as (select * exclude (n0), n0 + (n0 % 2 = 0)::int as width, (n0 + (n0 % 2 = 0)::int) // 2 as h from bw)"


@query(f"""with {US}, {_WIDE}, m0 as (select *, case when count(*) over w >= greatest(3, width // 3) then quantile_cont(p, 0.5) over w end as m_ from sw window w as (partition by subject order by seq rows between h preceding and h following))
select subject, seq::bigint as seq, width, round({_fill('m_')}, 6) as median from m0""")
def median_by_width(spark, sf):
    """Rolling median whose width in seconds is each subject's own number of samples."""
    df = event_series(spark, sf, "user_id")
    wide = df.join(series.sampling_interval(df), "subject").withColumn("width", series.samples(40000.0, F.col("dt"), 9))
    return series.rolling_median(wide, "width").select("subject", "seq", "width", *_r("median"))


def _channels(spark, sf):
    """Series of users with a sparse channel, a dense one, and a mask."""
    e = table(spark, sf, "events")
    order = Window.partitionBy("subject").orderBy("ts", "event_id")
    rows = e.select(F.col("user_id").alias("subject"), "event_id", "ts", seconds("ts").alias("t"), finite("value").alias("p"), F.when(F.col("event_type") == "click", finite("value")).alias("ph"), (F.col("event_id") % 97).cast("double").alias("temperature"))
    return rows.withColumn("seq", (F.row_number().over(order) - 1).cast("long")).drop("event_id", "ts").withColumn("flag", F.col("p") > 60)


_CH = f"s as (select user_id as subject, row_number() over (partition by user_id order by ts, event_id) - 1 as seq, epoch(ts) as t, value as p, case when event_type = 'click' then value end as ph, (event_id % 97)::double as temperature, value > 60 as flag from events)"
_ON_GRID = "{c}0 as (select g.subject, g.k, g.t, a.t as lt, a.{c} as ly from g asof left join (select * from {s} where {c} is not null) a on g.subject = a.subject and g.t >= a.t), {c}g as (select l.subject, l.k, case when lt is null or rt is null or rt = lt then coalesce(ly, ry) else ly + (l.t - lt) / (rt - lt) * (ry - ly) end as {c} from (select l.*, b.t as rt, b.{c} as ry from {c}0 l asof left join (select * from {s} where {c} is not null) b on l.subject = b.subject and l.t <= b.t) l)"


@query(f"""with {_CH}, {_GRID}, {_interp('s', 'ph is not null', 'ph_', 'i', 'ph').replace("then t end", "then seq end").replace("(t - lt)", "(seq - lt)")}, f as (select * exclude (ph, ph_), ph_ as ph from i),
{", ".join(_ON_GRID.format(c=c, s="f") for c in ("p", "ph", "temperature"))}, f2 as (select subject, seq, t, flag from f), {_RUNS.replace("from f)", "from f2)")}, rt as (select r.subject, min(t) - any_value(dt) / 2 as a, max(t) + any_value(dt) / 2 as b from r join dt on dt.subject = r.subject where flag group by r.subject, run)
select pg.subject, pg.k::bigint as k, round(p, 5) as p, round(ph, 5) as ph, round(temperature, 5) as temperature, exists (select 1 from rt join g on g.subject = rt.subject and g.k = pg.k where rt.subject = pg.subject and g.t between rt.a and rt.b) as flag
from pg join phg on phg.subject = pg.subject and phg.k = pg.k join temperatureg tg on tg.subject = pg.subject and tg.k = pg.k""")
def uniform_channels(spark, sf):
    """Pressure, carried channels and a mask on each subject's uniform grid; gaps in a channel are filled by position."""
    df = _channels(spark, sf)
    df = series.interpolate(df, F.col("ph").isNotNull(), x="seq", y="ph", out="ph")
    return series.uniform(df, ("p", "ph", "temperature"), ("flag",)).select("subject", "k", *_r("p", "ph", "temperature", n=5), "flag")


@query()
def denoise_uniform(spark, sf):
    """The whole chain on uniform grids, with widths and limits of each subject's own."""
    df = _channels(spark, sf).drop("flag")
    found = denoise.denoise_uniform(df, 5.0, 150.0, parameters=denoise.adaptive_parameters(df.select("subject", "seq", "t", "p"), 5.0, 150.0))
    real = ("ph", "temperature", "raw", "range_fixed", "preclean", "clean", "baseline", "residual", "noise")
    return found.select("subject", "k", *_r("t", n=3), *_r(*real, n=5), "out_of_range", "artifact", "event", "quality_flag")


# ------------------------------------------------------------------ windows

_FIXED = "c as (select subject, count(*) as n from s group by 1), w as (select subject, unnest(range(0, n - 48 + 1, 32)) as a, n from c where n >= 48), wr as (select w.subject, w.a // 32 as window_id, s.* exclude (subject) from w join s on s.subject = w.subject and s.seq >= a and s.seq < a + 64)"


@query(f"with {EV}, {_FIXED} select subject, window_id::bigint as window_id, min(seq)::bigint as start_idx, (max(seq) + 1)::bigint as end_idx, round(min(t), 6) as start_time, round(max(t), 6) as end_time, round((min(t) + max(t)) / 2, 3) as center_time, count(*) as num_points, round(avg((p > 60)::int), 6) as event_coverage from wr group by 1, 2")
def fixed_windows(spark, sf):
    out = windows.fixed_windows(event_series(spark, sf), 64, 32, 48, F.col("p") > 60)
    return out.select("subject", "window_id", "start_idx", "end_idx", *_r("start_time", "end_time"), *_r("center_time", n=3), "num_points", *_r("event_coverage"))


_SPANS = f"""{_FLAG}, {_RUNS}, rt as (select subject, min(t) as ta, max(t) as tb, count(*) as n, min(seq) as a from r where flag group by subject, run),
ei as (select *, row_number() over (partition by subject order by a) as event_id from rt where n >= 4)"""


@query(f"""with {EV}, {_SPANS}, w as (select *, (ta + tb) / 2 as mid from ei), j as (select w.subject, event_id, ta, tb, mid, min(f.seq) as a, max(f.seq) + 1 as b, avg(f.flag::int) as cov from w join f on f.subject = w.subject and f.t between mid - 7200 and mid + 7200 group by all)
select subject, (row_number() over (partition by subject order by event_id) - 1)::bigint as window_id, a::bigint as start_idx, b::bigint as end_idx, round(mid, 3) as center_time, event_id::bigint as event_id, (b - a)::bigint as num_points, round(cov, 6) as event_coverage from j where b - a >= 16""")
def event_windows(spark, sf):
    out = windows.event_windows(_flagged(spark, sf), "flag", 7200, 7200, 4, 16)
    return out.select("subject", "window_id", "start_idx", "end_idx", *_r("center_time", n=3), "event_id", "num_points", *_r("event_coverage"))


@query(f"""with {EV}, {_SPANS}, w as (select *, (ta + tb) / 2 - 7200 as lo, (ta + tb) / 2 + 7200 as hi from ei), x as (select *, case when lo > max(hi) over (partition by subject order by lo, event_id rows between unbounded preceding and 1 preceding) or row_number() over (partition by subject order by lo, event_id) = 1 then 1 else 0 end as new from w),
y as (select *, sum(new) over (partition by subject order by lo, event_id rows unbounded preceding) as g from x), z as (select subject, min(event_id) as event_id, min(ta) as ta, max(tb) as tb, min(lo) as lo, max(hi) as hi from y group by subject, g),
j as (select z.subject, event_id, ta, tb, min(f.seq) as a, max(f.seq) + 1 as b, avg(f.flag::int) as cov from z join f on f.subject = z.subject and f.t between lo and hi group by all)
select subject, (row_number() over (partition by subject order by event_id) - 1)::bigint as window_id, a::bigint as start_idx, b::bigint as end_idx, round((ta + tb) / 2, 3) as center_time, event_id::bigint as event_id, (b - a)::bigint as num_points, round(cov, 6) as event_coverage from j where b - a >= 16""")
def event_windows_merged(spark, sf):
    out = windows.event_windows(_flagged(spark, sf), "flag", 7200, 7200, 4, 16, merge=True)
    return out.select("subject", "window_id", "start_idx", "end_idx", *_r("center_time", n=3), "event_id", "num_points", *_r("event_coverage"))


@query(f"with {EV}, {_FIXED} select subject, window_id::bigint as window_id, round(avg(p), 9) as mean, count(*) as n from wr group by 1, 2")
def window_rows(spark, sf):
    df = event_series(spark, sf)
    rows = windows.window_rows(df, windows.fixed_windows(df, 64, 32, 48))
    return rows.groupBy("subject", "window_id").agg(F.avg("p").alias("mean"), F.count(F.lit(1)).alias("n")).select("subject", "window_id", *_r("mean", n=9), "n")


# ------------------------------------------------------------------ nonlinear features

_ACF = f"st as (select subject, avg(p) as m, var_pop(p) as v, count(*) as n from s group by 1), c as (select s.subject, seq, p - m as c, v, n from s join st on s.subject = st.subject), acf as (select a.subject, b.seq - a.seq as lag, sum(a.c * b.c) / ((any_value(a.n) - (b.seq - a.seq)) * any_value(a.v)) as acf from c a join c b on a.subject = b.subject and b.seq - a.seq between 0 and 10 group by 1, 2)"


@query(f"with {EM}, {_ACF} select subject, lag::bigint as lag, round(acf, 6) as acf from acf")
def autocorrelation(spark, sf):
    return nonlinear.autocorrelation(vector_series(spark, sf)).select("subject", F.col("lag").cast("long").alias("lag"), *_r("acf"))


@query(f"with {EM}, {_ACF}, k as (select *, acf < lag(acf) over (partition by subject order by lag) and acf < lead(acf) over (partition by subject order by lag) as low from acf) select subject, coalesce(min(case when acf <= exp(-1) then lag end), min(case when low then lag end), 1)::bigint as tau from k where lag >= 1 group by 1")
def tau_autocorr(spark, sf):
    return nonlinear.tau_from_autocorrelation(nonlinear.autocorrelation(vector_series(spark, sf)))


_AMI = f"""q as (select subject, least(greatest(case when 2 * (quantile_cont(p, 0.75) - quantile_cont(p, 0.25)) / (count(*) ** (1e0 / 3) + 1e-12) <= 1e-12 then floor(sqrt(count(*))) else ceil((max(p) - min(p)) / (2 * (quantile_cont(p, 0.75) - quantile_cont(p, 0.25)) / (count(*) ** (1e0 / 3) + 1e-12))) end, 8), 64)::int as bins from s group by 1),
r as (select a.subject, b.seq - a.seq as lag, a.p as x, b.p as y from s a join s b on a.subject = b.subject and b.seq - a.seq between 1 and {{MOST}}),
e as (select subject, lag, min(x) as xl, max(x) as xh, min(y) as yl, max(y) as yh, count(*) as n from r group by 1, 2),
b as (select r.subject, r.lag, n, least(floor((x - xl) / (xh - xl) * bins), bins - 1)::int as bx, least(floor((y - yl) / (yh - yl) * bins), bins - 1)::int as by_ from r join e on r.subject = e.subject and r.lag = e.lag join q on q.subject = r.subject),
h1 as (select subject, lag, -sum(c / n * ln(c / n + 1e-12)) as h from (select subject, lag, n::double as n, bx, count(*) as c from b group by all) group by 1, 2),
h2 as (select subject, lag, -sum(c / n * ln(c / n + 1e-12)) as h from (select subject, lag, n::double as n, by_, count(*) as c from b group by all) group by 1, 2),
h12 as (select subject, lag, -sum(c / n * ln(c / n + 1e-12)) as h from (select subject, lag, n::double as n, bx, by_, count(*) as c from b group by all) group by 1, 2)
select h1.subject, h1.lag::bigint as lag, round(h1.h + h2.h - h12.h, 6) as ami from h1 join h2 on h1.subject = h2.subject and h1.lag = h2.lag join h12 on h1.subject = h12.subject and h1.lag = h12.lag"""


_AMI5, _AMI6 = _AMI.replace("{MOST}", "5"), _AMI.replace("{MOST}", "6")


@query(f"with {EM}, {_AMI5}")
def mutual_information(spark, sf):
    return nonlinear.mutual_information(vector_series(spark, sf)).select("subject", F.col("lag").cast("long").alias("lag"), *_r("ami"))


def _tau_sql(ami: str, most: int) -> str:
    """Delays tau: first local minimum of the mutual information, else by the autocorrelation up to lag ``most``."""
    low = lambda c: f"{c} < lag({c}) over (partition by subject order by lag) and {c} < lead({c}) over (partition by subject order by lag)"
    at = ami.rindex("select h1.subject")
    return f"""{_ACF}, ta as (select subject, coalesce(min(case when acf <= exp(-1) then lag end), min(case when low then lag end), 1) as tau from (select *, {low('acf')} as low from acf where lag <= {most}) where lag >= 1 group by 1),
    {ami[:at]}, mi as ({ami[at:].replace("round(", "(").replace(", 6) as ami", ") as ami")}), tm as (select subject, min(case when low then lag end) as a, count(*) as n from (select *, {low('ami')} as low from mi) group by 1),
    tau as (select ta.subject, coalesce(case when tm.n >= 5 then a end, ta.tau)::bigint as tau from ta left join tm on tm.subject = ta.subject)"""


@query(f"with {EM}, {_tau_sql(_AMI5, 10)} select subject, tau from tau")
def tau_ami(spark, sf):
    s = vector_series(spark, sf)
    return nonlinear.tau_from_mutual_information(nonlinear.mutual_information(s), nonlinear.tau_from_autocorrelation(nonlinear.autocorrelation(s)))


def _fnn_sql(m: int) -> str:
    d = lambda k: " + ".join(f"(a.x{i} - b.x{i}) ** 2" for i in range(k))
    return f"""nd{m} as (select a.subject, a.i, b.i as j, a.tau, sqrt({d(m)}) as d from v a join v b on a.subject = b.subject where a.x{m} is not null and b.x{m} is not null),
    nr{m} as (select *, row_number() over (partition by subject, i order by d, abs(i - j), j) as r from nd{m}), nb{m} as (select * from (select *, row_number() over (partition by subject, i order by r) as q from nr{m} where r <= 20 and abs(i - j) > tau) where q = 1),
    fn{m} as (select n.subject, {m} as m, avg((abs(a.x{m} - b.x{m}) / greatest(n.d, 1e-12) > 10 or sqrt({d(m + 1)}) / sigma > 2)::int) as fnn from nb{m} n join v a on a.subject = n.subject and a.i = n.i join v b on b.subject = n.subject and b.i = n.j join g on g.subject = n.subject group by 1)"""


@query(f"""with {EM}, {_tau_sql(_AMI6, 6)}, g as (select subject, stddev_pop(p) + 1e-12 as sigma from s group by 1),
v as (select a.subject, a.seq as i, tau.tau, a.p as x0, b.p as x1, c.p as x2, d.p as x3 from s a join tau on tau.subject = a.subject left join s b on b.subject = a.subject and b.seq = a.seq + tau.tau left join s c on c.subject = a.subject and c.seq = a.seq + 2 * tau.tau left join s d on d.subject = a.subject and d.seq = a.seq + 3 * tau.tau),
{", ".join(map(_fnn_sql, (1, 2, 3)))}, fn as (select * from fn1 union all select * from fn2 union all select * from fn3)
select tau.subject, tau, (select coalesce(min(case when fnn <= 0.05e0 then m end), arg_min(m, fnn * 10 + m * 1e-9), 3) from fn where fn.subject = tau.subject)::bigint as m from tau""")
def embedding_parameters(spark, sf):
    return nonlinear.embedding_parameters(vector_series(spark, sf), most_dim=3, least=32)


def _embedded(m: int, tau: int = 1) -> str:
    cols = ", ".join(["p as x0"] + [f"lead(p, {k * tau}) over ({W}) as x{k}" for k in range(1, m)])
    return f"v as (select * from (select subject, seq as i, {cols} from s) where x{m - 1} is not null)"


@query(f"with {EM}, {_embedded(3, 2)} select subject, i::bigint as i, round(x0, 6) as x0, round(x1, 6) as x1, round(x2, 6) as x2 from v")
def delay_embedding(spark, sf):
    v = nonlinear.embed(vector_series(spark, sf), 3, 2)
    return v.select("subject", "i", *[F.round(F.col("x")[k], 6).alias(f"x{k}") for k in range(3)])


@query(f"with {EM}, {_embedded(3)}, c as (select subject, count(*) as c from v group by subject, x0 <= x1, x0 <= x2, x1 <= x2), q as (select subject, c / sum(c) over (partition by subject) as q from c) select subject, round(-sum(q * ln(q + 1e-12)) / ln(6), 6) as permen from q group by 1")
def permutation_entropy(spark, sf):
    return nonlinear.permutation_entropy(vector_series(spark, sf)).select("subject", *_r("permen"))


@query(f"""with {EM}, st as (select subject, 0.2e0 * stddev_pop(p) as r, count(*) as n from s group by 1), v as (select * from (select subject, seq as i, p as x0, lead(p) over ({W}) as x1, lead(p, 2) over ({W}) as x2 from s) where x1 is not null),
c as (select a.subject, sum((abs(a.x0 - b.x0) <= r and abs(a.x1 - b.x1) <= r)::int)::double as b, sum((abs(a.x0 - b.x0) <= r and abs(a.x1 - b.x1) <= r and coalesce(abs(a.x2 - b.x2) <= r, false))::int)::double as a, any_value(r) as r, any_value(n)::double as n from v a join v b on a.subject = b.subject and a.i < b.i join st on st.subject = a.subject group by 1)
select subject, round(case when r <= 1e-12 then 0 else -ln((a / ((n - 2) * (n - 3) / 2)) / nullif(b / ((n - 1) * (n - 2) / 2), 0) + 1e-12) end, 6) as sampen from c""")
def sample_entropy(spark, sf):
    return nonlinear.sample_entropy(vector_series(spark, sf)).select("subject", *_r("sampen"))


_REC = f"""{_embedded(3)}, d as (select a.subject, a.i, b.i as j, sqrt((a.x0 - b.x0) ** 2 + (a.x1 - b.x1) ** 2 + (a.x2 - b.x2) ** 2) as d from v a join v b on a.subject = b.subject and abs(a.i - b.i) > 1),
ep as (select subject, quantile_cont(d, 0.05) as epsilon from d group by 1), nn as (select subject, count(*) as n from v group by 1), r as (select d.subject, i, j, epsilon, n from d join ep on d.subject = ep.subject join nn on d.subject = nn.subject where d <= epsilon)"""
_RQA = f"""with {EM}, {_REC}, tot as (select subject, count(*) as r, any_value(n) as n, any_value(epsilon) as epsilon from r group by 1),
dl as (select subject, count(*) as len from (select subject, j - i as line, i - row_number() over (partition by subject, j - i order by i) as run from r) group by subject, line, run having count(*) >= 2),
vl as (select subject, count(*) as len from (select subject, j as line, i - row_number() over (partition by subject, j order by i) as run from r) group by subject, line, run having count(*) >= 2),
ds as (select subject, sum(len) as s, avg(len) as m, max(len) as x from dl group by 1), vs as (select subject, sum(len) as s, avg(len) as m from vl group by 1)
select tot.subject, round(r / (n * n - n + 1e-12), 6) as rr, round(coalesce(ds.s, 0) / (r + 1e-12), 6) as det, round(coalesce(vs.s, 0) / (r + 1e-12), 6) as lam, round(ds.m, 6) as l_mean, ds.x::bigint as l_max, round(vs.m, 6) as tt, round(epsilon, 6) as epsilon from tot left join ds on tot.subject = ds.subject left join vs on tot.subject = vs.subject"""


@query(_RQA)
def recurrence_quantification(spark, sf):
    out = nonlinear.recurrence_measures(vector_series(spark, sf))
    return out.select("subject", *_r("rr", "det", "lam", "l_mean"), F.col("l_max").cast("long").alias("l_max"), *_r("tt", "epsilon"))


@query(f"with {EM}, {_REC} select subject, count(*) as edges, sum(abs(i - j))::bigint as spread from r group by 1")
def recurrence_edges(spark, sf):
    return nonlinear.recurrence(vector_series(spark, sf)).groupBy("subject").agg(F.count(F.lit(1)).alias("edges"), F.sum(F.abs(F.col("i") - F.col("j"))).cast("long").alias("spread"))


@query(f"""with {EM}, {_embedded(2)}, m as (select subject, avg(x0) as mx, avg(x1) as my from v group by 1), t as (select v.subject, i, x0, x1, mx, my, sqrt((x0 - lag(x0) over (partition by v.subject order by i)) ** 2 + (x1 - lag(x1) over (partition by v.subject order by i)) ** 2) as step from v join m on v.subject = m.subject),
g as (select subject, sum(step) as tl, avg(step) as ms, stddev_pop(step) as ss, avg(sqrt((x0 - mx) ** 2 + (x1 - my) ** 2)) as sp, var_samp(x0) as a, var_samp(x1) as d, covar_samp(x0, x1) as b from t group by 1),
e as (select *, greatest((a + d) / 2 + sqrt(((a - d) / 2) ** 2 + b ** 2), 1e-12) as e1, greatest((a + d) / 2 - sqrt(((a - d) / 2) ** 2 + b ** 2), 1e-12) as e2 from g)
select subject, round(tl, 6) as trajectory_length, round(ms, 6) as mean_step, round(ss, 6) as step_std, round(sp, 6) as state_spread, round(e1, 6) as eig1, round(e2, 6) as eig2, round(e1 / (e2 + 1e-12), 4) as eig_ratio, round(ln(e1) + ln(e2), 6) as log_volume from e""")
def trajectory_geometry(spark, sf):
    out = nonlinear.geometry(vector_series(spark, sf))
    return out.select("subject", *_r("trajectory_length", "mean_step", "step_std", "state_spread", "eig1", "eig2"), *_r("eig_ratio", n=4), *_r("log_volume"))


@query(f"""with {EM}, k as (select unnest(range(1, 11)) as k), d as (select a.subject, k, b.seq % k as m, abs(b.p - a.p) as d from s a join k on true join s b on a.subject = b.subject and b.seq = a.seq + k),
n as (select subject, count(*) as n from s group by 1), l as (select d.subject, k, m, sum(d) * ((any_value(n) - 1) / ((count(*) + 1) * k)) / k as l, count(*) as c from d join n on d.subject = n.subject group by 1, 2, 3),
g as (select subject, k, avg(l) as l from l group by 1, 2) select subject, round(regr_slope(ln(l), ln(1e0 / k)), 6) as hfd from g where l > 0 group by 1""")
def higuchi_fd(spark, sf):
    return nonlinear.higuchi(vector_series(spark, sf)).select("subject", *_r("hfd"))


@query(f"""with {EM}, d as (select *, p - lag(p) over ({W}) as d, abs(p - first_value(p) over ({W} rows unbounded preceding)) as far from s), t as (select *, d * lag(d) over ({W}) < 0 as turn from d),
g as (select subject, sum(abs(d)) as l, max(far) as far, count(*) as n, sum(turn::int) as turns from t group by 1)
select subject, round(case when l > 1e-12 and far > 1e-12 then log10(n) / (log10(far / l) + log10(n)) end, 6) as kfd, round(case when turns = 0 then 1 else log10(n) / (log10(n) + log10(n / (n + 0.4e0 * turns))) end, 6) as pfd from g""")
def katz_petrosian_fd(spark, sf):
    return nonlinear.fractals(vector_series(spark, sf)).select("subject", *_r("kfd", "pfd"))


@query(f"""with {EM}, d as (select *, p - lag(p) over ({W}) as d from s)
select subject, round(avg(p), 6) as mean, round(stddev_pop(p), 6) as std, round(median(p), 6) as median, round(quantile_cont(p, 0.75) - quantile_cont(p, 0.25), 6) as iqr, round(min(p), 6) as min, round(max(p), 6) as max, round(max(p) - min(p), 6) as range, round(skewness(p), 6) as skewness, round(kurtosis(p) + 3, 6) as kurtosis, round(1.4826e0 * mad(d), 6) as diff_mad, round(sum(d * d), 6) as diff_energy from d group by 1""")
def basic_time_features(spark, sf):
    out = nonlinear.basic(vector_series(spark, sf))
    return out.select("subject", *_r(*[c for c in out.columns if c != "subject"]))


def _nearest(m: int, theiler: int, cap: int) -> str:
    d = " + ".join(f"(a.x{k} - b.x{k}) ** 2" for k in range(m))
    return f"""nd as (select a.subject, a.i, b.i as j, sqrt({d}) as d from vm a join vm b on a.subject = b.subject), nr as (select *, row_number() over (partition by subject, i order by d, abs(i - j), j) as r from nd),
nb as (select subject, i, j, d from (select *, row_number() over (partition by subject, i order by r) as q from nr where r <= {cap} and abs(i - j) > {theiler}) where q = 1)"""


@query(f"""with {EM}, {_embedded(3)}, vm as (select * from v), {_nearest(2, 1, 20)}, g as (select subject, stddev_pop(p) + 1e-12 as sigma from s group by 1)
select nb.subject, 2 as m, round(avg((abs(a.x2 - b.x2) / greatest(nb.d, 1e-12) > 2 or sqrt((a.x0 - b.x0) ** 2 + (a.x1 - b.x1) ** 2 + (a.x2 - b.x2) ** 2) / sigma > 1)::int), 6) as fnn
from nb join v a on a.subject = nb.subject and a.i = nb.i join v b on b.subject = nb.subject and b.i = nb.j join g on g.subject = nb.subject group by 1""")
def false_neighbours(spark, sf):
    return nonlinear.false_neighbours(vector_series(spark, sf), 2, 1, 2.0, 1.0).select("subject", "m", *_r("fnn"))


@query(f"""with {EM}, {_embedded(3)}, vm as (select * from v), {_nearest(3, 5, 30)}, n as (select subject, count(*) as n from v group by 1), k as (select unnest(range(0, 10)) as k),
f as (select nb.subject, k, ln(sqrt((a.x0 - b.x0) ** 2 + (a.x1 - b.x1) ** 2 + (a.x2 - b.x2) ** 2)) as y from nb join n on n.subject = nb.subject join k on true join v a on a.subject = nb.subject and a.i = nb.i + k join v b on b.subject = nb.subject and b.i = nb.j + k where nb.i + 10 < n and nb.j + 10 < n and sqrt((a.x0 - b.x0) ** 2 + (a.x1 - b.x1) ** 2 + (a.x2 - b.x2) ** 2) > 1e-12),
m as (select subject, k, avg(y) as y from f group by 1, 2 having count(*) >= 5) select subject, round(case when count(*) >= 3 then regr_slope(y, k) end, 6) as lle from m where k >= 1 and k < 6 group by 1""")
def lyapunov_slope(spark, sf):
    return nonlinear.divergence(vector_series(spark, sf)).select("subject", *_r("lle"))


#: Vectors as windows in robust z, each with the delay and dimension that it is estimated to have, and its delay vectors.
_OWN = f"""{EM.replace("s as", "es as", 1)}, zm as (select subject, median(p) as md, greatest(1.4826e0 * mad(p), 1e-9) as w from es group by 1), s as (select es.subject, seq, (p - md) / w as p from es join zm on zm.subject = es.subject),
{_tau_sql(_AMI6, 6)}, g as (select subject, stddev_pop(p) + 1e-12 as sigma from s group by 1),
v as (select a.subject, a.seq as i, tau.tau, a.p as x0, b.p as x1, c.p as x2, d.p as x3 from s a join tau on tau.subject = a.subject left join s b on b.subject = a.subject and b.seq = a.seq + tau.tau left join s c on c.subject = a.subject and c.seq = a.seq + 2 * tau.tau left join s d on d.subject = a.subject and d.seq = a.seq + 3 * tau.tau),
{", ".join(map(_fnn_sql, (1, 2, 3)))}, fn as (select * from fn1 union all select * from fn2 union all select * from fn3),
tm2 as (select tau.subject, tau, (select coalesce(min(case when fnn <= 0.05e0 then m end), arg_min(m, fnn * 10 + m * 1e-9), 3) from fn where fn.subject = tau.subject)::bigint as m from tau),
w as (select subject, list(p order by seq) as p from s group by 1), ev as (select subject, tau, m, i, [p[i + 1 + k * tau] for k in range(m)] as x from (select w.subject, p, tau, m, unnest(range(0, len(p) - (m - 1) * tau)) as i from w join tm2 on tm2.subject = w.subject)),
tr as (select subject, sum(step) as trajectory_length from (select subject, list_distance(x, lag(x) over (partition by subject order by i)) as step from ev) group by 1),
pe as (select subject, p[i + 1] as a, p[i + 1 + tau] as b, p[i + 1 + 2 * tau] as c from (select w.subject, p, tau, unnest(range(0, len(p) - 2 * tau)) as i from w join tm2 on tm2.subject = w.subject)),
pq as (select subject, c / sum(c) over (partition by subject) as q from (select subject, count(*) as c from pe group by subject, a <= b, a <= c, b <= c)), pn as (select subject, -sum(q * ln(q + 1e-12)) / ln(6) as permen from pq group by 1),
d as (select a.subject, a.i, b.i as j, a.tau, list_distance(a.x, b.x) as d from ev a join ev b on a.subject = b.subject),
ep as (select subject, quantile_cont(d, 0.05) as epsilon from d where abs(i - j) > tau group by 1), nn as (select subject, count(*) as n from ev group by 1), rc as (select d.subject, i, j, epsilon, n from d join ep on d.subject = ep.subject join nn on d.subject = nn.subject where d <= epsilon and abs(i - j) > tau)"""

_OWN_RQA = _RQA[_RQA.index("tot as (") :].replace("from r ", "from rc ").replace("from r)", "from rc)").replace("\nselect tot.subject", ",\nrq as (select tot.subject")


@query(f"""with {_OWN}, {_OWN_RQA}),
nr as (select *, row_number() over (partition by subject, i order by d, abs(i - j), j) as r from d), nb as (select subject, i, j from (select *, row_number() over (partition by subject, i order by r) as q from nr where r <= 30 and abs(i - j) > tau) where q = 1), k as (select unnest(range(1, 6)) as k),
f as (select nb.subject, k, ln(list_distance(a.x, b.x)) as y from nb join nn on nn.subject = nb.subject join k on true join ev a on a.subject = nb.subject and a.i = nb.i + k join ev b on b.subject = nb.subject and b.i = nb.j + k where nb.i + 10 < n and nb.j + 10 < n and list_distance(a.x, b.x) > 1e-12),
fm as (select subject, k, avg(y) as y from f group by 1, 2 having count(*) >= 5), ll as (select subject, round(case when count(*) >= 3 then regr_slope(y, k) end, 6) as lle from fm group by 1)
select tm2.subject, tau, m as dim, nn.n as vectors, round(permen, 6) as permen, round(trajectory_length, 6) as trajectory_length, rr, det, lam, l_mean, l_max, tt, epsilon, lle
from tm2 join nn on nn.subject = tm2.subject join pn on pn.subject = tm2.subject join tr on tr.subject = tm2.subject left join rq on rq.subject = tm2.subject left join ll on ll.subject = tm2.subject""")
def own_embedding_features(spark, sf):
    """Measures of windows that each have their own delay and dimension; every vector is a window."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("subject"), F.col("embedding").cast("array<double>").alias("x"))
    rows = reports.measured(vectors, least=32, most_dim=3).withColumn("_m", F.map_from_entries("measures"))
    of = lambda name: F.col("_m")[reports.NAMES[name]]
    whole = [of(c).cast("long").alias(c) for c in ("tau", "dim", "vectors", "l_max")]
    real = [F.round(of(c), 6).alias(c) for c in ("permen", "trajectory_length", "rr", "det", "lam", "l_mean", "tt", "epsilon", "lle")]
    return rows.select("subject", *whole, *real)


#: Windows of 300 samples every 100 as series of robust z, for the SQL of single measures.
_WINDOWS = f"""{EV.replace("s as", "es as", 1)}, wc as (select subject, count(*) as n from es group by 1), ws as (select subject, unnest(range(0, n - 256 + 1, 100)) as a from wc where n >= 256),
wr as (select es.subject || '#' || (a // 100) as subject, seq - a as seq, t, p from es join ws on ws.subject = es.subject and seq >= a and seq < a + 300),
wm as (select subject, median(p) as md, greatest(1.4826e0 * mad(p), 1e-9) as m from wr group by 1), s as (select wr.subject, seq, t, (p - md) / m as p from wr join wm on wm.subject = wr.subject)"""


def _of_windows(query: str, **columns: str) -> str:
    """Long rows of the columns of a vectors' query, over windows."""
    sql = _SQL[query].replace(EM, _WINDOWS)
    return " union all ".join(f"select subject, 'p_{name}' as feature, {c}::double as value from ({sql})" for c, name in columns.items())


_WINDOW_SQL = [
    _of_windows("sample_entropy", sampen="SampEn"), _of_windows("permutation_entropy", permen="PermEn"),
    _of_windows("recurrence_quantification", rr="RQA_RR", det="RQA_DET", lam="RQA_LAM", l_mean="RQA_L_mean", l_max="RQA_L_max", tt="RQA_TT", epsilon="RQA_epsilon"),
]


def _window_features(spark, sf):
    df = event_series(spark, sf)
    return reports.window_features(df, windows.fixed_windows(df, 300, 100, 256))


@query()
def window_feature_table(spark, sf):
    return _window_features(spark, sf).select("subject", "window_id", "feature", *_r("value", n=4))


@query(" union all ".join(_WINDOW_SQL))
def window_nonlinear(spark, sf):
    shown = ["SampEn", "PermEn", "RQA_RR", "RQA_DET", "RQA_LAM", "RQA_L_mean", "RQA_L_max", "RQA_TT", "RQA_epsilon"]
    rows = _window_features(spark, sf).where(F.col("feature").isin([f"p_{x}" for x in shown]))
    return rows.select(F.concat_ws("#", "subject", "window_id").alias("subject"), "feature", *_r("value"))


@query()
def event_vs_fixed_report(spark, sf):
    df = event_series(spark, sf).withColumn("flag", F.col("p") > 200)
    event = reports.window_features(df, windows.event_windows(df, "flag", 80000.0, 80000.0, 1, 100))
    out = reports.event_against_fixed(event, _window_features(spark, sf), balanced=True)["comparison"]
    return out.select("feature", "n1", "n0", *_r("mean1", "mean0", "cliffs_delta", "cohens_d", "p", "p_t", "fdr_q", n=3))


# ------------------------------------------------------------------ modes


@query(f"""with {EM}, n as (select subject, count(*) as n from s group by 1), f as (select unnest(range(0, 32)) as f), w as (select s.subject, f, sum(p * cos(2 * pi() * f * seq / n)) as re, sum(p * sin(2 * pi() * f * seq / n)) as im from s join n on n.subject = s.subject join f on true group by 1, 2),
a as (select subject, f, re * re + im * im as w from w), t as (select subject, sum(w) as t from a group by 1)
select a.subject, round(least(greatest(-sum(w / (t + 1e-12) * ln(w / (t + 1e-12) + 1e-12)) / (ln(32) + 1e-12), 0), 1), 6) as spectral_entropy, round(arg_max(f, w) / 64, 6) as dominant_freq from a join t on t.subject = a.subject group by 1""")
def spectra(spark, sf):
    return vmd.spectra(vector_series(spark, sf)).select("subject", *_r("spectral_entropy", "dominant_freq"))


@query()
def vmd_modes(spark, sf):
    return vmd.decompose(vector_series(spark, sf), 4).groupBy("subject", "mode").agg(F.avg("omega").alias("omega"), F.sum(F.col("value") * F.col("value")).alias("energy")).select("subject", "mode", *_r("omega", "energy", n=4))


_MODES = """m0 as (select label as subject, vec_id % 6 + 1 as mode, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings),
m as (select subject, mode, avg(x) filter (where i % 7 = 1) as a, avg(x) filter (where i % 7 = 2) as b, avg(x) filter (where i % 7 = 3) as c, avg(x) filter (where i % 7 = 4) as d, avg(x) filter (where i % 7 = 5) as e, avg(x) filter (where i % 7 = 6) as f, avg(x) filter (where i % 7 = 0) as g from m0 group by 1, 2),
t as (select subject, mode, a as signal_corr, b as event_corr, abs(c) as event_energy, abs(d) as artifact_energy, abs(e) as spectral_entropy, 3 + f as kurtosis, 1 / (1 + abs(g)) as continuity from m),
q as (select subject, quantile_cont(kurtosis, 0.05) as lo, quantile_cont(kurtosis, 0.95) as hi from t group by 1),
k as (select t.*, case when hi - lo <= 1e-12 then 0.5e0 else (least(greatest(kurtosis, lo), hi) - lo) / (hi - lo) end as k01 from t join q on q.subject = t.subject),
z as (select *, 0.22e0 * greatest(signal_corr, 0) + 0.26e0 * greatest(event_corr, 0) + 0.20e0 * event_energy + 0.16e0 * continuity - 0.22e0 * artifact_energy - 0.10e0 * spectral_entropy - 0.08e0 * k01 as keep_score from k)"""


def _mode_table(spark, sf):
    # Seven stand-in features, each the mean of every seventh component.
    e = table(spark, sf, "embeddings").select(F.col("label").alias("subject"), (F.col("vec_id") % 6 + 1).alias("mode"), F.posexplode("embedding").alias("i", "x"))
    m = e.groupBy("subject", "mode").agg(*[F.avg(F.when(F.col("i") % 7 == k, F.col("x").cast("double"))).alias(f"x{k}") for k in range(7)])
    return m.select("subject", "mode", F.col("x0").alias("signal_corr"), F.col("x1").alias("event_corr"), F.abs("x2").alias("event_energy"), F.abs("x3").alias("artifact_energy"), F.abs("x4").alias("spectral_entropy"), (3 + F.col("x5")).alias("kurtosis"), (1 / (1 + F.abs("x6"))).alias("continuity"))


@query(f"with {_MODES} select subject, mode::bigint as mode, round(keep_score, 6) as keep_score from z")
def vmd_keep_score(spark, sf):
    return vmd.keep_score(_mode_table(spark, sf)).select("subject", F.col("mode").cast("long").alias("mode"), *_r("keep_score"))


@query(f"""with {_MODES}, c as (select *, (keep_score >= 0.18e0 and artifact_energy <= 0.65e0) or mode = 1 as s from z), r as (select *, row_number() over (partition by subject order by s desc, keep_score desc, mode) as r, sum(s::int) over (partition by subject) as n from c),
o as (select *, max((mode = 1 and r > 2)::int) over (partition by subject) as o from r)
select subject, mode::bigint as mode, case when n > 2 then mode = 1 or r <= (case when o = 1 then 1 else 2 end) else s end as selected from o""")
def vmd_select(spark, sf):
    return vmd.select_modes(vmd.keep_score(_mode_table(spark, sf)), most=2).select("subject", F.col("mode").cast("long").alias("mode"), "selected")


@query(f"""with {EM}, h as (select *, (p + coalesce(lag(p) over ({W}), p)) / 2 as low from s), d as (select subject, seq, p, 1 as mode, low as value from h union all select subject, seq, p, 2, p - low from h),
x as (select *, value - lag(value) over (partition by subject, mode order by seq) as dd from d),
en as (select subject, mode, sum(value * value) + 1e-12 as e, 1 / (1 + sum(dd * dd) / (sum(value * value) + 1e-12)) as continuity, sum(value * value) filter (where seq % 3 = 0) / (sum(value * value) + 1e-12) as event_energy, sum(value * value) filter (where seq % 5 = 0) / (sum(value * value) + 1e-12) as artifact_energy, kurtosis(value) + 3 as kurtosis, corr(value, p) as signal_corr, corr(value, p) filter (where seq % 3 = 0) as event_corr from x group by 1, 2)
select subject, mode::int as mode, round(continuity, 6) as continuity, round(event_energy, 6) as event_energy, round(artifact_energy, 6) as artifact_energy, round(kurtosis, 6) as kurtosis, round(signal_corr, 6) as signal_corr, round(event_corr, 6) as event_corr, round(e / sum(e) over (partition by subject), 6) as energy_ratio from en""")
def mode_features(spark, sf):
    s = vector_series(spark, sf)
    low = s.withColumn("low", (F.col("p") + F.coalesce(F.lag("p").over(series.ordered()), F.col("p"))) / 2)
    both = F.array(F.struct(F.lit(1).alias("mode"), F.col("low").alias("value")), F.struct(F.lit(2).alias("mode"), (F.col("p") - F.col("low")).alias("value")))
    modes = low.select("subject", "seq", F.explode(both).alias("m")).select("subject", "m.mode", "seq", "m.value")
    signal = s.select("subject", "seq", "p", F.col("p").alias("residual"), (F.col("seq") % 3 == 0).alias("event"), (F.col("seq") % 5 == 0).alias("artifact"))
    return vmd.mode_features(modes, signal).select("subject", "mode", *_r("continuity", "event_energy", "artifact_energy", "kurtosis", "signal_corr", "event_corr", "energy_ratio"))


def _marked_series(spark, sf):
    """Each user's series with a baseline, events and artifacts marked by plain rules."""
    df = series.rolling_median(event_series(spark, sf, "user_id"), 25, "p", "baseline").withColumn("residual", F.col("p") - F.col("baseline"))
    return df.withColumn("event", F.col("residual") > 30).withColumn("artifact", F.col("p") > 200)


@query()
def vmd_reconstruction(spark, sf):
    """Every mode's features, score and selection, with how much of the series the rebuilt one keeps."""
    df = _marked_series(spark, sf)
    found = vmd.reconstruct(df, 5, 2700.0)
    kept = found["rebuilt"].join(df, ["subject", "seq"]).groupBy("subject").agg(series.safe_corr(F.col("p"), F.col("rebuilt")).alias("kept"))
    return found["table"].join(kept, "subject").select("subject", "mode", *_r("dominant_freq", "energy_ratio", "signal_corr", "event_corr", "event_energy", "artifact_energy", "spectral_entropy", "kurtosis", "continuity", "keep_score", "kept", n=3), "selected")


@query()
def vmd_search(spark, sf):
    out = vmd.search(_marked_series(spark, sf))
    return out.select("subject", "k", "alpha", *_r("rmse", "nrmse", "corr", "iou", "peak_ratio", "area_ratio", "objective", n=3), "n_events", F.array_join(F.transform("modes", lambda m: m.cast("string")), ",").alias("modes"), "place")


# ------------------------------------------------------------------ two-sample statistics

_GROUPS = """l as (select d.doc_id, quality as grp, unnest([{'f': 'n_chars', 'v': n_chars::double}, {'f': 'words', 'v': len(string_split(text, ' '))::double}, {'f': 'lines', 'v': len(string_split(text, chr(10)))::double}, {'f': 'digit', 'v': (doc_id % 10)::double}]) as u from documents d join labels using (doc_id)),
g as (select doc_id, grp, u.f as feature, u.v as value from l)"""
_MOMENTS = "m as (select feature, count(value) filter (where grp = 1)::double as n1, count(value) filter (where grp = 0)::double as n0, avg(value) filter (where grp = 1) as m1, avg(value) filter (where grp = 0) as m0, var_samp(value) filter (where grp = 1) as v1, var_samp(value) filter (where grp = 0) as v0, median(value) filter (where grp = 1) as md1, median(value) filter (where grp = 0) as md0 from g group by 1)"
_RANKS = """rk as (select feature, grp, rank() over (partition by feature order by value) + (count(*) over (partition by feature, value) - 1) / 2e0 as r, count(*) over (partition by feature, value) as ties from g),
rs as (select feature, count(*) filter (where grp = 1)::double as n1, count(*) filter (where grp = 0)::double as n0, sum(r) filter (where grp = 1) as r1, sum((ties * ties - 1)::double) as tied from rk group by 1),
ru as (select *, r1 - n1 * (n1 + 1) / 2 as u, n1 + n0 as n from rs),
rz as (select *, 2 * u / (n1 * n0) - 1 as delta, (greatest(u, n1 * n0 - u) - n1 * n0 / 2 - 0.5e0) / sqrt(n1 * n0 / 12 * ((n + 1) - tied / (n * (n - 1)))) as z from ru)"""


def _groups(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    wide = d.select("doc_id", F.col("quality").alias("grp"), F.col("n_chars").cast("double").alias("n_chars"), F.size(F.split("text", " ")).cast("double").alias("words"), F.size(F.split("text", "\n")).cast("double").alias("lines"), (F.col("doc_id") % 10).cast("double").alias("digit"))
    return wide.unpivot(["doc_id", "grp"], ["n_chars", "words", "lines", "digit"], "feature", "value")


@query(f"with {_GROUPS}, {_RANKS} select feature, round(delta, 6) as cliffs_delta from rz")
def cliffs_delta(spark, sf):
    return stats.rank_sums(_groups(spark, sf)).select("feature", F.round("delta", 6).alias("cliffs_delta"))


@query(f"with {_GROUPS}, {_MOMENTS} select feature, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 6) as cohens_d from m")
def cohens_d(spark, sf):
    return stats.cohens_d(_groups(spark, sf)).select("feature", *_r("cohens_d"))


@query(f"with {_GROUPS}, {_RANKS} select feature, n1::bigint as n1, n0::bigint as n0, round(u, 3) as u, round(z, 6) as z from rz")
def mann_whitney_u(spark, sf):
    return stats.rank_sums(_groups(spark, sf)).select("feature", "n1", "n0", *_r("u", n=3), *_r("z"))


@query(f"with {_GROUPS}, {_MOMENTS} select feature, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) as t, round((v1 / n1 + v0 / n0) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v0 / n0) ** 2 / (n0 - 1)), 5) as df from m")
def welch_t(spark, sf):
    return stats.welch(_groups(spark, sf)).select("feature", *_r("t"), *_r("df", n=5))


_P = "t as (select vec_id, label, abs(list_sum(embedding::double[])) / (1 + abs(list_sum(embedding::double[]))) as p from embeddings)"


@query(f"with {_P}, r as (select *, rank() over (partition by label order by p) + count(*) over (partition by label, p) - 1 as r, count(*) over (partition by label) as m from t) select vec_id, round(least(min(p * m / r) over (partition by label order by r desc range unbounded preceding), 1), 6) as fdr_q from r")
def bh_fdr(spark, sf):
    x = F.abs(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double")))
    df = table(spark, sf, "embeddings").select("vec_id", "label", (x / (1 + x)).alias("p"))
    return stats.benjamini_hochberg(df, "p", "label").select("vec_id", *_r("fdr_q"))


@query(f"with {_GROUPS}, {_MOMENTS}, {_RANKS} select m.feature, round(m1, 4) as mean1, round(m0, 4) as mean0, round(md1, 4) as median1, round(md0, 4) as median0, round(sqrt(v1), 4) as std1, round(sqrt(v0), 4) as std0, round(m1 - m0, 4) as mean_diff, round((m1 - m0) / sqrt(((m.n1 - 1) * v1 + (m.n0 - 1) * v0) / (m.n1 + m.n0 - 2)), 6) as cohens_d, round(delta, 6) as cliffs_delta from m join rz on m.feature = rz.feature")
def compare_methods(spark, sf):
    return stats.compare(_groups(spark, sf)).select("feature", *_r("mean1", "mean0", "median1", "median0", "std1", "std0", "mean_diff", n=4), *_r("cohens_d", "cliffs_delta"))


@query()
def compare_methods_p(spark, sf):
    return stats.compare_with_p(_groups(spark, sf)).select("feature", *_r("p", "p_t", "fdr_q"))


_SCORES = "sc as (select d.doc_id as id, quality as y, n_chars::double as s1, len(string_split(text, ' '))::double / (1 + doc_id % 7) as s2 from documents d join labels using (doc_id))"


def _scores(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return d.select(F.col("doc_id").alias("id"), F.col("quality").alias("y"), F.col("n_chars").cast("double").alias("s1"), (F.size(F.split("text", " ")).cast("double") / (1 + F.col("doc_id") % 7)).alias("s2"))


#: Two-sided probability of a standard normal z, by the series of the error function.
_TAIL = "case when z = 0 then 1 when z is not null then greatest(1 - 2 / sqrt(pi()) * exp(-z * z / 2) * list_sum([exp((2 * n + 1) * ln(abs(z) / sqrt(2e0)) + n * ln(4e0) + lgamma(n + 1) - lgamma(2 * n + 2)) for n in range(200)]), 0) end"


@query(f"""with {_SCORES}, e as (select id, y, 1 as k, s1 as s from sc union all select id, y, 2, s2 from sc),
r as (select *, rank() over (partition by k order by s) + (count(*) over (partition by k, s) - 1) / 2e0 as ra, rank() over (partition by k, y order by s) + (count(*) over (partition by k, y, s) - 1) / 2e0 as ro, count(*) filter (where y = 1) over (partition by k) as n1, count(*) filter (where y = 0) over (partition by k) as n0 from e),
v as (select id, y, k, n1, n0, case when y = 1 then (ra - ro) / n0 else 1 - (ra - ro) / n1 end as v from r), w as (select id, y, n1, n0, max(v) filter (where k = 1) as v1, max(v) filter (where k = 2) as v2 from v group by 1, 2, 3, 4),
q as (select n1, n0, avg(v1) filter (where y = 1) as a1, avg(v2) filter (where y = 1) as a2, var_samp(v1) filter (where y = 1) as s11, var_samp(v2) filter (where y = 1) as s12, covar_samp(v1, v2) filter (where y = 1) as c1, var_samp(v1) filter (where y = 0) as t11, var_samp(v2) filter (where y = 0) as t12, covar_samp(v1, v2) filter (where y = 0) as c0 from w group by 1, 2)
select round(a1, 6) as auc1, round(a2, 6) as auc2, round(a1 - a2, 6) as diff, round(z, 5) as z, round({_TAIL}, 6) as p from (select *, (a1 - a2) / sqrt((s11 + s12 - 2 * c1) / n1 + (t11 + t12 - 2 * c0) / n0) as z from q)""")
def delong(spark, sf):
    return stats.delong(_scores(spark, sf)).select(*_r("auc1", "auc2", "diff"), *_r("z", n=5), *_r("p"))


@query(f"""with {_SCORES}, e as (select id, y, 'chars' as model, s1 as s from sc union all select id, y, 'words', s2 from sc union all select id, y, 'mixed', s1 + 7 * s2 from sc),
v as (select a.id, a.y, a.model, avg(case when a.y = 1 then (b.s < a.s)::int + (b.s = a.s)::int / 2e0 else (b.s > a.s)::int + (b.s = a.s)::int / 2e0 end) as v from e a join e b on a.model = b.model and a.y <> b.y group by 1, 2, 3),
w as (select x.model as a, z.model as b, avg(x.v) filter (where x.y = 1) as ma, avg(z.v) filter (where x.y = 1) as mb, covar_samp(x.v, z.v) filter (where x.y = 1) / count(*) filter (where x.y = 1) + covar_samp(x.v, z.v) filter (where x.y = 0) / count(*) filter (where x.y = 0) as cov,
var_samp(x.v - z.v) filter (where x.y = 1) / count(*) filter (where x.y = 1) + var_samp(x.v - z.v) filter (where x.y = 0) / count(*) filter (where x.y = 0) as var from v x join v z on x.id = z.id and x.y = z.y and x.model <= z.model group by 1, 2),
q as (select *, case when a <> b then (ma - mb) / sqrt(var) end as z from w)
select a, b, round(ma, 6) as auc_a, round(mb, 6) as auc_b, round(cov, 9) as cov, round(ma - mb, 6) as diff, round(z, 5) as z, round({_TAIL}, 6) as p from q""")
def auc_covariance(spark, sf):
    """Areas under the curve of three scores and their covariance."""
    rows = _scores(spark, sf)
    model = lambda name, s: F.struct(F.lit(name).alias("model"), s.alias("s"))
    long = rows.select("id", "y", F.inline(F.array(model("chars", F.col("s1")), model("words", F.col("s2")), model("mixed", F.col("s1") + 7 * F.col("s2")))))
    return stats.auc_covariance(long).select("a", "b", *_r("auc_a", "auc_b", "diff", "p"), *_r("cov", n=9), *_r("z", n=5))


@query(f"""with {_SCORES}, r as (select sum((y = (s1 > 800)::int and y <> (s2 > 100)::int)::int) as b, sum((y <> (s1 > 800)::int and y = (s2 > 100)::int)::int) as c from sc),
k as (select b, c, unnest(range(0, least(b, c)::bigint + 1)) as i from r), l as (select b, c, i, lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2e0) as l from k)
select any_value(l.b)::bigint as b, any_value(l.c)::bigint as c, any_value(least(l.b, l.c))::bigint as statistic, round(least(1, 2 * sum(exp(l.l))), 5) as p from l""")
def mcnemar(spark, sf):
    df = _scores(spark, sf).select((F.col("y") == (F.col("s1") > 800).cast("int")).alias("right1"), (F.col("y") == (F.col("s2") > 100).cast("int")).alias("right2"))
    return stats.mcnemar(df).select("b", "c", "statistic", *_r("p", n=5))


@query()
def bootstrap_ci(spark, sf):
    return stats.bootstrap_interval(_scores(spark, sf).withColumn("s1", F.col("s1") * 1.0), "s1", "id").select(*_r("estimate", "low", "high", n=3))


@query()
def bootstrap_auc(spark, sf):
    return stats.bootstrap_auc(_scores(spark, sf).withColumn("score", F.col("s2")), "id").select(*_r("estimate", "low", "high", n=4))


# ------------------------------------------------------------------ aggregation and selection

_LONG = "lg as (select user_id as subject, event_type as feature, event_id % 2 as label, case when event_id % 11 <> 0 then value end as value from events)"


def _long(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("subject"), F.col("event_type").alias("feature"), (F.col("event_id") % 2).cast("int").alias("label"), F.when(F.col("event_id") % 11 != 0, finite("value")).alias("value"))


@query(f"with {_LONG} select subject, feature, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, round(median(value), 6) as median, round(min(value), 6) as min, round(max(value), 6) as max, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) as iqr, count(*) as num_windows from lg group by 1, 2")
def subject_aggregate(spark, sf):
    return features.subject_aggregate(_long(spark, sf), iqr=True).select("subject", "feature", *_r("mean", "std", "median", "min", "max", "iqr"), "num_windows")


@query(f"with {_LONG} select feature, round(avg((value is null)::int), 6) as missing_rate from lg group by 1")
def missingness(spark, sf):
    return features.missingness(_long(spark, sf)).select("feature", *_r("missing_rate"))


_HOLES = "h as (select subject, feature, label, case when feature in ('click', 'view') and subject % 2 = 0 then null else value end as value from lg)"


def _holes(spark, sf):
    return _long(spark, sf).withColumn("value", F.when(~(F.col("feature").isin("click", "view") & (F.col("subject") % 2 == 0)), F.col("value")))


@query(f"with {_LONG}, {_HOLES}, k as (select feature from h group by 1 having avg((value is null)::int) <= 0.3) select feature, count(*) as n, round(sum(value), 3) as total from h where feature in (select feature from k) group by 1")
def drop_high_missing(spark, sf):
    return features.drop_high_missing(_holes(spark, sf)).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query(f"with {_LONG}, {_HOLES}, k as (select subject, feature, coalesce(avg((value is null)::int) <= 0.3 and var_samp(value) > 1e-10, false) as ok from h group by 1, 2), a as (select *, bool_or(ok) over (partition by subject) as any_ok from k) select subject, feature from a where ok or not any_ok")
def missing_variance_filter(spark, sf):
    return features.missing_variance(_holes(spark, sf), ("subject",))


@query(f"with {_LONG}, f as (select feature, median(value) filter (where subject % 5 <> 0) as fill from lg group by 1) select lg.feature, count(*) as n, round(sum(coalesce(value, fill, 0)), 3) as total from lg join f on f.feature = lg.feature group by 1")
def median_impute(spark, sf):
    out = features.impute(_long(spark, sf).withColumn("train", F.col("subject") % 5 != 0), train="train")
    return out.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query(f"with {_LONG}, f as (select feature, avg(value) filter (where subject % 5 <> 0) as m, stddev_pop(value) filter (where subject % 5 <> 0) as s from lg group by 1) select lg.subject, lg.feature, round(sum((value - m) / s), 5) as z from lg join f on f.feature = lg.feature group by 1, 2")
def standardize(spark, sf):
    out = features.standardize(_long(spark, sf).withColumn("train", F.col("subject") % 5 != 0), train="train")
    return out.groupBy("subject", "feature").agg(F.round(F.sum("value"), 5).alias("z"))


_VEC = "vl as (select vec_id as subject, label, 'x' || lpad(i::varchar, 2, '0') as feature, (case when i = 5 then embedding[1] * 2 + 0.01 * embedding[2] else embedding[i] end)::double as value from (select *, generate_subscripts(embedding, 1) as i from embeddings))"


def _vector_features(spark, sf):
    e = table(spark, sf, "embeddings")
    x = F.col("embedding")
    mixed = x[0] * F.lit(2) + F.lit(0.01).cast("float") * x[1]
    name = lambda i: F.concat(F.lit("x"), F.lpad((i + 1).cast("string"), 2, "0"))
    pairs = F.transform(x, lambda v, i: F.struct(name(i).alias("feature"), F.when(i == 4, mixed).otherwise(v).cast("double").alias("value")))
    return e.select(F.col("vec_id").alias("subject"), "label", F.explode(pairs).alias("f")).select("subject", "label", "f.feature", "f.value")


@query(f"""with {_VEC.replace("0.01 *", "0.01::float *")}, r as (select subject, feature, rank() over (partition by feature order by value) + (count(*) over (partition by feature, value) - 1) / 2e0 as r from vl), c as (select a.feature as a, b.feature as b, corr(a.r, b.r) as rho from r a join r b on a.subject = b.subject and a.feature < b.feature group by 1, 2)
select distinct feature from vl where feature not in (select b from c where abs(rho) > 0.9)""")
def spearman_filter(spark, sf):
    return features.correlation_filter(_vector_features(spark, sf))


@query(f"""with {_VEC.replace("0.01 *", "0.01::float *")}, g as (select feature, (label < 5)::int as grp, value from vl), {_RANKS} select feature, round(abs(delta), 6) as score, r::int as r from (select feature, delta, row_number() over (order by abs(delta) desc, feature) as r from rz) where r <= 5""")
def effect_topk(spark, sf):
    return features.effect_top(_vector_features(spark, sf).withColumn("label", (F.col("label") < 5).cast("int")), 5).select("feature", *_r("score"), "r")


@query(f"""with {_VEC.replace("0.01 *", "0.01::float *")}, g as (select feature, label, count(*) as n, avg(value) as m, var_pop(value) as v from vl group by 1, 2), s as (select feature, sum(n) as n, count(*) as k, sum(n * m) / sum(n) as gm, sum(n * v) as w from g group by 1)
select s.feature, round((sum(g.n * (m - gm) ** 2) / (any_value(k) - 1)) / (any_value(w) / (any_value(s.n) - any_value(k))), 6) as f from g join s on s.feature = g.feature group by 1""")
def anova_f(spark, sf):
    return features.anova_f(_vector_features(spark, sf)).select("feature", *_r("f"))


@query("with s as (select c_custkey as subject from customer), a as (select distinct o_custkey as subject from orders where o_orderstatus = 'F'), b as (select distinct o_custkey as subject from orders where o_orderstatus = 'O') select s.subject, a.subject is not null as has_event, b.subject is not null as has_fixed from s left join a on a.subject = s.subject left join b on b.subject = s.subject")
def label_audit(spark, sf):
    o = table(spark, sf, "orders")
    kind = lambda k: o.where(F.col("o_orderstatus") == k).select(F.col("o_custkey").alias("subject"))
    return features.label_audit(table(spark, sf, "customer").select(F.col("c_custkey").alias("subject")), kind("F"), kind("O"))


@query(f"with {_LONG}, f as (select feature, count(distinct value) as d, avg((value is null)::int) as m from lg group by 1) select (select count(distinct subject) from lg) as n_subjects, (select count(*) from lg) as n_values, (select count(*) from f) as n_features, (select count(*) from f where d <= 1) as n_constant, round((select max(m) from f), 6) as max_missing_rate")
def subject_qc(spark, sf):
    return features.quality_report(_long(spark, sf)).select("n_subjects", "n_values", "n_features", "n_constant", *_r("max_missing_rate"))


@query("select l_returnflag as grp, count(*) as n_features, round(median(abs(l_discount - 0.05)), 6) as median_abs_effect, round(max(abs(l_discount - 0.05)), 6) as max_abs_effect, min(l_tax) as min_p, sum((l_tax < 0.05)::int)::bigint as n_below from lineitem group by 1")
def group_summary(spark, sf):
    df = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("grp"), (F.col("l_discount") - 0.05).alias("effect"), F.col("l_tax").alias("p"))
    return features.group_summary(df).select("grp", "n_features", *_r("median_abs_effect", "max_abs_effect"), "min_p", "n_below")


@query("with e as (select event_id as id from events where event_type = 'purchase'), f as (select event_id as id from events where event_type <> 'purchase' order by md5(event_id::varchar), event_id limit (select count(*) from e)) select id from e union all select id from f")
def balanced_sample(spark, sf):
    e = table(spark, sf, "events")
    pick = lambda c: e.where(c).select(F.col("event_id").alias("id"))
    return stats.balanced_sample(pick(F.col("event_type") == "purchase"), pick(F.col("event_type") != "purchase"), "id")


# ------------------------------------------------------------------ evaluation and models


@query(f"with {US}, m as (select subject, p > 60 as a, p > 100 or seq % 5 = 0 as b from s), c as (select subject, sum((a and b)::int)::double as tp, sum((a and not b)::int)::double as fp, sum((not a and b)::int)::double as fn, sum((not a and not b)::int)::double as tn from m group by 1), k as (select *, tp / (tp + fp + 1e-9) as pr, tp / (tp + fn + 1e-9) as rc from c) select subject, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, tn::bigint as tn, round(pr, 6) as precision, round(rc, 6) as recall, round(2 * pr * rc / (pr + rc + 1e-9), 6) as f1, round(tp / (tp + fp + fn + 1e-9), 6) as iou from k")
def artifact_detection_metrics(spark, sf):
    df = event_series(spark, sf, "user_id").withColumn("a", F.col("p") > 60).withColumn("b", (F.col("p") > 100) | (F.col("seq") % 5 == 0))
    return evaluate.mask_metrics(df, "a", "b").select("subject", "tp", "fp", "fn", "tn", *_r("precision", "recall", "f1", "iou"))


@query(f"""with {EV}, m as (select *, p > 60 as a, lag(p, 1) over ({W}) > 60 or p > 200 as b0 from s), mm as (select *, coalesce(b0, p > 200, false) as b from m),
ta as (select subject, seq, t, row_number() over ({W}) - row_number() over (partition by subject, a order by seq) as r, a from mm), tr as (select subject, min(seq) as s0, max(seq) as s1, min(t) as t0, max(t) as t1 from ta where a group by subject, r),
tb as (select subject, seq, t, row_number() over ({W}) - row_number() over (partition by subject, b order by seq) as r, b from mm), pr as (select subject, min(seq) as s0, max(seq) as s1, min(t) as t0, max(t) as t1 from tb where b group by subject, r),
j as (select tr.subject, tr.s0 as ts, pr.s0 as ps, coalesce((least(tr.s1, pr.s1) - greatest(tr.s0, pr.s0) + 1) / ((tr.s1 - tr.s0 + 1) + (pr.s1 - pr.s0 + 1) - (least(tr.s1, pr.s1) - greatest(tr.s0, pr.s0) + 1)), 0) as iou, pr.t0 - tr.t0 as oe, pr.t1 - tr.t1 as fe from tr left join pr on tr.subject = pr.subject and pr.s0 <= tr.s1 and pr.s1 >= tr.s0)
select subject, ts::bigint as true_start, ps::bigint as pred_start, round(iou, 6) as iou, round(oe, 5) as onset_error, round(fe, 5) as offset_error, round(fe - oe, 5) as duration_error from (select *, row_number() over (partition by subject, ts order by iou desc, ps) as r from j) where r = 1""")
def event_timing(spark, sf):
    df = event_series(spark, sf)
    df = df.withColumn("a", F.col("p") > 60).withColumn("b", F.coalesce((F.lag("p").over(series.ordered()) > 60) | (F.col("p") > 200), F.col("p") > 200))
    out = evaluate.event_timing(df, "b", "a")
    return out.select("subject", "true_start", "pred_start", *_r("iou"), *_r("onset_error", "offset_error", "duration_error", n=5))


@query(f"with {US}, e as (select *, p * 0.9e0 + 3 as q, p > 60 as ev from s) select subject, round(sqrt(avg((q - p) ** 2)), 6) as rmse, round(avg(abs(q - p)), 6) as mae, round(case when count(*) >= 3 and stddev_pop(p) >= 1e-12 then corr(q, p) end, 6) as corr, round(sqrt(avg((q - p) ** 2) filter (where ev)), 6) as event_rmse, round(sqrt(avg((q - p) ** 2) filter (where not ev)), 6) as other_rmse from e group by 1")
def clean_signal_metrics(spark, sf):
    df = event_series(spark, sf, "user_id").withColumn("q", F.col("p") * 0.9 + 3).withColumn("ev", F.col("p") > 60)
    return evaluate.signal_metrics(df, "q", "p", "ev").select("subject", *_r("rmse", "mae", "corr", "event_rmse", "other_rmse"))


@query(f"""with {EV}, e as (select *, p * 0.8e0 + 5 as q, p > 60 as flag from s), r as (select *, row_number() over ({W}) - row_number() over (partition by subject, flag order by seq) as run, greatest(p - 20, 0) as a, greatest(q - 20, 0) as b from e), f as (select *, max(a) over (partition by subject, run) * 0.05e0 as lim, (a + lag(a) over (partition by subject, run order by seq)) / 2 * (t - lag(t) over (partition by subject, run order by seq)) as aa, (b + lag(b) over (partition by subject, run order by seq)) / 2 * (t - lag(t) over (partition by subject, run order by seq)) as ba from r where flag)
select subject, min(seq)::bigint as start, count(*) as n, round(max(b) / (max(a) + 1e-9), 6) as peak_ratio, round(coalesce(sum(ba), 0) / (coalesce(sum(aa), 0) + 1e-9), 6) as area_ratio, round(sum((a > lim and b > lim)::int) / nullif(sum((a > lim or b > lim)::int), 0)::double, 6) as iou from f group by subject, run having count(*) >= 3""")
def event_fidelity(spark, sf):
    df = event_series(spark, sf).withColumn("q", F.col("p") * 0.8 + 5).withColumn("flag", F.col("p") > 60).withColumn("base", F.lit(20.0))
    return evaluate.event_fidelity(df, "p", "q", "base", "flag").select("subject", "start", "n", *_r("peak_ratio", "area_ratio", "iou"))


@query(f"with {_SCORES}, c as (select sum((y = 1 and s1 > 800)::int)::double as tp, sum((y = 0 and s1 > 800)::int)::double as fp, sum((y = 1 and s1 <= 800)::int)::double as fn, sum((y = 0 and s1 <= 800)::int)::double as tn from sc) select tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, tn::bigint as tn, round((tp + tn) / (tp + fp + fn + tn), 6) as acc, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(tn / (tn + fp), 6) as specificity, round(2 * tp / (2 * tp + fp + fn), 6) as f1, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) as balanced_acc from c")
def binary_metrics(spark, sf):
    out = evaluate.binary_metrics(_scores(spark, sf).withColumn("pred", (F.col("s1") > 800).cast("int")))
    return out.select("tp", "fp", "fn", "tn", *_r("acc", "precision", "recall", "specificity", "f1", "balanced_acc"))


@query(f"with {_SCORES}, r as (select y, rank() over (order by s2) + (count(*) over (partition by s2) - 1) / 2e0 as r from sc) select round((sum(r) filter (where y = 1) - sum((y = 1)::int)::double * (sum((y = 1)::int) + 1) / 2) / (sum((y = 1)::int)::double * sum((y = 0)::int)), 6) as auc from r")
def roc_auc(spark, sf):
    return evaluate.roc_auc(_scores(spark, sf).withColumn("score", F.col("s2"))).select(*_r("auc"))


@query(f"with {_LONG}, a as (select subject, feature, avg(value) as v from lg group by 1, 2), f as (select distinct subject as fold from a), t as (select feature, sum(v) as ts, count(v) as tn from a group by 1), m as (select fold, t.feature, (ts - coalesce(v, 0)) / (tn - (v is not null)::int) as m from f cross join t left join a on a.subject = f.fold and a.feature = t.feature), r as (select *, row_number() over (partition by fold order by round(m, 9) desc, feature) as r from m) select feature, count(distinct fold) as selected, round(count(distinct fold) / (select count(*) from f)::double, 6) as frequency, count(distinct fold) / (select count(*) from f)::double >= 0.6 as stable from r where r <= 2 group by 1")
def selection_frequency(spark, sf):
    a = _long(spark, sf).groupBy("subject", "feature").agg(F.avg("value").alias("value"))
    m = ml.held_out_means(a)
    top = m.withColumn("r", F.row_number().over(Window.partitionBy("fold").orderBy(F.round("mean", 9).desc(), "feature"))).where("r <= 2")
    return evaluate.selection_frequency(top, a.select("subject").distinct().count()).select("feature", "selected", *_r("frequency"), "stable")


@query(f"with {_LONG}, f as (select distinct subject as fold from lg), o as (select subject, count(*) as n, count(value) as c, sum(value) as s from lg group by 1) select fold, (select count(*) from lg) - n as n, round(((select sum(value) from lg) - s) / ((select count(value) from lg) - c), 6) as mean from f join o on o.subject = f.fold")
def loso_folds(spark, sf):
    out = ml.held_out_means(_long(spark, sf).withColumn("feature", F.lit("value")))
    return out.select("fold", F.col("rows").alias("n"), F.round("mean", 6).alias("mean"))


@query("""with e as (select vec_id as id, label as y, embedding::double[] as x from embeddings), d as (select q.id, e.id as other, e.y, list_distance(q.x, e.x) as d from e q join e on e.id <> q.id), r as (select *, row_number() over (partition by id order by round(d, 9), other) as r from d)
select id, (avg((y % 2)::double) > 0.5)::int as pred, round(avg((y % 2)::double), 6) as score from r where r <= 3 group by 1""")
def knn_loso(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("grp"), (F.col("label") % 2).cast("int").alias("y"), F.col("embedding").alias("x"))
    return ml.knn_vote(ml.nearest_neighbours(rows, rows)).select("id", "pred", *_r("score"))


#: Measures of a nation's customers in each market segment: of nations as subjects, or of each segment as a window.
_MEASURES = ("mean", "std", "most", "least", "size", "twice", "one")
_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_CELLS = """c0 as (select c_nationkey::bigint as nation, c_mktsegment as segment, round(avg(c_acctbal), 4) as mean, round(stddev_samp(c_acctbal), 4) as std, max(c_acctbal) as most, min(c_acctbal) as least, count(*)::double as size, 2 * round(avg(c_acctbal), 4) as twice, 1e0 as one from customer group by 1, 2),
c1 as (select nation, segment, unnest(['mean', 'std', 'most', 'least', 'size', 'twice', 'one']) as k, unnest([mean, std, most, least, size, twice, one]) as value from c0),
cells as (select nation, segment, (nation % 2)::int as label, k, case when (nation + length(segment)) % 7 <> 0 then value end as value from c1)"""
_BY_WINDOW = f"src as (select nation * 5 + list_position({list(_SEGMENTS)}, segment) - 1 as id, nation as grp, label, k as feature, value from cells)"
_NATION_COLUMNS = [f"{s}_{k}" for k in _MEASURES for s in reversed(_SEGMENTS)]
_BY_NATION = f"src as (select n.nation as id, n.nation as grp, n.label, f.feature, c.value from (select distinct nation, label from cells) n cross join (select unnest({_NATION_COLUMNS}) as feature) f left join cells c on c.nation = n.nation and c.segment || '_' || c.k = f.feature)"


def _selection(source: str, columns: list[str], top: int) -> str:
    """SQL of the selection inside folds: rows z of the chosen features, scaled, and places r."""
    at = lambda c: f"list_position({columns}, {c})"
    return f"""{_CELLS}, {source}, f as (select distinct grp as fold from src),
    r0 as (select fold, id, label, feature, value, grp <> fold as train from src, f),
    k1 as (select fold, feature, coalesce(avg((value is null)::int) <= 0.3 and var_samp(value) > 1e-10, false) as ok, median(value) as fill from r0 where train group by 1, 2),
    k2 as (select fold, feature, fill from (select *, max(ok::int) over (partition by fold) as any_ok from k1) where ok or any_ok = 0),
    x as (select r0.fold, id, label, feature, coalesce(value, fill, 0) as value, train from r0 join k2 using (fold, feature)),
    rk as (select fold, id, label, feature, rank() over (partition by fold, feature order by value) + (count(*) over (partition by fold, feature, value) - 1) / 2e0 as rk from x where train),
    bad as (select distinct fold, feature from (select a.fold, b.feature from rk a join rk b on a.fold = b.fold and a.id = b.id and {at('a.feature')} < {at('b.feature')} group by a.fold, a.feature, b.feature having stddev_pop(a.rk) > 0 and stddev_pop(b.rk) > 0 and abs(corr(a.rk, b.rk)) > 0.9e0)),
    e0 as (select fold, feature, sum(rk) filter (where label = 1) as r1, count(*) filter (where label = 1)::double as n1, count(*) filter (where label = 0)::double as n0 from rk where (fold, feature) not in (select (fold, feature) from bad) group by 1, 2),
    e1 as (select fold, feature, row_number() over (partition by fold order by abs(2 * (r1 - n1 * (n1 + 1) / 2) / (n1 * n0) - 1) desc, {at('feature')}) as r from e0),
    top as (select * from e1 where r <= {top}),
    sc as (select fold, feature, avg(value) as m, stddev_pop(value) as s from x where train group by 1, 2),
    z as (select x.fold, x.id, x.label, x.train, top.r, x.feature, (value - m) / (case when s > 0 then s else 1 end) as v from x join top using (fold, feature) join sc using (fold, feature))"""


_NEIGHBOURS = """d as (select q.fold, q.id, q.label as y, e.id as other, e.label as ye, sqrt(sum((q.v - e.v) ** 2)) as d from z q join z e on q.fold = e.fold and q.feature = e.feature where not q.train and e.train group by 1, 2, 3, 4, 5),
n as (select *, row_number() over (partition by fold, id order by round(d, 9), other) as r from d)
select fold, id, y, (avg(ye::double) > 0.5)::int as pred, round(avg(ye::double), 6) as score from n where r <= 3 group by fold, id, y"""


def _cells(spark, sf):
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("long").alias("nation"), F.col("c_mktsegment").alias("segment"))
    c = c.agg(F.round(F.avg("c_acctbal"), 4).alias("mean"), F.round(F.stddev_samp("c_acctbal"), 4).alias("std"), F.max("c_acctbal").alias("most"), F.min("c_acctbal").alias("least"), F.count(F.lit(1)).cast("double").alias("size"))
    c = c.withColumn("twice", 2 * F.col("mean")).withColumn("one", F.lit(1.0)).unpivot(["nation", "segment"], list(_MEASURES), "k", "value")
    value = F.when((F.col("nation") + F.length("segment")) % 7 != 0, F.col("value"))
    return c.select("nation", "segment", (F.col("nation") % 2).cast("int").alias("label"), "k", value.alias("value"))


def _nations(spark, sf):
    return _cells(spark, sf).select(F.col("nation").alias("subject"), "label", F.concat_ws("_", "segment", "k").alias("feature"), "value")


def _nation_windows(spark, sf):
    at = F.array_position(F.array(*map(F.lit, _SEGMENTS)), F.col("segment"))
    return _cells(spark, sf).select(F.col("nation").alias("subject"), (F.col("nation") * 5 + at - 1).alias("window_id"), "label", F.col("k").alias("feature"), "value")


@query(f"with {_selection(_BY_NATION, _NATION_COLUMNS, 5)}, {_NEIGHBOURS}")
def subject_loso(spark, sf):
    return ml.subject_level(_nations(spark, sf), _NATION_COLUMNS, top=5)["predictions"].select("fold", "id", "y", "pred", *_r("score"))


@query(f"with {_selection(_BY_WINDOW, list(_MEASURES), 3)}, {_NEIGHBOURS}")
def window_logo(spark, sf):
    return ml.window_level(_nation_windows(spark, sf), list(_MEASURES), top=3)["predictions"].select("fold", "id", "y", "pred", *_r("score"))


@query(f"with {_selection(_BY_NATION, _NATION_COLUMNS, 5)} select feature, count(distinct fold) as selected, round(count(distinct fold) / (select count(distinct fold) from z)::double, 6) as frequency, count(distinct fold) / (select count(distinct fold) from z)::double >= 0.6 as stable from top group by 1")
def loso_selected_features(spark, sf):
    return ml.subject_level(_nations(spark, sf), _NATION_COLUMNS, top=5)["frequency"].select("feature", "selected", *_r("frequency"), "stable")


_SUMMARY = """p as ({0}), c as (select sum((y = 1 and pred = 1)::int)::double as tp, sum((y = 0 and pred = 1)::int)::double as fp, sum((y = 1 and pred = 0)::int)::double as fn, sum((y = 0 and pred = 0)::int)::double as tn from p),
rr as (select y, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2e0 as r from p), au as (select (sum(r) filter (where y = 1) - sum(y) * (sum(y) + 1) / 2e0) / (sum(y)::double * sum(1 - y)) as auc from rr)
select '{1}' as "group", {2} as n_features, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, tn::bigint as tn, round((tp + tn) / (tp + fp + fn + tn), 6) as acc, round(auc, 6) as auc from c, au"""
_GROUPED = {name: [f"{s}_{k}" for k in members for s in reversed(_SEGMENTS)] for name, members in {"centre": ("mean", "twice"), "spread": ("std",), "ends": ("most", "least"), "counts": ("size", "one")}.items()}


def _group_sql(name: str, own: list[str]) -> str:
    source = f"{_BY_NATION[:-1]} where f.feature in {tuple(own)})"
    return f"select * from (with {_SUMMARY.format(f'with {_selection(source, own, 3)}, {_NEIGHBOURS}', name, len(own))})"


@query(" union all ".join(_group_sql(k, v) for k, v in _GROUPED.items()))
def feature_group_ablation(spark, sf):
    out = ml.group_ablation(_nations(spark, sf), _NATION_COLUMNS, _GROUPED, top=3)
    return out.select("group", F.col("n_features").cast("int").alias("n_features"), "tp", "fp", "fn", "tn", *_r("acc", "auc"))


@query(f"with {_VEC.replace('0.01 *', '0.01::float *')}, g as (select feature, (label < 5)::int as grp, value from vl), {_MOMENTS} select feature, round(score, 6) as score, r::int as r from (select feature, abs(m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) + 1e-12) as score, row_number() over (order by abs(m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) + 1e-12) desc, feature) as r from m) where r <= 5")
def effect_topk_cohen(spark, sf):
    return features.effect_top(_vector_features(spark, sf).withColumn("label", (F.col("label") < 5).cast("int")), 5, "cohen_abs").select("feature", *_r("score"), "r")


@query()
def effect_topk_p(spark, sf):
    return features.effect_top(_vector_features(spark, sf).withColumn("label", (F.col("label") < 5).cast("int")), 5, "mw_neglogp", 0.05).select("feature", *_r("score"), "r")


def _labelled_vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("subject"), (F.col("label") % 2).cast("int").alias("y"), F.col("embedding").alias("x"))


def _model_query(name: str):
    def f(spark, sf):
        return ml.cross_validate(_labelled_vectors(spark, sf), ml.classifiers()[name])

    f.__name__ = f"{name}_cv"
    return query()(f)


for _name in ("logistic", "linear_svm", "rbf_svm", "random_forest", "gbt"):
    _model_query(_name)


def _regions(spark, sf):
    """Nations as windows of their regions, with the features of all segments."""
    region = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("window_id"), F.col("n_regionkey").cast("long").alias("region"))
    rows = _nations(spark, sf).withColumnRenamed("subject", "window_id").drop("label").join(region, "window_id")
    return rows.select(F.col("region").alias("subject"), "window_id", (F.col("region") % 2).cast("int").alias("label"), "feature", "value")


def _fold_query(name: str, level: str):
    """Predictions of one model with selection inside folds: each region left out in turn, or five folds of nations."""

    def f(spark, sf):
        model = ml.classifiers()[name]
        out = ml.window_level(_regions(spark, sf), _NATION_COLUMNS, model, top=5) if level == "loso" else ml.k_fold_level(_nations(spark, sf), _NATION_COLUMNS, model, top=5)
        return out["predictions"].select("fold", "id", "y", "pred", *_r("score"))

    f.__name__ = f"{name}_{level}"
    return query()(f)


for _name in ml.MODELS:
    _fold_query(_name, "loso")
    _fold_query(_name, "5fold")


@query()
def knn_5fold(spark, sf):
    return ml.k_fold_level(_nations(spark, sf), _NATION_COLUMNS, top=5)["predictions"].select("fold", "id", "y", "pred", *_r("score"))


@query()
def pca2(spark, sf):
    return ml.pca(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"))).select("id", *_r("pc1", "pc2", n=4))


def _drawn_sql(use: str, i: int) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', subject, seq, 42, '{use}')), {1 + 8 * i}, 8))::bigint / 4294967296e0)"


_COUNTED = f"""{DT}, n as (select subject, count(*) as n from s group by 1), fr as (select s.*, n, row_number() over (partition by s.subject order by md5(concat_ws(':', s.subject, seq, 42, 'place')), seq) as rank from s join n on n.subject = s.subject where seq > 5 and seq < n - 6 and not p > 150),
ch as (select fr.*, dt, case when rank <= 40 then 'isolated_spike' when rank <= 60 then 'short_pulse' when rank <= 66 then 'flatline_dropout' else 'hard_range_outlier' end as kind, {_drawn_sql("shape", 0)} as u0, {_drawn_sql("shape", 1)} as u1, {_drawn_sql("shape", 2)} as u2, {_drawn_sql("shape", 3)} as u3 from (select fr.*, dt from fr join dt on dt.subject = fr.subject) fr where rank <= 78),
ln as (select *, greatest(2, round_even(4.8e0 / dt, 0)::int) as pl, greatest(2, round_even(8e0 / dt, 0)::int) as f0, greatest(3, round_even(18e0 / dt, 0)::int) as f1 from ch),
tb as (select subject, kind, rank, t, seq as a, least(seq + case kind when 'short_pulse' then 2 + floor(u0 * (pl - 2 + 1))::int when 'flatline_dropout' then f0 + floor(u0 * (greatest(f0, f1) - f0 + 1))::int else 1 end, n) as b,
case kind when 'isolated_spike' then (case when u1 < 0.5 then -1 else 1 end) * (4 + u2 * 8) when 'short_pulse' then (case when u1 < 0.5 then -1 else 1 end) * (3 + u2 * 6) when 'hard_range_outlier' then case when u3 < 0.5 then 60 + u2 * 22 else 132 + u2 * 23 end else 0 end as amp from ln)"""


@query(f"""with {US}, {_COUNTED} select subject, kind, a::bigint as start, b::bigint as "end", round(t, 3) as t_start, (b - a)::bigint as n, round(amp, 6) as amplitude from tb""")
def artifact_table(spark, sf):
    """Intervals of injected artifacts, exact in number."""
    df = event_series(spark, sf, "user_id").withColumn("event", F.col("p") > 150)
    return evaluate.semisynthetic_counted(df, event="event")["table"].select("subject", "kind", "start", "end", *_r("t_start", n=3), "n", *_r("amplitude"))


@query(f"""with {US}, {_COUNTED}, {DIFF}, sd as (select subject, 1.4826e0 * mad(dp) as sd from d group by 1),
nz as (select s.*, p + 0.35e0 * sd * sqrt(-2 * ln(1 - {_drawn_sql("noise", 0)})) * cos(2 * pi() * {_drawn_sql("noise", 1)}) as v0 from (select s.*, sd from s join sd on sd.subject = s.subject) s),
iv as (select *, unnest(range(a, b)) as seq from tb), mk as (select subject, seq, sum(case kind when 'isolated_spike' then amp when 'short_pulse' then amp * sin(pi() * (seq - a) / greatest(b - a - 1, 1)) end) as add, max(case when kind = 'flatline_dropout' then (rank, a, amp) end) as fl, max(case when kind = 'hard_range_outlier' then (rank, a, amp) end) as ou from iv group by 1, 2),
v as (select nz.*, nz.v0 + coalesce(add, 0) as v, fl, ou, add is not null or fl is not null or ou is not null as artifact from nz left join mk on mk.subject = nz.subject and mk.seq = nz.seq)
select v.subject, v.seq::bigint as seq, round(coalesce(v.ou[3], h.v, v.v), 5) as observed, v.artifact from v left join v h on h.subject = v.subject and h.seq = v.fl[2]""")
def semisynthetic_counted(spark, sf):
    """Samples with noise and artifacts of exact number, and their mask."""
    df = event_series(spark, sf, "user_id").withColumn("event", F.col("p") > 150)
    return evaluate.semisynthetic_counted(df, event="event")["samples"].select("subject", "seq", *_r("observed", n=5), "artifact")


def _semisynthetic(spark, sf):
    df = event_series(spark, sf).withColumn("event", F.col("p") > 150)
    return evaluate.semisynthetic(df, event="event")


@query()
def ablation_study(spark, sf):
    out = reports.ablation(_semisynthetic(spark, sf), low=1.0, high=400.0)
    return out.select("variant", "subject", *_r("energy_raw", "energy_clean", n=0), *_r("energy_reduction", n=2), *_r("artifact_ratio", "event_ratio", "rmse", "corr", "artifact_f1", "artifact_recall", "mean_event_iou", n=4))


@query(f"""with {EV}, s1 as (select *, p * 0.9e0 + 3 as clean, p > 60 as event, seq % 4 = 1 as artifact, p > 100 or seq % 5 = 0 as true_artifact from s), m as (select *, lag(event) over ({W}) or p > 200 as b0 from s1), mm as (select *, coalesce(b0, p > 200, false) as true_event from m),
c as (select subject, sqrt(avg((clean - p) ** 2)) as rmse, corr(clean, p) as corr, sum((artifact and true_artifact)::int)::double as tp, sum((artifact and not true_artifact)::int)::double as fp, sum((not artifact and true_artifact)::int)::double as fn from mm group by 1),
k as (select *, tp / (tp + fp + 1e-9) as pr, tp / (tp + fn + 1e-9) as rc from c),
ta as (select subject, seq, t, row_number() over ({W}) - row_number() over (partition by subject, true_event order by seq) as r, true_event as f from mm), tr as (select subject, min(seq) as s0, max(seq) as s1, min(t) as t0, max(t) as t1 from ta where f group by subject, r),
tb as (select subject, seq, t, row_number() over ({W}) - row_number() over (partition by subject, event order by seq) as r, event as f from mm), pr as (select subject, min(seq) as s0, max(seq) as s1, min(t) as t0, max(t) as t1 from tb where f group by subject, r),
j as (select tr.subject, tr.s0 as ts, pr.s0 as ps, coalesce((least(tr.s1, pr.s1) - greatest(tr.s0, pr.s0) + 1) / ((tr.s1 - tr.s0 + 1) + (pr.s1 - pr.s0 + 1) - (least(tr.s1, pr.s1) - greatest(tr.s0, pr.s0) + 1)), 0) as iou, pr.t0 - tr.t0 as oe, pr.t1 - tr.t1 as fe from tr left join pr on tr.subject = pr.subject and pr.s0 <= tr.s1 and pr.s1 >= tr.s0),
e as (select subject, avg(iou) as iou, avg(abs(oe)) as oe, avg(abs(fe)) as fe from (select *, row_number() over (partition by subject, ts order by iou desc, ps) as r from j) where r = 1 group by 1)
select k.subject, round(rmse, 6) as rmse, round(corr, 6) as corr, round(2 * pr * rc / (pr + rc + 1e-9), 6) as artifact_f1, round(rc, 6) as artifact_recall, round(iou, 6) as mean_event_iou, round(oe, 3) as mean_abs_onset_error, round(fe, 3) as mean_abs_offset_error from k join e on e.subject = k.subject""")
def semisynthetic_evaluation(spark, sf):
    df = event_series(spark, sf).withColumn("clean", F.col("p") * 0.9 + 3).withColumn("true", F.col("p")).withColumn("event", F.col("p") > 60)
    df = df.withColumn("artifact", F.col("seq") % 4 == 1).withColumn("true_artifact", (F.col("p") > 100) | (F.col("seq") % 5 == 0))
    df = df.withColumn("true_event", F.coalesce(F.lag("event").over(series.ordered()) | (F.col("p") > 200), F.col("p") > 200))
    out = evaluate.evaluate_semisynthetic(df)["summary"]
    return out.select("subject", *_r("rmse", "corr", "artifact_f1", "artifact_recall", "mean_event_iou"), *_r("mean_abs_onset_error", "mean_abs_offset_error", n=3))


@query(f"with {EV} select subject, seq::bigint as seq, round(p * 0.5e0, 6) as reference, p > 60 as event from s")
def clean_reference(spark, sf):
    df = event_series(spark, sf).withColumn("clean", F.col("p") * 0.5).withColumn("event", F.col("p") > 60)
    return evaluate.clean_reference(df).select("subject", "seq", *_r("reference"), "event")


@query()
def clean_reference_by_smoothing(spark, sf):
    return evaluate.clean_reference(event_series(spark, sf)).select("subject", "seq", *_r("reference", n=4), "event")


_NAMES = {"click": "p_Tau", "view": "p_SampEn__mean", "purchase": "p_RQA_epsilon__iqr", "error": "p_PS_Eig1", "signup": "p_NumPoints__std", "scroll": "p_HFD"}
_NAMED = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in _NAMES.items()) + " else 'p_RQA_DET' end"


@query(f"""with l as (select user_id as subject, {_NAMED} as feature, avg(value) as value from events group by 1, 2)
select subject, feature, round(value, 6) as value, case when contains(feature, '_PS_') then 'phase_space' when contains(feature, '_RQA_') then 'recurrence' when regexp_matches(feature, '_(SampEn|PermEn)') then 'entropy' when regexp_matches(feature, '_(HFD|KFD|PFD)') then 'fractal' when contains(feature, '_ApproxLLE') then 'divergence' else 'basic' end as kind
from l where not regexp_matches(feature, '_(Tau|EmbeddingDim|EmbeddedVectors|NumPoints|RQA_epsilon)(__[A-Za-z0-9]+)?$')""")
def biomarker_features(spark, sf):
    """Features of users, named by kind of event, without those that only describe an embedding."""
    rows = table(spark, sf, "events").groupBy(F.col("user_id").alias("subject"), F.expr(_NAMED).alias("feature")).agg(F.avg("value").alias("value"))
    return features.drop_non_biomarkers(rows).select("subject", "feature", *_r("value"), features.feature_group(F.col("feature")).alias("kind"))
