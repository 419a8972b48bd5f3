"""Queries: calculated series, vibration, spectra and local coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightframe.functions import angles
from flightframe.operators import calc, geo, spectrum
from flightframe.plans.base import SAMPLES, query, rounded_all
from flightframe.plans.joins import SERIES, high_sql, interp_sql, pair_sql
from flightframe.plans.timing import GAP
from flightframe.sources.events import event_samples

#: A sample value turned to degrees that cross half turns often.
_ANGLES = "angles as (select log_id, series, seq, t, v * 7 - 180 as v from samples)"


def _angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_samples(spark, sf_dir).withColumn("v", F.col("v") * 7 - 180)


def _arithmetic(op: str, name: str) -> None:
    value = "case when vb = 0 then 'nan'::double else va / vb end" if op == "/" else f"va {op} vb"

    @query(f"math1_{name}", f"with {SAMPLES}, {pair_sql('click', 'view')} select log_id, 'CALC.click{op}view' as series, seq, t, round({value}, 6) + 0.0 as v from pair")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded_all(calc.two_series(event_samples(spark, sf_dir), "click", op, "view"), "v")


for _op, _name in (("+", "add"), ("-", "subtract"), ("*", "multiply"), ("/", "divide")):
    _arithmetic(_op, _name)


@query("math2_constant", f"""with {SAMPLES}, x as (select * from samples where series = 'view')
    select log_id, 'CALC.view+2.5' as series, seq, t, round(v + 2.5, 6) as v from x union all select log_id, 'CALC.view-2.5', seq, t, round(v - 2.5, 6) + 0.0 from x
    union all select log_id, 'CALC.view*2.5', seq, t, round(v * 2.5, 6) from x union all select log_id, 'CALC.view/2.5', seq, t, round(v / 2.5, 6) from x""")
def constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = event_samples(spark, sf_dir)
    first, *rest = (calc.with_constant(samples, "view", op, 2.5) for op in "+-*/")
    for other in rest:
        first = first.unionByName(other)
    return rounded_all(first, "v")


@query("math3_norm", f"with {SAMPLES}, {high_sql(SERIES)} select log_id, 'CALC.norm' as series, seq, t, round(sqrt(sum(other * other)), 6) as v from high group by log_id, t, seq")
def norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_all(calc.norm(event_samples(spark, sf_dir), SERIES), "v")


@query("math4_vector_magnitude", f"with {SAMPLES} select seq, round(sqrt(v * v + k * k + cast(log_id as double) * log_id), 6) as magnitude from samples")
def vector_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = event_samples(spark, sf_dir).select("seq", F.col("v").alias("x"), F.col("k").cast("double").alias("y"), F.col("log_id").cast("double").alias("z"))
    return rounded_all(calc.vector_magnitude(wide, ["x", "y", "z"], "magnitude"), "magnitude").select("seq", "magnitude")


def _unary(ident: str, name: str, function, sql: str) -> None:
    @query(f"{ident}_{name}", f"with {SAMPLES}, {_ANGLES} select log_id, 'CALC.{name}(view)' as series, seq, t, round({sql}, 6) + 0.0 as v from angles where series = 'view'")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded_all(calc.mapped(_angles(spark, sf_dir), "view", name, function), "v")


_unary("math5", "wrap_180", angles.wrap_180, "v + 180 - 360 * floor((v + 180) / 360) - 180")
_unary("math6", "wrap_360", angles.wrap_360, "v - 360 * floor(v / 360)")
_unary("math7", "rad2deg", F.degrees, "degrees(v)")
_unary("math8", "deg2rad", F.radians, "radians(v)")

#: Steps made short: by whole turns, so that none is over half a turn.
_UNWRAP = """stepped as (select *, v - lag(v) over (partition by log_id, series order by t, seq) as d from {source}),
short as (select *, d + 180 - 360 * floor((d + 180) / 360) - 180 as s from stepped),
fixed as (select *, case when d is null or abs(d) < 180 then 0 when s = -180 and d > 0 then 180 - d else s - d end as fix from short),
smooth as (select log_id, series, seq, t, v + sum(fix) over (partition by log_id, series order by t, seq) as v from fixed)"""


@query("win8_unwrap", f"with {SAMPLES}, {_ANGLES}, {_UNWRAP.format(source='angles')} select log_id, series, seq, round(v, 6) + 0.0 as v from smooth")
def unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_all(angles.unwrap(_angles(spark, sf_dir)), "v").select("log_id", "series", "seq", "v")


@query(
    "math9_angle_difference",
    f"""with {SAMPLES}, {_ANGLES}, {pair_sql("click", "view").split(", " + interp_sql("joined", "base_rows", "other_rows"))[0].replace("from samples", "from angles")},
    {_UNWRAP.format(source="other_rows")}, {interp_sql("joined", "base_rows", "smooth")}, d as (select *, case when series = 'click' then v - other else other - v end as x from joined)
    select log_id, 'CALC.ang_sub(click,view)' as series, seq, t, round(x + 180 - 360 * floor((x + 180) / 360) - 180, 6) + 0.0 as v from d""",
)
def angle_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_all(calc.angle_difference(_angles(spark, sf_dir), "click", "view"), "v")


@query("math9_angle_from_constant", f"with {SAMPLES}, {_ANGLES}, d as (select *, v - 45 as x from angles where series = 'view') select log_id, 'CALC.ang_sub(view)' as series, seq, t, round(x + 180 - 360 * floor((x + 180) / 360) - 180, 6) + 0.0 as v from d")
def angle_from_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_all(calc.angle_difference(_angles(spark, sf_dir), "view", 45), "v")


def _vibration_sql(source: str, name: str = "vibe") -> str:
    """Recursion over row numbers; times are scaled so that steps are some hundredths of a second."""
    return f"""{name}_n as (select *, row_number() over w as n, greatest(t - lag(t) over w, 1e-6) as dt from {source} window w as (partition by log_id, series order by t, seq)),
{name}_r as (select log_id, series, seq, t, n, v as floor, 0.0::double as state from {name}_n where n = 1 union all
    select x.log_id, x.series, x.seq, x.t, x.n, r.floor + least(x.dt / (x.dt + 1 / (2 * pi() * 5)), 1) * (x.v - r.floor) as f,
        case when x.n = 2 then power(x.v - (r.floor + least(x.dt / (x.dt + 1 / (2 * pi() * 5)), 1) * (x.v - r.floor)), 2)
             else r.state + least(x.dt / (x.dt + 1 / (2 * pi() * 2)), 1) * (power(x.v - (r.floor + least(x.dt / (x.dt + 1 / (2 * pi() * 5)), 1) * (x.v - r.floor)), 2) - r.state) end
    from {name}_r r join {name}_n x on x.log_id = r.log_id and x.series = r.series and x.n = r.n + 1)"""


_FAST = "fast as (select log_id, series, seq, t / 1e6 as t, v from samples)"


def _fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_samples(spark, sf_dir).select("log_id", "series", "seq", (F.col("t") / 1e6).alias("t"), "v")


@query("win11_vibration", f"with recursive {SAMPLES}, {_FAST}, {_vibration_sql('fast')} select log_id, series, seq, round(sqrt(greatest(state, 0)), 6) + 0.0 as v from vibe_r")
def vibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_all(calc.vibration(_fast(spark, sf_dir)), "v").select("log_id", "series", "seq", "v")


@query("math10_vibe", f"with recursive {SAMPLES}, {_FAST}, one as (select * from fast where series = 'view'), {_vibration_sql('one')} select log_id, seq, round(sqrt(greatest(state, 0)), 6) + 0.0 as v from vibe_r")
def vibe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_all(calc.vibration(_fast(spark, sf_dir).where("series = 'view'")), "v").select("log_id", "seq", "v")


@query(
    "math11_vibe_magnitude",
    f"with recursive {SAMPLES}, {_FAST}, {high_sql(SERIES).replace('from samples', 'from fast')}, axes as (select log_id, series, seq, t, other as v from high), {_vibration_sql('axes')} select log_id, seq, round(sqrt(sum(greatest(state, 0))), 6) + 0.0 as vibe_mag from vibe_r group by all",
)
def vibe_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_all(calc.vibration_magnitude(_fast(spark, sf_dir), SERIES), "vibe_mag").select("log_id", "seq", "vibe_mag")


@query(
    "math12_expression",
    f"""with {SAMPLES}, n as (select *, row_number() over (partition by log_id, series order by t, seq) as r from samples)
    select a.log_id, 'CALC.mix' as series, a.seq, a.t, round(sqrt(abs(a.v)) + 2 * b.v - sin(b.v), 6) + 0.0 as v from n a join n b on a.log_id = b.log_id and a.r = b.r and a.series = 'click' and b.series = 'view'""",
)
def expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_all(calc.expression(event_samples(spark, sf_dir), "sqrt(abs(click)) + 2 * view - sin(view)", "mix"), "v")


_NAMED = """named as (select log_id, case series when 'click' then 'GPS.Alt' when 'view' then 'GPS.AltMSL' else 'IMU[0].AccX' end as series, seq, t, floor(v) % 4 - 1 as v from samples where series in ('click', 'view', 'error')),
n as (select *, row_number() over (partition by log_id, series order by t, seq) as r from named),
x as (select a.log_id, a.seq, a.t, a.v as acc, m.v as msl, g.v as alt from n a join n m on a.log_id = m.log_id and a.r = m.r join n g on a.log_id = g.log_id and a.r = g.r where a.series = 'IMU[0].AccX' and m.series = 'GPS.AltMSL' and g.series = 'GPS.Alt'),
quotient as (select *, case when alt = 0 and msl = 0 then 'nan' when alt = 0 then case when msl > 0 then 'inf' else '-inf' end end as odd, msl / nullif(alt, 0) as q from x)"""


@query(
    "math12_named_expression",
    f"""with {SAMPLES}, {_NAMED} select log_id, 'MIX.q' as series, seq, t, odd, case when odd is null then round(q + 2 * (alt - acc) ** 2 + case when acc >= alt and acc <> 1 then 0.5 else 0 end, 6) + 0.0 end as v from quotient""",
)
def named_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of which one is the beginning of another, and divisors that are zero."""
    name = F.when(F.col("series") == "click", "GPS.Alt").when(F.col("series") == "view", "GPS.AltMSL").otherwise("IMU[0].AccX")
    samples = event_samples(spark, sf_dir).where(F.col("series").isin("click", "view", "error")).select("log_id", name.alias("series"), "seq", "t", (F.floor("v") % 4 - 1).cast("double").alias("v"))
    text = "GPS.AltMSL / GPS.Alt + 2*(GPS.Alt-IMU[0].AccX)**2 + np.where((IMU[0].AccX >= GPS.Alt) & ~(IMU[0].AccX == 1), 0.5, 0)"
    out = calc.expression(samples, text, "MIX.q")
    odd = F.when(F.isnan("v"), "nan").when(F.col("v") == float("inf"), "inf").when(F.col("v") == float("-inf"), "-inf")
    return rounded_all(out.withColumn("odd", odd).withColumn("v", F.when(odd.isNull(), F.col("v"))), "v").select("log_id", "series", "seq", "t", "odd", "v")


_DFT = """sized as (select *, count(*) over (partition by log_id, series) as n, avg(v) over (partition by log_id, series) as m, row_number() over (partition by log_id, series order by t, seq) - 1 as j from {source}),
windowed as (select *, (v - m) * (0.5 - 0.5 * cos(2 * pi() * j / nullif(n - 1, 0))) as y from sized where n > 1),
bins as (select w.log_id, w.series, b.bin, any_value(w.n) as n, any_value(fs) as fs, sum(y * cos(2 * pi() * b.bin * j / w.n)) as re, sum(y * sin(2 * pi() * b.bin * j / w.n)) as im
    from windowed w join (select distinct n, unnest(range(0, n // 2 + 1)) as bin from sized) b using (n) group by w.log_id, w.series, b.bin),
single as (select distinct log_id, series from sized where n = 1)"""


@query(
    "sig1_spectrum",
    f"""with {SAMPLES}, x as (select *, 10.0 as fs from samples), {_DFT.format(source="x")}
    select log_id, series, bin::int as bin, round(bin * fs / n, 6) as freq, round(sqrt(re * re + im * im) / n * 2, 6) + 0.0 as mag from bins union all select log_id, series, 0, 0, 0 from single""",
)
def one_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spectrum of every series at one rate."""
    asked = event_samples(spark, sf_dir).withColumn("fs", F.lit(10.0))
    return rounded_all(spectrum.spectrum(asked), "freq", "mag")


@query(
    "sig2_series_spectra",
    f"""with {SAMPLES}, lagged as (select *, t - lag(t) over w as dt, row_number() over w as r from samples where series in ('view', 'click') window w as (partition by log_id, series order by t, seq)),
    medians as (select log_id, series, median(dt) filter (dt > 0) as m from lagged group by all),
    split as (select *, sum(coalesce(dt > greatest({GAP} * m, 0.05), false)::int) over (partition by log_id, series order by t, seq) as g from lagged join medians using (log_id, series)),
    starts as (select *, min(r) over (partition by log_id, series, g) as r0 from split),
    runs as (select log_id, series, g, count(*) as c, min(r) as r0, median(dt) filter (dt > 0 and r > r0) as own, any_value(m) as m, max(t) - min(t) as d from starts group by log_id, series, g),
    best as (select *, case when m is null then 0 when own > 0 then 1 / own when d > 0 then (c - 1) / d else 0 end as fs, row_number() over (partition by log_id, series order by c desc, r0) as k from runs),
    x as (select s.log_id, s.series, s.seq, s.t, s.v, b.fs from split s join best b on s.log_id = b.log_id and s.series = b.series and s.g = b.g and b.k = 1), {_DFT.format(source="x")}
    select log_id, 'FFT.mag_' || series as series, 'FFT.freq_' || series as freq_series, bin::int as bin, round(bin * fs / n, 12) as freq, round(sqrt(re * re + im * im) / n * 2, 6) + 0.0 as mag from bins
    union all select log_id, 'FFT.mag_' || series, 'FFT.freq_' || series, 0, 0, 0 from single""".replace("min(r) as r0, median(dt) filter (dt > 0 and r > r0)", "any_value(r0) as r0, median(dt) filter (dt > 0 and r > r0)"),
)
def series_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = event_samples(spark, sf_dir)
    asked = samples.select("log_id").distinct().withColumn("series", F.explode(F.array(*map(F.lit, ["view", "click", "view", "unknown"]))))
    return spectrum.series_spectra(samples, asked, GAP).withColumns({"freq": F.round("freq", 12), "mag": F.round("mag", 6) + F.lit(0.0)})


_RADII = "6378137.0 * (1 - power(0.08181919, 2)) / power(1 - power(0.08181919, 2) * power(sin({lat}), 2), 1.5)", "6378137.0 / sqrt(1 - power(0.08181919, 2) * power(sin({lat}), 2))"


@query("geo1_earth_radii", f"with {SAMPLES} select seq, round({_RADII[0].format(lat='radians(v)')}, 3) as along, round({_RADII[1].format(lat='radians(v)')}, 3) as across from samples")
def earth_radii(spark: SparkSession, sf_dir: str) -> DataFrame:
    along, across = geo.radii(F.radians("v"))
    return event_samples(spark, sf_dir).select("seq", F.round(along, 3).alias("along"), F.round(across, 3).alias("across"))




@query(
    "geo2_local_coordinates",
    f"""with {SAMPLES}, p as (select seq, radians(24 + v / 1e4) as lat, radians(121 + k / 1e4) as lon, v as alt from samples)
    select seq, round((lon - radians(121.0)) * ({_RADII[1].format(lat="radians(24.0)")} + 10.0) * cos(radians(24.0)), 4) + 0.0 as e, round((lat - radians(24.0)) * ({_RADII[0].format(lat="radians(24.0)")} + 10.0), 4) + 0.0 as n, round(alt - 10.0, 6) + 0.0 as u from p""",
)
def local_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n, u = geo.enu(F.radians(24 + F.col("v") / 1e4), F.radians(121 + F.col("k") / 1e4), F.col("v"), F.radians(F.lit(24.0)), F.radians(F.lit(121.0)), F.lit(10.0))
    return event_samples(spark, sf_dir).select("seq", (F.round(e, 4) + F.lit(0.0)).alias("e"), (F.round(n, 4) + F.lit(0.0)).alias("n"), (F.round(u, 6) + F.lit(0.0)).alias("u"))


@query(
    "geo3_series_to_enu",
    f"""with {SAMPLES}, p as (select log_id, t, seq, case when series = 'error' then 0 else 24 + v / 1e4 end * case when log_id % 2 = 0 then 1e7 else 1 end as lat,
        case when series = 'error' then 0 else 121 + k / 1e4 end * case when log_id % 2 = 0 then 1e7 else 1 end as lon, case when series = 'error' then 0 else v end as alt from samples),
    s as (select log_id, t, seq, alt, case when max(abs(lat)) over w > 180 then lat / 1e7 else lat end as lat, case when max(abs(lon)) over w > 180 then lon / 1e7 else lon end as lon from p window w as (partition by log_id)),
    o as (select log_id, coalesce(arg_min(struct_pack(lat, lon, alt), struct_pack(t, seq)) filter (abs(lat) > 0.001 and abs(lon) > 0.001), arg_min(struct_pack(lat, lon, alt), struct_pack(t, seq))) as o from s group by log_id),
    j as (select s.*, o.o.lat as lat0, o.o.lon as lon0, o.o.alt as alt0, not (abs(lat) < 0.001 and abs(lon) < 0.001) as ok from s join o using (log_id))
    select log_id, t, seq, case when ok then round((radians(lon) - radians(lon0)) * ({_RADII[1].format(lat="radians(lat0)")} + alt0) * cos(radians(lat0)), 4) + 0.0 end as "E",
        case when ok then round((radians(lat) - radians(lat0)) * ({_RADII[0].format(lat="radians(lat0)")} + alt0), 4) + 0.0 end as "N", case when ok then round(alt - alt0, 6) + 0.0 end as "U",
        round(lat0, 6) as lat0, round(lon0, 6) as lon0, alt0 from j""",
)
def series_to_enu(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = event_samples(spark, sf_dir)
    bad, scale = F.col("series") == "error", F.when(F.col("log_id") % 2 == 0, 1e7).otherwise(1.0)
    rows = samples.select("log_id", "t", "seq", (F.when(bad, 0.0).otherwise(24 + F.col("v") / 1e4) * scale).alias("lat"), (F.when(bad, 0.0).otherwise(121 + F.col("k") / 1e4) * scale).alias("lon"), F.when(bad, 0.0).otherwise(F.col("v")).alias("alt"))
    out = geo.series_to_enu(rows)
    return out.withColumns({"E": F.round("E", 4) + F.lit(0.0), "N": F.round("N", 4) + F.lit(0.0), "U": F.round("U", 6) + F.lit(0.0), "lat0": F.round("lat0", 6), "lon0": F.round("lon0", 6)})


