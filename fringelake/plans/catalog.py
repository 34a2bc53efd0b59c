"""Named queries over the synthetic tables, with the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import closure, images
from ..operators import visibility as V
from ..sources.visibilities import ORACLE_VIS, visibilities

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
DEG = "(3.141592653589e0/180)"
AMP = "sqrt(vis_re*vis_re+vis_im*vis_im)"
KEYS = ("time", "t1", "t2")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(F.col(n), 6) + 0.0).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


_staged: dict[tuple[str, str], DataFrame] = {}


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The synthetic visibilities, kept by Spark for the session's next queries."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _staged:
        _staged[key] = visibilities(spark, sf_dir).persist()
    return _staged[key]


def forget() -> None:
    """Free what ``staged`` has kept."""
    for frame in _staged.values():
        frame.unpersist()
    _staged.clear()


def query(sql: str, of: str = "vis"):
    """Register a function of the visibilities (or images), its doubles rounded, with SQL over ``vis``.

    In the SQL, ``[x]`` stands for x rounded alike.
    """

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(f(staged(spark, sf_dir) if of == "vis" else pictures(spark, sf_dir)))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        head = f"with recursive vis as materialized ({ORACLE_VIS})" if of == "vis" else f"with img as ({ORACLE_IMG})"
        more, body = sql.split("@@") if "@@" in sql else ("", sql)
        text = f"{head}{', ' + more if more else ''} {body}"
        text = text.replace("[[", "\0").replace("]]", "\1").replace("[", "(round(cast(").replace("]", " as double), 6)+0.0)").replace("\0", "[").replace("\1", "]")
        ORACLE_SQL[f.__name__] = text.replace("AMP", AMP).replace("DEG", DEG)
        return f

    return add


ORACLE_IMG = "select vec_id image_id, label movie_id, embedding pix from embeddings"
SIDE = 8


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image_id"), F.col("label").alias("movie_id"), F.col("embedding").alias("pix"))


def gains(spark: SparkSession) -> DataFrame:
    k, i = F.col("k"), F.col("i")
    return spark.range(6).select(F.col("id").alias("k")).crossJoin(spark.range(9).select(F.col("id").alias("i"))).select(F.concat(F.lit("S"), k.cast("string")).alias("site"), (i * 1.25).alias("time"), (1.0 + 0.01 * k * i).alias("g_re"), (0.005 * i - 0.002 * k).alias("g_im"))


GAINS_SQL = "gains as (select concat('S', cast(k as string)) site, i*1.25e0 \"time\", 1e0+1e-2*k*i g_re, 5e-3*i-2e-3*k g_im from range(6) a(k), range(9) b(i))"


@query("select [time] time, t1, t2, [AMP] amp, [atan2(vis_im,vis_re)/DEG] phase, [AMP/sigma] snr, [sigma/AMP/DEG] sigma_phase, u, v, [sqrt(u*u+v*v)/1e9] uvdist from vis")
def unpack(vis):
    return V.unpack(vis).withColumn("uvdist", F.col("uvdist") / 1e9)


@query("select [time] time, t1, t2, [case when AMP>sigma then sqrt(AMP*AMP-sigma*sigma) else 0 end] amp from vis")
def unpack_debiased(vis):
    return V.unpack(vis, debias=True).select(*KEYS, "amp")


@query("select [time] time, t1, t2, u, v, [vis_re] vis_re, [vis_im] vis_im from vis union all select [time], t2, t1, -u+0.0, -v+0.0, [vis_re], [-vis_im] from vis")
def data_conj(vis):
    return V.conjugates(vis).select(*KEYS, "u", "v", "vis_re", "vis_im")


@query("select [time] time, t1, t2, [sigma] sigma from vis where AMP/sigma > 3")
def flag_low_snr(vis):
    return V.flag(vis, V.low_snr(3.0)).select(*KEYS, "sigma")


@query("select [time] time, t1, t2, [sigma] sigma from vis where not AMP/sigma > 3")
def flag_low_snr_flagged(vis):
    return V.flag(vis, V.low_snr(3.0), "flagged").select(*KEYS, "sigma")


@query("select [time] time, t1, t2, sigma < 9e-2 kept from vis")
def flag_high_sigma_both(vis):
    return V.flag(vis, V.high_sigma(0.09), "both").select(*KEYS, "kept")


@query("select [time] time, t1, t2, u, v from vis where sqrt(u*u+v*v) between 5e8 and 2e9")
def flag_uvdist(vis):
    return V.flag(vis, V.uvdist_between(5e8, 2e9)).select(*KEYS, "u", "v")


@query("select [time] time, t1, t2 from vis where t1 not in ('S1','S4') and t2 not in ('S1','S4')")
def flag_sites(vis):
    return V.flag(vis, V.no_site("S1", "S4")).select(*KEYS)


@query("select [time] time, t1, t2 from vis where not (t1 in ('S1','S4') and t2 in ('S1','S4'))")
def flag_bl(vis):
    return V.flag(vis, V.not_baseline("S1", "S4")).select(*KEYS)


@query("select [time] time, t1, t2 from vis where time <= 2 or time >= 4")
def flag_ut_range(vis):
    return V.flag(vis, V.outside_hours(2.0, 4.0)).select(*KEYS)


@query("f as (select * from (values (1e0,2e0,'S0'),(5e0,55e-1,'S3')) t(start,stop,site))@@select [time] time, t1, t2 from vis where not exists (select 1 from f where time>start and time<stop and (t1=site or t2=site))")
def flags_from_table(vis):
    return V.flag_table(vis, vis.sparkSession.createDataFrame([(1.0, 2.0, "S0"), (5.0, 5.5, "S3")], "start double, stop double, site string")).select(*KEYS)


@query("select [time] time, t1, t2, [sqrt(sigma*sigma+25e-4*(vis_re*vis_re+vis_im*vis_im))] sigma from vis")
def add_fractional_noise(vis):
    return V.fractional_noise(vis, 0.05).select(*KEYS, "sigma")


@query("k as (select *, exp(-2*9.869604401089358e0*power(2e-10/(2*sqrt(2*ln(2e0))),2)*(u*u+v*v)) k from vis)@@select [time] time, t1, t2, [vis_re*k] vis_re, [vis_im*k] vis_im, [sigma*k] sigma from k")
def taper(vis):
    return V.taper(vis, 2e-10).select(*KEYS, "vis_re", "vis_im", "sigma")


@query("z as (select sum(AMP/(sigma*sigma))/sum(1/(sigma*sigma)) z from vis where sqrt(u*u+v*v)<6e8), k as (select vis.*, case when sqrt(u*u+v*v)<6e8 then 2/z else 1 end k from vis, z)@@select [time] time, t1, t2, [vis_re*k] vis_re, [sigma*k] sigma from k")
def rescale_zbl(vis):
    return V.rescale_short(vis, 2.0, 6e8).select(*KEYS, "vis_re", "sigma")


def _full(vis):
    re, im = F.col("vis_re"), F.col("vis_im")
    return vis.withColumns({"qvis_re": 0.1 * re, "qvis_im": -0.05 * im, "uvis_re": 0.03 * im, "uvis_im": 0.02 * re, "vvis_re": 0.01 * re, "vvis_im": 0.04 * im})


@query("select [time] time, t1, t2, [1.01*vis_re] rrvis_re, [1.04*vis_im] rrvis_im, [0.99*vis_re] llvis_re, [0.96*vis_im] llvis_im, [0.1*vis_re-0.02*vis_re] rlvis_re, [-0.05*vis_im+0.03*vis_im] rlvis_im, [0.1*vis_re+0.02*vis_re] lrvis_re, [-0.05*vis_im-0.03*vis_im] lrvis_im from vis")
def switch_polrep_circ(vis):
    return V.to_circular(_full(vis)).select(*KEYS, *[f"{n}_{p}" for n in ("rrvis", "llvis", "rlvis", "lrvis") for p in ("re", "im")])


@query("select [time] time, t1, t2, [0.5e0*((vis_re+1e-2*vis_re)+(vis_re-1e-2*vis_re))] vis_re, [0.1*vis_re] qvis_re, [0.03*vis_im] uvis_re, [0.5e0*((vis_im+4e-2*vis_im)-(vis_im-4e-2*vis_im))] vvis_im from vis")
def polrep_round_trip(vis):
    return V.to_stokes(V.to_circular(_full(vis))).select(*KEYS, "vis_re", "qvis_re", "uvis_re", "vvis_im")


COHERENT = "select t1, t2, cast(floor(time*3.6e3/3e2) as bigint) bucket, avg(vis_re) re, avg(vis_im) im, sqrt(sum(sigma*sigma))/count(*) sg, avg(u) uu, avg(v) vv, sum(tint) tt, count(*) n from vis where AMP/sigma > 3 group by all"


@query(f"c as ({COHERENT})@@select t1, t2, bucket, [re] vis_re, [im] vis_im, [sg] sigma, [uu/1e9] u, [vv/1e9] v, [tt] tint, n, [(bucket+5e-1)*(3e2/3.6e3)] time from c")
def avg_coherent(vis):
    return V.coherent(V.flag(vis, V.low_snr(3.0)), 300.0).withColumns({"u": F.col("u") / 1e9, "v": F.col("v") / 1e9})


@query(
    """g as (select t1, t2, cast(floor(time*3.6e3/3e2) as bigint) bucket, avg(AMP*AMP) p, avg(sigma*sigma) q, median(sigma) m, count(*) n, sqrt(sum(sigma*sigma))/count(*) c, max(AMP) one from vis group by all),
    a as (select *, case when n=1 then one else sqrt(greatest(p-(2-1e0/n)*q,0)) end a from g), i as (select *, m/nullif(a,0) i from a)
    @@select t1, t2, bucket, n, [a] amp, [case when n=1 then m when a>0 then a*nullif(sqrt(1+2/sqrt(n)*i*sqrt(1+i*i))-1,0) else c end] sigma from i"""
)
def avg_incoherent(vis):
    return V.incoherent(vis.drop("u", "v"), 300.0)


SCANS = "tt as (select distinct time from vis), l as (select time, case when time-lag(time) over (order by time)>0.0165e0 then 1 else 0 end n from tt), s as (select time, sum(n) over (order by time) scan_id from l), sc as (select cast(scan_id as bigint) scan_id, min(time) t_start, max(time) t_stop, count(*) n_times from s group by scan_id)"


@query(f"{SCANS}@@select scan_id, [t_start] t_start, [t_stop] t_stop, n_times from sc")
def add_scans(vis):
    return V.scans(vis, 0.0165)


@query(
    f"{SCANS}, tg as (select vis.*, scan_id from vis join sc on time between t_start and t_stop), c as (select scan_id, t1, t2, count(*) n from tg group by all), m as (select scan_id, median(n) m from c group by scan_id), g as (select c.* from c join m using (scan_id) where n>=0.9*m), "
    "lf as (select tg.* from tg semi join g using (scan_id, t1, t2)), e as (select scan_id, count(*) e from g group by 1), f as (select scan_id, time from lf join e using (scan_id) group by scan_id, time, e having count(*)=e)@@select scan_id, [time] time, t1, t2 from lf semi join f using (scan_id, time)"
)
def filter_subscan_dropouts(vis):
    return V.subscan_dropouts(V.in_scans(vis, V.scans(vis, 0.0165)), 0.9).select("scan_id", *KEYS)


@query(
    "x as (select *, cast(round(time*3.6e9) as bigint) us from vis), w as (select time, t1, t2, avg(vis_re) over d re, avg(vis_im) over d im, avg(sigma*sigma) over d / sqrt(sum(sigma*sigma) over d) sg, count(*) over d n from x window d as (partition by t1, t2 order by us range between 119999999 preceding and current row))@@select [time-12e1/7.2e3] time, t1, t2, [re] vis_re, [im] vis_im, [sg] sigma, n from w"
)
def avg_moving(vis):
    return V.moving(vis, 120)


@query(
    "x as (select *, cast(round(time*3.6e9) as bigint) us, AMP amp from vis), w as (select *, list(amp) over (partition by t1, t2 order by us range between 199999999 preceding and 199999999 following) l from x), m as (select *, list_median(l) md from w), a as (select *, list_median(list_transform(l, lambda z: abs(z-md))) mad from m)@@select [time] time, t1, t2, [amp] amp from a where abs(amp-md)/(case when mad=0 then 1 else mad end)<2"
)
def flag_anomalous(vis):
    return V.anomalies(vis, 200, 2.0).select(*KEYS, "amp")


BISPEC = """b as (select a.time, a.t1, a.t2, c.t2 t3, (a.vis_re*b.vis_re-a.vis_im*b.vis_im) pr, (a.vis_re*b.vis_im+a.vis_im*b.vis_re) pi, c.vis_re cr, -c.vis_im ci,
    a.sigma*a.sigma/(a.vis_re*a.vis_re+a.vis_im*a.vis_im) + b.sigma*b.sigma/(b.vis_re*b.vis_re+b.vis_im*b.vis_im) + c.sigma*c.sigma/(c.vis_re*c.vis_re+c.vis_im*c.vis_im) r
    from vis a join vis b on a.time=b.time and a.t2=b.t1 join vis c on a.time=c.time and a.t1=c.t1 and b.t2=c.t2),
    bs as (select time, t1, t2, t3, pr*cr-pi*ci re, pr*ci+pi*cr im, sqrt(r) r from b), cp as (select *, atan2(im,re)/DEG cphase, r/DEG sigmacp from bs)"""


@query(f"{BISPEC}@@select [time] time, t1, t2, t3, [re] bispec_re, [im] bispec_im, [sqrt(re*re+im*im)*r] sigmab from bs")
def bispectra(vis):
    return closure.bispectra(vis.drop("u", "v"))


@query(f"{BISPEC}, fs as (select time, min(t1) t1 from vis group by time)@@select [time] time, t1, t2, t3, [cphase] cphase, [sigmacp] sigmacp from cp semi join fs using (time, t1)")
def closure_phases_min_set(vis):
    return closure.closure_phases(vis.drop("u", "v"), minimal=True)


@query(f"{BISPEC}@@select t1, t2, t3, cast(round_even(time*3.6e3/6e2, 0) as bigint) bucket, [atan2(avg(sin(cphase*DEG)),avg(cos(cphase*DEG)))/DEG] cphase, [sqrt(sum(sigmacp*sigmacp))/count(*)] sigmacp, [avg(time)*10000001e-7] time, count(*) n from cp group by t1, t2, t3, round_even(time*3.6e3/6e2, 0)")
def add_cphase_averaged(vis):
    means = closure.average_phases(closure.closure_phases(vis.drop("u", "v")), 600.0)
    # Off the ties of rounding, where the order of a sum would show.
    return means.withColumn("time", F.col("time") * 1.0000001)


@query(
    f"{BISPEC}, w as (select *, time-lag(time) over d dt, cphase-lag(cphase) over d+180 x, sqrt(sigmacp*sigmacp+power(lag(sigmacp) over d,2)) s from cp window d as (partition by t1,t2,t3 order by time)), z as (select t1,t2,t3, stddev_pop((x-360*floor(x/360)-180)/s) sd, count(*) n from w where dt<0.05e0 group by all)@@select [coalesce(median(sd),1)] factor from z where n>10"
)
def noise_rescale_factor(vis):
    return closure.noise_rescale(closure.closure_phases(vis), 0.05, 10)


@query("select [time] time, t1, t2 from vis a where sigma < 0.11 and exists (select 1 from vis b where b.sigma >= 0.09 and a.t1=b.t1 and a.t2=b.t2 and round_even(a.time/1e-1,0)=round_even(b.time/1e-1,0))")
def common_set(vis):
    return V.common_times(vis.filter("sigma < 0.11"), vis.filter("sigma >= 0.09"), 0.1).select(*KEYS)


@query(
    f"""{GAINS_SQL}, c as (select tt.time, a.site, case when a.time=b.time then a.g_re else a.g_re+(tt.time-a.time)/(b.time-a.time)*(b.g_re-a.g_re) end r, case when a.time=b.time then a.g_im else a.g_im+(tt.time-a.time)/(b.time-a.time)*(b.g_im-a.g_im) end i
    from (select distinct time from vis) tt join gains a on a.time<=tt.time and tt.time<a.time+1.25e0 join gains b on a.site=b.site and b.time>=tt.time and b.time<tt.time+1.25e0),
    j as (select vis.*, g.r*h.r+g.i*h.i gr, g.i*h.r-g.r*h.i gi from vis left join c g on vis.time=g.time and t1=g.site left join c h on vis.time=h.time and t2=h.site)@@select [time] time, t1, t2, [vis_re*gr-vis_im*gi] vis_re, [vis_re*gi+vis_im*gr] vis_im, [sigma*sqrt(gr*gr+gi*gi)] sigma from j"""
)
def applycal_linear(vis):
    return V.apply_gains(vis, gains(vis.sparkSession)).select(*KEYS, "vis_re", "vis_im", "sigma")


@query(
    "m as (select *, 3*exp(-2*9.869604401089358e0*power(2e-10/(2*sqrt(2*ln(2e0))),2)*(u*u+v*v)) m from vis)@@select [sum(((vis_re-m)*(vis_re-m)+vis_im*vis_im)/(sigma*sigma))/(2*count(*))] chisq_vis, [sum(power((AMP-m)/sigma,2))/count(*)] chisq_amp from m"
)
def chisq(vis):
    return V.chisq(vis, V.gaussian_model(3.0, 2e-10))


@query("p as (select cast(i as int) i, (i-35e-1)*(2e-9/8) x from range(8) r(i))@@select a.i ix, b.i iy, [avg(cos(6.283185307179586e0*(a.x*u+b.x*v)))] \"value\" from vis, p a, p b group by a.i, b.i")
def dirty_beam(vis):
    return V.dirty_beam(vis, 8, 2e-9)


@query("select [1e9/max(sqrt(u*u+v*v))] res_nano, [avg(u*u)/1e18] uu, [avg(v*v)/1e18] vv, [avg(2*u*v)/1e18] uv2 from vis")
def fit_beam(vis):
    m = V.beam_moments(vis)
    return m.select((F.col("res") * 1e9).alias("res_nano"), *[(F.col(c) / 1e18).alias(c) for c in ("uu", "vv", "uv2")])


PIX = "px as (select image_id, cast(unnest(pix) as double) x, generate_subscripts(pix,1)-1 i from img)"


@query(f"{PIX}@@select image_id, [sum(x)] flux, [sum(x*(i%8))/sum(x)] x, [sum(x*floor(i/8))/sum(x)] y, [max(x)] peak from px group by image_id", "images")
def image_moments(img):
    return images.moments(img, SIDE)


@query(
    f"{PIX}, d as (select image_id, x, i, case when i%8<7 then lead(x,1) over w - x else 0 end r, case when i<56 then lead(x,8) over w - x else 0 end b from px window w as (partition by image_id order by i))@@select image_id, [sum(abs(x))] l1, [sum(r*r+b*b)] tv2, [sum(sqrt(r*r+b*b))] tv from d group by image_id", "images"
)
def regularizers(img):
    return images.regularizers(img, SIDE)


@query(f"{PIX}@@select cast(i as int) i, [avg(x)] \"value\" from px group by i", "images")
def avg_image(img):
    return images.mean_image(img)


@query(f"{PIX}@@select movie_id, image_id frame, [sum(x)] flux from px join img using (image_id) group by movie_id, image_id", "images")
def light_curve(img):
    return images.light_curve(img.withColumn("frame", F.col("image_id")))


@query(f"{PIX}@@select image_id, cast(floor(i%8/4) as bigint) bx, cast(floor(i/32) as bigint) \"by\", [sum(x)] \"value\" from px group by image_id, floor(i%8/4), floor(i/32)", "images")
def block_sums(img):
    return images.block_sums(img, SIDE, 4)
