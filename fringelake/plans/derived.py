"""Named queries of corruptions, models, gain tables, dirty images, polarised and movie terms and statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import calibration, closure, imaging, jones, models, polarimetry, raster, statistics, terms
from ..operators import visibility as V
from .catalog import AMP, GAINS_SQL, KEYS, QUERIES, SIDE, gains, query, rounded, staged
from .extended import FP, GAUSS, POS, SCAN_TABLE, full, modelled, positive

ENDS = "ends as (select distinct time, site, cast(substr(site,2) as int) k from (select time, t1 site from vis union all select time, t2 from vis))"


def _matrices(vis, leak: float):
    """A gain of 1 + site/100 in the right hand, leakages if any, and feeds that turn with the site."""
    k = F.substring("site", 2, 9).cast("double")
    ends = vis.select("time", F.explode(F.array("t1", "t2")).alias("site")).distinct()
    numbers = {"r_re": 1 + 0.01 * k, "r_im": F.lit(0.0), "l_re": F.lit(1.0), "l_im": F.lit(0.0), "dr_re": leak * k, "dr_im": F.lit(leak), "dl_re": F.lit(-leak), "dl_im": leak * k, "feed": 0.05 * k}
    return jones.matrices(ends.withColumns(numbers))


K1, K2 = "cast(substr(t1,2) as int)", "cast(substr(t2,2) as int)"
SIZE = f"((1+1e-2*{K1})*(1+1e-2*{K2}))"
TURN = f"(5e-2*({K2}-{K1}))"


@query(
    f"{FP}, z as (select *, vis_re+vvis_re a, vis_im+vvis_im b, vis_re-vvis_re c, vis_im-vvis_im d from fp)@@select [time] time, t1, t2, [{SIZE}*(a*cos({TURN})-b*sin({TURN}))] rrvis_re, [{SIZE}*(a*sin({TURN})+b*cos({TURN}))] rrvis_im, [c*cos({TURN})+d*sin({TURN})] llvis_re, [sqrt(sigma*sigma+vsigma*vsigma)*{SIZE}] rrsigma from z"
)
def jones_gains_and_feeds(vis):
    return jones.apply(polarimetry.switch(full(vis), "circ"), _matrices(vis, 0.0), errors=True).select(*KEYS, "rrvis_re", "rrvis_im", "llvis_re", "rrsigma")


@query(f"{FP}@@select [time] time, t1, t2, [vis_re+vvis_re] rrvis_re, [vis_im-vvis_im] llvis_im, [qvis_re-uvis_im] rlvis_re, [qvis_im-uvis_re] lrvis_im from fp")
def jones_taken_out_again(vis):
    """Corruptions with leakages, then their inverse: what was there before."""
    j = _matrices(vis, 0.02)
    broken = jones.apply(polarimetry.switch(full(vis), "circ"), j)
    return jones.apply(broken, jones.invert(j)).select(*KEYS, "rrvis_re", "llvis_im", "rlvis_re", "lrvis_im")


SOURCE = [models.Component("point", 0.5, x=1e-10, y=-2e-10), models.Component("circ_gauss", 2.0, fwhm=2e-10), models.Component("gauss", 1.0, major=3e-10, minor=1e-10, angle=0.4)]
B = "(9.869604401089358e0/(4*ln(2e0)))"


@query(
    f"z as (select *, 6.283185307179586e0*(u*1e-10-v*2e-10) t, 2*exp(-{B}*(u*u+v*v)*power(2e-10,2)) + exp(-{B}*(power(3e-10*(u*sin(4e-1)+v*cos(4e-1)),2)+power(1e-10*(u*cos(4e-1)-v*sin(4e-1)),2))) g from vis)@@select [time] time, t1, t2, [5e-1*cos(t)+g] mod_re, [5e-1*sin(t)] mod_im from z"
)
def sample_model(vis):
    return models.model_visibilities(vis, SOURCE, "mod").select(*KEYS, "mod_re", "mod_im")


@query("p as (select cast(i as int) i, (35e-1-i)*(2e-9/8) x from range(8) r(i)), w as (select *, 1/(sigma*sigma) w from vis)@@select b.i*8+a.i place, [sum(w*(vis_re*cos(6.283185307179586e0*(a.x*u+b.x*v))+vis_im*sin(6.283185307179586e0*(a.x*u+b.x*v))))/sum(w)] \"value\" from w, p a, p b group by a.i, b.i")
def dirty_image(vis):
    sums = imaging.normal_sums(vis, 8, 2e-9 / 8)
    rows = [(k, float(x)) for k, x in enumerate(imaging.dirty_image(sums).ravel())]
    return vis.sparkSession.createDataFrame(rows, "place long, value double")


@query(f"{GAUSS}, z as (select fp.*, md.mod_re, md.mod_im from fp join md using (time, t1, t2)), p as (select *, qvis_re-uvis_im-(1e-1*mod_re-5e-2*mod_im) a, qvis_im+uvis_re-(1e-1*mod_im+5e-2*mod_re) b from z)@@select [sum((a*a+b*b)/(qsigma*qsigma+usigma*usigma))/(2*count(*))] chisq from p")
def chisq_pvis(vis):
    return terms.chisq_polarised(_with_polarised_model(vis), "pvis")


@query(f"{GAUSS}, z as (select fp.*, md.mod_re, md.mod_im from fp join md using (time, t1, t2)), p as (select *, vvis_re-2e-2*mod_re a, vvis_im-2e-2*mod_im b from z)@@select [sum((a*a+b*b)/(vsigma*vsigma))/(2*count(*))] chisq from p")
def chisq_vvis(vis):
    return terms.chisq_polarised(_with_polarised_model(vis), "vvis")


@query(
    f"""{FP}, z as (select *, vis_re*vis_re+vis_im*vis_im n, qvis_re-uvis_im pr, qvis_im+uvis_re pi from fp), m as (select *, (pr*vis_re+pi*vis_im)/n a, (pi*vis_re-pr*vis_im)/n b from z)
    @@select [sum((power(a-1e-1,2)+power(b-5e-2,2))/((qsigma*qsigma+usigma*usigma+sigma*sigma*(a*a+b*b))/n))/(2*count(*))] chisq from m"""
)
def chisq_m(vis):
    return terms.chisq_polarised(_with_polarised_model(vis), "m")


def _with_polarised_model(vis):
    """Model Q and U are 0.1 and 0.05 of the model I, V is 0.02 of it."""
    share = {"modq": 0.1, "modu": 0.05, "modv": 0.02}
    return full(modelled(vis)).withColumns({f"{n}_{p}": k * F.col(f"mod_{p}") for n, k in share.items() for p in ("re", "im")})


GAINS_4 = f"{GAINS_SQL}, two as (select site, time, g_re r_re, g_im r_im, 5e-1*g_re l_re, -g_im l_im from gains)"


def two_hands(vis):
    return gains(vis.sparkSession).select("site", "time", F.col("g_re").alias("r_re"), F.col("g_im").alias("r_im"), (0.5 * F.col("g_re")).alias("l_re"), (-F.col("g_im")).alias("l_im"))


@query(f"{GAINS_4}@@select site, [time] time, [r_re/(r_re*r_re+r_im*r_im)] r_re, [-r_im/(r_re*r_re+r_im*r_im)] r_im, [l_re/(l_re*l_re+l_im*l_im)] l_re, [-l_im/(l_re*l_re+l_im*l_im)] l_im from two")
def invert_gains(vis):
    return calibration.invert_gains(two_hands(vis))


@query(f"{GAINS_4}, lo as (select site, min(least(sqrt(r_re*r_re+r_im*r_im), sqrt(l_re*l_re+l_im*l_im))) m from two group by site)@@select site, [time] time, [r_re*case when m<75e-2 then 75e-2/m else 1 end] r_re, [l_im*case when m<75e-2 then 75e-2/m else 1 end] l_im from two join lo using (site)")
def enforce_positive(vis):
    return calibration.raise_gains(two_hands(vis)).select("site", "time", "r_re", "l_im")


@query(
    f"{GAINS_4}, sz as (select site, sqrt(r_re*r_re+r_im*r_im) s from two union all select site, sqrt(l_re*l_re+l_im*l_im) from two), lo as (select site, median(s) m, avg(s) a from sz group by site)"
    "@@select site, [time] time, [r_re/case when m<9e-1 then m else 1 end] r_re, [l_im/case when a<8e-1 then a else 1 end] l_im from two join lo using (site)"
)
def enforce_positive_means(vis):
    """By the median for one hand's column, by the mean for the other's."""
    one = calibration.raise_gains(two_hands(vis), None, 0.9, "median").select("site", "time", "r_re")
    two = calibration.raise_gains(two_hands(vis), None, 0.8, "mean").select("site", "time", "l_im")
    return one.join(two, ["site", "time"])


@query(f"{GAINS_4}, {SCAN_TABLE}@@select site, [(t_start+t_stop)/2] time, [avg(r_re)] r_re, [avg(l_im)] l_im from two join sc on time between t_start and t_stop group by site, t_start, t_stop")
def caltable_scan_avg(vis):
    return calibration.average_gains(two_hands(vis), V.scans(vis, 0.0165)).select("site", "time", "r_re", "l_im")


@query(
    f"""{GAINS_SQL}, other as (select site, time+625e-3 "time", 17310000007e-10*g_re g_re, g_im from gains), tt as (select site, time from gains union select site, time from other),
    a as (select tt.*, coalesce(max(case when g.time=tt.time then g.g_re end), avg(g.g_re), 1) re, coalesce(max(case when g.time=tt.time then g.g_im end), avg(g.g_im), 0) im from tt left join gains g on g.site=tt.site and abs(g.time-tt.time)<7e-1 and tt.time<=1e1 group by all),
    b as (select tt.*, coalesce(max(case when g.time=tt.time then g.g_re end), avg(g.g_re), 1) re, coalesce(max(case when g.time=tt.time then g.g_im end), avg(g.g_im), 0) im from tt left join other g on g.site=tt.site and abs(g.time-tt.time)<7e-1 and tt.time>=625e-3 group by all)
    @@select site, [time] time, [a.re*b.re-a.im*b.im] g_re, [a.re*b.im+a.im*b.re] g_im from a join b using (site, time)"""
)
def merge_gains(vis):
    """Two tables whose knots lie half a step apart, so that each is interpolated at the middle of its own."""
    one = gains(vis.sparkSession)
    return V.merge_gains(one, one.select("site", (F.col("time") + 0.625).alias("time"), (1.7310000007 * F.col("g_re")).alias("g_re"), "g_im"))


@query(
    f"""{GAINS_SQL}, n as (select tt.time, site, arg_min(g_re, struct_pack(d := abs(gains.time-tt.time), t := gains.time)) r, arg_min(g_im, struct_pack(d := abs(gains.time-tt.time), t := gains.time)) i from (select distinct time from vis) tt, gains group by all),
    j as (select vis.*, g.r*h.r+g.i*h.i gr, g.i*h.r-g.r*h.i gi from vis join n g on vis.time=g.time and t1=g.site join n h on vis.time=h.time and t2=h.site)@@select [time] time, t1, t2, [vis_re*gr-vis_im*gi] vis_re, [vis_re*gi+vis_im*gr] vis_im, [sigma*sqrt(gr*gr+gi*gi)] sigma from j"""
)
def applycal_nearest(vis):
    return V.apply_gains(vis, gains(vis.sparkSession), "nearest", extrapolate=True).select(*KEYS, "vis_re", "vis_im", "sigma")


@query("select [time] time, t1, t2 from vis where not (time between 1e0 and 3e0 and 'S2' in (t1, t2) and 'S4' in (t1, t2))")
def flag_ut_range_baseline(vis):
    return V.flag(vis, V.outside_hours_of(1.0, 3.0, "S2", "S4")).select(*KEYS)


@query("e as (select t1 site, AMP/sigma s from vis union all select t2, AMP/sigma from vis), m as (select site, median(s) snr from e group by site)@@select site, [snr] snr, cast(row_number() over (order by snr desc, site) as int) ord from m")
def reorder_tarr_snr(vis):
    return V.station_order(vis)


@query(f"{SCAN_TABLE}, w as (select t_start, t_stop+2e-1 t_stop from sc), b as (select *, max(t_stop) over (order by t_start, t_stop rows between unbounded preceding and 1 preceding) p from w), l as (select *, sum(case when t_start<=p then 0 else 1 end) over (order by t_start, t_stop) label from b)@@select cast(label as bigint) label, [min(t_start)-1e-5] t_start, [max(t_stop)+1e-5] t_stop from l group by label")
def scan_bins(vis):
    return V.merge_intervals(V.scans(vis, 0.0165).withColumn("t_stop", F.col("t_stop") + 0.2))


PHASE = "atan2(vis_im,vis_re)"


@query(f"c as (select t1, t2, avg(cos({PHASE})) c, avg(sin({PHASE})) s, count(*) n from vis group by t1, t2)@@select t1, t2, [atan2(s,c)/DEG] mean, [case when n>1 then sqrt(-2*ln(least(sqrt(c*c+s*s),1)))/DEG end] deviation, [case when n>1 then sqrt(-2*ln(least(sqrt(c*c+s*s),1)))/DEG/sqrt(n) end] error from c")
def circular_phases(vis):
    phase = F.degrees(F.atan2("vis_im", "vis_re"))
    return vis.groupBy("t1", "t2").agg(statistics.circular_mean(phase).alias("mean"), statistics.circular_deviation(phase).alias("deviation"), statistics.circular_error(phase).alias("error"))


@query(f"d as (select t1, t2, abs({AMP}-lag({AMP}) over (partition by t1, t2 order by time)) d from vis)@@select t1, t2, [avg(d)] variation, count(*) n from d where d is not null group by t1, t2")
def amplitude_variation(vis):
    return statistics.variation(vis.withColumn("amp", V.amp()), ["t1", "t2"], "amp")


@query("select [time] time, printf('%02d:%02d:%2.4f', cast(floor(time) as bigint), cast(floor((time-floor(time))*60) as bigint), (time-floor(time)-floor((time-floor(time))*60)/60)*3600) gmt from vis where t1='S0'")
def gmt_strings(vis):
    return vis.filter("t1 = 'S0'").select("time", scalars.gmt_text(F.col("time")).alias("gmt"))


@query("z as (select *, u*1e-9 o, v*1e-9 w from vis)@@select [time] time, t1, t2, [case when o=0 then 1 else 2/o*sin(o/2) end] rect, [case when o=0 then 1 else 4/(o*o)*power(sin(o/2),2) end] triangle, [exp(-o*o/18)] gauss, [case when w=0 then 1 else 2*(3/w*sin(w/2)-cos(w/2))*power(2/w*sin(w/2),3) end] cubic from z")
def pulse_transforms(vis):
    o, w = F.col("u") * 1e-9, F.col("v") * 1e-9
    return vis.select(*KEYS, *[scalars.pulse_transform(k, w if k == "cubic" else o, 1.0).alias(k) for k in ("rect", "triangle", "gauss", "cubic")])


POL = f"{POS}, po as (select image_id, i k, ix, iy, x i, 1e-1*x q, 2e-1*x*p u, 5e-2*x v from pr), ml as (select *, sqrt(q*q+u*u)/i m from po)"


def polarised(img):
    own = positive(img)
    return own.withColumns({"i": F.col("pix"), "q": F.transform("pix", lambda x: 0.1 * x), "u": F.zip_with("pix", "prior", lambda x, p: 0.2 * x * p), "v": F.transform("pix", lambda x: 0.05 * x)})


STEP = "case when ix<7 then lead({0},1) over w else 0 end - {0}"
DOWN = "case when iy<7 then lead({0},8) over w else 0 end - {0}"


@query(
    f"{POL}, s as (select *, {STEP.format('q')} qr, {DOWN.format('q')} qd, {STEP.format('u')} ur, {DOWN.format('u')} ud, {STEP.format('v')} vr, {DOWN.format('v')} vd from ml window w as (partition by image_id order by k))"
    "@@select image_id, [-sum(i*ln(m))/2] msimple, [-sum(i*((1+m)/2*ln((1+m)/2)+(1-m)/2*ln((1-m)/2)))/2] hw, [-sum(sqrt(qr*qr+qd*qd+ur*ur+ud*ud))/2] ptv, [-power(sum(v)-5e-1,2)/25e-2] vflux, [-sum(abs(v))/5e-1] l1v, [-sum(v*v)/25e-2] l2v, [-sum(sqrt(vr*vr+vd*vd))/5e-1] vtv, [-sum(vr*vr+vd*vd)/25e-2] vtv2 from s group by image_id",
    "images",
)
def image_polarised_terms(img):
    return terms.polarised(polarised(img), SIDE, 2.0, 0.5)


@query(f"{POL}@@select image_id, [sum(i)] flux, [sqrt(power(sum(q),2)+power(sum(u),2))/sum(i)] linear, [sum(v)/sum(i)] circular, [atan2(sum(u),sum(q))/2] angle, [sum(m*i)/sum(i)] mean_linear, [sum(abs(v))/sum(i)] mean_circular from ml group by image_id", "images")
def image_polarised_totals(img):
    return terms.polarised_totals(polarised(img))


@query(f"{POL}, a as (select *, 35e-1-ix x, 35e-1-iy y from ml), t as (select *, m.m mode, atan2(x,y) t from a, (values (0),(1),(2)) m(m) where sqrt(x*x+y*y) between 1 and 3)@@select image_id, cast(mode as int) m, [sum(q*cos(mode*t)+u*sin(mode*t))/sum(i)] re, [sum(u*cos(mode*t)-q*sin(mode*t))/sum(i)] im from t group by image_id, mode", "images")
def image_azimuthal_modes(img):
    return terms.azimuthal_modes(polarised(img), SIDE, [0, 1, 2], 1.0, 3.0)


@query(f"{POS}, s as (select *, {STEP.format('x')} r, {DOWN.format('x')} d from pr window w as (partition by image_id order by i))@@select image_id, [-sum(power(x-p,2))/64] l2, [-sum(sqrt(r*r+d*d+1e-10))/64] tv from s group by image_id", "images")
def spectral_terms(img):
    return terms.spectral(positive(img), SIDE)


FRAMES = f"{POS}, fr as (select pr.*, img.movie_id from pr join img using (image_id))"


def frames(img):
    return positive(img).withColumn("frame", F.col("image_id"))


@query(f"{FRAMES}, b as (select *, lag(x) over (partition by movie_id, i order by image_id) y from fr), n as (select movie_id, count(distinct image_id) n from fr group by movie_id)@@select movie_id, [coalesce(sum(power(x-y,2)),0)/max(n)] d2, [coalesce(sum((x-y)/2*ln((x+1e-10)/(y+1e-10))),0)/max(n)] symkl from b join n using (movie_id) group by movie_id", "images")
def movie_step_terms(img):
    one, two = terms.movie_steps(frames(img), "D"), terms.movie_steps(frames(img), "SymKL")
    return one.select("movie_id", F.col("value").alias("d2")).join(two.select("movie_id", F.col("value").alias("symkl")), "movie_id")


@query(f"{FRAMES}, b as (select *, avg(x) over (partition by movie_id, i) y from fr)@@select movie_id, [sum(power(x-y,2))/count(distinct image_id)] d2, [sum(x*ln((x+1e-10)/(y+1e-10)))/count(distinct image_id)] kl from b group by movie_id", "images")
def movie_spread_terms(img):
    one, two = terms.movie_spread(frames(img), "D"), terms.movie_spread(frames(img), "KL")
    return one.select("movie_id", F.col("value").alias("d2")).join(two.select("movie_id", F.col("value").alias("kl")), "movie_id")


@query(f"{FRAMES}, f as (select movie_id, image_id, sum(x) f from fr group by all), d as (select movie_id, f-lag(f) over (partition by movie_id order by image_id) d from f)@@select movie_id, [coalesce(sum(d*d),0)] \"value\" from d group by movie_id", "images")
def movie_flux_term(img):
    return terms.movie_flux_steps(frames(img))


@query(f"{FRAMES}@@select movie_id, cast(i as int) i, [regr_intercept(ln(x), ln(1+image_id%7))] log_flux, [regr_slope(ln(x), ln(1+image_id%7))] index from fr group by movie_id, i", "images")
def spectral_index(img):
    return raster.spectral_index(positive(img).withColumn("rf", 1.0 + F.col("image_id") % 7)).withColumn("i", F.col("i").cast("int"))


@query("px as (select image_id, cast(unnest(pix) as double) x, generate_subscripts(pix,1)-1 i from img), m as (select i, round(avg(x),9) a from px group by i), o as (select i, row_number() over (order by a desc, i)-1 place from m)@@select image_id, cast(place as int) place, [x] \"value\" from px join o using (i)", "images")
def onedimize(img):
    return raster.by_mean_brightness(img)


@query("px as (select image_id, cast(unnest(pix) as double) x, generate_subscripts(pix,1)-1 i from img), c as (select image_id, (i//8+2)%8 iy, (i%8+5)%8 ix, x from px)@@select image_id, [sum(x*(iy*8+ix))] weighted from c group by image_id", "images")
def shift_image(img):
    moved = raster.each(img, raster.shift, SIDE, 2, -3)
    return moved.select("image_id", F.aggregate(F.transform("pix", lambda x, i: x * i), F.lit(0.0), lambda a, b: a + b).alias("weighted"))


@query("px as (select image_id, cast(unnest(pix) as double) x, generate_subscripts(pix,1)-1 i from img), c as (select image_id, i//16 iy, (i%8)//2 ix, sum(x) x from px group by all)@@select image_id, [sum(x*(iy*4+ix))] weighted, [sum(x)] flux from c group by image_id", "images")
def resample_image(img):
    """Pixels twice as wide."""
    small = raster.each(img, raster.resample, SIDE, 4, 4, 2.0)
    return small.select("image_id", F.aggregate(F.transform("pix", lambda x, i: x * i), F.lit(0.0), lambda a, b: a + b).alias("weighted"), F.aggregate("pix", F.lit(0.0), lambda a, b: a + b).alias("flux"))


@query(
    "px as (select image_id, cast(unnest(pix) as double) x, generate_subscripts(pix,1)-1 i from img), n as (select a.image_id, a.i, sum(b.x*((b.i%8)-(a.i%8))*(2-abs((b.i//8)-(a.i//8)))) r, sum(b.x*((b.i//8)-(a.i//8))*(2-abs((b.i%8)-(a.i%8)))) d from px a join px b on a.image_id=b.image_id and abs(a.i%8-b.i%8)<=1 and abs(a.i//8-b.i//8)<=1 where a.i%8 between 1 and 6 and a.i//8 between 1 and 6 group by all)@@select image_id, [sum(sqrt(r*r+d*d))] \"value\" from n group by image_id",
    "images",
)
def gradient_image(img):
    """Total of the gradient's length, but at the edges."""
    inner = F.filter(F.transform("pix", lambda x, i: F.when(F.pmod(i, F.lit(SIDE)).between(1, SIDE - 2) & F.floor(i / SIDE).between(1, SIDE - 2), x)), lambda x: x.isNotNull())
    return raster.each(img, raster.gradient, SIDE).select("image_id", F.aggregate(inner, F.lit(0.0), lambda a, b: a + b).alias("value"))


def _rows_only(f):
    """Register a function of the visibilities that SQL cannot express; tests hold it against what was put in."""

    def run(spark, sf_dir):
        return rounded(f(staged(spark, sf_dir)))

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    QUERIES[f.__name__] = run
    return f


def _in_scans(vis):
    return V.in_scans(modelled(vis), V.scans(vis, 0.0165))


@_rows_only
def self_cal(vis):
    """Gains of every scan against a Gaussian, then the calibrated visibilities."""
    tagged = _in_scans(vis)
    return calibration.apply_scan_gains(tagged, calibration.self_calibrate(tagged)).select(*KEYS, "vis_re", "vis_im", "sigma")


@_rows_only
def network_cal(vis):
    """Gains of every scan with S0 and S1 in one place, and S2 and S3 in another."""
    places = vis.sparkSession.createDataFrame([("S0", 1), ("S1", 1), ("S2", 2), ("S3", 2)], "site string, cluster int")
    return calibration.network_calibrate(_in_scans(vis), places, 3.0)


@_rows_only
def closure_phases_diagonal(vis):
    return statistics.diagonal_closures(closure.closure_phases(vis, minimal=True), vis)


@_rows_only
def clean_image(vis):
    """Components of an image of 16 by 16 pixels."""
    found, _ = imaging.clean(imaging.normal_sums(vis, 16, 1e-10), 200)
    return vis.sparkSession.createDataFrame([(k, float(x)) for k, x in enumerate(found.ravel())], "place long, value double")


@_rows_only
def bootstrap_amplitudes(vis):
    return statistics.bootstrap(vis.withColumn("amp", V.amp()), ["t1", "t2"], "amp", draws=50)
