"""Named queries of gridded transforms, cubic gains, flags of baselines and state-space movies, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import flow, gridding, polarimetry, search, statespace
from ..operators import visibility as V
from ..operators.models import Component
from .catalog import KEYS, QUERIES, SIDE, pictures, query, staged
from .extended import CP, full

PIXEL = 2e-9 / 8
TAU = "6.283185307179586e0"
_CUBIC = "case when abs({s})<=1 then (15e-1*abs({s})-25e-1)*{s}*{s}+1 when abs({s})<2 then ((-5e-1*abs({s})+25e-1)*abs({s})-4)*abs({s})+2 else 0e0 end"


@query(
    f"t as (select *, u*(16*(2e-9/8)) a, v*(16*(2e-9/8)) b from vis), m as (select *, floor(a-2)+1+i ja, floor(b-2)+1+j jb, {TAU}*5e-1/16*(a+b) turn from t, range(4) p(i), range(4) q(j)),"
    f"k as (select *, a-ja sa, b-jb sb from m), w as (select *, ({_CUBIC.format(s='sa')})*({_CUBIC.format(s='sb')}) w from k)@@"
    "select cast(((jb%16)+16)%16 as int) cell_v, cast(((ja%16)+16)%16 as int) cell_u, [sum(w*(vis_re*cos(turn)-vis_im*sin(turn)))] re, [sum(w*(vis_re*sin(turn)+vis_im*cos(turn)))] im, [sum(w)] weight from w group by 1, 2"
)
def grid_cells(vis):
    """Sums of the visibilities on a grid of 16 cells a side, under the cubic kernel."""
    return gridding.cell_sums(vis, gridding.Grid(8, PIXEL, 2, "cubic"), "uniform")


_PLACES = "p as (select cast(i as int) i, (35e-1-i)*(2e-9/8) x from range(8) r(i))"


@query(f"{_PLACES}, w as (select *, 1/(sigma*sigma) w from vis)@@select b.i*8+a.i place, [sum(w*(vis_re*cos({TAU}*(a.x*u+b.x*v))+vis_im*sin({TAU}*(a.x*u+b.x*v))))/sum(w)] as value from w, p a, p b group by 1")
def dirty_image_gridded(vis):
    image = gridding.dirty_image(vis, gridding.Grid(8, PIXEL, width=14))
    return vis.sparkSession.createDataFrame([(k, float(x)) for k, x in enumerate(image.ravel())], "place long, value double")


@query(f"{_PLACES}, px as (select a.x x, b.x y, 1e0/(1+a.i+2*b.i) f from p a, p b)@@select [time] time, t1, t2, [sum(f*cos({TAU}*(u*x+v*y)))] mod_re, [sum(f*sin({TAU}*(u*x+v*y)))] mod_im from vis, px group by time, t1, t2")
def sample_vis_gridded(vis):
    """Visibilities of an image of 8 by 8 pixels, read from its grid."""
    iy, ix = np.indices((8, 8))
    return gridding.model_visibilities(vis, 1 / (1.0 + ix + 2 * iy), gridding.Grid(8, PIXEL, width=14), "mod").select(*KEYS, "mod_re", "mod_im")


def _cubic_gains(spark):
    """Knots of cubic polynomials of time, which a cubic spline through them equals."""
    k, t = F.col("k"), F.col("time")
    knots = spark.range(6).select(F.col("id").alias("k")).crossJoin(spark.range(13).select((F.col("id") * 0.75 + 0.01 * F.pmod(F.col("id") * 7, F.lit(5))).alias("time")))
    curve = lambda a, b: 1.0 + a * k * t * t * t - b * t * t
    return knots.select(F.concat(F.lit("S"), k.cast("string")).alias("site"), "time", curve(1e-4, 2e-3).alias("r_re"), (1e-2 * k - 1e-4 * t * t * t).alias("r_im"), curve(2e-4, 1e-3).alias("l_re"), (2e-4 * t * t * k).alias("l_im"))


_POLY = """c as (select *, cast(substr(t1, 2) as double) k1, cast(substr(t2, 2) as double) k2, time t, time >= 0 and time <= 9e0+1e-2*((12*7)%5) held from {vis}),
    g as (select *, 1+1e-4*k1*t*t*t-2e-3*t*t ra, 1e-2*k1-1e-4*t*t*t rb, 1+1e-4*k2*t*t*t-2e-3*t*t rc, 1e-2*k2-1e-4*t*t*t rd, 1+2e-4*k1*t*t*t-1e-3*t*t la, 2e-4*t*t*k1 lb, 1+2e-4*k2*t*t*t-1e-3*t*t lc, 2e-4*t*t*k2 ld from c)"""


@query(f"{_POLY.format(vis='vis')}@@select [time] time, t1, t2, [case when held then vis_re*(ra*rc+rb*rd)-vis_im*(rb*rc-ra*rd) end] vis_re, [case when held then vis_re*(rb*rc-ra*rd)+vis_im*(ra*rc+rb*rd) end] vis_im, [case when held then sigma*sqrt((ra*ra+rb*rb)*(rc*rc+rd*rd)) end] sigma from g")
def applycal_cubic(vis):
    gains = _cubic_gains(vis.sparkSession).select("site", "time", F.col("r_re").alias("g_re"), F.col("r_im").alias("g_im"))
    return V.apply_gains(vis, gains, "cubic").select(*KEYS, "vis_re", "vis_im", "sigma")


@query(f"{CP}, {_POLY.format(vis='cp')}@@select [time] time, t1, t2, [case when held then rr_re*(ra*rc+rb*rd)-rr_im*(rb*rc-ra*rd) end] rrvis_re, [case when held then rl_re*(ra*lc+rb*ld)-rl_im*(rb*lc-ra*ld) end] rlvis_re, [case when held then lr_re*(lb*rc-la*rd)+lr_im*(la*rc+lb*rd) end] lrvis_im, [case when held then ls*sqrt((la*la+lb*lb)*(lc*lc+ld*ld)) end] llsigma from g")
def applycal_hands(vis):
    """Both hands, by cubic curves."""
    return V.apply_hands(polarimetry.switch(full(vis), "circ"), _cubic_gains(vis.sparkSession), "cubic").select(*KEYS, "rrvis_re", "rlvis_re", "lrvis_im", "llsigma")


@query("select [time] time, t1, t2 from vis where not (time>1e0 and time<2e0 and 'S0' in (t1,t2)) and not (time>5e0 and time<55e-1 and t1='S2' and t2='S3') and not (time>6e0 and time<61e-1)")
def flags_of_baselines_and_all(vis):
    flags = vis.sparkSession.createDataFrame([(1.0, 2.0, "S0"), (5.0, 5.5, "S3-S2"), (6.0, 6.1, None)], "start double, stop double, site string")
    return V.flag_table(vis, flags).select(*KEYS)


_FRAME = "cast(dayno as bigint)//250"


@query(
    f"w as (select cast({_FRAME} as bigint) frame, 1e-4/(sigma*sigma) w, vis_re, vis_im, u, v from vis), px as (select b.i*2+a.i k, (5e-1-a.i)*1e-9 x, (5e-1-b.i)*1e-9 y from range(2) a(i), range(2) b(i)), s as ("
    f"select frame, p.k*4+q.k cell, sum(w*cos({TAU}*(u*(p.x-q.x)+v*(p.y-q.y)))) s from w, px p, px q group by all union all select frame, 16+p.k, sum(w*(vis_re*cos({TAU}*(u*p.x+v*p.y))+vis_im*sin({TAU}*(u*p.x+v*p.y)))) from w, px p group by all)@@"
    "select frame, cast(cell as bigint) cell, [s] as value from s"
)
def movie_information(vis):
    """The sums that a state-space movie of 2 by 2 pixels asks of the visibilities of each 250 days."""
    sums = statespace.frame_information(vis.withColumn("frame", F.expr("dayno div 250")), "frame", 2, 1e-9)
    whole = sums.select("frame", F.posexplode(F.concat("info", "seen")).alias("cell", "value"))
    return whole.select("frame", F.col("cell").cast("long").alias("cell"), (F.col("value") * 1e-4).alias("value"))


def _movie_states(spark, sf_dir):
    """Smoothed frames of 4 by 4 pixels, one for each 50 days, of a sky that changes at random."""
    n = 4
    vis = staged(spark, sf_dir).withColumn("frame", F.expr("dayno div 50"))
    # Days are counted from 1995 and every 50 of them have visibilities, but for the first year or so perhaps.
    first = vis.agg(F.min("frame")).first()[0] or 0
    frames = statespace.frame_information(vis.withColumn("frame", F.col("frame") - first), "frame", n, 1e-9)
    one = np.eye(n * n)
    states = statespace.smooth(frames, one, 0.5 * one, np.ones(n * n), 25.0 * one)
    return states.select("frame", F.get("mean", F.lit(0)).alias("corner"), F.aggregate("mean", F.lit(0.0), lambda s, x: s + x).alias("flux"))


QUERIES["movie_states"] = _movie_states


def _clips(img):
    """Movies of 50 consecutive images."""
    return img.select(F.expr("image_id div 50").alias("movie_id"), F.col("image_id").alias("frame"), "pix")


_CLIPS = (
    "px as (select cast(image_id as bigint)//50 movie_id, image_id frame, pix from img), pr as (select a.movie_id, a.frame, a.pix p, b.pix q from px a join px b on b.movie_id=a.movie_id and b.frame=a.frame+1),"
    "ij as (select *, cast(k as int) i, cast(k//8 as int) r, cast(k%8 as int) c from pr, range(64) t(k)), g as (select movie_id, frame, i, r, c, cast(p[[i+1]] as double) s, cast(q[[i+1]] as double)-cast(p[[i+1]] as double) d,"
    "(cast(p[[(r+1)%8*8+c+1]] as double)-cast(p[[(r+7)%8*8+c+1]] as double))/2 gr, (cast(p[[r*8+(c+1)%8+1]] as double)-cast(p[[r*8+(c+7)%8+1]] as double))/2 gc from ij)"
)


@query(f"{_CLIPS}@@select movie_id, cast(i as int) i, [sum(gr*gr)] rr, [sum(gr*gc)] rc, [sum(gc*gc)] cc, [sum(gr*s)] rs, [sum(gc*s)] cs, [sum(s*s)] ss, [sum(gr*d)] rd, [sum(gc*d)] cd, [sum(s*d)] sd from g group by movie_id, i", "images")
def movie_flow_sums(img):
    """All that the flow of each movie follows from."""
    return flow.flow_sums(_clips(img), SIDE)


@query(
    f"{_CLIPS}, m as (select *, 1e-1*(r-35e-1) dn, 5e-2*(c-35e-1)*(c-2) rt from g), v as (select *, (1e-1*((r+1)%8)-1e-1*((r+7)%8))/2+5e-2*(((c+1)%8-35e-1)*((c+1)%8-2)-((c+7)%8-35e-1)*((c+7)%8-2))/2 div from m),"
    "k as (select movie_id, count(distinct frame) n from px group by movie_id)@@select k.movie_id, [coalesce(sum(power(d+dn*gr+rt*gc+s*div,2)),0)/max(n)] as value from k left join v using (movie_id) group by k.movie_id",
    "images",
)
def movie_flow_term(img):
    """The flow term of a field that stretches down and bends to the right."""
    row, col = np.indices((SIDE, SIDE))
    clips = _clips(img)
    fixed = lambda x: F.array(*[F.lit(float(k)) for k in x.ravel()])
    fields = clips.select("movie_id").distinct().withColumns({"down": fixed(0.1 * (row - 3.5)), "right": fixed(0.05 * (col - 3.5) * (col - 2))})
    return flow.flow_term(clips, fields, SIDE)


def _movie_fields(spark, sf_dir):
    """The field of motions of each movie, pixel by pixel."""
    fields = flow.movie_fields(_clips(pictures(spark, sf_dir)), SIDE, 0.5)
    both = fields.select("movie_id", F.posexplode(F.arrays_zip("down", "right")).alias("i", "m"))
    return both.select("movie_id", "i", *[F.round(f"m.{c}", 6).alias(c) for c in ("down", "right")])


QUERIES["movie_fields"] = _movie_fields

_POPULATION = [Component("circ_gauss", 1.0, fwhm=2e-10), Component("point", 0.5, x=1e-10)]
_FREE = [(0, "flux"), (0, "fwhm"), (1, "x"), (1, "y")]


@query(
    f"pop as (select cast(k as bigint) k, 2e-1+1e-1*k f, (1+k)*1e-11 w, (k%5-2)*2e-11 x, (k%3-1)*3e-11 y from range(12) r(k)), m as (select k, f*exp(-power(3.141592653589793e0*w*sqrt(u*u+v*v),2)/(4*ln(2e0))) g, {TAU}*(u*x+v*y) t, vis_re, vis_im, sigma from vis, pop)"
    "@@select k, [avg((power(vis_re-g-5e-1*cos(t),2)+power(vis_im-5e-1*sin(t),2))/(sigma*sigma))*1e-4/2] as chisq from m group by k"
)
def model_population(vis):
    """Chi-squares of twelve source models, by one pass."""
    k = np.arange(12)
    vectors = np.array([0.2 + 0.1 * k, (1 + k) * 1e-11, (k % 5 - 2) * 2e-11, (k % 3 - 1) * 3e-11]).T
    chi = search.Population(vis, "vis", _POPULATION, _FREE).chisq(vectors)
    return vis.sparkSession.createDataFrame([(int(i), float(c) * 1e-4) for i, c in enumerate(chi)], "k long, chisq double")


def _model_search(spark, sf_dir):
    """The best of a population of two components, over all visibilities."""
    bounds = [(0.0, 3.0), (1e-12, 1e-9), (-5e-10, 5e-10), (-5e-10, 5e-10)]
    best, chi, _ = search.search_components(staged(spark, sf_dir), "vis", _POPULATION, _FREE, bounds, members=24, rounds=12)
    rows = [(i, name, float(getattr(best[i], name)), float(chi)) for i, name in _FREE]
    return spark.createDataFrame(rows, "component int, parameter string, value double, chisq double")


QUERIES["model_search"] = _model_search
