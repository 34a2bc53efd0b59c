"""Named queries of closure tables with their legs, of averages that are closed, reductions, CLEAN on closures, traces and agreeing images, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import agreements, closure, closureclean, gridding, polarimetry, traces
from .catalog import AMP, BISPEC, QUERIES, pictures, query, staged
from .extended import CP, full, off_ties

#: Every baseline in both directions, the maximal and the minimal quadrangles of a time, and their legs.
_BOTH = "lg as (select time, t1 x, t2 y, u, v, {amp} a, {sigma} s from {source} union all select time, t2, t1, -u, -v, {amp}, {sigma} from {source})"
_MAXIMAL = """si as (select distinct time, x s from lg), qd as (select a.time, a.s a, b.s b, c.s c, d.s d from si a join si b on a.time=b.time and a.s<b.s join si c on a.time=c.time and b.s<c.s join si d on a.time=d.time and c.s<d.s),
 mx as (select time, a t1, b t2, c t3, d t4 from qd union all select time, a, c, b, d from qd union all select time, a, b, d, c from qd)"""
_MINIMAL = """si as (select distinct time, x s from lg), od as (select time, s, row_number() over (partition by time order by s)-1 i from si),
 mx as (select z.time, z.s t1, a.s t2, b.s t3, c.s t4 from od z join od a on z.time=a.time and z.i=0 and a.i>=3 join od b on z.time=b.time and b.i>=1 and b.i<a.i join od c on z.time=c.time and c.i=case when b.i=a.i-1 then 1 else b.i+1 end)"""
_JOINED = ", ".join(f"p{k}.a a{k}, p{k}.s s{k}, p{k}.u u{k}, p{k}.v v{k}" for k in "1234")
_LEGS = f"jq as (select q.*, {_JOINED} from mx q join lg p1 on p1.time=q.time and p1.x=q.t1 and p1.y=q.t2 join lg p2 on p2.time=q.time and p2.x=q.t3 and p2.y=q.t4 join lg p3 on p3.time=q.time and p3.x=q.t1 and p3.y=q.t4 join lg p4 on p4.time=q.time and p4.x=q.t2 and p4.y=q.t3)"
_SUM = "power(s1/a1,2)+power(s2/a2,2)+power(s3/a3,2)+power(s4/a4,2)"
_BOTH_VIS = _BOTH.format(amp=AMP, sigma="sigma", source="vis")
_TRIANGLE_LEGS = f"{BISPEC}, uv as (select bs.*, a.u u1, a.v v1, b.u u2, b.v v2, -c.u u3, -c.v v3 from bs join vis a on a.time=bs.time and a.t1=bs.t1 and a.t2=bs.t2 join vis b on b.time=bs.time and b.t1=bs.t2 and b.t2=bs.t3 join vis c on c.time=bs.time and c.t1=bs.t1 and c.t2=bs.t3)"
_MEANS3 = ", ".join(f"[avg({c}{k})*100000013e-14] {c}{k}" for k in "123" for c in "uv")


def _mega(table, names):
    """Coordinates in millions; the factor's last digits keep means of whole numbers off the ties of rounding, where the order of a sum would show."""
    return table.withColumns({c: F.col(c) * 1.00000013e-6 for c in names})


U3 = [f"{c}{k}" for k in "123" for c in "uv"]
U4 = [f"{c}{k}" for k in "1234" for c in "uv"]


@query(f"{_TRIANGLE_LEGS}@@select [time] time, t1, t2, t3, [re] bispec_re, [im] bispec_im, {', '.join(f'[{c}*100000013e-14] {c}' for c in U3)} from uv where 1/r > 3")
def add_bispec(vis):
    """Bispectra above a signal to noise of 3, with their legs."""
    return _mega(closure.bispectrum_table(vis, snr_cut=3.0).drop("sigmab"), U3)


@query(f"{_TRIANGLE_LEGS}@@select t1, t2, t3, cast(round_even(time*3.6e3/6e2, 0) as bigint) bucket, [avg(re)] bispec_re, [avg(im)] bispec_im, [avg(time)*10000001e-7] time, {_MEANS3} from uv group by t1, t2, t3, round_even(time*3.6e3/6e2, 0) having sqrt(power(avg(re),2)+power(avg(im),2))/(sqrt(sum((re*re+im*im)*r*r))/count(*))>2")
def add_bispec_averaged(vis):
    return off_ties(_mega(closure.bispectrum_table(vis, 600.0, snr_cut=2.0).drop("sigmab", "n"), U3))


@query(f"{_TRIANGLE_LEGS}, c as (select *, atan2(im,re) c from uv)@@select t1, t2, t3, cast(round_even(time*3.6e3/6e2, 0) as bigint) bucket, [atan2(avg(sin(c/DEG*DEG)),avg(cos(c/DEG*DEG)))/DEG] cphase, [sqrt(sum(power(r/DEG,2)))/count(*)] sigmacp, [avg(time)*10000001e-7] time, {_MEANS3} from c group by t1, t2, t3, round_even(time*3.6e3/6e2, 0) having 1/(sqrt(sum(r*r))/count(*))>4")
def add_cphase_snr(vis):
    """Averaged closure phases above a signal to noise of 4, with mean legs."""
    return off_ties(_mega(closure.phase_table(vis, 600.0, snr_cut=4.0).drop("n"), U3))


@query("select [time] time, t1, t2, [u*100000013e-14] u, [v*100000013e-14] v, [case when AMP>sigma then sqrt(AMP*AMP-sigma*sigma) else 0 end] amp, [sigma] sigma from vis where case when AMP>sigma then sqrt(AMP*AMP-sigma*sigma) else 0 end/sigma > 5")
def add_amp(vis):
    return _mega(closure.amplitude_table(vis, snr_cut=5.0), ["u", "v"])


@query(f"{_BOTH_VIS}, {_MAXIMAL}, {_LEGS}@@select [time] time, t1, t2, t3, t4, [a1*a2/(a3*a4)] camp, {', '.join(f'[{c}*100000013e-14] {c}' for c in U4)} from jq where 1/sqrt({_SUM})>=2")
def add_camp(vis):
    """Closure amplitudes above a signal to noise of 2, with their legs."""
    return _mega(closure.closure_amplitude_table(vis, snr_cut=2.0).drop("sigmaca"), U4)


_AVERAGED = "av as (select (floor(time*3.6e3/3e2)+5e-1)*(3e2/3.6e3) time, t1, t2, avg(u) u, avg(v) v, avg(AMP) amp, sqrt(sum(sigma*sigma))/count(*) sg from vis group by 1, 2, 3)"


@query(f"{_AVERAGED}, {_BOTH.format(amp='amp', sigma='sg', source='av')}, {_MAXIMAL}, {_LEGS}@@select [time] time, t1, t2, t3, t4, [a1*a2/(a3*a4)] camp, [a1*a2/(a3*a4)*sqrt({_SUM})] sigmaca, {', '.join(f'[{c}*100000013e-14] {c}' for c in U4)} from jq")
def add_camp_of_averages(vis):
    """Closure amplitudes of amplitudes averaged over 300 s."""
    return _mega(closure.closure_amplitude_table(vis, 300.0, debias=False), U4)


@query(f"{_BOTH_VIS}, {_MINIMAL}, {_LEGS}@@select [time] time, array_to_string(list_sort([[t1,t2,t3,t4]]), '-') stations, [a1*a2/(a3*a4)] camp, [a1*a2/(a3*a4)*sqrt({_SUM})] sigmaca from jq")
def reduce_quad_minimal(vis):
    """The minimal set out of the maximal one."""
    some = closure.minimal_quadrangles(closure.closure_amplitudes(vis, debias=False), vis)
    return some.select("time", F.concat_ws("-", F.array_sort(F.array("t1", "t2", "t3", "t4"))).alias("stations"), "camp", "sigmaca")


_AT = "(6.283185307179586e0*({s}*({u}*{x}+{v}*{y})))"
_MIDDLE = "(-5e-1*(2e-9/4))"  # pixel 2 of 4, where the model is a point of flux 2
_LEG = "2*cos({t}) m{k}, 2*sin({t}) n{k}"


@query(
    f"{_TRIANGLE_LEGS}, md as (select *, {', '.join(_LEG.format(k=k, t=_AT.format(s=1, u=f'u{k}', v=f'v{k}', x=_MIDDLE, y=_MIDDLE)) for k in '123')} from uv),"
    " c as (select *, m2*m3-n2*n3 c1, m2*n3+n2*m3 d1, m1*m3-n1*n3 c2, m1*n3+n1*m3 d2, m1*m2-n1*n2 c3, m1*n2+n1*m2 d3 from md), r as (select *, re-(m1*c1-n1*d1) e, im-(m1*d1+n1*c1) f from c),"
    " px as (select cast(i as int) i, (15e-1-i)*(2e-9/4) x from range(4) r(i)), z as (select b.i*4+a.i place, r.*, a.x x, b.x y from r, px a, px b)@@"
    "select cast(place as bigint) place, [sum("
    + "+".join(f"((e*c{k}+f*d{k})*cos(6.283185307179586e0*(u{k}*x+v{k}*y))-(e*d{k}-f*c{k})*sin(6.283185307179586e0*(u{k}*x+v{k}*y)))" for k in "123")
    + ")*(-2e0)/count(*)/1e3] slope, [sum(e*e+f*f)/count(*)/1e3] misfit from z group by place"
)
def closure_clean_slopes(vis):
    """The first raster of a CLEAN step on bispectra, of a model of one point."""
    columns, legs = closureclean.DATA["bispec"]
    rows = closure.bispectra(vis).select(*columns, *[c for leg in legs for c in leg])
    image = np.zeros((4, 4))
    image[2, 2] = 2.0
    misfit, p, _, count = closureclean.derivatives(rows, "bispec", image, gridding.Grid(4, 2e-9 / 4, width=14), "uniform")
    return vis.sparkSession.createDataFrame([(k, float(x) / count / 1e3, misfit / count / 1e3) for k, x in enumerate(p.ravel())], "place long, slope double, misfit double")


def _clean_phases(spark, sf_dir):
    """Components of eight CLEAN steps on the closure phases, from a point of flux 1 in the middle."""
    table = closure.closure_phases(staged(spark, sf_dir))
    image, _ = closureclean.clean_closures(table, "cphase", 8, 2e-9 / 8, steps=8, gain=0.3)
    rows = [(int(k), float(image.ravel()[k])) for k in np.flatnonzero(image)]
    return spark.createDataFrame(rows, "place long, flux double")


QUERIES["clean_closure_phases"] = _clean_phases


def _times(a: str, b: str) -> tuple[str, str]:
    """SQL of the real and imaginary part of a product; a number x has the columns xr and xi."""
    return f"({a}r*{b}r-{a}i*{b}i)", f"({a}r*{b}i+{a}i*{b}r)"


def _row(name: str, plus: tuple[tuple[str, str], ...], signs: str = "++") -> str:
    parts = [_times(*p) for p in plus]
    return ", ".join("".join(s + p[k] for s, p in zip(signs, parts, strict=True)) + f" {name}{x}" for k, x in ((0, "r"), (1, "i")))


_CELLS = ("a", "b", "c", "d")
_POLARISED = f"""{CP}, lg as (select time, t1 x, t2 y, rr_re ar, rr_im ai, rl_re br, rl_im bi, lr_re cr, lr_im ci, ll_re dr, ll_im di from cp union all select time, t2, t1, rr_re, -rr_im, lr_re, -lr_im, rl_re, -rl_im, ll_re, -ll_im from cp), {_MAXIMAL},
 jq as (select q.*, {', '.join(f'p{k}.{c}{x} {c}{k}{x}' for k in '1234' for c in _CELLS for x in 'ri')} from mx q join lg p1 on p1.time=q.time and p1.x=q.t1 and p1.y=q.t2 join lg p2 on p2.time=q.time and p2.x=q.t3 and p2.y=q.t2
   join lg p3 on p3.time=q.time and p3.x=q.t3 and p3.y=q.t4 join lg p4 on p4.time=q.time and p4.x=q.t1 and p4.y=q.t4),
 dt as (select *, {_row('e2', (('a2', 'd2'), ('b2', 'c2')), '+-')}, {_row('e4', (('a4', 'd4'), ('b4', 'c4')), '+-')} from jq),
 pr as (select *, {', '.join(_row(f'{n}{i}{j}', p, s) for n, k, m in (('f', '1', '2'), ('g', '3', '4')) for i, (x, y) in enumerate((('a', 'b'), ('c', 'd'))) for j, p, s in ((0, ((x + k, 'd' + m), (y + k, 'c' + m)), '+-'), (1, ((y + k, 'a' + m), (x + k, 'b' + m)), '+-')))} from dt),
 tp as (select *, {_row('n', (('f00', 'g00'), ('f01', 'g10'), ('f10', 'g01'), ('f11', 'g11')), '++++')}, {_row('w', (('e2', 'e4'),), '+')} from pr),
 tr as (select *, 5e-1*(nr*wr+ni*wi)/(wr*wr+wi*wi) re, 5e-1*(ni*wr-nr*wi)/(wr*wr+wi*wi) im from tp)"""


@query(f"{_POLARISED}@@select [time] time, t1, t2, t3, t4, [ln(sqrt(re*re+im*im))] log_size, [re/sqrt(re*re+im*im)] cosine from tr")
def closure_traces(vis):
    """Size and direction of the traces of all quadrangles."""
    found = traces.closure_traces(polarimetry.switch(full(vis), "circ"))
    size = F.sqrt(F.col("trace_re") * F.col("trace_re") + F.col("trace_im") * F.col("trace_im"))
    return found.select("time", "t1", "t2", "t3", "t4", F.log(size).alias("log_size"), (F.col("trace_re") / size).alias("cosine"))


@query("n as (select image_id, pix, list_avg(list_transform(pix, lambda x: cast(x as double))) m from img), c as (select image_id, list_transform(pix, lambda x: cast(x as double)-m) d from n), z as (select image_id, d, sqrt(list_sum(list_transform(d, lambda x: x*x))) s from c)@@select cast(p.image_id as bigint) a, cast(q.image_id as bigint) b, [list_inner_product(p.d, q.d)/(p.s*q.s)] as value from z p join z q on p.image_id<q.image_id where list_inner_product(p.d, q.d)/(p.s*q.s)>=35e-2", "images")
def image_pairs(img):
    """Pairs of images that correlate."""
    return agreements.pairs(img, 0.35, 3)


def _agreement_sets(spark, sf_dir):
    """Maximal sets of images that all correlate with each other."""
    return agreements.cliques(agreements.pairs(pictures(spark, sf_dir), 0.35)).select(F.size("members").alias("n"), F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


QUERIES["image_agreements"] = _agreement_sets
