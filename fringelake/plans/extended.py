"""Named queries of polarimetry, geometry, simulation, closures, chi-squares, image terms and arrangement, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import chisquares, closure, geometry, images, polarimetry, simulation, tables
from ..operators import visibility as V
from .catalog import KEYS, SIDE, _full, query

FP = """fp as (select vis.*, 1e-1*vis_re qvis_re, -5e-2*vis_im qvis_im, 3e-2*vis_im uvis_re, 2e-2*vis_re uvis_im, 1e-2*vis_re vvis_re, 4e-2*vis_im vvis_im, 11e-1*sigma qsigma, 12e-1*sigma usigma, 13e-1*sigma vsigma from vis)"""
CP = FP + """, cp as (select fp.*, vis_re+vvis_re rr_re, vis_im+vvis_im rr_im, vis_re-vvis_re ll_re, vis_im-vvis_im ll_im, qvis_re-uvis_im rl_re, qvis_im+uvis_re rl_im, qvis_re+uvis_im lr_re, qvis_im-uvis_re lr_im,
    sqrt(sigma*sigma+vsigma*vsigma) rs, sqrt(sigma*sigma+vsigma*vsigma) ls, sqrt(qsigma*qsigma+usigma*usigma) xs, sqrt(qsigma*qsigma+usigma*usigma) ys from fp)"""


def full(vis):
    """Stokes Q, U and V, and errors of their own."""
    return _full(vis).withColumns({"qsigma": 1.1 * F.col("sigma"), "usigma": 1.2 * F.col("sigma"), "vsigma": 1.3 * F.col("sigma")})


def off_ties(table):
    """Mean times a little longer, off the ties of rounding, where the order of a sum would show."""
    return table.withColumn("time", F.col("time") * 1.0000001)


I2 = "(vis_re*vis_re+vis_im*vis_im)"
P_RE, P_IM = "(qvis_re-uvis_im)", "(qvis_im+uvis_re)"
M_RE, M_IM = f"(({P_RE}*vis_re+{P_IM}*vis_im)/{I2})", f"(({P_IM}*vis_re-{P_RE}*vis_im)/{I2})"
C2, S2 = "cos(2*atan2(u,v))", "sin(2*atan2(u,v))"
R_RE, R_IM, L_RE, L_IM = "(vis_re+vvis_re)", "(vis_im+vvis_im)", "(vis_re-vvis_re)", "(vis_im-vvis_im)"
L2 = f"({L_RE}*{L_RE}+{L_IM}*{L_IM})"
ST = {
    "q": ("qvis_re", "qvis_im", "qsigma"),
    "u": ("uvis_re", "uvis_im", "usigma"),
    "v": ("vvis_re", "vvis_im", "vsigma"),
    "p": (P_RE, P_IM, "sqrt(qsigma*qsigma+usigma*usigma)"),
    "m": (M_RE, M_IM, f"sqrt((qsigma*qsigma+usigma*usigma+sigma*sigma*({M_RE}*{M_RE}+{M_IM}*{M_IM}))/{I2})"),
    "e": (f"{C2}*qvis_re+{S2}*uvis_re", f"{C2}*qvis_im+{S2}*uvis_im", f"sqrt(5e-1*(power({C2}*qsigma,2)+power({S2}*usigma,2)))"),
    "b": (f"-{S2}*qvis_re+{C2}*uvis_re", f"-{S2}*qvis_im+{C2}*uvis_im", f"sqrt(5e-1*(power({S2}*qsigma,2)+power({C2}*usigma,2)))"),
    "rr": (R_RE, R_IM, "sqrt(sigma*sigma+vsigma*vsigma)"),
    "ll": (L_RE, L_IM, "sqrt(sigma*sigma+vsigma*vsigma)"),
    "rl": (P_RE, P_IM, "sqrt(qsigma*qsigma+usigma*usigma)"),
    "lr": ("qvis_re+uvis_im", "qvis_im-uvis_re", "sqrt(qsigma*qsigma+usigma*usigma)"),
    "rrll": (f"({R_RE}*{L_RE}+{R_IM}*{L_IM})/{L2}", f"({R_IM}*{L_RE}-{R_RE}*{L_IM})/{L2}", f"sqrt(2e0)*sqrt({I2}+vvis_re*vvis_re+vvis_im*vvis_im)/{L2}*sqrt(sigma*sigma+vsigma*vsigma)"),
}
Q_RE, Q_IM, U_RE, U_IM = "5e-1*(lr_re+rl_re)", "5e-1*(lr_im+rl_im)", "(-5e-1*(lr_im-rl_im))", "5e-1*(lr_re-rl_re)"
T_RE, T_IM = "(rr_re+ll_re)", "(rr_im+ll_im)"
T2 = f"({T_RE}*{T_RE}+{T_IM}*{T_IM})"
N_RE, N_IM = f"(2*(rl_re*{T_RE}+rl_im*{T_IM})/{T2})", f"(2*(rl_im*{T_RE}-rl_re*{T_IM})/{T2})"
XS = "5e-1*sqrt(xs*xs+ys*ys)"
CI = {
    "i": (f"5e-1*{T_RE}", f"5e-1*{T_IM}", "5e-1*sqrt(rs*rs+ls*ls)"),
    "q": (Q_RE, Q_IM, XS),
    "u": (U_RE, U_IM, XS),
    "v": ("5e-1*(rr_re-ll_re)", "5e-1*(rr_im-ll_im)", "5e-1*sqrt(rs*rs+ls*ls)"),
    "p": ("rl_re", "rl_im", "xs"),
    "m": (N_RE, N_IM, f"sqrt((xs*xs+(rs*rs+ls*ls)*({N_RE}*{N_RE}+{N_IM}*{N_IM}))/(25e-2*{T2}))"),
    "e": (f"{C2}*{Q_RE}+{S2}*{U_RE}", f"{C2}*{Q_IM}+{S2}*{U_IM}", f"sqrt(5e-1*(power({C2}*{XS},2)+power({S2}*{XS},2)))"),
    "b": (f"-{S2}*{Q_RE}+{C2}*{U_RE}", f"-{S2}*{Q_IM}+{C2}*{U_IM}", f"sqrt(5e-1*(power({S2}*{XS},2)+power({C2}*{XS},2)))"),
    "rrll": ("(rr_re*ll_re+rr_im*ll_im)/(ll_re*ll_re+ll_im*ll_im)", "(rr_im*ll_re-rr_re*ll_im)/(ll_re*ll_re+ll_im*ll_im)", "sqrt((rs*rs+ls*ls*(rr_re*rr_re+rr_im*rr_im))/(ll_re*ll_re+ll_im*ll_im))"),
}


def _unpacked(family: str, polrep: str) -> None:
    re, im, sigma = (ST if polrep == "stokes" else CI)[family]
    head, source = (FP, "fp") if polrep == "stokes" else (CP, "cp")

    def run(vis):
        whole = full(vis)
        return polarimetry.unpack(whole if polrep == "stokes" else polarimetry.switch(whole, "circ"), family, polrep)

    run.__name__ = f"unpack_{family}" if polrep == "stokes" else f"unpack_circ_{family}"
    run.__doc__ = f"Amplitude, phase and errors of {family} from a {polrep} table."
    query(f"{head}, z as (select time, t1, t2, {re} re, {im} im, {sigma} sg from {source})@@select [time] time, t1, t2, [re] re, [im] im, [sg] sigma, [sqrt(re*re+im*im)] amp, [atan2(im,re)/DEG] phase, [sqrt(re*re+im*im)/sg] snr, [sg/sqrt(re*re+im*im)/DEG] sigma_phase from z")(run)


for _family in ST:
    _unpacked(_family, "stokes")
for _family in CI:
    _unpacked(_family, "circ")


@query(f"{CP}@@select [time] time, t1, t2, [rr_re] rrvis_re, [lr_im] lrvis_im, [rs] rrsigma, [ls] llsigma, [xs] rlsigma, [ys] lrsigma from cp")
def switch_polrep_errors(vis):
    return polarimetry.switch(full(vis), "circ").select(*KEYS, "rrvis_re", "lrvis_im", "rrsigma", "llsigma", "rlsigma", "lrsigma")


@query(f"{CP}@@select [time] time, t1, t2, [case when sigma<9e-2 then ll_re else 5e-1*(rr_re+ll_re) end] vis_re, [case when sigma<9e-2 then ls else 5e-1*sqrt(rs*rs+ls*ls) end] sigma, [5e-1*sqrt(xs*xs+ys*ys)] qsigma from cp")
def switch_polrep_single_hand(vis):
    """Where one parallel hand is missing, the other stands for Stokes I."""
    circ = polarimetry.switch(full(vis).withColumn("gone", F.col("sigma") < 0.09), "circ")
    circ = circ.withColumns({c: F.when(~F.col("gone"), F.col(c)) for c in ("rrvis_re", "rrvis_im")})
    return polarimetry.switch(circ, "stokes").select(*KEYS, "vis_re", "sigma", "qsigma")


@query(f"{CP}, b as (select time,t1,t2,u,rr_im,rl_re,rl_im,lr_re,lr_im,xs,ys*2 ys from cp)@@select [time] time, t1, t2, u, [rl_re] rlvis_re, [rl_im] rlvis_im, [xs] rlsigma from b union all select [time], t2, t1, -u+0.0, [lr_re], [-lr_im], [ys] from b")
def data_conj_circ(vis):
    circ = polarimetry.switch(full(vis), "circ").withColumn("lrsigma", 2 * F.col("lrsigma"))
    return V.conjugates(circ).select(*KEYS, "u", "rlvis_re", "rlvis_im", "rlsigma")


@query(f"{FP}@@select [time] time, t1, t2, [sigma*15e-1] sigma, [qsigma*15e-1] qsigma, [usigma*15e-1] usigma, [vsigma*15e-1] vsigma from fp")
def rescale_noise(vis):
    return polarimetry.rescale_noise(full(vis), 1.5).select(*KEYS, "sigma", "qsigma", "usigma", "vsigma")


@query(f"{FP}, k as (select *, 1e-2*({P_RE}*{P_RE}+{P_IM}*{P_IM}+power(qvis_re+uvis_im,2)+power(qvis_im-uvis_re,2))/{I2} f from fp), g as (select *, (case when f>1e-4 then f when f<1e-4 then 1e-4 else 0 end)*AMP g from k)@@select [time] time, t1, t2, [sqrt(sigma*sigma+g*g)] sigma, [sqrt(vsigma*vsigma+g*g)] vsigma from g")
def add_leakage_noise(vis):
    return polarimetry.leakage_noise(full(vis), 0.1, 1e-4).select(*KEYS, "sigma", "vsigma")


@query(f"{FP}@@select [time] time, t1, t2, sqrt(({P_RE}*{P_RE}+{P_IM}*{P_IM})/{I2})<9e-2 kept from fp")
def flag_large_fractional_pol(vis):
    return V.flag(full(vis), polarimetry.small_fraction(0.09), "both").select(*KEYS, "kept")


ELLIPSE = "k as (select fp.*, exp(-2*9.869604401089358e0*(({b}*sin({t}))*({b}*sin({t}))*u*u+({a}*cos({t}))*({a}*cos({t}))*u*u+2*({a}*{a}-{b}*{b})*cos({t})*sin({t})*u*v+({b}*cos({t}))*({b}*cos({t}))*v*v+({a}*sin({t}))*({a}*sin({t}))*v*v)) k from fp)"
# Widths at 1 cm in microarcseconds times the square of the wavelength in cm, as radians of a standard deviation.
WAVE2 = "power(299792458e0/23e10*100,2)*(DEG/3.6e9)/(2*sqrt(2*ln(2e0)))"


@query(f"{FP}, {ELLIPSE.format(a=f'(640*{WAVE2})', b=f'(1309*{WAVE2})', t='(-78*DEG)')}@@select [time] time, t1, t2, [vis_re/k] vis_re, [uvis_im/k] uvis_im, [sigma/k] sigma from k")
def deblur(vis):
    return polarimetry.by_kernel(full(vis), simulation.scattering(230e9)).select(*KEYS, "vis_re", "uvis_im", "sigma")


@query(
    "s as (select time, t1, t2, sigma, u, v from vis where time < 1e0), c as (select u, v from s union all select -u, -v from s), n as (select s.time, s.t1, s.t2, s.sigma, sqrt(count(*)) w from s join c on power(s.u-c.u,2)+power(s.v-c.v,2)<=power(2e8,2) group by all), k as (select avg(sigma)/avg(w) k from n)@@select [time] time, t1, t2, [w*k*75e-2+25e-2*sigma] sigma from n, k"
)
def reweight(vis):
    """Of the first hour."""
    return polarimetry.reweight(vis.filter("time < 1"), 2e8, 0.75).select(*KEYS, "sigma")


STATIONS = [("S0", -1828796.2, -5054406.8, 3427865.2, 6000.0), ("S1", 2225061.2, -5440057.4, -2481681.2, 90.0), ("S2", -5464523.4, -2493147.1, 2150611.8, 5000.0), ("S3", 5088967.9, -301681.6, 3825015.8, 700.0), ("S4", -768713.9, -5988541.8, 2063275.9, 600.0), ("S5", 1147000.0, -4583000.0, 4296000.0, 1500.0)]
SOURCE = geometry.Source(ra=12.5137, dec=12.3911, frequency=230e9, mjd=57854)


def stations(spark):
    return spark.createDataFrame(STATIONS, "site string, x double, y double, z double, sefd double")


_values = ", ".join(f"('{s}', {x:.1f}e0, {y:.1f}e0, {z:.1f}e0, {f:.1f}e0)" for s, x, y, z, f in STATIONS)
GMST = "24*(0.7790572732640e0+1.00273781191135448e0*d)+(0.014506e0+4612.156534e0*(d/36525)+1.3915817e0*(d/36525)*(d/36525))/54000e0"
DAY_START = GMST.replace("d", "6309.5e0")
SKY = f"""st as (select * from (values {_values}) t(site,x,y,z,sefd)), dd as (select vis.*, 57854-51544.5e0+time/24e0 d from vis), hh as (select dd.*, {GMST} h from dd), gg as (select hh.*, h-24*floor(h/24) g from hh),
 aa as (select gg.*, (g-12.5137e0)*15*DEG w from gg), tt as (select aa.*, w-2*pi()*floor(w/(2*pi())) th from aa),
 ss as (select tt.*, a.x x1, a.y y1, a.z z1, b.x x2, b.y y2, b.z z2, a.sefd f1, b.sefd f2, pi()/2-acos(((a.x*cos(th)-a.y*sin(th))*cos(12.3911e0*DEG)+a.z*sin(12.3911e0*DEG))/sqrt(a.x*a.x+a.y*a.y+a.z*a.z)) e1, pi()/2-acos(((b.x*cos(th)-b.y*sin(th))*cos(12.3911e0*DEG)+b.z*sin(12.3911e0*DEG))/sqrt(b.x*b.x+b.y*b.y+b.z*b.z)) e2 from tt join st a on t1=a.site join st b on t2=b.site),
 ww as (select *, g*15*DEG+atan2(y1,x1)-12.5137e0*15*DEG k1, atan2(z1,sqrt(x1*x1+y1*y1)) lat1 from ss), pp as (select *, k1-2*pi()*floor(k1/(2*pi())) ha1 from ww)"""


@query(f"{SKY}@@select [time] time, t1, t2, [g] gmst, [(g-({DAY_START})+24*floor(({DAY_START})/24))*0.9972695601848e0] utc from pp")
def switch_timetype(vis):
    sidereal = geometry.gmst(F.col("time"), SOURCE.mjd)
    return vis.select(*KEYS, sidereal.alias("gmst"), geometry.utc(sidereal, SOURCE.mjd).alias("utc"))


@query(f"{SKY}@@select [time] time, t1, t2, [e1/DEG] el1, [e2/DEG] el2, [ha1/DEG] hr_ang1, [atan2(sin(ha1)*cos(lat1), sin(lat1)*cos(12.3911e0*DEG)-cos(lat1)*sin(12.3911e0*DEG)*cos(ha1))/DEG] par_ang1 from pp")
def unpack_angles(vis):
    return geometry.station_angles(vis, stations(vis.sparkSession), SOURCE).select(*KEYS, "el1", "el2", "hr_ang1", "par_ang1")


@query(f"{SKY}@@select [time] time, t1, t2, [((x1-x2)*sin(th)+(y1-y2)*cos(th))/(299792458e0/23e10)/1e6] u, [(cos(12.3911e0*DEG)*(z1-z2)-sin(12.3911e0*DEG)*((x1-x2)*cos(th)-(y1-y2)*sin(th)))/(299792458e0/23e10)/1e6] v from pp")
def recompute_uv(vis):
    return geometry.recompute_uv(vis, stations(vis.sparkSession), SOURCE).select(*KEYS, (F.col("u") / 1e6).alias("u"), (F.col("v") / 1e6).alias("v"))


@query(f"{SKY}@@select [time] time, t1, t2, e1/DEG>10 and e1/DEG<85 and e2/DEG>10 and e2/DEG<85 kept from pp")
def flag_elev(vis):
    return geometry.flag_elevation(vis, stations(vis.sparkSession), SOURCE, output="both").select(*KEYS, "kept")


@query(
    f"all_vis as (select * from vis), bl as (select distinct time from all_vis), {SKY.replace('from vis)', 'from (select bl.time, a.site t1, b.site t2 from bl, st a, st b where a.site<b.site) vis)')}@@select [time] time, t1, t2, [((x1-x2)*sin(th)+(y1-y2)*cos(th))/(299792458e0/23e10)/1e6] u, [sqrt(f1*f2/(2*4e9*5))/0.88e0] sigma from pp where e1/DEG>10 and e1/DEG<85 and e2/DEG>10 and e2/DEG<85"
)
def make_uvpoints(vis):
    """Every baseline at every time of the table at which both stations see the source."""
    made = geometry.make_uvpoints(vis.select("time").distinct(), stations(vis.sparkSession), SOURCE, 5.0, 4e9)
    return made.select(*KEYS, (F.col("u") / 1e6).alias("u"), "sigma")


@query("px as (select a.i ix, b.i iy, (25e-1-a.i)*2e-10 x, (15e-1-b.i)*2e-10 y, 1e0/(1+a.i+2*b.i) w from range(6) a(i), range(4) b(i))@@select [time] time, t1, t2, [sum(w*cos(2*pi()*(u*x+v*y)))] vis_re, [sum(w*sin(2*pi()*(u*x+v*y)))] vis_im from vis, px group by time, t1, t2")
def sample_vis(vis):
    """Direct Fourier transform of an image of 6 by 4 pixels."""
    iy, ix = np.indices((4, 6))
    return simulation.image_visibilities(vis, 1 / (1.0 + ix + 2 * iy), 2e-10).select(*KEYS, "vis_re", "vis_im")


_A, _B = "(1e-10/(2*sqrt(2*ln(2e0))))", "(2e-10/(2*sqrt(2*ln(2e0))))"
GAUSS = f"{FP}, {ELLIPSE.format(a=_A, b=_B, t='(-4e-1)')}, md as (select time, t1, t2, u, v, vis_re, vis_im, sigma, 3*k*cos(-2*pi()*(u*3e-11-v*2e-11)) mod_re, 3*k*sin(-2*pi()*(u*3e-11-v*2e-11)) mod_im from k)"


def modelled(vis):
    return chisquares.with_model(vis, simulation.gaussian(3.0, 2e-10, 1e-10, 0.4, 3e-11, -2e-11))


@query(f"{GAUSS}@@select [time] time, t1, t2, [mod_re] mod_re, [mod_im] mod_im from md")
def gauss_uv(vis):
    return modelled(vis).select(*KEYS, "mod_re", "mod_im")


MD_AMP = "sqrt(mod_re*mod_re+mod_im*mod_im)"


@query(f"{GAUSS}@@select [sum((power(vis_re-mod_re,2)+power(vis_im-mod_im,2))/(sigma*sigma))/(2*count(*))] chisq from md")
def chisq_vis(vis):
    return chisquares.visibilities(modelled(vis))


@query(f"{GAUSS}@@select [sum(power((AMP-{MD_AMP})/sigma,2))/count(*)] chisq from md")
def chisq_amp(vis):
    return chisquares.amplitudes(modelled(vis))


@query(f"{GAUSS}@@select [sum(power((ln(AMP)-ln({MD_AMP}))*AMP/sigma,2))/count(*)] chisq from md")
def chisq_logamp(vis):
    return chisquares.amplitudes(modelled(vis), log=True)


TRIPLES = f"""{GAUSS}, ab as (select a.time, a.t1, a.t2, c.t2 t3, a.vis_re*b.vis_re-a.vis_im*b.vis_im pr, a.vis_re*b.vis_im+a.vis_im*b.vis_re pi, c.vis_re cr, -c.vis_im ci, a.mod_re*b.mod_re-a.mod_im*b.mod_im mr, a.mod_re*b.mod_im+a.mod_im*b.mod_re mi, c.mod_re dr, -c.mod_im di,
    sqrt(power(a.sigma,2)/(a.vis_re*a.vis_re+a.vis_im*a.vis_im)+power(b.sigma,2)/(b.vis_re*b.vis_re+b.vis_im*b.vis_im)+power(c.sigma,2)/(c.vis_re*c.vis_re+c.vis_im*c.vis_im)) r
    from md a join md b on a.time=b.time and a.t2=b.t1 join md c on a.time=c.time and a.t1=c.t1 and b.t2=c.t2), tr as (select *, pr*cr-pi*ci re, pr*ci+pi*cr im, mr*dr-mi*di m_re, mr*di+mi*dr m_im from ab)"""


@query(f"{TRIPLES}@@select [sum((power(re-m_re,2)+power(im-m_im,2))/((re*re+im*im)*r*r))/(2*count(*))] chisq from tr")
def chisq_bs(vis):
    return chisquares.bispectrum(modelled(vis))


@query(f"{TRIPLES}@@select [2*sum((1-cos(atan2(im,re)-atan2(m_im,m_re)))/(r*r))/count(*)] chisq from tr")
def chisq_cphase(vis):
    return chisquares.closure_phase(modelled(vis))


@query(f"{TRIPLES}@@select t1, t2, t3, cast(round_even(time*3.6e3/6e2, 0) as bigint) bucket, [avg(re)] bispec_re, [avg(im)] bispec_im, [sqrt(sum((re*re+im*im)*r*r))/count(*)] sigmab, [avg(time)*10000001e-7] time, count(*) n from tr group by t1, t2, t3, round_even(time*3.6e3/6e2, 0) having sqrt(power(avg(re),2)+power(avg(im),2))/(sqrt(sum((re*re+im*im)*r*r))/count(*))>2")
def avg_bispectra(vis):
    return off_ties(closure.average_bispectra(closure.bispectra(vis.drop("u", "v")), 600.0, 2.0))


LEGS = """lg as (select time, t1 x, t2 y, AMP a, sigma s, {m} m from {source} union all select time, t2, t1, AMP, sigma, {m} from {source}),
 si as (select distinct time, x s from lg), qd as (select a.time, a.s a, b.s b, c.s c, d.s d from si a join si b on a.time=b.time and a.s<b.s join si c on a.time=c.time and b.s<c.s join si d on a.time=d.time and c.s<d.s),
 mx as (select time, a t1, b t2, c t3, d t4 from qd union all select time, a, c, b, d from qd union all select time, a, b, d, c from qd)"""
MINIMAL = ", od as (select time, s, row_number() over (partition by time order by s)-1 i from si), mn as (select z.time, z.s t1, a.s t2, b.s t3, c.s t4 from od z join od a on z.time=a.time and z.i=0 and a.i>=3 join od b on z.time=b.time and b.i>=1 and b.i<a.i join od c on z.time=c.time and c.i=case when b.i=a.i-1 then 1 else b.i+1 end)"
JOINED = ", jq as (select q.*, p1.a a1, p1.s s1, p1.m m1, p2.a a2, p2.s s2, p2.m m2, p3.a a3, p3.s s3, p3.m m3, p4.a a4, p4.s s4, p4.m m4 from {quads} q join lg p1 on p1.time=q.time and p1.x=q.t1 and p1.y=q.t2 join lg p2 on p2.time=q.time and p2.x=q.t3 and p2.y=q.t4 join lg p3 on p3.time=q.time and p3.x=q.t1 and p3.y=q.t4 join lg p4 on p4.time=q.time and p4.x=q.t2 and p4.y=q.t3)"
DEBIASED = ", db as (select time, t1, t2, t3, t4, m1, m2, m3, m4, s1, s2, s3, s4, " + ", ".join(f"case when a{k}>s{k} then sqrt(a{k}*a{k}-s{k}*s{k}) else s{k} end a{k}" for k in "1234") + " from jq)"
SUM4 = "power(s1/a1,2)+power(s2/a2,2)+power(s3/a3,2)+power(s4/a4,2)"
PLAIN_LEGS = LEGS.format(m="1", source="vis")


@query(f"{PLAIN_LEGS}{JOINED.format(quads='mx')}{DEBIASED}@@select [time] time, t1, t2, t3, t4, [a1*a2/(a3*a4)/(1+power(s3/a3,2)+power(s4/a4,2))] camp, [a1*a2/(a3*a4)*sqrt({SUM4})] sigmaca from db")
def c_amplitudes_max(vis):
    """Three quadrangles of every four stations, debiased."""
    return closure.closure_amplitudes(vis.drop("u", "v"))


@query(f"{PLAIN_LEGS}{MINIMAL}{JOINED.format(quads='mn')}@@select [time] time, t1, t2, t3, t4, [a1*a2/(a3*a4)] camp, [a1*a2/(a3*a4)*sqrt({SUM4})] sigmaca from jq where 1/sqrt({SUM4})>=1")
def c_amplitudes_min(vis):
    return closure.closure_amplitudes(vis.drop("u", "v"), "min", debias=False, snr_cut=1.0)


@query(f"{PLAIN_LEGS}{JOINED.format(quads='mx')}{DEBIASED}@@select [time] time, t1, t2, t3, t4, [ln(a1)+ln(a2)-ln(a3)-ln(a4)+(power(s1/a1,2)+power(s2/a2,2)-power(s3/a3,2)-power(s4/a4,2))/2] camp, [sqrt({SUM4})] sigmaca from db")
def logcamp_debiased(vis):
    return closure.closure_amplitudes(vis.drop("u", "v"), kind="logcamp")


@query(f"{PLAIN_LEGS}{JOINED.format(quads='mx')}@@select t1, t2, t3, t4, cast(round_even(time*3.6e3/6e2, 0) as bigint) bucket, [avg(a1*a2/(a3*a4))] camp, [sqrt(sum(power(a1*a2/(a3*a4),2)*({SUM4})))/count(*)] sigmaca, [avg(time)*10000001e-7] time, count(*) n from jq group by t1, t2, t3, t4, round_even(time*3.6e3/6e2, 0)")
def avg_camp(vis):
    return off_ties(closure.average_amplitudes(closure.closure_amplitudes(vis.drop("u", "v"), debias=False), 600.0))


MODEL_LEGS = f"{GAUSS}, " + LEGS.format(m=MD_AMP, source="md")


@query(f"{MODEL_LEGS}{JOINED.format(quads='mx')}@@select [sum(power(a1*a2/(a3*a4)-m1*m2/(m3*m4),2)/(power(a1*a2/(a3*a4),2)*({SUM4})))/count(*)] chisq from jq")
def chisq_camp(vis):
    return chisquares.closure_amplitude(modelled(vis))


@query(f"{MODEL_LEGS}{JOINED.format(quads='mx')}@@select [sum(power(ln(a1)+ln(a2)-ln(a3)-ln(a4)-ln(m1)-ln(m2)+ln(m3)+ln(m4),2)/({SUM4}))/count(*)] chisq from jq")
def chisq_logcamp(vis):
    return chisquares.closure_amplitude(modelled(vis), log=True)


@query("r as (select * from vis where sigma<1e-1 union all select dayno, time, tint, t2, t1, tau2, tau1, -u, -v, vis_re, -vis_im, sigma from vis where sigma>=1e-1)@@select [time] time, least(t1,t2) t1, greatest(t1,t2) t2, case when t1>t2 then -u else u end + 0.0 u, [case when t1>t2 then -vis_im else vis_im end] vis_im from r")
def reorder_baselines(vis):
    """Of a table with some rows turned."""
    turned = V.conjugates(vis).filter((F.col("t1") < F.col("t2")) == (F.col("sigma") < 0.1))
    return tables.canonical(turned).select(*KEYS, "u", "vis_im")


@query("select cast(floor(time/(9e2/3.6e3)) as bigint) \"group\", [min(time)] t_start, [max(time)] t_stop, count(*) n from vis where time>=0 group by all")
def tlist_gathered(vis):
    return tables.time_groups(vis.filter("time >= 0"), 900.0)


@query("select least(t1,t2) t1, greatest(t1,t2) t2, count(*) n, [min(time)] t_start, [max(time)] t_stop, [sum(tint)] tint from vis group by 1, 2")
def bllist(vis):
    return tables.baseline_groups(vis)


SCAN_TABLE = "tm as (select distinct time from vis), lt as (select time, case when time-lag(time) over (order by time)>0.0165e0 then 1 else 0 end n from tm), sg as (select time, sum(n) over (order by time) scan_id from lt), sc as (select cast(scan_id as bigint) scan_id, min(time) t_start, max(time) t_stop from sg group by scan_id)"


@query(f"{SCAN_TABLE}, be as (select * from sc order by abs(t_start-25e-1), t_start limit 1)@@select [time] time, t1, t2 from vis, be where time between t_start and t_stop")
def closest_scan(vis):
    return tables.nearest_scan(vis, V.scans(vis, 0.0165), 2.5).select(*KEYS)


@query(f"{SCAN_TABLE}@@select t1, t2, scan_id, [avg(vis_re)] vis_re, [avg(vis_im)] vis_im, [sqrt(sum(sigma*sigma))/count(*)] sigma, [min(time)] time, [sum(tint)] tint, count(*) n from vis join sc on time between t_start and t_stop group by t1, t2, scan_id")
def avg_coherent_scans(vis):
    return V.coherent_by(V.in_scans(vis, V.scans(vis, 0.0165)), "scan_id")


@query("select [time] time, t1, t2, [sigma] sigma, cast(null as double) extra from vis where sigma<1e-1 union all select [time], t1, t2, [sigma], [2*sigma] from vis where sigma>=1e-1")
def merge_obs(vis):
    return tables.merge(vis.filter("sigma < 0.1"), vis.filter("sigma >= 0.1").withColumn("extra", 2 * F.col("sigma"))).select(*KEYS, "sigma", "extra")


@query("select [time] time, t1, t2 from vis where t1 in ('S0','S2','S5') and t2 in ('S0','S2','S5')")
def make_subarray(vis):
    return tables.subarray(vis, ["S0", "S2", "S5"]).select(*KEYS)


@query("r as (select *, dense_rank() over (order by time) k from vis)@@select [time] time, t1, t2 from r where (k-1)%7=0")
def every_seventh(vis):
    return tables.every_nth(vis, 7).select(*KEYS)


POS = "px as (select image_id, abs(cast(unnest(pix) as double))+1e-2 x, generate_subscripts(pix,1)-1 i from img), pr as (select image_id, x, i, 2e-2+1e-3*i p, i%8 ix, floor(i/8) iy from px)"


def positive(img):
    return img.withColumns({"pix": F.transform("pix", lambda x: F.abs(x.cast("double")) + 0.01), "prior": F.transform(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), lambda i: 0.02 + 0.001 * i)})


@query(
    f"{POS}, c as (select image_id, sum(x) s, sum(x*(ix-35e-1)*5e-1)/2 cx, sum(x*(iy-35e-1)*5e-1)/2 cy from pr group by image_id), d as (select pr.*, c.s, c.cx, c.cy, case when ix<7 then lead(x,1) over w else 0 end - x r, case when i<56 then lead(x,8) over w else 0 end - x b from pr join c using (image_id) window w as (partition by pr.image_id order by i))"
    "@@select image_id, [-power(max(s)-2,2)/4] flux, [-(power(sum(x*5e-1*(4-ix)),2)+power(sum(x*5e-1*(4-iy)),2))/4] cm, [-sum(x*ln(x/p))/2] simple, [sum(x-p-x*ln(x/p))/2] gs, [-sum(x)/2] l1, [-sum(sqrt(x*x+1e-10)/(sqrt(p*p+1e-10)+1e-10))] l1w, [-sum(4/pi()*atan(pi()/2*x/2))/((5e-1+4)/15e-1)] la, [-sum(sqrt(r*r+b*b))/1] tv, [-sum(r*r+b*b)/(625e-4*4)] tv2, [-sum(power(x-p,2))/8] patch, [-sum(x*(power((ix-35e-1)*5e-1-cx,2)+power((iy-35e-1)*5e-1-cy,2)))/2] compact, [-sum(x*x*(power((ix-35e-1)*5e-1,2)+power((iy-35e-1)*5e-1,2)))/4] compact2 from d group by image_id", "images"
)
def image_priors(img):
    return images.priors(positive(img), SIDE, 2.0, 0.5, 1.0)


@query("px as (select image_id, cast(unnest(pix) as double) x, cast(list_max(pix) as double) m, cast(list_min(pix) as double) l from img), z as (select *, l+25e-2*(m-l) cut from px)@@select image_id, [sum(case when x>cut then x else cut end)] flux, [sum(case when x>cut then x else 0 end)] cleared from z group by image_id", "images")
def threshold_images(img):
    flux = lambda fill, name: images.moments(images.threshold(img, 0.25, fill), SIDE).select("image_id", F.col("flux").alias(name))
    return flux(None, "flux").join(flux(0.0, "cleared"), "image_id")


@query(
    f"{POS}, lg as (select *, ln(x) g from pr), d as (select *, case when ix<7 then lead(g,1) over w else 0 end - g r, case when i<56 then lead(g,8) over w else 0 end - g b from lg window w as (partition by image_id order by i))"
    "@@select image_id, [-sum(sqrt(r*r+b*b))/(64*ln(32e0)*5e-1)] tvlog, [-sum(r*r+b*b)/(625e-4*power(64*ln(32e0),2))] tv2log from d group by image_id", "images"
)
def image_log_terms(img):
    return images.log_variation(positive(img), SIDE, 2.0, 0.5, 1.0)


@query("ok as (select time from vis group by time having bool_or('S1' in (t1,t2)) and bool_or('S4' in (t1,t2)))@@select [time] time, t1, t2 from vis join ok using (time)")
def pick_times(vis):
    """Rows at times at which both stations take part."""
    return tables.pick(vis, ["S1", "S4"]).select(*KEYS)


@query("s as (select *, AMP a, case when t1='S0' then 1e-2 when t1='S1' then 5e-2 else 0 end p, case when t2='S0' then 1e-2 when t2='S1' then 5e-2 else 0 end q from vis where 'S3' not in (t1,t2))@@select [time] time, t1, t2, [sqrt(sigma*sigma+(p*p+q*q)*a*a)] sigma from s where a/sigma>=5")
def systematic_noise_snrcut(vis):
    return V.systematic_noise(vis, {"S0": 0.01, "S1": 0.05, "S3": -1.0}, 5.0).select(*KEYS, "sigma")


@query(f"{POS}, z as (select image_id, x a, x*(1+1e-2*(i%5)) b from pr), av as (select image_id, avg(a) ma, avg(b) mb from z group by image_id)@@select image_id, [sqrt(sum(power(a-b,2))/sum(a*a))] nrmse, [sum((a-ma)*(b-mb))/sqrt(sum(power(a-ma,2))*sum(power(b-mb,2)))] nxcorr from z join av using (image_id) group by image_id", "images")
def compare_images(img):
    own = positive(img)
    return images.compare(own, own.withColumn("pix", F.transform("pix", lambda x, i: x * (1 + 0.01 * F.pmod(i, F.lit(5))))))


@query(f"{POS}, z as (select image_id, movie_id, sum(x) i, sum(1e-1*x) q, sum(2e-1*x*(p)) u, sum(5e-2*x) v from pr join img using (image_id) group by all)@@select movie_id, image_id frame, [i] flux, [sqrt(q*q+u*u)/i] linear, [v/i] circular from z", "images")
def polarised_light_curves(img):
    own = positive(img).withColumns({"frame": F.col("image_id"), "i": F.col("pix"), "q": F.transform("pix", lambda x: 0.1 * x), "u": F.zip_with("pix", "prior", lambda x, p: 0.2 * x * p), "v": F.transform("pix", lambda x: 0.05 * x)})
    return images.polarised_curves(own)


@query("t as (select distinct movie_id, unnest([[5e0, 777e0, 1e9]]) \"time\" from img)@@select movie_id, [time] \"time\", coalesce((select max(image_id) from img g where g.movie_id=t.movie_id and g.image_id<=t.time), (select min(image_id) from img g where g.movie_id=t.movie_id)) image_id from t", "images")
def movie_frame_at(img):
    """The latest frame not after each of three times, of movies whose frames are at their ids."""
    times = img.select("movie_id").distinct().withColumn("time", F.explode(F.array(F.lit(5.0), F.lit(777.0), F.lit(1e9))))
    return images.frame_at(img.withColumn("t", F.col("image_id").cast("double")), times)
