"""Structure theory as column expressions: windows, growth, transfer functions, mass functions, occupation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from starloom.functions.cosmology import bbks, tophat

__all__ = ["bbks", "tophat", "gaussian", "grid_window", "cpt_growth", "eh_power", "press_schechter", "sheth_tormen", "linear_bias", "centrals", "satellites"]


def gaussian(x: Column) -> Column:
    return F.exp(-x * x / 2.0)


def grid_window(k: Column, dx: float, order: int) -> Column:
    """sinc(k dx / 2) to the power of the assignment order: 1 nearest cell, 2 cloud in cell, 3 triangular."""
    x = k * (dx / 2)
    s = F.when(F.abs(x) < 1e-6, F.lit(1.0)).otherwise(F.sin(x) / x)
    out = s
    for _ in range(order - 1):
        out = out * s
    return out


def cpt_growth(z: Column, om: float, ol: float) -> Column:
    """Growth after Carroll, Press and Turner 1992, times the scale factor."""
    a = 1.0 / (1.0 + z)
    e2 = F.lit(om) / (a * a * a) + F.lit(1.0 - om - ol) / (a * a) + F.lit(ol)
    m, lam = F.lit(om) / (a * a * a) / e2, F.lit(ol) / e2
    return a * 2.5 * m / (F.pow(m, F.lit(4.0 / 7.0)) - lam + (1.0 + m / 2.0) * (1.0 + lam / 70.0))


def eh_scales(om: float, ob: float, h: float) -> dict[str, float]:
    """Scales of the fit of Eisenstein and Hu 1998 for a microwave background of 2.7 K.

    The numbers are fixed values of the published fit.
    """
    m, b = om * h * h, ob * h * h
    keq, zeq = 7.46e-2 * m, 2.5e4 * m
    b1 = 0.313 * m**-0.419 * (1.0 + 0.607 * m**0.674)
    drag = 1291.0 * m**0.251 / (1.0 + 0.659 * m**0.828) * (1.0 + b1) / (1.0 + 0.238 * m**0.223)
    rd, re = 3.15e4 * b / drag, 3.15e4 * b / zeq
    sound = 2.0 / (3.0 * keq) * math.sqrt(6.0 / re) * math.log((math.sqrt(1.0 + rd) + math.sqrt(rd + re)) / (1.0 + math.sqrt(re)))
    alpha = (46.9 * m) ** 0.67 * (1.0 + (32.1 * m) ** -0.532)
    beta = (12.0 * m) ** 0.424 * (1.0 + (45.0 * m) ** -0.582)
    return {"keq": keq, "sound": sound, "alpha": alpha, "beta": beta, "fb": ob / om}


def eh_power(k: Column, om: float, ob: float, h: float, ns: float, s8: float) -> Column:
    """Power of a simplified Eisenstein-Hu fit with baryon wiggles, normalised by s8 squared over 0.8.

    Quirk Q19 is kept: the smooth part has a pole where ln(1.8 q) = -(14.2 q)**2, near k = 0.0131 by default.
    """
    c = eh_scales(om, ob, h)
    q, ks = k / (13.41 * c["keq"]), k * c["sound"]
    smooth = F.ln(1.8 * q) / (F.ln(1.8 * q) + (14.2 * q) * (14.2 * q))
    fade = 1.0 / (1.0 + F.pow(ks / 5.4, F.lit(4.0)))
    wiggle = (smooth * fade + c["alpha"] * F.exp(-F.pow(ks / c["beta"], F.lit(1.4))) * (1.0 - fade)) / (1.0 + (ks / 5.2) * (ks / 5.2))
    t = c["fb"] * wiggle + (1.0 - c["fb"]) * smooth
    return F.pow(k, F.lit(ns)) * t * t * (s8 * s8 / 0.8)


def press_schechter(sigma: Column, dc: float = 1.686) -> Column:
    nu = F.lit(dc) / sigma
    return F.lit(math.sqrt(2.0 / math.pi)) * nu * F.exp(-nu * nu / 2.0)


def sheth_tormen(sigma: Column, dc: float = 1.686, amp: float = 0.3222, a: float = 0.707, p: float = 0.3) -> Column:
    nu2 = F.lit(a * dc * dc) / (sigma * sigma)
    return F.lit(amp * math.sqrt(2.0 * a / math.pi)) * (1.0 + F.pow(nu2, F.lit(-p))) * F.lit(dc) / sigma * F.exp(-nu2 / 2.0)


def linear_bias(sigma: Column, dc: float = 1.686) -> Column:
    """Bias after Mo and White 1996."""
    nu = F.lit(dc) / sigma
    return 1.0 + (nu * nu - 1.0) / dc


TERMS = 100


def erf(x: Column) -> Column:
    """Error function by its series of positive terms, summed from the last one; beyond 6 it is 1 in doubles."""
    a = F.least(F.abs(x), F.lit(6.0))
    out = F.lit(1.0)
    for i in range(TERMS, 0, -1):
        out = 1.0 + 2.0 * a * a / float(2 * i + 1) * out
    return F.when(x < 0, -1.0).otherwise(1.0) * (2.0 / math.sqrt(math.pi)) * a * F.exp(-a * a) * out


def centrals(log_m: Column, log_min: float, width: float) -> Column:
    """Mean number of central galaxies of a halo: half of one plus the error function."""
    return (1.0 + erf((log_m - log_min) / width)) / 2.0


def satellites(log_m: Column, log_min: float, log_one: float, alpha: float) -> Column:
    over = F.pow(F.lit(10.0), log_m) - 10.0**log_min
    return F.when(over > 0, F.pow(over / 10.0**log_one, F.lit(alpha))).otherwise(0.0)
