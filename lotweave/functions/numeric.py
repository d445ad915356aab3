"""Distributions and closed forms of sensitivity analysis, on the driver."""

from __future__ import annotations

import math

Z95, Z_POWER80 = 1.96, 0.84


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_ppf(p: float) -> float:
    """Inverse of normal_cdf by bisection and Newton steps."""
    if not 0 < p < 1:
        raise ValueError("p must be in (0, 1)")
    lo, hi = -40.0, 40.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if normal_cdf(mid) < p else (lo, mid)
    x = (lo + hi) / 2
    for _ in range(2):
        d = math.exp(-x * x / 2) / math.sqrt(2 * math.pi)
        x -= (normal_cdf(x) - p) / d if d > 0 else 0.0
    return x


def chi2_sf(x: float, df: int) -> float:
    """P(chi-squared with df degrees > x), by the incomplete gamma function's series or continued fraction."""
    if x <= 0:
        return 1.0
    a, z = df / 2, x / 2
    scale = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= z / k
            total += term
        return 1 - total * scale
    b, c = z + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b)
        c = b + step / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return scale * h


def interval(theta: float, se: float) -> tuple[float, float]:
    return theta - Z95 * se, theta + Z95 * se


def detectable(se: float) -> float:
    """The smallest effect found with 80 % power at 5 %."""
    return (Z95 + Z_POWER80) * se


def confounding_factor(eta_y: float, eta_d: float) -> float:
    return eta_y * eta_d / math.sqrt(max(1 - eta_d**2, 1e-12))


def robustness_value(theta: float, scale: float) -> float:
    """The eta at which a confounder equally strong on both sides explains theta: |theta| = scale eta^2 / sqrt(1 - eta^2)."""
    if scale <= 0 or not math.isfinite(theta):
        return math.nan
    a, b = scale**2, theta**2
    return math.sqrt(max(0.0, min((-b + math.sqrt(b * b + 4 * a * b)) / (2 * a), 1.0))) if b else 0.0


def robustness_value_alpha(theta: float, se: float, scale: float, alpha: float = 0.05) -> float:
    return robustness_value(max(0.0, abs(theta) - normal_ppf(1 - alpha / 2) * se), scale)


def e_value(theta: float, sd_y: float) -> float:
    rr = math.exp(0.91 * abs(theta) / sd_y)
    return rr + math.sqrt(rr * (rr - 1))


def e_value_interval(theta: float, se: float, sd_y: float, alpha: float = 0.05) -> float:
    """That of the interval's bound nearer to zero; 1 if zero is inside."""
    z = normal_ppf(1 - alpha / 2)
    near = abs(theta) - z * se
    return e_value(near, sd_y) if near > 0 else 1.0


def regression_robustness(tau: float, se: float) -> float:
    """The share |tau| / (|tau| + 2 se): how strong a confounder must be to explain a regression's coefficient."""
    return abs(tau) / (abs(tau) + 2 * se) if abs(tau) >= 1e-10 else 0.0


def portability(own: float, carried: float) -> str:
    """What a model carried to another market says of text as a cause: it rejects it, supports it, or hardly does."""
    return "rejects_direct" if carried < 0 else "weak_direct" if carried < 0.3 * own else "supports_direct"


def stability(bare: float, adjusted: float) -> str:
    """What an effect's shrinking under confounders says of text as a cause."""
    if abs(bare) <= 1e-3:
        return "near_zero"
    shrunk = 1 - abs(adjusted) / abs(bare)
    return "rejects_direct" if shrunk > 0.5 else "ambiguous" if shrunk > 0.2 else "supports_direct"


def verdict(port: str, stable: str) -> str:
    """Which of two causal models both say."""
    if port == "rejects_direct" and stable in ("rejects_direct", "near_zero"):
        return "no_direct_effect"
    return "direct_effect" if port == stable == "supports_direct" else "ambiguous"


def calibrate(placebo: list[tuple[float, float]], theta: float, se: float) -> dict[str, float]:
    """A focal estimate against the normal distribution of at least five placebo estimates (theta, se)."""
    if len(placebo) < 5:
        raise ValueError("at least 5 placebos are needed")
    ts, ses = [t for t, _ in placebo], sorted(s for _, s in placebo)
    mu = sum(ts) / len(ts)
    sigma = math.sqrt(sum((t - mu) ** 2 for t in ts) / (len(ts) - 1))
    mid = len(ses) // 2
    median = ses[mid] if len(ses) % 2 else (ses[mid - 1] + ses[mid]) / 2
    z = (theta - mu) / max(sigma, se)
    z_nominal = theta / se if se > 0 else math.nan
    return {"mu": mu, "sigma": sigma, "inflation": sigma / median if median > 0 else math.nan, "z": z, "p": 2 * (1 - normal_cdf(abs(z))), "p_nominal": 2 * (1 - normal_cdf(abs(z_nominal)))}


def severity(nmi: float, ratio: float, zero_inside: bool) -> str:
    """How much of an embedding's signal is location."""
    if nmi > 0.4 and ratio > 5 and zero_inside:
        return "severe"
    return "high" if nmi > 0.2 and ratio > 2 else "moderate" if nmi > 0.1 else "low"
