"""Expressions over KPI samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The parts of a scope, and which way a probe gets worse.
SCOPE = ("network", "band", "endpoint_name", "probe")
HIGHER_IS_WORSE = ("icmp_rtt", "dns", "tcp_connect", "tls_handshake", "http_ttfb", "jitter", "loss")
HIGHER_IS_BETTER = ("throughput",)


def scope_key(*parts: str) -> Column:
    """network|band|endpoint|probe; a missing part is empty."""
    return F.concat_ws("|", *(F.coalesce(F.col(p), F.lit("")) for p in parts or SCOPE))


def scope_part(key: Column, i: int) -> Column:
    """Part i of a key; a short key is padded with empty parts."""
    return F.coalesce(F.get(F.split(key, r"\|"), F.lit(i)), F.lit(""))


def unit_of(probe: Column) -> Column:
    return F.when(probe == "throughput", "mbps").when(probe == "loss", "pct").otherwise("ms")


def modified_z(value: Column, median: Column, mad: Column) -> Column:
    """Robust z-score; without spread, ten times the relative change."""
    flat = F.when(median == 0, 0.0).otherwise(10.0 * (value - median) / F.abs(median))
    return F.when(mad == 0, flat).otherwise(0.6745 * (value - median) / mad)


def packet_loss_pct(sent: Column, received: Column) -> Column:
    return F.when(sent <= 0, 0.0).otherwise(100.0 * (sent - received) / sent)


#: Least scores of the opinion classes, and least signal-to-noise ratios (dB) of the link classes.
OPINIONS = ((4.3, "excellent"), (4.0, "good"), (3.6, "fair"), (3.1, "poor"))
LINKS = ((40, "excellent"), (25, "good"), (15, "fair"))


def _class(value: Column, least: tuple, otherwise: str) -> Column:
    """The first class that value reaches."""
    return F.coalesce(*(F.when(value >= limit, name) for limit, name in least), F.lit(otherwise))


def mos_estimate(rtt: Column, jitter: Column, loss: Column) -> Column:
    """Mean opinion score, 1 to 5, of the simplified E-model."""
    latency = rtt + 2 * jitter + 10.0
    r = F.when(latency < 160, 93.2 - latency / 40.0).otherwise(93.2 - (latency - 120) / 10.0) - 2.5 * loss
    r = F.greatest(F.lit(0.0), F.least(F.lit(100.0), r))
    return F.greatest(F.lit(1.0), F.least(F.lit(5.0), 1 + 0.035 * r + r * (r - 60) * (100 - r) * 7e-6))


def classify_mos(mos: Column) -> Column:
    return _class(mos, OPINIONS, "unacceptable")


def link_quality(snr: Column) -> Column:
    return _class(snr, LINKS, "poor")


def quantile(sorted_values: Column, p: float) -> Column:
    """Linear interpolation at (n - 1) * p of a sorted array, as weighted values: low + (high - low) * share has other last bits where the two are far apart."""
    at = (F.size(sorted_values) - 1) * F.lit(float(p))
    share = at - F.floor(at)
    return F.get(sorted_values, F.floor(at).cast("int")) * (1 - share) + F.get(sorted_values, F.ceil(at).cast("int")) * share
