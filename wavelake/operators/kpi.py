"""KPI samples: statistics, baselines, regressions, and the wide table of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kpi as f
from ..session import written
from .selection import quantiles

#: Baselines have a row for each scope; beyond this many they are joined by shuffle.
MOST_BROADCAST_SCOPES = 100_000


def usable(kpi: DataFrame) -> DataFrame:
    return kpi.where("ok and value is not null")


def kpi_scope_filter(kpi: DataFrame, **scope: str) -> DataFrame:
    """Usable samples of the given network, band, endpoint_name or probe; a part left out doesn't matter."""
    for part, value in scope.items():
        kpi = kpi.where(F.col(part) == value)
    return usable(kpi)


def distinct_scopes(kpi: DataFrame) -> DataFrame:
    return usable(kpi).select(*f.SCOPE).distinct()


def newest_n_per_scope(kpi: DataFrame, n: int = 200) -> DataFrame:
    """The n usable samples of greatest id of each scope."""
    w = W.partitionBy("scope_key").orderBy(F.col("id").desc())
    return usable(kpi).withColumn("scope_key", f.scope_key()).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def series_summary(samples: DataFrame, *keys: str) -> DataFrame:
    """Robust and plain statistics of value for each group, however large it is. The second pass needs the median, so it is joined by group."""
    keys_ = list(keys)
    plain = samples.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("stddev"), F.min("value").alias("min_value"), F.max("value").alias("max_value")).where("n > 0")
    plain = written(plain, "plain-statistics")
    first = quantiles(samples, keys_, "value", (0.5, 0.95, 0.99), sizes=plain).withColumnsRenamed({"q0_5": "median", "q0_95": "p95", "q0_99": "p99"})
    first = written(plain.join(first, keys_), "statistics")
    apart = samples.join(first.select(*keys, "median"), keys_).select(*keys, F.abs(F.col("value") - F.col("median")).alias("apart"))
    second = quantiles(apart, keys_, "apart", (0.5,), sizes=plain).withColumnRenamed("q0_5", "mad")
    return first.join(second, keys_).withColumns({"jitter": F.col("mad") * 1.4826, "tail_ratio": F.when(F.col("median") != 0, F.col("p99") / F.col("median"))})


def probe_summary(kpi: DataFrame) -> DataFrame:
    """series_summary of the ms probes of each run, over all endpoints."""
    return series_summary(usable(kpi).where("unit = 'ms'"), "run_id", "probe")


def call_quality(kpi: DataFrame) -> DataFrame:
    """The best path of each run as a call would see it; zero round trips and jitters don't count."""
    least = lambda probe, none_at_zero: F.min(F.when((F.col("probe") == probe) & ((F.col("value") > 0) if none_at_zero else F.lit(True)), F.col("value")))
    best = usable(kpi).groupBy("run_id").agg(least("icmp_rtt", True).alias("rtt"), F.coalesce(least("jitter", True), F.lit(0.0)).alias("jitter"), F.coalesce(least("loss", False), F.lit(0.0)).alias("loss")).where("rtt is not null")
    mos = f.mos_estimate(F.col("rtt"), F.col("jitter"), F.col("loss"))
    return best.withColumn("mos", mos).withColumn("quality", f.classify_mos(F.col("mos")))


def baselines(kpi: DataFrame, window: int = 200, min_n: int = 8) -> DataFrame:
    """A robust baseline of each scope over its newest samples. A scope's window is a bounded array, so one shuffle does."""
    newest = newest_n_per_scope(kpi, window).groupBy("scope_key", "probe").agg(F.array_sort(F.collect_list("value")).alias("v"))
    middle = newest.withColumn("median", f.quantile(F.col("v"), 0.5))
    spread = middle.withColumn("d", F.array_sort(F.transform("v", lambda x: F.abs(x - F.col("median")))))
    stats = spread.select("scope_key", F.size("v").cast("long").alias("n"), "median", f.quantile(F.col("d"), 0.5).alias("mad"), f.quantile(F.col("v"), 0.95).alias("p95"), f.quantile(F.col("v"), 0.99).alias("p99"), F.array_min("v").alias("min_value"), F.array_max("v").alias("max_value"), f.unit_of(F.col("probe")).alias("unit"))
    sigma = 3.5 * 1.4826 * F.col("mad")
    relative = F.when(F.col("median") == 0, 0.0).otherwise(F.col("mad") / F.col("median"))
    return stats.where(F.col("n") >= min_n).withColumns({"upper_bound": F.col("median") + sigma, "lower_bound": F.col("median") - sigma, "relative_mad": relative, "noisy": relative > 0.35, "zero_median": F.col("median") == 0})


def kpi_vs_baseline(kpi: DataFrame, base: DataFrame, most: int = MOST_BROADCAST_SCOPES) -> DataFrame:
    """Every usable sample with its scope's baseline, if there is one. The baselines are broadcast if they are at most `most`."""
    right = written(base.drop("unit"), "baselines")  # computed once, for its size and for the join
    small = right.limit(most + 1).count() <= most
    return usable(kpi).withColumn("scope_key", f.scope_key()).join(F.broadcast(right) if small else right, "scope_key", "left")


def verdicts(joined: DataFrame, min_n: int = 8, min_relative: float = 0.25, z: tuple = (3.5, 7.0), ratio: tuple = (2.5, 4.0)) -> DataFrame:
    """z, relative, ratio and verdict of samples that have their baseline beside them."""
    c = F.col
    worse_up, worse_down = c("probe").isin(*f.HIGHER_IS_WORSE), c("probe").isin(*f.HIGHER_IS_BETTER)
    out = joined.withColumns({"z": f.modified_z(c("value"), c("median"), c("mad")), "relative": F.when(c("median") == 0, 0.0).otherwise(F.abs(c("value") - c("median")) / c("median"))})
    factor = F.when((c("median") > 0) & worse_up, c("value") / c("median")).when((c("median") > 0) & worse_down & (c("value") > 0), c("median") / c("value")).when((c("median") > 0) & worse_down, F.lit(float("inf"))).otherwise(1.0)
    better = F.when((c("median") > 0) & worse_down, c("value") / c("median")).when((c("median") > 0) & worse_up & (c("value") > 0), c("median") / c("value")).otherwise(0.0)
    out = out.withColumns({"ratio": factor, "inverse_ratio": better, "got_worse": ((c("z") > 0) & worse_up) | ((c("z") < 0) & worse_down)})
    verdict = (
        F.when(c("n").isNull(), "no_baseline")
        .when(c("n") < min_n, "insufficient_data")
        .when(c("relative") < min_relative, "ok")
        .when(~c("got_worse") & ((F.abs("z") > z[0]) | (c("inverse_ratio") >= ratio[0])), "improved")
        .when(c("got_worse") & ((F.abs("z") >= z[1]) | (c("ratio") >= ratio[1])), "critical")
        .when(c("got_worse") & ((F.abs("z") >= z[0]) | (c("ratio") >= ratio[0])), "warning")
        .otherwise("ok")
    )
    regressed = c("verdict").isin("critical", "warning")
    by_z = F.abs("z") >= F.when(c("verdict") == "critical", z[1]).otherwise(z[0])
    why = F.when(regressed & by_z, "z-score").when(regressed, F.concat(one_decimal(c("ratio")), F.lit("x worse than baseline"))).when(c("verdict") == "improved", "improved")
    noisy = F.when((c("noisy") if "noisy" in joined.columns else F.lit(False)) & (c("verdict") != "improved"), "noisy baseline")
    against = F.concat(decimals(c("value")), F.lit(" against "), decimals(c("median")), F.lit(" +/- "), decimals(c("mad")))
    figures = F.when(c("n").isNull(), F.concat(decimals(c("value")), F.lit(", no baseline yet"))).when(c("n") < min_n, F.concat(decimals(c("value")), F.lit(", baseline of "), c("n"), F.lit(" samples"))).otherwise(against)
    return out.withColumn("verdict", verdict).withColumn("reason", F.concat_ws(", ", figures, why, noisy))


def decimals(x: Column) -> Column:
    """A number with two decimals; it is rounded to six first, so that the last bits of a sum don't show."""
    return F.round(F.round(x, 6), 2).cast("decimal(38,2)").cast("string")


def one_decimal(x: Column) -> Column:
    """A number of at least 1 with one decimal, rounded by its exact binary value and to even at half, as C's printf does."""
    whole = F.floor(x)
    part = ((x - whole) * F.lit(float(1 << 52))).cast("long") * 10  # in units of 2**-52, exact
    digit, rest, half = F.shiftright(part, 52), part.bitwiseAND(F.lit((1 << 52) - 1)), F.lit(1 << 51)
    up = (rest > half) | ((rest == half) & (digit % 2 == 1))
    tenths = whole.cast("decimal(38,0)") * 10 + digit + F.when(up, 1).otherwise(0)
    return F.when(x == float("inf"), "inf").when(x < float(1 << 52), (tenths / 10).cast("decimal(38,1)").cast("string")).otherwise(F.format_string("%.1f", x))


def detect_regressions(kpi: DataFrame, base: DataFrame, **limits) -> DataFrame:
    """A verdict for every usable sample."""
    return verdicts(kpi_vs_baseline(kpi, base), **limits)


def regression_report(found: DataFrame) -> DataFrame:
    """What isn't ok, by scope, with the number of regressions of the scope."""
    bad = F.count_if(F.col("verdict").isin("critical", "warning")).over(W.partitionBy("scope_key"))
    return found.where("verdict <> 'ok'").withColumn("regressions", bad).orderBy("scope_key", "id")


def kpi_rollup(kpi: DataFrame, digits: int = 2) -> DataFrame:
    """Number, average, least and greatest value of each endpoint and probe."""
    return usable(kpi).groupBy("endpoint_name", "probe").agg(F.count("*").alias("n"), F.round(F.avg("value"), digits).alias("avg_value"), F.round(F.min("value"), digits).alias("min_value"), F.round(F.max("value"), digits).alias("max_value"), F.min("unit").alias("unit"))


def query_kpis(kpi: DataFrame, limit: int = 50, **scope: str) -> DataFrame:
    """Average and number by scope, the first `limit` scopes."""
    return kpi_scope_filter(kpi, **scope).groupBy(*f.SCOPE).agg(F.avg("value").alias("avg_value"), F.count("*").alias("n")).orderBy(*f.SCOPE).limit(limit)


def jitter_rfc3550(samples: DataFrame, order: str, *keys: str) -> DataFrame:
    """J += (|D| - J) / 16 over ordered values, as the sum of each step's weight, so no ordered loop is needed."""
    w = W.partitionBy(*keys).orderBy(order)
    steps = samples.withColumns({"d": F.abs(F.col("value") - F.lag("value").over(w)), "i": F.row_number().over(w), "n": F.count("*").over(W.partitionBy(*keys))})
    return steps.groupBy(*keys).agg(F.coalesce(F.sum(F.col("d") / 16 * F.pow(F.lit(15.0 / 16), F.col("n") - F.col("i"))), F.lit(0.0)).alias("jitter"))


def kpi_pivot(kpi: DataFrame, features: list[str] | None = None) -> DataFrame:
    """A row for each run and a column for each endpoint.probe (the given ones, or those found), which has the sample of greatest id."""
    rows = usable(kpi).withColumn("feature", F.concat_ws(".", "endpoint_name", "probe"))
    return rows.groupBy("run_id").pivot("feature", features).agg(F.max_by("value", "id"))


def kpi_features(kpi: DataFrame) -> DataFrame:
    """The pivot's cells as rows: run_id, feature, value."""
    return usable(kpi).groupBy("run_id", F.concat_ws(".", "endpoint_name", "probe").alias("feature")).agg(F.max_by("value", "id").alias("value"))


def common_features(cells: DataFrame) -> DataFrame:
    """Features that every run has."""
    runs = cells.agg(F.countDistinct("run_id").alias("runs"))
    return cells.groupBy("feature").agg(F.countDistinct("run_id").alias("n")).join(F.broadcast(runs), F.col("n") == F.col("runs")).select("feature", "n")


def robust_scale(cells: DataFrame) -> DataFrame:
    """(value - median) / IQR of each feature; without spread, value - median."""
    q = quantiles(cells, ["feature"], "value", (0.25, 0.5, 0.75))
    iqr = F.col("q0_75") - F.col("q0_25")
    return cells.join(q, "feature").select("run_id", "feature", ((F.col("value") - F.col("q0_5")) / F.when(iqr == 0, 1.0).otherwise(iqr)).alias("scaled"))


def mad_deviations(cells: DataFrame) -> DataFrame:
    """(value - median) / MAD of each feature; a MAD of 0 counts as 1e-9."""
    apart = cells.join(quantiles(cells, ["feature"], "value", (0.5,)).withColumnRenamed("q0_5", "median"), "feature").withColumn("apart", F.abs(F.col("value") - F.col("median")))
    spread = quantiles(apart.select("feature", "apart"), ["feature"], "apart", (0.5,)).withColumnRenamed("q0_5", "mad")
    return apart.join(spread, "feature").select("run_id", "feature", ((F.col("value") - F.col("median")) / F.when(F.col("mad") == 0, 1e-9).otherwise(F.col("mad"))).alias("deviation"))


def top_deviations(deviations: DataFrame, k: int = 3) -> DataFrame:
    """The k features of each run that deviate most."""
    w = W.partitionBy("run_id").orderBy(F.abs("deviation").desc(), "feature")
    return deviations.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def link_plausibility_check(link: DataFrame) -> DataFrame:
    """A row for each rule that a telemetry row breaks."""
    c = F.col
    rules = {
        "rssi_range": ~c("rssi_dbm").between(-100, -10), "noise_range": ~c("noise_dbm").between(-120, -60), "snr_sum": c("snr_db") != c("rssi_dbm") - c("noise_dbm"), "snr_low": c("snr_db") < 10,
        "channel_band": F.when(c("band") == "2.4GHz", ~c("channel").between(1, 14)).when(c("band") == "5GHz", ~c("channel").between(32, 177)).otherwise(~c("channel").between(1, 233)),
        "width": ~c("width_mhz").isin(20, 40, 80, 160, 320), "rate": ~((c("tx_rate_mbps") > 0) & (c("tx_rate_mbps") <= width_ceiling(c("width_mhz")))), "quality": c("quality") != f.link_quality(c("snr_db")),
    }
    broken = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))
    return link.withColumn("rule", F.explode(broken))


def width_ceiling(width: Column) -> Column:
    """The highest plausible rate, in Mbit/s."""
    return F.when(width == 20, 600).when(width == 40, 1200).when(width == 80, 2500).when(width == 160, 5000).otherwise(12000)
