"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Spark's own percentile, percentile_approx and KLL sketch over the same column
are timed beside the histogram for comparison.
"""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [HERE, os.environ.get("PYTHONPATH")]))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from sparkhist.operators import bins, histogram, quantiles  # noqa: E402
from sparkhist.plans import queries as Q  # noqa: E402
from sparkhist.plans.layouts import ExponentialLayout, LogLinearLayout, LogOptimalLayout, LogQuadraticLayout  # noqa: E402
from sparkhist.sources import codec  # noqa: E402
from sparkhist.sources.tables import table  # noqa: E402


#: Values recorded where the cost of one is asked for.
MANY = 20_000_000


def shuffle_bytes(spark: SparkSession) -> int:
    """Bytes that all stages so far have written to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    empty = sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, empty, sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    prices = lambda: table(spark, d, "lineitem")
    # Recording alone: log-uniform doubles in [1e3, 1e12], a million, and so many that fixed costs don't count.
    values = lambda n: spark.range(0, n, 1, int(cpus)).select((1000 * F.pow(F.lit(1e9), F.rand(0))).alias("x"))
    by = [Q.FLAG]
    ps = [0.5, 0.95, 0.99]
    layouts = {
        "linear": LogLinearLayout(10, 0.01, 0, 1e12), "quadratic": LogQuadraticLayout(10, 0.01, 0, 1e12),
        "optimal": LogOptimalLayout(10, 0.01, 0, 1e12), "exponential": ExponentialLayout(6),
    }
    todo = {f"record_1m_{k}": (lambda v=v: histogram.record(values(1_000_000), "x", v)) for k, v in layouts.items()}
    todo |= {f"record_20m_{k}": (lambda v=v: histogram.record(values(MANY), "x", v)) for k, v in layouts.items()}
    # The same values made and added up, without a histogram: what to subtract.
    todo["spark_sum_20m"] = lambda: values(MANY).agg(F.sum("x").alias("s"))
    todo |= {
        "quantiles_hist": lambda: Q.flagship(spark, d),
        "spark_percentile": lambda: prices().groupBy(*by).agg(F.percentile(Q.PRICE, F.array(*map(F.lit, ps))).alias("p")),
        "spark_percentile_approx": lambda: prices().groupBy(*by).agg(F.percentile_approx(Q.PRICE, ps, 10000).alias("p")),
        "spark_kll": lambda: prices().groupBy(*by).agg(F.expr(f"kll_sketch_agg_double({Q.PRICE})").alias("s")),
        "many_quantiles": lambda: quantiles.quantiles(
            bins.bins_view(histogram.record(prices(), Q.PRICE, Q.QUADRATIC, by), Q.QUADRATIC, by), [i / 100 for i in range(101)], by
        ),
    }
    for name in ("bin_custom_price", "hist_merge", "hist_rollup", "bins_view", "hist_rebin", "codec_round_trip", "events_daily"):
        todo[name] = lambda f=Q.queries()[name]: f(spark, d)
    took, shuffled = {}, {}
    for name, make in todo.items():
        best = float("inf")
        for _ in range(2 if "20m" in name else 3):
            before = shuffle_bytes(spark)
            start = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        took[name] = round(best, 4)
        shuffled[name] = shuffle_bytes(spark) - before
    exact = {r[0]: r.p for r in todo["spark_percentile"]().collect()}
    worst = max(
        abs(getattr(r, f"p{p * 100:g}") - e) / e
        for r in Q.flagship(spark, d).collect() for p, e in zip(ps, exact[r[0]])
    )
    # Stored bytes of a group: the histogram's binary form, and Spark's sketch of the same values.
    packed = histogram.pack(histogram.record(prices(), Q.PRICE, Q.QUADRATIC, by), by)
    stored = {
        "histogram": packed.agg(F.avg(F.length(codec.encode_column(F.col("hist"), Q.QUADRATIC)))).first()[0],
        "histogram_zlib": packed.agg(F.avg(F.length(codec.encode_column(F.col("hist"), Q.QUADRATIC, True)))).first()[0],
        "spark_kll": todo["spark_kll"]().agg(F.avg(F.length("s"))).first()[0],
    }
    per_value = {k: round((took[f"record_20m_{k}"] - took["spark_sum_20m"]) / MANY * int(cpus) * 1e9, 1) for k in layouts}
    timed = {k: v for k, v in took.items() if "20m" not in k}
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(v for k, v in timed.items() if not k.startswith("spark_")), 4),
        "unit": "sec", "queries": took, "sf": os.path.basename(d.rstrip("/")), "worst_relative_error": worst,
        "core_ns_per_recorded_value": per_value, "shuffle_bytes": shuffled, "stored_bytes_per_group": stored,
        "quantiles_hist_to_percentile_approx": round(took["quantiles_hist"] / took["spark_percentile_approx"], 2),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
