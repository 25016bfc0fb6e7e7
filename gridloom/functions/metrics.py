"""Statistics over samples: scaler fits, errors, overlap, thresholds. Sums are taken map-side; no payload is collected."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays


@dataclass
class StandardScaler:
    """(x - mean) / (std + eps) for each variable, with mean and population std over every element of the fitted samples; or, for a field of
    several levels (its leading axis), over every element of each level: mean and std are then lists."""

    mean: dict[str, float | list[float]] = field(default_factory=dict)
    std: dict[str, float | list[float]] = field(default_factory=dict)
    eps: float = 1e-8

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], levels: dict[str, int] | None = None) -> StandardScaler:
        """One job for all columns. levels: for a column its number of levels."""
        every = None
        for c in columns:
            own, many = F.col(c), (levels or {}).get(c)
            if df.schema[c].dataType.typeName() == "array":
                level = F.floor(F.col("pos") / (F.col("size") / many)) if many else F.lit(0)
                rows = df.select(F.size(c).alias("size"), F.posexplode(c).alias("pos", "v")).select(F.lit(c).alias("c"), level.cast("int").alias("level"), F.col("v").cast("double").alias("v"))
            else:
                rows = df.select(F.lit(c).alias("c"), F.lit(0).alias("level"), own.cast("double").alias("v"))
            every = rows if every is None else every.unionAll(rows)
        found = {(r.c, r.level): r for r in every.groupBy("c", "level").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()}  # a row a level
        out = cls()
        for c in columns:
            many = (levels or {}).get(c)
            for to, name in ((out.mean, "m"), (out.std, "s")):
                each = [found[c, k][name] if (c, k) in found else None for k in range(many or 1)]
                to[c] = each if many else each[0]
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        new = {}
        for c, mean in self.mean.items():
            if isinstance(mean, list):
                new[c] = _by_level(c, mean, self.std[c], self.eps)
            elif df.schema[c].dataType.typeName() == "array":
                new[c] = arrays.standardise(F.col(c), mean, self.std[c], self.eps)
            else:
                new[c] = (F.col(c) - mean) / (self.std[c] + self.eps)
        return df.withColumns(new)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = []
        for c, mean in self.mean.items():
            for k, (m, s) in enumerate(zip(mean, self.std[c]) if isinstance(mean, list) else [(mean, self.std[c])]):
                rows.append((c, k if isinstance(mean, list) else None, m, s, self.eps))
        spark.createDataFrame(rows, "variable string, level int, mean double, std double, eps double").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> StandardScaler:
        out = cls()
        for r in sorted(spark.read.parquet(path).collect(), key=lambda r: (r.variable, r.level or 0)):  # a row a variable and level
            out.eps = r.eps
            for to, x in ((out.mean, r.mean), (out.std, r.std)):
                if r.level is None:
                    to[r.variable] = x
                else:
                    to.setdefault(r.variable, []).append(x)
        return out


def _by_level(column: str, mean: list[float], std: list[float], eps: float) -> Column:
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), F.floor(i / (F.size(column) / len(values))).cast("int") + 1)
    return F.transform(column, lambda v, i: ((v.cast("double") - pick(mean, i)) / (pick(std, i) + eps)).cast("float"))


def rmse(pred, target) -> Column:
    return F.sqrt(F.avg(F.pow(pred - target, F.lit(2.0))))


def psnr(mse, data_range: float = 10.0) -> Column:
    return F.when(mse == 0, float("inf")).otherwise(F.log10(F.lit(data_range * data_range) / mse) * 10)


def iou(pred, target) -> Column:
    """Overlap of two boolean columns over all rows; 1 where neither is ever true."""
    both, either = F.sum((pred & target).cast("double")), F.sum((pred | target).cast("double"))
    return F.when(either > 0, both / either).otherwise(1.0)


def robust_scaled(x, limit: float = 5.0) -> Column:
    """(x - median) / (1.4826 MAD + 1e-6) of a field, clipped; values that are not finite count as 0. Within the row: nothing is shuffled."""
    values = F.transform(arrays.scrub(F.transform(x, lambda v: v.cast("double"))), lambda v: v.cast("double"))
    near = F.transform(F.array(F.struct(values.alias("v"), arrays.middle(values).alias("m"))), lambda r: F.struct(r["v"].alias("v"), r["m"].alias("m"), arrays.middle(F.transform(r["v"], lambda v: F.abs(v - r["m"]))).alias("mad")))
    scaled = F.transform(near, lambda r: F.transform(r["v"], lambda v: F.greatest(F.least((v - r["m"]) / (r["mad"] * 1.4826 + 1e-6), F.lit(limit)), F.lit(-limit))))
    return F.element_at(scaled, 1)


def otsu(x, bins: int = 256) -> Column:
    """The threshold of a field: the centre of the bin (of ``bins`` between its least and greatest value) that parts its values with the greatest
    variance between the parts; the greatest value where all are equal. Within the row, in one pass over the sorted values."""
    values = F.transform(x, lambda v: v.cast("double"))
    state = F.array(F.struct(F.array_sort(values).alias("s"), F.array_min(values).alias("lo"), F.array_max(values).alias("hi")))

    def binned(r):
        step = F.when(r["hi"] > r["lo"], (r["hi"] - r["lo"]) / bins).otherwise(1.0)
        return F.struct(F.transform(r["s"], lambda v: F.least(F.floor((v - r["lo"]) / step), F.lit(bins - 1)).cast("int")).alias("b"), r["lo"].alias("lo"), r["hi"].alias("hi"), step.alias("step"))

    def parted(r):
        n = F.size(r["b"])
        centre = lambda b: r["lo"] + (b + 0.5) * r["step"]
        total = F.aggregate(r["b"], F.lit(0.0), lambda t, b: t + centre(b))
        start = F.struct(F.lit(0).alias("left"), F.lit(0.0).alias("below"), F.lit(-1.0).cast("double").alias("best"), F.lit(0).alias("bin"))

        def step(acc, i):
            b = F.element_at(r["b"], i)
            left, below = acc["left"] + 1, acc["below"] + centre(b)
            gap = below / left - (total - below) / F.greatest(n - left, F.lit(1))
            last = (i == n) | (F.element_at(r["b"], F.least(i + 1, n)) != b)
            spread = F.round(left * (n - left) * gap * gap, 9)
            better = last & (spread > acc["best"])
            return F.struct(left.alias("left"), below.alias("below"), F.when(better, spread).otherwise(acc["best"]).alias("best"), F.when(better, b).otherwise(acc["bin"]).alias("bin"))

        return F.when(r["hi"] > r["lo"], centre(F.aggregate(F.sequence(F.lit(1), n), start, step)["bin"])).otherwise(r["hi"])

    return F.element_at(F.transform(F.transform(state, binned), parted), 1)


def median_iqr(df: DataFrame, by: list[str], value: str) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*by).agg(F.median(v).alias("median"), (F.percentile(v, F.lit(0.75)) - F.percentile(v, F.lit(0.25))).alias("iqr"))


def best_of_medians(df: DataFrame, repeat: list[str], keep: list[str], value: str) -> DataFrame:
    """The median over repeats of each tuning, then the best tuning of each remaining group."""
    return df.groupBy(*keep, *repeat).agg(F.median(value).alias("m")).groupBy(*keep).agg(F.max("m").alias("best"))


def steady_mean(df: DataFrame, by: list[str], epoch: str, value: str) -> DataFrame:
    """The mean without epoch 0; over all epochs where there is no other."""
    return df.groupBy(*by).agg(F.coalesce(F.avg(F.when(F.col(epoch) > 0, F.col(value))), F.avg(value)).alias("steady"))
