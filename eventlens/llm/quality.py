"""Quality rules: counts per text and robust multivariate outliers.

Base counts are taken over whole texts. Texts that pass the base rule are described by transformed
statistics and judged against the minimum-covariance-determinant estimate of their language and
source: from several starts, concentration steps (each the mean and covariance of the half of the group that was
nearest under the last one) go on until the determinant stops falling, and the least determinant counts (determinants).
Every step is an aggregate over all rows of all groups at once; a group is one row of sums, so a source with a third
of all rows is summed like any other. Rows whose squared distance is beyond `cutoff`, the 0.999 quantile of the
chi-squared law, are outliers. Where the median distance is above that of the law, distances are scaled down to it;
a smaller median isn't scaled up, as it only says that statistics vary less than their floors (most texts have no
symbols and no repeats at all).

Every group has its own estimate, whatever its size. It is drawn towards its language's, and that towards the estimate of all
texts, as if the parent had `prior` rows: so few rows say little and there is no size at which the rule changes. The covariance gets
a floor per statistic, so that a statistic that is constant in a clean group doesn't turn a single symbol into an outlier.
Floors times the root of `cutoff` lie within every statistic's range past the base rule, so each can reject alone.

Null and empty texts have no words and fail the base rule; null languages and sources are values
like any other. Equal texts in a group get equal verdicts; ids don't matter, repeated rows count as
often as they occur. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import BROADCAST_ROWS, cut, lookup, ship
from eventlens.llm.substring import window_hashes

_WHITE, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
_TAIL, _UPPER = bytes(range(0x80, 0xC0)), bytes(range(0x41, 0x5B))
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Transformed statistics and the least standard deviation each is taken to have.
FLOORS = {"z_length": 0.08, "z_symbols": 0.12, "z_lines": 0.15, "z_repeats": 0.12, "z_upper": 0.08}
#: Rows that a group's parent counts for; squared distance that rejects (0.999 quantile of the chi-squared law, 5 degrees of freedom).
PRIOR, CUTOFF = 100.0, 20.515
#: Concentration steps at most after the choice of a start; fall of the determinant's logarithm that is none; accuracy of percentiles.
STEPS, SETTLED, ACCURACY = 40, 1e-3, 2_000
#: Median of the chi-squared law of five degrees of freedom.
CHI2_MEDIAN = 4.3515


def counts(text: bytes | None) -> tuple[int, int, int, int, int, int, int]:
    """The base counts, lines with a word and ASCII capitals of one text."""
    raw = text or b""
    words = raw.split()
    if not words:
        return 0, 0, len(raw) - len(raw.translate(None, _SYMBOLS)), 0, 0, 0, 0
    chars = len(raw.translate(None, _WHITE + _TAIL))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip(_WHITE)]
    h = window_hashes(words, 3)
    repeated = 0
    if len(h) > 1:
        _, inverse, n = np.unique(h, return_inverse=True, return_counts=True)
        twice = n[inverse] > 1
        covered = np.zeros(len(words), bool)
        for k in range(3):
            covered[k : k + len(twice)] |= twice
        repeated = int(covered.sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), len(raw) - len(raw.translate(None, _UPPER))


def base_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang, source, the base counts, lines and capitals of every whole text."""
    ship(df.sparkSession)
    names = [*BASE, "lines", "capitals"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.array([counts(t) for t in batch.column(3).to_pylist()], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(table[:, k]) for k in range(len(names)))], [id_col, "lang", "source", *names])

    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(id_col, F.col("lang").cast("string"), F.col("source").cast("string"), F.encode(F.col(text_col), "UTF-8"))
    return source.mapInArrow(run, f"`{id_col}` {kind}, lang string, source string, " + ", ".join(f"{x} bigint" for x in names))


def _statistics() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "z_length": F.log((F.col("word_chars") + 1) / n),
        "z_symbols": F.sqrt(F.col("n_symbols") / n),
        "z_lines": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("lines"), F.lit(1))),
        "z_repeats": F.sqrt(F.col("n_repeat_words") / n),
        "z_upper": F.sqrt(F.col("capitals") / F.greatest(F.col("word_chars"), F.lit(1))),
    }


def _distance(z: list[str]) -> Column:
    """Squared distance under the group's mean and inverse (row-major arrays)."""
    off = [F.col(x) - F.col("mean")[i] for i, x in enumerate(z)]
    return sum(((1.0 if i == j else 2.0) * off[i] * off[j] * F.col("inverse")[i * len(z) + j] for i in range(len(z)) for j in range(i, len(z))), F.lit(0.0))


def _estimate(chosen: DataFrame, z: list[str], keys: list[str]) -> DataFrame:
    """keys, mean, cov, inverse, det (logarithm of the covariance's determinant); one row of sums a group reaches numpy."""
    sums = [F.sum(x).alias(f"s_{x}") for x in z]
    cross = [F.sum(F.col(z[i]) * F.col(z[j])).alias(f"c_{i}_{j}") for i in range(len(z)) for j in range(i, len(z))]
    floors = np.array([FLOORS[x] for x in z])

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for _, r in frame.iterrows():
                mean = np.array([r[f"s_{x}"] for x in z], float) / r["n"]
                c = np.zeros((len(z), len(z)))
                for i in range(len(z)):
                    for j in range(i, len(z)):
                        c[i, j] = c[j, i] = r[f"c_{i}_{j}"] / r["n"] - mean[i] * mean[j]
                c += np.diag(floors**2)
                out.append((*(r[k] for k in keys), mean.tolist(), c.ravel().tolist(), np.linalg.inv(c).ravel().tolist(), float(np.linalg.slogdet(c)[1])))
            yield pd.DataFrame(out, columns=[*keys, "mean", "cov", "inverse", "det"])

    kinds = {"grp": "string", "start": "int"}
    agg = chosen.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums, *cross)
    return agg.mapInPandas(solve, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", mean array<double>, cov array<double>, inverse array<double>, det double")


def determinants(rows: DataFrame, z: list[str], few: bool = True) -> DataFrame:
    """grp, mean, cov, inverse, det: the minimum-covariance-determinant estimate of every grp of rows (grp, *z).

    Three starts a group: the half of its rows nearest to the median by the sum of squares, by the largest and by the sum of the
    deviations, in units of the median absolute deviation. After two concentration steps the start of least determinant goes on, until
    a step lowers no group's determinant any more. The determinants seen never rise, so every group ends. Only what is read again is
    checkpointed, once a step: every file of a checkpoint on a local file system is a process or more that the executor starts.
    """

    def small(per_group: DataFrame) -> DataFrame:
        return F.broadcast(per_group) if few else per_group

    def halves(near: DataFrame, keys: list[str]) -> DataFrame:
        half = near.groupBy(*keys).agg(F.percentile_approx("d2", 0.5, ACCURACY).alias("half"))
        return _estimate(near.join(small(half), keys).where("d2 <= half"), z, keys)

    medians = rows.groupBy("grp").agg(*(F.percentile_approx(x, 0.5, ACCURACY).alias(f"m_{x}") for x in z))
    spread = rows.join(small(medians), "grp").groupBy("grp").agg(*(F.first(f"m_{x}").alias(f"m_{x}") for x in z), *(F.percentile_approx(F.abs(F.col(x) - F.col(f"m_{x}")), 0.5, ACCURACY).alias(f"d_{x}") for x in z))
    placed = rows.join(small(cut(spread)), "grp")
    off = [F.abs(F.col(x) - F.col(f"m_{x}")) / F.sqrt(F.pow(1.4826 * F.col(f"d_{x}"), 2) + FLOORS[x] ** 2) for x in z]
    begin = F.array(sum((o * o for o in off), F.lit(0.0)), F.greatest(*off), sum(off, F.lit(0.0)))
    model = cut(halves(placed.select("grp", *z, F.posexplode(begin).alias("start", "d2")), ["grp", "start"]))
    for _ in range(2):
        model = cut(halves(rows.join(small(model), "grp").select("grp", "start", *z, _distance(z).alias("d2")), ["grp", "start"]))
    best = model.groupBy("grp").agg(F.min(F.struct("det", "start", "mean", "cov", "inverse")).alias("m"))
    best = best.select("grp", *(f"m.{c}" for c in ("mean", "cov", "inverse", "det")), F.lit(True).alias("moving"))
    for _ in range(STEPS):
        moved = halves(rows.join(small(best.where("moving")), "grp").select("grp", *z, _distance(z).alias("d2")), ["grp"])
        moved = moved.select("grp", F.struct("mean", "cov", "inverse", "det").alias("new"))
        lower = F.coalesce(F.col("new.det") < F.col("det") - SETTLED, F.lit(False))
        both = best.join(small(moved), "grp", "left")
        best = cut(both.select("grp", *(F.when(lower, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in ("mean", "cov", "inverse", "det")), lower.alias("moving")))
        if best.where("moving").isEmpty():
            break
    return best.drop("moving")


def _blend(z: list[str]) -> tuple[Column, Column]:
    """mean and cov of a group drawn towards its parent's (p_mean, p_cov) with weight 1 - w, as those of a mixture of the two."""
    k, w = len(z), F.col("w")
    mean = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: w * F.get("mean", i) + (1 - w) * F.get("p_mean", i))
    gap = [F.col("mean")[i] - F.col("p_mean")[i] for i in range(k)]
    cov = [w * F.col("cov")[i * k + j] + (1 - w) * F.col("p_cov")[i * k + j] + w * (1 - w) * gap[i] * gap[j] for i in range(k) for j in range(k)]
    return mean, F.array(*cov)


def _inverted(models: DataFrame) -> DataFrame:
    """own, w, mean and inverse of models with own, w, mean, cov."""

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            k = int(len(frame["cov"].iloc[0]) ** 0.5) if len(frame) else 0
            frame["inverse"] = [np.linalg.inv(np.array(c).reshape(k, k)).ravel().tolist() for c in frame["cov"]]
            yield frame[["own", "w", "mean", "inverse"]]

    return models.select("own", "w", "mean", "cov").mapInPandas(solve, "own string, w double, mean array<double>, inverse array<double>")


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prior: float = PRIOR, cutoff: float = CUTOFF) -> DataFrame:
    """id, base counts, base_failed, distance (squared, null where the base rule failed) and kept."""
    z = list(FLOORS)
    counted = base_counts(df, id_col, text_col)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counted = cut(counted.withColumn("base_failed", failed).withColumns(_statistics()).withColumn("own", F.to_json(F.struct("lang", "source"))))

    rows = counted.where("not base_failed").select(*z, "own", F.concat(F.lit("lang "), F.to_json(F.struct("lang"))).alias("wide"))
    groups = cut(rows.groupBy("own", "wide").agg(F.count(F.lit(1)).alias("n")))
    few = groups.count() <= BROADCAST_ROWS
    rows = cut(rows.select(*z, F.explode(F.array("own", "wide", F.lit("all"))).alias("grp")))
    models = determinants(rows, z, few).select("grp", "mean", "cov")

    def parent(of: DataFrame, key: str) -> DataFrame:
        book = models.select(F.col("grp").alias(key), F.col("mean").alias("p_mean"), F.col("cov").alias("p_cov"))
        return of.join(F.broadcast(book) if few else book, key)

    mean, cov = _blend(z)
    weight = (F.col("n") / (F.col("n") + prior)).alias("w")
    wide = groups.groupBy("wide").agg(F.sum("n").alias("n")).select("wide", weight, F.lit("all").alias("top"))
    wide = parent(wide.join(models, F.col("wide") == F.col("grp")), "top").select("wide", mean.alias("p_mean"), cov.alias("p_cov"))
    own = groups.select("own", "wide", weight).join(models, F.col("own") == F.col("grp")).join(wide, "wide").select("own", "w", mean.alias("mean"), cov.alias("cov"))
    final = cut(_inverted(own))
    judged = lookup(counted.where("not base_failed"), final, "own", small=few).select("own", "w", _distance(z).alias("d2"))
    # Where the median distance is above the law's, distances are scaled down to it; few rows say little of their median.
    median = F.percentile_approx("d2", 0.5, ACCURACY)
    down = F.least(F.lit(0.0), F.log(CHI2_MEDIAN / F.greatest(median, F.lit(1e-9))))
    overall = judged.agg(down.alias("overall"))
    scale = judged.groupBy("own").agg(F.first("w").alias("w"), down.alias("down")).crossJoin(F.broadcast(overall))
    scale = scale.select("own", F.exp(F.col("w") * F.col("down") + (1 - F.col("w")) * F.col("overall")).alias("scale"))
    final = cut(lookup(final, scale, "own", small=few))

    out = lookup(counted, final, "own", "left", small=few)
    distance = F.when(~F.col("base_failed"), _distance(z) * F.col("scale"))
    kept = ~F.col("base_failed") & (F.coalesce(distance, F.lit(0.0)) <= cutoff)
    return out.select(id_col, *BASE, "base_failed", distance.alias("distance"), kept.alias("kept"))
