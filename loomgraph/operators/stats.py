"""Statistics: tables are aggregated in Spark to sufficient statistics; only those, of bounded size, meet numpy."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph import checkpointed

# --- special functions


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            c = 1 + top / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


# --- ranks and their tests


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """Ranks with ties averaged: counted by value, then cumulated, so only distinct values are sorted."""
    n = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("__n"))
    below = F.sum("__n").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    return df.join(n.select(value, (below + (F.col("__n") + 1) / 2).alias(out)), value)


def mann_whitney(df: DataFrame, value: str, group: str) -> DataFrame:
    """u, p of two groups (group is boolean), with tie correction and continuity correction."""
    cells = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(group)).alias("n1"))
    below = F.sum("n").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    r = cells.select("n", "n1", (below + (F.col("n") + 1) / 2).alias("r")).agg(F.sum(F.col("n1") * F.col("r")).alias("r1"), F.sum("n1").alias("n1"), F.sum("n").alias("n"), F.sum((F.col("n") * F.col("n") * F.col("n") - F.col("n")).cast("double")).alias("ties")).first()
    n1, n2, n = r["n1"], r["n"] - r["n1"], r["n"]
    u = r["r1"] - n1 * (n1 + 1) / 2
    sd = math.sqrt(n1 * n2 / 12 * ((n + 1) - r["ties"] / (n * (n - 1))))
    z = (abs(u - n1 * n2 / 2) - 0.5) / sd if sd else 0.0
    return df.sparkSession.createDataFrame([(float(u), min(1.0, math.erfc(z / math.sqrt(2))))], "u double, p double")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """n, rho, p by Student's t."""
    known = df.select(F.col(x).alias("x"), F.col(y).alias("y")).filter("x is not null and y is not null")
    ranked = average_ranks(average_ranks(known, "x", "rx"), "y", "ry")
    r = ranked.agg(F.count(F.lit(1)).alias("n"), F.corr("rx", "ry").alias("rho")).first()
    n, rho = r["n"], r["rho"]
    p = None if rho is None or n < 3 else 0.0 if abs(rho) >= 1 else t_two_sided(rho * math.sqrt((n - 2) / (1 - rho * rho)), n - 2)
    return df.sparkSession.createDataFrame([(n, rho, p)], "n long, rho double, p double")


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """auc from the rank sum; NULL where a class is missing."""
    cells = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(score).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("n1"))
    below = F.sum("n").over(Window.orderBy(score).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    s = cells.select("n", "n1", (below + (F.col("n") + 1) / 2).alias("r")).agg(F.sum(F.col("n1") * F.col("r")).alias("r1"), F.sum("n1").alias("p"), F.sum("n").alias("n"))
    neg = F.col("n") - F.col("p")
    return s.select(F.round(F.when((F.col("p") > 0) & (neg > 0), (F.col("r1") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * neg)), 6).alias("auc"))


def student_t(df: DataFrame, value: str, group: str) -> DataFrame:
    """t of two groups of equal variance, and the one-sided p of the first (true) being larger."""
    g = df.filter(F.col(value).isNotNull()).groupBy(F.col(group).alias("g")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")).collect()
    one, two = (next((r for r in g if r["g"] is b), None) for b in (True, False))
    t = p = None
    if one and two and one["n"] > 1 and two["n"] > 1:
        df_ = one["n"] + two["n"] - 2
        pooled = ((one["n"] - 1) * one["v"] + (two["n"] - 1) * two["v"]) / df_
        if pooled > 0:
            t = (one["m"] - two["m"]) / math.sqrt(pooled * (1 / one["n"] + 1 / two["n"]))
            p = t_two_sided(t, df_) / 2
            p = p if t > 0 else 1 - p
    return df.sparkSession.createDataFrame([(t, p)], "t double, p double")


def proportion_z(df: DataFrame, flag: str, against: float = 0.7) -> DataFrame:
    """n, share, z, p that the share exceeds `against`."""
    s = df.agg(F.count(flag).alias("n"), F.avg(F.col(flag).cast("double")).alias("share"))
    z = (F.col("share") - against) / F.sqrt(F.lit(against * (1 - against)) / F.col("n"))
    r = s.withColumn("z", z).first()
    p = None if r["z"] is None else 0.5 * math.erfc(r["z"] / math.sqrt(2))
    return df.sparkSession.createDataFrame([(r["n"], r["share"], r["z"], p)], "n long, share double, z double, p double")


def steiger(r1: float, r2: float, r12: float, n: int) -> tuple[float | None, float | None]:
    """z and one-sided p of two correlations that share a variable, with the covariance term of the inventory."""
    if n < 5:
        return None, None
    mean = (r1 + r2) / 2
    h = (1 - r12) ** 2 / (2 * (1 - mean * mean) ** 2)
    z = (math.atanh(r1) - math.atanh(r2)) / math.sqrt(1 / (n - 3) + h / (n - 1))
    return z, 1 - normal_cdf(z)


def auc_comparison(df: DataFrame, a: str, b: str, label: str) -> DataFrame:
    """auc_a, auc_b, z, p, and which one is better at 5 %."""
    c = df.select(F.count(F.lit(1)).alias("n"), F.corr(a, label).alias("r1"), F.corr(b, label).alias("r2"), F.corr(a, b).alias("r12")).first()
    z, p = steiger(c["r1"], c["r2"], c["r12"], c["n"])
    one, two = (auc(df, x, label).first()["auc"] for x in (a, b))
    verdict = "undecided" if p is None or 0.05 <= p <= 0.95 else "first" if p < 0.05 else "second"
    return df.sparkSession.createDataFrame([(one, two, z, p, verdict)], "auc_a double, auc_b double, z double, p double, verdict string")


# --- fits


def log_fit(df: DataFrame, x: str, y: str, low: float | None = None, high: float | None = None, least: int = 1) -> DataFrame:
    """n, slope, intercept, r2 of log10 y on log10 x over positive values; NULL under `least` points."""
    d = df.filter((F.col(x) > 0) & (F.col(y) > 0))
    if low is not None:
        d = d.filter(F.col(x) >= low)
    if high is not None:
        d = d.filter(F.col(x) <= high)
    lx, ly = F.log10(F.col(x).cast("double")), F.log10(F.col(y).cast("double"))
    s = d.agg(F.count(F.lit(1)).alias("n"), F.regr_slope(ly, lx).alias("a"), F.regr_intercept(ly, lx).alias("b"), F.regr_r2(ly, lx).alias("r"))
    ok = F.col("n") >= least
    return s.select("n", F.round(F.when(ok, F.col("a")), 6).alias("slope"), F.round(F.when(ok, F.col("b")), 6).alias("intercept"), F.round(F.when(ok, F.col("r")), 6).alias("r2"))


def _gamma_functions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log gamma and its first two derivatives of positive numbers, by recurrence up to 10 and the asymptotic series there."""
    x = np.asarray(x, dtype=np.float64)
    low, first, second = np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)
    z = x.copy()
    for _ in range(10):
        small = z < 10
        low[small] -= np.log(z[small])
        first[small] -= 1 / z[small]
        second[small] += 1 / z[small] ** 2
        z = np.where(small, z + 1, z)
    i = 1 / z
    i2 = i * i
    log_gamma = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + i * (1 / 12 - i2 * (1 / 360 - i2 * (1 / 1260 - i2 / 1680)))
    digamma = np.log(z) - 0.5 * i - i2 * (1 / 12 - i2 * (1 / 120 - i2 * (1 / 252 - i2 / 240)))
    trigamma = i + 0.5 * i2 + i * i2 * (1 / 6 - i2 * (1 / 30 - i2 * (1 / 42 - i2 / 30)))
    return log_gamma + low, digamma + first, trigamma + second


def _nb2_sums(y: np.ndarray, x: np.ndarray, w: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Log-likelihood of counts with variance mu + alpha mu^2 at theta (coefficients, log alpha), its gradient and its Hessian, in a row."""
    k = x.shape[1]
    a = math.exp(theta[k])
    r = 1 / a
    mu = np.exp(np.clip(x @ theta[:k], -30, 30))
    g_y, d_y, t_y = _gamma_functions(y + r)
    g_r, d_r, t_r = (v[0] for v in _gamma_functions(np.array([r])))
    g_1 = _gamma_functions(y + 1)[0]
    value = g_y - g_r - g_1 + r * np.log(r / (r + mu)) + y * np.log(mu / (r + mu))
    by_eta = (y - mu) / (1 + a * mu)
    by_r = d_y - d_r + np.log(r / (r + mu)) + 1 - (r + y) / (r + mu)
    by_rr = t_y - t_r + 1 / r - 1 / (r + mu) - (mu - y) / (r + mu) ** 2
    gradient = np.concatenate([x.T @ (w * by_eta), [-(w * r * by_r).sum()]])
    hessian = np.zeros((k + 1, k + 1))
    hessian[:k, :k] = -(x * (w * mu * (1 + a * y) / (1 + a * mu) ** 2)[:, None]).T @ x
    hessian[k, :k] = hessian[:k, k] = -(x.T @ (w * a * mu * by_eta / (1 + a * mu)))
    hessian[k, k] = (w * (r * r * by_rr + r * by_r)).sum()
    return np.concatenate([[(w * value).sum()], gradient, hessian.ravel()])


def nb2_fit(df: DataFrame, y: str, regressors: list[str], rounds: int = 100) -> dict:
    """NB2 regression of counts on an intercept and these columns, which may be continuous: coef, se, alpha, loglik, rounds.

    Newton steps. Value, gradient and Hessian are sums over the rows: each task adds up its own, and one row of numbers a
    task meets in an aggregate; the driver solves a system of as many unknowns as there are coefficients. Rows with a
    null take no part. Without rows, or without any count above zero, all values are None.
    """
    names = [y, *regressors]
    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)]).dropna()
    rows = checkpointed(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).cast("double").alias("w")))
    total = rows.agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("c0")).alias("y")).first()
    k = len(names)
    if not total["n"] or not total["y"]:
        return {"coef": [None] * k, "se": [None] * k, "alpha": None, "loglik": None, "rounds": 0}
    size = 1 + (k + 1) + (k + 1) ** 2

    def at(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def add(batches):
            out = np.zeros(size)
            for batch in batches:
                m = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                out += _nb2_sums(m[:, 0], np.column_stack([np.ones(len(m)), m[:, 1:-1]]), m[:, -1], theta)
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(out, pa.float64())], ["i", "v"])

        sums = {r["i"]: r["v"] for r in rows.mapInArrow(add, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
        flat = np.array([sums[i] for i in range(size)])
        return flat[0], flat[1 : k + 2], flat[k + 2 :].reshape(k + 1, k + 1)

    theta = np.zeros(k + 1)
    theta[0], theta[k] = math.log(total["y"] / total["n"]), math.log(0.5)
    best, gradient, hessian = at(theta)
    done = 0
    for done in range(1, rounds + 1):
        values, vectors = np.linalg.eigh(-hessian)
        step = vectors @ ((vectors.T @ gradient) / np.maximum(np.abs(values), 1e-6))
        step *= min(1.0, 4 / max(1e-12, np.abs(step).max()))
        for _ in range(40):
            value, *rest = at(theta + step)
            if value >= best:
                break
            step = step / 2
        else:
            break
        moved, theta, best, (gradient, hessian) = value - best, theta + step, value, rest
        if moved < 1e-10 * max(1.0, abs(best)) or np.abs(step).max() < 1e-9:
            break
    se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(-hessian)), 0))
    return {"coef": theta[:k].tolist(), "se": se[:k].tolist(), "alpha": math.exp(theta[k]), "loglik": float(best), "rounds": done}


def nb2(df: DataFrame, y: str, flag: str, year: str, names: tuple[str, ...] = ("intercept", "multi", "year")) -> DataFrame:
    """term, coef, se, z, p, irr, irr_low, irr_high: counts on a flag and the standardised year, which may be any number."""
    m = df.agg(F.avg(year).alias("m"), F.greatest(F.coalesce(F.stddev_samp(year), F.lit(1.0)), F.lit(1.0)).alias("s")).first()
    fit = nb2_fit(df.select(F.col(y).alias("y"), F.col(flag).cast("int").alias("f"), ((F.col(year) - m["m"]) / m["s"]).alias("t")), "y", ["f", "t"])
    rows = []
    for name, c, s in zip(names, fit["coef"], fit["se"]):
        z = c / s if s else None
        rows.append((name, c, s, z, None if z is None else math.erfc(abs(z) / math.sqrt(2)), *(None if c is None else math.exp(c + x * s) for x in (0, -1.96, 1.96))))
    rows.append(("alpha", fit["alpha"], None, None, None, None, None, None))
    return df.sparkSession.createDataFrame(rows, "term string, coef double, se double, z double, p double, irr double, irr_low double, irr_high double")


def nb_pmf(mu: float, alpha: float, ks: range) -> list[tuple[int, float]]:
    r = 1 / alpha
    return [(k, math.exp(math.lgamma(k + r) - math.lgamma(r) - math.lgamma(k + 1) + r * math.log(r / (r + mu)) + k * math.log(mu / (r + mu)))) for k in ks]


# --- shapes of distributions


def box_stats(df: DataFrame, value: str, group: str, least: int = 1) -> DataFrame:
    """group, n, q1, med, q3, low, high: Tukey's box and whiskers."""
    q = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[F.percentile(value, F.lit(p)).alias(c) for p, c in ((0.25, "q1"), (0.5, "med"), (0.75, "q3"))]).filter(F.col("n") >= least)
    iqr = F.col("q3") - F.col("q1")
    w = df.join(q, group).groupBy(group).agg(F.min(F.when(F.col(value) >= F.col("q1") - 1.5 * iqr, F.col(value))).alias("low"), F.max(F.when(F.col(value) <= F.col("q3") + 1.5 * iqr, F.col(value))).alias("high"))
    return q.join(w, group).select(group, "n", *[F.round(c, 6).alias(c) for c in ("q1", "med", "q3", "low", "high")])


def histogram(df: DataFrame, value: str, width: float = 0.01) -> DataFrame:
    return df.groupBy(F.floor(F.col(value) / width).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def kde(df: DataFrame, x: str, y: str, steps: int = 20, x_limits: tuple[float, float] | None = None, y_limits: tuple[float, float] | None = None, log_x: bool = False) -> DataFrame:
    """gx, gy, density of a Gaussian kernel on a grid of steps x steps points, scaled to a maximum of 1.

    The kernel has the points' covariance times n^(-1/3) (Scott's factor, squared), and every point adds to every grid
    point. The grid covers the limits, else the points' range; with limits only points within them count. log_x spaces
    the first axis by factors. Each task adds up one grid. Points without both numbers, or fewer than two, give none.
    """
    d = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    for name, limits in (("x", x_limits), ("y", y_limits)):
        if limits is not None:
            d = d.filter(F.col(name).between(*limits))
    points = checkpointed(d.groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("w")))
    s = d.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lx"), F.max("x").alias("ux"), F.min("y").alias("ly"), F.max("y").alias("uy"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), F.covar_samp("x", "y").alias("c")).first()
    schema = "gx double, gy double, density double"
    if s["n"] < 2:
        return df.sparkSession.createDataFrame([], schema)
    (lx, ux), (ly, uy) = x_limits or (s["lx"], s["ux"]), y_limits or (s["ly"], s["uy"])
    gx = np.geomspace(max(lx, 1.0), ux, steps) if log_x else np.linspace(lx, ux, steps)
    gy = np.linspace(ly, uy, steps)
    cov = np.array([[s["vx"] or 1e-18, s["c"]], [s["c"], s["vy"] or 1e-18]]) * s["n"] ** (-1 / 3)
    if np.linalg.det(cov) <= 1e-12 * cov[0, 0] * cov[1, 1]:
        cov = np.diag(np.diag(cov))  # points on one line
    inverse = np.linalg.inv(cov)

    def add(batches):
        out = np.zeros((steps, steps))
        for batch in batches:
            px, py, w = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for at in range(0, len(px), 512):
                part = slice(at, at + 512)
                dx, dy = px[part, None] - gx[None, :], py[part, None] - gy[None, :]
                q = inverse[0, 0] * (dx * dx)[:, :, None] + 2 * inverse[0, 1] * dx[:, :, None] * dy[:, None, :] + inverse[1, 1] * (dy * dy)[:, None, :]
                out += np.tensordot(w[part], np.exp(-0.5 * q), axes=1)
        i, j = np.indices(out.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(out.ravel(), pa.float64())], ["i", "j", "d"])

    summed = points.mapInArrow(add, "i int, j int, d double").groupBy("i", "j").agg(F.sum("d").alias("d"))
    on = lambda values, c: F.get(F.array(*map(F.lit, values.tolist())), F.col(c))
    return summed.select(on(gx, "i").alias("gx"), on(gy, "j").alias("gy"), (F.col("d") / F.max("d").over(Window.partitionBy(F.lit(1)))).alias("density"))  # the grid's points alone


def order_statistic(df: DataFrame, value: str, groups: tuple[str, ...] = (), places=lambda n: [F.floor(n / 2)], limit: int = 100_000) -> DataFrame:
    """groups, n, v0, v1, ...: the values at these 0-based places in ascending order; by default the upper median, values[n // 2].

    Selection by counts: an approximate quantile brackets each place, an aggregate counts what is below and inside, and
    while a bracket holds more than limit values of more than one size, counts in 1,024 bins narrow it. Only the distinct
    values of the last bracket are put in order. No task sorts a group. Nulls, and rows with a null group, are left out.
    """
    keys = list(groups) or ["__all"]
    rows = df.select(*[F.col(c) for c in groups], F.col(value).alias("__v")) if groups else df.select(F.lit(0).alias("__all"), F.col(value).alias("__v"))
    rows = rows.dropna()
    kind = rows.schema["__v"].dataType.simpleString()
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"), F.percentile_approx("__v", [i / 100 for i in range(101)], 10_000).alias("__q"))
    asked = sizes.select("*", F.posexplode(F.array(*places(F.col("__n")))).alias("__k", "__place"))
    near = F.floor(F.col("__place") * 100 / F.col("__n")).cast("int")
    state = asked.select(*keys, "__n", "__k", F.col("__place").cast("long").alias("__place"), "__low", "__high", F.get("__q", near - 1).alias("__a"), F.get("__q", near + 2).alias("__b"))
    state = checkpointed(state.withColumns({"__a": F.coalesce("__a", "__low"), "__b": F.coalesce("__b", "__high")}))
    counted = rows.join(state, keys).groupBy(*keys, "__k").agg(F.count_if(F.col("__v") < F.col("__a")).alias("__below"), F.count_if(F.col("__v").between(F.col("__a"), F.col("__b"))).alias("__inside"))
    state = state.join(counted, [*keys, "__k"])
    left, right = F.col("__place") < F.col("__below"), F.col("__place") >= F.col("__below") + F.col("__inside")
    state = checkpointed(state.select(*keys, "__n", "__k", "__place", F.when(left, F.col("__low")).otherwise(F.col("__a")).alias("__a"), F.when(right, F.col("__high")).otherwise(F.col("__b")).alias("__b"), F.when(left, F.lit(0)).otherwise(F.col("__below")).alias("__below")))
    while True:
        inside = rows.join(state, keys).filter(F.col("__v").between(F.col("__a"), F.col("__b")))
        if not inside.filter("__a < __b").groupBy(*keys, "__k").agg(F.count(F.lit(1)).alias("__c")).filter(F.col("__c") > limit).limit(1).count():
            break
        bin_ = F.when(F.col("__b") > F.col("__a"), F.least(F.lit(1023), F.floor((F.col("__v") - F.col("__a")) / (F.col("__b") - F.col("__a")) * 1024))).otherwise(0)
        bins = inside.groupBy(*keys, "__k", "__place", "__below", bin_.alias("__bin")).agg(F.count(F.lit(1)).alias("__c"), F.min("__v").alias("__a"), F.max("__v").alias("__b"))
        so_far = Window.partitionBy(*keys, "__k").orderBy("__bin")  # 1,024 rows
        bins = bins.withColumn("__before", F.col("__below") + F.sum("__c").over(so_far) - F.col("__c")).filter("__place >= __before AND __place < __before + __c")
        state = checkpointed(state.select(*keys, "__n", "__k").join(bins.select(*keys, "__k", "__place", "__a", "__b", F.col("__before").alias("__below")), [*keys, "__k"]))
    distinct = inside.groupBy(*keys, "__k", "__n", "__place", "__below", "__v").agg(F.count(F.lit(1)).alias("__c"))
    so_far = Window.partitionBy(*keys, "__k").orderBy("__v")
    found = distinct.withColumn("__before", F.col("__below") + F.sum("__c").over(so_far) - F.col("__c")).filter("__place >= __before AND __place < __before + __c")
    n = len(places(F.lit(1)))
    return found.groupBy(*keys).agg(F.first("__n").alias("n"), *[F.max(F.when(F.col("__k") == i, F.col("__v"))).cast(kind).alias(f"v{i}") for i in range(n)]).select(*groups, "n", *[f"v{i}" for i in range(n)])


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with each column scaled to its range; 0 where that has no length. The ranges are one row beside."""
    ends = df.agg(*[f(c).alias(f"__{n}{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = {c: (F.col(c) - F.col(f"__lo{i}")) / F.when(F.col(f"__hi{i}") > F.col(f"__lo{i}"), F.col(f"__hi{i}") - F.col(f"__lo{i}")).otherwise(1.0) for i, c in enumerate(columns)}
    return df.join(F.broadcast(ends)).withColumns(scaled).select(*df.columns)  # one row


def log_jitter(df: DataFrame, value: str, seed: int, scale: float = 0.01, most: float = 5.0) -> DataFrame:
    """df with jittered: log10 of the value plus normal noise of this scale, of `most` scales at most, by seed and value."""
    uniform = lambda k: (F.shiftright(F.xxhash64(value, F.lit(seed), F.lit(k)), 12).cast("double") + (2.0**51 + 0.5)) * 2.0**-52
    noise = F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * math.pi * uniform(2))
    return df.withColumn("jittered", F.log10(F.col(value).cast("double")) + scale * F.greatest(F.lit(-most), F.least(F.lit(most), noise)))


def interval(theta: Column, se: Column) -> tuple[Column, Column]:
    """95 % interval; without an error the point itself."""
    half = 1.96 * F.coalesce(se, F.lit(0.0))
    return theta - half, theta + half


def krippendorff(table: list[list[float | None]], level: str = "nominal") -> float | None:
    """Agreement of raters (rows) on units (columns), some missing."""
    units = [[v for v in u if v is not None] for u in zip(*table)]
    units = [u for u in units if len(u) > 1]
    values = [v for u in units for v in u]
    n = len(values)
    if n < 2:
        return None
    apart = (lambda a, b: float(a != b)) if level == "nominal" else (lambda a, b: (a - b) ** 2)
    seen = sum(sum(apart(a, b) for a in u for b in u) / (len(u) - 1) for u in units) / n
    expected = sum(apart(a, b) for a in values for b in values) / (n * (n - 1))
    return 1.0 if expected == 0 else 1 - seen / expected


def agreement(ratings: DataFrame, raters: list[str]) -> DataFrame:
    """alpha: nominal agreement of raters (columns) on units (rows), some missing, from counts that are summed on the map side."""
    known = ratings.select(F.array_compact(F.array(*[F.col(c).cast("string") for c in raters])).alias("v")).filter(F.size("v") > 1)
    m = F.size("v").cast("double")
    same = F.aggregate("v", F.lit(0), lambda n, x: n + F.size(F.filter("v", lambda y: y == x)))
    seen = known.agg(F.sum((m * m - same) / (m - 1)).alias("apart"))
    totals = known.select(F.explode("v").alias("c")).groupBy("c").agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("s"))
    n, expected = F.col("n"), F.col("n") * F.col("n") - F.col("s")
    alpha = F.when(n.isNull(), F.lit(None)).when(expected == 0, 1.0).otherwise(1 - F.col("apart") / n / (expected / (n * (n - 1))))
    return seen.join(totals).select(alpha.alias("alpha"))  # one row each


def nb_pmf_of(mu: Column, alpha: float, k: Column) -> Column:
    """The same as a column; k is a whole number, so its factorials are sums."""
    r = 1 / alpha
    steps = F.aggregate(F.sequence(F.lit(1), k), F.lit(0.0), lambda s, i: s + F.log((i - 1 + r) / i))
    return F.exp(steps + r * F.log(r / (r + mu)) + k * F.log(mu / (r + mu)))


def bootstrap_mean(values: np.ndarray, rounds: int = 1000, seed: int = 42) -> tuple[float, float, float, float]:
    """mean, sample std, and the 2.5 % and 97.5 % order statistics of resampled means."""
    means = np.sort(np.random.default_rng(seed).choice(values, (rounds, len(values))).mean(axis=1))
    return float(values.mean()), float(values.std(ddof=1)) if len(values) > 1 else 0.0, float(means[int(0.025 * rounds) - 1]), float(means[int(0.975 * rounds) - 1])


#: Distinct values in one chunk of a bootstrap, on average.
CHUNK = 4_096


def bootstrap_means(df: DataFrame, value: str, group: str, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """group, mean, std, low, high as bootstrap_mean has them, of all values that are not NULL; no group is in one task.

    Equal values are counted once and dealt over chunks. How many draws of a round fall to each chunk is multinomial by
    the chunks' sizes, and each chunk then draws so many of its own values: together that is drawing from the whole group.
    """
    known = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("x")).filter("x is not null")
    kind = known.schema["g"].dataType.simpleString()
    cells = checkpointed(known.groupBy("g", "x").agg(F.count(F.lit(1)).alias("n")))
    sizes = cells.groupBy(F.col("g").alias("h")).agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    dealt = cells.join(sizes, F.col("g").eqNullSafe(F.col("h"))).select("g", "x", "n", F.expr("pmod(xxhash64(x), chunks)").alias("chunk"))

    def rng(g, *more):
        return np.random.default_rng([seed, *more, *hashlib.blake2b(repr(g).encode(), digest_size=8).digest()])

    def allot(pdf):
        pdf = pdf.sort_values("chunk")
        n = pdf["n"].to_numpy()
        draws = rng(pdf["g"].iloc[0]).multinomial(n.sum(), n / n.sum(), rounds)
        return pdf[["g", "chunk"]].assign(draws=list(draws.T))

    def draw(pdf, told):
        pdf = pdf.sort_values("x")
        n = pdf["n"].to_numpy()
        taken = rng(pdf["g"].iloc[0], 1 + int(pdf["chunk"].iloc[0])).multinomial(told["draws"].iloc[0], n / n.sum())
        return pdf[["g"]].head(1).assign(sums=[taken @ pdf["x"].to_numpy()])

    allotted = dealt.groupBy("g", "chunk").agg(F.sum("n").alias("n")).groupBy("g").applyInPandas(allot, f"g {kind}, chunk long, draws array<long>")
    sums = dealt.groupBy("g", "chunk").cogroup(allotted.groupBy("g", "chunk")).applyInPandas(draw, f"g {kind}, sums array<double>")
    by_round = sums.select("g", F.posexplode("sums")).groupBy("g", "pos").agg(F.sum("col").alias("s"))
    ends = by_round.groupBy(F.col("g").alias("h")).agg(F.sort_array(F.collect_list("s")).alias("s"))
    whole = known.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("std"))
    at = lambda share: F.col("s")[int(share * rounds) - 1] / F.col("n")
    return whole.join(ends, F.col("g").eqNullSafe(F.col("h"))).select(F.col("g").alias(group), "mean", "std", at(0.025).alias("low"), at(0.975).alias("high"))
