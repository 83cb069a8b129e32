"""Numeric and iterative models: series tests per byte run grouped in pandas, window models train on the window table (one row a window).

Window tables hold one row for each half window of time, so training data is small against the frames; it is bounded by ``most`` rows all the
same, taken by hash, and every window is scored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framequarry.checkpoints import cut
from framequarry.operators.graph import components

FEATURES = ["frames", "ids", "entropy", "duration_ms", "constant"]


def training_matrix(features: DataFrame, columns: list[str], most: int = 20_000) -> np.ndarray:
    """At most ``most`` rows of the window table, the least by a hash of the window, in window order."""
    rows = features.select("win", *columns).orderBy(F.xxhash64("win"), "win").limit(most).toPandas().sort_values("win")
    return rows[columns].to_numpy(dtype=float)


def spectrum(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Magnitudes over N of the series padded with zeros to a power of two, the first halved."""
    n = 1 << max(1, int(len(values) - 1).bit_length())
    mag = np.abs(np.fft.rfft(values, n)) / n
    mag[0] /= 2
    return mag, n


def fft_peaks(series: DataFrame, top: int = 10) -> DataFrame:
    """The peaks above 15 % of the greatest magnitude of each byte's series (can_id, byte_idx, ord, value), with their periods in samples."""
    def over(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("ord")["value"].to_numpy(dtype=float)
        mag, n = spectrum(v - v.mean())
        inside = np.arange(1, len(mag) - 1)
        peaks = [i for i in inside if mag[i] >= mag[i - 1] and mag[i] >= mag[i + 1] and mag[i] > 0.15 * mag.max()]
        peaks = sorted(peaks, key=lambda i: (-mag[i], i))[:top]
        return pd.DataFrame([(pdf["can_id"].iloc[0], pdf["byte_idx"].iloc[0], int(i), round(n / i, 9), round(float(mag[i]), 9)) for i in peaks], columns=["can_id", "byte_idx", "bin", "period", "magnitude"])

    return series.groupBy("can_id", "byte_idx").applyInPandas(over, "can_id long, byte_idx long, bin long, period double, magnitude double")


def granger_f(x: np.ndarray, y: np.ndarray, lag: int) -> float:
    """The F statistic of x's last ``lag`` values added to y's own in predicting y."""
    t = len(y) - lag
    own = np.column_stack([np.ones(t), *(y[lag - k : len(y) - k] for k in range(1, lag + 1))])
    both = np.column_stack([own, *(x[lag - k : len(x) - k] for k in range(1, lag + 1))])
    rss = [float(((y[lag:] - m @ np.linalg.lstsq(m, y[lag:], rcond=None)[0]) ** 2).sum()) for m in (own, both)]
    free = t - both.shape[1]
    return (rss[0] - rss[1]) / lag / (rss[1] / free) if free > 0 and rss[1] > 1e-12 else 0.0


def granger(series: DataFrame, most_lag: int = 5) -> DataFrame:
    """The best F over lags 1 to most_lag of each byte's series (with column target), its lag, and p as the reference gives it (p_compat) and by the F distribution (p_exact)."""
    from framequarry.operators.learn import p_value

    def f_tail(f: float, d1: int, d2: int) -> float:
        # P(F > f) by Simpson's rule over the beta density in t = d1 f / (d1 f + d2).
        if f <= 0 or d2 <= 0:
            return 1.0
        a, b, t0 = d1 / 2, d2 / 2, d1 * f / (d1 * f + d2)
        t = np.linspace(t0, 1, 4001)[:-1]
        t[0] = max(t[0], 1e-12)
        dens = np.exp((a - 1) * np.log(t) + (b - 1) * np.log1p(-t) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
        return float(min(1.0, np.trapezoid(dens, t)))

    def over(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        x, y = (pdf[c].to_numpy(dtype=float) for c in ("value", "target"))
        fs = [(granger_f(x, y, k), k) for k in range(1, most_lag + 1) if len(y) > 3 * k + 2]
        if not fs or x.std() < 1e-9 or y.std() < 1e-9:
            return pd.DataFrame(columns=["can_id", "byte_idx", "lag", "f", "p_compat", "p_exact"])
        f, k = max(fs)
        free = len(y) - k - 2 * k - 1
        return pd.DataFrame([(pdf["can_id"].iloc[0], pdf["byte_idx"].iloc[0], k, round(f, 9), p_value(math.sqrt(f / (f + free)), len(y)), f_tail(f, k, free))], columns=["can_id", "byte_idx", "lag", "f", "p_compat", "p_exact"])

    return series.groupBy("can_id", "byte_idx").applyInPandas(over, "can_id long, byte_idx long, lag long, f double, p_compat double, p_exact double")


def change_points(values: np.ndarray, least: int = 10, gain: float = 0.01) -> list[int]:
    """Where binary segmentation splits a series: the cut that lowers the summed squared deviation most, if by more than ``gain`` of the whole, recursively."""
    total = float(((values - values.mean()) ** 2).sum()) if len(values) else 0.0
    if total <= 1e-12:
        return []
    s1, s2 = np.concatenate(([0], np.cumsum(values))), np.concatenate(([0], np.cumsum(values * values)))
    out, stack = [], [(0, len(values))]
    while stack:
        a, b = stack.pop()
        if b - a < 2 * least:
            continue
        cost = lambda i, j: s2[j] - s2[i] - (s1[j] - s1[i]) ** 2 / (j - i)
        cuts = np.arange(a + least, b - least + 1)
        costs = cost(a, cuts) + cost(cuts, b)
        best = int(np.argmin(costs))
        if (cost(a, b) - costs[best]) / total > gain:
            at = int(cuts[best])
            out.append(at)
            stack += [(a, at), (at, b)]
    return sorted(out)


def series_changes(series: DataFrame, least: int = 10) -> DataFrame:
    def over(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("ord")["value"].to_numpy(dtype=float)
        return pd.DataFrame([(pdf["can_id"].iloc[0], pdf["byte_idx"].iloc[0], i) for i in change_points(v, least)], columns=["can_id", "byte_idx", "at"])

    return series.groupBy("can_id", "byte_idx").applyInPandas(over, "can_id long, byte_idx long, at long")


def bootstrap_models(pairs: DataFrame, rounds: int = 100, size: int = 20, seed: int = 7) -> DataFrame:
    """Each byte's line with the 5 % and 95 % quantiles of residual means over ``rounds`` resamples of at most ``size`` residuals."""
    def over(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["avg_byte"].to_numpy(dtype=float), pdf["value"].to_numpy(dtype=float)
        cols = ["can_id", "byte_idx", "slope", "intercept", "low", "high"]
        if len(x) < 3 or x.std() < 1e-9:
            return pd.DataFrame(columns=cols)
        slope = float(np.cov(x, y, bias=True)[0, 1] / x.var())
        rest = np.sort(y - slope * x - (y.mean() - slope * x.mean()))
        rng = np.random.default_rng(seed)
        means = rest[rng.integers(0, len(rest), (rounds, min(size, len(rest))))].mean(axis=1)
        return pd.DataFrame([(pdf["can_id"].iloc[0], pdf["byte_idx"].iloc[0], slope, float(y.mean() - slope * x.mean()), float(np.quantile(means, 0.05)), float(np.quantile(means, 0.95)))], columns=cols)

    return pairs.groupBy("can_id", "byte_idx").applyInPandas(over, "can_id long, byte_idx long, slope double, intercept double, low double, high double")


def _depth_left(n: float) -> float:
    """The mean path of a search that ends among n points."""
    return 0.0 if n <= 1 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def isolation_forest(x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 42) -> list:
    """Trees of random cuts over samples of at most ``sample`` rows, as nested (column, cut, left, right) or sizes."""
    rng = np.random.default_rng(seed)
    psi = min(sample, len(x))
    deepest = math.ceil(math.log2(max(psi, 2)))

    def grow(rows: np.ndarray, depth: int):
        spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) else []
        if depth >= deepest or len(rows) <= 1 or not len(spread):
            return len(rows)
        c = int(rng.choice(spread))
        cut = float(rng.uniform(rows[:, c].min(), rows[:, c].max()))
        low = rows[:, c] < cut
        return (c, cut, grow(rows[low], depth + 1), grow(rows[~low], depth + 1))

    return [grow(x[rng.choice(len(x), psi, replace=False)], 0) for _ in range(trees)] if len(x) else []


def isolation_score(forest: list, x: np.ndarray, sample: int) -> np.ndarray:
    def path(tree, row) -> float:
        depth = 0
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
            depth += 1
        return depth + _depth_left(tree)

    c = _depth_left(sample) or 1.0
    return np.array([2 ** (-np.mean([path(t, r) for t in forest]) / c) for r in x])


def isolation_scores(features: DataFrame, trees: int = 100, sample: int = 256, most: int = 20_000) -> DataFrame:
    """Every window's score by a forest trained on at most ``most`` windows; the forest (at most trees * 2 * sample nodes) goes to the executors."""
    columns = FEATURES[:4]
    x = training_matrix(features, columns, most)
    forest, psi = isolation_forest(x, trees, sample), min(sample, len(x))

    def over(batches):
        for pdf in batches:
            yield pd.DataFrame({"win": pdf["win"], "score": isolation_score(forest, pdf[columns].to_numpy(dtype=float), psi)})

    return features.select("win", *columns).mapInPandas(over, "win long, score double")


def _assembled(features: DataFrame, columns: list[str]) -> DataFrame:
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    rows = VectorAssembler(inputCols=columns, outputCol="raw").transform(features.select("win", *(F.col(c).cast("double").alias(c) for c in columns)))
    return StandardScaler(inputCol="raw", outputCol="vec", withMean=True).fit(rows).transform(rows)


def cluster_windows(features: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """Windows by k-means over the scaled features."""
    from pyspark.ml.clustering import KMeans

    rows = _assembled(features, FEATURES[:4])
    return KMeans(k=k, seed=seed, featuresCol="vec", maxIter=100, tol=0.001).fit(rows).transform(rows).select("win", F.col("prediction").alias("cluster"))


def elbow(features: DataFrame, most: int = 10, seed: int = 42) -> DataFrame:
    """The within-cluster sum of squares for 1 to ``most`` clusters; a single one from the moments."""
    from pyspark.ml.clustering import KMeans

    rows = _assembled(features, FEATURES[:4]).select("vec").cache()
    n = rows.count()
    costs = [(1, float((n - 1) * len(FEATURES[:4])))] + [(k, float(KMeans(k=k, seed=seed, featuresCol="vec").fit(rows).summary.trainingCost)) for k in range(2, most + 1)]
    return features.sparkSession.createDataFrame(costs, "k int, wcss double")


def dominant_ids(windows: DataFrame, clusters: DataFrame, top: int = 3) -> DataFrame:
    """The three most frequent identifiers of each cluster."""
    n = windows.join(clusters, "win").groupBy("cluster", "can_id").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "can_id"))).filter(F.col("rank") <= top)


def dbscan(x: np.ndarray, eps: float, least: int) -> np.ndarray:
    """Cluster numbers by density, noise -1; points are met in order, so numbers are those of their first core point."""
    labels, cluster = np.full(len(x), -2), -1
    near = lambda i: np.flatnonzero(((x - x[i]) ** 2).sum(axis=1) <= eps * eps)
    for i in range(len(x)):
        if labels[i] != -2:
            continue
        own = near(i)
        if len(own) < least:
            labels[i] = -1
            continue
        cluster += 1
        labels[i] = cluster
        queue = list(own)
        while queue:
            j = queue.pop()
            if labels[j] == -1:
                labels[j] = cluster
            if labels[j] != -2:
                continue
            labels[j] = cluster
            more = near(j)
            if len(more) >= least:
                queue += more.tolist()
    return labels


def dbscan_windows(features: DataFrame, eps: float = 0.5, least: int = 5) -> DataFrame:
    """Every window's cluster by density over the scaled features, -1 for noise, as dbscan() numbers them.

    Windows fall into a grid of cells eps wide and meet those of the 3^4 cells around theirs. Core windows within eps form components; a
    component's number is its rank by its first core window, and a border window takes the lowest number among its core neighbours'.
    The neighbour pairs of crowded cells are what this costs: density asks for them.
    """
    columns = FEATURES[:4]
    moments = features.agg(*(f(c).alias(f"{name}_{c}") for c in columns for name, f in (("m", F.avg), ("s", F.stddev_pop))))
    scaled = [(F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0) for c in columns]
    points = cut(features.crossJoin(F.broadcast(moments)).select("win", F.array(*scaled).alias("x")))
    cell = lambda i: F.floor(F.get("x", F.lit(i)) / eps)
    own = points.select("win", "x", *(cell(i).alias(f"c{i}") for i in range(len(columns))))
    around = points.select(F.col("win").alias("a"), F.col("x").alias("xa"), *(cell(i).alias(f"c{i}") for i in range(len(columns))))
    for i in range(len(columns)):
        around = around.withColumn(f"c{i}", F.explode(F.sequence(F.col(f"c{i}") - 1, F.col(f"c{i}") + 1)))
    far = F.aggregate(F.zip_with("xa", "x", lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, d: s + d)
    near = cut(around.join(own, [f"c{i}" for i in range(len(columns))]).filter(far <= eps * eps).select("a", F.col("win").alias("b")))
    cores = near.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select(F.col("a").alias("core"))
    ties = near.join(cores, near["b"] == cores["core"]).drop("core")  # from any window to its core neighbours
    comp = components(ties.join(cores, ties["a"] == cores["core"], "left_semi"))
    firsts = comp.select("comp").distinct().withColumn("cluster", F.row_number().over(Window.orderBy("comp")) - 1)  # one row a cluster
    of = ties.join(comp.join(firsts, "comp").select(F.col("node").alias("b"), "cluster"), "b").groupBy("a").agg(F.min("cluster").alias("cluster"))
    return points.select("win").join(of.withColumnRenamed("a", "win"), "win", "left").select("win", F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"))


def pca_windows(features: DataFrame, k: int = 2) -> DataFrame:
    """The windows on the first k principal components of the scaled features (the constant one left out). Signs are free."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    rows = _assembled(features, FEATURES[:4])
    out = PCA(k=k, inputCol="vec", outputCol="pc").fit(rows).transform(rows)
    return out.select("win", *(vector_to_array("pc")[i].alias(f"pc{i + 1}") for i in range(k)))


def tsne(x: np.ndarray, perplexity: float = 15.0, rounds: int = 500, rate: float = 200.0, seed: int = 1) -> tuple[np.ndarray, list[float]]:
    """Exact t-SNE to two dimensions, and the divergence every 50 rounds."""
    n = len(x)
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    p = np.zeros((n, n))
    for i in range(n):
        low, high, beta = 0.0, math.inf, 1.0
        for _ in range(60):
            w = np.exp(-(d[i] - np.delete(d[i], i).min()) * beta)
            w[i] = 0
            w /= w.sum()
            h = -(w[w > 0] * np.log(w[w > 0])).sum()
            if abs(h - math.log(perplexity)) < 1e-5:
                break
            low, high = (beta, high) if h > math.log(perplexity) else (low, beta)
            beta = beta * 2 if high == math.inf else (low + high) / 2
        p[i] = w
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    rng = np.random.default_rng(seed)
    y, v, losses = rng.normal(0, 1e-4, (n, 2)), np.zeros((n, 2)), []
    for t in range(rounds):
        q = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(axis=2))
        np.fill_diagonal(q, 0)
        share = np.maximum(q / q.sum(), 1e-12)
        pull = (p * (4 if t < 100 else 1) - share) * q
        grad = 4 * (np.diag(pull.sum(axis=1)) - pull) @ y
        v = (0.5 if t < 250 else 0.8) * v - rate * grad
        y = y + v - (y + v).mean(axis=0)
        if t % 50 == 49:
            losses.append(float((p * np.log(p / share)).sum()))
    return y, losses


def tsne_windows(features: DataFrame, most: int = 300, rounds: int = 500) -> DataFrame:
    """``most`` windows, taken by hash, in the plane; the method's own bound, for a picture and not an analysis of all rows."""
    columns = FEATURES[:4]
    rows = features.select("win", *columns).orderBy(F.xxhash64("win"), "win").limit(most).toPandas().sort_values("win")
    x = rows[columns].to_numpy(dtype=float)
    x = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    y, _ = tsne(x, min(15.0, max(2.0, (len(x) - 1) / 3)), rounds)
    return features.sparkSession.createDataFrame(pd.DataFrame({"win": rows["win"].to_numpy(), "x": y[:, 0], "y": y[:, 1]}), "win long, x double, y double")


def boosted_stumps(pairs: DataFrame, columns: list[str], target: str, rounds: int = 50, seed: int = 42) -> DataFrame:
    """Gradient-boosted stumps, learning rate 0.1, a third of the columns a round; (row id, prediction)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = VectorAssembler(inputCols=columns, outputCol="vec").transform(pairs)
    model = GBTRegressor(featuresCol="vec", labelCol=target, maxDepth=1, maxIter=rounds, stepSize=0.1, featureSubsetStrategy="onethird", seed=seed).fit(rows)
    return model.transform(rows).select("frame_id", target, "prediction")


class Network:
    """D inputs, layers of D/2 and D/4 (at least 8 and 4) sigmoids, one linear output; Adam, L2, early stopping."""

    def __init__(self, width: int, seed: int = 42):
        rng, h1 = np.random.default_rng(seed), max(8, width // 2)
        sizes = [width, h1, max(4, h1 // 2), 1]
        self.w = [rng.normal(0, 1 / math.sqrt(a), (a, b)) for a, b in zip(sizes, sizes[1:])]
        self.b = [np.zeros(b) for b in sizes[1:]]

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for i, (w, b) in enumerate(zip(self.w, self.b)):
            z = out[-1] @ w + b
            out.append(z if i == len(self.w) - 1 else 1 / (1 + np.exp(-z)))
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 300, rate: float = 0.01, l2: float = 1e-4, patience: int = 30) -> float:
        held = np.arange(len(x)) % 5 == 0
        m = [[np.zeros_like(a) for a in (*self.w, *self.b)] for _ in "mv"]
        best, since, kept = math.inf, 0, None
        for t in range(1, epochs + 1):
            acts = self.forward(x[~held])
            delta = (acts[-1][:, 0] - y[~held])[:, None] / max(1, (~held).sum())
            grads_w, grads_b = [], []
            for i in reversed(range(len(self.w))):
                grads_w.insert(0, acts[i].T @ delta + l2 * self.w[i])
                grads_b.insert(0, delta.sum(axis=0))
                if i:
                    delta = delta @ self.w[i].T * acts[i] * (1 - acts[i])
            for k, (p, g) in enumerate(zip([*self.w, *self.b], [*grads_w, *grads_b])):
                m[0][k] = 0.9 * m[0][k] + 0.1 * g
                m[1][k] = 0.999 * m[1][k] + 0.001 * g * g
                p -= rate * (m[0][k] / (1 - 0.9**t)) / (np.sqrt(m[1][k] / (1 - 0.999**t)) + 1e-8)
            loss = float(((self.forward(x[held])[-1][:, 0] - y[held]) ** 2).mean()) if held.any() else 0.0
            if loss < best - 1e-9:
                best, since, kept = loss, 0, [a.copy() for a in (*self.w, *self.b)]
            else:
                since += 1
            if since >= patience:
                break
        if kept:
            self.w, self.b = kept[: len(self.w)], kept[len(self.w) :]
        return best


def network_predictions(rows: DataFrame, columns: list[str], target: str, most: int = 5000, epochs: int = 300) -> DataFrame:
    """Every row's prediction by a network trained on at most ``most`` rows, taken by hash."""
    train = rows.select("frame_id", *columns, target).orderBy(F.xxhash64("frame_id"), "frame_id").limit(most).toPandas()
    x, y = train[columns].to_numpy(dtype=float) / 255, train[target].to_numpy(dtype=float)
    scale = (float(y.mean()), float(y.std()) or 1.0)
    net = Network(len(columns))
    net.fit(x, (y - scale[0]) / scale[1], epochs)

    def over(batches):
        for pdf in batches:
            out = net.forward(pdf[columns].to_numpy(dtype=float) / 255)[-1][:, 0] * scale[1] + scale[0]
            yield pd.DataFrame({"frame_id": pdf["frame_id"], "prediction": out})

    return rows.select("frame_id", *columns).mapInPandas(over, "frame_id long, prediction double")


def flag_classifier(byte_features: DataFrame, truth, layers: tuple[int, ...] = (24, 12), seed: int = 42) -> DataFrame:
    """Bytes as flags or not by a multilayer perceptron over their ten features; (can_id, byte_idx, label, prediction)."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import MinMaxScaler, VectorAssembler

    columns = [c for c, t in byte_features.dtypes if c not in ("can_id", "byte_idx")]
    rows = VectorAssembler(inputCols=columns, outputCol="raw").transform(byte_features.withColumn("label", truth.cast("double")))
    rows = MinMaxScaler(inputCol="raw", outputCol="vec").fit(rows).transform(rows)
    model = MultilayerPerceptronClassifier(featuresCol="vec", layers=[len(columns), *layers, 2], seed=seed, maxIter=100).fit(rows)
    return model.transform(rows).select("can_id", "byte_idx", "label", "prediction")


def merged_signals(roles: DataFrame, least: float = 3.0) -> DataFrame:
    """Dictionary signals out of byte roles: neighbouring VALUE bytes of entropy above ``least`` join in pairs, greedily from the left; CONST bytes give none."""
    def over(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("byte_idx").to_dict("records")
        out, i = [], 0
        wide = lambda r: r["role"] == "VALUE" and r["entropy"] > least
        while i < len(rows):
            two = i + 1 < len(rows) and wide(rows[i]) and wide(rows[i + 1]) and rows[i + 1]["byte_idx"] == rows[i]["byte_idx"] + 1
            if rows[i]["role"] != "CONST":
                out.append((rows[i]["can_id"], f"{rows[i]['role']}_{rows[i]['byte_idx']}", int(rows[i]["byte_idx"]) * 8, 16 if two else 8))
            i += 1 + two
        return pd.DataFrame(out, columns=["can_id", "sig_name", "start_bit", "length"])

    return roles.groupBy("can_id").applyInPandas(over, "can_id long, sig_name string, start_bit long, length long")
