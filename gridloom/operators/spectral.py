"""Signatures, spectral distances, classifiers, normalization, principal components and clustering.

Signature tables are small (one row a class), so they are read by the driver, with a checked bound, and become literals of a
projection: assigning pixels to classes costs no join and no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import collected, cut


def signatures(df: DataFrame, label: str, bands: Sequence[str]) -> DataFrame:
    """Mean, population standard deviation and count of each class (or region of interest), band by band."""
    stats = [f(b).alias(f"{n}_{b}") for b in bands for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("pixels"), *stats)


def merge_signatures(df: DataFrame) -> DataFrame:
    """One signature of several (wavelength, value, standard_deviation): mean values, root of mean variances."""
    return df.groupBy("wavelength").agg(F.avg("value").alias("value"), F.sqrt(F.avg(F.col("standard_deviation") * F.col("standard_deviation"))).alias("standard_deviation"))


def euclidean(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def angle(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Spectral angle in degrees; null for a zero spectrum."""
    dot, aa, bb = (sum((x * y for x, y in zip(p, q, strict=True)), F.lit(0.0)) for p, q in ((a, b), (a, a), (b, b)))
    cos = F.try_divide(dot, F.sqrt(aa * bb))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))


def bray_curtis(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Similarity 100 - 100 sum |a - b| / sum (a + b)."""
    up = sum((F.abs(x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0))
    return 100 - 100 * F.try_divide(up, sum((x + y for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def spectral_distance(df: DataFrame, a: Sequence[str], b: Sequence[str], algorithm: str = "md", threshold: float | None = None) -> DataFrame:
    """r, c and distance between two sets of bands; with a threshold 1 where it is above, else 0."""
    d = (euclidean if algorithm == "md" else angle)([F.col(x) for x in a], [F.col(x) for x in b])
    return df.select("r", "c", (d if threshold is None else (d > threshold).cast("int")).alias("distance"))


def signature_pairs(sig: DataFrame, label: str, bands: Sequence[str]) -> DataFrame:
    """Euclidean distance, angle and similarity of each two signatures of a small table."""
    rows = collected(sig.select(label, *(F.col(b).cast("double") for b in bands)))
    spark = sig.sparkSession
    pairs = [(x[0], y[0], [float(v) for v in x[1:]], [float(v) for v in y[1:]]) for x in rows for y in rows if x[0] < y[0]]
    kind = dict(sig.dtypes)[label]
    df = spark.createDataFrame(pairs, f"a {kind}, b {kind}, x array<double>, y array<double>")
    x, y = ([F.element_at(s, i + 1) for i in range(len(bands))] for s in "xy")
    return df.select("a", "b", euclidean(x, y).alias("euclidean"), angle(x, y).alias("angle"), bray_curtis(x, y).alias("bray_curtis"))


def _best(scores: list[tuple[object, Column]]) -> tuple[Column, Column]:
    """Class and value of the least score; ties go to the class that stands first."""
    a = F.array_min(F.array(*(F.when(s.isNotNull(), F.struct(s.alias("d"), F.lit(i).alias("o"), F.lit(k).alias("k"))) for i, (k, s) in enumerate(scores))))
    return a["k"], a["d"]


def classify(df: DataFrame, sig: DataFrame, label: str, bands: Sequence[str], algorithm: str = "md", threshold: float | None = None, thresholds: str | None = None, keep: Sequence[str] = ("r", "c")) -> DataFrame:
    """keep, class, distance: minimum distance (md) or spectral angle (sam) to the signatures (label and bands' means).

    Farther than the threshold (or the signature's own, a column of sig): class null, that is, unclassified.
    """
    rows = collected(sig.select(label, *bands, *([thresholds] if thresholds else [])).orderBy(label))
    pixel = [F.col(b).cast("double") for b in bands]
    measure = euclidean if algorithm == "md" else angle
    scores = []
    for r in rows:
        d = measure(pixel, [F.lit(float(r[b])) for b in bands])
        limit = r[thresholds] if thresholds else threshold
        scores.append((r[label], d if limit is None else F.when(d <= limit, d)))
    k, d = _best(scores)
    return df.select(*keep, k.alias("class"), d.alias("distance"))


def class_covariances(df: DataFrame, label: str, bands: Sequence[str]) -> DataFrame:
    """Sample covariances of each class, as cov_<i>_<j> over band numbers from 1, i <= j."""
    n = range(len(bands))
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(*(F.covar_samp(bands[i], bands[j]).alias(f"cov_{i + 1}_{j + 1}") for i in n for j in n if i <= j))


def chi_square_limit(percent: float, bands: int) -> float:
    """What a chi-square value of `bands` degrees of freedom is beyond in `percent` of all cases."""

    def above(x: float) -> float:
        """1 - P(bands / 2, x / 2), by the series of the incomplete gamma function."""
        a, y = bands / 2, x / 2
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= y / k
            total += term
        return 1 - total * math.exp(a * math.log(y) - y - math.lgamma(a))

    low, high = 1e-12, 1.0
    while above(high) > percent / 100:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if above(middle) > percent / 100 else (low, middle)
    return (low + high) / 2


def classify_likelihood(df: DataFrame, train: DataFrame, label: str, bands: Sequence[str], least: float | None = None, keep: Sequence[str] = ("r", "c"), percent: float | None = None) -> DataFrame:
    """keep, class, likelihood -ln|S| - d' S^-1 d of the likeliest class; classes without an invertible covariance are left out.

    least: classes less likely than that don't count. percent: classes from which a pixel is as far (d' S^-1 d) as only so
    many of their own would be don't count. No class: null, that is, unclassified.
    """
    limit = None if percent is None else chi_square_limit(percent, len(bands))
    means = {r[label]: np.array([r[f"mean_{b}"] for b in bands], float) for r in collected(signatures(train, label, bands))}
    scores = []
    for r in sorted(collected(class_covariances(train, label, bands)), key=lambda r: r[label]):
        n = len(bands)
        s = np.array([[r[f"cov_{min(i, j) + 1}_{max(i, j) + 1}"] for j in range(n)] for i in range(n)], float)
        sign, logdet = np.linalg.slogdet(s) if np.isfinite(s).all() else (0, 0)
        if sign <= 0:
            continue
        inv = np.linalg.inv(s)
        d = [F.col(b).cast("double") - float(m) for b, m in zip(bands, means[r[label]], strict=True)]
        q = sum((d[i] * d[j] * float(inv[i, j]) for i in range(n) for j in range(n)), F.lit(0.0))
        like = -q - float(logdet)
        near = F.lit(True) if limit is None else q <= limit
        scores.append((r[label], F.when(near & (F.lit(True) if least is None else like >= least), -like)))
    k, d = _best(scores)
    return df.select(*keep, k.alias("class"), (-d).alias("likelihood"))


def normalize(df: DataFrame, bands: Sequence[str], method: str = "zscore") -> DataFrame:
    """z-score (x - mean) / (std + 1e-6), std of the population, or linear (x - min) / (max - min), by band."""
    row = df.agg(*(f(b).alias(f"{n}_{b}") for b in bands for n, f in (("a", F.avg), ("s", F.stddev_pop), ("lo", F.min), ("hi", F.max)))).first()
    if method == "zscore":
        return df.withColumns({b: (F.col(b) - F.lit(row[f"a_{b}"])) / (F.lit(row[f"s_{b}"]) + 1e-6) for b in bands})
    return df.withColumns({b: F.try_divide(F.col(b) - F.lit(row[f"lo_{b}"]), F.lit(row[f"hi_{b}"]) - F.lit(row[f"lo_{b}"])) for b in bands})


def covariance(df: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Sample covariance and correlation of each two bands (i <= j), in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(bands) for b in bands[i:]]
    row = df.agg(*(f(a, b).alias(f"{n}{k}") for k, (a, b) in enumerate(pairs) for n, f in (("v", F.covar_samp), ("r", F.corr))))
    each = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"v{k}").alias("covariance"), F.col(f"r{k}").alias("correlation")) for k, (a, b) in enumerate(pairs)))
    return row.select(F.explode(each).alias("x")).select("x.*")


def principal_components(df: DataFrame, bands: Sequence[str], number: int, keep: Sequence[str] = ("r", "c"), normalized: bool = False) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Scores pc1.. of each pixel, the eigenvalues and vectors of the covariance (or correlation), largest first.

    A vector's sign is such that its largest loading is positive.
    """
    rows = collected(covariance(df, bands))
    means = df.agg(*(F.avg(b) for b in bands), *(F.stddev_samp(b) for b in bands)).first()
    n = len(bands)
    s = np.zeros((n, n))
    for r in rows:
        i, j = bands.index(r.a), bands.index(r.b)
        s[i, j] = s[j, i] = r.correlation if normalized else r.covariance
    values, vectors = np.linalg.eigh(s)
    order = np.argsort(-values)
    values, vectors = values[order], vectors[:, order]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(n)])
    x = [(F.col(b) - F.lit(means[i])) / (F.lit(means[n + i]) if normalized else F.lit(1.0)) for i, b in enumerate(bands)]
    scores = [sum((x[i] * float(vectors[i, k]) for i in range(n)), F.lit(0.0)).alias(f"pc{k + 1}") for k in range(number)]
    return df.select(*keep, *scores), values, vectors


def range_seeds(df: DataFrame, bands: Sequence[str], classes: int) -> np.ndarray:
    """Seeds evenly over each band's range: min + (i + 1/2) (max - min) / classes."""
    row = df.agg(*(f(b) for b in bands for f in (F.min, F.max))).first()
    low, high = np.array(row[::2], float), np.array(row[1::2], float)
    return np.stack([low + (i + 0.5) * (high - low) / classes for i in range(classes)])


def random_seeds(df: DataFrame, bands: Sequence[str], classes: int, seed: int = 0, keys: Sequence[str] = ("r", "c")) -> np.ndarray:
    """The bands of the pixels of least hashes of their keys: random, yet the same however the pixels are dealt out."""
    rows = df.dropna(subset=list(bands)).orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(classes).select(*bands).collect()
    return np.array([tuple(map(float, r)) for r in rows]).reshape(-1, len(bands))


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the nearest center and the squared distance."""
    d = ((x[:, None, :] - centers[None]) ** 2).sum(-1)
    return d.argmin(1), d.min(1)


def parallel_seeds(df: DataFrame, bands: Sequence[str], classes: int, seed: int = 0, rounds: int = 5, keys: Sequence[str] = ("r", "c")) -> np.ndarray:
    """Seeds by oversampling (Bahmani and others 2012): in each round a pixel is drawn with a chance of 2 classes times its
    share of the sum of squared distances to the seeds so far; the few drawn, weighed by the pixels nearest to each, are
    reduced to `classes` by weighted sampling. Draws come from hashes of the keys, so the seeds don't depend on partitions.
    """
    own = df.dropna(subset=list(bands)).select(*keys, *(F.col(b).cast("double").alias(f"_b{i}") for i, b in enumerate(bands)))
    names, kinds = [f"_b{i}" for i in range(len(bands))], dict(own.dtypes)
    centers = random_seeds(own, names, 1, seed, keys)
    if not len(centers):
        return np.zeros((0, len(bands)))

    def distances(centers):
        def run(batches):
            for batch in batches:
                x = np.stack([batch.column(n).to_numpy() for n in names], 1)
                for at in range(0, len(x), 4096):
                    near, d = _nearest(x[at : at + 4096], centers)
                    part = batch.slice(at, 4096)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near.astype(np.int32)), pa.array(d)], names=[*part.schema.names, "near", "d"])

        return own.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in kinds.items()) + ", near int, d double")

    for k in range(rounds):
        far = distances(centers)
        total = float(f"{far.agg(F.sum('d')).first()[0]:.9e}")  # so that the order of summing doesn't show
        if total == 0:
            break
        chance = F.pmod(F.xxhash64(F.lit(seed + k + 1), *keys), F.lit(1 << 53)) / float(1 << 53)
        drawn = collected(far.where(chance < 2 * classes * F.col("d") / total).select(*names, *keys).orderBy(*keys), max(10_000, 10 * classes))
        centers = np.concatenate([centers, np.array([r[: len(bands)] for r in drawn], float).reshape(-1, len(bands))])
    weight = np.zeros(len(centers))
    for r in collected(distances(centers).groupBy("near").agg(F.count("*").alias("n")), max(10_000, 60 * classes)):
        weight[r.near] = r.n
    rng = np.random.default_rng(seed)
    out = [int(rng.choice(len(centers), p=weight / weight.sum()))]
    while len(out) < min(classes, len(np.unique(centers, axis=0))):
        chance = weight * _nearest(centers, centers[out])[1]
        out.append(int(rng.choice(len(centers), p=chance / chance.sum())))
    return centers[out]


def _seed_table(df: DataFrame, centers: np.ndarray, bands: Sequence[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(i + 1, *map(float, c)) for i, c in enumerate(centers)], "cluster int, " + ", ".join(f"{b} double" for b in bands))


def assign_clusters(df: DataFrame, centers: np.ndarray, bands: Sequence[str], algorithm: str = "md", keep: Sequence[str] = ("r", "c")) -> DataFrame:
    return classify(df, _seed_table(df, centers, bands), "cluster", bands, algorithm, keep=keep).withColumnRenamed("class", "cluster")


def update_clusters(df: DataFrame, centers: np.ndarray, bands: Sequence[str], algorithm: str = "md") -> DataFrame:
    """Pixels and means of each cluster after one assignment."""
    own = assign_clusters(df, centers, bands, algorithm, keep=list(bands))
    return own.groupBy("cluster").agg(F.count("*").alias("pixels"), *(F.avg(b).alias(b) for b in bands))


def cluster(df: DataFrame, bands: Sequence[str], classes: int, algorithm: str = "md", threshold: float = 1e-4, max_iter: int = 10, seeds: np.ndarray | str | None = None) -> tuple[DataFrame, np.ndarray]:
    """Lloyd's iterations until no center moves by more than the threshold: r, c, cluster, and the centers.

    seeds: an array, "random", "parallel" (see parallel_seeds), or None: evenly over the bands' ranges.
    Each iteration is one aggregation over the pixels; only the centers come to the driver, and empty clusters keep theirs.
    """
    chosen = {"random": random_seeds, "parallel": parallel_seeds, "range": range_seeds}
    centers = chosen[seeds or "range"](df, bands, classes) if seeds is None or isinstance(seeds, str) else np.array(seeds, float)
    for _ in range(max_iter):
        new = centers.copy()
        for r in collected(update_clusters(df, centers, bands, algorithm)):
            new[r.cluster - 1] = [r[b] for b in bands]
        moved = np.sqrt(((new - centers) ** 2).sum(1)).max()
        centers = new
        if moved <= threshold:
            break
    return assign_clusters(df, centers, bands, algorithm), centers


# ---- learned classifiers

#: Machines of one against the rest that are fitted at once, over one cached table: waits between their steps overlap.
MACHINES = 4


def learner(kind: str, bands: Sequence[str], label: str, **parameters):
    """A Spark ML pipeline: random_forest, random_forest_ovr, svm (linear, one against the rest) or mlp."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LinearSVC, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    steps = [VectorAssembler(inputCols=list(bands), outputCol="_x", handleInvalid="skip"), StandardScaler(inputCol="_x", outputCol="_f", withMean=True)]
    common = {"featuresCol": "_f", "labelCol": label}
    if kind == "random_forest":
        own = RandomForestClassifier(numTrees=parameters.get("trees", 100), seed=0, **common)
    elif kind == "random_forest_ovr":
        own = OneVsRest(classifier=RandomForestClassifier(numTrees=parameters.get("trees", 100), seed=0, **common), **common)
    elif kind == "svm":
        own = OneVsRest(classifier=LinearSVC(regParam=parameters.get("regularization", 0.01), **common), parallelism=MACHINES, **common)
    elif kind == "mlp":
        own = MultilayerPerceptronClassifier(layers=[len(bands), *parameters.get("hidden", [100]), parameters["classes"]], seed=0, maxIter=parameters.get("max_iter", 100), **common)
    else:
        raise ValueError(f"unknown classifier {kind}")
    return Pipeline(stages=[*steps, own])


def predict(model, df: DataFrame, keep: Sequence[str] = ("r", "c")) -> DataFrame:
    """keep, class, and, where the classifier gives probabilities, confidence: the largest of them."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(df)
    sure = F.array_max(vector_to_array("probability")) if "probability" in out.columns else F.lit(None).cast("double")
    return out.select(*keep, F.col("prediction").cast("int").alias("class"), sure.alias("confidence"))


def cross_validate(pipeline, grid: list[dict], df: DataFrame, label: str, folds: int = 5):
    """The best parameters over stratified folds: rows of each class are dealt by hash."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator

    dealt = df.withColumn("_fold", F.pmod(F.xxhash64(*df.columns), F.lit(folds)).cast("int"))
    judge = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    return CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=judge, numFolds=folds, foldCol="_fold").fit(dealt)


def save_model(model, path: str) -> None:
    """A fitted pipeline, to a folder."""
    model.write().overwrite().save(path)


def load_model(path: str):
    """A pipeline that save_model saved."""
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def predict_with(df: DataFrame, bands: Sequence[str], model, keep: Sequence[str] = ("r", "c"), kind: str = "double") -> DataFrame:
    """keep and class by a model of one's own: model(array of pixels by bands) -> array of classes, a batch at a time."""
    import pyarrow as pa

    names = [f"_x{i}" for i in range(len(bands))]

    def run(batches):
        for batch in batches:
            x = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(model(x))], names=[*keep, "class"])

    kinds = dict(df.dtypes)
    return df.select(*keep, *(F.col(b).cast("double").alias(n) for b, n in zip(bands, names, strict=True))).mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keep) + f", class {kind}")


# ---- a machine with a radial kernel


@dataclass
class RadialMachine:
    """A support vector machine with a radial (RBF) kernel, by random Fourier features before linear machines."""

    bands: list[str]
    mean: np.ndarray
    scale: np.ndarray
    ways: np.ndarray  # bands by features
    phase: np.ndarray
    model: object  # Spark ML's one-against-the-rest model

    def features(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """keep and _f: sqrt(2 / n) cos(x W + b) of each pixel's standardized bands, whose products are the kernel's values."""
        from pyspark.ml.functions import array_to_vector

        kinds, names = dict(df.dtypes), [f"_x{i}" for i in range(len(self.bands))]
        mean, scale, ways, phase, many = self.mean, self.scale, self.ways, self.phase, math.sqrt(2 / len(self.phase))

        def run(batches):
            for batch in batches:
                x = np.stack([batch.column(n).to_numpy() for n in names], 1)
                z = many * np.cos((x - mean) / scale @ ways + phase)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), rows], names=[*keep, "_z"])

        own = df.dropna(subset=self.bands).select(*keep, *(F.col(b).cast("double").alias(n) for b, n in zip(self.bands, names, strict=True)))
        return own.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", _z array<double>").select(*keep, array_to_vector("_z").alias("_f"))

    def predict(self, df: DataFrame, keep: Sequence[str] = ("r", "c")) -> DataFrame:
        """keep, class, and confidence: the largest of the classes' decision values."""
        from pyspark.ml.functions import vector_to_array

        out = self.model.transform(self.features(df, keep))
        return out.select(*keep, F.col("prediction").cast("int").alias("class"), F.array_max(vector_to_array("rawPrediction")).alias("confidence"))

    def save(self, spark: SparkSession, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        rest = [(self.bands, self.mean.tolist(), self.scale.tolist(), self.ways.ravel().tolist(), self.phase.tolist())]
        spark.createDataFrame(rest, "bands array<string>, mean array<double>, scale array<double>, ways array<double>, phase array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/features")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RadialMachine:
        from pyspark.ml.classification import OneVsRestModel

        r = spark.read.parquet(f"{path}/features").first()
        return cls(list(r.bands), np.array(r.mean), np.array(r.scale), np.array(r.ways).reshape(len(r.bands), -1), np.array(r.phase), OneVsRestModel.load(f"{path}/model"))


def radial_machine(df: DataFrame, bands: Sequence[str], label: str, gamma: float | None = None, features: int = 200, regularization: float = 0.001, seed: int = 0) -> RadialMachine:
    """A RadialMachine of the kernel exp(-gamma d^2) over standardized bands; gamma: 1 / bands if not given. label: 0, 1, .."""
    from pyspark.ml.classification import LinearSVC, OneVsRest

    row = df.agg(*(F.avg(b) for b in bands), *(F.stddev_pop(b) for b in bands)).first()
    mean, scale = np.array(row[: len(bands)], float), np.array(row[len(bands) :], float)
    rng, gamma = np.random.default_rng(seed), gamma or 1 / len(bands)
    ways, phase = rng.normal(size=(len(bands), features)) * math.sqrt(2 * gamma), rng.uniform(0, 2 * np.pi, features)
    out = RadialMachine(list(bands), mean, np.where(scale > 0, scale, 1.0), ways, phase, None)
    rows = cut(out.features(df.where(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("double")), [label]), "features")
    out.model = OneVsRest(classifier=LinearSVC(regParam=regularization, featuresCol="_f", labelCol=label, standardization=False), featuresCol="_f", labelCol=label, parallelism=MACHINES).fit(rows)
    return out


# ---- a network trained by mini-batches


def cross_entropy(scores: np.ndarray, wanted: np.ndarray) -> tuple[float, np.ndarray]:
    """Sum of -ln p of the wanted classes, p by softmax, and its slope by score."""
    p = np.exp(scores - scores.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    rows = np.arange(len(wanted))
    loss = -np.log(np.maximum(p[rows, wanted], 1e-300)).sum()
    p[rows, wanted] -= 1
    return float(loss), p


@dataclass
class Network:
    """Dense layers with rectifiers between them, over standardized bands."""

    bands: list[str]
    mean: np.ndarray
    scale: np.ndarray
    layers: list[tuple[np.ndarray, np.ndarray]]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _forward((x - self.mean) / self.scale, self.layers)[-1]

    def predict(self, df: DataFrame, keep: Sequence[str] = ("r", "c")) -> DataFrame:
        """keep and class; pixels with NoData are left out."""
        return predict_with(df.dropna(subset=self.bands), self.bands, lambda x: self.scores(x).argmax(1).astype(np.int32), keep, "int")


def _forward(x: np.ndarray, layers) -> list[np.ndarray]:
    """Every layer's output, the input first."""
    out = [x]
    for k, (w, b) in enumerate(layers):
        z = out[-1] @ w + b
        out.append(np.maximum(z, 0) if k < len(layers) - 1 else z)
    return out


def train_network(df: DataFrame, bands: Sequence[str], label: str, classes: int, hidden: Sequence[int] = (100,), steps: int = 100, batches: int = 1, rate: float = 0.01, loss: Callable = cross_entropy, seed: int = 0, keys: Sequence[str] = ("r", "c")) -> Network:
    """A Network by Adam over mini-batches: pixels are dealt into `batches` by a hash of their keys, and each step sums the
    loss's slopes over one of them, wherever its pixels lie; only the layers and their slopes move.

    label: 0 to classes - 1. loss(scores, wanted) gives the sum of a batch's losses and their slopes by score.
    """
    row = df.agg(*(F.avg(b) for b in bands), *(F.stddev_pop(b) for b in bands)).first()
    mean, scale = np.array(row[: len(bands)], float), np.array(row[len(bands) :], float)
    scale = np.where(scale > 0, scale, 1.0)
    dealt = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(batches)).cast("int").alias("batch")
    rows = cut(df.dropna(subset=[*bands, label]).select(dealt, F.col(label).cast("int").alias("wanted"), *(F.col(b).cast("double").alias(f"x{i}") for i, b in enumerate(bands))), "training")
    rng, sizes = np.random.default_rng(seed), [len(bands), *hidden, classes]
    layers = [(rng.normal(size=(a, b)) * math.sqrt(2 / a), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)]
    flat = lambda parts: np.concatenate([x.ravel() for pair in parts for x in pair])

    def shaped(v: np.ndarray):
        out, at = [], 0
        for a, b in zip(sizes, sizes[1:], strict=False):
            out.append((v[at : at + a * b].reshape(a, b), v[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    theta = flat(layers)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        own = shaped(theta)

        def slopes(batches, own=own):
            total, n = np.zeros(len(theta)), 0
            for batch in batches:
                x = (np.stack([batch.column(f"x{i}").to_numpy() for i in range(len(bands))], 1) - mean) / scale
                out = _forward(x, own)
                _, g = loss(out[-1], batch.column("wanted").to_numpy())
                parts = []
                for k in range(len(own) - 1, -1, -1):
                    parts.append((out[k].T @ g, g.sum(0)))
                    g = (g @ own[k][0].T) * (out[k] > 0) if k else g
                total += flat(parts[::-1])
                n += len(x)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["slopes", "n"])

        def summed(batches):
            total, n = np.zeros(len(theta)), 0
            for batch in batches:
                for x, k in zip(batch.column("slopes"), batch.column("n"), strict=True):
                    total, n = total + np.frombuffer(x.as_py()), n + k.as_py()
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["slopes", "n"])

        parts = rows.where(F.col("batch") == (step - 1) % batches).mapInArrow(slopes, "slopes binary, n long")
        got = parts.repartition(16).mapInArrow(summed, "slopes binary, n long").collect() if rows.rdd.getNumPartitions() > 64 else parts.collect()  # a row a task
        g, n = sum(np.frombuffer(r.slopes) for r in got), sum(r.n for r in got)
        g = g / max(n, 1)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        theta = theta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Network(list(bands), mean, scale, shaped(theta))
