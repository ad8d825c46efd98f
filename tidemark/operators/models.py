"""Models: LSTM autoencoder scoring, principal components, predictions written back, inflation of variance. Boosted
trees are in `boosting`, hidden Markov models in `hmm`, regressions on lagged values in `lagged`.

Scoring runs distributed over Arrow batches with broadcast weights. Training of the autoencoder needs a deep
learning library and is not part of this library; `substitute_scores` is a stand-in and named so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- LSTM autoencoder


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def lstm_layer(x: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """Windows x (n, steps, inputs) through one layer; gates in the order input, forget, cell, output."""
    n, steps, _ = x.shape
    u = w["hidden"].shape[1]
    h, c, out = np.zeros((n, u)), np.zeros((n, u)), np.empty((n, steps, u))
    for t in range(steps):
        i, f, g, o = np.split(x[:, t] @ w["input"].T + h @ w["hidden"].T + w["bias"], 4, axis=1)
        c = _sigmoid(f) * c + _sigmoid(i) * np.tanh(g)
        h = _sigmoid(o) * np.tanh(c)
        out[:, t] = h
    return out


def reconstruct(x: np.ndarray, weights: dict) -> np.ndarray:
    """Encode, repeat the last state for each step, decode, project to the inputs."""
    coded = x
    for layer in weights["encoder"]:
        coded = lstm_layer(coded, layer)
    decoded = np.repeat(coded[:, -1:, :], x.shape[1], axis=1)
    for layer in weights["decoder"]:
        decoded = lstm_layer(decoded, layer)
    return decoded @ weights["out"].T + weights["out_bias"]


def random_weights(inputs: int, units: tuple[int, ...] = (64, 32), seed: int = 0) -> dict:
    """Weights of the architecture's shapes, untrained: for tests and for running the pipeline's form."""
    rng = np.random.default_rng(seed)

    def layer(a: int, u: int) -> dict[str, np.ndarray]:
        return {"input": rng.normal(0, 0.1, (4 * u, a)), "hidden": rng.normal(0, 0.1, (4 * u, u)), "bias": np.zeros(4 * u)}

    encoder = [layer(a, u) for a, u in zip((inputs, *units), units, strict=False)]
    back = units[::-1]
    decoder = [layer(a, u) for a, u in zip((back[0], *back), back, strict=False)]
    return {"encoder": encoder, "decoder": decoder, "out": rng.normal(0, 0.1, (inputs, back[-1])), "out_bias": np.zeros(inputs)}


def score_windows(windows: DataFrame, columns: list[str], weights: dict, keys: list[str]) -> DataFrame:
    """(keys, window of structs) -> keys, score (mean squared error), last_residual and feature_mse by column."""
    flat = windows.select(*keys, F.flatten(F.transform("window", lambda r: F.array(*[r[c].cast("double") for c in columns]))).alias("__x"))
    shared, k = windows.sparkSession.sparkContext.broadcast(weights), len(columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flat.schema if f.name != "__x") + ", score double, last_residual array<double>, feature_mse array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b["__x"].to_numpy()).reshape(len(b), -1, k)
                gap = x - reconstruct(x, shared.value)
                yield b[keys].assign(score=(gap**2).mean((1, 2)), last_residual=list(gap[:, -1]), feature_mse=list((gap**2).mean(1)))

    return flat.mapInPandas(run, schema)


def substitute_scores(df: DataFrame, columns: list[str], keys: list[str], k: int = 2) -> DataFrame:
    """Stand-in for a trained autoencoder: squared error of reconstruction from k principal components. Not equivalent."""
    vectors = VectorAssembler(inputCols=columns, outputCol="__v").transform(df)
    model = PCA(k=k, inputCol="__v", outputCol="__p").fit(vectors)
    axes = model.pc.toArray()
    means = vectors.agg(*[F.avg(c).alias(c) for c in columns]).first()
    centred = [F.col(c) - float(means[c]) for c in columns]
    parts = [sum((x * float(axes[i, j]) for i, x in enumerate(centred)), F.lit(0.0)) for j in range(axes.shape[1])]
    back = [sum((p * float(axes[i, j]) for j, p in enumerate(parts)), F.lit(0.0)) for i in range(len(columns))]
    error = sum(((x - y) * (x - y) for x, y in zip(centred, back, strict=True)), F.lit(0.0))
    return df.select(*keys, (error / len(columns)).alias("score"))


def pca(df: DataFrame, vector: str, k: int, keys: list[str]) -> DataFrame:
    """keys, component 1..k of centred vectors; each axis points to the side of its largest loading."""
    held = df.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    axes = PCA(k=k, inputCol="__v", outputCol="__p").fit(held).pc.toArray()
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), range(k)])
    means = held.agg(*[F.avg(F.get(F.col(vector), i)).alias(f"m{i}") for i in range(axes.shape[0])]).first()
    shift = [float(np.dot(np.array(means, float), axes[:, j])) for j in range(k)]
    dot = lambda j: F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), F.array(*[F.lit(float(v)) for v in axes[:, j]]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return df.select(*keys, *[(dot(j) - shift[j]).alias(f"component_{j + 1}") for j in range(k)])


def write_back(signals: DataFrame, made: DataFrame, key: str) -> DataFrame:
    """signals with direction_prob, predicted_direction and direction_confidence where there is a prediction."""
    up = F.col("probability")
    own = made.select(F.col(key).alias("__k"), up.alias("direction_prob"), F.when(F.col("prediction") == 1, "Up").otherwise("Down").alias("predicted_direction"), F.greatest(up, 1 - up).alias("direction_confidence"))
    return signals.join(own, F.col(key) == F.col("__k"), "left").drop("__k")


def confidence(predicted: DataFrame, label: str, levels: tuple[float, ...] = (0.5, 0.55, 0.6, 0.65, 0.7)) -> DataFrame:
    """level, n, accuracy of predictions at least that confident."""
    top = F.greatest("probability", 1 - F.col("probability"))
    spread = predicted.select(top.alias("c"), (F.col("prediction") == F.col(label)).cast("double").alias("ok")).withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    return spread.filter("c >= level").groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.avg("ok").alias("accuracy"))


# ---- regressions


def vif(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, vif: diagonal of the inverse correlation matrix, from one row of moments."""
    rows = df.na.drop(subset=columns)
    m = rows.agg(*[F.corr(a, b).alias(f"c{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j])

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, r in b.iterrows():
                c = np.eye(len(columns))
                for i in range(len(columns)):
                    for j in range(i + 1, len(columns)):
                        c[i, j] = c[j, i] = r[f"c{i}_{j}"]
                yield pd.DataFrame({"name": columns, "vif": np.diag(np.linalg.pinv(c))})

    return m.mapInPandas(one, "name string, vif double")


