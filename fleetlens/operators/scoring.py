"""Scores: residuals, attribution, robust probabilities, fusion, decisions, metrics, graph weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import with_frames
from .ranks import exact_quantiles, with_running_totals


def residual_energy(points: DataFrame, w: int = 10, node: str = "service", feature: str = "feature", ts: str = "ts_ms", value: str = "value", blocks: int | None = None) -> DataFrame:
    """H1 (a). (node, ts, energy): squared distance of each value to the mean of the w - 1 before it, summed over features.

    Only values with w - 1 predecessors count. Frames carry the sums, so no window array is built.
    """

    def frames(by):
        before = by.rowsBetween(-(w - 1), -1)
        return {"_e": F.pow(F.col(value) - F.avg(value).over(before), F.lit(2.0)), "_before": F.count("*").over(before)}

    rows = with_frames(points, [node, feature], [ts], w - 1, frames, blocks)
    return rows.where(F.col("_before") == w - 1).groupBy(node, ts).agg(F.sum("_e").alias("energy"))


def pca_energy(vectors: DataFrame, features: list[str], k: int = 2) -> DataFrame:
    """H1 (b). Add ``energy``: the squared distance of each row to its reconstruction from ``k`` principal components."""
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer

    ready = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(vectors)
    model = PCA(k=k, inputCol="_x", outputCol="_p").fit(ready)
    mean = ready.select(Summarizer.mean(F.col("_x")).alias("m")).first()["m"].toArray()
    axes = model.pc.toArray()  # features x k
    shift = mean @ axes
    projected = vector_to_array(F.col("_p"))
    energy = F.lit(0.0)
    for i, name in enumerate(features):
        back = F.lit(float(mean[i]))
        for j in range(axes.shape[1]):
            back = back + float(axes[i, j]) * (projected[j] - float(shift[j]))
        energy = energy + F.pow(F.col(name) - back, F.lit(2.0))
    return model.transform(ready).withColumn("energy", energy).drop("_x", "_p")


def edge_error_to_nodes(errors: DataFrame, by: tuple[str, ...] = ("status_code",), value: str = "error") -> DataFrame:
    """H2. Half of each directed edge's error to either end."""
    ends = errors.select(F.explode(F.array("src", "dst")).alias("node"), *by, (F.col(value) / 2).alias("_half"))
    return ends.groupBy("node", *by).agg(F.sum("_half").alias(value))


def robust_constants(df: DataFrame, col: str) -> tuple[float | None, float | None]:
    """H3. The lower median and the median of the distances to it, exact; a fit, which runs when it is called."""
    (middle,) = exact_quantiles(df, F.col(col), [0.5])
    (apart,) = exact_quantiles(df, F.abs(F.col(col) - F.lit(middle)), [0.5])
    return middle, apart


def robust_prob(df: DataFrame, col: str, constants: tuple[float | None, float | None] | None = None) -> DataFrame:
    """H3. Add ``prob``: the sigmoid of the distance to the lower median in units of 1.4826 MAD (1e-6 at least).

    ``constants`` (median, MAD), if fitted before, replace those of the rows themselves. Without any value all are null.
    """
    middle, apart = constants or robust_constants(df, col)
    z = (F.col(col) - F.lit(middle)) / (1.4826 * F.greatest(F.lit(apart), F.lit(1e-6)))
    return df.withColumn("prob", 1 / (1 + F.exp(-z)))


def fuse(p: Column, r: Column, alpha: float = 0.7) -> Column:
    """H4. alpha * p + (1 - alpha) * r within [0, 1], alpha clamped too."""
    a = min(max(alpha, 0.0), 1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), a * p + (1 - a) * r))


def decide(score: Column) -> Column:
    """H5. 1 above 0.5; a tie is normal."""
    return (score > 0.5).cast("int")


def prf(df: DataFrame, y: str, yhat: str, by: list[str] | None = None) -> DataFrame:
    """H6. One row (or one for each of ``by``): precision, recall, f1 and the counts of both classes, predicted and actual.

    Without predicted (actual) positives precision (recall) is 0; without either f1 is 1.
    """
    got = df.groupBy(*(by or [])).agg(F.count_if((F.col(y) == 1) & (F.col(yhat) == 1)).alias("tp"), F.count_if(F.col(yhat) == 1).alias("pred_1"), F.count_if(F.col(yhat) == 0).alias("pred_0"), F.count_if(F.col(y) == 1).alias("actual_1"), F.count_if(F.col(y) == 0).alias("actual_0"))
    either = F.col("pred_1") + F.col("actual_1")
    return got.select(
        *(by or []), F.coalesce(F.try_divide("tp", "pred_1"), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide("tp", "actual_1"), F.lit(0.0)).alias("recall"), F.coalesce(F.try_divide(2 * F.col("tp"), either), F.lit(1.0)).alias("f1"),
        "pred_0", "pred_1", "actual_0", "actual_1",
    )


def _by_score(df: DataFrame, y: str, s: str) -> DataFrame:
    """Positives and negatives of each distinct score: what the ranking metrics need, far fewer rows than the input."""
    return df.groupBy(F.col(s).alias("s")).agg(F.sum(F.col(y).cast("long")).alias("p"), F.sum(1 - F.col(y).cast("long")).alias("n"))


def roc_auc(df: DataFrame, y: str, s: str) -> DataFrame:
    """H7. One row: auc, the share of (positive, negative) pairs in the right order, ties half; null if a class is absent."""
    ranked = with_running_totals(_by_score(df, y, s), F.col("s"), ["n"])
    got = ranked.agg(F.sum(F.col("p") * (F.col("n_before") + F.col("n") / 2)).alias("right"), F.sum("p").alias("ps"), F.sum("n").alias("ns"))
    return got.select(F.try_divide(F.col("right"), F.col("ps").cast("double") * F.col("ns")).alias("auc"))


def average_precision(df: DataFrame, y: str, s: str) -> DataFrame:
    """H8. One row: ap, the mean of the average precision of the positives by ``s`` and of the negatives by 1 - ``s``."""
    by = _by_score(df, y, s)

    def one(hits: str, misses: str, order: Column) -> DataFrame:
        got = with_running_totals(by, order, [hits, misses])
        tp, fp = F.col(f"{hits}_before") + F.col(hits), F.col(f"{misses}_before") + F.col(misses)
        total = got.agg(F.sum(F.col(hits) * F.try_divide(tp, tp + fp)).alias("a"), F.sum(hits).alias("b"))
        return total.select(F.coalesce(F.try_divide("a", "b"), F.lit(0.0)).alias("ap"))

    return one("p", "n", -F.col("s")).union(one("n", "p", F.col("s"))).agg(F.avg("ap").alias("ap"))


def energy_report(df: DataFrame, label: str = "y_seen", energy: str = "energy", weight: float = 0.01) -> DataFrame:
    """H9. Energy of normal, inverse energy of abnormal and weighted energy of unknown rows, each over all rows."""
    part = lambda k, v: F.sum(F.when(F.col(label) == k, v).otherwise(0.0)) / F.count("*")
    return df.agg(part(0, F.col(energy)).alias("normal"), part(1, F.try_divide(F.lit(1.0), F.col(energy))).alias("abnormal"), part(2, weight * F.col(energy)).alias("unknown"))


def residual_classifier(train: DataFrame, test: DataFrame, features: list[str], label: str = "y_seen", abnormal_weight: float = 1.0) -> DataFrame:
    """H10. ``test`` with ``p_cls``: the anomaly probability of a logistic regression on residuals.

    Rows labelled 2 (unknown) teach nothing; abnormal rows weigh ``abnormal_weight``.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    ready = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip")
    known = train.where(F.col(label).isin(0, 1)).withColumn("_w", F.when(F.col(label) == 1, abnormal_weight).otherwise(1.0)).withColumn("_y", F.col(label).cast("double"))
    model = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", probabilityCol="_p").fit(ready.transform(known))
    return model.transform(ready.transform(test)).withColumn("p_cls", vector_to_array("_p")[1]).drop("_x", "_p", "rawPrediction", "prediction")


def edge_weights(summaries: DataFrame, graph: DataFrame, lam: float = 0.5, temperature: float = 0.5) -> DataFrame:
    """H11. (src, dst, dynamic, weight) of the graph's edges: sigmoid of the scaled product of both ends' summaries
    (node, vector), blended with the static 1. Self loops have no dynamic part."""
    a, b = (summaries.select(F.col("node").alias(end), F.col("vector").alias(f"_{end}")) for end in ("src", "dst"))
    joined = graph.select("src", "dst").distinct().join(a, "src").join(b, "dst")
    dot = F.aggregate(F.zip_with("_src", "_dst", lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)
    sim = dot / F.sqrt(F.size("_src"))
    dynamic = F.when(F.col("src") == F.col("dst"), 0.0).otherwise(1 / (1 + F.exp(-sim / temperature)))
    return joined.select("src", "dst", dynamic.alias("dynamic")).withColumn("weight", lam * F.col("dynamic") + (1 - lam))


def graph_drift(weights: DataFrame, n: int) -> DataFrame:
    """H12. One row: drift, the mean dynamic weight over n * n pairs + 0.1 * the divergence of static from dynamic, clamped to [1e-6, 1 - 1e-6].

    Pairs without an edge contribute nothing to either: both their weights are 0 and clamp to the same value.
    The divergence is averaged over all n * n entries.
    """
    clamp = lambda c: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), c))
    p, q = clamp(F.lit(1.0)), clamp(F.col("dynamic"))
    return weights.agg((F.coalesce(F.sum("dynamic"), F.lit(0.0)) / (n * n) + 0.1 * F.coalesce(F.sum(p * (F.log(p) - F.log(q))), F.lit(0.0)) / (n * n)).alias("drift"))


def weight_edges(edges: DataFrame, weights: DataFrame, values: list[str]) -> DataFrame:
    """H13. Edge features times the blended weight of their edge."""
    return edges.join(weights.select("src", "dst", "weight"), ["src", "dst"]).withColumns({v: F.col(v) * F.col("weight") for v in values}).drop("weight")
