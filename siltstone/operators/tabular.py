"""Tabular features and classifiers: statistics from training rows, applied to any rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.values import shuffled_place
from siltstone.operators.donors import fit_donors, impute
from siltstone.session import written

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def split_rows(df: DataFrame, key: str, train_share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by a hash of the key: stable under any partitioning."""
    below = shuffled_place(F.col(key), 8, seed) % 10_000 < int(train_share * 10_000 + 0.5)
    return df.where(below), df.where(~below)


def imputations(train: DataFrame) -> dict[str, object]:
    """What to fill: the mean of double columns, the mode of others (the smallest of equal ones)."""
    out: dict[str, object] = {}
    doubles = [c for c, t in train.dtypes if t == "double"]
    if doubles:
        out |= train.agg(*[F.avg(c).alias(c) for c in doubles]).first().asDict()
    others = [c for c, t in train.dtypes if t != "double"]
    if others:
        # one pass: a row per column and value, counted, and the best of each column
        values = F.array(*[F.struct(F.lit(c).alias("column"), F.to_json(F.struct(F.col(f"`{c}`").alias("v"))).alias("json"), F.col(f"`{c}`").isNotNull().alias("held")) for c in others])
        counts = train.select(F.inline(values)).where("held").groupBy("column", "json").count()
        most = counts.groupBy("column").agg(F.max("count").alias("count"))
        # values of equal counts are few; the smallest is found by the column's own order
        top = counts.join(most, ["column", "count"])
        best = top.groupBy("column").agg(*[F.min(F.from_json("json", f"v {train.schema[c].dataType.simpleString()}")["v"]).alias(f"v{i}") for i, c in enumerate(others)])
        out |= {r["column"]: r[f"v{others.index(r['column'])}"] for r in best.collect()}
    return {k: v for k, v in out.items() if v is not None}


@dataclass
class Encoding:
    """Levels of each string column in sorted order; those with few become indicator columns."""

    levels: dict[str, list[str]]
    wide: int = 5
    drop_first: bool = False
    columns: list[str] = field(default_factory=list)

    def apply(self, df: DataFrame) -> DataFrame:
        """Encoded rows in the training order of columns; levels not seen in training are -1 or all zero."""
        out = []
        for c, t in df.dtypes:
            if c not in self.levels:
                if t in NUMERIC or t == "boolean":
                    out.append(F.col(c).cast("int").alias(c) if t == "boolean" else F.col(c))
            elif len(self.levels[c]) <= self.wide:
                out += [F.coalesce((F.col(c) == v).cast("int"), F.lit(0)).alias(f"{c}_{v}") for v in self.levels[c][int(self.drop_first) :]]
            else:
                codes = F.create_map(*[x for i, v in enumerate(self.levels[c]) for x in (F.lit(v), F.lit(i))])
                out.append(F.coalesce(F.try_element_at(codes, F.col(c)), F.lit(-1)).alias(c))
        encoded = df.select(*out)
        if not self.columns:
            self.columns = encoded.columns
        return encoded.select(*[F.col(f"`{c}`") if c in encoded.columns else F.lit(0).alias(c) for c in self.columns])


def fit_encoding(train: DataFrame, wide: int = 5, drop_first: bool = False, most_levels: int = 10_000) -> Encoding:
    """The levels of the string columns of `train`; a column with over `most_levels` is refused."""
    levels = {}
    for c, t in train.dtypes:
        if t == "string":
            found = [r[0] for r in train.where(F.col(c).isNotNull()).select(c).distinct().orderBy(c).limit(most_levels + 1).collect()]
            if len(found) > most_levels:
                raise ValueError(f"{c} has over {most_levels} levels")
            levels[c] = found
    encoding = Encoding(levels, wide, drop_first)
    encoding.apply(train.limit(0))
    return encoding


def ranges(train: DataFrame) -> dict[str, tuple[float, float]]:
    """(min, max) of every numeric column, in one pass."""
    names = [c for c, t in train.dtypes if t in NUMERIC]
    row = train.agg(*[x for c in names for x in (F.min(f"`{c}`").cast("double"), F.max(f"`{c}`").cast("double"))]).first()
    return {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(names)}


def scale(df: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """(x - min) / (max - min) by training limits; a constant column becomes 0."""
    return df.withColumns({c: ((F.col(f"`{c}`") - low) / (high - low) if high is not None and high > low else F.lit(0.0)) for c, (low, high) in limits.items()})


def knn_impute(df: DataFrame, key: str, columns: list[str], k: int = 5) -> DataFrame:
    """Nulls of `columns` filled with the mean of the k nearest of all rows that have the column.

    Distance is Euclidean over the columns both rows have, scaled up for missing ones; ties
    go to the smaller key, which should be unique. NaN is missing too. A null without a row
    to compare with stays. The rows are their own donors; see donors.impute().
    """
    return impute(fit_donors(df, key, columns), df, key, k)[0]


def derive_features(df: DataFrame) -> DataFrame:
    """Ratios of amounts, transactions and ages; a ratio without a divisor is null."""
    ratio = F.try_divide("amount", "avg_amount_user")
    return df.withColumns({
        "amount_ratio": ratio,
        "tx_per_day": F.try_divide(F.col("total_transactions_user"), F.col("account_age_days") + 1),
        "far_shipping": (F.col("shipping_distance_km") > 100).cast("int"),
        "avg_per_tx": F.try_divide(F.col("avg_amount_user"), F.col("total_transactions_user") + 1),
        "amount_over_avg": ratio,
    })


def skewed_columns(train: DataFrame, columns: list[str], limit: float = 0.70) -> DataFrame:
    """(column, skew, log1p): sample-adjusted skew over the limit, and whether a logarithm applies."""
    row = train.agg(*[x for c in columns for x in (F.skewness(c).alias(f"s_{c}"), F.count(c).alias(f"n_{c}"), F.min(c).alias(f"m_{c}"))])
    entries = [F.struct(F.lit(c).alias("column"), (F.col(f"s_{c}") * F.sqrt(F.col(f"n_{c}") * (F.col(f"n_{c}") - 1.0)) / F.nullif(F.col(f"n_{c}") - 2, F.lit(0))).alias("skew"), (F.col(f"m_{c}") >= 0).alias("log1p")) for c in columns]
    return row.select(F.inline(F.array(*entries))).where(F.abs("skew") > limit)


def unskew(df: DataFrame, found: list[str]) -> DataFrame:
    return df.withColumns({c: F.log1p(c) for c in found})


def assemble(df: DataFrame, features: list[str], label: str) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df).withColumn("label", F.col(label).cast("double"))


def balanced(df: DataFrame) -> DataFrame:
    """`df` with weights that give both labels equal sums."""
    counts = {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}
    total, w = sum(counts.values()), F.lit(1.0)
    for value, n in counts.items():
        w = F.when(F.col("label") == value, total / (len(counts) * n)).otherwise(w)
    return df.withColumn("weight", w)


def fit_model(kind: str, train: DataFrame, seed: int = 42) -> Model:
    """One of `logistic`, `forest`, `bayes`, `tree`, `svm`, `svm_balanced`, on assembled rows."""
    common = {"featuresCol": "features", "labelCol": "label"}
    if kind == "logistic":
        return LogisticRegression(maxIter=50, **common).fit(train)
    if kind == "forest":
        return RandomForestClassifier(numTrees=100, seed=seed, **common).fit(train)
    if kind == "bayes":
        return NaiveBayes(modelType="gaussian", **common).fit(train)
    if kind == "tree":
        return DecisionTreeClassifier(seed=seed, maxDepth=8, **common).fit(train)
    if kind == "svm":
        return LinearSVC(maxIter=50, **common).fit(train)
    if kind == "svm_balanced":
        return LinearSVC(maxIter=50, weightCol="weight", **common).fit(balanced(train))
    raise ValueError(kind)


def predictions(model: Model, rows: DataFrame, key: str) -> DataFrame:
    """(key, label, prediction, score): score is the probability or, without one, the margin."""
    out = model.transform(rows)
    score = vector_to_array("probability")[1] if "probability" in out.columns else vector_to_array("rawPrediction")[1]
    return out.select(key, "label", "prediction", score.alias("score"))


def importances(model: Model, features: list[str], n: int = 10) -> list[str]:
    """The n features of most importance to a forest."""
    ranked = sorted(zip(model.featureImportances.toArray(), features, strict=True), key=lambda x: (-x[0], x[1]))
    return [f for _, f in ranked[:n]]


#: Ranges of scores over which the ranks of an AUC are dealt.
SCORE_RANGES = 64


def classification_metrics(scored: DataFrame) -> DataFrame:
    """One row: accuracy, precision, recall, f1 of label 1, and the exact AUC with ties.

    Counts per distinct score are dealt into ranges of scores of about equal size; how many
    negatives lie below a score are those of the ranges before and those below it in its range.
    So no task sees all scores, however many differ. The counts are written, so that what gives
    the scores runs once.
    """
    hit = lambda label, said: F.count_if((F.col("label") == label) & (F.col("prediction") == said))
    by_score = scored.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"), F.count_if(F.col("label") == F.col("prediction")).alias("right"), hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"))
    by_score = written(by_score, "scores")
    cuts = by_score.withColumn("score", F.col("score").cast("double")).approxQuantile("score", [i / SCORE_RANGES for i in range(1, SCORE_RANGES)], 0.5 / SCORE_RANGES)
    place = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c < F.col("score"))) if cuts else F.lit(0)
    by_score = by_score.withColumn("range", place)
    ranges = by_score.groupBy(F.col("range").alias("r")).agg(F.sum("neg").alias("n"))  # at most SCORE_RANGES rows
    ranges = ranges.select("r", F.coalesce(F.sum("n").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("neg").over(Window.partitionBy("range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_score = by_score.join(F.broadcast(ranges), F.col("range") == F.col("r"))
    below = F.col("before") + inside
    wins = F.col("pos") * (F.col("below") + F.col("neg") / 2)
    t = by_score.withColumn("below", below).agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "right", "tp", "fp", "fn")], F.sum(wins).alias("wins"))
    t = t.withColumns({"accuracy": F.try_divide(F.col("right"), F.col("pos") + F.col("neg")), "precision": F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)), "recall": F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return t.select("accuracy", "precision", "recall", f1.alias("f1"), F.try_divide(F.col("wins"), F.col("pos") * F.col("neg")).alias("auc"))


def compare_models(kinds: list[str], train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Metrics of each kind, one row per model.

    Both tables are read many times, so they are written first; training rows are dealt by key and
    sorted, so that models that draw rows by their place draw the same again.
    """
    weight = [c for c in ("weight",) if c in train.columns]
    train = written(train.select(key, "features", "label", *weight).repartition(key).sortWithinPartitions(key), "train")
    test = written(test.select(key, "features", "label"), "test")
    out = None
    for kind in kinds:
        row = classification_metrics(predictions(fit_model(kind, train), test, key)).withColumn("model", F.lit(kind))
        out = row if out is None else out.unionByName(row)
    return out


def attributions(rows: DataFrame, coefficients: dict[str, float], means: dict[str, float], key: str) -> DataFrame:
    """(key, feature, contribution) of a linear model: coefficient times the distance from the mean."""
    entries = [F.struct(F.lit(f).alias("feature"), (F.lit(float(w)) * (F.col(f"`{f}`") - means[f])).alias("contribution")) for f, w in coefficients.items()]
    return rows.select(key, F.inline(F.array(*entries)))


def global_attribution(contributions: DataFrame, n: int = 20) -> DataFrame:
    return contributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("importance")).orderBy(F.col("importance").desc(), "feature").limit(n)


def local_attribution(contributions: DataFrame, key: str, value: object, n: int = 15) -> DataFrame:
    return contributions.where(F.col(key) == value).orderBy(F.abs("contribution").desc(), "feature").limit(n)


def save_model(model: Model, path: str) -> None:
    PipelineModel([model]).write().overwrite().save(path)
