"""Label statistics, splits and entity metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapline import constants as C
from gapline.operators.sequence import label_runs
from gapline.session import materialize


def label_dimension(df: DataFrame) -> DataFrame:
    """(label_id, label), by id."""
    return df.sparkSession.createDataFrame(list(enumerate(C.LABELS)), "label_id int, label string")


def class_weights(samples: DataFrame) -> DataFrame:
    """(label_id, weight) of samples (labels array<int>): n / (classes present * n of the class); 1 for absent ones."""
    counts = samples.select(F.explode("labels").alias("label_id")).groupBy("label_id").agg(F.count("*").alias("n"))
    totals = counts.agg(F.sum("n").alias("total"), F.count("*").alias("present"))
    joined = label_dimension(samples).join(counts, "label_id", "left").join(F.broadcast(totals))  # one row
    return joined.select("label_id", F.coalesce(F.col("total") / (F.col("present") * F.col("n")), F.lit(1.0)).alias("weight"))


def to_label_sequences(labels: Column, predicted: Column) -> tuple[Column, Column]:
    """Names of both sides at the places whose label is not ignored."""
    names = F.array(*map(F.lit, C.LABELS))
    pairs = F.filter(F.arrays_zip(labels.alias("l"), predicted.alias("p")), lambda z: z["l"] != C.IGNORED_LABEL)
    return F.transform(pairs, lambda z: F.get(names, z["l"])), F.transform(pairs, lambda z: F.get(names, z["p"]))


def entities(labelled: DataFrame) -> DataFrame:
    """(doc_key, category, start, end) of rows (doc_key, pos, label)."""
    return label_runs(labelled).groupBy("doc_key", "category", "run").agg(F.min("pos").alias("start"), F.max("pos").alias("end")).drop("run")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def scores(true: Column, predicted: Column, both: Column) -> dict[str, Column]:
    p, r = ratio(both, predicted), ratio(both, true)
    return {"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r)}


def matched(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Entities of either side (category, g, p): equal if document, category and both ends are."""
    return paired(entities(gold), entities(predicted))


def paired(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """The same of what `entities` gives."""
    keys = ["doc_key", "category", "start", "end"]
    return gold.withColumn("g", F.lit(1)).join(predicted.withColumn("p", F.lit(1)), keys, "full")


COUNTS = {"n_true": "count(g)", "n_predicted": "count(p)", "n_both": "count(g + p)"}


def entity_counts(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(category, n_true, n_predicted, n_both)."""
    return matched(gold, predicted).groupBy("category").agg(*[F.expr(v).alias(k) for k, v in COUNTS.items()])


def entity_scores(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row (precision, recall, f1) over all entities."""
    return pair_scores(matched(gold, predicted))


def pair_scores(pairs: DataFrame) -> DataFrame:
    """The same of what `paired` gives."""
    sums = pairs.agg(*[F.expr(v).alias(k) for k, v in COUNTS.items()])
    return sums.select(*[v.alias(k) for k, v in scores(*map(F.col, COUNTS)).items()])


def entity_report(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(name, precision, recall, f1, support) by category, and micro, macro and weighted averages.

    One rollup counts the categories and all entities; the averages are made of its few rows, a category each."""
    rolled = matched(gold, predicted).rollup("category").agg(F.grouping("category").alias("is_all"), *[F.expr(v).alias(k) for k, v in COUNTS.items()])
    s = scores(*map(F.col, COUNTS))
    row = F.struct(F.col("category").alias("name"), *[v.alias(k) for k, v in s.items()], F.col("n_true").alias("support"))
    kind = "struct<name:string,precision:double,recall:double,f1:double,support:bigint>"
    empty = F.struct(F.lit(None).cast("string").alias("name"), *[F.lit(0.0).alias(k) for k in s], F.lit(0).cast("bigint").alias("support"))
    lists = rolled.agg(F.collect_list(F.when(F.col("is_all") == 0, row)).alias("by"), F.coalesce(F.max(F.when(F.col("is_all") == 1, row)), empty).alias("every"))
    sums = lambda value: f"aggregate(by, 0D, (a, x) -> a + {value})"
    macro = ", ".join(f"'{k}', if(size(by) = 0, 0D, {sums(f'x.{k}')} / size(by))" for k in s)
    weighted = ", ".join(f"'{k}', if(every.support = 0, 0D, {sums(f'x.{k} * x.support')} / every.support)" for k in s)
    micro = ", ".join(f"'{k}', every.{k}" for k in s)
    averages = [f"cast(named_struct('name', '{name} avg', {values}, 'support', every.support) AS {kind})" for name, values in (("micro", micro), ("macro", macro), ("weighted", weighted))]
    return lists.select(F.expr(f"inline(concat(by, array({', '.join(averages)})))"))


def max_length(lengths: DataFrame, col: str = "n", most: int = C.MOST_SUBWORDS) -> DataFrame:
    """One row (max_len): the 95th percentile, cut to whole numbers, at most `most`."""
    return lengths.agg(F.least(F.lit(most), F.floor(F.expr(f"percentile({col}, 0.95)"))).cast("int").alias("max_len"))


def sequential_split(samples: DataFrame, order: str, train: float = C.SPLIT[0], validation: float = C.SPLIT[1]) -> DataFrame:
    """Adds `part`: the first share is train, the next validation, the rest test; `order` is unique.

    The place of a row is its place in a range partition after the rows of the partitions before, so that no task sees
    all rows."""
    if not 0 <= train <= 1 or not 0 <= validation <= 1 - train:
        raise ValueError("shares are not within 0 and 1")
    # range partitions are stored with each row's place in its partition, and the counts of those before are joined by number
    ranged = samples.repartitionByRange(F.col(order)).sortWithinPartitions(order)
    ranged = materialize(ranged.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")), "ranges")
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))  # a row a partition
    before = Window.orderBy("__part")
    counts = counts.select("__part", "__first", (F.sum("__n").over(before) - F.col("__n")).alias("__base"), F.sum("__n").over(Window.partitionBy()).alias("__total"))
    placed = ranged.join(F.broadcast(counts), "__part").withColumn("__place", F.col("__base") + F.col("__at") - F.col("__first"))
    a = F.floor(F.col("__total") * train)
    b = a + F.floor(F.col("__total") * validation)
    part = F.when(F.col("__place") < a, "train").when(F.col("__place") < b, "validation").otherwise("test")
    return placed.select(*samples.columns, part.alias("part"))


def hashed_split(samples: DataFrame, order: str, share: float = 0.1) -> DataFrame:
    """Adds `part`: a fixed pseudo-random share of the keys, by their MD5, is validation, the rest train."""
    cut = F.conv(F.substring(F.md5(F.col(order).cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 10_000 < round(share * 10_000)
    return samples.withColumn("part", F.when(cut, "validation").otherwise("train"))
