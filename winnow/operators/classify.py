"""Categories of images from models' scores and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions import vectors

# Label names of each family, lower case.
FAMILIES = {
    "people": "person human face people man woman child boy girl".split(),
    "animal": "dog cat bird animal pet wildlife fish mammal reptile insect".split(),
    "landscape": "mountain beach sky ocean forest lake river sunset sunrise nature scenery landscape sea cloud field valley waterfall desert".split(),
}


def by_scores(people: Column, animal: Column, landscape: Column, other: Column) -> Column:
    """The category of four scores: people, animal and landscape by their thresholds in turn, else the highest, the first of equal ones."""
    top = F.greatest(people, animal, landscape, other)
    highest = F.when(people == top, "people").when(animal == top, "animal").when(landscape == top, "landscape").otherwise("other")
    return F.when((people >= 0.30) & (people >= animal - 0.03), "people").when((animal >= 0.38) & (animal - people >= 0.05), "animal").when(landscape >= 0.35, "landscape").otherwise(highest)


def class_scores(similarities: Column, prompts: list[int]) -> Column:
    """Scores of classes by likeness to their prompts, which follow each other, so many
    for each class: the highest in a class, and softmax over classes."""
    starts = [sum(prompts[:i]) + 1 for i in range(len(prompts))]
    return vectors.softmax(F.array(*[F.array_max(F.slice(similarities, a, n)) for a, n in zip(starts, prompts, strict=True)]))


def families(labels: DataFrame, key: str) -> DataFrame:
    """Highest confidence and number of labels of each key and family; other labels are left out."""
    f = labels.withColumn("family", family(F.col("label"))).where("family is not null")
    return f.groupBy(key, "family").agg(F.max("confidence").alias("top"), F.count("*").alias("n"))


def family(label: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, labels in FAMILIES.items():
        out = F.when(F.lower(label).isin(*labels), name).otherwise(out)
    return out


def by_labels(labels: DataFrame, key: str) -> DataFrame:
    """The category of each key from labels (key, label, confidence).

    Animals give way to people unless there are two labels more or a confidence 8
    higher, and to landscape unless there are two labels or a confidence of 85.
    """
    f = labels.withColumn("family", family(F.col("label")))
    of = lambda n: F.col("family") == n
    g = f.groupBy(key).agg(
        *[F.count_if(of(n)).alias(f"{n}_n") for n in FAMILIES],
        *[F.coalesce(F.max(F.when(of(n), F.col("confidence"))), F.lit(0.0)).alias(f"{n}_top") for n in ("people", "animal")],
    )
    dominates = (F.col("animal_n") >= F.col("people_n") + 2) | (F.col("animal_top") >= F.col("people_top") + 8)
    strong = (F.col("animal_n") >= 2) | (F.col("animal_top") >= 85)
    has = {n: F.col(f"{n}_n") > 0 for n in FAMILIES}
    category = (
        F.when(has["people"] & (~has["animal"] | ~dominates), "people")
        .when(has["animal"] & (has["people"] | ~has["landscape"] | strong), "animal")
        .when(has["landscape"], "landscape")
        .otherwise("other")
    )
    return g.select(key, category.alias("category"))


def chain(local: Column, remote: Column) -> Column:
    """Category and source: of the local model, else the remote one, else the fallback."""
    return F.struct(F.coalesce(local, remote, F.lit("other")).alias("category"), F.when(local.isNotNull(), "local").when(remote.isNotNull(), "remote").otherwise("fallback").alias("source"))


def repaired(value: Column, allowed: list[str], otherwise: str) -> Column:
    """A model's answer if it is one of those allowed, in any case, else another."""
    low = F.lower(F.trim(value))
    return F.when(low.isin(*allowed), low).otherwise(otherwise)
