"""Writers: builds, plans, scores, lists and sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_build(df: DataFrame, path: str, build: str) -> None:
    """Replace one build's rows and leave the others: only its partition is overwritten."""
    df.withColumn("build", F.lit(build)).write.option("partitionOverwriteMode", "dynamic").partitionBy("build").mode("overwrite").parquet(path)


def append_build(df: DataFrame, path: str, build: str) -> None:
    df.withColumn("build", F.lit(build)).write.partitionBy("build").mode("append").parquet(path)


def save_counts(units: DataFrame, path: str) -> None:
    """The counts that unit queries read instead of the edges: rewritten by build after each save."""
    c = units.groupBy("build", "kind", "key").agg(F.count("*").alias("said"))
    c.write.option("partitionOverwriteMode", "dynamic").partitionBy("build").mode("overwrite").parquet(path)


def catch_up(new: DataFrame, held: DataFrame, by: str = "video_id") -> DataFrame:
    """Rows of videos that the corpus does not hold yet."""
    return new.join(held.select(by).distinct(), by, "left_anti")


def replace_rows(held: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """held with new rows in place of those with their keys."""
    return held.join(new.select(*by).distinct(), by, "left_anti").unionByName(new, allowMissingColumns=True)


def append_history(held: DataFrame, new: DataFrame) -> DataFrame:
    """Experiment rows of all runs; columns that either side lacks are null there."""
    return held.unionByName(new, allowMissingColumns=True)


def sync_guard(local: DataFrame, upstream: DataFrame, by: str = "video_id") -> int:
    """How many rows only the local side has: a copy over them must be refused if there are any."""
    return local.select(by).subtract(upstream.select(by)).count()


def stamp(*parts: DataFrame) -> str:
    """A digest of tables' rows, whatever their order: results stored under it are still current."""
    total = []
    for p in parts:
        r = p.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*p.columns).cast("decimal(38,0)")).alias("h")).first()
        total.append(f"{r['n']}:{r['h']}")
    import hashlib

    return hashlib.sha256("|".join(total).encode()).hexdigest()


def write_tsv(df: DataFrame, path: str, order: list[str]) -> None:
    """A small ordered sheet as one tabbed file with a header."""
    df.orderBy(*order).coalesce(1).write.csv(path, sep="\t", header=True, mode="overwrite")


def study_list(order: DataFrame, forms: DataFrame) -> DataFrame:
    """(line, ranked, pos): ordered words in their listed forms, each form once, and after them the forms left over.

    order (word, pos), forms (word, form)."""
    ranked = order.join(forms, "word", "left").select(F.coalesce("form", "word").alias("line"), "pos").groupBy("line").agg(F.min("pos").alias("pos"))
    rest = forms.select(F.col("form").alias("line")).distinct().join(ranked, "line", "left_anti")
    return ranked.select("line", F.lit(True).alias("ranked"), "pos").unionByName(rest.select("line", F.lit(False).alias("ranked"), F.lit(None).cast(ranked.schema["pos"].dataType).alias("pos")))


def out_of_reach(goals: DataFrame, reached: DataFrame, counts: DataFrame, mentioned: DataFrame) -> DataFrame:
    """(key, why): goals not reached, as never said, said but never counted, or crowded by other unknowns."""
    lost = goals.select("kind", "key").join(reached.select("kind", "key"), ["kind", "key"], "left_anti")
    said = lost.join(counts.select("kind", "key", "said"), ["kind", "key"], "left").join(mentioned.select("key", F.lit(True).alias("heard")), "key", "left")
    return said.select("key", F.when(F.col("said") > 0, "crowded").when(F.col("heard"), "said never shown").otherwise("never said").alias("why"))


def tables_of(spark: SparkSession) -> DataFrame:
    """(table, column, type) of the current database: the schema document's rows."""
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table string, column string, type string")
