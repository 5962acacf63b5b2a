"""Connected components of a link table, by minimum labels and pointer jumping in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risekit.llm.common import drop_path, new_path


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): for each node of links (a, b), the smallest node that it reaches.

    Every round each node takes the smallest label among its neighbours and hands links over to
    labels (so stars form and chains halve); links inside one component vanish, and it ends when
    none is left. A node with very many links is pre-aggregated by min before each shuffle.
    """
    spark = links.sparkSession
    old: list[str] = []

    def save(df: DataFrame, name: str) -> DataFrame:
        path = new_path(spark, name)
        df.write.option("compression", "zstd").parquet(path)
        old.append(path)
        return spark.read.parquet(path)

    kind = links.schema["a"].dataType.simpleString()
    edges = save(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "cc-edges")
    label = save(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("component")), "cc-labels")
    for _ in range(rounds):
        if edges.isEmpty():
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # each root hooks on to its smallest neighbour, then roots are followed to the end of their chains
        hook = both.groupBy("a").agg(F.min("b").alias("least")).where("least < a").select(F.col("a").alias("root"), F.col("least").alias("to"))
        hook = save(hook, "cc-hooks")
        for _ in range(rounds):
            up = hook.select(F.col("root").alias("r2"), F.col("to").alias("t2"))
            jumped = save(hook.join(up, F.col("to") == F.col("r2"), "left").select("root", F.coalesce("t2", "to").alias("to"), F.col("t2").isNotNull().alias("moved")), "cc-hooks")
            hook = jumped.select("root", "to")
            if jumped.where("moved").isEmpty():
                break
        label = save(label.join(hook, F.col("component") == F.col("root"), "left").select("node", F.coalesce("to", "component").alias("component")), "cc-labels")
        left = hook.select(F.col("root").alias("ra"), F.col("to").alias("ta"))
        right = hook.select(F.col("root").alias("rb"), F.col("to").alias("tb"))
        moved = edges.join(left, F.col("a") == F.col("ra"), "left").join(right, F.col("b") == F.col("rb"), "left").select(F.coalesce("ta", "a").alias("x"), F.coalesce("tb", "b").alias("y"))
        edges = save(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct(), "cc-edges")
    else:
        raise RuntimeError("components did not settle")
    kept = {f.rsplit("/", 1)[0].split(":", 1)[-1].lstrip("/") for f in label.inputFiles()}
    for path in old:
        if path.split(":", 1)[-1].lstrip("/") not in kept:
            drop_path(spark, path)
    return label.select(F.col("node").cast(kind), F.col("component").cast(kind))
