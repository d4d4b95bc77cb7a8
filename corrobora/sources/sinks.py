"""Sinks. All writes are distributed; a document format is a folder of JSON lines plus one metadata row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from corrobora.model import EvidenceGraph
from corrobora.session import cut_lineage, ordinal_within


def write_graph(graph: EvidenceGraph, path: str, mode: str = "overwrite") -> None:
    """Nodes partitioned by type and edges by relation, so that later reads prune to what they need."""
    graph.nodes.write.mode(mode).partitionBy("type").parquet(f"{path}/nodes")
    graph.edges.write.mode(mode).partitionBy("rel").parquet(f"{path}/edges")


def read_graph(spark, path: str) -> EvidenceGraph:
    return EvidenceGraph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def write_graph_json(graph: EvidenceGraph, path: str, mode: str = "overwrite", compression: str = "gzip") -> None:
    """Nodes and links as JSON lines; Spark's JSON reader takes the compressed files as they are."""
    graph.nodes.write.mode(mode).json(f"{path}/nodes", compression=compression)
    graph.edges.write.mode(mode).json(f"{path}/links", compression=compression)


def matrix(rows: DataFrame, labels: list[str]) -> DataFrame:
    """Square form of (row, col, similarity) for a chosen set of entities; absent pairs are 0.

    Only a matrix whose columns were named is built: the long form is the scalable one.
    """
    wide = rows.filter(F.col("col").isin(*labels)).groupBy("row").pivot("col", labels).agg(F.first("similarity"))
    return wide.na.fill(0.0)


def write_similarity_matrix(rows: DataFrame, labels: list[str], path: str, mode: str = "overwrite") -> None:
    matrix(rows.filter(F.col("row").isin(*labels)), labels).orderBy("row").write.mode(mode).option("header", True).csv(path)


def similarity_tiles(rows: DataFrame, entities: DataFrame, tile: int = 256) -> DataFrame:
    """(row_block, col_block, cells): the matrix of all entities in tiles of ``tile`` x ``tile``, one row per tile that is not empty.

    ``rows(row, col, similarity)`` are the cells of both triangles and the diagonal, ``entities(entity)`` all entities;
    entities are numbered in the order of their ids without one task sorting them. ``cells`` is sorted by row and column
    and holds (row, col, similarity); cells that are left out are 0. A tile's size is bounded, whatever the matrix.
    """
    placed = cut_lineage(
        ordinal_within(entities.select("entity").distinct(), [], ["entity"], "place").select("entity", F.floor(F.col("place") / tile).cast("long").alias("block"))
    )
    side = lambda e: placed.select(F.col("entity").alias(e), F.col("block").alias(f"{e}_block"))
    return (
        rows.join(side("row"), "row").join(side("col"), "col").groupBy("row_block", "col_block")
        .agg(F.array_sort(F.collect_list(F.struct("row", "col", "similarity"))).alias("cells"))
    )


def write_similarity_tiles(tiles: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The tiles in the order of their blocks, so that a reader of some rows opens few files."""
    tiles.repartitionByRange("row_block", "col_block").sortWithinPartitions("row_block", "col_block").write.mode(mode).parquet(path)


def write_connections(connections: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Pair records as JSON lines, best score first (a range sort; the files follow the order)."""
    connections.orderBy(F.desc("score"), "a", "b").write.mode(mode).json(path)


def stringify_complex(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs become JSON text for tools that only take scalars."""
    cols = [
        F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (ArrayType, MapType, StructType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ]
    return df.select(*cols)


def write_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Flat tables in one folder each; for CSV complex columns are written as JSON text."""
    for name, df in tables.items():
        flat = stringify_complex(df) if fmt == "csv" else df
        writer = flat.write.mode(mode)
        (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(f"{path}/{name}")


def export_meta(graph: EvidenceGraph, generated: str, includes_pending: bool) -> DataFrame:
    nodes = graph.nodes.agg(F.count(F.lit(1)).alias("nodes"))
    edges = graph.edges.agg(F.count(F.lit(1)).alias("edges"))
    return nodes.withColumn("edges", edges.scalar()).withColumn("generated", F.lit(generated)).withColumn("includes_pending_papers", F.lit(includes_pending))


def write_export(
    graph: EvidenceGraph, path: str, generated: str, includes_pending: bool = False, mode: str = "overwrite", compression: str = "gzip"
) -> None:
    write_graph_json(graph, path, mode, compression)
    export_meta(graph, generated, includes_pending).write.mode(mode).json(f"{path}/meta")
