"""Readers: graphs and path indexes as tables, alignments as messages or JSON lines, path information as tab-separated text.

Protobuf's JSON leaves out zero and false and writes 64-bit integers as strings and bytes as base64; the
readers take either form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathquant.operators.paths import path_names
from pathquant.plans.store import stored
from pathquant.sources import blockgzip

_POSITION = "position struct<node_id:string,offset:string,is_reverse:boolean>"
_PATH = f"struct<mapping:array<struct<{_POSITION.replace(' ', ':', 1)},edit:array<struct<from_length:int,to_length:int,sequence:string>>>>>"
_COMMON = "name string, pair_id long, mate int, sequence string, quality string, mapping_quality int, annotation map<string,string>"
ALIGNMENT = f"{_COMMON}, score int, path {_PATH}, fragment_length_distribution string"
MULTIPATH = f"{_COMMON}, start array<int>, subpath array<struct<path:{_PATH},score:int,next:array<int>,connection:array<struct<next:int,score:int>>>>"


def read_nodes(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """(node_id, length). JSON nodes have an id and a sequence, of which the length is taken."""
    if fmt == "parquet":
        return spark.read.parquet(path).select(F.col("node_id").cast("long").alias("node_id"), F.col("length").cast("int").alias("length"))
    rows = spark.read.schema("id string, sequence string").json(path)
    return rows.select(F.col("id").cast("long").alias("node_id"), F.length(F.coalesce("sequence", F.lit(""))).alias("length"))


def read_steps(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col("path_id").cast("long").alias("path_id"), F.col("ordinal").cast("int").alias("ordinal"), F.col("node_id").cast("long").alias("node_id"), F.col("is_reverse").alias("is_reverse"))


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    """(path_id, name): given, or made of sample, contig, phase and count where the table has those."""
    rows = spark.read.parquet(path)
    return rows.select(F.col("path_id").cast("long").alias("path_id"), "name") if "name" in rows.columns else path_names(rows)


def _numbers(path: str) -> str:
    """An expression that casts the places of a path's mappings."""
    place = "named_struct('node_id', coalesce(cast(m.position.node_id as bigint), 0L), 'offset', coalesce(cast(m.position.offset as bigint), 0L), 'is_reverse', coalesce(m.position.is_reverse, false))"
    edits = "transform(coalesce(m.edit, array()), e -> named_struct('from_length', coalesce(e.from_length, 0), 'to_length', coalesce(e.to_length, 0)))"
    return f"named_struct('mapping', transform(coalesce({path}.mapping, array()), m -> named_struct('position', {place}, 'edit', {edits})))"


def _with_read_ids(rows: DataFrame, interleaved: bool) -> DataFrame:
    """Adds read_id and, where there is none, mate. rows are records as scanned, with file, block and place columns.

    A record without a pair id is called by its number in the input (files by name, lines in their order), so equal
    records stay apart and reruns agree; ids that are generated lie above those that are given. Interleaved records
    are pairs line by line, numbered without gaps from file to file. Only the splits' sizes, one row each, are summed up.
    """
    rows = stored(rows, "records")
    blocks = rows.groupBy("_file", "_block").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"), F.max("pair_id").alias("_pair"))
    order, own = Window.orderBy("_file", "_block"), Window.partitionBy("_file").orderBy("_block")
    before = Window.unboundedPreceding, -1
    records, last = F.sum("_n").over(Window.partitionBy("_file")), F.row_number().over(Window.partitionBy("_file").orderBy(F.desc("_block"))) == 1
    # what a file has of numbers counts at its last split, so before a split are those of the files before
    blocks = blocks.withColumn("_own", F.when(last, F.ceil(records / 2) if interleaved else records).otherwise(0))
    blocks = blocks.select("_file", "_block", "_first", F.coalesce(F.sum("_own").over(order.rowsBetween(*before)), F.lit(0)).alias("_start"), F.coalesce(F.sum("_n").over(own.rowsBetween(*before)), F.lit(0)).alias("_line"), (F.coalesce(F.max("_pair").over(Window.partitionBy()), F.lit(-1)) + 1).alias("_base"))
    rows = rows.join(blocks, ["_file", "_block"])
    line = F.col("_place") - F.col("_first") + F.col("_line")
    number = F.col("_start") + (F.floor(line / 2) if interleaved else line)
    mate = (line % 2 + 1).cast("int") if interleaved else F.lit(1)
    ids = F.coalesce("pair_id", F.col("_base") + number)
    return rows.withColumn("mate", F.coalesce("mate", mate)).withColumn("read_id", ids).drop("_file", "_block", "_place", "_first", "_start", "_line", "_base")


def read_alignments(spark: SparkSession, path: str, multipath: bool = True, interleaved: bool = False, fmt: str | None = None, split: int | None = None) -> DataFrame:
    """Reads with ``read_id`` (one per fragment) and ``mate`` (1 or 2).

    Records carry a pair id and a mate, or are pairs in consecutive records (interleaved), or are single reads. fmt is
    "json" (lines), "gam" or "gamp" (framed messages in block-gzip, which several tasks read); None tells by the path's end.
    split: bytes of a file of messages that one task reads, about.
    """
    messages = "gamp" if multipath else "gam"
    if (fmt or (messages if path.rstrip("/").endswith(f".{messages}") else "json")) == messages:
        blockgzip.register(spark)
        rows = spark.read.format(messages).options(**({"split": str(split)} if split else {})).load(path)
        rows = rows.withColumns({"pair_id": F.lit(None).cast("long"), "mate": F.lit(None).cast("int")})
        rows = _with_read_ids(rows, interleaved)
    else:
        rows = spark.read.schema(MULTIPATH if multipath else ALIGNMENT).json(path)
        rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_place"))
        rows = _with_read_ids(rows, interleaved).withColumn("quality", F.unbase64("quality"))
    rows = rows.withColumn("mapping_quality", F.coalesce("mapping_quality", F.lit(0)))
    if multipath:
        parts = f"transform(subpath, s -> named_struct('path', {_numbers('s.path')}, 'score', coalesce(s.score, 0), 'next', s.next, 'connection', s.connection))"
        return rows.withColumn("subpath", F.expr(parts)).drop("pair_id", "name")
    return rows.withColumn("path", F.when(F.col("path").isNotNull(), F.expr(_numbers("path")))).withColumn("score", F.coalesce("score", F.lit(0))).drop("pair_id", "name")


def has_path(alignments: DataFrame) -> DataFrame:
    """Reads that have a path, or at least one subpath."""
    column = "subpath" if "subpath" in alignments.columns else "path.mapping"
    return alignments.where(F.size(F.coalesce(F.col(column), F.array())) > 0)


def read_path_info(spark: SparkSession, path: str, parse_haplotypes: bool = True, collapse: bool = False) -> DataFrame:
    """(name, transcript, group_id, source_ids, source_count) of a path information file, plain or gzip.

    The columns are name, length, transcript, an optional reference, and last the haplotypes, comma-separated.
    Group and source ids are ranks of the names: only their equality counts. Without parse_haplotypes the
    haplotypes are only counted. With collapse a path is called by its transcript.
    """
    rows = spark.read.option("sep", "\t").option("header", "true").option("quote", "").csv(path)
    names = rows.columns
    if len(names) not in (4, 5):
        raise ValueError(f"path information has 4 or 5 columns, not {len(names)}")
    rows = rows.select(F.col(f"`{names[0]}`").alias("name"), F.col(f"`{names[2]}`").alias("transcript"), F.split(F.col(f"`{names[-1]}`"), ",").alias("haplotypes"))
    repeated = rows.groupBy("name").count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"path {repeated[0]['name']} is given twice")
    rows = rows.withColumn("group_id", F.xxhash64("transcript"))
    if parse_haplotypes:
        rows = rows.withColumn("source_ids", F.transform(F.array_distinct("haplotypes"), lambda h: F.xxhash64(h))).withColumn("source_count", F.size("source_ids"))
    else:
        rows = rows.withColumn("source_ids", F.lit(None).cast("array<long>")).withColumn("source_count", F.size("haplotypes"))
    return rows.withColumn("name", F.col("transcript") if collapse else F.col("name")).drop("haplotypes")


def with_path_info(paths: DataFrame, info: DataFrame | None) -> DataFrame:
    """paths(path_id, name, ...) with group_id, source_ids and source_count; every path must have information."""
    if info is None:
        return paths.withColumns({"group_id": F.lit(0).cast("long"), "source_ids": F.lit(None).cast("array<long>"), "source_count": F.lit(1), "transcript": F.col("name")})
    missing = paths.join(info, "name", "left_anti").limit(1).collect()
    if missing:
        raise ValueError(f"path {missing[0]['name']} has no path information")
    return paths.join(info, "name")
