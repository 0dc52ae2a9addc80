"""Shared helpers: tables, the shared scratch folder, connected components."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space and the control characters 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows and bytes of a batch that goes to Python at once; texts can be long.
BATCH_ROWS, BATCH_BYTES = 500, 2 << 20
#: Bytes of a row group of a table between steps, which its writer holds in memory.
GROUP_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir, or one of our own where it is unset (tests, local mode)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors reach")
        at = "file://" + os.path.join(tempfile.gettempdir(), "inkveil-shared")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/inkveil-{kind}-{uuid.uuid4().hex}"


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` (for mapInPandas or mapInArrow), after which a worker gives free memory back to the system: workers outlive their tasks, and what each holds adds up over the steps of a job."""

    @functools.wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # glibc
            libc.malloc_trim(0)

    return tidied


_made: list[str] = []


def cut(df: DataFrame, kind: str = "cut") -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: lineage ends there and a lost executor costs no earlier work."""
    spark = df.sparkSession
    path = scratch(spark, kind)
    df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by cut() that no later step reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/inkveil-" in path:
            _delete(df.sparkSession, path)


def settled(make: Callable[[], DataFrame], kind: str) -> DataFrame:
    """The table that `make` gives, written; the tables that cut() wrote for it meanwhile are deleted."""
    mark = len(_made)
    out = cut(make(), kind)
    for path in _made[mark:-1]:
        _delete(out.sparkSession, path)
    del _made[mark:-1]
    return out


def free(name: str, *taken: DataFrame) -> str:
    """`name`, with underscores behind it as long as a column of `taken` has that name in any case."""
    names = {c.lower() for df in taken for c in df.columns}
    while name.lower() in names:
        name += "_"
    return name


#: Bits of the map of keys for each key, and the most bits, i.e. 2 ** 20 rows of a broadcast table.
BITS_A_KEY, MOST_BITS = 16, 1 << 26


def probable(rows: DataFrame, key: str, wanted: DataFrame, absent: bool = False) -> DataFrame:
    """Rows of which `wanted` may hold the key: all that it holds and a few others, by a broadcast bitmap; `absent`: all the other rows.

    The map has BITS_A_KEY bits or more for each row of `wanted`, which should be a written table, as it is counted. If that is over MOST_BITS, nothing
    is told apart: all rows may be held and none is known to be absent. Columns of `rows` may have any names."""
    n = wanted.count()
    if n * BITS_A_KEY > MOST_BITS:
        return rows.filter(F.lit(False)) if absent else rows
    size = 1 << max(16, (n * BITS_A_KEY - 1).bit_length())
    place = F.pmod(F.xxhash64(key), F.lit(size))
    word, held, at = free("_word", rows), free("_held", rows), free("_at", rows)
    bits = wanted.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias(word)).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 AS int))")).alias(held))
    kept = rows.withColumn(at, place).withColumn(word, F.shiftright(at, 6)).join(F.broadcast(bits), word, "left" if absent else "inner")
    return kept.filter(F.expr(f"(shiftright(coalesce(`{held}`, 0L), cast(`{at}` % 64 AS int)) & 1) = {0 if absent else 1}")).select(*(F.col(f"`{c}`") for c in rows.columns))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected graph `edges`(u, v): rows (node, component), component the smallest node.

    Alternates the large-star and small-star steps (Kiveris et al., 2014). Each step takes minima by partial
    aggregation, writes them and attaches them by an equi-join of two written tables, which Spark can split where a hub has very many neighbours.
    Self-loops and null ends are ignored; nodes without edges aren't returned; an empty graph gives no rows.
    """
    e = cut(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lows")
        large = both.filter("v > u").join(low, "u").select(F.col("m").alias("u"), "v").filter("u <> v").distinct()
        # small star: each node's lower neighbours and itself go to the lowest of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b")).filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()
        n = cut(small, "edges")
        sign = n.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        forget(e)
        e = n
        if sign == seen or sign[0] == 0:
            break
        seen = sign
    return e.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component")).unionByName(e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


def block_pairs(rows: DataFrame, node: str) -> DataFrame:
    """Rows (l, o): each block of a group with each block of it from that on; o is null where a block is with itself. l and o are arrays of structs of the other columns.

    rows: (h, blocks, ...), h the group and `blocks` how many it has, the same in all of its rows; a hash of `node` deals its rows to them. They are gathered
    before blocks meet, so that a row stands for a block and no member is a row more than once."""
    own = [c for c in rows.columns if c not in ("h", "blocks")]
    dealt = rows.withColumn("i", F.pmod(F.xxhash64(node), F.col("blocks")).cast("int"))
    held = cut(dealt.groupBy("h", "blocks", "i").agg(F.collect_list(F.struct(*own)).alias("l")), "blocks")
    later = held.filter("i < blocks - 1").select("h", "l", F.explode(F.sequence(F.col("i") + 1, F.col("blocks").cast("int") - 1)).alias("i"))
    other = held.filter("blocks > 1").select("h", "i", F.col("l").alias("o"))
    return held.select("l", F.lit(None).cast(held.schema["l"].dataType).alias("o")).unionByName(later.join(other, ["h", "i"]).select("l", "o"))
