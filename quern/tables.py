"""Tables in the shared checkpoint folder, salted joins, connected components."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors: spark.checkpoint.dir, or in local mode a private one where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    app = spark.sparkContext.applicationId
    if not base:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if app not in _OWN_DIR:
            _OWN_DIR[app] = tempfile.mkdtemp(prefix="quern-")
            spark.sparkContext.setCheckpointDir(_OWN_DIR[app])
        base = _OWN_DIR[app]
    root = f"{base.rstrip('/')}/quern-{app}"
    if root not in _CLEANED:
        _CLEANED.add(root)
        atexit.register(_remove, spark, root)
    return root


_CLEANED: set[str] = set()


def _remove(spark: SparkSession, root: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session is gone: its folder is the cluster's to sweep
        pass


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name that none of those taken equals, whatever the case."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name += "_"
    return name


def drop_scratch(spark: SparkSession) -> None:
    """Remove what settle() has written so far: for long sessions, between jobs whose results are no longer read."""
    _remove(spark, scratch_dir(spark))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark then removes an execution's shuffle files as it ends, not when the driver happens to collect its garbage.
_SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_MADE = threading.local()


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends there and no executor's loss undoes it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_SWEEP, None)
    spark.conf.set(_SWEEP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_SWEEP) if before is None else spark.conf.set(_SWEEP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    getattr(_MADE, "paths", []).append(path)
    return out


def settle_only(make: Callable[[], DataFrame], name: str = "table") -> DataFrame:
    """settle() of what make() gives; tables that were settled on the way are removed, as nothing else reads them."""
    outer = getattr(_MADE, "paths", None)
    _MADE.paths = made = []
    try:
        out = settle(make(), name)
    finally:
        _MADE.paths = [] if outer is None else outer
    for path in made:
        if path != out._settled:
            _remove(out.sparkSession, path)
    _MADE.paths.append(out._settled)
    return out


def release(*tables: DataFrame) -> None:
    """Remove settled tables whose readers have all been settled; other tables are left alone."""
    for t in tables:
        if path := t.__dict__.get("_settled"):
            _remove(t.sparkSession, path)


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of value, which is read from its row once: a lambda that names a binary column copies it at each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it is so small that its files make fewer splits; a large table stays where it is."""
    spark = df.sparkSession
    if df.isStreaming:
        return df
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < cores * split // 4
    return df.repartition(cores) if small else df


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with a gapless number from 0 in the order given: sorted in ranges, each range counted, no single task over all."""
    rows = settle(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "sorted").withColumn("_range", F.shiftrightunsigned("_id", 33))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = rows.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return rows.join(F.broadcast(starts.drop("_n")), "_range").withColumn(name, F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id", "_range", "_before")


def salted_join(big: DataFrame, small: DataFrame, on: list[str], by: Column, how: str = "left", salts: int = 16) -> DataFrame:
    """Join on keys of which one may hold a large part of big's rows.

    big's rows are dealt over `salts` copies of small's matching row by the deterministic value `by`;
    small must have one row for each key and be much smaller than big.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def hot_join(big: DataFrame, small: DataFrame, on: list[str], by: Column, hot_rows: int = 100_000) -> DataFrame:
    """Inner join of big with a small side that has one row for each key and heavy columns.

    Keys with more than `hot_rows` rows in big are counted first (map-side) and dealt over copies of their small
    row, one for each hot_rows rows; all other keys are joined as they are, so that nothing else is copied."""
    hot = big.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows)
    hot = settle(hot.select(*on, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts")), "hot")
    if hot.isEmpty():
        release(hot)
        return big.join(small, on)
    # at most (rows of big) / hot_rows keys
    left = big.join(hot, on, "left").withColumn("_salt", F.pmod(F.xxhash64(by), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    right = small.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return left.join(right, [*on, "_salt"]).drop("_salt")


def components(edges: DataFrame, name: str = "cc", salts: int = 8) -> DataFrame | None:
    """Connected components of (a, b): (node, root), root the least node, of every node in an edge; None without edges.

    Each round every node picks its least neighbour (itself included), chains of picks are halved by
    pointer jumping, and the graph is contracted to the picks' ends; the nodes left are at most half.
    Everything stays distributed; tables are written between rounds.
    """
    edges = settle(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    found = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pick = settle(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), name)
        while True:
            up = pick.select(F.col("node").alias("root"), F.col("root").alias("top")).where("root <> top")
            far = settle(salted_join(pick, up, ["root"], F.col("node"), salts=salts).select("node", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), name)
            pick = far.select("node", "root")
            if far.where("moved").isEmpty():
                break
        if found is None:
            found = pick
        else:
            deep = salted_join(found, pick.select(F.col("node").alias("root"), F.col("root").alias("top")), ["root"], F.col("node"), salts=salts)
            found = settle(deep.select("node", F.coalesce("top", "root").alias("root")), name)
        a = salted_join(edges, pick.select(F.col("node").alias("a"), F.col("root").alias("ra")), ["a"], F.col("b"), "inner", salts)
        ab = salted_join(a, pick.select(F.col("node").alias("b"), F.col("root").alias("rb")), ["b"], F.col("a"), "inner", salts)
        edges = settle(ab.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), name)
    return found
