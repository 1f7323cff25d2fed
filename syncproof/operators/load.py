"""Load modes: key-range chunks, full and incremental loads, offsets and bounded backfills.

A load writes first and appends to its ledger last, so a run that dies is repeated and never skipped.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor, as_completed

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from syncproof.operators.joins import asof_join, lexicographic
from syncproof.operators.log import inject_metadata
from syncproof.operators.ranges import laid, with_running
from syncproof.scratch import cut

PLAN = "chunk_no long, lo long, hi long"


def chunk_step(span: int, est_rows: int, target_mb: int | None = None, rows: int = 50_000) -> int:
    """How wide a chunk is: a fixed number of keys, or by estimated rows where a target size is given (4096 rows a MB)."""
    if target_mb is None:
        return rows
    target = target_mb * 4096
    return span if est_rows <= target else max(1, span * target // est_rows)


def chunk_plan(df: DataFrame, key: str, step: int = 50_000, most: int = 100_000) -> DataFrame:
    """(chunk_no, lo, hi): half-open key ranges. The first is open below the least key, the last open above; no rows: one open chunk.

    Keys so sparse that ranges of `step` keys would be over `most` are cut at equal numbers of rows instead, about `step` each.
    """
    spark = df.sparkSession
    ends = df.agg(F.min(key).cast("long").alias("least"), F.max(key).cast("long").alias("most")).first()
    if ends.least is None:
        return spark.createDataFrame([(0, None, None)], PLAN)
    n = (ends.most - ends.least) // step + 1
    if n > most:
        bounds = equi_depth(df, [key], step).filter("chunk_no >= 0")
        return bounds.select("chunk_no", F.col(f"lo.`{key}`").cast("long").alias("lo"), F.col(f"hi.`{key}`").cast("long").alias("hi"))
    wide = lambda c: c.cast("decimal(20,0)")
    lo = lambda i: (wide(F.lit(ends.least)) + wide(i) * wide(F.lit(step))).cast("long")
    i = F.col("id")
    return spark.range(n + 1).select(i.alias("chunk_no"), F.when(i > 0, lo(i - 1)).alias("lo"), F.when(i == 0, F.lit(ends.least)).when(i < n, lo(F.least(i, F.lit(n - 1)))).alias("hi"))


def equi_depth(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """(chunk_no, lo, hi, n_rows): key ranges of about `rows` rows for keys of any sortable types, one or several; lo and hi are structs of the keys.

    Rows are counted by key, and the running sum over the keys in their order says in which chunk a key lies. A chunk has less than twice `rows` rows, but
    for a single key of more than `rows`, which is a chunk of its own: equal keys are never parted. The first chunk is open below, the last one above.
    Chunk -1 holds the rows of which any key is null, without bounds. The plan has one row a chunk.
    """
    named = df.select(*[F.col(f"`{k}`") for k in keys])
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(f"`{k}`").isNotNull()
    k = F.struct(*[F.col(f"`{k}`") for k in keys]).alias("k")
    counted = named.filter(whole).groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count("*").alias("_n_rows")).select(k, F.col("_n_rows").alias("n"))
    upto = with_running(laid(counted, [], ["k"]), [], F.col("n"), "upto")
    numbered = upto.select("k", "n", F.floor((F.col("upto") - F.col("n")) / rows).alias("c"), (F.col("n") > rows).alias("alone"))
    chunks = cut(numbered.groupBy("c", "alone").agg(F.min("k").alias("lo"), F.sum("n").alias("n_rows")))
    order = Window.orderBy("c", "alone")  # a key of more than `rows` ends its stretch of the running sum
    kind = chunks.schema["lo"].dataType
    bounded = chunks.select((F.row_number().over(order) - 1).cast("long").alias("chunk_no"), F.when(F.row_number().over(order) > 1, F.col("lo")).alias("lo"), F.lead("lo").over(order).alias("hi"), "n_rows")
    none = F.lit(None).cast(kind)
    nulls = named.filter(~whole).agg(F.count("*").alias("n_rows")).filter("n_rows > 0")
    return bounded.unionByName(nulls.select(F.lit(-1).cast("long").alias("chunk_no"), none.alias("lo"), none.alias("hi"), "n_rows"))


def chunk_rows(df: DataFrame, chunk: Row) -> DataFrame:
    """The rows of one chunk of equi_depth(), by predicates that reach the scan."""
    keys = list(chunk.lo.__fields__) if chunk.lo is not None else list(chunk.hi.__fields__) if chunk.hi is not None else []
    if chunk.chunk_no < 0:
        raise ValueError("rows of null keys have no bounds: filter for them")
    cols = [F.col(f"`{k}`") for k in keys]
    for bound, at_least in ((chunk.lo, True), (chunk.hi, False)):
        if bound is not None:
            df = df.filter(lexicographic(cols, [F.lit(v) for v in bound], at_least))
    for c in cols:
        df = df.filter(c.isNotNull())
    return df


def chunk_assign(df: DataFrame, plan: DataFrame, key: str) -> DataFrame:
    """(chunk_no, n_rows): rows in each chunk, chunks without any too. Rows are counted by key first and meet the chunk that begins last before them."""
    counts = df.filter(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").cast("long").alias("k")).agg(F.count("*").alias("n"))
    starts = plan.select("chunk_no", F.coalesce("lo", F.lit(-(1 << 63))).alias("start"))
    sums = asof_join(counts, starts, "k", "start").groupBy("chunk_no").agg(F.sum("n").alias("n"))
    return plan.join(sums, "chunk_no", "left").select("chunk_no", F.coalesce("n", F.lit(0)).alias("n_rows"))


def chunk_remaining(plan: DataFrame, done: DataFrame) -> DataFrame:
    return plan.join(done.select("chunk_no"), "chunk_no", "left_anti")


def chunk_runs(chunks: DataFrame, most: int) -> DataFrame:
    """(first, last, lo, hi): chunks that follow each other as one key range, cut so that no range has over `most` chunks."""
    numbered = chunks.withColumn("run", F.col("chunk_no") - F.row_number().over(Window.orderBy("chunk_no")))  # one row a chunk, 50 000 keys or more each
    edge = lambda c, by, f: F.max_by(F.col(c), F.col(by)) if f == "last" else F.min_by(F.col(c), F.col(by))
    pieces = numbered.groupBy("run", F.floor(F.col("chunk_no") / most).alias("piece"))
    return pieces.agg(F.min("chunk_no").alias("first"), F.max("chunk_no").alias("last"), edge("lo", "chunk_no", "first").alias("lo"), edge("hi", "chunk_no", "last").alias("hi")).select("first", "last", "lo", "hi")


def in_range(df: DataFrame, key: str, lo: int | None, hi: int | None) -> DataFrame:
    """Rows of lo <= key < hi; None leaves that end open. A plain filter, which reaches the scan."""
    k = F.col(f"`{key}`")
    for side in ([] if lo is None else [k >= lo]) + ([] if hi is None else [k < hi]):
        df = df.filter(side)
    return df


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The ledger at path, or an empty one if nothing was appended yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def full_load(source: DataFrame, key: str, path: str, ledger_path: str, ingested_at: Column, step: int = 50_000, keys: Sequence[str] | None = None, commits: int = 8, parallel: int = 4, target_mb: int | None = None) -> DataFrame:
    """Writes the chunks that the ledger does not hold yet to path (op `r`), in about `commits` ranges, `parallel` at a time, that are each entered
    when they are written; gives the chunks written. With target_mb a chunk's width follows from the rows there are. Rows of a null key are a range of their own.

    A range is written aside, and its files are moved to path under the numbers of its chunks. A load that dies, before, during or after that, removes
    the files of chunks that were never entered when it is run again, so no row comes twice; one that has finished reads no chunk.
    """
    spark = source.sparkSession
    plan_path, done_path = f"{ledger_path}/plan", f"{ledger_path}/done"
    plan = read_ledger(spark, plan_path, PLAN)
    if plan.isEmpty():  # the plan is kept first: chunks stay the same when the source grows
        if target_mb is not None:
            s = source.agg(F.min(key).cast("long").alias("a"), F.max(key).cast("long").alias("z"), F.count("*").alias("n")).first()
            step = chunk_step((s.z or 0) - (s.a or 0) + 1, s.n, target_mb)
        chunk_plan(source, key, step).coalesce(1).write.mode("append").parquet(plan_path)
        plan = read_ledger(spark, plan_path, PLAN)
    done = read_ledger(spark, done_path, "chunk_no long")
    left = cut(chunk_remaining(plan, done))
    entered = {r.chunk_no for r in done.collect()}  # a number for each chunk, `most` of chunk_plan() at most
    store = _Files(spark, path)
    for name in store.names("chunks"):
        if int(name.split("_")[1]) not in entered:
            store.remove(name)
    runs = [(r.first, r.last, in_range(source, key, r.lo, r.hi).filter(F.col(f"`{key}`").isNotNull())) for r in chunk_runs(left, max(1, -(-left.count() // commits))).collect()]  # a row a range
    nulls = source.filter(F.col(f"`{key}`").isNull())
    if NULLS not in entered and not nulls.isEmpty():
        runs.append((NULLS, NULLS, nulls))

    def write(run: tuple) -> tuple:
        first, last, rows = run
        inject_metadata(rows, list(keys or [key]), "r", ingested_at).write.mode("overwrite").parquet(f"{path}/_aside_{first}")
        store.take_in(f"_aside_{first}", f"chunks_{first}_{last}_")
        return first, last

    chunks = left.select("chunk_no").unionByName(spark.range(NULLS, NULLS + 1).toDF("chunk_no"))
    with ThreadPoolExecutor(max(1, parallel)) as pool:
        try:
            for f in as_completed([pool.submit(write, run) for run in runs]):
                chunks.filter(F.col("chunk_no").between(*f.result())).coalesce(1).write.mode("append").parquet(done_path)  # one writer at a time
        except BaseException:
            pool.shutdown(cancel_futures=True)
            raise
    return left


#: The number under which rows of null keys are entered.
NULLS = -1


class _Files:
    """Files of a table's folder, through Hadoop's file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.root = path
        self.fs = self.path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, start: str, under: str = "") -> list[str]:
        found = self.fs.globStatus(self.path(f"{self.root}/{under}{start}*"))
        return [f.getPath().getName() for f in found or []]

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(f"{self.root}/{name}"), True)

    def take_in(self, folder: str, prefix: str) -> None:
        for name in self.names("part-", f"{folder}/"):
            if not self.fs.rename(self.path(f"{self.root}/{folder}/{name}"), self.path(f"{self.root}/{prefix}{name}")):
                raise OSError(f"{name} could not be moved to {self.root}")
        self.remove(folder)


def load_verified(source: DataFrame, key: str, path: str, ledger_path: str, ingested_at: Column, columns: Sequence[str], **settings) -> DataFrame:
    """full_load(), then one row: rows and checksums of the source and of the re-read destination, and whether they match."""
    from syncproof.operators.digest import digest_compare, table_digest

    full_load(source, key, path, ledger_path, ingested_at, **settings)
    written = source.sparkSession.read.parquet(path)
    return digest_compare(table_digest(source, columns), table_digest(written, columns))


def max_cursor(df: DataFrame, cursor: str) -> DataFrame:
    return df.agg(F.max(f"`{cursor}`").alias("cursor"))


def incremental(df: DataFrame, cursor: str, since: object | None = None, inclusive: bool = False) -> DataFrame:
    """Rows past the cursor, all if there is none. With inclusive, rows at it as well: then drop repeated ids after reading."""
    if since is None:
        return df
    c = F.col(f"`{cursor}`")
    return df.filter(c >= F.lit(since) if inclusive else c > F.lit(since))


def incremental_load(source: DataFrame, keys: Sequence[str], cursor: str, path: str, ledger_path: str, ingested_at: Column) -> str | None:
    """Appends the rows past the ledger's cursor to path, then enters the new cursor; gives it as text (None without rows)."""
    spark = source.sparkSession
    kept = read_ledger(spark, ledger_path, "seq long, cursor string")
    last = kept.orderBy(F.desc("seq")).first()
    kind = source.schema[cursor].dataType
    rows = source if last is None else source.filter(F.col(cursor) > F.lit(last.cursor).cast(kind))
    top = rows.agg(F.max(cursor).cast("string").alias("c")).first().c
    if top is None:
        return None if last is None else last.cursor
    bounded = rows.filter(F.col(cursor) <= F.lit(top).cast(kind))  # rows that come in meanwhile wait for the next run
    inject_metadata(bounded, keys, "r", ingested_at).write.mode("append").parquet(path)
    spark.createDataFrame([(0 if last is None else last.seq + 1, top)], "seq long, cursor string").coalesce(1).write.mode("append").parquet(ledger_path)
    return top


def offset_increment(ends: DataFrame, stored: DataFrame) -> DataFrame:
    """(partition, start, next): ends (partition, first, end) met with stored (partition, offset).

    A start is the stored offset, held between first and end; partitions that vanished keep theirs.
    """
    both = ends.join(stored, "partition", "full_outer")
    start = F.greatest("first", F.least(F.coalesce("offset", "first"), "end"))
    return both.select("partition", F.when(F.col("end").isNotNull(), start).alias("start"), F.coalesce("end", "offset").alias("next"))


def backfill_range(source: DataFrame, key: str, low: object, high: object, ingested_at: Column, keys: Sequence[str] | None = None) -> DataFrame:
    """Source rows of low <= key < high as log rows of op `u`; to be appended, and verified after."""
    k = F.col(f"`{key}`")
    return inject_metadata(source.filter((k >= F.lit(low)) & (k < F.lit(high))), list(keys or [key]), "u", ingested_at)


def backfill_since(source: DataFrame, field: str, value: object, keys: Sequence[str], ingested_at: Column) -> DataFrame:
    return inject_metadata(source.filter(F.col(f"`{field}`") > F.lit(value)), keys, "u", ingested_at)


def backfill_window(source: DataFrame, ts: str, start: object, end: object, keys: Sequence[str], ingested_at: Column) -> DataFrame:
    """Rows of start <= ts < end."""
    t = F.col(f"`{ts}`")
    return inject_metadata(source.filter((t >= F.lit(start)) & (t < F.lit(end))), keys, "u", ingested_at)


def cdc_group(snapshot: DataFrame, changes: DataFrame, keys: Sequence[str], position: str, path: str, ledger_path: str, ingested_at: Column, kind: str = "op") -> int | None:
    """One run of a change-data group: the anchor is entered first, the table is copied once, then changes are replayed; gives the position reached.

    The anchor is the last position there is before the copy, so that no change between copy and replay is lost. Each run replays
    what lies past the last position entered, up to the position found at its start, and enters that when it is written. Rows
    carry `_sys_seq`, their position; a run that dies is repeated, and rows that then come twice are the same to log.current_state().
    """
    spark = changes.sparkSession
    ledger = "seq long, step string, position long"
    kept = read_ledger(spark, ledger_path, ledger).orderBy("seq").collect()  # a row or two a run

    def enter(step: str, at: int | None) -> None:
        spark.createDataFrame([(len(kept), step, at)], ledger).coalesce(1).write.mode("append").parquet(ledger_path)
        kept.append((len(kept), step, at))

    target = changes.agg(F.max(position)).first()[0]
    if not kept:
        enter("anchor", target)
    anchor = kept[0][2]
    if all(step != "snapshot" for _, step, _ in kept):
        rows = inject_metadata(snapshot, keys, "r", ingested_at).withColumn("_sys_seq", F.lit(-1 if anchor is None else anchor).cast("long"))
        rows.write.mode("append").parquet(path)
        enter("snapshot", anchor)
    reached = kept[-1][2]
    if target is None or (reached is not None and target <= reached):
        return reached
    p = F.col(f"`{position}`")
    fresh = changes.filter(p <= target) if reached is None else changes.filter((p > reached) & (p <= target))
    replayed = inject_metadata(fresh.drop(kind, position), keys, F.lit("u"), ingested_at)
    coded = inject_metadata(fresh, keys, F.col(kind), ingested_at).withColumn("_sys_seq", p.cast("long"))
    coded.select(*replayed.columns, "_sys_seq").write.mode("append").parquet(path)
    enter("replay", target)
    return target
