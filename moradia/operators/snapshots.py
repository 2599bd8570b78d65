"""What changed between full snapshots (problem 6).

The state between two snapshots is an index of hashes kept on disk in buckets: for each advert two hashes of its source
and address, the hash of its watched values and the key of its row. A new snapshot is brought into the same buckets and
probes them, so the index is never shuffled; only rows that differ come out, and the probed result is written into the
buckets of the next index (the swap). Old values are fetched afterwards, for changed rows alone. Sources that a snapshot
leaves out keep their entries until they deliver again.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moradia.functions.pages import with_page_key
from moradia.session import scratch_path, written

WATCHED = ("disponivel", "preco", "status")
ENTRY = "fonte_id string, k1 bigint, k2 bigint, linha_id bigint, h bigint, linha_antes bigint, mudanca string"
#: Most snapshots whose numbers are collected at once.
MOST_SNAPSHOTS = 10_000
CHANGES = "snapshot_no int, linha_id bigint, mudanca string, linha_antes bigint"


def content_hash(cols: tuple[str, ...]) -> Column:
    """Hash of the watched values; null differs from every value and equals null."""
    return F.xxhash64(*[x for c in cols for x in (F.col(c).isNull(), F.col(c))])


def counting_rows(snapshots: DataFrame, watched: tuple[str, ...] = WATCHED) -> DataFrame:
    """One slim row for each advert, source and snapshot: hashes of the key (128 bits) and of the watched values, and ``linha_id``.

    Of several rows of an advert the one captured last counts, then the one with the largest ``linha_id``. This is an
    aggregate with map-side combine. Rows without an address, source or snapshot number are left out.
    """
    given = snapshots.filter("snapshot_no is not null and fonte_id is not null").select("snapshot_no", "fonte_id", "url_anuncio", "linha_id", "capturado_em", *watched)
    rows = with_page_key(given, "_pagina").select(
        F.col("snapshot_no").cast("int").alias("snapshot_no"), "fonte_id", F.xxhash64("fonte_id", "_pagina").alias("k1"), F.xxhash64(F.lit("k2"), "_pagina", "fonte_id").alias("k2"),
        content_hash(watched).alias("h"), F.col("linha_id").cast("bigint").alias("linha_id"), "capturado_em",
    )
    last = F.max(F.struct("capturado_em", "linha_id", "h")).alias("m")
    return rows.groupBy("snapshot_no", "fonte_id", "k1", "k2").agg(last).select("snapshot_no", "fonte_id", "k1", "k2", "m.linha_id", "m.h")


def probe(index: DataFrame, new: DataFrame) -> DataFrame:
    """The next index, with what ``new`` changed against ``index`` marked in ``mudanca``.

    ``index`` and ``new`` hold ``fonte_id, k1, k2, linha_id, h``. An advert of a source that delivered is ``adicionado``,
    ``alterado``, ``removido`` or unmarked; a source's first snapshot marks nothing; entries of other sources pass unmarked.
    """
    delivered = new.select("fonte_id").distinct().withColumn("_veio", F.lit(True))
    known = index.select("fonte_id").distinct().withColumn("_havia", F.lit(True))
    old = index.select("k1", "k2", F.col("fonte_id").alias("_f"), F.col("linha_id").alias("_l"), F.col("h").alias("_h"))
    met = new.join(old, ["k1", "k2"], "full_outer").withColumn("fonte_id", F.coalesce("fonte_id", "_f"))
    met = met.join(delivered, "fonte_id", "left").join(known, "fonte_id", "left")
    mark = (
        F.when(F.col("_l").isNull(), F.when(F.col("_havia"), "adicionado"))
        .when(F.col("linha_id").isNull(), F.when(F.col("_veio"), "removido"))
        .when(F.col("h") != F.col("_h"), "alterado")
    )
    return met.select("fonte_id", "k1", "k2", F.coalesce("linha_id", "_l").alias("linha_id"), F.coalesce("h", "_h").alias("h"), F.col("_l").alias("linha_antes"), mark.alias("mudanca"))


class SnapshotIndex:
    """The index of the last snapshot: a table in ``baldes`` buckets by key under a path of the shared folder.

    ``SnapshotIndex(spark)`` is empty; with ``path`` the index that an earlier run left there is opened. ``apply`` probes it with a
    snapshot, writes the next index beside it and swaps; the one before stays until ``forget``, as changes are read from it.
    """

    def __init__(self, spark: SparkSession, baldes: int | None = None, path: str | None = None) -> None:
        self.spark, self.path = spark, path
        self.baldes = baldes or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _read(self, path: str) -> DataFrame:
        """The buckets at ``path``, registered so that the planner knows them."""
        name = f"indice_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({ENTRY}) USING parquet CLUSTERED BY (k1, k2) SORTED BY (k1, k2) INTO {self.baldes} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def rows(self) -> DataFrame:
        """The entries: adverts that the last snapshot of their source held."""
        if self.path is None:
            return self.spark.createDataFrame([], ENTRY)
        return self._read(self.path).filter("mudanca is null or mudanca <> 'removido'")

    def apply(self, new: DataFrame) -> DataFrame:
        """What ``new`` (``fonte_id, k1, k2, linha_id, h``) changed: ``linha_id, mudanca, linha_antes``; the index is then that of ``new``."""
        name, path = f"indice_{uuid.uuid4().hex}", scratch_path(self.spark, "indice")
        placed = new.repartition(self.baldes, "k1", "k2")
        state = probe(self.rows(), placed) if self.path else probe(self.rows(), new).repartition(self.baldes, "k1", "k2")
        state.write.bucketBy(self.baldes, "k1", "k2").sortBy("k1", "k2").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
        self.path = path
        return self.spark.read.schema(ENTRY).parquet(path).filter("mudanca is not null").select("linha_id", "mudanca", "linha_antes")


def snapshot_changes(snapshots: DataFrame, watched: tuple[str, ...] = WATCHED) -> DataFrame:
    """``snapshot_no, linha_id, mudanca, linha_antes`` over all snapshots, each source against the last one it delivered.

    ``linha_id`` is the counting row of the later snapshot, for ``removido`` of the earlier one. Empty input gives no
    rows. Repeated rows count once. Columns beyond those named are not read. The numbers of the snapshots come to the
    driver one by one.
    """
    spark = snapshots.sparkSession
    path = scratch_path(spark, "snapshot-rows")
    slim = counting_rows(snapshots, watched)
    slim.withColumn("parte", F.col("snapshot_no")).write.partitionBy("parte").option("compression", "zstd").parquet(path)
    rows = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in slim.schema)}, parte int").parquet(path)
    index, found = SnapshotIndex(spark), []
    for (n,) in rows.select("parte").distinct().orderBy("parte").toLocalIterator():
        changed = index.apply(rows.filter(F.col("parte") == n).select("fonte_id", "k1", "k2", "linha_id", "h"))
        found.append(changed.select(F.lit(n).cast("int").alias("snapshot_no"), "linha_id", "mudanca", "linha_antes"))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], CHANGES)


def with_old_values(changes: DataFrame, snapshots: DataFrame, watched: tuple[str, ...] = WATCHED) -> DataFrame:
    """``changes`` with the values of the watched fields before and after (``<field>_antes``, ``<field>_depois``).

    Values are fetched by row key for the changed rows alone, in one pass over the table; an added advert has none before,
    a removed one none after. Row keys that stand more than once give the values of one of their rows.
    """
    sides = [F.struct(F.lit("depois").alias("lado"), F.when(F.col("mudanca") != "removido", F.col("linha_id")).alias("linha")), F.struct(F.lit("antes").alias("lado"), F.when(F.col("mudanca") == "removido", F.col("linha_id")).when(F.col("mudanca") == "alterado", F.col("linha_antes")).alias("linha"))]
    key = ["snapshot_no", "linha_id", "mudanca"]
    wanted = written(changes.select(*key, "linha_antes"), "mudancas").select(*key, F.explode(F.array(*sides)).alias("s")).select(*key, "s.*").filter("linha is not null")
    values = snapshots.select(F.col("linha_id").cast("bigint").alias("linha"), F.struct(*watched).alias("v"))
    got = wanted.join(values, "linha")
    return got.groupBy(*key).agg(*(F.max(F.when(F.col("lado") == s, F.col("v")))[c].alias(f"{c}_{s}") for s in ("antes", "depois") for c in watched))
