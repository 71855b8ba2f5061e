"""A feature table stored by session, changed in place: only folders of touched sessions are written anew.

A change reads the touched sessions, writes them to a staging folder named by the operation, a folder per
session, and then moves these folders over the table's. An operation that comes again after a failure is
not worked out twice: what is staged is put in place again, what is done is left alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheetlore.operators import merging
from sheetlore.session import cut_lineage, is_small, listed, shuffles_removed, small_side

SESSION = "session_id"
#: A list of maps up to this size is broadcast, so rows stay in the task that reads them; with a longer one they are shuffled.
LISTED_MAPS = 500_000
LISTED_BYTES = 32 * 1024 * 1024


class FeatureStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def create(self, features: DataFrame) -> FeatureStore:
        # Spark cuts a large session into as many tasks as its size asks for, and joins small ones
        with shuffles_removed(self.spark):
            self._write(features.hint("rebalance", SESSION), self._table)
        features.limit(0).write.mode("overwrite").parquet(f"{self.path}/columns")
        return self

    @property
    def _table(self) -> str:
        return f"{self.path}/table"

    def _write(self, rows: DataFrame, path: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(SESSION).parquet(path)

    def _by_session(self, rows: DataFrame) -> DataFrame:
        """Rows in ranges of session and id: rows of an id are in one task, and a session is in as many as its size asks for."""
        return rows.repartitionByRange(SESSION, "id")

    def read(self) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.path}/columns").schema
        return self.spark.read.schema(schema).parquet(self._table).select(*schema.names)

    def _change(self, operation: str, touched: Callable[[DataFrame], DataFrame], change: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Put changed rows in place of all rows of the touched sessions.

        ``touched`` gives rows with these sessions and any column besides. ``change`` gets all rows of
        these sessions and what ``touched`` gave; it leaves rows of a session in few tasks.
        """
        home = f"{self.path}/operations/{operation}"
        state = {name for name, _, _ in listed(self.spark, home)}
        if "done" in state:
            return
        rows = self.read()
        if "ready" not in state:
            with shuffles_removed(self.spark):
                hit = touched(rows)
                self._write(hit, f"{home}/touched")
                hit = self.spark.read.schema(hit.schema).parquet(f"{home}/touched")
                sessions = small_side(hit.select(F.col(SESSION).alias("_session")).distinct())
                self._write(change(rows.join(sessions, F.col(SESSION).eqNullSafe(F.col("_session")), "left_semi"), hit), f"{home}/rows")
            self._mark(home, "ready")
        staged = self._folders(f"{home}/rows")
        if "cleared" not in state:  # sessions left without rows; once folders are moved these can't be told from others
            for name in self._folders(f"{home}/touched") - staged:
                self._delete(f"{self._table}/{name}")
            self._mark(home, "cleared")
        for name in sorted(staged):
            self._delete(f"{self._table}/{name}")
            self._move(f"{home}/rows/{name}", f"{self._table}/{name}")
        self._mark(home, "done")
        self._delete(f"{home}/touched")

    def _mark(self, home: str, state: str) -> None:
        self.read().limit(0).write.mode("overwrite").parquet(f"{home}/{state}")

    def _folders(self, path: str) -> set[str]:
        return {name for name, _, _ in listed(self.spark, path) if name.startswith(f"{SESSION}=")}

    def _delete(self, path: str) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def _move(self, path: str, to: str) -> None:
        old, new = (self.spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, to))
        if not old.getFileSystem(self.spark._jsc.hadoopConfiguration()).rename(old, new):
            raise OSError(f"{path} could not be moved to {to}")

    def apply_verdicts(self, operation: str, review: DataFrame, mark_verified: bool = False, order: str = "row_no") -> None:
        """As ``merging.apply_verdicts``, in the sessions that hold a reviewed feature.

        Decisions get the session of their feature from ids alone; then whole rows and decisions are
        shuffled together, once, and leave the tasks as they are to lie in the table.
        """

        def decided(rows: DataFrame) -> DataFrame:
            return self._by_session(rows.select(SESSION, "id").join(merging.decisions(review, order), "id"))

        def change(rows: DataFrame, decided: DataFrame) -> DataFrame:
            both = rows.withColumn("_row", F.lit(True)).unionByName(decided, allowMissingColumns=True)
            own = Window.partitionBy(SESSION, "id")
            joined = self._by_session(both).withColumns({c: F.max(c).over(own) for c in ("fix", "confirmed")}).filter("_row")
            return merging.with_decisions(joined, mark_verified).select(*rows.columns)

        self._change(operation, decided, change)

    def _change_maps(self, operation: str, maps: DataFrame, name: str, change: Callable[[DataFrame, DataFrame], DataFrame], session_id: str | None = None) -> None:
        """Change the sessions, or the one given, that have a map listed in the column ``name`` of ``maps``."""
        small = is_small(maps, LISTED_MAPS, LISTED_BYTES)
        maps = F.broadcast(maps) if small else maps

        def touched(rows: DataFrame) -> DataFrame:
            hit = rows.join(maps.select(F.col(name).alias("map_name")), "map_name", "left_semi")
            return (hit if session_id is None else hit.filter(F.col(SESSION) == session_id)).groupBy(SESSION).count()

        self._change(operation, touched, lambda rows, _: change(rows, maps) if small else self._by_session(change(rows, maps)))

    def rename_maps(self, operation: str, renames: DataFrame) -> None:
        self._change_maps(operation, cut_lineage(renames.select("old_name", "new_name")), "old_name", merging.rename_maps)

    def delete_maps(self, operation: str, doomed: DataFrame, session_id: str | None = None) -> DataFrame:
        """Delete maps, in one session or everywhere; returns how many rows each lost (map_name, deleted)."""
        home = f"{self.path}/operations/{operation}"
        doomed = cut_lineage(doomed.select("map_name"))
        if not listed(self.spark, f"{home}/counts/_SUCCESS"):
            rows = self.read() if session_id is None else self.read().filter(F.col(SESSION) == session_id)
            merging.deletion_counts(rows, doomed).write.mode("overwrite").parquet(f"{home}/counts")
        self._change_maps(operation, doomed, "map_name", lambda rows, maps: merging.delete_maps(rows, maps, session_id).select(*rows.columns), session_id)
        return self.spark.read.parquet(f"{home}/counts")

    def patch_column(self, operation: str, map_pattern: str, column: str, value) -> None:
        self._change(
            operation,
            lambda rows: rows.filter(F.col("map_name").ilike(map_pattern)).groupBy(SESSION).count(),
            lambda rows, _: merging.patch_column(rows, map_pattern, column, value),
        )


# --- by place ------------------------------------------------------------------------------------

#: Rows that one folder of a table by place holds, and that one task sorts by place.
ROWS_PER_FOLDER = 1_000_000
ROWS_PER_TASK = 1_000_000
#: Boxes kept of a folder, at most: its range jumps, and a box over a jump holds much that the folder does not.
BOXES = 16
_SIDES = ("lat_min", "lat_max", "lon_min", "lon_max")


def place_code(latitude, longitude):
    """Place on a curve that keeps neighbours together: the bits of both coordinates, 16 each, by turns."""

    def spread_bits(value, low: float, high: float):
        scaled = F.floor((F.least(F.greatest(value, F.lit(low)), F.lit(high)) - low) / (high - low) * 65_535).cast("long")
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            scaled = scaled.bitwiseOR(F.shiftleft(scaled, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return scaled

    return F.shiftleft(spread_bits(latitude, -90.0, 90.0), 1).bitwiseOR(spread_bits(longitude, -180.0, 180.0))


class PlaceTable:
    """Features in folders that are ranges of places, with the boxes that parts of each folder's range fill."""

    def __init__(self, spark: SparkSession, path: str, per_folder: int = ROWS_PER_FOLDER):
        self.spark, self.path, self.per_folder = spark, path, per_folder

    def create(self, features: DataFrame) -> PlaceTable:
        code = place_code((F.col("lat_min") + F.col("lat_max")) / 2, (F.col("lon_min") + F.col("lon_max")) / 2)
        # tasks have ranges of places and cut them into folders as they write, so small folders are not as many tasks
        tasks = max(1, -(-features.count() // max(ROWS_PER_TASK, self.per_folder)))
        ranged = features.withColumn("_place", code).repartitionByRange(tasks, "_place", "id").sortWithinPartitions("_place", "id")
        row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        folder = F.shiftleft(F.spark_partition_id().cast("long"), 33) + F.floor(row / self.per_folder)
        ranged.withColumn("_folder", folder).drop("_place").write.mode("overwrite").partitionBy("_folder").parquet(f"{self.path}/table")
        stored = self.spark.read.parquet(f"{self.path}/table")
        box = F.struct(F.min("lat_min").alias("lat_min"), F.max("lat_max").alias("lat_max"), F.min("lon_min").alias("lon_min"), F.max("lon_max").alias("lon_max"))
        placed = stored.select("_folder", *_SIDES, code.alias("_place"))
        ends = placed.groupBy("_folder").agg(F.min("_place").alias("_low"), F.max("_place").alias("_high"))
        part = F.floor((F.col("_place") - F.col("_low")) * BOXES / (F.col("_high") - F.col("_low") + 1))
        boxes = placed.join(ends, "_folder").groupBy("_folder", part.alias("part")).agg(box.alias("box"))
        boxes.groupBy("_folder").agg(F.collect_list("box").alias("boxes")).write.mode("overwrite").parquet(f"{self.path}/boxes")
        return self

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/table").drop("_folder")

    def near(self, lat_min: float, lat_max: float, lon_min: float, lon_max: float) -> DataFrame:
        """Rows of the folders one of whose boxes meets the given one; others have no row there, nor rows without a place."""
        box = dict(zip(_SIDES, (lat_min, lat_max, lon_min, lon_max), strict=True))

        def meets(own):
            return (own["lat_min"] <= box["lat_max"]) & (own["lat_max"] >= box["lat_min"]) & (own["lon_min"] <= box["lon_max"]) & (own["lon_max"] >= box["lon_min"])

        boxes = self.spark.read.parquet(f"{self.path}/boxes").filter(F.exists("boxes", meets))
        folders = sorted(r["_folder"] for r in boxes.select("_folder").collect())  # one number per folder
        return self.spark.read.parquet(f"{self.path}/table").filter(F.col("_folder").isin(folders)).drop("_folder")
