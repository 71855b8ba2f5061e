"""Sources: adapters, artifacts, session reads and incremental ingestion (SRC)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sheetlore.operators.filters import with_optional_columns
from sheetlore.plans.registry import query
from sheetlore.session import ensure_checkpoint_dir
from sheetlore.sources import catalogue, payloads
from sheetlore.streaming import ingest


@query(
    "src03_artifact_rows",
    "SELECT map_name, text, confidence, x1, y1, x2, y2 FROM boxes",
    ("boxes",),
)
def _(t):
    item = F.struct("text", "confidence", F.array("x1", "y1", "x2", "y2").alias("bbox"))
    objects = t.boxes.select(F.to_json(F.create_map("map_name", F.array(item))).alias("value"))
    rows = catalogue.box_columns(catalogue.artifact_rows(objects, catalogue.BOX_SCHEMA))
    return rows.drop("seq")


@query(
    "src03_manifest_tiles",
    """SELECT map_name, width, height, CAST(x AS INT) AS x, 0 AS y, CAST(x + 1024 AS INT) AS x2, 1024 AS y2 FROM map_info, unnest([0, 974]) AS a(x)""",
    ("map_info",),
)
def _(t):
    tiles = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(0).alias("y"), F.lit(x + 1024).alias("x2"), F.lit(1024).alias("y2")) for x in (0, 974)])
    info = F.struct(F.concat("map_name", F.lit(".jpg")).alias("file"), "width", "height", tiles.alias("tiles"))
    objects = t.map_info.select(F.to_json(F.create_map("map_name", info)).alias("value"))
    return catalogue.manifest_tiles(objects)


@query(
    "src04_annotations",
    """SELECT map_name, trim(substr(text, 1, 3) || substr(text, 4)) AS text,
         round(CASE WHEN l_linenumber = 3 THEN 0.85::DOUBLE WHEN l_linenumber = 4 THEN confidence ELSE (confidence + 0.9::DOUBLE) / 2 END, 4) AS confidence, x1, y1, x2, y2
       FROM boxes WHERE l_linenumber <> 5 AND CASE WHEN l_linenumber = 3 THEN 0.85::DOUBLE WHEN l_linenumber = 4 THEN confidence ELSE (confidence + 0.9::DOUBLE) / 2 END >= 0.3""",
    ("boxes",),
)
def _(t):
    def symbol(text, confidence):
        return F.struct(text.alias("text"), confidence.alias("confidence"))

    line = F.col("l_linenumber")
    first = F.when(line == 3, F.lit(0.0)).otherwise(F.col("confidence"))
    second = F.when(line.isin(3, 4), F.lit(0.0)).otherwise(F.lit(0.9))
    symbols = F.when(line == 5, F.array(symbol(F.lit(" "), F.lit(0.9)))).otherwise(
        F.array(symbol(F.substring("text", 1, 3), first), symbol(F.substr("text", F.lit(4)), second))
    )
    corners = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))])
    word = F.struct(symbols.alias("symbols"), F.struct(corners.alias("vertices")).alias("bounding_box"))
    document = F.struct(
        F.array(F.struct(F.array(F.struct(F.array(F.struct(F.array(word).alias("words"))).alias("paragraphs"))).alias("blocks"))).alias("pages")
    )
    return payloads.from_annotations(t.boxes.select("map_name", F.to_json(document).alias("payload")))


@query(
    "src05_polygons",
    "SELECT map_name, trim(text) AS text, round(confidence, 4) AS confidence, x1, y1, x2, y2 FROM boxes WHERE confidence >= 0.3",
    ("boxes",),
)
def _(t):
    points = F.array(F.array("x1", "y1"), F.array("x2", "y1"), F.array("x2", "y2"), F.array("x1", "y2"))
    return payloads.from_polygons(t.boxes.select("map_name", points.alias("points"), "text", "confidence"))


@query(
    "src06_columnar_tokens",
    """SELECT map_name, text, round(CAST(CAST(floor(confidence * 100) AS INT) AS DOUBLE) / 100.0, 4) AS confidence, x1, y1, CAST(x1 + 30 AS INT) AS x2, CAST(y1 + 12 AS INT) AS y2 FROM boxes
       WHERE CAST(floor(confidence * 100) AS INT) / 100.0::DOUBLE >= 0.3 UNION ALL SELECT map_name, 'x', 0.5, y1, x1, CAST(y1 + 5 AS INT), CAST(x1 + 6 AS INT) FROM boxes""",
    ("boxes",),
)
def _(t):
    rows = t.boxes.select(
        "map_name",
        F.array(F.col("text"), F.lit(" "), F.lit("x"), F.lit("gone")).alias("text"),
        F.array(F.floor(F.col("confidence") * 100).cast("int"), F.lit(90), F.lit(50), F.lit(-1)).alias("conf"),
        F.array("x1", "x1", "y1", "x1").alias("left"), F.array("y1", "y1", "x1", "y1").alias("top"),
        F.array(F.lit(30), F.lit(1), F.lit(5), F.lit(1)).alias("width"), F.array(F.lit(12), F.lit(1), F.lit(6), F.lit(1)).alias("height"),
    )
    return payloads.from_columns(rows)


@query(
    "src10_corrections_log",
    """SELECT id, map_name, feature_name AS old_name, NULL::BOOLEAN AS verified_correct FROM review WHERE upper(trim(verified_correct, ' ' || chr(9) || chr(13) || chr(160))) = 'N'
       UNION ALL SELECT id, NULL, NULL, true FROM review WHERE upper(trim(verified_correct, ' ' || chr(9) || chr(13) || chr(160))) = 'Y'""",
    ("review",),
)
def _(t):
    from sheetlore.operators.review import log_entries

    lines = log_entries(t.review, "2024-05-01 12:00:00").select(F.to_json(F.struct("*")).alias("value"))
    parsed = lines.select(F.from_json("value", catalogue.CORRECTION_SCHEMA).alias("entry")).select("entry.*")
    return parsed.select("id", "map_name", "old_name", "verified_correct")


@query("src11_session_read", "SELECT id, map_name, feature_name FROM features WHERE session_id = 'S4'", ("features",))
def _(t):
    return t.features.filter(F.col("session_id") == "S4").select("id", "map_name", "feature_name")


@query("src12_optional_columns", "SELECT id, feature_name, sheet_ref, CAST(NULL AS VARCHAR) AS reviewer FROM features", ("features",))
def _(t):
    return with_optional_columns(t.features, ("sheet_ref", "reviewer")).select("id", "feature_name", "sheet_ref", "reviewer")


@query(
    "src13_streaming_ingest",
    """SELECT 'MAP_' || l_suppkey AS map_name, l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey % 2 = 0 AND l_linenumber = 1
       UNION ALL SELECT 'MAP_' || l_suppkey, l_orderkey, l_linenumber FROM lineitem
         WHERE l_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_suppkey % 2 = 0 AND l_linenumber = 1)""",
)
def _(t):
    folder = f"{ensure_checkpoint_dir(t.spark)}/ingest-{uuid.uuid4().hex}"
    table, maps, checkpoint = f"{folder}/table", f"{folder}/maps", f"{folder}/checkpoint"

    def detections(df):
        return df.select(F.concat(F.lit("MAP_"), F.col("l_suppkey").cast("string")).alias("map_name"), "l_orderkey", "l_linenumber")

    ingest.seed(detections(t.lineitem.filter("l_suppkey % 2 = 0 AND l_linenumber = 1")), table, maps)
    for _ in range(2):  # the second run finds no new file and adds nothing
        ingest.ingest_files(
            t.spark, t.folder, t.lineitem.schema, table, maps, checkpoint, detections, name_filter="lineitem.parquet"
        )
    return ingest.read_table(t.spark, table).select("map_name", "l_orderkey", "l_linenumber")
