"""Text lines of a sheet and the survey year printed on it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetlore.functions.texts import stripped
from sheetlore.operators.numbering import number_rows
from sheetlore.session import cut_lineage, ship_package

# Year notation, context words and their points.
CONTEXT = 30
YEAR = r"(?<![0-9])([0-9]{4}(?:[-–][0-9]{2,4})?)(?![0-9])"
# The cheap test for four digits comes first; only then is the context before them captured.
YEAR_WITH_CONTEXT = rf"(?s)(?=[0-9]{{4}})(?<![0-9])(?<=(^.{{0,29}}|.{{30}})){YEAR}(?=(.{{0,30}}))"
FIRST_YEAR, LAST_YEAR, LONGEST_SPAN = 1500, 2100, 20
STRONG = 8
CONTEXT_POINTS = (
    (r"\b(surv(?:ey(?:ed)?)?|season)\b", 12),
    (r"\b(revis(?:ed)?|publish(?:ed)?|edition|compiled|drawn|sketch(?:ed)?|prepared)\b", 10),
    (r"\b(date|dated|year|a\.?d\.?)\b", 8),
    (r"\b(map|plate|plan|copy|title|sheet)\b", 4),
    (
        r"\b(scale|miles?|yards?|feet|foot|kilomet(?:er|re)s?|metres?|contours?|elevation|latitude|longitude"
        r"|north|south|east|west|grid|legend)\b",
        -8,
    ),
)
RANGE_POINTS, EDGE_POINTS, EDGE = 2, 3, 0.20
LINE_TOLERANCE = 0.8
#: Tokens of a piece of a map that one task folds in turn; longer pieces are folded in chunks of so many.
CHUNK = 4096

_LINE_SCHEMA = "map_name string, segment bigint, line_no bigint, text string, cy double, avg_h double, n bigint"


def _fold_lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Join sorted tokens into lines, holding only the current line in memory."""
    key, line_no, cy, avg_h, items = None, 0, 0.0, 0.0, []

    def finished():
        words = [text for _, text in sorted(items, key=lambda item: item[0])]
        return (*key, line_no, " ".join(words), cy, avg_h, len(items))

    for frame in frames:
        rows = []
        for map_name, segment, text, x, y, h in zip(
            frame["map_name"], frame["segment"], frame["text"], frame["x1"], frame["cy"], frame["h"]
        ):
            same = key == (map_name, segment)
            if same and abs(y - cy) <= max(avg_h, h) * LINE_TOLERANCE:
                items.append((x, text))
                n = len(items)
                cy, avg_h = (cy * (n - 1) + y) / n, (avg_h * (n - 1) + h) / n
                continue
            if key is not None:
                rows.append(finished())
            line_no = line_no + 1 if same else 0
            key, cy, avg_h, items = (map_name, segment), y, h, [(x, text)]
        yield pd.DataFrame(rows, columns=["map_name", "segment", "line_no", "text", "cy", "avg_h", "n"])
    if key is not None:
        yield pd.DataFrame([finished()], columns=["map_name", "segment", "line_no", "text", "cy", "avg_h", "n"])


def fold_breaks(cy: list[float], h: list[float], state: tuple[float, float, int] | None) -> tuple[list[bool], tuple[float, float, int]]:
    """Where new lines begin among sorted tokens, from the state (middle, height, tokens) of the line before, and the state at the end."""
    breaks = []
    mean, height, n = state or (0.0, 0.0, 0)
    for y, own in zip(cy, h, strict=True):
        if n and abs(y - mean) <= max(height, own) * LINE_TOLERANCE:
            n += 1
            mean, height = (mean * (n - 1) + y) / n, (height * (n - 1) + own) / n
            breaks.append(False)
        else:
            mean, height, n = y, own, 1
            breaks.append(True)
    return breaks, (mean, height, n)


def _chunks(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Runs of rows with equal keys in a sorted stream."""
    rest = None
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        if not len(frame):
            continue
        new = (frame[keys] != frame[keys].shift()).any(axis=1).to_numpy().nonzero()[0].tolist()
        for begin, end in zip(new[:-1], new[1:], strict=True):
            part = frame.iloc[begin:end]
            yield tuple(part.iloc[0][keys]), part
        rest = frame.iloc[new[-1] :]
    if rest is not None and len(rest):
        yield tuple(rest.iloc[0][keys]), rest


_CHUNK_KEYS = ["map_name", "segment", "chunk"]
_STATE_SCHEMA = "map_name string, segment bigint, chunk bigint, mean double, height double, n bigint, n_breaks bigint"


def _start_of(part: pd.DataFrame) -> tuple[float, float, int] | None:
    first = part.iloc[0]
    return None if pd.isna(first["s_mean"]) else (float(first["s_mean"]), float(first["s_height"]), int(first["s_n"]))


def _end_states(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The state at the end of each chunk, from the state it starts with (none: a new line)."""
    rows = []
    for key, part in _chunks(frames, _CHUNK_KEYS):
        breaks, (mean, height, n) = fold_breaks(part["cy"].tolist(), part["h"].tolist(), _start_of(part))
        rows.append((*key, mean, height, n, sum(breaks)))
    yield pd.DataFrame(rows, columns=[*_CHUNK_KEYS, "mean", "height", "n", "n_breaks"])


def _numbered_lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tokens of chunks with the number of their line, from the states the chunks start with."""
    for _, part in _chunks(frames, _CHUNK_KEYS):
        breaks, _ = fold_breaks(part["cy"].tolist(), part["h"].tolist(), _start_of(part))
        lines = part["lines_before"].iloc[0] + pd.Series(breaks).cumsum() - 1
        yield part.assign(line_no=lines.to_numpy())[["map_name", "segment", "line_no", "text", "x1", "row_no", "cy", "h"]]


def _fold_in_chunks(placed: DataFrame) -> DataFrame:
    """Lines of long pieces: chunks are folded at once and joined where their states meet.

    Each chunk is first folded as if a line began with it. Then it starts from the end of the chunk
    before; where both folds begin a line at the same token, they agree from there on. Only chunks
    whose start turns out to be another one than assumed are folded again, until none is: a second
    round is needed only behind a chunk without a common beginning of a line.
    """
    numbered = number_rows(placed, ["map_name", "segment"], F.col("cy"), ["cy", "x1", "_order"])
    tokens = cut_lineage(numbered.withColumn("chunk", F.floor((F.col("row_no") - 1) / CHUNK)))

    def folded(starts: DataFrame, columns: list[str], run, schema: str) -> DataFrame:
        joined = tokens.join(starts, _CHUNK_KEYS)
        dealt = joined.repartition(*_CHUNK_KEYS).sortWithinPartitions(*_CHUNK_KEYS, "row_no")
        return dealt.select(*_CHUNK_KEYS, "text", "x1", "row_no", "cy", "h", *columns).mapInPandas(run, schema)

    begins = ["s_mean", "s_height", "s_n"]
    none = [F.lit(None).cast(kind).alias(c) for c, kind in zip(begins, ("double", "double", "bigint"), strict=True)]
    chunks = tokens.select(*_CHUNK_KEYS).distinct()
    starts = cut_lineage(chunks.select("*", *none))
    ends = cut_lineage(folded(starts, begins, _end_states, _STATE_SCHEMA))
    while True:
        follows = ends.select("map_name", "segment", (F.col("chunk") + 1).alias("chunk"), F.col("mean").alias("s_mean"), F.col("height").alias("s_height"), F.col("n").alias("s_n"))
        now = cut_lineage(chunks.join(follows, _CHUNK_KEYS, "left"))
        old = starts.select(*_CHUNK_KEYS, *[F.col(c).alias(f"o_{c}") for c in begins])
        other = [~F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in begins]
        moved = cut_lineage(now.join(old, _CHUNK_KEYS).filter(other[0] | other[1] | other[2]).select(*_CHUNK_KEYS, *begins))
        if moved.isEmpty():
            break
        again = folded(moved, begins, _end_states, _STATE_SCHEMA)
        ends = cut_lineage(ends.join(moved, _CHUNK_KEYS, "left_anti").unionByName(again))
        starts = now
    along = Window.partitionBy("map_name", "segment").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(*_CHUNK_KEYS, F.coalesce(F.sum("n_breaks").over(along), F.lit(0)).alias("lines_before"))
    schema = "map_name string, segment bigint, line_no bigint, text string, x1 long, row_no long, cy double, h double"
    numbered = folded(starts.join(before, _CHUNK_KEYS), [*begins, "lines_before"], _numbered_lines, schema)
    words = F.array_sort(F.collect_list(F.struct("x1", "row_no", "text")))
    return numbered.groupBy("map_name", "segment", "line_no").agg(
        F.array_join(F.transform(words, lambda w: w["text"]), " ").alias("text"), F.avg("cy").alias("cy"), F.avg("h").alias("avg_h"), F.count("*").alias("n")
    )


def group_lines(tokens: DataFrame, order: str = "token_no") -> DataFrame:
    """Text lines of each map, top to bottom.

    A token joins the current line while its middle stays near the line's running mean,
    which makes the work sequential inside a map. Where two neighbouring heights lie further
    apart than any token could bridge, a new line is certain, so maps are first cut there
    and the pieces are folded independently, each as a sorted stream of rows; a piece of more
    than CHUNK tokens is folded in chunks.
    """
    items = (
        tokens.withColumn("text", stripped("text")).filter(F.col("text") != "")
        .select(
            "map_name", "text", "x1", ((F.col("y1") + F.col("y2")) / 2).alias("cy"),
            F.greatest(F.col("y2") - F.col("y1"), F.lit(1)).cast("double").alias("h"), F.col(order).alias("_order"),
        )
    )
    # Heights are half pixels: per map there are at most twice as many as the picture is high.
    heights = items.groupBy("map_name", "cy").agg(F.max("h").alias("h"), F.count("*").alias("tokens"))
    along = Window.partitionBy("map_name").orderBy("cy")
    tallest = F.max("h").over(Window.partitionBy("map_name"))
    cut = F.when(F.col("cy") - F.lag("cy").over(along) > F.col("tallest") * LINE_TOLERANCE, 1).otherwise(0)
    cuts = heights.withColumn("tallest", tallest).withColumn("cut", cut).select("map_name", "cy", "tokens", F.sum("cut").over(along).alias("segment"))
    held = F.sum("tokens").over(Window.partitionBy("map_name", "segment"))
    segments = cut_lineage(cuts.select("map_name", "cy", "segment", (held > CHUNK).alias("long")))
    ship_package(tokens.sparkSession)
    placed = items.join(segments, ["map_name", "cy"])
    ordered = placed.filter("NOT long").repartition("map_name", "segment").sortWithinPartitions("map_name", "segment", "cy", "x1", "_order")
    lines = ordered.select("map_name", "segment", "text", "x1", "cy", "h").mapInPandas(_fold_lines, _LINE_SCHEMA)
    if segments.filter("long").isEmpty():
        return lines
    return lines.unionByName(_fold_in_chunks(placed.filter("long").drop("long")).select(*lines.columns))


def line_texts(tokens: DataFrame, order: str = "token_no") -> DataFrame:
    """Text and middle of lines whose number is already known."""
    words = F.array_sort(F.collect_list(F.struct("x1", F.col(order).alias("o"), "text")))
    return tokens.groupBy("map_name", "line_no").agg(
        F.array_join(F.transform(words, lambda w: w["text"]), " ").alias("text"),
        (F.sum(F.col("y1") + F.col("y2")) / 2 / F.count("*")).alias("cy"),
    )


def _year_of(text: Column) -> Column:
    start = F.substring(text, 1, 4).try_cast("int")
    tail = F.substring(text, 6, 4)
    end = F.when(F.length(tail) == 4, tail).otherwise(F.concat(F.substring(text, 1, 2), tail)).try_cast("int")
    # From start >= FIRST_YEAR and end <= LAST_YEAR the two other limits follow.
    span = (start >= FIRST_YEAR) & end.between(start, F.least(start + LONGEST_SPAN, F.lit(LAST_YEAR)))
    return (
        F.when(F.length(text) == 4, F.when(start.between(FIRST_YEAR, LAST_YEAR), text).otherwise(""))
        .when(span, F.concat(F.substring(text, 1, 4), F.lit("-"), F.substring(end.cast("string"), 3, 2)))
        .otherwise("")
    )


def normalised_year(raw: Column) -> Column:
    """``yyyy`` or ``yyyy-yy``; '' for years out of range or spans of more than 20 years."""
    text = F.regexp_replace(F.regexp_replace(stripped(raw), "[.,;:]+$", ""), "–", "-")
    year = F.regexp_extract(text, r"^([0-9]{4}(?:-[0-9]{2,4})?)$", 1)
    return F.coalesce(F.when(year != "", _year_of(year)), F.lit(""))


def year_candidates(lines: DataFrame) -> DataFrame:
    """Every year of every line with up to 30 characters of context on both sides."""
    pattern = F.lit(YEAR_WITH_CONTEXT)
    found = F.arrays_zip(
        F.regexp_extract_all("text", pattern, F.lit(1)).alias("before"),
        F.regexp_extract_all("text", pattern, F.lit(2)).alias("raw"),
        F.regexp_extract_all("text", pattern, F.lit(3)).alias("after"),
    )
    keep = [c for c in lines.columns if c != "text"]
    hits = lines.filter(F.col("text").rlike("[0-9]{4}")).select(*keep, F.posexplode(found).alias("pos", "hit"))
    return hits.select(
        *keep, "pos", _year_of(F.replace("hit.raw", F.lit("–"), F.lit("-"))).alias("year"), F.concat("hit.before", "hit.raw", "hit.after").alias("context")
    ).filter(F.col("year") != "")


def with_year_score(candidates: DataFrame, height: Column) -> DataFrame:
    """Add ``score`` and ``edge`` (line in the top or bottom fifth of the sheet)."""
    context = F.lower("context")
    edge = (F.col("cy") <= height * EDGE) | (F.col("cy") >= height * (1 - EDGE))
    score = F.lit(0)
    for pattern, points in CONTEXT_POINTS:
        score = score + F.when(context.rlike("(?U)" + pattern), points).otherwise(0)
    score = score + F.when(F.col("year").contains("-"), RANGE_POINTS).otherwise(0)
    score = score + F.when(edge, EDGE_POINTS).otherwise(0)
    return candidates.withColumns({"score": score, "edge": edge})


def best_year(scored: DataFrame, line_order: tuple[str, ...] = ("cy", "line_no", "pos")) -> DataFrame:
    """Best candidate per map: any strong one before any at the edges, then by score."""
    eligible = scored.filter((F.col("score") >= STRONG) | F.col("edge"))
    rank = F.struct(
        F.when(F.col("score") >= STRONG, 0).otherwise(1).alias("weak"), (-F.col("score")).alias("s"),
        F.when(F.col("year").contains("-"), 0).otherwise(1).alias("single"), F.when(F.col("edge"), 0).otherwise(1).alias("inner"),
        *[F.col(c) for c in line_order], "year",
    )
    return eligible.groupBy("map_name").agg(F.min(rank).alias("best")).select("map_name", F.col("best.year").alias("survey_year"))


def survey_years(tokens: DataFrame, maps: DataFrame, order: str = "token_no") -> DataFrame:
    """Survey year of every map in ``maps``, '' where none is printed."""
    sized = group_lines(tokens, order).join(maps.select("map_name", "height"), "map_name")
    scored = with_year_score(year_candidates(sized), F.col("height"))
    best = best_year(scored, ("cy", "segment", "line_no", "pos"))
    return maps.select("map_name").join(best, "map_name", "left").select("map_name", F.coalesce("survey_year", F.lit("")).alias("survey_year"))
