"""Sources of samples: CSV files, text lines, uploaded tables, JSON documents, a simulated signal."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.functions import scalars
from pulsegrid.operators.windows import relative_seconds
from pulsegrid.schema import ALIASES, number
from pulsegrid.shared import materialize

#: Files whose header table is broadcast.
FILES = 100_000
#: Header spellings of the column that names a row's recording.
NAMES = {"name": ("subject", "recording", "subject name", "subject_name")}


def simulated(spark: SparkSession, n: int, hertz: float = 400.0, subject_id: int = 1) -> DataFrame:
    """The noise-free test signal: 1.2 Hz with its first harmonic and a slow drift, on both channels."""
    t = F.col("i") / F.lit(float(hertz))
    wave = lambda base, a, b, c, shift: base + a * F.sin(2 * F.pi() * 1.2 * t + shift) + b * F.sin(2 * F.pi() * 2.4 * t + shift) + c * F.sin(0.1 * t)
    rows = spark.range(n).withColumnRenamed("id", "i")
    return rows.select(F.lit(subject_id).cast("long").alias("subject_id"), (F.col("i") + 1).alias("seq"), "i", t.alias("ts"), wave(80000.0, 8000.0, 2000.0, 300.0, 0.0).alias("ir"), wave(75000.0, 7200.0, 1800.0, 250.0, 0.1).alias("red"))


def parse_lines(df: DataFrame, line: str = "value", exact: bool = True) -> DataFrame:
    """Text lines ``IR,RED`` to ir and red; malformed lines are dropped. exact: two parts, else two or more."""
    parts = F.split(F.col(line), ",")
    whole = F.size(parts) == 2 if exact else F.size(parts) >= 2
    out = df.where(whole).withColumn("ir", number(F.trim(F.get(parts, F.lit(0))))).withColumn("red", number(F.trim(F.get(parts, F.lit(1)))))
    return out.where(F.col("ir").isNotNull() & F.col("red").isNotNull())


def _with_fields(lines: DataFrame, width: int) -> DataFrame:
    """Adds _fields, the fields of the CSV line value as an array; quotes are understood, lines of fewer fields end with NULL.

    The parsed line is a column of its own: used inside the array, it would be parsed once a field."""
    parsed = F.from_csv("value", ", ".join(f"c{i} string" for i in range(width)), {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    return lines.withColumn("_parsed", parsed).withColumn("_fields", F.array(*[F.col(f"_parsed.c{i}") for i in range(width)]))


def headers(lines: DataFrame) -> DataFrame:
    """Where each file has its columns: _file, header (the line), n_fields, <canonical name>_at (NULL: not there).

    lines: _file, _block (its start in the file), _at (order in the block), value. The first line that is not blank is the header;
    of several spellings in one file the first of the contract's list counts.
    """
    first = lines.where(F.col("_block") == 0).groupBy("_file").agg(F.min_by("value", "_at").alias("header"))
    names = F.transform(F.split(F.regexp_replace("header", "[\ufeff\"]", ""), ","), lambda c: F.lower(F.trim(c)))
    named = first.select("_file", "header", names.alias("_names"))
    # array_position counts from 1 and gives 0 for what is not there
    at = lambda spellings: F.coalesce(*[F.nullif(F.array_position("_names", s), F.lit(0).cast("long")) for s in spellings])
    return named.select("_file", "header", F.size("_names").alias("n_fields"), *[(at(spellings) - 1).cast("int").alias(f"{name}_at") for name, spellings in (ALIASES | NAMES).items()])


def read_recordings(spark: SparkSession, paths: str | list[str], hertz: float = 400.0, by: str = "file") -> DataFrame:
    """CSV recordings, each file with a header spelling and order of its own. A recording is a file (named by it), by "folder" a
    folder of files, by "column" the rows that name it (``NAMES``), in one file or many.

    Two phases: every file's header becomes a row of a small table (``headers``), then each line's fields are picked by the
    places its own file names, once, and written. A file without a required column is refused by name. NaN and bad numbers are NULL.
    By file and folder a recording is known by its whole path, as it is on disk: equal names in two folders are two recordings.
    By column it is known by its name; rows without one are left out, and a line that repeats its file's header is no row.
    Rows keep their order: a file is read in blocks, rows are numbered inside their recording's part of a block and parts by their
    place in the file (then by file), so that no task sorts a whole recording.
    """
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    lines = spark.read.text(paths).select("value", path.alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    lines = lines.where(F.trim("value") != "")
    heads = materialize(headers(lines), "headers")
    required = [f"{c}_at" for c in (("ir", "red", "name") if by == "column" else ("ir", "red"))]
    facts = heads.agg(F.max("n_fields").alias("width"), F.count("*").alias("files")).first()
    if bad := [r[0] for r in heads.where(" OR ".join(f"{c} IS NULL" for c in required)).select("_file").limit(5).collect()]:
        raise ValueError(f"no {'IR, no red or no name' if by == 'column' else 'IR or no red'} column in {', '.join(bad)}")
    rows = lines.join(F.broadcast(heads) if facts.files <= FILES else heads, "_file")
    if by == "column":
        rows = rows.where(F.col("value") != F.col("header"))
    rows, field = _with_fields(rows, facts.width or 1), lambda c: F.get("_fields", F.col(f"{c}_at"))
    recording = field("name") if by == "column" else F.col("_file") if by == "file" else F.regexp_replace("_file", "/[^/]*$", "")
    rows = rows.select(recording.alias("_recording"), "_file", "_block", "_at", F.col("ts_at").isNotNull().alias("_timed"), field("ir").alias("ir"), field("red").alias("red"), field("ts").alias("_text"))
    rows = materialize(rows, "rows").where("_recording <> ''")
    part = ["_recording", "_file", "_block"]
    blocks = rows.groupBy(*part).agg(F.count("*").alias("_n"))
    # by file and folder the header is the first line of a file's first block and no row
    blocks = blocks.withColumn("_head", F.lit(0) if by == "column" else (F.col("_block") == 0).cast("int")).withColumn("_n", F.col("_n") - F.col("_head"))
    before = Window.partitionBy("_recording").orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(*part, "_head", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*part).orderBy("_at"))
    out = rows.join(starts, part).withColumn("_line", inside - F.col("_head")).where("_line > 0")
    out = materialize(out.select("_recording", (F.col("_start") + F.col("_line")).cast("long").alias("seq"), "_timed", "ir", "red", "_text"), "numbered")
    stem = F.col("_recording") if by == "column" else F.regexp_replace(F.regexp_extract("_recording", "([^/]*)$", 1), r"\.csv(\.gz)?$", "")
    out = out.withColumn("subject", scalars.subject_name(stem)).withColumn("win", scalars.window_number(stem))
    out = out.withColumn("ir", number("ir")).withColumn("red", number("red"))
    out = relative_seconds(out, "_text", "_recording", "seq", hertz)
    out = out.withColumn("ts", F.when(F.col("_timed"), F.col("ts")).otherwise((F.col("seq") - 1) / hertz))
    return out.select(F.col("_recording").alias("recording"), "subject", "win", "seq", "ts", "ir", "red").dropna(subset=["ir", "red"])


def find_keys(documents: DataFrame, document: str, names: Sequence[str]) -> DataFrame:
    """Where keys stand in JSON documents, at any depth: documents' columns, found (the lower-case name), depth, path, hit.

    The text is parsed once, to VARIANT; each round opens the objects and arrays of one level, until none is nested. A key's name inside
    a string is no key, and a text that is no JSON has none. hit is a VARIANT: a scalar, an array or an object. Names are
    matched in any casing.
    """
    wanted = [n.lower() for n in names]
    spark, own = documents.sparkSession, documents.columns
    level = materialize(documents.withColumn("_v", F.try_parse_json(document)).where("_v IS NOT NULL").withColumn("_path", F.lit("$")), "level")
    hits = []
    for depth in count():
        opened = level.alias("l").lateralJoin(spark.tvf.variant_explode(F.col("l._v").outer()).alias("e"))  # scalars give no rows
        step = F.coalesce(F.concat(F.lit("."), F.col("e.key")), F.concat(F.lit("["), F.col("e.pos").cast("string"), F.lit("]")))
        below = opened.select(*[F.col(f"l.`{c}`") for c in own], F.lower("e.key").alias("_key"), F.col("e.value").alias("_v"), F.concat("l._path", step).alias("_path"))
        level = materialize(below, "level")
        hits.append(level.where(F.col("_key").isin(wanted)).select(*[F.col(f"`{c}`") for c in own], F.col("_key").alias("found"), F.lit(depth).alias("depth"), F.col("_path").alias("path"), F.col("_v").alias("hit")))
        if not level.limit(1).count():
            return reduce(DataFrame.unionByName, hits)


def find_key(documents: DataFrame, key: str, document: str, names: Sequence[str]) -> DataFrame:
    """The hit nearest to the document's root for each key column value and name (of equally near ones the first path): key, found, hit."""
    hits = find_keys(documents.select(F.col(key).alias("_k"), F.col(document).alias("_d")), "_d", names)
    best = hits.groupBy("_k", "found").agg(F.min_by(F.to_json("hit"), F.struct("depth", "path")).alias("json"))
    return best.select(F.col("_k").alias(key), "found", F.try_parse_json("json").alias("hit"))


def scaler_parameters(documents: DataFrame, key: str, document: str) -> DataFrame:
    """The scaler's list of each document, wherever it stands: key, feature, center, scale; a scale of 0 is left out."""
    listed = find_key(documents, key, document, ["feature_scaler_parameters"])
    rows = listed.select(key, F.explode(F.variant_get("hit", "$", "array<struct<feature: string, center_median: double, scale_iqr: double>>")).alias("p"))
    return rows.select(key, "p.feature", F.col("p.center_median").alias("center"), F.col("p.scale_iqr").alias("scale")).where("scale <> 0")


def read_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Window configuration documents, with either key casing and at any depth: source file, status and sampling rate."""
    raw = spark.read.text(paths, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    return parse_documents(raw)


def parse_documents(raw: DataFrame, document: str = "value") -> DataFrame:
    """raw with source_file, status (UNKNOWN without one), hertz and hyperparameters (JSON) of its documents."""
    rows = materialize(raw.withColumn("_doc", F.monotonically_increasing_id()), "documents")
    names = ("source_file", "status", "sampling_rate_fs", "hyperparameters")
    wide = find_key(rows, "_doc", document, names).groupBy("_doc").pivot("found", list(names)).agg(F.first(F.to_json("hit")))
    text = lambda c: F.variant_get(F.try_parse_json(c), "$", "string")
    return rows.join(wide, "_doc", "left").select(
        *[F.col(f"`{c}`") for c in raw.columns], text("source_file").alias("source_file"), F.coalesce(text("status"), F.lit("UNKNOWN")).alias("status"),
        text("sampling_rate_fs").try_cast("double").alias("hertz"), "hyperparameters",
    )


def read_labels(spark: SparkSession, path: str, key: str = "ID", target: str = "Glucose level (mg/dl)") -> DataFrame:
    """Reference labels from CSV or Parquet: the key as given, its row order and the value."""
    raw = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.option("header", True).csv(path)
    if lost := [c for c in (key, target) if c not in raw.columns]:
        raise ValueError(f"missing columns: {', '.join(lost)}")
    return raw.select(F.col(key).cast("string").alias("label_key"), number(target).alias("target"), F.monotonically_increasing_id().alias("label_seq"))
