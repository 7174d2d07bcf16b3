"""CSV and JSON readers with the reference's semantics, plus key detection.

CSV: header row, comma, quoted fields may hold line breaks; values are read as
text, the pandas missing-value tokens become NULL and every column gets the
narrowest type that holds all its values (one aggregate job).
JSON: a whole-file document (array of objects or one object) or JSON Lines;
nested objects are flattened to dotted column names, arrays stay arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tablewash.functions.missing import normalize_nan
from tablewash.functions.names import c, header_names
from tablewash.operators.casts import NA_TOKENS, infer_types, na_to_null
from tablewash.session import scratch_path
from tablewash.sources.csv_records import ASCII_LIKE, HEAD, csv_records, plain_lines
from tablewash.sources.json_records import json_records, parse_records


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    encoding: str | None = None,
    infer: bool = True,
    na_tokens: Sequence[str] = NA_TOKENS,
    multiline: bool = True,
    sep: str = ",",
    ordinal_col: str | None = None,
    split: bool = True,
) -> DataFrame:
    """Read CSV as text, NULL for missing tokens, then infer types.

    ``encoding=None`` uses the census of all files (BOM / UTF-8 / Latin-1). ``multiline=True`` keeps quoted
    line breaks right; a large file is still read in many tasks (``csv_records``), unless ``split=False`` or
    its encoding writes a line break in several bytes (UTF-16, UTF-32); UTF-8 files without quotes go through Spark's own line reader.
    ``multiline=False`` takes every line for a record. With ``infer`` the text is cut and parsed once: the fields are stored as
    Parquet in the checkpoint folder, and both the inference and the result read that copy.
    A row shorter than the header is filled up with missing values, a longer one stops the job;
    empty header names become ``Unnamed: i`` and repeated ones are numbered."""
    paths = [path] if isinstance(path, str) else list(path)
    if encoding is None:
        encoding = common_encoding(spark, paths)
    reader = (
        spark.read.option("sep", sep)
        .option("encoding", encoding)
        .option("multiLine", multiline)
        .option("escape", '"')
        .option("emptyValue", "")
    )
    # the first file's header line, as data; an empty file has none
    header = reader.option("header", False).option("inferSchema", False).csv(paths).first()
    if header is None:
        raise ValueError(f"no header line in {paths}")
    names = header_names(header)
    raw = "_malformed"
    while raw in names:
        raw += "_"
    schema = StructType([StructField(n, StringType()) for n in [*names, raw]])
    place: list[str] = []
    by_split = multiline and split and encoding.upper() in ASCII_LIKE and sep.isascii()
    if by_split and encoding.upper() == "UTF-8" and plain_lines(spark, paths):
        by_split, reader = False, reader.option("multiLine", False).option("lineSep", "\n")
    if by_split:
        df, place = _split_csv(spark, paths, encoding, sep, names, raw)
    else:
        df = reader.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", raw).schema(schema).csv(paths)
    # only rows with another number of fields are kept raw; separators within quotes don't count
    bare = F.regexp_replace(F.col(raw), '"[^"]*"', "")
    fields = F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1
    too_long = F.col(raw).isNotNull() & (fields > len(names))
    # the first field is read too: Spark refuses a scan of the raw rows alone
    refused = F.raise_error(F.concat(F.lit(f"more than {len(names)} fields in row "), F.coalesce(c(names[0]), F.lit("")), F.lit(": "), F.col(raw)))
    df = df.where(F.when(too_long, refused.cast("boolean")).otherwise(True))
    if ordinal_col:
        from tablewash.operators.sequence import with_file_ordinal, with_row_ordinal

        df = with_row_ordinal(df, place, ordinal_col) if place else with_file_ordinal(df, out=ordinal_col)
    df = na_to_null(df.drop(raw, *place), names, tokens=na_tokens)
    if not infer:
        return df
    if not ordinal_col:  # numbered rows are a stored copy already
        df = _stored(spark, df)
    return infer_types(df, names)


def _stored(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back; its column names may be any."""
    path = scratch_path(spark, "csv-fields")
    plain = [f"f{i}" for i in range(len(df.columns))]
    df.toDF(*plain).write.parquet(path)
    return spark.read.schema(StructType([StructField(n, f.dataType) for n, f in zip(plain, df.schema.fields)])).parquet(path).toDF(*df.columns)


def _split_csv(spark: SparkSession, paths: Sequence[str], encoding: str, sep: str, names: Sequence[str], raw: str) -> tuple[DataFrame, list[str]]:
    """Fields (as text), ``raw`` and three place columns of all records but the files' headers."""
    records = csv_records(spark, paths, sep).where(F.col("n") != HEAD)
    text = F.col("record").cast("string") if encoding.upper() == "UTF-8" else F.decode("record", encoding)
    # plain names within the parse: a header may hold anything
    fields = ", ".join(f"f{i} string" for i in range(len(names) + 1))
    options = {"sep": sep, "escape": '"', "emptyValue": "", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": f"f{len(names)}"}
    place = []
    for name in ("_file", "_block", "_n"):
        while name in [*names, raw, *place]:
            name += "_"
        place.append(name)
    df = records.select(F.from_csv(text, fields, options).alias("f"), "file", "block", "n").select("f.*", "file", "block", "n")
    return df.toDF(*names, raw, *place), place


def common_encoding(spark: SparkSession, paths: Sequence[str]) -> str:
    """The one encoding of all files; plain ASCII files agree with UTF-8 and ISO-8859-1."""
    from tablewash.sources.census import file_census

    data = ~F.col("file_name").startswith("_") & ~F.col("file_name").startswith(".")
    found = {r["encoding"] for r in file_census(spark, list(paths)).where(data & ~F.col("ascii_only")).select("encoding").distinct().collect()}
    if len(found) > 1:
        raise ValueError(f"files of {list(paths)} differ in encoding {sorted(found)}; pass encoding=")
    return found.pop() if found else "UTF-8"


def _opens_array(spark: SparkSession, paths: Sequence[str]) -> bool:
    """Whether any file's first non-blank character opens an array (its first bytes tell)."""
    from tablewash.session import ship_package
    from tablewash.sources.census import first_characters

    ship_package(spark)
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path")
    return not listing.mapInPandas(first_characters, "path string, first string").where("first = '['").isEmpty()


def json_layout(spark: SparkSession, path: str | Sequence[str]) -> str:
    """'lines' (several values, one per line), 'document' (one value), else ValueError: every
    value of every file is accounted for before anything is read. (The contents of an array are
    accounted for as its records are cut.)"""
    paths = [path] if isinstance(path, str) else list(path)
    if _opens_array(spark, paths):
        return "document"
    lines = spark.read.text(paths).where(F.trim("value") != "")
    parsed = lines.select(F.input_file_name().alias("f"), F.try_parse_json("value").isNotNull().alias("ok"))
    per_file = parsed.groupBy("f").agg(F.count("*").alias("n"), F.count_if("ok").alias("good"))
    row = per_file.agg(F.count_if(F.expr("n > 1 and n = good")).alias("many"), F.count_if(F.expr("n > 1 and n != good")).alias("spread")).first()
    if row["many"] and not row["spread"]:
        return "lines"
    if row["many"] or (row["spread"] and not _one_value_each(spark, paths)):
        raise ValueError(f"not one JSON value per file, nor one per line: {paths}")
    return "document"


def _one_value_each(spark: SparkSession, paths: Sequence[str]) -> bool:
    records = json_records(spark, paths)
    if records is None:
        raise ValueError(f"too many files or splits to account for, pass multiline=: {paths}")
    return records.where("bad or try_parse_json(record) is null").isEmpty()


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Flatten nested structs at every depth: ``a.b.c`` columns (backquoted on
    use). Arrays are kept as they are. Leaf columns only."""

    def walk(prefix_path: list[str], dtype: StructType):
        for f in dtype.fields:
            path = prefix_path + [f.name]
            if isinstance(f.dataType, StructType) and f.dataType.fields:
                yield from walk(path, f.dataType)
            else:
                col = c(path[0])
                for p in path[1:]:
                    col = col.getField(p)
                yield col.alias(sep.join(path))

    return df.select(*list(walk([], df.schema)))


def read_json(
    spark: SparkSession,
    path: str | Sequence[str],
    multiline: bool = True,
    flatten_nested: bool = True,
    mode: str = "FAILFAST",
    schema: StructType | str | None = None,
) -> DataFrame:
    """Whole-file JSON (``multiline=True``) or JSON Lines. Broken input raises
    (FAILFAST), like the reference's default; see ``read_json_with_rejects``.

    A whole-file document is cut into its records in many tasks (``json_records``), however large it is and
    wherever its lines end."""
    paths = [path] if isinstance(path, str) else list(path)
    records = json_records(spark, paths) if multiline and mode == "FAILFAST" and hasattr(spark, "_jsparkSession") else None
    if records is not None:
        bad = records.where("bad").orderBy("file", "block", "n").first()
        if bad is not None:
            raise ValueError(f"broken JSON in {bad['file']}: {bad['record'][:200]}")
        df = normalize_nan(parse_records(spark, records.select("record"), mode, schema))
        return flatten(df) if flatten_nested else df
    reader = spark.read.option("multiLine", multiline).option("mode", mode)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.json(paths)
    df = normalize_nan(df)
    return flatten(df) if flatten_nested else df


def read_json_with_rejects(
    spark: SparkSession, path: str | Sequence[str], multiline: bool = False, corrupt_col: str = "_corrupt_record"
) -> tuple[DataFrame, DataFrame]:
    """(good rows flattened, rejected raw records ``record``).

    One record per line, or per object of the documents with ``multiline=True`` (what stands between the objects
    and doesn't belong there is a reject too). The schema is inferred once from the parseable records; then the
    raw text is parsed with ``from_json`` in PERMISSIVE mode, so a broken record never stops the
    job and both outputs come from one lazy scan."""
    paths = [path] if isinstance(path, str) else list(path)
    records = json_records(spark, paths) if multiline else None
    if records is None:
        text = spark.read.text(paths, wholetext=multiline).where(F.trim(F.col("value")) != "").select("value", F.lit(False).alias("bad"))
        inferred = spark.read.option("multiLine", multiline).option("mode", "DROPMALFORMED").json(paths).schema
    else:
        text = records.select(F.col("record").alias("value"), "bad")
        inferred = parse_records(spark, text.where("not bad").select("value"), "DROPMALFORMED").schema
    schema = StructType(inferred.fields + [StructType().add(corrupt_col, "string").fields[0]])
    parsed = text.select(
        F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt_col}).alias("r"),
        F.col("value"), F.col("bad"),
    )
    bad_flag = F.col("bad") | F.col(f"r.{corrupt_col}").isNotNull() | F.col("r").isNull()
    good = flatten(normalize_nan(parsed.where(~bad_flag).select("r.*").drop(corrupt_col)))
    bad = parsed.where(bad_flag).select(F.col("value").alias("record"))
    return good, bad


def key_candidate(df: DataFrame, column: str | None = None) -> DataFrame:
    """(column_name, n_rows, n_distinct, is_key) for the first (or given)
    column: a key when no value repeats; missing counts as a value, so two
    missing values are a repeat. count(distinct struct(col)) keeps NULL."""
    name = column or df.columns[0]
    return df.agg(
        F.lit(name).alias("column_name"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(F.struct(c(name))).alias("n_distinct"),
    ).withColumn("is_key", F.col("n_rows") == F.col("n_distinct"))


def detect_key(df: DataFrame) -> str | None:
    """Name of the first column if it can serve as a key, else None (one job)."""
    if not df.columns:
        return None
    return df.columns[0] if key_candidate(df).first()["is_key"] else None


def detect_kind(spark: SparkSession, path: str) -> tuple[str, str | None]:
    """(type, encoding) of a file, or of every data file of a folder as Spark
    writes them. Unsupported, mismatched or missing files raise; a folder must
    hold one type in one encoding."""
    from tablewash.sources.census import census_of_files, file_census, require_type

    jvm = spark.sparkContext._jvm  # noqa: SLF001
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001
    if not (fs.exists(hpath) and fs.getFileStatus(hpath).isDirectory()):
        row = census_of_files(spark, [path]).first()
        return require_type(row), row["encoding"]
    data = ~F.col("file_name").startswith("_") & ~F.col("file_name").startswith(".")
    # distinct outcomes only: a handful of rows whatever the number of files
    outcomes = file_census(spark, path).where(data).select("ext_type", "status", "encoding", "ascii_only").distinct().collect()
    if not outcomes:
        raise FileNotFoundError(f"no data files in {path}")
    for o in outcomes:
        require_type({"path": path, "status": o["status"], "ext_type": o["ext_type"]})
    kinds = {o["ext_type"] for o in outcomes}
    if len(kinds) > 1:
        raise ValueError(f"mixed file types in {path}: {sorted(kinds)}")
    encodings = {o["encoding"] for o in outcomes if not o["ascii_only"]} or {"UTF-8"}
    kind = kinds.pop()
    if kind == "csv" and len(encodings) != 1:
        raise ValueError(f"files of {path} differ in encoding {sorted(encodings)}; pass encoding=")
    return kind, encodings.pop() if len(encodings) == 1 else None


def read_any(spark: SparkSession, path: str, **options) -> DataFrame:
    """Census the file (or folder), then dispatch to the CSV / workbook / JSON reader."""
    kind, encoding = detect_kind(spark, path)
    if kind == "csv":
        return read_csv(spark, path, encoding=options.pop("encoding", encoding), **options)
    if kind == "json":
        options.setdefault("multiline", json_layout(spark, path) == "document")
        return read_json(spark, path, **options)
    from tablewash.sources.workbook import read_workbook

    return read_workbook(spark, path, **options)
