"""File census: type by extension, type by leading bytes, agreement, encoding.

A ``binaryFile`` scan lists every file under a path (recursively); the type by
extension needs only the path. The content checks read every byte of every
file, in chunks of bounded size, in the tasks (one open per file), so a file of
any size is judged whole and never held whole. Files that do not exist are
reported as rows with status ``missing`` rather than raised.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# extension -> type (fixed values)
EXTENSION_TYPES = {".csv": "csv", ".xlsx": "excel", ".xls": "excel", ".json": "json"}
UNSUPPORTED = "format not supported yet"

# byte-order marks -> encoding name accepted by Spark's CSV reader (fixed values)
BOMS = (("0000FEFF", "UTF-32BE"), ("FFFE0000", "UTF-32LE"), ("EFBBBF", "UTF-8"), ("FEFF", "UTF-16BE"), ("FFFE", "UTF-16LE"))


def extension_of(path: Column) -> Column:
    """Lower-cased suffix including the dot ('' when there is none)."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))


def type_by_extension(path: Column) -> Column:
    ext = extension_of(path)
    expr = F.lit(UNSUPPORTED)
    for e, t in reversed(list(EXTENSION_TYPES.items())):
        expr = F.when(ext == e, F.lit(t)).otherwise(expr)
    return expr


def type_by_content(head: Column) -> Column:
    """Zip magic -> excel; first byte '{' or '[' -> json; anything else -> csv."""
    head = F.hex(F.substring(head, 1, 4))
    first = F.substring(head, 1, 2)
    return (
        F.when(head == "504B0304", F.lit("excel"))
        .when(first.isin("7B", "5B"), F.lit("json"))
        .otherwise(F.lit("csv"))
    )


def encoding_of(head: Column, valid: Column) -> Column:
    """Byte-order mark if present, else UTF-8 when all bytes are valid UTF-8,
    else ISO-8859-1 (every byte sequence is valid Latin-1)."""
    marks = F.hex(F.substring(head, 1, 4))
    expr = F.when(valid, F.lit("UTF-8")).otherwise(F.lit("ISO-8859-1"))
    for bom, name in reversed(BOMS):
        expr = F.when(marks.startswith(bom), F.lit(name)).otherwise(expr)
    return expr


CHUNK_BYTES = 1 << 20


def arrow_uri(path: str) -> str:
    if path.startswith("file:/") and not path.startswith("file:///"):
        return "file://" + path[len("file:"):]
    for scheme in ("s3a://", "s3n://"):
        if path.startswith(scheme):
            return "s3://" + path[len(scheme):]
    return path


def _read_files(batches):
    """First bytes of each file, whether all its bytes are UTF-8, whether all are ASCII."""
    import codecs

    import pandas as pd
    from pyarrow import fs

    for b in batches:
        rows = []
        for path in b["path"]:
            filesystem, inner = fs.FileSystem.from_uri(arrow_uri(path))
            head, valid, ascii_only = b"", True, True
            decoder = codecs.getincrementaldecoder("utf-8")()
            with filesystem.open_input_stream(inner, compression=None) as f:
                while chunk := f.read(CHUNK_BYTES):
                    head = (head + chunk[:4])[:4]
                    ascii_only = ascii_only and chunk.isascii()
                    if valid:
                        try:
                            decoder.decode(chunk)
                        except UnicodeDecodeError:
                            valid = False
            if valid:
                try:
                    decoder.decode(b"", final=True)
                except UnicodeDecodeError:
                    valid = False
            rows.append((path, head, valid, ascii_only))
        yield pd.DataFrame(rows, columns=["path", "head", "valid", "ascii_only"])


def first_characters(batches):
    """The first non-blank byte of each file, as text (NULL in a blank file)."""
    import pandas as pd
    from pyarrow import fs

    for b in batches:
        rows = []
        for path in b["path"]:
            filesystem, inner = fs.FileSystem.from_uri(arrow_uri(path))
            first, marked = None, True
            with filesystem.open_input_stream(inner, compression=None) as f:
                while first is None and (chunk := f.read(CHUNK_BYTES)):
                    chunk = (chunk.removeprefix(b"\xef\xbb\xbf") if marked else chunk).strip()
                    first, marked = (chr(chunk[0]) if chunk else None), False
            rows.append((path, first))
        yield pd.DataFrame(rows, columns=["path", "first"])


def file_census(spark: SparkSession, path: str | Sequence[str], with_content: bool = True) -> DataFrame:
    """(path, file_name, extension, ext_type, size, content_type, encoding, ascii_only, status).

    status: ok | unsupported | mismatch | missing. ``ascii_only`` files read
    alike in UTF-8 and ISO-8859-1."""
    from tablewash.session import ship_package

    paths = [path] if isinstance(path, str) else list(path)
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "length")
    cols = [
        F.col("path"),
        F.regexp_extract("path", r"([^/]*)$", 1).alias("file_name"),
        extension_of(F.col("path")).alias("extension"),
        type_by_extension(F.col("path")).alias("ext_type"),
        F.col("length").alias("size"),
    ]
    if with_content:
        ship_package(spark)
        kinds = "path string, length long, head binary, valid boolean, ascii_only boolean"

        def run(batches):
            for b in batches:
                found = next(_read_files([b]))
                yield b.assign(head=found["head"], valid=found["valid"], ascii_only=found["ascii_only"])

        listing = listing.mapInPandas(run, kinds)
        cols += [type_by_content(F.col("head")).alias("content_type"), encoding_of(F.col("head"), F.col("valid")).alias("encoding"), F.col("ascii_only")]
    else:
        cols += [F.lit(None).cast("string").alias("content_type"), F.lit(None).cast("string").alias("encoding"), F.lit(None).cast("boolean").alias("ascii_only")]
    df = listing.select(*cols)
    status = (
        F.when(F.col("ext_type") == UNSUPPORTED, F.lit("unsupported"))
        .when(F.col("content_type").isNotNull() & (F.col("ext_type") != F.col("content_type")), F.lit("mismatch"))
        .otherwise(F.lit("ok"))
    )
    return df.withColumn("status", status)


def census_of_files(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """Census for an explicit list of files; absent files appear with status
    'missing' (one row each) instead of failing the job."""
    from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

    files = list(files)
    jvm_fs = spark.sparkContext._jvm.org.apache.hadoop.fs  # noqa: SLF001
    conf = spark.sparkContext._jsc.hadoopConfiguration()  # noqa: SLF001
    present, absent = [], []
    for f in files:
        p = jvm_fs.Path(f)
        fs = p.getFileSystem(conf)
        (present if fs.exists(p) and fs.getFileStatus(p).isFile() else absent).append(f)
    schema = StructType(
        [StructField(n, t) for n, t in (("path", StringType()), ("file_name", StringType()), ("extension", StringType()),
                                        ("ext_type", StringType()), ("size", LongType()), ("content_type", StringType()),
                                        ("encoding", StringType()), ("ascii_only", BooleanType()), ("status", StringType()))]
    )
    miss = spark.createDataFrame([(f, f.rsplit("/", 1)[-1], None, None, None, None, None, None, "missing") for f in absent], schema)
    if not present:
        return miss
    found = file_census(spark, present)
    return found.unionByName(miss.withColumns({
        "extension": extension_of(F.col("path")), "ext_type": type_by_extension(F.col("path")),
    }))


def require_type(census_row) -> str:
    """Strict check of one census row, as the reference's reader does."""
    st = census_row["status"]
    if st == "missing":
        raise FileNotFoundError(f"no such file: {census_row['path']}")
    if st == "unsupported":
        raise ValueError(f"no reader for this file type: {census_row['path']}")
    if st == "mismatch":
        raise ValueError(f"name and content are of different types: {census_row['path']}")
    return census_row["ext_type"]
