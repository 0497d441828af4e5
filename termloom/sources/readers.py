"""Reading spreadsheets: format by suffix, encoding and delimiter by looking at the file's head."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.encodings import PYTHON, detect_encoding
from ..functions.text import count_text
from ..operators.cleaning import clean_cells, drop_null_columns, drop_null_rows, text_columns, trim_names
from ..plans.progress import counting
from .sheets import read_sheet

# Delimiters in order of preference, how much of a file is looked at, and limits.
DELIMITERS = [",", ";", "\t", "|", ":"]
HEAD_BYTES, HEAD_CHARS = 2048, 4096
MAX_ROWS, MAX_FILE_SIZE_MB = 10_000_000, 1000
UNSUPPORTED = "Formato de arquivo não suportado!"
#: Texts that stand for a missing value.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def file_head(spark: SparkSession, path: str, size: int) -> bytes:
    """The first bytes of a file, or of a folder's first file, through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(place).isDirectory():
        parts = [s.getPath() for s in fs.listStatus(place) if not s.getPath().getName().startswith(("_", "."))]
        place = min(parts, key=lambda p: p.toString())
    stream = fs.open(place)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream.builder().setInputStream(stream).setMaxCount(size).get()))
    finally:
        stream.close()


def detect_delimiter(sample: str) -> str:
    return max(DELIMITERS, key=lambda d: (sample.count(d), -DELIMITERS.index(d)))


def delimiter_of(sample: Column) -> Column:
    """The same as an expression over a text column."""
    scores = F.array(*[F.struct(count_text(F.substring(sample, 1, HEAD_CHARS), d).alias("n"), F.lit(-i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)])
    return F.array_max(scores)["d"]


def validate_file(spark: SparkSession, path: str, max_size_mb: float = MAX_FILE_SIZE_MB, max_rows: int | None = None) -> bool:
    """Refuses a file that is too large, or, where ``max_rows`` is given, has more rows: so many and one are read at most."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
    if size / 1024 / 1024 > max_size_mb:
        raise ValueError(f"Arquivo excede o tamanho máximo permitido de {max_size_mb} MB.")
    if max_rows is not None and load(spark, path).limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"Arquivo excede o número máximo permitido de {max_rows} linhas.")
    return True


def missing_as_null(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")) for c in text_columns(df)})


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV with a header. Without a schema, types are inferred in one more pass, dates staying text."""
    head = file_head(spark, path, 4 * HEAD_CHARS)
    encoding = detect_encoding(head[:HEAD_BYTES])
    encoding = "UTF-8" if encoding == "US-ASCII" else encoding  # what comes after the head may be more
    delimiter = detect_delimiter(head.decode(PYTHON[encoding], "replace")[:HEAD_CHARS])
    reader = spark.read.option("header", True).option("sep", delimiter).option("encoding", encoding).option("escape", '"').option("nanValue", "NaN")
    if encoding.startswith("UTF-16") or encoding.startswith("UTF-32"):
        reader = reader.option("multiLine", True)  # lines are not split by bytes
    elif encoding not in ("UTF-8", "ISO-8859-1"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # Spark reads other encodings only so
    if schema is not None:
        return missing_as_null(reader.schema(schema).csv(path))
    return missing_as_null(reader.option("inferSchema", True).option("preferDate", False).option("timestampFormat", "'none'").csv(path))


def read_excel(spark: SparkSession, path: str, legacy_nulls: bool = False) -> DataFrame:
    """The first sheet, or those of a folder's files, cleaned. Texts that stand for a missing value are null."""
    if path.lower().endswith(".xls"):
        raise ValueError(UNSUPPORTED + " (.xls)")
    return clean_sheet(missing_as_null(read_sheet(spark, path)), legacy_nulls)


def clean_sheet(df: DataFrame, legacy_nulls: bool = False) -> DataFrame:
    """Empty rows and columns dropped, names and cells cleaned, columns named data or date as timestamps, in the format
    of their first value."""
    from ..functions.dates import to_date

    out = clean_cells(trim_names(drop_null_columns(drop_null_rows(df))), legacy_nulls)
    dated = [c for c in text_columns(out) if "data" in c.lower() or "date" in c.lower()]
    first = {c: out.select(f"`{c}`").where(F.col(f"`{c}`").isNotNull() & (F.col(f"`{c}`") != "nan")).first() for c in dated}
    return out.withColumns({c: to_date(F.col(f"`{c}`"), False, first=first[c] and first[c][0]) for c in dated})


def load(spark: SparkSession, path: str, progress=None, **options) -> DataFrame:
    """By suffix: .csv, .xlsx, .parquet; anything else is refused. ``progress`` gets the number of rows from the first
    job that reads them all; none is run for it."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix == ".csv":
        out = read_csv(spark, path, **options)
    elif suffix in (".xlsx", ".xls"):
        out = read_excel(spark, path, **options)
    elif suffix == ".parquet":
        out = spark.read.parquet(path)
    else:
        raise ValueError(UNSUPPORTED)
    return counting(out, progress) if progress else out


TABLE = "array<struct<termo_base: string, variantes: string, frequencia: bigint, ids: string>>"
REPORT = f"struct<coluna: string, tipo: string, tabela: {TABLE}>"


def ingest(payload: Column) -> Column:
    """A posted report: groups whose table is a JSON text are decoded, what cannot be is null."""
    return F.from_json(payload, REPORT, {"mode": "PERMISSIVE"})


def received(payload: Column) -> Column:
    """A posted body as it is taken in: refused if it is empty (nothing, white space, an empty object or list, null,
    false, zero) or no JSON; else its report, where a table that cannot be decoded is null."""
    bare = F.trim(F.regexp_replace(payload, r"\s+", " "))
    empty = F.coalesce(bare.rlike(r'^(\{ ?\}|\[ ?\]|""|null|false|-?0+(\.0*)?|)$'), F.lit(True))
    known = F.try_parse_json(bare).isNotNull()
    return F.when(empty | ~known, F.struct(F.lit(True).alias("refused"), F.lit(None).cast(REPORT).alias("report"))).otherwise(F.struct(F.lit(False).alias("refused"), F.from_json(payload, REPORT, {"mode": "PERMISSIVE"}).alias("report")))
