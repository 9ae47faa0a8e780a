"""Files in and out: text trees, JSON lines, delimited tables with schema detection, manifests, guarded writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_texts(spark: SparkSession, *roots: str, pattern: str = "*.txt") -> DataFrame:
    """(path, raw_text) of all files below the roots, whole; bytes that are not UTF-8 are replaced."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(list(roots), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw_text"))


def folder_year(path: str | Column) -> Column:
    return F.nullif(F.regexp_extract(F.col(path) if isinstance(path, str) else path, r"((?:19|20)\d{2})", 1), F.lit("")).cast("int")


def source_tag(path: str | Column, root: str) -> Column:
    """The first folder below the root, else the root's name."""
    c = F.col(path) if isinstance(path, str) else path
    below = F.split(F.regexp_replace(F.regexp_replace(c, "^[a-z]+:/*", "/"), f"^{root.rstrip('/')}/", ""), "/")
    return F.when(F.size(below) > 1, below[0]).otherwise(F.lit(root.rstrip("/").rsplit("/", 1)[-1]))


def date_from_name(path: str | Column) -> Column:
    name = F.element_at(F.split(F.col(path) if isinstance(path, str) else path, "/"), -1)
    return F.try_to_date(F.regexp_extract(name, r"^(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One object a line; blank and broken lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def find_column(df: DataFrame, names: set[str]) -> str | None:
    """The first column whose trimmed name in lower case is one of the names."""
    return next((c for c in df.columns if c.strip().lower() in names), None)


def text_column(df: DataFrame) -> str | None:
    """The string column of the largest mean length: one aggregate."""
    strings = [c for c, k in df.dtypes if k == "string"]
    if not strings:
        return None
    means = df.agg(*(F.avg(F.length(F.col(f"`{c}`"))).alias(str(i)) for i, c in enumerate(strings))).first()
    return strings[max(range(len(strings)), key=lambda i: (means[i] or 0, -i))]


def date_column(df: DataFrame, sample: int = 50, share: float = 0.8) -> str | None:
    """A column of a date type, else one named like a date, else one whose first values are mostly dates."""
    from corpusloom.functions.text import first_date

    for c, k in df.dtypes:
        if k in ("date", "timestamp", "timestamp_ntz"):
            return c
    for c in df.columns:
        if any(w in c.lower() for w in ("date", "release")):
            return c
    strings = [c for c, k in df.dtypes if k == "string"]
    if not strings:
        return None
    head = df.select(*(F.col(f"`{c}`") for c in strings)).limit(sample)
    got = head.agg(*((F.count(first_date(F.col(f"`{c}`"))) / F.greatest(F.count(F.col(f"`{c}`")), F.lit(1))).alias(str(i)) for i, c in enumerate(strings))).first()
    return next((c for i, c in enumerate(strings) if got[i] > share), None)


def read_table(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A delimited file as strings."""
    return spark.read.options(header=True, inferSchema=False, multiLine=True, escape='"', **options).csv(path)


def promote_header(rows: DataFrame, order: str, marks: tuple[str, ...] = ("sentence", "text"), within: int = 10) -> DataFrame:
    """The first row, of the first few, with one of the marks in a cell names the columns; rows up to it go."""
    cols = [c for c in rows.columns if c != order]
    head = rows.orderBy(order).limit(within).collect()
    for r in head:
        cells = [str(r[c]).strip() if r[c] is not None else "" for c in cols]
        if any(m in cell.lower() for cell in cells for m in marks):
            names = [x or f"column_{i}" for i, x in enumerate(cells)]
            return rows.where(F.col(order) > F.lit(r[order])).select(*(F.col(c).alias(n) for c, n in zip(cols, names, strict=True)))
    return rows.drop(order)


def split_manifest(df: DataFrame, ok: Column, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(manifest, missing): rows that went well, with a status, and the others with their error."""
    good = F.coalesce(ok, F.lit(False))
    return df.where(good).withColumn("status", F.lit("ok")), df.where(~good).withColumn("error", reason)


def write_once(df: DataFrame, path: str, kind: str = "parquet", **options: str) -> None:
    """Writes where nothing is yet; an existing result is never overwritten."""
    df.write.mode("errorifexists").options(**options).format(kind).save(path)


def write_sheets(sheets: dict[str, DataFrame], path: str, kind: str = "csv") -> None:
    """One folder for each sheet."""
    for name, df in sheets.items():
        write_once(df, f"{path}/{name}", kind, **({"header": "true", "compression": "gzip"} if kind == "csv" else {}))
