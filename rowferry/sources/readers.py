"""Lazy reads of relational tables and of CSV, JSON and Parquet files.

Every read is a plain Spark scan: column lists and filters applied later by the
caller reach the database or the file footer through Catalyst, so there is one
``read`` for both the narrow and the full-width case.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.plans.spec import Connector
from rowferry.sources.identifiers import split_identifier
from rowferry.sources.ranges import begins_with_array, csv_table, json_array_lines, large_files

# Relational systems with JDBC URL form and default port ...
JDBC_URLS = {
    "mssql": ("jdbc:sqlserver://{host}:{port};databaseName={database}", 1433),
    "postgresql": ("jdbc:postgresql://{host}:{port}/{database}", 5432),
    "supabase": ("jdbc:postgresql://{host}:{port}/{database}?sslmode=require", 5432),
    "mysql": ("jdbc:mysql://{host}:{port}/{database}", 3306),
    "oracle": ("jdbc:oracle:thin:@//{host}:{port}/{database}", 1521),
}
# ... their quotes around a name (Oracle names stay unquoted, so that its own
# case folding applies) ...
QUOTES = {
    "mssql": ("[", "]"),
    "postgresql": ('"', '"'),
    "supabase": ('"', '"'),
    "mysql": ("`", "`"),
    "oracle": ("", ""),
}
# ... and object stores with the URI of a container.
STORE_URIS = {
    "s3": "s3a://{database}",
    "azure_blob": "abfss://{database}@{username}.dfs.core.windows.net",
    "gcs": "gs://{database}",
    "file": "{database}",
}
# Preview length, default and largest length of an extract,
# seconds allowed for making a connection.
PREVIEW_ROWS = 25
EXTRACT_DEFAULT = 100
EXTRACT_MAX = 10_000
CONNECT_TIMEOUT_S = 15
#: The drivers' names of that setting, and how many of their units are a second; MySQL
#: hands rows over in steps only where it is told to use a cursor.
CONNECT_OPTIONS = {
    "mssql": {"loginTimeout": 1},
    "postgresql": {"connectTimeout": 1, "loginTimeout": 1},
    "supabase": {"connectTimeout": 1, "loginTimeout": 1},
    "mysql": {"connectTimeout": 1000},
    "oracle": {"oracle.net.CONNECT_TIMEOUT": 1000},
}
DRIVER_OPTIONS = {"mysql": {"useCursorFetch": "true"}}


def is_relational(connector: Connector) -> bool:
    return connector.type in JDBC_URLS


def require_supported(connector: Connector) -> None:
    if connector.type not in JDBC_URLS and connector.type not in STORE_URIS:
        raise ValueError(f"Connector type {connector.type} is not supported")


def quoted_table(connector: Connector, table: str) -> str:
    left, right = QUOTES[connector.type]
    return ".".join(f"{left}{p}{right}" for p in split_identifier(table))


def jdbc_options(connector: Connector, table: str | None = None, query: str | None = None,
                 **extra: str) -> dict[str, str]:
    """Options for ``format('jdbc')``; ``extra`` may add partitioning, a driver or a ``queryTimeout``.

    Connecting must succeed within 15 seconds; a statement may take as long as it needs.
    """
    url, port = JDBC_URLS[connector.type]
    options = {
        "url": url.format(host=connector.host, port=connector.port or port,
                          database=connector.database),
        "user": connector.username,
        "password": connector.password,
        "fetchsize": "10000",
        **{k: str(CONNECT_TIMEOUT_S * unit) for k, unit in CONNECT_OPTIONS[connector.type].items()},
        **DRIVER_OPTIONS.get(connector.type, {}),
    }
    if query is not None:
        options["query"] = query
    elif table is not None:
        options["dbtable"] = quoted_table(connector, table)
    options.update({k: str(v) for k, v in extra.items()})
    return options


def first_rows_query(connector: Connector, table: str, n: int) -> str:
    """A query whose row limit the database applies, for previews."""
    name = quoted_table(connector, table)
    if connector.type == "mssql":
        return f"SELECT TOP ({n}) * FROM {name}"
    if connector.type == "oracle":
        return f"SELECT * FROM {name} FETCH FIRST {n} ROWS ONLY"
    return f"SELECT * FROM {name} LIMIT {n}"


def file_uri(connector: Connector, table: str) -> str:
    """URI of a file, or of a folder of files, in a store."""
    return f"{STORE_URIS[connector.type].format(database=connector.database, username=connector.username).rstrip('/')}/{table.lstrip('/')}"


def store_options(connector: Connector) -> dict[str, str]:
    """Hadoop file system settings of an object store, as reader options."""
    if connector.type == "s3":
        options = {"fs.s3a.access.key": connector.username,
                   "fs.s3a.secret.key": connector.password}
        if connector.host:
            options |= {"fs.s3a.endpoint": connector.host, "fs.s3a.path.style.access": "true"}
        return {k: v for k, v in options.items() if v}
    if connector.type == "azure_blob" and connector.password:
        account = f"{connector.username}.dfs.core.windows.net"
        return {f"fs.azure.account.key.{account}": connector.password}
    return {}


def file_format(table: str) -> str:
    """``csv``, ``json``, ``jsonl`` or ``parquet``, from the name; JSON otherwise."""
    name = table.lower().rstrip("/")
    for suffix in ("csv", "parquet", "jsonl"):
        if name.endswith("." + suffix):
            return suffix
    return "json"


def read_csv(spark: SparkSession, path: str, quoting: str = "standard",
             options: dict[str, str] | None = None, multi_line: bool = True) -> DataFrame:
    """CSV with a header row; all columns text, cells and header trimmed.

    Quoted cells may hold line breaks. A file longer than one of Spark's ranges
    is cut into records by many tasks in two passes and staged (see
    :func:`rowferry.sources.ranges.csv_table`); shorter ones are read by a task
    each. Where no cell holds a line break, ``multi_line=False`` saves the
    passes. The files of a folder must have the same header, other ones raise.
    ``quoting='none'`` treats quotes as ordinary characters and splits at every
    comma and line break. Blank lines are skipped, absent cells are NULL,
    surplus cells dropped.
    """
    own = {k.lower() for k in options or {}} & {"sep", "delimiter", "quote", "escape", "linesep", "encoding", "charset"}
    if quoting != "none" and multi_line and not own and large_files(spark, path, options):
        return csv_table(spark, path, options)
    reader = spark.read.options(**(options or {})).options(
        header="true", inferSchema="false", ignoreLeadingWhiteSpace="true", ignoreTrailingWhiteSpace="true",
        enforceSchema="false",
    )
    if quoting == "none":
        reader = reader.option("quote", "").option("enforceSchema", "true")
    else:
        reader = reader.option("escape", '"').option("multiLine", str(multi_line).lower())
    df = reader.csv(path)
    return df.toDF(*[c.strip() for c in df.columns])


def json_layouts(spark: SparkSession, path: str, options: dict[str, str] | None = None) -> dict[str, list[str]]:
    """Files below ``path`` by layout: ``lines`` if each line that is not blank is an object, else ``document``.

    One pass over the lines, so pass the layout of large data instead.
    """
    text = F.trim(F.col("value"))
    files = (
        spark.read.options(**(options or {})).text(path).filter(text != "")
        .select(F.col("_metadata.file_path").alias("file"),
                (text.startswith("{") & text.endswith("}")).alias("whole"))
        .groupBy("file").agg(F.min("whole").alias("whole")).collect()  # one row per file
    )
    return {"lines": sorted(r.file for r in files if r.whole), "document": sorted(r.file for r in files if not r.whole)}


def _files(spark: SparkSession, path: str, options: dict[str, str] | None = None) -> list[str]:
    return [r.path for r in spark.read.format("binaryFile").options(**(options or {})).load(path).select("path").collect()]


def json_names(spark: SparkSession, path: str, options: dict[str, str] | None = None) -> list[str]:
    """Column names of a JSON table: those of its first record.

    Where a record is a line, no more than that line is read.
    """
    first = spark.read.options(**(options or {})).text(path).filter(F.trim("value") != "").limit(1).collect()
    if not first:
        return []
    try:
        record = json.loads(first[0].value.strip())
    except ValueError:
        return read_json(spark, path, options=options).columns
    if isinstance(record, list):
        record = record[0] if record else {}
    return list(record)


def read_json(spark: SparkSession, path: str, lines: bool | None = None,
              options: dict[str, str] | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """An array of objects, one object, or JSON Lines.

    ``lines`` gives the layout; ``None`` finds that of each file, so a folder may
    hold both. JSON Lines files are divided between tasks, and so are array
    files longer than one of Spark's ranges: their elements are cut out in two
    passes and staged as JSON Lines. A ``schema`` saves the pass that infers it.
    Broken records raise. A blank file has no rows and no columns.
    """
    reader = spark.read.options(**(options or {})).option("mode", "FAILFAST")
    if schema is not None:
        reader = reader.schema(schema)

    def part(where, multi_line: bool) -> DataFrame:
        return reader.option("multiLine", str(multi_line).lower()).json(where)

    if lines:
        return part(path, False)
    arrays = [f for f in large_files(spark, path, options) if begins_with_array(spark, f, options)]
    found = [part(json_array_lines(spark, arrays, options), False)] if arrays else []
    rest = [f for f in _files(spark, path, options) if f not in set(arrays)] if arrays else path
    if lines is False and rest:
        found.append(part(rest, True))
    elif rest:
        found += [part(files, layout == "document")
                  for layout, files in json_layouts(spark, rest, options).items() if files]
    if not found:
        return part(path, False)
    # Types that differ between the two layouts are brought together as in any union.
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def read(spark: SparkSession, connector: Connector, table: str,
         columns: Sequence[str] | None = None, quoting: str = "standard",
         multi_line: bool = True, lines: bool | None = None, schema: T.StructType | str | None = None,
         **options: str) -> DataFrame:
    """Scan ``table`` of ``connector``; ``columns`` narrows and orders the result.

    A requested column that a *file* lacks comes back as NULL. A database
    raises, as it does for any query naming an unknown column. ``quoting`` and
    ``multi_line`` are of CSV, ``lines`` and ``schema`` of JSON files.
    """
    require_supported(connector)
    if is_relational(connector):
        df = spark.read.format("jdbc").options(**jdbc_options(connector, table, **options)).load()
        return df.select(*columns) if columns is not None else df
    path, fmt = file_uri(connector, table), file_format(table)
    settings = {**store_options(connector), **options}
    if fmt == "csv":
        df = read_csv(spark, path, quoting, settings, multi_line)
    elif fmt in ("json", "jsonl"):
        df = read_json(spark, path, True if fmt == "jsonl" else lines, settings, schema)
    else:
        df = spark.read.options(**settings).parquet(path)
    return project(df, columns) if columns is not None else df


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns in order, NULL where ``df`` has none of that name."""
    have = set(df.columns)
    return df.select(
        *[F.col(f"`{c}`") if c in have else F.lit(None).cast("string").alias(c) for c in columns]
    )


def preview(df: DataFrame, n: int = PREVIEW_ROWS, order_by: Sequence[str] = ()) -> DataFrame:
    """The first rows; ``order_by`` makes the choice repeatable."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def extract(df: DataFrame, limit: float = EXTRACT_DEFAULT, order_by: Sequence[str] = ()) -> DataFrame:
    """A bounded extract: ``limit`` is floored and kept within 1 and 10,000."""
    return preview(df, max(1, min(EXTRACT_MAX, math.floor(limit))), order_by)


def preview_table(spark: SparkSession, connector: Connector, table: str, n: int = PREVIEW_ROWS,
                  **options: str) -> DataFrame:
    """Preview straight from a connector, the limit running in the database."""
    if is_relational(connector):
        query = first_rows_query(connector, table, n)
        return spark.read.format("jdbc").options(
            **jdbc_options(connector, query=query, **options)).load()
    return preview(read(spark, connector, table, **options), n)


# -- catalog -----------------------------------------------------------------

COLUMN_SCHEMA = "table string, ordinal int, name string, type string, nullable boolean"

# Schema that is not shown as a prefix, per system, and the system
# schemas that are not listed.
DEFAULT_SCHEMAS = {"mssql": "dbo", "postgresql": "public", "supabase": "public"}
SYSTEM_SCHEMAS = {"postgresql": ("pg_catalog", "information_schema"),
                  "supabase": ("pg_catalog", "information_schema")}


def _catalog(spark: SparkSession, connector: Connector, what: str, **options: str) -> DataFrame:
    """A catalog view of the database; filters and columns are pushed to it."""
    if connector.type == "oracle":
        view = {"tables": "user_tables", "columns": "user_tab_columns"}[what]
    else:
        view = f"information_schema.{what}"
    return spark.read.format("jdbc").options(**jdbc_options(connector, **options)).option(
        "dbtable", view).load()


def tables_in(catalog: DataFrame, connector: Connector) -> DataFrame:
    """Base tables of a catalog by schema and name, the default schema unprefixed."""
    if connector.type == "oracle":  # its catalog shows the user's own tables only
        return catalog.select(F.col("table_name").alias("name")).orderBy("name")
    base = catalog.filter(F.col("table_type") == "BASE TABLE")
    if connector.type == "mysql":
        mine = base.filter(F.col("table_schema") == connector.database)
        return mine.select(F.col("table_name").alias("name")).orderBy("name")
    hidden = SYSTEM_SCHEMAS.get(connector.type, ())
    if hidden:
        base = base.filter(~F.col("table_schema").isin(*hidden))
    plain = F.col("table_schema") == DEFAULT_SCHEMAS[connector.type]
    name = F.when(plain, F.col("table_name")).otherwise(F.concat_ws(".", "table_schema", "table_name"))
    return base.orderBy("table_schema", "table_name").select(name.alias("name"))


def columns_in(catalog: DataFrame, connector: Connector, table: str) -> DataFrame:
    """Columns of one table with the type names the database uses."""
    if connector.type == "oracle":
        name = table.split(".")[-1].upper()
        rows = catalog.filter(F.col("table_name") == name)
        place, kind, null = F.col("column_id"), F.col("data_type"), F.col("nullable") == "Y"
    else:
        if connector.type == "mysql":
            schema, name = connector.database, table
        else:
            *front, name = table.split(".")
            schema = front[0] if front else DEFAULT_SCHEMAS[connector.type]
        rows = catalog.filter((F.col("table_schema") == schema) & (F.col("table_name") == name))
        place, kind, null = F.col("ordinal_position"), F.col("data_type"), F.col("is_nullable") == "YES"
    return rows.select(
        F.lit(table).alias("table"), (place - 1).cast("int").alias("ordinal"),
        F.col("column_name").alias("name"), kind.alias("type"), null.alias("nullable"),
    ).orderBy("ordinal")


def list_tables(spark: SparkSession, connector: Connector, **options: str) -> DataFrame:
    """Names of the tables, or of the CSV, JSON and Parquet files of a store."""
    require_supported(connector)
    if is_relational(connector):
        return tables_in(_catalog(spark, connector, "tables", **options), connector)
    return list_files(spark, file_uri(connector, ""), {**store_options(connector), **options})


def table_columns(spark: SparkSession, connector: Connector, table: str, **options: str) -> DataFrame:
    """Columns of one table or file."""
    require_supported(connector)
    if is_relational(connector):
        return columns_in(_catalog(spark, connector, "columns", **options), connector, table)
    return file_columns(spark, connector, table)


def list_files(spark: SparkSession, folder: str, options: dict[str, str] | None = None) -> DataFrame:
    """``name, length`` of the data files below ``folder``; only the listing is read, no content.

    Names are relative to ``folder``, as :func:`read` takes them. A folder named
    like a data file, which holds the parts of one table, is one name.
    """
    files = (
        spark.read.format("binaryFile").options(**(options or {}))
        .option("recursiveFileLookup", "true").load(folder)
    )
    # Paths come with a scheme whether or not the folder has one: what follows the folder's own path counts.
    inner = folder.split("://", 1)[-1] if "://" in folder else folder.removeprefix("file:")
    inner = "/" + inner.strip("/") + "/"
    path = F.col("path")
    name = F.substring(path, F.locate(inner, path) + F.lit(len(inner)), F.length(path))
    table = F.regexp_extract(name, r"(?i)^(.*?\.(?:csv|json|jsonl|parquet))(?:/|$)", 1)
    return files.select(table.alias("name"), "length").filter("name <> ''").groupBy("name").agg(
        F.sum("length").alias("length")).orderBy("name")


def list_columns(frames: dict[str, DataFrame]) -> DataFrame:
    """Name, type and nullability of every column of several tables."""
    spark = next(iter(frames.values())).sparkSession
    rows = [
        (table, i, f.name, f.dataType.simpleString(), f.nullable)
        for table, df in frames.items()
        for i, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(rows, COLUMN_SCHEMA)


def file_columns(spark: SparkSession, connector: Connector, table: str) -> DataFrame:
    """Columns of a file. A file that does not exist yet has none.

    CSV columns are all text, also when there is only a header row. JSON values
    are classed as numeric, boolean or text.
    """
    empty = spark.createDataFrame([], COLUMN_SCHEMA)
    try:
        schema = read(spark, connector, table, multi_line=False).schema
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return empty
        raise
    if file_format(table) == "parquet":
        kinds = [(f.name, f.dataType.simpleString()) for f in schema.fields]
    else:
        kinds = [(f.name, _json_kind(f.dataType)) for f in schema.fields]
    rows = [(table, i, name, kind, True) for i, (name, kind) in enumerate(kinds)]
    return spark.createDataFrame(rows, COLUMN_SCHEMA) if rows else empty


def _json_kind(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return "numeric"
    return "boolean" if isinstance(dtype, T.BooleanType) else "text"
