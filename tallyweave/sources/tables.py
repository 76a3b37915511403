"""Reading and writing ledgers, manifests and reports; ad-hoc read-only SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave import schemas as S


def scan_ledger(ledger: DataFrame, vendor: str | None = None, limit: int | None = None) -> DataFrame:
    """The seven record columns, optionally of one vendor, optionally the first rows."""
    rows = ledger.select(*S.RECORD_FIELDS)
    if vendor:
        rows = rows.filter(F.col("vendor") == vendor)
    if limit is not None:
        rows = rows.orderBy("invoice_id", "invoice_date", "amount").limit(limit)
    return rows


def run_select(
    spark: SparkSession, text: str, views: dict[str, DataFrame], args: dict | None = None
) -> DataFrame:
    """Run a SELECT over the given tables; anything else is refused."""
    query = (text or "").strip()
    if not query:
        raise ValueError("a query is required")
    if not query.upper().startswith("SELECT"):
        raise ValueError("only SELECT queries are allowed")
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(query, args=args)


def read_manifest(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A manifest: JSON lines, or one JSON array per file with ``multi_line``.

    A file that holds one array cannot be split; write large manifests as
    JSON lines.
    """
    return spark.read.schema(S.MANIFEST).option("multiLine", multi_line).json(path)


def manifest_rows(manifest: DataFrame) -> DataFrame:
    """Evaluation ledger rows of a manifest."""
    record = "ledger_record"
    kinds = {f.name: f.dataType for f in S.RECORD.fields}
    return manifest.select(
        "case_id",
        "scenario",
        *[F.col(f"{record}.{n}").cast(kinds[n]).alias(n) for n in S.RECORD_FIELDS],
        F.to_json(f"{record}.line_items").alias("line_items"),
    )


def replace_table(df: DataFrame, path: str) -> None:
    """Put ``df`` in the place of whatever the table held.

    The new rows are written beside the table and take its place when they are
    complete, so a failed write changes nothing and ``df`` may read the table
    itself.  On file systems without an atomic rename, readers that start
    between the two renames find no table.
    """
    spark, mark = df.sparkSession, uuid.uuid4().hex
    target = path.rstrip("/")
    staged, former = f"{target}.new-{mark}", f"{target}.old-{mark}"
    df.write.parquet(staged)
    as_path = spark._jvm.org.apache.hadoop.fs.Path
    files = as_path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    replaced = files.exists(as_path(target))
    if replaced and not files.rename(as_path(target), as_path(former)):
        raise OSError(f"{target} cannot be replaced; the new rows are in {staged}")
    if not files.rename(as_path(staged), as_path(target)):
        if replaced:
            files.rename(as_path(former), as_path(target))
        raise OSError(f"{target} cannot be replaced; the new rows are in {staged}")
    if replaced:
        files.delete(as_path(former), True)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """Cases, manifests and reports as JSON lines."""
    df.write.mode("overwrite").json(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Report lines of whatever shape, as one VARIANT ``report`` each; ``broken`` lines are kept as they are.

    Reports of different runs differ in their fields, so no schema is laid over them;
    :func:`report_field` takes out what a reader needs.
    """
    lines = spark.read.text(path)
    report = F.try_parse_json("value")
    return lines.select(report.alias("report"), F.when(report.isNull(), F.col("value")).alias("broken"))


def report_field(names: list[str], kind: str) -> Column:
    """The first of some fields (paths such as ``$.a.b``) that a report has in readable form."""
    return F.coalesce(*[F.try_variant_get("report", n, kind) for n in names])
