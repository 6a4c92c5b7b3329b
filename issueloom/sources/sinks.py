"""Writers of the report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes that are copied at a time.
BUFFER = 1 << 16
LINE_ORDER = ["section", "rank", "repo_pos", "repo", "batch_id", "pos", "part_repo", "part"]


def in_report_order(lines: DataFrame) -> DataFrame:
    """Lines sorted by section and sort keys. A range sort, so the report may exceed one task."""
    return lines.orderBy(*[c for c in LINE_ORDER if c in lines.columns])


def write_report(lines: DataFrame, path: str, single_file: bool = False) -> None:
    """Write the report as text. Part files in name order make up the report.

    With `single_file` the sorted parts are then joined to one, `part-00000.txt`. Its bytes pass through a buffer
    of the driver, so a report of any size becomes one file.
    """
    in_report_order(lines).select("line").write.mode("overwrite").text(path)
    if single_file:
        join_parts(lines.sparkSession, path, "part-00000.txt")


def join_parts(spark: SparkSession, path: str, name: str) -> None:
    """Put the part files of a folder, in name order, into one file of it, and delete them.

    The file has another name until it is whole.
    """
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    files = folder.getFileSystem(conf)
    parts = sorted((f.getPath() for f in files.listStatus(folder)), key=lambda p: p.getName())
    parts = [p for p in parts if p.getName().startswith("part-")]
    whole = jvm.org.apache.hadoop.fs.Path(folder, f"_{name}")
    out = files.create(whole, True)
    try:
        for part in parts:
            read = files.open(part)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(read, out, BUFFER, False)
            finally:
                read.close()
    finally:
        out.close()
    for part in parts:
        files.delete(part, False)
    if not files.rename(whole, jvm.org.apache.hadoop.fs.Path(folder, name)):
        raise RuntimeError(f"{whole} is whole, but could not be renamed to {name}")


def write_parts(parts: dict[str, DataFrame], path: str) -> None:
    """Write the tables behind the report as parquet, one folder each."""
    for name, table in parts.items():
        table.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def show_report(lines: DataFrame, rows: int | None = None) -> None:
    """Dry run: print the report line by line, fetched part by part; with `rows`, its beginning only.

    A report that is cut says how many lines are left.
    """
    ordered = in_report_order(lines).select("line")
    shown = ordered if rows is None else ordered.limit(rows)
    printed = 0
    for row in shown.toLocalIterator():
        print(row["line"])
        printed += 1
    if rows is not None and printed == rows and (left := lines.count() - printed):
        print(f"({left} more lines)")
