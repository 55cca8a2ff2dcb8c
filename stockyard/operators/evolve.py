"""Schema creation and evolution (E1-E5) for parquet warehouse tables.

Adding a nullable column is a catalog change; dropping a column or changing a
type rewrites the table (parquet files are immutable): read, transform, write
to a new location, then point the table at it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockyard.schemas import TABLES, ddl


def create_tables(spark: SparkSession, root: str, names: list[str] | None = None,
                  limits: bool = True) -> list[str]:
    """CREATE TABLE ... USING parquet for the warehouse tables under ``root``.

    With ``limits`` the declared varchar(n) lengths are enforced on insert.
    """
    made = []
    for name in names or list(TABLES):
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}` ({ddl(name, limits)}) "
                  f"USING parquet LOCATION '{root.rstrip('/')}/{name}'")
        made.append(name)
    return made


def add_column(df: DataFrame, name: str, dtype: T.DataType) -> DataFrame:
    """New nullable column, NULL in existing rows."""
    return df.withColumn(name, F.lit(None).cast(dtype))


def drop_column(df: DataFrame, name: str) -> DataFrame:
    """E3."""
    return df.drop(name)


def change_decimal(df: DataFrame, name: str, precision: int, scale: int) -> DataFrame:
    """Re-type a decimal column. Narrowing that overflows raises (ANSI cast)."""
    return df.withColumn(name, F.col(name).cast(T.DecimalType(precision, scale)))


def narrowed(df: DataFrame, name: str, precision: int, scale: int) -> DataFrame:
    """E5 as a migration that must not lose a value: ``change_decimal`` if every value fits the narrower type;
    if one does not, the downgrade is refused and the column stays as it was."""
    lost = F.col(name).isNotNull() & F.col(name).try_cast(T.DecimalType(precision, scale)).isNull()
    return change_decimal(df, name, precision, scale) if df.where(lost).isEmpty() else df


def alter_add_column(spark: SparkSession, table: str, name: str, sql_type: str) -> None:
    """E2 on a catalog table (metadata only)."""
    spark.sql(f"ALTER TABLE `{table}` ADD COLUMNS (`{name}` {sql_type})")


def schema_downgrade(spark: SparkSession, table: str, name: str, precision: int, scale: int,
                     new_location: str) -> DataFrame:
    """E5 on a catalog table: back to a narrower decimal. A value that does not fit
    raises, and the table stays as it was."""
    return rewrite_table(spark, table, new_location, lambda df: change_decimal(df, name, precision, scale))


def rewrite_table(spark: SparkSession, table: str, new_location: str, transform) -> DataFrame:
    """E3-E5 on a catalog table: write ``transform(table)`` to a new location, declare a
    new table over it, then swap the names.

    Columns whose type the transform keeps also keep their declared limits
    (varchar(n)), and NOT NULL where the catalog records it. The old table goes last, so a failure at any
    point leaves a complete table under the name; the old files stay until the caller
    removes them.
    """
    old = spark.table(table)
    declared = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE `{table}`").collect()}
    fixed = {c.name for c in spark.catalog.listColumns(table) if not c.nullable}
    df = transform(old)
    df.write.mode("error").parquet(new_location)
    kept = {f.name: f.dataType for f in old.schema.fields}
    cols = ", ".join(
        f"`{f.name}` {declared[f.name] if kept.get(f.name) == f.dataType else f.dataType.simpleString()}"
        f"{' NOT NULL' if f.name in fixed else ''}" for f in df.schema.fields)
    spark.sql(f"CREATE TABLE `{table}__new` ({cols}) USING parquet LOCATION '{new_location}'")
    spark.sql(f"ALTER TABLE `{table}` RENAME TO `{table}__old`")
    spark.sql(f"ALTER TABLE `{table}__new` RENAME TO `{table}`")
    spark.sql(f"DROP TABLE `{table}__old`")
    return spark.table(table)
