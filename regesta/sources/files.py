"""Tables from and to text files: CSV, JSON lines, annotated XML; several outputs and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN = "_id string, _start int, _end int, _element string, _class string, text string"
DOCUMENT = f"_id string, metadata struct<year: string, dossier_id: string, source: string>, text string, spans struct<span: array<struct<{SPAN}, span: array<struct<{SPAN}>>>>>, relations struct<role: array<struct<_role: string, _ref: string>>>"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, fields quoted, lines within fields."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def read_json_lines(spark: SparkSession, path: str, schema: str, key: str | None = None, order: str | None = None) -> DataFrame:
    """JSON lines, compressed or not; with key one row a key, the first by order."""
    rows = spark.read.schema(schema).json(path)
    if key is None:
        return rows
    return rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Annotated XML, a row a document: id, year, dossier, source, text, spans, roles. Broken documents are left out and
    the rest of the file is read."""
    docs = spark.read.schema(DOCUMENT + ", broken string").format("xml").options(rowTag="document", mode="PERMISSIVE", columnNameOfCorruptRecord="broken").load(path)
    docs = docs.where("_id is not null and broken is null")
    return docs.select(F.col("_id").alias("id"), F.col("metadata.year").try_cast("int").alias("year"), F.col("metadata.dossier_id").alias("dossier"), F.col("metadata.source").alias("source"), "text", F.col("spans.span").alias("spans"), F.col("relations.role").alias("roles"))


def own_spans(docs: DataFrame) -> DataFrame:
    """id, span_id, owner, element, class, text of all spans, outer and inner: owner is the span that holds an inner one."""
    outer = docs.select("id", F.explode("spans").alias("s"))
    inner = outer.select("id", F.col("s._id").alias("owner"), F.explode("s.span").alias("s"))
    shown = lambda df, owner: df.select("id", F.col("s._id").alias("span_id"), owner.alias("owner"), F.col("s._element").alias("element"), F.col("s._class").alias("class"), F.col("s.text").alias("text"))
    return shown(outer, F.lit(None).cast("string")).unionByName(shown(inner, F.col("owner")))


def person_rows(docs: DataFrame) -> DataFrame:
    """id, year, dossier, span_id, name, roles (ordered, without repeats) of the references to persons with a name of
    their own; names of nested references aren't theirs. All from the row of a document, which is parsed once."""
    people = docs.select("id", "year", "dossier", "roles", F.explode("spans").alias("s")).where("s._class = 'per' and s._element = 'reference' and s._id is not null")
    heads = F.filter("s.span", lambda x: x["_element"] == "head")
    first = F.array_min(F.transform(F.filter(heads, lambda x: x["_id"].isNotNull()), lambda x: F.struct(x["_id"].alias("at"), x["text"].alias("text"))))
    mine = F.filter("roles", lambda r: r["_ref"] == F.col("s._id"))
    roles = F.array_distinct(F.transform(mine, lambda r: r["_role"]))
    named = people.where(F.coalesce(F.size(heads), F.lit(0)) > 0)
    return named.select("id", "year", "dossier", F.col("s._id").alias("span_id"), first["text"].alias("name"), F.array_join(F.coalesce(roles, F.array().cast("array<string>")), "|").alias("roles"))


def write_outputs(path: str, **frames: DataFrame) -> None:
    """Each frame as CSV in a folder of its name."""
    for name, df in frames.items():
        df.write.mode("overwrite").csv(f"{path}/{name}", header=True, escape='"')


def write_with_preview(df: DataFrame, path: str, rows: int = 200) -> None:
    """Parquet, and the first rows as CSV beside it."""
    df.write.mode("overwrite").parquet(f"{path}/table")
    df.sparkSession.read.parquet(f"{path}/table").limit(rows).write.mode("overwrite").csv(f"{path}/preview", header=True)
