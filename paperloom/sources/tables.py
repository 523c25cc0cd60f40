"""Readers for table folders, and the model tables derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SKIPPED_FOLDERS, company_form

MANIFEST = T.StructType(
    [
        T.StructField(n, T.LongType() if n == "original_size" else T.StringType())
        for n in (
            "timestamp", "original_path", "original_sha256", "original_size", "output_path",
            "output_sha256", "final_filename", "division_code", "company_name", "document_date",
        )
    ]
)

# Words of which a heading of a roster file has one.
ROSTER_HEADINGS = ("company", "name", "customer", "vendor", "account")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scan_files(spark: SparkSession, root: str, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """Files under ``root`` at any depth: path, rel_path, rel_dir, name, length, modified.

    The content column is not read.  Hidden and artifact folders are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    files = files.select("path", "length", F.col("modificationTime").alias("modified"))
    return kept_paths(files.withColumn("rel_path", F.regexp_replace("path", F.lit(r"^file:/*"), F.lit("/"))).withColumn("rel_path", F.expr(f"substring(rel_path, {len(root.rstrip('/')) + 2})")))


def kept_paths(files: DataFrame) -> DataFrame:
    """Rows whose rel_path has no hidden part and no artifact folder; adds rel_dir and name."""
    parts = F.split("rel_path", "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    hidden = F.exists(parts, lambda p: p.startswith("."))
    skipped = F.exists(folders, lambda p: F.lower(p).isin(*SKIPPED_FOLDERS))
    return files.filter(~hidden & ~skipped).withColumns({"rel_dir": F.array_join(folders, "/"), "name": F.element_at(parts, -1)})


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(MANIFEST).csv(path)


def read_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A session snapshot (one JSON document per file) under a fixed schema."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def read_roster(spark: SparkSession, path: str, existing: DataFrame | None = None) -> DataFrame:
    """Names (entry) in the first column of CSV files, in normal form, each once, without those in ``existing``.

    The first line of a file goes if it looks like a heading; the same words further down are a name.
    """
    cells = spark.read.option("encoding", "UTF-8").option("multiLine", True).csv(path, schema="entry string")
    cells = cells.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("entry", "\ufeff", "").alias("entry"))
    # A file is read by one task, so its rows have rising numbers.  One row per file.
    heads = cells.groupBy("file").agg(F.min_by("entry", "at").alias("entry"), F.min("at").alias("at"))
    heads = heads.filter(F.lower("entry").rlike("|".join(ROSTER_HEADINGS))).select("file", "at")
    names = cells.join(heads, ["file", "at"], "left_anti").filter(F.trim("entry") != "").select(company_form(F.trim("entry")).alias("entry")).distinct()
    return names if existing is None else names.join(existing.select("entry"), "entry", "left_anti")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


def read_known(spark: SparkSession, path: str, seed: str | None = None) -> DataFrame:
    """Names (entry) of a roster in JSON, as written, each once: a file with a list of texts, or a folder of such files.

    A missing ``path`` is answered by ``seed``, the list that a user starts from; nothing is read from the seed once
    ``path`` is there.  A file that holds no list gives no rows, as do null elements; empty texts stay out as well.
    """
    found = next((p for p in (path, seed) if p and _exists(spark, p)), None)
    if found is None:
        return spark.createDataFrame([], "entry string")
    lists = spark.read.option("recursiveFileLookup", True).text(found, wholetext=True)
    # A value that is no list would be taken for the only element of one.
    lists = lists.filter(F.regexp_like("value", F.lit(r"^[\s\uFEFF]*\[")))
    names = lists.select(F.explode(F.from_json(F.regexp_replace("value", "^\ufeff", ""), "array<string>")).alias("entry"))
    return names.filter(F.trim("entry") != "").distinct()


def read_hints(spark: SparkSession, path: str) -> DataFrame:
    """(kind, key, company) of a hints file: the maps ``folders`` and ``letterheads``.

    A missing file, one that is no JSON object and a missing map give no rows.
    """
    kinds = ("folders", "letterheads")
    schema = ", ".join(f"{k} map<string,string>" for k in kinds)
    hints = spark.read.option("multiLine", True).schema(schema).json(path) if _exists(spark, path) else spark.createDataFrame([], schema)
    one = lambda kind: hints.select(F.lit(kind).alias("kind"), F.explode(kind).alias("key", "company"))
    return one(kinds[0]).union(one(kinds[1]))


def text_pages(docs: DataFrame, lines: int = 10) -> DataFrame:
    """documents -> doc_id, page_idx, page_text: blocks of ``lines`` lines."""
    split = F.split("text", "\n")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(split) - 1) / lines).cast("int")), lambda i: F.struct(i.alias("page_idx"), F.array_join(F.slice(split, i * lines + 1, lines), "\n").alias("page_text")))
    return docs.select("doc_id", F.explode(blocks).alias("b")).select("doc_id", "b.page_idx", "b.page_text")


def roster(spark: SparkSession, folder: str) -> DataFrame:
    """A roster of company names from part names: entry, ord."""
    from pyspark.sql import Window as W

    names = table(spark, folder, "part").select(F.concat(F.upper("p_name"), F.lit(" INSURANCE CORPORATION")).alias("entry")).distinct()
    # The roster is small reference data; its order is its sort order.
    return names.withColumn("ord", F.row_number().over(W.orderBy("entry")))


def letters(spark: SparkSession, folder: str) -> DataFrame:
    """One-page letters composed from orders, customers and parts: doc_id, page_idx, page_text, company."""
    return composed(letter_rows(spark, folder))


def letter_rows(spark: SparkSession, folder: str) -> DataFrame:
    """What letters are composed from: doc_id, p, o_custkey, o_orderdate, o_orderpriority."""
    orders, part = table(spark, folder, "orders"), table(spark, folder, "part")
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.min("l_partkey").alias("l_partkey"))
    named = lines.join(part.select(F.col("p_partkey").alias("l_partkey"), F.upper("p_name").alias("p")), "l_partkey")
    rows = orders.join(named, orders.o_orderkey == named.doc_id).select("doc_id", "p", "o_custkey", "o_orderdate", "o_orderpriority")
    # What reads the texts is bound by the processor, so they are spread while narrow, in as many parts as the
    # session's shuffles have: without the number, or by the joins' key alone, few bytes end in one part.
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "p")


def composed(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.lit(0).alias("page_idx"), letter_text().alias("page_text"), F.concat("p", F.lit(" INSURANCE CORPORATION")).alias("company"), F.to_date("o_orderdate").alias("sent"))


def letter_text() -> Column:
    """The letter's text over columns p, doc_id, o_custkey, o_orderdate."""
    day = F.date_format("o_orderdate", "MM/dd/yyyy")
    return F.concat(
        F.col("p"), F.lit(" INSURANCE CORPORATION\nMakati City\nDear Sirs:\nCustomer "), F.col("o_custkey").cast("string"),
        F.lit(", Complainant, versus "), F.col("p"), F.lit(" INSURANCE CORPORATION, Respondent.\nSubject: claim vs. "), F.col("p"),
        F.lit(" INSURANCE COMPANY.\nDate Requested "), day, F.lit("\nVery truly yours,\n"), F.col("p"), F.lit(" INSURANCE CORPORATION\n"),
    )


LETTERS_SQL = """letters AS (
  SELECT o_orderkey AS doc_id, 0 AS page_idx, upper(p_name) AS p, upper(p_name) || ' INSURANCE CORPORATION' AS company, o_orderdate::DATE AS sent, o_custkey,
    upper(p_name) || ' INSURANCE CORPORATION' || chr(10) || 'Makati City' || chr(10) || 'Dear Sirs:' || chr(10) || 'Customer ' || o_custkey ||
    ', Complainant, versus ' || upper(p_name) || ' INSURANCE CORPORATION, Respondent.' || chr(10) || 'Subject: claim vs. ' || upper(p_name) ||
    ' INSURANCE COMPANY.' || chr(10) || 'Date Requested ' || strftime(o_orderdate, '%m/%d/%Y') || chr(10) || 'Very truly yours,' || chr(10) ||
    upper(p_name) || ' INSURANCE CORPORATION' || chr(10) AS page_text
  FROM orders JOIN (SELECT l_orderkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)"""
