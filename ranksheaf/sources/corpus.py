"""Readers of nested corpora, submissions, details, pair scores, vectors and score files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sets import as_list, parse_refs
from ..functions.text import is_valid_paragraph
from . import split_json

PARAGRAPH = T.StructType([T.StructField("para_id", T.StringType()), T.StructField("text", T.StringType())])
DOCUMENT = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("paragraphs", T.ArrayType(PARAGRAPH))])
QUERY = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("ID", "doc_id", "query", "abstractive")] + [T.StructField("refs", T.VariantType())]
)
CORPUS = T.StructType([T.StructField("docs", T.ArrayType(DOCUMENT)), T.StructField("queries", T.ArrayType(QUERY))])


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The nested corpus; refs stay a variant, since they may be a string, a list or missing."""
    return spark.read.schema(CORPUS).option("multiLine", True).json(path)


def paragraphs(corpus: DataFrame) -> DataFrame:
    """doc_id, para_id, pos (1-based, in document order), text, is_valid."""
    docs = corpus.select(F.explode("docs").alias("d"))
    rows = docs.select("d.doc_id", F.posexplode("d.paragraphs").alias("pos", "p"))
    return rows.select("doc_id", "p.para_id", (F.col("pos") + 1).alias("pos"), "p.text", is_valid_paragraph(F.col("p.text")).alias("is_valid"))


def questions(corpus: DataFrame) -> DataFrame:
    """query_id, query_ord, doc_id, query, abstractive, refs (array of strings)."""
    rows = corpus.select(F.posexplode("queries").alias("query_ord", "q"))
    return rows.select(F.col("q.ID").alias("query_id"), "query_ord", "q.doc_id", "q.query", "q.abstractive", as_list(F.col("q.refs")).alias("refs"))


def split_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """paragraphs() and questions() of a corpus file of any size, which several tasks read."""
    elements = split_json.read_elements(spark, path)
    docs = elements.where("array = 'docs'").select(F.from_json("json", DOCUMENT).alias("d"))
    rows = docs.select("d.doc_id", F.posexplode("d.paragraphs").alias("pos", "p"))
    ps = rows.select("doc_id", "p.para_id", (F.col("pos") + 1).alias("pos"), "p.text", is_valid_paragraph(F.col("p.text")).alias("is_valid"))
    asked = elements.where("array = 'queries'").select(F.col("ord").cast("int").alias("query_ord"), F.from_json("json", QUERY).alias("q"))
    return ps, asked.select(F.col("q.ID").alias("query_id"), "query_ord", "q.doc_id", "q.query", "q.abstractive", as_list(F.col("q.refs")).alias("refs"))


def read_submission(spark: SparkSession, path: str, keep_blank: bool = True) -> DataFrame:
    """query_id, answer, refs from ID, abstractive, refs; answers may hold line breaks and quotes."""
    rows = spark.read.schema("ID string, abstractive string, refs string").options(header=True, multiLine=True, escape='"').csv(path)
    return rows.select(F.col("ID").alias("query_id"), F.col("abstractive").alias("answer"), parse_refs(F.col("refs"), keep_blank).alias("refs"))


def read_detail(spark: SparkSession, path: str) -> DataFrame:
    """query_id and the three metrics per query."""
    return spark.read.schema("query_id string, rouge_l double, ss double, iou double").option("header", True).csv(path)


def read_vectors(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A vector cache: keys and one vector (array<float>) or one a token (array<array<float>>)."""
    return spark.read.schema(schema).parquet(path)


def read_pair_scores(spark: SparkSession, path: str) -> DataFrame:
    """query_id, para_id, pool_pos (order of the pool, not of the scores), score; one JSON object query -> [[id, score], ...]."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<array<string>>>").alias("m"))
    rows = raw.select(F.explode("m").alias("query_id", "pairs")).select("query_id", F.posexplode("pairs").alias("pool_pos", "p"))
    return rows.select("query_id", F.col("p")[0].alias("para_id"), "pool_pos", F.col("p")[1].cast("double").alias("score"))


def sorted_pair_scores(pairs: DataFrame, k: int | None = None) -> DataFrame:
    """Pair scores with their rank, the k best only if asked."""
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "pool_pos")))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def read_hypotheses(spark: SparkSession, path: str) -> DataFrame:
    """query_id, hypothesis from one JSON object of texts."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return raw.select(F.explode("m").alias("query_id", "hypothesis"))


def with_hypotheses(queries: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Queries with the text to embed: the hypothesis where there is one."""
    return queries.join(hypotheses, "query_id", "left").withColumn("to_embed", F.coalesce("hypothesis", "query"))


def missing_hypotheses(queries: DataFrame, hypotheses: DataFrame) -> DataFrame:
    return queries.join(hypotheses, "query_id", "left_anti")


def read_score_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Per-query details of many experiments; experiment and combination come from the path."""
    rows = spark.read.schema("query_id string, rouge_l double, ss double, iou double").option("header", True).csv(paths)
    path = F.input_file_name()
    return rows.withColumn("exp", F.regexp_extract(path, r"/(exp[^/]+)/", 1)).withColumn("combo", F.regexp_extract(path, r"/eval_result/([^/]+)/[^/]+$", 1))


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A fixed lookup table, small by definition, with a broadcast hint."""
    return F.broadcast(spark.createDataFrame(rows, schema))
