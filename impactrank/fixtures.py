"""Vectors, queries and relevance judgements derived from ordinary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.quantize import positive
from .operators.index import lists_of
from .operators.sizes import BROADCAST_ROWS, is_small


def text_impacts(df: DataFrame, id_col: str, text_col: str = "text", out_id: str = "doc_id", terms: DataFrame | None = None, block: int | None = None) -> DataFrame:
    """(id, term, weight): quantized saturating term frequencies of lower-case words.

    Texts are dealt by id before they are split: a text is smaller than its words with
    their counts, and whatever is grouped by document then needs no further exchange.
    ``terms`` leaves out other words before they are counted, which changes no weight.
    ``block`` deals texts by blocks of so many ids, and adds ``block_id``.
    """
    texts, dealt = df.select(F.col(id_col).alias(out_id), F.col(text_col).alias("_text")), [out_id]
    if block is not None:
        texts, dealt = texts.withColumn("block_id", F.expr(f"{out_id} div {block}")), ["block_id"]
    ids = list(dict.fromkeys([*dealt, out_id]))
    words = texts.repartition(*dealt).select(*ids, F.explode(F.regexp_extract_all(F.lower("_text"), F.lit("[a-z]+"), F.lit(0))).alias("term"))
    tf = lists_of(words, terms).groupBy(*ids, "term").agg(F.count("*").alias("tf"))
    return tf.select(out_id, "term", positive(F.lit(3.0) * F.col("tf") / (F.col("tf") + F.lit(1.5))).alias("weight"), *ids[:-1])


def dense_impacts(df: DataFrame, id_col: str = "vec_id", array_col: str = "embedding", out_id: str = "doc_id") -> DataFrame:
    """(id, term, weight) from the positive components of dense vectors; term is the position."""
    parts = df.select(F.col(id_col).alias(out_id), F.posexplode(array_col).alias("term", "v")).where("v > 0")
    return parts.select(out_id, "term", positive(F.least(F.lit(3.0).cast("float"), F.col("v").cast("float") * F.lit(8.0).cast("float"))).alias("weight"))


#: Words of the grams that lead from items to documents, the longest that an item has.
GRAM_WORDS = (4, 3, 2, 1)


def containment_qrels(docs: DataFrame, items: DataFrame, labels: DataFrame) -> DataFrame:
    """(query_id, doc_id, relevance): documents that hold an item's text; relevance 1 + quality.

    Documents are found by a gram of the item's inner words (its first and last may be
    parts of the document's words), up to four.  Few items go to the texts: the gram's
    longest word finds them by a hash join, then gram and text are compared in the same
    row.  Of many items, grams are joined, and texts are attached to pairs of ids
    afterwards.  Items of one or two words have no inner word and are looked for in
    every text.
    """
    words = F.split("text", "[ \n]+")
    inner = F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0)))
    q = items.select(F.col("item_id").alias("query_id"), F.col("text").alias("item"), words.alias("w")).where("item IS NOT NULL")
    q = q.select("query_id", "item", F.slice(inner, 1, GRAM_WORDS[0]).alias("inner")).withColumn("n", F.size("inner"))
    sizes = [r["n"] for r in q.select("n").distinct().collect()]  # five values at most
    d = docs.select("doc_id", F.col("text").alias("body"), words.alias("w")).where("w IS NOT NULL")

    def grams(n: int) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.concat_ws(" ", F.slice("w", i, n)))
        return F.when(F.size("w") >= n, each).otherwise(F.array().cast("array<string>"))

    long = [grams(n) for n in GRAM_WORDS if n in sizes]
    body = docs.select("doc_id", F.col("text").alias("body"))
    asked = q.where("n > 0")
    hit = None
    if long and is_small(asked, BROADCAST_ROWS):
        longest = F.array_max(F.transform("inner", lambda x, i: F.struct(F.length(x).alias("size"), x.alias("word"), i.alias("at"))))
        asked = asked.withColumn("x", longest).select("query_id", "item", "inner", "n", F.col("x.word").alias("word"), F.col("x.at").alias("at"))
        there = F.slice("w", F.greatest(F.col("pos") - F.col("at") + 1, F.lit(1)), F.col("n")) == F.col("inner")
        pairs = d.select("doc_id", "body", "w", F.posexplode("w").alias("pos", "word")).join(F.broadcast(asked), "word")
        hit = pairs.where(there & F.contains("body", "item")).select("query_id", "doc_id")
    elif long:
        have = d.select("doc_id", F.explode(F.array_distinct(F.concat(*long))).alias("gram"))
        pairs = have.join(asked.select("query_id", F.concat_ws(" ", "inner").alias("gram")), "gram").select("query_id", "doc_id").distinct()
        hit = pairs.join(q.select("query_id", "item"), "query_id").join(body, "doc_id").where(F.contains("body", "item")).select("query_id", "doc_id")
    if 0 in sizes:
        short = q.where("n = 0").groupBy().agg(F.collect_list(F.struct("query_id", "item")).alias("items"))  # items of two words at most
        found = F.explode(F.filter("items", lambda x: F.contains(F.col("body"), x["item"]))).alias("x")
        least = body.crossJoin(F.broadcast(short)).select("doc_id", found).select(F.col("x.query_id").alias("query_id"), "doc_id")  # one row on the right
        hit = least if hit is None else hit.unionByName(least)
    if hit is None:
        hit = body.where("false").select(F.lit(0).cast("long").alias("query_id"), "doc_id")
    hit = hit.distinct()
    return hit.join(labels.select("doc_id", "quality"), "doc_id", "left").select("query_id", "doc_id", (F.lit(1) + F.coalesce("quality", F.lit(0))).cast("int").alias("relevance"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def docs_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_impacts(documents(spark, sf_dir), "doc_id")


def queries_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_impacts(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", out_id="query_id")


def docs_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_impacts(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def members_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").alias("cluster_id"), F.col("vec_id").alias("doc_id"))


def qrels_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    return containment_qrels(read("documents"), read("benchmark"), read("labels"))
