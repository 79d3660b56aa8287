"""Text formats: judgements, id lists, result matrices, runs, query tokens, JSON lines, latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, value): lines numbered from 0, files in order of their paths.

    Lines are counted by file and split; a split's first number is the sum before it.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    splits = lines.groupBy("_f", "_b").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))  # one row per split
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("_f", "_b", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    return lines.join(splits, ["_f", "_b"]).select((F.col("_m") + F.col("_shift")).alias("ordinal"), "value")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Four fields by tab, else by white space; shorter lines are ignored; the last of repeated pairs holds."""
    lines = read_lines(spark, path)
    tab = F.split("value", "\t")
    part = F.when(F.size(tab) >= 4, tab).otherwise(F.split(F.trim("value"), r"\s+"))
    rows = lines.select("ordinal", part.alias("p")).where(F.size("p") >= 4).select("ordinal", F.col("p")[0].alias("query_id"), F.col("p")[1].alias("iter"), F.col("p")[2].alias("doc_id"), F.col("p")[3].cast("int").alias("relevance"))
    return rows.groupBy("query_id", "doc_id").agg(F.max_by(F.struct("iter", "relevance"), "ordinal").alias("l")).select("query_id", "l.iter", "doc_id", "l.relevance")


def write_qrels(qrels: DataFrame, path: str) -> None:
    qrels.select(F.concat_ws("\t", "query_id", "iter", "doc_id", F.col("relevance").cast("string"))).write.text(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(query_ord, rank, doc_id) from lines of comma-separated document numbers."""
    return read_lines(spark, path).select(F.col("ordinal").alias("query_ord"), F.posexplode(F.split("value", r"\s*,\s*")).alias("pos", "d")).select("query_ord", (F.col("pos") + 1).alias("rank"), F.col("d").cast("double").cast("long").alias("doc_id"))


def result_lines(ranked: DataFrame, query: str = "query_id") -> DataFrame:
    """One line per query: its documents in rank order, comma-separated."""
    held = ranked.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("r"))
    return held.select(query, F.array_join(F.transform("r", lambda x: x["doc_id"].cast("string")), ",").alias("value"))


def write_results(ranked: DataFrame, path: str, query: str = "query_id") -> None:
    result_lines(ranked, query).orderBy(query).select("value").write.text(path)


def trec_lines(ranked: DataFrame, tag: str = "run", digits: int = 4) -> DataFrame:
    """(query_id, rank, line) in the six-column run format."""
    return ranked.select("query_id", "rank", F.format_string(f"%s Q0 %s %d %.{digits}f %s", F.col("query_id").cast("string"), F.col("doc_id").cast("string"), F.col("rank").cast("int"), F.col("score").cast("double"), F.lit(tag)).alias("line"))


def write_trec(ranked: DataFrame, path: str, tag: str = "run", digits: int = 4) -> None:
    trec_lines(ranked, tag, digits).orderBy("query_id", "rank").select("line").write.text(path)


def read_trec(spark: SparkSession, path: str) -> DataFrame:
    p = F.split("value", r"\s+")
    return spark.read.text(path).select(p.alias("p")).where(F.size("p") >= 6).select(F.col("p")[0].alias("query_id"), F.col("p")[2].alias("doc_id"), F.col("p")[3].cast("int").alias("rank"), F.col("p")[4].cast("double").alias("score"), F.col("p")[5].alias("tag"))


def parse_pisa(lines: DataFrame, value: str = "value") -> DataFrame:
    """(query_id, token, weight) from ``id: tok tok``; a token's weight is its number of occurrences."""
    cut = F.instr(value, ":")
    rows = lines.where(cut > 0).select(F.trim(F.expr(f"substring({value}, 1, instr({value}, ':') - 1)")).alias("query_id"), F.explode(F.split(F.trim(F.expr(f"substring({value}, instr({value}, ':') + 1)")), r"\s+")).alias("token"))
    return rows.where("token <> ''").groupBy("query_id", "token").agg(F.count("*").cast("double").alias("weight"))


def read_pisa(spark: SparkSession, path: str) -> DataFrame:
    return parse_pisa(spark.read.text(path))


def jsonl_lines(vectors: DataFrame, id_col: str, token_col: str = "term", digits: int = 6) -> DataFrame:
    """(id, line): ``{"id": ..., "vector": {token: weight}}``, tokens in order, weights above 0."""
    entry = F.struct(F.col(token_col).cast("string").alias("t"), F.round(F.col("weight").cast("double"), digits).alias("w"))
    held = vectors.where("weight > 0").groupBy(id_col).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return held.select(id_col, F.to_json(F.struct(F.col(id_col).cast("string").alias("id"), F.map_from_entries("e").alias("vector"))).alias("line"))


def write_jsonl(vectors: DataFrame, path: str, id_col: str = "doc_id", token_col: str = "term") -> None:
    jsonl_lines(vectors, id_col, token_col).select("line").write.text(path)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(id, token, weight)."""
    return spark.read.schema("id STRING, vector MAP<STRING, DOUBLE>").json(path).select("id", F.explode("vector").alias("token", "weight"))


def convert(vectors: DataFrame, vocabulary: DataFrame, ids: DataFrame, alpha: float | None = None, max_ratio: float | None = None, list_ratio: float | None = None) -> DataFrame:
    """(id, token, weight) from numbered vectors: list pruning, then ratio, then mass; then names.

    ``vocabulary`` and ``ids`` are (ordinal, value); terms beyond the vocabulary and
    weights of 0 or less go.  The vocabulary joins by hash, broadcast by size.
    """
    from ..operators.prune import mass_inclusive, plain_ratio

    out = plain_ratio(plain_ratio(vectors, "term", list_ratio), "doc_id", max_ratio)
    if alpha is not None:
        out = mass_inclusive(out, "doc_id", "term", alpha, guard=False)
    named = out.where("weight > 0").join(vocabulary.select(F.col("ordinal").alias("term"), F.col("value").alias("token")), "term")
    return named.join(ids.select(F.col("ordinal").alias("doc_id"), F.col("value").alias("id")), "doc_id").select("id", "token", F.round(F.col("weight").cast("double"), 6).alias("weight"))


def conversion_stats(original: DataFrame, pruned: DataFrame) -> DataFrame:
    """Removed postings, their per cent, and terms a document after pruning."""
    a, b = original.agg(F.count("*").alias("n")), pruned.agg(F.count("*").alias("m"), F.countDistinct("doc_id").alias("d"))
    return a.crossJoin(b).select((F.col("n") - F.col("m")).alias("removed"), F.round((F.col("n") - F.col("m")) * 100 / F.col("n"), 4).alias("removed_percent"), F.round(F.col("m") / F.col("d"), 4).alias("terms_per_doc"))


def write_latencies(df: DataFrame, path: str) -> None:
    """(query_idx, latency_ms) as CSV with a header."""
    df.select("query_idx", "latency_ms").write.option("header", True).csv(path)


def write_token_audit(df: DataFrame, path: str) -> None:
    """(token_id, pruned_count, posting_list_length) as CSV with a header."""
    df.select("token_id", "pruned_count", "posting_list_length").write.option("header", True).csv(path)


def read_sweep(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of {exp_id, alpha, beta, k}."""
    return spark.read.schema("exp_id STRING, alpha DOUBLE, beta DOUBLE, k INT").option("multiLine", True).json(path)


#: Ids that cut the range of all ids into parts which are numbered side by side, about.
ORDINAL_PARTS = 64


def ordinal_ids(df: DataFrame, id_col: str) -> DataFrame:
    """(ordinal, value): distinct ids numbered from 0 in their own order.

    Ids are cut into ranges at a few of them, picked by hash; ranges are counted, and
    numbers given inside each.
    """
    ids = df.select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct()
    every = max(1, ids.count() // ORDINAL_PARTS)
    cuts = sorted(r["id"] for r in ids.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).orderBy(F.xxhash64("id", F.lit(1))).limit(4 * ORDINAL_PARTS).collect())

    def below(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col("id") < F.lit(cuts[mid]), below(low, mid)).otherwise(below(mid + 1, high))

    ids = ids.withColumn("part", below(0, len(cuts)))
    everything = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ids.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(everything), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("id"))
    return ids.join(F.broadcast(parts), "part").select((F.col("before") + rank - 1).cast("long").alias("ordinal"), F.col("id").cast("string").alias("value"))


def write_experiments(rows: DataFrame, path: str) -> None:
    """Append rows of a sweep to a folder of CSV files; each file begins with the header."""
    rows.write.option("header", True).mode("append").csv(path)


def read_experiments(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    read = spark.read.option("header", True)
    return (read.schema(schema) if schema else read.option("inferSchema", True)).csv(path)


def sweep_json(rows: DataFrame, order: str = "exp_id") -> DataFrame:
    """(value): one JSON list of all rows of a sweep summary, in order; a row per setting, so it is small."""
    whole = F.array_sort(F.collect_list(F.struct(order, F.struct(*rows.columns).alias("row"))))
    return rows.agg(F.to_json(F.transform(whole, lambda x: x["row"])).alias("value"))


def write_sweep(rows: DataFrame, path: str, order: str = "exp_id") -> None:
    """A sweep summary as one JSON list, readable by read_sweep()."""
    sweep_json(rows, order).coalesce(1).write.text(path)
