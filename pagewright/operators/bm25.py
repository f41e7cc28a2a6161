"""BM25 over tables of entries (key columns, ref, text): statistics are kept per key.

With the document's id as key every document is its own corpus; with no key all entries
are one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize
from .physical import small

#: Fixed values.
K1, B = 1.5, 0.75
#: Scores are compared on so many decimals, so that sums in another order cannot change ranks.
RANK_DECIMALS = 10


def tokens(entries: DataFrame, by: list[str]) -> DataFrame:
    return entries.select(*by, "ref", F.explode(tokenize(F.col("text"))).alias("token"))


def term_freq(entries: DataFrame, by: list[str]) -> DataFrame:
    return tokens(entries, by).groupBy(*by, "ref", "token").agg(F.count("*").alias("tf"))


def doc_freq(tf: DataFrame, by: list[str]) -> DataFrame:
    return tf.groupBy(*by, "token").agg(F.count("*").alias("df"))


def lengths(tf: DataFrame, by: list[str]) -> DataFrame:
    """Tokens of each entry, repeats included; entries without tokens have no row."""
    return tf.groupBy(*by, "ref").agg(F.sum("tf").alias("len"))


def stats(entries: DataFrame, tf: DataFrame, by: list[str]) -> DataFrame:
    """n and avgdl of each corpus; n counts all entries, also those without tokens."""
    n = entries.groupBy(*by).agg(F.count("*").alias("n"))
    total = tf.groupBy(*by).agg(F.sum("tf").alias("_t"))
    return n.join(total, by, "left").select(*by, "n", (F.coalesce("_t", F.lit(0)) / F.col("n")).alias("avgdl"))


def idf(n, df) -> "F.Column":
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def hits(queries: DataFrame, entries: DataFrame, by: list[str], query_keys: list[str]) -> DataFrame:
    """(query_id, by, ref, score) of entries that hold a query token; repeats in the query count.

    queries: query_id, query and the columns of query_keys, a part of by that they are limited to.
    Tokens nobody asked for go before any shuffle if the queries are few, by a broadcast of their
    vocabulary; else by a join on tokens. Refs are unique within by.
    """
    if not by:  # one corpus: a constant key
        one = hits(queries, entries.withColumn("_all", F.lit(0)), ["_all"], query_keys)
        return one.drop("_all")
    q = queries.select("query_id", *query_keys, F.explode(tokenize(F.col("query"))).alias("token")).groupBy("query_id", *query_keys, "token").agg(F.count("*").alias("qf"))
    asked = q.select(*query_keys, "token").distinct()
    few = small(queries)
    listed = entries.select(*by, "ref", tokenize(F.col("text")).alias("_tokens")).select(*by, "ref", F.size("_tokens").cast("long").alias("len"), "_tokens")
    held = listed.select(*by, "ref", "len", F.explode("_tokens").alias("token")).join(F.broadcast(asked) if few else asked, [*query_keys, "token"], "left_semi")
    wanted = held.groupBy(*by, "ref", "len", "token").agg(F.count("*").alias("tf"))
    df = wanted.groupBy(*by, "token").agg(F.count("*").alias("df"))
    sums = listed.groupBy(*by).agg(F.count("*").alias("n"), (F.sum("len") / F.count("*")).alias("avgdl"))
    joined = wanted.join(F.broadcast(df) if few and by == ["_all"] else df, [*by, "token"]).join(F.broadcast(sums) if by == ["_all"] else sums, by)  # one row of sums, or one a key
    part = idf(F.col("n"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    scored = joined.select(*by, "ref", "token", part.alias("part")).join(F.broadcast(q) if few else q, [*query_keys, "token"])
    return scored.groupBy("query_id", *by, "ref").agg(F.sum(F.col("part") * F.col("qf")).alias("score"))


def ranked(found: DataFrame, by: list[str], limit: int | None = None) -> DataFrame:
    """Adds position (from 1): falling score, then ref as text."""
    order = Window.partitionBy("query_id", *by).orderBy(F.round("score", RANK_DECIMALS).desc(), F.col("ref").cast("string"))
    out = found.withColumn("position", F.row_number().over(order))
    return out.filter(F.col("position") <= limit) if limit else out


def rare_terms(entries: DataFrame, by: list[str], share: float = 0.5) -> DataFrame:
    tf = term_freq(entries, by)
    limit = F.greatest(F.lit(1), F.floor(F.col("n") * share))
    return tf.join(doc_freq(tf, by), [*by, "token"]).join(entries.groupBy(*by).agg(F.count("*").alias("n")), by).filter(F.col("df") <= limit).select(*by, "ref", "token")


def answerable(queries: DataFrame, entries: DataFrame, by: list[str]) -> DataFrame:
    """(query_id, by, token): distinct query tokens that some entry holds."""
    return term_marks(queries, entries, None, by).select("query_id", *by, "token")


def term_marks(queries: DataFrame, entries: DataFrame, picked: DataFrame | None, by: list[str]) -> DataFrame:
    """(query_id, by, token, held): distinct query tokens that some entry holds, and whether a picked one does."""
    q = queries.select("query_id", *by, F.explode(F.array_distinct(tokenize(F.col("query")))).alias("token"))
    held = entries.select(*by, "ref", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("token"))
    asked = q.select(*by, "token").distinct()
    held = held.join(F.broadcast(asked) if small(queries) else asked, [*by, "token"], "left_semi")
    found = q.join(held, [*by, "token"])
    if picked is not None:
        found = found.join(picked.select("query_id", *by, "ref").distinct().withColumn("_c", F.lit(True)), ["query_id", *by, "ref"], "left")
    mark = F.bool_or(F.col("_c").isNotNull()) if picked is not None else F.lit(False)
    return found.groupBy("query_id", *by, "token").agg(mark.alias("held"))


def term_report(queries: DataFrame, entries: DataFrame, picked: DataFrame, by: list[str]) -> DataFrame:
    """Per query and key: answerable and missing tokens and coverage by the picked refs.

    picked: query_id, by, ref. Coverage is 1 where no query token is in the corpus.
    """
    marked = term_marks(queries, entries, picked, by)
    listed = lambda keep: F.array_sort(F.collect_list(F.when(keep, F.col("token"))))
    sums = marked.groupBy("query_id", *by).agg(listed(F.lit(True)).alias("answerable"), listed(~F.col("held")).alias("missing"), (F.count_if("held") / F.count("*")).alias("coverage"))
    none = F.array().cast("array<string>")
    return queries.select("query_id", *by).join(sums, ["query_id", *by], "left").select("query_id", *by, F.coalesce("answerable", none).alias("answerable"), F.coalesce("missing", none).alias("missing"), F.coalesce("coverage", F.lit(1.0)).alias("coverage"))
