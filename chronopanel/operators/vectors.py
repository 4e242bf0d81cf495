"""Term vectors, similarity, search and alignment; all joins are on terms or blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def term_counts(docs: DataFrame, key: str, terms: Column) -> DataFrame:
    """key, term, tf: how often each term occurs in each document; null texts have none."""
    return docs.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Character n-grams inside words that have a space at either end."""
    words = F.transform(F.split(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), " "), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(words, lambda w: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - (n - 1)), lambda i: F.substring(w, i, n))).otherwise(F.array(w))))


def tfidf(counts: DataFrame, key: str, fit: DataFrame | None = None) -> DataFrame:
    """key, term, w: sublinear term frequency times smoothed idf, of length one. Document frequencies come from fit (counts
    itself if not given); terms that fit doesn't know are left out."""
    base = fit if fit is not None else counts
    base_key = base.columns[0]
    n = base.agg(F.count_distinct(base_key).alias("n")).first()["n"]  # one number
    idf = base.groupBy("term").agg((F.ln((1 + F.lit(n)) / (1 + F.count("*"))) + 1).alias("idf"))
    x = counts.join(idf, "term").withColumn("w", (1 + F.ln("tf")) * F.col("idf"))
    return x.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(key)))).select(key, "term", "w")


def cosine_pairs(a: DataFrame, a_key: str, b: DataFrame, b_key: str, scope: list[str] | None = None, most: int | None = None) -> DataFrame:
    """a_key, b_key, sim of all pairs that share a term (in the same scope): an equi-join on the term.

    most: terms of more than so many rows of b don't make pairs; they still count in the sums of pairs made by others."""
    scope = scope or []
    pairs = a.select(*scope, a_key, "term", F.col("w").alias("wa")).join(b.select(*scope, b_key, "term", F.col("w").alias("wb")), [*scope, "term"])
    return pairs.groupBy(*scope, a_key, b_key).agg(F.sum(F.col("wa") * F.col("wb")).alias("sim"))


def top_matches(pairs: DataFrame, key: str, other: str, n: int, score: str = "sim") -> DataFrame:
    """The n best of other for each key, with rank; ties by the least."""
    r = F.row_number().over(W.partitionBy(key).orderBy(F.desc(score), other))
    return pairs.withColumn("rank", r).where(F.col("rank") <= n)


def bm25(postings: DataFrame, key: str, query: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, key, score of documents that have a term starting with one of the query's (query_id, prefix).

    Prefixes meet terms on their first three letters, then startswith decides; shorter prefixes match the whole term."""
    lens = postings.groupBy(key).agg(F.sum("tf").alias("len"))
    stats = lens.agg(F.count("*").alias("n"), F.avg("len").alias("avg")).first()  # two numbers
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    words = df.withColumn("head", F.substring("term", 1, 3))
    q = query.select("query_id", "prefix", F.substring("prefix", 1, 3).alias("head"))
    hit = q.join(words, "head").where(F.when(F.length("prefix") < 3, F.col("term") == F.col("prefix")).otherwise(F.col("term").startswith(F.col("prefix")))).select("query_id", "term", "df").distinct()
    idf = F.ln(1 + (F.lit(stats["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    x = postings.join(hit, "term").join(lens, key)
    s = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(stats["avg"])))
    return x.groupBy("query_id", key).agg(F.sum(s).alias("score"))


def vector_search(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int = 10, rows: int = 20_000, block: int = 1_000) -> DataFrame:
    """query_id, key, rank, score: the k vectors of greatest inner product with each query vector, exact; ties by key.

    Both sides are cut into blocks; each pair of blocks is one matrix product, from which k rows a query go on. Neither
    side is broadcast. Null vectors are left out. queries: query_id, vector.
    """
    sizes = (vectors.count(), queries.count())
    nr, nq = max(1, -(-sizes[0] // rows)), max(1, -(-sizes[1] // block))
    kinds = dict(vectors.dtypes)
    r = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("_id"), F.col(vector).alias("_v"), F.pmod(F.xxhash64(key), F.lit(nr)).alias("rb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long"))).alias("qb"))
    q = queries.where(F.col(vector).isNotNull()).select("query_id", F.col(vector).alias("_v"), F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("long").alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nr - 1).cast("long"))).alias("rb"))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "_id": [], "score": []})
        x, y = np.stack(a["_v"].to_numpy()).astype(np.float64), np.stack(b["_v"].to_numpy()).astype(np.float64)
        s, ids = y @ x.T, a["_id"].to_numpy()
        n = min(k, len(ids))
        out = []
        for i, row in enumerate(s):
            edge = np.partition(row, len(row) - n)[len(row) - n]
            near = np.flatnonzero(row >= edge)  # all that tie with the last, for the order by key
            top = near[np.lexsort((ids[near], -row[near]))][:n]
            out.append(pd.DataFrame({"query_id": b["query_id"].iloc[i], "_id": ids[top], "score": row[top]}))
        return pd.concat(out)

    got = r.groupBy("rb", "qb").cogroup(q.groupBy("rb", "qb")).applyInPandas(best, f"query_id long, _id {kinds[key]}, score double")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "_id")
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("_id").alias(key), "rank", "score")


def centroids(vectors: DataFrame, group: str, vector: str, size: int) -> DataFrame:
    """group, dim, mean: the mean vector of each group, a row a dimension; combined before the shuffle."""
    x = vectors.where(F.col(group).isNotNull() & F.col(vector).isNotNull())
    sums = x.groupBy(group).agg(*[F.avg(F.get(vector, F.lit(i)).cast("double")).alias(str(i)) for i in range(size)])
    return sums.unpivot([group], [str(i) for i in range(size)], "dim", "mean").select(group, F.col("dim").cast("int").alias("dim"), "mean")


def dot(a: str, b: str) -> Column:
    """Inner product of two array columns in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets of terms; 0 if both are empty."""
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(0.0)


def align(questions: DataFrame, nodes: DataFrame, scope: str = "course_id", top: int = 2, cos_share: float = 0.6) -> DataFrame:
    """question_id, node_id, rank, score, sim, coverage: the best nodes of each question in its own scope (a course), by the
    cosine of their term vectors and the idf-weighted share of the question's known terms that the node has.

    questions: scope, question_id, term, tf; nodes: scope, node_id, term, tf; terms should be content terms, for every
    pair that shares one is scored. Weights are fitted on the scope's nodes alone. A question without a known term has no
    match.
    """
    n = nodes.groupBy(scope).agg(F.count_distinct("node_id").alias("n"))
    df = nodes.groupBy(scope, "term").agg(F.count("*").alias("df"))
    idf = df.join(n, scope).select(scope, "term", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))

    def unit(counts: DataFrame, key: str) -> DataFrame:
        x = counts.join(idf, [scope, "term"]).withColumn("w", (1 + F.ln("tf")) * F.col("idf"))
        return x.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(scope, key)))).select(scope, key, "term", "idf", "w")

    qv = unit(questions, "question_id")
    total = qv.groupBy(scope, "question_id").agg(F.sum("idf").alias("total"))
    nv = unit(nodes, "node_id").select(scope, "node_id", "term", F.col("w").alias("wn"))
    pairs = qv.join(nv, [scope, "term"]).groupBy(scope, "question_id", "node_id").agg(F.sum(F.col("w") * F.col("wn")).alias("sim"), F.sum("idf").alias("had"))
    x = pairs.join(total, [scope, "question_id"]).withColumn("coverage", F.col("had") / F.col("total"))
    x = x.withColumn("score", F.round(cos_share * F.greatest("sim", F.lit(0.0)) + (1 - cos_share) * F.col("coverage"), 9))
    return top_matches(x, "question_id", "node_id", top, "score").select("question_id", "node_id", "rank", "score", "sim", "coverage")


def unknown_terms(questions: DataFrame, nodes: DataFrame) -> DataFrame:
    """question_id, unknown, share: terms of a question that no node has, and their share of its terms."""
    known = nodes.select("term").distinct().withColumn("known", F.lit(1))
    x = questions.join(known, "term", "left").groupBy("question_id").agg(F.count(F.when(F.col("known").isNull(), 1)).alias("unknown"), F.count("*").alias("n"))
    return x.select("question_id", "unknown", (F.col("unknown") / F.col("n")).alias("share"))
