"""Term statistics and topics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litlake.functions.unicode import nfkc_lower


# The English stop words of the reference's vectorizer.
STOP_WORDS = (
    "a about above across after afterwards again against all almost alone along already also although always am among amongst amoungst "
    "amount an and another any anyhow anyone anything anyway anywhere are around as at back be became because become becomes becoming "
    "been before beforehand behind being below beside besides between beyond bill both bottom but by call can cannot cant co con could "
    "couldnt cry de describe detail do done down due during each eg eight either eleven else elsewhere empty enough etc even ever every "
    "everyone everything everywhere except few fifteen fifty fill find fire first five for former formerly forty found four from front "
    "full further get give go had has hasnt have he hence her here hereafter hereby herein hereupon hers herself him himself his how "
    "however hundred i ie if in inc indeed interest into is it its itself keep last latter latterly least less ltd made many may me "
    "meanwhile might mill mine more moreover most mostly move much must my myself name namely neither never nevertheless next nine no "
    "nobody none noone nor not nothing now nowhere of off often on once one only onto or other others otherwise our ours ourselves out "
    "over own part per perhaps please put rather re same see seem seemed seeming seems serious several she should show side since "
    "sincere six sixty so some somehow someone something sometime sometimes somewhere still such system take ten than that the their "
    "them themselves then thence there thereafter thereby therefore therein thereupon these they thick thin third this those though "
    "three through throughout thru thus to together too top toward towards twelve twenty two un under until up upon us very via was we "
    "well were what whatever when whence whenever where whereafter whereas whereby wherein whereupon wherever whether which while "
    "whither who whoever whole whom whose why will with within without would yet you your yours yourself yourselves"
).split()


def topic_text(title: Column, abstract: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(abstract, F.lit("")))


def term_statistics(docs: DataFrame, key: str, text: Column, least_docs: int = 5, largest_share: float = 0.9, stop_words: Sequence[str] = ()) -> DataFrame:
    """(term, tf, df, idf) of terms of two or more letters or digits that at least ``least_docs`` and at most a share of all documents hold.

    ``stop_words`` are left out.  Counts per (document, term) are combined before the shuffle by term.
    """
    total = docs.select(key).distinct().count()
    words = docs.select(key, F.explode(F.regexp_extract_all(nfkc_lower(text), F.lit(r"[\p{L}\p{N}]{2,}"), F.lit(0))).alias("term")).where(~F.col("term").isin(*stop_words))
    per_doc = words.groupBy(key, "term").agg(F.count("*").alias("n"))
    counts = per_doc.groupBy("term").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))
    kept = counts.where((F.col("df") >= least_docs) & (F.col("df") <= largest_share * total))
    return kept.withColumn("idf", F.log((F.lit(1.0) + total) / (F.lit(1.0) + F.col("df"))) + 1)


def embedding_topics(vectors: DataFrame, key: str, embedding: str, k: int, seed: int = 5) -> DataFrame:
    """(key, topic) by k-means on the embeddings; null embeddings have no topic."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = vectors.where(F.col(embedding).isNotNull()).select(key, array_to_vector(F.col(embedding).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="topic", maxIter=10).fit(points)
    return model.transform(points).select(key, "topic")


def topic_words(docs: DataFrame, key: str, topics: DataFrame, text: Column, most: int = 10, stop_words: Sequence[str] = ()) -> DataFrame:
    """(topic, term, score, place): class-based TF-IDF of each topic's terms but for ``stop_words``, the ``most`` best."""
    from pyspark.sql import Window

    words = docs.join(topics, key).select("topic", F.explode(F.regexp_extract_all(nfkc_lower(text), F.lit(r"[\p{L}\p{N}]{2,}"), F.lit(0))).alias("term"))
    per_topic = words.where(~F.col("term").isin(*stop_words)).groupBy("topic", "term").agg(F.count("*").alias("tf"))
    per_term = per_topic.groupBy("term").agg(F.sum("tf").alias("all"))
    mean = per_topic.groupBy("topic").agg(F.sum("tf").alias("n")).agg(F.avg("n")).first()[0] or 0.0
    scored = per_topic.join(per_term, "term").withColumn("score", F.col("tf") * F.log1p(F.lit(mean) / F.col("all")))
    place = F.row_number().over(Window.partitionBy("topic").orderBy(F.col("score").desc(), "term"))
    return scored.withColumn("place", place).where(F.col("place") <= most).select("topic", "term", "score", "place")
