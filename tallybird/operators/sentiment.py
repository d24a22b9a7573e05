"""Review sentiment, topics, and their link to customer outcomes."""

from __future__ import annotations

from collections.abc import Mapping
from re import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybird.functions.polarity import LEXICON, polarity
from tallybird.functions.stats import safe_corr
from tallybird.operators.churn_features import churned

# Class limits and names.
POSITIVE_FROM, NEGATIVE_TO = 0.05, -0.05
POSITIVE, NEGATIVE, NEUTRAL = "Positive", "Negative", "Neutral"

# Topics in the order of their tags, and the substrings that reveal them.
TOPICS = {
    "Delivery": ["delivery", "delivered", "shipping", "arrived", "late"],
    "Product Quality": ["quality", "damaged", "defective", "broken", "works"],
    "Pricing": ["price", "expensive", "value", "money"],
    "Customer Service": ["service", "support", "helpful", "unhelpful", "response"],
    "Payment": ["payment", "refund", "charged", "billing"],
}
NO_TOPIC = "General"
SEPARATOR = ", "


def sentiment_scores(
    reviews: DataFrame, text: str = "review_text", lexicon: Mapping[str, float] = LEXICON
) -> DataFrame:
    return reviews.withColumn("sentiment_score", polarity(text, lexicon))


def sentiment_label(score: Column) -> Column:
    return (
        F.when(score >= POSITIVE_FROM, POSITIVE)
        .when(score <= NEGATIVE_TO, NEGATIVE)
        .otherwise(NEUTRAL)
    )


def rating_label(rating: Column) -> Column:
    return F.when(rating >= 4, POSITIVE).when(rating <= 2, NEGATIVE).otherwise(NEUTRAL)


def topic_array(text: Column, topics: Mapping[str, list[str]] = TOPICS) -> Column:
    """Every topic with a keyword anywhere in the text, also inside words, in dictionary order."""
    lower = F.lower(text)
    tagged = [
        F.when(lower.rlike("|".join(map(escape, words))), topic)
        for topic, words in topics.items()
    ]
    found = F.array_compact(F.array(*tagged))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(NO_TOPIC)))


def topic_tags(text: Column, topics: Mapping[str, list[str]] = TOPICS) -> Column:
    return F.array_join(topic_array(text, topics), SEPARATOR)


def review_sentiment(reviews: DataFrame, lexicon: Mapping[str, float] = LEXICON) -> DataFrame:
    """The reviews with sentiment_score, sentiment_label, topics and rating_based_sentiment."""
    return sentiment_scores(reviews, lexicon=lexicon).select(
        "*",
        sentiment_label(F.col("sentiment_score")).alias("sentiment_label"),
        topic_tags(F.col("review_text")).alias("topics"),
        rating_label(F.col("rating")).alias("rating_based_sentiment"),
    )


def sentiment_agreement(scored: DataFrame) -> DataFrame:
    same = (F.col("sentiment_label") == F.col("rating_based_sentiment")).cast("int")
    return scored.agg(F.avg(same).alias("agreement"))


def sentiment_distribution(scored: DataFrame) -> DataFrame:
    return (
        scored.groupBy("sentiment_label")
        .agg(F.count(F.lit(1)).alias("num_reviews"))
        .orderBy(F.desc("num_reviews"), "sentiment_label")
    )


def rating_sentiment_crosstab(scored: DataFrame) -> DataFrame:
    labels = [NEGATIVE, NEUTRAL, POSITIVE]
    return scored.groupBy("rating").pivot("sentiment_label", labels).count().na.fill(0, labels)


def negative_topic_counts(scored: DataFrame) -> DataFrame:
    return (
        scored.where(F.col("sentiment_label") == NEGATIVE)
        .select(F.explode(F.split("topics", SEPARATOR)).alias("topic"))
        .groupBy("topic")
        .agg(F.count(F.lit(1)).alias("num_mentions"))
        .orderBy(F.desc("num_mentions"), "topic")
    )


def sentiment_business_link(scored: DataFrame, rfm: DataFrame) -> DataFrame:
    """Customers with reviews: segment, value, recency, mean sentiment and churn flag."""
    per_customer = scored.groupBy("customer_id").agg(
        F.avg("sentiment_score").alias("avg_sentiment_score")
    )
    columns = ["customer_id", "segment", "monetary", "frequency", "recency_days"]
    return (
        rfm.select(*columns)
        .join(per_customer, "customer_id")
        .withColumn("churned", churned(F.col("recency_days")))
    )


def sentiment_by_group(link: DataFrame) -> DataFrame:
    """Mean customer sentiment by segment and by churn flag, as (dimension, value, mean), from one
    pass over the customers."""
    keys = F.array(
        F.struct(F.lit("segment").alias("dimension"), F.col("segment").alias("value")),
        F.struct(
            F.lit("churned").alias("dimension"), F.col("churned").cast("string").alias("value")
        ),
    )
    return (
        link.select("avg_sentiment_score", F.inline(keys))
        .groupBy("dimension", "value")
        .agg(F.avg("avg_sentiment_score").alias("avg_sentiment"))
        .orderBy("dimension", F.desc("avg_sentiment"), "value")
    )


def sentiment_correlations(link: DataFrame) -> DataFrame:
    score = F.col("avg_sentiment_score")
    return link.agg(
        safe_corr(score, F.col("monetary")).alias("corr_monetary"),
        safe_corr(score, F.col("frequency")).alias("corr_frequency"),
    )
