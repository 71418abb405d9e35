"""Lexicon sentiment and crisis phrases as Column expressions (no Python workers)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F



# Word and phrase lists of the lexicon.
POSITIVE_WORDS = [
    "good", "great", "excellent", "happy", "joy", "love", "wonderful", "fantastic", "amazing", "better", "best",
    "positive", "hopeful", "optimistic",
]
NEGATIVE_WORDS = [
    "bad", "terrible", "awful", "sad", "depressed", "anxious", "worried", "fear", "hate", "worst", "negative",
    "hopeless", "pessimistic", "miserable",
]
HIGH_AROUSAL_WORDS = ["excited", "anxious", "angry", "energetic", "panic", "frantic", "intense", "urgent", "!"]
LOW_AROUSAL_WORDS = ["calm", "tired", "relaxed", "bored", "sleepy", "peaceful", "quiet", "still"]
HIGH_DOMINANCE_WORDS = ["confident", "control", "powerful", "strong", "capable", "able", "can", "will"]
LOW_DOMINANCE_WORDS = ["helpless", "powerless", "weak", "unable", "can't", "won't", "impossible", "trapped"]
CRISIS_PHRASES = [
    "suicide", "suicidal", "kill myself", "end my life", "want to die", "better off dead", "no reason to live",
    "self-harm", "hurt myself", "cut myself", "overdose", "end it all", "can't go on", "hopeless", "worthless",
    "no way out",
]
EMOTION_CUT = 0.3


def words_present(lowered: Column, words: list[str]) -> Column:
    """How many of the words occur anywhere in the text, each counted once."""
    return reduce(lambda a, b: a + b, [F.contains(lowered, F.lit(w)).cast("int") for w in words])


def balance(high: Column, low: Column) -> Column:
    total = high + low
    return F.when(total > 0, (high - low) / F.when(total > 0, total)).otherwise(F.lit(0.0))


def lexicon_counts(text: Column, lowered: Column) -> dict[str, Column]:
    """Word-presence counts behind the three scores.

    Exclamation marks count once as a word and once more per mark.
    """
    marks = F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))
    return {
        "_positive": words_present(lowered, POSITIVE_WORDS),
        "_negative": words_present(lowered, NEGATIVE_WORDS),
        "_high_arousal": words_present(lowered, HIGH_AROUSAL_WORDS) + marks,
        "_low_arousal": words_present(lowered, LOW_AROUSAL_WORDS),
        "_high_dominance": words_present(lowered, HIGH_DOMINANCE_WORDS),
        "_low_dominance": words_present(lowered, LOW_DOMINANCE_WORDS),
    }


def crisis_phrases(lowered: Column) -> Column:
    """Phrases found as whole words in lower-case text, in list order."""
    found = [
        F.when(F.contains(lowered, F.lit(p)) & F.rlike(lowered, F.lit(r"(?U)\b" + p.replace("-", r"\-") + r"\b")), F.lit(p))
        for p in CRISIS_PHRASES
    ]
    return F.array_compact(F.array(*found))


def emotions(v: Column, a: Column) -> dict[str, Column]:
    cut, zero = F.lit(EMOTION_CUT), F.lit(0.0)
    return {
        "joy": F.when((v > cut) & (a > cut), F.least(v, a)).otherwise(zero),
        "anxiety": F.when((v < -cut) & (a > cut), F.least(F.abs(v), a)).otherwise(zero),
        "sadness": F.when((v < -cut) & (a < -cut), F.least(F.abs(v), F.abs(a))).otherwise(zero),
    }


def analyze_sentiment(df: DataFrame, text_column: str = "text_response") -> DataFrame:
    """Sentiment and crisis columns; null or empty text gives zeros and no flag.

    The text is lowered once and each word list counted once, in projections of their own,
    so no expression repeats a scan of the text.
    """
    data = df.withColumn("_low", F.lower(text_column))
    counted = data.withColumns({**lexicon_counts(F.col(text_column), F.col("_low")), "_found": crisis_phrases(F.col("_low"))})

    def score(high, low):
        return F.coalesce(balance(F.col(high), F.col(low)), F.lit(0.0))

    hit = F.coalesce(F.size("_found") > 0, F.lit(False))
    valence = score("_positive", "_negative")
    return counted.select(
        *df.columns,
        valence.alias("sentiment_valence"),
        score("_high_arousal", "_low_arousal").alias("sentiment_arousal"),
        score("_high_dominance", "_low_dominance").alias("sentiment_dominance"),
        valence.alias("sentiment_compound"),
        F.when(hit, F.concat_ws(", ", "_found")).alias("crisis_keywords"),
        hit.alias("crisis_flag"),
    )


def emotion_columns(df: DataFrame) -> DataFrame:
    """Add joy, anxiety and sadness to a table that has the sentiment columns."""
    return df.withColumns(emotions(F.col("sentiment_valence"), F.col("sentiment_arousal")))


def sentiment_features(df: DataFrame, text_column: str = "text_response", id_column: str = "anonymized_id") -> DataFrame:
    """Sentiment roll-up per individual."""
    scored = analyze_sentiment(df.filter(F.col(id_column).isNotNull()).select(id_column, text_column), text_column)
    v = F.col("sentiment_valence")
    aggs = [
        F.avg(v).alias("sentiment_valence_mean"),
        F.stddev_samp(v).alias("sentiment_valence_std"),
        F.min(v).alias("sentiment_valence_min"),
        F.max(v).alias("sentiment_valence_max"),
    ]
    for name in ("arousal", "dominance", "compound"):
        c = F.col(f"sentiment_{name}")
        aggs += [F.avg(c).alias(f"sentiment_{name}_mean"), F.stddev_samp(c).alias(f"sentiment_{name}_std")]
    aggs.append(F.sum(F.col("crisis_flag").cast("long")).alias("crisis_flag_sum"))
    return scored.groupBy(id_column).agg(*aggs)
