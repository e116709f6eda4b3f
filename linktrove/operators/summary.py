"""Model-free summary: the sentences with the rarest words, in text order."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linktrove import fixed_values as V
from linktrove.functions.urls import strip
from linktrove.sources.scratch import materialize

# A mark that is followed by more text ("example.org", "2.5") does not end a sentence.
SENTENCE_END = r"(?<=[.!?])(?=\s)|\n"
WORD = r"[\p{L}\p{N}]+"
DAMPING = 5


def sentences(text: Column) -> Column:
    """Split, not matched piece by piece: a repeated group would recurse once per mark on long tokens."""
    found = F.split(F.coalesce(text, F.lit("")), SENTENCE_END)
    return F.filter(F.transform(found, lambda s: strip(F.regexp_replace(s, r"^[.!?]+", ""))), lambda s: s.rlike(WORD))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


#: Most frequent words that meet their weight by broadcast, and the longest word among them.
HEAD_WORDS, HEAD_CHARS = 10_000, 64


def parsed_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sentences, counted) stored once: each text is split here and nowhere else.

    ``counted`` holds the number of words and the distinct words of each sentence.
    """
    split = docs.select(F.col(key), sentences(F.col(text)).alias("sentences"))
    counted = F.transform(
        F.transform("sentences", words), lambda ws: F.struct(F.size(ws).alias("n_words"), F.array_distinct(ws).alias("words"))
    )
    return materialize(split.withColumn("counted", counted), "parsed")


def word_weights(parsed: DataFrame) -> DataFrame:
    """Inverse document frequency per word, in thousandths (an integer), and the frequency.

    Distinct words are taken inside the row, so only (word, 1) pairs are
    shuffled, and those are combined first.
    """
    total = parsed.agg(F.count(F.lit(1))).scalar()
    return (
        parsed.select(F.explode(F.array_distinct(F.flatten("counted.words"))).alias("word"))
        .groupBy("word").agg(F.count(F.lit(1)).alias("df"))
        .select("word", "df", F.round(F.ln(total / F.col("df")) * 1000).cast("bigint").alias("weight"))
    )


def sentence_scores(parsed: DataFrame, key: str) -> DataFrame:
    """(key, pos, n_words, score) per sentence.

    The most frequent words, which nearly every sentence holds, meet their weights
    by broadcast; only the rows of the other words are shuffled by word.
    """
    weights = materialize(word_weights(parsed), "word_weights")
    short = weights.where(F.length("word") <= HEAD_CHARS)
    head = F.broadcast(short.orderBy(F.col("df").desc(), "word").limit(HEAD_WORDS).select("word", "weight"))
    per_word = parsed.select(key, F.posexplode("counted").alias("pos", "s")).select(
        key, "pos", "s.n_words", F.explode("s.words").alias("word")
    )
    parts = [
        per_word.join(head, "word"),
        per_word.join(head.select("word"), "word", "left_anti").join(
            weights.join(head.select("word"), "word", "left_anti").select("word", "weight"), "word"),
    ]
    sums = [p.groupBy(key, "pos").agg(F.max("n_words").alias("n_words"), F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n")) for p in parts]
    return sums[0].unionByName(sums[1]).groupBy(key, "pos").agg(
        F.max("n_words").alias("n_words"), F.expr(f"sum(w) div (sum(n) + {DAMPING})").alias("score")
    )


def ranked_sentences(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, n_words, score, rank, words_so_far) per sentence, without the texts.

    The rows of a key come from one text, so a window over a key is bounded by
    that text.
    """
    by_score = Window.partitionBy(key).orderBy(F.col("score").desc(), "pos")
    return sentence_scores(parsed, key).withColumn("rank", F.row_number().over(by_score)).withColumn(
        "words_so_far", F.sum("n_words").over(by_score.rowsBetween(Window.unboundedPreceding, 0))
    )


def extractive_summary(
    docs: DataFrame, key: str = "doc_id", text: str = "text",
    max_words: int = V.SUMMARY_WORDS, max_quotes: int = V.SUMMARY_QUOTES,
) -> DataFrame:
    """Best sentences up to ``max_words`` (at least one), and the best few as quotes.

    Only positions and scores are shuffled for the ranking; each text meets its
    chosen positions in one join on the key.  A text without sentences gets NULLs.
    """
    parsed = parsed_texts(docs, key, text)
    ranked = ranked_sentences(parsed, key)
    chosen = (
        ranked.where((F.col("words_so_far") <= max_words) | (F.col("rank") == 1))
        .groupBy(key)
        .agg(
            F.sort_array(F.collect_list("pos")).alias("_in_order"),
            F.sort_array(
                F.collect_list(F.when(F.col("rank") <= max_quotes, F.struct("rank", "pos")))
            ).alias("_best"),
            F.sum("n_words").alias("n_words"),
        )
    )
    return parsed.select(key, "sentences").join(chosen, key, "left").select(
        key,
        F.array_join(F.transform("_in_order", lambda i: F.col("sentences")[i]), " ").alias("summary"),
        F.array_join(F.transform("_best", lambda r: F.col("sentences")[r["pos"]]), "\n").alias("quotes"),
        "n_words",
    )
