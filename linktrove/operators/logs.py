"""Log and browser-console noise rules. The same columns serve batch and stream."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linktrove import fixed_values as V
from linktrove.functions.urls import contains_any
from linktrove.operators import winnowing as W


def level_number(level: Column) -> Column:
    return reduce(lambda c, kv: c.when(level == kv[0], kv[1]), V.LOG_LEVELS.items(), F.when(F.lit(False), 0)).otherwise(0)


def _app_noise(message: Column, level: Column) -> Column:
    ok_request = message.contains("HTTP Request:") & contains_any(message, V.HTTP_OK)
    ok_poll = contains_any(message, V.API_POLL_PHRASES) & message.contains("HTTP/1.1 200")
    editor = (level_number(level) >= V.LOG_LEVELS["WARNING"]) & (
        contains_any(F.lower(message), V.EDITOR_PHRASES)
        | message.startswith("[vs/")
        | (message.contains("]") & message.contains("vs/"))
        | (message.contains("at Object.") & message.contains("js:"))
    )
    return contains_any(message, V.TEX_PHRASES) | editor | ok_request | ok_poll


def _scraper_noise(message: Column, level: Column) -> Column:
    request = message.contains("HTTP Request:")
    editor = (level == "WARNING") & contains_any(F.lower(message), V.SCRAPER_EDITOR_PHRASES)
    ok_poll = contains_any(message, V.API_POLL_PHRASES) & message.contains("HTTP/1.1 200")
    return F.when(request, ~contains_any(message, V.HTTP_ERRORS)).otherwise(editor | ok_poll)


RULESETS = {"app": _app_noise, "scraper": _scraper_noise}


def below_logger_level(logger: Column, level: Column) -> Column:
    """Dropped by the minimum level of its logger or of the nearest named parent."""
    number = level_number(level)
    rules = sorted(V.LOGGER_MIN_LEVEL.items(), key=lambda kv: -len(kv[0]))
    minimum = reduce(
        lambda c, kv: c.when((logger == kv[0]) | logger.startswith(kv[0] + "."), V.LOG_LEVELS[kv[1]]),
        rules,
        F.when(F.lit(False), 0),
    ).otherwise(V.LOG_LEVELS["INFO"])
    return number < minimum


def log_noise(message: Column, level: Column, ruleset: str = "app") -> Column:
    return RULESETS[ruleset](F.coalesce(message, F.lit("")), level)


def log_noise_filter(log_lines: DataFrame, ruleset: str = "app") -> DataFrame:
    logger, level, message = F.col("logger"), F.col("level"), F.col("message")
    kept = ~log_noise(message, level, ruleset)
    if ruleset == "app":
        kept = kept & ~F.coalesce(below_logger_level(logger, level), F.lit(False))
    return log_lines.where(kept)


def critical_console_message(message: Column, msg_type: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    ignored = contains_any(low, V.CONSOLE_ALWAYS_IGNORED + V.CONSOLE_ERROR_IGNORED)
    return (F.lower(F.coalesce(msg_type, F.lit(""))) == "error") & ~ignored


def ignorable_browser_error(message: Column) -> Column:
    """Second filter; an empty message is ignorable."""
    text = F.coalesce(message, F.lit(""))
    return (text == "") | contains_any(F.lower(text), V.BROWSER_ERROR_IGNORED)


def console_filter(messages: DataFrame, strict: bool = True) -> DataFrame:
    """Console rows worth logging: errors that match no ignore phrase."""
    kept = critical_console_message(F.col("message"), F.col("type"))
    if strict:
        kept = kept & ~ignorable_browser_error(F.col("message"))
    return messages.where(kept)


def apply_rules(df: DataFrame, text: str, rules: DataFrame, phrase: str = "phrase") -> DataFrame:
    """Rows whose text contains any phrase of a rule table of any size.

    Short phrases are found in one pass over the texts by an automaton.  Longer
    ones are looked up by winnowed pieces: of every window of a text only the
    piece with the least hash is kept, and a phrase that fills a window shares
    that piece with every text it occurs in.  The candidates are checked where
    they meet the text, by its digest, so no text is copied.  NULL texts and
    empty phrases match nothing.
    """
    phrases = rules.select(F.col(phrase).alias("_phrase")).where("_phrase <> ''").distinct()
    least = min(W.GUARANTEES)
    found = [flag(F.col(text)) for flag in W.short_flags(phrases.where(F.length("_phrase") < least))]
    long = phrases.where(F.length("_phrase") >= least)
    sizes = W.guarantees_used(long)
    if not sizes:
        return df.where(reduce(lambda a, b: a | b, found)) if found else df.where(F.lit(False))
    digest = F.unhex(F.md5(F.col(text)))
    held = W.pieces(long, "_phrase", F.col("_phrase"), sizes, longest_only=True)
    shared = held.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n"))
    rarest = held.join(shared, "_piece").groupBy("_of").agg(F.min(F.struct("_n", "_piece"))["_piece"].alias("_piece"))
    hits = W.pieces(df, text, digest, sizes).join(rarest.select("_piece").distinct(), "_piece", "left_semi").distinct()
    candidates = hits.join(rarest.withColumnRenamed("_of", "_phrase"), "_piece").select("_of", "_phrase")
    matched = (digest == F.col("_of")) & F.contains(F.col(text), F.col("_phrase"))
    if not found:
        return df.join(candidates, matched, "left_semi")
    hit_digests = df.select(digest.alias("_digest"), F.col(text).alias("_text")).join(
        candidates, (F.col("_digest") == F.col("_of")) & F.contains(F.col("_text"), F.col("_phrase")), "left_semi")
    known = hit_digests.select(F.col("_digest").alias("_hit")).distinct()
    either = reduce(lambda a, b: a | b, [F.col("_hit").isNotNull(), *found])
    return df.join(known, digest == F.col("_hit"), "left").where(either).drop("_hit")
