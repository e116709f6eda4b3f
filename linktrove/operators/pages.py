"""Page jobs: text, markdown, fields, links, fallback and whole page attempts."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linktrove import fixed_values as V
from linktrove.functions import html as H
from linktrove.functions import text as T
from linktrove.operators import inference, summary
from linktrove.sources.scratch import materialize


def page_text(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", H.html_to_text(F.col("html")).alias("text"))


def page_markdown(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", H.html_to_markdown(F.col("html")).alias("markdown"))


@dataclass(frozen=True)
class FieldRule:
    """One extracted field: pattern with one group; ``mode`` first, all or count."""

    name: str
    pattern: str
    default: str | None = None
    mode: str = "first"


PAGE_RULES = [
    FieldRule("title", r"(?is)<title\b[^>]*>(.*?)</title\s*>", "Untitled Webpage"),
    FieldRule("language", r"(?i)<html\b[^>]*\blang=[\"']([^\"']*)[\"']"),
    FieldRule("headings", r"(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]\s*>", mode="all"),
    FieldRule("n_links", r"(?i)(<a\b[^>]*\bhref=)", mode="count"),
    FieldRule("n_images", r"(?i)(<img\b)", mode="count"),
    FieldRule("n_paragraphs", r"(?i)(<p\b)", mode="count"),
]


def _bold_counter(path: str) -> str:
    return rf"(?is)<a\b[^>]*href=\"[^\"]*/{path}\"[^>]*>(?:(?!</a).)*?class=\"[^\"]*\btext-bold\b[^\"]*\"[^>]*>([^<]*)<"


REPO_RULES = [
    FieldRule("title", r"(?is)<strong\b[^>]*itemprop=\"name\"[^>]*>\s*<a\b[^>]*>(.*?)</a"),
    FieldRule("description", r"(?is)<p\b[^>]*class=\"f4 mb-3\"[^>]*>(.*?)</p", ""),
    FieldRule("stars", _bold_counter("stargazers"), "0"),
    FieldRule("forks", _bold_counter("forks"), "0"),
    FieldRule("watching", _bold_counter("watchers"), "0"),
    FieldRule("commit_message", r"(?is)data-testid=\"latest-commit-html\"[^>]*>.*?<a\b[^>]*>(.*?)</a", ""),
    FieldRule("commit_date", r"(?is)data-testid=\"latest-commit\"[^>]*>.*?<relative-time\b[^>]*title=\"([^\"]*)\"", ""),
    FieldRule("commit_count", r"(?is)<span\b[^>]*fgColor-default[^>]*>\s*([0-9,]+)\s*Commits?", "Unknown"),
    FieldRule("languages", r"(?is)d-inline-flex[^\"]*flex-items-center[^\"]*\"[^>]*>.*?text-bold[^>]*>(.*?)<", mode="all"),
    FieldRule("readme", r"(?is)<article\b[^>]*class=\"[^\"]*\bmarkdown-body\b[^\"]*\"[^>]*>(.*?)</article", ""),
]

def field(html: Column, rule: FieldRule) -> Column:
    if rule.mode == "count":
        return F.size(F.regexp_extract_all(html, F.lit(rule.pattern), F.lit(1)))
    if rule.mode == "all":
        found = F.regexp_extract_all(html, F.lit(rule.pattern), F.lit(1))
        return F.transform(found, H.inner_text)
    found = F.when(html.rlike(rule.pattern), H.inner_text(F.regexp_extract(html, rule.pattern, 1)))
    return F.coalesce(found, F.lit(rule.default).cast("string"))


def page_fields(pages: DataFrame, rules: list[FieldRule] = PAGE_RULES) -> DataFrame:
    """One column per rule, from the HTML text without scripts and comments."""
    shown = H.apply_rules(F.coalesce(F.col("html"), F.lit("")), H.HIDDEN_BLOCKS)
    html = F.col("_html")
    return pages.select("page_id", "url", shown.alias("_html")).select("page_id", "url", *[field(html, r).alias(r.name) for r in rules])


def repo_fields(pages: DataFrame) -> DataFrame:
    """Repository fields; the title falls back to the last URL part."""
    last = F.regexp_extract("url", "([^/]*)$", 1)
    rows = page_fields(pages, REPO_RULES)
    return rows.withColumn("title", F.coalesce("title", last)).withColumn(
        "commit_count", F.when(F.col("commit_count") == "Unknown", "Unknown").otherwise(T.digits_only(F.col("commit_count")))
    )


POST_TEXT = r"""(?i)^<[^>]*\bdata-testid=["']tweetText["']"""
POST_USER = r"""(?i)^<[^>]*\bdata-testid=["']User-Name["']"""


def post_fields(pages: DataFrame) -> DataFrame:
    """Fields of a post page: user_name, user_handle, text, urls, created_at, timestamp.

    Every element ends at its own end tag, whatever is nested in it.  The text is
    that of the spans directly in the text elements; missing parts are empty, and
    an unreadable time is NULL.
    """
    shown = H.apply_rules(F.coalesce(F.col("html"), F.lit("")), H.HIDDEN_BLOCKS)
    parts = pages.select("page_id", "url", shown.alias("_html")).select(
        "page_id", "url", "_html", H.elements(F.col("_html"), POST_TEXT).alias("_texts"),
        F.get(H.elements(F.col("_html"), POST_USER), 0).alias("_user"),
    )

    def inner(found: Column) -> Column:
        return F.coalesce(H.inner_text(F.get(found, 0)), F.lit(""))

    spans = F.flatten(F.transform("_texts", lambda t: H.elements(t, r"(?i)^<span\b", direct=True)))
    anchors = F.regexp_extract_all(F.array_join("_texts", " "), F.lit(r"(?i)<a\b[^>]*>"), F.lit(0))
    named = F.transform(anchors, lambda a: F.struct(
        H.decode_entities(H.attribute(a, "href")).alias("href"), H.decode_entities(H.attribute(a, "title")).alias("title")))
    kept = F.filter(named, lambda n: n["href"].isNotNull() & keeps_link(n["href"]))
    at = F.coalesce(F.nullif(F.regexp_extract("_html", r"""(?i)<time\b[^>]*\bdatetime=["']([^"']*)["']""", 1), F.lit("")), F.lit(""))
    return parts.select(
        "page_id", "url",
        inner(H.elements(F.col("_user"), r"(?i)^<span\b", first_child=True)).alias("user_name"),
        F.regexp_replace(inner(H.elements(F.col("_user"), r"""(?i)^<div\b[^>]*\bdir=["']ltr["']""")), "^([^@]*)@", "$1").alias("user_handle"),
        H.strip(F.array_join(F.transform(spans, H.inner_text), " ")).alias("text"),
        F.transform(kept, lambda n: full_link(n["href"], n["title"])).alias("urls"),
        at.alias("created_at"), F.unix_timestamp(F.try_to_timestamp(at)).alias("timestamp"),
    )


def page_links(pages: DataFrame) -> DataFrame:
    """All anchors with href, in page order; not those inside comments, scripts or styles."""
    shown = H.apply_rules(F.coalesce(F.col("html"), F.lit("")), H.HIDDEN_BLOCKS)
    anchors = F.regexp_extract_all(shown, F.lit(H.ANCHOR), F.lit(0))
    rows = pages.select("page_id", F.col("url").alias("page_url"), F.posexplode(anchors).alias("pos", "anchor"))
    href = H.decode_entities(H.attribute(F.col("anchor"), "href"))
    return (
        rows.select(
            "page_id", "page_url", "pos",
            href.alias("href"),
            H.decode_entities(H.attribute(F.col("anchor"), "title")).alias("title"),
            H.inner_text(F.col("anchor")).alias("text"),
        )
        .where(F.col("href").isNotNull())
        .withColumn("url", H.resolve_link(F.col("href"), F.col("page_url")))
    )


def keeps_link(href: Column) -> Column:
    return (href != "") & ~href.startswith("/hashtag/") & ~href.startswith("/@")


def full_link(href: Column, title: Column) -> Column:
    """A shortened link's title holds the whole one."""
    return F.when(href.contains("t.co"), F.coalesce(F.nullif(title, F.lit("")), href)).otherwise(href)


def tweet_links(links: DataFrame) -> DataFrame:
    """Links worth keeping of a post; shortened ones use their title."""
    return links.where(keeps_link(F.col("href"))).withColumn("link", full_link(F.col("href"), F.col("title")))


def top_hits(search_index: DataFrame) -> DataFrame:
    """Top search hit per url as ``info``; a hit without title and snippet is none."""
    best = search_index.groupBy("url").agg(F.min_by(F.struct("title", "snippet"), "rank").alias("h"))
    title = F.concat(F.lit("Title: "), F.nullif(F.col("h.title"), F.lit("")))
    snippet = F.concat(
        F.lit("Description: "),
        F.btrim(F.replace(F.nullif(F.col("h.snippet"), F.lit("")), F.lit("..."), F.lit(""))),
    )
    info = F.nullif(F.concat_ws(" | ", title, snippet), F.lit(""))
    return best.select("url", info.alias("info")).where(F.col("info").isNotNull())


def fallback_enrich(failed: DataFrame, search_index: DataFrame | None, enabled: bool = True) -> DataFrame:
    """Content for attempts that gave no usable text, from a search index.

    ``failed``: url, timed_out, error.  Pass only failed rows, so that good
    rows (and their long texts) do not take part in the join.
    """
    timed_out = F.coalesce(F.col("timed_out"), F.lit(False))
    if not enabled or search_index is None:
        content = F.when(timed_out, V.TIMEOUT_DISABLED_CONTENT).otherwise(V.SEARCH_DISABLED_CONTENT)
        return failed.withColumn("content", content).withColumn("extraction_method", F.lit(V.METHOD_UNKNOWN))
    joined = failed.join(top_hits(search_index), "url", "left")
    found = F.col("info").isNotNull()
    nothing = F.when(timed_out, V.TIMEOUT_EMPTY_CONTENT).otherwise(V.SEARCH_EMPTY_CONTENT)
    return (
        joined.withColumn("content", F.coalesce("info", nothing))
        .withColumn("error", F.when(~found, F.col("error")))
        .withColumn("extraction_method", F.when(found, V.METHOD_SEARCH).otherwise(V.METHOD_UNKNOWN))
        .drop("info")
    )


def page_attempts(
    pages: DataFrame, search_index: DataFrame | None = None, make_fn=None, enabled: bool = True,
    templates: dict[str, str] | None = None,
) -> DataFrame:
    """Whole page path: text, gate, summary, else fallback; one attempt row per page.

    ``pages`` may carry a boolean ``timed_out``.  The gated branch never meets
    the fallback join, and the fallback branch carries no texts.  The texts are
    written once to the shared scratch folder, since several branches read them.
    """
    timed_out = F.coalesce(F.col("timed_out"), F.lit(False)) if "timed_out" in pages.columns else F.lit(False)
    texts = materialize(
        pages.select("page_id", "url", timed_out.alias("timed_out"), H.html_to_text(F.col("html")).alias("text")),
        "page_texts",
    )
    usable = ~F.col("timed_out") & T.content_gate(F.col("text"))

    good = texts.where(usable).select("page_id", "url", "text")
    if make_fn is not None:
        prompts = inference.build_prompt(good.withColumn("kind", F.lit("webpage")), templates)
        answered = inference.summarize_with(prompts.select("page_id", "url", "prompt"), make_fn)
        summarized = answered.select("page_id", "url", F.col("summary").alias("content"))
    else:
        short = summary.extractive_summary(good, key="page_id")
        summarized = good.select("page_id", "url").join(short, "page_id", "left").select(
            "page_id", "url", F.col("summary").alias("content")
        )
    done = summarized.select(
        "page_id", "url", "content",
        F.lit(None).cast("string").alias("error"), F.lit(V.METHOD_PAGE).alias("extraction_method"),
    )

    bad = texts.where(~usable).select(
        "page_id", "url", "timed_out",
        F.when(F.col("timed_out"), "Page load timeout").otherwise(V.INSUFFICIENT_CONTENT_ERROR).alias("error"),
    )
    rescued = fallback_enrich(bad, search_index, enabled).select(
        "page_id", "url", "content", "error", "extraction_method"
    )
    unknown = F.when(F.col("content").isNull() & F.col("error").isNull(), V.UNKNOWN_FAILURE_CONTENT)
    return done.unionByName(rescued).select(
        "page_id", "url", F.lit("webpage").alias("type"),
        F.coalesce("content", unknown).alias("content"), "error", "extraction_method",
    )
