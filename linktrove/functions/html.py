"""HTML columns by ordered replacement rules.

The rules work on text, not on a tree, so unclosed or cut-off tags are no
error.  Raw-text blocks (script, style, head) go first because a script string
may hold something that looks like a tag.
"""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from linktrove import fixed_values as V
from linktrove.functions.text import squeeze_text
from linktrove.functions.urls import computed_once, strip

Rule = tuple[str, str]

RAW_BLOCKS: list[Rule] = [
    (rf"(?is)<{tag}\b.*?(?:</{tag}\s*>|\z)", "") for tag in ("script", "style", "head")
] + [(r"(?s)<!--.*?(?:-->|\z)", "")]

# The same without "head", for rules that read the title.
HIDDEN_BLOCKS: list[Rule] = [rule for rule in RAW_BLOCKS if "<head" not in rule[0]]

WHITESPACE: list[Rule] = [(r"[ \t\r\n\f]+", " ")]

TEXT_BLOCKS: list[Rule] = [
    (r"(?i)</?(?:p|div|article|section|main|header|footer|nav|aside|ul|ol|table|blockquote|pre|h[1-6])\b[^>]*>", "\n\n"),
    (r"(?i)<(?:br|tr|hr)\b[^>]*>", "\n"),
    (r"(?i)<li\b[^>]*>", "\n- "),
    (r"(?i)</t[dh]\s*>", " "),
]

MARKDOWN_BLOCKS: list[Rule] = [
    (rf"(?i)<h{n}\b[^>]*>", "\n\n" + "#" * n + " ") for n in range(1, 7)
] + [
    (r"(?i)</h[1-6]\s*>", "\n\n"),
    (r"""(?i)<img\b[^>]*?\bsrc=["']([^"']*)["'][^>]*?\balt=["']([^"']*)["'][^>]*>""", "![$2]($1)"),
    (r"""(?i)<img\b[^>]*?\balt=["']([^"']*)["'][^>]*?\bsrc=["']([^"']*)["'][^>]*>""", "![$1]($2)"),
    (r"""(?i)<img\b[^>]*?\bsrc=["']([^"']*)["'][^>]*>""", "![]($1)"),
    (r"""(?i)<a\b[^>]*?\bhref=["']([^"']*)["'][^>]*>(.*?)</a\s*>""", "[$2]($1)"),
    (r"(?i)</?(?:b|strong)\b[^>]*>", "**"),
    (r"(?i)</?(?:i|em)\b[^>]*>", "_"),
    (r"(?i)</?code\b[^>]*>", "`"),
    (r"(?i)<hr\b[^>]*>", "\n\n* * *\n\n"),
    (r"(?i)<br\b[^>]*>", "  \n"),
    (r"(?i)<li\b[^>]*>", "\n* "),
    (r"(?i)</?(?:p|div|article|section|main|header|footer|nav|aside|ul|ol|table|blockquote|pre)\b[^>]*>", "\n\n"),
]

ANY_TAG: list[Rule] = [(r"</?[a-zA-Z!][^>]*(?:>|\z)", "")]

ANCHOR = r"(?is)<a\b[^>]*>.*?</a\s*>"


def apply_rules(text: Column, rules: list[Rule]) -> Column:
    return reduce(lambda t, rule: F.regexp_replace(t, rule[0], rule[1]), rules, text)


def decode_entities(text: Column) -> Column:
    """Named entities by table; numeric ones by code point; ``&amp;`` last."""
    def numeric(t: Column) -> Column:
        codes = F.array_distinct(F.regexp_extract_all(t, F.lit("&#0*([0-9]{1,7});"), F.lit(1)))
        chars = F.filter(codes, lambda c: c.cast("int").between(32, 1114111))
        return F.aggregate(
            chars,
            t,
            lambda acc, c: F.regexp_replace(
                acc,
                F.concat(F.lit("&#0*"), c, F.lit(";")),
                F.regexp_replace(
                    F.decode(F.unhex(F.lpad(F.hex(c.cast("int")), 8, "0")), "UTF-32"),
                    r"([\\$])", r"\\$1",
                ),
            ),
        )

    def named(t: Column) -> Column:
        return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), V.HTML_ENTITIES.items(), t)

    return computed_once(
        text, lambda t: F.when(~t.contains("&"), t).when(t.contains("&#"), named(numeric(t))).otherwise(named(t))
    )


def html_to_text(html: Column) -> Column:
    text = apply_rules(F.coalesce(html, F.lit("")), RAW_BLOCKS + WHITESPACE + TEXT_BLOCKS + ANY_TAG)
    text = F.regexp_replace(decode_entities(text), " *\n *", "\n")
    return squeeze_text(text)


def html_to_markdown(html: Column) -> Column:
    text = apply_rules(F.coalesce(html, F.lit("")), RAW_BLOCKS + WHITESPACE + MARKDOWN_BLOCKS + ANY_TAG)
    text = F.regexp_replace(decode_entities(text), "\n +", "\n")
    return strip(F.regexp_replace(text, "\n{3,}", "\n\n"))


def inner_text(fragment: Column) -> Column:
    """Text of a short HTML fragment on one line."""
    return strip(F.regexp_replace(decode_entities(apply_rules(fragment, ANY_TAG)), r"[ \t\r\n\f]+", " "))


#: A comment or tag with what follows it up to the next, quoted values kept whole; text before the first tag; a lone mark.
SEGMENT = r"""<!--[\s\S]*?-->[^<]*|<[!/a-zA-Z][^<>"']*(?:"[^"]*"[^<>"']*|'[^']*'[^<>"']*)*>[^<]*|[^<]+|<"""
TAG = r"""^(?:<!--[\s\S]*?-->|<[!/a-zA-Z][^<>"']*(?:"[^"]*"[^<>"']*|'[^']*'[^<>"']*)*>)"""
#: Tags without an end, and tags whose end may be left out, do not count as depth.
FLAT_TAG = (r"(?i)^</?(?:!|(?:area|base|br|col|embed|hr|img|input|link|meta|source|track|wbr|"
            r"p|li|dt|dd|option|tr|td|th|thead|tbody|tfoot|colgroup)\b)")
SELF_CLOSED = r"/>[^>]*$"


def elements(html: Column, start: str, direct: bool = False, first_child: bool = False) -> Column:
    """Inner HTML of the elements whose start tag matches ``start``, each up to its own end tag.

    One fold over the tags of the text with a running depth.  ``direct``: only
    elements at the top of the fragment; ``first_child``: only those that open
    right after their parent.  Matches inside a match belong to it.  An element
    that is cut off reaches to the end.
    """
    state = "struct<depth:int,take:boolean,after_open:boolean,held:string,found:array<string>>"

    def make(depth: Column, take: Column, after_open: Column, held: Column, found: Column) -> Column:
        return F.struct(depth.cast("int").alias("depth"), take.alias("take"), after_open.alias("after_open"),
                        held.alias("held"), found.alias("found")).cast(state)

    def step(acc: Column, seg: Column) -> Column:
        tag = F.regexp_extract(seg, TAG, 0)
        after = F.substring(seg, F.length(tag) + 1, F.length(seg))
        is_tag = tag != ""
        counts = is_tag & ~tag.rlike(FLAT_TAG)
        closes = counts & seg.startswith("</")
        opens = counts & ~closes & ~tag.rlike(SELF_CLOSED)
        depth, take = acc["depth"], acc["take"]
        wanted = tag.rlike(start) & (acc["after_open"] if first_child else F.lit(True))
        begins = (depth == 0) & opens & (F.lit(True) if direct else wanted)
        ends = (depth == 1) & closes
        level = depth + F.when(opens, 1).when(closes, -1).otherwise(0)
        now_open = F.when(is_tag, opens).otherwise(acc["after_open"])
        done = F.when(take, F.array_append(acc["found"], acc["held"])).otherwise(acc["found"])
        return (
            F.when(begins, make(F.lit(1), wanted, now_open, F.when(wanted, after).otherwise(""), acc["found"]))
            .when(depth == 0, make(F.lit(0), F.lit(False), now_open, F.lit(""), acc["found"]))
            .when(ends, make(F.lit(0), F.lit(False), now_open, F.lit(""), done))
            .otherwise(make(level, take, now_open, F.when(take, F.concat(acc["held"], seg)).otherwise(""), acc["found"]))
        )

    def finish(acc: Column) -> Column:
        return F.when((acc["depth"] > 0) & acc["take"], F.array_append(acc["found"], acc["held"])).otherwise(acc["found"])

    begin = make(F.lit(0), F.lit(False), F.lit(True), F.lit(""), F.array().cast("array<string>"))
    return F.aggregate(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(SEGMENT), F.lit(0)), begin, step, finish)


def attribute(tag: Column, name: str) -> Column:
    return F.nullif(
        F.regexp_extract(tag, rf"""(?i)^<[^>]*?\b{name}=["']([^"']*)["']""", 1), F.lit("")
    )


def _drop_dot_segments(path: Column) -> Column:
    segments = F.slice(F.split(path, "/"), F.lit(2), F.size(F.split(path, "/")))
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, s)),
    )
    tail = F.when(F.element_at(segments, -1).isin(".", ".."), F.lit("/")).otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), tail)


def resolve_link(href: Column, base: Column) -> Column:
    """Absolute form of a link found on page ``base``."""
    scheme = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    origin = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    directory = F.regexp_extract(base, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*/|/)", 1)
    directory = F.when(directory == "", "/").otherwise(directory)
    path = F.when(href.startswith("/"), href).otherwise(F.concat(directory, href))
    plain = F.regexp_extract(path, "^[^?#]*", 0)
    rest = F.regexp_extract(path, "(?s)^[^?#]*(.*)$", 1)
    absolute_path = F.when(path.rlike(r"^[^?#]*/\.\.?(?:/|$|[?#])"), F.concat(_drop_dot_segments(plain), rest)).otherwise(path)
    return (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("#"), F.concat(F.regexp_extract(base, "^[^#]*", 0), href))
        .when(href.startswith("?"), F.concat(F.regexp_extract(base, "^[^?#]*", 0), href))
        .otherwise(F.concat(origin, absolute_path))
    )
