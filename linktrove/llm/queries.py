"""Registered queries of the operators, with the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linktrove.llm.batches import small_batches
from linktrove.llm.bpe_stream import codec_digests
from linktrove.llm.collocations import collocations
from linktrove.llm.conversation_trie import trie_nodes
from linktrove.llm.cover_tree import search
from linktrove.llm.cube_mix import mix
from linktrove.llm.dart_minhash import near_duplicates
from linktrove.llm.licenses import APART, COPYRIGHT_LINE, SPELLINGS, scan, spaced
from linktrove.llm.license_texts import KNOWN
from linktrove.llm.line_dedup import dedup_lines
from linktrove.llm.merkle import edited_prints
from linktrove.llm.prefix_counts import count_tokens
from linktrove.llm.rans_files import token_files
from linktrove.llm.toxicity import fit, score
from linktrove.llm.url_cascade import host_and_path, judge
from linktrove.llm.vocab import vocabulary_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(_table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))


def op2_cover_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_table(spark, sf_dir, "documents"))


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Hosts of the corpus that name what they sell are listed as blocked.
SPAM_HOST = "(casino|bets|pills)"


def op5_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    listed = host_and_path(pages.select("url")).where(F.col("host").rlike(SPAM_HOST)).select("host").distinct()
    return judge(pages, RULES, listed)


def op6_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op7_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))


def op8_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec_digests(_table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))


def op9_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_prints(_table(spark, sf_dir, "documents"))


def op10_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = _table(spark, sf_dir, "documents")
    return score(docs, fit(docs, _table(spark, sf_dir, "labels")))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_nodes(_table(spark, sf_dir, "conversations"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_rans_token_files, op2_cover_tree_search, op3_cube_mix, op4_license_digests, op5_url_cascade,
    op6_dart_minhash, op7_prefix_token_counts, op8_bpe_transducer, op9_merkle_fingerprints, op10_toxicity_neighbours,
    op11_phrase_collocations, op12_conversation_trie, op13_line_dedup)}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    out = f"regexp_replace(lower(coalesce({text}, '')), {_quoted(COPYRIGHT_LINE)}, chr(10), 'g')"
    out = f"regexp_replace({out}, {_quoted(APART)}, ' ', 'g')"
    for old, new in SPELLINGS:
        out = f"replace({out}, {_quoted(spaced(old))}, {_quoted(spaced(new))})"
    return f"trim({out})"


_TOP_SQL = """
WITH x AS (
    SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
    SELECT q.vec_id AS query_id, x.vec_id,
           CAST(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM x AS q JOIN x ON q.vec_id <> x.vec_id WHERE q.vec_id % 100 = 0
), r AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

_LICENSE_SQL = f"""
WITH k AS (
    SELECT md5({_canonical_sql('t')}) AS digest, min(l) AS license
    FROM (VALUES {", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in KNOWN)}) AS known(l, t) GROUP BY 1
), d AS (
    SELECT doc_id, md5({_canonical_sql('text')}) AS digest FROM documents
), n AS (
    SELECT doc_id, md5({_canonical_sql('line')}) AS digest
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
), m AS (
    SELECT n.doc_id, string_agg(DISTINCT k.license, ',' ORDER BY k.license) AS license_lines
    FROM n JOIN k ON n.digest = k.digest GROUP BY n.doc_id
)
SELECT d.doc_id, d.digest, k.license, coalesce(m.license_lines, '') AS license_lines
FROM d LEFT JOIN k ON d.digest = k.digest LEFT JOIN m ON d.doc_id = m.doc_id
"""

_URL_SQL = f"""
WITH u AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
    SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(action, h, q) AS (VALUES {", ".join(f"('{a}', '{h}', '{q}')" for a, h, q in RULES)}
), f AS (
    SELECT page_id, max({{'n': length(h || q), 'h': length(h), 'rule': h || q, 'action': action}}) AS best
    FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, f.best.rule AS rule,
       coalesce(f.best.action, CASE WHEN regexp_matches(host, '{SPAM_HOST}') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN f ON p.page_id = f.page_id
"""

_LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format

_PHRASE_SQL = f"""
WITH p AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(string_split_regex({_LOWER_SQL("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), t AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), g AS (
    SELECT lang, k, phrase, count(*) AS f FROM (
        SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
        FROM t, (VALUES (1), (2), (3)) AS sizes(k)) GROUP BY ALL
), n AS (
    SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang
), c AS (
    SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= 10
), m AS (
    SELECT lang, inside, max(a) AS most FROM (
        SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS inside FROM c WHERE k = 3) GROUP BY ALL
), cut AS (
    SELECT c.lang, c.phrase, c.a, s.n, array_to_string(w[1:s.n], ' ') AS lp, array_to_string(w[s.n + 1:], ' ') AS rp
    FROM c JOIN (VALUES (1), (2)) AS s(n) ON s.n < c.k LEFT JOIN m ON c.lang = m.lang AND c.phrase = m.inside
    WHERE m.most IS NULL OR 100 * m.most < 50 * c.a
), scored AS (
    SELECT cut.lang, cut.phrase, cut.a, cut.n, x.f AS l, y.f AS r,
           CAST((CAST(1000000 AS HUGEINT) * cut.a * cut.a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
    FROM cut JOIN g AS x ON x.lang = cut.lang AND x.phrase = cut.lp JOIN g AS y ON y.lang = cut.lang AND y.phrase = cut.rp
), low AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, n) = 1
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low
)
SELECT ranked.lang, rank, phrase, a, l, r, n.n, score FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000
"""

_TRIE_SQL = """
WITH RECURSIVE t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
               md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
    FROM conversations WHERE conv_id IS NOT NULL
), crc AS (
    SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, 0 AS bit, CAST(4294967295 AS BIGINT) AS v, count(*) AS n FROM t GROUP BY conv_id
    UNION ALL
    SELECT conv_id, s, bit + 1, CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, n FROM (
        SELECT *, CASE WHEN bit % 8 = 0 THEN xor(v, CAST(ascii(substr(s, bit // 8 + 1, 1)) AS BIGINT)) ELSE v END AS x
        FROM crc WHERE bit < 8 * length(s))
), ids AS (
    SELECT conv_id, conv_id - conv_id % 5 AS leader, n, xor(v, 4294967295) % 9 AS h FROM crc WHERE bit = 8 * length(s)
), turns AS (
    SELECT ids.conv_id, t.i, t.role, t.text FROM ids JOIN t ON t.conv_id = ids.leader AND t.i <= ids.h
    UNION ALL
    SELECT ids.conv_id, t.i, t.role, t.text FROM ids JOIN t ON t.conv_id = ids.conv_id AND t.i > ids.h
), convs AS (
    SELECT ids.conv_id, coalesce(list({'r': role, 't': text} ORDER BY i) FILTER (WHERE i IS NOT NULL), []) AS l
    FROM ids LEFT JOIN turns ON turns.conv_id = ids.conv_id GROUP BY ids.conv_id
), pre AS (
    SELECT conv_id, len(l) AS size, d, l[1:d] AS path FROM (SELECT *, unnest(range(0, len(l) + 1)) AS d FROM convs)
), m AS (
    SELECT *, min(conv_id) OVER (PARTITION BY d, path) AS rep FROM pre
), node AS (
    SELECT rep, d, count(*) AS n_convs, max(strlen(coalesce(path[d].t, ''))) AS bytes,
           sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = d), '')) AS ends_sha256
    FROM m GROUP BY rep, d
), up AS (
    SELECT node.*, m.rep AS parent FROM node LEFT JOIN m ON m.conv_id = node.rep AND m.d = node.d - 1
), kids AS (
    SELECT parent, d - 1 AS d, count(*) AS n FROM up WHERE d > 0 GROUP BY ALL
), sums AS (
    SELECT m.rep, m.d, sum((up.n_convs - 1) * up.bytes) AS saved, count(*) FILTER (WHERE kids.n IS NULL) AS leaves
    FROM up JOIN m ON m.conv_id = up.rep AND m.d <= up.d LEFT JOIN kids ON kids.parent = up.rep AND kids.d = up.d GROUP BY m.rep, m.d
)
SELECT up.rep AS conv_id, up.d AS depth, up.parent AS parent_conv_id, up.n_convs, coalesce(kids.n, 0) AS n_children,
       sums.leaves AS n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, up.ends_sha256
FROM up LEFT JOIN kids ON kids.parent = up.rep AND kids.d = up.d JOIN sums ON sums.rep = up.rep AND sums.d = up.d
"""

_LINE_SQL = f"""
WITH l AS (
    SELECT doc_id, text, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line
    FROM (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
), k AS (
    SELECT *, {_LOWER_SQL("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l
), c AS (
    SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
    SELECT k.*, c.keeper IS NOT NULL AND c.keeper <> k.doc_id AS gone FROM k LEFT JOIN c ON c.key = k.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

LLM_ORACLES: dict[str, str] = {
    "op2_cover_tree_search": _TOP_SQL,
    "op4_license_digests": _LICENSE_SQL,
    "op5_url_cascade": _URL_SQL,
    "op11_phrase_collocations": _PHRASE_SQL,
    "op12_conversation_trie": _TRIE_SQL,
    "op13_line_dedup": _LINE_SQL,
}
