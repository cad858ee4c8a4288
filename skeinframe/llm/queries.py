"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontamination, license_scan, near_dedup, ngram_lm, phrase_mining, piece_lattice, prefix_trie, quality_rules, secret_scan, substring_dedup, url_filter, warc

#: The rules that op9 judges by.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_pages(spark, table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"), texts=False)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_lattice.digests(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op7_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.scores(table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = f"{chat_format.END}{chat_format.ROLE} ok {chat_format.TEXT}"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    made = chat_format.examples(turns.unionByName(more))
    return chat_format.read_back(made, in_order=True).drop("n_examples")


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.mine(table(spark, sf_dir, "documents").select("text", "lang"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prefix_trie.paths(table(spark, sf_dir, "conversations"), near=5)
    return prefix_trie.nodes(prefix_trie.grafted(found, most=9)).drop("turn_key")


OP1_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN first_id END AS refers_to
FROM f"""

OP9_SQL = r"""
WITH u AS (SELECT page_id, coalesce(CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END, '') AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) v(action, rhost, rpath)),
m AS (SELECT page_id, host, path, action, rhost || rpath AS rule, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rhost) - length(replace(rhost, '.', '')) DESC, length(rpath) DESC, action DESC) AS n
      FROM h LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE n = 1"""


OP11_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, n, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, r)),
e AS (SELECT *, 17 + length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) + length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) AS chars,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, count(*) OVER (PARTITION BY conv_id) AS n_turns FROM c),
p AS (SELECT *, 3 + sum(chars) OVER (PARTITION BY conv_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS upto FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR n = n_turns) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id"""


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT doc, lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece, generate_subscripts(string_split_regex(text, '[.,;:!?\x0A-\x0D]'), 1) AS pn FROM d),
w AS (SELECT doc, lang, pn, unnest(regexp_extract_all(piece, '[^\x20\x09]+')) AS w, generate_subscripts(regexp_extract_all(piece, '[^\x20\x09]+'), 1) AS wn FROM p),
s AS (SELECT lang, w AS w1, lead(w, 1) OVER q AS w2, lead(w, 2) OVER q AS w3, lead(w, 3) OVER q AS w4, lead(w, 4) OVER q AS w5 FROM w WINDOW q AS (PARTITION BY doc, pn ORDER BY wn)),
f AS (SELECT lang, ws, len(ws) AS k, count(*) AS a FROM (SELECT lang, unnest([[w1], CASE WHEN w2 IS NOT NULL THEN [w1, w2] END, CASE WHEN w3 IS NOT NULL THEN [w1, w2, w3] END, CASE WHEN w4 IS NOT NULL THEN [w1, w2, w3, w4] END, CASE WHEN w5 IS NOT NULL THEN [w1, w2, w3, w4, w5] END]) AS ws FROM s) WHERE ws IS NOT NULL GROUP BY lang, ws HAVING count(*) >= 100),
n AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
c AS (SELECT f.lang, f.ws, f.a, n.n, unnest(range(1, f.k)) AS cut FROM f JOIN n ON n.lang = f.lang WHERE f.k >= 2),
sc AS (SELECT c.lang, c.ws, c.a, c.n, c.cut, x.a AS l, y.a AS r, CAST((1000::HUGEINT * c.a * c.n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score FROM c JOIN f x ON x.lang = c.lang AND x.ws = c.ws[:c.cut] JOIN f y ON y.lang = c.lang AND y.ws = c.ws[c.cut + 1:]),
b AS (SELECT lang, ws, a, n, arg_min({'l': l, 'r': r, 'score': score}, (score, cut)) AS m FROM sc GROUP BY lang, ws, a, n),
inside AS (SELECT DISTINCT f.lang, f.ws[i:j] AS ws, f.a FROM f, range(1, 6) t(i), range(1, 6) u(j) WHERE i <= j AND j <= f.k AND j - i + 1 < f.k)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM (SELECT b.lang, array_to_string(b.ws, ' ') AS phrase, b.a, b.m.l AS l, b.m.r AS r, b.n, b.m.score AS score FROM b ANTI JOIN inside ON inside.lang = b.lang AND inside.ws = b.ws AND inside.a = b.a)
QUALIFY rank <= 2000"""

OP13_SQL = """
WITH own AS (SELECT conv_id AS c, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, octet_length(encode(coalesce(text, ''))) AS bytes,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM conversations WHERE conv_id IS NOT NULL),
counts AS (SELECT c, count(*) AS n FROM own GROUP BY c),
ids AS (SELECT c, c - c % 5 AS base, xor(list_reduce([4294967295] || list_transform(range(1, length(CAST(c AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(c AS VARCHAR)[i]) AS BIGINT)),
               lambda crc, b: list_reduce([xor(crc, b)] || range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 9 AS h FROM counts),
built AS (SELECT i.c, x.n AS d, x.k, x.bytes FROM ids i JOIN own x ON x.c = i.base AND x.n <= i.h
          UNION ALL SELECT i.c, least(i.h, coalesce(b.n, 0)) + x.n - i.h, x.k, x.bytes FROM ids i JOIN own x ON x.c = i.c AND x.n > i.h LEFT JOIN counts b ON b.c = i.base),
m AS (SELECT c, d, md5(string_agg(k, ',') OVER (PARTITION BY c ORDER BY d)) AS node, bytes FROM built UNION ALL SELECT c, 0, 'root', 0 FROM ids),
last AS (SELECT c, max(d) AS d FROM m GROUP BY c),
nodes AS (SELECT node, d, min(c) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes FROM m GROUP BY node, d),
up AS (SELECT nodes.*, p.node AS parent FROM nodes LEFT JOIN m p ON p.c = nodes.conv_id AND p.d = nodes.d - 1),
kids AS (SELECT parent AS node, count(*) AS n FROM up WHERE parent IS NOT NULL GROUP BY parent),
below AS (SELECT a.node, sum((up.n_convs - 1) * up.bytes) AS saved, count(*) FILTER (kids.n IS NULL) AS leaves FROM up JOIN m a ON a.c = up.conv_id AND a.d <= up.d LEFT JOIN kids ON kids.node = up.node GROUP BY a.node),
ends AS (SELECT m.node, sha256(string_agg(CAST(m.c AS VARCHAR), ',' ORDER BY m.c)) AS sha FROM m JOIN last ON m.c = last.c AND m.d = last.d GROUP BY m.node)
SELECT up.conv_id, CAST(up.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, up.n_convs, coalesce(kids.n, 0) AS n_children, below.leaves AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, coalesce(ends.sha, sha256('')) AS ends_sha256
FROM up JOIN below ON below.node = up.node LEFT JOIN kids ON kids.node = up.node LEFT JOIN ends ON ends.node = up.node LEFT JOIN nodes p ON p.node = up.parent"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = {f.__name__: f for f in (op1_warc_index, op2_substring_dedup, op3_quality_rules, op4_sentencepiece, op5_secret_scan, op6_license_scan, op7_ngram_scores, op8_near_dedup, op9_url_filter, op10_decontamination, op11_chat_format, op12_phrase_mining, op13_prefix_trie)}
    return made


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_index": OP1_SQL, "op6_license_scan": license_scan.oracle_sql(), "op9_url_filter": OP9_SQL, "op10_decontamination": decontamination.ORACLE_SQL, "op11_chat_format": OP11_SQL, "op12_phrase_mining": OP12_SQL, "op13_prefix_trie": OP13_SQL}
