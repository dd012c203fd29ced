"""Driver queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsefleet.llm import conversation_trie, filter_audit, langid, licenses, mixture, permutation_index, phrase_index, pieces, sharding, simhash, token_files, urls, warc
from pulsefleet.llm.common import table

TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
END_ID = 2
SHARDS = 24
#: Setting that names an empty shared folder for token files; without it they are gone with the application.
TOKEN_FOLDER = "spark.pulsefleet.tokenFolder"

# The rules of the URL filter (verdict, host, path).
URL_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

#: A budget of six tenths of all tokens, so that shortages occur and are shared out. Target weights: two domains count double, and the smaller languages more than the text they have.
MIXTURE = mixture.Plan(share=600, weights={"domain": {"d0": 2, "d5": 2}, "lang": {"en": 4, "de": 3, "fr": 3, "es": 3}})


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def token_folder(spark: SparkSession) -> str | None:
    return spark.conf.get(TOKEN_FOLDER, None)


def pieces_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECES)


def op1_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"))


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encoded_and_read(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID, folder=token_folder(spark))


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)


def op4_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), URL_RULES)


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(table(spark, sf_dir, "embeddings"))


def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixture(table(spark, sf_dir, "documents"), MIXTURE)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op10_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filter_audit.flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    steps = filter_audit.audit(rows, "part", "ABCDE", ["quality", "toxic"])
    return steps.withColumnsRenamed({"lost_quality": "good_lost", "lost_toxic": "toxic_lost"})


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pieces.encoded(table(spark, sf_dir, "documents"), pieces_path())
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {
    fn.__name__: fn
    for fn in (
        op1_archives,
        op2_token_ids,
        op3_shards,
        op4_contamination,
        op5_url_filter,
        op6_neighbours,
        op7_mixture,
        op8_near_duplicates,
        op9_licenses,
        op10_languages,
        op11_filter_audit,
        op12_conversation_trie,
        op13_sentence_pieces,
    )
}

# -- SQL twins -------------------------------------------------------------------------------------

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_ARCHIVES = """
WITH rows AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages
), best AS (
  SELECT html, max(page_id) AS response FROM rows WHERE n >= 1000 GROUP BY html
)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN page_id < response THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < response THEN response END AS refers_to
FROM rows LEFT JOIN best USING (html)
"""

_CONTAMINATION = f"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER.format("text")}, '{_WORD}') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS words
  FROM items, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS r(i) WHERE len(w) > 0
), grams AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS words
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)
), hits AS (
  SELECT doc_id, item_id, i, size FROM grams JOIN windows USING (size, words)
), covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_URL_FILTER = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), hosts AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS host FROM rest
), places AS (
  SELECT page_id, {_LOWER.format("host")} AS host, regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path FROM hosts
), rules(verdict, rule_host, rule_path) AS (
  VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)}
), fits AS (
  SELECT page_id, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY len(string_split(rule_host, '.')) DESC, length(rule_path) DESC, verdict DESC) AS nth
  FROM places JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM places LEFT JOIN (SELECT * FROM fits WHERE nth = 1) USING (page_id)
"""


def _weights(level: str, plan: mixture.Plan) -> str:
    cases = "".join(f" WHEN {level} = '{value}' THEN {weight}" for value, weight in plan.weights.get(level, {}).items())
    return f"CASE{cases} ELSE 1 END" if cases else "1"


def _shares(nth: int, plan: mixture.Plan) -> str:
    """Budgets of one level: given{nth}."""
    upper, level = list(mixture.LEVELS[:nth]), mixture.LEVELS[nth]
    keys = ", ".join([*upper, level])
    parent = f"PARTITION BY {', '.join(upper)}" if upper else ""
    join = f"JOIN given{nth - 1} USING ({', '.join(upper)})" if upper else "CROSS JOIN total"
    order = f"ORDER BY supply / weight, {level}"
    return f"""
nodes{nth} AS (
  SELECT {keys}, sum(tokens) * {plan.epochs} AS supply, {_weights(level, plan)} AS weight FROM leaves GROUP BY {keys}
), placed{nth} AS (
  SELECT *, coalesce(sum(supply) OVER ({parent} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS paid,
         sum(weight) OVER ({parent} {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
         row_number() OVER ({parent} {order}) AS nth
  FROM nodes{nth} {join}
), met{nth} AS (
  SELECT *, min(CASE WHEN supply * open_weight > (given - paid) * weight THEN nth END) OVER ({parent}) AS first FROM placed{nth}
), pools{nth} AS (
  SELECT *, max(CASE WHEN nth = first THEN given - paid END) OVER ({parent}) AS left_over,
         max(CASE WHEN nth = first THEN open_weight END) OVER ({parent}) AS pool
  FROM met{nth}
), parts{nth} AS (
  SELECT *, CASE WHEN nth >= first THEN (left_over * weight) // pool END AS part FROM pools{nth}
), given{nth} AS (
  SELECT {keys}, CAST(CASE WHEN nth >= first
      THEN part + CASE WHEN nth - first < left_over - sum(part) OVER ({parent}) THEN 1 ELSE 0 END
      ELSE supply END AS BIGINT) AS given
  FROM parts{nth}
)"""


def _mixture_sql(plan: mixture.Plan) -> str:
    keys = ", ".join(mixture.LEVELS)
    return f"""
WITH docs AS (
  SELECT doc_id, coalesce('d' || right(source, 1), 'none') AS domain, coalesce(lang, 'none') AS lang,
         coalesce(source, 'none') AS source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')) AS BIGINT) AS n_tokens
  FROM documents
), leaves AS (
  SELECT {keys}, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM docs WHERE n_tokens > 0 GROUP BY {keys}
), total AS (
  SELECT CAST(least((sum(tokens) * {plan.share}) // 1000, sum(tokens) * {plan.epochs}) AS BIGINT) AS given FROM leaves
), {", ".join(_shares(k, plan) for k in range(3))}, used AS (
  SELECT d.*, tokens, given // tokens AS full_epochs, given % tokens AS rest,
         unnest(range(0, given // tokens + CASE WHEN given % tokens > 0 THEN 1 ELSE 0 END)) AS epoch
  FROM docs d JOIN leaves USING ({keys}) JOIN given2 USING ({keys}) WHERE n_tokens > 0 AND given > 0
), streams AS (
  SELECT *, CAST(coalesce(sum(n_tokens) OVER (PARTITION BY {keys}, epoch
      ORDER BY substr(md5('{plan.seed}:' || epoch || ':' || doc_id), 1, 15) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM used
), cut AS (
  SELECT *, least(n_tokens, CASE WHEN epoch < full_epochs THEN tokens ELSE rest END - start) AS taken FROM streams
)
SELECT doc_id, {keys}, CAST(epoch AS INTEGER) AS epoch, n_tokens, start, CAST(taken AS BIGINT) AS taken FROM cut WHERE taken > 0
"""


def _licenses_sql() -> str:
    quoted = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in licenses.TEMPLATES)
    t = licenses.LEAST
    return f"""
WITH templates AS (
  SELECT license, regexp_extract_all({_LOWER.format("body")}, '{_WORD}') AS w FROM (VALUES {quoted}) AS v(license, body)
), template_pairs AS (
  SELECT license, pair, count(*) AS n
  FROM (SELECT license, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pair FROM templates)
  GROUP BY license, pair
), lines AS (
  SELECT doc_id, i AS line, regexp_extract_all({_LOWER.format("ls[i]")}, '{_WORD}') AS w
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), filled AS (
  SELECT *, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS part FROM lines WHERE len(w) > 0
), passages AS (
  SELECT doc_id, line AS first_line, line AS last_line, w FROM filled
  UNION ALL
  SELECT doc_id, min(line), max(line), flatten(list(w ORDER BY line)) FROM filled GROUP BY doc_id, part HAVING count(*) > 1
  UNION ALL
  SELECT doc_id, min(line), max(line), flatten(list(w ORDER BY line)) FROM filled GROUP BY doc_id HAVING count(DISTINCT part) > 1
), fits AS (
  SELECT doc_id, first_line, last_line, license, p.w, len(p.w) - 1 AS a, len(t.w) - 1 AS b
  FROM passages p JOIN templates t
    ON len(p.w) - 1 >= ceil((len(t.w) - 1) * {t} / (2 - {t}) - 1e-9) AND len(p.w) - 1 <= floor((len(t.w) - 1) * (2 - {t}) / {t} + 1e-9)
  WHERE len(p.w) > 1
), pairs AS (
  SELECT doc_id, first_line, last_line, license, a, b, pair, count(*) AS n
  FROM (SELECT *, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pair FROM fits)
  GROUP BY ALL
), scored AS (
  SELECT doc_id, first_line, last_line, license, 2.0 * CAST(sum(least(x.n, y.n)) AS DOUBLE) / CAST(a + b AS DOUBLE) AS dice
  FROM pairs x JOIN template_pairs y USING (license, pair) GROUP BY doc_id, first_line, last_line, license, a, b
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, first_line, last_line ORDER BY dice DESC, license) AS nth FROM scored WHERE dice >= {t}
)
SELECT doc_id, CAST(first_line AS BIGINT) AS first_line, CAST(last_line AS BIGINT) AS last_line, license, dice FROM ranked WHERE nth = 1
"""


def _filter_audit_sql() -> str:
    bit = {c: 1 << i for i, c in enumerate("ABCDE")}
    steps = [(order, k + 1, sum(bit[c] for c in order[:k]), bit[order[k]]) for order in map("".join, permutations("ABCDE")) for k in range(5)]
    return f"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), firsts AS (
  SELECT text, min(doc_id) AS first FROM docs GROUP BY text
), worded AS (
  SELECT doc_id, part, text, first, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM docs JOIN firsts USING (text)
), masks AS (
  SELECT doc_id, part,
    CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS mask
  FROM worded
), known AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id
), cells AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(bad), 0) AS bad FROM masks LEFT JOIN known USING (doc_id) GROUP BY part, mask
), steps(filter_order, step, earlier, own) AS (
  VALUES {", ".join(map(str, steps))}
), sums AS (
  SELECT part, filter_order, step, own,
         sum(CASE WHEN mask & (earlier | own) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & earlier = 0 AND mask & own > 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & earlier > 0 AND mask & own > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & earlier = 0 AND mask & own > 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & earlier = 0 AND mask & own > 0 THEN bad ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM sums
"""


#: CRC-32 of the decimal digits, a byte and a bit at a time.
_CRC32 = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda a, x: list_reduce(list_concat([xor(a, x)], list_transform(range(8), lambda k: CAST(k AS BIGINT))),
    lambda b, y: xor(b >> 1, CAST(3988292384 AS BIGINT) * (b & 1)))), CAST(4294967295 AS BIGINT))"""

_CONVERSATION_TRIE = f"""
WITH own AS (
  SELECT conv_id AS conv, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS nth
  FROM conversations WHERE conv_id IS NOT NULL
), sizes AS (
  SELECT conv, count(*) AS size FROM own GROUP BY conv
), plans AS (
  SELECT conv, base, h, least(h, coalesce(b.size, 0)) AS lent
  FROM (SELECT conv, conv - conv % 5 AS base, {_CRC32.format("conv")} % 9 AS h FROM sizes) LEFT JOIN (SELECT conv AS base, size FROM sizes) b USING (base)
), turns AS (
  SELECT p.conv, o.nth AS depth, role, text FROM plans p JOIN own o ON o.conv = p.base AND o.nth <= p.h
  UNION ALL
  SELECT p.conv, o.nth - p.h + p.lent, role, text FROM plans p JOIN own o ON o.conv = p.conv AND o.nth > p.h
), paths AS (
  SELECT conv, coalesce(list(md5(md5(role) || md5(text)) ORDER BY depth) FILTER (depth IS NOT NULL), []) AS path,
         coalesce(list(strlen(text) ORDER BY depth) FILTER (depth IS NOT NULL), []) AS bytes
  FROM plans LEFT JOIN turns USING (conv) GROUP BY conv
), prefixes AS (
  SELECT conv, d, array_to_string(path[1:d], '') AS key, CASE WHEN d > 0 THEN array_to_string(path[1:d - 1], '') END AS parent,
         CASE WHEN d > 0 THEN bytes[d] ELSE 0 END AS bytes, d = len(path) AS ends
  FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM paths)
), nodes AS (
  SELECT key, any_value(parent) AS parent, any_value(d) AS depth, min(conv) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
         sha256(coalesce(string_agg(CAST(conv AS VARCHAR), ',' ORDER BY conv) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY key
), children AS (
  SELECT parent AS key, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), subtrees AS (
  SELECT DISTINCT a.key AS top, b.key AS key FROM prefixes a JOIN prefixes b ON a.conv = b.conv AND a.d <= b.d
), sums AS (
  SELECT top AS key, count(*) FILTER (n_children IS NULL) AS n_leaves, sum((n_convs - 1) * bytes) AS saved_tokens
  FROM subtrees JOIN nodes USING (key) LEFT JOIN children USING (key) GROUP BY top
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON n.parent = p.key LEFT JOIN children c ON c.key = n.key JOIN sums s ON s.key = n.key
"""


ORACLES = {
    "op1_archives": _ARCHIVES,
    "op4_contamination": _CONTAMINATION,
    "op5_url_filter": _URL_FILTER,
    "op7_mixture": _mixture_sql(MIXTURE),
    "op9_licenses": _licenses_sql(),
    "op11_filter_audit": _filter_audit_sql(),
    "op12_conversation_trie": _CONVERSATION_TRIE,
}
