"""Registered queries of the training-data operators, each over its whole
table with production parameters, and the DuckDB SQL of those that SQL can
express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return deco


# -- 1: WARC -----------------------------------------------------------------------------

WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS first FROM p GROUP BY h),
u AS (SELECT h, first, array_to_string(list_transform(string_split(sha1(h), ''), lambda c: ['0000', '0001', '0010', '0011',
        '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111']
        [instr('0123456789abcdef', c)]), '') AS bits FROM g),
x AS (SELECT h, first, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT)
        + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT)
        + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1)), '') AS digest FROM u)
SELECT p.page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, x.digest AS payload_digest,
       CASE WHEN p.page_id = x.first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id <> x.first THEN x.first END AS refers_to, CAST(NULL AS VARCHAR) AS error
FROM p JOIN x ON p.h = x.h
"""


@register("op1_warc", WARC_SQL)
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.warc import round_trip

    back = round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


# -- 2: suffix-array dedup ---------------------------------------------------------------

@register("op2_suffix_dedup")
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.repeats import remove_repeats

    return remove_repeats(documents(spark, sf_dir), length=100).drop("spans", "kept")


# -- 3: benchmark decontamination --------------------------------------------------------

_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

DECONTAMINATE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item, list_slice(w, s, s + 9) AS win, least(len(w), 10) AS n
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, s, n, list_slice(w, s, s + n - 1) AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT dw.doc_id, dw.s, dw.n, bw.item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@register("op3_decontaminate", DECONTAMINATE_SQL)
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.decontaminate import decontaminate

    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(documents(spark, sf_dir), bench).drop("items")


# -- 4: toxicity -------------------------------------------------------------------------

@register("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.toxicity import toxicity

    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


# -- 5: language ID ----------------------------------------------------------------------

@register("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.language import language_id

    return language_id(documents(spark, sf_dir))


# -- 6: exact dedup ----------------------------------------------------------------------

EXACT_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept,
       sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""


@register("op6_exact_dedup", EXACT_SQL)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.exact_dedup import exact_dedup

    return exact_dedup(documents(spark, sf_dir))


# -- 7: MinHash near-dedup ---------------------------------------------------------------

NEAR_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
step AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, step.b FROM reach JOIN step ON reach.b = step.a),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, comp.component_id, d.doc_id = comp.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN comp ON comp.a = d.doc_id
"""


@register("op7_near_dedup", NEAR_SQL)
def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.near_dup import near_dedup

    return near_dedup(documents(spark, sf_dir), shingle=3, percent=85)


# -- 8: SentencePiece --------------------------------------------------------------------

@register("op8_sentencepiece")
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, decoded again: the ids, their number and hash,
    digest of the decoded text, and whether it is the text."""
    from vigil.llm.pieces import round_trip

    both = round_trip(documents(spark, sf_dir).select("doc_id", "text"))
    return both.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_xxhash64"),
                       F.sha2("decoded", 256).alias("decoded_sha256"), F.col("same").alias("round_trip"))


# -- 9: sharding -------------------------------------------------------------------------

@register("op9_sharding")
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.sharding import shard_rows

    rows = shard_rows(documents(spark, sf_dir), shards=40, seed=20240101)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"), "row_number")


# -- 10: personal data -------------------------------------------------------------------

@register("op10_personal_data")
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.personal_data import as_text, personal_data

    found = personal_data(documents(spark, sf_dir))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(as_text(F.col("base")), 256).alias("base_sha256"),
                        as_text(F.col("found")).alias("spans"))


# -- 11: conversation repair -------------------------------------------------------------

_CRC_BITS = "lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
_BLANK = r"NOT regexp_matches(text, '[^\x20\x09-\x0D]')"


def _state(*options: str) -> str:
    """Least (cost, audit) of the options; their text goes along."""
    return f"list_min([x for x in [{', '.join(options)}] if x IS NOT NULL])"


def _edit(state: str, cost: str, audit: str, line: str | None) -> str:
    lines = f"list_append({state}.t, {line})" if line else f"{state}.t"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 's': {state}.s || '{audit}', 't': {lines}}} END"


def _inserted(out: str, s0: str, ss: str, su: str, sa: str) -> tuple[str, str]:
    """The states u and a when one more row may have been inserted."""
    u = _state(su, *[_edit(x, "3", "I", "'user:'") for x in (s0, ss, sa)])
    return u, _state(sa, _edit(su, "3", "I", "'assistant:'"))


_STAY = "CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END"
_OWN, _FREE = "role || ':' || text", "fault IN ('', 'truncated')"

CONVERSATION_SQL = rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
summed AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(k, ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
         lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), {_CRC_BITS})), 4294967295) % 20 AS d FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS again FROM summed WHERE d <> 0),
placed AS (
  SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, again) AS met,
         lag(substr(role, 1, 1)) OVER w || substr(role, 1, 1) AS pair
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again)),
rows_ AS (
  SELECT *, CASE WHEN {_BLANK} THEN 'blank' WHEN met > 1 THEN 'duplicate'
         WHEN NOT regexp_matches(text, '[.!?][ 	-]*\z') THEN 'truncated' ELSE '' END AS fault FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM rows_ GROUP BY conv_id),
search AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 's': '', 't': CAST([] AS VARCHAR[])}} AS s0,
         CAST(NULL AS STRUCT(c BIGINT, s VARCHAR, t VARCHAR[])) AS ss, CAST(NULL AS STRUCT(c BIGINT, s VARCHAR, t VARCHAR[])) AS su,
         CAST(NULL AS STRUCT(c BIGINT, s VARCHAR, t VARCHAR[])) AS sa FROM counts
  UNION ALL
  SELECT conv_id, i, {_edit('s0', '4', 'D', None)},
         {_state(_edit('ss', '4', 'D', None), f"CASE WHEN {_FREE} AND starts_with(role, 's') THEN {_edit('s0', _STAY, 'K', _OWN)} END")},
         {_state(_edit('yu', '4', 'D', None), *[f"CASE WHEN {_FREE} THEN {_edit(x, f'3 + {_STAY}', 'R', "'user:' || text")} END" for x in ('s0', 'ss', 'ya')],
                 *[f"CASE WHEN {_FREE} AND starts_with(role, 'u') THEN {_edit(x, _STAY, 'K', _OWN)} END" for x in ('s0', 'ss', 'ya')])},
         {_state(_edit('ya', '4', 'D', None), f"CASE WHEN {_FREE} THEN {_edit('yu', f'3 + {_STAY}', 'R', "'assistant:' || text")} END",
                 f"CASE WHEN {_FREE} AND starts_with(role, 'a') THEN {_edit('yu', _STAY, 'K', _OWN)} END")}
  FROM (SELECT conv_id, i, role, text, fault, s0, ss, {_inserted('', 's0', 'ss', 'xu', 'xa')[0]} AS yu, {_inserted('', 's0', 'ss', 'xu', 'xa')[1]} AS ya
        FROM (SELECT s.conv_id, r.i, r.role, r.text, r.fault, s0, ss, {_inserted('', 's0', 'ss', 'su', 'sa')[0]} AS xu, {_inserted('', 's0', 'ss', 'su', 'sa')[1]} AS xa
              FROM search s JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i + 1))),
ended AS (
  SELECT conv_id, s0, ss, {_inserted('', 's0', 'ss', 'su', 'sa')[0]} AS su, {_inserted('', 's0', 'ss', 'su', 'sa')[1]} AS sa
  FROM search JOIN counts USING (conv_id) WHERE i = n),
best AS (SELECT conv_id, {_state('s0', 'sa', _edit('su', '3', 'I', "'assistant:'"))} AS b FROM ended)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost, coalesce(b.s, '') AS audit,
       sha256(coalesce(array_to_string(b.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts USING (conv_id) LEFT JOIN best USING (conv_id)
"""


@register("op11_conversation_repair", CONVERSATION_SQL)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and digest of every damaged conversation."""
    from vigil.llm.conversations import audit, damage

    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return audit(damage(conversations), conversations)


# -- 12: packing -------------------------------------------------------------------------

@register("op12_packing")
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, with the checksum of its ids."""
    from vigil.llm.packing import pack

    pieces = pack(documents(spark, sf_dir))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset", "row")


# -- 13: embedding whitening -------------------------------------------------------------

@register("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every remaining vector on every component up to 32."""
    from vigil.llm.whitening import whiten

    found = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=32)
    return found.select("vec_id", "component", "n", F.col("deviation").cast("long").alias("deviation"), "whitened",
                        "explained", "identity_error")
