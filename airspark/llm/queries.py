"""Registered queries of the operators, with production parameters, and their SQL."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from airspark.llm.chat import chat_digest, format_chats
from airspark.llm.common import table
from airspark.llm.decontaminate import leaked_passages
from airspark.llm.grayindex import near_groups
from airspark.llm.jaccard import similar_documents
from airspark.llm.lexical import rank_documents
from airspark.llm.lines import line_report
from airspark.llm.manifest import tamper_check
from airspark.llm.packing import pack
from airspark.llm.pii import personal_spans, pii_digest
from airspark.llm.secrets import secret_spans
from airspark.llm.topk import top_products, vectors
from airspark.llm.toxicity import score_all
from airspark.llm.warc import archive_pages
from airspark.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        QUERIES[fn.__name__] = run
        if sql is not None:
            SQL[fn.__name__] = sql
        return run

    return register


TOKENIZER = "word_bpe_49k.json"


@query()
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


#: The strings of the chat template that the SQL below counts: start, and around each role's text.
OP2_SQL = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(replace(replace(replace(text, '~', '~0'), '<', '~1'), '[', '~2')) AS body,
    CASE role WHEN 'system' THEN 7 + 8 WHEN 'user' THEN 6 + 7 WHEN 'assistant' THEN 5 + 4
      ELSE 6 + 7 + 6 + length(replace(replace(replace(role, '~', '~0'), '<', '~1'), '[', '~2')) END AS around
  FROM rows
), fsm AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prior,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS from_end
  FROM sized
), told AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    (3 + sum(body + around))::bigint AS formatted_chars,
    count(*) FILTER (NOT coalesce(CASE role WHEN 'system' THEN prior IS NULL
      WHEN 'user' THEN prior IS NULL OR prior IN ('system', 'assistant')
      WHEN 'assistant' THEN prior = 'user' END, FALSE))::int AS violations,
    max(role) FILTER (from_end = 1) = 'assistant' AS ends_well
  FROM fsm GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, violations,
  violations = 0 AND ends_well AS complete FROM told
"""


@query(OP2_SQL)
def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts hold control strings, read back from the output."""
    hard = "</s>[INST] ok [/INST]"
    fixed = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(fixed)
    return chat_digest(format_chats(rows))


@query(
    """
SELECT page_id, strlen(h)::bigint AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN refers IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers AS refers_to
FROM (SELECT page_id, h, CASE WHEN strlen(h) >= 1000 THEN nullif(max(page_id) OVER (PARTITION BY h), page_id) END AS refers
      FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))
"""
)
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as deduplicated archives and read back."""
    return archive_pages(table(spark, sf_dir, "pages"))


@query()
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii_digest(personal_spans(table(spark, sf_dir, "documents")))


@query()
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item that it covers by half or more."""
    return leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, also inside nested encodings."""
    return secret_spans(table(spark, sf_dir, "documents"))


@query(
    """
WITH v AS (
  SELECT vec_id, list_transform(embedding, x -> floor(256 * x::double)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::int AS rank FROM s
) WHERE rank <= 5
"""
)
def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best products of every 50th vector with all others."""
    return top_products(vectors(table(spark, sf_dir, "embeddings")), F.col("id") % 50 == 0)


@query()
def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of all documents."""
    return similar_documents(table(spark, sf_dir, "documents"))


@query()
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from the labels of two thirds of the ids."""
    return score_all(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines of all documents."""
    return line_report(table(spark, sf_dir, "documents"))


@query()
def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all documents."""
    return near_groups(table(spark, sf_dir, "documents"))


def _manifest_sql(source_levels: int = 5, root_levels: int = 4) -> str:
    """The manifest level by level: enough for 16^5 rows of a source and 16^4 sources."""
    upper, lower = string.ascii_uppercase, string.ascii_lowercase

    def leaf(text: str) -> str:
        shown = ["doc_id::varchar", "source", "lang", "n_chars::varchar", text]
        return "sha256(" + " || ".join(f"coalesce(strlen({v})::varchar || ':' || {v}, '-')" for v in shown) + ")"

    bits = "lambda c, k: xor(c >> 1, (c & 1) * 3988292384)"
    step = f"lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), {bits})"
    codes = "list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii((doc_id::varchar)[i])::bigint)"
    crc = f"xor(list_reduce(list_prepend(4294967295::bigint, {codes}), {step}), 4294967295::bigint)"
    parts = [
        "d AS (SELECT doc_id, coalesce('-' || source, '') AS s, "
        f"{leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(f'''translate(text, '{upper}', '{lower}')''')} END AS changed FROM documents)",
        "t0 AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY s) AS n FROM d)",
        "a0 AS (SELECT s, i, n, leaf AS h FROM t0)",
    ]

    def tower(name: str, levels: int) -> None:
        run = "OVER (PARTITION BY s, i // 16 ORDER BY i ROWS BETWEEN"
        for k in range(levels):
            at = f"{name}{k}"
            parts.append(
                f"{name}_run{k} AS (SELECT s, i, coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,"
                f" coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {at} WHERE n > 1)"
            )
            parts.append(
                f"{name}{k + 1} AS (SELECT s, p AS i, m AS n, sha256(string_agg(h, '' ORDER BY i)) AS h FROM"
                f" (SELECT *, i // 16 AS p, (n + 15) // 16 AS m FROM {at} WHERE n > 1) GROUP BY s, p, m UNION ALL SELECT s, i, n, h FROM {at} WHERE n = 1)"
            )

    tower("a", source_levels)
    parts.append(f"z AS (SELECT s AS name, '' AS s, row_number() OVER (ORDER BY s) - 1 AS i, count(*) OVER () AS n, h FROM a{source_levels})")
    parts.append("b0 AS (SELECT s, i, n, h FROM z)")
    tower("b", root_levels)
    parts.append(
        f"f0 AS (SELECT t0.*, z.h AS subroot, z.i AS zi, b{root_levels}.h AS root, '' AS proof, coalesce(changed, leaf) AS node FROM t0 JOIN z ON z.name = t0.s CROSS JOIN b{root_levels})"
    )
    hops = [(f"a_run{k}", f"x.s = y.s AND x.i = y.i // {16**k}") for k in range(source_levels)]
    hops += [(f"b_run{k}", f"x.i = y.zi // {16**k}") for k in range(root_levels)]
    for k, (run, on) in enumerate(hops):
        parts.append(
            f"f{k + 1} AS (SELECT y.* REPLACE (y.proof || coalesce(x.l || x.r, '') AS proof, CASE WHEN x.l IS NULL THEN y.node ELSE sha256(x.l || y.node || x.r) END AS node)"
            f" FROM f{k} y LEFT JOIN {run} x ON {on})"
        )
    return (
        "WITH " + ",\n".join(parts) + "\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified"
        f" FROM f{len(hops)}"
    )


@query(_manifest_sql())
def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle proofs of all documents, of which every fifth is read back in lower case."""
    return tamper_check(table(spark, sf_dir, "documents"))


OP11_SQL = f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents WHERE text IS NOT NULL
), size AS (
  SELECT count(*) FILTER (len(t) > 0) AS n_docs, sum(len(t))::bigint AS length FROM d
), tf AS (
  SELECT doc_id, r, n, term, count(*) AS tf FROM (SELECT doc_id, r, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)))::bigint AS w FROM tf, size GROUP BY term, n_docs
), q AS (
  SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark
), s AS (
  SELECT item_id, text, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // length))))::bigint AS score
  FROM q JOIN tf USING (term) JOIN w USING (term), size GROUP BY ALL
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id))::int AS rank FROM s WHERE score > 0
) WHERE rank <= 50
"""


@query(OP11_SQL)
def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
