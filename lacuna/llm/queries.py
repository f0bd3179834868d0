"""The queries of this subpackage, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lacuna.llm import bpe_automaton, decontamination, fill_middle, line_dedup, main_text, manifest, pii, quality, secrets, simhash, token_counts, token_files, warc
from lacuna.llm.common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "source", "text", "n_lines", "n_dropped")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", *quality.STATS, "base_failed", "kept", "n_removed_chars")


def op4_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.encode(table(spark, sf_dir, "documents"), tokenizer_path(), ids=False)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_drawn_keys: dict[str, str] = {}


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secret is the session's spark.lacuna.pii.key; where it is unset one is drawn for the application, so that nobody can
    make the surrogates again."""
    key = spark.conf.get("spark.lacuna.pii.key", None) or _drawn_keys.setdefault(spark.sparkContext.applicationId, os.urandom(16).hex())
    return pii.replace(table(spark, sf_dir, "documents"), key.encode()).select("doc_id", "text", "n_entities")


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return manifest.audit(docs, manifest.lowered_in_fifths(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_warc": op2_warc,
    "op3_quality_rules": op3_quality_rules,
    "op4_bpe_encoding": op4_bpe_encoding,
    "op5_token_files": op5_token_files,
    "op6_secrets": op6_secrets,
    "op7_token_counts": op7_token_counts,
    "op8_simhash": op8_simhash,
    "op9_decontamination": op9_decontamination,
    "op10_pii": op10_pii,
    "op11_main_text": op11_main_text,
    "op12_fill_middle": op12_fill_middle,
    "op13_manifest": op13_manifest,
}

_WHITE = "[\\x20\\x09-\\x0D]+"
_NORMAL = "regexp_replace(lower(coalesce(text, '')), '[\\x20\\x09\\x0B-\\x0D]+', ' ', 'g')"

#: Lines with a number, and how many documents of the host hold each normalised line.
_LINES = f"""
  base AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
  split AS (SELECT rid, source, text, string_split({_NORMAL}, chr(10)) AS norm, string_split(coalesce(text, ''), chr(10)) AS raw FROM base),
  lines AS (SELECT rid, source, unnest(generate_series(1, len(raw))) AS i, unnest(raw) AS line, trim(unnest(norm), ' ') AS norm FROM split),
  counts AS (SELECT source, norm, count(DISTINCT rid) AS n_docs FROM lines WHERE norm <> '' GROUP BY source, norm),
  totals AS (SELECT source, count(*) AS host_docs FROM base GROUP BY source)
"""

ORACLES: dict[str, str] = {
    "op1_line_dedup": f"""
      WITH {_LINES},
      bad AS (SELECT c.source, norm FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source WHERE n_docs >= 5 AND n_docs > host_docs * 0.06),
      marked AS (SELECT rid, i, line, b.norm IS NOT NULL AS dropped FROM lines l LEFT JOIN bad b ON b.norm = l.norm AND b.source IS NOT DISTINCT FROM l.source),
      joined AS (SELECT rid, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '') AS rest, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped FROM marked GROUP BY rid)
      SELECT doc_id, source, CASE WHEN text IS NULL THEN NULL ELSE rest END AS text, CASE WHEN text IS NULL THEN 0 ELSE n_lines END AS n_lines, n_dropped
      FROM base JOIN joined USING (rid)""",
    "op2_warc": """
      WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
      d AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
      f AS (SELECT payload_digest, min(page_id) AS first FROM d GROUP BY payload_digest)
      SELECT page_id, payload_bytes, payload_digest,
        CASE WHEN payload_bytes >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to
      FROM d JOIN f USING (payload_digest)""",
    "op3_quality_rules": f"""
      WITH {_LINES},
      bad AS (SELECT c.source, norm FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source WHERE n_docs > 10 AND n_docs > host_docs * 0.05),
      removed AS (SELECT rid, sum(length(regexp_replace(line, '{_WHITE}', '', 'g'))) AS n FROM lines l JOIN bad b ON b.norm = l.norm AND b.source IS NOT DISTINCT FROM l.source GROUP BY rid),
      dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines WHERE norm <> '' GROUP BY rid),
      w AS (SELECT rid, list_filter(string_split_regex(coalesce(text, ''), '{_WHITE}'), lambda x: x <> '') AS words FROM base),
      windows AS (SELECT rid, unnest(generate_series(1, len(words) - 2)) AS i, words FROM w WHERE len(words) > 2),
      keyed AS (SELECT rid, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM windows),
      twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM keyed) WHERE n > 1),
      rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
      s AS (
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(coalesce(text, ''), '{_WHITE}', '', 'g')) AS BIGINT) AS word_chars,
          CAST(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
          CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(removed.n, 0) AS BIGINT) AS n_removed_chars
        FROM base JOIN w USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN removed USING (rid))
      SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_removed_chars <= word_chars * 0.5 AS kept
      FROM s""",
    "op12_fill_middle": r"""
      WITH base AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
      drawn AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
        [CAST('0x' || substr(h, 1 + 8 * k, 8) AS BIGINT) FOR k IN [0, 1, 2, 3]] AS d FROM base),
      cut AS (SELECT *, len(units) AS n, least(d[1] % (len(units) + 1), d[2] % (len(units) + 1)) AS a, greatest(d[1] % (len(units) + 1), d[2] % (len(units) + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 50 THEN 'plain' WHEN d[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
      parts AS (SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM cut)
      SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
      FROM parts""",
    "op13_manifest": """
      WITH RECURSIVE
      base AS (SELECT doc_id, source, lang, n_chars, text, list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], [CAST(ascii(c) AS UBIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
        lambda x, c: list_reduce(list_concat([xor(x, c)], [CAST(0 AS UBIGINT) FOR k IN range(8)]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))) AS c FROM documents),
      told AS (SELECT *, CASE WHEN xor(c, 4294967295) % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other FROM base),
      fields AS (SELECT *, array_to_string([coalesce(octet_length(encode(x)) || ':' || x, '-') FOR x IN [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)]], '') AS head FROM told),
      leaves AS (SELECT doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf, sha256(head || coalesce(octet_length(encode(other)) || ':' || other, '-')) AS altered FROM fields),
      placed AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
      lower AS (
        SELECT g, 0 AS level, i, leaf AS node, count(*) OVER (PARTITION BY g) AS n FROM placed
        UNION ALL
        SELECT g, level + 1, i // 16, sha256(string_agg(node, '' ORDER BY i)), (any_value(n) + 15) // 16 FROM lower WHERE n > 1 GROUP BY g, level, i // 16),
      subs AS (SELECT g, node AS subroot FROM lower WHERE n = 1),
      upper AS (
        SELECT 0 AS level, g AS i, subroot AS node, count(*) OVER () AS n FROM subs
        UNION ALL
        SELECT level + 1, i // 16, sha256(string_agg(node, '' ORDER BY i)), (any_value(n) + 15) // 16 FROM upper WHERE n > 1 GROUP BY level, i // 16),
      near AS (
        SELECT x.g, x.level, x.i, coalesce(string_agg(y.node, '' ORDER BY y.i) FILTER (WHERE y.i < x.i), '') AS l, coalesce(string_agg(y.node, '' ORDER BY y.i) FILTER (WHERE y.i > x.i), '') AS r
        FROM lower x JOIN lower y ON x.g = y.g AND x.level = y.level AND x.i // 16 = y.i // 16 WHERE x.n > 1 GROUP BY x.g, x.level, x.i),
      near_up AS (
        SELECT x.level, x.i, coalesce(string_agg(y.node, '' ORDER BY y.i) FILTER (WHERE y.i < x.i), '') AS l, coalesce(string_agg(y.node, '' ORDER BY y.i) FILTER (WHERE y.i > x.i), '') AS r
        FROM upper x JOIN upper y ON x.level = y.level AND x.i // 16 = y.i // 16 WHERE x.n > 1 GROUP BY x.level, x.i),
      walked AS (
        SELECT p.g, p.i AS leaf_i, 0 AS level, p.i AS i, p.altered AS acc, '' AS proof FROM placed p
        UNION ALL
        SELECT w.g, w.leaf_i, w.level + 1, w.i // 16, sha256(m.l || w.acc || m.r), w.proof || m.l || m.r FROM walked w JOIN near m ON w.g = m.g AND w.level = m.level AND w.i = m.i),
      at_sub AS (SELECT g, leaf_i, acc, proof FROM walked QUALIFY row_number() OVER (PARTITION BY g, leaf_i ORDER BY level DESC) = 1),
      climbed AS (
        SELECT g, leaf_i, 0 AS level, g AS i, acc, proof FROM at_sub
        UNION ALL
        SELECT c.g, c.leaf_i, c.level + 1, c.i // 16, sha256(m.l || c.acc || m.r), c.proof || m.l || m.r FROM climbed c JOIN near_up m ON c.level = m.level AND c.i = m.i),
      at_root AS (SELECT g, leaf_i, acc, proof FROM climbed QUALIFY row_number() OVER (PARTITION BY g, leaf_i ORDER BY level DESC) = 1),
      root AS (SELECT node AS root FROM upper WHERE n = 1)
      SELECT p.doc_id, p.leaf, s.subroot, root.root, sha256(a.proof) AS proof_sha256, a.acc AS folded_root, a.acc = root.root AS verified
      FROM placed p JOIN subs s USING (g) JOIN at_root a ON a.g = p.g AND a.leaf_i = p.i CROSS JOIN root""",
}
