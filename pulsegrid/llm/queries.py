"""The operators' registered queries and the SQL that checks those which SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import html_text, language_mix, license_scan, merkle, mixing, mpeg_audio, ngram_join, packing, quality_mil, quality_rules, sharding, token_alignment, token_counts
from pulsegrid.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return out.select(*first, *[c for c in out.columns if c not in first])


def op2_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), sharding.even_tree(8))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def vocabulary(name: str) -> str:
    """A file of a public tokenizer, where its package lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_bpe() -> tuple[str, str, str]:
    import public_tokenizers

    return vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op3_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), byte_bpe(), with_ids=False)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(table(spark, sf_dir, "documents"))


def op6_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), "taken")


def op7_language_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = language_mix.held_out()
    names, model = language_mix.learn(docs.where(~held))
    found = language_mix.identify(docs, names, model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "proportions")


def op9_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.media(table(spark, sf_dir, "documents"), with_media=False)


def op10_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), language_mix.held_out()
    model = quality_mil.train(docs, table(spark, sf_dir, "labels").where(~held))
    scored = quality_mil.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    altered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    without = F.replace("text", F.lit("\n"), F.lit(""))
    claimed = F.when(altered, merkle.leaf([without if c == "text" else c for c in merkle.FIELDS]))
    return merkle.manifest(docs, claimed)


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ranks, pattern = byte_bpe()
    files = token_alignment.Vocabularies(ranks, pattern, vocabulary("piece_bpe_32k.model"))
    return token_alignment.align(table(spark, sf_dir, "documents"), files, with_groups=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_hash_tree, op3_mixture_packing, op4_html_text, op5_ngram_join, op6_fair_mix, op7_language_mix, op8_token_counts, op9_mpeg_audio, op10_quality_mil, op11_merkle_manifest, op12_license_scan, op13_token_alignment)}


#: The oracle counts windows by joining words to their neighbours, where the operator sorts packed longs.
OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d
), windows AS (
  SELECT doc_id, i, word AS a, lead(word) OVER s AS b, lead(word, 2) OVER s AS c FROM words WINDOW s AS (PARTITION BY doc_id ORDER BY i)
), repeated AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows WHERE c IS NOT NULL
), positions AS (
  SELECT DISTINCT doc_id, i + k AS p FROM repeated, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1
), covered AS (SELECT doc_id, count(*) AS n FROM positions GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
lined AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM lines
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
    length(regexp_replace(t, '\P{Lu}+', '', 'g'))::BIGINT AS n_upper,
    length(regexp_replace(t, '\P{L}+', '', 'g'))::BIGINT AS n_letters,
    length(regexp_replace(t, '[^!]+', '', 'g'))::BIGINT AS n_exclaims
  FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN lined l ON l.doc_id = d.doc_id
), f AS (
  SELECT *, CAST({bits} AS BIGINT) AS fail_bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {base}) <> 0 AS base_failed,
  (fail_bits & {mask}) = 0 AND (fail_bits & {base}) = 0 AS kept,
  n_lines, n_upper, n_letters, n_exclaims, fail_bits, '{policy}' AS policy
FROM f
"""


#: Level by level with recursive queries; the checksum's last bit comes from a bitwise fold over the digits.
OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT *, row_number() OVER () AS rid, {leaf_text} AS leaf,
    CASE WHEN list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: xor(x // 2, 3988292384 * (x % 2)) + 0 * k)) % 2 = 1
    THEN {leaf_without} ELSE {leaf_text} END AS claimed
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d
), nodes AS (
  SELECT 0 AS level, source, pos, n, leaf AS digest FROM placed
  UNION ALL
  SELECT level + 1, source, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY level, source, pos // 3, n
), subroots AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, place AS pos, n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 3, n
), root AS (SELECT digest AS root FROM tops WHERE n = 1),
runs AS (SELECT level, source, pos // 3 AS run, list(digest ORDER BY pos) AS members FROM nodes WHERE n > 1 GROUP BY ALL),
top_runs AS (SELECT level, pos // 3 AS run, list(digest ORDER BY pos) AS members FROM tops WHERE n > 1 GROUP BY ALL),
steps AS (
  SELECT p.rid, r.level AS step, r.members, (p.pos // (3 ** r.level)::BIGINT) % 3 AS own
  FROM placed p JOIN runs r ON r.source IS NOT DISTINCT FROM p.source AND r.run = p.pos // (3 ** (r.level + 1))::BIGINT
  UNION ALL
  SELECT p.rid, 100 + r.level, r.members, (s.place // (3 ** r.level)::BIGINT) % 3
  FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source JOIN top_runs r ON r.run = s.place // (3 ** (r.level + 1))::BIGINT
), ordered AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY step) AS k, array_to_string(list_slice(members, 1, own), '') AS a, array_to_string(list_slice(members, own + 2, len(members)), '') AS b FROM steps),
proofs AS (SELECT rid, sha256(string_agg(a || b, '' ORDER BY k)) AS proof FROM ordered GROUP BY rid),
folds AS (
  SELECT rid, 1 AS k, claimed AS digest FROM placed
  UNION ALL
  SELECT f.rid, f.k + 1, sha256(o.a || f.digest || o.b) FROM folds f JOIN ordered o ON o.rid = f.rid AND o.k = f.k
), folded AS (SELECT rid, arg_max(digest, k) AS folded_root FROM folds GROUP BY rid)
SELECT p.doc_id, p.leaf, s.subroot, r.root, coalesce(q.proof, sha256('')) AS proof_sha256, f.folded_root, f.folded_root = r.root AS verified
FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source CROSS JOIN root r LEFT JOIN proofs q ON q.rid = p.rid JOIN folded f ON f.rid = p.rid
"""


#: Words, grams and votes as joined rows; grams are compared by their words.
OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), t AS (SELECT *, string_split(body, ' ') AS w, len(string_split(body, ' ')) AS length FROM (VALUES {templates}) v(template, label, body, key)),
tg AS (SELECT template, label, length, key, pos, list_slice(w, pos + 1, pos + {gram}) AS gram FROM (SELECT *, unnest(range(0, length - {gram} + 1)) AS pos FROM t)),
tk AS (
  SELECT template, min(pos) AS key_from, min(pos) + len(string_split(any_value(key), ' ')) - {gram} AS key_to
  FROM (SELECT template, key, w, unnest(range(0, length)) AS pos FROM t) WHERE list_slice(w, pos + 1, pos + len(string_split(key, ' '))) = string_split(key, ' ') GROUP BY template
), words AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
grams AS (SELECT rid, i AS place, [word, lead(word) OVER s, lead(word, 2) OVER s] AS gram FROM words WINDOW s AS (PARTITION BY rid ORDER BY i)),
phrase AS (SELECT string_split(body, ' ') AS p, label FROM (VALUES {phrases}) v(body, label)),
opens AS (SELECT words.rid, i, p, label FROM words JOIN phrase ON word = p[1]),
places AS (SELECT o.rid, o.i, o.label FROM opens o JOIN d USING (rid) WHERE list_slice(d.w, o.i + 1, o.i + len(p)) = p),
base AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY rid),
votes AS (SELECT rid, template, label, length, key_from, key_to, place, pos, place - pos AS diagonal FROM grams JOIN tg USING (gram) JOIN tk USING (template)),
diagonals AS (SELECT rid, template, diagonal, count(*) FILTER (WHERE pos BETWEEN key_from AND key_to) = any_value(key_to - key_from + 1) AS named FROM votes GROUP BY ALL),
numbered AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER s <= {slack} THEN 0 ELSE 1 END AS fresh FROM diagonals WINDOW s AS (PARTITION BY rid, template ORDER BY diagonal)),
spanned AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, template ORDER BY diagonal) AS span FROM numbered),
spans AS (
  SELECT v.rid, v.template, v.label, s.span, bool_or(s.named) AS named, max(v.length) AS length, max(v.place) + {gram} - min(v.place) AS extent FROM votes v JOIN spanned s USING (rid, template, diagonal) GROUP BY ALL
), matched AS (
  SELECT rid, template, span, count(DISTINCT pos + k) AS n FROM votes JOIN spanned USING (rid, template, diagonal), range({gram}) r(k) GROUP BY ALL
), verified AS (SELECT rid, label, n / greatest(length, extent) AS share FROM spans JOIN matched USING (rid, template, span) WHERE named AND n / greatest(length, extent) >= {share}),
found AS (SELECT rid, list(DISTINCT label) AS labels, max(share) AS share, count(*) AS n_spans FROM verified GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
  array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score, coalesce(n_spans, 0)::BIGINT AS n_spans
FROM d LEFT JOIN base USING (rid) LEFT JOIN found USING (rid)
"""


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def oracle_sql() -> dict[str, str]:
    web = quality_rules.WEB
    bits = " + ".join(f"(CASE WHEN {fails} THEN {1 << i} ELSE 0 END)" for i, (_, fails) in enumerate(quality_rules.RULES))
    sql = OP1_SQL
    for name, value in (("bits", bits), ("base", str(quality_rules.BASE.mask)), ("mask", str(web.mask)), ("policy", f"{web.name}/{web.version}")):
        sql = sql.replace("{" + name + "}", value)
    field = "coalesce(strlen({0}) || ':' || {0}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field.format(text if c == "text" else f"{c}::VARCHAR") for c in merkle.FIELDS) + ")"
    tree = OP11_SQL.replace("{leaf_text}", leaf("text")).replace("{leaf_without}", leaf("replace(text, chr(10), '')"))
    scan = OP12_SQL
    settings = {"gram": license_scan.GRAM, "slack": license_scan.SLACK, "share": license_scan.SHARE}
    settings |= {"templates": _values((i, t.label, t.text, t.key) for i, t in enumerate(license_scan.TEMPLATES)), "phrases": _values(license_scan.PHRASES)}
    for name, value in settings.items():
        scan = scan.replace("{" + name + "}", str(value))
    return {"op1_quality_rules": sql, "op12_license_scan": scan, "op11_merkle_manifest": tree}
