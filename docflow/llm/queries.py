"""The thin ``opN_<name>`` queries: production parameters over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import spread
from . import chat, decontamination, exact_dedup, fim, hard_negatives, langid, quality, simhash, substring_dedup, token_count, toxicity
from .common import table, written
from .sentencepiece_bpe import encode
from .url_filter import BLOCK_GLOBS, HOST_RULES, UNRESERVED, filter_urls


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the production rules on every page's URL."""
    return filter_urls(table(spark, sf_dir, "pages")).drop("glob")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with each benchmark item that one of its passages is within the edit budget of."""
    return decontamination.matches(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words without those that a 20-word window repeats; a digest of what is kept."""
    found = substring_dedup.deduplicate(table(spark, sf_dir, "documents"))
    words = F.array_remove(F.split(F.coalesce("kept", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.array_join(words, " "), 256).alias("kept_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of a quarter of the ids are held out and teach nothing."""
    docs = _documents(spark, sf_dir)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~_held_out(4, 2)))
    return toxicity.score(docs, model).select("doc_id", _held_out(4, 2).alias("held_out"), "score", "predicted")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document, against the trusted documents and the whole corpus."""
    docs = _documents(spark, sf_dir)
    labels = table(spark, sf_dir, "labels")
    judged = written(quality.judge(docs, quality.log_ratios(docs, labels)), "judged")
    return quality.verdicts(judged, quality.fitted(judged, labels))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted from flat token files."""
    import public_tokenizers

    return token_count.document_counts(_documents(spark, sf_dir), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of every document's token ids, digest of the text they decode to."""
    return encode(_documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with a stale answer in its course: prompt, completions, scored spans."""
    pairs = chat.stale_pairs(chat.conversations(table(spark, sf_dir, "conversations")))
    spans = {c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["length"].cast("string"))), ",") for c in ("chosen_scored", "rejected_scored")}
    return chat.preferences(pairs).withColumns(spans)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def _held_out(modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; those of a third of the ids are held out and teach nothing."""
    docs = _documents(spark, sf_dir)
    model = langid.fit(docs.where(~_held_out(3, 1)))
    return langid.identify(docs, model).select("doc_id", _held_out(3, 1).alias("held_out"), "lang_pred", "score")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of smallest id that has the same words and blanks, by an index of digests."""
    return exact_dedup.equal_texts(spark, sf_dir)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hardest negatives of each anchor's best positives; anchors are a fiftieth of the vectors."""
    k = F.col("vec_id")
    label = F.when(k % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").select(k.alias("id"), label.alias("label"), F.col("embedding").alias("vector"), (k % 50 == 0).alias("anchor")))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in its fill-in-middle form; digests of that and of the text rebuilt from it."""
    found = fim.transformed(_documents(spark, sf_dir))
    digests = {"output_sha256": F.col("output"), "restored_sha256": fim.restored(F.col("output"), F.col("form"))}
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *[F.sha2(c, 256).alias(name) for name, c in digests.items()])


def _op1_sql() -> str:
    def fits(rule: str) -> str:
        host, slash, path = rule.partition("/")
        return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash}{path}')"

    def like(glob: str) -> str:
        return "%" + glob.lstrip("*").replace("_", r"\_").replace("*", "%").replace("?", "_")

    ranked = sorted(HOST_RULES, key=lambda r: -len(r[1]))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in ranked)
    verdict = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in ranked)
    globs = " OR ".join(rf"whole LIKE '{like(g)}' ESCAPE '\'" for g in BLOCK_GLOBS)
    plain = "path"
    for c in UNRESERVED:
        for code in sorted({f"%{ord(c):02x}", f"%{ord(c):02X}"}):
            plain = f"replace({plain}, '{code}', '{c}')"
    return rf"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
ruled AS (
  SELECT *, CASE {rule} END AS rule,
         '.' || rtrim(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') || {plain} AS whole FROM parts)
SELECT page_id, host, path, rule, CASE {verdict} WHEN {globs} THEN 'block' ELSE 'allow' END AS verdict FROM ruled"""


# both sides turn by turn; the prompt ends where they first differ, or where the shorter one ends
_OP8_SQL = """
WITH said AS (
  SELECT coalesce('c' || conv_id, 'l' || row_number() OVER ()) AS conv, conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS i FROM said),
answers AS (SELECT conv, conv_id, i, text, row_number() OVER w - 1 AS nth, count(*) OVER (PARTITION BY conv) AS m, lead(text) OVER w AS next, first_value(text) OVER w AS first FROM placed WHERE role = 'assistant' WINDOW w AS (PARTITION BY conv ORDER BY i)),
stale AS (
  SELECT conv, i AS place, CASE WHEN coalesce(next, first) = text THEN '' ELSE coalesce(next, first) END AS bad FROM answers
  WHERE nth = CASE coalesce(conv_id, 0) % 3 WHEN 0 THEN 0 WHEN 1 THEN m // 2 ELSE m - 1 END),
sizes AS (SELECT conv, any_value(conv_id) AS conv_id, count(*) AS m FROM placed GROUP BY conv),
turns AS (
  SELECT 0 AS side, conv, i, role, text FROM placed
  UNION ALL SELECT 1, p.conv, i, role, CASE WHEN i = place THEN bad ELSE text END FROM placed p LEFT JOIN stale USING (conv) WHERE place IS NULL OR i <= place OR coalesce(conv_id, 0) % 4 <> 2
  UNION ALL SELECT 1, conv, m + 1, 'user', 'Try again.' FROM sizes JOIN stale USING (conv) WHERE coalesce(conv_id, 0) % 4 = 3),
apart AS (
  SELECT conv, min(i) AS z FROM (SELECT conv, i FROM turns GROUP BY conv, i HAVING count(*) < 2 OR count(DISTINCT role || chr(1) || text) > 1) GROUP BY conv),
shown AS (
  SELECT t.*, coalesce(z, m + 2) AS z, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS turn, length(role) + 5 AS head, length(text) + 8 AS body
  FROM turns t JOIN sizes USING (conv) LEFT JOIN apart USING (conv)),
spans AS (SELECT *, coalesce(sum(head + body) FILTER (WHERE i >= z) OVER (PARTITION BY conv, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM shown),
sides AS (
  SELECT conv, side, count(*) FILTER (WHERE i < z) AS n, coalesce(string_agg(turn, '' ORDER BY i) FILTER (WHERE i < z), '') AS prompt, coalesce(string_agg(turn, '' ORDER BY i) FILTER (WHERE i >= z), '') AS rest,
         coalesce(string_agg((before + head) || ':' || body, ',' ORDER BY i) FILTER (WHERE i >= z AND role = 'assistant'), '') AS scored
  FROM spans GROUP BY conv, side)
SELECT conv_id, a.n::BIGINT AS n_prompt_turns, a.prompt, a.rest AS chosen, coalesce(b.rest, '') AS rejected, a.scored AS chosen_scored, coalesce(b.scored, '') AS rejected_scored
FROM sizes JOIN sides a USING (conv) LEFT JOIN sides b ON b.conv = a.conv AND b.side = 1 WHERE a.side = 0"""

_OP3_SQL = r"""
WITH words AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, greatest(len(w) - 18, 1))) AS s, md5(array_to_string(w[s : s + 19], ' ')) AS h
  FROM words WHERE len(w) >= 20),
ranked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS r FROM windows),
gone AS (SELECT DISTINCT doc_id, s + k AS p FROM ranked, (SELECT unnest(range(20)) AS k) WHERE r > 1),
lost AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
kept AS (
  SELECT words.doc_id, w, coalesce(len(ps), 0) AS n,
         CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END AS k
  FROM words LEFT JOIN lost USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, n::BIGINT AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept"""


_OP11_SQL = r"""
WITH digests AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM digests WINDOW same AS (PARTITION BY text_sha256)"""

_OP12_SQL = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER best::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER best <= 3"""

_OP13_SQL = r"""
WITH tokens AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (
  SELECT *, len(t)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(t) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(t) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM tokens),
cut AS (
  SELECT *, array_to_string(t[1 : least(a, b)], '') AS prefix, array_to_string(t[least(a, b) + 1 : greatest(a, b)], '') AS middle, array_to_string(t[greatest(a, b) + 1 :], '') AS suffix FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": _op1_sql(), "op3_substring_dedup": _OP3_SQL, "op8_chat_formatting": _OP8_SQL, "op11_exact_dedup": _OP11_SQL, "op12_hard_negatives": _OP12_SQL, "op13_fim": _OP13_SQL}
