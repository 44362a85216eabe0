"""The registered queries of the document operators and their SQL, where SQL can express them."""
import public_tokenizers

from dialoom.llm import bpe, fill_in_middle, fingerprints, jaccard_join, language_id, line_dedup, packing, prefix_trie, quality_classifier, quality_rules, simhash, suffix_dedup, toxicity
from dialoom.llm.common import documents, labels, small_batches


def op1_toxicity(spark, sf_dir):
    return toxicity.op1(documents(spark, sf_dir), labels(spark, sf_dir))


def op2_fingerprints(spark, sf_dir):
    return fingerprints.op2(documents(spark, sf_dir))


def op3_packing(spark, sf_dir):
    return packing.op3(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op4_simhash(spark, sf_dir):
    return simhash.op4(documents(spark, sf_dir))


def op5_quality_classifier(spark, sf_dir):
    return quality_classifier.op5(documents(spark, sf_dir), labels(spark, sf_dir))


def op6_suffix_dedup(spark, sf_dir):
    small_batches(spark)
    return suffix_dedup.op6(documents(spark, sf_dir))


def op7_byte_bpe(spark, sf_dir):
    small_batches(spark)
    return bpe.op7(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_line_dedup(spark, sf_dir):
    return line_dedup.op8(documents(spark, sf_dir))


def op9_language_id(spark, sf_dir):
    return language_id.op9(documents(spark, sf_dir))


def op10_quality_rules(spark, sf_dir):
    return quality_rules.op10(documents(spark, sf_dir))


def op11_prefix_trie(spark, sf_dir):
    """All nodes of the prefix trie of the rebuilt conversations."""
    return prefix_trie.op11(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_fill_in_middle(spark, sf_dir):
    """Every document cut into prefix, middle and suffix, with digests of the output and of the text rebuilt from it."""
    small_batches(spark)
    return fill_in_middle.op12(documents(spark, sf_dir))


def op13_jaccard_join(spark, sf_dir):
    """Shingle sets of all documents joined at a Jaccard similarity of 0.85, as components."""
    small_batches(spark)
    return jaccard_join.op13(documents(spark, sf_dir))


QUERIES = {q.__name__: q for q in (op1_toxicity, op2_fingerprints, op3_packing, op4_simhash, op5_quality_classifier, op6_suffix_dedup, op7_byte_bpe, op8_line_dedup, op9_language_id, op10_quality_rules,
                                   op11_prefix_trie, op12_fill_in_middle, op13_jaccard_join)}
ORACLES = {
    # XXH3 digests and the cuckoo filters only decide which lines are looked up; the result is plain counting.
    "op8_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, i, line, lower_key FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i,
           translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key
    FROM documents)),
common AS (SELECT lower_key FROM lines WHERE length(lower_key) >= 1 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 10)
SELECT l.doc_id, count(*) AS n_lines, count(c.lower_key) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE c.lower_key IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN common c ON l.lower_key = c.lower_key GROUP BY l.doc_id""",
    "op10_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, text AS given, coalesce(text, '') AS text FROM documents),
base AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    regexp_extract_all(translate(text, '.,;:!?''"()-ABCDEFGHIJKLMNOPQRSTUVWXYZ', '           abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS plain,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
starts AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS times
    FROM (SELECT r, i, array_to_string(words[i:i + 7], ' ') AS w FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM base WHERE len(words) > 8))) WHERE times > 1),
repeated AS (SELECT r, count(DISTINCT i + k) AS n FROM starts, range(8) AS g(k) GROUP BY r),
rules AS (
  SELECT base.*, len(words) AS n_words, list_sum(list_transform(words, lambda w: length(w))) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM base LEFT JOIN repeated USING (r)),
counted AS (
  SELECT r, lang, strlen(text) AS size, given IS NOT NULL AS there, length(text) - length(regexp_replace(text, '[a-z]', '', 'g')) AS c0, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS c1,
    length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS c2, length(text) - length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS c3,
    length(text) - length(regexp_replace(text, '[.,;:!?''"()\-]', '', 'g')) AS c4, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS c5,
    length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) AS ascii FROM d),
classes AS (SELECT r, lang, size, k, v FROM (SELECT r, lang, size, there, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS k,
    unnest([c0, c1, c2, c3, c4, c5, ascii - c0 - c1 - c2 - c3 - c4 - c5, size - ascii]) AS v FROM counted) WHERE there),
class_ref AS (SELECT lang, k, sum(v) / greatest(1, sum(sum(v)) OVER (PARTITION BY lang)) AS q FROM classes WHERE lang IS NOT NULL GROUP BY lang, k),
langs AS (SELECT DISTINCT lang FROM class_ref),
js AS (SELECT r, f.lang, sqrt(least(1, greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2))) AS far
  FROM (SELECT r, k, v / size AS p FROM classes WHERE size >= 300) c JOIN class_ref f USING (k) GROUP BY r, f.lang),
tokens AS (SELECT r, lang, unnest(plain) AS w FROM base WHERE given IS NOT NULL),
word_ref AS (SELECT lang, w, n / total AS q FROM (SELECT lang, w, count(*) AS n, sum(count(*)) OVER (PARTITION BY lang) AS total, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, w) AS place
  FROM tokens WHERE lang IS NOT NULL GROUP BY lang, w) WHERE place <= 100),
judged AS (SELECT r, len(plain) AS n FROM rules WHERE n_words >= 80 AND len(plain) >= 80),
met AS (SELECT r, f.lang, f.q, t.c / n AS p FROM (SELECT r, w, count(*) AS c FROM tokens GROUP BY r, w) t JOIN judged USING (r) JOIN word_ref f USING (w)),
known AS (SELECT lang, sum(q) AS q FROM word_ref GROUP BY lang),
sums AS (SELECT j.r, k.lang, coalesce(sum(m.p), 0) AS p, coalesce(sum(m.q), 0) AS q_met, any_value(k.q) AS q_all,
    coalesce(sum(m.p * log2(m.p / ((m.p + m.q) / 2)) + m.q * log2(m.q / ((m.p + m.q) / 2))), 0) AS s FROM judged j CROSS JOIN known k LEFT JOIN met m ON m.r = j.r AND m.lang = k.lang GROUP BY j.r, k.lang),
jw AS (SELECT r, lang, sqrt(least(1, greatest(0, (s + (q_all - q_met) + CASE WHEN po > 0 THEN po * log2(po / ((po + qo) / 2)) ELSE 0 END + CASE WHEN qo > 0 THEN qo * log2(qo / ((po + qo) / 2)) ELSE 0 END) / 2))) AS far
  FROM (SELECT *, 1 - p AS po, greatest(0, 1 - q_all) AS qo FROM sums)),
best AS (SELECT rules.r, arg_min(coalesce(js.far, 0), coalesce(js.far, 0) + coalesce(jw.far, 0)) AS by_char, arg_min(coalesce(jw.far, 0), coalesce(js.far, 0) + coalesce(jw.far, 0)) AS by_word
  FROM rules CROSS JOIN langs l LEFT JOIN js ON js.r = rules.r AND js.lang = l.lang LEFT JOIN jw ON jw.r = rules.r AND jw.lang = l.lang GROUP BY rules.r)
SELECT doc_id, n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND coalesce(by_char, 0) <= 0.30 AND coalesce(by_word, 0) <= 0.50 AS kept
FROM rules LEFT JOIN best USING (r)""",
    # Rebuilt conversations as lists, crc32 bit by bit; fingerprints are only a shorter name for a list.
    "op11_prefix_trie": r"""
WITH ids AS (SELECT conv_id AS c, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, 3988292384::BIGINT * (v & 1)))) AS r
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
given AS (SELECT conv_id AS c, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
drawn AS (SELECT g.c, own, xor(r, 4294967295::BIGINT) % 6 AS h FROM given g JOIN ids USING (c)),
full_seq AS (SELECT d.c, list_concat(coalesce(b.own, [])[1:d.h], d.own[d.h + 1:]) AS seq FROM drawn d LEFT JOIN given b ON b.c = d.c - d.c % 100),
members AS (SELECT c, k AS d, seq[1:k] AS prefix, len(seq) = k AS is_end FROM (SELECT c, seq, unnest(range(0, len(seq) + 1)) AS k FROM full_seq)),
nodes AS (SELECT d, prefix, min(c) AS conv_id, count(*) AS n_convs, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE is_end) AS ends FROM members GROUP BY d, prefix),
kids AS (SELECT d - 1 AS d, prefix[1:d - 1] AS prefix, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
valued AS (SELECT n.*, coalesce(k.n, 0) AS n_children, CASE WHEN n.d > 0 THEN (n_convs - 1) * length(n.prefix[n.d].text) ELSE 0 END AS saved FROM nodes n LEFT JOIN kids k ON k.d = n.d AND k.prefix = n.prefix),
above AS (SELECT k AS d, prefix[1:k] AS prefix, saved, n_children FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM valued)),
sums AS (SELECT d, prefix, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM above GROUP BY d, prefix)
SELECT v.conv_id, v.d AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM valued v JOIN sums s ON s.d = v.d AND s.prefix = v.prefix LEFT JOIN nodes p ON p.d = v.d - 1 AND p.prefix = v.prefix[1:v.d - 1]""",
    # Cut by code points; the markers are told apart from the text by the rule that a text with a marker stays plain.
    "op12_fill_in_middle": r"""
WITH drawn AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT *, ('0x' || substr(s, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substr(s, 9, 8))::BIGINT % (n + 1) AS y,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(s, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
       WHEN ('0x' || substr(s, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
cut AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b FROM h),
parts AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1, n - b) AS suffix FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM parts""",
    # All pairs that share a shingle, without any filter; components by closure.
    "op13_jaccard_join": r"""
WITH RECURSIVE split AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(1, len(w) - 3) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM split),
rows_of AS (SELECT r, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.r AS u, b.r AS v FROM rows_of a JOIN rows_of b ON a.x = b.x AND a.r <> b.r GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT r AS u, r AS v FROM sets UNION SELECT p.u, l.v FROM reach p JOIN links l ON p.v = l.u)
SELECT any_value(s.doc_id) AS doc_id, any_value(len(s.s)) AS n_shingles, min(t.doc_id) AS component_id FROM reach p JOIN sets s ON s.r = p.u JOIN sets t ON t.r = p.v GROUP BY p.u""",
}
