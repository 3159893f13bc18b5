"""DuckDB twins of the queries, written from the definitions and not from the Spark expressions."""

from __future__ import annotations

from ..functions.wordlists import ABBREVIATIONS, STOPWORDS, SYNONYMS

SPACE = r"\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
CLOSERS = r"""["''）)\]”’»]"""
PUNCT = r"[!-/:-@\[-`{-~]"
DIGITS = r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]"
WORD = r"[A-Za-z]+(?:''[A-Za-z]+)*|\p{Nd}+(?:[.,]\p{Nd}+)*"
LIST = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


def plain(c: str) -> str:
    return f"lower(regexp_replace({c}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g'))"


def r9(x: str) -> str:
    return f"round({x}, 9) + 0.0"


def r11(x: str) -> str:
    return f"round({x}, 11) + 0.0"


def div(a: str, b: str, other: str = "0.0") -> str:
    return f"CASE WHEN ({b}) = 0 THEN {other} ELSE ({a})::DOUBLE / ({b}) END"


def sentences(source: str = "documents", key: str = "doc_id") -> str:
    """CTEs up to sent(key, sid, start_pos, end_pos, sentence): pieces of a text, their places, boundaries, running counts."""
    return rf"""
pieces AS (SELECT {key}, unnest(ps) AS piece, generate_subscripts(ps, 1) AS k FROM
  (SELECT {key}, regexp_extract_all(text, '(?s)\n[ \t]*\n+|[.!?]+{CLOSERS}*|[A-Za-z][A-Za-z'']*|.') AS ps FROM {source} WHERE text IS NOT NULL)),
placed AS (SELECT *, sum(length(piece)) OVER w - length(piece) AS off, lead(piece) OVER w AS nxt, lag(piece) OVER w AS prv FROM pieces WINDOW w AS (PARTITION BY {key} ORDER BY k)),
marked AS (SELECT *, regexp_full_match(piece, '\n[ \t]*\n+') AS para,
  regexp_matches(piece, '^[.!?]') AND (nxt IS NULL OR regexp_matches(nxt, '^[{SPACE}]'))
  AND NOT (regexp_full_match(piece, '\.{CLOSERS}*') AND coalesce(regexp_matches(prv, '^[A-Za-z]') AND (length(prv) = 1 OR lower(prv) IN ({LIST(ABBREVIATIONS)})), false)) AS ends FROM placed),
numbered AS (SELECT *, coalesce(sum((para OR ends)::INT) OVER (PARTITION BY {key} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM marked),
bodies AS (SELECT {key}, seg, string_agg(piece, '' ORDER BY k) AS body, min(off) AS off FROM numbered WHERE NOT para GROUP BY {key}, seg),
trimmed AS (SELECT {key}, seg, (off + length(body) - length(regexp_replace(body, '^[{SPACE}]+', '')))::INT AS start_pos, regexp_replace(body, '^[{SPACE}]+|[{SPACE}]+$', '', 'g') AS sentence FROM bodies WHERE regexp_matches(body, '[^{SPACE}]')),
sent AS (SELECT {key}, (row_number() OVER (PARTITION BY {key} ORDER BY seg) - 1)::INT AS sid, start_pos, (start_pos + length(sentence))::INT AS end_pos, sentence FROM trimmed)"""


def words(key: str = "doc_id") -> str:
    """CTEs up to word(key, sid, pos, word) and tok(key, i, w): words of each sentence, and of each text with places from 0."""
    return rf""",
wl AS (SELECT {key}, sid, start_pos, end_pos, regexp_extract_all(sentence, '{WORD}') AS ws, sentence FROM sent),
word AS (SELECT {key}, sid, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM wl),
tok AS (SELECT {key}, sid, pos, word, lower(word) AS w, row_number() OVER (PARTITION BY {key} ORDER BY sid, pos) - 1 AS i, count(*) OVER (PARTITION BY {key}) AS n FROM word)"""


KEYS = ", keys AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL)"
BASE = "WITH RECURSIVE none AS (SELECT 1)," + sentences() + words() + KEYS

SENTENCE = f""", sw AS (SELECT doc_id, len(ws) AS n, end_pos - start_pos AS c FROM wl),
sa AS (SELECT doc_id, count(*) AS k, avg(n) AS m, stddev_pop(n) AS s, min(n) AS lo, max(n) AS hi, avg(c) AS cm, stddev_pop(c) AS cs FROM sw GROUP BY doc_id),
fs AS (SELECT keys.doc_id, coalesce(k, 0)::DOUBLE AS sent_count, coalesce(m, 0.0) AS sent_mean_len_words, coalesce(s, 0.0) AS sent_std_len_words, coalesce(lo, 0)::DOUBLE AS sent_min_len_words, coalesce(hi, 0)::DOUBLE AS sent_max_len_words,
  coalesce(cm, 0.0) AS sent_mean_len_chars, coalesce(cs, 0.0) AS sent_std_len_chars, {div('coalesce(s, 0.0)', 'abs(coalesce(m, 0.0))')} AS sent_len_words_cv, {div('coalesce(s - m, 0.0)', 'coalesce(s + m, 0.0)')} AS sent_len_words_burstiness FROM keys LEFT JOIN sa USING (doc_id))"""
LEXICAL = f""", ty AS (SELECT doc_id, w, count(*) AS c FROM tok GROUP BY doc_id, w),
ta AS (SELECT doc_id, count(*) AS types, sum((c = 1)::INT) AS once, sum(c) AS n FROM ty GROUP BY doc_id),
win AS (SELECT a.doc_id, a.i, count(DISTINCT b.w) / 50.0 AS t FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 49 WHERE a.n > 50 AND a.i <= a.n - 50 GROUP BY a.doc_id, a.i),
ma AS (SELECT doc_id, avg(t) AS mattr FROM win GROUP BY doc_id),
fl AS (SELECT keys.doc_id, coalesce(types::DOUBLE / n, 0.0) AS lex_ttr, coalesce(mattr, types::DOUBLE / n, 0.0) AS lex_mattr_w50, coalesce(once::DOUBLE / types, 0.0) AS lex_hapax_ratio FROM keys LEFT JOIN ta USING (doc_id) LEFT JOIN ma USING (doc_id))"""
REPETITION = """, gr AS (SELECT doc_id, w AS g1, CASE WHEN i <= n - 2 THEN w || ' ' || lead(w) OVER o END AS g2, CASE WHEN i <= n - 3 THEN w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o END AS g3 FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
gd AS (SELECT doc_id, count(DISTINCT g1)::DOUBLE / count(g1) AS d1, CASE WHEN count(g2) = 0 THEN 1.0 ELSE count(DISTINCT g2)::DOUBLE / count(g2) END AS d2, CASE WHEN count(g3) = 0 THEN 1.0 ELSE count(DISTINCT g3)::DOUBLE / count(g3) END AS d3 FROM gr GROUP BY doc_id),
m2 AS (SELECT doc_id, max(c)::DOUBLE / sum(c) AS t2 FROM (SELECT doc_id, g2, count(*) AS c FROM gr WHERE g2 IS NOT NULL GROUP BY ALL) GROUP BY doc_id),
m3 AS (SELECT doc_id, max(c)::DOUBLE / sum(c) AS t3 FROM (SELECT doc_id, g3, count(*) AS c FROM gr WHERE g3 IS NOT NULL GROUP BY ALL) GROUP BY doc_id),
fw AS (SELECT doc_id, 1.0 - count(DISTINCT w)::DOUBLE / count(*) AS again FROM tok WHERE pos = 0 GROUP BY doc_id),
fr AS (SELECT keys.doc_id, coalesce(d1, 1.0) AS rep_distinct_1, coalesce(d2, 1.0) AS rep_distinct_2, coalesce(d3, 1.0) AS rep_distinct_3, coalesce(t2, 0.0) AS rep_top_bigram_share, coalesce(t3, 0.0) AS rep_top_trigram_share, coalesce(again, 0.0) AS rep_repeated_sentence_start_ratio
  FROM keys LEFT JOIN gd USING (doc_id) LEFT JOIN m2 USING (doc_id) LEFT JOIN m3 USING (doc_id) LEFT JOIN fw USING (doc_id))"""


def style(common: str) -> str:
    count = lambda p: f"(length(text) - length(regexp_replace(text, '{p}', '', 'g')))"
    solid = f"length(regexp_replace(text, '[{SPACE}]', '', 'g'))"
    return rf""", tw AS (SELECT doc_id, count(*) AS n, sum((w IN ({LIST(STOPWORDS)}))::INT) AS stop, sum((w IN ({LIST(STOPWORDS)}) OR {common})::INT) AS com, sum(length(w)) AS chars, sum((length(word) > 1 AND regexp_full_match(word, '[A-Z]+(''[A-Z]+)*'))::INT) AS caps FROM tok GROUP BY doc_id),
fy AS (SELECT keys.doc_id, coalesce(stop::DOUBLE / n, 0.0) AS style_stopword_ratio, coalesce(com::DOUBLE / n, 0.0) AS style_common_word_ratio, coalesce(chars::DOUBLE / n, 0.0) AS style_avg_word_length,
  {div(count('[!-/:-@[-`{-~]'), solid)} AS style_punct_char_ratio, coalesce({count(',')}::DOUBLE / n, 0.0) AS style_comma_rate, coalesce({count(';')}::DOUBLE / n, 0.0) AS style_semicolon_rate,
  {div(count(DIGITS), solid)} AS style_digit_char_ratio, coalesce(caps::DOUBLE / n, 0.0) AS style_allcaps_word_ratio FROM keys LEFT JOIN tw USING (doc_id))"""


LEXICON = "w IN (SELECT lower(token) FROM lexicon)"
NAMES = {
    "fs": "sent_count sent_mean_len_words sent_std_len_words sent_min_len_words sent_max_len_words sent_mean_len_chars sent_std_len_chars sent_len_words_cv sent_len_words_burstiness".split(),
    "fl": "lex_ttr lex_mattr_w50 lex_hapax_ratio".split(),
    "fr": "rep_distinct_1 rep_distinct_2 rep_distinct_3 rep_top_bigram_share rep_top_trigram_share rep_repeated_sentence_start_ratio".split(),
    "fy": "style_stopword_ratio style_common_word_ratio style_avg_word_length style_punct_char_ratio style_comma_rate style_semicolon_rate style_digit_char_ratio style_allcaps_word_ratio".split(),
}


def feats(*tables: str) -> str:
    cols = ", ".join(f"{r9(c)} AS {c}" for t in tables for c in NAMES[t])
    joins = tables[0] + "".join(f" JOIN {t} USING (doc_id)" for t in tables[1:])
    return f" SELECT doc_id, {cols} FROM {joins}"


LEX = ", lx AS (SELECT lower(token) AS w, max(logprob) AS logprob, arg_max(struct_pack(e := entropy), logprob).e AS entropy FROM lexicon WHERE token IS NOT NULL GROUP BY lower(token)), sc AS (SELECT doc_id, sid, pos, word, coalesce(logprob, -2.0) AS logprob, entropy FROM tok LEFT JOIN lx USING (w))"
PERPLEXITY = f""", b AS (SELECT *, -logprob / ln(2.0) AS bits FROM sc),
ps AS (SELECT doc_id, sid, exp(-avg(logprob)) AS p FROM b GROUP BY doc_id, sid), pd AS (SELECT doc_id, avg(p) AS m, stddev_pop(p) AS s, min(p) AS lo, max(p) AS hi FROM ps GROUP BY doc_id),
pt AS (SELECT doc_id, avg(logprob) AS lp, avg(bits) AS mb, stddev_pop(bits) AS sb, max(bits) AS xb, avg(entropy) AS em, stddev_pop(entropy) AS es, count(entropy) AS en FROM b GROUP BY doc_id)
SELECT doc_id, {', '.join(f'{r9(e)} AS ppl_{n}' for n, e in {
    'doc_perplexity': 'exp(-lp)', 'mean_token_logprob': 'lp', 'mean_surprisal_bits': 'mb', 'std_surprisal_bits': 'sb', 'max_surprisal_bits': 'xb', 'sent_ppl_mean': 'm', 'sent_ppl_std': 's', 'sent_ppl_var': 's * s', 'sent_ppl_range': 'hi - lo', 'sent_ppl_min': 'lo', 'sent_ppl_max': 'hi',
    'sent_ppl_cv': 's / abs(m)', 'sent_ppl_burstiness': '(s - m) / (s + m)', 'entropy_mean': 'coalesce(em, 0.0)', 'entropy_std': 'coalesce(es, 0.0)', 'has_entropy': '(en > 0)::INT::DOUBLE'}.items())} FROM pt JOIN pd USING (doc_id)"""

RQ6 = LEX + rf""", rq AS (SELECT doc_id, sid, sentence, end_pos - start_pos AS chars, list_transform(ws, lambda x: lower(x)) AS l, len(ws) AS n FROM wl),
rf AS (SELECT doc_id, sid, chars, n AS words, {div('len(list_distinct(l))', 'n')} AS ttr, {div("len(list_distinct(list_transform(range(1, n), lambda i: l[i] || ' ' || l[i + 1])))", 'greatest(n - 1, 0)', '1.0')} AS d2,
  {div('coalesce(list_sum(list_transform(l, lambda x: length(x))), 0)', 'n')} AS size, {div("length(sentence) - length(regexp_replace(sentence, '" + PUNCT + "', '', 'g'))", f"length(regexp_replace(sentence, '[{SPACE}]+', '', 'g'))")} AS punct FROM rq),
rb AS (SELECT doc_id, sid, exp(-avg(logprob)) AS ppl, avg(-logprob / ln(2.0)) AS bits FROM sc GROUP BY doc_id, sid),
rp AS (SELECT rf.*, coalesce(ppl, 1.0) AS ppl, coalesce(bits, 0.0) AS bits, 1 / (1 + exp(-((chars - 70.0) / 40.0 * 0.5 + (punct - 0.03) / 0.03 * 0.7 + 0.2))) AS a,
  1 / (1 + exp(-(1.2 * ((words - 13.0) / 5.0 * 0.6 - (ttr - 0.8) / 0.15 * 0.4 + (d2 - 0.95) / 0.05 * 0.25 + (size - 4.0) / 0.7 * 0.8 - 0.1) + 0.05))) AS b FROM rf LEFT JOIN rb USING (doc_id, sid))
""" + " UNION ALL ".join(f"SELECT '{k}' AS signal, count(*) AS n, {r9(f'coalesce(corr(a, {c}), 0.0)')} AS r FROM rp" for k, c in (("neural_vs_classical_prob", "b"), ("neural_vs_ppl_doc_perplexity", "ppl"), ("neural_vs_ppl_mean_surprisal_bits", "bits"), ("neural_vs_lex_ttr", "ttr"), ("neural_vs_sent_mean_len_words", "words")))


REC = "rec AS (SELECT * FROM records WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, row_no DESC) = 1)"
SCO = "sco AS (SELECT * FROM sentence_scores QUALIFY row_number() OVER (PARTITION BY score_id ORDER BY scored_at DESC, p_ai DESC NULLS LAST) = 1)"
DEC = """agg AS (SELECT record_id AS id, count(*) AS n_sentences, avg(p_ai) AS mean_p_ai, avg((p_ai >= 0.5)::INT) AS frac_ai_sentences, stddev_pop(p_ai) AS dispersion FROM sco WHERE p_ai IS NOT NULL AND record_id IS NOT NULL GROUP BY record_id),
mx AS (SELECT *, mean_p_ai BETWEEN 0.45 AND 0.85 AND dispersion >= 0.10 AS mixed FROM agg),
pm AS (SELECT *, CASE WHEN mixed THEN 0.5 + 0.4 * least((mean_p_ai - 0.45) / 0.1, (0.85 - mean_p_ai) / 0.1, 1.0) ELSE 0.0 END AS p_mixed FROM mx),
dec AS (SELECT id, n_sentences, mean_p_ai, frac_ai_sentences, dispersion, CASE WHEN mixed THEN 'mixed' WHEN mean_p_ai >= 0.55 THEN 'ai' ELSE 'human' END AS label, (1 - p_mixed) * (1 - mean_p_ai) AS p_human, (1 - p_mixed) * mean_p_ai AS p_ai, p_mixed FROM pm)"""
JUD = f"""jud AS (SELECT rec.id, {plain('rec.label')} AS label, {plain('generation.model_family')} AS model_family, round(mean_p_ai, 9) AS p FROM rec JOIN dec ON dec.id = rec.id WHERE {plain('rec.label')} IN ('human', 'ai')), j AS (SELECT *, (label = 'ai')::INT AS y FROM jud)"""
WITH_J = f"WITH {REC}, {SCO}, {DEC}, {JUD}"
METRICS = f"""count(*) AS n, sum((p >= 0.5 AND y = 1)::INT)::BIGINT AS tp, sum((p >= 0.5 AND y = 0)::INT)::BIGINT AS fp, sum((p < 0.5 AND y = 0)::INT)::BIGINT AS tn, sum((p < 0.5 AND y = 1)::INT)::BIGINT AS fn, avg((p - y) * (p - y)) AS brier"""
RATIOS = f"""n, tp, fp, tn, fn, {r9('brier')} AS brier, {r9('(tp + tn)::DOUBLE / n')} AS accuracy, {r9(div('tp', 'tp + fp'))} AS precision, {r9(div('tp', 'tp + fn'))} AS recall, {r9(div('2 * tp', '2 * tp + fp + fn'))} AS f1"""


def auroc(table: str, by: str = "") -> str:
    """By the definition: the share of (positive, negative) pairs in the right order, ties half; through average ranks."""
    g, pb = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    grp = f" GROUP BY {by}" if by else ""
    return f"(SELECT {g}CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN (sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) END AS auroc FROM (SELECT *, rank() OVER ({pb}ORDER BY p) + (count(*) OVER (PARTITION BY {g}p) - 1) / 2.0 AS rk FROM {table}){grp})"


TRUTH = f"""st AS (SELECT s.score_id, s.start_pos, s.end_pos, s.p_ai, {plain('r.label')} AS label, CASE {plain('r.label')} WHEN 'human' THEN 0 WHEN 'ai' THEN 1 WHEN 'mixed' THEN coalesce(len(list_filter(r.spans, lambda x: x.label = 'ai' AND x."start" <= (s.start_pos + s.end_pos) / 2.0 AND (s.start_pos + s.end_pos) / 2.0 < x."end")) > 0, false)::INT END AS y
  FROM sco s JOIN rec r ON r.id = s.record_id WHERE s.start_pos IS NOT NULL AND s.end_pos > s.start_pos)"""
EDGES = [0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9]
FOUR = ["sent_mean_len_words", "lex_ttr", "rep_distinct_2", "style_avg_word_length"]
ALL = SENTENCE + LEXICAL + REPETITION + style(LEXICON)
LAB = f""", lab AS (SELECT f.doc_id, {plain('d.label')} AS label, {', '.join(FOUR)} FROM fs f JOIN fl USING (doc_id) JOIN fr USING (doc_id) JOIN fy USING (doc_id) JOIN documents d ON d.doc_id = f.doc_id WHERE {plain('d.label')} IN ('human', 'ai')),
longf AS (UNPIVOT lab ON {', '.join(FOUR)} INTO NAME feature VALUE x)"""
DIST = ", dist AS (SELECT label, feature, avg(x) AS mean, stddev_pop(x) AS std, quantile_cont(x, 0.05) AS p05, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.75) AS p75, quantile_cont(x, 0.95) AS p95 FROM longf GROUP BY label, feature)"
SCORE = "-0.1 + (sent_mean_len_words - 13.0) / 5.0 * 0.6 + (lex_ttr - 0.8) / 0.15 * -0.4 + (rep_distinct_2 - 0.95) / 0.05 * 0.25 + (style_avg_word_length - 4.0) / 0.7 * 0.8"
FAMILY = "CASE WHEN regexp_matches(lower(m), 'davinci|gpt-3\\.5|trubo|turbo') THEN 'gpt-3.5' WHEN regexp_matches(lower(m), 'glm') THEN 'glm' WHEN regexp_matches(lower(m), 'llama|^_?(7|13|30|65)b') THEN 'llama' WHEN regexp_matches(lower(m), 'flan_t5') THEN 'flan-t5' WHEN regexp_matches(lower(m), 'opt') THEN 'opt' WHEN regexp_matches(lower(m), 'gpt_j|gpt_neox|neox') THEN 'eleutherai' WHEN regexp_matches(lower(m), 'bloom|t0') THEN 'bigscience' WHEN m IS NOT NULL THEN 'other' END"
DIGIT = lambda *parts: f"(strpos('0123456789abcdef', md5(concat_ws(':', {', '.join(parts)}))[1]) - 1)"
SPANS = "coalesce(spans, [])"
EMPTY = lambda c: f"coalesce({c}, '') = ''"
RULES = {
    **{f"{c} is empty": EMPTY(c) for c in ("id", "text", "source", "group_id")},
    "unknown label": "NOT coalesce(label IN ('human', 'ai', 'mixed'), false)",
    "span bounds": f"len(list_filter({SPANS}, lambda s: coalesce(s.\"start\" < 0 OR s.\"end\" <= s.\"start\", true))) > 0",
    "unknown span label": f"len(list_filter({SPANS}, lambda s: NOT coalesce(s.label IN ('human', 'ai'), false))) > 0",
    "mixed needs spans of both kinds": f"label = 'mixed' AND NOT (len(list_filter({SPANS}, lambda s: s.label = 'human')) > 0 AND len(list_filter({SPANS}, lambda s: s.label = 'ai')) > 0)",
    "pure record has spans": f"label IN ('human', 'ai') AND len({SPANS}) > 0",
    "span past the text": f"len(list_filter({SPANS}, lambda s: s.\"end\" > length(coalesce(text, '')))) > 0",
    "spans overlap or are out of order": f"len(list_filter(range(1, len({SPANS})), lambda i: spans[i + 1].\"start\" < spans[i].\"end\")) > 0",
    "generation missing": "label IN ('ai', 'mixed') AND generation IS NULL",
    "human record has generation": "label = 'human' AND generation IS NOT NULL",
    "temperature out of range": "generation.temperature < 0",
    "top_p out of range": "generation.top_p < 0 OR generation.top_p > 1",
    "unknown split": "split IS NOT NULL AND split NOT IN ('train', 'val', 'test')",
}
VIOLATIONS = " UNION ALL ".join(f"SELECT '{k}' AS reason, count(*) AS n FROM records WHERE {c} HAVING count(*) > 0" for k, c in RULES.items()) + " UNION ALL SELECT 'duplicate id', count(*) FROM (SELECT id FROM records WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1) HAVING count(*) > 0"
SRC = f"CASE WHEN {plain('label')} = 'human' THEN source || '_human' ELSE replace({plain('source')}, '-', '_') || '_machine_topical_' || coalesce(model_family, 'x') END"

# native mixing: sides, hashed block sizes, turns, order, joined text and merged spans
MIXED = f"""WITH RECURSIVE dd AS (SELECT doc_id, {plain('label')} AS label, text FROM documents WHERE text IS NOT NULL),
hh AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS k FROM dd WHERE label = 'human'), aa AS (SELECT text, row_number() OVER (ORDER BY doc_id) AS k FROM dd WHERE label = 'ai'),
pairs AS (SELECT hh.doc_id, hh.text AS h, aa.text AS a FROM hh JOIN aa USING (k)),
src AS (SELECT doc_id || '/human' AS sk, h AS text FROM pairs UNION ALL SELECT doc_id || '/ai', a FROM pairs),{sentences('src', 'sk')},
ss AS (SELECT split_part(sk, '/', 1)::BIGINT AS doc_id, split_part(sk, '/', 2) AS label, sid AS i, sentence FROM sent),
ok AS (SELECT doc_id FROM ss GROUP BY doc_id HAVING count(DISTINCT label) = 2),
sz AS (SELECT *, {DIGIT('doc_id::VARCHAR', 'label', 'i::VARCHAR', "'0'")} % 3 + 1 AS z FROM ss WHERE doc_id IN (SELECT doc_id FROM ok)),
cum AS (SELECT *, sum(z) OVER (PARTITION BY doc_id, label ORDER BY i) AS e FROM sz),
blk AS (SELECT a.doc_id, a.label, a.i, a.sentence, (SELECT count(*) FROM cum b WHERE b.doc_id = a.doc_id AND b.label = a.label AND b.e <= a.i) AS b FROM cum a),
turn AS (SELECT *, 2 * b + CASE WHEN ({DIGIT('doc_id::VARCHAR', "'0'")} % 2 = 0) = (label = 'human') THEN 0 ELSE 1 END AS t FROM blk),
pos AS (SELECT *, coalesce(sum(length(sentence) + 1) OVER (PARTITION BY doc_id ORDER BY t, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, lag(label) OVER (PARTITION BY doc_id ORDER BY t, i) AS pl FROM turn),
run AS (SELECT *, sum((pl IS NULL OR pl <> label)::INT) OVER (PARTITION BY doc_id ORDER BY t, i) AS r FROM pos),
spn AS (SELECT doc_id, r, min(s) AS s, max(s + length(sentence)) AS e, any_value(label) AS label FROM run GROUP BY doc_id, r)
SELECT doc_id, string_agg(sentence, ' ' ORDER BY t, i) AS text, any_value(sp) AS spans FROM run JOIN (SELECT doc_id, string_agg(s::BIGINT || ':' || e::BIGINT || ':' || label, ',' ORDER BY s) AS sp FROM spn GROUP BY doc_id) USING (doc_id) GROUP BY doc_id"""

PARA = f"""WITH p AS (SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) - 1 AS i FROM (SELECT doc_id, regexp_extract_all(text, '(?s)[A-Za-z'']+|[^A-Za-z'']+') AS ps FROM documents WHERE text IS NOT NULL AND text <> '')),
syn(a, b) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in SYNONYMS.items())}),
q AS (SELECT doc_id, i, CASE WHEN b IS NOT NULL AND {DIGIT('doc_id::VARCHAR', 'i::VARCHAR', "'0'")} < 8 THEN CASE WHEN regexp_matches(piece, '^[A-Z]') THEN upper(b[1]) || b[2:] ELSE b END ELSE piece END AS piece FROM p LEFT JOIN syn ON lower(piece) = a)
SELECT doc_id, string_agg(piece, '' ORDER BY i) AS text FROM q GROUP BY doc_id UNION ALL SELECT doc_id, '' FROM documents WHERE text = ''"""

ORDER = "md5(concat_ws(':', doc_id::VARCHAR, '0'))"


def oracle_sql() -> dict[str, str]:
    bins = " + ".join(f"(p >= {e!r})::INT" for e in EDGES)
    z = lambda c: f"CASE WHEN {c}.std > 0 THEN (x - {c}.mean) / {c}.std ELSE 0.0 END"
    return {
        "sentences": BASE + " SELECT doc_id, sid, start_pos, end_pos, sentence FROM sent",
        "sentence_counts": BASE + " SELECT keys.doc_id, count(sid) AS n_sentences FROM keys LEFT JOIN sent USING (doc_id) GROUP BY keys.doc_id",
        "paragraph_counts": rf"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\n[ \t]*\n+'), lambda p: regexp_matches(p, '[^{SPACE}]')))::BIGINT AS n_paragraphs FROM documents WHERE text IS NOT NULL",
        "words": BASE + rf""", cov AS (SELECT doc_id, sid, start_pos, regexp_extract_all(sentence, '(?s){WORD}|.') AS cs FROM sent), cu AS (SELECT doc_id, sid, start_pos, unnest(cs) AS word, generate_subscripts(cs, 1) AS k FROM cov),
pl AS (SELECT *, start_pos + sum(length(word)) OVER (PARTITION BY doc_id, sid ORDER BY k) - length(word) AS s FROM cu), wd AS (SELECT * FROM pl WHERE regexp_full_match(word, '{WORD}'))
SELECT doc_id, sid, (row_number() OVER (PARTITION BY doc_id, sid ORDER BY k) - 1)::INT AS pos, word, s::INT AS start_pos, (s + length(word))::INT AS end_pos FROM wd""",
        "word_sentence_join": BASE + " SELECT doc_id, sid, count(*) AS n_words, arg_min(word, pos) AS first_word FROM word GROUP BY doc_id, sid",
        "span_round_trip": BASE + " SELECT count(*) AS n, 0::BIGINT AS broken FROM sent",
        "feat_sentence": BASE + SENTENCE + feats("fs"),
        "feat_lexical": BASE + LEXICAL + feats("fl"),
        "feat_repetition": BASE + REPETITION + feats("fr"),
        "feat_style": BASE + style(LEXICON) + feats("fy"),
        "feat_all_statistical": BASE + ALL + feats("fs", "fl", "fr", "fy"),
        "feature_rollup_by_lang": BASE + SENTENCE + LEXICAL + f" SELECT lang, count(*) AS n, {', '.join(f'{r9(f'avg({c})')} AS avg_{c}' for c in ('sent_count', 'sent_mean_len_words', 'sent_len_words_burstiness', 'lex_ttr', 'lex_mattr_w50'))} FROM fs JOIN fl USING (doc_id) JOIN documents USING (doc_id) GROUP BY lang",
        "fixed_scores": BASE + LEX + f" SELECT doc_id, sid, pos::INT AS pos, word, {r9('logprob')} AS logprob, {r9('entropy')} AS entropy FROM sc",
        "unigram_scores": BASE + f" SELECT w AS word, count(*) AS n, {r9('ln(count(*)::DOUBLE / (SELECT count(*) FROM tok))')} AS logprob FROM tok GROUP BY w",
        "feat_perplexity_fixed": BASE + LEX + PERPLEXITY,
        "sentence_statistics": BASE + LEX + f" SELECT doc_id, sid, count(*) AS n_tokens, {r9('avg(logprob)')} AS mean_logprob, {r9('avg(-logprob / ln(2.0))')} AS mean_surprisal_bits, {r9('exp(-avg(logprob))')} AS perplexity FROM sc GROUP BY doc_id, sid",
        "token_surprisal_series": BASE + LEX + rf""", cov AS (SELECT doc_id, sid, start_pos, regexp_extract_all(sentence, '(?s){WORD}|.') AS cs FROM sent), cu AS (SELECT doc_id, sid, start_pos, unnest(cs) AS token, generate_subscripts(cs, 1) AS k FROM cov),
pl AS (SELECT *, start_pos + sum(length(token)) OVER (PARTITION BY doc_id, sid ORDER BY k) - length(token) AS s FROM cu), wd AS (SELECT * FROM pl WHERE regexp_full_match(token, '{WORD}'))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INT AS k, s::INT AS start_pos, token, {r9('-coalesce(logprob, -2.0) / ln(2.0)')} AS surprisal_bits FROM wd LEFT JOIN lx ON lx.w = lower(token)""",
        "leakage_check": f"WITH {REC} SELECT group_id, string_agg(DISTINCT s, ',' ORDER BY s) AS splits, count(DISTINCT s) AS n_splits FROM (SELECT group_id, {plain('split')} AS s FROM rec) WHERE s IS NOT NULL AND group_id IS NOT NULL GROUP BY group_id HAVING count(DISTINCT s) > 1",
        "usable_docs": f"WITH RECURSIVE stripped AS (SELECT doc_id, regexp_replace(text, '^[{SPACE}]+|[{SPACE}]+$', '', 'g') AS text FROM documents WHERE text IS NOT NULL)," + sentences("stripped") + " SELECT doc_id, any_value(length(text)) AS n_chars FROM stripped JOIN sent USING (doc_id) WHERE length(text) BETWEEN 200 AND 4000 GROUP BY doc_id HAVING count(*) >= 3",
        "round_robin_sample": f"SELECT doc_id, source FROM (SELECT doc_id, {plain("coalesce(source, '?')")} AS source FROM documents WHERE text IS NOT NULL) ORDER BY row_number() OVER (PARTITION BY source ORDER BY {ORDER}, doc_id), source LIMIT 100",
        "balanced_boost": f"SELECT doc_id, label FROM (SELECT doc_id, text, {plain('label')} AS label FROM documents WHERE text IS NOT NULL AND label IS NOT NULL) d WHERE NOT EXISTS (SELECT 1 FROM records r WHERE r.text = d.text) QUALIFY row_number() OVER (PARTITION BY label ORDER BY {ORDER}, doc_id) <= 30",
        "anti_join_taken": "SELECT doc_id FROM documents WHERE text IS NOT NULL AND text NOT IN (SELECT text FROM documents WHERE length(text) < 40)",
        "class_distributions": BASE + ALL + LAB + DIST + f" SELECT label, feature, {', '.join(f'{r9(c)} AS {c}' for c in ('mean', 'std', 'p05', 'p25', 'p50', 'p75', 'p95'))} FROM dist",
        "scaler_stats": BASE + ALL + LAB + f" SELECT feature, {r9('avg(x)')} AS mean, {r9('stddev_pop(x)')} AS scale FROM longf GROUP BY feature",
        "feature_zscores": BASE + ALL + LAB + DIST + f", zz AS (SELECT l.doc_id, l.feature, {z('h')} AS zh, {z('a')} AS za FROM longf l JOIN dist h ON h.feature = l.feature AND h.label = 'human' JOIN dist a ON a.feature = l.feature AND a.label = 'ai') SELECT doc_id, feature, {r9('zh')} AS z_vs_human, {r9('za')} AS z_vs_ai, CASE WHEN abs(abs(zh) - abs(za)) < 0.25 THEN 'similar' WHEN abs(zh) < abs(za) THEN 'human' ELSE 'ai' END AS closer_to FROM zz",
        "linear_score_literals": BASE + ALL + f", z AS (SELECT doc_id, {SCORE} AS s FROM fs JOIN fl USING (doc_id) JOIN fr USING (doc_id) JOIN fy USING (doc_id)) SELECT doc_id, {r9('s')} AS score, {r9('1 / (1 + exp(-(1.2 * s + 0.05)))')} AS p_ai FROM z",
        "fold_assignment": f"""WITH d AS (SELECT doc_id, {plain('label')} AS label FROM documents WHERE {plain('label')} IN ('human', 'ai')), o AS (SELECT *, row_number() OVER (ORDER BY label, doc_id) - 1 AS g, row_number() OVER (PARTITION BY label ORDER BY doc_id) - 1 AS r FROM d),
c AS (SELECT label, sum((g % 3 = 0)::INT) AS c0, sum((g % 3 = 1)::INT) AS c1 FROM o GROUP BY label) SELECT doc_id, label, CASE WHEN r < c0 THEN 0 WHEN r < c0 + c1 THEN 1 ELSE 2 END AS fold FROM o JOIN c USING (label)""",
        "decision_rule": f"WITH {SCO}, {DEC} SELECT id, n_sentences, label, {', '.join(f'{r11(c)} AS {c}' for c in ('mean_p_ai', 'frac_ai_sentences', 'dispersion', 'p_human', 'p_ai', 'p_mixed'))}, {r11('greatest(p_human, p_ai, p_mixed)')} AS confidence FROM dec",
        "decision_counts": f"WITH {SCO}, {DEC} SELECT label, count(*) AS n FROM dec GROUP BY label",
        "mixed_rate": f"WITH {REC}, {SCO}, {DEC} SELECT count(*) AS n, {r9("coalesce(avg((dec.label = 'mixed')::INT), 0.0)")} AS frac_labelled_mixed FROM dec JOIN rec ON rec.id = dec.id WHERE {plain('rec.label')} = 'mixed'",
        "confusion_metrics": WITH_J + f", m AS (SELECT {METRICS} FROM j) SELECT {RATIOS}, 0.5::DOUBLE AS threshold FROM m",
        "auroc_exact": WITH_J + f" SELECT {r9('auroc')} AS auroc FROM {auroc('j')}",
        "classification_by_source": WITH_J + f", g AS (SELECT j.*, {plain('r.source')} AS source FROM j JOIN rec r USING (id) WHERE r.source IS NOT NULL), m AS (SELECT source, {METRICS} FROM g GROUP BY source) SELECT source, {RATIOS}, {r9('auroc')} AS auroc FROM m JOIN {auroc('g', 'source')} a USING (source)",
        "calibration_bins": WITH_J + f" SELECT ({bins})::INT AS bin, {r9('avg(p)')} AS mean_predicted, {r9('avg(y)')} AS frac_positive, count(*) AS count FROM j GROUP BY 1",
        "per_family_metrics": WITH_J + f", fam AS (SELECT DISTINCT model_family AS f FROM j WHERE y = 1 AND model_family IS NOT NULL), g AS (SELECT f AS model_family, p, y FROM fam JOIN j ON y = 0 OR j.model_family = f), m AS (SELECT model_family, sum(y)::BIGINT AS n_ai, {METRICS} FROM g GROUP BY model_family) SELECT model_family, n, n_ai, {r9('(tp + tn)::DOUBLE / n')} AS accuracy, {r9(div('2 * tp', '2 * tp + fp + fn'))} AS f1, {r9('brier')} AS brier, {r9('auroc')} AS auroc FROM m JOIN {auroc('g', 'model_family')} a USING (model_family)",
        "sentence_truth": f"WITH {REC}, {SCO}, {TRUTH} SELECT score_id, label, y FROM st",
        "localization_metrics": f"WITH {REC}, {SCO}, {TRUTH}, g AS (SELECT p_ai AS p, y FROM st WHERE label = 'mixed' AND p_ai IS NOT NULL), m AS (SELECT {METRICS} FROM g) SELECT {RATIOS}, 0.5::DOUBLE AS threshold, {r9('auroc')} AS auroc FROM m, {auroc('g')} a",
        "metric_input_check": f"WITH {REC}, {SCO}, {TRUTH} SELECT CASE WHEN y IS NULL OR p_ai IS NULL THEN 'missing' WHEN p_ai < 0 OR p_ai > 1 THEN 'probability' END AS reason, count(*) AS n FROM st WHERE y IS NULL OR p_ai IS NULL OR p_ai < 0 OR p_ai > 1 GROUP BY 1",
        "rq6_corr": BASE + RQ6,
        "record_violations": VIOLATIONS,
        "duplicate_ids": "SELECT id, count(*) AS n FROM records WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1",
        "merge_spans": f"""WITH {REC}, e AS (SELECT id, unnest(spans) AS s FROM rec), f AS (SELECT id, s."start" AS a, s."end" AS b, s.label AS label FROM e), l AS (SELECT *, lag(label) OVER (PARTITION BY id ORDER BY a) AS pl FROM f), g AS (SELECT *, sum((pl IS NULL OR pl <> label)::INT) OVER (PARTITION BY id ORDER BY a) AS r FROM l)
SELECT id, min(a) AS start_pos, max(b) AS end_pos, any_value(label) AS label FROM g GROUP BY id, r""",
        "paraphrase_native": PARA,
        "mixed_native": MIXED,
        "model_family_case": f"SELECT {FAMILY} AS family, count(*) AS n FROM (SELECT generation.model_name AS m FROM records WHERE generation IS NOT NULL) GROUP BY 1",
        "parse_src": f"""WITH s AS (SELECT {SRC} AS src FROM documents) SELECT CASE WHEN src LIKE '%\\_human' ESCAPE '\\' THEN src[:-7] WHEN regexp_matches(src, '^([a-z0-9_]+?)_machine_[a-z]+_(.+)') THEN regexp_extract(src, '^([a-z0-9_]+?)_machine_[a-z]+_(.+)', 1) ELSE src END AS domain,
CASE WHEN src LIKE '%\\_human' ESCAPE '\\' THEN NULL WHEN regexp_matches(src, '^([a-z0-9_]+?)_machine_[a-z]+_(.+)') THEN regexp_extract(src, '^([a-z0-9_]+?)_machine_[a-z]+_(.+)', 2) ELSE 'unknown' END AS model, count(*) AS n FROM s WHERE src IS NOT NULL GROUP BY ALL""",
        "label_source_counts": f"WITH {REC} SELECT {plain('label')} AS label, {plain('source')} AS source, count(*) AS n FROM rec GROUP BY ALL",
        "lineage": f"WITH {REC} SELECT c.id, c.transform.parent_id AS parent_id, c.transform.kind AS kind, c.group_id IS NOT DISTINCT FROM p.group_id AS same_group FROM rec c JOIN rec p ON p.id = c.transform.parent_id",
        "run_score_means": f"WITH {SCO}, per AS (SELECT run_id, count(*) AS n, {r9('avg(p_ai)')} AS mean_p_ai FROM sco GROUP BY run_id) SELECT r.run_id, unnest(r.ablations) AS ablation, n, mean_p_ai FROM experiment_runs r JOIN per USING (run_id)",
    }
