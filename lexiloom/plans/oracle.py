"""DuckDB SQL for the named queries, built from common table expressions."""

from __future__ import annotations

import string

from ..sources import chat

UTT = f"""
raw AS (SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
utt AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, text FROM (
  SELECT doc_id, line_no, trim(regexp_replace(regexp_replace(translate(line, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^a-z ]', '', 'g'), ' +', ' ', 'g')) AS text FROM raw) WHERE text <> '')"""

#: Letters of each utterance with their place, and whether a word ends after them.
LETTERS = """
chars AS (SELECT doc_id, line_no, unnest(range(len(c))) AS idx, unnest(c) AS unit, unnest(list_concat(c[2:], [' '])) AS nxt FROM (SELECT doc_id, line_no, string_split(text, '') AS c FROM utt)),
u AS (SELECT doc_id, line_no, idx, unit, nxt = ' ' AS word_end FROM chars WHERE unit <> ' ')"""

SEQ = """
last AS (SELECT max((doc_id, line_no)) AS m FROM utt),
seq AS (SELECT doc_id, line_no, idx, unit FROM u UNION ALL SELECT doc_id, line_no, 1000000000, ' ' FROM utt, last WHERE (doc_id, line_no) <> m),
s AS (SELECT *, lag(unit) OVER w AS p1, lag(unit, 2) OVER w AS p2, lead(unit) OVER w AS nx FROM seq WINDOW w AS (ORDER BY doc_id, line_no, idx)),
pairs AS (SELECT p1 AS a, unit AS b, count(*) AS n FROM s WHERE p1 IS NOT NULL GROUP BY ALL),
uni AS (SELECT unit, count(*) AS n FROM seq GROUP BY ALL)"""


def tp(dependency: str) -> str:
    score = {"ftp": "p.n / x.n", "btp": "p.n / y.n", "mi": "log2(p.n / (x.n * y.n))"}[dependency]
    return f"tp AS (SELECT a, b, {score} AS score FROM pairs p JOIN uni x ON x.unit = a JOIN uni y ON y.unit = b)"


RELATIVE = """
cut AS (SELECT s.*, coalesce(t1.score, 0) > coalesce(t2.score, 0) AND coalesce(t2.score, 0) < coalesce(t3.score, 0) AND p2 IS NOT NULL AND nx IS NOT NULL AND p1 <> ' ' AS c
  FROM s LEFT JOIN tp t1 ON t1.a = p2 AND t1.b = p1 LEFT JOIN tp t2 ON t2.a = p1 AND t2.b = s.unit LEFT JOIN tp t3 ON t3.a = s.unit AND t3.b = nx),
seg AS (SELECT doc_id, line_no, string_agg(CASE WHEN c THEN ' ' || unit ELSE unit END, '' ORDER BY idx) AS text FROM cut WHERE unit <> ' ' GROUP BY ALL)"""

ABSOLUTE = """
cut AS (SELECT s.*, coalesce(t2.score, 0) <= (SELECT sum(score) / count(score) FROM tp) AND p1 IS NOT NULL AND p1 <> ' ' AS c
  FROM s LEFT JOIN tp t2 ON t2.a = p1 AND t2.b = s.unit),
seg AS (SELECT doc_id, line_no, string_agg(CASE WHEN c THEN ' ' || unit ELSE unit END, '' ORDER BY idx) AS text FROM cut WHERE unit <> ' ' GROUP BY ALL)"""

DIBS = """
di AS (SELECT unit AS a, lead(unit) OVER (PARTITION BY doc_id, line_no ORDER BY idx) AS b, word_end FROM u),
dip AS (SELECT a, b, count(*) FILTER (NOT word_end) AS internal, count(*) FILTER (word_end) AS spanning FROM di WHERE b IS NOT NULL GROUP BY ALL),
words AS (SELECT unnest(string_split(text, ' ')) AS word FROM utt),
cnt AS (SELECT (SELECT count(*) FROM utt) AS nlines, (SELECT count(*) FROM words) AS nwords, (SELECT count(*) FROM u) AS nphones)"""


def dibs(kind: str) -> str:
    if kind == "gold":
        return DIBS + ", model AS (SELECT a, b, spanning / (internal + spanning) AS score FROM dip)"
    edge = {"phrasal": ("SELECT right(text, 1) AS e, left(text, 1) AS i FROM utt"), "lexical": "SELECT right(word, 1) AS e, left(word, 1) AS i FROM (SELECT DISTINCT word FROM words)"}[kind]
    return (
        DIBS
        + f""",
edges AS ({edge}),
fin AS (SELECT e, count(*) / (SELECT count(*) FROM edges) AS p FROM edges GROUP BY ALL),
ini AS (SELECT i, count(*) / (SELECT count(*) FROM edges) AS p FROM edges GROUP BY ALL),
parts AS (SELECT a, b, coalesce(fin.p, 0) * (SELECT (nwords - nlines) / (nphones - nlines) FROM cnt) * coalesce(ini.p, 0) AS over_, (internal + spanning) / (SELECT sum(internal + spanning) FROM dip) AS under
  FROM dip LEFT JOIN fin ON e = a LEFT JOIN ini ON i = b),
model AS (SELECT a, b, CASE WHEN over_ >= under THEN 1.0 ELSE over_ / under END AS score FROM parts)"""
    )


DIBS_SEG = """
scored AS (SELECT u.*, lag(unit) OVER (PARTITION BY doc_id, line_no ORDER BY idx) AS p1 FROM u),
seg AS (SELECT doc_id, line_no, string_agg(CASE WHEN p1 IS NOT NULL AND coalesce(score, 1.0) > 0.5 THEN ' ' || unit ELSE unit END, '' ORDER BY idx) AS text
  FROM scored LEFT JOIN model ON a = p1 AND b = unit GROUP BY ALL)"""

#: Word spans of the segmented (t) and the gold (g) side.
SPANS = """
tw AS (SELECT doc_id, line_no, unnest(range(len(w))) AS k, unnest(w) AS word FROM (SELECT doc_id, line_no, string_split(text, ' ') AS w FROM seg)),
gw AS (SELECT doc_id, line_no, unnest(range(len(w))) AS k, unnest(w) AS word FROM (SELECT doc_id, line_no, string_split(text, ' ') AS w FROM utt)),
t AS (SELECT *, sum(len(word)) OVER (PARTITION BY doc_id, line_no ORDER BY k) AS e, sum(len(word)) OVER (PARTITION BY doc_id, line_no ORDER BY k) - len(word) AS b FROM tw),
g AS (SELECT *, sum(len(word)) OVER (PARTITION BY doc_id, line_no ORDER BY k) AS e, sum(len(word)) OVER (PARTITION BY doc_id, line_no ORDER BY k) - len(word) AS b FROM gw)"""

SCORES = (
    SPANS
    + """,
tb AS (SELECT doc_id, line_no, e AS x FROM t UNION SELECT doc_id, line_no, b FROM t),
gb AS (SELECT doc_id, line_no, e AS x FROM g UNION SELECT doc_id, line_no, b FROM g),
ti AS (SELECT doc_id, line_no, b AS x FROM t WHERE b > 0),
gi AS (SELECT doc_id, line_no, b AS x FROM g WHERE b > 0),
tl AS (SELECT DISTINCT word FROM t WHERE word <> '_'), gl AS (SELECT DISTINCT word FROM g WHERE word <> '_'),
n AS (
  SELECT 'token' AS family, (SELECT count(*) FROM t) AS test, (SELECT count(*) FROM g) AS gold, (SELECT count(*) FROM t JOIN g USING (doc_id, line_no, b, e)) AS correct
  UNION ALL SELECT 'type', (SELECT count(*) FROM tl), (SELECT count(*) FROM gl), (SELECT count(*) FROM tl JOIN gl USING (word))
  UNION ALL SELECT 'boundary_all', (SELECT count(*) FROM tb), (SELECT count(*) FROM gb), (SELECT count(*) FROM tb JOIN gb USING (doc_id, line_no, x))
  UNION ALL SELECT 'boundary_noedge', (SELECT count(*) FROM ti), (SELECT count(*) FROM gi), (SELECT count(*) FROM ti JOIN gi USING (doc_id, line_no, x)))"""
)

ARI = (
    SPANS
    + """,
ends AS (SELECT doc_id, line_no, e AS x FROM t UNION SELECT doc_id, line_no, e FROM g),
cell AS (SELECT x - coalesce(lag(x) OVER (PARTITION BY doc_id, line_no ORDER BY x), 0) AS n FROM ends),
m AS (SELECT CAST((SELECT sum(n * (n - 1) // 2) FROM cell) AS DOUBLE) AS both_, CAST((SELECT sum((e - b) * (e - b - 1) // 2) FROM t) AS DOUBLE) AS a,
  CAST((SELECT sum((e - b) * (e - b - 1) // 2) FROM g) AS DOUBLE) AS b, CAST((SELECT count(*) FROM u) AS DOUBLE) AS n)"""
)

SUMMARY = (
    SPANS
    + """,
common AS (SELECT doc_id, line_no, t.e AS x FROM t JOIN g USING (doc_id, line_no, e)),
lo AS (SELECT doc_id, line_no, x AS hi, coalesce(lag(x) OVER (PARTITION BY doc_id, line_no ORDER BY x), 0) AS lo FROM common),
ts AS (SELECT lo.doc_id, lo.line_no, lo.hi, count(*) AS n FROM lo JOIN t ON t.doc_id = lo.doc_id AND t.line_no = lo.line_no AND t.e > lo.lo AND t.e <= lo.hi GROUP BY ALL),
gs AS (SELECT lo.doc_id, lo.line_no, lo.hi, g.word, count(*) OVER (PARTITION BY lo.doc_id, lo.line_no, lo.hi) AS n FROM lo JOIN g ON g.doc_id = lo.doc_id AND g.line_no = lo.line_no AND g.e > lo.lo AND g.e <= lo.hi)"""
)


ORDER = "o AS (SELECT *, row_number() OVER (ORDER BY doc_id, line_no) - 1 AS i FROM utt)"

#: Words that single consonants and vowels can begin; their syllables apart by an underscore.
SPOKEN = """
sp AS (SELECT * FROM (SELECT doc_id, line_no, array_to_string(list_filter(string_split(text, ' '), lambda w: regexp_matches(w, '^[^aeiou]?[aeiou]')), ' ') AS text FROM utt) WHERE text <> ''),
sy AS (SELECT doc_id, line_no, array_to_string(list_transform(string_split(text, ' '), lambda w: ltrim(regexp_replace(w, '([^aeiou]?[aeiou])', '_\\1', 'g'), '_')), ' ') AS text FROM sp),
swords AS (SELECT unnest(string_split(text, ' ')) AS unit FROM sp),
syllables AS (SELECT unnest(string_split(replace(text, ' ', '_'), '_')) AS unit FROM sy),
sphones AS (SELECT unnest(string_split(replace(text, ' ', ''), '')) AS unit FROM sp)"""


def costs(words: str) -> str:
    """Costs of the words and letters of a lexicon, from rows (word, n)."""
    return f"""
lx AS ({words}),
lt AS (SELECT c, count(*) AS n FROM (SELECT unnest(string_split(word, '')) AS c FROM lx) GROUP BY ALL),
lk AS (SELECT CAST((SELECT count(*) FROM lx) AS DOUBLE) AS types, CAST((SELECT sum(n) FROM lx) AS DOUBLE) AS total, CAST((SELECT count(*) FROM lt) AS DOUBLE) AS kinds, CAST((SELECT sum(n) FROM lt) AS DOUBLE) + (SELECT count(*) FROM lx) + 1 AS ends),
lc AS (SELECT c, CAST(round(-1e6 * ln((n + 1 / (kinds + 1)) / ends)) AS BIGINT) AS cost FROM lt, lk),
unseen AS (SELECT CAST(round(-1e6 * ln(1 / (kinds + 1) / ends)) AS BIGINT) AS letter, CAST(round(-1e6 * ln(1 / (total + 1))) AS BIGINT) + CAST(round(-1e6 * ln((types + 1) / ends)) AS BIGINT) AS fresh FROM lk),
spelled AS (SELECT word, sum(cost) AS s FROM (SELECT word, unnest(string_split(word, '')) AS c FROM lx) JOIN lc USING (c) GROUP BY ALL),
lw AS (SELECT word, CAST(round(-1e6 * ln((n + exp(-s / 1e6) * ((types + 1) / ends)) / (total + 1))) AS BIGINT) AS cost FROM lx JOIN spelled USING (word), lk)"""


#: Main tiers made of conversations, with the marks that the clean-up removes.
TIERS = r"""
tier AS (SELECT conv_id AS doc_id, turn AS line_no, '*' || upper(rpad(left(role, 3), 3, 'X')) || ': ' || regexp_replace(text, '[\n\t]', ' ', 'g')
  || CASE WHEN turn % 3 = 0 THEN ' [= noise] xxx &uh there_is look@o dog@s:spa cow@sing (y)ou .' ELSE ' .' END AS text FROM conversations WHERE text IS NOT NULL)"""


def rewritten(text: str, rules: list[tuple[str, str]]) -> str:
    for pattern, to in rules:
        text = f"regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to}', 'g')"
    return text


CLEAN = TIERS + f""",
clean AS (SELECT * FROM (SELECT doc_id, line_no, {rewritten('text', chat.CLEANING)} AS text FROM tier
  WHERE NOT regexp_matches(text, '{'|'.join(chat.LEFT_OUT.split())}') AND NOT regexp_matches(text, '^....:.0\\(.*\\) .$')) WHERE text <> '' AND NOT contains(text, chr(9)))"""


def sql(*parts: str, then: str) -> str:
    return "WITH " + ",".join(parts) + " " + then


ITEMS = """
bl AS (SELECT item_id AS doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT item_id, string_split(text, chr(10)) AS l FROM benchmark WHERE text IS NOT NULL)),
bt AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, trim(regexp_replace(regexp_replace(lower(line), '[^a-z ]', '', 'g'), ' +', ' ', 'g')) AS text FROM bl)"""
#: Where known words stand before a known beginning: of each place the shortest such word, or, by frequency, the first of the
#: candidates from short to long that has one when it gives way to the most frequent of those as long or longer.
HITS = {
    False: "hits AS (SELECT doc_id, line_no, i, fits, min(i + k) AS next FROM found WHERE substr(s, k + 1, 2) IN (FROM begins) GROUP BY ALL)",
    True: """
ways AS (SELECT *, (max({'n': n, 'k': k}) OVER (PARTITION BY doc_id, line_no, i ORDER BY k DESC)).k AS b FROM found),
hits AS (SELECT doc_id, line_no, i, fits, i + arg_min(b, k) AS next FROM ways WHERE substr(s, b + 1, 2) IN (FROM begins) GROUP BY doc_id, line_no, i, fits)""",
}


def known(by_frequency: bool) -> str:
    """The learner's words under a frozen model, by a fold over these places from left to right."""
    return (
        """
lex AS (SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM bt WHERE text <> '') GROUP BY word),
begins AS (SELECT DISTINCT left(word, 2) AS e FROM lex WHERE len(word) > 1),
ends AS (SELECT DISTINCT right(word, 2) AS e FROM lex WHERE len(word) > 1),
lengths AS (SELECT DISTINCT len(word) AS k FROM lex),
sq AS (SELECT doc_id, line_no, replace(text, ' ', '') AS t FROM utt),
places AS (SELECT doc_id, line_no, unnest(range(len(t))) AS i, unnest(string_split(t, '')) AS c FROM sq),
ahead AS (SELECT doc_id, line_no, i, coalesce(lag(c, 2) OVER o || lag(c) OVER o, '') AS before,
    string_agg(c, '') OVER (PARTITION BY doc_id, line_no ORDER BY i ROWS BETWEEN CURRENT ROW AND 63 FOLLOWING) AS s
  FROM places WINDOW o AS (PARTITION BY doc_id, line_no ORDER BY i)),
found AS (SELECT doc_id, line_no, i, s, k, n, before IN (FROM ends) AS fits FROM ahead JOIN lengths ON len(s) >= k JOIN lex ON word = left(s, k)),
"""
        + HITS[by_frequency]
        + """,
folded AS (SELECT doc_id, line_no, list_reduce(list({'i': i, 'fits': fits, 'next': next, 'cuts': CAST([] AS BIGINT[])} ORDER BY i),
    lambda a, x: CASE WHEN x.i = a.next OR x.fits AND x.i >= a.next + 2
      THEN {'i': x.i, 'fits': x.fits, 'next': x.next, 'cuts': list_concat(a.cuts, CASE WHEN x.i > a.next THEN [x.i, x.next] ELSE [x.next] END)} ELSE a END,
    {'i': CAST(0 AS BIGINT), 'fits': false, 'next': CAST(0 AS BIGINT), 'cuts': CAST([] AS BIGINT[])}).cuts AS cuts
  FROM hits GROUP BY ALL),
cut_at AS (SELECT doc_id, line_no, unnest(cuts) AS i FROM folded),
seg AS (SELECT doc_id, line_no, string_agg(CASE WHEN cut_at.i IS NOT NULL AND i > 0 THEN ' ' || c ELSE c END, '' ORDER BY i) AS text
  FROM places LEFT JOIN cut_at USING (doc_id, line_no, i) GROUP BY ALL)"""
    )


#: The best split of each utterance under a lexicon's costs: one fold over its letters, then one back over where the best words start.
VITERBI = """
sq AS (SELECT doc_id, line_no, replace(text, ' ', '') AS t FROM utt),
places AS (SELECT doc_id, line_no, unnest(range(len(t))) AS i, unnest(string_split(t, '')) AS c FROM sq),
ahead AS (SELECT doc_id, line_no, i, string_agg(c, '') OVER (PARTITION BY doc_id, line_no ORDER BY i ROWS BETWEEN CURRENT ROW AND 63 FOLLOWING) AS s FROM places),
held AS (SELECT doc_id, line_no, i + k - 1 AS i, list({'i': i, 'c': cost}) AS words
  FROM ahead JOIN (SELECT DISTINCT len(word) AS k FROM lx) ON len(s) >= k JOIN lw ON word = left(s, k) GROUP BY doc_id, line_no, i + k - 1),
steps AS (SELECT doc_id, line_no, any_value(fresh) AS fresh, list({'j': i + 1, 'u': coalesce(lc.cost, letter), 'words': coalesce(words, []), 'd': CAST([] AS BIGINT[]), 's': CAST(0 AS BIGINT),
    'o': {'c': CAST(0 AS BIGINT), 'i': CAST(0 AS BIGINT)}, 'back': CAST([] AS BIGINT[])} ORDER BY i) AS e
  FROM places LEFT JOIN lc USING (c) LEFT JOIN held USING (doc_id, line_no, i), unseen GROUP BY doc_id, line_no),
best AS (SELECT doc_id, line_no, list_reduce(e, lambda a, x:
    list_transform([list_min([a.o, {'c': a.d[-1] - a.s, 'i': x.j - 1}])], lambda o:
      list_transform([list_min(list_append(list_transform(x.words, lambda w: {'c': a.d[w.i - x.j] + w.c, 'i': w.i}), {'c': o.c + a.s + x.u + fresh, 'i': o.i}))], lambda b:
        {'j': x.j, 'u': x.u, 'words': x.words, 'd': list_append(a.d, b.c)[-64:], 's': a.s + x.u, 'o': o, 'back': list_append(a.back, b.i)})[1])[1],
    {'j': CAST(0 AS BIGINT), 'u': CAST(0 AS BIGINT), 'words': CAST([] AS STRUCT(i BIGINT, c BIGINT)[]), 'd': [CAST(0 AS BIGINT)], 's': CAST(0 AS BIGINT),
     'o': {'c': CAST(1 AS BIGINT) << 60, 'i': CAST(-1 AS BIGINT)}, 'back': CAST([] AS BIGINT[])}) AS r FROM steps),
split AS (SELECT doc_id, line_no, r.d[-1] AS cost, list_reduce(list_reverse(list_transform(r.back, lambda x, j: {'at': j, 'start': x, 'cuts': CAST([] AS BIGINT[])})),
    lambda a, x: CASE WHEN x.at = a.at THEN {'at': x.start, 'start': x.start, 'cuts': list_append(a.cuts, x.start)} ELSE a END,
    {'at': len(r.back), 'start': CAST(0 AS BIGINT), 'cuts': CAST([] AS BIGINT[])}).cuts AS cuts FROM best),
cut_at AS (SELECT doc_id, line_no, unnest(cuts) AS i FROM split),
seg AS (SELECT doc_id, line_no, string_agg(CASE WHEN cut_at.i IS NOT NULL AND i > 0 THEN ' ' || c ELSE c END, '' ORDER BY i) AS text
  FROM places LEFT JOIN cut_at USING (doc_id, line_no, i) GROUP BY ALL)"""
WORDS = "w AS (SELECT doc_id, line_no, CAST(unnest(range(len(x))) AS INTEGER) AS pos, unnest(x) AS token FROM (SELECT doc_id, line_no, string_split(text, ' ') AS x FROM utt))"
COUNTED = "SELECT {}, CAST(n AS BIGINT) AS n FROM {}"
SEGMENT = "SELECT doc_id, line_no, text FROM seg"


def oracle_sql() -> dict[str, str]:
    out = {
        "corpus_utterances": sql(UTT, then="SELECT doc_id, line_no, text FROM utt"),
        "prepare_phone": sql(UTT, then="SELECT doc_id, line_no, trim(regexp_replace(replace(text, ' ', ''), '(.)', '\\1 ', 'g')) AS text FROM utt"),
        "gold_words": sql(UTT, then="SELECT doc_id, line_no, text FROM utt"),
        "validate_errors": "WITH " + UTT + """, e AS (SELECT CASE WHEN line IS NULL OR trim(line, ' ' || chr(9)) = '' THEN 'utterance is an empty string'
  WHEN regexp_matches(replace(replace(line, ';eword', ''), ';esyll', ''), '[!-/:-@\\[-`{-~]') THEN 'punctuation found in utterance'
  WHEN starts_with(line, ' ') OR starts_with(line, ';esyll') OR starts_with(line, ';eword') THEN 'utterance begins with a separator'
  WHEN NOT ends_with(line, ';eword') THEN 'utterance does not end with a word separator' END AS error FROM raw)
SELECT error, count(*) AS n FROM e GROUP BY ALL""",
        "unigram_topk": sql(UTT, WORDS, then="SELECT token, CAST(n AS BIGINT) AS n FROM (SELECT token, count(*) AS n, min((doc_id, line_no, pos)) AS idx FROM w GROUP BY ALL) ORDER BY n DESC, idx LIMIT 100"),
        "describe_utterances": sql(UTT, then="SELECT count(*) AS nutts, count(*) FILTER (NOT contains(text, ' ')) AS nutts_single_word FROM utt"),
        "mattr": sql(UTT, WORDS, "o AS (SELECT token, row_number() OVER (ORDER BY doc_id, line_no, pos) - 1 AS i FROM w)", "r AS (SELECT i, len(list_distinct(list(token) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))) / 10.0 AS r FROM o)",
                     then="SELECT round(avg(r), 6) AS mattr FROM r WHERE i < (SELECT count(*) - 10 FROM o)"),
        "entropy": sql(UTT, WORDS, "c AS (SELECT token, count(*) AS n, count(*) / (SELECT count(*) FROM w) AS p FROM w GROUP BY ALL)",
                       then="SELECT round(-sum(n * p * log2(p)) / ((SELECT sum(len(replace(text, ' ', ''))) FROM utt) - 1), 6) AS entropy FROM c"),
        "unit_counts": sql(UTT, LETTERS, SEQ, then=COUNTED.format("unit", "uni")),
        "bigram_counts": sql(UTT, LETTERS, SEQ, then=COUNTED.format("a, b", "pairs")),
        "dibs_counts": sql(UTT, LETTERS, DIBS, then="SELECT nlines, nwords, nphones FROM cnt"),
        "dibs_diphones": sql(UTT, LETTERS, DIBS, then="SELECT a, b, internal, spanning FROM dip"),
        "evaluate_tp": sql(UTT, LETTERS, SEQ, tp("ftp"), RELATIVE, SCORES, then="SELECT family, round(correct / test, 6) AS precision, round(correct / gold, 6) AS recall, round(2 * correct / (test + gold), 6) AS fscore FROM n"),
        "evaluate_dibs": sql(UTT, LETTERS, dibs("phrasal"), DIBS_SEG, SCORES, then="SELECT family, round(correct / test, 6) AS precision, round(correct / gold, 6) AS recall, round(2 * correct / (test + gold), 6) AS fscore FROM n"),
        "ari_tp": sql(UTT, LETTERS, SEQ, tp("ftp"), RELATIVE, ARI, then="SELECT round((both_ - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)), 6) AS adjusted_rand_index FROM m"),
        "error_summary_tp": sql(UTT, LETTERS, SEQ, tp("ftp"), RELATIVE, SUMMARY,
                                then="SELECT CASE WHEN gs.n = 1 AND ts.n = 1 THEN 'correct' WHEN gs.n = 1 THEN 'over' WHEN ts.n = 1 THEN 'under' ELSE 'mis' END AS category, word, count(*) AS n FROM gs JOIN ts USING (doc_id, line_no, hi) GROUP BY 1, 2"),
        "fold_assignment": sql(UTT, "o AS (SELECT doc_id, line_no, row_number() OVER (ORDER BY doc_id, line_no) - 1 AS i FROM utt)", "b AS (SELECT *, least(i // ((SELECT count(*) FROM o) // 5), 4) AS block FROM o)",
                               then="SELECT doc_id, line_no, CAST(block AS INTEGER) AS block, CAST(fold AS INTEGER) AS fold, CAST((block + fold) % 5 AS INTEGER) AS turn FROM b, (SELECT unnest(range(5)) AS fold)"),
        "unfold_roundtrip": sql(UTT, then="SELECT doc_id, line_no, text FROM utt"),
        "baseline_none": sql(UTT, then="SELECT doc_id, line_no, replace(text, ' ', '') AS text FROM utt"),
        "baseline_all": sql(UTT, then="SELECT doc_id, line_no, regexp_replace(replace(text, ' ', ''), '(.)', '\\1 ', 'g') AS text FROM utt"),
        "frozen_viterbi": sql(UTT, ITEMS, costs("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM bt WHERE text <> '') GROUP BY ALL"), VITERBI,
                              then="SELECT doc_id, line_no, text, cost FROM seg JOIN split USING (doc_id, line_no)"),
        "sql_best_words": sql(UTT, ITEMS, costs("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM bt WHERE text <> '') GROUP BY ALL ORDER BY n DESC, word LIMIT 100"), VITERBI,
                              then="SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM seg) GROUP BY ALL"),
        "puddle_known": sql(UTT, ITEMS, known(False), then=SEGMENT),
        "puddle_known_frequency": sql(UTT, ITEMS, known(True), then=SEGMENT),
        "sampled_vote": "WITH " + ITEMS + " SELECT doc_id, line_no, TRUE AS conserved FROM bt WHERE text <> ''",
        "adaptor_vote": "WITH " + ITEMS + " SELECT doc_id, line_no, TRUE AS conserved FROM bt WHERE text <> ''",
        "dpseg_folds": "WITH " + ITEMS + " SELECT doc_id, line_no, TRUE AS conserved FROM bt WHERE text <> ''",
        "oracle_probability": sql(UTT, LETTERS, DIBS, then="SELECT round(nwords / nphones, 6) AS probability FROM cnt"),
        "diphone_dump": sql(UTT, LETTERS, DIBS, then="SELECT concat_ws(' ', internal + spanning, a, b) AS value FROM dip"),
        "tp_train_test": sql(UTT, LETTERS, SEQ, tp("ftp"), """""" + ITEMS + """,
bu AS (SELECT doc_id, line_no, unnest(range(len(c))) AS idx, unnest(c) AS unit FROM (SELECT doc_id, line_no, string_split(replace(text, ' ', ''), '') AS c FROM bt WHERE text <> '')),
bseq AS (SELECT * FROM bu UNION ALL SELECT doc_id, line_no, 1000000000, ' ' FROM bt WHERE text <> '' AND (doc_id, line_no) <> (SELECT max((doc_id, line_no)) FROM bt WHERE text <> '')),
bs AS (SELECT *, lag(unit) OVER w AS p1, lag(unit, 2) OVER w AS p2, lead(unit) OVER w AS nx FROM bseq WINDOW w AS (ORDER BY doc_id, line_no, idx))""", RELATIVE.replace("FROM s LEFT", "FROM bs s LEFT"), then=SEGMENT),
    }
    for level, of in (("word", "SELECT token AS unit FROM w"), ("phone", "SELECT unit FROM u")):
        out[f"describe_{level}s"] = sql(UTT, WORDS, LETTERS, f"x AS ({of})", "c AS (SELECT unit, count(*) AS n FROM x GROUP BY ALL)", then="SELECT CAST(sum(n) AS BIGINT) AS tokens, count(*) AS types, count(*) FILTER (n = 1) AS hapaxes FROM c")
    for dependency in ("ftp", "btp", "mi"):
        out[f"tp_table_{dependency}"] = sql(UTT, LETTERS, SEQ, tp(dependency), then="SELECT a, b, round(score, 6) AS score FROM tp")
        out[f"tp_relative_{dependency}"] = sql(UTT, LETTERS, SEQ, tp(dependency), RELATIVE, then=SEGMENT)
        out[f"tp_absolute_{dependency}"] = sql(UTT, LETTERS, SEQ, tp(dependency), ABSOLUTE, then=SEGMENT)
    for kind in ("gold", "phrasal", "lexical"):
        out[f"dibs_model_{kind}"] = sql(UTT, LETTERS, dibs(kind), then="SELECT a, b, round(score, 6) AS score FROM model")
        out[f"dibs_{kind}"] = sql(UTT, LETTERS, dibs(kind), DIBS_SEG, then=SEGMENT)
    items, gold_words = ITEMS + ", iw AS (SELECT unnest(string_split(text, ' ')) AS word FROM bt WHERE text <> '')", "gw AS (SELECT unnest(string_split(text, ' ')) AS word FROM utt)"
    spoken = lambda of, then: sql(UTT, SPOKEN, *of, then=then)
    tokens = lambda level, of: f"SELECT '{level}' AS level, unnest(['tokens', 'types', 'hapaxes']) AS name, unnest([CAST(sum(n) AS DOUBLE), count(*), count(*) FILTER (n = 1)]) AS value FROM (SELECT unit, count(*) AS n FROM {of} GROUP BY ALL)"
    spaced = lambda c: f"trim(regexp_replace(replace({c}, ' ', ''), '(.)', '\\1 ', 'g'))"
    phones = lambda c: f"regexp_replace({c}, '([a-z])', '\\1;', 'g')"
    ended = "array_to_string(list_transform(string_split(text, ' '), lambda w: w || '_'), ' ') || ' '"
    row = lambda value: f"SELECT doc_id, line_no, {value} AS text FROM sy"
    out |= {
        "text_lines": sql(UTT, ORDER, then="SELECT i AS line_no, text FROM o"),
        "parse_vote": sql(UTT, ORDER, f"""v AS (SELECT i, s, CASE WHEN s = 0 AND (doc_id + line_no) % 3 = 0 OR s = 2 AND (doc_id + line_no) % 2 = 0 THEN replace(text, ' ', '')
  WHEN s = 1 AND (doc_id + line_no) % 5 = 0 THEN {spaced('text')} ELSE text END AS text FROM o, (SELECT unnest(range(3)) AS s))""", "c AS (SELECT i, text, count(*) AS n, min(s) AS f FROM v GROUP BY ALL)",
                          then="SELECT CAST(i AS INTEGER) AS utterance, text FROM c QUALIFY row_number() OVER (PARTITION BY i ORDER BY n DESC, f) = 1"),
        "stimuli_choice": sql(UTT, items, gold_words, costs("SELECT word, count(*) AS n FROM gw GROUP BY ALL"), """
pair AS (SELECT DISTINCT word AS text, reverse(word) AS other FROM iw WHERE reverse(word) <> word),
own AS (SELECT word, coalesce(any_value(k), sum(coalesce(cost, letter)) + any_value(fresh)) AS cost FROM (
  SELECT q.word, q.c, lc.cost, letter, fresh, lw.cost AS k FROM (SELECT word, unnest(string_split(word, '')) AS c FROM (SELECT text AS word FROM pair UNION SELECT other FROM pair)) q CROSS JOIN unseen LEFT JOIN lc USING (c) LEFT JOIN lw ON lw.word = q.word) GROUP BY word)""",
                              then="SELECT text, other, round(1 / (1 + exp(least((a.cost - b.cost) / 1e6, 700.0))), 6) AS choice FROM pair JOIN own a ON a.word = text JOIN own b ON b.word = other"),
        "fold_repair": sql(UTT, ORDER, "b AS (SELECT i, len(replace(text, ' ', '')) AS u, least(i // ((SELECT count(*) FROM o) // 5), 4) AS block FROM o)", "f AS (SELECT block, min(i) FILTER (u >= (SELECT u FROM b WHERE i = 0)) AS own FROM b GROUP BY ALL)",
                           then="SELECT CAST(block AS INTEGER) AS block, min(own) OVER (ORDER BY block ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS start FROM f"),
        "syllabify": spoken([], row(ended)),
        "syllabify_stripped": spoken([], row("text")),
        "syllabify_phones": spoken([], row(phones(ended))),
        "syllabify_phones_stripped": spoken([], row(f"rtrim(replace(replace({phones('text')}, ';_', '_'), '; ', ' '), ';')")),
        "prepare_syllable": spoken([], row("replace(text, '_', ' ')")),
        "describe_syllables": spoken([], "SELECT CAST(sum(n) AS BIGINT) AS tokens, count(*) AS types, count(*) FILTER (n = 1) AS hapaxes FROM (SELECT unit, count(*) AS n FROM syllables GROUP BY ALL)"),
        "describe_all": spoken(["c AS (SELECT unit, count(*) AS n, count(*) / (SELECT count(*) FROM swords) AS p FROM swords GROUP BY ALL)"], f"""SELECT level, name, round(value, 6) AS value FROM (
  {tokens('words', 'swords')} UNION ALL {tokens('syllables', 'syllables')} UNION ALL {tokens('phones', 'sphones')}
  UNION ALL SELECT 'corpus', unnest(['nutts', 'nutts_single_word']), unnest([CAST(count(*) AS DOUBLE), count(*) FILTER (NOT contains(text, ' '))]) FROM sp
  UNION ALL SELECT 'corpus', 'entropy', -sum(n * p * log2(p)) / ((SELECT count(*) FROM sphones) - 1) FROM c)"""),
        "nested_tokens": spoken([], "SELECT sp.doc_id, sp.line_no, CAST(len(string_split(sp.text, ' ')) AS INTEGER) AS words, CAST(len(string_split(replace(sy.text, ' ', '_'), '_')) AS INTEGER) AS syllables, CAST(len(replace(sp.text, ' ', '')) AS INTEGER) AS phones, sp.text FROM sp JOIN sy USING (doc_id, line_no)"),
        "chat_cleaned": "WITH " + CLEAN + " SELECT doc_id, line_no, text FROM clean",
        "chat_phonologised": "WITH " + CLEAN + f" SELECT doc_id, line_no, {rewritten('lower(text)', chat.SOUNDS['raspanish'])} AS text FROM clean",
        "sql_tokens": spoken([], "SELECT CAST(k - 1 AS INTEGER) AS phone_no, substr(unit, k, 1) AS phone, count(*) AS n FROM (SELECT unit, unnest(range(1, len(unit) + 1)) AS k FROM syllables) GROUP BY ALL"),
        "sql_prepared": spoken([], f"SELECT sp.doc_id, sp.line_no, {spaced('sp.text')} AS phones, replace(sy.text, '_', ' ') AS syllables, sp.text AS gold FROM sp JOIN sy USING (doc_id, line_no)"),
        "sql_syllables": spoken([], "SELECT unit AS syllable, count(*) AS n FROM syllables GROUP BY ALL"),
        "ari_units_tp": out["ari_tp"],
        "error_summary_lines": "WITH n AS (" + out["error_summary_tp"] + """),
k AS (SELECT * FROM (VALUES (1, 'correct'), (2, 'over'), (3, 'under'), (4, 'mis')) v(c, category)),
r AS (SELECT c, word, n, row_number() OVER (PARTITION BY c ORDER BY n, word DESC) AS last FROM n JOIN k USING (category))
SELECT '{' AS value UNION ALL SELECT '}' UNION ALL SELECT '        "' || word || '": ' || n || CASE WHEN last = 1 THEN '' ELSE ',' END FROM r
UNION ALL SELECT '    "' || category || CASE WHEN c IN (SELECT c FROM r) THEN '": {' WHEN c = 4 THEN '": {}' ELSE '": {},' END FROM k
UNION ALL SELECT CASE WHEN c = 4 THEN '    }' ELSE '    },' END FROM k WHERE c IN (SELECT c FROM r)""",
    }
    conserved = "SELECT doc_id, line_no, TRUE AS conserved FROM utt"
    for name in ("baseline_random", "puddle_online", "puddle_frozen"):
        out[name] = sql(UTT, then=conserved)
    return out
