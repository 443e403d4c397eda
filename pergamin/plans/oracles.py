"""DuckDB's SQL for the queries of the registry, over the same tables.

Patterns are those of the catalogue: RE2 and Java give them the same meaning. Where a query needs what RE2 lacks, the SQL says
the same in another way or the query has none.
"""

from __future__ import annotations

from pergamin.functions import catalogue as C
from pergamin.functions import checks, prose
from pergamin.functions import text as X
from pergamin.operators import gates, lines, segment

T = C.Thresholds()


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pattern(regex: str) -> str:
    return quoted(regex.replace("}+", "}").replace("(?iu", "(?i"))


def removed(text: str, regex: str) -> str:
    return f"regexp_replace({text}, {pattern(regex)}, '', 'g')"


def strip(text: str) -> str:
    return removed(text, rf"\A{C.SPACE}+|{C.SPACE}+\z")


def found(text: str, regex: str) -> str:
    return f"regexp_extract_all({text}, {pattern(regex)})"


def matches(text: str, regex: str) -> str:
    return f"regexp_matches({text}, {pattern(regex)})"


def share_of(regex: str, empty: float) -> str:
    return f"CASE WHEN length(text) = 0 THEN {empty} ELSE (length(text) - length({removed('text', regex)})) / length(text) END"


def share(items: str, test: str, empty: float) -> str:
    return f"CASE WHEN len({items}) = 0 THEN {empty} ELSE len(list_filter({items}, lambda x: {test})) / len({items}) END"


def latin(text: str) -> str:
    return f"list_transform({found(text, C.LATIN_WORD)}, lambda x: lower(x))"


STOP = ", ".join(map(quoted, C.STOPWORDS))
EDGE = r"[^\p{L}\p{N}_]"
DOMAIN = " + ".join(f"CAST({matches('lower(text)', rf'(?:{chr(92)}A|{EDGE}){p}(?:{chr(92)}z|{EDGE})')} AS INT)" for p in C.DOMAIN)
METRICS = f"""
    round({share_of(C.ODD_CHARACTER, 1.0)}, 4) AS odd_chars,
    round({share('shown', 'length(x) < 20', 1.0)}, 4) AS short_lines,
    round({share('all_words', 'length(x) = 1', 1.0)}, 4) AS single_chars,
    round({share_of(C.GLYPH_INDEX, 0.0)}, 4) AS glyph_index,
    round({share_of(C.CONTROL_CHARACTER, 0.0)}, 4) AS control_chars,
    round({share('latin', f'x IN ({STOP})', 0.0)}, 4) AS stopwords,
    CAST(len(latin) AS INT) AS latin_words,
    round(({DOMAIN}) / {len(C.DOMAIN)}, 4) AS domain"""
PARTS = f"""list_filter(list_transform(regexp_split_to_array(text, {pattern(C.LINE_BREAK)}), lambda x: {strip('x')}), lambda x: x <> '') AS shown,
    {found('text', C.WORD)} AS all_words, {latin('text')} AS latin"""


def metrics(source: str, keys: str) -> str:
    return f"(SELECT {keys}, text, {METRICS} FROM (SELECT {keys}, text, {PARTS} FROM {source}))"


SCORE = """greatest(0.0, least(1.0, 1.0::DOUBLE
    + CASE WHEN odd_chars > 0.15 THEN -0.30 WHEN odd_chars > 0.05 THEN -0.15 ELSE 0 END
    + CASE WHEN short_lines > 0.60 THEN -0.20 WHEN short_lines > 0.40 THEN -0.10 ELSE 0 END
    + CASE WHEN single_chars > 0.20 THEN -0.20 WHEN single_chars > 0.10 THEN -0.10 ELSE 0 END
    {more_before}
    + CASE WHEN glyph_index > 0.30 THEN -0.60 WHEN glyph_index > 0.10 THEN -0.30 ELSE 0 END
    + CASE WHEN control_chars > 0.05 THEN -0.40 ELSE 0 END
    + CASE WHEN latin_words >= 15 THEN CASE WHEN stopwords < 0.02 THEN -0.45 WHEN stopwords < 0.08 THEN -0.25 ELSE 0 END ELSE 0 END
    + CASE WHEN domain < 0.03 THEN -0.15 WHEN domain > 0.10 THEN 0.05 ELSE 0 END))::DOUBLE"""
TEXT_SCORE = f"CASE WHEN text IS NULL THEN NULL WHEN {strip('text')} = '' THEN 0.0 ELSE {SCORE.format(more_before='')} END"


def bare(text: str) -> str:
    stamps = pattern("(?is)" + "|".join(C.STAMP))
    return strip(f"regexp_replace(regexp_replace({text}, {stamps}, ' ', 'g'), {pattern(C.SPACE + '{2,}')}, ' ', 'g')")


def anchors(text: str) -> str:
    codes = f"list_filter({found(f'upper({text})', C.WORD)}, lambda x: {matches('x', chr(92) + 'A[A-Z0-9]{8,}' + chr(92) + 'z')} AND {matches('x', '[A-Z]')} AND length({removed('x', '[^0-9]')}) >= 4)"
    marked = f"list_filter(list_transform({found(text, C.PUNCTUATED)}, lambda x: {removed('x', '[^0-9]')}), lambda x: length(x) >= 8)"
    return f"list_sort(list_distinct(list_concat(list_concat({codes}, {marked}), {found(text, C.DIGIT_RUN)})))"


LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, step ORDER BY loaded_at DESC, coalesce(md5(text), '') DESC, reading_id DESC) AS rn FROM readings {where}) WHERE rn = 1)"
READ = LATEST.format(where="WHERE text IS NOT NULL")
LINES = f"(SELECT DISTINCT line_id, doc_id, step, page_no, line_no, text, score, poly, page_w, page_h FROM page_lines)"
LEXICON = f"SELECT word, count(*) AS n FROM (SELECT unnest({found('lower(text)', C.LEXICON_TOKEN)}) AS word FROM documents) GROUP BY word HAVING count(*) >= 3"
SHORT = ", ".join(map(quoted, C.SHORT_WORDS))
COVERED = f"""(SELECT l.*, coalesce(c.coverage, 1.0) AS coverage FROM {LINES} l LEFT JOIN (
    SELECT line_id, tx, count(*) FILTER (w.word IS NOT NULL OR t.token IN ({SHORT})) / count(*) AS coverage FROM (SELECT DISTINCT line_id, tx, i, token FROM (SELECT line_id, md5(text) AS tx, unnest(toks) AS token, generate_subscripts(toks, 1) AS i
        FROM (SELECT line_id, text, {found('lower(text)', C.LEXICON_TOKEN)} AS toks FROM page_lines))) t
    LEFT JOIN ({LEXICON}) w ON w.word = t.token GROUP BY line_id, tx) c ON c.line_id = l.line_id AND c.tx = md5(l.text))"""
EDGES = "list_min(list_transform(poly, lambda p: p.x)) AS x1, list_min(list_transform(poly, lambda p: p.y)) AS y1, list_max(list_transform(poly, lambda p: p.x)) AS x2, list_max(list_transform(poly, lambda p: p.y)) AS y2"
CLASSIFIED = f"""(SELECT *, round(jr, 3) AS junk,
    CASE WHEN alnum = 0 AND n <= 3 THEN 'fragment'
      WHEN x1 IS NOT NULL AND page_w > 1 AND page_h > 1 AND y2 - y1 > 1.5 * greatest(x2 - x1, 1.0) AND y2 - y1 > 0.06 * page_h AND ((x1 + x2) / 2 / page_w < 0.13 OR (x1 + x2) / 2 / page_w > 0.87) THEN 'vertical'
      WHEN {matches('ct', C.REFERENCE_LINE)} OR {matches('ct', C.DATE_LINE)} OR (n <= 24 AND {matches('ct', C.CAPS_TITLE)}) OR {matches('ct', C.ANCHOR_LINE)} THEN 'clean'
      WHEN fr > 0.5 OR jr > 0.55 OR (coalesce(score, 0) < 0.55 AND coverage < 0.12 AND n >= 14) THEN 'illegible'
      WHEN (tokens >= 2 AND coverage < 0.35 AND coalesce(score, 0) < 0.85) OR fr > 0.2 THEN 'suspect' ELSE 'clean' END AS kind0
  FROM (SELECT *, length(ct) AS n, 1 - length(ct) / greatest(length(t0), 1) AS fr, (length(ct) - length({removed('ct', C.JUNK_CHARACTER)})) / greatest(length(ct), 1) AS jr,
      length(ct) - length({removed('ct', '[' + chr(92) + 'p{L}' + chr(92) + 'p{N}]')}) AS alnum, len({found('lower(ct)', C.LEXICON_TOKEN)}) AS tokens, {EDGES}
    FROM (SELECT *, {strip(removed('t0', C.FOREIGN_SCRIPT))} AS ct FROM (SELECT *, {strip("coalesce(text, '')")} AS t0 FROM {COVERED}))))"""
AHEAD = "PARTITION BY doc_id, step, page_no ORDER BY line_no, line_id"
SIGNED = f"""(SELECT *, kind0 AS kind FROM {CLASSIFIED} WHERE kind0 = 'fragment' UNION ALL
  SELECT * EXCLUDE (nm, jt), CASE WHEN kind0 = 'clean' AND n BETWEEN 2 AND 28 AND tokens <= 3 AND coverage < 0.25 AND coalesce(score, 0) < 0.97 AND NOT {matches('ct', '[0-9]')} AND nm AND jt THEN 'signature' ELSE kind0 END AS kind
  FROM (SELECT *, coalesce(bool_or({matches('ct', C.CAPS_NAME)}) OVER ({AHEAD} ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), false) AS nm,
      coalesce(bool_or({matches('ct', C.JOB_TITLE)}) OVER ({AHEAD} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), false) AS jt FROM {CLASSIFIED} WHERE kind0 <> 'fragment'))"""
CONTAINED = f"""(SELECT doc_id, step, page_no, count(*) AS n_total, count(*) FILTER (kind = 'illegible') AS n_illegible, count(*) FILTER (kind = 'vertical') AS n_vertical, count(*) FILTER (kind = 'fragment') AS n_fragment,
    count(*) FILTER (kind = 'suspect') AS n_suspect, count(*) FILTER (kind = 'signature') AS n_signature, count(*) FILTER (kind = 'recovered') AS n_recovered,
    round(sum(CASE WHEN kind = 'clean' THEN n ELSE 0 END) / greatest(sum(greatest(n, 1)), 1), 3) AS trusted_fraction,
    coalesce(string_agg(shown, chr(10) ORDER BY line_no, line_id) FILTER (shown IS NOT NULL), '') AS text
  FROM (SELECT *, CASE WHEN kind NOT IN ('illegible', 'vertical', 'signature') THEN ct WHEN again THEN NULL WHEN kind = 'signature' THEN {quoted(C.SIGNATURE_MARKER)} ELSE {quoted(C.ILLEGIBLE_MARKER)} END AS shown
      FROM (SELECT *, coalesce(lag(kind IN ('illegible', 'vertical', 'signature')) OVER ({AHEAD}), false) AS again FROM {SIGNED} WHERE kind <> 'fragment')
    UNION ALL SELECT *, false AS again, NULL AS shown FROM {SIGNED} WHERE kind = 'fragment') GROUP BY doc_id, step, page_no)"""
ESCALATE = "(trusted_fraction < 0.72 OR n_illegible >= 3 OR n_illegible + n_suspect >= 6)"

STRUCTURE = """(SELECT doc_id, count(*) AS native_pages, round(sum(chars) / count(*), 2) AS chars_per_page, round(avg(CAST(chars < 50 AS DOUBLE)), 4) AS empty_pages,
    CASE WHEN sum(words) > 0 THEN round(sum(blocks) / sum(words), 4) ELSE 1.0 END AS fragmentation
  FROM (SELECT doc_id, page_no, max(row(chars, blocks, words)) AS p, p[1] AS chars, p[2] AS blocks, p[3] AS words FROM doc_pages GROUP BY doc_id, page_no) GROUP BY doc_id)"""
INSIDE = "len(list_filter(boxes, lambda x: x.kind = 0 AND (x.x1 + x.x2) / 2 BETWEEN i.x1 AND i.x2 AND (x.y1 + x.y2) / 2 BETWEEN i.y1 AND i.y2)) = 0"
UNCOVERED = f"coalesce(page_w * page_h > 0 AND len(list_filter(boxes, lambda i: i.kind = 1 AND (i.x2 - i.x1) * (i.y2 - i.y1) / (page_w * page_h) >= {T.uncovered_image_share} AND {INSIDE})) > 0, false)"

CARD = f"""upper(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(text, {quoted(X.compatible_forms()[0])}, {quoted(X.compatible_forms()[1])}), {pattern(chr(92) + 'p{Mn}+')}, '', 'g'),
    '[^A-Za-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'), {pattern(chr(92) + 'A | ' + chr(92) + 'z')}, '', 'g'))"""
MARKS = " + ".join([*(f"CAST(contains(card, {quoted(m)}) AS INT)" for m in C.IDENTITY_MARKS), f"CAST({matches('card', C.TRAFFIC_OFFICE)} AS INT)"])
VEHICLE = " OR ".join(f"contains(card, {quoted(m)})" for m in C.VEHICLE_MARKS)

USEFUL = f"CASE WHEN length({strip('text')}) = 0 THEN 0.0 ELSE greatest(score, 0.0) * ln(1 + length({strip('text')})) END"
VOCABULARY = f"list_distinct({latin(bare('text'))})"
GATE = f"""CASE WHEN NOT (coalesce(has_image, true) OR coalesce(has_vector, false)) THEN 'page with no visual content'
    WHEN useful_words < {T.min_useful_words} THEN 'only ' || useful_words || ' useful words outside the stamp' WHEN glyph_index > {T.max_glyph_index} THEN 'glyph indices instead of text'
    WHEN kind <> 'native' AND score < {T.min_score} THEN 'text quality below the minimum' WHEN bare_chars / greatest(coalesce(doc_pages, 1), 1) < {T.min_chars_per_page} THEN 'too few characters a page' ELSE 'adequate extraction' END"""
MEASURED = f"""(SELECT *, reason IN ('page with no visual content', 'adequate extraction') AS accepted, coalesce(available, true) AND {strip('text')} <> '' AS read_something FROM (SELECT *,
    CASE WHEN NOT coalesce(available, true) THEN 'unavailable: ' || coalesce(why, 'no reason given') WHEN {strip('text')} = '' THEN CASE WHEN kind = 'native' THEN 'no text layer' ELSE 'no text' END
      WHEN kind = 'native' AND structure_score < {T.native_accept_score} THEN 'structure below the minimum' WHEN kind = 'native' AND coalesce(uncovered, false) THEN 'image without text'
      WHEN kind = 'ocr' AND coalesce(confidence, 0) < {T.min_confidence} THEN 'confidence below the minimum' WHEN kind <> 'native' AND (coalesce(pages_sent, 0) = 0 OR pages_sent <> pages_answered) THEN 'pages without an answer'
      ELSE {GATE} END AS reason FROM (SELECT *, round({SCORE.format(more_before="+ CASE WHEN chars_per_page < 50 THEN -0.45 WHEN chars_per_page < 300 THEN -0.25 ELSE 0 END + CASE WHEN empty_pages > 0.30 THEN -0.30 WHEN empty_pages > 0.10 THEN -0.15 ELSE 0 END + CASE WHEN fragmentation > 0.08 THEN -0.10 ELSE 0 END")}, 4) AS structure_score
    FROM (SELECT r.* EXCLUDE (chars_per_page, empty_pages, fragmentation), coalesce(chars_per_page, length(text) / greatest(coalesce(doc_pages, 1), 1)) AS chars_per_page, coalesce(empty_pages, CAST(length(text) < 50 AS DOUBLE)) AS empty_pages, coalesce(fragmentation, 0.0) AS fragmentation
      FROM (SELECT m.*, round({TEXT_SCORE}, 4) AS score, length({bare('text')}) AS bare_chars, CAST(len({found(bare('text'), C.LATIN_WORD)}) AS INT) AS useful_words, {VOCABULARY} AS vocabulary, d.* EXCLUDE (doc_id), s.* EXCLUDE (doc_id), u.uncovered
        FROM {metrics("(SELECT * REPLACE (coalesce(text, '') AS text) FROM " + LATEST.format(where='') + ")", 'doc_id, step, ordinal, kind, available, why, confidence, pages_sent, pages_answered')} m
        LEFT JOIN (SELECT doc_id, pages AS doc_pages, has_image, has_vector FROM documents) d ON d.doc_id = m.doc_id LEFT JOIN {STRUCTURE} s ON s.doc_id = m.doc_id
        LEFT JOIN (SELECT doc_id, bool_or({UNCOVERED}) AS uncovered FROM doc_pages GROUP BY doc_id) u ON u.doc_id = m.doc_id) r))))"""


def jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) >= {T.min_useful_words} AND len({b}) >= {T.min_useful_words} THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) ELSE 0.0 END"


def real(text: str) -> str:
    return strip(f"regexp_replace(regexp_replace({text}, {pattern('(?i)' + C.UNREAD)}, ' ', 'g'), {pattern(C.SPACE + '+')}, ' ', 'g')")


MARKED = f"CASE WHEN length({strip('new')}) = 0 THEN 0.0 ELSE 1 - length({real('new')}) / length({strip('new')}) END"
REPLACED = f"""SELECT doc_id, CASE WHEN previous = '' THEN NULL WHEN markers >= {T.max_marker_fraction} THEN 'loop of unread marks' WHEN truncated AND NOT degenerate AND NOT richer THEN 'pages were left out'
    WHEN failed > 0 AND NOT degenerate THEN 'batches failed' WHEN NOT (degenerate OR truncated OR richer) AND len(lost) > 0 THEN 'identifiers lost: ' || array_to_string(lost[1:5], ', ')
    WHEN length(new) <= length(previous) AND NOT degenerate THEN 'not longer than the text it would replace' END AS rejection, CAST(len(lost) AS INT) AS n_lost
  FROM (SELECT *, sent > 0 AND doc_pages > sent AS truncated, useful < {T.min_useful_words} AS degenerate, after >= {T.much_richer} * greatest(before, 1.0) AS richer, list_filter(pa, lambda x: len(list_filter(na, lambda y: contains(y, x))) = 0) AS lost
  FROM (SELECT c.doc_id, previous, new, coalesce(sent, 0) AS sent, coalesce(failed, 0) AS failed, coalesce(d.pages, 1) AS doc_pages, {MARKED} AS markers, len({found(bare('previous'), C.LATIN_WORD)}) AS useful,
      length({real('previous')}) / greatest(coalesce(d.pages, 1), 1) AS before, length({real('new')}) / greatest(CASE WHEN answered > 0 THEN answered WHEN sent > 0 THEN sent ELSE coalesce(d.pages, 1) END, 1) AS after,
      {anchors('previous')} AS pa, {anchors('new')} AS na
    FROM (SELECT doc_id, text AS previous FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, ordinal) AS rank FROM {READ} WHERE kind <> 'expensive') WHERE rank = 1) c
    JOIN (SELECT doc_id, text AS new, pages_sent AS sent, pages_answered AS answered, failed_batches AS failed FROM {READ} WHERE kind = 'expensive') n ON n.doc_id = c.doc_id JOIN documents d ON d.doc_id = c.doc_id))"""

ALIKE = f"CASE WHEN len(v) >= 2 AND len(list_filter(v, lambda w: len(w) < {T.min_useful_words})) = 0 THEN round(len(list_reduce(v, lambda a, b: list_intersect(a, b))) / len(list_distinct(flatten(v))), 4) ELSE 0.0 END"
def settled(rows: str, guarded: bool = False) -> str:
    """The contest over measured readings; ``guarded``: those ``refused`` neither close nor win, and the winner is given as running text."""
    refused = "refused" if guarded else "false"
    text = final("coalesce(best.text, '')") if guarded else "coalesce(best.text, '')"
    digest = ", md5(x) AS text_digest" if guarded else ""
    return f"""WITH r AS (SELECT doc_id, list(struct_pack(o := ordinal, step := step, text := text, score := score, accepted := accepted, reason := reason, n := useful_words, v := vocabulary, read := read_something, u := {USEFUL}, no := {refused}) ORDER BY ordinal, step) AS r FROM {rows} GROUP BY doc_id),
  p AS (SELECT doc_id, i, list_transform(list_filter(r[1:i], lambda x: x.read), lambda x: x.v) AS v FROM r, unnest(range(1, len(r) + 1)) t(i)),
  s AS (SELECT doc_id, list(a ORDER BY i) AS sims FROM (SELECT doc_id, i, {ALIKE} AS a FROM p) GROUP BY doc_id),
  c AS (SELECT r.doc_id, r, sims, nullif(coalesce(list_position(list_transform(r, lambda x: x.accepted), true), 0), 0) AS acc, nullif(coalesce(list_position(list_transform(sims, lambda x: x >= {T.min_agreement}), true), 0), 0) AS agr,
      least(acc, agr) AS close, list_filter(r, lambda x: x.read) AS rd FROM r JOIN s ON r.doc_id = s.doc_id),
  k AS (SELECT *, CASE WHEN close = acc THEN 'acceptance' WHEN close IS NOT NULL THEN 'agreement' WHEN len(rd) >= 2 AND len(list_filter(rd, lambda x: x.n >= {T.min_useful_words})) = 0 THEN 'consensus' ELSE 'contest' END AS closed_by FROM c),
  w AS (SELECT *, list_sort(list_transform(CASE closed_by WHEN 'acceptance' THEN r[close:close] WHEN 'agreement' THEN list_filter(r[1:close], lambda x: x.read AND NOT x.no) WHEN 'contest' THEN list_filter(rd, lambda x: NOT x.no) ELSE [] END,
      lambda x: struct_pack(u := -x.u, o := x.o, step := x.step, text := x.text, score := x.score)))[1] AS best FROM k)
  SELECT doc_id, step, score, closed_by, similarity, CAST(length(x) AS INT) AS n_chars, provenance{digest} FROM (SELECT doc_id, coalesce(best.step, CASE WHEN closed_by = 'consensus' THEN 'empty_by_consensus' ELSE 'none' END) AS step, round(best.score, 4) AS score, closed_by, sims[coalesce(close, len(r))] AS similarity, {text} AS x,
    coalesce(best.step, CASE WHEN closed_by = 'consensus' THEN 'empty_by_consensus' ELSE 'none' END) || ': ' || array_to_string(list_transform(r[1:coalesce(close, len(r))], lambda x: x.step || '(' || CASE WHEN x.accepted THEN 'ok' ELSE x.reason END || ')'), ' -> ') AS provenance FROM w)"""


def within(regex: str) -> str:
    """A pattern of words in RE2, which has no edge of words but that of ASCII: it takes the character at the edge."""
    edge = r"[^\p{L}\p{N}_]"
    return regex.replace(r"(?U)\b(?:", rf"(?:\A|{edge})(?:").replace(r"(?U)\b[", rf"(?:\A|{edge})[").replace(r"(?U)\b", rf"(?:{edge}|\z)").replace("$)", r"\z)")


def thousands(text: str) -> str:
    """Amounts in the English way repaired, one after another."""
    parts, hits = f"regexp_split_to_array({text}, {pattern(C.ENGLISH_THOUSANDS)})", found(text, C.ENGLISH_THOUSANDS)
    fixed = f"list_transform({hits}, lambda x: replace(left(x, length(x) - 3), ',', '.') || ',' || right(x, 2))"
    return f"array_to_string(list_transform(list_zip({parts}, {fixed}), lambda z: z[1] || coalesce(z[2], '')), '')"


def rebuilt(text: str) -> str:
    """Lines folded to paragraphs one by one, by the definition: the line before is the joined one."""
    rows = f"list_filter(list_transform(string_split({text}, chr(10)), lambda x: {removed('x', C.SPACE + '+' + chr(92) + 'z')}), lambda x: NOT {matches('x', C.PAGE_NUMBER_ONLY)})"
    last = r"regexp_extract(a, '([^\n]*)\z', 1)"
    bare, b = removed("a", rf"{C.SPACE}+\z"), removed("b", rf"\A{C.SPACE}+")
    keep, end = "a || chr(10) || b", f"right({bare}, 12)"
    hyphen = f"({matches(bare, '[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]-' + chr(92) + 'z')} AND {matches(b, chr(92) + 'A' + chr(92) + 'p{Ll}')})"
    short = matches(f"right({removed(last, C.SPACE + '+' + chr(92) + 'z')}, 12)", within(C.ABBREVIATION))
    fold = f"""CASE WHEN {last} = '' OR {b} = '' OR {matches(last, prose.STRUCTURE)} OR {matches('b', prose.STRUCTURE)} THEN {keep} WHEN {matches(bare, '[0-9][-/]' + chr(92) + 'z')} AND {matches(b, chr(92) + 'A[0-9]')} THEN {bare} || {b}
      WHEN {hyphen} AND {matches(b, within(C.ENCLITIC))} THEN {bare} || {b} WHEN {hyphen} THEN left({bare}, length({bare}) - 1) || {b} WHEN {matches(bare, prose.SENTENCE_END)} AND NOT {short} THEN {keep}
      WHEN {short} AND {matches(b, chr(92) + 'A[0-9]')} THEN {bare} || ' ' || {b} WHEN {matches(b, prose.TITLE)} THEN {keep} ELSE {bare} || ' ' || {b} END"""
    return f"CASE WHEN len({rows}) = 0 THEN '' ELSE list_reduce({rows}, lambda a, b: {fold}) END"


def final(text: str) -> str:
    """The final text: as ``prose.normalize``."""
    plain = f"translate({text}, {quoted(prose.HOMOGLYPHS[0])}, {quoted(prose.HOMOGLYPHS[1])})"
    rows, stamp = f"string_split({plain}, chr(10))", matches("x", "(?i)" + C.STAMP_LINE)
    numbered = f"list_transform(list_filter({rows}, lambda x: {stamp}), lambda x: {strip(f'regexp_replace(x, {pattern(C.SPACE + "+")}, {quoted(" ")}, {quoted("g")})')})"
    once = f"list_transform(list_filter(list_zip({numbered}, range(len({numbered}))), lambda z: list_position({numbered}, z[1]) = z[2] + 1), lambda z: z[1])"
    body = f"array_to_string(list_filter({rows}, lambda x: NOT {stamp}), chr(10))"
    body = f"regexp_replace({body}, {pattern(rf'R{chr(92)}${C.SPACE}*{chr(92)}n{C.SPACE}*([0-9])')}, 'R$ {chr(92)}1', 'g')"
    body = f"regexp_replace({rebuilt(body)}, 'R{chr(92)}$([0-9])', 'R$ {chr(92)}1', 'g')"
    amount = r"([^A-Za-zÀ-ÿ0-9]|\A)(?:RS|R2|E\$|8\$|SR\$|3R\$|H\$|RE)\s*([0-9]{1,3}(?:[.,][0-9]{3})*[.,][0-9]{2})([^0-9]|\z)"
    for _ in range(2):  # what is behind one may be before the next
        body = f"regexp_replace({body}, {pattern('(?i)' + amount)}, '{chr(92)}1R$ {chr(92)}2{chr(92)}3', 'g')"
    body = f"regexp_replace(regexp_replace(regexp_replace({thousands(body)}, '§{chr(92)}$', '§§', 'g'), '[ {chr(92)}t]{{2,}}', ' ', 'g'), '{chr(92)}n{{3,}}', chr(10) || chr(10), 'g')"
    return f"({strip(body)} || CASE WHEN len({numbered}) > 0 THEN chr(10) || chr(10) || {quoted(prose.STAMP_FOOTER)} || chr(10) || array_to_string({once}, chr(10)) ELSE '' END)"


SETTLED = settled(MEASURED)
GUARDED = f"""(WITH m AS (SELECT x.*, coalesce(y.sent, 0) AS sent, coalesce(y.answered, 0) AS answered, coalesce(y.failed, 0) AS failed FROM {MEASURED} x LEFT JOIN (SELECT doc_id, step, pages_sent AS sent, pages_answered AS answered, failed_batches AS failed FROM {LATEST.format(where='')}) y ON y.doc_id = x.doc_id AND y.step = x.step),
  e AS (SELECT * FROM m WHERE kind = 'expensive' AND read_something),
  b AS (SELECT * FROM (SELECT e.doc_id, e.step, p.text AS previous, e.text AS new, e.sent, e.answered, e.failed, coalesce(e.doc_pages, 1) AS doc_pages, row_number() OVER (PARTITION BY e.doc_id, e.step ORDER BY length(p.text) DESC, p.ordinal) AS rn FROM e JOIN m p ON p.doc_id = e.doc_id AND p.read_something AND (p.ordinal < e.ordinal OR p.ordinal = e.ordinal AND p.step < e.step)) WHERE rn = 1),
  k AS ({REPLACED.split("  FROM (SELECT *, sent > 0 AND", 1)[0].replace("SELECT doc_id,", "SELECT doc_id, step,", 1)}
    FROM (SELECT *, sent > 0 AND doc_pages > sent AS truncated, useful < {T.min_useful_words} AS degenerate, after >= {T.much_richer} * greatest(before, 1.0) AS richer, list_filter(pa, lambda x: len(list_filter(na, lambda y: contains(y, x))) = 0) AS lost
    FROM (SELECT *, {MARKED} AS markers, len({found(bare('previous'), C.LATIN_WORD)}) AS useful, length({real('previous')}) / greatest(doc_pages, 1) AS before, length({real('new')}) / greatest(CASE WHEN answered > 0 THEN answered WHEN sent > 0 THEN sent ELSE doc_pages END, 1) AS after, {anchors('previous')} AS pa, {anchors('new')} AS na FROM b)))
  SELECT m.* REPLACE (m.accepted AND k.rejection IS NULL AS accepted, coalesce(k.rejection, m.reason) AS reason), k.rejection IS NOT NULL AS refused FROM m LEFT JOIN k ON k.doc_id = m.doc_id AND k.step = m.step)"""


def tax_valid(x: str) -> str:
    d = removed(x, "[^0-9]")
    digit = lambda k: f"CAST(substr({d}, {k}, 1) AS INT)"
    check = lambda n: "((" + " + ".join(f"{digit(k + 1)} * {n + 1 - k}" for k in range(n)) + ") * 10) % 11 % 10"
    return f"({check(9)} = {digit(10)} AND {check(10)} = {digit(11)} AND {d} <> repeat(substr({d}, 1, 1), 11))"


def case_valid(x: str) -> str:
    d = removed(x, "[^0-9]")
    return f"98 - CAST(substr({d}, 1, 7) || substr({d}, 10, 11) || '00' AS HUGEINT) % 97 = CAST(substr({d}, 8, 2) AS INT)"


def above(name: str, *steps: tuple[float, str]) -> str:
    return "CASE " + " ".join(f"WHEN {name} > {limit} THEN {quoted(why)}" for limit, why in steps) + " END"


REASONS = ", ".join([*(above(n, *s) for n, *s in X.FORM_REASONS), *(above(n, *s) for n, *s in X.READING_REASONS), "CASE WHEN latin_words >= 15 THEN CASE WHEN stopwords < 0.02 THEN 'no function words' WHEN stopwords < 0.08 THEN 'few function words' END END", "CASE WHEN domain < 0.03 THEN 'no words of the domain' END"])
BLANK = f"{strip("coalesce(text, '')")} = ''"
ONCE = "(SELECT doc_id, page_no, max(text) AS text FROM doc_pages GROUP BY doc_id, page_no)"
TO_READ = f"""(SELECT doc_id, page_no, rank FROM (SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS rank FROM (SELECT *, bool_or(bare) OVER (PARTITION BY doc_id) AS some_bare, bool_and(bare) OVER (PARTITION BY doc_id) AS all_bare
    FROM (SELECT doc_id, page_no, bool_and(length({strip("coalesce(text, '')")}) < {T.min_text_page_chars}) AS bare FROM doc_pages GROUP BY doc_id, page_no)) WHERE bare OR NOT some_bare OR all_bare) WHERE rank <= {T.max_pages})"""
PAGE_TEXTS = f"(SELECT doc_id, step, page_no, string_agg(text, chr(10) ORDER BY line_no, line_id) AS text, coalesce(round(round(100 * avg(score), 6), 1), 0.0) AS confidence FROM {LINES} WHERE NOT ({BLANK}) GROUP BY doc_id, step, page_no)"
WITNESS = f"""(SELECT doc_id, CAST(sum(CASE WHEN coalesce(score, 0) * 100 >= {T.min_confidence} THEN len({found("coalesce(text, '')", C.WORD)}) ELSE 0 END) AS BIGINT) AS reliable, coalesce(round(round(100 * avg(score), 6), 1), 0.0) AS confidence,
    string_agg(coalesce(text, ''), chr(10) ORDER BY page_no, line_no, line_id) AS text FROM {LINES} WHERE step = 'vision' AND page_no < {T.max_witness_pages} GROUP BY doc_id)"""
CURRENT = f"(SELECT doc_id, text AS current FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, ordinal) AS rank FROM {LATEST.format(where="WHERE text IS NOT NULL AND kind <> 'expensive' AND step <> 'vision'")}) WHERE rank = 1)"
WON = f"""(SELECT doc_id, step FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY u DESC, ordinal) AS rank FROM (SELECT doc_id, step, ordinal, round({USEFUL}, 4) AS u FROM (SELECT *, round({TEXT_SCORE}, 4) AS score FROM {metrics(READ, 'doc_id, step, ordinal')}) WHERE {strip('text')} <> '')) WHERE rank = 1)"""


def company_valid(x: str) -> str:
    d = removed(x, "[^0-9]")
    digit = lambda k: f"CAST(substr({d}, {k}, 1) AS INT)"
    total = lambda n: "(" + " + ".join(f"{digit(k + 1)} * {w}" for k, w in enumerate(checks.COMPANY_WEIGHTS[13 - n :])) + ") % 11"
    check = lambda n: f"CASE WHEN {total(n)} < 2 THEN 0 ELSE 11 - {total(n)} END"
    return f"({check(12)} = {digit(13)} AND {check(13)} = {digit(14)} AND {d} <> repeat(substr({d}, 1, 1), 14))"


def cleaned(text: str) -> str:
    """A model's answer without its fence, thoughts and preamble, if it has no delimited pages."""
    return strip(f"regexp_replace(regexp_replace({text}, {pattern(C.AFTER_THINK)}, ''), {pattern(C.LEADING_META)}, '')")


def unfenced(text: str) -> str:
    return f"regexp_replace({strip(text)}, {pattern(C.MD_FENCE)}, '', 'g')"


def blocks(text: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({text}, {pattern(C.DELIMITED)}, 1), lambda x: {strip('x')}), lambda x: x <> '')"


ORACLES = {
    "score_reasons": f"SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN {strip('text')} = '' THEN 'no text' ELSE concat_ws('; ', {REASONS}) END AS reasons FROM {metrics('documents', 'doc_id')}",
    "pages_to_read": f"SELECT doc_id, page_no, CAST(rank AS INT) AS rank FROM {TO_READ}",
    "transcriptions": f"""SELECT doc_id, step, count(*) AS pages_sent, count(*) AS pages_answered, coalesce(round(round(avg(confidence), 6), 1), 0.0) AS confidence, md5(string_agg(text, chr(10) || chr(10) ORDER BY page_no)) AS text_digest FROM {PAGE_TEXTS} GROUP BY doc_id, step""",
    "engine_readings": f"""SELECT doc_id, count(*) AS pages_sent, count(text) AS pages_answered, CASE WHEN count(*) FILTER (NOT ({BLANK})) > 0 THEN 100.0 ELSE 0.0 END AS confidence, CASE WHEN count(*) > count(text) THEN 'the page has no layer of text' ELSE '' END AS failures,
        md5(coalesce(string_agg({strip('text')}, chr(10) || chr(10) ORDER BY page_no) FILTER (NOT ({BLANK})), '')) AS text_digest FROM {ONCE} GROUP BY doc_id""",
    "batch_coverage": f"""SELECT doc_id, CAST(sum(n) AS BIGINT) AS pages_sent, CAST(sum(CASE WHEN fine THEN n ELSE 0 END) AS BIGINT) AS pages_answered, count(*) FILTER (NOT fine) AS failed_batches FROM (SELECT doc_id, b, count(*) AS n, count(text) = count(*) AS fine
        FROM (SELECT doc_id, text, (row_number() OVER (PARTITION BY doc_id ORDER BY page_no) - 1) // 2 AS b FROM {ONCE}) GROUP BY doc_id, b) GROUP BY doc_id""",
    "converted_pages": f"""WITH c AS (SELECT doc_id, unnest(page_texts) AS t, generate_subscripts(page_texts, 1) AS rank FROM {LATEST.format(where="WHERE step = 'paddle'")}), p AS (SELECT r.doc_id, r.page_no, c.t FROM {TO_READ} r JOIN c ON c.doc_id = r.doc_id AND c.rank = r.rank),
        j AS (SELECT o.doc_id, o.page_no, {strip("coalesce(t, '')")} <> '' AS converted, CASE WHEN {strip("coalesce(t, '')")} <> '' THEN t WHEN {strip("coalesce(text, '')")} <> '' THEN text END AS x FROM {ONCE} o LEFT JOIN p ON p.doc_id = o.doc_id AND p.page_no = o.page_no)
        SELECT doc_id, count(*) AS pages, count(*) FILTER (converted) AS converted_pages, md5(coalesce(string_agg(x, chr(10) || chr(10) ORDER BY page_no) FILTER (x IS NOT NULL), '')) AS text_digest FROM j GROUP BY doc_id""",
    "witnesses": f"SELECT doc_id, reliable, confidence, md5(text) AS text_digest FROM {WITNESS}",
    "veto_decisions": f"""SELECT doc_id, reliable IS NOT NULL AS witnessed, CASE WHEN reliable IS NULL THEN 'proceed' WHEN reliable < {T.min_reliable_words} THEN 'no_legible_word' WHEN len({found(bare('wt'), C.LATIN_WORD)}) < {T.min_useful_words} THEN 'sparse_page' WHEN {jaccard('cv', 'wv')} >= {T.min_agreement} THEN 'reading_confirmed' ELSE 'proceed' END AS veto
        FROM (SELECT c.doc_id, w.reliable, coalesce(w.text, '') AS wt, list_distinct({latin(bare('current'))}) AS cv, list_distinct({latin(bare("coalesce(w.text, '')"))}) AS wv FROM {CURRENT} c LEFT JOIN {WITNESS} w ON w.doc_id = c.doc_id)""",
    "screened_texts": f"""SELECT doc_id, dropped, CAST(CASE WHEN dropped THEN {len(gates.NOTICE)} ELSE length(text) END AS INT) AS n_chars FROM (SELECT *, CASE WHEN {strip('text')} = '' THEN false WHEN {VEHICLE} THEN true WHEN coalesce(lower({strip('label')}) = {quoted(C.PERSONAL_LABEL)}, false) AND length(text) <= 1000 THEN true WHEN m < 2 THEN false WHEN 1000 * m / length(text) < 2.5 THEN false ELSE true END AS dropped
        FROM (SELECT *, {MARKS} AS m FROM (SELECT b.doc_id, b.text, d.label, {CARD.replace('translate(text', 'translate(b.text')} AS card FROM (SELECT doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, ordinal) AS rank FROM {READ}) WHERE rank = 1) b LEFT JOIN documents d ON d.doc_id = b.doc_id)))""",
    "losing_readings": f"SELECT r.doc_id, r.step, r.score FROM (SELECT doc_id, step, round({TEXT_SCORE}, 4) AS score FROM {metrics(READ, 'doc_id, step, ordinal')}) r LEFT JOIN {WON} w ON w.doc_id = r.doc_id WHERE w.step IS NULL OR w.step <> r.step",
    "converted_texts": f"SELECT reading_id, CAST(length(t) AS INT) AS n_chars, length({strip("coalesce(t, '')")}) < 40 AS is_empty FROM (SELECT reading_id, regexp_replace(regexp_replace(text, {pattern(C.IMAGE_MARK)}, '', 'g'), '{chr(92)}n{{3,}}', chr(10) || chr(10), 'g') AS t FROM readings WHERE kind = 'expensive')",
    "responses": f"SELECT reading_id, md5(CASE WHEN len(b) > 0 THEN array_to_string(b, chr(10) || chr(10)) ELSE {cleaned('t')} END) AS digest FROM (SELECT *, {blocks('t')} AS b FROM (SELECT reading_id, {unfenced('text')} AS t FROM readings WHERE kind = 'expensive'))",
    "response_pages": f"""SELECT reading_id, CAST(CASE WHEN len(b) > 0 THEN len(b) WHEN c <> '' THEN 1 ELSE 0 END AS INT) AS n_pages, md5(CASE WHEN len(b) > 0 THEN array_to_string(b, '|') ELSE c END) AS digest FROM (SELECT reading_id, {blocks('t')} AS b, {cleaned('t')} AS c FROM (SELECT reading_id, {unfenced('a')} AS t
        FROM (SELECT reading_id, '<think>a</think>' || chr(10) || array_to_string(list_transform(page_texts, lambda p: '=== INICIO DA TRANSCRICAO ===' || chr(10) || coalesce(p, '') || chr(10) || '=== FIM DA TRANSCRICAO ==='), chr(10)) AS a FROM readings WHERE step = 'paddle' AND page_texts IS NOT NULL)))""",
    "engine_report": "SELECT * FROM (VALUES ('text_layer', 0, true, '')) v(engine, priority, available, why)",
    "route_evidence": "SELECT doc_id, step, page_no, route || ' (' || concat_ws(', ', " + ", ".join(f"printf('{name}=%.2f', floor(coalesce(CAST({name} AS DOUBLE), 0.0) * 100 + {lines.HALF}) / 100)" for name in lines.EVIDENCE) + ") || ')' AS evidence FROM ({page_routes})",
    "privacy_scan": f"""SELECT doc_id, CAST(len(c) AS INT) AS company_ids, CAST(len(list_filter(c, lambda x: {company_valid('x')})) AS INT) AS valid_company_ids, CAST(len(m) AS INT) AS emails, CASE WHEN length(m[1]) > 6 THEN substr(m[1], 1, 4) || repeat('*', length(m[1]) - 6) || right(m[1], 2) ELSE '***' END AS first_email,
        CAST(len({found('k', checks.ADDRESS)}) AS INT) AS addresses, CAST(len({found('k', checks.SECRET)}) AS INT) AS secrets FROM (SELECT doc_id, k, {found('k', checks.COMPANY_ID)} AS c, list_filter({found('k', checks.EMAIL)}, lambda x: NOT {matches('x', checks.EXAMPLE_EMAIL)}) AS m FROM (SELECT doc_id, {removed('text', checks.IGNORED_LINE)} AS k FROM documents))""",
    "unwrapped_files": f"SELECT unwrap_id, 'rtf' AS seen_format, md5({strip("regexp_replace(regexp_replace(text, '[' || chr(13) || ']', '', 'g'), '" + chr(92) + "n{3,}', chr(10) || chr(10), 'g')")}) AS text_digest FROM (SELECT DISTINCT unwrap_id, text FROM unwrapped WHERE file_format = 'rtf' AND text IS NOT NULL)",
    "replacements": REPLACED,
    "cascade_results": SETTLED,
    "cascade_guarded": settled(GUARDED, True),
    "final_text": f"SELECT doc_id, CAST(length(t) AS INT) AS n_chars, md5(t) AS digest FROM (SELECT doc_id, CASE WHEN text IS NOT NULL THEN {final('text')} END AS t FROM documents)",
    "resegmented_texts": f"""WITH RECURSIVE r AS (SELECT DISTINCT unnest({found('text', segment.RUN.pattern)}) AS run FROM documents), l AS (SELECT DISTINCT strip_accents(lower(word)) AS w FROM ({LEXICON}) UNION SELECT unnest([{SHORT}])),
        p AS (SELECT run, s, n FROM (SELECT run, unnest(range(length(run))) AS s FROM r), range({segment.SHORTEST}, {segment.LONGEST + 1}) t(n) WHERE s + n <= length(run) AND substr(strip_accents(lower(run)), s + 1, n) IN (SELECT w FROM l)),
        f AS (SELECT run, 0 AS pos, CAST([] AS BIGINT[]) AS sizes FROM r UNION ALL SELECT f.run, f.pos + p.n, list_append(f.sizes, p.n) FROM f JOIN p ON p.run = f.run AND p.s = f.pos),
        b AS (SELECT run, len(max(sizes)) AS n FROM f WHERE pos = length(run) GROUP BY run HAVING len(max(sizes)) > 1), m AS (SELECT d.doc_id, d.text, sum(b.n - 1) AS more FROM (SELECT doc_id, text, unnest({found('text', segment.RUN.pattern)}) AS run FROM documents) d JOIN b ON b.run = d.run GROUP BY d.doc_id, d.text)
        SELECT d.doc_id, m.more IS NOT NULL AS changed, CAST(length(d.text) + m.more AS INT) AS n_chars FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id""",
    "amounts_repaired": f"SELECT doc_id, md5(CASE WHEN text IS NOT NULL THEN {thousands('text')} END) AS digest FROM documents",
    "text_metrics": f"SELECT doc_id, odd_chars, short_lines, single_chars, glyph_index, control_chars, stopwords, latin_words, domain FROM {metrics('documents', 'doc_id')}",
    "text_scores": f"SELECT doc_id, round(raw, 4) AS score, CASE WHEN raw >= 0.75 THEN 'good' WHEN raw >= 0.5 THEN 'fair' WHEN raw IS NOT NULL THEN 'poor' END AS label FROM (SELECT doc_id, {TEXT_SCORE} AS raw FROM {metrics('documents', 'doc_id')})",
    "native_text": "SELECT doc_id, page_no, md5(t) AS text_digest, CAST(length(t) AS INT) AS n_chars FROM (SELECT doc_id, page_no, "
    + strip(f"regexp_replace(regexp_replace(replace(replace(text, chr(160), ' '), chr(173), ''), '[ {chr(92)}t]+', ' ', 'g'), '{chr(92)}n{{3,}}', chr(10) || chr(10), 'g')")
    + " AS t FROM doc_pages)",
    "stamp_words": f"SELECT doc_id, CAST(length(b) AS INT) AS bare_chars, CAST(len({found('b', C.LATIN_WORD)}) AS INT) AS useful_words, CAST(len(list_distinct({latin('b')})) AS INT) AS different_words FROM (SELECT doc_id, {bare('text')} AS b FROM documents)",
    "identifiers": f"SELECT doc_id, CAST(len(a) AS INT) AS n_anchors, array_to_string(a, ' ') AS anchors FROM (SELECT doc_id, CASE WHEN text IS NOT NULL THEN {anchors('text')} END AS a FROM documents)",
    "identifiers_lost": f"""WITH a AS (SELECT doc_id, step, {anchors('text')} AS a FROM {LATEST.format(where="WHERE text IS NOT NULL AND step IN ('paddle', 'vision')")})
        SELECT p.doc_id, array_to_string(list_filter(p.a, lambda x: len(list_filter(v.a, lambda y: contains(y, x))) = 0), ' ') AS lost FROM a p JOIN a v ON p.doc_id = v.doc_id AND p.step = 'paddle' AND v.step = 'vision'""",
    "unread_marks": f"""SELECT reading_id, CAST(length(c) AS INT) AS real_chars, round(CASE WHEN length(s) = 0 THEN 0.0 ELSE 1 - length(c) / length(s) END, 4) AS marker_fraction
        FROM (SELECT reading_id, {strip('text')} AS s, {strip(f"regexp_replace(regexp_replace(text, {pattern('(?i)' + C.UNREAD)}, ' ', 'g'), {pattern(C.SPACE + '+')}, ' ', 'g')")} AS c FROM readings WHERE text IS NOT NULL)""",
    "structure_scores": f"SELECT * FROM {STRUCTURE}",
    "pages_without_text": f"""SELECT doc_id, count(*) AS pages, count(*) FILTER (bare) AS without_text, coalesce(string_agg(CAST(page_no AS VARCHAR), ',' ORDER BY page_no) FILTER (bare), '') AS page_list,
        count(*) FILTER (bare) > 0 AND count(*) FILTER (bare) < count(*) AS mixed FROM (SELECT doc_id, page_no, bool_and(length({strip("coalesce(text, '')")}) < {T.min_text_page_chars}) AS bare FROM doc_pages GROUP BY doc_id, page_no) GROUP BY doc_id""",
    "image_coverage": f"SELECT doc_id, page_no, bool_or({UNCOVERED}) AS uncovered FROM doc_pages GROUP BY doc_id, page_no",
    "attachment_screening": f"""SELECT screening_id, CAST(coalesce(m, 0) AS INT) AS marks_found, round(CASE WHEN length(text) > 0 THEN 1000 * coalesce(m, 0) / length(text) ELSE 0.0 END, 3) AS mark_density,
        CASE WHEN text IS NULL THEN false WHEN {strip('text')} = '' THEN false WHEN {VEHICLE} THEN true WHEN lower({strip('label')}) = {quoted(C.PERSONAL_LABEL)} AND length(text) <= 1000 THEN true
          WHEN m < 2 THEN false WHEN 1000 * m / length(text) < 2.5 THEN false ELSE true END AS drop FROM (SELECT *, {MARKS} AS m FROM (SELECT *, {CARD} AS card FROM screenings))""",
    "lexicon": LEXICON,
    "line_coverage": f"""SELECT l.line_id, round(coalesce(c.coverage, 1.0), 4) AS coverage FROM page_lines l LEFT JOIN (
        SELECT line_id, tx, count(*) FILTER (w.word IS NOT NULL OR t.token IN ({SHORT})) / count(*) AS coverage FROM (SELECT DISTINCT line_id, md5(text) AS tx, generate_subscripts(toks, 1) AS i, unnest(toks) AS token FROM (SELECT line_id, text, {found('lower(text)', C.LEXICON_TOKEN)} AS toks FROM page_lines)) t
        LEFT JOIN ({LEXICON}) w ON w.word = t.token GROUP BY line_id, tx) c ON c.line_id = l.line_id AND c.tx = md5(l.text)""",
    "line_kinds": f"SELECT line_id, kind, junk, CAST(n AS INT) AS n_chars FROM {SIGNED}",
    "page_containment": f"SELECT * EXCLUDE (text), md5(text) AS text_digest, {ESCALATE} AS needs_escalation, CASE WHEN {ESCALATE} THEN 'escalate' WHEN n_illegible = 0 THEN 'ok' ELSE 'accept_with_holes' END AS suggested_action FROM {CONTAINED}",
    "document_layers": f"""SELECT doc_id, step, CAST(sum(n_total) AS BIGINT) AS n_total, CAST(sum(n_illegible) AS BIGINT) AS n_illegible, CAST(sum(n_suspect) AS BIGINT) AS n_suspect, CAST(sum(n_signature) AS BIGINT) AS n_signature, CAST(sum(n_vertical) AS BIGINT) AS n_vertical,
        round(avg(trusted_fraction), 3) AS trusted_fraction, bool_or({ESCALATE}) AS needs_escalation FROM {CONTAINED} GROUP BY doc_id, step""",
    "reread_targets": f"SELECT line_id, kind, CAST(rank AS INT) AS rank FROM (SELECT line_id, kind, row_number() OVER (PARTITION BY doc_id, step, page_no ORDER BY kind = 'vertical' DESC, line_no, line_id) AS rank FROM {SIGNED} WHERE kind IN ('vertical', 'illegible')) WHERE rank <= {T.max_targets}",
    "page_routes": f"""SELECT *, CASE WHEN votes >= 4 AND numeric > 0.2 THEN 'table' WHEN seal AND coverage >= 0.45 THEN 'stamped_digital' WHEN coverage < 0.4 AND median_score < 0.9 AND prose < 0.15 THEN 'degraded' ELSE 'normal' END AS route
        FROM (SELECT *, CAST(short > 0.55 AS INT) + CAST(numeric > 0.3 AS INT) + CAST(amounts >= 6 AS INT) + CAST(rules >= 3 AS INT) + CAST(columns > 0.35 AS INT) + CAST(prose < 0.12 AS INT) AS votes
        FROM (SELECT doc_id, step, page_no, avg(CAST(n <= 22 AS DOUBLE)) AS short, avg(CAST(digits >= 2 AND n <= 40 AS DOUBLE)) AS numeric, CAST(sum(len({found('t', C.AMOUNT_MARK)})) AS BIGINT) AS amounts, count(*) FILTER ({matches('t', C.RULE_MARK)}) AS rules,
          CASE WHEN count(x) < 6 THEN 0.0 ELSE count(*) FILTER (x IS NOT NULL AND members >= 3) / count(x) END AS columns, avg(CAST(n > 45 AND {matches('t', '[.;:]' + chr(92) + 'z')} AS DOUBLE)) AS prose,
          bool_or({matches('t', C.SEAL)}) AS seal, avg(coverage) AS coverage, median(score) AS median_score
        FROM (SELECT *, count(x) OVER (PARTITION BY doc_id, step, page_no, grp) AS members FROM (SELECT *, CASE WHEN x IS NOT NULL THEN sum(coalesce(gap, 0)) OVER (PARTITION BY doc_id, step, page_no ORDER BY x NULLS LAST, line_id ROWS UNBOUNDED PRECEDING) END AS grp
          FROM (SELECT *, CAST(x - lag(x) OVER (PARTITION BY doc_id, step, page_no ORDER BY x NULLS LAST, line_id) > 0.02 AS INT) AS gap, length(t) AS n, length(t) - length({removed('t', '[0-9]')}) AS digits
            FROM (SELECT *, {strip("coalesce(text, '')")} AS t, CASE WHEN page_w > 0 THEN list_min(list_transform(poly, lambda p: p.x)) / page_w END AS x FROM {COVERED}) WHERE t <> '')))
        GROUP BY doc_id, step, page_no))""",
    "page_confidence": f"SELECT doc_id, step, page_no, count(*) AS n_lines, coalesce(round(round(100 * avg(score), 6), 1), 0.0) AS confidence FROM {LINES} WHERE {strip("coalesce(text, '')")} <> '' GROUP BY doc_id, step, page_no",
    "page_merge": f"""WITH p AS (SELECT doc_id, page_no, max(text) AS native FROM doc_pages GROUP BY doc_id, page_no), o AS (SELECT doc_id, page_no, string_agg(text, chr(10) ORDER BY line_no, line_id) AS ocr FROM {LINES} WHERE step = 'paddle' AND {strip("coalesce(text, '')")} <> '' GROUP BY doc_id, page_no),
        m AS (SELECT p.doc_id, p.page_no, length({strip("coalesce(native, '')")}) < {T.min_text_page_chars} AND ocr IS NOT NULL AS merged, CASE WHEN merged THEN ocr WHEN {strip("coalesce(native, '')")} <> '' THEN native END AS t FROM p LEFT JOIN o ON p.doc_id = o.doc_id AND p.page_no = o.page_no)
        SELECT doc_id, count(*) AS pages, count(*) FILTER (merged) AS merged_pages, md5(coalesce(string_agg(t, chr(10) || chr(10) ORDER BY page_no) FILTER (t IS NOT NULL), '')) AS text_digest FROM m GROUP BY doc_id""",
    "reading_gates": f"SELECT doc_id, step, useful_words, score, structure_score, accepted, reason FROM {MEASURED}",
    "reading_agreement": f"""WITH v AS (SELECT doc_id, step, ordinal, {VOCABULARY} AS v FROM {READ})
        SELECT a.doc_id, a.step AS first, b.step AS second, round({jaccard('a.v', 'b.v')}, 4) AS similarity FROM v a JOIN v b ON a.doc_id = b.doc_id AND (a.ordinal < b.ordinal OR (a.ordinal = b.ordinal AND a.step < b.step))""",
    "best_readings": f"""SELECT doc_id, step, usefulness FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY usefulness DESC, ordinal) AS rank FROM (SELECT doc_id, step, ordinal, round({USEFUL}, 4) AS usefulness
        FROM (SELECT *, round({TEXT_SCORE}, 4) AS score FROM {metrics(READ, 'doc_id, step, ordinal')}) WHERE {strip('text')} <> '')) WHERE rank = 1""",
    "longest_texts": f"SELECT doc_id, step, CAST(length(text) AS INT) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, ordinal) AS rank FROM {READ}) WHERE rank = 1",
    "step_comparison": f"SELECT step, count(*) AS readings, median(len({found('text', C.LATIN_WORD)})) AS median_words, median(len({anchors('text')})) AS median_anchors, round(avg(confidence), 3) AS mean_confidence FROM {READ} GROUP BY step",
    "file_formats": "SELECT unwrap_id, file_format, CASE WHEN text IS NULL THEN NULL WHEN starts_with(text, '%PDF') THEN 'pdf' WHEN starts_with(text, '{\\rtf') THEN 'rtf' WHEN starts_with(text, 'BRyPDDE') THEN 'bry' ELSE 'unknown' END AS seen_format FROM unwrapped",
    "private_numbers": f"""SELECT doc_id, CAST(len(t) AS INT) AS tax_ids, CAST(len(list_filter(t, lambda x: {tax_valid('x')})) AS INT) AS valid_tax_ids, CAST(len(c) AS INT) AS case_numbers, CAST(len(list_filter(c, lambda x: {case_valid('x')})) AS INT) AS valid_case_numbers
        FROM (SELECT doc_id, {found('text', checks.TAX_ID)} AS t, {found('text', checks.CASE_NUMBER)} AS c FROM documents)""",
}
ORACLES["route_evidence"] = ORACLES["route_evidence"].replace("{page_routes}", ORACLES["page_routes"])
