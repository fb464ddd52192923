"""Oracle SQL (DuckDB) for the registered queries, put together from named CTEs.

The SQL states each operator its own way: closed-form windows instead of a regular
expression, sparse joins instead of matrix products, recursive CTEs and list folds
instead of expression folds.
"""

from __future__ import annotations

import re

from trovelake import fixed_values as fv
from trovelake.plans.catalog import FILTERS, GATE, HEADING, LEXICON, RULES

SIZE, STEP = fv.CHUNK_SIZE, fv.CHUNK_SIZE - fv.CHUNK_OVERLAP
K, N2 = fv.TOP_K, 2 * fv.TOP_K


def text(value: str) -> str:
    """A SQL string literal; line breaks become chr(10)."""
    parts = ["'" + p.replace("'", "''") + "'" for p in value.split("\n")]
    return "(" + " || chr(10) || ".join(parts) + ")"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def clean(x: str) -> str:
    x = f"regexp_replace({x}, '{fv.CONTROL_CHARS}', '', 'g')"
    x = f"regexp_replace({x}, '\\r\\n?', chr(10), 'g')"
    x = f"regexp_replace({x}, '[ \\t]+', ' ', 'g')"
    x = f"regexp_replace({x}, ' *\\n *', chr(10), 'g')"
    x = f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return trim(x)


def tokens(x: str) -> str:
    found = f"regexp_extract_all({x}, '(?i){fv.TOKEN_PATTERN}')"
    return f"list_transform({found}, lambda w: replace(lower(w), 'ё', 'е'))"


def sentences(x: str) -> str:
    marked = f"regexp_replace(replace({x}, chr(10), ' '), '([.!?])\\s+', '\\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {trim('s')}), lambda s: s <> '')"


def dot_sentences(x: str) -> str:
    split = f"string_split(replace({x}, chr(10), ' '), '. ')"
    return f"list_filter(list_transform({split}, lambda s: {trim('s')}), lambda s: s <> '')"


def shared(a: str, b: str) -> str:
    return f"len(list_intersect(list_distinct({a}), list_distinct({b})))"


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) > 0 THEN {shared(a, b)}::DOUBLE / len(list_distinct({a})) ELSE 0.0 END)"


def words(items: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in items) + "]"


def compressed(doc: str, asked: str) -> str:
    """A fold over [overlap-ordered sentences] with state (picked text list, total)."""
    return f"""CASE WHEN length({doc}) <= {fv.COMPRESS_MAX_CHARS} THEN {doc} ELSE (
      SELECT {trim(f"substring(array_to_string(r.picked, ' '), 1, {fv.COMPRESS_MAX_CHARS})")} FROM (
        SELECT list_reduce(list_transform(list_sort(list_transform(
                 {dot_sentences(doc)},
                 lambda s, i: {{'o': -{shared(asked, tokens('s'))}, 'i': i,
                               's': CASE WHEN suffix(s, '.') THEN s ELSE s || '.' END}})),
               lambda e: {{'picked': [e.s], 'total': length(e.s)}}),
             lambda st, e: CASE WHEN st.total >= {fv.COMPRESS_MAX_CHARS}
                   OR (st.total + e.total > {fv.COMPRESS_MAX_CHARS} AND len(st.picked) > 0) THEN st
                 ELSE {{'picked': list_concat(st.picked, e.picked), 'total': st.total + e.total}} END,
             {{'picked': CAST([] AS VARCHAR[]), 'total': CAST(0 AS BIGINT)}}) AS r) x) END"""


CTES: dict[str, str] = {}

# --- corpus --------------------------------------------------------------------
CTES["docs"] = f"""
  SELECT doc_id AS doc_pos, CAST(doc_id AS VARCHAR) AS doc_id, 'Document ' || doc_id AS title,
         {clean('lang')} AS product_type, {clean('source')} AS source, {clean('text')} AS body
  FROM documents"""
CTES["asked"] = f"SELECT item_id AS qid, {clean('text')} AS query FROM benchmark"
_SECTION = clean(f"title || chr(10) || '{HEADING}' || chr(10) || body")
for _name, _text in (
    ("recursive", _SECTION),
    ("sentence", f"regexp_replace({_SECTION}, '([.!?])\\s+', '\\1 ', 'g')"),
):
    CTES[f"windows_{_name}"] = f"""
  SELECT *, unnest(generate_series(0, CASE WHEN length(t) <= {SIZE} THEN 0
              ELSE CAST(ceil((length(t) - {SIZE}) / {STEP}.0) AS BIGINT) END)) AS nth
  FROM (SELECT * EXCLUDE (body), {_text} AS t FROM docs)"""
    CTES[f"cut_{_name}"] = f"""
  SELECT * EXCLUDE (t), {trim(f'substring(t, CAST(nth * {STEP} + 1 AS BIGINT), {SIZE})')} AS text
  FROM windows_{_name}"""
    CTES[f"chunks_{_name}"] = f"""
  SELECT doc_pos, row_number() OVER (PARTITION BY doc_pos ORDER BY nth) - 1 AS piece,
         doc_id, title, product_type, source, '{HEADING}' AS section, text
  FROM cut_{_name} WHERE text <> ''"""


def _cut_at(separator: str) -> str:
    if not separator:
        return "regexp_extract_all(p.text, '(?s).')"
    parts = f"string_split(p.text, {text(separator)})"
    joined = f"list_transform({parts}, lambda q, j: CASE WHEN j = 1 THEN q ELSE {text(separator)} || q END)"
    return f"list_filter({joined}, lambda q: q <> '')"


def _separator_ctes(strategy: str, size: int, overlap: int) -> None:
    """Splitting at separators as two list folds: over the separators, then over the parts."""
    separators = fv.SPLIT_SEPARATORS[strategy]
    CTES[f"parts_{strategy}_0"] = f"""
  SELECT * EXCLUDE (body), [{{'text': {_SECTION}, 'run': CAST(0 AS BIGINT), 'settled': FALSE}}] AS parts FROM docs"""
    for level, separator in enumerate(separators, 1):
        here = "TRUE" if level == len(separators) or not separator else f"contains(p.text, {text(separator)})"
        part = f"{{'text': q, 'run': CAST({level << 32} + i AS BIGINT), 'settled': length(q) < {size}}}"
        CTES[f"parts_{strategy}_{level}"] = f"""
  SELECT * REPLACE (flatten(list_transform(parts, lambda p, i: CASE WHEN NOT p.settled AND {here}
      THEN list_transform({_cut_at(separator)}, lambda q: {part}) ELSE [p] END)) AS parts)
  FROM parts_{strategy}_{level - 1}"""

    def flushed(window: str) -> str:
        whole = trim(f"array_to_string({window}, '')")
        return f"list_filter([{whole}], lambda c: c <> '')"

    def length_from(j: str) -> str:
        return f"length(array_to_string(st.win[{j}:], ''))"

    done = f"list_concat(st.chunks, {flushed('st.win')})"
    start = f"list_filter(range(1, len(st.win) + 2), lambda j: {length_from('j')} <= least({overlap}, {size} - e.total))[1]"
    CTES[f"merged_{strategy}"] = f"""
  SELECT * EXCLUDE (parts), list_reduce(
    list_transform(parts, lambda p: {{'chunks': CAST([] AS VARCHAR[]), 'win': [p.text], 'total': length(p.text),
                                      'run': p.run, 'settled': p.settled}}),
    lambda st, e: CASE
      WHEN NOT e.settled THEN {{'chunks': list_concat({done}, {flushed('e.win')}), 'win': CAST([] AS VARCHAR[]),
                                'total': CAST(0 AS BIGINT), 'run': CAST(-1 AS BIGINT), 'settled': TRUE}}
      WHEN st.run <> e.run THEN {{'chunks': {done}, 'win': e.win, 'total': e.total, 'run': e.run, 'settled': TRUE}}
      WHEN st.total + e.total > {size} THEN {{
        'chunks': {done}, 'win': list_concat(st.win[{start}:], e.win),
        'total': {length_from(start)} + e.total, 'run': e.run, 'settled': TRUE}}
      ELSE {{'chunks': st.chunks, 'win': list_concat(st.win, e.win), 'total': st.total + e.total,
             'run': e.run, 'settled': TRUE}} END,
    {{'chunks': CAST([] AS VARCHAR[]), 'win': CAST([] AS VARCHAR[]), 'total': CAST(0 AS BIGINT),
      'run': CAST(-1 AS BIGINT), 'settled': TRUE}}) AS st
  FROM parts_{strategy}_{len(separators)}"""
    CTES[f"separated_{strategy}"] = f"""
  SELECT doc_pos, doc_id, title, product_type, source, '{HEADING}' AS section, piece - 1 AS piece, {clean('chunk')} AS text
  FROM (SELECT *, unnest(chunks) AS chunk, unnest(range(1, len(chunks) + 1)) AS piece
        FROM (SELECT *, list_concat(st.chunks, {flushed('st.win')}) AS chunks FROM merged_{strategy}))"""


for _name in fv.CHUNK_STRATEGIES:
    _separator_ctes(_name, SIZE, fv.CHUNK_OVERLAP)
CTES["chunks"] = """
  SELECT *, doc_id || ':' || section || ':recursive:' || piece AS chunk_id,
         source || ' / ' || section AS citation FROM chunks_recursive"""
CTES["chunk_tokens"] = f"SELECT *, {tokens('text')} AS toks FROM chunks"

# --- hashing embedding ---------------------------------------------------------
_BUCKET = f"CAST('0x' || substr(md5(tok), 1, 8) AS BIGINT) % {fv.EMBEDDING_DIM}"
_SIGN = "CASE WHEN CAST('0x' || substr(md5(tok), 9, 2) AS BIGINT) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END"
CTES["chunk_cells"] = f"""
  SELECT doc_pos, piece, {_BUCKET} AS bucket, sum({_SIGN}) AS val
  FROM (SELECT doc_pos, piece, unnest(toks) AS tok FROM chunk_tokens) GROUP BY 1, 2, 3"""
CTES["chunk_norms"] = "SELECT doc_pos, piece, sqrt(sum(val * val)) AS norm FROM chunk_cells GROUP BY 1, 2"

# --- query analysis --------------------------------------------------------------
CTES["lexicon"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{p}', {words(w)})" for i, (p, w) in enumerate(LEXICON.items())
) + ") v(ord, product_type, keywords)"
CTES["rules"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {words(w)}, '{s}')" for i, (w, s) in enumerate(RULES)
) + ") v(ord, triggers, suffix)"
CTES["inferred"] = f"""
  SELECT qid, CASE WHEN n > 0 THEN product_type END AS wanted FROM (
    SELECT qid, product_type, {shared(tokens('query'), 'keywords')} AS n,
           row_number() OVER (PARTITION BY qid ORDER BY {shared(tokens('query'), 'keywords')} DESC, ord) AS r
    FROM asked, lexicon) WHERE r = 1"""
CTES["variants"] = f"""
  SELECT qid, 0 AS variant, query AS text FROM asked UNION ALL
  SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY ord), query || ' ' || suffix
  FROM asked, rules WHERE {shared(tokens('query'), 'triggers')} > 0"""
# The searches to run: (qid, variant, text, wanted product or null).
SEARCHES = {
    "plain": "SELECT qid, 0 AS variant, query AS text, CAST(NULL AS VARCHAR) AS wanted FROM asked",
    "en": f"SELECT qid, 0 AS variant, query AS text, '{FILTERS['product_type']}' AS wanted FROM asked",
    "multi": "SELECT qid, variant, text, CAST(NULL AS VARCHAR) AS wanted FROM variants",
    "full": "SELECT qid, variant, text, wanted FROM variants JOIN inferred USING (qid)",
    "gold": "SELECT qid, variant, text, coalesce(product_type, wanted) AS wanted FROM variants JOIN gold USING (qid) JOIN inferred USING (qid)",
}


def _search_ctes() -> None:
    for name, source in SEARCHES.items():
        for strategy in ("recursive", "sentence"):
            if strategy == "sentence" and name != "gold":
                continue
            end = name if strategy == "recursive" else f"{name}_{strategy}"
            suffix = "" if strategy == "recursive" else f"_{strategy}"
            CTES[f"s_{end}"] = source
            CTES[f"st_{end}"] = f"SELECT qid, variant, wanted, unnest({tokens('text')}) AS tok FROM s_{end}"
            CTES[f"sc_{end}"] = f"""
  SELECT qid, variant, {_BUCKET} AS bucket, sum({_SIGN}) AS val FROM st_{end} GROUP BY 1, 2, 3"""
            CTES[f"vec_{end}"] = f"""
  SELECT qid, variant, c.doc_pos, c.piece,
         round(coalesce(d.dot / (n.norm * q.norm), 0.0), 10) AS score
  FROM s_{end} s JOIN chunks{suffix} c ON s.wanted IS NULL OR s.wanted = c.product_type
  LEFT JOIN (SELECT q.qid, q.variant, h.doc_pos, h.piece, sum(q.val * h.val) AS dot
             FROM sc_{end} q JOIN chunk_cells{suffix} h USING (bucket) GROUP BY 1, 2, 3, 4) d
    USING (qid, variant, doc_pos, piece)
  LEFT JOIN (SELECT * FROM chunk_norms{suffix} WHERE norm > 0) n USING (doc_pos, piece)
  LEFT JOIN (SELECT qid, variant, nullif(sqrt(sum(val * val)), 0) AS norm FROM sc_{end} GROUP BY 1, 2) q
    USING (qid, variant)"""
            CTES[f"near_{end}"] = f"""
  SELECT *, row_number() OVER (PARTITION BY qid, variant ORDER BY score DESC, doc_pos, piece) AS rank
  FROM vec_{end}"""
            CTES[f"bm_{end}"] = f"""
  SELECT q.qid, q.variant, p.doc_pos, p.piece,
         round(sum(q.n * t.idf * p.tf * ({fv.BM25_K1} + 1) / (p.tf + {fv.BM25_K1} *
           (1 - {fv.BM25_B} + {fv.BM25_B} * greatest(p.dl, 1) / greatest(m.avgdl, 1.0)))), 10) AS score
  FROM (SELECT qid, variant, wanted, tok AS term, count(*) AS n FROM st_{end} GROUP BY 1, 2, 3, 4) q
  JOIN postings{suffix} p USING (term) JOIN term_stats{suffix} t USING (term), corpus_stats{suffix} m
  WHERE q.wanted IS NULL OR q.wanted = p.product_type
  GROUP BY 1, 2, 3, 4"""
            CTES[f"words_{end}"] = f"""
  SELECT *, row_number() OVER (PARTITION BY qid, variant ORDER BY score DESC, doc_pos, piece) AS rank
  FROM bm_{end} WHERE score > 0"""
            CTES[f"fused_{end}"] = f"""
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY qid, variant ORDER BY score DESC, place) AS rank FROM (
      SELECT coalesce(v.qid, b.qid) AS qid, coalesce(v.variant, b.variant) AS variant,
             coalesce(v.doc_pos, b.doc_pos) AS doc_pos, coalesce(v.piece, b.piece) AS piece,
             coalesce(v.rank, {N2} + b.rank) AS place,
             round(coalesce({fv.VECTOR_WEIGHT} * (v.score / v.top), 0.0)
                 + coalesce((1 - {fv.VECTOR_WEIGHT}::DOUBLE) * (b.score / b.top), 0.0), 10) AS score
      FROM (SELECT *, coalesce(nullif(max(score) OVER (PARTITION BY qid, variant), 0), 1.0) AS top
            FROM near_{end} WHERE rank <= {N2}) v
      FULL JOIN (SELECT *, max(score) OVER (PARTITION BY qid, variant) AS top
            FROM words_{end} WHERE rank <= {N2}) b
        ON v.qid = b.qid AND v.variant = b.variant AND v.doc_pos = b.doc_pos AND v.piece = b.piece))
  WHERE rank <= {K}"""
            CTES[f"top_{end}"] = f"SELECT * FROM near_{end} WHERE rank <= {K}"
            CTES[f"sims_{end}"] = f"""
  SELECT a.qid, a.variant, a.rank AS ra, b.rank AS rb, round(sum(x.val * y.val) / any_value(m.norm * n.norm), 10) AS sim
  FROM near_{end} a JOIN near_{end} b ON a.qid = b.qid AND a.variant = b.variant
  JOIN chunk_cells x ON x.doc_pos = a.doc_pos AND x.piece = a.piece
  JOIN chunk_cells y ON y.doc_pos = b.doc_pos AND y.piece = b.piece AND y.bucket = x.bucket
  JOIN chunk_norms m ON m.doc_pos = a.doc_pos AND m.piece = a.piece
  JOIN chunk_norms n ON n.doc_pos = b.doc_pos AND n.piece = b.piece
  WHERE a.rank <= {fv.MMR_FETCH_K} AND b.rank <= {fv.MMR_FETCH_K} GROUP BY 1, 2, 3, 4"""
            CTES[f"sim_lists_{end}"] = f"""
  SELECT qid, variant, ra, list(coalesce(sim, 0.0) ORDER BY rb) AS sims FROM (
    SELECT a.qid, a.variant, a.rank AS ra, b.rank AS rb FROM near_{end} a JOIN near_{end} b
    ON a.qid = b.qid AND a.variant = b.variant
    WHERE a.rank <= {fv.MMR_FETCH_K} AND b.rank <= {fv.MMR_FETCH_K})
  LEFT JOIN sims_{end} USING (qid, variant, ra, rb) GROUP BY 1, 2, 3"""
            CTES[f"picks_{end}"] = _greedy(f"near_{end}", f"sim_lists_{end}", ["qid", "variant"])
            CTES[f"mmr_{end}"] = f"""
  SELECT n.qid, n.variant, n.doc_pos, n.piece, n.score, p.step AS rank
  FROM (SELECT qid, variant, unnest(picked) AS near_rank, generate_subscripts(picked, 1) AS step
        FROM picks_{end}) p
  JOIN near_{end} n ON n.qid = p.qid AND n.variant = p.variant AND n.rank = p.near_rank"""
            for kind in ("fused", "top", "mmr"):
                _merge_ctes(kind, end, suffix)


def _greedy(near: str, sims: str, keys: list[str]) -> str:
    """MMR as a fold over steps 1..k, with the picked ranks as state."""
    by = ", ".join(keys)
    return f"""
  SELECT {by}, list_reduce(list_transform(generate_series(1, {K}), lambda z: [z]), lambda st, z: coalesce(list_concat(st,
      [list_sort(list_transform(list_filter(cands, lambda c: NOT list_contains(st, c.rank)),
        lambda c: {{'v': -round({fv.MMR_LAMBDA} * c.score - (1 - {fv.MMR_LAMBDA}::DOUBLE) *
            coalesce(list_max(list_transform(st, lambda p: c.sims[p])), 0.0), 10), 'r': c.rank}}))[1].r]), st),
      CAST([] AS BIGINT[])) AS picked
  FROM (SELECT {by}, list({{'rank': n.rank, 'score': n.score, 'sims': s.sims}} ORDER BY n.rank) AS cands
        FROM {near} n JOIN (SELECT {by}, ra AS rank, sims FROM {sims}) s USING ({by}, rank) GROUP BY {by})"""


def _merge_ctes(kind: str, end: str, suffix: str) -> None:
    CTES[f"merged_{kind}_{end}"] = f"""
  SELECT qid, doc_pos, piece, max(score) AS score, min(variant * 1000 + rank) AS seen
  FROM {kind}_{end} GROUP BY 1, 2, 3"""
    CTES[f"ctx_{kind}_{end}"] = f"""
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score + bonus, 10) DESC, seen) AS rank FROM (
      SELECT m.qid, m.score, m.seen, c.chunk_id, c.text, c.doc_id, c.section, c.citation, q.query,
             {ratio(tokens('q.query'), tokens('c.text'))} AS bonus
      FROM merged_{kind}_{end} m JOIN chunks{suffix} c USING (doc_pos, piece) JOIN asked q USING (qid)))
  WHERE rank <= {K}"""


# --- BM25 statistics -------------------------------------------------------------
CTES["postings"] = """
  SELECT doc_pos, piece, product_type, dl, term, count(*) AS tf FROM (
    SELECT doc_pos, piece, product_type, len(toks) AS dl, unnest(toks) AS term FROM chunk_tokens)
  GROUP BY ALL"""
CTES["corpus_stats"] = "SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM chunk_tokens"
CTES["term_stats"] = """
  SELECT term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY 1), corpus_stats"""

# The sentence strategy's copies of the corpus CTEs (chunks_sentence is the base).
CTES["sentence_chunks"] = """
  SELECT *, doc_id || ':' || section || ':sentence:' || piece AS chunk_id,
         source || ' / ' || section AS citation FROM chunks_sentence"""

# --- gold --------------------------------------------------------------------------
CTES["gold_pairs"] = """
  SELECT qid, doc_pos, doc_id, product_type FROM asked JOIN docs ON query <> '' AND contains(body, query)"""
CTES["gold"] = """
  SELECT a.qid, query, arg_min(doc_id, doc_pos) AS expected_doc_id, arg_min(product_type, doc_pos) AS product_type
  FROM asked a LEFT JOIN gold_pairs USING (qid) GROUP BY 1, 2"""

# --- label centroids -----------------------------------------------------------------
CTES["cells"] = """
  SELECT vec_id, label, unnest(embedding)::DOUBLE AS val, generate_subscripts(embedding, 1) AS pos
  FROM embeddings"""
CTES["means"] = "SELECT CAST(label AS BIGINT) AS qid, pos, avg(val) AS val FROM cells GROUP BY 1, 2"
CTES["vnorms"] = "SELECT vec_id, label, sqrt(sum(val * val)) AS norm FROM cells GROUP BY 1, 2"
CTES["mnorms"] = "SELECT qid, sqrt(sum(val * val)) AS norm FROM means GROUP BY 1"
CTES["pairs"] = """
  SELECT d.qid, d.vec_id, v.label, round(d.dot / (v.norm * m.norm), 10) AS score,
         round(1.0 / (1.0 + greatest(v.norm * v.norm + m.norm * m.norm - 2 * d.dot, 0.0)), 10) AS near
  FROM (SELECT qid, vec_id, sum(c.val * m.val) AS dot FROM cells c JOIN means m USING (pos) GROUP BY 1, 2) d
  JOIN vnorms v USING (vec_id) JOIN mnorms m USING (qid)"""
CTES["pair_near"] = """
  SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM pairs"""
CTES["pair_sims"] = f"""
  SELECT qid, ra, list(sim ORDER BY rb) AS sims FROM (
    SELECT a.qid, a.rank AS ra, b.rank AS rb,
           round(sum(x.val * y.val) / any_value(m.norm * n.norm), 10) AS sim
    FROM pair_near a JOIN pair_near b USING (qid)
    JOIN cells x ON x.vec_id = a.vec_id JOIN cells y ON y.vec_id = b.vec_id AND y.pos = x.pos
    JOIN vnorms m ON m.vec_id = a.vec_id JOIN vnorms n ON n.vec_id = b.vec_id
    WHERE a.rank <= {fv.MMR_FETCH_K} AND b.rank <= {fv.MMR_FETCH_K} GROUP BY 1, 2, 3) GROUP BY 1, 2"""
CTES["pair_picks"] = _greedy("pair_near", "pair_sims", ["qid"])

# --- conversations ---------------------------------------------------------------------
CTES["exchanges"] = """
  SELECT u.conv_id, u.turn, u.text AS question, a.text AS reply
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'"""

_search_ctes()

# --- answers ----------------------------------------------------------------------------
CTES["ctx"] = "SELECT * FROM ctx_fused_full"
CTES["ranked_sentences"] = f"""
  SELECT qid, rank, sentence, i, row_number() OVER (PARTITION BY qid, rank ORDER BY o DESC, i) AS r FROM (
    SELECT qid, rank, e.s AS sentence, e.i AS i, {shared(tokens('query'), tokens('e.s'))} AS o FROM (
      SELECT qid, rank, query, unnest(list_transform({sentences('text')}, lambda s, i: {{'s': s, 'i': i}})) AS e
      FROM ctx))"""
CTES["new_sentences"] = """
  SELECT qid, rank, r, sentence FROM (
    SELECT *, row_number() OVER (PARTITION BY qid, sentence ORDER BY rank, r) AS d
    FROM ranked_sentences WHERE r <= 2) WHERE d = 1"""
CTES["reached"] = """
  SELECT c.qid, c.rank, c.citation, count(n.sentence) AS before
  FROM ctx c LEFT JOIN new_sentences n ON n.qid = c.qid AND n.rank < c.rank GROUP BY 1, 2, 3"""
CTES["said"] = """
  SELECT qid, string_agg(sentence, ' ' ORDER BY rank, r) AS body FROM (
    SELECT n.*, row_number() OVER (PARTITION BY qid ORDER BY rank, r) AS nth
    FROM new_sentences n JOIN reached USING (qid, rank) WHERE before < 4) WHERE nth <= 4 GROUP BY 1"""
CTES["sources"] = """
  SELECT qid, string_agg('[' || citation || ']', ' ' ORDER BY rank) AS cited FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS nth FROM (
      SELECT qid, citation, min(rank) AS rank FROM reached WHERE before < 4 GROUP BY 1, 2)) WHERE nth <= 3 GROUP BY 1"""
CTES["gate"] = "SELECT qid, count(*) AS contexts, min_by(score, rank) AS top FROM ctx GROUP BY 1"
CTES["drafts"] = f"""
  SELECT qid, coalesce(nullif({trim("coalesce(body, '')")}, ''), {text(fv.UNCERTAIN_ANSWER)})
           || chr(10) || chr(10) || '{fv.ANSWER_SOURCES_LABEL}' || cited AS draft
  FROM sources LEFT JOIN said USING (qid)"""
CTES["allowed"] = """
  SELECT qid, list(citation ORDER BY rank) AS allowed FROM ctx GROUP BY 1"""


def valid(answer: str) -> str:
    found = f"regexp_extract_all({answer}, '{fv.CITATION_PATTERN}', 1)"
    return f"(len(list_filter({found}, lambda c: NOT list_contains(allowed, c))) = 0)"


def repaired(answer: str) -> str:
    good = "array_to_string(list_transform(allowed[1:3], lambda c: '[' || c || ']'), ' ')"
    return (
        f"CASE WHEN {valid(answer)} THEN {answer} ELSE {answer} || chr(10) || chr(10) || "
        f"'{fv.VERIFIED_SOURCES_LABEL}' || {good} END"
    )


CTES["answers"] = f"""
  SELECT qid, query, CASE WHEN coalesce(top, 0) >= {fv.MIN_RELEVANCE} THEN {repaired('draft')}
                   ELSE {text(fv.LOW_RELEVANCE_ANSWER)} END AS answer, coalesce(allowed, []) AS allowed
  FROM asked LEFT JOIN gate USING (qid) LEFT JOIN drafts USING (qid) LEFT JOIN allowed USING (qid)"""

# --- evaluation ---------------------------------------------------------------------------
for _end in ("gold", "gold_sentence"):
    CTES[f"ranks_{_end}"] = f"""
  SELECT g.qid, g.expected_doc_id,
         coalesce(min(CASE WHEN p.doc_id IS NOT NULL AND c.section = '{HEADING}' THEN c.rank END), 0) AS rank,
         string_agg(c.doc_id || ' / ' || c.section, '|' ORDER BY c.rank) AS top_chunks
  FROM gold g LEFT JOIN ctx_fused_{_end} c USING (qid)
  LEFT JOIN gold_pairs p ON p.qid = g.qid AND p.doc_id = c.doc_id GROUP BY 1, 2"""
_RATES = """avg((rank > 0)::INT) AS hit_rate_at_k,
  avg(CASE WHEN rank > 0 THEN 1.0::DOUBLE / rank ELSE 0.0 END) AS mrr, count(*) AS questions"""


def _sentence_copies() -> None:
    """Statistics CTEs over the sentence chunks, derived from the recursive ones."""
    CTES["chunk_tokens_sentence"] = CTES["chunk_tokens"].replace("FROM chunks", "FROM sentence_chunks")
    for name in ("chunk_cells", "chunk_norms", "postings", "corpus_stats", "term_stats"):
        sql = CTES[name]
        for used in ("chunk_tokens", "chunk_cells", "postings", "corpus_stats"):
            sql = re.sub(rf"\b{used}\b", f"{used}_sentence", sql)
        CTES[f"{name}_sentence"] = sql
    for name in list(CTES):
        if name.endswith("_gold_sentence"):
            CTES[name] = re.sub(r"\bchunks_sentence c\b", "sentence_chunks c", CTES[name])


_sentence_copies()


def with_ctes(final: str) -> str:
    """``final`` preceded by the CTEs it needs, in dependency order."""
    order: list[str] = []

    def visit(sql: str) -> None:
        for name in dict.fromkeys(re.findall(r"\b[a-z_0-9]+\b", sql)):
            if name in CTES and name not in order and re.search(rf"(FROM|JOIN|,)\s+{name}\b", sql):
                visit(CTES[name])
                if name not in order:
                    order.append(name)

    visit(final)
    if not order:
        return final
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in order) + "\n" + final


def _chunk_sql(strategy: str, base: str) -> str:
    return f"""
  SELECT doc_id || ':' || section || ':{strategy}:' || piece AS chunk_id, title, product_type, source,
         section, '{strategy}' AS chunk_strategy, CAST(piece AS VARCHAR) AS chunk_index,
         length(text) AS n_chars, md5(text) AS text_md5 FROM {base}"""


def _hit_sql(cte: str) -> str:
    return f"""
  SELECT h.qid, h.rank, c.chunk_id, round(h.score, 6) AS score
  FROM {cte} h JOIN chunks c USING (doc_pos, piece)"""


def _pair_sql(score: str, where: str = "TRUE") -> str:
    return f"""
  SELECT qid, rank, vec_id, round(score, 6) AS score FROM (
    SELECT qid, vec_id, {score} AS score, row_number() OVER (PARTITION BY qid ORDER BY {score} DESC, vec_id) AS rank
    FROM pairs WHERE {where}) WHERE rank <= {K}"""


def _bm25_sql(searches: str, where: str = "TRUE") -> str:
    return f"""
  SELECT qid, rank, doc_pos, piece, round(score, 6) AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_pos, piece) AS rank
    FROM bm_{searches} h WHERE score > 0 AND {where}) WHERE rank <= {K}"""


_DRAFT = "'See [' || coalesce(allowed[1], 'no source') || ']' || CASE WHEN qid % 2 = 1 THEN ' [nowhere]' ELSE '' END"
_OWN = f"coalesce({sentences('body')}[1], '')"


def _collection(condition: str) -> str:
    """Distance search over the vectors of which even labels were negated."""
    return f"""
  SELECT qid, rank, vec_id, text, label, round(score, 6) AS score FROM (
    SELECT qid, vec_id, label, CASE WHEN label % 2 = 0 THEN 'new' ELSE 'v' || label END AS text,
           1.0 / (1.0 + gap) AS score, row_number() OVER (PARTITION BY qid ORDER BY gap, vec_id) AS rank
    FROM (SELECT m.qid, c.vec_id, c.label,
                 sum(power(CASE WHEN c.label % 2 = 0 THEN -c.val ELSE c.val END - m.val, 2)) AS gap
          FROM cells c JOIN means m USING (pos) WHERE {condition} GROUP BY 1, 2, 3)) WHERE rank <= {K}"""


FINAL: dict[str, str] = {
    "clean_text": "SELECT doc_id, md5(body) AS text_md5, length(body) AS n_chars FROM docs",
    "clean_question_table": "SELECT qid, query FROM asked",
    "flat_document_text": f"""
  SELECT doc_id, md5(t) AS text_md5, length(t) AS n_chars FROM (
    SELECT doc_id, title || chr(10) || chr(10) || '{fv.FLAT_TYPE_LABEL}' || product_type || chr(10) || chr(10) ||
      '{fv.FLAT_SOURCE_LABEL}' || source || chr(10) || chr(10) || '{HEADING}' || chr(10) || body AS t FROM docs)""",
    "tokenize_counts": f"""
  SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, md5(array_to_string(t, ' ')) AS tokens_md5
  FROM (SELECT doc_id, {tokens('text')} AS t FROM documents)""",
    "sql_text_functions": f"""
  SELECT doc_id, md5({clean('text')}) AS text_md5, md5(array_to_string(t, ' ')) AS tokens_md5,
         round({ratio('t', 'o')}, 6) AS overlap
  FROM (SELECT doc_id, text, {tokens('text')} AS t, {tokens("source || ' the el le der'")} AS o FROM documents)""",
    "sql_vector_cosine": "SELECT vec_id, round(score, 6) AS score FROM pairs WHERE qid = label",
    "json_round_trip": "SELECT doc_id, 'Document ' || doc_id AS title, md5(body) AS text_md5, length(body) AS n_chars FROM docs",
    "sentence_split": f"""
  SELECT doc_id, e.p - 1 AS pos, e.s AS sentence FROM (
    SELECT doc_id, unnest(list_transform({sentences('text')}, lambda s, i: {{'s': s, 'p': i}})) AS e FROM documents)""",
    "sentence_split_dot": f"""
  SELECT doc_id, e.p - 1 AS pos, e.s AS sentence FROM (
    SELECT doc_id, unnest(list_transform({dot_sentences('text')}, lambda s, i: {{'s': s, 'p': i}})) AS e FROM documents)""",
    "lexical_overlap": f"""
  SELECT conv_id, turn, {shared('q', 'r')} AS shared, round({ratio('q', 'r')}, 6) AS ratio,
         round({ratio('r', 'q')}, 6) AS reverse_ratio
  FROM (SELECT conv_id, turn, {tokens('question')} AS q, {tokens('reply')} AS r FROM exchanges)""",
    "context_citation": """
  SELECT doc_id, coalesce(nullif(source, 'src0'), doc_id) || ' / ' || product_type AS citation FROM docs""",
    "citation_extraction": f"""
  SELECT doc_id, array_to_string(regexp_extract_all(
    text || ' [' || source || ' / body] [' || lang || '] [', '{fv.CITATION_PATTERN}', 1), '|') AS citations FROM documents""",
    "chunk_size": _chunk_sql("size", "chunks_recursive"),
    "chunk_sentence": _chunk_sql("sentence", "chunks_sentence"),
    "chunk_recursive": _chunk_sql("recursive", "chunks_recursive"),
    "chunk_separators_size": _chunk_sql("size", "separated_size"),
    "chunk_separators_sentence": _chunk_sql("sentence", "separated_sentence"),
    "chunk_separators_recursive": _chunk_sql("recursive", "separated_recursive"),
    "chunk_stats": """
  SELECT s AS chunk_strategy, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars, max(length(text)) AS longest
  FROM (SELECT 'size' AS s, text FROM chunks_recursive UNION ALL SELECT 'recursive', text FROM chunks_recursive
        UNION ALL SELECT 'sentence', text FROM chunks_sentence) GROUP BY 1""",
    "metadata_filter": """
  SELECT chunk_id, product_type, source FROM chunks WHERE product_type = 'en' AND source = 'src1'""",
    "vector_topk": _pair_sql("score"),
    "vector_topk_filtered": _pair_sql("score", "label = qid"),
    "vector_distance_topk": _pair_sql("near"),
    "mmr_topk": """
  SELECT n.qid, p.step AS rank, n.vec_id, round(n.score, 6) AS score
  FROM (SELECT qid, unnest(picked) AS near_rank, generate_subscripts(picked, 1) AS step FROM pair_picks) p
  JOIN pair_near n ON n.qid = p.qid AND n.rank = p.near_rank""",
    "cosine_pairs": "SELECT vec_id, round(score, 6) AS score FROM pairs WHERE qid = label",
    "vector_round_trip": """
  SELECT label, count(*) AS records, round(sum(norm), 6) AS norms, round(sum(first), 6) AS first_cells
  FROM vnorms JOIN (SELECT vec_id, val AS first FROM cells WHERE pos = 1) USING (vec_id) GROUP BY 1""",
    "upsert_last_writer": """
  SELECT md5(text) AS chunk_id, max(doc_id) AS doc_id, arg_max(source, doc_id) AS source FROM documents GROUP BY 1""",
    "collection_upsert": """
  SELECT label, count(*) AS records, round(sum(CASE WHEN label % 2 = 0 THEN -val ELSE val END), 6) AS first_cells
  FROM cells WHERE pos = 1 GROUP BY 1""",
    "collection_search": _collection("TRUE"),
    "collection_search_filtered": _collection("label % 2 = 0"),
    "vector_pruned_topk": f"""
  SELECT qid, rank, vec_id, round(score, 6) AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 10) DESC, vec_id) AS rank FROM (
      SELECT q.vec_id AS qid, v.vec_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score
      FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) AS q CROSS JOIN embeddings AS v)) WHERE rank <= {K}""",
    "collection_search_by_vector": f"""
  SELECT qid, rank, vec_id, text, label, round(1.0 / (1.0 + gap * gap), 6) AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY gap, vec_id) AS rank FROM (
      SELECT q.vec_id AS qid, v.vec_id, v.text, v.label, list_distance(q.e, list_transform(v.e, lambda x: x * v.factor)) AS gap
      FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 100 = 0) AS q
      CROSS JOIN (
        SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
          CASE WHEN vec_id % 14 = 1 THEN 2 WHEN vec_id % 7 = 1 THEN -1 WHEN vec_id % 7 = 2 THEN -2 WHEN vec_id % 7 = 3 THEN 3 ELSE 1 END AS factor,
          CASE WHEN vec_id % 14 = 1 THEN 'b4' WHEN vec_id % 7 BETWEEN 1 AND 3 THEN 'b' || (vec_id % 7) ELSE 'b0' END AS text
        FROM embeddings) AS v)) WHERE rank <= {K}""",
    "hash_embedding": """
  SELECT chunk_id, count(*) AS nonzero, round(sum(val / norm), 6) AS total, round(sum(val / norm * bucket), 6) AS moment
  FROM chunk_cells JOIN chunk_norms USING (doc_pos, piece) JOIN chunks USING (doc_pos, piece)
  WHERE val <> 0 GROUP BY 1""",
    "hash_vector_topk": _hit_sql("top_plain"),
    "hash_vector_mmr": _hit_sql("mmr_plain"),
    "bm25_postings": """
  SELECT doc_pos, piece, dl, count(*) AS terms, CAST(sum(tf) AS BIGINT) AS tokens,
         CAST(sum(tf * length(term)) AS BIGINT) AS chars FROM postings GROUP BY 1, 2, 3""",
    "bm25_term_stats": "SELECT term, df, round(idf, 6) AS idf FROM term_stats",
    "bm25_doc_stats": "SELECT doc_pos, piece, len(toks) AS dl FROM chunk_tokens",
    "bm25_corpus_stats": "SELECT n, round(avgdl, 6) AS avgdl FROM corpus_stats",
    "bm25_topk": _bm25_sql("plain"),
    "bm25_topk_filtered": _bm25_sql("en"),
    "bm25_after_add": _bm25_sql("plain"),
    "bm25_index_topk": _bm25_sql("plain"),
    "bm25_index_topk_filtered": _bm25_sql("en"),
    "bm25_topk_source_filtered": _bm25_sql(
        "plain", "(doc_pos, piece) IN (SELECT (doc_pos, piece) FROM chunks WHERE source = 'src1')"
    ),
    "infer_filters": "SELECT qid, wanted AS product_type FROM inferred",
    "expand_queries": "SELECT qid, CAST(variant AS INT) AS variant, text FROM variants",
    "hybrid_topk": _hit_sql("fused_plain"),
    "hybrid_topk_filtered": _hit_sql("fused_en"),
    "multi_query_merge": """
  SELECT m.qid, c.chunk_id, round(m.score, 6) AS score FROM merged_fused_multi m JOIN chunks c USING (doc_pos, piece)""",
    "retrieve_hybrid": "SELECT qid, rank, chunk_id, citation, round(score, 6) AS score FROM ctx",
    "retrieve_similarity": "SELECT qid, rank, chunk_id, round(score, 6) AS score FROM ctx_top_full",
    "retrieve_mmr": "SELECT qid, rank, chunk_id, round(score, 6) AS score FROM ctx_mmr_full",
    "rerank_single_query": "SELECT qid, rank, chunk_id, round(score, 6) AS score FROM ctx_fused_plain",
    "compress_documents": f"""
  SELECT doc_id, length(t) AS n_chars, md5(t) AS text_md5 FROM (
    SELECT doc_id, {compressed('body', 'own')} AS t FROM (SELECT doc_id, body, {tokens(_OWN)} AS own FROM docs))""",
    "answer_extractive": f"SELECT qid, answer, {valid('answer')} AS citation_validation FROM answers",
    "relevance_gate": f"""
  SELECT qid, coalesce(top, 0) < {GATE} AS refused, coalesce(contexts, 0) AS contexts,
         CASE WHEN coalesce(top, 0) < {GATE} THEN TRUE ELSE {valid(repaired('draft'))} END AS citation_validation
  FROM asked LEFT JOIN gate USING (qid) LEFT JOIN drafts USING (qid) LEFT JOIN allowed USING (qid)""",
    "citation_repair": f"""
  SELECT qid, {valid('draft')} AS valid, {repaired('draft')} AS answer, {valid(repaired('draft'))} AS valid_after
  FROM (SELECT qid, coalesce(allowed, []) AS allowed, {_DRAFT} AS draft FROM asked LEFT JOIN allowed USING (qid))""",
    "prompt_messages": f"""
  SELECT qid, CAST(4 AS BIGINT) AS messages, md5('system=' || {text(fv.SYSTEM_PROMPT)} || '|user=earlier|assistant=' || query ||
      '|user=' || {text(fv.PROMPT_CONTEXT_LABEL)} || coalesce(blocks, '') || {text(fv.PROMPT_QUESTION_LABEL)} || query) AS prompt_md5
  FROM asked LEFT JOIN (
    SELECT qid, string_agg('[' || citation || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS blocks
    FROM ctx GROUP BY 1) USING (qid)""",
    "history_query": f"""
  SELECT conv_id, turn, CAST(n AS BIGINT) AS exchanges, md5(CASE WHEN n = 0 THEN text ELSE
      CASE WHEN n = 2 THEN turn2 || ' ' ELSE '' END || turn1 || '{fv.HISTORY_QUESTION_LABEL}' || text END) AS query_md5
  FROM (SELECT c.conv_id, c.turn, c.text,
          CASE WHEN a.turn IS NULL THEN 0 WHEN b.turn IS NULL THEN 1 ELSE 2 END AS n,
          '{fv.HISTORY_USER_LABEL}' || a.question || '{fv.HISTORY_ASSISTANT_LABEL}' || a.reply AS turn1,
          '{fv.HISTORY_USER_LABEL}' || b.question || '{fv.HISTORY_ASSISTANT_LABEL}' || b.reply AS turn2
        FROM conversations c
        LEFT JOIN exchanges a ON a.conv_id = c.conv_id AND a.turn = c.turn - 2
        LEFT JOIN exchanges b ON b.conv_id = c.conv_id AND b.turn = c.turn - 4
        WHERE c.role = 'user')""",
    "answer_cache": f"""
  SELECT qid, question, min(qid) OVER (PARTITION BY question, late) AS answered_by FROM (
    SELECT conv_id * 1048576 + turn AS qid, turn > 2 AS late, coalesce({tokens('text')}[1], '') AS question
    FROM conversations WHERE role = 'user')""",
    "first_rank": "SELECT qid, expected_doc_id, rank FROM ranks_gold",
    "hit_rate_mrr": f"""
  SELECT round(hit_rate_at_k, 6) AS hit_rate_at_k, round(mrr, 6) AS mrr, questions
  FROM (SELECT {_RATES} FROM ranks_gold)""",
    "question_report": f"""
  SELECT qid, coalesce(expected_doc_id, 'none') || ' / {HEADING}' AS expected, rank > 0 AS hit, rank, coalesce(top_chunks, '') AS top_chunks
  FROM ranks_gold""",
    "chunking_comparison": f"""
  SELECT strategy, round(hit_rate_at_k, 4) AS hit_rate_at_k, round(mrr, 4) AS mrr, questions FROM (
    SELECT strategy, {_RATES} FROM (
      SELECT 'size' AS strategy, rank FROM ranks_gold UNION ALL SELECT 'recursive', rank FROM ranks_gold
      UNION ALL SELECT 'sentence', rank FROM ranks_gold_sentence) GROUP BY 1)""",
    "answer_quality_proxies": f"""
  SELECT round(avg({ratio('said', 'shown')}), 6) AS faithfulness, round(avg({ratio('q', 'said')}), 6) AS answer_relevancy,
         round(avg(best), 6) AS context_relevancy
  FROM (SELECT qid, {tokens('answer')} AS said, {tokens('query')} AS q,
               coalesce({tokens('shown')}, []) AS shown, coalesce(best, 0.0) AS best
        FROM answers LEFT JOIN (
          SELECT qid, string_agg(text, ' ' ORDER BY rank) AS shown,
                 max({ratio(f"list_concat({tokens('query')}, {tokens(chr(39) + HEADING + chr(39))})", tokens('text'))}) AS best
          FROM ctx GROUP BY 1) USING (qid))""",
}


def oracle_sql() -> dict[str, str]:
    return {name: with_ctes(sql) for name, sql in FINAL.items()}
