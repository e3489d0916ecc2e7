"""DuckDB SQL that must give the rows of the registered queries, where SQL can say it."""

from __future__ import annotations

_GAP = r" \t\r\f\x0B"
_PIECE = rf"(?:[^{_GAP}\n]{{0,23}}[^{_GAP}\n.!?,;][{_GAP}]{{1,24}}){{0,3}}[^{_GAP}\n]{{1,24}}[{_GAP}]{{0,24}}|[{_GAP}]{{1,24}}"


def _leaves(text: str) -> str:
    """Leaves by section and paragraph."""
    pieces = f"list_transform(regexp_extract_all(p, '{_PIECE}'), lambda x: sha256(x))"
    return f"list_transform(string_split({text}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: {pieces}))"


def _digests(leaves: str) -> str:
    """Paragraphs' digests by section."""
    return f"list_transform({leaves}, lambda s: list_transform(s, lambda p: sha256(array_to_string(p, ''))))"


def _root(tree: str) -> str:
    return f"sha256(array_to_string(list_transform({tree}, lambda s: sha256(array_to_string(s, ''))), ''))"


def _like(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END"


def _place(a: str, b: str) -> str:
    """Place, from 0, of the first entry in which two lists differ."""
    return (f"list_filter(range(0, greatest(coalesce(len({a}), 0), coalesce(len({b}), 0))), "
            f"lambda i: {a}[i + 1] IS DISTINCT FROM {b}[i + 1])[1]")


def _bare_words(text: str) -> str:
    lower = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


SQL: dict[str, str] = {
    "op2_merkle": f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
follow AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text FROM docs WINDOW w AS (ORDER BY doc_id DESC)),
edits AS (SELECT *, left(text, len(text) - len(text) // 2) || left(next_text, len(text) // 2) AS edited FROM follow),
leaves AS (SELECT *, {_leaves("text")} AS tl, {_leaves("edited")} AS el, {_leaves("next_text")} AS nl FROM edits),
trees AS (SELECT *, {_digests("tl")} AS t, {_digests("el")} AS e, list_distinct(flatten(flatten(tl))) AS own,
  list_distinct(flatten(flatten(el))) AS other, list_distinct(flatten(flatten(nl))) AS following FROM leaves),
sections AS (SELECT *, {_place("t", "e")} AS s FROM trees),
paragraphs AS (SELECT *, {_place("t[s + 1]", "e[s + 1]")} AS p FROM sections)
SELECT doc_id, len(text) AS n_chars, sha256(edited) AS edited_sha256, {_root("t")} AS fingerprint, {_root("e")} AS edited_fingerprint,
  ({_like("own", "other")})::DOUBLE AS near_edited, ({_like("own", "following")})::DOUBLE AS near_next, s AS edit_section, p AS edit_paragraph,
  {_place("tl[s + 1][p + 1]", "el[s + 1][p + 1]")} AS edit_piece
FROM paragraphs""",
    "op3_chat_format": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
lengths AS (
  SELECT *, len(role) + 13 + len(regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(\||s>|/s>|<SYS>>|</SYS>>)', '<.\1', 'g'),
             '\[/?INST\]|\|>', '.\0', 'g')) AS formatted FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(formatted)::BIGINT AS formatted_chars
FROM lengths GROUP BY conv_id""",
    "op7_url_rules": r"""
WITH rules(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rests AS (SELECT row_number() OVER () AS n, page_id,
  CASE WHEN position('://' IN url) > 0 THEN substring(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
fits AS (SELECT n, arg_max(struct_pack(rule := r.host || r.path, verdict := r.verdict), len(r.host || r.path) * 1000 + len(r.host)) AS best
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY n)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (n)""",
    "op11_decontaminate": f"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, {_bare_words("text")} AS w FROM documents),
items AS (SELECT item_id, {_bare_words("text")} AS w FROM benchmark WHERE item_id IS NOT NULL),
phrases AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)),
places AS (SELECT n, size, i, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT n, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, (SELECT DISTINCT size FROM phrases))),
hits AS (SELECT DISTINCT n, i, size FROM places SEMI JOIN phrases USING (size, phrase)),
hit_words AS (SELECT n, i + unnest(range(0, size)) AS spot FROM hits),
spots AS (SELECT DISTINCT n, spot FROM hit_words),
totals AS (SELECT n, count(*) AS n_hit, count(*) FILTER (follows IS NULL) AS n_spans
  FROM (SELECT a.n, b.spot AS follows FROM spots a LEFT JOIN spots b ON a.n = b.n AND b.spot = a.spot - 1) GROUP BY n),
named AS (SELECT n, list(DISTINCT item_id::VARCHAR) AS ids FROM places JOIN phrases USING (size, phrase) GROUP BY n)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(list_sort(ids), ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_spans, 0) AS n_spans
FROM docs LEFT JOIN totals USING (n) LEFT JOIN named USING (n)""",
    "op12_ranked_search": f"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, {_bare_words("text")} AS w FROM documents WHERE doc_id IS NOT NULL),
totals AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM docs),
parts AS (SELECT n, any_value(doc_id) AS doc_id, any_value(size)::BIGINT AS size, term, count(*) AS tf
  FROM (SELECT n, doc_id, len(w) AS size, unnest(w) AS term FROM docs) GROUP BY n, term),
item_terms AS (SELECT DISTINCT item_id, unnest({_bare_words("text")}) AS term FROM benchmark WHERE item_id IS NOT NULL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM parts, totals GROUP BY term),
scores AS (SELECT item_id, n, any_value(doc_id) AS doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * size * n_docs) // n_terms))))::BIGINT AS score
  FROM item_terms JOIN parts USING (term) JOIN weights USING (term), totals GROUP BY item_id, n)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0
QUALIFY rank <= 50""",
    "op13_hard_negatives": """
WITH vectors AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3""",
}


def registry() -> dict[str, str]:
    return dict(SQL)