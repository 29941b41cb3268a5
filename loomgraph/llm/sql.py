"""DuckDB SQL for the corpus operators that SQL can express."""

from __future__ import annotations

from .line_dedup import TAGS
from .mixing import DOMAIN_WEIGHTS, LANG_WEIGHTS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


OP4 = f"""
WITH d AS (SELECT doc_id, {_words("text")} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_words("text")} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, list_slice(w, s, s + least(13, len(w)) - 1) AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(win) AS n FROM iw),
dw AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n),
hit AS (SELECT doc_id, s, n, item_id FROM (SELECT doc_id, s, n, list_slice(w, s, s + n - 1) AS win FROM dw) AS x JOIN iw USING (win)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _page_text(html: str) -> str:
    for pattern, by in TAGS:
        html = f"regexp_replace({html}, '{pattern}', " + ("chr(10)" if by else "''") + ", 'g')"
    return html


_SITE = r"nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)', 1), '')"
OP7 = rf"""
WITH p AS (SELECT page_id, {_SITE} AS site, string_split(coalesce({_page_text("html")}, ''), chr(10)) AS lines FROM pages),
l AS (SELECT page_id, site, i, lines[i] AS line, trim(regexp_replace(lines[i], '[ \t\r\f\x0B]+', ' ', 'g')) AS k
  FROM (SELECT page_id, site, lines, unnest(range(1, len(lines) + 1)) AS i FROM p)),
gone AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT site) >= 10)
SELECT page_id, any_value(site) AS site, count(*) AS n_lines, count(gone.k) AS n_removed,
  coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (gone.k IS NULL), '') AS kept
FROM l LEFT JOIN gone USING (k) GROUP BY page_id"""


def _case(column: str, weights: dict[str, float]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in weights.items()) + " ELSE 1.0::DOUBLE END"


def _level(level: str, parents: list[str], weight: str, epochs: int, above: str) -> str:
    keys, by = ", ".join([*parents, level]), "PARTITION BY " + ", ".join(parents) if parents else ""
    budget = f"(SELECT budget FROM {above})" if not parents else "a.budget"
    join = f"JOIN {above} AS a USING ({', '.join(parents)})" if parents else ""
    return f"""
n_{level} AS (SELECT n.*, {budget} AS budget FROM (SELECT {keys}, sum(tokens)::DOUBLE * {epochs} AS supply, {weight} AS weight FROM leaves GROUP BY {keys}) AS n {join}),
p_{level} AS (SELECT *, (budget - coalesce(sum(supply) OVER ({by} ORDER BY supply / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER ({by} ORDER BY supply / weight, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS per FROM n_{level}),
b_{level} AS (SELECT {keys}, CASE WHEN supply <= per * weight THEN supply
  ELSE weight * first_value(CASE WHEN supply > per * weight THEN per END IGNORE NULLS) OVER ({by} ORDER BY supply / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS budget FROM p_{level})"""


def mixing_sql(documents: str = "documents", share: float = 0.5, epochs: int = 2, seed: int = 7) -> str:
    """CTEs up to ``taken(doc_id, ..., epoch, leaf_budget)``."""
    return rf"""
tok AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, CASE WHEN k <= 9 THEN 'web' WHEN k <= 15 THEN 'reference' ELSE 'other' END AS domain, n_tokens
  FROM (SELECT *, try_cast(nullif(regexp_extract(source, '^src([0-9]+)$', 1), '') AS INTEGER) AS k, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS n_tokens FROM {documents}) WHERE n_tokens > 0),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM tok GROUP BY ALL),
total AS (SELECT sum(tokens)::DOUBLE * {share!r} AS budget FROM leaves),""" + ",".join([
        _level("domain", [], _case("domain", DOMAIN_WEIGHTS), epochs, "total"),
        _level("lang", ["domain"], _case("lang", LANG_WEIGHTS), epochs, "b_domain"),
        _level("source", ["domain", "lang"], "1.0::DOUBLE", epochs, "b_lang"),
    ]) + rf""",
dealt AS (SELECT t.*, l.tokens, b.budget AS leaf_budget, e.epoch, md5('{seed}-' || e.epoch || '-' || doc_id) AS o
  FROM tok AS t JOIN leaves AS l USING (domain, lang, source) JOIN b_source AS b USING (domain, lang, source), (SELECT unnest(range({epochs})) AS epoch) AS e),
taken AS (SELECT doc_id, domain, lang, source, n_tokens, CAST(epoch AS INTEGER) AS epoch, leaf_budget FROM (SELECT *, epoch * tokens + coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY o, doc_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM dealt) WHERE start < leaf_budget)"""


OP10 = "WITH " + mixing_sql() + " SELECT doc_id, domain, lang, source, CAST(n_tokens AS BIGINT) AS n_tokens, epoch, round(leaf_budget, 3) AS leaf_budget FROM taken"

OP11 = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id)"""

_TERMS = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents WHERE text IS NOT NULL),
f AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
s AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS total FROM d WHERE len(w) > 0),
df AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM f, s GROUP BY t, docs),
m AS (SELECT r, doc_id, 75 + (25 * len(w) * docs) // total AS m FROM d, s WHERE len(w) > 0),
q AS (SELECT item_id, t, count(*) AS n FROM (SELECT item_id, unnest({_TERMS}) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark) AS b) GROUP BY item_id, t),
scored AS (SELECT item_id, r, doc_id, sum(n * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN df USING (t) JOIN f USING (t) JOIN m USING (r) GROUP BY item_id, r, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY rank <= 20"""

ORACLES = {"op4_decontaminate": OP4, "op7_line_dedup": OP7, "op10_mixing": OP10, "op11_exact_dedup": OP11, "op12_ranked_search": OP12}
