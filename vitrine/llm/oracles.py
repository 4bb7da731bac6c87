"""DuckDB SQL with the rows of the registered queries that SQL can express; written without the operators' methods."""

from __future__ import annotations

from .minhash import PERCENT, WORDS
from .repeats import LENGTH
from .secrets import BASE, RULES

# Near-duplicates: all pairs of distinct shingle sets that share a shingle, then what can be reached over links.
NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT r, array_to_string(ws[i:i + {WORDS - 1}], ' ') AS g
      FROM (SELECT r, ws, unnest(range(1, greatest(2, len(ws) - {WORDS - 2}))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
whole AS (SELECT r, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY r),
class AS (SELECT r, min(r) OVER (PARTITION BY k) AS c FROM whole),
own AS (SELECT s.r, s.g FROM s JOIN class ON s.r = class.r AND class.c = class.r),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM own a JOIN own b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
link AS (SELECT shared.a, shared.b FROM shared JOIN n na ON na.r = shared.a JOIN n nb ON nb.r = shared.b
         WHERE 100 * shared.n >= {PERCENT} * (na.n + nb.n - shared.n)),
reach AS (SELECT c AS a, c AS b FROM class WHERE c = r UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
part AS (SELECT a, min(b) AS p FROM reach GROUP BY a),
placed AS (SELECT w.r, w.doc_id, part.p FROM w LEFT JOIN class ON w.r = class.r LEFT JOIN part ON part.a = class.c),
least AS (SELECT p, min(doc_id) AS d FROM placed WHERE p IS NOT NULL GROUP BY p),
q AS (SELECT placed.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles,
             CASE WHEN placed.p IS NULL THEN placed.doc_id ELSE least.d END AS component_id
      FROM placed LEFT JOIN n ON placed.r = n.r LEFT JOIN least ON placed.p = least.p)
SELECT doc_id, n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM q
"""


def _either(word: str) -> str:
    """A pattern for `word` in upper or lower case, ASCII letters only."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))

_LABEL = "(?:[A-Z0-9]{1,20} ){0,6}PRIVATE KEY-----"

# One pattern per kind of `secrets.RULES`, in the syntax that DuckDB reads: group 1 is what stands before the match.
_PATTERNS = {
    "assign": rf"""()(?:{_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "()(AKIA[A-Z0-9]+)",
    "hex": "()([0-9a-f]+)",
    "private_key": rf"()(-----BEGIN {_LABEL}(?:[^-]*-----END {_LABEL}|(?:[\x20\x09-\x0D]{{1,4}}[A-Za-z0-9+/=]{{20,}}){{0,40}}))",
    "bearer": rf"()({_either('bearer')}\x20+[A-Za-z0-9._~+/-]{{20,}}=*)",
    "web_token": r"()(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})",
    "url_login": r"()([a-z][a-z0-9+.-]{1,20}://[^\x09-\x0D\x20:/@]{1,64}:[^\x09-\x0D\x20:/@]{3,64}@)",
    "prefixed": "(^|[^A-Za-z0-9_])((?:gh[pousr]_|glpat-|xox[abprs]-|sk_live_)[A-Za-z0-9_-]{16,})",
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_KINDS = ", ".join(
    f"({_quoted(rule.kind)}, {place}, {rule.least})" for place, rule in enumerate(RULES, 1)
)
_MATCHES = " UNION ALL ".join(
    f"""SELECT r, {place} AS place, unnest(range(1, len(f) + 1)) AS i, unnest(f) AS f, unnest(lead) AS lead,
       unnest(m) AS m, unnest(gaps[:len(f)]) AS gap
FROM (SELECT r, regexp_extract_all(t, p, 0) AS f, regexp_extract_all(t, p, 1) AS lead, regexp_extract_all(t, p, 2) AS m,
             string_split_regex(t, p) AS gaps FROM (SELECT r, t, {_quoted(_PATTERNS[rule.kind])} AS p FROM d))"""
    for place, rule in enumerate(RULES, 1)
)

# Secrets: every match is placed by the lengths of the texts between and in the matches before it.
SECRETS = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
kinds(kind, place, least) AS (VALUES {_KINDS}),
found AS ({_MATCHES}),
placed AS (SELECT r, place, m, length(f) AS n, length(lead) AS l,
                  sum(length(gap) + length(f)) OVER (PARTITION BY r, place ORDER BY i) AS e FROM found),
span AS (SELECT r, place, kind, (e - n + l)::BIGINT AS s, kind || ':' || (e - n + l)::BIGINT || ':' || e::BIGINT AS x
         FROM placed JOIN kinds USING (place) WHERE length(m) >= least),
per AS (SELECT r, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k,
               count(*) FILTER (kind = 'hex') AS h,
               coalesce(string_agg(x, ',' ORDER BY s, place) FILTER (place <= {len(BASE)}), '') AS base,
               string_agg(x, ',' ORDER BY s, place) AS spans
        FROM span GROUP BY r)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(k, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (r)
"""

_STEP = 1000  # windows cut from one piece of a text, so that no cut walks through a long text

# Long repeats: the hash of every window of every text, counted; texts are written as hexadecimal digits.
REPEATS = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n
           FROM documents),
piece AS (SELECT r, n, c, substring(h, 2 * c + 1, {2 * (_STEP + LENGTH - 1)}) AS p
          FROM (SELECT r, h, n, unnest(range(0, greatest(n - {LENGTH - 1}, 0), {_STEP})) AS c FROM d)),
win AS (SELECT r, c + k AS pos, md5_number(substring(p, 2 * k + 1, {2 * LENGTH})) AS w
        FROM (SELECT r, c, p, unnest(range(0, least({_STEP}, n - {LENGTH - 1} - c))) AS k FROM piece)),
dup AS (SELECT r, pos FROM (SELECT r, pos, count(*) OVER (PARTITION BY w) AS times FROM win) WHERE times > 1),
mark AS (SELECT r, pos, pos > coalesce(lag(pos) OVER (PARTITION BY r ORDER BY pos), -{LENGTH + 1}) + {LENGTH} AS fresh FROM dup),
run AS (SELECT r, pos, sum(fresh::INT) OVER (PARTITION BY r ORDER BY pos) AS k FROM mark),
span AS (SELECT r, min(pos) AS s, max(pos) + {LENGTH} AS e FROM run GROUP BY r, k),
gap AS (SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS before FROM span),
cut AS (SELECT gap.r, sum(e - s) AS removed, count(*) AS spans,
               string_agg(substring(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s)
               || substring(any_value(h), 2 * max(e) + 1) AS kept
        FROM gap JOIN d ON d.r = gap.r GROUP BY gap.r)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""
