"""Pieces of SQL shared by the oracles of several modules."""

from __future__ import annotations

#: little-endian float32 values of a base64 text, as doubles: sign, exponent and fraction from the hex digits
FLOATS = """list_transform(range(0, len(hex(from_base64({0}))) // 8), lambda i: (
    list_transform([('0x' || substr(hex(from_base64({0})), 8 * i + 7, 2) || substr(hex(from_base64({0})), 8 * i + 5, 2) || substr(hex(from_base64({0})), 8 * i + 3, 2) || substr(hex(from_base64({0})), 8 * i + 1, 2))::BIGINT],
    lambda u: CASE WHEN u % 2147483648 = 0 THEN 0.0::DOUBLE ELSE (CASE WHEN u >= 2147483648 THEN -1.0 ELSE 1.0 END)::DOUBLE * CASE WHEN (u // 8388608) % 256 = 0 THEN (u % 8388608) / 8388608.0::DOUBLE * pow(2, -126) ELSE (1 + (u % 8388608) / 8388608.0::DOUBLE) * pow(2, (u // 8388608) % 256 - 127) END END)[1]))"""

#: (item, name, grp, e): readable vectors of cluster_items, repeated rows once
ITEMS = f"""it AS (SELECT item_id AS item, any_value(mentions) AS name, any_value(request_id) AS grp, any_value(regexp_replace(CASE WHEN length(embeddings) > 0 THEN embeddings ELSE encodings END, '\\s+', '', 'g')) AS x
    FROM cluster_items WHERE item_id IS NOT NULL GROUP BY 1),
iv AS MATERIALIZED (SELECT item, name, grp, x, {FLOATS.format('x')} AS e FROM it WHERE length(x) = 684),
ok AS MATERIALIZED (SELECT item, name, grp, e FROM iv WHERE len(list_filter(e, lambda v: v <> 0)) > 0 AND len(list_filter(e, lambda v: isnan(v) OR isinf(v) OR abs(v) > 3.5e38)) = 0)"""

#: word list of a text: lower case, split at white space
WORDS = "list_filter(string_split(trim(regexp_replace(lower(coalesce({0}, '')), '\\s+', ' ', 'g')), ' '), lambda w: w <> '')"

#: mentions, one row per ex_id
MENTIONS = """m AS (SELECT ex_id, any_value(word) AS word, any_value(wikiid) AS wikiid, any_value(nil) AS nil, any_value(batch) AS batch, arg_min_null(left_context_text, (coalesce(left_context_text, ''), coalesce(right_context_text, ''))) AS l,
    arg_min_null(right_context_text, (coalesce(left_context_text, ''), coalesce(right_context_text, ''))) AS r,
    any_value(y_title) AS y_title, any_value(url) AS url FROM mentions WHERE ex_id IS NOT NULL GROUP BY 1)"""
