"""DuckDB SQL for the derived inputs of ``parley.sources.fixtures``.

Written independently from the Spark code as the oracle side: same rules,
DuckDB functions.  ``with_fixtures`` prepends the CTEs a query needs.
"""

from __future__ import annotations

import re

# Python-whitespace class in RE2 syntax, and the characters for trim().
WS_RUN = (r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
          r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+")
WS_CHARS_SQL = ("chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) "
                "|| chr(31) || chr(32) || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) "
                "|| chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) "
                "|| chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) "
                "|| chr(8287) || chr(12288)")
NL = "chr(10)"


def strip(expr: str) -> str:
    return f"trim({expr}, {WS_CHARS_SQL})"


def words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '{WS_RUN}'), lambda w: w <> '')"


def escape(expr: str) -> str:
    return (f"replace(replace(replace({expr}, '\\', '\\\\'), '\"', '\\\"'), {NL}, '\\n')")


def unescape(expr: str) -> str:
    park = "chr(57344)"
    t = f"replace({expr}, '\\\\', {park})"
    for esc, val in (("\\\"", "'\"'"), ("\\''", "''''"), ("\\n", "chr(10)"), ("\\t", "chr(9)"),
                     ("\\r", "chr(13)")):
        t = f"replace({t}, '{esc}', {val})"
    return f"replace({t}, {park}, '\\')"


FIXTURES: dict[str, str] = {
    "f_pages": """
        SELECT doc_id, k AS page_no, arr[k + 1] AS page_text
        FROM (SELECT doc_id, arr, unnest(range(len(arr))) AS k
              FROM (SELECT doc_id, string_split(text, chr(10)) AS arr FROM documents))""",
    "f_words": f"""
        SELECT doc_id, {words('text')} AS w FROM documents""",
    "f_chunks": """
        SELECT doc_id, i AS chunk_idx,
               len(w[i * 100 + 1 : (i + 1) * 100]) AS n_words,
               array_to_string(w[i * 100 + 1 : (i + 1) * 100], ' ') AS text
        FROM (SELECT doc_id, w, unnest(range(CAST(ceil(len(w) / 100.0) AS BIGINT))) AS i FROM f_words)""",
    "f_marked": """
        SELECT doc_id, text || CASE doc_id % 8
            WHEN 0 THEN ' $x^2+1$ tail'
            WHEN 1 THEN ' \\alpha{b} tail'
            WHEN 2 THEN ' [12, 3] tail'
            WHEN 3 THEN ' (Smith et al., 2020) tail'
            WHEN 4 THEN chr(10) || '• bullet item' || chr(10) || '1. first'
            WHEN 5 THEN chr(10) || 'Here''s the cleaned text:' || chr(10) || 'tail'
            WHEN 6 THEN ' Umm, hmm [laughs] tail'
            ELSE chr(10) || chr(10) || chr(10) || chr(10) || 'References' || chr(10) || '[1] x' END AS text
        FROM documents""",
    "f_responses": """
        SELECT doc_id, chunk_idx,
               CAST(CASE WHEN r = 0 THEN 500 ELSE 200 END AS BIGINT) AS status,
               CASE WHEN r = 0 THEN '{"error":"server"}' WHEN r = 1 THEN 'not json' WHEN r = 2 THEN '{}'
                    ELSE json_object('choices', json_array(json_object('message',
                         json_object('content', '  [ok] ' || text || ' '))))::VARCHAR END AS body
        FROM (SELECT *, (doc_id * 7 + chunk_idx * 3) % 10 AS r FROM f_chunks) WHERE r <> 3""",
    "f_segments": """
        SELECT conv_id AS episode_id, turn AS seg_idx,
               CASE role WHEN 'assistant' THEN 'Speaker 1' WHEN 'user' THEN 'Speaker 2' ELSE 'Speaker 3' END AS speaker,
               CASE WHEN turn % 5 = 2 THEN 'He said "so\\far" ' || text ELSE text END AS text
        FROM conversations""",
    "f_replies": f"""
        SELECT episode_id, 'Sure!' || chr(10) || '[' || chr(10)
               || string_agg('("' || speaker || '", "' || {escape('text')}
                             || CASE WHEN episode_id % 10 = 3 AND seg_idx = 1 THEN '"x)' ELSE '"),' END,
                             chr(10) ORDER BY seg_idx)
               || chr(10) || ']' AS reply
        FROM f_segments GROUP BY episode_id""",
    "f_synth": """
        SELECT episode_id, seg_idx, speaker, text, CAST(length(text) * 60 AS BIGINT) AS dur_ms,
               (episode_id * 31 + seg_idx) % 7 <> 0 AS ok, CAST(24000 AS BIGINT) AS frame_rate,
               CASE WHEN (episode_id * 31 + seg_idx) % 7 <> 0 THEN NULL
                    WHEN (episode_id + seg_idx) % 2 = 0 THEN 'no_reply' ELSE 'error' END AS fail_kind
        FROM f_segments""",
    "f_pause": """
        SELECT episode_id, seg_idx, CAST((episode_id * 17 + seg_idx * 13) % 600 + 200 AS BIGINT) AS pause_ms
        FROM f_segments""",
    "f_voices": """
        SELECT * FROM (VALUES
            ('openai', 'Speaker 1', 'alloy', false), ('openai', 'Speaker 2', 'echo', true),
            ('bark', 'Speaker 1', 'v2/en_speaker_9', false), ('bark', 'Speaker 2', 'v2/en_speaker_6', true),
            ('eleven', 'Speaker 1', 'voice_a', false), ('eleven', 'Speaker 2', 'voice_b', true))
            AS v(provider, speaker, voice, is_default)""",
    "f_paths": """
        SELECT doc_id, 'in/' || CAST(doc_id AS VARCHAR)
               || CASE doc_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' WHEN 2 THEN '.txt' ELSE '' END AS path
        FROM documents""",
    "f_wave": """
        SELECT CAST(vec_id // 25 AS BIGINT) AS episode_id, vec_id % 25 AS seg_idx,
               CAST(embedding AS DOUBLE[]) AS samples,
               CASE WHEN label % 2 = 0 THEN 'Speaker 1' ELSE 'Speaker 2' END AS speaker
        FROM embeddings""",
    "f_frames": """
        SELECT episode_id, seg_idx, speaker, k AS i, samples[k + 1] AS amp
        FROM (SELECT *, unnest(range(len(samples))) AS k FROM f_wave)""",
    "f_tone": """
        SELECT t, (t - 8) / 80.0::DOUBLE AS amp FROM range(16) r(t)""",
}



def with_fixtures(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the fixture CTEs it references (in dependency order)."""
    extra = extra or {}
    pool = {**FIXTURES, **extra}
    deps = {n: set(re.findall(r"\b[fq]_[a-z0-9_]+\b", s)) & set(pool) - {n} for n, s in pool.items()}
    needed: list[str] = []

    def visit(n: str) -> None:
        if n in needed:
            return
        for d in sorted(deps[n]):
            visit(d)
        needed.append(n)

    for n in sorted(set(re.findall(r"\b[fq]_[a-z0-9_]+\b", sql)) & set(pool)):
        visit(n)
    if not needed:
        return sql
    ctes = ",\n".join(f"{n} AS ({pool[n]})" for n in needed)
    body = sql.lstrip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{sql}"
