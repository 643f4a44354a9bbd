"""DuckDB SQL oracles for the registered queries.

Written independently of the Spark expressions, straight from the reference's
described behaviour, over the same fixture views (as CTEs on the driver
tables).  Two things are shared with the library: the wording of requests and
of the gallery page, which are parameters, not behaviour.  Doubles are rounded to 6 places on both sides; DuckDB's ``cast`` of
a double to int rounds, so truncation is spelled ``trunc``; pandas' half-even
rounding is spelled out with ``floor``.
"""

from __future__ import annotations

import sys

# Python's str.strip() whitespace set, as a DuckDB string expression.
_WS = "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace())
WS = "(" + "||".join(f"chr({ord(ch)})" for ch in _WS) + ")"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def one_line(x: str) -> str:
    return strip(f"replace({x}, chr(10), ' ')")


def pct2(x: str) -> str:
    """numpy round-half-even of x*100 to 2 places."""
    y = f"(({x}) * 100 * 100)"
    return (f"(case when {y} - floor({y}) = 0.5 and floor({y}) % 2 = 0 then floor({y}) "
            f"when {y} - floor({y}) = 0.5 then floor({y}) + 1 else round({y}) end / 100)")


FIXTURE_SQL = {
    "f_raw_prompts": """select doc_id prompt_id,
        case when doc_id % 3 = 0 then chr(9) || ' ' || text || chr(10) else text end raw from documents""",
    "f_noun_chunks": """select doc_id, text prompt,
        case when doc_id % 50 <> 7 then text end noun_chunks from documents""",
    "f_qca_replies": """select doc_id, text prompt,
        case when doc_id % 17 = 0 then null
             when doc_id % 13 = 0 then text
             when doc_id % 11 = 0 then 'Q: ' || text || chr(10) || 'Choices:yes, no' || chr(10) || 'A: yes'
             when doc_id % 7 = 0 then 'About x:' || chr(10) || 'Q: ' ||
                  replace(text, chr(10), chr(10) || 'Choices: yes, no' || chr(10) || 'A: yes' || chr(10) || 'Q: ')
             else 'About x:' || chr(10) || 'Q: ' ||
                  replace(text, chr(10), chr(10) || 'Choices: yes, no' || chr(10) || 'A: yes' || chr(10) || 'Q: ')
                  || chr(10) || 'Choices: one, two, three' || chr(10) || 'A: two' end visual_questions
        from documents""",
    "f_replies": """select conv_id || '-' || turn request_id, conv_id, turn,
        case when conv_id % 9 = 0 then 'filtered' else 'ok' end status, text reply
        from conversations where role = 'assistant'""",
    "f_requests": """select conv_id || '-' || turn request_id, conv_id, turn, text request_text
        from conversations""",
    "f_candidates": """select l_orderkey prompt_id, cast(l_suppkey % 3 as int) iter,
        cast(l_partkey % 4 as int) cand_pos, 'candidate ' || min(l_partkey) revised_prompt,
        floor(max(l_quantity) / 10) / 5 tifa, floor(max(l_discount) * 40 + 0.5) / 4 vqa
        from lineitem group by l_orderkey, cast(l_suppkey % 3 as int), cast(l_partkey % 4 as int)""",
    "f_scored_originals": """select o_orderkey prompt_id, 0 iter, -1 cand_pos, 'prompt ' || o_orderkey revised_prompt,
        (o_orderkey % 6) / 5 tifa, (o_orderkey % 5) / 4 vqa from orders""",
    "f_cand_prompts": """select o_orderkey prompt_id, 'prompt ' || o_orderkey original_prompt from orders""",
    "f_tifa_answers": """select o_orderkey prompt_id, case when l_orderkey is not null then row_number() over
        (partition by o_orderkey order by l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) - 1 end q_pos,
        ' ' || lower(l_returnflag) || ' ' picked,
        case when l_linestatus = 'F' then 'A' when l_linestatus is not null then 'N' end answer
        from orders left join lineitem on o_orderkey = l_orderkey""",
    "f_vqa_replies": """select user_id cand_id, event_id chunk_pos, cast(ts as date) obs_day,
        case event_type when 'click' then ' Yes' when 'view' then 'yes' when 'error' then 'No '
             when 'signup' then 'no' else 'maybe' end reply,
        case when event_type in ('click', 'view') then ' Yes' when event_type = 'purchase' then 'yes.'
             else 'no' end token, value / -100 logprob from events""",
    "f_shards": """select 'ds_process' || (o_orderkey % 4) || '_nextline_' || (40 * (1 + o_custkey % 5)) || '.csv' file_name,
        case when o_orderstatus = 'F' then 0 else 1 end source_rank, o_orderkey row_index,
        'prompt ' || o_custkey original_prompt, o_totalprice score from orders""",
    "f_purposes": """select event_type purpose, event_id seq, value elapsed from events
        union all select 'idle', -1, null""",
    "f_pairs": """select u.conv_id, u.turn, u.text original_prompt, a.text rephrased_prompt,
        case when u.conv_id % 2 = 0 then 'Correct.' else 'Fixed: ' || a.text end corrected_prompt
        from conversations u join conversations a on u.conv_id = a.conv_id and a.turn = u.turn + 1
        where u.role = 'user' and a.role = 'assistant'""",
    "f_existing": """select d.doc_id, d.text prompt from documents d join labels l on d.doc_id = l.doc_id
        where l.quality = 1""",
    "f_images": """select 'img_' || page_id || case page_id % 4 when 0 then '.png' when 1 then '.jpg'
        when 2 then '.html' else '' end path, html from pages""",
    "f_eval_log": """select cast(event_id % 20 as int) step, value / 100 eval_loss from events""",
    "f_generated": """select conv_id, turn, case when conv_id % 10 = 3 then text
        else '[/INST] Absolutely! Here is the rephrased prompt: ' || text end output from conversations""",
}


def with_fixtures(sql: str, *names: str, extra: dict | None = None) -> str:
    ctes = [f"{n} as ({FIXTURE_SQL[n]})" for n in names]
    for k, v in (extra or {}).items():
        ctes.append(f"{k} as ({v})")
    return ("with " + ",\n".join(ctes) + "\n" + sql) if ctes else sql


ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str, *fixtures: str, extra: dict | None = None) -> None:
    ORACLES[name] = with_fixtures(sql, *fixtures, extra=extra)
