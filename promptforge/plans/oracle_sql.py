"""Oracle SQL text for each registered query (DuckDB dialect)."""

from __future__ import annotations

import re

from promptforge.plans.oracles import ORACLES, oracle, pct2  # noqa: F401  (ORACLES is re-exported)

# ---------------------------------------------------------------- selection
_SCORED = """select *, tifa + vqa sum, (tifa + vqa) / 2 score from f_candidates"""

_ITER_BEST = """select prompt_id, iter, max(tifa) best_tifa, max(vqa) best_vqa, max(sum) best_sum,
    max(cand_pos) filter (where rk = 1) best_cand_pos,
    max(revised_prompt) filter (where rk = 1) best_paraphrase, count(*) n_candidates,
    max(tifa) filter (where rk = 1) winner_tifa, max(vqa) filter (where rk = 1) winner_vqa
  from (select *, row_number() over (partition by prompt_id, iter order by sum desc, cand_pos) rk from scored)
  group by prompt_id, iter"""

oracle("candidate_scores", """select prompt_id, iter, cand_pos, revised_prompt, round(tifa, 6) tifa,
    round(vqa, 6) vqa, round(sum, 6) sum, round(score, 6) score from scored""",
       "f_candidates", extra={"scored": _SCORED})

oracle("iteration_best", """select prompt_id, iter, round(best_tifa, 6) best_tifa, round(best_vqa, 6) best_vqa,
    round(best_sum, 6) best_sum, best_cand_pos, best_paraphrase, n_candidates from ib""",
       "f_candidates", extra={"scored": _SCORED, "ib": _ITER_BEST})

oracle("best_paraphrase", """select p.prompt_id, coalesce(b.iter, -1) best_iter,
    coalesce(b.best_paraphrase, '') best_paraphrase, round(coalesce(b.best_sum, 0.0), 6) best_sum
  from f_cand_prompts p left join (
    select * from (select *, row_number() over (partition by prompt_id order by best_sum desc, iter desc) r
                   from ib where best_sum >= 0) where r = 1) b on p.prompt_id = b.prompt_id""",
       "f_candidates", "f_cand_prompts", extra={"scored": _SCORED, "ib": _ITER_BEST})

oracle("iteration_lists", """select prompt_id, count(*) n_iters,
    string_agg(cast(iter as varchar), ',' order by iter) iters,
    string_agg(printf('%.6f', best_tifa), ',' order by iter) best_tifa_at_each_iter,
    string_agg(printf('%.6f', best_vqa), ',' order by iter) best_vqa_at_each_iter,
    string_agg(printf('%.6f', best_sum), ',' order by iter) best_sum_at_each_iter,
    string_agg(best_paraphrase, ' | ' order by iter) best_paraphrase_at_each_iter
  from ib group by prompt_id""",
       "f_candidates", extra={"scored": _SCORED, "ib": _ITER_BEST})

oracle("running_best", """select a.prompt_id, a.iter,
    round(coalesce(b.best_sum, 0.0), 6) running_best_sum, coalesce(b.iter, -1) running_best_iter,
    coalesce(b.best_paraphrase, '') running_best_paraphrase
  from ib a left join lateral (
    select * from ib b where b.prompt_id = a.prompt_id and b.iter <= a.iter and b.best_sum >= 0
    order by b.best_sum desc, b.iter desc limit 1) b on true""",
       "f_candidates", extra={"scored": _SCORED, "ib": _ITER_BEST})

oracle("run_averages_scoring", f"""select 'tifa_score' metric, {pct2('avg(tifa)')} value from scored
  union all select 'vqa_score', {pct2('avg(vqa)')} from scored
  union all select 'sum_score', {pct2('avg(sum)')} from scored""",
       "f_candidates", extra={"scored": _SCORED})

oracle("run_averages_iterative", f"""select 'best_tifa_at_each_iter' metric, {pct2('avg(t)')} value from pm
  union all select 'best_vqa_at_each_iter', {pct2('avg(v)')} from pm
  union all select 'best_sum_at_each_iter', {pct2('avg(s)')} from pm""",
       "f_candidates", extra={"scored": _SCORED, "ib": _ITER_BEST,
                              "pm": "select prompt_id, max(best_tifa) t, max(best_vqa) v, max(best_sum) s "
                                    "from ib group by prompt_id"})



# ================================================================ helpers
from promptforge.operators import history as _hist  # noqa: E402
from promptforge.operators import requests as _rq  # noqa: E402
from promptforge.operators import training as _tr  # noqa: E402
from promptforge.operators.replies import GENERATION_MARKER  # noqa: E402
from promptforge.plans.oracles import one_line, strip  # noqa: E402


def sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def key_(x: str) -> str:
    return f"substring(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_]', '_', 'g'), 1, 50)"


def esc(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


def rid(stage: str, *keys: str, scope: str = "") -> str:
    parts = ", ".join(f"coalesce('=' || cast({k} as varchar), '~')" for k in keys)
    return f"sha256(concat_ws(chr(31), {sq(stage)}, {sq(scope)}, {parts}))"


def flat(stage: str, keys: list[str], n_messages: str, text: str, src: str, modality: str = "'text'",
         image: str = "cast(null as varchar)", before: str = "''", scope: str = "") -> str:
    return (f"select {rid(stage, *keys, scope=scope)} request_id, {', '.join(keys)}, cast({n_messages} as bigint) n_messages, "
            f"'user' last_role, {text} last_text, {image} image_url, md5({before}) before_md5, {modality} modality from {src}")


def said(template: str, n: int | None = None, **columns: str) -> str:
    """SQL of a request text: its wording with columns put in."""
    parts = re.split(r"\{([a-z]+)\}", template)
    return " || ".join(sq(x) if i % 2 == 0 else sq(str(n)) if x == "n" else columns[x] for i, x in enumerate(parts))


def image_sql(scope: str, text: str, *keys: str, folder: str = "") -> str:
    named = ", ".join(f"coalesce('=' || cast({k} as varchar), '~')" for k in (*keys, text))
    return f"{sq(folder + scope + '_')} || sha256(concat_ws(chr(31), {sq(scope)}, {named})) || '.png'"


_INDEXED = f"select row_number() over (order by prompt_id) - 1 row_index, prompt_id, {strip('raw')} prompt from f_raw_prompts"

# ------------------------------------------------------- prompts and rows
oracle("prompt_lines", f"""select row_number() over (order by prompt_id, pos) - 1 line_no, {strip('line')} prompt
  from (select prompt_id, unnest(l) line, generate_subscripts(l, 1) pos
        from (select prompt_id, string_split(raw, chr(10)) l from f_raw_prompts))""", "f_raw_prompts")
oracle("normalised_prompts", f"""select row_number() over (order by prompt_id) - 1 line_no, {one_line('raw')} prompt
  from f_raw_prompts""", "f_raw_prompts")
oracle("indexed_rows", "select row_index, prompt_id, prompt from ix", "f_raw_prompts", extra={"ix": _INDEXED})
oracle("batch_numbers", """select prompt_id, row_index, row_index // 4 batch_4, row_index // 40 batch_40,
    row_index // 1000 batch_1000 from ix""", "f_raw_prompts", extra={"ix": _INDEXED})
oracle("shard_numbers", """select prompt_id, row_number() over (order by prompt_id) - 1 row_index,
    cast(ntile(8) over (order by prompt_id) - 1 as int) shard from f_raw_prompts""", "f_raw_prompts")
oracle("row_slice", "select row_index, prompt_id, prompt from ix where row_index >= 100 and row_index < 600",
       "f_raw_prompts", extra={"ix": _INDEXED})
oracle("first_200", "select row_index, prompt_id, prompt from ix where row_index < 200",
       "f_raw_prompts", extra={"ix": _INDEXED})
oracle("prompts_to_score", f"""select doc_id prompt_id, {strip('cast(n_chars as varchar)')} scored_text,
    {strip('text')} default_text from documents""")

_P = strip("raw")
oracle("req_noun_chunks", flat("noun_chunks", ["prompt_id"], "1",
                               f"{sq(_rq.NOUN_PHRASE_INSTRUCTION + chr(10) + chr(10))} || {_P}", "f_raw_prompts"),
       "f_raw_prompts")
oracle("req_visual_questions", flat("visual_questions", ["prompt_id"], str(len(_rq.DEFAULT_FEW_SHOT) + 1),
                                    f"{sq(_rq.DESCRIPTION_PREFIX)} || {_P}", "f_raw_prompts",
                                    before=" || chr(30) || ".join(sq(t) for _, t in _rq.DEFAULT_FEW_SHOT)), "f_raw_prompts")
oracle("req_instant", flat("instant", ["prompt_id"], "1", said(_rq.INSTANT, 4, prompt=_P), "f_raw_prompts"), "f_raw_prompts")
oracle("req_iter_first", flat("iter_0", ["prompt_id"], "1", said(_rq.OPTIMIZER_ROLE + _rq.FIRST_ITERATION, 4, prompt=_P),
                              "f_raw_prompts"), "f_raw_prompts")
oracle("req_generation", f"""select {rid('generation', 'prompt_id', 'row_index')} request_id, prompt_id,
    row_index // 4 batch_no,
    {sq(_tr.FORMATS['hf'][0] + _tr.DEFAULT_INSTRUCTION)} || prompt || {sq(_tr.FORMATS['hf'][1] + GENERATION_MARKER)}
    request_text from ix""", "f_raw_prompts", extra={"ix": _INDEXED})

# ------------------------------------------------------------ noun chunks
_CHUNKS = "string_split(coalesce(noun_chunks, 'nan'), ',')"
_CROWS = f"""select doc_id, prompt, unnest(l) raw_chunk, generate_subscripts(l, 1) - 1 chunk_pos
    from (select doc_id, prompt, {_CHUNKS} l from f_noun_chunks)"""
oracle("noun_chunk_arrays", f"""select doc_id, len({_CHUNKS}) n_chunks,
    array_to_string(list_transform({_CHUNKS}, lambda x: {strip('x')}), ' | ') chunks from f_noun_chunks""",
       "f_noun_chunks")
oracle("noun_chunk_rows", f"select doc_id, chunk_pos, {strip('raw_chunk')} chunk from cr", "f_noun_chunks",
       extra={"cr": _CROWS})
oracle("eval_rows_chunks_only", f"""select doc_id, {strip('prompt')} original_prompt, len({_CHUNKS}) n_chunks,
    'NOUN_CHUNK' kind from f_noun_chunks where prompt is not null""", "f_noun_chunks")
# -------------------------------------------------------------------- QCA
_QPARTS = f"""select doc_id, unnest(ps) part, generate_subscripts(ps, 1) k
    from (select doc_id, string_split(visual_questions, 'Q: ')[2:] ps from f_qca_replies)"""
_QFIELDS = f"""select doc_id, k,
    {strip("string_split(part, 'Choices: ')[1]")} q,
    {strip("string_split(string_split(part, 'Choices: ')[2], 'A: ')[1]")} c,
    {strip("string_split(string_split(part, 'A: ')[2], chr(10))[1]")} a from qparts"""
_QBAD = """select doc_id, min(k) filter (where c is null or a is null) first_bad from qf group by doc_id"""
_QGOOD = """select qf.* from qf left join qbad using (doc_id) where qbad.first_bad is null or qf.k < qbad.first_bad"""
_QAGG = """select r.doc_id, r.prompt, r.visual_questions text, count(g.k) n_questions,
    coalesce(string_agg(g.q, ' | ' order by g.k), '') questions,
    coalesce(string_agg(g.c, ' | ' order by g.k), '') choices,
    coalesce(string_agg(g.a, ' | ' order by g.k), '') answers,
    (r.visual_questions is null or max(b.first_bad) is not null) anomaly
  from f_qca_replies r left join qgood g on r.doc_id = g.doc_id left join qbad b on r.doc_id = b.doc_id
  group by r.doc_id, r.prompt, r.visual_questions"""
_QX = {"qparts": _QPARTS, "qf": _QFIELDS, "qbad": _QBAD, "qgood": _QGOOD, "qagg": _QAGG}
oracle("qca_parse", "select doc_id, n_questions, questions, choices, answers, anomaly from qagg",
       "f_qca_replies", extra=_QX)
oracle("qca_rows", "select doc_id, k - 1 q_pos, q question, c choices, a answer from qgood",
       "f_qca_replies", extra=_QX)
oracle("qca_errors", """select 'documents' dataset, row_index, prompt, text
  from (select *, row_number() over (order by doc_id) - 1 row_index from qagg) where anomaly""",
       "f_qca_replies", extra=_QX)
oracle("qca_json_roundtrip", "select prompt, n_questions, questions, choices, answers from qagg",
       "f_qca_replies", extra=_QX)
oracle("eval_rows_qca_only", f"""select doc_id, {strip('prompt')} original_prompt, n_questions, 'QCA' kind
  from qagg where prompt is not null""", "f_qca_replies", extra=_QX)
def first_row(table: str, order: str) -> str:
    return f"""select * from (select *, row_number() over (partition by prompt order by {order}) first_r from {table}
        where prompt is not null) where first_r = 1"""


_EVAL = f"""select a.doc_id doc_id_x, b.doc_id doc_id_y, {strip('a.prompt')} original_prompt, a.n_questions,
    len({_CHUNKS.replace('noun_chunks', 'b.noun_chunks')}) n_chunks, a.prompt
  from qfirst a join nfirst b on a.prompt = b.prompt"""
_EX = {**_QX, "qfirst": first_row("qagg", "doc_id"), "nfirst": first_row("f_noun_chunks", "doc_id"), "ev": _EVAL}
oracle("eval_rows", "select doc_id_x, doc_id_y, original_prompt, n_questions, n_chunks from ev",
       "f_qca_replies", "f_noun_chunks", extra=_EX)
oracle("eval_rows_scored", """select doc_id_x, doc_id_y, original_prompt, n_questions, n_chunks, s.scored_id, s.quality
  from ev join sfirst s on ev.prompt = s.prompt""", "f_qca_replies", "f_noun_chunks", extra={
           **_EX, "scoring": "select d.text prompt, l.doc_id scored_id, l.quality from documents d join labels l on d.doc_id = l.doc_id",
           "sfirst": first_row("scoring", "scored_id")})

# ------------------------------------------------------------ scoring run
_CAND = ["prompt_id", "iter", "cand_pos"]
_RUN = {**_QX, "cr": _CROWS,
        "cand": """select doc_id prompt_id, iter, cand_pos, text || ' v' || iter || '.' || cand_pos revised_prompt
          from documents, (values (0, 0), (0, 1), (1, 0)) g(iter, cand_pos)""",
        "tq": "select c.*, k - 1 q_pos, q, qgood.c choices, a, prompt_id + (k - 1) * 3 + iter + cand_pos kk from cand c "
              "join qgood on qgood.doc_id = c.prompt_id",
        "vq": f"select c.*, chunk_pos, {strip('raw_chunk')} chunk, prompt_id + chunk_pos * 3 + iter + cand_pos kk from cand c "
              "join cr on cr.doc_id = c.prompt_id",
        # what the replies amount to: nothing valid, filtered, or an answer
        "ta": """select *, case when kk % 37 = 1 or kk % 29 = 0 then null when kk % 31 = 3 then ''
          when kk % 4 <> 0 then 'Yes ' else 'two' end picked from tq""",
        "va": """select *, case when kk % 37 = 1 or kk % 29 = 0 or kk % 31 = 3 then null
          when kk % 4 <> 0 then 1 else 0 end seen from vq""",
        "ts": f"""select prompt_id, iter, cand_pos, count(*) nq, count(*) filter (where picked is null) oq,
            count(*) filter (where lower({strip('picked')}) = lower({strip('a')})) nc,
            string_agg(coalesce(picked, '?'), '|' order by q_pos) answers from ta group by all""",
        "vs": """select prompt_id, iter, cand_pos, count(*) nv, count(*) filter (where seen is null) ov, sum(seen) yes,
            string_agg(coalesce(cast(seen as varchar), '?'), '' order by chunk_pos) seen_all from va group by all""",
        "sc": """select c.*, coalesce(nq, 0) n_questions, coalesce(oq, 0) n_open_questions, coalesce(nc, 0) n_correct,
            coalesce(nv, 0) n_chunks, coalesce(ov, 0) n_open, coalesce(answers, '') answers, coalesce(seen_all, '') vqa_scores,
            case when coalesce(oq, 0) = 0 then coalesce(nc / nq, 0.0) end tifa,
            case when coalesce(ov, 0) = 0 then coalesce(yes / nv, 0.0) end vqa
          from cand c left join ts using (prompt_id, iter, cand_pos) left join vs using (prompt_id, iter, cand_pos)"""}
_RF = ("f_qca_replies", "f_noun_chunks")
_IMG = image_sql("docs/1", "revised_prompt", *_CAND)
oracle("req_tifa", flat("tifa", [*_CAND, "q_pos"], "1", said(_rq.TIFA_QUESTION, question="q", choices="choices"), "tq",
                        "'multimodal'", _IMG, scope="docs/1"), *_RF, extra=_RUN)
oracle("req_vqa", flat("vqa", [*_CAND, "chunk_pos"], "1", said(_rq.VQA_QUESTION, chunk="chunk"), "vq",
                       "'multimodal'", _IMG, scope="docs/1"), *_RF, extra=_RUN)
oracle("score_run", """select prompt_id, iter, cand_pos, n_questions, n_open_questions, cast(n_correct as bigint) n_correct, n_chunks,
    n_open, round(tifa, 6) tifa, round(vqa, 6) vqa, round(tifa + vqa, 6) sum, answers, vqa_scores from sc""", *_RF, extra=_RUN)
oracle("chunk_scores", "select prompt_id, iter, cand_pos, chunk_pos, chunk, cast(seen as double) prob from va", *_RF, extra=_RUN)
_IDS = " union all ".join(
    f"select {sq(x)} scope, {rid('noun_chunks', 'prompt_id', 'prompt_key', scope=x)} request_id, prompt_id, prompt_key from ids"
    for x in ("a/1", "a/2", "b/1"))
oracle("request_ids", _IDS, "f_raw_prompts", extra={"ids": """select distinct case when prompt_id % 10 <> 0 then prompt_id end prompt_id,
    raw, sha256(raw) prompt_key from f_raw_prompts"""})

# ---------------------------------------------------------------- replies
oracle("paraphrase_candidates", f"""select request_id, generate_subscripts(l, 1) - 1 cand_pos, unnest(l) revised_prompt
  from (select request_id, list_filter(list_transform(string_split({strip('reply')}, chr(10)), lambda x: {strip('x')}),
                                       lambda x: length(x) > 0) l from f_replies)""", "f_replies")
oracle("best_from_reply", f"select request_id, {strip('reply')} best_paraphrase from f_replies", "f_replies")
oracle("best_tag_extract", f"""select request_id, case when conv_id % 3 <> 0 then {strip("split_part(reply, '</BEST>', 1)")} end best
  from f_replies""", "f_replies")
oracle("effective_replies", """select request_id, status, case when status = 'filtered' then '' else reply end reply_used
  from f_replies""", "f_replies")
oracle("attach_replies", """select q.request_id, q.request_text, r.reply from f_requests q
  join f_replies r on q.request_id = r.request_id""", "f_requests", "f_replies")
oracle("open_requests", """select request_id from f_requests q where not exists (
  select 1 from f_replies r where r.request_id = q.request_id and r.status = 'ok' and r.reply is not null)""",
       "f_requests", "f_replies")
oracle("req_select_all", flat("select_all", ["reply_id"], "1", said(_rq.SELECT_ALL, 4, reply="reply"),
                              "(select request_id reply_id, reply from f_replies)"), "f_replies")
oracle("req_select_best", flat("select_best", ["reply_id"], "1", said(_rq.SELECT_BEST, 4, reply="reply"),
                               "(select request_id reply_id, reply from f_replies)"), "f_replies")
oracle("request_modality", """select request_id, case when conv_id % 2 = 0 then 'multimodal' else 'text' end modality,
    cast(case when conv_id % 2 = 0 then 2 else 1 end as bigint) n_parts, reply as text from f_replies""", "f_replies")

# ----------------------------------------------------- history / annotation
_SEL = {"scored": _SCORED, "ib": _ITER_BEST}
oracle("parse_list_column", "select prompt_id, count(*) n_items, round(max(best_sum), 6) max_sum from ib group by prompt_id",
       "f_candidates", extra=_SEL)
oracle("history_rows", """select prompt_id, row_number() over (partition by prompt_id order by iter, cand_pos) - 1 hist_pos,
    iter, cand_pos, revised_prompt from scored""", "f_candidates", extra={"scored": _SCORED})
_QL = f"""select prompt_id, iter, cand_pos, string_agg('- ' || q || ' | choices: '
    || array_to_string(list_transform(string_split(choices, ','), lambda x: {strip('x')}), '; ') || ' | correct: ' || a || ' | picked: '
    || picked || ' | ' || case when picked <> a then 'wrong' else 'right' end || chr(10), '' order by q_pos) qblock from ta group by all"""
_EL = """select prompt_id, iter, cand_pos, string_agg('- ' || chunk || ': ' || seen * 100 || chr(10), '' order by chunk_pos) eblock
  from va group by all"""
_ENT = """select s.*, (tifa + vqa) / 2 score, revised_prompt || chr(10) || 'Overall: ' || cast(trunc((tifa + vqa) / 2 * 100) as int)
    || ' | TIFA: ' || cast(trunc(tifa * 100) as int) || ' | VQA: ' || cast(trunc(vqa * 100) as int)
    || chr(10) || 'Questions:' || chr(10) || coalesce(qblock, '') || 'Elements:' || chr(10) || coalesce(eblock, '') entry
  from sc s left join ql using (prompt_id, iter, cand_pos) left join el using (prompt_id, iter, cand_pos)
  where tifa is not null and vqa is not null"""
_HIST = """select prompt_id, count(*) n_entries, string_agg(chr(10) || chr(10) || rn || '. ' || entry, '' order by rn) history
  from (select *, row_number() over (partition by prompt_id order by score, iter, cand_pos) rn from ent)
  group by prompt_id"""
_HX = {**_RUN, "ql": _QL, "el": _EL, "ent": _ENT, "hist": _HIST}
oracle("history_text", "select * from hist", *_RF, extra=_HX)
oracle("req_iter_next", flat("iter_3", ["prompt_id"], "1", said(_rq.OPTIMIZER_ROLE + _rq.NEXT_ITERATION, 4, prompt="original_prompt",
                                                               history="history"),
                             "(select h.*, d.text original_prompt from hist h join documents d on d.doc_id = h.prompt_id)"),
       *_RF, extra=_HX)
_CUR = """select ib.prompt_id, ib.iter, coalesce(lag(best_paraphrase) over w, p.original_prompt) current_prompt,
    case when lag(ib.iter) over w is null then o.tifa else lag(winner_tifa) over w end cur_t,
    case when lag(ib.iter) over w is null then o.vqa else lag(winner_vqa) over w end cur_v
  from ib join f_cand_prompts p using (prompt_id) join f_scored_originals o using (prompt_id)
  window w as (partition by ib.prompt_id order by ib.iter)"""
_ANN = f"""select *, {image_sql('ds', 'prompt_used_for_generation', folder='./annotations/')} image_path from (
    select s.prompt_id, s.iter, s.cand_pos, s.tifa, s.vqa, s.sum, s.revised_prompt prompt_used_for_generation,
           c.current_prompt original_prompt from scored s join cur c using (prompt_id, iter)
    union all
    select prompt_id, iter, -1, cur_t, cur_v, cur_t + cur_v, current_prompt, current_prompt from cur)"""
_AX = {"scored": _SCORED, "ib": _ITER_BEST, "cur": _CUR, "ann": _ANN}
_AF = ("f_candidates", "f_cand_prompts", "f_scored_originals")
oracle("annotation_rows", """select prompt_id, iter, cand_pos, round(tifa, 6) tifa, round(vqa, 6) vqa,
    round(sum, 6) sum, prompt_used_for_generation, original_prompt, image_path from ann""", *_AF, extra=_AX)
oracle("annotation_html", f"""select 0 part, null prompt_id, null iter, null cand_pos, {sq(_hist.HTML_HEADER)} html
  union all select 1, prompt_id, iter, cand_pos, '<li><figure><img alt="" src="' || {esc('image_path')} || '"><figcaption>'
    || {esc('original_prompt')} || '</figcaption></figure></li>' from ann
  union all select 2, null, null, null, {sq(_hist.HTML_FOOTER)}""", *_AF, extra=_AX)
oracle("annotation_append", "select prompt_id, iter, cand_pos, revised_prompt from scored", "f_candidates", extra={"scored": _SCORED})

# ------------------------------------------------------------------ scores
_CORRECT = f"cast(lower({strip('picked')}) = lower({strip('answer')}) as int)"
oracle("tifa_answers", f"""select prompt_id, q_pos, picked, answer, {_CORRECT} correct from f_tifa_answers
  where q_pos is not null""", "f_tifa_answers")
oracle("tifa_scores", f"""select prompt_id, count(answer) n_questions,
    cast(coalesce(sum({_CORRECT}) filter (where answer is not null), 0) as bigint) n_correct,
    round(coalesce(cast(sum({_CORRECT}) filter (where answer is not null) as double) / nullif(count(answer), 0), 0.0), 6) tifa,
    coalesce(string_agg(picked, ' | ' order by q_pos) filter (where answer is not null), '') answers
  from f_tifa_answers group by prompt_id""", "f_tifa_answers")
_YN = f"lower({strip('reply')})"
oracle("vqa_hard_scores", f"""select cand_id, n_chunks, n_yes, n_open,
    case when n_open = 0 then round(coalesce(cast(n_yes as double) / nullif(n_chunks, 0), 0.0), 6) end vqa
  from (select cand_id, count(*) n_chunks, count(*) filter (where {_YN} = 'yes') n_yes,
               count(*) filter (where {_YN} is null or {_YN} not in ('yes', 'no')) n_open
        from f_vqa_replies group by cand_id)""", "f_vqa_replies")
_YP = f"""select cand_id, obs_day, coalesce(exp(arg_min(logprob, chunk_pos)
    filter (where starts_with(lower({strip('token')}), 'yes'))), 0.0) yes_prob from f_vqa_replies group by cand_id, obs_day"""
oracle("yes_probability", "select cand_id, cast(obs_day as varchar) obs_day, round(yes_prob, 6) yes_prob from yp",
       "f_vqa_replies", extra={"yp": _YP})
oracle("vqa_soft_scores", "select cand_id, count(*) n_chunks, round(avg(yes_prob), 6) vqa from yp group by cand_id",
       "f_vqa_replies", extra={"yp": _YP})

# ------------------------------------------------------------------ shards
_PAT = "'process(\\d+)_nextline_(\\d+)'"
_SH = f"""select *, cast(regexp_extract(file_name, {_PAT}, 1) as int) process,
    cast(regexp_extract(file_name, {_PAT}, 2) as int) nextline from f_shards"""
oracle("parse_shard_name", f"""select distinct file_name, process, nextline, split_part(file_name, '.', 1) stem
  from sh""", "f_shards", extra={"sh": _SH})
oracle("latest_shard", """select process, max(nextline) nextline, arg_max(file_name, nextline) file_name
  from (select distinct process, nextline, file_name from sh) group by process""", "f_shards", extra={"sh": _SH})
oracle("merge_shards", """select file_name, process, nextline, 1 source_rank, row_index, original_prompt, round(score, 6) score
  from sh""", "f_shards", extra={"sh": _SH})
_FLAT = """select *, case when source_rank = 0 then 'ds_combined.csv' else file_name end file from sh"""
_MRG = """select * from (select *, row_number() over (partition by original_prompt order by source_rank,
    case when source_rank = 1 then process end, case when source_rank = 1 then nextline end, row_index desc) r from flat) where r = 1"""
_MX = {"sh": _SH, "flat": _FLAT, "mrg": _MRG}
oracle("merge_run", f"""select original_prompt, row_index, file file_name, printf('%.4f', score) as value from mrg
  union all select 'average value', null, null, printf('%.4f', {pct2('avg(score)')}) from mrg""", "f_shards", extra=_MX)
oracle("merge_run_iterative", f"""select original_prompt, row_index, file file_name, '[' || score || ', 1.5]' as value from mrg
  union all select 'average value', null, null, printf('%.4f', {pct2('avg(greatest(score, 1.5))')}) from mrg""", "f_shards", extra=_MX)
oracle("averages_sink", f"""select 'tifa_score' metric, {pct2('avg(tifa)')} value from scored
  union all select 'vqa_score', {pct2('avg(vqa)')} from scored
  union all select 'sum_score', {pct2('avg(sum)')} from scored""", "f_candidates", extra={"scored": _SCORED})
oracle("timer_sink", """select row_number() over (order by min(seq)) - 1 place, purpose, round(coalesce(avg(elapsed), -1.0), 6) average_time
  from f_purposes group by purpose""", "f_purposes")
oracle("incremental_batches", """select row_index // 40 batch_no, count(*) n, min(prompt_id) first_id from ix group by row_index // 40""",
       "f_raw_prompts", extra={"ix": _INDEXED})
oracle("dedup_keep_first", """select original_prompt, file_name, row_index, round(score, 6) score from (
    select *, row_number() over (partition by original_prompt order by source_rank, process, nextline, row_index) r
    from sh where original_prompt is not null) where r = 1""", "f_shards", extra={"sh": _SH})
oracle("csv_roundtrip", "select doc_id, text, case when lang = 'es' then null else lang end lang from documents")

oracle("csv_split_roundtrip", """select doc_id, text || ' "q" ' || chr(10) || ' ' || lang text, lang from documents""")

# ------------------------------------------------------------------ timers
oracle("timer_averages", """select purpose, min(seq) first_seq, round(coalesce(avg(elapsed), -1.0), 6) average_time
  from f_purposes group by purpose""", "f_purposes")
oracle("perplexity_by_step", "select step, round(exp(avg(eval_loss)), 6) perplexity from f_eval_log group by step",
       "f_eval_log")

# ---------------------------------------------------------------- training
_PAIRS = """select conv_id, turn, original_prompt,
    case when corrected_prompt = 'Correct.' then rephrased_prompt else corrected_prompt end rephrased_prompt from f_pairs"""
_PX = {"pairs": _PAIRS}
oracle("corrected_pairs", "select * from pairs", "f_pairs", extra=_PX)
for _f in ("hf", "gemma", "chatml"):
    _o, _c = _tr.FORMATS[_f]
    oracle(f"train_text_{_f}", f"""select conv_id, turn, {sq(_o + _tr.DEFAULT_INSTRUCTION)} || original_prompt
        || {sq(_c + _tr.ASSISTANT_LEAD)} || rephrased_prompt text from pairs""", "f_pairs", extra=_PX)
oracle("train_messages_qwen", f"""select conv_id, turn, 'user' user_from,
    {sq(_tr.DEFAULT_INSTRUCTION)} || original_prompt user_value, 'assistant' assistant_from,
    {sq(_tr.ASSISTANT_LEAD)} || rephrased_prompt assistant_value from pairs""", "f_pairs", extra=_PX)
oracle("train_pairs_test", """select conv_id, turn, original_prompt, rephrased_prompt rephrased_and_corrected_prompt
  from pairs""", "f_pairs", extra=_PX)
_ICL = """select conv_id, turn, original_prompt prompt, rephrased_prompt best_paraphrase,
    md5('42' || conv_id || '-' || turn) sample_key from pairs order by sample_key, conv_id || '-' || turn limit 100"""
oracle("icl_examples", "select conv_id, turn, prompt, best_paraphrase from icl", "f_pairs",
       extra={**_PX, "icl": _ICL})
_SHOTS = (f"(select {sq(_rq.ICL_SYSTEM)} || string_agg(chr(30) || {sq(_rq.ICL_PROMPT_LABEL)} || prompt || chr(30) || "
          f"{sq(_rq.ICL_ANSWER_LABEL)} || best_paraphrase, '' order by sample_key, prompt, best_paraphrase) from icl)")
oracle("req_icl", f"""select {rid('icl', 'conv_id', 'turn')} request_id, conv_id, turn,
    (select 2 + 2 * count(*) from icl) n_messages, 'user' last_role, {sq(_rq.ICL_PROMPT_LABEL)} || original_prompt last_text,
    cast(null as varchar) image_url, md5({_SHOTS}) before_md5,
    'text' modality, (select {sq(_rq.ICL_PROMPT_LABEL)} || arg_min(prompt, sample_key) from icl) first_example from f_pairs""",
       "f_pairs", extra={**_PX, "icl": _ICL})

# ------------------------------------------------------- existing / resume
_EXSET = "select prompt from f_existing union all select text from benchmark"
oracle("existing_prompts", f"select {one_line('line')} prompt from (select unnest(string_split(prompt, chr(10))) line from ex)",
       "f_existing", extra={"ex": _EXSET})
_FRESH = f"""select doc_id, text from documents d where not exists (
    select 1 from ex where {one_line('ex.prompt')} = {one_line('d.text')})"""
oracle("new_prompts_anti", "select doc_id, text prompt from fresh", "f_existing",
       extra={"ex": _EXSET, "fresh": _FRESH})
oracle("sample_new_prompts", f"""select doc_id, prompt, sample_key from (
    select doc_id, {one_line('text')} prompt, md5('42' || doc_id) sample_key,
           row_number() over (partition by {one_line('text')} order by md5('42' || doc_id), doc_id) r from fresh)
  where r = 1 order by sample_key, doc_id limit 300""", "f_existing", extra={"ex": _EXSET, "fresh": _FRESH})
oracle("resume_pending", f"""select prompt_id from f_raw_prompts r where not exists (
    select 1 from f_existing e where e.prompt = {strip('r.raw')})""", "f_raw_prompts", "f_existing")
oracle("resume_by_offset", "select row_index, prompt_id from ix where row_index >= (select count(*) from f_existing)",
       "f_raw_prompts", "f_existing", extra={"ix": _INDEXED})
oracle("generated_prompts", f"""select conv_id, turn, g generated_prompt, g is null rejected from (
    select conv_id, turn, {strip("string_split(output, " + sq(GENERATION_MARKER) + ")[2]")} g from f_generated)""",
       "f_generated")

# ------------------------------------------------------------------ images
_MIME = """case lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) when 'png' then 'image/png'
    when 'jpg' then 'image/jpeg' when 'html' then 'text/html' else 'application/octet-stream' end"""
oracle("data_url", f"""select path image_name, {_MIME} mime, cast(octet_length(encode(html || chr(10))) as bigint) length,
    'data:' || {_MIME} || ';base64,' || base64(encode(html || chr(10))) data_url from f_images""", "f_images")
oracle("image_keys", f"select item_id, {key_('text')} image_key from benchmark")
oracle("image_paths", f"""select item_id, 'out/annotations/benchmark_' || {key_('text')} || '.png' annotation_path,
    'out/benchmark_process3_' || {key_('text')} || '.png' process_path,
    './annotations/benchmark_' || {key_('text')} || '.png' relative_path from benchmark""")

oracle("image_files", """select bucket, length, cast(floor((sum(length) over (order by bucket) - length) / 1048576) as bigint) pack,
    data_url from (select page_id // 16 as bucket, cast(sum(octet_length(encode(html || chr(10)))) as bigint) as length,
    'data:text/plain;base64,' || base64(encode(string_agg(html || chr(10), '' order by page_id))) data_url from pages group by all)""")

# ------------------------------------------------------------- streaming
oracle("incremental_replies", f"""select r.request_id, generate_subscripts(l, 1) - 1 cand_pos, unnest(l) revised_prompt
  from (select request_id, list_filter(list_transform(string_split({strip('reply')}, chr(10)), lambda x: {strip('x')}),
                                       lambda x: length(x) > 0) l from f_replies) r
  where r.request_id in (select request_id from f_requests)""", "f_replies", "f_requests")

_ST = f"""select prompt_id cand, count(answer) n_questions,
      cast(coalesce(sum({_CORRECT}) filter (where answer is not null), 0) as bigint) n_correct,
      coalesce(cast(sum({_CORRECT}) filter (where answer is not null) as double) / nullif(count(answer), 0), 0.0) tifa,
      coalesce(string_agg(picked, ' | ' order by q_pos) filter (where answer is not null), '') answers
    from f_tifa_answers group by prompt_id"""
_SV = f"""select cand_id cand, count(*) n_chunks,
      count(*) filter (where {_YN} is null or {_YN} not in ('yes', 'no')) n_open,
      count(*) filter (where {_YN} = 'yes') n_yes from f_vqa_replies group by cand_id"""
_VQ = "case when coalesce(v.n_open, 0) = 0 then coalesce(cast(v.n_yes as double) / nullif(v.n_chunks, 0), 0.0) end"
oracle("candidate_score_table", f"""select coalesce(t.cand, v.cand) cand, coalesce(t.n_questions, 0) n_questions,
    coalesce(t.n_correct, 0) n_correct, round(coalesce(t.tifa, 0.0), 6) tifa, coalesce(v.n_chunks, 0) n_chunks,
    coalesce(v.n_open, 0) n_open, round({_VQ}, 6) vqa, round(coalesce(t.tifa, 0.0) + {_VQ}, 6) sum,
    coalesce(t.answers, '') answers
  from st t full outer join sv v on t.cand = v.cand""", "f_tifa_answers", "f_vqa_replies",
       extra={"st": _ST, "sv": _SV})

from promptforge.plans import run_oracles  # noqa: E402, F401
