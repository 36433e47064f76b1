"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Each string runs on DuckDB with the driver's tables registered as views and
must give the same rows and column names as ``plans/catalog.py``. Shared
pieces (the exam views, the scorers, the templates) are built here as SQL
text so that every query restates the whole derivation from the raw tables.
"""

from __future__ import annotations

from ..functions.constants import (
    ANSWER_OPEN,
    ANSWER_TAG,
    BACKENDS,
    CORRECT,
    CORRECT_ANSWER,
    INCORRECT,
    NOT_CORRECT_ANSWER,
    PY_WHITESPACE,
    QUESTION_TAG,
    STEP_BY_STEP,
    TOPIC_LINE,
)
from ..functions.templates import DEFAULT_CHAT_TEMPLATE
from . import catalog as C

NL = "chr(10)"


def lit(s: str) -> str:
    """A SQL string expression for any Python string (control chars via chr)."""
    parts, buf = [], ""
    for ch in s:
        if ch == "'" or ord(ch) < 32 or ord(ch) in (0x85,) or ch in PY_WHITESPACE and ch != " ":
            if buf:
                parts.append("'" + buf + "'")
                buf = ""
            parts.append(f"chr({ord(ch)})")
        else:
            buf += ch
    if buf or not parts:
        parts.append("'" + buf + "'")
    return "(" + " || ".join(parts) + ")"


WS = "(" + " || ".join(f"chr({ord(c)})" for c in PY_WHITESPACE) + ")"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def let(expr: str, name: str, body: str) -> str:
    """Bind ``expr`` to ``name`` inside ``body`` (a one-element list lambda)."""
    return f"list_transform([{expr}], lambda {name}: {body})[1]"


def is_fmt(x: str) -> str:
    return (
        f"(CASE WHEN contains({x}, {lit(NOT_CORRECT_ANSWER)}) THEN false "
        f"WHEN contains({x}, {lit(CORRECT_ANSWER)}) THEN true "
        f"WHEN contains({x}, {lit(INCORRECT)}) THEN false "
        f"WHEN contains({x}, {lit(CORRECT)}) THEN true "
        f"ELSE regexp_matches({x}, '[A-E]') END)"
    )


def find_choice(x: str) -> str:
    return (
        f"coalesce(nullif(regexp_extract({x}, '([A-F])\\)', 1), ''), "
        f"nullif(regexp_extract({x}, '[A-F]', 0), ''))"
    )


def find_choice_pos(x: str) -> str:
    return (
        f"(CASE WHEN regexp_matches({x}, '[A-F]\\)') "
        f"THEN length(regexp_extract({x}, '(?s)^(.*?)[A-F]\\)', 1)) "
        f"WHEN regexp_matches({x}, '[A-F]') THEN length(regexp_extract({x}, '(?s)^(.*?)[A-F]', 1)) "
        f"ELSE -1 END)"
    )


def predict_direct(r: str) -> str:
    blocks = f"string_split({strip(r)}, {NL} || {NL})"
    chosen = f"CASE WHEN {is_fmt('b_[1]')} THEN b_[1] ELSE b_[-1] END"
    return let(blocks, "b_", let(chosen, "t_", find_choice("t_")))


def predict_cot(r: str) -> str:
    lines = f"string_split({strip(f'split_part({strip(r)}, {lit(QUESTION_TAG)}, 1)')}, {NL})"
    from_end = (
        f"coalesce(list_position(list_reverse(list_transform(ls_, lambda x_: {is_fmt('x_')})), true), 0)"
    )
    tail = (
        "CASE WHEN fe_ = 0 THEN '' "
        "ELSE array_to_string(list_slice(ls_, len(ls_) - fe_ + 1, len(ls_)), '') END"
    )
    after = f"substring(tl_, greatest(instr(tl_, {lit(CORRECT_ANSWER)}), 1))"
    return let(lines, "ls_", let(from_end, "fe_", let(tail, "tl_", let(after, "af_", find_choice("af_")))))


def predict(mode: str, r: str) -> str:
    return predict_cot(r) if mode == "cot" else predict_direct(r)


def correct(pred: str, gold: str) -> str:
    return f"coalesce(CAST(({pred}) = ({gold}) AS INTEGER), 0)"


# --- templates -----------------------------------------------------------------

def present(prefix: str = "") -> str:
    arr = "[" + ", ".join(f'{prefix}"{x}"' for x in "ABCDEF") + "]"
    n = f"coalesce(list_position(list_transform({arr}, lambda v_: v_ IS NULL), true) - 1, 6)"
    return f"list_slice({arr}, 1, {n})"


def render_options(prefix: str = "") -> str:
    lines = f"list_transform({present(prefix)}, lambda v_, i_: '(' || chr(CAST(64 + i_ AS INTEGER)) || ') ' || v_)"
    return strip(f"array_to_string({lines}, {NL})")


def render_item(style: str, cot: bool, with_answer: bool, prefix: str = "") -> str:
    q = strip(f"replace({prefix}question, {NL} || {NL}, {NL})")
    parts = [lit(QUESTION_TAG), q, NL, render_options(prefix)]
    if with_answer:
        if cot:
            parts += [lit(f"\n{STEP_BY_STEP}\n"), strip(f"coalesce({prefix}explanation, '')")]
        parts += [lit(f"\n{ANSWER_OPEN}"), strip(f"{prefix}answer"), "')'"]
    elif style == "suffix":
        parts.append(lit(f"\n{STEP_BY_STEP}\n" if cot else f"\n{ANSWER_OPEN}"))
    return "(" + " || ".join(parts) + ")"


TOPIC = lit(TOPIC_LINE + "\n\n")


# --- exam views ---------------------------------------------------------------

ITEMS_CTE = f"""
docs_ AS (
  SELECT doc_id, lang, string_split(text, {NL}) AS l FROM documents
),
base_ AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn_
  FROM docs_
),
exam_items AS (
  SELECT lang AS subset,
         CASE WHEN rn_ <= 5 THEN 'dev' ELSE 'test' END AS split,
         doc_id AS seq,
         lang || '-' || CAST(doc_id AS VARCHAR) AS id,
         l[1] AS question,
         l[2] AS "A", l[3] AS "B", l[4] AS "C", l[5] AS "D", l[6] AS "E", l[7] AS "F",
         chr(CAST(65 + doc_id % greatest(least(len(l) - 1, 6), 1) AS INTEGER)) AS answer,
         CASE WHEN len(l) > 7 THEN array_to_string(l[8:], {NL}) END AS explanation
  FROM base_
)"""


def _response_expr() -> str:
    p = f"chr(CAST(65 + (seq // 3) % greatest(len({present()}), 1) AS INTEGER))"
    opened = f"({lit(ANSWER_OPEN)} || {p} || ')')"
    forms = [
        f"{p} || ')'",
        opened,
        f"question || {NL} || {NL} || {opened}",
        f"{lit(NOT_CORRECT_ANSWER + chr(10) + chr(10))} || {p} || ')'",
        f"{lit(chr(0x3000) + chr(10))} || {p} || {lit(') ' + chr(0x3000))}",
        f"{lit('A 與 B' + chr(10))} || {opened}",
        f"{opened} || {lit(chr(10) + QUESTION_TAG + 'A)')}",
        "''",
        f"{lit(ANSWER_TAG)} || answer || ' 或 ' || {p} || {lit(chr(10) + ') 不正確')}",
        f"{lit(chr(0x1F600))} || question || {NL} || {opened}",
    ]
    whens = " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(forms[:-1]))
    return f"(CASE seq % 10 {whens} ELSE {forms[-1]} END)"


RESPONSES_CTE = f"""{ITEMS_CTE},
exam_responses AS (
  SELECT subset, seq, id, {_response_expr()} AS full_response, answer AS gold_answer
  FROM exam_items WHERE split = 'test'
)"""

LOG_CTE = f"""{RESPONSES_CTE},
log_once_ AS (
  SELECT i.subset, i.seq, i.id,
         {TOPIC} || {render_item('suffix', False, False, 'i.')} AS prompt,
         r.full_response, r.gold_answer
  FROM exam_items i JOIN exam_responses r USING (subset, seq, id)
  WHERE i.split = 'test'
),
whole_log AS (
  SELECT * FROM log_once_
  UNION ALL
  SELECT * FROM log_once_ WHERE seq % 40 = 0
),
exam_log AS (SELECT * FROM whole_log WHERE seq % 4 = 0)"""

FAILURES_CTE = f"""{RESPONSES_CTE},
exam_failures AS (
  SELECT *, (seq % 97 = 0) AS failed FROM exam_responses
)"""

LOGITS_CTE = """
exam_logits AS (
  SELECT 'embeddings' AS subset,
         CAST(vec_id // 4 AS VARCHAR) AS id,
         chr(CAST(65 + vec_id % 4 AS INTEGER)) AS choice,
         0 AS pos,
         label AS token_id,
         CAST(embedding AS DOUBLE[]) AS logits
  FROM embeddings
),
lp_ AS (
  SELECT subset, id, choice,
         logits[token_id + 1] - list_max(logits)
           - ln(list_reduce(list_transform(logits, lambda x_: exp(x_ - list_max(logits))),
                            lambda a_, b_: a_ + b_)) AS lp
  FROM exam_logits
),
ll_ AS (
  SELECT subset, id, choice, sum(lp) AS loglik FROM lp_ GROUP BY subset, id, choice
)"""


# the turns of a conversation are the calls recorded for it; an item takes the conversation
# of its number, and its answer is the first call that has one
CALLS_CTE = """,
calls_ AS (
  SELECT conv_id, list(CASE WHEN role = 'assistant' THEN text END ORDER BY turn) AS calls FROM conversations GROUP BY conv_id
),
recorded_ AS (
  SELECT i.*, c.calls,
         list_position(list_transform(c.calls, lambda x_: x_ IS NOT NULL), true) AS first_,
         c.calls[list_position(list_transform(c.calls, lambda x_: x_ IS NOT NULL), true)] AS text
  FROM exam_items i LEFT JOIN calls_ c ON c.conv_id = i.seq % (SELECT max(conv_id) + 1 FROM conversations)
  WHERE split = 'test'
)"""


def _call(column: str, tries: int) -> str:
    return f"(CASE WHEN first_ <= {tries} THEN {column} END)"


def _best_option(contexts: str, context: str) -> str:
    """CTEs after ``contexts`` (subset, id, gold_answer, context): the label of the best
    option by the scores recorded for the item."""
    return f""",
opts_ AS (
  SELECT p.subset, p.id, p.gold_answer, chr(CAST(64 + o.pos_ AS INTEGER)) AS choice,
         e.embedding[(o.pos_ - 1 + length(p.{context})) % len(e.embedding) + 1] AS ll
  FROM {contexts} p JOIN (
    SELECT subset, id, seq, unnest(generate_series(1, len({present()}))) AS pos_
    FROM exam_items WHERE split = 'test') o USING (subset, id)
  JOIN embeddings e ON e.vec_id = o.seq % (SELECT max(vec_id) + 1 FROM embeddings)
),
best_ AS (
  SELECT p.subset, p.id, p.gold_answer, o.choice || ')' AS full_response FROM {contexts} p LEFT JOIN (
    SELECT *, row_number() OVER (PARTITION BY subset, id ORDER BY ll DESC, choice) AS r_ FROM opts_) o
  ON o.subset = p.subset AND o.id = p.id AND o.r_ = 1
)"""


def _with(cte: str, body: str) -> str:
    return f"WITH {cte.strip()}\n{body}"


# --- few-shot prompts ------------------------------------------------------------


def _header_ctes(k: int, style: str, cot: bool) -> str:
    shot = f"{render_item(style, cot, True)} || {NL} || {NL}"
    return f""",
dev_ AS (
  SELECT subset, seq, {shot} AS text,
         row_number() OVER (PARTITION BY subset ORDER BY seq) AS rank_
  FROM exam_items WHERE split = 'dev'
),
header_ AS (
  SELECT subset, string_agg(text, '' ORDER BY rank_) AS header
  FROM dev_ WHERE rank_ <= {k} GROUP BY subset
)"""


def _prompt_select(k: int, style: str, cot: bool) -> str:
    item = render_item(style, cot, False, "t.")
    if k == 0:
        return (
            f"SELECT t.subset, t.seq, t.id, {TOPIC} || {item} AS prompt, t.answer AS gold_answer "
            f"FROM exam_items t WHERE t.split = 'test'"
        )
    return (
        f"SELECT t.subset, t.seq, t.id, {TOPIC} || coalesce(h.header, '') || {item} AS prompt, "
        f"t.answer AS gold_answer FROM exam_items t LEFT JOIN header_ h USING (subset) "
        f"WHERE t.split = 'test'"
    )


def _prompt_sql(k: int, style: str, cot: bool) -> str:
    ctes = ITEMS_CTE + (_header_ctes(k, style, cot) if k > 0 else "")
    return _with(ctes, _prompt_select(k, style, cot))


def _budget_parts(k: int, max_length: int, template: str, style: str = "bare", cot: bool = False):
    """CTEs (after the items CTE) and the SELECT of budgeted few-shot prompts."""
    item = render_item(style, cot, False, "t.")
    shot = f"{render_item(style, cot, True)} || {NL} || {NL}"
    start = f"({max_length} - length({TOPIC}) - length({item}) - length({lit(template)}))"
    q = (
        f"SELECT t.subset, t.seq, t.id, t.answer, {item} AS item_prompt, "
        f"CAST({start} AS BIGINT) AS left_0, '' AS acc_0, "
        + ", ".join(f"h.text{i}, h.n{i}" for i in range(1, k + 1))
        + " FROM exam_items t LEFT JOIN bank_ h USING (subset) WHERE t.split = 'test'"
    )
    # the greedy fold, unrolled: keep shot i while the budget left after it
    # stays strictly positive, else skip it and try the next
    for i in range(1, k + 1):
        keep = f"(text{i} IS NOT NULL AND left_{i-1} - n{i} > 0)"
        q = (
            f"SELECT *, CASE WHEN {keep} THEN left_{i-1} - n{i} ELSE left_{i-1} END AS left_{i}, "
            f"CASE WHEN {keep} THEN acc_{i-1} || text{i} ELSE acc_{i-1} END AS acc_{i} FROM ({q})"
        )
    body = (
        f"SELECT subset, seq, id, {TOPIC} || acc_{k} || item_prompt AS prompt, "
        f"left_{k} AS budget_left, answer AS gold_answer FROM ({q})"
    )
    ctes = f""",
dev_ AS (
  SELECT subset, {shot} AS text,
         row_number() OVER (PARTITION BY subset ORDER BY seq) AS rank_
  FROM exam_items WHERE split = 'dev'
),
bank_ AS (
  SELECT subset,
         {", ".join(f"max(CASE WHEN rank_ = {i} THEN text END) AS text{i}" for i in range(1, k + 1))},
         {", ".join(f"max(CASE WHEN rank_ = {i} THEN length(text) END) AS n{i}" for i in range(1, k + 1))}
  FROM dev_ WHERE rank_ <= {k} GROUP BY subset
)"""
    return ctes, body


def _budget_fold_sql(k: int, max_length: int, template: str) -> str:
    ctes, body = _budget_parts(k, max_length, template)
    return _with(ITEMS_CTE + ctes, body)


def _report_sql(src: str, mode: str) -> str:
    return (
        f"SELECT subset, count(*) AS n, CAST(sum(c_) AS BIGINT) AS n_correct, avg(c_) AS avg_score "
        f"FROM (SELECT subset, {correct(predict(mode, 'full_response'), 'gold_answer')} AS c_ FROM {src}) "
        f"GROUP BY subset"
    )


def _lines_sql() -> str:
    return (
        f"SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS line_no, unnest(l) AS line "
        f"FROM (SELECT doc_id, string_split(text, {NL}) AS l FROM documents)"
    )


def _k0_bare(cot: bool) -> str:
    return f"{TOPIC} || {render_item('bare', cot, False)}"


def _build() -> dict[str, str]:
    q: dict[str, str] = {}
    q["report_direct"] = _with(RESPONSES_CTE, _report_sql("exam_responses", "direct"))
    q["report_cot"] = _with(RESPONSES_CTE, _report_sql("exam_responses", "cot"))
    for mode in ("direct", "cot"):
        pred = predict(mode, "full_response")
        q[f"predict_{mode}"] = _with(
            RESPONSES_CTE,
            f"SELECT subset, id, p_ AS prediction, {correct('p_', 'gold_answer')} AS correct "
            f"FROM (SELECT *, {pred} AS p_ FROM exam_responses)",
        )
    q["conversation_predictions"] = (
        f"SELECT conv_id, turn, {predict_direct('text')} AS pred_direct, "
        f"{predict_cot('text')} AS pred_cot FROM conversations WHERE role = 'assistant'"
    )
    q["answer_format"] = f"SELECT doc_id, line_no, {is_fmt('line')} AS is_answer FROM ({_lines_sql()})"
    q["find_choice"] = (
        f"SELECT doc_id, line_no, {find_choice('line')} AS choice, "
        f"CAST({find_choice_pos('line')} AS INTEGER) AS choice_pos FROM ({_lines_sql()})"
    )
    q["stop_truncate"] = _with(
        RESPONSES_CTE,
        f"SELECT subset, id, split_part(full_response, {lit(QUESTION_TAG)}, 1) AS truncated "
        f"FROM exam_responses",
    )
    q["options_takewhile"] = _with(
        ITEMS_CTE,
        f"SELECT subset, id, CAST(len({present()}) AS INTEGER) AS n_options, "
        f"array_to_string({present()}, chr(31)) AS options_text FROM exam_items",
    )
    q["options_render"] = _with(
        ITEMS_CTE, f"SELECT subset, id, {render_options()} AS options_block FROM exam_items"
    )
    q["prompt_bare_k0"] = _prompt_sql(0, "bare", False)
    q["prompt_bare_k5"] = _prompt_sql(5, "bare", False)
    q["prompt_suffix_k5"] = _prompt_sql(5, "suffix", False)
    q["prompt_bare_cot_k5"] = _prompt_sql(5, "bare", True)
    q["prompt_suffix_cot_k5"] = _prompt_sql(5, "suffix", True)
    q["prompt_budget"] = _budget_fold_sql(5, C.BUDGET_MAX_LENGTH, C.DIRECT_PREFILL)
    q["prefill_suffix"] = _with(
        ITEMS_CTE,
        f"SELECT subset, id, {_k0_bare(False)} || {lit(C.DIRECT_PREFILL)} AS model_input "
        f"FROM exam_items WHERE split = 'test'",
    )
    before, after = DEFAULT_CHAT_TEMPLATE
    q["chat_wrap"] = _with(
        ITEMS_CTE,
        f"SELECT subset, id, {lit(before)} || {_k0_bare(True)} || {lit(after + C.COT_PREFILL)} "
        f"AS model_input FROM exam_items WHERE split = 'test'",
    )
    q["messages"] = _with(
        ITEMS_CTE,
        f"SELECT subset, id, {_k0_bare(True)} AS user_content, "
        f"{strip(lit(C.COT_PREFILL))} AS assistant_content, "
        f"{_k0_bare(True)} || {strip(lit(C.COT_PREFILL))} AS flat_input "
        f"FROM exam_items WHERE split = 'test'",
    )
    q["pending_ids"] = _with(
        LOG_CTE,
        "SELECT subset, id FROM exam_items WHERE split = 'test' "
        "AND (subset, id) NOT IN (SELECT subset, id FROM exam_log)",
    )
    # a plain count on the documents, which does not use the exam view
    q["items_text_check"] = (
        f"SELECT lang AS subset, count(*) AS n_items, sum(len(string_split(text, {NL}))) AS n_lines, "
        f"sum(length(replace(text, {NL}, ''))) AS n_chars FROM documents GROUP BY lang"
    )
    q["overwrite_one_run"] = _with(
        RESPONSES_CTE,
        "SELECT 'r1' AS run_id, subset, id, full_response FROM exam_responses UNION ALL "
        "SELECT 'r2' AS run_id, subset, id, 'B)' AS full_response FROM exam_responses",
    )
    q["rescore_dedupe"] = _with(
        RESPONSES_CTE,
        "SELECT subset, 2 * count(*) AS n FROM exam_responses GROUP BY subset",
    )
    q["log_distinct_ids"] = _with(LOG_CTE, "SELECT DISTINCT subset, id FROM whole_log")
    for mode, key in (("direct", "rescore_union"), ("cot", "rescore_union_cot")):
        q[key] = _with(
            LOG_CTE,
            _report_sql(
                "(SELECT subset, full_response, gold_answer FROM exam_log UNION ALL "
                "SELECT subset, full_response, gold_answer FROM exam_responses r "
                "WHERE NOT EXISTS (SELECT 1 FROM exam_log g WHERE g.subset = r.subset AND g.id = r.id))",
                mode,
            ),
        )
    q["log_roundtrip"] = _with(
        LOG_CTE, "SELECT subset, id, prompt, full_response, gold_answer FROM whole_log"
    )
    q["overwrite_subset"] = _with(
        LOG_CTE,
        "SELECT subset, id, full_response, gold_answer FROM whole_log "
        f"WHERE subset NOT IN ({', '.join(repr(s) for s in C.OVERWRITE_SUBSETS)}) "
        f"UNION ALL SELECT subset, id, {lit('again' + chr(10) * 2)} || full_response AS full_response, gold_answer "
        "FROM exam_responses WHERE subset = 'en'",
    )
    q["items_scan_dev"] = _with(
        ITEMS_CTE, "SELECT subset, seq, id, answer FROM exam_items WHERE split = 'dev'"
    )
    names = ", ".join(repr(n.strip()) for n in C.SUBSET_SPEC.split(","))
    q["subset_filter"] = _with(
        ITEMS_CTE, f"SELECT subset, split, id FROM exam_items WHERE subset IN ({names})"
    )
    req = " UNION ".join(f"SELECT {lit(n.strip())} AS subset" for n in C.UNKNOWN_SPEC.split(","))
    q["unknown_subsets"] = _with(
        ITEMS_CTE,
        f"SELECT subset FROM ({req}) WHERE subset NOT IN (SELECT DISTINCT subset FROM exam_items)",
    )
    q["reconcile_counts"] = _with(
        FAILURES_CTE,
        "SELECT subset, count(*) AS n_expected, "
        "CAST(sum(CASE WHEN failed THEN 0 ELSE 1 END) AS BIGINT) AS n_answered, "
        "CAST(sum(CASE WHEN failed THEN 1 ELSE 0 END) AS BIGINT) AS n_missing "
        "FROM exam_failures GROUP BY subset",
    )
    q["prefix_commit"] = _with(
        FAILURES_CTE,
        "SELECT f.subset, f.seq, f.id FROM exam_failures f "
        "LEFT JOIN (SELECT subset, min(seq) AS ff FROM exam_failures WHERE failed GROUP BY subset) m "
        "USING (subset) WHERE m.ff IS NULL OR f.seq < m.ff",
    )
    backends = "[" + ", ".join(f"'{b}'" for b in BACKENDS) + "]"
    q["run_dirs"] = (
        "SELECT model, backend, cot, coalesce(nullif(log_dir, ''), "
        "'log/' || replace(model, '/', '_') || CASE WHEN backend = 'hf' THEN '_logits' "
        "WHEN cot THEN '_cot' ELSE '' END) AS run_dir, contains(lower(model), 'awq') AS awq FROM ("
        f"SELECT lang || '/' || source AS model, {backends}[n_ % 6 + 1] AS backend, "
        "(n_ % 4 = 1) AS cot, CASE WHEN n_ % 5 = 0 THEN 'custom/' || lang END AS log_dir "
        "FROM (SELECT DISTINCT lang, source, CAST(regexp_extract(source, '[0-9]+', 0) AS INTEGER) AS n_ "
        "FROM documents))"
    )
    q["log_softmax_token"] = _with(
        LOGITS_CTE, "SELECT subset, id, choice, round(lp, 6) AS lp FROM lp_"
    )
    q["choice_loglik"] = _with(
        LOGITS_CTE, "SELECT subset, id, choice, round(loglik, 6) AS loglik FROM ll_"
    )
    q["choice_argmax"] = _with(
        LOGITS_CTE,
        "SELECT subset, id, choice || ')' AS prediction, round(loglik, 6) AS loglik FROM ("
        "SELECT *, row_number() OVER (PARTITION BY subset, id ORDER BY loglik DESC, choice) AS r_ "
        "FROM ll_) WHERE r_ = 1",
    )
    ctx = f"string_split({_k0_bare(False)} || {lit(C.DIRECT_PREFILL)}, ' ')"
    n = f"({C.TRUNCATE_MAX_LENGTH} - 1)"
    q["left_truncate"] = _with(
        ITEMS_CTE,
        "SELECT subset, id, 1 AS n_conti, CAST(len(k_) AS INTEGER) AS n_kept, "
        "array_to_string(k_, ' ') AS kept_text FROM ("
        f"SELECT subset, id, list_slice(c_, greatest(len(c_) - {n}, 0) + 1, len(c_)) AS k_ "
        f"FROM (SELECT subset, id, {ctx} AS c_ FROM exam_items WHERE split = 'test'))",
    )
    q["respond_stub"] = _with(
        LOG_CTE + CALLS_CTE,
        f"SELECT subset, id, {_call('text', C.STUB_MAX_TRIES)} AS full_response FROM recorded_ "
        "WHERE (subset, id) NOT IN (SELECT subset, id FROM exam_log)",
    )
    tries = C.RETRY_MAX_TRIES
    q["respond_retry"] = _with(
        ITEMS_CTE + CALLS_CTE,
        f"SELECT subset, id, {_call('text', tries)} AS full_response, {_call('text', tries)} IS NULL AS failed, "
        f"CAST(coalesce(least(first_, {tries}), {tries}) AS INTEGER) AS attempts FROM recorded_",
    )
    q["evaluate_resume"] = _with(
        LOG_CTE + CALLS_CTE,
        _report_sql(
            "(SELECT subset, full_response, gold_answer FROM exam_log UNION ALL "
            "SELECT subset, text AS full_response, answer AS gold_answer FROM recorded_ "
            "WHERE text IS NOT NULL AND (subset, id) NOT IN (SELECT subset, id FROM exam_log))",
            "direct",
        ),
    )
    q["resume_after_abort"] = _with(
        ITEMS_CTE + CALLS_CTE,
        "SELECT 'once' AS run_id, subset, id, text AS full_response, answer AS gold_answer "
        "FROM recorded_ WHERE text IS NOT NULL",
    )
    q["loglik_requests"] = _with(
        ITEMS_CTE,
        f"SELECT subset, id, chr(CAST(64 + pos_ AS INTEGER)) AS choice, "
        f"{_k0_bare(False)} || {lit(C.DIRECT_PREFILL)} AS context, "
        f"chr(CAST(64 + pos_ AS INTEGER)) AS continuation FROM ("
        f"SELECT *, unnest(generate_series(1, len({present()}))) AS pos_ "
        f"FROM exam_items WHERE split = 'test')",
    )
    q["loglik_report"] = _with(
        LOGITS_CTE,
        _report_sql(
            "(SELECT subset, choice || ')' AS full_response, "
            "chr(CAST(65 + CAST(id AS BIGINT) % 4 AS INTEGER)) AS gold_answer FROM ("
            "SELECT *, row_number() OVER (PARTITION BY subset, id ORDER BY loglik DESC, choice) AS r_ "
            "FROM ll_) WHERE r_ = 1)",
            "direct",
        ),
    )
    before, after = DEFAULT_CHAT_TEMPLATE
    wrapper = before + after + C.DIRECT_PREFILL
    ctes, body = _budget_parts(5, C.BUDGET_MAX_LENGTH, wrapper)
    q["evaluate_budget_chat"] = _with(
        ITEMS_CTE + CALLS_CTE + ctes + f", prompts_ AS ({body})",
        "SELECT p.subset, p.id, p.prompt, split_part(r.text, " + lit(QUESTION_TAG) + ", 1) AS full_response, "
        "p.gold_answer FROM prompts_ p JOIN recorded_ r ON r.subset = p.subset AND r.id = p.id "
        "WHERE r.text IS NOT NULL",
    )
    q["evaluate_loglik"] = _with(
        ITEMS_CTE
        + _header_ctes(5, "bare", False)
        + f""",
prompts_ AS ({_prompt_select(5, "bare", False)}),
contexts_ AS (SELECT *, prompt || {lit(C.DIRECT_PREFILL)} AS context FROM prompts_){_best_option("contexts_", "context")}""",
        _report_sql("best_", "direct"),
    )
    words = f"regexp_extract_all(context, {lit(C.WORDS)})"
    cut = f"array_to_string(list_slice({{w}}, greatest(len({{w}}) - {C.CONTEXT_LENGTH} + n_conti, 0) + 1, len({{w}})), '')"
    n_conti = f"len(regexp_extract_all(context || {{x}}, {lit(C.WORDS)})) - len({words})"
    # a letter behind a blank is a token of its own, behind anything else a part of the last
    q["evaluate_loglik_truncated"] = _with(
        ITEMS_CTE
        + f""",
whole_ AS (
  SELECT subset, id, answer AS gold_answer, {_k0_bare(False)} || {lit(C.DIRECT_PREFILL)} AS context
  FROM exam_items WHERE split = 'test'),
contexts_ AS (
  SELECT subset, id, gold_answer, {cut.format(w="w_")} AS cut_
  FROM (SELECT *, {words} AS w_, {n_conti.format(x="'A'")} AS n_conti FROM whole_)){_best_option("contexts_", "cut_")}""",
        "SELECT subset, id, full_response FROM best_",
    )
    q["cut_contexts"] = _with(
        ITEMS_CTE,
        f"SELECT subset, id, choice, {cut.format(w='w_')} AS kept_text, "
        f"CAST(least(len(w_), {C.CONTEXT_LENGTH} - n_conti) AS INTEGER) AS n_kept, CAST(n_conti AS INTEGER) AS n_conti, "
        f"{cut.format(w='w_')} AS text_by_spans FROM (SELECT *, {words} AS w_, {n_conti.format(x='choice')} AS n_conti "
        f"FROM ({q['loglik_requests'][len('WITH ' + ITEMS_CTE.strip()):]}))",
    )
    q["continuation_loglik"] = f"""
WITH rows_ AS (
  SELECT vec_id // {C.SEQUENCE} AS s_, vec_id % {C.SEQUENCE} AS pos, label, CAST(embedding AS DOUBLE[]) AS logits FROM embeddings),
long_ AS (SELECT *, least(1 + s_ % 3, count(*) OVER (PARTITION BY s_) - 1) AS n, count(*) OVER (PARTITION BY s_) AS len_ FROM rows_),
aligned_ AS (
  SELECT t.s_, t.n, l.logits[t.label + 1] - list_max(l.logits) - ln(list_reduce(list_transform(
    l.logits, lambda x_: exp(x_ - list_max(l.logits))), lambda a_, b_: a_ + b_)) AS lp
  FROM long_ t JOIN rows_ l ON l.s_ = t.s_ AND l.pos = t.pos - 1 WHERE t.pos >= t.len_ - t.n)
SELECT 'embeddings' AS subset, CAST(s_ AS VARCHAR) AS id, n, round(sum(lp), 6) AS loglik FROM aligned_ GROUP BY s_, n
"""
    q["zip_outputs"] = """
SELECT d.doc_id, o.n FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents) d
JOIN (SELECT length(text) AS n, row_number() OVER (ORDER BY length(text), doc_id) AS r FROM documents) o USING (r)
"""
    q["legacy_log_rescore"] = _with(
        LOG_CTE,
        _report_sql("(SELECT subset, full_response, gold_answer FROM whole_log)", "direct"),
    )
    one = _report_sql("(SELECT subset, full_response, gold_answer FROM exam_responses)", "direct")
    q["stream_dedupe"] = _with(
        RESPONSES_CTE, f"SELECT run_id, r_.* FROM (VALUES ('r1'), ('r2')) v_(run_id), ({one}) r_"
    )
    q["stream_report"] = _with(
        LOG_CTE,
        _report_sql("(SELECT subset, full_response, gold_answer FROM whole_log)", "direct"),
    )
    return q


ORACLE_SQL: dict[str, str] = _build()
