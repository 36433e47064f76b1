"""Fixed values.

These strings and lists must equal the evaluated benchmark's conventions
exactly, or prompts and scores come out different. They are data, not logic.
"""

# --- fixed values: prompt phrases -------------------------------------------
TOPIC_LINE = "以下選擇題為出自臺灣的考題，答案為其中一個選項。"
QUESTION_TAG = "問題："
STEP_BY_STEP = "讓我們一步一步思考。"
ANSWER_TAG = "正確答案："
ANSWER_OPEN = "正確答案：("

# --- fixed values: answer-format phrases, in the order they are tested -------
NOT_CORRECT_ANSWER = "不是正確答案"
CORRECT_ANSWER = "正確答案"
INCORRECT = "不正確"
CORRECT = "正確"

# --- fixed values: option letters --------------------------------------------
OPTION_LETTERS = ["A", "B", "C", "D", "E", "F"]
# letters that make a line count as an answer line (F is not among them)
FORMAT_LETTERS = ["A", "B", "C", "D", "E"]

# --- fixed values: Python str.strip() whitespace (29 code points) -----------
PY_WHITESPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u001c\u001d\u001e\u001f\u0020\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- fixed values: the 37 benchmark subsets ----------------------------------
SUBSETS = [
    "AST_chinese",
    "AST_mathematics",
    "AST_biology",
    "AST_chemistry",
    "AST_physics",
    "AST_civics",
    "AST_geography",
    "AST_history",
    "GSAT_chinese",
    "GSAT_chemistry",
    "GSAT_biology",
    "GSAT_physics",
    "GSAT_earth_science",
    "GSAT_mathematics",
    "GSAT_geography",
    "GSAT_history",
    "GSAT_civics",
    "CAP_chinese",
    "CAP_mathematics",
    "CAP_biology",
    "CAP_history",
    "CAP_civics",
    "CAP_geography",
    "CAP_physics",
    "CAP_chemistry",
    "CAP_earth_science",
    "driving_rule",
    "basic_traditional_chinese_medicine",
    "clinical_traditional_chinese_medicine",
    "lawyer_qualification",
    "nutritionist",
    "tour_guide",
    "tour_leader",
    "taiwan_tourist_resources",
    "clinical_psychologist",
    "teacher_qualification",
    "accountant",
]

# --- fixed values: run defaults ----------------------------------------------
DEFAULT_FEW_SHOT = 5
MAX_FEW_SHOT = 5
DEFAULT_MAX_TOKENS = 128
DEFAULT_TEMPERATURE = 0.0
DEFAULT_TIMEOUT = 20.0
DEFAULT_MAX_RETRIES = 100

# --- fixed values: backends and what they imply ------------------------------
BACKENDS = ["hf", "vllm", "openai", "anthropic", "google", "custom_api"]
# prompt style per backend: "bare" adds nothing after the options of the
# question being asked, "suffix" opens the answer (or the reasoning) itself
BACKEND_STYLE = {
    "hf": "bare",
    "vllm": "bare",
    "anthropic": "bare",
    "openai": "suffix",
    "custom_api": "suffix",
    "google": "suffix",
}
# prefill per backend for (direct, chain-of-thought)
BACKEND_PREFILL = {
    "hf": ("\n正確答案：(", None),
    "vllm": ("\n正確答案：(", "\n讓我們一步一步思考。\n"),
    "anthropic": ("\n正確答案：(", "\n讓我們一步一步思考。\n"),
    "openai": ("", ""),
    "custom_api": ("", ""),
    "google": ("", ""),
}
