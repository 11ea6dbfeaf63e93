"""Answer parsing and reward expressions (R1-R5, A14) as Spark columns.

These are per-row helpers *inside* Spark jobs: every function returns a
Column built from built-in functions, so scoring a table of replies is one
codegen'd projection.  The patterns are legal in Java regex and RE2, so the
DuckDB oracles use the same text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import DIGIT, NONWORD, WS, strip

# ---- fixed values (must equal the reference's) ----
ANSWER_MARK = "答案"
SOLUTION_MARK = "解答"
COLONS = "[：:]"
THINK_OPEN, THINK_CLOSE = "<think>", "</think>"
UNITS = ["m/s", r"m/s\^2", "kg", "N", "J", "Pa", "K", "eV", "Hz", "W", "C", "V", "T", "mol", "rad"]
STRUCT_WEIGHTS = {"think": 0.3, "equation": 0.2, "unit": 0.2, "number": 0.3}
PPO_KEYWORDS = ["解", "积分", "=", "+ C", "C", "步骤"]
PPO_KEYWORD_STEP, PPO_INTEGRAL_BONUS, PPO_BASE = 0.15, 0.1, -0.5
RM_KEYWORDS = ["解", "积分", "=", "+ C", "C"]
RM_KEYWORD_STEP = 0.1
LEARNED_WEIGHT, SYMBOLIC_WEIGHT = 0.3, 0.7

SOLUTION_SPLIT = rf"(?s)^(.*?)\n?{WS}*{SOLUTION_MARK}{WS}*{COLONS}{WS}*(.*)\z"
SOLUTION_PRESENT = rf"{SOLUTION_MARK}{WS}*{COLONS}"
ANSWER_PRESENT = rf"{ANSWER_MARK}{WS}*{COLONS}"
ANSWER_TO_END = rf"(?s){ANSWER_MARK}{WS}*{COLONS}{WS}*(.*)\z"
ANSWER_TO_BREAK = rf"(?s){ANSWER_MARK}{WS}*{COLONS}{WS}*(.*?)(?:\n\n|\n{SOLUTION_MARK}|\n?\z)"
EQUATION = rf"[A-Za-z]{WS}*={WS}*[-+]?{DIGIT}"
UNIT = rf"(^|{NONWORD})(" + "|".join(UNITS) + rf")({NONWORD}|$)"
# expression after '=' (three patterns, tried in order; '.' is any char but \n)
EXPR_PATTERNS = [
    rf"={WS}*([^\n]+?){WS}*\+?{WS}*C",
    rf"={WS}*([^\n]+?){WS}*<\|im_end\|>",
    rf"={WS}*([^\n]+?)\n?\z",
]
# ---------------------------------------------------

# Same language, faster in Java: a first-character gate, the left boundary as a look-behind, then the
# units as a trie grouped by first character (built from UNITS, longest suffix first).
_WORD = r"[\p{L}\p{N}_]"


def _unit_trie() -> str:
    groups: dict[str, list[str]] = {}
    for u in UNITS:
        groups.setdefault(u[0], []).append(u[1:])
    alts = []
    for c, rest in groups.items():
        rest = sorted(rest, key=len, reverse=True)
        alts.append(c if rest == [""] else c + "(?:" + "|".join(rest) + ")")
    return rf"(?=[{''.join(groups)}])(?<!{_WORD})(?:" + "|".join(alts) + rf")(?!{_WORD})"


UNIT_JAVA = _unit_trie()


def answer_and_solution(text: Column) -> Column:
    """struct(answer, solution) of a reply or ground-truth text.

    (1) empty -> two empty strings; (2) split once at the solution marker:
    the answer is what follows the answer marker in the first part, else the
    whole first part; (3) no solution marker: the answer runs up to a blank
    line; (4) nothing found: the whole stripped text is the answer.
    """
    t = F.coalesce(text, F.lit(""))
    # plain substring tests first: most texts hold neither mark, and no pattern runs over them
    cut = F.when(t.contains(SOLUTION_MARK), F.split(t, SOLUTION_PRESENT, 2)).otherwise(F.array(t))  # one cut at the first solution mark

    def parsed(parts: Column) -> Column:
        head, two = F.get(parts, F.lit(0)), F.size(parts) > 1
        marked = head.contains(ANSWER_MARK) & head.rlike(ANSWER_PRESENT)
        found = F.when(marked, strip(F.regexp_extract(head, ANSWER_TO_BREAK, 1))).otherwise(F.lit(""))
        answer = F.when(two & marked, strip(F.regexp_extract(head, ANSWER_TO_END, 1))).when(two | (found == ""), strip(head)).otherwise(found)
        return F.struct(answer.alias("answer"), F.when(two, strip(F.get(parts, F.lit(1)))).otherwise(F.lit("")).alias("solution"))
    return F.get(F.transform(F.array(cut), parsed), F.lit(0))  # the parts are bound once, however often they are named


def structural_reward(response: Column) -> Column:
    """R2: +0.3 think tags, +0.2 letter = number, +0.2 a unit word, +0.3 a number."""
    r = F.coalesce(response, F.lit(""))
    w = STRUCT_WEIGHTS
    return (F.when(r.contains(THINK_OPEN) & r.contains(THINK_CLOSE), F.lit(w["think"])).otherwise(F.lit(0.0))
            + F.when(r.contains("=") & r.rlike(EQUATION), F.lit(w["equation"])).otherwise(F.lit(0.0))
            + F.when(r.rlike(UNIT_JAVA), F.lit(w["unit"])).otherwise(F.lit(0.0))
            + F.when(r.rlike(DIGIT), F.lit(w["number"])).otherwise(F.lit(0.0)))


def _keyword_count(text: Column, keywords: list[str]) -> Column:
    out = F.lit(0)
    for k in keywords:
        out = out + F.when(text.contains(k), F.lit(1)).otherwise(F.lit(0))
    return out


def with_answers(responses: DataFrame, answers: DataFrame, prompt: str = "prompt_id") -> DataFrame:
    """Every response with the answer of its prompt (inner join; prompts without an answer drop out).

    Many responses share a prompt; which side is broadcast or split is left to adaptive execution.
    """
    return responses.join(answers, prompt, "inner")


def extract_expression(text: Column) -> Column:
    """Expression after '=' by the three patterns in order (null when none matches)."""
    t = F.coalesce(text, F.lit(""))
    out = F.lit(None).cast("string")
    for p in reversed(EXPR_PATTERNS):
        out = F.when(t.rlike(p), strip(F.regexp_extract(t, p, 1))).otherwise(out)
    return out


def normalise_expression(e: Column) -> Column:
    """Drop the integral sign and dx, map pi and infinity, keep function names, drop spaces.

    The reference deletes every backslash word (so sin and cos compare equal,
    Q10); we drop only the backslash.
    """
    s = F.replace(F.replace(e, F.lit("∫"), F.lit("")), F.lit("dx"), F.lit(""))
    s = F.replace(F.replace(s, F.lit("π"), F.lit("pi")), F.lit("∞"), F.lit("oo"))
    s = F.replace(s, F.lit("\\frac"), F.lit("/"))
    s = F.regexp_replace(s, r"\\([a-zA-Z]+)", "$1")
    s = F.replace(F.replace(s, F.lit("{"), F.lit("(")), F.lit("}"), F.lit(")"))
    return F.regexp_replace(s, WS, "")


def expression_match(model_answer: Column, correct_answer: Column) -> Column:
    """Both sides have an expression and their normalised texts are equal."""
    a, b = extract_expression(model_answer), extract_expression(correct_answer)
    ok = a.isNotNull() & (a != "") & b.isNotNull() & (b != "")
    return F.coalesce(ok & (normalise_expression(a) == normalise_expression(b)), F.lit(False))


def partial_credit_reward(model_answer: Column, correct: Column) -> Column:
    """R3 (policy flavour): 1.0 if correct, else -0.5 + 0.15/keyword + 0.1 for an integral sign, in [-1, 1]."""
    t = F.coalesce(model_answer, F.lit(""))
    wrong = (F.lit(PPO_BASE) + _keyword_count(t, PPO_KEYWORDS) * F.lit(PPO_KEYWORD_STEP)
             + F.when(t.contains("∫"), F.lit(PPO_INTEGRAL_BONUS)).otherwise(F.lit(0.0)))
    return F.when(correct, F.lit(1.0)).otherwise(F.greatest(F.least(wrong, F.lit(1.0)), F.lit(-1.0)))


def reward_model_credit(model_answer: Column, correct: Column) -> Column:
    """R3 (reward-model flavour): 1.0 if correct, else -0.5 + 0.1/keyword of 5, floor -1."""
    t = F.coalesce(model_answer, F.lit(""))
    wrong = F.lit(PPO_BASE) + _keyword_count(t, RM_KEYWORDS) * F.lit(RM_KEYWORD_STEP)
    return F.when(correct, F.lit(1.0)).otherwise(F.greatest(wrong, F.lit(-1.0)))


def combined_reward(learned: Column, symbolic: Column) -> Column:
    """0.3 learned + 0.7 symbolic; symbolic alone when there is no learned score (Q9)."""
    return F.when(learned.isNull(), symbolic).otherwise(
        F.lit(LEARNED_WEIGHT) * learned + F.lit(SYMBOLIC_WEIGHT) * symbolic)


def keyword_hit(answer: Column, keywords: Column) -> Column:
    """Any expected keyword occurs, case-insensitively."""
    return F.exists(keywords, lambda k: F.lower(F.coalesce(answer, F.lit(""))).contains(F.lower(k)))
