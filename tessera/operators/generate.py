"""Synthetic corpus generation.

A generator maps an *index table* (one row per record to make, e.g. the ids
of a real table) to records; every field is a column expression of the index,
so generation is a narrow projection that scales with the index.  Template
tables are literals of a fixed handful of rows, joined with an explicit
broadcast (bounded by construction).  Ids come from a hash of (seed, index),
so a rerun with the same seed gives the same corpus (the reference ignores
its seed, Q13).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fingerprint import content_hash_of_messages

SYSTEM_PROMPT = "You are a physics reasoning assistant. Show the full derivation and give the final numeric result."
GENERATOR_SOURCE = "synthetic_generator"

# One row per problem kind: category and difficulty (of the lint schema), the question with its quantities, the
# result and its digits, the working and the answer.  Quantities are SQL expressions of the index ``i`` that grow with it, so texts differ.
PROBLEMS = [
    ("mechanics", "high_school", "A cart covers %d m in %d s at constant speed. How fast is it?", ["3 * i + 7", "i div 5 + 2"],
     "q0 / q1", 4, "speed is distance over time: %.4f m/s", "v = %.4f m/s"),
    ("thermo", "undergraduate", "A %d W heater warms %d kg of water for one minute (c = 4186 J/(kg K)). By how much does its temperature rise?",
     ["100 + 10 * i", "i div 3 + 1"], "60 * q0 / (4186 * q1)", 5, "all heat goes into the water: rise of %.5f K", "rise = %.5f K"),
    ("em", "high_school", "Resistors of %d ohm and %d ohm in series are connected to 24 V. Which current flows?", ["2 * i + 5", "i div 4 + 3"],
     "24 / (q0 + q1)", 6, "resistances in series add up: current of %.6f A", "I = %.6f A"),
    ("optics", "undergraduate", "An object stands %d cm beyond the focus of a lens of %d cm focal length. How far from the lens is its image?",
     ["i + 4", "i div 6 + 10"], "q1 * (q0 + q1) / q0", 4, "the lens equation gives %.4f cm", "b = %.4f cm"),
    ("statistical", "graduate", "A system has %d independent spins and %d independent three-level atoms, all states equally likely. What is its entropy in units of k?",
     ["i + 1", "i div 8 + 1"], "q0 * ln(2) + q1 * ln(3)", 5, "entropies of independent parts add up: %.5f", "S/k = %.5f"),
    ("mechanics", "undergraduate", "A spring of %d N/m is pressed together by %d cm. How much energy does it hold?", ["50 + 5 * i", "i div 9 + 2"],
     "q0 * q1 * q1 / 20000", 5, "half the constant times the square of the way in metres: %.5f J", "E = %.5f J"),
]

INTEGRAL_FACTS = [  # (family, integrand, antiderivative, method)
    ("trig", "sin(x)", "-cos(x)", "table"),
    ("trig", "cos(x)", "sin(x)", "table"),
    ("trig", "sec(x)^2", "tan(x)", "table"),
    ("exp", "e^x", "e^x", "table"),
    ("exp", "x e^x", "(x - 1) e^x", "parts"),
    ("log", "1/x", "ln|x|", "table"),
    ("log", "ln(x)", "x ln(x) - x", "parts"),
    ("inverse", "1/(1 + x^2)", "arctan(x)", "table"),
    ("inverse", "1/sqrt(1 - x^2)", "arcsin(x)", "table"),
    ("rational", "1/(x^2 - 1)", "(1/2) ln|(x - 1)/(x + 1)|", "partial fractions"),
    ("substitution", "2x cos(x^2)", "sin(x^2)", "substitution"),
    ("substitution", "x/(x^2 + 1)", "(1/2) ln(x^2 + 1)", "substitution"),
]


def deterministic_uuid(seed: int, i: Column) -> Column:
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), i.cast("string")), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4),
                       F.concat(F.lit("4"), F.substring(h, 14, 3)),
                       F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def choice(i: Column, seed: int, n: int) -> Column:
    """A number below n from the md5 of ``seed:i`` -- deterministic, unlike rand() after a recompute, and any SQL engine can restate it."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), i.cast("string"))), 1, 8), 16, 10)
    return F.pmod(h.cast("bigint"), F.lit(n).cast("bigint"))


def _problem(k: int) -> Column:
    """struct(category, difficulty, question, think, answer) of problem kind k for the index ``i``."""
    category, difficulty, question, quantities, result, digits, working, answer = PROBLEMS[k]
    q = [F.expr(f"cast({e} as bigint)") for e in quantities]
    text = result
    for n, e in enumerate(quantities):
        text = text.replace(f"q{n}", f"cast({e} as double)")
    r = F.round(F.expr(text) * F.lit(10.0 ** digits)) / F.lit(10.0 ** digits)  # so that printing never meets a tie
    return F.struct(F.lit(category).alias("category"), F.lit(difficulty).alias("difficulty"), F.format_string(question, *q).alias("question"),
                    F.format_string(working, r).alias("think"), F.format_string(answer, r).alias("answer"))


def _msg(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def physics_items(index: DataFrame, start: int = 0) -> DataFrame:
    """Index (column i) with the problem table on pmod(i, kinds) -> (i, category, difficulty, question, think, answer)."""
    idx = index.select((F.col("i") + start).cast("bigint").alias("i"))
    kind = F.pmod("i", F.lit(len(PROBLEMS)))
    p = _problem(len(PROBLEMS) - 1)
    for k in range(len(PROBLEMS) - 2, -1, -1):
        p = F.when(kind == k, _problem(k)).otherwise(p)
    return idx.select("i", p.alias("p")).select("i", "p.*")


def gen_sft(index: DataFrame, split: str = "train", start: int = 0, seed: int = 0) -> DataFrame:
    """G1 (+ T5 offset): chat records with think + answer and a content fingerprint; returns (idx, raw)."""
    p = physics_items(index, start)
    asst = F.concat(F.lit("<think>\n"), F.col("think"), F.lit("\n</think>\n\n"), F.col("answer"))
    msgs = F.array(_msg("system", F.lit(SYSTEM_PROMPT)), _msg("user", F.col("question")), _msg("assistant", asst))
    rec = p.select(
        "i", deterministic_uuid(seed, F.col("i")).alias("id"), F.lit("v1.0.0").alias("version"),
        F.lit(split).alias("split"), "difficulty", "category", F.lit(GENERATOR_SOURCE).alias("source"),
        content_hash_of_messages(msgs).alias("content_hash"), msgs.alias("messages"))
    return rec.select(F.col("i").alias("idx"),
                      F.to_json(F.struct(*[c for c in rec.columns if c != "i"])).alias("raw"))


def gen_pairs(index: DataFrame, start: int = 0, seed: int = 0) -> DataFrame:
    """Preference pairs -- chosen = think + answer, rejected = only what follows the last '='.

    Returns the record columns plus ``chosen_text`` / ``rejected_text`` (the assistant turns).
    """
    p = physics_items(index, start).select(
        "i", "category", "difficulty", "question",
        F.concat(F.lit("<think>\n"), F.col("think"), F.lit("\n</think>\n\n"), F.col("answer")).alias("chosen_text"),
        F.concat(F.lit("The answer is "), F.trim(F.element_at(F.split(F.col("answer"), "="), -1)))
        .alias("rejected_text"))
    system, user = _msg("system", F.lit(SYSTEM_PROMPT)), _msg("user", F.col("question"))
    cm = F.array(system, user, _msg("assistant", F.col("chosen_text")))
    rm = F.array(system, user, _msg("assistant", F.col("rejected_text")))
    return p.select("i", deterministic_uuid(seed + 1, F.col("i")).alias("id"), F.lit("v1.0.0").alias("version"),
                    F.lit("train").alias("split"), "difficulty", "category", F.lit(GENERATOR_SOURCE).alias("source"),
                    content_hash_of_messages(cm).alias("content_hash"), cm.alias("chosen"), rm.alias("rejected"),
                    "chosen_text", "rejected_text")


def gen_calculus(index: DataFrame, seed: int = 0, mode: str = "fixed") -> DataFrame:
    """Power-rule derivative / integral problems and a chain-rule family, closed form.

    (instruction, output, type).  mode="fixed" reduces the coefficient a/(n+1)
    once; mode="reference" keeps the reference's output when a divides evenly,
    which divides twice (3x^2 -> "1x^3/3", Q12).
    """
    i = F.col("i")
    a = F.floor(i / 5) + 1
    n = i % 5 + 1
    kind = choice(i, seed, 3)
    deriv_q = F.format_string("Find the derivative of %dx^%d.", a, n)
    deriv_a = F.when(n == 1, F.format_string("d/dx = %d", a)).otherwise(
        F.format_string("d/dx = %dx^%d", a * n, n - 1))
    num, den = a, n + 1
    coef = F.when(num % den == 0, (num / den).cast("bigint").cast("string")).otherwise(
        F.format_string("%d/%d", num, den))
    integ_q = F.format_string("Compute the integral ∫ %dx^%d dx.", a, n)
    integ_a = F.format_string("∫ %dx^%d dx = %sx^%d + C", a, n, coef, n + 1)
    if mode == "reference":
        twice = F.format_string("∫ %dx^%d dx = %dx^%d/%d + C", a, n, (num / den).cast("int"), n + 1, den)
        integ_a = F.when(num % den == 0, twice).otherwise(integ_a)
    chain_q = F.format_string("Find the derivative of sin(%dx^%d).", a, n)
    chain_a = F.format_string("d/dx = %dx^%d cos(%dx^%d)", a * n, n - 1, a, n)
    return index.select(
        i,
        F.when(kind == 0, deriv_q).when(kind == 1, integ_q).otherwise(chain_q).alias("instruction"),
        F.when(kind == 0, deriv_a).when(kind == 1, integ_a).otherwise(chain_a).alias("output"),
        F.when(kind == 0, F.lit("derivative")).when(kind == 1, F.lit("integral")).otherwise(F.lit("chain_rule"))
        .alias("type"))


def facts_table(spark: SparkSession) -> DataFrame:
    rows = [(k, *f) for k, f in enumerate(INTEGRAL_FACTS)]
    return spark.createDataFrame(rows, "fact int, family string, integrand string, antiderivative string, method string")


def gen_integrals(index: DataFrame, seed: int = 0, polynomial_share: float = 0.7) -> DataFrame:
    """G4 + G5: integral questions (i, type, prompt, correct_answer, method, steps).

    A polynomial family is mixed, 70/30 by default, with the facts table and three families in closed form:
    definite, rational and composite integrals, whose numbers grow with the index.  The mixture is decided per row
    by a seeded hash, so the corpus has exactly as many rows as the index (no rejection sampling needed).
    """
    i = F.col("i").cast("bigint")
    facts, families = len(INTEGRAL_FACTS), ["definite", "rational", "composite"]
    poly = choice(i, seed, 1_000_000) < int(polynomial_share * 1_000_000)
    other = choice(i, seed + 17, facts + len(families)).cast("int")
    a, n, b = F.floor(i / 5) + 1, i % 5 + 1, i % 7 + 2
    value = (a * F.pow(b, n + 1)).cast("bigint")
    coef = F.when(a % (n + 1) == 0, (a / (n + 1)).cast("bigint").cast("string")).otherwise(F.format_string("%d/%d", a, n + 1))
    row = lambda kind, prompt, answer, method, steps: F.struct(
        kind.alias("type"), prompt.alias("prompt"), answer.alias("correct_answer"), method.alias("method"), steps.alias("steps"))
    say = F.format_string
    polynomial = row(F.lit("polynomial"), say("∫ %dx^%d dx", a, n), say("= %sx^%d + C", coef, n + 1), F.lit("power rule"),
                     say("Raise the exponent from %d to %d. Divide %d by %d. Add the constant.", n, n + 1, a, n + 1))
    closed = {
        "definite": row(F.lit("definite"), say("∫ from 0 to %d of %dx^%d dx", b, a * (n + 1), n), say("= %d", value), F.lit("limits"),
                        say("An antiderivative is %dx^%d. At %d it is %d, at 0 it is 0.", a, n + 1, b, value)),
        "rational": row(F.lit("rational"), say("∫ %d/(x + %d) dx", a, b), say("= %d ln|x + %d| + C", a, b), F.lit("logarithm"),
                        say("The derivative of x + %d is 1. Its logarithm takes the factor %d.", b, a)),
        "composite": row(F.lit("composite"), say("∫ %d cos(%dx) dx", a * b, b), say("= %d sin(%dx) + C", a, b), F.lit("substitution"),
                         say("Put u = %dx, so that dx is du/%d. Then %d/%d is %d.", b, b, a * b, b, a)),
    }
    fact = row(F.col("family"), F.concat(F.lit("∫ "), F.col("integrand"), F.lit(" dx")), F.concat(F.lit("= "), F.col("antiderivative"), F.lit(" + C")),
               F.col("fact_method"), F.concat(F.lit("The derivative of "), F.col("antiderivative"), F.lit(" is "), F.col("integrand"), F.lit(".")))
    out = F.when(F.col("is_poly"), polynomial)
    for k, name in enumerate(families):
        out = out.when(F.col("fact") == facts + k, closed[name])
    base = index.select(i.alias("i"), poly.alias("is_poly"), other.alias("fact"))
    known = facts_table(index.sparkSession).withColumnRenamed("method", "fact_method")
    return base.join(F.broadcast(known), "fact", "left").select("i", out.otherwise(fact).alias("r")).select("i", "r.*")


# ---- fixed values (wrong replies and the answer mark of the reference) ----
WRONG_MARK = " (错误)"
REFUSAL = "无法计算此积分"
ZERO_ANSWER = "0 + C"
ANSWER_LEAD = "解: "
# ---------------------------------------------------------------------------
CORRUPTIONS = ["marked", "refusal", "zero"]
OPT_IN_CORRUPTIONS = ["sign", "coefficient"]


def corrupt(answer: Column, i: Column, seed: int = 0, kinds: list[str] | None = None) -> Column:
    """struct(kind, text), a wrong reply for the rejected side; the kind is chosen by a seeded hash among ``kinds``.

    The three default kinds always differ from the answer; ``sign`` and ``coefficient`` are opt-in (Q11), and where
    they find nothing to change the reply is marked wrong instead.
    """
    kinds = kinds or CORRUPTIONS
    k = F.element_at(F.array(*[F.lit(x) for x in kinds]), (choice(i, seed, len(kinds)) + 1).cast("int"))
    first = F.regexp_extract(answer, r"[0-9]+", 0)
    raised = (F.coalesce(first.try_cast("bigint"), F.lit(0)) + choice(i, seed + 1, 3) + 1).cast("string")
    place = F.instr(answer, first)
    forms = {
        "marked": F.concat(answer, F.lit(WRONG_MARK)),
        "refusal": F.lit(REFUSAL),
        "zero": F.lit(ZERO_ANSWER),
        "sign": F.replace(answer, F.lit(" + "), F.lit(" - ")),
        "coefficient": F.when(first == "", answer).otherwise(
            F.concat(F.substr(answer, F.lit(1), place - 1), raised, F.substr(answer, place + F.length(first)))),
    }
    out = F.lit(None).cast("string")
    for name in reversed(kinds):
        out = F.when(k == name, forms[name]).otherwise(out)
    return F.struct(k.alias("kind"), F.when(out == answer, forms["marked"]).otherwise(out).alias("text"))


def gen_integral_pairs(index: DataFrame, seed: int = 0, kinds: list[str] | None = None) -> DataFrame:
    """G4-G6 as raw-prompt preference pairs: (i, prompt, chosen, rejected, type), the prompt in ChatML."""
    g = gen_integrals(index, seed)
    lead = F.lit(ANSWER_LEAD)
    return g.select("i", F.concat(F.lit("<|im_start|>user\n"), F.col("prompt"), F.lit("<|im_end|>\n<|im_start|>assistant\n")).alias("prompt"),
                    F.concat(lead, F.col("correct_answer")).alias("chosen"),
                    F.concat(lead, corrupt(F.col("correct_answer"), F.col("i"), seed + 2, kinds)["text"]).alias("rejected"), "type")


def gen_arithmetic(index: DataFrame, n_train: int = 30, n_test: int = 8) -> DataFrame:
    """A + b questions over the whole index, n_train training rows to n_test test rows."""
    i = F.col("i").cast("bigint")
    a, b = i + 1, i * 7 + 3
    return index.select(
        i.alias("i"), F.format_string("What is %d + %d?", a, b).alias("instruction"), F.lit("").alias("input"),
        (a + b).cast("string").alias("output"),
        F.when(F.pmod(i, F.lit(n_train + n_test)) < n_train, F.lit("train")).otherwise(F.lit("test")).alias("split"))
