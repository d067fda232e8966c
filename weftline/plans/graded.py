"""Rewards and the forms of answers that they compare, on tables of cases.

A case is inputs and what they have to give. A query deals the cases to the rows of `documents` in turn, so that it
runs over the whole table; its SQL has the expected values. Where a reward reads a response, the document's text is
what stands before the answer.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from weftline.functions import answers, rewards
from weftline.functions import text as T
from weftline.plans.common import table

FORMS: dict[str, tuple[Callable, list[tuple[str, str]]]] = {
    "fn_mathd_normalize": (answers.hendrycks, [
        ("\\text{ 5 }", "5"), ("\\frac12", "\\frac{1}{2}"), ("\\tfrac1{72}", "\\frac{1}{72}"), ("0.5", "\\frac{1}{2}"), ("3/4", "\\frac{3}{4}"), ("x=5", "5"), ("abc=5", "abc=5"),
        ("\\sqrt2", "\\sqrt{2}"), ("5\\text{ cm}", "5"), ("50\\%", "50"), ("\\$7", "7"), ("90^\\circ", "90"), (".25", "0.25"), ("\\left(1, 2\\right)", "(1,2)"), ("\\dfrac{a}{b}", "\\frac{a}{b}"),
        ("2\\!3", "23"), ("\\sqrt", "\\sqrt"), ("\\frac1", "\\frac1"), ("03/4", "03/4"), ("1/2/3", "1/2/3"), ("\\text{ a }\\text{ b }", "a}"), ("1\\text{ a }2\\text{ b }", "1\\text{ a }2\\text{ b }"), ("", ""), ("x = 3 = y", "x=3=y"), ("\\frac{1}2", "\\frac{1}2"),
    ]),
    "fn_math_normalize": (answers.plain, [
        ("5 cm", "5"), ("5\\text{ cm}", "5"), ("3 million", "3*10^6"), ("7 3/4", "7+3/4"), ("7\\frac{3}{4}", "7+3/4"), ("1,234", "1234"), ("5.0", "5"), ("X", "x"), ("\\text{Yes}", "yes"), ("2 or 3", "2,3"),
        ("90^\\circ", "90"), ("{12}", "12"), ("- 3", "-3"), ("\\frac{1}{2}", "1/2"), ("2\\pi", "2pi"), ("\\sqrt{8}", "sqrt(8)"), ("$4", "4"), ("12\\%", "12"), ("5 seconds", "5"), ("2 \\cdot 3", "2*3"), ("0.50", "0.50"),
    ]),
    "fn_norm_final_answer": (answers.integer_form, [
        ("x = 12", "12"), ("12 cm", "12"), ("1,234", "1234"), ("\\$5", "5"), ("\\text{12}", "12"), ("\\frac12", "\\frac{1}{2}"), ("an 8", "8"), ("\\boxed{7}", "7"), ("3 apples", "3apples"), ("90^\\circ", "90"),
        ("2 hours", "2"), ("$x$", "x"), ("the $4$ of them", "4"), ("\\sqrt2", "\\sqrt{2}"), ("1,2,x", "1,2,x"), ("\\overline{ab}", "ab"), ("7<|im_end|>", "7"), ("5 units squared", "5d"),
    ]),
    "fn_normalize_latex": (answers.from_latex, [
        ("\\frac{1}{2}", "1/2"), ("\\dfrac{x+1}{2}", "x+1/2"), ("3\\frac{1}{2}", "3 1/2"), ("\\sqrt{2}", "sqrt(2)"), ("\\sqrt3", "sqrt(3)"), ("2\\pi", "2pi"), ("a\\cdot b\\times c", "a* b* c"), ("\\left(1,2\\right]", "(1,2]"),
        ("\\text{yes}", "yes"), ("\\infty", "inf"), ("A\\cup B", "AU B"), ("\\frac12", "1/2"), ("\\frac{\\sqrt{2}}{3}", "sqrt(2)/3"), ("1\\,000", "1 000"),
    ]),
    "fn_split_tuple": (lambda x: "|".join([str(len(answers.parts(x))), *answers.parts(x)]), [
        ("(1,2)", "2|1|2"), ("1,234", "1|1234"), ("[a, b)", "2|a|b"), ("((1,2),3)", "1|((1,2),3)"), ("", "0"), ("()", "1|()"), ("(1,234,567)", "1|1234567"), ("1,2", "1|1,2"),
    ]),
    "fn_last_boxed": (lambda x: answers.boxed(x) or "-", [
        ("\\boxed{1} \\boxed{\\frac{1}{2}}", "\\boxed{\\frac{1}{2}}"), ("\\boxed{1", "-"), ("none", "-"), ("\\fbox{2}", "\\fbox{2}"), ("\\boxed{1} \\fbox{2}", "\\boxed{1}"), ("\\boxed 5 and {x}", "\\boxed 5 and {x}"), ("\\boxed{1} \\boxed{2", "-"),
    ]),
    "fn_remove_boxed": (lambda x: "none" if answers.inside(x) is None else answers.inside(x), [
        ("\\boxed{\\frac{1}{2}}", "\\frac{1}{2}"), ("\\fbox{2}", "none"), ("\\boxed 5", "none"), ("\\boxed{}", ""), ("x", "none"),
    ]),
}

GATE = [("x+1", True), ("x+y+z", False), ("x^{2}", False), ("x^2", True), ("x^12", False), ("x^2^3", False), ("sqrt(x)", True), ("x^(2)", False), ("frac(x,y)", True), ("2", True)]

#: name: the reward's type, then (what follows the text, the truth, metadata or None, the reward).
GRADED: dict[str, tuple[str, list[tuple[str, str, dict | None, float]]]] = {
    "rw_deepscaler": ("deepscaler", [
        ("</think> \\boxed{\\sqrt2}", "\\sqrt{2}", None, 1), ("</think> \\boxed{x=5}", "5", None, 1), ("</think> \\boxed{5\\text{ cm}}", "5", None, 1), ("###Response \\boxed{7}", "7", None, 1), ("\\boxed{7}", "7", None, 0),
        ("</think> \\boxed{x+1}", "1+x", None, 1), ("</think> 7", "7", None, 0), ("</think> \\boxed{7}", "", None, 0), ("</think> \\boxed{2/4}", "1/2", None, 0), ("</think> \\boxed{(1,2)}", "(1, 2)", None, 1),
        ("</think>\\boxed{[1,2]}", "(1,2)", None, 0), ("a</think>b</think>\\boxed{3}", "\\boxed{3}", None, 1), ("</think> \\boxed{0.5}", "\\frac{1}{2}", None, 1), ("</think>\\boxed{8", "8", None, 0), ("</think>\\boxed{9}", "\\boxed{9", None, 0),
        ("</think>\\boxed{2\\sqrt{2}}", "\\sqrt{8}", None, 1), ("</think>\\boxed{1,000}", "1000", None, 1), ("</think>\\boxed{5.1}", "5", None, 0), ("</think>\\boxed{x}", "y", None, 0), ("</think>\\boxed{}", "", None, 0),
    ]),
    "rw_math": ("math", [
        ("\\boxed{\\frac{2}{4}} \\boxed{\\frac12}", "\\frac{1}{2}", None, 1), ("\\boxed{\\frac{2}{4}}", "\\frac{1}{2}", None, 0), ("42", "42", None, 0), ("\\boxed{42}", "\\boxed{42}", None, 1), ("\\boxed{42}", "", None, 0),
        ("\\boxed{3(x+1)}", "3x+3", None, 1), ("\\boxed{(x+1)^2}", "x^2+2x+1", None, 1), ("\\boxed{x^{2}+x}", "x+x^{2}", None, 1), ("\\boxed{x^2+1}", "x^2-1", None, 0), ("\\boxed{a+b+c}", "c+b+a", None, 0),
        ("\\boxed{\\text{Yes}}", "yes", None, 1), ("\\boxed{50\\%}", "50", None, 1), ("\\boxed{3 million}", "3000000", None, 0), ("\\boxed{7\\frac{3}{4}}", "31/4", None, 1), ("\\boxed{2\\pi}", "2 \\pi", None, 1), ("\\fbox{2}", "2", None, 0),
    ]),
    "rw_dapo": ("dapo", [
        ("\nAnswer: 42", "42", None, 1), ("\nAnswer: 42\nanswer: 43", "43", None, 1), ("\n\\boxed{42}", "42", None, -1), ("\nAnswer: 4.0", "4", None, -1), ("\nAnswer: 4", "4.0", None, 1), ("\nno more of it", "7", None, -1),
        ("\nAnswer: 1,234", "1234", None, 1), ("\nAnswer: 2/1", "2", None, -1), ("\nAnswer: 5 " + "x" * 400, "5", None, -1), ("\nANSWER : $x = 12$", "12", None, 1), ("\nAnswer: 12 cm", "12", None, 1),
    ]),
    "rw_gpqa": ("gpqa", [
        ("</think>The answer is B", "B", None, 1), ("</think>option C", "C", None, 1), ("</think>B is correct", "A", None, 0), ("</think>it is blue", "blue sky", {"choices": ["red", "Blue sky"]}, 0),
        ("</think>we saw a blue-sky there", "blue sky", {"choices": ["red", "Blue sky"]}, 1), ("</think>Answer: Z", "A", None, 1), ("</think>choice D", "whatever", {"correct_letter": "d"}, 1), ("</think>the D of it, no: C", "C", None, 1),
        ("</think>answer J", "J", {"valid_letters": ["i", "j"]}, 1), ("</think>nothing told", "B", None, 0), ("</think>option b", "A", {"choices": {"x": "yes", "y": "no"}}, 0), ("</think>it says no", "none", {"choices": ["yes", "no"], "correct_letter": "B"}, 1),
        ("</think>the A", "text", None, 0), ("</think>h2o it is", "ignored", {"correct_answer": "H2O"}, 1),
    ]),
    "rw_skywork_math": ("skywork", [
        ("\nAnswer: 12", "12", None, 1), ("\n**Answer: 12**", "12", None, 1), ("\nso \\boxed{12}", "12", None, 1), ("\n12", "12", None, 0), ("\nAnswer: 1\nAnswer: 2", "2", None, 1), ("\nAnswer: 3", "4", None, 0), ("\nAnswer: $\\frac12$", "\\frac{1}{2}", None, 1),
    ]),
    "udf_reward": ("math", [
        ("</think> \\boxed{7}", "7", None, 1), ("</think> \\boxed{7}", "7", {"rm_type": "deepscaler"}, 1), ("\n\\boxed{7}", "7", {"rm_type": "deepscaler"}, 0), ("\nAnswer: 7", "7", {"rm_type": "dapo"}, 1), ("\nAnswer: 8", "7", {"rm_type": "dapo"}, -1),
        ("\\boxed{the cat}", "cat", {"rm_type": "boxed_f1"}, 1), ("\\boxed{B}", "B", {"rm_type": "boxed_gpqa"}, 1), ("\\boxed{3", "3", {"rm_type": "boxed_f1"}, 0), ("x", "anything", {"rm_type": "always"}, 1), ("\\boxed{x}", "1", {"rm_type": "boxed_always"}, 1),
    ]),
}


def always(response, label, metadata) -> float:
    """A hook: 1 for any response that isn't empty."""
    return float(bool(response))


def contained(responses: list, labels: list) -> list[float]:
    """A hook of a whole batch: 1 if the label is part of the response."""
    return [float(b is not None and b in (a or "")) for a, b in zip(responses, labels)]


HOOKS = {"always": "weftline.plans.graded.always", "skywork": "weftline.plans.graded.skywork"}


def skywork(response, label, metadata) -> float:
    return rewards.line_reward(response, label)


def docs(s, d):
    return table(s, d, "documents").select("doc_id", "text")


def dealt(values: list) -> F.Column:
    """The value whose turn it is, by doc_id."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod("doc_id", F.lit(len(values))).cast("int"))


def quoted(v) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def dealt_sql(values: list) -> str:
    return f"([{', '.join(map(quoted, values))}])[doc_id % {len(values)} + 1]"


def form_query(rule: Callable, cases: list):
    @F.pandas_udf(StringType())
    def apply(x: pd.Series) -> pd.Series:
        return x.map(rule)

    return lambda s, d: docs(s, d).select("doc_id", apply(dealt([c[0] for c in cases])).alias("form"))


def gate(s, d):
    @F.pandas_udf(BooleanType())
    def allowed(x: pd.Series) -> pd.Series:
        return x.map(answers.may_evaluate)

    return docs(s, d).select("doc_id", allowed(dealt([c[0] for c in GATE])).alias("allowed"))


def graded_query(kind: str, cases: list):
    graded = rewards.reward_column(kind, HOOKS)

    def q(s, d):
        rows = docs(s, d).select("doc_id", F.concat(F.coalesce("text", F.lit("")), dealt([c[0] for c in cases])).alias("r"), dealt([c[1] for c in cases]).alias("t"), dealt([json.dumps(c[2]) if c[2] else "" for c in cases]).alias("m"))
        return rows.select("doc_id", graded("m", "r", "t").alias("reward"))

    return q


def batch(s, d):
    """The batch hook: labels that the text holds, and others that it doesn't."""
    label = F.when(F.col("doc_id") % 2 == 0, F.left("text", F.lit(12))).otherwise(F.concat("text", F.lit("!")))
    return docs(s, d).select("doc_id", rewards.batch_reward_column("weftline.plans.graded.contained")("text", label).alias("reward"))


def coin(s, d):
    """Rewards by chance are 0 or 1, and over many rows both occur."""
    r = rewards.py_reward(F.lit("random"), "text", "text")
    return docs(s, d).select(r.alias("reward")).agg(F.count_if(~F.col("reward").isin(0.0, 1.0)).alias("others"), (F.min("reward") < F.max("reward")).alias("both"))


def letters(s, d):
    """The letter that a turn's whole text chooses, and one that a turn is given."""
    t = table(s, d, "conversations").select("conv_id", "turn", "text")
    given = F.concat("text", F.lit(" so the answer is "), F.substring(F.lit("ABCD"), F.col("turn").cast("int") % 4 + 1, F.lit(1)))
    return t.select("conv_id", "turn", F.coalesce(T.choice_letter(F.col("text")), F.lit("-")).alias("own"), F.coalesce(T.choice_letter(given), F.lit("-")).alias("given"))


# In SQL the last lone capital is found between other signs than letters and digits, each of which is doubled so that
# one can end a match and begin the next.
TOLD = r"""nullif(upper(regexp_extract({x}, '(?i)(?:answer|option|choice)\s*(?:is|:)?\s*([A-Z])', 1)), '')"""
MORE = [r"""nullif(upper(regexp_extract({x}, '(?i)([A-Z])\s*(?:is\s*(?:the)?\s*correct)', 1)), '')""", r"""nullif(upper(regexp_extract({x}, '(?i)final\s*(?:answer|option)\s*(?:is|:)?\s*([A-Z])', 1)), '')"""]
ALONE = r"""list_filter(regexp_extract_all(' ' || regexp_replace({x}, '([^\pL\pN_])', '  ', 'g') || ' ', ' ([A-Z]) ', 1), lambda c: c BETWEEN 'A' AND 'H')[-1]"""


def choice_sql(x: str) -> str:
    told = [f"CASE WHEN {p} BETWEEN 'A' AND 'H' THEN {p} END" for p in (q.replace("{x}", x) for q in (TOLD, *MORE))]
    return f"coalesce({', '.join(told)}, {ALONE.replace('{x}', x)}, '-')"


def lines(s, d):
    """What follows the last "Answer:" of a whole turn, else its last box."""
    added = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("\nAnswer: 0\nanswer :  "), F.col("conv_id").cast("string"))).when(F.col("turn") % 3 == 1, F.concat(F.lit(" \\boxed{"), F.col("turn").cast("string"), F.lit("}"))).otherwise("")
    x = F.concat("text", added)
    boxed = F.regexp_extract(x, r"\\boxed\{([^{}]*)\}(?!.*\\boxed)", 1)
    return table(s, d, "conversations").select("conv_id", "turn", F.coalesce(T.last_answer_line(x), F.when(boxed != "", boxed), F.lit("-")).alias("answer"))


QUERIES = {
    **{name: form_query(*spec) for name, spec in FORMS.items()},
    **{name: graded_query(*spec) for name, spec in GRADED.items()},
    "fn_sympy_gate": gate, "udf_reward_batch": batch, "rw_random": coin, "fn_extract_letter": letters, "fn_answer_line": lines,
}
SQL = {
    **{name: f"SELECT doc_id, {dealt_sql([c[1] for c in cases])} AS form FROM documents" for name, (_, cases) in FORMS.items()},
    **{name: f"SELECT doc_id, {dealt_sql([c[3] for c in cases])}::DOUBLE AS reward FROM documents" for name, (_, cases) in GRADED.items()},
    "fn_sympy_gate": f"SELECT doc_id, {dealt_sql([c[1] for c in GATE])} AS allowed FROM documents",
    "udf_reward_batch": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS reward FROM documents",
    "rw_random": "SELECT 0::BIGINT AS others, true AS both",
    "fn_extract_letter": f"SELECT conv_id, turn, {choice_sql('text')} AS own, substr('ABCD', (turn % 4 + 1)::INT, 1) AS given FROM conversations",
    "fn_answer_line": r"SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN conv_id::VARCHAR WHEN 1 THEN coalesce(trim(regexp_extract_all(text, '(?i)answer\s*:\s*([^\n]+)', 1)[-1]), turn::VARCHAR) ELSE coalesce(trim(regexp_extract_all(text, '(?i)answer\s*:\s*([^\n]+)', 1)[-1]), '-') END AS answer FROM conversations",
}
