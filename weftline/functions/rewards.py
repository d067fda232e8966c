"""Rule-based rewards of answers, by name and as hooks that a caller registers."""

from __future__ import annotations

import random
import re
import string
from collections import Counter
from collections.abc import Callable
from importlib import import_module

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from weftline.functions import answers
from weftline.functions.structure import canonical


def last_boxed(text: str | None) -> str | None:
    r"""What the last \boxed{...} holds; None if it stays open, if there is none, or if \fbox is the only box."""
    return answers.inside(answers.boxed(text or ""))


def given_truth(truth) -> str | None:
    r"""The truth as a text, or what its \boxed{...} holds."""
    text = str(truth)
    return last_boxed(text) if "\\boxed" in text else text


def math_reward(response: str | None, truth) -> float:
    """1 if the last boxed answer is right."""
    if not truth or response is None:
        return 0.0
    return float(answers.right(last_boxed(response), given_truth(truth)))


def thought_reward(response: str | None, truth) -> float:
    """As math_reward on what follows the last </think>, else the first ###Response; 0 without either."""
    text = response or ""
    if "</think>" in text:
        text = text.rpartition("</think>")[2]
    elif "###Response" in text:
        text = text.split("###Response")[1]
    else:
        return 0.0
    truth = None if truth is None or truth == "" else given_truth(truth)
    return 0.0 if truth is None else float(answers.right(last_boxed(text), truth))


# How an answer line is told, how much of the end is read, and the answer where there is none.
ANSWER_LINE, TAIL, BOX_TAIL, NO_ANSWER = r"(?i)Answer\s*:\s*([^\n]+)", 300, 100, "[INVALID]"


def signed_reward(response: str, truth: str, strict_box: bool = False) -> dict:
    """score 1 or -1, acc and pred, by the last answer line (or, strictly, the last box) near the end.

    The truth has to be a number; one that isn't is an error.
    """
    end = response[-TAIL:]
    if strict_box:
        pred = answers.inside(answers.boxed(end[-BOX_TAIL:], ("\\boxed{",)))
        ok = pred == truth
    else:
        pred = answers.integer_form((re.findall(ANSWER_LINE, end) or [NO_ANSWER])[-1])
        ok = pred == str(int(float(answers.integer_form(truth))))
    return {"score": 1.0 if ok else -1.0, "acc": ok, "pred": pred}


# Fixed value: a line of its own, perhaps in bold.
LONE_LINE = r"(?im)^\s*\*{0,2}Answer\s*:\s*(.+?)\s*\*{0,2}\s*$"


def line_reward(response: str | None, truth) -> float:
    """1 if the last line "Answer: ...", or else the last box, is right. Verifying beyond the forms of `answers` is a hook."""
    found = re.findall(LONE_LINE, response or "")
    pred = found[-1].strip() if found else last_boxed(response)
    boxed = last_boxed(pred) if pred else None
    return float(pred is not None and answers.right((boxed or pred).strip("$"), str(truth).strip("$")))


def f1_words(text: str) -> list[str]:
    """Lower-case words without ASCII punctuation and English articles."""
    return re.sub(r"\b(a|an|the)\b", " ", text.lower().translate(str.maketrans("", "", string.punctuation))).split()


def f1_reward(response: str | None, truth: str) -> dict:
    """F1, precision and recall of words as multisets; yes, no and noanswer match only themselves."""
    a, b = f1_words(response or ""), f1_words(truth)
    n = sum((Counter(a) & Counter(b)).values())
    if not n or a != b and {" ".join(a), " ".join(b)} & {"yes", "no", "noanswer"}:
        return {"f1": 0.0, "precision": 0.0, "recall": 0.0}
    p, r = n / len(a), n / len(b)
    return {"f1": 2 * p * r / (p + r), "precision": p, "recall": r}


# How a choice is told, in order; without any of them the last capital that stands alone counts.
CHOICES = [r"(?:answer|option|choice)\s*(?:is|:)?\s*([A-Z])", r"([A-Z])\s*(?:is\s*(?:the)?\s*correct)", r"final\s*(?:answer|option)\s*(?:is|:)?\s*([A-Z])"]
LETTERS = "ABCDEFGH"


def without_thought(text: str | None) -> str:
    return (text or "").rpartition("</think>")[2]


def choice(response: str | None, letters) -> str | None:
    """The letter that a response chooses, among `letters`: a pattern whose first match names another is passed over."""
    text = without_thought(response)
    told = (m[1].upper() for m in (re.search(p, text, re.I) for p in CHOICES) if m)
    alone = reversed(re.findall(r"\b([A-Z])\b", text))
    return next((x for x in [*told, *alone] if x in set(letters)), None)


def simple(text) -> str:
    """Lower-case ASCII letters and digits, with one space for anything else between them."""
    return re.sub(r"[^a-z0-9]+", " ", str(text).lower()).strip()


def choice_reward(response: str | None, label, metadata: dict | None = None) -> float:
    """1 if the chosen letter is the correct one; where either is unknown, if a correct text is in the response.

    The correct letter is metadata's, the label itself if it is a letter, the label's place if it is a number, or that
    of the choice whose text the label is.
    """
    if response is None:
        return 0.0
    meta = metadata or {}
    options = meta.get("choices")
    options = None if options is None else list(options.values() if isinstance(options, dict) else options)
    letters = [str(x).upper() for x in meta.get("valid_letters") or ()] or list(string.ascii_uppercase[: len(options)] if options else LETTERS)
    named = meta.get("correct_letter")
    correct = (named.strip().upper() or None) if isinstance(named, str) else None
    text = label.strip() if isinstance(label, str) else None
    right_texts = []
    if text is not None:
        if not correct and len(text) == 1 and text.upper() in letters:
            correct = text.upper()
    elif isinstance(label, int | float) and 0 <= int(label) < len(letters):
        correct = letters[int(label)]
    if not correct and options and text:
        place = next((i for i, x in enumerate(options) if simple(x) == simple(text)), None)
        if place is not None:
            correct = letters[place]
            right_texts.append(options[place])
    picked = choice(response, letters)
    if picked and correct:
        return float(picked == correct)
    if correct and options and correct in letters and letters.index(correct) < len(options):
        right_texts.append(options[letters.index(correct)])
    right_texts += [meta[k] for k in ("correct_answer", "answer_text") if meta.get(k)]
    right_texts += [text] if text else []
    told = simple(without_thought(response))
    if any(simple(x) and simple(x) in told for x in right_texts if x):
        return 1.0
    return float(bool(picked and not correct and text and picked == text.upper()))


def trajectory_reward(calls: list[dict], expected: list[dict], executed: bool, passed: bool, weights: tuple[float, float, float, float] = (0.25, 0.20, 0.10, 0.45)) -> float:
    """Weighted sum of the share of expected calls made, the first call, execution and the final state."""
    key = [canonical(c) for c in calls]
    want = [canonical(c) for c in expected]
    part = sum((Counter(key) & Counter(want)).values()) / len(want) if want else float(not key)
    first = float(bool(want) and key[:1] == want[:1] or not want and not key)
    return sum(w * v for w, v in zip(weights, (part, first, float(executed), float(passed))))


#: Rewards by the name that a row's metadata or a default gives: (response, label, metadata) -> number.
BY_NAME: dict[str, Callable] = {
    "math": lambda r, t, m: math_reward(r, t),
    "deepscaler": lambda r, t, m: thought_reward(r, t),
    "dapo": lambda r, t, m: signed_reward(r or "", t)["score"],
    "f1": lambda r, t, m: f1_reward(r, t)["f1"],
    "gpqa": lambda r, t, m: choice_reward(r, t, m),
    "random": lambda r, t, m: float(random.randint(0, 1)),
}


def by_type(kind: str | None, response: str | None, truth, metadata: dict | None = None, hooks: dict[str, Callable] | None = None) -> float:
    """The reward that a row's type names; boxed_ before it takes the boxed answer first (none: an empty text).

    hooks has further names, such as ones that call other services, and may replace the names here.
    """
    kind = (kind or "").strip()
    if kind.startswith("boxed_"):
        kind, response = kind[len("boxed_") :], last_boxed(response) or ""
    rule = {**BY_NAME, **(hooks or {})}.get(kind)
    if rule is None:
        raise ValueError(f"no reward is named {kind!r}")
    return float(rule(response, truth, metadata))


def load_hook(path: str) -> Callable:
    """The function that "package.module.name" or "package.module:name" names."""
    module, _, name = path.replace(":", ".").rpartition(".")
    return getattr(import_module(module), name)


@F.pandas_udf(DoubleType())
def py_reward(kind: pd.Series, response: pd.Series, truth: pd.Series) -> pd.Series:
    return pd.Series([by_type(k, r, t) for k, r, t in zip(kind, response, truth)], dtype=float)


def reward_column(default: str, hooks: dict[str, str] | None = None):
    """A pandas UDF (metadata as JSON or null, response, label): the type is metadata's rm_type, else the default.

    hooks: paths of functions (response, label, metadata) by name; they are loaded where the UDF runs.
    """
    paths = hooks or {}

    @F.pandas_udf(DoubleType())
    def graded(metadata: pd.Series, response: pd.Series, label: pd.Series) -> pd.Series:
        import json

        loaded = {k: load_hook(p) for k, p in paths.items()}
        out = []
        for m, r, t in zip(metadata, response, label):
            meta = json.loads(m) if m else {}
            meta = meta if isinstance(meta, dict) else {}
            out.append(by_type(meta.get("rm_type") or default, r, t, meta, loaded))
        return pd.Series(out, dtype=float)

    return graded


def batch_reward_column(path: str):
    """A pandas UDF (response, label) of one function that grades a whole batch at once."""

    @F.pandas_udf(DoubleType())
    def graded(response: pd.Series, label: pd.Series) -> pd.Series:
        return pd.Series(load_hook(path)(response.tolist(), label.tolist()), dtype=float)

    return graded
