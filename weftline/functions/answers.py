"""Normal forms of short mathematical answers, and when two of them count as equal.

Three forms are kept apart, as the rewards that use them differ: `hendrycks` compares texts of LaTeX, `plain` turns
LaTeX into an expression that `equal` evaluates, and `integer_form` serves answers that are whole numbers. Rules are
tables that one loop applies; expressions are read by a small recursive parser and compared by value.
"""

from __future__ import annotations

import re
from decimal import Decimal, InvalidOperation, localcontext

# The rules of the first form in their order. Texts are literal, patterns are marked by a leading "re:".
HENDRYCKS = [
    ("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""),
    ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""), ("re:units", ""), ("\\%", ""), (" .", " 0."), ("{.", "{0."),
    ("re:^\\.", "0."), ("re:name", ""), ("re:sqrt", ""), (" ", ""), ("re:frac", ""),
]

# Replacements and removals of the whole-number form, in their order.
SUBSTITUTIONS = [
    ("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"),
    (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}"),
]
REMOVED = [
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet",
    "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students",
    "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}",
    "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots", "<|im_end|>", "<|endoftext|>",
]

# Units that the plain form drops, and words for powers of ten.
UNITS = [
    "degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day", "week", "month", "year", "foot",
    "feet", "inch", "yard",
]
POWERS = {"million": "*10^6", "billion": "*10^9", "trillion": "*10^12"}

# What commands of LaTeX stand for in an expression.
COMMANDS = {
    "cdot": "*", "times": "*", "div": "/", "pi": "pi", "infty": "inf", "cup": "U", "left": "", "right": "", "displaystyle": "",
    "quad": " ", "qquad": " ", "pm": "±", "le": "≤", "leq": "≤", "ge": "≥", "geq": "≥", "ne": "≠", "neq": "≠", "in": "∈",
}

WRAPPED = re.compile(r"^\\text\{(.+?)\}$")
GROUPED = re.compile(r"(\d),(\d\d\d)(?=$|\D)")


class Odd(ValueError):
    """A text that a rule can't read; it is then left as it was."""


def boxed(text: str, marks: tuple[str, ...] = ("\\boxed", "\\fbox")) -> str | None:
    """The last box with its mark, up to the brace that closes it: by the first mark that occurs; None if it stays open."""
    at = next((p for p in map(text.rfind, marks) if p >= 0), -1)
    depth = 0
    for m in re.finditer(r"[{}]", text[at:]) if at >= 0 else ():
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return text[at : at + m.end()]
    return None


def inside(box: str | None) -> str | None:
    r"""What \boxed{...} holds; None for anything else."""
    return box[7:-1] if box and box.startswith("\\boxed{") and box.endswith("}") else None


def _units(x: str) -> str:
    if x.count("\\text{ ") > 1:
        raise Odd(x)
    return x.partition("\\text{ ")[0]


def _name(x: str) -> str:
    """Without a name of one or two characters before the only equals sign."""
    name, _, value = x.partition("=")
    return value if x.count("=") == 1 and len(name) <= 2 else x


def _sqrt(x: str) -> str:
    if x.endswith("\\sqrt") or "\\sqrt\\sqrt" in x:
        raise Odd(x)
    return re.sub(r"\\sqrt([^{])", r"\\sqrt{\1}", x, flags=re.S)


def _frac(x: str) -> str:
    """Braces around what \\frac takes; a \\frac that ends a text is odd, one with a single argument stops the rule."""
    if any(not p for p in x.split("\\frac")[1:]):
        raise Odd(x)
    if any(len(p) == 1 and p != "{" for p in x.split("\\frac")[1:]):
        return x
    return re.sub(r"\\frac([^{])(?:(\{)|(.))", lambda m: f"\\frac{{{m[1]}}}" + (m[2] or f"{{{m[3]}}}"), x, flags=re.S)


STEPS = {"units": _units, "name": _name, "sqrt": _sqrt, "frac": _frac}


def hendrycks(answer: str | None) -> str | None:
    """The form of competition data sets: LaTeX without spacing, units and signs, with braces around arguments."""
    if answer is None:
        return None
    answer = answer.strip()
    if m := WRAPPED.search(answer):
        answer = m[1].strip()
    x = answer
    try:
        for rule, to in HENDRYCKS:
            if rule[3:] in STEPS and rule.startswith("re:"):
                x = STEPS[rule[3:]](x)
            else:
                x = re.sub(rule[3:], to, x) if rule.startswith("re:") else x.replace(rule, to)
    except Odd:
        return answer
    if x == "0.5":
        return "\\frac{1}{2}"
    m = re.fullmatch(r"(0|-?[1-9]\d*)/(0|-?[1-9]\d*)", x)
    return f"\\frac{{{m[1]}}}{{{m[2]}}}" if m else x


def integer_form(answer: str) -> str:
    """The form for answers that are whole numbers: what follows the last equals sign, without words, units and marks."""
    x = str(answer).rpartition("=")[2]
    for old, new in [*SUBSTITUTIONS, *((r, "") for r in REMOVED)]:
        x = x.replace(old, new)
    # Fixed patterns: the text between dollar signs, the arguments of text commands, short fractions and roots.
    for pattern, new in (
        (r"(.*?)(\$)(.*?)(\$)(.*)", r"$\3$"), (r"(\\text\{)(.*?)(\})", r"\2"), (r"(\\textbf\{)(.*?)(\})", r"\2"), (r"(\\overline\{)(.*?)(\})", r"\2"),
        (r"(\\boxed\{)(.*)(\})", r"\2"), (r"(frac)([^{])(.)", r"frac{\2}{\3}"), (r"(sqrt)([^{])", r"sqrt{\2}"),
    ):
        x = re.sub(pattern, new, x)
    x = x.replace("$", "")
    return (x.replace(",", "") if x.replace(",", "").isdigit() else x).strip()


def ungrouped(x: str) -> str:
    """Commas between groups of three digits go."""
    while (y := GROUPED.sub(r"\1\2", x)) != x:
        x = y
    return x


def whole(x: str) -> int | None:
    """The whole number that a text is close to, within 1e-7."""
    try:
        v = float(ungrouped(x))
        return round(v) if abs(v - round(v)) <= 1e-7 else None
    except (ValueError, OverflowError):
        return None


def from_latex(x: str) -> str:
    """LaTeX as an expression: fractions a/b, roots sqrt(a), commands by COMMANDS, other commands by their names' end."""
    out, i = [], 0

    def group() -> str:
        nonlocal i
        while i < len(x) and x[i] == " ":
            i += 1
        if i < len(x) and x[i] == "{":
            depth, at = 0, i
            while i < len(x):
                depth += (x[i] == "{") - (x[i] == "}")
                i += 1
                if not depth:
                    return from_latex(x[at + 1 : i - 1])
            raise Odd(x)
        if i < len(x) and x[i] == "\\":
            m = re.match(r"\\([A-Za-z]+|.)", x[i:])
            i += m.end() if m else 1
            return COMMANDS.get(m[1], "") if m else ""
        i += 1
        return x[i - 1 : i]

    while i < len(x):
        if x[i] != "\\":
            out.append(x[i])
            i += 1
            continue
        m = re.match(r"\\([A-Za-z]+|.)", x[i:], re.S)
        if not m:
            break
        i += m.end()
        name = m[1]
        if name in ("frac", "tfrac", "dfrac"):
            out.append(f" {group()}/{group()}")
        elif name == "sqrt":
            out.append(f"sqrt({group()})")
        elif name in ("text", "mathrm", "textbf", "mbox", "mathbf", "operatorname"):
            out.append(group())
        elif name.isalpha():
            out.append(COMMANDS.get(name, ""))
        else:
            out.append({"\\": "\n", ",": " ", ";": " ", ":": " ", "!": ""}.get(name, name))
    return "".join(out).strip()


def plain(x: str | None) -> str | None:
    """An expression without units, currency, grouping and case; a whole number is written as one."""
    if x is None:
        return None
    if m := WRAPPED.search(x):
        x = m[1]
    x = x.replace("\\%", "%").replace("\\$", "$").replace("$", "").replace("%", "").replace(" or ", " , ").replace(" and ", " , ")
    for word, power in POWERS.items():
        x = x.replace(word, power)
    for unit in UNITS:
        x = re.sub(rf"{unit}(es)?(s)? *(\^[0-9]+)?", "", x)
    x = re.sub(r"\^ *\\circ", "", x)
    if x.startswith("{") and x.endswith("}"):
        x = x[1:-1]
    x = re.sub(r",\\! *", "", x)
    try:
        if abs((v := float(x)) - round(v)) <= 1e-7:
            x = str(round(v))
    except (ValueError, OverflowError):
        pass
    if "\\" in x:
        try:
            x = from_latex(x)
        except Odd:
            pass
    x = re.sub(r"- *", "-", x)
    x = re.sub(r"([0-9]) +([0-9])", r"\1+\2", x)  # a mixed number
    x = re.sub(r"[ {}]", "", x).lower()
    n = whole(x)
    return x if n is None else str(int(float(x.replace(",", ""))))


def parts(x: str) -> list[str]:
    """The elements of a tuple or an interval; anything else is one element."""
    x = ungrouped(x)
    if not x:
        return []
    if len(x) > 2 and x[0] in "()[]" and x[-1] in "()[]" and not set(x[1:-1]) & set("()[]"):
        return [p.strip() for p in x[1:-1].split(",")]
    return [x]


def letters(x: str) -> int:
    """Different letters, those of sqrt and frac aside."""
    return len({c for c in x.replace("sqrt", "").replace("frac", "") if c.isalpha()})


def may_evaluate(x: str) -> bool:
    """At most two letters, no power in brackets, no tower of powers and no power of two digits or more."""
    return letters(x) <= 2 and not re.search(r"\^\{|\^\(|\^[0-9]+\^|\^[0-9][0-9]+", x)


TOKEN = re.compile(r"\s*(?:(\d+\.?\d*|\.\d+)|(sqrt)|(pi)|([a-z])|(\*\*|[-+*/^()!]))")


class Value:
    """A parser that evaluates: sums, products (also without a sign between), powers and roots, at given letters."""

    def __init__(self, text: str, at: dict[str, Decimal]):
        self.tokens, self.at, self.i = [], at, 0
        place = 0
        while place < len(text.rstrip()):
            m = TOKEN.match(text, place)
            if not m:
                raise Odd(text)
            self.tokens.append(m)
            place = m.end()

    def next(self, *signs: str) -> str | None:
        """Takes the next token if it is one of the signs."""
        if self.i < len(self.tokens) and self.tokens[self.i][5] in signs:
            self.i += 1
            return self.tokens[self.i - 1][5]
        return None

    def result(self) -> Decimal:
        v = self.sum()
        if self.i < len(self.tokens):
            raise Odd("more than an expression")
        return v

    def sum(self) -> Decimal:
        v = self.product()
        while sign := self.next("+", "-"):
            v = v + self.product() if sign == "+" else v - self.product()
        return v

    def product(self) -> Decimal:
        v = self.signed()
        while True:
            sign = self.next("*", "/")
            if not sign and (self.i >= len(self.tokens) or self.tokens[self.i][5] not in (None, "(")):
                return v
            w = self.signed() if sign else self.power()
            v = v / w if sign == "/" else v * w

    def signed(self) -> Decimal:
        if sign := self.next("+", "-"):
            return -self.signed() if sign == "-" else self.signed()
        return self.power()

    def power(self) -> Decimal:
        v = self.atom()
        if self.next("^", "**"):
            e = self.signed()
            if v < 0 and e != e.to_integral_value() or abs(e) > 10_000:
                raise Odd("power")
            return v**e
        return v

    def atom(self) -> Decimal:
        if self.next("("):
            v = self.sum()
            if not self.next(")"):
                raise Odd("bracket")
            return self.factorial(v)
        if self.i >= len(self.tokens) or self.tokens[self.i][5]:
            raise Odd("nothing")
        number, root, pi, letter, _ = self.tokens[self.i].groups()
        self.i += 1
        if root:
            return self.atom_after_root()
        return self.factorial(Decimal(number) if number else self.at["pi"] if pi else self.at[letter])

    def atom_after_root(self) -> Decimal:
        v = self.atom()
        if v < 0:
            raise Odd("root")
        return v.sqrt()

    def factorial(self, v: Decimal) -> Decimal:
        if self.next("!"):
            if v < 0 or v != v.to_integral_value() or v > 1000:
                raise Odd("factorial")
            out = Decimal(1)
            for k in range(2, int(v) + 1):
                out *= k
            return out
        return v


PI = Decimal("3.14159265358979323846264338327950288419716939937510582097494459")


def equal_values(a: str, b: str) -> bool:
    """Whether a - b is zero, to 30 digits of 60, at three places of its letters; an expression that can't be read is not equal."""
    if not may_evaluate(f"({a})-({b})"):
        return False
    try:
        with localcontext() as c:
            c.prec = 60
            for k in (7, 11, 13):
                at = {x: (Decimal(k) * (i + 3)).sqrt() for i, x in enumerate("abcdefghijklmnopqrstuvwxyz")} | {"pi": PI}
                v, w = Value(a, at).result(), Value(b, at).result()
                if abs(v - w) > Decimal("1e-30") * max(abs(v), abs(w), Decimal(1)):
                    return False
        return True
    except (Odd, InvalidOperation, ArithmeticError, KeyError, RecursionError):
        return False


FRACTION = re.compile(r"^-?[0-9]+.?/0*[1-9][0-9]*.?$")


def equal(given: str | None, truth: str | None) -> bool:
    """By plain forms: the same text, or elements of equal value between equal brackets. A fraction must be the same
    fraction, reduced or not, and a whole number is equal to a whole number alone."""
    a, b = plain(given), plain(truth)
    if b is None or a is None:
        return False
    if a == b:
        return True
    if not a:
        return False
    x, y = parts(a), parts(b)
    if len(x) != len(y) or len(y) > 1 and (a[0], a[-1]) != (b[0], b[-1]):
        return False

    def one(p: str, q: str) -> bool:
        if FRACTION.search(p) and FRACTION.search(q):
            return p == q
        return (whole(p) is None) == (whole(q) is None) and equal_values(q, p)

    return bool(y) and all(one(p, q) for p, q in zip(x, y))


def right(given: str | None, truth: str | None) -> bool:
    """Equal by either form."""
    return given is not None and (hendrycks(given) == hendrycks(truth) or equal(given, truth))
