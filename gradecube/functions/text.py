"""Text, answer and JSON extraction as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"(-?\d+(?:,\d{3})*(?:\.\d+)?)"
#: Patterns of a final number, in the order they are tried; the last match of the first that matches counts.
GOLD = r"####\s*" + NUMBER
ANSWERS = [
    GOLD,
    r"(?i)(?:final\s+answer|answer)\s*(?:is|=|:)\s*\$?" + NUMBER,
    r"(?i)(?:therefore|so|thus|hence)[^.]*?(\d+(?:,\d{3})*(?:\.\d+)?)",
    r"\\boxed\{" + NUMBER + r"\}",
    r"(?:^|[^\d])" + NUMBER + r"(?:\s*\.?\s*$|[^\d])",
]
#: Marks of a line with a step of reasoning, and the least and most steps of each difficulty.
STEP_MARKS = ["=", "+", "-", "*", "/", "so", "therefore", "thus", "hence"]
DIFFICULTIES = [("easy", 1, 3), ("medium", 4, 5), ("hard", 6, None)]
#: Typographic characters and what stands for them.
PLAIN = [("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "-"), ("\u00a0", " "), ("…", "...")]
#: What an error text holds that is never or always worth another try.
NEVER_RETRY = ["max_tokens", "permission denied", "content policy", "authentication failed", "invalid request", "unauthenticated", "invalid_argument", "401", "403"]
RETRY = ["timeout", "rate limit", "429", "500", "502", "503", "504", "overloaded", "capacity", "empty response", "resource_exhausted"]


def last_match(text: Column, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1))


def number(text: Column) -> Column:
    """A number without thousands separators and currency signs, or null."""
    return F.regexp_replace(F.trim(text), "[,$]", "").try_cast("double")


def gold_answer(text: Column) -> Column:
    return number(last_match(text, GOLD))


def model_answer(text: Column) -> Column:
    return number(F.coalesce(*[last_match(text, p) for p in ANSWERS]))


def numbers_match(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    return F.coalesce(F.abs(a - b) < tolerance, F.lit(False))


def choice_letter(text: Column, letters: str = "A-D") -> Column:
    """The first valid letter of the upper-cased reply, else "?"."""
    return F.coalesce(F.nullif(F.regexp_extract(F.upper(text), f"([{letters}])", 1), F.lit("")), F.lit("?"))


def letter_cascade(text: Column) -> Column:
    """A letter of A to D: alone on the first line, in a short reply, at the end, after "answer" or "choice", else the first one."""
    t = F.upper(F.trim(text))
    line = F.trim(F.split_part(t, F.lit("\n"), F.lit(1)))
    first = lambda x, p: F.nullif(F.regexp_extract(x, p, 1), F.lit(""))
    return F.coalesce(
        F.when(F.length(line) <= 2, first(line, "^([A-D])")),
        F.when(F.length(t) <= 3, first(t, "([A-D])")),
        first(t, r"\b([A-D])\s*\.?\s*$"),
        first(t, r"(?:ANSWER|CHOICE)[:\s]+([A-D])\b"),
        first(t, "([A-D])"),
        F.lit("?"),
    )


def solution_steps(text: Column) -> Column:
    marked = F.filter(F.split(F.lower(text), "\n"), lambda x: _any_of(x, STEP_MARKS))
    return F.greatest(F.lit(1), F.size(marked)).cast("int")


def difficulty(steps: Column) -> Column:
    out = F.lit(DIFFICULTIES[-1][0])
    for name, low, high in reversed(DIFFICULTIES[:-1]):
        out = F.when(steps.between(low, high), name).otherwise(out)
    return out


def sanitized(text: Column) -> Column:
    single = [(a, b) for a, b in PLAIN if len(b) == 1]
    text = F.translate(text, "".join(a for a, _ in single), "".join(b for _, b in single))
    for a, b in PLAIN:
        if len(b) > 1:
            text = F.replace(text, F.lit(a), F.lit(b))
    return text


def without_thoughts(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<think>.*?</think>\s*", "")


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "?")


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def short_name(name: Column, alias: Column, most: int = 12) -> Column:
    return F.substring(F.coalesce(alias, name), 1, most)


def duration(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60)
    return F.when(seconds < 60, F.format_string("%.1fs", seconds)).when(seconds >= 60, F.format_string("%dm %.1fs", minutes.cast("int"), seconds - minutes * 60))


def bar(value: Column, most: float = 10.0, width: int = 25) -> Column:
    return F.repeat(F.lit("█"), (value / most * width).cast("int"))


def error_class(text: Column) -> Column:
    low = F.lower(text)
    return F.when(_any_of(low, NEVER_RETRY), "final").when(_any_of(low, RETRY), "retry").otherwise("other")


def _any_of(text: Column, terms: list[str]) -> Column:
    out = text.contains(terms[0])
    for t in terms[1:]:
        out = out | text.contains(t)
    return out


def extracted_json(text: Column) -> Column:
    """The first JSON value a reply holds, as variant: all of it, a fenced part, from "[" to "]", from "{" to "}"."""
    t = F.trim(text)
    fenced = F.transform(F.filter(F.split(t, "```"), lambda _, k: k > 0), lambda x: F.try_parse_json(F.regexp_replace(F.trim(x), "^(json|JSON)", "")))
    def between(left: str, right: str) -> Column:
        a, b = F.instr(t, left), F.length(t) - F.instr(F.reverse(t), right) + 1
        return F.when((a > 0) & (F.instr(t, right) > 0) & (b > a), F.try_parse_json(F.substr(t, a, b - a + 1)))

    return F.coalesce(F.try_parse_json(t), F.get(F.filter(fenced, lambda v: v.isNotNull()), F.lit(0)), between("[", "]"), between("{", "}"))


def text_colour(hex_colour: Column) -> Column:
    """Black or white, by the relative luminance of the background."""
    def channel(at: int) -> Column:
        c = F.conv(F.substring(F.ltrim(hex_colour), at, 2), 16, 10).cast("double") / 255
        return F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    light = 0.2126 * channel(2) + 0.7152 * channel(4) + 0.0722 * channel(6)
    return F.when(light < 0.5, "white").otherwise("black")


def exponent(x: Column) -> Column:
    """A number in raised digits, 2.0 as a single one."""
    return F.translate(F.when(x == 2, F.lit("2")).otherwise(x.cast("string")), "0123456789.", "⁰¹²³⁴⁵⁶⁷⁸⁹·")
