"""Text functions as Column expressions; all of them run inside Catalyst."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from briefmill.functions import fixed


def choose(c: Column, values: Mapping[str, object], default: object = None) -> Column:
    """The value that a small fixed table has for c."""
    out = None
    for k, v in values.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space become one blank, those at the ends go."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c worked out once, however often f reads it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def canonical_number(c: Column) -> Column:
    """An amount as the digits of its whole part; null where c isn't a number with currency, separators or a multiplier."""

    def number(t: Column) -> Column:
        multiple = choose(F.lower(F.regexp_extract(t, f"(?i){fixed.MULTIPLE}", 2)), fixed.MULTIPLIERS)
        scaled = F.regexp_extract(t, f"(?i){fixed.MULTIPLE}", 1).try_cast("double") * multiple
        plain = F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), t.try_cast("double"))
        value = F.when(t.rlike(f"(?i){fixed.MULTIPLE}"), scaled).otherwise(plain)
        whole = let(value, lambda v: F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)))
        return F.when(t != "", whole.cast("string"))

    return let(strip(F.replace(F.regexp_replace(c, f"(?i){fixed.CURRENCY}", ""), F.lit(","), F.lit(""))), number)


def words_to_digits(c: Column) -> Column:
    for word, digits in fixed.NUMBER_WORDS.items():
        c = F.regexp_replace(c, rf"\b{word}\b", digits)
    return c


def normal_form(c: Column) -> Column:
    """What two values must share not to be in conflict."""
    v = F.regexp_replace(strip(F.lower(c)), r"\(\d+\)", "")
    v = words_to_digits(v)
    v = F.regexp_replace(F.regexp_replace(v, r"^state of\s+", ""), r"\s+state$", "")
    return let(squeeze(v), lambda v: F.coalesce(canonical_number(v), v))


def _first(c: Column, pattern: str) -> Column:
    """c without the first match of an anchored pattern."""
    return F.regexp_replace(c, pattern, "")


def trim_clause(c: Column) -> Column:
    """A clause without the number and heading of its section, and without a number left at its end."""
    t0 = strip(c)
    t1 = _first(t0, fixed.LEAD_NUMBER)
    t2 = _first(t1, fixed.LEAD_KEYWORD)
    number, keyword = t0.rlike(fixed.LEAD_NUMBER), t1.rlike(fixed.LEAD_KEYWORD)
    t3 = F.when(number | keyword, _first(t2, fixed.LEAD_CAPITALS)).otherwise(t2)
    t4 = F.when(keyword, _first(t3, fixed.LEAD_TITLE)).otherwise(t3)
    t5 = strip(_first(t4, fixed.TRAIL_NUMBER))
    return F.when(c.isNull() | (c == ""), c).otherwise(F.when(t5 == "", t0).otherwise(t5))


def parties(c: Column) -> Column:
    """Names of organisations in order of first appearance."""
    names = F.regexp_extract_all(c, F.lit(fixed.PARTY), 1)
    clean = F.transform(names, lambda x: F.regexp_replace(strip(x), r"[,;.]+$", ""))
    found = F.filter(F.array_distinct(clean), lambda x: F.length(x) >= 4)
    return F.when(c.isNull() | (c == ""), F.array().cast("array<string>")).otherwise(found)


def strip_fence(c: Column) -> Column:
    """A reply without the fence around it; a fence goes only if there are more than two lines."""
    t = strip(c)
    lines = F.split(t, "\n")
    inner = F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
    return F.when(t.startswith("```") & (F.size(lines) > 2), inner).otherwise(t)


def strip_fence_loose(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(strip(c), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def merge_headings(c: Column, most: int = fixed.HEADING) -> Column:
    """Paragraphs (parted by blank lines) of at most `most` characters are joined to the next longer one; short ones at
    the end go to the last paragraph."""
    parts = F.filter(F.split(c, "\n\n", -1), lambda p: F.length(strip(p)) > 0)
    start = F.struct(F.array().cast("array<string>").alias("short"), F.array().cast("array<string>").alias("done"))

    def step(a: Column, p: Column) -> Column:
        clean = strip(p)
        longer = F.array_join(F.concat(a["short"], F.array(clean)), "\n\n")
        empty = F.array().cast("array<string>")
        return F.when(F.length(clean) <= most, F.struct(F.concat(a["short"], F.array(clean)).alias("short"), a["done"].alias("done"))).otherwise(
            F.struct(empty.alias("short"), F.concat(a["done"], F.array(longer)).alias("done"))
        )

    def finish(a: Column) -> Column:
        rest, last = F.array_join(a["short"], "\n\n"), F.size(a["done"])
        joined = F.concat(F.slice(a["done"], F.lit(1), F.greatest(last - 1, F.lit(0))), F.array(F.concat(F.element_at(a["done"], F.greatest(last, F.lit(1))), F.lit("\n\n"), rest)))
        done = F.when(F.size(a["short"]) == 0, a["done"]).when(last == 0, F.array(rest)).otherwise(joined)
        return F.array_join(done, "\n\n")

    return F.when(F.size(parts) == 0, strip(c)).otherwise(F.aggregate(parts, start, step, finish))


def answer_tokens(c: Column) -> Column:
    """Words of an answer: lower case, no ASCII punctuation."""
    t = squeeze(F.regexp_replace(F.lower(c), r"[\p{Punct}]", ""))
    return F.filter(F.split(t, " "), lambda w: w != "")


def answer_text(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(c), r"[\p{Punct}]", ""))


def token_f1(prediction: Column, truth: Column) -> Column:
    """2PR/(P+R) over the two bags of words; 0 without overlap."""
    p, t = answer_tokens(prediction), answer_tokens(truth)
    count = lambda bag, w: F.size(F.filter(bag, lambda x: x == w))
    common = F.aggregate(
        F.array_intersect(p, t), F.lit(0), lambda a, w: a + F.least(count(p, w), count(t, w))
    ).cast("double")
    precision, recall = common / F.nullif(F.size(p), F.lit(0)), common / F.nullif(F.size(t), F.lit(0))
    return F.coalesce(F.when(common > 0, 2 * precision * recall / (precision + recall)), F.lit(0.0))


def contains_answer(prediction: Column, truth: Column) -> Column:
    return F.contains(answer_text(prediction), answer_text(truth))


def is_hit(text: Column, truth: Column) -> Column:
    return F.contains(F.lower(text), F.lower(strip(truth)))


def pipe_safe(c: Column, most: int) -> Column:
    """The first characters of c with the table's bar escaped after the cut."""
    return F.replace(F.substring(c, 1, most), F.lit("|"), F.lit("\\|"))


def file_name(title: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(title, r"[^\w\s-]", ""), r"\s+", "_")
    return F.concat(F.substring(plain, 1, 80), F.lit(".txt"))


def words(c: Column) -> Column:
    """Tokens where no tokenizer is given: runs of anything but ASCII white space."""
    return F.array_remove(F.split(c, r"[ \t\n\x0B\f\r]+"), "")


def with_defaults(c: Column, default: Column) -> Column:
    """A payload's field, or the default where it is null."""
    return F.coalesce(c, default)


def cut(c: Column, most: int) -> Column:
    """The first characters of a text, as reports and answer tables show it."""
    return F.substring(c, 1, most)
