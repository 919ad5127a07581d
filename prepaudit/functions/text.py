"""Text as columns: lines, n-grams, rule tags and pattern extraction."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: line breaks and white space of any script, as character classes
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

WHITE = r"[\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def strip(column: Column) -> Column:
    """Remove white space of any kind on both sides (``trim`` removes blanks only).

    The trailing pattern may only start where a run starts, so a long run inside the text is read once.
    """
    return F.regexp_replace(F.regexp_replace(column, f"^{WHITE}+", ""), rf"(?<!{WHITE}){WHITE}++\z", "")


def lines(text: Column) -> Column:
    """Lines without their breaks; a final break opens no further line, empty text has none."""
    ended = F.regexp_replace(text, rf"(?:{LINE_BREAK})\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(ended, LINE_BREAK, -1))


def after_first(items: Column) -> Column:
    """All items but the first."""
    return F.filter(items, lambda item, i: i > 0)


def words(text: Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(text, f"{WHITE}+"), lambda w: w != "")


def ngrams(text: Column, n: int) -> Column:
    """All character n-grams of the whole text, repeats kept, in one scan of it."""
    pattern = "(?s)." if n == 1 else rf"(?s)(?=(.{{{n}}}))."
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0 if n == 1 else 1))


def strip_comment_lines(text: Column, mark: str = "#") -> Column:
    """Drop the lines whose first visible character is ``mark``."""
    return F.array_join(F.filter(lines(text), lambda line: ~line.rlike(rf"^{WHITE}*\Q{mark}\E")), "\n")


def rule_tags(text: Column, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Tags, in rule order, of the rules whose substrings all occur."""
    found = []
    for tag, needed in rules:
        held = F.lit(True)
        for part in needed:
            held = held & F.contains(text, F.lit(part))
        found.append(F.when(held, F.lit(tag)))
    return F.array_compact(F.array(*found))


def first_match(text: Column, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Label of the first rule one of whose substrings occurs, else null."""
    found = F.lit(None).cast("string")
    for label, any_of in reversed(rules):
        held = F.lit(False)
        for part in any_of:
            held = held | F.contains(text, F.lit(part))
        found = F.when(held, F.lit(label)).otherwise(found)
    return found


def not_in(left: Column, right: Column) -> Column:
    """Items of ``left`` absent from ``right``, order and repeats kept."""
    return F.filter(left, lambda item: ~F.array_contains(right, item))


def number_after(text: Column, pattern: str) -> Column:
    """The first group of the first match as a number, else null."""
    return F.regexp_extract(text, pattern, 1).try_cast("double")


def fill_template(template: str, values: Mapping[str, Column]) -> Column:
    """Replace every marker of the template by a column."""
    text = F.lit(template)
    for marker, value in values.items():
        text = F.replace(text, F.lit(marker), value)
    return text


def token_estimate(text: Column) -> Column:
    """One and a half tokens per word, rounded down."""
    return F.floor(F.size(words(text)) * F.lit(1.5)).cast("bigint")


def fenced_block(text: Column, language: str = "python") -> Column:
    """Content of the first fenced block of a language, else null."""
    return F.nullif(F.regexp_extract(text, rf"(?s)```{language}\n(.+?)```", 1), F.lit(""))


def strip_fences(text: Column, language: str = "python") -> Column:
    """Remove the fence marks and keep everything else."""
    return F.replace(F.replace(text, F.lit(f"```{language}"), F.lit("")), F.lit("```"), F.lit(""))


def line_titles(text: Column) -> Column:
    """Text before the first colon of every line of the stripped text; one line without a colon, blank ones included, empties the list."""
    rows = F.split(strip(text), "\n", -1)
    titles = F.transform(rows, lambda line: strip(F.substring_index(line, ":", 1)))
    broken = F.exists(rows, lambda line: ~F.contains(line, F.lit(":")))
    return F.when(broken, F.array().cast("array<string>")).otherwise(titles)


def sanitise_label(label: Column) -> Column:
    """A label as a metric key: relations spelled out, anything unsafe an underscore."""
    # fixed values: relation spellings
    for sign, spelling in ((">=", "ge_"), (">", "gt_"), ("<=", "le_"), ("<", "lt_")):
        label = F.replace(label, F.lit(sign), F.lit(spelling))
    # fixed values: the clean-up patterns
    label = F.regexp_replace(label, r"\s+", "_")
    label = F.regexp_replace(label, r"[^A-Za-z0-9_\-./ ]", "_")
    label = F.regexp_replace(label, "_+", "_")
    return F.regexp_replace(label, "^_|_$", "")
