"""Cleaning of scores, names and ids, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ids whose scores are shares of 1, organisations before a slash, and company names after a model, in the order in which they are stripped.
SHARES_OF_ONE = ("FACTS", "GPQA", "HMMT (Feb 2025)", "HumanEval", "IFEval", "SuperGPQA", "SWE-bench (Verified)")
PREFIXES = ("openai", "google", "anthropic", "alibaba", "fireworks", "grok", "kimi", "minimax", "mistralai", "cohere", "ai21labs", "together", "zai")
SUFFIXES = ("Alibaba Cloud / Qwen Team", "NewZhipu AI", "NewMiniMax", "Moonshot AI", "Mistral AI", "Zhipu AI", "DeepSeek", "Xiaomi", "NVIDIA", "OpenAI", "Anthropic", "Google", "MiniMax", "Amazon", "xAI", "Meta", "IBM")
CATEGORY_COLUMNS = {"Coding": "elo_coding", "Creative Writing": "elo_creative_writing", "Expert": "elo_expert", "Hard Prompts": "elo_hard_prompts", "Instruction Following": "elo_instruction_following", "Math": "elo_math"}
COMPLEXITY = {"Applying": 1, "Analyzing": 2, "Evaluating": 3, "Creating": 4}
ABBREVIATIONS = {"Instruction Following": "IF", "Hard Prompts": "HP", "Creative Writing": "CW"}
FIRST_DAY = "2021-01-01"

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def to_number(text: Column) -> Column:
    """A plain decimal as double, null for anything else."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(_NUMBER), trimmed.try_cast("double"))


def parse_score(text: Column) -> Column:
    """A score without its "±" part and "%"; null for blanks and words."""
    return to_number(F.replace(F.regexp_replace(F.trim(text), "±.*$", ""), F.lit("%"), F.lit("")))


def parse_preliminary_score(text: Column) -> Column:
    """As parse_score, for boards that add "Preliminary" to a score."""
    return to_number(F.regexp_replace(F.replace(F.trim(text), F.lit("Preliminary"), F.lit("")), "±.*$", ""))


def parse_digits(text: Column) -> Column:
    """The digits and points of a text as a number; a sign is lost."""
    return to_number(F.regexp_replace(text, r"[^0-9.]", ""))


def scaled_score(benchmark: Column, score: Column) -> Column:
    return F.when(benchmark.isin(*SHARES_OF_ONE), score * 100.0).otherwise(score)


def strip_prefix(name: Column, prefixes: Sequence[str] = PREFIXES) -> Column:
    """Drop "org/" at the start, in either case, for known organisations."""
    return F.regexp_replace(name, "^(?i:" + "|".join(prefixes) + ")/", "")


def strip_suffixes(name: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """Drop company names at the end, each at most once, in the listed order, so several can go."""
    return F.trim(reduce(lambda c, s: F.regexp_replace(c, rf"\Q{s}\E\z", ""), suffixes, name))


def clean_model_name(name: Column, source: Column) -> Column:
    trimmed = F.trim(name)
    return F.when(F.lower(source).contains("vals_ai"), strip_prefix(trimmed)).when(F.lower(source).contains("selenium"), strip_suffixes(trimmed)).otherwise(trimmed)


def sanitize_id(text: Column) -> Column:
    """Letters, digits, "_" and "-" of any script; other runs become one "_", none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?U)[^\w-]", "_"), "_+", "_"), "^_+|_+$", "")


def benchmark_id_from_path(path: Column) -> Column:
    """The folder's name; of one that a partitioned write has named key=value, the value."""
    folder = F.regexp_replace(F.element_at(F.split(path, "/"), -2), "^[^=]+=", "")
    return F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))


def day_number(text: Column) -> Column:
    """Days from 2021-01-01 to a yyyy-MM-dd date; null if it isn't one."""
    return F.datediff(F.try_to_date(text, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date"))


def _mapped(key: Column, values: dict) -> Column:
    return reduce(lambda c, kv: c.when(key == kv[0], F.lit(kv[1])), list(values.items())[1:], F.when(key == next(iter(values)), F.lit(next(iter(values.values())))))


def complexity_rank(text: Column) -> Column:
    """1 to 4; an unknown level is an error, null stays null."""
    known = _mapped(text, COMPLEXITY)
    return F.when(text.isNull(), F.lit(None)).when(known.isNotNull(), known).otherwise(F.raise_error(F.concat(F.lit("unknown complexity: "), text)).cast("int"))


def category_column(category: Column) -> Column:
    """The Elo column of a category; an unknown category is an error, null stays null."""
    known = _mapped(category, CATEGORY_COLUMNS)
    return F.when(category.isNull(), F.lit(None)).when(known.isNotNull(), known).otherwise(F.raise_error(F.concat(F.lit("unknown category: "), category)).cast("string"))


def short_category(category: Column) -> Column:
    return F.coalesce(_mapped(category, ABBREVIATIONS), category)


def format_pvalue(p: Column) -> Column:
    """N/A for null, two significant decimals with exponent below 0.001, else four decimals."""
    return F.when(p.isNull(), "N/A").when(p < 0.001, F.format_string("%.2e", p)).otherwise(F.format_string("%.4f", p))
