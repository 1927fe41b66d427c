"""Column expressions: everything here is built from native Spark functions."""

from postscreen.functions.labels import is_valid_label, parse_label, presence_flag
from postscreen.functions.text import (
    NA_VALUES,
    fill_text,
    first_tokens,
    missing_to_null,
    not_blank,
    remove_emoji,
    strip,
    tokens,
)

__all__ = [
    "NA_VALUES",
    "fill_text",
    "first_tokens",
    "is_valid_label",
    "missing_to_null",
    "not_blank",
    "parse_label",
    "presence_flag",
    "remove_emoji",
    "strip",
    "tokens",
]
