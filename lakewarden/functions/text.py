"""Text gates and small extractions, as column expressions over tables of questions and statements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that block a statement or a question.
DESTRUCTIVE_STATEMENT_WORDS = (
    "DROP DELETE UPDATE INSERT ALTER TRUNCATE CREATE REPLACE GRANT REVOKE MERGE".split()
)
DESTRUCTIVE_QUESTION_WORDS = (
    "remove delete drop truncate clear erase wipe destroy eliminate".split()
)
TABLE_REQUEST_PHRASES = (
    "show", "list", "display", "fetch", "retrieve", "show me the records", "show records",
    "show patients", "list patients", "find all", "get all",
)
# Set operators name their result after the first branch only, which would hide where the rest is from.
SET_WORDS = ("UNION", "INTERSECT", "EXCEPT", "MINUS")
LIMIT_WORDS = ("top", "first", "any", "last")


def _words(words) -> str:
    return r"(?i)\b(" + "|".join(words) + r")\b"


def _unquoted(statement: Column) -> Column:
    """Statement without the content of literals and without comments, taken from left to right in one pass: whichever
    form opens first counts. Literals leave their quotes, comments a blank."""
    forms = (
        r"(')(?:[^'\\]|\\.)*+'", r'(")(?:[^"\\]|\\.)*+"', r"(`)[^`]*+`", r"--[^\n]*+", r"/\*.*?\*/",
    )
    return F.regexp_replace(statement, "(?s)" + "|".join(forms), r" $1$1$2$2$3$3 ")


def blocked_word(statement: Column) -> Column:
    """First blocked word of a statement outside literals and comments, upper case, or NULL."""
    words = _words(DESTRUCTIVE_STATEMENT_WORDS)
    found = F.when(statement.rlike(words), F.regexp_extract(_unquoted(statement), words, 1))
    return F.when(found != "", F.upper(found))


def is_read_only(statement: Column) -> Column:
    return blocked_word(statement).isNull()


def starts_as_query(statement: Column) -> Column:
    """One SELECT or WITH statement and nothing after it."""
    bare = F.regexp_replace(F.trim(_unquoted(statement)), r"[;\s]+$", "")
    return bare.rlike(r"(?is)^\s*\(*\s*(select|with)\b") & ~bare.contains(";")


def combines_sets(statement: Column) -> Column:
    """A set operator outside literals and comments."""
    return _unquoted(statement).rlike(_words(SET_WORDS))


def is_destructive_question(question: Column) -> Column:
    return question.rlike(_words(DESTRUCTIVE_QUESTION_WORDS)) | question.rlike(
        _words("DROP DELETE TRUNCATE INSERT UPDATE ALTER CREATE REPLACE".split())
    )


def has_destructive_verb(question: Column) -> Column:
    return question.rlike(_words(DESTRUCTIVE_QUESTION_WORDS))


def asks_for_table(question: Column) -> Column:
    return question.rlike(_words(TABLE_REQUEST_PHRASES))


def requested_limit(question: Column) -> Column:
    """N of ``top|first|any|last N``, or NULL."""
    digits = F.regexp_extract(
        F.lower(question), r"\b(" + "|".join(LIMIT_WORDS) + r")\s+(\d+)", 2
    )
    return F.when(digits != "", digits.try_cast("bigint"))


BLANKS = " \t\n\r\f\x0b"


def strip_fences(text: Column) -> Column:
    """Text without a leading and a trailing code fence."""
    body = F.regexp_replace(F.btrim(text, F.lit(BLANKS)), r"\A```\w*\n?", "")
    return F.btrim(F.regexp_replace(body, r"\n?```\z", ""), F.lit(BLANKS))


def number_in(text: Column) -> Column:
    """First number of an answer text with thousands commas removed, or NULL."""
    digits = F.regexp_extract(text, r"(\d[\d,]*)", 1)
    return F.when(digits != "", F.regexp_replace(digits, ",", "").try_cast("bigint"))


def path_token(text: Column) -> Column:
    """Lower-case token safe in a path: other characters as ``_``, ``unknown`` if nothing is left."""
    folded = F.regexp_replace(F.lower(text), r"[^a-z0-9_\-]+", "_")
    bare = F.regexp_replace(folded, r"^_+|_+$", "")
    return F.when(F.coalesce(bare, F.lit("")) == "", F.lit("unknown")).otherwise(bare)
