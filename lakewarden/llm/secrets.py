"""Secret scans: base patterns, and sliding-window Shannon entropy of candidate strings per character class.

A candidate is a run of ``LEAST`` or more characters that keys and tokens are written in. A window of ``WINDOW``
characters slides over it. The window's entropy is ``log2(W) - sum(c * log2(c)) / W`` over its character counts ``c``;
when a character enters or leaves, only its own count changes, so the sum is updated by one term. The highest window
must reach the threshold of the candidate's class. Candidates that the allow-list knows are suppressed.

All steps are expressions over one row's text: no shuffle, no state.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.common import col, documents, free_name, only, query, spans

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are maximal, so asking for the least length in the pattern drops the same matches as asking afterwards.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
LEAST = 20
WINDOW = 20
KINDS = ("assign", "access", "hex", "entropy")
#: Character class by pattern, first that fits, and the bits per character that its best window must reach.
CLASSES = (
    ("digits", r"^[0-9]+$", 9.0),
    ("hex", r"^[0-9a-fA-F]+$", 3.0),
    ("one case", r"^([a-z0-9]+|[A-Z0-9]+)$", 3.4),
    ("mixed case", r"^[A-Za-z0-9]+$", 3.6),
    ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.7),
)
#: Strings that look random to a window and are not secret: no digit or no letter, words joined by separators, paths,
#: placeholders, published digests named as such, identifiers in the 8-4-4-4-12 form, runs of the alphabet. No group is
#: repeated: Java repeats groups by recursion, so a long candidate would overflow the stack. The third entry is letters
#: and separators in any order, the fourth pieces between single slashes of which the last two are short.
ALLOWED = (
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"^[A-Za-z_/=-]*+[0-9]{0,4}$",
    r"^(?!.*//)[a-z0-9/]*[a-z0-9]/[a-z0-9]{1,12}/[a-z0-9]{1,12}/?$",
    r"(?i)example|placeholder|dummy|changeme|your[_-]|xxxx|0000000",
    r"(?i)^(sha(1|224|256|384|512)|md5)[=_-]",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)abcdefgh|12345678|qwertyui",
)


def _count(window: Column, char: Column) -> Column:
    return F.length(window) - F.length(F.replace(window, char, F.lit("")))


def best_window(candidate: Column, window: int = WINDOW) -> Column:
    """Bits per character of the candidate's most random window; 0 if it is shorter than one."""
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    f = lambda c: F.get(weight, c)

    def enter(state: Column, x: Column) -> Column:
        c = _count(state["window"], x)
        return F.struct(
            F.concat(state["window"], x).alias("window"), (state["sum"] + f(c + 1) - f(c)).alias("sum"), state["best"].alias("best")
        )

    def leave(state: Column) -> Column:
        c = _count(state["window"], F.substring(state["window"], 1, 1))
        return F.when(
            F.length(state["window"]) > window,
            F.struct(
                F.substring(state["window"], 2, window).alias("window"), (state["sum"] + f(c - 1) - f(c)).alias("sum"), state["best"].alias("best")
            ),
        ).otherwise(state)

    def rate(state: Column) -> Column:
        bits = F.lit(math.log2(window)) - state["sum"] / float(window)
        full = F.length(state["window"]) == window
        return F.struct(state["window"].alias("window"), state["sum"].alias("sum"), F.when(full, F.greatest(state["best"], bits)).otherwise(state["best"]).alias("best"))

    def bound(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    start = F.struct(F.lit("").alias("window"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
    step = lambda state, x: bound(bound(enter(state, x), leave), rate)
    return F.aggregate(F.split(candidate, ""), start, step, lambda state: state["best"])


def is_secret(candidate: Column) -> Column:
    """Whether a candidate's best window reaches the threshold of its class and no allow-list entry fits."""
    needed = F.lit(None).cast("double")
    for _, pattern, bits in reversed(CLASSES):
        needed = F.when(candidate.rlike(pattern), F.lit(bits)).otherwise(needed)
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | candidate.rlike(pattern)
    return F.when(allowed, F.lit(False)).otherwise(best_window(candidate) >= needed)


def base_spans(text: Column) -> dict[str, Column]:
    return {
        "assign": spans(text, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
        "access": spans(text, ACCESS),
        "hex": spans(text, HEX),
    }


def by_start(lists: list[tuple[str, Column]]) -> Column:
    """``kind:start:end`` of all spans by start, then by kind as listed, comma-joined."""

    def tagged(n: int, kind: str, found: Column) -> Column:
        return F.transform(
            found, lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("n"), s["end"].alias("end"), F.lit(kind).alias("kind"))
        )

    all_spans = F.concat(*[tagged(n, kind, found) for n, (kind, found) in enumerate(lists)])
    return F.array_join(F.transform(F.sort_array(all_spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs``, and a struct column ``secrets`` under the first free name: one list of spans per kind.

    A span has ``start``, ``end`` (code points, end exclusive) and ``found``. Kinds may overlap: a hex key behind
    ``token =`` is an assignment, a hex run and an entropy span. Null and empty texts have none; repeated rows are
    scanned each.
    """
    value = F.coalesce(col(text), F.lit(""))
    lists = base_spans(value) | {"entropy": spans(value, CANDIDATE, is_secret)}
    return docs.withColumn(free_name(docs.columns, "secrets"), F.struct(*[lists[k].alias(k) for k in KINDS]))


@query("op10_secret_spans")
def op10_secret_spans(spark, sf_dir):
    out = find_secrets(only(documents(spark, sf_dir)))
    lists = [(k, F.col(f"secrets.{k}")) for k in KINDS]
    return out.select(
        "doc_id",
        *[F.size(found).cast("long").alias(f"n_{k}") for k, found in lists[:3]],
        F.sha2(by_start(lists[:3]).cast("binary"), 256).alias("base_sha256"),
        by_start(lists).alias("spans"),
    )
