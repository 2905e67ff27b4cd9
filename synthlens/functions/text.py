"""Text expressions for model replies and prompt rendering.

Reply handling mirrors the tolerant-but-strict parser of the generator:
strip, take the first fenced part that opens a JSON array, slice from the
first ``[`` to the last ``]``, parse strictly, and on failure cut at the last
comma that has at least five characters after it and close the array.
Every step is a Catalyst expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters Python's str.strip() removes (str.isspace in
# the ASCII and Latin-1 ranges plus the Unicode space separators).
WS_CLASS = "[\\t\\n\\x0b\\x0c\\r\\x1c-\\x1f \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
FENCE = "```"
JSON_TAG = "json"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def _clean_parts(t: Column) -> Column:
    """Fence parts, each stripped and with a leading ``json`` tag removed."""
    parts = F.transform(F.split(t, FENCE, -1), strip)
    return F.transform(parts, lambda p: F.when(p.startswith(JSON_TAG),
                                               strip(F.substring(p, len(JSON_TAG) + 1, 1 << 30))).otherwise(p))


def _pick_clean(t: Column, parts: Column) -> Column:
    first_array = F.element_at(F.filter(parts, lambda p: p.startswith("[")), 1)
    return F.when(F.instr(t, FENCE) > 0, F.coalesce(first_array, t)).otherwise(t)


def reply_clean(c: Column) -> Column:
    """Stripped reply; if fenced, the first fenced part that (after an
    optional ``json`` tag) starts with ``[``. (Single-use expression; the
    parse path stages the same steps as columns, see ``reply_stages``.)"""
    t = strip(c)
    return _pick_clean(t, _clean_parts(t))


def last_pos(t: Column, ch: str) -> Column:
    """1-based position of the last ``ch`` in ``t``; 0 if absent."""
    r = F.instr(F.reverse(t), ch)
    return F.when(r == 0, F.lit(0)).otherwise(F.length(t) - r + 1)


def _slice(t: Column, s: Column, e: Column) -> Column:
    return (F.when((s > 0) & (e > 0), F.when(e >= s, F.substring(t, s, e - s + 1)).otherwise(F.lit("")))
            .otherwise(t))


def reply_slice(t: Column) -> Column:
    """From the first ``[`` to the last ``]`` when both exist (empty text
    when the last ``]`` comes before the first ``[``)."""
    return _slice(t, F.instr(t, "["), last_pos(t, "]"))


def repair_cut(t: Column) -> Column:
    """0-based index of the last comma at least five characters before the
    end (Python ``rfind(',', 0, len - 5)``, a negative end counting from the
    back); -1 if none."""
    n = F.length(t)
    end = F.when(n >= 5, n - 5).otherwise(F.greatest(F.lit(0), 2 * n - 5))
    p = last_pos(F.substring(t, 1, end), ",")
    return p - 1


def repaired(t: Column, cut: Column | None = None) -> Column:
    cut = repair_cut(t) if cut is None else cut
    return F.when(cut > 0, F.concat(F.substring(t, 1, cut), F.lit("]")))


def reply_stages(df: DataFrame, col: str = "response") -> DataFrame:
    """Adds ``_cand`` (cleaned and sliced candidate) and ``_cut`` (repair
    cut) as staged columns: each step reads the previous column once, so
    the plan stays linear in the number of steps."""
    d = df.withColumn("_t", strip(F.col(col)))
    d = d.withColumn("_parts", _clean_parts(F.col("_t")))
    d = d.withColumn("_clean", _pick_clean(F.col("_t"), F.col("_parts")))
    d = d.withColumn("_s", F.instr(F.col("_clean"), "[")).withColumn("_e", last_pos(F.col("_clean"), "]"))
    d = d.withColumn("_cand", _slice(F.col("_clean"), F.col("_s"), F.col("_e")))
    d = d.withColumn("_n", F.length("_cand"))
    d = d.withColumn("_end", F.when(F.col("_n") >= 5, F.col("_n") - 5).otherwise(F.greatest(F.lit(0), 2 * F.col("_n") - 5)))
    d = d.withColumn("_cut", last_pos(F.substring(F.col("_cand"), 1, F.col("_end")), ",") - 1)
    return d.drop("_t", "_parts", "_clean", "_s", "_e", "_n", "_end")


# Strict reading: no single quotes; NaN and infinities are numbers, as in the generator's JSON reader.
_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "true"}


def _wrapped(t: Column) -> Column:
    """``t`` as member ``r`` of an object that ends in a sentinel: the
    sentinel is only read if all of ``t`` is valid JSON."""
    return F.from_json(F.concat(F.lit('{"r":'), t, F.lit(',"end":1}')), "r array<string>, end int", _JSON)


def _values(t: Column) -> Column:
    """Number of JSON values in ``t``: more than one where ``t`` would close
    the wrapping object early and go on with members of its own."""
    return F.size(F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>", _JSON))


def _strict(t: Column, wrapped: Column, values: Column) -> Column:
    """The items of the array ``t``; empty for another JSON value; NULL if
    ``t`` is not JSON."""
    empty = F.array().cast("array<string>")
    return F.when((wrapped["end"] == 1) & (values == 1), F.coalesce(wrapped["r"], empty))


def parse_replies(df: DataFrame, col: str = "response", out: str = "items") -> DataFrame:
    """Reply text to an array with one text per array item (empty on
    failure; NULL for an item that is not an object): strict parse of the
    candidate; only if that is not JSON and a repair cut exists, strict parse
    of the repaired text. A number with a plus sign before Infinity passes
    (and becomes NULL later), which the generator's reader rejects."""
    d = reply_stages(df, col)
    d = d.withColumns({"_w1": _wrapped(F.col("_cand")), "_v1": _values(F.col("_cand"))})
    d = d.withColumn("_first", _strict(F.col("_cand"), F.col("_w1"), F.col("_v1")))
    d = d.withColumn("_fix", F.when(F.col("_first").isNull(), repaired(F.col("_cand"), F.col("_cut"))))
    d = d.withColumns({"_w2": _wrapped(F.col("_fix")), "_v2": _values(F.col("_fix"))})
    d = d.withColumn("_second", _strict(F.col("_fix"), F.col("_w2"), F.col("_v2")))
    items = F.coalesce("_first", "_second", F.array().cast("array<string>"))
    d = d.withColumn(out, F.transform(items, lambda x: F.when(x.startswith("{"), x)))
    return d.drop("_cand", "_cut", "_w1", "_v1", "_first", "_fix", "_w2", "_v2", "_second")


def fmt4(c: Column) -> Column:
    return F.format_string("%.4f", c)
