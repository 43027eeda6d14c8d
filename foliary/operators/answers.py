"""Answers of bounded size: how many ranked items fit into a budget of bytes, and where the next page begins.

An answer is a JSON object that is sent as a string inside another, so a quote or backslash in it takes one byte more. Its size depends on the cut itself, by the digits
of the counts in it. Everything else adds up, so the longest page is found from running sums: no answer is built to be measured.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The texts of hints, and of the object around an answer.
FIRST_HINT, OVERFLOW_HINT = "use compact or increase budget_bytes", "narrow vaults or increase budget_bytes"
AROUND = len('{"content": [{"type": "text", "text": ""}]}')


def json_string(text: str | Column) -> Column:
    """A text as a JSON string with its quotes."""
    whole = F.to_json(F.struct((F.col(text) if isinstance(text, str) else text).alias("x")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def sent_bytes(text: Column) -> Column:
    """Bytes of a part of an answer when it is sent inside a string."""
    return (F.octet_length(text) + F.regexp_count(text, F.lit(r'["\\]'))).cast("long")


def _cost(text: str) -> int:
    return len(text.encode()) + text.count('"') + text.count("\\")


def _digits(n: Column) -> Column:
    return F.length(n.cast("long").cast("string"))


def within_answer(rows: DataFrame, by: Sequence[str], order: Sequence[Column], item: Column, base: dict, budget: int, offset: int = 0) -> DataFrame:
    """Per group of ``rows``: returned, truncated, next_offset, bytes, state, minimum: the longest beginning in this order whose answer takes ``budget`` bytes at most.

    An answer has the fields of ``base``, then chunks (``item``: the JSON text of each), truncated, returned and next_offset. States: ``whole``; ``cut``; ``empty``, where
    not even the first item fits, but an answer without items and with a hint does; ``overflow``, where that does not either: then ``minimum`` is the size of
    the answer that says so, that number included. Groups are pages of hits.
    """
    head = json.dumps(base, ensure_ascii=False)[:-1] + (", " if base else "") + '"chunks": ['
    fixed = AROUND + _cost(head) + _cost('], "truncated": , "returned": , "next_offset": }')
    line = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    k = F.col("__k")
    size = F.lit(fixed) + F.col("__sum") + (k - 1) * 2 + _digits(k) + _digits(k + offset)
    sized = rows.select(*by, F.sum(sent_bytes(item)).over(line).alias("__sum"), F.count("*").over(line).alias("__k")).withColumn("__size", size)
    cut = F.when(F.col("__size") + len("true") <= budget, F.struct(k, F.col("__size")))
    found = sized.groupBy(*by).agg(F.max(F.struct("__k", "__size")).alias("__all"), F.max(cut).alias("__cut"))
    n, whole = F.col("__all.__k"), F.col("__all.__size") + len("false")
    # the last item belongs to a cut only if the whole answer, with its longer false, does not fit
    shorter = F.when(F.col("__cut.__k") < n, F.col("__cut"))
    before_last = sized.join(found.select(*by, n.alias("__n")), list(by)).where(k == F.col("__n") - 1).groupBy(*by).agg(F.max(cut).alias("__last"))
    found = found.join(before_last, list(by), "left")
    part = F.coalesce(shorter, F.when(F.col("__cut.__k") == n, F.col("__last")))
    empty = fixed + 1 + len(str(offset)) + len("true") + _cost(f', "budget_hint": "{FIRST_HINT}"')
    over = AROUND + _cost(head) + _cost(f'], "next_offset": {offset}, "truncated": true, "returned": 0, "budget_exceeded": true, "budget_hint": "{OVERFLOW_HINT}", "minimum_budget_bytes": ' + "}")
    minimum = budget
    for _ in range(3):
        minimum = over + len(str(minimum))
    fits = whole <= budget
    state = F.when(fits, "whole").when(part.isNotNull(), "cut").otherwise("empty" if empty <= budget else "overflow")
    returned = F.when(fits, n).otherwise(F.coalesce(part["__k"], F.lit(0)))
    size = F.when(fits, whole).when(part.isNotNull(), part["__size"] + len("true")).otherwise(empty if empty <= budget else minimum)
    out = found.select(*by, returned.alias("returned"), (~fits).alias("truncated"), (returned + offset).alias("next_offset"), size.cast("long").alias("bytes"), state.alias("state"))
    return out.withColumn("minimum", F.when(F.col("state") == "overflow", F.lit(minimum)).cast("long"))


def listing(rows: DataFrame, order: Sequence[Column], offset: int = 0, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(page, info) of a list: info has total, next_offset (null on the last page) and page_truncated, of all rows before the cut."""
    page = rows.orderBy(*order).offset(max(0, offset))
    page = page if limit is None or limit < 1 else page.limit(limit)
    total = rows.agg(F.count("*").alias("total"))
    end = max(0, offset) + (limit or 0)
    more = (F.col("total") > end) if limit and limit > 0 else F.lit(False)
    return page, total.select("total", F.when(more, F.lit(end)).cast("long").alias("next_offset"), more.alias("page_truncated"))


def fan_out_depth(top_k: int, offset: int = 0, limit: int | None = None, most: int = 200, least: int = 20) -> int:
    """How many hits each collection gives before the merge, so that the page is right."""
    return min(most, max(top_k, offset + (limit or top_k), least))
