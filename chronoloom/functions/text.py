"""Text of numbers, series, channels and retrieved examples, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def format_float(value: Column | str, *, digits: int = 3, mode: str = "round", strip_zeros: bool = True) -> Column:
    """A decimal number of at most ``digits`` places, halves away from zero (``round``) or cut (``truncate``), from
    the shortest decimal form of the double. NaN and infinities are words."""
    if mode not in ("round", "truncate"):
        raise ValueError("mode must be 'round' or 'truncate'")
    if digits < 0:
        raise ValueError("digits must be non-negative")
    v = _col(value).cast("double")
    exact = F.when(F.isnan(v) | (F.abs(v) >= 1e19), None).otherwise(v).cast("string").cast("decimal(38,18)")
    if mode == "round":
        kept = F.round(exact, digits)
    else:
        kept = F.when(exact < 0, F.ceil(exact, F.lit(digits))).otherwise(F.floor(exact, F.lit(digits)))
    text = kept.cast(f"decimal(38,{min(digits, 18)})").cast("string")
    if strip_zeros and digits:
        text = F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")
        text = F.when(text == "-0", "0").otherwise(text)
    return (
        F.when(F.isnan(v), "nan")
        .when(v == float("inf"), "inf")
        .when(v == float("-inf"), "-inf")
        .when(F.abs(v) >= 1e19, v.cast("string"))
        .otherwise(text)
    )


def format_series(values: Column | str, *, max_items: int | None = None, show_length: bool = True, **number) -> Column:
    """``[a, b, …]``; of a longer series the first ``max_items`` and the whole length."""
    v = _col(values)
    shown = v if max_items is None else F.slice(v, 1, max_items)
    body = F.concat(F.lit("["), F.array_join(F.transform(shown, lambda x: format_float(x, **number)), ", "), F.lit("]"))
    if max_items is None:
        return body
    more = F.concat(F.lit(" ... (total_length="), F.size(v).cast("string"), F.lit(")")) if show_length else F.lit(" ...")
    return F.when(F.size(v) > max_items, F.concat(body, more)).otherwise(body)


def format_channel(channel_id: Column | str, values: Column | str, score: Column | str | None = None, **series) -> Column:
    text = F.concat(F.lit("Channel "), _col(channel_id).cast("string"), F.lit(": "), format_series(values, **series))
    if score is None:
        return text
    score = _col(score)
    return F.when(score.isNull(), text).otherwise(F.concat(text, F.lit(" (score="), format_float(score), F.lit(")")))


def format_payload(*, text: Column | str | None = None, series: Column | str | None = None, features: Column | str | None = None, max_items: int | None = None) -> Column:
    """The first that isn't null: a text, a series, or a map as ``{ k=v, … }`` by key."""
    options = []
    if text is not None:
        options.append(_col(text))
    if series is not None:
        options.append(format_series(series, max_items=max_items))
    if features is not None:
        entries = F.array_sort(F.map_entries(_col(features)))
        options.append(F.concat(F.lit("{ "), F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), format_float(e["value"]))), ", "), F.lit(" }")))
    return F.coalesce(*options, F.lit("None"))


def format_example(sample_id: Column | str, *, label: Column | str | None = None, channel_id: Column | str | None = None, view: str | None = None, score: Column | str | None = None, payload: Column | None = None) -> Column:
    """A header line of what is known, and the payload below."""
    parts = [F.concat(F.lit("Sample: "), _col(sample_id).cast("string"))]
    for name, value in (("Label", label), ("Channel", channel_id)):
        if value is not None:
            v = _col(value).cast("string")
            parts.append(F.when(v.isNotNull(), F.concat(F.lit(f"{name}: "), v)))
    if view:
        parts.append(F.lit(f"View: {view}"))
    if score is not None:
        parts.append(F.when(_col(score).isNotNull(), F.concat(F.lit("Score: "), format_float(score))))
    head = F.concat_ws(" | ", *parts)
    return head if payload is None else F.concat(head, F.lit("\n"), payload)


def format_set(examples: Column, ranks: Column, empty: str = "No retrieved examples.") -> Column:
    """An aggregate: the examples of a group as ``Example i:`` blocks in the order of their ranks."""
    ordered = F.array_sort(F.collect_list(F.struct(ranks.alias("r"), examples.alias("t"))))
    blocks = F.transform(ordered, lambda e, i: F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit(":\n"), e["t"]))
    return F.when(F.size(blocks) == 0, F.lit(empty)).otherwise(F.array_join(blocks, "\n\n"))


def sample_id_of_path(path: Column | str) -> Column:
    """A relative path, without its suffix, as an id: separators become two underscores."""
    p = F.regexp_replace(F.regexp_replace(_col(path), r"\\", "/"), r"\.[^./]*$", "")
    return F.replace(p, F.lit("/"), F.lit("__"))


def path_of_sample_id(sample_id: Column | str) -> Column:
    """The path of an id; names that hold two underscores themselves come back as separators."""
    return F.replace(_col(sample_id), F.lit("__"), F.lit("/"))
