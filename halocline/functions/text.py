"""Text helpers: fenced chart blocks and search keys."""

from pyspark.sql import functions as F

# Pattern of a fenced block and defaults of a chart.
FENCED_JSON = r"```json\s*([\s\S]*?)```"
CHART_DEFAULTS = {"type": "line", "title": "Chart", "x_label": "X", "y_label": "Y"}
CHART_SCHEMA = (
    "array<struct<type:string,title:string,x_label:string,y_label:string,data:array<map<string,string>>>>"
)


def strip(c):
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def contains_ignore_case(c, needle):
    return F.coalesce(F.contains(F.lower(c), F.lit(needle.strip().lower())), F.lit(False))


def matches_ignore_case(c, pattern):
    return F.coalesce(F.lower(c).rlike(pattern.strip().lower()), F.lit(False))


def fenced_blocks(text):
    """Array of ``(block, charts)``; ``charts`` is NULL where the JSON does not parse."""
    blocks = F.regexp_extract_all(text, F.lit(FENCED_JSON), F.lit(0))
    bodies = F.regexp_extract_all(text, F.lit(FENCED_JSON), F.lit(1))
    return F.zip_with(
        blocks,
        bodies,
        lambda block, body: F.struct(
            block.alias("block"), F.from_json(strip(body), CHART_SCHEMA).alias("charts")
        ),
    )


def charts_of(text):
    """All charts of a text, in order, with defaults for missing labels."""
    found = F.flatten(F.transform(fenced_blocks(text), lambda b: F.coalesce(b["charts"], F.array())))
    return F.transform(
        F.array_compact(found),
        lambda c: F.struct(
            *[F.coalesce(c[k], F.lit(v)).alias(k) for k, v in CHART_DEFAULTS.items()],
            F.coalesce(c["data"], F.array()).alias("data"),
        ),
    )


def without_charts(text):
    """The text with every parsed block removed; blocks that do not parse stay."""
    parsed = F.filter(fenced_blocks(text), lambda b: b["charts"].isNotNull())
    return F.aggregate(parsed, text, lambda acc, b: strip(F.replace(acc, b["block"], F.lit(""))))


def zero_padded(c, width):
    return F.lpad(c.cast("string"), width, "0")


def id_prefix(c):
    """The part of an identifier before its first underscore."""
    return F.split(c, "_")[0]
