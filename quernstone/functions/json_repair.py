"""Repair of JSON that arrives wrapped in prose, fenced, or slightly broken, as column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.text import py_strip

# Keys looked at, in order, when a list is expected but an object arrives.
LIST_KEYS = ["items", "data", "results", "nodes", "relations"]


def valid(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def _find(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(text, pattern, 1)
    return F.when(text.rlike(pattern), found)


def fix_json(text: Column) -> Column:
    """Trailing commas dropped, single quotes doubled where no double ones are, newlines in strings escaped."""
    t = F.regexp_replace(text, r",\s*([}\]])", "$1")
    # Pieces at odd places between the quotes are string contents.
    pieces = F.transform(
        F.split(t, '"', -1),
        lambda p, i: F.when(
            i % 2 == 1, F.replace(F.replace(p, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
        ).otherwise(p),
    )
    return (
        F.when(~F.contains(text, F.lit('"')), F.replace(t, F.lit("'"), F.lit('"')))
        .when(text.rlike("[\n\r]"), F.array_join(pieces, '"'))
        .otherwise(t)
    )


def repair_json(df: DataFrame, text: str, expected: str = "object", out: str = "repaired") -> DataFrame:
    """Adds struct(json, error): the repaired JSON text of the expected kind and what went wrong.

    Every step is a column of its own, so that each pattern runs once per row.
    """
    raw = F.col(text)
    t = F.col("_t")
    first_obj, first_arr = F.instr(t, "{"), F.instr(t, "[")
    obj_first = (first_obj > 0) & ((first_arr == 0) | (first_obj < first_arr))
    steps = [
        ("_raw_ok", F.coalesce(valid(raw), F.lit(False))),
        # Text that parses as it stands skips the rest.
        ("_t", F.when(~F.col("_raw_ok"), F.regexp_replace(py_strip(raw), "^\\x{FEFF}+", ""))),
        ("_fenced", py_strip(_find(t, r"(?is)```json\s*(.*?)\s*```"))),
        ("_plain", py_strip(_find(t, r"(?s)```\s*(.*?)\s*```"))),
        ("_obj", _find(t, r"(?s)(\{.*\})")),
        ("_arr", _find(t, r"(?s)(\[.*\])")),
        ("_widest", py_strip(
            F.when(obj_first, F.coalesce("_obj", "_t")).when(first_arr > 0, F.coalesce("_arr", "_t")).otherwise(t)
        )),
        ("_clean", F.coalesce(
            F.col("_fenced"), F.when(F.col("_plain").rlike(r"^[{\[]"), F.col("_plain")),
            F.when(valid(F.col("_obj")), F.col("_obj")), F.when(valid(F.col("_arr")), F.col("_arr")), F.col("_widest"),
        )),
        ("_fixed", fix_json(F.col("_clean"))),
        ("_found", F.when(F.col("_raw_ok"), raw).when(valid(F.col("_clean")), F.col("_clean")).when(valid(F.col("_fixed")), F.col("_fixed"))),
        ("_body", py_strip(F.col("_found"))),
    ]
    staged = df
    for name, col in steps:
        staged = staged.withColumn(name, col)
    body = F.col("_body")
    empty = F.lit("{}" if expected == "object" else "[]")
    is_list, is_obj = body.startswith("["), body.startswith("{")
    if expected == "object":
        filled = is_list & ~body.rlike(r"^\[\s*\]$")
        made = F.when(is_obj, body).when(filled, F.concat(F.lit('{"items": '), body, F.lit("}"))).otherwise(empty)
        wrong = ~is_obj
    else:
        member = F.coalesce(*[
            F.when(F.get_json_object(body, f"$.{k}").startswith("["), F.get_json_object(body, f"$.{k}")) for k in LIST_KEYS
        ])
        single = F.when(body.rlike(r"^\{\s*\}$"), F.lit("[]")).otherwise(F.concat(F.lit("["), body, F.lit("]")))
        made = F.when(is_list, body).when(is_obj, F.coalesce(member, single)).otherwise(empty)
        wrong = ~is_list
    blank = F.coalesce(raw, F.lit("")) == ""
    failed = blank | F.col("_found").isNull()
    error = F.when(blank, "empty").when(F.col("_found").isNull(), "unparsable").when(wrong, f"not an {expected}")
    return staged.withColumn(
        out, F.struct(F.when(failed, empty).otherwise(made).alias("json"), error.alias("error"))
    ).drop(*[name for name, _ in steps])
