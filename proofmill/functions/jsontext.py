"""JSON found in model answers, as Column expressions.

``try_parse_json`` accepts text that goes on after the first value, so the functions here
first cut out exactly one object and only then parse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import fixed_values as K
from .stage import once
from .text import strip_ws

# An escape pair, a quote, a brace, or a run of anything else.
_TOKENS = r'(?s)\\.|["{}]|[^"{}\\]+|\\'
_SCAN = T.StructType([
    T.StructField("depth", T.IntegerType(), False),
    T.StructField("quoted", T.BooleanType(), False),
    T.StructField("pos", T.IntegerType(), False),
    T.StructField("end", T.IntegerType(), False),
])


def _object_end(text: Column) -> Column:
    """Length of the object that ``text`` starts with, 0 when it never closes.

    Braces inside strings do not count. A backslash only escapes inside a string, so an
    escape pair seen outside one still counts by its second character.
    """

    def step(acc: Column, token: Column) -> Column:
        outside = ~acc["quoted"]
        mark = F.when(outside, F.substring(token, -1, 1)).otherwise(token)
        depth = acc["depth"] + F.when(outside & (mark == "{"), 1).when(
            outside & (mark == "}"), -1).otherwise(0)
        pos = acc["pos"] + F.length(token)
        closes = outside & (mark == "}") & (depth == 0) & (acc["end"] == 0)
        # only single marks carry meaning; a longer run of text ends in none of them
        return F.struct(
            depth.cast("int").alias("depth"),
            F.when(mark == '"', outside).otherwise(acc["quoted"]).alias("quoted"),
            pos.cast("int").alias("pos"),
            F.when(closes, pos).otherwise(acc["end"]).cast("int").alias("end"),
        )

    start = F.struct(
        F.lit(0).alias("depth"), F.lit(False).alias("quoted"),
        F.lit(0).alias("pos"), F.lit(0).alias("end"),
    )
    tokens = F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0))
    return F.aggregate(tokens, start, step, lambda acc: acc["end"])


_STRING = r'"(?:[^"\\]++|\\.)*+"'
_FLAT = rf'[^{{}}"]++|{_STRING}'
_SHALLOW = rf"\{{(?:{_FLAT})*+\}}"
for _ in range(3):
    _SHALLOW = rf"\{{(?:{_FLAT}|{_SHALLOW})*+\}}"
# Objects up to four deep, found in one pass: possessive, so neither backtracking nor stack.
_SHALLOW = r"(?s)\A" + _SHALLOW


def _with_object_end(rows: DataFrame, text: str, end: str) -> DataFrame:
    """Adds the length of the object ``text`` starts with, 0 when it never closes."""
    found = F.regexp_extract(text, _SHALLOW, 0)
    rows = rows.withColumn("__flat", F.length(found))
    deep = F.when(F.contains(F.col(text), F.lit("}")), _object_end(F.col(text))).otherwise(0)
    return rows.withColumn(
        end, F.when(F.col("__flat") > 0, F.col("__flat")).otherwise(deep)).drop("__flat")


def with_json(rows: DataFrame, raw: str, out: str) -> DataFrame:
    """Adds the JSON object of a model answer: what is inside a code fence if there is one,
    from the first brace to the one that closes it, else what there is, stripped.

    Done in stages, since each one is used several times by the next.
    """
    pattern = "(?sU)" + K.CODE_FENCE
    t, r, s, e = "__text", "__rest", "__start", "__end"
    staged = (
        rows.withColumn(t, F.when(
            F.contains(F.col(raw), F.lit("```")) & F.col(raw).rlike(pattern),
            F.regexp_extract(raw, pattern, 1)).otherwise(F.col(raw)))
        .withColumn(s, F.instr(t, "{"))
        # a start of 0 reads the whole text, whose result is then not used
        .withColumn(r, F.substr(t, F.greatest(F.col(s), F.lit(1))))
    )
    found = (
        F.when(F.col(s) == 0, strip_ws(F.col(t)))
        .when(F.col(e) > 0, F.substr(r, F.lit(1), F.col(e)))
        .otherwise(strip_ws(F.col(r))))
    return _with_object_end(staged, r, e).withColumn(out, found).drop(t, r, s, e)


def with_strict_json(rows: DataFrame, raw: str, out: str) -> DataFrame:
    """Adds the text itself when it is exactly one object, else null."""
    t, e = "__text", "__end"
    staged = rows.withColumn(t, F.regexp_replace(raw, r"^[ \t\r\n]+|[ \t\r\n]+\z", ""))
    return _with_object_end(staged, t, e).withColumn(out, F.when(
        F.col(t).startswith("{") & (F.col(e) == F.length(t)), F.col(t))).drop(t, e)


def parse_object(json: Column) -> Column:
    """Variant of a text that is one JSON object, null for anything else."""
    return F.when(json.startswith("{"), F.try_parse_json(json))


def _with_fields(rows: DataFrame, node: str, fields: tuple[str, ...]) -> DataFrame:
    """Adds value, kind and text of each field of a parsed object, each read once."""
    rows = rows.withColumns({
        f"__v_{f}": F.try_variant_get(node, f"$.{f}", "variant") for f in fields})
    rows = rows.withColumns({f"__k_{f}": F.schema_of_variant(f"__v_{f}") for f in fields})
    return rows.withColumns({
        f"__t_{f}": F.try_variant_get(f"__v_{f}", "$", "string") for f in fields})


def _drop_fields(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    return rows.drop(*[f"__{x}_{f}" for x in "vkt" for f in fields])


def _truthy(field: str) -> Column:
    """A value counts as true unless it is absent, null, false, 0, "" or an empty container."""
    kind, text = F.col(f"__k_{field}"), F.col(f"__t_{field}")
    return (
        F.when(kind.isNull() | (kind == "VOID"), False)
        .when(kind == "BOOLEAN", text == "true")
        .when(kind == "STRING", text != "")
        .when(kind.startswith("ARRAY"), text != "[]")
        .when(kind.startswith("OBJECT"), text != "{}")
        .otherwise(F.coalesce(text.try_cast("double") != 0.0, F.lit(True)))
    )


def _text_or_empty(field: str) -> Column:
    """Text of a value, empty when the value does not count as true."""
    kind, text = F.col(f"__k_{field}"), F.col(f"__t_{field}")
    return (
        F.when(kind == "STRING", text)
        .when(~_truthy(field), "")
        .when(kind == "BOOLEAN", F.initcap(text))
        .otherwise(text)
    )


def _clamped_score(field: str) -> Column:
    """0..5: numbers lose their fraction, whole-number text counts, the rest is 0."""
    kind, text = F.col(f"__k_{field}"), F.col(f"__t_{field}")
    plain = strip_ws(text)
    number = (
        F.when(kind == "STRING", F.when(plain.rlike(r"^[+-]?[0-9]+\z"), plain.try_cast("double")))
        .when(kind == "BOOLEAN", F.when(text == "true", 1.0).otherwise(0.0))
        .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), text.try_cast("double"))
    )
    whole = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))
    return F.coalesce(F.least(F.lit(5), F.greatest(F.lit(0), whole)), F.lit(0)).cast("int")


def _items(field: str) -> Column:
    """Items of a list, characters of a text, keys of an object; null for a bare number."""
    kind, text = F.col(f"__k_{field}"), F.col(f"__t_{field}")

    def shown(v: Column) -> Column:
        as_text = F.try_variant_get(v, "$", "string")
        item = F.schema_of_variant(v)
        return (F.when(item == "STRING", as_text).when(item == "VOID", "None")
                .when(item == "BOOLEAN", F.initcap(as_text)).otherwise(as_text))

    empty = F.array().cast("array<string>")
    return (
        F.when(~_truthy(field), empty)
        .when(kind == "ARRAY<STRING>", F.from_json(text, "array<string>"))
        .when(kind.startswith("ARRAY"), F.transform(
            F.try_variant_get(f"__v_{field}", "$", "array<variant>"), shown))
        .when(kind == "STRING", F.filter(F.split(text, ""), lambda c: c != ""))
        .when(kind.startswith("OBJECT"), F.json_object_keys(text))
    )


_ANALYSIS_FIELDS = ("summary", "rootCauseHypothesis", "suggestedActions", "evidenceFound", "evidenceLine")
_SCORE_FIELDS = ("accuracy", "groundedness", "hallucinationDetected", "verdict", "rationale")


def with_analysis(rows: DataFrame, node: str, out: str) -> DataFrame:
    """Adds the analysis struct of a parsed object, null when it is not a usable one."""
    staged = _with_fields(rows, node, _ANALYSIS_FIELDS).withColumn("__items", _items("suggestedActions"))
    value = F.when(
        F.col(node).isNotNull() & F.col("__items").isNotNull(),
        F.struct(
            _text_or_empty("summary").alias("summary"),
            _text_or_empty("rootCauseHypothesis").alias("root_cause_hypothesis"),
            F.col("__items").alias("suggested_actions"),
            _truthy("evidenceFound").alias("evidence_found"),
            _text_or_empty("evidenceLine").alias("evidence_line"),
        ),
    )
    return _drop_fields(once(staged, **{out: value}), _ANALYSIS_FIELDS).drop("__items")


def with_score(rows: DataFrame, node: str, out: str) -> DataFrame:
    """Adds the judge-score struct; null (no JSON object) is a FAIL that says so."""
    staged = _with_fields(rows, node, _SCORE_FIELDS)
    ok = F.col(node).isNotNull()
    passed = (F.col("__k_verdict") == "STRING") & (F.col("__t_verdict") == "PASS")
    value = F.struct(
        F.when(ok, _clamped_score("accuracy")).otherwise(0).alias("accuracy"),
        F.when(ok, _clamped_score("groundedness")).otherwise(0).alias("groundedness"),
        F.when(ok, _truthy("hallucinationDetected")).otherwise(False).alias("hallucination_detected"),
        F.when(ok & passed, "PASS").otherwise("FAIL").alias("verdict"),
        F.when(ok, _text_or_empty("rationale")).otherwise(
            "judge answer is not a JSON object").alias("rationale"),
    )
    return _drop_fields(once(staged, **{out: value}), _SCORE_FIELDS)


def target_json(analysis: Column) -> Column:
    """Training target: fixed key order, ``", "`` and ``": "`` between the parts."""
    def quoted(value: Column) -> Column:
        # to_json escapes a whole struct; the text of its only field is cut back out
        body = F.to_json(F.struct(value.alias("v")))
        return F.substr(body, F.lit(6), F.length(body) - 6)

    actions = F.concat(
        F.lit("["), F.array_join(F.transform(analysis["suggested_actions"], quoted), ", "), F.lit("]")
    )
    return F.concat(
        F.lit('{"summary": '), quoted(analysis["summary"]),
        F.lit(', "rootCauseHypothesis": '), quoted(analysis["root_cause_hypothesis"]),
        F.lit(', "suggestedActions": '), actions,
        F.lit(', "evidenceFound": '), analysis["evidence_found"].cast("string"),
        F.lit(', "evidenceLine": '), quoted(analysis["evidence_line"]),
        F.lit("}"),
    )
