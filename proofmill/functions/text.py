"""Text functions as Column expressions.

Patterns run under ``(?dU)``: classes and word boundaries are Unicode-aware and only the
newline ends a line. All of them stay on the JVM side.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as K
from .stage import let

FLAGS = "(?dU)"
#: Every blank there is; ``trim`` alone only knows U+0020.
BLANKS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
          "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
_BLANK_RUN = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
_META = set("\\^$.|?*+()[]{}")


def rx(pattern: str) -> str:
    """A pattern with the flags every text function here uses."""
    return FLAGS + pattern


def whole(pattern: str) -> str:
    """A pattern that has to cover the whole value."""
    return f"{FLAGS}^(?:{pattern})\\z"


def quote(text: str) -> str:
    """Text as a literal inside a pattern (valid in Java and in RE2)."""
    return "".join("\\" + c if c in _META else c for c in text)


def template_pattern(template: str) -> str:
    """``{}`` becomes any non-empty text, the rest is literal; the whole value must fit."""
    return "^" + ".+?".join(quote(p) for p in template.split("{}")) + "$"


def matches_template(value: Column, template: str) -> Column:
    return value.rlike("(?s)" + FLAGS + template_pattern(template))


def any_of(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for condition in conditions:
        out = out | condition
    return out


def strip_ws(value: Column) -> Column:
    """Drop blanks of any kind at both ends."""
    return F.btrim(value, F.lit(BLANKS))


def squash_ws(value: Column) -> Column:
    """Strip, then one space for every run of blanks."""
    return F.regexp_replace(strip_ws(value), _BLANK_RUN, " ")


def is_blank(value: Column) -> Column:
    return strip_ws(value) == ""


def _replace_all(value: Column, rules) -> Column:
    # the look-ahead rejects most positions before the costlier Unicode word boundary
    for start, pattern, placeholder in rules:
        value = F.regexp_replace(value, rx(f"(?={start}){pattern}" if start else pattern), placeholder)
    return value


def _without_ids(value: Column) -> Column:
    """One scan tells whether there can be an id by its form; names that end in ``=`` are sought
    as they are. No placeholder makes a new match, so the value itself may be asked."""
    formed = F.when(value.rlike(rx(K.VOLATILE_START)), _replace_all(value, K.VOLATILE_IDS)).otherwise(value)
    return _replace_all(formed, K.VOLATILE_NAMES)


def normalize_message(value: Column) -> Column:
    """Log message without run-specific ids and numbers. ``value`` is read several times, so it
    should cost little."""
    plain = _without_ids(value)
    return strip_ws(F.when(value.rlike(rx(K.VOLATILE_NUMBER[0])), _replace_all(plain, [K.VOLATILE_NUMBER])).otherwise(plain))


def normalize_alert_text(value: Column) -> Column:
    """Alert text without run-specific ids; numbers say how large the problem is and stay."""
    return strip_ws(_without_ids(value))


def is_error_level(line: Column) -> Column:
    """The level is the bracket after the timestamp, not the word anywhere in the line."""
    return line.rlike(rx(K.ERROR_LEVEL))


def normalize_line(line: Column) -> Column:
    """One log line as it is shown: no control characters, folded stack, bounded length."""
    clean = F.regexp_replace(line, K.CONTROL_CHARS, " ")
    frames = F.regexp_count(clean, F.lit(rx(K.STACK_FRAME)))
    keep = K.MAX_STACK_FRAMES
    frame = f"(?:{K.STACK_FRAME})"
    # head up to the fourth frame | the frames to fold | what follows the last frame
    layout = rx(f"(?s)^((?:.*?{frame}){{{keep}}}.*?){frame}(?:.*{frame})?(.*)$")
    folded = F.concat(
        F.regexp_extract(clean, layout, 1),
        F.lit(" ... (스택 "), (frames - keep).cast("string"), F.lit("줄 생략)"),
        F.regexp_extract(clean, layout, 2),
    )
    text = F.when(frames > keep, folded).otherwise(clean)
    limit = K.MAX_LINE_CHARS
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(" …(잘림)"))
    ).otherwise(text)


def line_family(line: Column) -> Column:
    """Logger, with its consumer or else its exception when the message names one."""
    logger = F.regexp_extract(line, rx(K.LOGGER_AND_MESSAGE), 1)
    message = F.regexp_extract(line, rx(K.LOGGER_AND_MESSAGE), 2)
    consumer = F.regexp_extract(message, rx(K.CONSUMER_SLOT), 1)
    exception = F.regexp_extract(message, rx(K.EXCEPTION_SLOT), 1)
    return (
        F.when(logger == "", F.lit(K.OTHER_FAMILY))
        .when(consumer != "", F.concat_ws(":", logger, consumer))
        .when(exception != "", F.concat_ws(":", logger, exception))
        .otherwise(logger)
    )


def coarse_family(family: Column) -> Column:
    return F.substring_index(family, ":", 1)


def render_rule(text: Column) -> Column:
    """Alert-rule text with its template expressions filled in."""
    for expression, value in K.RULE_TEMPLATE_VALUES:
        text = F.replace(text, F.lit(expression), F.lit(value))
    text = F.regexp_replace(text, K.RULE_VALUE_PATTERN, K.RULE_VALUE)
    return strip_ws(F.regexp_replace(text, K.RULE_OTHER_PATTERN, ""))


def signature_lines(lines: Column) -> Column:
    """(logger, normalised message) per line; ``?`` and the whole line without a logger."""
    split = F.transform(lines, lambda line: F.struct(
        F.regexp_extract(line, rx(K.SIGNATURE_LINE), 1).alias("logger"),
        F.regexp_extract(line, rx(K.SIGNATURE_LINE), 2).alias("message"),
        line.alias("line"),
    ))
    return F.transform(split, lambda x: F.struct(
        F.when(x["logger"] == "", F.lit("?")).otherwise(x["logger"]).alias("logger"),
        normalize_message(
            F.when(x["logger"] == "", x["line"]).otherwise(x["message"])).alias("message"),
    ))


def without_stamp(line: Column) -> Column:
    return F.regexp_replace(line, rx(K.LEADING_STAMP), "")


def span_minutes(lines: Column) -> Column:
    """Minutes between the first and last stamp; null with fewer than two stamps."""
    stamps = F.array_compact(F.transform(
        lines,
        lambda line: F.unix_timestamp(F.try_to_timestamp(
            F.nullif(F.regexp_extract(line, rx(K.LEADING_STAMP), 1), F.lit("")),
            F.lit("yyyy-MM-dd HH:mm:ss"),
        )),
    ))
    return let(stamps, lambda s: F.when(
        F.size(s) >= 2,
        (F.array_max(s) - F.array_min(s)).cast("double") / F.lit(60.0),
    ))


def span_bucket(minutes: Column) -> Column:
    return (
        F.when(minutes.isNull(), "?")
        .when(minutes <= K.TIGHT_MINUTES, "tight")
        .when(minutes <= K.SPREAD_MINUTES, "mid")
        .otherwise("spread")
    )


def thread_family(thread: Column) -> Column:
    """Execution family of a thread name, null when there is none."""
    out = F
    for pattern, family in K.THREAD_FAMILIES:
        hit = thread == "" if pattern == "" else thread.rlike(whole(pattern))
        if family == "stream":
            pool = F.regexp_extract(thread, whole(pattern), 1)
            value = F.when(pool.isin(*K.STREAM_POOLS), family)
        else:
            value = F.lit(family)
        out = out.when(hit, value)
    return out
