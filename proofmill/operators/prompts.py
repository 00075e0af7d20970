"""Prompt texts as columns: the analysed alert, judge and screener prompts, variants, chat."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as K
from ..functions import jsontext as J


def build_prompt(alert: Column, lines: Column, environment: Column) -> Column:
    """Alert header, labels, and the log lines if there are any, one per line."""
    bullets = lambda items: F.array_join(F.transform(
        items, lambda x: F.concat(F.lit("\n- "), x)), "")
    labels = F.transform(F.map_entries(alert["labels"]), lambda e: F.concat(
        e["key"], F.lit("="), e["value"]))
    head = F.concat(
        F.lit(K.PROMPT_SEVERITY), alert["severity"],
        F.lit("\n" + K.PROMPT_FINGERPRINT), alert["fingerprint"],
        F.lit("\n" + K.PROMPT_ALERTNAME), alert["alertname"],
        F.lit("\n" + K.PROMPT_SUMMARY), alert["summary"],
        F.lit("\n" + K.PROMPT_DESCRIPTION), alert["description"],
        F.lit("\n" + K.PROMPT_LABELS), bullets(labels))
    logs = F.concat(
        F.lit("\n\n" + K.PROMPT_LOGS_HEAD), environment, F.lit(K.PROMPT_LOGS_TAIL), bullets(lines))
    return F.concat(head, F.when(F.size(lines) > 0, logs).otherwise(""), F.lit("\n"))


def with_prompt(scenarios: DataFrame) -> DataFrame:
    return scenarios.withColumn("prompt", build_prompt(
        F.col("alert"), F.col("log_samples"), F.col("log_environment")))


def judge_prompt(question: Column, rubric: Column, answer: Column) -> Column:
    return F.concat(
        F.lit(K.JUDGE_QUESTION + "\n"), question, F.lit(f"\n\n{K.JUDGE_RUBRIC}\n"), rubric,
        F.lit(f"\n\n{K.JUDGE_ANSWER}\n"), answer, F.lit("\n"))


def screen_prompt(alert: Column, lines: Column, rubric: Column) -> Column:
    said = lambda c: F.coalesce(c, F.lit("None"))
    return F.concat(
        F.lit(K.SCREEN_ALERT + "\n"), said(alert["alertname"]),
        F.lit(" ("), said(alert["severity"]), F.lit(")\n" + K.SCREEN_SUMMARY), said(alert["summary"]),
        F.lit("\n" + K.SCREEN_DESCRIPTION), said(alert["description"]),
        F.lit(f"\n\n{K.SCREEN_LOGS}"),
        F.array_join(F.transform(lines, lambda x: F.concat(F.lit("\n- "), x)), ""),
        F.lit(f"\n\n{K.SCREEN_RUBRIC}\n"), F.coalesce(rubric, F.lit("")), F.lit("\n"))


@dataclass(frozen=True)
class PromptVariants:
    """A base instruction and named ways of extending it.

    The texts belong to the deployment. A rule of (text, None) is appended; one of
    (text, marker) goes in front of the marker's first occurrence in the base.
    """

    base: str
    rules: dict[str, tuple[str, str | None]] = field(default_factory=dict)

    def column(self) -> Column:
        """Array of (variant, system) structs; ``production`` is the base as it is."""
        base = F.lit(self.base)
        out = [("production", base)]
        for name, (rule, marker) in self.rules.items():
            if marker is None:
                text = F.concat(base, F.lit(rule))
            else:
                if marker not in self.base:
                    raise ValueError(f"marker of {name} is not in the base instruction")
                at = F.instr(base, marker)
                text = F.concat(F.substr(base, F.lit(1), at - 1), F.lit(rule),
                                F.substr(base, at))
            out.append((name, text))
        return F.array(*[F.struct(F.lit(n).alias("variant"), t.alias("system")) for n, t in out])


def prompt_variants(scenarios: DataFrame, variants: PromptVariants) -> DataFrame:
    """Every scenario with every variant: (name, variant, system, prompt)."""
    return with_prompt(scenarios).withColumn("v", F.explode(variants.column())).select(
        "name", "v.variant", "v.system", "prompt")


def judge_variants(results: DataFrame, variants: PromptVariants) -> DataFrame:
    """Every judged answer with every variant of the judge's instruction:
    (run, scenario, trial, variant, system, prompt). ``results`` has question and rubric."""
    prompt = judge_prompt(F.col("question"), F.col("rubric"), F.col("answer"))
    return results.withColumn("prompt", prompt).withColumn("v", F.explode(variants.column())).select(
        "run", "scenario", "trial", "v.variant", "v.system", "prompt")


def chat_messages(system: Column, user: Column, assistant: Column) -> Column:
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("system", system), turn("user", user), turn("assistant", assistant))


def chat_samples(rows: DataFrame, system: str) -> DataFrame:
    """Adds ``messages`` and the ``assistant`` target of rows with an analysis."""
    step = with_prompt(rows).withColumn("assistant", J.target_json(F.col("analysis")))
    return step.withColumn("messages", chat_messages(
        F.lit(system), F.col("prompt"), F.col("assistant")))
