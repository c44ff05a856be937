"""Prompt records and pluggable predictors (survey 1.1, 2.11, 2.12)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import with_end
from ..functions.series import finite


@dataclass(frozen=True)
class DatasetSpec:
    """What a data set must say, as columns of its rows."""

    pre_prompt: Column
    post_prompt: Column
    answer: Column
    texts: list[Column]
    series: list[Column]
    keep: tuple[str, ...] = ()


def prompt_records(rows: DataFrame, spec: DatasetSpec, eos: str = "") -> tuple[DataFrame, DataFrame]:
    """Prompt records, and the rows with a series that is empty or not finite."""
    made = rows.select(
        *spec.keep,
        spec.pre_prompt.alias("pre_prompt"),
        F.array(*spec.series).alias("time_series"),
        F.array(*spec.texts).alias("time_series_text"),
        spec.post_prompt.alias("post_prompt"),
        (with_end(spec.answer, eos) if eos else spec.answer).alias("answer"),
    )
    ok = F.forall("time_series", finite)
    return made.where(ok), made.where(~F.coalesce(ok, F.lit(False)))


#: What stands before and after the series, by family; {names} are filled from columns. The wording is this library's own.
FAMILIES = {
    "multiple_choice": ("{question}", "Predict the {task} Answer:"),
    "caption": ("The series below comes from a collection of recorded measurements.", "Describe its course, level and changes in a short and exact caption."),
    "activity_reasoning": ("Three axes of an acceleration sensor follow. Find out which activity of this list they show: {labels}. Reason from the signals to the activity, name it in the last sentence only, and end with the word Answer and the activity.", "Reasoning:"),
    "activity_label": ("Three axes of an acceleration sensor follow, recorded over time. Say which activity they show.", "Choose one of: {labels}. End with the word Answer and the activity."),
    "sleep_reasoning": ("A brain signal of 30 seconds follows. Find out which sleep stage of this list it shows: {labels}. Reason from the signal to the stage and end with the word Answer and the stage.", "Reasoning:"),
    "heart_question": ("A heart recording follows. {context} Question: {question}", "Choose one of: {labels}. End with the word Answer and the choice."),
    "heart_reasoning": ("A heart recording follows. {context} Look at rhythm, rate and shape before you answer: {question}", "Choose one of: {labels}. Reason first, then end with the word Answer and the choice."),
    "value": ("A series of measurements of one patient follows.", "Estimate the value that belongs to it. Answer:"),
    "simulated": ("Series of made-up numbers follow.", "Tell what they have in common. Answer:"),
}


def family_prompts(family: Column, values: dict[str, Column]) -> tuple[Column, Column]:
    """pre and post prompt of a row's family (null for an unknown one), with each {name} replaced by its column (null: nothing)."""
    side = lambda k: F.try_element_at(F.create_map(*[F.lit(x) for name, texts in FAMILIES.items() for x in (name, texts[k])]), family)

    def filled(text: Column) -> Column:
        for name, value in values.items():
            text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
        return text

    return filled(side(0)), filled(side(1))


def string_prompt(formatted: Column) -> Column:
    """A text prompt; `formatted` holds the series as texts."""
    return F.concat_ws("\n", F.col("pre_prompt"), F.array_join(F.zip_with("time_series_text", formatted, lambda t, s: F.concat_ws("\n", t, s)), "\n"), F.col("post_prompt"))


def media_prompt(media: str = "<image>", end: str = "<|endofchunk|>") -> Column:
    """a media mark before each series' text, then post prompt and answer."""
    chunks = F.transform("time_series_text", lambda t: F.concat(F.lit(media), t, F.lit(end)))
    return F.concat_ws(" ", F.col("pre_prompt"), F.array_join(chunks, ""), F.col("post_prompt"), F.col("answer"))


#: A batch of prompts to as many texts.
Predictor = Callable[[list[str]], list[str]]


def echo(prompts: list[str]) -> list[str]:
    """A predictor that needs no model: the last word of each prompt."""
    return [f"Answer: {p.split()[-1]}" if p.split() else "" for p in prompts]


def predicted(prompts: DataFrame, predictor: Predictor = echo, batch: int = 64) -> DataFrame:
    """`generated` for every row of `prompts` (any columns and `prompt`), in batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["prompt"].tolist()
            yield frame.assign(generated=[x for k in range(0, len(texts), batch) for x in predictor(texts[k : k + batch])])

    return prompts.mapInPandas(run, T.StructType([*prompts.schema.fields, T.StructField("generated", T.StringType())]))
