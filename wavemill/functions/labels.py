"""Scalar functions on strings and labels (survey 2.9): Column in, Column out, JVM only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks that Python's str.strip() removes from ASCII text; Spark's trim() alone removes the space only.
BLANKS = " \t\n\r\x0b\x0c"
#: Characters that a normalised label doesn't end with.
STOPS = ".,!?;:"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def normalize_label(c: Column) -> Column:
    """lower case, strip, then drop trailing stops; a blank before the stops stays."""
    return F.rtrim(strip(F.lower(c)), F.lit(STOPS))


def after_last(c: Column, marker: str) -> Column:
    """What follows the last marker; the whole text if there is none."""
    return F.element_at(F.split(c, _quoted(marker), -1), -1)


def _quoted(text: str) -> str:
    return "".join("\\" + x if not x.isalnum() and x != " " else x for x in text)


def last_word(c: Column) -> Column:
    words = F.filter(F.split(strip(c), r"\s+"), lambda w: w != "")
    return F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit(""))


def first_word(c: Column) -> Column:
    words = F.filter(F.split(strip(c), r"\s+"), lambda w: w != "")
    return F.try_element_at(words, F.lit(1))


def answer_tagged(c: Column) -> Column:
    """After the last `Answer: ` (case counts), stripped, without one `<|...|>` at the end; else the text as it is."""
    found = F.regexp_replace(strip(after_last(c, "Answer: ")), r"<\|.*?\|>$", "")
    return F.when(F.contains(c, F.lit("Answer: ")), strip(found)).otherwise(c)


# Fixed values in these rules: the markers `Answer: ` and `answer:`, and the forms of end tokens, `<|...|>` and `<eos>`.
def answer_clean(c: Column) -> Column:
    """As F02a, but `<|...|>` goes anywhere, `<eos>` and one period only at the end."""
    found = F.when(F.contains(c, F.lit("Answer: ")), strip(after_last(c, "Answer: "))).otherwise(c)
    return F.regexp_replace(strip(F.regexp_replace(found, r"<\|.*?\|>|<eos>$", "")), r"\.$", "")


def answer_or_last_word(c: Column) -> Column:
    """After the last `answer:` in any case, else the last word; stops dropped; lower case."""
    low = F.lower(c)
    found = F.when(F.contains(low, F.lit("answer:")), strip(after_last(low, "answer:"))).otherwise(last_word(low))
    return F.rtrim(found, F.lit(STOPS))


def answer_sentence(c: Column) -> Column:
    """F02d: from the first `Answer:` to the first period; else `non-rem`/`rem` with the word after it; else the last word."""
    direct = strip(F.regexp_extract(c, r"(?is)answer:\s*(.+?)(?:\.|$)", 1))
    two = F.regexp_extract(c, r"(?i)\b((?:non-)?rem \w+)", 1)
    return F.coalesce(F.nullif(direct, F.lit("")), F.nullif(two, F.lit("")), F.nullif(F.rtrim(last_word(c), F.lit(STOPS)), F.lit("")))


# Stage names that are looked for in predictions, lower case.
STAGE_NAMES = ("non-rem stage 1", "non-rem stage 2", "non-rem stage 3", "rem sleep", "wake", "movement")


def rightmost_label(c: Column, labels: tuple[str, ...] = STAGE_NAMES) -> Column:
    """F02e: of the labels that occur, the one that starts furthest right (ties: the first listed); null if none does."""
    low = F.lower(c)
    starts = [F.struct((F.length(low) - F.locate(x[::-1], F.reverse(low)) - len(x)).alias("at"), F.lit(-k).alias("k"), F.lit(x).alias("label"), F.contains(low, F.lit(x)).alias("has")) for k, x in enumerate(labels)]
    return F.array_max(F.filter(F.array(*starts), lambda s: s["has"]))["label"]


def answer_staged(c: Column, labels: tuple[str, ...] = STAGE_NAMES) -> Column:
    """F02e, lower case: from the first `Answer:` to a period or the text's end on the same line; else all that follows the
    last `answer:`; else the right-most label; else the last word."""
    t = strip(c)
    direct = r"(?id)answer:\s*(.+?)(?:\.|$)"
    rest = F.regexp_extract(t, r"(?is)^.*answer:\s*(.*)$", 1)
    return F.lower(
        F.when(F.regexp_like(t, F.lit(direct)), strip(F.regexp_replace(strip(F.regexp_extract(t, direct, 1)), r"\.$", "")))
        .when(F.contains(F.lower(t), F.lit("answer:")), strip(F.rtrim(strip(rest), F.lit(STOPS))))
        .otherwise(F.coalesce(rightmost_label(t, labels), strip(F.rtrim(last_word(t), F.lit(STOPS)))))
    )


def answer_prefix3(c: Column) -> Column:
    """F02f: lower case, after the last `answer:`, first three characters."""
    return F.left(strip(after_last(F.lower(c), "answer:")), F.lit(3))


def mcq_prefix3(c: Column) -> Column:
    """Quirk Q7, kept: cut to three characters before anything is looked for."""
    return F.left(strip(F.lower(c)), F.lit(3))


def answer_first_word(c: Column, lower: bool = True) -> Column:
    """F02g: the first word after the last `Answer:`, else the last word, else `unknown`, stops included; an empty answer gives null (Q24)."""
    tagged = F.contains(c, F.lit("Answer:"))
    found = F.when(tagged, first_word(after_last(c, "Answer:"))).otherwise(F.coalesce(F.nullif(last_word(c), F.lit("")), F.lit("unknown")))
    return F.lower(found) if lower else found


def answer_label(c: Column) -> Column:
    """F02h: the trailing label of a training answer."""
    return answer_clean(c)


def mcq_option(c: Column) -> Column:
    """`(a)` to `(e)` anywhere; else such a letter with `)` or `.` and a word character right behind; else one with
    `:` or `-` behind. Without any, the stripped text; null gives the empty text."""
    t = strip(F.coalesce(c, F.lit("")))
    rules = (r"\(([a-eA-E])\)", r"\b([a-eA-E])[).]\b", r"\b([a-eA-E])\s*[:-]")
    found = [F.nullif(F.regexp_extract(t, r, 1), F.lit("")) for r in rules]
    return F.coalesce(F.concat(F.lit("("), F.lower(F.coalesce(*found)), F.lit(")")), t)


# What predictions call a stage, by the canonical name; stage 4 counts as stage 3.
STAGES = ("Wake", "Non-REM stage 1", "Non-REM stage 2", "Non-REM stage 3", "REM sleep", "Movement")
STAGE_ALIASES = {
    "wake": ("w", "wake"),
    "rem sleep": ("rem", "rapid eye movement", "rem sleep"),
    "movement": ("artifact", "artifacts", "movement time", "movement"),
    "non-rem stage 1": ("1", "s1", "n1", "stage 1"),
    "non-rem stage 2": ("2", "s2", "n2", "stage 2"),
    "non-rem stage 3": ("3", "s3", "n3", "stage 3", "4", "s4", "n4", "stage 4"),
}
# Parts of a longer text that tell its stage, in the order in which they are looked for.
STAGE_PARTS = (
    ("wake", "wake"), ("rem", "rem sleep"), ("movement", "movement"), ("artifact", "movement"), ("stage 4", "non-rem stage 3"), ("stage 3", "non-rem stage 3"),
    ("stage 2", "non-rem stage 2"), ("spindle", "non-rem stage 2"), ("k-complex", "non-rem stage 2"), ("stage 1", "non-rem stage 1"),
)
# Short codes of stages in reports, and the names that plots show for codes.
STAGE_OF_CODE = {"w": "wake", "n1": "non-rem stage 1", "n2": "non-rem stage 2", "n3": "non-rem stage 3", "n4": "non-rem stage 3", "rem": "rem sleep"}
SHOWN_CODES = {"W": "Wake", "N1": "Non-REM stage 1", "N2": "Non-REM stage 2", "N3": "Non-REM stage 3", "N4": "Non-REM stage 4", "REM": "REM sleep", "M": "Movement", "Unknown": "Unknown"}


def mapped(c: Column, table: dict[str, str]) -> Column:
    """Dictionary lookup, unmapped is null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def stage_label(c: Column) -> Column:
    """F04, lower case: without stops at its end and a leading `(x)`, a text's alias; else the first of STAGE_PARTS in it; else the text."""
    t = strip(F.regexp_replace(strip(F.lower(F.coalesce(c, F.lit("")))), r"[.,;:!?][.,;:!?\s]*$", ""))
    t = F.when(F.length(t) > 3, strip(F.regexp_replace(t, r"^\([^)]{0,2}\)", ""))).otherwise(t)
    aliases = {alias: stage for stage, names in STAGE_ALIASES.items() if stage != "wake" for alias in names} | {"w": "wake"}
    full = F.replace(F.replace(t, F.lit("non rem"), F.lit("non-rem")), F.lit("nrem"), F.lit("non-rem"))
    guess = F.when(full == "non-rem stage 4", "non-rem stage 3").when(full.isin(*STAGE_NAMES), full)
    for part, stage in STAGE_PARTS:
        guess = guess.when(F.contains(full, F.lit(part)) & ~(F.lit(part == "rem") & F.contains(full, F.lit("non-rem"))), stage)
    return F.coalesce(mapped(t, aliases), guess, full)


def own_stage_label(c: Column, labels: tuple[str, ...] = STAGES) -> Column:
    """control tokens and one period gone; numbered non-REM stages, REM sleep, wake and movement by their words; else one
    of `labels` in any case; else the text without tokens."""
    text = strip(F.regexp_replace(strip(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"<\|.*?\|>|<eos>$", "")), r"\.$", ""))
    low = F.lower(text)
    low = F.when(F.contains(low, F.lit("non-rem")) | F.contains(low, F.lit("nrem")), F.replace(F.replace(low, F.lit("nrem"), F.lit("non-rem")), F.lit("non rem"), F.lit("non-rem"))).otherwise(low)
    has = lambda *parts: reduce(lambda x, y: x & y, [F.contains(low, F.lit(p)) for p in parts])
    found = F.when(has("non-rem", "stage 4") | has("non-rem", "stage 3"), "Non-REM stage 3").when(has("non-rem", "stage 2"), "Non-REM stage 2").when(has("non-rem", "stage 1"), "Non-REM stage 1")
    found = found.when(has("rem", "sleep"), "REM sleep").when(low.isin("wake", "awake"), "Wake").when(has("movement") | low.isin("mov", "mt"), "Movement")
    for label in labels:
        found = found.when(low == label.lower(), label)
    return F.coalesce(found, text)


def stage_supported(c: Column, labels: tuple[str, ...] = STAGES) -> Column:
    """whether what own_stage_label finds is one of the labels."""
    return own_stage_label(c, labels).isin(*labels)


def stage_of_code(c: Column) -> Column:
    """a short code's stage, lower case; other texts as they are, lower case and stripped; null gives the empty text."""
    t = strip(F.lower(F.coalesce(c, F.lit(""))))
    return F.coalesce(mapped(t, STAGE_OF_CODE), t)


def shown_code(c: Column) -> Column:
    """the name that a plot shows for a code; null for another text."""
    return mapped(c, SHOWN_CODES)


def path_identifier(c: Column) -> Column:
    """last path part, `.` and `-` as `_`, runs of `_` as one."""
    return F.regexp_replace(F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"[.-]", "_"), "_+", "_")


def slug(c: Column) -> Column:
    """lower case, everything but a-z and 0-9 as `-`."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "-")


def model_base(c: Column) -> Column:
    """a model's name without owner and `-SP`/`-Flamingo` at its end."""
    return F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"(?i)[-_](sp|flamingo)$", "")


def model_config(c: Column) -> Column:
    """Which kind of model a name means by its end."""
    low = F.lower(c)
    return F.when(F.endswith(low, F.lit("flamingo")), "flamingo").when(F.endswith(low, F.lit("sp")), "sp")


def formatter_kind(c: Column) -> Column:
    """2.14: `openai-` names and those with gpt use the gpt number format, all others the llama one."""
    low = F.lower(c)
    return F.when(F.startswith(low, F.lit("openai-")) | F.contains(low, F.lit("gpt")), "gpt").otherwise("llama")


def simulation_size(c: Column) -> tuple[Column, Column]:
    """length and number of series of `Simulation-L<d>-N<d>`; null if the text doesn't start like that."""
    part = lambda k: F.nullif(F.regexp_extract(c, r"^Simulation-L(\d+)-N(\d+)", k), F.lit("")).cast("int")
    return part(1), part(2)


def task_name(c: Column) -> Column:
    """F10."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"(?s)Predict the (.+?) Answer:", 1), F.lit("")), F.lit("unknown"))


# The sentences of a prompt that are rewritten.
STATED, PLAIN = r"This is the time series, it has mean (-?\d+\.\d{4}) and std (-?\d+\.\d{4})\.", "This is the time series:"
AXIS_DATA = r"The following is the accelerometer data on the [xyz]-axis\n([\-0-9, ]+)"


def without_statistics(c: Column) -> Column:
    """a sentence that states mean and deviation of a series, to four decimals, becomes one that doesn't."""
    return F.regexp_replace(c, STATED, PLAIN)


def without_axis_data(c: Column) -> Column:
    """the numbers of an axis and the sentence before them go."""
    return F.regexp_replace(c, AXIS_DATA, "")


def prompt_numbers(c: Column) -> Column:
    """the integers of the first bracket list in a text."""
    return F.transform(F.filter(F.split(F.regexp_extract(c, r"\[([-\d,\s]+)\]", 1), r"[,\s]+"), lambda x: x != ""), lambda x: x.cast("int"))


def between(c: Column, marker: str, default: str) -> Column:
    """from a marker to the next empty line, else to the end of the line; a default without the marker."""
    tail = F.substring(c, 1, 2**31 - 1)
    tail = F.substr(tail, F.locate(marker, c) + len(marker))
    cut = F.when(F.contains(tail, F.lit("\n\n")), F.substring_index(tail, "\n\n", 1)).otherwise(F.substring_index(tail, "\n", 1))
    return F.when(F.contains(c, F.lit(marker)), strip(cut)).otherwise(default)


def sample_id(template: Column, sample: Column) -> Column:
    """F14."""
    return F.format_string("T%02d_S%d", template, sample)


def preview(c: Column, n: int) -> Column:
    """F14."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def pair_key(a: Column, b: Column) -> Column:
    """the same key for both orders."""
    return F.concat(F.least(a, b), F.lit(" ↔ "), F.greatest(a, b))


def response_kind(c: Column) -> Column:
    """`Yes` is positive, `Some` or `Used some` inside is partial, all else negative."""
    return F.when(F.startswith(c, F.lit("Yes")), "positive").when(F.contains(c, F.lit("Some")) | F.contains(c, F.lit("Used some")), "partial").otherwise("negative")


def with_end(c: Column, eos: str) -> Column:
    """the end token once at the end."""
    return F.when(F.endswith(c, F.lit(eos)), c).otherwise(F.concat(c, F.lit(eos)))


#: Fixed value: what stands for a token that no loss is taken of.
IGNORED = -100


def label_mask(ids: Column, prompt: Column, padding: int) -> Column:
    """The token ids that a loss is taken of; those of the prompt and padding are IGNORED."""
    return F.transform(ids, lambda x, i: F.when((i < prompt) | (x == padding), F.lit(IGNORED)).otherwise(x))


def fitted(c: Column, width: int) -> Column:
    """cut and padded to a width."""
    return F.rpad(F.left(c, F.lit(width)), width, " ")


def path_of_record(id_: Column) -> Column:
    """`21000/21837_hr` for 21837."""
    return F.concat(F.lpad(((id_ / 1000).cast("long") * 1000).cast("string"), 5, "0"), F.lit("/"), F.lpad(id_.cast("string"), 5, "0"), F.lit("_hr"))


# The parts of a context sentence.
NO_RECORD = "12-lead ECG recording. Signal quality adequate for analysis."
LEAD_TEXT, DATED, ADEQUATE = "12-lead ECG", "clinical recording", "adequate for analysis"
QUALITY = {"baseline_drift": "baseline drift noted", "static_noise": "static noise present", "burst_noise": "burst noise present", "electrodes_problems": "electrode artifacts present"}
EXTRA = {"extra_beats": "extra beats detected during recording", "pacemaker": "pacemaker present"}


def context_sentence(record: dict[str, Column], found: Column | None = None, nan_is_truthy: bool = False) -> Column:
    """F16: what is known of a record. `record` has columns age, sex, recording_date, device and those of QUALITY and
    EXTRA; one that is left out is unknown. Where `found` is false the sentence is NO_RECORD.

    Columns of QUALITY count if they hold more than blanks, those of EXTRA if they aren't empty; with
    `nan_is_truthy` missing ones count too (Q6). The first two parts have a blank between them, the others `. `."""
    get = lambda name: record.get(name, F.lit(None)).cast("string")
    counts = lambda name, text: F.when(F.coalesce(text != "", F.lit(nan_is_truthy)) if name in record else F.lit(False), F.lit({**QUALITY, **EXTRA}[name]))
    noted = F.concat_ws(", ", *[counts(n, strip(get(n))) for n in QUALITY])
    device = strip(get("device"))
    age, sex = record.get("age", F.lit(None)).cast("double"), record.get("sex", F.lit(None)).cast("double")
    parts = F.array_compact(
        F.array(
            F.when(age.isNotNull() & ~F.isnan(age), F.concat(age.cast("long").cast("string"), F.lit("-year-old"))),
            F.when(sex.isNotNull() & ~F.isnan(sex), F.when(sex == 1, "male patient").otherwise("female patient")),
            F.lit(LEAD_TEXT),
            F.when(get("recording_date").isNotNull(), DATED),
            F.when((device != "") & (device != "nan"), F.concat(F.lit("recorded with "), device)),
            F.concat(F.lit("Signal quality: "), F.when(noted != "", noted).otherwise(ADEQUATE)),
            *[counts(n, get(n)) for n in EXTRA],
        )
    )
    sentence = F.concat(F.array_join(F.slice(parts, 1, 2), " "), F.lit(". "), F.array_join(F.slice(parts, 3, 99), ". "), F.lit("."))
    return sentence if found is None else F.when(found, sentence).otherwise(NO_RECORD)
