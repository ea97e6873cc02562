"""Scalar expressions over columns. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as a scripting language's split() sees it.
SPACE = "\\p{IsWhite_Space}\\x{1c}-\\x{1f}"
#: Roman numerals 1 to 30 are computed by this table of parts.
ROMAN_PARTS = ((10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))
#: Number words that head sections.
NUMBER_WORDS: Mapping[str, int] = {
    "uno": 1, "due": 2, "tre": 3, "quattro": 4, "cinque": 5, "sei": 6, "sette": 7, "otto": 8, "nove": 9, "dieci": 10,
    "undici": 11, "dodici": 12, "tredici": 13, "quattordici": 14, "quindici": 15, "sedici": 16, "diciassette": 17,
    "diciotto": 18, "diciannove": 19, "venti": 20, "ventuno": 21, "ventidue": 22, "ventitré": 23, "ventitre": 23,
    "ventiquattro": 24, "venticinque": 25, "ventisei": 26, "ventisette": 27, "ventotto": 28, "ventinove": 29, "trenta": 30,
    "primo": 1, "secondo": 2, "terzo": 3, "quarto": 4, "quinto": 5, "sesto": 6, "settimo": 7, "ottavo": 8, "nono": 9, "decimo": 10,
    "undicesimo": 11, "dodicesimo": 12, "tredicesimo": 13, "quattordicesimo": 14, "quindicesimo": 15, "sedicesimo": 16,
    "diciassettesimo": 17, "diciottesimo": 18, "diciannovesimo": 19, "ventesimo": 20,
}
#: An addition of this engine: English number words.
ENGLISH_NUMBER_WORDS: Mapping[str, int] = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10,
}
#: Parts of error messages that mean a passing fault; that ask for a retry; that ask for a pause.
TRANSIENT = ("503", "unavailable", "high demand", "429", "timeout", "network")
RETRY = ("503", "unavailable", "high demand", "timeout", "network")
PAUSE = ("429", "resource_exhausted", "quota_exhausted")


def falsy_to_null(x: Column, empty="") -> Column:
    """Null for a value that counts as missing in an `a or b` chain."""
    return F.nullif(x, F.lit(empty))


def first_truthy(*xs: Column) -> Column:
    """The first column that is neither null nor an empty string."""
    return F.coalesce(*[falsy_to_null(x) for x in xs])


def normalize_id(x: Column) -> Column:
    """Slug: the extension goes, lower case, anything but letters and digits becomes one underscore; empty or null: `unknown`."""
    stem = F.regexp_replace(x, "(?s)^((?:.*/)?\\.*[^./][^/]*)\\.[^./]*$", "$1")
    slug = F.regexp_replace(F.regexp_replace(F.lower(stem), "[^a-zA-Z0-9]+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(x, F.lit("")) == "", "unknown").otherwise(slug)


def word_count(x: Column) -> Column:
    """Words between runs of Unicode white space; empty and null: 0."""
    return F.coalesce(F.regexp_count(x, F.lit(f"[^{SPACE}]+")), F.lit(0))


def collapse(x: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(x, "\\s+", " ")))


def roman(n: int) -> str:
    out = ""
    for value, part in ROMAN_PARTS:
        while n >= value:
            out, n = out + part, n - value
    return out


def _lookup(table: Mapping[str, int], key: Column) -> Column:
    return F.create_map(*[F.lit(v) for item in table.items() for v in item])[key]


def roman_to_int(x: Column) -> Column:
    """1 to 30 for Roman numerals of any case, else null."""
    return F.try_element_at(F.create_map(*[F.lit(v) for n in range(1, 31) for v in (roman(n), n)]), F.upper(x))


def parse_ordinal(x: Column) -> Column:
    """A number word, a Roman numeral or digits (with closing colons, points or commas) as an integer, else null."""
    key = F.regexp_replace(F.lower(x), "[:.,]+$", "")
    words = F.create_map(*[F.lit(v) for item in {**ENGLISH_NUMBER_WORDS, **NUMBER_WORDS}.items() for v in item])
    return F.coalesce(F.try_element_at(words, key), roman_to_int(key), F.trim(key).try_cast("int"))


def token_estimate(n_chars: Column) -> Column:
    return (n_chars / F.lit(3.8)).cast("int")


def retry_delay(message: Column) -> Column:
    """Seconds named in an error message plus 5, or 65."""
    digits = F.regexp_extract(message, "retryDelay[\"']?\\s*:\\s*[\"']?(\\d+)", 1)
    return F.coalesce(F.nullif(digits, F.lit("")).try_cast("int") + 5, F.lit(65))


def fill_template(template: Column, values: Mapping[str, Column]) -> Column:
    """Literal `{name}` placeholders, replaced one after another (an inserted value may hold a later placeholder)."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def format_template(template: Column, values: Mapping[str, Column]) -> Column:
    """A format string: `{name}` is replaced, doubled braces are literal ones, inserted values are left as they are."""
    marks = {name: chr(0xE010 + k) for k, name in enumerate(values)}
    out = F.replace(template, F.lit("{{"), F.lit("\ue000"))
    for name, mark in marks.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.lit(mark))
    out = F.replace(F.replace(out, F.lit("}}"), F.lit("}")), F.lit("\ue000"), F.lit("{"))
    for name, value in values.items():
        out = F.replace(out, F.lit(marks[name]), F.coalesce(value.cast("string"), F.lit("")))
    return out


def output_name(collection: Column, block: Column, scene: Column, custom: Column, stamp: Column) -> Column:
    """File name of a stage's output: the normalised collection and the parts that are there, joined by `-`; a block that begins
    with the collection is not doubled."""
    slug = normalize_id(collection)
    head = F.when(F.coalesce(block, F.lit("")) == "", slug).when(F.startswith(block, F.concat(slug, F.lit("-"))), block).otherwise(F.concat(slug, F.lit("-"), block))
    return F.concat(F.concat_ws("-", head, falsy_to_null(scene), falsy_to_null(custom), stamp), F.lit(".json"))


def heading_pauses(x: Column) -> Column:
    """A point and an empty line after `Capitolo Word` and `Libro Word`, no more than one empty line anywhere."""
    for word in ("Capitolo", "Libro"):
        x = F.regexp_replace(x, f"\\b({word}\\s+[A-Za-zÀ-ÿ]+)\\b(?!\\.)", "$1.")
        x = F.regexp_replace(x, f"\\b({word}\\s+[A-Za-zÀ-ÿ]+\\.)\\s*(?!\\n\\n)", "$1\n\n")
    for title in ("Capitolo Primo", "Libro Primo"):
        x = F.replace(x, F.lit(title + ":"), F.lit(title + "."))
    return F.regexp_replace(F.regexp_replace(x, "\\n{3,}", "\n\n"), f"^[{SPACE}]+|[{SPACE}]+$", "")


def quoted_list(items: Column) -> Column:
    """Items in double quotes, joined by commas."""
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", ")


def listed(items: Column) -> Column:
    """A list of strings as a scripting language prints it: `['a', 'b']`."""
    return F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))


def job_id(**parts: Column) -> Column:
    """`job-` and 12 hex digits of the SHA-256 of the `key:value` pairs in key order, joined by `|`."""
    joined = F.concat_ws("|", *[F.concat(F.lit(f"{k}:"), v.cast("string")) for k, v in sorted(parts.items())])
    return F.concat(F.lit("job-"), F.substring(F.sha2(joined, 256), 1, 12))


def asset_job_id(kind: Column, key: Column) -> Column:
    return F.concat(F.lit("d2-"), F.substring(kind, 1, 3), F.lit("-"), F.substring(F.md5(key.cast("binary")), 1, 10))


def cache_key(model: Column, prompt: Column) -> Column:
    return F.md5(F.concat(model, F.lit(":"), prompt).cast("binary"))


def motif_id(x: Column) -> Column:
    return F.translate(F.replace(F.lower(x), F.lit(" "), F.lit("_")), "'.", "")


def base_id(x: Column) -> Column:
    return F.regexp_replace(x, "_\\d+$", "")


def with_suffix(x: Column) -> Column:
    """`_01` is added to an id without a numeric suffix."""
    return F.when(x.rlike("_\\d+$"), x).otherwise(F.concat(x, F.lit("_01")))


def parent_key(x: Column, parts: int = 2, by: str = "-") -> Column:
    return F.substring_index(x, by, parts)


def zero_pad(x: Column, width: int = 3) -> Column:
    """Pads with zeros and never truncates."""
    return F.format_string(f"%0{width}d", x)


def minutes_seconds(seconds: Column) -> Column:
    s = seconds.cast("bigint")
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


def hours_minutes_seconds(ms: Column) -> Column:
    s = F.floor(ms / 1000)
    h, m, sec = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, sec)).otherwise(F.format_string("%d:%02d", m, sec))


def db_to_linear(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def linear_to_db(x: Column) -> Column:
    return 20 * F.log10(F.greatest(x, F.lit(1e-10)))


def seconds_to_samples(s: Column, rate: int = 44_100) -> Column:
    return (s * rate).cast("bigint")


def spoken_seconds(words: Column, per_minute: float = 150.0) -> Column:
    return words / F.lit(per_minute) * 60


def unit_energy(arousal: Column) -> Column:
    return F.round(F.lit(0.4) + 0.5 * F.coalesce(arousal, F.lit(0.5)), 3)


def unit_temperature(arousal: Column) -> Column:
    return F.round(F.lit(0.6) + 0.2 * unit_energy(arousal), 3)


def unit_subtalker(arousal: Column) -> Column:
    return F.round(F.lit(0.3) + 0.4 * F.coalesce(arousal, F.lit(0.5)), 3)


def heuristic_score(rms: Column, pitch_std: Column, silence: Column) -> Column:
    """1, less 0.3 for little energy, 0.2 for flat pitch, 0.2 for much silence; at least 0.1."""
    cut = lambda test, by: F.when(test, F.lit(by)).otherwise(F.lit(0.0))
    return F.round(F.greatest(F.lit(0.1), F.lit(1.0) - cut(rms < 0.01, 0.3) - cut(pitch_std < 5, 0.2) - cut(silence > 0.4, 0.2)), 2)


def timeout_seconds(kind: Column) -> Column:
    return F.when(kind == "bed", 7200).when(kind == "motif", 1500).otherwise(900)


def ensure_prefix(x: Column, prefix: str) -> Column:
    return F.when(F.startswith(F.lower(x), F.lit(prefix.lower())), x).otherwise(F.concat(F.lit(prefix), x))


def is_transient(message: Column, marks: tuple[str, ...] = TRANSIENT) -> Column:
    """Whether a message (in any case) holds one of the marks."""
    return F.coalesce(reduce(or_, [F.contains(F.lower(message), F.lit(m)) for m in marks]), F.lit(False))


def error_action(message: Column) -> Column:
    """`pause` for exhausted quotas, else `retry` for passing faults, else `fail`."""
    return F.when(is_transient(message, PAUSE), "pause").when(is_transient(message, RETRY), "retry").otherwise("fail")


def retry_job_id(job: Column, attempt: Column) -> Column:
    """The job id of a repeated attempt: `_r{n}` for the n-th retry, the id itself before any."""
    return F.when(attempt > 0, F.concat(job, F.lit("_r"), attempt.cast("string"))).otherwise(job)


def stage_status(done: Column, total: Column) -> Column:
    return F.when(done == 0, "pending").when(done >= total, "done").otherwise("in_progress")


def friendly_title(x: Column) -> Column:
    """Underscores become spaces, the first letter is capitalised."""
    spaced = F.replace(x, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 1_000_000))


def title_case(x: Column) -> Column:
    """Every letter that follows a non-letter is upper case, all others lower case (so also after an apostrophe)."""
    parts = F.regexp_extract_all(F.lower(x), F.lit("\\p{L}+|[^\\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000))), "")


def shell_quote_path(x: Column) -> Column:
    return F.replace(x, F.lit("'"), F.lit("'\\''"))


def arc_line(position: Column, event: Column) -> Column:
    return F.concat(F.lit("At ~"), (position * 100).cast("int").cast("string"), F.lit("%: "), event)


def bullet_list(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")
