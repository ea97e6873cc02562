"""Cue sheets: arc segments to lyrics, arc checks, unit scripts, automation, requests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from .timeline import arc_tags

#: What a unit without a stated emotion or arousal has.
NEUTRAL, MIDDLE = "neutro", 0.5


#: How a voice reads an emotion.
INSTRUCTIONS: Mapping[str, str] = {
    "neutro": "Tone: Neutral. Rhythm: Moderate. Attitude: Factual.",
    "neutral": "Tone: Neutral. Rhythm: Moderate. Attitude: Factual.",
    "tensione": "Tone: Tense. Rhythm: Slow. Attitude: Detached.",
    "suspense": "Tone: Tense. Rhythm: Slow. Attitude: Detached.",
    "paura": "Tone: Dark. Rhythm: Slow. Attitude: Hesitant.",
    "fear": "Tone: Dark. Rhythm: Slow. Attitude: Hesitant.",
    "tristezza": "Tone: Melancholic. Rhythm: Slow. Attitude: Intimate.",
    "sadness": "Tone: Melancholic. Rhythm: Slow. Attitude: Intimate.",
    "gioia": "Tone: Bright. Rhythm: Moderate. Attitude: Conversational.",
    "joy": "Tone: Bright. Rhythm: Moderate. Attitude: Conversational.",
    "rabbia": "Tone: Dark. Rhythm: Fast. Attitude: Authoritative.",
    "anger": "Tone: Dark. Rhythm: Fast. Attitude: Authoritative.",
    "curiosità": "Tone: Bright. Rhythm: Moderate. Attitude: Factual.",
    "curiosity": "Tone: Bright. Rhythm: Moderate. Attitude: Factual.",
}
#: The narrator's tone for a block's emotion, and that for any other.
NARRATOR_TONES: Mapping[str, str] = {
    "tensione": "Low, unhurried chest voice. The narrator speaks with exhausted clarity — detached but not cold, like someone describing a world they know too well.",
    "tristezza": "Soft, low chest voice. Measured pace with slight weight on stressed syllables. No warmth — intimate but restrained.",
    "gioia": "Lighter chest voice, moderate pace. Slightly open mouth quality. Conversational but controlled.",
    "paura": "Hushed, tight chest voice. Short breath. Words clipped at the edges. Very slow.",
    "rabbia": "Clipped, low voice. Hard consonants. Fast but deliberate. Jaw barely moving.",
    "curiosità": "Slightly rising intonation at end of phrases. Mid-chest register. Moderate pace.",
    "determinazione": "Chest voice, firm and forward. Consistent pace without hesitation. No emotional colour.",
}
OTHER_TONE = "Low, unhurried chest voice. Measured and detached."
#: The music for a unit's emotion.
MUSIC: Mapping[str, str] = {
    "gioia": "Musica solare, positiva, chitarra acustica, pianoforte leggero",
    "tristezza": "Musica malinconica, archi dolci, tempo lento, pianoforte solo",
    "tensione": "Suspense, archi bassi, ritmi sincopati, tensione cinematografica",
    "relax": "Calma, suoni ambientali, pad eterei, atmosfera rilassata",
    "neutro": "Texture ambientale discreta, sottofondo narrativo neutro",
}
#: Models that make assets, short effects apart.
EFFECT_KINDS, EFFECT_MODEL, MUSIC_MODEL = ("amb", "sfx", "sting"), "audiocraft-medium", "acestep-1.5-xl-sft"


def _named(table: Mapping[str, str], key: Column, default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for item in table.items() for v in item]), key), F.lit(default))


def voice_instruction(emotion: Column) -> Column:
    return _named(INSTRUCTIONS, F.lower(emotion), INSTRUCTIONS["neutro"])


def narrator_tone(stated: Column, emotion: Column) -> Column:
    """The stated tone, or that of the emotion."""
    return F.coalesce(X.falsy_to_null(stated), _named(NARRATOR_TONES, F.lower(emotion), OTHER_TONE))


def music_prompt(emotion: Column) -> Column:
    return _named(MUSIC, emotion, MUSIC["neutro"])


def asset_model(kind: Column) -> Column:
    return F.when(kind.isin(*EFFECT_KINDS), EFFECT_MODEL).otherwise(MUSIC_MODEL)


def voice_backend(model: Column, known: Sequence[str], default: str) -> Column:
    """The first of `known` whose name the model's name holds (in any case), or the default."""
    return F.coalesce(*[F.when(F.contains(F.lower(model), F.lit(k)), k) for k in known], F.lit(default))


def reading_instruction(tone: Column, rhythm: Column, attitude: Column, stated: Column, fallback: Column) -> Column:
    """Prose from a triple of tone, rhythm and attitude where all three are given, else the stated instruction, else the fallback."""
    prose = F.concat(
        F.lit("Read with a "), F.lower(tone), F.lit(" tone. Maintain a "), F.lower(rhythm), F.lit(" pacing throughout. The delivery should be "), F.lower(attitude), F.lit(".")
    )
    return F.coalesce(prose, X.falsy_to_null(stated), fallback)


def spoken_units(texts: DataFrame, text: str, most_words: int = 60, title_pause_ms: int = 2000) -> DataFrame:
    """texts with (unit, kind, unit_text, words, pause_ms): a text split by its quotes. Double quotes are dialogue, single quotes (not apostrophes
    inside words) thought, a first line that is a book, chapter or part title stands alone with a long pause, the rest is narration; no unit has more
    than `most_words` words. Such rules are usually left to a model's prompt; these are a plain stand-in."""
    title = F.regexp_extract(text, "(?i)^\\s*((?:capitolo|chapter|parte|part|libro|book)\\s[^\\n]*)", 1)
    body = F.substring(F.col(text), F.length(F.regexp_extract(text, "(?i)^(\\s*(?:capitolo|chapter|parte|part|libro|book)\\s[^\\n]*)", 1)) + 1, F.length(text))
    inside = "[\\p{L}\\p{N}]"
    pieces = F.regexp_extract_all(body, F.lit(f"\"[^\"]*\"|(?<!{inside})'[^']*'(?!{inside})|(?:[^\"']|(?<={inside})')+|[\"']"), F.lit(0))
    listed = F.concat(F.when(title != "", F.array(title)).otherwise(F.array().cast("array<string>")), pieces)
    rows = texts.withColumn("__title", title != "").select("*", F.posexplode(listed).alias("__at", "__piece"))
    first = F.substring("__piece", 1, 1)
    kind = F.when((F.col("__at") == 0) & F.col("__title"), "title").when(first == '"', "dialogue").when(first == "'", "thought").otherwise("narration")
    inner = F.when(kind.isin("dialogue", "thought"), F.translate("__piece", "\"", "")).otherwise(F.col("__piece"))
    words = F.regexp_extract_all(F.when(kind == "thought", F.regexp_replace(inner, "^'|'$", "")).otherwise(inner), F.lit(f"[^{X.SPACE}]+"), F.lit(0))
    rows = rows.withColumn("kind", kind).withColumn("__words", words).where((F.size("__words") > 0) & ((F.col("kind") != "narration") | F.exists("__words", lambda w: w.rlike(inside))))
    cuts = F.sequence(F.lit(0), F.floor((F.size("__words") - 1) / most_words).cast("int"))
    rows = rows.select("*", F.explode(cuts).alias("__cut"))
    part = F.slice("__words", F.col("__cut") * most_words + 1, F.lit(most_words))
    return rows.select(
        *texts.columns, F.col("__at").alias("piece"), F.col("__cut").alias("part"), "kind", F.array_join(part, " ").alias("unit_text"), F.size(part).alias("words"), F.when(F.col("kind") == "title", title_pause_ms).otherwise(200).alias("pause_ms")
    )


def asset_listing(assets: DataFrame, group: str, asset_id: str, tags: str, description: str) -> DataFrame:
    """(group, listing): a line `- id: tags - description` for each asset of a catalogue, by id, for a prompt."""
    line = F.concat(F.lit("- "), F.col(asset_id).cast("string"), F.lit(": "), X.listed(F.col(tags)), F.lit(" - "), F.coalesce(description, F.lit("")))
    return assets.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(asset_id).alias("i"), line.alias("l")))), lambda x: x["l"]), "\n").alias("listing"))


def choose_templates(templates: DataFrame, chosen: DataFrame, name: str = "name", version: str = "version") -> DataFrame:
    """(name, version, template): the version that the configuration `chosen` (name, version) names, else the latest one."""
    latest = templates.groupBy(F.col(name).alias("__name")).agg(F.max(version).alias("__latest"))
    picked = latest.join(chosen.select(F.col(name).alias("__n"), F.col(version).alias("__v")), F.col("__name") == F.col("__n"), "left")
    wanted = picked.select("__name", F.coalesce("__v", "__latest").alias("__wanted"))
    return templates.join(wanted, (F.col(name) == F.col("__name")) & (F.col(version) == F.col("__wanted"))).select(*templates.columns)


def lyric_lines(segments: DataFrame, keys: Sequence[str], start: str = "start_s", intensity: str = "intensity", item: str = "roadmap_item", note: str = "note") -> DataFrame:
    """segments with `lyric`: `[mm:ss.ss] [Tag] description`, a second after the start; a segment without a tag of its own prints None. The
    description is the item's text, else (with an item that has none) the note, else the note or the intensity."""
    tagged = arc_tags(segments, keys, [start], intensity)
    cs = F.round((F.col(start) + 1) * 100).cast("bigint")
    clock = F.format_string("[%02d:%02d.%02d]", F.floor(cs / 6000), F.floor(cs % 6000 / 100), cs % 100)
    described = F.trim(F.regexp_extract(F.coalesce(F.col(item), F.lit("")), "\\[[\\w-]+\\]\\.\\s*(.+?)(?:\\.\\]?)?$", 1))
    level = F.coalesce(F.col(intensity), F.lit("mid"))
    plain = F.concat(F.upper(F.substring(level, 1, 1)), F.lower(F.substring(level, 2, 1_000_000)), F.lit(" section."))
    with_item = F.coalesce(X.falsy_to_null(described), F.col(note), F.lit(""))
    text = F.when(X.falsy_to_null(F.col(item)).isNotNull(), with_item).otherwise(F.coalesce(X.falsy_to_null(F.col(note)), plain))
    label = F.coalesce(F.concat(F.lit("["), F.col("tag"), F.lit("]")), F.lit("None"))
    return tagged.withColumn("lyric", F.concat(clock, F.lit(" "), label, F.lit(" "), text))


def arc_violations(duration: Column, starts: Column, ends: Column) -> Column:
    """Names of broken arc rules: the number of segments that a duration asks for, and 45 s at least for each."""
    n = F.size(starts)
    wanted = F.when(duration < 600, n == 3).when(duration <= 1800, n.between(4, 5)).otherwise(n >= 6)
    short = F.exists(F.zip_with(starts, ends, lambda a, b: b - a), lambda d: d < 45)
    return F.array_compact(F.array(F.when(~wanted, "segment_count"), F.when(short, "segment_too_short")))


def unit_scripts(units: DataFrame, keys: Sequence[str], order: str, text: str, unit_emotion: str, block_emotion: str, arousal: str) -> DataFrame:
    """units with scene_id, scene_number (from 1 in each key), emotion, energy, temperatures, estimated seconds and dialogue flag."""
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    words = X.word_count(F.col(text))
    return units.select(
        "*",
        number.alias("scene_number"),
        F.concat(F.col(keys[0]).cast("string"), F.lit("-scene-"), X.zero_pad(number)).alias("scene_id"),
        F.coalesce(F.lower(X.falsy_to_null(F.col(unit_emotion))), F.lower(X.falsy_to_null(F.col(block_emotion))), F.lit(NEUTRAL)).alias("primary_emotion"),
        X.unit_energy(F.col(arousal)).alias("energy"),
        X.unit_temperature(F.col(arousal)).alias("temperature"),
        X.unit_subtalker(F.col(arousal)).alias("subtalker_temperature"),
        F.round(X.spoken_seconds(words), 3).alias("estimated_seconds"),
        words.alias("word_count"),
        F.contains(F.col(text), F.lit('"')).alias("has_dialogue"),
    )


def with_automation(timeline: DataFrame, automation: DataFrame, unit: str, order: str, defaults: Mapping[str, object]) -> DataFrame:
    """timeline and each unit's automation: the last one by `order` wins, defaults apply where there is none."""
    last = automation.groupBy(F.col(unit).alias("__unit")).agg(F.max_by(F.struct(*defaults), order).alias("__a"))
    got = timeline.join(last, F.col(unit) == F.col("__unit"), "left")
    return got.select(*timeline.columns, *[F.when(F.col("__unit").isNull(), F.lit(v)).otherwise(F.col(f"__a.{c}")).alias(c) for c, v in defaults.items()])


def request_list(beds: DataFrame, items: DataFrame, key: str = "canonical_id", order: str = "ord") -> DataFrame:
    """Asset requests: beds before items, the first of each id, ids with a number."""
    from .ordered import first_wins

    both = beds.withColumn("rank", F.lit(0)).unionByName(items.withColumn("rank", F.lit(1)), allowMissingColumns=True)
    named = both.withColumn(key, X.with_suffix(F.col(key)))
    return first_wins(named, [key], ["rank", order]).drop("rank")
