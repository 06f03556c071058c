"""Text of subtitles and screenplays: cleaning, line classes, speakers, cues and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Screenplay vocabulary that decides results.
SHOT_PREFIXES = (
    "INT.", "EXT.", "INT/EXT.", "EXT/INT.", "I/E.", "MS", "LS", "MLS", "MCS", "CS", "CU", "MCU", "ECU", "FS", "WS", "POV",
    "PAN", "ANGLE", "CLOSE SHOT", "LONG SHOT", "MED. SHOT", "MED SHOT", "DISSOLVE TO", "FADE IN", "FADE OUT", "CUT TO",
)
TRANSITIONS = ("FADE", "CUT TO", "DISSOLVE", "INT.", "EXT.", "INT/", "EXT/")
SCENE_STARTS = ("INT.", "EXT.", "INT/EXT.", "EXT/INT.", "I/E.", "FADE IN", "FADE OUT", "CUT TO", "DISSOLVE TO")
CAMERA_CUES = ("CAMERA", "ANGLE", "POV", "PAN", "PANS", "PANNING", "TRACK", "TRACKS", "TRUCK", "TRUCKS", "DOLLY", "CLOSE[- ]?UP", "CLOSE SHOT", "WIDE SHOT", "LONG SHOT", "MEDIUM SHOT", "MS", "MCS", "MCU", "CU", "ECU", "LS")
GAZE_CUES = ("LOOKS?", "GLANCES?", "STARES?", "WATCHES?", "SEES?", "NOTICES?", "EYES?", "PEERS?", "GAZES?", "TURNS? TO", "LOOKS? AWAY", "LOOKS? DOWN", "LOOKS? UP")
MOVEMENT_CUES = ("ENTERS?", "EXITS?", "CROSSES?", "MOVES?", "WALKS?", "RUNS?", "STEPS?", "TURNS?", "FOLLOWS?", "APPROACHES?", "BACKS? AWAY", "LEANS?", "SITS?", "STANDS?")
NARRATION_CUES = ("NARRATOR", "VOICE", "VOICE OVER", "VO", "ANNOUNCER")
SINGING_CUES = ("SINGING", "SONG", "SINGS", "SUNG", "MUSIC")

_SPACE = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


def _any(words: tuple[str, ...]) -> str:
    return r"(?iu)\b(?:" + "|".join(words) + r")\b"


def _literal(words: tuple[str, ...]) -> str:
    return "|".join(w.replace(".", r"\.") for w in sorted(words, key=len, reverse=True))


def clean_line(c: Column) -> Column:
    """No byte-order mark, white space folded, trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "\\ufeff", ""), _SPACE, " "))


#: What Python's strip() takes from both ends of a text.
_STRIPPED = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def clean_text(c: Column) -> Column:
    """No-break spaces are blanks; white space at both ends goes; null becomes empty."""
    return F.btrim(F.translate(F.coalesce(c.cast("string"), F.lit("")), "\u00a0", " "), F.lit(_STRIPPED))


def indent(c: Column) -> Column:
    return F.length(c) - F.length(F.ltrim(c))


def is_noise_line(c: Column) -> Column:
    """A page number or a CONTINUED mark; a blank line is no noise."""
    return clean_text(c).rlike(r"(?i)^(?:\d+\.?|\(?CONTINUED\)?[: ]?.*)$")


def is_heading_line(c: Column) -> Column:
    return clean_line(c).rlike(r"(?iu)^(?:" + _literal(SHOT_PREFIXES) + r")(?:\b|\s|:|-|\.|/).*$")


def is_speaker_line(c: Column) -> Column:
    """Indented by 8 or more, up to 48 characters of capitals, digits and a few marks, with a letter; no transition."""
    t = clean_text(c)
    transition = F.lit(False)
    for x in TRANSITIONS:
        transition = transition | F.upper(t).startswith(x)
    return (t != "") & ~is_noise_line(c) & ~is_heading_line(c) & (indent(c) >= 8) & (F.length(t) <= 48) & t.rlike(r"^[A-Z0-9\s\-()'.#/&]+$") & t.rlike("[A-Z]") & ~transition


def is_dialogue_line(c: Column) -> Column:
    return (clean_text(c) != "") & ~is_noise_line(c) & ~is_heading_line(c) & ~is_speaker_line(c) & indent(c).between(1, 36)


def line_class(c: Column) -> Column:
    """S speaker, D dialogue, N noise, B blank, O anything else."""
    return F.when(clean_text(c) == "", "B").when(is_noise_line(c), "N").when(is_speaker_line(c), "S").when(is_dialogue_line(c), "D").otherwise("O")


def canonical_speaker(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.replace(F.upper(clean_line(c)), F.lit(" (CONT'D)"), F.lit("")), F.lit("(CONT'D)"), F.lit("")), _SPACE, " "))


def clean_speaker_name(c: Column) -> Column:
    """Without the parenthesis that ends it."""
    return F.trim(F.regexp_replace(clean_text(c), r"\s*\(.*?\)\s*$", ""))


def normalize_for_match(c: Column) -> Column:
    """No [notes] and NAME: labels; lower case; only a-z, 0-9, apostrophes and single spaces."""
    t = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\[[^\]]*\]", " ")
    t = F.lower(F.regexp_replace(t, r"\b[A-Z][A-Z'\-\s]{1,25}:\s*", " "))
    t = F.replace(F.replace(t, F.lit("..."), F.lit(" ")), F.lit("--"), F.lit(" "))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9\s']", " "), r"\s+", " "))


def join_nonblank(items: Column, sep: str) -> Column:
    return F.array_join(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != ""), sep)


def unique_join(items: Column, sep: str) -> Column:
    """Trimmed non-blank items, each once, in the order of their first place."""
    return F.array_join(F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")), sep)


def first_distinct(items: Column, k: int) -> Column:
    return F.slice(F.array_distinct(F.filter(F.transform(items, lambda x: clean_text(x)), lambda x: x != "")), 1, k)


def truncate(c: Column, most: int) -> Column:
    t = clean_text(c)
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most - 3)), F.lit("..."))).otherwise(t)


def slug(c: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(clean_text(c), r"[^A-Za-z0-9_-]+", "_"), F.lit("_")), F.lit("")), F.lit("unknown"))


def target_name(c: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.upper(clean_text(c))), F.lit("")), F.lit("UNKNOWN"))


def normalize_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]+", " "))


def normalize_label(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]", "")


def utterance_count(sentences: Column, text: Column) -> Column:
    """Non-blank sentences; without any the parts of "a | b"; else 1 or 0 for the text."""
    n = F.size(F.filter(sentences, lambda x: clean_text(x) != ""))
    t = clean_text(text)
    parts = F.size(F.filter(F.split(t, r" \| "), lambda x: F.trim(x) != ""))
    return F.when(n > 0, n).when(F.contains(t, F.lit(" | ")), parts).when(t != "", 1).otherwise(0)


def scene_headings(c: Column) -> Column:
    """Heading lines of a text, upper-cased with white space folded, in their order."""
    found = F.regexp_extract_all(c, F.lit(r"(?im)^\s*(?:" + "|".join(w.replace(".", r"\.") for w in SCENE_STARTS) + r")\b.*$"), F.lit(0))
    return F.transform(found, lambda x: F.upper(F.regexp_replace(F.trim(x), r"\s+", " ")))


def cue_count(c: Column, words: tuple[str, ...]) -> Column:
    return F.regexp_count(c, F.lit(_any(words)))


def action_score(camera: Column, gaze: Column, movement: Column, length: Column) -> Column:
    return F.least(F.lit(10.0), camera + gaze * 1.5 + movement * 0.75 + F.least(length / F.lit(240.0), F.lit(2.0)))


def visual_cues(c: Column) -> Column:
    """A struct of the cue counts, headings, scene boundaries, score and preview of a script's action text."""
    camera, gaze, movement = cue_count(c, CAMERA_CUES), cue_count(c, GAZE_CUES), cue_count(c, MOVEMENT_CUES)
    headings = scene_headings(c)
    return F.struct(
        F.bround(action_score(camera, gaze, movement, F.length(c)), 3).alias("visual_action_score"), camera.alias("camera_cue_count"), gaze.alias("gaze_verb_count"),
        movement.alias("movement_cue_count"), F.size(headings).alias("scene_heading_count"), F.greatest(F.size(F.array_distinct(headings)) - 1, F.lit(0)).alias("scene_boundary_count"),
        truncate(c, 350).alias("script_action_preview"),
    )


def is_narration(speakers: Column) -> Column:
    return F.array_join(speakers, " ").rlike(_any(NARRATION_CUES))


def is_singing(c: Column) -> Column:
    return c.rlike(_any(SINGING_CUES))


def global_person_id(pid: Column, shot: Column, track: Column) -> Column:
    local = F.concat_ws(":", shot, track)
    return F.when(F.coalesce(pid, F.lit("")) == "", F.concat(F.lit("local:"), local)).when(pid == "others", F.concat(F.lit("other:"), local)).otherwise(F.concat(F.lit("pid:"), pid))


def padded(prefix: str, digits: int, n: Column) -> Column:
    return F.concat(F.lit(prefix), F.when(F.length(n.cast("string")) >= digits, n.cast("string")).otherwise(F.lpad(n.cast("string"), digits, "0")))


def sequence_id(movie: Column, first: Column, last: Column) -> Column:
    return F.concat(movie, F.lit("_"), padded("seq_", 4, first), F.lit("_"), padded("", 4, last))


def retry_seconds(message: Column, default: float = 3.0) -> Column:
    """Delay that an error text asks for ("try again in 1.5s"), half a second at least."""
    found = F.regexp_extract(message, r"(?i)try again in ([0-9.]+)\s*s", 1)
    return F.greatest(F.coalesce(F.nullif(found, F.lit("")).try_cast("double"), F.lit(default)), F.lit(0.5))
