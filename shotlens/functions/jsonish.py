"""Lists and objects that come as JSON, as Python literals or as plain text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_list(c: Column) -> Column:
    """array<string> of JSON ["a","b"], of a Python literal ['a'], of "a | b", of a single text; empty for null and blank."""
    t = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    listed = F.coalesce(F.from_json(t, "array<string>", {"mode": "PERMISSIVE"}), F.from_json(F.translate(t, "'", '"'), "array<string>"))
    parts = F.filter(F.transform(F.split(t, r" \| "), lambda x: F.trim(x)), lambda x: x != "")
    nothing = F.array().cast("array<string>")
    return F.when(t == "", nothing).when(t.startswith("[") & t.endswith("]") & listed.isNotNull(), listed).when(F.contains(t, F.lit(" | ")), parts).otherwise(F.array(t))


def parse_cell(c: Column) -> Column:
    """As parse_list for JSON; else the parts that "|" separates; blanks go."""
    t = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    listed = F.from_json(t, "array<string>")
    out = F.when(t.startswith("[") & listed.isNotNull(), listed).otherwise(F.split(t, r"\|"))
    return F.filter(F.transform(out, lambda x: F.trim(x)), lambda x: x != "")


def json_object(c: Column) -> Column:
    """The text from the first "{" to the last "}" (code fences and talk around an answer go); null if there is none."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


CANDIDATE = "struct<candidate_type:string,candidate_id:string,candidate_global_person_id:string,candidate_cast_pid:string,candidate_side:string,total_score:double>"


def parse_candidates(c: Column, item: str = CANDIDATE) -> Column:
    """array<struct> of a JSON list of objects; empty for blank text, bad JSON and what is no list; items that are no
    objects go."""
    each = F.from_json(F.coalesce(c, F.lit("")), "array<string>")
    objects = F.filter(F.coalesce(each, F.array().cast("array<string>")), lambda x: x.isNotNull() & F.ltrim(x).startswith("{"))
    return F.transform(objects, lambda x: F.from_json(x, item))


def stable_key(*parts: Column) -> Column:
    """A response cache's key: SHA-256 of the parts, each with its length before it."""
    text = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws("|", *(F.concat_ws(":", F.length(t).cast("string"), t) for t in text)), 256)


def id_list(text: str | None) -> list[str] | None:
    """Identifiers of "a,b"; None (no filter) for null, blank, "none", "null" and "auto"."""
    if text is None or text.strip().lower() in ("", "none", "null", "auto"):
        return None
    return [x.strip() for x in text.split(",") if x.strip()]
