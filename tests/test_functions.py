"""Column functions and operators against values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from shotlens.functions import text as T
from shotlens.functions import timecode as C
from shotlens.functions.geometry import body_score, box, centre_distance, cosine, iou, scale_box, unit
from shotlens.functions.jsonish import id_list, json_object, parse_cell, parse_list
from shotlens.functions.numeric import direction_bucket, even_int, finite_float, safe_float


@pytest.fixture(scope="module")
def one(spark):
    row = spark.range(1).cache()
    return lambda *cols: (lambda r: r[0] if len(cols) == 1 else list(r))(row.select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).head())


def b(x1, y1, x2, y2):
    return box(*(F.lit(float(v)) for v in (x1, y1, x2, y2)))


def test_numbers(one):
    assert one(*(safe_float(F.lit(x), -1.0) for x in ("1.5", "x", "nan", None))) == [1.5, -1.0, -1.0, -1.0]
    assert one(safe_float(F.lit("inf")), finite_float(F.lit("inf"))) == [math.inf, None]
    assert one(*(direction_bucket(F.lit(x), 0.2) for x in ("-0.21", "-0.20", "0.20", "0.21", "nan", ""))) == ["left", "center", "center", "right", "unknown", "unknown"]
    assert one(even_int(F.lit(5.0)), even_int(F.lit(0.4)), even_int(F.lit(-3.0), 0), even_int(F.lit(6.5))) == [4, 2, 0, 6]


def test_times(one):
    assert one(C.sec_to_hms(F.lit(3723.5)), C.sec_to_hms(F.lit(None).cast("double")), C.hms_to_sec(F.lit("01:02:03,5")), C.hms_to_sec(F.lit("x"))) == ["01:02:03.500", "", 3723.5, None]
    assert one(C.bin_index(F.lit(0.25 + 0.5), 0.5), C.bin_index(F.lit(0.3), 0.1), C.sec_to_frame(F.lit(1.02), F.lit(25.0))) == [1, 2, 26]


def test_boxes(one):
    a, c = b(0, 0, 100, 100), b(10, 0, 110, 100)
    assert [round(x, 6) for x in one(iou(a, c), centre_distance(a, c, F.lit(640), F.lit(360)))] == [0.818182, 0.013618]
    body = b(0, 0, 100, 200)
    assert [round(x, 6) for x in one(*(body_score(f, body) for f in (b(40, 20, 60, 40), b(200, 20, 220, 40), b(90, 150, 110, 170))))] == [0.978571, 0.0, 0.55]
    assert one(scale_box(a, F.lit(0), F.lit(1), F.lit(1), F.lit(1))) is None
    v = F.array(F.lit(3.0), F.lit(4.0))
    assert one(cosine(unit(v), unit(v)), cosine(unit(F.array(F.lit(0.0))), unit(v))) == [pytest.approx(1.0), -1.0]


def test_lists(one):
    assert one(*(parse_list(F.lit(x)) for x in ('["a","b"]', "['a']", "a | b", "a", "", None))) == [["a", "b"], ["a"], ["a", "b"], ["a"], [], []]
    assert one(parse_cell(F.lit('["a"," "]')), parse_cell(F.lit("a|| b")), json_object(F.lit('x ```{"a": {}} ``` y')), json_object(F.lit("none"))) == [["a"], ["a", "b"], '{"a": {}}', None]
    assert id_list("a, b") == ["a", "b"] and id_list("auto") is None and id_list("") is None


def test_text(one):
    assert one(T.clean_line(F.lit("﻿ a  b\t")), T.normalize_for_match(F.lit("[x] JOHN: It's -- O.K...")), T.clean_speaker_name(F.lit("DOROTHY (V.O.)")), T.canonical_speaker(F.lit(" dorothy (CONT'D)"))) == ["a b", "it's o k", "DOROTHY", "DOROTHY"]
    assert one(*(T.line_class(F.lit(x)) for x in ("          DOROTHY (CONT'D)", "     Hello", "     12.", "", "     stray words", "INT. HOUSE", "          FADE OUT", "(CONTINUED)", "no indent"))) == ["S", "D", "N", "B", "D", "O", "O", "N", "O"]
    assert one(T.global_person_id(F.lit("nm1"), F.lit("s"), F.lit("t")), T.global_person_id(F.lit("others"), F.lit("s"), F.lit("t")), T.global_person_id(F.lit(""), F.lit("s"), F.lit("t")), T.padded("shot_", 4, F.lit(7)), T.padded("shot_", 4, F.lit(12345))) == ["pid:nm1", "other:s:t", "local:s:t", "shot_0007", "shot_12345"]
    assert one(T.utterance_count(F.array(F.lit("a"), F.lit(" ")), F.lit("")), T.utterance_count(F.array().cast("array<string>"), F.lit("a | b")), T.retry_seconds(F.lit("try again in 0.1s")), T.retry_seconds(F.lit(""))) == [1, 2, 0.5, 3.0]
    v = one(T.visual_cues(F.lit("FADE IN: HOUSE\nShe looks at him. CAMERA PANS.\nEXT.ROAD\nHe walks. \nINT. a word has to come")))
    assert (v["scene_heading_count"], v["scene_boundary_count"], v["gaze_verb_count"], v["camera_cue_count"], v["movement_cue_count"]) == (2, 1, 1, 2, 1)
    assert one(T.truncate(F.lit("abcdefghij"), 8), T.truncate(F.lit("abc"), 8)) == ["abcde...", "abc"]
