"""Whole assignments of streams of many bins, memory and smoothing included, against a plain loop."""

import random
from decimal import ROUND_HALF_EVEN, Decimal

from shotlens.plans.targets import GENERIC, PRIORITY, TargetRules, assignments

CAND = "sequence_id string, shot_id string, local_track_id string, bin_idx long, candidate_type string, candidate_id string, candidate_global_person_id string, candidate_cast_pid string, candidate_identity_confidence double, total_score double"
BINS = "sequence_id string, shot_id string, shot_idx int, local_track_id string, bin_idx long, bin_start_sec double, gaze_quality string, gaze_angle_x_mean double, pose_Ry_mean double"


def even(x, digits=6):
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_EVEN))


def loop(bins, cands, active, aligned, rules):
    """(status before and after smoothing, reason, type, id, confidence, smoothed) of each bin of one stream in order."""
    last, rows = "", []
    for b in bins:
        ranked = sorted(((s, PRIORITY.get(k, 0), i, k, conf) for k, i, conf, s in cands[b[0]] if k != "unknown"), reverse=True)
        top = ranked[0][0] if ranked else 0.0
        margin = even(top - (ranked[1][0] if len(ranked) > 1 else 0.0))
        reason = "gaze_quality_unknown" if b[1] == "unknown" else "no_candidate" if not ranked else "low_score" if top < rules.least_score else "low_margin" if len(ranked) > 1 and margin < rules.ambiguous_margin else "assigned"
        chosen = ranked[0] if reason == "assigned" else None
        if reason == "low_margin":
            near = [c for c in ranked if even(top - c[0]) < rules.ambiguous_margin]
            key = lambda c: (2 if c[2] in active else 1 if c[2] in aligned else 0, c[4], int(bool(last) and c[2] == last), int(c[3] not in GENERIC), c[1])  # noqa: B023, E731
            best = sorted(near, key=key, reverse=True)
            if len(best) == 1 or key(best[0]) > key(best[1]):
                chosen, reason = best[0], "assigned"
        last = chosen[2] if chosen else last
        status = {"assigned": "assigned", "low_margin": "ambiguous", "low_score": "rejected"}.get(reason, "unknown")
        low = reason == "low_margin"
        rows.append([status, reason, "ambiguous" if low else chosen[3] if chosen else "unknown", ranked[0][2] if low else chosen[2] if chosen else "unknown", top if low else chosen[0] if chosen else 0.0])
    out = []
    for i, (status, reason, kind, ident, conf) in enumerate(rows):
        p, n = (rows[i - 1], rows[i + 1]) if 0 < i < len(rows) - 1 else (None, None)
        if status in ("unknown", "ambiguous") and p and p[0] == n[0] == "assigned" and p[2:4] == n[2:4]:
            out.append((status, "assigned", "assigned", p[2], p[3], even(min(p[4], n[4]) * 0.9), 1))
        else:
            out.append((status, status, reason, kind, ident, conf, 0))
    return out


def test_streams_of_many_bins(spark):
    rng, rules = random.Random(11), TargetRules(ambiguous_margin=0.10)
    kinds = [("offscreen_participant", "A"), ("offscreen_participant", "B"), ("onscreen_local_track", "trk_001"), ("current_speaker", "C"), ("down_self_or_think", "down_self_or_think"), ("offscreen_place_or_away", "offscreen_place_or_away"), ("unknown", "unknown")]
    bins, cands, want = [], [], {}
    active, aligned = ["A", "B"], ["C"]
    for stream in ("trk_000", "trk_002", "trk_003"):
        mine = {i: [(k, c, rng.choice([0.0, 0.5]), rng.choice([0.3, 0.6, 0.62, 0.65, 0.7, 0.9])) for k, c in rng.sample(kinds, rng.choice([0, 1, 2, 3, 4]))] for i in range(80)}
        own = [(i, rng.choice(["gaze_reliable"] * 5 + ["unknown"])) for i in range(80)]
        bins += [("q", "s1", 1, stream, i, i / 2, q, 0.0, 0.0) for i, q in own]
        cands += [("q", "s1", stream, i, k, c, "", "", conf, s) for i, x in mine.items() for k, c, conf, s in x]
        want |= {(stream, i): r for (i, _), r in zip(own, loop(own, mine, active, aligned, rules), strict=True)}
    rng.shuffle(bins)
    ids = spark.createDataFrame([("s1", "trk_000", "g", "p", "", "", 0.9)], "shot_id string, local_track_id string, global_person_id string, cast_pid string, character_name string, cast_name string, identity_confidence double")
    shots = spark.createDataFrame([("q", "s1", 1, "two_person_dialogue_simple", aligned, active)], "sequence_id string, shot_id string, shot_idx int, stage_type string, aligned_speakers array<string>, active_speakers array<string>")
    out = assignments(spark.createDataFrame(bins, BINS), spark.createDataFrame(cands, CAND), ids, shots, rules).collect()
    got = {(r["local_track_id"], r["bin_idx"]): (r["raw_proxy_status"], r["proxy_status"], r["failure_reason"], r["target_type"], r["target_id"], r["proxy_confidence"], r["smoothing_applied"]) for r in out}
    assert got == want
    assert sum(r[6] for r in want.values()) > 3 and len({r["proxy_source"] for r in out}) == 3
