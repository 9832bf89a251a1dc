"""Models asked about every row: one tier, and two of them."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tideline.bind import TL, micro, timeline
from tideline.catalog import query
from tideline.plans import scoring
from tideline.queries.evaluation import ROUTED
from tideline.queries.joins import MICRO
from tideline.sources.staging import store


def quick_model():
    """Rejects every fourth row, is unsure of some, and confirms the rest as they are."""
    def answer(rows):
        for r in rows:
            said = "none" if r["seq"] % 4 == 0 else "perhaps" if r["seq"] % 12 == 9 else r["event_type"]
            yield "```json\n" + json.dumps({"event": said, "confidence": r["confidence"], "reasoning": f"row {r['seq']}"}) + "\n```"

    return lambda rows: list(answer(rows))


def slow_model():
    """Calls every fifth row a goal, has no answer to every seventh, and halves the confidence of the rest."""
    def answer(r):
        if r["seq"] % 7 == 0:
            return None
        return json.dumps({"event": "goal", "confidence": 0.9} if r["seq"] % 5 == 0 else {"event": r["event_type"], "confidence": r["confidence"] / 2})

    return lambda rows: [answer(r) for r in rows]


ONE, TWO = scoring.Scorer("quick-1", quick_model, batch_rows=256), scoring.Scorer("slow-1", slow_model, batch_rows=64)
INPUTS = ("seq", "event_type", "confidence")


@query("model_answers", f"""WITH {TL} SELECT stream_id, seq, CASE WHEN seq % 4 = 0 THEN 'rejected' WHEN seq % 12 = 9 THEN 'uncertain' WHEN confidence >= 0.6 THEN 'confirmed' ELSE 'uncertain' END AS result,
 CASE WHEN seq % 4 = 0 OR seq % 12 = 9 THEN NULL ELSE event_type END AS event_type, {MICRO.format("CASE WHEN seq % 4 <> 0 AND seq % 12 = 9 THEN 0.5 ELSE confidence END")} AS confidence_u, 'row ' || seq AS reasoning FROM tl""")
def model_answers(spark, sf_dir):
    """Verdicts of a model that workers ask about every row, batch by batch."""
    out = scoring.verdicts(timeline(spark, sf_dir), ONE, INPUTS, store(spark, "answers"), "tier1")
    return out.select("stream_id", "seq", "result", "event_type", micro(F.col("confidence")).alias("confidence_u"), "reasoning")


TIERS = ROUTED + f""", k AS (SELECT *, (a OR b OR c OR d OR rate > 0.5) AND seq % 7 <> 0 AS esc FROM (SELECT stream_id, seq, t, event_type, confidence, result, CASE WHEN result = 'confirmed' THEN event_type END AS kind, CASE WHEN result = 'uncertain' THEN 0.5 ELSE confidence END AS conf, a, b, c, d, rate FROM g)),
s AS (SELECT stream_id, t, arg_max(seq % 5 = 0, seq) AS goal, arg_max(event_type, seq) AS kind, arg_max(confidence / 2, seq) AS conf FROM k WHERE esc GROUP BY stream_id, t)
SELECT k.stream_id, k.seq, CASE WHEN s.t IS NULL THEN 'tier1' ELSE 'tier2' END AS tier, CASE WHEN s.t IS NULL THEN k.result ELSE 'confirmed' END AS result, CASE WHEN s.t IS NULL THEN k.kind WHEN s.goal THEN 'goal' ELSE s.kind END AS event_type,
 {MICRO.format("CASE WHEN s.t IS NULL THEN k.conf WHEN s.goal THEN 0.9 ELSE s.conf END")} AS confidence_u FROM k LEFT JOIN s ON s.stream_id = k.stream_id AND s.t = k.t"""


@query("two_tiers", TIERS)
def two_tiers(spark, sf_dir):
    """A quick model for all rows, a slow one for those in doubt, whose word counts."""
    rows = timeline(spark, sf_dir).withColumn("motion", F.col("x").cast("double"))
    out = scoring.two_tiers(rows, ONE, TWO, INPUTS, store(spark, "tiers"), ["kickoff"], least=0.0)
    return out.select("stream_id", "seq", "tier", "result", "event_type", micro(F.col("confidence")).alias("confidence_u"))
