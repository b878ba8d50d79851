"""START-style triage, alerts and rescue conditions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW_CONFIDENCE = 0.35
# Movement words by category, priorities and recommended actions.
MOVEMENT_WORDS = {
    "none": ["none", "absent", "still", "immobile", "unresponsive", "no_movement"],
    "involuntary": ["tremor", "seizure", "involuntary", "agonal"],
    "minimal": ["fine", "minimal", "periodic", "small"],
    "moving": ["gross", "moving", "motion"],
    "responsive": ["responsive", "voluntary", "purposeful", "walking", "walk", "ambulatory"],
}
PRIORITY = {"immediate": 1, "delayed": 2, "minor": 3, "deceased": 4, "unknown": 4}
ACTIONS = {
    "immediate": "Immediate rescue required. Prioritize extraction and prepare airway/critical-care support.",
    "delayed": "Rescue team required. Mark location and monitor for deterioration while immediate cases are handled.",
    "minor": "Lower priority. Guide to extraction if conscious and mobile.",
    "deceased": "Mark location for recovery and document the finding.",
    "unknown": "Repeat assessment with additional sensing coverage before escalation.",
}


def lookup(value: Column, table: dict) -> Column:
    out = None
    for key, result in table.items():
        out = F.when(value == key, F.lit(result)) if out is None else out.when(value == key, F.lit(result))
    return out


def movement_category(movement: Column, voluntary: Column) -> Column:
    out = F.when(voluntary, "responsive").when(movement.isNull(), "unknown")
    for category, words in MOVEMENT_WORDS.items():
        out = out.when(movement.isin(words), category)
    return out.otherwise("unknown")


def _decisions(breathing, heart, movement, category, confidence, pattern):
    """Ordered (condition, status, reason) rules; the first one that holds decides.

    Bounds and reason texts are fixed values.
    """
    nothing = breathing.isNull() & heart.isNull() & movement.isNull()
    no_vitals = (category == "none") & (breathing <= 0) & (heart.isNull() | (heart <= 0))
    f1 = lambda c: F.format_string("%.1f", c.cast("double"))
    return [
        (confidence < LOW_CONFIDENCE, "unknown", F.format_string("confidence %.2f below 0.35 threshold", confidence)),
        (nothing, "unknown", F.lit("no breathing, heart, or movement observation provided")),
        (no_vitals, "deceased", F.lit("no breathing, heartbeat, or movement detected with adequate confidence")),
        (pattern == "agonal", "immediate", F.lit("agonal breathing pattern")),
        (breathing <= 0, "immediate", F.lit("breathing absent but other signs may be present")),
        (breathing < 10, "immediate", F.concat(F.lit("respiration "), f1(breathing), F.lit(" BPM below START lower bound"))),
        (breathing > 30, "immediate", F.concat(F.lit("respiration "), f1(breathing), F.lit(" BPM above START upper bound"))),
        (heart <= 0, "immediate", F.lit("heartbeat absent")),
        (heart < 40, "immediate", F.concat(F.lit("heart rate "), f1(heart), F.lit(" BPM critically low"))),
        (heart > 130, "immediate", F.concat(F.lit("heart rate "), f1(heart), F.lit(" BPM critically high"))),
        ((category == "none") & breathing.isNotNull(), "immediate", F.lit("breathing present but no movement detected")),
        (category == "involuntary", "immediate", F.lit("only involuntary movement detected")),
        (category == "responsive", "minor", F.lit("responsive or voluntary gross movement detected")),
        (category.isin("moving", "minimal"), "delayed", F.concat(category, F.lit(" movement detected without immediate vital-sign trigger"))),
        (breathing.isNotNull() | heart.isNotNull(), "delayed", F.lit("vitals present but responsiveness is unclear")),
    ]


def status(breathing: Column, heart: Column, movement: Column, category: Column, confidence: Column, pattern: Column) -> Column:
    out = None
    for rule, value, _ in _decisions(breathing, heart, movement, category, confidence, pattern):
        out = F.when(rule, value) if out is None else out.when(rule, value)
    return out.otherwise("unknown")


def reason(breathing: Column, heart: Column, movement: Column, category: Column, confidence: Column, pattern: Column) -> Column:
    """Text of the rule that decided."""
    out = None
    for rule, _, text in _decisions(breathing, heart, movement, category, confidence, pattern):
        out = F.when(rule, text) if out is None else out.when(rule, text)
    return out.otherwise("insufficient evidence after START screening")


def priority(value: Column) -> Column:
    return lookup(value, PRIORITY)


def upgrade(value: Column) -> Column:
    return F.when(value == "minor", "delayed").when(value == "delayed", "immediate").otherwise(value)


def should_upgrade(value: Column, deteriorating: Column) -> Column:
    return deteriorating & value.isin("delayed", "minor")


def condition(breathing: Column, pattern: Column, moving: Column, has_heart: Column) -> Column:
    """Compact condition from vital signs."""
    return (
        F.when(breathing.isNotNull() & pattern.isin("agonal", "apnea"), "immediate")
        .when((breathing < 10) | (breathing > 30), "immediate")
        .when(breathing.isNotNull() & ~breathing.between(12, 24), F.when(moving, "delayed").otherwise("immediate"))
        .when(breathing.isNotNull(), F.when(moving, "minor").otherwise("delayed"))
        .when(moving | has_heart, "immediate")
        .otherwise("deceased")
    )


# Confidence of each movement class.
MOVEMENT_CONFIDENCE = {"none": 0.0, "gross": 0.9, "fine": 0.7, "tremor": 0.6, "periodic": 0.5}


def ensemble(breathing: Column, heart: Column, movement: Column) -> Column:
    """Detector ensemble; weights .5 / .3 / .2, missing parts count as zero."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return 0.5 * z(breathing) + 0.3 * z(heart) + 0.2 * z(movement)


def detected_condition(bpm: Column, pattern: Column, heart: Column, moving: Column, confidence: Column) -> Column:
    """Condition of a detection; ``bpm`` is null without breathing, the others are flags."""
    breathing = bpm.isNotNull()
    return (
        F.when(breathing & pattern.isin("agonal", "apnea"), "immediate")
        .when((bpm < 10) | (bpm > 30), "immediate")
        .when(confidence < 0.3, "unknown")
        .when(~breathing & ~heart & ~moving, "deceased")
        .when(~breathing & (heart | moving), "immediate")
        .when(~bpm.between(12, 24), F.when(moving, "delayed").otherwise("immediate"))
        .otherwise(F.when(moving, "minor").otherwise("delayed"))
    )


def vitals_confidence(breathing: Column, heart: Column, movement: Column) -> Column:
    """Weighted mean (1.5 / 1 / 1) of the confidences that are present."""
    part = lambda c, w: F.coalesce(c * w, F.lit(0.0))
    weight = lambda c, w: F.when(c.isNotNull(), F.lit(w)).otherwise(F.lit(0.0))
    total = weight(breathing, 1.5) + weight(heart, 1.0) + weight(movement, 1.0)
    return F.when(total > 0, (part(breathing, 1.5) + part(heart, 1.0) + part(movement, 1.0)) / total).otherwise(F.lit(0.0))


def escalated(level: Column) -> Column:
    """One step towards critical, which is 1."""
    return F.greatest(level - 1, F.lit(1))
