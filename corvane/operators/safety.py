"""Requests and answers held to safety rules: the rule of highest severity counts, the first of equals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITY = {"allow": 0, "warn": 1, "escalate": 2, "block": 3}
# Request patterns by rule.
REQUEST_PATTERNS = {
    "bypass-interlock": r"(?i)\b(bypass|jumper|jump|defeat|disable|override|tape\s+over)\b.{0,40}\b(door|lock|interlock|lid|safety\s+switch)\b|\b(door|lock|interlock|lid|safety\s+switch)\b.{0,40}\b(bypass|jumper|jump|defeat|disable|override)\b",
    "defeat-safety-device": r"(?i)\b(defeat|disable|remove|bypass)\b.{0,40}\b(safety|interlock|thermal\s+fuse)\b|\brun\s+without\b.{0,20}\b(door|lid|interlock)\b",
    "live-voltage": r"(?i)\b(measure|check|test)\b.{0,30}\b(voltage|120\s*v|240\s*v|vac|live)\b|\b(voltage|120\s*v|240\s*v|vac)\b.{0,30}\b(measure|measurement|check|test)\b|\blive\s+voltage\b|\bwith\s+power\s+on\b|\benergized\b",
    "control-board-service": r"(?i)\b(replace|remove|install|swap)\b.{0,30}\b(acu|control\s+board|main\s+control|ccu)\b|\bdisassemble\b",
    "panel-access": r"(?i)\b(remove|take\s+off)\b.{0,20}\b(rear|front|top|bottom|service)\s+panel\b",
    "service-test-procedure": r"(?i)\bTEST\s*#\s*\d+\b.{0,60}\b(step|steps|perform|run|do|how|procedure)\b|\b(how|steps?|perform|run)\b.{0,60}\bTEST\s*#\s*\d+\b",
    "stored-energy": r"(?i)\b(discharge|bleed)\b.{0,30}\bcapacitor\b|\bcapacitor\b.{0,40}\b(discharge|shock|stored\s+energy)\b",
    "tip-over-service": r"(?i)\b(tip|lay|turn|place)\b.{0,25}\b(washer|dryer|machine|appliance)\b.{0,40}\b(on\s+(its\s+)?(side|back)|upside\s*down)\b",
    "water-line-mod": r"(?i)\b(cut|drill|splice|modify)\b.{0,30}\b(drain\s+hose|inlet\s+hose|water\s+line)\b|\b(drain\s+hose|inlet\s+hose)\b.{0,30}\b(cut|drill|splice|modify)\b",
    "reset-and-power": r"(?i)\b(unplug|disconnect\s+power|cycle\s+power|hard\s+reset)\b",
}
# Fixed values: (audience, rule, action) in order.
REQUEST_RULES = [
    *((a, r, "block") for a in ("owner", "technician") for r in ("bypass-interlock", "defeat-safety-device")),
    *(("owner", r, "escalate") for r in ("live-voltage", "control-board-service", "panel-access", "service-test-procedure", "stored-energy", "tip-over-service", "water-line-mod")),
    ("owner", "reset-and-power", "warn"), ("technician", "live-voltage", "warn"), ("technician", "panel-access", "warn"),
]
# Patterns of answers and evidence.
FORBIDDEN_OUTPUT = r"(?i)\b(bypass|jumper|jump\s+the|defeat\s+the)\b.{0,40}\b(door|lock|interlock)\b"
OWNER_PROCEDURE = r"(?is)\bTEST\s*#\s*\d+\b.{0,240}\b(\d+\.\s|step\s+\d+|measure|multimeter|VAC|120\s*v)\b|\b(measure|multimeter)\b.{0,60}\b(VAC|voltage|120\s*v|240\s*v)\b"
UNSAFE_PROCEDURE = r"(?is)(\bstep\s+\d+\b|\b\d+\.\s|\bthen\s+(measure|remove|replace|disconnect|test)\b).{0,120}\b(voltage|120\s*v|panel|acu|control\s+board|multimeter|disassemble)\b"
SERVICE_EVIDENCE = r"(?i)FOR\s+SERVICE\s+TECHNICIAN|\bTEST\s*#\s*\d+\b|\blive\s+voltage\b|\btech[\s_-]?sheet\b|\bservice\s+manual\b"
PROCEDURE = r"(?i)(?:^|\n)\s*\d+\.\s+\S.{8,}|\bstep\s+\d+\b|\b(measure|multimeter|remove the|replace the|disconnect the)\b"
#: A streamed answer holds back as much as a hazard may span.
HOLD_BACK = 320


def severity(action: Column) -> Column:
    out = F.lit(0)
    for name, n in SEVERITY.items():
        out = F.when(action == name, n).otherwise(out)
    return out


def assess(requests: DataFrame) -> DataFrame:
    """requests(request_id, audience, question) with `action` and `rule_id` (allow where no rule speaks, empty for no text)."""
    best, rule = F.lit("allow"), F.when(F.trim(F.coalesce("question", F.lit(""))) == "", "empty").otherwise("allow")
    for audience, name, action in _weakest_first():
        met = (F.coalesce("audience", F.lit("owner")) == audience) & F.coalesce("question", F.lit("")).rlike(REQUEST_PATTERNS[name])
        best, rule = F.when(met, action).otherwise(best), F.when(met, name).otherwise(rule)
    return requests.withColumn("action", best).withColumn("rule_id", rule)


def _weakest_first() -> list[tuple[str, str, str]]:
    """Rules such that each overrules all before it: by severity, of equals the first one last."""
    return [r for _, r in sorted(enumerate(REQUEST_RULES), key=lambda x: (SEVERITY[x[1][2]], -x[0]))]


def raised(own: Column, other: Column) -> Column:
    """A second opinion may only raise the severity."""
    return F.when(severity(other) > severity(own), other).otherwise(own)


def output_hazard(audience: Column, action: Column, rule: Column, answer: Column) -> Column:
    """The rule that an answer breaks, or null."""
    text, owner = F.trim(F.coalesce(answer, F.lit(""))), audience == "owner"
    return F.when(text.rlike(FORBIDDEN_OUTPUT), "output-bypass").when(owner & text.rlike(OWNER_PROCEDURE), "owner-tech-procedure").when(owner & (action == "escalate") & text.rlike(UNSAFE_PROCEDURE), rule)


def needs_citation(answer: Column) -> Column:
    """Whether an answer describes a procedure without citing anything."""
    text = F.trim(F.coalesce(answer, F.lit("")))
    return ~F.upper(text).rlike("^(ABSTAIN:|BLOCK:|ESCALATE:)") & ~text.rlike(r"\[\d+\]") & text.rlike(PROCEDURE)


def gate(answers: DataFrame) -> DataFrame:
    """answers(audience, action, rule_id, answer) with gate_action and gate_rule: what is released, and by which rule."""
    hazard = output_hazard(F.col("audience"), F.col("action"), F.col("rule_id"), F.col("answer"))
    a = answers.withColumn("hazard", hazard)
    bare = needs_citation(F.col("answer"))
    act = F.when(F.col("action") == "block", "block").when(F.col("hazard") == "output-bypass", "block").when(F.col("hazard").isNotNull(), "escalate").when(bare, "ungrounded").otherwise(F.col("action"))
    rule = F.when(F.col("action") == "block", F.col("rule_id")).when(F.col("hazard").isNotNull(), F.col("hazard")).when(bare, "ungrounded-procedure").otherwise(F.col("rule_id"))
    return a.withColumn("gate_action", act).withColumn("gate_rule", rule)


def may_stream(audience: Column, action: Column) -> Column:
    return (action != "block") & ~((audience == "owner") & (action == "escalate"))


def mentions_service_literature(evidence: Column) -> Column:
    return F.coalesce(evidence, F.lit("")).rlike(SERVICE_EVIDENCE)


def released_prefix(deltas: DataFrame, key: str = "answer_id", order: str = "n", hold_back: int = HOLD_BACK) -> DataFrame:
    """Of a streamed answer, how many characters are safe to show after each piece: key, order, received, released.

    Nothing more is shown from the first piece on with which the text so far breaks the rule against bypasses.
    Text is released up to a space, `hold_back` characters before what was received.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    so_far = F.array_join(F.collect_list("piece").over(w), "")
    d = deltas.withColumn("text", so_far)
    d = d.withColumn("bad", F.col("text").rlike(FORBIDDEN_OUTPUT)).withColumn("stopped", F.max("bad").over(w))
    safe = F.left("text", F.greatest(F.length("text") - hold_back, F.lit(0)))
    cut = F.length(safe) - F.coalesce(F.nullif(F.locate(" ", F.reverse(safe)), F.lit(0)) - 1, F.length(safe))
    d = d.withColumn("cut", F.when(~F.col("stopped"), cut))
    return d.select(key, order, F.length("text").alias("received"), F.coalesce(F.max("cut").over(w), F.lit(0)).alias("released"))
