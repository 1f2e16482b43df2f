"""Families, vagueness and emotion of descriptions (P19), by patterns that the user may give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions import text

# Phrases of emotion, and the pattern of each family.
EMOTIONS = ("gracias mil", "favorzote", "te debo la vida", "eres el mejor")
FAMILIES = {
    "PRESTAMO": r"\b(?:prestam|adelant|deuda|abono)\b",
    "VAGUEDAD": r"\b(?:varios|gastos|servicio|pago|consultoria|apoyo|reembolso|proyecto)\b",
}
UNDESCRIBED = "SIN_DESCRIPCION"


def describe(tx: DataFrame, column: str = "descripcion", emotions: tuple[str, ...] = EMOTIONS, families: dict[str, str] | None = None) -> DataFrame:
    """Tx with feat_nlp_vaguedad, feat_nlp_emocion and desc_flags of a text column.

    families: name -> pattern, matched against the plain text (lower case, no accents, single spaces). desc_flags are the names of those
    found, in order of name; [UNDESCRIBED] if the text is null or blank. Vagueness is hits of the family VAGUEDAD over words, at least 0.8 in texts
    of one or two words or none; without such a family there are no hits. Emotion is how many of the phrases the text holds. Every pattern is one
    expression over the column, so all are read in a single pass.
    """
    families = FAMILIES if families is None else families
    plain = F.trim(text.normalize(F.col("_text")))
    words = F.size(F.filter(F.split("_plain", " "), lambda w: w != ""))
    hits = F.regexp_count("_plain", F.lit(families["VAGUEDAD"])) if "VAGUEDAD" in families else F.lit(0)
    share = hits / F.greatest(words, F.lit(1))
    phrases = [text.plain_text(e) for e in emotions]
    felt = sum((F.contains(F.col("_plain"), F.lit(e)).cast("double") for e in phrases), F.lit(0.0))
    named = [F.when(F.col("_plain").rlike(rx), F.lit(name)) for name, rx in sorted(families.items())]
    found = F.array_compact(F.array(*named)) if named else F.array().cast("array<string>")
    held = tx.withColumn("_text", F.col(column)).withColumn("_plain", plain)
    return held.withColumns({
        "feat_nlp_vaguedad": F.when(words > 2, share).otherwise(F.greatest(F.lit(0.8), share)),
        "feat_nlp_emocion": felt,
        "desc_flags": F.when(F.col("_plain") == "", F.array(F.lit(UNDESCRIBED))).otherwise(found),
    }).drop("_text", "_plain")
