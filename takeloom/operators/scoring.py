"""Hypotheses scored against references: the verbatim text, the script, or both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takeloom.functions import text, wer
from takeloom.operators import keyed, validate


def scored(manifest: DataFrame, hypotheses: DataFrame, references: tuple[str, ...] = ("verbatim", "script"), strict: bool = True) -> DataFrame:
    """Each hypothesis (utt_id, hypothesis) with its manifest row and, per reference <r>_text, <r>_substitutions, _deletions, _insertions, _reference_length, _wer and _alignment.

    A hypothesis without a manifest row raises (strict) or is left out; the manifest may hold more. Keys repeated on either side raise. The
    hypothesis is normalised once, whatever the number of references; a NULL text counts as one without words.
    """
    if strict:
        for df, name in ((manifest, "manifest"), (hypotheses, "hypotheses")):
            validate.gate(validate.duplicates(df, ["utt_id"]), f"repeated utt_id in {name}")
        validate.gate(hypotheses.select("utt_id").join(manifest.select("utt_id"), "utt_id", "left_anti"), "hypotheses not in the manifest")
    rows = keyed.joined_excluding(manifest, hypotheses.select("utt_id", "hypothesis"), "utt_id")
    lead = rows.columns
    for r in ("hypothesis", *(f"{r}_text" for r in references)):
        rows = rows.withColumn(f"_{r}", F.coalesce(text.normalize(r), F.array().cast("array<string>")))
    out = rows
    for r in references:
        out = out.withColumn(f"_{r}_a", wer.align(f"_{r}_text", "_hypothesis"))
    columns = []
    for r in references:
        a, n = F.col(f"_{r}_a"), F.size(f"_{r}_text")
        columns += [a["s"].alias(f"{r}_substitutions"), a["d"].alias(f"{r}_deletions"), a["i"].alias(f"{r}_insertions"), n.alias(f"{r}_reference_length"), wer.wer(a["s"] + a["d"] + a["i"], n).alias(f"{r}_wer"), a["alignment"].alias(f"{r}_alignment")]
    return out.select(*lead, *columns)
