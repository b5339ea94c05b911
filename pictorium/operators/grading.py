"""Model output: parsing, consistency, grading, result application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pictorium.functions import fixed_values as V
from pictorium.functions import rules

_BLANKS = " \t\n\r\f\v\u0085      　"


def strip_fence(text: Column) -> Column:
    """Without a Markdown fence: the first and last of two or more lines."""
    lines = F.split(text, "\r?\n")
    inner = F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
    single = F.regexp_replace(F.regexp_replace(text, "^(?:```json)+", ""), r"(?:```)+\z", "")
    return F.when(~text.startswith("```"), text).when(F.size(lines) >= 2, inner).otherwise(single)


def parse_ai_response(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Adds ``tags``, ``description``, ``category``, ``confidence``, ``error``.

    Only string elements count as tags, only numbers as confidence; what is
    missing gets its default, and text that is no JSON sets ``error``.
    """
    content = strip_fence(F.btrim(F.col(column), F.lit(_BLANKS)))
    parsed = raw.withColumn("_json", F.try_parse_json(content))
    doc = F.col("_json")

    def text_at(path: str, default: str) -> Column:
        value = F.try_variant_get(doc, path, "variant")
        is_text = F.schema_of_variant(value) == "STRING"
        return F.coalesce(F.when(is_text, F.try_variant_get(doc, path, "string")), F.lit(default))

    found = F.try_variant_get(doc, "$.tags", "array<variant>")
    texts = F.filter(found, lambda v: F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False)))
    tags = F.coalesce(F.transform(texts, lambda v: F.try_variant_get(v, "$", "string")), F.array().cast("array<string>"))
    number = F.try_variant_get(doc, "$.confidence", "variant")
    numeric = F.schema_of_variant(number).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    confidence = F.coalesce(F.when(numeric, F.try_variant_get(doc, "$.confidence", "double")), F.lit(0.5))
    bad = doc.isNull()
    return parsed.select(
        *raw.columns,
        F.when(~bad, tags).alias("tags"),
        F.when(~bad, text_at("$.description", "No description")).alias("description"),
        F.when(~bad, text_at("$.category", "other")).alias("category"),
        F.when(~bad, confidence).alias("confidence"),
        F.when(bad, F.lit("not valid JSON")).alias("error"),
    )


def split_parsed(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    return parsed.filter(F.col("error").isNull()).drop("error"), parsed.filter(F.col("error").isNotNull())


def check_consistency(df: DataFrame, strict: bool = True) -> DataFrame:
    """Adds ``conflicts`` and ``has_conflicts`` to rows with ``category``,
    ``tags`` and ``description``."""
    found = rules.check_all(rules.normalize_category(F.col("category")), F.col("tags"), F.col("description"), strict)
    return df.withColumn("conflicts", found).withColumn("has_conflicts", F.size("conflicts") > 0)


def grade_results(df: DataFrame, strict: bool = True) -> DataFrame:
    grade = rules.grade(F.col("category"), F.col("confidence"), F.col("tags"), F.col("description"), strict)
    graded = df.withColumn("tag_status", grade)
    return graded.withColumn("is_correct", rules.derive_is_correct(F.col("tag_status"), F.col("confidence")))


def apply_results(assets: DataFrame, results: DataFrame, processed_at: Column) -> DataFrame:
    """Set the AI columns of assets that have a result ``(id, tags,
    description, category, confidence, tag_status)``; they become completed."""
    new = results.select(
        "id",
        F.lit(True).alias("_hit"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("_ai_tags"),
        F.coalesce("description", F.lit("")).alias("_ai_description"),
        F.coalesce("category", F.lit("")).alias("_ai_category"),
        F.coalesce("confidence", F.lit(0.0)).alias("_ai_confidence"),
        F.coalesce("tag_status", F.lit("provisional")).alias("_ai_tag_status"),
        F.lit("completed").alias("_ai_status"),
        processed_at.alias("_ai_processed_at"),
        F.lit("").alias("_ai_error_message"),
    )
    joined = assets.join(new, "id", "left")
    return joined.select(
        *[
            F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if f"_{c}" in new.columns else F.col(c)
            for c in assets.columns
        ]
    )


def apply_failures(assets: DataFrame, failures: DataFrame, max_attempts: int = V.MAX_ATTEMPTS) -> DataFrame:
    """One failed attempt per row ``(id, error)``: back to pending with a
    backoff of ``2^n`` seconds, or failed for good.  Adds ``backoff_ms``."""
    joined = assets.join(failures.select("id", F.lit(True).alias("_hit"), F.col("error").alias("_error")), "id", "left")
    attempt = F.coalesce("ai_retry_count", F.lit(0)) + 1
    again = attempt < max_attempts
    changed = {
        "ai_status": F.when(again, F.lit("pending")).otherwise(F.lit("failed")),
        "ai_error_message": F.col("_error"),
        "ai_retry_count": attempt,
    }
    columns = [
        F.when(F.col("_hit"), changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in assets.columns
    ]
    backoff = F.when(F.col("_hit") & again, (F.pow(F.lit(2), attempt) * 1000).cast("long"))
    return joined.select(*columns, backoff.alias("backoff_ms"))


def top_predictions(rows: DataFrame, scores: str, labels: list[str], n: int) -> DataFrame:
    """The n best labels of a score array, best first, plus ``label`` and
    ``confidence`` of the best.  Sorted inside the row: no shuffle."""
    names = F.array(*[F.lit(x) for x in labels]) if labels else F.array().cast("array<string>")
    pairs = F.transform(F.col(scores), lambda s, i: F.struct((-s.cast("double")).alias("neg"), i.alias("index")))
    best = F.slice(F.array_sort(pairs), 1, n)
    named = F.transform(
        best,
        lambda p: F.struct(
            F.coalesce(F.get(names, p["index"]), F.concat(F.lit("class_"), p["index"].cast("string"))).alias("label"),
            (-p["neg"]).alias("confidence"),
        ),
    )
    out = rows.withColumn("predictions", F.when(F.size(scores) > 0, named).otherwise(F.slice(named, 1, 0)))
    first = F.get(F.col("predictions"), F.lit(0))
    return out.withColumn("label", F.coalesce(first["label"], F.lit("unknown"))).withColumn(
        "confidence", F.coalesce(first["confidence"], F.lit(0.0))
    )


def decode_detections(rows: DataFrame, values: str, width: str, height: str, threshold: float, keep: list[str]) -> DataFrame:
    """Stride-15 detector output to one row per detection: box scaled from
    640 units to the picture size, five landmarks, confidence."""
    v = F.col(values)
    sx, sy = F.col(width) / 640.0, F.col(height) / 640.0
    count = F.floor(F.size(v) / 15).cast("int")

    def at(i: Column, k) -> Column:
        return F.element_at(v, i * 15 + k + 1).cast("double")

    def one(i: Column) -> Column:
        marks = F.array(*[F.struct((at(i, 4 + 2 * j) * sx).alias("x"), (at(i, 5 + 2 * j) * sy).alias("y")) for j in range(5)])
        return F.struct(
            i.cast("long").alias("detection"),
            (at(i, 0) * sx).alias("x"),
            (at(i, 1) * sy).alias("y"),
            ((at(i, 2) - at(i, 0)) * sx).alias("box_width"),
            ((at(i, 3) - at(i, 1)) * sy).alias("box_height"),
            marks.alias("landmarks"),
            at(i, 14).alias("confidence"),
        )

    found = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), one))
    return rows.select(*keep, F.inline(found)).filter(F.col("confidence") >= threshold)


def backfill_tag_status(assets: DataFrame) -> DataFrame:
    """Missing grades: rejected when pending or failed, else provisional."""
    default = F.when(F.col("ai_status").isin("pending", "failed"), F.lit("rejected")).otherwise(F.lit("provisional"))
    return assets.withColumn("ai_tag_status", F.coalesce("ai_tag_status", default))
