"""Driver tables seen as library tables.

Every column is a function of the row, with no random numbers and no clock.
Spark prunes what a query does not use, so the costlier columns (hash,
fingerprint) are only computed where they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pictorium.functions.hashing import content_sha256, long_to_hex, token_fingerprint
from pictorium.functions.rules import grade_by_confidence
from pictorium.plans.skew import shuffled

EPOCH = "timestamp_ntz'2024-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _after(amount: str, unit: str) -> Column:
    return F.expr(f"{EPOCH} + ({amount}) * interval '1' {unit}")


def confidence(doc_id: str = "doc_id") -> Column:
    return ((F.col(doc_id) * 37) % 100) / F.lit(100.0)


def _status() -> Column:
    return (
        F.when(F.col("source").isin("src3", "src11"), F.lit("failed"))
        .when(F.col("source").isin("src5", "src17"), F.lit("pending"))
        .otherwise(F.lit("completed"))
    )


def assets(spark: SparkSession, sf_dir: str, fingerprint: bool = False, moved: bool = True) -> DataFrame:
    """The picture catalog, from documents and their labels.  ``fingerprint``
    adds ``phash``, and moves the labels by a shuffle, unless ``moved`` leaves that to Catalyst."""
    return assets_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fingerprint, moved)


def assets_of(docs: DataFrame, labels: DataFrame, fingerprint: bool = False, moved: bool = True) -> DataFrame:
    """:func:`assets` of any frame of documents, a stream as well."""
    toxic = labels.select("doc_id", "toxic")
    if fingerprint:  # worked out before the join, which then moves words in place of texts
        docs = docs.withColumn("phash", long_to_hex(token_fingerprint(F.col("text"))))
        toxic = shuffled(toxic) if moved else toxic
    joined = docs.join(toxic, "doc_id", "left")
    name = F.concat(F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))
    tags = F.array("lang", "source")
    status = _status()
    conf = confidence()
    return joined.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("/lib/"), F.col("source"), F.lit("/"), name).alias("file_path"),
        name.alias("file_name"),
        F.col("n_chars").alias("file_size"),
        content_sha256(F.col("text")).alias("file_hash"),
        (F.lit(640) + F.lit(160) * (F.col("doc_id") % 7)).cast("int").alias("width"),
        (F.lit(480) + F.lit(120) * (F.col("doc_id") % 5)).cast("int").alias("height"),
        *(["phash"] if fingerprint else []),
        status.alias("ai_status"),
        F.when(F.col("toxic") == 0, F.concat(tags, F.array(F.lit("clean")))).otherwise(tags).alias("ai_tags"),
        F.col("text").alias("ai_description"),
        F.when(F.col("source") != "src9", F.col("lang")).alias("ai_category"),
        conf.alias("ai_confidence"),
        F.when(status == "completed", _after("doc_id % 30", "day")).alias("ai_processed_at"),
        F.when(status == "failed", F.lit("timeout")).alias("ai_error_message"),
        F.when(status == "failed", F.col("doc_id") % 5).otherwise(0).cast("int").alias("ai_retry_count"),
        F.col("source"),
        _after("doc_id", "minute").alias("created_at"),
        F.when(F.col("lang") == "de", F.lit("generator")).alias("generation_source"),
        grade_by_confidence(conf).alias("ai_tag_status"),
    )


def vec_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pictorium.functions.hashing import mean_threshold_hash

    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select(F.col("vec_id").alias("id"), mean_threshold_hash(F.col("embedding")).alias("phash"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def cal_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cal_samples_of(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


def cal_samples_of(labels: DataFrame, docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "lang")
    return labels.join(docs, "doc_id").select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("predicted_category"),
        confidence().alias("confidence"),
        (F.col("quality") == 1).alias("is_correct"),
    )


def narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pictorium.functions.entities import extract_entities

    told = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    when = F.expr(f"{EPOCH} + conv_id * interval '1' hour + turn * interval '1' minute")
    return told.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.col("conv_id").alias("image_id"),
        F.col("text").alias("content"),
        extract_entities(F.col("text")).alias("entities"),
        when.alias("created_at"),
        when.alias("updated_at"),
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = (
        F.when(F.col("event_type") == "error", F.lit("ERROR"))
        .when(F.col("event_type") == "purchase", F.lit("{WARN}"))
        .otherwise(F.lit("INFO"))
    )
    full = F.concat_ws(
        " ",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
        level,
        F.concat(F.lit("user."), F.col("user_id").cast("string")),
        F.concat(F.col("event_type"), F.lit(" props="), F.col("props")),
    )
    # a signup writes one short line without the four fields
    line = F.when(F.col("event_type") == "signup", F.concat(F.lit("signup "), F.col("user_id").cast("string"))).otherwise(full)
    return table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("seq"), line.alias("line"))


def error_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return error_events_of(table(spark, sf_dir, "events"))


def error_events_of(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_type") == "error").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("pattern_name"), "ts")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work attempts: one item per user and day; purchases succeed."""
    return attempts_of(table(spark, sf_dir, "events"))


def attempts_of(events: DataFrame) -> DataFrame:
    item = F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    return events.select(item.alias("item"), "ts", (F.col("event_type") == "purchase").alias("ok"))


def ai_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model answer per document, the whole text being its description: fenced, broken or
    incomplete for some."""
    docs = table(spark, sf_dir, "documents")
    array = F.to_json(F.array(F.coalesce("text", F.lit(""))))  # ["…"] with the escapes of JSON
    told = F.substr(array, F.lit(2), F.length(array) - 2)
    conf = F.when(F.col("doc_id") % 7 == 0, F.lit("")).when(
        F.col("doc_id") % 5 == 0, F.lit(',"confidence":"0.5"')
    ).otherwise(F.concat(F.lit(',"confidence":0.'), F.lpad((F.col("doc_id") * 37 % 100).cast("string"), 2, "0")))
    body = F.concat(
        F.lit('{"tags":["'), F.col("lang"), F.lit('",7,"'), F.col("source"), F.lit('"],"category":"'),
        F.col("lang"), F.lit('","description":'), told, conf,
        F.when(F.col("doc_id") % 11 == 0, F.lit("")).otherwise(F.lit("}")),
    )
    fenced = F.concat(F.lit("```json\n"), body, F.lit("\n```"))
    return docs.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, fenced).otherwise(body).alias("raw"))


# header bytes by language for the files to import; es has a format we refuse
_EXT = {"en": "jpg", "fr": "png", "de": "gif", "es": "svg"}
_HEAD = {"en": "FFD8FFE0", "fr": "89504E470D0A1A0A", "de": "474946383961", "es": "3C737667"}


def incoming_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files waiting for import: ``(seq, path, length, content)``.  Source src7
    has wrong headers, src8 climbs out of its folder, src9 is empty."""
    return incoming_of(table(spark, sf_dir, "documents"))


def incoming_of(docs: DataFrame) -> DataFrame:
    def pick(values, other):
        chain = None
        for lang, v in values.items():
            chain = F.when(F.col("lang") == lang, F.lit(v)) if chain is None else chain.when(F.col("lang") == lang, F.lit(v))
        return chain.otherwise(F.lit(other))

    head = F.when(F.col("source") == "src7", F.lit("00000000")).otherwise(pick(_HEAD, "00000000"))
    body = F.concat(F.unhex(head), F.col("text").cast("binary"))
    content = F.when(F.col("source") == "src9", F.unhex(F.lit(""))).otherwise(body)
    folder = F.when(F.col("source") == "src8", F.lit("/in/../")).otherwise(F.lit("/in/"))
    path = F.concat(folder, F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), pick(_EXT, "bin"))
    rows = docs.select(F.col("doc_id").alias("seq"), path.alias("path"), content.alias("content"))
    return rows.select("seq", "path", F.octet_length("content").cast("long").alias("length"), "content")


def cjk_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chinese narratives: literal sentences, one per document by the length
    of its text, followed by that text."""
    docs = table(spark, sf_dir, "documents")
    texts = F.array(*[F.lit(t) for t in NOTES])
    at = (F.col("n_chars") % len(NOTES)).cast("int")
    return docs.select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("image_id"), F.concat(F.get(texts, at), F.lit(" "), F.col("text")).alias("content")
    )


NOTES = [
    "我和小明一起去公园玩",
    "去年我们去旅行",
    "周三开会",
    "一张风景照",
    "星期五跟小红在北京吃饭，昨天到上海",
    "今年从南京走，与老王和小李",
]

# category, tags, description
JUDGED = [
    ("animal", ["狗", "宠物"], "一只狗在草地上"),
    ("animal", ["建筑", "桥梁"], "一只狗"),
    ("动物", ["狗", "彩色", "高清"], "毛茸茸的宠物"),
    ("person", ["笑容"], "城市中的桥梁建筑风景"),
    ("风景", ["山", "海边"], "这是一张照片"),
    ("美食", ["拉面"], "一碗拉面"),
    ("document", [], "扫描的文字"),
    ("architecture", ["塔", "室内", "tower"], "高塔与大厦"),
]


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model judgements: a literal case per document by its text length, its
    description followed by the whole text, with the document's confidence."""
    docs = table(spark, sf_dir, "documents")
    cases = F.array(
        *[
            F.struct(
                F.lit(c).alias("category"),
                F.array(*[F.lit(t) for t in tags]).cast("array<string>").alias("tags"),
                F.lit(d).alias("description"),
            )
            for c, tags, d in JUDGED
        ]
    )
    case = F.get(cases, (F.col("n_chars") % len(JUDGED)).cast("int"))
    rows = docs.select(F.col("doc_id").alias("id"), confidence().alias("confidence"), case.alias("case"), "text")
    told = F.concat_ws(" ", "case.description", "text")
    return rows.select("id", "confidence", "case.category", "case.tags", told.alias("description"))


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections: the tag ``fixed`` added to the pictures of four sources."""
    chosen = assets(spark, sf_dir).filter(F.col("source").isin("src1", "src2", "src3", "src4"))
    new = F.concat("ai_tags", F.array(F.lit("fixed")))
    return chosen.select("id", F.col("id").alias("image_id"), F.col("ai_tags").alias("old_tags"), new.alias("new_tags"), F.col("created_at").alias("corrected_at"))


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key/value rows from the nations: base values."""
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"), F.col("n_nationkey").cast("long").alias("version")
    )
