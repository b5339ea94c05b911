"""Single operators against small hand-made rows."""

import pytest
from pyspark.sql import functions as F

from pictorium.functions import entities, files, hashing, redact, rules, text
from pictorium.operators import catalog, curation, dedup, grading, ingest, logs, metrics, search, similarity
from pictorium.sources import sinks, tables


def one(spark, **columns):
    """Evaluate named Column expressions over a single row."""
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).head()


def lit(x):
    return F.lit(x)


def strings(values):
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def test_hamming_hex(spark):
    row = one(
        spark,
        a=hashing.hamming_hex(lit("00"), lit("00")),
        b=hashing.hamming_hex(lit("ff"), lit("00")),
        c=hashing.hamming_hex(lit("f0"), lit("0f")),
        d=hashing.hamming_hex(lit("00"), lit("0000"), on_bad="null"),
        e=hashing.hamming_hex(lit("f" * 40), lit("0" * 40)),
    )
    assert tuple(row) == (0, 8, 8, None, 160)
    with pytest.raises(Exception, match="differ in length"):
        one(spark, x=hashing.hamming_hex(lit("zz"), lit("00")))


def test_similarity_and_phash(spark):
    assert [hashing.resolve_distance(p) for p in (90, 70, 95)] == [6, 19, 3]
    assert hashing.resolve_distance() == 10 and hashing.resolve_distance(None, 4) == 4 and hashing.resolve_distance(95, 4) == 3
    row = one(spark, a=hashing.phash_to_long(lit("f" * 32)), b=hashing.phash_to_long(lit("xyz"), "null"), c=hashing.similarity_to_hamming(90))
    assert tuple(row) == (-1, None, 6)
    with pytest.raises(Exception, match="not a hex"):
        one(spark, x=hashing.phash_to_long(lit("nothex")))


def test_mean_threshold_hash(spark):
    row = one(
        spark,
        a=hashing.mean_threshold_hash(F.array(*[lit(float(i)) for i in range(8)])),
        b=hashing.mean_threshold_hash(F.array().cast("array<double>")),
        c=hashing.mean_threshold_hash(F.array(*[lit(1.0)] * 10)),
    )
    assert tuple(row) == ("0f", "0" * 16, "ffc0")


def scan_rows(spark, rows):
    columns = "id long, phash string, ai_status string, file_size long, width int, height int, file_path string"
    full = [(i, h, s, z, w, t, f"/p/{i}.jpg") for i, h, s, z, w, t in rows]
    return spark.createDataFrame(full, columns)


def simple(spark, *hashes, status="completed"):
    return scan_rows(spark, [(i + 1, h, status, 10, 1, 1) for i, h in enumerate(hashes)])


def groups(assets, radius):
    scan = dedup.scan_duplicates(assets, radius)
    return sorted(r["size"] for r in scan.groups().collect()), scan


@pytest.mark.parametrize(
    "hashes,radius,want",
    [
        (("0000000000000000", "ffffffffffffffff"), 10, []),
        (("0000000000000000", "000000000000000f"), 10, [2]),
        (("0000000000000000", "0000000000000006", "00000000000000ff"), 6, [3]),
        (("0000000000000000", "000000000000000a", "00000000000000ff"), 1, []),
        (("0000000000000000", "000000000000000a", "00000000000000ff"), 2, [2]),
        (("0000000000000000", "000000000000000a", "00000000000000ff"), 10, [3]),
        (("0000000000000000",), 10, []),
    ],
)
def test_scan(spark, hashes, radius, want):
    assert groups(simple(spark, *hashes), radius)[0] == want


def test_scan_ignores_pending_and_blank(spark):
    rows = [(1, "00", "pending", 1, 1, 1), (2, "00", "completed", 1, 1, 1), (3, None, "completed", 1, 1, 1), (4, "", "completed", 1, 1, 1)]
    sizes, scan = groups(scan_rows(spark, rows), 10)
    assert sizes == [] and scan.total == 1


def test_dedup_end_to_end(spark):
    rows = [
        (1, "0000000000000000", "completed", 3_000_000, 4000, 3000),
        (2, "0000000000000001", "completed", 1_000_000, 1920, 1080),
        (3, "ffffffffffffffff", "completed", 3_000_000, 4000, 3000),
        (4, "fffffffffffffffe", "completed", 2_000_000, 1920, 1080),
        (5, "00ff00ff00ff00ff", "completed", 1_500_000, 800, 600),
    ]
    assets = scan_rows(spark, rows)
    sizes, scan = groups(assets, 10)
    assert sizes == [2, 2]
    members = scan.member_distances().drop("word").join(assets, "id")
    plan = dedup.plan_retention(members)
    assert {r["id"]: r["action"] for r in plan.collect()} == {1: "keep", 2: "delete", 3: "keep", 4: "delete"}
    assert tuple(dedup.deletion_summary(plan).head()) == (2, 2, 3_000_000, 3_000_000)
    assert tuple(dedup.deletion_summary(plan, dry_run=True).head()) == (2, 2, 0, 3_000_000)
    left = dedup.apply_deletions(plan, assets=(assets, "id"))["assets"]
    assert sorted(r["id"] for r in left.collect()) == [1, 3, 5]
    assert {r["id"] for r in dedup.recommend_keep(members).collect()} == {1, 3}


@pytest.mark.parametrize("hot,span", [(3, 4), (10**6, 1 << 20)])
def test_scan_with_a_third_identical(spark, hot, span):
    """Groups, similarity and member distances against pairwise loops."""
    import random

    rng = random.Random(11)
    base = [rng.getrandbits(64) for _ in range(4)]
    words = []
    for i in range(90):
        w = base[0] if i % 3 == 0 else rng.choice(base)
        for _ in range(0 if i % 3 == 0 else rng.randint(0, 4)):
            w ^= 1 << rng.randrange(64)
        words.append(w)
    assets = simple(spark, *[f"{w:016x}" for w in words])
    scan = dedup.DuplicateScan(assets, 3, bucket_limit=5, hot_rows=hot)
    n = len(words)
    dist = {(i, j): bin(words[i] ^ words[j]).count("1") for i in range(n) for j in range(i + 1, n)}
    near = {p: x for p, x in dist.items() if x <= 3}
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in near:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    member = {}
    for i in range(n):
        member.setdefault(find(i), []).append(i)
    want = {r + 1: m for r, m in member.items() if len(m) > 1}
    got = {r["group_id"]: (r["size"], r["similarity"]) for r in scan.groups().collect()}
    assert {g: s for g, (s, _) in got.items()} == {g: len(m) for g, m in want.items()}
    for g, m in want.items():
        inside = [x for (i, j), x in near.items() if i in m]
        assert abs(got[g][1] - (1 - sum(inside) / len(inside) / 64)) < 1e-12
    distances = {r["id"]: r["distance"] for r in scan.member_distances(span).collect()}
    expect = {}
    for m in want.values():
        for j in m:
            earlier = [i for i in range(j) if (i, j) in near]
            expect[j + 1] = near[(max(earlier), j)] if earlier else 0
    assert distances == expect


def test_tokenize(spark):
    row = one(
        spark,
        a=text.tokenize(lit("A beautiful sunset over the ocean")),
        b=text.tokenize(lit("")),
        c=text.tokenize(lit("... !!! ???")),
        d=text.tokenize(lit("高清山顶x风景abc")),
        e=text.tokenize(lit("火锅好"), words=[], unknown="pair"),
        f=text.tokenize(lit("金毛犬"), words=["金毛"]),
    )
    assert row["a"] == ["beautiful", "sunset", "over", "ocean"]
    assert row["b"] == [] and row["c"] == []
    assert row["d"] == ["高清", "山顶", "风景", "abc"]
    assert row["e"] == ["火锅", "好"] and row["f"] == ["金毛", "犬"]
    assert text.query_tokens(spark, "Cute cute CAT, the") == ["cute", "cat"]


def library(spark):
    rows = [
        (1, "/s/cat.jpg", "cat.jpg", ["cat", "pet", "cute", "animal", "fluffy"], "A cute cat sleeping", "animal", 0.9, "completed", "verified", "2024-01-01"),
        (2, "/s/peak.jpg", "peak.jpg", ["mountain", "snow"], "mountain covered in snow", "landscape", 0.9, "completed", "verified", "2024-01-02"),
        (3, "/s/toy.jpg", "toy.jpg", ["cat"], "a cat toy", "object", 0.3, "completed", "rejected", "2024-01-03"),
        (4, "/s/new.jpg", "new.jpg", ["cat"], "unseen cat", "animal", 0.9, "pending", "provisional", "2024-01-04"),
    ]
    columns = "id long, file_path string, file_name string, ai_tags array<string>, ai_description string, ai_category string, ai_confidence double, ai_status string, ai_tag_status string, created string"
    df = spark.createDataFrame(rows, columns)
    return df.withColumn("created_at", F.col("created").cast("timestamp_ntz")).drop("created")


def test_search(spark):
    assets = library(spark)
    index = search.build_index(assets)
    assert index.filter("image_id = 3").isEmpty()  # rejected pictures are not indexed
    hit = search.search(index, assets, "cute cat").collect()
    assert [(r["id"], r["match_count"], r["relevance_score"]) for r in hit] == [(1, 2, 4.0)]
    assert [r["id"] for r in search.search(index, assets, "mountain snow", category="landscape").collect()] == [2]
    assert search.search(index, assets, "mountain snow", category="animal").isEmpty()
    assert search.search(index, assets, "the of").isEmpty()
    assert [r["id"] for r in search.search(index, assets, "id 2", tags=["sno"]).collect()] == [2]
    after = search.refresh_index(index, assets.filter("id = 1").withColumn("ai_tag_status", F.lit("rejected")))
    assert after.filter("image_id = 1").isEmpty() and not after.filter("image_id = 2").isEmpty()


def test_search_fallback(spark):
    assets = library(spark)
    told = spark.createDataFrame(
        [(1, 2, "Cat at 100% speed", [("person", "cat lady")]), (2, 4, "nothing", [("person", "100% lady")]), (3, 99, "100% gone", None)],
        "id long, image_id long, content string, entities array<struct<type:string,value:string>>",
    )
    told = told.withColumn("created_at", F.expr("timestamp_ntz'2024-02-01' + id * interval '1' day")).withColumn("updated_at", F.col("created_at"))
    index = search.build_index(assets)
    out = search.search_with_fallback(index, assets, told, "100%").collect()
    assert [(r["id"], r["relevance_score"]) for r in out] == [(4, 0.5), (2, 0.5)]
    assert search.search_with_fallback(index, assets, told, "1__%").isEmpty()
    kinds = {r["image_id"]: r["match_type"] for r in search.query_associations(told, assets, "100%").collect()}
    assert kinds == {2: "content", 4: "entity"}
    with pytest.raises(ValueError):
        search.search_with_fallback(index, assets, told, "  ")


def test_write_index_sorted(spark, tmp_path):
    index = search.build_index(library(spark))
    search.write_index(index, str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index")).count() == index.count()


def samples(spark, pairs):
    return spark.createDataFrame([(float(c), bool(k)) for c, k in pairs], "confidence double, is_correct boolean")


def test_calibration(spark):
    over = [(0.80 + 0.15 * i / 9, i == 0) for i in range(10)]
    assert metrics.expected_error(samples(spark, over)).head()[0] > 0.3
    under = [(0.05 + 0.17 * i / 9, True) for i in range(10)]
    assert metrics.expected_error(samples(spark, under)).head()[0] > 0.3
    mixed = [(0.05 + 0.1 * i, i >= 4) for i in range(10)]
    assert abs(metrics.expected_error(samples(spark, mixed)).head()[0] - 0.26) < 1e-9
    hundred = samples(spark, [(i / 99, True) for i in range(100)])
    assert [metrics.calibration_bins(hundred, n).count() for n in (5, 20)] == [5, 20]
    empty = hundred.limit(0)
    assert metrics.expected_error(empty).head()[0] == 0.0 and metrics.calibration_report(empty).isEmpty()
    good, bad = metrics.split_samples(samples(spark, [(1.5, True), (-0.1, True), (0.0, True), (1.0, True)]))
    assert good.count() == 2 and bad.count() == 2


def test_calibration_change(spark):
    rows = [(1, 0.4, "2024-01-01"), (2, 0.3, "2024-01-02"), (3, 0.15, "2024-01-03")]
    reports = spark.createDataFrame(rows, "id long, ece double, created_at string")
    assert tuple(metrics.calibration_change(reports).head()) == (0.3, 0.15, 50.0)
    worse = reports.withColumn("ece", -F.col("ece") + 1)
    assert metrics.calibration_change(worse).head()["improvement_percent"] == 0.0
    assert metrics.calibration_change(reports.limit(1)).isEmpty()


def test_empty_library_totals(spark):
    empty = spark.createDataFrame([], "file_size long, ai_status string, ai_tag_status string")
    assert tuple(metrics.library_totals(empty).head()) == (0, 0, 0, 0)
    assert metrics.progress(empty).head()["state"] == "idle"


def conflicts(spark, category, tags, description, strict=True):
    return one(spark, x=rules.check_all(lit(category), strings(tags), lit(description), strict))["x"]


def test_consistency(spark):
    assert conflicts(spark, "animal", ["狗", "宠物"], "") == []
    assert conflicts(spark, "animal", ["建筑", "桥梁"], "") == ["分类(动物) 与标签不一致: 建筑, 桥梁"]
    assert conflicts(spark, "animal", ["狗", "彩色", "高清"], "") == []
    assert len(conflicts(spark, "person", [], "城市中的桥梁建筑")) == 1
    assert conflicts(spark, "landscape", [], "这是一张照片") == []
    assert conflicts(spark, "other", ["拉面"], "") and not conflicts(spark, "other", ["拉面"], "", strict=False)
    assert conflicts(spark, "animal", ["狗"], "一张照片") == ["标签(狗) 在描述中未找到支持内容"]


def test_grade(spark):
    def grade(conf, tags=("狗",)):
        return one(spark, g=rules.grade(lit("动物"), lit(conf), strings(tags), lit("狗")))["g"]

    assert [grade(c) for c in (0.9, 0.85, 0.6, 0.5, 0.2)] == ["verified", "verified", "provisional", "provisional", "rejected"]
    assert grade(0.99, ("建筑",)) == "rejected"


def test_parse_ai_response(spark):
    raws = [
        '```json\n{"tags": ["a", 1, "b"], "description": "d", "category": "animal", "confidence": 0.9}\n```',
        "{}",
        "<html>no</html>",
        '{"tags": ["a"',
        "",
        '{"tags": "x", "description": 3, "category": null, "confidence": "0.9"}',
        '  {"confidence": 1}  ',
        "```json{}```",
    ]
    df = spark.createDataFrame(list(enumerate(raws)), "i int, raw string")
    rows = {r["i"]: r for r in grading.parse_ai_response(df).collect()}
    assert (rows[0]["tags"], rows[0]["description"], rows[0]["category"], rows[0]["confidence"]) == (["a", "b"], "d", "animal", 0.9)
    for i in (1, 5, 7):
        assert (rows[i]["tags"], rows[i]["description"], rows[i]["category"], rows[i]["confidence"]) == ([], "No description", "other", 0.5)
    assert rows[6]["confidence"] == 1.0
    assert [i for i, r in rows.items() if r["error"]] == [2, 3, 4]


def test_failures_back_off(spark):
    assets = spark.createDataFrame([(1, "pending", None, 0), (2, "pending", None, 1), (3, "pending", None, 2), (4, "completed", None, 0)], "id long, ai_status string, ai_error_message string, ai_retry_count int")
    failed = spark.createDataFrame([(1, "e"), (2, "e"), (3, "e")], "id long, error string")
    out = {r["id"]: (r["ai_status"], r["ai_retry_count"], r["backoff_ms"]) for r in grading.apply_failures(assets, failed).collect()}
    assert out == {1: ("pending", 1, 2000), 2: ("pending", 2, 4000), 3: ("failed", 3, None), 4: ("completed", 0, None)}


def test_top_predictions(spark):
    df = spark.createDataFrame([(1, [0.1, 0.7, 0.2]), (2, [])], "id int, s array<double>")
    rows = {r["id"]: r for r in grading.top_predictions(df, "s", ["x", "y"], 2).collect()}
    assert [(p["label"], p["confidence"]) for p in rows[1]["predictions"]] == [("y", 0.7), ("class_2", 0.2)]
    assert (rows[1]["label"], rows[2]["label"], rows[2]["confidence"]) == ("y", "unknown", 0.0)


@pytest.mark.parametrize(
    "content,persons,places,times",
    [
        ("我和小明一起去公园玩", ["小"], ["公"], []),
        ("去年我们去旅行", [], ["旅"], ["去年"]),
        ("周三开会", [], [], ["周三"]),
        ("一张风景照", [], [], []),
        ("周末，星期天见", [], [], ["星期天"]),
        ("从去年到今年", [], [], ["去年", "今年"]),
    ],
)
def test_entities(spark, content, persons, places, times):
    row = one(spark, p=entities.extract_persons(lit(content)), q=entities.extract_places(lit(content)), t=entities.extract_times(lit(content)))
    assert (row["p"], row["q"], row["t"]) == (persons, places, times)


def test_longer_names(spark):
    row = one(spark, p=entities.extract_persons(lit("和小明"), 3), q=entities.extract_places(lit("去人民公园玩"), 6))
    assert (row["p"], row["q"]) == (["小明"], ["人民公园"])


def test_tag_operations(spark):
    cur = strings(["1", "2", "2"])
    row = one(spark, a=curation.tags_add(cur, strings(["2", "3"])), r=curation.tags_remove(cur, strings(["2"])), p=curation.tags_replace(cur, strings([])))
    assert (row["a"], row["r"], row["p"]) == (["1", "2", "2", "3"], ["1"], [])


def test_csv_escape(spark):
    row = one(spark, a=text.csv_escape(lit("hello,world")), b=text.csv_escape(lit('say "hi"')), c=text.csv_escape(lit("plain")), d=text.csv_escape(lit("a\nb")))
    assert tuple(row) == ('"hello,world"', '"say ""hi"""', "plain", '"a\nb"')


@pytest.mark.parametrize(
    "given,want",
    [
        ("key sk-abcdefghijklmnop end", "key sk-abcd****mnop end"),
        ("Authorization: Bearer abcdefghijkl", "Authorization: Bearer abcd****ijkl"),
        ("password=12345678", "password=****"),
        ("enc:v2:QUJDREVGR0hJSktMTU5PUA==", "enc:v2:QUJD****UA=="),
        ("open C:\\Users\\me\\a.jpg now", "open [REDACTED_PATH] now"),
        ("open /home/me/a/b.png now", "open [REDACTED_PATH] now"),
        ("打开 /home/me/a.png\u3000完成", "打开 [REDACTED_PATH]\u3000完成"),
        ("http://h/p?token=abc&x=1", "http://h/p?token=[REDACTED]&x=1"),
        ("all is fine", "all is fine"),
        ("abc", "abc"),
    ],
)
def test_redaction(spark, given, want):
    row = one(spark, a=redact.sanitize_log(lit(given)), b=redact.sanitize_log(redact.sanitize_log(lit(given))))
    assert row["a"] == want and row["b"] == want


def test_sanitize_error(spark):
    row = one(spark, a=redact.sanitize_error(lit("bad /var/lib/x.db: SELECT * FROM t; end")), b=redact.mask_value(lit("abcdefghijk")), c=redact.mask_value(lit("")))
    assert tuple(row) == ("bad [PATH]: [QUERY] end", "abcd****hijk", "")


def test_path_rules(spark):
    cases = {
        " ": "blank", "x" * 241: "too_long", "\\\\srv\\a": "network_path", "//srv/a": "network_path", "a\\\\.\\b": "device_path",
        "a::$DATA": "data_stream", "a/%2E%2e/b": "encoded_traversal", "a/../b": "encoded_traversal", "a\x00b": "control_character", "a\tb": None, "/ok/a.jpg": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    got = {r["p"]: r["i"] for r in df.select("p", files.path_issue(F.col("p")).alias("i")).collect()}
    assert got == cases


def test_import(spark):
    png, jpg = b"\x89PNG\r\n\x1a\n123", b"\xff\xd8\xff\xe0abc"
    rows = [(1, "/i/a.png", png), (2, "/i/b.PNG", png), (3, "/i/c.jpg", jpg), (4, "/i/d.jpg", png), (5, "/i/e.txt", jpg), (6, "/i/f.jpg", b""), (7, "/i/g.jpg", jpg + b"x")]
    df = spark.createDataFrame([(s, p, len(c), c) for s, p, c in rows], "seq long, path string, length long, content binary")
    stored = ingest.hash_content(df.filter("seq = 7")).select("file_hash")
    got = {r["seq"]: (r["outcome"], r["reason"]) for r in ingest.import_outcomes(df, stored).collect()}
    assert got == {
        1: ("success", None), 2: ("duplicate", None), 3: ("success", None), 4: ("error", "magic_mismatch"),
        5: ("error", "unsupported_extension"), 6: ("error", "empty"), 7: ("duplicate", None),
    }


def test_scan_assets(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.JPG", "b.txt", "sub/c.webp", ".hidden", "noext"):
        (tmp_path / name).write_bytes(b"x")
    names = {r["path"].rsplit("/", 1)[-1] for r in tables.scan_assets(spark, str(tmp_path), content=False).collect()}
    assert names == {"a.JPG", "c.webp"}
    flat = {r["path"].rsplit("/", 1)[-1] for r in tables.scan_assets(spark, str(tmp_path / "*.*"), recursive=False).collect()}
    assert flat == {"a.JPG"}


@pytest.mark.parametrize("span", [2, 1 << 20])
def test_manifest_serves_requests_in_order(spark, span):
    """Names that collide with really existing suffixed names."""
    import random

    rng = random.Random(7)
    names = ["a.jpg", "a_1.jpg", "a_2.jpg", "a_1_1.jpg", "b", "b_1", ".hid", "x.tar.gz"]
    asked = [rng.choice(names[:4] if rng.random() < 0.8 else names) for _ in range(60)]
    taken, want = set(), {}
    for i, name in enumerate(asked):
        dot = name.rfind(".")
        stem, ext = (name[:dot], name[dot:]) if dot > 0 else (name, "")
        target, n = name, 0
        while target in taken:
            n += 1
            target = f"{stem}_{n}{ext}"
        taken.add(target)
        want[i] = target
    assets = spark.createDataFrame([(i, f"/d{i}/{n}") for i, n in enumerate(asked)], "id long, file_path string")
    requested = spark.createDataFrame([(i, i) for i in range(60)] + [(100, 999)], "seq long, id long")
    rows = {r["seq"]: r for r in sinks.export_manifest(assets, requested, span).collect()}
    assert rows.pop(100)["error"] == "not found"
    assert {s: r["target"] for s, r in rows.items()} == want


def test_log(spark):
    lines = ["2024 {INFO} app one two", "2024 ERROR app boom", "short line", "", "2024 ERROR app again x"]
    df = spark.createDataFrame([(i + 1, l) for i, l in enumerate(lines)], "seq long, line string")
    rows = {r["seq"]: r for r in logs.parse_log(df).collect()}
    assert (rows[1]["level"], rows[1]["message"]) == ("INFO", "one two")
    assert (rows[3]["level"], rows[3]["message"], rows[3]["timestamp"]) == ("UNKNOWN", "short line", "")
    assert [r["seq"] for r in logs.page_log(df, 1, 2, "error").collect()] == [5]
    assert tuple(logs.page_info(df, 1, 0, "error").head()) == (5, 1, True)


def test_json_strings(spark):
    row = one(spark, a=text.json_strings(lit("[1")), b=text.json_strings(lit('["x"]')), c=text.json_strings_or_raw(lit("plain")), d=text.json_strings(lit(None).cast("string")))
    assert tuple(row) == ([], ["x"], ["plain"], [])


def test_unknown_ids_and_arguments(spark):
    assets = library(spark)
    good, bad = curation.batch_tag_correction(assets, [1, 2, 77], ["t"], "add")
    assert tuple(curation.correction_counts(good, bad).head()) == (2, 1)
    with pytest.raises(ValueError):
        curation.batch_tag_correction(assets, [1], [], "replace")
    with pytest.raises(LookupError):
        catalog.get_by_id(assets, 77, required=True)
    assert catalog.eligible_batch(assets, range(600)).count() == 1


def test_vector_insert(spark):
    base = spark.createDataFrame([("a", [1.0, 0.0], 1), ("b", [0.0, 1.0], 1)], "id string, embedding array<float>, created_at int")
    new = spark.createDataFrame([("a", [0.0, 1.0], 2), ("c", [], 2), ("d", [1.0], 2), ("a", [0.6, 0.8], 3)], "id string, embedding array<float>, created_at int")
    table, refused = similarity.insert_vectors(base, new, 2)
    assert {r["id"]: r["created_at"] for r in table.collect()} == {"a": 3, "b": 1}
    assert {r["id"] for r in refused.collect()} == {"c", "d"}
    text_rows = spark.createDataFrame([(1, "red car"), (2, "car red"), (3, "blue sky")], "id long, t string")
    dense = {r["id"]: r["embedding"] for r in similarity.dense_text_vectors(similarity.text_vectors(text_rows, "id", "t")).collect()}
    assert dense[1] == dense[2] != dense[3] and len(dense[1]) == 512
    assert abs(sum(x * x for x in dense[3]) - 1) < 1e-6


def test_text_vectors_add_up_rows_of_one_id(spark):
    """Rows of one id, null too, are one vector, whatever batch they come in; text moves once, as sums."""
    import numpy as np

    words = [f"w{i % 37}" for i in range(400)]
    rows = [(1, " ".join(words[:200])), (None, "x y"), (2, "..."), (None, "y z"), (1, " ".join(words[200:])), (3, None)]
    df = spark.createDataFrame(rows, "id long, t string").repartition(4)
    sparse = similarity.text_vectors(df, "id", "t", 16)
    whole = similarity.text_vectors(spark.createDataFrame([(1, " ".join(words)), (0, "x y y z")], "id long, t string"), "id", "t", 16)
    shown = lambda rows: {(r["id"] or 0, r["index"], round(r["value"], 9)) for r in rows}
    assert shown(sparse.collect()) == shown(whole.collect()) and sparse.count() == whole.count()
    dense = {r["id"]: np.array(r["embedding"]) for r in similarity.dense_text_vectors(sparse, 16).collect()}
    assert set(dense) == {1, None} and all(abs(float((v * v).sum()) - 1) < 1e-6 for v in dense.values())
    plan = similarity.dense_text_vectors(sparse, 16)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan
