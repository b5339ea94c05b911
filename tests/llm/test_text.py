"""Secret scan, decontamination, packing: brute force and edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

from pictorium.llm import decontaminate as D
from pictorium.llm import packing, secrets
from pictorium.llm.queries import QUERIES

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def check_secrets(rows, texts):
    for r in rows:
        base = base_spans(texts[r["doc_id"]])
        n = Counter(x[3] for x in base)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (n["assign"], n["access"], n["hex"])
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) <= set(r["spans"].split(","))


def test_secrets_equal_brute_force(spark, data, documents):
    check_secrets(QUERIES["op1_secret_scan"][0](spark, data).collect(), {r["doc_id"]: r["text"] for r in documents.collect()})


def test_secrets_odd_rows(odd, none):
    rows = secrets.scan_secrets(odd).collect()
    assert len(rows) == odd.count()
    check_secrets(rows, {r["doc_id"]: r["text"] for r in odd.collect()})
    assert [r["spans"] for r in rows if r["doc_id"] == 2] == [""]
    assert secrets.scan_secrets(none).count() == 0
    cleaned = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(odd).collect()}
    assert cleaned[9] == "<secret> and <secret> here".replace("<secret> and", '<secret>" and') and cleaned[2] is None
    assert cleaned[1] == odd.filter("doc_id = 1").head()["text"]


def test_entropy_windows_equal_direct_computation():
    random.seed(1)
    for _ in range(200):
        s = "".join(random.choice("abcdef01") for _ in range(random.randint(0, 40)))
        inside = set()
        for i in range(len(s) - 7):
            w = Counter(s[i : i + 8])
            if -sum(c / 8 * math.log2(c / 8) for c in w.values()) >= 2.4 - 1e-9:
                inside |= set(range(i, i + 8))
        got = {i for a, b in secrets.entropy_spans(s, 8, 2.4) for i in range(a, b)}
        assert got == inside


def test_allow_list_suppresses_entropy_only():
    scan = secrets.Scanner().scan
    key = "wJalrXUtnFEMIK7MDENGbPxRfiCYzzzQ9"
    assert scan(f"x {key} y")[1] and not scan(f"x {key}EXAMPLE y")[1]
    uuid = "123e4567-e89b-12d3-a456-426614174000"
    assert scan(uuid) == ([], [])
    base, more = scan("token=example0123456789abcdef0123456789")
    assert [k for _, _, k in base] == ["assign", "hex"] and not more


def contamination(texts, items, window=10):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[i : i + m])].add(str(item if item is not None else ""))
    sizes = {len(k) for k in windows}
    out = []
    for text in texts:
        w, hit, ids = words(text), set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in windows:
                    ids |= windows[tuple(w[i : i + m])]
                    hit |= set(range(i, i + m))
        out.append((len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination_equals_brute_force(spark, data, documents):
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    rows = documents.select("doc_id", "text").collect()
    want = {r["doc_id"]: x for r, x in zip(rows, contamination([r["text"] for r in rows], items))}
    got = QUERIES["op2_decontamination"][0](spark, data).collect()
    assert {r["doc_id"]: tuple(r)[1:6] for r in got} == want
    assert any(x[4] for x in want.values())


def test_decontamination_small_alphabet(spark):
    """Overlapping, nested, short and repeated items, in one block and in many."""
    random.seed(3)
    make = lambda n: " ".join(random.choice("ab") for _ in range(n))
    items = [(i, make(random.choice((0, 1, 3, 4, 5, 9)) if i else 7)) for i in range(12)] + [(3, "b a b a a"), (None, "a c a"), (20, None)]
    items = [x for x in items if x[1] is None or len(x[1]) != 1]
    texts = [make(random.randint(0, 40)) + random.choice(("", " c ", " c a")) for _ in range(80)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    frame = spark.createDataFrame(items, "item_id long, text string")
    want = contamination(texts, items, 4)
    for block in (100_000, 6):
        got = {r["doc_id"]: tuple(r)[1:6] for r in D.contamination(docs, frame, 4, block).collect()}
        assert [got[i] for i in range(len(texts))] == want
    left = D.decontaminate(docs, frame, 4, 1.0)
    assert D.contamination(left, frame, 4).filter("contaminated").count() == 0


def test_longest_match(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x two three four y five six"), (2, "zero")], "doc_id long, text string")
    assert [r["longest"] for r in D.contamination(docs, items, 5).orderBy("doc_id").collect()] == [3, 0]


def test_decontaminate_cuts_and_drops(spark, odd, none):
    items = spark.createDataFrame([("q", "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu")], "item_id string, text string")
    passage = "ALPHA beta, gamma delta epsilon zeta eta theta iota kappa lambda mu"
    docs = spark.createDataFrame([(1, f"é before, {passage}! after " + "clean words " * 20), (2, passage), (3, None), (4, "clean")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in D.decontaminate(docs, items).collect()}
    assert got == {1: "é before, ! after " + "clean words " * 20, 3: None, 4: "clean"}
    same = D.decontaminate(odd, items)
    assert same.columns == odd.columns and sorted(map(str, same.collect())) == sorted(map(str, odd.collect()))
    assert D.decontaminate(none, items).count() == 0
    assert D.contamination(odd, items.limit(0)).filter("contaminated or n_items > 0").count() == 0


def check_packing(rows, texts):
    """Every document's ids come back from its pieces; sequences are gapless."""
    import public_tokenizers
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in texts:
        want[i, tuple(bpe.encode(t or "", add_special_tokens=False).ids + [0])] += 1
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
        assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in r["ids"])) and len(r["ids"]) == r["length"]
    total = padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= packing.SEQUENCE_TOKENS
        total += at
        padding += 0 if at & (at - 1) == 0 else packing.SEQUENCE_TOKENS - at
    assert padding == 0
    for (i, ids), n in want.items():
        own = sorted((r["start"], r["length"], tuple(r["ids"])) for r in pieces[i])
        if sum(k for (j, _), k in want.items() if j == i) == 1:  # rows that repeat an id are checked by their sum
            assert [x[0] for x in own] == [sum(y[1] for y in own[:k]) for k in range(len(own))]
            assert tuple(v for x in own for v in x[2]) == ids
            assert {r["doc_tokens"] for r in pieces[i]} == {len(ids)}
    assert total == sum(len(ids) * n for (_, ids), n in want.items())


def test_packing_round_trip(documents, odd, none):
    for docs in (documents, odd):
        check_packing(packing.pack_documents(docs, with_ids=True).collect(), [tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert packing.pack_documents(none).count() == 0
    check_packing(packing.pack_documents(documents, with_ids=True, group_tokens=5000).collect(), [tuple(r) for r in documents.select("doc_id", "text").collect()])


def test_packing_special_text_and_balance(spark):
    docs = spark.createDataFrame([(1, "a<|endoftext|>b")], "doc_id long, text string")
    check_packing(packing.pack_documents(docs, with_ids=True).collect(), [(1, "a<|endoftext|>b")])
    random.seed(5)
    lengths = [random.randint(1, 900) for _ in range(3000)]
    cost = Counter()
    used = Counter()
    for _, _, n, s, _ in packing.pack(lengths):
        cost[s] += n + n * n / 4096
        used[s] += n
    full = [cost[s] for s in used if used[s] == 1024]
    mean = sum(full) / len(full)
    assert max(abs(c - mean) for c in full) < 0.15 * mean
    assert packing.capacities(2049) == [1024, 1024, 1]


def test_packing_very_long_white_space(spark):
    """Runs of white space on which the reader of the rank file gives up."""
    rows = [(1, " " * 2_000_000), (2, "a" + "\n" * 1_200_000 + "b<|endoftext|>"), (3, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check_packing(packing.pack_documents(docs, with_ids=True).collect(), rows)


def test_decontaminate_in_several_blocks(spark):
    """Overlapping hits of two blocks are one cut, and words joined by a later block's cut are looked at again."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    items = [(1, " ".join(letters[:6])), (2, " ".join(letters[3:9])), (3, "p q r s t u")]
    # in text 2, cutting item 3 joins a window of item 1
    texts = [" ".join(letters[:9]) + " x x x x x x x x", " ".join(letters[:9]) + " x x x x x x x x x", "a b c p q r s t u d e f" + " y" * 13, None, "clean"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    frame = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    got = {}
    for block in (100_000, 6):
        rows = D.decontaminate(docs, frame, 6, 0.5, block)
        assert rows.columns == docs.columns
        got[block] = {r["doc_id"]: (r["text"] or "").split() for r in rows.collect()}
        assert D.contamination(rows, frame, 6).filter("contaminated").count() == 0
    # of text 0 nine words of 17 are hit, of text 1 nine of 18, of text 2 twelve of 25
    assert got[6] == got[100_000] == {1: ["x"] * 9, 2: ["y"] * 13, 3: [], 4: ["clean"]}


def test_decontamination_of_many_blocks(spark, monkeypatch):
    """Fifty blocks: one map step, or several with tables between them; the same hits, one automaton at a time."""
    random.seed(8)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(random.choices(vocabulary, k=6))) for i in range(50)]
    texts = [" ".join(random.choices(vocabulary, k=20) + items[i][1].split() + random.choices(vocabulary, k=9)) for i in range(50)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    frame = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    want = contamination(texts, items, 4)
    for step_blocks, steps in ((64, 1), (20, 1)):
        out = D.scan(docs, frame, 4, 6, step_blocks)
        assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == steps
        rows = {r["doc_id"]: r for r in out.collect()}
        for i, (n, hit, found, _, _) in enumerate(want):
            flat = rows[i][D.HITS]
            assert (rows[i][D.WORDS], sum(flat[1::2]) - sum(flat[::2]), len(rows[i][D.ITEMS])) == (n, hit, found)
    D._built.clear()
    blocks = tuple(map(D._pack, D.item_blocks(frame, 6)))
    assert len(blocks) == 50
    for _ in D._automata("many", blocks, 4):
        assert len(D._built) <= 1
    for _ in D._automata("few", blocks[:3], 4):
        pass
    assert len(D._built) == 3
