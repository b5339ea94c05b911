import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from pictorium.llm import align


def brute(rows):
    """(doc_id, text) to the whole result, byte by byte from the files' own readers."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    ta = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ta.encode_special_tokens = True
    tb = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(other)}

    def spans(pieces):
        out, at = [], 0
        for i, p in pieces:
            out.append((at, at + len(p), i))
            at += len(p)
        return out

    docs, counts = [], Counter()
    for i, text in rows:
        a = [(t, bytes(byte_of[c] for c in ta.id_to_token(t))) for t in ta.encode(" " + (text or ""), add_special_tokens=False).ids] if text else []
        b = []
        for t in tb.encode(text) if text else []:
            p = tb.id_to_piece(t)
            b.append((t, bytes([int(p[3:5], 16)]) if tb.is_byte(t) else p.replace("▁", " ").encode()))
        raw = (" " + (text or "")).encode()
        if not text or b"".join(p for _, p in a) != raw or b"".join(p for _, p in b) != raw:
            docs.append((i, [], [], [], ""))
            continue
        sa, sb = spans(a), spans(b)
        links, j0 = [], 0
        for s, e, t in sa:
            while sb[j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(sb) and sb[j][0] < e:
                links.append((t, sb[j][2]))
                j += 1
        ends = sorted({e for _, e, _ in sa} & {e for _, e, _ in sb})
        groups, ia, ib = [], 0, 0
        for end in ends:
            parts = []
            for side, k in ((sa, ia), (sb, ib)):
                ids = []
                while k < len(side) and side[k][1] <= end:
                    ids.append(str(side[k][2]))
                    k += 1
                parts.append((",".join(ids), k))
            (x, ia), (y, ib) = parts
            groups.append(f"{x}|{y}")
        counts.update(links)
        docs.append((i, sa, sb, links, ";".join(groups)))
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for i, sa, sb, links, text in docs:
        best = sum(counts[x] == most[x[1]] for x in links)
        digest = hashlib.sha256(text.encode()).hexdigest() if sa else ""
        out.append((i, len(sa), len(sb), text.count("|"), len(links), best, sum(counts[x] for x in links), digest))
    return sorted(out, key=repr)


HARD = [
    (1, "naïve façade — 日本語の文章  and   spaces\n\n\tend "),
    (2, None),
    (3, ""),
    (4, "<|endoftext|> and <s> </s> <unk> <0x41>"),
    (5, "a▁b"),
    (6, " "),
    (7, "emoji 👩‍👩‍👧‍👦 ①②③ \x00  "),
    (8, "word " * 900 + "日本" * 200 + "x" * 500),
    (8, "twice"),
    (8, "twice"),
    (None, "no id at all"),
    (9, " leading"),
]


@pytest.mark.parametrize("options", [{}, {"chunk_bytes": 40, "fan": 3}, {"chunk_bytes": 600, "fan": 3, "max_pairs": 0, "hot_rows": 1}])
def test_equal_to_brute_force(spark, options):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in HARD], "doc_id long, text string, row int, part string").repartition(3)
    rows, pairs = align.align_tokenizers(docs, **options)
    assert rows.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, rows.collect()), key=repr) == brute(HARD)
    assert pairs.agg({"n": "sum"}).head()[0] == sum(r[4] for r in brute(HARD))


def test_documents(spark, data, documents):
    want = brute([(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()])
    for options in ({}, {"chunk_bytes": 4000, "fan": 4, "max_pairs": 10}):
        rows, _ = align.align_tokenizers(documents, **options)
        assert sorted(map(tuple, rows.collect()), key=repr) == want


def test_odd_and_empty_rows(spark, odd, none):
    assert align.align_tokenizers(odd)[0].count() == odd.count()
    assert align.align_tokenizers(none)[0].count() == 0 and align.align_tokenizers(none)[1].count() == 0


def test_composition_is_associative():
    rng = random.Random(3)
    len_a, len_b = np.array([1, 2, 3, 5]), np.array([1, 1, 2, 4])

    def ids(lengths, total):
        out = []
        while total:
            i = rng.choice([k for k, n in enumerate(lengths) if n <= total])
            out.append(i)
            total -= lengths[i]
        return np.array(out)

    def plain(f):
        side = lambda r: None if r is None else (r.a.tolist(), r.b.tolist())
        return side(f.left), [side(r) for r in f.closed], side(f.right)

    for _ in range(200):
        a, b = ids(len_a, 40), ids(len_b, 40)
        parts = [align.fragment(r, len_a, len_b, k == 0) for k, _, r in align.byte_ranges(a, b, len_a, len_b, rng.randint(1, 15))]
        left = parts[0]
        for p in parts[1:]:
            left = align.compose(left, p)
        while len(parts) > 1:
            k = rng.randrange(len(parts) - 1)
            parts[k : k + 2] = [align.compose(parts[k], parts[k + 1])]
        assert plain(parts[0]) == plain(left)
        whole = align.align([(a, b)], len_a, len_b).text[0]
        joined = align.align([(r.a, r.b) for r in left.closed], len_a, len_b).text
        assert b";".join(joined) == whole and not len(left.left.a) and not len(left.right.a)
