import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pressmill.llm import crossalign, queries
from pressmill.llm.common import stored

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "Hello world", "  two  spaces ", "<|endoftext|> and <s> </s> <unk> <0x41>", "naïve café 日本語 \U0001f600\U0001f469‍\U0001f680 x", "tab\tand\nline\r\n", "▁under", "ﬁ ligature ｆｕｌｌ", "é combining",
    "a" * 3000, "word " * 4000, "0123456789" * 50, "\x00\x01\x1c", "Hello world", "don't we'll", "ไทยไทย", " nbsp　wide",
]


def plain(texts):
    """With the libraries and sets of ends."""
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    p = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = {i: chr(b) for b, i in zip([*range(33, 127), *range(161, 173), *range(174, 256)], [*range(33, 127), *range(161, 173), *range(174, 256)])}
    rest = [b for b in range(256) if b not in letters]
    back = {c: b for b, c in letters.items()} | {chr(256 + i): b for i, b in enumerate(rest)}
    rows, n = [], Counter()
    for text in texts:
        a, b, groups, links = [], [], [], []
        if text:
            whole = (" " + text).encode()
            a = t.encode(" " + text, add_special_tokens=False).ids
            b = p.encode(text)
            a_raw = [bytes(back[c] for c in t.id_to_token(i)) for i in a]
            b_raw = [bytes([int(p.id_to_piece(i)[3:-1], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(a_raw) != whole or b"".join(b_raw) != whole:
                a, b = [], []
            else:
                a_ends, b_ends = (np.cumsum([len(x) for x in raw]).tolist() for raw in (a_raw, b_raw))
                both = sorted(set(a_ends) & set(b_ends))
                i = j = 0
                for end in both:
                    k, m = a_ends.index(end, i) + 1, b_ends.index(end, j) + 1
                    groups.append((a[i:k], b[j:m]))
                    i, j = k, m
                links = [(x[-1], y[-1]) for x, y in groups]
        n.update(links)
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((len(a), len(b), said, links))
    most = Counter()
    for (_, y), c in n.items():
        most[y] = max(most[y], c)
    return [(na, nb, said, len(links), sum(n[x] == most[x[1]] for x in links), sum(n[x] for x in links)) for na, nb, said, links in rows], n


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 300)), st.sets(st.integers(0, 300)))
def test_galloping_finds_what_both_have(a, b):
    a, b = (np.array(sorted(x), np.int64) for x in (a, b))
    i, j = crossalign.common_ends(a, b)
    assert a[i].tolist() == b[j].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_galloping_over_far_ends():
    rng = np.random.default_rng(5)
    for n, m in ((1, 100_000), (40, 100_000), (50_000, 60_000), (17, 3)):
        a, b = (np.unique(rng.integers(0, 200_000, k)) for k in (n, m))
        i, j = crossalign.common_ends(a, b)
        assert a[i].tolist() == b[j].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


@pytest.mark.parametrize("chunk,block_pairs", [(1 << 19, 1 << 20), (10, 40)])
def test_equals_the_libraries(spark, chunk, block_pairs):
    df = spark.createDataFrame([(None if i % 3 else i, t, i, i) for i, t in enumerate(TEXTS)], "doc_id int, text string, aligned int, n_best int").repartition(3)
    done = crossalign.align(df, A, B, chunk_chars=chunk)
    assert done.columns == ["doc_id", "text", "n_best", "aligned"]
    kept = stored(done.select(F.col("n_best").alias("row"), F.monotonically_increasing_id().alias("n_best"), "aligned.*"))
    counts = crossalign.pair_counts(kept.select("links"), A, B)
    want, n = plain(TEXTS)
    assert {(r["a_id"], r["b_id"]): r["n"] for r in counts.collect()} == dict(n)
    got = crossalign.with_counts(kept, counts, A, B, block_pairs=block_pairs).orderBy("row").collect()
    assert [(r["n_a"], r["n_b"], r["groups"], len(r["links"]) // 4, r["n_best"], r["count_sum"]) for r in got] == want
    assert sum(x[0] > 0 for x in want) > 10 and want[8][0] == 0


def test_tasks_count_before_they_hold_too_much(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS * 2], "text string").coalesce(1)
    got = crossalign.pair_counts(crossalign.align(df, A, B).select("aligned.links"), A, B, held_links=5)
    assert {(r["a_id"], r["b_id"]): r["n"] for r in got.collect()} == dict(plain(TEXTS * 2)[1])


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want, _ = plain([r["text"] for r in rows])
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_token_alignment"](spark, SF).collect()}
    for r, (na, nb, said, links, best, total) in zip(rows, want):
        x = got[r["doc_id"]]
        assert (x["n_a"], x["n_b"], x["n_groups"], x["n_links"], x["n_best"], x["count_sum"]) == (na, nb, links, links, best, total)
        assert x["groups_sha256"] == (hashlib.sha256(said.encode()).hexdigest() if said else "")


def test_empty_table(spark):
    none = crossalign.align(spark.createDataFrame([], "text string"), A, B)
    counts = crossalign.pair_counts(none.select("aligned.links"), A, B)
    assert counts.count() == 0 and crossalign.with_counts(none.select("aligned.links"), counts, A, B).count() == 0
