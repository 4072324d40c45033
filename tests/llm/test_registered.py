"""Every registered query of the training-data operators against a plain version."""

import hashlib
import math
import os
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import test_alignment
import test_decontamination
import test_importance
import test_near_dedup
import test_substring_dedup
import test_suffix_dedup
import test_vector_graph
from rivulet.llm import catalogue, chat, language_id, toxicity
from rivulet.llm.tokenizers import load_ranks
from test_exact_dedup import brute as exact_brute
from test_pipeline import fixture

DATA = "/root/testdata/sf0.001"


def sha(raw):
    return hashlib.sha256(raw.encode() if isinstance(raw, str) else raw).hexdigest()


def crc(i):
    return zlib.crc32(str(i).encode())


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A small data folder: (path, document rows, benchmark rows)."""
    rnd = random.Random(21)
    docs, labels, items = fixture(rnd)
    passage = " ".join(f"pass{i}" for i in range(45))
    docs = [(i, f"{t} {passage} {t[:40]}" if t and i % 9 == 0 else t) for i, t in docs]
    docs += [(903, "1234 .. !"), (904, "langer text " * 8000), (905, "日本語 " * 20), (906, "x" * 900)]
    rows = [(i, t, "aa" if i % 3 else "bb", f"src{i % 3}", len(t or "")) for i, t in docs]
    sf = str(tmp_path_factory.mktemp("registered"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    turns = [(c, k, rnd.choice(["user", "assistant", "\tuser ", "tool", None]), f"say {k}") for c in range(40) for k in range(rnd.randint(1, 7))]
    spark.createDataFrame(turns, "conv_id bigint, turn int, role string, text string").write.parquet(f"{sf}/conversations.parquet")
    spark.createDataFrame(test_vector_graph.sample(600, 8), "vec_id bigint, embedding array<float>, label int").repartition(3).write.parquet(f"{sf}/embeddings.parquet")
    return sf, docs, items


def run(spark, tables, name):
    rows = catalogue.queries()[name](spark, tables[0]).collect()
    assert len({r[0] for r in rows}) == len(rows) or "rank" in rows[0] and len({r[:2] for r in rows}) == len(rows)
    return rows


def test_op1(spark, tables):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = {}
    for i, t in tables[1]:
        ids = library.encode_ordinary(t or "")
        want[i] = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t or ""))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, tables, "op1_byte_bpe")} == want


def test_op2(spark, tables):
    want = {i: (n, gone, spans, sha(kept)) for i, (n, gone, spans, kept) in test_suffix_dedup.brute(tables[1]).items()}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, tables, "op2_suffix_dedup")} == want
    assert any(gone for _, gone, _, _ in want.values())


def test_op3(spark, tables):
    rows = run(spark, tables, "op3_chat_format")
    assert len(rows) == 40
    for r in rows:
        assert r.rendered_sha256 == sha(r.rendered)
        roles = [chat.ROLES.index(part.split("\n")[0]) + 1 for part in r.rendered.split("<|im_start|>")[1:]]
        state = chat.START
        for role in roles:
            assert role in chat.LEGAL[state]
            state = role
        assert state in chat.FINAL and len(roles) == r.n_turns


def test_op4(spark, tables):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t in tables[1]:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[i] = (len((t or "").encode()), n, n > 512)
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in run(spark, tables, "op4_token_counts")} == want


def test_op5(spark, tables):
    rows = run(spark, tables, "op5_near_dedup")
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == test_near_dedup.brute(tables[1])


def test_op6(spark, tables):
    want = {i: (n, hit, len(items), sha(",".join(items)), hit > 0) for i, n, hit, items in test_decontamination.brute(*tables[1:])}
    rows = run(spark, tables, "op6_decontamination")
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows} == want


def plain_language(model, text):
    """(language, cosine) without arrays: trigrams of letters, TF-IDF, every centroid."""
    counts = {}
    folded = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").encode())
    folded = b" " + folded + b" "
    for a, b, c in zip(folded, folded[1:], folded[2:]):
        if b != 32:
            slot = ((a << 16 | b << 8 | c) * 2654435761 & 0xFFFFFFFF) >> 19
            counts[slot] = counts.get(slot, 0) + 1
    weight = {s: math.log1p(n) * float(model.idf[s]) for s, n in counts.items()}
    norm = math.sqrt(sum(w * w for w in weight.values())) or 1.0
    cosines = [sum(w / norm * float(c[s]) for s, w in weight.items()) for c in model.centroids]
    best = max(range(len(cosines)), key=lambda k: (cosines[k], -k))
    return model.languages[best], min(max(cosines[best], 0.0), 1.0), cosines


def test_op7(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    model = language_id.fit(docs.filter(~language_id.held_out()).selectExpr("doc_id AS id", "text", "lang"))
    texts = dict(tables[1])
    for r in run(spark, tables, "op7_language_id"):
        assert r.held_out == (crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1
        if not any(map(str.isalpha, texts[r.doc_id] or "")):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        lang, cosine, all_cosines = plain_language(model, texts[r.doc_id])
        near = [model.languages[k] for k, c in enumerate(all_cosines) if c > cosine - 1e-5]
        assert abs(r.score - cosine) < 1e-5 and r.lang_pred in near


def test_op8(spark, tables):
    slots, weights = toxicity.learn_from(spark, tables[0])
    weight, texts = dict(zip(slots.tolist(), weights.tolist())), dict(tables[1])
    for r in run(spark, tables, "op8_toxicity"):
        data = np.frombuffer((texts[r.doc_id] or "").encode(), np.uint8)
        own = set(toxicity.features(data, np.array([0, len(data)]))[0].tolist())
        assert abs(r.score - 1 / (1 + math.exp(-sum(weight.get(s, 0) for s in own)))) < 1e-5
        assert r.held_out == (crc(r.doc_id) % 3 == 1) and r.predicted == int(r.score >= 0.7)


def test_op9(spark, tables):
    want = {i: (keep, size, kept, digest) for i, keep, size, kept, digest in exact_brute(tables[1])}
    rows = run(spark, tables, "op9_exact_dedup")
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows} == want


def test_op10(spark, tables):
    want = {i: (n, gone, sha(kept)) for i, (n, gone, kept) in test_substring_dedup.brute(tables[1]).items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in run(spark, tables, "op10_substring_dedup")} == want
    assert any(gone for _, gone, _ in want.values())


def test_op11(spark, tables):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{tables[0]}/embeddings.parquet").collect()]
    want = test_vector_graph.brute(vectors, [(i, v) for i, v in vectors if i is not None and i % 20 == 0], 20)
    assert {tuple(r) for r in run(spark, tables, "op11_vector_graph")} == set(want)  # shards that fit in a beam


def test_op12(spark, tables):
    rows = [tuple(r) for r in run(spark, tables, "op12_importance")]
    assert test_importance.order(rows) == test_importance.order(test_importance.brute(tables[1], [t for _, t in tables[2]]))
    assert any(r[4] for r in rows)


def test_op13(spark, tables):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(tuple(r[c] for c in names) for r in run(spark, tables, "op13_alignment")) == sorted(test_alignment.brute(tables[1])[0])


def test_queries_take_empty_tables(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([], "conv_id bigint, turn int, role string, text string").write.parquet(f"{sf}/conversations.parquet")
    spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{sf}/embeddings.parquet")
    for name, query in catalogue.queries().items():
        assert query(spark, sf).count() == 0, name


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    df = catalogue.queries()[name](spark, DATA)
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(want.columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall())
