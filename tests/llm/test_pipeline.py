"""The pipeline against brute-force versions of its stages."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from rivulet.llm import toxicity
from rivulet.llm.tokenizers import load_ranks
from test_decontamination import brute as windows_hit
from test_near_dedup import brute as near_components


def fixture(rnd):
    word = lambda: "".join(rnd.choice(["ka", "lo", "mi", "ré", "tu", "sha", "ny"]) for _ in range(rnd.randint(1, 4)))
    say = lambda n: " ".join(word() for _ in range(n))
    items = [(k, say(15)) for k in range(4)]
    docs, labels = [], []
    for i in range(420):
        text, bad = say(rnd.randint(15, 90)), rnd.random() < 0.2
        kind = rnd.random()
        if i > 50 and kind < 0.15:
            text = re.sub(" ", "  ", docs[rnd.randrange(i)][1] or "", count=3)
        elif i > 50 and kind < 0.3:
            text = (docs[rnd.randrange(i)][1] or "") + " " + word()
        elif kind < 0.35:
            text = text + " " + rnd.choice(items)[1] + " " + say(3)
        elif bad:
            text = " ".join(["vileness", text, "rancid", "vile grotty"])
            labels.append((i, 1))
        else:
            labels.append((i, 0))
        docs.append((i, text))
    docs += [(900, None), (901, ""), (902, "  ")]
    return docs, labels, items


def test_pipeline_matches_brute_force(spark, tmp_path):
    docs, labels, items = fixture(random.Random(11))
    sf = str(tmp_path)
    rows = [(i, t, "xx", f"src{i % 3}", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")

    slots, weights = toxicity.learn_from(spark, sf)
    weight = dict(zip(slots.tolist(), weights.tolist()))

    def score(text):
        data = np.frombuffer((text or "").encode(), np.uint8)
        own = set(toxicity.features(data, np.array([0, len(data)]))[0].tolist())
        return 1 / (1 + np.exp(-sum(weight.get(s, 0) for s in own)))

    stage1 = [(i, t) for i, t in docs if score(t) < toxicity.THRESHOLD]
    assert len(stage1) < len(docs) and all(score(t) < 0.7 for _, t in stage1)
    seen, stage2 = set(), []
    for i, t in sorted(stage1):
        key = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        if key not in seen:
            stage2.append((i, t))
            seen.add(key)
    components = near_components(stage2)
    stage3 = [(i, t) for i, t in stage2 if components[i][2]]
    hit = {d: n for d, _, n, _ in windows_hit(stage3, items)}
    stage4 = [(i, t) for i, t in stage3 if not hit[i]]
    assert len(docs) > len(stage1) > len(stage2) > len(stage3) > len(stage4) > 50

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = {}
    for i, t in stage4:
        ids = library.encode_ordinary(t or "")
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want and len(got) == len(want)


def test_stages_take_an_empty_table_and_keep_columns(spark, tmp_path):
    sf = str(tmp_path)
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([], schema).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_stages_take_odd_rows_and_clashing_columns(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "seven eight nine")], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, long), (3, long), (4, long + " x"), (5, "a b c d e f g"), (6, "a  b c d e f g"), (None, "alone at last"), (None, "a b c d e f g"),
            (7, " .. "), (8, "six Seven, eight-nine ten")]
    clash = ["gone", "digest", "token_ids", "c0", "maybe", "missing", "score", "spans", "n_words", "sha", "__key", "__maybe", "__slot", "text_sha256"]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in clash)
    docs = spark.createDataFrame([(i, t, "xx", "s", len(t or ""), *clash) for i, t in rows], schema).repartition(2)
    docs.write.parquet(f"{sf}/documents.parquet")
    want = {
        "toxicity": [r[0] for r in rows],  # nothing is learned: every score is that of no evidence
        "exact_dedup": [1, 3, 3, 4, 5, None, 7, 8],
        "near_dedup": [1, 3, 3, 5, None, 7, 8],
        "decontamination": [1, 3, 3, 5, None, 7],
    }
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.schema.names == docs.schema.names
        out.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        assert sorted(r.doc_id for r in docs.collect() if r.doc_id is not None) + [None] * docs.filter("doc_id is null").count() == sorted(i for i in want[name] if i is not None) + [None] * want[name].count(None)
        assert docs.filter("gone = 'gone' and c0 = 'c0' and text_sha256 = 'text_sha256'").count() == len(want[name])
    ids = {r.doc_id: r.n_tokens for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()}
    assert ids[1] == 0 and ids[3] > 60_000 and set(ids) == {1, 3, 5, None, 7}
