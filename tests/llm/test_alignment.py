"""Cross-tokenizer alignment against a plain version on whole texts."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from rivulet.llm import alignment

TEXTS = [None, "", " ", "a", "  two  spaces ", "tab\tand\nline", "é ﬁ 日本語 🙂 x", "▁ is a mark", "it's <|endoftext|> and </s>", "ab " * 400, "x" * 3000, "\x00\x1c odd", "end. "]
TYPES = "doc_id bigint, text string, id bigint, pairs string"


def brute(docs):
    """doc_id to a contract row, by the libraries on whole texts."""
    a_lib = Tokenizer.from_file(public_tokenizers.path(alignment.FIRST))
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.SECOND))
    alphabet = alignment.byte_alphabet()
    made, counts = [], Counter()
    for i, text in docs:
        a = b = []
        if text:
            raw = (" " + text).encode()
            a = [(t, bytes(alphabet[c] for c in a_lib.id_to_token(t))) for t in a_lib.encode(" " + text, add_special_tokens=False).ids]
            b = [(t, bytes([int(p[3:5], 16)]) if b_lib.is_byte(t) else p.replace("▁", " ").encode()) for t in b_lib.encode(text) for p in [b_lib.id_to_piece(t)]]
            if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
                a = b = []
        ends = []
        for side in (a, b):
            at, own = 0, {}
            for k, (_, x) in enumerate(side):
                at += len(x)
                own[at] = k
            ends.append(own)
        groups, links, from_a, from_b = [], [], 0, 0
        for end in sorted(ends[0].keys() & ends[1].keys()):
            x, y = ends[0][end], ends[1][end]
            groups.append("|".join(",".join(str(t) for t, _ in part) for part in (a[from_a : x + 1], b[from_b : y + 1])))
            links.append((a[x][0], b[y][0]))
            from_a, from_b = x + 1, y + 1
        counts.update(links)
        made.append((i, len(a), len(b), ";".join(groups), links))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    rows = [
        (i, n_a, n_b, len(links), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "")
        for i, n_a, n_b, g, links in made
    ]
    return rows, {(x, y, n, n == best[y]) for (x, y), n in counts.items()}


def random_text(rnd):
    words = ["the", "The", "of,", "naïve", "don't", "x1y2", "  ", "\n", "日本", "größer", "1234", "...", "a-b", "🙂", "ab<s>"]
    return rnd.choice([" ", "", "\t"]).join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))


def key(row):
    return tuple((x is not None, x) for x in row)


def check(spark, docs, **how):
    df = spark.createDataFrame([(i, t, 7, "extra") for i, t in docs], TYPES).repartition(3)
    made = alignment.Alignment(df, **how)
    rows, pairs = brute(docs)
    got = [tuple(r) for r in made.documents().select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()]
    assert sorted(got, key=key) == sorted(rows, key=key)
    assert {tuple(r) for r in made.pairs().collect()} == pairs


def test_equals_plain_version(spark):
    rnd = random.Random(13)
    docs = [(i, t) for i, t in enumerate([*TEXTS, *(random_text(rnd) for _ in range(120))])]
    check(spark, [*docs, docs[9], (3, "the same id"), (None, "no id here"), (None, None)])


def test_frequent_pairs_in_several_units(spark, monkeypatch):
    monkeypatch.setattr(alignment, "FLUSH", 500)
    monkeypatch.setattr(alignment, "COUNT_ROWS", 7)
    rnd = random.Random(3)
    docs = [(i, "the the, and so the " * rnd.randint(1, 5) + random_text(rnd)) for i in range(300)]
    check(spark, docs, unit=200)


def test_groups_are_given_as_text(spark):
    docs = [(i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    for r in alignment.Alignment(df, with_groups=True).documents().collect():
        assert r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "")


def test_empty_table_and_long_text(spark):
    assert alignment.Alignment(spark.createDataFrame([], TYPES)).documents().count() == 0
    check(spark, [(1, "one long text of many words, " * 60_000), (2, "z" * 40_000)])
