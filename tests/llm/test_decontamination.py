"""Decontamination against a brute-force window search."""

import random
import re

from rivulet.llm.decontamination import decontaminate, find_windows, merge, without

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width=10):
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(width, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for i in range(len(w)):
            for size in range(1, min(width, len(w) - i) + 1):
                if own := windows.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    found |= own
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def test_matches_brute_force_in_one_and_in_many_blocks(spark):
    rnd = random.Random(1)
    vocabulary = ["Al", "be", "Ça", "dé", "e2", "3", "日本", "gé"]
    say = lambda n: "".join(rnd.choice(vocabulary) + rnd.choice([" ", ", ", "\n", "-", "\x00"]) for _ in range(n))
    items = [(k, say(n)) for k, n in enumerate([1, 3, 3, 9, 10, 12, 25, 30])] + [(20, None), (21, " .. "), (None, "Al be"), (10, items_text := say(11)), (10, items_text)]
    docs = [(d, say(rnd.randint(0, 40))) for d in range(150)] + [(d, say(3) + items[rnd.randint(3, 7)][1] + say(5)) for d in range(150, 200)]
    docs += [(300, None), (301, ""), (302, (items[6][1] + "x y z ") * 3000), (0, docs[0][1]), (None, items[5][1])]
    want = brute(docs, [x for x in items if x[0] is not None])
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for bound in (10**6, 20):
        rows = find_windows(df, bench, block_words=bound).collect()
        got = [(r.doc_id, r.n_words, sum(s.last - s.first for s in r.spans), r["items"]) for r in rows]
        assert sorted(got, key=str) == want


def test_removal_of_documents_and_spans_keeps_columns(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, f"A {item.upper()}, b.", "p", 3), (2, "clean\ntext", None, 4), (3, None, "r", None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, items string, n_words int")
    bench = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    kept = decontaminate(df, bench)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == sorted(docs[1:])
    spans = {r.doc_id: r.text for r in decontaminate(df, bench, "spans").collect()}
    assert spans == {1: "A " + " " * 9 + ", b.", 2: "clean\ntext", 3: None}
    assert decontaminate(df.limit(0), bench).collect() == []
    assert decontaminate(df, bench.limit(0)).count() == 3


def test_span_helpers():
    assert merge([(5, 9), (0, 3), (3, 4), (6, 7)]) == [(0, 4), (5, 9)]
    assert without("Aa-bb cc", [(1, 2)]) == "Aa- cc"
