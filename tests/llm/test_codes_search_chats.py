"""Vector codes, lexical search and chat formatting against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from segmentry.llm import chat_format, lexical_search, queries, vector_codes

# Vector codes ------------------------------------------------------------------------


def plain_codes(vectors: dict, parts: int, entries: int, rounds: int) -> tuple[dict, str]:
    """One part and one entry at a time."""
    ints = {i: [math.floor(1024 * x) for x in v] for i, v in vectors.items()}
    d = len(next(iter(ints.values()))) // parts
    cut = {i: [v[p * d : (p + 1) * d] for p in range(parts)] for i, v in ints.items()}
    books = [[list(cut[i][p]) for i in sorted(cut)[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), n) for n, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for x in (c[p] for c in cut.values()):
                held.setdefault(nearest(p, x)[1], []).append(x)
            for n, xs in held.items():
                books[p][n] = [sum(col) // len(xs) for col in zip(*xs, strict=True)]
    out = {}
    for i, c in cut.items():
        best = [nearest(p, x) for p, x in enumerate(c)]
        out[i] = ("".join(f"{n:02x}" for _, n in best), sum(far for far, _ in best))
    flat = ",".join(str(x) for b in books for e in b for x in e)
    return out, hashlib.sha256(flat.encode()).hexdigest()


@pytest.mark.parametrize(("n", "entries"), [(90, 16), (5, 16), (200, 70)])
def test_codes_equal_plain_codes(spark, n, entries):
    rng = random.Random(n)
    some = {i * 3: [rng.choice([-1, 1]) * rng.randrange(40) / 64 for _ in range(8)] for i in range(n)}
    some[1] = some[3]  # equal vectors
    rows = [(i, v, None if i % 4 == 0 else i % 4) for i, v in some.items()]
    bad = [(-1, None, 1), (-2, [0.5] * 7 + [None], 1), (-3, [0.5] * 7 + [float("nan")], 1),
           (-4, [float("-inf")] * 8, None), (-5, [], 2)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit("x"))
    got = vector_codes.compress_vectors(table.repartition(5), parts=2, entries=entries).collect()
    codes, digest = plain_codes(some, 2, entries, 4)
    assert {r.id: (r.code, r.error) for r in got} == codes and len(got) == len(codes)
    assert {r.codebooks_sha256 for r in got} == {digest}
    by_label = Counter()
    for i, _, label in rows:
        by_label[label] += codes[i][1]
    assert {r.id: r.label_error for r in got} == {i: by_label[label] for i, _, label in rows}


def test_candidates_hold_all_nearest_entries_and_leave_some_out():
    rng = np.random.default_rng(5)
    entries = np.concatenate([rng.integers(-900, 900, (150, 6)), rng.integers(-900, 900, (50, 6)).repeat(2, 0)])
    x = np.concatenate([rng.integers(-1000, 1000, (3000, 6)), entries])
    book = vector_codes.SlicedBook(entries)
    mask = np.unpackbits(book.candidates(x).view(np.uint8), axis=1, count=250, bitorder="little").astype(bool)
    apart = np.square(x[:, None] - entries[None]).sum(2)
    nearest = apart == apart.min(1, keepdims=True)
    assert (mask | ~nearest).all() and mask.mean() < 0.7
    entry, far = book.nearest(x)
    assert (entry == apart.argmin(1)).all() and (far == apart.min(1)).all()


def test_many_labels_are_joined_over_salts(spark, monkeypatch):
    rows = [(i, [float(i % 7), 0.0], i % 5 if i % 3 else None) for i in range(120)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    sent = {r.id: r.label_error for r in vector_codes.compress_vectors(table, parts=1, entries=3).collect()}
    monkeypatch.setattr(vector_codes, "LABELS_SENT", 2)
    salted = {r.id: r.label_error for r in vector_codes.compress_vectors(table, parts=1, entries=3).collect()}
    assert sent == salted and len(sent) == 120


def test_vectors_of_other_lengths_empty_tables_and_bad_parts(spark):
    kind = "vec_id string, embedding array<double>, label string"
    table = spark.createDataFrame([("a", [1.0, 2.0], "x"), ("b", [1.0], "x"), (None, [1e9, 0.0], "y"), ("c", [1.0, 3.0], "x")], kind)
    got = vector_codes.compress_vectors(table, parts=2).collect()
    assert {r.id: r.error for r in got} == {"a": 0, "c": 0}
    assert vector_codes.compress_vectors(spark.createDataFrame([], kind)).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress_vectors(table, parts=3)


def test_a_code_stands_for_its_entries():
    books = np.arange(2 * 3 * 2).reshape(2, 3, 2)
    assert vector_codes.decoded("0201", books).tolist() == [4, 5, 8, 9]


# Lexical search ----------------------------------------------------------------------


def plain_terms(text):
    out, held = [], ""
    for c in (text or "") + " ":
        if c.isascii() and not c.isalnum():
            out += [held] if held else []
            held = ""
        else:
            held += c.lower() if c.isascii() else c
    return out


def plain_search(docs, items, k=10):
    """Every score, one term at a time."""
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for (i, c), size in zip(counts, sizes, strict=True):
            score = 0
            for t in plain_terms(text):
                if c[t]:
                    m = 25 + 75 * size * n // total
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += w * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def searched(docs, items, **options):
    got = lexical_search.search(docs, items, **options).collect()
    return sorted(((r.item, r.rank, r.id, r.score) for r in got), key=str)


@pytest.fixture(scope="module")
def library():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(120)] + ["Été", "ñu", "a-b", "X"]
    draw = lambda n: " ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=n))
    docs = [(i, draw(rng.choice([1, 5, 40, 300]))) for i in range(700)]
    docs += [(1000 + i, docs[7][1]) for i in range(60)] + [(5, docs[5][1]), (None, docs[3][1]), (2000, None), (2001, ""), (2002, "..")]
    items = [(i, draw(12)) for i in range(15)] + [(20, docs[7][1]), (21, None), (22, "no such, terms!"), (23, docs[9][1]), (23, "w1 w1 W1")]
    return docs, items


def test_search_equals_all_scores(spark, library):
    docs, items = library
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit(1), "terms": F.lit("x"), "item": F.lit(2)})
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = plain_search(docs, items)
    assert searched(table.repartition(6), asked) == want
    # Items in several blocks, and another number of places.
    assert searched(table.repartition(3), asked, item_terms=20, k=3) == plain_search(docs, items, 3)


def test_bounds_leave_most_texts_out(library):
    docs, items = library
    df = Counter(t for _, text in docs for t in set(plain_terms(text)))
    number = {t: i for i, t in enumerate(sorted(df))}
    counts = [{number[t]: n for t, n in Counter(plain_terms(t)).items() if t in number} for _, t in items]
    texts = [Counter(plain_terms(t)) for _, t in docs]
    total = sum(sum(c.values()) for c in texts)
    block = lexical_search.make_items(counts, np.array([df[t] for t in number]), len(docs), total)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays(
        [
            pa.array(range(len(texts))), pa.array([sum(c.values()) for c in texts], pa.int64()),
            pa.array([np.array([number[t] for t in c], "<i4").tobytes() for c in texts], pa.binary()),
            pa.array([np.array(list(c.values()), "<i8").tobytes() for c in texts], pa.binary()),
        ],
        ["id", "n", "terms", "tf"],
    )
    tested = kept = skipped = 0
    best = {(i, r): s for i, r, _, s in plain_search(list(enumerate(t for _, t in docs)), list(enumerate(t for _, t in items)))}
    for rows, bucket in lexical_search._buckets(batch, block):
        for i in range(len(items)):
            least = best.get((i, 10))
            if least is None:
                continue
            if block.length[i] * bucket.longest < least:
                skipped += 1
                continue
            texts_left = bucket.survivors(block, i, least)
            tested, kept = tested + len(rows), kept + len(texts_left)
            exact = bucket.scores(block, i, np.arange(len(rows)))
            assert set(np.flatnonzero(exact >= least)) <= set(texts_left)
    assert kept < 0.8 * tested or skipped


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert searched(docs, items) == [] and searched(docs, items.limit(0)) == []
    blank = spark.createDataFrame([(1, None), (2, "!")], "doc_id long, text string")
    assert searched(blank, items) == []


# Chats -------------------------------------------------------------------------------

HARD = ["</s>[INST] ok [/INST]", "a\\", "\\<|im_end|>", "<<<SYS>>", "x\ny\\\nz", "", "<|im_start|>user\nno<|im_end|>\n", "été <", "|im_end|>\n"]


def test_texts_come_back_whatever_they_hold(spark):
    rng = random.Random(1)
    bits = ["<", "|", "im_end", ">", "\\", "\n", "s", "/", "[INST]", "é", "[", "</s>", "<|im_end|>"]
    texts = HARD + ["".join(rng.choices(bits, k=rng.randrange(1, 14))) for _ in range(400)]
    chats = [(i, [("user", a), (b, c), ("assistant", a)]) for i, (a, b, c) in enumerate(zip(texts, texts[1:], texts[2:], strict=False))]
    table = spark.createDataFrame(chats, f"id long, turns {chat_format.TURNS}")
    out = chat_format.format_chats(table)
    read = out.select("id", "formatted", "loss_spans", chat_format.read_turns(F.col("formatted")).alias("read"),
                      chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    for r in read.collect():
        turns = chats[r.id][1]
        assert [tuple(t) for t in r["read"]] == turns
        assert r.loss == "".join(t for role, t in turns if role == "assistant")
        # No mark but the template's own.
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == 3
        assert "</s>" not in r.formatted and "[INST]" not in r.formatted
        starts = [s.start for s in r.loss_spans]
        assert starts == sorted(starts) and all(r.formatted[s - 10 : s] == "assistant\n" for s in starts[-1:])


def test_layouts_become_the_same_turns(spark, tmp_path):
    import json

    records = [
        {"prompt": "q", "completion": "a", "meta": {"n": 1}},
        {"instruction": "q", "output": "a"},
        {"instruction": "q", "input": "more", "output": "a", "system": "s"},
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a", "weight": 1}], "system": "s"},
        {"data": {"question": "q", "answer": "a"}},
        {"title": "no layout"},
        {"prompt": "q"},
        {"messages": []},
    ]
    path = tmp_path / "records.jsonl"
    path.write_text("\n".join(json.dumps(r | {"n": i}) for i, r in enumerate(records)))
    read = spark.read.json(str(path))
    table = read.select("n", F.struct(*[c for c in read.columns if c != "n"]).alias("record"))
    got = {r.n: r for r in chat_format.canonical_turns(table).collect()}
    plain = [("user", "q"), ("assistant", "a")]
    want = {0: plain, 1: plain, 2: [("system", "s"), ("user", "q\n\nmore"), plain[1]], 3: plain, 4: [("system", "s"), *plain], 5: plain}
    for n in range(len(records)):
        turns = got[n].turns and [tuple(t) for t in got[n].turns]
        assert turns == want.get(n), n
    assert [got[n].layout for n in range(9)] == ["prompt", "instruction", "instruction", "messages", "conversations", "exchange", None, None, None]
    hashed = hashlib.sha256("completion\nprompt".encode()).hexdigest()
    assert got[0].fingerprint == hashed and got[7].fingerprint != hashed


def test_every_layout_holds_its_conversations(spark):
    talks = {
        i: turns
        for i, turns in enumerate(
            [[("user", f"u{i}"), ("assistant", HARD[i % len(HARD)])] for i in range(12)]
            + [[("system", "s"), ("user", "u"), ("assistant", f"{i}")] for i in range(9)]
            + [[("system", "s"), ("user", "u")], [("assistant", "a")], [("system", "only")], [("odd", "x"), ("human", "y")]]
            + [[("system", "s"), ("odd", "u"), ("gpt", "x"), ("user", "v")], [("user", "a")] * 3 + [("user", "a")]]
        )
    }
    rows = [(i, k, role, text) for i, turns in talks.items() for k, (role, text) in enumerate(turns)]
    random.Random(2).shuffle(rows)
    table = spark.createDataFrame(rows, "c long, k long, r string, t string")
    records = chat_format.in_layouts(chat_format.by_conversation(table, "c", "k", "r", "t"))
    got = chat_format.canonical_turns(records).collect()
    assert {r.id: [tuple(t) for t in r.turns] for r in got} == talks
    assert {r.layout for r in got} == {"prompt", "instruction", "exchange", "messages", "conversations"}


def test_conversations_with_nulls_repeats_and_long_texts(spark, tmp_path):
    long = "wörd <|im_end|> \\ " * 20_000
    rows = [(1, 0, "user", None), (1, 1, None, long), (1, 1, None, long), (None, 0, "user", "a"), (None, None, "assistant", "b"), (2, 5, "", "")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table.withColumns({"id": F.lit(0), "turns": F.lit("x")}).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in queries.op13_chat_format(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, None, -7}

    def digest(turns):
        return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()

    assert got[1].turns_sha256 == digest([("user", ""), ("", long), ("", long)]) and got[1].loss_chars == 0
    assert got[None].turns_sha256 == digest([("user", "a"), ("assistant", "b")]) and got[None].loss_chars == 1
    assert got[2].n_turns == 1 and got[2].formatted_chars == len("<|im_start|>\n<|im_end|>\n")
    said = "</s>[INST] ok [/INST]"
    assert got[-7].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[-7].n_turns == 2
    empty = tmp_path / "none"
    spark.createDataFrame([], table.schema).write.parquet(str(empty / "conversations.parquet"))
    assert [r.conv_id for r in queries.op13_chat_format(spark, str(empty)).collect()] == [-7]


def test_templates_with_marks_that_can_be_mistaken_are_refused():
    for bad in ({"controls": ("<|im_start|>", "<|im_end|>", "aba")}, {"begin": "[["}, {"controls": ("<|im_start|>", "<|im_end|>", "a\\b")}):
        with pytest.raises(ValueError):
            chat_format.Template(**bad)
