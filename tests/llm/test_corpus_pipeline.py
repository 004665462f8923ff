"""Every stage of the pipeline on its own input, and the whole of it."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from segmentry.llm.common import materialize
from segmentry.llm.tokens import Encoder, default_tokenizer

PARTS = {"en": "the of and tion er ent ing th wh ly".split(), "de": "der sch ung ein ich keit zu ver ö ß".split()}


def make(seed: int, lang: str, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS[lang], k=3)) for _ in range(n)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output rows of each stage, each written and read again."""
    texts = []
    for i in range(60):
        words = make(i, ["en", "de"][i % 2], 80 + i)
        texts.append((" ".join(words), ["en", "de"][i % 2]))
        if i % 10 == 0:
            texts.append(texts[-1])
            words[40] = "edited"
            texts.append((" ".join(words), None))
    texts += [(None, "en"), ("", None), ("12 ?!", "de"), (" ".join(make(99, "en", 3000)), "en")]
    rows = [(i, t, lang, "big" if i % 3 else "small", len(t or "")) for i, (t, lang) in enumerate(texts)]
    root = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(
        2
    ).write.parquet(str(root / "documents.parquet"))
    docs, seen = spark.read.parquet(str(root / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        given = [tuple(r) for r in docs.collect()]
        stage(spark, docs, str(root)).write.parquet(str(root / name))
        docs = spark.read.parquet(str(root / name))
        seen.append((name, given, docs.columns, docs.collect()))
    return root, {name: rest for name, *rest in seen}


def test_stage_names_and_columns(stages):
    _, seen = stages
    assert [n for n, _ in corpus_pipeline.STAGES] == list(seen)
    for name, (_, columns, _) in seen.items():
        if name != "packing":
            assert columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_stage_drops_what_has_no_letter(stages):
    given, _, out = stages[1]["language_id"]
    assert sorted(map(tuple, out), key=str) == sorted((r for r in given if any(c.isalpha() for c in r[1] or "")), key=str)


def test_exact_stage_keeps_the_smallest_id_of_each_text(stages):
    given, _, out = stages[1]["exact_dedup"]
    first = {}
    for r in sorted(given):
        first.setdefault(r[1], r)
    assert sorted(map(tuple, out)) == sorted(first.values())


def test_near_stage_drops_the_edited_copies(stages):
    given, _, out = stages[1]["near_dedup"]
    edited = {r[0] for r in given if "edited" in r[1].split()}
    assert len(edited) == 6 and {r.doc_id for r in out} == {r[0] for r in given} - edited


def test_mix_stage_repeats_whole_rows(stages):
    given, _, out = stages[1]["source_mix"]
    taken = Counter(r.doc_id for r in out)
    assert {tuple(r) for r in out} <= set(given)
    tokens, spent = Counter(), Counter()
    for r in given:
        tokens[r[3]] += len(r[1].split())
        spent[r[3]] += len(r[1].split()) * taken[r[0]]
    for source in tokens:
        counts = {taken[r[0]] for r in given if r[3] == source}
        assert max(counts) - min(counts) <= 1
    before, after = (c["small"] / sum(c.values()) for c in (tokens, spent))
    longest = {s: max(len(r[1].split()) for r in given if r[3] == s) for s in tokens}
    assert abs(after - 0.5) <= abs(before - 0.5) + 0.02
    assert sum(spent.values()) <= sum(tokens.values()) + sum(longest.values()) / 2


def test_packing_stage_packs_every_row(stages):
    given, _, out = stages[1]["packing"]
    enc = Encoder(default_tokenizer())
    assert sum(r.length for r in out) == sum(len(enc.ids(r[1])) + 1 for r in given)
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048


def test_run_gives_the_last_stage(spark, stages):
    root, seen = stages
    out = corpus_pipeline.run(spark, str(root)).collect()
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(tuple(r[c] for c in columns) for r in out) == sorted(tuple(r[c] for c in columns) for r in seen["packing"][2])


def test_every_stage_takes_odd_columns_null_ids_and_repeats(spark, tmp_path):
    texts = [" ".join(make(i, ["en", "de"][i % 2], 40)) for i in range(24)]
    rows = [(i, t, ["en", "de"][i % 2], "s") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[4], "en", None), (None, texts[4], "en", None), (90, None, "en", "s"), (91, "", None, None)]
    table = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("a`b", "x.y", "row", "copies", "id", "label", "block", "TEXT2"):
        table = table.withColumn(name, F.lit(name))
    docs, given = table, len(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, ""), f"odd-{name}")
        assert docs.columns == table.columns
        out = docs.collect()
        assert all(r["a`b"] == "a`b" and r["x.y"] == "x.y" and r["copies"] == "copies" for r in out)
        given = len(out) if name == "source_mix" else given
    kept = {r.doc_id for r in out}
    assert kept <= {*range(24), None} and len(kept) > 12
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert sum(r.start == 0 for r in pieces) == given


def test_an_empty_table_goes_through(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], kind).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
