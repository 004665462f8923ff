"""The registered queries of the corpus operators, on the smallest tables: those with SQL
against it, the others against plain Python over the same rows."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from segmentry.llm import language_id, queries
from tests.test_registry import values

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def texts():
    table = pq.read_table(DATA / "documents.parquet", columns=["doc_id", "text"])
    return dict(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True))


def rows_of(spark, name, columns):
    frame = queries.queries()[name](spark, str(DATA))
    assert set(columns) <= set(frame.columns)
    return frame.collect()


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    import duckdb

    frame = queries.queries()[name](spark, str(DATA))
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = con.sql(queries.oracle_sql()[name]).df().astype(object).to_dict("records")
    columns = sorted(frame.columns)
    assert sorted(want[0]) == columns
    assert values([r.asDict() for r in frame.collect()], columns) == values(want, columns)


def test_op1_counts_and_base_scores(spark, texts):
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    got = {r.doc_id: r for r in rows_of(spark, "op1_hmm_score", names)}
    tokens = {i: [*(t or "").encode().lower().split(), b"\n"] for i, t in texts.items()}
    c = Counter(w for i, ws in tokens.items() if remainder(i, 5) != 1 for w in ws)
    total, kinds = sum(c.values()), len(c)
    assert set(got) == set(texts)
    for i, ws in tokens.items():
        base = sum(math.log10((c[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in ws)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (remainder(i, 5) == 1, len(ws), sum(c[w] > 0 for w in ws), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    taught = [i for i in texts if remainder(i, 5) != 1]
    assert sum(got[i].score for i in taught) > sum(got[i].base_score for i in taught)


def test_op1_of_a_null_id(spark, tmp_path):
    table = spark.createDataFrame([(None, "a b"), (1, "a"), (7, None)], "doc_id long, text string")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op1_hmm_score(spark, str(tmp_path)).collect()}
    assert got[None].held_out is None and got[None].n_tokens == 3
    assert {i: got[i].held_out for i in (1, 7)} == {i: remainder(i, 5) == 1 for i in (1, 7)}


def test_op3_classes_are_those_of_all_pairs(spark, texts):
    """Exact TF-IDF weights over all shingles, all pairs that share one. With fewer than a
    thousand documents no shingle is rarer than one in a thousand."""
    assert len(texts) <= 1000
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().split()
        sets[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()
    df = Counter(s for x in sets.values() for s in x)
    weight = {s: math.log(1 + len(sets) / n) for s, n in df.items()}
    size = {i: sum(n * weight[s] for s, n in x.items()) for i, x in sets.items()}
    by = defaultdict(list)
    for i, x in sets.items():
        for s in x:
            by[s].append(i)
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = {(a, b) for held in by.values() for a in held for b in held if a < b}
    pairs |= {(a, b) for a in sets for b in sets if a < b and (texts[a] or "") == (texts[b] or "")}
    for a, b in pairs:
        both = sum(min(n, sets[b][s]) * weight[s] for s, n in sets[a].items() if s in sets[b])
        if (texts[a] or "") == (texts[b] or "") or both >= 0.8 * (size[a] + size[b] - both):
            a, b = sorted((top(a), top(b)))
            root[b] = a
    got = {r.doc_id: r.class_id for r in rows_of(spark, "op3_minhash_near_dedup", ("doc_id", "class_id", "class_size", "kept"))}
    assert got == {i: top(i) for i in sets}


def test_op5_counts_are_the_tokenizer_s(spark, texts):
    from segmentry.llm.tokens import default_tokenizer, encoder

    enc = encoder(default_tokenizer(), added=False)
    got = {r.doc_id: r.n_tokens for r in rows_of(spark, "op5_token_counts", ("doc_id", "n_tokens"))}
    assert got == {i: len(enc.ids(t or "")) for i, t in texts.items()}


def test_op6_pieces_are_whole_and_gapless(spark, texts):
    from segmentry.llm.tokens import default_tokenizer, encoder, little_endian

    names = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    got = rows_of(spark, "op6_best_fit_packing", names)
    enc, by, bins = encoder(default_tokenizer()), defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for i, t in texts.items():
        raw = little_endian(enc.ids(t or "")) + bytes(4)
        at = 0
        for k, r in enumerate(sorted(by[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (r.length <= 2048)
            assert r.ids_crc32 == zlib.crc32(raw[4 * at : 4 * (at + r.length)])
            at += r.length
        assert 4 * at == len(raw)
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.05 * sum(r.length for r in got) / 2048 + 1


def test_op7_learns_from_its_fold_only(spark, texts):
    got = {r.doc_id: r for r in rows_of(spark, "op7_language_id", ("doc_id", "held_out", "lang_pred", "score"))}
    table = pq.read_table(DATA / "documents.parquet", columns=["doc_id", "lang"])
    lang = dict(zip(table["doc_id"].to_pylist(), table["lang"].to_pylist(), strict=True))
    learned = {lang[i] for i in lang if lang[i] and remainder(i, 4) != 2}
    for i, t in texts.items():
        letters = any(c.isalpha() for c in t or "")
        assert got[i].held_out == (remainder(i, 4) == 2) and 0 <= got[i].score <= 1
        assert (got[i].lang_pred in learned) if letters else got[i].lang_pred == "und"
    told = [i for i in texts if got[i].held_out and lang[i] and got[i].lang_pred != "und"]
    assert sum(got[i].lang_pred == lang[i] for i in told) >= 0.9 * len(told)


def test_op9_digests_are_those_of_the_payload(spark, texts):
    names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    got = {r.doc_id: r for r in rows_of(spark, "op9_matroska", names)}
    for i, t in texts.items():
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_bytes > len(payload)


def test_repeated_rows_null_ids_and_very_long_texts(spark, tmp_path):
    """Each operator over rows that repeat, an id that is null, a text of 300,000 words and
    columns with names that the operators use."""
    long = " ".join(f"w{k % 977} x{k % 13}" for k in range(150_000))
    rows = [(1, long), (1, long), (None, "a b c"), (None, "a b c"), (2, None), (3, ""), (4, "zeta " * 60)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(1), "id": F.lit("x"), "row": F.lit("y"), "block": F.lit("z")}
    )
    table.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("op1_hmm_score", "op2_exact_dedup", "op3_minhash_near_dedup", "op4_mix_sources", "op5_token_counts",
                 "op7_language_id", "op9_matroska", "op10_substring_dedup"):
        got = queries.queries()[name](spark, str(tmp_path)).collect()
        ids = sorted(str(r.doc_id) for r in got)
        assert ids == ["1", "1", "2", "3", "4", "None", "None"], name
    pieces = queries.op6_best_fit_packing(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == {1, 2, 3, 4, None}
    assert sum(r.start == 0 for r in pieces) == len(rows)


def test_empty_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert queries.op8_url_filter(spark, str(tmp_path)).count() == 0


def plain_votes(model: language_id.Model, text: str) -> tuple[str, float]:
    """Families by duels, then languages of the best family by duels, one weight at a time."""
    bits = model.dimensions.bit_length() - 1

    def place(*codes: int) -> int:
        """The top bits of a mixed 32-bit hash of two or three characters."""
        h = (codes[0] * 0x9E3779B1 + codes[1] * 0x85EBCA6B) % 2**32
        if len(codes) == 3:
            h = (h * 0xC2B2AE35 + codes[2] * 0x27D4EB2F) % 2**32
        h = (h ^ (h >> 15)) * 0x2C1B3C6D % 2**32
        return h >> (32 - bits)

    codes = [ord(c) for c in f" {text.lower()} "]
    counts: dict[int, int] = {}
    for i in range(len(codes) - 1):
        counts[place(*codes[i : i + 2])] = counts.get(place(*codes[i : i + 2]), 0) + 1
    for i in range(len(codes) - 2):
        at = place(*codes[i : i + 3])
        counts[at] = counts.get(at, 0) + 1
    length = math.sqrt(sum(counts.values()))  # of the square roots
    margin = {}
    for k, names in enumerate(model.pairs):
        margin[names] = float(model.intercepts[k])
        for at, n in counts.items():
            margin[names] += math.sqrt(n) / length * float(model.weights[at, k])

    def winner(names: list[str]) -> tuple[str, float]:
        won, sums = {n: 0 for n in names}, {n: 0.0 for n in names}
        for (a, b), m in margin.items():
            if a in won and b in won:
                won[b if m > 0 else a] += 1
                sums[a], sums[b] = sums[a] - m, sums[b] + m
        best = sorted(names, key=lambda n: (won[n], sums[n], n))[-1]
        own = [m if b == best else -m for (a, b), m in margin.items() if a in won and b in won and best in (a, b)]
        return best, 1 / (1 + math.exp(-4 * min(own))) if own else 1.0

    family, sure = winner(sorted(model.families))
    language, surer = winner(model.families[family])
    return language, sure * surer


def test_op7_predictions_are_those_of_plain_duels(spark, texts):
    """The query's answers against hashes, vectors, duels and votes written out."""
    docs = spark.read.parquet(str(DATA / "documents.parquet")).select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    got = {r.doc_id: r for r in rows_of(spark, "op7_language_id", ("doc_id", "held_out", "lang_pred", "score"))}
    some = [i for i, t in sorted(texts.items()) if t and any(c.isalpha() for c in t) and len(t) < 4000][:150]
    assert len(model.families) > 1 and any(len(f) > 1 for f in model.families.values())
    for i in some:
        language, score = plain_votes(model, texts[i])
        assert got[i].lang_pred == language and math.isclose(got[i].score, score, abs_tol=1e-4)


def test_op7_predictions_do_not_depend_on_the_batch(spark, texts):
    """A text alone gets what it gets among all others."""
    docs = spark.read.parquet(str(DATA / "documents.parquet")).select("doc_id", "text", "lang")
    model = language_id.fit(docs)
    some = [t for t in texts.values() if t and any(c.isalpha() for c in t)][:40]
    together = model.predict(some)
    alone = [model.predict([t])[0] for t in some]
    assert [n for n, _ in together] == [n for n, _ in alone]
    assert np.allclose([p for _, p in together], [p for _, p in alone])
