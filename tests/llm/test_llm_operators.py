"""The corpus operators against brute force, round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from segmentry.llm import (
    blocks,
    exact_dedup,
    hmm_score,
    language_id,
    matroska,
    minhash_dedup,
    mixing,
    packing,
    substring_dedup,
    token_counts,
    url_filter,
)
from segmentry.llm.tokens import Encoder, default_tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and tion er ent ing ation re on es an in at ou ea ha th st nd".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(WORDS, k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Prose with copies, near copies, nulls, blanks, one long text and shared passages."""
    base = [prose(i, 60 + 7 * i) for i in range(30)]
    shared = prose(999, 60)
    near = base[5].split()
    near[40] = "changed"
    texts = [
        *base,
        *[base[3]] * 12,
        " ".join(near),
        f"{prose(50, 30)} {shared} {prose(51, 20)}",
        f"{prose(52, 10)} {shared}",
        None, "", " \n", "12 34", "word", prose(7777, 6000), "a " * 200,
        "été — Straße <|endoftext|> \x0b x",
    ]
    langs = ["en", "de", None]
    return [
        (i, t, langs[i % 3], ["s0", "s0", "s1", None][i % 4], len(t or "")) for i, t in enumerate(texts)
    ]


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def clashing(docs):
    """Extra columns with names that the operators use inside."""
    extra = ("id", "row", "digest", "key", "copies", "node", "length", "n_tokens", "block")
    return docs.withColumns({c: F.lit("x") for c in extra})


# -- exact dedup -----------------------------------------------------------------------


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_groups_match_brute_force(docs, rows, keep):
    by = defaultdict(list)
    for i, t, *_ in rows:
        by[t or ""].append(i)
    pick = min if keep == "smallest" else max
    want = {i: (pick(by[t or ""]), len(by[t or ""])) for i, t, *_ in rows}
    got = exact_dedup.exact_groups(docs, keep=keep, rounds=3, slice_size=4).collect()
    assert {r.id: (r.keep_id, r.group_size) for r in got} == want and len(got) == len(rows)
    assert all(r.kept == (r.id == r.keep_id) for r in got)
    texts = {i: (t or "") for i, t, *_ in rows}
    assert all(r.text_sha256 == hashlib.sha256(texts[r.id].encode()).hexdigest() for r in got)


def test_exact_dedup_of_repeated_rows_null_ids_and_other_columns(spark, clashing):
    many = spark.createDataFrame(
        [(1, "a"), (1, "a"), (None, "a"), (2, "a"), (None, "b"), (3, None), (4, "")],
        "doc_id long, text string",
    )
    got = exact_dedup.exact_groups(many).collect()
    assert {(r.keep_id, r.group_size) for r in got if r.kept} == {(1, 4), (3, 2), (None, 1)}
    assert sum(r.kept for r in got) == 3
    assert exact_dedup.drop_exact_copies(many).count() == 3
    out = exact_dedup.drop_exact_copies(clashing)
    assert out.columns == clashing.columns and out.count() == len({t or "" for t in (r.text for r in clashing.collect())})


def test_trees_of_any_shape_merge_to_the_same_entries(docs):
    found = [
        {(r.id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs, rounds=r, slice_size=s).collect()}
        for r, s in ((1, 1), (2, 8192), (5, 3))
    ]
    assert found[0] == found[1] == found[2]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_every_level_holds_sorted_verified_runs(spark, keep):
    """64 runs to 8 to 1; two texts that the digest confuses stay apart at each level."""
    rng = random.Random(3)
    made = [(i, 10 * i, i % 64, *((b"same", b"%d" % (i % 2)) if i < 9 else (b"%d" % rng.randint(0, 40), b"c"))) for i in range(600)]
    rows = spark.createDataFrame(made, "id long, row long, part int, digest binary, check binary")
    runs = exact_dedup.first_runs(rows, keep, 3)
    pick = min if keep == "smallest" else max
    want = defaultdict(list)
    for i, _, _, digest, check in made:
        want[digest, check].append(i)
    for bits, number in ((0, 64), (3, 8), (3, 1)):
        runs = exact_dedup.merge_round(runs, keep, bits) if bits else runs
        table = defaultdict(list)
        for r in sorted(runs.collect(), key=lambda r: (r.run, r["slice"])):
            table[r.run] += [(bytes(e.digest), bytes(e.check), e.best.id, e.n) for e in r.entries]
        assert len(table) == number
        for run in table.values():
            keys = [e[:2] for e in run]
            assert keys == sorted(set(keys))
    assert table[0] == [(*k, pick(v), len(v)) for k, v in sorted(want.items())]


# -- near dedup ------------------------------------------------------------------------


def weighted_jaccard(a: Counter, b: Counter, idf: dict) -> float:
    both = sum(min(n, b[k]) * idf[k] for k, n in a.items() if k in b)
    return both / (sum(n * idf[k] for k, n in a.items()) + sum(n * idf[k] for k, n in b.items()) - both)


def damped(df: Counter, total: int) -> dict:
    """Weights of shingles: one, but less where more than a quarter of all texts have one."""
    return {k: 0.5 + 0.5 * min(1.0, math.log(total / n, 4)) for k, n in df.items()}


def test_near_duplicates_match_brute_force(spark, tmp_path):
    rng = random.Random(5)
    texts = []
    for g in range(12):
        base = prose(g, 150).split()
        texts.append(" ".join(base))
        for _ in range(g % 5):
            copy = list(base)
            for _ in range(rng.choice([1, 2, 9])):
                copy[rng.randrange(len(copy))] = f"edit{rng.random()}"
            texts.append(" ".join(copy))
    texts += [texts[0], None, "", "four words are here", "four words are here"]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    table.repartition(3).write.parquet(str(tmp_path / "t"))
    got = {r.id: r for r in minhash_dedup.near_duplicates(spark.read.parquet(str(tmp_path / "t"))).collect()}

    def shingles(t):
        w = (t or "").split()
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    sets = [shingles(t) for t in texts]
    df = Counter(k for s in sets for k in s)
    idf = damped(df, len(texts))
    group = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        same = (texts[a] or "") == (texts[b] or "")
        if same or (sets[a] and sets[b] and weighted_jaccard(sets[a], sets[b], idf) >= 0.8):
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = [new if g == old else g for g in group]
    assert [got[i].class_id for i in range(len(texts))] == group
    assert all(got[i].kept == (group[i] == i) for i in got)
    assert all(got[i].class_size == group.count(group[i]) for i in got)


def test_frequencies_are_exact_with_more_shingles_than_any_table_of_features(spark, tmp_path):
    rng = np.random.default_rng(8)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    common = words(1004)  # in 90 % of the documents
    texts = [" ".join([*common, *words(100)]) for _ in range(2)]
    texts += [" ".join([*common, *words(2000)]) for _ in range(358)]
    texts += [" ".join(words(2500)) for _ in range(40)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table.repartition(3).write.parquet(str(tmp_path / "t"))
    sets = [Counter(zip(*(t.split()[i:] for i in range(5)), strict=False)) for t in texts]
    df = Counter(k for s in sets for k in s)
    assert len(df) > 3 * (1 << 18)
    # Alike shingle by shingle, but for what nearly all have in common.
    assert weighted_jaccard(sets[0], sets[1], dict.fromkeys(df, 1.0)) > 0.82
    assert 0.70 < weighted_jaccard(sets[0], sets[1], damped(df, len(texts))) < 0.77
    got = {r.id: r.class_id for r in minhash_dedup.near_duplicates(spark.read.parquet(str(tmp_path / "t"))).collect()}
    assert all(got[i] == i for i in range(len(texts)))


@pytest.mark.parametrize("others", [40, 150, 20_000])
def test_a_group_of_copies_does_not_hide_itself_in_any_number_of_documents(spark, tmp_path, others):
    """Twelve copies with an edit each, 0.818 similar shingle by shingle: weights that grow
    with the number of documents would take them below 0.8."""
    base = [f"b{i}" for i in range(104)]
    texts = []
    for k in range(12):
        copy = list(base)
        copy[4 + 8 * k] = f"edit{k}"
        texts.append(" ".join(copy))
    sets = [Counter(zip(*(t.split()[i:] for i in range(5)), strict=False)) for t in texts]
    df, total = Counter(k for s in sets for k in s), 12 + others
    plain = {k: math.log1p(total / n) for k, n in df.items()}
    assert all(weighted_jaccard(a, b, plain) < 0.8 for a, b in itertools.combinations(sets, 2))
    assert all(weighted_jaccard(a, b, damped(df, total)) > 0.81 for a, b in itertools.combinations(sets, 2))
    texts += [f"word{i}" for i in range(others)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table.write.parquet(str(tmp_path / "t"))
    got = minhash_dedup.near_duplicates(spark.read.parquet(str(tmp_path / "t"))).where("class_id <> id OR class_size > 1")
    assert sorted((r.id, r.class_id, r.class_size) for r in got.collect()) == [(i, 0, 12) for i in range(12)]


def test_planted_copies_are_found_even_where_a_group_is_a_third_of_all(spark, tmp_path):
    """Copies with every thirtieth to sixtieth word changed; recall of pairs of 0.8 or more."""
    rng = random.Random(17)
    texts, planted = [], []
    for g in range(60):
        base = prose(100 + g, 200).split()
        for _ in range(90 if g == 0 else 1 + g % 4):
            copy = list(base)
            for at in rng.sample(range(200), rng.randrange(0, 4)):
                copy[at] = f"x{rng.random()}"
            planted.append(g)
            texts.append(" ".join(copy))
    assert planted.count(0) > len(texts) / 3
    sets = [set(zip(*(t.split()[i:] for i in range(5)), strict=False)) for t in texts]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    table.write.parquet(str(tmp_path / "t"))
    got = {r.id: r.class_id for r in minhash_dedup.near_duplicates(spark.read.parquet(str(tmp_path / "t"))).collect()}
    close = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(close) > 1000 and sum(got[a] == got[b] for a, b in close) >= 0.98 * len(close)
    assert all(planted[i] == planted[c] for i, c in got.items())  # and no class has two origins


def test_samples_agree_as_often_as_the_sets_are_similar():
    rng = np.random.default_rng(3)
    h = np.unique(rng.integers(0, 1 << 63, 900, dtype=np.int64).view(np.uint64))
    a, b = h[:700], h[200:]
    wa, wb = rng.uniform(0.5, 3, len(h))[:700], rng.uniform(0.5, 3, len(h))[200:]
    by_a, by_b = dict(zip(a.tolist(), wa, strict=True)), dict(zip(b.tolist(), wb, strict=True))
    keys = by_a.keys() | by_b.keys()
    low = sum(min(by_a.get(k, 0), by_b.get(k, 0)) for k in keys)
    high = sum(max(by_a.get(k, 0), by_b.get(k, 0)) for k in keys)
    drawn = [minhash_dedup.samples(x, w, np.array([0]), 4000)[0] for x, w in ((a, wa), (b, wb))]
    assert abs((drawn[0] == drawn[1]).mean() - low / high) < 0.03


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 9)] + [(300, 301)]
    got = {r.node: r.label for r in minhash_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, **{100 + i: 100 for i in range(9)}, 300: 300, 301: 300}


def test_large_buckets_are_compared_tile_by_tile(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "LARGE", 3)
    monkeypatch.setattr(minhash_dedup, "TILE", 7)
    base = prose(1, 120).split()
    texts = []
    for i in range(40):  # a chain: neighbours are similar, the ends are not
        base[3 * i % 120] = f"new{i}"
        texts.append(" ".join(base))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    got = minhash_dedup.near_duplicates(spark.read.parquet(str(tmp_path / "t"))).collect()
    assert len({r.class_id for r in got}) == 1


def test_shared_weights_are_those_of_every_pair():
    names = minhash_dedup.Names()
    texts = [prose(i % 3, 60) + " x y" * (i % 4) + f" end{i}" for i in range(9)]
    texts += ["a " * 30, "a " * 40, "a " * 7 + "b"]
    sets = [minhash_dedup.shingles(t, names) for t in texts]
    idf = np.random.default_rng(0).uniform(1, 5, 1 << 10).astype(np.float32)
    shared, own = minhash_dedup.shared_weights(sets, idf)

    def weights(s):
        return {int(h): int(n) * float(idf[int(h) & 1023]) for h, n in zip(*s, strict=True)}

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = weights(sets[i]), weights(sets[j])
        assert math.isclose(shared[i, j], sum(min(w, b.get(h, 0)) for h, w in a.items()), abs_tol=1e-9)
        assert math.isclose(own[i], sum(a.values()))


# -- mixing ----------------------------------------------------------------------------


def test_mix_meets_its_targets(spark):
    sizes = {"a": 600, "b": 60, "c": 20, None: 40}
    rows = [(i, "w " * (1 + i % 5), s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.source_mix(table, entropy_share=0.9, max_epochs=5.0).collect()
    assert len(got) == len(rows)
    tokens, taken, weight = Counter(), Counter(), {}
    for r in got:
        tokens[r.source] += r.n_tokens
        taken[r.source] += r.n_tokens * r.copies
        weight[r.source] = r.weight
    total = sum(tokens.values())
    alpha = got[0].alpha
    mass = {s: (n / total) ** alpha for s, n in tokens.items()}
    for s in sizes:
        assert abs(weight[s] - mass[s] / sum(mass.values())) < 1e-6
        assert abs(weight[s] * total - taken[s]) <= 3.5  # half a document, and rounding down
    entropy = -sum(w * math.log2(w) for w in weight.values())
    most = max(weight[s] * total / tokens[s] for s in sizes)
    assert most <= 5.0 + 1e-3 and (abs(entropy - 0.9 * 2) < 1e-3 or abs(most - 5) < 1e-3)


@pytest.mark.parametrize(
    "sizes",
    [
        {"long": [100], "short": [5] * 12},
        {"twin": [7, 7], "other": [3, 3, 3]},
        {"first": [400, 1, 1, 1], "second": [9] * 40, "third": [2] * 7},
        {f"host{i}": [3 + i % 2] for i in range(30)},
    ],
)
def test_every_source_gets_its_tokens_within_half_a_document(spark, sizes):
    rows, twins = [], {}
    for s, each in sizes.items():
        for n in each:
            key = len(rows) if s != "twin" else 0  # equal rows have one place
            rows.append((key, "w " * n, s))
            twins[s, key] = twins.get((s, key), 0) + n
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.source_mix(table, entropy_share=0.97, max_epochs=4.0).collect()
    total = sum(len(t.split()) for _, t, _ in rows)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        longest = max(n for (name, _), n in twins.items() if name == s)
        assert abs(mine[0].weight * total - sum(r.n_tokens * r.copies for r in mine)) <= longest / 2 + 1


def test_mix_repeats_whole_rows_and_takes_empty_tables(docs, clashing, empty):
    marks = {r.id: r.copies for r in mixing.source_mix(docs, entropy_share=0.97).collect()}
    out = mixing.apply_mix(clashing, entropy_share=0.97)
    assert out.columns == clashing.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({i: n for i, n in marks.items() if n})
    assert mixing.source_mix(empty, entropy_share=0.97).count() == 0
    assert mixing.apply_mix(empty, max_epochs=2.0).count() == 0


def test_without_targets_every_document_is_taken_once(docs):
    assert {r.copies for r in mixing.source_mix(docs).collect()} <= {0, 1}


# -- tokens ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def ids(rows):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(default_tokenizer())
    return {i: plain.encode(t or "", add_special_tokens=False).ids for i, t, *_ in rows}


def test_encoder_gives_the_ids_of_the_tokenizer_file(rows, ids):
    enc = Encoder(default_tokenizer())
    assert all(enc.ids(t or "").tolist() == ids[i] for i, t, *_ in rows)


@pytest.mark.parametrize("block_ids", [7, 64, 1 << 17])
def test_token_counts_stitch_documents_over_blocks(docs, rows, block_ids):
    enc = Encoder(default_tokenizer(), added=False)
    got = token_counts.document_token_counts(docs, block_ids=block_ids).collect()
    assert {r.id: r.n_tokens for r in got} == {i: len(enc.ids(t or "")) for i, t, *_ in rows}
    by_file = defaultdict(list)
    for r in got:
        by_file[r.file].append(r)
    for found in by_file.values():
        at = 0
        for k, r in enumerate(sorted(found, key=lambda r: r.ordinal)):
            assert (r.ordinal, r.start) == (k, at)
            at += r.n_tokens + 1


def test_ids_too_large_for_the_file_are_an_error(docs):
    with pytest.raises(Exception, match="too large"):
        token_counts.document_token_counts(docs, id_bytes=1, end_id=7).collect()


def test_token_counts_of_files_with_spans_and_an_open_end(spark, tmp_path):
    rng = random.Random(1)
    sizes = [rng.choice([0, 1, 5, 40]) for _ in range(60)]
    flat = b"".join(struct.pack(f"<{n + 1}H", *[5] * n, 9) for n in sizes) + struct.pack("<3H", 5, 5, 5)
    (tmp_path / "a.bin").write_bytes(flat)
    (tmp_path / "b.bin").write_bytes(b"")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    blocks = token_counts.blocks_of_files(files, block_bytes=16)
    got = sorted(token_counts.token_counts(blocks, end_id=9, span=4).collect(), key=lambda r: r.ordinal)
    assert [r.n_tokens for r in got] == [*sizes, 3] and [r.ended for r in got] == [True] * 60 + [False]


def test_packing_is_whole_gapless_and_tight(docs, rows, ids):
    got = packing.pack_documents(docs).collect()
    pieces = defaultdict(list)
    for r in got:
        pieces[r.id].append(r)
    for i, _, *_ in rows:
        whole, at = [*ids[i], 0], 0
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r.piece)):
            part = whole[at : at + r.length]
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            assert r.length == 2048 or k == 0
            at += r.length
        assert at == len(whole)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(bins) <= total / 2048 + 5


def test_bounded_bins_close_the_fullest_first():
    fit = packing.BestFit(capacity=10, open_bins=2)
    assert fit.place(4) == (0, 0) and fit.place(7) == (1, 0)
    assert fit.place(8) == (2, 0)  # bin 1, with 3 free, was the fullest
    assert fit.place(3) == (0, 4) and fit.place(2) == (2, 8)
    assert fit.in_use == 1 and fit.bits == 1 << 3


@pytest.mark.parametrize("open_bins", [1, 3, 4096])
def test_bins_hold_what_is_placed(open_bins):
    rng = random.Random(open_bins)
    fit, bins = packing.BestFit(100, open_bins), defaultdict(list)
    for _ in range(500):
        n = rng.randint(1, 100)
        b, at = fit.place(n)
        assert at == sum(bins[b]) and at + n <= 100 and fit.in_use <= open_bins
        bins[b].append(n)


# -- language ID -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def spoken(spark):
    parts = {
        "en": "the of and tion er ent ing th wh ly".split(),
        "de": "der sch ung ein ich keit zu ver ö ß".split(),
        "fr": "le eau eux tion é è ç que oi vi".split(),
        "es": "el ción ado ñ de os as ll rr mente".split(),
        "xx": "зд ова ть ий ые ого ст пр на по".split(),
    }
    rng = random.Random(0)
    made = [
        (i, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(40)), lang)
        for i, lang in enumerate(list(parts) * 40)
    ]
    return spark.createDataFrame(made, "doc_id long, text string, lang string").repartition(2).cache()


def test_languages_are_told_on_held_out_texts(spoken):
    model = language_id.fit(spoken.where("doc_id % 4 <> 2"))
    got = language_id.identify(spoken, model).join(spoken.withColumnRenamed("doc_id", "id"), "id").collect()
    held = [r for r in got if r.id % 4 == 2]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_texts_without_letters_are_undetermined(spark, spoken, docs, clashing, empty):
    model = language_id.fit(spoken)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !? 3"), (4, "x")], "doc_id long, text string")
    got = {r.id: r for r in language_id.identify(odd, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[4].lang_pred != "und"
    assert got[1].score == 0
    kept = language_id.keep_identified(clashing, model)
    assert kept.columns == clashing.columns
    lettered = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert {r.doc_id for r in kept.collect()} == lettered
    assert language_id.identify(empty, model).count() == 0


def test_training_on_one_language_or_none(spoken, empty):
    one = language_id.fit(spoken.where("lang = 'de'"))
    assert {(r.lang_pred, r.score) for r in language_id.identify(spoken, one).collect()} == {("de", 1.0)}
    none = language_id.fit(empty)
    assert {r.lang_pred for r in language_id.identify(spoken, none).collect()} == {"und"}


def test_equal_texts_get_equal_answers(spark, spoken):
    model = language_id.fit(spoken)
    twice = spoken.unionByName(spoken.withColumn("doc_id", F.col("doc_id") + 1000))
    got = {r.id: (r.lang_pred, r.score) for r in language_id.identify(twice.repartition(3), model).collect()}
    assert all(got[i][0] == got[i + 1000][0] and abs(got[i][1] - got[i + 1000][1]) < 1e-5 for i in range(200))


# -- URL filter ------------------------------------------------------------------------


@pytest.mark.parametrize("broadcast_bytes", [0, 8 << 20])
def test_urls_against_brute_force(spark, broadcast_bytes):
    urls = [
        None, "", "no scheme/x", "http://A.example.COM/de/1?x=1", "https://example.net/en/2#f",
        "http://badexample.net/en/", "http://x.org/fr", "http://x.org/fr/9", "http://w.io/p/?utm_source=a&b=2",
        "https://www.w.io:443/p?b=2", "http://w.io/p?b=3", "http://h?q", "://", "http://net/", "http://a.net",
    ]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(99, urls[9])], "page_id long, url string")
    listed = spark.createDataFrame([("http://w.io/p?b=2",), ("http://w.io/p?b=2",), (None,)], "url string")
    rules = [
        url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "example.net", "/en/"),
        url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/"),
    ]
    got = {r.id: r for r in url_filter.judge_urls(pages, listed, rules, broadcast_bytes=broadcast_bytes).collect()}
    assert len(got) == len(urls) + 1
    assert [(got[i].host, got[i].path) for i in (0, 1, 2)] == [("", "")] * 3
    assert (got[3].host, got[3].path, got[3].rule) == ("a.example.com", "/de/1", "example.com/de/")
    assert (got[4].rule, got[4].verdict) == ("example.net/en/", "allow")
    assert (got[5].rule, got[5].verdict) == ("net/", "block")
    assert got[6].rule is None and got[7].rule == "org/fr/"
    assert got[13].rule == "net/" and got[14].rule is None
    assert [got[i].listed for i in (8, 9, 10, 99)] == [True, True, False, True]
    assert (got[8].verdict, got[10].verdict) == ("block", "allow")


def test_the_filter_never_misses_and_seldom_errs(spark):
    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"))
    n = -(-4000 * url_filter.BITS_PER_KEY // 512)
    blocks = url_filter.build_filter(keys, n)
    asked = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"), "id")
    got = url_filter.possible_hits(asked, "key", blocks, n, 8 << 20)
    assert got.where("id < 4000 AND NOT possible").count() == 0
    assert got.where("id >= 4000 AND possible").count() < 160


def test_an_empty_list_blocks_nothing(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    got = url_filter.judge_urls(pages, pages.where("false")).collect()
    assert [(r.rule, r.verdict, r.listed) for r in got] == [(None, "allow", False)]


# -- Matroska --------------------------------------------------------------------------


def test_texts_survive_the_store(docs, rows):
    got = {r.id: r for r in matroska.media_features(matroska.store_texts(docs)).collect()}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_sha256 == hashlib.sha256(matroska.mux(payload)).hexdigest()


@pytest.mark.parametrize("n", [64, 512, 4096, 4160, 300_032, 700_032])
def test_round_trip_of_payloads(n):
    payload = random.Random(n).randbytes(n)
    media = matroska.mux(payload)
    assert matroska.demux(media) == payload
    cues = [x for x in matroska.parse(media) if isinstance(x, matroska.Cue)]
    packets = [x for x in matroska.parse(media) if isinstance(x, matroska.Packet)]
    assert len(cues) == packets[-1].cluster + 1
    assert all(media[c.cluster_start : c.cluster_start + 4] == b"\x1f\x43\xb6\x75" for c in cues)
    assert [p.timestamp for p in packets] == sorted(p.timestamp for p in packets)


def test_lacing_unknown_sizes_and_block_groups():
    def element(ident, body, unknown=False):
        size = b"\x01\xff\xff\xff\xff\xff\xff\xff" if unknown else matroska.write_number(len(body))
        return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size + body

    frames = [b"a" * 300, b"b" * 10, b"c" * 700, b"d"]
    blocks = b""
    for kind in (matroska.XIPH, matroska.EBML_LACING):
        blocks += element(0xA3, b"\x82" + struct.pack(">hB", -5, 0x80 | kind << 1) + matroska.lace(frames, kind))
    blocks += element(0xA0, element(0xA1, b"\x81\x00\x07\x00plain") + element(0xFB, b"\x01"))
    blocks += element(0xA0, element(0xA1, b"\x81\x00\x08\x00key") + element(0x9B, b"\x05"))
    cluster = element(0x1F43B675, element(0xE7, b"\x64") + blocks, unknown=True)
    media = element(0x1A45DFA3, b"") + element(0x18538067, element(0xEC, b"zz") + cluster, unknown=True)
    got = [x for x in matroska.parse(media)]
    assert [media[p.start : p.start + p.length] for p in got] == frames * 2 + [b"plain", b"key"]
    assert [p.timestamp // 1_000_000 for p in got] == [95] * 8 + [107, 108]
    assert [p.track for p in got] == [2] * 8 + [1, 1]
    assert [p.keyframe for p in got[-2:]] == [False, True]


def test_frames_of_a_lace_follow_by_duration():
    def element(ident, body):
        return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + matroska.write_number(len(body)) + body

    track = element(0xAE, element(0x23E383, (20_000_000).to_bytes(4, "big")) + element(0xD7, b"\x01"))
    laced = matroska.lace([b"ab", b"cd", b"ef"], matroska.FIXED)
    blocks = element(0xA3, b"\x81\x00\x05\x04" + laced)
    blocks += element(0xA0, element(0xA1, b"\x81\x00\x64\x04" + laced) + element(0x9B, b"\x1e"))
    cluster = element(0x1F43B675, element(0xE7, b"\x00") + blocks)
    head = element(0x1A45DFA3, b"")
    media = head + element(0x18538067, element(0x1654AE6B, track) + cluster)
    assert [p.timestamp // 1_000_000 for p in matroska.parse(media)] == [5, 25, 45, 100, 110, 120]
    times = [p.timestamp for p in matroska.parse(matroska.mux(bytes(5000))) if isinstance(p, matroska.Packet)]
    assert times == [64_000_000 * k for k in range(10)]
    beyond = head + element(0x18538067, element(0x1F43B675, b"\xe7\x85\x00")) + bytes(9)
    with pytest.raises(matroska.Malformed, match="its parent"):
        list(matroska.parse(beyond))
    coded = head + element(0x18538067, element(0x1654AE6B, element(0xAE, element(0x6D80, b""))))
    with pytest.raises(matroska.Malformed, match="encodings"):
        list(matroska.parse(coded))


def test_packet_and_cue_tables_of_broken_media(spark):
    good = matroska.mux(bytes(range(256)) * 40)
    table = spark.createDataFrame(
        [(1, good), (2, good[:-20]), (3, b"junk"), (4, b""), (5, None)], "id long, media binary"
    )
    got = defaultdict(list)
    for r in matroska.packet_table(table, "id", "media").collect():
        got[r.id].append(r)
    assert len(got[1]) == 20 and all(r.error is None for r in got[1])
    assert [r.error is None for r in got[3]] == [False] and [r.error for r in got[4]] == ["no bytes"]
    assert got[2][-1].error and 5 not in got
    assert matroska.cue_table(table.where("id = 1"), "id", "media").count() == 1


# -- substring dedup -------------------------------------------------------------------


def without_repeats(texts: list[str | None], window: int) -> list[tuple[int, int, str]]:
    words = [[w for w in (t or "").encode().split()] for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def test_repeated_windows_match_brute_force(docs, rows):
    got = {r.id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs).collect()}
    assert [got[i] for i, *_ in rows] == without_repeats([t for _, t, *_ in rows], 35)


@pytest.mark.parametrize("window", [2, 7, 35])
def test_windows_of_any_width_over_few_words(spark, tmp_path, window):
    rng = random.Random(window)
    texts = [" ".join(rng.choices("ab", k=rng.randint(0, 120))) for _ in range(40)]
    texts += ["a " * 90, "a b " * 60, None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "t"))
    got = {r.id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(spark.read.parquet(str(tmp_path / "t")), window=window).collect()}
    assert [got[i] for i in range(len(texts))] == without_repeats(texts, window)


def reshuffled(docs):
    """``docs`` in another order each time that a job reads it."""

    def shuffled(batches):
        for batch in batches:
            yield batch.take(np.random.default_rng().permutation(batch.num_rows))

    return docs.coalesce(1).mapInArrow(shuffled, docs.schema)


def test_rows_are_numbered_once(spark):
    texts = {i: prose(100 + i, 120) for i in range(40)}
    texts |= {40 + i: texts[i] for i in range(0, 40, 3)}  # copies go, all others stay
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    left = minhash_dedup.drop_near_copies(reshuffled(table)).collect()
    assert sorted((r.doc_id, r.text) for r in left) == [(i, texts[i]) for i in range(40)]
    got = {r.id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(reshuffled(table)).collect()}
    assert got == dict(zip(texts, without_repeats(list(texts.values()), 35), strict=True))


def test_rounds_keep_every_repeat_and_settle_the_rest():
    """Names of all blocks at once: what a bucket gives, without Spark."""
    rng = np.random.default_rng(0)
    texts = [rng.integers(1, 60, n) for n in (4000, 0, 30, 9000, 2500)]
    texts[3][100:180] = texts[0][3000:3080]
    texts[4][7:47] = texts[3][5000:5040]
    parts, window, sd = [texts[:3], texts[3:]], 35, substring_dedup
    states, left = [], []
    for part in parts:
        names = np.concatenate(part).astype(np.uint64) << np.uint64(30)
        states.append(sd.first_state(names, np.array([len(x) for x in part]), window))
    for turn in range(1, 6):
        asked = [sd.new_symbols(s, turn) for s in states]
        both = [np.concatenate([x[i] for x in asked]) for i in (0, 1)]
        h, _, at = sd.distinct(*both)
        again = np.bincount(at, minlength=len(h)) > 1
        rank = dict(zip(h.tolist(), (np.cumsum(again) * again).tolist(), strict=True))
        for k, (s, pair) in enumerate(zip(states, asked, strict=True)):
            told = np.array([rank[x] for x in sd.distinct(*pair)[0].tolist()], np.uint64)
            states[k] = sd.after_round(s, turn, told, 64, window)
        left.append(sum(len(s.win) for s in states))
    assert left == sorted(left, reverse=True) and left[-1] < 300
    assert {*range(3000, 3046)} <= {*states[0].win.tolist()}
    assert {*range(100, 146), *range(5000, 5006), *range(9008, 9014)} <= {*states[1].win.tolist()}


def test_words_are_the_pattern_s():
    texts = [" a  b\tc\n", "", "  ", None, "\x0ba\x0cb\x1cc\x85d\xa0e\u2003f", "é\r\nü "]
    flat, n = blocks.words_in(pa.array(texts))
    expected = [(t or "").encode().split() for t in texts]
    assert [w.encode() for w in flat.to_pylist()] == sum(expected, [])
    assert n.tolist() == [len(w) for w in expected]


# -- language model --------------------------------------------------------------------


def test_base_scores_and_counts_match_brute_force(docs, rows):
    train = F.col("doc_id") % 5 != 1
    got = {r.id: r for r in hmm_score.score_documents(docs, train, states=3, iterations=2).collect()}
    tokens = {i: [*(t or "").encode().lower().split(), b"\n"] for i, t, *_ in rows}
    c = Counter(w for i, ws in tokens.items() if i % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        r = got[i]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert r.score < 0 and r.train == (i % 5 != 1)


def test_recursions_match_sums_over_all_paths():
    rng = np.random.default_rng(1)
    m = hmm_score.Hmm(*(x / x.sum(-1, keepdims=True) for x in (rng.random(3), rng.random((3, 3)))), (e := rng.random((5, 3))) / e.sum(0))
    sequences = [rng.integers(0, 5, n) for n in (4, 1, 6, 4)]
    counts, moves, starts = np.zeros((5, 3)), np.zeros((3, 3)), np.zeros(3)
    packed = hmm_score.Packed(sequences)
    want = []
    for s in sequences:
        total, c, a, b = 0.0, np.zeros((5, 3)), np.zeros((3, 3)), np.zeros(3)
        for path in itertools.product(range(3), repeat=len(s)):
            p = m.start[path[0]] * m.emit[s[0], path[0]]
            for x, y, o in zip(path, path[1:], s[1:], strict=False):
                p *= m.move[x, y] * m.emit[o, y]
            total += p
            b[path[0]] += p
            for k, o in zip(path, s, strict=True):
                c[o, k] += p
            for x, y in zip(path, path[1:], strict=False):
                a[x, y] += p
        want.append(math.log10(total))
        counts -= c / total
        moves -= a / total
        starts -= b / total
    assert np.allclose(packed.log10(m), want)
    assert math.isclose(packed.expected(m, counts, moves, starts), sum(want))
    assert np.allclose(counts, 0) and np.allclose(moves, 0) and np.allclose(starts, 0)


DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def trained(spark):
    """Blocks of the given documents, the trained model, the shares, and the likelihoods."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    counted, m = hmm_score.counted_blocks(docs, F.crc32(F.col("doc_id").cast("string")) % 5 != 1, "doc_id", "text")
    return docs, counted, hmm_score.train(counted, m, 4)


def test_training_gains_and_states_differ(trained):
    _, _, (m, _, _, path) = trained
    assert path == sorted(path) and path[-1] > 0.95 * path[0]
    assert m.mass.max() > 1.2 * m.mass.min() and math.isclose(m.mass.sum(), m.total, rel_tol=1e-9)


def test_held_out_texts_score_above_the_base(trained):
    docs, *_ = trained
    scored = hmm_score.score_documents(docs, F.crc32(F.col("doc_id").cast("string")) % 5 != 1).where("NOT train")
    score, base, unknown = scored.agg(F.sum("score"), F.sum("base_score"), F.sum(F.col("n_tokens") - F.col("n_known"))).first()
    assert score >= base and unknown > 0


def test_emissions_of_a_state_sum_to_one(trained):
    """Over all distinct tokens of training, ends, and one that training has not."""
    _, counted, (m, expected, answers, _) = trained
    emit = {}
    for r in hmm_score._with_shares(counted, expected, answers).collect():
        count, names = (blocks.unpack(bytes(x), "<u8") for x in (r.c, r.name))
        prints = blocks.unpack(bytes(r.h), "<u8")
        told = pa.scalar(r.told and [bytes(x) for x in r.told], pa.list_(pa.binary()))
        shares = hmm_score._shares(pa.scalar(bytes(r.prior)), told, names, m.states, False)
        rows = m.hmm(count.astype(float), shares).emit
        emit |= {int(h): e for h, e, c in zip(prints, rows, count, strict=False) if c}
        end = rows[-1]
    total = sum(emit.values()) + end + m.share(np.zeros(1))
    assert len(emit) + 1 == m.kinds and np.abs(total - 1).max() < 1e-9


def plain_baum_welch(texts, states, rounds, backoff):
    """One text, one position and one state at a time."""
    count = Counter(w for t in texts for w in t)
    n, kinds = sum(count.values()), len(count)
    prints = np.array([hmm_score.xxhash.xxh3_64_intdigest(w) for w in count if w != b"end"], np.uint64)
    share = dict(zip([w for w in count if w != b"end"], hmm_score.noise(prints, states).tolist(), strict=True))
    share[b"end"] = [1 / states] * states
    start = [1 / states] * states
    move = [[0.3 / states + 0.7 * (i == j) for j in range(states)] for i in range(states)]
    unseen = 0.5 / (n + 0.5 * (kinds + 1))
    K, path = range(states), []
    for _ in range(rounds):
        mass = [sum(count[w] * share[w][k] for w in count) for k in K]

        def emit(w, k, mass=mass, share=share):
            own = count[w] * share[w][k] / mass[k]
            return (1 - backoff) * (1 - unseen) * own + backoff * (count[w] + 0.5) / (n + 0.5 * (kinds + 1))

        likelihood, c = 0.0, {w: [0.0] * states for w in count}
        moves, starts = [[0.0] * states for _ in K], [0.0] * states
        for t in texts:
            a = [[start[k] * emit(t[0], k) for k in K]]
            for w in t[1:]:
                a.append([sum(a[-1][i] * move[i][k] for i in K) * emit(w, k) for k in K])
            b = [[1.0] * states]
            for w in reversed(t[1:]):
                b.insert(0, [sum(move[k][j] * emit(w, j) * b[0][j] for j in K) for k in K])
            p = sum(a[-1])
            likelihood += math.log10(p)
            for i, w in enumerate(t):
                for k in K:
                    c[w][k] += a[i][k] * b[i][k] / p
                    if i + 1 < len(t):
                        for j in K:
                            moves[k][j] += a[i][k] * move[k][j] * emit(t[i + 1], j) * b[i + 1][j] / p
            for k in K:
                starts[k] += a[0][k] * b[0][k] / p
        path.append(likelihood)
        share = {}
        for w in count:
            stored = [c[w][k] / count[w] for k in K]
            if w != b"end":  # one byte for a share, by its square root
                stored = [round(255 * math.sqrt(x)) ** 2 for x in stored]
            share[w] = [x / sum(stored) for x in stored]
        start = [(x + 1) / (sum(starts) + states) for x in starts]
        move = [[(x + 1) / (sum(row) + states) for x in row] for row in moves]
    return start, move, [sum(count[w] * share[w][k] for w in count) for k in K], path


def test_the_model_is_that_of_a_plain_baum_welch(spark):
    rng = random.Random(8)
    kinds = ["a b c d e f", "p q r s t u", "a q x y z"]
    texts = [" ".join(rng.choices(rng.choice(kinds).split(), k=rng.randrange(1, 9))) for _ in range(60)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    counted, first = hmm_score.counted_blocks(table, F.lit(True), "doc_id", "text", 3)
    m, _, _, path = hmm_score.train(counted, first, 4)
    start, move, mass, plain = plain_baum_welch([[*t.encode().split(), b"end"] for t in texts], 3, 4, hmm_score.BACKOFF)
    assert np.allclose(path, plain, rtol=1e-6)
    assert np.allclose(m.start, start, atol=1e-5) and np.allclose(m.move, move, atol=1e-5) and np.allclose(m.mass, mass, rtol=1e-5)


def test_noise_is_spread():
    shares = hmm_score.noise(np.arange(10_000, dtype=np.uint64), 8)
    assert np.allclose(shares.sum(1), 1) and abs(shares.mean() - 1 / 8) < 1e-9
    assert 0.08 < shares.std() < 0.15 and np.abs(np.corrcoef(shares.T) + 1 / 7 * (1 - np.eye(8)) - np.eye(8)).max() < 0.05


def test_scores_do_not_depend_on_how_documents_are_dealt(docs, rows, monkeypatch):
    """Blocks of a few documents each, whose tokens meet in the buckets, against one block."""
    def scores():
        found = hmm_score.score_documents(docs.coalesce(1), F.col("doc_id") % 5 != 1, states=3, iterations=3).collect()
        return {r.id: (r.n_known, r.base_score, r.score) for r in found}

    one = scores()
    monkeypatch.setattr(hmm_score, "BLOCK_BYTES", 3000)
    many = scores()
    for i, *_ in rows:
        assert many[i][0] == one[i][0] and math.isclose(many[i][1], one[i][1], rel_tol=1e-9)
        assert math.isclose(many[i][2], one[i][2], rel_tol=0.01)  # shares are bytes
    assert sum(x for *_, x in many.values()) != 0


def test_shares_survive_as_bytes():
    p = np.array([[0.5, 0.5, 0.0], [0.999, 0.001, 0.0], [1 / 3, 1 / 3, 1 / 3]])
    assert np.abs(hmm_score.of_bytes(hmm_score.to_bytes(p)) - p).max() < 0.004


def test_scores_without_training_texts(docs, empty):
    got = hmm_score.score_documents(docs, F.lit(False), states=2, iterations=1).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in got)
    assert hmm_score.score_documents(empty, F.lit(True), states=2, iterations=1).count() == 0


# -- the cases that all operators share ------------------------------------------------


def test_empty_tables(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "e"))
    nothing = spark.read.parquet(str(tmp_path / "e"))
    assert exact_dedup.exact_groups(nothing).count() == 0
    assert exact_dedup.drop_exact_copies(nothing).count() == 0
    assert minhash_dedup.near_duplicates(nothing).count() == 0
    assert minhash_dedup.drop_near_copies(nothing).count() == 0
    assert token_counts.document_token_counts(nothing).count() == 0
    assert packing.pack_documents(nothing).count() == 0
    assert matroska.media_features(matroska.store_texts(nothing)).count() == 0
    assert substring_dedup.remove_repeats(nothing).count() == 0


def test_columns_with_clashing_names(clashing, docs):
    n = docs.count()
    assert exact_dedup.exact_groups(clashing).count() == n
    assert minhash_dedup.near_duplicates(clashing).count() == n
    out = minhash_dedup.drop_near_copies(clashing)
    assert out.columns == clashing.columns and out.count() < n
    assert token_counts.document_token_counts(clashing).count() == n
    assert packing.pack_documents(clashing).select("id").distinct().count() == n
    assert matroska.media_features(matroska.store_texts(clashing)).count() == n
    assert substring_dedup.remove_repeats(clashing).count() == n
    assert mixing.source_mix(clashing).count() == n
