"""Every operator on hard rows: nulls, empty and long texts, repeats, empty tables, clashing columns."""

import hashlib
import math
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmap.llm import (
    calibrate,
    decontaminate,
    embeddings,
    licenses,
    lm,
    minhash,
    packing,
    quality,
    suffix_index,
    toxicity,
    warc,
    words,
)
from corpusmap.sources.scratch import scratch_folder

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"{a}{b}" for a, b in zip(rng.choice(WORDS, n), rng.choice(WORDS, n), strict=True))


LONG = prose(1, 20_000)
ROWS = [
    (0, None),
    (1, ""),
    (2, " \n\t "),
    (3, "short"),
    (4, prose(2, 60)),
    (5, prose(2, 60)),
    (6, " ".join(prose(2, 60).split()[:58]) + " other end"),
    (7, LONG),
    (8, LONG + " tail"),
    (8, LONG + " tail"),
    (None, prose(3, 40)),
    (None, None),
    (9, "Released under the MIT License.\nñandú " + prose(4, 30)),
    (10, "é" * 300),
    (11, "x" * 1000),
]
COLUMNS = "doc_id long, text string"
#: Names that the operators use themselves.
CLASHES = ("key", "block", "score", "label", "x", "n", "part", "tag", "row", "size", "shard", "words", "bucket", "rest")


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, COLUMNS)
    return rows.select("*", *(F.lit(f"{c}!").alias(c) for c in CLASHES)).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, 1 - i % 2, 5) for i in range(12)] + [(3, 0, 0, 5), (3, 1, 1, 5), (None, 1, 1, 5), (4, None, None, 5)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, score int")


def test_scores(docs, none, labels):
    for module, name in ((quality, "quality"), (toxicity, "toxic")):
        model = module.fit(calibrate.labelled(docs, labels, name))
        got = module.score(docs.select("doc_id", "text"), model).collect()
        assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
        same = {r["score"] for r in got if r["doc_id"] in (0, 1)}
        assert len(same) == 1
        flat = module.fit(calibrate.labelled(none, labels, name))
        assert module.score(none, flat).count() == 0
        assert len({r["score"] for r in module.score(docs.select("doc_id", "text"), flat).collect()}) == 1


def test_toxicity_folds(spark):
    bad = ["you are an 1d10t today", "such an іdiоt here", "IDIOT!", "what an i​diot"] * 5
    rows = [(f"{prose(i, 20)} {t}", 1) for i, t in enumerate(bad)] + [(prose(100 + i, 25), 0) for i in range(60)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, label int"))
    assert "idiot" in model.lexicon
    for text in ("The 1D1OT came", "an ídíot", "idi0t"):
        assert "idiot" in model.weigh(text)[2]
    assert not model.weigh("idiotic idioms")[2]


def test_toxicity_exceptions(spark):
    rows = [(f"{prose(i, 20)} clown", 1) for i in range(20)] + [(f"{prose(50 + i, 20)} clown fish", 0) for i in range(6)]
    rows += [(prose(100 + i, 25), 0) for i in range(200)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, label int"))
    assert model.weigh("a clown")[0] > 0 and model.weigh("a clown fish")[0] == 0


def test_quality_tells_classes_apart(spark):
    rows = [(i, prose(i, 80), 1) for i in range(150)] + [
        (1000 + i, " | ".join(prose(i, 40).upper().split()), 0) for i in range(150)
    ]
    data = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = quality.fit(data.where("doc_id % 3 > 0"))
    got = quality.score(data.where("doc_id % 3 = 0"), model).collect()
    assert np.mean([(r["score"] >= 0.5) == (r["label"] == 1) for r in got]) > 0.95


def test_language_model(spark, docs, none):
    got = lm.score(docs.withColumn("train", F.coalesce(F.col("doc_id") % 3 != 0, F.lit(True)))).collect()
    assert len(got) == len(ROWS)
    assert all(r["score"] <= 0 and r["n_known"] <= r["n_tokens"] for r in got)
    empty = [r for r in got if r["doc_id"] in (0, 1, 2)]
    assert {r["n_tokens"] for r in empty} == {1}
    assert lm.score(none.withColumn("train", F.lit(True))).count() == 0
    untrained = lm.score(docs.withColumn("train", F.lit(False))).collect()
    assert {r["train_tokens"] for r in untrained} == {0} and {r["n_known"] for r in untrained} == {0}


def test_language_model_is_a_distribution(spark):
    """After one context the probabilities of all words, and of unknown ones, add up to 1."""
    train = [(i, prose(i, 30)) for i in range(40)] + [(100 + i, "a b c a b a") for i in range(30)]
    known = sorted({w for _, t in train for w in t.split()})
    rows = [(i, t, True) for i, t in train] + [(1000 + i, f"a {w}", False) for i, w in enumerate(["", *known, "unknown"])]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string, train boolean"))
    # log p(a) + log p(w | a) + log p(end | w): the parts come from texts of their own.
    more = [(i, w, False) for i, w in enumerate(["", "a", *known, "unknown"])]
    single = {r["doc_id"]: r["score"] for r in lm.score(
        spark.createDataFrame([*[(10_000 + i, t, True) for i, t in train], *more], "doc_id long, text string, train boolean")
    ).collect() if r["doc_id"] < 10_000}
    both = {r["doc_id"] - 1000: r["score"] for r in got.where("doc_id >= 1000").collect()}
    assert single[1] < 0 and len(both) == len(known) + 2
    # p(end | a) from the text "a": p(a | begin) p(end | a) ; p(w | a) p(end | w) stay below 1 together.
    start = single[1] - both[0]
    assert abs(start) < 1e-6
    assert sum(10 ** (both[i + 1] - both[0]) for i in range(len(known))) < 1 / 10 ** (both[0] - start) + 1e-6


def test_seats_follow_the_process():
    keys = np.arange(1, 4001, dtype=np.uint64)
    for c in (2, 20, 500):
        tables = lm.seats(keys, np.full(4000, c), np.full(4000, 0.5), 0.5, 3)
        assert tables.min() >= 1 and tables.max() <= c
        mean, t = 1.0, 1.0
        for j in range(1, c):
            t += 0.5 / (j - 0.5 * t + 0.5)
            mean = t
        assert abs(tables.mean() - mean) < 0.15 * mean


def test_tables_are_drawn_from_their_exact_conditional():
    """Against a walk over all seatings, one customer after another: the weights of an arrangement's tables multiply."""
    discount, spare, prob = 0.8, 2.5, 0.3
    for customers in (2, 3, 7):
        weight = {(1,): spare * prob}  # sizes of the tables -> summed weight of the seatings
        for _ in range(customers - 1):
            after: dict = {}
            for sizes, w in weight.items():
                for i, n in enumerate(sizes):
                    key = (*sizes[:i], n + 1, *sizes[i + 1 :])
                    after[key] = after.get(key, 0) + w * (n - discount)
                key = (*sizes, 1)
                after[key] = after.get(key, 0) + w * (spare + discount * len(sizes)) * prob
            weight = after
        want = np.array([sum(w for sizes, w in weight.items() if len(sizes) == t) for t in range(1, customers + 1)])
        n = 40_000
        drawn = lm.resample(
            np.arange(1, n + 1, dtype=np.uint64), np.full(n, customers), np.full(n, spare), np.full(n, prob), discount, 5
        )
        got = np.bincount(drawn, minlength=customers + 1)[1:] / n
        assert np.abs(got - want / want.sum()).max() < 0.012


def test_language_model_counts_like_brute_force(spark):
    """Tokens, known tokens and base scores of every row against plain counting; perplexity follows from the score."""
    rows = [(i, t, i % 3 > 0) for i, t in enumerate(["", "A b\tb", "b c c", None, "x b \u00e9", "b b b", "c\r\nA"])]
    rows += [(50 + i, prose(i, 40), i % 4 > 0) for i in range(30)] + [(None, "b c", True), (None, "b q", None)]
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0d]+", (t or "").lower()) if w] + ["<end>"]
    counts = Counter(w for _, t, train in rows if train for w in split(t))
    total = sum(counts.values())
    want = sorted(
        (len(w := split(t)), sum(counts[x] > 0 for x in w), total,
         round(sum(math.log10((counts[x] + 1) / (total + len(counts) + 1)) for x in w), 6)) for _, t, _ in rows
    )
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string, train boolean")).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(abs(r["perplexity"] - 10 ** (-r["score"] / r["n_tokens"])) < 1e-6 * r["perplexity"] for r in got)


def test_words_are_counted_whatever_the_keys_of_pairs(spark, monkeypatch):
    """Pairs whose travelling key bits are equal keep their own counts, so figures of words are exact."""
    monkeypatch.setattr(lm, "layout", lambda total, *more: lm.Layout(1, 0, more[1] if len(more) > 1 else 1))
    rows = [(i, " ".join(f"w{i * 40 + j}" for j in range(40)), i % 5 > 0) for i in range(25)]
    rows += [(100 + i, f"w{i * 41} w{i} again", False) for i in range(20)]
    split = lambda t: [*t.split(), "<end>"]
    counts = Counter(w for _, t, train in rows if train for w in split(t))
    total = sum(counts.values())
    want = {
        i: (sum(counts[x] > 0 for x in split(t)), total,
            round(sum(math.log10((counts[x] + 1) / (total + len(counts) + 1)) for x in split(t)), 6)) for i, t, _ in rows
    }
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string, train boolean")).collect()
    assert {r["doc_id"]: (r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got} == want


def test_counts_handed_to_texts_take_few_bytes():
    """Keys of a part travel as steps; keys that are equal in the bits that travel have their sums."""
    rng = np.random.default_rng(3)
    plan = lm.Layout(1, 4)
    keys = (rng.integers(0, 2**60, 200_000, dtype=np.uint64)) | np.uint64(5 << 60)
    keys = plan.trim(np.concatenate([keys, keys[:3]]))
    count = rng.geometric(0.8, len(keys)).astype(np.int64)
    raw = lm._told(plan, keys, [count, 3 * count])
    assert len(raw) < 4.5 * len(keys)  # whole keys alone take five
    wanted = {}
    for k, c in zip(keys.tolist(), count.tolist()):
        wanted[k] = wanted.get(k, 0) + c
    got, (counts, tables) = lm._heard(plan, raw, 2)
    packed = plan.unpack(plan.pack(np.array(sorted(wanted), np.uint64)))
    assert got.tolist() == packed.tolist()
    assert counts.tolist() == [wanted[k] for k in sorted(wanted)] and (tables == 3 * counts).all()


def test_language_model_scores_shares_of_the_blocks(spark, monkeypatch):
    """No share holds most of the texts, only scores stay on the disk, and one share alone gives the same rows."""
    from corpusmap.llm import blocks

    monkeypatch.setattr(blocks, "BLOCK_BYTES", 3000)
    rows = [(i, prose(i % 70, 60), i % 3 > 0) for i in range(90)] + [(None, "a b", True), (None, None, None), (3, prose(3, 60), True)]
    table = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    sizes, write = [], lm.materialize

    def spy(df, name):
        written = write(df, name)
        if name == "scored":
            sizes.append(written.count())
        return written

    monkeypatch.setattr(lm, "materialize", spy)
    folder = Path(scratch_folder(spark))
    before = set(folder.glob("*"))
    got = sorted(map(str, lm.score(table).collect()))
    assert sum(sizes) == len(got) == len(rows) and max(sizes) < 0.6 * len(rows)
    assert {p.name.split("-")[0] for p in set(folder.glob("*")) - before} == {"scored"}
    monkeypatch.setattr(lm, "PASSES", 1)
    assert sorted(map(str, lm.score(table).collect())) == got


def test_places_are_ordered_by_two():
    rng = np.random.default_rng(5)
    first, second = rng.integers(0, 50, (2, 1000))
    second = np.arange(1000) * 7 % 1000  # pairs differ
    for below in (1000, 1 << 40):  # the second does not fit into one number
        assert (lm._by_two(first, second, below) == np.lexsort((second, first))).all()


def test_hashes_of_words(monkeypatch):
    """Sums of the bytes' values times powers from the word's start, also across the steps that powers are held for."""
    monkeypatch.setattr(words, "_STEP", 64)
    texts = [b"Abc  def", b"", b"ghi", b"x" * 150 + b" \xc3\xa9 Z", b" end"]
    offsets = np.cumsum([0, *map(len, texts)])
    got = words.Words(np.frombuffer(b"".join(texts), np.uint8), offsets, words.nonspace_mask())
    value, wanted = words.byte_table(1).tolist(), []
    for row, text in enumerate(texts):
        for m in re.finditer(rb"\S+", text):
            total = sum(value[b] * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(m[0].lower())) + len(m[0])
            hashed = words.mix(np.array([total % (1 << 64)], np.uint64))[0]
            wanted.append((row, offsets[row] + m.start(), offsets[row] + m.end(), hashed))
    assert list(zip(got.doc, got.start, got.end, got.hash, strict=True)) == wanted


def test_licenses(docs, none):
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert got[0]["n_words"] == 0 and got[0]["first_word"] is None and got[0]["labels"] == "" and got[0]["score"] == 0
    assert got[9]["base_labels"] == "mit" and got[9]["first_word"] == 1 and got[9]["n_base"] == 1
    assert licenses.scan(none).count() == 0


def test_licenses_place_every_phrase(spark):
    text = "x under the MIT license under the mit License\nz Apache-license: version 2.0 cc by-nc"
    row = licenses.scan(spark.createDataFrame([(1, text)], COLUMNS)).first()
    assert (row["n_base"], row["first_word"], row["last_word"]) == (4, 1, 15)
    assert row["base_labels"] == "apache-2,cc-by-nc,mit"


def test_licenses_of_two_notices_in_a_block(spark):
    """A notice with a changed word keeps its label beside a verbatim one; near-identical templates exclude each other."""
    mit = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation papers"
    cc = "this work is licensed under a creative commons attribution {} 4 0 international license"
    nc = cc.format("noncommercial")
    texts = [
        f"{mit} licensed under the apache license version 2 0",
        nc,
        f"{nc} {nc}",
        f"{nc} {cc.format('sharealike')}",
        f"{nc} {cc.format('share alike')}",
    ]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), COLUMNS)).collect()
    labels = {r["doc_id"]: r["labels"] for r in got}
    assert labels == {0: "apache-2,mit", 1: "cc-by-nc", 2: "cc-by-nc", 3: "cc-by-nc,cc-by-sa", 4: "cc-by-nc,cc-by-sa"}
    assert {b["label"] for r in got if r["doc_id"] == 0 for b in r["blocks"]} == {"apache-2", "mit"}


def test_decontamination(spark, docs, none):
    passage = prose(500, 40).split()
    changed = passage.copy()
    for i in range(3, 38, 9):
        changed[i] = "changed"
    bench = spark.createDataFrame(
        [(1, " ".join(passage)), (2, None), (3, ""), (4, "two words"), (None, prose(501, 30)), (1, " ".join(passage))],
        "item_id long, text string",
    ).withColumn("doc_id", F.lit(7))
    texts = spark.createDataFrame(
        [(1, f"{prose(9, 50)} {' '.join(changed).upper()}. {prose(8, 50)}"), (2, prose(7, 500)), (3, " ".join(passage[:9])), (4, " ".join(passage))],
        COLUMNS,
    )
    got = decontaminate.overlaps(texts.unionByName(docs.select("doc_id", "text")), bench).collect()
    assert {r["doc_id"] for r in got} == {1, 4} and {r["item_id"] for r in got} == {1}
    assert {(r["doc_start"], r["n_words"]) for r in got if r["doc_id"] == 1} == {(50, 40)}
    assert {r["doc_id"] for r in decontaminate.drop_contaminated(texts, bench).collect()} == {2, 3}
    assert decontaminate.overlaps(none, bench).count() == 0
    assert decontaminate.overlaps(texts, bench.where("false")).count() == 0
    assert decontaminate.drop_contaminated(texts, bench.where("false")).count() == 4


def test_decontamination_tests_every_range(spark):
    """A span of enough words counts whatever surrounds it, and with changed words at its ends."""
    item = prose(510, 120).split()
    mixed = item.copy()
    for run in range(20, 120, 10):
        mixed[run : run + 3] = ["changed"] * 3
    short = prose(511, 13).split()
    ends = ["changed", *short[1:12], "changed"]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short))], "item_id long, text string")
    texts = spark.createDataFrame(
        [(1, " ".join(mixed)), (2, f"{prose(9, 30)} {' '.join(ends)} {prose(8, 30)}"), (3, prose(7, 200))], COLUMNS
    )
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.overlaps(texts, bench).collect()}
    assert set(got) == {(1, 1), (2, 2)}
    assert (got[1, 1]["doc_start"], got[1, 1]["n_words"], got[1, 1]["n_equal"]) == (0, 20, 20)
    assert (got[2, 2]["doc_start"], got[2, 2]["n_words"], got[2, 2]["n_equal"]) == (30, 13, 11)
    assert [r["doc_id"] for r in decontaminate.drop_contaminated(texts, bench).collect()] == [3]


@pytest.mark.parametrize("least", [6, 13])
def test_best_overlap_against_all_ranges(least):
    rng = np.random.default_rng(5)
    for n, share in [(5, 1), (13, 0.8), (40, 0.7), (60, 0.8), (60, 0.6)] * 20:
        equal = rng.random(n) < share
        spans = [(a, b) for a in range(n) for b in range(a + least, n + 1)]
        gain = {(a, b): 5 * int(equal[a:b].sum()) - 4 * (b - a) for a, b in spans}
        got = decontaminate.best_overlap(equal, least)
        assert got is None if max(gain.values(), default=-1) < 0 else gain[got] >= 0


def test_decontamination_in_parts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_WORDS", 50)
    bench = spark.createDataFrame([(i, prose(600 + i, 30)) for i in range(8)], "item_id long, text string")
    texts = spark.createDataFrame([(i, f"{prose(i, 20)} {prose(600 + i, 30)}") for i in range(12)], COLUMNS)
    got = decontaminate.overlaps(texts, bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(i, i) for i in range(8)]


@pytest.mark.parametrize("range_bytes", [50, 700, 1 << 20])
def test_warc_round_trip(spark, range_bytes):
    import gzip

    rows = [(i, f"http://x/{i}", prose(i % 7, 200)) for i in range(40)]
    rows += [(50, None, None), (51, "u\nv", ""), (None, "z", prose(3, 200)), (None, "z2", "alone"), (3, "again", prose(3, 200)), (60, "big", LONG)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    folder = warc.archive_folder(spark)
    warc.write_archives(pages.repartition(3), folder)
    got = warc.read_archives(spark, folder, range_bytes).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, html in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(html or "", i)
    html_of = {(i, u): h or "" for i, u, h in rows}
    for r in got:
        html = html_of[r["page_id"], r["url"] if r["url"] not in ("", "u v") else {"": None, "u v": "u\nv"}[r["url"]]]
        raw = html.encode()
        assert r["payload_bytes"] == len(raw)
        lowest = first.get(html)
        if lowest is None or lowest == r["page_id"]:
            assert r["record_type"] == "response" and r["refers_to"] is None and r["payload"] == raw
        else:
            assert r["record_type"] == "revisit" and r["refers_to"] == lowest
    for path in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).collect():
        assert gzip.decompress(path["content"]).startswith(b"WARC/1.1") or not path["length"]


def test_warc_skips_damage(spark, tmp_path):
    import io

    member = lambda i: warc.HEAD + b"\0" + warc._member(
        warc._record("response", i, "u", warc.base64.b32encode(hashlib.sha1(b"p%d" % i).digest()).decode(), warc._http(2) + b"p%d" % i)
    )
    whole = [member(i) for i in range(4)]
    data = whole[0] + b"\x1f\x8b\x08junk" + whole[1] + whole[2][:-9] + b"\0" * 9 + whole[3] + b"\0"
    got = [r["page_id"] for r in warc.owned_records(io.BytesIO(data), len(data), 0, len(data))]
    assert got == [0, 1, 3]


def test_warc_empty(spark):
    folder = warc.archive_folder(spark)
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read_archives(spark, folder).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 24))
    near = base[:20] + 0.1 * rng.standard_normal((20, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, near, base[:5], 3 * base[5:8]]))]
    rows += [(900, None), (901, []), (902, [0.0] * 24), (903, [1.0, None] + [0.0] * 22), (904, [float("nan")] * 24),
             (905, [float("inf")] * 24), (906, [1.0]), (907, [2.0]), (None, base[0].tolist()), (7, base[7].tolist()), (908, [1e-300] * 24)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("key", F.lit(0)).withColumn("n", F.lit(0))
    got = embeddings.near_duplicates(data).collect()
    assert len(got) == len(rows)
    ok = [(i, np.array(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = {}
    for a, (i, v) in enumerate(ok):
        links[a] = [b for b, (j, w) in enumerate(ok) if b != a and len(v) == len(w) and (v / abs(v).max()) @ (w / abs(w).max()) / np.linalg.norm(v / abs(v).max()) / np.linalg.norm(w / abs(w).max()) >= 0.9 - 1e-12]
    want = sorted((i, len(links[a])) for a, (i, _) in enumerate(ok))
    assert sorted((r["vec_id"], r["n_links"]) for r in got if r["vec_id"] is not None and r["vec_id"] not in range(900, 906)) == want
    assert all(r["n_links"] == 0 and r["kept"] for r in got if r["vec_id"] in range(900, 906))
    assert [r["n_links"] for r in got if r["vec_id"] is None] == [0]
    assert embeddings.near_duplicates(data.where("false")).count() == 0


def test_embeddings_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(6)
    centre = rng.standard_normal(16)
    rows = [(i, (centre + 0.25 * rng.standard_normal(16)).tolist()) for i in range(150)]
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.9).sum(1) - 1
    found = np.array([got[i] for i in range(150)])
    assert (found <= want).all() and found.sum() >= 0.98 * want.sum()


def test_near_duplicates(docs, none):
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    classes = {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None}
    assert classes[5] == 4 and classes[6] == 4 and classes[8] == 7 and classes[0] == classes[1] == 0
    assert {classes[i] for i in (2, 3, 9, 10, 11)} == {2, 3, 9, 10, 11}
    kept = minhash.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [0, 2, 3, 4, 7, 9, 10, 11]
    assert minhash.near_duplicates(none).count() == 0


def test_representatives_of_null_and_repeated_ids(spark):
    """Unrelated texts without an id, or with one id, are classes of their own."""
    near = prose(604, 60)
    rows = [(None, prose(601, 40)), (None, prose(602, 40)), (None, prose(602, 40)), (5, prose(603, 40)), (5, near), (6, near + " tail"), (None, near)]
    kept = minhash.representatives(spark.createDataFrame(rows, COLUMNS)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted([(0, rows[0][1]), (0, rows[1][1]), (5, rows[3][1]), (5, near)])


def test_near_copies_in_a_large_group(spark):
    """Texts with one or two words of their own are linked, however many copies share the others."""
    words = prose(78, 130).split()
    rows = []
    for i in range(3000):
        own = words.copy()
        own[40] = f"own{i}"
        if i % 2:
            own[90] = f"more{i}"
        rows.append((i, " ".join(own)))
    rows += [(3000 + i, prose(5000 + i, 20)) for i in range(300)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, COLUMNS)).where("doc_id < 3000")
    assert [r["class_id"] for r in got.select("class_id").distinct().collect()] == [0]


def test_idf_is_bounded():
    for n in (1, 2, 1000, 10**9):
        got = minhash.idf(np.array([1, max(n // 3, 1), n]), n)
        assert (np.diff(got) <= 0).all() and got[0] <= 1 + minhash.IDF_RANGE and got[-1] >= 1


def test_near_duplicates_chain(spark):
    """Texts that are alike only through others are one class, whatever the leaders."""
    words = prose(77, 400).split()
    rows = []
    for i in range(12):
        own = words.copy()
        own[: 15 * i] = prose(1000, 200).split()[: 15 * i]
        rows.append((i, " ".join(own)))
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert set(got.values()) == {0}


def removed_by_force(rows):
    seen, out = {}, []
    order = sorted(range(len(rows)), key=lambda i: (-1 if rows[i][0] is None else rows[i][0]))
    for i in order:
        raw = (rows[i][1] or "").encode()
        for s in range(len(raw) - 99):
            key, at = raw[s : s + 100], (-1 if rows[i][0] is None else rows[i][0], s)
            seen[key] = min(seen.get(key, at), at)
    for i in range(len(rows)):
        raw = (rows[i][1] or "").encode()
        covered = np.zeros(len(raw), bool)
        for s in range(len(raw) - 99):
            if seen[raw[s : s + 100]] < (-1 if rows[i][0] is None else rows[i][0], s):
                covered[s : s + 100] = True
        out.append((rows[i][0], len(raw), int(covered.sum()), hashlib.sha256(np.frombuffer(raw, np.uint8)[~covered].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("block_bytes", [3 << 20, 20_000])
def test_repeats(spark, docs, none, monkeypatch, block_bytes):
    from corpusmap.llm import blocks

    monkeypatch.setattr(blocks, "BLOCK_BYTES", block_bytes)
    shared = prose(40, 30)
    rows = ROWS + [(100 + i, f"{prose(50 + i, 40)} {shared[: 90 + 7 * i]}{prose(80 + i, 20)}") for i in range(20)] + [(200, "ab" * 400 + "c" + "ab" * 90)]
    got = suffix_index.remove_repeats(spark.createDataFrame(rows, COLUMNS)).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    want = sorted(removed_by_force(rows), key=key)
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in got), key=key) == want
    assert suffix_index.remove_repeats(docs, kept_text=True).where("rest.block = 'block!'").count() == len(ROWS)
    assert suffix_index.remove_repeats(none).count() == 0


def test_index_levels_grow_geometrically():
    family, rng = suffix_index.Family(), np.random.default_rng(1)
    every = np.zeros(0, np.uint64)
    for _ in range(33):
        batch = np.sort(rng.integers(0, 1 << 62, 100, dtype=np.uint64))
        assert not family.seen(batch).any()
        family.add(batch)
        every = np.concatenate([every, batch])
        assert family.seen(np.sort(every)).all() and len(family.levels) <= 7
    assert sorted(np.concatenate([level for _, level in family.levels])) == sorted(every)


def test_packing(docs, none):
    path = packing.tokenizer_path()
    rows = packing.pack(docs, path).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.LIMIT
    assert len(by_sequence) <= -(-sum(r["length"] for r in rows) // packing.LIMIT) + 2
    assert sum(r["length"] for r in rows if r["doc_id"] == 0) == 1
    eight = sorted((r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == 8)
    assert eight[0][0] == 0 and eight[0] == eight[1] and all(n == packing.LIMIT for p, _, n in eight if p)
    assert packing.pack(none, path).count() == 0


def test_packing_beats_or_meets_best_fit():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 1024, 800)
    plain = packing.best_fit(sizes, packing.Packing(np.zeros(800, int), np.zeros(0, int)), np.argsort(-sizes), 1024)
    found = packing.evolve(sizes, [], 1)
    fill = np.bincount(found, sizes)
    assert fill.max() <= 1024 and len(found) == 800 and (fill > 0).sum() <= plain.count()


def test_tokens_match_the_tokenizer(spark, sf):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    exact, ours = Tokenizer.from_file(path), packing.Tokens(path)
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += ["", " ", "a  b \n c", "<|endoftext|> x", "it's I'LL 12ab!!", "日本語 ñ🎉", "\x85\x1c a　 b"]
    for text, ids in zip(texts, ours.ids(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == [*exact.encode(text, add_special_tokens=False).ids, packing.END_ID]


def test_pipeline_on_hard_rows(spark, labels, tmp_path):
    rows = spark.createDataFrame(
        [(i, t, "en", None, len(t or "")) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long"
    )
    for name, docs in (("hard", rows), ("empty", rows.where("false"))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame([(1, prose(4, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        ids = {r["doc_id"] for r in got}
        assert not ids & {5, 6, 9} if name == "hard" else not ids
