"""Token files, spelling variants and conversation repair against brute force, on plain and on hard rows."""

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmap.llm import conversations, spelling, token_files

CLASHES = ("cell", "n", "tie", "place", "part", "path", "start", "digest", "copies", "audit", "kind", "form", "root", "own")
END = np.array([2], "<u4").tobytes()


def table(spark, sf, name):
    return spark.read.parquet(os.path.join(sf, f"{name}.parquet"))


def clashing(df):
    return df.select("*", *(F.lit(f"{c}!").alias(c) for c in CLASHES))


# Token files


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_files.tokenizer_path())


def ids_of(library, text):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def expected_documents(library, rows):
    out, start = [], 0
    for doc_id, text in rows:
        ids = ids_of(library, text)
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


TEXTS = [
    "İstanbul Straße ½ x² naïve 'start don't",
    "a\x1cb \x85 c d\x00",
    "“quoted” — it’s",
    "𝒳y Σας Ǆ ŉ ſ ª",
    "é é ﻿",
    "'ll''s!!'s 'Tis 100% 2024",
    "<|endoftext|> inside",
    "x" * 3000,
    "word " * 4000,
    "",
]


def test_word_ids_are_the_librarys(library):
    code = token_files.WordIds(token_files.tokenizer_path())
    assert code.by_words
    chars = "".join(chr(c) for a, b in token_files._SIMPLE for c in range(a, b + 1))
    rng = random.Random(3)
    noise = ["".join(rng.choices(chars + "  ''aeiouAE", k=60)) for _ in range(1500)]
    for text, got in zip(TEXTS + noise, code.ids(TEXTS + noise), strict=True):
        assert np.array_equal(np.frombuffer(got, code.kind), ids_of(library, text)[:-1]), text


def test_token_files_hold_every_document(spark, sf, library):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    manifest = token_files.write_sequences(docs.repartition(5), token_files.tokenizer_path())
    got = sorted(tuple(r) for r in token_files.read_documents(manifest).collect())
    assert got == expected_documents(library, sorted(tuple(r) for r in docs.collect()))


def test_token_files_on_hard_rows(spark, library):
    rows = [(None, "first"), (None, None), (3, TEXTS[8]), (3, TEXTS[8]), (3, "tied"), (2, TEXTS[0]), (1, ""), (9, TEXTS[7])]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    manifest = token_files.write_sequences(docs, token_files.tokenizer_path(), length=64)
    got = sorted((tuple(r) for r in token_files.read_documents(manifest).collect()), key=lambda r: r[1])
    want = collections.Counter((i, len(ids_of(library, t)), zlib.crc32(ids_of(library, t).tobytes())) for i, t in rows)
    assert collections.Counter((r[0], r[2], r[3]) for r in got) == want
    assert [r[0] for r in got] == [None, None, 1, 2, 3, 3, 3, 9]
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1]]
    none = token_files.write_sequences(docs.where("false"), token_files.tokenizer_path())
    assert none.count() == 0 and token_files.read_documents(none).count() == 0


def test_sequences_are_views_of_the_file(spark, library):
    rows = [(i, f"document number {i} " * (i % 7)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    manifest = token_files.write_sequences(docs, token_files.tokenizer_path(), length=16)
    files = sorted(manifest.collect(), key=lambda r: r["part"])
    assert [f["first_sequence"] for f in files] == [0, *np.cumsum([f["sequences"] for f in files])[:-1]]
    stream, ends = [], []
    for row in files:
        file = token_files.TokenFile(row["path"])
        before = pa.total_allocated_bytes()
        views = [(file.ids(i), file.mask(i), file.mask(i, "document_end")) for i in range(row["sequences"])]
        assert not views[0][0].flags.owndata and pa.total_allocated_bytes() == before
        assert row["sequences"] > token_files.BATCH_ROWS
        for ids, mask, end in views:
            real = mask.to_numpy(zero_copy_only=False)
            assert len(ids) == 16 and not real[np.argmin(real) :].any() or real.all()
            stream.append(ids[real])
            ends.append(end.to_numpy(zero_copy_only=False)[real])
    whole, ends = np.concatenate(stream), np.concatenate(ends)
    want = [ids_of(library, t) for _, t in rows]
    assert np.array_equal(whole, np.concatenate(want))
    assert np.array_equal(np.flatnonzero(ends) + 1, np.cumsum([len(w) for w in want]))


# Spelling variants

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_counts(rows):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            at = h % len(word)
            counts[word if h % 97 else word[:at] + word[at + 1 :]] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def brute_variants(words):
    near = {w: [o for o in words if one_edit(w, o)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        if best and words[best] >= 2 * words[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def test_spelling_variants_of_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    want = brute_variants(brute_counts([tuple(r) for r in docs.collect()]))
    for cell_words in (spelling.CELL_WORDS, 60):
        assert {tuple(r) for r in spelling.variants(docs, cell_words).collect()} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_spelling_variants_of_close_words(spark, seed):
    rng = random.Random(seed)
    made = {"".join(rng.choices("abcé÷", k=rng.choice((5, 5, 6, 7)))): rng.randint(3, 60) for _ in range(700)}
    text = " ".join(w for w, n in made.items() for _ in range(n))
    rows = [(None, text), (7, text.upper()), (7, None), (8, ""), (9, "x" * 50_000), (9, "y" * 70), (9, "y" * 70), (9, "y" * 70)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    want = brute_variants(brute_counts(rows))
    assert any(r[1] for r in want) and any(r[1] != r[2] for r in want if r[1])
    assert {tuple(r) for r in spelling.variants(docs, 40).collect()} == want
    assert spelling.variants(docs.where("false")).count() == 0


def test_cells_reach_all_near_words(spark):
    rng = random.Random(5)
    words = {"".join(rng.choices("abcdef", k=8)) for _ in range(3000)}
    cells = spelling.fit_cells(spark.createDataFrame([(w, 3) for w in words], "word string, n long"), 100)
    spelled = [w.encode("latin-1") for w in words]
    points = spelling.letter_counts(spelled)
    sizes = collections.Counter(cells.own(8, points).tolist())
    assert len(sizes) > 30 and max(sizes.values()) <= 100
    point, cell = cells.reached(8, points, 1, 1)
    assert len(point) < 0.6 * len(words) * len(sizes)
    reach = set(zip(point.tolist(), cell.tolist(), strict=True))
    own = cells.own(8, points)
    for i in range(0, 3000, 100):
        if i < len(spelled):
            for j in range(len(spelled)):
                assert not one_edit(spelled[i].decode(), spelled[j].decode()) or (i, own[j]) in reach


# Conversation repair

PUT = {"": "u", "s": "u", "u": "a", "a": "u"}


def brute_repair(rows):
    """Least (cost, audit) by relaxing every state of every position until nothing moves."""
    best = {q: (0, "") if q in ("", "a") else (10**9, "~") for q in PUT}
    for i in range(len(rows), -1, -1):
        now = dict(best) if i == len(rows) else {}
        if i < len(rows):
            initial, must_go, extra = rows[i]
            for q in PUT:
                found = [(best[q][0] + 4, "D" + best[q][1])]
                if not must_go:
                    found.append((best[PUT[q]][0] + 3 + extra, "R" + best[PUT[q]][1]))
                    if initial == PUT[q] or (q == "" and initial == "s"):
                        found.append((best[initial][0] + extra, "K" + best[initial][1]))
                now[q] = min(found)
        for _ in range(6):
            for q in PUT:
                now[q] = min(now[q], (now[PUT[q]][0] + 3, "I" + now[PUT[q]][1]))
        best = now
    return best[""]


def test_repair_is_the_least_of_the_cheapest():
    rng = random.Random(11)
    for _ in range(4000):
        rows = [
            (rng.choice("ssuuuaaax") if rng.random() > 0.02 else "", rng.random() < 0.2, 3 * (rng.random() < 0.2))
            for _ in range(rng.randint(0, 14))
        ]
        assert conversations.repair(rows) == brute_repair(rows), rows


def brute_conversation(conv_id, rows):
    out = []
    for turn, role, text in rows:
        name = " " if conv_id is None else conv_id
        kind = zlib.crc32(f"{name}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    digest = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
    out.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
    seen, faults, blank, duplicate, truncated = set(), [], 0, 0, 0
    for _, role, text in out:
        solid = text.strip(" \t\n\x0b\x0c\r")
        empty, again = not solid, (role, text) in seen
        cut = not empty and not again and solid[-1] not in ".!?"
        seen.add((role, text))
        blank, duplicate, truncated = blank + empty, duplicate + (again and not empty), truncated + cut
        faults.append((role[:1], empty or again, 3 * cut))
    turns = [r[0] for r in out if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(faults, faults[1:], strict=False))
    cost, audit = brute_repair(faults)
    left, text_rows = iter(out), []
    names = {"u": "user", "a": "assistant"}
    for letter in audit:
        put = names[PUT[text_rows[-1][0][:1] if text_rows else ""]]
        if letter == "I":
            text_rows.append((put, ""))
            continue
        _, role, text = next(left)
        if letter != "D":
            text_rows.append((role if letter == "K" else put, text))
    whole = "\n".join(f"{a}:{b}" for a, b in text_rows)
    return (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256(whole.encode()).hexdigest())


def brute_all(rows):
    talks = collections.defaultdict(list)
    for conv_id, *row in rows:
        talks[conv_id].append(tuple(row))
    return {brute_conversation(i, talk) for i, talk in talks.items()}


def test_conversations_of_the_table(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    got = conversations.repaired(conversations.damaged(rows.repartition(3)))
    assert {tuple(r) for r in got.collect()} == brute_all(tuple(r) for r in rows.collect())


def test_conversations_on_hard_rows(spark):
    rng = random.Random(2)
    texts = ["Yes.", "No!", "cut off", "", " \n\t", None, "Why? ", "é.", "x" * 40_000 + "."]
    roles = ["user", "assistant", "system", None, "", "tool", "usher"]
    rows = [(c, t, rng.choice(roles), rng.choice(texts)) for c in (None, 1, 2, 3) for t in (None, None, 1, 1, 2, 5, 6, 9, 11)]
    rows += [(4, t, ("user", "assistant")[t % 2], "Same again.") for t in range(3000)]
    dropped = next(c for c in range(10, 400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "Gone."))
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {tuple(r) for r in conversations.repaired(conversations.damaged(df)).collect()}
    assert got == brute_all(rows)
    assert (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got
    assert conversations.repaired(conversations.damaged(df.where("false"))).count() == 0


# Archives of other writers


def test_foreign_archives_are_read(spark, tmp_path):
    import base64
    import gzip

    from corpusmap.llm import warc

    html = b"<p>payload</p>"
    http = b"HTTP/1.1 200 OK\r\ncontent-length: 99\r\n\r\n" + html
    digest = base64.b32encode(hashlib.sha1(html).digest()).decode()

    def record(kind, body, *more):
        lines = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:0a-1>", *more, f"content-length:{len(body)}", "", ""]
        return gzip.compress("\r\n".join(lines).encode() + body + b"\r\n\r\n")

    members = [
        record("warcinfo", b"software: other\r\n"),
        record("request", b"GET / HTTP/1.1\r\n\r\n", "WARC-Target-URI: http://a/"),
        record("response", http, "WARC-Target-URI: http://a/"),
        record("response", http, "warc-target-uri: http://b/", f"warc-payload-digest: sha1:{digest}"),
        record("response", http, "WARC-Payload-Digest: sha1:AAAA"),
        record("metadata", b""),
        record("revisit", b"HTTP/1.1 200 OK\r\n\r\n", "WARC-Refers-To: <urn:uuid:0a-2>"),
    ]
    (tmp_path / "part-0.warc.gz").write_bytes(b"".join(members))
    for size in (1 << 20, 50):
        rows = warc.read_archives(spark, str(tmp_path), size).collect()
        kinds = collections.Counter(r["record_type"] for r in rows)
        assert kinds == {"warcinfo": 1, "request": 1, "response": 2, "metadata": 1, "revisit": 1}
        assert all(r["page_id"] is None and r["refers_to"] is None for r in rows)
        for r in rows:
            if r["record_type"] == "response":
                assert (bytes(r["payload"]), r["payload_bytes"], r["payload_digest"]) == (html, len(html), digest)
                assert r["url"] in ("http://a/", "http://b/")
