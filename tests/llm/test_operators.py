"""Corpus operators against brute force, round trips, SQL and held-out labels, with awkward inputs."""

import hashlib
import os
import random
import re
import zlib

import brute
import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ladderwork.llm import chats, decontamination, fingerprints, licenses, pieces, pii, quality, queries, revisits
from ladderwork.llm.words import utf8

TABLES = "/root/testdata/sf0.001"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DOCS = "doc_id long, text string, score string, words int"


def frame(spark, rows, schema=DOCS, parts=4):
    return spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], schema).repartition(parts)


AWKWARD = [(1, None), (2, ""), (3, " \n"), (4, "x"), (4, "x"), (None, "y z"), (6, "Ünï ▁ 日本 😀\x00"), (7, "long " * 40000)]


# --- 1: decontamination


def benchmark_case(seed=5):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, say(rng.choice([3, 12, 13, 20, 40]))) for k in range(25)] + [(90, None), (91, "..."), (92, "W1, w2"), (93, "w1 w2")]
    docs = [(k, say(rng.randrange(60)) + ". " + (rng.choice(items)[1] or "").upper() + " " + say(rng.randrange(40))) for k in range(120)]
    return docs + [(500, None), (501, ""), (502, "w1 W2"), (503, "w1-w2")], items


def test_contamination(spark):
    docs, items = benchmark_case()
    got = decontamination.contamination_digest(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(tuple(r)[:6] for r in got.collect()) == sorted(brute.contamination(docs, items))


def test_contamination_in_blocks_of_items(spark, monkeypatch):
    docs, items = benchmark_case(6)
    monkeypatch.setattr(decontamination.blocks, "__defaults__", (60,))
    docs = docs + docs[:3]
    got = decontamination.contamination_digest(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(tuple(r)[:6] for r in got.collect()) == sorted(brute.contamination(docs, items))


def test_proximity_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    docs = frame(spark, [(1, "alpha x beta y gamma delta"), (2, "alpha beta gamma delta"), (3, "delta gamma"), (4, "alpha b b b b b b b beta gamma delta")])
    got = {r.doc_id: (r.items, r.near_items) for r in decontamination.benchmark_matches(docs, items).collect()}
    assert got == {1: ([], [1]), 2: ([1], [1]), 3: ([], []), 4: ([], [])}
    assert decontamination.contamination(docs.limit(0), items).count() == 0
    assert not any(r.contaminated for r in decontamination.contamination(docs, items.limit(0)).collect())
    assert decontamination.contamination(frame(spark, AWKWARD), items).count() == len(AWKWARD)


# --- 2: fingerprints


def test_fingerprints(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()][:150] + AWKWARD
    got = fingerprints.fingerprint_report(frame(spark, rows), low=0.002, high=0.3).collect()
    ordered = sorted(((d, t or "") for d, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want = []
    for k, (doc, text) in enumerate(ordered):
        half, after = len(text) // 2, ordered[(k + 1) % len(ordered)][1]
        edited = text[: len(text) - half] + after[:half]
        want.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), text))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted((str(d), n, s) for d, n, s, _ in want)
    by_text = {}
    prints = {(r.doc_id, r.n_chars): r.fingerprint for r in got}
    for doc, n, _, text in want:
        assert by_text.setdefault(text, prints[doc, n]) == prints[doc, n]
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert sum(r.near_edited for r in got) > 4 * sum(r.near_next for r in got)
    assert fingerprints.fingerprint_report(frame(spark, [])).count() == 0
    one = fingerprints.fingerprint_report(frame(spark, [(1, "a b c")])).first()
    assert one.near_next == 1.0 and one.edited_sha256 == brute.sha("a ba ")


def test_fingerprints_of_a_large_group_of_near_copies(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(2000)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    hot, rows = say(120), []
    for k in range(100):
        own = hot[:k] + [f"own{k}"] + hot[k + 1 :] if k != 50 else hot + [f"much{j}" for j in range(25)]
        rows.append((k, " ".join(own)))
    rows += [(k, " ".join(say(120))) for k in range(100, 300)]
    got = {r.doc_id: r for r in fingerprints.fingerprint_report(frame(spark, rows)).collect()}
    assert all(got[k].near_next > 0.6 for k in range(99) if k not in (49, 50)) and min(got[49].near_next, got[50].near_next) > 0.4
    assert all(got[k].near_edited > 0.1 for k in range(99))
    assert max(got[k].near_next for k in range(99, 299)) < 0.4
    assert got[50].fingerprint[0] != "=" == got[49].fingerprint[0]


# --- 3 and 8: against SQL


@pytest.mark.parametrize("name", ["op3_chats", "op8_revisits"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(TABLES):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{TABLES}/{f}'")
    got = queries.QUERIES[name](spark, TABLES)
    answer = con.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in answer.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(str([r[c] for c in names]) for r in got.collect()) == sorted(str(list(r)) for r in answer.fetchall())


def test_chats(spark, monkeypatch):
    a = [("user", "hi"), ("assistant", "yes"), ("user", None)]
    logs = {1: a[:1], 2: a[:2], 3: a, 4: a, 5: a[:2] + [("user", "")], 6: [("user", "other")], 7: [(None, "hi")]}
    rows = [(c, k + 10 * (c == 4), r, t) for c, turns in logs.items() for k, (r, t) in enumerate(turns)] + [(None, 0, "user", "lost")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("chunk", F.lit("clash"))
    for size in (512, 2):
        monkeypatch.setattr(chats, "CHUNK_TURNS", size)
        got = chats.formatted_chats(turns).orderBy("conv_id", "part").collect()
        texts = {}
        for r in got:
            texts[r.conv_id] = texts.get(r.conv_id, "") + r.text
        assert set(texts) == {3, 5, 6, 7}
        assert {r.conv_id: r.n_equal for r in got} == {3: 2, 5: 1, 6: 1, 7: 1}
        assert texts[3] == "<|user|>\nhi<|end|>\n<|assistant|>\nyes<|end|>\n<|user|>\n<|end|>\n" and texts[7].startswith("<|unknown|>")
    assert chats.formatted_chats(turns.limit(0)).count() == 0


def test_revisits(spark, monkeypatch):
    records = [
        (1, "http://WWW.a.com/x?utm_s=1#f", 1, "response", {"etag": "e1", "date": "d1", "content-type": "h"}), (2, "https://a.com:443/x", 5, "revisit", {"etag": "W/e1", "date": "d2", "content-type": "z"}),
        (3, "a.com/x/", 5, "response", {"etag": "e3"}), (4, "a.com/x", 9, "revisit", {"etag": "e1"}), (5, "b.com", 9, "revisit", {}), (6, "c.com", 1, "response", None), (7, "c.com", 2, "revisit", {"vary": "q"}),
        (8, None, 1, "response", {}), (9, None, 2, "revisit", {}), (10, "c.com", None, "revisit", {}), (11, "d.com", 3, "response", {"last-modified": "m", "server": "s"}), (12, "d.com", 4, "revisit", {"last-modified": "m", "etag": "n"}),
    ]
    df = spark.createDataFrame(records, "record_id long, url string, captured long, kind string, headers map<string,string>").repartition(3)
    for size in (200_000, 2):
        monkeypatch.setattr(revisits, "SLOT_RECORDS", size)
        got = {r.record_id: (r.response_id, r.status, r.headers) for r in revisits.resolve_revisits(df).collect()}
        assert {k: v[:2] for k, v in got.items()} == {2: (1, "resolved"), 4: (3, "mismatch"), 5: (None, "no_response"), 7: (6, "unchecked"), 9: (None, "no_response"), 10: (None, "no_response"), 12: (11, "resolved")}
        assert got[2][2] == {"etag": "W/e1", "date": "d2", "content-type": "h"} and got[12][2] == {"last-modified": "m", "server": "s", "etag": "n"}
    assert revisits.resolve_revisits(df.limit(0)).count() == 0


# --- 5: quality


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.unionByName(spark.createDataFrame([(9001, None), (9002, ""), (9002, "")], "doc_id long, text string"), allowMissingColumns=True)
    rows = quality.classify(docs, labels).select("doc_id", "text", "held_out", "score", "predicted").collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    own = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(p == t for p, t in own) / len(own) > 0.9
    empty = [r.score for r in rows if r.doc_id in (9001, 9002)]
    assert len(empty) == 3 and len(set(empty)) == 1
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_network_without_labels():
    net = quality.fit(["a", "b"], [1, 1])
    assert net.scores(*utf8(pa.array(["x", None, "y" * 5000]))).min() > 0.9


# --- 6: pieces


@pytest.fixture(scope="module")
def automaton():
    return pieces.Automaton(pieces.load_pieces(MODEL))


def viterbi(automaton, text):
    """The best segmentation, character by character over the whole text."""
    known = {b.decode(): (automaton.score[k], k) for k, (b, _, kind) in enumerate(automaton.pieces) if kind == "piece"}
    most = max(map(len, known))
    if not text:
        return []
    t = "▁" + text.replace("▁", "\ue000").replace(" ", "▁")
    score, back = [0.0], [None]
    for p in range(1, len(t) + 1):
        best, at = score[p - 1] + automaton.unknown, (p - 1, None)
        for size in range(min(most, p), 0, -1):
            piece = known.get(t[p - size : p])
            if piece and score[p - size] + piece[0] > best:
                best, at = score[p - size] + piece[0], (p - size, piece[1])
        score.append(best)
        back.append(at)
    out, p = [], len(t)
    while p:
        q, k = back[p]
        out += [k] if k is not None else [int(automaton.byte_id[b]) for b in reversed(t[q:p].replace("\ue000", "▁").encode())]
        p = q
    return out[::-1]


def test_pieces_against_plain_viterbi(automaton):
    rng = random.Random(4)
    bits = ["the", "a", " ", "  ", "é", "▁", "x", "\n", "日本", "😀", "Thing ", "über", "\t", "0", ".", "\x00", "zzzzqqqq", "‱"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(800)] + ["", " ", "▁", "a" * 3000]
    ids, at = automaton.encode(*utf8(pa.array(texts)))
    for k, text in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == viterbi(automaton, text)
    assert [b.decode() for b in pieces.Vocabulary(automaton.pieces).decode(ids, at)] == texts


def test_round_trip(spark):
    rows = AWKWARD + [(10 + k, r.text) for k, r in enumerate(spark.read.parquet(f"{TABLES}/documents.parquet").limit(50).collect())]
    got = pieces.round_trip(frame(spark, rows), MODEL).collect()
    assert len(got) == len(rows) and all(r.exact for r in got)
    assert {r.doc_id: r.n_tokens for r in got}[1] == 0
    assert pieces.tokenized(frame(spark, rows), MODEL).where("text is null and piece_ids is not null").count() == 0
    assert pieces.round_trip(frame(spark, []), MODEL).count() == 0


# --- 7: licences


def plain_alignment(text, template):
    """Patience alignment, written recursively."""
    if not text or not template:
        return 0
    if text[0] == template[0]:
        return 1 + plain_alignment(text[1:], template[1:])
    if text[-1] == template[-1]:
        return 1 + plain_alignment(text[:-1], template[:-1])
    once = [w for w in template if template.count(w) == 1 and text.count(w) == 1]
    best = [[]]
    spots = sorted((text.index(w), template.index(w)) for w in once)
    for k, (i, j) in enumerate(spots):
        best.append(max((b for b in best if not b or b[-1] < (i, j) and b[-1][1] < j), key=len) + [(i, j)])
    chosen = max(best, key=len)
    if not chosen:
        return 0
    ends = [(-1, -1), *chosen, (len(text), len(template))]
    return len(chosen) + sum(plain_alignment(text[a + 1 : c], template[b + 1 : d]) for (a, b), (c, d) in zip(ends, ends[1:]))


def test_alignment():
    rng = random.Random(8)
    for _ in range(400):
        template = [rng.randrange(8) for _ in range(rng.randrange(1, 12))]
        text = [x for x in template if rng.random() < 0.8] + [rng.randrange(10) for _ in range(rng.randrange(4))]
        pairs = licenses.align(text, template)
        assert all(text[a] == template[b] for a, b in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
        assert len(pairs) <= len(template) and (sorted(set(text)) != sorted(text) or len(pairs) == plain_alignment(text, template))


def test_licenses(spark):
    mit = licenses.TEMPLATES["mit-text"]
    rows = AWKWARD + [(20, "Thn and.\nReleased under the MIT License."), (21, "start " * 30 + mit.replace("restriction", "limits") + " end"), (22, "the license of a of the")]
    got = {r.doc_id: r for r in licenses.license_matches(frame(spark, rows)).collect()}
    assert (got[20].license, got[20].coverage, got[20].first_word, got[20].last_word) == ("mit", 1.0, 2, 6)
    assert got[21].license == "mit-text" and 0.97 < got[21].coverage < 1 and got[21].first_word == 30
    assert got[22].license is None and got[1].license is None
    assert licenses.license_matches(frame(spark, rows)).count() == len(rows)
    assert licenses.license_matches(frame(spark, [])).count() == 0


def test_repeated_and_several_licenses(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    full = licenses.TEMPLATES["mit-text"]
    damaged = full.replace("free of charge", "gratis").replace("restriction", "limits")
    rows = AWKWARD + [
        (20, f"one two. {mit} three. {mit} four"), (21, f"{mit} some text {apache} end"), (22, f"a {damaged} b {damaged} c {damaged} d"), (23, f"{mit} {mit} {mit}"), (24, "a license of it"),
        (25, " x ".join(["go", *full.split()])), (26, f"see. {mit[:-1]} " * 3000),
    ]
    got = {r.doc_id: r for r in licenses.license_matches(frame(spark, rows)).collect()}
    places = lambda k, name: [(x.first_word, x.last_word) for x in got[k].found if x.license == name]
    assert got[20].license == "mit" and places(20, "mit") == [(2, 6), (8, 12)]
    assert places(21, "mit") == [(0, 4)]  # three of its five words in the other notice, without its name, are no notice
    assert places(21, "apache-2.0") == [(7, 14)] and got[21].coverage == 1
    n = len(re.findall("[a-z0-9]+", damaged.lower()))
    assert places(22, "mit-text") == [(1, n), (n + 2, 2 * n + 1), (2 * n + 3, 3 * n + 2)] and got[22].license == "mit-text"
    assert places(23, "mit") == [(0, 4), (5, 9), (10, 14)]
    assert got[24].license is None and got[24].found == [] == got[1].found
    assert got[25].license == "mit-text" and got[25].coverage > 0.9
    assert places(26, "mit") == [(6 * k + 1, 6 * k + 5) for k in range(3000)]


# --- 10: personal data

BASE = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_identifiers(text):
    out = []
    for kind, pattern in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(x) > 255 for x in m[0].split(".")) or kind == 2 and not (13 <= len(digits) <= 19 and pii.luhn(digits)) or kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_identifiers():
    rng = random.Random(1)
    bits = ["a", "@", ".", "1", "2", "25", "+", "-", " ", "(", ")", "b.c", "4111111111111111", "x", "é"]
    for _ in range(30000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 25)))
        assert pii.identifiers(text) == plain_identifiers(text), text


@pytest.mark.parametrize(
    "text, found",
    [
        ("mail john dot doe at example dot com now", "email:5:36"), ("bob [at] mail7.example.com", "email:0:26"), ("jоhn@exаmple.com", "email:0:16"), ("bob@example dot com!", "email:0:19"),
        ("call plus one two three five five five zero one nine nine eight.", "phone:5:63"), ("４１１１ １１１１ １１１１ １１１１", "card:0:19"), ("at one nine two dot one six eight dot one dot one", "ip:3:49"),
        ("look at the.house now", ""), ("he was at home. one two three.", ""), ("", ""),
    ],
)
def test_deobfuscation(text, found):
    base, added = pii.all_identifiers(text)
    assert pii._joined(base + added) == found


def test_personal_data(spark):
    rows = AWKWARD + [(30, "é a@b.co and (at) 😀 c (at) d.org +1 (222) 555-1234")]
    got = {r.doc_id: r for r in pii.personal_data_digest(frame(spark, rows)).collect()}
    assert got[30].spans == "email:2:8,email:20:32,phone:33:50" and (got[30].n_email, got[30].n_phone, got[30].n_added) == (1, 1, 1)
    assert got[30].base_sha256 == brute.sha("email:2:8,phone:33:50") and got[1].spans == "" and got[1].base_sha256 == brute.sha("")
    clean = {r.doc_id: r.text for r in pii.redacted(frame(spark, rows)).collect()}
    assert clean[30] == "é <EMAIL> and (at) 😀 <EMAIL> <PHONE>" and clean[1] is None
    assert pii.personal_data_digest(frame(spark, [])).count() == 0


# --- pipeline


def test_pipeline(spark):
    """Each stage's rows against brute force on what the stage before it kept."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(4).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = docs
    for name, step in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in kept.collect()}
        after_frame = step(spark, kept, sf)
        after = {r.doc_id: r for r in after_frame.collect()}
        if name == "quality":
            truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            assert all(d in after for d in before if truth.get(d) == 1)
        elif name == "near_duplicates":
            want = brute.components([(d, r.text) for d, r in sorted(before.items())], 5, 80)
            assert set(after) == {d for d, _, c in want if d == c}
        elif name == "decontamination":
            assert set(after) == {r[0] for r in brute.contamination([(d, r.text) for d, r in before.items()], items) if not r[5]}
        elif name == "personal_data":
            assert set(after) == set(before)
            assert all(r.text == pii.redact(before[d].text, sum(pii.all_identifiers(before[d].text), [])) and r.n_chars == len(r.text) for d, r in after.items())
        else:
            assert all(r.n_tokens == len(r.piece_ids) > 0 for r in after.values() if r.text) and after_frame.columns[:5] == docs.columns
            continue
        assert after_frame.columns == docs.columns
        kept = spark.createDataFrame(list(after.values()), docs.schema)
    assert corpus_pipeline.run(spark, sf).count() == len(after)
