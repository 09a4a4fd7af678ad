"""Awkward inputs of every stage, and fingerprints, licences and links against plain versions."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F
from test_operators import AWKWARD, MODEL, benchmark_case, frame, plain_alignment
from test_pairs import texts

import corpus_pipeline
from brute import ALNUM, components, lower, sha
from brute import contamination as brute_contamination
from brute import substrings as brute_substrings
from ladderwork.llm import decontamination, fingerprints, graph, jaccard, licenses, pieces, pii, quality, revisits, substrings
from ladderwork.llm.jaccard import distinct_documents, jaccard_components

CLASHES = "quality_score string, found string, pii string, text_code string, sid string, block string, component string, _rows string"


# --- stages


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_with_awkward_rows(spark, name):
    """Nulls, repeated rows, long texts, clashing columns and empty tables: other columns pass through, and rows that the
    stage has nothing against stay."""
    sf = "/root/testdata/sf0.001"
    step = dict(corpus_pipeline.STAGES)[name]
    clashes = [c.split()[0] for c in CLASHES.split(", ")]
    rows = [(d, t, "en", f"own {k}", len(t or "")) + tuple(f"{c} {k}" for c in clashes) for k, (d, t) in enumerate(AWKWARD)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}").repartition(3)
    got = step(spark, docs, sf)
    assert got.columns[: len(docs.columns)] == docs.columns
    kept = got.collect()
    by_row = {r[3]: r for r in rows}
    for r in kept:
        own = by_row[r.source]
        assert r.doc_id == own[0] and tuple(r[5:13]) == own[5:]
        assert r.text == own[1] or name == "personal_data"
    expected = {"quality": None, "near_duplicates": len(rows), "decontamination": len(rows), "personal_data": len(rows), "pieces": len(rows)}[name]
    assert expected is None or len(kept) == expected
    none = step(spark, docs.limit(0), sf)
    assert none.count() == 0 and none.columns == got.columns


def test_contaminated_rows_without_ids_go(spark):
    items = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(3).collect()]
    rows = [(None, items[0]), (1, items[1]), (1, "clean text"), (None, None), (2, "x " + items[2] + " y")]
    got = corpus_pipeline.decontaminated(spark, frame(spark, rows), "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, ""), (1, "clean text")]


@pytest.mark.parametrize("words", [80, 10_000])
def test_blocks_of_items_share_passes(spark, monkeypatch, words):
    docs, items = benchmark_case(8)
    monkeypatch.setattr(decontamination.blocks, "__defaults__", (60,))
    monkeypatch.setattr(decontamination, "PASS_WORDS", words)
    groups = list(decontamination.passes(spark.createDataFrame(items, "item_id long, text string"), 13))
    assert (len(groups) > 2) == (words == 80) and sum(map(len, groups)) > 5
    got = decontamination.contamination_digest(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(tuple(r)[:6] for r in got.collect()) == sorted(brute_contamination(docs, items))


def test_a_long_text_is_whole_in_every_operator(spark):
    """Identifiers, benchmark words and pieces at the end of a text of a million characters."""
    long = "plain words " * 90_000 + "mail a@b.org now"
    assert pii.all_identifiers(long)[0] == [(0, len(long) - 11, len(long) - 4)]
    got = pieces.round_trip(frame(spark, [(1, long), (2, "a")]), MODEL).where("doc_id = 1").first()
    assert got.exact and got.n_chars == len(long)


def test_many_added_identifiers_are_found():
    text = " ".join(f"u{k} [at] h{k}.org" for k in range(3000))
    base, added = pii.all_identifiers(text)
    assert not base and len(added) == 3000 and added == sorted(added)


# --- quality


def test_fitting_sees_whole_texts(spark):
    """Only the last words tell the labels apart, far beyond the first 3,000 bytes."""
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n))
    rows = [(k, say(900) + (" zqxjk zqxjk zqxjk zqxjk" if k % 2 else "") + " " + say(5)) for k in range(400)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k, _ in rows] + [(0, 1, 0), (None, 1, 0), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(frame(spark, rows), labels).where("held_out").collect()
    assert len(got) > 40 and sum(r.predicted == r.doc_id % 2 for r in got) > 0.9 * len(got)
    assert "x" not in got[0].asDict() and set(got[0].asDict()) >= {"score", "words", "predicted"}


def test_labels_that_contradict_each_other_are_left_out(spark):
    docs = frame(spark, [(1, "a"), (2, "b"), (3, "c")])
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, 1)], "doc_id long, quality int")
    net = quality.train(docs, labels)
    assert net.bias > 5 and not net.out.any()  # labels of 1 only are left


# --- fingerprints


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_fingerprint(text, known):
    """The fingerprint, one term and one subset after the other."""
    terms = {t for t in re.split(fingerprints._SEPARATORS, text.lower()) if t}
    both = {"own": [0] * fingerprints.SUBSETS, "band": [0] * fingerprints.SUBSETS}
    plain = 0
    for term in terms:
        code = xxhash.xxh64_intdigest(term.encode(), 42)
        plain ^= code
        again = xxhash.xxh64_intdigest(code.to_bytes(8, "little"), 42)
        draws = [xxhash.xxh64_intdigest(d.to_bytes(4, "little"), again) for d in range(8)]
        for k in range(fingerprints.SUBSETS):
            needed = fingerprints.DENSITIES[k // fingerprints.PER_DENSITY].bit_length() - 1
            if all(draws[d] >> k & 1 for d in range(needed)):
                half = code & 0xFFFFFFFF if k < fingerprints.SUBSETS // 2 else code >> 32
                both["own"][k] ^= half
                both["band"][k] ^= half if term in known else 0
    own, band = (" ".join("-" if v == 0 else f"{v:08X}" for v in both[x]) for x in ("own", "band"))
    n = len(terms & known)
    few = n < fingerprints.FEW or n * fingerprints.FEW_SHARE < len(terms)
    return (f"={plain:X}" if few else band) + "|" + own


def plain_likeness(a, b):
    """The likeness, from what is returned alone."""
    if a == b:
        return 1.0
    x, y = (z.split("|")["=" in a + b] for z in (a, b))
    pairs, best, size = list(zip(x.split(" "), y.split(" "))), 0.0, fingerprints.PER_DENSITY
    for d in range(len(fingerprints.DENSITIES)):
        own = [(p, q) for p, q in pairs[d * size : (d + 1) * size] if not p == q == "-"]
        best = max(best, sum(p == q for p, q in own) / max(len(own), size // 2))
    return best


def test_fingerprints_against_a_plain_version(spark):
    low, high = 0.004, 0.3
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r.text.isascii()][:120]
    rows += [(k + 10_000, t) for k, (_, t) in enumerate(AWKWARD) if t is None or t.isascii()] + [(20_000 + k, " ".join(["rare"] * 3 + [f"only{k}"])) for k in range(4)]
    frequency = {}
    for _, t in rows:
        for term in {x for x in re.split(fingerprints._SEPARATORS, (t or "").lower()) if x}:
            frequency[term] = frequency.get(term, 0) + 1
    known = {t for t, n in frequency.items() if max(1, low * len(rows)) <= n <= max(1, high * len(rows))}
    ordered = sorted((d, t or "") for d, t in rows)
    got = {r.doc_id: r for r in fingerprints.fingerprint_report(frame(spark, rows), low, high).collect()}
    kinds = set()
    for k, (doc, text) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, other, following = (plain_fingerprint(t, known) for t in (text, edited, after))
        assert (got[doc].fingerprint, got[doc].edited_fingerprint, got[doc].edited_sha256) == (own, other, sha(edited))
        assert got[doc].near_edited == pytest.approx(plain_likeness(own, other)) and got[doc].near_next == pytest.approx(plain_likeness(own, following))
        kinds.add(own[0] == "=")
    assert kinds == {True, False}


# --- licences


def test_licences_against_all_stretches(spark):
    """A template is reported exactly where some stretch of the text aligns with enough of it."""
    rng = random.Random(6)
    templates = {"one": "alpha beta gamma delta epsilon", "two": "alpha zeta beta eta", "three": "theta iota kappa lambda mu nu xi"}
    words = sorted({w for t in templates.values() for w in t.split()})
    rows = []
    for k in range(150):
        out = []
        while len(out) < 22:
            if rng.random() < 0.3:
                out += [w for w in rng.choice(list(templates.values())).split() if rng.random() < 0.85]
            else:
                out.append(rng.choice(words) if rng.random() < 0.2 else f"other{rng.randrange(50)}")
        rows.append((k, " ".join(out)))
    got = {r.doc_id: r for r in licenses.license_matches(frame(spark, rows), templates).collect()}
    some = 0
    for k, text in rows:
        w = ALNUM.findall(lower(text))
        for name, template in templates.items():
            t = template.split()
            reached = max(plain_alignment(w[a:b], t) for a in range(len(w)) for b in range(a + 1, min(len(w), a + len(t)) + 1)) / len(t)
            found = [x for x in got[k].found if x.license == name]
            if reached >= 0.6:
                some += 1
                assert found and max(x.coverage for x in found) >= 0.6
            for x in found:
                assert x.coverage >= 0.6 and plain_alignment(w[x.first_word : x.last_word + 1], t) >= x.n_aligned - 1
    assert some > 60


def test_templates_from_a_table(spark):
    table = spark.createDataFrame([("own", "these are the words of a licence"), ("own", "zzz"), (None, "x"), ("empty", None)], "name string, text string")
    known = licenses.templates_of(table)
    assert known == {"own": "these are the words of a licence"}
    got = licenses.license_matches(frame(spark, [(1, "see: these are the words of a licence."), (2, "other")]), known).collect()
    assert {r.doc_id: r.license for r in got} == {1: "own", 2: None}
    with pytest.raises(ValueError):
        licenses.templates_of(table, most_bytes=10)
    whole = licenses.TEMPLATES["bsd-3-clause"]
    got = licenses.license_matches(frame(spark, [(1, f"/* Copyright 2020\n{whole}\n*/ int x;")])).first()
    assert (got.license, got.coverage, got.first_word) == ("bsd-3-clause", 1.0, 2)


# --- substrings


@pytest.mark.parametrize("shelf", [1, 5, 1000])
def test_substrings_through_shelves(spark, monkeypatch, shelf):
    """Ranges reached in two levels: the same results, with blocks of a shelf merged."""
    rows = texts(seed=12, n=150)
    monkeypatch.setattr(substrings.repeated_places, "__defaults__", (4, shelf))
    got = sorted(tuple(r) for r in substrings.deduplicated_digest(frame(spark, rows + rows[:9])).collect())
    assert got == sorted(brute_substrings(rows + rows[:9]))
    assert substrings.deduplicated_digest(frame(spark, [])).count() == 0


# --- links


def test_sets_without_ids_link(spark):
    base = [f"w{k}" for k in range(120)]
    one, two, three = (" ".join(base + [f"{x}{k}" for k in range(n)]) for x, n in (("a", 0), ("a", 12), ("a", 26)))
    rows = [(5, one), (None, two), (9, three), (None, "lonely words that nobody shares at all"), (None, two)]
    want = components([(d if d is not None else 10**6 + k, t) for k, (d, t) in enumerate(rows)])
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard_components(frame(spark, rows)).collect())
    assert got == [(0, 0), (0, 5), (0, 5), (5, 5), (9, 5)]
    assert [c for _, _, c in want] == [5, 5, 5, 10**6 + 3, 5]


def test_components_in_rounds(spark, monkeypatch):
    """The rounds over the whole graph, which small graphs do without."""
    monkeypatch.setattr(graph, "CONTRACTED", 1)
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 200)]
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long").repartition(4)).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100, 200: 200}


def test_texts_that_share_a_frequent_line(spark):
    """Chance components fall apart under other seeds, and links inside them are found all the same."""
    rng = random.Random(9)
    line = " ".join(f"line{k}" for k in range(12))
    rows = []
    for k in range(240):
        own = [f"x{k}y{j}" for j in range(rng.randrange(3, 9))]
        rows.append((k, " ".join([line, *own])))
        if k % 10 == 0:
            rows.append((1000 + k, " ".join([line, *own, "more"])))
    for local in (jaccard.LOCAL, 300):
        got = sorted(tuple(r) for r in jaccard_components(frame(spark, rows), local=local).collect())
        assert got == sorted(components(rows))


def test_repeated_rows_of_one_id(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A b c d e f g"), (3, "other words stand here now")]
    kept = distinct_documents(frame(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 1, 3]


def test_jaccard_of_other_sizes(spark):
    rows = texts(seed=21, n=120)
    got = sorted(tuple(r) for r in jaccard_components(frame(spark, rows), size=3, num=60).collect())
    assert got == sorted(components(rows, 3, 60))


# --- revisits


def test_revisits_of_one_url_and_clashing_columns(spark):
    records = [(0, "a.com", 0, "response", {"etag": "e"})] + [(k, "http://a.com/", k, "revisit", {"etag": "e", "date": f"d{k}"}) for k in range(1, 60)]
    records += [(100 + k, None, k, "revisit", {}) for k in range(60)] + [(300, "b.com/" + "x" * 100_000, 1, "response", {}), (301, "b.com/" + "x" * 100_000, 2, "revisit", {})]
    df = spark.createDataFrame(records, "record_id long, url string, captured long, kind string, headers map<string,string>")
    got = {r.record_id: r for r in revisits.resolve_revisits(df.withColumns({"slot": F.lit(1), "stored": F.lit("x"), "response_id": F.lit(-1)})).collect()}
    assert len(got) == 120 and all(got[k].response_id == 0 and got[k].headers["date"] == f"d{k}" for k in range(1, 60))
    assert all(got[100 + k].status == "no_response" for k in range(60)) and got[301].status == "unchecked"


# --- licences that are none, vocabularies that are alike, words without end


def test_no_false_licences(spark):
    gpl = licenses.TEMPLATES["gpl-3.0"]
    filler = " ".join(f"w{k}" for k in range(2000))
    texts = ["He drives under the influence without a license", gpl, "software is distributed under the license terms", f"released {filler} under {filler} The MIT", "Released under the MIT License", f"x {licenses.TEMPLATES['bsd-3-clause']} y"]
    got = {r.doc_id: r for r in licenses.license_matches(frame(spark, list(enumerate(texts)))).collect()}
    assert [got[k].license for k in range(6)] == [None, "gpl-3.0", None, None, "mit", "bsd-3-clause"]
    assert [[x.license for x in got[k].found] for k in range(6)] == [[], ["gpl-3.0"], [], [], ["mit"], ["bsd-3-clause"]]


def test_licences_of_the_table_have_their_names(spark):
    """No document is given a short notice's licence without the notice's name in it, close to its other words."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: ALNUM.findall(lower(r.text)) for r in docs.collect()}
    some = 0
    for r in licenses.license_matches(docs).collect():
        for x in r.found:
            own = texts[r.doc_id][x.first_word : x.last_word + 1]
            assert {*licenses.REQUIRED.get(x.license, [])} <= {*own} and len(own) <= 3 * x.n_aligned
            t = ALNUM.findall(lower(licenses.TEMPLATES[x.license]))
            assert plain_alignment(own, t) >= x.n_aligned
            some += 1
        assert (r.license is None) == (not r.found)
    # A notice that stands in a text word for word is found there.
    for k, w in texts.items():
        for name in ("mit", "apache-2.0", "gpl-3.0", "cc-by-nc-4.0"):
            t = ALNUM.findall(lower(licenses.TEMPLATES[name]))
            if any(w[i : i + len(t)] == t for i in range(len(w) - len(t) + 1)):
                some += 1
    assert some


def test_like_vocabularies_are_kept_apart(spark):
    plain = [(f"p{k}".encode(), -float(k), "piece") for k in range(3001)]
    other = [(b, s, kind) if k != 1 else (b"qq", s, kind) for k, (b, s, kind) in enumerate(plain)]
    built = [pieces._built(pieces.Vocabulary, x, pieces._digest(x)) for x in (plain, other, plain)]
    assert built[0] is built[2] and built[0] is not built[1]


def test_long_words_are_searched_alike(spark, monkeypatch):
    """Words without spaces: one by one as in tables, and in bounded time."""
    rng = random.Random(12)
    known = pieces.load_pieces(MODEL)
    automaton = pieces.Automaton(known)
    letters = ["a", "b", "th", "é", "中", "🙂", "▁", "\n", "xyz", "the", "ing"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 300))) for _ in range(60)] + [" " * 50, "a" + " " * 9 + "b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encode = lambda: [automaton.encode(*pieces.utf8(pieces.pa.array([t])))[0].tolist() for t in texts]
    wanted = encode()
    monkeypatch.setattr(pieces, "LONG", 20)
    assert encode() == wanted
    monkeypatch.undo()
    long_text = "".join(rng.choice(letters) for _ in range(300_000))
    got = pieces.round_trip(rows.union(spark.createDataFrame([(99, long_text)], rows.schema)), MODEL).where("doc_id = 99").first()
    assert got.exact and got.n_tokens > 1000
