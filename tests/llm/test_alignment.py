"""Token alignment against whole-text encodings and plain counting."""

import random
from collections import Counter, defaultdict

import pytest
from brute import sha

from ladderwork.llm import alignment
from ladderwork.llm.alignment import alignment_report
from ladderwork.llm.totals import Spread

BYTE, PIECE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


def plain_groups(text, a, b, names, table):
    """Groups of ids (a, b) of a whole text, or None."""
    if not text:
        return None
    raw = (" " + text).encode()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    of_a = [bytes(table[c] for c in names[k]) for k in ids_a]
    of_b = [bytes([int(p[3:-1], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode() for k in ids_b for p in [b.id_to_piece(k)]]
    if b"".join(of_a) != raw or b"".join(of_b) != raw:
        return None
    ends = []
    for pieces in (of_a, of_b):
        at, own = 0, []
        for x in pieces:
            at += len(x)
            own.append(at)
        ends.append(own)
    cut = sorted(set(ends[0]) & set(ends[1]))
    group = {c: ([], []) for c in cut}
    for side, ids in enumerate((ids_a, ids_b)):
        k = 0
        for e, token in zip(ends[side], ids):
            while cut[k] < e:
                k += 1
            group[cut[k]][side].append(token)
    return [group[c] for c in cut]


def plain_report(docs):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    names, table = {k: n for n, k in a.get_vocab().items()}, alignment._byte_level()
    groups = [plain_groups(t, a, b, names, table) or [] for _, t in docs]
    links = [[(x, y) for g in own for x in g[0] for y in g[1]] for own in groups]
    count = Counter(p for own in links for p in set(own))
    highest = defaultdict(int)
    for (x, _), n in count.items():
        highest[x] = max(highest[x], n)
    out = []
    for (doc, _), own, pairs in zip(docs, groups, links):
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in own)
        out.append((doc, sum(len(x) for x, _ in own), sum(len(y) for _, y in own), len(own), len(pairs), sum(count[p] == highest[p[0]] for p in pairs), sum(count[p] for p in pairs), sha(written) if own else ""))
    return sorted(map(repr, out))


def got(docs):
    return sorted(repr(tuple(r)) for r in alignment_report(docs, BYTE, PIECE).collect())


def test_query_over_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(docs) == plain_report([(r.doc_id, r.text) for r in docs.collect()])


def made_texts(n):
    rng = random.Random(4)
    parts = [" ", "  ", "   ", "\n", "\n\n", "\t", "a", "ab", "'s", "é", "中", "中文", "\x85", "\x1c", "1", "12345", ".", "...", "<s>", "</s>", "<|endoftext|>", "　", " ", "​", "🙂", "́", "\x00", "\xa0", "ﬁ", "the", " the", " cat"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(n)]


@pytest.mark.parametrize("size, wide", [(2 << 20, 2048), (300, 4)])
def test_awkward_rows(spark, monkeypatch, size, wide):
    """Nulls, empty and long texts, odd characters, texts that a side doesn't spell, repeated rows and clashing columns, in
    large and small chunks, with few ranges and with shelves."""
    monkeypatch.setattr(alignment, "CHUNK_BYTES", size)
    monkeypatch.setattr(alignment, "Spread", lambda ranges, of: Spread(ranges, wide, 2, of))
    rows = [(k, t) for k, t in enumerate(made_texts(500))]
    rows += [(900, None), (901, ""), (902, " "), (903, "▁"), (904, "x ▁y"), (905, "word " * 3000), (906, "x" * 5000), (None, "the cat"), (None, None)]
    rows += [(1000 + k, "the same text") for k in range(300)] + rows[:40]
    docs = spark.createDataFrame([(d, t, "own", 7) for d, t in rows], "doc_id long, text string, key string, copies int").repartition(3)
    assert got(docs) == plain_report(rows)
    assert alignment_report(docs.limit(0), BYTE, PIECE).count() == 0


def test_tables_of_null_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert got(docs) == plain_report([(1, None), (2, "")])
