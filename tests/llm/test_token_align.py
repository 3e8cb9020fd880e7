"""Alignment of two tokenizers against whole texts encoded and compared token by token, and counts against a dictionary."""

import collections
import hashlib
import os

import numpy as np
import pytest

from quarrylog.llm import token_align

SF = "/root/testdata/sf0.001"
A, B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
pytestmark = pytest.mark.skipif(not os.path.exists(A), reason="no vocabularies here")
ODD = ["", " ", "  ", "a", "a  b", " a b ", "a\tb\n c", "x ▁ y", "▁", "<s> x </s> <|endoftext|> <unk>", "ａ é ö́ 漢字 🙂🙂", "a b   c", "don't  we'll 123 4567", "a\x00b \x1c c", "  b", "b  ", "　", "a\r\nb", "<0x41> [UNK]", "word " * 3000]


@pytest.fixture(scope="module")
def whole():
    """text -> groups as lists of ids, and links, from whole texts."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    alphabet = token_align.byte_alphabet()

    def groups(text):
        if not text:
            return [], []
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        raw_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            return [], []
        out, links, i, j, at_a, at_b = [], [], 0, 0, 0, 0
        while i < len(ids_a):
            own = ([], [])
            while True:
                if at_a <= at_b:
                    own[0].append((ids_a[i], at_a, at_a + len(raw_a[i])))
                    at_a += len(raw_a[i])
                    i += 1
                else:
                    own[1].append((ids_b[j], at_b, at_b + len(raw_b[j])))
                    at_b += len(raw_b[j])
                    j += 1
                if at_a == at_b:
                    break
            out.append(([x[0] for x in own[0]], [x[0] for x in own[1]]))
            links += [(x, y) for x, s, e in own[0] for y, u, v in own[1] if s < v and u < e]
        return out, links

    return groups


def results(rows, whole):
    """rows (doc_id, text) -> the contract's rows, and the counts of pairs."""
    found = [(d, *whole(t)) for d, t in rows]
    count = collections.Counter(p for _, _, links in found for p in set(links))
    most = collections.defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for d, groups, links in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((d, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr), count, most


def test_query_on_the_documents(spark, whole):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in token_align.op11_token_alignment(spark, SF).collect()), key=repr)
    assert got == results(rows, whole)[0]


@pytest.mark.parametrize("most_pairs", [token_align.MOST_PAIRS, 0])
def test_odd_rows_both_ways_of_looking_up(spark, whole, most_pairs):
    """Texts of all kinds, nulls, repeats and clashing columns; counts read in tasks, and joined."""
    rows = [*enumerate(ODD), (3, "a"), (None, "a"), (None, None), (99, None)]
    docs = spark.createDataFrame([(d, t, "r", "b", 5) for d, t in rows], "doc_id long, text string, row string, own string, n_a int")
    out, pairs = token_align.align(docs, A, B, most_pairs=most_pairs)
    assert out.columns == ["doc_id", "text", "row", "own", *token_align.NUMBERS, "groups"]
    got = out.collect()
    want, count, most = results(rows, whole)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest() if s else ""
    assert sorted(((r["doc_id"], *(r[c] for c in token_align.NUMBERS), sha(r["groups"])) for r in got), key=repr) == want
    assert {(r["row"], r["own"]) for r in got} == {("r", "b")}
    assert {((r["a"], r["b"]), r["docs"], r["best"]) for r in pairs.collect()} == {(p, n, n == most[p[0]]) for p, n in count.items()}


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    for most_pairs in (10, -1):
        out, pairs = token_align.align(docs, A, B, most_pairs=most_pairs)
        assert out.count() == pairs.count() == 0


def test_words_alone_as_whole_texts():
    """Texts cut into words and whole ones have the same tokens."""
    models = [open(p, "rb").read() for p in (A, B)]
    by_word, whole = (token_align.Aligner(*models, True) for _ in range(2))
    whole.by_word = False
    texts = [t for t in ODD if t] + [f"{x}{y}{z}" for x in ("a", "Üb", "1") for y in (" ", "  ", "\n", " \n", " ", "  ") for z in ("b", "'s", "!?", "é")]
    for t in texts:
        parts = ["".join(x.groups[w] for w in x.see([t])[0].tolist()) for x in (by_word, whole)]
        assert parts[0] == parts[1], t


def test_perfect_hash_numbers_every_key_once():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 40, 50_000))
    parts = {s: keys[token_align.segment_of(keys, 7) == s] for s in range(7)}
    levels = {s: token_align.perfect_levels(k) for s, k in parts.items()}
    number = token_align.PerfectHash(7, {s: [len(x) for x in v] for s, v in levels.items()}, {s: np.packbits(np.concatenate(v)).tobytes() for s, v in levels.items()})
    assert sorted(number(keys)) == list(range(len(keys)))


def test_sums_of_many_branches(spark, monkeypatch):
    """Counts of many tasks, summed over several rounds of the tree."""
    monkeypatch.setattr(token_align, "ROWS", 20)
    rows = [(t, p * 1_000_003, t % 3 + 1) for t in range(40) for p in range(100) if (t * p) % 5]
    slices = token_align.slice_of(np.array([r[1] for r in rows])).tolist()
    partial = spark.createDataFrame([(t, s, p, n) for (t, p, n), s in zip(rows, slices, strict=True)], "part long, slice long, pair long, n long")
    hashes = token_align.hash_pairs(partial, 2)
    sums = token_align.summed(partial, hashes, 2, len(rows))
    got = {}
    for r in hashes.join(sums, "segment").collect():
        got |= dict(zip(np.frombuffer(r["pairs"], np.int64).tolist(), np.frombuffer(r["counts"], np.int64).tolist(), strict=True))
    want = collections.Counter()
    for _, p, n in rows:
        want[p] += n
    assert got == want
