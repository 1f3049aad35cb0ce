import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from draftsmith.llm import alignment as A
from draftsmith.llm import entries
from draftsmith.llm.bpe import byte_chars, tokenizer_file
from tests.conftest import SF_SMALL
from tests.llm.helpers import PROSE, docs_frame, long_text

FILES = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")


def plain_tokens(texts):
    """Per text (A ids, A ends, B ids, B ends), token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    byte = byte_chars()
    out = []
    for t in texts:
        if not t:
            out.append(([], [], [], []))
            continue
        enc = a.encode(" " + t, add_special_tokens=False)
        a_tokens = [bytes(byte[c] for c in x) for x in enc.tokens]
        b_ids = b.encode(t)
        b_tokens = []
        for i in b_ids:
            p = b.id_to_piece(i)
            b_tokens.append(bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
        if b"".join(a_tokens) != (" " + t).encode() or b"".join(b_tokens) != (" " + t).encode():
            out.append(([], [], [], []))
            continue
        ends = lambda xs: np.cumsum([len(x) for x in xs]).tolist()
        out.append((enc.ids, ends(a_tokens), b_ids, ends(b_tokens)))
    return out


def plain_rows(texts):
    """The contract's columns by plain loops over cut offsets."""
    docs, groups, held = plain_tokens(texts), [], Counter()
    for a, a_ends, b, b_ends in docs:
        links, parts = [], []
        both = sorted(set(a_ends) & set(b_ends))
        i = j = 0
        for end in both:
            ii, jj = i, j
            while a_ends[i] != end:
                i += 1
            while b_ends[j] != end:
                j += 1
            i, j = i + 1, j + 1
            parts.append(",".join(map(str, a[ii:i])) + "|" + ",".join(map(str, b[jj:j])))
            for x in range(ii, i):
                for y in range(jj, j):
                    xs, ys = (a_ends[x - 1] if x else 0), (b_ends[y - 1] if y else 0)
                    if xs < b_ends[y] and ys < a_ends[x]:
                        links.append((a[x], b[y]))
        groups.append((len(a), len(b), parts, links))
        held.update(set(links))
    best = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    return [
        (n_a, n_b, len(parts), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(";".join(parts).encode()).hexdigest() if parts else "")
        for n_a, n_b, parts, links in groups
    ]


COLS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

ODD = [
    None,
    "",
    " ",
    "a",
    "  two   spaces\tand\n\nlines  ",
    "<|endoftext|> <s> </s> <0x41> plain",
    "byte fallback: \U0001f600 中文 กำ é ﬁ \x00 \x7f",
    "a ▁ mark that B reads as a space",
    "▁",
    PROSE,
    PROSE,
    "I'll can't 12345 ///// ====== " + "x" * 500,
    "éèü" * 50,
]


def test_query_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()}
    got = entries.QUERIES["op13_cross_tokenizer_alignment"](spark, SF_SMALL).collect()
    want = dict(zip(texts, plain_rows(list(texts.values()))))
    assert len(got) == len(want)
    assert {r.doc_id: tuple(r[c] for c in COLS) for r in got} == want


@pytest.mark.parametrize("block", [1, A.BLOCK])
def test_odd_texts_repeated_rows_and_clashing_columns(spark, block):
    texts = ODD + [long_text(3000)]
    docs = docs_frame(spark, [(i // 2, t) for i, t in enumerate(texts)], extra=True).withColumnRenamed("m", "block")
    got = A.alignment_counts(docs, *FILES, block=block).collect()
    want = sorted((i // 2, *r) for i, r in enumerate(plain_rows(texts)))
    assert sorted((r.doc_id, *[r[c] for c in COLS]) for r in got) == want
    empty = dict(zip(texts, plain_rows(texts)))
    assert empty[None] == empty[""] == empty["▁"] == (0, 0, 0, 0, 0, 0, "")


def test_empty_table_and_string_or_null_ids(spark):
    assert A.alignment_counts(docs_frame(spark, []), *FILES).collect() == []
    rows = spark.createDataFrame([("k1", "one two"), (None, "three"), ("k1", None)], "doc_id string, text string")
    got = {(r.doc_id, r.n_a > 0) for r in A.alignment_counts(rows, *FILES).collect()}
    assert got == {("k1", True), (None, True), ("k1", False)}


def test_groups_are_whole_and_digest_is_theirs(spark):
    docs = docs_frame(spark, list(enumerate(ODD)))
    digests = {r.doc_id: r.groups_sha256 for r in A.alignment_counts(docs, *FILES).collect()}
    for r in A.align_documents(docs, *FILES).collect():
        text = ";".join(",".join(map(str, g.a)) + "|" + ",".join(map(str, g.b)) for g in r.groups)
        assert digests[r.doc_id] == (hashlib.sha256(text.encode()).hexdigest() if text else "")
        assert all(g.a and g.b for g in r.groups)


@pytest.fixture(scope="module")
def tok():
    with open(FILES[0], encoding="utf-8") as f, open(FILES[1], "rb") as g:
        return A.TwoTokenizers(f.read(), g.read())


def test_long_texts_in_pieces_are_as_in_one(tok, monkeypatch):
    text = (PROSE + ", l'été  12 ") * 40
    whole = tok.encode([text])
    monkeypatch.setattr(A, "_PIECE", 50)
    assert len(list(tok._pieces(" " + text))) > 10
    assert tok.encode([text]) == whole


def test_both_libraries_give_the_same_ids(tok):
    rng = random.Random(4)
    signs = [chr(i) for i in range(0x3001) if chr(i).isspace()] + ["\u180e", "\u200b", "\ufeff", "'s", "'LL", "12", "²", "½", "éa", "Ab", "the", "中", "\U0001f600", "!?", "_", "▁", "<s>", "<|endoftext|>", "\x00"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 25))) for _ in range(5000)] + ["x" * 20_000, " " * 4095 + "a", "\n" * 4095, (" " * 4000 + "b") * 9, " " * 1_000_000 + "a"]
    assert tok.a_encode(texts) == [x.ids for x in tok.a.encode_batch_fast(texts, add_special_tokens=False)]


def test_coalesce_and_links_on_random_cuts():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(1, 60))
        cut = lambda: np.append(np.sort(rng.choice(np.arange(1, n), int(rng.integers(0, n)), replace=False)), n) if n > 1 else np.array([1])
        a, b = cut(), cut()
        sa, sb = np.append(0, a[:-1]), np.append(0, b[:-1])
        ga, gb = A.coalesce(sa, a, sb, b)
        ends = sorted(set(a.tolist()) & set(b.tolist()))
        assert ga.tolist() == np.searchsorted(ends, a, "left").tolist() and gb.tolist() == np.searchsorted(ends, b, "left").tolist()
        i, j = A.links(sa, a, sb, b)
        assert list(zip(i.tolist(), j.tolist())) == [(x, y) for x in range(len(a)) for y in range(len(b)) if sa[x] < b[y] and sb[y] < a[x]]
