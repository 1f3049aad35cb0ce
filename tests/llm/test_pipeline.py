import hashlib
import math
from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline as P
from draftsmith.llm import entries, mixing
from draftsmith.llm.bpe import tokenizer_file
from tests.conftest import SF_SMALL
from tests.llm.helpers import DOCS, docs_frame
from tests.llm.test_lines import plain as plain_lines
from tests.llm.test_mixing import plain_copies
from tests.llm.test_simhash import plain_components, plain_fp


def test_run_against_brute_force(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    kept = sorted(r.doc_id for r in entries.QUERIES["op9_quality_rules"](spark, SF_SMALL).where("kept").collect())
    texts = plain_lines([(d, docs[d].text) for d in kept], 50)
    comp = plain_components([plain_fp(texts[d]) for d in kept], kept, 4)
    left = [d for d, c in zip(kept, comp) if d == c]
    n = Counter(docs[d].source for d in left)
    norm = sum(math.sqrt(x) for x in n.values())
    copies = {d: plain_copies(d, len(left) * math.sqrt(n[docs[d].source]) / norm / n[docs[d].source], mixing.SEED) for d in left}
    tok = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    want = Counter()
    for d, k in copies.items():
        ids = tok.encode(texts[d], add_special_tokens=False).ids
        want[d, docs[d].source, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()] += k
    got = entries.QUERIES["pipeline"](spark, SF_SMALL).collect()
    assert all(r.round_trip for r in got)
    assert Counter((r.doc_id, r.source, r.n_tokens, r.ids_sha256) for r in got) == +want


def test_stages_keep_the_columns(spark):
    rows = [(1, None), (2, ""), (3, "a\nb"), (None, "Some words here.\n" * 3), (4, "x " * 30), (4, "x " * 30), (5, "Plain words make one good line of prose that ends well, and then another few words follow it. " + "z" * 9)]
    for frame in (docs_frame(spark, rows), docs_frame(spark, rows, extra=True), spark.createDataFrame([], DOCS)):
        docs = frame
        for _, stage in P.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
        last = P.STAGES[-1][1](spark, docs, "")
        assert {"doc_id", "token_ids", "n_tokens"} <= set(last.columns) and last.count() == docs.count()


def test_stage_list():
    assert len(P.STAGES) == 5 and all(callable(f) for _, f in P.STAGES) and P.ORACLE_SQL is None
