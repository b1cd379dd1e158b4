from collections import defaultdict

import public_tokenizers

from marginalia.llm import common, queries
from marginalia.llm import repeats as rp
from marginalia.llm.token_counts import token_counts

SF = "/root/testdata/sf0.001"


def test_short_and_unspaced_lines_that_repeat_go(frame):
    passage = "這是一段沒有空格的很長的文字" * 50
    docs = [(i, f"text {i}\n\nAll rights reserved.\n{passage}\n\nend {i}") for i in range(5)]
    got = {r.doc_id: r for r in rp.without_repeats(frame(docs), words=0).collect()}
    assert got[0].n_removed == 0 and all(got[i].text == f"text {i}\n\n\nend {i}" and got[i].n_removed == 2 for i in range(1, 5))


def test_all_repeats_are_registered():
    assert queries.ORACLE_SQL["repeated_lines_all"] != queries.REPEATED_LINES_SQL and "repeated_lines_all" in queries.QUERIES


def test_no_batch_of_several_documents_has_more_tokens_than_the_budget(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = {r.doc_id: r.n_tokens for r in token_counts(common.read(spark, SF, "documents"), path).collect()}
    batches = defaultdict(list)
    for r in queries.op1_packing(spark, SF).collect():
        assert r.n_tokens == want.pop(r.doc_id)
        batches[r.bucket_length, r.batch_no].append(r.n_tokens)
    assert not want and all(len(b) == 1 or sum(b) <= 16_384 for b in batches.values())
