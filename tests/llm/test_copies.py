"""Near copies by both methods: SimHash links and shingle links make common groups."""

from test_near_copies import slow_print

import corpus_pipeline
from demandloom.llm import simhash
from demandloom.llm.similar import drop_similar


def test_stage_takes_links_of_the_simhash_as_well(spark, rows):
    words = [f"v{i}" for i in range(300)]
    x = " ".join(words[:40] * 12)
    y = " ".join([*words[:40] * 12, *words[100:112]])                  # few new words, but over a fifth of the distinct shingles
    z = " ".join([*y.split()[:-1], "last"])                            # like y by its shingles, three bits from x
    assert (slow_print(x) ^ slow_print(y)).bit_count() <= 2 < (slow_print(x) ^ slow_print(z)).bit_count()
    docs = rows((1, x), (2, y), (3, z), (4, "quite another text"), (5, None), (6, " "), more=True)
    assert sorted(r.doc_id for r in drop_similar(docs).collect()) == [1, 2, 4, 5]
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 5]
    assert sorted(r.doc_id for r in simhash.drop_near_copies(docs.where("doc_id < 3")).collect()) == [1]
