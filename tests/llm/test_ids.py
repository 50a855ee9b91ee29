"""Rows without an id, and ids beyond the range of doubles, in operators that build components."""

import numpy as np

from tidepool.llm import embedding_dedup, simhash


def test_fingerprints_reach_each_other_through_a_row_without_an_id(spark, monkeypatch):
    big = (1 << 60) + 1
    rows = [(1, 0), (None, 7), (3, 63), (big, 1 << 40), (big + 2, 3 << 40), (None, 0xFFFF << 20), (None, 0xFFFF << 20), (9, 0xFFFFFFFF)]
    prints = spark.createDataFrame([(d, v.to_bytes(8, "big")) for d, v in rows], "doc_id long, fp binary")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, **_: prints)
    got = sorted(((x["doc_id"], int.from_bytes(x["fp"], "big"), x["component_id"]) for x in simhash.simhash_components(prints).collect()), key=str)
    part = {1: 1, None: 1, 3: 1, big: 1, big + 2: 1, 9: 9}  # 2 ** 40 and 3 * 2 ** 40 are 1 and 2 bits from 0
    want = [(d, v, None if v == 0xFFFF << 20 else part[d]) for d, v in rows]
    assert got == sorted(want, key=str)


def test_vectors_without_an_id_change_no_other_links(spark):
    big = (1 << 60) + 1
    e = np.eye(6)
    rows = [(big, e[0]), (big + 2, 3 * e[0]), (None, e[1]), (None, 2 * e[1] + 0.1 * e[2]), (5, e[3]), (None, e[3] + 0.3 * e[4]), (7, e[3] + 0.7 * e[4]), (8, None), (None, None), (9, e[5]), (9, -e[5])]
    df = spark.createDataFrame([(i, None if v is None else [float(c) for c in v]) for i, v in rows], "vec_id long, embedding array<double>")
    got = sorted(((x["vec_id"], x["n_links"], x["component_id"]) for x in embedding_dedup.embedding_components(df).collect()), key=str)
    want = [(big, 1, big), (big + 2, 1, big), (None, 1, None), (None, 1, None), (5, 1, 5), (None, 2, 5), (7, 1, 5), (8, 0, 8), (None, 0, None), (9, 0, 9), (9, 0, 9)]
    assert got == sorted(want, key=str)
