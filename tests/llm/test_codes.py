"""Token counts, chat formatting, pieces, embeddings: exact round trips and brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.llm import ann, chat, embedding_dedup, pieces, queries, token_counts

SF = "/root/testdata/sf0.001"


def test_rollups_follow_from_the_final_state(spark):
    import tiktoken

    got = {(x["source"], x["lang"], x["tokenizer_version"]): (x["n_docs"], x["n_tokens"]) for x in queries.op3_token_counts(spark, SF).collect()}
    code = {v: token_counts._encoding(token_counts.read_ranks(f"{queries.TOKENIZERS}/{v}.tiktoken")) for v in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    assert isinstance(code["byte_bpe_50k"], tiktoken.Encoding)
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda x: x["doc_id"])
    seen, want = set(), {}
    for x in docs:
        if x["text"] not in seen:
            seen.add(x["text"])
            v = "byte_bpe_50k" if x["lang"] == "en" else "byte_bpe_multi_50k"
            n, t = want.get((x["source"], x["lang"], v), (0, 0))
            want[x["source"], x["lang"], v] = (n + 1, t + len(code[v].encode_ordinary(x["text"])))
    assert got == want


def test_rollups_of_repeats_nulls_and_long_texts(spark, tmp_path):
    rows = [(1, "a b", "en", "s"), (1, "a b", "en", "s"), (None, "a b", None, "s"), (2, "c", None, "s"), (3, "c", "de", "t"), (4, None, "en", None), (5, None, "fr", "s"), (6, "", "en", "s"), (7, "x " * 50_000, "fr", "s"), (None, "d", "de", "t"), (None, "d", "de", "t")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"h1": F.lit(1), "again": F.lit(2), "n_tokens": F.lit(3)}).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {(x["source"], x["lang"], x["tokenizer_version"]): x["n_docs"] for x in queries.op3_token_counts(spark, f"file://{tmp_path}").collect()}
    assert got == {("s", "en", "byte_bpe_50k"): 2, (None, "en", "byte_bpe_50k"): 1, ("s", None, "byte_bpe_multi_50k"): 1, ("s", "fr", "byte_bpe_multi_50k"): 1, ("t", "de", "byte_bpe_multi_50k"): 1}
    roll = token_counts.Rollup(spark, f"file://{tmp_path}/stream")
    token_counts.inserts(spark.createDataFrame([("s", "en", "v1", 5)], "source string, lang string, tokenizer_version string, n_tokens long")).write.parquet(f"file://{tmp_path}/changes")
    flow = spark.readStream.schema("source string, lang string, tokenizer_version string, sign int, n_tokens long").parquet(f"file://{tmp_path}/changes")
    token_counts.commit_stream(roll, flow, f"file://{tmp_path}/check").awaitTermination(120)
    token_counts.commit_stream(roll, flow, f"file://{tmp_path}/check").awaitTermination(120)  # nothing new
    assert [tuple(x) for x in roll.totals().collect()] == [("s", "en", "v1", 1, 5)]


def test_commits_are_idempotent_and_additive(spark, tmp_path):
    schema = "source string, lang string, tokenizer_version string, n_tokens long"
    a = spark.createDataFrame([("s", "en", "v1", 5), ("s", "en", "v1", 7), (None, None, "v1", None)], schema)
    b = spark.createDataFrame([("s", "en", "v1", 7)], schema)
    new = spark.createDataFrame([("s", "en", "v2", 9)], schema)
    roll = token_counts.Rollup(spark, f"file://{tmp_path}/roll")
    assert roll.totals().count() == 0
    assert roll.commit("one", token_counts.inserts(a)) and not roll.commit("one", token_counts.inserts(a))
    assert roll.commit("two", token_counts.revisions(b, new)) and roll.commit("none", token_counts.inserts(a.limit(0)))
    (tmp_path / "roll" / "batch=half").mkdir()  # a writer that was lost before its success mark
    assert {tuple(x) for x in roll.totals().collect()} == {("s", "en", "v1", 1, 5), ("s", "en", "v2", 1, 9), (None, None, "v1", 1, 0)}
    assert roll.commit("half", token_counts.deletes(new)) and ("s", "en", "v2", 1, 9) not in {tuple(x) for x in roll.totals().collect()}
    with pytest.raises(ValueError):
        roll.commit("a/b", token_counts.inserts(a))
    before = {tuple(x) for x in roll.totals().collect()}
    assert roll.compact() == 4 and {tuple(x) for x in roll.totals().collect()} == before
    assert not roll.commit("one", token_counts.inserts(a)) and roll.commit("five", token_counts.inserts(a))
    (tmp_path / "roll" / "base=000000002" / "totals").mkdir(parents=True)  # a base that was never finished
    after = {tuple(x) for x in roll.totals().collect()}
    assert ("s", "en", "v1", 3, 17) in after and roll.compact() == 5 and {tuple(x) for x in roll.totals().collect()} == after
    import shutil

    for name in ("one", "two", "five"):
        shutil.rmtree(tmp_path / "roll" / f"batch={name}")
    assert {tuple(x) for x in roll.totals().collect()} == after and not roll.commit("two", token_counts.inserts(a))
    counted = token_counts.count_tokens(spark.createDataFrame([(1, "two words"), (2, None), (3, "")], "id long, text string"), token_counts.read_ranks(f"{queries.TOKENIZERS}/byte_bpe_50k.tiktoken"))
    assert sorted(tuple(x) for x in counted.collect()) == [(1, 2), (2, 0), (3, 0)]


def test_chat_round_trip(spark):
    r = random.Random(2)
    bits = [*chat.CONTROL, "\\", "<", "[", "/s>", "|im_end|>", "\n", "é", "🙂", "ok ", "<\\|im_start|>", "[\\\\INST]"]
    rows, want = [], {}
    for c in range(200):
        turns = [(r.choice(["user", "assistant", "system", "we\\ird\nrole", ""]), "".join(r.choice(bits) for _ in range(r.randrange(8)))) for _ in range(r.randrange(1, 6))]
        want[c] = turns
        rows += [(c, i, a, t) for i, (a, t) in enumerate(turns)]
    rows += [(300, 0, "user", None), (300, 1, None, "x"), (301, 0, "assistant", "y" * 200_000)]
    want[300], want[301] = [("user", ""), ("", "x")], [("assistant", "y" * 200_000)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"turns": F.lit(1), "loss": F.lit(2)})
    out = {x["conv_id"]: x for x in chat.format_chats(df).collect()}
    for c, turns in want.items():
        raw = bytes(out[c]["formatted"])
        assert chat.parse_chat(raw) == turns
        assert [chat.unescape(raw[s["begin"]:s["end"]]).decode() for s in out[c]["loss"]] == [t for a, t in turns if a == "assistant"]
        assert all(raw[s["begin"]:s["end"]].count(k.encode()) == 0 for s in out[c]["loss"] for k in chat.CONTROL)
    digests = {x["conv_id"]: x for x in chat.chat_digests(chat.format_chats(df)).collect()}
    for c, turns in want.items():
        said = "".join(t for a, t in turns if a == "assistant")
        assert digests[c]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in turns).encode()).hexdigest()
        assert (digests[c]["n_turns"], digests[c]["loss_chars"], digests[c]["loss_sha256"]) == (len(turns), len(said), hashlib.sha256(said.encode()).hexdigest())
        assert digests[c]["formatted_chars"] == len(bytes(out[c]["formatted"]).decode())
    assert chat.format_chats(df.limit(0)).count() == 0
    null = spark.createDataFrame([(None, 1, "user", "b"), (None, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    assert chat.parse_chat(bytes(chat.format_chats(null).first()["formatted"])) == [("user", "a"), ("user", "b")]


def test_pieces_equal_the_library(spark):
    import sentencepiece

    path = f"{queries.TOKENIZERS}/piece_bpe_32k.model"
    model, library = pieces.read_model(path), sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(1)
    texts = ["".join(r.choice("abcdeéñ  \t\n.,;!?01▁日本🙂İtheing-'") for _ in range(r.randrange(80))) for _ in range(3000)]
    texts += [x["text"] for x in spark.read.parquet(f"{SF}/documents.parquet").collect()] + ["", " ", " " * 90, "a" * 700, "x" * 3000, "\n\n", "\x00\x7f", "q9Z" * 20_000, "same", "same"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "doc_id long, text string").withColumn("decoded", F.lit(0))
    out = {x["doc_id"]: x for x in pieces.decode_documents(pieces.encode_documents(df, model), model).collect()}
    for i, t in enumerate(texts):
        assert out[i]["ids"] == library.encode(t), t
        assert out[i]["decoded"] == t.replace("▁", " ") == library.decode(out[i]["ids"])
    assert out[-1]["ids"] == [] and out[-1]["decoded"] == ""
    assert pieces.encode_documents(df.limit(0), model).count() == 0


def test_many_units_are_composed_together(monkeypatch):
    import pyarrow as pa
    import sentencepiece

    path = f"{queries.TOKENIZERS}/piece_bpe_32k.model"
    code, library = pieces.Transducer(pieces.read_model(path), remembered=300), sentencepiece.SentencePieceProcessor(model_file=path)
    one_by_one, path_of = [], code._path
    monkeypatch.setattr(code, "_path", lambda u: one_by_one.append(u) or path_of(u))
    r = random.Random(4)
    texts = ["".join(r.choice("abcdeéñÿß÷  \t\n.,;!?01▁日本🙂İthein-'\x0b\u3000|):_") for _ in range(r.randrange(60))) for _ in range(3000)]
    texts += [None, "", " ", "\n", "▁", "a" * 256, "b" * 257, "é,é.ß!÷,", "日本" * 100, " " * 90, "🙂" * 80]
    whole = pa.array([None, "x", *texts])[2:]
    for _ in range(2):  # the second time with spans that are known
        for at in range(0, len(texts), 700):
            some = whole.slice(at, 700)
            ids, edges = code.encode_all(some)
            assert [ids[a:z].tolist() for a, z in zip(edges, edges[1:])] == [library.encode(t or "") for t in some.to_pylist()]
            assert code.decode_all(ids, edges).to_pylist() == [(t or "").replace("▁", " ") for t in some.to_pylist()]
    assert set(one_by_one) == {" " + "a" * 256, " " + "b" * 257}  # longer than the others by far
    ids, edges = code.encode_all(whole.slice(0, 0))
    assert len(ids) == 0 and edges.tolist() == [0]
    broken = np.array([code.byte_ids[0xE6], code.byte_ids[0x97], *library.encode("x")])  # bytes that make no text
    assert code.decode_all(broken, np.array([0, 2, len(broken)])).to_pylist() == ["\ufffd", "x"]
    a, b = (np.array([r.randrange(3, 32000) for _ in range(4000)]) for _ in range(2))
    known = np.array([i in code.halves or len(code.text.get(i, "")) == 1 for i in range(32000)])
    on = known[a] & known[b]
    for _ in range(2):
        assert code._open(a[on], b[on]).tolist() == [code.side_by_side(x, y) for x, y in zip(a[on].tolist(), b[on].tolist())]


def test_coding_and_decoding_in_one_pass(spark):
    model = pieces.read_model(f"{queries.TOKENIZERS}/piece_bpe_32k.model")
    texts = [None, "", " ", "a b ▁", "🙂\n  x,y", *[f"word{i} ñandú{i}," * (i % 90) for i in range(500)], "z" * 300_000, "ab " * 900_000, "end"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "ids int, doc_id long, text string")
    once, twice = pieces.recode_documents(df, model), pieces.decode_documents(pieces.encode_documents(df, model), model)
    assert once.columns == twice.columns == ["doc_id", "text", "ids", "decoded"]
    got = {r["doc_id"]: r for r in once.collect()}
    assert got == {r["doc_id"]: r for r in twice.collect()} and len(got) == len(texts)
    assert all(got[i]["decoded"] == (t or "").replace("▁", " ") for i, t in enumerate(texts))
    assert once._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def planted(r, n=400):
    x = r.normal(size=(n, 16))
    x[100:160] = x[100] + 0.25 * r.normal(size=(60, 16))
    x[200:220] = x[200]
    x[230] = 2.5 * x[200]
    return x


def slow_links(x, cosine):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= cosine
    np.fill_diagonal(near, False)
    root = list(range(len(x)))
    for _ in range(len(x)):
        new = [min([root[i], *(root[j] for j in np.flatnonzero(near[i]))]) for i in range(len(x))]
        if new == root:
            break
        root = new
    return near.sum(axis=1), root


def vectors_of(spark, x, extra=()):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + list(extra), "vec_id long, embedding array<double>")


@pytest.mark.parametrize("residents,visitors", [(8192, 32768), (16, 32)])
def test_embedding_links_against_brute_force(spark, residents, visitors, monkeypatch):
    x = planted(np.random.default_rng(0))
    links, root = slow_links(x, 0.9)
    bad = [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [None] + [1.0] * 15), (904, [float("inf")] * 16), (905, [])]
    plain = embedding_dedup.embedding_links
    monkeypatch.setattr(embedding_dedup, "embedding_links", lambda a, b, c: plain(a, b, c, residents, visitors))
    out = {r["vec_id"]: r for r in embedding_dedup.embedding_components(vectors_of(spark, x, bad)).collect()}
    assert len(out) == 406 and links.sum() > 500
    for i in range(400):
        assert (out[i]["n_links"], out[i]["component_id"], out[i]["kept"]) == (links[i], root[i], root[i] == i)
    for i, _ in bad:
        assert (out[i]["n_links"], out[i]["component_id"], out[i]["kept"]) == (0, i, True)
    assert embedding_dedup.embedding_components(vectors_of(spark, x[:0])).count() == 0


def test_vectors_of_any_scale_and_length(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(40, 8))
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    rows += [(100, [1e200] * 8), (101, [2e200] * 8), (102, [3e-200] * 8), (103, [1e-310] * 8), (104, [1.0] * 3), (105, [2.0] * 3), (106, [1.0] * 8), (106, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "raw": F.lit(2), "n_links": F.lit("x"), "part": F.lit(3)})
    out = {v["vec_id"]: v for v in embedding_dedup.embedding_components(df).collect()}
    ones = {100, 101, 102, 103, 106}
    assert {out[i]["component_id"] for i in ones} <= set(range(40)) | {100} and len({out[i]["component_id"] for i in ones}) == 1
    assert all(out[i]["n_links"] >= 5 for i in ones) and (out[104]["component_id"], out[105]["component_id"], out[105]["n_links"]) == (104, 104, 1)
    near = ann.nearest_neighbours(df, every=1, k=4).toPandas()
    assert set(near[near.query_id == 100].vec_id) <= ones and near[near.query_id == 100].score.between(1 - 1e-12, 1 + 1e-12).all()
    assert near[near.query_id == 104].vec_id.tolist() == [105]
    bad = spark.createDataFrame([(0, [1.0, 2.0]), (1, [float("nan"), 1.0]), (2, [float("inf"), 1.0]), (3, [2.0, 4.0])], "vec_id long, embedding array<double>")
    assert set(ann.nearest_neighbours(bad, every=1, k=5).toPandas().query_id) == {0, 3}


def test_neighbours_recall_and_exact_scores(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(4000, 16))
    x[50:60] = x[50]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = ann.nearest_neighbours(vectors_of(spark, x, [(5000, None), (5050, [0.0] * 16)]), every=50, k=5, block=700).toPandas()
    hits = 0
    for q, g in out.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == [1, 2, 3, 4, 5] and q not in set(g.vec_id)
        assert np.allclose(g.score, u[g.vec_id] @ u[q], atol=1e-12)
        assert list(zip(-g.score, g.vec_id)) == sorted(zip(-g.score, g.vec_id))
        s = u @ u[q]
        s[q] = -2
        hits += len(set(np.lexsort((np.arange(len(s)), -s))[:5]) & set(g.vec_id))
    assert len(out) == 400 and hits / 400 >= 0.9
    ties = out[out.query_id == 50].sort_values("rank")
    assert ties.vec_id.tolist() == [51, 52, 53, 54, 55]
    few = ann.nearest_neighbours(vectors_of(spark, x[:3]), every=1, k=5).toPandas()
    assert Counter(few.query_id) == {0: 2, 1: 2, 2: 2}
    assert ann.nearest_neighbours(vectors_of(spark, x[:0])).count() == 0


def test_clustered_vectors_probe_few_partitions(spark):
    r = np.random.default_rng(8)
    centres = r.normal(size=(64, 16)) * 3
    x = (centres[r.integers(0, 64, 3000)] + r.normal(size=(3000, 16)) * 0.2).astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    graph = ann.neighbour_graph(x, 10)
    part = ann.balanced_partition(x, graph, 16)
    learn = np.arange(3000) % 6 != 5
    router = ann.fit_router(x[learn], graph[learn], part, 16, homes=part[learn])
    assert ann.enough_probes(router, x, graph, 0.97) <= 4
    out = ann.nearest_neighbours(vectors_of(spark, x), every=50, k=5, block=40).toPandas()  # many blocks of queries and rows
    hits = sum(len(set(np.argsort(-np.where(np.arange(3000) == q, -2, u @ u[q]))[:5]) & set(g.vec_id)) for q, g in out.groupby("query_id"))
    assert len(out) == 300 and hits / 300 >= 0.9 and out.groupby("query_id")["rank"].apply(list).map(lambda v: v == [1, 2, 3, 4, 5]).all()
    shapeless = r.normal(size=(1200, 32))
    g2 = ann.neighbour_graph(shapeless, 10)
    p2 = ann.balanced_partition(shapeless, g2, 16)
    assert ann.enough_probes(ann.fit_router(shapeless[learn[:1200]], g2[learn[:1200]], p2, 16, homes=p2[learn[:1200]]), shapeless, g2, 0.97) > 4


def test_balanced_partition_is_balanced():
    x = np.random.default_rng(3).normal(size=(1000, 8))
    part = ann.balanced_partition(x, ann.neighbour_graph(x, 8), 8)
    assert np.bincount(part).max() <= 138 and len(set(part)) == 8
