"""Mixing, toxicity, line dedup, SimHash, secrets and the pipeline against brute force and edge cases."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations, product

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidepool.llm import components, line_dedup, mixing, secrets, simhash, toxicity
from tidepool.llm._common import held_out

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def docs_of(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, an empty text, repeats, ties, a very long text, a null source and id."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, "a b c d e", "en", "x", 9), (1, "a b c d e", "en", "x", 9), (2, None, None, None, None), (3, "", "en", "y", 0), (4, long, "en", "x", 1), (5, "a b c d e", None, "y", 9),
            (None, "q r s", "en", None, 5), (None, "q r s", "en", None, 5), (6, " \n\t ", "en", "z", 4)]
    return docs_of(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


# mixing ------------------------------------------------------------------------------------------------------------


def water_fill(sizes, weights, most):
    """Shares by weight, the excess above the limits reshared until none is above."""
    w = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, full, total = {}, set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        free = [s for s in sizes if s not in full]
        target = {s: most * sizes[s] if s in full else rest * w[s] / sum(w[f] for f in free) for s in sizes}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def test_mix_meets_targets_and_quotas(spark):
    r = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(r.randrange(1, 400))), "en", r.choice(["a", "a", "a", "b", "c", "d", None]), 0) for i in range(3000)]
    docs = docs_of(spark, rows)
    out = mixing.mix_report(docs).toPandas()
    source = {row[0]: row[3] for row in rows}
    size = {row[0]: len(row[1].split()) for row in rows}
    total = Counter()
    for i, n in size.items():
        total[source[i]] += n
    target = water_fill(dict(total), (5, 2, 1), 3)
    taken = Counter()
    for x in out.itertuples():
        assert x.size == size[x.doc_id] and x.source_size == total[source[x.doc_id]] and x.taken <= 3 * x.size and x.taken % x.size == 0
        assert len(x.shards) == x.taken // x.size and abs(x.target - target[source[x.doc_id]]) < 1e-6
        taken[source[x.doc_id]] += x.taken
    for s in total:
        assert abs(taken[s] - target[s]) <= 0.001 * target[s], s  # whole documents only: a gap smaller than one document may stay
    again = mixing.mix_report(docs.repartition(7)).toPandas()
    key = ["doc_id"]
    assert out.sort_values(key).reset_index(drop=True).astype(str).equals(again.sort_values(key).reset_index(drop=True).astype(str))
    mixed = mixing.mix_documents(docs, shard_col="shard").toPandas()
    assert Counter(mixed.doc_id) == Counter({x.doc_id: x.taken // x.size for x in out.itertuples() if x.taken})


def test_splitting_tree_is_exact_and_hypergeometric(spark):
    quotas = spark.createDataFrame([(1, 40), (2, 0), (3, 24)], "n int, q long")
    first = []
    for seed in range(40):
        rows = {r["n"]: r["upto"] for r in mixing.splitting_tree(quotas, 2, seed).collect()}
        assert [rows[n][-1] for n in (1, 2, 3)] == [40, 0, 24]
        per = np.diff(np.array([[0, *rows[n]] for n in (1, 2, 3)]), axis=1)
        assert (per >= 0).all() and (per.sum(axis=0) == 16).all()
        first.append(per[0, 0])
    assert abs(np.mean(first) - 10) < 1.2  # 16 draws of 64 with 40 good: mean 10, sd 1.7


def test_mix_fills_the_gap_behind_a_document_that_does_not_fit(spark, tmp_path):
    r = random.Random(21)
    skewed = [(i, " ".join(["w"] * (r.choice([3000, 5000, 9000]) if i % 10 == 0 else r.randrange(1, 200))), "en", "abcdef"[i % 6], 0) for i in range(240)]
    ones = [(1000 + i, "w", "en", "g", 0) for i in range(3000)] + [(5000 + i, " ".join(["w"] * 4000), "en", "g", 0) for i in range(4)]
    repeats = [skewed[3]] * 5
    docs = docs_of(spark, skewed + ones + repeats).withColumn("extra", F.lit(1))
    out = mixing.mix_report(docs).toPandas()
    source = {row[0]: row[3] for row in skewed + ones}
    out["source"] = out.doc_id.map(source)
    total = {s: int(x) for s, x in out.groupby("source")["size"].sum().items()}
    want = water_fill(total, (5, 2, 1), 3)
    for s, x in out.groupby("source").taken.sum().items():
        assert abs(x - want[s]) <= 0.015 * want[s], (s, x, want[s])  # 40 documents a source, some of them longer than the gap
    assert out[out.doc_id == skewed[3][0]].taken.nunique() == 1  # repeated rows are taken together
    mixed = mixing.mix_documents(docs, shard_col="shard")
    assert mixed.columns == [*docs.columns, "shard"]
    assert Counter(x["doc_id"] for x in mixed.collect()) == Counter({i: int(n) for i, n in (out.assign(n=out.taken // out["size"])).groupby("doc_id").n.sum().items() if n})
    mixing.write_mix(docs, f"file://{tmp_path}/a", files_per_shard=1)
    mixing.write_mix(docs.repartition(5), f"file://{tmp_path}/b", files_per_shard=1)
    for shard in range(0, 32, 7):
        a, b = ([x["doc_id"] for x in spark.read.parquet(f"file://{tmp_path}/{d}/shard={shard}").collect()] for d in "ab")
        assert Counter(a) == Counter(b)
        assert len(a) < 30 or a != sorted(a)


def test_mix_edges(spark, odd, empty):
    out = mixing.mix_report(odd).toPandas()
    assert len(out) == 9 and out[out["size"] == 0].taken.sum() == 0
    assert mixing.mix_report(empty).count() == 0 and mixing.mix_documents(empty).count() == 0
    clash = odd.withColumns({"size": F.lit("x"), "target": F.lit(1), "block": F.lit(2), "shards": F.lit(0)})
    assert mixing.mix_documents(clash).columns == clash.columns


# toxicity ----------------------------------------------------------------------------------------------------------


def test_forward_backward_against_enumeration():
    r = np.random.default_rng(1)
    chain, start = r.normal(size=(2, 2)), r.normal(size=2)
    lengths = [1, 5, 3, 9]
    e = r.normal(size=sum(lengths))
    first = np.zeros(len(e), bool)
    first[np.cumsum([0, *lengths[:-1]])] = True
    got, at = toxicity.forward_backward(e, first, chain, start), 0
    for n in lengths:
        total, one = 0.0, np.zeros(n)
        for y in product((0, 1), repeat=n):
            w = np.exp(start[y[0]] + sum(e[at + i] * y[i] for i in range(n)) + sum(chain[y[i - 1], y[i]] for i in range(1, n)))
            total, one = total + w, one + w * np.array(y)
        assert np.abs(got[at:at + n] - one / total).max() < 1e-12
        at += n
    long = r.normal(size=1000)
    starts = np.arange(1000) == 0
    assert np.abs(toxicity.forward_backward(long, starts, chain, start)[:3] - toxicity.forward_backward(long[:200], starts[:200], chain, start)[:3]).max() < 1e-9


def test_toxicity_learns_and_keeps_held_out_labels_unread(spark, odd, empty):
    r = random.Random(3)
    clean = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        words = [r.choice(clean) for _ in range(80)]
        for _ in range(r.randrange(1, 5) if bad else 0):
            words[r.randrange(80)] = r.choice(["nasty", "Vile,", "rotten"])
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 0, int(bad)))
    docs = docs_of(spark, rows)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train_toxicity(docs, marks)
    out = {x["doc_id"]: x for x in toxicity.score_toxicity(docs, model).collect()}
    test = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(out[i]["predicted"] == (i % 5 == 0) for i in test) / len(test) > 0.97
    span = next(x for i, x in out.items() if i % 5 == 0 and x["spans"])
    text = rows[span["doc_id"]][1]
    assert re.search("nasty|Vile|rotten", text[span["spans"][0]["begin"]:span["spans"][0]["end"]])
    flipped = marks.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    same = toxicity.train_toxicity(docs, flipped)
    assert np.array_equal(same.emit, model.emit) and np.array_equal(same.doc, model.doc)
    odd_out = toxicity.score_toxicity(odd, model).toPandas()
    assert len(odd_out) == 9 and odd_out.score.between(0, 1).all() and toxicity.score_toxicity(empty, model).count() == 0
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(x["score"] < 0.5 for x in out.values())
    assert toxicity.train_toxicity(empty, marks.limit(0)).doc_scores(np.zeros(0), np.array([0]))[0] == 0.5


def test_document_scores_against_enumeration(spark):
    """Scores from all label paths of short documents, features of the document score recomputed plainly."""
    r = np.random.default_rng(4)
    model = toxicity.Crf(r.normal(size=toxicity.SLOTS), r.normal(size=(2, 2)), r.normal(size=2), r.normal(size=4))
    texts = ["", None, "One", "two words", "x, (y) 12 ... z", "nine short words make two to the ninth paths", " \n "]
    for x in toxicity.score_toxicity(docs_of(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)]), model).collect():
        words = (texts[x["doc_id"]] or "").lower().split()
        total, one = 0.0, np.zeros(len(words))
        for y in product((0, 1), repeat=len(words)):
            w = np.exp(sum(model.emit[toxicity.features(t)].sum() * v for t, v in zip(words, y)) + (model.start[y[0]] if y else 0) + sum(model.chain[a, b] for a, b in zip(y, y[1:])))
            total, one = total + w, one + w * np.array(y)
        m = one / total
        f = np.array([1, np.log1p(m.sum()), m.mean() if words else 0, m.max() if words else 0])
        score = 1 / (1 + np.exp(-f @ model.doc))
        assert abs(x["score"] - score) < 1e-9 and x["predicted"] == (score >= 0.5)


def test_toxicity_takes_null_and_repeated_labels_and_bounds_its_sample(spark, odd):
    rows = [(i, "nasty vile rotten words here" if i % 2 else "plain good calm words here", "en", "s", 0) for i in range(1, 400)]
    docs = docs_of(spark, rows).withColumns({"score": F.lit(1), "toxic": F.lit(0), "id": F.lit("z")})
    marks = spark.createDataFrame([(i, 0, i % 2) for i in range(1, 400)] + [(1, 0, 0), (2, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train_toxicity(docs, marks, most_bytes=2000)
    assert len(toxicity._fetch(docs.select("doc_id", "text").withColumnRenamed("doc_id", "id"), 2000)) < 90
    assert toxicity.score_toxicity(docs, model).count() == 399 and toxicity.drop_toxic(docs, model).columns == docs.columns


# line dedup --------------------------------------------------------------------------------------------------------


def test_line_dedup_against_brute_force(spark, empty):
    r = random.Random(8)
    lines = [f"line {i}" for i in range(40)] + ["footer", "  footer ", "", "\t"]
    rows = [(i, None if i % 17 == 0 else "\n".join(r.choice(lines) for _ in range(r.randrange(6))), "en", r.choice(["a", "a", "b", None]), 0) for i in range(300)]
    rows += [rows[5]] * 2 + [(900 + i, "one page\nthat is copied", "en", "a", 0) for i in range(60)]
    pages = {(row[3], row[1]) for row in rows}  # copies of a page are one page
    host, held = Counter(h for h, _ in pages), Counter()
    for h, t in pages:
        held.update({(h, x.strip(" \t\r\x0b\x0c")) for x in (t.split("\n") if t is not None else [])})
    bad = {k for k, n in held.items() if k[1] and n >= 3 and n > 0.1 * host[k[0]]}
    want = Counter((row[0], None if row[1] is None else "\n".join(x for x in row[1].split("\n") if (row[3], x.strip(" \t\r\x0b\x0c")) not in bad)) for row in rows)
    docs = docs_of(spark, rows).withColumns({"host": F.lit(1), "key": F.lit(2), "id": F.lit(3)})
    for most_keys in (100_000, 0):  # keys broadcast, keys shuffled to the documents that hold them
        out = line_dedup.drop_boilerplate(docs, host=F.col("source"), ratio=0.1, dropped="gone", most_keys=most_keys)
        assert out.columns == [*docs.columns, "gone"]
        assert Counter((x["doc_id"], x["text"]) for x in out.collect()) == want and bad
    assert line_dedup.drop_boilerplate(empty, host=F.col("source")).count() == 0


def test_line_dedup_edges(spark, odd):
    assert line_dedup.drop_boilerplate(odd, host=F.col("source")).count() == 9
    urls = spark.createDataFrame([("http://A.example.net/x",), ("https://u:p@b.org:80/#t",), ("nothing",), (None,)], "u string")
    assert [x[0] for x in urls.select(line_dedup.host_of(F.col("u"))).collect()] == ["a.example.net", "b.org", None, None]


# SimHash -----------------------------------------------------------------------------------------------------------


def slow_print(text, k, seed=42):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(p.encode(), seed) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(prints, most):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= most:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_every_link_shares_an_opened_list():
    for depth, n in ((1, 4), (2, 4), (3, 8), (4, 14)):
        lists = simhash.lists_to_open(depth)
        assert len(lists) == n and all(len(x) == depth for x in lists)
        for equal in combinations(range(8), 5):
            assert any(set(x) <= set(equal) for x in lists)
    assert [simhash.depth_for(n, 1024) for n in (0, 10**5, 10**7, 10**9, 10**14)] == [1, 1, 2, 3, 4]


def test_simhash_against_brute_force(spark, odd, empty):
    r = random.Random(5)
    base = [" ".join(r.choice("alpha Beta gamma delta éta\tzeta".split(" ")) for _ in range(r.randrange(1, 60))) for _ in range(60)]
    texts = base + [t + " tail" for t in base[:30]] + base[:10] + ["", None, "one", "One"]
    out = simhash.simhash_components(docs_of(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])).collect()
    prints = {i: slow_print(t, 3) for i, t in enumerate(texts)}
    assert {x["doc_id"]: int.from_bytes(x["fp"]) for x in out} == prints
    assert {x["doc_id"]: x["component_id"] for x in out} == slow_components(prints, 3)
    assert simhash.simhash_components(odd).count() == 9 and simhash.simhash_components(empty).count() == 0


@pytest.mark.parametrize(("longest", "depth"), [(4, 1), (2048, 1), (2048, 2), (16, 3), (2048, 4)])
def test_long_posting_lists_lose_no_link(spark, longest, depth):
    r = random.Random(6)
    centre = r.getrandbits(64)
    prints = {i: centre ^ sum(1 << b for b in r.sample(range(64), r.randrange(0, 5))) for i in range(150)} | {i: r.getrandbits(64) for i in range(150, 300)}
    prints = {i: p for p, i in {p: i for i, p in sorted(prints.items(), reverse=True)}.items()}
    reps = spark.createDataFrame([(i, bytearray(p.to_bytes(8))) for i, p in prints.items()], "doc long, fp binary")
    parts = components.connected_components(simhash.near_links(reps, 3, 8, longest, depth))
    got = {i: i for i in prints} | {x["node"]: x["component"] for x in parts.collect()}
    assert got == slow_components(prints, 3)


def test_near_copies_go_and_others_stay(spark, odd, empty):
    r = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    texts = [[r.choice(words) for _ in range(200)] for _ in range(80)]
    copies = [list(t) for t in texts[:30]]
    for t in copies:
        t[r.randrange(200)] = "changed"
    rows = [(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts + copies + texts[:5])]
    assert sorted(x["doc_id"] for x in simhash.drop_near_copies(docs_of(spark, rows)).collect()) == list(range(80))
    assert simhash.drop_near_copies(empty).count() == 0
    assert sorted(x["doc_id"] or 0 for x in simhash.drop_near_copies(odd).collect()) == [0, 1, 2, 4]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(201, 260)] + [(5, 5), (None, 4)]
    got = {x["node"]: x["component"] for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 200 for i in range(201, 260)}  # the smallest nodes are absent
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# secrets -----------------------------------------------------------------------------------------------------------


def test_secrets_against_regular_expressions(spark, odd, empty):
    r = random.Random(9)
    bits = ["password", "PASSWD", "secret", "Token", "api_key", "apikey", "=", ":", " ", '"', "'", "abcdef", "0123456789abcdef", "AKIA", "ABCDEFGH12345678", "x/y+z", "é日🙂", "ghp_", "eyJ", ".", "-", "a1b2", "xoxb-", "\n", "key"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(30))) for _ in range(600)] + [None, "", "-----BEGIN RSA PRIVATE KEY-----", "token=" + "k" * 5000]
    out = {x["doc_id"]: [tuple(s) for s in x["spans"]] for x in secrets.scan_secrets(docs_of(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])).collect()}
    rules = [(k, q, re.compile(q.pattern, re.A | (re.I if q.any_case else 0))) for k, q in enumerate(secrets.RULES)]
    found = 0
    for i, t in enumerate(texts):
        want = sorted((m.start(), k, q.kind, m.end()) for k, q, p in rules for m in p.finditer(t or "") if len(m[q.group]) >= q.least)
        assert out[i] == want, t
        found += len(want)
    assert found > 100
    assert secrets.scan_secrets(odd).count() == 9 and secrets.scan_secrets(empty).count() == 0


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]+") is None and secrets.trigram_query("ab?c+") is None
    assert secrets.trigram_query("foo|barn") == [frozenset({"bar", "arn"}), frozenset({"foo"})]
    assert set(secrets.trigram_query("colou?red")) == {frozenset(("col", "olo", "lou", "our", "ure", "red")), frozenset(("col", "olo", "lor", "ore", "red"))}


def test_more_trigrams_than_one_number_holds(spark):
    words = [f"{a}{b}{c}key{d}" for a in "abc" for b in "xyz" for c in "pq" for d in "12"]
    rules = tuple(secrets.Rule(w, w) for w in words)
    texts = [" ".join(words[i::7]) for i in range(7)] + [None]
    docs = docs_of(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)]).withColumns({"doc": F.lit(1), "trigram": F.lit(2), "bits0": F.lit(3), "spans": F.lit(4), words[0]: F.lit(5)})
    for x in secrets.scan_secrets(docs, rules=rules).collect():
        t = texts[x["doc_id"]] or ""
        assert sorted((s["start"], s["kind"]) for s in x["spans"]) == sorted((t.index(w), w) for w in words if w in t)


def test_redaction(spark):
    df = spark.createDataFrame([("my token=abcdef! é password: zzzzzz",)], "text string").withColumn("doc_id", F.lit(1))
    spans = secrets.scan_secrets(df)
    assert df.join(spans, "doc_id").select(secrets.redact(F.col("text"), F.col("spans"))).first()[0] == "my [secret]! é [secret]"


# pipeline ----------------------------------------------------------------------------------------------------------


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as cp

    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in cp.STAGES:
        before, docs = docs, cp.stage_table(stage(spark, docs, SF))
        seen.append((name, before, docs))
    assert [n for n, *_ in seen] == ["toxicity", "line_dedup", "simhash_dedup", "mixing", "pieces"]
    for _, before, after in seen[:-1]:
        assert after.columns == before.columns
    rows = lambda d: d.toPandas()
    tox, lines, sim, mix = (rows(a) for _, _, a in seen[:4])
    assert len(tox) == len(lines) and (lines.n_chars == lines.text.str.len()).all()
    k = 5
    shingles = {}
    for x in lines.itertuples():
        w = x.text.lower().split()
        shingles[x.doc_id] = {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))}
    kept, dropped = set(sim.doc_id), set(lines.doc_id) - set(sim.doc_id)
    like = lambda a, b: len(shingles[a] & shingles[b]) / max(1, len(shingles[a] | shingles[b]))
    for a, b in combinations(sorted(kept), 2):
        assert like(a, b) < 0.8
    for d in dropped:
        assert max(like(d, o) for o in shingles if o != d) >= 0.8
    assert set(mix.doc_id) <= kept and Counter(mix.doc_id).most_common(1)[0][1] <= 3
    assert seen[4][2].count() == len(mix)
