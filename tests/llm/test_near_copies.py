"""The near-copy stage of the pipeline against brute-force Jaccard similarity."""

import random
from itertools import combinations

from tidepool.llm import simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], DOCS)


def shingles(text, k=5):
    w = text.lower().split()
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def components(sets, least):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [(a, b) for a, b in combinations(sorted(sets), 2) if jaccard(sets[a], sets[b]) >= least]
    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return links, {i: find(i) for i in sets}


def edited(r, words, n):
    out = list(words)
    for at in r.sample(range(len(out)), n):
        out[at] = f"new{r.getrandbits(40)}"
    return out


def test_every_link_at_the_limit_is_found_and_none_below(spark):
    r = random.Random(11)
    passage = [f"p{i}" for i in range(30)]
    texts = []
    for size in (6, 9, 12, 40, 120, 300):
        for g in range(14):
            base = [f"w{r.randrange(4000)}" for _ in range(size)] + (passage if g % 3 == 0 else [])
            texts += [base, *[edited(r, base, max(1, round(len(base) * x))) for x in (0.012, 0.02, 0.023, 0.026, 0.03)], base[:round(size * 0.82)], base + base]
    texts = dict(enumerate(" ".join(t) for t in texts))
    sets = {i: shingles(t) for i, t in texts.items()}
    links, want = components(sets, 0.8)
    near = [jaccard(sets[a], sets[b]) for a, b in links]
    assert sum(x < 0.85 for x in near) > 50
    kept = {x["doc_id"] for x in simhash.drop_near_copies(docs_of(spark, texts.items())).collect()}
    assert kept == set(want.values())


def test_lists_cut_into_blocks_lose_no_link(spark):
    r = random.Random(12)
    base = [f"w{i}" for i in range(200)]
    texts = {i: " ".join(edited(random.Random(i), base, 1 + i % 6)) for i in range(60)}
    sets = {i: shingles(t) for i, t in texts.items()}
    _, want = components(sets, 0.8)
    rows = spark.createDataFrame([(i, i, i, t) for i, t in texts.items()], "id long, h1 long, h2 long, text string")
    prints = simhash._set_prints(rows, 5, 8, 0.8)
    reps = simhash.stage_table(prints.selectExpr("id as node", "struct(false as no_id, id, h1, h2) as first", "fp", "keys"))
    for longest in (4, 2048):
        parts = simhash.connected_components(simhash.set_links(reps, rows, 5, 0.8, 8, longest, longest))
        assert {i: i for i in texts} | {x["node"]: x["component"] for x in parts.collect()} == want


def test_texts_that_differ_stay_whatever_their_fingerprints(spark):
    a, b = "one two three four five", "six seven eight nine ten eleven"
    r = random.Random(13)
    base = [f"w{i}" for i in range(300)]
    below = [" ".join(edited(r, base, 9)) for _ in range(30)]
    pairs = {i: t for i, t in enumerate([" ".join(base), *below])}
    sets = {i: shingles(t) for i, t in pairs.items()}
    _, want = components(sets, 0.8)
    assert any(0.72 < jaccard(sets[0], sets[i]) < 0.8 for i in sets if i)
    kept = {x["doc_id"] for x in simhash.drop_near_copies(docs_of(spark, pairs.items())).collect()}
    assert kept == set(want.values())
    repeats = {0: " ".join([a] * 40), 1: " ".join([a] * 40 + [b])}  # one fingerprint by words repeated, 5 shingles of 11
    assert jaccard(*map(shingles, repeats.values())) < 0.8
    assert simhash.drop_near_copies(docs_of(spark, repeats.items())).count() == 2


def test_rows_with_null_and_repeated_ids_go_only_as_copies(spark):
    r = random.Random(14)
    t = [" ".join(f"w{r.randrange(9000)}" for _ in range(80)) for _ in range(6)]
    rows = [(None, t[0]), (None, t[1]), (None, t[1]), (7, t[2]), (7, t[3]), (9, t[3]), (3, t[4]), (None, t[4]), (8, t[4] + " tail"), (8, t[5])]
    want = sorted([(None, t[0]), (None, t[1]), (7, t[2]), (7, t[3]), (3, t[4]), (8, t[5])], key=str)
    for parts in (1, 5):
        out = simhash.drop_near_copies(docs_of(spark, rows).repartition(parts))
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert sorted(((x["doc_id"], x["text"]) for x in out.collect()), key=str) == want


def test_candidates_come_from_the_index_of_fingerprint_bytes(spark, monkeypatch):
    """Pairs within 3 of 64 bits are found by the byte index alone: they stay links where no shingle list yields any."""
    r = random.Random(5)
    texts = []
    for g in range(12):
        base = [f"w{r.randrange(10**6)}" for _ in range(1500)]
        texts += [base, edited(r, base, 1), edited(r, base, 1)]
    texts = dict(enumerate(" ".join(t) for t in texts))
    prints = {i: simhash.set_print(simhash.shingle_set(t))[:8] for i, t in texts.items()}
    apart = lambda a, b: (int.from_bytes(prints[a]) ^ int.from_bytes(prints[b])).bit_count()
    near = [(a, b) for a, b in combinations(sorted(texts), 2) if apart(a, b) <= 3]
    assert len(near) >= 12
    root = {i: i for i in texts}
    for _ in texts:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    reps = spark.createDataFrame([(i, b"size" + p + b"rest" * 14) for i, p in prints.items()], "node long, fp binary")
    got = {i: i for i in texts} | {x["node"]: x["component"] for x in simhash.connected_components(simhash.byte_links(reps)).collect()}
    assert got == root
    monkeypatch.setattr(simhash, "prefix_length", lambda n, similarity: 0)  # no set posts a shingle
    kept = {x["doc_id"] for x in simhash.drop_near_copies(docs_of(spark, texts.items())).collect()}
    assert kept == set(root.values())
