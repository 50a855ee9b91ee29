"""Ranked search, periodic runs and packing against brute force, enumeration and the public library."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.llm import lexical, packing, queries, runs

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, rank int, score string, runs string, ids string, item int, start long"


def _ranked(docs, items, k=10):
    bags = [(d, Counter(lexical.terms_of(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for d, b in bags:
            m = 25 + 75 * sum(b.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m)) for t in lexical.terms_of(text) if t in b)
            if s > 0:
                scores.append((-s, d is None, d if d is not None else 0, d))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def test_terms_are_runs_of_letters_and_digits():
    assert lexical.terms_of("Ab-c_9é\x00Ÿ Z²　Ärger'S") == [x.encode() for x in ("ab", "c", "9é", "Ÿ", "z²　Ärger", "s")]
    assert lexical.terms_of(None) == lexical.terms_of("") == lexical.terms_of(" .-") == []


def test_slices_add_like_numbers_and_give_the_best():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 40)
        sums, total = [0] * n, []
        for _ in range(rng.randint(1, 6)):
            places = sorted(rng.sample(range(n), rng.randint(1, n)))
            values = [rng.randint(1, rng.choice([3, 1 << 33])) for _ in places]
            rows = lexical.bit_slices(np.array(places), np.array(values, np.int64), -(-n // 8))
            slices, shift = [int.from_bytes(r.tobytes(), "little") for r in rows], rng.randint(0, 3)
            lexical.add_slices(total, slices, shift)
            for p, v in zip(places, values):
                sums[p] += v << shift
        assert [sum((s >> p & 1) << i for i, s in enumerate(total)) for p in range(n)] == sums
        k = rng.randint(1, 12)
        sure, tied = lexical.top_slices(total, k, n)
        got = lexical.places_of(sure)
        got += lexical.places_of(tied, k - len(got))
        assert sorted(got) == sorted(sorted((p for p in range(n) if sums[p]), key=lambda p: (-sums[p], p))[:k])


def test_search_equals_brute_force_on_nulls_ties_repeats_and_long_texts(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)] + ["É", "the", "The"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(120)]
    docs += [(7, "the w1 w2"), (7, "the w1 w2"), (None, "w3 w3 w4"), (None, None), (300, None), (301, ""), (302, " .-"), (303, "w5 " * 30_000), (304, "w6. W6"), (305, "w6, w6")]
    items = [(0, "w1 w1 w2 the"), (0, "w6"), (1, None), (2, ""), (3, "unseen"), (None, "w3 w4 w4 w4"), (4, "w5 É"), (5, " ".join(words))]
    frame = spark.createDataFrame([(d, t, 1, "x", "y", "z", 2, 3) for d, t in docs], ODD).repartition(5)
    asked = spark.createDataFrame([(i, t, 1, "x", 3) for i, t in items], "item_id long, text string, rank int, score string, doc_id long")
    for more in ({}, {"docs_per_block": 512, "most_items": 2, "most_terms": 3}):
        got = sorted((tuple(x) for x in lexical.ranked_search(frame, asked, **more).collect()), key=str)
        assert got == _ranked(docs, items)
    assert lexical.ranked_search(frame.limit(0), asked).count() == 0 and lexical.ranked_search(frame, asked.limit(0)).count() == 0
    assert lexical.ranked_search(frame.filter("doc_id in (301, 302)"), asked).count() == 0


def test_the_query_ranks_the_given_documents(spark):
    docs = [tuple(x) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(x) for x in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted((tuple(x) for x in queries.op11_search(spark, SF).collect()), key=str) == _ranked(docs, items)


def _runs(words, least=24, times=3):
    n, out = len(words), {}
    number = {}
    a = np.array([number.setdefault(w, len(number)) for w in words])
    for q in range(1, n // times + 1):
        same = np.diff(np.r_[0, a[:-q] == a[q:], 0].astype(int))
        for s, e in zip(np.flatnonzero(same == 1), np.flatnonzero(same == -1)):
            if e - s + q >= max(least, times * q):
                out.setdefault((int(s), int(e + q)), q)
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force_on_random_words():
    rng = random.Random(1)
    for _ in range(800):
        texts = []
        for _ in range(rng.randint(1, 6)):
            k, n = rng.choice([1, 2, 3, 6]), rng.choice([0, 1, 5, 24, 60, 120])
            w = [rng.randrange(k) for _ in range(n)]
            if rng.random() < 0.6 and n:
                unit = [rng.randrange(3) for _ in range(rng.randint(1, 12))]
                x = rng.randint(0, n)
                w = w[:x] + (unit * 30)[:rng.randint(1, 90)] + w[x:]
            texts.append(w)
        least, times = rng.choice([(24, 3), (4, 2), (10, 2), (6, 4), (2, 2)])
        found = runs.maximal_runs(np.array([c for w in texts for c in w], np.int64), np.array([len(w) for w in texts]), least, times)
        assert [found.get(i, []) for i in range(len(texts))] == [_runs(w, least, times) for w in texts]


def test_the_smaller_half_rule_bounds_what_is_listed():
    codes = np.random.default_rng(0).integers(0, 3, 4096)
    tree = runs.SuffixTree(codes, np.array([4096]), 1)
    rows = tree.nodes()
    assert ((rows[:, 2] - rows[:, 1]) - (rows[:, 4] - rows[:, 3])).sum() <= 4096 * 12  # n log2 n
    suffixes = sorted(range(4096), key=lambda i: codes[i:].tolist())
    assert tree.order.tolist() == suffixes
    with pytest.raises(ValueError):
        runs.find_runs(None, min_exponent=1)


def _digests(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = _runs(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], sha("".join("%d,%d,%d\n" % r for r in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_run_digests_of_the_given_documents(spark):
    docs = [tuple(x) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(x) for x in queries.op12_runs(spark, SF).collect())
    want = sorted(_digests(d, t) for d, t in docs)
    assert got == want and sum(x[1] > 0 for x in want) > 5


def test_runs_of_nulls_empty_long_and_repeated_texts(spark):
    texts = [None, "", " \t\n", "a " * 24, "a " * 23, "a\tb\n" * 20_000, "x y " * 12 + "z " + "p q r " * 9, "é ü " * 15, "a b c " * 8 + "a b"]
    rows = [(i, t) for i, t in enumerate(texts)] * 2 + [(None, "a " * 30), (None, "a " * 30), (11, "w%d " * 50 % tuple(range(50)))]
    frame = spark.createDataFrame([(d, t, 1, "x", "y", "z", 2, 3) for d, t in rows], ODD)
    planted = runs.plant_tails(frame)
    found = runs.find_runs(planted)
    assert set(found.columns) == set(frame.columns) | {"collapsed"} and found.count() == len(rows)
    got = sorted((tuple(x) for x in runs.run_digests(found).collect()), key=str)
    assert got == sorted((_digests(d, t) for d, t in rows), key=str)
    kept = {x["doc_id"]: x["collapsed"] for x in runs.find_runs(frame).collect() if x["doc_id"] is not None}
    assert kept[6] == "x y z p q r" and kept[5] == "a b" and kept[0] == kept[1] == kept[2] == ""
    assert runs.run_digests(runs.find_runs(frame.limit(0))).count() == 0


def _laid(tails, longest, slack):
    """Check that the plan covers every tail once without gaps; returns packs, padding."""
    plan, packs = packing.recipes(packing.top_up(packing.shortest_pack_first(tails, longest), longest, slack), longest)
    ranks, held = Counter(), {}
    for length, low, high, pieces in plan:
        end = 0
        for start, size, sequence, at in pieces:
            assert start == end and size > 0
            end += size
            for k in range(high - low):
                held.setdefault(sequence + k, []).append((at, size))
        assert end == length
        ranks[length] += high - low
    assert ranks == tails and sorted(held) == list(range(packs))
    padding = 0
    for parts in held.values():
        end = 0
        for at, size in sorted(parts):
            assert at == end
            end += size
        assert end <= longest
        padding += longest - end if end & (end - 1) else 0
    return packs, padding


def test_plans_cover_every_tail_once():
    rng = random.Random(3)
    for _ in range(600):
        longest = rng.choice([4, 16, 64])
        _laid({rng.randint(1, longest - 1): rng.randint(1, rng.choice([2, 30])) for _ in range(rng.randint(1, 20))}, longest, rng.choice([0, 1, 2]))
    for tails in ({700: 20_000}, {1500: 9999}, {length: 3 for length in range(1, 2048)}, {1100: 5000, 3: 7}):
        packs, padding = _laid(tails, 2048, 8)
        tokens = sum(a * n for a, n in tails.items())
        assert padding <= 0.005 * tokens and packs <= 1.01 * tokens / 2048 + 2
    whole = packing.shortest_pack_first({6: 2, 5: 1, 4: 2, 3: 2, 1: 1}, 10)  # 5+4 before 6+4, 6+3, then 3+1 into the shortest
    assert sorted(10 - p.room for p in whole for _ in range(p.packs)) == [4, 9, 9, 10]


def test_spans_are_coded_as_in_place():
    spec = packing.read_tokenizer(f"{queries.TOKENIZERS}/byte_bpe_50k.json")
    coder, rng = packing.SpanCoder(spec), random.Random(0)
    bits = [" ", "  ", "\n", "\t", "\r\n", "a", "B", "é", "1", "23", ",", ".", "'s", "don't", "<|endoftext|>", "\u00a0", "\u3000", "\x1c", "😀", "。", "\n\n", " \n", "   x", "_", "\u200b", "中文", "\x00", "x" * 40]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    want = [e.ids for e in coder.coder.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in coder.encode(texts)] == want
    packing_at = [x.tolist() for i in range(0, 4000, 7) for x in coder.encode(texts[i:i + 7])]
    assert packing_at == want
    coder.forget()
    assert [x.tolist() for t in texts[:50] for x in coder.encode([t])] == want[:50] and coder.encode([]) == []


def test_spans_of_many_texts_are_cut_together():
    """Cuts and single words against the library: letters that are not one word, marks, runs at the end of a text, names of special tokens."""
    import pyarrow as pa

    spec = packing.read_tokenizer(f"{queries.TOKENIZERS}/byte_bpe_50k.json")
    coder, rng = packing.SpanCoder(spec), random.Random(2)
    texts = ["".join(rng.choice("abcdeéñÿß÷×ªºµ AZ09  \t\n\r.,;!?日🙂İthe'sdmll_") for _ in range(rng.randrange(50))) for _ in range(4000)]
    texts += [None, "", " ", "a  ", "  ", "b", "\n", "l\u00e0,b", "\u00f7,b", "x<|endoftext|>y", "a\u00a0b", "\u3000", "it's,'s", "w" * 3000]
    want = [e.ids for e in coder.coder.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    whole = pa.array(["q", *texts])[1:]
    for _ in range(2):  # the second time all spans are known
        assert [x.tolist() for x in coder.encode(whole)] == want
    asked, once = [], coder.table.code
    coder.table.code = lambda spans: asked.extend(spans) or once(spans)
    coder.forget()
    words = [" ".join(f"{a}{b}" for b in "abcdefgh") for a in ("x", "\u00e9", "th")]
    assert [x.tolist() for x in coder.encode(words * 3)] == [e.ids for e in coder.coder.encode_batch(words * 3)]
    assert len(asked) == len(set(asked)) == len({s for w in words for s in re.findall(" ?[^ ]+", w)})
    coder.coder = None  # spans that are one word do not need the library's search for words
    coder.forget()
    assert [len(x) for x in coder.encode(words)] == [len(x) for x in coder.encode(words)] and sum(map(len, coder.encode(words))) > 0


def _check_pieces(rows, ids, longest):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for parts in by.values():
        end = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= longest
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append(r)
    for d, x in ids.items():
        end = 0
        for r in sorted(out[d], key=lambda r: r["start"]):
            assert r["start"] == end and r["doc_tokens"] == len(x) and r["ids_crc32"] == zlib.crc32(np.array(x[end:end + r["length"]], "<u4").tobytes())
            end += r["length"]
        assert end == len(x)
    assert out.keys() == ids.keys()
    return by


def _library(texts):
    from tokenizers import Tokenizer

    code = Tokenizer.from_file(f"{queries.TOKENIZERS}/byte_bpe_50k.json")
    return {d: code.encode(t or "", add_special_tokens=False).ids + [1] for d, t in texts}


def test_packing_of_the_given_documents(spark):
    docs = [tuple(x) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    by = _check_pieces(queries.op13_packing(spark, SF).collect(), _library(docs), 2048)
    used = [sum(r["length"] for r in x) for x in by.values()]
    assert sum(2048 - n for n in used if n & (n - 1)) <= 0.01 * sum(used)


def test_packing_of_nulls_repeats_ties_and_long_texts(spark):
    spec = packing.read_tokenizer(f"{queries.TOKENIZERS}/byte_bpe_50k.json")
    docs = [(0, None), (1, ""), (2, "one two three"), (3, "x y z " * 3000), (4, "<|endoftext|> é　\n\n"), *[(10 + i, "same words here") for i in range(40)], (60, "a" * 5000)]
    frame = spark.createDataFrame([(d, t, 1, "x", "y", "z", 2, 3) for d, t in docs], ODD).repartition(4)
    for longest in (2048, 16, 5):
        packed = packing.pack_documents(packing.token_ids(frame, spec, longest=longest), longest=longest)
        rows = packed.withColumn("ids_crc32", F.crc32("ids")).collect()
        by = _check_pieces(rows, _library(docs), longest)
        whole = {r["sequence_id"]: r for r in packing.padded_sequences(packed, longest=longest, pad_id=9).collect()}
        for q, parts in by.items():
            ids = b"".join(bytes(r["ids"]) for r in sorted(parts, key=lambda r: r["offset"]))
            n = len(ids) // 4
            assert whole[q]["n_tokens"] == n and bytes(whole[q]["ids"]) == ids + (b"" if n & (n - 1) == 0 else b"\x09\0\0\0" * (longest - n))
    twice = spark.createDataFrame([(5, "b c")] * 3 + [(None, "d e")] * 2, "doc_id long, text string")
    rows = packing.pack_documents(packing.token_ids(twice, spec)).collect()
    assert Counter(r["doc_id"] for r in rows) == {5: 3, None: 2} and len({(r["sequence_id"], r["offset"]) for r in rows}) == 5
    assert packing.pack_documents(packing.token_ids(frame.limit(0), spec)).count() == 0


def test_index_rows_stay_small_and_workers_give_memory_back(spark):
    docs = spark.range(0, 5000, 1, 1).selectExpr("id as doc_id", "concat('alpha beta', id % 7) as text")
    lexical.ranked_search(docs, spark.createDataFrame([(1, "alpha beta3")], "item_id long, text string"), k=3)
    assert spark.sparkContext.environment["ARROW_DEFAULT_MEMORY_POOL"] == "system"
    forward = lexical.stage_table(lexical.forward_rows(docs, [b"alpha"]))
    held = [len(x["docs"]) for x in lexical.impact_index(forward, lexical.statistics_of(forward, 1)).collect()]
    assert sum(held) == 5000 and max(held) <= 2048
