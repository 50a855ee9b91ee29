"""The registered queries of the training-data operators, with production parameters, and their SQL where there is any."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import ann, chat, embedding_dedup, lexical, line_dedup, mixing, packing, pieces, runs, secrets, simhash, token_counts, toxicity
from tidepool.llm._common import held_out, load, shared_dir, stage_table

#: Folder of public vocabulary files.
TOKENIZERS = os.environ.get("TIDEPOOL_TOKENIZERS", "/opt/tokenizers")

BOILERPLATE = 0.02
LEAST_PAGES = 3


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(load(spark, sf_dir, "documents"), weights=(5, 2, 1), max_repeat=3.0, share=1.0)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = toxicity.train_toxicity(docs, load(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("spans").cast("long").alias("n_spans"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches: all documents; exact copies out again, but for the copy with the smallest id (null ids last,
    then source and language); originals of another language than English (null included) counted anew with the vocabulary for
    many languages; the second batch once more, which changes nothing. Null and empty texts count as copies of their like. The
    rollup's folder is named by the table's content, so a rerun over it commits nothing anew."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), F.col("text").isNull().alias("none"), "text")
    first, second = (token_counts.read_ranks(f"{TOKENIZERS}/{v}.tiktoken") for v in ("byte_bpe_50k", "byte_bpe_multi_50k"))
    other = ~F.col("lang").eqNullSafe("en")
    both = docs.withColumn("again", F.when(other, F.col("text")))
    once = token_counts.count_tokens(both, first, into="n_tokens")
    counts = stage_table(token_counts.count_tokens(once, second, text="again", into="n_again").withColumn("row", F.monotonically_increasing_id()))
    pick = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col("source").isNull().alias("no_source"), "source", F.col("lang").isNull().alias("no_lang"), "lang", "n_tokens", "n_again", "row"))
    originals = stage_table(counts.groupBy("h1", "h2", "none").agg(pick.alias("x")).select("x.*"))
    copies = counts.join(originals.select("row"), "row", "left_anti")
    old, new = (token_counts.versioned(originals.filter(other).withColumn("n_tokens", F.col(n)), v) for n, v in (("n_tokens", "byte_bpe_50k"), ("n_again", "byte_bpe_multi_50k")))
    mark = counts.agg(F.count("*"), F.sum(F.xxhash64("doc_id", "source", "lang", "h1", "h2", "none").cast("decimal(38,0)"))).first()
    rollup = token_counts.Rollup(spark, f"{shared_dir(spark)}/rollup-{mark[0]}-{mark[1] or 0}".replace("--", "-m"))
    gone = token_counts.deletes(token_counts.versioned(copies, "byte_bpe_50k"))
    rollup.commit("load", token_counts.inserts(token_counts.versioned(counts, "byte_bpe_50k")))
    rollup.commit("copies", gone)
    rollup.commit("recount", token_counts.revisions(old, new))
    rollup.commit("copies", gone)
    return rollup.totals()


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = simhash.simhash_components(load(spark, sf_dir, "documents"), shingle=3, max_diff=3)
    return parts.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    kept = line_dedup.drop_boilerplate(docs, host=F.col("source"), ratio=BOILERPLATE, min_pages=LEAST_PAGES, dropped="n_dropped")
    return kept.select("doc_id", "text", "n_dropped")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return chat.chat_digests(chat.format_chats(turns.union(extra)))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.read_model(f"{TOKENIZERS}/piece_bpe_32k.model")
    return pieces.piece_digests(pieces.recode_documents(load(spark, sf_dir, "documents").select("doc_id", "text"), model))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_components(load(spark, sf_dir, "embeddings"), cosine=0.9)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(load(spark, sf_dir, "documents"))
    base = [r.kind for r in secrets.RULES if r.base]
    of = lambda *kinds: F.filter("spans", lambda x: x["kind"].isin(*kinds))
    return found.select("doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in base],
                        F.sha2(_joined(of(*base)), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(load(spark, sf_dir, "embeddings"), every=50, k=5)


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), k=10)


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runs.plant_tails(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return runs.run_digests(runs.find_runs(docs, min_length=24, min_exponent=3).drop("text"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts are empty documents, one id long. The digest of a piece is that of its ids as they lie in the output."""
    coded = packing.token_ids(load(spark, sf_dir, "documents"), packing.read_tokenizer(f"{TOKENIZERS}/byte_bpe_50k.json"), end_id=1)
    packed = packing.pack_documents(coded, longest=2048)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_mixing, op2_toxicity, op3_token_counts, op4_simhash, op5_line_dedup, op6_chat, op7_pieces, op8_embedding_dedup, op9_secrets, op10_ann, op11_search, op12_runs, op13_packing, pipeline)
    return {f.__name__: f for f in ops}


_TRIM = "' ' || chr(9) || chr(13) || chr(11) || chr(12)"

_LINE_SQL = f"""
WITH pages AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
own AS (SELECT DISTINCT source, text FROM documents),
held AS (SELECT source, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: trim(x, {_TRIM})))) AS line FROM own),
hosts AS (SELECT source, count(*) AS t FROM own GROUP BY source),
bad AS (SELECT s.source, list(s.line) AS bl FROM (SELECT source, line, count(*) AS n FROM held WHERE line <> '' GROUP BY source, line) s
        JOIN hosts h ON s.source IS NOT DISTINCT FROM h.source WHERE n >= {LEAST_PAGES} AND n > t * {BOILERPLATE} GROUP BY s.source),
kept AS (SELECT doc_id, p.text, ls, CASE WHEN bl IS NULL THEN ls ELSE list_filter(ls, lambda x: NOT list_contains(bl, trim(x, {_TRIM}))) END AS ks
         FROM pages p LEFT JOIN bad b ON p.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CASE WHEN len(ks) < len(ls) THEN array_to_string(ks, chr(10)) ELSE text END AS text,
       CAST(coalesce(len(ls) - len(ks), 0) AS BIGINT) AS n_dropped FROM kept"""

_TAILS = r"\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>"

_CHAT_SQL = rf"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
laid AS (SELECT *, 24 + length(role) + length(regexp_replace(text, '([<\[])(\\*)({_TAILS})', '\1\\\2\3', 'g')) AS chars FROM turns)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM laid GROUP BY conv_id"""


_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_LEXICAL_SQL = rf"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERMS}')) AS term FROM documents),
asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERMS}')) AS term FROM benchmark),
wants AS (SELECT item_id, term, CAST(count(*) AS BIGINT) AS times FROM asked GROUP BY item_id, term),
sizes AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM words GROUP BY doc_id),
whole AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(n) AS BIGINT) AS l FROM sizes),
held AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM words WHERE term IN (SELECT term FROM wants) GROUP BY doc_id, term),
spread AS (SELECT term, CAST(count(*) AS BIGINT) AS df FROM held GROUP BY term),
impact AS (SELECT h.doc_id, h.term, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT)
                  * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // l))) AS v
           FROM held h JOIN spread s ON h.term = s.term JOIN sizes z ON h.doc_id = z.doc_id CROSS JOIN whole),
sums AS (SELECT item_id, doc_id, CAST(sum(times * v) AS BIGINT) AS score FROM wants w JOIN impact i ON w.term = i.term GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM sums WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": _LINE_SQL, "op6_chat": _CHAT_SQL, "op11_search": _LEXICAL_SQL}
