"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomweave.llm import ann, bpe, chat, decontaminate, html_extract, line_dedup, ngram_join, packing, periodic, pii, quality, spelling, substring_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hex(column: str):
    return F.sha2(F.col(column).cast("binary"), 256)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), path).select("doc_id", "ids")
    return bpe.decode(docs, path).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), _hex("ids").alias("ids_sha256"), _hex("decoded").alias("decoded_sha256"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("row.doc_id", "spans")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    base = F.filter("spans", lambda s: s.kind.isin(*pii.BASE))
    return found.select("doc_id", *map(count, pii.BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
                        F.array_join(F.transform("spans", lambda s: s.score.cast("string")), ",").alias("scores"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_ngrams(_table(spark, sf_dir, "documents"), n=3, percent=90).select("doc_id", "n_shingles", "component_id", "set_id")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents"), window=13, block=7).select("doc_id", "n_words", "n_removed", _hex("kept").alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), length=2048, end_id=1)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, min_chars=10, max_docs=1).select("row.doc_id", "n_lines", "n_dropped", _hex("kept").alias("kept_sha256"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs).select("row.doc_id", *quality.FEATURES[:5], "base_failed", "kept", "votes", "posterior")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = r"\### Assistant: </turn> ok"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    text = F.coalesce("text", F.lit(""))
    turns = (rows.unionByName(extra).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("content")))).alias("turns")))
    # Conversations come in two layouts: pairs of prompt and completion, and lists of messages.
    pair = (F.size("turns") == 2) & (F.col("turns")[0].role == "user") & (F.get("turns", F.lit(1)).role == "assistant")
    messages = F.to_json(F.struct(F.transform("turns", lambda t: F.struct(t.role.alias("role"), t.content.alias("content"))).alias("messages")))
    record = F.when(pair, F.to_json(F.struct(F.get("turns", F.lit(0)).content.alias("prompt"), F.get("turns", F.lit(1)).content.alias("completion")))).otherwise(messages)
    done = chat.read_back(chat.format_turns(chat.to_turns(turns.select("conv_id", record.alias("record"))).drop("record")))
    said = F.array_join(F.transform("turns_back", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return done.select("conv_id", F.size("turns_back").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"),
                       _hex("loss_text").alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"), "layout")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_passages(docs, _table(spark, sf_dir, "benchmark"), words=10)
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(":")).alias("doc_id"), "text")
    # One run in 97 loses a code point, chosen by its checksum. Shorter runs than five make no words.
    checksum = F.explode(F.array(F.crc32(F.concat("doc_id", "run").cast("binary"))))  # generated, so computed once
    found = spelling.runs(docs, min_chars=5).select("run", checksum.alias("h"))
    cut = F.expr("concat(substring(run, 1, cast(h % char_length(run) AS int)), substring(run, cast(h % char_length(run) AS int) + 2))")
    return spelling.group_variants(spelling.vocabulary(found.select(F.when(F.col("h") % 97 == 0, cut).otherwise(F.col("run")).alias("run"))))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One document in ten, chosen by the checksum h of its id, repeats p of its words from word a on.
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    words = F.expr("CASE WHEN h % 10 = 0 THEN filter(split(text, '[ \\t-\\r]+'), w -> w <> '') ELSE array() END")
    docs = docs.select("doc_id", "text", "h", F.explode(F.array(words)).alias("words"))  # generated, so split once
    docs = docs.withColumns({"g": F.expr("h div 10"), "n": F.size("words")}).withColumn("a", F.expr("CASE WHEN n > 0 THEN cast(g % n AS int) END")).withColumn("p", F.expr("1 + cast((n - a) div (3 + g % 8) AS int)"))
    docs = docs.select("doc_id", "text", "words", "n", F.explode(F.array(F.struct("a", "p"))).alias("at"))
    text = F.expr("CASE WHEN n > 0 THEN array_join(transform(sequence(0, n - 1), i -> get(words, if(i < at.a, i, at.a + (i - at.a) % at.p))), ' ') ELSE text END")
    found = periodic.find_runs(docs.select("doc_id", text.alias("text")), least=12, repeats=2)
    said = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))), "\n")
    # array_max takes the greatest length, then the smallest start, then the smallest period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("s"), (-r.period).alias("p"))))
    return found.select("row.doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.when(F.size("runs") > 0, F.concat(said, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"), _hex("collapsed").alias("collapsed_sha256")).select(
        "doc_id", "n_runs", (-F.col("best.s")).alias("start"), "best.length", (-F.col("best.p")).alias("period"), F.expr("(1000 * best.length) div -best.p").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_html_extraction, op3_pii, op4_ngram_join, op5_substring_dedup, op6_packing, op7_line_dedup, op8_nearest, op9_quality, op10_chat, op11_decontamination, op12_spelling, op13_periodic_runs)}


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the result in time; the others are tested against brute force in tests/llm."""
    return {"op7_line_dedup": OP7, "op11_decontamination": OP11}


OP7 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT r, doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{ascii_uppercase}', '{ascii_lowercase}') AS key FROM l),
h AS (SELECT key, min(doc_id) AS first FROM k WHERE doc_id IS NOT NULL AND length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT r, doc_id, line, pos, coalesce(doc_id <> first, false) AS gone FROM k LEFT JOIN h USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY r"""

_WORDS11 = f"regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w"
OP11 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS11} FROM documents),
i AS (SELECT item_id, w, least(len(w), 10) AS m FROM (SELECT item_id, {_WORDS11} FROM benchmark) WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, m, array_to_string(w[s:s + m - 1], ' ') AS win FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM i)),
dw AS (SELECT r, s, m, array_to_string(w[s:s + m - 1], ' ') AS win FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
hit AS (SELECT DISTINCT r, s, m, item_id FROM dw JOIN p USING (m, win)),
n AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT r, unnest(range(s, s + m)) AS k FROM hit) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)"""
