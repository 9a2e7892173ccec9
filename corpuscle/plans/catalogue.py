"""The engine's queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import folds, text, timing
from corpuscle.operators import evaluate, files, media, models, optimize, search, speech
from corpuscle.session import new_path

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- text

_HTML = "html"
for _p, _o in ((r"<!--.*?-->", "gs"), (r"<!doctype[^>]*>", "gi"), (r"<script\b.*?</script\s*>", "gis"), (r"<style\b.*?</style\s*>", "gis"), (r"<[^>]*>", "gs")):
    _HTML = f"regexp_replace({_HTML}, '{_p}', ' ', '{_o}')"
for _n, _c in text.ENTITIES:
    _HTML = f"regexp_replace({_HTML}, '&{_n};?', '{_c}', 'g')"
_WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"
_SENTENCES = r"list_filter(string_split(regexp_replace(trim(regexp_replace({0}, '\s+', ' ', 'g')), '([" + text.ENDS + r"])\s+', concat('\1', chr(1)), 'g'), chr(1)), lambda s: s <> '')"
_WORD_CLASS = r"[\p{L}\p{N}_\x{00C0}-\x{1EF9}]+"


@query(rf"SELECT page_id, trim(regexp_replace({_HTML}, '\s+', ' ', 'g')) AS text FROM pages")
def html_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without markup."""
    return table(spark, sf_dir, "pages").select("page_id", text.clean_html(F.col("html")).alias("text"))


@query(f"SELECT doc_id, CAST(len({_WORDS.format('text')}) AS BIGINT) AS n_tokens, md5(array_to_string({_WORDS.format('text')}, '|')) AS tokens_md5 FROM documents")
def whitespace_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words between white space."""
    t = text.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, "|").cast("binary")).alias("tokens_md5"))


@query(f"SELECT conv_id, turn, regexp_extract_all(text, '{_WORD_CLASS}') AS words FROM conversations")
def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of letters, numbers and underlines."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.words(F.col("text")).alias("words"))


@query(f"SELECT doc_id, CAST(i AS BIGINT) AS idx, s AS sentence FROM (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) - 1 AS i FROM (SELECT doc_id, {_SENTENCES.format('text')} AS s FROM documents))")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each document."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("idx", "sentence"))
    return rows.select("doc_id", F.col("idx").cast("long"), "sentence")


def _jump_sql(items: str, first: int, later: int) -> str:
    """A recursive query that jumps a chunk a step over the running sums of lengths."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {items} AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
c AS (SELECT doc_id, i, word, CAST(sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS c FROM u),
l AS (SELECT doc_id, list(c ORDER BY i) AS cl, list(word ORDER BY i) AS wl, count(*) AS n FROM c GROUP BY doc_id),
r AS (
  SELECT doc_id, 0 AS k, CAST(1 AS BIGINT) AS s, CAST(len(list_filter(cl, lambda x: x <= {first})) + 1 AS BIGINT) AS e FROM l
  UNION ALL
  SELECT r.doc_id, k + 1, r.e, CAST(greatest(r.e + 1, len(list_filter(cl, lambda x: x - (CASE WHEN r.e = 1 THEN 0 ELSE cl[r.e - 1] END) <= {later})) + 1) AS BIGINT)
  FROM r JOIN l ON r.doc_id = l.doc_id WHERE r.e <= n)
SELECT r.doc_id, CAST(k AS BIGINT) AS idx, coalesce(CASE WHEN e > s THEN array_to_string(wl[s:e - 1], ' ') END, '') AS text FROM r JOIN l ON r.doc_id = l.doc_id"""


@query(_jump_sql(_WORDS.format("text"), 800, 801))
def chunk_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of whole words, at most 800 characters."""
    return _chunks(table(spark, sf_dir, "documents"))


def _chunks(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.posexplode(folds.pack_words(F.col("text"), 800)).alias("idx", "text"))
    return rows.select("doc_id", F.col("idx").cast("long"), "text")


_PACKED = _jump_sql(_SENTENCES.format("text"), 1201, 1201).replace("len(list_filter(cl, lambda x: x <= 1201)) + 1 AS BIGINT", "greatest(2, len(list_filter(cl, lambda x: x <= 1201)) + 1) AS BIGINT")


@query(_PACKED)
def sentence_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole sentences in pieces of at most 1200 characters."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(folds.pack_sentences(F.col("text"), 1200)).alias("idx", "text"))
    return rows.select("doc_id", F.col("idx").cast("long"), "text")


# --- retrieval

_BM25 = f"""
corpus AS (SELECT doc_id AS pos, text, CAST(len({_WORDS.format('text')}) AS BIGINT) AS length FROM documents),
words AS (SELECT pos, unnest({_WORDS.format('text')}) AS term FROM corpus),
postings AS (SELECT term, pos, count(*) AS tf FROM words GROUP BY term, pos),
raw AS (SELECT term, count(*) AS df, ln((SELECT count(*) FROM corpus) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM postings GROUP BY term),
terms AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""


def _topk_sql(k: int) -> str:
    return f"""
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_WORDS.format('query')}) AS term FROM q) GROUP BY query_id, term),
scores AS (SELECT query_id, postings.pos AS pos, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / (SELECT avg(length) FROM corpus)))), 6) AS score
  FROM asked JOIN terms USING (term) JOIN postings USING (term) JOIN corpus ON corpus.pos = postings.pos GROUP BY query_id, postings.pos),
filled AS (SELECT q.query_id, corpus.pos AS pos, coalesce(score, 0.0) AS score FROM q CROSS JOIN corpus LEFT JOIN scores ON scores.query_id = q.query_id AND scores.pos = corpus.pos),
lexical AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS INTEGER) AS rank FROM filled) WHERE rank <= {k})"""


def _stored(spark: SparkSession, index: search.Index) -> search.Index:
    """The index, written to the shared folder once, as several parts of a query read it."""
    path = new_path(spark, "index")
    index.save(path)
    return search.Index.load(spark, path, index.vectors is not None)


def _index(spark: SparkSession, sf_dir: str, vectors: DataFrame | None = None) -> search.Index:
    return search.build(table(spark, sf_dir, "documents"), "doc_id", "text", vectors)


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query(f"WITH {_BM25} SELECT term, df, round(idf, 6) AS idf FROM terms")
def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency and weight of each term."""
    return _index(spark, sf_dir).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_BM25}, q AS (SELECT item_id AS query_id, text AS query FROM benchmark), {_topk_sql(25)} SELECT query_id, rank, pos, score FROM lexical")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 best documents of each benchmark item."""
    return search.bm25_topk(_stored(spark, _index(spark, sf_dir)), _questions(spark, sf_dir), 25)


_UNIT = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
_DENSE = f"""
v AS (SELECT vec_id AS pos, list_transform({_UNIT}, lambda x: x / sqrt(list_inner_product({_UNIT}, {_UNIT}))) AS v FROM embeddings),
dense_all AS (SELECT a.pos AS query_id, b.pos AS pos, round(list_inner_product(a.v, b.v), 6) AS score FROM v a JOIN v b ON a.pos % 100 = 0),
dense AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS INTEGER) AS rank FROM dense_all) WHERE rank <= 25)"""


@query(f"WITH {_DENSE} SELECT query_id, rank, pos, score FROM dense")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 nearest vectors of every hundredth vector."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), "embedding")
    index = _index(spark, sf_dir, vectors)
    asked = vectors.where(F.col("pos") % 100 == 0).withColumnRenamed("pos", "query_id")
    return search.dense_topk(index, asked, 25)


_HYBRID = f"""{_BM25.replace('FROM documents)', 'FROM documents JOIN embeddings ON doc_id = vec_id)', 1)},
q AS (SELECT vec_id AS query_id, text AS query FROM documents JOIN embeddings ON doc_id = vec_id WHERE vec_id % 100 = 0), {_topk_sql(25)}, {_DENSE.replace('FROM embeddings)', 'FROM embeddings JOIN documents ON doc_id = vec_id)')},
both_lists AS (SELECT query_id, pos FROM lexical UNION SELECT query_id, pos FROM dense),
fused AS (SELECT b.query_id, b.pos, round(coalesce(s.score, 0) + coalesce(d.score, 0), 6) AS score
  FROM both_lists b LEFT JOIN scores s ON s.query_id = b.query_id AND s.pos = b.pos LEFT JOIN dense d ON d.query_id = b.query_id AND d.pos = b.pos),
hits AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS INTEGER) AS rank FROM fused) WHERE rank <= 5)"""


def _kept(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back, as several parts of a query read it."""
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _likely_in(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """df without nearly all rows whose key is not among those of keys, and with all others, before a join shuffles it.

    Bitmaps of the hashed keys, two bytes for each key, are broadcast; of the rows without a partner 6 in 100 stay.
    """
    buckets = keys.count() // 2048 + 1
    place = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets << 15))
    bit = F.col("_place").bitwiseAND(F.lit((1 << 15) - 1))
    placed = lambda x: x.withColumn("_place", place).withColumn("_bucket", F.shiftright("_place", 15))
    bitmaps = placed(keys.select(key)).repartition("_bucket").groupBy("_bucket").agg(F.bitmap_construct_agg(bit).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = placed(df).join(F.broadcast(bitmaps), "_bucket").where(F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1)
    return met.select(*df.columns)


def _met(spark: SparkSession, df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """df as its join with keys gives it, each row once for each equal key, without a shuffle of df.

    The keys, eight bytes each, are broadcast in short lists by their hash.
    """
    lists = keys.count() // 64 + 1
    place = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(lists))
    listed = keys.where(F.col(key).isNotNull()).groupBy(place.alias("_list")).agg(F.collect_list(key).alias("_keys"))
    listed = _kept(spark, listed, "keys")
    found = df.withColumn("_list", place).join(F.broadcast(listed), "_list").where(F.array_contains("_keys", F.col(key)))
    return found.withColumn("_each", F.explode(F.filter("_keys", lambda x: x == F.col(key)))).select(*df.columns)


def _hybrid(spark: SparkSession, sf_dir: str) -> tuple[search.Index, DataFrame]:
    """Documents that have a vector of the same number; every hundredth asks with its text and vector.

    Texts are read where they lie and neither shuffled nor stored, but for those that ask.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = _kept(spark, docs.join(vectors, "doc_id").where(F.col("doc_id") % 100 == 0), "asked")
    known = _kept(spark, _likely_in(docs.select("doc_id"), "doc_id", vectors).join(vectors, "doc_id"), "vectors")
    index = search.build(_met(spark, docs, "doc_id", vectors.select("doc_id")), "doc_id", "text", known.withColumnRenamed("doc_id", "pos"))
    index.terms = _kept(spark, index.terms, "terms")
    return index, asked.select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"), "embedding")


@query(f"WITH {_HYBRID} SELECT query_id, rank, pos, score FROM hits")
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best by lexical and dense score together."""
    return search.hybrid_topk(*_hybrid(spark, sf_dir), 5)


_RERANKED = f"""{_HYBRID},
sets AS (SELECT h.query_id, h.pos, h.rank AS before, q.query, c.text, list_distinct({_WORDS.format('q.query')}) AS a, list_distinct({_WORDS.format('c.text')}) AS b
  FROM hits h JOIN q ON q.query_id = h.query_id JOIN corpus c ON c.pos = h.pos),
judged AS (SELECT query_id, query, pos, text, before, round(CASE WHEN len(a) + len(b) > 0 THEN len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) ELSE 0 END, 6) AS score FROM sets),
reranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS INTEGER) AS rank FROM judged)"""


def _reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, asked = _hybrid(spark, sf_dir)
    return search.rerank(search.with_texts(index, asked, search.hybrid_topk(index, asked, 5)), 5)


@query(f"WITH {_RERANKED} SELECT query_id, rank, pos, score FROM reranked")
def rerank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in the order of a stand-in reranker."""
    return _reranked(spark, sf_dir).select("query_id", "rank", "pos", "score")


_PROMPT = f"""{_RERANKED},
prompted AS (SELECT query_id, 'Answer the question using the sources and cite like [1], [2].' || chr(10) || chr(10) || 'Question: ' || query || chr(10) || chr(10) || 'Sources:' || chr(10)
  || string_agg('[' || rank || '] ' || text, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Answer:' AS prompt,
  string_agg(CAST(pos AS VARCHAR), ',' ORDER BY rank) AS cites, arg_min(text, rank) AS first FROM reranked GROUP BY query_id, query)"""


@query(f"WITH {_PROMPT} SELECT query_id, prompt, cites FROM prompted")
def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with numbered sources."""
    made = search.prompts(_reranked(spark, sf_dir))
    return made.select("query_id", "prompt", F.array_join(F.transform("contexts", lambda c: c["id"]), ",").alias("cites"))


@query(
    rf"""WITH {_PROMPT}, said AS (SELECT query_id, cites, prompt || ' ' || array_to_string(list_slice({_WORDS.format('first')}, 1, 400), ' ') || ' [1]' AS said FROM prompted)
SELECT query_id, regexp_replace(split_part(said, 'Answer:', -1), '^\s+|\s+$', '', 'g') AS answer, cites FROM said"""
)
def ask_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a stand-in generator over retrieved, reranked sources."""
    made = search.ask(*_hybrid(spark, sf_dir), k=5)
    return made.select("query_id", "answer", F.array_join(F.transform("contexts", lambda c: c["id"]), ",").alias("cites"))


@query(r"SELECT conv_id, turn, regexp_replace(split_part('Question: x Answer: ' || text, 'Answer:', -1), '^\s+|\s+$', '', 'g') AS answer FROM conversations")
def answer_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows the last marker of an answer."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.answer(F.concat(F.lit("Question: x Answer: "), "text")).alias("answer"))


# --- speech

_VOCAB = r"""
chars AS (SELECT DISTINCT unnest(list_distinct(string_split(lower(text), ''))) AS token FROM documents),
vocab AS (SELECT token, row_number() OVER (ORDER BY encode(token)) + 1 AS token_id FROM chars WHERE token NOT IN (chr(10), chr(13), chr(9), '')
  UNION ALL VALUES ('<blank>', 0), ('<unk>', 1))"""
_ENCODED = rf"""{_VOCAB},
m AS (SELECT map(list(token), list(token_id)) AS m FROM vocab),
encoded AS (SELECT doc_id, CASE WHEN t = '' THEN [] ELSE list_transform(string_split(t, ''), lambda c: coalesce(m[c], 1)) END AS ids
  FROM (SELECT doc_id, regexp_replace(lower(text), '^\s+|\s+$', '', 'g') AS t FROM documents), m)"""


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return speech.encode(docs, speech.vocabulary(docs, "text"), "text").select("doc_id", "ids")


@query(f"WITH {_VOCAB} SELECT token, CAST(token_id AS BIGINT) AS token_id FROM vocab")
def char_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Special tokens and the characters of all documents."""
    return speech.vocabulary(table(spark, sf_dir, "documents"), "text")


@query(f"WITH {_ENCODED} SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_ids, md5(array_to_string(ids, ',')) AS ids_md5 FROM encoded")
def encode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character ids of each document."""
    joined = F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")
    return _encoded(spark, sf_dir).select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.md5(joined.cast("binary")).alias("ids_md5"))


@query(
    f"""WITH {_ENCODED}, b AS (SELECT *, doc_id // 4 AS batch, max(len(ids)) OVER (PARTITION BY doc_id // 4) AS longest FROM encoded)
SELECT doc_id, CAST(batch AS BIGINT) AS batch, CAST(len(ids) AS BIGINT) AS length, CAST(longest AS BIGINT) AS padded_length, md5(array_to_string(list_resize(ids, longest, 0), ',')) AS padded_md5 FROM b"""
)
def pad_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of four encoded documents, padded with zeros."""
    joined = F.array_join(F.transform("padded", lambda x: x.cast("string")), ",")
    return speech.pad_batches(_encoded(spark, sf_dir), "ids", "doc_id").select("doc_id", "batch", "length", F.size("padded").cast("long").alias("padded_length"), F.md5(joined.cast("binary")).alias("padded_md5"))


@query(
    f"""WITH {_VOCAB}, best AS (SELECT label, vec_id, list_position(embedding, list_max(embedding)) - 1 AS i FROM embeddings),
prev AS (SELECT *, lag(i) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM best)
SELECT label, coalesce(string_agg(coalesce(token, ''), '' ORDER BY vec_id) FILTER (WHERE i <> 0 AND i IS DISTINCT FROM before), '') AS text FROM prev LEFT JOIN vocab ON token_id = i GROUP BY label"""
)
def ctc_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy decoding, with vectors as frames and labels as utterances."""
    vocab = speech.vocabulary(table(spark, sf_dir, "documents"), "text")
    return speech.ctc_decode(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", vocab)


@query(
    r"""SELECT conv_id, regexp_replace(string_agg(regexp_replace(text, '^\s+|\s+$', '', 'g'), ' ' ORDER BY turn), '^\s+|\s+$', '', 'g') AS stripped,
regexp_replace(string_agg(text, '' ORDER BY turn), '^\s+|\s+$', '', 'g') AS plain, regexp_replace(string_agg(text, ' ' ORDER BY turn), '^\s+|\s+$', '', 'g') AS spaced,
string_agg(text, chr(10) ORDER BY turn) AS lines FROM conversations GROUP BY conv_id"""
)
def segments_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as segments, joined in the four ways that services do."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").alias("start"), "text"))).alias("s"))
    s = F.col("s")
    return rows.select("conv_id", timing.join_stripped(s).alias("stripped"), timing.join_plain(s).alias("plain"), timing.join_spaced(s).alias("spaced"), F.array_join(F.transform(s, lambda x: x["text"]), "\n").alias("lines"))


def _srt_sql(t: str) -> str:
    ms = f"CAST(round_even(greatest({t}, 0) * 1000, 0) AS BIGINT)"
    return f"printf('%02d:%02d:%02d,%03d', {ms} // 3600000, ({ms} // 60000) % 60, ({ms} // 1000) % 60, {ms} % 1000)"


@query(
    f"""WITH pieces AS ({_PACKED.replace('WITH RECURSIVE', 'WITH RECURSIVE', 1)}),
n AS (SELECT doc_id, count(*) AS total FROM pieces GROUP BY doc_id),
t AS (SELECT p.*, CAST(n_chars AS DOUBLE) / 15 AS total, length(p.text) AS len, sum(length(p.text)) OVER (PARTITION BY p.doc_id) AS whole,
  coalesce(sum(length(p.text)) OVER (PARTITION BY p.doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pieces p JOIN documents d ON d.doc_id = p.doc_id),
s AS (SELECT doc_id, idx, text, CASE WHEN whole > 0 THEN total * CAST(before AS DOUBLE) / whole ELSE 0 END AS b, CASE WHEN whole > 0 THEN total * CAST(before + len AS DOUBLE) / whole ELSE 0 END AS e FROM t)
SELECT doc_id, idx + 1 AS cue, {_srt_sql('b')} AS begins, {_srt_sql('e')} AS ends, text FROM s"""
)
def srt_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtitle cues of sentence pieces, with a document's time shared out by length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("n_chars").cast("double") / 15).alias("total"))
    rows = docs.select("doc_id", "total", F.posexplode(folds.pack_sentences(F.col("text"), 1200)).alias("idx", "text")).withColumn("len", F.length("text"))
    made = speech.timeline(rows, "doc_id", "idx", "len", "total")
    return made.select("doc_id", (F.col("idx") + 1).cast("long").alias("cue"), timing.srt_time(F.col("start")).alias("begins"), timing.srt_time(F.col("end")).alias("ends"), "text")


@query(
    rf"""WITH c AS (SELECT conv_id, turn, text, CASE WHEN turn % 3 = 2 THEN 'soon' ELSE CAST(turn AS VARCHAR) END AS b, CAST(turn + 1 AS VARCHAR) AS e FROM conversations),
x AS (SELECT *, TRY_CAST(b AS DOUBLE) AS bd, TRY_CAST(e AS DOUBLE) AS ed, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM c),
y AS (SELECT *, CASE WHEN bd IS NULL OR ed IS NULL THEN 0 ELSE bd END AS bs, CASE WHEN bd IS NULL OR ed IS NULL THEN 0 ELSE ed END AS es FROM x)
SELECT conv_id, string_agg(i || chr(10) || {_srt_sql('bs')} || ' --> ' || {_srt_sql('es')} || chr(10) || text || chr(10) || chr(10), '' ORDER BY i) AS srt FROM y GROUP BY conv_id"""
)
def srt_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtitles of alignment JSON made from turns; every third begin is no number."""
    begin = F.when(F.col("turn") % 3 == 2, "soon").otherwise(F.col("turn").cast("string"))
    one = F.struct(begin.alias("begin"), (F.col("turn") + 1).cast("string").alias("end"), F.array("text").alias("lines"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", one.alias("f")))).alias("x"))
    parsed = rows.select("conv_id", timing.fragments(F.to_json(F.struct(F.transform("x", lambda t: t["f"]).alias("fragments")))).alias("f"))
    return parsed.select("conv_id", F.array_join(F.transform("f", lambda f, i: timing.cue(i + 1, f["start"], f["end"], f["text"])), "").alias("srt"))


@query(
    r"""WITH r AS (SELECT conv_id, turn, text, max(CAST(contains(lower(text), 'the') AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY turn) AS began FROM conversations WHERE text <> ''),
s AS (SELECT *, coalesce(sum(CAST(contains(lower(text), 'and') AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over_ FROM r WHERE began = 1)
SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM s WHERE over_ = 0 GROUP BY conv_id"""
)
def chapter_range_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns from the first that holds one marker through the first that holds another."""
    return speech.chapter_items(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", "the", "and")


@query(
    r"""WITH a AS (SELECT doc_id, text, greatest(strpos(lower(text), 'the'), 1) AS b FROM documents),
c AS (SELECT *, strpos(substring(lower(text), b), 'and') AS f FROM a)
SELECT doc_id, CASE WHEN f > 0 THEN substring(text, b, f - 1 + 3) ELSE substring(text, b) END AS text FROM c"""
)
def chapter_range_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document from one marker through the next other one."""
    return table(spark, sf_dir, "documents").select("doc_id", speech.chapter_text(F.col("text"), "the", "and").alias("text"))


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 5")
def first_n_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five turns of each conversation."""
    return media.first_n(table(spark, sf_dir, "conversations"), "conv_id", "turn", 5).select("conv_id", "turn", "role", "text")


# --- media and files

# Extensions of every kind, so that each branch has rows.
_EXTENSIONS = ["wav", "MP3", "png", "JPEG", "txt", "webm", "tiff", ""]
_NAME = "concat('f', page_id, CASE WHEN e = '' THEN '' ELSE '.' || e END)"
_NAMED = f"SELECT page_id, {_NAME} AS name, CASE page_id % 3 WHEN 0 THEN 'audio' WHEN 1 THEN NULL ELSE 'other' END AS mode, CASE page_id % 5 WHEN 0 THEN 'image/png' WHEN 1 THEN 'audio/wav' ELSE 'text/html' END AS mime FROM (SELECT page_id, ({_EXTENSIONS})[page_id % 8 + 1] AS e FROM pages)"
_KIND = f"CASE WHEN lower(split_part(name, '.', 2)) IN ({', '.join(repr(x) for x in media.AUDIO)}) THEN 'audio' WHEN lower(split_part(name, '.', 2)) IN ({', '.join(repr(x) for x in media.IMAGE)}) THEN 'image' ELSE '' END"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, _EXTENSIONS)), (F.col("page_id") % 8 + 1).cast("int"))
    name = F.concat(F.lit("f"), F.col("page_id").cast("string"), F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext)))
    mode = F.when(F.col("page_id") % 3 == 0, "audio").when(F.col("page_id") % 3 == 2, "other")
    mime = F.when(F.col("page_id") % 5 == 0, "image/png").when(F.col("page_id") % 5 == 1, "audio/wav").otherwise("text/html")
    return table(spark, sf_dir, "pages").select("page_id", name.alias("name"), mode.alias("mode"), mime.alias("mime"))


@query(f"SELECT page_id, {_KIND} AS kind FROM ({_NAMED})")
def sniff_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of file names."""
    return _named(spark, sf_dir).select("page_id", media.sniff_kind(F.col("name")).alias("kind"))


@query(f"SELECT page_id, CASE WHEN mode = 'audio' THEN 'audio' WHEN {_KIND} <> '' THEN {_KIND} WHEN mime LIKE 'audio/%' THEN 'audio' WHEN mime LIKE 'image/%' THEN 'image' END AS kind FROM ({_NAMED})")
def kind_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds by mode, name and MIME type; null where the upload is refused."""
    return _named(spark, sf_dir).select("page_id", media.resolve_kind(F.col("mode"), F.col("name"), F.col("mime")).alias("kind"))


@query("SELECT doc_id, doc_id % 2 = 0 AS is_binary FROM documents")
def binary_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, of which every second has a NUL put before it."""
    content = F.concat(F.when(F.col("doc_id") % 2 == 0, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit(""))), F.col("text").cast("binary"))
    return table(spark, sf_dir, "documents").select("doc_id", files.probably_binary(content).alias("is_binary"))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files of one root for each thousand of them, in folders by the last digit and the one before."""
    p = F.col("page_id")
    path = F.concat(F.lit("d"), (p % 10).cast("string"), F.lit("/e"), (F.floor(p / 10) % 10).cast("string"), F.lit("/f"), F.lpad(p.cast("string"), 9, "0"), F.when(p % 7 == 0, ".bin").otherwise(".html"))
    return table(spark, sf_dir, "pages").select(F.concat(F.lit("root"), F.floor(p / 1000).cast("string")).alias("root"), path.alias("path"), F.octet_length("html").alias("size"), F.lit(False).alias("binary"), F.col("html").alias("text"))


_PATHS = "SELECT 'root' || (page_id // 1000) AS root, 'd' || (page_id % 10) AS d, 'e' || ((page_id // 10) % 10) AS e, 'f' || lpad(CAST(page_id AS VARCHAR), 9, '0') || CASE WHEN page_id % 7 = 0 THEN '.bin' ELSE '.html' END AS f, html FROM pages"
_TREE = f"""p AS ({_PATHS}),
rows_ AS (SELECT DISTINCT root, '' AS k, root || '/' AS line FROM p
  UNION SELECT DISTINCT root, d, d || '/' FROM p
  UNION SELECT DISTINCT root, d || '/' || e, '    ' || e || '/' FROM p
  UNION SELECT root, d || '/' || e || '/' || f, '        ' || f FROM p),
trees AS (SELECT root, string_agg(line, chr(10) ORDER BY k) AS tree FROM rows_ GROUP BY root)"""


@query(f"WITH {_TREE} SELECT root, tree FROM trees")
def project_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of files."""
    return files.tree(_paths(spark, sf_dir))


@query(
    f"""WITH {_TREE}, bodies AS (SELECT root, string_agg(repeat('=', 80) || chr(10) || '# FILE: ' || d || '/' || e || '/' || f || chr(10) || repeat('=', 80) || chr(10) || html || chr(10) || chr(10), '' ORDER BY d, e, f) AS body
  FROM p WHERE f LIKE '%.html' AND octet_length(encode(html)) <= 1000000 GROUP BY root)
SELECT root, md5(repeat('=', 80) || chr(10) || 'PROJECT ROOT: ' || root || chr(10) || repeat('=', 80) || chr(10) || chr(10) || '{files.TREE_HEADING}' || chr(10) || chr(10) || tree || chr(10) || chr(10)
  || repeat('=', 80) || chr(10) || '{files.FILES_HEADING}' || chr(10) || repeat('=', 80) || chr(10) || chr(10) || coalesce(body, '')) AS packed_md5 FROM trees LEFT JOIN bodies USING (root)"""
)
def project_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed projects."""
    return files.pack(_paths(spark, sf_dir)).select("root", F.md5(F.col("packed").cast("binary")).alias("packed_md5"))


@query("SELECT event_id, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) // 86400000000 > 7 AS expired FROM events")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events are older than a week of whole days."""
    return table(spark, sf_dir, "events").select("event_id", media.expired(F.col("ts").cast("timestamp"), F.lit("2024-01-31").cast("timestamp")).alias("expired"))


@query("SELECT conv_id, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def backend_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last turn of each conversation."""
    return media.latest(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@query(
    f"""WITH u AS (SELECT page_id, ['WHISPER', NULL, 'vosk', 'other', ''][page_id % 5 + 1] AS wanted, html FROM pages),
b AS (SELECT *, CASE lower(coalesce(nullif(wanted, ''), 'tesseract')) WHEN 'whisper' THEN 'whisper' WHEN 'tesseract' THEN 'tesseract' END AS backend FROM u)
SELECT page_id, backend, backend IS NULL AS refused,
  CASE backend WHEN 'whisper' THEN '0 samples' WHEN 'tesseract' THEN regexp_replace(html, '^\\s+|\\s+$', '', 'g') END AS text FROM b"""
)
def backend_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as uploads, sent to stand-ins of the backends that they want."""
    wanted = F.element_at(F.array(F.lit("WHISPER"), F.lit(None), F.lit("vosk"), F.lit("other"), F.lit("")), (F.col("page_id") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "pages").select("page_id", wanted.alias("wanted"), F.col("html").cast("binary").alias("content"), F.lit("en").alias("language"))
    slots = {"whisper": models.whisper_standin(), "tesseract": models.reading_standin("tesseract_standin")}
    return models.dispatched(rows, "wanted", "tesseract", slots, ["content", "language"]).select("page_id", "backend", "refused", "text")


# --- optimisation

_ITEMS = "SELECT p_partkey AS item_id, CAST(p_size AS BIGINT) AS w, CAST(round(p_retailprice * 100) AS BIGINT) AS v FROM part"
_CAPACITY = 600


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_size").cast("long").alias("w"), F.round(F.col("p_retailprice") * 100).cast("long").alias("v"))


_USEFUL = f"useful AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY v DESC, item_id) AS n FROM ({_ITEMS})) WHERE n * w <= {_CAPACITY})"


@query(
    f"""WITH RECURSIVE {_USEFUL}, o AS (SELECT w, v, row_number() OVER (ORDER BY w, n) AS i FROM useful),
dp AS (SELECT CAST(0 AS BIGINT) AS i, list_transform(range({_CAPACITY + 1}), lambda c: CAST(0 AS BIGINT)) AS t
  UNION ALL SELECT o.i, list_transform(range({_CAPACITY + 1}), lambda c: CASE WHEN c >= w THEN greatest(t[c + 1], t[c - w + 1] + v) ELSE t[c + 1] END) FROM dp JOIN o ON o.i = dp.i + 1)
SELECT t[{_CAPACITY + 1}] AS value FROM dp ORDER BY i DESC LIMIT 1"""
)
def knapsack_optimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest value that fits."""
    return optimize.optimum(_items(spark, sf_dir), _CAPACITY)


@query(
    f"""WITH RECURSIVE {_USEFUL}, o AS (SELECT w, v, row_number() OVER (ORDER BY w, n) AS i FROM useful),
dp AS (SELECT CAST(0 AS BIGINT) AS i, list_transform(range({_CAPACITY + 1}), lambda c: CAST(0 AS BIGINT)) AS t
  UNION ALL SELECT o.i, list_transform(range({_CAPACITY + 1}), lambda c: CASE WHEN c >= w THEN greatest(t[c + 1], t[c - w + 1] + v) ELSE t[c + 1] END) FROM dp JOIN o ON o.i = dp.i + 1)
SELECT t[{_CAPACITY + 1}] AS value, true AS fits, true AS adds_up FROM dp ORDER BY i DESC LIMIT 1"""
)
def knapsack_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final choice: the exact one, unless the greedy one is as good."""
    items = _items(spark, sf_dir)
    made = optimize.final_choice(optimize.greedy(items, _CAPACITY), optimize.chosen_items(items, _CAPACITY), _CAPACITY)
    told = made.select("value", "weight", F.explode("chosen").alias("item_id")).join(items, "item_id")
    return told.groupBy("value").agg((F.sum("w") <= _CAPACITY).alias("fits"), (F.sum("v") == F.col("value")).alias("adds_up"))


@query(
    f"""WITH d AS (SELECT v / greatest(1, w) AS density, sum(w) AS w, sum(v) AS v FROM ({_ITEMS}) GROUP BY 1),
b AS (SELECT *, coalesce(sum(w) OVER (ORDER BY density DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT round(sum(CASE WHEN before + w <= {_CAPACITY} THEN CAST(v AS DOUBLE) ELSE ({_CAPACITY} - before) * density END), 6) AS bound FROM b WHERE before < {_CAPACITY}"""
)
def knapsack_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value if items could be taken in part."""
    return optimize.bound(_items(spark, sf_dir), _CAPACITY)


@query(
    f"""WITH RECURSIVE {_USEFUL}, o AS (SELECT item_id, w, v, row_number() OVER (ORDER BY v / w DESC, item_id) AS i FROM useful),
g AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS used, CAST(NULL AS BIGINT) AS item_id, CAST(0 AS BIGINT) AS w, CAST(0 AS BIGINT) AS v
  UNION ALL SELECT o.i, CASE WHEN used + o.w <= {_CAPACITY} THEN used + o.w ELSE used END, CASE WHEN used + o.w <= {_CAPACITY} THEN o.item_id END, o.w, o.v FROM g JOIN o ON o.i = g.i + 1)
SELECT item_id, w, v FROM g WHERE item_id IS NOT NULL"""
)
def knapsack_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items taken by density while they fit."""
    return optimize.greedy(_items(spark, sf_dir), _CAPACITY)


_SOLUTIONS = "SELECT p_brand AS group_id, p_partkey AS solution, p_retailprice AS fitness FROM part"
_SELECTED = f"""s AS (SELECT *, max(fitness) OVER (PARTITION BY group_id) AS best, row_number() OVER (PARTITION BY group_id ORDER BY fitness DESC, solution) AS r FROM ({_SOLUTIONS})),
t AS (SELECT *, exp((fitness - best) / 20.0) * CASE WHEN r = 1 THEN 1.6 WHEN r <= 5 AND fitness >= best * 0.99 AND abs(fitness - best) > 1e-9 * greatest(1, abs(best)) THEN 0.5 ELSE 1 END AS q FROM s),
sel AS (SELECT group_id, solution, round(q / sum(q) OVER (PARTITION BY group_id), 9) AS p FROM t)"""


def _selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("group_id"), F.col("p_partkey").alias("solution"), F.col("p_retailprice").alias("fitness"))
    return optimize.selection(rows, 20.0)


@query(f"WITH {_SELECTED} SELECT group_id, solution, round(p, 7) AS p FROM sel")
def softmax_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chances of solutions, by their fitness."""
    return _selection(spark, sf_dir).select("group_id", "solution", F.round("p", 7).alias("p"))


@query(
    f"""WITH {_SELECTED}, u AS (SELECT *, sum(p) OVER (PARTITION BY group_id ORDER BY solution) AS upto, max(solution) OVER (PARTITION BY group_id) AS final FROM sel)
SELECT group_id, CAST(draw AS INTEGER) AS draw, coalesce(min(solution) FILTER (WHERE upto >= draw / 10), max(final)) AS solution FROM u CROSS JOIN range(1, 10) AS d(draw) GROUP BY group_id, draw"""
)
def roulette_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine draws from each group at fixed numbers."""
    chances = _selection(spark, sf_dir)
    draws = chances.select("group_id").distinct().select("group_id", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("draw")).withColumn("r", F.col("draw") / 10)
    return optimize.roulette(chances, draws)


@query()
def knapsack_colony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What four seeded colonies find, and the optimum."""
    found = optimize.colony(_items(spark, sf_dir), _CAPACITY, bees=100, rounds=100).select("island", "weight", "value")
    return found.crossJoin(F.broadcast(optimize.optimum(_items(spark, sf_dir), _CAPACITY).withColumnRenamed("value", "optimum")))


@query(
    f"""WITH x AS (SELECT p_brand AS solution, p_partkey AS item_id, CAST(p_size AS BIGINT) AS w, CAST(round(p_retailprice * 100) AS BIGINT) AS v, p_partkey % 2 AS x FROM part)
SELECT solution, CAST(coalesce(sum(w) FILTER (WHERE x = 1), 0) AS BIGINT) AS weight, CAST(coalesce(sum(v) FILTER (WHERE x = 1), 0) AS BIGINT) AS value, count(*) FILTER (WHERE x = 1) AS chosen,
  CAST(coalesce(sum(v) FILTER (WHERE x = 1), 0) - 1e6 * greatest(0, coalesce(sum(w) FILTER (WHERE x = 1), 0) - {_CAPACITY}) AS DOUBLE) AS fitness FROM x GROUP BY solution"""
)
def knapsack_fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, value and penalised fitness of one solution for each brand."""
    rows = _items(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("solution")), "item_id")
    return optimize.fitness(rows.withColumn("x", (F.col("item_id") % 2).cast("int")), _CAPACITY)


@query(
    f"""WITH x AS (SELECT p_brand AS solution, p_partkey AS item_id, CAST(p_size AS BIGINT) AS w, CAST(round(p_retailprice * 100) AS BIGINT) AS v FROM part),
y AS (SELECT *, sum(w) OVER (PARTITION BY solution) - {_CAPACITY} AS excess, coalesce(sum(w) OVER (PARTITION BY solution ORDER BY v / w, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM x)
SELECT solution, item_id, w, v FROM y WHERE NOT gone < excess"""
)
def knapsack_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of each brand's items once the least dense are dropped until the rest fits."""
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("solution"), F.col("p_partkey").alias("item_id"), F.col("p_size").cast("long").alias("w"), F.round(F.col("p_retailprice") * 100).cast("long").alias("v"))
    return optimize.repair(rows, _CAPACITY).select("solution", "item_id", "w", "v")


# --- evaluation

_PAIRS = "SELECT a.conv_id, a.turn, a.text AS truth, b.text AS said FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("said"))
    return rows.select("conv_id", "turn", F.col("text").alias("truth")).join(after, ["conv_id", "turn"])


@query()  # DuckDB counts changes of bytes
def cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character error rate of each turn against the next."""
    errors = evaluate.char_errors(F.col("truth"), F.col("said"))
    return _pairs(spark, sf_dir).select("conv_id", "turn", errors.alias("errors"), evaluate.rate(errors, F.length("truth")).alias("cer"))


@query()
def wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word error rate of each turn against the next."""
    rows = _pairs(spark, sf_dir).withColumn("errors", evaluate.word_errors(F.col("truth"), F.col("said")))
    return rows.select("conv_id", "turn", "errors", evaluate.rate(F.col("errors"), F.size(text.tokens(F.col("truth")))).alias("wer"))


_CITED = r"list_distinct(list_transform(regexp_extract_all({0}, '\[(\d+)\]', 1), lambda x: CAST(x AS BIGINT)))"


@query(
    f"""WITH p AS (SELECT conv_id, turn, truth || ' [' || turn || '] [3]' AS a, said || ' [' || (turn + 1) || '][3]' AS b FROM ({_PAIRS})),
s AS (SELECT conv_id, turn, {_CITED.format('a')} AS a, {_CITED.format('b')} AS b FROM p)
SELECT conv_id, turn, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS overlap FROM s"""
)
def citation_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far citations agree; every turn cites its number and 3."""
    said = lambda c, n: F.concat(c, F.lit(" ["), n.cast("string"), F.lit("] [3]"))
    return _pairs(spark, sf_dir).select("conv_id", "turn", evaluate.citation_overlap(said(F.col("truth"), F.col("turn")), said(F.col("said"), F.col("turn") + 1)).alias("overlap"))


@query(rf"SELECT conv_id, turn, trim(regexp_replace(lower(truth), '\s+', ' ', 'g')) = trim(regexp_replace(lower(said), '\s+', ' ', 'g')) AS matches FROM ({_PAIRS})")
def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a turn says the same as the next."""
    return _pairs(spark, sf_dir).select("conv_id", "turn", evaluate.exact_match(F.col("truth"), F.col("said")).alias("matches"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of documents, the five best for each benchmark item, and the prompts they make."""
    chunks = _chunks(table(spark, sf_dir, "documents")).select((F.col("doc_id") * 1_000_000 + F.col("idx")).alias("doc_id"), "text")
    index, asked = _stored(spark, search.build(chunks, "doc_id", "text")), _questions(spark, sf_dir)
    hits = search.bm25_topk(index, asked, 5).join(asked, "query_id").join(index.corpus.select("pos", "text"), "pos")
    return search.prompts(hits).select("query_id", "prompt")
