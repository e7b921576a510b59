"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.llm import audit, idfiles, langid, lines, middles, minhash, neighbours, packing, pieces, secrets, shards, toxicity, winnow
from helixlake.plans.staging import delete, shared_root


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document; learned from four of five labelled ones."""
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out)
    out = toxicity.predict(docs, toxicity.train(docs, labels))
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted", joined.alias("spans"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents over two-word shingles."""
    return minhash.near_duplicates(_docs(spark, sf_dir), words=2, percent=80)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, base patterns and confirmed structures."""
    return secrets.digest_columns(secrets.find_secrets(_docs(spark, sf_dir).select("doc_id", "text")))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowed fingerprints of all documents and of their edited texts."""
    return winnow.fingerprint_edits(_docs(spark, sf_dir))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return pieces.encode_decode(_docs(spark, sf_dir).select("doc_id", "text"), _tokenizer("piece_bpe_32k.model"), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector."""
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, 20)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; learned from two of three documents."""
    docs = _docs(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    model = langid.train(docs.filter(~held_out), pieces.load(_tokenizer("piece_bpe_32k.model")).piece)
    return langid.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model)


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated lines."""
    out = lines.dedup_lines(_docs(spark, sf_dir).select("doc_id", "text"), distance=None)
    return out.select("doc_id", "n_lines", "n_dropped", "text")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids."""
    return packing.pack(_docs(spark, sf_dir), _tokenizer("word_bpe_49k.json"), 2048)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 of row counts at most one apart."""
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    out = shards.shuffle_into_shards(docs, 40, size=size)
    return out.select("doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rearranged around a middle of whole lines, and rebuilt from that."""
    return middles.fill_in_middle(_docs(spark, sf_dir).select("doc_id", "text"), outputs=False, digests=True)


def op12_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written in compact files in order of doc_id, and read back from them."""
    path = f"{shared_root(spark)}/helixlake/ids-{uuid.uuid4().hex}"
    idfiles.write_ids(_docs(spark, sf_dir).select("doc_id", "text"), _tokenizer("word_bpe_49k.json"), path)
    out = idfiles.read_documents(spark, path)
    delete(spark, path)
    return out


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each language in every order."""
    return audit.audit_filters(_docs(spark, sf_dir).select("doc_id", "text", "lang"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict:
    return {"op1_toxicity": op1_toxicity, "op2_near_duplicates": op2_near_duplicates, "op3_secrets": op3_secrets, "op4_fingerprints": op4_fingerprints, "op5_sentencepiece": op5_sentencepiece, "op6_neighbours": op6_neighbours, "op7_language": op7_language, "op8_lines": op8_lines, "op9_packing": op9_packing, "op10_sharding": op10_sharding, "op11_fill_in_middle": op11_fill_in_middle, "op12_id_files": op12_id_files, "op13_filter_audit": op13_filter_audit}


#: Exact links between all pairs of texts, then the smallest document that each reaches.
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NEAR = rf"""WITH RECURSIVE W AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
S AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 1 THEN [hash(w[1])] WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: hash(w[i], w[i + 1])) ELSE [] END) AS s FROM W),
P AS (SELECT a.doc_id AS a, b.doc_id AS b, len(a.s) AS n, len(b.s) AS m, len(list_intersect(a.s, b.s)) AS c FROM S a JOIN S b ON a.doc_id < b.doc_id AND len(a.s) > 0 AND 100 * least(len(a.s), len(b.s)) >= 80 * greatest(len(a.s), len(b.s))),
L AS MATERIALIZED (SELECT a, b FROM P WHERE 100 * c >= 80 * (n + m - c)),
R AS (SELECT a AS x, b AS y FROM L UNION SELECT b, a FROM L UNION SELECT R.x, E.y FROM R JOIN (SELECT a AS x, b AS y FROM L UNION ALL SELECT b, a FROM L) E ON E.x = R.y)
SELECT S.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(least(S.doc_id, min(y)), S.doc_id) AS component_id, coalesce(least(S.doc_id, min(y)), S.doc_id) = S.doc_id AS kept FROM S LEFT JOIN R ON R.x = S.doc_id GROUP BY S.doc_id, s"""


#: Each document walked through each order of the filters, one at a time.
_AUDIT = rf"""WITH T AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
W AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS head FROM T),
D AS (SELECT part, concat(CASE WHEN len(w) < 100 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' END, CASE WHEN 100 * (length(t) - length(translate(t, '{_LETTERS}', ''))) > 10 * length(t) THEN 'C' END,
 CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN head < doc_id THEN 'E' END) AS fails,
 doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic FROM W),
X AS (SELECT * FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x)),
O AS (SELECT concat(a.x, b.x, c.x, d.x, e.x) AS o FROM X a, X b, X c, X d, X e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
G AS (SELECT part, o, fails, good, toxic, list_min([CAST(instr(o, x) AS INTEGER) FOR x IN string_split(fails, '') IF x <> '']) AS hit FROM D, O),
R AS (SELECT part, o AS filter_order, CAST(s.s AS INTEGER) AS step, substr(o, s.s, 1) AS x, count(*) FILTER (WHERE hit IS NULL OR hit > s.s) AS kept, count(*) FILTER (WHERE hit = s.s) AS removed, count(*) FILTER (WHERE hit < s.s AND contains(fails, substr(o, s.s, 1))) AS redundant,
 count(*) FILTER (WHERE fails = substr(o, s.s, 1)) AS unique_fails, count(*) FILTER (WHERE hit = s.s AND good) AS good_lost, count(*) FILTER (WHERE hit = s.s AND toxic) AS toxic_lost FROM G, (SELECT unnest([1, 2, 3, 4, 5]) AS s) s GROUP BY part, o, s.s)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM R"""


def oracle_sql() -> dict[str, str]:
    """SQL over whole tables, where it can express an operator's exact result."""
    return {"op2_near_duplicates": _NEAR, "op13_filter_audit": _AUDIT}
