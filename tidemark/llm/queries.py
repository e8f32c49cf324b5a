"""The registered queries of this subpackage: opN_<name> for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fold, read, tokenizer_path


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and near-duplicate groups of all documents: shingles of four words, four differing bits. Rows, nulls and repeats as in near_duplicates()."""
    from .simhash import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels outside the held-out fold. Rows, nulls and repeats as in toxicity.score()."""
    from .toxicity import classify

    out = classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


#: Fixed verdicts by host and path.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of every page: fixed rules, then mined ones. Labels reach a url by the document number at the end of its path: bad is low quality or toxic.

    Rows, nulls and repeats as in judge().
    """
    from .urls import judge, parse

    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(((F.min("quality") == 0) | (F.max("toxic") == 1)).alias("bad"))
    labelled = pages.select("url", document_number(parse(F.col("url"))[1]).alias("doc_id")).join(labels, "doc_id")
    return judge(pages, URL_RULES, labelled)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2,048 tokens, one row a piece; ids_crc32 is of its ids as little-endian unsigned 32-bit numbers. Rows, nulls and repeats as in pack()."""
    from .packing import pack

    pieces = pack(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and verdict of every document; the operator's longest_repeat stays with it."""
    from .repetition import judge

    return judge(read(spark, sf_dir, "documents")).drop("longest_repeat")


#: A word repeat of eight or more is a window of eight words found twice, and one of over a hundred a window of 101.
OP5_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), s AS (SELECT *, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS ws FROM d),
 w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM s),
 k AS (SELECT *, CASE WHEN lead(word, 2) OVER o IS NOT NULL THEN concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o) END AS k3,
 CASE WHEN lead(word, 7) OVER o IS NOT NULL THEN concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o, lead(word, 5) OVER o, lead(word, 6) OVER o, lead(word, 7) OVER o) END AS k8 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
 f AS (SELECT doc_id, i, word, k3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, k3) > 1 AS f3, k8 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, k8) > 1 AS f8 FROM k),
 c AS (SELECT doc_id, max(f3::int) OVER (PARTITION BY doc_id ORDER BY i ROWS 2 PRECEDING) AS c3, max(f8::int) OVER (PARTITION BY doc_id ORDER BY i ROWS 7 PRECEDING) AS c8 FROM f),
 g AS (SELECT doc_id, count(*) AS n_words, sum(c3)::bigint AS n_repeat_words, sum(c8)::bigint AS covered_words FROM c GROUP BY doc_id),
 l AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, list_slice(ws, i, i + 100) AS run FROM (SELECT doc_id, i FROM f WHERE f8) JOIN s USING (doc_id) WHERE i + 100 <= len(ws)) GROUP BY doc_id, run HAVING count(*) > 1),
 t AS (SELECT s.doc_id, coalesce(n_words, 0) AS n_words, list_sum(list_transform(ws, lambda x: length(x))) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS ls, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(covered_words, 0) AS covered_words, s.doc_id IN (SELECT doc_id FROM l) AS long_ FROM s LEFT JOIN g ON g.doc_id = s.doc_id)
 SELECT doc_id, n_words::bigint AS n_words, coalesce(word_chars, 0)::bigint AS word_chars, n_symbols::bigint AS n_symbols, (len(ls) - len(list_distinct(ls)))::bigint AS n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
 NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND covered_words <= 0.4::double * n_words AND NOT long_ AS kept, covered_words FROM t"""


def document_number(path: Column) -> Column:
    """The document that a page shows: the number at the end of its path."""
    return F.regexp_extract(path, r"/([0-9]{1,18})(?:\.html)?/?$", 1).try_cast("bigint")


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from .language import fit, identify, page_evidence

    evidence = page_evidence(read(spark, sf_dir, "pages"), document_number(F.col("path")))
    return identify(docs, fit(docs), evidence)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document from its text, its pages and its host. Rows, nulls and repeats as in identify()."""
    return identified(spark, read(spark, sf_dir, "documents"), sf_dir)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data of every document: counts and a digest of the base spans, and all spans. Rows, nulls and repeats as in find()."""
    from .pii import KINDS, find, of_kind, spelled

    found = find(read(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from the labels outside the held-out fold. Rows, nulls and repeats as in classify()."""
    from .quality import classify

    out = classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of what they decode to, for every document. Rows, nulls and repeats as in encode()."""
    from .pieces import encode

    return encode(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), texts=False)


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row whose id is divisible by 20, among all rows. Nulls and repeats as in search()."""
    from .ann import search

    return search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1,024 tokens, one row a piece. Rows, nulls and repeats as in slots.pack()."""
    from .slots import pack

    pieces = pack(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item. Rows, nulls and repeats as in lexical.search()."""
    from .lexical import search

    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP12_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
 s AS (SELECT count(*) FILTER (len(ts) > 0) AS n_docs, sum(len(ts))::bigint AS n_terms FROM d),
 f AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) GROUP BY r, t),
 w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)))::bigint AS w FROM f, s GROUP BY t, n_docs),
 q AS (SELECT DISTINCT i, item_id, t FROM (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)),
 m AS (SELECT r, doc_id, 100 - 50 + ((50 * len(ts) * n_docs) // n_terms) AS m FROM d, s),
 x AS (SELECT i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint AS score FROM q JOIN w USING (t) JOIN f USING (t) JOIN m USING (r) GROUP BY i, item_id, r, doc_id),
 k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0)
 SELECT item_id, rank::int AS rank, doc_id, score FROM k WHERE rank <= 50"""


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors, sixteen parts of 64 entries, after two rounds. Rows, nulls and repeats as in codes.compress()."""
    from .codes import compress, with_label_error

    found = compress(read(spark, sf_dir, "embeddings"))
    rows = with_label_error(found.rows)
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))


def _op13_sql() -> str:
    """Two rounds over the parts of vectors of 64 components, as joins of parts with entries; 64 * distance + entry makes the least one the nearest with ties to the lower entry."""
    v, c = [f"v{k}" for k in range(4)], [f"c{k}" for k in range(4)]
    far = " + ".join(f"({a} - {b}) * ({a} - {b})" for a, b in zip(v, c))
    steps = [
        "r AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS x FROM embeddings WHERE len(embedding) = len(list_filter(embedding, lambda x: isfinite(x))))",
        f"p AS MATERIALIZED (SELECT r, part, {', '.join(f'x[4 * part + {k + 1}] AS v{k}' for k in range(4))} FROM r, range(16) AS t(part))",
        f"b0 AS MATERIALIZED (SELECT part, r - 1 AS e, {', '.join(f'{a} AS {b}' for a, b in zip(v, c))} FROM p WHERE r <= 64)",
    ]
    for k in range(3):
        steps.append(f"a{k} AS MATERIALIZED (SELECT part, r, min(64 * ({far}) + e) AS least, {', '.join(f'any_value({a}) AS {a}' for a in v)} FROM p JOIN b{k} USING (part) GROUP BY part, r)")
        if k < 2:
            means = ", ".join(f"coalesce(m.{b}, b.{b}) AS {b}" for b in c)
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT b.part, b.e, {means} FROM b{k} b LEFT JOIN (SELECT part, least % 64 AS e, {', '.join(f'floor(sum({a}) / count(*))::bigint AS {b}' for a, b in zip(v, c))} FROM a{k} GROUP BY ALL) m ON m.part = b.part AND m.e = b.e)")
    every = " || ',' || ".join(c)
    steps.append(f"h AS (SELECT sha256(string_agg({every}, ',' ORDER BY part, e)) AS codebooks_sha256 FROM b2)")
    steps.append("g AS (SELECT r, string_agg(printf('%02x', (least % 64)::int), '' ORDER BY part) AS code, sum(least // 64)::bigint AS error FROM a2 GROUP BY r)")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::bigint AS label_error, codebooks_sha256 FROM r JOIN g USING (r), h"


OP13_SQL = _op13_sql()


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline over documents. Nulls and repeats as stated there."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    of = (op1_simhash, op2_toxicity, op3_urls, op4_packing, op5_repetition, op6_language, op7_pii, op8_quality, op9_sentencepiece, op10_neighbours, op11_bestfit, op12_lexical, op13_codes, pipeline)
    return {f.__name__: f for f in of}


def oracle_sql() -> dict[str, str]:
    """SQL of the repetition rules, the ranked search and the vector codes. The other operators hash, learn or tokenise beyond what SQL expresses; tests/llm holds their brute-force twins."""
    return {"op5_repetition": OP5_SQL, "op12_lexical": OP12_SQL, "op13_codes": OP13_SQL}
