"""Language identification by fusing evidence (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map, salted, stored
from .urls import parse

#: Places of the hashed three-letter table.
SLOTS = 1 << 16


def grams(text: str) -> np.ndarray:
    """Hashed three-byte pieces of the lower-cased text, with runs of anything but letters as one space."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
    letter = ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    raw = np.where(letter, raw, 32)
    raw = raw[~((raw == 32) & (np.r_[0, raw[:-1]] == 32))]
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    return (raw[:-2] * 1031 + raw[1:-1]) * 1033 + raw[2:] & (SLOTS - 1)


@dataclass
class Profiles:
    """log P(piece | language), and how many pieces count as independent."""

    languages: list[str]
    table: np.ndarray  # SLOTS x languages
    most: float = 40.0

    def scores(self, text: str) -> list[float] | None:
        """Log likelihood by language against their mean, as of at most `most` independent pieces; None without letters."""
        ids = grams(text)
        if not len(ids):
            return None
        mean = np.zeros(len(self.languages))
        for k in range(0, len(ids), 1 << 20):
            mean += self.table[ids[k : k + (1 << 20)]].sum(0)
        mean /= len(ids)
        return ((mean - mean.mean()) * min(len(ids), self.most)).tolist()


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 1500, most_languages: int = 1024) -> Profiles:
    """Profiles of every labelled language, from at most about sample_rows labelled rows of each, drawn by a hash of the id.

    Rows whose label or text is null, and those with an empty label, teach nothing; copies are drawn with their id. A profile is 65,536 numbers that every executor
    holds, so over most_languages labels raise an error rather than leave languages out.
    """
    known = docs.where(F.col(lang_col).isNotNull() & (F.col(lang_col) != "") & F.col(text_col).isNotNull())
    sizes = known.groupBy(lang_col).count().limit(most_languages + 1).collect()
    if len(sizes) > most_languages:
        raise ValueError(f"over {most_languages} languages: clean the labels, or fit on groups of languages")
    languages = sorted(r[lang_col] for r in sizes)
    if not languages:
        return Profiles([], np.zeros((SLOTS, 0), np.float32))
    size = F.create_map(*[F.lit(x) for r in sizes for x in (r[lang_col], r["count"])])
    drawn = known.where(F.pmod(F.xxhash64(id_col, F.lit(6)), F.try_element_at(size, F.col(lang_col))) < sample_rows)
    place = {x: k for k, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for lang, t in zip(b.column(0).to_pylist(), b.column(1)):
                own = total.setdefault(place[lang], np.zeros(SLOTS))
                ids = grams(t.as_py())
                for k in range(0, len(ids), 1 << 20):
                    own += np.bincount(ids[k : k + (1 << 20)], minlength=SLOTS)
        for k, own in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([own.tobytes()], pa.binary())], names=["k", "counts"])

    # a language's drawn rows are few, whatever the table's size, so they meet in one task
    table = np.full((SLOTS, len(languages)), 0.5)
    for r in arrow_map(drawn.select(lang_col, text_col).repartition(len(languages), lang_col), count, "k long, counts binary").toLocalIterator():
        table[:, r["k"]] += np.frombuffer(r["counts"])
    return Profiles(languages, np.log(table / table.sum(0)).astype(np.float32))


def page_evidence(pages: DataFrame, doc_number: Column, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """doc, host, declared, suffix of every page that shows a document. doc_number: an expression of `path` that gives the document's id.

    declared is the lang attribute of the html element, suffix the first path segment of two letters or else the host's last label; each is null where a page
    has none, or has no url or html.
    """
    host, path = parse(F.col(url_col))
    rows = pages.select(host.alias("host"), path.alias("path"), F.regexp_extract(html_col, r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})", 1).alias("declared"))
    segment = F.regexp_extract("path", r"^/([a-z]{2})(?:/|$)", 1)
    suffix = F.when(segment != "", segment).otherwise(F.substring_index("host", ".", -1))
    empty = lambda c: F.when(F.col(c) != "", F.lower(c))
    out = rows.select(doc_number.alias("doc"), empty("host").alias("host"), empty("declared").alias("declared"), F.when(suffix != "", suffix).alias("suffix"))
    return out.where("doc is not null")


def _softmax(x: Column) -> Column:
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def identify(docs: DataFrame, profiles: Profiles, evidence: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", host_col: str | None = "source", accept: list[str] | None = None, least: float = 0.5, weight_domain: float = 5.0, weight_host: float = 10.0) -> DataFrame:
    """id, lang, posterior, kept, text_lang (of the text alone) and pages (how many gave evidence) for every row of docs.

    The text's likelihoods meet the chances of the declared markup language and of the address suffix in each language, and the prior of
    the host, which leans on its domain's and that on the corpus's in proportion to weight_host and weight_domain rows. The chances and priors are counts of
    the languages that the texts alone are sure of (0.9), over all rows and pages. The pages of one document (rows of evidence: doc, host, declared, suffix)
    repeat one another, so their logarithms are averaged; where it has none, the host is host_col and the rest says nothing. A row is kept if its text
    has letters, its best posterior is at least `least` and the language is accepted (all of the profiles' unless given).

    Null and empty texts give lang null and are not kept; without profiles all rows do; a very long text is scored whole; repeated rows give repeated
    results; an empty table gives none; other columns, whatever their names, are ignored.
    """
    spark, langs = docs.sparkSession, profiles.languages
    out_cols = [id_col, "lang", "posterior", "kept", "text_lang", "pages"]
    host = F.col(host_col).cast("string") if host_col and host_col in docs.columns else F.lit(None).cast("string")
    if not langs:
        nothing = [F.lit(None).cast(t).alias(c) for c, t in zip(out_cols[1:], ["string", "double", "boolean", "string", "long"])]
        return docs.select(id_col, *nothing).withColumns({"kept": F.lit(False), "pages": F.lit(0).cast("long")})
    shared = spark.sparkContext.broadcast(profiles)  # 65,536 numbers a language, a bounded number of languages

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for b in batches:
            s = [p.scores(t.as_py() or "") for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.list_(pa.float64()))], names=["id", "own_host", "t"])

    text = docs.select(docs[id_col].cast("long").alias("id"), host.alias("own_host"), docs[text_col].cast("string").alias("_text"))
    rows = arrow_map(text, score, "id long, own_host string, t array<double>")
    known, n = F.array(*map(F.lit, langs)), len(langs)
    best = lambda p: F.element_at(known, F.array_position(p, F.array_max(p)).cast("int"))
    rows = rows.withColumn("p", _softmax(F.col("t"))).withColumn("text_lang", F.when(F.col("t").isNotNull(), best(F.col("p"))))
    rows = stored(rows.select("id", "own_host", "t", "text_lang", F.when(F.array_max("p") >= 0.9, F.col("text_lang")).alias("sure")))
    if evidence is None:
        evidence = spark.createDataFrame([], "doc long, host string, declared string, suffix string")
    of_known = lambda c: F.when(F.array_contains(known, F.col(c)), F.col(c)).otherwise(F.when(F.col(c).isNotNull(), F.lit("other"))).alias(c)
    sure = rows.where("sure is not null").groupBy(F.col("id").alias("doc")).agg(F.min("sure").alias("sure"))
    pages = stored(evidence.select("doc", "host", of_known("declared"), of_known("suffix")).join(sure, "doc", "left"))
    shown = pages.groupBy(F.col("doc").alias("id")).agg(F.count(F.lit(1)).alias("pages"))
    own = rows.join(shown, "id", "left").select("*", F.when(F.col("pages").isNull(), F.col("own_host")).alias("host"))

    counts = lambda df, *keys: df.groupBy(*keys).agg(*[F.count_if(F.col("sure") == x).cast("double").alias(f"n{k}") for k, x in enumerate(langs)])
    as_array = F.array(*[F.col(f"n{k}") for k in range(n)])
    total = [r if r is not None else 0.0 for r in counts(rows).first()]
    base = [(c + 1) / (sum(total) + n) for c in total]
    lit_base = F.array(*map(F.lit, base))

    def chances(c: str) -> Column:
        """log P(value of c | language) as an array by language; null where c is. At most one row a language and one for others."""
        got = {r[c]: list(r)[1:] for r in counts(pages.where(F.col(c).isNotNull()), c).collect()}
        values = [*langs, "other"]
        got = {v: got.get(v, [0.0] * n) for v in values}
        by_lang = [sum(got[v][k] for v in values) for k in range(n)]
        logs = {v: [float(np.log((got[v][k] + 0.5) / (by_lang[k] + 0.5 * len(values)))) for k in range(n)] for v in values}
        table = F.create_map(*[y for v in values for y in (F.lit(v), F.array(*map(F.lit, logs[v])))])
        return F.try_element_at(table, F.col(c))

    def leaning(c: Column, parent: Column, weight: float) -> Column:
        size = F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(c, parent, lambda x, y: (x + weight * y) / (size + weight))

    seen = pages.select("host", "sure").unionByName(own.select("host", "sure")).where("host is not null and sure is not null")
    by_host = stored(counts(seen, "host").withColumn("domain", F.substring_index("host", ".", -2)))
    domains = by_host.groupBy("domain").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(n)]).select("domain", leaning(as_array, lit_base, weight_domain).alias("of_domain"))
    hosts = by_host.select("host", "domain", as_array.alias("n")).join(domains, "domain").select("host", leaning(F.col("n"), F.col("of_domain"), weight_host).alias("of_host"))
    hosts = stored(hosts.select("host", F.zip_with("of_host", lit_base, lambda x, y: F.ln(x / y)).alias("of_host")))  # what the host adds to the corpus's prior
    said = {"of_host": F.col("of_host"), "of_declared": chances("declared"), "of_suffix": chances("suffix")}
    placed = salted(pages, "host", hosts, "doc").select("doc", *[v.alias(k) for k, v in said.items()])
    means = placed.groupBy(F.col("doc").alias("id")).agg(*[F.avg(F.col(c)[k]).alias(f"{c}{k}") for c in said for k in range(n)])
    none = F.array(*[F.lit(0.0)] * n)
    means = means.select("id", F.array(*[sum((F.coalesce(F.col(f"{c}{k}"), F.lit(0.0)) for c in said), F.lit(0.0)) for k in range(n)]).alias("of_pages"))
    rows = salted(own, "host", hosts, "id").join(means, "id", "left")
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    fused = add(add(F.col("t"), F.transform(lit_base, lambda v: F.ln(v))), F.coalesce("of_pages", "of_host", none))
    rows = rows.withColumn("p", _softmax(fused))
    lettered = F.col("text_lang").isNotNull()
    rows = rows.withColumn("lang", F.when(lettered, best(F.col("p")))).withColumn("posterior", F.when(lettered, F.array_max("p")))
    fine = lettered & (F.col("posterior") >= least)
    if accept is not None:
        fine = fine & F.col("lang").isin(*accept)
    kept = F.coalesce(fine, F.lit(False))
    return rows.select(F.col("id").alias(id_col), "lang", "posterior", kept.alias("kept"), "text_lang", F.coalesce("pages", F.lit(0).cast("long")).alias("pages"))
