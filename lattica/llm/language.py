"""Language ID by Bayesian evidence fusion.

Four kinds of evidence are multiplied: the text's likelihood under hashed byte-trigram multinomials of each language; the declared language (the markup's `lang`, or a document's own column) through a confusion table, P(declared | language); the address suffix; and the host. The last two form one hierarchical prior: language counts of a host are smoothed by those of its domain, these by its suffix's, these by all rows'. All counts are expected counts, the sums of the text posteriors, from grouped aggregations; a row's own share is taken out of its host's counts before they judge it.

Languages are primary codes: labels and declarations are lower-cased and cut at the first `-` or `_`; what is left of other than two or three letters is no language. Every language that any label names is known. The multinomials are fitted on about TRAIN_ROWS labelled documents, an equal number of each language as far as it has so many, those below a bound of a keyed hash. Trigrams overlap, so a text's log-likelihood counts a third.

Pages give visible text (no scripts, styles, comments, tags; what is not closed runs to the end), declared language and address; documents give their text, their `lang` as declared, and their source as host without a suffix.

Defined results: null or empty texts have an even likelihood; a null or unreadable declaration is no evidence; a null URL or source is the empty host; a null or unreadable label trains nothing; without labelled documents no language is known and lang is null; repeated rows count each; an empty table gives no rows; ids pass through, null or not; other columns are not read.

Plan: one scan makes the evidence table, a row of small numbers for each text; texts are never shuffled. Aggregations combine before they shuffle. Hosts that hold one row in HOT or more, HOT at most, are broadcast; all others meet their rows in a shuffled join, so no host is a hot key. The driver holds one table of BUCKETS x languages, 64 kB a language.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import arrow_map, column, materialize, read
from lattica.llm.urls import host_of

BUCKETS, TRAIN_ROWS, HOT = 1 << 14, 20_000, 1024
#: Pseudo-counts that an upper level of the prior, and the overall share of a declared value, weigh.
STRENGTH, DECLARED_STRENGTH, TEMPER = 8.0, 2.0, 1 / 3
CHUNK = 1 << 20
#: Elements whose content is not shown, and how a tag declares its language.
SILENT = ("script", "style")
LANG = re.compile(r"""(?i)\blang\s*=\s*["']?([a-z]{2,3})(?![a-z])""")


def scanned(page: str) -> tuple[str, str | None]:
    """Visible text and declared language, in one pass from tag to tag: each character is looked at a fixed number of times, however the markup is broken."""
    low = page.translate(LOWERED)
    shown, declared, at, n = [], None, 0, len(page)
    while at < n:
        tag = low.find("<", at)
        if tag < 0:
            shown.append(page[at:])
            break
        shown.append(page[at:tag])
        shown.append(" ")
        if low.startswith("<!--", tag):
            end = low.find("-->", tag + 4)
            at = n if end < 0 else end + 3
            continue
        end = low.find(">", tag)
        if end < 0:  # no tag ends any more
            shown.append(page[tag:])
            break
        name = NAME.match(low, tag + 1, end)
        name = name[0] if name else ""
        if name == "html" and declared is None and (found := LANG.search(low, tag, end)):
            declared = found[1]
        at = end + 1
        if name in SILENT:
            close = low.find("</" + name, at)
            end = low.find(">", close) if close >= 0 else -1
            at = n if end < 0 else end + 1
    return html.unescape("".join(shown)), declared


#: Lowers A-Z in place, so that positions stay.
LOWERED = {ord(a): b for a, b in zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", strict=True)}
NAME = re.compile("[a-z]+")


def code_of(language: Column) -> Column:
    """The primary code of a label or declaration; null if it is not readable."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(language)), "^([a-z]{2,3})(?:[-_].*)?$", 1), F.lit(""))


def trigrams(text: bytes) -> Iterator[np.ndarray]:
    raw = np.frombuffer(text, np.uint8)
    for at in range(0, len(raw) - 2, CHUNK):
        b = raw[at : at + CHUNK + 2].astype(np.uint32)
        yield ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1) >> np.uint32(18)).astype(np.int64)


def sample(labelled: DataFrame, rows: int) -> DataFrame:
    """labelled (doc_id, text, lang) -> lang, text of about rows / languages documents of each language: those below a bound of a keyed hash, which its grouped count sets."""
    known = labelled.select("doc_id", "text", code_of(F.col("lang")).alias("lang")).where("lang IS NOT NULL AND doc_id IS NOT NULL")
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    bounds = counts.select(F.col("lang").alias("__lang"), (F.lit(float(rows)) / F.count(F.lit(1)).over(Window.partitionBy()) / F.col("n")).alias("__share"))  # 26**2 + 26**3 rows at most
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    return known.join(F.broadcast(bounds), (F.col("lang") == F.col("__lang")) & (place < F.col("__share"))).select("lang", F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """labelled (doc_id, text, lang) -> languages, log probabilities (bucket, language)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                n = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for f in trigrams(t.as_py()):
                    n += np.bincount(f, minlength=BUCKETS)
        for lang, n in total.items():
            at = np.r_[np.flatnonzero(n), -1]  # -1: the language alone, for one whose texts are empty
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(np.where(at < 0, 0, n[at]))], ["lang", "bucket", "n"])

    table = arrow_map(sample(labelled, rows), count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(table.lang.unique())
    counts = np.full((BUCKETS, len(langs)), 0.5)
    table = table[table.bucket >= 0]
    if langs:
        np.add.at(counts, (table.bucket.to_numpy(np.int64), np.searchsorted(langs, table.lang.to_numpy(str))), table.n.to_numpy(float))
    return langs, np.log(counts / counts.sum(axis=0, keepdims=True))


def evidence(rows: DataFrame, langs: list[str], logs: np.ndarray) -> DataFrame:
    """rows (id: any, markup: boolean, text, declared, host, suffix, domain) -> the same without text, declared read from markup, ll (tempered log-likelihood by language) and q (its softmax)."""
    model = rows.sparkSession.sparkContext.broadcast(logs)
    n = len(langs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ll = np.zeros((b.num_rows, n))
            said = b.column("declared").to_pylist()
            for i, (markup, t) in enumerate(zip(b.column("markup").to_pylist(), b.column("text"), strict=True)):
                text = t.as_py() or ""
                if markup:
                    text, said[i] = scanned(text)
                for f in trigrams(text.encode()):
                    ll[i] += np.bincount(f, minlength=BUCKETS) @ model.value if len(f) > BUCKETS else model.value[f].sum(axis=0)
            ll *= TEMPER
            q = np.exp(ll - ll.max(axis=1, keepdims=True)) if n else ll
            q = q / q.sum(axis=1, keepdims=True) if n else q
            vector = lambda x: pa.array(list(x), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(said, pa.string()), b.column("host"), b.column("domain"), b.column("suffix"), vector(ll), vector(q)], ["id", "declared", "host", "domain", "suffix", "ll", "q"])

    kind = rows.schema["id"].dataType.simpleString()
    return arrow_map(rows.select("id", "markup", "text", "declared", "host", "domain", "suffix"), work, f"id {kind}, declared string, host string, domain string, suffix string, ll array<double>, q array<double>")


def each(n: int, f) -> Column:
    return F.array(*[f(i) for i in range(n)]).cast("array<double>")


def fused(rows: DataFrame, labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """rows as in `evidence` -> id, declared, host, suffix, text_lang (by text alone), lang, probability."""
    langs, logs = fit(labelled, train_rows)
    n = len(langs)
    seen = materialize(evidence(rows, langs, logs), "evidence")
    if not n:
        return seen.select("id", "declared", "host", "suffix", F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"))
    sums = each(n, lambda i: F.sum(F.col("q")[i]))
    whole = seen.agg(F.count(F.lit(1)).alias("n"), sums.alias("c")).first()
    total = max(whole.n, 1)
    top = [((whole.c[i] or 0.0) + 1 / n) / (whole.n + 1) for i in range(n)]

    hosts = materialize(seen.groupBy("suffix", "domain", "host").agg(F.count(F.lit(1)).alias("n"), sums.alias("c")), "hosts")
    again = each(n, lambda i: F.sum(F.col("c")[i]))
    level = lambda above: each(n, lambda i: (F.col("c")[i] + STRENGTH * above(i)) / (F.col("n") + STRENGTH))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), again.alias("c")).select("suffix", level(lambda i: F.lit(top[i])).alias("by_suffix"))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), again.alias("c")).join(suffixes, "suffix").select("suffix", "domain", level(lambda i: F.col("by_suffix")[i]).alias("by_domain"))
    priors = hosts.join(domains, ["suffix", "domain"]).select("suffix", "domain", "host", F.col("n").alias("host_n"), F.col("c").alias("host_c"), "by_domain")

    said = seen.where("declared IS NOT NULL").groupBy("declared").agg(F.count(F.lit(1)).alias("n"), sums.alias("c"))
    heard = said.agg(F.sum("n").alias("n"), again.alias("c")).first()
    share = lambda i: (F.col("c")[i] + DECLARED_STRENGTH * F.col("n") / (heard.n or 1)) / ((heard.c[i] or 0.0) + DECLARED_STRENGTH)
    table = said.select("declared", each(n, share).alias("by_declared"))  # 26**2 + 26**3 rows at most

    place = ["suffix", "domain", "host"]
    hot = F.col("host_n") * HOT >= F.lit(total)
    often = F.broadcast(priors.where(hot))  # HOT rows at most
    joined = seen.join(often, place).unionByName(seen.join(often.select(*place), place, "left_anti").join(priors.where(~hot), place))
    joined = joined.join(F.broadcast(table), "declared", "left")
    host = lambda i: (F.greatest(F.col("host_c")[i] - F.col("q")[i], F.lit(0.0)) + STRENGTH * F.col("by_domain")[i]) / (F.col("host_n") - 1 + STRENGTH)
    joined = joined.withColumn("lp", each(n, lambda i: F.col("ll")[i] + F.log(host(i)) + F.coalesce(F.log(F.col("by_declared")[i]), F.lit(0.0))))
    best = lambda c: F.element_at(F.array(*map(F.lit, langs)), F.array_position(c, F.array_max(c)).cast("int"))
    norm = F.aggregate("lp", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("lp")))
    return joined.select("id", "declared", "host", "suffix", best(F.col("ll")).alias("text_lang"), best(F.col("lp")).alias("lang"), (1 / norm).alias("probability"))


def evidence_rows(documents: DataFrame, pages: DataFrame) -> DataFrame:
    kinds = [t.schema[c].dataType for t, c in ((documents, "doc_id"), (pages, "page_id"))]
    no_doc, no_page = (F.lit(None).cast(k) for k in kinds)
    host = host_of(column(pages, "url"))
    docs = documents.select(F.struct(column(documents, "doc_id").alias("doc_id"), no_page.alias("page_id")).alias("id"), F.lit(False).alias("markup"), column(documents, "text").alias("text"), code_of(column(documents, "lang")).alias("declared"), F.coalesce(column(documents, "source"), F.lit("")).alias("host"), F.coalesce(column(documents, "source"), F.lit("")).alias("domain"), F.lit("").alias("suffix"))
    webs = pages.select(F.struct(no_doc.alias("doc_id"), column(pages, "page_id").alias("page_id")).alias("id"), F.lit(True).alias("markup"), column(pages, "html").alias("text"), F.lit(None).cast("string").alias("declared"), host.alias("host"), F.substring_index(host, ".", -2).alias("domain"), F.concat(F.lit("."), F.substring_index(host, ".", -1)).alias("suffix"))
    return docs.unionByName(webs)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id or page_id, declared, host, suffix, text_lang, lang, probability for every document and every page."""
    documents = read(spark, sf_dir, "documents")
    found = fused(evidence_rows(documents, read(spark, sf_dir, "pages")), documents.select("doc_id", "text", "lang"))
    return found.select("id.doc_id", "id.page_id", "declared", "host", "suffix", "text_lang", "lang", "probability")
