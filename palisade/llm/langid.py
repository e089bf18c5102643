"""Language identification by Bayesian evidence fusion.

Four pieces of evidence are summed as log likelihoods: the text (byte trigrams, naive Bayes, tempered, since overlapping
trigrams aren't independent), the declared markup language, and the prior of the host, which is smoothed towards that
of its domain, which is smoothed towards that of its address suffix, which is smoothed towards that of all rows. Priors
and the reliability of declarations come from grouped aggregation over all rows, of the language that the text alone
speaks for; the text model is fitted on a bounded sample of labelled rows (SAMPLE_ROWS, SAMPLE_CHARS), of distinct texts,
with as many for each language that any row names. Hosts, domains and suffixes meet by join_skewed(): a domain of very many
hosts or a suffix of very many domains is no one task's. Markup is taken away by a scanner that passes over it once.

Repeated rows and ids are rows of their own, and all count; an empty table gives no rows; of extra columns,
accept_documents() returns all as they are and identify_pages() none.

Nulls: a null text or html gives no text evidence (it tells nothing apart and joins no count); a null address is a host
of its own; a null or unknown declaration is evidence of its own kind. Ties go to the first language in order.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, join_skewed, map_texts, pieces, written

#: Rows of the text model's sample, and characters of each.
SAMPLE_ROWS, SAMPLE_CHARS = 2000, 10_000
BINS, SMOOTH, TEMPER = 1 << 15, 0.5, 0.25
#: Weight, in rows, of the next wider level in a host's, domain's or suffix's prior; and of agreement in declarations.
ALPHA, BETA = 10.0, 1.0
MIN_POSTERIOR = 0.6
#: The one language of a model fitted on no rows.
NO_LANGUAGE = "und"
_RAW = re.compile(r"(?i)(script|style)\b")
_CLOSE = {name: re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style")}
_HTML = re.compile(r"(?i)<html\b")
_LANG = re.compile(r"""(?i)(?<![\w-])lang\s*=\s*["']?([a-z]{2,3})""")
_LETTERS = re.compile(rb"[^a-z\x80-\xff]+")


def visible_text(page: str) -> str:
    """The page without tags, comments, scripts and styles, each of which leaves a space. What is opened and never closed
    is a tag alone; a "<" that no ">" follows is text. One pass: what has once been looked for in vain isn't again."""
    out, at, missing = [], 0, set()

    def after(end: str, start: int) -> int:
        """Where the next end stops; -1 if there is none."""
        if end in missing:
            return -1
        if end in _CLOSE:
            m = _CLOSE[end].search(page, start)
            found = m.end() if m else -1
        else:
            found = page.find(end, start)
            found = found + len(end) if found >= 0 else -1
        if found < 0:
            missing.add(end)
        return found

    while (start := page.find("<", at)) >= 0:
        raw = _RAW.match(page, start + 1)
        stop = after(raw[1].lower(), raw.end()) if raw else after("-->", start + 4) if page.startswith("<!--", start) else -1
        if stop < 0:
            stop = after(">", start + 1)
        if stop < 0:
            break
        out.append(page[at:start])
        at = stop
    out.append(page[at:])
    return html_lib.unescape(" ".join(out))


def declared_language(page: str) -> str | None:
    """The lang attribute of the first html tag that has one."""
    at = 0
    while m := _HTML.search(page, at):
        end = page.find(">", m.end())
        end = len(page) if end < 0 else end
        found = _LANG.search(page, m.end(), end)
        if found:
            return found[1].lower()
        at = end
    return None


def trigram_bins(text: str) -> np.ndarray:
    """Bins of the byte trigrams of the letters of the text, runs of other bytes being one space."""
    data = np.frombuffer(b" " + _LETTERS.sub(b" ", text.lower().encode()).strip() + b" ", dtype=np.uint8).astype(np.uint32)
    if len(data) < 5:
        return np.empty(0, dtype=np.uint32)
    return ((data[:-2] * np.uint32(0x9E3779B1)) ^ (data[1:-1] * np.uint32(0x85EBCA6B)) ^ (data[2:] * np.uint32(0xC2B2AE35))) * np.uint32(0x27D4EB2F) >> np.uint32(17)


class TextModel:
    """Log likelihoods of trigrams by language."""

    def __init__(self, rows: list[tuple[str, str]], languages: list[str] | None = None):
        self.languages = languages or sorted({lang for _, lang in rows}) or [NO_LANGUAGE]
        counts = np.full((len(self.languages), BINS), SMOOTH)
        for text, lang in rows:
            counts[self.languages.index(lang)] += np.bincount(trigram_bins(text), minlength=BINS)
        self.log = np.ascontiguousarray(np.log(counts / counts.sum(axis=1, keepdims=True)).T.astype(np.float32))

    @classmethod
    def fit(cls, labelled: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> TextModel:
        """From distinct labelled texts of least hash, at most rows in all and as many for each language; of each, at most so many characters."""
        known = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
        n_of = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
        quota = max(1, rows // max(1, len(n_of)))
        # Tasks send on only rows of low hash, about four times as many as are wanted of the whole table.
        share = F.create_map(*(x for lang, n in n_of.items() for x in (F.lit(lang), F.lit(int(min(1.0, 4.0 * quota / n) * (1 << 40)))))) if n_of else F.lit(None).cast("map<string,bigint>")
        low = known.withColumn("h", F.xxhash64("text", "lang")).where(F.pmod("h", F.lit(1 << 40)) <= F.element_at(share, F.col("lang")))
        low = low.groupBy("lang", "h").agg(F.first(F.substring("text", 1, chars)).alias("text"))
        best = low.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("n") <= quota)
        return cls([(r.text, r.lang) for r in best.select("text", "lang").collect()], sorted(n_of))

    def score(self, text: str) -> list[float] | None:
        """Tempered log likelihood by language; None if the text has no letters or uniform noise explains it better."""
        bins = trigram_bins(text)
        if not len(bins):
            return None
        total = np.zeros(len(self.languages))
        for at in range(0, len(bins), 1 << 16):
            total += self.log[bins[at : at + (1 << 16)]].sum(axis=0, dtype=np.float64)
        if total.max() < -len(bins) * np.log(BINS):
            return None
        return (TEMPER * total).tolist()


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))


def _best(ll: Column) -> Column:
    """Index of the greatest entry, the first of equals; null of null."""
    return F.when(ll.isNotNull(), F.array_position(ll, F.array_max(ll)) - 1)


class Fusion:
    """What grouped aggregation over all rows says of hosts and declarations, and the sum of all evidence for a row.

    seen: host, declared, ll (array by language, or null), a row for each row that will be judged.
    """

    def __init__(self, seen: DataFrame, languages: list[str]):
        self.languages = languages
        n, each = len(languages), range(len(languages))
        rows = self._known(seen)
        # Reliability of declarations: at most languages x (languages + 2) counts.
        counts = {(r.best, r.said): r.n for r in rows.where("best IS NOT NULL").groupBy("best", "said").agg(F.count("*").alias("n")).collect()}
        kinds = [*languages, "none", "other"]
        self.log_said = {}
        for i in each:
            of = sum(counts.get((i, k), 0) for k in kinds) + BETA * (2 * n + 3)
            for s in kinds:
                agree = BETA * (n + 2 if s == languages[i] else 1)
                self.log_said[s, i] = float(np.log((counts.get((i, s), 0) + agree) / of))
        # Priors: counts by host, then by domain and suffix out of those.
        cols = [f"c{i}" for i in each]
        sums = [F.sum(c).alias(c) for c in cols]
        hosts = rows.groupBy("host").agg(F.count("*").alias("n_rows"), *(F.count(F.when(F.col("best") == i, 1)).alias(c) for i, c in zip(each, cols, strict=True)))
        hosts = cut(hosts.withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1)))

        def smoothed(wider: list[Column]) -> Column:
            total = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
            return F.array(*((F.col(c) + ALPHA * w) / (total + ALPHA) for c, w in zip(cols, wider, strict=True)))

        whole = hosts.agg(*sums).first()
        total = sum(x or 0 for x in whole)
        top = [F.lit(((x or 0) + 1.0) / (total + n)) for x in whole]
        by_domain = cut(hosts.groupBy("domain", "suffix").agg(F.count("*").alias("n_hosts"), *sums))
        suffixes = cut(by_domain.groupBy("suffix").agg(F.count("*").alias("n_domains"), *sums).select("suffix", "n_domains", smoothed(top).alias("wider")))
        domains = join_skewed(by_domain, suffixes, ["suffix"], "n_domains")
        domains = cut(domains.select("domain", "n_hosts", smoothed([F.col("wider")[i] for i in each]).alias("wider")))
        self.priors = cut(join_skewed(hosts, domains, ["domain"], "n_hosts").select("host", "n_rows", smoothed([F.col("wider")[i] for i in each]).alias("prior")))

    def _known(self, rows: DataFrame) -> DataFrame:
        said = F.when(F.col("declared").isin(self.languages), F.col("declared")).otherwise(F.when(F.col("declared").isNull(), "none").otherwise("other"))
        return rows.withColumn("host", F.coalesce("host", F.lit(""))).withColumn("best", _best(F.col("ll"))).withColumn("said", said)

    def weigh(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """keep..., text_lang, lang, posterior of rows with host, declared, ll."""
        each = range(len(self.languages))
        found = join_skewed(self._known(rows), self.priors, ["host"])
        text = F.coalesce("ll", F.array(*(F.lit(0.0) for _ in each)))
        said = F.array(*(F.lit(0.0) for _ in each))
        for kind in dict.fromkeys(s for s, _ in self.log_said):
            said = F.when(F.col("said") == kind, F.array(*(F.lit(self.log_said[kind, i]) for i in each))).otherwise(said)
        found = found.withColumn("said_ll", said)
        found = found.withColumn("logs", F.array(*(F.log(F.col("prior")[i]) + F.col("said_ll")[i] + text[i] for i in each)))
        named = F.array(*map(F.lit, self.languages))
        mass = F.aggregate(F.transform("logs", lambda x: F.exp(x - F.array_max("logs"))), F.lit(0.0), lambda a, x: a + x)
        at = lambda i: F.when(i.isNotNull(), F.element_at(named, (i + 1).cast("int")))
        return found.select(*keep, at(F.col("best")).alias("text_lang"), at(_best(F.col("logs"))).alias("lang"), (1.0 / mass).alias("posterior"))


def identify_pages(pages: DataFrame, model: TextModel) -> DataFrame:
    """page_id, host, declared, text_lang, lang, posterior of every page."""

    def row(page: str | None) -> tuple:
        return declared_language(page or ""), model.score(visible_text(page or ""))

    seen = cut(map_texts(pages.select("page_id", host_of(F.col("url")).alias("host"), "html"), "html", row, ["page_id", "host"], "declared string, ll array<double>"))
    return Fusion(seen, model.languages).weigh(seen, ["page_id", "host", "declared"])


def accept_documents(docs: DataFrame, model: TextModel, min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """The documents in a known language, with all their columns: those with text evidence whose fused posterior reaches min_posterior.

    The source is the host and the lang column the declaration. A text without letters, or that uniform noise explains
    better than any language, is rejected. Texts are scored once, and written beside their rows to the shared folder.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                ll = pa.array([model.score(t or "") for t in part.column("text").to_pylist()], pa.list_(pa.float64()))
                whole = pa.StructArray.from_arrays([part.column(c) for c in names], names=names)
                yield pa.RecordBatch.from_arrays([whole, ll], names=["row", "ll"])

    kind = T.StructType([T.StructField("row", docs.schema), T.StructField("ll", T.ArrayType(T.DoubleType()))])
    rows = written(docs.mapInArrow(run, kind), "language").select("row", F.col("row.source").alias("host"), F.lower("row.lang").alias("declared"), "ll")
    fusion = Fusion(rows.drop("row"), model.languages)
    return fusion.weigh(rows, ["row"]).where(F.col("text_lang").isNotNull() & (F.col("posterior") >= min_posterior)).select("row.*")
